import random

from tarnwork.llm import mojibake as m

CLEAN = ["Die Größe der Prüfung ändert sich für jeden Schlüssel", "La función búsqueda más rápida según la última medición", "le café déjà fermé près de la forêt", "тест стал быстрее for the row loader after изменения кода", "请注意缓存的大小必须是二的幂", "latency ≤ 9 µs and cost €5 — fine", "keep the “label” as it was…"]
ROUTES = [("utf-8", "cp1252"), ("utf-8", "latin_1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1251", "latin_1"), ("gbk", "latin_1")]


def corpus(n=900, seed=1):
    r = random.Random(seed)
    rows, bad = [], {}
    for i in range(n):
        text = f"note {i} about\n" + r.choice(CLEAN)
        if r.random() < 0.2:
            line = text.split("\n")[1]
            g = m.garble(line, r.choice(ROUTES))
            if g and r.random() < 0.2 and (h := m.garble(g, ("utf-8", "cp1252"))):
                g = h
            if g and g != line:
                bad[i] = text
                text = text.split("\n")[0] + "\n" + g
        rows.append(("message", i, text))
    return rows, bad


def test_garble_round_trips():
    for text in CLEAN:
        for route in ROUTES:
            g = m.garble(text, route)
            if g and g != text:
                assert m.ungarble(g, route) == text


def test_found_and_restored(spark):
    rows, bad = corpus()
    rows += rows[:40]
    rows += [("message", 5000, None), ("message", 5001, ""), ("message", 5002, "plain ascii with \\xc3\\xa4 and \\ufffd written out"), ("message", 5003, "lost �"), ("diff", 0, "nothing")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "origin string, record_id long, text string, w int, salt string")
    found = [(r.origin, r.record_id) for r in m.find_garbled(df, "text").collect()]
    assert len(found) == len(set(found))
    got = {i for o, i in found if o == "message"}
    assert 5003 in got and not got & {5000, 5001, 5002}
    got -= {5003}
    assert len(got & set(bad)) / len(bad) > 0.95 and len(got - set(bad)) <= 2
    fixed = {r.record_id: r for r in m.restore_text(df, "text").collect()}
    right = sum(fixed[i].restored == bad[i] for i in bad if i in fixed)
    assert right / len(bad) > 0.8
    assert not fixed[5003].complete


def test_clean_text_is_no_case(spark):
    rows = [("message", i, CLEAN[i % len(CLEAN)] + " MAÇÃ / PÃO «x» ┌──┬──┐ Â and Ã rows") for i in range(200)]
    assert m.find_garbled(spark.createDataFrame(rows, "origin string, record_id long, text string"), "text").count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "origin string, record_id long, text string")
    assert m.find_garbled(df, "text").count() == 0 and m.restore_text(df, "text").count() == 0
