import random

from tarnwork.llm.leakage import Finder, find_leaks, holds_passage, without_passages, without_shared_opening, words

NOUNS = "engine ladder marble copper window basket harbor violin meadow pepper saddle timber ribbon walnut candle anchor".split()


def item(seed: int, n: int = 40) -> list[str]:
    r = random.Random(seed)
    return [f"{r.choice(NOUNS)}{r.randrange(1000)}" if r.random() < 0.4 else r.choice(NOUNS) for _ in range(n)]


ITEMS = {k: " ".join(item(k)) for k in range(1, 9)}


def found(text: str) -> set[int]:
    keys = list(ITEMS)
    return {k for k, _, _ in Finder(list(zip(keys, without_shared_opening([ITEMS[k] for k in keys])))).find(text)}


def test_whole_part_and_too_short():
    ws = ITEMS[1].split()
    assert found("intro words here " + ITEMS[1] + " and more") == {1}
    assert found("x y " + " ".join(ws[5:25])) == {1}
    assert found("x y " + " ".join(ws[5:20])) == set()


def test_case_markup_layout_and_invisible_characters():
    ws = ITEMS[2].split()[3:24]
    assert found("\n// ".join(" ".join(ws[i : i + 4]).upper() for i in range(0, 21, 4))) == {2}
    assert found(" ".join(f"**{w}**" if i % 2 else f"_{w}_" for i, w in enumerate(ws))) == {2}
    assert found(" ".join(w[:2] + "⁠" + w[2:] for w in ws)) == {2}
    assert found(" ".join(ws).replace(ws[7], ws[7][:3] + "-\n * " + ws[7][3:])) == {2}


def test_altered_words():
    r = random.Random(4)
    ws = ITEMS[3].split()[:25]
    few = list(ws)
    for i in (4, 9, 14, 19):
        few[i] = "other"
    assert found(" ".join(few)) == {3}
    many = [("other" if i % 3 == 0 else w) for i, w in enumerate(ws)]
    assert found(" ".join(many)) == set()
    dropped = [w for i, w in enumerate(ITEMS[3].split()[:30]) if i not in (6, 13, 20)]
    assert found(" ".join(dropped)) == {3}
    shuffled = list(ws)
    r.shuffle(shuffled)
    assert found(" ".join(shuffled)) == set()


def test_brute_force_agrees_on_substitutions():
    """Every window of at least 18 words with at most one in five altered is found, others are not."""
    r = random.Random(9)
    base = item(77, 30)
    for _ in range(60):
        p = r.choice([0.05, 0.15, 0.3])
        doc = [w if r.random() > p else "altered" for w in base]
        hit = [a == b for a, b in zip(base, doc)]
        brute = any(hit[i] and hit[j - 1] and 5 * (j - i - sum(hit[i:j])) <= j - i for i in range(len(hit)) for j in range(i + 18, len(hit) + 1))
        assert (holds_passage(base, doc) is not None) == brute


def test_same_style_is_no_leak():
    frame = "how many {} does the {} keep when every {} of the {} must wait for the {} before it can close".split()
    make = lambda r: " ".join(w if w != "{}" else f"{r.choice(NOUNS)}{r.randrange(10**6)}" for w in frame)
    texts = [make(random.Random(i)) for i in range(120)]
    f = Finder(list(zip(range(120), without_shared_opening(texts))))
    assert {k for k, _, _ in f.find(texts[5])} == {5}
    assert f.find(make(random.Random(999))) == []


def test_shared_openings_do_not_count():
    opening = "Read the following case and choose the one answer that fits it best of all the answers given below here today."
    texts = [opening + " " + " ".join(item(k)) for k in (1, 2)] + [" ".join(item(3))]
    own = without_shared_opening(texts)
    assert own[0][0] == item(1)[0] and own[2] == item(3)
    assert without_shared_opening([texts[2], texts[2]])[0] == item(3)


def test_offsets_are_of_the_original_text():
    text = "ünïcode ** " + ITEMS[4] + " **"
    key, a, b = Finder([(4, ITEMS[4].split())]).find(text)[0]
    assert text[a:b].split()[0] in ITEMS[4].split()[:2] and text[a:b] in text
    assert words("Don't co-\nop")[0][0] == "dont"


def test_table(spark):
    docs = [(1, ITEMS[1]), (1, ITEMS[1]), (2, None), (3, ""), (4, "x " * 100_000 + ITEMS[5]), (5, ITEMS[1] + "\n" + ITEMS[2])]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(k, t) for k, t in ITEMS.items()] + [(99, None), (98, "")], "item_id long, item_text string")
    kw = dict(doc_id="doc_id", text="text", item_id="item_id", item_text="item_text")
    got = sorted((r.doc_id, r.item_id) for r in find_leaks(df, items, **kw).collect())
    assert got == [(1, 1), (4, 5), (5, 1), (5, 2)]
    assert find_leaks(df.limit(0), items, **kw).count() == 0 and find_leaks(df, items.limit(0), **kw).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    import tarnwork.llm.leakage as m

    df = spark.createDataFrame([(k, t) for k, t in ITEMS.items()], "doc_id long, text string")
    items = spark.createDataFrame([(k, t) for k, t in ITEMS.items()], "item_id long, item_text string")
    monkeypatch.setattr(m, "BLOCK_WORDS", 100)
    got = find_leaks(df, items, doc_id="doc_id", text="text", item_id="item_id", item_text="item_text").collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in ITEMS]


def test_passages_are_cut_out_with_their_sentences():
    text = "Plain words stand before it. " + ITEMS[6] + ". And plain words stand after it."
    got = without_passages(text, Finder([(6, ITEMS[6].split())]))
    assert got.split() == "Plain words stand before it. And plain words stand after it.".split()


def test_altered_words_may_stand_together():
    ws = ITEMS[1].split()[:30]
    gap = ws[:12] + ["other"] * 6 + ws[18:]
    assert found(" ".join(gap)) == {1}
    assert found(" ".join(ws[:12] + ws[18:])) == {1}
    assert found(" ".join(ws[:11] + ["other"] * 7 + ws[18:])) == set()


def test_long_documents_full_of_item_words():
    """A passage near the limit is found wherever it stands among tens of thousands of the item's words out of order."""
    r = random.Random(5)
    ws = ITEMS[3].split()
    noise = lambda n: " ".join(r.choice(ws) for _ in range(n))
    part = [("other" if i in (4, 9, 14) else w) for i, w in enumerate(ws[:19])]
    assert found(noise(9000)) == set()
    assert found(noise(7000) + " " + " ".join(part) + " " + noise(7000)) == {3}


def test_brute_force_agrees_on_edits():
    """Against edit distances of every part of the item and of the document, for deletions and insertions too."""

    def brute(x, y):
        for s in range(len(x)):
            for d in range(len(y)):
                if x[s] != y[d]:
                    continue
                row = list(range(len(y) - d + 1))
                for e in range(s + 1, len(x) + 1):
                    new = [e - s]
                    for k in range(1, len(y) - d + 1):
                        new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x[e - 1] != y[d + k - 1])))
                    row = new
                    if e - s >= 18 and any(x[e - 1] == y[d + k - 1] and 5 * row[k] <= e - s for k in range(1, len(row))):
                        return True
        return False

    r = random.Random(12)
    base = [f"w{k}" for k in range(44)]
    for _ in range(25):
        p, doc = r.choice([0.04, 0.09, 0.14]), []
        for w in base:
            x = r.random()
            doc += ["altered"] if x < p else [] if x < 1.6 * p else [w, "more"] if x < 2 * p else [w]
        assert (holds_passage(base, doc) is not None) == brute(base, doc)
