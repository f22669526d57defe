import random

import numpy as np
import pytest

from tarnwork.llm import pairs as p

SUBJECTS = ["The loop", "The buffer", "This function", "The parser", "The cache", "The lookup"]
VERBS = ["walks the list twice", "copies each element", "holds the lock too long", "computes the length again", "allocates on every call", "formats text that is never shown"]
ENDS = ["so the strategy applies here.", "and the rewrite removes that cost.", "which the new code avoids.", "therefore the idea fits well.", "so nothing can be gained from it."]
CODE = [("for (size_t i = 0; i < strlen({x}); i++) {{\n  sum += {x}[i];\n}}", "size_t n = strlen({x});\nfor (size_t i = 0; i < n; i++) {{\n  sum += {x}[i];\n}}"), ("std::map<int, int> {x};", "std::unordered_map<int, int> {x};"), ("{x} = {x} % 64;", "{x} = {x} & 63;"), ("if (slow({x}) && {x}->flag) {{\n  go();\n}}", "if ({x}->flag && slow({x})) {{\n  go();\n}}")]
NAMES = ["buf", "key", "slot", "node", "page", "path", "item", "row"]


def texts(n, seed):
    r = random.Random(seed)
    return [(f"Does the strategy of hoisting the {r.choice(NAMES)} call apply to `{r.choice(NAMES)}_{i}`? Explain.", f"{r.choice(SUBJECTS)} {r.choice(VERBS)}, {r.choice(ENDS)}") for i in range(n)]


def codes(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = r.choice(CODE)
        x = r.choice(NAMES) + str(r.randrange(9))
        out.append((a.format(x=x), b.format(x=x)))
    return out


@pytest.fixture(scope="module")
def models():
    return {"explanation": p.train("explanation", texts(900, 1)), "code": p.train("code", codes(900, 2))}


def test_held_out_accuracy(models):
    """Pairs broken anew, with other seeds, and sound ones."""
    r = random.Random(5)
    for kind, make in (("explanation", texts), ("code", codes)):
        sound = make(300, 6)
        flagged = [d for d in p.defects_of(kind, models[kind], [q for q, _ in sound], [a for _, a in sound])[0] if d]
        assert len(flagged) / len(sound) < 0.02
        hit = total = 0
        for q, a in sound[:150]:
            for bq, ba, d in p.broken(r, kind, q, a, []):
                total += 1
                hit += p.defects_of(kind, models[kind], [bq], [ba])[0][0] == d
        assert hit / total > 0.85


def test_each_defect(models):
    q, a = texts(1, 9)[0]
    cases = [("", "empty"), ("TODO", "empty"), (None, "empty"), ("​ \n", "empty"), (a[: len(a) // 2], "truncated"), ("I'm sorry, but I cannot help with this request.", "refusal"), (q, "copied"), ("Die Funktion kann nicht schneller werden, weil der Puffer klein ist und nur einmal gelesen wird.", "other_language"), (a, None), (a.rstrip("."), None)]
    got, _ = p.defects_of("explanation", models["explanation"], [q] * len(cases), [c for c, _ in cases])
    assert [g == want for g, (_, want) in zip(got, cases)].count(False) <= 1, list(zip(got, cases))
    q, a = codes(1, 10)[0]
    cases = [("", "empty"), ("```\n" + q + "\n```", "copied"), ("// same\n" + q.replace("\n", "\n    "), "copied"), ("acc = [x * 2 for x in row]\nfor k in range(len(row)):\n    acc.append(k)", "other_language"), (a, None)]
    got, _ = p.defects_of("code", models["code"], [q] * len(cases), [c for c, _ in cases])
    assert [g == want for g, (_, want) in zip(got, cases)].count(False) <= 1, list(zip(got, cases))


def test_nothing_to_train_on_flags_nothing():
    for kind in ("explanation", "code", "summary"):
        assert p.defects_of(kind, p.train(kind, []), ["q", ""], ["an answer", None])[0] == [None, None]


def test_table(spark, monkeypatch):
    monkeypatch.setattr(p, "SAMPLE", 500)
    rows = [("answer", i, 0, "explanation", q, a, 0) for i, (q, a) in enumerate(texts(500, 3))]
    rows += rows[:20] + [("answer", 9000, 0, "explanation", None, None, 0), ("answer", 9001, 0, "explanation", "q?", "word " * 60_000 + "end.", 0)]
    df = spark.createDataFrame(rows, "origin string, record_id long, item int, kind string, question string, answer string, margin int")
    got = {(r.origin, r.record_id, r.item): r.defect for r in p.find_defects(df, ("explanation",)).collect()}
    assert got[("answer", 9000, 0)] == "empty" and len(got) < 20
    assert p.find_defects(df.limit(0), ("explanation",)).count() == 0


def test_long_code_is_counted_whole():
    """Signs of another language in the middle count, and a sound long function keeps its balance."""
    part = "if (p->flag && check(p)) {\n  total = total + step(p, (1 + 2));\n}\n"
    sound = part * 150
    assert len(sound) > 5000
    short = p.code_features("x = 1;", part)
    assert p.code_features("x = 1;", sound)[7:12] == short[7:12] == (0.0,) * 5
    middle = sound + "for k in range(len(xs)):\n    val = None\n" * 20 + sound
    assert p.code_features("x = 1;", middle)[24] > p.code_features("x = 1;", sound + sound)[24]


def test_ngrams_of_long_texts():
    """All bytes are hashed, in pieces as in one, and the last n-grams are those of the end."""
    def buckets(t, ends=False):
        row, b, w = p.gram_rows([t], ends)
        return np.bincount(b, w, p.BUCKETS)

    def plain(t):
        d = np.frombuffer(t.lower().encode(), dtype="uint8").astype("uint32")
        return np.bincount(p.gram_buckets(d, 5), minlength=p.BUCKETS) / np.sqrt(len(d) - 4)

    rnd = random.Random(3)
    for n in (300, 900, 30_000):
        t = " ".join(rnd.choice(NAMES) + str(rnd.randrange(999)) for _ in range(n))
        assert np.allclose(buckets(t), plain(t))
        chinese = "因为循环内的值不变所以" * (n // 3) + "适用。"
        assert np.allclose(buckets(chinese), plain(chinese))
        ends = buckets(chinese, True) - buckets(chinese)
        for k in (3, 5, 8, 12, 18):
            assert ends[p.hash_bytes(chinese.encode()[-k:], 977 + k) & p.BUCKETS - 1] > 0.5


def test_pieces_of_ngrams_join(monkeypatch):
    t = "".join(random.Random(8).choice("abcdefgh ") for _ in range(9001))
    whole = p.gram_rows([t, "short text"], True)
    monkeypatch.setattr(p, "PIECE", 700)
    assert all(np.allclose(a, b) for a, b in zip(whole, p.gram_rows([t, "short text"], True)))


def test_repeated_pairs_are_scored_once(models, monkeypatch):
    made = [(q, a) for q, a in codes(40, 12)] + [("x = 1;", None), ("x = 1;", "")]
    once = p.defects_of("code", models["code"], [q for q, _ in made], [a for _, a in made])
    seen, real = [], p.features

    def counted(kind, questions, answers, *more):
        seen.append(len(answers))
        return real(kind, questions, answers, *more)

    monkeypatch.setattr(p, "features", counted)
    many = made * 30
    random.Random(4).shuffle(many)
    got, by = p.defects_of("code", models["code"], [q for q, _ in many], [a for _, a in many])
    assert sum(seen) == len({(q, a or "") for q, a in made})
    want = {pair: (d, m) for pair, d, m in zip(made, *once)}
    assert got == [want[pair][0] for pair in many] and np.allclose(by, [want[pair][1] for pair in many])
    assert got[many.index(("x = 1;", None))] == "empty"


def test_sums_of_ngrams_are_those_of_their_rows(models):
    """Scores as for the fit, for texts without an n-gram, at the bound of long ones, beyond it, and all in one chunk."""
    m = models["explanation"]
    made = ["", "a", "abcd", "abcde", "因为", "é" * 2000, "x" * p.LONG, "y" * (p.LONG + 1), "The end. " * 900, "\ud800 broken", " \n"]
    for some in (made, made[::-1], made[:3], made[7:8]):
        dense = np.zeros((len(some), len(m.dense)))
        assert np.allclose(m.of_texts(dense, some), m.scores(dense, p.gram_rows(some, True)))


def test_words_and_signs_without_a_search():
    r = random.Random(7)
    parts = ["_", "__", "a", "B", "9", " ", "\t", "\n", "\x00", "\x1c", "-", ".", "`", "é", "İ", "²", "中", "snake_case", "don't"]
    signs = ["def", "for x, y in z", "[x for x in y]", "not in", "is not", "async def", "f\"", "**k", "a: ", "len(", "let", "const", "of", "`${", ".push", "===", "=>", ":=", "func", "-> i3", ".iter()", "nil", "new ArrayList", "let mut", "std::x", "p->x"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(9)))
        assert p.words_of(t) == p._WORDS.findall(t.lower())
        code = r.choice(["", " ", "\n"]).join(r.choice(signs + parts) for _ in range(r.randrange(5)))
        assert p.code_language(code) == {lang: len(s.findall(code)) for lang, s in p._CODE_SIGNS.items()}


def test_features_of_a_pair_do_not_depend_on_the_others():
    pairs = [(q, b) for q, a in texts(20, 14) for b in (a, a[:30], q, "I cannot do that, sorry.", "Das ist nicht die Antwort.", "因为循环", "", "a_b")]
    every = p.text_features([q for q, _ in pairs], [a for _, a in pairs], False)
    assert every.shape == (len(pairs), 46) and p.text_features([], [], True).shape == (0, 46)
    assert all((p.text_features([q], [a], False)[0] == f).all() for (q, a), f in zip(pairs, every))
