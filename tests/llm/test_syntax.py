import ast
import random

import pytest

from tarnwork.llm import grammars, lexing, productions, syntax

VALID = {
    "C": [
        "static int f(struct node *p, size_t n) {\n  unsigned a = 0;\n  for (size_t i = 0; i < n; i++) {\n    a += p->v[i] & 0x1f;\n  }\n  do {\n    a = (a * 31u) ^ p->seq;\n  } while (--n > 0);\n  return (int)a;\n}",
        "int g(void) {\n#ifdef A\n  if (x > 1) {\n#else\n  if (x > 2) {\n#endif\n    x = 3;\n  }\n  /* ( { */ char c = '{'; // )\n  const char *s = \"<<<<<<< {\" \"b\";\n  switch (x) {\n  case 1:\n  case 'a':\n    y = x ? 1 : 2;\n    break;\n  default:\n    goto out;\n  }\nout:\n  return -1;\n}",
        "struct p { int a; unsigned b : 3; struct q *next; };",
        "#define LIM(x) \\\n  ((x) > 3 ? 3 : (x))\nint h(int a) { return LIM(a); }",
        "enum e { A = 1, B, C };", "static const int t[3] = {1, 2, 3};", "int (*fp)(int, char *) = 0;", "void k(void) { struct iovec v[2] = {{h, 2}, {b, n}}; if (a) b(); else if (c) d(); else { e(); } for (;;) ; }",
    ],
    "C++": [
        "template <typename K>\nint Page<K>::load(K* p, int n) {\n  size_t s{0};\n  std::map<int, std::vector<int>> m;\n  for (const auto& e : p->v) {\n    s += e.size();\n  }\n  auto f = [&](int x) { return x < 5 ? x : 5; };\n  if constexpr (kDebug) {\n    std::cerr << \"{\" << s << std::endl;\n  }\n  const char* t = R\"(<<<<<<< {{ )\";\n  try {\n    p->r();\n  } catch (const std::exception& e) {\n    R(e.what());\n  }\n  s = std::max<int>(s, 3);\n  return Finish(s >> 2);\n}",
        "Foo::Foo(int a) : a_(a), b_{1} {}", "class A : public B {\n public:\n  A() = default;\n  virtual int f() const override { return 1; }\n private:\n  int x_ = 0;\n};", "namespace a { int b; }", "using T = std::unique_ptr<int>;", "bool operator==(const A& a, const A& b) { return a.x == b.x; }",
    ],
    "JavaScript": [
        "function f(a, b = 1, ...c) {\n  let s = 0;\n  const r = /[{(]+$/;\n  const t = `{ ${s} (`;\n  const g = (x) => (x > 3 ? 3 : x);\n  for (const k of a) { s += k; }\n  for (let i = 0; i < 3; i += 1) s += i;\n  const o = { a, b: 1, [c]: 2, m() { return 1; } };\n  if (a === '}') {\n    return null;\n  }\n  return o;\n}",
        "function f(a) {\n  const b = a.map((x) => x * 2)\n  return b\n}", "class A extends B {\n  constructor(x) { super(x); this.x = x; }\n  get y() { return 1; }\n}", "const f = async (a) => { await a(); };", "const a = b / c / d;", "do { x++; } while (x < 3)",
    ],
    "Python": [
        "def f(a, b=None, *c, **d):\n    r = 0\n    # ( {\n    p = {\n        'a(': 1,\n    }\n    t = f\"{r:>{8}} ( {a}\"\n    m = \"\"\"\n<<<<<<< {\n=======\n\"\"\"\n    with lock as l:\n        h[\"{\"] = [x for x in a if x]\n    if not b:\n        return None\n    elif a:\n        pass\n    else:\n        r = a if b else c\n    try:\n        g(a, k=1)\n    except (A, B) as e:\n        raise X from e\n    finally:\n        z = lambda q: q + 1\n    return r",
        "class A(B):\n    x: int = 1\n\n    @p\n    def f(self): return self.x\n", "import a.b as c\nfrom . import d\nx, y = 1, 2\n", "async def f():\n    async for x in y:\n        await z\n",
    ],
}
INVALID = {
    "C": ["int f(int a) {\n  if (a {\n    b();\n  }\n}", "int f(int a) {\n  b()\n  return 1;\n}", "int f(int a) {\n  for (i = 0; i < 3; i++ {\n  }\n}", "int f() {\n<<<<<<< HEAD\n  a();\n=======\n  b();\n>>>>>>> x\n}", "int f() {\n  std::map<int, int> m;\n}", "  a = 1;\n  return a;\n}", "int f() {\n  a = b +;\n}", "int f() {\n  while (x) {\n", "def f(a):\n    return a", "int f() { /* never closed }", "int f() {\n#ifdef A\n  if (x) {\n#endif\n  y();\n  }\n}", "int f() {\n  else { a(); }\n}", "int f() {\n  a = 'x;\n}", "int f() {\n... 20 lines omitted ...\n}", "int f() { return [1); }"],
    "C++": ["int A::f() {\n  for (auto e : v {\n  }\n}", "int f() {\n  try {\n    a();\n  }\n}", "function f(a) {\n  let b = 1;\n  return b;\n}", "int f() {\n  auto g = [&](int x { return x; };\n}", "int f() { std::vector<int v; }"],
    "JavaScript": ["function f(a {\n  return a;\n}", "function f(a) {\n  const t = `${a;\n}", "return 1;", "function f(a) {\n  if (a) {\n}", "int f(int a) { return a; }", "function f() {\n  let = ;\n}", "const a = {b: 1,, c: 2};", "function f() {\n  a b;\n}"],
    "Python": ["def f(a):\n  x = (1\n  return x", "def f(a)\n    return a", "    return 1\n", "def f():\n    if a:\n    return 1", "int f(int a) {\n  return a;\n}", "def f():\n    x = 'abc\n", "def f():\n<<<<<<< a\n    x = 1\n=======\n    x = 2\n>>>>>>> b\n", "def f():\n        a = 1\n    b = 2\n", "x = 1 +\n", "try:\n    a()\n", "else:\n    pass\n"],
}


def faults(text, language):
    """The three checks without Spark: adjacency, and productions (which imply nesting)."""
    codes = syntax.code_strings(text, language)
    pairs = any(set(map(str.__add__, "^" + c, c + "$")) - grammars.permissible(language) for c in codes)
    return pairs, not all(productions.checker(language).valid(c) for c in codes)


@pytest.mark.parametrize("language", list(VALID))
def test_valid_texts_pass(language):
    for text in VALID[language]:
        assert faults(text, language) == (False, False), text


@pytest.mark.parametrize("language", list(INVALID))
def test_invalid_texts_fail(language):
    for text in INVALID[language]:
        assert any(faults(text, language)), text


def test_python_agrees_with_its_parser_on_damaged_texts():
    r = random.Random(3)
    agree = total = 0
    for text in VALID["Python"]:
        for _ in range(60):
            a = r.randrange(len(text))
            cut = text[:a] + text[a + r.randrange(1, 8) :] if r.random() < 0.6 else text[:a]
            if not cut.strip():
                continue
            try:
                ast.parse(cut)
                valid = True
            except (SyntaxError, ValueError):
                valid = False
            total += 1
            agree += valid != any(faults(cut, "Python"))
    assert agree / total > 0.93


def test_derived_pairs_are_few():
    for language in VALID:
        ok = grammars.permissible(language)
        letters = {c for p in ok for c in p}
        assert len(ok) < 0.5 * len(letters) ** 2
    pairs, first, last = grammars.derive("top: aa+ c\naa: a bb?\nbb: b / eps\neps: bb?")
    assert pairs == {"aa", "ab", "ba", "ac", "bc"} and first == "a" and last == "c"


def test_nesting_by_windows(spark):
    rows = ["", "(())", "([)]", "{", "}", "({u[]v})", "(" * 500 + ")" * 500, "())("]
    got = {r.brackets for r in syntax.badly_nested(spark.createDataFrame([(x,) for x in rows + rows], "brackets string")).collect()}
    assert got == {"([)]", "{", "}", "())("}


def test_table(spark):
    rows = []
    ext = {"C": "c", "C++": "cc", "JavaScript": "js", "Python": "py"}
    k = 0
    want = set()
    for lang in VALID:
        for bad, texts in ((False, VALID[lang]), (True, INVALID[lang])):
            for t in texts:
                k += 1
                rows.append((k, f"a/b.{ext[lang]}", t, 0, "r"))
                if bad:
                    want.add(k)
    rows += rows[:9] + [(900, "x.c", None, 0, "r"), (901, "x.py", " \n", 0, "r"), (902, "x.md", "((", 0, "r"), (903, None, "((", 0, None), (904, "y.C", "int f() { " + "a = (b + c) * d[1]; " * 20_000 + "}", 0, "r")]
    df = spark.createDataFrame(rows, "file_id long, file_path string, content string, language int, codes string")
    got = [r.file_id for r in syntax.invalid_files(df, file_id="file_id", path="file_path", content="content").collect()]
    assert sorted(got) == sorted(want)
    rates = syntax.invalid_rates(df, syntax.invalid_files(df, file_id="file_id", path="file_path", content="content"), file_id="file_id", path="file_path", content="content", repository="codes").collect()
    assert sum(r.n_invalid for r in rates) == len(want)
    assert syntax.invalid_files(df.limit(0), file_id="file_id", path="file_path", content="content").count() == 0


def test_unbalanced_conditionals():
    assert lexing.lex("#if A\nint a;\n", "C") == ["X"] and lexing.lex("int a;\n#endif\n", "C") == ["X"]
    assert len(lexing.lex("#if A\nint a;\n#elif B\nint *a;\n#else\nint a();\n#endif", "C")) == 3


@pytest.mark.parametrize("language", ["C", "C++"])
def test_every_branch_and_mix_of_conditions_is_checked(language):
    bad = [
        "int f(int a) {\n#if A\n  b();\n#else\n#if B\n  if (a {\n#endif\n#endif\n  return 1;\n}",  # inside the outer else
        "int f(int a) {\n#ifdef A\n#ifdef B\n  b();\n#else\n  if (a) {\n#endif\n#endif\n  return 1;\n}",  # an else inside the first branch
        "int f(int a) {\n#ifdef HAVE_QUEUE\n  if (a) {\n#endif\n  b();\n#ifdef HAVE_PACKET\n  }\n#endif\n  return 1;\n}",  # one on, one off
        "int f(int a) {\n" + "".join(f"#ifdef C{k}\n  b({k});\n#endif\n" for k in range(12)) + "#ifdef X\n  if (a) {\n#endif\n  b();\n#ifdef Y\n  }\n#endif\n  return 1;\n}",
    ]
    good = [
        "int f(int a) {\n#ifdef A\n  if (a) {\n#endif\n  b();\n#if defined(A)\n  }\n#endif\n  return 1;\n}",
        "int f(int a) {\n#ifdef A\n  if (a) {\n#endif\n  b();\n#ifndef A\n  c();\n#else\n  }\n#endif\n  return 1;\n}",
        "int f(int a) {\n#if V > 2\n  if (a > 2) {\n#elif V > 1 /* x */\n  if (a > 1) {\n#else\n  {\n#endif\n  b();\n  }\n  return 1;\n}",
        "int f(int a) {\n" + "".join(f"#if defined(C{k}) && !C{k + 1}\n  b({k});\n#else\n  c();\n#endif\n" for k in range(14)) + "  return 1;\n}",
    ]
    assert all(any(faults(t, language)) for t in bad)
    assert not any(any(faults(t, language)) for t in good)
    assert lexing.lex("int a;\n#else\nint b;\n#endif", language) == ["X"]


def test_deep_nests_and_many_brackets(spark):
    deep = "int f(int a) { return " + "(" * 450 + "a" + ")" * 450 + "; }"
    assert productions.checker("C").valid(lexing.lex(deep, "C")[0])
    assert not productions.checker("C").valid(lexing.lex(deep.replace("))))", ")))", 1), "C")[0])
    assert not productions.checker("C").valid(lexing.lex(deep.replace("a))", "a+))", 1), "C")[0])
    many = "int f(void) {\n" + "g(a[1]);\n" * 50_000 + "}\n"
    df = spark.createDataFrame([(1, "x.c", many), (2, "x.c", many[:-2]), (3, "x.c", deep), (4, "x.js", "function f() { return " + "(" * 3000 + "a" + ")" * 3000 + "; }")], "file_id long, file_path string, content string")
    got = {r.file_id for r in syntax.invalid_files(df, file_id="file_id", path="file_path", content="content").collect()}
    assert got == {2}


def test_many_faulty_codes_are_met_by_shuffle(spark, monkeypatch):
    rows = [(k, "x.c", "int f(void) { return (; }" if k % 3 else "int f(void) { return 1; }") for k in range(60)] + [(99, "x.c", "int f( {"), (99, "x.c", None)]
    df = spark.createDataFrame(rows, "file_id long, file_path string, content string")
    kw = dict(file_id="file_id", path="file_path", content="content")
    few = {r.file_id for r in syntax.invalid_files(df, **kw).collect()}
    monkeypatch.setattr(syntax, "BROADCAST_KEYS", 0)
    assert {r.file_id for r in syntax.invalid_files(df, **kw).collect()} == few == {k for k in range(60) if k % 3} | {99}
