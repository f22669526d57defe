"""Broken prompt and response pairs: a multi-label linear classifier over hashed n-grams and pair features.

Nothing is labelled. A bounded sample of pairs (``SAMPLE`` of each kind, the first by hash of their id) is taken as
mostly sound and broken on purpose: emptied, cut off, replaced by a refusal, by a copy of the question, or swapped for an
answer in another language. One logistic model a kind and a defect is fitted on these; what the
first fit finds defective in the sample leaves the sound rows and the model is fitted again; thresholds are set on
held-out pairs. Every pair of the tables is then scored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ["empty", "truncated", "refusal", "copied", "other_language"]
SAMPLE = 6000  # pairs of each kind for the classifier
BROKEN = 1500  # of them to break
BUCKETS = 1 << 16
CHUNK, CHUNK_CHARS = 500, 2_000_000  # answers, and their length, that are scored at a time
LONG, PIECE = 4000, 1 << 20  # bytes from which on n-grams of a text are counted by bucket, so many bytes at a time
END_GRAMS, END_WEIGHT = (3, 5, 8, 12, 18), 0.6  # last bytes of a text that count as n-grams of their own
EPOCHS, BATCH, RATE, DECAY = 12, 512, 0.15, 1e-6

#: Share of pairs assumed to have a given defect, for the thresholds.
DEFECT_SHARE = 0.02

# ---- fixed values: words by which a language shows, stock phrases of models, placeholders

FUNCTION_WORDS = {
    "en": "the a an of to in is it and or that this be by for with as on at from not no are was which can so than into its if".split(),
    "de": "der die das und ist nicht ein eine einen den dem des mit auf für von zu im wird werden auch nur sich wenn weil durch keine nach oder".split(),
    "fr": "le la les des du un une et est pas ne que qui dans pour sur avec par ce cette plus au aux après sont elle il cela mais".split(),
    "es": "el la los las de del un una y es no que en por para con se su lo como más pero este esta al sólo sino ya entero".split(),
    "pt": "o a os as de do da dos das um uma e é não que em por para com se sua no na mais mas foi ser ao há apenas após".split(),
    "it": "il lo la gli le di del della un una e è non che in per con si su come più ma questo questa al sono dei nella".split(),
    "nl": "de het een en is niet dat van op te in voor met door naar zijn worden ook maar deze dit bij als er geen".split(),
}
REFUSALS = [
    "I'm sorry, but I can't help with that.", "I cannot assist with this request.", "Sorry, I can't rewrite code for you.", "I am unable to provide an optimised version of {x}.", "Sorry, I am not able to help with {x}.",
    "As an AI language model, I cannot review code like this.", "As an AI, I am not able to judge {x}.", "I must decline this request.", "I must refuse to change {x}.", "I won't be able to analyse {x}.", "I will not review {x}. Can I help you with anything else?",
    "My guidelines do not allow me to review {x}.", "My instructions prevent me from commenting on code.", "It would be inappropriate for me to modify {x}.", "This is not something I am comfortable answering.", "I'm not comfortable with giving advice on this.",
    "Unfortunately I don't have permission to look at {x}.", "Unfortunately, I lack the information to give you any opinion on {x}; please ask somebody else.", "I apologise, but I can not comply with this request.", "I apologize, however I am unable to comply.", "The policy forbids any comment on {x}.",
    "I cannot provide an explanation for this code.", "This request goes against my usage policy, so I will not answer it.", "I prefer not to answer.", "I have to refuse this task for safety reasons.", "I'm not able to discuss the contents of {x}.", "Sorry, that is something I cannot do.",
    "I do not feel comfortable evaluating {x}.", "I'm afraid I can't do that.", "Company policy does not permit me to comment on {x}.", "I am not in a position to say anything about {x}.", "It is against my instructions to modify {x}.", "I respectfully decline to evaluate {x}.", "I can't share an analysis of this.",
    "No answer can be given to this question under the current policy.", "I don't have enough context to help; please ask someone else.", "You will have to ask a human reviewer, I cannot answer this.", "I can't provide an optimised version.", "I am not allowed to rewrite proprietary code.",
    "我无法回答这个问题。", "抱歉，我不能帮助处理这段代码。", "对不起，我不能提供这方面的帮助。", "根据规定，我不便评价这段代码。", "很抱歉，我无法完成这个请求。",
]
#: Ways on from a cut, themselves unfinished, and words that do not end a sentence.
UNFINISHED = ["because", "which", "so that", "but only if", "while", "since", "and then", "although", "in order to", "and", "or", "for", "with", "that is", "whereas", "as", "when", "if"]
DANGLING = frozenset("a an the of to in on at by for with from and or but so that which who because since while as if when than then into its their this is are was be been not only whereas although in order it".split())
PLACEHOLDERS = ["", " ", "\n", " \n", "\u00a0\n", "\u200b", "n/a", "N/A", "na", "null", "None", "nil", "none", "undefined", "-", "--", "—", "...", "…", "?", ".", "TODO", "TBD", "todo", "tbd", "(empty)", "(none)", "(no answer)", "no answer", "<empty>", "[]", "{}", '""', "``", "```\n```", "```cpp\n```", "```c\n```", "```python\n\n```", "// TODO", "// code", "// put the code here", "{ }", "/* TODO */", "# TODO", "// ...", "pass", "[answer]", "<answer>", "<placeholder>", "xxx", "placeholder", "N.A.", "待补充", "无", "{\"explanation\": \"\"}"]
FOREIGN = {
    "zh": ["这个函数可以使用该策略，因为循环里的值没有变化。", "修改之后代码运行得更快，锁的持有时间也缩短了。", "该优化不适用，缓冲区太小。", "请注意，这里不需要加锁，因为没有共享状态。"],
    "ja": ["この関数には適用できます。ループの中で値が変わらないためです。", "変更後は処理が速くなりました。", "引数が小さいので、この方法は使えません。"],
    "ko": ["이 함수에는 전략을 적용할 수 있습니다.", "변경 후 잠금 시간이 줄었습니다."],
    "ru": ["Эта функция может быть ускорена, потому что длина не меняется в цикле.", "После изменения код работает быстрее.", "Стратегия здесь не подходит."],
    "ar": ["يمكن تطبيق هذه الاستراتيجية على الدالة لأن القيمة لا تتغير."],
    "de": ["Die Funktion kann so beschleunigt werden, weil sich die Länge in der Schleife nicht ändert.", "Nach der Änderung wird die Sperre nur noch kurz gehalten.", "Das Verfahren ist hier nicht anwendbar, denn der Puffer ist klein.", "Der Wert wird nur einmal berechnet und danach wieder verwendet."],
    "fr": ["La fonction peut être accélérée, car la longueur ne change pas dans la boucle.", "Après la modification, le verrou est gardé moins longtemps.", "Cette méthode ne s'applique pas ici, parce que le tampon est petit.", "La valeur est calculée une seule fois puis réutilisée."],
    "es": ["La función se puede acelerar, porque la longitud no cambia dentro del bucle.", "Después del cambio, el cerrojo se mantiene menos tiempo.", "Esta estrategia no es aplicable aquí, ya que el búfer es pequeño.", "El valor se calcula una sola vez y luego se reutiliza."],
    "pt": ["A função pode ser acelerada, porque o comprimento não muda no laço.", "Depois da alteração, o bloqueio é mantido por menos tempo.", "Esta estratégia não se aplica aqui, pois o buffer é pequeno.", "O valor é calculado apenas uma vez e depois reutilizado."],
    "it": ["La funzione può essere accelerata, perché la lunghezza non cambia nel ciclo.", "Dopo la modifica il blocco viene tenuto per meno tempo."],
    "nl": ["De functie kan sneller worden gemaakt, omdat de lengte niet verandert in de lus.", "Na de wijziging wordt het slot korter vastgehouden."],
}
ENGLISH = ["The function can be made faster, because the length does not change inside the loop.", "After the change the lock is held for a shorter time.", "The strategy does not apply here, since the buffer is small.", "The value is computed once and then used again.", "Yes, the idea fits: the same key is looked up twice."]
OTHER_CODE = {
    "python": ["acc_ = [x * {n} for x in {x}]", "for k in range(len({x})):\n    val += {x}[k]", "def {x}(a, b):\n    return a + b", "with open({x}) as f:\n    data = f.read()", "{x} = \"\".join(parts)", "if {x} is None:\n    return {n}", "while {x} > {n}:\n    {x} -= 1", "total = sum(v for v in {x}.values())", "import numpy as np\nres = np.sum({x})", "{x} = {k: v for k, v in items}", "lo = bisect.bisect_left({x}, {n})", "print(f\"{x}: {n}\")", "try:\n    {x}()\nexcept ValueError:\n    pass"],
    "js": ["const out_ = {x}.map((v) => v * {n});", "for (const v of {x}) {\n  total += v;\n}", "let {x} = [];\n{x}.push({n});", "function {x}(a, b) {\n  return a + b;\n}", "const {x} = new Map();", "{x}.forEach((v) => console.log(v));", "if ({x} === undefined) {\n  return null;\n}", "const n = {x}.length;\nlet sum = 0;", "export default {x};", "const { {x} } = require('mod');", "const seen_ = new Set({x});"],
    "c": ["size_t n = strlen({x});\nfor (size_t i = 0; i < n; i++) {\n  sum += {x}[i];\n}", "memcpy(dst, src, {n} * sizeof(*dst));", "std::vector<int> {x};\n{x}.reserve({n});", "if (p->flag && check(p)) {\n  val = {n};\n}", "auto it = map_.find({x});", "const std::string& {x} = name_;", "char {x}[{n}];\nread_all(p, {x}, {n});", "out_ = std::move({x});", "int32_t {x} = {n};", "static inline void {x}(struct node *p) {\n  p->hits++;\n}"],
    "java": ["List<Integer> {x} = new ArrayList<>({n});", "for (String s : {x}) {\n  System.out.println(s);\n}", "public int {x}() {\n  return {n};\n}", "final StringBuilder sb = new StringBuilder();"],
    "go": ["for i, v := range {x} {\n\tsum += v\n}", "{x} := make([]int, 0, {n})", "func {x}(a int) int {\n\treturn a + {n}\n}", "if err != nil {\n\treturn err\n}"],
    "rust": ["let mut {x} = Vec::with_capacity({n});", "for v in {x}.iter() {\n    sum += v;\n}", "fn {x}(a: i32) -> i32 {\n    a + {n}\n}"],
}
_CODE_SIGNS = {
    "python": re.compile(r"^\s*(?:def|class|elif|except|with|import|from|assert|lambda|async def)\b|:\s*$|\bfor \w+(?:, ?\w+)* in\b|\b(?:None|True|False|self|not in|is not|is None)\b|\brange\(|\blen\(|\[[^\]\n]* for \w+ in |f\"|\*\*\w", re.M),
    "js": re.compile(r"=>|===|!==|\b(?:let|var|function|undefined|typeof|require|export|const)\b(?!\s+(?:std|auto|char|int|void|struct|unsigned|size_t|\w+[ *&]+\w+\s*[=;)(]))|\.(?:length|push|map|filter|forEach|includes|join)\b(?!_)|console\.|`[^`\n]*\$\{|\bof\b"),
    "c": re.compile(r"->|::|\b(?:int|char|size_t|unsigned|void|struct|auto|std|sizeof|bool|double|float|long|uint\d+_t|int\d+_t|memcpy|malloc|nullptr|NULL|template|static|inline|__\w+)\b|#include|&\w+\)|\*\w+[ ;=)]|\w+_\.\w+\("),
    "other": re.compile(r":=|\bfunc\b|\bfn\b|\blet mut\b|\bpublic\b|\bpackage\b|\bimpl\b|\bnew ArrayList|\bSystem\.|-> [iu]\d+|\.iter\(\)|\bString\b|\bnil\b"),
}
#: Any sign of a language holds one of these; a text without them needs no search for signs. Nearly all code holds one of C's.
_CODE_HINTS = {
    "python": [*"def class elif except with import from assert lambda : None True False self range( len( f\" **".split(), " in", "is not"],
    "js": "=> === !== let var function undefined typeof require export const .length .push .map .filter .forEach .includes .join console. ` of".split(),
    "c": [""],
    "other": [*":= func fn public package impl System. .iter() String nil".split(), "let mut", "new ArrayList", "-> "],
}

_WORDS = re.compile(r"[^\W_]+(?:_[^\W_]+)*")
_COMMENTS = re.compile(r"```[\w+]*|//[^\n]*|/\*.*?\*/|^\s*#(?!include|define|if|endif|else)[^\n]*", re.S | re.M)
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0590-\u06ff\u0900-\u0dff\u0e00-\u0e7f]")
_IN = {w: lang for lang, ws in reversed(FUNCTION_WORDS.items()) for w in ws}
_OF = {lang: frozenset(ws) for lang, ws in FUNCTION_WORDS.items()}
_FOREIGN_ONLY = frozenset(w for lang, ws in FUNCTION_WORDS.items() if lang != "en" for w in ws) - _OF["en"]
_EN_ONLY = _OF["en"] - frozenset(w for lang, ws in FUNCTION_WORDS.items() if lang != "en" for w in ws)
_LATIN = re.compile("[à-öø-ÿßœ]", re.I)
_KEEP = re.compile(r"[\W_]+")
_ASCII_WORDS = bytes(ord(chr(i).lower()) if i < 128 and (chr(i).isalnum() or chr(i) == "_") else 32 for i in range(256))


def words_of(text: str) -> list[str]:
    """``_WORDS`` of the lower-case text; most texts are ASCII, where a table of bytes does it in a fraction of the time."""
    if text.isascii():
        t = text.encode("ascii").translate(_ASCII_WORDS).decode("ascii")
        if "_" not in t or not ("__" in t or " _" in t or "_ " in t or t[0] == "_" or t[-1] == "_"):
            return t.split()
    return _WORDS.findall(text.lower())


def folded(text: str) -> str:
    return _KEEP.sub(" ", text.lower()).strip()


def script_shares(text: str) -> tuple[float, float, float]:
    n = max(1, len(text))
    if text.isascii():
        return 0.0, 0.0, 0.0
    return len(_CJK.findall(text)) / n, len(_CYRILLIC.findall(text)) / n, len(_OTHER_SCRIPT.findall(text)) / n


@lru_cache(4096)
def _asked(question: str, summary: bool) -> tuple:
    words = words_of(question)
    line = words_of(question.split("\n")[0]) if summary else words
    cjk = not summary and not question.isascii() and len(_CJK.findall(question)) > 5
    return cjk, frozenset(words), Counter(line), len(line), " ".join(line), " ".join(words)


@lru_cache(4096)
def _threes(flat: str) -> frozenset[tuple[str, str, str]]:
    words = flat.split(" ")
    return frozenset(zip(words, words[1:], words[2:]))


# words by which a refusal may show
_SELF = frozenset("i my me myself".split())
_DECLINE = frozenset("sorry apologise apologize unable decline refuse refused cannot unfortunately permission permit permitted policy guidelines instructions comfortable appropriate inappropriate allowed assist comment prefer answer help afraid request position".split())


def text_counts(question: str, answer: str, summary: bool, vocabulary: frozenset[str]) -> tuple:
    """What ``text_features`` is computed of, by answer."""
    a = answer.strip()
    ascii = a.isascii()
    words = words_of(a)
    n = len(words)
    cjk, cyr, other = (0.0, 0.0, 0.0) if ascii else script_shares(a)
    wants_cjk, q_set, line, asked, flat_line, flat_q = _asked(question, summary)
    a_set = set(words)
    foreign = 0 if a_set.isdisjoint(_FOREIGN_ONLY) else sum(map(_FOREIGN_ONLY.__contains__, words))
    selves = 0 if a_set.isdisjoint(_SELF) else sum(map(_SELF.__contains__, words))
    declines = 0 if a_set.isdisjoint(_DECLINE) else sum(map(_DECLINE.__contains__, words))
    known = bytes(map(q_set.__contains__, words))  # 1 for a word of the question
    flat = " ".join(words)
    tail = words[-1] if n else ""
    last = a[-1:] or " "
    ticks = a.count("`")
    return (
        n, sum(map(_EN_ONLY.__contains__, words)), foreign, selves, declines, known.count(1), asked, sum(map(line.__getitem__, a_set.intersection(q_set))),
        len(_threes(flat_q).intersection(zip(words, words[1:], words[2:]))) if b"\1\1\1" in known else 0,
        0 if ascii else len(_LATIN.findall(a)), cjk, cyr, other, wants_cjk, n > 0 and (flat == flat_line or flat == flat_q), n >= 4 and flat in flat_q,
        n > 0 and ascii and last.isalpha() and tail not in vocabulary and tail not in q_set, "_" in tail, n > 2 and tail in DANGLING,
        last in ".!?。！？\"'`)”", last.isalnum(), last in ",;:([{<=&|+-*/\\", a.endswith("...") or last == "…", ticks,
        a.count("(") + a.count("[") + a.count("{") - a.count(")") - a.count("]") - a.count("}"), a.count("\""), a.count("```") if ticks > 2 else 0, a[:1] == "{" and last != "}",
    )


def text_features(questions: list[str], answers: list[str], summary: bool, vocabulary: frozenset[str] = frozenset()) -> np.ndarray:
    counts = [text_counts(q, a, summary, vocabulary) for q, a in zip(questions, answers)]
    (n, english, foreign, selves, declines, inside, asked, back, run, latin, cjk, cyr, other, wants_cjk, same, part, odd, joined, dangling, closed, letter, goes_on, dots, ticks, opened, quotes, fences, brace) = np.array(counts, dtype="float64").reshape(-1, 28).T
    wants, same, part, letter, dots, odd = wants_cjk > 0, same > 0, part > 0, letter > 0, dots > 0, odd > 0
    off = np.where(wants, (cjk < 0.15) & (n > 4), (cjk > 0.15) | (cyr > 0.15) | (other > 0.15))
    some, new, run3 = np.maximum(n, 1), n - inside, run / np.maximum(n - 2, 1)
    return np.stack([
        n == 0, n == 1, n == 2, np.minimum(n, 30) / 30,
        closed, letter, goes_on, dots & (n > 2), dots & (n <= 2),
        ticks % 2, opened > 0, quotes % 2, fences % 2, brace,
        off, wants, np.where(wants, 0.0, cjk), cyr, other,
        np.minimum(foreign, 6) / 6, np.minimum(english, 6) / 6, (foreign > english) & (foreign > 1), (latin > 0) & (foreign >= english), foreign / some, english / some,
        inside / some, back / np.maximum(asked, 1), run3, same, part, part & (new == 0), np.minimum(new, 8) / 8, (run3 > 0.9) & (n >= 5), (inside == n) & (n >= 4),
        np.full(len(n), summary), same & summary, (dangling > 0) & letter, odd, odd & (joined == 0), selves > 0, declines > 0, declines > 1, (selves > 0) & (declines > 0), declines / some, wants & (cjk >= 0.15), ~wants & (english > 1) & ~off,
    ], axis=1).astype("float64")


def code_language(text: str) -> dict[str, int]:
    return {lang: len(p.findall(text)) if any(map(text.__contains__, _CODE_HINTS[lang])) else 0 for lang, p in _CODE_SIGNS.items()}


def bare(code: str) -> str:
    return "".join(_COMMENTS.sub(" ", code).split())


@lru_cache(4096)
def _given(question: str) -> tuple:
    return bare(question), code_language(question), frozenset(words_of(question))


@lru_cache(1 << 16)
def code_features(question: str, answer: str) -> tuple[float, ...]:
    a = answer.strip()
    body = _COMMENTS.sub(" ", a).strip()
    q_flat, theirs, q_words = _given(question)
    flat = "".join(body.split())
    words = words_of(body)
    mine = code_language(body)
    c_mine, c_theirs = mine["c"], theirs["c"]
    def best(m: dict[str, int]) -> str:
        top = max(m, key=lambda k: (m[k], k == "c"))
        return top if m[top] else "c" if any(s in (";", "{") for s in a[-1:]) else ""
    b_mine, b_theirs = best(mine), best(theirs)
    differs = b_mine != b_theirs and bool(b_mine) and bool(b_theirs)
    opened = [body.count(o) - body.count(c) for o, c in ("()", "[]", "{}")]
    last = body[-1:] or " "
    quotes = body.count('"') - body.count('\\"')
    semi, q_semi = body.count(";"), question.count(";")
    prose = sum(map(_EN_ONLY.__contains__, words if body == a else words_of(a)))
    return (
        float(not flat), float(not a), float(len(words) <= 1 and len(flat) < 8), float(len(flat) < 4), min(len(flat), 200) / 200,
        float(flat == q_flat and bool(flat)), float(flat.rstrip(";") == q_flat.rstrip(";") and bool(flat)),
        float(opened[0] > 0), float(opened[1] > 0), float(opened[2] > 0), float(min(opened) < 0), float(any(o > 0 for o in opened)),
        float(last in ";}"), float(last in ")]"), float(last.isalnum() or last == "_"), float(last in ",.([{<>=&|+-*/!:?"), float(quotes % 2), float(a.count("```") % 2),
        float(last not in ";}" and semi > 0 and q_semi > 0), float(semi == 0 and q_semi > 0), float(semi > 0 and q_semi == 0), float(last not in ";}" and q_semi > 0 and semi == 0),
        float(differs), float(differs and min(mine[b_mine], 3) >= 2), min(mine["python"], 4) / 4 * (b_theirs != "python"), min(mine["js"], 4) / 4 * (b_theirs != "js"), min(c_mine, 4) / 4 * (b_theirs in ("python", "js")), min(mine["other"], 4) / 4 * (theirs["other"] == 0), float(c_theirs > 0),
        min(prose, 5) / 5, prose / max(1, len(words) + 1), sum(map(q_words.__contains__, words)) / max(1, len(words)),
        float(a.endswith("...") or last == "…"),
    )


# ---- hashed n-grams of bytes, over a whole batch at once


def gram_buckets(flat: np.ndarray, k: int) -> np.ndarray:
    m = len(flat) - k + 1
    h = np.full(m, 2166136261 + k, dtype="uint32")
    for j in range(k):
        h = (h ^ flat[j : j + m]) * np.uint32(16777619)
    h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype("int64")


def gram_rows(texts: list[str], ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the n-grams of 5 bytes of each text, and of its last bytes."""
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    short = [d if len(d) <= LONG else b"" for d in data]
    size = np.fromiter(map(len, short), dtype="int64", count=len(data))
    flat = np.frombuffer(b"".join(short), dtype="uint8").astype("uint32")
    owner = np.repeat(np.arange(len(data)), size)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    at = np.arange(len(flat)) - start[owner] if len(flat) else np.zeros(0, dtype="int64")
    rows, buckets, weights = [], [], []
    for k in (5,):
        m = len(flat) - k + 1
        if m > 0:
            ok = at[:m] + k <= size[owner[:m]]
            rows.append(owner[:m][ok])
            buckets.append(gram_buckets(flat, k)[ok])
            weights.append(1.0 / np.sqrt(np.maximum(size[owner[:m][ok]] - k + 1, 1)))
        for i, d in enumerate(data):
            if len(d) <= LONG:
                continue
            n = long_counts(d, k)
            used = np.nonzero(n)[0]
            rows.append(np.full(len(used), i))
            buckets.append(used)
            weights.append(n[used] / np.sqrt(len(d) - k + 1))
    if ends:
        for b in end_buckets(data):
            rows.append(np.arange(len(data)))
            buckets.append(b)
            weights.append(np.full(len(data), END_WEIGHT))
    if not rows:
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(weights)


def long_counts(d: bytes, k: int) -> np.ndarray:
    """How often each bucket occurs in a long text."""
    n = np.zeros(BUCKETS)
    for lo in range(0, len(d) - k + 1, PIECE):
        n += np.bincount(gram_buckets(np.frombuffer(d[lo : lo + PIECE + k - 1], dtype="uint8").astype("uint32"), k), minlength=BUCKETS)
    return n


def end_buckets(data: list[bytes]) -> list[np.ndarray]:
    """Buckets of the last bytes of each text, as of ``hash_bytes``."""
    tails = [d.rstrip() for d in data]
    out = []
    for k in END_GRAMS:
        h = np.fromiter([zlib.crc32(d[-k:], 977 + k) for d in tails], dtype="int64", count=len(tails))
        out.append((h ^ h >> 15) & BUCKETS - 1)
    return out


def gram_sums(grams: np.ndarray, texts: list[str]) -> np.ndarray:
    """Sums of ``grams`` by text, weighted as in ``gram_rows``, without a row in memory for the weight of each n-gram."""
    k = 5
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    out = grams[np.stack(end_buckets(data), axis=1)].sum(axis=1, dtype="float64") * END_WEIGHT
    short = np.array([i for i, d in enumerate(data) if k <= len(d) <= LONG], dtype="int64")
    if len(short):
        size = np.array([len(data[i]) for i in short])
        end = np.cumsum(size)
        each = np.take(grams, gram_buckets(np.frombuffer(b"".join([data[i] for i in short]), dtype="uint8").astype("uint32"), k), axis=0)
        # sums from each text's start to its last n-gram; every other sum is of those that run into the next text
        cuts = np.stack([end - size, end - k + 1], axis=1).ravel()[:-1]
        out[short] += np.add.reduceat(each, cuts, axis=0, dtype="float64")[::2] / np.sqrt(size - k + 1)[:, None]
    for i, d in enumerate(data):
        if len(d) > LONG:
            out[i] += long_counts(d, k) @ grams / np.sqrt(len(d) - k + 1)
    return out


def hash_bytes(b: bytes, salt: int) -> int:
    h = zlib.crc32(b, salt)
    return h ^ h >> 15


@dataclass
class Model:
    """Weights of the buckets and of the pair features, by defect, with thresholds on the log odds."""

    grams: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    cut: np.ndarray
    vocabulary: frozenset[str] = frozenset()

    def scores(self, dense: np.ndarray, grams: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        row, bucket, weight = grams
        out = dense @ self.dense + self.bias
        each = self.grams[bucket] * weight[:, None]
        for k in range(len(DEFECTS)):
            out[:, k] += np.bincount(row, each[:, k], len(dense))
        return out

    def of_texts(self, dense: np.ndarray, texts: list[str]) -> np.ndarray:
        return dense @ self.dense + self.bias + gram_sums(self.grams, texts)


def features(kind: str, questions: list[str], answers: list[str], vocabulary: frozenset[str] = frozenset()) -> np.ndarray:
    if kind == "code":
        return np.array([code_features(q, a) for q, a in zip(questions, answers)], dtype="float64").reshape(len(answers), -1)
    return text_features(questions, answers, kind == "summary", vocabulary)


def fit(kind: str, questions: list[str], answers: list[str], labels: np.ndarray, seed: int, vocabulary: frozenset[str] = frozenset()) -> Model:
    """Logistic regression by Adagrad; labels is (n, defects) of 0 and 1."""
    dense, (row, bucket, weight) = features(kind, questions, answers, vocabulary), gram_rows(answers, True)
    n, d = dense.shape
    order = np.argsort(row, kind="stable")
    row, bucket, weight = row[order], bucket[order], weight[order]
    first = np.searchsorted(row, np.arange(n + 1))
    k = labels.shape[1]
    m = Model(np.zeros((BUCKETS, k)), np.zeros((d, k)), np.zeros(k), np.zeros(k), vocabulary)
    g2 = [np.full_like(m.grams, 1e-2), np.full_like(m.dense, 1e-2), np.full_like(m.bias, 1e-2)]
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        shuffled = rng.permutation(n)
        for lo in range(0, n, BATCH):
            rows = shuffled[lo : lo + BATCH]
            size = first[rows + 1] - first[rows]
            local = np.repeat(np.arange(len(rows)), size)
            idx = np.repeat(first[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            b, w = bucket[idx], weight[idx]
            z = m.scores(dense[rows], (local, b, w))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            used, inv = np.unique(b, return_inverse=True)
            grad = np.stack([np.bincount(inv, err[local, j] * w, len(used)) for j in range(k)], axis=1) + DECAY * m.grams[used]
            g2[0][used] += grad**2
            m.grams[used] -= RATE * grad / np.sqrt(g2[0][used])
            gd = dense[rows].T @ err + DECAY * m.dense
            g2[1] += gd**2
            m.dense -= RATE * gd / np.sqrt(g2[1])
            gb = err.sum(axis=0)
            g2[2] += gb**2
            m.bias -= RATE * gb / np.sqrt(g2[2])
    return m


# ---- synthetic defects


def _cut(rng: random.Random, text: str) -> str:
    t = text.strip()
    for _ in range(8):
        at = max(2, int(len(t) * rng.uniform(0.08, 0.96)))
        if rng.random() < 0.3:  # between words
            at = max(t.rfind(" ", 0, at), 2)
        out = t[:at].rstrip() if rng.random() < 0.8 else t[:at]
        if out and out.rstrip()[-1:] not in ".!?。！？;}":
            return out
    return t[: max(2, len(t) // 2)]


def broken(rng: random.Random, kind: str, question: str, answer: str, others: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(question, answer, defect) made of one sound pair."""
    name = rng.choice(_WORDS.findall(question) or ["value"])
    x = f"`{name}`" if rng.random() < 0.6 and kind != "code" else rng.choice([name, f"lib/{name}", "this function", "this code"])
    out = [(question, rng.choice(PLACEHOLDERS), "empty")]
    cut = _cut(rng, answer)
    if kind != "code":
        r = rng.random()
        if r > 0.65:
            more = rng.choice(UNFINISHED) + rng.choice(["", " the", " it", " this", " a", " its"])
            cut = cut.rstrip(" ,;:") + rng.choice([" ", ", "]) + more[: rng.choice([99, 99, 3, 4])].rstrip()
        elif r < 0.15:
            cut = cut.rstrip(" ,;:") + rng.choice(["...", "…", " ..."])
        elif r < 0.3:
            cut = '{"applicable": ' + rng.choice(["true", "false"]) + ', "explanation": "' + cut
        elif r < 0.42:
            code = rng.choice(OTHER_CODE["c"]).replace("{x}", name).replace("{n}", str(rng.randrange(2, 900)))
            cut = answer.strip() + rng.choice([" The new code is:", " For example:", " The rewritten loop:"]) + "\n```" + rng.choice(["cpp", "c", ""]) + "\n" + code[: rng.randrange(3, max(4, len(code)))]
    elif rng.random() < 0.3:
        whole = answer.rstrip()
        more = rng.choice(["\nif (n > ", "\nfor (size_t i = 0; i", "\nreturn", "\nwhile (", "\n  x = "])
        cut = whole + more
    out.append((question, cut, "truncated"))
    for _ in range(2):
        text = rng.choice(REFUSALS).replace("{x}", x)
        if rng.random() < (0.6 if kind == "code" else 0.15):
            text = rng.choice(["// ", "/* ", "# "]) + text
        out.append((question, text, "refusal"))
    if kind == "code":
        copy = question
        r = rng.random()
        if r < 0.25:
            copy = rng.choice(["// after\n", "/* optimised */\n", "// unchanged\n", "// faster version\n"]) + copy
        elif r < 0.5:
            copy = "```" + rng.choice(["cpp", "c", "python", ""]) + "\n" + copy + "\n```"
        elif r < 0.75:
            copy = "\n".join("    " + line for line in copy.split("\n")) + "\n"
        out.append((question, copy, "copied"))
        langs = code_language(question)
        own = "c" if langs["c"] >= max(langs.values()) or max(langs.values()) == 0 else max(langs, key=langs.get)
        other = rng.choice([k for k in OTHER_CODE if k != own and not (own == "other" and k in ("java", "go", "rust"))])
        out.append((question, "\n".join(s.replace("{x}", name).replace("{n}", str(rng.randrange(2, 900))) for s in rng.sample(OTHER_CODE[other], k=rng.choice([1, 1, 2]))), "other_language"))
    else:
        line = question.split("\n")[0] if kind == "summary" and rng.random() < 0.5 else question
        r = rng.random()
        strategy = re.search(r"(?:[Ss]trategy:|idea[^:]*:|explanation:)\s*(.+)", line, re.S)
        if kind == "explanation" and r < 0.6:
            parts = [s.strip() for s in re.split(r"(?<=[.?!。？！])\s*", strategy.group(1) if strategy else line) if len(s) > 15]
            line = rng.choice(parts) if parts else line
        r = rng.random()
        line = line.lower() if r < 0.2 else f'"{line}"' if r < 0.35 else "Explanation: " + line if r < 0.5 else "  " + line.replace(" ", "  ") + "\n" if r < 0.65 else line
        out.append((question, line, "copied"))
        own = "zh" if kind == "explanation" and _asked(question, False)[0] else "en"
        if own == "zh":
            text = " ".join(rng.sample(ENGLISH, k=rng.choice([1, 2])))
        else:
            lang = rng.choice([k for k in FOREIGN if k != own])
            text = " ".join(rng.sample(FOREIGN[lang], k=min(len(FOREIGN[lang]), rng.choice([1, 1, 2]))))
            if lang == "zh" and others and rng.random() < 0.7:
                text = rng.choice(others)[1]
        out.append((question, text, "other_language"))
    return out


def train(kind: str, pairs: list[tuple[str, str]], seed: int = 11) -> Model:
    """Fits on ``pairs`` (question, answer), broken on purpose; see the module docstring. No pairs: a model that flags nothing."""
    rng = random.Random(seed)
    others = [(q, a) for q, a in pairs if script_shares(a)[0] > 0.15]
    sound = [(q, a) for q, a in pairs if a.strip()]
    model = None
    seen: dict[str, int] = {}
    for q, a in sound:
        for w in {*_WORDS.findall(a.lower())[:-1], *(_WORDS.findall(q.lower()) if kind == "explanation" else [])}:
            seen[w] = seen.get(w, 0) + 1
    vocabulary = frozenset(w for w, n in seen.items() if n > 2)
    for _ in range(2):
        qs, ans, ys = [], [], []
        share = min(1.0, BROKEN / max(1, len(sound)))
        for q, a in sound:
            qs.append(q)
            ans.append(a)
            ys.append(-1)
            t = a.rstrip()
            if kind != "code" and t.endswith(".") and rng.random() < 0.4:  # a missing full stop is no defect
                qs.append(q)
                ans.append(t[:-1])
                ys.append(-1)
            if rng.random() > share:
                continue
            for bq, ba, d in broken(rng, kind, q, a, others):
                qs.append(bq)
                ans.append(ba)
                ys.append(DEFECTS.index(d))
        y = np.zeros((len(qs), len(DEFECTS)))
        for i, d in enumerate(ys):
            if d >= 0:
                y[i, d] = 1
        if not qs:
            d = 33 if kind == "code" else 46
            return Model(np.zeros((BUCKETS, len(DEFECTS))), np.zeros((d, len(DEFECTS))), np.full(len(DEFECTS), -9.0), np.zeros(len(DEFECTS)))
        held = np.array([rng.random() < 0.2 for _ in qs])
        pick = lambda xs, keep: [x for x, k in zip(xs, keep) if k]
        model = fit(kind, pick(qs, ~held), pick(ans, ~held), y[~held], seed, vocabulary)
        z = model.of_texts(features(kind, pick(qs, held), pick(ans, held), vocabulary), pick(ans, held))
        for k in range(len(DEFECTS)):
            model.cut[k] = threshold(z[:, k], y[held][:, k])
        # pairs of the sample that look broken are no examples of sound ones
        z = model.of_texts(features(kind, [q for q, _ in sound], [a for _, a in sound], vocabulary), [a for _, a in sound])
        keep = (z < model.cut).all(axis=1)
        sound = [p for p, k in zip(sound, keep) if k]
    return model


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The log odds with the best F1 on held-out pairs, weighted as if ``DEFECT_SHARE`` of all pairs had the defect."""
    if not y.any():
        return np.inf
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    # pairs with another defect count as sound ones here
    weight = y.sum() * (1 - DEFECT_SHARE) / DEFECT_SHARE / max(1, (1 - y).sum())
    false = weight * np.cumsum(1 - y[order])
    f1 = 2 * hits / (hits + false + y.sum())
    best = int(np.argmax(f1))
    here = z[order[best]]
    below = z[order[best + 1]] if best + 1 < len(z) else here - 1
    return float((here + max(below, here - 1)) / 2)


def defects_of(kind: str, model: Model, questions: list[str], answers: list[str | None]) -> tuple[list[str | None], np.ndarray]:
    """The defect of each answer or None, and by how much its score passes the threshold. Repeated pairs are scored once."""
    first: dict[tuple[str, str], int] = {}
    which = [first.setdefault((q, "" if a is None else a), len(first)) for q, a in zip(questions, answers)]
    questions, every = [q for q, _ in first], [a for _, a in first]
    defects: list[str | None] = []
    tops = []
    lo = 0
    while lo < len(every):  # what a chunk needs stays in the processor's cache
        hi, chars = lo + 1, len(every[lo])
        while hi < min(len(every), lo + CHUNK) and chars + len(every[hi]) <= CHUNK_CHARS:
            chars += len(every[hi])
            hi += 1
        known, asked = every[lo:hi], questions[lo:hi]
        lo = hi
        z = model.of_texts(features(kind, asked, known, model.vocabulary), known) - model.cut
        best = z.argmax(axis=1)
        top = z[np.arange(len(known)), best]
        defects += [DEFECTS[b] if t > 0 else None for b, t in zip(best, top)]
        tops.append(top)
    return [defects[i] for i in which], np.concatenate(tops)[which] if tops else np.zeros(0)


def find_defects(units: DataFrame, kinds: tuple[str, ...] = ("explanation", "code", "summary")) -> DataFrame:
    """(origin, record_id, item, defect) of the defective answers among ``units``.

    ``units``: origin, record_id, item, kind ('explanation', 'code' or 'summary'), question, answer. An answer may have several
    units (fields); it is defective if one is, with the defect whose score passes its threshold by most. A null
    answer is empty; what is rightly null must not be given. Repeated rows give one; a null question counts as an
    empty one; texts are scored whole, however long; an empty table gives an empty result.
    """
    spark = units.sparkSession
    models = {}
    for kind in kinds:
        mine = units.where((F.col("kind") == kind) & F.col("answer").isNotNull() & (F.length("answer") < 20_000))
        got = mine.select("question", "answer", "record_id", "item").orderBy(F.xxhash64("record_id", "item"), "record_id", "item").limit(SAMPLE).collect()
        models[kind] = train(kind, sorted({(r.question or "", r.answer) for r in got}))
    shared = spark.sparkContext.broadcast({k: Model(m.grams.astype("float32"), m.dense, m.bias, m.cut, m.vocabulary) for k, m in models.items()})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for kind, model in shared.value.items():
                own = pdf[pdf.kind == kind]
                if own.empty:
                    continue
                defects, by = defects_of(kind, model, [q or "" for q in own.question], list(own.answer))
                parts.append(pd.DataFrame({"origin": own.origin, "record_id": own.record_id, "item": own["item"], "defect": defects, "margin": by}).dropna(subset=["defect"]))
            if parts:
                yield pd.concat(parts)

    scored = units.select("origin", "record_id", "item", "kind", "question", "answer").mapInPandas(score, "origin string, record_id long, item int, defect string, margin double")
    return scored.groupBy("origin", "record_id", "item").agg(F.max_by("defect", F.struct("margin", "defect")).alias("defect"))


