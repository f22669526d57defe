"""Reading level of documents: regularised ordinal regression calibrated to graded passages.

The prose of a document is cut into stretches of some ten to twenty words. A stretch is described by lexical diversity, word
rarity (in the whole corpus, and in the graded passages of each level), connectives, marks of clause depth and
lengths; a proportional-odds model, fitted on the stretches of the graded passages, gives its level. Ratings are taken as
noisy: the fit is repeated with stretches and passages that the model contradicts moved or given less weight. A document has the level
of most of its prose.

What is prose is told line by line by a linear model of words and shapes, fitted on ``LINE_SAMPLE`` documents whose kind is known,
and by the language's function words; code blocks, headings, links, legal notices and passages of test items are left out.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.leakage import Finder, finder_of, item_blocks, without_passages
from tarnwork.llm.pairs import FUNCTION_WORDS
from tarnwork.staging import stage

LINE_SAMPLE = 3000  # documents of known kind for the model of prose lines
GRADED = 20_000  # graded passages that are learned from
MIN_WORDS = 40
MAIN_SHARE = 0.5  # of a document's words that must be prose
LEVELS = 4
RARITY_BUCKETS = 1 << 16
LINE_BUCKETS = 1 << 15
STRETCH = 14

# ---- fixed values: kinds of document, words that connect, that mark a subordinate clause, and that mark a legal notice
PROSE_KINDS = ("note", "guide", "faq", "review", "readme")
OTHER_KINDS = ("changes", "source", "log", "diff")
CONNECTIVES = frozenset("and but or so because although though however therefore thus hence consequently accordingly moreover furthermore nevertheless whereas while since if unless when then instead otherwise albeit inasmuch insofar notwithstanding whereby thereby".split())
SUBORDINATE = frozenset("that which who whom whose where when because although though if unless whether while since until as than whereas whereby wherein insofar inasmuch albeit".split())
PERSONAL = frozenset("i you we us he she they them it me my your our".split())
LEGAL = frozenset("liability liable disclaims disclaim warranty warranties licence license licensed licensee licensor copyright redistribute redistribution redistributions stipulations hereinafter hereby herein thereof grantor grantee conferred consequential indemnify damages damage merchantability infringement permission permitted notice notices derivative derivatives disseminate reproduce sublicense trademark".split())

_FENCE = re.compile(r"^[ \t]*(?:```|~~~)[^\n]*\n.*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\Z)", re.S | re.M)
_LINK = re.compile(r"https?://\S+|www\.\S+|\[[^\]\n]*\]\([^)\n]*\)|<[A-Za-z/][^>\n]{0,200}>")
_NAME = re.compile(r"`[^`\n]*`|\b\w*(?:_\w+)+\b|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z]+[A-Z]\w*|\b[\w.-]+/[\w./-]+|\b[A-Z]{2,}-\d+\b")
_BULLET = re.compile(r"^[ \t]*(?:[-*+>|]+|\d+[.)]|//+|/\*+|\*/|#(?=\s))[ \t]*")
_WORD = re.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)*")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n+")
_SHAPE = re.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)*|\d+|[^\w\s]|[^\x00-\x7f]+")
_HEADING = re.compile(r"^[ \t]*#{1,6}[ \t]|^[ \t]*(?:={3,}|-{3,})[ \t]*$")
_FOREIGN = frozenset(w for lang, ws in FUNCTION_WORDS.items() if lang != "en" for w in ws) - frozenset(FUNCTION_WORDS["en"])
_ENGLISH = frozenset(FUNCTION_WORDS["en"]) | PERSONAL | frozenset("has have had can will would do does should may how what there these those any some all each many most more only also first now".split())
_LINE_START = re.compile(_BULLET.pattern, re.M)
_HEADING_LINE = re.compile(r"^[ \t]*#{1,6}[ \t][^\n]*$|^[ \t]*(?:={3,}|-{3,})[ \t]*$", re.M)
_QUOTED, _NAME_WORD = re.compile(r"`[^`\n]*`"), re.compile(_NAME.pattern.split("|", 1)[1])
_DIFF = re.compile(r"^(?:diff --git |@@ -\d|index [0-9a-f]{6,}\.\.|--- a/|\+\+\+ b/)", re.M)


def lines_of(text: str) -> list[str]:
    """The lines that may be prose, with names of code as ` and links gone."""
    text = _FENCE.sub("\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    out = []
    for line in text.split("\n"):
        if not line.strip() or _HEADING.match(line):
            continue
        line = _NAME.sub(" ` ", _LINK.sub(" ", _BULLET.sub("", line)))
        out.append(line)
    return out


def shape_hash(token: str) -> int:
    """Of a word or shape: digits are one, and so are characters beyond ASCII; case makes no difference."""
    c = token[0]
    return zlib.crc32(("9" if c.isdigit() else token.lower() if c.isascii() else "~").encode())


def line_slots(line: str) -> list[int]:
    """Buckets of all words and shapes of a line, and of neighbours among them."""
    got = [shape_hash(t) for t in _SHAPE.findall(line)]
    both = [(a * 31 + b) & 0xFFFFFFFF for a, b in zip(got, got[1:])]
    return [h % LINE_BUCKETS for h in got + both]


# ---- the words of a batch of texts as numbers


class Words(dict):
    """What stands between blanks -> numbers of its words and shapes. What is known of a number lies in arrays, so that a
    batch of texts is judged by array operations. 0 ends a line; beyond ``MOST`` entries all is forgotten before the next batch.
    """

    MOST = 400_000
    FLAGS = ["word", "stop", "counted", "english", "foreign", "legal", "connective", "subordinate", "personal", "long7", "long10"]

    def __init__(self, rarity: np.ndarray, graded: dict[str, np.ndarray] | None = None, unseen: np.ndarray | None = None):
        super().__init__()
        self.rarity, self.unknown = rarity, rarity.max() - 0.5
        self.graded, self.unseen = graded or {}, np.zeros(LEVELS) if unseen is None else unseen
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.number: dict[tuple[str, bool, bool], int] = {}
        self.same: dict[str, int] = {}
        size = 1 << 12
        self.flag = {f: np.zeros(size, dtype=bool) for f in self.FLAGS}
        self.hash, self.word_of = np.zeros(size, dtype="uint64"), np.zeros(size, dtype="int64")
        self.letters, self.beyond, self.syllables, self.rare = (np.zeros(size) for _ in range(4))
        self.logs = np.zeros((size, LEVELS))
        self.size = 1
        self[_END] = (0,)

    def _grow(self) -> None:
        more = lambda a: np.concatenate([a, np.zeros_like(a)])
        self.flag = {f: more(a) for f, a in self.flag.items()}
        for name in ("hash", "word_of", "letters", "beyond", "syllables", "rare", "logs"):
            setattr(self, name, more(getattr(self, name)))

    def _of(self, token: str, stop: bool, counted: bool) -> int:
        key = (token, stop, counted)
        if (k := self.number.get(key)) is not None:
            return k
        k = self.number[key] = self.size
        self.size += 1
        if k >= len(self.hash):
            self._grow()
        flag = self.flag
        flag["stop"][k], flag["counted"][k], self.hash[k] = stop, counted, shape_hash(token)
        self.beyond[k] = 0 if token.isascii() else sum(c > "\x7f" and c.isalpha() for c in token)
        if token[0].isascii() and token[0].isalpha():
            w = token.lower().replace("’", "'")
            self.word_of[k] = self.same.setdefault(w, len(self.same))
            flag["word"][k], flag["english"][k], flag["foreign"][k], flag["legal"][k] = True, w in _ENGLISH, w in _FOREIGN, w in LEGAL
            flag["connective"][k], flag["subordinate"][k], flag["personal"][k] = w in CONNECTIVES, w in SUBORDINATE, w in PERSONAL
            flag["long7"][k], flag["long10"][k] = len(w) >= 7, len(w) >= 10
            self.letters[k], self.syllables[k] = len(w), syllables(w)
            self.rare[k] = self.rarity[zlib.crc32(w.encode()) % RARITY_BUCKETS]
            logs = self.graded.get(w, self.unseen)
            self.logs[k] = logs - logs.mean()
        return k

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in _NAME_WORD.sub(" ` ", chunk).split():
            tokens = _SHAPE.findall(piece)
            counted = piece[0] == "`" or piece[0].isalnum() or piece[-1].isalnum()
            for i, t in enumerate(tokens):
                out.append(self._of(t, i + 1 == len(tokens) and piece[-1] in ".!?;:", counted and i == 0))
        got = tuple(out)
        if len(chunk) < 200:
            self[chunk] = got
        return got

    def read(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts one after another, how many are of each text); each line ends with a 0."""
        if len(self) > self.MOST:
            self.forget()
        parts, size = [], []
        for t in texts:
            got = list(chain.from_iterable(map(self.__getitem__, (plain_lines(t).replace("\n", f" {_END} ") + f" {_END}").split())))
            parts.append(np.array(got, dtype="int64"))
            size.append(len(got))
        return np.concatenate(parts) if parts else np.zeros(0, dtype="int64"), np.array(size, dtype="int64")


_END = "\x02"


def plain_lines(text: str) -> str:
    """``text`` with the lines that are no prose empty, without links and marks at the start of a line; quoted names as `."""
    if _END in text:
        text = text.replace(_END, " ")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "#" in text or "===" in text or "---" in text:
        text = _HEADING_LINE.sub("", text)
    text = _LINE_START.sub("", text)
    if "://" in text or "www." in text or "](" in text or "<" in text:
        text = _LINK.sub(" ", text)
    return _QUOTED.sub(" ` ", text) if "`" in text else text


# ---- the model of prose lines


def line_sums(known: Words, ids: np.ndarray, line: np.ndarray, lines: int, weights: np.ndarray) -> np.ndarray:
    """Log odds of each line that it is prose; ``ids`` without the ends of lines."""
    slots, owner = slots_of(known, ids, line)
    return np.bincount(owner, weights[slots], lines) / np.sqrt(np.maximum(np.bincount(owner, minlength=lines), 1)) + weights[-1]


def slots_of(known: Words, ids: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, line) of all words and shapes and of neighbours on a line."""
    h = known.hash[ids]
    beside = line[1:] == line[:-1]
    both = (h[:-1] * np.uint64(31) + h[1:])[beside] & np.uint64(0xFFFFFFFF)
    return (np.concatenate([h, both]) % np.uint64(LINE_BUCKETS)).astype("int64"), np.concatenate([line, line[1:][beside]])


def fit_lines(docs: list[tuple[str, bool]], epochs: int = 6, rate: float = 0.3, batch: int = 32) -> np.ndarray:
    """Weights by bucket (the last is the bias) of a logistic model, fitted by Adagrad on the lines of documents of known kind."""
    known = Words(np.zeros(RARITY_BUCKETS))
    ids, size = known.read([t for t, _ in docs])
    w = np.zeros(LINE_BUCKETS + 1)
    line = np.cumsum(ids == 0)
    prose = np.repeat([float(p) for _, p in docs], size)[ids == 0]
    slots, owner = slots_of(known, ids[ids > 0], line[ids > 0])
    rows, owner = np.unique(owner, return_inverse=True)
    if not len(rows):
        return w
    y, n = prose[rows], np.bincount(owner)
    order = np.argsort(owner, kind="stable")
    slots, first = slots[order], np.concatenate([[0], np.cumsum(n)])
    g2 = np.full(LINE_BUCKETS + 1, 1e-2)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        shuffled = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            mine = shuffled[lo : lo + batch]
            local = np.repeat(np.arange(len(mine)), n[mine])
            at = slots[np.arange(len(local)) + np.repeat(first[mine] - np.cumsum(n[mine]) + n[mine], n[mine])]
            root = np.sqrt(n[mine])
            z = np.bincount(local, w[at], len(mine)) / root + w[-1]
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[mine]
            used, back = np.unique(at, return_inverse=True)
            gs = np.bincount(back, (g / root)[local], len(used))
            g2[used] += gs * gs
            w[used] -= rate * gs / np.sqrt(g2[used])
            g2[-1] += g.sum() ** 2
            w[-1] -= rate * g.sum() / np.sqrt(g2[-1])
    return w


# ---- stretches and their features


def stretches(lines: list[str]) -> list[list[str]]:
    """The words of consecutive sentences, cut or joined to some ten to twenty words; capitals make no difference."""
    out: list[list[str]] = []
    for line in lines:
        for s in _SENTENCE.split(line):
            ws = _WORD.findall(s)
            if not ws:
                continue
            ws = [w.lower().replace("’", "'") for w in ws]
            if len(ws) < 4 and out and len(out[-1]) < STRETCH:
                out[-1] = out[-1] + ws
                continue
            while len(ws) > STRETCH * 3 // 2:
                # a break before a connective near the wanted length
                at = next((k for k in range(STRETCH, STRETCH - 6, -1) if ws[k] in CONNECTIVES), STRETCH)
                out.append(ws[:at])
                ws = ws[at:]
            out.append(ws)
    return out


def syllables(word: str) -> int:
    return max(1, len(re.findall(r"[aeiouy]+", word)) - (word.endswith("e") and not word.endswith("le") and len(word) > 3))


@dataclass
class Model:
    rarity: np.ndarray  # -log of the share of documents, by bucket
    graded: dict[str, np.ndarray]  # log probability of a word at each level
    unseen: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    cuts: np.ndarray
    lines: np.ndarray

    def levels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the levels."""
        return level_probabilities((x - self.mean) / self.scale @ self.beta, self.cuts)


def level_probabilities(z: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - z[:, None], -30, 30)))
    full = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1)
    return np.maximum(np.diff(full, axis=1), 1e-9)


def features(ws: list[str], rarity: np.ndarray, graded, unseen: np.ndarray) -> list[float]:
    n = len(ws)
    length = [len(w) for w in ws]
    rare = [rarity[zlib.crc32(w.encode()) % RARITY_BUCKETS] for w in ws]
    by_level = np.mean([graded.get(w, unseen) for w in ws], axis=0)
    by_level = by_level - by_level.mean()
    content = [w for w in ws if w not in _ENGLISH]
    return [
        len(set(ws)) / n, float(np.mean(rare)), float(np.mean(sorted(rare)[-3:])), *by_level.tolist(), float(by_level @ np.arange(len(by_level))),
        sum(w in CONNECTIVES for w in ws) / n, sum(w in SUBORDINATE for w in ws) / n, sum(w in PERSONAL for w in ws) / n,
        sum(length) / n, sum(k >= 7 for k in length) / n, sum(k >= 10 for k in length) / n, sum(map(syllables, ws)) / n, len(content) / n,
        sum(map(len, content)) / max(1, len(content)), min(n, 30) / 30,
    ]


def graded_words(parts: list[list[str]], weights: np.ndarray, smooth: float = 0.3) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """(log probabilities by word, of unseen words, counts) of stretches with weights (stretch, level)."""
    counts: dict[str, np.ndarray] = {}
    for ws, w in zip(parts, weights):
        for x in ws:
            if x not in counts:
                counts[x] = np.zeros(LEVELS)
            counts[x] += w
    total = sum(counts.values(), np.zeros(LEVELS))
    size = len(counts) + 1
    logs = {x: np.log((c + smooth) / (total + smooth * size)) for x, c in counts.items()}
    return logs, np.log(smooth / (total + smooth * size)), counts


def fit_ordinal(x: np.ndarray, target: np.ndarray, l2: float = 0.02, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(beta, cuts) of a proportional-odds model for level weights ``target`` (n, LEVELS), by Adam."""
    n, d = x.shape
    theta = np.concatenate([np.zeros(d), [-2.0, np.log(2.0), np.log(2.0)]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    w = target.sum(axis=1)

    def cuts_of(t: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([[t[0]], np.exp(t[1:])]))

    for step in range(1, steps + 1):
        beta, raw = theta[:d], theta[d:]
        cuts = cuts_of(raw)
        z = x @ beta
        s = 1 / (1 + np.exp(-np.clip(cuts[None] - z[:, None], -30, 30)))
        ds = s * (1 - s)
        p = level_probabilities(z, cuts)
        r = target / p
        # d log-likelihood / d cut_k = ds_k * (r_k - r_{k+1}); every cut moves with -z
        g_cut = ds * (r[:, :-1] - r[:, 1:])
        g_beta = -(x * (-g_cut.sum(axis=1))[:, None]).sum(axis=0) / w.sum() + l2 * beta
        gc = -g_cut.sum(axis=0) / w.sum()
        g_raw = np.concatenate([[gc.sum()], [gc[k:].sum() * np.exp(raw[k]) for k in range(1, len(raw))]])
        g = np.concatenate([g_beta, g_raw])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:d], cuts_of(theta[d:])


def train(graded: list[tuple[str, int]], rarity: np.ndarray, lines: np.ndarray, rounds: int = 5) -> Model:
    """Fits on graded passages (text, level from 1); no passages: everything is of the middle level."""
    parts, owner = [], []
    for k, (text, _) in enumerate(graded):
        mine = stretches([x for x in lines_of(text) if not is_legal(x)])
        parts += mine
        owner += [k] * len(mine)
    owner_of = np.array(owner, dtype=int)
    d = len(features(["a"], rarity, {}, np.zeros(LEVELS)))
    if not parts:
        return Model(rarity, {}, np.zeros(LEVELS), np.zeros(d), np.ones(d), np.zeros(d), np.array([-2.0, 0.0, 2.0]), lines)
    rated = np.array([r - 1 for _, r in graded])
    # a passage's rating is the prior of its stretches; neighbours get what misratings and admixtures leave
    apart = np.abs(np.arange(LEVELS)[None] - rated[:, None])
    prior = np.array([0.82, 0.12, 0.04, 0.02])[apart]
    prior /= prior.sum(axis=1, keepdims=True)
    target = prior[owner_of]
    model = None
    for _ in range(rounds):
        logs, unseen, counts = graded_words(parts, target)
        total = sum(counts.values(), np.zeros(LEVELS))
        size = len(counts) + 1
        x = []
        for k in range(len(graded)):  # without the passage itself, lest a word should speak for its own rating
            mine = np.nonzero(owner_of == k)[0]
            own: dict[str, np.ndarray] = {}
            own_total = np.zeros(LEVELS)
            for i in mine:
                for w in parts[i]:
                    own[w] = own.get(w, 0) + target[i]
                    own_total = own_total + target[i]
            rest = {w: np.log((counts[w] - c + 0.3) / (total - own_total + 0.3 * size)) for w, c in own.items()}
            x += [features(parts[i], rarity, rest, unseen) for i in mine]
        x = np.array(x)
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        beta, cuts = fit_ordinal((x - mean) / scale, target)
        model = Model(rarity, logs, unseen, mean, scale, beta, cuts, lines)
        p = model.levels(x)
        length = np.array([len(w) for w in parts], dtype="float64")
        # what the passages say as a whole: the level of most of their words
        whole = np.stack([(p[owner_of == k] * length[owner_of == k][:, None]).sum(axis=0) for k in range(len(graded))])
        whole /= np.maximum(whole.sum(axis=1, keepdims=True), 1e-9)
        belief = prior * np.maximum(whole, 1e-3) ** 2
        belief /= belief.sum(axis=1, keepdims=True)
        target = p * (0.15 + belief[owner_of])
        target /= target.sum(axis=1, keepdims=True)
    return model


# ---- documents


def is_legal(line: str) -> bool:
    ws = [w.lower() for w in _WORD.findall(line)]
    hits = sum(w in LEGAL for w in ws)
    return hits >= 4 or (hits >= 3 and hits >= len(ws) / 12)


def prose_of(text: str, weights: np.ndarray, rarity: np.ndarray) -> tuple[list[str], int, int]:
    """(prose lines in English, their words, words of the whole text) of one text; names of code and figures are words here."""
    reader = Reader(Model(rarity, {}, np.zeros(LEVELS), np.zeros(0), np.ones(0), np.zeros(0), np.zeros(0), weights))
    kept, words, _ = reader.prose([text])
    lines = [_NAME_WORD.sub(" ` ", x) for x in plain_lines(text).split("\n")]
    return [x for x, k in zip(lines, kept) if k], int(words[0]), all_words(text)


def all_words(text: str) -> int:
    return sum(map(str.isalnum, (t[:1] for t in _LINK.sub(" ", text).split())))


class Reader:
    """Levels of batches of texts by a model."""

    def __init__(self, model: Model):
        self.model = model
        self.known = Words(model.rarity, model.graded, model.unseen)

    def prose(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(whether each line is English prose, such words of each text, (numbers, line, text) of all words and shapes)."""
        k = self.known
        ids, size = k.read(texts)
        line_of, owner = np.cumsum(ids == 0) - (ids == 0), np.repeat(np.arange(len(texts)), size)
        doc_of_line = owner[ids == 0]
        inside = ids > 0
        ids, line, owner = ids[inside], line_of[inside], owner[inside]
        lines = len(doc_of_line)
        total = lambda a: np.bincount(line, a[ids], lines)
        words, letters = total(k.flag["word"]), total(k.letters)
        mine, theirs, legal = total(k.flag["english"]), total(k.flag["foreign"]), total(k.flag["legal"])
        strange = total(k.flag["word"] & (k.rare >= k.unknown))
        kept = (words >= 2) & (total(k.beyond) <= 0.15 * (letters + 1)) & (theirs <= mine) & (letters <= 14 * words)
        kept &= ~((mine < 0.12 * words) & (strange > 0.3 * words))  # letters, but hardly words
        kept &= (line_sums(k, ids, line, lines, self.model.lines) > 0) & ~((legal >= 4) | ((legal >= 3) & (legal >= words / 12)))
        by_text = lambda a: np.bincount(doc_of_line, a * kept, len(texts))
        english = by_text(mine) > by_text(theirs)
        kept &= english[doc_of_line]
        return kept, np.where(english, by_text(total(k.flag["counted"])), 0), (ids, line, owner)

    def cut(self, ids: np.ndarray, sentence: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Where the stretches of the words begin, as ``stretches`` cuts them."""
        begins = np.nonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))[0]
        ends = np.append(begins[1:], len(ids))
        connective = self.known.flag["connective"][ids]
        out: list[int] = []
        text, last = -1, 0
        for b, e, o in zip(begins.tolist(), ends.tolist(), owner[begins].tolist()):
            if o != text:
                text, last = o, STRETCH
            if e - b < 4 and last < STRETCH:
                last += e - b
                continue
            while e - b > STRETCH * 3 // 2:
                out.append(b)
                b += next((k for k in range(STRETCH, STRETCH - 6, -1) if connective[b + k]), STRETCH)
            out.append(b)
            last = e - b
        return np.array(out, dtype="int64")

    def features(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``features`` of the stretches that begin at ``first``."""
        k = self.known
        n = np.diff(np.append(first, len(ids)))
        mean = lambda a: np.add.reduceat(a[ids].astype("float64"), first) / n
        stretch = np.repeat(np.arange(len(first)), n)
        words = np.unique(stretch * (len(k.same) + 1) + k.word_of[ids]) // (len(k.same) + 1)
        rare = k.rare[ids][np.lexsort((k.rare[ids], stretch))]  # ascending in each stretch
        ends = first + n
        top = sum(np.where(n > i, rare[np.maximum(ends - 1 - i, first)], 0.0) for i in range(3)) / np.minimum(n, 3)
        levels = np.stack([mean(k.logs[:, i]) for i in range(LEVELS)], axis=1)
        content = k.flag["word"] & ~k.flag["english"]
        letters = np.add.reduceat((content * k.letters)[ids], first)
        return np.stack([
            np.bincount(words, minlength=len(first)) / n, mean(k.rare), top, *levels.T, levels @ np.arange(LEVELS),
            mean(k.flag["connective"]), mean(k.flag["subordinate"]), mean(k.flag["personal"]),
            mean(k.letters), mean(k.flag["long7"]), mean(k.flag["long10"]), mean(k.syllables), mean(content),
            letters / np.maximum(1, mean(content) * n), np.minimum(n, 30) / 30,
        ], axis=1)

    def levels(self, texts: list[str | None], finder: Finder | None) -> list[int | None]:
        """The level of each text or None; ties go to the level with more probability."""
        out: list[int | None] = [None] * len(texts)
        asked = [i for i, t in enumerate(texts) if t and len(t) >= 2 * MIN_WORDS and len(_DIFF.findall(t)) < 2]
        given = [without_passages(texts[i], finder) if finder is not None and finder.find(texts[i]) else texts[i] for i in asked]
        kept, words, (ids, line, owner) = self.prose(given)
        fits = np.array([w >= MIN_WORDS and w >= MAIN_SHARE * all_words(t) for w, t in zip(words, given)], dtype=bool)
        if not fits.any():
            return out
        k = self.known
        # a sentence ends with its mark or its line
        sentence = np.concatenate([[0], np.cumsum(k.flag["stop"][ids[:-1]] | (line[1:] != line[:-1]))])
        use = kept[line] & fits[owner] & k.flag["word"][ids]
        ids, sentence, owner = ids[use], sentence[use], owner[use]
        if not len(ids):
            return out
        first = self.cut(ids, sentence, owner)
        p = self.model.levels(self.features(ids, first))
        text, n = owner[first], np.diff(np.append(first, len(ids)))
        votes = np.stack([np.bincount(text, n * (p.argmax(axis=1) == i), len(given)) for i in range(LEVELS)], axis=1)
        soft = np.stack([np.bincount(text, n * p[:, i], len(given)) for i in range(LEVELS)], axis=1)
        best = np.lexsort((-soft, -votes), axis=1)[:, 0] if len(given) else []
        for i, level, ok in zip(asked, best, np.bincount(text, minlength=len(given)) > 0):
            if ok:
                out[i] = int(level) + 1
        return out


def rarity_table(docs: DataFrame, doc_id: str, text: str) -> np.ndarray:
    """-log of the share of documents that hold a word, over all documents, by bucket; of a row delivered n times each counts 1 / n.

    Only ids and digests are shuffled to tell which rows were repeated; their texts stay where they are unless the repeated rows are
    too many to be broadcast.
    """
    marked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"), F.xxhash64(text).alias("_h"))
    times = stage(marked.groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("_n")), "deliveries")
    size = times.count()
    repeated = stage(times.where("_n > 1 AND _id IS NOT NULL"), "repeated")  # its size is known when the join is planned
    once = marked.where("_t IS NOT NULL").join(repeated, ["_id", "_h"], "left")
    word = F.explode(F.array_distinct(F.split(F.translate(F.lower(F.col("_t")), "’", "'"), "[^a-z'-]+"))).alias("w")
    slot = (F.crc32(F.col("w").cast("binary")) % RARITY_BUCKETS).cast("int").alias("b")
    rows = once.select((F.lit(1.0) / F.coalesce("_n", F.lit(1))).alias("_w"), word).where("w <> ''").groupBy(slot).agg(F.round(F.sum("_w"), 4).alias("n")).toPandas()
    out = np.full(RARITY_BUCKETS, 0.5)
    out[rows.b.to_numpy(dtype=int)] = np.maximum(rows.n.to_numpy(dtype="float64"), 0.5)
    return np.log((size + 1) / out)


_READERS: dict[str, Reader] = {}
CHUNK = 400  # texts that are judged at a time


def reader_of(token: str, model: Model) -> Reader:
    """The reader of a model; a worker process keeps it, and the words it knows, over its tasks."""
    if token not in _READERS:
        _READERS.clear()
        _READERS[token] = Reader(model)
    return _READERS[token]


def reading_levels(docs: DataFrame, graded: DataFrame, items: DataFrame | None, *, doc_id: str, text: str, kind: str) -> DataFrame:
    """(doc_id, reading_level) of the documents that mainly consist of English prose.

    ``graded`` has text and rated_level, ``items`` (optional) item_id and item_text, the test items whose passages do not count.
    Null, empty and short texts, source, logs, change lists, diffs and other languages have no row; repeated rows of one id
    give one row; ties go to the level with more of the stretches' probability; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(kind).isin(*PROSE_KINDS, *OTHER_KINDS) & F.col(text).isNotNull() & (F.length(text) < 20_000))
    sample = known.select(text, kind, doc_id).orderBy(F.xxhash64(doc_id), doc_id).limit(LINE_SAMPLE).collect()
    lines = fit_lines([(r[0], r[1] in PROSE_KINDS) for r in sorted(sample, key=lambda r: (r[2], r[0]))])
    passages = [(r.text, r.rated_level) for r in graded.where("text IS NOT NULL AND rated_level BETWEEN 1 AND 4").select("text", "rated_level").distinct().orderBy(F.xxhash64("text"), "text", "rated_level").limit(GRADED).collect()]
    model = spark.sparkContext.broadcast(train(sorted(passages), rarity_table(docs, doc_id, text), lines))
    token = uuid.uuid4().hex
    asked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = list(item_blocks(items, "item_id", "item_text")) if items is not None else []
    last = spark.sparkContext.broadcast(blocks[-1] if blocks else [])

    # passages of all blocks but the last go first, block by block, so that a worker holds one block
    for k, block in enumerate(blocks[:-1]):
        given = spark.sparkContext.broadcast(block)

        def strip(batches: Iterator[pd.DataFrame], given=given, k=k) -> Iterator[pd.DataFrame]:
            finder = finder_of(f"{token}-{k}", given.value)
            for pdf in batches:
                yield pdf.assign(text=[without_passages(t, finder) if t and finder.find(t) else t for t in pdf.text])

        asked = asked.mapInPandas(strip, "doc_id long, text string")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = finder_of(token, last.value) if last.value else None
        reader = reader_of(token, model.value)
        for pdf in batches:
            ids, texts = pdf.doc_id.tolist(), pdf.text.tolist()
            levels = [x for lo in range(0, len(texts), CHUNK) for x in reader.levels(texts[lo : lo + CHUNK], finder)]
            yield pd.DataFrame([(d, x) for d, x in zip(ids, levels) if x is not None], columns=["doc_id", "reading_level"])

    judged = asked.mapInPandas(judge, "doc_id long, reading_level int")
    return judged.groupBy("doc_id").agg(F.max("reading_level").alias("reading_level"))
