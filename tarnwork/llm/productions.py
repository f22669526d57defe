"""Statement productions: windows of token codes are reduced to nonterminals, innermost groups first.

Reduced symbols: A a bracketed list of expressions, Z empty brackets, 1 brackets of parameters or a type, h the header of a
for, J an index, U a list or object, b a valid block, # what is not valid. Groups and statements recur, so every
reduction is remembered by its text.
"""

from __future__ import annotations

import re
from functools import lru_cache

_ROUND = re.compile(r"\(([^(){}\[\]uvpP]*)\)|\[([^(){}\[\]uvpP]*)\]|u([^(){}\[\]uvpP]*)v|\{([^(){}\[\]uvpP]*)\}|p([^(){}\[\]uvpP]*)P")
MEMORY, LONG = 1 << 17, 400  # reductions that are remembered, and the longest text of one
ROUNDS = 64  # of reductions of all innermost groups at once; deeper nests go bracket by bracket


def _remembered(f):
    """``f`` with its results for short texts remembered."""
    known = lru_cache(MEMORY)(f)
    return lambda *text: known(*text) if len(text[-1]) <= LONG else f(*text)


def _list_of(one: str) -> str:
    return rf"{one}(?:,{one})*"


# ---- C and C++

# expression: operands with what may stand before and behind them, joined by operators
_C_PRE = r"(?:[!*&@+xz]|[A1](?=[ins!*&@+xzAN1U])|N(?:A(?=[it]))?)"
_C_PRIM = r"(?:i|n|s+|A|t[AZU]|[it]*t[AZU])"
_C_POST = r"(?:[AZJUx]|\.[it]|\.!i|1(?=[.)]|$)|1)"
_C_UNARY = rf"{_C_PRE}*(?:{_C_PRIM}|[qt]*t[*&]*){_C_POST}*"
_C_BIN = r"(?:>>|<<|>=?|[o*&@+<=a?:])"
_C_EXPR = rf"{_C_UNARY}(?:{_C_BIN}{_C_UNARY})*"
_C_ELEM = rf"(?:(?:\.i|J)+=)?(?:{_C_EXPR}|U)~?"
_C_SPEC = r"(?:q|t|T|(?:[Kk]i?[iU]?)|i)"
_C_DECLR = rf"(?:[*&@q])*(?:i|A(?=[AZ1])|O[^;,]{{1,3}})?(?:J|A|Z|1)*(?:=(?:{_C_EXPR}|U)|U)?(?::n)?"
_C_DECL = rf"{_C_SPEC}+(?:[*&@q])*(?:i|A(?=[AZ1])|J)(?:J|A|Z|1)*(?:q|qA)*(?:=(?:{_C_EXPR}|U|[dz])|U)?(?::n)?(?:,{_C_DECLR})*"
_C_PARAM = rf"(?:{_C_SPEC}+(?:[*&@q])*~?(?:i|A(?=[AZ1]))?(?:J|A|Z|1)*(?:=(?:{_C_EXPR}|U))?|~|t)"


class _C:
    def __init__(self, cpp: bool):
        self.cpp = cpp
        full = lambda p: re.compile(rf"(?:{p})\Z")
        self.exprs = full(_list_of(_C_ELEM if cpp else _C_EXPR))
        self.elems = full(_list_of(_C_ELEM) + ",?")
        self.params = full(_list_of(_C_PARAM))
        self.header = full(rf"(?:{_C_DECL}|{_list_of(_C_EXPR)})?;(?:{_C_EXPR})?;(?:{_list_of(_C_EXPR)})?")
        self.range = full(rf"{_C_SPEC}+[*&@q]*(?:i|J):(?:{_C_EXPR}|U)")
        self.template = re.compile(r"([iN])<([^<>(){};=.xoa]*)>(?=[iV(*&@,>)AZJ1Uu{;:.]|$)" if cpp else r"$^")
        self.template_head = re.compile(r"M<[^<>;{}]*>")
        self.types = full(r"(?:(?:q|t|[Kk]?i|i)+[*&@q]*(?:[Z1A][*&]*)?|n|)(?:,(?:(?:q|t|[Kk]?i|i)+[*&@q]*(?:[Z1A])?|n))*~?")
        simple = [rf"{_list_of(_C_EXPR)}", _C_DECL, rf"R(?:{_C_EXPR}|U)?", "B", "Gi", "z", r"T[^;{}]*", r"[Kk]i?", "qA", rf"[KkT]*[Kk]i?:?[^;{{}}]*?[bU](?:{_C_DECLR}(?:,{_C_DECLR})*)?"]
        self.statement = re.compile(
            rf"(?P<if>Iq?(?:A|1|(?={'a'}$^)))|(?P<for>Fh)|(?P<while>WA)|(?P<switch>SA)|(?P<do>D)|(?P<else>E)|(?P<try>Y)|(?P<catch>H[A1])|(?P<label>C{_C_UNARY}(?:[o+*<]{_C_UNARY})*:|d:|Q:|i:(?!:))|(?P<block>b)"
            rf"|(?P<simple>(?:{'|'.join(simple)})?;)"
        )
        self.letter = {"if": "I", "for": "F", "while": "W", "switch": "S", "do": "D", "else": "E", "try": "Y", "catch": "H", "label": "L", "block": "b", "simple": "k"}
        func = rf"(?:M)*{_C_SPEC}*[*&@q]*(?:!?i|O.{{1,3}})(?:[AZ1]|(?=Z))[AZ1]?(?:q|qA|&|@|\.[it]+[*&]*)*(?::i[AUZ](?:,i[AUZ])*)?b"
        func = rf"(?:{func}|(?:M)*{_C_SPEC}*[*&@q]*!?i[AZ1](?:q|&|@)*=[dz];)"
        ktype = rf"(?:M)*(?:[qT])*[Kk]i?(?:q|:[^;b]*)?[bU](?:{_C_DECLR}(?:,{_C_DECLR})*)?;"
        self.top = full(rf"(?:{func};?|{ktype}|(?:M)*{_C_DECL};|T[^;{{}}b]*;|w[iV]*b|Ts?b|;|qs[b]|Q:)+")
        self.klass = full(rf"(?:{func};?|{ktype}|(?:M)*{_C_DECL};|T[^;{{}}b]*;|Q:|;)*")
        self.group = _remembered(self._group)
        self.block = _remembered(self._block)

    def _group(self, kind: str, inner: str) -> str:
        """The symbol of a bracketed group without brackets in it."""
        if "#" in inner or "X" in inner:
            return "#"
        inner = self.templates(inner)
        if kind == "(":
            if not inner:
                return "Z"
            if ";" in inner:
                return "h" if self.header.match(inner) else "I" if False else "#" if not self.cpp else self._if_init(inner)
            if inner.count("?") == inner.count(":") and self.exprs.match(inner):
                return "A"
            if self.cpp and self.range.match(inner):
                return "h"
            return "1" if self.params.match(inner) else "#"
        if kind == "[":
            return "J" if not inner or self.exprs.match(inner) or (self.cpp and re.fullmatch(r"(?:[=&]|&?i(?:=.*)?|\*?i|J)(?:,(?:&?i|\*?i|&i=.*))*", inner)) else "#"
        if kind == "u":
            return "U" if not inner or self.elems.match(inner) else "#"
        return self.block(inner)

    def _if_init(self, inner: str) -> str:
        a, _, b = inner.partition(";")
        return "A" if re.fullmatch(rf"{_C_DECL}|{_C_EXPR}", a) and self.exprs.match(b) else "#"

    def templates(self, s: str) -> str:
        if "<" not in s or not self.cpp:
            return self.scopes(s)
        s = self.template_head.sub("M", self.scopes(s))
        while True:
            t = self.template.sub(lambda m: m.group(1) if self.types.match(m.group(2)) else m.group(), s)
            t = self.scopes(t)
            if t == s:
                return s
            s = t

    def scopes(self, s: str) -> str:
        if "V" not in s:
            return s
        while True:
            t = re.sub(r"iV(?=[i!O*])|(?<![i>])V(?=i)", "", s)
            if t == s:
                return s
            s = t

    def _block(self, inner: str) -> str:
        """b for a sequence of statements."""
        if "#" in inner or "X" in inner or "h" in inner and False:
            return "#"
        inner = self.templates(inner)
        # lambdas: [..](..) -> type block
        if self.cpp and "J" in inner:
            inner = re.sub(r"J(?:[AZ1])?(?:q)*(?:\.[it]+[*&]*)?b", "n", inner)
        kinds, pos = [], 0
        while pos < len(inner):
            m = self.statement.match(inner, pos)
            if not m:
                # members of a class, or what may stand outside functions
                return "b" if self.klass.match(inner) and ("Q" in inner or "b" in inner or "k" not in kinds) and not self._function_like(inner) else "#"
            kinds.append(self.letter[m.lastgroup])
            pos = m.end()
        return "b" if structure("".join(kinds)) else "#"

    def _function_like(self, inner: str) -> bool:
        return bool(re.search(r"[IEFWDSCRB]", inner))

    def valid(self, codes: str) -> bool:
        if "X" in codes:
            return False
        s = reduce_groups(codes, self.pre, self.group)
        if s is None:
            return False
        s = self.templates(s)
        if self.cpp:
            s = re.sub(r"(?<=[=,(])J(?:[AZ1])?(?:q)*(?:\.[it]+[*&]*)?b", "n", s)
        return bool(self.top.match(s))

    def pre(self, s: str) -> str:
        if self.cpp and "J" in s:
            # a lambda whose parts are reduced is a literal
            s = re.sub(r"(?<![in)\]A])J(?:[AZ1])?q*(?:\.[it]+[*&]*)?b", "n", s)
        if self.cpp and "<" in s:
            s = self.templates(s)
        return s


_PARTNER = dict(zip(")]}vP", "([{up"))


def reduce_groups(codes: str, pre, group) -> str | None:
    """Replaces groups, innermost first, until none is left; None if brackets do not pair or a group is not valid.

    All innermost groups go in one round, ``ROUNDS`` times; what is nested deeper than that goes from left to right over a stack, so
    that the depth costs nothing.
    """
    s = codes
    for _ in range(ROUNDS):
        s = pre(s)

        def put(m: re.Match) -> str:
            t = m.group()
            return group(t[0], t[1:-1])

        t = _ROUND.sub(put, s)
        if "#" in t:
            return None
        if t == s:
            return None if re.search(r"[(){}\[\]uvpP]", s) else s
        s = t
    stack, parts = [], []
    for m in re.finditer(r"[^(){}\[\]uvpP]+|.", s):
        t = m.group()
        if t in _PARTNER:
            if not stack or stack[-1][0] != _PARTNER[t]:
                return None
            opening, above = stack.pop()
            got = group(opening, pre(opening + "".join(parts))[1:])
            if got == "#":
                return None
            parts = above
            parts.append(got)
        elif t in _PARTNER.values():
            stack.append((t, parts))
            parts = []
        else:
            parts.append(t)
    return None if stack else pre("".join(parts))


@lru_cache(MEMORY)
def structure(kinds: str) -> bool:
    """Whether statement kinds make a sequence: I F W S take a statement, E follows that of an I, D needs W and an empty one."""

    def one(p: int) -> int:
        """The end of the statement at p, or -1."""
        if p >= len(kinds):
            return -1
        c = kinds[p]
        if c in "kb":
            return p + 1
        if c == "L":
            return one(p + 1) if p + 1 < len(kinds) else p + 1
        if c == "I":
            q = one(p + 1)
            return one(q + 1) if 0 < q < len(kinds) and kinds[q] == "E" else q
        if c in "FW":
            return one(p + 1)
        if c == "S":
            return p + 2 if kinds[p + 1 : p + 2] == "b" else -1
        if c == "D":
            q = one(p + 1)
            if q > 0 and kinds[q : q + 2] == "Wk":
                return q + 2
            return q + 1 if q > 0 and kinds[q : q + 1] == "w" else -1
        if c == "Y":
            if kinds[p + 1 : p + 2] != "b":
                return -1
            q = p + 2
            n = 0
            while kinds[q : q + 2] in ("Hb", "yb"):
                q, n = q + 2, n + 1
            return q if n else -1
        return -1

    p = 0
    while p < len(kinds):
        p = one(p)
        if p < 0:
            return False
    return True


# ---- JavaScript

_J_PRIM = r"(?:i|n|s|A|U|J|1)"
_J_TMPL = r"(?:s(?:2s)+)"
_J_POST = r"(?:[AZ1J]|\.[iAJZ]|\.\#?i|s|x(?![in(A])|2s)"
_J_UNARY = rf"(?:[!+xz~])*(?:{_J_TMPL}|{_J_PRIM}|z){_J_POST}*"
_J_BIN = r"(?:[o*&+<>=a?:])"
_J_EXPR = rf"{_J_UNARY}(?:{_J_BIN}{_J_UNARY})*"


class _JavaScript:
    def __init__(self):
        full = lambda p: re.compile(rf"(?:{p})\Z")
        many = rf"{_J_EXPR}(?:,+{_J_EXPR})*"
        self.exprs = full(many + ",?")
        self.array = full(rf",*(?:{many})?,*")
        key = r"(?:i|n|s|J|l|[IEFWDSCdBRYHfKTMjogy])"
        self.object = full(rf"(?:(?:{key}:{_J_EXPR}|i(?:={_J_EXPR})?|~{_J_UNARY}|(?:g)?\*?(?:i)?{key}[AZ1]b|g\*?i[AZ1]b),?)*")
        self.header = full(rf"(?:l?{many})?;(?:{many})?;(?:{many})?")
        self.each = full(rf"(?:l{_J_UNARY}o|l?{_J_UNARY}j){_J_EXPR}")
        self.statement = re.compile(
            rf"(?P<if>I[A])|(?P<for>Fz?h)|(?P<while>WA)|(?P<switch>SA)|(?P<do>D)|(?P<else>E)|(?P<try>Y)|(?P<catch>H[A1]?)|(?P<finally>y)|(?P<label>C{_J_UNARY}(?:[o+*]{_J_UNARY})*:|d:|i:)|(?P<block>b|M?d?g?f\*?i?[AZ1]b|M?d?Ki?(?:e{_J_UNARY})?b)"
            rf"|(?P<simple>(?:M?l{many}|R(?:{many})?|Bi?|M?T[^;b]*|Md?{many}|{many})?;)"
        )
        self.letter = {"if": "I", "for": "F", "while": "W", "switch": "S", "do": "D", "else": "E", "try": "Y", "catch": "H", "finally": "y", "label": "L", "block": "b", "simple": "k"}
        self.klass = full(rf"k(?:(?:g|\*|i)*{key}[AZ1]b|i?(?:i|J)(?:={_J_EXPR})?;|ib|;)*")
        self.group = _remembered(self._group)

    def pre(self, s: str) -> str:
        # functions and arrows whose parts are reduced are literals
        s = re.sub(r"(?<=[=(,:?oa&|+u\[ROz>~!])g?f\*?i?[AZ1]b", "n", s)
        s = re.sub(r"g?(?:i|[AZ1])O(?:b|(?=$^))", "n", s)
        return s

    def _group(self, kind: str, inner: str) -> str:
        if "#" in inner or "X" in inner:
            return "#"
        inner = self.arrows(inner)
        if kind == "(":
            if not inner:
                return "Z"
            if self.header.match(inner) or self.each.match(inner):
                return "h"
            return "A" if self.exprs.match(inner) else "#"
        if kind == "[":
            return "J" if self.array.match(inner) else "#"
        if kind == "u":
            return "U" if self.object.match(inner) else "#"
        if kind == "p":
            return "2" if self.exprs.match(inner) else "#"
        return self._block(inner)

    def arrows(self, s: str) -> str:
        """Arrow functions with an expression as their body, from the right."""
        while "O" in s:
            t = re.sub(rf"g?(?:i|[AZ1])O({_J_EXPR})(?=[,;)]|\Z)", "n", s)
            if t == s:
                return s
            s = t
        return s

    def _block(self, inner: str) -> str:
        inner = self.arrows(inner)
        if inner and inner[-1] not in ";b:k":
            inner += ";"
        kinds, pos = [], 0
        while pos < len(inner):
            m = self.statement.match(inner, pos)
            if not m:
                return "b" if self.klass.match(inner) else "#"
            kinds.append(self.letter[m.lastgroup])
            pos = m.end()
        return "b" if structure("".join(kinds)) else "#"

    def valid(self, codes: str) -> bool:
        """Of codes with the semicolons that line breaks stand for; a return outside functions is not valid."""
        if "X" in codes:
            return False
        s = reduce_groups(codes, self.pre, self.group)
        if s is None:
            return False
        s = self.arrows(s)
        if re.search(r"R(?![:])", s):
            return False
        return self._block(s) == "b"


# ---- Python

_P_PRIM = r"(?:i|n|s+|A|Z|J|U|G|1)"
_P_POST = r"(?:[AZJ1]|\.i)"
_P_OP = r"(?:J!?|!j|j|[o*+<>@P&]|J)"
_P_UNARY = rf"(?:!|[+]|z)*{_P_PRIM}{_P_POST}*(?:P(?:!|[+])*{_P_PRIM}{_P_POST}*)?"


class _Python:
    # is and not in are taken as operators; a conditional expression is X I Y E Z
    def __init__(self):
        full = lambda p: re.compile(rf"(?:{p})\Z")
        op = r"(?:Q!?|!j|j|[o*+<>@P])"
        cmp_ = rf"{_P_UNARY}(?:{op}{_P_UNARY})*"
        lam = r"l(?:[*P]?i(?:=[ins])?(?:,[*P]?i(?:=[ins])?)*)?:"
        expr = rf"(?:{lam})*{cmp_}(?:I(?:{lam})*{cmp_}E(?:{lam})*{cmp_})*"
        self.expr = expr
        star = rf"(?:[*]?{expr}|i?U{expr})"
        many = rf"{star}(?:,{star})*,?"
        comp = rf"{expr}(?:g?F{_P_UNARY}(?:,{_P_UNARY})*,?j{expr}(?:I{cmp_})*)+"
        arg = rf"(?:i=(?:{expr})|[*P]{expr}|i(?:U{expr})|{comp}|{expr})"
        self.args = full(rf"{arg}(?:,{arg})*,?")
        self.tuple = full(rf"(?:{many}|N(?:m?{many})?|{comp})")
        par = rf"(?:[*P]?i(?::{expr})?(?:={expr})?|[*]|o)"
        self.params = full(rf"{par}(?:,{par})*,?")
        sl = rf"(?:(?:{expr})?(?::(?:{expr})?){{0,2}})"
        self.index = full(rf"(?:{many}|{comp}|{sl}(?:,{sl})*,?)?")
        item = rf"(?:{expr}:{expr}|P{expr}|{star})"
        self.set = full(rf"(?:{item}(?:,{item})*,?|{expr}:{comp}|{comp})?")
        target = rf"{many}"
        value = rf"(?:{many}|N(?:m?{many})?)"
        simple = rf"(?:{target}(?:=(?:{target}))*(?:={value})?|{_P_UNARY}a{value}|{_P_UNARY}:{expr}(?:={value})?|R(?:{value})?|r(?:{expr}(?:m{expr})?)?|B|Gi(?:,i)*|D{many}|C{expr}(?:,{expr})?|N(?:m?{many})?|T[i.](?:\.?i)*(?:ki)?(?:,i(?:\.i)*(?:ki)?)*|m(?:[.n]*)(?:i(?:\.i)*)?T(?:\*|A|i(?:ki)?(?:,i(?:ki)?)*))"
        self.simple = full(rf"{simple}(?:Z;?{simple})*Z?")
        self.simple = full(rf"{simple}(?:;{simple})*;?")
        cond = rf"(?:{expr}|{expr}U{expr})"
        with_ = rf"{expr}(?:k{_P_UNARY})?"
        self.head = re.compile(
            rf"(?:(?P<if>I{cond}:)|(?P<elif>L{cond}:)|(?P<else>E:)|(?P<for>g?F{many}j{many}:)|(?P<while>W{cond}:)|(?P<try>Y:)|(?P<except>H(?:[*]?{expr}(?:,{expr})*(?:ki)?)?:)|(?P<finally>y:)"
            rf"|(?P<with>g?w{with_}(?:,{with_})*:)|(?P<def>g?fi[Z1AJ]*(?:A{expr}|3{expr})?:|Ki[AZ]?:)|(?P<match>i{many}:))"
        )
        self.letter = {"if": "I", "elif": "L", "else": "E", "for": "F", "while": "W", "try": "Y", "except": "H", "finally": "y", "with": "w", "def": "f", "match": "w"}
        self.line = _remembered(self._line)
        self.group = _remembered(self._group)

    def _group(self, kind: str, inner: str) -> str:
        if kind == "(":
            if not inner:
                return "Z"
            if self.args.match(inner) or self.tuple.match(inner):
                return "A"
            return "1" if self.params.match(inner) else "#"
        if kind == "[":
            return "J" if self.index.match(inner) else "#"
        return "U" if self.set.match(inner) else "#"

    def _line(self, line: str) -> str:
        """The kind of a logical line: k simple, a letter for a clause with a block to come, lower-case o for one on its line, # invalid."""
        s = line
        for _ in range(200):  # Python itself takes no deeper nest
            t = re.sub(r"\(([^()\[\]uv]*)\)|\[([^()\[\]uv]*)\]|u([^()\[\]uv]*)v", lambda m: self.group(m.group()[0], m.group()[1:-1]), s)
            if "#" in t:
                return "#"
            if t == s:
                break
            s = t
        if re.search(r"[()\[\]uv]", s):
            return "#"
        if s.startswith("@"):
            return "@" if re.fullmatch(rf"@{self.expr}", s) else "#"
        if self.simple.match(s):
            return "k"
        m = self.head.match(s)
        if not m:
            return "#"
        if m.end() == len(s):
            return self.letter[m.lastgroup]
        return self.letter[m.lastgroup] + "o" if self.simple.match(s[m.end() :]) else "#"

    def valid(self, codes: str) -> bool:
        if "X" in codes:
            return False
        # names for operators that share a letter with a reduced symbol
        kinds: list[str] = []
        for part in re.split(r"(?<=[;{}])", codes.replace("Z", "\x01").replace("J", "Q").replace("U", "\x02").replace("A", "3")):
            if part in ("{", "}"):
                kinds.append(part)
            elif part:
                k = self.line(part[:-1].replace("\x01", ";").replace("\x02", "U"))
                if k == "#":
                    return False
                kinds.append(k)
        return _suite("".join(kinds))


@lru_cache(MEMORY)
def _suite(kinds: str) -> bool:
    """Whether logical lines and indentation make a module."""

    def body(p: int) -> int:
        if kinds[p : p + 1] == "o":
            return p + 1
        if kinds[p : p + 1] != "{":
            return -1
        q = lines(p + 1)
        return q + 1 if q > p + 1 and kinds[q : q + 1] == "}" else -1

    def lines(p: int) -> int:
        while p < len(kinds) and kinds[p] not in "}":
            c = kinds[p]
            if c == "k":
                p += 1
                continue
            if c == "@":
                if kinds[p + 1 : p + 2] not in ("@", "f"):
                    return -1
                p += 1
                continue
            if c not in "IFWYwf":
                return -1
            p = body(p + 1)
            if p < 0:
                return -1
            if c == "I":
                while kinds[p : p + 1] == "L":
                    if (p := body(p + 1)) < 0:
                        return -1
            if c == "Y":
                n = 0
                while kinds[p : p + 1] == "H":
                    n += 1
                    if (p := body(p + 1)) < 0:
                        return -1
                if n and kinds[p : p + 1] == "E" and (p := body(p + 1)) < 0:
                    return -1
                if kinds[p : p + 1] == "y":
                    n += 1
                    if (p := body(p + 1)) < 0:
                        return -1
                if not n:
                    return -1
            elif c in "IFW" and kinds[p : p + 1] == "E" and (p := body(p + 1)) < 0:
                return -1
        return p

    return lines(0) == len(kinds)


_CHECKERS = {}


def checker(language: str):
    if language not in _CHECKERS:
        _CHECKERS[language] = {"C": lambda: _C(False), "C++": lambda: _C(True), "JavaScript": _JavaScript, "Python": _Python}[language]()
    return _CHECKERS[language]
