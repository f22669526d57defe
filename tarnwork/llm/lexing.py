"""Lexers of C, C++, JavaScript and Python: a text becomes a string of token codes, one character a token.

Codes: i name, n number or other literal, s string, t type word, q qualifier, ( ) [ ] brackets, { } braces of a block,
u v braces of a list or object, ; , : ? . and = themselves, a compound assignment, o operator with two operands,
* & @ + ! x operators that may stand alone (@ is && in C++, + also -, ! also ~, x is ++ and --), < >, ~ an ellipsis, V ::,
upper-case letters and some others for keywords (tables below), X what no text of the language holds.
In Python ; ends a logical line, and { } stand for indentation and its end.
"""

from __future__ import annotations

import re

# Keywords of the languages with their codes.
_C_WORDS = {
    "if": "I", "else": "E", "for": "F", "while": "W", "do": "D", "switch": "S", "case": "C", "default": "d", "break": "B", "continue": "B",
    "return": "R", "goto": "G", "struct": "K", "union": "K", "enum": "K", "typedef": "T", "sizeof": "z", "_Alignof": "z",
    "int": "t", "char": "t", "short": "t", "long": "t", "float": "t", "double": "t", "void": "t", "signed": "t", "unsigned": "t", "_Bool": "t",
    "const": "q", "static": "q", "inline": "q", "extern": "q", "volatile": "q", "register": "q", "restrict": "q", "_Atomic": "q", "_Thread_local": "q", "__restrict": "q",
}
_CPP_WORDS = {k: v for k, v in _C_WORDS.items() if k not in ("restrict", "_Atomic", "_Bool", "_Alignof", "_Thread_local")} | {
    "bool": "t", "wchar_t": "t", "char8_t": "t", "char16_t": "t", "char32_t": "t", "auto": "t",
    "constexpr": "q", "consteval": "q", "constinit": "q", "mutable": "q", "virtual": "q", "explicit": "q", "friend": "q", "thread_local": "q", "typename": "q", "noexcept": "q", "override": "q", "final": "q",
    "class": "K", "namespace": "w", "using": "T", "template": "M", "operator": "O", "try": "Y", "catch": "H", "throw": "z", "new": "N", "delete": "z", "alignof": "z", "co_await": "z", "co_yield": "z", "co_return": "R",
    "public": "Q", "private": "Q", "protected": "Q",
}
_JS_WORDS = {
    "if": "I", "else": "E", "for": "F", "while": "W", "do": "D", "switch": "S", "case": "C", "default": "d", "break": "B", "continue": "B",
    "return": "R", "throw": "R", "try": "Y", "catch": "H", "finally": "y", "function": "f", "class": "K", "extends": "e", "let": "l", "const": "l", "var": "l",
    "new": "z", "typeof": "z", "void": "z", "delete": "z", "await": "z", "yield": "z", "async": "g", "in": "o", "instanceof": "o", "of": "j",
    "import": "T", "export": "M", "this": "i", "super": "i", "null": "n", "true": "n", "false": "n",
}
_PY_WORDS = {
    "if": "I", "elif": "L", "else": "E", "for": "F", "while": "W", "try": "Y", "except": "H", "finally": "y", "with": "w", "def": "f", "class": "K", "async": "g", "await": "z",
    "return": "R", "raise": "r", "from": "m", "import": "T", "as": "k", "pass": "B", "break": "B", "continue": "B", "global": "G", "nonlocal": "G", "del": "D", "assert": "C",
    "lambda": "l", "yield": "N", "in": "j", "is": "J", "not": "!", "and": "o", "or": "o", "None": "n", "True": "n", "False": "n",
}

_NAME = r"(?:[A-Za-z_$]|[^\W\d])\w*"
_MARKER = r"(?P<marker>^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z))"
_PUNCT = r"(?P<punct><<=|>>=|>>>=|\*\*=|//=|<=>|\?\?=|&&=|\|\|=|===|!==|>>>|->\*|\.\.\.|=>|::|->|\?\.(?!\d)|\?\?|:=|\*\*|//|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^@]=|##|[-+*/%&|^~!<>=?:;,.(){}\[\]@#])"

# what hides its content from the lexer of C: comments, literals, directives, and the marks of an unfinished merge.
# Each alternative opens with a plain character, which lets the regex engine skip to candidates.
_C_OPAQUE = re.compile(
    r"(?P<comment>//(?:[^\n\\]|\\.|\\\n)*|/\*.*?\*/|\\\r?\n)|(?P<directive>\#(?:/\*.*?\*/|[^\n\\/]|/(?![*/])|//[^\n]*|\\.|\\\r?\n)*)"
    r'|(?P<string>"(?:[^"\\\n]|\\.|\\\r?\n)*")'
    r"|(?P<char>'(?:[^'\\\n]|\\.)+')|(?P<bad>\"|'|/\*)",
    re.S,
)
_C_MARKER = re.compile(_C_OPAQUE.pattern + r"|(?P<marker><{7}|={7}|>{7}|\|{7})", re.S)
_C_RAW = re.compile(r'(?P<comment>//(?:[^\n\\]|\\.|\\\n)*|/\*.*?\*/)|(?:u8|u|U|L)?R"(?P<fence>[^()\\\s]{0,16})\(.*?\)(?P=fence)"|"(?:[^"\\\n]|\\.|\\\r?\n)*"', re.S)
_MARKS = ("<<<<<<<", "=======", ">>>>>>>", "|||||||")
#: Heads that other languages have; as C they would declare a name of a type "function", "let" or "def".
_FOREIGN_HEAD = re.compile(r"^[ \t]*(?:(?:async[ \t]+)?function[ \t]+\w+[ \t]*\(|(?:let|var)[ \t]+\w+[ \t]*[=;]|def[ \t]+\w+[ \t]*\()", re.M)
_SEPARATED = re.compile(r"\b\d[\w.]*(?:'[\w.]+)+")
_JS_RE = re.compile(
    rf"{_MARKER}|(?P<blank>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:[^\"\\\n]|\\.|\\\r?\n)*\"|'(?:[^'\\\n]|\\.|\\\r?\n)*')"
    rf"|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?n?|\d+\.)(?!\w)|(?P<name>\#?{_NAME})|(?P<tick>`)|{_PUNCT}|(?P<bad>.)",
    re.S | re.M,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_PY_RE = re.compile(
    rf"{_MARKER}|(?P<blank>[ \t\f]+|\#[^\n]*|\\\r?\n)|(?P<newline>\r?\n|\r)"
    r"|(?P<long>(?P<lp>[A-Za-z]{0,2})(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''))"
    r"|(?P<string>(?P<sp>[A-Za-z]{0,2})(?:\"(?:[^\"\\\n]|\\.|\\\r?\n)*\"|'(?:[^'\\\n]|\\.|\\\r?\n)*'))"
    rf"|(?P<number>0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?[jJ]?|\d+\.)(?!\w)|(?P<name>{_NAME})|{_PUNCT}|(?P<bad>.)",
    re.S,
)
_PY_PREFIX = re.compile(r"(?i:|r|u|b|f|t|br|rb|fr|rf|tr|rt)\Z")

_SHARED = {
    "(": "(", ")": ")", "[": "[", "]": "]", ";": ";", ",": ",", ":": ":", "?": "?", ".": ".", "=": "=", "*": "*", "&": "&", "+": "+", "-": "+", "!": "!", "~": "!", "++": "x", "--": "x", "<": "<", ">": ">",
    "/": "o", "%": "o", "|": "o", "^": "o", "||": "o", "&&": "o", "<<": "o", ">>": "o", "<=": "o", ">=": "o", "==": "o", "!=": "o",
    "+=": "a", "-=": "a", "*=": "a", "/=": "a", "%=": "a", "&=": "a", "|=": "a", "^=": "a", "<<=": "a", ">>=": "a", "...": "~",
}
_C_PUNCT = _SHARED | {"->": "."}
_CPP_PUNCT = _C_PUNCT | {"&&": "@", ">>": ">>", "::": "V", "<=>": "o", "->*": "o"}
_JS_PUNCT = _SHARED | {"===": "o", "!==": "o", ">>>": "o", ">>>=": "a", "**": "o", "**=": "a", "??": "o", "??=": "a", "&&=": "a", "||=": "a", "?.": ".", "=>": "O"}
_PY_PUNCT = {k: v for k, v in _SHARED.items() if k not in ("++", "--", "&&", "||", "!", "?", "&")} | {"&": "o", "**": "P", "//": "o", "//=": "a", "**=": "a", "@=": "a", "@": "@", "->": "A", ":=": "U", "~": "!", "...": "n"}


# conditional compilation in a code string: begin, next branch, last branch, end
_IF, _ELIF, _ELSE, _ENDIF = "\x11", "\x12", "\x13", "\x14"
_CONDITIONS = {"if": _IF, "ifdef": _IF, "ifndef": _IF, "elif": _ELIF, "elifdef": _ELIF, "elifndef": _ELIF, "else": _ELSE, "endif": _ENDIF}


#: Up to so many conditions, all ways they may go are taken; beyond, every two of them in all ways, with all others off and on.
ALL_WAYS = 8
_DEFINED = re.compile(r"\bdefined\s*(?:\(\s*(\w+)\s*\)|(\w+))")
_LOGIC = re.compile(r"\w+|&&|\|\||[!()]|\s+")
_PYTHON = {"&&": " and ", "||": " or ", "!": " not "}


def _condition(word: str, text: str, atoms: dict[str, int]):
    """What a directive demands: code over ``a``, whether each atom holds, and the atoms it names. A part that is no logic of names is an atom as a whole."""
    text = re.sub(r"/\*.*?\*/|//[^\n]*|\\\r?\n", " ", text, flags=re.S).strip()
    if word.endswith("def"):
        text = ("!" if word.endswith("ndef") else "") + text
    text = _DEFINED.sub(lambda m: m.group(1) or m.group(2), text)
    got = _LOGIC.findall(text)
    if "".join(got) == text:
        names = [t for t in got if t[0].isalnum() or t[0] == "_"]
        new = {n: len(atoms) + k for k, n in enumerate(dict.fromkeys(n for n in names if n not in atoms))}
        try:
            code = compile("(" + "".join(_PYTHON.get(t, f" a[{atoms.get(t, new.get(t))}] " if t in names else t) for t in got).strip() + ")", "", "eval")
            atoms.update(new)
            return code, sorted({atoms[n] for n in names})
        except (SyntaxError, MemoryError, RecursionError):
            pass
    k = atoms.setdefault(" ".join(text.split()), len(atoms))
    return compile(f"a[{k}]", "", "eval"), [k]


def variants(codes: str, conditions: list[tuple[str, str]] | None = None) -> list[str]:
    """Code strings with conditional compilation resolved, each branch being taken in at least one; X if unbalanced.

    ``conditions`` has the word and the text of each directive in order; without them every branch has a condition of its own.
    Branches of one condition go together, different conditions each way (see ``ALL_WAYS``).
    """
    marks = re.findall("[\x11-\x14]", codes)
    if not marks:
        return [codes]
    if conditions is None or len(conditions) != len(marks):
        conditions = [("if", f"c{k}") for k in range(len(marks))]
    atoms: dict[str, int] = {}
    given = iter(conditions)
    root: list = []
    body, stack = root, []
    for part in re.split("([\x11-\x14])", codes):
        if part and part in "\x11\x12\x13\x14":
            word, text = next(given)
        if part == _IF:
            branches: list = [(_condition(word, text, atoms), [])]
            body.append(branches)
            stack.append([body, branches, False])
            body = branches[0][1]
        elif part in (_ELIF, _ELSE):
            if not stack or stack[-1][2]:
                return ["X"]
            stack[-1][2] = part == _ELSE
            stack[-1][1].append((None if part == _ELSE else _condition(word, text, atoms), []))
            body = stack[-1][1][-1][1]
        elif part == _ENDIF:
            if not stack:
                return ["X"]
            body = stack.pop()[0]
        elif part:
            body.append(part)
    if stack:
        return ["X"]

    def take(part: list, a: list[bool]) -> str:
        return "".join([x if isinstance(x, str) else take(next((b for c, b in x if c is None or eval(c[0], {"a": a})), []), a) for x in part])

    def branches_of(part: list, above: list) -> list[list]:
        """The conditions on the way to each branch: (code, whether it holds)."""
        out = []
        for x in part:
            if not isinstance(x, str):
                no: list = []
                for c, b in x:
                    way = above + no + ([] if c is None else [(c, True)])
                    out += [way, *branches_of(b, way)]
                    no = no + ([] if c is None else [(c, False)])
                out.append(above + no)
        return out

    n = len(atoms)
    if n <= ALL_WAYS:
        ways = [[bool(w >> k & 1) for k in range(n)] for w in range(1 << n)]
    else:
        ways = []
        for others in (False, True):
            ways.append([others] * n)
            for i in range(n):
                for j in range(i, n):
                    for p, q in ((True, True), (True, False), (False, True), (False, False)):
                        way = [others] * n
                        way[i], way[j] = p, q
                        ways.append(way)
        for path in branches_of(root, []):  # a branch below many conditions: those on its way as it needs them
            for others in (False, True):
                way = [others] * n
                for _ in range(n):
                    off = next(((c, v) for c, v in path if bool(eval(c[0], {"a": way})) != v), None)
                    if off is None:
                        break
                    for k in off[0][1]:
                        way[k] = off[1]
                ways.append(way)
    return list(dict.fromkeys(take(root, w) for w in ways))


class _Codes(dict):
    """Codes of tokens; names are added as they are met."""

    def __missing__(self, token: str) -> str:
        c = token[0]
        code = "i" if c == "_" or c == "$" or c.isalpha() else "n" if c.isdigit() or (c == "." and len(token) > 1) else "X"
        if len(self) < 300_000:
            self[token] = code
        return code


_C_TOKENS = re.compile(rf"{_NAME}|\.?\d(?:[\w.]|(?<=[eEpP])[+-])*|" + _PUNCT.removeprefix("(?P<punct>").removesuffix(")") + r"|\S")
_C_CODES = {
    False: _Codes(_C_WORDS | _C_PUNCT | {'"': "s", "'": "n", "enum": "k", "`": "X"} | {c: c for c in "{}\x11\x12\x13\x14"}),
    True: _Codes(_CPP_WORDS | _CPP_PUNCT | {'"': "s", "'": "n", "enum": "k", "`": "X"} | {c: c for c in "{}\x11\x12\x13\x14"}),
}
_BLOCK_AFTER = re.compile("(?:(?<=[)EDY};:q\x02])|^)\\{")
_BLOCK_TYPE = re.compile(r"[Kw][^;()={}k]*\{|\)q*\.[itV*&<>]+\{")


def lex_c(text: str, cpp: bool) -> list[str]:
    """The code strings of the variants of a C or C++ text."""
    conditions: list[tuple[str, str]] = []

    def put(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "comment":
            return " "
        if kind == "string":
            return ' " '
        if kind == "char":
            return " ' "
        if kind in ("directive", "marker"):
            before = m.string[m.string.rfind("\n", 0, m.start()) + 1 : m.start()]
            if kind == "marker":
                return " ` " if not before and m.string[m.end() : m.end() + 1] in ("", " ", "\r", "\n") else m.group()
            if before.strip() and not re.fullmatch(r"\s*/\*.*\*/\s*", before, re.S):
                return " ` "
            word, rest = re.match(r"#\s*(\w*)(.*)", m.group(), re.S).groups()
            if word not in _CONDITIONS:
                return " "
            conditions.append((word, rest))
            return f" {_CONDITIONS[word]} "
        return " ` "

    if 'R"' in text and cpp:
        text = _C_RAW.sub(lambda m: ' "" ' if m.group("fence") is not None else m.group(), text)
    if _FOREIGN_HEAD.search(text):
        text = _FOREIGN_HEAD.sub(" ` ", text)
    if "'" in text and _SEPARATED.search(text):
        text = _SEPARATED.sub(lambda m: m.group().replace("'", ""), text)
    plain = (_C_MARKER if any(k in text for k in _MARKS) else _C_OPAQUE).sub(put, text)
    # the end of a line is no token of C; marks of an unfinished merge are caught as such
    codes = "".join(map(_C_CODES[cpp].__getitem__, _C_TOKENS.findall(plain)))
    return [_braces_c(v) for v in variants(codes, conditions)]


def _braces_c(s: str) -> str:
    """Braces of lists become u and v."""
    t = _BLOCK_AFTER.sub("\x02", s)
    while "{" in t:
        u = _BLOCK_AFTER.sub("\x02", _BLOCK_TYPE.sub(lambda m: m.group()[:-1] + "\x02", t))
        if u == t:
            break
        t = u
    if "{" not in t:
        return t.replace("\x02", "{")
    out, stack, last = [], [], 0
    for m in re.finditer(r"[{}\x02]", t):
        c, at = m.group(), m.start()
        out.append(t[last:at])
        last = at + 1
        if c == "}":
            out.append("v" if stack and stack.pop() == "{" else "}")
        else:
            stack.append(c)
            out.append("u" if c == "{" else "{")
    out.append(t[last:])
    return "".join(out)


def lex_js(text: str) -> list[str]:
    out: list[str] = []
    fresh: list[bool] = []  # whether a line break stands before the token
    kinds: list[str] = []
    pos, n, line = 0, len(text), False
    templates: list[int] = []  # open ${ by brace depth
    stack: list[str] = []

    def add(c: str) -> None:
        nonlocal line
        out.append(c)
        fresh.append(line)
        line = False

    def template(at: int) -> int:
        """Reads template text from ``at``; the place after ` or ${, or -1."""
        while at < n:
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                add("s")
                return at + 1
            elif text.startswith("${", at):
                add("s")
                add("p")
                stack.append("p")
                return at + 2
            else:
                at += 1
        add("X")
        return n

    while pos < n:
        prev = out[-1] if out else ""
        if text[pos] == "/" and not text.startswith(("//", "/*"), pos) and prev not in ("i", "n", "s", ")", "]", "v", "x"):
            m = _JS_REGEX.match(text, pos)
            if m:
                add("n")
                pos = m.end()
                continue
        m = _JS_RE.match(text, pos)
        kind, v = m.lastgroup, m.group()
        pos = m.end()
        if kind == "blank":
            line |= "\n" in v
            continue
        if kind == "tick":
            pos = template(pos)
        elif kind == "name":
            c = _JS_WORDS.get(v, "i")
            if prev == "." or (c not in "in" and stack and stack[-1] == "u" and prev in ("u", ",") and text[pos:].lstrip()[:1] in (":", "(", ",", "}")):
                c = "i"
            if c == "j" and not (stack and stack[-1] == "(" and prev in "iv]"):
                c = "i"
            if c == "g" and not re.match(r"\s*(?:function\b|\(|[A-Za-z_$])", text[pos:]):
                c = "i"
            add(c)
        elif kind == "punct":
            if v == "{":
                block = prev in ("", ")", "O", "E", "D", "Y", "y", "{", "}", ";", "H") or _class_head(out) or (prev == ":" and not (stack and stack[-1] in "u("))
                c = "{" if block else "u"
                stack.append(c)
                add(c)
                if block and prev not in ("", ")", "O", "E", "D", "Y", "y", "{", "}", ";", "H", ":"):
                    add("k")
            elif v == "}":
                while stack and stack[-1] == "(":
                    stack.pop()
                top = stack.pop() if stack else ""
                if top == "p":
                    add("P")
                    pos = template(pos)
                else:
                    add("v" if top == "u" else "}")
            else:
                c = _JS_PUNCT.get(v, "X")
                if c == "(":
                    stack.append("(")
                elif c == ")" and stack and stack[-1] == "(":
                    stack.pop()
                add(c)
        elif kind in ("number", "string"):
            add("n" if kind == "number" else "s")
        else:
            add("X")
    if "p" in stack:
        out.append("X")
        fresh.append(False)
    return ["".join(out), "".join("1" if f else "0" for f in fresh)]


def _class_head(out: list[str]) -> bool:
    for c in reversed(out[-6:]):
        if c == "K":
            return True
        if c not in "ie.":
            return False
    return False


def lex_python(text: str) -> list[str]:
    out: list[str] = []
    depth, indents, start, pos, n = 0, [0], True, 0, len(text)
    if text.startswith("﻿"):
        pos = 1
    opened: list[str] = []
    while pos < n:
        if start and not opened:
            m = re.compile(r"[ \t\f]*").match(text, pos)
            rest = m.end()
            if rest >= n:
                break
            if text[rest] in "\r\n#":
                end = text.find("\n", rest)
                pos = n if end < 0 else end + 1
                continue
            width = len(m.group().expandtabs(8))
            if width > indents[-1]:
                indents.append(width)
                out.append("{")
            else:
                while width < indents[-1]:
                    indents.pop()
                    out.append("}")
                if width != indents[-1]:
                    out.append("X")
            start = False
            at_line = pos
            pos = rest
            if at_line == pos == 0:
                pass
        m = _PY_RE.match(text, pos)
        kind, v = m.lastgroup, m.group()
        pos = m.end()
        if kind in ("blank",):
            continue
        if kind == "newline":
            if not opened:
                if out and out[-1] not in "{}":
                    out.append(";")
                start = True
            continue
        if kind in ("lp", "long", "sp", "string"):
            prefix = m.group("lp") if m.group("long") is not None else m.group("sp")
            if not _PY_PREFIX.match(prefix or ""):
                out.append("X")
            elif "f" in (prefix or "").lower():
                out.append("s" if _fstring_ok(v, len(prefix)) else "X")
            else:
                out.append("s")
            continue
        if kind == "name":
            out.append(_PY_WORDS.get(v, "i") if v.isascii() or v.isidentifier() else "X")
        elif kind == "number":
            bad = re.match(r"0\d*[1-9]", v) and not re.search(r"[.eEjJ]", v)
            out.append("X" if bad else "n")
        elif kind == "punct":
            if v in "([{":
                opened.append(v)
                out.append("u" if v == "{" else v)
            elif v in ")]}":
                if opened:
                    opened.pop()
                out.append("v" if v == "}" else v)
            elif v == ";":
                out.append("Z")
            elif v == "!=":
                out.append("o")
            else:
                out.append(_PY_PUNCT.get(v, "X"))
        else:
            out.append("X")
    if opened:
        out.append("X")
    if out and out[-1] not in ";{}":
        out.append(";")
    out += ["}"] * (len(indents) - 1)
    return ["".join(out)]


def _fstring_ok(v: str, skip: int) -> bool:
    """Whether the braces of a formatted string are balanced."""
    body = v[skip:]
    q = 3 if body[:3] in ('"""', "'''") else 1
    body = body[q:-q]
    depth, k = 0, 0
    while k < len(body):
        c = body[k]
        if depth == 0 and body[k : k + 2] in ("{{", "}}"):
            k += 2
            continue
        if c == "{":
            if re.match(r"\{\s*[}!:]", body[k:]):
                return False
            depth += 1
        elif c == "}":
            depth -= 1
            if depth < 0:
                return False
        k += 1
    return depth == 0


LANGUAGES = {"c": "C", "h": "C++", "hpp": "C++", "cc": "C++", "cpp": "C++", "py": "Python", "js": "JavaScript"}


def lex(text: str, language: str) -> list[str]:
    """Code strings: the variants for C and C++, (codes, line-break flags) for JavaScript, one for Python."""
    if language in ("C", "C++"):
        return lex_c(text, language == "C++")
    return lex_js(text) if language == "JavaScript" else lex_python(text)
