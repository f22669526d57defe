"""Which token codes may stand side by side, derived from grammars.

A grammar has a rule a line; words of two letters or more are rules, single characters are token codes of ``lexing``; a rule name
may end in ? * or +; " / " parts alternatives. Two codes may be adjacent if one can end and the other can begin neighbouring
parts of some alternative.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

_C = """
top: piece*
piece: temp* spec* declr tailq* = d ; / temp* spec* declr tailq* = z ; / temp* spec* declr tailq* inits? block / temp* simple ; / temp* spec* typedefn initds? ; / wd name? block / ; / Q : / q s block / q s piece / T simple ; / T w name ; / T name = type ;
wd: w / q w
temp: M < tlist? >
spec: q / t / T / K name / k name / K / k / name
name: i / V name / i V name / i targs / i targs V name / ! name / i V O oper / i V ! i
targs: < tlist? >
tlist: targ / targ , tlist
targ: type / n / type ~ / K i / spec = type / K ~ i / q i / q ~ i
type: spec+ ptr* absd?
spec2: q
ptr: * / & / @ / q
absd: ( ptr* ) / ( params? ) / [ expr? ] / ( params? ) absd / ( ptr* ) absd
declr: ptr* core suffix*
core: name / ( declr ) / O oper
oper: o / * / & / + / ! / x / = / a / < / > / ( ) / [ ] / name / @
suffix: ( params? ) / [ exprs? ] / ( exprs? )
tailq: q / q ( exprs ) / . type / & / @
inits: : initm
initm: name ( args? ) / name list / initm , initm
params: param / param , params
param: spec+ declr? init? / type / ~ / spec+ ptr* ~ name?
init: = expr / = list / list
list: u elems? v
elems: elem / elem , / elem , elems
elem: arg / list / . i = elem / [ expr ] = elem / . i list
simple: spec+ initds? / exprs
initds: initd / initd , initds
initd: declr init? / declr : n / : n
exprs: expr / expr , exprs
expr: unary / unary bin expr / unary ? expr : expr / unary = list
bin: o / * / & / @ / + / < / > / = / a / > > / < <
unary: pre* post
pre: ! / * / & / @ / + / x / z / ( type ) / z ( type )
post: prim tail*
prim: name / n / strs / ( exprs ) / lambda / t ( args? ) / t list / N place? type newend? / K name / ( block )
place: ( args )
newend: ( args? ) / [ expr ] / list
strs: s strs? / i s
tail: ( args? ) / [ exprs? ] / list / . name / . O oper / x / . M name
args: arg / arg , args
arg: expr / list / type / ~ / expr ~
lambda: [ caps? ] lpar? lq* block / [ caps? ] < tlist > lpar block
lpar: ( params? )
lq: q / . type
caps: cap / cap , caps
cap: & / = / expr / & name / * i / & i ~
stmt: ; / exprs ; / simple ; / T simple ; / R exprs? ; / R list ; / B ; / G i ; / iff / F ( fhead ) stmt / W ( cond ) stmt / D stmt W ( cond ) ; / S ( cond ) stmt / C expr : / C expr ~ expr : / d : / i : / Q : / Y block handler+ / block / spec* typedefn initds? ; / piece
iff: I q? ( cond ) stmt / I q ( cond ) stmt / I ( cond ) stmt / iff E stmt
cond: exprs / spec+ declr init / simple ; exprs
fhead: fpart ; exprs? ; exprs? / spec+ ptr* i : arg / spec+ ptr* [ caps ] : arg
fpart: simple?
handler: H ( param ) block
block: { stmt* }
typedefn: K q* name? base? { member* } / k name? base? list / k K name? base? list
base: : q* basel
basel: Q? name / Q name / name / name , basel / type
member: piece / stmt
"""

_JAVASCRIPT = """
top: stmt*
stmt: ; / exprs ; / l binds ; / R exprs? ; / B i? ; / if / F fw? ( fhead ) stmt / W ( exprs ) stmt / D stmt W ( exprs ) ; / D stmt W ( exprs ) stmt / S ( exprs ) block / C exprs : / d : / i : / Y block handler+ / block / func / klass / T imports ; / M exported / stmt stmt
if: I ( exprs ) stmt / I ( exprs ) stmt E stmt
fw: z
fhead: finit? ; exprs? ; exprs? / l target j expr / l target o expr / expr j expr
finit: l binds / exprs
binds: bind / bind , binds
bind: target / target = expr
target: i / object / array / member
handler: H ( target ) block / H block / y block
block: { stmt* }
func: g? f star? i? ( params? ) block / f i ( params? ) block / f ( params? ) block / f * i ( params? ) block / g f i ( params? ) block / g f ( params? ) block
star: *
params: param / param , params / param ,
param: bind / ~ target
klass: K i e expr { k members* } / K i { k members* } / K { k members* } / K e expr { k members* }
members: mods key ( params? ) block / key ( params? ) block / key = expr ; / key ; / i block / ;
mods: g / * / i / g *
key: i / n / s / [ expr ] / kw
kw: I / E / F / W / D / S / C / d / B / R / Y / H / f / K / T / M / o / y / l / z / e
exprs: expr / expr , exprs
expr: unary / unary bin expr / unary ? expr : expr / arrow / unary = expr / unary a expr / object = expr
arrow: g? params1 O abody / i O abody / ( params? ) O abody / g i O abody / g ( params? ) O abody
params1: i / ( params? )
abody: expr / block
bin: o / * / & / + / < / > / @
unary: pre* post
pre: ! / + / x / z
post: prim tail* / prim tail* x
prim: i / n / tmpl / ( exprs ) / array / object / func / klass / z
tmpl: s tparts? / s
tparts: p exprs P s / p exprs P s tparts
tail: ( args? ) / [ exprs ] / . key / tmpl / . ( args? ) / . [ exprs ]
args: arg / arg , args / arg ,
arg: expr / ~ expr
array: [ elems? ]
elems: arg / arg , / arg , elems / , / , elems
object: u props? v
props: prop / prop , / prop , props
prop: key : expr / i / i = expr / ~ expr / key ( params? ) block / mods key ( params? ) block / g key ( params? ) block
member: post
imports: s / exprs
exported: l binds ; / func / klass / d expr ; / u props? v ;
"""

_PYTHON = """
top: line*
line: simples ; / compound
simples: simple / simple Z simples / simple Z
simple: exprl / exprl = simple / exprl a rhs / exprl : expr / exprl : expr = rhs / R rhs? / r expr? / r expr m expr / B / G names / D exprl / C expr / C expr , expr / T mods / m dotted T imps / exprl = rhs
rhs: exprl / N exprl? / N m expr / i = rhs
names: i / i , names
mods: dot / dot k i / mods , mods
dot: i / i . dot / . dot
dotted: dot / . / n / . dotted / n dotted
imps: * / ( imps ) / imp / imp , imps / imp ,
imp: i / i k i
compound: I named : suite / compound L named : suite / compound E : suite / F exprl j exprl : suite / W named : suite / Y : suite / compound H exc : suite / H : suite / compound y : suite / w withs : suite / g compound / f i ( params? ) ret? : suite / f i tpar ( params? ) : suite / K i : suite / K i ( args? ) : suite / @ expr ; compound / i exprl : suite / compound compound
tpar: [ names ]
exc: exprl / exprl k i / * exprl / * exprl k i / eps
eps: H
ret: A expr
withs: with / with , withs / ( withs )
with: expr / expr k expr
suite: simples ; / ; { line* }
exprl: sexpr / sexpr , / sexpr , exprl
sexpr: named / * expr / lamb
named: expr / i U expr
expr: cmp / cmp I expr E expr / lamb
lamb: l params? : expr / l : expr
cmp: unary / unary op cmp
op: o / * / + / < / > / @ / j / ! j / J / J !
unary: pre* post / post P unary
pre: ! / + / z
post: prim tail*
prim: i / n / strs / ( exprl? ) / ( N exprl? ) / ( comp ) / [ exprl? ] / [ comp ] / u items? v / ( N m expr )
strs: s strs? / s
items: item / item , / item , items / expr comps / expr : expr comps
item: expr : expr / P expr / sexpr
comp: expr comps / named comps
comps: F exprl j cmp cif? / g F exprl j cmp cif? / comps comps
cif: I cmp / cif cif
tail: ( args? ) / [ subs ] / . i
args: arg / arg , args / arg ,
arg: named / i = expr / * expr / P expr / expr comps
subs: sub / sub , subs / sub ,
sub: sexpr / expr? : expr? / expr? : expr? : expr? / comp
params: param / param , params / param ,
param: i / i : expr / i = expr / i : expr = expr / * / * i / P i / o / * i : expr / P i : expr
"""


def derive(grammar: str) -> tuple[frozenset[str], str, str]:
    """(pairs that may be adjacent, codes that may open a text, codes that may close it)."""
    rules: dict[str, list[list[str]]] = {}
    for row in grammar.strip().split("\n"):
        name, _, body = row.partition(": ")
        rules[name] = [alt.split() for alt in body.split(" / ")]

    def parse(sym: str) -> tuple[str, str]:
        return (sym[:-1], sym[-1]) if len(sym) > 1 and sym[-1] in "?*+" else (sym, "")

    nullable = {n: False for n in rules}
    first: dict[str, set[str]] = {n: set() for n in rules}
    last: dict[str, set[str]] = {n: set() for n in rules}
    pairs: set[str] = set()

    def empty(sym: str) -> bool:
        base, mark = parse(sym)
        return mark in ("?", "*") and mark != "" or (base in rules and nullable[base])

    def of(table: dict[str, set[str]], sym: str) -> set[str]:
        base = parse(sym)[0]
        return table[base] if base in rules else {base}

    for alts in rules.values():
        for alt in alts:
            for sym in alt:
                base = parse(sym)[0]
                if len(base) > 1 and base not in rules:
                    raise ValueError(f"no rule {base}")
    while True:
        before = sum(map(len, first.values())) + sum(map(len, last.values())) + len(pairs) + sum(nullable.values())
        for name, alts in rules.items():
            for alt in alts:
                nullable[name] |= all(map(empty, alt))
                for side, table in ((alt, first), (alt[::-1], last)):
                    for sym in side:
                        table[name] |= of(table, sym)
                        if not empty(sym):
                            break
                for i, left in enumerate(alt):
                    if parse(left)[1] in ("*", "+"):
                        pairs |= {x + y for x, y in product(of(last, left), of(first, left))}
                    for right in alt[i + 1 :]:
                        pairs |= {x + y for x, y in product(of(last, left), of(first, right))}
                        if not empty(right):
                            break
        if before == sum(map(len, first.values())) + sum(map(len, last.values())) + len(pairs) + sum(nullable.values()):
            return frozenset(pairs), "".join(sorted(first["top"])), "".join(sorted(last["top"]))


@lru_cache(None)
def permissible(language: str) -> frozenset[str]:
    """Adjacent code pairs of a language; ^ is the start of a text and $ its end."""
    pairs, opens, closes = derive({"C": _C, "C++": _C, "Python": _PYTHON, "JavaScript": _JAVASCRIPT}[language])
    return frozenset(pairs | {"^" + c for c in opens} | {c + "$" for c in closes})
