"""Secrets in texts, found by one combined deterministic automaton.

Every rule is a regular expression over bytes. All rules together are compiled on the driver: expressions to one
nondeterministic automaton that may begin anywhere, subset construction over classes of bytes that no rule tells apart,
then minimisation, then one flat array of transitions, in which the states that end a match come last. A text's UTF-8 bytes
pass through it once, for all rules; what comes out are the runs of places where matches of a rule end. Where such a match
begins is read backwards from its first end by the automaton of the reversed rule, over the match's own bytes only.

Matches of a kind are the leftmost ones that do not overlap, as a regex library finds them: a rule ends in a repeated class
of bytes or in fixed ones, so a match goes on to the end of its run, and where the match before has taken the beginning, the
rule's own automaton starts anew behind it. Lengths are checked afterwards; a match that fails still takes its place.

Beside the kinds of RULES[:3] the scan has further ones; none of them takes anything from the first three. ``inner`` is an
assignment of sufficient length that a regex library misses, since it begins in a match that fails:
``password: token: abcdefghijkl``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import column, documents, fresh, map_columns


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, and the least length of the match, or of its last repeated class if ``of_tail``."""

    kind: str
    pattern: str
    least: int = 1
    of_tail: bool = False
    any_case: bool = False


#: Formats of secrets, few of them, as every endless class multiplies the states (these have about 4,000).
#: The first three are the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
RULES = (
    Rule("assign", ASSIGN, 12, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16}[0-9a-f]*", 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", 24),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 32),
    Rule("url", r"[a-z]+://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+=-]+@"),
)
BASE = 3
INNER = "inner"
#: Bytes that continue a code point in UTF-8.
FOLLOWING = bytes(range(0x80, 0xC0))


def read_pattern(pattern: str, any_case: bool = False):
    """A regular expression as nested tuples: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None).

    Letters, ``\\xHH`` and escaped signs, classes with ranges, groups, ``|`` and the repeats ``? * + {n} {n,}``; ASCII only.
    """
    at = 0

    def fold(found: set[int]) -> tuple:
        if any_case:
            found = {x for b in found for x in (b, ord(chr(b).lower()), ord(chr(b).upper()))}
        return ("set", frozenset(found))

    def sign() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
            if c.isalnum():
                raise ValueError(f"unknown escape \\{c}")
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def one():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inside = either()
            if pattern[at : at + 1] != ")":
                raise ValueError("a group is not closed")
            at += 1
            return inside
        if pattern[at] == "[":
            at += 1
            found: set[int] = set()
            while pattern[at] != "]":
                low = high = sign()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = sign()
                found |= set(range(low, high + 1))
            at += 1
            return fold(found)
        return fold({sign()})

    def repeated():
        nonlocal at
        part = one()
        while at < len(pattern) and pattern[at] in "?*+{":
            mark = pattern[at]
            at += 1
            if mark == "{":
                end = pattern.index("}", at)
                low, comma, _ = pattern[at:end].partition(",")
                part, at = ("rep", part, int(low), None if comma else int(low)), end + 1
            else:
                part = ("rep", part, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[mark])
        return part

    def either():
        nonlocal at
        options, parts = [], []
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                options.append(("cat", parts))
                parts = []
            else:
                parts.append(repeated())
        return ("alt", [*options, ("cat", parts)])

    out = either()
    if at != len(pattern):
        raise ValueError("a group is not opened")
    return out


def backwards(node):
    """The expression of all words read from their ends."""
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", backwards(node[1]), *node[2:])
    parts = [backwards(x) for x in node[1]]
    return (node[0], parts[::-1] if node[0] == "cat" else parts)


@dataclass
class Automaton:
    """Transitions in one list: step[state + class], states in steps of the number of classes.

    classes turns bytes into classes. States from ``ends`` on end a match, of the rules whose bits ``rules`` has for them;
    ``dead`` leads nowhere (-1 if there is no such state).
    """

    classes: bytes
    step: list[int]
    start: int
    ends: int
    rules: dict[int, int]
    dead: int


def compile_rules(nodes: list, anywhere: bool) -> Automaton:
    """One minimal automaton for the expressions; with ``anywhere`` a match may begin at any byte."""
    free: list[list[int]] = []  # moves without a byte
    takes: list[tuple[frozenset[int], int] | None] = []

    def state() -> int:
        free.append([])
        takes.append(None)
        return len(free) - 1

    def wire(node, here: int) -> int:
        """Adds the states of an expression behind ``here``; the state behind it."""
        if node[0] == "set":
            end = state()
            takes[here] = (node[1], end)
            start = state()  # keeps ``end`` free for what follows
            free[end].append(start)
            return start
        if node[0] == "cat":
            for part in node[1]:
                here = wire(part, here)
            return here
        if node[0] == "alt":
            end = state()
            for part in node[1]:
                begin = state()
                free[here].append(begin)
                free[wire(part, begin)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            here = wire(part, here)
        end, begin = state(), state()
        free[here] += [begin, end]
        if high is None:
            free[wire(part, begin)] += [begin, end]
        else:
            for _ in range(high - low):
                after = wire(part, begin)
                free[after].append(end)
                begin = state()
                free[after].append(begin)
        return end

    first = state()
    last = {}
    for k, node in enumerate(nodes):
        begin = state()
        free[first].append(begin)
        last[wire(node, begin)] = 1 << k

    reach: list[frozenset[int]] = []
    for s in range(len(free)):
        seen, todo = {s}, [s]
        while todo:
            for t in free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach.append(frozenset(t for t in seen if takes[t] is not None or t in last))

    sets = sorted({t[0] for t in takes if t is not None}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    wide = len(kinds)
    sample = [classes.index(c) for c in range(wide)]
    moves = {s: [t[1] if b in t[0] else None for b in sample] for s, t in enumerate(takes) if t is not None}

    number = {reach[first]: 0}
    order, table = [reach[first]], []
    for now in order:  # grows as states are found
        row = []
        for c in range(wide):
            nxt: frozenset[int] = frozenset().union(*[reach[moves[s][c]] for s in now if s in moves and moves[s][c] is not None])
            if anywhere:
                nxt |= reach[first]
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        table.append(row)
    accepts = np.array([sum(last.get(s, 0) for s in now) for now in order])

    # states stay apart as long as what they end, or where a class of bytes leads from them, differs
    moves_to, part = np.array(table), np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[moves_to]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    one = np.unique(part, return_index=True)[1]  # a state of each part
    rank = np.argsort(accepts[one] > 0, kind="stable")
    place = np.empty(len(rank), int)
    place[rank] = np.arange(len(rank))
    step = place[part[moves_to[one[rank]]]]
    found = accepts[one[rank]]
    stays = np.flatnonzero((step == np.arange(len(rank))[:, None]).all(axis=1) & (found == 0))
    return Automaton(
        classes,
        (step * wide).ravel().tolist(),
        int(place[part[0]]) * wide,
        int((found == 0).sum()) * wide,
        {k * wide: int(m) for k, m in enumerate(found) if m},
        int(stays[0]) * wide if len(stays) and not anywhere else -1,
    )


Span = tuple[str, int, int]


class Scanner:
    """The rules, compiled: scan(bytes) gives the base spans and all spans."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, base: int = BASE) -> None:
        self.rules, self.base = rules, base
        nodes = [read_pattern(r.pattern, r.any_case) for r in rules]
        self.all = compile_rules(nodes, anywhere=True)
        self.forward = [compile_rules([n], anywhere=True) for n in nodes]
        self.back = [compile_rules([backwards(n)], anywhere=False) for n in nodes]
        self.rank = {r.kind: k for k, r in enumerate(rules)} | {INNER: len(rules)}

    def runs(self, data: bytes) -> list[list[tuple[int, int]]]:
        """Of each rule the runs of bytes at which a match ends, first and last byte of a run. This is the one pass."""
        step, ends, s = self.all.step, self.all.ends, self.all.start
        hits = [(i, s) for i, c in enumerate(data.translate(self.all.classes)) if (s := step[s + c]) >= ends]
        out: list[list[tuple[int, int]]] = [[] for _ in self.rules]
        for i, s in hits:
            mask = self.all.rules[s]
            while mask:
                found = out[(mask & -mask).bit_length() - 1]
                if found and found[-1][1] == i - 1:
                    found[-1] = (found[-1][0], i)
                else:
                    found.append((i, i))
                mask &= mask - 1
        return out

    def begin(self, k: int, data: bytes, end: int, low: int) -> int | None:
        """The leftmost begin, not before ``low``, of a match of rule k whose last byte is ``end``."""
        a, best = self.back[k], None
        s = a.start
        for p in range(end, low - 1, -1):
            s = a.step[s + a.classes[data[p]]]
            if s == a.dead:
                break
            if s >= a.ends:
                best = p
        return best

    def first_end(self, k: int, data: bytes, low: int, high: int) -> int | None:
        """The first byte up to ``high`` that ends a match of rule k which begins at ``low`` or later."""
        a = self.forward[k]
        s = a.start
        for p in range(low, high + 1):
            s = a.step[s + a.classes[data[p]]]
            if s >= a.ends:
                return p
        return None

    def matches(self, k: int, data: bytes, runs: list[tuple[int, int]], tail: int = 1) -> list[tuple[int, int, int]]:
        """Leftmost matches of rule k without overlap: begin, first end, end. Shorter tails than ``tail`` are no matches."""
        low, out = 0, []
        for a, b in runs:
            at = self.begin(k, data, a, low)
            if at is None:  # the match that ends here begins in the one before
                a = self.first_end(k, data, low, b)
                at = None if a is None else self.begin(k, data, a, low)
            if at is not None and b - a + 1 >= tail:
                out.append((at, a, b + 1))
                low = b + 1
        return out

    def scan(self, data: bytes) -> tuple[list[Span], list[Span]]:
        """Base spans and all spans, (kind, start, end) in code points, end exclusive, by start and then kind as listed."""
        found: list[Span] = []
        inner: list[Span] = []
        for k, runs in enumerate(self.runs(data)):
            if not runs:
                continue
            rule = self.rules[k]
            mine = [(s, e) for s, a, e in self.matches(k, data, runs) if (e - a if rule.of_tail else e - s) >= rule.least]
            found += [(rule.kind, s, e) for s, e in mine]
            if rule.of_tail:
                have = set(mine)
                inner += [(INNER, s, e) for s, _, e in self.matches(k, data, runs, rule.least) if (s, e) not in have]
        if (found or inner) and not data.isascii():
            places = sorted({x for _, s, e in found + inner for x in (s, e)})
            point, count, last = {}, 0, 0
            for x in places:
                count += len(data[last:x].translate(None, FOLLOWING))
                point[x], last = count, x
            found, inner = [[(k, point[s], point[e]) for k, s, e in some] for some in (found, inner)]
        order = lambda x: (x[1], self.rank[x[0]], x[2])
        found.sort(key=order)
        return [x for x in found if self.rank[x[0]] < self.base], sorted(found + inner, key=order)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES, base: int = BASE) -> Scanner:
    return Scanner(rules, base)


def joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: int = BASE, keep: list[str] | None = None) -> DataFrame:
    """Adds n_<kind> long for each base kind, and base_spans and spans: ``kind:start:end`` joined by commas, code points.

    A null text counts as an empty one: no spans, counts of 0. Texts are read whole, whatever their length, byte by byte
    with one state, so memory does not grow with what is found before. Repeated rows and ids are rows of their own. Input
    columns of the added names are replaced; others pass through, or only those that keep names. No rows give none.
    """
    compiled = scanner(rules, base)
    counts = [f"n_{r.kind}" for r in rules[:base]]
    made = StructType()
    for name in counts:
        made = made.add(name, "long")
    made = made.add("base_spans", "string").add("spans", "string")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in [x.lower() for x in made.names]]
    raw = fresh(docs, "utf8")

    def work():
        def run(texts: list[bytes | None]) -> list:
            rows = []
            for data in texts:
                mine, every = compiled.scan(data or b"")
                kinds = [k for k, _, _ in mine]
                rows.append([*[kinds.count(r.kind) for r in rules[:base]], joined(mine), joined(every)])
            return [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in made.names]

        return run

    return map_columns(docs.withColumn(raw, column(text_col).cast("binary")), [raw], keep, made, work)


def mask_spans(text: str, spans: str) -> str:
    """The text with each span written as [kind]; where spans overlap, they are one, of the first kind."""
    out, at = [], 0
    held: list = []
    for part in spans.split(",") if spans else []:
        kind, s, e = part.split(":")
        if held and int(s) < held[-1][2]:
            held[-1][2] = max(held[-1][2], int(e))
        else:
            held.append([kind, int(s), int(e)])
    for kind, s, e in held:
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The table with every secret in its texts written as [kind]; nulls stay. Rows and all other columns are as they were."""
    compiled = scanner(rules)
    names = docs.columns
    new = fresh(docs, "masked")
    made = StructType().add(new, "string")

    def work():
        return lambda texts: [[t if t is None else mask_spans(t, joined(compiled.scan(t.encode())[1])) for t in texts]]

    out = map_columns(docs, [text_col], names, made, work)
    return out.select(*[column(new).alias(c) if c == text_col else column(c) for c in names])


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(documents(spark, sf_dir), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


#: The rules again as DuckDB writes them; classes in either case are spelt out, so that no letter beyond ASCII folds.
def _sql() -> str:
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    assign = either + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, "len(g[i]) >= 12"), ("access", r"AKIA[A-Z0-9]+", "len(m[i]) >= 18"), ("hex", "[0-9a-f]{16,}", "true")]
    kinds += [(r.kind, r.pattern, f"len(m[i]) >= {r.least}") for r in RULES[BASE:]] + [(INNER, assign.replace("]+)", "]{12,})"), "true")]
    parts = []
    for k, (kind, pattern, test) in enumerate(kinds):
        group = f"regexp_extract_all(t, '{pattern}', 2)" if kind == "assign" else "[]::varchar[]"
        parts.append(f"""
        select r, {k} as k, '{kind}' as kind, s, s + len(m[i]) as e from (
          select r, m, g, i, list_sum([len(x) for x in gaps[:i]]) + coalesce(list_sum([len(x) for x in m[:i - 1]]), 0) as s from (
            select r, m, g, gaps, unnest(range(1, len(m) + 1)) as i from (
              select r, regexp_extract_all(t, '{pattern}') as m, {group} as g, string_split_regex(t, '{pattern}') as gaps from docs)))
        where {test}""")
    return f"""
    with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    hits as ({' union all '.join(parts)}),
    spans as (select * from hits h where kind <> '{INNER}' or not exists (select 1 from hits a where a.kind = 'assign' and a.r = h.r and a.s = h.s and a.e = h.e)),
    lists as (
      select r, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c,
        string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k, e) filter (k < {BASE}) as base,
        string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k, e) as spans
      from spans group by r)
    select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from docs left join lists using (r)"""


SQL = _sql()
