"""Secret scans with one automaton for all rules.

Rule regexes become non-deterministic automata over bytes, and these deterministic
ones by subset construction, minimised by partition refinement. One automaton holds
what every rule looks for at least; its transition arrays are walked once per text, and
every step tells which rules have just matched. Texts without a match, nearly all of
them, cost that one pass. In the others a reversed automaton of all rules, walked from
the end, tells where matches start, and from each start that is not within the match
before, the rule's own automaton tells where the longest match ends, and where the part
begins whose length counts. So a match is the leftmost, and the longest from there.

Defined results: null text is empty; no secrets give zero counts, the digest of
the empty string and an empty span list; repeated rows stay repeated; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    scan: str  # contained in every span that counts
    spans: str  # leftmost non-overlapping matches
    before: str = ""  # the beginning of a match whose characters are not counted
    least: int = 1  # characters counted


_NAMED = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: The kinds, patterns and least lengths. The first three are the base kinds.
RULES = (
    Rule("assign", _NAMED + r"[A-Za-z0-9+/_.=-]{8}", _NAMED + r"[A-Za-z0-9+/_.=-]+", _NAMED, 8),
    Rule("access", r"AKIA[A-Z0-9]{12}", r"AKIA[A-Z0-9]+", "", 16),
    Rule("hex", r"[0-9a-f]{32}", r"[0-9a-f]+", "", 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]", r"hooks\.slack\.com/services/[A-Za-z0-9/]+"),
)
BASE = 3
ALL = frozenset(range(256))


class Nfa:
    """Moves over byte sets and over nothing. ``add`` puts a regex between two new states:
    literals, classes, (groups), (?i:groups), alternatives, and ? * + {n} {n,m} (n of 1 or more) behind them."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        first = self.state()
        last, at = self._branches(pattern, 0, first, False)
        if at != len(pattern):
            raise ValueError(f"{pattern}: cannot be read from {at} on")
        return first, last

    def _branches(self, p: str, at: int, first: int, fold: bool) -> tuple[int, int]:
        last = self.state()
        while True:
            here = first
            while at < len(p) and p[at] not in "|)":
                here, at = self._repeated(p, at, here, fold)
            self.free[here].append(last)
            if at >= len(p) or p[at] == ")":
                return last, at
            at += 1

    def _repeated(self, p: str, at: int, first: int, fold: bool) -> tuple[int, int]:
        begin = self.state()
        self.free[first].append(begin)
        last, end = self._one(p, at, begin, fold)
        sign = p[end : end + 1]
        if sign == "{":
            close = p.index("}", end)
            low, _, high = p[end + 1 : close].partition(",")
            for _ in range(int(low) - 1):
                last, _ = self._one(p, at, last, fold)
            out = self.state()
            self.free[last].append(out)
            for _ in range(int(high or low) - int(low)):
                last, _ = self._one(p, at, last, fold)
                self.free[last].append(out)
            return out, close + 1
        if sign and sign in "?*+":
            out = self.state()
            self.free[last].append(out)
            if sign in "*+":
                self.free[last].append(begin)
            if sign in "?*":
                self.free[begin].append(out)
            return out, end + 1
        return last, end

    def _one(self, p: str, at: int, first: int, fold: bool) -> tuple[int, int]:
        if p[at] == "(":
            begin = at + (4 if p.startswith("(?i:", at) else 1)
            last, end = self._branches(p, begin, first, fold or begin == at + 4)
            if end >= len(p):
                raise ValueError(f"{p}: a group is not closed")
            return last, end + 1
        found, end = _class(p, at) if p[at] == "[" else _byte(p, at)
        if fold:
            found = {ord(c) for x in found for c in (chr(x).lower(), chr(x).upper() if x < 128 else chr(x))}
        last = self.state()
        self.moves[first].append((frozenset(found), last))
        return last, end


def _byte(p: str, at: int) -> tuple[set, int]:
    if p.startswith("\\x", at):
        return {int(p[at + 2 : at + 4], 16)}, at + 4
    if p[at] in ".^$?*+{" or ord(p[at]) > 127 or p[at] == "\\" and p[at + 1].isalnum():
        raise ValueError(f"{p}: rules can't use {p[at : at + 2]}")
    return ({ord(p[at + 1])}, at + 2) if p[at] == "\\" else ({ord(p[at])}, at + 1)


def _class(p: str, at: int) -> tuple[set, int]:
    found, at, negate = set(), at + 1, p[at + 1] == "^"
    at += negate
    while p[at] != "]":
        if p[at] in ".^$?*+{":
            low, at = {ord(p[at])}, at + 1
        else:
            low, at = _byte(p, at)
        if p[at] == "-" and p[at + 1] != "]":
            high, at = _byte(p, at + 1)
            low = set(range(min(low), max(high) + 1))
        found |= low
    return set(ALL) - found if negate else found, at + 1


def subset_construction(patterns: Sequence[str], anchored: bool = False, backwards: bool = False) -> tuple[list[list[int]], list[int]]:
    """Transition arrays (256 wide) and per state the bits of the patterns that have just matched; -1 where
    nothing can match any more. Patterns are looked for at every place, or ``anchored`` at the first one;
    ``backwards`` reads the text from its end, and a pattern has matched at its start."""
    nfa = Nfa()
    pairs = [nfa.add(p) for p in patterns]
    if backwards:
        moves, free = [[] for _ in nfa.moves], [[] for _ in nfa.free]
        for x, own in enumerate(nfa.moves):
            for s, t in own:
                moves[t].append((s, x))
        for x, own in enumerate(nfa.free):
            for t in own:
                free[t].append(x)
        nfa.moves, nfa.free, pairs = moves, free, [(b, a) for a, b in pairs]
    starts, ends = {a for a, _ in pairs}, {b: 1 << i for i, (_, b) in enumerate(pairs)}

    def closed(states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    # Bytes that no rule tells apart share a column.
    sets = list({s for moves in nfa.moves for s, _ in moves})
    column: dict[tuple, int] = {}
    of = [column.setdefault(tuple(b in s for s in sets), len(column)) for b in range(256)]
    sample = [of.index(c) for c in range(len(column))]
    first = closed(starts)
    number, table, accepts, todo = {first: 0}, [], [], [first]
    while todo:
        states = todo.pop(0)
        accepts.append(sum(bit for x, bit in ends.items() if x in states) if states else -1)
        row = []
        for b in sample:
            to = closed({t for x in states for s, t in nfa.moves[x] if b in s} | (set() if anchored else starts))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    table, accepts = minimise(table, accepts)
    return [[row[of[b]] for b in range(256)] for row in table], accepts


def minimise(table: list[list[int]], accepts: list[int]) -> tuple[list[list[int]], list[int]]:
    """Merge states that accept alike and go to merged states alike; state 0 stays the start."""
    group = accepts
    while True:
        names: dict[tuple, int] = {}
        new = [names.setdefault((group[i], *(group[t] for t in row)), len(names)) for i, row in enumerate(table)]
        if len(names) == len(set(group)):
            break
        group = new
    names = {}
    group = [names.setdefault(g, len(names)) for g in group]
    keep = {g: i for i, g in reversed(list(enumerate(group)))}
    return [[group[t] for t in table[keep[g]]] for g in range(len(names))], [accepts[keep[g]] for g in range(len(names))]


@lru_cache(maxsize=64)
def automaton(patterns: tuple[str, ...], anchored: bool = False, backwards: bool = False) -> list[list]:
    """Linked transition arrays: entry 0-255 is the next array, 256 the bits just matched."""
    table, accepts = subset_construction(patterns, anchored, backwards)
    rows: list[list] = [[] for _ in table]
    for row, moves, bits in zip(rows, table, accepts):
        row.extend([rows[t] for t in moves])
        row.append(bits)
    return rows


def scan(data: bytes, start: list) -> int:
    """Bits of all rules that match somewhere, from one pass over the bytes."""
    row, found = start, 0
    for c in data:
        row = row[c]
        if row[256]:
            found |= row[256]
    return found


def longest(data: bytes, at: int, start: list) -> int:
    """End of the longest match that starts at ``at``; ``at`` itself if there is none."""
    row, end = start, at
    for i in range(at, len(data)):
        row = row[data[i]]
        if row[256]:
            if row[256] < 0:
                break
            end = i + 1
    return end


def resolve(text: str, bits: int, rules: Sequence[Rule]) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end in code points) of the rules of ``bits``, by start, then rule."""
    data = text.encode("utf-8")
    hit = [i for i in range(len(rules)) if bits >> i & 1]
    if not hit:
        return []
    row = automaton(tuple(rules[i].spans for i in hit), backwards=True)[0]
    starts: list[list[int]] = [[] for _ in hit]
    for at in range(len(data) - 1, -1, -1):
        row = row[data[at]]
        if row[256]:
            for k, found in enumerate(starts):
                if row[256] >> k & 1:
                    found.append(at)
    spans = []
    for i, found in zip(hit, starts):
        whole, before, last = automaton((rules[i].spans,), anchored=True)[0], automaton((rules[i].before,), anchored=True)[0], 0
        for at in reversed(found):
            if at >= last:
                last = longest(data, at, whole)
                if last - longest(data, at, before) >= rules[i].least:
                    spans.append((at, i, last))
    spans.sort()
    if text.isascii():
        return [(rules[i].kind, s, e) for s, i, e in spans]
    place, count = {}, 0
    cuts = sorted({x for s, _, e in spans for x in (s, e)})
    for a, b in zip([0, *cuts], cuts):
        count += len(data[a:b].decode("utf-8"))
        place[b] = count
    return [(rules[i].kind, place[s], place[e]) for s, i, e in spans]


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, base: int = BASE) -> DataFrame:
    """Per document: counts and digest of the first ``base`` rules, and all spans as kind:start:end by start, then rule."""
    rules = tuple(rules)
    names = [f"n_{r.kind}" for r in rules[:base]]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_sha256", pa.string()), ("spans", pa.string())])
    kinds = [r.kind for r in rules[:base]]

    def row(text: str, start: list) -> list:
        found = resolve(text, scan(text.encode("utf-8"), start), rules)
        own = [s for s in found if s[0] in kinds]
        joined = ",".join("%s:%d:%d" % s for s in own)
        return [*(sum(s[0] == k for s in own) for k in kinds), hashlib.sha256(joined.encode()).hexdigest(), ",".join("%s:%d:%d" % s for s in found)]

    def run(batches):
        start = automaton(tuple(r.scan for r in rules))[0]
        for b in batches:
            rows = [row(t or "", start) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[] for _ in range(base + 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names), "base_sha256 string", "spans string"]))
