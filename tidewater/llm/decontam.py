"""Benchmark decontamination by templates.

Words are canonicalised: numbers, names (capitalised words inside a sentence)
and units after a number become typed placeholders, the rest is lower-cased
without outer punctuation. Windows of ``WINDOW`` canonical words are hash-joined
with those of the benchmark. Matches of a document and an item on one alignment
are then checked for slot consistency: what fills a slot of the item is always
filled by the same thing in the document, and the other way round. So copies
and re-parameterised copies are found, while texts that only share a mould of
placeholders are not (a template needs ``LITERALS`` words that are none).
Windows with fewer plain words are hashed over the words themselves, without
case and outer punctuation, and so match only identical ones.

Windows are also made of joined words: a run of names is one placeholder, and so
is a number with its unit. So a slot may be filled with more or fewer words.

A document is contaminated by an item if windows on one alignment, all of them consistent,
or windows of joined words on one chain of rising places in both, which may leave
words out or put some in, cover ``COVER`` of the item's windows of that kind or
``RUN`` windows; templates alone may also cover ``COVER`` of the item's templates.

Defined results: null texts are empty and match nothing; items shorter than a
window form one window of their length; an item of numbers only is matched word for
word, but never if it is shorter than a window, as such numbers stand anywhere;
repeated rows of documents and items each count on their own; an empty table of
documents or items gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, scratch, small_join, stage, text_key, without_texts

WINDOW, LITERALS, COVER, RUN = 8, 4, 0.5, 13
CACHE = 300_000
#: Words whose windows are made at once.
BLOCK = 100_000
#: Factors of the words of a window, and of its width.
_FACTORS = mix(np.arange(1, WINDOW + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Benchmark windows up to which executors filter by them before the join.
FILTER_WINDOWS = 2_000_000
#: Units.
UNITS = frozenset("mm cm m km mg g kg t ml l s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years km/h mph percent % $ € £ dollars euros cents meters metres meter metre kilometers kilometres miles mile feet foot inches inch grams gram kilograms kilogram liters litres litre liter pounds pound ounces ounce degrees degree".split())
_NUMBER = re.compile(r"[$€£]?[+-]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%|[a-z]{1,4})?", re.IGNORECASE)
_OUTER = "\"'`.,;:!?()[]{}<>«»“”‘’*_"
_LEADS = frozenset("$€£+-0123456789")
NUM, NAME, UNIT = 1, 2, 3  # ids of the placeholders
_IS_NUMBER, _IS_NAME, _ENDS, _IS_UNIT = 1, 2, 4, 8  # bits of a word's kind


class Canon:
    """Canonical word ids of texts; what a raw word is gets remembered."""

    def __init__(self):
        self.known: defaultdict[str, int] = defaultdict(count().__next__)
        self.plain, self.kinds = array("q"), bytearray()

    def learn(self, raw: list[str]) -> None:
        cores = [w if w.isalpha() else w.strip(_OUTER) or w for w in raw]
        low = [c.lower() for c in cores]
        number = np.array([c[0] in _LEADS and _NUMBER.fullmatch(c) is not None for c in cores])
        name = np.array([c[0].isupper() and c[0].isalpha() for c in cores]) & ~number
        ends = np.array([not w[-1].isalnum() and w.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":") for w in raw])
        unit = np.array([w in UNITS for w in low])
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, low), np.uint64, len(low))
        self.plain.frombytes((hashes % np.uint64((1 << 63) - 4) + np.uint64(4)).tobytes())
        self.kinds += (number * _IS_NUMBER + name * _IS_NAME + ends * _ENDS + unit * _IS_UNIT).astype(np.uint8).tobytes()

    def ids(self, words: list[str], head: np.ndarray, inside_sentence: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Canonical ids, and ids of the words themselves, of texts after each other; ``head`` marks their first words."""
        if len(self.known) > CACHE:
            self.__init__()
        n = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > n:
            self.learn(list(islice(reversed(self.known), len(self.known) - n))[::-1])
        itself, kinds = np.frombuffer(self.plain, dtype=np.int64)[at], np.frombuffer(self.kinds, dtype=np.uint8)[at]
        before = np.where(head, 0 if inside_sentence else _ENDS, np.concatenate((kinds[:1], kinds[:-1])))
        out = np.where((kinds & _IS_NAME > 0) & (before & _ENDS == 0), NAME, itself)
        out[kinds & _IS_NUMBER > 0] = NUM
        out[(before & _IS_NUMBER > 0) & (kinds & _IS_UNIT > 0)] = UNIT
        return out, itself


class Wanted:
    """Benchmark windows, met by a table of the leading bits of their hashes first."""

    def __init__(self, hashes: np.ndarray):
        bits = min(24, max(10, (32 * len(hashes)).bit_length()))
        self.hashes, self.shift, self.table = hashes, np.uint64(64 - bits), np.zeros(1 << bits, dtype=bool)
        self.table[(hashes >> self.shift).astype(np.int64)] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        own = hashes[at]
        return at[self.hashes[np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)] == own]


def _sums(ids: np.ndarray, widths: list[int], seed: int) -> dict[int, np.ndarray]:
    """Hashes of all windows of each width; a wider window goes on from the narrower one."""
    words, sums, out = mix(ids.astype(np.uint64)), np.zeros(len(ids), dtype=np.uint64), {}
    for j in range(min(max(widths), len(ids))):
        sums[: len(ids) - j] += words[j:] * _FACTORS[j]
        if j + 1 in widths:
            out[j + 1] = mix(sums[: len(ids) - j] + _FACTORS[-1:] * np.uint64(j + 1 + seed))
    return out


def windows(ids: np.ndarray, itself: np.ndarray, widths: list[int]):
    """For every width the hash of every window of as many words, and whether it has plain
    words enough for a template; the others are hashed over the words themselves."""
    plain = np.concatenate(([0], np.cumsum(ids > UNIT)))
    templates, exact = _sums(ids, widths, 0), _sums(itself, widths, 256)
    for width in templates:
        template = plain[width:] - plain[:-width] >= min(LITERALS, width)
        yield width, np.where(template, templates[width], exact[width]), template


class Joined:
    """The words of texts with runs of names, and numbers with their units, as one word each."""

    def __init__(self, ids: np.ndarray, itself: np.ndarray, head: np.ndarray):
        names = ids == NAME
        starts = ~((ids == UNIT) | (names & np.concatenate(([False], names[:-1])) & ~head))
        self.at = np.flatnonzero(starts)
        self.ends = np.append(self.at[1:], len(ids))
        sizes = self.ends - self.at
        self.long = np.concatenate(([0], np.cumsum(sizes > 1)))  # joined words of several before each
        self.number = np.cumsum(starts) - 1  # joined word that each word is in
        self.starts, self.ids, self.itself = starts, ids[self.at], itself[self.at].astype(np.uint64)
        if len(self.at) < len(ids):
            factors = mix(np.arange(1, sizes.max() + 1, dtype=np.uint64))
            self.itself = np.add.reduceat(itself.astype(np.uint64) * factors[np.arange(len(ids)) - np.repeat(self.at, sizes)], self.at)

    def several(self, first: np.ndarray, width: int) -> np.ndarray:
        """Whether windows, by their first joined word, have a word joined of several."""
        return self.long[first + width] > self.long[first]

    def slots(self, words: list[str], first: int, width: int) -> list[str]:
        out = []
        for t in range(first, first + width):
            if self.ids[t] <= UNIT:
                out.append(("" if self.ids[t] == NUM else " ").join(w.strip(_OUTER).lower() for w in words[self.at[t] : self.ends[t]]))
        return out


def _slots(words: list[str], ids: np.ndarray, at: int, width: int) -> list[str]:
    return [words[i].strip(_OUTER).lower() for i in range(at, at + width) if ids[i] <= UNIT]


def _places(words: list[str], head: np.ndarray, ids: np.ndarray, itself: np.ndarray, raw: list[int], joined: list[int] | None, wanted: Wanted | None):
    """The windows (only wanted hashes) of texts after each other, each with the number of its text. ``joined`` None:
    windows of joined words are as wide as those of words, or as the one text."""
    j, text = Joined(ids, itself, head), np.cumsum(head) - 1
    first = np.flatnonzero(head)
    joined = [min(WINDOW, len(j.at))] if joined is None else joined

    def of(hashes, template, good, is_raw, is_joined, places, slots):
        for k in good:
            yield int(text[places[k]]), {"hash": int(hashes[k].astype(np.int64)), "template": bool(template[k]), "raw": is_raw, "joined": bool(is_joined(k)), "place": int(places[k] - first[text[places[k]]]), "slots": slots(k), "width": None}

    for width, hashes, template in windows(ids, itself, sorted({*raw, *joined})):
        good = np.arange(len(hashes)) if wanted is None else wanted.among(hashes)
        good = good[text[good] == text[good + width - 1]]

        def alone(k, w=width):
            """The window is one of joined words too, none of them joined of several."""
            return w in joined and j.starts[k] and j.number[k] + w <= len(j.at) and not j.several(j.number[k], w)

        good = good if width in raw else good[[bool(alone(k)) for k in good]] if len(good) else good
        yield from of(hashes, template, good, width in raw, alone, np.arange(len(hashes)), lambda k, w=width: _slots(words, ids, k, w))
    if len(j.at) < len(words):
        for width, hashes, template in windows(j.ids, j.itself, sorted(joined)):
            good = np.arange(len(hashes)) if wanted is None else wanted.among(hashes)
            good = good[(text[j.at[good]] == text[j.at[good + width - 1]]) & j.several(good, width)]
            yield from of(hashes, template, good, False, lambda k: True, j.at, lambda k, w=width: j.slots(words, k, w))


WINDOWS = "array<struct<hash:long,template:boolean,raw:boolean,joined:boolean,place:int,slots:array<string>,width:int>>"
COUNTS = ["n", "whole", "joined_n", "joined_whole"]
_WINDOW = pa.struct([("hash", pa.int64()), ("template", pa.bool_()), ("raw", pa.bool_()), ("joined", pa.bool_()), ("place", pa.int32()), ("slots", pa.list_(pa.string())), ("width", pa.int32())])


def _item_windows(canon: Canon, words: list[str]) -> tuple[list[dict], list[int]]:
    """The windows of an item, of WINDOW words or its length, and COUNTS of them."""
    if not words:
        return [], [0] * 4
    head = np.arange(len(words)) == 0
    ids, itself = canon.ids(words, head)
    if len(words) < WINDOW and (ids == NUM).all():
        return [], [0] * 4

    def own(ids):
        raw = min(WINDOW, len(words))
        return [{**w, "width": raw if w["raw"] else min(WINDOW, len(Joined(ids, itself, head).at))} for _, w in _places(words, head, ids, itself, [raw], None, None)]

    found = own(ids)
    counts = [sum(w[kind] and (w["template"] or whole) for w in found) for kind in ("raw", "joined") for whole in (False, True)]
    if (other := canon.ids(words, head, inside_sentence=True)[0])[0] != ids[0]:
        # an item may be quoted inside a sentence, where its first word looks like a name
        found = [w for w in own(other) if w["place"] == 0] + found
    return found, counts


def _item_rows(items: DataFrame) -> DataFrame:
    """Rows of items with ``found``, their windows, and COUNTS, the numbers of templates and of all windows, of words and of joined words."""

    def run(batches):
        canon = Canon()
        for b in batches:
            rows = [_item_windows(canon, (t.as_py() or "").split()) for t in b.column(2)]
            kept = b.select([0, 1])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([c[k] for _, c in rows], pa.int32()) for k in range(4)), pa.array([f for f, _ in rows], pa.list_(_WINDOW))], names=["item_row", "item_id", *COUNTS, "found"])

    schema = ", ".join(["item_row long", "item_id long", *(f"{c} int" for c in COUNTS), f"found {WINDOWS}"])
    return items.select("item_row", "item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _text_rows(frame: DataFrame, keys: list[str], widths: list[int], hashes: np.ndarray | None) -> DataFrame:
    """Rows of ``keys`` with ``found``: the windows of the text (only those of ``hashes``), where there are any.
    Windows are made of BLOCK words at once, of as many texts as these are."""
    types = {f.name: f.dataType.simpleString() for f in frame.schema if f.name in keys}

    def run(batches):
        canon, wanted = Canon(), None if hashes is None else Wanted(hashes)

        def block(b, rows, words, sizes):
            head = np.zeros(len(words), dtype=bool)
            head[np.cumsum([0, *sizes[:-1]])] = True
            found: dict[int, list[dict]] = {}
            for text, w in _places(words, head, *canon.ids(words, head), widths, widths, wanted):
                found.setdefault(rows[text], []).append(w)
            kept = b.select(list(range(len(keys)))).take(pa.array(list(found), pa.int64()))
            return pa.RecordBatch.from_arrays([*kept.columns, pa.array(list(found.values()), pa.list_(_WINDOW))], names=[*keys, "found"])

        for b in batches:
            rows, words, sizes = [], [], []
            for i, t in enumerate(b.column(len(keys))):
                if own := (t.as_py() or "").split():
                    rows.append(i)
                    words += own
                    sizes.append(len(own))
                if len(words) >= BLOCK:
                    yield block(b, rows, words, sizes)
                    rows, words, sizes = [], [], []
            if words:
                yield block(b, rows, words, sizes)

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"found {WINDOWS}"])
    return frame.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _covered(windows: list[dict], n: int) -> tuple[int, int, bool] | None:
    """(matched, n, substituted) if the windows fill slots consistently and cover enough of an item's ``n``."""
    matched = len({w["b_place"] for w in windows})
    if not n or (matched < COVER * n and matched < RUN):
        return None
    # equal words fill equal slots, whatever the place makes of them
    pairs = {x for w in windows for x in zip(w["b_slots"], w["slots"] if w["template"] else w["b_slots"])}
    if not len(pairs) == len({b for b, _ in pairs}) == len({d for _, d in pairs}):
        return None
    return matched, n, any(b != d for b, d in pairs)


def _chain(windows: list[dict]) -> list[dict]:
    """A longest chain of windows whose places rise in the item and in the document."""
    order = sorted(windows, key=lambda w: (w["place"], -w["b_place"]))
    tails, last, before = [], [], []
    for k, w in enumerate(order):
        at = bisect_left(tails, w["b_place"])
        before.append(last[at - 1] if at else -1)
        tails[at : at + 1], last[at : at + 1] = [w["b_place"]], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(order[k])
        k = before[k]
    return out[::-1]


def _ascents(windows: list[dict]) -> list[list[dict]]:
    """The windows cut where the place in the item falls, as between two copies of it."""
    out: list[list[dict]] = []
    for w in sorted(windows, key=lambda w: (w["place"], w["b_place"])):
        if not out or w["b_place"] < out[-1][-1]["b_place"]:
            out.append([])
        out[-1].append(w)
    return out


def _verdict(windows: list[dict], n: int, whole: int, joined_n: int, joined_whole: int) -> tuple[int, int, bool] | None:
    """The best cover of one item by one document."""
    shifts: dict[int, list[dict]] = {}
    for w in windows:
        if w["raw"] and w["b_raw"]:
            shifts.setdefault(w["place"] - w["b_place"], []).append(w)
    tries = [(on, m) for every in shifts.values() for on, m in ((every, whole), ([w for w in every if w["template"]], n))]
    joined = [w for w in windows if w["joined"] and w["b_joined"]]
    for every, m in ((joined, joined_whole), ([w for w in joined if w["template"]], joined_n)):
        tries += [(_chain(on), m) for on in (every, *_ascents(every))]
    found = [(c[0] / c[1], c[0], on[0]["b_place"] - on[0]["place"], c) for on, m in tries if on and (c := _covered(on, m))]
    return max(found)[3] if found else None


def _verdicts_of(carry: tuple[str, ...]):
    def run(batches):
        for b in batches:
            take, out = [], []
            for i in range(b.num_rows):
                v = _verdict(b["windows"][i].as_py(), *(b[c][i].as_py() for c in COUNTS))
                if v:
                    take.append(i)
                    out.append(v)
            kept = b.select([*carry, "row", "doc_id", "item_id"]).take(pa.array(take, pa.int64()))
            matched, n, substituted = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(matched, pa.int64()), pa.array(n, pa.int64()), pa.array([m / x for m, x, _ in out], pa.float64()), pa.array(substituted, pa.bool_())], names=[*carry, "row", "doc_id", "item_id", "matched", "n_windows", "coverage", "substituted"])

    return run


def contaminated_rows(rows: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``contaminations`` of documents (row, doc_id, text), with their row and the columns of ``carry``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item_row", F.monotonically_increasing_id())
    own = _item_rows(items)
    parts = [F.col(f"w.{c}").alias(f"b_{c}") for c in ("hash", "raw", "joined", "place", "slots", "width")]
    bench = stage(own.select("item_row", "item_id", *COUNTS, F.explode("found").alias("w")).select("item_row", "item_id", *COUNTS, *parts), "bench-windows")
    widths = sorted({WINDOW} | {r[0] for r in bench.select("b_width").distinct().collect()})  # at most WINDOW values
    n = bench.count()
    wanted = None
    if n <= FILTER_WINDOWS:
        wanted = np.unique(np.array([r[0] for r in bench.select("b_hash").distinct().collect()], dtype=np.int64).view(np.uint64))
    rows = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    found = _text_rows(rows, ["row", "doc_id", *carry], widths, wanted).select("row", "doc_id", *carry, F.explode("found").alias("w"))
    met = small_join(found, bench, F.col("w.hash") == F.col("b_hash"), rows=n)
    each = F.struct("b_place", "w.place", "w.template", "b_raw", "w.raw", "b_joined", "w.joined", "b_slots", "w.slots")
    return met.groupBy("row", "doc_id", *carry, "item_row", "item_id", *COUNTS).agg(F.collect_list(each).alias("windows")).mapInArrow(_verdicts_of(carry), "".join(f"{c} string, " for c in carry) + "row long, doc_id long, item_id long, matched long, n_windows long, coverage double, substituted boolean")


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and item that contaminates it: doc_id, item_id,
    matched, n_windows, coverage, substituted (a slot is filled otherwise)."""
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return contaminated_rows(rows, benchmark).drop("row")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without contamination, all columns. Each row is judged by its own text, whatever its id."""
    rows = docs.select("doc_id", "text", text_key().alias("key")).withColumn("row", F.monotonically_increasing_id())
    with scratch(docs.sparkSession) as keep:
        bad = keep(stage(contaminated_rows(rows, benchmark, ("key",)).select("key").distinct(), "contaminated"))
    return without_texts(docs, bad)
