"""N-gram Jaccard join by prefixes of single tokens and token combinations.

A document's tokens are its distinct five-word shingles. Equal token sets are one
class and only one representative of it goes on. All tokens have one order, rare
ones first, frequent ones (FREQUENT_DF documents or more) last.

*Signatures.* Of two sets that link, each has at most n - ceil(4n/5) tokens that the
other lacks. So their first shared token stands in the first n - ceil(4n/5) + 1 of
each; where it is rare, it is a signature of both. Where it is frequent, all shared
tokens are and each set lacks a partner for its r rare ones: with r above
n - ceil(4n/5) there is no such pair, and the set has no combinations. Otherwise the
prefix is extended to hold the first L = (k-1) (floor(n/4) - r) + k shared tokens of
both. The two sets differ in at most floor(n/4) - r frequent tokens, each of them parts at most k-1
of the L-k+1 runs of k neighbouring shared tokens, so at least one run of k neighbours
is whole in both. Frequent tokens are therefore indexed by combinations of k
neighbours in the order, which puts the less frequent ones first; k is COMBINE, and one
more for runs that begin with a token of HOT_DF documents or more, where the prefix is
extended for the larger k (sets that share four tokens only may have no whole run of three, so sets below
SMALL tokens have both kinds). Rare tokens are indexed singly, and a document has fewer
signatures than tokens.

*Lists of combinations* are cut by size, each into sets of one class and of the next,
classes growing by RATIO, and rid of sets that cannot link there: the smaller set of a
pair has at most n - ceil(8n/9) rare tokens, so a list without such a set goes, and so do sets
below the smallest or far above the largest of them. Pages of one template that do not
link for what is their own meet in no list.

*Homes.* The sets of a signature's list get a home, the first of them by size and row.
Lists of near copies nearly all begin with the same set, so a set has few homes
although it has many signatures. A home that lies within an earlier one goes. A pair is
tested in its first common home only, so each pair once, and no pair of a list is ever
written or joined: whole texts go to their homes, and a task multiplies the incidence
matrices of the sets it holds. Homes of more than BLOCK sets are cut into blocks, each
pair of blocks being a unit of its own, so that no task holds a large group. The
arithmetic of a group grows with the pairs that are to be counted in it, and a set of a
group of m goes to m / BLOCK units; each unit returns a set's number of links and one
linked set, never pairs.

Results are exact up to collisions of 64-bit shingle hashes.

Defined results: a document without words (null, empty, white space) has an empty set,
is its own component and has no links; with fewer than five words its one token is the
whole sequence; rows with equal ids are judged each by its text, and each reports the
component of that text; a null id is never the smallest of others. ``n_links`` counts
the other rows that a row links with, equal texts included. Extra columns are carried
aside and cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, mix, scratch, shingle_sets, small_join, stage, without

PART, WHOLE = 80, 100  # link when WHOLE * intersection >= PART * union
COMBINE = 2  # k, the tokens of a combination; one more where it begins with a token of HOT_DF documents or more
HOT_DF = 1024
SMALL = 8  # tokens below which a set has every run of k too: two such sets may share no longer run
RATIO = 1.26  # of the classes of sizes; above WHOLE / PART, so that sets which link are of one class or of neighbours
#: Documents from which a token is frequent, and tokens in that class at most; both cost work, not results.
FREQUENT_DF, FREQUENT = 16, 2_000_000
LIST = 32  # sets of a list up to which all its pairs are tried by their places
BLOCK, BLOCK_TOKENS = 1024, 1 << 20  # sets and tokens of a block of a home
LOOKUP_ROWS = 200_000  # of a side that is broadcast: the driver holds some of these at a time, each row about 200 bytes
EARLIER = 4  # earlier homes that weigh as a row


def most_missing(n: int) -> int:
    """Tokens of a set of ``n`` that a set it links with can lack."""
    return n - -(-PART * n // WHOLE)


def prefix_length(n: int) -> int:
    """Tokens that hold the first shared one."""
    return min(n, most_missing(n) + 1)


def _slices(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


# --- frequent tokens ----------------------------------------------------------


def _pack(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending ids as differences, and counts, one plane of bytes after the other, which packs well."""
    return b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (np.diff(ids, prepend=np.uint32(0)), n))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, n = (x.T.copy().view("<u4").ravel() for x in np.frombuffer(data, np.uint8).reshape(2, 4, -1))
    return np.cumsum(gaps, dtype=np.uint32), n


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.uint32)
    ids, own = np.unique(ids, return_inverse=True)
    n = np.concatenate([x for _, x in held]) if held else np.zeros(0)
    return ids, np.bincount(own, weights=n, minlength=len(ids)).astype(np.int64)


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """The sorted ids of ``frequencies``."""
    return frequencies(docs)[0]


def frequencies(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Upper halves of tokens that FREQUENT_DF documents or more share, sorted, and the
    binary logarithms of their numbers of documents, rounded down; the
    FREQUENT most frequent ones where there are more. The classes decide between single
    tokens and combinations, and any choice gives the same links. Tokens are counted over
    all documents: each batch sends its distinct ids with counts, cut into buckets by id."""
    bits = int(np.clip(np.log2(max(1, docs.count()) / 500 + 1), 4, 20))
    shift = np.uint32(32 - bits)

    def deal(batches):
        for b in batches:
            sets = [(s >> np.uint64(32)).astype(np.uint32) for part in _slices([b]) for s in shingle_sets(part.column(0).to_pylist())]
            ids, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint32), return_counts=True)
            cuts = np.flatnonzero(np.diff(ids >> shift)) + 1
            parts = [x for x in zip(np.split(ids, cuts), np.split(n, cuts)) if len(x[0])]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[0] >> shift) for x, _ in parts], pa.int32()), pa.array([_pack(*x) for x in parts], pa.binary())], names=["bucket", "ids"])

    def often(held):
        ids, n = _added(held)
        return pa.RecordBatch.from_arrays([pa.array(ids[n >= FREQUENT_DF], pa.int64()), pa.array(n[n >= FREQUENT_DF], pa.int64())], names=["id", "n"])

    def count(batches):
        held, size, of = [], 0, None
        for b in batches:
            for bucket, ids in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != of:
                    yield often(held)
                    held, size, of = [], 0, bucket
                held.append(_unpack(ids.as_py()))
                size += len(held[-1][0])
                if size > 1 << 22:  # what repeats is added up early
                    held = [_added(held)]
                    size = len(held[0][0]) // 2
        yield often(held)

    dealt = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(deal, "bucket int, ids binary")
    def pack(batches):
        for b in batches:
            level = np.log2(b.column(1).to_numpy()).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (b.column(0).to_numpy().astype("<u4").tobytes(), level.tobytes())], names=["ids", "level"])

    counts = stage(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "id long, n long"), "jaccard-counts")
    rows = counts.orderBy(F.desc("n"), "id").limit(FREQUENT) if counts.count() > FREQUENT else counts
    packed = rows.select("id", "n").mapInArrow(pack, "ids binary, level binary").collect()  # five bytes a token, not a row
    ids, level = np.frombuffer(b"".join(r["ids"] for r in packed), "<u4"), np.frombuffer(b"".join(r["level"] for r in packed), np.uint8)
    order = np.argsort(ids)
    return ids[order], level[order]


# --- signatures ---------------------------------------------------------------


def signatures(tokens: np.ndarray, frequent: np.ndarray, k: int = COMBINE, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rare tokens in whose place the first shared token can stand, in order, and hashes
    of k or k + 1 neighbouring frequent tokens of the extended prefix; ``level`` has the logarithms of
    ``frequencies``. Fewer than four tokens link with equal sets only."""
    none = np.zeros(0, dtype=np.uint64)
    n = len(tokens)
    if n < 4:
        return none, none
    late, at = _is_frequent(tokens, frequent)
    rare, often = tokens[~late], tokens[late]
    singles, spare, apart = rare[: prefix_length(n)], most_missing(n) - len(rare), n // 4 - len(rare)
    if spare < 0:
        return singles, none
    hot = np.zeros(len(often), dtype=bool)
    if level is not None:
        order = np.argsort(level[at[late]], kind="stable")
        often, hot = often[order], level[at[late]][order] >= np.log2(HOT_DF)
    runs = often[: spare + (k - 1) * apart + k]
    if hot[: len(runs)].any():
        runs = often[: spare + k * apart + k + 1]
    if len(runs) < k:
        return singles, none
    keys = np.full(len(runs) - k + 1, k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + runs[j : j + len(keys)])
        longer = mix(keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + runs[k:])
    hot = hot[: len(keys)]
    return singles, np.concatenate((keys if n < SMALL else keys[~hot], longer[hot[:-1]]))


def _is_frequent(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are frequent, and the places of those in the sorted ids."""
    if not len(frequent):
        return np.zeros(len(tokens), dtype=bool), np.zeros(len(tokens), dtype=np.int64)
    high = (tokens >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(frequent, high), len(frequent) - 1)
    return frequent[at] == high, at


def token_sets(rows: DataFrame, frequent: np.ndarray, level: np.ndarray | None = None) -> DataFrame:
    """(row, doc_id, n, sig, singles, runs, early) of ``keyed`` documents, written: ``sig`` is a digest of a
    row's set; an ``early`` set has so few rare tokens that it can be the smaller one of a pair which shares none."""
    shared = rows.sparkSession.sparkContext.broadcast((frequent, level))

    def run(batches):
        for b in _slices(batches):
            sets = shingle_sets(b.column(2).to_pylist())
            frequent, level = shared.value
            keys = [signatures(s, frequent, level=level) for s in sets]
            early = [len(s) - int(_is_frequent(s, frequent)[0].sum()) < _early(len(s)) for s in sets]
            sigs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            lists = [pa.array([x[i].view(np.int64) for x in keys], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(sigs, pa.binary()), *lists, pa.array(early, pa.bool_())], names=["row", "doc_id", "n", "sig", "singles", "runs", "early"])

    texts = rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
    return stage(texts.mapInArrow(run, "row long, doc_id long, n int, sig binary, singles array<long>, runs array<long>, early boolean"), "jaccard-sets")


# --- homes --------------------------------------------------------------------


def _early(n: int) -> int:
    """First places of a set of ``n`` at which a token shared with a set as large or
    larger can be their first: behind them too few tokens are left for a link."""
    return n - -(-2 * PART * n // (PART + WHOLE)) + 1


def _tried(part: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of a short list (n, place, row) that by size and place can have here their first shared token with another."""
    good = set()
    for i, (n, p, _) in enumerate(part):
        for j in range(i):
            m, q, _ = part[j]
            if PART * n <= WHOLE * m and q < _early(m) and min(n - p, m - q) * (PART + WHOLE) >= (n + m) * PART:
                good |= {i, j}
    return [part[i] for i in sorted(good)]


def single_homes(sets: DataFrame) -> DataFrame:
    """(home_n, home, n, row) from the lists of single tokens, walked in the order of size and
    row. A list ends where the next set is too large for the one before. Lists up to LIST
    sets are first rid of sets without a partner; longer ones pass by without being held."""
    schema = pa.schema([("home_n", pa.int32()), ("home", pa.int64()), ("n", pa.int32()), ("row", pa.int64())])

    def run(batches):
        token, pending, size = None, None, 0
        part: list[tuple[int, int, int]] = []
        first = None  # of a list that has grown long
        out: list[tuple[int, ...]] = []

        def close():
            nonlocal part, first
            if first is None and len(part) > 1:
                good = _tried(part)
                out.extend((good[0][0], good[0][2], x[0], x[2]) for x in good)
            part, first = [], None

        def batch():
            nonlocal out
            done, out = out, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            columns = [b.column(i).to_numpy() for i in range(4)]
            if pending is not None:
                columns = [np.concatenate(([x], y)) for x, y in zip(pending, columns)]
            t = columns[0]
            same = t[1:] == t[:-1]
            keep = np.concatenate(([t[0] == token], same)) | np.concatenate((same, [False]))
            pending = None if keep[-1] else [c[-1] for c in columns]
            for x, n, place, y in zip(*(c[keep].tolist() for c in columns)):
                if x != token or PART * n > WHOLE * size:
                    close()
                token, size = x, n
                if first is None:
                    part.append((n, place, y))
                    if len(part) > LIST:
                        first = part[0]
                        out.extend((first[0], first[2], z[0], z[2]) for z in part)
                else:
                    out.append((first[0], first[2], n, y))
            yield batch()
        close()
        yield batch()

    tokens = sets.select("n", "row", F.posexplode("singles").alias("place", "token")).select("token", "n", "place", "row")
    return tokens.repartition("token").sortWithinPartitions("token", "n", "row").mapInArrow(run, "home_n int, home long, n int, row long")


def combined_homes(sets: DataFrame) -> DataFrame:
    """(home_n, home, n, row) from the lists of combinations, each cut by class of size. These
    can be long, so each one's smallest and largest early set of the lower class are
    aggregated before the shuffle and joined back: no other set can be the smaller one of a pair."""
    grade = F.floor(F.log("n") / F.log(F.lit(RATIO))).cast("int")
    runs = sets.select("n", "row", "early", grade.alias("grade"), F.explode("runs").alias("key"))
    runs = runs.select("n", "row", "key", "grade", "early", F.explode(F.array("grade", F.col("grade") - 1)).alias("lower"))
    runs = runs.select("n", "row", "key", "lower", (F.col("early") & (F.col("grade") == F.col("lower"))).alias("small"))
    lists = runs.groupBy(F.col("key").alias("_k"), F.col("lower").alias("_l")).agg(F.min(F.when(F.col("small"), F.struct("n", "row"))).alias("first"), F.max(F.when(F.col("small"), F.col("n"))).alias("top"), F.count("*").alias("m"))
    lists = stage(lists.where("m > 1 AND first IS NOT NULL").select("_k", "_l", "first", "top"), "jaccard-runs")
    met = small_join(runs, lists, (F.col("key") == F.col("_k")) & (F.col("lower") == F.col("_l")), most=LOOKUP_ROWS)
    met = met.where((F.col("small") | (F.col("n") > F.col("first.n"))) & (PART * F.col("n") <= WHOLE * F.col("top")))
    return met.select(F.col("first.n").alias("home_n"), F.col("first.row").alias("home"), "n", "row")


def homes(heads: DataFrame) -> DataFrame:
    """(home, row, earlier, sets, tokens): the homes of each set, those of them that come
    before this one, and the size of the home. Homes of one set and homes that lie within an earlier one are left out."""
    found = stage(single_homes(heads).union(combined_homes(heads)).distinct(), "jaccard-homes")
    own = found.groupBy("row", "n").agg(F.sort_array(F.collect_set(F.struct("home_n", "home"))).alias("all"))  # no more than a set has signatures
    own = own.withColumn("h", F.explode("all")).select("row", "n", "h", F.filter("all", lambda x: x < F.col("h")).alias("before"))
    own = stage(own.select("row", "n", F.col("h.home").alias("home"), F.col("before.home").alias("earlier")), "jaccard-own")
    sizes = stage(own.groupBy("home").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")), "jaccard-sizes")
    within = own.select("home", F.explode("earlier").alias("e")).groupBy("home", "e").count()
    known = sizes.select(F.col("home").alias("_h"), "sets")
    within = small_join(within, known, F.col("home") == F.col("_h"), most=LOOKUP_ROWS).where("count = sets").select("_h").distinct()
    left = stage(sizes.where("sets > 1").join(within, F.col("home") == F.col("_h"), "left_anti").withColumnRenamed("home", "_h"), "jaccard-left")
    return small_join(own, left, F.col("home") == F.col("_h"), most=LOOKUP_ROWS).drop("_h")


# --- links --------------------------------------------------------------------


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets: a product of incidence matrices, a part of the tokens at a time."""
    both = [*left, *right]
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    tokens = np.concatenate(both)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    lengths = np.diff(np.append(starts, len(tokens)))
    keep = np.repeat(lengths > 1, lengths)
    lengths, owner = lengths[lengths > 1], owner[keep]
    column = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 4096
    for at in range(0, len(lengths), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(both), min(width, len(lengths) - at)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def linked_pairs(sets: list[np.ndarray], earlier: list[list[int]], sides: np.ndarray | None = None) -> np.ndarray:
    """Matrix of the pairs that link and have no earlier common home; of two ``sides`` (False, True) only pairs across them."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    names, own = np.unique(np.concatenate([np.array(e, dtype=np.int64) for e in earlier]), return_inverse=True)
    done = np.zeros((m, m), dtype=bool)
    rows = np.arange(m)
    if len(names):
        inside = np.zeros((m, len(names)), dtype=np.float32)
        inside[np.repeat(rows, [len(e) for e in earlier]), own] = 1
        done = inside @ inside.T > 0
    left, right = (rows[~done.all(axis=1)], rows) if sides is None else (rows[~sides], rows[sides])
    out = np.zeros((m, m), dtype=bool)
    if not len(left) or not len(right):
        return out
    both = _shared([sets[i] for i in left], [sets[i] for i in right])
    link = both * (PART + WHOLE) >= PART * (n[left][:, None] + n[right][None, :])
    out[np.ix_(left, right)] = link & ~done[np.ix_(left, right)]
    out |= out.T
    np.fill_diagonal(out, False)
    return out


def _labels(link: np.ndarray) -> np.ndarray:
    """For each place the least place that links reach from it."""
    label = np.arange(len(link))
    while True:
        low = np.minimum(label, np.where(link, label, len(link)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def links(homes: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(row, links, to): per unit and set in it its links there, each counted as often as
    the other set has documents, and the least set that they reach."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("sets") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    own = homes.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64("row"), F.col("_n")).cast("int"))
    own = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    own = own.select(F.col("row").alias("_r"), "home", F.least("_b", "_o").alias("lo"), F.greatest("_b", "_o").alias("hi"), (F.col("_b") > F.col("_o")).alias("side"), "earlier")
    own = small_join(stage(own, "jaccard-units"), classes.select("cls", "c"), F.col("_r") == F.col("cls"), "left", most=LOOKUP_ROWS)
    own = stage(own.select("_r", "home", "lo", "hi", "side", "earlier", F.coalesce("c", F.lit(1)).alias("copies")), "jaccard-units")
    texts, on = rows.select("row", F.col("doc.text").cast("string").alias("text")), F.col("row") == F.col("_r")
    weight = own.agg(F.coalesce(F.sum(1 + F.size("earlier") / EARLIER), F.lit(0.0))).first()[0]
    units = texts.join(F.broadcast(own) if weight <= LOOKUP_ROWS else own.hint("merge"), on)
    schema = pa.schema([("row", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def run(batches):
        unit, rows, copies, sides, earlier, tokens = None, [], [], [], [], []
        out: list[tuple[int, int, int]] = []

        def close():
            if len(rows) < 2:
                return
            link = linked_pairs(tokens, earlier, np.array(sides) if unit[1] != unit[2] else None)
            some = np.flatnonzero(link.any(axis=1))
            total, label = link[some] @ np.array(copies, dtype=np.float64), _labels(link)
            out.extend((rows[i], int(c), rows[label[i]]) for i, c in zip(some.tolist(), total.tolist()))

        def batch():
            nonlocal out
            done, out = out, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in _slices(batches, 500):
            columns = [b.column(i).to_pylist() for i in range(7)]
            for u, row, c, side, before, s in zip(zip(*columns[:3]), *columns[3:], shingle_sets(b.column(7).to_pylist())):
                if u != unit:
                    close()
                    unit, rows, copies, sides, earlier, tokens = u, [], [], [], [], []
                for to, x in zip((rows, copies, sides, earlier, tokens), (row, c, side, before, s)):
                    to.append(x)
            yield batch()
        close()
        yield batch()

    dealt = units.select("home", "lo", "hi", "row", "copies", "side", "earlier", "text").repartition("home", "lo", "hi").sortWithinPartitions("home", "lo", "hi", "row")
    return stage(dealt.mapInArrow(run, "row long, links long, to long"), "jaccard-links")


def components(links: DataFrame) -> DataFrame:
    """(row, comp) of every row in a link (a, b). Each round contracts a row to the
    smallest of itself and its neighbours until no link is left."""
    edges = stage(links.select("a", "b").where("a <> b").distinct(), "components-edges")
    of = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        low = stage(low.select("v", F.least("v", "m").alias("p")), "components-low")
        if of is None:
            of = low.select(F.col("v").alias("row"), F.col("p").alias("comp"))
        else:
            of = stage(small_join(of, low, F.col("comp") == F.col("v"), "left", most=LOOKUP_ROWS).select("row", F.coalesce("p", "comp").alias("comp")), "components-of")
        a, b = low.select(F.col("v").alias("va"), F.col("p").alias("pa")), low.select(F.col("v").alias("vb"), F.col("p").alias("pb"))
        n = low.count()
        moved = small_join(edges, a, F.col("a") == F.col("va"), rows=n, most=LOOKUP_ROWS)
        moved = small_join(moved, b, F.col("b") == F.col("vb"), rows=n, most=LOOKUP_ROWS).where("pa <> pb")
        edges = stage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "components-edges")
    return of if of is not None else links.select(F.col("a").alias("row"), F.col("a").alias("comp")).limit(0)


def join_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, component_id, n_links, stays) of every row of ``keyed`` documents: ``stays``
    is the row of the component with the smallest doc_id (nulls last, then the first row), null for sets without tokens."""
    sets = token_sets(docs, *frequencies(docs.select("doc.text")))
    full = sets.where("n > 0").select("row", "doc_id", "n", "sig")
    classes = full.groupBy(F.col("sig").alias("_s")).agg(F.min("row").alias("cls"), F.count("*").alias("c")).where("c > 1")
    classes = stage(classes, "jaccard-classes")
    heads = small_join(sets.where("n > 0").select("row", "n", "sig", "singles", "runs", "early"), classes, F.col("sig") == F.col("_s"), "left", most=LOOKUP_ROWS).where("cls IS NULL OR cls = row").drop("sig", "_s", "cls", "c")
    found = links(homes(heads), docs, classes)
    of = components(found.select(F.col("row").alias("a"), F.col("to").alias("b")))
    counted = found.groupBy(F.col("row").alias("_r")).agg(F.sum("links").alias("links"))
    known = stage(small_join(counted, of, F.col("_r") == F.col("row"), most=LOOKUP_ROWS).select("_r", "comp", "links"), "jaccard-known")
    rows = small_join(full, classes, F.col("sig") == F.col("_s"), "left", most=LOOKUP_ROWS).select("row", "doc_id", "n", "cls", "c", F.coalesce("cls", "row").alias("head"))
    rows = small_join(rows, known, F.col("head") == F.col("_r"), "left", most=LOOKUP_ROWS)
    rows = rows.select("row", "doc_id", "n", F.coalesce("comp", "cls", "row").alias("comp"), F.coalesce("comp", "cls").isNotNull().alias("more"), (F.coalesce("c", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = stage(rows, "jaccard-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    lows = stage(rows.where("more").groupBy(F.col("comp").alias("_p")).agg(least.alias("low")), "jaccard-lows")
    named = small_join(rows, lows, F.col("more") & (F.col("comp") == F.col("_p")), "left", most=LOOKUP_ROWS)
    named = named.select("row", "doc_id", "n", F.when(F.col("_p").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id")).alias("component_id"), "n_links", F.coalesce("low.row", "row").alias("stays"))
    alone = sets.where("n = 0").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("stays"))
    return named.unionByName(alone)


def join_components(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links."""
    with scratch(docs.sparkSession) as keep:
        rows = keep(stage(join_rows(keyed(docs.select("doc_id", "text"), "jaccard-documents")), "jaccard-result"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, with all columns; nulls
    come last, and of equal ids the first row as written stays. Documents without words all stay.
    Rows are told apart by a key of their own, so null and repeated ids do no harm."""
    rows = keyed(docs, "jaccard-documents")
    with scratch(docs.sparkSession) as keep:
        goes = keep(stage(join_rows(rows).where("stays <> row").select("row"), "jaccard-goes"))
    return without(rows, goes)


#: Rows of ``join_components`` in DuckDB SQL.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ') AS t
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id, coalesce(any_value(k.k), 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) k ON k.a = d.doc_id GROUP BY d.doc_id
"""
