"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Every tree has ``BITS`` random hyperplanes; the signs of a vector's products with them are its hash
string there. A tree is its strings in order: a sorted array, cut into segments (files in the shared
folder) by a range partitioning. Where a prefix of the query's string stands in it is one run.

1. Descend: a query is in the arrays itself, so while a segment is written its ``NEAR`` neighbours
   on either side, those with the longest common prefixes, are compared with it. The fifth best over all
   trees bounds the angle of its true fifth.
2. Ascend: two vectors at angle t share a prefix of x bits in one tree with probability
   (1 - t / pi) ^ x. The prefix is shortened by one bit in tree after tree until the chance that all
   trees miss a vector at that angle is at most ``MISS``; vectors that are nearer are missed less often. All
   entries with those prefixes are compared, whatever their number. So a query with close
   neighbours looks at a few entries, and one in uniform noise at a large part of the table.

Equal vectors are one class, indexed once with its six smallest ids: more can't be among the five
nearest. Classes that are compared in several trees count once. Queries of a segment are split
into blocks of ``BLOCK``, so a segment that many queries look at is read by many tasks. Only the
six best of a query and segment are written. The driver holds one row per segment (about
``SEGMENT`` bytes of the index).

Defined results: vectors that are null, empty, zero, or hold a null or a number that isn't finite take no part,
nor do rows without an id; vectors of other lengths are no candidates; rows that repeat an id
are rows of their own, a query leaves out itself once; -0.0 is 0.0; equal vectors have equal
scores; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import folder, scratch, small_join, stage

K = 5
#: The queries of op12: rows whose id this divides.
EVERY = 50
TREES, BITS, NEAR, MISS = 20, 64, 32, 0.07
SEGMENT, BLOCK, ROWS = 32 << 20, 2048, 16_384  # bytes of a segment, queries of a block, entries compared at once
_TOP = np.uint64(1 << 63)
_PLANES: dict[int, np.ndarray] = {}


def _planes(dim: int) -> np.ndarray:
    if dim not in _PLANES:
        _PLANES[dim] = np.random.default_rng([12, dim]).standard_normal((dim, TREES * BITS))
    return _PLANES[dim]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """In double precision, each divided by a power of two so that squares neither overflow nor vanish: exact, and the same cosine."""
    v = vectors.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) if len(v) else v


def cosines(vectors: np.ndarray, lengths: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
    """Row by row, so that equal vectors have equal scores wherever they stand."""
    return (vectors * query).sum(axis=1) / (lengths * length)


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def hashes(vectors: np.ndarray) -> np.ndarray:
    """(rows, trees): hash strings as numbers whose order is that of the strings."""
    bits = vectors @ _planes(vectors.shape[1]) > 0
    return np.packbits(bits.reshape(len(vectors), TREES, BITS), axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id, best first."""
    at = np.arange(len(scores)) if len(scores) <= k else np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def levels(cosine: float, first: int, miss: float = MISS) -> np.ndarray:
    """Length of the prefix in each tree, such that a vector of this cosine is missed with a chance of at most ``miss``.
    Trees from ``first`` on are shortened first."""
    p = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    hit = p ** np.arange(BITS + 1)
    x = int(np.flatnonzero((1 - hit) ** TREES <= miss)[-1])
    out = np.full(TREES, x)
    if x < BITS:
        short = np.arange(1, TREES + 1)
        j = int(short[(1 - hit[x]) ** short * (1 - hit[x + 1]) ** (TREES - short) <= miss][0])
        out[(first + np.arange(j, TREES)) % TREES] = x + 1
    return out


def vectors_of(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec): the rows that take part, vectors as bytes."""
    kind = np.float32 if table.schema[vector].dataType.elementType.typeName() == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            values = lists.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
            ends = lists.offsets.to_numpy()
            odd, some = (np.concatenate(([0], np.cumsum(x))) for x in (~np.isfinite(values), values != 0))
            good = (odd[ends[1:]] == odd[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])
            good &= ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(good)
            blobs = [values[a:b].tobytes() for a, b in zip(ends[at].tolist(), ends[at + 1].tolist())]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(blobs, pa.binary())], names=["vec_id", "vec"])

    name = "float" if kind is np.float32 else "double"
    return table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{name}>").alias("v")).mapInArrow(run, "vec_id long, vec binary")


def _matrices(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(places in the batch, other columns, vectors of one length); the last column has the vectors."""
    for batch in batches:
        blobs = batch.column(batch.num_columns - 1).to_pylist()
        sizes = np.array([len(b) for b in blobs], np.int64)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            for i in range(0, len(at), ROWS // 8):
                part = at[i : i + ROWS // 8]
                found = np.frombuffer(b"".join([blobs[j] for j in part.tolist()]), kind).reshape(len(part), -1)
                yield part, [batch.column(c).to_numpy(zero_copy_only=False)[part] for c in range(batch.num_columns - 1)], found


SEGMENTS = pa.schema([("tree", pa.int64()), ("path", pa.string()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("query", pa.int64()), ("near", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
SEGMENTS_SQL = "tree long, path string, n long, low long, high long, query long, near array<long>, scores array<double>"


class Segment:
    """A part of a tree's sorted array: strings, classes, their smallest ids, vectors."""

    def __init__(self, strings: np.ndarray, classes: np.ndarray, first: np.ndarray, raw: np.ndarray):
        self.strings, self.classes, self.first = strings, classes, first
        self.vectors = scaled(raw)
        self.lengths = lengths_of(self.vectors)

    @classmethod
    def read(cls, path: str, kind: type) -> Segment:
        store, name = pafs.FileSystem.from_uri(path)
        with store.open_input_stream(name) as f:
            data = f.read()
        n = int(np.frombuffer(data, "<i8", 1)[0])
        part = lambda i, t: np.frombuffer(data, t, n, 8 + 8 * n * i)
        return cls(part(0, "<u8").astype(np.uint64), part(1, "<i8"), part(2, "<i8"), np.frombuffer(data, kind, -1, 8 + 24 * n).reshape(n, -1))

    def compare(self, begin: int, end: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best entries of a run."""
        places, scores = [], []
        length = lengths_of(query[None])[0]
        for i in range(begin, end, ROWS):
            found = cosines(self.vectors[i : min(end, i + ROWS)], self.lengths[i : min(end, i + ROWS)], query, length)
            at = best(found, self.first[i : min(end, i + ROWS)], k)
            places.append(at + i)
            scores.append(found[at])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0)
        places, scores = np.concatenate(places), np.concatenate(scores)
        at = best(scores, self.first[places], k)
        return places[at], scores[at]


def build(classes: DataFrame, files: str, kind: type) -> DataFrame:
    """Write the segments; (tree, path, n, low, high) of each, and rows of every query with its near classes."""
    spark = classes.sparkSession
    size = classes.agg(F.coalesce(F.sum(F.length("vec") + 32), F.lit(0))).first()[0] * TREES
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SEGMENT))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (cid, first, query), raw in _matrices(batches, kind):
            found, m = (hashes(scaled(raw)) ^ _TOP).view(np.int64), len(raw)
            tree = raw.shape[1] * TREES + np.arange(TREES)
            blobs = pa.array([r.tobytes() for r in raw], pa.binary())
            columns = [np.tile(tree, m), found.reshape(-1), np.repeat(cid, TREES), np.repeat(first, TREES), np.repeat(query, TREES)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), blobs.take(pa.array(np.repeat(np.arange(m), TREES)))], names=["tree", "string", "cid", "first", "query", "vec"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, store, root = None, [], *pafs.FileSystem.from_uri(files)

        def closed() -> Iterator[pa.RecordBatch]:
            strings, cid, first, query = (np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in (1, 2, 3, 4))
            raw = np.frombuffer(b"".join([b for h in held for b in h.column(5).to_pylist()]), kind).reshape(len(cid), -1)
            task = TaskContext.get()
            path = f"{tree}-{task.partitionId()}-{task.taskAttemptId()}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{path}") as out:
                for x in (np.array([len(cid)], "<i8"), strings.view(np.uint64) ^ _TOP, cid.astype("<i8"), first.astype("<i8"), raw):
                    out.write(x.tobytes())
            rows = [{"tree": tree, "path": f"{files}/{path}", "n": len(cid), "low": int(strings[0]), "high": int(strings[-1])}]
            part = Segment(strings.view(np.uint64) ^ _TOP, cid, first, raw)
            for i in np.flatnonzero(query).tolist():
                places, scores = part.compare(max(0, i - NEAR), min(len(cid), i + NEAR + 1), part.vectors[i], K + 1)
                others = places != i
                rows.append({"query": int(cid[i]), "near": cid[places[others]][:K].tolist(), "scores": scores[others][:K].tolist()})
                if len(rows) >= BLOCK:
                    yield pa.RecordBatch.from_pylist(rows, schema=SEGMENTS)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=SEGMENTS)

        for batch in batches:
            trees = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(trees)) + 1).tolist(), len(trees)]
            for x, y in zip(cuts, cuts[1:]):
                if y > x:
                    if held and trees[x] != tree:
                        yield from closed()
                        held = []
                    tree = int(trees[x])
                    held.append(batch.slice(x, y - x))
        if held:
            yield from closed()

    rows = classes.select("cid", F.col("ids")[0].alias("first"), "query", "vec").mapInArrow(entries, "tree long, string long, cid long, first long, query boolean, vec binary")
    order = ["tree", "string", "cid"]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(write, SEGMENTS_SQL)


def routed(queries: DataFrame, segments: list, kind: type, miss: float) -> DataFrame:
    """(seg, query, low, high, vec): the run that a query looks at in each tree, to all segments that hold a part of it."""
    trees: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for i, s in enumerate(segments):
        trees.setdefault(s["tree"], []).append(i)
    trees = {t: (np.array(own), *(np.array([segments[i][c] for i in own], np.int64).view(np.uint64) ^ _TOP for c in ("low", "high"))) for t, own in trees.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (cid, cosine), raw in _matrices(batches, kind):
            found, out = hashes(scaled(raw)), []
            for q, c, strings, vector in zip(cid.tolist(), cosine.tolist(), found, raw):
                for t, (x, string) in enumerate(zip(levels(c, q % TREES, miss).tolist(), strings.tolist())):
                    rest = (1 << (BITS - x)) - 1
                    low, high = string & ~rest & ((1 << 64) - 1), string | rest
                    own, lows, highs = trees[raw.shape[1] * TREES + t]
                    for i in own[np.searchsorted(highs, np.uint64(low)) : np.searchsorted(lows, np.uint64(high), "right")].tolist():
                        out.append((i, q, low - (1 << 63), high - (1 << 63), vector.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["seg", "query", "low", "high", "vec"])

    return queries.select("cid", "cosine", "vec").mapInArrow(run, "seg int, query long, low long, high long, vec binary")


def search(looks: DataFrame, segments: list, kind: type) -> DataFrame:
    """(query, cid, first, score): the best classes of every run that a query looks at."""
    paths = [s["path"] for s in segments]
    counts = looks.groupBy("seg").count().select(F.col("seg").alias("_seg"), F.ceil(F.col("count") / BLOCK).alias("blocks"))
    dealt = looks.join(F.broadcast(counts), F.col("seg") == F.col("_seg")).withColumn("block", F.pmod(F.xxhash64("query"), "blocks"))  # a row per segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        for batch in batches:
            out = []
            for seg, q, low, high, vec in zip(*(c.to_pylist() for c in batch.columns)):
                if seg != at:
                    at, part = seg, Segment.read(paths[seg], kind)
                begin, end = np.searchsorted(part.strings, np.uint64(low + (1 << 63))), np.searchsorted(part.strings, np.uint64(high + (1 << 63)), "right")
                places, scores = part.compare(int(begin), int(end), scaled(np.frombuffer(vec, kind)[None])[0], K + 1)
                out += [(q, c, f, s) for c, f, s in zip(part.classes[places].tolist(), part.first[places].tolist(), scores.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query", "cid", "first", "score"])

    rows = dealt.repartition("seg", "block").sortWithinPartitions("seg", "block", "low")
    return rows.select("seg", "query", "low", "high", "vec").mapInArrow(run, "query long, cid long, first long, score double")


def _top(rows: DataFrame, by: str, n: int, *order) -> DataFrame:
    """The first n rows of each key; Spark limits each task's rows before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n)


def nearest(table: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", miss: float = MISS) -> DataFrame:
    """(query_id, rank, vec_id, score): the K nearest found of every row whose key ``is_query``; with ``miss`` 0 it is exact."""
    spark = table.sparkSession
    kind = np.float32 if table.schema[vector].dataType.elementType.typeName() == "float" else np.float64
    with scratch(spark) as keep:
        files = folder(spark, "forest")
        rows = vectors_of(table, key, vector)
        split = rows.withColumn("query", is_query(F.col("vec_id")))
        few = split.withColumn("_n", F.row_number().over(Window.partitionBy("vec", "query").orderBy("vec_id"))).where(F.col("_n") <= K + 1)
        classes = few.groupBy("vec").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, K + 1).alias("ids"), F.max("query").alias("query"))
        classes = stage(classes.select(F.monotonically_increasing_id().alias("cid"), "ids", "query", "vec"), "vectors")
        forest = stage(build(classes, files, kind), "forest")
        segments = sorted(forest.where("path IS NOT NULL").select("tree", "path", "low", "high").collect(), key=lambda s: (s["tree"], s["low"], s["high"]))
        near = forest.where("path IS NULL").select("query", F.explode(F.arrays_zip("near", "scores")).alias("x")).select("query", F.col("x.near").alias("cid"), F.col("x.scores").alias("score")).dropDuplicates(["query", "cid"])
        fifth = _top(near, "query", K, F.desc("score")).groupBy("query").agg(F.when(F.count("*") == K, F.min("score")).otherwise(-1.0).alias("cosine"))
        asked = classes.where("query").drop("query").join(fifth.withColumnRenamed("query", "_q"), F.col("cid") == F.col("_q"), "left").select("cid", F.coalesce("cosine", F.lit(-1.0)).alias("cosine"), "vec")
        looks = stage(routed(asked, segments, kind, miss), "looks")
        found = search(looks, segments, kind).dropDuplicates(["query", "cid"])
        few = _top(found, "query", K + 1, F.desc("score"), "first").select(F.col("query").alias("q"), F.col("cid").alias("c"), "score")
        ids = few.join(classes.select("cid", "ids"), F.col("c") == F.col("cid")).select("q", F.explode("ids").alias("vec_id"), "score", (F.col("q") == F.col("c")).alias("own"))
        lists = _top(ids, "q", K + 1, F.desc("score"), "vec_id").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score", "own"))).alias("found"))
        known = stage(lists.join(classes.where("query").select("cid", F.col("vec").alias("v")), F.col("q") == F.col("cid")).select("v", "found"), "neighbours")
        asking = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vec")
        each = small_join(asking, known, F.col("vec") == F.col("v"))
        itself = F.expr(f"coalesce(try_element_at(filter(found, x -> x.own AND x.vec_id = query_id), 1)._n, {K + 1})")
        out = each.withColumn("itself", itself).select("query_id", "itself", F.explode("found").alias("x")).where("x._n <> itself")
        rank = (F.col("x._n") - (F.col("x._n") > F.col("itself")).cast("int")).cast("int")
        return keep(stage(out.select("query_id", rank.alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")), "nearest"))


def op12_forest(table: DataFrame) -> DataFrame:
    return nearest(table, lambda c: c % EVERY == 0)
