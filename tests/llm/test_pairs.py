"""Fill-in-middle, nearest neighbours and cross-tokenizer alignment against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidewater.llm import align, fim, forest


def by_hand(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, len(units), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


ODD = ["<P>", "a<S>b", "<", "<P", "x<" * 300, "a" * 20_000, "ab " * 5000, "é" * 3000, "日本語" * 2000, "\x00\n\t" * 400, "a1" * 3000, "\U0001f600b" * 1500]


def test_fim(spark, docs):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id at all"), (None, None)], "doc_id long, text string")
    for table in (docs, odd):
        want = sorted((by_hand(r["doc_id"], r["text"] or "") for r in table.collect()), key=str)
        assert sorted((tuple(r) for r in fim.op11_fim(table).collect()), key=str) == want


def test_fim_of_nothing(empty):
    assert fim.op11_fim(empty).collect() == []


def test_fim_sql(spark, docs):
    """DuckDB's form of the same, but for a text with U+0000."""
    tables = duckdb.connect()
    tables.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    assert sorted(tables.execute(fim.SQL).fetchall(), key=str) == sorted((by_hand(r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)


def test_chunks_are_shared_and_whole():
    rng, memo = random.Random(3), fim.Memo()
    passage = "".join(rng.choice("abcdefghij ") for _ in range(40_000))
    for before in ("", "one ", "ü" * 500):
        text = before + passage
        blob = text.encode()
        ends = fim.chunk_ends(blob)
        assert ends[-1] == len(blob) and max(b - a for a, b in zip([0, *ends], ends)) <= fim.MOST + 3
        assert "".join(blob[a:b].decode() for a, b in zip([0, *ends], ends)) == text
        made = memo.made
        counted = fim.Counted(text, memo)
        assert counted.n == len(fim.TOKEN.findall(text))
    assert memo.made - made < 5 < made  # the passage's chunks are found again


@pytest.mark.parametrize("k", [0, 1, 2, 63, 64, 999])
def test_starts(k):
    text = "word " * 300 + "a" * 9000 + "é1" * 800
    starts = [m.start() for m in fim.TOKEN.finditer(text)] + [len(text)]
    assert fim.Counted(text, fim.Memo(3)).start(k) == starts[k] and fim.Counted(text, fim.Memo()).start(len(starts) - 1) == len(text)


# --- alignment ---------------------------------------------------------------

MESSY = ["a", "b", " ", "  ", "\n", "\n\n", "\t", " \n", "é", "日", "\U0001f600", "<|endoftext|>", "<s>", "'s", "1", "23", "\r\n", "\x1c", "\x85", "\u3000", "\xa0", "th", "e", "ing", "_", "--", "\u2581", "//", "<0x41>"]


def alignments_by_hand(rows):
    """Whole texts, encoded in one call each; groups, links and counts by definition."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in letters} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in letters)}

    def groups(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xs = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in y]
        if not text or b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            return []
        ends = [np.cumsum([len(t) for t in z]).tolist() for z in (xs, ys)]
        out, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            out.append((x[i:p], y[j:q]))
            i, j = p, q
        return out

    found = [groups(t or "") for _, t in rows]
    links = [[(i, j) for x, y in g for i in x for j in y] for g in found]
    counts = Counter(pair for own in links for pair in set(own))
    most: dict = {}
    for (i, _), n in counts.items():
        most[i] = max(n, most.get(i, 0))
    out = []
    for (key, _), g, own in zip(rows, found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((key, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard, held", [(align.SHARD, align.HELD), (100, 2)])
def test_align(spark, texts, shard, held):
    rng = random.Random(7)
    rows = [*enumerate(texts), (3, texts[8]), (None, "no id"), (None, None), (500, "a" * 3000), (501, "日本" * 700), (502, "x  " * 900), (503, "\u2581 x")]
    rows += [(1000 + i, "".join(rng.choice(MESSY) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    table = spark.createDataFrame([(k, t, 1, -1) for k, t in rows], "doc_id long, text string, key long, shard int").repartition(3)
    got = align.op13_align(table, shard=shard, held=held)
    assert got.columns == ["doc_id", *align.COLUMNS, "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == alignments_by_hand(rows)


def test_align_of_nothing(spark, empty):
    assert align.op13_align(empty).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, align.op13_align(blank).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_aligner_forgets_pieces_and_large_groups(monkeypatch):
    """A small memory gives the same numbers; so do groups whose links are counted from distinct ids."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(60)]
    monkeypatch.setattr(align, "LISTED", 3)
    small, large = align.Aligner(cache=100), align.Aligner()
    for text in texts:
        found = []
        for aligner in (small, large):
            (pieces,) = aligner.cut([text])
            at = aligner.spans(pieces)
            links: Counter = Counter()
            for link, times in zip(np.array(aligner.links)[at].tolist(), np.array(aligner.times)[at].tolist()):
                links[link] += times
            found.append((links, np.array(aligner.stats).reshape(-1, 4)[pieces].sum(axis=0).tolist(), [aligner.groups[i] for i in pieces]))
            assert sum(links.values()) == found[-1][1][3]
        assert found[0] == found[1]
    assert len(small.known) < 200


def test_pair_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 5000))
    for depth in (24, 2):
        made = align.PairHash.load(align.PairHash.build(keys, depth).dump())
        slots = made.slots(keys)
        assert sorted(slots.tolist()) == list(range(len(keys))) and (made.keys[slots] == keys).all()
        assert (made.slots(np.array([1 << 51, 7], np.int64)) == -1).all()
    assert len(align.PairHash.load(align.PairHash.build(keys[:0]).dump()).keys) == 0


# --- nearest neighbours --------------------------------------------------------


def nearest_by_hand(rows):
    """All pairs, in double precision."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for n, (i, q) in enumerate(good):
        if i % 50 == 0:
            found = sorted((-(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)).round(12), j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q))[:5]
            out.setdefault(i, []).append([(r, j, -s) for r, (s, j) in enumerate(found, 1)])
    return out


def found_by(got):
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 12)))
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_on_odd_rows(spark, kind):
    """Every entry is looked at, so the result is exact."""
    rng = np.random.default_rng(3)
    some = lambda: rng.integers(-8, 9, 6).astype(float).tolist()
    rows = [(i, some()) for i in range(0, 400, 10)]
    rows += [(1000 + i, [1.0, 2, 3, 4, 5, 6]) for i in range(20)] + [(50 * 40, [1.0, 2, 3, 4, 5, 6]), (-50, [1.0, 2, 3, 4, 5, 6]), (7, [2.0, 4, 6, 8, 10, 12])]
    rows += [(100_000, None), (100_050, [0.0] * 6), (100_100, [1.0, None, 0, 0, 0, 0]), (100_150, [float("nan")] * 6), (100_200, [float("inf")] + [0.0] * 5), (None, some()), (100_250, []), (100_300, [1.0, -0.0]), (3, [1.0, 0.0]), (5, [-1.0, 0.0])]
    if kind == "double":
        rows += [(9, [3e200, 1.0, 1, 1, 1, 1]), (100_350, [1e-200, 2e-200, 3e-200, 4e-200, 5e-200, 6e-200])]
    table = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 0, -1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cid int, query int").repartition(3)
    got = found_by(forest.nearest(table, lambda c: c % 50 == 0, miss=0.0))
    scale = [(i, None if v is None or None in v or not np.isfinite(v).all() or not any(v) else (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    want = {i: own[0] for i, own in nearest_by_hand(scale).items()}
    assert set(got) == {i for i, own in want.items() if own}
    for i, own in got.items():
        assert [r[0] for r in own] == list(range(1, len(own) + 1)) and [r[2] for r in own] == pytest.approx([r[2] for r in want[i]], abs=1e-9)
        assert i not in [r[1] for r in own]
    for i in (2000, -50, 100_300):
        assert [r[1] for r in got[i]] == [r[1] for r in want[i]]


def test_nearest_of_repeated_rows_and_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    assert forest.op12_forest(spark.createDataFrame([], schema)).collect() == []
    assert forest.op12_forest(spark.createDataFrame([(50, [1.0, 2.0])], schema)).collect() == []
    got = forest.op12_forest(spark.createDataFrame([(50, [1.0, 2.0])] * 2 + [(51, [2.0, 1.0])], schema)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(50, 1, 50), (50, 1, 50), (50, 2, 51), (50, 2, 51)]


def test_recall(spark):
    """Vectors around centres and in noise; a group of equal and one of nearly equal vectors."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    v = np.concatenate([centres[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 32)), rng.standard_normal((2000, 32)), np.tile(centres[0], (300, 1)), centres[1] + 1e-3 * rng.standard_normal((300, 32))]).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got = found_by(forest.op12_forest(table))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, len(v), 50):
        s = u @ u[q]
        s[q] = -2
        fifth = np.sort(s)[-5]
        assert len(got[q]) == 5 and q not in [r[1] for r in got[q]]
        assert [r[2] for r in got[q]] == pytest.approx([s[r[1]] for r in got[q]], abs=1e-9)
        hits += sum(s[r[1]] >= fifth - 1e-9 for r in got[q])
        total += 5
    assert hits / total > 0.93
    assert [r[1] for r in got[5050]] == [5000, 5001, 5002, 5003, 5004]
