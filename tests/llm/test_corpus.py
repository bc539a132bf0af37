"""Operators over pairs, labels, pages and conversations against brute force, and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import chat, decontam, jaccard, toxicity, urls
from tidewater.llm.common import keyed, small_join

SF = "/root/testdata/sf0.01"


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    low = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((rows[i][0], len(sets[i]), (low.get(find(i)) if sets[i] else rows[i][0]), links[i]) for i in range(len(rows)))


def test_jaccard(docs, rows, empty):
    assert Counter(tuple(r) for r in jaccard.join_components(docs).collect()) == plain_components(rows)
    assert jaccard.join_components(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0


def many(spark, rng_seed, groups, size, words=60, edits=2):
    import random

    rng = random.Random(rng_seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            own = base[:]
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(words)] = rng.choice(vocabulary)
            out.append(" ".join(own))
    for _ in range(100):
        out.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))]))
    rng.shuffle(out)
    return [(i, t, None) for i, t in enumerate(out)]


@pytest.mark.parametrize(("frequent", "listed", "block"), [(3, 2, 8), (16, 32, 1024), (10**6, 3, 7)])
def test_jaccard_with_large_groups(spark, monkeypatch, frequent, listed, block):
    """Large groups of near copies and a shared passage: through combinations, single tokens, long lists and homes of several blocks."""
    monkeypatch.setattr(jaccard, "FREQUENT_DF", frequent)
    monkeypatch.setattr(jaccard, "LIST", listed)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = many(spark, frequent % 100, 4, 60, edits=4) + [(1000 + i, "the same few words stand here once and again", None) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.join_components(docs).collect()) == plain_components(rows)


def test_frequent_tokens_come_packed(spark, monkeypatch):
    """The driver gets the frequent tokens as arrays, not as a row each."""
    kind, got = type(spark.range(1)), []

    def counted(f):
        def run(self, *a, **k):
            rows = list(f(self, *a, **k))
            got.extend(rows)
            return rows

        return run

    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(kind, name, counted(getattr(kind, name)))
    texts = [" ".join(f"w{i}" for i in range(4000))] * 20 + [" ".join(f"w{i}" for i in range(500))] * 20 + ["some other words that only one text has"]
    ids, level = jaccard.frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    whole, part = ((s >> np.uint64(32)).astype(np.uint32) for s in jaccard.shingle_sets([texts[0], texts[20]]))
    assert np.array_equal(ids, np.unique(whole)) and ids.dtype == np.uint32 and np.array_equal(level, np.where(np.isin(ids, part), 5, 4)) and level.dtype == np.uint8
    assert 0 < len(got) < len(ids) / 10
    none = jaccard.frequencies(spark.createDataFrame([("a b c",)], "text string"))
    assert [len(x) for x in none] == [0, 0]


def test_jaccard_broadcasts_little(spark, monkeypatch):
    """Sides beyond LOOKUP_ROWS rows, counting the lists of earlier homes they carry, are shuffled, with the same links."""
    rows = many(spark, 5, 3, 40, edits=4) + [(1000 + i, "the same few words stand here once and again", None) for i in range(5)]
    docs, want = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), Counter(plain_components(rows))
    seen, broadcast = [], F.broadcast

    def watched(side):
        seen.append(sum(1 + len(r["earlier"]) / 4 if "earlier" in side.columns else 1 for r in side.collect()))
        return broadcast(side)

    monkeypatch.setattr(jaccard, "FREQUENT_DF", 3)
    monkeypatch.setattr(F, "broadcast", watched)
    for most in (10, 200_000):
        monkeypatch.setattr(jaccard, "LOOKUP_ROWS", most)
        seen.clear()
        assert Counter(tuple(r) for r in jaccard.join_components(docs).collect()) == want
        assert max(seen, default=0) <= most
    assert max(seen) > 10


def test_large_lookups_are_never_broadcast(spark, tmp_path):
    """The copies of a lookup's rows have a small file, so Spark would broadcast all of them."""
    for name in ("big", "lookup"):
        spark.range(2000).select((F.col("id") if name == "big" else F.col("id") + 1000).alias(name)).write.parquet(f"{tmp_path}/{name}")
    big, lookup = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("big", "lookup"))
    for how, rows in (("inner", 1000), ("left", 2000), ("left_anti", 1000)):
        met = small_join(big, lookup, F.col("big") == F.col("lookup"), how, most=1999)
        assert met.count() == rows
        met.write.mode("overwrite").format("noop").save()
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in small_join(big, lookup, F.col("big") == F.col("lookup"), most=2000)._jdf.queryExecution().executedPlan().toString()


def test_jaccard_uses_combinations(spark):
    """Frequent tokens of the given tables are indexed by combinations, and these find homes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    frequent = jaccard.frequent_tokens(docs)
    sets = jaccard.token_sets(keyed(docs, "test"), frequent)
    assert len(frequent) and sets.where("size(runs) > 0").count() and jaccard.combined_homes(sets).count()


def test_keep_one(docs, rows):
    kept = jaccard.keep_one(docs).collect()
    heads = {d for d, n, c, _ in plain_components(rows) if d == c}
    assert {r["doc_id"] for r in kept} == heads and kept[0].asDict().keys() == set(docs.columns)


def test_keep_one_tells_rows_apart(spark):
    """Null and repeated ids: one row of each group stays, other rows with such ids too."""
    a, b, c = ("one two three four five six seven eight nine ten " + "and more words of the same kind as before %s" % x for x in ("eleven", "twelve", "thirteen fourteen fifteen sixteen"))
    rows = [(None, a), (None, a), (7, b), (7, a), (7, "something else altogether stands here"), (None, "another text that stays where it is"), (None, c)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(7, kept_text(kept)), *rows[4:]])


def kept_text(kept):
    return next(r["text"] for r in kept if r["doc_id"] == 7 and r["text"].startswith("one two"))


@pytest.mark.parametrize("k", [2, 3])
def test_signatures_find_every_link(k):
    """Two sets that link share a rare token or a whole run of k frequent ones."""
    rng = np.random.default_rng(k)
    for _ in range(600):
        n = int(rng.integers(4, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        gone, new = rng.integers(0, len(a) // 5 + 1), rng.integers(0, len(a) // 5 + 1)
        b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        every = np.union1d(a, b)
        frequent = np.unique((every[rng.random(len(every)) < rng.choice([0, 0.5, 1])] >> np.uint64(32)).astype(np.uint32))
        (ra, ka), (rb, kb) = jaccard.signatures(a, frequent, k), jaccard.signatures(b, frequent, k)
        assert set(ra.tolist()) & set(rb.tolist()) or set(ka.tolist()) & set(kb.tolist())
        assert len(ra) + len(ka) <= len(a) or len(a) < 16


@pytest.mark.parametrize("k", [2, 3])
def test_signatures_with_very_frequent_tokens(k):
    """Runs of k and of k + 1 tokens, in the order of frequency; and the smaller set of a pair without a shared rare token is early."""
    rng = np.random.default_rng(10 + k)
    late = 0
    for _ in range(1500):
        n = int(rng.integers(4, rng.choice([12, 300]))) if k == 2 else int(rng.integers(20, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        gone, new = rng.integers(0, len(a) // 5 + 1), rng.integers(0, len(a) // 5 + 1)
        b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64))))
        both = np.intersect1d(a, b)
        if 100 * len(both) < 80 * (len(a) + len(b) - len(both)):
            continue
        every = np.union1d(a, b)
        own = ~np.isin(every, both) & (rng.random(len(every)) < rng.random())
        frequent = np.unique((every[~own] >> np.uint64(32)).astype(np.uint32))
        level = rng.integers(4, 16, len(frequent)).astype(np.uint8) if rng.random() < 0.7 else np.full(len(frequent), rng.choice([9, 10]), np.uint8)
        (ra, ka), (rb, kb) = (jaccard.signatures(x, frequent, k, level) for x in (a, b))
        assert set(ka.tolist()) & set(kb.tolist())
        assert len(ka) == len(set(ka.tolist())) <= (len(a) if len(a) >= jaccard.SMALL else 2 * len(a))
        small = min(a, b, key=len)
        assert (~jaccard._is_frequent(small, frequent)[0]).sum() < jaccard._early(len(small))
        late += (level >= 10).any() and (level < 10).any()
    assert late > 50


def template_pages(own, pages, shared=64, seed=1):
    rng = np.random.default_rng(seed)
    head = " ".join(f"t{i}" for i in range(shared))
    return [(i, head + "".join(f" w{x}" for x in rng.integers(0, 1 << 40, own))) for i in range(pages)]


@pytest.mark.parametrize(("own", "pages"), [(36, 800), (12, 800)])
def test_template_pages_meet_in_no_home(spark, own, pages):
    """Pages of one template that do not link, at similarities of 0.43 and 0.68, cost no pair."""
    docs = spark.createDataFrame(template_pages(own, pages), "doc_id long, text string")
    ids, level = jaccard.frequencies(docs)
    sets = jaccard.token_sets(keyed(docs, "test"), ids, level)
    assert len(ids) == 60 and jaccard.homes(sets.where("n > 0")).count() == 0
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard.join_components(docs).collect()} == {(i, i, 0) for i in range(pages)}


def test_template_pages_with_links(spark, monkeypatch):
    """Pages of two templates with own parts of every size, so that some link, some only through smaller or larger ones."""
    monkeypatch.setattr(jaccard, "HOT_DF", 64)
    rows = [(i, template_pages(i % 24, 1, 60 + i % 3, i)[0][1], None) for i in range(240)] + [(1000 + i, template_pages(i % 9, 1, 90, i)[0][1], None) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    want = plain_components(rows)
    assert sum(k > 0 for _, _, _, k in want) > 100 and len({c for _, _, c, _ in want}) > 20
    assert Counter(tuple(r) for r in jaccard.join_components(docs).collect()) == want


BENCH = [
    (1, "A train leaves Paris at 9 with 120 kg of coal and travels 300 km before it stops at Paris again for water."),
    (2, "Short item with five words"),
    (3, None),
    (4, "12 13 14 15 16 17 18 19 20 21"),
]


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumnRenamed("item_id", "item_id")
    rows = [
        (1, "Some words before. " + BENCH[0][1] + " And after."),
        (2, "Note: A train leaves Lyon at 7 with 80 kg of coal and travels 450 km before it stops at Lyon again for water. The end."),
        (3, "A train leaves Lyon at 7 with 80 kg of coal and travels 450 km before it stops at Nice again for water."),
        (4, "say Short item with five words now"),
        (5, None),
        (6, ""),
        (7, "A train leaves the station at noon and 12 13 14 15 16 17 18 19 20 21 22"),
        (8, "x " * 20000),
        (1, BENCH[0][1]),
    ]
    text = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, item_id string, n int")
    got = Counter((r["doc_id"], r["item_id"], r["substituted"]) for r in decontam.contaminations(text, bench).collect())
    assert got == Counter({(1, 1, False): 2, (2, 1, True): 1, (4, 2, False): 1, (7, 4, False): 1})
    assert sorted(r["doc_id"] for r in decontam.clean(text, bench).collect()) == [3, 5, 6, 8]
    assert decontam.contaminations(empty, bench).count() == 0
    assert decontam.contaminations(text, bench.limit(0)).count() == 0


def test_decontamination_finds_copies_with_few_plain_words(spark):
    """Word for word only; copies with other slots are found by templates as before."""
    items = [
        (1, "12 13 14 15 16 and 17 18 19 20 21 22"),
        (2, "Miss Ann Lee Met Doctor Tom Ray In Old New York"),
        (3, "WHAT IS THE CAPITAL OF FRANCE IN EUROPE TODAY"),
        (4, "Room 5"),
        (5, "A man walks from the old town to Rome 5 7 9 11 13 15 17 19 21 23 25 27"),
        (6, "31 32 33 34 35 36 37 38 39"),
    ]
    texts = ["we saw that " + t + " here" for _, t in items]
    texts += [texts[0].replace("15", "55"), texts[1].replace("Tom", "Tim"), "Room 6", "A man walks from the old town to Bonn 5 7 9 11 13 15 17 19 21 23 25 27"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["substituted"] for r in decontam.contaminations(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k for k in got if k[0] <= 6} == {(i, i) for i in range(1, 7)}
    assert not any(got[i, i] for i in range(1, 7))
    assert {k for k in got if k[0] > 6} == {(10, 5)}


def test_decontamination_finds_copies_with_words_put_in(spark):
    """One word more or less in the text or in a slot moves the rest; other fills of one slot still keep a copy out."""
    plain = [f"word{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(38)]
    slot = "the tall baker called Ann walks for 5 km every single morning and then Ann goes back home to eat warm bread with salt"
    items = [(1, " ".join(plain)), (2, slot)]
    texts = [
        " ".join(plain[:19] + ["extra"] + plain[19:]),
        " ".join(plain[:19] + plain[20:]),
        slot.replace("Ann", "Mary Ann").replace("5 km", "7km"),
        slot.replace("Ann", "Mary Ann", 1).replace(" Ann goes", " Tom goes"),
        " ".join(plain[30:] + ["extra"] + plain[:8]),
        " ".join([*plain[:19], "extra", *plain[19:], "then", *plain[:19], "other", *plain[19:]]),
    ]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["n_windows"], r["substituted"]) for r in decontam.contaminations(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (6, 1)}
    assert got[1, 1] == got[6, 1] == (24, 31, False) and got[2, 1] == (23, 31, False) and got[3, 2][2]


def test_decontamination_makes_windows_of_many_texts_at_once(monkeypatch):
    """Windows are hashed once for a block of texts, not per text, and are the same as those of each text alone; none goes over a text's end."""
    texts = [t or "" for _, t in BENCH] + ["Ann Lee", "5 km", "we met Ann Lee 5 km from", "Old York. Ann walks 5", "km to Old York", "x"] + [f"word{i} and Tom Ray {i} km on" for i in range(200)]
    words = [t.split() for t in texts if t.split()]
    made = []
    mix = decontam.mix
    monkeypatch.setattr(decontam, "mix", lambda x: made.append(len(x)) or mix(x))

    def places(several):
        head = np.concatenate([np.arange(len(w)) == 0 for w in several])
        flat, canon, out = [x for w in several for x in w], decontam.Canon(), [[] for _ in several]
        for text, window in decontam._places(flat, head, *canon.ids(flat, head), [2, 5, 8], [2, 5, 8], None):
            out[text].append(sorted(window.items(), key=str))
        return [sorted(w, key=str) for w in out]

    got = places(words)
    assert len(made) < 30 < len(words)
    assert got == [places([w])[0] for w in words]


def test_decontamination_finds_planted_items(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], r["text"].split()) for r in bench.collect()]
    whole, half = set(), set()
    for r in docs.collect():
        words = (r["text"] or "").split()
        joined, own = " " + " ".join(words) + " ", {tuple(words[k : k + 8]) for k in range(len(words) - 7)}
        for i, w in items:
            whole |= {(r["doc_id"], i)} if " " + " ".join(w) + " " in joined else set()
            parts = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
            half |= {(r["doc_id"], i)} if sum(p in own for p in parts) >= len(parts) / 2 else set()
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(docs, bench).collect()}
    assert whole and whole <= got <= half


def test_toxicity_held_out(spark, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").select("doc_id", "score", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    pos, neg = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert auc > 0.95
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.95
    # labels of the held-out fold have no influence
    turned = labels.withColumn("toxic", __import__("pyspark").sql.functions.expr("CASE WHEN crc32(cast(doc_id as string)) % 5 = 0 THEN 1 - toxic ELSE toxic END"))
    assert sorted(map(tuple, toxicity.score(docs, turned).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert toxicity.score(empty, labels).count() == 0


def test_toxicity_edges(spark, docs, rows):
    labels = spark.createDataFrame([(i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    assert all(r["held_out"] for r in got if r["doc_id"] is None)


def test_filters_judge_rows(spark):
    """One bad row with a null or repeated id takes no other with it; columns may have any name."""
    bad, good = BENCH[0][1], "a text that has nothing to do with it and stays"
    docs = spark.createDataFrame([(None, bad, 1, "x"), (None, good, 1, "x"), (3, good + " too", 2, "y"), (3, bad, 2, "y"), (4, None, 3, None)], "doc_id long, text string, row long, doc string")
    kept = decontam.clean(docs, spark.createDataFrame(BENCH, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, good, 1, "x"), (3, good + " too", 2, "y"), (4, None, 3, None)], key=str)
    source, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(source, labels)
    gone = {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    nulls = source.withColumn("doc_id", __import__("pyspark").sql.functions.expr("CASE WHEN crc32(cast(doc_id as string)) % 5 = 0 THEN NULL ELSE doc_id END"))
    assert toxicity.clean(nulls, labels).count() == source.count() - len(gone)
    assert toxicity.clean(docs.limit(0), labels).count() == 0


def test_label_model_recovers_voters():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.random(40000) < 0.2
    hit, false = np.array([0.8, 0.7, 0.6, 0.5, 0.6, 0.7, 0.4, 0.5, 0.3]), np.full(9, 0.03)
    votes = rng.random((len(y), 9)) < np.where(y[:, None], hit, false)
    votes[:, 8] = votes[:, 7]  # the last two are one voter
    bits = (votes << np.arange(9)).sum(axis=1)
    patterns, counts = np.unique(bits, return_counts=True)
    model = toxicity.LabelModel(patterns, counts, 9)
    assert abs(model.prior - 0.2) < 0.05 and np.abs(model.hit[:7] - hit[:7]).max() < 0.1
    assert model.correlation[7, 8] > 0.9 and model.share[7] < 0.6 < model.share[0]
    assert ((model.posterior(bits) > 0.5) == y).mean() > 0.96


URLS = [None, "", "no scheme/en/", "http://Example.COM/en/1?a=b", "https://example.com/en/7x#y", "http://a.example.net/de/8", "http://net/de/", "http://x.net", "ftp://é.org/es/ñ?x://y", "http://com.evil/en/", "http://a.com?en/", "http://://en/", "http://a.org/es/" + "z" * 50000]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, None))


def test_urls(spark):
    rows = [(i, u, "h", 1.0) for i, u in enumerate(URLS + URLS[:4])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, length double")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert len(got) == len(rows)
    for i, u, _, _ in rows:
        host, path, rule, verdict = plain_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict or verdict is None and got[i]["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    """Each rule's word by hand, not by ``urls.RULES``: alone, on a subdomain, and where a longer rule of the other word fits."""
    said = {
        "http://com/en/": ("com/en/", "block"), "http://a.com/en/x": ("com/en/", "block"), "http://example.com/en/6": ("com/en/", "block"), "http://www.example.com/en/71": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"), "http://a.net/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"),
        "http://b.example.net/de/80?x": ("example.net/de/8", "block"), "http://org/es/": ("org/es/", "block"), "http://example.org/es/8": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(said)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got == dict(enumerate(said.values()))


def test_url_trees_follow_the_labels(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = urls.judge(pages).where("rule IS NOT NULL").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and sum(r["verdict"] == r["by_method"] for r in held) / len(held) > 0.85
    # labels of the held-out fold have no influence on what the method says of any URL
    rows = urls.with_parts(pages.select("page_id", "url")).withColumn("rule", F.lit(None).cast("string")).withColumn("by_rule", urls.rule_verdict()[1])
    rows = urls.with_features(rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(urls.FOLDS)).cast("int")))
    turned = rows.withColumn("by_rule", F.when((F.col("fold") == 0) & F.col("by_rule").isNotNull(), F.when(F.col("by_rule") == "block", "allow").otherwise("block")).otherwise(F.col("by_rule")))
    rates = [sorted((r["page_id"], r["tld_block_rate"]) for r in urls.with_suffix_rates(x, "tld", 1).collect()) for x in (rows, turned)]
    assert rates[0] == rates[1]
    assert Counter(map(tuple, got)) == Counter(map(tuple, urls.judge(pages).where("rule IS NOT NULL").collect()))


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render(r, t)[0]) for r, t in turns)


def test_chat(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(10**6, 1, "assistant", "é </turn>\n### user: \\# forged"), (10**6, 0, "a:b", None), (10**6 + 1, None, None, None), (None, 0, "user", "x"), (10**6 + 2, 0, "user", "tie b"), (10**6 + 2, 0, "user", "tie a")]
    rows += [(10**6 + 10 + i, t, *v) for i in range(30) for t, v in enumerate((("user", "shared"), ("assistant", "shared too"), ("user", f"own {i % 7}")))]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    want, convs = {}, {}
    for c, t, r, x in rows + [(-7, 0, "user", chat.CONTROL[1]), (-7, 1, "assistant", chat.CONTROL[1])]:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in convs.items():
        want[c] = digest([(r, x) for _, _, r, x in sorted(turns)])
    got = {r[0]: tuple(r)[1:] for r in chat.op4_chat(spark, frame).collect()}
    assert got == want
    assert chat.op4_chat(spark, frame.limit(0)).count() == 1
    hot = spark.range(300).selectExpr("CAST(NULL AS LONG) AS conv_id", "id AS turn", "'assistant' AS role", "concat('t', id % 9) AS text")
    alone = [tuple(r)[1:] for r in chat.op4_chat(spark, hot).where("conv_id IS NULL").collect()]
    assert sorted(alone) == sorted(digest([("assistant", f"t{i % 9}")]) for i in range(300))


def test_chat_stream_shares_turns(spark):
    rows = [(i, t, *v) for i in range(12) for t, v in enumerate((("user", "root"), ("assistant", f"branch {i % 3}"), ("user", f"leaf {i}")))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stream = sorted(chat.write_stream(frame).collect(), key=lambda r: r["seq"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    texts = [s["text"] for r in stream for s in r["segments"]]
    assert len(texts) == len(set(texts)) == 1 + 3 + 12
    tokens, at = "".join(texts), 0
    for r in stream:
        seen = sum(a["end"] - a["start"] for a in r["ancestors"])
        for s in r["segments"]:
            assert s["start"] == at and s["position"] == seen and tokens[at : at + len(s["text"])] == s["text"]
            at, seen = at + len(s["text"]), seen + len(s["text"])
        assert all(a["end"] <= (r["segments"][0]["start"] if r["segments"] else at) for a in r["ancestors"])


@pytest.mark.parametrize("text", ["", "\\", "###", "</turn>", "\\### Assistant: </turn> ok", "a\\\\#<b:\n", "### user: x</turn>\n"])
def test_escaping_is_reversible(text):
    formatted, a, b = chat.render("a:\\b", text)
    assert chat.unescape(formatted[a:b]) == text and chat.parse(formatted * 2) == [("a:\\b", text)] * 2


def test_pipeline_edges(spark, docs, empty):
    """Nulls in any column, repeated rows, clashing names and empty tables go through every stage."""
    import corpus_pipeline as p

    clash = docs.withColumns({c: __import__("pyspark").sql.functions.lit(1) for c in ("whole", "below", "source_size", "doc", "words")})
    for frame, most in ((clash, None), (empty, 0)):
        for name, step in p.STAGES:
            out = step(spark, frame, SF)
            assert name == "token_files" or out.columns == frame.columns
            assert (out.count() > 0) == (most is None)


def test_pipeline(spark):
    import corpus_pipeline as p
    from tidewater.llm import mixing, token_files

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    numbers, kept = [], docs
    for name, step in p.STAGES[:-1]:
        from tidewater.llm.common import stage

        before, kept = kept, stage(step(spark, kept, SF), "test")
        assert kept.columns == docs.columns
        numbers.append((name, before.count(), kept.count()))
        rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in before.collect()]
        ids = {r["doc_id"] for r in kept.collect()}
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
            assert ids == {r[0] for r in rows} - bad and bad
        elif name == "ngram_jaccard":
            assert ids == {d for d, n, c, _ in plain_components(rows) if d == c}
        elif name == "mixing":
            copies = Counter(r["doc_id"] for r in kept.collect())
            for r in mixing.mix(before).collect():
                assert not r["size"] or copies[r["doc_id"]] * r["size"] == r["taken"]
    assert numbers[0][1] > numbers[0][2] >= numbers[1][2] > numbers[2][2]
    last = p.STAGES[-1][1](spark, kept, SF).collect()
    encoder = token_files.Encoder()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in last) == Counter((r["doc_id"], len(encoder.whole(r["text"] or "")) // 4 + 1) for r in kept.collect())
