r"""Personal data: base spans by pattern, and terms that reveal them by co-occurrence.

Base kinds are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
numbers. The method then asks which words give a protected value away: over the whole
corpus it counts how many documents hold a term together with a value, and how many
hold the term at all. A term discloses the value if the share of its documents that
hold the value is ``SHARE`` or more, in ``CONTEXTS`` different texts or more, and that is
``BITS`` above the share of all documents that hold the value. Every occurrence of a
disclosing term in a document that holds its value is a span of kind ``term``; ``sanitise``
generalises these, or removes them where the share is ``REMOVE`` or more.

A term of a share of ``SHARE`` stands in at most holders / ``SHARE`` documents, so common
words are left out before a document's terms meet its values, and values of fewer than
``CONTEXTS`` texts have no part in it: the rows made are those of rare terms only.

Everything is DataFrame functions: places come from splitting a text by a
pattern and adding up the lengths of pieces and matches. Patterns are possessive
and start only where a run of their characters does (``\G`` lets a match start
where the last one ended), so they match what the plain patterns match, in
linear time and without recursion. Places are added up in runs of ``RUN`` matches, so
that no array grows by one element a match.

Defined results: null text is empty; no spans give zero counts, the digest of
the empty string and an empty list; repeated rows stay repeated, and count as so many
documents but as one text; an empty table gives no rows; extra columns are carried aside and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, scratch, small_join, stage

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"
SHARE, CONTEXTS, BITS, REMOVE = 0.5, 2, 3.0, 0.9
RUN = 256


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def places(text: Column, pattern: str) -> Column:
    """array<struct<s,e,v>> of leftmost non-overlapping matches, in code points from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("v")))
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def step(a, x):
        s = a["at"] + x["gap"]
        e = s + F.length(x["v"])
        return F.struct(F.coalesce(e, s).alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))).alias("out"))

    def moved(a, part):
        out = F.transform(part["out"], lambda x: F.struct((a["at"] + x["s"]).alias("s"), (a["at"] + x["e"]).alias("e"), x["v"].alias("v")))
        return F.struct((a["at"] + part["at"]).alias("at"), F.concat(a["out"], F.array(out)).alias("out"))

    def added(pieces):
        starts = F.sequence(F.lit(1), F.size(pieces), F.lit(RUN))
        runs = F.transform(starts, lambda i: F.aggregate(F.slice(pieces, i, RUN), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))
        return F.flatten(F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,v:string>>>").alias("out")), moved)["out"])

    return F.filter(_bound(both, added), lambda x: x["v"].isNotNull())


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))

    def step(a, i):
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(bare) <= 3) & (F.substring(bare, 1, 3).cast("int") <= 255)


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))


def base_spans(text: Column) -> Column:
    """array<struct<kind,s,e,v>> of the base kinds, by kind, then start."""
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    length = lambda x: F.length(_digits(x["v"]))
    of = {
        "email": F.when(F.instr(text, "@") > 0, places(text, EMAIL)).otherwise(none),
        "ip": F.filter(F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), places(text, IP)).otherwise(none), lambda x: F.forall(F.split(x["v"], r"\."), _byte)),
        "card": F.filter(F.when(text.rlike(CARD), places(text, CARD)).otherwise(none), lambda x: (length(x) <= 19) & _luhn(x["v"])),
        "phone": F.filter(F.when(F.instr(text, "+") > 0, places(text, PHONE)).otherwise(none), lambda x: length(x).between(9, 15)),
    }
    return F.concat(*[_named(of[k], k) for k in KINDS])


def disclosing(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, term, share) of the terms that give a value away, and (row, entity, term) of the documents
    that hold both. ``rows`` has row, base spans and the text of documents with spans; every whole text of ``docs`` is counted."""
    entity = lambda x: F.concat(x["kind"], F.lit(":"), F.lower(x["v"]))
    held = rows.where("text IS NOT NULL").select("row", F.xxhash64("text").alias("h"), F.explode(F.array_distinct(F.transform("base", entity))).alias("entity"))
    values = held.groupBy("entity").agg(F.count("*").alias("holders"), F.count_distinct("h").alias("texts")).where(F.col("texts") >= CONTEXTS)
    values = stage(values.select(F.col("entity").alias("_v"), "holders"), "pii-values")
    known = stage(small_join(held, values, F.col("entity") == F.col("_v")).drop("_v"), "pii-known")
    most = stage(known.groupBy(F.col("row").alias("_r")).agg(F.max("holders").alias("most")), "pii-most")
    words = lambda text: F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    own = small_join(rows.select("row", "text"), most, F.col("row") == F.col("_r")).select("row", "most", F.explode(words(F.regexp_replace("text", EMAIL, " "))).alias("term"))
    wanted = stage(own.groupBy(F.col("term").alias("_w")).agg(F.count("*").alias("n")).where(F.col("n") >= CONTEXTS).select("_w"), "pii-wanted")
    everywhere = docs.select(F.explode(words(F.col("text").cast("string"))).alias("t"))
    if wanted.count() <= BROADCAST_ROWS:  # else all terms are counted first
        everywhere = everywhere.join(F.broadcast(wanted), F.col("t") == F.col("_w"), "left_semi")
    counts = stage(everywhere.groupBy("t").agg(F.count("*").alias("documents")).where(F.col("documents") >= CONTEXTS), "pii-counts")
    rare = small_join(own, counts, (F.col("term") == F.col("t")) & (F.col("documents") * SHARE <= F.col("most"))).select("row", "term", "documents")
    met = rare.join(known, "row").where(F.col("documents") * SHARE <= F.col("holders"))
    met = stage(met.select("row", "h", "entity", "term", "documents", "holders"), "pii-together")
    pairs = met.groupBy("entity", "term", "documents", "holders").agg(F.count("*").alias("together"), F.count_distinct("h").alias("texts"))
    share = F.least(F.lit(1.0), F.col("together") / F.col("documents"))
    bits = F.log2(F.col("share") * rows.count() / F.col("holders"))
    told = pairs.where(F.col("texts") >= CONTEXTS).withColumn("share", share).where((F.col("share") >= SHARE) & (bits >= BITS))
    return told.select("entity", "term", "share"), met.select("row", "entity", "term")


def find(docs: DataFrame) -> DataFrame:
    """Per document row: doc (all its columns), base spans, disclosing terms (s, e, share)."""
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    with scratch(docs.sparkSession) as keep:
        rows = docs.select(F.struct(*docs.columns).alias("doc")).select("doc", base_spans(text).alias("base"))
        rows = rows.withColumn("text", F.when(F.size("base") > 0, text)).withColumn("row", F.monotonically_increasing_id())
        rows = keep(stage(rows, "pii-base"))
        told, met = disclosing(rows.select("row", "base", "text"), docs)
        told = stage(told.select(F.col("entity").alias("_e"), F.col("term").alias("_w"), "share"), "pii-told")
        hits = small_join(met, told, (F.col("entity") == F.col("_e")) & (F.col("term") == F.col("_w"))).groupBy("row", "term").agg(F.max("share").alias("share"))
        per = keep(stage(hits.groupBy(F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told")), "pii-hits"))
    found = small_join(rows, per, F.col("row") == F.col("_row"), "left")
    # e-mail addresses are matched along, so that words within them are no terms
    inside = lambda t: F.exists("base", lambda b: (t["s"] < b["e"]) & (b["s"] < t["e"]))
    terms = F.filter(places(F.col("text"), f"{EMAIL}|{TERM}"), lambda t: F.map_contains_key("told", F.lower(t["v"])) & ~inside(t))
    terms = F.transform(terms, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), F.element_at("told", F.lower(t["v"])).alias("share")))
    none = F.array().cast("array<struct<s:int,e:int,share:double>>")
    return found.select("doc", "base", F.coalesce(F.when(F.col("told").isNotNull(), terms), none).alias("terms"))


def op7_pii(docs: DataFrame) -> DataFrame:
    line = lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    base = F.concat_ws(",", F.transform("base", line))
    more = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"].cast("string"), x["e"].cast("string")))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.concat_ws(",", F.concat(F.transform("base", line), more))
    return find(docs.select("doc_id", "text")).select(F.col("doc.doc_id").cast("long").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """All columns, with base spans in ``text`` replaced by their kind and disclosing
    terms by [TERM], or by nothing where their share is REMOVE or more. Of spans
    that overlap, the first to start counts, then the longest; null text stays null."""
    spans = F.concat(
        F.transform("base", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("z"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("to"))),
        F.transform("terms", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("z"), F.when(x["share"] >= REMOVE, "").otherwise("[TERM]").alias("to"))),
    )
    text = F.col("doc.text").cast("string")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.when(x["s"] < a["at"], a).otherwise(F.struct((-x["z"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), x["to"]).alias("out")))
    clean = F.aggregate(F.sort_array(spans), begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    clean = F.when(text.isNotNull(), clean)
    return find(docs).select(*[clean.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
