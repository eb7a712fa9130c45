"""Document fingerprints from closed syncmers, with DataFrame functions alone.

A text is a sequence of tokens: runs of up to 16 characters without white space, and
single characters of scripts that put no spaces between words. Of every K tokens in a row
(a k-mer), the k-mer is chosen if the token with the smallest hash among them (its inner
substring of one token) lies at either edge: a closed syncmer. The choice looks at nothing
but the k-mer, so equal passages have equal anchors wherever they stand, and an edit only
touches the k-mers over it. In a text of fewer than K tokens every token is an anchor.

The fingerprint is the KEPT smallest anchor hashes (40 bits each, in hex, ascending):
a sketch of the set of anchors. The likeness of two fingerprints estimates the Jaccard
likeness of the sets from the KEPT smallest of their union; two empty texts are alike (1),
an empty and a nonempty one not (0).

Anchors also come with their place in tokens, which lets passages be matched by position: two
anchors with one hash are so far apart, and a passage that two texts share has all its anchors
equally far apart. ``placed`` samples a text's anchors with their places: the KEPT smallest,
and in longer texts all those below a fixed part of the hashes, so the sample grows with the
text. ``agreement`` is the share of two samples' anchors that both texts have at the same
place, or as far apart as another of them: chance matches of single k-mers don't count.

Null texts count as empty. Equal texts have equal fingerprints. Repeated rows each get
their row. doc_ids order the documents, nulls last; rows with one doc_id (or none) go by
their text's hash, descending. Neighbours are sought in ranges of about as many rows each:
ranges lie between quantiles of doc_id, and a doc_id with more rows than a range, null among
them, is split between quantiles of the hash, equal texts by turns. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, KEPT = 4, 64
#: Samples with places hold one in PART of a text's anchors, and KEPT at least.
PART = 32
#: Rows per range of doc_ids when neighbours are sought, and ranges at most (then larger).
BUCKET_ROWS, BUCKETS = 8_000, 1 << 14
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_TOKEN = rf"[{_ALONE}]|[^\s{_ALONE}]{{1,16}}+"


def _hashes(df: DataFrame, text: str) -> DataFrame:
    """Adds h: the token hashes of a text column."""
    return df.withColumn("h", F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))


def _chosen(h: Column, i: Column) -> Column:
    """Whether the k-mer from place i is a closed syncmer."""
    at = lambda j: F.get(h, i + j)
    return F.least(at(0), at(K - 1)) <= F.least(*[at(j) for j in range(1, K - 1)])


def _kmer(h: Column, i: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(K)]), 24)


def anchors(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds ``out``: array of (place in tokens, hash) of the text's closed syncmers."""
    df = _hashes(df, text_col)
    places = F.when(F.size("h") >= K, F.filter(F.sequence(F.lit(0), F.size("h") - K), lambda i: _chosen(F.col("h"), i))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("places", places)
    few = F.transform("h", lambda x, i: F.struct(i.alias("place"), F.shiftrightunsigned(x, 24).alias("hash")))
    found = F.transform("places", lambda i: F.struct(i.alias("place"), _kmer(F.col("h"), i).alias("hash")))
    return df.withColumn(out, F.when(F.size("h") >= K, found).otherwise(few)).drop("h", "places")


def _pack(hash_: Column, place: Column) -> Column:
    """A hash of 40 bits and a place (modulo 2^24) as one long, in order of (hash, place)."""
    return F.shiftleft(hash_, 24).bitwiseOR(F.pmod(place.cast("long"), F.lit(1 << 24))).bitwiseXOR(F.lit(-(1 << 63)))


def _hash_of(x: Column) -> Column:
    return F.shiftrightunsigned(x.bitwiseXOR(F.lit(-(1 << 63))), 24)


def _place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << 24) - 1))


def _first_of_hash(packed: str) -> Column:
    """Of an ascending array, the first entry of every hash."""
    return F.filter(packed, lambda x, i: (i == 0) | (_hash_of(F.get(F.col(packed), i - 1)) != _hash_of(x)))


def _sample_size(packed: str) -> Column:
    low = F.lit(((1 << 63) // PART << 1) - (1 << 63))
    return F.greatest(F.lit(KEPT), F.size(F.filter(packed, lambda x: x < low)))


def placed(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds ``out``: a sample of a text's distinct anchors, each with its first place, packed
    and ascending: the KEPT smallest hashes, or all of the lowest 1/PART where those are more."""
    df = _hashes(df, text_col)
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("h") - K, F.lit(0))), lambda i: _chosen(F.col("h"), i))
    df = df.withColumn("places", places)
    many = F.transform("places", lambda i: _pack(_kmer(F.col("h"), i), i))
    few = F.transform("h", lambda x, i: _pack(F.shiftrightunsigned(x, 24), i))
    df = df.withColumn("every", F.sort_array(F.when(F.size("h") >= K, many).otherwise(few)))
    df = df.withColumn("every", _first_of_hash("every"))
    return df.withColumn(out, F.slice("every", F.lit(1), _sample_size("every"))).drop("h", "places", "every")


def hashes_of(sample: Column) -> Column:
    """The fingerprint's hashes: the KEPT smallest of a sample."""
    return F.transform(F.slice(sample, 1, KEPT), _hash_of)


def sketch(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds ``out``: the KEPT smallest anchor hashes of a text column, ascending."""
    return placed(df, text_col, out).withColumn(out, hashes_of(F.col(out)))


def agreement(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: of the anchors that two samples stand for together, the share that both
    texts have, at one place or as far apart as another such anchor; 1 for two empty texts."""
    df = df.withColumn("both", F.sort_array(F.concat(a, b)))
    df = df.withColumn("least", _first_of_hash("both"))
    df = df.withColumn("n", F.least(F.size("least"), _sample_size("least")))
    df = df.withColumn("bound", F.get("least", F.col("n") - 1))
    twice = lambda x, i: _hash_of(F.get(F.col("both"), i - 1)).eqNullSafe(_hash_of(x)) & (_hash_of(x) <= _hash_of(F.col("bound")))
    apart = F.transform("both", lambda x, i: F.when(twice(x, i), _place_of(x) - _place_of(F.get(F.col("both"), i - 1))))
    df = df.withColumn("apart", F.sort_array(F.array_compact(apart)))
    near = lambda d, i: F.get(F.col("apart"), i).eqNullSafe(d)
    good = F.size(F.filter("apart", lambda d, i: (d == 0) | near(d, i - 1) | near(d, i + 1)))
    return df.withColumn(out, F.when(F.col("n") == 0, F.lit(1.0)).otherwise(good / F.col("n")).cast("double")).drop("both", "least", "n", "bound", "apart")


def text_of(sk: Column) -> Column:
    """A sketch as a string: 10 hex digits for each hash."""
    return F.array_join(F.transform(sk, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: the estimated Jaccard likeness of two sketches, 0 to 1."""
    df = df.withColumn("least", F.slice(F.sort_array(F.array_union(a, b)), 1, KEPT))
    shared = F.size(F.array_intersect(F.array_intersect("least", a), b))
    return df.withColumn(out, F.when(F.size("least") == 0, F.lit(1.0)).otherwise(shared / F.size("least")).cast("double")).drop("least")


def matches(a: Column, b: Column) -> Column:
    """Matched anchors of two anchor arrays: (place, other place); equal differences of
    places along a run mark a passage that was moved as a whole."""
    hit = lambda x: F.filter(b, lambda y: y["hash"] == x["hash"])
    return F.flatten(F.transform(a, lambda x: F.transform(hit(x), lambda y: F.struct(x["place"].alias("place"), y["place"].alias("other")))))


def _below(bounds: list[int], x: Column) -> Column:
    """How many of some ascending numbers are below a column, sought in two steps."""
    width = max(1, round(len(bounds) ** 0.5))
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not parts:
        return F.lit(0)
    ends = F.from_json(F.lit(json.dumps([p[-1] for p in parts])), "array<long>")
    inside = F.from_json(F.lit(json.dumps(parts)), "array<array<long>>")
    before = F.size(F.filter(ends, lambda y: y < x))
    return F.when(before >= len(parts), len(bounds)).otherwise(before * width + F.size(F.filter(F.get(inside, before), lambda y: y < x)))


def dealt_by_range(df: DataFrame, key: str) -> DataFrame:
    """The rows (key, text) dealt into ranges of a long key (bucket), and once more (copy = 1)
    the row that follows each range's last in descending order, after the whole's last its first.

    Within a bucket, ordered by (copy, key descending, ord descending), every row's next is the
    next row. Lists of bounds have BUCKETS entries at most, about.
    """
    spark = df.sparkSession
    n = df.count()
    per = max(BUCKET_ROWS, -(-n // BUCKETS))
    points = [i / (n // per) for i in range(1, n // per)]
    bounds = df.agg(F.percentile_approx(key, points, max(10_000, 8 * len(points))).alias("b")).first()["b"] if points else []
    # Keys with more rows than a range: at most n / per of them.
    many = {r[key]: r["n"] for r in df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per).collect()}
    bounds = sorted({*(bounds or []), *(x for v in many if v is not None for x in (v - 1, v) if x >= -(1 << 63))})
    # ord orders the rows of a key; turn tells equal texts apart, in any way.
    df = df.withColumn("ord", F.shiftright(F.xxhash64("text"), 20))
    rows = df.withColumn("turn", F.col("ord") * (1 << 19) + F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 19) - 1)))
    place = F.coalesce(_below(bounds, F.col(key)), F.lit(-1)) if bounds else F.when(F.col(key).isNull(), -1).otherwise(0)
    rows = rows.withColumn("bucket", F.when(F.col(key).isNull(), -1).otherwise(place).cast("long") * (1 << 20))
    if many:
        slots = -(-max(many.values()) // per)
        keys = F.broadcast(spark.createDataFrame([(k, -(-c // per)) for k, c in many.items()], "many long, slots int"))
        cuts = rows.join(keys, F.col(key).eqNullSafe(F.col("many"))).groupBy("many", "slots").agg(F.percentile_approx("turn", [i / slots for i in range(1, slots)], max(10_000, 8 * slots)).alias("cuts"))
        cuts = cuts.select("many", F.expr(f"transform(sequence(1, slots - 1), i -> element_at(cuts, CAST(i * {slots} / slots AS INT)))").alias("cuts")).collect()  # n / per numbers at most
        cuts = F.broadcast(spark.createDataFrame([(r["many"], r["cuts"]) for r in cuts], "many long, cuts array<long>"))
        rows = rows.join(cuts, F.col(key).eqNullSafe(F.col("many")), "left")
        rows = rows.withColumn("bucket", F.col("bucket") + F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("turn"))), F.lit(0))).drop("many", "cuts")
    rows = rows.drop("turn")
    heads = rows.groupBy("bucket").agg(F.max(F.struct(key, "ord")).alias("head"))
    down = Window.orderBy(F.desc("bucket"))
    last = down.rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(down), F.first("head").over(last)).alias("head"))
    heads = F.broadcast(heads.select(F.col("bucket").alias("above"), F.col(f"head.{key}").alias("hk"), F.col("head.ord").alias("ho")))  # three numbers a range
    copy = df.join(heads, df[key].eqNullSafe(F.col("hk")) & (df["ord"] == F.col("ho")))
    copy = copy.groupBy("above").agg(F.first(key, ignorenulls=False).alias(key), F.first("text").alias("text"), F.first("ord").alias("ord"))
    return rows.withColumn("copy", F.lit(0)).unionByName(copy.withColumnRenamed("above", "bucket").withColumn("copy", F.lit(1)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_anchors (kept in the fingerprint), and by places the agreement with the
    edited and with the next text: placed_edited, placed_next."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = placed(dealt_by_range(d, "doc_id"), "text", "at")
    w = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("ord"))
    d = d.withColumn("next_text", F.lead("text").over(w)).withColumn("next_at", F.lead("at").over(w)).filter("copy = 0")
    third = F.floor(F.length("text") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)))
    d = placed(d, "edited", "edited_at")
    d = agreement(agreement(d, "at", "edited_at", "placed_edited"), "at", "next_at", "placed_next")
    d = d.withColumns({"sk": hashes_of(F.col("at")), "esk": hashes_of(F.col("edited_at")), "next_sk": hashes_of(F.col("next_at"))})
    d = likeness(likeness(d, "sk", "esk", "near_edited"), "sk", "next_sk", "near_next")
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("sk")).alias("fingerprint"),
        text_of(F.col("esk")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("sk").alias("n_anchors"),
        "placed_edited",
        "placed_next",
    )
