"""URL filter: listed rules, and association rules mined from the URLs they decide.

A URL's tokens are its host's labels and domain endings, its path's segments, their words
and its query's names. URLs that a listed rule decides are labelled examples (without the
tokens that the listed rules name, which only restate the rule); Spark's FP-growth mines token sets that come with one verdict, and rules stay whose support and
confidence suffice and that no shorter rule with at least their confidence implies.
A URL without a listed rule takes the verdict of its best mined rule (confidence, then
support, then the smaller set, then block before allow), or ``default`` where none fits.

Rules are matched by an inverted index: token to rules; a rule fits where a URL's tokens
point to each of its items. Tokens that stand in the same labelled rows have the same
rules: each of them alone makes a rule, and in a larger set any of them will do. The
support is a small number of rows, so rules grow with the table; they are broadcast only
while their number is checked to be small.

Null URLs and URLs without ``://`` have empty host and path and no tokens. Repeated rows
each get their row. Where no URL is decided by a listed rule nothing is mined. An empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A token set seen in two labelled URLs can make a rule, at any size of the table.
MIN_SUPPORT, MIN_CONFIDENCE, DEFAULT = 2, 0.8, "allow"
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column; both empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def listed(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest listed rule that fits (as text) and its verdict, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):  # the longest is tried first, being put on last
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens, each marked with where it stands."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    endings = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(4))), lambda i: F.concat(F.lit("end:"), F.array_join(F.slice(labels, n - i + 1, i), ".")))
    own = lambda mark, xs: F.transform(xs, lambda x: F.concat(F.lit(mark), x))
    full = lambda xs: F.filter(xs, lambda x: x != "")
    words = F.split(F.translate(path, _UPPER, _LOWER), r"[^a-z0-9]+")
    names = F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("")), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    every = F.concat(endings, own("host:", full(labels)), own("path:", full(F.split(path, "/"))), own("word:", full(words)), own("name:", full(names)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def named_by(rules) -> list[str]:
    """The tokens that listed rules name themselves."""
    out = set()
    for host, path, _ in rules:
        labels = host.split(".")
        out.update("end:" + ".".join(labels[i:]) for i in range(len(labels)))
        out.update(f"host:{x}" for x in labels)
        out.update(f"{mark}:{x}" for x in path.split("/") if x for mark in ("path", "word"))
    return sorted(out)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, items, members, verdict, support, confidence) from (tokens, verdict) rows.

    ``min_support`` is a share of the rows below 1 and a number of rows from 1 on. Tokens
    rarer than that can be in no rule. Rules of one token are read off its counts, one for
    every token. A set with a token of one verdict only is implied by that token, so
    FP-growth gets the others; of these, tokens that always stand together are mined as
    one item, named after the smallest, and ``members`` has, for each item of a rule, all
    tokens that stand for it.
    """
    spark = labelled.sparkSession
    schema = "rule_id long, items array<string>, members array<array<string>>, verdict string, support double, confidence double"
    total = labelled.count()
    if not total:
        return spark.createDataFrame([], schema)
    rows = labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict")
    with Scratch(spark, "url-rules") as s:
        rows = s.write(rows, "labelled")
        each = rows.select("row", "verdict", F.explode("tokens").alias("token"))
        counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("rows"))
        common = s.write(counts.filter(F.col("n") >= (min_support if min_support >= 1 else min_support * total)), "common")
        mixed = common.filter("blocked > 0 AND blocked < n")
        # Tokens of exactly the same rows are one item, named after the smallest.
        one = s.write(mixed.groupBy("n", "blocked", "rows").agg(F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("members")).select("token", "members"), "items")
        held = each.join(common.select("token"), "token").join(one.select("token", F.col("token").alias("item")), "token", "left")
        basket = held.groupBy("row", "verdict").agg(F.collect_set("item").alias("items"))
        basket = s.write(basket.select(F.concat(F.col("items"), F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items")), "baskets")
        having = basket.count()
        need = math.ceil(min_support if min_support >= 1 else min_support * having)
        by = [F.struct(F.lit(v).alias("verdict"), F.col(n).alias("n")) for v, n in (("block", "blocked"), ("allow", "allowed"))]
        single = common.withColumn("allowed", F.col("n") - F.col("blocked")).select("token", F.col("n").alias("all"), F.inline(F.array(*by)))
        single = single.filter((F.col("n") >= need) & (F.col("n") / F.col("all") >= min_confidence))
        single = single.select(F.array("token").alias("items"), F.array(F.array("token")).alias("members"), "verdict", (F.col("n") / having).alias("support"), (F.col("n") / F.col("all")).alias("confidence"))
        model = FPGrowth(itemsCol="items", minSupport=max(need - 0.5, 0.0) / max(having, 1), minConfidence=min_confidence).fit(basket)
        found = model.associationRules.filter(F.startswith(F.element_at("consequent", 1), F.lit("verdict=")))
        found = found.filter(~F.exists("antecedent", lambda x: F.startswith(x, F.lit("verdict="))))
        found = s.write(
            found.select(F.array_sort("antecedent").alias("items"), F.substring(F.element_at("consequent", 1), 9, 9).alias("verdict"), "support", "confidence"), "found"
        )
        # Pruned: a rule whose proper subset says the same with no less confidence.
        a, b = found.alias("a"), found.withColumn("first", F.explode("items")).alias("b")
        implied = (
            a.withColumn("token", F.explode("items"))
            .join(b, (F.col("token") == F.col("b.first")) & (F.col("a.verdict") == F.col("b.verdict")) & (F.size("b.items") < F.size("a.items")) & (F.col("b.confidence") >= F.col("a.confidence")))
            .filter(F.size(F.array_except("b.items", "a.items")) == 0)
            .select(F.col("a.items").alias("items"), F.col("a.verdict").alias("verdict"))
            .distinct()
        )
        sets = found.filter(F.size("items") > 1).join(implied, ["items", "verdict"], "left_anti")
        members = sets.select("items", "verdict", F.explode("items").alias("token")).join(one, "token").groupBy("items", "verdict").agg(F.collect_list("members").alias("members"))
        kept = single.unionByName(sets.join(members, ["items", "verdict"]))
        kept = kept.withColumn("rule_id", F.xxhash64("items", "verdict")).select("rule_id", "items", "members", "verdict", "support", "confidence")
        return s.keep(s.write(kept, "rules"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, verdict, rule_id): the best mined rule of each (key, tokens) row that has one.
    A rule fits where a URL has a member of each of its items (without ``members``: the items)."""
    few = rules.count() <= BROADCAST_RULES
    members = F.col("members") if "members" in rules.columns else F.transform("items", lambda x: F.array(x))
    index = rules.select("rule_id", F.size("items").alias("need"), "verdict", "support", "confidence", F.posexplode(members).alias("item", "member"))
    index = index.withColumn("token", F.explode("member")).drop("member")
    hits = urls.select("key", F.explode("tokens").alias("token")).join(F.broadcast(index) if few else index, "token")
    fits = hits.groupBy("key", "rule_id", "need", "verdict", "support", "confidence").agg(F.size(F.collect_set("item")).alias("n")).filter("n = need")
    best = F.max(F.struct("confidence", "support", (-F.col("need")).alias("short"), "verdict", "rule_id"))
    return fits.groupBy("key").agg(best.alias("best")).select("key", F.col("best.verdict").alias("verdict"), F.col("best.rule_id").alias("rule_id"))


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule (id of the mined rule that decided)."""
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "listed": verdict, "tokens": tokens(F.col("url"), F.col("host"), F.col("path"))})
    telling = F.array_except("tokens", F.array(*[F.lit(t) for t in named_by(rules)]).cast("array<string>"))
    mined = mine(rows.filter("listed IS NOT NULL").select(telling.alias("tokens"), F.col("listed").alias("verdict")), min_support, min_confidence)
    # Equal URLs are judged once; the verdict then joins back to every row.
    open_urls = rows.filter("listed IS NULL").groupBy(F.col("url").alias("key")).agg(F.first("tokens").alias("tokens"))
    got = match(open_urls, mined).withColumnsRenamed({"verdict": "mined", "rule_id": "mined_rule"})
    listed_rows = rows.filter("listed IS NOT NULL").select("page_id", "host", "path", "rule", F.col("listed").alias("verdict"), F.lit(None).cast("long").alias("mined_rule"))
    rest = rows.filter("listed IS NULL").join(got, F.col("url") == F.col("key"), "left")
    return listed_rows.unionByName(rest.select("page_id", "host", "path", "rule", F.coalesce("mined", F.lit(default)).alias("verdict"), "mined_rule"))
