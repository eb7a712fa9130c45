"""BM25 over an inverted index of positions.

The index is a table of (doc, term, tf, positions), one shuffle to build; a search reads
only its own terms' postings. Document frequencies come from the same few postings; the
collection's size and mean length are one row. Boolean parts are evaluated per document
from its matched postings, so a search is one aggregation by document. Ranks are given to
the first rows only: ``top`` is a distributed top-k, and no window sees all matches.

``StoredIndex`` keeps the index as segments: postings in a fixed number of parts by hash of
the term (a search reads its terms' parts alone), documents with their lengths, and the
statistics of what lives after each segment. A document's newest segment decides whether it
lives and which of its postings count; ``compact`` makes all of them one segment.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import places
from ..errors import Conflict, StaleCursor, Unsupported
from ..functions import values as V
from . import expression as X

# Fixed values of the scoring.
K1, B, PHRASE_BOOST, FIELD_GAP, PAGE = 1.2, 0.75, 1.25, 100, 20


def live(docs: DataFrame, key: str = "doc", revision: str | None = None, deleted: str | None = None) -> DataFrame:
    """The newest version of every document, without deleted ones."""
    from ..operators.versions import latest

    return docs if revision is None else latest(docs, [key], revision, deleted)


def fields_of(df: DataFrame, skip: list[str] = ()) -> Column:
    """String fields of a row, also within structs and arrays, as array<(path, text)> in
    order of (path, text)."""
    from pyspark.sql import types as T

    def walk(kind, col, path):
        if isinstance(kind, T.StringType):
            return [F.array(F.struct(F.lit(path).alias("path"), col.alias("text")))]
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in walk(f.dataType, col[f.name], f"{path}.{f.name}")]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return [F.transform(col, lambda x, i: F.struct(F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]")).alias("path"), x.alias("text")))]
        return []

    parts = [c for f in df.schema.fields if f.name not in skip for c in walk(f.dataType, F.col(f"`{f.name}`"), f.name)]
    every = F.concat(*[F.coalesce(p, F.array().cast("array<struct<path:string,text:string>>")) for p in parts])
    return F.array_sort(F.filter(every, lambda x: x["text"].isNotNull()))


@dataclass
class LexicalIndex:
    postings: DataFrame  # doc, term, tf, positions, fields
    lengths: DataFrame  # doc, length
    words: DataFrame | None = None  # doc, term, at, field: a row a word

    @staticmethod
    def build(docs: DataFrame, key: str, text: str | None = None, fields: str | None = None) -> LexicalIndex:
        """From a text column, or from a column of (path, text) fields. Positions of one
        field start FIELD_GAP after the one before, so phrases don't cross fields."""
        if text is not None:
            d = docs.select(F.col(key).alias("doc"), F.array(F.struct(F.lit(text).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))).alias("fields"))
        else:
            d = docs.select(F.col(key).alias("doc"), F.col(fields).alias("fields"))
        d = d.select("doc", F.transform("fields", lambda f: F.struct(f["path"].alias("path"), V.tokens(f["text"]).alias("tokens"))).alias("fields"))
        lengths = d.select("doc", F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f["tokens"])).alias("length"))
        if text is not None:
            words = d.select("doc", F.posexplode(F.col("fields")[0]["tokens"]).alias("at", "term")).withColumn("field", F.lit(0))
        else:
            start = F.aggregate(F.slice("fields", F.lit(1), F.col("field")), F.lit(0), lambda n, f: n + F.size(f["tokens"]) + F.lit(FIELD_GAP))
            one = d.select("doc", "fields", F.posexplode("fields").alias("field", "f")).withColumn("start", start)
            words = one.select("doc", "field", "start", F.posexplode("f.tokens").alias("at0", "term")).withColumn("at", F.col("start") + F.col("at0"))
        return LexicalIndex(_postings(words, "doc", "term"), lengths, words)

    def statistics(self) -> DataFrame:
        """(n, mean): how many documents, and their mean length."""
        return self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))

    def hits(self, terms: list[str]) -> DataFrame:
        return self.postings.filter(F.col("term").isin(terms))

    def top(self, text: str, size: int = PAGE, **options) -> DataFrame:
        """(doc, score, matched, rank) of the best ``size`` matches, by (score descending, doc)."""
        return ranked(self.search(text, **options).orderBy(F.desc("score"), "doc").limit(size), [F.desc("score"), F.col("doc")])

    def search(self, text: str, k1: float = K1, b: float = B, boost: float = PHRASE_BOOST) -> DataFrame:
        """(doc, score, matched): every match with a score, in no order."""
        node = X.parse(text)
        scored, phrases = X.positive(node)
        terms = X.all_terms(node)
        spark = self.postings.sparkSession
        if not scored:  # nothing but NOT: all scores are 0, and such rows are left out
            return spark.createDataFrame([], self.lengths.schema).select("doc", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched"))
        stats, hit = self.statistics(), self.hits(terms)
        held = hit.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("tf", "positions")))).alias("m"))
        dfs = hit.agg(*[F.count_if(F.col("term") == t).alias(f"df{i}") for i, t in enumerate(terms)])
        rows = held.join(self.lengths, "doc").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(dfs))  # two one-row tables
        rows = rows.filter(self._matches(node))
        score = F.lit(0.0)
        for t in scored:
            i = terms.index(t)
            df, tf = F.col(f"df{i}").cast("double"), F.col("m")[t]["tf"].cast("double")
            idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
            part = idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * (F.col("length") / F.col("mean"))))
            score = score + F.coalesce(part, F.lit(0.0))
        for p in phrases:
            score = score * F.when(self._phrase(p), F.lit(boost)).otherwise(F.lit(1.0))
        matched = F.filter(F.array(*[F.lit(t) for t in scored]), lambda t: F.map_contains_key("m", t))
        return rows.select("doc", score.alias("score"), matched.alias("matched")).filter("score > 0")

    def matched_fields(self, rows: DataFrame) -> DataFrame:
        """Adds matched_fields: the numbers of the fields where a row's matched terms stand."""
        terms = rows.select("doc", F.explode("matched").alias("term"))
        at = self.postings.join(terms, ["doc", "term"]).select("doc", F.explode("fields").alias("f"))
        return rows.join(at.groupBy("doc").agg(F.sort_array(F.collect_set("f")).alias("matched_fields")), "doc")  # one a field

    def paged(self, text: str, size: int = PAGE, offset: int = 0, token: str | None = None, **options):
        """(rows with rank, diagnostics, next token): a page by offset or by token, not both.
        Diagnostics: segments searched, postings lists read, candidates, whether more follow."""
        if offset < 0 or (token is not None and offset):
            raise Unsupported("a page has an offset from 0 or a token, not both")
        if token is not None:
            try:
                offset = int(json.loads(base64.urlsafe_b64decode(token))["offset"])
            except (ValueError, KeyError, TypeError) as e:
                raise StaleCursor("the token can't be read") from e
            if offset < 0:
                raise StaleCursor("the token can't be read")
        found = self.search(text, **options)
        n = found.count()
        order = [F.desc("score"), F.col("doc")]
        rows = ranked(found.orderBy(*order).offset(offset).limit(size), order).withColumn("rank", F.col("rank") + F.lit(offset))
        more = offset + size < n
        seen = {"segments": self.segment_count(), "postings_lists": len(set(X.all_terms(X.parse(text)))), "candidates": n, "truncated": more}
        return rows, seen, base64.urlsafe_b64encode(json.dumps({"offset": offset + size}).encode()).decode() if more else None

    def segment_count(self) -> int:
        return 1

    def _phrase(self, terms) -> Column:
        """Whether the terms stand one after another."""
        first = F.col("m")[terms[0]]["positions"]
        follow = lambda p: _all([F.array_contains(F.col("m")[t]["positions"], (p + i).cast("int")) for i, t in enumerate(terms[1:], 1)])
        found = F.exists(first, follow) if len(terms) > 1 else first.isNotNull()
        return F.coalesce(found, F.lit(False))

    def _matches(self, node) -> Column:
        if isinstance(node, X.Term):
            return F.map_contains_key("m", node.term)
        if isinstance(node, X.Phrase):
            return self._phrase(node.terms)
        if isinstance(node, X.Without):
            return ~self._matches(node.item)
        parts = [self._matches(i) for i in node.items]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node, X.Both) else out | p
        return out


def _all(cols) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _postings(words: DataFrame, *by: str) -> DataFrame:
    one = words.groupBy(*by).agg(F.collect_list(F.struct("at", "field")).alias("w"))
    return one.select(*by, F.size("w").cast("long").alias("tf"), F.sort_array("w.at").alias("positions"), F.array_distinct(F.sort_array("w.field")).alias("fields"))


#: Parts that a stored segment's postings lie in, by term, and slices of a part by document:
#: a term that every document holds is written by several tasks.
PARTS, SLICES = 16, 16


class StoredIndex(LexicalIndex):
    """An index in a folder that all executors see, one segment per ``add``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _segments(self) -> list[int]:
        n = 0
        while places.exists(self.spark, f"{self.path}/segment-{n}/done"):
            n += 1
        return list(range(n))

    def _read(self, what: str) -> DataFrame:
        found = [self._segment(n, what).withColumn("segment", F.lit(n)) for n in self._segments()]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def _segment(self, n: int, what: str) -> DataFrame:
        documents = self.spark.read.parquet(f"{self.path}/segment-{n}/documents")
        if what == "documents":
            return documents
        # a segment of deletions has no postings, and so no file with their schema
        return self.spark.read.schema(f"doc {dict(documents.dtypes)['doc']}, term string, tf bigint, positions array<int>, fields array<int>, part int").parquet(f"{self.path}/segment-{n}/{what}")

    @property
    def documents(self) -> DataFrame:
        """(doc, length, deleted, revision, segment): every version that was added."""
        return self._read("documents")

    @property
    def living(self) -> DataFrame:
        """(doc, length, revision, segment): the newest version of each document that lives."""
        newest = self.documents.groupBy("doc").agg(F.max(F.struct("segment", "length", "deleted", "revision")).alias("x")).select("doc", "x.*")
        return newest.filter("NOT deleted").drop("deleted")

    @property
    def lengths(self) -> DataFrame:
        return self.living.select("doc", "length")

    @property
    def postings(self) -> DataFrame:
        every = self._read("postings").drop("part")
        return every.join(self.living.select("doc", "segment"), ["doc", "segment"], "left_semi") if len(self._segments()) > 1 or not self._clean() else every

    def _clean(self) -> bool:
        """Whether the only segment has no deleted documents."""
        return self.spark.read.parquet(f"{self.path}/segment-0/documents").filter("deleted").isEmpty()

    def segment_count(self) -> int:
        return len(self._segments())

    def statistics(self) -> DataFrame:
        at = f"{self.path}/segment-{self._segments()[-1]}/statistics"
        # a writer that was lost after its segment counts has left them out
        return self.spark.read.parquet(at).select("n", "mean") if places.exists(self.spark, f"{at}/_SUCCESS") else super().statistics()

    def hits(self, terms: list[str]) -> DataFrame:
        parts = [r["part"] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(_part("term").alias("part")).distinct().collect()]
        found = []
        for n in self._segments():  # the parts of the terms alone are read
            found.append(self._segment(n, "postings").filter(F.col("part").isin(parts) & F.col("term").isin(terms)).withColumn("segment", F.lit(n)))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        if len(found) == 1 and self._clean():
            return out
        return out.join(self.living.select("doc", "segment"), ["doc", "segment"], "left_semi")

    @property
    def revision(self) -> int:
        """The newest revision that was added."""
        return self.documents.agg(F.max("revision").alias("r")).first()["r"] if self._segments() else 0

    def answer(self, text: str, table_revision: int, size: int = PAGE, allow_stale: bool = False, max_lag: int | None = None) -> DataFrame:
        """The best matches, if the index is as new as the table or may lag behind it; a
        segment that comes in between is a Conflict, as parts would show two snapshots."""
        seen = self._segments()
        if not fresh(self.revision, table_revision, allow_stale, max_lag):
            raise Conflict(f"the index is at {self.revision}, the table at {table_revision}")
        out = self.top(text, size)
        if self._segments() != seen:
            raise Conflict("the index changed under the search")
        return out

    def add(self, docs: DataFrame, key: str, text: str | None = None, fields: str | None = None, deleted: str | None = None, revision: int = 0) -> StoredIndex:
        """A segment of new versions of documents; those whose ``deleted`` holds die."""
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        made = LexicalIndex.build(docs.filter(~gone), key, text, fields)
        length = F.size(V.tokens(F.coalesce(F.col(text), F.lit("")))) if text is not None else F.aggregate(fields, F.lit(0), lambda n, f: n + F.size(V.tokens(f["text"])))
        every = docs.select(F.col(key).alias("doc"), gone.alias("deleted"), F.when(~gone, length).alias("length"))
        words = made.words.select("doc", "term", "at", "field", _part("term").alias("part"), F.pmod(F.xxhash64("doc"), F.lit(SLICES)).alias("slice"))
        # one shuffle; in sorted order the words of a posting come together
        words = words.repartition("part", "slice").sortWithinPartitions("part", "slice", "term", "doc")
        self._write(_postings(words, "part", "slice", "term", "doc").drop("slice"), every.select("doc", F.coalesce("length", F.lit(0)).alias("length"), "deleted", F.lit(revision).cast("long").alias("revision")))
        return self

    def _write(self, postings: DataFrame, documents: DataFrame) -> None:
        n = len(self._segments())
        at = f"{self.path}/segment-{n}"
        postings.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{at}/postings")
        documents.write.mode("overwrite").parquet(f"{at}/documents")
        self.spark.range(1).write.mode("overwrite").parquet(f"{at}/done")  # the segment counts from here on
        LexicalIndex.statistics(self).write.mode("overwrite").parquet(f"{at}/statistics")

    def compact(self) -> StoredIndex:
        """The living versions as the one segment of a new folder beside this one."""
        out = StoredIndex(self.spark, f"{self.path}-compact-{len(self._segments())}")
        out._write(self.postings.drop("segment").withColumn("part", _part("term")).repartition("part", F.pmod(F.xxhash64("doc"), F.lit(SLICES))), self.living.select("doc", "length", F.lit(False).alias("deleted"), "revision"))
        return out


def _part(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """Adds rank to the few rows of a page."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def page(rows: DataFrame, key: str = "doc", size: int = PAGE, offset: int = 0) -> DataFrame:
    """One page of scored rows (a distributed top-k, no total rank)."""
    return rows.orderBy(F.desc("score"), key).offset(offset).limit(size)


def filtered(rows: DataFrame, nodes: DataFrame, key: str, condition: Column, size: int = PAGE, examine: int | None = None) -> DataFrame:
    """Scored rows whose nodes pass a condition, up to a page; ``examine`` bounds how many
    candidates are looked at, as a bounded reader would."""
    if examine is not None:
        rows = rows.orderBy(F.desc("score"), "doc").limit(examine)
    return rows.join(nodes.filter(condition).select(F.col(key).alias("doc")), "doc").orderBy(F.desc("score"), "doc").limit(size)


def fresh(index_revision: int, table_revision: int, allow_stale: bool = False, max_lag: int | None = None) -> bool:
    """Whether an index may answer: as new as the table, or stale within what is allowed."""
    lag = table_revision - index_revision
    return lag <= 0 or (allow_stale and (max_lag is None or lag <= max_lag))
