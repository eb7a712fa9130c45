"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Every document's set of word n-grams is a sparse row. Columns (n-grams) are dealt into
blocks by hash; a block's task multiplies its slice with its transpose, which counts, for
pairs of like size, the columns they share; counts add up over the blocks, and pairs that
cannot reach the overlap that their sizes ask for are discarded. What the bounds rest on:

* Two sets of sizes a and b with Jaccard >= t overlap in at least t/(1+t) (a+b) columns, so
  sizes further apart than the factor t never link.
* Columns are ordered from rare to frequent, by a sketch of document frequencies of fixed
  size (CELLS counters). A pair that links shares a column among the first
  n - ceil(t n) + 1 of each row; only those are multiplied.
* A pair whose first shared column has positions p and q overlaps in at most
  min(a - p, b - q) columns.
* A pair that shares s of those first columns overlaps in at most s and the larger of the
  two rests, ceil(t n) - 1 columns.

Survivors are counted exactly over whole texts; counts decide, the bounds only save work.

Equal sets are one class, found by digest, and are counted once per class. A column that
more than LIST rows share does not multiply out: its rows (of like size) are a list, led by
one of them, its hub: the row whose own first columns are the commonest, as it has least of
its own and so is like the most others. Lists leave a block packed, dealt by hub: near copies
share most of their columns and so a few hubs, where their columns meet again. Every row is
first compared with the hub that leads most of its columns, then with the others that are
still in another component. Only lists that stay over several components are unpacked, and
only their rows in different components are paired (and counted), so no link between
different sets is lost and large groups of copies never emit all pairs. Columns of more than
about SPLIT rows are dealt over several tasks, each with a hub of its own.

Null and empty texts have empty sets and link with nothing. Rows that share a doc_id are
versions of one document: each has its own set and row, and they share a component. A row
whose doc_id is null joins the class of its set. An empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, sifted, small_batches
from .components import components

WORDS, NUM, DEN = 5, 80, 100
#: Counters of the frequency sketch, and chunks they travel in.
CELLS, CHUNKS = 1 << 22, 64
#: A column with more rows than this isn't multiplied out.
LIST = 8
#: Rows of a column that one task meets, about; a longer one is dealt over several.
SPLIT = 200_000
#: Columns that a row remembers when pairs of such columns are made: a pair that shares one
#: of them has been made there. Beyond them a pair may come again, and is counted once.
BEFORE = 32
#: Entries of the product's operand per block, on average.
BLOCK_ENTRIES = 500_000
#: Entries gathered in a task before they are packed by block.
FLUSH = 2_000_000
#: Sketch parts that one task sums.
SUMMED = 512
_ENTRY = [("h", np.uint64), ("doc", np.int64), ("size", np.uint32), ("pos", np.uint32), ("split", np.uint8), ("rank", np.uint16)]
_PAIR = [("a", np.int64), ("b", np.int64), ("na", np.uint32), ("nb", np.uint32), ("shared", np.uint32), ("best", np.int32)]
_LISTED = [("hub", np.int64), ("h", np.uint64), ("level", np.int32), ("doc", np.int64), ("size", np.uint32), ("pos", np.uint32), ("split", np.uint8)]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of a text's word n-grams. Words: runs of bytes other than
    ASCII white space, A-Z lower-cased (bytes.split and bytes.lower do just that)."""

    #: Words remembered before the memory starts anew.
    HELD = 400_000

    def __init__(self, words: int):
        self.words, self.ids, self.hashes, self.n = words, {}, np.empty(1 << 16, np.uint64), 0

    def _id(self, word: bytes) -> int:
        n = self.ids[word] = self.n
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty(n, np.uint64)])
        self.hashes[n] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.n += 1
        return n

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if self.n > self.HELD:
            self.ids, self.n = {}, 0
        get, make = self.ids.get, self._id
        at = [i if (i := get(w)) is not None else make(w) for w in words]
        h = self.hashes[np.array(at, np.int64)]
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = out * _ODD + h[i : len(h) - k + 1 + i]
        return np.unique(_mix(out))


def _need(n, num: int, den: int):
    """ceil(num * n / den): the least overlap that a row of n columns can link with."""
    return -(-num * n // den)


def _rows_and_sketch(words: int):
    def run(batches):
        shingles, counts = Shingler(words), np.zeros(CELLS, np.uint32)
        for b in batches:
            ids, sizes, digests = b.column(0).to_pylist(), [], []
            for text in b.column(1).to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                counts[(s >> np.uint64(42)).astype(np.int64)] += np.uint32(1)  # cells may repeat within a row: a sketch may be low by those
            yield _batch(["row"] * len(ids), ids, sizes, digests, [None] * len(ids))
        width = CELLS // CHUNKS
        for c in range(CHUNKS):
            part = counts[c * width : (c + 1) * width]
            if part.any():
                yield _batch(["sketch"], [c], [0], [None], [zlib.compress(part.tobytes(), 1)])

    return run


def _batch(kind, ids, sizes, digests, blobs):
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.string()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())],
        ["kind", "doc_id", "n", "digest", "blob"],
    )


def _sum_sketch(tbl: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // CHUNKS, np.uint64)
    for blob in tbl.column("blob"):
        total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint32)
    out = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
    return pa.table({"doc_id": pa.array([tbl.column("doc_id")[0].as_py()], pa.int64()), "blob": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})


def _sketch(parts: DataFrame, s: Scratch) -> list[bytes]:
    """The sum of the tasks' sketches (doc_id: the chunk, blob), chunk by chunk: a tree whose
    every step sums SUMMED parts at most, about."""
    most = parts.groupBy("doc_id").count().agg(F.max("count").alias("m")).first()["m"] or 0
    while most > SUMMED:
        fan = -(-most // SUMMED)
        parts = parts.withColumn("g", F.pmod(F.xxhash64("blob", F.monotonically_increasing_id()), F.lit(fan)))
        parts = s.write(parts.groupBy("doc_id", "g").applyInArrow(_sum_sketch, "doc_id long, blob binary"), "sketch")
        most = fan
    found = parts.groupBy("doc_id").applyInArrow(_sum_sketch, "doc_id long, blob binary").collect()  # CELLS counters at most
    empty = zlib.compress(bytes(4 * CELLS // CHUNKS), 1)
    by_chunk = {r["doc_id"]: bytes(r["blob"]) for r in found}
    return [by_chunk.get(c, empty) for c in range(CHUNKS)]


def _packed(kinds, arrays, idx) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(x[idx], k).tobytes() for (_, k), x in zip(kinds, arrays)), 1)


def _unpacked(kinds, blobs):
    """The arrays of packed entries, one after another."""
    width = sum(np.dtype(k).itemsize for _, k in kinds)
    raw = [zlib.decompress(x) for x in blobs]
    out, at = [], 0
    for _, k in kinds:
        out.append(np.concatenate([np.empty(0, k), *[np.frombuffer(r, k, len(r) // width, at * (len(r) // width)) for r in raw]]))
        at += np.dtype(k).itemsize
    return out


def _slices(key: np.ndarray):
    """(key, indices) of equal keys."""
    order = np.argsort(key, kind="stable")
    return [(int(key[i[0]]), i) for i in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(i)]


def _entries(words: int, num: int, den: int, blocks: int, sketch):
    """Each row's first columns, packed by block: (block, blob). A column of more than SPLIT
    rows, as the sketch has it beyond its mean, goes to several blocks by document."""

    def pack(parts):
        h, over = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        lens = [len(p[0]) for p in parts]
        doc = np.repeat(np.array([p[2] for p in parts], np.int64), lens)
        size = np.repeat(np.array([p[3] for p in parts], np.uint32), lens)
        pos = np.concatenate([np.arange(k, dtype=np.uint32) for k in lens])
        turn = (_mix(doc.view(np.uint64)) >> np.uint64(20)) % (over + np.uint64(1))
        block = (h % np.uint64(blocks) + np.uint64(blocks) * turn).astype(np.int64)
        found = _slices(block)
        rank = np.repeat(np.array([p[4] for p in parts], np.uint16), lens)
        arrays = (h, doc, size, pos, over > 0, rank)
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([_packed(_ENTRY, arrays, i) for _, i in found], pa.binary())], ["block", "blob"])

    def run(batches):
        shingles, counts = Shingler(words), np.concatenate([np.frombuffer(zlib.decompress(x), np.uint32) for x in sketch.value])
        mean = np.uint32(min(counts.mean(), 2**32 - 1))
        parts, held, seen = [], 0, set()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(text)
                if doc is None or not len(s):
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if digest in seen:  # an equal set of this task has entered already
                    continue
                if len(seen) < 200_000:
                    seen.add(digest)
                freq = counts[(s >> np.uint64(42)).astype(np.int64)]
                order = np.lexsort((s, freq))[: len(s) - _need(len(s), num, den) + 1]
                freq = freq[order]
                rank = 65_535 - int(1024 * np.log2(freq + 1.0).mean())  # low: its columns are common
                parts.append((s[order], ((freq - np.minimum(freq, mean)) // SPLIT).astype(np.uint64), doc, len(s), rank))
                held += len(order)
            if held >= FLUSH:
                yield pack(parts)
                parts, held = [], 0
        if parts:
            yield pack(parts)

    return run


def _like(a, b, num: int, den: int):
    return np.minimum(a, b) * den >= num * np.maximum(a, b)


_PRODUCT = "kind string, a long, b long, level long, n long, blob binary"


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (_mix(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _product(num: int, den: int, groups: int):
    """One block times its transpose. 'pair': packed for the group ``a`` of their first row,
    pairs, the number of the block's columns they share and what the positions leave them at
    best beyond their need. 'list': lists of long columns, packed for the group ``a``. 'top':
    of a column dealt over several blocks (a) the hub (b) of each list, its level and size."""

    def rows(kind, a, b=None, level=None, n=None, blobs=None):
        none = [None] * len(a)
        ints = [pa.array(none if x is None else x, pa.int64()) for x in (a, b, level, n)]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), *ints, pa.array(blobs or none, pa.binary())], ["kind", "a", "b", "level", "n", "blob"])

    def pairs(starts, lens, doc, size, pos):
        found = [[np.empty(0, np.int64)] for _ in range(5)]
        for k in np.unique(lens[lens > 1]).tolist():
            at = starts[lens == k]
            i, j = np.triu_indices(k, 1)
            step = max(1, 4_000_000 // len(i))
            for c in range(0, len(at), step):
                x, y = (at[c : c + step, None] + i).ravel(), (at[c : c + step, None] + j).ravel()
                ok = _like(size[x], size[y], num, den) & (doc[x] != doc[y])
                x, y = x[ok], y[ok]
                x, y = np.where(doc[x] < doc[y], x, y), np.where(doc[x] < doc[y], y, x)
                # What the positions leave beyond the need of a pair: 0 or more, or it can't link.
                best = np.minimum(size[x] - pos[x], size[y] - pos[y]) - -(-num * (size[x] + size[y]) // (num + den))
                for out, more in zip(found, (doc[x], doc[y], size[x], size[y], best)):
                    out.append(more)
        a, b, na, nb, best = map(np.concatenate, found)
        if not len(a):
            return []
        order = np.lexsort((nb, na, b, a))
        a, b, na, nb, best = (x[order] for x in (a, b, na, nb, best))
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (na[1:] != na[:-1]) | (nb[1:] != nb[:-1])))
        arrays = (a[first], b[first], na[first], nb[first], np.diff(np.append(first, len(a))), np.maximum.reduceat(best, first))
        packed = _slices(_group(a[first], groups))
        return [rows("pair", [g for g, _ in packed], blobs=[_packed(_PAIR, arrays, i) for _, i in packed])]

    def lists(h, doc, size, pos, split, rank):
        """Lists of like sizes: rows of one level of size and of the next."""
        level = np.floor(np.log(size) / np.log(den / num)).astype(np.int32)
        twice = np.concatenate([np.arange(len(h))] * 2)
        at = np.concatenate([level, level - 1])
        own = np.repeat([True, False], len(h))
        prio = _mix(doc.view(np.uint64))
        order = np.lexsort((prio[twice], rank[twice], at, h[twice]))
        i, at, own = twice[order], at[order], own[order]
        starts = np.flatnonzero(np.append(True, (h[i][1:] != h[i][:-1]) | (at[1:] != at[:-1])))
        lens = np.diff(np.append(starts, len(i)))
        apart = split[i][starts] > 0  # other blocks have rows of these columns
        good = apart | (np.logical_or.reduceat(own, starts) & (lens > 1))
        tops = starts[apart]
        top_h, top_doc, top_level, top_size = h[i][tops], doc[i][tops], at[tops], size[i][tops]
        hub = np.repeat(doc[i[starts]], lens)
        kept = np.repeat(good, lens)
        turns = np.repeat(1 + lens // SPLIT, lens).astype(np.uint64)
        i, at, hub, turns = i[kept], at[kept], hub[kept], turns[kept]
        turn = (prio[i] >> np.uint64(20)) % turns  # the rows of a very long list go to several groups
        group = _mix(hub.view(np.uint64) + turn) % np.uint64(groups)
        found = _slices(group.astype(np.int64))
        arrays = (hub, h[i], at, doc[i], size[i], pos[i], (split[i] > 0) | (turns > 1))
        out = [rows("list", [g for g, _ in found], blobs=[_packed(_LISTED, arrays, idx) for _, idx in found])]
        if len(tops):
            out.append(rows("top", top_h.view(np.int64), top_doc, top_level, top_size))
        return out

    def run(tbl: pa.Table) -> pa.Table:
        h, doc, size, pos, split, rank = _unpacked(_ENTRY, tbl.column("blob").to_pylist())
        order = np.lexsort((doc, h))
        h, doc, size, pos, split, rank = h[order], doc[order], size[order].astype(np.int64), pos[order].astype(np.int64), split[order], rank[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lens = np.diff(np.append(starts, len(h)))
        long = (lens > LIST) | (split[starts] > 0)
        out = pairs(starts[~long], lens[~long], doc, size, pos)
        hot = np.repeat(long, lens)
        if hot.any():
            out += lists(h[hot], doc[hot], size[hot], pos[hot], split[hot], rank[hot])
        return pa.Table.from_batches(out or [rows("pair", [])])

    return run


def _added(num: int, den: int):
    """Pairs of one group with their counts added up over the blocks, where the bounds leave
    them: (a, b, short), what they lack of their need that lists may still add. Right: (doc,
    listed), the columns of first rows that are in lists."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, na, nb, shared, best = _unpacked(_PAIR, left.column("blob").to_pylist())
        order = np.lexsort((b, a))
        a, b, na, nb, shared, best = (x[order].astype(np.int64) for x in (a, b, na, nb, shared, best))
        if not len(a):
            return pa.table({"a": a, "b": b, "short": a})
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        need = np.minimum.reduceat(-(-num * (na + nb) // (num + den)), first)
        rest = np.maximum.reduceat(-(-num * np.maximum(na, nb) // den) - 1, first)
        short = need - rest - np.add.reduceat(shared, first)
        a, b, best = a[first], b[first], np.maximum.reduceat(best, first)
        doc = right.column("doc").to_numpy()
        order = np.argsort(doc)
        doc, listed = doc[order], right.column("listed").to_numpy()[order]
        at = np.minimum(np.searchsorted(doc, a), max(len(doc) - 1, 0))
        may = np.where(doc[at] == a, listed[at], 0) if len(doc) else np.zeros(len(a), np.int64)
        ok = (best >= 0) & (short <= may)
        return pa.table({"a": a[ok], "b": b[ok], "short": short[ok]})

    return run


def _hubs(groups: int):
    """Of one group's lists, how many columns a hub leads that a row has: (g, hub, doc, columns,
    and the row's own group)."""

    def run(tbl: pa.Table) -> pa.Table:
        return _led(tbl, groups)

    return run


def _led(tbl: pa.Table, groups: int) -> pa.Table:
    hub, _, _, doc, _, _, _ = _unpacked(_LISTED, tbl.column("blob").to_pylist())
    order = np.lexsort((doc, hub))
    hub, doc = hub[order], doc[order]
    first = np.flatnonzero(np.append(True, (hub[1:] != hub[:-1]) | (doc[1:] != doc[:-1]))) if len(hub) else np.empty(0, np.int64)
    g = tbl.column("g")[0].as_py()
    return pa.table({"g": pa.array([g] * len(first), pa.int64()), "hub": hub[first], "doc": doc[first], "columns": np.diff(np.append(first, len(hub))), "own": _group(doc[first], groups)})


def _unsettled(num: int, den: int):
    """Of a group's lists, the rows of those over several components and of columns dealt
    over several blocks. Right: (hub, doc, c), the components of the rows of hubs in question."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        hub, h, level, doc, size, pos, split = _unpacked(_LISTED, left.column("blob").to_pylist())
        of_hub, of_doc, c = (right.column(n).to_numpy() for n in ("hub", "doc", "c"))
        ok = np.isin(hub, np.unique(of_hub))
        hub, h, level, doc, size, pos, split = (x[ok] for x in (hub, h, level, doc, size, pos, split))
        docs, first = np.unique(of_doc, return_index=True)
        comp = c[first][np.searchsorted(docs, doc)] if len(docs) else np.empty(0, np.int64)
        order = np.lexsort((level, h))
        hub, h, level, doc, size, pos, split, comp = (x[order] for x in (hub, h, level, doc, size, pos, split, comp))
        if len(h):
            starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (level[1:] != level[:-1])))
            lens = np.diff(np.append(starts, len(h)))
            some = (np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)) | (split[starts] > 0)
            ok = np.repeat(some, lens)
            h, level, doc, size, pos, comp = (x[ok] for x in (h, level, doc, size, pos, comp))
        own = np.floor(np.log(size) / np.log(den / num)).astype(np.int32) == level
        return pa.table({"column": h.view(np.int64), "level": level.astype(np.int64), "row": doc, "n": size.astype(np.int64), "pos": pos.astype(np.int64), "c": comp, "own": own})

    return run


def _count(words: int, num: int, den: int):
    """Of pairs with their texts, those whose exact counts reach the threshold."""

    def run(batches):
        shingles, held = Shingler(words), {}

        def row(text):
            if text not in held:
                if len(held) >= 512:
                    held.clear()
                held[text] = shingles(text)
            return held[text]

        for b in batches:
            u, v = [], []
            for a, ta, c, tc in zip(*(b.column(i).to_pylist() for i in range(4))):
                x, y = row(ta), row(tc)
                both = np.intersect1d(x, y, assume_unique=True).size
                if both and den * both >= num * (len(x) + len(y) - both):
                    u.append(a)
                    v.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _like_size(a: str, b: str, num: int, den: int):
    return F.least(a, b) * den >= F.greatest(a, b) * num


def join(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest doc_id with the same
    set; null for empty sets), component_id (smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(spark, "ngram-join") as s:
        first = s.write(d.mapInArrow(_rows_and_sketch(words), "kind string, doc_id long, n long, digest binary, blob binary"), "rows")
        rows = first.filter("kind = 'row'").select("doc_id", "n", "digest")
        total = rows.filter("n > 0").agg(F.sum(F.expr(f"n - ceil({num} * n / {den}) + 1")).alias("t")).first()["t"] or 0
        sketch = spark.sparkContext.broadcast(_sketch(first.filter("kind = 'sketch'").select("doc_id", "blob"), s))

        classes = rows.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("class_id"))
        member = s.write(rows.join(classes, ["digest", "n"], "left").select("doc_id", "n", "class_id"), "member")
        of = s.write(member.filter("class_id IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc"), "class_id").agg(F.min("n").alias("n")), "of")
        # Documents of several classes (versions) tie them together.
        versions = of.groupBy("doc").agg(F.min("class_id").alias("v"), F.max("class_id").alias("w")).filter("v <> w").select("doc", "v")
        versions = of.join(versions, "doc").filter("class_id <> v").select(F.col("class_id").alias("u"), "v").distinct()

        blocks = max(8, int(total) // BLOCK_ENTRIES)
        packed = d.mapInArrow(_entries(words, num, den, blocks, sketch), "block long, blob binary")
        out = s.write(packed.groupBy("block").applyInArrow(_product(num, den, blocks), _PRODUCT), "product")
        lists = out.filter("kind = 'list'").select(F.col("a").alias("g"), "blob")
        tops = out.filter("kind = 'top'").select(F.col("a").alias("column"), "level", F.col("b").alias("hub"), "n")
        led = s.write(lists.groupBy("g").applyInArrow(_hubs(blocks), "g long, hub long, doc long, columns long, own long"), "hubs")

        # Pairs of the rarer columns: counts over all blocks, and what lists may add.
        listed = led.groupBy("own", "doc").agg(F.sum("columns").alias("listed"))
        cold = out.filter("kind = 'pair'").select("a", "blob").groupBy("a").cogroup(listed.groupBy("own")).applyInArrow(_added(num, den), "a long, b long, short long")
        cold = cold.join(listed.select(F.col("doc").alias("b"), "listed"), "b", "left").filter("short <= COALESCE(listed, 0)").select("a", "b")
        # Rows of long columns: each with the hub (of like size) that leads most of its columns.
        sizes = s.write(of.groupBy("doc").agg(F.max("n").alias("n")), "sizes")
        sized = led.filter("hub <> doc").join(sizes, "doc").join(sizes.select(F.col("doc").alias("hub"), F.col("n").alias("hn")), "hub").filter(_like_size("n", "hn", num, den))
        star = sized.groupBy("doc").agg(F.max_by("hub", F.struct("columns", "hub")).alias("hub")).select(F.col("hub").alias("a"), F.col("doc").alias("b"))
        above = tops.groupBy("column", "level").agg(F.max_by("hub", F.xxhash64("hub")).alias("a")).join(tops, ["column", "level"]).select("a", F.col("hub").alias("b"))
        pairs = s.write(_of_classes(cold.unionByName(star).unionByName(above), of), "pairs")
        links = s.write(_verified(d, pairs, s, words, num, den).unionByName(versions), "links")

        # Rows that are still in another component than one of their hubs.
        label = components(links, s)
        in_c = _components_of(of, label)
        apart = sized.select("doc", "hub").join(in_c, "doc").join(in_c.toDF("hub", "hc"), "hub").filter("c <> hc").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
        pairs, links, label = _joined(d, _of_classes(apart, of), pairs, links, label, s, words, num, den)

        # What long columns still owe: rows of one list whose components differ.
        in_c = s.write(_components_of(of, label), "components")
        placed = s.write(led.join(in_c, "doc").select("g", "hub", "doc", "c"), "placed")
        split = placed.groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("hub")
        at_top = tops.join(in_c.withColumnRenamed("doc", "hub"), "hub").join(split.withColumn("odd", F.lit(True)), "hub", "left")
        uneven = at_top.groupBy("column").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("odd").alias("odd")).filter("lo <> hi OR odd").select("column")
        asked = placed.join(split.unionByName(tops.join(uneven, "column", "left_semi").select("hub")).distinct(), "hub", "left_semi")
        asked = s.write(asked, "asked")
        if not asked.isEmpty():
            some = lists.join(asked.select("g").distinct(), "g", "left_semi")
            at = some.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(_unsettled(num, den), "column long, level long, row long, n long, pos long, c long, own boolean")
            owed = _owed(s.write(at.distinct(), "unsettled"), s, num, den)
            _, _, label = _joined(d, _of_classes(owed, of), pairs, links, label, s, words, num, den)

        label = label.select(F.col("node").alias("class_id"), "component")
        done = member.join(label, "class_id", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id", "doc_id").alias("component_id")
        )
        return s.keep(s.write(done, "result"))


def _of_classes(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs of documents (a, b) as distinct pairs of their classes."""
    p = pairs.join(of.select(F.col("doc").alias("a"), F.col("class_id").alias("ca")), "a").join(of.select(F.col("doc").alias("b"), F.col("class_id").alias("cb")), "b")
    return p.filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def _components_of(of: DataFrame, label: DataFrame) -> DataFrame:
    """(doc, c): each document's component so far."""
    return of.join(label.withColumnRenamed("node", "class_id"), "class_id", "left").groupBy("doc").agg(F.min(F.coalesce("component", "class_id")).alias("c"))


def _joined(docs, more: DataFrame, pairs: DataFrame, links: DataFrame, label: DataFrame, s: Scratch, words: int, num: int, den: int):
    """Pairs, links and components with those of more pairs that weren't counted yet."""
    more = s.write(more.join(pairs, ["a", "b"], "left_anti"), "more")
    if more.isEmpty():
        return pairs, links, label
    links = links.unionByName(_verified(docs, more, s, words, num, den))
    return pairs.unionByName(more), links, components(links, s)


def _owed(at: DataFrame, s: Scratch, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of rows of one list in different components that the bounds leave."""
    # A pair is made at the first column it shares: a row knows its columns just before.
    before = Window.partitionBy("row").orderBy("pos", "column", "level").rowsBetween(-BEFORE, -1)
    at = at.withColumn("before", F.filter(F.collect_list("column").over(before), lambda x: x != F.col("column")))
    most = at.groupBy("column", "level", "c").count().groupBy("column", "level").agg(F.max_by("c", F.struct("count", "c")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    at = s.write(at.join(most, ["column", "level"]), "split")
    few = at.filter("c <> most").select("column", "level", *[F.col(x).alias(f"{x}2") for x in ("row", "n", "pos", "c", "own", "before")])
    need = F.ceil((F.col("n") + F.col("n2")) * num / (num + den))
    owed = at.join(few, ["column", "level"]).filter(
        (F.col("c") != F.col("c2")) & (F.col("own") | F.col("own2")) & ((F.col("c") == F.col("most")) | (F.col("row") < F.col("row2"))) & _like_size("n", "n2", num, den)
        & (F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= need) & ~F.arrays_overlap("before", "before2")
    )
    return owed.select(F.col("row").alias("a"), F.col("row2").alias("b")).distinct()


def _verified(docs: DataFrame, pairs: DataFrame, s: Scratch, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that link, as (u, v), by the exact counts of their texts.

    Few other texts get through the sieve; the joins leave exactly the wanted ones."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = s.write(sifted(docs, "doc_id", F.col("doc_id"), wanted).filter("maybe").select("doc_id", "text"), "texts")
    if texts.count() > texts.select("doc_id").distinct().count():  # rows that repeat their document count once
        texts = s.write(texts.groupBy("doc_id", F.xxhash64("text").alias("x"), F.length("text").alias("k")).agg(F.first("text").alias("text")).select("doc_id", "text"), "texts")
    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "ta", "b", "tb")
    links = s.write(both.mapInArrow(_count(words, num, den), "u long, v long"), "links")
    s.drop(texts)
    return links
