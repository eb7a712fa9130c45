"""Substring dedup: content-defined chunks, cut by a gear rolling hash.

A gear hash rolls over a text's bytes; a chunk ends at a white-space byte whose hash is
divisible by ``every``, so about every fifth word. Within unbroken runs, that is where the
hash's window holds no white space, a chunk ends after a non-ASCII character whose hash is
divisible by RUN_EVERY; a far stricter test cuts at any character's end. The hash covers the last 16 bytes, so chunks depend on
nearby text alone: an insertion moves no boundary beyond its own neighbourhood. Chunks
with equal 96-bit digests are copies; the first in order of (row, place) stays. Copies
are cut out where they follow each other over at least ``min_words`` words, so short
phrases that texts share by chance stay.

Digests travel packed by block, one row per task and block, and a block's task sorts them:
a chunk that a third of all documents hold is a run in a sorted array. Such chunks are
thinned first: of equal digests in a task only the first is dealt to a block, as the rest
are copies in any case.

Null texts stay null, empty texts empty. Rows go by doc_id, null ones last, and by their
text's hash: rows that share a doc_id, or have none, with other texts are documents of
their own, and passages that they share are cut. Rows that repeat both are one document:
they keep the same text. An empty table gives no rows. Other columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, small_batches

EVERY, MIN_WORDS = 5, 12
#: Characters per chunk, on average, in scripts without spaces.
RUN_EVERY = 11
#: Chunks per block, on average.
BLOCK_CHUNKS = 1_000_000
FLUSH = 1_000_000
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=2).digest() for i in range(256)), np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_LAST = (1 << 63) - 1
_ENTRY = np.dtype([("d1", "<u8"), ("d2", "<u4"), ("doc", "<i8"), ("row", "<i8"), ("at", "<u4")])
_FLAG = np.dtype([("at", "<u4"), ("tag", "<u4"), ("src", "<i8")])


def chunk_ends(data: bytes, every: int = EVERY) -> np.ndarray:
    """Where the chunks of a text's bytes end."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.empty(0, np.int64)
    g = _GEAR[a]
    h = g.copy()
    for j in range(1, min(16, len(a))):
        h[j:] += g[:-j] << np.uint16(j)
    whole = np.append((a[1:] & 0xC0) != 0x80, True)
    cut = (_SPACE[a] & (h % every == 0)) | (whole & (h % 509 == 0))
    far = np.flatnonzero(whole & (a >= 0x80) & (h % RUN_EVERY == 0))
    if len(far):
        spaces = np.concatenate([[0], np.cumsum(_SPACE[a])])
        cut[far[spaces[far + 1] == spaces[np.maximum(far - 15, 0)]]] = True
    cut[-1] = True
    return np.flatnonzero(cut) + 1


def _digests(data: bytes, ends: np.ndarray) -> np.ndarray:
    out, at = [], 0
    for e in ends.tolist():
        out.append(xxhash.xxh3_128_digest(data[at:e]))
        at = e
    raw = np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)
    return raw


def _firsts(parts):
    """Entries in order, without repeated rows; which are the first of their digest; and for
    each the first's index."""
    e = np.concatenate(parts)
    e = e[np.lexsort((e["at"], e["row"], e["doc"], e["d2"], e["d1"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["d1"][1:] != e["d1"][:-1]) | (e["d2"][1:] != e["d2"][:-1])
    once = new.copy()
    once[1:] |= (e["doc"][1:] != e["doc"][:-1]) | (e["row"][1:] != e["row"][:-1]) | (e["at"][1:] != e["at"][:-1])
    e, new = e[once], new[once]
    return e, new, np.flatnonzero(new)[np.cumsum(new) - 1]


def _entries(every: int, blocks: int):
    def pack(parts):
        e, new, first = _firsts(parts)
        flags = _flags(e, first)
        one = e[new]
        block = (one["d1"] % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((one["at"], one["row"], one["doc"], block))
        ids, docs, rows, blobs = [], [], [], []
        for idx in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            part = one[idx]
            ids.append(int(block[idx[0]]))
            docs.append(None)
            rows.append(None)
            blobs.append(zlib.compress(b"".join(np.ascontiguousarray(part[f]).tobytes() for f in _ENTRY.names), 1))
        for n, (doc, row, blob) in enumerate(flags):
            ids.append(n % blocks)
            docs.append(doc)
            rows.append(row)
            blobs.append(blob)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, docs, rows)] + [pa.array(blobs, pa.binary())], ["block", "doc", "row", "flags"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for doc, row, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not text:
                    continue
                data = text.encode("utf-8", "surrogatepass")
                d = _digests(data, chunk_ends(data, every))
                e = np.empty(len(d), _ENTRY)
                e["d1"], e["d2"], e["doc"], e["row"], e["at"] = d[:, 0], d[:, 1] >> np.uint64(32), _LAST if doc is None else doc, row, np.arange(len(d))
                parts.append(e)
                held += len(e)
                if held >= FLUSH:
                    yield pack(parts)
                    parts, held = [], 0
        if parts:
            yield pack(parts)

    return run


def _flags(e: np.ndarray, first: np.ndarray):
    """By document (doc, row), the entries that aren't the first of their digest."""
    src = e[first]
    copy = (src["doc"] != e["doc"]) | (src["row"] != e["row"]) | (src["at"] != e["at"])
    f = np.empty(int(copy.sum()), _FLAG)
    f["at"], f["tag"], f["src"] = e["at"][copy], e["d2"][copy], src["doc"][copy]
    doc, row = e["doc"][copy], e["row"][copy]
    order = np.lexsort((row, doc))
    f, doc, row = f[order], doc[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])) if len(doc) else []
    ends = np.append(starts[1:], len(doc)) if len(doc) else []
    raw = f.tobytes()
    return [(int(doc[i]), int(row[i]), raw[i * _FLAG.itemsize : j * _FLAG.itemsize]) for i, j in zip(starts, ends)]


def _block(tbl: pa.Table) -> pa.Table:
    docs, rows, blobs, parts = [], [], [], []
    for doc, row, blob in zip(*(tbl.column(c).to_pylist() for c in ("doc", "row", "flags"))):
        if doc is not None:
            docs.append(doc)
            rows.append(row)
            blobs.append(blob)
            continue
        raw = zlib.decompress(blob)
        n, at = len(raw) // _ENTRY.itemsize, 0
        e = np.empty(n, _ENTRY)
        for f in _ENTRY.names:
            w = _ENTRY[f].itemsize
            e[f] = np.frombuffer(raw, _ENTRY[f], n, at)
            at += n * w
        parts.append(e)
    if parts:
        e, _, first = _firsts(parts)
        for doc, row, blob in _flags(e, first):
            docs.append(doc)
            rows.append(row)
            blobs.append(blob)
    return pa.table({"doc": pa.array(docs, pa.int64()), "row": pa.array(rows, pa.int64()), "flags": pa.array(blobs, pa.binary())})


def cut_spans(data: bytes, flags: np.ndarray, every: int, min_words: int):
    """Byte spans to cut, and the documents they are copies from."""
    ends = chunk_ends(data, every)
    d = _digests(data, ends)
    flags = flags[(flags["at"] < len(ends))]
    flags = flags[(d[flags["at"], 1] >> np.uint64(32)) == flags["tag"]]
    copy, src = np.zeros(len(ends), bool), np.zeros(len(ends), np.int64)
    copy[flags["at"]], src[flags["at"]] = True, flags["src"]
    space = _SPACE[np.frombuffer(data, np.uint8)]
    words = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
    starts = np.concatenate([[0], ends[:-1]])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], copy.view(np.int8), [0]])))
    spans, sources = [], set()
    for i, j in zip(edge[::2], edge[1::2]):
        s, e = int(starts[i]), int(ends[j - 1])
        if words[e] - words[s] >= min_words or e - s >= LONG_BYTES:
            spans.append((s, e))
            sources.update(src[i:j].tolist())
    return spans, sorted(sources)


#: A run of copies this long is cut however few words it has (scripts without spaces).
LONG_BYTES = 200


def _cut(at: int, every: int, min_words: int):
    def run(batches):
        for b in batches:
            row, blobs = b.column(0), b.column(1).to_pylist()
            fields = [row.field(i) for i in range(row.type.num_fields)]
            texts, spans, sources = [], [], []
            for text, parts in zip(fields[at].to_pylist(), blobs):
                cuts, src = [], []
                if text and parts:
                    data = text.encode("utf-8", "surrogatepass")
                    cuts, src = cut_spans(data, np.frombuffer(b"".join(parts), _FLAG), every, min_words)
                    if cuts:
                        keep, last = [], 0
                        for s, e in cuts:
                            keep.append(data[last:s])
                            last = e
                        text = b"".join([*keep, data[last:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
                spans.append([{"start": s, "end": e} for s, e in cuts])
                sources.append([x for x in src if x != _LAST])
            fields[at] = pa.array(texts, pa.string())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.StructArray.from_arrays(fields, names=[f.name for f in row.type]), pa.array(spans, span), pa.array(sources, pa.list_(pa.int64()))], ["r", "spans", "sources"]
            )

    return run


def dedup(docs: DataFrame, every: int = EVERY, min_words: int = MIN_WORDS) -> DataFrame:
    """(r, spans, sources): the row with its text cut, the byte spans cut from the whole
    text, and the doc_ids of earlier documents that hold them."""
    spark = docs.sparkSession
    small_batches(spark)
    row = F.xxhash64(F.col("text").cast("string"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.col("text").cast("string").alias("text"))
    size = d.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(8, int(size) // (6 * every * BLOCK_CHUNKS))
    s = Scratch(spark, "chunk-dedup")
    packed = d.mapInArrow(_entries(every, blocks), "block long, doc long, row long, flags binary")
    flags = packed.groupBy("block").applyInArrow(_block, "doc long, row long, flags binary").groupBy("doc", "row").agg(F.collect_list("flags").alias("flags"))
    flags = s.keep(s.write(flags, "copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), row.alias("row"))
    both = rows.join(flags, ["doc", "row"], "left").select("r", "flags")
    fields = "r " + docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")).schema["r"].dataType.simpleString()
    return both.mapInArrow(_cut(docs.columns.index("text"), every, min_words), f"{fields}, spans array<struct<start: long, end: long>>, sources array<long>")
