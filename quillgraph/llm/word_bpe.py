"""BPE encoding and decoding through a table of distinct words.

Texts are split at white space (nothing in this tokenizer's normaliser, split pattern or
special tokens reaches across it), each distinct word is encoded once by the tokenizers
library, and ids return to the words' places. Decoding joins ids to the vocabulary's
pieces, by one space as the library does without a decoder.

Documents are grouped into chunks of about CHUNK_BYTES of text, so that a word crosses the
network once per chunk that has it, not once per place: a chunk's distinct words, packed
by hash of the word, go to the word table and their ids come back to the chunk. A word
that every text holds is so one entry per chunk. A chunk sends a packet to each part of the
table that it has words for, and so no more packets than it has distinct words, however
many parts a large input makes. Documents are read twice, once for their
words and once for their texts, and a chunk is known by a digest of its documents, so the
two readings needn't deal rows alike: a chunk that finds no ids under its digest (its
source gave other rows the second time) has its own words encoded on the spot.

Null texts count as empty: no ids, empty decoded text. Repeated rows each get their row;
a null doc_id stays null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches
from .byte_bpe import library

VOCABULARY = "word_bpe_49k.json"
CHUNK_BYTES = 24_000_000
#: Distinct words that one task of the word table encodes at a time.
WORD_BATCH = 20_000
#: White space as the tokenizer sees it (unlike str.split, without 0x1C to 0x1F).
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = "\x1c\x1d\x1e\x1f"
#: Between a word's ids and its pieces: a byte that UTF-8 never has.
_BAR = b"\xff"


def words_of(text: str) -> list[str]:
    if any(c in text for c in _ODD):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def _pack(items: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(items)) + np.array([len(x) for x in items], "<u4").tobytes() + b"".join(items))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)).tolist()
    at, body = 0, memoryview(raw)[4 + 4 * n :]
    out = []
    for e in ends:
        out.append(bytes(body[at:e]))
        at = e
    return out


def _ids(vocabulary: str, words: list[bytes]) -> list[list[int]]:
    tok = library(vocabulary)
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)  # the same ids, without offsets
    return [e.ids for e in encode([w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)]


_tables: dict[str, tuple[list[bytes], list[bytes]]] = {}


def _id_table(vocabulary: str) -> tuple[list[bytes], list[bytes]]:
    """By id: the id as decimal text, and its piece (the id-to-piece table)."""
    if vocabulary not in _tables:
        tok = library(vocabulary)
        n = 1 + max(tok.get_vocab(with_added_tokens=True).values(), default=-1)
        _tables[vocabulary] = [str(i).encode() for i in range(n)], [(tok.id_to_token(i) or "").encode("utf-8", "surrogatepass") for i in range(n)]
    return _tables[vocabulary]


def _parted(texts: list[str], parts: int) -> list[list[bytes]]:
    """The distinct words of texts, sorted, by part of the word table."""
    words: set[str] = set()
    for t in texts:
        words.update(words_of(t))
    out: list[list[bytes]] = [[] for _ in range(parts)]
    for w in words:
        raw = w.encode("utf-8", "surrogatepass")
        out[zlib.crc32(raw) % parts].append(raw)
    return [sorted(p) for p in out]


def _answer(ids: list[list[int]]) -> bytes:
    counts, flat = np.array([len(x) for x in ids], "<u4"), np.array([i for x in ids for i in x], "<u4")
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(ids)) + counts.tobytes() + (flat.astype("<u2") if not len(flat) or flat.max() < 1 << 16 else flat).tobytes())


def _read_answer(blob: bytes) -> tuple[list[int], list[int]]:
    """Where each word's ids end, and all ids."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)).tolist()
    body = raw[4 + 4 * n :]
    return ends, np.frombuffer(body, "<u2" if ends and len(body) == 2 * ends[-1] else "<u4").tolist()


def _chunks(parts: int):
    """With parts, (chunk, part, blob): a chunk's distinct words by hash. With 0, its
    documents as part -1."""

    def emit(ids, texts):
        keys = [b"" if i is None else struct.pack("<q", i) for i in ids]
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        digest = hashlib.blake2b(digest_size=16)
        for x in [*keys, *raw]:
            digest.update(struct.pack("<I", len(x)))
            digest.update(x)
        blobs = {n: _pack(p) for n, p in enumerate(_parted(texts, parts)) if p} if parts else {-1: _pack(keys + raw)}
        return pa.RecordBatch.from_arrays(
            [pa.array([digest.digest()] * len(blobs), pa.binary()), pa.array([*blobs], pa.int32()), pa.array([*blobs.values()], pa.binary())], ["chunk", "part", "blob"]
        )

    def run(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield emit(ids, texts)

    return run


def _word_table(vocabulary: str):
    """One part of the word table: all chunks' requests for it. Each distinct word is
    encoded once; every chunk's answer has its words as they came, and their ids in order."""

    def run(tbl: pa.Table) -> pa.Table:
        asked = [_unpack(b) for b in tbl.column("blob").to_pylist()]
        distinct = sorted({w for ws in asked for w in ws})
        ids: dict[bytes, list[int]] = {}
        for i in range(0, len(distinct), WORD_BATCH):
            some = distinct[i : i + WORD_BATCH]
            ids.update(zip(some, _ids(vocabulary, some)))
        return pa.table({"chunk": tbl.column("chunk"), "words": tbl.column("blob"), "answer": pa.array([_answer([ids[w] for w in ws]) for ws in asked], pa.binary())})

    return run


def _join_back(vocabulary: str, full: bool):
    """A chunk with its words and their ids: rows of documents, ids in place; ``full`` with
    ids and decoded texts themselves, else with their digests."""

    digest = lambda raw: hashlib.sha256(raw).hexdigest()

    def fill(out, keys, texts, known):
        for doc, text in zip(keys, texts):
            both = _BAR.join(filter(None, map(known.get, words_of(text)))).split(_BAR)  # one look-up a word
            ids, decoded = b" ".join(both[::2]), b" ".join(both[1::2])
            out["doc_id"].append(struct.unpack("<q", doc)[0] if doc else None)
            out["n_tokens"].append(ids.count(b" ") + 1 if ids else 0)
            out["ids"].append([int(i) for i in ids.split()] if full else digest(ids))
            out["decoded"].append(decoded.decode("utf-8", "surrogatepass") if full else digest(decoded))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        number, piece = _id_table(vocabulary)
        answers = [(_unpack(w), a) for w, a in zip(right.column("words").to_pylist(), right.column("answer").to_pylist())]
        out = {"doc_id": [], "n_tokens": [], "ids": [], "decoded": []}
        for blob in left.column("blob").to_pylist():
            items = _unpack(blob)
            half = len(items) // 2
            texts = [raw.decode("utf-8", "surrogatepass") for raw in items[half:]]
            known: dict[str, bytes] = {}  # by word: its ids as text, and their pieces
            if not right.num_rows:
                answers = [(words, _answer(_ids(vocabulary, words))) for words in _parted(texts, 1)]
            for words, answer in answers:
                ends, flat = _read_answer(answer)
                names, pieces = [number[i] for i in flat], [piece[i] for i in flat]
                at = 0
                for w, end in zip(words, ends):
                    if end > at:
                        known[w.decode("utf-8", "surrogatepass")] = b" ".join(names[at:end]) + _BAR + b" ".join(pieces[at:end])
                    at = end
            fill(out, items[:half], texts, known)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()) if full else pa.string(), pa.string()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text; unless ``full``, of the two the SHA-256
    in hex (of the decimal ids joined by a space, of the text in UTF-8)."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = d.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(8, int(size) // (4 * CHUNK_BYTES))
    kinds = "chunk binary, part int, blob binary"
    asked = d.mapInArrow(_chunks(parts), kinds)
    answers = asked.groupBy("part").applyInArrow(_word_table(vocabulary), "chunk binary, words binary, answer binary")
    texts = d.mapInArrow(_chunks(0), kinds)
    done = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _join_back(vocabulary, full), f"doc_id long, n_tokens long, ids {'array<int>' if full else 'string'}, decoded string"
    )
    return done
