import hashlib
import random

import numpy as np
import xxhash

from quillgraph.llm import chunk_dedup as cd


GEAR = [int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=2).digest(), "little") for i in range(256)]


def naive_ends(data):
    """Chunk ends byte by byte: a 16-bit gear hash rolls, and its last 16 bytes decide."""
    ends, h, last_space = [], 0, -1
    for i, x in enumerate(data):
        h = ((h << 1) + GEAR[x]) & 0xFFFF
        space = x in b"\t\n\v\f\r "
        last_space = i if space else last_space
        whole = i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80
        run = whole and x >= 0x80 and h % cd.RUN_EVERY == 0 and last_space < max(i - 15, 0)
        if (space and h % cd.EVERY == 0) or (whole and h % 509 == 0) or run or i + 1 == len(data):
            ends.append(i + 1)
    return ends


def signed(text):
    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def brute(rows):
    """The same rule without blocks: the first (doc_id, hash of the text, place) of every
    chunk stays. Keyed by doc_id where those differ, else by (doc_id, text)."""
    seen, chunks = {}, {}
    for doc, text in sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]))):
        data, at = text.encode(), 0
        for i, e in enumerate(naive_ends(data)):
            chunks.setdefault((doc, text), []).append((at, e, seen.setdefault(data[at:e], (doc, text, i)) != (doc, text, i)))
            at = e
    out, alone = {}, len({d for d, _ in rows}) == len(rows)
    for doc, text in rows:
        key = doc if alone else (doc, text)
        keep, run, data = [], [], (text or "").encode()
        for s, e, copy in [*chunks.get((doc, text), []), (0, 0, False)]:
            if copy:
                run.append((s, e))
                continue
            if run:
                part = data[run[0][0] : run[-1][1]]
                if len(part.split()) < cd.MIN_WORDS and len(part) < cd.LONG_BYTES:
                    keep.append(part)
                run = []
            keep.append(data[s:e])
        out[key] = None if text is None else b"".join(keep).decode()
    return out


def test_same_as_brute_force_and_passages_go(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = words(60)
    rows = [(i, words(rng.randrange(0, 90))) for i in range(79)] + [(79, words(50))]
    for i in range(80, 110):
        a, b = words(40), words(40)
        rows.append((i, f"{a} {passage} {b}"))
    rows += [(200, rows[79][1]), (201, None), (202, ""), (203, "日本語の文章です。" * 80), (204, "前置き" + "日本語の文章です。" * 80), (205, words(20000))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.r.doc_id: r.r.text for r in cd.dedup(df).collect()}
    assert got == brute(rows)
    kept = [d for d in range(80, 110) if passage[60:-60] in got[d]]
    assert kept == [80]
    assert got[200] == "" and got[201] is None and all(got[i] == t for i, t in rows if i < 80)


def test_insertions_shift_no_boundary():
    rng = np.random.default_rng(1)
    text = " ".join("".join(map(chr, rng.integers(97, 105, 6))) for _ in range(2000)).encode()
    a = {text[s:e] for s, e in zip([0, *cd.chunk_ends(text)], cd.chunk_ends(text))}
    moved = b"new words " + text[:3000] + b"inserted " + text[3000:]
    b = {moved[s:e] for s, e in zip([0, *cd.chunk_ends(moved)], cd.chunk_ends(moved))}
    assert len(a - b) <= 4


def test_clashing_columns_repeats_and_empty(spark):
    schema = "doc_id long, text string, flags binary, block long, doc int, r string"
    t = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3
    rows = [(1, t, None, 3, 4, "x"), (1, t, None, 3, 4, "x"), (None, t, None, 1, 1, None), (2, None, None, None, None, None)]
    out = cd.dedup(spark.createDataFrame(rows, schema)).collect()
    one = [x.r.text for x in out if x.r.doc_id == 1]
    assert len(out) == 4 and one[0] == one[1] != "" and [x.r.text for x in out if x.r.doc_id is None] == [""]
    assert cd.dedup(spark.createDataFrame([], schema)).collect() == []


def test_one_shared_passage_without_spaces_goes(spark):
    rng = random.Random(8)
    for low, high in ((0x4E00, 0x9FA5), (0x3041, 0x3094), (0x0E01, 0x0E2F)):
        run = lambda n: "".join(chr(rng.randrange(low, high)) for _ in range(n))
        passage = run(120)
        rows = [(i, run(300) + passage + run(300)) for i in range(6)]
        got = {r.r.doc_id: r.r.text for r in cd.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[0] == rows[0][1]
        for i, text in rows[1:]:
            assert passage[40:80] not in got[i] and got[i].startswith(text[:300]) and got[i].endswith(text[-300:])


def test_rows_without_or_with_one_doc_id_are_cut_too(spark):
    """A passage that rows with a null or a repeated doc_id share stays once."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = words(60)
    rows = [(doc, passage + " " + words(30) if i % 2 else words(20) + " " + passage) for doc in (None, 7, None, 7) for i in range(6)]
    rows += [(None, rows[3][1])] * 3 + [(7, None), (None, ""), (3, words(9))] + [(i, words(40)) for i in range(100, 140)]
    for parts in (1, 4):
        got = {}
        for r in cd.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect():
            got.setdefault(r.r.doc_id, []).append(r.r.text)
        want = {}
        by = brute(rows)
        for row in rows:
            want.setdefault(row[0], []).append(by[row])
        order = lambda xs: sorted(xs, key=lambda t: (t is None, t or ""))
        assert {d: order(t) for d, t in got.items()} == {d: order(t) for d, t in want.items()}
        assert sum(passage[80:-80] in (t or "") for ts in got.values() for t in ts) == 1
