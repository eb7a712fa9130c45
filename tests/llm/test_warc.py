import struct

import pytest
import zstandard

from quillgraph.llm import warc


def test_round_trip_of_every_case(spark):
    rows = [(i, f"http://h/{i}\r\nX: y", f"<p>page {i % 40} é</p>" * (i % 17)) for i in range(200)]
    rows += [(300, None, None), (301, "u", ""), (-5, "u", "<p>page 3 é</p>" * 3), (None, "n", "<p>page 3 é</p>" * 3), (400, "u", "x" * 500_000), (401, "u", "\r\n\r\nWARC/1.1\r\n")]
    rows += [(400, "again", "x" * 500_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = sorted((i if i is not None else 10**9, len((h or "").encode()), warc.sha1_base32((h or "").encode()), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    key = lambda r: (r[0], r[1], r[2], r[3], r[4] if r[4] is not None else 10**9)
    assert sorted(map(key, want)) == sorted(key((r.page_id if r.page_id is not None else 10**9, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    urls = {r.page_id: r.url for r in warc.read(warc.archives(df)).collect()}
    assert urls[5] == "http://h/5%0D%0AX:%20y"


def test_min_revisit(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), 5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_dictionary_leads_and_helps():
    recs = [warc.record(i, f"http://host/{i}", (f"<html><head><title>{i}</title></head>" + "<div class='row'>cell</div>" * 3).encode()) for i in range(300)]
    data = warc.write_archive(recs)
    magic, n = struct.unpack_from("<II", data)
    assert magic == warc.SKIPPABLE and n > 0
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in recs)
    assert len(data) - n < plain * 0.7
    assert [b for _, _, b in warc.read_archive(data)] == [r.split(b"\r\n\r\n", 1)[1][:-4] for r in recs]
    # a dictionary stored plain
    d = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    plain = struct.pack("<II", warc.SKIPPABLE, len(d)) + d + data[8 + n :]
    assert len(list(warc.read_archive(plain))) == 300


def test_faults_are_found(spark):
    good = warc.write_archive([warc.record(1, "u", b"abc"), warc.record(2, "u", b"defg")])
    n = struct.unpack_from("<I", good, 4)[0]
    z = zstandard.ZstdCompressor(write_checksum=True).compress
    lead = struct.pack("<II", warc.SKIPPABLE, 0)
    rec = warc.record(3, "u", b"abc")
    bad = {
        "none": b"", "no lead": good[8 + n :], "cut": good[:-3], "lead cut": good[:6], "junk": good + b"junk!",
        "length": lead + z(rec.replace(b"Content-Length: ", b"Content-Length: 1", 1)), "digest": lead + z(rec.replace(b"abc\r\n\r\n", b"abd\r\n\r\n")),
        "version": lead + z(rec.replace(b"WARC/1.1", b"WARC/9.9")), "type": lead + z(rec.replace(b"WARC-Type", b"WARC-Tipe")), "flip": lead + bytes(x ^ (i == 30) for i, x in enumerate(z(rec))),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in bad.items()], "archive string, content binary")
    got = warc.read(df, strict=False).collect()
    assert {r.archive for r in got if r.error} == set(bad)
    with pytest.raises(ValueError):
        list(warc.read_archive(bad["cut"]))


def test_files_on_disk_and_empty_table(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(warc.write_archive([warc.record(1, "u", b"abc")]))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [(r.page_id, bytes(r.payload)) for r in warc.read(files, "path").collect()] == [(1, b"abc")]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string, digest int")).collect() == []


def test_clashing_names_and_long_payloads(spark):
    rows = [(1, "u", "a", "d", 5, "x"), (2, "u", "a", None, None, None), (3, "u", "z" * 3_000_000, "d", 1, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first int, payload string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {1: (1, "response", None), 2: (1, "revisit", 1), 3: (3_000_000, "response", None)}
