"""Operator 13: archives are written, read back and held against the rule."""

import glob
import hashlib

import duckdb
import pytest
import zstandard

from lattica.llm import warc


def _rows():
    page = "<html><body>" + "".join(f"<p>paragraph {k} of the page</p>" for k in range(60))
    rows = [(k, f"http://a.example/{k}", f"{page}{k % 3}") for k in range(40)]
    rows += [(100 + k, "http://b.example/\r\nX: y z ", "short") for k in range(5)] + [(200, None, None), (201, "", ""), (None, "http://c.example", page + "0"), (None, None, "é" * 499 + "xy"), (300, "u", "é" * 499 + "xy")]
    return rows + [(301, "WARC", "WARC/1.1\r\n\r\nP*M\x18\x00\x00\x00\x00" * 90), (302, "big", "x" * 3_000_000), (303, "P", "P*M\x18\x00\x00\x00\x00")]


def _want(rows):
    best = {}
    for p, u, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            best[b] = max(best.get(b, (-1, "")), (-1 if p is None else p, u or ""))
    out = []
    for p, u, h in rows:
        b = (h or "").encode()
        kept = best.get(b)
        old = kept and (-1 if p is None else p, u or "") < kept
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if old else "response", kept[0] if old else None))
    return sorted(map(str, out))


def _pages(spark, rows):
    return spark.createDataFrame([(*r, r[0], 1) for r in rows], "page_id long, url string, html string, digest long, `a.b` int").repartition(3)


@pytest.mark.parametrize("train", [1 << 10, 8 << 20])
def test_round_trip(spark, tmp_path, train):
    rows = _rows()
    warc.write_warcs(_pages(spark, rows), str(tmp_path / "w"), train)
    back = warc.read_warcs(spark, str(tmp_path / "w")).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in back) == _want(rows)
    texts = {(p, h or "") for p, _, h in rows}
    assert all(r.html is None if r.record_type == "revisit" else (r.page_id, r.html) in texts for r in back) and {r.record_type for r in back} == {"response", "revisit"}
    assert {r.url for r in back if r.page_id == 100} == {"http://b.example/%0D%0AX:%20y%20z%E2%80%A8"} and len([r for r in back if r.page_id is None]) == 2


def test_files_hold_their_dictionary_and_single_records(spark, tmp_path):
    warc.write_warcs(_pages(spark, _rows()), str(tmp_path / "w"))
    heads = 0
    for name in glob.glob(str(tmp_path / "w" / "part-*")):
        body = open(name, "rb").read()
        if body[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little"):
            heads += 1
            size = int.from_bytes(body[4:8], "little")
            assert body[8:12] == (0xEC30A437).to_bytes(4, "little")
            assert body[8 + size : 16 + size] == warc.GAP.encode()
            first = body[16 + size :]
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body[8 : 8 + size]))
            assert reader.decompressobj().decompress(first).startswith(b"WARC/1.1\r\nWARC-Type: ")
            with pytest.raises(zstandard.ZstdError):
                zstandard.ZstdDecompressor().decompressobj().decompress(first)
    assert heads


def test_empty_ties_and_broken_files(spark, tmp_path):
    none = _pages(spark, _rows()).limit(0)
    warc.write_warcs(none, str(tmp_path / "none"))
    assert warc.read_warcs(spark, str(tmp_path / "none")).count() == 0
    twice = [(7, "u", "y" * 1000)] * 2 + [(6, "u", "y" * 1000), (7, "t", "y" * 1000)]
    warc.write_warcs(_pages(spark, twice), str(tmp_path / "twice"))
    got = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.read_warcs(spark, str(tmp_path / "twice")).collect())
    assert got == [(6, "revisit", 7), (7, "response", 0), (7, "response", 0), (7, "revisit", 7)]
    whole = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest())
    with pytest.raises(ValueError):
        warc.parsed(whole.replace(b"abc", b"abd"))
    body = b"".join(warc.frames(iter([whole] * 3)))
    assert list(warc.unpacked(memoryview(body), 7)) == [whole] * 3
    for cut in (body[:-1], body + b"abcd"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.unpacked(memoryview(cut)))


def test_sql(spark, tmp_path):
    rows = [r for r in _rows() if r[0] is not None]
    _pages(spark, rows).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    rel = con.sql(warc.OP13_SQL)
    got = warc.op13_warc(spark, str(tmp_path))
    assert got.columns == rel.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rel.fetchall()))
