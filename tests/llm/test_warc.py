"""Bundles are written and read back whole, and by single records."""

import hashlib
import io

import pytest
import zstandard

from tidemark.llm import warc

BIG = "<p>" + "große Seite " * 200


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"http://h/{i}", f"<p>{i % 50}</p>" * (i % 9)) for i in range(300)]
    out += [(1000 + i, "http://big/", BIG) for i in range(5)] + [(1004, None, BIG), (2000, "http://a\r\nb c", None), (None, None, "x"), (None, "u", BIG)]
    out += [(3000, "u", "a" * 999), (3001, "u", "a" * 999), (3002, "u", "b" * 1000), (3003, "u", "b" * 1000), (4000, "u", "\r\n\r\nWARC/1.1\r\n" * 90)]
    return out


@pytest.fixture(scope="module")
def stored(spark, rows):
    frame = spark.createDataFrame([(*r, "x", b"") for r in rows], "page_id long, url string, html string, digest string, data binary")
    bundles, index = warc.bundles(frame.repartition(3), bundle_bytes=2000, frame_bytes=3000)
    return bundles, index


def test_read_back(rows, stored):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h] = max(top.get(h, -1), i)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = top[h] if len(data) >= 1000 and i != top[h] else None
        expected.append((i, "response" if refers is None else "revisit", refers, len(data), hashlib.sha1(data).hexdigest(), data if refers is None else None))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload)) for r in warc.read_bundles(stored[0]).collect()]
    got = [(*g[:5], b"" if g[1] == "response" and not g[5] else g[5]) for g in got]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_single_records_by_index(rows, stored):
    bundles = {r.bundle: bytes(r.data) for r in stored[0].collect()}
    index = stored[1].collect()
    assert len(index) == len(rows) and len(bundles) > 3
    for entry in index:
        fields, payload = warc.fetch(bundles[entry.bundle], entry.frame, entry.offset)
        assert warc.page_of(fields["WARC-Record-ID"]) == entry.page_id
        frames = warc.seek_table(bundles[entry.bundle])
        assert entry.offset + entry.length <= frames[entry.frame][2]
    assert any(len(warc.seek_table(b)) > 1 for b in bundles.values())


def test_a_bundle_is_a_plain_zstd_file(stored):
    data = bytes(stored[0].first().data)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
    assert len(whole) == sum(unpacked for _, _, unpacked in warc.seek_table(data))


def test_damage_is_an_error(stored):
    data = bytearray(stored[0].first().data)
    data[-1] ^= 1
    with pytest.raises(ValueError):
        list(warc.records(bytes(data)))


def test_empty(spark):
    bundles, index = warc.bundles(spark.createDataFrame([], "page_id long, url string, html string"))
    assert bundles.collect() == [] and index.collect() == [] and warc.read_bundles(bundles).collect() == []
