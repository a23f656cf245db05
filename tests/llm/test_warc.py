"""Archives: seek table, frames, revisits, random access."""

import zstandard
from pyarrow import fs

from inkproof.llm import warc

ROWS = [
    (1, "http://a.example/", "<p>é</p>"),
    (2, "http://b.example/\r\nX: y", "<p>é</p>"),
    (3, None, None),
    (4, "http://c.example/", ""),
    (5, "http://d.example/", "x" * 300_000),
    (6, "http://e.example/", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"),
    (7, "http://a.example/", "<p>é</p>"),
    (7, "http://a.example/", "<p>é</p>"),
    (None, "http://n.example/", "<p>é</p>"),
]


def _pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as kind")


def test_round_trip(spark):
    index = warc.write_archives(_pages(spark), frame_bytes=400)
    rows = warc.read_archives(index).collect()
    assert len(rows) == len(ROWS)
    want = {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), 6: ("response", None), 7: ("revisit", 1), None: ("revisit", 1)}
    by_id = {k: (h or "").encode() for k, _, h in ROWS}
    for row in rows:
        assert (row.record_type, row.refers_to) == want[row.page_id]
        assert (row.payload_bytes, row.payload_digest) == (len(by_id[row.page_id]), warc.payload_digest(by_id[row.page_id]))
        assert bytes(row.payload) == (by_id[row.page_id] if row.record_type == "response" else b"")
    assert {r.url for r in rows if r.page_id == 2} == {"http://b.example/%0D%0AX: y"}
    assert len({r.payload_digest for r in rows}) == 4 and warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_bundles_are_seekable(spark):
    index = warc.write_archives(_pages(spark).coalesce(1), frame_bytes=200, bundle_bytes=500).collect()
    assert len({r.bundle for r in index}) > 1
    for name in {r.bundle for r in index}:
        frames = sorted((r.frame_offset, r.frame_size, r.frame_bytes) for r in index if r.bundle == name)
        system, path = fs.FileSystem.from_uri(name)
        with system.open_input_file(path) as file:
            assert warc.seek_table(file) == frames
            whole = file.read_at(file.size(), 0)
        # an ordinary decoder skips the seek table
        with zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True) as reader:
            assert reader.read().count(b"WARC/1.1\r\nWARC-Type") == sum(len(r.records) for r in index if r.bundle == name)


def test_fetch_reads_single_records(spark):
    index = warc.write_archives(_pages(spark), frame_bytes=1)
    got = warc.fetch(index, spark.createDataFrame([(6,), (5,), (99,), (None,), (5,)], "page_id long")).collect()
    assert sorted(r.page_id for r in got) == [5, 6]


def test_no_revisits_of_small_payloads(spark):
    rows = warc.read_archives(warc.write_archives(_pages(spark), revisit_bytes=100), payload=False).collect()
    assert {r.record_type for r in rows} == {"response"}


def test_damage_is_an_error():
    record = warc.make_record(1, "u", b"abc", "response", None)
    try:
        warc.parse_record(record.replace(b"abc", b"abd"))
    except ValueError as error:
        assert "damaged" in str(error)
    else:
        raise AssertionError


def test_empty(spark):
    assert warc.read_archives(warc.write_archives(_pages(spark, []))).collect() == []
