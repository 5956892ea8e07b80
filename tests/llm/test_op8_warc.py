import base64
import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from turnweave.llm import op8_warc as op


def brute(rows, min_bytes=0):
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    largest = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= min_bytes:
            largest.setdefault(sha(h), []).append(p)
    out = []
    for p, _, h in rows:
        n = len((h or "").encode())
        top = max(largest.get(sha(h), []), default=None)
        revisit = n >= min_bytes and top is not None and top != p
        out.append((p, n, sha(h), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, None), (4, "http://b", ""), (9, "u\r\nX: 1", "a\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://n", "lone"), (None, "http://n", "<p>é</p>"), (7, "http://l", "long " * 300_000), (8, "http://l", "long " * 300_000), (5, "s", "twice"), (5, "s", "twice")]


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_matches_brute_force(spark, min_bytes):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3).withColumn("file", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op.warc_digest(df, min_bytes=min_bytes).collect()]
    assert sorted(got, key=str) == brute(ROWS, min_bytes)


def test_empty_table(spark):
    assert op.warc_digest(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_archives_are_members_with_a_sidecar_and_hold_the_payloads(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    index = op.write_archives(df, f"file://{tmp_path}")
    names = sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc"))
    assert names and all(n.endswith((".warc.gz", ".warc.gz.idx")) for n in names)
    for r in index.collect():
        data = (tmp_path / r.file).read_bytes()[r.offset : r.offset + r.length]
        z = zlib.decompressobj(31)
        assert z.decompress(data).startswith(b"WARC/1.1\r\n") and z.eof and not z.unused_data
    payloads = sorted((r.page_id, r.html) for r in op.read_archives(index, f"file://{tmp_path}").where("record_type = 'response' AND page_id IS NOT NULL").collect())
    assert payloads == [(2, "<p>é</p>"), (4, ""), (5, "twice"), (5, "twice"), (8, ROWS[7][2]), (9, ROWS[4][2])]


def test_normalise_takes_one_stream_or_many_and_refuses_cut_files():
    record = lambda i: op._record("response", i, f"http://x/{i}", b"x" * i * 50_000, op.digest32(b"x" * i * 50_000), None)
    whole = b"".join(map(record, range(12)))
    many = b"".join(gzip.compress(record(i)) for i in range(12))
    outs = []
    for source in (gzip.compress(whole), many):
        out = io.BytesIO()
        entries = list(op.normalise(io.BytesIO(source), out))
        assert [int(h["x-page-id"]) for h, _, _ in entries] == list(range(12))
        for i, (_, at, n) in enumerate(entries):
            assert gzip.decompress(out.getvalue()[at : at + n]) == record(i)
        outs.append(out.getvalue())
    assert outs[0] == outs[1]
    assert list(op.normalise(io.BytesIO(b""), io.BytesIO())) == []
    with pytest.raises(ValueError):
        list(op.normalise(io.BytesIO(gzip.compress(whole)[:-2000]), io.BytesIO()))
    with pytest.raises(ValueError):
        list(op.normalise(io.BytesIO(gzip.compress(whole[:-9])), io.BytesIO()))
