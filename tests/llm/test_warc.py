import base64
import glob
import hashlib

import pytest

from tidemark.llm import warc as op

INNER = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 777\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 7\r\n\r\nA: b\r\n\r\nq\r\n\r\n"
ROWS = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, "http://a/3\r\nX: y", "<p>one</p>"),
    (4, None, ""),
    (5, "u", None),
    (6, "u", "before " + INNER + " after"),
    (7, "u", INNER),
    (8, "u", "WARC/1.1\r\n"),
    (9, "u", "WARC/1.1\r\nWARC/1.1\r\n" * 3 + "x\r\n\r\nWARC/1.1"),
    (10, "u", "é\r\n\r\n" * 400),
    (11, "u", "long " * 4_000),
    (12, "u", "\r\n\r\n"),
    (None, "u", "no id"),
    (20, "u", "twice"),
    (20, "u", "twice"),
]


def expected(rows, least=0):
    largest, n = {}, {}
    for i, _, h in rows:
        b = (h or "").encode()
        n[b] = n.get(b, 0) + 1
        if i is not None:
            largest[b] = max(i, largest.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= least and n[b] > 1 and largest[b] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", largest[b] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split,least,bound", [("128m", 0, 200_000), ("400b", 0, 0), ("3k", 11, 200_000)])
def test_round_trip(spark, tmp_path, monkeypatch, split, least, bound):
    monkeypatch.setattr(op, "BROADCAST_ROWS", bound)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS at", "2 AS bytes").repartition(2)
    path = str(tmp_path / "archives")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted((tuple(r) for r in op.round_trip(df, path, least).collect()), key=str)
        assert got == expected(ROWS, least)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    whole = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*")))
    at = count = 0
    while at < len(whole):  # a plain reader follows the lengths from record to record
        assert whole.startswith(b"WARC/1.1\r\n", at)
        end = whole.index(b"\r\n\r\n", at)
        length = int(whole[at:end].split(b"Content-Length: ")[1].split(b"\r\n")[0])
        at = end + 4 + length
        assert whole[at : at + 4] == b"\r\n\r\n"
        at += 4
        count += 1
    assert count == len(ROWS)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert op.round_trip(df, str(tmp_path / "none")).count() == 0


def test_two_reads_with_other_splits_agree(spark, tmp_path):
    path = str(tmp_path / "archives")
    op.write(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1), path)
    name, old, got = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for split in ("64m", "1k", "7k"):
            spark.conf.set(name, split)
            got.append(sorted(tuple(r) for r in op.read(spark, path).select("at", "bytes", "computed", "type").collect()))
    finally:
        spark.conf.set(name, old)
    assert got[0] == got[1] == got[2] and len(got[0]) == len(ROWS)


def test_a_broken_chain_raises(spark, tmp_path):
    path = tmp_path / "archives"
    path.mkdir()
    op.write(spark.createDataFrame(ROWS[:4], "page_id long, url string, html string").coalesce(1), str(path / "whole"))
    whole = b"".join(open(f, "rb").read() for f in glob.glob(f"{path}/whole/part-*"))
    (path / "torn").mkdir()
    (path / "torn" / "part-0").write_bytes(whole.replace(b"Content-Length: 89", b"Content-Length: 88", 1) if b"Content-Length: 89" in whole else whole[:-9])
    with pytest.raises(ValueError, match="stops at"):
        op.read(spark, str(path / "torn"))


def test_pointer_jumping_follows_long_chains(spark):
    links = [("f", 3 * i, 3 * i + 3 if i < 99 else None, 3 * i + 3) for i in range(100)] + [("f", 3 * i + 1, 3 * i + 4, 3 * i + 5) for i in range(50)] + [("g", 1, None, None), ("g", 0, None, None)]
    got = {tuple(r) for r in op.reachable(spark.createDataFrame(links, "file string, node long, to long, to_entry long")).collect()}
    assert got == {("f", 3 * i, 3 * i) for i in range(100)} | {("g", 0, 0)}
