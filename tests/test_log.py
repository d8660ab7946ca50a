import gzip
import json

import pytest
import zstandard

from tidemark.sources import log

HOUR = log.HOUR
T0 = 1_705_312_800_000_000_000  # 2024-01-15T10:00:00Z


def record(seq, t=T0, **more):
    return json.dumps({"seq": seq, "stream": "trades", "t_ingest": t, "t_event": None, "payload": {"k": seq}, **more})


def put(folder, name, text, pack=lambda b: b):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(pack(text.encode()))


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_files_in_order_with_the_tail_left_out(spark, tmp_path):
    whole = record(0) + "\n\n" + record(1) + "\n"
    put(tmp_path, "trades-20240115T10-00.ndjson", whole + record(2)[:20])
    put(tmp_path, "trades-20240115T10-01.ndjson.zst", record(3) + "\n" + record(4), zstandard.ZstdCompressor().compress)
    put(tmp_path, "trades-20240115T11-00.ndjson.gz", record(5) + "\n", gzip.compress)
    put(tmp_path, "_staged/trades-20240115T10-02.ndjson", record(9) + "\n")
    put(tmp_path, "notes.md", "nothing")
    put(tmp_path, "empty.ndjson", "")
    got = log.read_log(spark, str(tmp_path), log.SCHEMA + ", file string, line long").collect()
    assert sorted((r.file[7:21], r.line, r.seq) for r in got) == [("20240115T10-00", 1, 0), ("20240115T10-00", 3, 1), ("20240115T10-01", 1, 3), ("20240115T11-00", 1, 5)]
    assert {r.payload for r in got if r.seq == 0} == {'{"k":0}'}
    assert log.listed(str(tmp_path)) == log.listed(f"file://{tmp_path}") == log.listed(f"file:{tmp_path}")


def test_a_frame_still_open_gives_what_was_flushed(spark, tmp_path):
    packer = zstandard.ZstdCompressor().compressobj()
    body = packer.compress((record(0) + "\n" + record(1)[:9]).encode()) + packer.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
    put(tmp_path, "a.ndjson.zst", "", lambda _: body)
    put(tmp_path, "b.ndjson.zst", "", lambda _: zstandard.ZstdCompressor().compress((record(2) + "\n").encode()) * 2)
    put(tmp_path, "c.ndjson.gz", "", lambda _: gzip.compress((record(3) + "\n").encode())[:-4])
    assert seqs(log.read_log(spark, str(tmp_path))) == [0, 2, 2, 3]


@pytest.mark.parametrize("line", ['{"seq": 0, "payload": BROKEN}', "[1]", '{"seq": "many"}', '{"seq": 0, "t_ingest": 1', "\x00"])
def test_an_ended_broken_line_fails_with_file_and_number(spark, tmp_path, line):
    put(tmp_path, "a-20240115T10-00.ndjson", record(0) + "\n" + line + "\n" + record(1) + "\n")
    with pytest.raises(Exception, match="a-20240115T10-00.ndjson"):
        log.read_log(spark, str(tmp_path)).collect()


def test_since_opens_no_older_file(spark, tmp_path):
    for hour, t in ((9, T0 - 1), (10, T0 + 7), (11, T0 + HOUR + 9)):
        put(tmp_path, f"t-20240115T{hour:02d}-00.ndjson", record(hour, t) + "\n")
    put(tmp_path, "t-20240115T08-00.ndjson", "broken\n")
    put(tmp_path, "odd.ndjson", record(99, T0 + 1) + "\n" + record(98, T0 - 1) + "\n" + record(97, None) + "\n")
    assert seqs(log.read_log(spark, str(tmp_path), since=T0)) == [10, 11, 99]
    assert seqs(log.read_log(spark, str(tmp_path), since=T0 + HOUR + 9)) == [11]


def test_times_that_names_and_folders_tell():
    assert log.end_of("x/t-20240115T09-00.ndjson") == T0
    assert log.end_of("2024-01-15.ndjson") == log.end_of("a/2024-01-15/x.ndjson") == log.end_of("day=19737/part-0.txt") == 19738 * log.DAY
    assert log.end_of("weird.ndjson") == log.end_of("t-20241399T09.ndjson") == log.NEVER


def test_lines_longer_than_a_chunk_and_empty_folders(spark, tmp_path):
    put(tmp_path, "a.ndjson", record(0, text="é" * (2 * log.CHUNK)) + "\n" + record(1) + "\n")
    assert log.read_log(spark, str(tmp_path), "seq long, text string").selectExpr("sum(length(text)) n", "count(*) c").collect() == [(2 * log.CHUNK, 2)]
    (tmp_path / "none").mkdir()
    assert log.read_log(spark, str(tmp_path / "none")).collect() == []


def test_the_stream_takes_each_hour_once_when_it_is_over(spark, tmp_path):
    at, kept = tmp_path / "log", str(tmp_path / "kept")

    def run():
        log.stream_log(spark, str(at)).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(kept).awaitTermination()
        return seqs(spark.read.schema(log.SCHEMA).parquet(kept))

    put(at, "t-20240115T09-00.ndjson", record(0) + "\n")
    put(at, "t-20240115T10-00.ndjson", record(1) + "\n")
    assert run() == [0]
    put(at, "t-20240115T10-01.ndjson", record(2) + "\n")
    put(at, "t-20240115T11-00.ndjson", record(3) + "\n" + record(4)[:9])
    assert run() == run() == [0, 1, 2]
