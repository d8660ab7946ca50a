import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.plans import kept
from tidemark.sources import sinks


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))


def test_a_batch_is_there_whole_or_not_at_all(spark, tmp_path):
    at = str(tmp_path / "table")
    assert sinks.get(spark, at, "k long, v long").count() == 0 and sinks.digests(spark, at).count() == 0
    assert sinks.put(rows(spark, 100), at, "one", ["k"]) and sinks.batches(spark, at) == ["one"]
    assert not sinks.put(rows(spark, 50, 200), at, "one", ["k"])  # there already
    assert not sinks.put(rows(spark, 0), at, "none", ["k"])  # empty
    broken = rows(spark, 100, 500).withColumn("v", F.when(F.col("k") == 577, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        sinks.put(broken, at, "two", ["k"])
    assert os.listdir(at) == ["one"] and sinks.get(spark, at, "k long, v long").count() == 100
    assert sinks.put(rows(spark, 10, 500), at, "two", ["k"]) and sinks.put(rows(spark, 20, 500), at, "two", ["k"], replace=True)
    assert sinks.get(spark, at, "k long, v long").count() == 120


def test_a_repeated_run_writes_the_same_bytes(spark, tmp_path):
    told = []
    for k, order in enumerate(("k", "v")):
        at = str(tmp_path / f"t{k}")
        sinks.put(rows(spark, 5_000).orderBy(order).repartition(3 + k), at, "x", ["v", "k"])
        told.append(sorted(map(tuple, sinks.digests(spark, at).collect())))
    assert told[0] == told[1] and len(told[0]) >= 1


def test_a_table_larger_than_any_sample_is_written_as_the_same_files(spark, tmp_path):
    told, wide = [], rows(spark, 60_000).select("k", F.when(F.col("v") > 0, F.concat(F.lit("w"), F.col("v"))).alias("v"))
    for k, order in enumerate(("k", "v")):
        at = str(tmp_path / f"t{k}")
        sinks.put(wide.orderBy(order).repartition(3 + k), at, "x", ["v", "k"])
        told.append(sorted(map(tuple, sinks.digests(spark, at).collect())))
    assert told[0] == told[1] and len(told[0]) > 1
    got = sinks.get(spark, at, "k long, v string").select("*", F.input_file_name().alias("f"))
    files = got.groupBy("f").agg(F.min(F.struct("v", "k")).alias("a"), F.max(F.struct("v", "k")).alias("b"), F.count("*").alias("n")).orderBy("f").collect()
    last = [tuple(x or "" if i == 0 else x for i, x in enumerate(f.a)) + tuple(x or "" if i == 0 else x for i, x in enumerate(f.b)) for f in files]
    assert sum(f.n for f in files) == 60_000 and all(p[2:] < q[:2] for p, q in zip(last, last[1:], strict=False))
    assert max(f.n for f in files) < 2 * 60_000 / 4  # no range holds most of it


def test_no_byte_of_a_file_is_the_choice_of_a_jvm(spark, tmp_path):
    kinds = rows(spark, 20_000).select("k", "v", F.concat(F.lit("w"), F.col("v")).alias("s"), (F.col("k") / 7).alias("x"), (F.col("v") > 3).alias("b"), F.when(F.col("v") > 1, (F.col("k") / 4).cast("decimal(22,3)")).alias("d"), F.timestamp_millis("k").alias("t"), F.array("v").alias("a"))
    at = str(tmp_path / "t")
    sinks.put(kinds, at, "x", ["v", "k"])
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{at}/x/*.parquet")]
    chunks = [m.row_group(g).column(c) for m in files for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert len(files) > 1 and len(chunks) >= 8 * len(files)
    assert {c.path_in_schema for c in chunks if len(c.encodings) != 1} == set()  # a footer lists several in the order of identity hashes
    back = sinks.get(spark, at, kinds.schema)
    assert back.exceptAll(kinds).isEmpty() and kinds.exceptAll(back).isEmpty()


def test_rows_that_tie_in_the_key_are_written_in_one_order(spark, tmp_path):
    told, tied = [], rows(spark, 6_000).select("v", (F.col("k") % 40).alias("n"), F.col("k").alias("rest"))
    for k, order in enumerate(("rest", "v")):
        at = str(tmp_path / f"t{k}")
        sinks.put(tied.orderBy(F.desc(order)).repartition(3 + k), at, "x", ["n", "v"])
        told.append(sorted(map(tuple, sinks.digests(spark, at).collect())))
    assert told[0] == told[1] and len(told[0]) > 1


def test_the_narrow_map_outlives_a_wide_one_that_fails(spark, tmp_path):
    at = str(tmp_path)
    narrow = spark.createDataFrame([("a", 1, 2.0)], "coin string, day int, up double")
    wide = spark.createDataFrame([("a", "within1", 2.0)], "coin string, band string, mass double")
    with pytest.raises(Exception, match="too wide"):
        kept.append_maps(narrow, wide.withColumn("mass", F.raise_error(F.lit("too wide")).cast("double")), at, "w")
    assert sinks.batches(spark, f"{at}/v1") == ["w"] and sinks.batches(spark, f"{at}/v2") == []
    assert kept.append_maps(narrow, wide, at, "w") == {"v1": False, "v2": True}


def test_actions_of_an_unknown_level_are_refused(spark, tmp_path):
    good = spark.createDataFrame([(1, 5, "L0", "x"), (2, 6, "L3", "y")], "seq long, t_ingest long, level string, kind string")
    for level in ("L4", "l0", None):
        with pytest.raises(ValueError, match="level"):
            kept.append_actions(good.withColumn("level", F.when(F.col("seq") == 2, F.lit(level)).otherwise(F.col("level"))), str(tmp_path / "a"), "b")
    assert sinks.batches(spark, str(tmp_path / "a")) == []
    assert kept.append_actions(good, str(tmp_path / "a"), "b") and not kept.append_actions(good, str(tmp_path / "a"), "b")
