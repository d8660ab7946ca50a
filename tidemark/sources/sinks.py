"""Tables kept as a folder of batches, each there whole or not at all.

A batch is sorted by range, written to a staged folder by Spark's own writer, and moved
to its name when all tasks are done: one rename. Until then no reader sees it, and a job
that fails takes its staged folder with it. A batch whose name is there already is left
as it is, so a run that is repeated adds nothing; an empty one is not written.

The sort goes over a key and, where it ties, over the other columns, and the ranges are cut
at keys that a hash of the key picks, so they depend on the rows alone: a repeated run writes
the same rows to the same files, byte for byte. (``repartitionByRange`` cuts at a sample that
is drawn anew for each job.) So that the bytes do not depend on the executor either, a column
has one encoding: a footer names several in an order that each JVM has for itself.
"""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys looked at for each range; a table with fewer rows than all ranges ask for is one file.
PER_RANGE = 50
#: Pages of the second version without a dictionary have one encoding a column.
ONE_ENCODING = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}


def _path(spark: SparkSession, at: str):
    """A path and the file system it lies in, as Spark's writers see them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def batches(spark: SparkSession, at: str) -> list[str]:
    """The names of a table's batches."""
    path, files = _path(spark, at)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def dealt(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` in ranges of ``key``, sorted within them, by the other columns where it ties; the same rows always lie in the same range and order.

    A row's range is found in two steps, among some of the cuts and then between two of them.
    """
    spark, by = df.sparkSession, [F.col(c) for c in key]
    order = [*by, *[F.col(c) for c in df.columns if c not in key]]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = df.select(*key).orderBy(F.xxhash64(*by), *by).limit(n * PER_RANGE).orderBy(*by).collect()  # a bounded sample
    if n == 1 or len(picked) < n * PER_RANGE:
        return df.repartition(1).sortWithinPartitions(*order)
    cuts = picked[PER_RANGE::PER_RANGE]
    size = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    kind = df.select(*key).schema.simpleString()
    table = spark.createDataFrame([([g[0] for g in groups], groups)], f"__tops array<{kind}>, __groups array<array<{kind}>>")
    upto = lambda among: F.size(F.filter(among, lambda cut: cut <= F.struct(*by)))
    placed = df.crossJoin(F.broadcast(table)).withColumn("__group", upto(F.col("__tops")))  # one row
    inside = upto(F.element_at("__groups", F.col("__group")))
    at = F.when(F.col("__group") == 0, 0).otherwise((F.col("__group") - 1) * size + inside)
    placed = placed.withColumn("__range", at.cast("int")).drop("__tops", "__groups", "__group")
    return placed.repartitionById(n, F.col("__range")).sortWithinPartitions(*order).drop("__range")


def put(df: DataFrame, at: str, name: str, key: list[str], replace: bool = False) -> bool:
    """Add ``df`` to the table at ``at`` as batch ``name``, sorted by ``key``; whether it was written.

    ``replace`` writes it even if the batch is there; the old one is gone once the new one is whole.
    """
    spark = df.sparkSession
    if name in batches(spark, at) and not replace:
        return False
    staged, files = _path(spark, f"{at}/_staged-{uuid.uuid4().hex}")
    final, _ = _path(spark, f"{at}/{name}")
    try:
        dealt(df, key).write.options(**ONE_ENCODING).parquet(staged.toString())
        if spark.read.schema(df.schema).parquet(staged.toString()).isEmpty():
            return False
        if replace and files.exists(final):
            files.delete(final, True)
        if not files.rename(staged, final):
            raise OSError(f"batch {name!r} of {at} was not moved to its name")
        return True
    finally:
        files.delete(staged, True)


def get(spark: SparkSession, at: str, schema) -> DataFrame:
    """All batches of a table; one that does not exist is empty."""
    names = batches(spark, at)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{at}/{n}" for n in names])


def digests(spark: SparkSession, at: str) -> DataFrame:
    """``(batch, file, sha256)`` of a table's files, numbered in the order of their rows."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{at}/{n}" for n in batches(spark, at)])
    except AnalysisException:
        return spark.createDataFrame([], "batch string, file int, sha256 string")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("batch"), F.regexp_extract(name, r"^part-(\d+)-", 1).cast("int").alias("file"), F.sha2("content", 256).alias("sha256"))
