"""What the training-data operators share: checkpoints, tokens, stable hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every operator here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none (local runs, tests), a temporary folder is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage; the files lie in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like `cut`, for long tables of plain columns that are read again and again: Parquet in the shared folder, which is read by column."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch on its way to Python, where the session sets no bound of its own (Spark's is 64 MB).
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are of BATCH_BYTES at most: a task holds several copies of one, and worker and JVM keep that room."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def words(raw: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text with A-Z lower-cased.

    ``bytes.split`` cuts at exactly the six bytes that WORD leaves out and
    ``bytes.lower`` changes exactly A-Z.
    """
    return (raw or b"").lower().split()


def raw_texts(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes | None]:
    """A string column's values as bytes, one at a time."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


def id_bucket(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod ``n``; a null id counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def unit_hash(*cols: str | Column, seed: int) -> Column:
    """A stable uniform number in (0, 1) from the columns and a seed, never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *cols), 12).cast("double")
    return (bits + 0.5) / float(1 << 52)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


#: Up to this many rows (ids, digests, paths: some hundred bytes each) a join's side is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast join if it has at most ``rows`` rows (counted), else as it is for a shuffle join."""
    return F.broadcast(df) if fits(df, rows) else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def compiled_words() -> re.Pattern:
    return re.compile(WORD)
