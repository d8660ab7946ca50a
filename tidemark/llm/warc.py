"""WARC archives: written with revisit records, read back by boundary-chain verification.

Writing. Every row is a record; of rows with equal payloads of at least
``least`` bytes that with the largest id is a response, the others are revisits
that refer to it. Records are whole WARC/1.1 records, written by Spark's text
writer (a record a row, the record's closing blank lines as line separator), so
the archives are plain files in any store that Spark reaches.

Reading. The archives are read as splits at the magic ``WARC/1.1 CR LF``, by as
many tasks as the store gives splits, wherever the magic stands. Every piece
with a record's header is a candidate; its task emits its byte offset in the
split and its successor's, from the header's lengths. Candidates that follow
each other without a gap are one run, so what is left to resolve is a few runs
for each split. Offsets in the file come from the lengths of the splits before,
a run's exit is looked up among the candidates, and pointer jumping over the
runs from the file's start, with doubled jumps, keeps those that a chain of
successors reaches, from where it enters them; a magic inside a payload starts
no such record. A chain that does not end at its file's end raises. Payloads
that hold a magic are joined again from their pieces by byte offset in a second
read with the same splits (their size is fixed by `same_splits`, so an executor
that comes or goes between the reads changes nothing); a piece that is missing
there raises. Every payload is held against its record's digest.

Skew: equal payloads meet in a max() with a partial aggregate; only ids and
digests are shuffled, and payloads pass from scan to file unless more than
BROADCAST_ROWS digests repeat: then they are shuffled by digest. A revisit keeps
its payload's length in its HTTP header, so that no join is needed on reading.

Null payloads are empty, null URLs are ``urn:none``, null ids are written as such
and come back null. Repeated rows of the largest id are all responses. Empty
tables write an archive without records. A very long text is one record, held
whole by one task. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, cut, shared_dir, small

MAGIC = "WARC/1.1\r\n"
_CLOSE = "\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed value: the date of all records, so that equal inputs give equal archives.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(content: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four characters."""
    digest = F.sha1(content)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def _record_id(page: Column) -> Column:
    """A stable URN of the record of an id."""
    h = F.md5(F.concat(F.lit("tidemark:"), F.coalesce(page.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Write a record a row to archives under ``path``."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("urn:none")).alias("url"), body.alias("body"))
    rows = rows.withColumns({"bytes": F.octet_length("body").cast("long"), "digest": base32_sha1(F.col("body").cast("binary"))})
    firsts = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    known = rows.join(small(cut(firsts), BROADCAST_ROWS), F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_CLOSE))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", _record_id(F.col("page"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        F.when(F.col("page").isNotNull(), line("X-Page-ID", F.col("page").cast("string"))).otherwise(""),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _record_id(F.col("first"))), line("X-Refers-To-Page-ID", F.col("first").cast("string")),
        )).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block,
    )
    known.select(record.alias("value")).write.option("lineSep", _CLOSE).text(path)


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Inside, files are cut by their bytes and the settings alone, not by how many executors happen to be there."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(file, split, piece)``: what lies between the magics, each task's in the order of the file."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Each batch of pieces with the offset, in its split, of the byte behind the magic in front of each."""
    last, at = None, 0
    for batch in batches:
        places = []
        for file, split, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (file, split) != last:
                last, at = (file, split), 0
            places.append(at)
            at += len(piece.as_buffer()) + len(MAGIC)
        yield batch, places


_FIELD = re.compile(rb"(?:^|\r\n)(WARC-Type|X-Page-ID|X-Refers-To-Page-ID|WARC-Payload-Digest|Content-Length): ([^\r\n]+)")
_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,18})\r\n")
_SLIM = "file string, split long, at long, size long, next long, run long, whole boolean, head long, type string, page long, refers long, digest string, bytes long, computed string"


def candidates(found: DataFrame) -> DataFrame:
    """A row for each piece, with offsets counted in its split; without ``run`` it has no header of a record.

    ``at`` is where the magic in front of the piece begins, ``next`` where the
    record's successor would, ``run`` the ``at`` of the first of the candidates that
    follow each other up to this one. ``whole`` records end with their piece and
    have the length and the digest of their payload.
    """
    close = _CLOSE.encode()
    kinds = [pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def number(text: bytes | None) -> int | None:
        return int(text) if text and len(text) <= 18 and text.removeprefix(b"-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split_of, head_of, follows = None, 0, False
        for batch, places in _located(batches):
            out = []
            for file, split, start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), places, batch.column(2), strict=True):
                raw, at = piece.as_py(), start - len(MAGIC)
                if (file, split) != split_of:
                    split_of, follows = (file, split), False
                head = raw.find(close)
                fields = dict(_FIELD.findall(raw[:head])) if head >= 0 else {}
                length, kind = number(fields.get(b"Content-Length")), fields.get(b"WARC-Type")
                if length is None or length < 0 or kind is None:
                    out.append((file, split, at, len(raw), *[None] * 10))
                    follows = False
                    continue
                whole = head + 4 + length + 4 == len(raw)
                if not follows:
                    head_of = at
                follows = whole
                size = computed = None
                if whole:
                    inner = raw.find(close, head + 4)
                    payload = raw[inner + 4 : head + 4 + length]
                    told = _LENGTH.search(raw, head + 4, inner + 2)
                    size = int(told[1]) if kind == b"revisit" and told else len(payload)
                    computed = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                digest = fields.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha1:").decode("ascii", "replace") or None
                out.append((file, split, at, len(raw), at + len(MAGIC) + head + 4 + length + 4, head_of, whole, head, kind.decode("ascii", "replace"), number(fields.get(b"X-Page-ID")), number(fields.get(b"X-Refers-To-Page-ID")), digest, size, computed))
            cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _SLIM.split(", ")])

    return found.mapInArrow(run, _SLIM)


def located(found: DataFrame) -> DataFrame:
    """``(file, split, at, piece)`` with ``at`` as in `candidates`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, places in _located(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p - len(MAGIC) for p in places], pa.int64()), batch.column(2)], ["file", "split", "at", "piece"])

    return found.mapInArrow(run, "file string, split long, at long, piece binary")


def _placed(slim: DataFrame, starts: DataFrame) -> DataFrame:
    """Candidates with offsets counted in their file; those in the split stay as ``local``."""
    moved = slim.join(starts, ["file", "split"]).withColumn("local", F.col("at"))
    return moved.withColumns({c: F.col(c) + F.col("start") for c in ("at", "next", "run")}).drop("start")


def reachable(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(file, node, entry)``: the nodes that chains from node 0 of their file reach, and where they enter them.

    ``links (file, node, to, to_entry)`` has a row for each node; ``to`` is null at
    the end of a chain. Each round every node passes its ``entry`` on to where its
    jump leads and doubles the jump.
    """
    state = cut(links.withColumn("entry", F.when(F.col("node") == 0, F.lit(0).cast("long"))))
    count = -1
    for _ in range(max_rounds):
        now = state.where("entry is not null").count()
        if now == count:
            return state.where("entry is not null").select("file", "node", "entry")
        count = now
        ahead = small(state.select("file", F.col("node").alias("to"), F.col("to").alias("far"), F.col("to_entry").alias("far_entry")), BROADCAST_ROWS)
        moved = state.join(ahead, ["file", "to"], "left").select("file", "node", F.col("far").alias("to"), F.col("far_entry").alias("to_entry"), "entry")
        none = F.lit(None).cast("long")
        told = state.where("entry is not null and to is not null").select("file", F.col("to").alias("node"), none.alias("to"), none.alias("to_entry"), F.col("to_entry").alias("entry"))
        state = cut(moved.unionByName(told).groupBy("file", "node").agg(F.max("to").alias("to"), F.max("to_entry").alias("to_entry"), F.max("entry").alias("entry")))
    raise RuntimeError(f"a file has more than 2^{max_rounds} runs of records")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, type, page, refers, digest, bytes, computed)`` of every record in the archives under ``path``.

    ``bytes`` is the length of the payload, for revisits as told by their HTTP
    header; ``computed`` is the digest of what the record itself holds.
    """
    with same_splits(spark):
        slim = cut(candidates(pieces(spark, path)))
    magic = len(MAGIC)
    totals = slim.groupBy("file", "split").agg(F.max(F.col("at") + F.col("size") + 2 * magic).alias("n"))
    over = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut(totals.select("file", "split", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("start"), "n"))
    known = _placed(slim, small(totals.drop("n"), BROADCAST_ROWS))
    runs = cut(known.where("run is not null").groupBy("file", F.col("run").alias("node")).agg(F.max("next").alias("exit")))
    exits = small(cut(runs.select("file", F.col("exit").alias("at")).distinct()), BROADCAST_ROWS)
    entered = small(cut(known.where("run is not null").join(exits, ["file", "at"]).select("file", F.col("at").alias("exit"), F.col("run").alias("to"))), BROADCAST_ROWS)
    links = cut(runs.join(entered, ["file", "exit"], "left").select("file", "node", "exit", "to", F.when(F.col("to").isNotNull(), F.col("exit")).alias("to_entry")))
    reached = cut(reachable(links.drop("exit")))
    ends = totals.groupBy("file").agg((F.max(F.col("start") + F.col("n")) - magic).alias("end"))
    stops = links.where("to is null").join(small(reached, BROADCAST_ROWS), ["file", "node"]).groupBy("file").agg(F.max("exit").alias("exit"))
    astray = ends.where(F.col("end") > 0).join(stops, "file", "left").where(~F.col("exit").eqNullSafe(F.col("end")))
    lost = astray.select("file", "exit", "end").first()
    if lost is not None:
        raise ValueError(f"the chain of records of {lost.file} stops at {lost.exit} of {lost.end} bytes")
    entries = small(reached.withColumnRenamed("node", "run"), BROADCAST_ROWS)
    flagged = known.join(entries, ["file", "run"], "left").withColumn("reached", F.coalesce(F.col("at") >= F.col("entry"), F.lit(False)))
    records = cut(flagged.where("reached"))
    sure = records.where("whole").select("file", "at", "type", "page", "refers", "digest", "bytes", "computed")
    broken = records.where("not whole")
    if broken.isEmpty():
        return sure
    return sure.unionByName(_joined(spark, path, broken, flagged.where("not reached")))


def _joined(spark: SparkSession, path: str, broken: DataFrame, loose: DataFrame) -> DataFrame:
    """Records whose payload holds a magic: their pieces, read again, in order of their offsets."""
    spans = broken.select("file", "at", "next", "head", "type", "page", "refers", "digest")
    # Of a file's records with loose pieces behind them, the last before a piece owns it.
    owner = Window.partitionBy("file").orderBy("at", "loose").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tagged = broken.select("file", "split", "local", "at", "next", F.lit(0).alias("loose")).unionByName(loose.select("file", "split", "local", "at", F.lit(None).cast("long").alias("next"), F.lit(1).alias("loose")))
    own = F.last(F.when(F.col("loose") == 0, F.struct("at", "next")), ignorenulls=True).over(owner)
    wanted = cut(tagged.withColumn("own", own).where("own.at <= at and at < own.next").select("file", "split", F.col("local").alias("piece_local"), F.col("at").alias("piece_at"), F.col("own.at").alias("at")))
    wanted = small(wanted, BROADCAST_ROWS)
    with same_splits(spark):
        again = located(pieces(spark, path)).withColumnRenamed("at", "piece_local")
        texts = again.join(wanted, ["file", "split", "piece_local"]).groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("piece_at", "piece"))).alias("parts"))
        texts = cut(texts)
    content = F.aggregate("parts", F.lit(None).cast("binary"), lambda acc, x: F.when(acc.isNull(), x["piece"]).otherwise(F.concat(acc, F.lit(MAGIC.encode()), x["piece"])))
    whole = spans.join(texts.select("file", "at", content.alias("content")), ["file", "at"], "left")
    length = F.col("next") - F.col("at") - len(MAGIC)
    lost = F.raise_error(F.concat(F.lit("pieces are missing of the record at "), F.col("file"), F.lit(":"), F.col("at").cast("string"))).cast("binary")
    whole = whole.withColumn("content", F.when(F.coalesce(F.octet_length("content"), F.lit(-1)) == length, F.col("content")).otherwise(lost))
    block = F.col("content").substr(F.col("head").cast("int") + 5, (length - F.col("head") - 8).cast("int"))
    inner = F.octet_length(F.substring_index(block.cast("string"), _CLOSE, 1)) + 4
    payload = block.substr(inner + 1, F.lit(1 << 30))
    return whole.select("file", "at", "type", "page", "refers", "digest", F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("computed"))


def round_trip(pages: DataFrame, path: str | None = None, least: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` to archives, read them back, and give a row a record.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``. Raises
    while reading if a response's payload does not have its record's digest.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least=least, **columns)
    wrong = (F.col("type") == "response") & (F.col("digest") != F.col("computed"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("wrong payload digest at "), F.col("file"), F.lit(":"), F.col("at").cast("string"))).cast("string")).otherwise(F.col("digest"))
    return read(spark, path).select(F.col("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), checked.alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))
