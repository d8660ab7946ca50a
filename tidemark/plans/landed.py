"""Queries over landed files and ledgers: scans with pruning, closing of days, audits against the manifest, hash chains.

The tape lands as one file for each (coin, day, part), where a part is a range
of `PART_ROWS` sequence numbers: a file, and so the task that writes, hashes or
reads it, is bounded whatever share of the rows a coin or a day holds.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import whole
from tidemark.operators.ordered import DAY
from tidemark.plans import integrity
from tidemark.session import shared_folder
from tidemark.sources import views as V

PART_ROWS = 100_000
KEY = ["coin", "day", "part"]
LINE = "seq long, coin string, t_event long, t_ingest long, k int"
MANIFEST = "coin string, day int, part int, lines long, bytes long, sha256 string, closed_at int"
#: The days (since 1970) on which days are closed here; one of them comes twice.
TODAYS = (19730, 19745, 19745, 19800)
GENESIS = "0" * 64
DAILY = "daily_ AS (SELECT gate, CAST(t_event // 86400000000000 AS INT) AS day, gate || '|' || CAST(t_event // 86400000000000 AS VARCHAR) || '|' || count(*) || '|' || count(*) FILTER (verdict = 'pass') AS body FROM verdicts GROUP BY gate, t_event // 86400000000000)"
MORE = integrity.MORE | {
    "lines_": (["tape"], f"""lines_ AS (SELECT coin, CAST(t_ingest // 86400000000000 AS INT) AS day, CAST(seq // {PART_ROWS} AS INT) AS part, seq, k, t_event, t_ingest FROM tape)"""),
    "daily_": (["verdicts"], DAILY),
}


def sql(*names: str) -> str:
    return V.with_views(*names, more=MORE)


def lines_of(tape: DataFrame) -> DataFrame:
    """A line of JSON for each row, with the file it belongs to."""
    line = F.to_json(F.struct("seq", "coin", "t_event", "t_ingest", "k"))
    return tape.select("coin", whole(F.col("t_ingest"), DAY).cast("int").alias("day"), F.floor(F.col("seq") / PART_ROWS).cast("int").alias("part"), "seq", line.alias("value"))


def land(lines: DataFrame, at: str) -> None:
    """Write one file for each key, its lines in the order of ``seq``."""
    dealt = lines.repartition(*KEY).sortWithinPartitions(*KEY, "seq")
    dealt.select("value", *KEY).write.mode("append").partitionBy(*KEY).text(at)


def files_of(spark: SparkSession, at: str) -> DataFrame:
    """``(coin, day, part, lines, bytes, sha256)`` of the files as their readers see them; hashing is distributed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(at)
    breaks = F.col("length") - F.octet_length(F.translate(F.decode("content", "UTF-8"), "\n", ""))
    return files.select(F.col("coin").cast("string").alias("coin"), F.col("day").cast("int").alias("day"), F.col("part").cast("int").alias("part"), breaks.cast("long").alias("lines"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def names_of(spark: SparkSession, at: str) -> DataFrame:
    """``(coin, day, part, bytes)`` of the files, from their listing alone: no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(at)
    return files.select(F.col("coin").cast("string").alias("coin"), F.col("day").cast("int").alias("day"), F.col("part").cast("int").alias("part"), F.col("length").alias("bytes"))


def fresh_files(spark: SparkSession, at: str, known: DataFrame, today: int) -> DataFrame:
    """`files_of` those of days before ``today`` that ``known`` lacks: folders of other days are not opened.

    The listing says which days have such files. They are few, those since the last
    closing and days with a late file, and become a filter on folders.
    """
    listed = names_of(spark, at).where(F.col("day") < today).join(known.select(*KEY), KEY, "left_anti")
    days = sorted(r.day for r in listed.select("day").distinct().collect())
    return files_of(spark, at).where(F.col("day").isin(days)).join(known.select(*KEY), KEY, "left_anti")


def close_finished(spark: SparkSession, at: str, manifest: str, today: int) -> None:
    """Append to the manifest every file of a day before ``today`` that it does not have; a second call adds nothing."""
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(manifest)
    known = spark.read.schema(MANIFEST).parquet(manifest)
    fresh = fresh_files(spark, at, known, today)
    fresh.withColumn("closed_at", F.lit(today)).write.mode("append").parquet(manifest)


def audit(manifest: DataFrame, files: DataFrame, today: int) -> DataFrame:
    """Each file's state: ok, modified, missing, open (not in the manifest, of today) or stale (not in it, but of a day gone by)."""
    m = manifest.select(*KEY, F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha256"))
    j = m.join(files.select(*KEY, "bytes", "sha256"), KEY, "full")
    same = (F.col("bytes") == F.col("m_bytes")) & (F.col("sha256") == F.col("m_sha256"))
    state = F.when(F.col("m_sha256").isNull(), F.when(F.col("day") < today, "stale").otherwise("open")).when(F.col("sha256").isNull(), "missing").when(same, "ok").otherwise("modified")
    return j.select(*KEY, state.alias("state"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"


def scan_landed(spark: SparkSession, d: str, since: int = 19740) -> DataFrame:
    """The landed tape from a day on: the day is a folder, so older files are not listed in the plan; a broken line fails the scan."""
    at = _folder(spark)
    land(lines_of(V.tape(spark, d)), at)
    rows = spark.read.schema(f"{LINE}, day int, part int").option("mode", "FAILFAST").json(at)
    return rows.where(F.col("day") >= since).select("seq", "coin", "t_event", "t_ingest", "k")


def close_days(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of landed days after closing them on each of `TODAYS`."""
    at = _folder(spark)
    land(lines_of(V.tape(spark, d)), f"{at}/tape")
    for today in TODAYS:
        close_finished(spark, f"{at}/tape", f"{at}/manifest", today)
    return spark.read.schema(MANIFEST).parquet(f"{at}/manifest")


def damaged(tape: DataFrame) -> DataFrame:
    """The tape's lines with files lost (day % 9 = 0), changed (day % 9 = 4) and left over (day % 9 = 7, a thousand days before and after)."""
    day = whole(F.col("t_ingest"), DAY)
    changed = lines_of(tape.where(day % 9 != 0).withColumn("k", F.when((day % 9 == 4) & (F.col("seq") % 5 == 0), F.col("k") + 1).otherwise(F.col("k"))))
    over = lines_of(tape.where(day % 9 == 7))
    return changed.unionByName(over.withColumn("day", F.col("day") - 1000)).unionByName(over.withColumn("day", F.col("day") + 1000))


def file_audit(spark: SparkSession, d: str) -> DataFrame:
    """Landed files, some of them damaged after closing, against their manifest."""
    at = _folder(spark)
    with V.one_tape(spark, d):
        land(lines_of(V.tape(spark, d)), f"{at}/closed")
        land(damaged(V.tape(spark, d)), f"{at}/found")
    return audit(files_of(spark, f"{at}/closed"), files_of(spark, f"{at}/found"), TODAYS[-1])


def append_chain(heads: DataFrame | None, batch: DataFrame) -> DataFrame:
    """``(chain, seq, prev_hash, body, hash)`` of a batch ``(chain, at, body)`` that goes on from ``heads (chain, seq, hash)``.

    Each hash is the SHA-256 of the entry's number, its predecessor's hash and its
    body, so a chain is sequential: a task walks its new entries in the order of
    (at, body) and carries no more than the last hash. Chains without heads begin at
    0 with 64 zeros; a null body counts as if it were not there.
    """
    kinds, names = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()], ["chain", "seq", "prev_hash", "body", "hash"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, seq, last = None, 0, GENESIS
        for part in batches:
            out = []
            for one, body, head_seq, head in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if one != chain:
                    chain, seq, last = one, 0 if head_seq is None else head_seq + 1, head or GENESIS
                digest = hashlib.sha256("|".join(x for x in (str(seq), last, body) if x is not None).encode()).hexdigest()
                out.append((one, seq, last, body, digest))
                seq, last = seq + 1, digest
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    new = batch.where("chain is not null").select("chain", "at", "body")
    if heads is None:
        new = new.withColumns({"seq": F.lit(None).cast("long"), "hash": F.lit(None).cast("string")})
    else:
        new = new.join(heads.select("chain", "seq", "hash"), "chain", "left")
    dealt = new.repartition("chain").sortWithinPartitions("chain", "at", "body")
    return dealt.select("chain", "body", F.col("seq").cast("long").alias("seq"), "hash").mapInArrow(walk, "chain string, seq long, prev_hash string, body string, hash string")


def verify_chain(entries: DataFrame) -> DataFrame:
    """``(chain, entries, first_break, reason)``: the first entry whose number, link or digest is wrong.

    An entry needs only its own fields and its predecessor's stored hash.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("chain").orderBy("seq")
    e = entries.withColumns({"was": F.coalesce(F.lag("seq").over(w), F.lit(-1)), "before": F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))})
    digest = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "prev_hash", "body"), 256)
    reason = F.when(F.col("seq") != F.col("was") + 1, "sequence").when(F.col("prev_hash") != F.col("before"), "link").when(F.col("hash") != digest, "digest")
    wrong = e.withColumn("reason", reason)
    at = F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason")))
    return wrong.groupBy("chain").agg(F.count("*").alias("entries"), at.alias("b")).select("chain", "entries", F.col("b.seq").alias("first_break"), F.col("b.reason").alias("reason"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    v = integrity.verdicts_of(spark, d).groupBy("gate", whole(F.col("t_event"), DAY).cast("int").alias("day")).agg(F.count("*").alias("runs"), F.sum((F.col("verdict") == "pass").cast("long")).alias("passes"))
    return v.select(F.col("gate").alias("chain"), F.col("day").alias("at"), F.concat_ws("|", "gate", *[F.col(c).cast("string") for c in ("day", "runs", "passes")]).alias("body"))


def ledger_of(spark: SparkSession, d: str) -> DataFrame:
    """The gates' daily entries, appended in two batches."""
    from tidemark.session import settle

    entries = settle(_daily(spark, d))
    first = settle(append_chain(None, entries.where(F.col("at") < TODAYS[1])))
    heads = first.groupBy("chain").agg(F.max_by(F.struct("seq", "hash"), "seq").alias("h")).select("chain", "h.*")
    return first.unionByName(append_chain(heads, entries.where(F.col("at") >= TODAYS[1])))


def ledger_append(spark: SparkSession, d: str) -> DataFrame:
    return ledger_of(spark, d)


def ledger_verify(spark: SparkSession, d: str) -> DataFrame:
    """The first break of ledgers of which some were damaged: a body changed, an entry lost, an entry forged with a fitting digest."""
    e = ledger_of(spark, d)
    forged = F.concat("body", F.lit("!"))
    hit = lambda chain, seq: (F.col("chain") == chain) & (F.col("seq") == seq)
    refit = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "prev_hash", forged), 256)
    bad = e.where(~hit("error", 5)).select("chain", "seq", "prev_hash", F.when(hit("click", 3) | hit("purchase", 7), forged).otherwise(F.col("body")).alias("body"), F.when(hit("purchase", 7), refit).otherwise(F.col("hash")).alias("hash"))
    return verify_chain(bad)


QUERIES = {f.__name__: f for f in (scan_landed, close_days, file_audit, ledger_append, ledger_verify)}

_VALUE = """'{{"seq":' || seq || ',"coin":"' || coin || '","t_event":' || t_event || ',"t_ingest":' || t_ingest || ',"k":' || {k} || '}}'"""
_FILES = "SELECT coin, day, part, count(*) AS lines, CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes, sha256(string_agg(value, chr(10) ORDER BY seq) || chr(10)) AS sha256 FROM ({rows}) GROUP BY 1, 2, 3"
_CLOSED = _FILES.format(rows=f"SELECT *, {_VALUE.format(k='k')} AS value FROM lines_")
_OVER = [f"SELECT coin, day {by} AS day, part, seq, {_VALUE.format(k='k')} AS value FROM lines_ WHERE day % 9 = 7" for by in ("- 1000", "+ 1000")]
_FOUND = _FILES.format(rows=f"SELECT coin, day, part, seq, {_VALUE.format(k='CASE WHEN day % 9 = 4 AND seq % 5 = 0 THEN k + 1 ELSE k END')} AS value FROM lines_ WHERE day % 9 <> 0 UNION ALL {_OVER[0]} UNION ALL {_OVER[1]}")
_CHAIN = sql("daily_").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", numbered AS (SELECT gate AS chain, row_number() OVER (PARTITION BY gate ORDER BY day) - 1 AS seq, body FROM daily_),
    ledger AS (SELECT chain, seq, '{GENESIS}' AS prev_hash, body, sha256('0|{GENESIS}|' || body) AS hash FROM numbered WHERE seq = 0
        UNION ALL SELECT n.chain, n.seq, l.hash, n.body, sha256(n.seq || '|' || l.hash || '|' || n.body) FROM ledger l JOIN numbered n ON n.chain = l.chain AND n.seq = l.seq + 1)
"""
SQL = {
    "scan_landed": sql("tape") + f"SELECT seq, coin, t_event, t_ingest, k FROM tape WHERE t_ingest // {DAY} >= 19740",
    "close_days": sql("lines_") + f"SELECT *, CAST(CASE WHEN day < {TODAYS[0]} THEN {TODAYS[0]} WHEN day < {TODAYS[1]} THEN {TODAYS[1]} ELSE {TODAYS[-1]} END AS INT) AS closed_at FROM ({_CLOSED}) WHERE day < {TODAYS[-1]}",
    "file_audit": sql("lines_") + f"SELECT coin, day, part, CASE WHEN m.sha256 IS NULL THEN CASE WHEN day < {TODAYS[-1]} THEN 'stale' ELSE 'open' END WHEN f.sha256 IS NULL THEN 'missing' WHEN m.sha256 = f.sha256 AND m.bytes = f.bytes THEN 'ok' ELSE 'modified' END AS state FROM ({_CLOSED}) m FULL JOIN ({_FOUND}) f USING (coin, day, part)",
    "ledger_append": _CHAIN + "SELECT chain, seq, prev_hash, body, hash FROM ledger",
    "ledger_verify": _CHAIN + f"""SELECT chain, count(*) AS entries, min(seq) FILTER (reason IS NOT NULL) AS first_break, arg_min(reason, seq) FILTER (reason IS NOT NULL) AS reason FROM (SELECT *, CASE WHEN seq <> coalesce(lag(seq) OVER w, -1) + 1 THEN 'sequence' WHEN prev_hash <> coalesce(lag(hash) OVER w, '{GENESIS}') THEN 'link' WHEN hash <> sha256(seq || '|' || prev_hash || '|' || body) THEN 'digest' END AS reason
        FROM (SELECT chain, seq, prev_hash, CASE WHEN (chain = 'click' AND seq = 3) OR (chain = 'purchase' AND seq = 7) THEN body || '!' ELSE body END AS body, CASE WHEN chain = 'purchase' AND seq = 7 THEN sha256(seq || '|' || prev_hash || '|' || body || '!') ELSE hash END AS hash FROM ledger WHERE NOT (chain = 'error' AND seq = 5)) WINDOW w AS (PARTITION BY chain ORDER BY seq)) GROUP BY 1""",
}
