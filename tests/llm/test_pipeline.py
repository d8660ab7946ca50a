"""The pipeline's stages against slow versions, on odd rows, and the whole run against its stages."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline as op
from test_mixture import slow_targets
from test_simhash import slow_components, slow_fingerprint

from tidemark.llm import decontaminate, simhash_dedup, toxicity

ITEM = "than and onesen erblest it hein ti inenan eranenes whan ou therouou thon the heoron eratsh"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `__keep` int, row string"


def corpus():
    rnd = random.Random(11)
    vocab = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(360):
        words = rnd.choices(vocab, k=rnd.randint(20, 60))
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zidiot", "zmoron", "schelmzen"]))
        rows.append((i, " ".join(words), "hot" if i % 3 else rnd.choice(["a", "B", None])))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000 + i, rows[i][1], "hot") for i in range(1, 40, 2)]  # copies with larger ids
    rows += [(2000, "so " + ITEM + " it goes", "a"), (2001, ITEM.upper(), None), (None, ITEM, "a"), (None, "no id, clean", "a"), (None, rows[4][1], "a")]
    rows += [(3000, None, "a"), (3001, "", None), (rows[5][0], rows[5][1], "hot"), (3002, "word " * 60_000, "B")]
    return [(i, t, "en", s, len(t or ""), 7, "r") for i, t, s in rows], labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def key(rows):
    return sorted(map(str, rows))


def test_toxicity_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = op.drop_toxic(spark, docs, tables)
    assert kept.schema == docs.schema
    toxic = lambda t: any(w in (t or "") for w in ("zidiot", "zmoron", "schelmzen"))
    assert key(kept.collect()) == key(r for r in docs.collect() if not toxic(r.text))


def test_near_duplicate_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = docs.collect()
    kept = op.drop_near_duplicates(spark, docs, tables)
    assert kept.columns == docs.columns
    label = slow_components([(r.doc_id, slow_fingerprint(r.text) if len(r.text or "") < 9999 else 0x5555555555555555) for r in rows])
    expected = {r for r in rows if r.doc_id is not None and label[r.doc_id] == r.doc_id}  # repeated rows once
    assert key(kept.where("doc_id is not null").collect()) == key(expected)
    assert key(kept.where("doc_id is null").collect()) == key(r for r in rows if r.doc_id is None)


def test_decontamination_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = op.drop_contaminated(spark, docs, tables)
    assert kept.schema == docs.schema
    assert key(kept.collect()) == key(r for r in docs.collect() if ITEM not in (r.text or "").lower())


def test_mixing_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows, got = docs.collect(), op.mix_sources(spark, docs, tables).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows)
    sums = {}
    for r in rows:
        sums[r.source] = sums.get(r.source, 0) + len((r.text or "").split())
    expected = slow_targets(sums)
    assert all(r.target == pytest.approx(expected[r.source]) and r.taken <= 3 * r["size"] for r in got)


def test_whole_run_is_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in op.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), stage(spark, docs, tables).schema)
    assert key(op.run(spark, tables).collect()) == key(docs.collect())


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert op.run(spark, d).count() == 0


def test_batches_of_long_texts_are_bounded_in_every_stage(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")  # 30 MB in one task
    none = spark.createDataFrame([], "item_id long, text string")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    for stage in (lambda: toxicity.features(docs, [{}]), lambda: simhash_dedup.fingerprints(docs), lambda: decontaminate.decontaminate(docs, none)):
        spark.conf.unset(key)
        stage()
        assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 6_000_000
    spark.conf.set(key, "1234567")
    try:
        toxicity.features(docs, [{}])
        assert spark.conf.get(key) == "1234567"  # a session's own bound stays
    finally:
        spark.conf.unset(key)
