"""The pipeline's stages against what their operators say."""

import zlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lorebase.llm import decontamination, near_dedup, quality_rules, secrets

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, tables = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        tables.append((name, before, docs))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = lambda rows: {r.doc_id for r in rows.select("doc_id").collect()}
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, packed) = tables
    assert ids(d1) == ids(quality_rules.judged(d0).where("kept")) and d1.count() < d0.count()
    assert ids(d2) == ids(near_dedup.near_duplicates(d1).where("kept"))
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert ids(d3) == ids(d2) - ids(decontamination.leaks(d2, bench)) and decontamination.leaks(d3, bench).count() == 0
    assert ids(d4) == ids(d3)
    masked = {r.doc_id: r for r in d4.collect()}
    for r in d3.collect():
        spans = secrets.find(r.text)[1]
        assert (masked[r.doc_id].text == r.text) is (not spans) and masked[r.doc_id].n_chars == len(masked[r.doc_id].text)
        assert not secrets.find(masked[r.doc_id].text)[1]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    places = packed.collect()
    assert {r.doc_id for r in places} == set(masked)
    for r in places:
        part = [*tokenizer.encode(masked[r.doc_id].text, add_special_tokens=False).ids, 0][r.start : r.start + r.length]
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r.ids_crc32


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_decisions_are_by_row(spark):
    """Null and repeated doc_ids: each row is kept or dropped by its own text."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(400)
    good = quality_rules.judged(docs).where("kept").select("doc_id").limit(2)
    rows = docs.join(good, "doc_id", "left_semi").collect()
    at = docs.columns.index("doc_id")
    text = docs.columns.index("text")
    make = lambda r, doc, t=None: tuple(doc if k == at else (t if t is not None and k == text else x) for k, x in enumerate(r))
    table = spark.createDataFrame([make(rows[0], None), make(rows[0], 7), make(rows[0], 7, "short"), make(rows[1], 7), make(rows[1], None, "short")], docs.schema)
    kept = corpus_pipeline.apply_quality_rules(spark, table, DIR)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, rows[0].text), (7, rows[0].text), (7, rows[1].text)])
    left = corpus_pipeline.drop_near_duplicates(spark, kept, DIR)
    assert left.count() == 3
    item = spark.read.parquet(f"{DIR}/benchmark.parquet")
    leaking = decontamination.leaks(docs, item).select("doc_id").limit(1)
    bad = docs.join(leaking, "doc_id", "left_semi").collect()
    mixed = spark.createDataFrame([make(rows[0], None), *(make(r, None) for r in bad)], docs.schema)
    clean = decontamination.leaks(mixed.select(F.lit(1).cast("long").alias("doc_id"), "text").limit(1), item).count() == 0
    assert corpus_pipeline.drop_leaks(spark, mixed, DIR).count() == (1 if clean else 0)


def test_a_caller_may_have_a_column_of_any_name(spark):
    """Columns _row and _ROW_ come out of each stage that names a column of its own as they went in."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(80).withColumn("_row", F.concat(F.lit("r"), "doc_id")).withColumn("_ROW_", F.col("doc_id"))
    for stage in (corpus_pipeline.apply_quality_rules, corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_leaks):
        made = stage(spark, docs, DIR)
        rows = made.collect()
        assert made.columns == docs.columns and rows and all(r["_row"] == f"r{r.doc_id}" and r["_ROW_"] == r.doc_id for r in rows)
        assert stage(spark, docs.limit(0), DIR).count() == 0
