"""The pipeline against a plain version of each stage, and with odd rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lexspark.llm import langid, simhash, toxicity
from lexspark.llm.work import table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with nulls, repeats and an extra column beside the given rows."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(100_001, None, None, None, None), (100_002, "", "en", "src1", 0), (100_003, "call +1 (988) 555-2485 of the and that is in", "en", "src1", 40), (100_003, "call +1 (988) 555-2485 of the and that is in", "en", "src1", 40)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("__extra", F.lit("x"))
    both.write.parquet(f"{out}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        kept[name] = (before, docs)
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    before, after = kept["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{folder}/labels.parquet"))
    assert ids(after) == sorted(str(r.doc_id) for r in before.collect() if toxicity.probability(toxicity.features(r.text, model), model) < 0.5)
    before, after = kept["language"]
    model = langid.train(before)
    rows = before.collect()
    assert ids(after) == sorted(str(r.doc_id) for r, (_, _, rejected) in zip(rows, model.predict([r.text for r in rows])) if not rejected)
    assert "100001" not in ids(after) and "100003" in ids(after)
    before, after = kept["near_copies"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    sets = [set(simhash.run_hashes(simhash.words_of(t), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert ids(after) == sorted({str(rows[r][0]) for r in root})
    before, after = kept["pseudonyms"]
    assert before.count() == after.count()
    assert "555-2485" not in after.where("doc_id = 100003").first().text
    assert after.where(F.col("n_chars") != F.length("text")).where("doc_id < 100000").count() == 0
    before, after = kept["packing"]
    assert after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0
    assert after.select("doc_id").distinct().count() == before.count()


def test_run(spark, folder):
    first = sorted(map(str, P.run(spark, folder).collect()))
    assert first and first == sorted(map(str, P.run(spark, folder).collect()))


def test_columns_that_clash_with_helpers_stay(spark, sf):
    docs = table(spark, sf, "documents")
    names = ["__score", "__found", "__id", "__same", "__rows", "__FOUND_", "_lead", "__kinds_of_text"]
    more = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, more, sf)
        assert out.columns == more.columns and out.schema == more.schema
        wrong = F.lit(False)
        for n in names:
            wrong = wrong | (F.col(n) != F.concat(F.lit(n), F.col("doc_id").cast("string")))
        assert out.where(wrong).isEmpty() and not out.isEmpty()


def test_language_sums_don_t_grow_with_partitions(spark, sf):
    docs = table(spark, sf, "documents").where("lang IS NOT NULL")
    one, many = (langid.frequency_rows(docs.repartition(n)) for n in (1, 50))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and many.count() <= 1 + langid.WIDTH
