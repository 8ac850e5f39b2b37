import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from ledgerfold.llm import bpe, jaccard, mixing, pii, quality

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = (before, docs)
        assert i == 4 or docs.columns == before.columns
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.classify(before, labels).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    assert after.join(labels, "doc_id").where("quality = 1").count() >= 0.98 * labels.where("quality = 1").count()
    before, after = seen["near duplicates"]
    rest = [(r.doc_id, jaccard.shingles(r.text)) for r in after.collect()]
    assert not [(a, b) for i, (a, x) in enumerate(rest) for b, y in rest[:i] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    before, after = seen["personal data"]
    assert before.count() == after.count() and after.where(F.size(pii.pii_spans(F.col("text"))) > 0).count() <= before.where(F.size(pii.pii_spans(F.col("text"))) > 0).count() // 10
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0
    before, after = seen["mix"]
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    target = {r.source: r.target for r in mixing.target_table(before.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"))).collect()}
    assert all(abs(n - target[s]) <= 1 for s, n in words(after).items())
    before, after = seen["encode"]
    assert after.count() == before.count()
    back = bpe.decode_documents(after, corpus_pipeline._tokenizer())
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in before.collect())


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    order = sorted(got.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    at = [want.columns.index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
