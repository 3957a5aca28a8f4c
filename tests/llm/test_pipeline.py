"""The pipeline's stages against brute force, and the registered queries' columns."""

import corpus_pipeline
import pytest

import __spark_entry__
from statloom.llm import mixing, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / name))
        steps[name] = now, spark.read.parquet(str(tmp_path / name))
        now = steps[name][1]
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.columns == docs.columns, name
    before, after = steps["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = toxicity.train(*toxicity.training_sample(before, labels))
    bad = {r.doc_id for r in toxicity.score(before, net).collect() if r.predicted}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = steps["simhash_near_dedup"]
    found = simhash.near_duplicates(before).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in found})
    before, after = steps["mixing"]
    taken = {r.doc_id: r.copies for r in mixing.mix(mixing.sizes(before)).collect()}
    have = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert have == {i: n for i, n in taken.items() if n}
    before, after = steps["bpe"]
    assert after.count() == before.count() > 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in after.collect())


def test_stages_pass_empty_and_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (90001, "", "en", None, 0), (90001, "", "en", None, 0)], docs.schema))
    for k, now in enumerate((docs.limit(0), odd)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            out.write.parquet(str(tmp_path / f"{k}{name}"))
            now = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert k or now.count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name, columns", [
    ("op3_urlfilter", ["page_id", "host", "path", "rule", "verdict"]),
    ("op6_mixing", ["doc_id", "size", "source_size", "target", "taken"]),
    ("op10_vecdedup", ["vec_id", "n_links", "component_id", "kept"])])
def test_contract_columns(spark, name, columns):
    df = __spark_entry__.queries()[name](spark, SF)
    assert df.columns[:len(columns)] == columns and df.count() > 0
