"""The pipeline against plain versions of its stages, and every registered query on the small tables."""

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        f(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_toxic_go_and_others_stay_whole(stages, spark):
    before, after = stages[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = dict(pairs(after))
    assert kept.items() <= dict(pairs(before)).items()
    clean = [d for d, t in labels.items() if not t]
    assert sum(d in kept for d in clean) >= 0.9 * len(clean)


def test_lines(stages):
    before, after = stages[1]
    got = {r.doc_id: r.sha for r in after.select("doc_id", F.sha2("text", 256).alias("sha")).collect()}
    assert got == {d: v[2] for d, v in brute.lines(pairs(before)).items()}


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    assert {d for d, _ in pairs(after)} == {d for d, (_, root) in brute.jaccard(pairs(before), 5, 80).items() if d == root}


def test_leaks_go(stages, spark):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute.contained(pairs(before), items)}
    assert {d for d, _ in pairs(after)} == {d for d, _ in pairs(before)} - leaks


def test_mixture(stages):
    before, after = stages[4]
    triples = [(r.doc_id, r.text, r.source) for r in before.collect()]
    size, target = brute.targets(triples)
    assert after.count() == before.count()
    total = sum(r.taken for r in after.collect())
    assert abs(total - sum(size.values())) <= len(size) + 0.005 * sum(target.values())


def test_run_equals_stages(spark, stages):
    import corpus_pipeline

    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[-1][1].collect())


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert set(entry.oracle_sql()) <= names
