"""Scores of wide rows, and of sequences in which no label counts, against the queries' SQL."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewater.functions import scoring as S
from tidewater.plans import catalog


def test_length_weight_takes_time_in_proportion(spark):
    rng = random.Random(47)
    x = [[rng.gauss(0, 1) for _ in range(256)] for _ in range(2)]
    df = spark.createDataFrame([(x, [-100, 5])], "x array<array<double>>, y array<int>")
    began = time.monotonic()
    got = df.select(S.length_weight(F.col("x"), F.col("y")).alias("w")).first().w
    assert time.monotonic() - began < 30  # a sum within a sum within a lambda took the fourth power of the width
    lse = math.log(sum(math.exp(v) for v in x[0]))
    assert got == pytest.approx(x[0][5] - lse - math.log(sum(math.exp(2 * (v - lse)) for v in x[0])))


def against_sql(spark, folder, name, rows):
    """A query's rows and its SQL's on a table of embeddings (vec_id, embedding, label), in order."""
    import duckdb

    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, str(folder)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
        return got, sorted(con.execute(catalog.oracle_sql()[name]).fetchall())


def vectors(ids, labelled=lambda i: True):
    rng = random.Random(53)
    return [(i, [rng.gauss(0, 1) for _ in range(12)], i % 10 if labelled(i) else None) for i in ids]


@pytest.mark.parametrize(("n", "labelled"), [(25, lambda i: True), (64, lambda i: not 8 <= i < 16), (64, lambda i: not 32 <= i < 40)])
def test_pairs_whose_sides_have_no_label_that_counts(spark, tmp_path, n, labelled):
    """A last sequence of one vector, one without labels as the second or the first side of a pair."""
    got, sql = against_sql(spark, tmp_path, "loss_simpo_sft", vectors(range(n), labelled))
    assert got == sql and len(got) == 1


def test_a_batch_without_tokens_has_no_loss(spark, tmp_path):
    got, sql = against_sql(spark, tmp_path, "loss_simpo_sft", vectors(range(80), lambda i: i < 64))
    assert got == sql and got[1] == (1, None)


@pytest.mark.parametrize("n", [33, 26, 42, 48])
def test_mean_logits_of_sequences_with_labels_that_count(spark, tmp_path, n):
    """The last sequence has one vector, two of which the second is masked, two of which it is not, or eight."""
    got, sql = against_sql(spark, tmp_path, "mean_logits", vectors(range(n)))
    assert got == sql and len(got) == n // 8 + (n == 42)
