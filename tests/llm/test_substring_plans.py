"""Operator 6 sends no table to every executor through the driver, whatever its file's size."""

import random

from tests.llm import brute


def test_no_join_is_broadcast(spark):
    from tidewater.llm.common import Scratch
    from tidewater.llm.substrings import covered_spans, substring_dedup

    rng = random.Random(59)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    passage = text(300)
    rows = [(i, text(rng.randint(0, 60)) + passage[rng.randint(0, 20) :] + text(40)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    found = {r.doc_id: (r.n_bytes, r.n_removed) for r in substring_dedup(df).collect()}
    # owners split by other hashes, and windows by their own bytes
    covered_spans(df, Scratch(spark, "t"), owner_bytes=2000, turns=1).collect()
    covered_spans(df, Scratch(spark, "t"), owner_bytes=0, turns=0).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(int(before), runs.size())]
    assert {d: v[:2] for d, v in brute.substrings(rows).items()} == found
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
