"""Operator 11 sends no n-gram that holds a rare one."""

import random


def test_phrases_that_hold_a_rare_one_are_not_sent(spark):
    from tidewater.llm.collocations import bitmaps_of, sketch
    from tidewater.llm.common import shuffles_dropped

    rng = random.Random(61)
    words = [f"w{i}" for i in range(400)]
    texts = spark.createDataFrame([("en", " ".join(rng.sample(words, 400))) for _ in range(12)], "lang string, text string")
    sketches = []
    for _ in range(2):  # all words are frequent, no pair is
        sketches.append((20, spark.sparkContext.broadcast(bitmaps_of(sketch(texts, 20, 10, sketches), 20))))
    assert any(x.any() for x in sketches[0][1].value) and sketch(texts, 20, 10, sketches).count() == 0
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before
