"""Operator 11's exact counts: what they take of disks, and that packing them loses nothing."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.test_phrases_and_spelling import plain_collocations


def written(spark):
    """Bytes of shuffles written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_counts_take_little_disk_and_sketches_go(spark, monkeypatch):
    from tidewater.llm.collocations import collocations

    rng = random.Random(71)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(4, 9))) for _ in range(500)]
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(1500)]  # each in every partition, so all phrases are frequent
    docs = spark.createDataFrame([("en", ". ".join(rng.sample(lines, len(lines)))) for _ in range(12)], "lang string, text string").repartition(12).localCheckpoint()
    sent = []
    plain = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(plain(self, value)) or sent[-1])
    before = written(spark)
    found = collocations(docs)
    took = written(spark) - before
    assert len(sent) == 3 and not any(os.path.exists(b._path) for b in sent)
    assert took < 4_000_000, took
    assert found.count() == 2000


def test_languages_and_parts(spark, monkeypatch):
    from tidewater.llm import collocations as c

    monkeypatch.setattr(c, "PART", 50)  # several parts for each shuffle partition
    rng = random.Random(72)
    rows = [(rng.choice(["en", "a\nb", "a", "\n", None, "b\né"]), " ".join(rng.choice(["sea", "é", "漢", "tide", "b"]) for _ in range(30))) for _ in range(150)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in c.collocations(docs, least=3).collect()}
    assert got == plain_collocations(rows, 3, 2000) and len({k[0] for k in got}) == 6


def test_tallies_and_blocks(monkeypatch):
    from tidewater.llm import collocations as c

    monkeypatch.setattr(c, "GATHERED", 2000)  # summed many times
    rng = random.Random(73)
    want, meets = Counter(), c.Tally()
    for _ in range(5):  # tasks
        held = c.Tally()
        for _ in range(40):
            some = {f"{rng.choice(['en', 'x'])}\n{rng.randrange(300)} {'é' * rng.randrange(3)}": rng.choice([1, 300, 2**33]) for _ in range(20)}
            held.add(pa.array(list(some)), np.array(list(some.values())))
            want.update(some)
        seen = []
        for batch in c.blocks(held, 2500):
            seen += batch["part"].to_pylist()
            for data in batch["counts"]:
                meets.add(*c.unpacked(data.as_buffer()))
        assert seen == sorted(set(seen)) and seen[-1] < 2500
    table = meets.table()
    assert dict(zip(table["key"].to_pylist(), table["n"].to_pylist(), strict=True)) == want
    assert not list(c.blocks(c.Tally(), 3)) and not sum(x.num_rows for x in c.Tally().frequent(1))
