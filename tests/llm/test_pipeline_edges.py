"""Every stage of the pipeline on rows that are hard: null ids, texts and sources, empty and very long texts, ties, repeated rows, clashing
columns, and empty tables."""

import random
from collections import Counter

import pytest

from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, keep int, size int, `set` string, item_id long, h string, comp long, is_toxic int"
STAGES = range(5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, item, base = "A line that several documents share", text(20), text(80)
    out = [(None, None), (None, None), (0, None), (1, ""), (2, " \t\n "), (3, "one"), (3, "ONE"), (4, base), (4, base), (5, base + " x"), (None, base), (None, base), (6, text(90)), (6, text(90))]
    out += [(10 + i, f"{text(15)}\n{line}\n{text(5)}\n  {line.lower()} ") for i in range(6)] + [(None, f"{text(10)}\n{line}")]
    out += [(30, text(40) + " " + item + " " + text(30)), (31, item.upper()), (None, item + " " + text(9)), (32, item)]
    out += [(40, text(30_000)), (41, "ü" * 5000), (42, "spaces " * 3000)]
    return [(d, t, "en", rng.choice(["a", "b", None]), len(t or ""), "x", 1, 2, "s", 3, "h", 4, 5) for d, t in out], item


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("edges"))
    docs, item = rows
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    labels = [(d, 1, 0) for d in range(40)] + [(None, 0, 1), (5, None, None), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return [f for _, f in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_no_toxic_labels(spark, stages, docs, folder):
    out = stages[0](spark, docs, folder)
    assert out.columns == docs.columns and of(out) == of(docs)


def test_lines(spark, stages, docs, folder):
    out = stages[1](spark, docs, folder)
    assert out.columns == docs.columns and out.count() == docs.count()
    known = [(d, t) for (d, t), n in of(docs).items() if d is not None and [x for x, _ in of(docs)].count(d) == 1]
    shared = dict(brute.lines([x for x in of(docs) if x[0] is not None]))
    import hashlib

    got = {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in of(out) if d is not None}
    assert all(got[d] == shared[d][2] for d, _ in known)
    assert sum(n for (d, _), n in of(out).items() if d is None) == sum(n for (d, _), n in of(docs).items() if d is None)
    assert all(t in {x for _, x in of(docs)} for d, t in of(out) if d is None)  # null ids keep their lines


def test_one_of_each_group(spark, stages, docs, folder):
    out = stages[2](spark, docs, folder)
    assert out.columns == docs.columns
    every = [x for x, n in of(docs).items() for _ in range(n)]
    sets = [brute.shingles(t, 5) for _, t in every]
    linked = [(i, j) for i in range(len(every)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = brute.roots(range(len(every)), linked)
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(every[i])
    got = of(out)
    assert sum(got.values()) == len(groups) and set(got) <= set(every)
    for members in groups.values():
        least = min((d for d, _ in members if d is not None), default=None)
        assert any((d, t) in got for d, t in members if d == least)


def test_leaks(spark, stages, docs, folder, rows):
    out = stages[3](spark, docs, folder)
    leaks = {d for d, _ in brute.contained([x for x in of(docs) if x[0] is not None], [(1, rows[1])])}
    assert leaks == {30, 31, 32}
    assert out.columns == docs.columns and of(out) == Counter({x: n for x, n in of(docs).items() if x[0] not in leaks})


def test_mixture(spark, stages, docs, folder):
    out = stages[4](spark, docs, folder).collect()
    size, target = brute.targets([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert len(out) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in out)
    assert abs(sum(r.taken for r in out) - sum(target.values())) <= len(size)
    assert sorted(r["size"] for r in out) == sorted(len(brute.words(r.text)) for r in docs.collect())


@pytest.mark.parametrize("k", STAGES)
def test_empty_table(spark, stages, docs, folder, k):
    out = stages[k](spark, docs.limit(0), folder)
    assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_run(spark, folder):
    import corpus_pipeline

    first, again = (sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert first == again and len(first) > 10
