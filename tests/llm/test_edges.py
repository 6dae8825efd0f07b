"""Operators on hard rows: null ids, null, empty and very long texts, repeated rows and columns whose names clash with the operators' own."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

CLASH = ("id", "block", "ids", "codes", "n", "first", "piece", "base", "runs", "spans", "owner", "start", "words", "shard", "rank", "size", "content", "meta", "stats", "label", "y", "h")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(30)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(60)
    out = [(None, None), (None, shared), (None, shared), (0, None), (1, ""), (2, "   "), (3, shared), (4, text(10) + shared), (5, text(30)), (5, text(30)), (6, "x" * 3000), (7, text(40_000)), (8, f"{shared} password = {'a1b2' * 9} é AKIA{'Q7' * 9}"), (None, f"token={'Zz9' * 8}")]
    return [*out, out[5], out[7], out[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(c) for c in CLASH} | {"source": F.when(F.col("doc_id") % 2 == 0, "a"), "lang": F.lit("en")})


def test_token_counts(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidewater.llm.tokens import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    want = Counter((d, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    for size in (200, 1 << 25):
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(docs, path, block_bytes=size).collect()) == want


def test_secrets(docs, rows):
    from tidewater.llm.secrets import KINDS, secret_spans

    got = secret_spans(docs).collect()
    base = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind in KINDS)) for r in got)
    assert base == Counter((d, tuple(brute.secrets(t))) for d, t in rows)
    assert all(s.score is not None for r in got for s in r.spans)


def test_substrings(docs, rows):
    """Rows with a null id stay whole; rows of one id count as one document, so ids are made unique here."""
    from tidewater.llm.substrings import substring_dedup

    unique = docs.filter("doc_id is null or doc_id not in (2, 5)").dropDuplicates(["doc_id", "text"])
    known = dict((d, t) for d, t in rows if d not in (None, 2, 5))
    want = brute.substrings(list(known.items()))
    got = substring_dedup(unique).select("doc_id", "n_bytes", "n_removed", F.size("removed").alias("n"), F.sha2("kept", 256).alias("sha")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n, r.sha) for r in got if r.doc_id is not None} == want
    assert all(r.n_removed == 0 for r in got if r.doc_id is None) and len(got) == unique.count()


def test_jaccard(docs, rows):
    from tidewater.llm.jaccard import jaccard_join

    got = Counter((r.doc, r.n) for r in jaccard_join(docs, k=3, percent=90).classes().collect())
    assert got == Counter((d, len(brute.shingles(t, 3))) for d, t in rows)


def test_mixture(docs, rows):
    """What is taken of each document, against slots that are laid over the words in a plain way."""
    from tidewater.llm.mixing import mix_sources

    found = mix_sources(docs, length=16)
    out = found.documents.collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((d, len(brute.words(t))) for d, t in rows)
    place = {(r.rank, r.start): r.id for r in found.blocks.collect()}
    ends = Counter()
    for r in found.blocks.collect():
        ends[r.rank, r.start] += r.words
    words = {}  # each source's words by the document that holds them
    for (rank, start), n in ends.items():
        words.update({(rank, start + i): (rank, start) for i in range(n)})
    taken = Counter()
    for s in found.slots.collect():
        for i in range(s.words):
            if (s.rank, s.block * 16 + i) in words:
                taken[words[s.rank, s.block * 16 + i]] += 1
    want = Counter()
    for key, n in taken.items():
        want[place[key]] += n
    got = Counter()
    for r in out:
        got[r.doc_id] += r.taken
    assert +got == want
    for r in found.sources.collect():
        assert sum(n for (rank, _), n in taken.items() if rank == r.rank) == r.words and abs(r.words - r.target) <= 0.5


def test_quality_and_toxicity(spark, docs, rows):
    from tidewater.llm.quality import quality
    from tidewater.llm.toxicity import toxicity

    labels = spark.createDataFrame([(d, int(d < 4), int(d == 5)) for d in range(9)] + [(None, 0, 1), (None, None, None), (3, None, None)], "doc_id long, quality int, toxic int")
    assert Counter(r.doc_id for r in quality(docs, labels).collect()) == Counter(d for d, _ in rows)
    scored = toxicity(docs, labels, prefix="of_")
    assert scored.columns[: len(docs.columns)] == docs.columns and Counter(r.doc_id for r in scored.collect()) == Counter(d for d, _ in rows)
    by_text = {}
    for r in scored.collect():
        by_text.setdefault(r.text or "", set()).add(r.of_p_toxic)
    assert all(len(v) == 1 for v in by_text.values())  # equal texts score the same
