"""Collocations and spelling variants against plain versions."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

CLASH = ("phrase", "words", "n", "f", "parts", "a", "l", "r", "salt", "word", "run", "id", "near", "root")


def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = {}
    for lang, own in f.items():
        some = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in some.items():
            if any(100 * b >= 50 * a for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, left, right = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n[lang], -s)
    return out


@pytest.mark.parametrize(("least", "top", "most_bits"), [(3, 2000, 29), (2, 7, 4)])
def test_collocations(spark, least, top, most_bits):
    from tidewater.llm.collocations import collocations

    rng = random.Random(11)
    vocabulary = ["sea", "Sea", "é", "漢", "of", "the", "longer-than-eight", "x\x0by", "\xa0", "tide", "a"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n"]) for _ in range(n))
    rows = [(rng.choice(["en", "fr", None]), text(rng.randint(0, 40))) for _ in range(120)] + [("en", None), ("en", ""), ("de", " . , "), ("en", text(6000))]
    rows += [("en", "high tide table")] * 50 + [("en", "low water mark, low water")] * 20
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({c: F.lit(c) for c in CLASH})
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations(docs, least=least, top=top, most_bits=most_bits).collect()}
    want = plain_collocations(rows, least, top)
    assert got == want and len(want) > 15
    assert collocations(docs.limit(0)).count() == 0


def test_scores_are_exact(spark):
    from tidewater.llm.collocations import score

    rng = random.Random(1)
    rows = [(a, a + rng.randrange(10**9), a + rng.randrange(10**9)) for a in (10, 3_037_000_500, 10**12 + 7, 10**15 + 1) for _ in range(20)]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", score(F.col("a"), F.col("l"), F.col("r")))
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in df.collect())


def plain_variants(n, times):
    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in n if apart(w, x)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


@pytest.mark.parametrize("most_group", [50_000, 20])
def test_spelling_variants(spark, most_group):
    from tidewater.llm.spelling import spelling_variants

    rng = random.Random(12)
    n = {}
    for _ in range(40):
        word = "".join(rng.choice("abéÿ") for _ in range(rng.randint(7, 10)))
        for _ in range(8):
            n.setdefault(word, rng.choice([2, 2, 3, 20, 30, 200, 300, 3000]))
            i = rng.randrange(len(word) + 1)
            word = rng.choice([word[:i] + rng.choice("abc") + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice("abc") + word[i + 1 :]])
    n |= {"a" * i: 10**i % 9973 + 2 for i in range(7, 12)} | {"beginnin" + c: 5 for c in "gabcdef"} | {c + "eginning": 5 for c in "bcdefgh"}
    words = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants(words, times=10, most_group=most_group).collect()}
    want = plain_variants(n, 10)
    assert got == want and any(v[4] != v[2] for v in want.values() if v[2])
    assert spelling_variants(words.limit(0)).count() == 0


def test_letter_runs(spark):
    from tidewater.llm.spelling import letter_runs, words_of

    rows = [(1, None), (2, ""), (None, "Straße ÉTÉ-été"), (3, "a1b×c÷d ñandú"), (3, "a1b×c÷d ñandú")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in CLASH})
    runs = letter_runs(docs, "doc_id", "text", 1)
    want = Counter((d, "".join(c.lower() if c.isascii() else c for c in run)) for d, t in rows for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    assert Counter((r.id, r.run) for r in runs.collect()) == want
    counts = Counter({w: 0 for _, w in want})
    for (_, w), m in want.items():
        counts[w] += m
    assert {r.word: r.n for r in words_of(runs.withColumnRenamed("run", "word"), 2, 2).collect()} == {w: m for w, m in counts.items() if len(w) >= 2 and m >= 2}
