"""Operators do the whole job: what the first review found left out."""

import random
import warnings
from collections import Counter, defaultdict

from tests.llm import brute


def test_shards_hold_the_words_that_are_taken(spark):
    from tidewater.llm.mixing import mix_sources

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    text = lambda n: rng.choice(["", " \n"]) + "".join(word() + rng.choice([" ", "\n", "\t  "]) for _ in range(n)).strip()
    rows = [(i, text(rng.randint(0, 300)), ["a", "b", None][min(i % 7, 2)]) for i in range(60)] + [(60, None, "a"), (61, text(3000), "b")]
    rows += [rows[3], rows[3], (3, text(7), rows[3][2])]  # repeated rows, and an id with two texts
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = mix_sources(df, length=16)
    words = defaultdict(list)
    for d, t, _ in rows:
        words[d].append(brute.words(t))
    slots = {(r.rank, r.slot): r for r in found.slots.collect()}
    shards = found.shards.collect()
    assert shards
    inside, of_slot, of_doc = Counter(), Counter(), Counter()
    for r in shards:
        own = brute.words(r.text)
        assert len(own) == r.words > 0 and any(own == w[r.first : r.first + r.words] for w in words[r.id])
        of_slot[r.rank, r.slot] += r.words
        of_doc[r.id] += r.words
        inside.update(((r.rank, r.slot, r.at + j) for j in range(r.words)))
    assert max(inside.values()) == 1 and all(at < slots[rank, slot].words for rank, slot, at in inside)
    sources = {r.rank: r for r in found.sources.collect()}
    short = [k for k, r in slots.items() if of_slot[k] != r.words]  # only a source's last block has fewer words
    assert all(slots[k].block == sources[k[0]].n_blocks - 1 for k in short)
    taken = Counter()
    for r in found.documents.collect():
        taken[r.doc_id] += r.taken
    assert +taken == of_doc
    full = {(r.shard, r.rank, r.slot): r.text for r in found.texts().collect()}
    assert {k[1:] for k in full} == set(slots) and all(len(brute.words(t)) == of_slot[k[1:]] for k, t in full.items())
    blocks = {(r.rank, r.block, r.start, r.first, r.at): r.words for r in found.blocks.collect()}
    assert all(blocks[r.rank, r.block, r.start, r.first, r.at] >= r.words for r in shards)
    assert sum(blocks.values()) == sum(len(w) for ws in words.values() for w in ws)
    for rank, r in sources.items():
        assert r.length == 16 and abs(sum(n for (k, _), n in of_slot.items() if k == rank) - r.target) <= 1


def all_links(rows, k, percent):
    """Each row's number of linked other rows, by brute force."""
    sets = [brute.shingles(t, k) for _, t in rows]
    return [sum(i != j and bool(s and x) and 100 * len(s & x) >= percent * len(s | x) for j, x in enumerate(sets)) for i, s in enumerate(sets)]


def test_jaccard_has_all_links(spark):
    """Near copies of one text: links within a component, of pairs that the pivot connects, too."""
    from tidewater.llm.jaccard import jaccard_join, within

    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE")]
    for size, copies in ((80, 60), (120, 12), (40, 3), (60, 2), (30, 1)):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(size)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [rows[10], rows[10], (len(rows), rows[70][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, percent in ((3, 90), (5, 80)):
        found = jaccard_join(df, k=k, percent=percent)
        want = all_links(rows, k, percent)
        assert max(want) > 20
        assert sorted((r.doc, r.n_links) for r in found.link_counts().collect()) == sorted((d, n) for (d, _), n in zip(rows, want, strict=True))
        sets = {r.doc: r.set for r in found.sets.collect()}
        text = {sets[d]: brute.shingles(t, k) for d, t in rows}
        got = [(r.a, r.b) for r in found.links.collect()]
        assert len(set(got)) == len(got)
        for r in found.links.collect():
            assert r.a < r.b and (r.n_a, r.n_b, r.common) == (len(text[r.a]), len(text[r.b]), len(text[r.a] & text[r.b]))
        # many blocks a component
        for pairs in (True, False):
            blocks = within(found.members(), found.parts, percent, pairs, block=8).collect()
            if pairs:
                assert sorted((r.a, r.b) for r in blocks) == sorted(got)
            else:
                others = Counter()
                for r in blocks:
                    others[r.set] += r.others
                copies = Counter(r.set for r in found.sets.collect())
                assert {s: n + copies[s] - 1 for s, n in others.items()} == {sets[d]: n for (d, _), n in zip(rows, want, strict=True) if others[sets[d]]}


def test_jaccard_streams_runs_over_partitions(spark):
    """Prefix rows of n-grams that go on over batches and partitions give the same star edges as in one piece."""
    import numpy as np
    import pyarrow as pa

    from tidewater.llm.jaccard import streamed

    rng = random.Random(15)
    for _ in range(200):
        rows = sorted((rng.randint(0, 4), rng.randint(0, 6) << 32 | 9, rng.randint(0, 5)) for _ in range(rng.randint(1, 25)))
        batch = lambda part: pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*part, strict=True)], ["gram", "own", "set"])
        cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(3))})
        cuts = [c for c in cuts if c in (0, len(rows)) or rows[c - 1] != rows[c]]  # equal rows are in one partition
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            inner = sorted({a, b, rng.randint(a, b), rng.randint(a, b)})
            for found in streamed((batch(rows[x:y]) for x, y in zip(inner[:-1], inner[1:], strict=True)), 1):
                out += list(zip(*(c.to_pylist() for c in found.columns), strict=True))
        near = {x for is_open, g, o, s, po, p, _ in out if not is_open for x in ((g, o, s), (g, po, p))}
        distinct = set(rows)
        groups = defaultdict(set)
        for g, o, s in distinct:
            groups[g].add((o, s))
        links = defaultdict(set)
        for is_open, g, o, s, po, p, many in out:
            links[g].add(((o, s), (po, p)))
            if not is_open and len(groups[g]) > 2 and (o, s) != (po, p):
                assert many
        ends = defaultdict(set)
        for is_open, g, o, s, *_ in out:
            if is_open:
                ends[g].add((o, s))
        for g, members in groups.items():
            if len(members) > 1:
                assert {(g, *m) for m in members} <= near
                least = min(ends[g], default=None)
                edges = [*links[g], *((e, least) for e in ends[g])]
                order = sorted(members)
                place = {m: i for i, m in enumerate(order)}
                root = brute.roots(range(len(order)), [(place[a], place[b]) for a, b in edges])
                assert set(root.values()) == {0}
        assert near <= distinct


def test_jaccard_partners_by_sizes_and_places():
    import numpy as np

    from tidewater.llm.jaccard import partners

    rng = random.Random(19)
    for percent in (50, 80, 90):
        runs = [sorted(rng.randint(0, 5) << 32 | rng.randint(6, 30) for _ in range(rng.randint(1, 6))) for _ in range(300)]
        sizes = np.array(list(map(len, runs)))
        star, many = partners(np.array([x for r in runs for x in r]), np.cumsum(sizes) - sizes, sizes, percent, most=5)
        at = 0
        for r in runs:
            n, pos = [x & 0xFFFFFFFF for x in r], [x >> 32 for x in r]
            fine = lambda i, j: 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]) and (100 + percent) * min(n[i] - pos[i], n[j] - pos[j]) >= percent * (n[i] + n[j])  # noqa: E731, B023
            if 1 < len(r) <= 5:
                assert [bool(x) for x in star[at : at + len(r)]] == [i > 0 and fine(i, 0) for i in range(len(r))]
                assert [bool(x) for x in many[at : at + len(r)]] == [i > 0 and any(j not in (0, i) and fine(i, j) for j in range(len(r))) for i in range(len(r))]
            else:
                assert star[at : at + len(r)].all() and many[at : at + len(r)].all()
            at += len(r)


def test_parities_bound_differences(spark):
    """The number of bits in which parities differ, folded to the smaller size, by both ways of counting, against the sets."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tidewater.llm import jaccard

    rng = np.random.default_rng(22)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 255, 256, 257, 900, 1100, 5000, 40_000)]
    sets += [np.union1d(s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, 1 + len(s) // 20, dtype=np.uint64)) for s in sets]
    rows = [jaccard.parities(s) for s in sets]
    assert [64 * len(r) for r in rows[:9]] == [256, 256, 256, 256, 512, 1024, 2048, 8192, 32768]
    folded = jaccard.Folded(pa.array([r.tolist() for r in rows], pa.list_(pa.int64())))
    a, b = map(np.ravel, np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = folded.differ(a, b)
    pairs = []
    for i, j, d in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        size = 64 * min(len(rows[i]), len(rows[j]))
        other = np.setxor1d(sets[i], sets[j])
        assert d == (np.bincount((other & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).sum() <= len(other)
        n_i, n_j = len(sets[i]), len(sets[j])
        pairs.append((len(pairs), n_i, n_j, rows[i].tolist(), rows[j].tolist(), 100 * (n_i + n_j - d) >= 90 * (2 * (n_i + n_j) - (n_i + n_j - d))))
    df = spark.createDataFrame(pairs, "k int, n_a int, n_b int, bits_a array<long>, bits_b array<long>, want boolean").repartition(4)
    assert df.filter(jaccard.alike(90) != F.col("want")).count() == 0


def test_jaccard_null_ids_and_equal_names(spark):
    """Null ids link like any; an id with several texts is several documents; sets whose first names are equal stay apart."""
    from tidewater.llm import jaccard

    text = lambda start: " ".join(f"w{start + i}" for i in range(60))
    rows = [(None, text(0)), (None, text(0) + " x"), (5, text(0) + " y"), (9, text(500)), (9, text(500) + " z"), (9, text(0)), (3, text(900)), (4, text(900)), (None, text(2000)), (None, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = all_links(rows, 3, 90)
    found = sorted((r.doc or -1, r.n, r.component_id or -1, r.n_links) for r in jaccard.jaccard_join(df, k=3, percent=90).classes(counted=True).collect())
    groups = [5, 5, 5, 9, 9, 5, 3, 3, None, None, 8]
    assert found == sorted((d or -1, len(brute.shingles(t, 3)), g or -1, n) for (d, t), g, n in zip(rows, groups, want, strict=True))
    first, second = jaccard.names_of(__import__("numpy").arange(3))
    assert jaccard.names_of(__import__("numpy").arange(3), frozenset([first])) == (second, second)


def test_quality_learns_from_all_unlabelled_documents(spark):
    """The bound is on labelled documents only."""
    from tests.llm.test_operators import classified
    from tidewater.llm.quality import metadata, quality, train

    docs, labels, truth = classified(spark)
    judge, every = train(docs, labels, metadata(["source", "lang"], docs, "n_chars"), most=100)
    assert every.count() == docs.count()
    assert len(judge.used) == 3 and all(max(views) > 300 for views in judge.used)
    held = [r for r in quality(docs, labels, most=100).collect() if r.doc_id % 2 and r.doc_id < 1200]
    assert sum(r.kept != truth[r.doc_id][0] for r in held) >= 0.95 * len(held)


def test_automata_learn_whole_credentials():
    """Credentials of over 64 characters, whose classes follow a pattern without a period."""
    from tidewater.llm.secrets import infer, learn

    rng = random.Random(13)
    kinds = ["0123456789", "abcdef", "ghijklmnop", "ABCDEF", "GHIJKLMN"]
    for n in (65, 66, 100, 300):
        pattern = [rng.choice(kinds) for _ in range(n)]
        key = lambda: "".join(map(rng.choice, pattern)).encode()  # noqa: E731, B023
        found = learn({"assign": [key() for _ in range(300)], "access": [], "hex": []})["assign"]
        fresh = [key() for _ in range(100)]
        assert sum(found.score(w) >= found.threshold for w in fresh) >= 85
    hexes = [bytes(rng.choice(b"0123456789abcdef") for _ in range(128)) for _ in range(300)]
    found = learn({"assign": [], "access": [], "hex": hexes[:200]})["hex"]
    assert sum(found.score(w) >= found.threshold for w in hexes[200:]) >= 85
    assert len(infer([b"ab1" * 2000]).steps) <= 140


def test_all_candidates_are_scored(spark):
    """Runs of 12 characters, without a digit, and around a base span; but none within one."""
    from tidewater.llm.secrets import Automaton, secret_spans

    judge = Automaton(bytes(256), __import__("numpy").zeros(256), steps=[{}], ends=[0.0], threshold=-1e9)  # finds every run likely
    texts = ["so Abcdefghijk1 it", "so AbcdefghijkL it", "AbcdefghijK", "é Zq0123456789abcdefXYZ", "0123456789abcdef", "password=abcdefghijk1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_spans(df, automata={"hex": judge}).collect()}
    assert got[0] == [("like_hex", 3, 15)] and got[1] == [("like_hex", 3, 15)] and got[2] == []
    assert got[3] == [("like_hex", 2, 23), ("hex", 4, 20)]
    assert got[4] == [("hex", 0, 16)] and got[5] == [("assign", 0, 21)]


def test_embedding_links_recall(spark):
    """64 components, many lists: links of cosines down to 0.93 against brute force, and a large group of near copies whole."""
    import numpy as np

    from tidewater.llm.embeddings import embedding_links

    rng = np.random.default_rng(14)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    base = unit(rng.normal(size=(1500, 64)))
    away = unit(rng.normal(size=(1500, 64)))
    away = unit(away - (away * base).sum(1)[:, None] * base)
    c = rng.uniform(0.9301, 0.99, size=(1500, 1))
    copies = c * base + np.sqrt(1 - c * c) * away
    group = unit(base[:1] + 0.01 * rng.normal(size=(600, 64)))
    x = np.concatenate([base, copies, group])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(None, x[0].tolist(), 1)], "vec_id long, embedding array<double>, label int").repartition(4)
    cosine = x @ x.T
    np.fill_diagonal(cosine, 0)
    want = (cosine >= 0.93).sum(1)
    got = {r.vec_id: r for r in embedding_links(df, most=2000, block=256).collect()}
    assert got[None].kept and got[None].n_links == 0
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.99 * want.sum()
    assert (n[3000:] >= 599).all() and len({got[i].component_id for i in range(3000, 3600)}) == 1


def test_formats_are_found_outside_their_contexts(spark):
    """Keys of the learned formats without what the base patterns go by: at least 0.9 are found; words, names and numbers, and runs of other
    lengths, are left alone."""
    from tidewater.llm.secrets import KINDS, labelled, found_in, learn, secret_spans

    rng = random.Random(16)
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["ver", "ant", "ious", "ment", "graph", "ster", "pol", "en", "Ab", "or"]
    name = lambda: rng.choice(["", "get_", "some-"]) + "".join(rng.choice(syllables) for _ in range(rng.randint(4, 7)))
    texts = [f"{name()} {name()} api_key = {key(mixed, 32)} é {name()} {key('0123456789abcdef', 40)} AKIA{key(mixed[:26] + mixed[-10:], 16)}" for _ in range(300)]
    bare = [f"é {name()} {key(mixed, 32)}, {name()}" for _ in range(200)]
    clean = [f"{name()} {name()}={name()} {name()}{rng.randint(1, 99)}" for _ in range(300)] + [f"on {key(mixed, 14)}" for _ in range(100)] + ["20240131120000 1234567890123"]
    df = spark.createDataFrame(list(enumerate(texts + bare + clean)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [s for s in r.spans if s.kind not in KINDS] for r in secret_spans(df).collect()}
    hits = [got[i + 300] for i in range(200)]
    assert sum(any(s.kind == "like_assign" and texts_of[s.start : s.end].isalnum() and s.end - s.start == 32 for s in spans) for spans, texts_of in zip(hits, bare, strict=True)) >= 180
    assert sum(bool(got[i + 500]) for i in range(len(clean))) <= 4
    found = learn(*labelled(found_in(df, "doc_id", "text", 12), 2000))
    assert set(found) == set(KINDS) and all(len(a.steps) > 10 for a in found.values()) and found["access"].prefix == b"AKIA"
    for n in (16, 40, 128):
        hexes = learn({"hex": [key("0123456789abcdef", n).encode() for _ in range(300)]})["hex"]
        assert len(hexes.steps) > n
        assert sum(hexes.margin(key("0123456789abcdef", n).encode()) >= 0 for _ in range(100)) >= 90
        assert not any(hexes.margin(key("0123456789abcdef", m).encode()) >= 0 for m in (n - 3, n + 5))


def test_kinds_of_several_lengths_stay_strict():
    """Two lengths of a kind, with or without what ordinary runs look like: held-out credentials are found, and UUIDs, times, numbers and runs of other lengths aren't."""
    from tidewater.llm.secrets import Formats, learn

    rng = random.Random(23)
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n)).encode()
    low, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    uuid = lambda: b"-".join(key(low, n) for n in (8, 4, 4, 4, 12))
    names = [b"_".join(rng.choice([b"get", b"value", b"some", b"user", b"name"]) for _ in range(4)) for _ in range(400)]
    ordinary = names + [uuid() for _ in range(40)] + [b"2024-01-%02d-12-30-05" % rng.randint(1, 28) for _ in range(40)]
    for letters, sizes in ((low, (16, 40)), (mixed, (24, 32)), (low, (16, 20, 64))):
        words = [key(letters, rng.choice(sizes)) for _ in range(416)]
        for plain in ([], ordinary):
            found = learn({"hex": words}, plain)["hex"]
            assert isinstance(found, Formats) and len(found.parts) == len(sizes) and all(a.allowed <= 1 for a in found.parts)
            take = lambda ws: sum(found.margin(w) >= 0 for w in ws) / len(ws)
            for n in sizes:
                assert take([key(letters, n) for _ in range(200)]) >= 0.9
            for n in {12, 14, 18, 33, 48, 80}:
                assert take([key(letters, n) for _ in range(100)]) <= 0.05
            assert take([uuid() for _ in range(100)]) <= 0.05
            assert take([b"%d" % rng.randint(10**12, 10**14) for _ in range(100)] + [b"20240131123005", b"2024-01-31-12-30-05"]) <= 0.05


def test_a_kind_without_a_format_is_left_out():
    """Credentials that tell nothing of others: a warning, and no automaton that takes everything."""
    from tidewater.llm.secrets import learn

    rng = random.Random(24)
    texts = [bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789-_.") for _ in range(n)) for n in range(12, 60)]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        found = learn({"assign": texts})["assign"]
    assert "no format" in str(seen[0].message) and found.allowed == -1
    assert not any(found.margin(w) >= 0 for w in [*texts, b"some-dashed-words-in-a-row-1", b"2024-01-31-12-30-05"])


def test_automata_equal_a_plain_alergia():
    """Word probabilities under the merged automaton equal those of a plain version of the method."""
    import math

    from tidewater.llm.secrets import infer

    rng = random.Random(17)
    for letters, sizes in (("ab1", (3, 4)), ("a1", (6, 6)), ("aA1-", (2, 5))):
        words = [("".join(rng.choice(letters) for _ in range(rng.randint(*sizes)))).encode() for _ in range(150)]
        found = infer(words)
        plain = brute.alergia([w.translate(found.symbols) for w in words])
        assert not found.prefix and len(found.steps) - 1 == plain.n_states
        for w in words[:40]:
            chars = sum(found.chars[c] for c in w)
            assert math.isclose(found.read(w)[0] - chars, plain.log_probability(w.translate(found.symbols)), abs_tol=1e-9)


def test_line_runs_in_parts():
    """Runs that are passed on in parts, within a document too, count each document once."""
    import numpy as np
    import pyarrow as pa

    from tidewater.llm.linededup import stream_runs

    rng = random.Random(20)
    for _ in range(100):
        rows = sorted((rng.randint(0, 2), 0, rng.randint(0, 4), p) for p in range(rng.randint(1, 60)))
        cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(5))})
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c, t)) for c, t in zip(zip(*rows[a:b], strict=True), (np.int64, np.int64, np.int64, np.int32), strict=True)], ["h1", "h2", "doc", "pos"]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        docs = defaultdict(set)
        for h, _, d, _ in rows:
            docs[h].add(d)
        for part in (3, 1000):
            out = [x for b in stream_runs(3, part)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            n, last = Counter(), {}
            for kind, h, _, d, _, k in out:
                if kind == 2:
                    n[h] += k
                    last[h] = max(last.get(h, -1), d)
            assert all(n[h] == len(docs[h]) and last[h] == max(docs[h]) for h in n)
            gone = {(d, p) for kind, h, _, d, p, _ in out if kind == 0 or kind == 1 and n[h] >= 3 and d != last[h]}
            assert gone == {(d, p) for h, _, d, p in rows if len(docs[h]) >= 3 and d != max(docs[h])}


def test_one_row_of_each_component_stays(spark):
    """Ids that repeat, with equal and other texts, and null ids: what others() names, but one row, goes."""
    from tidewater.llm.jaccard import jaccard_join

    text = lambda start: " ".join(f"w{start + i}" for i in range(60))
    rows = [(3, text(0)), (3, text(0)), (3, text(0) + " more"), (1, text(0) + " x"), (None, text(0)), (None, text(500)), (None, text(500)), (7, text(500) + " y"), (8, text(900)), (8, text(1500)), (9, None), (9, None), (None, text(3000)), (None, text(3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone, again = jaccard_join(df, k=3, percent=90).others()
    from pyspark.sql import functions as F

    key = {(r.i, r.h): (r.doc_id, r.text) for r in df.select("doc_id", "text", F.xxhash64("doc_id").alias("i"), F.xxhash64("text").alias("h")).collect()}
    gone = {key[r.id_h, r.text_h] for r in gone.collect()}
    assert gone == {rows[0], rows[2], rows[4], rows[5]}
    assert [key[r.id_h, r.text_h] for r in again.collect()] == [rows[-1]]


def test_scratch_tables_go(spark):
    from pathlib import Path

    from tidewater.llm.common import Scratch

    outer = Scratch(spark, "outer")
    kept = outer.put(spark.range(3), "a")
    with Scratch.sweep():
        inner = Scratch(spark, "inner")
        assert outer.put(inner.put(spark.range(4), "b"), "c").count() == 4 and Path(inner.root.removeprefix("file:")).exists()
    assert not Path(inner.root.removeprefix("file:")).exists() and kept.count() == 3
    outer.remove()
    assert not Path(outer.root.removeprefix("file:")).exists() and outer not in Scratch.open


def features_by_row(texts):
    """(features, statistics) of texts, as the classifiers see them."""
    import pyarrow as pa

    from tidewater.llm import linear

    docs, ids, stats = linear.features(pa.array(texts, pa.string()))
    docs, ids = linear.pairs(docs, ids)
    return [ids[docs == i] for i in range(len(texts))], stats


def test_chain_equals_a_plain_chain(spark):
    """Every document's probabilities against dense Newton steps; labels of documents that aren't there change nothing, and nor do null ids, repeated
    rows or very long texts."""
    import numpy as np
    from pyspark.sql import functions as F

    from tests.llm.test_operators import classified
    from tidewater.llm.toxicity import toxicity, train

    docs, labels, _ = classified(spark, 500)
    rows = {r.doc_id: r.text for r in docs.collect()}
    known = {}
    for r in labels.collect():
        if r.doc_id in rows:
            junk, toxic = known.get(r.doc_id, (0, 0))
            known[r.doc_id] = max(junk, int(r.quality == 0)), max(toxic, int(r.toxic == 1))
    ids = sorted(known)
    lists, stats = features_by_row([rows[i] for i in ids])
    held, want = brute.chain(lists, stats, np.array([known[i] for i in ids]))
    more = labels.unionByName(spark.range(10_000, 40_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(1).alias("toxic")))
    extra = [(None, rows[ids[0]]), (ids[0], rows[ids[0]]), (9000, " ".join(["word1"] * 200_000)), (9001, None)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = toxicity(every, more).collect()
    by_id = {r.doc_id: (r.p_junk, r.p_toxic) for r in got if r.doc_id in known}
    assert len(got) == docs.count() + 4
    assert np.abs(np.array([by_id[i] for i in ids]) - want).max() < 0.02
    assert len({(r.p_junk, r.p_toxic) for r in got if r.text == rows[ids[0]]}) == 1
    categories = {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    assert all(v >= 0.9 for v in train(docs, more, categories).held_out.values())


def test_co_training_equals_a_plain_one(spark):
    """Every document's three scores against dense Newton steps on all unlabelled documents; absent documents' labels change nothing."""
    import numpy as np
    from pyspark.sql import functions as F

    from tests.llm.test_operators import classified
    from tidewater.llm.quality import metadata, quality, train

    docs, labels, _ = classified(spark, 500)
    meta = metadata(["source", "lang"], docs, "n_chars")
    rows = {r.doc_id: r for r in docs.select("doc_id", "text", meta.alias("meta")).collect()}
    ids = sorted(rows)
    y = {r.doc_id: r.quality for r in labels.filter("quality is not null").collect() if r.doc_id in rows}
    place = {d: i for i, d in enumerate(ids)}
    known = sorted(y)
    held, fit = known[::5], [d for i, d in enumerate(known) if i % 5]
    lists, stats = features_by_row([rows[d].text for d in ids])
    own = [set(rows[d].meta) for d in ids]
    truth = np.array([y[d] for d in fit], float)
    views = [np.hstack([brute.matrix(lists, brute.telling([lists[place[d]] for d in fit], [truth], 1500, 8)), stats]), brute.matrix(own, brute.telling([own[place[d]] for d in fit], [truth], 1500, 5))]
    where = lambda some: [place[d] for d in some]
    want = brute.co_training(views, {place[d]: v for d, v in y.items()}, where(fit), where(held), where([d for d in ids if d not in y]))
    more = labels.unionByName(spark.range(10_000, 40_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(1).alias("toxic")))
    extra = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    got = {r.doc_id: (r.p_content, r.p_metadata, r.quality, r.kept) for r in quality(docs, more).collect()}
    found = np.array([got[d][:3] for d in ids])
    assert np.abs(found - want).max() < 0.08 and np.abs(found - want).mean() < 0.004
    assert all(k == (q >= 0.5) for *_, q, k in got.values())
    assert sum(r.doc_id is None for r in quality(docs.unionByName(extra), more).collect()) == 1
    assert train(docs, more, meta)[0].held_out >= 0.9
