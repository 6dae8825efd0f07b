"""Token files and their index against the tokenizers library, row by row."""

import random
import zlib

import numpy as np
import pytest


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(library, text, end=1):
    return [*library.encode(text or "", add_special_tokens=False).ids, *([] if end is None else [end])]


def test_encoder(path, library):
    import pyarrow as pa

    from tidewater.llm.tokenfiles import Encoder

    rng = random.Random(13)
    some = ["'", "s", "ll", "ve", "re", "'d", "'T", " ", "\n", "\t", "A", "é", "É", "ß", "×", "÷", "ª", "²", "½", "7", "12", ".", "--", "\x00", "\x85", "\xa0", "\x1c", "µ", "don't", "Straße", "é", "漢", "🙂", "<|endoftext|>", "</w>"]
    texts = [None, "", " ", "'", "s'", *("".join(rng.choice(some[:-5] if rng.random() < 0.8 else some) for _ in range(rng.randint(1, 30))) for _ in range(4000))]
    ids, counts = Encoder(path).encode(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(library, text, None), repr(text)


def test_perfect_hash():
    from tidewater.llm.tokenfiles import PerfectHash

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 5000):
        h1, h2 = (rng.integers(0, 1 << 63, n, np.uint64) for _ in range(2))
        own = PerfectHash.of(h1, h2)
        assert sorted(own.slots(h1, h2).tolist()) == list(range(n))
        other = own.slots(h2, h1)
        assert ((other >= -1) & (other < max(n, 1))).all()
    with pytest.raises(ValueError):
        PerfectHash.of(np.array([5, 5], np.uint64), np.array([6, 6], np.uint64))


@pytest.mark.parametrize(("shard_ids", "bucket"), [(1 << 25, 1 << 18), (300, 16)])
def test_files(spark, tmp_path, path, library, shard_ids, bucket):
    from pyspark.sql import functions as F

    from tidewater.llm.tokenfiles import write_token_files

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["sea", "Don't", "naïve", "x1", "漢字"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 40))) for i in range(-50, 400) if i % 3] + [(None, None), (None, "a b"), (7, "again"), (7, "again"), (7, ""), (500, text(30_000)), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(c) for c in ("key", "h", "row", "file", "shard", "bucket", "ids")})
    files = write_token_files(docs, str(tmp_path / "out"), path, shard_ids=shard_ids, bucket=bucket)
    asked = docs.select("doc_id").distinct().union(spark.createDataFrame([(9999,), (402,)], "doc_id long"))
    got = files.read(asked, "doc_id").collect()
    encoded = sorted(((d, ids_of(library, t)) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((str(r.key), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == sorted((str(d), tuple(i)) for d, i in encoded)
    # each document's place: all files, read in order, hold its ids there, and places follow each other in ascending order of ids
    order = [r.file for r in files.shards.orderBy("shard").collect()]
    whole = np.concatenate([np.fromfile(tmp_path / "out" / "ids" / f"{f}.ids", f"<u{files.width}") for f in order])
    assert len(whole) == sum(len(i) for _, i in encoded) and (len(order) > 4) == (shard_ids == 300)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and whole[at : at + r.n_tokens].tolist() == np.frombuffer(r.ids, "<u4").tolist()
        at += r.n_tokens
    keys = [r.key for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_other_keys_and_empty(spark, tmp_path, path, library):
    from tidewater.llm.tokenfiles import write_token_files

    docs = spark.createDataFrame([("b", "one two"), ("a", None), ("é", "three")], "name string, body string")
    files = write_token_files(docs, str(tmp_path / "s"), path, id_col="name", text_col="body", end=None)
    got = {r.key: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in files.read(docs.select("name"), "name").collect()}
    one = ids_of(library, "one two", None)
    assert got == {"a": (0, []), "b": (0, one), "é": (len(one), ids_of(library, "three", None))}
    none = write_token_files(docs.limit(0), str(tmp_path / "e"), path, id_col="name", text_col="body")
    assert none.read(docs.select("name"), "name").count() == 0
    with pytest.raises(ValueError):
        write_token_files(docs, str(tmp_path / "w"), path, id_col="name", text_col="body", end=1 << 20)


def test_query(spark, library):
    from tidewater.llm.queries import op13_token_files

    sf = "/root/testdata/sf0.001"
    want, at = {}, 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(ids_of(library, r.text), "<u4")
        want[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op13_token_files(spark, sf).collect()} == want
