"""Token ids as raw binary files, and a minimal perfect hash index for keyed access to them.

Documents are ranged by key, so files in order hold documents in ascending order: nothing but ids, little-endian, of two bytes where the vocabulary allows
and else four. Beside each file its documents' lengths. Index files, one a bucket of keys' hashes, map each key to the shard, the place there and the number of its documents: a minimal perfect hash
gives the key's slot without any key stored, and a 32-bit fingerprint in the slot tells whether the key was there at all. So a key costs one look into one index
file and one read of its ids, however many documents there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import LOWER, MULT, Scratch, bytes_of, hash_spans, mix, partitions, per_worker, pieces_of, tidy

#: Documents' keys for each index file, about; words that a worker remembers; text that is encoded at a time.
BUCKET, REMEMBERED, STRETCH = 1 << 18, 400_000, 4 << 20
MAGIC = b"MPHIDX01"


def opened(path: str):
    """The file system of a path and the path there: of this machine's view of a shared folder, or of a store that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Encoder:
    """Texts to ids with a vocabulary file of the tokenizers library.

    For a vocabulary that lower-cases and splits texts into words and whose merges stay within words, distinct words are encoded once and remembered;
    texts beyond Latin-1, or that hold a special token's string, and all texts of other vocabularies, are encoded by the library whole. The ids are the library's.
    """

    #: What such a file says of normalising and splitting (fixed values of that vocabulary).
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        split = {"type": "Split", "pattern": {"Regex": self.SPLIT}, "behavior": "Removed", "invert": True}
        self.by_words = (
            (spec.get("normalizer") or {}).get("normalizers") == self.NORMAL
            and pre.get("type") == "Sequence"
            and pre["pretokenizers"][0] == split
            and pre["pretokenizers"][1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
            and model["type"] == "BPE"
            and not model.get("dropout")
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        if self.by_words:
            self.model = self.whole.model
            self.forget()
            # bytes as the characters that stand for them: printable Latin-1 for itself, the rest from U+0100 on
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in plain]
            self.shown = {b: 256 + i for i, b in enumerate(rest)}
            kinds = np.full(256, 3, np.uint8)  # of Latin-1 characters: 0 white space, 1 letters, 2 digits, 3 others
            for c in range(256):
                kinds[c] = 1 if chr(c).isalpha() else 2 if chr(c).isnumeric() else 0 if c in (*range(9, 14), 32, 0x85, 0xA0) else 3
            self.kinds = kinds

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.count, self.pool, self.filled = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 17, np.uint32), 0

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where each word's ids are among first and count."""
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        known, out = self.known, np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            at = known.get(word)
            if at is None:
                ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.shown))]
                at = known[word] = len(known)
                while at >= len(self.first):
                    self.first, self.count = np.concatenate([self.first, self.first]), np.concatenate([self.count, self.count])
                while self.filled + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool, self.pool])
                self.first[at], self.count[at] = self.filled, len(ids)
                self.pool[self.filled : self.filled + len(ids)] = ids
                self.filled += len(ids)
            out[i] = at
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none) and each text's number of ids."""
        if self.by_words:
            easy = self.easy(texts)
            if easy.all():
                return self.encode_words(texts)
            ids, sizes = self.encode_words(pc.if_else(pa.array(easy), texts, ""))
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(~easy):
                parts[i] = self.encode_whole(texts[i].as_py())
        else:
            parts = [self.encode_whole(t) for t in texts.to_pylist()]
        return np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.uint32), np.array(list(map(len, parts)), np.int64)

    def encode_whole(self, text: str | None) -> np.ndarray:
        return np.array(self.whole.encode(text or "", add_special_tokens=False).ids, np.uint32)

    def easy(self, texts: pa.Array) -> np.ndarray:
        """Texts of Latin-1 characters without any special token's string."""
        data, offsets = bytes_of(texts)
        beyond = np.concatenate([[0], np.cumsum(data >= 0xC4, dtype=np.int64)])
        easy = beyond[offsets[1:]] == beyond[offsets[:-1]]
        for s in self.special:
            easy &= ~pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        return easy

    def encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        import pandas as pd

        data, offsets = bytes_of(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        low, kind = LOWER[data], self.kinds[data]
        lead = np.flatnonzero(data >= 0xC2)  # of two-byte characters
        second = data[lead + 1]
        kind[lead] = kind[lead + 1] = self.kinds[(data[lead] & 3) << 6 | second & 63]
        capital = (data[lead] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        low[lead[capital] + 1] += 0x20
        begins = np.ones(n + 1, bool)  # a word, or white space, begins here
        begins[1:n] = (kind[1:] != kind[:-1]) | ((kind[1:] == 2) & (data[1:] & 0xC0 != 0x80))
        begins[offsets] = True
        # an apostrophe that begins a word takes some endings with it
        ends = np.zeros(n + 1, bool)
        ends[offsets] = True
        quote = np.flatnonzero((low == 39) & begins[:-1])
        wide = np.concatenate([low, np.zeros(2, np.uint8)])
        one, two = wide[quote + 1], wide[np.minimum(quote + 2, n + 1)]
        inside = ~ends[quote + 1]
        single = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = inside & ~single & ~ends[np.minimum(quote + 2, n)] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        begins[quote[single | double] + 1] = False
        begins[quote[single] + 2] = True
        begins[quote[double] + 3] = True
        at = np.flatnonzero(begins)
        starts, stops = at[:-1], at[1:]
        word = kind[starts] != 0
        starts, lengths = starts[word], (stops - starts)[word]
        of, distinct = pd.factorize(hash_spans(low, starts, lengths, fold=False)[0])
        first = np.empty(len(distinct), np.int64)
        first[of[::-1]] = np.arange(len(starts))[::-1]
        raw = low.tobytes()
        place = self.places([raw[a : a + m] for a, m in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)])[of]
        counts = self.count[place]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(self.first[place] - total[:-1], counts) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit hashes: in each level keys try for a place of their own among twice as many bits, those that
    meet others go on; a key's slot is the number of bits set before its own."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        counts = np.unpackbits(bits).reshape(-1, 64).sum(1, dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h1 + h2 * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(h1):
            if len(sizes) == 64:
                raise ValueError("two keys have the same 128-bit hash")
            size = -(-2 * len(h1) // 64) * 64
            at = cls.place(h1, h2, len(sizes), size)
            counts = np.bincount(at, minlength=size)
            parts.append(np.packbits(counts == 1))
            sizes.append(size)
            again = counts[at] > 1
            h1, h2 = h1[again], h2[again]
        return cls(sizes, np.concatenate([*parts, np.zeros(0, np.uint8)]))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each key's slot; of a key that wasn't there any slot, or -1."""
        out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = base + self.place(h1[left], h2[left], level, size)
            hit = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            own, word = at[hit], at[hit] >> 6
            bits = np.unpackbits(self.bits.reshape(-1, 8)[word], axis=1)
            out[left[hit]] = self.before[word] + (bits * (np.arange(64) < (own & 63)[:, None])).sum(1)
            left = left[~hit]
            base += size
        return out


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix(h2 ^ (h1 * MULT)) >> np.uint64(32)).astype(np.uint32)


#: What an index file says of each run of one key's documents in one shard: which shard, which document of it is the first, how many ids come before it there, how many documents and ids the run has.
RUN = ["shard", "doc", "start", "docs", "ids"]


def write_index(path: str, h1: np.ndarray, h2: np.ndarray, runs: np.ndarray) -> int:
    """An index file of runs [n, 5], sorted by (h1, h2, shard). Returns the number of keys."""
    new = np.ones(len(h1), bool)
    new[1:] = (np.diff(h1) != 0) | (np.diff(h2) != 0)
    at = np.flatnonzero(new)
    k1, k2 = h1[at], h2[at]
    own = PerfectHash.of(k1, k2)
    slot = own.slots(k1, k2)
    marks, order = np.zeros(len(at), np.uint32), np.empty(len(at), np.int64)
    marks[slot] = fingerprint(k1, k2)
    order[slot] = np.arange(len(at))
    counts = np.diff(np.append(at, len(h1)))[order]
    first = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(at[order] - first[:-1], counts) + np.arange(len(h1))
    head = json.dumps({"sizes": own.sizes, "keys": len(at), "runs": len(h1)}).encode()
    fs, where = opened(path)
    own_copy = f"{where}.{uuid.uuid4().hex}"  # a second run of a task never cuts the file short that another reads
    with fs.open_output_stream(own_copy) as f:
        f.write(MAGIC + len(head).to_bytes(8, "little") + head)
        for x in (own.bits, marks, first, runs[rows].T):
            f.write(np.ascontiguousarray(x).tobytes())
    fs.move(own_copy, where)
    return len(at)


class Index:
    """An index file, read once."""

    def __init__(self, path: str):
        fs, where = opened(path)
        with fs.open_input_file(where) as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{path} isn't an index file")
        n = int.from_bytes(data[8:16], "little")
        head, at = json.loads(data[16 : 16 + n]), 16 + n
        parts = []
        for kind, count in ((np.uint8, sum(head["sizes"]) // 8), (np.uint32, head["keys"]), (np.int64, head["keys"] + 1), (np.int64, 5 * head["runs"])):
            parts.append(np.frombuffer(data, kind, count, at))
            at += count * np.dtype(kind).itemsize
        self.hash, self.marks, self.first = PerfectHash(head["sizes"], parts[0]), parts[1], parts[2]
        self.runs = parts[3].reshape(5, -1)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each run of each key that is there: which key of those asked for, and the run's place."""
        slot = self.hash.slots(h1, h2)
        ok = slot >= 0
        ok[ok] = self.marks[slot[ok]] == fingerprint(h1[ok], h2[ok])
        asked, slot = np.flatnonzero(ok), slot[ok]
        counts = self.first[slot + 1] - self.first[slot]
        total = np.cumsum(counts)
        return np.repeat(asked, counts), np.repeat(self.first[slot] - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)


def hashed(key: str) -> list:
    return [F.xxhash64(F.col(key).cast("string")).alias("h1"), F.xxhash64(F.lit("key"), F.col(key).cast("string")).alias("h2")]


class TokenFiles:
    """A folder of token files and their index, and the table of its shards (shard, file, docs, ids, base)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.shards = spark.read.parquet(f"{self.path}/shards")
        about = json.loads(spark.read.text(f"{self.path}/about").first()[0])
        self.width, self.buckets = about["width"], about["buckets"]

    def find(self, keys: DataFrame, key_col: str) -> DataFrame:
        """(key, shard, doc, start, docs, ids) of each run of documents of each key that the files hold: start counts the ids before it in all files. A row a
        run, so equal keys asked twice are answered twice; keys that aren't there, but for one of 2**32, have no row."""
        path, buckets = self.path, self.buckets
        kind = keys.schema[key_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, index = None, None
            for batch in batches:
                at = batch.column("bucket").to_numpy()
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else ():
                    if at[part[0]] != bucket:
                        bucket = at[part[0]]
                        index = Index(f"{path}/index/{bucket:06d}.mph")
                    h1, h2 = (batch.column(c).to_numpy()[part].view(np.uint64) for c in ("h1", "h2"))
                    asked, runs = index.find(h1, h2)
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(part[asked])), *(pa.array(x) for x in index.runs[:, runs])], ["key", *RUN])
            tidy()

        asked = keys.select(F.col(key_col).alias("key"), *hashed(key_col)).withColumn("bucket", F.pmod("h1", F.lit(buckets)))
        dealt = asked.repartition(min(partitions(self.spark), buckets), "bucket").sortWithinPartitions("bucket")
        found = dealt.mapInArrow(run, f"key {kind}, shard long, doc long, start long, docs long, ids long")
        return found.join(self.shards.select("shard", "base", "file"), "shard").select("key", "shard", "file", "doc", F.col("start").alias("at"), (F.col("base") + F.col("start")).alias("start"), "docs", "ids")

    def read(self, keys: DataFrame, key_col: str) -> DataFrame:
        """(key, start, n_tokens, ids) of each document of each key: how many ids all files hold before it, how many it has, and its ids as little-endian
        unsigned 32-bit integers. Only the ids of these documents are read, neighbours at once."""
        path, width, kind = self.path, self.width, keys.schema[key_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            file, payload, sizes = None, None, None
            for batch in batches:
                names = pc.dictionary_encode(batch.column("file"))
                of = names.indices.to_numpy()
                for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1) if len(of) else ():
                    if names.dictionary[of[part[0]]].as_py() != file:
                        file = names.dictionary[of[part[0]]].as_py()
                        fs, where = opened(f"{path}/ids/{file}")
                        payload, sizes = fs.open_input_file(f"{where}.ids"), fs.open_input_file(f"{where}.len")
                    doc, at, start, docs, ids = (batch.column(c).to_numpy()[part] for c in ("doc", "at", "start", "docs", "ids"))
                    i = 0
                    while i < len(part):  # neighbours, about 4 MB at a time
                        j = i + 1
                        while j < len(part) and at[j] == at[j - 1] + ids[j - 1] and at[j] + ids[j] - at[i] < 1 << 20:
                            j += 1
                        n = int(ids[i:j].sum())
                        own = np.frombuffer(payload.read_at(n * width, int(at[i]) * width), f"<u{width}").astype("<u4")
                        if (docs[i:j] == 1).all():
                            lengths = ids[i:j]
                        else:  # a key's several documents: their lengths are in the file beside
                            lengths = np.concatenate([np.frombuffer(sizes.read_at(8 * int(m), 8 * int(d)), np.int64) for d, m in zip(doc[i:j], docs[i:j], strict=True)])
                        before = np.cumsum(lengths) - lengths
                        offsets = np.append(before, n) * 4
                        kept = batch.column("key").take(pa.array(np.repeat(part[i:j], docs[i:j])))
                        raw = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own)])
                        # a run's first document is where the index says
                        firsts = np.repeat(start[i:j] - before[np.cumsum(docs[i:j]) - docs[i:j]], docs[i:j])
                        yield pa.RecordBatch.from_arrays([kept, pa.array(firsts + before), pa.array(lengths), raw.cast(pa.binary())], ["key", "start", "n_tokens", "ids"])
                        i = j
            tidy()

        found = self.find(keys, key_col).select("key", "file", "doc", "at", "start", "docs", "ids")
        dealt = found.repartition(partitions(self.spark), "file").sortWithinPartitions("file", "at")
        return dealt.mapInArrow(run, f"key {kind}, start long, n_tokens long, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int | None = 1, shard_ids: int = 1 << 25, bucket: int = BUCKET) -> TokenFiles:
    """Writes the ids of all documents, in ascending order of their ids (null first; rows of one id by their texts' hash), each followed by `end` (unless None), and their index.

    tokenizer_path: a file of the tokenizers library that each executor can open; no special tokens are added, and their strings inside a text are handled as the library does by default. path: a
    folder that the driver and all executors see: files of about `shard_ids` ids (a longer document is in one) in `ids`, an index file for about `bucket` keys in `index`, a table of shards in `shards`. A file
    that a lost task wrote is named by none of them. Null and empty texts have no ids but `end`; ids may be of any type that casts to a string, and repeated or null; equal ids of very
    many rows are dealt over tasks and shards; a very long text is encoded alone; an empty table gives no files and an empty index; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    path = path.rstrip("/")
    kind = docs.schema[id_col].dataType.simpleString()
    width = Encoder(tokenizer_path).width
    if end is not None and end >= 1 << (8 * width):
        raise ValueError("the end id is beyond the vocabulary's width")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = per_worker(("ids", tokenizer_path), lambda: Encoder(tokenizer_path))
        task = TaskContext.get()
        name, shard, out, sizes, doc, start = "", task.partitionId() << 24, None, None, 0, 0
        fs, where = opened(f"{path}/ids")
        for batch in pieces_of(batches, 1, min(STRETCH, shard_ids)):
            if not batch.num_rows:
                continue
            ids, counts = encoder.encode(batch.column(1))
            if end is not None:
                ids = np.insert(ids, np.cumsum(counts), end)
                counts = counts + 1
            if out is None:
                name = f"{task.partitionId():06d}-{shard & 0xFFFFFF:06d}-{uuid.uuid4().hex[:12]}"
                out, sizes = fs.open_output_stream(f"{where}/{name}.ids"), fs.open_output_stream(f"{where}/{name}.len")
            out.write(np.ascontiguousarray(ids.astype(f"<u{width}")).tobytes())
            sizes.write(counts.astype("<i8").tobytes())
            starts = start + np.cumsum(counts) - counts
            # a row for each run of one key
            key = batch.column(0)
            same = np.zeros(len(key), bool)
            if len(key) > 1:
                same[1:] = pc.fill_null(pc.equal(key[1:], key[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(key[1:]).to_numpy(zero_copy_only=False) & pc.is_null(key[:-1]).to_numpy(zero_copy_only=False))
            at = np.flatnonzero(~same)
            n_docs, n_ids = np.diff(np.append(at, len(key))), np.add.reduceat(counts, at)
            columns = [pa.array(np.full(len(at), shard)), pa.array([name] * len(at), pa.string()), key.take(pa.array(at)), pa.array(doc + at), pa.array(starts[at]), pa.array(n_docs), pa.array(n_ids)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "file", "key", "doc", "start", "docs", "ids"])
            doc, start = doc + len(key), start + int(counts.sum())
            if start >= shard_ids:
                out.close()
                sizes.close()
                out, doc, start, shard = None, 0, 0, shard + 1
        if out is not None:
            out.close()
            sizes.close()
        tidy()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def full() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            own = table["bucket"][0].as_py()
            h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            n = write_index(f"{path}/index/{own:06d}.mph", h1, h2, np.stack([table[c].to_numpy() for c in RUN], axis=1))
            return pa.RecordBatch.from_arrays([pa.array([own]), pa.array([n])], ["bucket", "keys"])

        for batch in batches:
            at = batch.column("bucket").to_numpy()
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else ():
                if waiting and waiting[0].column("bucket")[0].as_py() != at[part[0]]:
                    yield full()
                    waiting.clear()
                waiting.append(batch.slice(part[0], len(part)))
        if waiting:
            yield full()
        tidy()

    scratch = Scratch(spark, "tokenfiles")
    fs, where = opened(path)
    for part in ("ids", "index"):
        fs.create_dir(f"{where}/{part}", recursive=True)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    ranged = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), "key", "h", "row").sortWithinPartitions("key", "h", "row")
    runs = scratch.put(ranged.select("key", "text").mapInArrow(write, f"shard long, file string, key {kind}, doc long, start long, docs long, ids long"), "runs")
    shards = runs.groupBy("shard", "file").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"))
    # a row a file of about 64 MB, in one task
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards.withColumn("base", F.coalesce(before, F.lit(0).cast("long"))).write.mode("overwrite").parquet(f"{path}/shards")
    buckets = max(1, -(-runs.count() // bucket))
    placed = runs.select(*hashed("key"), *RUN).withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    dealt = placed.repartition(min(partitions(spark), buckets), "bucket").sortWithinPartitions("bucket", "h1", "h2", "shard", "doc")
    dealt.mapInArrow(index, "bucket long, keys long").write.mode("overwrite").parquet(f"{path}/buckets")
    spark.createDataFrame([(json.dumps({"width": width, "buckets": buckets}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return TokenFiles(spark, path)
