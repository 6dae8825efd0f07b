"""Token counts by the method of distinct pre-tokens.

A byte-level BPE never merges across pre-tokens, so a document has as many tokens as its pre-tokens have pieces. Each
block of documents is split once into (document, pre-token, frequency) rows, kept as arrays over the block's distinct pre-tokens. Those
of all blocks meet, ranged and sorted by pre-token; the pieces of each distinct one are counted once, and the counts are joined to
the blocks' pre-tokens as these stream by, then to their documents' frequencies, and summed. No token ids are made. What is shuffled
are distinct pre-tokens of blocks and compressed frequencies, never a row for each pre-token of each document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, partitions, per_worker, pieces_of, tidy

#: Fixed value: how the byte-level vocabulary splits a text (public_tokenizers.PATTERN).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are split at a time, and pre-tokens that are encoded at a time.
STRETCH, BATCH = 1 << 18, 4096


class Splitter:
    """Splits texts into pre-tokens as the vocabulary's file says."""

    def __init__(self, path: str):
        import json

        import regex

        self.find = regex.compile(PATTERN).findall
        self.safe = regex.compile(r"(?<=\S)\s")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only a byte-level vocabulary without a normaliser splits into independent pre-tokens this way")
        special = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("added tokens that take white space or need word ends aren't handled")
        self.special = [t["content"] for t in special]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if special else None

    def stretches(self, text: str) -> Iterator[str]:
        """The text in parts that split independently: no pre-token has white space behind other characters, so a part may end
        before it."""
        at = 0
        while len(text) - at > 2 * STRETCH and (m := self.safe.search(text, at + STRETCH)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """A text's pre-tokens with their frequencies, and how many special strings it holds; each is one token and parts the text."""
        found, special, parts = Counter(), 0, [text]
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            special = len(parts) - 1
        for part in parts:
            for stretch in self.stretches(part):
                found.update(self.find(stretch))
        return found, special


def encoder(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def packed(values: np.ndarray) -> bytes:
    """int32 values as zstd frames, bytes of one weight together."""
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int32)
    n = int.from_bytes(data[:8], "little")
    flat = pa.Codec("zstd").decompress(data[8:], decompressed_size=4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(4, -1).T).view(np.int32)[:, 0]


def split_blocks(rows: DataFrame, kind: str, path: str, block_bytes: int) -> DataFrame:
    """A row per block of rows (id, text): its documents' ids, bytes and special strings, how many distinct pre-tokens each has, which (by
    steps from one code to the next) and how often, and the block's distinct pre-tokens in ascending order, which is that of their codes."""
    schema = f"block long, ids array<{kind}>, n_bytes array<long>, special array<long>, sizes array<int>, codes binary, freqs binary, pieces array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        splitter = per_worker(("splitter", path), lambda: Splitter(path))
        block = TaskContext.get().partitionId() << 32
        for batch in pieces_of(batches, 1, block_bytes):
            known: dict[str, int] = {}
            codes, freqs, special = [], [], []
            for text in batch.column(1):
                found, n = splitter.frequencies(text.as_py() or "")
                codes.append(np.fromiter((known.setdefault(x, len(known)) for x in found), np.int32, len(found)))
                freqs.append(np.fromiter(found.values(), np.int32, len(found)))
                special.append(n)
            pieces = sorted(known)
            rank = np.empty(len(pieces), np.int32)
            rank[np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))] = np.arange(len(pieces), dtype=np.int32)
            counts = np.array(list(map(len, codes)), np.int32)
            flat = rank[np.concatenate(codes)] if codes else np.zeros(0, np.int32)
            by = np.argsort(np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32 | flat)
            flat, often = flat[by], np.concatenate(freqs)[by] if freqs else flat
            starts = (np.cumsum(counts) - counts)[counts > 0]
            steps = np.diff(flat, prepend=np.int32(0))
            steps[starts] = flat[starts]
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            out = [pa.array([block], pa.int64()), one(batch.column(0)), one(sizes), one(pa.array(special, pa.int64())), one(pa.array(counts)),
                   pa.array([packed(steps)], pa.binary()), pa.array([packed(often)], pa.binary()), one(pa.array(pieces, pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=["block", "ids", "n_bytes", "special", "sizes", "codes", "freqs", "pieces"])
            block += 1
            del known, codes, freqs, pieces, out
        tidy()

    return rows.mapInArrow(run, schema)


def count_pieces(own: DataFrame, path: str) -> DataFrame:
    """(block, first, n): the tokens of a stretch of a block's distinct pre-tokens, which begins with `first`, from rows (piece, block) in ranges
    sorted by piece. A pre-token is encoded once, or once a task if it has very many rows; by its range, even one that all blocks hold is
    dealt over many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = per_worker(("tokenizer", path), lambda: encoder(path))
        last, tokens = None, 0
        for batch in pieces_of(batches, 0):
            if not batch.num_rows:
                continue
            which = pc.dictionary_encode(batch.column(0))
            distinct = which.dictionary.to_pylist()
            known = [tokens] if distinct[0] == last else []
            n = known + [len(e) for i in range(len(known), len(distinct), BATCH) for e in tokenizer.encode_batch_fast(distinct[i : i + BATCH], add_special_tokens=False)]
            last, tokens = distinct[-1], n[-1]
            n = np.array(n, np.int32)[which.indices.to_numpy()]
            block = batch.column(1).to_numpy()
            by = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.diff(block[by], prepend=block[by[0]] - 1))
            parts = [packed(x) for x in np.split(n[by], starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(block[by[starts]]), batch.column(0).take(pa.array(by[starts])), pa.array(parts, pa.binary())], ["block", "first", "n"])
        tidy()

    return own.mapInArrow(run, "block long, first string, n binary")


def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their pre-tokens, in order of the codes, to rows (id, n_bytes, n_tokens)."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, n_bytes, special, sizes = (batch.column(c)[i].values for c in range(4))
            steps, often = (unpacked(batch.column(c)[i].as_py()) for c in (4, 5))
            n = np.concatenate([np.zeros(0, np.int64), *map(unpacked, batch.column(6)[i].as_py() or ())])
            edges = np.concatenate([[0], np.cumsum(sizes.to_numpy())])
            run = np.cumsum(steps, dtype=np.int64)  # from one document to the next it starts anew
            before = np.concatenate([[0], run])[edges[:-1]]
            codes = run - np.repeat(before, sizes.to_numpy())
            sums = np.concatenate([[0], np.cumsum(n[codes] * often)])[edges]
            yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(np.diff(sums).astype(np.int64) + special.to_numpy())], ["id", "n_bytes", "n_tokens"])
    tidy()


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, block_bytes: int = 32 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    tokenizer_path: a byte-level `tokenizers` file that each executor can open. Null texts count as empty (0 tokens); null ids are
    ids; equal rows give equal rows; a very long text is a block of its own, split a stretch at a time; nothing is ranked, so there are no ties;
    an empty table gives none; other columns, whatever their names, are not read. Strings of special tokens inside a
    text are handled as the library does by default: each is one token. A block is about `block_bytes` of text.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = scratch.put(split_blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), kind, tokenizer_path, block_bytes), "blocks")
    own = blocks.select(F.explode("pieces").alias("piece"), "block")
    ranged = own.repartitionByRange(partitions(docs.sparkSession), "piece", "block").sortWithinPartitions("piece")
    priced = count_pieces(ranged, tokenizer_path)
    # Ranges are stretches of a block's pre-tokens too, so in order of their beginnings they give the counts in order of the codes.
    per_block = priced.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "n"))), lambda x: x["n"]).alias("n"))
    joined = blocks.drop("pieces").join(per_block.withColumnRenamed("block", "__block"), F.col("block") == F.col("__block"), "left")
    columns = ["ids", "n_bytes", "special", "sizes", "codes", "freqs", "n"]
    out = joined.select(*columns).mapInArrow(sum_up, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
