"""Tokenised pairs: boundaries, special tokens, truncation, label masks, padding and inspection rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDS = "array<int>"
COLUMNS = tuple(f"{s}_{k}" for s in ("chosen", "rejected") for k in ("input_ids", "attention_mask", "labels")) + ("prompt_input_ids", "prompt_attention_mask")


@dataclass(frozen=True)
class TokenizerSpec:
    """encode: text to ids as a Column, or, with `python`, a function of a list of texts that runs on Arrow batches."""

    name: str = "char"
    bos: int | None = None
    eos: int | None = None
    pad: int | None = None
    model_max_length: int = 2048
    chat_template: str | None = None
    bos_token: str | None = None
    eos_token: str = "</s>"
    encode: Callable[[Column], Column] | None = None
    python: Callable[[list[str]], list[list[int]]] | None = None

    def ready(self) -> TokenizerSpec:
        """With the defaults: the end token pads, and a length without bounds becomes 2,048."""
        from dataclasses import replace

        return replace(self, pad=self.eos if self.pad is None else self.pad, model_max_length=2048 if self.model_max_length > 100_000 else self.model_max_length)


def char_codec(c: Column) -> Column:
    """Code points."""
    return F.when(c == "", F.array().cast(IDS)).otherwise(F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("int")))


def word_codec(buckets: int = 1 << 15) -> Callable[[Column], Column]:
    """Words at spaces, hashed."""
    return lambda c: F.when(F.trim(c) == "", F.array().cast(IDS)).otherwise(F.transform(F.split(F.trim(c), " +"), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


#: Ids of merged tokens: this and their rank. As code points they are for private use, so a text's own are replaced.
MERGED = 0xF0000


def read_merges(table: DataFrame, most: int = 8192) -> list[tuple[str, str]]:
    """The pairs of a table of (left, right, rank), lowest rank first; raises beyond `most`, as all pairs go into the plan."""
    rows = table.select("left", "right", "rank").orderBy("rank").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pairs; use a tokenizer of `python` instead")
    return [(r.left, r.right) for r in rows]


def _merge_steps(merges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(pair, token) as characters, a token being one. Each part must be one character or made before: then merging pair by pair equals merging the lowest
    rank first over and over."""
    if len(merges) > 0x1FFFE - 1:
        raise ValueError("more pairs than private code points")
    known: dict[str, str] = {}
    steps = []
    for rank, pair in enumerate(merges):
        parts = [known.get(p, p) for p in pair]
        if any(len(p) != 1 for p in parts):
            raise ValueError(f"pair {rank} of {pair} has a part that no earlier pair makes")
        if "".join(pair) in known:
            raise ValueError(f"pair {rank} of {pair} makes a token that is there")
        known["".join(pair)] = chr(MERGED + rank)
        steps.append(("".join(parts), known["".join(pair)]))
    return steps


def _replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    if not steps:
        return c
    table = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in steps])
    return F.aggregate(table, c, lambda text, step: F.replace(text, step[0], step[1]))


def merge_codec(merges: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """Byte-pair merging over characters, without words in between, so that a prompt's end and a response's beginning may merge. A token is one
    character, and a step of the fold replaces a pair everywhere, from the left; ids are code points, and MERGED and the rank for what was merged."""
    steps = _merge_steps(merges)
    return lambda c: char_codec(_replaced(F.regexp_replace(c, "[\\x{F0000}-\\x{10FFFF}]", "\ufffd"), steps))


def merge_decode(merges: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """Ids back to text."""
    steps = [(b, a) for a, b in reversed(_merge_steps(merges))]
    return lambda ids: _replaced(F.array_join(F.transform(ids, _character), ""), steps)


def _character(code: Column) -> Column:
    """A code point as text, beyond what F.char gives."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def char_tokenizer(bos: int | None = None, eos: int | None = 999) -> TokenizerSpec:
    return TokenizerSpec("char", bos, eos, encode=char_codec)


def needs_chatml_setup(template: str, known: set[str], pad: str | None) -> bool:
    return "<|im_start|>" in template and (not {"<|im_start|>", "<|im_end|>"} <= known or pad is None)


def encoded(df: DataFrame, texts: dict[str, Column], spec: TokenizerSpec) -> DataFrame:
    """Adds the ids of each text."""
    if spec.encode is not None:
        return df.withColumns({n: spec.encode(c) for n, c in texts.items()})
    base, at = df.withColumns(texts), len(df.columns)
    kept, names, python = list(df.columns), list(texts), spec.python

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [pa.array(python([t or "" for t in batch.column(at + i).to_pylist()]), pa.list_(pa.int32())) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *new], names=[*kept, *names])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([*df.schema.fields, *[StructField(n, ArrayType(IntegerType())) for n in texts]])
    return base.mapInArrow(run, schema)


def boundary(prompt: Column, full: Column) -> Column:
    """Where the response begins: after the prompt's ids, or one earlier if a merge changed the last of them."""
    n = F.size(prompt)
    return F.when(F.slice(full, F.lit(1), F.greatest(n, F.lit(0))) == prompt, n).otherwise(n - 1)


def head(a: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))


def tail(a: Column, n: Column) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def tokenise_pairs(df: DataFrame, spec: TokenizerSpec, *, max_length: int = 512, max_prompt_length: int = 128, truncation: str = "keep_end", pad_label: int = -100) -> DataFrame:
    """Adds COLUMNS to rows of prompt, chosen and rejected texts.

    Prompt and response are encoded together; prompts that differ by more than one token or one in length raise. A limit of 0 with
    keep_end keeps everything, as a slice from -0 does.
    """
    if truncation not in ("keep_start", "keep_end"):
        raise ValueError(f"unknown truncation mode {truncation!r}")
    text = {s: F.coalesce(F.col(s), F.lit("")) for s in ("prompt", "chosen", "rejected")}
    df = encoded(df, {"__p": text["prompt"], "__fc": F.concat(text["prompt"], text["chosen"]), "__fr": F.concat(text["prompt"], text["rejected"])}, spec)
    out = df
    for s in "cr":
        out = out.withColumn(f"__b{s}", boundary(F.col("__p"), F.col(f"__f{s}")))
    out = out.withColumns({f"__p{s}": head(F.col(f"__f{s}"), F.col(f"__b{s}")) for s in "cr"} | {f"__a{s}": tail(F.col(f"__f{s}"), F.col(f"__b{s}")) for s in "cr"})
    n_c, n_r = F.size("__pc"), F.size("__pr")
    shared = F.least(n_c, n_r)
    differ = F.size(F.filter(F.zip_with(head(F.col("__pc"), shared), head(F.col("__pr"), shared), lambda a, b: a != b), lambda x: x))
    bad = F.raise_error(F.lit("the prompts of chosen and rejected differ by more than their last token")).cast(IDS)
    out = out.withColumn("__p", F.when((differ > 1) | (F.abs(n_c - n_r) > 1), bad).otherwise(head(F.col("__p"), shared)))
    if spec.bos is not None:
        starts = lambda c: F.coalesce(F.get(c, F.lit(0)) == spec.bos, F.lit(False))
        out = out.withColumns({n: F.when(starts(F.col(n)), F.col(n)).otherwise(F.concat(F.array(F.lit(spec.bos)), F.col(n))) for n in ("__p", "__pc", "__pr")})
    if spec.eos is not None:
        ends = lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)) == spec.eos, F.lit(False))
        out = out.withColumns({n: F.when(ends(F.col(n)), F.col(n)).otherwise(F.concat(F.col(n), F.array(F.lit(spec.eos)))) for n in ("__ac", "__ar")})
    out = out.withColumn("__longer", F.greatest(F.size("__ac"), F.size("__ar")))
    over = lambda n: F.size(n) + F.col("__longer") > max_length
    if truncation == "keep_start":
        cut = lambda n: head(F.col(n), F.lit(max_prompt_length))
    elif max_prompt_length == 0:
        cut = F.col
    else:
        cut = lambda n: F.slice(F.col(n), F.greatest(F.size(n) - max_prompt_length, F.lit(0)) + 1, F.lit(max_prompt_length))
    out = out.withColumns({n: F.when(over(n), cut(n)).otherwise(F.col(n)) for n in ("__p", "__pc", "__pr")})
    out = out.withColumns({f"__a{s}": F.when(over(f"__p{s}"), head(F.col(f"__a{s}"), F.lit(max_length - max_prompt_length))).otherwise(F.col(f"__a{s}")) for s in "cr"})
    ones = lambda c: F.transform(c, lambda _: F.lit(1))
    final = {"prompt_input_ids": F.col("__p"), "prompt_attention_mask": ones(F.col("__p"))}
    for side, s in (("chosen", "c"), ("rejected", "r")):
        ids = F.concat(f"__p{s}", f"__a{s}")
        final[f"{side}_input_ids"] = ids
        final[f"{side}_attention_mask"] = ones(ids)
        final[f"{side}_labels"] = F.concat(F.transform(f"__p{s}", lambda _: F.lit(pad_label)), f"__a{s}")
    return out.withColumns(final).drop(*[c for c in out.columns if c.startswith("__")])


def tokenise_encoder_decoder(df: DataFrame, spec: TokenizerSpec, *, max_length: int = 512, max_prompt_length: int = 128, max_target_length: int = 128) -> DataFrame:
    """Prompt and responses encoded apart and cut; the labels are the responses' ids."""
    df = encoded(df, {"__p": F.col("prompt"), "__c": F.col("chosen"), "__r": F.col("rejected")}, spec)
    p = head(F.col("__p"), F.lit(max_prompt_length))
    labels = {f"{s}_labels": head(F.col(f"__{s[0]}"), F.lit(max_target_length)) for s in ("chosen", "rejected")}
    return df.withColumns({"prompt_input_ids": p, "prompt_attention_mask": F.transform(p, lambda _: F.lit(1)), **labels}).drop("__p", "__c", "__r")


def pad_batches(df: DataFrame, batch: str, row_id: str, *, pad: int = 0, pad_label: int = -100) -> DataFrame:
    """(batch, row, side, input_ids, attention_mask, labels): both sides padded on the right to the batch's longest; side 0, chosen, before 1.
    A window holds one batch."""
    longest = F.greatest(F.size("chosen_input_ids"), F.size("rejected_input_ids"))
    df = df.withColumn("__n", F.max(longest).over(Window.partitionBy(batch)))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("__n") - F.size(c)))
    sides = [df.select(batch, row_id, F.lit(i).alias("side"), fill(f"{s}_input_ids", pad).alias("input_ids"), fill(f"{s}_attention_mask", 0).alias("attention_mask"), fill(f"{s}_labels", pad_label).alias("labels")) for i, s in enumerate(("chosen", "rejected"))]
    return sides[0].unionByName(sides[1])


def real_labels(labels: Column, pad_label: int = -100) -> Column:
    return F.filter(labels, lambda x: x != pad_label)


#: Fixed value: the fields of an inspection row.
INSPECTION = (
    "sample_index split tokenization_source prompt chosen rejected prompt_input_ids prompt_attention_mask chosen_input_ids chosen_attention_mask chosen_labels "
    "rejected_input_ids rejected_attention_mask rejected_labels decoded_prompt decoded_chosen_full decoded_rejected_full decoded_chosen_target decoded_rejected_target "
    "prompt_length chosen_length rejected_length chosen_target_length rejected_target_length"
).split()


def inspection_rows(df: DataFrame, decode: Callable[[Column], Column] | None = None, pad_label: int = -100, *, split: str = "train", source: str = "online", index: str = "row_id") -> DataFrame:
    """INSPECTION of tokenised pairs: where a row is from, its texts, ids, decoded texts and lengths. decode: the char codec's by default.
    Columns that the table hasn't are null."""
    decode = decode or (lambda ids: F.array_join(F.transform(ids, lambda i: F.char(i)), ""))
    out: dict[str, Column] = {"sample_index": F.col(index) if index in df.columns else F.lit(None).cast("long"), "split": F.lit(split), "tokenization_source": F.lit(source)}
    out |= {"decoded_prompt": decode(F.col("prompt_input_ids")), "prompt_length": F.size("prompt_input_ids")}
    for s in ("chosen", "rejected"):
        target = real_labels(F.col(f"{s}_labels"), pad_label)
        out |= {f"decoded_{s}_full": decode(F.col(f"{s}_input_ids")), f"decoded_{s}_target": decode(target), f"{s}_length": F.size(f"{s}_input_ids"), f"{s}_target_length": F.size(target)}
    return df.select(*[(out[n] if n in out else F.col(n) if n in df.columns else F.lit(None).cast("string")).alias(n) for n in INSPECTION])


def pack(df: DataFrame, ids: str, row_id: str, length: int, eos: int) -> DataFrame:
    """(block, input_ids): all rows' ids in row_id order, eos behind each, cut into blocks of `length`; the last one may be shorter. Row ids are whole
    numbers. Places are sums within runs of 4,096 row ids and of the runs before, so no task sees all rows."""
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.concat(F.col(ids), F.array(F.lit(eos))).alias("a")).withColumns({"n": F.size("a").cast("long"), "run": F.expr("id div 4096")})
    runs = rows.groupBy("run").agg(F.sum("n").alias("total"))
    runs = runs.select("run", (F.sum("total").over(Window.orderBy("run")) - F.col("total")).alias("base"))
    within = Window.partitionBy("run").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("n").over(within)).join(runs, "run").withColumn("start", F.expr("base + upto - n"))
    piece = lambda b: F.struct(b.alias("block"), F.greatest(F.col("start"), b * length).alias("at"), F.slice("a", (F.greatest(b * length - F.col("start"), F.lit(0)) + 1).cast("int"), F.lit(length) - F.greatest(F.col("start") - b * length, F.lit(0)).cast("int")).alias("ids"))
    cut = rows.select(F.explode(F.transform(F.sequence(F.expr(f"start div {length}"), F.expr(f"(start + n - 1) div {length}")), piece)).alias("p")).select("p.*")
    packed = cut.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda s: s["ids"])).alias("input_ids"))
    return packed.select("block", "input_ids")
