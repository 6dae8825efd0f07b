"""Preference pairs: transcripts to canonical pairs, reasons for rejection, prompts, messages and column keep-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.text import has_turn, is_raw_pair, let, parse_transcript

#: Why a pair of transcripts is rejected, in the order in which the tests apply.
REASONS = {
    "E2": "HH transcript does not contain any 'Human:' or 'Assistant:' turns.",
    "E3": "HH transcript does not contain any non-empty turns.",
    "E4": "HH chosen/rejected transcripts must share a non-empty common prefix.",
    "E5": "HH chosen/rejected transcripts must each contain a divergent assistant response.",
    "E6": "HH prompt prefix must end with a user turn before the compared assistant responses.",
    "E7": "HH preprocessing expects exactly one final assistant response in chosen/rejected suffixes.",
    "E8": "HH chosen/rejected suffixes must each contain one assistant message.",
}
#: Fixed value: the columns that training reads.
STANDARD_COLUMNS = ("messages", "chosen", "rejected", "prompt", "completion", "label")
DIALOGUE = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


def is_dialogue(df: DataFrame, name: str) -> bool:
    """Whether a column holds messages: known from the schema, not by row."""
    if name not in df.columns:
        return False
    kind = df.schema[name].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {"role", "content"} <= set(kind.elementType.names)


def is_string(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, T.StringType)


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading messages two dialogues share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["content"] == y["content"]), F.lit(False)))
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, n).otherwise(F.least(first - 1, n)).cast("int")


def judged(chosen: Column, rejected: Column) -> Column:
    """struct<raw, c, r, n, error>: whether both are transcripts, their turns, how many leading turns they share, and a key of
    REASONS (null if valid)."""

    def of(s: Column) -> Column:
        n, c, r = s["n"], F.size(s["c"]), F.size(s["r"])
        error = F.when(~has_turn(chosen), "E2").when(c == 0, "E3").when(~has_turn(rejected), "E2").when(r == 0, "E3")
        error = error.when(n == 0, "E4").when((n >= c) | (n >= r), "E5")
        error = error.when(F.get(s["c"], n - 1)["role"] != "user", "E6").when((c - n != 1) | (r - n != 1), "E7")
        error = error.when((F.get(s["c"], n)["role"] != "assistant") | (F.get(s["r"], n)["role"] != "assistant"), "E8")
        raw = is_raw_pair(chosen, rejected)
        return F.struct(raw.alias("raw"), s["c"].alias("c"), s["r"].alias("r"), n.alias("n"), F.when(raw, error).alias("error"))

    turns = F.struct(parse_transcript(chosen).alias("c"), parse_transcript(rejected).alias("r"))
    return let(let(turns, lambda s: F.struct(s["c"].alias("c"), s["r"].alias("r"), common_prefix(s["c"], s["r"]).alias("n"))), of)


def validation_error(df: DataFrame, name: str = "error") -> DataFrame:
    """The rows with why each pair isn't valid; null for valid pairs and for rows that are no transcripts."""
    return df.withColumn(name, judged(F.col("chosen"), F.col("rejected"))["error"])


def error_histogram(df: DataFrame) -> DataFrame:
    """(error, message, n) of the rejected pairs, the most common first."""
    message = F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("error"))
    counts = validation_error(df.select("chosen", "rejected")).filter("error is not null").groupBy("error").count()
    return counts.select("error", message.alias("message"), F.col("count").alias("n")).orderBy(F.desc("n"), "error")


def canonical_pairs(df: DataFrame) -> DataFrame:
    """The valid transcript pairs alone, as dialogues prompt, chosen and rejected; other columns stay. normalise() also keeps strings
    that are no transcripts."""
    return _converted(df, False)


def _converted(df: DataFrame, others: bool) -> DataFrame:
    """others: rows that are no transcripts stay too, with their strings in chosen_text and rejected_text and no dialogues."""

    def of(j: Column) -> Column:
        part = lambda c, start, size: F.slice(j[c], start, size)
        parts = [part("c", F.lit(1), j["n"]).alias("prompt"), part("c", j["n"] + 1, F.lit(1)).alias("chosen"), part("r", j["n"] + 1, F.lit(1)).alias("rejected")]
        if not others:
            return F.when(j["raw"] & j["error"].isNull(), F.struct(*parts))
        parts = [F.when(j["raw"], p).alias(n) for p, n in zip(parts, ("prompt", "chosen", "rejected"), strict=True)]
        texts = [F.when(~j["raw"], F.col(c)).alias(f"{c}_text") for c in ("chosen", "rejected")]
        return F.when(~j["raw"] | j["error"].isNull(), F.struct(*parts, *texts))

    made = df.withColumn("__pair", let(judged(F.col("chosen"), F.col("rejected")), of))
    # null arrays explode to no row, so the pair is computed once and no filter is pushed below it
    kept = made.select("*", F.explode(F.array_compact(F.array("__pair"))).alias("__p"))
    names = ("prompt", "chosen", "rejected", *(("chosen_text", "rejected_text") if others else ()))
    return kept.withColumns({c: F.col(f"__p.{c}") for c in names}).drop("__pair", "__p")


def normalise(df: DataFrame) -> DataFrame:
    """A source's pairs in canonical form. A table of dialogues passes as it is. In a table of strings, transcripts are parsed and invalid ones
    go; all other rows stay, unchanged, with their strings in chosen_text and rejected_text (null for transcripts), as one column can't hold
    both dialogues and strings; their dialogues are null."""
    return _converted(df, True) if is_string(df, "chosen") and is_string(df, "rejected") else df


def derive_prompt(df: DataFrame) -> DataFrame:
    """Without a dialogue prompt: all but the last chosen message, and the last one of either side."""
    for name in ("chosen", "rejected"):
        if not is_dialogue(df, name):
            raise ValueError(f"{name} must be a dialogue: an array of role and content")
    if is_dialogue(df, "prompt"):
        return df
    last = lambda c: F.slice(c, F.greatest(F.size(c), F.lit(1)), F.lit(1))
    head = F.slice("chosen", F.lit(1), F.greatest(F.size("chosen") - 1, F.lit(0)))
    return df.withColumns({"prompt": head, "chosen": last("chosen"), "rejected": last("rejected")})


def to_messages(df: DataFrame) -> DataFrame:
    """A messages column from the first shape that the schema has. Of strings, rows that are no transcripts have no messages and go, as there is
    nothing to render; a table without any of these shapes comes back as it is."""
    if is_dialogue(df, "messages"):
        return df
    if is_string(df, "chosen"):
        raw = F.contains("chosen", F.lit("Human:")) & F.contains("chosen", F.lit("Assistant:"))
        return df.filter(raw).withColumn("messages", parse_transcript(F.col("chosen")))
    if is_dialogue(df, "prompt") and is_dialogue(df, "chosen"):
        return df.withColumn("messages", F.concat("prompt", "chosen"))
    if is_dialogue(df, "chosen"):
        return df.withColumn("messages", F.col("chosen"))
    if is_dialogue(df, "prompt") and is_dialogue(df, "completion"):
        return df.withColumn("messages", F.concat("prompt", "completion"))
    return df


def keep_columns(df: DataFrame, wanted: list[str] | tuple[str, ...]) -> DataFrame:
    """The wanted columns in the table's order; one of prompt, chosen and rejected brings all three, if all are there."""
    if not wanted:
        raise ValueError("no columns to keep")
    triple = {"prompt", "chosen", "rejected"}
    keep = set(wanted) | (triple if triple & set(wanted) and triple <= set(df.columns) else set())
    return df.select([c for c in df.columns if c in keep])


def rename_rendered(df: DataFrame) -> DataFrame:
    """text_prompt, text_chosen, text_rejected become prompt, chosen, rejected."""
    names = ("prompt", "chosen", "rejected")
    if missing := [f"text_{c}" for c in names if f"text_{c}" not in df.columns]:
        raise ValueError(f"not rendered: {missing}")
    return df.drop(*names).withColumnsRenamed({f"text_{c}": c for c in names})
