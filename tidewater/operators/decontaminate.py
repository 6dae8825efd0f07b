"""Containment anti-join: rows go that hold a benchmark text as a substring, after lower-casing and squashing white space."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewater.functions.text import squash


def docstring(prompt: Column) -> Column:
    """The text between triple double quotes, the second such if there are two; else between triple single quotes. Raises for
    other counts."""
    parts = F.split(prompt, '"""')
    quotes = F.size(parts) - 1
    single = F.split(prompt, "'''")
    odd = F.raise_error(F.lit("a prompt needs one or two docstrings")).cast("string")
    return F.when(quotes == 2, parts[1]).when(quotes == 4, F.get(parts, F.lit(3))).when((quotes == 0) & (F.size(single) == 3), F.get(single, F.lit(1))).otherwise(odd)


def normalised(text: Column) -> Column:
    return squash(F.lower(text))


def patterns(benchmark: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """Distinct, non-empty normalised patterns, without allowed ones."""
    df = benchmark.filter(~F.coalesce(F.col(text_col).isin(*allow), F.lit(False))) if allow else benchmark
    return df.select(normalised(F.col(text_col)).alias("pattern")).filter("length(pattern) > 0").distinct()


#: Characters of patterns that one automaton holds: it takes about a hundred bytes for each.
AUTOMATON_CHARS = 1 << 20


def holding(texts: DataFrame, found: list[str]) -> DataFrame:
    """The __id of rows of (__id, __text) that hold a pattern, by one scan of an Aho-Corasick automaton over Arrow batches."""
    kind = texts.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for x in found:
            automaton.add_word(x, 1)
        automaton.make_automaton()
        for batch in batches:
            hit = [next(automaton.iter(t.as_py()), None) is not None for t in batch.column(1)]
            yield batch.select([0]).filter(pa.array(hit, pa.bool_()))

    return texts.select("__id", "__text").mapInArrow(run, f"__id {kind}")


def contaminated_ids(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "row_id", text_col: str = "text", pattern_col: str = "text", allow: tuple[str, ...] = (), automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Ids of rows that hold a pattern.

    Patterns of at most automaton_chars together are found by one scan and no shuffle of texts. Beyond that, a pattern of five words or more is
    found through the rarest of its inner three-word runs, which must be a run of words of a row that holds it: only hashes of runs
    that are some pattern's anchor leave a scan of the texts; shorter patterns go through as many automata as they need, a scan each.
    """
    found = patterns(benchmark, pattern_col, allow).withColumn("words", F.split("pattern", " "))
    texts = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__text")).filter("__text is not null")
    total = found.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    if total == 0:
        return docs.select(id_col).limit(0)
    scans = found.select("pattern") if total <= automaton_chars else found.filter(F.size("words") < 5).select("pattern")
    numbered = scans.withColumn("part", F.expr(f"pmod(xxhash64(pattern), {max(1, -(-total // automaton_chars))})"))
    ids: DataFrame | None = None
    for (part,) in sorted(numbered.select("part").distinct().collect()):
        own = [r.pattern for r in numbered.filter(F.col("part") == part).select("pattern").collect()]  # about automaton_chars
        hits = holding(texts, own).distinct()
        ids = hits if ids is None else ids.unionByName(hits)
    if total > automaton_chars:
        runs = lambda words, n: F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(3))))
        long = found.filter(F.size("words") >= 5).select("pattern", F.slice("words", F.lit(2), F.size("words") - 2).alias("inner"))
        inner = long.select("pattern", F.explode(F.array_distinct(runs(F.col("inner"), F.size("inner")))).alias("run"))
        words = F.split("__text", " ")
        own = texts.select("__id", F.explode(F.array_distinct(F.transform(F.array(words), lambda w: runs(w, F.size(w)))[0])).alias("run"))
        frequency = own.join(inner.select("run").distinct(), "run").groupBy("run").count()
        ranked = inner.join(frequency, "run").groupBy("pattern").agg(F.min(F.struct("count", "run"))["run"].alias("run"))
        candidates = own.join(ranked, "run").select("__id", "pattern")
        hits = candidates.join(texts, "__id").filter(F.contains("__text", F.col("pattern"))).select("__id")
        ids = hits if ids is None else ids.unionByName(hits)
    return ids.distinct().select(F.col("__id").alias(id_col))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "row_id", text_col: str = "text", **more) -> DataFrame:
    """The rows that hold no pattern."""
    return docs.join(contaminated_ids(docs, benchmark, id_col=id_col, text_col=text_col, **more), id_col, "left_anti")


class Dropped:
    """How many rows decontamination takes, counted by the action that runs the plan anyway; report() waits for the first one."""

    def __init__(self) -> None:
        self.before, self.kept = Observation(), Observation()

    @staticmethod
    def _read(counts: Observation) -> int:
        try:
            return counts.get.get("n") or 0
        except Py4JJavaError:  # the plan was cut down to nothing, the count with it: there is no row
            return 0

    def report(self) -> dict[str, float]:
        n, m = self._read(self.before), self._read(self.kept)
        return {"n_before": n, "n_dropped": n - m, "percent": 100 * (n - m) / n if n else 0.0}


def decontaminate_observed(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "row_id", text_col: str = "text", **more) -> tuple[DataFrame, Dropped]:
    """The rows that hold no pattern, and what will tell how many do."""
    dropped, n = Dropped(), F.count(F.lit(1)).alias("n")
    ids = contaminated_ids(docs, benchmark, id_col=id_col, text_col=text_col, **more)
    return docs.observe(dropped.before, n).join(ids, id_col, "left_anti").observe(dropped.kept, n), dropped


def dropped_report(before: DataFrame, after: DataFrame) -> dict[str, float]:
    n, m = before.count(), after.count()
    return {"n_before": n, "n_dropped": n - m, "percent": 100 * (n - m) / n if n else 0.0}
