"""Inputs derived from the supplied tables: transcripts, dialogues, scored pairs and sequences of logits, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = "\n\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dialogues(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, messages): user and assistant turns up to the last assistant turn."""
    turns = table(spark, d, "conversations").filter(F.col("role").isin("user", "assistant"))
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn")))
    rows = turns.groupBy(F.col("conv_id").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"), last.alias("last")).filter("last is not null")
    kept = F.filter("m", lambda x: x["turn"] <= F.col("last"))
    return rows.select("row_id", F.transform(kept, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def raw_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, chosen, rejected) transcripts; some ids carry a defect each, so that every reason occurs."""
    who = lambda m: F.when(m["role"] == "user", "Human").otherwise("Assistant")
    text = lambda a: F.array_join(F.transform(a, lambda m: F.concat(F.lit(BLANK), who(m), F.lit(": "), m["content"])), "")
    n = F.size("messages")
    rows = dialogues(spark, d).select("row_id", text(F.slice("messages", F.lit(1), F.greatest(n - 1, F.lit(0)))).alias("prefix"), F.try_element_at("messages", F.lit(-1))["content"].alias("answer"))
    answer = F.concat(F.lit(f"{BLANK}Assistant: No. "), F.col("answer"))
    rejected = (
        F.when(F.col("row_id") % 8 == 1, F.concat("prefix", F.lit(f"{BLANK}Assistant: ")))
        .when(F.col("row_id") % 8 == 2, F.concat(F.col("prefix"), answer, F.lit(f"{BLANK}Human: And then?")))
        .when(F.col("row_id") % 8 == 3, F.concat(F.lit(f"{BLANK}Human: Something else"), F.col("prefix"), answer))
        .when(F.col("row_id") % 8 == 4, F.concat("prefix", F.lit(f"{BLANK}Human: No.")))
        .otherwise(F.concat(F.col("prefix"), answer))
    )
    return rows.select("row_id", F.concat("prefix", F.lit(f"{BLANK}Assistant: "), "answer").alias("chosen"), rejected.alias("rejected"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, microbatch, c, r, rc, rr): stand-ins for log-probabilities."""
    price, key, cust = F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(key.cast("long").alias("pair_id"), F.expr("o_orderkey div 64").cast("long").alias("microbatch"), (-(price % 97) / 10).alias("c"), (-(price * 7 % 89) / 10).alias("r"), (-(cust % 53) / 10).alias("rc"), (-(key % 47) / 10).alias("rr"))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """(seq, logits, labels): eight positions each; every fifth label is masked."""
    row = F.struct(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("label")).cast("int").alias("y"))
    rows = table(spark, d, "embeddings").groupBy(F.expr("vec_id div 8").alias("seq")).agg(F.array_sort(F.collect_list(row)).alias("a"))
    return rows.select("seq", F.transform("a", lambda s: s["x"]).alias("logits"), F.transform("a", lambda s: s["y"]).alias("labels"))


SQL_TURNS = """
t AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')),
l AS (SELECT conv_id, max(turn) AS last_turn FROM t WHERE role = 'assistant' GROUP BY conv_id),
k AS (SELECT t.*, last_turn FROM t JOIN l USING (conv_id) WHERE turn <= last_turn),
dialogues AS (SELECT conv_id AS row_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM k GROUP BY conv_id)
"""
SQL_RAW = (
    SQL_TURNS
    + r""",
p AS (SELECT conv_id AS row_id,
             coalesce(string_agg(chr(10) || chr(10) || CASE role WHEN 'user' THEN 'Human' ELSE 'Assistant' END || ': ' || text, '' ORDER BY turn) FILTER (WHERE turn < last_turn), '') AS prefix,
             max(CASE WHEN turn = last_turn THEN text END) AS answer FROM k GROUP BY conv_id),
q AS (SELECT row_id, prefix, answer, chr(10) || chr(10) || 'Assistant: No. ' || answer AS other, chr(10) || chr(10) AS nn FROM p),
raw AS (SELECT row_id, prefix || nn || 'Assistant: ' || answer AS chosen,
        CASE row_id % 8 WHEN 1 THEN prefix || nn || 'Assistant: '
                        WHEN 2 THEN prefix || other || nn || 'Human: And then?'
                        WHEN 3 THEN nn || 'Human: Something else' || prefix || other
                        WHEN 4 THEN prefix || nn || 'Human: No.'
                        ELSE prefix || other END AS rejected FROM q)
"""
)
#: The characters of Python's white space, for RE2.
SQL_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_squash(e: str) -> str:
    return f"trim(regexp_replace({e}, '{SQL_WS}+', ' ', 'g'))"


def sql_parse(e: str) -> str:
    split = rf"string_split(regexp_replace({e}, '(?:^|\n\n)(Human|Assistant): ', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:]"
    message = f"{{'role': CASE WHEN string_split(p, chr(2))[1] = 'Human' THEN 'user' ELSE 'assistant' END, 'content': {sql_strip('string_split(p, chr(2))[2]')}}}"
    return f"list_filter(list_transform({split}, lambda p: {message}), lambda m: m.content <> '')"


SQL_PARSED = (
    SQL_RAW
    + f""",
parsed AS (SELECT row_id, {sql_parse('chosen')} AS c, {sql_parse('rejected')} AS r, contains(chosen, 'Human:') AND contains(chosen, 'Assistant:') AND contains(rejected, 'Human:') AND contains(rejected, 'Assistant:') AS is_raw FROM raw),
counted AS (SELECT *, len(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[1:i] = r[1:i])) AS n FROM parsed),
judged AS (SELECT *, CASE WHEN len(c) = 0 OR len(r) = 0 THEN 'E3' WHEN n = 0 THEN 'E4' WHEN n >= len(c) OR n >= len(r) THEN 'E5'
                          WHEN c[n].role <> 'user' THEN 'E6' WHEN len(c) - n <> 1 OR len(r) - n <> 1 THEN 'E7'
                          WHEN c[n + 1].role <> 'assistant' OR r[n + 1].role <> 'assistant' THEN 'E8' END AS error FROM counted WHERE is_raw)
"""
)
SQL_SCORED = """
scored AS (SELECT o_orderkey AS pair_id, o_orderkey // 64 AS microbatch, -(o_totalprice % 97) / 10 AS c, -((o_totalprice * 7) % 89) / 10 AS r,
                  -(o_custkey % 53) / 10.0::DOUBLE AS rc, -(o_orderkey % 47) / 10.0::DOUBLE AS rr FROM orders)
"""
SQL_SEQUENCES = """
rows AS (SELECT vec_id // 8 AS seq, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, CASE WHEN vec_id % 5 = 0 THEN -100 ELSE label END AS y FROM embeddings),
shifted AS (SELECT seq, vec_id, x, lead(y) OVER (PARTITION BY seq ORDER BY vec_id) AS y FROM rows),
logps AS (SELECT seq, vec_id, y, x[y + 1] - (list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x)))))) AS logp FROM shifted WHERE y IS NOT NULL AND y <> -100)
"""
