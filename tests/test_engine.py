"""The engine's own operators: golden rows, and plain Python versions on random inputs."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewater.config import BetaDPOConfig, DataArguments, PreferenceConfig, config_class, load, read_yaml
from tidewater.functions import losses as L
from tidewater.functions import scoring as S
from tidewater.functions import template as T
from tidewater.functions.text import parse_transcript, squash, strip
from tidewater.operators import decontaminate as D
from tidewater.operators import mixing as M
from tidewater.operators import pairs as P
from tidewater.operators import stats as G
from tidewater.operators import tokenise as K
from tidewater.operators.render import apply_template
from tidewater.sources.cache import TokenCache, fingerprint, stable_hash
from tidewater.sources.catalog import Catalog
from tidewater.sources.sinks import append_margins, read_margins, write_samples

H, A = "\n\nHuman: ", "\n\nAssistant: "
PROMPT = f"{H}Hi{A}Hello!{H}How?"


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def pair(spark, chosen, rejected):
    return spark.createDataFrame([(1, chosen, rejected)], "row_id long, chosen string, rejected string")


def test_white_space(spark):
    text = "".join(chr(c) for c in range(1, 0x3001) if chr(c).isspace())
    assert value(spark, strip(F.lit(text + "a b" + text))) == "a b"
    assert value(spark, squash(F.lit(f" a{text}b "))) == "a b"


def plain_parse(t):
    found = list(re.finditer(r"(?:^|\n\n)(Human|Assistant): ", t))
    ends = [*[m.start() for m in found[1:]], len(t)][: len(found)]
    turns = [("user" if m[1] == "Human" else "assistant", t[m.end() : e].strip()) for m, e in zip(found, ends, strict=True)]
    return [x for x in turns if x[1]]


def test_parse_random_transcripts(spark):
    rng = random.Random(1)
    bits = ["Human: ", "Assistant: ", "\n\n", "\n", "hello", " ", "é", " ", "Human:", "x y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", parse_transcript(F.col("t")).alias("m")).collect()
    assert {r.i: [tuple(m) for m in r.m] for r in rows} == {i: plain_parse(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    ("chosen", "rejected", "error"),
    [
        (f"{PROMPT}{A}Fine", f"{PROMPT}{A}Bad", None),
        ("no transcript", f"{PROMPT}{A}x", None),
        ("x Human:y Assistant:z", f"{PROMPT}{A}x", "E2"),
        (f"{H}{A}", f"{PROMPT}{A}x", "E3"),
        (f"{H}Other{A}Fine", f"{PROMPT}{A}Bad", "E4"),
        (f"{PROMPT}{A}Fine", f"{PROMPT}{A}", "E5"),
        (f"{H}a{A}b{A}c", f"{H}a{A}b{A}d", "E6"),
        (f"{PROMPT}{A}Fine{H}More", f"{PROMPT}{A}Bad", "E7"),
        (f"{H}a{H}b{A}", f"{H}a{H}c{A}", "E8"),
    ],
)
def test_reasons(spark, chosen, rejected, error):
    assert P.validation_error(pair(spark, chosen, rejected)).first().error == error


def test_canonical_pair(spark):
    row = P.canonical_pairs(pair(spark, f"{PROMPT}{A}Fine", f"{PROMPT}{A}Bad")).first()
    assert [tuple(m) for m in row.prompt] == [("user", "Hi"), ("assistant", "Hello!"), ("user", "How?")]
    assert (tuple(row.chosen[0]), tuple(row.rejected[0]), row.row_id) == (("assistant", "Fine"), ("assistant", "Bad"), 1)


def test_histogram_adds_up(spark):
    rows = [(f"{PROMPT}{A}Fine", f"{PROMPT}{A}Bad"), (f"{PROMPT}{A}Fine", f"{PROMPT}{A}"), (f"{PROMPT}{A}Fine", f"{PROMPT}{A}"), (f"{H}Other{A}a", f"{PROMPT}{A}b")]
    df = spark.createDataFrame(rows, "chosen string, rejected string")
    assert [(r.error, r.n) for r in P.error_histogram(df).collect()] == [("E5", 2), ("E4", 1)]
    assert P.canonical_pairs(df).count() == 1


def dialogue(spark, **columns):
    kind = "array<struct<role:string,content:string>>"
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} {kind}" for c in columns))


def test_messages_and_prompts(spark):
    u, a = ("user", "q"), ("assistant", "r")
    df = dialogue(spark, chosen=[u, a], rejected=[u, ("assistant", "s")])
    row = P.derive_prompt(df).first()
    assert (row.prompt, row.chosen, row.rejected) == ([u], [a], [("assistant", "s")])
    assert P.to_messages(dialogue(spark, prompt=[u], completion=[a])).first().messages == [u, a]
    assert P.to_messages(spark.range(1)).columns == ["id"]  # none of the shapes: as it is
    with pytest.raises(ValueError, match="sft needs"):
        apply_template(spark.range(1), T.chatml(), "sft")
    with pytest.raises(ValueError):
        apply_template(df, T.chatml(), "other")
    assert P.keep_columns(P.derive_prompt(df).withColumn("x", F.lit(1)), ["prompt"]).columns == ["chosen", "rejected", "prompt"]


def test_templates(spark):
    df = dialogue(spark, messages=[("user", " q "), ("assistant", "r")])
    text = lambda t, task="sft": apply_template(df, t, task).first().text
    assert text(T.chatml(), "generation") == "<|im_start|>system\n<|im_end|>\n<|im_start|>user\n q <|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n<|im_start|>assistant\n"
    assert text(T.header()) == "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nq<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nr<|eot_id|>"
    with pytest.raises(Exception, match="empty dialogue"):
        apply_template(dialogue(spark, messages=[]), T.chatml(), "sft").collect()


def printed(spark, source, messages=(("user", " q "), ("assistant", "r")), **constants):
    from tidewater.functions.language import compiled

    return compiled_value(spark, compiled(source, F.col("messages"), constants), messages)


def compiled_value(spark, c, messages):
    return spark.createDataFrame([([tuple(m) for m in messages],)], "messages array<struct<role:string,content:string>>").select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain\n", "plain"),
        ("{% for m in messages %}{{ m.role }}{% if not loop.last %}, {% endif %}{% endfor %}", "user, assistant"),
        ("a\n  {% if true %}\nb\n  {% endif %}\nc", "a\nb\nc"),
        ("a \n {%- if true -%} \n b {%- endif %}", "ab"),
        ("{{ messages[0].content | trim }}{{ messages[-1]['content'] }}", "qr"),
        ("{% set x = 'a' %}{% for m in messages %}{% set x = x + 'b' %}{{ x }}{% endfor %}{{ x }}", "ababa"),
        ("{% set x = 'a' %}{% if messages | length == 2 %}{% set x = 'b' %}{% elif false %}{% set x = 'c' %}{% endif %}{{ x }}", "b"),
        ("{% for m in messages[1:] %}{{ loop.index ~ m.role }}{% endfor %}", "1assistant"),
        ("{% for m in messages[-1:] %}{{ m.role }}{% endfor %}{% for m in messages[5:] %}{{ m.role }}{% endfor %}", "assistant"),
        ("{% for m in messages %}{% for o in messages %}{{ loop.index0 }}{% endfor %}{{ loop.index }}{% endfor %}", "011012"),
        ("{{ '}}' }}{{ \"it's\" }}{{ 'a\\nb' }}{# {{ gone }} #}", "}}it'sa\nb"),
        ("{{ 'x' if eos_token is defined and eos_token else 'y' }}{{ 'z' if other is not defined }}", "xz"),
        ("{{ 7 % 4 }}{{ 1 + 2 - 4 }}{% if 'us' in messages[0].role and 'q' not in 'abc' %}!{% endif %}", "3-1!"),
        ("{{ messages[0].content.strip() | upper }}{{ 'A' | lower }}", "Qa"),
    ],
)
def test_template_language(spark, source, text):
    assert printed(spark, source, eos_token="</s>") == text


@pytest.mark.parametrize(
    "source",
    ["{% macro x() %}{% endmacro %}", "{{ other }}", "{{ messages }}", "{% for m in messages %}", "{% endif %}", "{{ 'a' + 1 }}", "{{ messages | tojson }}", "{{ 'a", "{% if true %}{% set x = 'a' %}{% endif %}{{ x }}", "{% set ns.x = 1 %}", "{{ 'a' 'b' }}", "{{ strftime('x') }}"],
)
def test_template_language_raises_before_it_runs(source):
    from tidewater.functions.language import compiled

    with pytest.raises(ValueError):
        compiled(source, F.col("messages"), {})


def test_template_errors_and_choice(spark):
    source = "{% if messages[0].role != 'user' %}{{ raise_exception('a user begins') }}{% endif %}ok"
    assert printed(spark, source) == "ok"
    with pytest.raises(Exception, match="a user begins"):
        printed(spark, source, [("assistant", "r")])
    assert printed(spark, "{% for m in messages %}{{ m.role + m.content }}{% endfor %}!", [("a", None), ("b", "c")]) == "bc!" and printed(spark, "{% for m in messages %}x{% endfor %}", []) == ""
    assert T.chosen_template("{{ 'a' }}", "{{ 'b' }}").name == "settings" and T.chosen_template(None, "{{ 'b' }}").source == "{{ 'b' }}" and T.chosen_template(None).source == T.DEFAULT
    with pytest.raises(ValueError):
        T.Template("broken", "{% for %}")


def test_mixing_and_samples(spark, tmp_path):
    for name, n in (("a", 10), ("b", 7)):
        for split in ("train", "test"):
            spark.range(n).select(F.col("id").alias("row_id"), F.lit("c").alias("chosen"), F.lit(1).alias("unused")).write.parquet(f"{tmp_path}/{name}/{split}.parquet")
    catalog = Catalog(spark, str(tmp_path))
    catalog.register("a", f"{tmp_path}/a")
    catalog.register("b", f"{tmp_path}/b")
    out = M.mix(catalog, {"a": 0.29, "b": 1.0})
    assert (out["train"].count(), out["test"].count()) == (9, 17) and "unused" not in out["train"].columns
    assert sorted(r.row_id for r in out["train"].filter("source = 'a'").collect()) == [0, 1]
    for bad in (lambda: M.mix(catalog, {"a": -1.0}), lambda: M.mix(catalog, {"a": 1.0}, configs=["x", "y"]), lambda: M.mix(catalog, {"a": 1.0}, splits=("dev",)), lambda: M.mix(catalog, {})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        catalog.load("nowhere", "train")
    df = spark.range(50).withColumnRenamed("id", "row_id")
    assert {r.row_id for r in M.k_sample(df, 5, 3).collect()} == set(random.Random(3).sample(range(50), 5))
    assert M.k_sample(df, 0, 3).count() == 0
    kept = M.weighted_sample(df.withColumns({"w": (F.col("row_id") < 20).cast("double"), "g": F.lit(1)}), "w", 0.3, keys=("g",)).filter("kept")
    assert kept.count() == 15 and kept.filter("w = 0").count() == 0
    assert [r.row_id for r in Catalog.numbered(df.repartition(3).withColumnRenamed("row_id", "k"), ["k"]).orderBy("k").collect()] == list(range(50))


def test_numbers_of_a_wide_table(spark):
    """Numbers are 0 to n - 1 without gaps, in order, whatever the exchanges do: several partitions, ties, wide rows, columns without type."""
    n = 400_000
    wide = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 1000).alias("tie"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 2).alias("text"), F.lit(None).alias("none"), F.lit(1).alias("a.b"))
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            out = Catalog.numbered(wide, ["k"])
            assert out.columns == [*wide.columns, "row_id"]
            assert out.filter("row_id <> k").count() == 0 and out.select("row_id").distinct().count() == n
            assert M.prefix_sample(out, 0.5).count() == n // 2
            ties = Catalog.numbered(wide, ["tie"])
            got = ties.groupBy("tie").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b"), F.count("*").alias("n"))
            assert got.filter(f"a <> tie * {n // 1000} or b <> a + n - 1").count() == 0
            assert ties.agg(F.sum(F.xxhash64("row_id", "k").cast("decimal(38,0)"))).first() == ties.agg(F.sum(F.xxhash64("row_id", "k").cast("decimal(38,0)"))).first()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Catalog.numbered(wide.limit(0), ["k"]).count() == 0


def test_containment(spark):
    docs = [(1, "The  Quick brown FOX jumps"), (2, "nothing here"), (3, "xquick brown foxy"), (4, None), (5, "short one")]
    items = [("the quick Brown fox",), ("quick brown fox",), ("",), ("t o",)]
    df, bench = spark.createDataFrame(docs, "row_id long, text string"), spark.createDataFrame(items, "text string")
    want = {d for d, t in docs if t and any(p and p in " ".join(t.lower().split()) for p in (" ".join(i.lower().split()) for (i,) in items))}
    assert {r.row_id for r in D.contaminated_ids(df, bench).collect()} == want == {1, 3, 5}
    assert {r.row_id for r in D.decontaminate(df, bench).collect()} == {2, 4}
    assert value(spark, D.docstring(F.lit('a """x""" b """y"""'))) == "y"


def plain_tokenise(p, c, r, *, bos, eos, most, prompt_most, mode):
    """The char codec: prompts never merge with responses."""
    ids = lambda t: [ord(x) for x in t]
    prompt = ([bos] if bos is not None and (not p or ord(p[0]) != bos) else []) + ids(p)
    sides = [ids(x) + [eos] for x in (c, r)]
    longer = max(map(len, sides))
    if len(prompt) + longer > most:
        prompt = prompt[:prompt_most] if mode == "keep_start" else prompt[-prompt_most:]
    if len(prompt) + longer > most:
        sides = [s[: most - prompt_most] for s in sides]
    return prompt, [(prompt + s, [-100] * len(prompt) + s) for s in sides]


@pytest.mark.parametrize("mode", ["keep_start", "keep_end"])
@pytest.mark.parametrize("bos", [None, 1])
def test_tokenise(spark, mode, bos):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(0, n)))
    rows = [(i, text(30), text(20), text(20)) for i in range(60)]
    df = K.tokenise_pairs(spark.createDataFrame(rows, "row_id long, prompt string, chosen string, rejected string"), K.char_tokenizer(bos), max_length=32, max_prompt_length=8, truncation=mode)
    for r in df.collect():
        _, p, c, j = rows[r.row_id]
        prompt, (one, two) = plain_tokenise(p, c, j, bos=bos, eos=999, most=32, prompt_most=8, mode=mode)
        assert (r.prompt_input_ids, r.chosen_input_ids, r.chosen_labels, r.rejected_input_ids, r.rejected_labels) == (prompt, *one, *two)
        assert r.chosen_attention_mask == [1] * len(one[0])
    padded = K.pad_batches(df.withColumn("batch", F.col("row_id") % 4), "batch", "row_id").groupBy("batch").agg(F.count_distinct(F.size("input_ids")).alias("n")).collect()
    assert all(r.n == 1 for r in padded)
    with pytest.raises(ValueError):
        K.tokenise_pairs(df, K.char_tokenizer(), truncation="middle")


def test_arrow_tokenizer_and_boundary(spark):
    spec = K.TokenizerSpec("words", None, 0, python=lambda texts: [[len(w) for w in t.split()] for t in texts])
    df = spark.createDataFrame([("a bb", "cc ddd", " e")], "prompt string, chosen string, rejected string")
    row = K.tokenise_pairs(df, spec).first()
    assert row.chosen_input_ids == [1, 4, 3, 0] and row.chosen_labels == [-100, 4, 3, 0]
    assert row.rejected_input_ids == [1, 2, 1, 0]


def lse(x):
    m = max(x)
    return m + math.log(sum(math.exp(v - m) for v in x))


def test_sequence_scores(spark):
    logits = [[[0.1, 0.2, 0.7], [2.0, -1.0, 0.5], [0.0, 0.0, 0.0]]]
    df = spark.createDataFrame([(logits[0], [99, 1, -100]), (logits[0], [99, -100, -100])], "x array<array<double>>, y array<int>")
    got = [r.s for r in df.select(S.sequence_logp(F.col("x"), F.col("y"), average=True, clamp=False).alias("s")).collect()]
    assert got[0] == pytest.approx(0.2 - lse(logits[0][0])) and math.isnan(got[1])
    with pytest.raises(Exception, match="length"):
        df.select(S.sequence_logp(F.slice("x", 1, 2), F.col("y"))).collect()
    assert value(spark, S.log_sigmoid(F.lit(-800.0))) == -800.0
    assert value(spark, S.sanitise(F.lit(float("nan")))) == 0 and value(spark, S.sanitise(F.lit(float("-inf")))) == -1e4
    assert value(spark, S.step_of(F.lit(3.0), F.lit(2.0), F.lit(1.0))) == 1 and value(spark, S.step_of(F.lit(float("nan")), F.lit(2.0), F.lit(1.0))) == 0


def test_losses(spark):
    c, r, rc, rr = -1.0, -2.0, -1.5, -1.2
    cols = [F.lit(x) for x in (c, r, rc, rr)]
    ls = lambda x: -math.log1p(math.exp(-x))
    assert value(spark, L.simpo(*cols[:2], smoothing=0.1)["loss"]) == pytest.approx(-ls(1.0) * 0.9 - ls(-1.0) * 0.1)
    assert value(spark, L.margin_dpo(*cols)["loss"]) == pytest.approx(-ls(0.1 * ((c - rc) - (r - rr))))
    assert value(spark, L.margin_dpo(*cols, divergence="forward_kl")["loss"]) == pytest.approx(-ls(0.1 * (-math.exp(-(c - rc)) + math.exp(-(r - rr)))))
    a, b = (value(spark, L.epsilon_dpo(*cols, F.lit(1), smoothing=s)["loss"]) for s in (0.0, 0.3))
    assert a == pytest.approx(b)
    for bad in (lambda: L.simpo(*cols[:2], kind="x"), lambda: L.margin_dpo(*cols, divergence="x")):
        with pytest.raises(ValueError):
            bad()


def test_margins_by_step(spark, tmp_path):
    df = spark.createDataFrame([(i, i // 2, float(v)) for i, v in enumerate([10, 20, 30, 40])], "pair_id long, microbatch long, margin double")
    row = G.margin_summary(G.by_step(df), log_steps=2, sample=True).collect()
    assert len(row) == 1 and row[0].step == 2 and row[0].sample == [30.0, 40.0] and row[0].p10 == 31.0
    six = G.by_step(spark.createDataFrame([(i, i // 2, float(i + 1)) for i in range(6)], "pair_id long, microbatch long, margin double"), accumulation=3)
    assert G.margin_summary(six).first().batch_size == 6
    append_margins(G.margin_summary(six), str(tmp_path / "m"))
    assert read_margins(spark, str(tmp_path / "m")).first().epoch is None
    write_samples(spark.createDataFrame([("é",)], "t string"), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()[0] == '{"t":"é"}'


def test_running_statistics(spark):
    stats = spark.createDataFrame([(s, float(s), 1.0 + s) for s in (3, 1, 2)], "step long, mean double, std double")
    m, want = 0.0, []
    for s in (1, 2, 3):
        m = 0.9 * m + 0.1 * s
        want.append(m)
    assert [r["mean"] for r in G.running(stats, 0.9).orderBy("step").collect()] == pytest.approx(want)
    assert G.running(stats, 0.9, first=None).orderBy("step").first()["mean"] == 1.0
    path = G.beta_path(stats.select("step", F.col("mean").alias("mean_steps")), 0.1, 0.5).orderBy("step").collect()
    assert [r.beta for r in path] == pytest.approx([0.1, 0.1 / 1.5, 0.1 / 1.5 / 2.0])
    far = G.compare(stats, stats.withColumn("mean", F.col("mean") + F.when(F.col("step") == 2, 1).otherwise(0)), "step", ["mean", "std"]).collect()
    assert {r.name: r.n_far for r in far} == {"mean": 1, "std": 0}
    with pytest.raises(Exception, match="missing"):
        G.attach_reference(stats, stats.filter("step < 3").select("step", F.col("std").alias("rc")), "step").collect()


def test_stream_equals_fold(spark, tmp_path):
    from tidewater.streaming.running import running_stream

    stats = spark.createDataFrame([("k", s, float(s), 1.0) for s in range(1, 6)], "key string, step long, mean double, std double")
    stats.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = running_stream(spark.readStream.schema(stats.schema).parquet(str(tmp_path / "in")), "key", "step", "mean", "std", 0.9)
    q = stream.writeStream.format("memory").queryName("running").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [r["mean"] for r in spark.sql("select * from running order by step").collect()]
    assert got == pytest.approx([r["mean"] for r in G.running(stats.drop("key"), 0.9).orderBy("step").collect()])


def test_cache(spark, tmp_path):
    cache, calls = TokenCache(spark, str(tmp_path)), []
    build = lambda: calls.append(1) or spark.range(3).withColumnRenamed("id", "x")
    get = lambda m, **k: cache.build(build, m, trainer="t", split="train", required=["x"], **k)
    with pytest.raises(FileNotFoundError):
        get({"a": 1}, mode="reuse_only")
    assert get({"a": 1}).count() == 3 and get({"a": 1}, mode="reuse_only").count() == 3 and len(calls) == 1
    get({"a": 2}, mode="offline_only")
    get({"a": 2}, reuse=False)
    assert len(calls) == 3 and stable_hash({"b": 1, "a": 2}) == stable_hash({"a": 2, "b": 1})
    df = spark.range(9)
    assert fingerprint(df) == fingerprint(df.orderBy(F.desc("id"))) != fingerprint(spark.range(8))


def test_cache_publication(spark, tmp_path):
    """Two builders of one table, a failure between data and manifest, stale and incomplete folders, and the sweep."""
    cache, m = TokenCache(spark, str(tmp_path)), {"a": 1}
    path = cache.path("t", "train", m)
    get = lambda c=cache, build=None, **k: c.build(build or (lambda: spark.range(3).withColumnRenamed("id", "x")), m, trainer="t", split="train", required=["x"], **k)
    files = lambda: sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith((".", "_")))

    class Broken(TokenCache):
        def _staged(self, df, manifest, place):
            df.write.parquet(f"{place}/dataset")
            raise OSError("between data and manifest")

    with pytest.raises(OSError, match="between"):
        get(Broken(spark, str(tmp_path)))
    assert files() == []  # nothing was published or left
    with pytest.raises(FileNotFoundError):
        get(mode="reuse_only")

    first = []

    def slow():  # while this one builds, another builder publishes the same table, and someone begins to read it
        first.append(get())
        return spark.range(5).withColumnRenamed("id", "x")

    assert get(build=slow).count() == 3 and first[0].count() == 3  # the first one's files are still there
    assert not list((tmp_path / ".staging").iterdir()) and len({f.split("/")[2] for f in files()}) == 1

    for spoil in (lambda p: (p / "manifest.json").unlink(), lambda p: (p / "manifest.json").write_text('{"a": 2}'), lambda p: (p / "manifest.json").write_text('{"a"'), lambda p: [f.unlink() for f in p.glob(".manifest*")] + [__import__("shutil").rmtree(p / "dataset")]):
        spoil(tmp_path / "t" / "train" / path.rsplit("/", 1)[-1])
        for crc in (tmp_path / "t" / "train").rglob(".manifest*"):
            crc.unlink()
        before = files()
        with pytest.raises(FileNotFoundError):
            get(mode="reuse_only")
        assert files() == before  # not a thing was removed
        assert get().count() == 3 and get(mode="reuse_only").count() == 3
    stale = list((tmp_path / ".staging").iterdir())
    assert len(stale) == 4 and cache.sweep() == 0 and cache.sweep(-1) == 4 and get(mode="reuse_only").count() == 3
    with pytest.raises(FileNotFoundError, match="lacks"):
        cache.build(lambda: spark.range(1), {"b": 1}, trainer="t", split="train", required=["x"])


def test_prepare(spark, tmp_path):
    from tidewater.plans.prepare import log_samples, prepare

    rows = [(i, f"{PROMPT}{A}Fine {i}", f"{PROMPT}{A}Bad" if i % 3 else f"{PROMPT}{A}") for i in range(12)]
    for split in ("train", "test"):
        spark.createDataFrame(rows, "row_id long, chosen string, rejected string").coalesce(1).write.parquet(f"{tmp_path}/hh/{split}.parquet")
    catalog = Catalog(spark, str(tmp_path))
    catalog.register("hh", f"{tmp_path}/hh", format="transcript")
    data, spec = DataArguments({"hh": 0.5}), K.char_tokenizer()
    bench = spark.createDataFrame([("fine 1",)], "text string")
    out = prepare(catalog, f"{tmp_path}/cache", "epsilon_dpo", data, spec, T.chatml(), benchmark=bench)
    assert (out["train"].count(), out["test"].count()) == (3, 5)
    again = prepare(catalog, f"{tmp_path}/cache", "epsilon_dpo", data, spec, T.chatml(), PreferenceConfig(preprocessing_mode="reuse_only"), benchmark=bench)
    assert set(again["train"].columns) >= set(K.COLUMNS)
    with pytest.raises(FileNotFoundError):
        prepare(catalog, f"{tmp_path}/cache", "epsilon_dpo", data, spec, T.chatml(), PreferenceConfig(preprocessing_mode="reuse_only", max_length=99), benchmark=bench)
    assert log_samples(out["test"], f"{tmp_path}/log", 3) == 3 and spark.read.text(f"{tmp_path}/log").count() == 3
    row = spark.createDataFrame([([[1.0, 3.0], [5.0, 5.0]], [0, 1])], "x array<array<double>>, y array<int>").select(S.mean_logit(F.col("x"), F.col("y")).alias("m")).first()
    assert row.m == 2.0


def test_settings():
    text = "dataset_mixer:\n  a: 0.5\n  'b/c': 1\ndataset_splits:\n- train\n- test  # both\nauto_insert_empty_system_msg: false\n"
    args = load(DataArguments, text, ["--preprocessing_num_workers=4"])
    assert args.dataset_mixer == {"a": 0.5, "b/c": 1} and args.dataset_splits == ["train", "test"] and args.preprocessing_num_workers == 4 and not args.auto_insert_empty_system_msg
    assert load(PreferenceConfig, overrides=["--loss_type=a=b"]).loss_type == "a=b"
    assert read_yaml("x: [1, 2]\n")["x"] == [1, 2]
    for bad in (lambda: load(PreferenceConfig, overrides=["--beta=1", "--beta=2"]), lambda: BetaDPOConfig(rho=0), lambda: load(PreferenceConfig, "nothing: 1"), lambda: config_class("x"), lambda: DataArguments(dataset_dir="a", dataset_configs=["b"])):
        with pytest.raises(ValueError):
            bad()
    assert config_class("epsilon_dpo")().epsilon == 0.01


def test_queries_run(spark):
    from tidewater.plans import catalog

    for name in ("hh_error_histogram", "chat_render_chatml", "loss_alpha", "mix_prefix_sample", "flagship_summary"):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_normalise_keeps_rows_that_are_no_transcripts(spark):
    rows = [(1, f"{PROMPT}{A}Fine", f"{PROMPT}{A}Bad"), (2, f"{PROMPT}{A}Fine", f"{PROMPT}{A}"), (3, "plain", "text"), (4, None, "x")]
    out = {r.row_id: r for r in P.normalise(spark.createDataFrame(rows, "row_id long, chosen string, rejected string")).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1].chosen[0].content == "Fine" and out[1].chosen_text is None
    assert (out[3].chosen, out[3].chosen_text, out[3].rejected_text) == (None, "plain", "text") and out[4].rejected_text == "x"
    with pytest.raises(Exception, match="no dialogue"):
        apply_template(P.normalise(spark.createDataFrame(rows, "row_id long, chosen string, rejected string")), T.chatml(), "dpo").collect()
    done = dialogue(spark, prompt=[("user", "q")], chosen=[("assistant", "a")], rejected=[("assistant", "b")])
    assert P.normalise(done).collect() == done.collect()


def test_running_statistics_equal_a_plain_fold(spark):
    rng = random.Random(4)
    steps = sorted(rng.sample(range(1, 3000), 700))
    rows = [(k, s, rng.gauss(0, 1), rng.random()) for k in (0, 1) for s in steps]
    df = spark.createDataFrame(rows, "k int, step long, mean double, std double").repartition(5)
    for decay in (0.0, 0.05, 0.9, 0.999):
        for first in ((0.0, 1.0), None):
            want = {}
            for k in (0, 1):
                state = first
                for _, s, m, v in [r for r in rows if r[0] == k]:
                    state = (m, v) if state is None else tuple(decay * a + (1 - decay) * b for a, b in zip(state, (m, v), strict=True))
                    want[k, s] = state
            got = {(r.k, r.step): (r.mean, r.std) for r in G.running(df, decay, first=first, keys=("k",)).collect()}
            assert got.keys() == want.keys()
            assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for key in want for a, b in zip(got[key], want[key], strict=True))
    one = df.filter("k = 0")
    half = G.update_state(None, one.filter(f"step <= {steps[300]}"), 0.9)
    assert G.update_state(half, one.filter(f"step > {steps[300]}"), 0.9) == pytest.approx(G.update_state(None, one, 0.9))
    assert G.update_state((1.0, 2.0), one.limit(0), 0.9) == (1.0, 2.0)
    beta, want = 0.1, {}
    for _, s, m, _ in [r for r in rows if r[0] == 0]:
        want[s] = beta
        beta /= 1 + m * 0.01
    got = {r.step: r.beta for r in G.beta_path(one, 0.1, 0.01, mean="mean").collect()}
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in want)


def test_masked_beta_loss_equals_a_plain_batch(spark):
    rng = random.Random(5)
    rows = [(i, i // 10, *(rng.gauss(0, 2) for _ in range(4))) for i in range(60)]
    df = spark.createDataFrame(rows, "pair_id long, step long, c double, r double, rc double, rr double")
    out = G.beta_rows(df, rho=0.5).collect()
    per = {r.step: r for r in G.beta_summary(G.beta_rows(df, rho=0.5)).collect()}
    state = (0.0, 1.0)
    for step in range(6):
        batch = [r for r in out if r.step == step]
        gaps = [r.gap for r in batch]
        mean = sum(gaps) / 10
        std = math.sqrt(sum((g - mean) ** 2 for g in gaps) / 10)
        state = (0.9 * state[0] + 0.1 * mean, 0.9 * state[1] + 0.1 * std)
        kept = [r.gap for r in batch if r.kept]
        assert len(kept) == 5 and batch[0].mean == pytest.approx(state[0]) and batch[0].std == pytest.approx(state[1])
        raw = 0.1 * (1 + 0.6 * (sum(kept) / 5 - state[0]))
        used = max(raw, 1e-3)
        assert (per[step].beta_raw, per[step].beta_used, per[step].kept_share) == pytest.approx((raw, used, 0.5))
        assert per[step].loss == pytest.approx(sum(math.log1p(math.exp(-used * g)) for g in kept) / 5)
    fixed = G.beta_rows(df, training=False, state=(0.5, 2.0)).collect()
    assert all(r.kept and (r.mean, r.std) == (0.5, 2.0) for r in fixed)
    assert not all(r.kept for r in G.beta_rows(df, training=False, deterministic_eval=False).collect())


def test_containment_beyond_one_automaton(spark):
    """Patterns that are too many for one automaton go by anchors and several scans, with the same rows."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(200)] + [(900, None), (901, "")]
    bench = [(text(n),) for n in (1, 2, 3, 4) for _ in range(2)] + [(" ".join(docs[i][1].split()[2 : 2 + n]) + cut,) for i in range(0, 60, 3) for n, cut in ((5, ""), (6, "x"), (9, ""))]
    df, patterns = spark.createDataFrame(docs, "row_id long, text string").repartition(3), spark.createDataFrame(bench, "text string")
    known = {" ".join(b.split()) for (b,) in bench if b.split()}
    want = {i for i, t in docs if t and any(p in t for p in known)}
    for chars in (1 << 20, 60, 400):
        assert {r.row_id for r in D.contaminated_ids(df, patterns, automaton_chars=chars).collect()} == want


def test_prompt_metadata_tells_renderers_apart():
    from tidewater.plans.prepare import prompt_metadata

    of = lambda t, **k: prompt_metadata(K.char_tokenizer(), t, DataArguments(**k))
    assert of(T.chatml()) == of(T.chatml()) != of(T.chatml(), auto_insert_empty_system_msg=False)
    assert of(T.header()) != of(T.header("<s>")) and of(T.header())["template"] == T.HEADER


def plain_bpe(text, merges):
    """Lowest rank first, over and over."""
    rank = {m: i for i, m in enumerate(merges)}
    tokens = list(text)
    while True:
        pairs = [(rank[p], p) for p in zip(tokens, tokens[1:], strict=False) if p in rank]
        if not pairs:
            break
        pair, out, i = min(pairs)[1], [], 0
        while i < len(tokens):
            if tuple(tokens[i : i + 2]) == pair:
                out.append("".join(pair))
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    made = {"".join(m): K.MERGED + i for i, m in enumerate(merges)}
    return [made.get(t) or ord(t) for t in tokens]


def test_merge_codec_equals_plain_merging(spark):
    rng = random.Random(31)
    for _ in range(4):
        known, merges = list("aab😀 é"), []
        while len(merges) < 25:
            m = (rng.choice(known), rng.choice(known))
            if "".join(m) not in known and len("".join(m)) < 9:
                merges.append(m)
                known.append("".join(m))
        texts = ["", "a", "aaa", "aaaa", *["".join(rng.choice("aaab😀 é") for _ in range(rng.randint(1, 60))) for _ in range(80)]]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", K.merge_codec(merges)(F.col("t")).alias("ids"))
        got = df.select("i", "ids", K.merge_decode(merges)(F.col("ids")).alias("back")).collect()
        assert {r.i: r.ids for r in got} == {i: plain_bpe(t, merges) for i, t in enumerate(texts)}
        assert {r.i: r.back for r in got} == dict(enumerate(texts))
    table = spark.createDataFrame([("ab", "c", 1), ("a", "b", 0)], "left string, right string, rank int")
    assert K.read_merges(table) == [("a", "b"), ("ab", "c")]
    assert value(spark, K.merge_codec(K.read_merges(table))(F.lit("abcab\U000F0000"))) == [K.MERGED + 1, K.MERGED, 0xFFFD]
    for bad in ([("ab", "c")], [("a", "b"), ("a", "b")]):
        with pytest.raises(ValueError):
            K.merge_codec(bad)
    with pytest.raises(ValueError, match="more than 1"):
        K.read_merges(table, 1)


def test_merges_move_the_boundary_or_raise(spark):
    spec = K.TokenizerSpec(encode=K.merge_codec([("b", "c"), ("a", "bc"), ("x", "abc")]))
    rows = lambda p, c, r: K.tokenise_pairs(spark.createDataFrame([(p, c, r)], "prompt string, chosen string, rejected string"), spec)
    one = rows("yb", "cz", "z").first()  # y, bc, z against y, b, z
    assert (one.prompt_input_ids, one.chosen_input_ids, one.chosen_labels) == ([121], [121, K.MERGED, 122], [-100, K.MERGED, 122])
    assert (one.rejected_input_ids, one.rejected_labels) == ([121, 98, 122], [-100, -100, 122])
    with pytest.raises(Exception, match="differ by more than their last token"):
        rows("xab", "c", "z").collect()  # xabc against x, a, b, z


def test_codecs_are_told_apart(spark):
    from tidewater.sources.cache import cache_root, function_hash

    assert function_hash(K.word_codec(100)) == function_hash(K.word_codec(100)) != function_hash(K.word_codec(32768))
    assert function_hash(K.char_codec) != function_hash(K.word_codec(100)) != function_hash(None)
    assert (cache_root("a/b", "/p/"), cache_root("/a", "/p"), cache_root("s3a://x/y", "/p")) == ("/p/a/b", "/a", "s3a://x/y")


def test_margin_log_keeps_rows_without_step_and_raises_on_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"mean": 1.0}\n\n{"step": 2, "mean": 2.0, "more": 1}\n')
    assert sorted((r.step or 0, r["mean"]) for r in read_margins(spark, str(tmp_path / "log.jsonl")).collect()) == [(0, 1.0), (2, 2.0)]
    (tmp_path / "bad.jsonl").write_text('{"step": 1}\n{"step": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_margins(spark, str(tmp_path / "bad.jsonl")).collect()


def test_packing_and_eval_batches(spark):
    rng = random.Random(7)
    rows = [(i * 1000, [rng.randint(0, 9) for _ in range(rng.randint(0, 30))]) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, ids array<int>").repartition(4)
    flat = [x for _, a in rows for x in [*a, 99]]
    got = {r.block: r.input_ids for r in K.pack(df, "ids", "row_id", 16, 99).collect()}
    assert got == {b: flat[b * 16 : b * 16 + 16] for b in range(-(-len(flat) // 16))}
    numbered = spark.range(9).withColumnRenamed("id", "row_id")
    assert M.eval_batch(numbered, 4).count() == 4 and M.eval_batch(numbered, 40).count() == 9


def test_losses_of_batches(spark):
    rows = spark.createDataFrame([(1.0, 3.0, 2), (2.0, 5.0, 3)], "loss double, nll double, n int")
    assert rows.agg(L.with_sft(F.col("loss"), F.col("nll"), F.col("n"), 0.5).alias("x")).first().x == pytest.approx(1.5 + 0.5 * 8 / 5)
    assert rows.agg(L.with_sft(F.col("loss"), F.col("nll"), F.col("n"), 0.0).alias("x")).first().x == 1.5
    assert value(spark, L.weighted(F.lit(2.0), F.lit(-1.0), F.lit(-0.5))) == pytest.approx(2 * math.exp(-1.5))
    assert value(spark, L.weighted(F.lit(2.0), F.lit(1.0), F.lit(0.5))) == 2.0


def test_sinks_of_margins(spark, tmp_path):
    from tidewater.sources.sinks import MARGIN_LOG, margin_dataset_name, write_card, write_full_margins

    rows = spark.createDataFrame([(1, 0.5), (1, -0.5), (2, 1.0)], "step long, margin double")
    write_full_margins(rows, f"{tmp_path}/full")
    write_full_margins(rows.withColumn("step", F.lit(3)), f"{tmp_path}/full")
    assert {(r.step, r.n) for r in spark.read.parquet(f"{tmp_path}/full").groupBy("step").agg(F.count("*").alias("n")).collect()} == {(1, 2), (2, 1), (3, 3)}
    assert (margin_dataset_name("m"), margin_dataset_name(None, "x")) == ("m-margin", "x")
    with pytest.raises(ValueError):
        margin_dataset_name(None)
    write_card(spark, f"{tmp_path}/card", "margins", 6, run={"base": "m"}, mixer={"a": 0.5})
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/card").collect())
    assert "# margins" in text and "6 rows" in text and "- base: m" in text and '{"a": 0.5}' in text and all(c in text for c in MARGIN_LOG.names)


def test_non_finite_policy(spark):
    for bad, fixed in ((float("nan"), 0.0), (float("inf"), 1e4), (float("-inf"), -1e4), (2.0, 2.0)):
        assert value(spark, S.checked(F.lit(bad), "sanitize")) == fixed
    assert value(spark, S.checked(F.lit(1.5), "error")) == 1.5
    with pytest.raises(Exception, match="non-finite"):
        value(spark, S.checked(F.lit(float("nan")), "error"))
    with pytest.raises(ValueError):
        S.checked(F.lit(1.0), "other")


def test_evaluation_output(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (3.0, 4.0, 5.0)], "loss double, logits_chosen double, logits_rejected double")
    assert G.evaluation(df).first().asDict() == {"loss": 2.0, "logits_chosen": 3.0, "logits_rejected": 4.0, "label": 0}
    assert G.evaluation(df, ("logits_chosen",)).columns == ["loss", "logits_rejected", "label"]


def test_encoder_decoder_and_tokenizer_setup(spark):
    df = spark.createDataFrame([("abcdef", "xyz", "")], "prompt string, chosen string, rejected string")
    row = K.tokenise_encoder_decoder(df, K.char_tokenizer(), max_prompt_length=4, max_target_length=2).first()
    assert (row.prompt_input_ids, row.prompt_attention_mask, row.chosen_labels, row.rejected_labels) == ([97, 98, 99, 100], [1] * 4, [120, 121], [])
    assert K.needs_chatml_setup("<|im_start|>x", {"<|im_start|>"}, "<pad>") and K.needs_chatml_setup("<|im_start|>x", {"<|im_start|>", "<|im_end|>"}, None)
    assert not K.needs_chatml_setup("<|im_start|>x", {"<|im_start|>", "<|im_end|>"}, "<pad>") and not K.needs_chatml_setup("plain", set(), None)
    spec = K.TokenizerSpec("t", eos=7, model_max_length=10**9).ready()
    assert (spec.pad, spec.model_max_length) == (7, 2048)
    assert K.TokenizerSpec("t", eos=7, pad=3, model_max_length=512).ready().pad == 3


def test_prompts_that_differ_raise_and_padding(spark):
    with pytest.raises(Exception, match="differ"):
        odd = K.TokenizerSpec("odd", eos=999, python=lambda texts: [[ord(t[-1]), ord(t[-1]), *map(ord, t)] if t else [] for t in texts])
        K.tokenise_pairs(spark.createDataFrame([("abc", "x", "yz")], "prompt string, chosen string, rejected string"), odd).collect()
    rows = K.tokenise_pairs(spark.createDataFrame([(0, 1, "a", "xyz", "q"), (0, 2, "b", "x", "pq")], "batch int, row_id int, prompt string, chosen string, rejected string"), K.char_tokenizer())
    got = {(r.row_id, r.side): (r.input_ids, r.attention_mask, r.labels) for r in K.pad_batches(rows, "batch", "row_id", pad=0).collect()}
    assert got[1, 0] == ([97, 120, 121, 122, 999], [1] * 5, [-100, 120, 121, 122, 999])
    assert got[2, 0] == ([98, 120, 999, 0, 0], [1, 1, 1, 0, 0], [-100, 120, 999, -100, -100])
    assert got[1, 1] == ([97, 113, 999, 0, 0], [1, 1, 1, 0, 0], [-100, 113, 999, -100, -100])


def test_inspection_rows_have_all_fields(spark):
    rows = K.tokenise_pairs(spark.createDataFrame([(4, "ab", "c", "de")], "row_id long, prompt string, chosen string, rejected string"), K.char_tokenizer(eos=None))
    row = K.inspection_rows(rows, split="test").first().asDict()
    assert list(row) == list(K.INSPECTION) and len(row) == 24
    assert (row["sample_index"], row["split"], row["decoded_prompt"], row["decoded_chosen_full"], row["decoded_rejected_target"], row["rejected_target_length"]) == (4, "test", "ab", "abc", "de", 2)


def test_weighted_samples_follow_their_weights(spark):
    """Which rows are kept: the heavier ones, over many groups, in about the share that sampling without replacement gives."""
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.expr("id div 10").alias("g"), F.when(F.col("id") % 10 < 5, 3.0).otherwise(1.0).alias("w"))
    kept = M.weighted_sample(df, "w", 0.3, keys=("g",)).filter("kept")
    share = kept.filter("w = 3").count() / kept.count()
    rng = random.Random(8)
    plain = [sorted(range(10), key=lambda i: -math.log(1 - rng.random()) / (3 if i < 5 else 1))[:3] for _ in range(5000)]
    assert kept.count() == 6000 and abs(share - sum(i < 5 for x in plain for i in x) / 15000) < 0.02


def test_configs_of_models_and_trainers():
    from tidewater.config import AlphaDPOConfig, DPOConfig, ModelArguments, SFTConfig

    model = load(ModelArguments, "model_name_or_path: m\nuse_peft: true\nlora_target_modules:\n  - q\n  - v\n", ["--lora_r=8"])
    assert (model.model_name_or_path, model.use_peft, model.lora_target_modules, model.lora_r) == ("m", True, ["q", "v"], 8)
    with pytest.raises(ValueError):
        ModelArguments(load_in_8bit=True, load_in_4bit=True)
    assert load(SFTConfig, "packing: true").packing and load(DPOConfig, "", ["--beta=0.2"]).beta == 0.2 and not AlphaDPOConfig().ln
    with pytest.raises(ValueError):
        load(DataArguments, "preprocessing_log_samples: -1")


def test_loss_registry(spark):
    c = [F.lit(x) for x in (-1.0, -2.0, -1.5, -1.8)]
    assert set(L.REGISTRY) == {"simpo", "alpha_dpo", "margin_dpo", "epsilon_dpo"}
    assert value(spark, L.REGISTRY["margin_dpo"](*c)["margin"]) == pytest.approx(0.7)
    assert value(spark, L.REGISTRY["simpo"](c[0], c[1])["loss"]) == pytest.approx(math.log1p(math.exp(-1.0)))


def jobs_of(spark, group, run):
    """What run gives, and how many jobs it took."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_dropped_rows_are_counted_by_the_job_that_writes(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{'def bad thing here' if i % 4 == 0 else 'fine'} {i}") for i in range(40)], "row_id long, text string").repartition(3)
    bench = spark.createDataFrame([("bad thing here",)], "text string")
    plain = D.decontaminate(docs, bench)
    _, n_plain = jobs_of(spark, "plain", lambda: plain.write.parquet(f"{tmp_path}/a"))
    clean, dropped = D.decontaminate_observed(docs, bench)
    _, n_observed = jobs_of(spark, "observed", lambda: clean.write.parquet(f"{tmp_path}/b"))
    report, none = jobs_of(spark, "report", dropped.report)
    assert report == {"n_before": 40, "n_dropped": 10, "percent": 25.0} == D.dropped_report(docs, plain)
    assert n_observed == n_plain and none == 0
    clean, dropped = D.decontaminate_observed(docs.filter("row_id < 0"), bench)
    assert clean.collect() == [] and dropped.report() == {"n_before": 0, "n_dropped": 0, "percent": 0.0}


def test_prepare_reports_what_it_drops(spark, tmp_path):
    from tidewater.plans.prepare import prepare

    rows = [(i, f"{PROMPT}{A}{'xx yy' if i < 3 else 'ok'} {i}", f"{PROMPT}{A}no {i}") for i in range(12)]
    spark.createDataFrame(rows, "row_id long, chosen string, rejected string").coalesce(1).write.parquet(f"{tmp_path}/hh/train.parquet")
    catalog = Catalog(spark, str(tmp_path))
    catalog.register("hh", f"{tmp_path}/hh", format="transcript")
    data = DataArguments(dataset_mixer={"hh": 1.0}, dataset_splits=["train"], chat_template="{% for m in messages %}{{ m.role + ':' + m.content }};{% endfor %}")
    for _ in range(2):  # built, then found
        reports = {}
        out = prepare(catalog, f"{tmp_path}/cache", "epsilon_dpo", data, K.char_tokenizer(), benchmark=spark.createDataFrame([("xx yy",)], "text string"), reports=reports)
        assert reports == {"train": {"n_before": 12, "n_dropped": 3, "percent": 25.0}} and out["train"].count() == 9
    text = "".join(map(chr, out["train"].orderBy("row_id").first().prompt_input_ids))
    assert text == "user:Hi;assistant:Hello!;user:How?;"  # by the settings' own template


def test_bucketed_sides_join_without_a_shuffle(spark, tmp_path):
    from tidewater.sources.shared import write_bucketed

    pairs = spark.range(500).selectExpr("id AS pair_id", "CAST(id AS double) AS c").repartition(5)
    reference = spark.range(500).selectExpr("id AS pair_id", "CAST(id * 2 AS double) AS rc")
    a, b = (write_bucketed(df, f"tidewater_{n}", "pair_id", 4, f"{tmp_path}/{n}") for n, df in (("pairs", pairs), ("reference", reference)))
    out = G.attach_reference(a, b.hint("merge"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted((r.pair_id, r.c, r.rc) for r in out.collect()) == [(i, float(i), 2.0 * i) for i in range(500)]
    assert len(list((tmp_path / "pairs").glob("part-*"))) == 4
    with pytest.raises(Exception, match="missing or not finite"):
        G.attach_reference(a, write_bucketed(reference.filter("pair_id > 0"), "tidewater_fewer", "pair_id", 4, f"{tmp_path}/fewer").hint("merge")).collect()


def test_steps_are_replaced_and_pruned(spark, tmp_path):
    from tidewater.sources.sinks import read_full_margins, write_full_margins

    path = f"{tmp_path}/full"
    rows = spark.createDataFrame([(s, float(i)) for s in (1, 2) for i in range(3)], "step long, margin double")
    write_full_margins(rows, path)
    write_full_margins(rows.filter("step = 2").withColumn("margin", F.col("margin") + 10), path)
    write_full_margins(rows.limit(0), path)
    got = sorted((r.step, r.margin) for r in read_full_margins(spark, path).collect())
    assert got == [(1, 0.0), (1, 1.0), (1, 2.0), (2, 10.0), (2, 11.0), (2, 12.0)]
    one = read_full_margins(spark, path, [2])
    assert one.count() == 3 and len(one.inputFiles()) > 0 and all("step=2" in f for f in read_full_margins(spark, path, [2]).filter("margin > 0").select(F.input_file_name().alias("f")).toPandas()["f"])
    assert "PartitionFilters: [isnotnull(step" in one._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [step" in one._jdf.queryExecution().executedPlan().toString()


def test_long_form_logits(spark):
    rng = random.Random(41)
    vocab, width, rows = 37, 8, []
    logits = {(s, p): [rng.uniform(-800, 800) if p % 2 else rng.gauss(0, 3) for _ in range(vocab)] for s in range(4) for p in range(5)}
    labels = {k: -100 if k[1] == 3 else vocab - 1 if k[1] == 4 else rng.randrange(vocab) for k in logits}
    for (s, p), x in logits.items():
        rows += [(s, p, c, x[c * width : (c + 1) * width]) for c in range(-(-vocab // width))]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "seq int, pos int, chunk int, values array<double>").repartition(3)
    ys = spark.createDataFrame([(*k, y) for k, y in labels.items()] + [(9, 9, 1)], "seq int, pos int, label int")
    got = {(r.seq, r.pos): r.logp for r in S.token_logp_long(chunks, ys, width=width).collect()}
    assert set(got) == {k for k, y in labels.items() if y != -100}
    for k, v in got.items():
        x, top = logits[k], max(logits[k])
        assert math.isclose(v, x[labels[k]] - top - math.log(sum(math.exp(e - top) for e in x)), rel_tol=1e-9, abs_tol=1e-9)
    beyond = S.token_logp_long(chunks, spark.createDataFrame([(0, 0, 99)], "seq int, pos int, label int"), width=width).first()
    assert beyond.logp is None


def test_state_as_a_table(spark):
    rng = random.Random(43)
    rows = [(k, s, rng.gauss(0, 1), rng.random()) for k in ("a", "b", "c") for s in range(300)]
    stats = spark.createDataFrame(rows, "key string, step long, mean double, std double")
    ends = lambda df: df.groupBy("key").agg(F.max_by("mean", "step").alias("mean"), F.max_by("std", "step").alias("std"))
    state = ends(G.running(stats.filter("step < 140"), 0.9, keys=("key",))).filter("key <> 'c'")
    got = {(r.key, r.step): (r["mean"], r["std"]) for r in G.resumed(stats.filter("step >= 140"), state, 0.9, key="key").collect()}
    assert len(got) == 480
    for key in ("a", "b", "c"):
        m, sd = 0.0, 1.0
        for k, step, x, y in rows:
            if k == key and (step >= 140 or key != "c"):
                m, sd = 0.9 * m + 0.1 * x, 0.9 * sd + 0.1 * y
                if step >= 140:
                    assert math.isclose(got[key, step][0], m, abs_tol=1e-9) and math.isclose(got[key, step][1], sd, abs_tol=1e-9)
