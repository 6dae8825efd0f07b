"""The offline job: named sources to tokenised pairs behind the cache, in one lazy plan up to the one write."""

from __future__ import annotations

from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.config import DataArguments, PreferenceConfig, config_class
from tidewater.functions.template import Template, chosen_template
from tidewater.operators.decontaminate import Dropped, decontaminate_observed
from tidewater.operators.mixing import k_sample, mix
from tidewater.operators.pairs import STANDARD_COLUMNS, rename_rendered
from tidewater.operators.render import apply_template
from tidewater.operators.tokenise import COLUMNS, TokenizerSpec, inspection_rows, tokenise_pairs
from tidewater.sources.cache import TokenCache, code_hash, fingerprint, function_hash
from tidewater.sources.catalog import Catalog
from tidewater.sources.sinks import write_samples


def rendered(catalog: Catalog, data: DataArguments, template: Template, *, benchmark: DataFrame | None = None, dropped: dict[str, Dropped] | None = None) -> dict[str, DataFrame]:
    """Prompt, chosen and rejected texts by split; rows whose chosen text holds a benchmark text go if a benchmark is given, and `dropped` gets what counts them."""
    mixed = mix(catalog, data.dataset_mixer, splits=tuple(data.dataset_splits), configs=data.dataset_configs, columns=STANDARD_COLUMNS)
    out = {}
    for split, df in mixed.items():
        df = rename_rendered(apply_template(df, template, "dpo", auto_system=data.auto_insert_empty_system_msg, strip_response_bos=True))
        if benchmark is not None:
            key = F.concat_ws("/", "source", F.col("row_id").cast("string"))
            df, counts = decontaminate_observed(df.withColumn("__key", key), benchmark, id_col="__key", text_col="chosen")
            df = df.drop("__key")
            if dropped is not None:
                dropped[split] = counts
        out[split] = df
    return out


def prompt_metadata(spec: TokenizerSpec, template: Template, data: DataArguments) -> dict[str, Any]:
    """How prompts are made, taken before rendering: the tokenizer, the template's text and its special tokens."""
    return {"tokenizer": spec.name, "template": template.source, "bos": template.bos, "eos": template.eos, "system": data.auto_insert_empty_system_msg}


def manifest(trainer: str, split: str, df: DataFrame, spec: TokenizerSpec, template: Template, data: DataArguments, config: PreferenceConfig) -> dict[str, Any]:
    """What identifies a tokenised table: its input's fingerprint, the tokenizer, the template, the lengths and the code."""
    return {
        "trainer": trainer,
        "split": split,
        "tokenizer": {"name": spec.name, "bos": spec.bos, "eos": spec.eos, "pad": spec.pad, "model_max_length": spec.model_max_length, "codec": [function_hash(spec.encode), function_hash(spec.python)]},
        "prompt": prompt_metadata(spec, template, data),
        "settings": {k: v for k, v in asdict(config).items() if k in ("max_length", "max_prompt_length", "max_target_length", "truncation_mode", "label_pad_token_id")},
        "input": fingerprint(df.select("prompt", "chosen", "rejected")),
        "columns": sorted(COLUMNS),
        "code": {f.__name__: code_hash(f) for f in (tokenise_pairs, apply_template)},
    }


def prepare(catalog: Catalog, cache_root: str, trainer: str, data: DataArguments, spec: TokenizerSpec, template: Template | None = None, config: PreferenceConfig | None = None, *, benchmark: DataFrame | None = None, reuse: bool = True, reports: dict[str, dict[str, float]] | None = None) -> dict[str, DataFrame]:
    """Tokenised tables by split, from the cache or built into it, as the configuration's mode says. Without a template the settings' is taken, else
    the tokenizer's, else the default one. reports gets each split's rows before decontamination and those dropped, counted by the jobs that run anyway."""
    config = config or config_class(trainer)()
    template = template or chosen_template(data.chat_template, spec.chat_template, bos=spec.bos_token, eos=spec.eos_token)
    spec = spec.ready()
    cache, out, dropped = TokenCache(catalog.spark, cache_root), {}, {}
    for split, df in rendered(catalog, data, template, benchmark=benchmark, dropped=dropped).items():
        build = lambda df=df: tokenise_pairs(df, spec, max_length=config.max_length, max_prompt_length=config.max_prompt_length, truncation=config.truncation_mode, pad_label=config.label_pad_token_id)
        identity = manifest(trainer, split, df, spec, template, data, config)
        out[split] = cache.build(build, identity, trainer=trainer, split=split, required=list(COLUMNS), mode=config.preprocessing_mode, reuse=reuse)
        if reports is not None and split in dropped:
            reports[split] = dropped[split].report()
    return out


def log_samples(tokenised: DataFrame, path: str, count: int, seed: int = 42, row_id: str = "row_id") -> int:
    """Writes at most count inspection rows as JSON Lines, at places that the seed fixes; returns how many. None if count is 0."""
    rows = Catalog.numbered(tokenised, [row_id]) if row_id in tokenised.columns else Catalog.numbered(tokenised)
    some = inspection_rows(k_sample(rows, count, seed))
    if count > 0:
        write_samples(some, path)
    return some.count()
