"""Chat rendering by task; the shape of the input is checked when the plan is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.template import Template, render, strip_bos, with_system
from tidewater.operators.pairs import derive_prompt, is_dialogue, to_messages

TASKS = ("sft", "generation", "rm", "dpo", "orpo")


def apply_template(df: DataFrame, template: Template, task: str, *, auto_system: bool = True, strip_response_bos: bool = False) -> DataFrame:
    """text for sft and generation; text_chosen and text_rejected for rm; text_prompt too for dpo and orpo.

    strip_response_bos: takes a leading beginning-of-text mark from chosen and rejected (the preference path).
    """
    def own(c: str) -> Column:
        none = F.raise_error(F.lit(f"a row has no dialogue in {c}")).cast("array<struct<role:string,content:string>>")
        return F.when(F.col(c).isNull(), none).otherwise(F.col(c))

    system = (lambda c: with_system(own(c), template)) if auto_system else own
    if task == "sft":
        df = to_messages(df)
        if not is_dialogue(df, "messages"):
            raise ValueError("sft needs messages, or chosen, prompt with chosen, or prompt with completion")
        return df.withColumn("messages", system("messages")).withColumn("text", render(F.col("messages"), template))
    if task == "generation":
        if not is_dialogue(df, "messages"):
            raise ValueError("generation needs messages")
        return df.withColumn("messages", system("messages")).withColumn("text", render(F.col("messages"), template, True))
    if task not in TASKS:
        raise ValueError(f"task {task!r} isn't one of {list(TASKS)}")
    if missing := [c for c in ("chosen", "rejected") if c not in df.columns]:
        raise ValueError(f"{task} needs chosen and rejected; missing: {missing}, found: {df.columns}")
    if not (is_dialogue(df, "chosen") and is_dialogue(df, "rejected")):
        raise ValueError(f"{task} needs dialogues in chosen and rejected")
    if task == "rm":
        return df.withColumns({f"text_{c}": render(system(c), template) for c in ("chosen", "rejected")})
    df = derive_prompt(df)
    answer = (lambda c: strip_bos(render(own(c), template), template)) if strip_response_bos else (lambda c: render(own(c), template))
    return df.withColumns({"text_prompt": render(system("prompt"), template), "text_chosen": answer("chosen"), "text_rejected": answer("rejected")})
