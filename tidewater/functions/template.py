"""Chat templates as expressions over arrays of messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.language import compiled, parse


# The template of tokenizers that have none, and that of header models, as settings files give them.
DEFAULT = "{% for message in messages %}\n{% if message['role'] == 'user' %}\n{{ '<|user|>\n' + message['content'] + eos_token }}\n{% elif message['role'] == 'system' %}\n{{ '<|system|>\n' + message['content'] + eos_token }}\n{% elif message['role'] == 'assistant' %}\n{{ '<|assistant|>\n'  + message['content'] + eos_token }}\n{% endif %}\n{% if loop.last and add_generation_prompt %}\n{{ '<|assistant|>' }}\n{% endif %}\n{% endfor %}"
HEADER = "{% set loop_messages = messages %}{% for message in loop_messages %}{% set content = '<|start_header_id|>' + message['role'] + '<|end_header_id|>\n\n'+ message['content'] | trim + '<|eot_id|>' %}{% if loop.index0 == 0 %}{% set content = bos_token + content %}{% endif %}{{ content }}{% endfor %}{% if add_generation_prompt %}{{ '<|start_header_id|>assistant<|end_header_id|>\n\n' }}{% endif %}"

CHATML = "{% for m in messages %}{{ '<|im_start|>' + m.role + '\n' + m.content + '<|im_end|>\n' }}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"
INST = "{% for m in messages %}{% if loop.first %}{{ bos_token }}{% endif %}{% if m.role == 'assistant' %}{{ m.content + eos_token }}{% else %}{{ '[INST] ' + m.content + ' [/INST]' }}{% endif %}{% endfor %}"


@dataclass(frozen=True)
class Template:
    """A template's text and the special tokens that it may name; compiled by tidewater.functions.language. bos: what strip_bos takes away."""

    name: str
    source: str
    bos: str | None = None
    eos: str = "</s>"

    def __post_init__(self) -> None:
        parse(self.source)

    def takes_system(self) -> bool:
        return "system" in self.source or "<|im_start|>" in self.source


def default_template(eos: str = "</s>") -> Template:
    return Template("default", DEFAULT, eos=eos)


def chatml() -> Template:
    return Template("chatml", CHATML)


def header(bos: str = "<|begin_of_text|>") -> Template:
    return Template("header", HEADER, bos)


def inst(bos: str = "<s>", eos: str = "</s>") -> Template:
    return Template("inst", INST, bos, eos)


def chosen_template(setting: str | None, of_tokenizer: str | None = None, *, bos: str | None = None, eos: str = "</s>") -> Template:
    """The template of the settings, else the tokenizer's own, else the default one."""
    for name, source in (("settings", setting), ("tokenizer", of_tokenizer)):
        if source:
            return Template(name, source, bos, eos)
    return Template("default", DEFAULT, bos, eos)


def with_system(messages: Column, template: Template) -> Column:
    """An empty system message in front, if there is none and the template takes one. An empty dialogue is an error."""
    if not template.takes_system():
        return messages
    first = F.get(messages, F.lit(0))["role"]
    blank = F.struct(F.lit("system").alias("role"), F.lit("").alias("content"))
    bad = F.raise_error(F.lit("an empty dialogue has no first message")).cast("array<struct<role:string,content:string>>")
    return F.when(F.size(messages) == 0, bad).when(first == "system", messages).otherwise(F.concat(F.array(blank), messages))


def render(messages: Column, template: Template, generation: bool = False) -> Column:
    return compiled(template.source, messages, {"bos_token": template.bos or "", "eos_token": template.eos, "add_generation_prompt": generation})


def strip_bos(text: Column, template: Template) -> Column:
    if not template.bos:
        return text
    return F.when(F.startswith(text, F.lit(template.bos)), F.substr(text, F.lit(len(template.bos) + 1))).otherwise(text)
