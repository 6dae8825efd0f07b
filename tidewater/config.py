"""Settings: YAML or JSON files and --key=value overrides into dataclasses."""

from __future__ import annotations

import dataclasses
import typing
from dataclasses import dataclass, field
from typing import Any, TypeVar, get_args, get_origin

C = TypeVar("C")


# The settings' names and defaults, as configuration files have them.


@dataclass
class ModelArguments:
    base_model_revision: str | None = None
    model_name_or_path: str | None = None
    model_revision: str = "main"
    model_code_revision: str | None = None
    torch_dtype: str | None = None
    tokenizer_name_or_path: str | None = None
    trust_remote_code: bool = False
    attn_implementation: str | None = None
    use_peft: bool = False
    lora_r: int | None = 16
    lora_alpha: int | None = 32
    lora_dropout: float | None = 0.05
    lora_target_modules: list[str] | None = None
    lora_modules_to_save: list[str] | None = None
    load_in_8bit: bool = False
    load_in_4bit: bool = False
    bnb_4bit_quant_type: str | None = "nf4"
    use_bnb_nested_quant: bool = False
    bnb_4bit_quant_storage: str | None = "uint8"

    def __post_init__(self) -> None:
        if self.load_in_8bit and self.load_in_4bit:
            raise ValueError("load_in_8bit and load_in_4bit exclude each other")


@dataclass
class DataArguments:
    dataset_mixer: dict[str, float] = field(default_factory=dict)
    dataset_splits: list[str] = field(default_factory=lambda: ["train", "test"])
    dataset_configs: list[str] | None = None
    dataset_dir: str | list[str] | None = None
    preprocessing_num_workers: int | None = None
    truncation_side: str | None = None
    auto_insert_empty_system_msg: bool = True
    chat_template: str | None = None
    text_column: str | None = "text"
    use_persistent_hf_cache: bool = False
    hf_cache_dir: str | None = None
    preprocessing_log_samples: int = 0
    preprocessing_log_dir: str | None = None

    def __post_init__(self) -> None:
        if self.preprocessing_log_samples < 0:
            raise ValueError("preprocessing_log_samples must not be negative")
        if self.dataset_dir is not None:
            if self.dataset_configs is not None:
                raise ValueError("dataset_dir and dataset_configs exclude each other")
            self.dataset_configs = list(self.dataset_dir) if isinstance(self.dataset_dir, (list, tuple)) else [self.dataset_dir]


@dataclass
class PreferenceConfig:
    max_length: int = 512
    max_prompt_length: int = 128
    max_target_length: int | None = None
    truncation_mode: str = "keep_end"
    label_pad_token_id: int = -100
    beta: float = 0.1
    loss_type: str = "sigmoid"
    label_smoothing: float = 0.0
    preprocessing_mode: str = "online"
    non_finite: str = "error"
    tokenization_batch_size: int = 64

    def __post_init__(self) -> None:
        if self.preprocessing_mode not in ("online", "offline_only", "reuse_only"):
            raise ValueError(f"unknown preprocessing_mode {self.preprocessing_mode!r}")
        if self.non_finite not in ("error", "sanitize"):
            raise ValueError(f"unknown non_finite {self.non_finite!r}")


@dataclass
class SFTConfig:
    max_seq_length: int | None = None
    packing: bool = False
    dataset_text_field: str = "text"
    hub_model_revision: str | None = "main"
    logging_first_step: bool = True


@dataclass
class DPOConfig(PreferenceConfig):
    hub_model_revision: str | None = "main"
    logging_first_step: bool = True
    optim: str | None = "rmsprop"
    remove_unused_columns: bool = False


@dataclass
class SimPOConfig(PreferenceConfig):
    beta: float = 2.0
    gamma: float = 1.0
    sft_weight: float = 0.0


@dataclass
class AlphaDPOConfig(SimPOConfig):
    alpha: float = 0.1
    ln: bool = False  # log-probabilities are means over tokens, not sums


@dataclass
class BetaDPOConfig(PreferenceConfig):
    rho: float = 0.8
    alpha: float = 0.6
    ema_momentum: float = 0.9
    beta_min: float = 1e-3
    deterministic_eval: bool = True

    def __post_init__(self) -> None:
        super().__post_init__()
        if not 0 < self.rho <= 1:
            raise ValueError("rho must be in (0, 1]")
        if self.alpha < 0:
            raise ValueError("alpha must not be negative")
        if not 0 <= self.ema_momentum < 1:
            raise ValueError("ema_momentum must be in [0, 1)")
        if self.beta_min <= 0:
            raise ValueError("beta_min must be positive")


@dataclass
class MarginDPOConfig(PreferenceConfig):
    f_divergence_type: str = "reverse_kl"
    f_alpha_divergence_coef: float = 0.5
    margin_log_path: str | None = None
    log_steps: int = 1
    save_full: bool = False


@dataclass
class EpsilonDPOConfig(PreferenceConfig):
    epsilon: float = 0.01

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.epsilon < 0:
            raise ValueError("epsilon must not be negative")


#: Trainer type to its configuration.
CONFIGS: dict[str, type[PreferenceConfig]] = {"simpo": SimPOConfig, "alpha_dpo": AlphaDPOConfig, "beta_dpo": BetaDPOConfig, "margin_dpo": MarginDPOConfig, "epsilon_dpo": EpsilonDPOConfig}


def config_class(trainer: str) -> type[PreferenceConfig]:
    if trainer not in CONFIGS:
        raise ValueError(f"unknown trainer {trainer!r}; one of {sorted(CONFIGS)}")
    return CONFIGS[trainer]


def cast(value: Any, kind: Any) -> Any:
    """A string override as its declared type."""
    if not isinstance(value, str):
        return value
    if get_origin(kind) is not None and type(None) in get_args(kind):
        options = [a for a in get_args(kind) if a is not type(None)]
        return None if value.lower() in ("none", "null", "") else cast(value, options[0])
    if kind is bool:
        if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"{value!r} is no boolean")
        return value.lower() in ("true", "1", "yes")
    if kind in (int, float):
        return kind(value)
    if get_origin(kind) is list:
        return [cast(v.strip(), (get_args(kind) or (str,))[0]) for v in value.split(",")]
    return value


def scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    low = text.lower()
    if low in ("", "null", "~", "none"):
        return None
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def read_yaml(text: str) -> dict[str, Any]:
    """The part of YAML that settings use: keys, scalars, one level of lists and of maps. A YAML library is used if there is one."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        pass
    out: dict[str, Any] = {}
    key = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        item = bare.strip()
        if item.startswith("- ") and key is not None:
            out[key] = [*(out[key] or []), scalar(item[2:])]
        elif bare[0] in " \t" and key is not None:
            name, _, value = item.partition(":")
            out[key] = {**(out[key] or {}), name.strip().strip("'\""): scalar(value)}
        else:
            key, _, value = item.partition(":")
            key = key.strip()
            out[key] = scalar(value)
    return out


def load(cls: type[C], text: str = "", overrides: list[str] | tuple[str, ...] = ()) -> C:
    """A dataclass from YAML text and --key=value overrides; each key may be overridden once; unknown keys are errors."""
    values = {k: v for k, v in read_yaml(text).items()}
    kinds = typing.get_type_hints(cls)
    seen = set()
    for o in overrides:
        key, sep, value = o.lstrip("-").partition("=")
        if not sep:
            raise ValueError(f"{o!r} isn't --key=value")
        if key in seen:
            raise ValueError(f"{key} is given twice")
        seen.add(key)
        values[key] = value
    if unknown := set(values) - {f.name for f in dataclasses.fields(cls)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return cls(**{k: cast(v, kinds[k]) for k, v in values.items()})
