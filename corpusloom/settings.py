"""Named defaults; thresholds differ by caller on purpose. Values can come from the environment, a mapping or YAML."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


class Group:
    """Defaults that can be replaced by name."""

    def updated(self, values: Mapping[str, object]):
        """With values by name, each converted to the default's type; unknown names raise."""
        known = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if unknown := set(values) - set(known):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: known[k](v) for k, v in values.items()})


# The defaults of the groups below are fixed values.


@dataclass(frozen=True)
class Generation(Group):
    primary_model: str = "claude-sonnet-4-20250514"
    fallback_model: str = "gpt-4o-mini"
    temperature: float = 0.4
    max_retries: int = 3
    concurrency: int = 10


@dataclass(frozen=True)
class Validation(Group):
    models: tuple = ("claude-sonnet-4-20250514", "gpt-4o-mini", "gemini-2.0-flash")
    equivalence_threshold: float = 0.85
    tasks: tuple = ("qa", "reasoning")
    concurrency: int = 10


@dataclass(frozen=True)
class Training(Group):
    local_model: str = "mlx-community/Qwen3-4B-Instruct-4bit"
    local_lora_rank: int = 8
    local_lora_alpha: int = 16
    local_iters: int = 500
    local_batch_size: int = 2
    local_lr: float = 1e-4
    cloud_model: str = "Qwen/Qwen3-8B"
    cloud_lora_rank: int = 64
    cloud_lora_alpha: int = 128
    cloud_epochs: int = 3
    cloud_batch_size: int = 4
    cloud_lr: float = 2e-4

    def with_cloud(self, payload: Mapping | None) -> Training:
        """With the cloud part of a settings file: cloud.model, and epochs, batch_size and learning_rate of
        cloud.training; what is missing keeps its default."""
        cloud = (payload or {}).get("cloud") or {}
        own = cloud.get("training") or {}
        found = {"cloud_model": cloud.get("model"), "cloud_epochs": own.get("epochs"), "cloud_batch_size": own.get("batch_size"), "cloud_lr": own.get("learning_rate")}
        return self.updated({k: v for k, v in found.items() if v is not None})


def load_yaml(path: str) -> dict:
    """A settings file; needs PyYAML, except for files that are JSON, which YAML includes."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text) if text.strip() else {}
    return yaml.safe_load(text) or {}


@dataclass(frozen=True)
class Settings(Group):
    cost_limit_daily_usd: float = 50.0
    cost_warn_threshold_usd: float = 30.0
    equivalence_threshold: float = 0.85
    harness_threshold: float = 0.72
    synthetic_threshold: float = 0.80
    train_ratio: float = 0.8
    valid_ratio: float = 0.1
    seed: int = 42
    concurrency: int = 10
    costs_log: str = "data/costs.jsonl"

    @classmethod
    def from_env(cls, environ: Mapping[str, str] = os.environ) -> Settings:
        return cls().updated({f.name: environ[f.name.upper()] for f in fields(cls) if f.name.upper() in environ})
