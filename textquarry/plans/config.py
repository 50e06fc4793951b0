"""The declarative configuration: sections with defaults, files in YAML or JSON, paths with dots, overrides from the environment."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any


@dataclass
class Project:
    name: str = "corpus"
    version: str = "1.0"
    output_dir: str = "output"
    seed: int = 42


@dataclass
class Ingestion:
    sources: list[dict[str, Any]] = field(default_factory=list)
    text_field: str = "text"


@dataclass
class Preprocessing:
    cleaning: dict[str, Any] = field(default_factory=lambda: {"remove_html": True, "fix_encoding": True, "normalize_unicode": True, "normalize_whitespace": True})
    languages: list[str] = field(default_factory=list)
    dedup: dict[str, Any] = field(default_factory=lambda: {"methods": ["exact"]})
    tokenizer: dict[str, Any] = field(default_factory=dict)


@dataclass
class Quality:
    filters: list[dict[str, Any]] = field(default_factory=list)
    min_quality_score: float = 0.0
    validate: bool = True
    required_fields: list[str] = field(default_factory=list)


@dataclass
class Augmentation:
    enabled: bool = False
    techniques: list[str] = field(default_factory=list)
    paraphrases_per_doc: int = 2
    intensity: float = 0.7
    ratio: float = 0.5
    variations: int = 2
    synthetic: int = 0


@dataclass
class Output:
    format: str = "parquet"
    compression: str | None = None
    splits: dict[str, float] = field(default_factory=lambda: {"train": 0.8, "validation": 0.1, "test": 0.1})
    stratify_by: str | None = None


@dataclass
class Monitoring:
    enabled: bool = True
    alerts: list[dict[str, Any]] = field(default_factory=list)


SECTIONS = {"project": Project, "ingestion": Ingestion, "preprocessing": Preprocessing, "quality": Quality, "augmentation": Augmentation, "output": Output, "monitoring": Monitoring}
SOURCE_TYPES = ("file", "web", "api", "table")


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Deep merge; mappings are joined key by key, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


class Config:
    """A tree of sections."""

    def __init__(self, tree: Mapping[str, Any] | None = None):
        self.tree = merged({name: asdict(kind()) for name, kind in SECTIONS.items()}, tree or {})

    @classmethod
    def load(cls, path: str) -> Config:
        if not path.endswith((".yaml", ".yml", ".json")):
            raise ValueError(f"unsupported configuration format: {path}")
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                return cls(json.load(f))
            import yaml

            return cls(yaml.safe_load(f) or {})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            if path.endswith(".json"):
                json.dump(self.tree, f, indent=2)
            else:
                import yaml

                yaml.safe_dump(self.tree, f, sort_keys=False)

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.tree
        for part in path.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, path: str, value: Any) -> None:
        *parents, last = path.split(".")
        at = self.tree
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value

    def update(self, tree: Mapping[str, Any]) -> None:
        self.tree = merged(self.tree, tree)

    def from_environment(self, prefix: str = "TEXTQUARRY__") -> None:
        """``PREFIX a__b=value``: two underscores part the path, values are read as JSON where they are."""
        for name, value in os.environ.items():
            if name.startswith(prefix):
                try:
                    parsed = json.loads(value)
                except ValueError:
                    parsed = value
                self.set(name[len(prefix) :].lower().replace("__", "."), parsed)

    def section(self, name: str):
        kind = SECTIONS[name]
        known = {f.name for f in fields(kind)}
        return kind(**{k: v for k, v in self.tree[name].items() if k in known})

    def problems(self) -> list[str]:
        """What keeps the configuration from running; unknown keys are named, never ignored silently."""
        out = []
        if not self.get("project.name"):
            out.append("project.name is required")
        sources = self.get("ingestion.sources") or []
        if not sources:
            out.append("at least one ingestion source is required")
        out += [f"unknown source type: {s.get('type')}" for s in sources if s.get("type") not in SOURCE_TYPES]
        if abs(sum((self.get("output.splits") or {}).values()) - 1) > 0.01:
            out.append("output.splits must sum to 1")
        if self.get("output.format") not in ("parquet", "jsonl", "dataset"):
            out.append(f"unknown output format: {self.get('output.format')}")
        for a in self.get("monitoring.alerts") or []:
            if not isinstance(a, Mapping) or not a.get("metric") or a.get("operator") not in ("gt", "lt", "eq") or not isinstance(a.get("threshold"), (int, float)):
                out.append(f"an alert needs a metric, an operator (gt, lt, eq) and a threshold: {a}")
        for name, own in self.tree.items():
            if name not in SECTIONS:
                out.append(f"unknown section: {name}")
            else:
                out += [f"unknown key: {name}.{k}" for k in own if k not in {f.name for f in fields(SECTIONS[name])}]
        return out
