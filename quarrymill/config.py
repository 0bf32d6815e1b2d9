"""Settings of the engine; every threshold of the plans is one of these."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 96
    overlap_sentences: int = 1


@dataclass(frozen=True)
class Retrieval:
    hybrid: bool = True
    dense_k: int = 20
    bm25_k: int = 20
    rrf_k: int = 60
    final_k: int = 6


@dataclass(frozen=True)
class Rerank:
    enabled: bool = True


@dataclass(frozen=True)
class Verify:
    enabled: bool = True
    support_threshold: float = 0.5
    premise_window_chars: int = 160


@dataclass(frozen=True)
class Abstain:
    gate_a: bool = True
    gate_b: bool = True
    min_rerank_score: float = 0.35
    min_supported_claims: int = 1


@dataclass(frozen=True)
class Config:
    chunk: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    rerank: Rerank = field(default_factory=Rerank)
    verify: Verify = field(default_factory=Verify)
    abstain: Abstain = field(default_factory=Abstain)

    def with_overrides(self, overrides: dict[str, Any]) -> Config:
        """A copy with dotted settings ("abstain.gate_a") replaced."""
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        for name, value in overrides.items():
            section, key = name.split(".", 1)
            part = {f.name: getattr(values[section], f.name) for f in fields(values[section])}
            if key not in part:
                raise KeyError(name)
            values[section] = type(values[section])(**part | {key: value})
        return Config(**values)


def load_config(path: str | None) -> Config:
    """Settings from a YAML file; a missing or empty file gives the defaults,
    unknown keys are ignored."""
    config = Config()
    if path is None or not Path(path).exists():
        return config
    import yaml

    given = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    known = {}
    for section in fields(config):
        part = getattr(config, section.name)
        if is_dataclass(part) and isinstance(given.get(section.name), dict):
            known |= {f"{section.name}.{f.name}": given[section.name][f.name] for f in fields(part) if f.name in given[section.name]}
    return config.with_overrides(known)
