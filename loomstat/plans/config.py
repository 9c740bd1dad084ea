"""Settings of an experiment. Unknown names and values out of range are refused."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class ChunkSettings:
    unit: str = "messages"
    size: int = 10
    overlap: int = 0
    context_messages: int = 5

    def __post_init__(self) -> None:
        if self.unit not in ("messages", "characters"):
            raise ValueError("unit must be messages or characters")
        if self.size < 1 or not 0 <= self.overlap < self.size or self.context_messages < 0:
            raise ValueError("size must be positive, overlap under it, context not negative")


@dataclass(frozen=True)
class AggregateSettings:
    method: str = "max"
    top_k: int = 3

    def __post_init__(self) -> None:
        if self.method not in ("max", "mean", "topk_mean", "noisy_or") or self.top_k < 1:
            raise ValueError("unknown method or top_k under 1")


@dataclass(frozen=True)
class SubsetSettings:
    n_samples: int = 100
    positive_fraction: float | None = None
    max_prompted_fraction: float | None = None
    manually_reviewed_only: bool = True
    label_quotas: Mapping[str, int | str] | None = None
    family_quotas: Mapping[str, int | str] | None = None
    max_tokens: int | None = None
    seed: int = 0

    def __post_init__(self) -> None:
        for x in (self.positive_fraction, self.max_prompted_fraction):
            if x is not None and not 0 <= x <= 1:
                raise ValueError("fractions must be between 0 and 1")
        if self.n_samples < 0:
            raise ValueError("n_samples must not be negative")


@dataclass(frozen=True)
class EvaluationSettings:
    threshold: float = 50.0
    target_fpr: float = 0.05

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 100 or not 0 < self.target_fpr < 1:
            raise ValueError("threshold must be in 0..100, target_fpr in (0, 1)")


@dataclass(frozen=True)
class ExperimentSettings:
    name: str = "default"
    strip_system_prompt: bool = False
    max_transcript_tokens: int = 350_000
    chunk: ChunkSettings = field(default_factory=ChunkSettings)
    aggregate: AggregateSettings = field(default_factory=AggregateSettings)
    subset: SubsetSettings = field(default_factory=SubsetSettings)
    evaluation: EvaluationSettings = field(default_factory=EvaluationSettings)

    @classmethod
    def of(cls, values: Mapping[str, Any]) -> ExperimentSettings:
        return _build(cls, values)

    @classmethod
    def from_yaml(cls, path: str, folder: str = "configs") -> ExperimentSettings:
        """From a file, or by its bare name in ``folder``."""
        import yaml

        file = Path(path)
        if not file.is_file():
            file = Path(folder) / f"{path}.yaml"
        return cls.of(yaml.safe_load(file.read_text()) or {})

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def _build(cls: type, values: Mapping[str, Any]) -> Any:
    known = {f.name: f for f in fields(cls)}
    unknown = set(values) - set(known)
    if unknown:
        raise ValueError(f"unknown settings of {cls.__name__}: {sorted(unknown)}")
    made = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else None  # type: ignore[misc]
        made[name] = _build(type(default), value) if is_dataclass(default) and isinstance(value, Mapping) else value
    return cls(**made)
