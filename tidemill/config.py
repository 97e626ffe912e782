"""Strict configurations: unknown keys and wrong types are errors, and so are settings that contradict each other."""

from __future__ import annotations

import dataclasses
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, TypeVar

from tidemill.functions.expr import SPECIAL_TOKENS

T = TypeVar("T")


class ConfigError(ValueError):
    pass


def _checked(value: Any, kind: Any, where: str) -> Any:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (types.UnionType, typing.Union):
        problems = []
        for one in args:
            try:
                return _checked(value, one, where)
            except ConfigError as problem:
                problems.append(str(problem))
        raise ConfigError(problems[0])
    if kind is type(None) and value is None:
        return None
    if origin is tuple:
        if not isinstance(value, (list, tuple)):
            raise ConfigError(f"{where}: a list is needed")
        return tuple(_checked(v, args[0], f"{where}[{i}]") for i, v in enumerate(value))
    if origin is dict:
        if not isinstance(value, dict):
            raise ConfigError(f"{where}: a mapping is needed")
        return {_checked(k, args[0], where): _checked(v, args[1], f"{where}.{k}") for k, v in value.items()}
    if dataclasses.is_dataclass(kind):
        return from_dict(kind, value, where)
    if kind is float and type(value) is int:
        return float(value)
    if type(value) is not kind:
        raise ConfigError(f"{where}: {getattr(kind, '__name__', kind)} is needed, not {type(value).__name__}")
    return value


def from_dict(kind: type[T], raw: Any, where: str = "") -> T:
    """A configuration from plain values."""
    if not isinstance(raw, dict):
        raise ConfigError(f"{where or kind.__name__}: a mapping is needed")
    hints = typing.get_type_hints(kind)
    unknown = sorted(set(raw) - set(hints))
    if unknown:
        raise ConfigError(f"{where or kind.__name__}: unknown keys {', '.join(unknown)}")
    missing = [f.name for f in dataclasses.fields(kind) if f.name not in raw and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing:
        raise ConfigError(f"{where or kind.__name__}: missing keys {', '.join(missing)}")
    return kind(**{k: _checked(v, hints[k], f"{where}.{k}" if where else k) for k, v in raw.items()})


def load(path: str, kind: type[T]) -> T:
    """A configuration from a YAML file."""
    import yaml

    return from_dict(kind, yaml.safe_load(Path(path).read_text()))


@dataclass(frozen=True)
class Component:
    """A named source with its share of the budget: local files or an exported table."""

    name: str
    fraction: float
    path: str
    text_field: str | None = "text"

    def __post_init__(self) -> None:
        if not self.name or not 0 <= self.fraction <= 1:
            raise ConfigError(f"component {self.name!r}: a name and a fraction from 0 to 1 are needed")


@dataclass(frozen=True)
class CorpusConfig:
    total_bytes: int
    output_dir: str
    components: tuple[Component, ...]
    seed: int = 42
    val_fraction: float = 0.01
    test_fraction: float = 0.0
    min_component_fill: float = 0.0
    output_format: str = "jsonl"

    def __post_init__(self) -> None:
        if self.total_bytes <= 0 or self.output_format not in ("jsonl", "txt"):
            raise ConfigError("total_bytes must be positive and output_format jsonl or txt")
        if abs(sum(c.fraction for c in self.components) - 1) > 1e-6:
            raise ConfigError("component fractions must add up to 1")
        if len({c.name for c in self.components}) != len(self.components):
            raise ConfigError("component names must differ")
        if min(self.val_fraction, self.test_fraction) < 0 or self.val_fraction + self.test_fraction > 1:
            raise ConfigError("val and test fractions must lie in 0 to 1 together")


@dataclass(frozen=True)
class BundleConfig:
    """How many rows of each source a training or evaluation bundle has; written_rows are those a model writes, by category."""

    output_dir: str
    seed: int = 42
    assistant_rows: int = 25_000
    math_rows: int = 7_000
    tool_rows: int = 10_000
    scale: float = 1.0
    most_candidates: int | None = None
    attempts: int = 4
    written_rows: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if min(self.assistant_rows, self.math_rows, self.tool_rows, self.attempts) < 1 or self.scale <= 0:
            raise ConfigError("rows, attempts and scale must be positive")
        if unknown := set(self.written_rows) - {"assistant", "math", "tool"}:
            raise ConfigError(f"unknown categories {', '.join(sorted(unknown))}")


@dataclass(frozen=True)
class TokenizerConfig:
    vocab_size: int = 16_384
    min_frequency: int = 2
    eos_token: str = "im_end"
    special_tokens: tuple[str, ...] = SPECIAL_TOKENS

    def __post_init__(self) -> None:
        if len(set(self.special_tokens)) != len(self.special_tokens):
            raise ConfigError("special tokens must differ")
        if self.eos_token not in self.special_tokens:
            raise ConfigError("eos_token must be a special token")
        if self.vocab_size < 256 + len(self.special_tokens):
            raise ConfigError("vocab_size must hold 256 bytes and the special tokens")


@dataclass(frozen=True)
class MixtureConfig:
    input_dir: str
    output_dir: str
    recipe: dict[str, int]
    fallback_recipe: dict[str, int] | None = None
    fallback_when_missing: str | None = None
    deficit_policy: str = "redistribute"
    seed: int = 42
    order: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.deficit_policy not in ("redistribute", "fail", "shrink"):
            raise ConfigError("deficit_policy must be redistribute, fail or shrink")
        if any(n < 0 for n in self.recipe.values()):
            raise ConfigError("rows of a recipe can't be negative")


@dataclass(frozen=True)
class BatchConfig:
    context_length: int
    batch_size: int
    total_tokens: int | None = None
    epochs: int = 1

    def __post_init__(self) -> None:
        if self.context_length < 2 or self.batch_size < 1 or self.epochs < 1 or (self.total_tokens is not None and self.total_tokens < 1):
            raise ConfigError("context_length must be 2 or more; batch_size, epochs and total_tokens positive")


@dataclass(frozen=True)
class SftConfig:
    """What fine-tuning takes: how rows become batches, and how often it reports, checks and saves."""

    context_length: int
    batch_size: int
    epochs: int = 1
    warmup_steps: int = 0
    learning_rate: float = 3e-5
    least_rate: float = 0.0
    report_every: int = 10
    check_every: int = 100
    save_every: int = 500
    keep: int = 3

    def __post_init__(self) -> None:
        BatchConfig(self.context_length, self.batch_size, None, self.epochs)
        if min(self.report_every, self.check_every, self.save_every, self.keep) < 1 or self.warmup_steps < 0:
            raise ConfigError("intervals and keep must be positive, warmup_steps not negative")
        if not 0 <= self.least_rate <= self.learning_rate or self.learning_rate <= 0:
            raise ConfigError("learning_rate must be positive and least_rate lie between 0 and it")


def as_dict(config: Any, without: tuple[str, ...] = ()) -> dict:
    return {k: v for k, v in dataclasses.asdict(config).items() if k not in without}


def resume_problems(stored: dict, current: dict, ignored: tuple[str, ...] = ("output_dir",)) -> list[str]:
    """Settings in which a stored state and the current configuration differ."""
    return sorted(k for k in (stored.keys() | current.keys()) - set(ignored) if stored.get(k) != current.get(k))


def artifact_problems(stored: dict[str, str], current: dict[str, str]) -> list[str]:
    """Files whose hashes a stored state and the present differ in, or that one of them lacks: with these it can't be resumed."""
    return [f"{name}: {'missing' if name not in current else 'new' if name not in stored else 'changed'}" for name in sorted(stored.keys() | current.keys()) if stored.get(name) != current.get(name)]
