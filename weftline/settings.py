"""Validated configuration of a run, from YAML or dictionaries."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


def none_if_blank(value: Any) -> Any:
    return None if isinstance(value, str) and not value.strip() else value


def _within(name: str, value: float, low: float, high: float = float("inf")) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be within {low} and {high}, not {value}")


# Sections, names, defaults and ranges of the configuration, which files written for it must find.
@dataclass
class Input:
    dataset: str
    config_name: str | None = None
    split: str = "train"
    question_field: str = "question"
    answer_field: str = "answer"
    iteration_field: str = "iteration"
    memory_field: str = "memory"
    max_seeds: int = 100
    seed: int = 0

    def __post_init__(self):
        self.config_name = none_if_blank(self.config_name)
        _within("input.max_seeds", self.max_seeds, 1)


@dataclass
class Output:
    dataset: str | None = None
    split: str = "train"
    private: bool = False
    push_to_hub: bool = False
    append_if_same_dataset: bool = True
    local_path: str = "out/rows"
    summary_path: str = "out/summary.json"

    def __post_init__(self):
        self.dataset = none_if_blank(self.dataset)


@dataclass
class Models:
    default: str = "stub"
    generator: str | None = None
    refiner: str | None = None
    judge: str | None = None

    def __post_init__(self):
        self.generator = none_if_blank(self.generator) or self.default
        self.refiner = none_if_blank(self.refiner) or self.generator
        self.judge = none_if_blank(self.judge) or self.default

    @classmethod
    def of(cls, given: dict) -> Models:
        """Also takes the older lists `generators` and `verifiers`, of which the first names generator and judge."""
        given = dict(given)
        for old, new in (("generators", "generator"), ("verifiers", "judge")):
            names = given.pop(old, None) or []
            if names and not given.get(new):
                given[new] = names[0]
        return cls(**{k: v for k, v in given.items() if k in {f.name for f in dataclasses.fields(cls)}})


@dataclass
class Lineage:
    candidates_per_iteration: int = 3
    generator_temperature: float = 0.8
    refiner_temperature: float = 0.4
    judge_temperature: float = 0.0
    max_memory_items: int = 8
    max_question_chars: int = 6000
    max_answer_chars: int = 4000
    min_correctness: float = 1.0
    min_novelty: float = 0.45
    min_depth: float = 0.45
    min_non_stitched: float = 0.70
    min_solution_economy: float = 0.50
    continue_on_rejected: bool = False

    def __post_init__(self):
        _within("lineage.candidates_per_iteration", self.candidates_per_iteration, 1, 8)
        _within("lineage.max_memory_items", self.max_memory_items, 0, 40)
        _within("lineage.max_question_chars", self.max_question_chars, 500)
        _within("lineage.max_answer_chars", self.max_answer_chars, 200)
        for k in ("generator", "refiner", "judge"):
            _within(f"lineage.{k}_temperature", getattr(self, f"{k}_temperature"), 0, 2)
        for k in ("correctness", "novelty", "depth", "non_stitched", "solution_economy"):
            _within(f"lineage.min_{k}", getattr(self, f"min_{k}"), 0, 1)


@dataclass
class Runtime:
    dry_run: bool = False
    log_level: str = "INFO"


@dataclass
class Config:
    input: Input
    output: Output = field(default_factory=Output)
    models: Models = field(default_factory=Models)
    lineage: Lineage = field(default_factory=Lineage)
    runtime: Runtime = field(default_factory=Runtime)

    def __post_init__(self):
        self.output.dataset = self.output.dataset or self.input.dataset

    @classmethod
    def of(cls, given: dict) -> Config:
        """From nested dictionaries; unknown keys of the top level and of models are ignored, others are errors."""
        if "input" not in given:
            raise ValueError("input is required")
        parts = {"output": Output, "lineage": Lineage, "runtime": Runtime}
        made = {k: t(**(given.get(k) or {})) for k, t in parts.items()}
        return cls(input=Input(**given["input"]), models=Models.of(given.get("models") or {}), **made)

    def as_dict(self) -> dict:
        return dataclasses.asdict(self)


def load_config(path: str | Path) -> Config:
    import yaml

    return Config.of(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def write_config(path: str | Path, config: Config) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(config.as_dict(), allow_unicode=True, sort_keys=False), encoding="utf-8")


def same_dataset(a: str | None, b: str | None) -> bool:
    """Whether two data set names mean the same: neither blank, equal but for case and white space around."""
    return bool(a and b and a.strip() and a.strip().lower() == b.strip().lower())
