"""A run's settings: defaults, a YAML or JSON file over them, and what holds in a dry run."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

from .operators.recipes import fingerprint
from .operators.staged import validate_config


@dataclass(frozen=True)
class Settings:
    """What the phases need to know; every field has a default, so a file may name only what differs."""

    seed: int = 42
    dry_run: bool = False
    profiling: bool = False
    root: str = "artifacts"
    folders: dict[str, str] = field(default_factory=lambda: {k: k for k in ("corpus", "splits", "routing", "calibration", "checkpoints", "eval", "results")})
    model: str = ""
    reference_model: str = ""
    seq_len: int = 4096
    sample_counts: tuple[int, ...] = (256, 512, 1024, 2048)
    gate_sample_count: int = 512
    gate_variant: str = "oracle_contaminated"
    variants: tuple[str, ...] = ("baseline_en", "bm_only", "mixed_5050", "mixed_weighted", "coverage_greedy", "oracle_contaminated")
    families: tuple[str, ...] = ("w4a16_shipped", "w4a4_mechanism")
    traffic_mix: dict[str, float] = field(default_factory=dict)
    dry_run_model: str = ""
    dry_run_seq_len: int = 1024
    dry_run_sample_counts: tuple[int, ...] = (8, 16)

    def effective_model(self) -> str:
        return self.dry_run_model if self.dry_run else self.model

    def effective_seq_len(self) -> int:
        return self.dry_run_seq_len if self.dry_run else self.seq_len

    def effective_sample_counts(self) -> tuple[int, ...]:
        return self.dry_run_sample_counts if self.dry_run else self.sample_counts

    def folder(self, name: str) -> str:
        """Where a named kind of artifact lies."""
        if name not in self.folders:
            raise KeyError(f"{name} is no folder of this run: {sorted(self.folders)}")
        return f"{self.root.rstrip('/')}/{self.folders[name]}"

    def fingerprint(self) -> str:
        """16 hex digits; dry runs and profiled ones of the same settings share them."""
        return fingerprint(asdict(self))

    def checked(self) -> Settings:
        """These settings, or ValueError with what does not fit together."""
        validate_config({"sample_counts": self.sample_counts, "gate_sample_count": self.gate_sample_count, "variants": self.variants, "gate_variant": self.gate_variant, "traffic_mix": self.traffic_mix})
        return self

    def shown(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True, ensure_ascii=False)


def parsed(text: str) -> dict:
    """A mapping from YAML (of which JSON is a part); an empty text is an empty mapping."""
    import yaml

    found = yaml.safe_load(text)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"a mapping is expected, not {type(found).__name__}")
    return found


def settings_from(text: str = "", **overrides) -> Settings:
    """Settings from a file's text and then ``overrides``; unknown names raise."""
    given = {**parsed(text), **overrides}
    known = {f.name: f for f in fields(Settings)}
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    return replace(Settings(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}).checked()


def recipe_from(text: str, family: str) -> dict:
    """A recipe's mapping; raises if it is for another family or lacks what every recipe has."""
    recipe = parsed(text)
    missing = [k for k in ("name", "algorithm", "quantized_layers", "exclude") if k not in recipe]
    if missing:
        raise ValueError(f"the recipe of {family} lacks {missing}")
    if recipe["name"] != family:
        raise ValueError(f"the recipe is named {recipe['name']}, not {family}")
    return recipe


def checkpoint_path(settings: Settings, label: str, runs: dict[str, str | None]) -> str:
    """Where a checkpoint is: the reference's own id, in a dry run the small model, else what a run recorded."""
    if settings.dry_run:
        return settings.dry_run_model
    if label == "reference":
        return settings.reference_model
    if not runs.get(label):
        raise FileNotFoundError(f"no finished run has made {label}")
    return runs[label]
