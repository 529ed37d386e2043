"""Staged runs: resume by fingerprint, blocking and non-blocking gates, a journal after every stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..sources.artifacts import is_complete, write_json


@dataclass(frozen=True)
class Stage:
    """One stage: what it runs, the artifact that shows it is done, and a gate over its result.

    A blocking gate that is shut ends the run; another is only recorded.
    """

    name: str
    run: Callable[[], object]
    artifact: str | None = None
    gate: Callable[[object], bool] | None = None
    blocking: bool = False


@dataclass
class Journal:
    """What happened, rewritten to ``path`` after each stage."""

    path: str | None = None
    entries: list[dict] = field(default_factory=list)

    def record(self, stage: str, **payload) -> None:
        self.entries.append({"stage": stage, **payload})
        if self.path:
            write_json(self.entries, self.path)


def run_stages(spark, stages: list[Stage], fingerprint: str, journal: Journal | None = None) -> Journal:
    """Run the stages that are not complete, in order, up to a blocking gate that is shut."""
    journal = journal or Journal()
    for stage in stages:
        if stage.artifact and is_complete(spark, stage.artifact, fingerprint):
            journal.record(stage.name, status="resumed")
            continue
        result = stage.run()
        is_open = True if stage.gate is None else bool(stage.gate(result))
        journal.record(stage.name, status="done", gate_open=is_open)
        if stage.blocking and not is_open:
            journal.record(stage.name, status="stopped")
            break
    return journal


def validate_config(cfg: dict) -> None:
    """Checks of a run's configuration; raises ValueError with what is wrong."""
    if cfg.get("gate_sample_count") not in cfg.get("sample_counts", ()):
        raise ValueError("the gate's sample count is not among the sample counts")
    if cfg.get("gate_variant") not in cfg.get("variants", ()):
        raise ValueError("the gate's variant is not among the variants")
    mix = cfg.get("traffic_mix", {})
    if mix and abs(sum(mix.values()) - 1) > 1e-6:
        raise ValueError("the traffic mix does not sum to 1")
    unknown = set(mix) - set(cfg.get("classes", mix))
    if unknown:
        raise ValueError(f"unknown classes in the traffic mix: {sorted(unknown)}")
    shared = set(cfg.get("indonesian_markers", ())) & set(cfg.get("malaysian_markers", ()))
    if shared:
        raise ValueError(f"markers in both lists: {sorted(shared)}")
