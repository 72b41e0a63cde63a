"""Jobs in stages: all checks before the first write, and a dispatcher by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Violations of a check that an error names.
NAMED = 5


@dataclass(frozen=True)
class Stage:
    """``checks``: queries by name that return violations; ``outputs``: tables by name; ``after``: stages it needs."""

    name: str
    outputs: dict[str, Callable[[], DataFrame]]
    checks: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    after: tuple[str, ...] = ()


def ordered(stages: Sequence[Stage], wanted: Sequence[str] = ()) -> list[Stage]:
    """The wanted stages (all by default) and what they need, each after what it needs."""
    known = {s.name: s for s in stages}
    if len(known) < len(stages):
        raise ValueError("two stages have one name")
    out: dict[str, Stage] = {}

    def add(name: str, path: tuple[str, ...]) -> None:
        if name not in known:
            raise ValueError(f"no stage {name}; there are {sorted(known)}")
        if name in path:
            raise ValueError(f"stages wait for each other: {' > '.join((*path, name))}")
        for needed in known[name].after:
            add(needed, (*path, name))
        out.setdefault(name, known[name])

    for name in wanted or known:
        add(name, ())
    return list(out.values())


def run(stages: Sequence[Stage], folder: str, wanted: Sequence[str] = ()) -> dict[str, str]:
    """Runs stages and returns the paths of their tables. Nothing is written unless no check finds anything."""
    chosen = ordered(stages, wanted)
    faults = []
    for s in chosen:
        for name, check in s.checks.items():
            rows = check().limit(NAMED).collect()
            if rows:
                faults.append(f"{s.name}: {name}: {[r.asDict() for r in rows]}")
    if faults:
        raise ValueError("; ".join(faults))
    paths = {}
    for s in chosen:
        for name, make in s.outputs.items():
            paths[name] = f"{folder}/{name}"
            make().write.mode("errorifexists").parquet(paths[name])
    return paths


@dataclass(frozen=True)
class Method:
    key: str
    label: str
    family: str
    learned: bool


def registry(methods: Sequence[Method]) -> dict[str, Method]:
    """Methods by key; keys and labels must be unique."""
    for k in ("key", "label"):
        values = [getattr(m, k) for m in methods]
        if len(set(values)) < len(values):
            raise ValueError(f"a {k} is given twice")
    return {m.key: m for m in methods}
