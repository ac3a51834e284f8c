"""Stages that consume and produce named outputs: their order, and what became of each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from ..session import written


@dataclass(frozen=True)
class Stage:
    """run gets the outputs that it consumes by name (several stages can produce one: a list of tables) and gives its own.

    Of an exclusive group only the first stage of the given order takes part."""

    name: str
    produces: str
    run: Callable[[dict[str, list[DataFrame]]], DataFrame]
    consumes: tuple[str, ...] = ()
    exclusive: str | None = None


@dataclass
class Entry:
    """What became of a stage; an output only where the status is ok."""

    status: str
    produces: str
    output: DataFrame | None = None
    reason: str = ""


class CyclicStages(ValueError):
    pass


def levels(stages: Sequence[Stage]) -> list[list[Stage]]:
    """Stages in levels: each consumes only what earlier levels produce, or what no stage does.  A cycle is refused, with its stages named."""
    waiting, done, out = list(stages), set(), []
    names = [s.name for s in waiting]
    if len(set(names)) < len(names):
        raise ValueError("two stages have one name")
    while waiting:
        open_ = {s.produces for s in waiting}
        ready = [s for s in waiting if not open_ & set(s.consumes)]
        if not ready:
            raise CyclicStages(", ".join(s.name for s in waiting))
        out.append(ready)
        done |= {s.name for s in ready}
        waiting = [s for s in waiting if s.name not in done]
    return out


@dataclass
class Run:
    entries: dict[str, Entry] = field(default_factory=dict)

    def outputs(self, kind: str) -> list[DataFrame]:
        return [e.output for e in self.entries.values() if e.status == "ok" and e.produces == kind]


def run_stages(stages: Sequence[Stage], given: dict[str, list[DataFrame]] | None = None) -> Run:
    """Runs stages level by level; given: outputs that are there already.

    A stage's output is written at once, so that a fault is its own and not that of whoever reads it.  A stage is skipped
    if something it consumes never arrived; one that another stage also produces has arrived as soon as one of them is ok."""
    given, run, groups = given or {}, Run(), set()
    chosen = []
    for s in stages:
        if s.exclusive and s.exclusive in groups:
            run.entries[s.name] = Entry("skipped", s.produces, reason=f"another stage of {s.exclusive} is used")
            continue
        groups.add(s.exclusive)
        chosen.append(s)
    for level in levels(chosen):
        for s in level:
            inputs = {kind: [*given.get(kind, []), *run.outputs(kind)] for kind in s.consumes}
            missing = [kind for kind, found in inputs.items() if not found]
            if missing:
                run.entries[s.name] = Entry("skipped", s.produces, reason=f"{missing[0]} never arrived")
                continue
            try:
                run.entries[s.name] = Entry("ok", s.produces, written(s.run(inputs), "stage"))
            except (PySparkException, ArithmeticError, LookupError, TypeError, ValueError, OSError) as e:
                run.entries[s.name] = Entry("failed", s.produces, reason=(str(e).strip() or type(e).__name__).splitlines()[0])
    return run
