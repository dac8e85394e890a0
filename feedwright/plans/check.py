"""A check is a named, parameterised report over the sources; an empty report passes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources import Sources, write_report
from .stages import StagedSources

KINDS = ("check", "audit", "listing")


@dataclass(frozen=True)
class Check:
    name: str
    area: str
    kind: str
    survey: str
    build: Callable[..., DataFrame]

    @property
    def about(self) -> str:
        return (self.build.__doc__ or "").strip()

    def run(self, sources: Sources, **params) -> DataFrame:
        return self.build(sources, **params)


@dataclass(frozen=True)
class Result:
    check: str
    kind: str
    rows: int
    passed: bool | None = field(default=None)


CHECKS: dict[str, Check] = {}


def check(name: str, area: str, survey: str, kind: str = "check") -> Callable:
    """Register a report. kind: 'check' compares values, 'audit' compares populations, 'listing' has no pass rule."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in CHECKS:
            raise ValueError(f"check {name} is registered twice")
        CHECKS[name] = Check(name, area, kind, survey, build)
        return build

    return register


def select_checks(names: Iterable[str] | None = None, area: str | None = None) -> list[Check]:
    wanted = list(CHECKS) if names is None else list(names)
    return [CHECKS[n] for n in wanted if area is None or CHECKS[n].area == area]


def run_checks(
    sources: Sources,
    out: str,
    names: Iterable[str] | None = None,
    area: str | None = None,
    params: Mapping[str, Mapping] | None = None,
    parallel: int = 1,
    staged: bool = True,
    stage_path: str | None = None,
) -> list[Result]:
    """Write each report under ``out/check=<name>`` and say how many rows it has.

    Reports are independent jobs; with ``parallel`` > 1 several are submitted at a time and share the cluster. Frames that
    reports share are written once, to ``stage_path`` or the session's warehouse, and dropped at the end; ``staged=False``
    plans them anew in every report.
    """
    if staged and not isinstance(sources, StagedSources):
        with_stages = StagedSources(sources, SparkSession.active(), stage_path)
        try:
            return run_checks(with_stages, out, names, area, params, parallel)
        finally:
            with_stages.drop()

    def one(c: Check) -> Result:
        rows = write_report(c.run(sources, **(params or {}).get(c.name, {})), out, {"check": c.name})
        return Result(c.name, c.kind, rows, None if c.kind == "listing" else rows == 0)

    chosen = select_checks(names, area)
    if parallel <= 1:
        return [one(c) for c in chosen]
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(one, chosen))
