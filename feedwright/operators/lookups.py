"""Which look-up of a chain loses a row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .keys import as_list, join_summary

_LOST = "_fw_lost"


@dataclass(frozen=True)
class LookUp:
    """One step of a chain: rows without ``on`` among the ``key`` values of ``reference`` are lost there.

    ``adds`` are columns of the reference that later steps look up by. Where a key repeats, the smallest row of these
    columns is followed, so the chain never multiplies rows.
    """

    name: str
    reference: DataFrame
    on: str
    key: str
    adds: Sequence[str] = ()


def trace_look_ups(rows: DataFrame, steps: Sequence[LookUp], seen: Observation | None = None) -> DataFrame:
    """All rows with ``dropped_by``: the first look-up whose reference lacks them, null for rows that come through.

    Every look-up adds one presence bit; nothing is filtered on the way, so one pass shows all steps. A null key is found
    nowhere. With ``seen``, the rows that enter and leave each step are observed while the result is computed, as
    ``<step>_in`` and ``<step>_out``.
    """
    names = [s.name for s in steps]
    if len(set(names)) != len(names):
        raise ValueError("steps need different names")
    out, lost = rows, F.lit(None).cast("int")
    for i, step in enumerate(steps):
        bit = f"_fw_found{i}"
        picked = F.min(F.struct(*step.adds)).alias("_row") if step.adds else F.lit(True).alias("_row")
        found = step.reference.filter(F.col(step.key).isNotNull()).groupBy(F.col(step.key).alias(step.on)).agg(picked)
        found = found.select(step.on, F.lit(True).alias(bit), *[F.col(f"_row.{c}").alias(c) for c in step.adds])
        out = join_summary(out.drop(*[c for c in step.adds if c != step.on]), found, step.on, "left")
        lost = F.coalesce(lost, F.when(F.col(bit).isNull(), F.lit(i)))
    out = out.withColumn(_LOST, lost)
    if seen is not None:
        alive = [F.count(F.when(F.col(_LOST).isNull() | (F.col(_LOST) >= i), 1)) for i in range(len(steps) + 1)]
        counts = [c for i, n in enumerate(names) for c in (alive[i].alias(f"{n}_in"), alive[i + 1].alias(f"{n}_out"))]
        out = out.observe(seen, *counts)
    dropped = F.coalesce(*[F.when(F.col(_LOST) == i, F.lit(n)) for i, n in enumerate(names)])
    return out.withColumn("dropped_by", dropped).drop(_LOST, *[f"_fw_found{i}" for i in range(len(steps))])


def drop_trace(rows: DataFrame, key: str | Sequence[str], steps: Sequence[LookUp], seen: Observation | None = None) -> DataFrame:
    """Lost keys with the first look-up that dropped them and the rows lost there."""
    lost = trace_look_ups(rows, steps, seen).filter(F.col("dropped_by").isNotNull())
    return lost.groupBy(*as_list(key), "dropped_by").agg(F.count("*").alias("lost_rows"))


def drop_steps(rows: DataFrame, key: str, steps: Sequence[LookUp]) -> DataFrame:
    """One row per look-up: rows and keys that enter and leave it."""
    place = F.coalesce(*[F.when(F.col("dropped_by") == s.name, F.lit(i)) for i, s in enumerate(steps)], F.lit(len(steps)))
    depth = range(len(steps) + 1)
    per_key = trace_look_ups(rows, steps).groupBy(key).agg(*[F.count(F.when(place >= i, 1)).alias(f"_r{i}") for i in depth])
    keys = [F.count(F.when((F.col(f"_r{i}") > 0) & F.col(key).isNotNull(), 1)).alias(f"_k{i}") for i in depth]
    total = per_key.agg(*[F.sum(f"_r{i}").alias(f"_r{i}") for i in depth], *keys)
    out = [
        F.struct(
            F.lit(i + 1).alias("step"),
            F.lit(s.name).alias("look_up"),
            *[F.coalesce(F.col(f"_{c}{i + d}"), F.lit(0)).alias(f"{n}_{way}") for c, n in (("r", "rows"), ("k", "keys")) for d, way in ((0, "in"), (1, "out"))],
        )
        for i, s in enumerate(steps)
    ]
    return total.select(F.inline(F.array(*out)))
