"""Frames that several checks start from.

A stage is a named frame with a key. Over plain sources it is only a shared variable, part of every plan that uses it.
Over ``StagedSources`` it is written once per run, as a Parquet table bucketed and sorted by its key, and every check reads
that: the source table is read once, codes are stored in the form they are compared in, and checks that join two stages on
their key, or group by it, exchange nothing.

Bucketing puts all rows of a key into one file, so only frames with a bounded number of rows per key are stages (one row
per store, per component, per code of a sku); nothing that repeats a key without bound is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import wraps
from graphlib import TopologicalSorter
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from ..sources import Sources

Build = Callable[[Sources], DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    key: str
    needs: tuple[str, ...]
    build: Build


STAGES: dict[str, Stage] = {}


def stage(name: str, key: str = "sku", needs: Iterable[str] = ()) -> Callable[[Build], Build]:
    """Register a shared frame. ``needs`` names the stages it is built from."""

    def register(build: Build) -> Build:
        if name in STAGES:
            raise ValueError(f"stage {name} is registered twice")
        STAGES[name] = Stage(name, key, tuple(needs), build)

        @wraps(build)
        def frame(s: Sources) -> DataFrame:
            return s.shared(name, build)

        return frame

    return register


def stage_order(names: Iterable[str]) -> list[str]:
    """The named stages and all they need, each after what it needs."""
    graph, todo = {}, list(names)
    while todo:
        name = todo.pop()
        if name not in graph:
            if name not in STAGES:
                raise KeyError(f"unknown stage {name}")
            graph[name] = STAGES[name].needs
            todo += graph[name]
    return list(TopologicalSorter(graph).static_order())


class StagedSources(Sources):
    """Sources whose stages are written when first used, each with the stages it needs before it.

    Tables go to ``path`` or the session's warehouse, which every executor must reach, under a name of this run's own; a
    lost executor costs a re-read. ``drop()`` removes them.
    """

    def __init__(self, sources: Sources, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        super().__init__(sources._loaders, sources._rename)
        self._spark = spark
        self._path = path
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._run = uuid.uuid4().hex[:12]
        self._guard = Lock()
        self._locks: dict[str, Lock] = {}
        self._tables: dict[str, str] = {}

    def with_frames(self, **frames: DataFrame) -> StagedSources:
        return StagedSources(super().with_frames(**frames), self._spark, self._path, self._buckets)

    @property
    def written(self) -> list[str]:
        """Stages written so far, in order."""
        return list(self._tables)

    def shared(self, name: str, build: Build) -> DataFrame:
        with self._guard:
            lock = self._locks.setdefault(name, Lock())
        with lock:  # two checks at a time may ask for one stage
            if name not in self._tables:
                for need in STAGES[name].needs:  # before this one begins, not from within its build
                    self.shared(need, STAGES[need].build)
                self._tables[name] = self._write(STAGES[name])
        return self._spark.table(self._tables[name])

    def _write(self, wanted: Stage) -> str:
        table = f"stage_{self._run}_{wanted.name}"
        # Dealt by the key as the buckets are, so every bucket is one file.
        rows = wanted.build(self).repartition(self._buckets, wanted.key)
        writer = rows.write.format("parquet").bucketBy(self._buckets, wanted.key).sortBy(wanted.key)
        if self._path is not None:
            writer = writer.option("path", f"{self._path.rstrip('/')}/{table}")
        writer.saveAsTable(table)
        return table

    def prepare(self, names: Iterable[str]) -> None:
        """Write stages ahead of their use."""
        for name in stage_order(names):
            self.shared(name, STAGES[name].build)

    def drop(self) -> None:
        for table in self._tables.values():
            self._spark.sql(f"drop table if exists {table}")
        self._tables.clear()
