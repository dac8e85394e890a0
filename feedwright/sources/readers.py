"""Logical names to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from .entities import ENTITIES, FOLDED_COLUMNS, ddl
from .splits import even_splits

Loader = Callable[[], DataFrame]


class Sources(Mapping):
    """Input tables by logical name, with declared columns and types and one form of keys.

    Loading is lazy and cut to the declared columns; what a check does not use is never read.
    """

    def __init__(self, loaders: Mapping[str, Loader | DataFrame], rename: Mapping[str, Mapping[str, str]] | None = None):
        unknown = set(loaders) - set(ENTITIES)
        if unknown:
            raise KeyError(f"unknown entities: {sorted(unknown)}")
        self._loaders = dict(loaders)
        self._rename = {k: dict(v) for k, v in (rename or {}).items()}
        self._frames: dict[str, DataFrame] = {}
        self._shared: dict[str, DataFrame] = {}

    def __iter__(self):
        return iter(self._loaders)

    def __len__(self) -> int:
        return len(self._loaders)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._load(name)
        return self._frames[name]

    def _load(self, name: str) -> DataFrame:
        loader = self._loaders[name]
        df = loader() if callable(loader) else loader
        for physical, logical in self._rename.get(name, {}).items():
            df = df.withColumnRenamed(physical, logical)
        missing = set(ENTITIES[name]) - set(df.columns)
        if missing:
            raise ValueError(f"{name} lacks columns {sorted(missing)}")
        return df.selectExpr(*[self._column(c, kind) for c, kind in ENTITIES[name].items()])

    @staticmethod
    def _column(name: str, kind: str) -> str:
        value = f"cast(`{name}` as {kind})"
        return f"upper(rtrim({value})) as `{name}`" if name in FOLDED_COLUMNS else f"{value} as `{name}`"

    def shared(self, name: str, build: Callable[[Sources], DataFrame]) -> DataFrame:
        """A frame that several checks start from, planned once."""
        if name not in self._shared:
            self._shared[name] = build(self)
        return self._shared[name]

    def with_frames(self, **frames: DataFrame) -> Sources:
        """A copy with some tables replaced."""
        return Sources({**self._loaders, **frames}, self._rename)

    @classmethod
    def from_files(
        cls,
        spark: SparkSession,
        root: str,
        names: list[str] | None = None,
        fmt: str = "parquet",
        rename: Mapping[str, Mapping[str, str]] | None = None,
        options: Mapping[str, str] | None = None,
    ) -> Sources:
        """One directory per entity. Text formats are read with the declared schema instead of guessing it."""

        def loader(name: str) -> Loader:
            def load() -> DataFrame:
                reader = spark.read.format(fmt).options(**(options or {}))
                if fmt in ("csv", "json") and name not in (rename or {}):
                    reader = reader.schema(ddl(name))
                return reader.load(str(PurePosixPath(root) / name) if "://" not in root else f"{root.rstrip('/')}/{name}")

            return load

        return cls({n: loader(n) for n in (names or ENTITIES)}, rename)

    @classmethod
    def from_tables(
        cls, spark: SparkSession, tables: Mapping[str, str], rename: Mapping[str, Mapping[str, str]] | None = None
    ) -> Sources:
        """Catalog tables or views, {entity: table name}."""
        return cls({n: (lambda t=t: spark.table(t)) for n, t in tables.items()}, rename)

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        tables: Mapping[str, str],
        options: Mapping[str, str] | None = None,
        split: Mapping[str, Mapping[str, str]] | None = None,
        rename: Mapping[str, Mapping[str, str]] | None = None,
        even: Mapping[str, tuple[str, int]] | None = None,
    ) -> Sources:
        """Database tables. ``split`` gives an entity its partitionColumn, lowerBound, upperBound and numPartitions, so
        that a large table is read by many tasks; ``even`` gives it a column and a number of parts instead, whose bounds a
        first narrow read of that column finds (see ``even_splits``). The choice of columns reaches the database, and
        filters on columns that need no cast; keys are brought to one form in Spark, so filters on them are applied after
        reading."""

        def loader(name: str, table: str) -> Loader:
            def load() -> DataFrame:
                extra = {**(options or {}), **(split or {}).get(name, {})}
                rows = spark.read.format("jdbc").options(url=url, dbtable=table, **extra)
                if name not in (even or {}):
                    return rows.load()
                column, parts = even[name]
                return spark.read.jdbc(url, table, predicates=even_splits(rows.load().select(column), column, parts), properties=extra)

            return load

        return cls({n: loader(n, t) for n, t in tables.items()}, rename)
