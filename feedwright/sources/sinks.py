"""Where reports go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, partition: dict[str, str] | None = None, fmt: str = "parquet") -> int:
    """Write a report and return its row count, which is gathered while writing (no second run of the plan).

    Each report owns its partition directory, so a repeated run replaces just that report.
    """
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    target = "/".join([path.rstrip("/"), *[f"{k}={v}" for k, v in (partition or {}).items()]])
    out.write.mode("overwrite").format(fmt).save(target)
    return int(seen.get["rows"])
