"""Words of a text and the scaffold of operators that give one row per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Bytes that stand between words: controls, blanks and ASCII punctuation. Every byte of a non-ASCII character is
#: part of a word, so texts can be split as UTF-8 bytes.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(SEPARATORS + _UPPER, b" " * len(SEPARATORS) + _UPPER.lower())


#: Rows that are handled together inside a task.
SLICE = 512


#: Bytes of the batches in which tasks hand rows to Python, unless the session says otherwise.
BATCH = 8 << 20
_BATCH_OPTION = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets tasks hand rows to Python in batches of ``BATCH`` bytes: a batch is held on both sides, and more than once.
    A single longer row is a batch of its own."""
    if spark.conf.get(_BATCH_OPTION, None) is None:
        spark.conf.set(_BATCH_OPTION, str(BATCH))


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case."""
    return text.translate(_FOLD).split()


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold kept out of training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def drawn(rows: DataFrame, n: int, content: Sequence[Column], by: str | None = None) -> DataFrame:
    """A sample of exact size: of the rows - of each value of ``by`` - those with the ``n`` least hashes of ``content``, or
    all if there are fewer. The same rows in every run, whatever the number of rows; equal content counts once, so
    neither null nor repeated ids let the sample grow. The bounds, one hash per value of ``by``, reach the driver."""
    small_batches(rows.sparkSession)
    group = [by] if by else []
    hashed = rows.withColumn("_hash", F.xxhash64(*content))
    every = hashed.select(*group, "_hash").distinct()
    if by:
        # Spark keeps the n least of each value per task before it exchanges them.
        place = F.row_number().over(Window.partitionBy(by).orderBy("_hash"))
        least = every.withColumn("_place", place).where(F.col("_place") <= n)
    else:
        least = every.orderBy("_hash").limit(n)
    keep = F.lit(False)
    for bound in least.groupBy(*group).agg(F.max("_hash").alias("_last")).collect():
        inside = F.col("_hash") <= F.lit(bound["_last"])
        keep = keep | (inside & (F.col(by) == F.lit(bound[by])) if by else inside)
    return hashed.where(keep).dropDuplicates([*group, "_hash"]).drop("_hash")


def per_document(
    docs: DataFrame,
    fields: Sequence[StructField],
    setup: Callable[[], Callable],
    id_col: str = "doc_id",
    text_col: str = "text",
    also: Sequence[str] = (),
    together: bool = False,
) -> DataFrame:
    """One result row per input row: the id, the columns named in ``also``, then what ``setup()`` computes from the text.

    ``setup`` runs once per task and returns a function of the text's UTF-8 bytes (a null text comes as empty bytes)
    whose result has one value per field; with ``together`` it gets the list of texts of up to ``SLICE`` rows and returns
    a list of results. Rows are handled one by one, so repeated ids, null ids and further columns
    need no care, and a lost executor costs only its own tasks.
    """
    small_batches(docs.sparkSession)
    keep = [id_col, *also]
    schema = StructType([*(docs.schema[c] for c in keep), *fields])
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = setup()
        for batch in batches:
            # In slices, so that what a batch of very long texts needs stays bounded.
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or b"" for t in part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()]
                found = fn(texts) if together else [fn(t) for t in texts]
                columns = [pa.array(c, t) for c, t in zip(zip(*found), types[len(keep):])]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).cast(types[i]) for i in range(len(keep))), *columns], names=schema.names
                )
        pa.default_memory_pool().release_unused()

    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
