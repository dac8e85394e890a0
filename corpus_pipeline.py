"""From raw documents to token ids: the stages of a training-corpus clean-up, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, and
further columns are dropped at the first stage. Null texts have no language and go in the first stage.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField

from feedwright.llm import decontaminate, language, minhash, pii
from feedwright.llm.bpe import Codec, apply_codec
from feedwright.llm.components import checkpoint_folder, saved
from feedwright.llm.queries import CODEC_FIELDS, RANKS, codec_digests
from feedwright.llm.text import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: How certain the language of a text of ``language.FULL`` words or more must be; of one with fewer, in proportion, as
#: one or two words of the right language cannot make it certain either.
SURE = 0.5
#: Ids that may be sent to every task (eight bytes each); more are joined by shuffle.
SEND = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not among ``ids`` (one column, doc_id)."""
    ids = saved(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= SEND else ids, "doc_id", "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without letters or of doubtful language go."""
    judged = language.identify(docs, language.fit(docs), also=COLUMNS[1:])
    # The words are counted only where the score alone does not decide.
    sure = (F.col("score") >= SURE) | (F.col("score") >= SURE / language.FULL * F.size(F.split("text", r"\s+")))
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & sure).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates; rows that repeat an id count as copies."""
    found = minhash.near_duplicates(docs)
    kept = without(docs, found.where(~F.col("kept")).select("doc_id").distinct())
    again = saved(kept.groupBy("doc_id").count().where((F.col("count") > 1) & F.col("doc_id").isNotNull()).select("doc_id"))
    if again.isEmpty():
        return kept.select(*COLUMNS)
    first = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return without(kept, again).select(*COLUMNS).unionByName(first.select("doc_id", "row.*"))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), also=COLUMNS[1:])
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind; n_chars is that of the new text."""
    marked = docs.withColumn("_null", F.col("text").isNull())
    found = pii.mask(marked, pii.fit(docs), also=("lang", "source", "n_chars", "_null"))
    text = F.when(~F.col("_null"), F.col("masked"))
    chars = F.when(F.col("_null"), F.col("n_chars")).otherwise(F.length("masked")).cast(docs.schema["n_chars"].dataType)
    return found.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of each text, their number, and digests of the ids and of what they decode to."""
    import public_tokenizers

    def result(codec: Codec, ids: list[int]) -> tuple:
        return (ids, *codec_digests(codec, ids))

    fields = [StructField("ids", ArrayType(IntegerType())), *CODEC_FIELDS]
    return apply_codec(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, fields, result, also=("lang", "source"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("personal_data", without_personal_data),
    ("token_ids", token_ids),
]

#: None: language models, MinHash and byte-level BPE are not expressible in SQL.
ORACLE_SQL = None


def rewritten(docs: DataFrame) -> DataFrame:
    """The rows as Parquet in a folder of their own within the session's checkpoint folder, read again."""
    path = f"{checkpoint_folder(docs.sparkSession)}/stage-{uuid4().hex}"
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else rewritten(docs), sf_dir)
    return docs
