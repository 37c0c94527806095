"""A training corpus from `documents` in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import decontam, langid, packing, pii, simhash
from lodestone.llm.common import cut, shared_dir, table

#: A side of a join with at most so many narrow rows is broadcast; Spark shuffles both sides beyond it.
BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model rejects: without a letter (null and empty texts too), or far from every language's centroids.

    Rows are judged each by its own text, whatever its doc_id; long texts are read whole. Columns named like the prediction's
    come back as they were. An empty table, or one without any lang to learn from, gives no rows.
    """
    own = {c: f"_document_{k}" for k, c in enumerate(docs.columns) if c in ("lang_pred", "score", "rejected")}
    found = langid.predict(docs.withColumnsRenamed(own), langid.fit(docs)).where(~F.col("rejected"))
    return found.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies. 

    Rows that share a doc_id are one document: it goes if any of them belongs to a smaller one, and one of them stays
    otherwise. Rows without doc_id go where a row with one has their text; one row of each other text stays.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    found = cut(simhash.near_duplicates(docs.withColumn("doc_id", F.col("doc_id").cast("long"))))
    rows = docs.where("doc_id IS NOT NULL")
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct())
    out = rows.join(_small(gone), "doc_id", "left_anti").select(*docs.columns)
    twice = cut(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if twice.count():
        repeated = out.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
        out = out.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)
    h = "_text_hash" + "_" * max(map(len, docs.columns))  # longer than any column's name
    nameless = docs.where("doc_id IS NULL").withColumn(h, text)
    named = rows.select(text.alias(h)).distinct()
    return out.unionByName(nameless.join(named, h, "left_anti").dropDuplicates([h]).select(*docs.columns)) if found.where("doc_id IS NULL").limit(1).count() else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, as it stands or with other numbers, units and names.

    Rows that share a doc_id (null included) are judged each by its own text; rows without text stay. Texts are read
    whole; further columns pass through; an empty table gives no rows, an empty benchmark drops none.
    """
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind, and counts n_chars anew where there is such a column.

    Each row is read for itself, repeated ones too, and none is dropped; a null text stays null. Further columns pass
    through; an empty table gives no rows.
    """
    out = pii.redact(docs, pii.fit_field(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of at most 4096 tokens, see packing.OUT.

    Each row is packed for itself, repeated ones and those without doc_id too; a null or empty text is the end token alone,
    and only longer texts than a sequence are cut. Further columns are left out; an empty table gives no rows.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii", personal_data),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs


#: Learned and iterative stages have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
