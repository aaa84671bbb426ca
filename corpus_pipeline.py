"""The corpus pipeline: five stages over documents, each written and read again.

``STAGES`` names the stages in order. A stage takes (spark, docs, sf_dir) and works on all rows its
predecessor kept; all but the last return the columns of documents. ``n_chars`` follows the text
where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.llm import decontam, ngram, packing, quality, secretscan
from sigtide.llm.cells import KeyFilter
from sigtide.llm.queries import vocabulary
from sigtide.session import materialised, scratch_path

# A trained score per document cannot be written as SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier predicts as label 1; word vectors over all of ``docs``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, prefix="_").where("_predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per group of texts linked at a shingle similarity of 0.8 or more.

    The row of the smallest id stays, of several texts under that id the smallest text, of equal
    texts one row. Rows without an id take part and come after all ids. Texts without words link
    with nothing: of those, one row stays per id and text.
    """
    # rows are told apart by id and text; equal keys are copies of one row
    keyed = docs.withColumn("_key", F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", F.unhex(F.md5("text")).alias("text")))
    rows = materialised(ngram.links(keyed, "_key").groupBy("_key").agg(
        F.min("component_id").alias("_group"), F.count("*").alias("_rows")), "row-keys")
    # the least key has the smallest id; where that id has more texts, the texts decide
    least = rows.where("_key.no_id = _group.no_id and _key.doc_id <=> _group.doc_id")
    several = least.groupBy("_group").count().where("count > 1").select("_group")
    unclear = materialised(least.join(several, "_group", "left_semi").select("_key", "_group"), "row-unclear")
    # texts move only where a key may be asked for; a filter on the map side knows the others
    key = F.xxhash64("_key")
    some, _ = KeyFilter(unclear, key).split(keyed.select("_key", "text"), key)
    first = some.join(unclear, "_key").groupBy("_group").agg(
        F.min(F.struct("text", "_key")).alias("_first")).select(
        "_group", F.col("_first._key").alias("_first"))
    other = materialised(rows.join(first, "_group", "left").select(
        "_key", (F.col("_key") == F.coalesce("_first", "_group")).alias("_kept"), "_rows").where(
        "not _kept or _rows > 1").select("_key", "_kept"), "row-verdicts")
    asked, alone = KeyFilter(other, key).split(keyed, key)
    marked = asked.join(other, "_key", "left")
    copies = marked.where("_kept").groupBy("_key").agg(
        F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return alone.select(*docs.columns).unionByName(
        marked.where("_kept is null").select(*docs.columns)).unionByName(copies)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask."""
    clean = secretscan.scan(docs, columns=("clean_text",), prefix="_")
    rows = clean.withColumn("_n", F.when(F.col("_clean_text") == F.coalesce("text", F.lit("")),
                                         F.col("n_chars")).otherwise(
        F.length("_clean_text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*[
        F.when(F.col("text").isNotNull(), F.col("_clean_text")).alias(c) if c == "text"
        else F.col("_n").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids."""
    return packing.pack(docs, vocabulary(), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written below ``spark.checkpoint.dir`` and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
