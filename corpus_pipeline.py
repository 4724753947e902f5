"""From raw documents to token ids in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before has kept; ``run`` writes what a stage
returns to the shared folder and reads it back for the next. All but the last return the columns of ``documents``.

Nulls, empty texts, repeated rows and empty tables follow the operators' rules: a null or empty text is not toxic, has
no lines, no near-duplicate and no leak, and encodes to no tokens; a row with a null id is judged by its text alone.
Extra columns pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairan.llm.bpe import encode_decode
from kairan.llm.common import crc_mod
from kairan.llm.decontam import without_leaks
from kairan.llm.lines import drop_boilerplate
from kairan.llm.minhash import near_duplicates
from kairan.llm.queries import table
from kairan.llm.toxicity import fit, score
from kairan.sources.store import release, settled, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted as for its query, doesn't reject."""
    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(crc_mod("doc_id", 4) != 2))
    judged = score(docs, model, [f"`{c}`" for c in docs.columns if c != "text"], prefix="__toxic_")
    return judged.filter("__toxic_predicted = 0").select(*(f"`{c}`" for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source."""
    cleaned = drop_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of near-duplicates: five-word shingles, 80 % in common.

    (The query of the operator alone takes two words, as its contract says.) Rows are numbered and judged by number: a
    repeated id loses no text of its own, and rows that repeat a text, whatever their ids, leave one.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(rows, id_col=row).select(F.col("doc_id").alias("__at"), F.col("component_id").alias("__group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(row).alias("at"))
    first = rows.select("doc_id", row).join(groups, F.col(row) == F.col("__at")).groupBy("__group").agg(F.min(order)["at"].alias("__first"))
    return rows.join(first, F.col(row) == F.col("__first"), "left_semi").select(*(f"`{c}`" for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, with the digests of ids and of the bytes they decode to."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: Fitted models, signatures and edit distances have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's table, and what it stored on its way, is deleted once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
