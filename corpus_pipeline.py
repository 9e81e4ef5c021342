"""From raw documents to token ids: five stages, each of which works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``, in their order. Between stages rows are Parquet tables in the
shared folder. Stages that run Python bound the batches that Spark sends it, if the session has no bound of its own.

Defined cases, in every stage: an empty table gives an empty one; extra columns pass through
all stages but the last, whatever their names, except that names that begin with two
underscores are reserved; very long texts are read whole. A null text goes in the first
stage, as does one without letters; the others keep it. A null id is kept by all. Repeated
rows pass the first two stages and are one group in the third. Ties: a probability of
exactly one half stays, as do a line on exactly the ratio of pages and, of a group, the
least id; two texts of exactly the similarity are near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from foliant.llm.arrow_text import bounded_batches
from foliant.llm.queries import table, tokenizer_path
from foliant.llm.storage import checkpointed, release

#: Near duplicates: shingles of five words, similarity of 80 of 100 or more.
SHINGLE, PART, WHOLE = 5, 80, 100


def _hidden(docs: DataFrame, *read: str) -> DataFrame:
    """``docs`` with all columns but those that are ``read`` named ``__of_...``, so that no operator's column replaces one."""
    return docs.select(*[F.col(c).alias(c if c in read else f"__of_{c}") for c in docs.columns])


def _shown(found: DataFrame, docs: DataFrame, *read: str) -> DataFrame:
    return found.select(*[F.col(c if c in read else f"__of_{c}").alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; those without letters or with a pooled probability below one half go."""
    bounded_batches(spark)
    network = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predict(_hidden(docs, "text"), network)
    return _shown(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= language_id.MIN_SCORE)), docs, "text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars is that of the text left.

    Copies are the next stage's work: a host's identical texts and near copies count as one page here, and a
    document that would become blank stays as it was, so that one of its group is left whole.
    """
    clean = line_dedup.drop_boilerplate(_hidden(docs, "text", "source").withColumn("__whole", F.col("text")), copies_once=True)
    changed = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(" \t\r\n")) != "")
    clean = clean.withColumn("__of_n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("__of_n_chars")).cast("long"))
    return _shown(clean.withColumn("text", F.when(changed, F.col("text")).otherwise(F.col("__whole"))), docs, "text", "source")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, once if its row repeats.

    Rows without words or id stay, and so does a row whose id another row shares, unless its own text goes.
    """
    bounded_batches(spark)
    return jaccard_join.drop_near_duplicates(docs, SHINGLE, PART, WHOLE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    found = decontaminate.decontaminate(_hidden(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _shown(found.where(~F.col("contaminated")), docs, "doc_id", "text")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, encoded and decoded."""
    bounded_batches(spark)
    return bpe.encode_and_decode(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]

#: The first stage's network has no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, checkpointed(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
