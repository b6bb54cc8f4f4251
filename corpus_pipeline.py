"""A corpus from language identification to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, saved


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter.

    Null ids, repeated rows and very long texts stay; columns named as the operator's
    results are kept as they are; an empty table stays empty.
    """
    from tallyspark.llm.language_id import identified

    taken = {c.lower() for c in docs.columns}
    pred = next(c for c in ("lang_pred", "_lang_pred", "__lang_pred") if c not in taken)
    score = next(c for c in ("lang_score", "_lang_score", "__lang_score") if c not in taken)
    found = identified(docs, keep=docs.columns, pred_col=pred, score_col=score)
    return found.filter(F.col(pred) != "und").select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies.

    Rows with a null id stay unless a kept row has the same words; of rows that share an id
    and have the same words one stays; documents too short for a shingle stay unless another one has
    the same words; an empty table stays empty.
    """
    from tallyspark.llm.ngram_join import one_of_each_group

    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark.

    Rows are judged one by one, whatever their ids; null texts and an empty benchmark
    leave a document clean.
    """
    from tallyspark.llm.decontamination import uncontaminated

    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; every row and column stays, and a null text stays null."""
    from tallyspark.llm.pii import masked_documents

    return masked_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 4096 tokens.

    A null or empty text is one piece with the end id; rows that share an id are packed
    once each, null ids pass through; an empty table gives no pieces.
    """
    import public_tokenizers

    from tallyspark.llm.packing import packed

    pieces = packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Tokenised output and learned decisions have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, saved(stage(spark, docs, sf_dir), name)
        discard(last)  # the next stage has been written
    return STAGES[-1][1](spark, docs, sf_dir)
