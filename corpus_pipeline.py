"""A training corpus from raw documents: stages of (name, function), each one operator's work.

What holds for all stages: columns that are no part of documents pass through unchanged, whatever
their names. Repeated rows are treated alike until near duplicates go. An empty table gives an empty
table. A stage's rows are told apart by doc_id and text, either of which may be null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.llm import common, langid, neardup, packing, quality, substrings
from slatework.llm.queries import PASSAGES, language_model, tokenizer_path

#: What the mean posterior of a long text's language must reach, and the mean share of its words'
#: features that are known.
LEAST_SCORE, LEAST_KNOWN = 0.6, 0.8


def beside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``work`` with the columns of ``docs`` alone. Columns that have the names of those
    that the operator makes step aside for it."""
    clashing = [c for c in docs.columns if c.lower() in names]
    aside = dict(zip(clashing, common.unused(docs, *clashing), strict=True))
    done = work(docs.withColumnsRenamed(aside))
    return done.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of an importance sample by Gumbel top-k, as many as rejection sampling by the
    same weights is expected to keep. Null and empty texts have weight 0, as ordinary ones, and a text
    of few words hardly another; ties with the last one kept stay, and so do equal rows."""

    def work(docs: DataFrame) -> DataFrame:
        ratio = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        keyed = common.materialize(quality.perturb(quality.score(docs, ratio)), "weights")
        return keyed.filter(F.col("gumbel_key") >= quality.threshold(keyed, quality.accepted(keyed)))

    return beside(docs, ("log_weight", "n_grams", "gumbel_key"), work)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of one of the languages that were learned: texts without a letter go, texts of
    unknown words, and texts of several languages. A few words say little, so the mean posterior
    wanted is less by half of the standard error that a share has at most. Where no language can be
    learned, all stay. Null and empty texts go if any was learned; equal rows fare alike."""
    model = language_model(docs)
    if model.langs == ["und"]:
        return docs

    def work(docs: DataFrame) -> DataFrame:
        bar = LEAST_SCORE - 0.5 / F.sqrt(F.greatest("n_words", F.lit(1)))
        return langid.predict(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= bar) & (F.col("known") >= LEAST_KNOWN))

    return beside(docs, ("lang_pred", "score", "n_words", "known", "lang_spans"), work)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8. Of a group that
    with the smallest doc_id stays, of equal rows one. Null and empty texts are near nothing: those
    with different ids stay."""
    return neardup.first_of_each(docs, neardup.near_duplicates(docs, width=5, percent=80)).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occurred before, in documents with smaller ids or earlier in
    the same; n_chars is that of what is left. A document of nothing else goes; null and empty texts stay."""

    def work(docs: DataFrame) -> DataFrame:
        found = substrings.remove_repeats(docs, **PASSAGES)
        left = found.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
        return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return beside(docs, ("n_sentences", "n_removed", "removed_spans"), work)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in training sequences; the last stage. A null or empty text is the
    final id alone; rows that repeat are packed each; the result has its own columns only."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", good), ("language", in_a_language), ("near_duplicates", distinct), ("substrings", without_repeats), ("packing", packed)]

#: None of the stages' models and hashes can be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows are written once as Parquet and reread; what
    the stage has written besides is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(common.MADE)
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.sweep(spark, before, keep=docs)
    return docs
