"""The corpus pipeline: quality, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All stages but the last keep
the columns of ``documents``.

Defined results: null and empty texts, null ids and repeated rows pass as the
operators of each stage say; a null id cannot be matched with a label and is
scored like any other. Further columns, whatever their names, are kept. An empty
table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, mixing, pii, quality_model, setjoin
from inkwell.llm.common import cut, remove, scratch

#: Words of a shingle and hundredths of similarity at which two documents are near copies; looser than op8's contract.
NEAR_WORDS, NEAR_PERCENT = 5, 80

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def tokenizer_path() -> str:
    """The vocabulary of the last stage; the file is read on the driver and broadcast."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rule ensemble rejects."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return quality_model.score(whole, model, keep=("row",)).where(F.col("score") >= quality_model.THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: that of the least id, null ids last, then of the least digest of id and text.

    Documents without words are in no group. Rows equal in id and text are one
    document and stay once; rows that share an id but no group stay both.
    """
    tag = "_tag"
    while tag in docs.columns:
        tag += "_"
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("text").isNull(), "null").otherwise(F.concat(F.lit("text"), F.col("text"))))
    tagged = docs.withColumn(tag, F.unhex(F.md5(own)))
    members = setjoin.classify(tagged, percent=NEAR_PERCENT, words=NEAR_WORDS, tag_col=tag)[0]
    by_tag = members.groupBy("tag").agg(F.min("doc_id").alias("doc_id"), F.min("component").alias("component"), F.count("*").alias("n"))
    least = by_tag.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tag", "n")).alias("first"))
    kept = cut(least.select(F.col("first.tag").alias(tag), F.col("first.n").alias(f"{tag}n")).union(by_tag.where("component is null").select("tag", "n")))
    # Texts move once. Only rows that repeat an id and a text go on to be reduced to one.
    found = tagged.join(kept.where(F.col(f"{tag}n") == 1).select(tag), tag, "left_semi").select(docs.columns)
    again = tagged.join(kept.where(F.col(f"{tag}n") > 1).select(tag), tag, "left_semi")
    return found.unionByName(again.groupBy(tag).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row")).select("row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's rate says."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, one row per copy in the mix."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    folder = scratch(spark, "corpus")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return docs
