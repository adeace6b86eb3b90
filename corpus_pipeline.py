"""Five stages from raw documents to token ids; each is written as Parquet and read by the next.

Defined cases, for every stage: nulls in any column, empty and very long texts, ties, repeated rows and an empty
table pass as the operator's docstring says (a document without a usable text is never toxic, has the quality of the empty text,
groups with others like it and is drawn by no mix, as it has no words); columns beside doc_id, text and source are
carried through, whatever their names, up to the last stage, which returns what it makes. Where ``labels`` teaches nothing,
toxicity scores by its seed list and the quality classifier keeps every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import covering_simhash, mixture_tree, prefix_bpe, quality_gbdt, toxicity
from graphloom.llm.common import table
from graphloom.session import new_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the lexicon is learnt from the labelled ones among ``docs``."""
    return toxicity.keep(docs, toxicity.learn(spark, docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above; the trees are fitted on the labelled ones among ``docs``."""
    return quality_gbdt.keep(docs, quality_gbdt.train(spark, docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return covering_simhash.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in the shuffled order of the shards that drew them."""
    return mixture_tree.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For every drawn copy doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids themselves, in the order of the rows."""
    return prefix_bpe.encode_decode(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode),
]

#: The classifiers and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-").lower())
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
