"""From raw documents to packed training sequences, in five stages.

Each stage reads what the stage before it kept: the quality classifier drops what it scores below 0.3, one document
of each group of near duplicates stays (five-word shingles, Jaccard 0.8), personal data is replaced in the texts, sources
are mixed to their target weights (rows repeat as often as the mix takes them), and the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import mixing, ngram_join, packing, pii, quality_classifier
from curata.llm.storage import free_names, quoted, stored

THRESHOLD = 0.3
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject.

    A null or empty text is scored by the intercept alone; of a repeated id one document trains, all are scored; a null id never trains;
    without labels all score 0.5 and stay; other columns, whatever their names, pass through; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    weights = quality_classifier.train(docs, labels)
    (score,) = free_names(docs, "quality")
    scored = quality_classifier.score(docs, weights, keep=tuple(docs.columns), name=score)
    return scored.where(F.col(score) >= THRESHOLD).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Texts without words (null, empty) are in no group and all stay; repeated rows are one group; equal ids with different texts, and null
    ids, are documents of their own; other columns pass through; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced in the texts.

    Null and empty texts stay as they are; repeated rows are sanitised alike; ids play no part; other columns pass through; an empty table stays empty.
    """
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A text without words has size 0 and costs nothing; a null source is a source of its own, the last; equal rows are counted apart; a row
    taken twice is there twice; other columns pass through; an empty table stays empty.
    """
    return mixing.repeated(docs, mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in the packed sequences, and their ids.

    A null or empty text is a piece of the end id alone; longer texts than a sequence are cut; repeated rows and ids are packed one by one; other
    columns are left out; an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("best-fit packing", pack),
]

#: Fitted weights, tokenizers and packing cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
