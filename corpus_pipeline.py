"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns a DataFrame; the next stage reads
what it wrote. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm import bpe, deobfuscate, mixing, neardup, queries, rules
from sparkveil.llm._common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Pivotal draws, the mixing sampler and hashing are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, policy: rules.Policy = rules.CURRENT) -> DataFrame:
    """Documents that a policy keeps, the current one unless another is given."""
    return rules.apply_policy(rules.ledger(docs.select(*COLUMNS)), policy).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    found = neardup.near_duplicates(docs)
    # Ids that go may be as many as the documents: a merge join at every size. Rows with a null id are all kept.
    gone = found.where("NOT kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, disguised or not; n_chars follows the text."""
    masked = deobfuscate.deobfuscate(docs.select(*COLUMNS), masked="text", keep=COLUMNS)
    return masked.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its bytes."""
    ranks, pattern = queries.rank_file()
    coded = bpe.encode(docs.select("doc_id", "source", "text"), ranks, pattern, keep=["doc_id", "source", "text"], as_bytes=True)
    read = bpe.decode(coded, ranks, pattern)
    size = (F.length("token_ids") / 4).cast("bigint")
    return read.select("doc_id", "source", size.alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.decode("decoded", "UTF-8") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
