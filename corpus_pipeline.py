"""A corpus from raw documents: five stages, each of which reads all that the one before kept.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents.

Defined results of every stage: an empty table gives none; a null text is one without words
and stays null; no length of text is cut; rows with a null doc_id stay, as nothing is known of
them by id (the toxicity stage judges them by their text); further columns, whatever their
names, pass through unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import byte_bpe, decontaminate, jaccard_join, secret_scan, toxicity
from folioframe.llm._session import ensure_checkpoint_dir, pinned, remove, shipped
from folioframe.llm.components import components

#: A document that scores at least this is toxic.
TOXIC = 0.7


def _packed(docs: DataFrame) -> DataFrame:
    """Text beside one struct of all other columns, so that no name of theirs meets an operator's own."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("__row"), "text")


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents, row by row.

    Those without a word stay, and so do all where the labels don't hold both classes: then
    there is no model to reject one by.
    """
    labels = shipped(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    if isinstance(model, float):
        return docs
    wordless = ~F.coalesce(F.col("text").rlike(toxicity.WORD), F.lit(False))
    return _unpacked(toxicity.scored(_packed(docs), model).where((F.col("score") < TOXIC) | wordless), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies (five words, 0.8).

    Documents without words are in no group. Rows that repeat a doc_id stay or go together.
    """
    shipped(spark)
    links = jaccard_join.links(docs, width=5, similarity=0.8)
    # Only documents with a link that are not their group's smallest go; all others need no row here.
    extra = components(links).where("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark windows in a twentieth of their words or more.

    Rows that repeat a doc_id go together if the hits of all of them are so many of one's words.
    """
    benchmark = shipped(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = decontaminate.contamination(docs, benchmark, slop=0).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts, row by row; the n_chars of texts that are masked follows."""
    shipped(spark)
    found, _ = secret_scan.scan(_packed(docs), keep=pinned)
    text, hit = secret_scan.redact(F.col("text"), F.col("findings")), F.size("findings") > 0
    masked = found.select("__row", text.alias("text"), hit.alias("hit"))
    out = _unpacked(masked, docs)
    if "n_chars" in docs.columns:
        n = F.when(F.col("hit"), F.length("text")).otherwise(F.col("__row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
        of = {"text": F.col("text"), "n_chars": n}
        out = masked.select(*(of.get(c, F.col("__row")[c]).alias(c) for c in docs.columns))
    return out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids (little-endian unsigned 32-bit integers) and their number, n_tokens, row by row.

    Columns of these names are replaced. A null text has none.
    """
    import public_tokenizers

    shipped(spark)
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumn("n_tokens", byte_bpe.n_tokens())


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", contaminated),
    ("secret_scans", secrets),
    ("byte_bpe", encoded),
]

#: A learned classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    import uuid

    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        if i:  # nothing reads the stage before's any more
            remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
