"""Embeddings and search: hash vectors, similarity, cached embedding, top-k over all chunks for a table of queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions import rules as R
from folioframe.functions import text as X

def normalized(v: Column, digits: int = 8) -> Column:
    """Unit length, rounded; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(F.struct(v.alias("v"), norm.alias("n"))), lambda p: F.when(p["n"] == 0, p["v"]).otherwise(F.transform(p["v"], lambda x: F.round(x / p["n"], digits))))[0]


def similarity(a: Column, b: Column) -> Column:
    """Dot product; 0 where the lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot).otherwise(0.0)


def hash_embedding(texts: DataFrame, key: str = "chunk_id", size: int = R.VECTOR_SIZE) -> DataFrame:
    """(key, vector), a row per text: each token adds or takes 1 at a place that its SHA-256 gives; then unit length.

    A text's tokens are summed within its row, so nothing is shuffled and a task holds one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            coded = words.flatten().dictionary_encode()
            hashed = [hashlib.sha256(w.encode()).digest() for w in coded.dictionary.to_pylist()]
            place = np.array([int.from_bytes(h[:4], "big") % size for h in hashed], np.int64)
            sign = np.array([-1.0 if h[4] % 2 else 1.0 for h in hashed])
            code = coded.indices.to_numpy()
            row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
            sums = np.bincount(row * size + place[code], sign[code], len(words) * size)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.FixedSizeListArray.from_arrays(pa.array(sums), size).cast(pa.list_(pa.float64()))], [key, "sums"])

    words = texts.select(key, X.tokens(F.col("text")).alias("words"))
    sums = words.mapInArrow(run, T.StructType([texts.schema[key], T.StructField("sums", T.ArrayType(T.DoubleType()))]))
    return sums.select(key, normalized(F.col("sums")).alias("vector"))


Backend = Callable[[DataFrame], DataFrame]
#: Embedding backends by name: (key, text) -> (key, vector), and the vectors' size.
BACKENDS: dict[str, tuple[Backend, int]] = {"hash": (lambda df: hash_embedding(df, "key"), R.VECTOR_SIZE)}


def register_backend(name: str, backend: Backend, size: int) -> None:
    BACKENDS[name] = backend, size


def embedded(chunks: DataFrame, cache: DataFrame, backend: str = "hash", version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """(chunks with vector, rows to add to the cache (key, vector)): only distinct texts that the cache lacks are embedded. A key is of the version, the backend and its size."""
    embed, size = BACKENDS[backend]
    keyed = chunks.withColumn("key", X.embedding_key(f"{version}:{backend}:{size}", F.col("source_checksum"), F.col("text")))
    misses = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = embed(misses)
    return keyed.join(cache.select("key", "vector").unionByName(fresh.select("key", "vector")), "key", "left"), fresh


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best chunks of each query; ties by vec_id. Vectors of different lengths score 0.

    An index of the chunks, searched exactly; where chunks are searched again and again, build
    it once with `vector_index.build`.
    """
    from folioframe.operators import vector_index as I

    return I.search(I.build(chunks, k), queries, k)


def cited(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their chunk's text and a citation struct."""
    out = hits.join(chunks.select("vec_id", "doc_id", "chunk_order", "section", "text"), "vec_id").join(documents.select("doc_id", "title", "document_number"), "doc_id", "left")
    return out.withColumn("citation", F.struct("doc_id", "title", "document_number", "section", "chunk_order", F.col("score").alias("relevance")))
