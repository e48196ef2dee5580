"""Drafting support: classification of requests, template ranking, evidence, review replay."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioframe.functions import rules as R
from folioframe.functions import text as X
from folioframe.operators import vectors as V
from folioframe.operators.metadata import is_internal
from folioframe.operators.ranking import Points, best


def classified(requests: DataFrame, intents=R.INTENTS, threshold: float = R.LOW_CONFIDENCE) -> DataFrame:
    """(request_id, document_type, confidence, requires_user_selection); equal scores go to the earlier type."""
    t = X.folded(F.col("request_text"))
    hits = lambda s: sum((F.contains(t, F.lit(x)).cast("int") for x in s), F.lit(0))
    scores = F.array(*(F.struct((hits(s) + F.when(F.contains(t, F.lit(kind.lower())), 2).otherwise(0)).alias("n"), F.lit(-i).alias("i"), F.lit(kind).alias("kind")) for i, (kind, s) in enumerate(intents.items())))
    df = requests.select("request_id", F.slice(F.sort_array(scores, asc=False), 1, 2).alias("top"))
    best, second = F.col("top")[0], F.col("top")[1]
    confidence = F.round(F.least(0.35 + best["n"] * 0.18 + F.greatest(best["n"] - second["n"], F.lit(0)) * 0.08, F.lit(0.98)), 2)
    known = best["n"] > 0
    df = df.select("request_id", F.when(known, best["kind"]).alias("document_type"), F.when(known, confidence).otherwise(0.0).alias("confidence"))
    return df.withColumn("requires_user_selection", F.col("confidence") < threshold)


def _shared(a: Column, b: Column) -> Column:
    """The first five of the words that both hold, in order."""
    return F.array_join(F.slice(F.sort_array(F.array_intersect(a, b)), 1, 5), ", ")


def _reason(texts: dict[str, str], *parts: Column) -> Column:
    joined = F.concat_ws("; ", *parts)
    return F.when(joined == "", F.lit(texts["none"])).otherwise(joined)


def ranked_documents(requests: DataFrame, documents: DataFrame, k: int = 5, texts=R.RANKING_A) -> DataFrame:
    """Ranker A: (request_id, doc_id, score, reason, rank). requests: request_id, request_text, document_type; documents with updated_at."""
    text = F.concat_ws(" ", "title", "summary", "keywords", "document_number")
    agency = X.folded(F.col("issuing_agency"))
    internal = F.coalesce(is_internal(agency), F.lit(False))
    ready = F.coalesce(F.col("status").isin("indexed", "need_review"), F.lit(False))
    none = F.lit(None).cast("string")
    cand = documents.select(
        F.col("doc_id").alias("cand_id"), F.array_distinct(X.folded_tokens(text)).alias("words"), X.folded(F.col("document_type")).alias("type"), none.alias("field"),
        (F.when(internal, 25).otherwise(0) + F.when(ready, 10).otherwise(0)).alias("extra"), F.col("updated_at").alias("at"), internal.alias("internal"),
    )
    asked = requests.select("request_id", F.array_distinct(X.folded_tokens(F.col("request_text"))).alias("words"), X.folded(F.col("document_type")).alias("type"), none.alias("field"))
    found = best(asked, cand, k, Points(35, 0, 6, 30, 100, False)).where("points > 0")
    rows = found.join(asked.select("request_id", F.col("words").alias("r_words"), F.col("type").alias("r_type")), "request_id").join(cand.select("cand_id", "words", "type", "internal"), "cand_id")
    same, shared = F.coalesce((F.col("type") == F.col("r_type")) & (F.col("type") != ""), F.lit(False)), _shared(F.col("words"), F.col("r_words"))
    reason = _reason(texts, F.when(same, texts["type"]), F.when(F.col("internal"), texts["internal"]), F.when(shared != "", F.concat(F.lit(texts["words"]), shared)))
    return rows.select("request_id", F.col("cand_id").alias("doc_id"), (F.col("points") / 100).alias("score"), reason.alias("reason"), "rank")


def ranked_templates(requests: DataFrame, templates: DataFrame, k: int = 5, texts=R.RANKING_B) -> DataFrame:
    """Ranker B: (request_id, template_id, score, reason, rank); points of 100, nothing is dropped but templates of another type than a request names. requests: request_id, request_text, document_type, field."""
    text = F.concat_ws(" ", "name", "summary", "keywords", "document_type", "field")
    ready = F.coalesce(F.col("status") == R.ANALYSED, F.lit(False))
    cand = templates.select(F.col("template_id").alias("cand_id"), F.array_distinct(X.tokens(text)).alias("words"), F.col("document_type").alias("type"), "field", F.when(ready, 8).otherwise(0).alias("extra"), F.col("created_at").alias("at"), ready.alias("ready"))
    asked = requests.select("request_id", F.array_distinct(X.tokens(F.col("request_text"))).alias("words"), F.col("document_type").alias("type"), "field")
    found = best(asked, cand, k, Points(35, 25, 8, 32, 100, True))
    rows = found.join(asked.select("request_id", *(F.col(c).alias(f"r_{c}") for c in ("words", "type", "field"))), "request_id").join(cand.select("cand_id", "words", "type", "field", "ready"), "cand_id")
    same = lambda c: (F.col(f"r_{c}") != "") & (F.col(c) == F.col(f"r_{c}"))
    shared = _shared(F.col("words"), F.col("r_words"))
    reason = _reason(texts, F.when(same("type"), texts["type"]), F.when(same("field"), texts["field"]), F.when(shared != "", F.concat(F.lit(texts["words"]), shared)), F.when(F.col("ready"), texts["ready"]))
    return rows.select("request_id", F.col("cand_id").alias("template_id"), F.col("points").alias("score"), reason.alias("reason"), "rank")


def evidence(requests: DataFrame, query_vectors: DataFrame, chunks: DataFrame, documents: DataFrame, catalogue: DataFrame, k: int = 5) -> DataFrame:
    """Evidence of each request: its k best chunks with citation and the file of the cited document's checksum.

    query_vectors: request_id, vector; chunks: vec_id, vector, doc_id, chunk_order, section, text; documents: doc_id, title, document_number, checksum.
    """
    asked = query_vectors.join(requests.select("request_id"), "request_id", "left_semi")
    hits = V.top_k(asked.select(F.col("request_id").alias("query_id"), "vector"), chunks, k)
    found = V.cited(hits, chunks, documents).join(documents.select("doc_id", "checksum"), "doc_id", "left")
    return evidence_files(found, catalogue).withColumnRenamed("query_id", "request_id")


def evidence_files(citations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Citations with the catalogue row of their checksum, one per checksum."""
    one = catalogue.groupBy("checksum").agg(F.min(F.struct("id", "title", "file_path")).alias("c")).select("checksum", F.col("c.id").alias("library_id"), F.col("c.title").alias("library_title"), F.col("c.file_path").alias("file_path"))
    return citations.join(one, "checksum", "left")


def latest_results(results: DataFrame) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy(F.desc("created_at"), F.desc("id"))
    return results.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def citation_lines(citations: DataFrame, n: int = 10) -> DataFrame:
    """(result_id, lines): the n best citations as numbered lines."""
    w = Window.partitionBy("result_id").orderBy(F.desc("score"), "citation_id")
    top = citations.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    line = F.format_string("[%d] %s (%.2f)", F.col("r"), F.coalesce("title", F.lit("")), F.col("score"))
    return top.groupBy("result_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def packages(results: DataFrame, requests: DataFrame, citations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each result with its request, citations and revisions, both in order; lists are aggregated before they are joined."""
    c = citations.groupBy("result_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "citation_id", "section"))).alias("citations"))
    r = revisions.groupBy("result_id").agg(F.sort_array(F.collect_list(F.struct("seq", "status"))).alias("revisions"))
    return results.join(requests.select("request_id", "request_text"), "request_id", "left").join(c, "result_id", "left").join(r, "result_id", "left")


def carried_over(results: DataFrame, citations: DataFrame) -> DataFrame:
    """Request-level citations copied to each result of the request."""
    return citations.where("result_id IS NULL").drop("result_id").join(results.select("request_id", "result_id"), "request_id")


def replayed(log: DataFrame, steps=R.REVIEW_STEPS, first: str = "pending_outline_review") -> DataFrame:
    """(result_id, status, n_refused): the log (result_id, seq, action) played through the legal steps; an action that is not legal is refused and changes nothing.

    The log is dealt by ranges of (result_id, seq, action), so a long one spans many partitions.
    Each partition reduces its part of a result's log to one row: the state after it and the
    number refused, from each of the few states. A result's rows, one per partition, are then
    met in order.
    """
    states = list(dict.fromkeys([first, *(s for now, _, then in steps for s in (now, then))]))
    place = {s: i for i, s in enumerate(states)}
    legal = {}
    for now, act, then in reversed(list(steps)):  # the first of equal steps counts
        legal.setdefault(act, {})[place[now]] = place[then]
    start = tuple(range(len(states)))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        known, row = False, None  # row: result, state after each start, refused since each start
        moves = {a: [(m.get(s, s), int(s not in m)) for s in start] for a, m in legal.items()}
        refused = [(s, 1) for s in start]
        done = []

        def out(rows):
            ids, after, n = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([part] * len(rows), pa.int32()), pa.array(after, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))], ["result_id", "part", "after", "refused"])

        for batch in batches:
            kind = batch.schema.field("result_id").type
            for key, act in zip(batch.column("result_id").to_pylist(), batch.column("action").to_pylist()):
                if not known or key != row[0]:
                    if known:
                        done.append(row)
                    known, row = True, (key, list(start), [0] * len(start))
                move, (_, after, n) = moves.get(act, refused), row
                for k, s in enumerate(after):
                    after[k], more = move[s]
                    n[k] += more
            if len(done) >= 4096:
                yield out(done)
                done = []
        if known:
            yield out([*done, row])

    dealt = log.select("result_id", "seq", "action").repartitionByRange("result_id", "seq", "action").sortWithinPartitions("result_id", "seq", "action")
    key = T.StructField("result_id", log.schema["result_id"].dataType)
    kept = T.StructType([key, T.StructField("part", T.IntegerType()), T.StructField("after", T.ArrayType(T.IntegerType())), T.StructField("refused", T.ArrayType(T.LongType()))])
    parts = dealt.select("result_id", "action").mapInArrow(reduced, kept)
    gathered = parts.groupBy("result_id").agg(F.sort_array(F.collect_list(F.struct("part", "after", "refused"))).alias("parts"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate("parts", zero, lambda s, p: F.struct(F.get(p["after"], s["at"]).alias("at"), (s["n"] + F.get(p["refused"], s["at"])).alias("n")))
    names = F.array(*map(F.lit, states))
    return gathered.select("result_id", fold.alias("f")).select("result_id", F.get(names, F.col("f.at")).alias("status"), F.col("f.n").cast("int").alias("n_refused"))
