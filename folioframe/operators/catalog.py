"""Document catalogue: search, scan states, duplicates, upserts, missing files, filters and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.functions import rules as R
from folioframe.functions.text import ascii_like, file_stem, first_non_empty
from folioframe.operators.tasks import positive

REVIEWABLE = ["title", "document_type", "document_number", "issued_date", "issuing_agency", "signer", "summary", "keywords", "field", "status"]


def search(documents: DataFrame, *, status=None, file_ext=None, document_type=None, field=None, issuing_agency=None, year: int | None = None, keyword: str | None = None, limit: int = 500) -> DataFrame:
    """Filters that are given, newest first."""
    for name, value in (("status", status), ("file_ext", file_ext), ("document_type", document_type), ("field", field), ("issuing_agency", issuing_agency)):
        if value:
            documents = documents.where(F.col(name) == value)
    if year:
        documents = documents.where(F.year("issued_date") == year)
    if keyword:
        hit = F.lit(False)
        for name in ("title", "file_name", "document_number", "summary", "keywords"):
            hit = hit | ascii_like(F.col(name), F.lit(f"%{keyword}%"))
        documents = documents.where(hit)
    return documents.orderBy(F.desc("updated_at"), F.desc("id")).limit(positive(limit))


def by_key(df: DataFrame, **key) -> DataFrame:
    for name, value in key.items():
        df = df.where(F.col(name) == value)
    return df


def scan_states(scanned: DataFrame, catalogue: DataFrame) -> DataFrame:
    """scanned (path, checksum, ...) with state: existing, changed or new."""
    known = catalogue.select(F.col("file_path").alias("path"), F.col("checksum").alias("__old"))
    state = F.when(F.col("__old").isNull() & F.col("__known").isNull(), "new").when(F.col("__old") == F.col("checksum"), "existing").otherwise("changed")
    return scanned.join(known.withColumn("__known", F.lit(True)), "path", "left").withColumn("state", state).drop("__old", "__known")


def duplicates(incoming: DataFrame, catalogue: DataFrame) -> DataFrame:
    """incoming (path, checksum, ...) with duplicate_of, the lowest catalogue id of another path, and is_duplicate.

    Rows are compared by (checksum) keys only; a checksum that a third of all rows share is
    reduced by partial aggregation, never gathered.
    """
    first = catalogue.groupBy("checksum").agg(F.min("id").alias("__1"))
    second = catalogue.select("id", "checksum").join(first, "checksum").where("id > __1").groupBy("checksum").agg(F.min("id").alias("__2"))
    own = catalogue.select(F.col("file_path").alias("path"), F.col("checksum").alias("__own"), F.col("id").alias("__id"))
    path = incoming.groupBy("checksum").agg(F.min("path").alias("__path"))
    out = incoming.join(own, "path", "left").join(first, "checksum", "left").join(second, "checksum", "left").join(path, "checksum", "left")
    # The row's own catalogue entry does not count: where it holds the lowest id, the next one is named.
    mine = F.coalesce((F.col("__own") == F.col("checksum")) & (F.col("__id") == F.col("__1")), F.lit(False))
    out = out.withColumn("duplicate_of", F.when(mine, F.col("__2")).otherwise(F.col("__1")))
    out = out.withColumn("is_duplicate", F.col("duplicate_of").isNotNull() | (F.col("__path") < F.col("path")))
    return out.select(*incoming.columns, "duplicate_of", "is_duplicate")


def duplicates_within(documents: DataFrame, key: str, order: str) -> DataFrame:
    """documents with first_id, the smallest `order` of their key, and is_duplicate; the key's group is never gathered."""
    first = documents.groupBy(key).agg(F.min(order).alias("first_id"))
    return documents.join(first, key).withColumn("is_duplicate", F.col(order) > F.col("first_id"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old overlaid by new on key; nulls of new never overwrite.

    Of several rows of new of one key the last by the column order counts, of equal ones the
    greatest as JSON; without an order, keys of new must differ.
    """
    if order is not None:
        new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.struct(order, F.to_json(F.struct(*new.columns)))).alias("__last")).select("__last.*")
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    o = old.select(F.col(key), F.struct(*old.columns).alias("__o"))
    n = new.select(F.col(key), F.struct(*new.columns).alias("__n"))
    pick = lambda c: F.coalesce(*([F.col(f"__n.{c}")] if c in new.columns else []), *([F.col(f"__o.{c}")] if c in old.columns else []))
    return o.join(n, key, "full_outer").select(*(F.col(key) if c == key else pick(c).alias(c) for c in columns))


def missing(catalogue: DataFrame, scanned: DataFrame, root: str) -> DataFrame:
    """Catalogue rows below root whose file is gone and that are not deleted yet."""
    under = catalogue.where(F.startswith("file_path", F.lit(root.rstrip("/") + "/")) & (F.col("status") != "deleted"))
    return under.join(scanned.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the children of new's parents, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def status_of_reading(status: Column) -> Column:
    return F.when(status == "read", "need_review").when(status.isin("need_ocr", "unsupported"), status).otherwise("failed")


def counts_by(documents: DataFrame, column: str) -> DataFrame:
    return documents.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def filter_values(documents: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value): distinct non-empty values of all columns, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns)))
    return documents.select(pairs.alias("x")).select("x.*").where("value IS NOT NULL AND value <> ''").distinct()


def tiles(documents: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return documents.agg(F.count(F.lit(1)).alias("total"), n("need_review", "indexed").alias("indexed"), n("new").alias("new"), n("failed").alias("failed"), n("duplicate").alias("duplicate"))


def corrected(documents: DataFrame, corrections: DataFrame) -> DataFrame:
    """Review corrections on id: allowed columns only, the status becomes indexed unless given."""
    allowed = [c for c in REVIEWABLE if c in corrections.columns]
    fix = corrections.select("id", F.struct(*allowed).alias("__fix")).dropDuplicates(["id"])
    out = documents.join(fix, "id", "left")
    for c in [c for c in REVIEWABLE if c in documents.columns]:
        given = F.col(f"__fix.{c}") if c in allowed else F.lit(None)
        given = F.coalesce(given, F.when(F.col("__fix").isNotNull(), F.lit("indexed"))) if c == "status" else given
        out = out.withColumn(c, F.coalesce(given, F.col(c)))
    return out.drop("__fix")


def keyword_weights(documents: DataFrame) -> DataFrame:
    """(id, keyword, weight) from comma-joined keywords: 10 less the place, at least 1."""
    parts = documents.select("id", F.posexplode(F.split("keywords", ",")).alias("pos", "keyword")).withColumn("keyword", F.trim("keyword")).where("keyword <> ''")
    return parts.groupBy("id", "keyword").agg(F.max(F.greatest(F.lit(1), 10 - F.col("pos"))).cast("double").alias("weight"))


def knowledge_rows(catalogue: DataFrame) -> DataFrame:
    """Knowledge documents from catalogue rows; the title falls back to the file name, then to a constant."""
    meta = F.to_json(F.struct("summary", "keywords", "issuing_agency", "signer"))
    return catalogue.select(
        F.col("id").alias("library_document_id"), first_non_empty(F.col("title"), F.col("file_name"), F.lit(R.UNTITLED)).alias("title"), "document_type", "document_number", "field",
        F.col("checksum").alias("source_checksum"), meta.alias("metadata_json"),
    )


def parsed_metadata(raw: Column, schema: str = "summary string, keywords string, issuing_agency string, signer string") -> Column:
    """The JSON object, or an empty one where the text is none."""
    return F.coalesce(F.from_json(raw, schema, {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), schema))


def ingest_plan(documents: DataFrame, state: DataFrame) -> DataFrame:
    """documents (library_document_id, source_checksum, ...) with action: skip, index or fail (empty text)."""
    known = state.select("library_document_id", F.col("checksum").alias("__c"), F.col("status").alias("__s"))
    same = (F.col("__c") == F.col("source_checksum")) & (F.col("__s") == "indexed")
    action = F.when(F.coalesce(same, F.lit(False)), "skip").when(F.trim(F.coalesce("text", F.lit(""))) == "", "fail").otherwise("index")
    return documents.join(known, "library_document_id", "left").withColumn("action", action).drop("__c", "__s")


def state_upsert(state: DataFrame, outcome: DataFrame, now: Column) -> DataFrame:
    """Index state after a run; last_indexed_at moves on indexed rows only."""
    new = outcome.select("library_document_id", "checksum", "status").withColumn("last_indexed_at", F.when(F.col("status") == "indexed", now))
    return upsert(state, new, "library_document_id")


def deleted_sync(state: DataFrame, catalogue: DataFrame) -> DataFrame:
    """State rows whose source is gone or deleted become deleted."""
    source = catalogue.select(F.col("id").alias("library_document_id"), F.col("status").alias("__s"))
    gone = F.col("__s").isNull() | (F.col("__s") == "deleted")
    return state.join(source, "library_document_id", "left").withColumn("status", F.when(gone, "deleted").otherwise(F.col("status"))).drop("__s")


def sync_counts(plan: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a)
    return plan.agg(F.count(F.lit(1)).alias("total"), (n("index") + n("fail")).alias("processed"), n("skip").alias("skipped"), n("index").alias("indexed"), n("fail").alias("failed"))


def last_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the last by order."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def titled_relations(relations: DataFrame, documents: DataFrame, how: str = "left") -> DataFrame:
    """Relations with both documents' titles."""
    title = lambda side: documents.select(F.col("id").alias(f"{side}_id"), F.col("title").alias(f"{side}_title"))
    return relations.join(title("source"), "source_id", how).join(title("target"), "target_id", how)


def touching(relations: DataFrame, document_id: int) -> DataFrame:
    return relations.where((F.col("source_id") == document_id) | (F.col("target_id") == document_id))


def stem_title(file_name: Column) -> Column:
    return file_stem(file_name)
