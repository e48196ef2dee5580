"""Catalogue, structure, knowledge, metadata and drafting over the driver's tables: documents are the catalogue (field lang, agency source), user turns are requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import rules as R
from folioframe.functions import text as X
from folioframe.operators import catalog as C
from folioframe.operators import drafting as D
from folioframe.operators import knowledge as K
from folioframe.operators import maintained as MA
from folioframe.operators import metadata as M
from folioframe.operators import structure as S
from folioframe.operators import vectors as V
from folioframe.plans.registry import query
from folioframe.plans.task_queries import table

#: Rules with words of these texts; the default tables are Vietnamese.
SECTIONS = [("Licence", r"^Licensed|^Released"), ("Table", r"\|"), ("Opening", r"^(The|La|Der|El) ")]
FIELDS = {"apache": ["apache", "version 2.0"], "mit": ["mit license"], "gnu": ["gnu", "public license"], "common": [" the ", " and "]}
INTENTS = {"Report": [" the ", " of ", " in "], "Letter": [" la ", " de "], "Plan": [" der ", " die "], "Notice": [" el ", " que "]}
STOP = ["the", "and", "for"]
STATUSES = [("src0", "indexed"), ("src1", "failed"), ("src2", "duplicate"), ("src3", "deleted"), ("src4", "new")]


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    status = F.coalesce(*(F.when(F.col("source") == s, v) for s, v in STATUSES), F.lit("need_review"))
    word = lambda i: F.get(F.split("text", " "), F.lit(i))
    keywords = F.concat_ws(" ,, ", word(0), word(3), word(1), F.lit("a"))  # with blanks and empty ones among them
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "doc_id", F.substring_index("text", ".", 1).alias("title"), F.concat("doc_id", F.lit(".txt")).alias("file_name"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"),
        F.lit("txt").alias("file_ext"), F.sha2("text", 256).alias("checksum"), F.col("lang").alias("document_type"), F.concat("source", F.lit("-"), "n_chars").alias("document_number"), F.col("source").alias("issuing_agency"),
        F.col("lang").alias("field"), F.lit("").alias("summary"), keywords.alias("keywords"), status.alias("status"), F.col("doc_id").alias("updated_at"), "text", "n_chars",
    )


CAT = """cat AS (SELECT doc_id AS id, doc_id, split_part(text, '.', 1) AS title, doc_id || '.txt' AS file_name, source || '/' || doc_id || '.txt' AS file_path, sha256(text) AS checksum, lang AS document_type, source || '-' || n_chars AS document_number,
  source AS issuing_agency, lang AS field, concat_ws(' ,, ', string_split(text, ' ')[1], string_split(text, ' ')[4], string_split(text, ' ')[2], 'a') AS keywords, CASE source WHEN 'src0' THEN 'indexed' WHEN 'src1' THEN 'failed' WHEN 'src2' THEN 'duplicate' WHEN 'src3' THEN 'deleted' WHEN 'src4' THEN 'new' ELSE 'need_review' END AS status, text, n_chars FROM documents)"""


@query("a2_checksums", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def _(spark, d):
    return catalogue(spark, d).select("doc_id", "checksum")


_OLD = "old AS (SELECT file_path, CASE WHEN issuing_agency = 'src3' THEN 'stale' ELSE checksum END AS checksum FROM cat WHERE field <> 'es')"


def _scan(spark, d):
    c = catalogue(spark, d)
    old = c.where("field <> 'es'").select("file_path", F.when(F.col("issuing_agency") == "src3", "stale").otherwise(F.col("checksum")).alias("checksum"))
    return C.scan_states(c.select(F.col("file_path").alias("path"), "checksum"), old)


@query("a3_scan_states", f"WITH {CAT}, {_OLD} SELECT cat.file_path AS path, cat.checksum, CASE WHEN old.file_path IS NULL THEN 'new' WHEN old.checksum = cat.checksum THEN 'existing' ELSE 'changed' END AS state FROM cat LEFT JOIN old USING (file_path)")
def _(spark, d):
    return _scan(spark, d)


@query("a4_scan_report", f"""WITH {CAT}, {_OLD}, x AS (SELECT CASE WHEN cat.file_path LIKE 'src9/%' THEN 'ignored' WHEN cat.file_path LIKE 'src8/%' THEN 'unsupported' ELSE 'accepted' END AS class, cat.checksum AS now, old.checksum AS was, old.file_path AS p FROM cat LEFT JOIN old USING (file_path))
  SELECT count(*) AS total, count(*) FILTER (class = 'accepted') AS accepted, count(*) FILTER (class = 'ignored') AS ignored, count(*) FILTER (class = 'unsupported') AS unsupported, count(*) FILTER (p IS NULL) AS new, count(*) FILTER (was <> now) AS changed, count(*) FILTER (was = now) AS existing FROM x""")
def _(spark, d):
    from folioframe.sources.files import scan_report

    kind = F.when(F.startswith("path", F.lit("src9/")), "ignored").when(F.startswith("path", F.lit("src8/")), "unsupported").otherwise("accepted")
    return scan_report(_scan(spark, d).withColumn("scan_class", kind))


@query("a7_catalogue_upsert", f"""WITH {CAT}, o AS (SELECT file_path, title, status FROM cat WHERE field <> 'es'), n AS (SELECT file_path, CASE WHEN field = 'fr' THEN NULL ELSE 'new ' || title END AS title, 'indexed' AS status, checksum FROM cat WHERE field <> 'de')
  SELECT file_path, coalesce(n.title, o.title) AS title, coalesce(n.status, o.status) AS status, checksum FROM o FULL JOIN n USING (file_path)""")
def _(spark, d):
    c = catalogue(spark, d)
    new = c.where("field <> 'de'").select("file_path", F.when(F.col("field") != "fr", F.concat(F.lit("new "), "title")).alias("title"), F.lit("indexed").alias("status"), "checksum")
    return C.upsert(c.where("field <> 'es'").select("file_path", "title", "status"), new, "file_path")


@query("a8_duplicates", f"""WITH {CAT}, c AS (SELECT * FROM cat WHERE field <> 'en' OR n_chars > 1000), i AS (SELECT file_path AS path, checksum FROM cat),
  h AS (SELECT i.path, min(c.id) AS duplicate_of FROM i JOIN c ON c.checksum = i.checksum AND c.file_path <> i.path GROUP BY 1), f AS (SELECT checksum, min(path) AS p FROM i GROUP BY 1)
  SELECT i.path, i.checksum, duplicate_of, duplicate_of IS NOT NULL OR f.p < i.path AS is_duplicate FROM i LEFT JOIN h USING (path) JOIN f USING (checksum)""")
def _(spark, d):
    c = catalogue(spark, d)
    return C.duplicates(c.select(F.col("file_path").alias("path"), "checksum"), c.where("field <> 'en' OR n_chars > 1000"))


@query("a8_copies_within", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, doc_id > min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents")
def _(spark, d):
    return C.duplicates_within(catalogue(spark, d).select("doc_id", "checksum"), "checksum", "doc_id").drop("checksum")


@query("a9_missing_files", f"WITH {CAT} SELECT id, file_path FROM cat WHERE file_path LIKE 'src1/%' AND status <> 'deleted' AND field = 'de'")
def _(spark, d):
    c = catalogue(spark, d)
    return C.missing(c, c.where("field <> 'de'").select(F.col("file_path").alias("path")), "src1").select("id", "file_path")


_STATE = "st AS (SELECT id AS library_document_id, CASE WHEN field = 'fr' THEN 'stale' ELSE checksum END AS checksum, CASE WHEN field = 'de' THEN 'failed' ELSE 'indexed' END AS status FROM cat WHERE field <> 'es')"
_PLAN = "plan AS (SELECT id AS library_document_id, CASE WHEN st.checksum = cat.checksum AND st.status = 'indexed' THEN 'skip' WHEN trim(text) = '' THEN 'fail' ELSE 'index' END AS action FROM cat LEFT JOIN st ON library_document_id = id)"


def _state(spark, d):
    return catalogue(spark, d).where("field <> 'es'").select(F.col("id").alias("library_document_id"), F.when(F.col("field") == "fr", "stale").otherwise(F.col("checksum")).alias("checksum"), F.when(F.col("field") == "de", "failed").otherwise("indexed").alias("status"))


def _plan(spark, d):
    return C.ingest_plan(catalogue(spark, d).select(F.col("id").alias("library_document_id"), F.col("checksum").alias("source_checksum"), "text"), _state(spark, d))


@query("a11_ingest_plan", f"WITH {CAT}, {_STATE}, {_PLAN} SELECT * FROM plan")
def _(spark, d):
    return _plan(spark, d).select("library_document_id", "action")


@query("d9_sync_counts", f"WITH {CAT}, {_STATE}, {_PLAN} SELECT count(*) AS total, count(*) FILTER (action <> 'skip') AS processed, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'index') AS indexed, count(*) FILTER (action = 'fail') AS failed FROM plan")
def _(spark, d):
    return C.sync_counts(_plan(spark, d))


@query("a12_state_upsert", f"""WITH {CAT}, {_STATE}, n AS (SELECT id AS library_document_id, checksum, CASE WHEN n_chars < 100 THEN 'failed' ELSE 'indexed' END AS status FROM cat WHERE field <> 'en')
  SELECT library_document_id, coalesce(n.checksum, st.checksum) AS checksum, coalesce(n.status, st.status) AS status, CASE WHEN n.status = 'indexed' THEN '2024-01-02' WHEN st.library_document_id IS NOT NULL THEN '2024-01-01' END AS last_indexed_at FROM st FULL JOIN n USING (library_document_id)""")
def _(spark, d):
    out = catalogue(spark, d).where("field <> 'en'").select(F.col("id").alias("library_document_id"), "checksum", F.when(F.col("n_chars") < 100, "failed").otherwise("indexed").alias("status"))
    return C.state_upsert(_state(spark, d).withColumn("last_indexed_at", F.lit("2024-01-01")), out, F.lit("2024-01-02"))


@query("a13_deleted_sync", f"WITH {CAT}, {_STATE} SELECT library_document_id, CASE WHEN cat.id IS NULL OR cat.status = 'deleted' THEN 'deleted' ELSE st.status END AS status FROM st LEFT JOIN (SELECT * FROM cat WHERE issuing_agency <> 'src7') cat ON cat.id = library_document_id")
def _(spark, d):
    return C.deleted_sync(_state(spark, d), catalogue(spark, d).where("issuing_agency <> 'src7'")).select("library_document_id", "status")


@query("a14_replace_children", "SELECT l_orderkey AS parent, l_linenumber AS child, 'old' AS gen FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, 'new' FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    old = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"), F.lit("old").alias("gen"))
    return C.replace_children(old, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("parent"), F.lit(1).alias("child"), F.lit("new").alias("gen")), "parent")


@query("a17_json_metadata", "SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", C.parsed_metadata(F.col("props"), "k int")["k"].alias("k"))


@query("a18_knowledge_rows", f"WITH {CAT} SELECT id AS library_document_id, coalesce(nullif(title, ''), file_name) AS title, document_type, document_number, field, checksum AS source_checksum FROM cat")
def _(spark, d):
    return C.knowledge_rows(catalogue(spark, d).withColumn("signer", F.lit(None).cast("string"))).drop("metadata_json")


@query("b1_catalogue_search", f"WITH {CAT} SELECT id, title, status FROM cat WHERE field = 'en' AND status = 'need_review' AND (title ILIKE '%the%' OR file_name ILIKE '%the%' OR document_number ILIKE '%the%' OR keywords ILIKE '%the%') ORDER BY id DESC LIMIT 500")
def _(spark, d):
    return C.search(catalogue(spark, d), field="en", status="need_review", keyword="the").select("id", "title", "status")


@query("b2_year_filter", "SELECT o_orderkey AS id FROM orders WHERE year(o_orderdate) = 1997 ORDER BY o_orderkey DESC LIMIT 500")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("issued_date"), F.col("o_orderkey").alias("updated_at"))
    return C.search(o, year=1997).select("id")


@query("b18_review_corrections", f"WITH {CAT} SELECT id, CASE WHEN n_chars < 500 THEN 'checked ' || title ELSE title END AS title, CASE WHEN n_chars < 500 THEN 'indexed' ELSE status END AS status FROM cat")
def _(spark, d):
    c = catalogue(spark, d)
    return C.corrected(c, c.where("n_chars < 500").select("id", F.concat(F.lit("checked "), "title").alias("title"))).select("id", "title", "status")


_WEIGHTS = """SELECT id, trim(k) AS keyword, max(greatest(1, 10 - p))::DOUBLE AS weight FROM (SELECT id, unnest(string_split(keywords, ',')) AS k, generate_subscripts(string_split(keywords, ','), 1) - 1 AS p FROM {}) WHERE trim(k) <> '' GROUP BY 1, 2"""


@query("f27_keyword_weights", f"WITH {CAT} {_WEIGHTS.format('cat')}")
def _(spark, d):
    return C.keyword_weights(catalogue(spark, d))


@query("b18_corrected_keywords", f"WITH {CAT}, fixed AS (SELECT id, CASE WHEN n_chars < 500 THEN 'checked, ' || keywords ELSE keywords END AS keywords FROM cat) {_WEIGHTS.format('fixed')}")
def _(spark, d):
    """Keywords are derived again from what a correction has left."""
    c = catalogue(spark, d)
    return C.keyword_weights(C.corrected(c, c.where("n_chars < 500").select("id", F.concat(F.lit("checked, "), "keywords").alias("keywords"))))


@query("d3_counts_by_status", f"WITH {CAT} SELECT status, count(*) AS n FROM cat GROUP BY 1")
def _(spark, d):
    return C.counts_by(catalogue(spark, d), "status")


FILTERS = ["status", "file_ext", "document_type", "field", "issuing_agency"]


@query("d4_filter_values", f"WITH {CAT}, c AS (SELECT *, 'txt' AS file_ext FROM cat) " + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS name, {c} AS value FROM c" for c in FILTERS))
def _(spark, d):
    return C.filter_values(catalogue(spark, d), FILTERS)


@query("d10_catalogue_tiles", f"WITH {CAT} SELECT count(*) AS total, count(*) FILTER (status IN ('need_review', 'indexed')) AS indexed, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'duplicate') AS duplicate FROM cat")
def _(spark, d):
    return C.tiles(catalogue(spark, d))


_AFTER = f"""{CAT}, after AS (
    SELECT CASE WHEN field = 'de' THEN status ELSE 'indexed' END AS status, 'txt' AS file_ext, document_type, field, issuing_agency
    FROM cat WHERE issuing_agency <> 'src3'
  )"""


def _followed(spark: SparkSession, d: str, view: MA.View) -> DataFrame:
    """The view's state after an upsert and a deletion of catalogue rows: the one before, and the change's part in it."""
    c = catalogue(spark, d).select("file_path", *FILTERS)
    old = c.where("field <> 'es'")
    new = c.where("field <> 'de'").withColumn("status", F.lit("indexed"))
    before, after = MA.change_rows(old, new, c.where("issuing_agency = 'src3'").select("file_path"), "file_path")
    return MA.merged(view, MA.state(view, old), MA.part(view, before, after))


@query("d3_maintained_counts", f"WITH {_AFTER} SELECT status, count(*) AS n FROM after GROUP BY 1")
def _(spark, d):
    return _followed(spark, d, MA.by_column("status"))


@query("d4_maintained_values", f"WITH {_AFTER} " + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS value, count(*) AS n FROM after GROUP BY ALL" for c in FILTERS))
def _(spark, d):
    return _followed(spark, d, MA.filter_values_view(FILTERS))


@query("d10_maintained_tiles", f"""WITH {_AFTER} SELECT count(*) AS total, count(*) FILTER (status IN ('need_review', 'indexed')) AS indexed, count(*) FILTER (status = 'new') AS new,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'duplicate') AS duplicate FROM after""")  # fmt: skip
def _(spark, d):
    return MA.tiles_of(_followed(spark, d, MA.by_column("status")))


WORDS = "regexp_extract_all(lower(text), '[0-9A-Za-zÀ-ỹ]+')"
KEYS = f"""tok AS (SELECT doc_id, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS pos FROM documents), cnt AS (SELECT doc_id, w, count(*) AS n, min(pos) AS f FROM tok WHERE length(w) >= 3 AND w NOT IN ('the', 'and', 'for') GROUP BY 1, 2),
  keys AS (SELECT doc_id, w AS keyword, least(n + 1, 10)::DOUBLE AS weight FROM cnt QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) <= 20)"""


@query("d5_keyword_weights", f"WITH {KEYS} SELECT * FROM keys")
def _(spark, d):
    return K.keyword_weights(table(spark, d, "documents"), stopwords=STOP)


@query("d6_best_field", """WITH s AS (SELECT doc_id, contains(lower(text), 'apache')::INT + contains(lower(text), 'version 2.0')::INT AS a, contains(lower(text), 'mit license')::INT AS m, contains(lower(text), 'gnu')::INT + contains(lower(text), 'public license')::INT AS g, contains(lower(text), ' the ')::INT + contains(lower(text), ' and ')::INT AS c FROM documents)
  SELECT doc_id, CASE WHEN greatest(a, m, g, c) = 0 THEN NULL WHEN a = greatest(a, m, g, c) THEN 'apache' WHEN m = greatest(a, m, g, c) THEN 'mit' WHEN g = greatest(a, m, g, c) THEN 'gnu' ELSE 'common' END AS field FROM s""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.best_field(F.col("text"), FIELDS).alias("field"))


@query("f_text_functions", """SELECT doc_id, len(regexp_extract_all(lower(text), '[0-9A-Za-zÀ-ỹ]+')) AS n_tokens, sha256(trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '\\s+', ' ', 'g'))) AS folded_sha,
  sha256(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g')) AS space_sha FROM documents""")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(t)).alias("n_tokens"), F.sha2(X.folded(t), 256).alias("folded_sha"), F.sha2(X.normalized_space(t), 256).alias("space_sha"))


LINES = """raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents), lines AS (
  SELECT doc_id, trim(l) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS ln, len(regexp_extract_all(lower(l), '[0-9A-Za-zÀ-ỹ]+')) AS n,
    CASE WHEN regexp_matches(trim(l), '(?i)^Licensed|^Released') THEN 'Licence' WHEN regexp_matches(trim(l), '\\|') THEN 'Table' WHEN regexp_matches(trim(l), '(?i)^(The|La|Der|El) ') THEN 'Opening' END AS opens FROM raw WHERE trim(l) <> '')"""


@query("g1_sections_of_lines", f"WITH {LINES} SELECT opens AS section, count(*) AS n FROM lines GROUP BY 1")
def _(spark, d):
    lines = table(spark, d, "documents").select(F.explode(X.lines(F.col("text"))).alias("line"))
    return lines.select(S.section_of(F.col("line"), SECTIONS).alias("section")).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("g2_chunks", f"""WITH RECURSIVE {LINES}, walk AS (
  SELECT doc_id, ln, line, n, 1 AS chunk_order, n AS total, coalesce(opens, 'body') AS section FROM lines WHERE ln = 1 UNION ALL
  SELECT l.doc_id, l.ln, l.line, l.n, w.chunk_order + (l.opens IS NOT NULL OR w.total + l.n > 180)::INT, CASE WHEN l.opens IS NOT NULL OR w.total + l.n > 180 THEN l.n ELSE w.total + l.n END, coalesce(l.opens, w.section) FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.ln = w.ln + 1)
  SELECT doc_id, chunk_order::INT AS chunk_order, section, sha256(string_agg(line, chr(10) ORDER BY ln)) AS text_sha, sum(n)::INT AS token_count FROM walk GROUP BY doc_id, chunk_order, section""")
def _(spark, d):
    return S.chunks(table(spark, d, "documents"), SECTIONS).select("doc_id", "chunk_order", "section", F.sha2("text", 256).alias("text_sha"), "token_count")


@query("g6_format_signals", """SELECT doc_id, contains(lower(text), 'cộng hòa xã hội chủ nghĩa việt nam') AS has_national_header, contains(lower(text), 'độc lập') AND contains(lower(text), 'tự do') AND contains(lower(text), 'hạnh phúc') AS has_motto,
  contains(lower(text), 'số:') OR contains(lower(text), 'số ') AS has_document_number, contains(lower(text), 'kính gửi') OR contains(lower(text), 'nơi nhận') AS has_recipient, contains(lower(text), 'người ký') OR contains(lower(text), 'trưởng ban') OR contains(lower(text), 'kt.') AS has_signature_block FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in S.format_signals(F.col("text")).items()))


@query("g8_missing_information", "SELECT conv_id * 1000 + turn AS request_id, list_filter([CASE WHEN NOT contains(lower(text), ' the ') THEN 'english' END, CASE WHEN NOT (contains(lower(text), ' la ') OR contains(lower(text), ' der ')) THEN 'other' END], lambda x: x IS NOT NULL) AS missing FROM conversations WHERE role = 'user'")
def _(spark, d):
    need = {"any": {"english": [" the "], "other": [" la ", " der "]}}
    return S.missing_information(requests(spark, d).withColumn("document_type", F.lit("none")), need)


@query("g9_format_review", """SELECT doc_id AS draft_id, unnest(['period', 'licence', 'Dung lượng nội dung']) AS name, unnest([contains(lower(text), '.'), contains(lower(text), 'license'), length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) >= 200]) AS ok FROM documents""")
def _(spark, d):
    return S.format_review(table(spark, d, "documents").select(F.col("doc_id").alias("draft_id"), F.col("text").alias("content")), [("period", "."), ("licence", "LICENSE")])


@query("g10_extracted_metadata")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("doc_id", F.lit("_note.txt")).alias("file_name"), "text")
    return S.extracted_metadata(docs, fields=FIELDS)


@query("g5_template_sections", f"""WITH {LINES}, k AS (SELECT doc_id, line, ln, CASE WHEN contains(lower(line), 'licensed') THEN 'Licence' WHEN contains(line, '|') THEN 'Table' WHEN line = upper(line) AND line <> lower(line) AND length(line) <= 120 THEN 'Tiêu đề' END AS kind FROM lines),
  g AS (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY ln) AS grp FROM k), p AS (SELECT doc_id, grp, coalesce(any_value(kind), 'Mở đầu') AS section_type, coalesce(any_value(left(line, 120)) FILTER (kind IS NOT NULL), 'Mở đầu') AS title, coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (kind IS NULL), '') AS content, count(*) FILTER (kind IS NULL) AS n FROM g GROUP BY 1, 2),
  q AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most, max(grp) OVER (PARTITION BY doc_id) AS last FROM p UNION ALL SELECT doc_id, 0, 'Mở đầu', 'Mở đầu', '', 0, 0, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lines))
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp)::INT AS section_order, section_type, title, content FROM q WHERE n > 0 OR (most = 0 AND grp = last) QUALIFY section_order <= 20""")
def _(spark, d):
    return S.template_sections(table(spark, d, "documents"), [("Licensed", "Licence"), ("|", "Table")])


@query("g11_analysed_templates")
def _(spark, d):
    return S.analysed_templates(table(spark, d, "documents").select("doc_id", F.col("source").alias("name"), "text"))


_STOP = ", ".join(f"'{w}'" for w in R.KNOWLEDGE_STOPWORDS)
_NUMBERS = r"regexp_extract_all(text, '\b\d{1,4}[-/][A-Za-zÀ-ỹ0-9./-]+')"
ENTITIES = f"""{CAT}, tok AS (SELECT doc_id, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS pos FROM documents), cnt AS (SELECT doc_id, w, count(*) AS n, min(pos) AS f FROM tok WHERE length(w) >= 3 AND w NOT IN ({_STOP}) GROUP BY 1, 2),
  keys AS (SELECT doc_id, w, least(n + 1, 10)::DOUBLE AS weight FROM cnt QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) <= 20),
  e AS (SELECT doc_id, 0 AS pos, 'document_type' AS entity_type, document_type AS entity_value, 8.0::DOUBLE AS weight FROM cat UNION ALL SELECT doc_id, 1, 'document_number', document_number, 10.0 FROM cat UNION ALL SELECT doc_id, 2, 'agency', issuing_agency, 8.0 FROM cat UNION ALL SELECT doc_id, 4, 'field', field, 7.0 FROM cat
    UNION ALL SELECT doc_id, 5, 'keyword', w, weight FROM keys UNION ALL SELECT doc_id, 6 + generate_subscripts({_NUMBERS}, 1), 'reference_number', unnest({_NUMBERS}), 5.0 FROM documents)"""
VALUES = f"{KEYS}, vals AS (SELECT DISTINCT doc_id, keyword AS v FROM keys), idx AS (SELECT doc_id, v FROM vals)"
_PAIRS = "pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, array_to_string(list_sort(list(v))[1:8], ', ') AS evidence FROM idx a JOIN idx b USING (v) WHERE a.doc_id < b.doc_id GROUP BY 1, 2)"
PAIRS = f"{VALUES}, {_PAIRS}"
ALL_PAIRS = f"{ENTITIES}, idx AS (SELECT DISTINCT doc_id, lower(entity_value) AS v FROM e), {_PAIRS}"


def _values(spark, d):
    return K.keyword_weights(table(spark, d, "documents"), stopwords=STOP).select("doc_id", F.col("keyword").alias("entity_value"))


def _entities(spark, d):
    c = catalogue(spark, d).select("doc_id", "text", "document_type", "document_number", "issuing_agency", F.lit(None).cast("string").alias("signer"), "field")
    return K.entities(c, FIELDS)


def _all_values(spark, d):
    """All entity values: type, number, agency, signer, field, keywords and reference numbers."""
    return _entities(spark, d).select("doc_id", "entity_value")


@query("c7_shared_values", f"WITH {PAIRS} SELECT * FROM pairs")
def _(spark, d):
    return K.shared_values(_values(spark, d))


@query("c7_value_members", f"WITH {VALUES} SELECT doc_id, v, count(*) OVER (PARTITION BY v) AS n_documents FROM idx")
def _(spark, d):
    """The same links as c7_shared_values by classes: every value that a document holds, and how many hold it."""
    return K.value_members(_values(spark, d))


@query("c7_all_shared_values", f"WITH {ALL_PAIRS} SELECT * FROM pairs")
def _(spark, d):
    """Every pair of documents with a common value, however many documents hold it."""
    return K.shared_values(_all_values(spark, d))


@query("g4_entities", f"WITH {ENTITIES} SELECT doc_id, entity_type, min_by(entity_value, pos) AS entity_value, max(weight) AS weight FROM e GROUP BY doc_id, entity_type, lower(entity_value)")
def _(spark, d):
    return _entities(spark, d)


#: Types of the relation rules, by language; the field is the source and the language together, which keeps fields small.
TYPES = {"en": "Báo cáo", "fr": "Kế hoạch", "de": "Quyết định", "es": "Công văn"}


def _typed(spark, d):
    kind = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in TYPES.items()))
    return table(spark, d, "documents").select("doc_id", kind.alias("document_type"), "source", F.concat("source", "lang").alias("field"), F.concat("source", F.lit("-"), "n_chars").alias("document_number"))


_RELATIONS = """doc AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'Báo cáo' WHEN 'fr' THEN 'Kế hoạch' WHEN 'de' THEN 'Quyết định' ELSE 'Công văn' END AS t, source AS f, CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 3 WHEN 'de' THEN 2 ELSE 4 END AS r FROM documents),
  al AS (SELECT x.doc_id AS s, y.doc_id AS t, x.t AS st, y.t AS tt, x.r AS sr, y.r AS tr, x.f = y.f AS same, coalesce(p.shared, 0) AS shared, coalesce(p.evidence, '') AS evidence FROM doc x JOIN doc y ON x.doc_id <> y.doc_id LEFT JOIN pairs p ON p.a = least(x.doc_id, y.doc_id) AND p.b = greatest(x.doc_id, y.doc_id)),
  k AS (SELECT *, CASE WHEN shared = 0 AND NOT same THEN NULL WHEN st = 'Báo cáo' AND tt IN ('Kế hoạch', 'Công văn') THEN 'reports' WHEN st IN ('Công văn', 'Kế hoạch') AND tt IN ('Quy định', 'Quyết định') THEN 'implements' WHEN sr > tr THEN 'follows' WHEN shared > 0 THEN 'related' END AS kind FROM al),
  fw AS (SELECT s, t, kind, greatest(1, shared)::DOUBLE AS weight, shared, evidence FROM k WHERE kind IS NOT NULL), m AS (SELECT t AS s, s AS t, kind, weight, least(1.0, 0.5 + weight * 0.1) AS conf, evidence FROM fw WHERE kind = 'related' AND s > t)
  SELECT fw.s AS source_id, fw.t AS target_id, fw.kind AS relation_type, fw.weight, 1.0::DOUBLE AS confidence, false AS is_bidirectional, fw.evidence FROM fw WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.s = fw.s AND m.t = fw.t AND m.kind = fw.kind) UNION ALL SELECT s, t, kind, weight, round(conf, 6), true, evidence FROM m"""


@query("h1_h2_relations", f"WITH {PAIRS}, {_RELATIONS}")
def _(spark, d):
    docs = _typed(spark, d).select("doc_id", "document_type", F.col("source").alias("field"))
    return K.relations(docs, _values(spark, d))


@query("h1_h2_all_relations", f"WITH {ALL_PAIRS}, {_RELATIONS}")
def _(spark, d):
    docs = _typed(spark, d).select("doc_id", "document_type", F.col("source").alias("field"))
    return K.relations(docs, _all_values(spark, d))


_M2 = "m AS (SELECT doc_id, source || '-' || n_chars AS no, source || lang AS f, CASE lang WHEN 'en' THEN 'bao_cao' WHEN 'fr' THEN 'ke_hoach' WHEN 'de' THEN 'quyet_dinh' ELSE 'cong_van' END AS t FROM documents)"
_R2 = f"""{_M2}, r AS (SELECT x.doc_id AS s, y.doc_id AS g, x.t AS st, y.t AS tt, x.f AS sf, y.f AS tf, CASE WHEN x.no = y.no THEN 1 WHEN x.t = 'bao_cao' AND y.t IN ('ke_hoach', 'cong_van') AND x.f = y.f THEN 2 WHEN x.t IN ('cong_van', 'ke_hoach') AND y.t IN ('quy_dinh', 'quyet_dinh') THEN 3 WHEN x.f = y.f THEN 4 END AS k FROM m x JOIN m y ON x.doc_id <> y.doc_id)"""


@query("h5_relations_v2", f"""WITH {_R2} SELECT s AS source_id, g AS target_id, ['references', 'reports', 'implements', 'related'][k] AS relation_type, [0.92, 0.78, 0.72, 0.58][k]::DOUBLE AS weight, [0.92, 0.78, 0.72, 0.58][k]::DOUBLE AS confidence, 'forward' AS direction,
  sha256(to_json({{'reason': ['Trùng số/ký hiệu văn bản', 'Báo cáo cùng lĩnh vực với văn bản triển khai', 'Văn bản triển khai liên hệ văn bản quy định/quyết định', 'Cùng lĩnh vực'][k], 'source_type': st, 'target_type': tt, 'source_field': sf, 'target_field': tf}})::VARCHAR) AS evidence_sha FROM r WHERE k IS NOT NULL""")
def _(spark, d):
    m = _typed(spark, d)
    return M.relations_v2(m.withColumn("normalized_type", M.normalized_type(F.col("document_type"))), evidence=lambda c: F.sha2(c, 256)).withColumnRenamed("evidence", "evidence_sha")


@query("h5_relation_classes", f"""WITH {_R2} SELECT ['references', 'reports', 'implements', 'related'][k] AS relation_type, CASE WHEN k <> 3 THEN sf END AS source_field, st AS source_type, CASE WHEN k <> 3 THEN tf END AS target_field, tt AS target_type, count(*) AS n_pairs FROM r WHERE k IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    m = _typed(spark, d)
    return M.relation_classes(m.withColumn("normalized_type", M.normalized_type(F.col("document_type"))))[0]


@query("h5_relations_of_catalogue", f"""WITH {_R2.replace("source || lang AS f", "lang AS f")} SELECT s AS source_id, g AS target_id, ['references', 'reports', 'implements', 'related'][k] AS relation_type, [0.92, 0.78, 0.72, 0.58][k]::DOUBLE AS weight, [0.92, 0.78, 0.72, 0.58][k]::DOUBLE AS confidence, 'forward' AS direction FROM r WHERE k IS NOT NULL""")
def _(spark, d):
    """As h5_relations_v2, with the catalogue's own field, the language."""
    m = _typed(spark, d).drop("field").join(catalogue(spark, d).select("doc_id", "field"), "doc_id")
    return M.relations_v2(m.withColumn("normalized_type", M.normalized_type(F.col("document_type")))).drop("evidence")


def _metadata(spark, d):
    c = catalogue(spark, d)
    lib = c.select("id", F.when(F.col("field") == "en", F.concat(F.lit("Đảng ủy "), "issuing_agency")).when(F.col("field") == "fr", "").otherwise(F.col("issuing_agency")).alias("issuing_agency"), F.when(F.col("field") == "de", "Quyết định").otherwise("Báo cáo").alias("document_type"), "document_number", "field", F.when(F.col("n_chars") > 500, "2023-05-01").otherwise("soon").alias("issued_date"))
    docs = c.select("doc_id", F.col("id").alias("library_document_id"), "document_type", "document_number", "field", F.when(F.col("n_chars") > 3000, '{"expiry_date": "2023-12-31"}').when(F.col("n_chars") > 2000, '{"effective_date": "2025-01-01"}').otherwise("{bad").alias("metadata_json"))
    return M.metadata_rows(docs, lib, F.lit("2024-06-30"))


@query("h6_metadata_rows", """SELECT doc_id, CASE lang WHEN 'en' THEN 'Đảng ủy ' || source WHEN 'fr' THEN NULL ELSE source END AS issuing_agency, CASE WHEN lang = 'de' THEN 'quyet_dinh' ELSE 'bao_cao' END AS normalized_type,
  CASE WHEN lang = 'en' THEN 'party_committee' WHEN lang = 'de' THEN 'normative' WHEN lang = 'fr' THEN 'unknown' ELSE 'known_agency' END AS authority_level, CASE WHEN lang = 'en' THEN 0.84 WHEN lang = 'de' THEN 0.78 WHEN lang = 'fr' THEN 0.2 ELSE 0.62 END::DOUBLE AS authority_score,
  CASE WHEN lang = 'en' THEN 'Cơ quan Đảng cấp ủy' WHEN lang = 'de' THEN 'Loại văn bản có tính quy định' WHEN lang = 'fr' THEN 'Thiếu cơ quan ban hành' ELSE 'Có cơ quan ban hành' END AS authority_reason,
  CASE WHEN n_chars > 3000 THEN 'expired' WHEN n_chars > 2000 THEN 'pending' WHEN n_chars > 500 THEN 'valid' ELSE 'unknown' END AS validity FROM documents""")
def _(spark, d):
    return _metadata(spark, d).select("doc_id", "issuing_agency", "normalized_type", "authority_level", "authority_score", M.authority_reason(F.col("authority_level")).alias("authority_reason"), "validity")


def requests(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("request_text"))


@query("h7_classified_requests", """WITH t AS (SELECT conv_id * 1000 + turn AS request_id, trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '\\s+', ' ', 'g')) AS x FROM conversations WHERE role = 'user'),
  s AS (SELECT request_id, contains(x, ' the ')::INT + contains(x, ' of ')::INT + contains(x, ' in ')::INT + 2 * contains(x, 'report')::INT AS a, contains(x, ' la ')::INT + contains(x, ' de ')::INT + 2 * contains(x, 'letter')::INT AS b, contains(x, ' der ')::INT + contains(x, ' die ')::INT + 2 * contains(x, 'plan')::INT AS c, contains(x, ' el ')::INT + contains(x, ' que ')::INT + 2 * contains(x, 'notice')::INT AS e FROM t),
  g AS (SELECT *, list_reverse_sort([a, b, c, e]) AS l FROM s), q AS (SELECT request_id, l[1] AS m, CASE WHEN l[1] = 0 THEN NULL WHEN a = l[1] THEN 'Report' WHEN b = l[1] THEN 'Letter' WHEN c = l[1] THEN 'Plan' ELSE 'Notice' END AS document_type, CASE WHEN l[1] = 0 THEN 0 ELSE round(least(0.35 + l[1] * 0.18 + (l[1] - l[2]) * 0.08, 0.98), 2) END AS confidence FROM g)
  SELECT request_id, document_type, confidence::DOUBLE AS confidence, confidence < 0.55 AS requires_user_selection FROM q""")
def _(spark, d):
    return D.classified(requests(spark, d), INTENTS)


@query("h8_ranked_documents", rf"""WITH {CAT}, q AS (SELECT conv_id * 1000 + turn AS request_id, list_distinct(regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[0-9a-zA-Z]+')) AS w FROM conversations WHERE role = 'user'),
  c AS (SELECT doc_id, document_type, list_distinct(regexp_extract_all(replace(strip_accents(lower(concat_ws(' ', title, keywords, document_number))), 'đ', 'd'), '[0-9a-zA-Z]+')) AS w, status IN ('indexed', 'need_review') AS ready FROM cat),
  s AS (SELECT request_id, doc_id, document_type = 'en' AS same, list_intersect(q.w, c.w) AS met, round(least((document_type = 'en')::INT * 0.35 + least(len(list_intersect(q.w, c.w)) * 0.06, 0.3) + ready::INT * 0.1, 1.0), 4) AS score FROM q, c),
  t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id DESC)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 5)
  SELECT request_id, doc_id, score::DOUBLE AS score, coalesce(nullif(concat_ws('; ', CASE WHEN same THEN 'Cung loai van ban' END, CASE WHEN len(met) > 0 THEN 'Trung tu khoa: ' || array_to_string(list_sort(met)[1:5], ', ') END), ''), 'Mẫu trong kho văn bản') AS reason, rank FROM t""")
def _(spark, d):
    return D.ranked_documents(requests(spark, d).withColumn("document_type", F.lit("EN")), catalogue(spark, d))


@query("h9_ranked_templates", r"""WITH q AS (SELECT conv_id * 1000 + turn AS request_id, CASE WHEN turn % 3 = 0 THEN '' WHEN conv_id % 2 = 0 THEN 'letter' ELSE 'plan' END AS t, CASE WHEN turn % 2 = 0 THEN 'f1' ELSE '' END AS f, list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-zÀ-ỹ]+')) AS w FROM conversations WHERE role = 'user'),
  b AS (SELECT *, CASE WHEN length(text) % 2 = 0 THEN 'letter' ELSE 'plan' END AS t, 'f' || length(text) % 3 AS f, length(text) % 5 AS made, length(text) % 4 > 0 AS ready FROM benchmark),
  c AS (SELECT item_id, t, f, made, ready, list_distinct(regexp_extract_all(lower(text || ' ' || t || ' ' || f), '[0-9A-Za-zÀ-ỹ]+')) AS w FROM b),
  s AS (SELECT request_id, item_id AS template_id, made, q.t <> '' AS same_t, q.f <> '' AND q.f = c.f AS same_f, ready, list_intersect(q.w, c.w) AS met FROM q JOIN c ON q.t = '' OR q.t = c.t),
  p AS (SELECT *, least(same_t::INT * 35 + same_f::INT * 25 + least(len(met) * 8, 32) + ready::INT * 8, 100)::INT AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, made DESC, template_id DESC)::INT AS rank FROM p QUALIFY rank <= 5)
  SELECT request_id, template_id, score, rank, coalesce(nullif(concat_ws('; ', CASE WHEN same_t THEN 'Cùng loại văn bản' END, CASE WHEN same_f THEN 'Cùng lĩnh vực' END, CASE WHEN len(met) > 0 THEN 'Trùng từ khóa: ' || array_to_string(list_sort(met)[1:5], ', ') END, CASE WHEN ready THEN 'Đã phân tích bố cục' END), ''), 'Mẫu sẵn có trong kho') AS reason FROM r""")
def _(spark, d):
    n = F.length("text")
    t = table(spark, d, "benchmark").select(
        F.col("item_id").alias("template_id"), F.col("text").alias("name"), F.lit("").alias("summary"), F.lit("").alias("keywords"), F.when(n % 2 == 0, "letter").otherwise("plan").alias("document_type"), F.concat(F.lit("f"), n % 3).alias("field"),
        F.when(n % 4 > 0, "Đã phân tích").otherwise("Mới nạp").alias("status"), (n % 5).alias("created_at"),
    )
    turn, conv = F.col("request_id") % 1000, F.floor(F.col("request_id") / 1000)
    asked = requests(spark, d).withColumns({"document_type": F.when(turn % 3 == 0, "").when(conv % 2 == 0, "letter").otherwise("plan"), "field": F.when(turn % 2 == 0, "f1").otherwise("")})
    return D.ranked_templates(asked, t)


@query("h11_evidence", """WITH q AS (SELECT vec_id AS request_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT request_id, vec_id, round(list_dot_product(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings), t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5),
  l AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS library_id, source || '-' || n_chars AS number FROM documents) SELECT request_id, vec_id, rank, score, number, library_id FROM t LEFT JOIN l ON l.doc_id = vec_id""")
def _(spark, d):
    v, c = _vectors(spark, d), catalogue(spark, d)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("request_id"), "vector")
    chunks = v.select("vec_id", "vector", F.col("vec_id").alias("doc_id"), F.lit(1).alias("chunk_order"), F.lit("body").alias("section"), F.lit("").alias("text"))
    out = D.evidence(asked.select("request_id"), asked, chunks, c, c)
    return out.select("request_id", "vec_id", "rank", "score", F.col("citation.document_number").alias("number"), "library_id")


@query("e3_latest_results", "SELECT conv_id AS request_id, max(turn) AS id FROM conversations GROUP BY 1")
def _(spark, d):
    return D.latest_results(table(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"))).drop("created_at")


@query("c11_evidence_files", f"WITH {CAT} SELECT doc_id AS citation_id, min(id) OVER (PARTITION BY checksum) AS library_id FROM cat")
def _(spark, d):
    c = catalogue(spark, d)
    return D.evidence_files(c.select(F.col("doc_id").alias("citation_id"), "checksum"), c).select("citation_id", "library_id")


ACTIONS = "['approve_outline', 'generate_draft', 'save_review', 'approve_draft', 'export']"
LOG = f"log AS (SELECT user_id AS result_id, event_id AS seq, {ACTIONS}[1 + CASE event_type WHEN 'click' THEN (event_id % 3)::INT WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE (event_id % 5)::INT END] AS action FROM events)"


def review_log(spark, d):
    names = F.array(*map(F.lit, ("approve_outline", "generate_draft", "save_review", "approve_draft", "export")))
    at = F.when(F.col("event_type") == "click", F.pmod("event_id", F.lit(3))).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", 4).otherwise(F.pmod("event_id", F.lit(5)))
    return table(spark, d, "events").select(F.col("user_id").alias("result_id"), F.col("event_id").alias("seq"), F.get(names, at.cast("int")).alias("action"))


@query("h15_review_replay", f"""WITH RECURSIVE {LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY seq) AS k FROM log), steps(now, act, nxt) AS (VALUES ('pending_outline_review', 'approve_outline', 'outline_approved'), ('outline_approved', 'generate_draft', 'pending_user_review'), ('pending_user_review', 'save_review', 'pending_user_review'), ('approved', 'save_review', 'pending_user_review'), ('pending_user_review', 'approve_draft', 'approved'), ('approved', 'export', 'exported')),
  w AS (SELECT DISTINCT result_id, 0::BIGINT AS k, 'pending_outline_review' AS status, 0 AS refused FROM log UNION ALL SELECT w.result_id, w.k + 1, coalesce(s.nxt, w.status), w.refused + (s.nxt IS NULL)::INT FROM w JOIN o ON o.result_id = w.result_id AND o.k = w.k + 1 LEFT JOIN steps s ON s.now = w.status AND s.act = o.action)
  SELECT result_id, arg_max(status, k) AS status, max(refused)::INT AS n_refused FROM w GROUP BY 1""")
def _(spark, d):
    return D.replayed(review_log(spark, d))


@query("h16_carried_citations", "SELECT c.conv_id AS request_id, c.turn AS citation_id, r.turn AS result_id FROM conversations c JOIN conversations r ON r.conv_id = c.conv_id WHERE c.role = 'user' AND r.role <> 'user'")
def _(spark, d):
    c = table(spark, d, "conversations")
    cites = c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("citation_id"), F.when(F.col("role") != "user", F.col("turn")).alias("result_id"))
    return D.carried_over(c.where("role <> 'user'").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("result_id")), cites)


@query("c14_packages", """WITH u AS (SELECT conv_id, turn, role, (turn % 3)::DOUBLE AS score, text FROM conversations) SELECT conv_id AS result_id, any_value(text) FILTER (turn = 0) AS request_text, coalesce(string_agg(turn || role, ',' ORDER BY score DESC, turn) FILTER (role = 'user'), '') AS citations,
  coalesce(string_agg(turn || role, ',' ORDER BY turn) FILTER (role <> 'user'), '') AS revisions FROM u GROUP BY 1""")
def _(spark, d):
    c = table(spark, d, "conversations")
    results = c.groupBy(F.col("conv_id").alias("result_id")).agg(F.min("conv_id").alias("request_id"))
    reqs = c.where("turn = 0").select(F.col("conv_id").alias("request_id"), F.col("text").alias("request_text"))
    cites = c.where("role = 'user'").select(F.col("conv_id").alias("result_id"), F.col("turn").alias("citation_id"), (F.col("turn") % 3).cast("double").alias("score"), F.col("role").alias("section"))
    revs = c.where("role <> 'user'").select(F.col("conv_id").alias("result_id"), F.col("turn").alias("seq"), F.col("role").alias("status"))
    joined = lambda x, f: F.coalesce(F.array_join(F.transform(x, f), ","), F.lit("")).alias(x)
    out = D.packages(results, reqs, cites, revs)
    return out.select("result_id", "request_text", joined("citations", lambda e: F.concat(e["citation_id"], e["section"])), joined("revisions", lambda e: F.concat(e["seq"], e["status"])))


@query("f26_citation_lines", "WITH x AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id AS result_id, sha256(string_agg('[' || r || '] ' || text || ' (0.50)', chr(10) ORDER BY r) FILTER (r <= 10)) AS lines_sha FROM x GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("result_id"), F.col("turn").alias("citation_id"), F.col("text").alias("title"), F.lit(0.5).alias("score"))
    return D.citation_lines(c).select("result_id", F.sha2("lines", 256).alias("lines_sha"))


@query("f22_hash_embedding", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-zÀ-ỹ]+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY 1, 2), h AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64 AS i, CASE WHEN ('0x' || substr(sha256(w), 9, 2))::BIGINT % 2 = 0 THEN n ELSE -n END AS x FROM c),
  s AS (SELECT doc_id, i, sum(x)::DOUBLE AS x FROM h GROUP BY 1, 2) SELECT doc_id, i::INT AS place, round(round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 8), 6) AS value FROM s QUALIFY x <> 0""")
def _(spark, d):
    v = V.hash_embedding(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 64)
    return v.select("doc_id", F.posexplode("vector").alias("place", "v")).where("v <> 0").select("doc_id", "place", F.round("v", 6).alias("value"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


@query("e1_top_k_search", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings)
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5""")
def _(spark, d):
    v = _vectors(spark, d)
    return V.top_k(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector"), v)


_PLACES = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-zÀ-ỹ]+')) AS w FROM documents), h AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % {0} AS i, CASE WHEN ('0x' || substr(sha256(w), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS x FROM t),
  v AS (SELECT doc_id, i, sum(x) AS x FROM h GROUP BY 1, 2 HAVING sum(x) <> 0), s AS (SELECT doc_id, count(*) AS n_places, sum(i * sign(x))::BIGINT AS signed_places FROM v GROUP BY 1) SELECT d.doc_id, lang, coalesce(n_places, 0) AS n_places, coalesce(signed_places, 0) AS signed_places FROM documents d LEFT JOIN s USING (doc_id)"""


def _embedded(spark, d, backend: str) -> DataFrame:
    chunks = table(spark, d, "documents").select("doc_id", "lang", "text", F.lit("").alias("source_checksum"))
    cache, _ = V.embedded(chunks.where("lang <> 'en'"), spark.createDataFrame([], "key string, vector array<double>"), backend)
    return V.embedded(chunks, cache.select("key", "vector").dropDuplicates(["key"]), backend)[0]


def _places(df: DataFrame) -> DataFrame:
    cells = F.filter(F.transform("vector", lambda x, i: (i * F.signum(x)).cast("long")), lambda c, i: F.get("vector", i) != 0)
    held = df.select("doc_id", "lang", F.coalesce(cells, F.array().cast("array<bigint>")).alias("c"))
    return held.select("doc_id", "lang", F.size("c").cast("long").alias("n_places"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x).alias("signed_places"))


@query("h14_cached_embedding", _PLACES.format(128))
def _(spark, d):
    return _places(_embedded(spark, d, "hash"))


@query("j1_other_backend", _PLACES.format(32))
def _(spark, d):
    """The same vectors by a backend of another size, which has keys of its own in a cache."""
    V.register_backend("hash32", lambda df: V.hash_embedding(df, "key", 32), 32)
    both = _embedded(spark, d, "hash").select("key", "vector").dropDuplicates(["key"])
    chunks = table(spark, d, "documents").select("doc_id", "lang", "text", F.lit("").alias("source_checksum"))
    return _places(V.embedded(chunks, both, "hash32")[0])


@query("h12_h13_cited_hits", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5)
  SELECT query_id, vec_id, rank, d.source || '-' || d.n_chars AS number, CASE lang WHEN 'en' THEN 'party_committee' WHEN 'de' THEN 'normative' WHEN 'fr' THEN 'unknown' WHEN 'es' THEN 'known_agency' END AS authority_level FROM t LEFT JOIN documents d ON d.doc_id = vec_id""")
def _(spark, d):
    v = _vectors(spark, d)
    hits = V.top_k(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector"), v)
    chunks = v.select("vec_id", F.col("vec_id").alias("doc_id"), F.lit(1).alias("chunk_order"), F.lit("body").alias("section"), F.lit("").alias("text"))
    out = M.citation_metadata(V.cited(hits, chunks, catalogue(spark, d)), _metadata(spark, d))
    return out.select("query_id", "vec_id", "rank", F.col("citation.document_number").alias("number"), "authority_level")


@query("d11_graph_edges", "SELECT l_orderkey AS source, l_partkey AS target, 'related' AS type, count(*) AS weight FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id")).agg(F.count(F.lit(1)).alias("weight"))
    _, edges = K.graph(catalogue(spark, d), r.withColumns({"relation_type": F.lit("related"), "confidence": F.lit(1.0)}))
    return edges.drop("confidence")


@query("d11_graph_nodes", f"WITH {CAT} SELECT id, title AS label, document_type AS type, field FROM cat")
def _(spark, d):
    c = catalogue(spark, d)
    nodes, _ = K.graph(c.drop("id"), c.limit(0).select(*(F.col("id").alias(x) for x in ("source_id", "target_id", "relation_type", "weight", "confidence"))))
    return nodes


@query("c4_titled_relations", "SELECT l_orderkey AS source_id, l_partkey AS target_id, a.p_name AS source_title, b.p_name AS target_title FROM lineitem LEFT JOIN part a ON a.p_partkey = l_orderkey LEFT JOIN part b ON b.p_partkey = l_partkey")
def _(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return C.titled_relations(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id")), docs)


@query("b13_touching_relations", "SELECT l_orderkey AS source_id, l_partkey AS target_id FROM lineitem WHERE l_orderkey = 7 OR l_partkey = 7")
def _(spark, d):
    return C.touching(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id")), 7)


@query("e10_last_write_wins", "SELECT l_orderkey AS source_id, l_partkey AS target_id, max(l_linenumber) AS version FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_linenumber").alias("version"))
    return C.last_wins(r, ["source_id", "target_id"], F.col("version"))


@query("e9_distinct_words", f"""WITH t AS (SELECT doc_id, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS pos FROM documents), f AS (SELECT doc_id, w, min(pos) AS p FROM t WHERE length(w) >= 3 AND w NOT IN ('the', 'and', 'for') GROUP BY 1, 2)
  SELECT d.doc_id, coalesce(k, '') AS keywords FROM documents d LEFT JOIN (SELECT doc_id, array_to_string(list(w ORDER BY p)[1:12], ' ') AS k FROM f GROUP BY 1) USING (doc_id)""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.distinct_words(F.col("text"), STOP), " ").alias("keywords"))


@query("f6_f8_slugs_and_stems", r"""SELECT p_partkey, left(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^0-9a-zA-ZÀ-ỹ]+', '-', 'g'), '-'), 90) AS slug, trim(translate(regexp_replace(p_name || '_' || p_brand || '.v1.txt', '\.[^.]+$', ''), '_-', '  ')) AS stem FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), X.file_stem(F.concat("p_name", F.lit("_"), "p_brand", F.lit(".v1.txt"))).alias("stem"))


@query("d7_entity_dedupe", "SELECT o_custkey AS doc_id, o_orderstatus AS entity_type, min_by(o_orderpriority, o_orderkey) AS entity_value, max(o_totalprice) AS weight FROM orders GROUP BY o_custkey, o_orderstatus, lower(o_orderpriority)")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("entity_type"), F.col("o_orderpriority").alias("entity_value"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("weight"))
    return K.deduped(rows)


@query("b10_newest_results", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 100")
def _(spark, d):
    from folioframe.operators.tasks import newest

    return newest(C.by_key(table(spark, d, "conversations"), role="user"), "conv_id", "turn", n=100).select("conv_id", "turn", "role")


@query("f20_f21_similarity", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    v = _vectors(spark, d).select("vec_id", V.normalized(F.col("vector"), 12).alias("v"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(V.similarity(F.col("v"), F.col("w")), 4).alias("cosine"))
