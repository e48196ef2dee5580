"""Metadata and template analysis with the default rules, over letters made of the documents' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import rules as R
from folioframe.operators import structure as S
from folioframe.plans.document_queries import LINES, WORDS
from folioframe.plans.registry import query
from folioframe.plans.task_queries import table

#: A letter: agency, number, long or short date, subject, the document's text, title and name of a signer; some of each are absent.
_LETTER = r"""concat(
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('Đảng ủy ', source, '{n}') END,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('Số:  ', n_chars, '-CV/', source, '{n}') END,
    CASE doc_id % 3 WHEN 0 THEN concat('ngày ', 1 + doc_id % 28, ' tháng ', 1 + doc_id % 12, ' năm ', 2000 + doc_id % 25, '{n}') WHEN 1 THEN concat(1 + doc_id % 31, '/', 1 + doc_id % 12, '/2023', '{n}') ELSE '' END,
    CASE WHEN doc_id % 7 = 0 THEN concat('Kế hoạch ', source, '{n}') WHEN doc_id % 7 = 1 THEN concat('báo cáo ', lang, '{n}') ELSE '' END,
    CASE WHEN doc_id % 2 = 0 THEN concat(' - V/v matters of ', lang, ' ', doc_id, '{n}') ELSE '' END,
    text,
    CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('{n}', 'Trưởng ban', '{n}', 'Signer ', source) END)"""
_SQL_LETTER = "replace(" + _LETTER.replace("{n}", "~~") + ", '~~', chr(10))"


def letters(spark, d):
    made = F.replace(F.expr(_LETTER.replace("{n}", "~~")), F.lit("~~"), F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", F.concat("doc_id", F.lit("_note.v1.txt")).alias("file_name"), made.alias("text"))


def _listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_TYPES = "CASE " + " ".join(f"WHEN regexp_matches(concat_ws(chr(10), t, coalesce(number, ''), file_name), '(?i){p}') THEN '{n}'" for n, p in R.DOCUMENT_TYPES) + " END"
_SCORES = ", ".join("(" + " + ".join(f"contains(lower(t), '{k}')::INT" for k in keys) + f") AS s{i}" for i, keys in enumerate(R.CATALOGUE_FIELDS.values()))
_MOST = "greatest(" + ", ".join(f"s{i}" for i in range(len(R.CATALOGUE_FIELDS))) + ")"
_FIELD = f"CASE WHEN {_MOST} = 0 THEN NULL " + " ".join(f"WHEN s{i} = {_MOST} THEN '{name}'" for i, name in enumerate(R.CATALOGUE_FIELDS)) + " END"
_AGENCY = " OR ".join(f"contains(upper(line), '{s}')" for s in R.AGENCY_SIGNALS)
_NOT_BOILERPLATE = " AND ".join(f"NOT starts_with(upper(bare), '{s}')" for s in R.BOILERPLATE)
_SUBJECT = " OR ".join(f"starts_with(lower(bare), '{s}')" for s in R.SUBJECT_MARKS)
_DAY = "try_cast(regexp_extract(t, '{0}', 3) || '-' || lpad(regexp_extract(t, '{0}', 2), 2, '0') || '-' || lpad(regexp_extract(t, '{0}', 1), 2, '0') AS DATE)"


@query("g10_letter_metadata", f"""WITH raw AS (
    SELECT doc_id, doc_id || '_note.v1.txt' AS file_name, doc_id || ' note.v1' AS stem, regexp_replace({_SQL_LETTER}, '[ \\t]+', ' ', 'g') AS t FROM documents
  ), line AS (
    SELECT doc_id, line, ln, lead(line) OVER (PARTITION BY doc_id ORDER BY ln) AS after, trim(line, ' -') AS bare
    FROM (SELECT doc_id, trim(l) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS ln
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM raw) WHERE trim(l) <> '')
  ), typed AS (
    SELECT *, {_TYPES} AS document_type FROM (SELECT *, nullif(regexp_extract(t, '(?i){R.NUMBER_LABEL.removeprefix("(?iu)")}', 1), '') AS number FROM raw)
  ), agency AS (SELECT doc_id, arg_min(line, ln) AS issuing_agency FROM line WHERE ln <= 12 AND ({_AGENCY}) GROUP BY doc_id),
  signer AS (SELECT doc_id, arg_min(after, ln) AS signer FROM line WHERE upper(line) IN ({_listed(R.SIGNER_TITLES)}) AND length(after) BETWEEN 3 AND 80 GROUP BY doc_id),
  subject AS (
    SELECT doc_id, arg_min(bare, ln) AS subject FROM line JOIN typed USING (doc_id)
    WHERE length(bare) >= 12 AND {_NOT_BOILERPLATE} AND NOT coalesce(upper(bare) = upper(document_type), false) AND ({_SUBJECT}) GROUP BY doc_id
  ), word AS (
    SELECT doc_id, w, min(pos) AS p FROM (
      SELECT doc_id, unnest({WORDS.replace("text", "x")}) AS w, generate_subscripts({WORDS.replace("text", "x")}, 1) AS pos FROM (SELECT doc_id, t || ' ' || file_name AS x FROM raw))
    WHERE length(w) >= 3 AND w NOT IN ({_listed(R.CATALOGUE_STOPWORDS)}) GROUP BY doc_id, w
  ), keys AS (SELECT doc_id, array_to_string(list(w ORDER BY p)[1:12], ', ') AS keywords FROM word GROUP BY doc_id),
  scored AS (SELECT doc_id, {_SCORES} FROM raw)
  SELECT doc_id, number AS document_number, coalesce({_DAY.format("(?i)" + R.LONG_DATE.removeprefix("(?iu)"))}, {_DAY.format(R.SHORT_DATE)}) AS issued_date, document_type, issuing_agency, signer,
         coalesce(subject, stem) AS summary, coalesce(keywords, '') AS keywords, {_FIELD} AS field, coalesce(subject, stem) AS title
  FROM typed JOIN scored USING (doc_id) LEFT JOIN agency USING (doc_id) LEFT JOIN signer USING (doc_id) LEFT JOIN subject USING (doc_id) LEFT JOIN keys USING (doc_id)""")  # fmt: skip
def _(spark, d):
    """Number, dates, type, agency, signer, subject, keywords, field and title of letters, by the default rules."""
    return S.extracted_metadata(letters(spark, d)).withColumn("keywords", F.array_join("keywords", ", "))


_KIND = "CASE " + " ".join(f"WHEN contains(lower(line), '{s.lower()}') THEN '{k}'" for s, k in R.TEMPLATE_HEADINGS) + f" WHEN line = upper(line) AND line <> lower(line) AND length(line) <= 120 THEN '{R.HEADING}' END"
_SIGNALS = ", ".join(" AND ".join("(" + " OR ".join(f"contains(lower(text), '{s}')" for s in some) + ")" for some in lists) + f" AS {name}" for name, lists in R.FORMAT_SIGNALS.items())


@query("g11_letter_templates", f"""WITH documents AS (SELECT doc_id, source AS name, {_SQL_LETTER} || chr(10) || 'Kính gửi: ' || source || chr(10) || 'độc lập tự do hạnh phúc' || chr(10) || 'Nội dung' AS text FROM documents),
  {LINES}, k AS (SELECT doc_id, line, ln, {_KIND} AS kind FROM lines),
  g AS (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY ln) AS grp FROM k),
  p AS (SELECT doc_id, grp, coalesce(any_value(kind), '{R.OPENING}') AS section_type, count(*) FILTER (kind IS NULL) AS n FROM g GROUP BY 1, 2),
  q AS (SELECT doc_id, section_type, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS r FROM p WHERE n > 0),
  s AS (SELECT doc_id, array_to_string(list(section_type ORDER BY r) FILTER (r <= 6), ', ') AS kinds FROM q GROUP BY doc_id),
  h AS (SELECT doc_id, array_to_string(list(line ORDER BY ln) FILTER (ln <= 5), ' / ') AS head FROM lines GROUP BY doc_id),
  word AS (
    SELECT doc_id, w, min(pos) AS p FROM (
      SELECT doc_id, unnest({WORDS.replace("text", "x")}) AS w, generate_subscripts({WORDS.replace("text", "x")}, 1) AS pos FROM (SELECT doc_id, name || ' ' || text AS x FROM documents))
    WHERE length(w) >= 3 AND w NOT IN ({_listed(R.TEMPLATE_STOPWORDS)}) GROUP BY doc_id, w
  ), keys AS (SELECT doc_id, array_to_string(list(w ORDER BY p)[1:12], ', ') AS keywords FROM word GROUP BY doc_id)
  SELECT doc_id, {_SIGNALS}, keywords, '{R.SUMMARY_LAYOUT}' || kinds || '.' || '{R.SUMMARY_OPENING}' || left(head, 300) AS summary, '{R.ANALYSED}' AS status
  FROM documents JOIN s USING (doc_id) JOIN h USING (doc_id) JOIN keys USING (doc_id)""")  # fmt: skip
def _(spark, d):
    """Templates made of the letters, with headings, signals, keywords and summary by the default rules."""
    source = table(spark, d, "documents").select("doc_id", F.col("source").alias("name"))
    more = F.concat("text", F.lit("\nKính gửi: "), "name", F.lit("\nđộc lập tự do hạnh phúc\nNội dung"))
    return S.analysed_templates(letters(spark, d).join(source, "doc_id").select("doc_id", "name", more.alias("text")))
