"""Text structure: sections, chunks, template sections, metadata extraction, format checks. No shuffles except where rows are regrouped per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import rules as R
from folioframe.functions import text as X
from folioframe.keeping import kept
from folioframe.operators import chunking as C


def section_of(line: Column, rules=R.SECTION_RULES) -> Column:
    return X.first_rule(line, rules, "(?iu)")


#: Characters from which on a document is cut into ranges of so many lines, which several tasks may work on.
LONG, RANGE = 1 << 20, 4096


def chunks(documents: DataFrame, rules=R.SECTION_RULES, max_tokens: int = R.MAX_CHUNK_TOKENS) -> DataFrame:
    """(doc_id, chunk_order, section, text, token_count).

    A chunk begins at every line that opens a section, and where the next line would take it
    over max_tokens; a longer single line stays whole. Documents of fewer than LONG characters
    are chunked within their row and nothing is shuffled; longer ones by ranges of lines.
    """
    read = lambda lines: [lines.alias("lines"), F.transform(lines, lambda x: F.size(X.tokens(x))).alias("n"), F.transform(lines, lambda x: section_of(x, rules)).alias("opens")]
    before = [F.lit(C.EMPTY).alias("held"), F.lit(0).cast("long").alias("begun"), F.lit(None).cast("string").alias("section")]
    is_long = F.coalesce(F.length("text") >= LONG, F.lit(False))
    short = documents.where(~is_long).select("doc_id", F.lit(0).alias("part"), *read(X.lines(F.col("text"))), *before)
    out = C.pieces(short, max_tokens, "body").drop("part")

    ranges = documents.where(is_long).select("doc_id", X.lines(F.col("text")).alias("l"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / RANGE).cast("int")), lambda i: F.slice("l", i * RANGE + 1, RANGE))
    ranges = ranges.where("size(l) > 0").select("doc_id", F.posexplode(cut).alias("part", "r")).repartition("doc_id", "part").select("doc_id", "part", *read(F.col("r")))
    ranges = kept(ranges)
    placed = ranges.join(C.entries(ranges.select("doc_id", "part", "n", "opens"), max_tokens), ["doc_id", "part"])
    parts = C.pieces(placed, max_tokens, "body").groupBy("doc_id", "chunk_order").agg(F.sort_array(F.collect_list(F.struct("part", "section", "text", "token_count"))).alias("p"))
    tokens = F.aggregate("p", F.lit(0), lambda n, p: n + p["token_count"])
    whole = parts.select("doc_id", "chunk_order", F.get("p", F.lit(0))["section"].alias("section"), F.array_join("p.text", "\n").alias("text"), tokens.alias("token_count"))
    return out.select("doc_id", "chunk_order", "section", "text", "token_count").unionByName(whole)


def template_sections(documents: DataFrame, headings=R.TEMPLATE_HEADINGS, most: int = 20) -> DataFrame:
    """(doc_id, section_order, section_type, title, content): runs of lines under headings, at most `most` per document.

    Every heading's run ends at the next heading, so each section is a slice of the lines.
    """
    signal = lambda x: F.coalesce(*(F.when(F.contains(F.lower(x), F.lit(s.lower())), F.lit(kind)) for s, kind in headings))
    loud = lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) <= 120)
    lines = documents.select("doc_id", X.lines(F.col("text")).alias("lines"))
    kinds = F.transform("lines", lambda x, i: F.struct((i + 1).alias("start"), F.coalesce(signal(x), F.when(loud(x), F.lit(R.HEADING))).alias("kind"), F.substring(x, 1, 120).alias("title")))
    opening = F.struct(F.lit(0).alias("start"), F.lit(R.OPENING).alias("kind"), F.lit(R.OPENING).alias("title"))
    heads = lines.withColumn("heads", F.concat(F.array(opening), F.filter(kinds, lambda h: h["kind"].isNotNull())))
    long = lambda h, i: F.coalesce(F.get(F.col("heads"), i + 1)["start"] - 1, F.size("lines")) - h["start"]
    sized = F.transform("heads", lambda h, i: F.struct(h["kind"].alias("section_type"), h["title"].alias("title"), h["start"].alias("start"), long(h, i).alias("n")))
    filled = heads.withColumn("sized", sized).withColumn("full", F.filter("sized", lambda h: h["n"] > 0))
    chosen = F.slice(F.when(F.size("full") > 0, F.col("full")).otherwise(F.slice("sized", -1, 1)), 1, most)
    content = lambda h: F.array_join(F.slice(F.col("lines"), h["start"] + 1, h["n"]), "\n")
    out = filled.withColumn("chosen", chosen).select("doc_id", F.posexplode(F.transform("chosen", lambda h: F.struct(h["section_type"], h["title"], content(h).alias("content")))).alias("pos", "s"))
    return out.select("doc_id", (F.col("pos") + 1).alias("section_order"), "s.section_type", "s.title", "s.content")


def format_signals(c: Column) -> dict[str, Column]:
    low = F.lower(X.text_or_empty(c))

    def all_of(lists: list[list[str]]) -> Column:
        out = X.contains_any(low, lists[0])
        for signals in lists[1:]:
            out = out & X.contains_any(low, signals)
        return out

    return {name: all_of(lists) for name, lists in R.FORMAT_SIGNALS.items()}


def template_summary(c: Column, section_types: Column) -> Column:
    head = F.array_join(F.slice(X.lines(c), 1, 5), " / ")
    named = F.concat(F.lit(R.SUMMARY_LAYOUT), F.array_join(F.slice(section_types, 1, 6), ", "), F.lit("."))
    return F.when(head == "", named).otherwise(F.concat(named, F.lit(R.SUMMARY_OPENING), F.substring(head, 1, 300)))


def analysed_templates(templates: DataFrame) -> DataFrame:
    """Templates with signals, keywords and summary; status becomes analysed."""
    kinds = template_sections(templates).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("section_order", "section_type"))), lambda s: s["section_type"]).alias("section_types"))
    out = templates.join(kinds, "doc_id", "left")
    return out.select(
        "doc_id", *(v.alias(k) for k, v in format_signals(F.col("text")).items()), F.array_join(X.distinct_words(F.concat_ws(" ", "name", "text"), R.TEMPLATE_STOPWORDS), ", ").alias("keywords"),
        template_summary(F.col("text"), F.col("section_types")).alias("summary"), F.lit(R.ANALYSED).alias("status"),
    )


def missing_information(requests: DataFrame, rules=R.REQUIRED_INFORMATION, default: str | None = None) -> DataFrame:
    """(request_id, missing): labels none of whose signals occur; an unknown type uses the first rule set."""
    low = F.lower(X.text_or_empty(F.col("request_text")))
    listed = lambda need: F.filter(F.array(*(F.when(~X.contains_any(low, s), F.lit(label)) for label, s in need.items())), lambda x: x.isNotNull())
    first = default or next(iter(rules))
    out = None
    for kind, need in rules.items():
        out = F.when(F.col("document_type") == kind, listed(need)) if out is None else out.when(F.col("document_type") == kind, listed(need))
    return requests.select("request_id", out.otherwise(listed(rules[first])).alias("missing"))


def format_review(drafts: DataFrame, checks=R.DRAFT_CHECKS, least: int = 200) -> DataFrame:
    """(draft_id, name, ok): presence checks and the length check."""
    low = F.lower(X.text_or_empty(F.col("content")))
    rows = [F.struct(F.lit(n).alias("name"), F.contains(low, F.lit(s.lower())).alias("ok")) for n, s in checks]
    rows.append(F.struct(F.lit(R.LENGTH_CHECK).alias("name"), (F.length(X.stripped(X.text_or_empty(F.col("content")))) >= least).alias("ok")))
    return drafts.select("draft_id", F.explode(F.array(*rows)).alias("c")).select("draft_id", "c.*")


def extracted_metadata(documents: DataFrame, types=R.DOCUMENT_TYPES, fields=R.CATALOGUE_FIELDS) -> DataFrame:
    """doc_id and what the rules read from (text, file_name): one projection, no shuffle."""
    df = documents.select("doc_id", F.coalesce("file_name", F.lit("")).alias("file_name"), X.normalized_space(F.col("text")).alias("t")).withColumn("lines", X.lines(F.col("t")))
    number = X.document_number(F.col("t"))
    df = df.withColumn("document_number", number).withColumn("document_type", X.first_rule(F.concat_ws("\n", "t", F.coalesce(number, F.lit("")), "file_name"), types, "(?iU)"))
    agency = F.get(F.filter(F.slice("lines", 1, 12), lambda x: X.contains_any(F.upper(x), R.AGENCY_SIGNALS)), 0)
    after = F.filter(F.transform("lines", lambda x, i: F.struct(F.upper(x).isin(R.SIGNER_TITLES).alias("title"), F.get(F.col("lines"), i + 1).alias("next"))), lambda s: s["title"] & F.length(s["next"]).between(3, 80))
    bare = F.transform("lines", lambda x: F.trim(x, F.lit(" -")))
    subject = lambda x: (F.length(x) >= 12) & ~starts_with_any(F.upper(x), R.BOILERPLATE) & ~F.coalesce(F.upper(x) == F.upper("document_type"), F.lit(False)) & starts_with_any(F.lower(x), R.SUBJECT_MARKS)
    summary = F.coalesce(F.get(F.filter(bare, subject), 0), F.nullif(X.file_stem(F.col("file_name")), F.lit("")))
    df = df.withColumn("summary", summary)
    return df.select(
        "doc_id", "document_number", X.issued_date(F.col("t")).alias("issued_date"), "document_type", agency.alias("issuing_agency"), F.get(after, 0)["next"].alias("signer"), "summary",
        X.distinct_words(F.concat_ws(" ", "t", "file_name"), R.CATALOGUE_STOPWORDS).alias("keywords"), X.best_field(F.col("t"), fields).alias("field"),
        X.first_non_empty(F.col("summary"), X.file_stem(F.col("file_name")), F.col("document_type"), F.lit(R.UNNAMED)).alias("title"),
    )


def starts_with_any(c: Column, beginnings: list[str]) -> Column:
    out = F.lit(False)
    for b in beginnings:
        out = out | F.startswith(c, F.lit(b))
    return out
