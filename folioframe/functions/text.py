"""Scalar text functions, Column -> Column, all inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions import rules as R

WORD = "[0-9A-Za-zÀ-ỹ]+"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, by code-point range."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(WORD), F.lit(0))


def _fold_table() -> tuple[str, str]:
    """Precomposed Latin letters and what is left of them without marks; combining marks, which go."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != chr(code):
            source.append(chr(code))
            target.append(bare)
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.category(chr(c)) == "Mn"]
    return "".join(source) + "đ" + "".join(marks), "".join(target) + "d"


_FROM, _TO = _fold_table()


def folded(c: Column) -> Column:
    """Lower case without accents, đ as d, runs of white space as one blank, trimmed."""
    bare = F.translate(F.lower(text_or_empty(c)), _FROM, _TO)
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def folded_tokens(c: Column) -> Column:
    return F.regexp_extract_all(folded(c), F.lit("[0-9a-zA-Z]+"), F.lit(0))


def normalized_space(c: Column) -> Column:
    """Line ends as \\n, runs of blanks and tabs as one blank."""
    return F.regexp_replace(F.regexp_replace(text_or_empty(c), "\r\n?", "\n"), "[ \t]+", " ")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    """Trimmed lines that hold something."""
    return F.filter(F.transform(F.split(text_or_empty(c), r"\R"), stripped), lambda x: x != "")


def slug(c: Column, length: int = 90, fold: bool = False, default: str = "") -> Column:
    base = folded(c) if fold else F.lower(stripped(text_or_empty(c)))
    out = F.regexp_replace(base, "[^0-9a-zA-Z]+" if fold else "[^0-9a-zA-ZÀ-ỹ]+", "-")
    out = F.substring(F.trim(out, F.lit("-")), 1, length)
    return F.when(out == "", F.lit(default)).otherwise(out)


def file_stem(c: Column) -> Column:
    """The name without its last extension, _ and - as blanks."""
    return F.trim(F.translate(F.regexp_replace(text_or_empty(c), r"\.[^.]+$", ""), "_-", "  "))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def document_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text_or_empty(c), R.NUMBER_LABEL, 1), F.lit(""))


def _date(c: Column, pattern: str) -> Column:
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(part(1) != "", F.try_to_date(F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd"))


def issued_date(c: Column) -> Column:
    """The long form, or where it is absent or no date the first d/m/yyyy or d-m-yyyy."""
    text = text_or_empty(c)
    return F.coalesce(_date(text, R.LONG_DATE), _date(text, R.SHORT_DATE))


def first_rule(c: Column, rules: list[tuple[str, str]], flags: str = "(?iU)") -> Column:
    """The name of the first rule whose pattern is found."""
    return F.coalesce(*(F.when(c.rlike(flags + pattern), F.lit(name)) for name, pattern in rules))


def first_contained(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first signal that c contains."""
    return F.coalesce(*(F.when(F.contains(c, F.lit(signal)), F.lit(value)) for signal, value in rules))


def contains_any(c: Column, signals: list[str]) -> Column:
    out = F.lit(False)
    for s in signals:
        out = out | F.contains(c, F.lit(s))
    return out


def best_field(c: Column, fields: dict[str, list[str]]) -> Column:
    """The field most of whose words occur; the first of equals; null where none does."""
    low = F.lower(text_or_empty(c))
    scores = [F.struct(sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, keys) in enumerate(fields.items())]
    top = F.array_max(F.array(*scores))
    return F.when(top["n"] > 0, top["name"])


def iso_date_text(c: Column) -> Column:
    """c where it looks like an ISO date; no calendar is asked."""
    return F.when(stripped(c.cast("string")).rlike(r"^\d{4}-\d{2}-\d{2}$"), stripped(c.cast("string")))


def reference_numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_or_empty(c), F.lit(R.REFERENCE_NUMBER), F.lit(0)))


def embedding_key(version: str, checksum: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(version), text_or_empty(checksum), F.sha2(text_or_empty(text), 256)), 256)


def distinct_words(c: Column, ignored: list[str], length: int = 12, least: int = 3) -> Column:
    """The first distinct words in their order."""
    words = F.filter(tokens(c), lambda w: (F.length(w) >= least) & ~w.isin(ignored))
    return F.slice(F.array_distinct(words), 1, length)


def ascii_like(c: Column, pattern: Column) -> Column:
    """LIKE that folds the case of ASCII letters only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.like(F.translate(text_or_empty(c), upper, lower), F.translate(pattern, upper, lower))
