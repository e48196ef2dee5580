"""Quality rules: text statistics, and decision lists learned by sequential covering.

A rule is a conjunction of thresholds on statistics. It is grown on one part of the
labelled documents, condition by condition of the highest information gain, pruned on the
other part, and kept while it is right often enough there; what it covers is taken away
and the next rule is grown. The list becomes one ordered conditional expression, evaluated
by Spark in the projection that reads the statistics.

Everything is DataFrame and SQL functions: statistics are one projection without a
shuffle, and each learning step is one aggregate over the labelled rows, which returns a
row per statistic and threshold to the driver, a number that does not grow with the data.

Defined results: a null text has no words and zero statistics; a text of any length is
read whole; labels that are null are not learned from, and without any label of either
class the list is empty and keeps everything that passes the base; rows that repeat a
doc_id are judged one by one; further columns of the inputs are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import pinned

GRAM = 8
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
#: Thresholds tried per statistic, conditions per rule, rules per list.
STEPS, CONDITIONS, RULES = 16, 3, 8
#: A rule must be right this often on the pruning part, and cover so many labelled rows.
PRECISION, SUPPORT = 0.8, 5


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _repeated(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more."""

    def covered(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def among(x: Column) -> Column:
            again = F.filter(
                F.transform(x, lambda y, i: F.struct(y["i"].alias("i"), ((y["g"] == F.get(x, i - 1)["g"]) | (y["g"] == F.get(x, i + 1)["g"])).alias("twice"))),
                lambda y: y["twice"],
            )
            places = F.array_sort(F.transform(again, lambda y: y["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(places, zero, lambda s, i: F.struct((s["n"] + i + GRAM - F.greatest(i, s["end"])).alias("n"), (i + GRAM).alias("end")), lambda s: s["n"])

        return _let(ordered, among)

    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(words, i, GRAM)))
    counted = _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))
    return F.when(F.size(words) > GRAM, counted).otherwise(0)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = documents.select("doc_id", text.alias("text"))
    bare = F.trim(F.col("text"), F.lit(BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANK)) != "")
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    df = df.select(
        "doc_id", of_words.alias("w"), of_lines.alias("l"),
        (F.length("text") - _count(F.col("text"), BLANK)).alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        _count(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _count(F.col("text"), "!?").alias("n_marks"),
    )
    names = [("w", "n_words"), (None, "word_chars"), (None, "n_symbols"), ("l", "n_dup_lines"), ("w", "n_repeat_words"), ("l", "n_lines"), (None, "n_upper"), (None, "n_marks")]
    return df.select("doc_id", *(F.col(f"{a}.{b}" if a else b).cast("long").alias(b) for a, b in names))


def ratios() -> dict[str, Column]:
    """What rules put thresholds on; 0 where there are no words or lines."""
    per = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"), "word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "word_chars"),
        "upper": per("n_upper", "word_chars"), "marks": per("n_marks", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeated": per("n_repeat_words", "n_words"),
    }


class Condition(NamedTuple):
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = ratios()[self.name]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    from math import log2

    return p * (log2((p + 1e-9) / (p + n + 1e-9)) - log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p else -1.0


def prepared(labelled: DataFrame) -> DataFrame:
    """Labelled rows with the ratios and the part that each is in: rules grow on the one and are pruned on the other."""
    rows = labelled.where("bad IS NOT NULL").withColumns({f"__{k}": v for k, v in ratios().items()})
    return rows.withColumn("__grow", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 0, F.lit(True)))


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Per ratio, the thresholds that conditions are made of; none without rows."""
    names = list(ratios())
    quantiles = [i / STEPS for i in range(1, STEPS)]
    cuts = rows.agg(*(F.percentile_approx(f"__{k}", quantiles, 1000).alias(k) for k in names), F.count(F.lit(1)).alias("n")).first()
    if not cuts["n"]:
        return {}
    cuts = {k: sorted(set(cuts[k])) for k in names}
    # Between two quantiles of one value lies nothing; a rule on a value that is 0 for most needs thresholds above that.
    upper = rows.agg(*(F.percentile_approx(F.when(F.col(f"__{k}") > cuts[k][-1] / 2, F.col(f"__{k}")), [0.1, 0.3, 0.5, 0.7, 0.9], 1000).alias(k) for k in names)).first()
    return {k: sorted({*cuts[k], *(upper[k] or []), *(x / 2 for x in (upper[k] or [])[:1])}) for k in names}


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules for rejection from rows with the statistics and bad (0 or 1), in order."""
    names, rows = list(ratios()), pinned(prepared(labelled))
    cuts = thresholds(rows)
    if not cuts:
        return []

    def counts(where: Column, grow: bool) -> dict[tuple[str, int], tuple[int, int]]:
        """Bad and good rows per statistic and bin; bin i lies above i thresholds."""
        bin_of = lambda k: F.size(F.filter(F.array(*map(F.lit, cuts[k])), lambda t: t < F.col(f"__{k}")))
        bins = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), bin_of(k).alias("i")) for k in names)))
        table = rows.where((F.col("__grow") == F.lit(grow)) & where).select("bad", bins.alias("b")).groupBy("b.k", "b.i").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        return {(r["k"], r["i"]): (r["p"], r["n"]) for r in table.collect()}

    def totals(where: Column, grow: bool) -> tuple[int, int]:
        r = rows.where((F.col("__grow") == F.lit(grow)) & where).agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).first()
        return r["p"] or 0, r["n"] or 0

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < RULES:
        rule: Rule = ()
        while len(rule) < CONDITIONS:
            table = counts(left & _holds(rule), True)
            p0, n0 = (sum(table.get((names[0], i), (0, 0))[j] for i in range(len(cuts[names[0]]) + 1)) for j in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for k in names:
                p = n = 0
                for i, t in enumerate(cuts[k]):
                    x = table.get((k, i), (0, 0))
                    p, n = p + x[0], n + x[1]
                    for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                        best = max(best, (_gain(q, m, p0, n0), Condition(k, above, float(t))), key=lambda x: x[0])
            if best[1] is None:
                break
            rule += (best[1],)
        # Pruning: the shortest beginning of the rule that is right most often.
        tried = [(*totals(left & _holds(rule[:j]), False), rule[:j]) for j in range(1, len(rule) + 1)]
        tried = [((p + 1) / (p + n + 2), -len(r), r) for p, n, r in tried if p + n >= SUPPORT and p >= PRECISION * (p + n)]
        if not tried:
            break
        chosen = max(tried, key=lambda x: x[:2])[2]
        rules.append(chosen)
        left = left & ~_holds(chosen)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """kept: the ordered conditional expression of the list."""
    out = None
    for rule in rules:
        out = F.when(_holds(rule), False) if out is None else out.when(_holds(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row's statistics with base_failed, kept and the number of the rule that rejects it."""
    stats = pinned(statistics(documents))
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    rules = learn(stats.join(known, "doc_id"))
    number = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        number = F.when(_holds(rule), F.lit(i)).otherwise(number)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules)).withColumn("rule", number)
