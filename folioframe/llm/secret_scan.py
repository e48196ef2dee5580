"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of every file is a blob, named by the SHA-256 of its text. The ledger holds
one row per (blob, rule version) that was ever scanned, with its findings, none included.
A run scans the blobs whose pair with the present rules is not in the ledger, appends
them, and joins the findings back to all paths that hold the blob.

Most blobs hold nothing that any rule could start from. A cheap JVM expression, which runs
once over the texts that a bounded filter takes for unseen, tells them apart, and only the
others' texts are shuffled to become one row per blob: what is moved follows the secrets, not
the corpus. A blob that a third of all paths share is reduced to one row per task before the
shuffle. Findings come back by an equi-join on the blob that adaptive execution can split;
paths whose blob a bounded filter of all blobs with findings rules out go around that join.

Defined results: a null text is an empty blob; an empty or null blob has no findings; rows
that repeat a path each get their blob's findings; an empty table gives no rows and leaves the
ledger as it is; further columns pass through, also those that are named like this module's
own work columns, but for columns named blob and findings, which are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
RULES: dict[str, tuple[str, int, int]] = {
    # kind: pattern, group that must have the least length, least length
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    "url": (r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@", 0, 1),
}
#: What every match of some of RULES holds; for the JVM.
NEEDED = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{24}|PRIVATE KEY-----|eyJ[A-Za-z0-9_-]{8}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-|://[^\s/:@]+:[^\s/:@]{3,}@"
#: Bits of the filters of blobs that go to all executors: 1 MiB, whatever the input.
FILTER_BITS = 23
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def rule_version(rules: dict[str, tuple[str, int, int]] = RULES) -> str:
    return hashlib.sha256(repr(sorted(rules.items())).encode()).hexdigest()[:16]


def find(text: str, rules: list[tuple[str, re.Pattern, int, int]]) -> list[tuple[int, int, str]]:
    """(start, number of the kind, kind, end) sorted; code points, end exclusive."""
    out = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def _scanner(rules: dict[str, tuple[str, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(k, re.compile(p, re.ASCII), g, n) for k, (p, g, n) in rules.items()]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, _, k, e in find(t, compiled)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, pa.list_(kind))], ["blob", "findings"])

    return run


def _slot(blob: str) -> str:
    return f"(xxhash64({blob}) & {(1 << FILTER_BITS) - 1})"


def _flagged(df: DataFrame, blob: str, blobs: DataFrame, flag: str) -> DataFrame:
    """df with a flag that is true where its blob is among blobs, and by chance elsewhere."""
    bits = blobs.selectExpr(f"shiftright({_slot('blob')}, 6) AS __word", f"shiftleft(1L, cast({_slot('blob')} & 63 AS int)) AS __bit").groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    held = df.withColumn("__word", F.expr(f"shiftright({_slot(blob)}, 6)")).join(F.broadcast(bits), "__word", "left")  # at most 2**17 rows
    return held.withColumn(flag, F.expr(f"coalesce(shiftright(__bits, cast({_slot(blob)} & 63 AS int)) & 1 = 1, false)")).drop("__word", "__bits")


def scan(
    files: DataFrame,
    ledger: DataFrame | None = None,
    rules: dict[str, tuple[str, int, int]] = RULES,
    needed: str | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """(files with columns blob and findings, rows (blob, rules, findings) to append to the ledger).

    files: a column text and any others. ledger: (blob, rules, findings) of earlier runs.
    needed: a pattern that every text with a match of some rule holds; none is taken but for RULES.
    keep: what is done with what is used several times, say a checkpoint or a write and a reread.
    """
    version = rule_version(rules)
    needed = NEEDED if needed is None and rules == RULES else needed
    # One struct of all columns, so that no name of theirs meets one of ours.
    named = files.select(F.struct("*").alias("__row"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("__blob"))
    text = F.col("__row")["text"]
    unseen = named.select(F.col("__blob").alias("blob")).distinct()
    told = named
    if ledger is not None:
        done = ledger.where(F.col("rules") == version)
        unseen = keep(unseen.join(done.select("blob"), "blob", "left_anti"))
        told = _flagged(named, "__blob", unseen, "__unseen").where("__unseen")
    suspects = told.where(text.rlike(needed) if needed else text.isNotNull()).select(F.col("__blob").alias("blob"), text.alias("text"))
    if ledger is not None:
        suspects = suspects.join(unseen, "blob", "left_semi")
    scanned = keep(suspects.dropDuplicates(["blob"]).mapInArrow(_scanner(rules), f"blob string, findings {FINDINGS}"))
    none = F.array().cast(FINDINGS)
    new = unseen.join(scanned, "blob", "left").select("blob", F.lit(version).alias("rules"), F.coalesce("findings", none).alias("findings"))
    hits = scanned.where("size(findings) > 0")
    if ledger is not None:
        hits = hits.unionByName(done.where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"]))
    split = _flagged(named, "__blob", hits, "__held")
    hits = hits.select(F.col("blob").alias("__blob"), F.col("findings").alias("__findings"))
    looked = split.where("__held").join(hits, "__blob", "left").withColumn("__findings", F.coalesce("__findings", none))
    out = split.where("NOT __held").withColumn("__findings", none).unionByName(looked)
    own = [F.col("__row")[c].alias(c) for c in files.columns if c not in ("blob", "findings")]
    return out.select(*own, F.col("__blob").alias("blob"), F.col("__findings").alias("findings")), new


def rendered(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kinds(findings: Column, *kinds: str) -> Column:
    return F.filter(findings, lambda x: x["kind"].isin(*kinds))


def redact(text: Column, findings: Column, mask: str = "[REDACTED]") -> Column:
    """text with every found span replaced; spans that overlap become one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    folded = F.aggregate(
        findings,
        start,
        lambda s, x: F.struct(
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(findings) > 0, folded).otherwise(text)
