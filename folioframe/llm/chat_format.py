"""Chat records of any known layout to canonical turns, and turns to one marked text each, reversibly.

A layout is told by its schema: the nested field paths of a record (`messages[].role`, ...)
that any mapping knows are sorted and hashed, and the hash is looked up among those of the
mappings (LAYOUTS: a mapping has one for its required paths with each choice of its optional
ones). A mapping is declarative: Column expressions that give a record's turns, as an array of
(role, text) structs. Where no hash fits, as when a column of another layout stands beside, the
mapping with the most required paths that are all there is taken. For tables the paths are
those of the schema, so the choice costs nothing; for JSON texts of mixed layouts each row's
paths are probed, hashed and looked up by expressions (`canonical_json`).

Canonical turns are rows (conv_id, pos, role, text), pos being any orderable value. `formatted`
writes a conversation's turns between markers of a Template: control strings in texts are
escaped by a backslash after their first character, one more where they have some, which `read`
takes off again; a role's backslashes and line ends are escaped as well. The loss mask has one
span (code points of the formatted text) per turn, empty for turns without loss. One shuffle
by conversation serves the offsets, the gathering and the reading: offsets are running sums
over rows, so that long conversations cost no more per turn than short ones.

Everything is DataFrame functions. A conversation is one row of the result, so its formatted
text must fit in a row (2 GiB), as its digest asks for anyway.

Defined results: null texts and roles are empty; turns of equal pos are ordered by role and text,
and repeated ones stay; a null pos comes first; a null conv_id is a conversation of its own; a
record without turns gives no row; JSON that cannot be read or whose layout is unknown gives no
turns, and `canonical_json` returns such rows with a null layout and an empty list; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Field access: path -> Column, for the mapping's expressions.
Get = Callable[[str], Column]


def paths(schema: T.DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a schema; an array's element is written []."""
    if isinstance(schema, T.StructType):
        return set(chain.from_iterable(paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in schema.fields))
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, f"{prefix}[]")
    return {prefix}


def fingerprint(fields: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _said(role: str, text: Column) -> Column:
    return turn(F.lit(role), text)


def _given(*turns: tuple[str, Column]) -> Column:
    """A turn per text that is there and not empty."""
    return F.filter(F.array(*(_said(role, text) for role, text in turns)), lambda t: t["text"] != "")


def _listed(role: str, text: str, names: dict[str, str]) -> Callable[[Column], Column]:
    """Turns of a list of structs; names translate roles."""

    def of(messages: Column) -> Column:
        renamed = lambda r: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), r), r) if names else r
        return F.transform(messages, lambda m: turn(renamed(m[role]), m[text]))

    return of


@dataclass(frozen=True)
class Layout:
    """A mapping: required and optional field paths, and the turns they make (None: the table's rows are turns already)."""

    name: str
    required: tuple[str, ...]
    turns: Callable[[Get], Column] | None
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[str]:
        choices = chain.from_iterable(combinations(self.optional, k) for k in range(len(self.optional) + 1))
        return [fingerprint({*self.required, *c}) for c in choices]


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def _instructed(get: Get) -> Column:
    asked = F.concat_ws("\n\n", get("instruction"), F.when(get("input") != "", get("input")))
    return F.concat(_given(("system", get("system"))), F.array(_said("user", asked), _said("assistant", get("output"))))


def _with_history(get: Get) -> Column:
    past = F.flatten(F.transform(F.coalesce(get("history[][]"), F.array().cast("array<array<string>>")), lambda pair: F.array(_said("user", F.get(pair, 0)), _said("assistant", F.get(pair, 1)))))
    return F.concat(_given(("system", get("system"))), past, F.array(_said("user", get("prompt")), _said("assistant", get("response"))))


#: All layouts, by precedence where several fit.
LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), None),
    Layout("messages", ("messages[].role", "messages[].content"), lambda get: _listed("role", "content", {})(get("messages[]"))),
    Layout("speakers", ("conversations[].from", "conversations[].value"), lambda get: F.concat(_given(("system", get("system"))), _listed("from", "value", _SPEAKERS)(get("conversations[]"))), ("system",)),
    Layout("instruction", ("instruction", "output"), _instructed, ("input", "system")),
    Layout("completion", ("prompt", "completion"), lambda get: F.concat(_given(("system", get("system"))), F.array(_said("user", get("prompt")), _said("assistant", get("completion")))), ("system",)),
    Layout("response", ("prompt", "response"), _with_history, ("history[][]", "system")),
    Layout("question", ("question", "answer"), lambda get: F.array(_said("user", F.concat_ws("\n\n", get("context"), get("question"))), _said("assistant", get("answer"))), ("context",)),
)
_KNOWN = frozenset(chain.from_iterable((*x.required, *x.optional) for x in LAYOUTS))
_BY_PRINT = {p: x for x in reversed(LAYOUTS) for p in x.fingerprints()}
#: Element types of the lists in JSON.
_JSON_LISTS = {"messages[]": "array<struct<role string, content string>>", "conversations[]": "array<struct<`from` string, value string>>", "history[][]": "array<array<string>>"}


def layout_of(schema: T.StructType) -> Layout:
    """The mapping for a table of this schema."""
    there = paths(schema)
    found = _BY_PRINT.get(fingerprint(there & _KNOWN))
    if found is None:
        fit = [x for x in LAYOUTS if there.issuperset(x.required)]
        if not fit:
            raise ValueError(f"no layout fits the fields {sorted(there)}")
        found = max(fit, key=lambda x: len(x.required))
    return found


def _rows(df: DataFrame, conv_id: Column, turns: Column) -> DataFrame:
    return df.select(conv_id.alias("conv_id"), F.posexplode(turns).alias("pos", "turn")).select("conv_id", F.col("pos").cast("long").alias("pos"), "turn.role", "turn.text")


def canonical(records: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, pos, role, text): the turns of a table of records of one layout."""
    layout, there = layout_of(records.schema), paths(records.schema)
    if layout.turns is None:
        said = turn(F.col("role"), F.col("text"))
        return records.select(F.col(conv_id).alias("conv_id"), F.col("turn").cast("long").alias("pos"), said["role"].alias("role"), said["text"].alias("text"))
    get = lambda path: F.col(path.split("[")[0]) if path in there or any(p.startswith(f"{path}.") for p in there) else F.lit(None).cast(_JSON_LISTS.get(path, "string"))
    return _rows(records, F.col(conv_id), layout.turns(get))


def canonical_json(records: DataFrame, payload: str = "payload", conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turns) of JSON records whose layouts may differ row by row; turns is an array of (role, text)."""
    layouts = [x for x in LAYOUTS if x.turns is not None]
    known = sorted(set(chain.from_iterable((*x.required, *x.optional) for x in layouts)))
    at = lambda path: "$." + path.replace("[]", "[0]")
    parsed = records.select(F.col(conv_id).alias("conv_id"), F.try_parse_json(F.col(payload)).alias("record"))
    probe = lambda path: F.when(F.try_variant_get("record", at(path), "string").isNotNull(), F.lit(path))
    there = F.array_compact(F.array(*map(probe, known)))  # sorted, as `known` is
    parsed = parsed.withColumn("there", there).withColumn("print", F.sha2(F.array_join("there", "\n"), 256))
    name = F.element_at(F.create_map(*(F.lit(x) for p, l in _BY_PRINT.items() if l.turns is not None for x in (p, l.name))), F.col("print"))
    for x in sorted(layouts, key=lambda x: -len(x.required)):
        name = F.coalesce(name, F.when(F.size(F.array_intersect("there", F.array(*map(F.lit, x.required)))) == len(x.required), x.name))
    named = parsed.withColumn("layout", name)
    get = lambda path: F.try_variant_get("record", "$." + path.split("[")[0], _JSON_LISTS.get(path, "string"))
    turns = F.coalesce(*(F.when(F.col("layout") == x.name, x.turns(get)) for x in layouts), F.array().cast("array<struct<role string, text string>>"))
    return named.select("conv_id", "layout", turns.alias("turns"))


@dataclass(frozen=True)
class Template:
    """Markers around a turn: open, role, line end, text, close. `controls` are escaped in texts, the markers among them.

    No control string holds its own or another's first character but at its beginning: then no
    two of them overlap, and escaping one makes none of another.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    _firsts: str = field(init=False, default="")

    def __post_init__(self):
        firsts = {c[0] for c in self.controls}
        if any(x in firsts or x == "\\" for c in self.controls for x in c[1:]) or "\\" in firsts or not {self.open, self.close.rstrip("\n")} <= set(self.controls):
            raise ValueError("control strings may overlap, or lack a marker")

    def _pattern(self, backslashes: str) -> str:
        quoted = lambda x: "".join(c if c.isalnum() else f"\\{c}" for c in x)
        by_first: dict[str, list[str]] = {}
        for c in self.controls:
            by_first.setdefault(c[0], []).append(quoted(c[1:]))
        return "|".join(f"(?<={quoted(x)}){backslashes}(?=\\\\*(?:{'|'.join(rest)}))" for x, rest in by_first.items())

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(""), r"\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\"), "")

    def role(self, role: Column) -> Column:
        return F.replace(F.replace(self.escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))

    def role_read(self, role: Column) -> Column:
        # A line end is a backslash and an n whose backslash is not the second of a pair.
        lines = F.regexp_replace(role, r"\\\\|\\n", "$0\u0000")  # mark each pair, left to right
        lines = F.replace(F.replace(lines, F.lit("\\n\u0000"), F.lit("\n")), F.lit("\\\\\u0000"), F.lit("\\"))
        return self.unescaped(lines)


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, loss_mask): one row a conversation; loss_mask has a span (start, end) per turn."""
    head = F.concat(F.lit(template.open), template.role(F.col("role")), F.lit("\n"))
    text = template.escaped(F.col("text"))
    rows = turns.select("conv_id", "pos", "role", F.col("text").alias("raw"), F.concat(head, text, F.lit(template.close)).alias("piece"), F.length(head).cast("long").alias("ahead"), F.length(text).cast("long").alias("own"))
    order = Window.partitionBy("conv_id").orderBy("pos", "role", "raw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.length("piece").cast("long")).over(order) - F.length("piece") + F.col("ahead")
    end = start + F.when(F.col("role").isin(*template.loss_roles), F.col("own")).otherwise(0)
    placed = rows.select("conv_id", F.struct(start.alias("start"), end.alias("end"), "piece").alias("turn"))
    # Starts grow from turn to turn, so they give the order.
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return gathered.select("conv_id", F.array_join("turns.piece", "").alias("formatted"), F.transform("turns", lambda t: F.struct(t["start"], t["end"])).alias("loss_mask"))


def read(texts: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted_chars, pos, role, text, loss): the turns of formatted texts, and what of each lies under the loss mask, null where nothing does.

    Conversations are told apart by conv_id.
    """
    split = F.split("formatted", "".join(f"\\{c}" if not c.isalnum() and c != "\n" else c for c in template.close))
    pieces = F.slice(split, 1, F.size(split) - 1)  # nothing stands behind the last marker
    rows = texts.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("loss_mask").alias("span"))).alias("pos", "turn"))
    rows = rows.select("conv_id", "formatted_chars", "pos", "turn.piece", "turn.span.start", "turn.span.end")
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("piece") + len(template.close)).over(before), F.lit(0))
    line = F.instr("piece", "\n")
    loss = F.when(F.col("end") > F.col("start"), template.unescaped(F.substring(F.col("piece"), (F.col("start") - offset + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))))
    return rows.select(
        "conv_id", "formatted_chars", "pos",
        template.role_read(F.substring(F.col("piece"), F.lit(len(template.open) + 1), line - 1 - len(template.open))).alias("role"),
        template.unescaped(F.substring(F.col("piece"), line + 1, F.length("piece") - line)).alias("text"),
        loss.alias("loss"),
    )


def digests(texts: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted texts."""
    said = F.struct("pos", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), F.coalesce("loss", F.lit("")).alias("loss"))
    whole = read(texts, template).groupBy("conv_id").agg(F.max("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list(said)).alias("turns"))
    whole = whole.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.turn", "").alias("said"), F.array_join("turns.loss", "").alias("learned"))
    return whole.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars"
    )
