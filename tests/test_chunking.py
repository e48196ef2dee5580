"""Chunks against the plain line by line model, in one range and in many."""

import random

import numpy as np
import pytest

from folioframe.operators import chunking as C
from folioframe.operators import structure as S

RULES = [("A", r"^# a"), ("B", r"^# b")]


def model(lines, limit, section="body"):
    """[(section, lines, tokens)]: lines are (text, tokens, section that it opens or None)."""
    out, buffer, held = [], [], 0
    for text, n, opens in lines:
        if buffer and (opens or held + n > limit):
            out.append((section, buffer, held))
            buffer, held = [], 0
        section = opens or section
        buffer, held = [*buffer, text], held + n
    return [*out, (section, buffer, held)] if buffer else out


def text_of(r, n):
    rows = []
    for _ in range(n):
        head = r.random() < 0.05
        words = r.choice([0, 1, 3, 10, 30, 60, 200] if r.random() < 0.2 else [0, 2, 5])
        rows.append((("# a" if r.random() < 0.5 else "# b") if head else "--") + " w" * words)
    return rows


def lines_of(rows):
    return [(x, x.count("w") + (x[0] == "#"), {"# a": "A", "# b": "B"}.get(x[:3])) for x in rows]


@pytest.mark.parametrize(("long", "size"), [(1 << 20, 4096), (40, 1), (1, 7), (200, 64)])
def test_chunks(spark, monkeypatch, long, size):
    monkeypatch.setattr(S, "LONG", long)
    monkeypatch.setattr(S, "RANGE", size)
    r = random.Random(size)
    texts = [text_of(r, r.choice([0, 1, 2, 20, 60])) for _ in range(250)]
    docs = [(i, "\n".join(t)) for i, t in enumerate(texts)] + [(1000, None), (1001, " \n\t\n"), (1002, "x" * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {}
    for x in sorted(S.chunks(df, RULES, 60).collect(), key=lambda x: x.chunk_order):
        got.setdefault(x.doc_id, []).append((x.chunk_order, x.section, x.text, x.token_count))
    want = {i: [(k, s, "\n".join(b), n) for k, (s, b, n) in enumerate(model(lines_of(t), 60), 1)] for i, t in enumerate(texts) if t}
    assert got == {**want, 1002: [(1, "body", "x" * 50, 1)]}


@pytest.mark.parametrize("limit", [5, 60])
def test_ranges_in_order_are_the_whole(limit):
    """The tables of ranges, followed in order, give the beginnings of the whole document."""
    r = random.Random(limit)
    for _ in range(150):
        n = [r.choice([0, 0, 1, 2, 7, limit, limit + 1, 3 * limit]) for _ in range(r.randint(1, 60))]
        opens = [r.random() < 0.1 for _ in n]
        whole = C.starts(np.array(n), np.array(opens), C.EMPTY, limit)
        lines = [(i, x, "s" if o else None) for i, (x, o) in enumerate(zip(n, opens))]
        assert whole == [b[0] for _, b, _ in model(lines, limit)]
        state, count, at, met = C.EMPTY, 0, 0, []
        while at < len(n):
            size = r.randint(1, 9)
            part, flags = np.array(n[at : at + size]), np.array(opens[at : at + size])
            met += [at + s for s in C.starts(part, flags, state, limit)]
            held, begun = C.table(part, flags, limit)
            place = limit + 2 if state == C.EMPTY else state
            state, count, at = held[place], count + begun[place], at + size
        assert met == whole and count == len(whole)


def test_a_document_of_very_many_lines(spark, monkeypatch):
    monkeypatch.setattr(S, "LONG", 1000)
    r = random.Random(3)
    rows = text_of(r, 2000) * 100
    df = spark.createDataFrame([(1, "\n".join(rows))], "doc_id long, text string")
    got = [(x.section, x.token_count, len(x.text)) for x in S.chunks(df, RULES, 180).orderBy("chunk_order").collect()]
    assert got == [(s, n, len("\n".join(b))) for s, b, n in model(lines_of(rows), 180)]


def plain_sections(lines, headings, most):
    out, kind, title, buffer = [], "Mở đầu", "Mở đầu", []
    for x in lines:
        found = next((k for s, k in headings if s.lower() in x.lower()), None) or ("Tiêu đề" if x == x.upper() != x.lower() and len(x) <= 120 else None)
        if found:
            out += [(kind, title, "\n".join(buffer))] if buffer else []
            kind, title, buffer = found, x[:120], []
        else:
            buffer.append(x)
    return (out + [(kind, title, "\n".join(buffer))] if buffer or not out else out)[:most]


def test_template_sections(spark):
    from folioframe.functions import rules as R

    r = random.Random(4)
    texts = [[r.choice(["plain text", "LOUD", "part one of it", "42", "more " * 40]) for _ in range(r.choice([0, 1, 4, 90]))] for _ in range(60)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    headings = [("part", "Part")]
    got = {}
    for x in S.template_sections(df, headings, 20).orderBy("doc_id", "section_order").collect():
        got.setdefault(x.doc_id, []).append((x.section_type, x.title, x.content))
    clean = lambda t: [x.strip() for x in t]
    want = {i: plain_sections(clean(t), headings, 20) for i, t in [*enumerate(texts), (99, [])]}
    renamed = {"Mở đầu": R.OPENING, "Tiêu đề": R.HEADING}
    assert got == {i: [(renamed.get(k, k), renamed.get(t, t), c) for k, t, c in v] for i, v in want.items()}
