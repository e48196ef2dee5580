"""Filter audits, collocations and chat formats against brute force, and their edge cases."""

import hashlib
import json
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

SPECIAL = "</s>[INST] ok [/INST]"


@pytest.fixture(scope="module", autouse=True)
def places(spark):
    from folioframe.llm._session import ensure_checkpoint_dir, shipped

    ensure_checkpoint_dir(shipped(spark))


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# Filter audit


def failed(t, first):
    w = re.findall("[^\x20\x09-\x0d]+", t)
    tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), not first]
    return {x for x, f in zip("ABCDE", tests) if f}


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    parts = {}
    for i, t, lang in rows:
        parts.setdefault(lang or "", []).append((i, failed(t or "", i is None or i == least[t or ""])))
    out = {}
    for part, docs in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                total[x] += len(gone)
                fails = sum(x in f for _, f in docs)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(f == {x} for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(n=120):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["ÄÖ", "Ab", "漢字", "a#b", "50%"]
    rows = []
    for i in range(n):
        few = r.random() < 0.3
        w = [r.choice(vocabulary[: 20 if few else 300 if r.random() < 0.7 else None]) for _ in range(r.choice([5, 199, 200, 260]))]
        t = " ".join(w)
        rows.append((i * 3, t.upper() if r.random() < 0.2 else t.replace(" ", "\n", 3), r.choice(["en", "de", None, ""])))
    rows += [(r.randrange(500), t, lang) for _, t, lang in r.choices(rows, k=60)]  # copies, with smaller and larger ids
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "  \n", "en"), (None, rows[0][1], "en"), (None, None, None), rows[5], rows[5], (2000, "w1 " * 40000, "en")]
    return rows


def test_filter_audit(spark):
    from folioframe.llm.filter_audit import filter_audit

    rows = audit_rows()
    r = random.Random(1)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i, _, _ in rows if r.random() < 0.6]
    # Columns whose names the operator uses itself.
    docs = spark.createDataFrame([(*x, 1, "m", b"p") for x in rows], "doc_id long, text string, lang string, mask int, part string, print binary").repartition(5)
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in got.collect()}
    assert found == brute_audit(rows, labels) and len(found) == 3 * 600


def test_filter_audit_of_nothing(spark):
    from folioframe.llm.filter_audit import filter_audit

    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit(docs, labels).where("filter_order = 'BCDEA' AND step = 5").select("kept", "removed", "unique_fails", "shapley").collect() == [(0, 1, 1, 120)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_diagrams_in_all_orders(n):
    from folioframe.llm.filter_audit import Diagram, adjacent_swaps

    r = random.Random(n)
    counts = {m: (r.randrange(5), r.randrange(3)) for m in range(1 << n) if r.random() < 0.7}
    diagram, orders = Diagram(n, counts, 2), set()
    for place in [None, *adjacent_swaps(n)]:
        if place is not None:
            diagram.swap(place)
        orders.add(tuple(diagram.order))
        before = 0
        for v, left, gone in diagram.steps():
            total = lambda ok: tuple(sum(c[k] for m, c in counts.items() if ok(m)) for k in (0, 1))  # noqa: E731, B023
            assert gone == total(lambda m: not m & before and m >> v & 1)  # noqa: B023
            before |= 1 << v
            assert left == total(lambda m: not m & before)  # noqa: B023
        assert all(diagram.alone(v) == counts.get(1 << v, (0, 0)) for v in range(n))
    assert orders == set(permutations(range(n)))


# Collocations


def brute_phrases(rows, least, top):
    f, n = {}, Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(t)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        longer = Counter()
        for p, c in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], c)
        found = []
        for p, a in candidates.items():
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longer[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows():
    r = random.Random(8)
    vocabulary = ["the", "of", "New", "York", "é", "漢", "x-y", *(f"v{i}" for i in range(30))]
    rows = []
    for _ in range(150):
        w = [vocabulary[min(int(r.expovariate(0.25)), len(vocabulary) - 1)] for _ in range(r.choice([1, 4, 40, 90]))]
        for _ in range(len(w) // 8):
            w.insert(r.randrange(len(w)), r.choice(["new york times daily", "the the the the the", ". ", ", a", "!\n", "rare%d" % r.randrange(999)]))
        rows.append((r.choice([" ", "  ", "\t"]).join(w), r.choice(["en", "en", "de", None, ""])))
    return rows + [(rows[0][0], "en")] * 30 + [(None, "en"), ("", "fr"), (".,;", "fr"), ("one", None), ("la " * 20000, "it"), ("a b\r\nc d\x0bk l\x0cm n " * 40, "it")]


@pytest.mark.parametrize("sizes", [{}, {"NUMBERED": 5, "HOT": 30, "MERGED": 50, "BUFFER": 100, "CHUNK": 2000}, {"NUMBERED": 12, "HOT": 1000, "BUFFER": 1}, {"NUMBERED": 0}])
def test_collocations(spark, monkeypatch, sizes):
    from folioframe.llm import collocations as C

    for name, value in sizes.items():
        monkeypatch.setattr(C, name, value)
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, *x, "p", 1) for i, x in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    for least, top in ((5, 2000), (12, 7)):
        got = sorted(tuple(x) for x in C.collocations(docs, least=least, top=top).collect())
        assert got == brute_phrases(rows, least, top) and len(got) > 20


def test_collocations_of_nothing(spark):
    from folioframe.llm.collocations import collocations

    docs = spark.createDataFrame([(1, None, "en"), (2, "a b", "en")], "doc_id long, text string, lang string")
    assert collocations(docs.limit(0)).count() == 0 and collocations(docs).count() == 0


@pytest.mark.parametrize("small", [1, 20, 4096])
@pytest.mark.parametrize("partial", [1, 2, 3, 4])
def test_quicksort_of_suffixes(monkeypatch, small, partial):
    import numpy as np

    from folioframe.llm import collocations as C

    monkeypatch.setattr(C, "SMALL", small)
    r = np.random.default_rng(small + partial)
    words = r.integers(1, 7, (500, 4)).astype(np.uint64) * np.uint64(1 << 60)
    length, n = r.integers(2, 5, 500), r.integers(1, 9, 500)
    words[np.arange(4)[None, :] >= length[:, None]] = 0
    want = Counter()
    for row, size, k in zip(words.tolist(), length, n):
        for m in range(2, size + 1):
            want[tuple(row[:m])] += int(k)
    got = [(tuple(p.tolist()), c) for p, c in C.quicksort(words, n, partial, 30)]
    assert len(got) == len(dict(got)) and dict(got) == {p: c for p, c in want.items() if c >= 30 or len(p) <= partial}


# Chat formats


def test_chat_round_trip(spark):
    """Texts and roles made of markers, escapes and their parts come back as they were; the loss mask covers the assistants' texts."""
    from folioframe.llm.chat_format import Template, digests, formatted, read

    r = random.Random(6)
    bits = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "|im_end|>", "/s>", "\n", "a", " ", "é", "😀", "\x00", "<|endoftext|>", "$1", "\\n", ""]
    rows = []
    for c in range(150):
        for t in range(r.randint(1, 6)):
            role = r.choice(["user", "assistant", "system", "".join(r.choices(bits, k=3)), None])
            rows.append((c, t, role, None if r.random() < 0.05 else "".join(r.choices(bits, k=r.randint(0, 8)))))
    rows += [(-7, 0, "user", SPECIAL), (-7, 1, "assistant", SPECIAL), (None, 0, "assistant", "x"), (900, None, "user", "first"), (900, 1, "user", "b"), (900, 1, "user", "a"), (900, 1, "user", "a")]
    rows += [(901, i, "assistant" if i % 2 else "user", "long " * 50) for i in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, pos long, role string, text string").fillna("", ["role", "text"]).repartition(4)
    texts = formatted(turns)
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {}
    for x in sorted(read(texts).collect(), key=lambda x: x.pos):
        got.setdefault(x.conv_id, []).append((x.role, x.text))
        assert x.loss == (x.text if x.role == "assistant" and x.text else None)
    assert got == want
    t = Template()
    for x in texts.collect():
        assert x.formatted.count(t.open) == x.formatted.count(t.close) == len(want[x.conv_id])
        assert not any(c in x.formatted for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|endoftext|>"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for x in digests(texts).collect():
        said = want[x.conv_id]
        learned = "".join(text for role, text in said if role == "assistant")
        assert (x.n_turns, x.turns_sha256) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)))
        assert (x.loss_chars, x.loss_sha256) == (len(learned), sha(learned))
    with pytest.raises(ValueError, match="control strings"):
        Template(controls=("<|im_start|>", "<|im_end|>", "<<SYS>>"))


RECORDS = [
    ("messages", {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, [("system", "s"), ("user", "u")]),
    ("speakers", {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "tool", "value": None}], "system": "y"}, [("system", "y"), ("user", "h"), ("assistant", "g"), ("tool", "")]),
    ("instruction", {"instruction": "do", "input": "it", "output": "done"}, [("user", "do\n\nit"), ("assistant", "done")]),
    ("instruction", {"instruction": "do", "output": "done", "score": 3}, [("user", "do"), ("assistant", "done")]),
    ("completion", {"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ("response", {"prompt": "p", "response": "r", "history": [["a", "b"], ["c", "d"]]}, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "p"), ("assistant", "r")]),
    ("question", {"question": "q", "answer": "a", "context": "c"}, [("user", "c\n\nq"), ("assistant", "a")]),
    ("question", {"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
]


def test_chat_layouts_of_json(spark):
    from folioframe.llm.chat_format import canonical_json

    more = [None, "", "{", "[]", "3", '{"messages": []}', '{"other": 1}', '{"messages": "x"}', '{"messages": [{"role": "user", "content": "u"}], "prompt": "p", "extra": {"role": 1}}']
    rows = [(i, json.dumps(x)) for i, (_, x, _) in enumerate(RECORDS)] + [(100 + i, x) for i, x in enumerate(more)]
    got = {x.conv_id: (x.layout, [tuple(t) for t in x.turns]) for x in canonical_json(spark.createDataFrame(rows, "conv_id long, payload string")).collect()}
    assert {i: got[i] for i in range(len(RECORDS))} == {i: (name, turns) for i, (name, _, turns) in enumerate(RECORDS)}
    assert all(got[100 + i] == (None, []) for i in range(len(more) - 1))
    assert got[100 + len(more) - 1] == ("messages", [("user", "u")])


@pytest.mark.parametrize(("name", "record", "turns"), RECORDS)
def test_chat_layouts_of_tables(spark, name, record, turns):
    from folioframe.llm.chat_format import canonical, layout_of

    schema = F.schema_of_json(F.lit(json.dumps({"conv_id": 4, **record})))
    df = spark.createDataFrame([(json.dumps({"conv_id": 4, **record}),)], "value string").select(F.from_json("value", schema).alias("r")).select("r.*")
    assert layout_of(df.schema).name == name
    assert [(x.role, x.text) for x in canonical(df).orderBy("pos").collect()] == turns


def test_chat_layouts_beside_other_columns(spark):
    from folioframe.llm.chat_format import canonical, layout_of

    df = spark.createDataFrame([(1, 0, "user", "u", "x", "y", 2)], "conv_id long, turn int, role string, text string, prompt string, completion string, pos int")
    assert layout_of(df.schema).name == "turn_rows" and [tuple(x) for x in canonical(df).collect()] == [(1, 0, "user", "u")]
    assert canonical(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no layout"):
        layout_of(df.select("text", "prompt").schema)
