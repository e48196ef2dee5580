"""The pipeline's stages on small tables."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    from folioframe.llm._session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = " ".join(f"word{i}" for i in range(120))
    item = " ".join(f"bench{i}" for i in range(20))
    texts = [base, base, base.replace("word60", "other"), "password: hunter2222 is here", f"{item} and more", "", None, "clean text of no harm"]
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({"score": F.lit("mine"), "blob": F.lit("mine")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 3, 5, 6, 7}
    assert got[3].text == "[REDACTED] is here" and got[3].n_chars == len("[REDACTED] is here")
    assert (got[0].text, got[0].score, got[0].blob, got[6].text) == (base, "mine", "mine", None)
    assert got[7].n_tokens == len(bytes(got[7].ids)) // 4 > 0
    assert [name for name, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "byte_bpe"]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, `__row` string"


def corpus_rows():
    """Near and exact copies, benchmark passages, secrets, junk, nulls, a repeated doc_id and a long text."""
    import random

    from test_operators import SECRETS, corpus, word

    r = random.Random(11)
    texts = [*corpus(40, 5), *(t for t in SECRETS if t), None, "", " . ", " ".join(word(r) for _ in range(9000))]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "mine", "mine", "mine") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "a null id", "en", "s", 9, "mine", "mine", "mine")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    from test_operators import corpus

    from folioframe.llm._session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder, rows = str(tmp_path_factory.mktemp("stages")), corpus_rows()
    spark.createDataFrame(rows, COLUMNS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    texts = [t for t in corpus(40, 5) if t and len(t.split()) > 25]
    items = [(i, " ".join(t.split()[5:25])) for i, t in enumerate(texts[:4])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    r = random.Random(1)
    spark.createDataFrame([(i, 1, int(r.random() < 0.4)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items


def stage(spark, tables, name, docs=None):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet") if docs is None else docs
    return dict(P.STAGES)[name](spark, docs, tables[0])


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("name", ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "byte_bpe"])
def test_stages_of_an_empty_table(spark, tables, name):
    docs = spark.createDataFrame([], COLUMNS)
    out = stage(spark, tables, name, docs)
    assert out.count() == 0 and set(docs.columns) <= set(out.columns)


def test_stage_toxicity(spark, tables):
    from folioframe.llm import toxicity as T

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    out = stage(spark, tables, "toxicity")
    assert out.columns == docs.columns
    model = T.fit(docs, spark.read.parquet(f"{tables[0]}/labels.parquet"))
    scores = T.scored(docs.select("doc_id", "text"), model).collect()
    import re

    gone = sorted(key((x.doc_id, x.text)) for x in scores if x.score >= 0.7 and re.search(T.WORD, x.text or ""))
    left = sorted(key((x.doc_id, x.text)) for x in out.collect())
    assert sorted(gone + left) == sorted(key((x[0], x[1])) for x in tables[1]) and gone
    assert {None, "", " . "} <= {x.text for x in out.collect()}


def test_stage_toxicity_without_two_classes(spark, tables, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    spark.createDataFrame([(i, 1, 1) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.toxic(spark, docs, str(tmp_path)).count() == len(tables[1])


def test_stage_near_copies(spark, tables):
    from test_operators import low, words

    rows, sets = tables[1], []
    for _, t, *_ in rows:
        w = words(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = {x[0]: x[0] for x in rows if x[0] is not None}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for x, s in zip(rows, sets):
        for y, t in zip(rows, sets):
            if s and None not in (x[0], y[0]) and x[0] < y[0] and 10 * len(s & t) >= 8 * len(s | t):
                a, b = sorted((top(x[0]), top(y[0])))
                group[b] = a
    want = sorted(key(x) for x in rows if x[0] is None or top(x[0]) == x[0])
    assert sorted(key(x) for x in stage(spark, tables, "ngram_jaccard_join").collect()) == want and len(want) <= len(rows) - 10


def test_stage_decontamination(spark, tables):
    from test_operators import brute_contamination

    rows = tables[1]
    bad = {x[0] for x, b in zip(rows, brute_contamination([x[1] for x in rows], tables[2])) if b[3] and x[0] is not None}
    out = stage(spark, tables, "benchmark_decontamination").collect()
    assert sorted(map(key, out)) == sorted(key(x) for x in rows if x[0] not in bad) and bad


def test_stage_secrets(spark, tables):
    import re

    from folioframe.llm import secret_scan as S

    want = []
    for x in tables[1]:
        spans = sorted((m.start(), m.end()) for p, g, n in S.RULES.values() for m in re.finditer(p, x[1] or "", re.ASCII) if len(m.group(g)) >= n)
        text, at = "", 0
        for a, b in spans:
            if a >= at:
                text += x[1][at:a] + "[REDACTED]"
            at = max(at, b)
        text = text + x[1][at:] if spans else x[1]
        want.append(key((x[0], text, *x[2:4], len(text) if spans else x[4], *x[5:])))
    got = stage(spark, tables, "secret_scans")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "score", "__row"]
    assert sorted(map(key, got.collect())) == sorted(want)


def test_stage_tokens(spark, tables):
    import public_tokenizers

    from folioframe.llm.byte_bpe import vocabulary

    v = vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = stage(spark, tables, "byte_bpe").collect()
    assert len(out) == len(tables[1]) and all(v.decode(bytes(x.ids)) == (x.text or "").encode() and x.n_tokens == len(bytes(x.ids)) // 4 and x.score == "mine" for x in out)
