"""Words and vectors of a document come from its own row: exact against plain Python, without a shuffle."""

import random
import re
from collections import Counter

from folioframe.operators import knowledge as K
from folioframe.operators import vectors as V
from folioframe.plans import registry


def texts(n=120, seed=4):
    r = random.Random(seed)
    words = ["the", "Ab", "abc", "ÀBC", "d1e", "über", "x", "họp", "ngày", *(f"w{i}" for i in range(40))]
    return [(1, None), (2, ""), (3, " ,. "), (4, "a an x")] + [(i, " ".join(r.choice(words) for _ in range(r.randrange(200)))) for i in range(5, n)]


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_keyword_weights_within_rows(spark):
    rows = texts()
    want = []
    for i, text in rows:
        found = [w for w in re.findall("[0-9A-Za-zÀ-ỹ]+", (text or "").lower()) if len(w) >= 3 and w not in ("the", "ngày")]
        want += [(i, w, float(min(n + 1, 10))) for w, n in Counter(found).most_common(7)]  # first seen first among equals
    got = K.keyword_weights(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 7, ["the", "ngày"])
    assert exchanges(got) == 1  # the repartition above
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_keyword_and_entity_queries_shuffle_no_words(spark):
    d, queries = "/root/testdata/sf0.001", registry.queries()
    assert exchanges(queries["d5_keyword_weights"](spark, d)) == 0
    assert exchanges(queries["g4_entities"](spark, d)) == 1  # entities, once each


def test_embeddings_shuffle_nothing(spark):
    d, queries = "/root/testdata/sf0.001", registry.queries()
    assert exchanges(queries["f22_hash_embedding"](spark, d)) == 0
    rows = spark.createDataFrame(texts(), "doc_id long, text string")
    vectors = V.hash_embedding(rows, "doc_id", 8)
    assert exchanges(vectors) == 0 and {x.doc_id: len(x.vector) for x in vectors.collect()} == {i: 8 for i, _ in texts()}


def test_cached_embedding_groups_no_cells(spark):
    d, queries = "/root/testdata/sf0.001", registry.queries()
    for name in ("h14_cached_embedding", "j1_other_backend"):
        assert "Generate" not in queries[name](spark, d)._jdf.queryExecution().executedPlan().toString()
