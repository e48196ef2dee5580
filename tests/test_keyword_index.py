"""Keyword search by signatures against the plain search."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import catalog
from folioframe.operators import keyword_index as K


def test_literal_runs():
    assert K.literal_runs(r"ab%c\%d_ef\\g%") == ["ab", "c%d", "ef\\g"] and K.literal_runs("%_") == []


def test_search_skips_blocks(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeĐé") for _ in range(5))
    rows = [(i, i // 50, " ".join(word() for _ in range(4)), f"{word()}.TXT", None if i % 9 == 0 else f"{i}/QĐ", "", word(), "new", i) for i in range(1000)]
    rows[777] = (777, 777 // 50, "A Needle 100%_sure \\ here", "x.txt", None, None, None, "new", 777)
    schema = "id long, block long, title string, file_name string, document_number string, summary string, keywords string, status string, updated_at long"
    spark.createDataFrame(rows, schema).write.partitionBy("block").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    signature = K.signatures(table).cache()
    for keyword in ["needle", "NEEDLE", "need%sure", "100\\%\\_sure", "ne_dle", "abc", "ĐéĐ", "99/QĐ", "zzzz", "a", "%", "dee", "nosuchword"]:
        want = [x.id for x in catalog.search(table, keyword=keyword).collect()]
        assert [x.id for x in K.search(table, signature, keyword).collect()] == want, keyword
    assert [x.id for x in K.search(table, signature, "needle", status="new").collect()] == [777]
    read = K.blocks_to_read(signature, "needle")
    assert 777 // 50 in {x.block for x in read.collect()} and read.count() <= 3  # of 20 blocks
    assert K.blocks_to_read(signature, "ab") is None and K.blocks_to_read(signature, "nosuchword").count() <= 1
    assert K.search(table, K.signatures(table.limit(0)), "needle").count() == 0


@pytest.mark.parametrize("n", [0, 2, 3])
def test_signatures_of_short_texts(spark, n):
    df = spark.createDataFrame([(1, "a" * n, None)], "block long, title string, keywords string").select("*", *(F.lit("").alias(c) for c in ("file_name", "document_number", "summary")))
    assert K.signatures(df).count() == (n == 3)
