"""Operators over groups that hold most of the rows, and passages inside documents, against plain loops."""

import itertools

import pytest
from pyspark.sql import functions as F

from weftline.operators import batch, dedup, finetune


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 7}", None if i % 13 == 0 else i * 37 % 50) for i in range(300)]
    return data, spark.createDataFrame(data, "i int, g string, n int")


def grouped(data):
    key = lambda r: (r[1] is not None, r[1] or "")
    return {k[1] if k[0] else None: list(v) for k, v in itertools.groupby(sorted(data, key=lambda r: (key(r), r[0])), key=key)}


def test_before_within_spreads_a_group_over_ranges(rows):
    data, df = rows
    want = {}
    for own in grouped(data).values():
        sums = list(itertools.accumulate((r[2] or 0 for r in own), initial=0))
        want |= {r[0]: (b, sums[-1]) for r, b in zip(own, sums, strict=False)}
    out = batch.before_within(df, "g", ["i"], F.coalesce("n", F.lit(0)), "b", total="t", rows_per_range=20).withColumn("p", F.spark_partition_id())
    assert {r.i: (r.b, r.t) for r in out.collect()} == want
    assert batch.before_within(df.where("false"), "g", ["i"], F.lit(1), "b").count() == 0
    assert df.columns == out.drop("b", "t", "p").columns


def test_stratified_fold_and_blocks(rows):
    data, df = rows
    per = batch.stratified_fold(df, "g", "i", 4).groupBy("g", "fold").count().collect()
    for g, own in grouped(data).items():
        sizes = [r["count"] for r in per if r.g == g]
        assert sum(sizes) == len(own)
        assert max(sizes) - (min(sizes) if len(sizes) == 4 else 0) <= 1
    want = {}
    for own in grouped(data).values():
        total, begin = sum(r[2] or 0 for r in own) // 64 * 64, 0
        for i, _, n in own:
            kept = max(0, min(begin + (n or 0), total) - begin)
            want[i] = (begin // 64, begin % 64, kept, (begin + kept - 1) // 64 if kept else None)
            begin += n or 0
    got = finetune.blocks(df, "g", "i", "n", 64).collect()
    assert {r.i: (r.first_block, r.offset, r.kept, r.last_block) for r in got} == want


def test_passages_inside_documents(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta", "xalpha beta gamma delta epsilon zeta etax", "alpha beta\ngamma delta", "abcdefghijk", "say abcdefghij k", "", None, " ", "a b", "beta gamma", "prefix alpha beta suffix", "alphabeta", "\n\n", "one  two"]
    items = ["alpha beta gamma delta epsilon zeta eta", "alpha beta", "beta gamma delta", "abcdefghij", "bcd", "b", "a b", " ", "", None, "a\ngamma d", "  ", "one  two", "\n", "gamma delta epsilon", "not there at all", "beta gamma"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("_item", F.lit("clash"))
    passages = spark.createDataFrame(list(enumerate(items)), "id int, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, p in enumerate(items) if t is not None and p is not None and p in t}
    got = dedup.containing(docs, "id", "text", passages.withColumnRenamed("id", "item"), "item", "text").collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)
    assert dedup.containing(docs, "id", "text", passages.where("false").withColumnRenamed("id", "item"), "item", "text").count() == 0
    assert dedup.containing(docs.where("false"), "id", "text", passages.withColumnRenamed("id", "item"), "item", "text").count() == 0
