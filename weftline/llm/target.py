"""Importance resampling towards a target: hashed word features by a byte automaton, log gains, Gumbel draws."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import checkpointed, steps, table, unused

BUCKETS, WORDS, SEED = 10_000, 1, 2024
#: Texts of fewer words are not drawn; of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 10
#: Bytes by which all starts advance together; what is left of longer words goes on word by word.
TOGETHER = 128
#: Rows of one range of the order by score.
RANGE_ROWS = 50_000

#: Digits, small letters, and all bytes of characters beyond ASCII; capitals once they are lower-cased.
_WORD = np.array([chr(b).isascii() and chr(b).isalnum() or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def _crc_table() -> np.ndarray:
    """The 256 remainders of CRC-32 (reflected polynomial EDB88320)."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of an Arrow string column, and each word's start, length and row. A word never crosses rows."""
    if pa.types.is_large_string(column.type):
        offsets_type = np.int64
    else:
        column, offsets_type = column.cast(pa.string()), np.int32
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=offsets_type)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = _WORD[raw]
    edges = at[(at > 0) & (at < len(raw))]
    before, after = np.zeros(len(raw), dtype=bool), np.zeros(len(raw), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edges], after[edges - 1] = False, False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return _LOWER[raw], starts, stops - starts, np.searchsorted(at, starts, side="right") - 1


def advance(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The registers ``state`` of a CRC-32 after each has read ``lengths`` bytes from its start: all read their k-th byte in one step."""
    order = np.argsort(-lengths, kind="stable")
    state, at, size = state[order], starts[order], lengths[order]
    for k in range(min(int(size[0]), TOGETHER) if len(size) else 0):
        live = np.searchsorted(-size, -k, side="left")  # those longer than k
        state[:live] = _CRC[(state[:live] ^ raw[at[:live] + k]) & np.uint32(255)] ^ (state[:live] >> np.uint32(8))
    for i in range(np.searchsorted(-size, -TOGETHER, side="left")):
        state[i] = zlib.crc32(raw[at[i] + TOGETHER : at[i] + size[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def features(column: pa.Array, words: int = WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every run of 1 to ``words`` consecutive words of each text, joined by one space, and each text's
    number of words. The automaton of a longer run goes on where that of the run without its last word stands."""
    raw, starts, lengths, row = words_of(column)
    state = advance(np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), raw, starts, lengths)
    rows, found = [row], [(state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)]
    for n in range(1, words):
        has = row[: max(0, len(row) - n)] == row[n:]
        first = np.flatnonzero(has)
        state = state[: len(has)][has] if n == 1 else state[np.isin(begun, first)]
        begun = first
        state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = advance(state, raw, starts[first + n], lengths[first + n])
        rows.append(row[first])
        found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), np.bincount(row, minlength=len(column))


def bucket_counts(texts: DataFrame, column: str = "text", words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often a feature of all texts falls into each bucket. Tasks count first and send a row a bucket."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in steps(batches, "text"):
            total += np.bincount(features(b.column("text"), words, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return texts.select(F.col(column).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket floor(1000 ln(p / q)): p is its smoothed share of the target's features, q of the documents'."""
    counts = []
    for df in (docs, target):
        held = [0] * buckets
        for r in bucket_counts(df, "text", words, buckets).collect():  # a row a bucket at most
            held[r.bucket] = r.n
        counts.append(held)
    s_all, t_all = float(sum(counts[0])), float(sum(counts[1]))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(*counts, strict=True)], dtype=np.int64)


def _sampled(docs: DataFrame, target: DataFrame, percent: int, least_words: int, words: int, buckets: int, seed: int, name: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (its id among them) with a struct ``name``: n_features, weight, score, rank. They are all that is written and ordered."""
    gain = gains(docs, target, words, buckets)
    text, kept = docs.columns.index("text"), [docs.columns.index(c) for c in keep]

    def run(batches):
        for b in steps(batches, "text"):
            row, bucket, n_words = features(b.column(text), words, buckets)
            weight = np.zeros(b.num_rows, dtype=np.int64)
            np.add.at(weight, row, gain[bucket])
            more = [pa.array(n_words, pa.int64()), pa.array(np.bincount(row, minlength=b.num_rows), pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *more], [*keep, *own])

    own = [unused(x, docs.columns) for x in ("n_words", "n_features", "weight")]
    fields = [*(docs.schema.fields[i] for i in kept), *(T.StructField(x, T.LongType()) for x in own)]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = docs.mapInArrow(run, T.StructType(fields)).withColumn(name, F.struct((F.col(own[0]) >= least_words).alias("enough"), F.col(own[1]).alias("n_features"), F.col(own[2]).alias("weight"), (F.col(own[2]) + noise).alias("score"))).drop(*own)
    scored = checkpointed(scored)  # else the order's sample would read all texts once more
    order = [F.desc(f"{name}.enough"), F.desc(f"{name}.score"), F.asc_nulls_last("doc_id")]
    ranges = max(1, -(-scored.count() // RANGE_ROWS))
    # the written order: a row's place in its range is part of the id that Spark gives it
    ranged = checkpointed(scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order))
    place, part = unused("place", ranged.columns), unused("part", ranged.columns)
    placed = ranged.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33))
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"), F.count_if(f"{name}.enough").alias("enough"))
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias(f"{place}_before"), F.sum("enough").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{place}_enough"))  # a row a range
    rank = F.col(f"{place}_before") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = F.when(F.col(f"{name}.enough") & (rank <= F.floor(F.col(f"{place}_enough") * percent / 100)), rank)
    return placed.join(F.broadcast(before), part).withColumn(name, F.struct(f"{name}.n_features", f"{name}.weight", f"{name}.score", drawn.cast("long").alias("rank"))).select(*keep, name)


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, words: int = WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text); ``target`` has texts.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased; features are all
    runs of 1 to ``words`` of them, hashed by CRC-32 into ``buckets``. A feature's gain is the log of how much likelier
    its bucket is in the target than in the documents, a text's weight the sum of gains, its score the weight and Gumbel
    noise that the id's hash draws; so the rows of highest scores are a sample without replacement by the weights.
    ``rank`` counts from 1 among the drawn (``percent`` of those with ``least_words`` words), null for others.

    Counts cover all rows; tasks count buckets before they send them. Ranks come from ranges of the order that are
    written first and counted, so that no task sees all rows; many equal scores are told apart by id. Null and empty
    texts have no features, a weight of 0 and are not drawn; without a target its counts are 0. A null doc_id draws the
    noise of an empty one and comes last among equal scores; rows that repeat an id draw the same noise and are ranked
    each, in any order among equal ones. A very long text is a step of its own, a very long word is read on by itself
    after TOGETHER bytes. Other columns, whatever their names, are ignored; no rows give no rows.
    """
    return _sampled(docs.select("doc_id", "text"), target, percent, least_words, words, buckets, seed, "sampling", ["doc_id"]).select("doc_id", "sampling.*")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, as ``importance`` draws them."""
    options = {"percent": PERCENT, "least_words": LEAST_WORDS, "words": WORDS, "buckets": BUCKETS, "seed": SEED} | options
    name = unused("sampling", docs.columns)
    return _sampled(docs, target, name=name, keep=docs.columns, **options).where(F.col(f"{name}.rank").isNotNull()).select(*docs.columns)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER = "".join(map(chr, range(65, 91)))
#: CRC-32 by its table, of each different word once.
OP11_SQL = rf"""
with tab as (select list(list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) order by i) as t from range(256) r(i)),
words as (select 'd' as side, doc_id as id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents
 union all select 'b', null, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
counted as (select side, id, w, count(*) as n from words group by all),
hashed as (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::int, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} as bucket
 from (select distinct w from counted) cross join tab),
placed as (select side, id, bucket, sum(n)::bigint as n from counted join hashed using (w) group by all),
sums as (select bucket, coalesce(sum(n) filter (side = 'd'), 0)::double as s, coalesce(sum(n) filter (side = 'b'), 0)::double as t from placed group by bucket),
totals as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from sums),
gain as (select bucket, floor(1000 * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS}))))::bigint as g from sums cross join totals),
per_doc as (select id, sum(n)::bigint as n_features, sum(n * g)::bigint as weight from placed join gain using (bucket) where side = 'd' group by id),
scored as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
 from documents left join per_doc on doc_id = id),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as many from scored where n_features >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when rank <= many * {PERCENT} // 100 then rank end as rank from scored left join ranked using (doc_id)
"""
