"""Quality classifier: averaged vectors of hashed words and character n-grams, softmax output, numpy SGD."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import give_back, steps, table, unused

#: Labelled rows that training takes at most: those of the smallest hash of their id.
SAMPLE_ROWS = 4000
#: Bytes of their texts at most: rows are taken in order of the hash as long as they fit.
SAMPLE_BYTES = 64 << 20
BUCKETS = 1 << 17
DIMENSIONS = 16
GRAMS = (2, 3, 4)
#: Updates (documents seen) that training makes at least, and passes at most.
UPDATES, PASSES = 12_000, 150
RATE = 0.3
#: Bytes of text whose features a task holds at a time.
STEP = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(4095, 0x100000001B3, dtype=np.uint64)])


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - 17)).astype(np.int32)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Arrays (bucket, document) of all features of the texts, kind by kind: character n-grams of every length, words
    and pairs of words. Words are parted by bytes up to 32."""
    sep = b"\n"
    buf = np.frombuffer(sep + sep.join(texts) + sep, dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)  # of the bytes after the first
    doc = np.r_[np.int32(0), doc]
    b = buf.astype(np.uint64) + np.uint64(1)
    out = []
    for n in GRAMS:
        if len(b) <= n:
            continue
        h = b[: len(b) - n + 1].copy()
        for k in range(1, n):
            h = h * np.uint64(0x100000001B3) + b[k : len(b) - n + 1 + k]
        inside = doc[: len(h)] == doc[n - 1 :]
        out.append((_bucket(h, n)[inside], doc[: len(h)][inside]))
    blank = buf <= 32
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if len(starts):
        at = np.arange(len(buf)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(buf)]))
        h = np.where(blank, np.uint64(0), b * _POWERS[at & 4095])
        words = np.add.reduceat(h, starts)
        of = doc[starts]
        out.append((_bucket(words, 11), of))
        same = of[1:] == of[:-1]
        pairs = words[1:] ^ words[:-1]  # in either order; all pairs of a word with itself are one
        out.append((_bucket(pairs, 12)[same], of[1:][same]))
    return out


@dataclass(frozen=True)
class QualityModel:
    """Per bucket the difference of the two classes' outputs for its vector, and the difference of the biases.

    The output layer is linear in a mean of vectors, so one number per bucket scores as the vectors would.
    """

    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, doc in features(texts):
            total += np.bincount(doc, weights=self.weights[bucket], minlength=len(texts))
            count += np.bincount(doc, minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def train(texts: list[bytes], labels: list[int], seed: int = 17) -> QualityModel:
    """Document by document: mean of bucket vectors, softmax over two classes, gradient steps with a falling rate.

    The classes' errors are weighted to the same sum, up to a factor of 4. No rows give a model that scores 0.5; rows
    of one class give one that leans towards it.
    """
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    out = np.zeros((DIMENSIONS, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    if not texts:
        return QualityModel(np.zeros(BUCKETS, dtype=np.float32), 0.0)
    docs = []
    for t in texts:
        own = np.concatenate([x for x, _ in features([t])]) if t else np.zeros(0, np.int32)
        idx, n = np.unique(own, return_counts=True)
        docs.append((idx.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    y = np.array(labels)
    weight = np.clip(len(y) / (2.0 * np.maximum(np.bincount(y, minlength=2), 1)), 0.5, 2.0)
    passes = min(PASSES, max(2, -(-UPDATES // len(docs))))
    total, done = passes * len(docs), 0
    for _ in range(passes):
        for i in rng.permutation(len(docs)):
            idx, share = docs[i]
            rate = RATE * (1.0 - done / total)
            done += 1
            mean = share @ vectors[idx] if len(idx) else np.zeros(DIMENSIONS, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = p
            g[y[i]] -= 1.0
            g *= weight[y[i]]
            # a bucket's share of a document is small, so its step is scaled by the root of the document's buckets
            if len(idx):
                vectors[idx] -= np.float32(rate) * np.outer(share * np.sqrt(len(idx)), out @ g).astype(np.float32)
            out -= np.float32(rate) * np.outer(mean * np.sqrt(max(1, len(idx))), g).astype(np.float32)
            bias -= np.float32(0.1 * rate) * g
    diff = out[:, 1] - out[:, 0]
    return QualityModel((vectors @ diff).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 3, is 1. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """A model of the ``rows`` labelled documents at most with the smallest hashes of their ids, outside the held-out
    third, and of SAMPLE_BYTES of text at most. Labels other than 0 and 1 and null ids or labels take no part; of repeated rows the smallest text and label
    count."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "quality")
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.sum(F.octet_length("text")).alias("bytes"))  # bounded by ``rows``
    held = F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = sizes.withColumn("held", held).where(F.col("held") <= SAMPLE_BYTES).select("doc_id", "quality")
    found = texts.join(F.broadcast(fitting), "doc_id")

    def run(batches):
        got: dict[int, tuple[str, int]] = {}
        for b in batches:
            for doc, text, label in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "quality")), strict=True):
                got[doc] = min(got.get(doc, (text, label)), (text, label))
        ids = sorted(got)
        model = train([got[i][0].encode("utf-8") for i in ids], [int(got[i][1]) for i in ids])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weights", "bias"])

    # the bounded sample is trained on in one task, so that the driver holds no texts, only the model
    row = found.select("doc_id", "text", "quality").repartition(1).mapInArrow(run, "weights binary, bias double").first()
    return train([], []) if row is None else QualityModel(np.frombuffer(row.weights, dtype=np.float32), row.bias)


def score(docs: DataFrame, model: QualityModel, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` with the score (0 to 1) called ``name``, each row in its own task.

    Null and empty texts get the bias's score. Repeated rows score alike; a very long text is a step of its own; no
    rows give no rows. A column of that name is replaced, all others are kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    kept = docs.drop(name)
    names = kept.columns

    def run(batches):
        for b in steps(batches, "text", STEP):
            texts = [t or b"" for t in pc.cast(b.column("text"), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(texts), pa.float64())], [*names, name])
        give_back()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score at least 0.5 by a model of their own labelled rows, with their columns."""
    name = unused("quality_score", docs.columns)
    return score(docs, fit(docs, labels), name).where(F.col(name) >= 0.5).select(*docs.columns)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
