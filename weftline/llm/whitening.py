"""Whitening of vectors: covariance by one aggregation of centred products, eigenvectors by LAPACK, projection."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, table

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Columns of the triangle in a group; Spark compiles aggregations of up to 100 columns as one stage.
WIDTH = 64
#: The largest entry that stands for itself; farther ones count as it.
FAR = 1 << 62


def upper_triangle(centred: DataFrame, d: int, n: int) -> np.ndarray:
    """The covariance (divisor ``n``) of the ``d`` entries of the centred array column ``y``, by one aggregation.

    A group is a row of the triangle (WIDTH columns of it, if it is longer), and an expression for each column sums the
    products of the row's entry with that column's; entries left of the diagonal are not summed. So many expressions
    stay within one compiled stage, which a column for each pair of dimensions would not, and tasks send their sums.
    """
    last = (d - 1) // WIDTH
    rows = centred.select("y", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("i"))
    rows = rows.select("y", "i", F.get("y", F.col("i")).alias("a"), F.explode(F.expr(f"sequence(int(i div {WIDTH}), {last})")).alias("b"))
    sums = rows.groupBy("i", "b").agg(*(F.expr(f"sum(if(i <= {WIDTH} * b + {k}, a * get(y, {WIDTH} * b + {k}), null)) as s{k}") for k in range(min(d, WIDTH))))
    out = np.zeros((d, d))
    for r in sums.collect():  # a row of the triangle each
        for k in range(min(d, WIDTH)):
            j = WIDTH * r.b + k
            if r.i <= j < d:
                out[r.i, j] = out[j, r.i] = (r[f"s{k}"] or 0.0) / n
    return out


def whitened(df: DataFrame, id_column: str, vector: str, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each vector of ``df`` and component.

    Entries become integers floor(scale c) + shift, which sum exactly; the covariance of all vectors then is the upper
    triangle of centred products, its unit eigenvectors the components, by falling eigenvalue e. ``whitened`` is the
    centred vector on the component over sqrt(e), ``deviation`` n * n times the squared distance from the mean
    (exact; null beyond 64 bits), ``explained`` the share of e in the trace, ``identity_error`` the largest entry by
    which the covariance of all whitened vectors, summed likewise, departs from the identity.

    Vectors that are null or hold null, NaN or infinite entries take no part. The dimension is that of most vectors (of
    equally many the larger one); vectors of other lengths take no part. Repeated rows and null ids count and are
    returned like others. Entries beyond 2^62 count as that. Components without variance (fewer different vectors than
    dimensions, constant entries) don't exist; equal vectors only, empty vectors and no rows give no rows. Ties among
    eigenvalues are ordered as LAPACK gives them, once for all rows. Other columns, whatever their names, are ignored.
    The driver holds sums of dimensions and pairs of dimensions, never rows.
    """
    v = F.col(vector).cast("array<double>")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vectors = df.select(F.col(id_column).alias("id"), v.alias("v")).where("v is not null").where(sound)
    kind = dict(vectors.dtypes)["id"]
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    size = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None or size.d == 0:
        return nothing
    d, n = size.d, size.n
    whole = lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(float(shift - FAR))), F.lit(float(FAR - shift)))) + shift
    x = vectors.where(F.size("v") == d).select("id", F.transform("v", whole).alias("x"))
    sums = x.agg(*(F.sum(F.col("x")[i].cast("decimal(19,0)")).alias(f"s{i}") for i in range(d))).first()
    sums = [int(s) for s in sums]
    near = [round(Fraction(s, n)) for s in sums]  # integers next to the means, and what remains of the means
    rest = [float(Fraction(s, n) - c) for s, c in zip(sums, near, strict=True)]
    fixed = [F.array(*map(F.lit, c)) for c in (near, rest)]
    centred = x.select(F.transform("x", lambda c, i: (c - F.get(fixed[0], i)).cast("double") - F.get(fixed[1], i)).alias("y"))
    cov = upper_triangle(centred, d, n)
    top = float(np.abs(cov).max())
    if top == 0:
        return nothing
    values, axes = np.linalg.eigh(cov / top)  # ascending
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > values[0] * d * np.finfo(float).eps).sum()))
    explained = (values[:k] / np.trace(cov / top)).tolist()
    onto = axes[:, :k] / (np.sqrt(values[:k]) * math.sqrt(top))
    base, frac, gap = np.array(near, dtype=np.int64), np.array(rest), [n * c - s for c, s in zip(near, sums, strict=True)]

    def run(batches):
        for b in batches:
            apart = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - base
            on = (apart.astype(np.float64) - frac) @ onto
            far = np.abs(apart).max(initial=0)
            if d * (float(n) * (float(far) + 1)) ** 2 < 2**62:
                deviation = ((n * apart + np.array(gap, dtype=np.int64)) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((n * a + g) ** 2 for a, g in zip(row, gap, strict=True)) for row in apart.tolist()]
                deviation = [e if e < 1 << 63 else None for e in exact]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * k, k), pa.int32()), pa.array(on.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(deviation, pa.int64()), lists], ["id", "deviation", "on"])

    done = checkpointed(x.mapInArrow(run, f"id {kind}, deviation long, on array<double>"))
    means = done.agg(*(F.avg(F.col("on")[i]).alias(f"m{i}") for i in range(k))).first()
    middle = F.array(*map(F.lit, means))
    again = upper_triangle(done.select(F.transform("on", lambda c, i: c - F.get(middle, i)).alias("y")), k, n)
    error = float(np.abs(again - np.eye(k)).max())
    rows = done.select("id", "deviation", F.posexplode("on").alias("at", "whitened"))
    share = F.array(*map(F.lit, explained))
    return rows.select(F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
