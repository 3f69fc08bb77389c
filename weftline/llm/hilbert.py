"""Approximate nearest neighbours by inner product: several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, table

#: Curves in all, projections of each, and bits of a projection.
CURVES, PLANES, BITS = 512, 2, 7
#: A vector stands on so many of the curves, those on which it lies farthest out; a query asks as many.
OWN = 32
#: A curve's cells are shifted by up to this share of the whole.
SHIFT = 0.125
#: Ranks on each side of a query that a curve offers: so many at least, or a share of a power of the number of vectors
#: (at 10,000 vectors 65, at 50,000 240, at 1,000,000,000 some 815,000).
WINDOW, WINDOW_SHARE, WINDOW_POWER = 64, 0.034, 0.82
QUERIES_AT_ONCE = 256
#: Bins of a doubling of length, and bins of a band. Vectors of one band differ in length by a factor of 4 at most, and
#: each band is ordered by itself, so that a long vector spoils no other's order.
BINS, BAND = 8, 16


def window_of(n: int) -> int:
    return max(WINDOW, int(WINDOW_SHARE * n**WINDOW_POWER))


def log_norms(x: np.ndarray) -> np.ndarray:
    """The binary logarithms of the vectors' lengths, which neither overflow nor vanish: each is scaled by its largest entry first."""
    e = np.frexp(np.abs(x).max(axis=1))[1]
    return e + np.log2(np.linalg.norm(np.ldexp(x, -e[:, None]), axis=1))


@dataclass(frozen=True)
class Curves:
    """Projections and shifts of all curves; of each band of lengths its largest (a logarithm), its number of points, and
    the scale that makes its projected coordinates about uniform."""

    planes: np.ndarray  # dimensions + 1, curves * planes of each
    shifts: np.ndarray  # curves, planes of each
    starts: np.ndarray  # of bands: the first bin of each, descending
    tops: np.ndarray
    counts: np.ndarray
    mean: np.ndarray  # bands, curves * planes of each
    deviation: np.ndarray

    def bands(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(-self.starts, -np.floor(log_norms(x) * BINS).astype(np.int64), side="right") - 1

    def lift(self, x: np.ndarray, query: bool, band: int) -> np.ndarray:
        """Vectors of one length, so that the largest inner product is the nearest: candidates of a band get the
        coordinate that fills them up to the band's largest length, queries are scaled to it. Both are scaled by a power of two."""
        whole = int(np.floor(self.tops[band]))
        top = 2.0 ** (self.tops[band] - whole)
        if query:
            y = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
            return np.c_[y * (top / np.linalg.norm(y, axis=1))[:, None], np.zeros(len(x))]
        y = np.ldexp(x, -whole)
        return np.c_[y, np.sqrt(np.maximum(top**2 - (y * y).sum(axis=1), 0.0))]

    def places(self, x: np.ndarray, query: bool, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Per vector the curves on which it lies farthest from the middle, the farthest first, and its keys there.

        What lies near a vector lies about as far out, and there few others do, so such curves tell most.
        """
        z = ((self.lift(x, query, band) @ self.planes - self.mean[band]) / self.deviation[band]).reshape(len(x), *self.shifts.shape)
        count = min(OWN, len(self.shifts))
        curve = np.argsort(-(z * z).sum(axis=2), axis=1, kind="stable")[:, :count]
        own = np.take_along_axis(z, curve[:, :, None], axis=1)
        u = 1.0 / (1.0 + np.exp(-1.702 * own.clip(-300, 300)))  # close to the normal distribution function
        cells = ((u + self.shifts[curve]) / (1 + SHIFT) * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
        return curve, hilbert(cells.reshape(-1, cells.shape[2]), BITS).reshape(curve.shape)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cell coordinates (below 2 ** bits)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections from the highest bit down
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | x[i] >> bit & 1
    return place


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, vec (packed floats, of 32 bits if the column's are): without null, zero, empty and non-finite vectors and
    null ids. Of an id's different vectors the smallest stays, compared as lists."""
    single = "float" in vectors.schema[column].dataType.simpleString()
    v = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<float>" if single else "array<double>").alias("vec")).where("id is not null and vec is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.where(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)).groupBy("id").agg(F.min("vec").alias("vec"))
    kind = "<f4" if single else "<f8"

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([np.asarray(x, dtype=kind).tobytes() for x in b.column("vec").to_pylist()], pa.binary())], ["id", "vec"])

    return v.mapInArrow(run, "id long, vec binary")


def unpack(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)


def fit(points: DataFrame, kind: str, seed: int = 5) -> Curves | None:
    """Random projections; bands of lengths, and the projections' means and deviations in each, over all points. None
    without points. All points have one length of ``vec``. Bins of lengths are as many as there are exponents at most."""
    first = points.select("vec").first()
    if first is None:
        return None
    dims = len(first.vec) // np.dtype(kind).itemsize
    rng, curves = np.random.default_rng(seed), CURVES
    each = min(PLANES, dims + 1)
    per = (dims + 1) // each  # curves that one rotation serves
    rotations = [np.linalg.qr(rng.standard_normal((dims + 1, dims + 1)))[0][:, : per * each] for _ in range(-(-curves // per))]
    planes = np.concatenate(rotations, axis=1)[:, : curves * each]
    shifts = SHIFT * rng.random((curves, each))

    def lengths(batches):
        for b in batches:
            if b.num_rows:
                n = log_norms(unpack(b.column("vec"), kind))
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(n * BINS).astype(np.int64)), pa.array(n)], ["bin", "n"])

    bins = sorted(points.mapInArrow(lengths, "bin long, n double").groupBy("bin").agg(F.max("n"), F.count("*")).collect(), reverse=True)
    starts: list[int] = []
    tops: list[float] = []
    counts: list[int] = []
    for at, top, count in bins:
        if not starts or at <= starts[-1] - BAND:
            starts.append(at)
            tops.append(top)
            counts.append(0)
        counts[-1] += count
    draft = Curves(planes, shifts, np.array(starts), np.array(tops), np.array(counts), np.zeros((0, 0)), np.zeros((0, 0)))

    def sums(batches):
        for b in batches:
            if b.num_rows:
                x = unpack(b.column("vec"), kind)
                band = draft.bands(x)
                for k in np.unique(band).tolist():
                    y = draft.lift(x[band == k], False, k) @ planes
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(y.shape[1], k)), pa.array(np.arange(y.shape[1])), pa.array(y.sum(axis=0)), pa.array((y * y).sum(axis=0))], ["band", "k", "s", "s2"])

    rows = sorted(points.mapInArrow(sums, "band long, k long, s double, s2 double").groupBy("band", "k").agg(F.sum("s"), F.sum("s2")).collect())
    s, s2 = (np.array([float(r[i]) for r in rows]).reshape(len(starts), -1) / draft.counts[:, None] for i in (2, 3))
    return Curves(planes, shifts, draft.starts, draft.tops, draft.counts, s, np.sqrt(np.maximum(s2 - s**2, 1e-18)))


def best_of_block(query: dict, other: dict, window: int, k: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, gid, score) of the k + 1 best of a block within the window of each query, ties by the smaller gid.

    A fast product finds the candidates; all that might be among the best, ties included, are computed again one by
    one, so that equal vectors always score the same.
    """
    x, y = unpack(other["vec"], kind), unpack(query["vec"], kind)
    out = []
    for a in range(0, len(y), QUERIES_AT_ONCE):
        part = slice(a, a + QUERIES_AT_ONCE)
        inside = np.abs(query["rank"][part][:, None] - other["rank"][None, :]) <= window
        m = min(k + 1, len(x))
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.where(inside, y[part] @ x.T, -np.inf)
            least = np.partition(s, len(x) - m, axis=1)[:, len(x) - m]
            slack = 1e-9 * np.abs(least) + 1e-12 * np.linalg.norm(y[part], axis=1) * np.linalg.norm(x, axis=1).max()
            # products or slack that overflow leave all of the window to be computed again
            q, c = np.nonzero(inside & (~np.isfinite(least - slack)[:, None] | (s >= (least - slack)[:, None])))
            score = (y[part][q] * x[c]).sum(axis=1)
        gid = other["gid"][c]
        order = np.lexsort((gid, -score, q))
        q, gid, score = q[order], gid[order], score[order]
        first = np.searchsorted(q, np.arange(len(y[part])))
        top = np.arange(len(q)) - first[q] <= k
        out.append((query["gid"][part][q[top]], gid[top], score[top]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def nearest(vectors: DataFrame, id_column: str, column: str, is_query: F.Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest others by inner product, among the windows' vectors.

    ``is_query`` is a condition on ``id``. Equal vectors are one point of the curves, with its k + 1 smallest ids, so
    copies neither fill a window nor a task. Each point stands on OWN of the curves, which order their points; a query
    asks as many and is compared with the points within ``window_of`` all points ranks of its own place, in blocks of
    that many ranks; the curves' best are merged and ranked again by exact products.

    Ties go to the smaller id, also at the edge of what a block returns. Unusable vectors (null, zero, empty, with
    null or non-finite components) and null ids take no part, nor do vectors of another dimension than most (of equally
    many the larger one); an id with several vectors has the smallest of them. Very long and very short vectors are scaled
    before they are measured, and products that overflow are infinite;
    other columns, whatever their names, are ignored. No usable rows give no rows; fewer than k others give them all.
    """
    spark = vectors.sparkSession
    kind = "<f4" if "float" in vectors.schema[column].dataType.simpleString() else "<f8"
    points = checkpointed(usable(vectors, id_column, column))
    sizes = points.groupBy(F.length("vec").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(2).collect()
    if len(sizes) > 1:
        points = points.where(F.length("vec") == sizes[0].size)
    top_ids = Window.partitionBy("vec").orderBy("id")
    ids = points.withColumn("n", F.row_number().over(top_ids)).where(F.col("n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asks = points.groupBy("vec").agg(F.min("id").alias("gid"), F.max(is_query).alias("asks"))
    groups = checkpointed(asks.join(ids, "vec"))
    curves = fit(groups.select("vec"), kind)
    result = "query_id long, rank int, vec_id long, score double"
    if curves is None:
        return spark.createDataFrame([], result)
    windows, of_band = np.array([window_of(n) for n in curves.counts.tolist()]), len(curves.shifts)
    sent = spark.sparkContext.broadcast(curves)  # of fixed size

    def place(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                x, asking = unpack(b.column("vec"), kind), b.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                own = sent.value.bands(x)
                for query, band in product((False, True), range(len(windows))):
                    rows = np.flatnonzero(asking if query else own == band)  # queries ask every band
                    if not len(rows):
                        continue
                    curve, key = sent.value.places(x[rows], query, band)
                    curve = curve + band * of_band
                    take = pa.array(np.repeat(rows, curve.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(curve.reshape(-1).astype(np.int32)), pa.array(key.reshape(-1)), b.column("gid").take(take), pa.array(np.full(len(take), query)), b.column("vec").take(take)],
                        ["curve", "key", "gid", "query", "vec"],
                    )

    places = groups.select("gid", "asks", "vec").mapInArrow(place, "curve int, key long, gid long, query boolean, vec binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the id is a range column too, so that many points of one key are split
    ordered = checkpointed(places.repartitionByRange(parts, "curve", "key", "gid").sortWithinPartitions("curve", "key", "gid", "query"))
    found = ordered.groupBy(F.spark_partition_id().alias("p"), "curve").agg(F.sum(F.when(F.col("query"), 0).otherwise(1)).alias("n")).collect()
    before: dict[tuple[int, int], int] = {}
    total: dict[int, int] = {}
    for r in sorted(found, key=lambda r: (r.curve, r.p)):
        before[r.p, r.curve] = total.get(r.curve, 0)
        total[r.curve] = before[r.p, r.curve] + r.n

    def deal(batches):
        at = {c: before[p, c] for p, c in before if p == TaskContext.get().partitionId()}
        for b in batches:
            curve, query = b.column("curve").to_numpy(), b.column("query").to_numpy(zero_copy_only=False)
            rank = np.zeros(len(curve), dtype=np.int64)
            for c in np.unique(curve).tolist():
                here = curve == c
                own = np.cumsum(~query[here])
                rank[here] = at[c] + own - 1
                at[c] += int(own[-1])
            window = windows[curve // of_band]
            rows, blocks = [np.flatnonzero(~query)], [rank[~query] // window[~query]]
            q = np.flatnonzero(query)
            for step in (-1, 0, 1):
                near = rank[q] // window[q] + step
                inside = (near >= 0) & (near * window[q] < np.array([total.get(c, 0) for c in curve[q].tolist()], dtype=np.int64))
                rows.append(q[inside])
                blocks.append(near[inside])
            take = np.concatenate(rows)
            idx = pa.array(take)
            yield pa.RecordBatch.from_arrays([b.column("curve").take(idx), pa.array(np.concatenate(blocks)), pa.array(rank[take]), *(b.column(x).take(idx) for x in ("gid", "query", "vec"))], ["curve", "block", "rank", "gid", "query", "vec"])

    def compare(batches):
        for (curve, _), rows in groupby(runs(batches), key=lambda r: r[0]):
            t = pa.Table.from_batches([r for _, r in rows])
            query = t.column("query").to_numpy()
            sides = []
            for side in (query, ~query):
                own = t.filter(pa.array(side))
                sides.append({"gid": own.column("gid").to_numpy(), "rank": own.column("rank").to_numpy(), "vec": own.column("vec").combine_chunks()})
            if len(sides[0]["gid"]) and len(sides[1]["gid"]):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in best_of_block(*sides, int(windows[curve // of_band]), k, kind)], ["query", "gid", "score"])

    dealt = ordered.mapInArrow(deal, "curve int, block long, rank long, gid long, query boolean, vec binary")
    dealt = dealt.repartition(parts, "curve", "block").sortWithinPartitions("curve", "block")
    best = dealt.mapInArrow(compare, "query long, gid long, score double")
    best = best.groupBy("query", "gid").agg(F.max("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "gid"))).where(F.col("n") <= k + 1)
    offered = best.join(groups.select("gid", "ids"), "gid").select("query", "score", F.explode("ids").alias("vec_id"))
    offered = offered.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    offered = offered.groupBy("query").agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))  # k + 1 at most
    queries = points.where(is_query).join(groups.select("vec", F.col("gid").alias("query")), "vec").select(F.col("id").alias("query_id"), "query")
    pairs = queries.join(offered, "query").select("query_id", F.explode("near").alias("n")).select("query_id", "n.*").where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def runs(batches) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The stretches of rows of one curve and block, which stand together."""
    for b in batches:
        curve, block = b.column("curve").to_numpy(), b.column("block").to_numpy()
        cuts = np.flatnonzero((curve[1:] != curve[:-1]) | (block[1:] != block[:-1])) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(curve)], strict=True):
            if stop > start:
                yield (int(curve[start]), int(block[start])), b.slice(start, stop - start)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)
