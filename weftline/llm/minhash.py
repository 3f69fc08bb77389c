"""Near-duplicates: ProbMinHash signatures of weighted five-word shingles, banding, exact verification, classes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, gathered, steps, table
from weftline.llm.links import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 a pair shares no band with a probability of 0.00006.
BANDS, ROWS = 32, 6
#: A prime, so that every stride visits all registers.
REGISTERS = 193
#: Rounds in which each text is compared with one leader of its buckets, before the remaining pairs are compared.
ROUNDS = 2
#: About the bytes of shingles in a block.
BLOCK_BYTES = 2 << 20
#: Ids that a join sends to all executors at most; beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000
#: Pairs with their shingles that one task compares.
SETS_PER_TASK = 4000
#: Bytes of text whose shingles a task holds at a time.
STEP = 2 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes that part words: white space and ASCII punctuation, so that a full stop or a comma does not make another word.
_BLANK = np.array([b <= 32 or (b < 128 and not chr(b).isalnum()) for b in range(256)])
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(4095, 0x100000001B3, dtype=np.uint64)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MUL
    h = (h ^ (h >> np.uint64(27))) * _MIX
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[str], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 48-bit shingle, count), each shingle once per document, in ascending order.

    Words are lower-cased and parted by white space of code points up to 32 and by ASCII punctuation. A text of fewer
    words is one shingle of all of them; a text without words has none. At most 65,535 texts at a time.
    """
    raw = [t.lower().encode("utf-8") for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)
    doc = np.r_[0, np.repeat(np.arange(len(raw)), np.fromiter((len(t) + 1 for t in raw), dtype=np.int64, count=len(raw)))]
    blank = _BLANK[buf]
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    at = np.arange(len(buf)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(buf)]))
    h = np.where(blank, np.uint64(0), (buf.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 4095])
    word, of = _mix(np.add.reduceat(h, starts)), doc[starts]
    n = np.bincount(of, minlength=len(raw))
    first = np.r_[0, np.cumsum(n)[:-1]]
    index = np.arange(len(word)) - first[of]
    size = np.minimum(n, words)
    mine = index + size[of] <= n[of]  # places where a shingle begins
    begins = np.flatnonzero(mine)
    out = np.zeros(len(begins), dtype=np.uint64)
    for k in range(words):
        has = k < size[of[begins]]
        out = np.where(has, out * np.uint64(0x100000001B3) + word[np.minimum(begins + k, len(word) - 1)], out)
    key = np.sort(of[begins].astype(np.uint64) << np.uint64(48) | _mix(out) >> np.uint64(16))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[new, len(key)]).astype(np.float64)
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


def signatures(n_docs: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per document and register the shingle that arrives there first; 0 in documents without shingles.

    Each shingle is a Poisson process of its weight's rate: its k-th arrival comes at a time that its hash draws and
    goes to the k-th register of its own order of all registers (a random start and stride modulo a prime). It ends
    once its time is past the latest first arrival of its document, as nothing it brings can be first any more. Two
    documents agree in a register with their probability Jaccard similarity.
    """
    m = REGISTERS
    times = np.full((n_docs, m), np.inf)
    held = np.zeros((n_docs, m), dtype=np.uint64)
    seed = _mix(shingle * _MIX + np.uint64(1))
    start, stride = (seed % np.uint64(m)).astype(np.int64), (_mix(seed) % np.uint64(m - 1)).astype(np.int64) + 1
    t = np.zeros(len(shingle))
    flat_t, flat_s = times.reshape(-1), held.reshape(-1)
    for k in range(m):
        u = (_mix(seed + np.uint64((k + 2) * int(_MIX) % (1 << 64))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        t = t - np.log1p(-u) / weight * (m / (m - k))
        cell = doc * m + (start + k * stride) % m
        first = np.flatnonzero(t < flat_t[cell])
        first = first[np.argsort(-t[first], kind="stable")]  # the earliest is written last
        flat_t[cell[first]] = t[first]
        flat_s[cell[first]] = shingle[first]
        live = t < times.max(axis=1)[doc]
        if not live.any():
            break
        if not live.all():
            doc, shingle, weight, seed, start, stride, t = (x[live] for x in (doc, shingle, weight, seed, start, stride, t))
    return held


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash per document and band of ROWS registers, which differs from band to band."""
    part = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _MIX
    for r in range(ROWS):
        h = _mix(h ^ part[:, :, r]) + np.uint64(r)
    return h.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the whole text), bands (empty for a text without words) of each row, in its own task."""

    def run(batches):
        for b in steps(batches, "text", STEP):
            texts = [t or "" for t in b.column("text").to_pylist()]
            doc, shingle, weight = shingles(texts)
            rows = bands(signatures(len(texts), doc, shingle, weight))
            has = np.bincount(doc, minlength=len(texts)) > 0
            offsets = np.r_[0, np.cumsum(np.where(has, BANDS, 0))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[has].reshape(-1)))
            digests = [hashlib.blake2b(t.encode("utf-8"), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary()), lists], ["doc_id", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def pack_shingles(docs: DataFrame) -> DataFrame:
    """doc_id, n (different shingles), total (their counts), set: shingles and counts as bytes (8 each, the count as a float)."""

    def run(batches):
        for b in steps(batches, "text", STEP):
            texts = [t or "" for t in b.column("text").to_pylist()]
            doc, shingle, weight = shingles(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            sets = [shingle[i:j].tobytes() + (weight[i:j].astype(np.float32).tobytes() if (weight[i:j] != 1).any() else b"") for i, j in zip(cut, cut[1:], strict=False)]
            total = np.bincount(doc, weight, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([j - i for i, j in zip(cut.tolist(), cut.tolist()[1:], strict=False)], pa.int32()), pa.array(total, pa.float64()), pa.array(sets, pa.binary())], ["doc_id", "n", "total", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, total double, set binary")


def unpack(n: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(raw, dtype=np.uint64, count=n)
    return s, np.frombuffer(raw, dtype=np.float32, offset=8 * n).astype(np.float64) if len(raw) > 8 * n else np.ones(n)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common shingles i of 1 / sum over all j of max(x_j / x_i, y_j / y_i); 0 if nothing is common."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i], b[1][j]
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # of common j with a ratio up to i's the term is y_j / y_i, of the others x_j / x_i; equal ratios give the same
    from_x = x.sum() - np.cumsum(x)
    from_y = np.cumsum(y)
    return float((1.0 / ((only_x + from_x) / x + (only_y + from_y) / y)).sum())


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold. A frequent ``b`` is split by Spark's skew join."""

    def run(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            keep = [probability_jaccard(unpack(n, x), unpack(k, y)) >= similarity for n, x, k, y in zip(*cols[2:], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    n = pairs.count()
    x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a")), "a")
    y = gathered(x, n, SETS_PER_TASK).join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b")), "b")
    return gathered(y.select("a", "b", "n_a", "set_a", "n_b", "set_b"), n, SETS_PER_TASK).mapInArrow(run, "a long, b long")


def links_of_cell(t: pa.Table, similarity: float) -> pa.Table:
    """The links (a, b) between the texts of ``t`` that are ``asking`` and those that are not, of other classes.

    A text with n different shingles that another lacks has a similarity of at most 1 - n / total with it, which
    excludes pairs before they are compared.
    """
    ids, classes, n, total, asking = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "class_id", "n", "total", "asking"))
    sets = [unpack(k, x) for k, x in zip(n.tolist(), t.column("set").to_pylist(), strict=True)]
    code = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)[1]
    cut, doc = np.r_[0, np.cumsum(n)], np.repeat(np.arange(len(n)), n)
    side = ~asking[doc]
    code_r, doc_r = code[side], doc[side]
    may_lack = total * (1 - similarity + 1e-6)
    mark, out = np.zeros(len(code) + 1, dtype=bool), []
    for x in np.flatnonzero(asking).tolist():
        own = code[cut[x] : cut[x + 1]]
        mark[own] = True
        common = np.bincount(doc_r[mark[code_r]], minlength=len(n))
        mark[own] = False
        near = ~asking & (classes != classes[x]) & (common > 0) & (n[x] - common <= may_lack[x]) & (n - common <= may_lack)
        out += [(max(ids[x], ids[y]), min(ids[x], ids[y])) for y in np.flatnonzero(near).tolist() if probability_jaccard(sets[x], sets[y]) >= similarity]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def remaining(met: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float, places: int) -> DataFrame:
    """The links (a, b) of all pairs of different classes that share a bucket.

    A bucket's largest class need not be compared with itself, so each pair has a text of the others, which asks.
    Texts and asking texts of a bucket are dealt into blocks by the hash of the id; a block of each meet in a group
    of their own, so that a set travels once for a block and not once for a pair. Of buckets that hold the same texts
    one is compared.
    """
    few = lambda df: gathered(df, places, 200_000)
    held = checkpointed(few(few(met.select("bucket", "id")).join(classes, "id")))
    spread = few(held.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"), F.min("class_id").alias("low"), F.max("class_id").alias("high")))
    one = few(spread.where("low <> high").groupBy("size", "mark").agg(F.min("bucket").alias("bucket"))).select("bucket")
    held = checkpointed(few(few(held.join(one, "bucket")).join(sets.select(F.col("doc_id").alias("id"), "n", "total"), "id")))
    per_class = few(held.groupBy("bucket", "class_id").agg(F.count("*").alias("texts"), F.sum("n").alias("n")))
    blocks = lambda n: F.ceil(F.greatest(n, F.lit(1)) * 8 / BLOCK_BYTES).cast("int")
    full = few(per_class.groupBy("bucket").agg(F.max(F.struct("texts", "class_id", "n")).alias("most"), F.sum("n").alias("n")))
    full = full.select("bucket", F.col("most.class_id").alias("most"), blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("most.n")).alias("asking_blocks"))
    held = few(held.join(full, "bucket"))
    at = lambda count: F.pmod(F.xxhash64("id", F.lit(7)), count).cast("int")
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    texts = F.transform(every("asking_blocks"), lambda j: F.struct(at(F.col("blocks")).alias("i"), j.alias("j"), F.lit(False).alias("asking")))
    asking = F.transform(every("blocks"), lambda i: F.struct(i.alias("i"), at(F.col("asking_blocks")).alias("j"), F.lit(True).alias("asking")))
    cell = F.explode(F.when(F.col("class_id") == F.col("most"), texts).otherwise(F.concat(texts, asking)))
    rows = few(held.select("bucket", "id", "class_id", "n", "total", cell.alias("cell")).select("bucket", "id", "class_id", "n", "total", "cell.*"))
    rows = rows.join(sets.select(F.col("doc_id").alias("id"), "set"), "id")
    return checkpointed(rows.groupBy("bucket", "i", "j").applyInArrow(lambda t: links_of_cell(t, similarity), "a long, b long"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of each row: the smallest doc_id of the texts that it is linked to.

    Equal texts are one class and go on as their smallest doc_id. Of different texts that share a band of the
    signature, each is compared with one leader: of its buckets' texts that meet most others over all bands, the one
    of them all that meets most. Those that are in another class than a bucket's leader then are compared with one
    more, ROUNDS in all; at last all pairs of a bucket that are still in different classes with each other. Pairs are
    links if their exact probability Jaccard similarity of five-word shingles, weighted by their counts, reaches
    ``similarity``. So every two texts that share a band are compared or already in one class; leaders join most of a
    bucket first, so that few pairs remain.

    Texts without words (null, empty) are linked only to equal ones, null and empty being equal. A null doc_id has
    the class of its text, null if no row with an id has that text. Repeated rows are all returned; rows of one
    doc_id with different texts are one member that has the shingles of any of them; other columns, whatever their
    names, are ignored; no rows give no rows. A very long text is a step of its own. Ties: of leaders
    that meet as many, the smallest doc_id leads.
    """
    docs = docs.select("doc_id", "text")
    signed = checkpointed(sign(docs))
    rows = signed.count()
    same = checkpointed(gathered(signed, rows).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")).where("rep is not null"))
    keyed = gathered(same, rows).select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"))
    full = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = checkpointed(gathered(keyed.join(full, "bucket"), rows * BANDS, 1_000_000))
    places = met.count()
    few = lambda df: gathered(df, places, 200_000)
    degree = checkpointed(few(met.groupBy("id").agg(F.sum("size").alias("degree"))))
    n = degree.count()
    met = checkpointed(few(met.select("bucket", "id").join(degree, "id")))
    needed = degree.select(F.col("id").alias("doc_id"))
    wanted = docs.join(F.broadcast(needed) if n <= BROADCAST_IDS else needed, "doc_id", "left_semi")
    sets = checkpointed(gathered(pack_shingles(wanted), n, SETS_PER_TASK))

    classes = checkpointed(gathered(degree, n).select("id", F.col("id").alias("class_id")))
    links, rest = None, met
    for _ in range(ROUNDS if n else 0):
        best = rest.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("l"))
        leaders = few(best.select("bucket", (-F.col("l.minus")).alias("b"), F.col("l.degree").alias("degree_b")))
        led = checkpointed(few(rest.join(leaders, "bucket")))
        own = few(led.where("id <> b").groupBy("id").agg(F.max(F.struct("degree_b", (-F.col("b")).alias("minus"))).alias("l")))
        pairs = checkpointed(own.select(F.col("id").alias("a"), (-F.col("l.minus")).alias("b")))
        found = checkpointed(verified(pairs, sets, similarity))
        links = found if links is None else checkpointed(gathered(links.unionByName(found), n))
        classes = joined_classes(degree, links, n)
        of_leader = classes.select(F.col("id").alias("b"), F.col("class_id").alias("class_b"))
        rest = checkpointed(few(few(led.join(classes, "id")).join(of_leader, "b").where("class_id <> class_b").select("bucket", "id", "degree")))
    if n:
        links = checkpointed(gathered(links.unionByName(remaining(met, classes, sets, similarity, places)), n))
        classes = joined_classes(degree, links, n)
    member = gathered(signed, rows).select("doc_id", "digest").join(gathered(same, rows).select("digest", "rep"), "digest", "left")
    return gathered(member, rows).join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("class_id", "rep").alias("class_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows of a doc_id that is in a class with a smaller one and the smallest of none. Rows without
    an id stay. What goes is sent to the documents, so that texts are not shuffled."""
    of = near_duplicates(docs).where("doc_id is not null")
    gone = checkpointed(of.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class_id")).alias("first")).where(~F.col("first")).select("doc_id"))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def joined_classes(ids: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """(id, class_id) of each of the ``n`` ids: the smallest that it is linked to, or itself."""
    labelled = gathered(ids.select("id").join(components(links), "id", "left"), n)
    return checkpointed(labelled.select("id", F.coalesce("class_id", "id").alias("class_id")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
