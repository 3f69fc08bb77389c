"""Near-duplicates by SimHash: fingerprints of hashed shingles, a self-join of their binary trie, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftline.llm.common import checkpointed, gathered, steps, table
from weftline.llm.links import components

SHINGLE_WORDS, SEED, BUDGET = 3, 42, 2
#: Fingerprints below a pair of nodes that one row holds; larger pairs are split.
LIMIT = 4096
#: Bits by which a round goes down the trie.
DOWN = 2
#: Pairs of nodes that are looked at together in a task.
TOGETHER = 1 << 17
#: Pairs of subtrees of a task.
PAIRS_PER_TASK = 200
#: Nodes that are sent to all executors at most; beyond, both sides are shuffled, and large partitions split by Spark's skew join.
BROADCAST_NODES = 1_000_000
#: Hashes whose bits are counted together.
COUNTED = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of the XXH64 hashes of all word shingles, repeats included: a bit is set if it is in over half of them."""
    parts = text.lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not parts:
        return 0
    if len(parts) <= words:
        runs = [b" ".join(parts)]
    else:
        runs = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(r, SEED) for r in runs), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        block = hashes[at : at + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of each row, in its own task; print is the fingerprint as a signed number."""

    def run(batches):
        for b in steps(batches, "text"):
            found = [fingerprint((t or "").encode("utf-8")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, print long")


def _children(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the right child of each node [lo, hi) of ``depth`` bits begins in the sorted values."""
    shift = np.uint64(63 - depth)
    return np.clip(np.searchsorted(values, (values[lo] >> shift | np.uint64(1)) << shift), lo, hi)


def trie_links(a: np.ndarray, b: np.ndarray, depth: int, same: bool, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all a[i] and b[j] that differ in ``budget`` bits at most; both are sorted and unique, all values
    of a agree in their first ``depth`` bits, as do those of b. If the two are the ``same``, each pair once.

    Pairs of nodes go down both tries together. A node is a range of its sorted values; its children are found by a
    search for the first value with the next bit. A pair of nodes splits into the pairs of their children, of which
    two add a differing bit; a pair beyond the budget or with an empty child ends. Two single values are compared.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(a) or not len(b):
        return none, none
    differs = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - depth))) if depth else 0
    one = lambda v: np.array([v], dtype=np.int64)
    stack = [(depth, one(0), one(len(a)), one(0), one(len(b)), one(differs))] if differs <= budget else []
    left, right = [none], [none]
    while stack:
        depth, la, ha, lb, hb, diff = stack.pop()
        single = (ha - la == 1) & (hb - lb == 1)
        if depth == 64:
            single[:] = True
        i, j = la[single], lb[single]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        left.append(i[near])
        right.append(j[near])
        la, ha, lb, hb, diff = (x[~single] for x in (la, ha, lb, hb, diff))
        if not len(la):
            continue
        ma, mb = _children(a, la, ha, depth), _children(b, lb, hb, depth)
        parts = []
        for x0, x1, y0, y1, add in ((la, ma, lb, mb, 0), (ma, ha, mb, hb, 0), (la, ma, mb, hb, 1), (ma, ha, lb, mb, 1)):
            keep = (x0 < x1) & (y0 < y1) & (diff + add <= budget)
            if same:
                keep &= x0 <= y0
            parts.append((x0[keep], x1[keep], y0[keep], y1[keep], diff[keep] + add))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        stack += [(depth + 1, *(c[at : at + TOGETHER] for c in cols)) for at in range(0, len(cols[0]), TOGETHER)]
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest that it is linked to."""
    label = np.arange(n)
    while len(left):
        x, y = label[left], label[right]
        apart = x != y
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _bits(prefix: str, depth: int):
    return F.shiftrightunsigned(prefix, 64 - depth) if depth else F.lit(0).cast("long")


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): links that join all of the different ``print``s that differ in ``budget`` bits at most, over any number of links.

    Rounds go down the trie from the root by DOWN bits. A pair of nodes that together hold more than LIMIT prints is
    split into its children's pairs; the others are rows with the prints of both, and each row is joined by itself. A
    print of so few different bits has at most 2,081 partners, and pairs of nodes likewise, so nothing grows with the
    square of a group; of the links found in a row its trees are sent, one for each print at most.
    """
    n = prints.count()
    if n == 0:
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b"))
    spark = prints.sparkSession
    open_ = spark.createDataFrame([(0, 0, 0, n, n)], "a long, b long, diff int, n_a long, n_b long")
    depth, ready = 0, []
    while True:
        small = open_.where(F.col("n_a") + F.col("n_b") <= LIMIT)
        ready.append((depth, small))
        open_ = open_.where(F.col("n_a") + F.col("n_b") > LIMIT).select("a", "b", "diff")
        if depth == 64 or not open_.limit(1).count():
            break
        depth += DOWN
        node = prints.groupBy(_bits("print", depth).alias("node")).agg(F.count("*").alias("n"))
        node = checkpointed(node.withColumn("parent", F.shiftright("node", DOWN)))
        left, right = (node.select(F.col("parent").alias(x), F.col("node").alias(f"child_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
        diff = F.col("diff") + F.bit_count(F.col("child_a").bitwiseXOR(F.col("child_b")).bitwiseAND(F.lit((1 << DOWN) - 1)))
        met = open_.join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("child_a") <= F.col("child_b")))
        met = met.select(F.col("child_a").alias("a"), F.col("child_b").alias("b"), diff.cast("int").alias("diff"), "n_a", "n_b")
        open_ = checkpointed(met.where(F.col("diff") <= budget))
    pairs = None
    for at, small in ready:
        part = small.select(F.lit(at).alias("depth"), "a", "b", "n_a", "n_b")
        pairs = part if pairs is None else pairs.unionByName(part)
    pairs = checkpointed(pairs.where((F.col("a") != F.col("b")) | (F.col("n_a") > 1)))
    tasks = max(1, -(-pairs.count() // PAIRS_PER_TASK))
    used = checkpointed(pairs.select("depth", F.explode(F.array("a", "b")).alias("node")).distinct())
    depths = [r.depth for r in used.select("depth").distinct().collect()]  # of 64 at most
    # a print of a node that was split at this depth is not sent, where the nodes in use fit into a broadcast
    used = F.broadcast(used) if used.count() <= BROADCAST_NODES else used
    placed = prints.select("print", F.explode(F.array(*(F.struct(F.lit(at).alias("depth"), _bits("print", at).alias("node")) for at in depths))).alias("p")).select("print", "p.depth", "p.node")
    held = checkpointed(placed.join(used, ["depth", "node"]).groupBy("depth", "node").agg(F.collect_list("print").alias("prints")))
    rows = pairs.select("depth", "a", "b").join(held.withColumnsRenamed({"node": "a", "prints": "prints_a"}), ["depth", "a"])
    rows = rows.join(held.withColumnsRenamed({"node": "b", "prints": "prints_b"}), ["depth", "b"]).select("depth", "a", "b", "prints_a", "prints_b").repartition(tasks, "a", "b")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                depth, node_a, node_b = (batch.column(i)[k].as_py() for i in range(3))
                x, y = (np.sort(batch.column(i)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)) for i in (3, 4))
                same = node_a == node_b
                i, j = trie_links(x, y, depth, same, budget)
                if not len(i):
                    continue
                both = x if same else np.r_[x, y]
                label = forest(len(both), i, j if same else j + len(x))
                far = np.flatnonzero(label != np.arange(len(both)))
                yield pa.RecordBatch.from_arrays([pa.array(both[far].view(np.int64)), pa.array(both[label[far]].view(np.int64))], ["a", "b"])

    return checkpointed(rows.mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: the 16 hexadecimal digits of its SimHash, and the smallest doc_id
    of all rows that it is linked to over any number of links of at most ``budget`` differing bits.

    Words are parted by ASCII white space, with A-Z lower-cased; shingles of three words are hashed, repeats included;
    fewer words are one shingle. Texts without words (null, empty) have the fingerprint zero, which links like others.
    Equal fingerprints are joined once, whatever their number. Rows without an id have the component of their
    fingerprint, null if no row with an id is in it; rows that repeat an id are each placed by their own text. A very
    long text is a step of its own. Other columns, whatever their names, are ignored; no rows give no rows.
    """
    marked = checkpointed(fingerprints(docs))
    rows = marked.count()
    prints = checkpointed(gathered(marked, rows).groupBy("print").agg(F.min("doc_id").alias("least")))
    found = links(prints.select("print"), budget)
    classes = components(found).withColumnsRenamed({"id": "print"})
    placed = prints.join(classes, "print", "left").select("print", F.coalesce("class_id", "print").alias("class_id"), "least")
    least = placed.groupBy("class_id").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "class_id").select("print", "component_id")
    return gathered(marked, rows).join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
