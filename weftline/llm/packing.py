"""Cost-balanced packing of token ids into sequences of bounded length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import give_back, steps, table
from weftline.llm.tokens import byte_bpe

LENGTH = 1024
#: Cost of n tokens that attend to one another: LINEAR * n + n * n.
LINEAR = 24576
#: Tokens of remainders that are packed together.
POOL_TOKENS = 512 * LENGTH

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n):
    return LINEAR * n + n * n


def capacities(total: int, length: int = LENGTH) -> list[int]:
    """Lengths of sequences that ``total`` tokens fill without padding: full ones, then powers of two."""
    full, rest = divmod(total, length)
    return [length] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def balance(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(item, begin in the item, tokens, sequence) for items up to ``length``.

    Items are taken in descending order and go to the sequence of the lowest cost that still has room for them. If
    none has, the item is cut: its beginning fills the cheapest sequence with any room, the rest is taken in turn.
    Sequences are as many as the tokens fill exactly.
    """
    room = np.array(capacities(sum(lengths), length), dtype=np.int64)
    spent = np.zeros(len(room), dtype=np.int64)
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        waiting[lengths[i]].append((i, 0))
    placed = []
    far = np.iinfo(np.int64).max
    for n in range(length, 0, -1):  # a cut item's rest is shorter, so it waits further down
        stack = waiting[n]
        while stack:
            item, begin = stack.pop()
            fits = np.where(room >= n, spent, far)
            at = int(fits.argmin())
            if fits[at] == far:
                open_ = np.where(room > 0, spent, far)
                at = int(open_.argmin())
            take = min(n, int(room[at]))
            placed.append((item, begin, take, at))
            room[at] -= take
            spent[at] += cost(take)
            if take < n:
                waiting[n - take].append((item, begin + take))
    return placed


def pack(docs: DataFrame, path: str, ranks_path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of documents with their sequence and place; each task packs its own rows, without a shuffle.

    A document's ids are followed by id 0. Full sequences are cut off a document first; remainders wait in pools of
    POOL_TOKENS, which are balanced one by one. Sequences other than full ones have a power of two as length, so
    none needs padding. Null and empty texts are the single id 0; repeated rows and null ids are packed like any
    other; of remainders of one length the first read is placed first; a very long text is a step of its own and is
    cut into full sequences; other columns, whatever their names, are ignored; no rows give no rows. Sequence ids hold the task's partition, so a task that runs again gives the
    same ids.
    """

    def run(batches):
        bpe = byte_bpe(path, ranks_path)
        sequence = TaskContext.get().partitionId() << 40
        columns: list[list] = [[] for _ in range(7)]

        def add(doc, start, ids, tokens, seq, offset):
            for c, v in zip(columns, (doc, start, len(ids) // 4, zlib.crc32(ids), tokens, seq, offset), strict=True):
                c.append(v)

        def flush():
            nonlocal sequence
            offsets: dict[int, int] = {}
            for item, begin, n, at in balance([len(r[2]) // 4 for r in pool], length):
                doc, start, ids, tokens = pool[item]
                offset = offsets.get(at, 0)
                add(doc, start + begin, ids[4 * begin : 4 * (begin + n)], tokens, sequence + at, offset)
                offsets[at] = offset + n
            sequence += len(offsets)
            pool.clear()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            for c in columns:
                c.clear()
            return batch

        pool: list[tuple] = []
        held = 0
        for b in steps(batches, "text"):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = bpe.ids(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                whole = n // length * length
                for start in range(0, whole, length):
                    add(doc, start, ids[4 * start : 4 * (start + length)], n, sequence, 0)
                    sequence += 1
                if n > whole:
                    pool.append((doc, whole, ids[4 * whole :], n))
                    held += n - whole
                if held >= POOL_TOKENS:
                    flush()
                    held = 0
            yield out()
        if pool:
            flush()
            yield out()
        bpe.chunks.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *default_paths())
