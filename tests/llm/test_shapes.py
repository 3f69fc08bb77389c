"""Importance resampling, whitening and SimHash against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from weftline.llm import hilbert, simhash, target, whitening
from weftline.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(30_000))
ODD = [(1, None), (2, ""), (None, "no id here"), (None, None), (3, LONG), (4, "x" * 100_000 + " " + "é" * 50_000), (5, "Same text"), (5, "Same text"), (5, "another text of this id"), (6, "ÀB\x00c\n\x7fd-e_f   g"), (7, " \t\n")]


def spread(rng, n=60, least=1, most=60):
    words = [rng.choice(["alpha", "Beta", "GAMMA", "δέλτα", "e9", "a-b", "x"]) + str(rng.randrange(40)) for _ in range(200)]
    return [(100 + i, " ".join(rng.choices(words, k=rng.randint(least, most)))) for i in range(n)]


# ---- importance resampling


def brute_buckets(text, words, buckets):
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(found), [zlib.crc32(" ".join(found[i : i + n]).encode()) % buckets for n in range(1, words + 1) for i in range(len(found) - n + 1)]


def brute_importance(rows, others, words=1, buckets=10_000, percent=10, least=20, seed=2024):
    held = [(i, *brute_buckets(t, words, buckets)) for i, t in rows]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, found in held:
        np.add.at(s, found, 1)
    for text in others:
        np.add.at(t, brute_buckets(text, words, buckets)[1], 1)
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + buckets) / ((x + 1) * (t.sum() + buckets)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, n, found in held:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    enough = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(enough[: percent * len(enough) // 100])}
    return sorted(((*x[:4], rank.get(id(x))) for x in out), key=repr)


def test_features_against_regular_expressions():
    rng = random.Random(1)
    texts = [t for _, t in ODD] + ["".join(rng.choice("aZ9 -é中\U0001f600\n_") for _ in range(rng.randint(0, 90))) for _ in range(200)]
    for words in (1, 2, 3):
        column = pa.array(["not read", *texts])[1:]
        row, bucket, n = target.features(column, words, 997)
        for i, t in enumerate(texts):
            count, want = brute_buckets(t, words, 997)
            assert n[i] == count and bucket[row == i].tolist() == want, (i, words)
    for empty in (pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        row, _, n = target.features(empty)
        assert not len(row) and n.tolist() == [0] * len(empty)


def test_importance_against_brute_force(spark):
    rng = random.Random(2)
    rows, others = ODD + spread(rng), [t for _, t in spread(rng, 5)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'own' as weight", "text", "doc_id", "1 as n_words", "'r' as rank", "2 as place")
    bench = spark.createDataFrame([(t,) for t in others], "text string")
    for words, percent in ((1, 10), (2, 50)):
        got = [tuple(r) for r in target.importance(docs, bench, percent=percent, words=words).collect()]
        assert sorted(got, key=repr) == brute_importance(rows, others, words, percent=percent)
    drawn = target.resample(docs, bench, percent=50)
    want = [r[0] for r in brute_importance(rows, others, percent=50) if r[4]]
    assert drawn.columns == docs.columns and sorted(r.doc_id for r in drawn.collect()) == sorted(want) and len(want) > 20
    assert target.importance(docs.where("false"), bench).count() == 0
    assert target.resample(docs.where("false"), bench).count() == 0
    assert [tuple(r) for r in target.importance(docs, bench.where("false"), percent=100).collect() if r.doc_id == 1][0][1:3] == (0, 0)


def test_ranks_hold_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(target, "RANGE_ROWS", 7)
    rows = spread(random.Random(3), 150, 18, 30) + [(i, " ".join(["tie"] * 30)) for i in range(20)]
    got = [tuple(r) for r in target.importance(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("tie tie",)], "text string"), percent=60).collect()]
    assert sorted(got, key=repr) == brute_importance(rows, ["tie tie"], percent=60)


@pytest.mark.parametrize("name", ["op11_importance_resampling"])
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = con.sql(SQL[name])
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.select(*got.columns).fetchall()))


# ---- whitening


def check_whitening(rows, got, components=32):
    sound = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in sound], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x.astype(float) - np.array([float(s) / n for s in sums]))
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, len(values))
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert len(got) == n * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    signs = None
    for (i, _), row in zip(sound, want, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x[[j for j, _ in sound].index(i)], sums, strict=True))
        mine = np.array([by[i, deviation][c].whitened for c in range(1, k + 1)])
        signs = np.sign(mine * row) if signs is None else signs
        assert np.abs(mine - row * signs).max() < 1e-6
        assert np.allclose([by[i, deviation][c].explained for c in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-6)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5] + 70).tolist()) for i in range(80)]
    odd = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (202, [float("nan")] * 6), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "own") for r in rows + odd], "vec_id long, embedding array<double>, deviation string").selectExpr("deviation", "embedding", "vec_id", "1 as x", "2 as id", "3 as v")
    check_whitening(rows + odd, whitening.whitened(df, "vec_id", "embedding", 4).collect(), 4)
    check_whitening(rows + odd, whitening.whitened(df, "vec_id", "embedding").collect())
    others = df.unionByName(spark.createDataFrame([(300, [1.0]), (301, []), (302, [2.0] * 9)], "vec_id long, embedding array<double>"), allowMissingColumns=True)
    check_whitening(rows, whitening.whitened(others, "vec_id", "embedding").collect())


def test_triangle_in_parts_gives_the_same(spark, monkeypatch):
    rows = [(i, np.random.default_rng(i).standard_normal(5).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(whitening, "WIDTH", 2)
    check_whitening(rows, whitening.whitened(df, "vec_id", "embedding").collect())


def test_whitening_of_odd_tables(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert make([]).count() == 0 and make([(1, None), (2, [])]).count() == 0 and make([(1, [3.0, 4.0]), (2, [3.0, 4.0])]).count() == 0
    assert make([]).columns == make([(1, [1.0]), (2, [9.0])]).columns
    flat = make([(1, [1.0, 5.0]), (2, [9.0, 5.0]), (None, [4.0, 5.0]), (2, [9.0, 5.0])]).collect()  # one entry never changes
    assert [r.component for r in flat] == [1] * 4 and flat[0].explained == pytest.approx(1) and flat[0].identity_error < 1e-9
    far = make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]).collect()
    assert len(far) >= 3 and all(r.deviation is None for r in far if r.vec_id == 1)


# ---- SimHash


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(prints, budget=2):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= budget and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def near_prints(rng, n):
    heads = [rng.getrandbits(64) for _ in range(max(1, n // 12))]
    out = set()
    while len(out) < n:
        v = rng.choice([*heads, rng.getrandbits(64)])
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


def test_trie_links_against_all_pairs(monkeypatch):
    rng = random.Random(7)
    for together in (5, 1 << 17):
        monkeypatch.setattr(simhash, "TOGETHER", together)
        for budget in (0, 1, 2, 3):
            v = near_prints(rng, 120)
            a = np.array(v, dtype=np.uint64)
            i, j = simhash.trie_links(a, a, 0, True, budget)
            assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x in range(120) for y in range(x + 1, 120) if (v[x] ^ v[y]).bit_count() <= budget]
    one, other = ([x for x in near_prints(rng, 400) if x >> 62 == top] for top in (1, 3))
    other += [x ^ 1 << 63 for x in one[:20]]
    one, other = sorted(set(one)), sorted(set(other))
    i, j = simhash.trie_links(np.array(one, np.uint64), np.array(other, np.uint64), 2, False)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x in range(len(one)) for y in range(len(other)) if (one[x] ^ other[y]).bit_count() <= 2]
    assert not len(simhash.trie_links(np.zeros(0, np.uint64), np.array(one, np.uint64), 0, False)[0])


@pytest.mark.parametrize("limit", [8, 64, 4096])
def test_links_join_what_all_pairs_join(spark, monkeypatch, limit):
    """Small limits send the traversal through many rounds in Spark before tasks take over."""
    monkeypatch.setattr(simhash, "LIMIT", limit)
    prints = near_prints(random.Random(limit), 150)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    at = {p: k for k, p in enumerate(signed)}
    label = list(range(len(prints)))
    for r in got:
        low, high = sorted((label[at[r.a]], label[at[r.b]]))
        label = [low if x == high else x for x in label]
    assert label == brute_labels(prints)


def test_simhash_against_brute_force(spark):
    rng = random.Random(9)
    rows = ODD + spread(rng, 30) + [(500 + i, "one two three") for i in range(5)] + [(600 + i, LONG + f" end{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'own' as print", "text", "doc_id", "1 as class_id", "2 as fingerprint", "3 as component_id")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    prints = [brute_print(t) for _, t in rows]
    label = brute_labels(prints)
    least = {c: min((i for (i, _), x in zip(rows, label, strict=True) if x == c and i is not None), default=None) for c in label}
    assert got == sorted(((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, label, strict=True)), key=repr)
    assert next(r[2] for r in got if r[0] == 605) == 3 and next(r[1] for r in got if r[0] == 7) == "0" * 16
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_simhash_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in docs]
    label = brute_labels(prints)
    want = [(r.doc_id, f"{p:016x}", docs[c].doc_id) for r, p, c in zip(docs, prints, label, strict=True)]
    assert sorted(tuple(r) for r in QUERIES["op13_simhash_near_dedup"](spark, DATA).collect()) == want


# ---- neighbours of vectors of very different lengths


def neighbours_recall(spark, rows):
    keep = {i: np.array(v) for i, v in rows}
    got = {}
    for r in hilbert.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits, least = [], 20
    with np.errstate(over="ignore", invalid="ignore"):
        for q in (i for i in keep if i % 20 == 0):
            scores = sorted((-(keep[q] * keep[j]).sum(), j) for j in keep if j != q)[:20]
            hits.append(len(got[q] & {j for _, j in scores}) / len(scores))
            least = min(least, len(got[q]))
    return np.mean(hits), least


@pytest.mark.parametrize("case", ["one long", "log-normal", "tiny and huge"])
def test_recall_where_lengths_differ(spark, case):
    rng = np.random.default_rng(21)
    x = rng.standard_normal((3000 if case != "tiny and huge" else 800, 64))
    if case == "one long":
        x[7] *= 100
    elif case == "log-normal":
        x *= np.exp(rng.standard_normal(len(x)))[:, None]
    else:
        x[3] *= 1e160
        x[5] *= 1e-170
        x[40] *= 1e160
        x[60] *= 1e-170
    recall, least = neighbours_recall(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert recall >= 0.9 and least == 20, (case, recall)


def test_vectors_of_other_dimensions_take_no_part(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(10)] + [(40, [1.0, 2.0, 3.0]), (60, [1.0])]
    got = hilbert.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {0} and len(got) == 9


def test_messages_of_groups_to_ranges_stay_few():
    from weftline.llm import repeats

    groups, ranges, bins = repeats.dealing(600, 10 << 30)
    assert groups * ranges <= 6_500_000 and bins == 1200  # 24,576,000 before
    assert repeats.dealing(12, 100) == (12, 12, 24)
