"""Repeats, near duplicates, personal data, neighbours and the pipeline: against brute force on small tables."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import hilbert, minhash, packing, privacy, repeats, suffix
from weftline.llm.links import components
from weftline.llm.suffix import common_sides, repeated_windows, suffix_arrays

DATA = "/root/testdata/sf0.001"


# ---- suffix arrays and repeats


def test_suffix_arrays_against_sorting():
    rng = random.Random(0)
    for trial in range(400):
        texts = [[bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))]
        chars = np.array([c for t in texts for s in t for c in [*(x + 1 for x in s), 0]])
        sizes = np.array([sum(len(s) + 1 for s in t) for t in texts])
        got, base = suffix_arrays(chars, sizes), 0
        for n in sizes.tolist():
            own = (got[base : base + n] - base).tolist()
            assert sorted(own) == list(range(n))
            suffix = lambda i, part=chars[base : base + n].tolist(): part[i : part.index(0, i) + 1]
            assert [suffix(i) for i in own] == sorted(suffix(i) for i in range(n))
            base += n
    assert len(suffix_arrays(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))) == 0


def test_repeated_windows_have_smaller_owners():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    owners, texts = np.array([rng.randrange(9) for _ in strings]), np.repeat(np.arange(12), 5)
    for i, mask in enumerate(repeated_windows(strings, owners, texts, 5)):
        for at in range(len(strings[i]) - 4):
            w = strings[i][at : at + 5]
            want = any(w in strings[j] and owners[j] < owners[i] for j in range(60) if texts[j] == texts[i])
            assert bool(mask >> at & 1) == want


def test_a_faulty_sort_shows(monkeypatch):
    """The suffix arrays find the repeats: with another order they are lost."""
    rng = random.Random(5)
    gram = bytes(range(65, 85))
    tails = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(6)]
    strings = [rng.choice(tails)[::-1] + gram + rng.choice(tails) for _ in range(40)]
    owners, texts = np.arange(40), np.zeros(40, dtype=np.int64)
    want = [sum(1 << i for i in range(31) if any(s[i : i + 50] in x for x in strings[:k])) for k, s in enumerate(strings)]
    assert repeated_windows(strings, owners, texts, 50) == want and any(want)
    monkeypatch.setattr(suffix, "suffix_arrays", lambda chars, sizes: np.random.default_rng(1).permutation(len(chars)))
    assert repeated_windows(strings, owners, texts, 50) != want


def test_common_sides_against_all_pairs():
    rng = random.Random(6)
    gram = bytes(range(65, 85))
    for _ in range(80):
        side = lambda: bytes(rng.choice(b"ab\0") for _ in range(rng.choice([0, 1, 3, 15, 30])))
        sides = [(side(), side()) for _ in range(4)]
        pairs = [(rng.choice(sides)[0], rng.choice(sides)[1]) for _ in range(12)]
        strings, places = [a + gram + b for a, b in pairs], np.array([len(a) for a, _ in pairs])
        texts = np.repeat([3, 8], 6)
        before, after = common_sides(strings, places, texts, 20, 30)
        agree = lambda x, y: next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
        for i, (a, b) in enumerate(pairs):
            others = [p for j, p in enumerate(pairs) if j != i and texts[j] == texts[i]]
            assert (before[i], after[i]) == (max(agree(a[::-1], x[::-1]) for x, _ in others), max(agree(b, y) for _, y in others))


def brute_repeats(rows: list[tuple], length: int = 50) -> dict:
    first: dict[bytes, int] = {}
    key = lambda d: float("inf") if d is None else d
    raw = sorted(((key(d), (t or "").encode()) for d, t in rows), key=lambda r: r[0])
    for d, b in raw:
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = {}
    for d, b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int))).tolist()
        out[d, b] = list(zip(edge[::2], edge[1::2], strict=True))
    return out


def corpus(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeéstr") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(6)]
    line = "All rights reserved, whatever follows here in this line.\n"
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            k = rng.random()
            parts.append(rng.choice(passages)[rng.randrange(10) :] if k < 0.4 else line if k < 0.6 else " ".join(word() for _ in range(rng.randint(1, 40))))
        rows.append((i * 3 % n if n % 3 else i, rng.choice(["", " ", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("many", [2048, 2])
def test_repeats_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    rows = [*corpus(1, 80), (200, None), (201, ""), (202, "x" * 49), (203, "x" * 50), (204, "x" * 120), (205, "y" * 20_000), (206, "y" * 20_000), (None, "y" * 60), (7, "z" * 55), (7, "z" * 55), (8, "z" * 55)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit(1)).withColumn("doc_group", F.lit("old")).withColumn("repeats", F.lit(2))
    want = brute_repeats(rows)
    got = repeats.repeated(df).collect()
    assert len(got) == len(rows)
    for r in got:
        key = (float("inf") if r.doc_id is None else r.doc_id, (r.text or "").encode())
        assert [tuple(s) for s in r.repeats] == want[key], r.doc_id
    assert repeats.repeated(df.where("false")).count() == 0


def test_texts_without_repeats_keep_whole_code_points(spark):
    text = "é" * 40
    df = spark.createDataFrame([(1, "a" + text, 41), (2, "bé" + text + "c", 43), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert got[2].text in ("bc", "béc")
    assert got[2].n_chars == len(got[2].text)
    assert (got[1].text, got[3].text, got[3].n_chars) == ("a" + text, None, None)


def test_op1_digests(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = brute_repeats(rows)
    texts = dict(rows)
    for r in repeats.op1_suffix_array_dedup(spark, DATA).collect():
        raw = texts[r.doc_id].encode()
        spans = want[r.doc_id, raw]
        kept = repeats.kept_parts(raw, [{"start": a, "stop": b} for a, b in spans])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


# ---- near duplicates


def grams(text: str | None) -> Counter:
    w = [x for x in re.split(r"[\x00-\x20!-/:-@\[-`{-~]+", (text or "").lower()) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def exact_jaccard(x: Counter, y: Counter) -> float:
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x | y) for i in x if i in y)


def test_probability_jaccard():
    rng = random.Random(6)
    for _ in range(60):
        x, y = (Counter(rng.choices(range(12), k=rng.randint(1, 25))) for _ in range(2))
        pack = lambda c: (np.array(sorted(c), dtype=np.uint64), np.array([float(c[k]) for k in sorted(c)]))
        assert minhash.probability_jaccard(pack(x), pack(y)) == pytest.approx(exact_jaccard(x, y))


def test_signatures_estimate_similarity():
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    other = [w if rng.random() < 0.98 else "new" for w in base]
    doc, shingle, weight = minhash.shingles([" ".join(base), " ".join(other), "one", ""])
    s = minhash.signatures(4, doc, shingle, weight)
    want = exact_jaccard(grams(" ".join(base)), grams(" ".join(other)))
    assert abs((s[0] == s[1]).mean() - want) < 0.12
    assert len(set(s[2].tolist())) == 1
    assert not s[3].any()


def brute_classes(rows: list[tuple]) -> dict:
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    g = [(i, t or "", grams(t)) for i, t in rows]
    for a in range(len(g)):
        for b in range(a):
            if g[a][1] == g[b][1] or (g[a][2] and g[b][2] and exact_jaccard(g[a][2], g[b][2]) >= 0.8):
                x, y = root(g[a][0]), root(g[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for base in range(12):
        words = [f"v{rng.randrange(900)}" for _ in range(rng.choice([3, 12, 60, 90]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(900)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(100, None), (101, ""), (102, "  "), (103, "lone"), (104, "Lone"), (105, "la " * 300), (106, "la " * 310), (107, "q" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit(1)).withColumn("class_id", F.lit(5))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == brute_classes(rows)
    extra = spark.createDataFrame([(None, "lone"), (None, "nobody"), (103, "lone")], "doc_id long, text string")
    more = minhash.near_duplicates(df.select("doc_id", "text").unionByName(extra)).where("doc_id is null or doc_id = 103").collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in more) == [(0, 0), (0, 103), (103, 103), (103, 103)]
    assert minhash.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 1 << 17])
def test_pairs_inside_a_template_family_are_found(spark, monkeypatch, block):
    """Many classes of one template meet in the same buckets, where pairs at 0.8 are led by neither of the two."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block, raising=False)
    rng = random.Random(1)
    base = [f"t{i}" for i in range(1000)]

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"e{rng.randrange(10**9)}"
        return out

    family = [edited(base, 14) for _ in range(200)]
    for _ in range(60):
        family.append(edited(base, 16))
        family.append(edited(family[-1], 19))
    rows = [(i, " ".join(w)) for i, w in enumerate(family)]
    sets = [set(grams(t)) for _, t in rows]
    edges = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert len(set(want.values())) > 40
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(50, 49), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.class_id for r in components(edges).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {49: 49, 50: 49}
    assert components(edges.where("false")).count() == 0


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_against_the_patterns():
    rng = random.Random(3)
    for i in range(8000):
        parts = list("aB1@.-+ ()2%é_09") if i % 2 else ["a", "4111", "1111", " ", "-", "1", "@x.y", "a@b", ".c", "256.", "1.2", "+1 ", "(555)", ".", "12"]
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        want = []
        for k, p in PATTERNS.items():
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m.group())
                ok = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and privacy.luhn(digits), "phone": 8 <= len(digits) <= 15}[k]
                want += [(k, *m.span())] if ok else []
        assert privacy.base_spans(t) == want, t
    assert privacy.base_spans("9" * 200_000) == privacy.base_spans("@" * 100_000) == []


def revealed_plainly(rows: list[tuple]) -> set:
    """(term, entity) by counting different texts one by one."""
    texts = sorted({t or "" for _, t in rows})
    of = {}
    for t in texts:
        own = privacy.base_spans(t)
        covered = {i for _, a, b in own for i in range(a, b)}
        words = {privacy.term_of(m.group()) for m in re.finditer(r"\w+", t) if not covered & set(range(*m.span()))}
        values = {privacy.entity(k, t[a:b]) for k, a, b in own}
        of[t] = words, values | {v.split(":")[0] for v in values} | ({"any"} if values else set())
    n_term = Counter(w for ws, _ in of.values() for w in ws)
    n_entity = Counter(e for _, es in of.values() for e in es)
    both = Counter((w, e) for ws, es in of.values() for w in ws for e in es)
    found = set()
    for (w, e), n in both.items():
        share = n_entity[e] / len(texts)
        posterior = (n + privacy.PRIOR_TEXTS * share) / (n_term[w] + privacy.PRIOR_TEXTS)
        if -np.log2(posterior) <= privacy.RESIDUAL_BITS and np.log2(posterior / share) >= privacy.TOLD_BITS:
            found.add((w, e))
    return found


def test_information_against_plain_counts(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(12))}" for _ in range(12)]
        if i < 60:
            words += ["jo@x.org" if i % 4 == 0 else rng.choice(["1.2.3.4", "+1 (555) 123-4567", f"u{i}@y.net"])] + ["desk"] * (i % 7 > 0) + ["suite"] * (i % 4 == 0) + [f"{rng.randrange(10**5, 10**6)}x"] * (i % 3 > 0)
        if i % 50 == 0:
            words += ["desk", "12 34"]
        rows.append((i, " ".join(words)))
    rows += rows[:20] + [(900 + k, rows[k % 8][1]) for k in range(40)] + [(None, rows[70][1]), (950, None), (951, "")]
    want = revealed_plainly(rows)
    assert {("desk", "any"), ("a9#7", "any"), ("suite", "email"), ("suite", "email:jo@x.org")} <= want
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.term, r.entity) for r in privacy.revealing(df).collect()}
    assert got == want


def test_terms_that_reveal_an_entity_go(spark, monkeypatch):
    filler = [(i, f"plain words number {chr(97 + i % 26)}{chr(97 + i // 26)} with the usual text") for i in range(100, 190)]
    known = [(i, f"the zorblat office {chr(97 + i)} answers at jo@x.org today") for i in range(14)]
    odd = [(200, None), (201, ""), (202, "zorblat alone goes"), (None, "call +1 (555) 123-4567 now"), (5, known[4][1]), (5, known[4][1]), (300, "mail a@b.co please"), (300, "no address here"), (300, "1.2.3.4")]
    df = spark.createDataFrame(known + filler + odd, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("found", F.lit("x")).withColumn("spans", F.lit("y"))
    out = privacy.sanitise(df)
    assert out.columns == df.columns
    rows = out.collect()
    got = {(r.doc_id, r.text) for r in rows}
    texts = {i: t for i, t in got}
    assert {t for i, t in got if i == 300} == {"mail [EMAIL] please", "no address here", "[IP]"}
    assert texts[0].split() == ["the", "a", "[EMAIL]"]
    assert texts[202] == " alone goes"
    assert texts[None] == "call [PHONE] now"
    assert texts[200] is None and texts[201] == "" and texts[100] == filler[0][1]
    assert len(rows) == len(known) + len(filler) + len(odd)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)
    assert privacy.with_spans(df.where("false"), "s").count() == 0
    monkeypatch.setattr(privacy, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(privacy, "BROADCAST_IDS", 0)
    assert sorted(map(str, privacy.sanitise(df).collect())) == sorted(map(str, rows))


def test_copies_do_not_make_terms_revealing(spark):
    df = spark.createDataFrame([(i, "rare zorblat words near jo@x.org") for i in range(19)] + [(100 + i, f"other {chr(97 + i)}") for i in range(26)], "doc_id long, text string")
    assert privacy.revealing(df).count() == 0


def test_many_addresses_in_one_text_take_linear_time():
    text = " ".join(f"word{i} user{i}@host.example" for i in range(10_000)) + " " + "x" * 5000
    began = time.process_time()
    spans = privacy.base_spans(text)
    words = [m.group() for m in privacy.words_outside(text, spans)]
    assert time.process_time() - began < 1
    assert len(spans) == 10_000 and len(words) == 10_001 and words[-1] == "x" * 5000


# ---- neighbours


def brute_nearest(rows: list[tuple], k: int) -> dict:
    keep = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i in keep:
        if i % 20 == 0:
            scores = sorted(((-(keep[i] * keep[j]).sum(), j) for j in keep if j != i))[:k]
            out[i] = [(j, -s) for s, j in scores]
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    for name, value in {"CURVES": 8, "OWN": 8, "WINDOW": 1000}.items():
        monkeypatch.setattr(hilbert, name, value)  # windows that hold the whole table, so that nothing may be missed
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(400 + i, [1.0] * 8) for i in range(60)]  # copies, more than are asked for
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (1080, [float("inf")] * 8), (None, [1.0] * 8), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("id", F.lit("x"))
    got: dict = {}
    for r in hilbert.nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, 20)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [(r, v) for r, v, _ in got[q]] == [(i + 1, v) for i, (v, _) in enumerate(near)], q
        assert [s for _, _, s in got[q]] == pytest.approx([s for _, s in near], abs=1e-12)
    # 190 candidates of one product, and ids with two vectors, of which the smaller counts
    tied = [(0, [1.0, 0.0, 0.0])] + [(1 + i, [0.5, float(i), float(-i * i)]) for i in range(190)] + [(7, [0.4, 9.0, 9.0]), (0, [2.0, 0.0, 0.0])]
    got = hilbert.nearest(spark.createDataFrame(tied, "vec_id long, embedding array<float>"), "vec_id", "embedding", F.col("id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(k + 1, i, 0.5) for k, i in enumerate(i for i in range(1, 30) if i != 7) if k < 20]
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert hilbert.nearest(few, "vec_id", "embedding", F.col("id") % 20 == 0).count() == 4
    assert hilbert.nearest(few.where("false"), "vec_id", "embedding", F.col("id") % 20 == 0).count() == 0


def test_recall_where_windows_are_a_part_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "WINDOW", 16)
    monkeypatch.setattr(hilbert, "WINDOW_SHARE", 0.0)
    rng = np.random.default_rng(11)
    rows = [(i, (rng.standard_normal(6) * rng.uniform(0.5, 1.5)).tolist()) for i in range(3000)]
    assert hilbert.OWN * (2 * hilbert.window_of(len(rows)) + 1) < len(rows) / 2
    want = brute_nearest(rows, 20)
    got: dict = {}
    for r in hilbert.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {v for v, _ in near}) / 20 for q, near in want.items()]) >= 0.9


def test_hilbert_neighbours_are_adjacent():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    place = hilbert.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


# ---- the pipeline


def test_stages_against_plain_versions(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{DATA}/documents.parquet"), None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            columns = columns or docs.columns
            assert after.columns == columns
            now = {r.doc_id: r for r in after.collect()}
        if i == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            good = [d for d in before if labels.get(d) == 1]
            assert all(d in now for d in good)
            assert not any(d in now for d in before if labels.get(d) == 0)
        elif i == 1:
            classes = brute_classes([(d, r.text) for d, r in before.items()])
            assert set(now) == set(classes.values())
        elif i == 2:
            want = brute_repeats([(d, r.text) for d, r in before.items()])
            for d, r in before.items():
                raw = r.text.encode()
                kept = repeats.kept_parts(raw, [{"start": a, "stop": b} for a, b in want[d, raw]])
                assert abs(len(now[d].text.encode()) - len(kept)) <= 3 * 2 * (1 + len(want[d, raw]))
                assert now[d].n_chars == len(now[d].text)
        elif i == 3:
            assert now.keys() == before.keys()
            assert all(not privacy.base_spans(r.text) for d, r in now.items() if not any(k == "card" for k, _, _ in privacy.base_spans(before[d].text)))
        else:
            pieces = after.collect()
            assert {r.doc_id for r in pieces} == set(before)
            assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
            assert packing.LENGTH == 1024
        docs = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicate classes", "repeated passages", "personal data", "packing"]


def test_stages_on_odd_input(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns that the stages use themselves."""
    long_ = " ".join(f"w{i * 7919 % 4001}" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "no id here"), (None, None), (3, long_), (4, long_ + " end"), (5, "mail jo@x.org now"), (5, "mail jo@x.org now"), (5, "another text of this id"), (6, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    for name in ("quality_score", "repeats", "doc_group", "found", "found_digest", "mark", "class_id", "digest", "range", "bands", "label"):
        df = df.withColumn(name, F.lit("own"))
    count = len(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, DATA)
        assert out.columns == df.columns, name
        got = out.collect()
        assert all(r.mark == r.repeats == r.found == "own" for r in got), name
        texts = sorted((r.doc_id or 0, r.text or "") for r in got)
        if name == "near-duplicate classes":
            # null and empty are one class of which 1 stays; 3 and 4 are near copies
            assert [i for i, _ in texts] == [0, 0, 1, 3, 5, 5, 5, 6]
        elif name == "repeated passages":
            assert len(got) == count and [t for i, t in texts if i == 4] == ["end"]  # the word before it ends with a space in 3 too
        elif name == "personal data":
            assert len(got) == count and texts.count((5, "mail [EMAIL] now")) == 2
        assert stage(spark, df.where("false"), DATA).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stage(spark, df, DATA)
    assert pieces.where("start = 0").count() == count
    assert stage(spark, df.where("false"), DATA).count() == 0
