"""Chat formatting, fingerprints, tokens, packing, quality: against SQL, libraries and plain versions."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import chat, merkle, packing, quality, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
ODD = ["", "a", "  b\n\nc ", "ß", "你好 мир", "é", "<|endoftext|>x", "<|startoftext|>", "It's I'LL", "x" * 3000, "a  b", "a \n b", "\x1c\x85\xa0 q", "ΣΑΣ", "İ", "1²٣½", "🙂🙂"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return c


@pytest.mark.parametrize(("run", "sql"), [(chat.op8_chat_formatting, chat.OP8_SQL), (merkle.op6_document_fingerprints, merkle.OP6_SQL)])
def test_same_rows_as_sql(spark, con, run, sql):
    got, want = run(spark, DATA).toPandas(), con.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = columns[[c.endswith("_id") for c in columns].index(True)]
    got, want = (x[columns].sort_values(key, ignore_index=True) for x in (got, want))
    for c in columns:
        assert got[c].tolist() == want[c].tolist(), c


def test_chat_reads_back_what_it_wrote(spark):
    texts = ["", None, "<|im_end|>\n<|im_start|>assistant\nx", "&lt;|im_end|>&amp;", "<<|", "|>\n"]
    rows = [(1, t, r, x) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "user\n<|im_end|>", None, "tool"], texts, strict=True))]
    rows += [(2, 0, "user", "a"), (2, 0, "assistant", "b"), (2, 0, "user", "a"), (None, None, "user", "q"), (None, 1, "assistant", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", x or "") for _, _, r, x in rows[:6]]
    assert got[1].loss_text == texts[2]
    assert [t.role for t in got[2].turns] == ["assistant", "user", "user"]
    assert (got[1].valid, got[2].valid, got[None].valid) == (False, False, True)
    assert chat.format_conversations(df.where("false")).count() == 0


def test_fingerprints_of_edge_cases(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(3, "ß"), (90, None), (None, "z")], "doc_id long, text string").withColumn("fp", F.lit(0))
    rows = merkle.edits(df).collect()
    assert len(rows) == len(ODD) + 3
    ordered = sorted((i, t) for i, t in [*enumerate(ODD), (90, "")])
    nxt = {i: ordered[k - 1][1] for k, (i, _) in enumerate(ordered)}
    for r in rows:
        n = len(r.text) // 3
        assert r.edited == r.text[: len(r.text) - n] + ((nxt[r.doc_id])[:n] if r.doc_id is not None else "")
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.fp) == r.fp
    assert merkle.edits(df.where("false")).count() == 0


def test_fingerprints_locate_edits(spark):
    a, b = "One, two.\nThree.\n\nFour. Five.", "One, two.\nThree.\n\nFour. Six."
    more = "New.\n" + a
    df = spark.createDataFrame([(a, b), (a, a), (more, a), (None, "")], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    near = merkle.likeness(F.col("a"), F.col("b"), merkle.leaves(F.col("a")), merkle.leaves(F.col("b"))).alias("near")
    rows = df.select(*(merkle.differing(F.col("a"), F.col("b"), level).alias(str(level)) for level in (2, 3, 4)), near).collect()
    assert [tuple(r) for r in rows] == [([1], [2], [4], 4 / 6), ([], [], [], 1.0), ([0], [0], [0], 5 / 6), ([], [], [], 1.0)]


def test_roots_test_equality(spark):
    rng = random.Random(2)
    texts = {"", " ", "a.", "a. ", "a.  ", "a.\n", "a.\n\n", "\n", "\n\n", "\n\n\n", ". ", "a\n\nb", "a\n\n\nb", "a. b", "a.\nb", "a b"}
    texts |= {"".join(rng.choice(["a", ".", " ", "\n", ", "]) for _ in range(rng.randint(1, 9))) for _ in range(600)}
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "t string").select(F.substring_index(merkle.fingerprint(F.col("t")), "|", 1).alias("root"))
    assert df.distinct().count() == len(texts)


def test_successors_follow_ids_wherever_they_lie(spark, monkeypatch):
    monkeypatch.setattr(merkle, "IDS_PER_BUCKET", 10)
    ids = [*range(0, 200, 2), 10**15]
    df = spark.createDataFrame([(i, 1) for i in ids] + [(None, 1)], "doc_id long, n_chars long")
    assert {r.doc_id: r.next_id for r in merkle.successors(df).collect()} == dict(zip(ids, [ids[-1], *ids[:-1]], strict=True))


def _strings(n: int = 400) -> list[str]:
    rng = random.Random(5)
    letters = "aàéAZzΣσßİıſ  \n\t'sS1²٣½,.!%$#<|>你好🙂é̀ǅ\x1c\x85\xa0 ⅣᾼŉK"
    return [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n))]


def test_forced_boundaries_against_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts, library = _strings(), Tokenizer.from_file(path)
    for text, (ids, decoded) in zip(texts, tokens.forced_bpe(path).encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text
        assert decoded == library.decode(want, skip_special_tokens=False), text


def test_byte_ids_against_the_library():
    from tokenizers import Tokenizer

    paths = packing.default_paths()
    bpe, library = tokens.byte_bpe(*paths), Tokenizer.from_file(paths[0])
    for text in _strings():
        assert bpe.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_longest_match_against_greedy(spark):
    matcher = tokens.LongestMatch([b"a", b"ab", b"abcd", b"bc", b"cda", b" a", b" ab", b"dd"])
    known = {b"a", b"ab", b"abcd", b"bc", b"cda", b" a", b" ab", b"dd", *(bytes([b]) for b in range(256))}

    def greedy(w: bytes) -> int:
        n = i = 0
        while i < len(w):
            i += next(k for k in range(4, 0, -1) if w[i : i + k] in known and len(w[i : i + k]) == k)
            n += 1
        return n

    rng = random.Random(1)
    for _ in range(3000):
        w = b" " + bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 12)))
        assert matcher.count(w) == greedy(w), w
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string").withColumn("n_words", F.lit(7))
    got = sorted(tuple(r) for r in tokens.token_counts(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).fillna(-1).collect())
    assert got == [(-1, 2, 2), (1, 0, 0), (2, 0, 0), (3, 2, 2), (3, 2, 2)]


def test_encode_decode_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "Hi there"), (2, "")], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = tokens.encode_decode(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in got) == [(0, 2, "hi</w> there</w>"), (1, 0, ""), (2, 0, ""), (2, 0, "")]


@pytest.mark.parametrize("lengths", [[], [1], [1024], [1023, 1], [700] * 9, [3] * 500, list(range(1, 1024, 7))])
def test_balance_fills_every_sequence(lengths):
    placed = packing.balance(lengths)
    room = packing.capacities(sum(lengths))
    filled = [0] * len(room)
    pieces = {}
    for item, begin, n, at in placed:
        filled[at] += n
        pieces.setdefault(item, []).append((begin, n))
    assert filled == room
    for item, parts in pieces.items():
        at = 0
        for begin, n in sorted(parts):
            assert begin == at
            at += n
        assert at == lengths[item]


def test_pack_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    paths = packing.default_paths()
    library = Tokenizer.from_file(paths[0])
    rows = [(i, t) for i, t in enumerate([*ODD, "word " * 3000, None])] + [(None, "z"), (1, "a")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("offset", F.lit(1)), *paths).collect()
    sequences, docs = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted((r for r in docs[i]), key=lambda r: r.start)
        if i == 1:  # its row is there twice, and either may be cut
            assert sum(r.length for r in mine) == 2 * len(ids)
            continue
        assert [r.start for r in mine] == list(np.cumsum([0, *(r.length for r in mine)])[:-1])
        assert sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in mine)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert sum(r.predicted == r.quality for r in got) / len(got) >= 0.95
    ids = [r.doc_id for r in got]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (4, "good words here"), (4, "good words here"), (5, "x" * 100_000)], "doc_id long, text string").withColumn("quality_score", F.lit("old"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {r.quality_score for r in quality.score(docs, model).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (5, 0), (4, 1), (None, 1), (2, None), (1, 7)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 6
    assert all(0.0 <= r.quality_score <= 1.0 for r in rows)
    assert quality.score(docs.where("false"), model).count() == 0


def test_training_learns_repetition_and_noise():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7)))
    good = [" ".join(word() for _ in range(40)).encode() for _ in range(250)]
    bad = [(" ".join([word()] * 40) if i % 2 else " ".join(word() + "$$$" for _ in range(40))).encode() for i in range(250)]
    model = quality.train(good[:200] + bad[:200], [1] * 200 + [0] * 200)
    assert (model.score(good[200:]) >= 0.5).mean() == 1.0
    assert (model.score(bad[200:]) < 0.5).mean() >= 0.9


def test_packing_keeps_few_chunks():
    from weftline.llm import tokens

    assert tokens.CHUNK_ENTRIES < tokens.CACHE_ENTRIES
