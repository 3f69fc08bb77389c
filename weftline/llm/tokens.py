"""Tokenisation: forced-boundary byte-pair encoding, whitespace-chunk caching and the longest-match automaton."""

from __future__ import annotations

import base64
import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import give_back, steps, table

#: Entries that a worker's chunk cache holds before it starts again.
CACHE_ENTRIES = 400_000
#: Those of a byte-level vocabulary, whose packing comes last in the pipeline, when the JVM has its full size.
CHUNK_ENTRIES = 200_000

#: A regex for words of the lower-cased word vocabulary, as its tokenizer file states it (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(shown))
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class ForcedBoundaryBpe:
    """Byte-pair encoding of fragments between certain cuts.

    Two neighbouring bytes that no vocabulary token holds side by side can never be merged, so a word is cut there;
    white space is such a cut as well. The fragments are encoded on their own, those that end a word with the
    vocabulary's word-end mark, and the ids are put together again. ``path`` is the tokenizer file.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import Split

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words, self.space = regex.compile(WORD_PATTERN), regex.compile(r"\s+")
        self.to_chars = {b: c for b, c in enumerate(byte_chars())}
        to_byte = {c: b for b, c in self.to_chars.items()}
        self.forced = np.ones(1 << 16, dtype=bool)
        for token in self.vocab:
            raw = [to_byte[c] for c in token.removesuffix(self.end)]
            for a, b in zip(raw, raw[1:], strict=False):
                self.forced[a << 8 | b] = False
        self.encoders = {}
        for ends in (False, True):
            t = Tokenizer(BPE(vocab=self.vocab, merges=merges, cache_capacity=0, **({"end_of_word_suffix": self.end} if ends else {})))
            t.pre_tokenizer = Split(" ", "removed")
            self.encoders[ends] = t
        self.ids_of: dict[str, str] = {}
        self.tokens_of: dict[str, str] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        raw = np.frombuffer(word, dtype=np.uint8).astype(np.uint16)
        cuts = np.flatnonzero(self.forced[raw[:-1] << 8 | raw[1:]]) + 1
        bounds = [0, *cuts.tolist(), len(word)]
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _encode_all(self, pieces: list[str], ends: bool) -> list[list[int]]:
        """Ids of each piece; the pieces go through the encoder in one string parted by spaces."""
        if not pieces:
            return []
        e = self.encoders[ends].encode(" ".join(pieces), add_special_tokens=False)
        ids, of = e.ids, np.array(e.word_ids, dtype=np.int64)
        # Words are numbered with the spaces that were removed between them.
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist()
        assert len(starts) == len(pieces)
        return [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]

    def learn(self, chunks: list[str]) -> None:
        """Fills the cache with white-space-free, normalised chunks."""
        final: list[str] = []
        inner: list[str] = []
        plan: list[list[tuple[bool, int]]] = []
        raw_words = [[w.encode("utf-8") for w in self.words.findall(c)] for c in chunks]
        flat = [w for ws in raw_words for w in ws]
        buf = np.frombuffer(b"".join(flat), dtype=np.uint8).astype(np.uint16)
        ends = np.cumsum(np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)))
        cut = self.forced[buf[:-1] << 8 | buf[1:]] if len(buf) > 1 else np.zeros(0, dtype=bool)
        if len(cut):
            cut[ends[:-1] - 1] = False  # between two words
        has = np.zeros(len(flat), dtype=bool)
        has[np.searchsorted(ends, np.flatnonzero(cut), side="right")] = True
        k = 0
        for ws in raw_words:
            steps_: list[tuple[bool, int]] = []
            for w in ws:
                parts = self.fragments(w) if has[k] else [w]
                k += 1
                for p in parts[:-1]:
                    steps_.append((False, len(inner)))
                    inner.append(p.decode("latin-1").translate(self.to_chars))
                steps_.append((True, len(final)))
                final.append(parts[-1].decode("latin-1").translate(self.to_chars))
            plan.append(steps_)
        got = {True: self._encode_all(final, True), False: self._encode_all(inner, False)}
        for chunk, steps_ in zip(chunks, plan, strict=True):
            ids = [i for which, at in steps_ for i in got[which][at]]
            self.ids_of[chunk] = " ".join(map(str, ids))
            self.tokens_of[chunk] = " ".join([self.names[i] for i in ids])

    def forget(self) -> None:
        self.ids_of.clear()
        self.tokens_of.clear()

    def chunks(self, text: str) -> list[list[str] | str]:
        """Normalised, white-space-free chunks of the stretches between special tokens, and those tokens as strings."""
        import unicodedata

        out: list[list[str] | str] = []
        for k, part in enumerate(self.special_split.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            odd = any(c in part for c in "\x1c\x1d\x1e\x1f")  # white space to str.split, not to the pattern
            out.append([c for c in self.space.split(part) if c] if odd else part.split())
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Per text its ids and its decoded tokens, each as one string joined by spaces."""
        if len(self.ids_of) > CACHE_ENTRIES:
            self.forget()
        cut = [self.chunks(t) for t in texts]
        new = {c for doc in cut for part in doc if isinstance(part, list) for c in part} - self.ids_of.keys()
        new = list(new)
        for a in range(0, len(new), 50_000):
            self.learn(new[a : a + 50_000])
        ids_of, tokens_of = self.ids_of.__getitem__, self.tokens_of.__getitem__
        for doc in cut:
            ids, tokens = [], []
            for part in doc:
                if isinstance(part, str):
                    ids.append(str(self.special[part]))
                    tokens.append(part)
                elif part:
                    ids.append(" ".join(map(ids_of, part)))
                    tokens.append(" ".join(map(tokens_of, part)))
            yield " ".join(ids), " ".join(tokens)


@cache
def forced_bpe(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (decimal, joined by spaces), decoded text, n_tokens of each row, in its own task, no shuffle.

    Null texts count as empty (no tokens, empty decoded text). Rows that repeat a doc_id are all returned, null ids
    included, each by itself, so ties need no rule; other columns, whatever their names, are ignored; no rows give no
    rows. A very long text is one step of its own.
    """

    def run(batches):
        bpe = forced_bpe(path)
        for b in steps(batches, "text"):
            got = list(bpe.encode([t or "" for t in b.column("text").to_pylist()]))
            n = [ids.count(" ") + 1 if ids else 0 for ids, _ in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.string()), pa.array(n, pa.int64())], ["doc_id", "ids", "decoded", "n_tokens"])
        bpe.forget()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids string, decoded string, n_tokens long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    out = encode_decode(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


class ByteBpe:
    """Ids of a text under a byte-level vocabulary, as packed little-endian 32-bit integers.

    A space between two non-space characters always begins a word of the vocabulary's pattern, so a text is cut there
    and each chunk's ids are kept in a cache. Texts with other white space, rare characters or special tokens go
    through the library as a whole.
    """

    def __init__(self, path: str, ranks_path: str):
        import re

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.rare = re.compile(r"  | \n|\n |[\t\r\x0b\x0c\x1c-\x1f\x85\xa0]|[^\x00-ɏ‐-‧]|^ | $|<\|endoftext\|>")
        encode = self.fast.encode_ordinary

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                got = self[chunk] = array("I", encode(" " + chunk)).tobytes()
                return got

        self.chunks = Chunks()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.rare.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        if len(self.chunks) > CHUNK_ENTRIES:
            self.chunks.clear()
        return array("I", self.fast.encode_ordinary(first)).tobytes() + b"".join(map(self.chunks.__getitem__, rest))


@cache
def byte_bpe(path: str, ranks_path: str) -> ByteBpe:
    return ByteBpe(path, ranks_path)


class LongestMatch:
    """Greedy longest-match token counts in one pass over a word's bytes.

    The vocabulary is a trie. Where a node has no child for the next byte, its failure link leads to the node of what
    remains after the greedy tokens that are certain by then have been popped; their number was computed with the
    link, so a word's count is a sum of such numbers and no piece is ever built. Every single byte is a token here,
    so every word has tokens.
    """

    def __init__(self, tokens: list[bytes]):
        tokens = sorted({*tokens, *(bytes([b]) for b in range(256))})
        child: list[dict[int, int]] = [{}]
        ends = [False]
        for t in tokens:
            at = 0
            for b in t:
                nxt = child[at].get(b)
                if nxt is None:
                    nxt = child[at][b] = len(child)
                    child.append({})
                    ends.append(False)
                at = nxt
            ends[at] = True
        fail, pops = [0] * len(child), [0] * len(child)
        order = [0]
        for at in order:  # breadth first: links of shorter prefixes come first
            for b, nxt in child[at].items():
                order.append(nxt)
                if ends[nxt]:
                    fail[nxt], pops[nxt] = 0, 1  # the whole prefix is one token
                else:
                    # follow the parent's link until b can be read; the root reads every byte
                    z, n = fail[at], pops[at]
                    while b not in child[z]:
                        n += pops[z]
                        z = fail[z]
                    fail[nxt], pops[nxt] = child[z][b], n
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: bytes) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        at = n = 0
        for b in word:
            nxt = child[at].get(b)
            while nxt is None:
                n += pops[at]
                at = fail[at]
                nxt = child[at].get(b)
            at = nxt
        while at:
            n += pops[at]
            at = fail[at]
        return n


@cache
def longest_match(path: str) -> tuple[LongestMatch, dict[str, int]]:
    matcher = LongestMatch([base64.b64decode(line.split()[0]) for line in open(path, "rb")])

    class Counts(dict):
        def __missing__(self, word: str) -> int:
            n = self[word] = matcher.count(b" " + word.encode("utf-8"))
            return n

    return matcher, Counts()


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens: greedy longest-match tokens of each white-space word with a space before it.

    ``path`` is a vocabulary of base64 tokens with ranks, one a line. Null and empty texts count 0. Each row counts
    on its own, so ties, repeated rows and null ids need no rule; other columns, whatever their names, are ignored; no
    rows give no rows. A very long text is a step of its own.
    """

    def run(batches):
        _, counts = longest_match(path)
        for b in steps(batches, "text"):
            words, tokens = [], []
            for t in b.column("text").to_pylist():
                if len(counts) > CACHE_ENTRIES:
                    counts.clear()
                ws = (t or "").split()
                words.append(len(ws))
                tokens.append(sum(map(counts.__getitem__, ws)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])
        counts.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
