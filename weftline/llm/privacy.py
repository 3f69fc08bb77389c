"""Personal data: exact patterns, and terms whose co-occurrence in the corpus reveals the protected entities."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import checkpointed, steps, table, unused

KINDS = ("email", "ip", "card", "phone")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: Pseudo-texts that draw a term's share of texts with an entity towards the entity's share of all texts.
PRIOR_TEXTS = 5.0
#: A term reveals an entity if, given the term, at most so many bits of it remain unknown, and so many at least were told.
RESIDUAL_BITS, TOLD_BITS = 0.6, 2.0
#: One in so many texts is counted first, to find terms that are too common to reveal anything.
PART = 16
#: Terms that are sent to all executors at most; beyond, they are joined.
BROADCAST_TERMS = 500_000
#: Ids of further copies that are sent to all executors at most; beyond, they are joined.
BROADCAST_IDS = 1_000_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits are taken whole, so that a long run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\w+")
#: Words with a digit, each read from its beginning.
_CODE = re.compile(r"\b(?=[^\W0-9]*[0-9])\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; code points, end exclusive."""
    out = []
    at, done, before = text.find("@"), 0, 0
    while at >= 0:
        low = max(done, before)  # the last match's end, or the sign before
        run = text[low:at]
        start = low + len(run.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        before = at + 1
        at = text.find("@", max(before, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> str:
    """One name for all ways to write a value."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def term_of(word: str) -> str:
    """A word's term: the lower-cased word, or, if it holds a digit, its shape (letters or none, and its length), so that
    what is written alike counts together."""
    if not _DIGIT.search(word):
        return word.lower()
    return f"{'a9' if any(c.isalpha() for c in word) else '9'}#{len(word)}"


def words_outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The words that touch no span, in one pass."""
    edges = sorted((a, b) for _, a, b in spans)
    k, reach = 0, 0  # spans that begin before a word's end, and how far they reach
    for m in _WORD.finditer(text):
        while k < len(edges) and edges[k][0] < m.end():
            reach = max(reach, edges[k][1])
            k += 1
        if m.start() >= reach:
            yield m


def terms(text: str) -> set[str]:
    """All terms of a text without spans. Words with digits are left as they are beside their shapes."""
    found = {w.lower() for w in set(_WORD.findall(text))}
    if _DIGIT.search(text):
        found.update(map(term_of, _CODE.findall(text)))
    return found


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, mark, digest, entities and terms (those outside of spans; both empty without spans) of each row."""

    def run(batches):
        strings = pa.list_(pa.string())
        for b in steps(batches, "text"):
            digests, entities, outside = [], [], []
            for t in b.column("text").to_pylist():
                t = t or ""
                own = base_spans(t)
                digests.append(hashlib.blake2b(t.encode("utf-8"), digest_size=16).digest())
                entities.append(sorted({entity(k, t[x:y]) for k, x, y in own}))
                outside.append(sorted({term_of(m.group()) for m in words_outside(t, own)}) if own else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(digests, pa.binary()), pa.array(entities, strings), pa.array(outside, strings)], ["doc_id", "mark", "digest", "entities", "terms"])

    return keyed(docs).mapInArrow(run, "doc_id long, mark long, digest binary, entities array<string>, terms array<string>")


def texts_with_terms(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n): the rows of ``docs`` without spans that hold each of the terms ``wanted``, counted over whole texts."""
    if wanted.count() <= BROADCAST_TERMS:
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in wanted.toLocalIterator()))

        def run(batches):
            known, count = sent.value, Counter()
            for b in steps(batches, "text"):
                for t in b.column("text").to_pylist():
                    if t and not base_spans(t):
                        count.update(known & terms(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

        return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    def split(batches):
        for b in steps(batches, "text"):
            for t in b.column("text").to_pylist():
                if t and not base_spans(t):
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(terms(t)), pa.string())], ["term"])

    return docs.select("text").mapInArrow(split, "term string").join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def told(n_both: Column, n_term: Column, share: Column) -> tuple[Column, Column]:
    """Bits of an entity that a term leaves unknown, and bits that it tells: from the share of the term's texts that hold
    the entity, drawn by PRIOR_TEXTS towards ``share``, the entity's share of all texts."""
    posterior = (n_both + PRIOR_TEXTS * share) / (n_term + PRIOR_TEXTS)
    return -F.log2(posterior), F.log2(posterior / share)


def reveals(n_both: Column, n_term: Column, share: Column) -> Column:
    left, gained = told(n_both, n_term, share)
    return (left <= RESIDUAL_BITS) & (gained >= TOLD_BITS)


def revealing(docs: DataFrame) -> DataFrame:
    """(term, entity) of all terms that reveal a protected entity, estimated over the whole corpus.

    Entities are every value, the four kinds, and personal data of any kind. Counted are different texts, for the
    corpus, the entities, the terms and the pairs alike; a term counts where it stands outside of spans. A term tells
    log2(P(entity | term) / P(entity)) bits of the entity's log2(1 / P(entity)); P(entity | term) is drawn towards
    P(entity) by a prior, so a term of few texts tells little, without a least number of texts. Values that occur in
    the same texts are one entity, named by the smallest. Rows without an id count once each, copies or not.
    """
    scanned = checkpointed(scan(docs))
    copies = checkpointed(scanned.groupBy("digest").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "mark")).alias("first")))
    texts = copies.count()
    private = checkpointed(scanned.where(F.size("entities") > 0).groupBy("digest").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms")))
    total = F.lit(float(texts))
    kind = lambda k: F.exists("entities", lambda e: e.startswith(f"{k}:"))
    flags = {"any": F.lit(True)} | {k: kind(k) for k in KINDS}
    count = lambda: [F.sum(F.col(f"is_{k}").cast("long")).alias(f"n_{k}") for k in flags]
    marked = private.select("digest", "entities", "terms", *(c.alias(f"is_{k}") for k, c in flags.items()))
    sizes = marked.agg(*count()).first()
    # by kind: one pass over the terms counts for all kinds
    held = checkpointed(marked.select(F.explode("terms").alias("term"), *(f"is_{k}" for k in flags)).groupBy("term").agg(*count()))
    by_kind = held.select("term", F.explode(F.array(*(F.struct(F.lit(k).alias("entity"), F.col(f"n_{k}").alias("n_both"), F.lit(float(sizes[f"n_{k}"] or 0)).alias("n_entity")) for k in flags))).alias("e")).select("term", "e.*")
    # by value: only values in so many texts that a term could reveal them
    value = private.select("digest", F.explode("entities").alias("entity"))
    value = value.groupBy("entity").agg(F.count("*").cast("double").alias("n_entity"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("where"))
    value = value.where(reveals(F.col("n_entity"), F.col("n_entity"), F.col("n_entity") / total)).groupBy("n_entity", "where").agg(F.min("entity").alias("entity"))
    value = checkpointed(value.select("entity", "n_entity"))
    pairs = by_kind
    if value.count():
        of_text = private.select("digest", F.explode("entities").alias("entity")).join(value, "entity")
        pairs = pairs.unionByName(of_text.join(private.select("digest", "terms"), "digest").select("entity", "n_entity", F.explode("terms").alias("term")).groupBy("term", "entity").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity")))
    share = F.col("n_entity") / total
    pairs = pairs.where((F.col("n_both") > 0) & reveals(F.col("n_both"), F.col("n_both"), share)).join(held.select("term", "n_any"), "term")
    # the most texts without spans that may hold a term which reveals the entity
    room = (F.col("n_both") + PRIOR_TEXTS * share) * 2**RESIDUAL_BITS - PRIOR_TEXTS - F.col("n_any")
    pairs = checkpointed(pairs.withColumn("room", room + 1e-6).where(F.col("room") >= 0))
    wanted = checkpointed(pairs.groupBy("term").agg(F.max("room").alias("room")))
    if not wanted.count():
        return pairs.select("term", "entity")
    # the texts without spans that hold the terms; of copies one counts
    again = copies.where("rows > 1").select("digest", "first")
    again = scanned.join(again, "digest").where(F.struct("doc_id", "mark") != F.col("first")).select("doc_id", "mark").distinct()
    again = checkpointed(again)
    once = keyed(docs).join(F.broadcast(again) if again.count() <= BROADCAST_IDS else again, ["doc_id", "mark"], "left_anti")
    # what a part of the texts holds is a lower bound for all: terms that are too many there already reveal nothing,
    # which spares counting common words everywhere
    early = texts_with_terms(once.where(F.pmod("mark", F.lit(PART)) == 0), wanted.select("term"))
    wanted = checkpointed(wanted.join(early, "term", "left").where(F.coalesce("n", F.lit(0)) <= F.col("room")).select("term"))
    clean = texts_with_terms(once, wanted)
    n_term = wanted.join(clean, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n_clean"))
    return pairs.join(n_term, "term").withColumn("n_term", F.col("n_any") + F.col("n_clean")).where(reveals(F.col("n_both"), F.col("n_term"), share)).select("term", "entity")


SPAN = "array<struct<kind:string,start:int,stop:int>>"


def with_spans(docs: DataFrame, name: str) -> DataFrame:
    """All columns of ``docs`` and ``name``: the spans (kind, start, stop) of each text; the base ones by kind and
    start, then those of kind 'term': every place, outside of the base spans, of a term that reveals an entity."""
    known = checkpointed(revealing(docs.select("doc_id", "text")).select("term").distinct())
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(SPAN))])
    few = known.count() <= BROADCAST_TERMS
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in known.toLocalIterator()) if few else frozenset())

    def run(batches):
        terms_ = sent.value
        for b in steps(batches, "text"):
            spans = []
            for t in b.column("text").to_pylist():
                t = t or ""
                own = base_spans(t)
                extra = [("term", *m.span()) for m in words_outside(t, own) if term_of(m.group()) in terms_] if terms_ and not terms_.isdisjoint(terms(t)) else []
                spans.append([{"kind": k, "start": x, "stop": y} for k, x, y in own + extra])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, found)], [*b.schema.names, name])

    out = docs.mapInArrow(run, schema)
    if few:
        return out

    digest = unused(f"{name}_digest", [*docs.columns, name])

    def places(batches):
        for b in steps(batches, "text"):
            for key, t in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True):
                at = [(key, term_of(w.group()), *w.span()) for w in words_outside(t or "", base_spans(t or ""))]
                yield pa.RecordBatch.from_pylist([dict(zip(("digest", "term", "start", "stop"), x, strict=True)) for x in at], pa.schema([("digest", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    # a text's places are found once for all its copies
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    once = docs.select(sha.alias("digest"), "text").dropDuplicates(["digest"])
    extra = once.mapInArrow(places, "digest string, term string, start int, stop int").join(known, "term")
    extra = extra.groupBy(F.col("digest").alias(digest)).agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "stop"))), lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("extra"))
    extra = extra.withColumnRenamed("extra", unused("extra", [*docs.columns, name, digest]))
    joined = out.withColumn(digest, sha).join(extra, digest, "left")
    return joined.withColumn(name, F.concat(name, F.coalesce(joined[joined.columns[-1]], F.array().cast(SPAN)))).select(*docs.columns, name)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans generalised to their kind's mark, revealing terms removed and n_chars brought up to date
    if there is such a column.

    Texts without spans, null and empty ones too, stay as they are. Repeated rows change alike; of overlapping spans
    the first is marked and the others go with it. Columns of any other name are kept; no rows give no rows. A very
    long text is a step of its own.
    """
    kept, name = docs.columns, unused("found", docs.columns)
    lengths = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            texts, sizes = [], b.column("n_chars").to_pylist() if lengths else []
            for i, (t, spans) in enumerate(zip(b.column("text").to_pylist(), b.column(name).to_pylist(), strict=True)):
                if t is not None and spans:
                    parts, at = [], 0
                    for start, stop, mark in sorted((s["start"], s["stop"], MARKS.get(s["kind"], "")) for s in spans):
                        if start >= at:
                            parts += [t[at:start], mark]
                        at = max(at, stop)
                    t = "".join([*parts, t[at:]])
                    if lengths:
                        sizes[i] = len(t)
                texts.append(t)
            changed = {"text": pa.array(texts, pa.string())} | ({"n_chars": pa.array(sizes, b.column("n_chars").type)} if lengths else {})
            yield pa.RecordBatch.from_arrays([changed.get(c, b.column(c)) for c in kept], kept)

    return with_spans(docs, name).mapInArrow(run, docs.schema)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole text; null and empty texts have none, repeated rows get the same."""
    out = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "spans")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    return out.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "term"), line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        F.size(of("term")).cast("long").alias("n_terms"),
        F.size("spans").cast("long").alias("n_spans"),
    )
