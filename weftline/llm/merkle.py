"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections, in SQL functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import checkpointed, table

#: Rows of ids that a window partition of the document order holds on average.
IDS_PER_BUCKET = 20_000


#: Digits of a leaf's hash in a fingerprint.
LEAF_DIGITS = 12


def _clauses(paragraph: Column) -> Column:
    return F.split(F.regexp_replace(paragraph, r"([.,;:!?]) ", "$1\n"), "\n")


def _hash(kind: str, content: Column) -> Column:
    """Nodes of different kinds never have one preimage."""
    return F.sha2(F.concat(F.lit(f"{kind}:"), content), 256)


def fingerprint(text: Column) -> Column:
    """The tree as one string: root, sections, paragraphs and leaves from the top down, levels parted by '|'.

    Sections are parted by an empty line, paragraphs by a line break, leaves are clauses (text up to a punctuation
    mark and a space). Nothing is dropped, so the tree has its text back: leaves joined by a space, paragraphs by a
    line break, sections by two. A leaf's hash is the SHA-256 of its text, an inner node's that of its children's
    hashes, each after the name of its kind; so the root tests equality of texts. The string holds 16 digits of inner
    nodes with their number of children, and LEAF_DIGITS of leaves. Null and empty texts have the tree of one empty
    leaf. Repeated rows have one fingerprint; a very long text has a long one.
    """
    sections = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(_clauses(p), lambda c: _hash("leaf", c))))
    return fingerprint_of_leaves(sections)


def fingerprint_of_leaves(sections: Column) -> Column:
    def paragraph(p: Column) -> Column:
        return F.struct(_hash("paragraph", F.array_join(p, "")).alias("h"), p.alias("leaves"))

    def section(ps: Column) -> Column:
        return F.struct(_hash("section", F.array_join(F.transform(ps, lambda p: p["h"]), "")).alias("h"), ps.alias("ps"))

    # The tree is bound once by the one-element array, so that no level is evaluated again.
    tree = F.array(F.transform(F.transform(sections, lambda s: F.transform(s, paragraph)), section))

    def write(ss: Column) -> Column:
        ps = F.flatten(F.transform(ss, lambda s: s["ps"]))
        node = lambda h, n: F.concat(F.substring(h, 1, 16), F.lit(":"), n.cast("string"))
        return F.concat_ws(
            "|",
            _hash("document", F.array_join(F.transform(ss, lambda s: s["h"]), "")),
            F.array_join(F.transform(ss, lambda s: node(s["h"], F.size(s["ps"]))), " "),
            F.array_join(F.transform(ps, lambda p: node(p["h"], F.size(p["leaves"]))), " "),
            F.array_join(F.transform(F.flatten(F.transform(ps, lambda p: p["leaves"])), lambda h: F.substring(h, 1, LEAF_DIGITS)), " "),
        )

    return F.element_at(F.transform(tree, write), 1)


#: The hash of an empty leaf, which says nothing about likeness.
EMPTY_LEAF = hashlib.sha256(b"leaf:").hexdigest()[:LEAF_DIGITS]


def nodes(fp: Column, level: int) -> Column:
    """The nodes of a level in order: 1 the root, 2 sections, 3 paragraphs, 4 leaves."""
    return F.split(F.element_at(F.split(fp, r"\|"), level), " ")


def leaves(fp: Column) -> Column:
    return F.filter(nodes(fp, 4), lambda h: h != EMPTY_LEAF)


def likeness(a: Column, b: Column, x: Column, y: Column) -> Column:
    """How alike two fingerprints ``a`` and ``b`` with leaves ``x`` and ``y`` are, 0 to 1: 1 at once if their roots are
    equal, else the share of their different leaves that both have; 0 if one is null."""
    both, either = F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")
    return F.when(a.isNull() | b.isNull(), 0.0).when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), 1.0).when(either == 0, 0.0).otherwise(both / either)


def differing(a: Column, b: Column, level: int) -> Column:
    """Places (from 0) of the nodes of ``a`` at a level (2 sections, 3 paragraphs, 4 leaves) that ``b`` hasn't got, none
    if the roots are equal. What was inserted or removed before a node does not make it differ."""
    mine = nodes(a, level)
    lost = F.array_except(mine, nodes(b, level))
    found = F.filter(F.transform(mine, lambda h, i: F.when(F.array_contains(lost, h), i)), lambda i: i.isNotNull())
    return F.when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), F.array().cast("array<int>")).otherwise(found)


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, n_chars) of each doc_id with ``next_id``, the next smaller doc_id; the smallest has the largest.

    Ids are dealt into ranges of about as many ids, wherever they lie, so no single task orders them all; what one
    range lacks is the largest id of the range below. Null doc_ids take no part.
    """
    ids = ids.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    high, n = ids.agg(F.max("doc_id"), F.count("*")).first()
    if not n:
        return ids.withColumn("next_id", F.col("doc_id"))
    # written once, as both uses must see the same ranges
    cut = checkpointed(ids.repartitionByRange(max(1, n // IDS_PER_BUCKET), "doc_id").withColumn("bucket", F.spark_partition_id()))
    inner = cut.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("bucket").orderBy(F.desc("doc_id"))))
    heads = cut.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    below = heads.select("bucket", F.lead("head").over(Window.orderBy(F.desc("bucket"))).alias("below"))
    return inner.join(below, "bucket", "left").select("doc_id", "n_chars", F.coalesce("next_id", "below", F.lit(high)).alias("next_id"))


def edits(docs: DataFrame) -> DataFrame:
    """Each document with its edited text and fingerprints: doc_id, text, edited, fp, edited_fp, next_fp.

    The last third of a text (code points, rounded down) gives way to the beginning of the next document's text in
    descending order of doc_id, as long as that third, or all of it. Texts are shuffled once by doc_id; only the
    beginnings and fingerprints asked for are shuffled again. Columns of other names are ignored; no rows give no rows.
    Rows that repeat a doc_id are all returned; as the next
    document counts the one of them with the largest beginning. A null doc_id has no next document (its third is
    cut off, and likeness to the next is 0).
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    nameless, docs = docs.where("doc_id is null"), docs.where("doc_id is not null")  # one filter, so that both joins read one exchange
    order = successors(docs.select("doc_id", F.length("text").cast("long").alias("n_chars")))
    asked = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("asker"), F.floor(F.col("n_chars") / 3).cast("int").alias("n"))
    sent = docs.join(asked.hint("shuffle_hash"), "doc_id").select("asker", F.substring("text", F.lit(1), F.col("n")).alias("beginning"), fingerprint(F.col("text")).alias("next_fp"))
    got = sent.groupBy(F.col("asker").alias("doc_id")).agg(F.max(F.struct("beginning", "next_fp")).alias("next"))
    out = docs.join(got, "doc_id", "left").unionByName(nameless, allowMissingColumns=True)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    out = out.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.coalesce("next.beginning", F.lit(""))))
    return out.select("doc_id", "text", "edited", fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("edited_fp"), F.col("next.next_fp").alias("next_fp"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edits(table(spark, sf_dir, "documents")).withColumns({"a": leaves(F.col("fp")), "b": leaves(F.col("edited_fp")), "c": leaves(F.col("next_fp"))})
    return e.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp"), F.col("a"), F.col("c")).alias("near_next"),
        F.size(differing(F.col("edited_fp"), F.col("fp"), 3)).cast("long").alias("changed_paragraphs"),
    )


def _tree_sql(column: str) -> str:
    split = r"string_split(regexp_replace(p, '([.,;:!?]) ', '\1' || chr(10), 'g'), chr(10))"
    shas = f"list_transform(string_split({column}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform({split}, lambda c: sha256('leaf:' || c))))"
    ps = "list_transform(x, lambda s: list_transform(s, lambda p: {'h': sha256('paragraph:' || array_to_string(p, '')), 'leaves': p}))"
    ss = f"list_transform({ps}, lambda s: {{'h': sha256('section:' || array_to_string(list_transform(s, lambda p: p.h), '')), 'ps': s}})"
    return f"list_transform([{shas}], lambda x: {ss})[1]"


def _fp_sql(tree: str) -> str:
    ps = f"flatten(list_transform({tree}, lambda s: s.ps))"
    return (
        f"sha256('document:' || array_to_string(list_transform({tree}, lambda s: s.h), '')) || '|' || array_to_string(list_transform({tree}, lambda s: s.h[1:16] || ':' || len(s.ps)), ' ')"
        f" || '|' || array_to_string(list_transform({ps}, lambda p: p.h[1:16] || ':' || len(p.leaves)), ' ')"
        f" || '|' || array_to_string(list_transform(flatten(list_transform({ps}, lambda p: p.leaves)), lambda h: h[1:{LEAF_DIGITS}]), ' ')"
    )


def _likeness_sql(x: str, y: str, a: str, b: str) -> str:
    return f"CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN len(list_distinct({a} || {b})) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct({a} || {b})) END"


_LEAVES = "list_filter(string_split(string_split({}, '|')[4], ' '), lambda h: h <> '" + EMPTY_LEAF + "')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt, length(text) // 3 AS k FROM d),
e AS (SELECT *, left(text, length(text) - k) || left(nxt, k) AS edited FROM n),
t AS (SELECT *, {_tree_sql("text")} AS t1, {_tree_sql("edited")} AS t2, {_tree_sql("nxt")} AS t3 FROM e),
f AS (SELECT *, {_fp_sql("t1")} AS f1, {_fp_sql("t2")} AS f2, {_fp_sql("t3")} AS f3 FROM t),
l AS (SELECT *, {_LEAVES.format("f1")} AS a, {_LEAVES.format("f2")} AS b, {_LEAVES.format("f3")} AS c,
             string_split(string_split(f1, '|')[3], ' ') AS p1, string_split(string_split(f2, '|')[3], ' ') AS p2 FROM f)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, f1 AS fingerprint, f2 AS edited_fingerprint,
       {_likeness_sql("text", "edited", "a", "b")} AS near_edited, {_likeness_sql("text", "nxt", "a", "c")} AS near_next,
       CASE WHEN text = edited THEN 0 ELSE len(list_filter(p2, lambda h: NOT list_contains(p1, h))) END::BIGINT AS changed_paragraphs
FROM l
"""
