"""Row-wise repetition flags and the cascade that rejects generated or crawled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.binding import let


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _occurs(values: Column, times: int) -> Column:
    """Whether an array holds a value ``times`` times: sorted, some value equals the one ``times`` - 1 places on."""

    def test(a: Column) -> Column:
        n = F.greatest(F.size(a) - (times - 1), F.lit(0))
        return F.exists(F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(times), n), lambda x, y: x == y), lambda same: same)

    return let(F.sort_array(values), test)


def repeated_lines(text: Column, min_length: int = 20, times: int = 5) -> Column:
    """Whether a stripped line of ``min_length`` characters or more occurs ``times`` times."""
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: F.length(x) >= min_length)
    return _occurs(lines, times)


def repeated_windows(text: Column, length: int = 100, stride: int = 10, times: int = 3) -> Column:
    """Whether one of the windows of ``length`` characters at every ``stride`` occurs ``times`` times.

    The text is cut into pieces of one stride first, so a row costs its length, not its square.
    """
    per = length // stride
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(.{{{stride}}})"), F.lit(1))

    def windows(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(p) - (per - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(p, i, F.lit(per)), "")))

    return (F.length(text) >= length * times) & _occurs(let(pieces, windows), times)


def consecutive_blocks(text: Column, block: int = 50, times: int = 3) -> Column:
    """Whether any ``block`` characters stand ``times`` times in a row."""
    return text.rlike(f"(?s)(.{{{block}}})" + r"\1" * (times - 1))


def reject_reason(text: Column, marker: str | None = None, long_text: int = 5000) -> Column:
    """The first reason against a text, or 'ok'. Only texts over ``long_text`` are tested for consecutive blocks.

    The tests stand in one CASE, so the costly ones run only where the cheap ones passed.
    """
    reason = F.when(text.isNull(), "empty")
    if marker is not None:
        reason = reason.when(~F.contains(text, F.lit(marker)), "no_marker")
    reason = reason.when(repeated_lines(text), "repeated_lines").when(repeated_windows(text), "ngram_repetition")
    return reason.when((F.length(text) > long_text) & consecutive_blocks(text), "consecutive_repeat").otherwise("ok")


def corpus_report(docs: DataFrame, labels: DataFrame, reason: Column) -> DataFrame:
    """Per source and in all: rows, kept rows, their share, mean length, share of labelled rows that are good."""
    flagged = docs.select("doc_id", "source", "n_chars", reason.alias("reason")).join(labels.select("doc_id", "quality"), "doc_id", "left")
    return flagged.rollup("source").agg(
        F.coalesce(F.col("source"), F.lit("ALL")).alias("source_name"),
        F.count("*").alias("n_rows"),
        F.count_if(F.col("reason") == "ok").alias("n_kept"),
        F.round(F.avg(F.when(F.col("reason") == "ok", 1.0).otherwise(0.0)), 6).alias("kept_rate"),
        F.round(F.avg("n_chars"), 6).alias("mean_chars"),
        F.round(F.avg(F.col("quality").cast("double")), 6).alias("good_rate"),
    ).drop("source")
