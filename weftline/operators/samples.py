"""Rows of training and evaluation sets in the forms that trainers read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tag of searched sources, and the task that rows without one have.
SEARCH_TAG = "searchR1_"
TASK = "general ask-for-assistance task"


def first_filled(df: DataFrame, *names: str) -> Column:
    """The first of the columns that is there and neither null nor empty, else an empty text."""
    found = [F.when(F.col(c) != "", F.col(c)) for c in names if c in df.columns]
    return F.coalesce(*found, F.lit(""))


def collapsed(df: DataFrame, system: str, source: str, agent: str, index: Column) -> DataFrame:
    """Rows of one prompt (an array of role and content) in the form of reinforcement learning: the system message comes
    first, the truth is the first filled of three columns, and all other columns move into ``extra_info``."""
    for c in ("prompt", "single_turn_prompt"):
        if c not in df.columns:
            raise ValueError(f"missing column {c}")
    truth = first_filled(df, "ground_truth", "single_turn_completion", "completion")
    prompt = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), F.transform("prompt", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    task = F.coalesce(F.col("task_desc"), F.lit(TASK)) if "task_desc" in df.columns else F.lit(TASK)
    rest = [c for c in df.columns if c not in ("prompt", "ground_truth", "extra_info", "single_turn_prompt", "task_desc")]
    kwargs = F.struct(F.lit(source).alias("name"), F.col("single_turn_prompt"), task.alias("task_desc"))
    return df.select(
        prompt.alias("prompt"), truth.alias("ground_truth"), prompt.alias("raw_prompt"), F.struct(*rest, prompt.alias("prompt"), kwargs.alias("interaction_kwargs")).alias("extra_info"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.lit(source).alias("data_source"), F.lit(agent).alias("agent_name"), index.alias("index"),
    )


def evaluation_samples(df: DataFrame, index: Column) -> DataFrame:
    """example_id, prompt and answer, trimmed, of either layout: flat (problem, answer), or nested (a prompt's first
    message, the truth of ``reward_model``)."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    flat = "problem" in df.columns
    prompt = F.col("problem") if flat else F.col("prompt")[0]["content"]
    answer = F.col("answer") if flat else F.col("reward_model.ground_truth")
    return df.select(index.alias("example_id"), trim(prompt).alias("prompt"), trim(answer).alias("answer"))


def search_sample(question: Column, truth: Column, source: Column, split: str, index: Column, system: str, prefix: str) -> list[Column]:
    """The columns of a question that is answered by searching: tagged source, prompt, and what the search tool gets."""
    tagged = F.concat(F.lit(SEARCH_TAG), F.coalesce(source, F.lit("")))
    q = F.coalesce(question, F.lit(""))
    prompt = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.lit(prefix.rstrip("\n")), q).alias("content")))
    tools = F.struct(F.struct(F.struct(truth.alias("ground_truth"), q.alias("question"), tagged.alias("data_source")).alias("create_kwargs")).alias("search"))
    extra = F.struct(index.alias("index"), F.lit(True).alias("need_tools_kwargs"), q.alias("question"), F.lit(split).alias("split"), tools.alias("tools_kwargs"))
    return [tagged.alias("data_source"), prompt.alias("prompt"), F.struct(truth.alias("ground_truth")).alias("reward_model"), extra.alias("extra_info")]


def with_aliases(nodes: Column) -> Column:
    """Graph nodes (maps of text) with ``id`` and ``type`` beside ``node_id`` and ``node_type``, unless they are there."""

    def named(n: Column) -> Column:
        for old, new in (("node_id", "id"), ("node_type", "type")):
            there = F.map_contains_key(n, old) & ~F.map_contains_key(n, new)
            n = F.when(there, F.map_concat(n, F.create_map(F.lit(new), F.element_at(n, old)))).otherwise(n)
        return n

    return F.transform(nodes, named)


def prompt_ids(ids: Column, cutoff: int, eos: int | None = None) -> Column:
    """The ids of an unlabelled text up to the cutoff; an end mark, if one is asked for, takes the last place."""
    if eos is None:
        return F.slice(ids, 1, cutoff)
    return F.concat(F.slice(ids, 1, cutoff - 1), F.array(F.lit(eos)))


def segment_mask(segments: Column) -> Column:
    """Who sees whom in a packed sequence: place j is seen from i if it is not later and of the same segment; segment 0
    is padding and sees nothing. Rows of 0 and 1."""
    n = F.size(segments)
    at = lambda i: F.get(segments, i)
    places = F.sequence(F.lit(0), n - 1)
    row = lambda i: F.transform(places, lambda j: ((j <= i) & (at(i) == at(j)) & (at(i) != 0)).cast("int"))
    return F.when(n > 0, F.transform(places, row)).otherwise(F.array().cast("array<array<int>>"))


def flattened_pairs(df: DataFrame, key: str, chosen: str, rejected: str) -> DataFrame:
    """Chosen answers first, then rejected ones, each in the order of the key: the batch of a pairwise loss."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col(chosen).alias("answer")), F.struct(F.lit(1).alias("part"), F.col(rejected).alias("answer"))))
    return df.select(key, both.alias("x")).select(F.col("x.part").alias("part"), key, F.col("x.answer").alias("answer"))


def best_and_worst(df: DataFrame, prompt: str, score: str, key: list[str]) -> DataFrame:
    """Per prompt the rows of the best and of the worst score, the first by ``key`` of equals, as structs; prompts whose
    best is not better than their worst have no pair."""
    row = F.struct(*df.columns)
    up, down = F.struct(F.col(score), *(-F.col(c) for c in key)), F.struct(-F.col(score), *(-F.col(c) for c in key))
    pairs = df.groupBy(prompt).agg(F.max_by(row, up).alias("chosen"), F.max_by(row, down).alias("rejected"))
    return pairs.where(F.col(f"chosen.{score}") > F.col(f"rejected.{score}"))


def preference_loss(chosen: Column, rejected: Column, chosen_reference: Column, rejected_reference: Column, beta: float) -> Column:
    """-log sigmoid of beta times what the policy prefers the chosen answer more than the reference does."""
    x = beta * ((chosen - rejected) - (chosen_reference - rejected_reference))
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
