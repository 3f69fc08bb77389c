"""Supervised and preference data: alignment of formats, turn checks, truncation, masking, packing, chunks."""

from __future__ import annotations

from bisect import bisect_right
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.batch import before_within

IGNORE = -100


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def align_alpaca(instruction: Column, query: Column | None, response: Column | None, system: Column | None = None, history: Column | None = None) -> tuple[Column, Column, Column]:
    """(prompt messages, response messages, system): instruction and input joined by a line break, history before."""
    blank = lambda c: F.when(c != "", c)
    asked = F.concat_ws("\n", *(blank(c) for c in (instruction, query) if c is not None))
    prompt = F.array(message("user", asked))
    if history is not None:
        turns = F.flatten(F.transform(history, lambda h: F.array(message("user", h[0]), message("assistant", h[1]))))
        prompt = F.concat(F.coalesce(turns, F.array().cast("array<struct<role:string,content:string>>")), prompt)
    none = F.array().cast("array<struct<role:string,content:string>>")
    answer = F.when(response.isNotNull(), F.array(message("assistant", response))).otherwise(none) if response is not None else none
    return prompt, answer, F.coalesce(system, F.lit("")) if system is not None else F.lit("")


def align_pair(chosen: Column, rejected: Column) -> Column:
    return F.array(message("assistant", chosen), message("assistant", rejected))


def align_tagged(response: Column, good: Column) -> Column:
    """Two responses, the wanted one first; the other is empty."""
    empty = message("assistant", F.lit(""))
    return F.when(good, F.array(message("assistant", response), empty)).otherwise(F.array(empty, message("assistant", response)))


def align_chat(turns: Column) -> tuple[Column, Column, Column]:
    """(system, prompt, response) of messages (role, content): a leading system turn is taken out, the last is the
    response."""
    lead = F.when(F.size(turns) > 0, F.element_at(turns, 1)["role"] == "system").otherwise(F.lit(False))
    rest = F.when(lead, F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)
    system = F.when(lead, F.element_at(turns, 1)["content"]).otherwise(F.lit(""))
    return system, F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0))), F.slice(rest, F.greatest(F.size(rest), F.lit(1)), F.lit(1))


def valid_turns(roles: Column, ranking: bool = False) -> Column:
    """Whether users (or observations) and assistants (or functions) alternate from a user on, in an even number of
    turns (odd for ranking), one at least."""
    odd = F.array(F.lit("user"), F.lit("observation"))
    even = F.array(F.lit("assistant"), F.lit("function"))
    fits = F.transform(roles, lambda r, i: F.when(i % 2 == 0, F.array_contains(odd, r)).otherwise(F.array_contains(even, r)))
    return (F.size(roles) > 0) & (F.size(roles) % 2 == (1 if ranking else 0)) & F.forall(fits, lambda x: x)


def budgets(source: Column, target: Column, cutoff: int) -> tuple[Column, Column]:
    """Lengths to which a prompt and its answer are cut so that both fit: the shorter of them first keeps its own."""
    most = F.when(target * 2 < cutoff, F.lit(cutoff)).when(source * 2 < cutoff, cutoff - source).otherwise(F.floor(cutoff * target / (source + target)))
    new_target = F.least(most, target)
    return F.least(F.greatest(cutoff - new_target, F.lit(0)), source).cast("int"), new_target.cast("int")


def labelled(source: Column, target: Column, train_on_prompt: bool = False) -> tuple[Column, Column]:
    """(ids, labels) of one turn: labels of the prompt are IGNORE unless it is trained on."""
    hidden = F.transform(source, lambda _: F.lit(IGNORE))
    return F.concat(source, target), F.concat(source if train_on_prompt else hidden, target)


def padded(ids: Column, length: int, pad: int, left: bool = False) -> Column:
    """Exactly ``length`` ids: cut at the end (or the beginning), or filled with ``pad`` there."""
    gap = F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)))
    keep = F.slice(ids, F.greatest(F.size(ids) - length, F.lit(0)) + 1, F.lit(length)) if left else F.slice(ids, F.lit(1), F.lit(length))
    return F.concat(gap, keep) if left else F.concat(keep, gap)


def shifted_pairs(df: DataFrame, batch: str, order: str, response: str) -> DataFrame:
    """Adds ``other``: the response of the row before in its batch; the first row gets the last one's."""
    w = Window.partitionBy(batch).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("other", F.coalesce(F.lag(response).over(w), F.last(response).over(whole)))


def blocks(df: DataFrame, group: str, order: str, length: str, block: int) -> DataFrame:
    """Where each row's tokens lie once a group's rows are joined and cut into blocks: first and last block and the
    offset in the first; blocks beyond the last full one are dropped, so their rows may lose tokens. A row without a
    length has no tokens. A group may hold most of the rows: lengths are summed range by range."""
    own = F.coalesce(F.col(length), F.lit(0)).cast("long")
    placed = before_within(df, group, [order], own, "__begin", total="__total")
    begin, total = F.col("__begin"), F.floor(F.col("__total") / block) * block
    kept = F.greatest(F.least(begin + own, total) - begin, F.lit(0))
    out = placed.withColumn("first_block", F.floor(begin / block)).withColumn("offset", begin % block).withColumn("kept", kept)
    return out.withColumn("last_block", F.when(F.col("kept") > 0, F.floor((begin + F.col("kept") - 1) / block))).drop("__begin", "__total")


def knapsacks(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items (by place) of each knapsack: each takes the largest item that still fits, again and again. Items longer
    than the capacity are left out."""
    items = sorted((n, i) for i, n in enumerate(lengths) if n <= capacity)
    out = []
    while items:
        room, sack = capacity, []
        while items:
            at = bisect_right(items, (room, len(lengths))) - 1
            if at < 0:
                break
            n, i = items.pop(at)
            room -= n
            sack.append(i)
        out.append(sack)
    return out


def pack_greedily(df: DataFrame, batch: str, key: str, length: str, capacity: int) -> DataFrame:
    """key, knapsack and segment (from 1) of the rows of each batch. A batch is packed on its own, so its size is the
    bound on what a task holds. Rows that fit no knapsack (longer than one, or without a length) have nulls there."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        at = {i: (s, k) for s, sack in enumerate(knapsacks(pdf["_n"].tolist(), capacity)) for k, i in enumerate(sack, 1)}
        places = pd.DataFrame([at.get(i, (None, None)) for i in range(len(pdf))], columns=["knapsack", "segment"], dtype="Int64")
        return pd.concat([pdf[[batch, key]], places], axis=1)

    return df.select(batch, key, F.coalesce(F.col(length), F.lit(capacity + 1)).alias("_n")).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {key} {kinds[key]}, knapsack long, segment long")


def workload(length: Column) -> Column:
    """Cost of a sequence: a linear and a quadratic part."""
    return 24576 * length + length * length


def balanced(costs: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """k sets of places with close sums, by differencing: the two states of the largest spread are merged, heaviest
    set with lightest, until one state is left. With ``equal_size`` items enter k at a time, so that sets have one
    number of items; their number must be a multiple of k then."""
    if equal_size and len(costs) % k:
        raise ValueError("items are not a multiple of the sets")
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    groups = [order[a : a + k] for a in range(0, len(order), k)] if equal_size else [[i] for i in order]

    def state(items):
        sets = sorted(([costs[i], [i]] for i in items), key=lambda s: (-s[0], s[1]))
        return sets + [[0, []] for _ in range(k - len(sets))]

    heap = []
    for n, items in enumerate(groups):
        s = state(items)
        heap.append((-(s[0][0] - s[-1][0]), n, s))
    heapify(heap)
    n = len(groups)
    while len(heap) > 1:
        a, b = heappop(heap)[2], heappop(heap)[2]
        merged = sorted(([x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b), strict=True)), key=lambda s: (-s[0], s[1]))
        heappush(heap, (-(merged[0][0] - merged[-1][0]), n, merged))
        n += 1
    return [sorted(s[1]) for s in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy_sets(costs: list[int], k: int) -> list[list[int]]:
    """Each item in turn goes to the lightest set."""
    heap = [(0, i) for i in range(k)]
    out: list[list[int]] = [[] for _ in range(k)]
    for i, c in enumerate(costs):
        total, s = heappop(heap)
        out[s].append(i)
        heappush(heap, (total + c, s))
    return out


def partition_batches(df: DataFrame, batch: str, key: str, cost: str, k: int, method: str = "differencing") -> DataFrame:
    """key and part of the rows of each batch, with close sums of cost."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        costs = pdf[cost].tolist()
        sets = balanced(costs, k) if method == "differencing" else greedy_sets(costs, k)
        part = {i: p for p, s in enumerate(sets) for i in s}
        return pd.DataFrame({batch: pdf[batch], key: pdf[key], "part": [part[i] for i in range(len(pdf))]})

    return df.select(batch, key, cost).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {key} {kinds[key]}, part long")


def micro_batches(df: DataFrame, batch: str, key: str, length: str, most: int) -> DataFrame:
    """key and micro-batch of the rows of each batch: as many as its tokens need at ``most`` a piece, balanced by
    cost."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        n = pdf[length].tolist()
        k = min(len(n), -(-sum(n) // most) or 1)
        part = {i: p for p, s in enumerate(balanced([24576 * x + x * x for x in n], k)) for i in s}
        return pd.DataFrame({batch: pdf[batch], key: pdf[key], "micro_batch": [part[i] for i in range(len(pdf))]})

    return df.select(batch, key, length).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {key} {kinds[key]}, micro_batch long")


def render(turns: Column, begin: str = "<|im_start|>", end: str = "<|im_end|>\n") -> Column:
    """Messages (role, content) as one string."""
    return F.array_join(F.transform(turns, lambda m: F.concat(F.lit(begin), m["role"], F.lit("\n"), m["content"], F.lit(end))), "")


#: Turn formats by name: (prefix, user, assistant, system), with {content}.
TEMPLATES = {
    "chatml": ("", "<|im_start|>user\n{content}<|im_end|>\n<|im_start|>assistant\n", "{content}<|im_end|>\n", "<|im_start|>system\n{content}<|im_end|>\n"),
    "alpaca": ("", "### Instruction:\n{content}\n\n### Response:\n", "{content}\n\n", "{content}\n\n"),
    "default": ("", "Human: {content}\nAssistant:", "{content}\n", "System: {content}\n"),
    "llama3": ("<|begin_of_text|>", "<|start_header_id|>user<|end_header_id|>\n\n{content}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "{content}<|eot_id|>", "<|start_header_id|>system<|end_header_id|>\n\n{content}<|eot_id|>"),
}


def render_template(turns: Column, name: str) -> Column:
    prefix, user, assistant, system = TEMPLATES[name]
    write = lambda t, m: F.concat(F.lit(t.split("{content}")[0]), m["content"], F.lit(t.split("{content}")[1]))
    one = lambda m: F.when(m["role"] == "user", write(user, m)).when(m["role"] == "system", write(system, m)).otherwise(write(assistant, m))
    return F.concat(F.lit(prefix), F.array_join(F.transform(turns, one), ""))


def without_thoughts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")


def tool_calls(text: Column) -> Column:
    """Bodies of <tool_call> blocks as (name, arguments); null if any of them is no JSON object with a name."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    parsed = F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.when(F.forall(parsed, lambda p: p["name"].isNotNull()), parsed)


def first_of(*columns: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def latest_best(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")
