"""Queries of tool calls in all dialects and of chat templates, and the SQL that writes them by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import templates, toolcalls
from weftline.operators.batch import spread
from weftline.plans.base import query, table
from weftline.plans.prepared import chats

_NAMES = list(toolcalls.DIALECTS)
_DIALECT = f"CASE event_id % {len(_NAMES)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
_ARGS = """'{"user": ' || user_id || ', "note": "a b ' || event_type || '", "more": {"list": [' || event_id || ', true], "none": null}}'"""
_MORE = """'{"list": [' || event_id || ', true], "none": null}'"""
_OBJECT = "'{\"name\": \"' || event_type || '\", \"arguments\": ' || a || '}'"
# what each dialect's text is, of one call to event_type with the arguments a: user, note, more
_TEXT = {
    "default": "'Action: ' || event_type || chr(10) || 'Action Input: ' || a",
    "glm4": "event_type || chr(10) || a",
    "llama3": "replace({o}, '\"arguments\"', '\"parameters\"')",
    "mistral": "'[' || {o} || ']'",
    "minimax1": "'<tool_calls>' || chr(10) || {o} || chr(10) || '</tool_calls>'",
    **{n: "'<tool_call>' || chr(10) || {o} || chr(10) || '</tool_call>'" for n in ("qwen", "ling", "hermes")},
    "qwen3_5": "'<tool_call>' || chr(10) || '<function=' || event_type || '>' || {q} || chr(10) || '</function>' || chr(10) || '</tool_call>'",
    "seed": "chr(10) || '<seed:tool_call>' || chr(10) || '<function=' || event_type || {s} || chr(10) || '</function>' || chr(10) || '</seed:tool_call>'",
    "minimax2": "'<minimax:tool_call>' || chr(10) || '<invoke name=\"' || event_type || '\">' || {m} || chr(10) || '</invoke>' || chr(10) || '</minimax:tool_call>'",
    "glm4_moe": "chr(10) || '<tool_call>' || event_type || {g}",
    "lfm2": "'<|tool_call_start|>[' || event_type || '(user=' || user_id || ', note=\"a b ' || event_type || '\", more=' || {x} || ')]<|tool_call_end|>'",
    "gpt_oss": "'<|start|>assistant<|channel|>commentary to=functions.' || event_type || ' <|constrain|>json<|message|>' || a || '<|call|>'",
}
_VALUES = {"user": "user_id", "note": "'a b ' || event_type", "more": _MORE}
_PARTS = {
    "o": _OBJECT, "x": _MORE,
    "q": " || ".join(f"chr(10) || '<parameter={k}>' || chr(10) || {v} || chr(10) || '</parameter>'" for k, v in _VALUES.items()),
    "s": " || ".join(f"chr(10) || '<parameter={k}>' || {v} || '</parameter>'" for k, v in _VALUES.items()),
    "m": " || ".join(f"chr(10) || '<parameter name=\"{k}\">' || {v} || '</parameter>'" for k, v in _VALUES.items()),
    "g": " || ".join(f"chr(10) || '<arg_key>{k}</arg_key>' || chr(10) || '<arg_value>' || {v} || '</arg_value>'" for k, v in _VALUES.items()),
}
_SQL_TEXT = "CASE dialect " + " ".join("WHEN '{}' THEN {}".format(n, t.format(**_PARTS)) for n, t in _TEXT.items()) + " END"


@query(f"WITH e AS (SELECT event_id, user_id, event_type, {_DIALECT} AS dialect, {_ARGS} AS a FROM events) SELECT event_id, dialect, {_SQL_TEXT} AS text, event_type AS name, a AS arguments FROM e")
def tool_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a call, written in a dialect and read back."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_DIALECT).alias("dialect"), F.expr(_ARGS).alias("a"))
    calls = F.array(F.struct(F.col("event_type").alias("name"), F.col("a").alias("arguments")))
    text = e.select("event_id", "dialect", toolcalls.formatted(calls, F.col("dialect")).alias("text"))
    return text.withColumn("c", toolcalls.extracted(F.col("text"), F.col("dialect"))).select("event_id", "dialect", "text", F.col("c")[0]["name"].alias("name"), F.col("c")[0]["arguments"].alias("arguments"))


@query("SELECT conv_id, turn, 'before ' || text || ' after' AS rest, 2 AS n, '{\"n\": ' || length(text) || '}' AS first FROM conversations WHERE role = 'assistant'")
def agent_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with two calls around their text and one that can't be read: the text stays, with what stands around it."""
    call = F.concat(F.lit('<tool_call>{"name": "count", "arguments": {"n": '), F.length("text").cast("string"), F.lit("}}</tool_call>"))
    reply = F.concat(F.lit("before "), call, F.col("text"), F.lit("<tool_call>{broken</tool_call>"), call, F.lit(" after"))
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", toolcalls.agent_turn(reply, "hermes").alias("r"))
    return turns.select("conv_id", "turn", "r.rest", F.size("r.calls").alias("n"), F.col("r.calls")[0]["arguments"].alias("first"))


def _sql_template(row: tuple) -> str:
    """A template's parts as texts, with the marks of begin and end of the sequence."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    texts = ["".join({"bos": "<s>", "eos": "</s>"}.get(k, v) for k, v in part) for part in row[1:5]]
    merged_system = "".join(v for k, v in row[4] if k == "text")
    return "(" + ", ".join(map(quoted, [row[0], *texts, merged_system, row[6]])) + f", {row[7]})"


_TEMPLATE_SQL = f"""WITH t(name, prefix, usr, assistant, sys, merged_sys, own, merged) AS (VALUES {', '.join(map(_sql_template, templates.rows(templates.TEMPLATES)))}),
c AS (SELECT conv_id, role, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' AS has, first_value(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM conversations),
m AS (SELECT conv_id, role, x, CASE WHEN has THEN i - 1 ELSE i END AS i, CASE WHEN has THEN first ELSE '' END AS s FROM c WHERE NOT (has AND i = 0)),
r AS (SELECT conv_id, name, i, prefix, CASE WHEN s = '' THEN own ELSE s END AS s, sys, merged_sys, merged, x, replace(CASE role WHEN 'user' THEN usr ELSE assistant END, '{{{{idx}}}}', (i // 2)::VARCHAR) AS slot FROM m, t),
w AS (SELECT conv_id, name, i, CASE WHEN i = 0 THEN prefix || CASE WHEN s <> '' AND NOT merged THEN replace(sys, '{{{{content}}}}', s) ELSE '' END ELSE '' END || replace(slot, '{{{{content}}}}', CASE WHEN i = 0 AND merged AND s <> '' THEN replace(merged_sys, '{{{{content}}}}', s) ELSE '' END || x) AS part FROM r)
SELECT conv_id, name AS template, md5(string_agg(part, '' ORDER BY i)) AS digest, sum(length(part))::BIGINT AS n_chars FROM w GROUP BY 1, 2"""


def _with_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with every template, a row each; the templates are a small table of known size."""
    known = templates.table_of(spark)
    names = F.array(*map(F.lit, templates.TEMPLATES))
    t = F.broadcast(known.select("name", F.struct(*known.columns).alias("t")))
    return spread(chats(spark, sf_dir)).withColumn("name", F.explode(names)).join(t, "name").select("conv_id", "name", templates.elements(F.col("turns"), F.col("t")).alias("e"))


@query(_TEMPLATE_SQL)
def chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in all templates."""
    text = _with_templates(spark, sf_dir).where("size(e) > 0").select("conv_id", F.col("name").alias("template"), templates.as_text(F.col("e"), "<s>", "</s>").alias("x"))
    return text.select("conv_id", "template", F.md5("x").alias("digest"), F.length("x").cast("long").alias("n_chars"))


@query()
def chat_template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in all templates as token ids, with the sizes of their prompts and answers."""
    import public_tokenizers

    e = templates.with_ids(_with_templates(spark, sf_dir), "e", public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>", "<|endoftext|>")
    pairs = templates.turn_pairs(F.col("ids"))
    sizes = F.aggregate(pairs, F.lit(0), lambda s, p: s + p["stop"] - p["middle"])
    return e.select("conv_id", F.col("name").alias("template"), F.size("ids.ids").alias("n_ids"), F.size(pairs).alias("n_pairs"), sizes.alias("n_answer_ids"))
