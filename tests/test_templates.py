"""Chat templates as rows against plain loops, as text and as token ids."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import templates

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

TALKS = [
    (0, [("system", "be brief"), ("user", "hi {{content}} {{idx}}"), ("assistant", "yes"), ("user", None), ("assistant", "no <|endoftext|> é")]),
    (1, [("user", "one"), ("assistant", "two"), ("tool", '"r"'), ("assistant", "three"), ("user", "four")]),
    (2, []),
    (3, [("user", "a"), ("critic", "b")]),
    (4, [("system", "only")]),
    (5, [("assistant", "first"), ("user", "then")]),
    (6, None),
    (7, [("user", "a"), ("system", "late")]),
]


def brute(turns, row):
    """Elements per turn, by a plain loop over messages."""
    name, prefix, user, assistant, system, observation, own, merged = row
    said = ""
    if turns and turns[0][0] == "system":
        said, turns = turns[0][1] or "", turns[1:]
    said = said or own
    slots = {"user": user, "assistant": assistant, "tool": observation}

    def fill(part, content, i):
        out = []
        for kind, value in part:
            if kind == "text":
                before, mark, after = value.partition("{{content}}")
                value = before.replace("{{idx}}", str(i // 2)) + (content if mark else "") + after.replace("{{idx}}", str(i // 2))
            out.append((kind, value))
        return out

    out = []
    for i, (role, content) in enumerate(turns):
        if role not in slots:
            return None
        content, front = content or "", []
        if i == 0:
            front = fill(prefix, "", 0)
            if said and merged and role == "user":
                content = "".join(v for k, v in fill(system, said, 0) if k == "text") + content
            elif said:
                front += fill(system, said, 0)
        out.append(front + fill(slots[role], content, i))
    return out


@pytest.fixture(scope="module")
def talks(spark):
    df = spark.createDataFrame([(i, None if t is None else [{"role": r, "content": c} for r, c in t]) for i, t in TALKS], "id long, turns array<struct<role:string,content:string>>")
    known = templates.table_of(spark)
    t = known.select("name", F.struct(*known.columns).alias("t"))
    return df.crossJoin(t).select("id", "name", templates.elements(F.col("turns"), F.col("t")).alias("e"))


def test_texts_of_all_templates(talks):
    rows = {r[0]: r for r in templates.rows(templates.TEMPLATES)}
    got = talks.select("id", "name", templates.as_text(F.col("e"), "<B>", "<E>").alias("x")).collect()
    assert len(got) == len(TALKS) * len(rows)
    turns = dict(TALKS)
    for r in got:
        want = None if turns[r.id] is None else brute(turns[r.id], rows[r.name])
        assert r.x == (None if want is None else "".join({"bos": "<B>", "eos": "<E>"}.get(k, v) for part in want for k, v in part)), (r.id, r.name)
    by = {(r.id, r.name): r.x for r in got}
    assert by[0, "llama2"] == "<B>[INST] <<SYS>>\nbe brief\n<</SYS>>\n\nhi {{content}} {{idx}} [/INST]yes<E><B>[INST]  [/INST]no <|endoftext|> é<E>"
    assert by[0, "chatglm2"].startswith("[gMASK]sopbe brief[Round 0]\n\n问：hi {{content}} {{idx}}\n\n答：yes[Round 1]")
    assert by[1, "chatml"].endswith('two<|im_end|>\n<|im_start|>tool\n"r"<|im_end|>\n<|im_start|>assistant\nthree<|im_end|>\n<|im_start|>user\nfour<|im_end|>\n<|im_start|>assistant\n')
    assert by[2, "llama3"] == by[4, "llama3"] == "" and by[3, "llama3"] is None and by[7, "llama3"] is None and by[6, "llama3"] is None


def test_ids_share_their_prefixes(talks):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rows = {r[0]: r for r in templates.rows(templates.TEMPLATES)}
    e = templates.with_ids(talks, "e", PATH, "<|endoftext|>", None, "x")
    got = e.select("id", "name", "x.*", templates.one_turn(F.col("x")).alias("one"), templates.turn_pairs(F.col("x")).alias("pairs")).collect()
    turns = dict(TALKS)
    for r in got:
        want = None if turns[r.id] is None else brute(turns[r.id], rows[r.name])
        if want is None:
            assert r.ids is None and r.ends is None
            continue
        each = []
        for part in want:
            ids = []
            for kind, value in part:
                if kind == "bos":
                    ids.append(tokenizer.token_to_id("<|endoftext|>"))
                elif kind == "token" and tokenizer.token_to_id(value) is not None:
                    ids.append(tokenizer.token_to_id(value))
                elif kind != "eos" and value:
                    ids += tokenizer.encode(value, add_special_tokens=False).ids
            each.append(ids)
        assert r.ids == sum(each, []) and r.ends == [sum(map(len, each[: k + 1])) for k in range(len(each))], (r.id, r.name)
        assert r.one.prompt == sum(each[:-1], []) and r.one.response == (each[-1] if each else [])
        assert [(r.ids[p.start : p.middle], r.ids[p.middle : p.stop]) for p in r.pairs] == [(each[k], each[k + 1]) for k in range(0, len(each) - 1, 2)]


def test_templates_are_checked_and_come_from_files(spark, tmp_path):
    for wrong in ({"user": ["no place"]}, {"prefix": ["{{content}}"]}, {"user": [("odd", "x"), "{{content}}"]}, {"users": ["{{content}}"]}):
        with pytest.raises(ValueError, match="own"):
            templates.rows({"own": wrong})
    slot = lambda k, v: {"kind": k, "value": v}
    row = {"name": "file", "prefix": [slot("bos", "")], "user": [slot("text", "U{{idx}}:{{content}};")], "assistant": [slot("text", "A:{{content}};")], "system": [slot("text", "S:{{content}};")], "observation": [slot("text", "O:{{content}};")], "default_system": "be good", "merged": False}
    (tmp_path / "t.json").write_text(json.dumps(row) + "\n")
    t = spark.read.schema(templates.SCHEMA).json(str(tmp_path / "t.json"))
    talk = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "x"), ("assistant", "y"), ("user", "z"))))
    out = t.select(templates.as_text(templates.elements(talk, F.struct(*t.columns)), "<s>", "</s>").alias("x")).first().x
    assert out == "<s>S:be good;U0:x;A:y;U1:z;"


def test_ids_of_texts_are_kept_and_conversations_dealt_over_tasks(spark):
    import public_tokenizers

    from weftline.plans import dialects

    path = public_tokenizers.path("byte_bpe_50k.json")
    hits = templates._short_ids.cache_info().hits
    assert list(templates._short_ids(path, "some text")) == list(templates._short_ids(path, "some text")) == templates._tokenizer(path).encode("some text", add_special_tokens=False).ids
    assert templates._short_ids.cache_info().hits > hits
    assert "RoundRobinPartitioning" in dialects.chat_template_tokens(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
