"""Voice blocks against a plain walk over parsed marks, and JSON checks against a recursive one."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import blocks, markup, schema


def clean(text, lines=False):
    text = re.sub(r"\r\n?", "\n", re.sub(blocks.LITERAL, "", re.sub(blocks.COMMENT, "", text)))
    if lines:
        return "\n".join(x for x in (re.sub(r"[ \t]+", " ", s).strip() for s in text.split("\n")) if x)
    return re.sub(r"\s+", " ", text).strip()


def brute(source):
    """(blocks, problems) of one text, node after node."""
    out, problems, held, first = [], [], "", 1

    def spoken(own, text, line, role):
        mode, current, found = "narration", "", []
        for c in clean(text):
            if c in "“”":
                if (c == "“") == (mode == "dialogue"):
                    return problems.append((line, "nested" if c == "“" else "not open"))
                found.append((mode, clean(current)))
                mode, current = ("dialogue", "") if c == "“" else ("narration", "")
            else:
                current += c
        if mode == "dialogue":
            return problems.append((line, "not closed"))
        own += [(kind, role, line, text) for kind, text in [*found, (mode, clean(current))] if text]

    def flush():
        nonlocal held
        spoken(out, held, first, "prose")
        held = ""

    def add(text, line):
        nonlocal held, first
        first = line if not held else first
        held += text

    parsed = markup.parse(source)
    for node, _, depth, _, type_, kind, value, _, line, _, _ in parsed:
        if depth or type_ in ("image", "error"):
            continue
        under = [n for n in parsed if n[0] > node and n[2] > 0 and not any(m[2] == 0 and node < m[0] < n[0] for m in parsed)]
        seen = lambda brk, under=under: "".join(n[6] if n[4] == "text" else brk for n in under if n[4] in ("text", "hard-break") and not {"zp", "mp", "zpsc", "wz"} & set(n[3]))
        if type_ == "text":
            for k, piece in enumerate(value.split("\n")):
                if k:
                    flush()
                add(piece, line + k)
        elif type_ == "hard-break":
            add(" ", line)
        elif kind in ("sc", "fu"):
            flush()
            text = clean(seen("\n"), lines=True)
            if text:
                out.append(("poetry", kind, min([n[8] for n in under if n[4] == "text" and n[6] and not {"zp", "mp", "zpsc", "wz"} & set(n[3])], default=line), text))
        elif kind == "T":
            flush()
            spoken(out, seen(" "), min([n[8] for n in under if n[4] == "text"], default=line), "title")
        elif kind not in ("zp", "mp", "zpsc", "wz"):
            add(seen(" "), line)
    flush()
    return out, problems


SOURCES = [
    "[T]第八十一回\n旁白甲[zp]脂批[-]道：“人物说话。”旁白乙。\n[sc]诗句一\n诗句二[-]\n[fu]赋正文[-]",
    "[T]测试\n旁白：“没有闭合。",
    "甲“乙“丙”丁", "甲”乙", "“一”“二”\n\n 空 \n【批】“三”", "", "\n\n", "[sc]独诗[zp]批[-]一 \t 句\n\n末[-]后文[wz]注“[-]“话”",
    "前\\\n后“说\\\n完”[img:a.png]末", "【只有批】", "[sc]甲[-][sc]乙[-]\n[fu][-]丙",
]


def check(spark, sources):
    docs = spark.createDataFrame(list(enumerate(sources)), "source_id int, body string").repartition(3)
    rows = blocks.paragraphs(markup.nodes(docs), "source_id").cache()
    got, bad = {}, {}
    for r in blocks.voice_blocks(rows, "source_id").orderBy("source_id", "order").collect():
        got.setdefault(r["source_id"], []).append((r["kind"], r["role"], r["line"], r["text"]))
        assert r["order"] == len(got[r["source_id"]]) and r["text_hash"] == hashlib.sha256(r["text"].encode()).hexdigest()
    for r in blocks.quote_problems(rows, "source_id").collect():
        bad.setdefault(r["source_id"], []).append((r["line"], r["problem"]))
    for i, source in enumerate(sources):
        want, problems = brute(source)
        assert sorted(bad.get(i, [])) == sorted(problems), source
        assert got.get(i, []) == ([] if problems else want), source
    return got, bad


def test_blocks_are_those_of_a_walk_over_the_marks(spark):
    got, bad = check(spark, SOURCES)
    assert [b[0] for b in got[0]] == ["narration", "narration", "dialogue", "narration", "poetry", "poetry"] and got[0][0][1] == "title"
    assert got[0][4][3] == "诗句一\n诗句二" and bad[1] == [(2, "not closed")] and bad[2] == [(1, "nested")] and bad[3] == [(1, "not open")]


def test_blocks_of_random_texts(spark):
    rng = random.Random(12)
    parts = ["甲", "乙 丙", "“话”", "“", "”", "\n", "[zp]批[-]", "[sc]诗\n句[-]", "[fu]赋[-]", "[wz]注[-]", "[mp]“[-]", "\\\n", "【评】", " ", "[T]题“引”\n"]
    check(spark, ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(150)])


def test_contexts_name_both_sides(spark):
    one = spark.createDataFrame([(1, "甲\n乙\n丙"), (2, "甲\n乙\n丁"), (3, "乙")], "source_id int, body string")
    rows = {(r["source_id"], r["order"]): r for r in blocks.voice_blocks(blocks.paragraphs(markup.nodes(one), "source_id"), "source_id").collect()}
    assert rows[1, 1]["context_hash"] == rows[2, 1]["context_hash"] and rows[1, 2]["context_hash"] != rows[2, 2]["context_hash"] != rows[3, 1]["context_hash"]


# ---- JSON checks

RULES = {
    "type": "object", "required": ["id", "tags"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 4}},
        "state": {"enum": ["on", "off", None, 3, True]}, "inner": {"type": ["object", "null"], "properties": {"x": {"type": "number", "maximum": 2.5}}, "additionalProperties": {"type": "string", "minLength": 2}},
        "fixed": {"const": "v1"},
    },
}


def brute_problems(v, rules, path="$"):
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    is_ = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "integer": number and v == int(v), "number": number}
    out = []
    wanted = rules.get("type")
    if wanted and not any(is_[t] for t in ([wanted] if isinstance(wanted, str) else wanted)):
        out.append((path, "type"))
    same = lambda a: type(a) is type(v) and a == v or number and not isinstance(a, bool) and isinstance(a, (int, float)) and a == v
    out += [(path, "enum")] * ("enum" in rules and not any(map(same, rules["enum"]))) + [(path, "const")] * ("const" in rules and not same(rules["const"]))
    if is_["string"]:
        out += [(path, "minLength")] * (len(v) < rules.get("minLength", 0)) + [(path, "maxLength")] * (len(v) > rules.get("maxLength", 99)) + [(path, "pattern")] * (not re.search(rules.get("pattern", ""), v))
    if number:
        out += [(path, "minimum")] * (v < rules.get("minimum", v)) + [(path, "maximum")] * (v > rules.get("maximum", v))
    if is_["array"]:
        out += [(path, "minItems")] * (len(v) < rules.get("minItems", 0)) + [(path, "maxItems")] * (len(v) > rules.get("maxItems", 99))
        out += [(path, "uniqueItems")] * (rules.get("uniqueItems", False) and len({json.dumps(x) for x in v}) < len(v))
        for i, x in enumerate(v):
            out += brute_problems(x, rules.get("items", {}), f"{path}[{i}]")
    if is_["object"]:
        known = rules.get("properties", {})
        out += [(f"{path}.{k}", "required") for k in rules.get("required", []) if k not in v]
        for k, x in v.items():
            extra = rules.get("additionalProperties", True)
            out += brute_problems(x, known[k], f"{path}.{k}") if k in known else [(f"{path}.{k}", "additionalProperties")] if extra is False else brute_problems(x, extra, f"{path}.{k}") if extra is not True else []
    return out


def some_document(rng):
    values = [0, 1, 7, -3, 2.25, 2.75, "ab", "abcde", "A", "", "on", "v1", None, True, False, [], ["ab"], ["ab", "ab"], ["a", 3, "B", "c"], {}, {"x": 2}, {"x": 3, "y": "q"}, {"z": "long"}]
    return {k: rng.choice(values) for k in ("id", "tags", "state", "inner", "fixed", "other") if rng.random() < 0.7}


def test_checks_agree_with_a_recursive_one(spark):
    rng = random.Random(9)
    docs = [some_document(rng) for _ in range(300)] + [[], 3, "x", None, True, {"id": 7, "tags": ["ab", "c"], "state": None, "inner": {"x": 2.5, "y": "long"}, "fixed": "v1"}]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, doc string").repartition(3)
    got = {r["id"]: sorted(map(tuple, r["problems"])) for r in schema.checked(frame, "doc", RULES).collect()}
    for i, d in enumerate(docs):
        assert got[i] == sorted(brute_problems(d, RULES)), d
    assert sum(not p for p in got.values()) >= 1


def test_import_keeps_what_is_corrupt(spark):
    good, rows = '{"id": 2, "tags": ["ab"], "state": "on"}', []
    rows = [(1, good), (2, '{"id": 2, "tags"'), (3, None), (4, ""), (5, '{"id": 0, "tags": ["ab"]}'), (6, good + " junk"), (7, good + "],[" + good), (8, good + '},{"v":' + good), (9, f" {good}\n")]
    sound, kept = schema.imported(spark.createDataFrame(rows, "line long, doc string"), "doc", RULES, "id long, tags array<string>, state string")
    assert [tuple(r) for r in sound.select("line", "id", "tags", "state").collect()] == [(1, 2, ["ab"], "on"), (9, 2, ["ab"], "on")]
    problems = {(r["line"], r["path"], r["problem"]) for r in schema.problem_rows(kept, ["line"]).collect()}
    assert problems == {(2, "$", "json"), (3, "$", "missing"), (4, "$", "json"), (5, "$.id", "minimum"), *((k, "$", "json") for k in (6, 7, 8))}
    assert kept.filter(F.col("line") == 2).first()["doc"] == '{"id": 2, "tags"' and sound.count() + kept.count() == len(rows)


def test_schema_errors_show_when_it_is_compiled(spark):
    with pytest.raises(ValueError):
        schema.problems(F.lit(None), {"type": "object", "oneOf": []})
    with pytest.raises(ValueError):
        schema.problems(F.lit(None), {"properties": {'a"b': {}}})


def test_checks_run_without_python_or_shuffle(spark):
    plan = schema.checked(spark.range(3).selectExpr("id", "'{}' AS doc"), "doc", RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_a_text_is_parsed_once_for_all_rules(spark):
    docs = spark.createDataFrame([(1, '{"k": 3}')], "id long, d string")
    plan = schema.problem_rows(schema.checked(docs, "d", {"required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 89}}}), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2  # as an item, and once more as a member to see that nothing follows


def test_a_text_without_marks_is_parsed_in_a_step(monkeypatch):
    """The parser goes from mark to mark, not from character to character."""
    calls, pattern = [0], markup.TOKEN

    class Counted:
        def __getattr__(self, name):
            calls[0] += 1
            return getattr(pattern, name)

    monkeypatch.setattr(markup, "TOKEN", Counted())
    text = "[T]a [T]b\n" + "word\n" * 2000 + "[zp]note\n\\[x[-]" + "end"
    got = markup.parse(text)
    assert [n[4:8] for n in got if n[4] == "mark"] == [("mark", "T", None, 0), ("mark", "T", None, 5), ("mark", "zp", None, 10010)]
    assert [n[6] for n in got if n[4] == "text"] == ["a ", "b", "\n" + "word", "\n" + "word\n" * 1999, "note\n[x", "end"]
    assert calls[0] < 10


def test_voice_blocks_parse_each_text_once(spark):
    docs = spark.createDataFrame([("a", "one (two) three\n[sc]verse (\nmore[-]"), ("b", "bad ( one"), (None, "bad ( too"), ("c", "(x)(y)")], "source_id string, body string")
    got = blocks.voice_blocks(blocks.paragraphs(markup.nodes(docs), "source_id"), "source_id", ("(", ")"))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    rows = sorted((str(r["source_id"]), r["order"], r["kind"], r["text"]) for r in got.collect())
    assert rows == [
        ("None", 1, "narration", "bad"), ("None", 2, "dialogue", "too"), ("a", 1, "narration", "one"), ("a", 2, "dialogue", "two"), ("a", 3, "narration", "three"),
        ("a", 4, "poetry", "verse (\nmore"), ("c", 1, "dialogue", "x"), ("c", 2, "dialogue", "y"),
    ]
