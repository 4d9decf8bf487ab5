"""Scans in blocks and annotations against plain loops over the events."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import annotations, markup, scan


def test_suffix_and_cursor_are_those_of_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in (*range(20), None):
        text, at = "", 0
        for place in sorted(rng.sample(range(400), rng.randrange(0, 120) if doc != 7 else 300)):
            body = rng.choice([None, "", "甲", "ab c", "x" * 30, "😀" * 15])
            rows.append((doc, place, body, at + len(body or "") + 1))
            want[doc, place] = (text[-10:], at if text else 0)
            if body:
                text, at = text + body, at + len(body) + 1
    events = spark.createDataFrame(rows, "doc int, place int, body string, end long")
    for block in (7, 64, 4096):
        got = scan.carried_suffix(events, ["doc"], "place", "body", "end", 10, block).collect()
        assert {(r["doc"], r["place"]): (r["before"], r["cursor"]) for r in got} == want and len(got) == len(rows)
        assert got[0].asDict().keys() == {"doc", "place", "body", "end", "before", "cursor"}


def test_running_sum_is_that_of_a_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for doc in ("a", "b", None):
        total = 0
        for place in rng.sample(range(-50, 500), 200):
            rows.append((doc, place, rng.choice([None, 1, -2, 5])))
        for d, place, v in sorted((r for r in rows if r[0] == doc), key=lambda r: r[1]):
            total += v or 0
            want[d, place] = total
    got = scan.running_sum(spark.createDataFrame(rows, "doc string, place int, v int"), ["doc"], "place", F.col("v"), "sum", 16).collect()
    assert {(r["doc"], r["place"]): r["sum"] for r in got} == want


def test_no_events_give_no_rows(spark):
    none = spark.createDataFrame([], "doc int, place int, body string, end long")
    assert scan.carried_suffix(none, ["doc"], "place", "body", "end", 10).count() == 0 and scan.running_sum(none, ["doc"], "place", none["end"], "s").count() == 0


def loop(text):
    """(offset, anchor, cursor, comment) by walking the parsed nodes as a tree."""
    nodes = markup.parse(text)
    body, cursor, titled, out = "", 0, False, []
    for n, (node, parent, depth, path, type_, kind, value, offset, *_rest) in enumerate(nodes):
        if type_ == "mark" and kind == "T":
            titled = True
        if titled and not {"zp", "mp"} & set(path):
            if type_ == "text":
                body, cursor = body + value, offset + len(value)
            elif type_ == "hard-break":
                body, cursor = body + " ", offset + 2
        if type_ == "mark" and kind == "zp":
            inside = []
            for later in nodes[n + 1 :]:
                if later[2] <= depth or later[4] == "error" and not later[3]:
                    break
                inside.append(later[6] if later[4] == "text" else " " if later[4] == "hard-break" else "")
            comment = " ".join("".join(inside).split())
            for a, b in ("【】", "（）", "[]"):
                if len(comment) > 1 and comment[0] == a and comment[-1] == b:
                    comment = comment[1:-1].strip()
                    break
            out.append((offset, " ".join(body[-90:].split()).replace("【", "").replace("】", "")[-45:], cursor, comment))
    return out


def test_annotations_are_those_of_a_walk(spark):
    rng = random.Random(5)
    docs = [(0, None), (1, ""), (2, "[T]题\n正文[zp]甲戌：好[-][zp]【又】[-]文[mp]校[zp]内[-][-]终"), (3, "前[zp]题前[-][T]题\n后[zp]x[-]")]
    for i in range(4, 120):
        parts = [rng.choice(["[zp]", "[mp]", "[sc]", "[-]", "[-]", "红楼", "梦 ", "\\\n", "\\[", "【", "】", "x" * 50, "\n", "[T]题\n"]) for _ in range(rng.randrange(0, 60))]
        docs.append((i, ("[T]回目\n" if i % 3 else "") + "".join(parts)))
    parsed = markup.nodes(spark.createDataFrame(docs, "id int, body string"), "id", "body")
    for block in (5, 4096):
        got = annotations.annotations(parsed, "id", block=block).orderBy("id", "ordinal").collect()
        by = {}
        for r in got:
            by.setdefault(r["id"], []).append((r["offset"], r["anchor"], r["locus_offset"], r["comment"]))
        assert by == {i: found for i, t in docs if (found := loop(t))}
    assert len({r["annotation"] for r in got}) == len(got)
    third = [r for r in got if r["id"] == 2]
    assert [r["comment"] for r in third] == ["甲戌：好", "又", "内"] and third[0]["locus"] == third[1]["locus"] == "loc-2-7" and third[2]["embedded"] == ["mp"]


def test_a_lost_annotation_fails_the_job(spark):
    docs = spark.createDataFrame([(1, "[T]t\na[zp]b[-]"), (2, None)], "id int, body string")
    found = annotations.annotations(markup.nodes(docs, "id", "body"), "id")
    counts = annotations.mark_counts(docs, found, "id", "body")
    assert {tuple(r) for r in counts.collect()} == {(1, 1, 1), (2, 0, 0)} and annotations.complete(found, counts, "id").count() == 1
    for text in ("[T]t\na[zp]b[-]\\[zp]", "\\[zp]"):
        docs = spark.createDataFrame([(9, text)], "doc int, body string")
        found = annotations.annotations(markup.nodes(docs, "doc", "body"), "doc")
        with pytest.raises(Exception, match="text 9 has"):
            annotations.complete(found, annotations.mark_counts(docs, found, "doc", "body"), "doc").collect()
