"""Cuts against a loop that slices what remains."""

import random

import pytest

from textloom.operators import cuts

MARKS = "\n。！？!?；;", "，,、：:"


def brute(text, most):
    out, rest, least = [], text.strip(), int(most * 0.4)
    while len(rest) > most:
        window = rest[:most]
        cut = max(window.rfind(m) for m in MARKS[0]) + 1
        if cut < least:
            cut = max(window.rfind(m) for m in MARKS[1]) + 1
        if cut < least:
            cut = most
        if rest[:cut].strip():
            out.append(rest[:cut].strip())
        rest = rest[cut:].lstrip()
    return [*out, rest] if rest else out


def test_cuts_are_those_of_a_loop():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("甲乙丙丁 \n。，;" if rng.random() < 0.3 else "甲乙丙😀") for _ in range(rng.randrange(0, 260)))
        most = rng.randrange(20, 60)
        found = [text[a:b] for a, b in cuts.bounded_cuts(text, most)]
        assert found == brute(text, most) and all(len(c) <= most for c in found)
        assert "".join("".join(found).split()) == "".join(text.split())
    with pytest.raises(ValueError):
        cuts.bounded_cuts("x", 19)


def test_a_text_without_marks_and_a_long_one(spark):
    docs = [(1, "x" * 100), (2, None), (3, " \n "), (4, "句。" * 300_000)]
    got = cuts.speech_cuts(spark.createDataFrame(docs, "id int, text string"), "id", "text", 40).collect()
    assert [len(r["text"]) for r in got if r["id"] == 1] == [40, 40, 20] and sum(r["id"] == 4 for r in got) == 15_000 and {r["id"] for r in got} == {1, 4}


def test_forced_units_stay_whole_and_nothing_is_lost(spark):
    rng = random.Random(2)
    docs = []
    for i in range(200):
        text = "".join(rng.choice("甲乙丙丁。，！") for _ in range(rng.randrange(0, 80)))
        places = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 4)))
        forced = [text[a:b] for a, b in zip(places[::2], places[1::2]) if b > a]
        docs.append((i, text, forced))
    docs += [(1000, "一二三", ["四"]), (1001, "一二三", ["三", "一"]), (1002, None, None), (1003, "一二三", [""])]
    units, missing = cuts.forced_units(spark.createDataFrame(docs, "id int, text string, forced array<string>"), "id", "text", "forced", 12)
    assert {(r["id"], r["missing"]) for r in missing.collect()} == {(1000, 0), (1001, 1), (1003, 0)}
    by = {}
    for r in units.orderBy("id", "unit_index").collect():
        by.setdefault(r["id"], []).append((r["unit"], r["forced"]))
    for i, text, forced in docs[:200]:
        own = by.get(i, [])
        assert "".join(u for u, _ in own) == text and [u for u, k in own if k is not None] == forced
        assert all(len(u) <= 12 for u, k in own if k is None)
