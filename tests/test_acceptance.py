"""Acceptance of annotations, voices of blocks, reports."""

from pyspark.sql import functions as F

from textloom.operators import acceptance, reports
from textloom.sources.sinks import markdown_report


def test_each_rule_of_acceptance(spark):
    blocks = [
        (1, "narration", "t1", "c1", "same", None), (2, "narration", "t2", "c2", "same", None), (3, "dialogue", "t3", "c3", "same", "look"), (4, "narration", "t4", "c4", "auto-reused", None),
        (5, "narration", "t5", "c5", "new", None), (6, "narration", "t6", "c6", "same", None), (7, "dialogue", "t7", "c7", None, None), (8, "dialogue", None, None, "same", None), (9, "narration", "t9", "c9", "auto-reused", None),
    ]
    own = [(1, "$narrator", "t1", "old", "ok"), (2, "$narrator", "old", "c2", "ok"), (3, "anna", "t3", "old", "ok"), (4, "$narrator", "old", "old", "ok"), (5, "$narrator", "t5", "c5", "auto-reused"), (7, "anna", "t7", "c7", None),
           (8, "anna", None, None, "ok"), (9, "nobody", "t9", "c9", "ok")]
    got = acceptance.judged(
        spark.createDataFrame(blocks, "block int, kind string, text_hash string, context_hash string, match string, reason string"),
        spark.createDataFrame(own, "block int, speaker string, text_hash string, context_hash string, review string"), spark.createDataFrame([("anna",), ("anna",)], "speaker string"), ["block"],
    )
    changed = "text or context has changed"
    assert sorted(((r["block"], r["state"], r["reason"], r["context_hash"], r["review"]) for r in got.collect()), key=lambda r: r[0]) == [
        (1, "accepted", None, "old", "ok"), (2, "pending", changed, None, None), (3, "pending", "look", None, None), (4, "accepted", None, "c4", "auto-reused"), (5, "pending", changed, None, None),
        (6, "pending", "no annotation", None, None), (7, "accepted", None, "c7", ""), (8, "pending", changed, None, None), (9, "unknown voice", None, None, None),
    ]


def test_voices_of_blocks(spark):
    accepted = spark.createDataFrame([(1, "$narrator"), (2, "anna"), (3, "nobody")], "block int, speaker string")
    cards = spark.createDataFrame([("anna", "p1", "v1"), ("teller", "p2", "v2")], "card string, provider string, voice string")
    profiles = spark.createDataFrame([("a", None, None, "own"), ("b", "teller", None, None), ("c", None, None, None), ("d", "gone", None, None)], "variant string, card string, provider string, voice string")
    got = {(r["block"], r["variant"], r["card"], r["provider"], r["voice"], r["problem"]) for r in acceptance.voices(accepted, cards, profiles, ["block"]).collect()}
    assert got == {
        (1, "a", "$narrator:a", "edge", "own", None), (1, "b", "teller", "p2", "v2", None), (1, "c", "$narrator:c", "edge", None, "no voice"), (1, "d", None, None, None, "no card"),
        (2, None, "anna", "p1", "v1", None), (3, None, None, None, None, "no card"),
    }
    assert {r["provider"] for r in acceptance.voices(accepted, cards, profiles, ["block"], "forced").collect()} == {"forced"}
    assert {r["problem"] for r in acceptance.voices(accepted.filter("block = 1"), cards, profiles.limit(0), ["block"]).collect()} == {"no profile"}


def test_groups_vote_and_have_a_middle(spark):
    rows = spark.createDataFrame([("g", i, 1.0 * i, v) for i, v in enumerate([[0.0], [0.1], [50.0], None])] + [("h", 9, None, None)], "part string, id int, value double, v array<double>")
    centers = spark.createDataFrame([("far", [10.0]), ("near", [0.0])], "label string, centroid array<double>")
    got = {r["part"]: (r["fragments"], r["mean_value"], r["vote"], r["cluster"]) for r in reports.group_report(rows, "part", "id", "value", "v", centers, "label").collect()}
    assert got == {"g": (4, 1.5, "near", "far"), "h": (1, None, None, None)}
    features = spark.createDataFrame([("ngram.1.a",), ("structure.x",), ("structure.log",)], "feature string")
    assert [r[0] for r in reports.without_features(features, "feature", ("ngram.",), ("structure.log",)).collect()] == ["structure.x"]


def test_a_report_keeps_its_order(spark, tmp_path):
    rows = spark.range(500).select(F.format_string("%03d", "id").alias("n"), F.lit("a|b\nc").alias("t")).repartition(7)
    report = markdown_report(spark, "All", [("Numbers", rows, ["n", "t"], ["n"]), ("None", rows.limit(0), ["n"], ["n"])])
    report.write.text(str(tmp_path / "r"))
    lines = "".join(f.read_text() for f in sorted((tmp_path / "r").glob("part-*"))).splitlines()
    assert lines[:6] == ["# All", "", "## Numbers", "", "| n | t |", "| --- | --- |"] and lines[6:506] == [f"| {i:03d} | a\\|b<br>c |" for i in range(500)]
    assert lines[506:] == ["", "## None", "", "| n |", "| --- |", "No rows."] and [r[0] for r in report.collect()] == lines
