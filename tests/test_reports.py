"""Splits, report counts and checks of single texts on small tables: nulls, ties, repeated rows and empty tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import reports, wording


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, **columns):
    """The values of expressions over one empty row."""
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_hash_rank_is_the_order_of_the_hash_in_every_group(spark):
    random.seed(1)
    data = [(i % 400, random.choice(["a", "b", None])) for i in range(900)]
    got = reports.hash_rank(spark.createDataFrame(data, "k long, g string"), "k", ["g"], "s").collect()
    for g in ("a", "b", None):
        own = sorted((r["rank"], r["k"]) for r in got if r["g"] == g)
        assert [n for n, _ in own] == list(range(len(own)))
        assert [k for _, k in own] == sorted((k for k, x in data if x == g), key=lambda k: (hashlib.md5(f"{k}s".encode()).hexdigest(), k))
    assert reports.hash_rank(spark.createDataFrame([], "k long, g string"), "k", ["g"]).count() == 0


def test_folds_keep_groups_together_and_rows_whole(spark):
    data = [(i, random.Random(i).choice(["x", "y", "z", None])) for i in range(200)]
    got = reports.group_folds(spark.createDataFrame(data, "i int, g string"), "g", 3).collect()
    assert len(got) == 200 and len({(r["g"], r["fold"]) for r in got}) == 4


def test_split_takes_every_third_of_a_stratum(spark):
    got = reports.stratified_split(spark.range(30).withColumn("s", F.col("id") % 2), "id", "s").groupBy("s", "split").count()
    assert rows_of(got) == [(0, "calibration", 10), (0, "test", 5), (1, "calibration", 10), (1, "test", 5)]


def test_fold_metrics_of_one_fold_have_no_training(spark):
    got = reports.fold_metrics(spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0)], "f int, g string, v double"), "f", "g", "v").first()
    assert (got["n"], got["median"], got["held_out"], got["training"]) == (2, 2.0, ["a", "b"], [])


def test_items_are_stable_unstable_or_incomplete(spark):
    marks = {"stable": [(4, 3), (3, 4), (4, 4)], "unstable": [(4, 4), (1, 4), (4, 4)], "short": [(4, 4), (4, 4)]}
    data = [(k, r, d, s) for k, rounds in marks.items() for r, scores in enumerate(rounds) for d, s in enumerate(scores)]
    got = {r["k"]: r for r in reports.item_report(spark.createDataFrame(data, "k string, round int, dimension int, score int"), "k").collect()}
    assert (got["stable"]["total"], got["stable"]["total_range"], got["stable"]["status"]) == (40, 5, "stable")
    assert got["unstable"]["status"] == "unstable" and got["short"]["status"] == "incomplete" and got["short"]["total"] is None


@pytest.mark.parametrize(("items", "stable", "status"), [(12, 12, "passed"), (12, 11, "passed"), (12, 10, "failed"), (11, 11, "incomplete")])
def test_calibration_wants_twelve_items_and_eleven_stable(spark, items, stable, status):
    data = [("p", "stable" if i < stable else "unstable") for i in range(items)]
    assert reports.calibration_status(spark.createDataFrame(data, "p string, status string"), "p").first()["status"] == status


def test_a_pair_is_won_in_both_orders_only(spark):
    votes = [("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "x"), ("c", None), ("d", "x")]
    got = rows_of(reports.both_orders(spark.createDataFrame(votes, "p string, w string"), "p", "w"))
    assert got == [("a", 2, "x", "agreed"), ("b", 2, None, "no agreement"), ("c", 2, None, "no agreement"), ("d", 1, None, "incomplete")]


def test_neighbours_skip_rows_without_value_and_the_row_itself(spark):
    data = spark.createDataFrame([(1, None), (2, 20), (3, None), (4, 40)], "o int, v int").withColumn("g", F.lit(1))
    got = [(r["o"], r["before"], r["after"]) for r in reports.marked_neighbours(data, ["g"], ["o"], F.col("v")).orderBy("o").collect()]
    assert got == [(1, None, 20), (2, None, 40), (3, 20, 40), (4, 20, None)]


def test_changes_of_two_versions(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (1, 3, "y")], "g int, k int, t string")
    b = spark.createDataFrame([(1, 1, "x"), (1, 2, ""), (1, 3, "z"), (1, 4, "n")], "g int, k int, t string")
    assert rows_of(reports.change_counts(a, b, ["g"], ["k"], "t")) == [(1, 2, 1, 1, 0)]
    assert rows_of(reports.change_counts(b, a, ["g"], ["k"], "t")) == [(1, 2, 1, 0, 1)]


def test_first_differences_match_a_plain_search(spark):
    random.seed(3)
    pairs = [("", ""), ("", "a"), ("ab", "ab"), ("a\n😀b", "a\n😀c"), ("a\n", "a\nb"), (None, "x")]
    pairs += [("".join(random.choices("a\n", k=random.randint(0, 6))), "".join(random.choices("a\n", k=random.randint(0, 6)))) for _ in range(60)]
    for a, b, got in spark.createDataFrame(pairs, "a string, b string").select("a", "b", wording.first_difference(F.col("a"), F.col("b"))).collect():
        a, b = a or "", b or ""
        if a == b:
            assert got is None
            continue
        at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert tuple(got) == (at, a[:at].count("\n") + 1, at - (a[:at].rfind("\n")))


def test_marked_up_speech_may_only_pause(spark):
    ok = '<speak>Well,<break time="200ms"/> then.</speak>'
    cases = {"Well, then.": (ok, None), "Well then": (ok, None), "Well, that.": (ok, "words"), "a": ("a", "root"), "b": ("<speak><b>b</b></speak>", "tags"), "c": ("<speak>c</speak><speak></speak>", "root")}
    for text, (ssml, problem) in cases.items():
        assert one(spark, p=wording.ssml_problem(F.lit(text), F.lit(ssml)))["p"] == problem
    assert one(spark, p=wording.ssml_problem(F.lit(None).cast("string"), F.lit(None).cast("string")))["p"] == "root"


def test_forms_of_texts(spark):
    got = one(
        spark, slug=wording.slug(F.lit("my file (2).txt")), none=wording.slug(F.lit("??")), quotes=wording.alternating_quotes(F.lit('"a" and "b')),
        long=wording.plausible_seconds(F.lit("x" * 1000)), short=wording.plausible_seconds(F.lit("x y")), form=wording.transcript_form(F.lit("A b, ¡C! +")),
        up=wording.safe_path(F.lit("a/../b")), good=wording.safe_path(F.lit("a/b.c")), root=wording.safe_path(F.lit("/a")), null=wording.safe_path(F.lit(None).cast("string")),
        leap=wording.iso_instant(F.lit("2024-02-29T10:00:00.000Z")), no=wording.iso_instant(F.lit("2023-02-29T10:00:00.000Z")),
        issues=wording.format_issues(F.lit("一二三四"), F.lit("一二三"), 4), fine=wording.format_issues(F.lit("一二三四"), F.lit("四三二一"), 4),
        inner=wording.unwrapped(F.lit("【 好 】")), head=wording.comment_parts(F.lit("甲：【好】"))[0], core=wording.comment_parts(F.lit("甲：【好】"))[1],
    )
    assert (got["slug"], got["none"], got["quotes"], got["long"], got["short"], got["form"]) == ("my-file-2-txt", "input", "“a” and “b", 120, 6, "abc")
    assert (got["up"], got["good"], got["root"], got["null"], got["leap"], got["no"]) == (False, True, False, False, True, False)
    assert (got["issues"], got["fine"], got["inner"], got["head"], got["core"]) == (["length", "unequal"], [], "好", "甲", "好")


def test_kept_ranges_map_cleaned_offsets_to_raw_ones(spark):
    random.seed(5)
    texts = ["", None, "【x】", "a【x】b😀【y】", "plain"] + ["".join(random.choices("a😀【】", k=12)) for _ in range(40)]
    for text, got in spark.createDataFrame([(t,) for t in texts], "t string").select("t", wording.kept_ranges(F.col("t"), "【[^】]*】")).collect():
        dropped = {i for m in re.finditer("【[^】]*】", text or "") for i in range(*m.span())}
        assert [p["raw"] + i for p in got for i in range(p["length"])] == [i for i in range(len(text or "")) if i not in dropped]
        assert [p["clean"] + i for p in got for i in range(p["length"])] == list(range(len(text or "") - len(dropped)))


def test_orthography_counts_what_it_changes(spark):
    form, changed = wording.orthography(F.lit("caﬁé é"), {"é": "e", "x": "x"})
    assert tuple(one(spark, f=form, c=changed)) == ("caﬁe e", 2)
    with pytest.raises(ValueError):
        wording.orthography(F.lit("a"), {"ab": "c"})


def test_rated_rows_are_dealt_over_as_many_tasks_as_they_need(spark):
    """A task's share does not grow with the table, and no median keeps a group's scores."""
    rows = spark.range(1000).selectExpr("CAST(id % 50 AS string) AS k", "CAST(id AS int) AS round", "0 AS dimension", "CAST(CASE WHEN id % 7 > 0 THEN id % 11 END AS int) AS score")
    assert reports.dealt(rows, "k", 100).rdd.getNumPartitions() == 10 and reports.dealt(rows, "k").rdd.getNumPartitions() == 4
    got = reports.spread(rows, ["k"], "score")
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()
    want = rows.groupBy("k").agg(F.percentile("score", F.lit(0.5)).alias("m"), (F.max("score") - F.min("score")).alias("r"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
