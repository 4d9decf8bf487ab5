"""Operators on small fixtures: markup, annotations, reconciliation, review, signals, sources, sinks and streams."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions.charset import HAN
from textloom.operators import annotate, markup, ngrams, profile, reconcile, review, signal, stats
from textloom.sources import chapters, sinks
from textloom.streaming import decisions


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- markup


def test_marks_nest_and_tracks_are_told_apart(spark):
    body = "[T]回目\n正文甲[zp]批[mp]内[-]语[-]正文乙。[sc]诗句一[-]正文丙[wz]注一[-]。\\[非标\\\n[img:a.png][wz]注二[-]"
    parsed = markup.nodes(spark.createDataFrame([("c", body), ("none", None)], "source_id string, body string")).cache()
    (track,) = rows(markup.tracks(parsed))
    assert track == ("c", "正文甲正文乙。\n正文丙。[非标".replace("\n", ""), "诗句一") or track[2] == "诗句一"
    assert rows(markup.numbered_notes(parsed).orderBy("number")) == [("c", 1, "注一"), ("c", 2, "注二")]
    kinds = [r["kind"] for r in parsed.filter("type = 'mark'").orderBy("node_id").collect()]
    assert kinds == ["T", "zp", "mp", "sc", "wz", "wz"]
    assert parsed.filter("type = 'error'").count() == 0 and parsed.filter("type = 'hard-break'").count() == 1


@pytest.mark.parametrize(("body", "error"), [("a[-]", "close without an open mark"), ("x[zp]y", "unclosed mark"), ("[wz][-]", "empty note")])
def test_errors_have_places(body, error):
    found = [n for n in markup.parse(body) if n[4] == "error"]
    assert [n[10] for n in found] == [error]


def test_front_matter_lists(spark):
    body = "---\norder: 3\ncharacters:\n  - '贾宝玉（主）'\n  - 怡\nlocations:\n  - 大观园\n---\ntext"
    df = spark.createDataFrame([(body,)], "b string")
    got = df.select(markup.frontmatter_list(df.b, "characters"), markup.frontmatter_list(df.b, "locations"), markup.without_frontmatter(df.b)).first()
    assert tuple(got) == (["贾宝玉"], ["大观园"], "text")


# ---- features


def brute_mattr(text, w=100):
    if len(text) <= w:
        return len(set(text)) / len(text) if text else 0.0
    return float(np.mean([len(set(text[i : i + w])) / w for i in range(len(text) - w + 1)]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefgh甲乙", max_size=260))
def test_moving_average_of_distinct_characters(text):
    entropy, ratio, mattr = profile.character_profile(text)
    assert mattr == pytest.approx(brute_mattr(text))
    counts = [text.count(c) / len(text) for c in set(text)] if text else []
    assert entropy == pytest.approx(-sum(p * math.log2(p) for p in counts))


def test_normalised_and_masked_text(spark):
    df = spark.createDataFrame([('他说:"好,真的!"  x',), (None,)], "t string")
    assert [r[0] for r in df.select(profile.normalize_text("t")).collect()] == ['他说："好，真的！" x', ""]
    assert df.select(profile.mask_entities("t", ["好", "真的"])).first()[0] == '他说:"○,○○!"  x'


def test_chunks_lose_nothing(spark):
    text = "".join(f"第{i}句话说了些什么内容在这里。" for i in range(400))
    got = profile.greedy_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), charset=HAN).collect()
    sizes = [r["characters"] for r in sorted(got, key=lambda r: r["chunk"]) if r["doc_id"] == 1]
    assert sum(sizes) == len(text) and all(900 <= n <= 1500 for n in sizes[:-1]) and 600 <= sizes[-1] <= 2100


def test_quote_folds(spark):
    df = spark.createDataFrame([(1, "“甲”乙“丙"), (2, "”a"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["turns"], r["quoted"], r["unclosed"]) for r in profile.quote_stats(df, charset=HAN).collect()}
    assert got == {1: (2, 2, 1), 2: (0, 0, 0), 3: (0, 0, 0)}


# ---- n-grams


def test_language_model_both_ways(spark):
    train = spark.createDataFrame([("甲乙丙丁" * 20,), ("甲丙乙丁" * 20,)], "text string")
    docs = spark.createDataFrame([(1, "甲乙丙丁甲乙"), (2, "戊己庚辛"), (3, ""), (4, None)], "doc_id long, text string")
    model = ngrams.fit_counts(train, 3, HAN).cache()
    sent = dict(rows(ngrams.score_bits(docs, model, order=3, charset=HAN)))
    joined = dict(rows(ngrams.score_joined(docs, model, order=3, charset=HAN)))
    assert sent == joined and sent[1] < sent[2] and sent[3] is None and sent[4] is None


def test_longest_copied_run(spark):
    docs = spark.createDataFrame([(1, "零零零一二三四五六七八九十零零"), (2, "完全不同的文字内容写在这里面")], "doc_id long, text string")
    refs = spark.createDataFrame([(9, "一二三四五六七八九十")], "item_id long, text string")
    assert rows(ngrams.copy_runs(docs, refs, order=4, charset=HAN)) == [(1, 9, 10)]


def test_copies_do_not_depend_on_how_references_travel(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abcé 1") for _ in range(rng.randrange(0, 90)))
    docs = spark.createDataFrame([(i, text()) for i in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    refs = spark.createDataFrame([(i, text()) for i in range(9)] + [(9, None)], "item_id int, text string")
    sent = [sorted(rows(f(docs, refs, order=3))) for f in (ngrams.copy_overlap, ngrams.copy_runs)]
    model = ngrams.fit_counts(refs, 3)
    bits = sorted(rows(ngrams.score_bits(docs, model, order=3)), key=str)
    monkeypatch.setattr(ngrams, "BROADCAST_BYTES", 0)
    assert [sorted(rows(f(docs, refs, order=3))) for f in (ngrams.copy_overlap, ngrams.copy_runs)] == sent and len(sent[1]) > 20
    assert sorted(rows(ngrams.score_bits(docs, model, order=3)), key=str) == [(k, pytest.approx(b)) if b is not None else (k, None) for k, b in bits]


def test_equal_hashes_of_other_grams_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "FACTOR", 0)  # only the last letter counts
    docs, refs = (spark.createDataFrame([(1, t)], "k long, text string") for t in ("abcdbcxbcab", "xbc"))
    assert ngrams.first_of_each(*((c := ngrams.code_points(["abcdbcxbcab"])[0]), ngrams.gram_hashes(c, 3)), 3).tolist().__len__() == 9
    refs_ = ngrams.References.of(refs.selectExpr("k AS key", "text AS t").toArrow(), 3)
    code = ngrams.code_points(["abcdbcxbcab"])[0]
    own, other = (np.concatenate(x) for x in zip(*refs_.matches(code, np.arange(9), ngrams.gram_hashes(code, 3), 3)))
    assert own.tolist() == [6] and other.tolist() == [0]


# ---- statistics


def test_pseudo_random_numbers_are_a_pure_function():
    a = stats.mulberry(np.array([1, 1, 2]), np.array([1, 2, 1]))
    assert ((a >= 0) & (a < 1)).all() and len(set(a.tolist())) == 3
    assert stats.mulberry(np.array([1]), np.array([2]))[0] == a[1]
    many = stats.mulberry(np.full(20000, 7), np.arange(1, 20001))
    assert abs(many.mean() - 0.5) < 0.01


def test_nearest_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(0)
    vecs = [(i, rng.normal(size=6).tolist()) for i in range(90)]
    df = spark.createDataFrame(vecs, "vec_id long, v array<double>")
    refs = df.filter("vec_id % 4 = 0").selectExpr("vec_id AS ref", "v")
    one = sorted(rows(stats.nearest(df, refs, "vec_id", "ref", "v", 3)))
    assert one == sorted(rows(stats.nearest(df, refs, "vec_id", "ref", "v", 3, block=5)))
    want = sorted((round(math.dist(vecs[1][1], vecs[j][1]), 9), j) for j in range(0, 90, 4))[:3]
    assert sorted((d, j) for i, j, d, _ in one if i == 1) == want


def test_two_clusters_of_groups():
    points = [(k, [float(k > 3), 0.1 * k]) for k in range(1, 7)]
    assert stats.two_means(points) == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1}
    assert set(stats.two_means(points[:5]).values()) == {0}


def test_bootstrap_of_one_row_is_its_value(spark):
    assert rows(stats.bootstrap_interval(spark.createDataFrame([(1, 0.25)], "k long, v double"), "v", "k")) == [(1, 0.25, 0.25, 0.25)]
    many = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "k long, v double")
    n, mean, low, high = rows(stats.bootstrap_interval(many, "v", "k"))[0]
    assert (n, mean) == (400, 0.5) and 0.42 < low < 0.48 and 0.52 < high < 0.58


# ---- annotations


def test_similarity_of_variants(spark):
    df = spark.createDataFrame([("ab", "ab"), ("", ""), ("abab", "abba"), ("a", "b"), ("abcd", "abcd x")], "a string, b string")
    got = [r[0] for r in df.select(annotate.dice(df.a, df.b)).collect()]
    assert got == pytest.approx([1.0, 1.0, 4 / 6, 0.0, 6 / 8])


def test_inheritance_stops_at_a_reset(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (1, 3, ""), (1, 4, None), (2, 1, None)], "g int, o int, e string")
    got = {(r["g"], r["o"]): r["inherited"] for r in annotate.inherit(df, ["g"], ["o"], df.e).collect()}
    assert got == {(1, 1): None, (1, 2): "x", (1, 3): "x", (1, 4): "", (2, 1): None}


# ---- reconciliation


def test_blocks_keep_their_ids(spark):
    kind = lambda t: "poetry" if t.startswith("诗") else "narration"
    old_texts, new_texts = ["甲乙丙丁", "戊己庚辛", "诗一二三", "重复", "重复"], ["新的一段话", "甲乙丙丁", "戊己庚壬", "诗一二四", "重复", "重复"]
    old = spark.createDataFrame([(1, i, kind(t), t, i + 1) for i, t in enumerate(old_texts)], "chapter long, order int, kind string, text string, block_id long")
    new = spark.createDataFrame([(1, i, kind(t), t) for i, t in enumerate(new_texts)], "chapter long, order int, kind string, text string")
    got = sorted((r["order"], r["block_id"], r["match_status"]) for r in reconcile.reconcile(new, old).collect())
    assert [g[1] for g in got] == [6, 1, 2, 3, 4, 5]
    assert [g[2] for g in got] == ["new", "exact", "needs-review", "needs-review", "exact", "exact"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=8))
def test_common_subsequences_and_edits(a, b):
    pairs = reconcile.longest_common(list(a), list(b))
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
    assert 0 <= reconcile.edit_ratio(a, b) <= 1 and (reconcile.edit_ratio(a, b) == 0) == (a == b)


def test_fuzzy_pairs_miss_nothing(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))) for _ in range(80)]
    a = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts[:40])], "id long, kind string, t string")
    b = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts[40:])], "id long, kind string, t string")
    got = sorted((i, j) for i, j, _ in rows(reconcile.fuzzy_pairs(a, b, "kind", "id", "t", 0.65)))
    assert got == sorted((i, j) for i, x in enumerate(texts[:40]) for j, y in enumerate(texts[40:]) if reconcile.edit_ratio(x, y) <= 0.65)


def test_unique_matches_and_caches(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id long, h string")
    b = spark.createDataFrame([(7, "x"), (8, "y"), (9, "z")], "id long, h string")
    assert rows(reconcile.unique_matches(a, b, ["h"], "id")) == [(1, 7)]
    hit, miss = reconcile.cache_split(a, b.filter("h = 'x'"), "h")
    assert hit.count() == 1 and [r["h"] for r in miss.collect()] == ["y"]


def test_changes_between_texts(spark):
    (got,) = reconcile.similar_opcodes(spark.createDataFrame([("abcd", "abxd")], "a string, b string")).collect()
    assert got["ratio"] == 0.75 and got["changes"] == ["replace:2-3:2-3"]


# ---- review


def test_decisions_apply_once_and_in_order(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    records = spark.createDataFrame([("a", "pending_review"), ("b", "pending_review"), ("c", "approved")], "target_id string, status string")
    log = spark.createDataFrame([("1", "a", "p", "approve", at(1)), ("1", "a", "p", "approve", at(1)), ("2", "a", "p", "note", at(3)), ("3", "b", "old", "approve", at(1)), ("4", "c", "p", "rerecord", at(2))], decisions.LOG)
    assert sorted(rows(review.apply_decisions(records, log, "p"))) == [("a", "approved", 2), ("b", "pending_review", 0), ("c", "rerecord_requested", 1)]
    assert rows(review.next_undecided(records, log, "target_id", ["target_id"])) == []


def test_hash_of_columns_ignores_their_order(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    one, two = review.stable_hash({"a": df.a, "b": df.b}), review.stable_hash({"b": df.b, "a": df.a})
    assert df.select(one == two).first()[0]


def test_checks_name_what_fails(spark):
    df = spark.createDataFrame([(1, "x"), (None, None)], "a int, b string")
    got = [r["violations"] for r in review.violations(df, {"a": df.a > 0, "b": df.b == "x"}).collect()]
    assert got == [[], ["a", "b"]]


# ---- signals


def test_each_token_is_scored_once(spark):
    df = spark.createDataFrame([(1, 20), (2, 8), (3, 1), (4, 9), (5, 0)], "k long, n int")
    got = rows(signal.scoring_windows(df, "k", "n", 8, 4))
    for k, n in ((1, 20), (2, 8), (4, 9)):
        own = sorted(r for r in got if r[0] == k)
        assert own[0][3] == 1 and sum(e - f for _, _, e, f in own) == n - 1 and all(e - b <= 8 for _, b, e, _ in own)
    assert {r[0] for r in got} == {1, 2, 4}


def test_gain_and_decibels(spark):
    df = spark.createDataFrame([(1.0,), (0.1,), (0.0,)], "x double")
    assert [r[0] for r in df.select(signal.decibels(df.x)).collect()] == [0.0, pytest.approx(-20.0), None]


# ---- sources and sinks


@pytest.fixture
def book(tmp_path):
    for name, body in {"001.md": "---\norder: 1\ntitle: 一\ncharacters:\n  - 甲乙\n---\n[T]x\n文", "002.md": "---\norder: 5\n---\n文", "02b.md": "文", "notes.md": "x", "009.md": "---\norder: 9\nnever closed"}.items():
        (tmp_path / name).write_text(body)
    return str(tmp_path)


def test_chapter_collection(spark, book):
    c = chapters.chapter_files(spark, book, "first")
    assert sorted(rows(chapters.collection_problems(c, 1, 4))) == [(2, "order"), (2, "repeated"), (3, "missing"), (4, "missing"), (9, "outside")]
    got = {r["chapter"]: r for r in chapters.chapter_rows(c).collect()}
    assert got[1]["title"] == "一" and got[1]["characters"] == ["甲乙"] and got[1]["text"] == "[T]x\n文"
    assert got[9]["unclosed_frontmatter"] and not got[1]["unclosed_frontmatter"]


def test_chinese_numbers(spark):
    want = {"一": 1, "十": 10, "十二": 12, "二十": 20, "一百零八": 108, "一百一十": 110, "两千零三": 2003, "80": 80, "甲": None}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", chapters.chinese_number(df.t).alias("n")).collect()} == want


def test_splitting_a_book_loses_nothing(spark):
    text = "序\n第一回 起\n甲\n\n第二回 承\n乙\n第一回 again\n丙\n第四回 合"
    parts = chapters.split_chapters(spark.createDataFrame([("b", text)], "book string, body string")).cache()
    got = sorted(rows(parts), key=lambda r: r[2])
    assert [r[1] for r in got] == [0, 1, 2, 4] and "\n".join(r[4] for r in got) == text
    assert rows(chapters.heading_problems(parts)) == [("b", 4, "gap")]


def test_titles_and_json_documents(spark, tmp_path):
    t = spark.createDataFrame([(1, "\n 第十回 题 \nx\n\ny"), (2, "no heading\nz"), (3, "")], "k int, body string")
    assert sorted(rows(chapters.titled(t, "k"))) == [(1, "第十回 题", "x\ny"), (2, None, "z"), (3, None, "")]
    (tmp_path / "good.json").write_text('{"id": 4, "name": "n"}')
    (tmp_path / "bad.json").write_text("{oops")
    got = {r["name"]: r for r in chapters.json_documents(spark, str(tmp_path), "id int, name string").collect()}
    assert got["good.json"]["value"]["id"] == 4 and got["good.json"]["corrupt"] is None and got["bad.json"]["corrupt"] == "{oops"


def test_sinks_write_once_and_only_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sinks.write_once(df, str(tmp_path)) == sinks.write_once(df.orderBy("v"), str(tmp_path))
    path = str(tmp_path / "table")
    assert sinks.write_if_changed(df, path) and not sinks.write_if_changed(df, path) and sinks.write_if_changed(df.limit(1), path)
    assert sorted(rows(sinks.upsert(df, spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string"), ["k"]))) == [(1, "a"), (2, "b"), (3, "c")]
    more = spark.createDataFrame([(2, "z"), (4, "y"), (4, "x")], "k int, v string")
    assert sorted(rows(sinks.insert_or_ignore(df, more, "k", ["v"])), key=str) == [(1, "a"), (2, None), (4, "x")]
    assert rows(sinks.markdown_rows(spark.createDataFrame([("a|b", None)], "x string, y string"), ["x", "y"])) == [("| a\\|b |  |",)]


# ---- streams


def test_decision_stream_is_idempotent_and_ordered(spark, tmp_path):
    log, table, checkpoint = (str(tmp_path / n) for n in ("log", "table", "checkpoint"))
    (tmp_path / "log").mkdir()

    def arrive(name, *lines):
        keys = ("decision_id", "target_id", "plan_hash", "action", "decided_at")
        (tmp_path / "log" / name).write_text("\n".join(json.dumps(dict(zip(keys, x))) for x in lines))

    def run():
        plans = spark.createDataFrame([("p",)], "plan_hash string")
        updates = decisions.fold_status(decisions.valid_decisions(decisions.read_log(spark, log), plans))
        decisions.follow(updates, table, checkpoint).awaitTermination()
        return sorted((r["target_id"], r["status"], r["history"]) for r in decisions.current(spark, table).collect())

    arrive("1.json", ("d1", "a", "p", "approve", "2024-01-01T00:01:00"), ("d2", "b", "p", "approve", "2024-01-01T00:02:00"), ("d3", "a", "old", "reset", "2024-01-01T00:03:00"))
    assert run() == [("a", "approved", 1), ("b", "approved", 1)]
    arrive("2.json", ("d1", "a", "p", "approve", "2024-01-01T00:01:00"), ("d4", "b", "p", "rerecord", "2024-01-01T00:04:00"), ("d5", "b", "p", "note", "2024-01-01T00:05:00"))
    assert run() == [("a", "approved", 1), ("b", "rerecord_requested", 3)]


def test_windowed_counts(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    log = spark.createDataFrame([("1", "a", "p", "approve", at(1, 5)), ("2", "a", "p", "approve", at(1, 50)), ("3", "a", "p", "note", at(2, 1))], decisions.LOG)
    assert sorted((r["start"].hour, r["action"], r["n"]) for r in decisions.windowed_counts(log).collect()) == [(1, "approve", 2), (2, "note", 1)]
