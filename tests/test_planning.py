"""Review packages, spoken-text planning, alignment and audio files on small fixtures."""

import json
import struct

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import markup, packages, reconcile, review, speech
from textloom.sources import audio


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- packages


def test_blind_keys_do_not_tell_ids(spark):
    df = spark.createDataFrame([("a", "甲", None), ("b", "甲", None), ("c", "甲", "")], "id string, upper string, lower string")
    got = packages.blind(df, "id", ["upper", "lower"]).collect()
    assert "id" not in got[0].asDict() and len({r["blind_key"] for r in got}) == 3 and len({r["text_hash"] for r in got}) == 1
    split = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    assert split.select(packages.text_hash(split.x, split.y)).distinct().count() == 2


def test_package_hash_sees_changes_repeats_and_loss(spark):
    row = packages.text_hash("t")
    h = lambda data: {r["p"]: r["package_hash"] for r in packages.package_hashes(spark.createDataFrame(data, "p int, t string"), ["p"], row).collect()}
    assert h([(1, "a"), (1, "b")]) == h([(1, "b"), (1, "a")])
    assert len({h(d)[1] for d in ([(1, "a")], [(1, "a"), (1, "a")], [(1, "b")], [(1, None)])}) == 4
    manifests = packages.package_hashes(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "p int, t string"), ["p"], row)
    assert rows(packages.changed_packages(manifests, spark.createDataFrame([(1, "a"), (2, "x")], "p int, t string"), "p", row)) == [(2, "hash differs"), (3, "no rows")]


def test_ratings_with_problems(spark):
    known = spark.createDataFrame([("k", "h", "some words"), ("n", "h", None)], "key string, text_hash string, text string")
    data = [(1, "k", "h", "words"), (2, "k", "h", "other"), (3, "k", "g", "words"), (4, "z", "h", "words"), (5, "k", "h", None), (5, "k", "h", "some"), (6, "n", "h", ""), (7, "n", None, "")]
    got = rows(packages.rating_problems(spark.createDataFrame(data, "review int, key string, text_hash string, quote string"), known, "review", "key"))
    twice, unknown, differs, quote = "rated twice", "unknown", "text differs", "quote not in text"
    assert got == [(1, "k", None), (2, "k", quote), (3, "k", differs), (4, "z", unknown), (5, "k", twice), (5, "k", twice), (6, "n", None), (7, "n", differs)]


def test_reviews_that_count(spark):
    data = [("p", 1, 1, "a", "m"), ("p", 2, 2, "b", "m"), ("p", 3, 2, "c", "m"), ("q", 4, 1, "a", "m"), ("q", 5, 2, "b", None), ("r", 6, 1, "a", None), ("r", 7, 2, "a", None)]
    got = rows(packages.independent_reviews(spark.createDataFrame(data, "p string, review int, round int, context string, snapshot string"), "p", "review"))
    rep, dif = "round or context repeated", "snapshots differ"
    assert [g[2] for g in got] == [None, rep, rep, dif, dif, rep, rep]


def test_fresh_attempts_are_new(spark):
    df = spark.createDataFrame([("a", False), ("a", False), ("a", True)], "f string, fresh boolean")
    got = packages.attempts(df, ["f"], df.fresh).collect()
    assert len({r["family"] for r in got}) == 1 and [r["attempt"] == "initial" for r in got] == [True, True, False]


# ---- speech


def test_prosody_shifts_and_bounds(spark):
    data = [("+0%", "+0Hz", "+0%", "broken", "low", "light", ["whispering", "dream-murmur"]), ("+99%", "+19Hz", "-7%", "urgent", "high", "heavy", None), ("x", None, "+3Hz", None, "?", "medium", [])]
    df = spark.createDataFrame(data, "rate string, pitch string, volume string, pace string, tone string, energy string, m array<string>")
    assert [tuple(r)[:3] for r in speech.prosody(df, df.m).collect()] == [("-27%", "-3Hz", "-42%"), ("+100%", "+20Hz", "+1%"), ("+0%", "+0Hz", "+0%")]
    unit = spark.createDataFrame([("99999999999%",), ("-7%",), ("7",)], "t string")
    assert [r[0] for r in unit.select(speech.signed_value(unit.t, "%", 1)).collect()] == [1, -7, 1]


def test_instruction_and_substitution(spark):
    df = spark.createDataFrame([("calm", ["soft", "odd"], [("a", "b"), ("b", "c"), ("", "x")]), (None, None, None)], "f string, t array<string>, r array<struct<text:string,replacement:string>>")
    said = speech.instruction([(F.array("f"), {"calm": "calmly"}), (df.t, {"soft": "softly"})], "clearly")
    assert [tuple(r) for r in df.select(said, speech.substitute(F.lit("ab"), df.r)).collect()] == [("calmly, softly, clearly", "cc"), ("clearly", "ab")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab。，？! \n", max_size=120), st.integers(1, 30))
def test_units_lose_nothing_and_keep_the_limit(text, most):
    units = speech.units_of(text, most)
    assert "".join(units) == text and all(0 < len(u) <= most for u in units)


def test_units_and_targets(spark):
    df = spark.createDataFrame([(1, "一二三四五六。七八，九十！" * 2), (2, None), (3, "")], "k int, t string")
    units = speech.speech_units(df, "k", df.t, 10)
    assert {r["k"] for r in units.collect()} == {1}
    targets = speech.render_targets(units, ["k", "unit_index"], F.lit("v")).collect()
    assert len({r["target_hash"] for r in targets}) == len(targets) > len({r["request_hash"] for r in targets})


def test_scenes(spark):
    blocks = spark.createDataFrame([(c, i, t) for c in "abc" for i, t in enumerate(["x1", "begin here", "mid", "the end", None])] + [("c", 9, "begin again")], "c string, i int, t string")
    anchors = spark.createDataFrame([("a", "begin", "end"), ("b", "the", "here"), ("c", "begin", "end"), ("d", "x", "y")], "c string, start_anchor string, end_anchor string")
    bounds = speech.scene_bounds(blocks, anchors, "c", "i", "t")
    assert rows(bounds) == [("a", 1, 3, None), ("b", None, None, "end before start"), ("c", None, None, "start not unique"), ("d", None, None, "start not unique")]
    assert rows(speech.scene_rows(blocks, bounds, "c", "i").select("c", "i")) == [("a", 1), ("a", 2), ("a", 3)]


def test_excerpts_and_groups(spark):
    targets = spark.createDataFrame([(f"t{i}", i, "b") for i in range(8)], "target_id string, position int, binding string")
    wanted = spark.createDataFrame([("t1", 0), ("t3", 1), ("t2", 2), ("zz", 3), ("t5", 5), ("t5", 6)], "target_id string, wanted_order int")
    problems = {(r["target_id"], r["wanted_order"]): r["problem"] for r in speech.excerpt(targets, wanted, "target_id", "position").collect()}
    assert problems == {("t1", 0): None, ("t3", 1): None, ("t2", 2): "out of order", ("zz", 3): "missing", ("t5", 5): "wanted twice", ("t5", 6): "wanted twice"}
    groups = [("ok", 0, "t0", "b"), ("ok", 1, "t1", "b"), ("gap", 0, "t2", "b"), ("gap", 1, "t4", "b"), ("old", 0, "t5", "x"), ("gone", 0, "zz", "b"), ("two", 0, "t6", "b"), ("dup", 0, "t6", "b")]
    got = speech.group_problems(targets, spark.createDataFrame(groups, "group_id string, ordinal int, target_id string, binding string"))
    assert {r["group_id"]: r["problem"] for r in got.collect()} == {"ok": None, "gap": "not contiguous", "old": "binding changed", "gone": "unknown target", "two": "covered twice", "dup": "covered twice"}


def test_alignment(spark):
    def version(texts):
        df = spark.createDataFrame([(f"{p}", "c", i, k, t) for i, (p, k, t) in enumerate(texts)], "id string, c string, i int, kind string, text string")
        return reconcile.context_hashes(df, ["c"], ["i"], "kind", "text")

    old = version([("o1", "n", "the first line of all"), ("o2", "n", "another longer line here"), ("o3", "d", "said once"), ("o4", "n", "same"), ("o5", "n", "same")])
    new = version([("n1", "n", "the first line of all"), ("n2", "n", "another longer line there"), ("n3", "d", "said once"), ("n4", "n", "wholly new words, nothing alike"), ("n5", "n", "same")])
    got = {r["id"]: (r["old_id"] if "old_id" in r.asDict() else r["old_key"], r["how"]) for r in reconcile.align(new, old, "c", "id").collect()}
    assert got["n1"] == ("o1", "moved") and got["n2"] == ("o2", "changed") and got["n3"] == ("o3", "moved") and got["n4"] == (None, "paused")
    empty = reconcile.align(new.limit(0), old, "c", "id")
    assert empty.count() == 0
    elsewhere = reconcile.align(new.withColumn("c", F.lit("other")), old, "c", "id")
    assert {r["how"] for r in elsewhere.collect()} == {"paused"}


def test_reuse_and_sequences(spark):
    now = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "k int, t string, u string")
    old = spark.createDataFrame([(1, "a", None), (2, "b", None)], "k int, t string, u string")
    assert rows(speech.reusable(now, old, "k", ["t", "u"])) == [(1, True), (2, False), (3, False)]
    a = spark.createDataFrame([("p", 1, "x"), ("p", 2, None), ("q", 1, "x"), ("s", 1, "x")], "c string, i int, t string")
    b = spark.createDataFrame([("p", 5, "x"), ("p", 6, None), ("q", 1, "x"), ("q", 2, "y"), ("s", 1, "z")], "c string, i int, t string")
    assert rows(speech.same_sequence(a, b, "c", ["i"], ["t"])) == [("p", True), ("q", False), ("s", False)]
    carried = speech.carry_over(spark.createDataFrame([(1, "h"), (2, None)], "k int, h string"), spark.createDataFrame([("h", 1), ("h", 2), (None, 9)], "h string, v int"), "h", ["v"])
    assert rows(carried) == [(1, "h", 2), (2, None, None)]


def test_structure(spark):
    df = spark.createDataFrame([(100, 104, False, 1), (100, 105, False, 1), (3, 4, False, 0), (100, 100, True, 0), (100, 100, False, 2), (0, 0, False, 0)], "e int, h int, r boolean, d int")
    assert [r[0] for r in df.select(speech.structural_pass(df.e, df.h, df.r, df.d)).collect()] == [True, False, True, False, False, True]


# ---- audio


def wav(samples, rate=24000, extra=b""):
    data = np.asarray(samples, "<i2").tobytes()
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav_frames(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav([16384] * 240 + [-32768] * 100, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    (tmp_path / "b.wav").write_bytes(wav([]))
    (tmp_path / "c.wav").write_bytes(b"no")
    got = {}
    for r in audio.wav_frames(audio.audio_files(spark, str(tmp_path), "*.wav")).collect():
        got.setdefault(r["path"][-5:], []).append((r["frame_no"], r["n"], r["sum_sq"], r["peak"], r["problem"]))
    assert got == {"a.wav": [(0, 240, 60.0, 0.5, None), (1, 100, 100.0, 1.0, None)], "b.wav": [(None,) * 4 + ("no format or no samples",)], "c.wav": [(None,) * 4 + ("not a RIFF WAVE file",)]}


def frame(kbit=9, mono=True):
    head = 0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | kbit << 12 | (3 if mono else 0) << 6
    size = audio.mp3_header(head)[0]
    return head.to_bytes(4, "big") + bytes(size - 4)


def test_mp3_files(spark, tmp_path):
    tag = b"ID3\x04\0\0\0\0\0\x05" + b"12345"
    for name, content in {"a": tag + frame() * 3 + b"TAG" + bytes(125), "b": frame() + frame()[:-1], "c": frame() + frame(mono=False)}.items():
        (tmp_path / f"{name}.mp3").write_bytes(content)
    got = {r["path"][-5]: r for r in audio.mp3_table(audio.audio_files(spark, str(tmp_path), "*.mp3")).collect()}
    assert tuple(got["a"])[2:] == (3, round(3 * 1152 / 44100, 3), 44100, 128, 1, None)
    assert got["b"]["problem"] == "no whole frame at byte 417" and got["c"]["problem"] == "rate or channels change at byte 417" and audio.mp3_info(b"") == {"problem": "no whole frame"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=4), st.one_of(st.integers(), st.text(max_size=6))), max_size=4), st.integers(0, 200))
def test_json_pieces_join_up(values, cut):
    text = "\n ".join(json.dumps(v) for v in values)
    found, rest = audio.json_values_of(text[:cut])
    more, end = audio.json_values_of(rest + text[cut:])
    assert [json.loads(v) for v in found + more] == values and end == ""


def test_json_table(spark):
    df = spark.createDataFrame([(1, '{"a":1}[2] {"b'), (2, None), (3, "x{}")], "k int, t string")
    assert rows(audio.json_values(df, "k", "t")) == [
        (1, 0, '{"a":1}', '{"b', None), (1, 1, "[2]", '{"b', None), (2, None, None, "", None), (3, None, None, "x{}", "not a JSON object or array at 0")
    ]


# ---- voices


def test_voice_spans_and_runs(spark):
    body = r"lead \[voice: [voice:dai|calm]one[zp]two[-]three[-][voice:dai|calm]four[-] end[-]"
    df = spark.createDataFrame([("a", body), ("b", "[voice:x|y]open"), ("c", "[voice:x|y]a[voice:z|y]"), ("d", "[voice:X]"), ("e", "[voice:x|y][T]t[-]"), ("f", None)], "source_id string, body string")
    spans = markup.voice_table(df).cache()
    assert [r["problem"] for r in spans.filter("problem is not null").orderBy("source_id").collect()] == ["voice not closed", "voice inside a voice", "bad voice mark", "title inside a voice"]
    assert [(r["voice"], r["text"]) for r in spans.filter("source_id = 'a'").orderBy("offset").collect()] == [(None, r"lead \[voice: "), ("dai", "one[zp]two[-]three"), ("dai", "four"), (None, " end[-]")]
    assert rows(markup.voice_runs(spans)) == [("a", 1, None, None, 14), ("a", 2, "dai", "calm", 22), ("a", 3, None, None, 7)]


# ---- repeats, approvals and manifests


def test_repeats():
    assert reconcile.repeated_span("哄人来了", "哄人哄人来了") == "哄人"
    assert reconcile.repeated_span("好好的", "好好的") is None and reconcile.repeated_span("", "") is None
    assert reconcile.repeated_span("一二三四五六", "一二三四五六一二三四") == "一二三四"
    assert reconcile.repeated_span("ab-cd", "ab-cd-ab") is None
    assert reconcile.repeated_span("abcdabcd", "abcdabcd") is None


def test_repeated_span_is_the_longest_then_first_of_all():
    import random

    rng = random.Random(3)
    for _ in range(1500):
        written = "".join(rng.choice(rng.choice(["ab", "abcdefgh"])) for _ in range(rng.randrange(0, 14)))
        heard = written
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(heard) + 1)
            j = rng.randrange(i, len(heard) + 1)
            heard = heard[:j] + heard[i:j] + heard[j:]
        hits = []
        for size in range(2, 21):
            for p in range(len(heard) - 2 * size + 1):
                span = heard[p : p + size]
                again = heard.startswith(span, p + size) if size <= 3 else span in heard[p + size :]
                doubled = len(written) >= p + 2 * size and written[p : p + size] == written[p + size : p + 2 * size]
                if again and not doubled and heard.count(span) > written.count(span):
                    hits.append((-size, p, span))
        assert reconcile.repeated_span(written, heard) == (min(hits)[2] if hits else None)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", max_size=12), st.text(alphabet="ab", max_size=14))
def test_repeats_brute(expected, heard):
    def wanted():
        for size in range(min(20, len(heard) // 2), 1, -1):
            for i in range(len(heard) - size + 1):
                span, own = heard[i : i + size], expected[i : i + 2 * size]
                later = [j for j in range(i + size, len(heard)) if heard[j : j + size] == span]
                if (i + size in later if size < 4 else later) and not (len(own) == 2 * size and own[:size] == own[size:]) and heard.count(span) > expected.count(span):
                    return span

    assert reconcile.repeated_span(expected, heard) == wanted()


def test_voices_and_overrides(spark):
    configs = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h"), ("c", 3, "bad"), ("d", 4, None), ("e", None, "h")], "speaker string, approval_id int, file_hash string")
    decisions = spark.createDataFrame([(1, "approved", "h"), (2, "open", "h"), (3, "approved", "bad"), (4, "approved", "h")], "approval_id int, decision string, file_hash string")
    denied = spark.createDataFrame([("bad",), ("bad",), (None,)], "file_hash string")
    assert [(r["speaker"], r["problem"]) for r in review.verified(configs, decisions, denied).orderBy("speaker").collect()] == [("a", None), ("b", "not approved"), ("c", "denied"), ("d", "changed"), ("e", "not approved")]
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "k int, v string")
    o = spark.createDataFrame([(1, "x", "y"), (2, "z", "y")], "k int, expected string, replacement string")
    assert rows(review.overridden(df, o, "k", "v")) == [(1, "y", None), (2, "x", "not the expected value"), (3, None, None)]
    assert rows(review.availability(df, spark.createDataFrame([("x",), ("x",)], "v string"), "v")) == [(1, "x", "available"), (2, "x", "available"), (3, None, "missing")]


def test_manifests(spark):
    old = {"version": 1, "chapters": {"081": {"buildHash": "b", "fileHash": "f", "bytes": 3, "durationSeconds": 1.5}}}
    new = {"version": 2, "chapters": {"082": {"defaultVariant": "m", "variants": {"m": {"url": "u", "trackHash": "t", "fileHash": "g", "bytes": 4, "durationSeconds": 2}}}}}
    df = spark.createDataFrame([(json.dumps(old),), (json.dumps(new),), ("{",), ('{"version": 3, "chapters": {}}',), (None,)], "j string")
    assert rows(review.manifest_tracks(df, "j")) == [("081", "female", "/audio/081.mp3", "b", "f", 3, 1.5), ("082", "m", "u", "t", "g", 4, 2.0)]


def test_rendering(spark):
    body = "[T]回目\n正文<甲>[zp]批[mp]内[-][-]乙。[wz]注一[-]行\\\n尾[img:a.png][wz]注二[-][sc]诗[-]"
    df = spark.createDataFrame([("a", body), ("b", "x[zp]y"), ("c", "plain & 'simple'"), ("d", None)], "source_id string, body string")
    got = dict(rows(markup.rendered(markup.nodes(df))))
    assert got == {
        "a": '<h1>回目</h1>\n正文&lt;甲&gt;<span class="zp">批<span class="mp">内</span></span>乙。<aside data-note="1">注一</aside>行<br>尾'
        '<img src="/images/a.png"><aside data-note="2">注二</aside><span class="sc">诗</span>',
        "b": None,
        "c": "plain &amp; &#39;simple&#39;",
    }


def test_list_functions_see_slices_of_a_batch(spark):
    from textloom.operators import ngrams

    rows = spark.createDataFrame([(i, "a" * 20_000) for i in range(200)], "id int, t string").coalesce(1)
    sizes = ngrams.in_slices(rows, ["id"], [F.col("t")], lambda texts: [len(texts)] * len(texts), "n", "int").collect()
    assert sorted(r["id"] for r in sizes) == list(range(200))
    assert max(r["n"] for r in sizes) < 60  # 4 MB of text in one batch, about a megabyte at once
