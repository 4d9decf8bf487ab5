"""The style model and the normal form against plain loops over single texts."""

import dataclasses
import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from textloom import plans
from textloom.operators import ngrams, normal, stats, style
from textloom.operators.ngrams import UNSEEN

TEXTS = "key long, source string, fold int, text string"
SMALL = dataclasses.replace(style.HAN, grams=(8, 8, 8), order=3, alphas=(0.3, 1.0))
BASE = ["话说只见众人笑道：“原来如此。”一时都笑起来；", "却说宝玉听见，心下不免诧异，忙问是何缘故？", "且说那丫鬟进来回话，“老太太来了！”——众人听了。", "项目的的的已经完成！！OK……"]


def corpus(n=48, seed=4):
    rng = random.Random(seed)
    return [(i, f"s{i % 8}", i % 4, "".join(rng.choice(BASE[(i % 8) // 4 :][:3]) for _ in range(rng.randrange(3, 9)))) for i in range(n)]


def brute_record(text, spec, grams):
    """The features one by one, with loops over the text."""
    han = lambda t: regex.findall(r"\p{Script=Han}", t)
    n, letters = len(text), han(text)
    depth = inside = turns = 0
    for c in text:
        if c in spec.opening:
            turns += depth == 0
            depth += 1
        elif c in spec.closing:
            depth = max(0, depth - 1)
        elif regex.match(r"\p{Script=Han}", c):
            inside += depth > 0
    cut = lambda marks: [k for k in (len(han(p)) for p in regex.split(f"[{marks}]+", text)) if k]
    sentence, clause = cut(spec.ends), cut(spec.clauses)
    q = lambda v, p: float(np.quantile(v, p)) if v else 0.0
    mean = lambda v: sum(v) / len(v) if v else 0.0
    windows = [len(set(letters[i : i + spec.window])) / spec.window for i in range(len(letters) - spec.window + 1)]
    mattr = len(set(letters)) / len(letters) if letters and len(letters) <= spec.window else mean(windows)
    entropy = -sum(k / len(letters) * math.log2(k / len(letters)) for k in Counter(letters).values())
    out = [
        math.log1p(n), len(letters) / n if n else 0, inside / len(letters) if letters else 0, turns * 1000 / len(letters) if letters else 0,
        mean(sentence), q(sentence, 0.25), q(sentence, 0.5), q(sentence, 0.75), q(sentence, 0.9), mean(clause), q(clause, 0.5), mattr, entropy, len(set(letters)) / len(letters) if letters else 0,
    ]
    out += [text.count(t) * 1000 / len(letters) if letters else 0 for t in (*spec.functions, *spec.formulas, *spec.punctuation)]
    for k, found in enumerate(grams, 1):
        out += [sum(text.startswith(g, i) for i in range(n)) * 1000 / max(1, n - k + 1) for g in found]
    return out


def brute_bits(texts, text, order, alpha):
    counts, after = Counter(), Counter()
    for t in texts:
        for i in range(len(t)):
            for k in range(1, order + 1):
                if i >= k - 1:
                    counts[t[i - k + 1 : i + 1]] += 1
                    after[t[i - k + 1 : i]] += k > 1
    known = {c for t in texts for c in t}
    text = "".join(c if c in known else UNSEEN for c in text)
    total, bits = sum(len(t) for t in texts), 0.0
    for i, c in enumerate(text):
        p = (counts[c] + alpha) / (total + alpha * (len(known) + 1))
        for k in range(2, order + 1):
            if i >= k - 1 and after[text[i - k + 1 : i]]:
                p = (counts[text[i - k + 1 : i + 1]] + alpha * p) / (after[text[i - k + 1 : i]] + alpha)
        bits -= math.log2(p)
    return bits / len(text) if text else math.inf


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus() + [(100, "s0", 0, None), (101, None, None, "只见")], TEXTS).repartition(3).cache()


def test_record_of_whole_texts():
    grams = [["的", "，"], ["的的", "——"], ["的的的"]]
    long = "".join(BASE) * 9
    texts = ["", "的的的的", "———————……………", "”“‘内’外”末", " \n", "ascii only", BASE[0], long, "“" * 4 + "话说" + "”" * 6 + "话说"]
    got = style.Record(style.HAN, grams).of(texts)
    assert len(style.feature_names(style.HAN, grams)) == got.shape[1]
    assert np.allclose(got, [brute_record(t, style.HAN, grams) for t in texts])


def test_vocabulary_ranks_by_count_then_text(spark):
    rows = spark.createDataFrame([("bab a  ",), ("ba",), (None,)], "text string")
    assert style.vocabulary(rows, dataclasses.replace(style.HAN, grams=(3, 2))) == [["a", "b"], ["ba", " a"]]


def test_model_agrees_with_plain_numbers(spark, docs):
    """Scales, covariance, clusters, distances, bits, smoothing and shares, each from its definition."""
    training, rest = docs.filter("key < 100 AND key % 3 != 0"), docs.filter("key % 3 = 0")
    model = style.fit(training, rest, SMALL, "source", "fold")
    own = [(s, f, t) for k, s, f, t in corpus() if k % 3]
    f = model.features
    x = np.array([brute_record(t, SMALL, f.grams) for _, _, t in own])
    center = np.median(x, axis=0)
    mad, iqr = np.median(abs(x - center), axis=0) * stats.MAD, (np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / stats.IQR
    scale = np.where(mad > 0, mad, np.where(iqr > 0, iqr, np.where(x.std(axis=0) > 0, x.std(axis=0), 1)))
    z = (x - center) / scale
    cov = z.T @ z / (len(z) - 1)
    cov = np.where(np.eye(len(cov)) > 0, cov + SMALL.ridge, cov * (1 - SMALL.shrinkage))
    assert np.allclose(f.center, center) and np.allclose(f.scale, scale) and np.allclose(f.inverse @ cov, np.eye(len(cov)), atol=1e-6)
    means = {g: np.mean([v for (s, _, _), v in zip(own, z) if s == g], axis=0) for g in sorted({s for s, _, _ in own})}
    labels = stats.two_means(sorted(means.items()))
    assert f.groups == [[g for g in sorted(means) if labels[g] == c] for c in (0, 1)] and all(len(g) >= 3 for g in f.groups)
    centroids = [np.mean([means[g] for g in groups], axis=0) for groups in f.groups]
    assert np.allclose(f.centroids, centroids)

    by_alpha = {}
    for alpha in SMALL.alphas:
        scored = [(brute_bits([t for _, other, t in own if other != fold], text, 3, alpha), len(text)) for _, fold, text in own]
        by_alpha[alpha] = sum(b * n for b, n in scored) / sum(n for _, n in scored)
    chosen = style.choose_alpha(training, SMALL, "fold")
    assert chosen[0][0] == model.alpha == min(by_alpha, key=by_alpha.get) and all(abs(by_alpha[a] - b) < 1e-9 for a, b in chosen)

    def measured(text):
        v = (np.array(brute_record(text, SMALL, f.grams)) - center) / scale
        options = []
        for c in centroids:
            d = v - c
            options.append(0.5 * abs(d).mean() + 0.5 * math.sqrt(max(0, d @ np.linalg.inv(cov) @ d) / len(d)))
        bits = [brute_bits([t for s, _, t in own if s in groups], text, 3, model.alpha) for groups in f.groups]
        return int(np.argmin(options)), min(options), -math.log2(max(5e-324, np.mean([2.0**-b for b in bits])))

    calibration = [measured(t or "") for k, _, _, t in corpus() + [] if k % 3 == 0]
    bpc = np.array([b for _, _, b in calibration])
    middle = np.median(bpc)
    wide = np.median(abs(bpc - middle)) * stats.MAD
    assert abs(model.bpc_center - middle) < 1e-8 and abs(model.bpc_scale - wide) < 1e-8
    for r in style.audit(docs.filter("key < 100"), model, ["key"]).collect():
        cluster, distance, b = measured(corpus()[r["key"]][3])
        assert r["cluster"] == cluster and abs(r["distance"] - distance) < 1e-6 and abs(r["bpc"] - b) < 1e-6
        feature = 100 * (sum(d >= distance - 1e-8 for _, d, _ in calibration) + 1) / (len(calibration) + 1)
        language = 100 * (sum(abs(x - middle) >= abs(b - middle) - 1e-8 for x in bpc) + 1) / (len(bpc) + 1)
        assert abs(r["feature_share"] - feature) < 1e-6 and abs(r["language_share"] - language) < 1e-6
        assert abs(r["overall"] - 0.6 * feature - 0.4 * language) < 1e-6 and r["band"] == ("alarm" if min(feature, language) < 5 else "weak" if r["overall"] < 20 else "in range")


def test_model_is_kept_by_version(spark, docs, tmp_path):
    training, rest = docs.filter("key % 3 != 0"), docs.filter("key % 3 = 0")
    model = style.fit(training, rest, SMALL, "source", alpha=1.0)
    version = model.save(str(tmp_path))
    assert model.save(str(tmp_path)) == version and len(version) == 64
    again = style.StyleModel.load(spark, str(tmp_path), version)
    assert again.version() == version
    other = style.fit(training.filter("key != 1"), rest, SMALL, "source", alpha=1.0)
    assert other.version() != version
    ask = lambda m: sorted(map(str, style.distances(docs, m, ["key"]).select("key", "cluster", F.round("distance", 9), F.round("bpc", 9)).collect()))
    assert ask(again) == ask(model)


def test_out_of_fold_distances_use_the_other_folds(spark, docs):
    training = docs.filter("key < 100 AND fold < 2")
    got = {r["fold"]: r for r in style.cross_validation(training, SMALL, "source", "fold").collect()}
    assert sorted(got) == [0, 1]
    model = style.fit_features(training.filter("fold = 0"), SMALL, "source")
    d = [r["distance"] for r in style.out_of_fold(training.filter("fold = 1"), model).collect()]
    assert got[1]["n"] == len(d) and abs(got[1]["median"] - np.median(d)) < 1e-8 and abs(got[1]["p90"] - np.quantile(d, 0.9)) < 1e-8


def test_unlike_texts_lie_farther_off(spark, docs):
    model = style.fit(docs.filter("key < 100 AND key % 3 != 0"), docs.filter("key % 3 = 0 AND key < 100"), SMALL, "source", alpha=1.0)
    asked = spark.createDataFrame([("like", BASE[0] * 4), ("unlike", "项目已经完成！！！！？？？？KPI OK 数据 数据" * 9), ("empty", ""), ("null", None)], "name string, text string")
    got = {r["name"]: r for r in style.audit(asked, model, ["name"]).collect()}
    assert got["like"]["distance"] < got["unlike"]["distance"] and got["like"]["bpc"] < got["unlike"]["bpc"]
    assert got["unlike"]["band"] == "weak" and got["unlike"]["suggestions"] and got["empty"]["distance"] == got["null"]["distance"]
    assert style.validation(style.audit(docs.filter("key < 100"), model, ["source"]), "source").first()["status"] in ("validated", "experimental")


def test_few_groups_make_one_cluster(spark):
    few = spark.createDataFrame([(i, f"s{i % 3}", 0, t) for i, t in enumerate(BASE * 3)], TEXTS)
    assert style.fit_features(few, SMALL, "source").groups == [["s0", "s1", "s2"]]
    with pytest.raises(ValueError):
        style.fit_features(few.limit(1), SMALL, "source")


# ---- the normal form


def brute_normal(text, rules):
    """Character by character: (result, source offset of each character, changes)."""
    pairs = list(enumerate(text))
    if pairs and pairs[0][1] == "﻿":
        pairs = pairs[1:]
    pairs = [(i, "\n" if c == "\r" else c) for k, (i, c) in enumerate(pairs) if not (c == "\r" and k + 1 < len(pairs) and pairs[k + 1][1] == "\n")]
    for pattern, once in ((rules.comments, False), (rules.heading, True)):
        if pattern:
            plain = "".join(c for _, c in pairs)
            spans = [m.span() for m in ([regex.match(pattern, plain)] if once else regex.finditer(pattern, plain)) if m]
            pairs = [p for k, p in enumerate(pairs) if not any(a <= k < b for a, b in spans)]
    out, source, changes, double, single, space = "", [], 0, False, False, None
    for i, c in pairs:
        if c.isspace() or c == "﻿":
            space = i if out else None
            continue
        if c == '"':
            double = not double
            form = rules.double[not double]
        elif c == "'":
            single = not single
            form = rules.single[not single]
        else:
            form = rules.marks.get(c) or (c if c in rules.kept else unicodedata.normalize("NFKC", c))
        form = "".join(rules.variants.get(x, x) for x in form)
        changes += form != c
        if space is not None and out and not set(form) & set(rules.opening) and out[-1] not in rules.closing:
            out, source = out + " ", [*source, space]
        space = None
        out, source = out + form, source + [i] * len(form)
    while out[:1].isspace():
        out, source = out[1:], source[1:]
    return out.rstrip(), source[: len(out.rstrip())], changes


def points(runs):
    return [raw + k for _, raw, length in runs for k in range(length)]


def test_normal_form_character_by_character():
    rules = dataclasses.replace(normal.HAN, variants={"風": "风", "説": "说", "Ⅳ": "4"})
    rng, form = random.Random(5), normal.Form(rules)
    pieces = ["他說", "風", '"', "'", ",", "!", " ", "\n", "\r\n", "\r", "\t", "　", "【x", "】", "第一回 題\n", "①", "¨", "ﬁ", "Ⅳ", "，", "。", "「", "」", "（", "）", "a b", "😀", "﻿", ""]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14)))
        out, runs, changes = normal.normalise(text, form)
        want, source, n = brute_normal(text, rules)
        assert (out, points(runs), changes) == (want, source, n), text
        assert all(a[0] + a[2] == b[0] for a, b in zip(runs, runs[1:]))
    assert normal.normalise('他说:"好,真的!"', form)[0] == "他说：“好，真的！”"


def test_composed_maps_are_maps_of_maps():
    rng = random.Random(6)

    def some(size, over):
        """A map into `over` characters, with gaps, repeats and steps back."""
        return normal.runs_of(np.array([rng.randrange(over) if rng.random() < 0.3 else min(over - 1, k) for k in range(size)], dtype=np.int64)) if over else normal.runs_of(np.zeros(0, dtype=np.int64))

    for _ in range(500):
        inner, = [some(rng.randrange(1, 30), 40)]
        outer = some(rng.randrange(0, 30), int(inner[:, 2].sum()))
        far = points(inner)
        got = normal.after(outer, inner)
        assert points(got) == [far[k] for k in points(outer)]
        assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:])) and all(a[1] + a[2] != b[1] for a, b in zip(got, got[1:]))


def test_normalised_rows_and_source_offsets(spark):
    text = "第一回 测试\n正文甲【夹批】乙  “a”, 丙"
    frame = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z"), (4, " \n", "w"), (5, "长。" * 40000, "v")], "id long, text string, normal string")
    rows = normal.normalised(frame.drop("normal"), ["id"], "text", normal.HAN).cache()
    by = {r["id"]: r for r in rows.collect()}
    assert by[1]["normal"] == "正文甲乙“a”，丙" and by[2]["normal"] == by[3]["normal"] == by[4]["normal"] == "" and len(by[5]["runs"]) == 1
    at = rows.filter("id = 1").select(F.explode(F.sequence(F.lit(0), F.length("normal"))).alias("at"), "normal", "runs")
    found = at.select("at", normal.source_of(F.col("runs"), F.col("at")).alias("s")).orderBy("at").collect()
    assert [text[r["s"]] for r in found[:-1]] == list("正文甲乙“a”,丙") and found[-1]["s"] is None
    span = rows.filter("id = 1").select(normal.source_range(F.col("runs"), F.lit(2), F.lit(4)).alias("r")).first()["r"]
    assert text[span["begin"] : span["end"]] == "甲【夹批】乙"
    assert normal.normalised(frame.limit(0), ["id"], "text", normal.HAN).count() == 0


def test_composed_column(spark):
    maps = [(1, [(0, 5, 3), (3, 9, 2)], [(0, 100, 7), (7, 200, 9)]), (2, [], [(0, 1, 2)])]
    frame = spark.createDataFrame(maps, f"id int, outer {normal.RUNS}, inner {normal.RUNS}")
    got = {r["id"]: [tuple(x) for x in r["whole"]] for r in normal.composed(frame, "outer", "inner", "whole").collect()}
    assert got == {1: [(0, 105, 2), (2, 200, 1), (3, 202, 2)], 2: []}


def test_scales_are_those_of_numpy_without_groups_in_memory(spark):
    from textloom.operators import stats

    draw = np.random.default_rng(5)
    groups = {"many": draw.normal(size=501), "even": draw.integers(0, 9, 40) * 1.0, "flat": np.ones(7), "rare": np.append(np.zeros(30), [4.0]), "one": np.array([2.5])}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double")
    found = stats.robust_scale(rows, "v", ["g"])
    for g, n, center, scale in found.collect():
        x = groups[g]
        mad, iqr = np.median(abs(x - np.median(x))), np.quantile(x, 0.75) - np.quantile(x, 0.25)
        assert (n, center) == (len(x), pytest.approx(np.median(x)))
        assert scale == pytest.approx(1.4826 * mad or iqr / 1.349 or x.std() or 1.0)
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_marks_are_looked_up_once_a_kind_of_character():
    class Counted(str):
        asked = 0

        def __contains__(self, c):
            Counted.asked += 1
            return str.__contains__(self, c)

    form = normal.Form(dataclasses.replace(normal.HAN, opening=Counted(normal.HAN.opening)))
    out, runs, changed = form("say \"a\" or 'b' " * 1000)
    assert out.startswith("say“a”or‘b’") and changed == 4000
    assert Counted.asked < 20


def test_style_audit_measures_every_text_once_and_counts_n_grams_twice(spark, monkeypatch):
    """One pass of distances for calibration and audit, one count for the vocabulary and all folds, one for the clusters."""
    distances, grams, measured, counted = style.distances, ngrams.gram_counts, [], []
    monkeypatch.setattr(style, "distances", lambda docs, *a, **b: measured.append(docs.count()) or distances(docs, *a, **b))
    monkeypatch.setattr(ngrams, "gram_counts", lambda docs, *a, **b: counted.append(docs.count()) or grams(docs, *a, **b))
    rows = plans.QUERIES["style_audit"](spark, "/root/testdata/sf0.001").collect()
    training = sum(r["split"] == "training" for r in rows)
    assert measured == [len(rows)] and counted == [training, training] and len({r["doc_id"] for r in rows}) == len(rows)


def test_bits_of_a_text_do_not_depend_on_where_it_stands():
    rng = random.Random(7)
    for order in (1, 2, 3, 5):
        texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 400))) for _ in range(8)]
        table = gram_table(texts, order)
        asked = ["".join(rng.choice("abcdéx ") for _ in range(rng.randrange(0, 300))) for _ in range(40)]
        model = ngrams.Counts.of(table, order, 0.3)
        together = model.bits(asked)
        assert all(math.isnan(b) if not t else b == model.bits([t])[0] for t, b in zip(asked, together))
        assert all(abs(b - brute_bits(texts, t, order, 0.3)) < 1e-9 for t, b in zip(asked, together) if t)
        assert np.array_equal(model.bits_by_alpha(asked, [1.0, 0.3])[1], together, equal_nan=True)


def test_models_without_the_ends_of_some_n_grams_are_scored_place_by_place():
    table = gram_table(["abcabd abc", "bcd abca"], 3)
    model = ngrams.Counts.of(table[table["gram"] != "bc"], 3, 1.0)
    whole = ngrams.Counts.of(table, 3, 1.0)
    assert whole.complete and not model.complete
    # P(c | ab) rests on P(c), as "bc" is not known, though "b" is followed
    n = table.set_index("gram")["n"]
    followed = table.set_index("gram")["context_n"]
    one = lambda c: (n[c] + 1) / (n[list(" abcd")].sum() + 6)
    ab = [one("a"), (n["ab"] + one("b")) / (followed["a"] + 1)]
    ab.append((n["abc"] + one("c") / (followed["b"] + 1)) / (followed["ab"] + 1))
    assert abs(model.bits(["abc"])[0] + sum(map(math.log2, ab)) / 3) < 1e-12


def test_a_task_sends_the_counts_of_all_its_slices_at_once():
    batches = [pa.record_batch({"fold": [1, None, 1], "letters": ["abab", "ab", "b"]}), pa.record_batch({"fold": [1, 2, None], "letters": ["ab", "", "ba"]})]
    sent = [r for b in ngrams.counted(iter(batches), ["fold"], [1, 2]) for r in b.to_pylist()]
    found = {(r["fold"], r["gram"]): r["n"] for r in sent}
    assert len(found) == len(sent)
    assert found == {(1, "a"): 3, (1, "b"): 4, (1, "ab"): 3, (1, "ba"): 1, (None, "a"): 2, (None, "b"): 2, (None, "ab"): 1, (None, "ba"): 1}


def gram_table(texts, order):
    """(order, gram, n, context_n) by loops."""
    n = Counter(t[i : i + k] for t in texts for k in range(1, order + 1) for i in range(len(t) - k + 1))
    after = Counter()
    for gram, count in n.items():
        if len(gram) > 1:
            after[gram[:-1]] += count
    return pd.DataFrame([(len(g), g, c, after[g]) for g, c in sorted(n.items())], columns=["order", "gram", "n", "context_n"])
