"""Quality, decontamination, pieces, language ID, personal data and chats against brute force and held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import chat, common, decontaminate, langid, pieces, pii, quality, queries

DOC = "doc_id long, text string"
MIDDLE = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "..."), (5, "x"), (5, "x"), (None, "some text"), (6, "words and more words. " * 9000)]


def rows(df):
    return [tuple(r) for r in df.collect()]


def auc(score, label):
    order = np.argsort(score, kind="stable")
    s, y = np.asarray(score)[order], np.asarray(label)[order]
    _, first, n = np.unique(s, return_index=True, return_counts=True)
    rank = np.repeat(first + (n + 1) / 2, n)
    ones = y == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


# ---- quality


def test_quality_ranks_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.op1_quality(spark, MIDDLE).collect()}
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, MIDDLE, "labels").collect()}
    assert len(got) == common.table(spark, MIDDLE, "documents").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert auc(*zip(*held)) > 0.85


def test_quality_does_not_read_held_out_labels(spark):
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(rows(quality.classify(docs, labels))) == sorted(rows(quality.classify(docs, flipped)))


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(EDGES, DOC)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = rows(quality.classify(docs, none))
    assert len(got) == len(EDGES) and all(r[2] == 0.5 and r[3] == 1 for r in got)
    some = spark.createDataFrame([(2, 1), (3, 0), (5, 1), (None, 1), (6, None), (4, 1)], "doc_id long, quality int")
    got = rows(quality.classify(docs.selectExpr("*", "1 AS score", "2 AS x", "3 AS id"), some))
    assert len(got) == len(EDGES) and all(0 <= r[2] <= 1 for r in got)
    assert rows(quality.classify(spark.createDataFrame([], DOC), some)) == []


def test_risk_never_profits_from_negative_part():
    rng = np.random.default_rng(0)
    p = rng.normal(1, 1, (300, 5)).astype(np.float32)
    u = np.concatenate([rng.normal(1, 1, (400, 5)), rng.normal(-1, 1, (600, 5))]).astype(np.float32)
    m = quality.fit(p, u, 0.4)
    s = 1 / (1 + np.exp(-(((u - m.mean) / m.scale) @ m.weights + m.bias)))
    assert auc(s, [1] * 400 + [0] * 600) > 0.97
    assert abs((s > 0.5).mean() - 0.4) < 0.1


def plain_features(text):
    """The features of a text, one character and one pair at a time."""
    kind = lambda c: 0 if ord(c) > 0xFFFF else 6 + quality.PUNCTUATION.index(c) if c in quality.PUNCTUATION else 2 if c in "\r\n" else 1 if c.isspace() else 3 if c.islower() else 4 if c.isupper() else 5 if c.isdigit() else 0
    out = [0.0] * quality.FEATURES
    if not text:
        return out
    c = [kind(x) for x in text]
    for k in c:
        out[k] += 1 / len(c)
    for a, b in zip(c, c[1:]):
        out[quality.CLASSES + ((a * quality.CLASSES + b) * 2654435761 >> 7) % quality.PAIRS] += 1 / (len(c) - 1)
    out = [x**0.5 for x in out]
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    out[-6:] = [np.log1p(len(c)), len(set(words)) / n, sum(k not in (1, 2) for k in c) / n / 10, len(set(lines)) / len(lines), np.log1p(len(c) / len(lines)), np.log1p(n / len(lines))]
    return out


def test_quality_scores_agree_with_brute_force(spark):
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    held = "crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1"
    model = quality.train(docs.filter(f"NOT {held}"), labels.filter(f"NOT {held}"))
    got = {r["doc_id"]: r for r in queries.op1_quality(spark, SMALL).collect()}
    for r in docs.collect():
        x = (np.array(plain_features(r["text"])) - model.mean) / model.scale
        want = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(x, model.weights)) + model.bias)))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-3 and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.5)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_class_prior_comes_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(1)
    y = rng.random(6000) < prior
    unlabelled = rng.normal(size=(6000, 5)) + np.where(y, 1.5, -1.5)[:, None]
    assert abs(quality.class_prior(rng.normal(size=(2000, 5)) + 1.5, unlabelled) - prior) < 0.05
    assert quality.class_prior(unlabelled[:2], unlabelled) == 0.5


def test_quality_reads_positive_labels_only(spark):
    """Negatives' labels count neither for the fit nor for the prior: without them the scores are the same."""
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    assert sorted(rows(quality.classify(docs, labels))) == sorted(rows(quality.classify(docs, labels.filter("quality = 1"))))


def test_fitting_lowers_the_non_negative_risk():
    rng = np.random.default_rng(2)
    y = rng.random(2000) < 0.6
    u, p = rng.normal(size=(2000, 4)) + np.where(y, 1, -1)[:, None], rng.normal(size=(500, 4)) + 1
    m = quality.fit(p, u, 0.6)
    loss = lambda w, b: (lambda s: 0.6 * (1 - s(p)).mean() + max(0, s(u).mean() - 0.6 * s(p).mean()))(lambda x: 1 / (1 + np.exp(-((x - m.mean) / m.scale @ w + b))))
    assert loss(m.weights, m.bias) < 0.6 * loss(np.zeros(4), np.log(0.6 / 0.4))
    assert np.mean(((u - m.mean) / m.scale @ m.weights + m.bias > 0) == y) > 0.95


# ---- decontamination


def brute_alignment(item, words):
    h = np.zeros((len(item) + 1, len(words) + 1), dtype=int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=1, max_size=9), st.lists(st.integers(0, 5), min_size=1, max_size=14)), min_size=1, max_size=6))
def test_alignment_is_smith_waterman(pairs):
    got, _ = decontaminate.align([(np.array(a), np.array(b)) for a, b in pairs])
    assert got.tolist() == [brute_alignment(a, [x or -9 for x in b]) for a, b in pairs]


def leaky(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(rng.randrange(2, 7)))
    common_words = [word() for _ in range(40)]
    items = [(i, " ".join(rng.choice(common_words) if rng.random() < 0.3 else word() for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    docs = []
    for i in range(150):
        body = [rng.choice(common_words) if rng.random() < 0.5 else word() for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            w = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 1 + len(w) // 8)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [word()], [w[k], word()]])
            at = rng.randrange(0, len(body) + 1)
            body[at:at] = w
        docs.append((i, " ".join(body)))
    return docs, items


def test_leaks_agree_with_full_alignment(spark):
    docs, items = leaky()
    extra = [(200, None), (201, ""), (202, items[0][1].upper() + "!"), (202, items[0][1])]
    got = {(r[0], r[1]): r[2] for r in rows(decontaminate.leaks(spark.createDataFrame(docs + extra, DOC), spark.createDataFrame([*items, (50, None), (51, "two words"), (52, "")], "item_id long, text string")))}
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    want = {}
    for i, t in docs + extra:
        for j, u in items:
            score = brute_alignment(split(u), split(t)) / (2 * len(split(u))) if t else 0
            if score >= decontaminate.THRESHOLD:
                want[i, j] = score
    assert got == pytest.approx(want)


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    docs, items = leaky(2)
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(rows(decontaminate.leaks(d, b)))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 400)
    assert sorted(r[:3] for r in rows(decontaminate.leaks(d, b))) == [r[:3] for r in one]


@pytest.mark.parametrize("kinds", [("int", "int"), ("bigint", "string"), ("string", "smallint"), ("int", "date")])
def test_leaks_keep_the_kinds_of_ids(spark, kinds):
    docs, items = leaky(4)
    d, b = (spark.createDataFrame(x, s) for x, s in ((docs, DOC), (items, "item_id long, text string")))
    want = {(str(r[0]), str(r[1]), r[2]) for r in rows(decontaminate.leaks(d, b))}
    cast = lambda c, k: f"CAST({c} AS {k}) AS {c}" if k != "date" else f"date_add(DATE'2020-01-01', CAST({c} AS int)) AS {c}"
    leaks = decontaminate.leaks(d.selectExpr(cast("doc_id", kinds[0]), "text"), b.selectExpr(cast("item_id", kinds[1]), "text"))
    assert [t for _, t in leaks.dtypes[:2]] == list(kinds)
    got = rows(leaks)
    assert len(got) == len(want) and {str(r[0]) for r in got} == {w[0] for w in want}
    if kinds[1] != "date":
        assert {(str(r[0]), str(r[1]), r[2]) for r in got} == want


def test_alignment_windows_are_exact():
    """A chain of seeds far longer than the item is aligned in windows: the best score and place are those of the whole."""
    rng = random.Random(6)
    for _ in range(20):
        item = np.array([rng.randrange(1, 4) for _ in range(9)])
        items = decontaminate.with_seeds(decontaminate.Items({str(k): k for k in range(1, 4)}, None, [item]), np.ones(4))
        words = np.array([rng.randrange(1, 4) for _ in range(700)])
        pairs = [(b, e) for _, b, e in decontaminate.candidates(words, items)]
        assert max(e - b for b, e in pairs) <= decontaminate.WINDOW * len(item)
        scores, ends = decontaminate.align([(item, words[b:e]) for b, e in pairs])
        whole, end = decontaminate.align([(item, words)])
        assert scores.max() == whole[0] == brute_alignment(item, words.tolist())
        assert min(b + e for (b, _), e, s in zip(pairs, ends, scores) if s == scores.max()) == end[0]


def test_a_long_repetitive_text_needs_little_memory():
    import tracemalloc

    phrase = "alpha beta gamma delta epsilon zeta eta theta "
    items = decontaminate.block_of(None, [phrase * 3, "one two three four five six seven"])
    items = decontaminate.with_seeds(items, np.ones(len(items.vocabulary) + 1))
    texts = [phrase * 110_000] + [f"text {i} one two three four five six seven {i}" for i in range(255)]
    assert len(texts[0]) > 5_000_000
    tracemalloc.start()
    best = decontaminate.best_alignments(texts, items, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and best[0, 0][0] == 1.0 and all(best[i, 1][0] == 1.0 for i in range(1, 256))


def test_clean_documents_stay(spark):
    docs, items = leaky(3)
    d, b = spark.createDataFrame(docs, DOC).selectExpr("doc_id", "text", "1 AS item", "2 AS id"), spark.createDataFrame(items, "item_id long, text string")
    gone = {r[0] for r in rows(decontaminate.leaks(d, b))}
    kept = decontaminate.drop_leaked(d, b)
    assert kept.columns == d.columns and {r[0] for r in rows(kept)} == {i for i, _ in docs} - gone
    assert gone and all(i % 3 == 0 for i in gone)
    assert rows(decontaminate.leaks(spark.createDataFrame([], DOC), b)) == []
    assert kept.count() and decontaminate.drop_leaked(d, b.limit(0)).count() == len(docs)


# ---- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def brute_viterbi(unit, scores, worst):
    """Best sum over all segmentations into pieces; single unknown characters cost `worst`."""
    best = [0.0] + [-np.inf] * len(unit)
    for j in range(1, len(unit) + 1):
        for i in range(max(0, j - 64), j):
            s = scores.get(unit[i:j], worst if j == i + 1 else -np.inf)
            best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_segmentation_has_the_best_sum(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    rng = random.Random(2)
    units = ["▁" + "".join(rng.choice("etaoinshrdlé") for _ in range(rng.randrange(1, 14))) for _ in range(300)] + ["▁漢字", "▁\U0001f600x", "▁▁▁", "a", "▁naïve"]
    ids, n = pieces.viterbi([u.encode() for u in units], vocabulary)
    at = 0
    for u, k in zip(units, n.tolist()):
        own, at = ids[at : at + k].tolist(), at + k
        unknown = [c for c in u if c not in scores]
        total = sum(scores[model.id_to_piece(i)] for i in own if i in set(plain)) + len(unknown) * vocabulary.scores[-1]
        assert total == pytest.approx(brute_viterbi(u, scores, vocabulary.scores[-1])), u
        assert sum(model.is_byte(i) for i in own) == sum(len(c.encode()) for c in unknown)


def test_trie_holds_each_piece_and_no_other(vocabulary):
    v = vocabulary

    def look(key):
        state = 0
        for c in key:
            to = v.base[state] + c
            if v.check[to] != state:
                return -1
            state = to
        return v.value[state]

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    for i in range(300, model.get_piece_size(), 37):
        key = model.id_to_piece(i).encode()
        assert look(key) == i
    assert look("▁zqxjv".encode()) == -1 and look(b"\xff\xff") == -1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_round_trip_of_any_text(vocabulary, texts):
    texts = [t.replace("▁", "_") for t in texts]
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    e = pieces.Encoder(vocabulary)
    ids, n = e.encode(texts)
    assert e.decode(ids, n) == texts


def test_round_trip_query(spark):
    got = queries.op3_pieces(spark, SMALL).collect()
    assert len(got) == common.table(spark, SMALL, "documents").count() and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in got)
    odd = {r["doc_id"]: (r["n_tokens"], r["lossless"]) for r in pieces.round_trip(spark.createDataFrame(EDGES, DOC).selectExpr("*", "1 AS id", "2 AS ids", "3 AS doc")).collect()}
    assert odd[1] == odd[2] == (0, True) and all(x[1] for x in odd.values())
    assert rows(pieces.round_trip(spark.createDataFrame([], DOC))) == []
    docs = common.table(spark, SMALL, "documents")
    apart = {r["doc_id"]: (r["ids"], r["text"]) for r in pieces.decode(pieces.encode(docs)).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert apart == {r["doc_id"]: (r["ids"], texts[r["doc_id"]]) for r in got}


# ---- language ID


def test_language_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.op4_langid(spark, MIDDLE).collect()}
    docs = common.table(spark, MIDDLE, "documents").select("doc_id", "text", "lang").collect()
    assert len(got) == len(docs)
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        lettered = any(c.isalpha() for c in d["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered)
        if r["held_out"] and lettered and d["lang"]:
            right.append(r["lang_pred"] == d["lang"])
    assert np.mean(right) > 0.9


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "en" if t == "x" else None) for i, t in EDGES], DOC + ", lang string")
    got = rows(langid.identify(docs.selectExpr("*", "1 AS score", "2 AS id", "3 AS lang_pred")))
    assert len(got) == len(EDGES) and {r[2] for r in got if r[0] in (1, 2, 3, 4)} == {"und"}
    assert rows(langid.identify(docs.limit(0))) == []
    unlabelled = rows(langid.identify(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")))
    assert {r[2] for r in unlabelled} == {"und"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 4


def test_kernel_counts_shared_grams():
    texts = ["abc abd", "Abd!", "xyz", ""]
    codes = langid.every_letter()
    m = langid.landmark_model([langid.present_grams(langid.letter_codes(t, codes)) for t in texts[:3]], codes)
    k, lettered = langid.kernel(m, texts)

    def grams(t):
        t = re.sub(r"[^a-z]+", "0", t.lower())
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    for i, a in enumerate(texts[:3]):
        for j, b in enumerate(texts[:3]):
            assert k[i, j] == pytest.approx(len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))), rel=1e-5)
    assert lettered.tolist() == [True, True, True, False]


def brute_languages(train, texts):
    """Presence kernels in plain sets, and ridge regression on Nystroem features; every training text is a landmark."""

    def grams(t):
        t = re.sub(r"[^\W\d_]+|[\W\d_]+", lambda m: m[0] if m[0][0].isalpha() else "\0", (t or "").lower())
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    k = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    marks, langs = [t for t, _ in train], sorted({x for _, x in train})
    kmm = np.array([[k(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(kmm)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kmm @ root
    w = np.array([1 / sum(y == x for _, y in train) for _, x in train])
    w *= len(train) / w.sum()
    mean = w @ phi / w.sum()
    out = []
    for lang in langs:
        y = np.array([1.0 if x == lang else -1.0 for _, x in train])
        centre = w @ y / w.sum()
        x = phi - mean
        beta = np.linalg.solve(x.T @ (x * w[:, None]) + langid.RIDGE * len(train) * np.eye(x.shape[1]), x.T @ (w * (y - centre)))
        out.append([np.array([k(t, m) for m in marks]) @ root @ beta - mean @ beta + centre for t in texts])
    margin = np.array(out).T
    return [langs[j] for j in margin.argmax(axis=1)], 1 / np.exp(4 * (margin - margin.max(axis=1, keepdims=True))).sum(axis=1)


def test_languages_agree_with_brute_force(spark):
    """Four made languages, two of them of scripts with many letters: predictions and scores of every row."""
    rng = random.Random(5)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "zh": [chr(0x4E00 + i) for i in range(0, 900, 3)], "ko": [chr(0xAC00 + i) for i in range(0, 900, 3)]}
    text = lambda x: " ".join("".join(rng.choice(alphabets[x]) for _ in range(rng.randrange(1, 6))) for _ in range(12)) + rng.choice(["", "!", " 1"])
    docs = [(i, text(x), x) for i in range(48) for x in [rng.choice(sorted(alphabets))]]
    train = [(t, x) for i, t, x in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    assert max(sum(y == x for _, y in train) for _, x in train) <= langid.LANDMARKS
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    langs, scores = brute_languages(train, [t for _, t, _ in docs])
    assert [got[i]["lang_pred"] for i, _, _ in docs] == langs
    assert [got[i]["score"] for i, _, _ in docs] == pytest.approx(scores.tolist(), abs=0.05)  # kernels are of single precision
    assert np.mean([got[i]["lang_pred"] == x for i, _, x in docs if got[i]["held_out"]]) > 0.9


def test_landmarks_are_whole_texts(spark):
    """What is beyond the first characters of the only texts of a language counts."""
    docs = [(i, "x" * 30_000 + " " + ("abc " if i % 2 else "def ") * 50, "one" if i % 2 else "two") for i in range(40)]
    docs += [(100, "abc abc", None), (101, "def def", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert got[100] == "one" and got[101] == "two"


# ---- personal data


def brute_spans(text):
    luhn = lambda d: sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return [(a, b, ("email", "ip", "card", "phone")[k]) for a, k, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="ab1.@-%+ é", max_size=40), st.text(alphabet="0123. -+()", max_size=60), st.from_regex(r"x? ?\+?4[0-9 -]{12,20}(\.[0-9]{1,3}){0,5}", fullmatch=True)))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_personal_data_query(spark):
    got = {r["doc_id"]: r for r in queries.op5_pii(spark, SMALL).collect()}
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        base, r = brute_spans(d["text"] or ""), got[d["doc_id"]]
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        assert {s for s in joined.split(",") if s} <= set(r["spans"].split(","))


def test_contexts_discover_unseen_identifiers(spark):
    docs = [(i, f"please write to user{i}@mail{i % 7}.example today") for i in range(30)]
    docs += [(100, "please write to jdoe42@localhost today"), (101, "version 42@x of the tool"), (102, None), (103, ""), (104, "please write to jdoe42@localhost today"), (104, "please write to jdoe42@localhost today")]
    got = rows(pii.find_personal_data(spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS kind", "2 AS seen", "3 AS id")).select("doc_id", "spans", "n_found"))
    assert sorted(g for g in got if g[0] >= 100) == [(100, "email:16:32", 1), (101, "", 0), (102, "", 0), (103, "", 0), (104, "email:16:32", 1), (104, "email:16:32", 1)]
    assert rows(pii.find_personal_data(spark.createDataFrame([], DOC))) == []


def brute_bootstrap(seen):
    """The graph scores in plain Python; seen: (kind, filler, patterns)."""
    form = lambda f: "at" if "@" in f else "number" if re.search(r"^[+(]?[0-9][0-9 ().:/-]*$", f) else "mixed"
    fillers, base = {}, {}
    for kind, filler, patterns in seen:
        for p in patterns:
            fillers.setdefault(p, set()).add(filler)
        if kind:
            base[filler] = max(base.get(filler, ""), kind)
    all_fillers = {f for fs in fillers.values() for f in fs}
    prior = {(f, k): 1.0 for f, k in base.items()} | {(f, pii.SECRET): pii.PRIOR for f in all_fillers - set(base) if re.search(pii.SECRET_FORM, f)}
    forms = {(form(f), k) for f, k in prior}
    scores = dict(prior)
    for _ in range(pii.ROUNDS):
        trust = {}
        for p, fs in fillers.items():
            for k in (*pii.KINDS, pii.SECRET):
                known = [scores[f, k] for f in fs if (f, k) in scores]
                if len(known) >= pii.SUPPORT and sum(known) / (len(fs) + pii.DOUBT) >= pii.PATTERN_SCORE:
                    trust[p, k] = sum(known) / (len(fs) + pii.DOUBT)
        scores = dict(prior)
        for f in all_fillers - set(base):
            for k in (*pii.KINDS, pii.SECRET):
                mine = [min(0.999, trust[p, k]) for p, fs in fillers.items() if f in fs and (p, k) in trust]
                if mine and (form(f), k) in forms:
                    score = 1 - (1 - prior.get((f, k), 0.0)) * float(np.prod([1 - t for t in mine]))
                    if score >= pii.INSTANCE_SCORE:
                        scores[f, k] = score
    return {(f, k): s for (f, k), s in scores.items() if s >= pii.INSTANCE_SCORE and f not in base}


def identifier_texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("lorem ipsum dolor sit amet".split())
    values = {
        "token": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([40, 32, 40, 8]))), "mail": lambda: f"u{rng.randrange(99)}@m{rng.randrange(3)}{rng.choice(['.example', ''])}",
        "host": lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), "part": lambda: f"no-{rng.randrange(50)}",
    }
    texts = []
    for i in range(120):
        label = rng.choice(sorted(values))
        lead = rng.choice([f'{label} = "%s"', f"{label}: %s,", f"{word()} {label} %s {word()}"])
        texts.append((i, f"{word()} {word()} {lead % values[label]()} {word()}. {word()}" + (f" {values['token']()}" if rng.random() < 0.1 else "")))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graph_scores_agree_with_brute_force(spark, seed):
    seen = [(s["kind"], s["filler"], s["patterns"]) for _, t in identifier_texts(seed) for s in pii.found(t)[1]]
    got = {(r["filler"], r["kind"]): r["score"] for r in pii.bootstrap(spark.createDataFrame(seen, "kind string, filler string, patterns array<string>")).collect()}
    want = brute_bootstrap(seen)
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_secrets_are_found_by_their_contexts(spark):
    """Values that no pattern and no seed form tells: the contexts of seeds give them away; lone ones stay."""
    rng = random.Random(4)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    docs = [(i, f'so the token = "{key(40)}" it is') for i in range(20)]
    docs += [(100, 'so the token = "Pa55-w0rd" it is'), (101, "commit " + key(40) + " of them"), (102, f'A TOKEN = "{key(40).upper()}"!!'), (103, "chapter 7b of it")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(docs, DOC)).collect()}
    assert got[100] == "secret:16:25" and got[101] == "" and got[102] == "secret:11:51" and got[103] == ""
    assert all(got[i] == "secret:16:56" for i in range(20))


def test_planted_secrets_are_found(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in common.table(spark, MIDDLE, "documents").collect()}
    want = {(i, m.start(1), m.end(1)) for i, t in docs.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t, re.I)}
    spans = [(r["doc_id"], s.split(":")) for r in queries.op5_pii(spark, MIDDLE).collect() for s in r["spans"].split(",") if s.startswith(pii.SECRET)]
    got = {(i, int(a), int(b)) for i, (_, a, b) in spans}
    assert want and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_whole_words_make_patterns():
    """Words of any length count whole: equal ones are equal, and others that share a long beginning are not."""
    a, b = ("x" * 500 + c for c in "ab")
    of = lambda w: pii.contexts(f"{w} 1.2.3.4 {w}", 501 + 0, 508)
    assert of(a) == of(a) and not set(of(a)) & set(of(b)) and max(map(len, of(a))) < 120
    assert pii.contexts("", 0, 0) == ["^ _", "^ ^ _", "^ _ $"]


# ---- chats


def chat_digest(turns):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_chats_read_back_from_their_format(spark):
    got = {r[0]: tuple(r[1:5]) for r in rows(queries.op9_chat(spark, SMALL))}
    want = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in common.table(spark, SMALL, "conversations").orderBy("conv_id", "turn", "role", "text").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert got == {k: chat_digest(v) for k, v in want.items()}


def test_conversations_become_a_log_of_deltas_edits_and_regenerations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "good day"), (2, 0, None, None), (2, 0, "assistant", "")], "conv_id int, turn int, role string, text string")
    log = chat.messages_as_events(turns.selectExpr("*", "1 AS step", "2 AS k", "3 AS branch", "4 AS seq"))
    got = {k: sorted((r["seq"], r["kind"], r["text"]) for r in log.filter(f"conv_id = 1 AND turn = {k}").collect()) for k in (0, 1)}
    assert got[0] == [(0, "message", "he"), (1, "edit", "hello")]
    assert got[1] == [(8, "message", ""), (9, "delta", "good"), (10, "regenerate", ""), (11, "delta", "good"), (12, "delta", " day")]
    assert sorted(rows(chat.fold(log).select("conv_id", "turn", "role", "text"))) == [(1, 0, "user", "hello"), (1, 1, "assistant", "good day"), (2, 0, "assistant", ""), (2, 0, "user", "")]


CHAT = "conv_id long, seq long, kind string, turn long, branch int, role string, text string"


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 1, "message", 0, 1, "user", "hi"), (1, 2, "delta", 1, 1, "assistant", "He"), (1, 3, "delta", 1, 1, None, "llo"),
        (1, 4, "regenerate", 1, 1, None, None), (1, 5, "delta", 1, 1, None, "Good "), (1, 6, "delta", 1, 1, None, "day"),
        (1, 7, "edit", 0, 1, None, "hello"), (1, 8, "message", 2, 1, "user", "gone"), (1, 9, "delete", 2, 1, None, None),
        (2, 1, "delta", 0, 1, "assistant", "a"), (2, 2, "edit", 0, 1, None, "b"), (2, 3, "delta", 0, 1, None, "c"), (2, 4, None, 1, 1, None, None),
        (None, 1, "message", None, 1, "user", "nobody"),
    ]
    got = rows(chat.fold(spark.createDataFrame(random.Random(1).sample(log, len(log)), CHAT)).select("conv_id", "turn", "role", "text"))
    assert sorted(got, key=str) == sorted([(1, 0, "user", "hello"), (1, 1, "assistant", "Good day"), (2, 0, "assistant", "bc"), (2, 1, "user", ""), (None, None, "user", "nobody")], key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a]b", "", "x<&[y"]), st.text(alphabet="ab<[]&;/slINST amp", max_size=30)), max_size=8))
def test_any_turns_come_back(turns):
    formatted = "".join(chat.render_turn(r, t)[0] for r, t in turns)
    assert list(chat.read_turns(chat.BEGIN + formatted)) == turns


def test_long_conversations_in_parts(spark):
    talk = [(7, i, "assistant" if i % 2 else "user", f"[/INST] turn {i} </s> &lt; " + "x" * (i % 5)) for i in range(300)] + [(8, 0, None, None), (None, 0, "user", "n"), (8, 0, "user", "tie")]
    table = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    rendered = chat.format_chats(chat.messages_as_events(table)).cache()
    assert rendered.filter("conv_id = 7").count() == -(-300 // chat.PART_TURNS)
    got = {r[0]: tuple(r[1:5]) for r in rows(chat.digests(rendered))}
    assert got == {7: chat_digest([(r, t) for _, _, r, t in talk[:300]]), 8: chat_digest([("user", ""), ("user", "tie")]), None: chat_digest([("user", "n")])}
    assert rows(chat.digests(chat.format_chats(chat.messages_as_events(table.limit(0))))) == []


def test_repetitive_text_against_items_that_share_a_phrase():
    """Every place of the phrase meets every item: memory stays bounded, and lots don't change the stretches."""
    import tracemalloc

    phrase = "alpha beta gamma delta".split()
    texts = [" ".join([f"w{i}x{j}" for j in range(12)] + phrase + [f"v{i}x{j}" for j in range(12)]) for i in range(60)]
    items = decontaminate.block_of(pa.array(range(60)), texts)
    counts = np.ones(len(items.vocabulary) + 1)
    counts[0] = 1e6
    items = decontaminate.with_seeds(items, counts)
    doc = " ".join([*phrase * 3000, texts[5], *phrase * 3000])
    tracemalloc.start()
    best = decontaminate.best_alignments([doc], items, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(best) == 60 and best[0, 5][0] == 1.0 and peak < 200 << 20


@pytest.mark.parametrize("places", [1, 7, 1 << 20])
def test_stretches_are_the_same_in_any_lots(monkeypatch, places):
    rng = random.Random(places)
    words = ["".join(rng.choice("ab") for _ in range(3)) for _ in range(6)]
    items = decontaminate.block_of(pa.array(range(8)), [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 20))) for _ in range(8)])
    items = decontaminate.with_seeds(items, np.append(1e6, np.ones(len(items.vocabulary))))
    ids = decontaminate.word_ids(" ".join(rng.choice([*words, "other"]) for _ in range(400)), items.vocabulary)
    at, code = decontaminate.codes(ids, len(items.vocabulary) + 1)
    hits = {(int(items.item[p]), int(a - items.offset[p])) for a, c in zip(at, code) for k in [int(np.searchsorted(items.seeds, c))] if k < len(items.seeds) and items.seeds[k] == c for p in range(items.first[k], items.first[k + 1])}
    want = []
    for item, diagonal in sorted(hits):
        if want and want[-1][0] == item and diagonal - want[-1][2] <= len(items.words[item]) // 2:
            want[-1][2] = diagonal
        else:
            want.append([item, diagonal, diagonal])
    monkeypatch.setattr(decontaminate, "PLACES", places)
    assert decontaminate.stretches(ids, items).tolist() == want and want
