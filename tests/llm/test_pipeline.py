"""The pipeline's stages against brute force on a small folder of planted cases."""

import random
import re

import corpus_pipeline
import pytest
from conftest import SMALL
from test_dedup import brute_exact, rows
from test_near import brute as brute_copies

from textloom.llm import decontaminate
from textloom.llm.common import table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("planted")
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinsrhldcu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    passage = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [passage(30) for _ in range(5)]
    texts = [passage(rng.randrange(20, 160)) for _ in range(60)]
    texts += [texts[3].replace(" ", "\n"), texts[4] + "  ", texts[5]]  # exact copies
    near = texts[6].split()
    texts += [" ".join([*near[:5], near[5].upper(), *near[6:]])]  # equal once lower-cased: a near copy
    for base in (7, 8, 9, 10, 11, 12):  # edited copies of a similarity around 0.8: some are near copies, some are not
        for edits in (1, 2, 3, 4):
            words_of = texts[base].split()
            for _ in range(edits):
                words_of[rng.randrange(len(words_of))] = "edited"
            texts.append(" ".join(words_of))
    texts += [passage(20) + " " + items[0] + " " + passage(20), passage(10) + " " + items[1].replace(items[1].split()[7], "changed")]  # leaks
    texts += [None, "", "12345 ...", "!!!"]  # no language
    docs = [(i, t, "en" if i % 3 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_agree_with_brute_force(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    items = [r["text"] for r in table(spark, folder, "benchmark").collect()]
    lettered = {i: t for i, t in docs.items() if any(c.isalpha() for c in t or "")}
    exact = {i: t for i, t in lettered.items() if (i, True) in {(r[0], r[3]) for r in brute_exact(sorted(lettered.items()))}}
    near = {i: exact[i] for i, c in brute_copies(sorted(exact.items())) if c == i}
    split = lambda t: re.findall(r"\w+", t.lower())

    def leaks(text):
        from test_texts import brute_alignment

        return any(brute_alignment(split(u), split(text)) >= 2 * len(split(u)) * decontaminate.THRESHOLD for u in items)

    clean = {i for i, t in near.items() if not leaks(t)}
    got, df = {}, table(spark, folder, "documents")
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder).cache()
        assert df.columns == columns
        got[name] = {r["doc_id"] for r in df.collect()}
    assert got == {"language_id": set(lettered), "exact_dedup": set(exact), "near_dedup": set(near), "decontaminate": clean}
    assert len(lettered) > len(exact) > len(near) > len(clean) > 50
    final = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in final} == clean and all(r["lossless"] for r in final)


def test_pipeline_keeps_extra_columns_and_takes_empty_tables(spark, folder, tmp_path):
    odd = table(spark, folder, "documents").selectExpr("*", "1 AS id", "2 AS content", "3 AS fp")
    df = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        assert df.columns == odd.columns
    table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, folder, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == []


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "tokens"]
    assert SMALL
