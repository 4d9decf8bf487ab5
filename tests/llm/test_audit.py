"""The filter audit against orders run one by one over documents."""

import random
import re
from collections import defaultdict
from itertools import permutations

import compare
from conftest import SMALL
from test_dedup import ordered, rows

from textloom.llm import filter_audit, queries

DOC, LABEL = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", (True, 0)), (i is None, i or 0))

    def fails(i, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield "A" if len(w) < 200 else ""
        yield "B" if 100 * len(set(w)) < 50 * len(w) else ""
        yield "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
        yield "D" if re.search("[#$%&*|]", text) else ""
        yield "E" if first[text] != (i is None, i or 0) else ""

    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, s in docs:
        parts[s or ""].append((i, set(fails(i, t or "")) - {""}))
    out, shapley = [], defaultdict(int)
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                own = [m for m in members if f in m[1]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), len(own) - len(gone), sum(m[1] == {f} for m in own), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)))
    return [(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out]


def made(seed=5, n=160):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        words = [rng.choice("abcdefgh") + str(rng.randrange(rng.choice([3, 4000]))) for _ in range(rng.choice([150, 199, 200, 260]))]
        text = " ".join(words) + rng.choice(["", "", " $", " | #"]) + " CAPITALS" * rng.choice([0, 0, 9])
        docs.append((i, text, rng.choice(["x", "y", None, ""])))
    return docs + [(1000 + k, docs[k % min(40, n)][1], rng.choice("xz")) for k in range(80)]


EDGES = [(3000, None, None), (3001, "", "only"), (3002, " \t\n", "only"), (3003, "Word " * 60000, "long"), (3003, "Word " * 60000, "long"), (None, "Word " * 60000, "long"), (None, None, None), (3004, "É" * 100 + "AB", "é")]


def test_audit_agrees_with_orders_run_one_by_one(spark):
    docs = made() + EDGES
    rng = random.Random(6)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i, _, _ in docs if rng.random() < 0.7] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    got = filter_audit.audit(spark.createDataFrame(docs, DOC).repartition(5), spark.createDataFrame(labels, LABEL))
    assert got.columns == NAMES and len(got.schema.fields) == 10
    assert ordered(rows(got)) == ordered(brute(docs, labels))


def test_hot_text_counts_whole(spark):
    """A third of the rows have one text; all but the smallest id fail E."""
    docs = [(i, "same", "s") for i in range(100, 400)] + [(i, f"other {i}", "s") for i in range(400, 1000)]
    got = filter_audit.audit(spark.createDataFrame(docs, DOC), spark.createDataFrame([], LABEL)).filter("filter_order = 'EABCD' AND step = 1").first()
    assert (got["removed"], got["kept"], got["good_lost"]) == (299, 601, 0)


def test_shapley_values_share_what_all_filters_remove(spark):
    docs = spark.createDataFrame(made(7), DOC)
    got = filter_audit.audit(docs, spark.createDataFrame([], LABEL)).filter("filter_order = 'ABCDE'")
    by = got.selectExpr("part", "shapley", "removed").groupBy("part").sum("shapley", "removed").collect()
    assert by and all(r[1] == filter_audit.SCALE * r[2] for r in by)


def test_empty_tables_and_clashing_columns(spark):
    assert rows(filter_audit.audit(spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL))) == []
    odd = spark.createDataFrame(made(8, 20), DOC)
    clash = odd.selectExpr("*", "1 AS part", "2 AS id", "3 AS mask", "'x' AS digest", "4 AS n", "5 AS good", "6 AS quality")
    marks = spark.createDataFrame([(1, 1, 0)], LABEL)
    assert ordered(rows(filter_audit.audit(clash, marks.selectExpr("*", "7 AS text", "8 AS good", "9 AS part")))) == ordered(rows(filter_audit.audit(odd, marks)))


def test_query_agrees_with_sql(spark, duck):
    assert compare.difference(spark, duck, SMALL, queries.op11_filter_audit, filter_audit.ORACLE) == ""
