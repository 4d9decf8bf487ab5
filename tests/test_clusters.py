"""Clusters against a plain version in NumPy."""

import numpy as np

from textloom.operators import clusters


def plain(x, k):
    """Labels and mean silhouette of k clusters, numbered by their first members."""
    far = [int(np.argmax(((x - x.mean(0)) ** 2).sum(1)))]
    while len(far) < k:
        d = ((x[:, None] - x[far][None]) ** 2).sum(-1).min(1)
        d[far] = -1
        far.append(int(np.argmax(d)))
    c, label = x[far], None
    while True:
        new = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        c = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
    order = list(dict.fromkeys(label.tolist()))
    label = np.array([order.index(v) for v in label])
    d, s = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            s.append(0)
            continue
        a, b = d[i][own].sum() / (own.sum() - 1), min(d[i][label == o].mean() for o in set(label) - {label[i]})
        s.append((b - a) / max(a, b))
    return label, float(np.mean(s))


def test_clusters_and_choice_match_a_plain_version(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(m, 0.4, (9, 3)) for m in ((0, 0, 0), (3, 0, 1), (0, 4, 2))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, point array<double>")
    got = {row["k"]: row for row in clusters.choices(points, "k", range(2, 5)).collect()}
    for k in (2, 3):
        label, s = plain(x, k)
        assert [row["cluster"] for row in clusters.clustered(points, "k", k).orderBy("k").collect()] == label.tolist()
        assert abs(got[k]["silhouette"] - s) < 2e-6 and got[k]["smallest"] == np.bincount(label).min()
    assert [k for k, row in got.items() if row["chosen"]] == [3]


def test_blocks_give_the_same_silhouettes(spark):
    r = np.random.default_rng(5)
    points = spark.createDataFrame([(i, r.normal(size=2).tolist(), i % 3) for i in range(40)], "k int, point array<double>, cluster int")
    one, many = ({row["k"]: round(row["silhouette"], 9) for row in clusters.silhouettes(points, "k", b).collect()} for b in (100, 7))
    assert one == many and len(one) == 40


def test_equal_points_and_empty_tables_have_a_result(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "k int, point array<double>")
    assert [tuple(r)[2:] for r in clusters.choices(same, "k", range(2, 3)).collect()] == [(4, False, False)]
    assert clusters.clustered(same.limit(0), "k", 2).count() == 0


def test_scales_are_robust_and_values_cut(spark):
    rows = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)] + [(9, [1e6, 7.0]), (10, None)], "k int, v array<double>")
    got = {r["k"]: r["point"] for r in clusters.clipped(rows, "k", "v").collect()}
    assert got[9] == [5.0, 0.0] and abs(got[0][0] + 2.5 / (1.4826 * 1.5)) < 1e-9 and len(got) == 6
