"""Collections by book and published versions on small folders."""

import pytest
from pyspark.sql import functions as F

from textloom.sources import collections, published


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_books_are_read_in_one_scan_and_none_twice(spark, tmp_path):
    for place, body in (("a/1-x.md", "one"), ("a/deep/2 y.md", "two"), ("a/own/3.md", "three"), ("b/1-x.md", "eins"), ("b/skip.txt", "no")):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(body)
    rows = collections.collections(spark, {"a": f"{tmp_path}/a", "own": f"{tmp_path}/a/own", "b": f"{tmp_path}/b"})
    assert {(r["book"], r["source_id"], r["body"]) for r in rows.collect()} == {("a", "1-x", "one"), ("a", "deep/2 y", "two"), ("own", "3", "three"), ("b", "1-x", "eins")}
    assert rows.count() == 4 and plan(rows).count("FileScan") == 1


def test_a_book_is_pruned_by_folder_and_a_chapter_by_row_groups(spark, tmp_path):
    path = str(tmp_path / "stored")
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "small").otherwise("large").alias("book"), F.format_string("%06d", "id").alias("source_id"), F.sha2(F.col("id").cast("string"), 512).alias("body"))
    collections.store(rows, path, 1 << 16)
    assert collections.load(spark, path).count() == 60_000
    book = collections.load(spark, path, "small")
    assert "PartitionFilters: [isnotnull(book" in plan(book) and book.count() == 20_000
    assert {"book=small" in f for f in (r[0] for r in book.select(F.input_file_name()).distinct().collect())} == {True}
    one = collections.load(spark, path, "small", "030000")
    assert "EqualTo(source_id,030000)" in plan(one) and [r["body"] for r in one.collect()] == [rows.filter("source_id = '030000'").first()["body"]]
    import pyarrow.parquet as pq

    groups = [(f.stem, g.column(0).statistics.min, g.column(0).statistics.max) for f in (tmp_path / "stored" / "book=small").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert len(groups) > 1 and sum(lo <= "030000" <= hi for _, lo, hi in groups) == 1
    assert collections.load(spark, path, "none").count() == 0 and collections.load(spark, path, "large", "030000").count() == 0


def test_what_is_named_must_be_there(spark):
    images = spark.createDataFrame([(1, "a.png"), (1, "b.png"), (1, "b.png"), (2, None)], "doc int, name string")
    assert [tuple(r) for r in collections.missing_images(images, spark.createDataFrame([("a.png",)], "name string"), "name", ["doc"]).collect()] == [(1, "b.png")]
    text = "voice: 'v one'\n# note: x\nrate:  \"+5%\"\nbroken\nvoice: last: one\r\nother: 1"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(collections.key_values(F.col("t")).alias("all"), collections.key_values(F.col("t"), ("rate",)).alias("some")).collect()
    assert got[0]["all"] == {"rate": "+5%", "voice": "last: one", "other": "1"} and got[0]["some"] == {"rate": "+5%"} and got[1]["all"] == {}
    index = spark.createDataFrame([("a", "a.json", 1), ("b", "b.json", 1), ("c", "c.json", 1), ("d", "d.json", 2), ("e", "e.json", 1), ("e", "f.json", 1)], "id string, file string, version int")
    cards = spark.createDataFrame([("a.json", "a", 1, "{}"), ("c.json", "x", 1, "{}"), ("d.json", "d", 1, "{}"), ("e.json", "e", 1, "{}"), ("z.json", "z", 1, "{}")], "file string, card_id string, card_version int, body string")
    assert sorted((r["id"], r["problem"] or "") for r in collections.catalog(index, cards).collect()) == [("a", ""), ("b", "no file"), ("c", "other id"), ("d", "other version"), ("e", "listed twice"), ("e", "listed twice"), ("z", "not listed")]


def test_versions_are_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "root")
    assert published.current(spark, root) is None
    with pytest.raises(LookupError):
        published.load(spark, root, "a")
    one, two = spark.range(3), spark.range(5)
    assert published.publish({"a": one, "b": one}, root) == 1 and published.load(spark, root, "a").count() == 3
    broken = spark.range(5).select(F.when(F.col("id") < 9, F.raise_error(F.lit("broken"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        published.publish({"a": two, "b": broken}, root)
    assert published.current(spark, root) == 1 and published.load(spark, root, "a").count() == published.load(spark, root, "b").count() == 3
    assert published.publish({"a": two}, root, on=1) == 2
    assert published.load(spark, root, "a").count() == 5 and published.load(spark, root, "b").count() == 3 and published.load(spark, root, "a", 1).count() == 3
    with pytest.raises(published.Conflict):
        published.publish({"a": one}, root, on=1)
    with pytest.raises(published.Conflict):
        published._commit(spark, root, 2, {"a": "elsewhere"}, None)
    assert published.rollback(spark, root, 1) == 3 and published.load(spark, root, "a").count() == 3
    assert {(r["version"], r["restored"]) for r in published.manifests(spark, root).collect()} == {(1, None), (2, None), (3, 1)}
    assert published.publish({"a": two}, root) == 4 and len(list((tmp_path / "root" / "tables" / "a").iterdir())) == 2
    with pytest.raises(LookupError):
        published.rollback(spark, root, 77)


def test_what_a_lost_driver_left_is_not_read(spark, tmp_path):
    from textloom.sources.sinks import content_hash

    root, rows = str(tmp_path / "root"), spark.range(4)
    left = tmp_path / "root" / "tables" / "a" / content_hash(rows)
    left.mkdir(parents=True)
    published.publish({"a": rows}, root)
    assert published.load(spark, root, "a").count() == 4
    (tmp_path / "root" / "manifests" / f"v{2:0{published.WIDTH}d}").mkdir()
    with pytest.raises(published.Conflict):
        published.publish({"a": spark.range(1)}, root)
    assert published.current(spark, root) == 1 and published.abandon(spark, root) == 2 and published.publish({"a": spark.range(1)}, root) == 3
    assert published.load(spark, root, "a", 2).count() == 4 and published.load(spark, root, "a").count() == 1
