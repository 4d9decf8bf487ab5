"""Reading chapter files and JSON documents into tables; what is missing or malformed becomes rows, not crashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.markup import frontmatter, frontmatter_list, without_frontmatter

#: Chinese numerals below 10, and the powers of ten that follow a digit.
DIGITS, TENS = "零一二三四五六七八九", {"十": 10, "百": 100, "千": 1000}
HEADING = r"^第([零〇一二两三四五六七八九十百千0-9]+)[回章]"


def whole_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, body): each text file of a folder as a row."""
    raw = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    at = F.input_file_name()
    return raw.select(at.alias("path"), F.element_at(F.split(at, "/"), -1).alias("name"), F.col("value").alias("body"))


def chapter_files(spark: SparkSession, path: str, book: str, pattern: str = "*.md") -> DataFrame:
    """(book, chapter, name, body): files with a number in their names; others are left out."""
    number = F.expr("try_cast(regexp_extract(name, '([0-9]+)', 1) AS INT)")
    return whole_texts(spark, path, pattern).select(F.lit(book).alias("book"), number.alias("chapter"), "name", "body").filter("chapter is not null")


def collection_problems(chapters: DataFrame, first: int, last: int) -> DataFrame:
    """(chapter, problem): 'missing' numbers of the range, numbers that are 'repeated' or 'outside' it, and an order in
    the front matter that is not the file's number."""
    spark = chapters.sparkSession
    wanted = spark.range(first, last + 1).select(F.col("id").cast("int").alias("chapter"))
    missing = wanted.join(chapters.select("chapter"), "chapter", "left_anti").withColumn("problem", F.lit("missing"))
    repeated = chapters.groupBy("chapter").count().filter("count > 1").select("chapter", F.lit("repeated").alias("problem"))
    outside = chapters.filter(~F.col("chapter").between(first, last)).select("chapter", F.lit("outside").alias("problem")).distinct()
    order = F.expr("try_cast(order_text AS INT)")
    stated = chapters.withColumn("order_text", F.regexp_extract(frontmatter(F.col("body")), r"(?m)^order:\s*([0-9]+)\s*$", 1))
    unordered = stated.filter("order_text != ''").filter(order != F.col("chapter")).select("chapter", F.lit("order").alias("problem")).distinct()
    return missing.unionByName(repeated).unionByName(outside).unionByName(unordered)


def chapter_rows(chapters: DataFrame) -> DataFrame:
    """chapters with title, characters, locations, has_frontmatter and the text after the front matter."""
    body = F.col("body")
    text = without_frontmatter(body)
    return chapters.select(
        "book", "chapter", F.regexp_extract(frontmatter(body), r"(?m)^title:\s*[\"']?(.+?)[\"']?\s*$", 1).alias("title"),
        frontmatter_list(body, "characters").alias("characters"), frontmatter_list(body, "locations").alias("locations"),
        (F.startswith(body, F.lit("---\n")) & (text == body)).alias("unclosed_frontmatter"), text.alias("text"),
    )


def chinese_number(text: Column) -> Column:
    """The value of a numeral such as 一百零八 or 12; null if it is none. A fold over its characters."""
    digit = F.create_map(*(F.lit(x) for i, c in enumerate(DIGITS) for x in (c, i)), F.lit("〇"), F.lit(0), F.lit("两"), F.lit(2))
    ten = F.create_map(*(F.lit(x) for pair in TENS.items() for x in pair))

    def step(a: Column, c: Column) -> Column:
        d, t = F.try_element_at(digit, c), F.try_element_at(ten, c)
        return F.struct(
            F.when(t.isNotNull(), a["total"] + F.greatest(a["open"], F.when(a["seen"], F.lit(0)).otherwise(F.lit(1))) * t).otherwise(a["total"]).alias("total"),
            F.when(t.isNotNull(), 0).otherwise(F.coalesce(d, F.lit(0))).alias("open"),
            d.isNotNull().alias("seen"),
        )

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("open"), F.lit(False).alias("seen"))
    folded = F.aggregate(F.split(text, ""), start, step, lambda a: a["total"] + a["open"])
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).when(text.rlike("^[零〇一二两三四五六七八九十百千]+$"), folded)


def split_chapters(books: DataFrame, key: str = "book", text: str = "body") -> DataFrame:
    """(book, chapter, start, end, body): one long text a row, cut at its heading lines; the first heading of a number wins.

    What stands before the first heading is chapter 0, so the parts of a book joined in order are the book.
    """
    lines = books.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    number = chinese_number(F.nullif(F.regexp_extract(F.trim("value"), HEADING, 1), F.lit("")))
    headed = lines.withColumn("chapter", number)
    first = headed.filter("chapter is not null").groupBy(key, "chapter").agg(F.min("line").alias("line"))
    marked = lines.join(first, [key, "line"], "left")
    current = F.coalesce(F.last("chapter", ignorenulls=True).over(Window.partitionBy(key).orderBy("line")), F.lit(0))
    parts = marked.withColumn("chapter", current).groupBy(key, "chapter").agg(
        F.min("line").alias("start"), (F.max("line") + 1).alias("end"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l")
    )
    return parts.select(key, "chapter", "start", "end", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("body"))


def heading_problems(parts: DataFrame, key: str = "book") -> DataFrame:
    """(key, chapter, problem): chapters that come 'out of order' or leave a 'gap' before them."""
    w = Window.partitionBy(key).orderBy("start")
    before = F.lag("chapter").over(w)
    problem = F.when(F.col("chapter") < before, "out of order").when(F.col("chapter") > before + 1, "gap")
    return parts.withColumn("problem", problem).filter("problem is not null").select(key, "chapter", "problem")


def titled(texts: DataFrame, key: str, text: str = "body") -> DataFrame:
    """(key, title, text): the first line that is not blank is the title, null unless it is a heading; the rest is the text."""
    parts = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    first = F.trim(F.get(parts, F.lit(0)))
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "\n")
    return texts.select(key, F.when(first.rlike(HEADING), first).alias("title"), rest.alias("text"))


def json_documents(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """(name, content_hash, value, corrupt): JSON files by a schema; what cannot be read stays as `corrupt` text."""
    rows = whole_texts(spark, path, pattern)
    parsed = F.from_json("body", f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    out = rows.select("name", F.sha2("body", 256).alias("content_hash"), parsed.alias("value"), "body")
    return out.select("name", "content_hash", F.col("value").dropFields("__corrupt").alias("value"), F.when(F.col("value.__corrupt").isNotNull() | F.col("value").isNull(), F.col("body")).alias("corrupt"))
