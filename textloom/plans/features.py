"""The flagship query: features of every document, and how usual its length is among good ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile, stats
from ..session import read
from .registry import query
from .text import CHARS_SQL, LETTERS_SQL, SHARE_SQL


@query(f"""{CHARS_SQL},
k AS (SELECT doc_id, c, count(*) AS k, any_value(n) AS n FROM c GROUP BY ALL),
e AS (SELECT doc_id, -sum(k / n::DOUBLE * log2(k / n::DOUBLE)) AS e FROM k GROUP BY doc_id),
s AS (SELECT doc_id, share FROM ({SHARE_SQL} SELECT doc_id, share FROM p))
SELECT doc_id, length(coalesce(text, '')) AS characters, length({LETTERS_SQL}) AS letters, round(coalesce(e, 0), 6) + 0 AS entropy,
  round(share, 6) AS share, CASE WHEN share < 5 THEN 'alarm' WHEN share < 20 THEN 'weak' ELSE 'in range' END AS band
FROM documents LEFT JOIN e USING (doc_id) JOIN s USING (doc_id)""")
def document_features(spark: SparkSession, folder: str) -> DataFrame:
    """Characters, letters and entropy of each document, with the share of good documents at least as long."""
    docs = read(spark, folder, "documents")
    good = docs.join(read(spark, folder, "labels").filter("quality = 1"), "doc_id").select("n_chars")
    rows = stats.empirical_share(profile.whole_profile(docs, ["doc_id", "n_chars"]), good, "n_chars")
    return rows.select("doc_id", "characters", "letters", (F.round("entropy", 6) + 0).alias("entropy"), F.round("share", 6).alias("share"), stats.band(F.col("share")).alias("band"))
