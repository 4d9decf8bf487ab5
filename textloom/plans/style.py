"""Queries of the style model, its audit and the normal form of texts."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ngrams, normal, stats, style
from ..session import read
from .registry import query
from .text import ALPHAS, CHARS_SQL, FOLDS, SEGMENTS_SQL, _alpha_sql

#: What is counted in the tables' texts; bracketed parts stand for speech.
LATIN = style.Style(
    letter=r"\p{L}", ends=".!?;\n", clauses=",.;:!?\n", opening="([{", closing=")]}", functions=("the", "and", "of", "de", "la", "und", "password"),
    formulas=("license", "example"), punctuation=(",", ".", ";", ":", "!", "?", "(", ")", "--"), grams=(24, 32, 32), order=3,
)

SPLIT_SQL = "('0x' || substring(md5(doc_id::VARCHAR), 1, 6))::BIGINT % 3"


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return stats.hash_split(read(spark, folder, "documents"), "doc_id")


def _marks(chars: str) -> str:
    return "(" + ", ".join("chr(10)" if c == "\n" else f"'{c}'" for c in chars) + ")"


def _record_sql() -> str:
    """CTEs up to r (doc_id, feature, value) over all documents, with the vocabulary of the training documents."""
    tokens = [(kind, t) for kind, own in (("function", LATIN.functions), ("formula", LATIN.formulas), ("punctuation", LATIN.punctuation)) for t in own]
    listed = ", ".join(f"('{kind}.{t}', '{t}')" for kind, t in tokens)
    grams = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, unnest(list_transform(range(1, n - {k} + 2), lambda i: substring(text, i, {k}))) AS g FROM d WHERE n >= {k}" for k in (1, 2, 3))
    top = " ".join(f"WHEN {k} THEN {most}" for k, most in enumerate(LATIN.grams, 1))
    sentence, clause = (SEGMENTS_SQL.format(f"[{cut}]+".replace("\n", r"\n")) for cut in (LATIN.ends, LATIN.clauses))
    one = lambda name, value: f"SELECT doc_id, '{name}' AS feature, {value} AS value"
    of = lambda p, c="s": f"coalesce(list_aggregate({c}, 'quantile_cont', {p}), 0)"
    plain = [
        (one("structure.characters_log", "ln(1 + n)"), "d"), (one("structure.letter_ratio", "CASE WHEN n > 0 THEN m / n::DOUBLE ELSE 0 END"), "d"),
        (one("structure.dialogue_ratio", "CASE WHEN m > 0 THEN coalesce(inside, 0) / m::DOUBLE ELSE 0 END"), "d LEFT JOIN v USING (doc_id)"),
        (one("structure.dialogue_turns_per_1000", "CASE WHEN m > 0 THEN coalesce(turns, 0) * 1000 / m::DOUBLE ELSE 0 END"), "d LEFT JOIN v USING (doc_id)"),
        (one("sentence.mean", "coalesce(list_avg(s), 0)"), "f"), (one("sentence.p25", of(0.25)), "f"), (one("sentence.median", of(0.5)), "f"), (one("sentence.p75", of(0.75)), "f"), (one("sentence.p90", of(0.9)), "f"),
        (one("clause.mean", "coalesce(list_avg(c), 0)"), "f"), (one("clause.median", of(0.5, "c")), "f"),
        (one("lexical.mattr", "coalesce(m, 0)"), "documents LEFT JOIN mattr USING (doc_id)"), (one("lexical.entropy", "coalesce(e, 0)"), "documents LEFT JOIN entropy USING (doc_id)"),
        (one("lexical.unique_ratio", "CASE WHEN m > 0 THEN u / m::DOUBLE ELSE 0 END"), "d"),
    ]
    return rf"""{CHARS_SQL},
p AS (SELECT doc_id, c, i, n, coalesce(lag(i) OVER (PARTITION BY doc_id, c ORDER BY i), -1) AS p FROM c),
mattr AS (SELECT doc_id, CASE WHEN any_value(n) > 100
    THEN sum(greatest(0, least(i, n - 100) - greatest(0, i - 99, p + 1) + 1)) / (100.0 * (any_value(n) - 99))
    ELSE count(DISTINCT c) / any_value(n)::DOUBLE END AS m FROM p GROUP BY doc_id),
kk AS (SELECT doc_id, c, count(*) AS k, any_value(n) AS n FROM c GROUP BY ALL),
entropy AS (SELECT doc_id, -sum(k / n::DOUBLE * log2(k / n::DOUBLE)) AS e FROM kk GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(documents.text, '') AS text, length(coalesce(documents.text, '')) AS n, length(l.t) AS m, len(list_distinct(string_split(l.t, ''))) AS u, {SPLIT_SQL} AS part FROM documents JOIN l USING (doc_id)),
f AS (SELECT doc_id, {sentence} AS s, {clause} AS c FROM documents),
o AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM d WHERE n > 0),
w AS (SELECT *, sum(CASE WHEN c IN {_marks(LATIN.opening)} THEN 1 WHEN c IN {_marks(LATIN.closing)} THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM o),
x AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM w),
v AS (SELECT doc_id, count(*) FILTER (depth > 0 AND regexp_matches(c, '\p{{L}}')) AS inside, count(*) FILTER (depth = 1 AND c IN {_marks(LATIN.opening)}) AS turns FROM x GROUP BY doc_id),
g AS ({grams}),
gn AS (SELECT doc_id, k, g, count(*) AS c FROM g GROUP BY ALL),
gt AS (SELECT k, g, sum(c) AS c FROM gn JOIN d USING (doc_id) WHERE part = 0 AND NOT regexp_matches(g, '^\s+$') GROUP BY ALL),
gr AS (SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY c DESC, g) AS rank FROM gt),
gv AS (SELECT k, g FROM gr WHERE rank <= CASE k {top} END),
tk AS (SELECT * FROM (VALUES {listed}) AS t(feature, token)),
r AS (
  {" UNION ALL ".join(f"{select} FROM {table}" for select, table in plain)}
  UNION ALL SELECT doc_id, feature, CASE WHEN m > 0 THEN 1000.0 * ((n - length(replace(text, token, ''))) / length(token)) / m ELSE 0 END FROM d, tk
  UNION ALL SELECT d.doc_id, concat('ngram.', gv.k, '.', gv.g), 1000.0 * coalesce(gn.c, 0) / greatest(1, n - gv.k + 1) FROM d CROSS JOIN gv LEFT JOIN gn ON gn.doc_id = d.doc_id AND gn.k = gv.k AND gn.g = gv.g)
"""


RECORD_SQL = _record_sql()


def _records(spark: SparkSession, folder: str, training: bool = False) -> tuple[DataFrame, list[str]]:
    """The records of all documents, or of the training documents alone, and the features' names."""
    docs = _split(spark, folder)
    own = docs.filter("split = 'training'")
    grams = style.vocabulary(own, LATIN)
    return style.records(own if training else docs, LATIN, grams, ["doc_id", "source", "split"]), style.feature_names(LATIN, grams)


@query(f"{RECORD_SQL} SELECT doc_id, feature, round(value, 6) + 0 AS value FROM r")
def style_record(spark: SparkSession, folder: str) -> DataFrame:
    """Every feature of every document, in long form."""
    rows, names = _records(spark, folder)
    return style.long_form(rows, names, ["doc_id"]).withColumn("value", F.round("value", 6) + 0)


SCALES_SQL = f"""{RECORD_SQL},
tr AS (SELECT feature, value FROM r JOIN d USING (doc_id) WHERE part = 0),
ce AS (SELECT feature, median(value) AS center, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, stddev_pop(value) AS sd FROM tr GROUP BY feature),
md AS (SELECT feature, median(abs(value - center)) AS mad FROM tr JOIN ce USING (feature) GROUP BY feature),
sc AS (SELECT feature, center, coalesce(nullif(1.4826 * mad, 0), nullif(iqr / 1.349, 0), nullif(sd, 0), 1) AS scale FROM ce JOIN md USING (feature))
"""


@query(f"{SCALES_SQL} SELECT feature, round(center, 6) + 0 AS center, round(scale, 6) AS scale FROM sc")
def style_scales(spark: SparkSession, folder: str) -> DataFrame:
    """Centre and robust scale of every feature over the training documents."""
    rows, names = _records(spark, folder, training=True)
    return style.scales(style.kept(rows), names).select("feature", (F.round("center", 6) + 0).alias("center"), F.round("scale", 6).alias("scale"))


DELTA_SQL = f"""{SCALES_SQL},
dl AS (SELECT doc_id, round(avg(abs((value - center) / scale)), 6) AS delta FROM r JOIN sc USING (feature) GROUP BY doc_id),
ca AS (SELECT delta FROM dl JOIN d USING (doc_id) WHERE part NOT IN (0, 1)),
sh AS (SELECT doc_id, delta, 100.0 * ((SELECT count(*) FROM ca WHERE ca.delta >= dl.delta) + 1) / ((SELECT count(*) FROM ca) + 1) AS share FROM dl)
"""


def _delta(spark: SparkSession, folder: str) -> DataFrame:
    rows, names = _records(spark, folder)
    rows = style.kept(rows)
    found = {r["feature"]: (r["center"], r["scale"]) for r in style.scales(rows.filter("split = 'training'"), names).collect()}
    z = style.standardize(F.col("values"), *([found[n][k] for n in names] for k in (0, 1)))
    delta = F.aggregate(z, F.lit(0.0), lambda s, x: s + F.abs(x)) / len(names)
    scored = style.kept(rows.select("doc_id", "source", "split", F.round(delta, 6).alias("delta")))
    return stats.empirical_share(scored, scored.filter("split = 'calibration'").select("delta"), "delta")


@query(f"{DELTA_SQL} SELECT doc_id, delta, round(share, 6) AS share, CASE WHEN share < 5 THEN 'alarm' WHEN share < 20 THEN 'weak' ELSE 'in range' END AS band FROM sh")
def style_delta(spark: SparkSession, folder: str) -> DataFrame:
    """The mean absolute deviation of each document from the training centre, against that of calibration documents."""
    return _delta(spark, folder).select("doc_id", "delta", F.round("share", 6).alias("share"), stats.band(F.col("share")).alias("band"))


@query(f"""{DELTA_SQL},
ag AS (SELECT source, count(*) AS n, 0.7 * median(share) + 0.3 * quantile_cont(share, 0.1) AS score FROM sh JOIN documents USING (doc_id) GROUP BY source)
SELECT source, n, round(score, 6) AS score, CASE WHEN round(score, 6) < 5 THEN 'alarm' WHEN round(score, 6) < 20 THEN 'weak' ELSE 'in range' END AS band FROM ag""")
def style_delta_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The same for each source: 0.7 median and 0.3 tenth percentile of its documents' shares."""
    return stats.aggregate_score(_delta(spark, folder), "share", ["source"]).withColumn("band", stats.band(F.col("score")))


def fitted(spark: SparkSession, folder: str, keep: list[str], splits: tuple[str, ...]) -> tuple[DataFrame, style.StyleModel]:
    """The distances of the documents of some splits, and a model calibrated on those of its split: every text is measured once."""
    docs = _split(spark, folder).withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    model = style.fit(docs.filter("split = 'training'"), None, LATIN, "source", "fold")
    rows = style.kept(style.distances(docs.filter(F.col("split").isin(*splits)), model, keep))
    return rows, style.calibrated(model, rows.filter("split = 'calibration'"))


@query()
def style_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against a model of the training documents: nearest cluster, distance, bits for a character, shares, band and advice."""
    rows, model = fitted(spark, folder, ["doc_id", "source", "split"], ("training", "test", "calibration"))
    rows = style.audit(rows, model, ["doc_id", "source", "split"])
    return rows.select("doc_id", "source", "split", "cluster", F.round("distance", 6).alias("distance"), F.round("bpc", 6).alias("bpc"), "feature_share", "language_share", "overall", "band", "suggestions")


@query()
def style_validation(spark: SparkSession, folder: str) -> DataFrame:
    """How many sources raise an alarm over the test documents, and whether the model counts as validated."""
    rows, model = fitted(spark, folder, ["source", "split"], ("test", "calibration"))
    return style.validation(style.audit(rows.filter("split = 'test'"), model, ["source"]), "source")


@query(f"WITH a AS ({_alpha_sql()}) SELECT alpha, bpc, row_number() OVER (ORDER BY bpc, alpha) = 1 AS best FROM a")
def style_alpha(spark: SparkSession, folder: str) -> DataFrame:
    """Smoothing by bits for a character of held-out folds, and the one that is chosen."""
    items = read(spark, folder, "benchmark").select(ngrams.only_letters("text").alias("text"), (F.col("item_id") % FOLDS).cast("int").alias("fold"))
    found = style.choose_alpha(items, dataclasses.replace(LATIN, order=3, alphas=tuple(ALPHAS)), "fold")
    rows = [(a, round(float(b), 5), k == 0) for k, (a, b) in enumerate(found)]
    return spark.createDataFrame(rows, "alpha double, bpc double, best boolean")


#: What the tables' texts are rid of: bracketed parts, and a first line that ends with a colon.
RULES = normal.Rules(
    comments=r"\([^)]*\)", heading=r"^\s*[A-Z][^\n:]*:(?:\n|$)", marks=normal.HAN.marks, kept=normal.HAN.kept, variants={"é": "e", "ü": "u", "ß": "s", "，": "、"},
    opening=normal.HAN.opening, closing=normal.HAN.closing,
)


def _normal_sql() -> str:
    marks = " ".join(f"WHEN c = '{a}' THEN '{RULES.variants.get(b, b)}'" for a, b in (RULES.marks | {k: v for k, v in RULES.variants.items()}).items())
    white = r"regexp_matches(c, '[\s\x0B\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]')"
    return rf"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\([^)]*\)', '', 'g'), '^\s*[A-Z][^\n:]*:(\n|$)', '') AS text FROM documents),
o AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM a WHERE length(text) > 0),
k AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before, row_number() OVER (PARTITION BY doc_id, c ORDER BY i) % 2 AS odd FROM o WHERE NOT {white}),
f AS (SELECT *, CASE WHEN c = '"' THEN CASE odd WHEN 1 THEN '“' ELSE '”' END WHEN c = '''' THEN CASE odd WHEN 1 THEN '‘' ELSE '’' END {marks} ELSE c END AS f FROM k),
s AS (SELECT *, CASE WHEN i - before > 1 AND NOT contains('{RULES.opening}', f) AND NOT contains('{RULES.closing}', lag(f) OVER (PARTITION BY doc_id ORDER BY i)) THEN ' ' || f ELSE f END AS out FROM f),
t AS (SELECT doc_id, string_agg(out, '' ORDER BY i) AS normal, count(*) FILTER (f <> c) AS changes FROM s GROUP BY doc_id)
SELECT doc_id, sha256(coalesce(normal, '')) AS normal_sha256, length(coalesce(normal, '')) AS characters, coalesce(changes, 0) AS changes FROM documents LEFT JOIN t USING (doc_id)"""


@query(_normal_sql())
def normal_form(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's normal form and how many of its characters changed."""
    rows = normal.normalised(read(spark, folder, "documents"), ["doc_id"], "text", RULES)
    return rows.select("doc_id", F.sha2("normal", 256).alias("normal_sha256"), F.length("normal").cast("long").alias("characters"), "changes")


@query()
def normal_map(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of every document that its normal form copies: (begin, end) there and in the document."""
    rows = normal.normalised(read(spark, folder, "documents"), ["doc_id"], "text", RULES)
    run = rows.select("doc_id", F.explode("runs").alias("r"))
    return run.select("doc_id", F.col("r.clean").alias("begin"), (F.col("r.clean") + F.col("r.length")).alias("end"), F.col("r.raw").alias("source_begin"), (F.col("r.raw") + F.col("r.length")).alias("source_end"))
