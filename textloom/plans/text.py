"""Queries over the texts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, markup, ngrams, profile, stats
from ..session import read
from .registry import query

LETTERS_SQL = r"regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g')"
CHARS_SQL = f"""
WITH l AS (SELECT doc_id, {LETTERS_SQL} AS t FROM documents),
c AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) - 1 AS i, length(t) AS n FROM l WHERE length(t) > 0)
"""


@query(f"""
WITH l AS (SELECT doc_id, text, {LETTERS_SQL} AS t FROM documents)
SELECT doc_id, length(coalesce(text, '')) AS characters, length(t) AS letters,
  round(CASE WHEN length(t) > 0 THEN len(list_distinct(string_split(t, ''))) / length(t)::DOUBLE ELSE 0 END, 6) AS unique_ratio
FROM l""")
def doc_letter_stats(spark: SparkSession, folder: str) -> DataFrame:
    return profile.letter_stats(read(spark, folder, "documents"))


@query(f"""{CHARS_SQL},
k AS (SELECT doc_id, c, count(*) AS k, any_value(n) AS n FROM c GROUP BY ALL),
e AS (SELECT doc_id, -sum(k / n::DOUBLE * log2(k / n::DOUBLE)) AS e FROM k GROUP BY doc_id)
SELECT doc_id, round(coalesce(e, 0), 6) + 0 AS entropy FROM documents LEFT JOIN e USING (doc_id)""")
def doc_char_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return profile.character_features(read(spark, folder, "documents")).select("doc_id", (F.round("entropy", 6) + 0).alias("entropy"))


@query(f"""{CHARS_SQL},
p AS (SELECT doc_id, c, i, n, coalesce(lag(i) OVER (PARTITION BY doc_id, c ORDER BY i), -1) AS p FROM c),
m AS (SELECT doc_id, CASE WHEN any_value(n) > 100
    THEN sum(greatest(0, least(i, n - 100) - greatest(0, i - 99, p + 1) + 1)) / (100.0 * (any_value(n) - 99))
    ELSE count(DISTINCT c) / any_value(n)::DOUBLE END AS m FROM p GROUP BY doc_id)
SELECT doc_id, round(coalesce(m, 0), 6) AS mattr FROM documents LEFT JOIN m USING (doc_id)""")
def doc_mattr(spark: SparkSession, folder: str) -> DataFrame:
    return profile.character_features(read(spark, folder, "documents")).select("doc_id", F.round("mattr", 6).alias("mattr"))


SEGMENTS_SQL = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{}'), lambda s: length(regexp_replace(s, '[^\p{{L}}]+', '', 'g'))), lambda n: n > 0)"


@query(f"""
WITH s AS (SELECT doc_id, {SEGMENTS_SQL.format(r"[.!?\n]+")} AS s, {SEGMENTS_SQL.format(r"[,.;:!?\n]+")} AS c FROM documents)
SELECT doc_id, len(s) AS sentences, round(coalesce(list_avg(s), 0), 6) AS mean,
  round(coalesce(list_aggregate(s, 'quantile_cont', 0.25), 0), 6) AS p25, round(coalesce(list_aggregate(s, 'quantile_cont', 0.5), 0), 6) AS p50,
  round(coalesce(list_aggregate(s, 'quantile_cont', 0.75), 0), 6) AS p75, round(coalesce(list_aggregate(s, 'quantile_cont', 0.9), 0), 6) AS p90,
  round(coalesce(list_avg(c), 0), 6) AS clause_mean
FROM s""")
def doc_sentence_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return profile.sentence_stats(read(spark, folder, "documents"))


def _rates_sql() -> str:
    one = "round(CASE WHEN length(text) > 0 THEN 1000.0 * ((length(text) - length(replace(text, '{0}', ''))) / length('{0}')::DOUBLE) / length(text) ELSE 0 END, 6) AS rate_{0}"
    return "SELECT doc_id, " + ", ".join(one.format(t) for t in profile.LETTERS.tokens) + " FROM documents"


@query(_rates_sql())
def doc_token_rates(spark: SparkSession, folder: str) -> DataFrame:
    return profile.token_rates(read(spark, folder, "documents"))


def _top_sql(order: int, k: int) -> str:
    return f"""
WITH l AS (SELECT {LETTERS_SQL} AS t FROM documents),
g AS (SELECT unnest(list_transform(range(1, length(t) - {order} + 2), lambda i: substring(t, i, {order}))) AS gram FROM l WHERE length(t) >= {order}),
n AS (SELECT gram, count(*) AS n FROM g GROUP BY gram)
SELECT gram, n, row_number() OVER (ORDER BY n DESC, gram) AS rank FROM n ORDER BY n DESC, gram LIMIT {k}"""


@query(_top_sql(1, 48))
def ngram_topk_1(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.top_grams(read(spark, folder, "documents"), 1, 48)


@query(_top_sql(2, 64))
def ngram_topk_2(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.top_grams(read(spark, folder, "documents"), 2, 64)


@query(_top_sql(3, 64))
def ngram_topk_3(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.top_grams(read(spark, folder, "documents"), 3, 64)


def _bits_sql(train: str, score: str, key: str, order: int = 5, alpha: float = 1.0, name: str = "bpc") -> str:
    """SQL of the interpolated model: train and score are queries for (t) and (key, t)."""
    grams = " UNION ALL ".join(f"SELECT unnest(list_transform(range(1, length(t) - {k} + 2), lambda i: substring(t, i, {k}))) AS g FROM tr WHERE length(t) >= {k}" for k in range(1, order + 1))
    joins = " ".join(
        f"LEFT JOIN cn n{k} ON n{k}.g = right(s, {k})" + (f" LEFT JOIN cx x{k} ON x{k}.g = left(right(s, {k}), {k - 1})" if k > 1 else "") for k in range(1, order + 1)
    )
    p = f"(coalesce(n1.n, 0) + {alpha}) / ((SELECT sum(n) FROM cn WHERE length(g) = 1) + {alpha} * ((SELECT count(*) FROM cn WHERE length(g) = 1) + 1))"
    steps = [f"z1 AS (SELECT *, {p} AS p1 FROM z0)"]
    for k in range(2, order + 1):
        steps.append(f"z{k} AS (SELECT *, CASE WHEN length(s) >= {k} AND x{k} IS NOT NULL THEN (n{k} + {alpha} * p{k - 1}) / (x{k} + {alpha}) ELSE p{k - 1} END AS p{k} FROM z{k - 1})")
    columns = ", ".join([f"coalesce(n{k}.n, 0) AS n{k}" for k in range(2, order + 1)] + [f"x{k}.n AS x{k}" for k in range(2, order + 1)])
    steps[0] = "z1 AS (SELECT * FROM z0)"
    return f"""
WITH tr AS ({train}), sc AS ({score}),
gr AS ({grams}), cn AS (SELECT g, count(*) AS n FROM gr GROUP BY g),
cx AS (SELECT left(g, length(g) - 1) AS g, sum(n) AS n FROM cn WHERE length(g) > 1 GROUP BY 1),
ch AS (SELECT {key}, generate_subscripts(string_split(t, ''), 1) AS i, unnest(string_split(t, '')) AS c FROM sc WHERE length(t) > 0),
kn AS (SELECT {key}, string_agg(CASE WHEN g IS NULL THEN chr(57344) ELSE c END, '' ORDER BY i) AS t FROM ch LEFT JOIN (SELECT g FROM cn WHERE length(g) = 1) v ON v.g = c GROUP BY {key}),
w AS (SELECT {key}, unnest(list_transform(range(1, length(t) + 1), lambda i: substring(t, greatest(1, i - {order - 1}), least(i, {order})))) AS s FROM kn),
u AS (SELECT {key}, s, count(*) AS m FROM w GROUP BY ALL),
d AS (SELECT DISTINCT s FROM u),
z0 AS (SELECT s, {p} AS p1, {columns} FROM d {joins}),
{", ".join(steps)},
b AS (SELECT {key}, -sum(m * log2(p{order})) / sum(m) AS b FROM u JOIN z{order} USING (s) GROUP BY {key})
SELECT {key}, round(b, 6) AS {name} FROM sc LEFT JOIN b USING ({key})"""


@query(_bits_sql(f"SELECT {LETTERS_SQL} AS t FROM benchmark", f"SELECT doc_id, {LETTERS_SQL} AS t FROM documents", "doc_id"))
def ngram_lm_bpc(spark: SparkSession, folder: str) -> DataFrame:
    """A model of the benchmark's letters scores every document."""
    model = ngrams.fit_counts(read(spark, folder, "benchmark"))
    return ngrams.score_bits(read(spark, folder, "documents"), model)


ALPHAS, FOLDS = (0.1, 0.3, 1.0, 3.0), 2


def _alpha_sql() -> str:
    parts = []
    for a in ALPHAS:
        for fold in range(FOLDS):
            inner = _bits_sql(f"SELECT {LETTERS_SQL} AS t FROM benchmark WHERE item_id % {FOLDS} <> {fold}", f"SELECT item_id, {LETTERS_SQL} AS t FROM benchmark WHERE item_id % {FOLDS} = {fold}", "item_id", 3, a, "b")
            parts.append(f"SELECT {a}::DOUBLE AS alpha, item_id, b FROM ({inner})")
    return f"""WITH q AS ({" UNION ALL ".join(parts)})
SELECT alpha, round(sum(b * length({LETTERS_SQL})) / sum(length({LETTERS_SQL})), 5) AS bpc FROM q JOIN benchmark USING (item_id) GROUP BY alpha"""


@query(_alpha_sql())
def ngram_alpha_cv(spark: SparkSession, folder: str) -> DataFrame:
    """Bits per character by smoothing, each fold scored by the model of the others and weighted by length.

    A fold's counts do not depend on the smoothing, so each fold is counted once.
    """
    items = read(spark, folder, "benchmark")
    out = None
    for fold in range(FOLDS):
        model = ngrams.fit_counts(items.filter(F.col("item_id") % FOLDS != fold), 3)
        own = items.filter(F.col("item_id") % FOLDS == fold)
        for a in ALPHAS:
            one = ngrams.score_bits(own, model, "item_id", 3, a).withColumn("alpha", F.lit(a))
            out = one if out is None else out.unionByName(one)
    n = items.select("item_id", F.length(ngrams.only_letters("text")).alias("n"))
    return out.join(n, "item_id").groupBy("alpha").agg(F.round(F.sum(F.col("bpc") * F.col("n")) / F.sum("n"), 5).alias("bpc"))


_KNOWN = f"SELECT {LETTERS_SQL} AS t FROM documents JOIN labels USING (doc_id) WHERE quality = "
_DOCS = f"SELECT doc_id, {LETTERS_SQL} AS t FROM documents"


@query(f"""
WITH a AS ({_bits_sql(_KNOWN + "1", _DOCS, "doc_id", 3, 1.0, "a")}), b AS ({_bits_sql(_KNOWN + "0", _DOCS, "doc_id", 3, 1.0, "b")})
SELECT doc_id, round(-log2((pow(2.0, -a) + pow(2.0, -b)) / 2), 5) AS mixture, CASE WHEN a <= b THEN 'good' ELSE 'bad' END AS best FROM a JOIN b USING (doc_id)""")
def lm_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Every document under a model of all good and one of all bad labelled documents, their mixture and the better one."""
    docs = read(spark, folder, "documents")
    known = docs.join(read(spark, folder, "labels"), "doc_id")
    good = ngrams.score_bits(docs, ngrams.fit_counts(known.filter("quality = 1"), 3), "doc_id", 3).withColumnRenamed("bpc", "a")
    bad = ngrams.score_bits(docs, ngrams.fit_counts(known.filter("quality = 0"), 3), "doc_id", 3).withColumnRenamed("bpc", "b")
    return good.join(bad, "doc_id").select("doc_id", F.round(ngrams.mixture_bits([F.col("a"), F.col("b")]), 5).alias("mixture"), F.when(F.col("a") <= F.col("b"), "good").otherwise("bad").alias("best"))


COPY_SQL = f"""
WITH d AS (SELECT doc_id, {LETTERS_SQL} AS t FROM documents), b AS (SELECT item_id, {LETTERS_SQL} AS t FROM benchmark),
dg AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 10), lambda i: substring(t, i, 12))) AS g, unnest(range(1, length(t) - 10)) AS i FROM d WHERE length(t) >= 12),
bg AS (SELECT item_id, unnest(list_transform(range(1, length(t) - 10), lambda i: substring(t, i, 12))) AS g, unnest(range(1, length(t) - 10)) AS j FROM b WHERE length(t) >= 12)
"""


@query(f"""{COPY_SQL},
s AS (SELECT DISTINCT doc_id, g FROM dg), k AS (SELECT DISTINCT g, 1 AS hit FROM bg),
o AS (SELECT doc_id, count(*) AS grams, sum(coalesce(hit, 0))::BIGINT AS shared FROM s LEFT JOIN k USING (g) GROUP BY doc_id)
SELECT doc_id, coalesce(grams, 0) AS grams, coalesce(shared, 0) AS shared, round(CASE WHEN grams > 0 THEN shared / grams::DOUBLE ELSE 0 END, 6) AS overlap
FROM documents LEFT JOIN o USING (doc_id)""")
def copy_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.copy_overlap(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query(f"""{COPY_SQL},
m AS (SELECT doc_id, item_id, j - i AS diagonal, i, i - row_number() OVER (PARTITION BY doc_id, item_id, j - i ORDER BY i) AS island FROM dg JOIN bg USING (g)),
r AS (SELECT doc_id, item_id, diagonal, island, count(*) AS n FROM m GROUP BY ALL)
SELECT doc_id, item_id, max(n) + 11 AS longest FROM r GROUP BY ALL""")
def copy_longest_run(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.copy_runs(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query(f"""{COPY_SQL},
s AS (SELECT DISTINCT doc_id, g FROM dg), k AS (SELECT DISTINCT g, 1 AS hit FROM bg),
o AS (SELECT doc_id, sum(coalesce(hit, 0)) / count(*)::DOUBLE AS overlap FROM s LEFT JOIN k USING (g) GROUP BY doc_id),
q AS (SELECT quantile_cont(coalesce(overlap, 0), 0.99) AS q FROM documents LEFT JOIN o USING (doc_id))
SELECT doc_id, round(coalesce(overlap, 0), 6) AS overlap FROM documents LEFT JOIN o USING (doc_id), q WHERE coalesce(overlap, 0) > q""")
def copy_p99_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose overlap is beyond the 99th percentile of all."""
    o = ngrams.copy_overlap(read(spark, folder, "documents"), read(spark, folder, "benchmark")).select("doc_id", F.when(F.col("grams") > 0, F.col("shared") / F.col("grams")).otherwise(0.0).alias("overlap"))
    limit = o.agg(F.percentile("overlap", F.lit(0.99)).alias("q"))
    return o.join(F.broadcast(limit), F.col("overlap") > F.col("q")).select("doc_id", F.round("overlap", 6).alias("overlap"))


ROBUST_SQL = """
WITH c AS (SELECT source, count(n_chars) AS n, median(n_chars) AS center, quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS iqr, stddev_pop(n_chars) AS sd FROM documents GROUP BY source),
m AS (SELECT source, median(abs(n_chars - center)) AS mad FROM documents JOIN c USING (source) GROUP BY source),
s AS (SELECT source, n, center, coalesce(nullif(1.4826 * mad, 0), nullif(iqr / 1.349, 0), nullif(sd, 0), 1) AS scale FROM c JOIN m USING (source))
"""


@query(f"{ROBUST_SQL} SELECT source, n, center, round(scale, 6) AS scale FROM s")
def robust_center(spark: SparkSession, folder: str) -> DataFrame:
    return stats.robust_scale(read(spark, folder, "documents"), "n_chars", ["source"]).withColumn("scale", F.round("scale", 6))


@query(f"""{ROBUST_SQL},
z AS (SELECT source, doc_id, (n_chars - center) / scale AS z FROM documents JOIN s USING (source)),
r AS (SELECT source, doc_id, round(z, 6) AS z, row_number() OVER (PARTITION BY source ORDER BY round(abs(z), 6) DESC, doc_id) AS rank FROM z)
SELECT source, doc_id, z, rank FROM r WHERE rank <= 8""")
def robust_zscores_top(spark: SparkSession, folder: str) -> DataFrame:
    return stats.deviations(read(spark, folder, "documents"), "n_chars", ["source"], ["doc_id"], 8)


SHARE_SQL = """
WITH k AS (SELECT n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
p AS (SELECT doc_id, source, 100.0 * ((SELECT count(*) FROM k WHERE k.n_chars >= d.n_chars) + 1) / ((SELECT count(*) FROM k) + 1) AS share FROM documents d)
"""


def _shares(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    good = docs.join(read(spark, folder, "labels").filter("quality = 1"), "doc_id").select("n_chars")
    return stats.empirical_share(docs.select("doc_id", "source", "n_chars"), good, "n_chars")


@query(f"{SHARE_SQL} SELECT doc_id, round(share, 6) AS share, CASE WHEN share < 5 THEN 'alarm' WHEN share < 20 THEN 'weak' ELSE 'in range' END AS band FROM p")
def empirical_compat(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's length against those of good documents, and its band."""
    return _shares(spark, folder).select("doc_id", F.round("share", 6).alias("share"), stats.band(F.col("share")).alias("band"))


@query(f"""{SHARE_SQL},
s AS (SELECT source, count(share) AS n, 0.7 * median(share) + 0.3 * quantile_cont(share, 0.1) AS score FROM p GROUP BY source)
SELECT source, n, round(score, 6) AS score, CASE WHEN round(score, 6) < 5 THEN 'alarm' WHEN round(score, 6) < 20 THEN 'weak' ELSE 'in range' END AS band FROM s""")
def group_aggregate_score(spark: SparkSession, folder: str) -> DataFrame:
    return stats.aggregate_score(_shares(spark, folder), "share", ["source"]).withColumn("band", stats.band(F.col("score")))


@query(f"{SHARE_SQL} SELECT source, round(avg(CASE WHEN share < 5 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM p JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source")
def false_outlier_rate(spark: SparkSession, folder: str) -> DataFrame:
    good = _shares(spark, folder).join(read(spark, folder, "labels").filter("quality = 1"), "doc_id")
    return good.groupBy("source").agg(F.round(F.avg((F.col("share") < 5).cast("double")), 6).alias("rate"))


@query("""
WITH s AS (SELECT doc_id, ('0x' || substring(md5(doc_id::VARCHAR), 1, 6))::BIGINT % 3 AS p FROM documents)
SELECT CASE p WHEN 0 THEN 'training' WHEN 1 THEN 'test' ELSE 'calibration' END AS split, count(*) AS n, min(doc_id) AS first FROM s GROUP BY 1""")
def split_partition(spark: SparkSession, folder: str) -> DataFrame:
    rows = stats.hash_split(read(spark, folder, "documents"), "doc_id")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(r"""SELECT doc_id, sha256(translate(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')), ',.;:!?()', '，。；：！？（）')) AS text_hash FROM documents""")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.sha2(profile.normalize_text("text"), 256).alias("text_hash"))


LEXICON = ["password", "example", "license", "the", "and", "worthless"]


def _mask_sql() -> str:
    text = "coalesce(text, '')"
    for name in sorted(LEXICON, key=lambda x: (-len(x), x)):
        text = f"replace({text}, '{name}', '{'○' * len(name)}')"
    return f"SELECT doc_id, sha256({text}) AS masked_hash, length({text}) - length(replace({text}, '○', '')) AS masked FROM documents"


@query(_mask_sql())
def mask_entities(spark: SparkSession, folder: str) -> DataFrame:
    m = profile.mask_entities("text", LEXICON)
    return read(spark, folder, "documents").select("doc_id", F.sha2(m, 256).alias("masked_hash"), (F.length(m) - F.length(F.replace(m, F.lit("○"), F.lit("")))).alias("masked"))


@query()
def greedy_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return profile.greedy_chunks(read(spark, folder, "documents"))


@query()
def dialogue_stats(spark: SparkSession, folder: str) -> DataFrame:
    return profile.quote_stats(read(spark, folder, "documents"))


@query("""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '</?[a-zA-Z][a-zA-Z0-9]*')) AS t FROM pages)
SELECT page_id, lower(regexp_replace(t, '[</]', '', 'g')) AS tag, count(*) FILTER (NOT starts_with(t, '</')) AS opened, count(*) FILTER (starts_with(t, '</')) AS closed FROM t GROUP BY ALL""")
def markup_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return markup.tag_tokens(read(spark, folder, "pages"))


@query("""
WITH a AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '</?[a-zA-Z][a-zA-Z0-9]*') AS a FROM pages),
t AS (SELECT page_id, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM a),
d AS (SELECT page_id, i, CASE WHEN lower(regexp_replace(t, '[</]', '', 'g')) IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') THEN 0 WHEN starts_with(t, '</') THEN -1 ELSE 1 END AS d FROM t),
s AS (SELECT page_id, i, d, sum(d) OVER (PARTITION BY page_id ORDER BY i) AS s FROM d),
g AS (SELECT page_id, count(*) AS tags, greatest(0, max(s))::BIGINT AS deepest, sum(d)::BIGINT AS final FROM s GROUP BY page_id)
SELECT page_id, coalesce(tags, 0) AS tags, coalesce(deepest, 0) AS deepest, coalesce(final, 0) AS final FROM pages LEFT JOIN g USING (page_id)""")
def markup_depth(spark: SparkSession, folder: str) -> DataFrame:
    return markup.tag_depth(read(spark, folder, "pages"))


@query(r"""
WITH v AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '\bhref="([^"]*)"', 1)) AS value FROM pages)
SELECT page_id, value, count(*) AS n FROM v GROUP BY ALL""")
def attribute_extract(spark: SparkSession, folder: str) -> DataFrame:
    return markup.attributes(read(spark, folder, "pages"), "href")


RULES = [("license", "(?i)licen[sc]ed?"), ("contact", "@|\\+[0-9]"), ("secret", "password=|AKIA"), ("shouting", "[A-Z]{4,}!!"), ("table", " \\| "), ("insult", "(?i)idiot|worthless|pathetic")]


def _rules_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' END" for n, p in RULES)
    return f"""WITH c AS (SELECT doc_id, list_filter([{cases}], lambda x: x IS NOT NULL) AS c FROM documents)
SELECT doc_id, array_to_string(c, ',') AS categories, coalesce(c[1], 'other') AS primary FROM c"""


@query(_rules_sql().replace(" AS primary", ' AS "primary"'))
def rule_classify(spark: SparkSession, folder: str) -> DataFrame:
    return annotate.classify(read(spark, folder, "documents"), "doc_id", "text", RULES)


@query(f"""WITH k AS ({_rules_sql().replace(" AS primary", " AS p")})
SELECT value, count(*) AS n FROM (SELECT unnest(CASE WHEN categories = '' THEN [NULL] ELSE string_split(categories, ',') END) AS value FROM k) GROUP BY value""")
def rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = read(spark, folder, "documents").select(annotate.matched_rules(F.col("text"), RULES).alias("c"))
    return annotate.count_by(found, F.col("c"))
