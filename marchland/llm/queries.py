"""Queries of the problems on vectors and texts (3, 4, 6, 7, 8, 9) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marchland.llm import groups, mixture, quality, similar, tokens, varied
from marchland.plans.load import table

SKIN = [f"c{i}" for i in range(33)]


def usable_ds6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ds6").where(F.col("c0").isNotNull() & ~F.isnan("c0") & F.col("c1").isNotNull() & ~F.isnan("c1"))


def usable_skin(spark: SparkSession, d: str) -> DataFrame:
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in SKIN])
    return table(spark, d, "dermatology").where(there & (F.col("c33") > 0) & (F.col("c33") <= 100))


def _ds6_vec():
    return [F.col("c0"), F.col("c1")]


def _skin_vec():
    return [F.col(c) for c in SKIN] + [F.col("c33") / 8]


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    a = similar.most_similar(usable_ds6(spark, d), F.col("set_no"), F.col("point_id"), _ds6_vec())
    b = similar.most_similar(usable_skin(spark, d), F.col("batch"), F.col("rec_id"), _skin_vec(), confidence=0.99)
    out = a.withColumn("src", F.lit("ds6")).unionByName(b.withColumn("src", F.lit("dermatology")))
    return out.select("src", "id", F.posexplode("neighbours").alias("pos", "n")).select("src", "id", (F.col("pos") + 1).alias("rank"), F.col("n.i").alias("neighbour"), F.col("n.d").alias("d2"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    a = similar.most_similar(usable_ds6(spark, d), F.col("set_no"), F.col("point_id"), _ds6_vec())
    b = similar.most_similar(usable_skin(spark, d), F.col("batch"), F.col("rec_id"), _skin_vec(), confidence=0.99)
    return similar.similar_pairs(a).select(F.lit("ds6").alias("src"), "a_id", "b_id").unionByName(similar.similar_pairs(b).select(F.lit("dermatology").alias("src"), "a_id", "b_id"))


def _clusters(spark: SparkSession, d: str, op) -> tuple[DataFrame, DataFrame]:
    a = op(usable_ds6(spark, d), F.col("set_no"), F.col("point_id"), _ds6_vec(), 0, 0.255**2)
    b = op(usable_skin(spark, d), F.col("batch"), F.col("rec_id"), _skin_vec(), 33, 4.5)
    return a.withColumn("src", F.lit("ds6")), b.withColumn("src", F.lit("dermatology"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = _clusters(spark, d, groups.similarity_clusters)
    return a.unionByName(b).select("src", "first_id", "member_id")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    a, b = _clusters(spark, d, groups.describe_clusters)
    return a.unionByName(b).select("src", "group", "first_id", "medoid_id", "size", "loose", "typical")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    a, b = _clusters(spark, d, groups.link_shares)
    return a.unionByName(b)


SUBSET_SIZE = 50


def p6_subset(spark: SparkSession, d: str) -> DataFrame:
    a = varied.varied_subset(usable_ds6(spark, d), F.col("set_no"), F.col("point_id"), _ds6_vec(), 1.005**2, SUBSET_SIZE)
    b = varied.varied_subset(usable_skin(spark, d), F.col("batch"), F.col("rec_id"), _skin_vec(), 60.0, SUBSET_SIZE)
    return a.withColumn("src", F.lit("ds6")).unionByName(b.withColumn("src", F.lit("dermatology"))).select("src", "group", F.col("id").alias("rec_id"), "must", "stands_for")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Those of the subset's records whose coverage no other record gives."""
    return p6_subset(spark, d).where("must").select("src", "rec_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _mixture(spark: SparkSession, d: str) -> mixture.Mixture:
    """The mixture keeps the corpus's bands of length and its two main languages."""
    docs = tokens.token_counts(table(spark, d, "documents").select("doc_id", "source", "lang", "text"))
    flag = lambda c: c.cast("double")
    bands = {"short": flag(F.col("tokens") < 64), "long": flag(F.col("tokens") >= 512)}
    languages = {f"lang_{x}": flag(F.col("lang") == x) for x in ("en", "zh")}
    return mixture.mix(docs, table(spark, d, "mix_targets"), "doc_id", "source", "tokens", "text", bands | languages)


def p8_balance(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).balance


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).copies


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).where(~F.col("reachable")).select("source")


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.score_texts(table(spark, d, "documents"), "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_quality(spark, d).where("is_junk").select("doc_id")


# what SQL can say about results it can't compute ------------------------------------------------------------------------


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each cluster together have all its records."""
    return p4_clusters(spark, d).groupBy("src", "first_id").agg(F.sum("size").alias("size"), F.bool_and((F.size("typical") >= 1) & F.col("medoid_id").isNotNull()).alias("described"))


def p6_reach(spark: SparkSession, d: str) -> DataFrame:
    """How many records the subset's stand for: all of them, each once."""
    return p6_subset(spark, d).groupBy("src").agg(F.sum("stands_for").alias("records"), F.sum(F.col("must").cast("long")).alias("musts"))


def p7_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of the tokens of each text: those of the text."""
    ranks = tokens.read_ranks(tokens.VOCABULARY)
    sizes = spark.createDataFrame([(i, len(t)) for t, i in ranks.items()], "i int, n int")
    ids = p7_ids(spark, d)
    each = ids.select("doc_id", F.explode("ids").alias("i")).join(F.broadcast(sizes), "i").groupBy("doc_id").agg(F.sum("n").alias("n_bytes"))
    return ids.select("doc_id").join(each, "doc_id", "left").na.fill(0, ["n_bytes"])


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of each source: no text is used too often, and attainable shares are met to within the longest text."""
    m = _mixture(spark, d)
    off = F.abs(F.col("used_tokens") - F.col("target_tokens"))
    return m.report.select(
        "source", (F.col("most_copies") <= F.col("max_repeats")).alias("within"), (~F.col("attainable") | (off <= F.col("longest"))).alias("met"), F.col("documents").cast("long").alias("documents")
    )


def p9_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p9_quality(spark, d).select("doc_id", "n_chars", F.round(F.col("digit_share") * F.col("n_chars")).cast("long").alias("digits"))


QUERIES = {
    "p9_found": p9_found,
    "p9_quality": p9_quality,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_copies": p8_copies,
    "p8_balance": p8_balance,
    "p7_ids": p7_ids,
    "p6_found": p6_found,
    "p6_subset": p6_subset,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p4_shares": p4_shares,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p4_sizes": p4_sizes,
    "p6_reach": p6_reach,
    "p7_bytes": p7_bytes,
    "p8_limits": p8_limits,
    "p9_sizes": p9_sizes,
}

_DS6 = "(SELECT DISTINCT point_id AS id, set_no AS g, c0, c1 FROM ds6 WHERE c0 IS NOT NULL AND NOT isnan(c0) AND c1 IS NOT NULL AND NOT isnan(c1))"
_SKIN = f"(SELECT DISTINCT rec_id AS id, batch AS g, {', '.join(SKIN)}, c33 FROM dermatology WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SKIN)} AND c33 > 0 AND c33 <= 100)"
_DS6_D2 = "round(pow(a.c0 - b.c0, 2) + pow(a.c1 - b.c1, 2), 6)"
_SKIN_D2 = f"round(CAST({' + '.join(f'pow(a.{c} - b.{c}, 2)' for c in SKIN)} + pow((a.c33 - b.c33) / 8, 2) AS DOUBLE), 6)"
_P3 = f"""
u AS {_DS6}, v AS {_SKIN},
n AS (SELECT 'ds6' AS src, a.id AS id, b.id AS nb, {_DS6_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_DS6_D2}, b.id) AS rn FROM u a JOIN u b ON a.g = b.g AND a.id <> b.id
      QUALIFY rn <= 5
      UNION ALL SELECT 'dermatology', a.id, b.id, {_SKIN_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_SKIN_D2}, b.id) AS rn FROM v a JOIN v b ON a.g = b.g AND a.id <> b.id
      QUALIFY rn <= 5)
"""
_P4 = f"""
WITH RECURSIVE u AS {_DS6}, v AS {_SKIN},
l AS (SELECT 'ds6' AS src, a.id AS a, b.id AS b FROM u a JOIN u b ON a.g = b.g AND a.id <> b.id AND {_DS6_D2} <= 0.065025
      UNION ALL SELECT 'dermatology', a.id, b.id FROM v a JOIN v b ON a.g = b.g AND a.id <> b.id AND {_SKIN_D2} <= 4.5),
reach AS (SELECT DISTINCT src, a AS id, a AS r FROM l UNION SELECT reach.src, l.b, reach.r FROM reach JOIN l ON l.src = reach.src AND l.a = reach.id WHERE reach.r < l.b),
c AS (SELECT src, id, min(r) AS first_id FROM reach GROUP BY 1, 2)
SELECT src, first_id, id AS member_id FROM c WHERE first_id <> id QUALIFY count(*) OVER (PARTITION BY src, first_id) >= 2
"""
_P6 = f"""
WITH u AS {_DS6}, v AS {_SKIN}
SELECT 'ds6' AS src, id AS rec_id FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.g = a.g AND b.id <> a.id AND {_DS6_D2} <= 1.010025)
UNION ALL SELECT 'dermatology', id FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.g = a.g AND b.id <> a.id AND {_SKIN_D2} <= 60)
"""
_USABLE = f"(SELECT 'ds6' AS src, count(*) AS records FROM {_DS6} UNION ALL SELECT 'dermatology', count(*) FROM {_SKIN})"
ORACLE = {
    "p4_sizes": f"SELECT src, first_id, CAST(count(*) + 1 AS BIGINT) AS size, true AS described FROM ({_P4}) GROUP BY ALL",
    "p6_reach": f"SELECT src, records, CAST((SELECT count(*) FROM ({_P6}) m WHERE m.src = u.src) AS BIGINT) AS musts FROM {_USABLE} u",
    "p8_limits": "SELECT source, true AS within, true AS met, (SELECT count(*) FROM documents d WHERE d.source = m.source) AS documents FROM mix_targets m",
    "p7_bytes": "SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes FROM documents",
    "p9_sizes": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(CASE WHEN trim(regexp_replace(text, '[\\s\\p{Z}\\x0B\\x85]', '', 'g')) = '' THEN 0 ELSE length(regexp_replace(text, '[^\\p{N}]', '', 'g')) END AS BIGINT) AS digits FROM documents",
    "p6_found": _P6,
    "p4_found": _P4,
    "p3_found": f"WITH {_P3} SELECT DISTINCT src, least(id, nb) AS a_id, greatest(id, nb) AS b_id FROM n",
    "p3_neighbours": f"WITH {_P3} SELECT src, id, CAST(rn AS INTEGER) AS rank, nb AS neighbour, d2 FROM n",
}
