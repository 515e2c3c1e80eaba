"""Queries of the general data-preparation problems (1, 2, 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marchland.operators import badrows, spatial
from marchland.operators.badrows import whole
from marchland.operators.fill import Features, Target, fill_missing
from marchland.plans.load import table


def usable_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hubei_points").where(F.col("lat").between(15, 55) & F.col("lon").between(70, 140))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.bad_lines(table(spark, d, "raw_lines")).select("line_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return badrows.bad_lines(table(spark, d, "raw_lines")).select("line_id", "kind", "reason", "broken_field", "n_fields")


def p1_breast_cancer_rows(spark: SparkSession, d: str) -> DataFrame:
    return badrows.typed_rows(table(spark, d, "raw_lines"), "BreastCancer")


def p1_dermatology_rows(spark: SparkSession, d: str) -> DataFrame:
    return badrows.typed_rows(table(spark, d, "raw_lines"), "Dermatology")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spatial.dual_tree_join(usable_points(spark, d), 50.0, table(spark, d, "hubei_463"))


def p2_region_counts(spark: SparkSession, d: str) -> DataFrame:
    within = spatial.dual_tree_join(usable_points(spark, d), None, table(spark, d, "hubei_463"))
    names = table(spark, d, "hubei_463").where(F.col("coordinates").isNotNull()).groupBy(F.col("objectid").alias("a_id")).agg(F.max(F.trim("name")).alias("name"))
    return within.groupBy("a_id").agg(F.count("*").alias("n_points")).join(names, "a_id", "left").select(F.col("a_id").alias("objectid"), "name", "n_points")


def _whole_or_null(c: str, alternatives: str):
    text = F.col(c).cast("string")
    return F.when(text.rlike(f"\\A{whole(alternatives)}\\z"), F.regexp_replace(F.trim(text), "\\.0+$", "").try_cast("int"))


def _hidden(field: str, hide: bool) -> Column:
    """A tenth of the records, by hash, whose value is held out to measure errors."""
    return (F.pmod(F.xxhash64(F.lit(field), "rec_id"), F.lit(10)) == 0) if hide else F.lit(False)


def _grade() -> Column:
    return _whole_or_null("c6", "10|[1-9]")


def _status() -> Column:
    return F.when(F.col("c10").isin(1, 2), F.col("c10"))


def _age() -> Column:
    return F.when((F.col("c33") > 0) & (F.col("c33") <= 100), F.col("c33"))


def fill_breast_cancer(spark: SparkSession, d: str, hide: bool = False) -> DataFrame:
    grade, status = F.when(~_hidden("c6", hide), _grade()), F.when(~_hidden("c10", hide), _status())
    numeric = {f"c{i}": F.col(f"c{i}") for i in (1, 2, 3, 4, 5, 7, 8, 9)} | {"c6": grade, "day": F.col("seen_at").cast("long") / 86400}
    levels6 = (("case", ("c0",), 1), ("cluster_clinic", ("_cluster", "clinic"), 20), ("cluster", ("_cluster",), 1), ("clinic", ("clinic",), 1), ("all", (), 1))
    targets = [Target("c6", grade, levels6), Target("c10", status, (("case", ("c0",), 1), *levels6[1:]), categorical=True)]
    return fill_missing(table(spark, d, "breast_cancer"), "rec_id", Features(numeric, {"c10": status, "clinic": F.col("clinic")}), targets)


def fill_dermatology(spark: SparkSession, d: str, hide: bool = False) -> DataFrame:
    age = F.when(~_hidden("c33", hide), _age())
    numeric = {f"c{i}": F.col(f"c{i}") for i in range(33)} | {"c33": age}
    levels = (("cluster_class_batch", ("_cluster", "c34", "batch"), 20), ("cluster_class", ("_cluster", "c34"), 1), ("cluster", ("_cluster",), 1), ("batch", ("batch",), 1), ("all", (), 1))
    alike = tuple(f"c{i}" for i in range(33))
    return fill_missing(table(spark, d, "dermatology"), "rec_id", Features(numeric, {"c34": F.col("c34")}), [Target("c33", age, levels, alike=alike)])


def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    """(src, field, method, n, error, plain): of held-out values, by the level that filled them, the mean absolute error (c10: the
    share of wrong ones) and that of the median (mode) of all."""
    out = []
    cancer = fill_breast_cancer(spark, d, True)
    for src, field, truth, filled in (("breast_cancer", "c6", _grade(), cancer), ("breast_cancer", "c10", _status(), cancer), ("dermatology", "c33", _age(), fill_dermatology(spark, d, True))):
        seen = table(spark, d, src).select("rec_id", _hidden(field, True).alias("hidden"), truth.cast("double").alias("truth")).where(F.col("truth").isNotNull() & F.col("rec_id").isNotNull()).dropDuplicates(["rec_id"])
        plain = seen.where("not hidden").agg((F.mode("truth", deterministic=True) if field == "c10" else F.percentile_approx("truth", 0.5)).alias("p"))
        off = (lambda a, b: (a != b).cast("double")) if field == "c10" else (lambda a, b: F.abs(a - b))
        both = seen.where("hidden").join(filled.select("rec_id", F.col(field).cast("double").alias("v"), F.col(f"{field}_method").alias("method")), "rec_id").crossJoin(F.broadcast(plain))
        err = both.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(off(F.col("v"), F.col("truth"))).alias("error"), F.avg(off(F.col("p"), F.col("truth"))).alias("plain"))
        out.append(err.select(F.lit(src).alias("src"), F.lit(field).alias("field"), "method", "n", "error", "plain"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _filled(df: DataFrame, src: str, name: str) -> DataFrame:
    return df.where(F.col(f"{name}_method").isNotNull()).select(F.lit(src).alias("src"), "rec_id", F.lit(name).alias("field"), F.col(name).cast("double").alias("value"), F.col(f"{name}_method").alias("method"))


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    cancer = fill_breast_cancer(spark, d)
    return _filled(cancer, "breast_cancer", "c6").unionByName(_filled(cancer, "breast_cancer", "c10")).unionByName(_filled(fill_dermatology(spark, d), "dermatology", "c33"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_filled(spark, d).select("src", "rec_id", "field")


def p5_marks(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each field were filled, and how many of those have a value now."""
    return p5_filled(spark, d).groupBy("src", "field").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"), F.count("method").alias("marked"))


QUERIES = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p1_breast_cancer_rows": p1_breast_cancer_rows,
    "p1_dermatology_rows": p1_dermatology_rows,
    "p2_found": p2_found,
    "p2_region_counts": p2_region_counts,
    "p5_found": p5_found,
    "p5_filled": p5_filled,
    "p5_errors": p5_errors,
    "p5_marks": p5_marks,
}


#: The rules of the two kinds of files, written down from the description of the data: (column, least, most).
_RULES = {
    "BreastCancer": [*[(f"c{i}", 1, 10) for i in range(1, 10)], ("c10", 1, 2)],
    "Dermatology": [*[(f"c{i}", 0, 1 if i == 10 else 3) for i in range(33)], ("c33", 1, 100), ("c34", 1, 6)],
}
_LINES = """
WITH l AS (SELECT line_id, CASE WHEN file_name LIKE 'BreastCancer%' THEN 'BreastCancer' WHEN file_name LIKE 'Dermatology%' THEN 'Dermatology' END AS kind,
  CASE WHEN right(line_text, 1) = chr(13) THEN left(line_text, len(line_text) - 1) ELSE line_text END AS t FROM raw_lines),
s AS (SELECT *, list_transform(string_split(t, ','), lambda x: CASE WHEN len(x) > 1 AND x[1] = '"' AND x[-1] = '"' THEN x[2:-2] ELSE x END) AS f FROM l),
"""


def _field_ok(kind: str, at: int, name: str, least: int, most: int) -> str:
    """Whether field ``at`` (from 1) holds a whole number of the range; a quote left in it fails the pattern."""
    v = f"trim(f[{at}], ' ')"
    blank = f" OR {v} IN ('', '?')" if (kind, name) in (("BreastCancer", "c6"), ("Dermatology", "c33")) else ""
    return f"coalesce((regexp_full_match({v}, '[0-9]+([.]0+)?') AND TRY_CAST({v} AS DOUBLE) BETWEEN {least} AND {most}){blank}, false)"


def _broken_sql() -> str:
    """b: every line with the name of its first broken field, NULL for valid lines."""
    cases = []
    for kind, rules in _RULES.items():
        ok = {n: _field_ok(kind, i + 1 + (kind == "BreastCancer"), n, lo, hi) for i, (n, lo, hi) in enumerate(rules)}
        if kind == "BreastCancer":
            ok = {"c0": "coalesce(regexp_full_match(trim(f[1], ' '), '[0-9]+'), false)", **ok}
        whens = " ".join(f"WHEN NOT {c} THEN '{n}'" for n, c in ok.items())
        cases.append(f"WHEN kind = '{kind}' THEN CASE {whens} WHEN len(f) > {len(ok)} THEN 'end_of_line' END")
    return f"b AS (SELECT *, CASE WHEN t IS NULL THEN NULL {' '.join(cases)} END AS broken_field FROM s)"


_BROKEN = _LINES + _broken_sql()
_FAILED = "(t IS NULL OR kind IS NULL OR broken_field IS NOT NULL)"
_QUOTED = '([^",]*|"([^"]|"")*")'
_REASONS = f"""{_BROKEN}
SELECT line_id, kind, CASE WHEN t IS NULL THEN 'null_line' WHEN kind IS NULL THEN 'unknown_kind' WHEN regexp_full_match(t, '[\\s\\x0B]*') THEN 'blank'
    WHEN NOT regexp_full_match(t, '{_QUOTED}(,{_QUOTED})*') THEN 'broken_quotes'
    WHEN n_fields <> CASE kind WHEN 'BreastCancer' THEN 11 ELSE 35 END THEN 'field_count' ELSE 'invalid_value' END AS reason, broken_field, n_fields
FROM (SELECT *, len(regexp_replace(regexp_replace(t, '"[^"]*("|$)', '', 'g'), '[^,]', '', 'g'))::INTEGER + 1 AS n_fields FROM b) WHERE {_FAILED}
"""


def _typed_sql(kind: str) -> str:
    names = (["c0"] if kind == "BreastCancer" else []) + [n for n, _, _ in _RULES[kind]]
    cols = ", ".join(f"TRY_CAST(TRY_CAST(trim(f[{i + 1}], ' ') AS DOUBLE) AS {'BIGINT' if kind == 'BreastCancer' and n == 'c0' else 'INTEGER'}) AS {n}" for i, n in enumerate(names))
    return f"{_BROKEN} SELECT line_id, {cols} FROM b WHERE kind = '{kind}' AND NOT {_FAILED}"


_USABLE = "(SELECT DISTINCT pt_id, lat, lon FROM hubei_points WHERE lat BETWEEN 15 AND 55 AND lon BETWEEN 70 AND 140)"
_WITHIN = f"""
g AS (SELECT objectid, any_value(shape_area) AS shape_area, any_value(coordinates) AS c FROM hubei_463
      WHERE coordinates IS NOT NULL AND len(coordinates) > 0 GROUP BY objectid),
r AS (SELECT objectid, shape_area, k AS ring, c[k] AS v FROM g, range(1, 100) t(k) WHERE k <= len(c)),
e AS (SELECT objectid, shape_area, ring, v[i][1] AS x1, v[i][2] AS y1, v[i % len(v) + 1][1] AS x2, v[i % len(v) + 1][2] AS y2
      FROM r, range(1, 5000) t(i) WHERE i <= len(v)),
hit AS (SELECT pt_id, objectid, shape_area, ring, count(*) % 2 AS odd FROM p JOIN e
        ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL),
ins AS (SELECT pt_id, objectid, shape_area FROM hit WHERE odd = 1 GROUP BY ALL HAVING min(ring) = 1 AND max(ring) = 1),
w AS (SELECT objectid AS a_id, pt_id AS b_id FROM ins
      QUALIFY row_number() OVER (PARTITION BY pt_id ORDER BY shape_area NULLS LAST, objectid) = 1)
"""
_NEAR = """
c AS (SELECT pt_id, lat, lon, CAST(floor(lat * 1000) AS BIGINT) AS cy, CAST(floor(lon * 1000) AS BIGINT) AS cx FROM p),
n AS (SELECT a.pt_id AS a_id, b.pt_id AS b_id FROM c a, range(-1, 2) dy(dy), range(-2, 3) dx(dx), c b
      WHERE b.cy = a.cy + dy AND b.cx = a.cx + dx AND a.pt_id < b.pt_id
      AND 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
          + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 50)
"""

_P5 = """
SELECT DISTINCT 'breast_cancer' AS src, rec_id, 'c6' AS field FROM breast_cancer
  WHERE NOT coalesce(regexp_full_match(trim(c6, ' '), '[0-9]+([.]0+)?') AND TRY_CAST(trim(c6, ' ') AS DOUBLE) BETWEEN 1 AND 10, false)
UNION ALL SELECT DISTINCT 'breast_cancer', rec_id, 'c10' FROM breast_cancer WHERE coalesce(c10 NOT IN (1, 2), true)
UNION ALL SELECT DISTINCT 'dermatology', rec_id, 'c33' FROM dermatology WHERE NOT coalesce(NOT isnan(c33) AND c33 > 0 AND c33 <= 100, false)
"""

ORACLE = {
    "p5_marks": f"SELECT src, field, count(*) AS n, count(*) AS filled, count(*) AS marked FROM ({_P5}) GROUP BY ALL",
    "p5_found": _P5,
    "p1_found": f"{_BROKEN} SELECT line_id FROM b WHERE {_FAILED}",
    "p1_reasons": _REASONS,
    "p1_breast_cancer_rows": _typed_sql("BreastCancer"),
    "p1_dermatology_rows": _typed_sql("Dermatology"),
    "p2_found": f"WITH p AS {_USABLE}, {_WITHIN}, {_NEAR} SELECT 'near' AS kind, a_id, b_id FROM n UNION ALL SELECT 'within', a_id, b_id FROM w",
    "p2_region_counts": f"""WITH p AS {_USABLE}, {_WITHIN} SELECT a_id AS objectid, any_value(name) AS name, count(*) AS n_points FROM w
        LEFT JOIN (SELECT objectid, max(trim(name)) AS name FROM hubei_463 WHERE coordinates IS NOT NULL GROUP BY 1) m ON a_id = objectid GROUP BY 1""",
}
