"""Small text helpers for writing the DuckDB oracle SQL of each registered query."""

from __future__ import annotations

from collections.abc import Callable, Sequence


def qi(name: str) -> str:
    """Double-quote an identifier for DuckDB."""
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def per_column(cols: Sequence[str], body: Callable[[str], str]) -> str:
    """``UNION ALL`` of one SELECT per column."""
    return "\nUNION ALL\n".join(body(c) for c in cols)


def dbl(src: str, col: str, alias: str = "x") -> str:
    """``SELECT CAST(col AS DOUBLE) AS x FROM src`` with NaN as NULL."""
    return f"(SELECT CASE WHEN isnan(CAST({qi(col)} AS DOUBLE)) THEN NULL ELSE CAST({qi(col)} AS DOUBLE) END AS {alias} FROM {src})"


# ── DuckDB mirror of the column profile, for oracles of rules built on it ──────

BOOL_WORDS_SQL = "('yes','no','y','n','true','false')"
DT_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


def _basic(src: str, col: str, kind: str, pos: int) -> str:
    c = qi(col)
    if kind == "numeric":
        return (f"SELECT {lit(col)} AS col, {pos} AS pos, 'numeric' AS kind, count(*) AS n_rows, count(x) AS n, "
                f"count(DISTINCT x) AS nunique, coalesce(sum(CASE WHEN x NOT IN (0, 1) THEN 1 ELSE 0 END), 0) = 0 AS bool_ok, "
                f"false AS parse_ok, CAST(NULL AS DOUBLE) AS avg_len FROM {dbl(src, col)}")
    if kind == "string":
        return (f"SELECT {lit(col)} AS col, {pos} AS pos, 'string' AS kind, count(*) AS n_rows, count(x) AS n, "
                f"count(DISTINCT x) AS nunique, coalesce(sum(CASE WHEN x NOT IN {BOOL_WORDS_SQL} THEN 1 ELSE 0 END), 0) = 0 AS bool_ok, "
                f"(coalesce(sum(CASE WHEN x IS NOT NULL AND NOT coalesce(regexp_matches(x, '{DT_PATTERN}') AND try_cast(x AS TIMESTAMP) IS NOT NULL, false) THEN 1 ELSE 0 END), 0) = 0 AND count(x) > 0) AS parse_ok, "
                f"avg(length(x)) AS avg_len FROM (SELECT CAST({c} AS VARCHAR) AS x FROM {src})")
    return (f"SELECT {lit(col)} AS col, {pos} AS pos, 'datetime' AS kind, count(*) AS n_rows, count(x) AS n, "
            f"count(DISTINCT x) AS nunique, false AS bool_ok, false AS parse_ok, CAST(NULL AS DOUBLE) AS avg_len "
            f"FROM (SELECT CAST({c} AS TIMESTAMP) AS x FROM {src})")


SEMANTIC_CASE = """CASE WHEN nunique <= 1 THEN 'constant'
     WHEN bool_ok THEN 'boolean'
     WHEN (instr(lower(col), '_id') > 0 OR instr(lower(col), 'id_') > 0 OR instr(lower(col), ' id') > 0
           OR instr(lower(col), 'uuid') > 0 OR instr(lower(col), 'key') > 0)
          AND nunique / greatest(n, 1) > 0.9 THEN 'id'
     WHEN kind = 'datetime' THEN 'datetime'
     WHEN kind = 'string' AND parse_ok THEN 'datetime_string'
     WHEN kind = 'string' AND avg_len > 50 THEN 'text'
     WHEN kind = 'numeric' AND nunique = 2 THEN 'binary_numeric'
     WHEN kind = 'numeric' AND (nunique <= 15 OR nunique / greatest(n, 1) < 0.05) THEN 'ordinal_or_categorical_numeric'
     WHEN kind = 'numeric' THEN 'continuous'
     WHEN nunique / greatest(n, 1) < 0.5 THEN 'categorical'
     ELSE 'text' END"""

ROUTE_CASE = """CASE WHEN kind = 'numeric' AND semantic_type NOT IN ('boolean', 'id', 'constant') THEN 'numeric'
     WHEN semantic_type IN ('datetime', 'datetime_string') THEN 'datetime'
     ELSE 'categorical' END"""


def _numstats(src: str, col: str) -> str:
    return (f"SELECT {lit(col)} AS col, count(x) AS cnt, skewness(x) AS skew_raw, kurtosis(x) AS kurt_raw, "
            f"count_if(x < 0) AS negatives_count, count_if(x = 0) AS zeros_count, "
            f"quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM {dbl(src, col)}")


def _numout(src: str, col: str) -> str:
    return (f"SELECT s.col, count_if(x < s.q1 - 1.5 * (s.q3 - s.q1) OR x > s.q3 + 1.5 * (s.q3 - s.q1)) AS iqr_out "
            f"FROM {dbl(src, col)} d, ns s WHERE s.col = {lit(col)} AND d.x IS NOT NULL GROUP BY s.col")


def _labels(src: str, col: str, kind: str) -> str:
    return f"SELECT {lit(col)} AS col, CAST({qi(col)} AS VARCHAR) AS v FROM {src}"


def profile_ctes(src: str, cols: Sequence[tuple[str, str]]) -> str:
    """CTEs ending in ``prof`` (one row per column) that mirror ``profile.profile_columns``.

    ``cols`` = [(name, kind)] in table order; kind ∈ numeric / string / datetime.
    """
    basics = per_column(range(len(cols)), lambda i: _basic(src, cols[i][0], cols[i][1], i))
    nums = [n for n, k in cols if k == "numeric"]
    ns = per_column(nums, lambda c: _numstats(src, c)) if nums else \
        "SELECT NULL AS col, 0 AS cnt, 0.0 AS skew_raw, 0.0 AS kurt_raw, 0 AS negatives_count, 0 AS zeros_count, 0.0 AS q1, 0.0 AS q3 WHERE false"
    no = per_column(nums, lambda c: _numout(src, c)) if nums else "SELECT NULL AS col, 0 AS iqr_out WHERE false"
    labels = per_column(range(len(cols)), lambda i: _labels(src, cols[i][0], cols[i][1]))
    return f"""basics AS ({basics}),
sem AS (SELECT *, {SEMANTIC_CASE} AS semantic_type FROM basics),
sem2 AS (SELECT *, {ROUTE_CASE} AS profile_type, round(CAST(n_rows - n AS DOUBLE) * 100 / n_rows, 2) AS missing_pct FROM sem),
ns AS ({ns}),
no AS ({no}),
lab AS ({labels}),
vc AS (SELECT col, v, count(*) AS cnt FROM lab WHERE v IS NOT NULL GROUP BY col, v),
cs AS (SELECT col, sum(cnt) AS n_lab, count(*) AS unique_values, max(cnt) AS top_cnt FROM vc GROUP BY col),
prof AS (
  SELECT s.col AS "column", s.pos, s.kind, s.semantic_type, s.profile_type, s.n_rows - s.n AS missing_count, s.missing_pct,
         s.nunique AS cardinality,
         CASE WHEN s.profile_type = 'numeric' THEN round(CASE WHEN ns.cnt < 3 THEN NULL ELSE coalesce(ns.skew_raw, 0) END, 4) END AS skewness,
         CASE WHEN s.profile_type = 'numeric' THEN round(CASE WHEN ns.cnt < 4 THEN NULL ELSE coalesce(ns.kurt_raw, 0) END, 4) END AS kurtosis,
         CASE WHEN s.profile_type = 'numeric' THEN ns.negatives_count END AS negatives_count,
         CASE WHEN s.profile_type = 'numeric' THEN round(CAST(ns.zeros_count AS DOUBLE) * 100 / ns.cnt, 2) END AS zeros_pct,
         CASE WHEN s.profile_type = 'numeric' AND ns.cnt >= 4 THEN round(CAST(no.iqr_out AS DOUBLE) * 100 / ns.cnt, 2) END AS iqr_outlier_pct,
         CASE WHEN s.profile_type = 'categorical' THEN cs.unique_values END AS unique_values,
         CASE WHEN s.profile_type = 'categorical' THEN round(CAST(cs.top_cnt AS DOUBLE) / cs.n_lab, 4) END AS dominance,
         CASE WHEN s.profile_type = 'categorical' THEN round(CAST(cs.unique_values AS DOUBLE) / greatest(cs.n_lab, 1), 4) END AS cardinality_ratio
  FROM sem2 s LEFT JOIN ns ON ns.col = s.col LEFT JOIN no ON no.col = s.col LEFT JOIN cs ON cs.col = s.col),
prof2 AS (
  SELECT *, CASE WHEN profile_type <> 'numeric' THEN NULL
       WHEN abs(skewness) < 0.5 AND abs(kurtosis) < 1 THEN 'normal-like'
       WHEN skewness > 1 THEN 'right-skewed' WHEN skewness < -1 THEN 'left-skewed'
       WHEN kurtosis > 3 THEN 'leptokurtic (heavy tails)' WHEN kurtosis < -1 THEN 'platykurtic (light tails)'
       ELSE 'moderate' END AS distribution_shape FROM prof)"""
