"""DuckDB SQL for the queries of tabular diagnostics."""

from __future__ import annotations

import re

from .functions.names import is_identifier_name

ORACLES: dict[str, str] = {}

#: Columns and Spark types of the test tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
_ISO = r"\d{4}-\d{2}-\d{2}([T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)?)?"


def _profile_column(table: str, c: str, t: str) -> str:
    named = is_identifier_name(c)
    head = f"SELECT '{c}' AS name, '{t}' AS dtype"
    if t.startswith("array"):
        return f"{head}, 'unknown' AS semantic_type, NULL::BIGINT AS cardinality, count(*) - count({c}) AS null_count, NULL::DOUBLE AS identifier_confidence, NULL::BOOLEAN AS identifier_named FROM {table}"
    base = f"SELECT count({c}) AS n, count(DISTINCT {c}) AS d, count(*) - count({c}) AS nulls"
    unique = "(n >= 20 AND d / n >= 0.95)"
    if t.startswith("timestamp"):
        return f"{head}, 'datetime' AS semantic_type, d AS cardinality, nulls AS null_count, NULL AS identifier_confidence, NULL AS identifier_named FROM ({base} FROM {table})"
    if t == "string":
        inner = f"{base}, bool_and(regexp_full_match({c}, '{_ISO}') AND try_cast(substr({c}, 1, 10) AS DATE) IS NOT NULL) AS iso, bool_or(regexp_matches({c}, '\\s')) AS blank FROM {table}"
        alone, gate = f"({unique} AND NOT blank)", "NOT iso"
        kind = "CASE WHEN d <= 20 OR d / n <= 0.5 THEN 'categorical' ELSE 'text' END"
        first = "WHEN iso THEN 'datetime'"
    else:
        inner = f"{base}, max({c}) - min({c}) + 1 AS span, bool_and({c} % 1 = 0) AS whole FROM {table}"
        alone, gate, kind, first = f"({unique} AND d = n AND span = n)", "whole", "'numeric'", ""
    conf = f"CASE WHEN NOT ({gate}) THEN NULL " + (f"WHEN {unique} THEN 0.95 ELSE 0.4 END" if named else f"WHEN {alone} THEN 0.6 END")
    return f"{head}, CASE {first} WHEN coalesce({conf}, 0) >= 0.6 THEN 'identifier' ELSE {kind} END AS semantic_type, d AS cardinality, nulls AS null_count, ({conf})::DOUBLE AS identifier_confidence, CASE WHEN ({conf}) IS NOT NULL THEN {named} END AS identifier_named FROM ({inner})"


for _table, _schema in SCHEMAS.items():
    ORACLES[f"profile_{_table}"] = " UNION ALL ".join(_profile_column(_table, *c.split(" ")) for c in _schema.split(", "))

_GAPS = "(SELECT * REPLACE (nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, CASE WHEN l_quantity <= 45 THEN l_quantity END AS l_quantity) FROM lineitem)"
_LINEITEM = [c.split(" ")[0] for c in SCHEMAS["lineitem"].split(", ")]

ORACLES["null_overview"] = f"""SELECT count(*) * {len(_LINEITEM)} AS cells, (count_if(l_discount IS NULL) + count_if(l_tax IS NULL) + count_if(l_quantity IS NULL))::BIGINT AS missing_cells,
count_if(l_discount IS NULL OR l_tax IS NULL OR l_quantity IS NULL)::BIGINT AS rows_with_missing FROM {_GAPS}"""
ORACLES["null_rates"] = " UNION ALL ".join(f"SELECT '{c}' AS name, count_if({c} IS NULL)::BIGINT AS n_missing, round(avg(({c} IS NULL)::DOUBLE), 8) AS rate FROM {_GAPS}" for c in _LINEITEM)
ORACLES["value_freq_events"] = "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1"
ORACLES["value_freq_topk"] = """WITH f AS (SELECT p_brand AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1)
SELECT r::INT AS rank, label, n, NULL::BIGINT AS pooled FROM f WHERE r <= 10 UNION ALL SELECT 11, '(other)', sum(n)::BIGINT, count(*) FROM f WHERE r > 10 HAVING count(*) > 0"""
ORACLES["distinct_and_top"] = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_distinct, max(n) AS top FROM (SELECT {c}, count(*) AS n FROM lineitem GROUP BY 1)" for c in _LINEITEM)
ORACLES["constants_scan"] = " UNION ALL ".join(
    f"SELECT '{name}' AS name, CASE WHEN count(*) = 1 THEN 'constant' WHEN max(n) >= 0.99 * sum(n) THEN 'near_constant' ELSE 'varying' END AS kind, count(*) AS n_distinct, round(max(n) / sum(n), 8) AS top_share FROM (SELECT {e} AS v, count(*) AS n FROM part GROUP BY 1)"
    for name, e in (("p_partkey", "p_partkey"), ("size_is_one", "p_size = 1"), ("always", "'same'"), ("is_seven", "p_partkey = 7"))
)


def _summary(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, round(skewness({c}), 6) AS skew, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3 FROM {table}"
        for c in columns
    )


ORACLES["numeric_summary_lineitem"] = _summary("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
ORACLES["numeric_summary_orders"] = _summary("orders", ["o_totalprice"])
ORACLES["numeric_summary_events"] = _summary("events", ["value"])
_FENCES = "q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS s FROM events)"
_FLAGS = "f AS (SELECT *, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS mild, value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) AS far, abs((value - m) / s) > 3 AS z FROM events, q)"
ORACLES["outlier_flags"] = f"""WITH {_FENCES}, {_FLAGS} SELECT count(*) AS n, count_if(mild)::BIGINT AS iqr_flagged, count_if(far)::BIGINT AS iqr_extreme, count_if(z)::BIGINT AS z_flagged,
count_if(mild AND z)::BIGINT AS both_flagged, count_if(mild OR z)::BIGINT AS flagged, count_if(far AND z)::BIGINT AS extreme FROM f"""
ORACLES["outlier_positions"] = f"WITH {_FENCES}, {_FLAGS} SELECT event_id AS position, event_id FROM f WHERE mild OR z ORDER BY event_id LIMIT 10"
ORACLES["histogram_bins"] = "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1"
ORACLES["range_shown"] = """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, min(value) AS a, max(value) AS b FROM events),
f AS (SELECT greatest(a, q1 - 3 * (q3 - q1)) AS low, least(b, q3 + 3 * (q3 - q1)) AS high FROM q)
SELECT round(low, 6) AS low, round(high, 6) AS high, count_if(value < low)::BIGINT AS below, count_if(value > high)::BIGINT AS above FROM events, f GROUP BY low, high"""


def _duplicates(columns: str) -> str:
    return f"SELECT coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, count_if(n > 1)::BIGINT AS duplicate_groups, max(n) AS largest_group FROM (SELECT count(*) AS n FROM documents GROUP BY {columns})"


ORACLES["duplicate_rows"] = _duplicates("text")
ORACLES["hidden_duplicates"] = _duplicates("text, lang, source, n_chars")
ORACLES["repeated_identifiers"] = """SELECT count(*) AS repeated, count_if(k > 1)::BIGINT AS conflicting, count_if(k = 1)::BIGINT AS exact, coalesce(sum(n - 1), 0)::BIGINT AS "rows"
FROM (SELECT conv_id, count(*) AS n, count(DISTINCT (conv_id, turn, role, text)) AS k FROM conversations GROUP BY 1 HAVING count(*) > 1)"""
ORACLES["duplicate_positions"] = "WITH p AS (SELECT file_row_number AS position, row_number() OVER (PARTITION BY text ORDER BY file_row_number) AS r FROM (SELECT *, row_number() OVER () - 1 AS file_row_number FROM documents)) SELECT position FROM p WHERE r > 1 ORDER BY position LIMIT 5"
ORACLES["class_balance"] = "SELECT o_orderstatus AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM orders GROUP BY 1"
ORACLES["imbalance"] = """WITH f AS (SELECT toxic AS v, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT min(n) / sum(n) AS s FROM f)
SELECT (SELECT v::VARCHAR FROM f ORDER BY n, v LIMIT 1) AS minority_label, round(s, 8) AS minority_share, CASE WHEN s < 0.05 THEN 'medium' WHEN s < 0.1 THEN 'low' ELSE 'none' END AS severity FROM m"""
_NUM = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?\d{1,3}(,\d{3})+(\.\d+)?"
ORACLES["numbers_as_text"] = rf"""WITH t AS (SELECT CASE WHEN event_id % 40 = 0 THEN 'unknown' ELSE regexp_extract(props, '[0-9]+') END AS t FROM events), o AS (SELECT t, regexp_full_match(trim(t), '{_NUM}') AS ok FROM t)
SELECT count(t) AS non_null, round(avg(ok::DOUBLE), 8) AS numeric_share, count_if(NOT ok)::BIGINT AS non_numeric, count_if(ok AND regexp_matches(t, '^[+-]?0\d'))::BIGINT AS leading_zero FROM o"""
ORACLES["text_tokens"] = rf"""WITH t AS (SELECT CASE WHEN event_id % 40 = 0 THEN 'n' || (event_id % 7) ELSE regexp_extract(props, '[0-9]+') END AS t FROM events)
SELECT t AS token, count(*) AS n FROM t WHERE NOT regexp_full_match(t, '{_NUM}') GROUP BY 1 ORDER BY n DESC, token LIMIT 5"""
ORACLES["leading_zero_codes"] = r"""SELECT count(t) AS checked, count_if(regexp_matches(t, '^[+-]?0\d'))::BIGINT AS "values", min(length(t))::INT AS shortest, max(length(t))::INT AS longest FROM (SELECT list_extract(string_split(c_name, '#'), -1) AS t FROM customer)"""
ORACLES["future_dates"] = "SELECT count(l_shipdate) AS checked, count_if(l_shipdate::DATE > DATE '2001-01-01')::BIGINT AS future, strftime(max(l_shipdate)::DATE, '%Y-%m-%d') AS latest FROM lineitem"
ORACLES["invalid_dates"] = "SELECT count(*) AS checked, count_if(try_cast(t AS DATE) IS NULL)::BIGINT AS invalid FROM (SELECT '2024-02-' || lpad((o_orderkey % 31 + 1)::VARCHAR, 2, '0') AS t FROM orders)"
ORACLES["iso_moments"] = f"SELECT count(t) AS n, count_if(regexp_full_match(t, '{_ISO}'))::BIGINT AS valid FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad((o_orderkey % 26)::VARCHAR, 2, '0') || ':30Z' AS t FROM orders)"
ORACLES["negative_quantities"] = "SELECT count(c_acctbal) AS checked, count_if(c_acctbal < 0)::BIGINT AS negative, count_if(c_acctbal > 120)::BIGINT AS above_maximum, round(min(c_acctbal), 6) AS min, round(max(c_acctbal), 6) AS max FROM customer"
_EMAIL = r"[\p{L}\p{N}_.+%-]+@[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)*\.[A-Za-z]{2,}"
ORACLES["pii_email"] = f"SELECT count(w) AS checked, count_if(regexp_full_match(w, '{_EMAIL}'))::BIGINT AS matched FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents)"
ORACLES["pii_email_search"] = f"SELECT count_if(regexp_matches(text, '{_EMAIL}'))::BIGINT AS documents FROM documents"
ORACLES["pii_phone"] = r"""WITH t AS (SELECT CASE c_custkey % 3 WHEN 0 THEN '+49 30 1234 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 1 THEN '555-123-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') ELSE '10.0.12.' || c_custkey END AS t FROM customer),
m AS (SELECT t, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(t, '[^ .()-]', '', 'g')) AS seps FROM t)
SELECT count(t) AS checked, count_if(length(t) BETWEEN 9 AND 30 AND regexp_full_match(t, '\+?\(?\d{1,4}\)?([\s.-]?\(?\d{1,4}\)?){2,5}') AND NOT regexp_full_match(t, '\d{1,3}(\.\d{1,3}){3}')
AND NOT regexp_full_match(t, '\d{3}-\d{2}-\d{4}') AND digits BETWEEN 9 AND 15 AND (t LIKE '+%' OR seps >= 2))::BIGINT AS matched FROM m"""
ORACLES["pii_ssn"] = r"""WITH t AS (SELECT printf('%03d-%02d-%04d', o_orderkey % 1000, o_orderkey % 100, o_orderkey % 5000) AS t FROM orders)
SELECT count(t) AS checked, count_if(split_part(t, '-', 1) NOT IN ('000', '666') AND t NOT LIKE '9%' AND split_part(t, '-', 2) <> '00' AND split_part(t, '-', 3) <> '0000')::BIGINT AS matched FROM t"""
ORACLES["pii_nino"] = r"""WITH t AS (SELECT substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (o_orderkey % 26 + 1)::INT, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (o_orderkey // 26 % 26 + 1)::INT, 1) || '123456' || substr('ABCDE', (o_orderkey % 5 + 1)::INT, 1) AS t FROM orders)
SELECT count(t) AS checked, count_if(regexp_full_match(t, '[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]') AND substr(t, 1, 2) NOT IN ('BG', 'GB', 'KN', 'NK', 'NT', 'TN', 'ZZ'))::BIGINT AS matched FROM t"""
ORACLES["pii_iban"] = r"""WITH t AS (SELECT lpad((c_custkey % 97 + 2)::VARCHAR, 2, '0') AS k, '50010517' || '54' || lpad((c_custkey % 9999)::VARCHAR, 8, '0') AS b FROM customer)
SELECT count(*) AS checked, count_if((b || '1314' || k)::HUGEINT % 97 = 1)::BIGINT AS matched FROM t"""
_WORD = r"[A-ZÀ-ÖØ-Þ][\p{L}\p{Nl}\p{No}]*([''’-][\p{L}\p{Nl}\p{No}]+)*\.?"
ORACLES["pii_names"] = rf"""WITH t AS (SELECT upper(substr(f, 1, 1)) || lower(substr(f, 2)) AS f, p_name, p_partkey FROM (SELECT split_part(p_name, ' ', 1) AS f, p_name, p_partkey FROM part)),
u AS (SELECT CASE p_partkey % 4 WHEN 0 THEN f || ' van O''Neil' WHEN 1 THEN f ELSE p_name END AS t FROM t)
SELECT count(t) AS checked, count_if(length(t) <= 60 AND regexp_full_match(t, '{_WORD}( (van|von|de|der|da|di|del|la|le|bin|al|{_WORD})){{0,3}}'))::BIGINT AS matched FROM u"""
_COUNT = r"len(regexp_extract_all({}, '[\p{{L}}\p{{Nl}}\p{{No}}]+'))"
ORACLES["word_counts"] = f"SELECT sum({_COUNT.format('text')})::BIGINT AS words, count_if({_COUNT.format('text')} >= 5)::BIGINT AS long_texts FROM documents"
ORACLES["free_text_columns"] = " UNION ALL ".join(f"SELECT '{c}' AS name, avg(({_COUNT.format(c)} >= 5)::DOUBLE) >= 0.5 AS free_text FROM conversations" for c in ("role", "text"))
ORACLES["country_code_share"] = "SELECT round(avg(regexp_full_match(upper(substr(n_name, 1, 3)), '[A-Z]{2,3}')::DOUBLE), 8) AS share FROM nation"


def _pairs(columns: dict[str, str], source: str, digits: int) -> str:
    names = list(columns)
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({columns[a]}, {columns[b]}), {digits}) AS r FROM {source}" for i, a in enumerate(names) for b in names[i + 1 :])


_BASE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLES["correlation_matrix"] = _pairs({c: c for c in _BASE}, "lineitem", 8)
ORACLES["correlation_matrix_wide"] = _pairs({c: c for c in _BASE} | {f"{c}_2": f"{c} * {c}" for c in _BASE} | {f"{c}_h": f"sqrt(abs({c}))" for c in _BASE} | {"l_linenumber": "l_linenumber::DOUBLE"}, "lineitem", 6)
ORACLES["correlated_pairs"] = f"SELECT a, b, r FROM ({_pairs({'n_chars': 'n_chars', 'length': 'length(text)', 'doc_id': 'doc_id'}, 'documents', 8)}) WHERE abs(r) >= 0.8"
_ETA = """WITH g AS (SELECT {g}, count(*) AS n, avg({v}) AS m, var_pop({v}) * count(*) AS w FROM {t} GROUP BY 1 HAVING count(*) >= 2),
s AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(w) AS within, sum(n * m) / sum(n) AS grand FROM g), b AS (SELECT sum(g.n * (m - grand) * (m - grand)) AS between_ FROM g, s)"""
ORACLES["eta_squared"] = _ETA.format(g="o_orderpriority", v="o_totalprice", t="orders") + " SELECT k, n, round(between_ / (between_ + within), 8) AS eta2, round((between_ / (k - 1)) / (within / (n - k)), 6) AS f FROM s, b"


def _contingency(table: str, a: str, b: str) -> str:
    return f"""c AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {table} GROUP BY 1, 2), r AS (SELECT x, sum(n)::DOUBLE AS nx FROM c GROUP BY 1), k AS (SELECT y, sum(n)::DOUBLE AS ny FROM c GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS total FROM c),
e AS (SELECT r.x, k.y, coalesce(c.n, 0) AS n, nx * ny / total AS expected FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.x = r.x AND c.y = k.y)"""


_CHI = "sum((n - expected) * (n - expected) / expected)"
ORACLES["cramers_v"] = f"""WITH {_contingency("lineitem", "l_returnflag", "l_linestatus")} SELECT count(DISTINCT x) AS "rows", count(DISTINCT y) AS cols, sum(n)::BIGINT AS n, round({_CHI}, 6) AS chi2,
round(sqrt({_CHI} / (sum(n) * (least(count(DISTINCT x), count(DISTINCT y)) - 1))), 8) AS v, round(min(expected), 6) AS least_expected FROM e"""
ORACLES["contingency_table"] = f"WITH {_contingency('labels', 'quality', 'toxic')} SELECT x, y, n, round(expected, 6) AS expected FROM e"
ORACLES["welch_missing_vs_numeric"] = " UNION ALL ".join(
    f"""(WITH w AS (SELECT count({v}) FILTER (l_discount IS NULL) AS n1, count({v}) FILTER (l_discount IS NOT NULL) AS n0, avg({v}) FILTER (l_discount IS NULL) AS m1, avg({v}) FILTER (l_discount IS NOT NULL) AS m0,
var_samp({v}) FILTER (l_discount IS NULL) AS v1, var_samp({v}) FILTER (l_discount IS NOT NULL) AS v0 FROM {_GAPS}), e AS (SELECT *, v1 / n1 AS e1, v0 / n0 AS e0 FROM w)
SELECT 'l_discount' AS indicator, '{v}' AS value, n1, n0, round((m1 - m0) / sqrt(e1 + e0), 6) AS t, round((e1 + e0) * (e1 + e0) / (e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1)), 3) AS dof, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 8) AS d FROM e)"""
    for v in ("l_extendedprice", "l_quantity")
)
ORACLES["chi2_missing_vs_category"] = f"""WITH g AS (SELECT l_returnflag, count(*)::DOUBLE AS n, count_if(l_discount IS NULL)::DOUBLE AS m FROM {_GAPS} GROUP BY 1), s AS (SELECT sum(n) AS tn, sum(m) AS tm FROM g),
c AS (SELECT count(*) AS k, sum(pow(m - n * tm / tn, 2) / (n * tm / tn) + pow(n - m - n * (tn - tm) / tn, 2) / (n * (tn - tm) / tn)) AS chi2, max(tn) AS tn FROM g, s) SELECT k, round(chi2, 6) AS chi2, round(sqrt(chi2 / tn), 8) AS v FROM c"""
ORACLES["phi_missing_pairs"] = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(({a} IS NULL)::INT, ({b} IS NULL)::INT), 8) AS phi, count_if({a} IS NULL AND {b} IS NULL)::BIGINT AS n_both FROM {_GAPS}" for a, b in (("l_discount", "l_tax"), ("l_discount", "l_quantity"), ("l_tax", "l_quantity"))
)
ORACLES["temporal_association"] = "SELECT count(*) AS n, round(corr(epoch_us(ts)::DOUBLE, value), 8) AS r FROM events"
ORACLES["group_candidates"] = "SELECT count(DISTINCT user_id) AS k, round(count(*) / count(DISTINCT user_id), 6) AS rows_each, count(DISTINCT user_id) <= 50 AS tested FROM events"
ORACLES["small_n"] = " UNION ALL ".join(f"SELECT '{t}' AS name, round(count(*) * 0.2::DOUBLE, 6) AS expected_test_rows, CASE WHEN count(*) * 0.2 < 15 THEN 'high' WHEN count(*) * 0.2 < 30 THEN 'medium' ELSE 'none' END AS severity FROM {t}" for t in ("nation", "region", "supplier"))


def _leak(e: str, name: str) -> str:
    return f"(WITH {_contingency('orders', e, 'o_orderstatus')} SELECT '{name}' AS name, 'cramers_v' AS kind, round(sqrt({_CHI} / (sum(n) * (least(count(DISTINCT x), count(DISTINCT y)) - 1))), 6) AS effect FROM e)"


ORACLES["leakage_scan"] = " UNION ALL ".join(
    [_leak("'s-' || o_orderstatus", "status_copy"), _leak("o_orderpriority", "o_orderpriority"), "(" + _ETA.format(g="o_orderstatus", v="o_totalprice", t="orders") + " SELECT 'o_totalprice' AS name, 'eta_squared' AS kind, round(sqrt(between_ / (between_ + within)), 6) AS effect FROM s, b)"]
)
ORACLES["group_means"] = "SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus), 6) AS group_mean FROM lineitem"
ORACLES["quantile_bins"] = """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
SELECT ((o_totalprice >= a)::INT + (o_totalprice >= b)::INT + (o_totalprice >= c)::INT)::BIGINT AS bin, count(*) AS n FROM orders, q GROUP BY 1"""

_SOME_GAPS = ("l_quantity", "l_discount", "l_tax", "l_returnflag")
ORACLES["missingness_metrics"] = " UNION ALL ".join(
    [f"SELECT '{c}' AS name, count_if({c} IS NULL)::BIGINT AS n_missing, round(avg(({c} IS NULL)::DOUBLE), 8) AS rate, count_if({c} IS NULL) = 0 AS complete FROM {_GAPS}" for c in _SOME_GAPS]
    + [f"SELECT '(rows)' AS name, count_if({' OR '.join(f'{c} IS NULL' for c in _SOME_GAPS)})::BIGINT AS n_missing, round(avg(({' OR '.join(f'{c} IS NULL' for c in _SOME_GAPS)})::DOUBLE), 8) AS rate, false AS complete FROM {_GAPS}"]
)
ORACLES["constants_metrics"] = " UNION ALL ".join(
    f"SELECT '{name}' AS name, CASE WHEN count(*) = 1 THEN 'constant' WHEN max(n) >= 0.99 * sum(n) THEN 'near_constant' ELSE 'varying' END AS kind, sum(n)::BIGINT AS non_null, count(*) AS n_distinct, round(max(n) / sum(n), 8) AS top_share FROM (SELECT {e} AS v, count(*) AS n FROM part GROUP BY 1)"
    for name, e in (("p_partkey", "p_partkey"), ("size_is_one", "p_size = 1"), ("always", "'same'"), ("is_seven", "p_partkey = 7"))
)
ORACLES["duplicates_metrics"] = f"SELECT *, round(duplicate_rows / (SELECT count(*) FROM documents), 8) AS rate FROM ({_duplicates('text, lang, source, n_chars')})"


def _outliers(source: str, c: str) -> str:
    return f"""(WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s FROM {source}),
f AS (SELECT {c} AS x, q.*, {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) AS mild, {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1) AS far, abs(({c} - m) / s) > 3 AS z FROM {source}, q WHERE {c} IS NOT NULL)
SELECT '{c}' AS name, round(max(q1), 6) AS q1, round(max(q3), 6) AS q3, round(max(q1 - 1.5 * (q3 - q1)), 6) AS mild_low, round(max(q3 + 1.5 * (q3 - q1)), 6) AS mild_high, round(max(q1 - 3 * (q3 - q1)), 6) AS extreme_low,
round(max(q3 + 3 * (q3 - q1)), 6) AS extreme_high, round(count_if(mild OR z) / count(*), 6) AS rate, count(*) AS n, count_if(mild)::BIGINT AS iqr_flagged, count_if(far)::BIGINT AS iqr_extreme, count_if(z)::BIGINT AS z_flagged,
count_if(mild AND z)::BIGINT AS both_flagged, count_if(mild OR z)::BIGINT AS flagged, count_if(far AND z)::BIGINT AS extreme FROM f)"""


ORACLES["outliers_metrics"] = " UNION ALL ".join([*(_outliers(_GAPS, c) for c in ("l_quantity", "l_extendedprice", "l_discount")), _outliers("events", "value")])
ORACLES["dtypes_metrics"] = rf"""WITH t AS (SELECT CASE WHEN event_id % 40 = 0 THEN 'n' || (event_id % 7) ELSE regexp_extract(props, '[0-9]+') END AS t FROM events), o AS (SELECT t, regexp_full_match(trim(t), '{_NUM}') AS ok FROM t),
k AS (SELECT t, count(*) AS n FROM o WHERE NOT ok GROUP BY 1 ORDER BY n DESC, t LIMIT 5)
SELECT 'units' AS name, 'numbers_as_text' AS kind, count(t) AS non_null, round(avg(ok::DOUBLE), 8) AS numeric_share, count_if(NOT ok)::BIGINT AS non_numeric, count_if(ok AND regexp_matches(t, '^[+-]?0\d'))::BIGINT AS leading_zero,
(SELECT string_agg(t || ':' || n, ',' ORDER BY n DESC, t) FROM k) AS tokens FROM o"""
ORACLES["impossible_metrics"] = """SELECT 'age' AS name, count(l_linenumber) AS checked, count_if(l_linenumber * 40 > 120 OR l_linenumber < 0)::BIGINT AS impossible, round(avg((l_linenumber * 40 > 120)::DOUBLE), 8) AS rate, (max(l_linenumber) * 40)::VARCHAR AS greatest FROM lineitem
UNION ALL SELECT 'l_shipdate', count(l_shipdate), 0, 0.0, strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem"""
ORACLES["pii_metrics"] = """WITH n AS (SELECT count(*) AS n, count_if(c_custkey % 10 < 8)::BIGINT AS mail, count_if(c_custkey % 899 + 1 <> 666 AND c_custkey % 5000 <> 0)::BIGINT AS ssn FROM customer)
SELECT 'contact' AS name, 'email' AS kind, CASE WHEN mail >= 0.8 * n THEN 'column' ELSE 'partial' END AS evidence, '' AS format, mail AS matched, n AS checked FROM n
UNION ALL SELECT 'tax_ref', 'national_id', 'column', 'us_ssn', ssn, n FROM n UNION ALL SELECT 'email', 'email', 'name', '', 0, 0 UNION ALL SELECT 'phone_number', 'phone', 'name', '', 0, 0"""
_STATISTICS = {"count": "count(x)", "missing": "count_if(x IS NULL)", "mean": "avg(x)", "std": "stddev_samp(x)", "min": "min(x)", "q1": "quantile_cont(x, 0.25)", "median": "quantile_cont(x, 0.5)", "q3": "quantile_cont(x, 0.75)", "max": "max(x)", "skew": "skewness(x)"}
ORACLES["univariate_metrics"] = " UNION ALL ".join(
    [f"SELECT 'o_totalprice' AS name, '{k}' AS statistic, NULL::VARCHAR AS label, round(({e})::DOUBLE, 6) AS value FROM (SELECT o_totalprice AS x FROM orders)" for k, e in _STATISTICS.items()]
    + ["SELECT 'o_orderpriority', 'label', o_orderpriority, count(*)::DOUBLE FROM orders GROUP BY o_orderpriority", "SELECT 'o_orderpriority', 'distinct', NULL, count(DISTINCT o_orderpriority)::DOUBLE FROM orders"]
)
_BY_STATUS = {c: "(" + _ETA.format(g="o_orderstatus", v=v, t="orders") + f" SELECT '{c}' AS name, 'eta_squared' AS kind, round(sqrt(between_ / (between_ + within)), 6) AS effect FROM s, b)" for c, v in (("o_totalprice", "o_totalprice"), ("o_orderdate", "datediff('day', DATE '1970-01-01', o_orderdate::DATE)"))}
_LEAKS = [_leak("'s-' || o_orderstatus", "status_copy"), _leak("o_orderpriority", "o_orderpriority"), _BY_STATUS["o_totalprice"]]
ORACLES["relationships_metrics"] = " UNION ALL ".join([*_LEAKS, "SELECT o_orderstatus, 'share', round(count(*) / sum(count(*)) OVER (), 6) FROM orders GROUP BY 1"])
ORACLES["leakage_metrics"] = f"SELECT name, effect, effect >= 0.9 AND effect < 0.999 AS near_perfect, effect >= 0.999 AS copied FROM ({' UNION ALL '.join(_LEAKS)})"
ORACLES["splits_metrics"] = f"""SELECT 'expected_test_rows' AS name, round(count(*) * 0.2::DOUBLE, 6) AS value, count(*) * 0.2 < 30 AS flagged FROM orders
UNION ALL (SELECT 'minority_share', round(min(n) / sum(n), 6), min(n) / sum(n) < 0.1 FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) UNION ALL SELECT name, effect, effect >= 0.3 FROM {_BY_STATUS["o_orderdate"]}"""
ORACLES["embedded_phones"] = "SELECT count(*) AS checked, count_if(c_custkey % 4 <= 1)::BIGINT AS contact FROM customer"

assert all(re.fullmatch(r"\w+", k) for k in ORACLES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
