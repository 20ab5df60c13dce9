"""Queries over the test tables, one or more for each operator of tabular diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core.table import POSITION, Table, sample_positions, with_positions
from .functions import predicates as P
from .operators import aggregates as A
from .operators import association as S
from .plans.schema import profile_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


PROFILED = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events", "documents", "pages", "conversations", "labels", "embeddings", "benchmark")
for _t in PROFILED:
    QUERIES[f"profile_{_t}"] = lambda spark, sf_dir, t=_t: profile_frame(Table(read(spark, sf_dir, t), t))


def with_gaps(df: DataFrame) -> DataFrame:
    """lineitem with values missing: no discount of 0, no tax of 0, no quantity over 45."""
    return df.withColumns({"l_discount": F.when(F.col("l_discount") != 0, F.col("l_discount")), "l_tax": F.when(F.col("l_tax") != 0, F.col("l_tax")), "l_quantity": F.when(F.col("l_quantity") <= 45, F.col("l_quantity"))})


def r8(c, name: str):
    return F.round(c, 8).alias(name)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query
def null_overview(spark, sf_dir):
    return A.null_overview(with_gaps(read(spark, sf_dir, "lineitem")))


@query
def null_rates(spark, sf_dir):
    df = with_gaps(read(spark, sf_dir, "lineitem"))
    row = F.array(*(F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.round(F.avg(F.col(c).isNull().cast("double")), 8).alias("rate")) for c in df.columns))
    return df.agg(row.alias("a")).select(F.inline("a"))


@query
def value_freq_events(spark, sf_dir):
    return A.frequency(read(spark, sf_dir, "events"), "event_type")


@query
def value_freq_topk(spark, sf_dir):
    return A.ranked_top(read(spark, sf_dir, "part"), "p_brand")


@query
def distinct_and_top(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return A.distinct_and_top(df, df.columns)


@query
def constants_scan(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") == 1).alias("size_is_one"), F.lit("same").alias("always"), (F.col("p_partkey") == 7).alias("is_seven"))
    n = df.agg(F.count("*").alias("n"))
    kind = F.when(F.col("n_distinct") == 0, "all_null").when(F.col("n_distinct") == 1, "constant").when(F.col("top") >= 0.99 * F.col("n"), "near_constant").otherwise("varying")
    return A.distinct_and_top(df, df.columns).crossJoin(n).select(F.col("column").alias("name"), kind.alias("kind"), "n_distinct", r8(F.col("top") / F.col("n"), "top_share"))


def _summary(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = []
    for c in columns:
        x = P.finite(F.col(c))
        q = F.percentile(x, [0.25, 0.5, 0.75])
        parts.append(
            F.struct(F.lit(c).alias("name"), F.count(x).alias("n"), r6(F.avg(x), "mean"), r6(F.stddev_samp(x), "std"), F.min(x).alias("min"), F.max(x).alias("max"), r6(A.bias_free_skew(x), "skew"), r6(q[0], "q1"), r6(q[1], "median"), r6(q[2], "q3"))
        )
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


@query
def numeric_summary_lineitem(spark, sf_dir):
    return _summary(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query
def numeric_summary_orders(spark, sf_dir):
    return _summary(read(spark, sf_dir, "orders"), ["o_totalprice"])


@query
def numeric_summary_events(spark, sf_dir):
    return _summary(read(spark, sf_dir, "events"), ["value"])


def _flags(df: DataFrame) -> tuple[DataFrame, dict]:
    x = P.finite(F.col("value"))
    q = F.percentile(x, [0.25, 0.75])
    fences = df.agg(q[0].alias("q1"), q[1].alias("q3"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    both = df.crossJoin(F.broadcast(fences))  # one row
    iqr = F.col("q3") - F.col("q1")
    beyond = lambda k: (x < F.col("q1") - k * iqr) | (x > F.col("q3") + k * iqr)
    z = F.abs((x - F.col("m")) / F.col("s")) > 3
    return both, {"mild": beyond(1.5), "far": beyond(3.0), "z": z}


@query
def outlier_flags(spark, sf_dir):
    df, f = _flags(read(spark, sf_dir, "events"))
    count = lambda c, n: F.count_if(c).alias(n)
    return df.agg(F.count("*").alias("n"), count(f["mild"], "iqr_flagged"), count(f["far"], "iqr_extreme"), count(f["z"], "z_flagged"), count(f["mild"] & f["z"], "both_flagged"), count(f["mild"] | f["z"], "flagged"), count(f["far"] & f["z"], "extreme"))


@query
def outlier_positions(spark, sf_dir):
    df, f = _flags(with_positions(read(spark, sf_dir, "events")))
    return df.where(f["mild"] | f["z"]).select(F.col(POSITION).alias("position"), "event_id").orderBy("position").limit(10)


@query
def histogram_bins(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    ends = F.broadcast(df.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")))
    b = F.least(F.floor((F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20), F.lit(19))
    return df.crossJoin(ends).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query
def range_shown(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    q = F.percentile("value", [0.25, 0.75])
    f = df.agg(q[0].alias("q1"), q[1].alias("q3"), F.min("value").alias("a"), F.max("value").alias("b"))
    iqr = F.col("q3") - F.col("q1")
    f = f.select(F.greatest("a", F.col("q1") - 3 * iqr).alias("low"), F.least("b", F.col("q3") + 3 * iqr).alias("high"))
    return df.crossJoin(F.broadcast(f)).groupBy("low", "high").agg(F.count_if(F.col("value") < F.col("low")).alias("below"), F.count_if(F.col("value") > F.col("high")).alias("above")).select(r6(F.col("low"), "low"), r6(F.col("high"), "high"), "below", "above")


@query
def duplicate_rows(spark, sf_dir):
    return A.duplicate_summary(read(spark, sf_dir, "documents"), ["text"])


@query
def hidden_duplicates(spark, sf_dir):
    return A.duplicate_summary(read(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"])


@query
def repeated_identifiers(spark, sf_dir):
    df = read(spark, sf_dir, "conversations")
    return A.repeated_identifiers(df, "conv_id", df.columns)


@query
def duplicate_positions(spark, sf_dir):
    return A.repeat_positions(with_positions(read(spark, sf_dir, "documents")), ["text"], POSITION)


@query
def class_balance(spark, sf_dir):
    counts = A.frequency(read(spark, sf_dir, "orders"), "o_orderstatus")
    return counts.crossJoin(counts.agg(F.sum("n").alias("t"))).select(F.col("value").alias("label"), "n", r8(F.col("n") / F.col("t"), "share"))


@query
def imbalance(spark, sf_dir):
    counts = A.frequency(read(spark, sf_dir, "labels"), "toxic")
    share = F.min("n") / F.sum("n")
    return counts.agg(F.min(F.struct("n", "value"))["value"].cast("string").alias("minority_label"), r8(share, "minority_share"), F.when(share < 0.05, "medium").when(share < 0.1, "low").otherwise("none").alias("severity"))


@query
def numbers_as_text(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 40 == 0, F.lit("unknown")).otherwise(F.regexp_extract("props", "[0-9]+", 0)).alias("t"))
    ok = P.is_number_text(F.col("t"))
    return df.agg(F.count("t").alias("non_null"), r8(F.avg(ok.cast("double")), "numeric_share"), F.count_if(~ok).alias("non_numeric"), F.count_if(ok & P.has_leading_zero(F.col("t"))).alias("leading_zero"))


@query
def text_tokens(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 40 == 0, F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string"))).otherwise(F.regexp_extract("props", "[0-9]+", 0)).alias("t"))
    return A.frequency(df.where(~P.is_number_text(F.col("t"))), "t").where(F.length("value") <= 20).orderBy(F.desc("n"), "value").limit(5).select(F.col("value").alias("token"), "n")


@query
def leading_zero_codes(spark, sf_dir):
    code = F.element_at(F.split("c_name", "#"), -1)
    return read(spark, sf_dir, "customer").select(code.alias("t")).agg(F.count("t").alias("checked"), F.count_if(P.has_leading_zero(F.col("t"))).alias("values"), F.min(F.length("t")).alias("shortest"), F.max(F.length("t")).alias("longest"))


@query
def future_dates(spark, sf_dir):
    day = P.day_of(F.col("l_shipdate"), "moment")
    return read(spark, sf_dir, "lineitem").agg(F.count("l_shipdate").alias("checked"), F.count_if(day > F.to_date(F.lit("2001-01-01"))).alias("future"), F.date_format(F.max(day), "yyyy-MM-dd").alias("latest"))


@query
def invalid_dates(spark, sf_dir):
    text = F.concat(F.lit("2024-02-"), F.lpad((F.col("o_orderkey") % 31 + 1).cast("string"), 2, "0"))
    df = read(spark, sf_dir, "orders").select(text.alias("t"))
    return df.agg(F.count_if(P.looks_like_date(F.col("t"))).alias("checked"), F.count_if(P.looks_like_date(F.col("t")) & P.day_of(F.col("t"), "string").isNull()).alias("invalid"))


@query
def iso_moments(spark, sf_dir):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.lpad((F.col("o_orderkey") % 26).cast("string"), 2, "0"), F.lit(":30Z"))
    return read(spark, sf_dir, "orders").select(text.alias("t")).agg(F.count("t").alias("n"), F.count_if(P.is_iso_moment(F.col("t"))).alias("valid"))


@query
def negative_quantities(spark, sf_dir):
    x = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").agg(F.count(x).alias("checked"), F.count_if(x < 0).alias("negative"), F.count_if(x > 120).alias("above_maximum"), r6(F.min(x), "min"), r6(F.max(x), "max"))


@query
def pii_email(spark, sf_dir):
    words = F.explode(F.split("text", "[ \n]+")).alias("w")
    df = read(spark, sf_dir, "documents").select(words)
    return df.agg(F.count("w").alias("checked"), F.count_if(P.is_email(F.col("w"))).alias("matched"))


@query
def pii_email_search(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count_if(F.col("text").contains("@") & F.col("text").rlike(P.EMAIL)).alias("documents"))


@query
def pii_phone(spark, sf_dir):
    n = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("+49 30 1234 "), n)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("555-123-"), n)).otherwise(F.concat(F.lit("10.0.12."), F.col("c_custkey").cast("string")))
    return read(spark, sf_dir, "customer").select(text.alias("t")).agg(F.count("t").alias("checked"), F.count_if(P.is_phone(F.col("t"))).alias("matched"))


@query
def pii_ssn(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.format_string("%03d-%02d-%04d", k % 1000, k % 100, k % 5000)
    return read(spark, sf_dir, "orders").select(text.alias("t")).agg(F.count("t").alias("checked"), F.count_if(P.is_us_ssn(F.col("t"))).alias("matched"))


@query
def pii_nino(spark, sf_dir):
    k = F.col("o_orderkey")
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    at = lambda n: F.substr(letters, (n % 26 + 1).cast("int"), F.lit(1))
    text = F.concat(at(k), at(F.floor(k / 26)), F.lit(" 12 34 56 "), at(k % 5))
    return read(spark, sf_dir, "orders").select(text.alias("t")).agg(F.count("t").alias("checked"), F.count_if(P.is_uk_nino(F.col("t"))).alias("matched"))


@query
def pii_iban(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(F.lit("DE"), F.lpad((k % 97 + 2).cast("string"), 2, "0"), F.lit("5001 0517 54"), F.lpad((k % 9999).cast("string"), 8, "0"))
    return read(spark, sf_dir, "customer").select(text.alias("t")).agg(F.count("t").alias("checked"), F.count_if(P.is_iban(F.col("t"))).alias("matched"))


@query
def pii_names(spark, sf_dir):
    first = F.initcap(F.substring_index("p_name", " ", 1))
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(first, F.lit(" van O'Neil"))).when(F.col("p_partkey") % 4 == 1, first).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(text.alias("t")).agg(F.count("t").alias("checked"), F.count_if(P.is_person_name(F.col("t"))).alias("matched"))


@query
def word_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.sum(P.word_count(F.col("text"))).alias("words"), F.count_if(P.word_count(F.col("text")) >= 5).alias("long_texts"))


@query
def free_text_columns(spark, sf_dir):
    df = read(spark, sf_dir, "conversations")
    parts = F.array(*(F.struct(F.lit(c).alias("name"), (F.avg((P.word_count(F.col(c)) >= 5).cast("double")) >= 0.5).alias("free_text")) for c in ("role", "text")))
    return df.agg(parts.alias("a")).select(F.inline("a"))


@query
def country_code_share(spark, sf_dir):
    code = F.upper(F.substring("n_name", 1, 3))
    return read(spark, sf_dir, "nation").agg(r8(F.avg(P.whole(code, P.COUNTRY_CODE).cast("double")), "share"))


def _long(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query
def correlation_matrix(spark, sf_dir):
    rows = S.correlation_matrix(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return _long(spark, rows, "a string, b string, n long, r double").withColumn("r", F.round("r", 8))


@query
def correlation_matrix_wide(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    wide = df.select(*(F.col(c) for c in base), *((F.col(c) * F.col(c)).alias(f"{c}_2") for c in base), *(F.sqrt(F.abs(F.col(c))).alias(f"{c}_h") for c in base), F.col("l_linenumber").cast("double"))
    rows = S.correlation_matrix(wide, wide.columns)
    return _long(spark, rows, "a string, b string, n long, r double").withColumn("r", F.round("r", 6))


@query
def correlated_pairs(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select(F.col("n_chars").cast("double"), F.length("text").cast("double").alias("length"), F.col("doc_id").cast("double"))
    rows = [(a, b, r) for a, b, _, r in S.correlation_matrix(df, df.columns) if r is not None and abs(r) >= S.STRONG_CORRELATION]
    return _long(spark, rows, "a string, b string, r double").withColumn("r", F.round("r", 8))


@query
def eta_squared(spark, sf_dir):
    return S.eta_table(read(spark, sf_dir, "orders"), F.col("o_totalprice"), F.col("o_orderpriority")).select("k", "n", r8(F.col("eta2"), "eta2"), r6(F.col("f"), "f"))


@query
def cramers_v(spark, sf_dir):
    t = S.cramers_table(read(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_linestatus"))
    return t.select("rows", "cols", "n", r6(F.col("chi2"), "chi2"), r8(F.sqrt(F.col("chi2") / (F.col("n") * (F.least("rows", "cols") - 1))), "v"), r6(F.col("least_expected"), "least_expected"))


@query
def contingency_table(spark, sf_dir):
    return S.contingency(read(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic")).select("x", "y", "n", r6(F.col("expected"), "expected"))


@query
def welch_missing_vs_numeric(spark, sf_dir):
    df = with_gaps(read(spark, sf_dir, "lineitem"))
    t = S.welch_table(df, {"l_discount": F.col("l_discount").isNull()}, {c: P.finite(F.col(c)) for c in ("l_extendedprice", "l_quantity")})
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    dof = (e1 + e0) * (e1 + e0) / (e1 * e1 / (F.col("n1") - 1) + e0 * e0 / (F.col("n0") - 1))
    return t.select("indicator", "value", "n1", "n0", r6((F.col("m1") - F.col("m0")) / F.sqrt(e1 + e0), "t"), F.round(dof, 3).alias("dof"), r8((F.col("m1") - F.col("m0")) / F.sqrt(pooled), "d"))


@query
def chi2_missing_vs_category(spark, sf_dir):
    df = with_gaps(read(spark, sf_dir, "lineitem"))
    t = S.flags_by_category(df, {"d": F.col("l_discount").isNull()}, F.col("l_returnflag"))
    s = F.broadcast(t.agg(F.sum("n").alias("tn"), F.sum("m_d").alias("tm")))
    e1, e0 = F.col("n") * F.col("tm") / F.col("tn"), F.col("n") * (F.col("tn") - F.col("tm")) / F.col("tn")
    chi2 = F.sum(F.pow(F.col("m_d") - e1, 2) / e1 + F.pow(F.col("n") - F.col("m_d") - e0, 2) / e0)
    return t.crossJoin(s).agg(F.count("*").alias("k"), r6(chi2, "chi2"), r8(F.sqrt(chi2 / F.max("tn")), "v"))


@query
def phi_missing_pairs(spark, sf_dir):
    df = with_gaps(read(spark, sf_dir, "lineitem"))
    names = ["l_discount", "l_tax", "l_quantity"]
    n, ones, both = S.flag_pairs(df, {c: F.col(c).isNull() for c in names})
    rows = [(a, b, S.phi(n, ones[a], ones[b], k), k) for (a, b), k in both.items()]
    return _long(spark, rows, "a string, b string, phi double, n_both long").withColumn("phi", F.round("phi", 8))


@query
def temporal_association(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(P.ordinal(F.col("ts"), "moment").alias("t"), "value")
    return df.agg(F.count("*").alias("n"), r8(S.correlation(F.col("t"), F.col("value")), "r"))


@query
def group_candidates(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    return df.agg(F.count_distinct("user_id").alias("k"), F.count("*").alias("n")).select("k", r6(F.col("n") / F.col("k"), "rows_each"), (F.col("k") <= 50).alias("tested"))


@query
def small_n(spark, sf_dir):
    out = None
    for t in ("nation", "region", "supplier"):
        one = read(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), r6(F.col("n") * 0.2, "expected_test_rows"), F.when(F.col("n") * 0.2 < 15, "high").when(F.col("n") * 0.2 < 30, "medium").otherwise("none").alias("severity"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def leakage_scan(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderstatus", F.concat(F.lit("s-"), F.col("o_orderstatus")).alias("status_copy"), "o_orderpriority", "o_totalprice")
    rows = []
    for c in ("status_copy", "o_orderpriority"):
        e = S.cramers_v(df, F.col(c), F.col("o_orderstatus"))
        rows.append((c, e.kind, e.effect))
    e = S.eta(df, F.col("o_totalprice"), F.col("o_orderstatus"))
    rows.append(("o_totalprice", e.kind, e.effect))
    return _long(spark, rows, "name string, kind string, effect double").withColumn("effect", F.round("effect", 6))


@query
def seeded_sample(spark, sf_dir):
    df = with_positions(read(spark, sf_dir, "orders"))
    chosen = sample_positions(df.count(), 1000, 42)
    wanted = spark.createDataFrame([(int(p),) for p in chosen], f"{POSITION} long")
    return df.join(F.broadcast(wanted), POSITION, "left_semi").select(F.col(POSITION).alias("position"), "o_orderkey")


@query
def group_means(spark, sf_dir):
    df, keys = read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]
    means = df.groupBy(*keys).agg(F.avg("l_quantity").alias("m")).alias("g")
    same = F.col("d.l_returnflag").eqNullSafe(F.col("g.l_returnflag")) & F.col("d.l_linestatus").eqNullSafe(F.col("g.l_linestatus"))
    return df.alias("d").join(means, same).select("l_orderkey", "l_linenumber", r6(F.col("m"), "group_mean"))


@query
def quantile_bins(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    q = F.percentile("o_totalprice", [0.25, 0.5, 0.75])
    e = F.broadcast(df.agg(q[0].alias("a"), q[1].alias("b"), q[2].alias("c")))
    b = sum(((F.col("o_totalprice") >= F.col(k)).cast("int") for k in "bc"), (F.col("o_totalprice") >= F.col("a")).cast("int"))
    return df.crossJoin(e).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


# --- analyzers: their metrics as tables


def _settings():
    from .core.results import Settings

    return Settings()


def _numbers(spark, sf_dir) -> DataFrame:
    return with_gaps(read(spark, sf_dir, "lineitem")).select("l_quantity", "l_extendedprice", "l_discount")


@query
def missingness_metrics(spark, sf_dir):
    from .plans.quality import missingness

    found = missingness(Table(with_gaps(read(spark, sf_dir, "lineitem")).select("l_quantity", "l_discount", "l_tax", "l_returnflag"), "lineitem"), _settings()).metrics
    rows = [(m["name"], m["n_missing"], m["rate"], m["dependence"] == "no_missing") for m in found["columns"]]
    rows.append(("(rows)", found["overall"]["rows_with_missing"], found["overall"]["row_rate"], False))
    return _long(spark, rows, "name string, n_missing long, rate double, complete boolean").withColumn("rate", F.round("rate", 8))


@query
def constants_metrics(spark, sf_dir):
    from .plans.quality import constants

    df = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") == 1).alias("size_is_one"), F.lit("same").alias("always"), (F.col("p_partkey") == 7).alias("is_seven"))
    rows = [(m["name"], m["kind"], m["non_null"], m["distinct"], m["top_share"]) for m in constants(Table(df, "part"), _settings()).metrics["columns"]]
    return _long(spark, rows, "name string, kind string, non_null long, n_distinct long, top_share double").withColumn("top_share", F.round("top_share", 8))


@query
def duplicates_metrics(spark, sf_dir):
    from .plans.quality import duplicates

    m = duplicates(Table(read(spark, sf_dir, "documents").select("text", "lang", "source", "n_chars"), "documents"), _settings()).metrics["rows"]
    rows = [(m["duplicate_rows"], m["duplicate_groups"], m["largest_group"], m["rate"])]
    return _long(spark, rows, "duplicate_rows long, duplicate_groups long, largest_group long, rate double").withColumn("rate", F.round("rate", 8))


_FENCED = ("q1", "q3", "mild_low", "mild_high", "extreme_low", "extreme_high", "rate")
_FLAGGED = ("n", "iqr_flagged", "iqr_extreme", "z_flagged", "both_flagged", "flagged", "extreme")


@query
def outliers_metrics(spark, sf_dir):
    from .plans.quality import outliers

    found = outliers(Table(_numbers(spark, sf_dir), "lineitem"), _settings()).metrics["columns"]
    found += outliers(Table(read(spark, sf_dir, "events").select("value"), "events"), _settings()).metrics["columns"]
    rows = [(m["name"], *(m[k] for k in _FENCED), *(m[k] for k in _FLAGGED)) for m in found]
    out = _long(spark, rows, "name string, " + ", ".join(f"{k} double" for k in _FENCED) + ", " + ", ".join(f"{k} long" for k in _FLAGGED))
    return out.withColumns({k: F.round(k, 6) for k in _FENCED})


@query
def dtypes_metrics(spark, sf_dir):
    from .plans.quality import dtypes

    units = F.when(F.col("event_id") % 40 == 0, F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string"))).otherwise(F.regexp_extract("props", "[0-9]+", 0))
    found = dtypes(Table(read(spark, sf_dir, "events").select("event_type", units.alias("units")), "events"), _settings()).metrics["columns"]
    rows = [(m["name"], m["kind"], m["non_null"], m["numeric_share"], m["non_numeric"], m["leading_zero"], ",".join(f"{t['token']}:{t['count']}" for t in m["tokens"])) for m in found]
    return _long(spark, rows, "name string, kind string, non_null long, numeric_share double, non_numeric long, leading_zero long, tokens string").withColumn("numeric_share", F.round("numeric_share", 8))


@query
def impossible_metrics(spark, sf_dir):
    from .plans.quality import impossible

    df = read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 40).alias("age"), "l_shipdate")
    found = {m["rule"]: m for m in impossible(Table(df, "lineitem"), _settings()).metrics["columns"]}
    age, date = found["age"], found["date"]
    rows = [(age["name"], age["checked"], age["negative"] + age["above_maximum"], age["rate"], f"{age['max']:g}"), (date["name"], date["checked"], date["invalid"] + date["future"], date["rate"], date["latest"])]
    return _long(spark, rows, "name string, checked long, impossible long, rate double, greatest string").withColumn("rate", F.round("rate", 8))


@query
def pii_metrics(spark, sf_dir):
    from .plans.privacy import pii

    k = F.col("c_custkey")
    text = F.when(k % 10 < 8, F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.org"))).otherwise("none")
    df = read(spark, sf_dir, "customer").select(text.alias("contact"), F.format_string("%03d-%02d-%04d", k % 899 + 1, k % 99 + 1, k % 5000).alias("tax_ref"), F.concat(F.lit("x"), k.cast("string")).alias("email"), "c_mktsegment", k.alias("phone_number"))
    rows = [(m["name"], m["kind"], m["evidence"], m["format"] or "", m["matched"] or 0, m["checked"] or 0) for m in pii(Table(df, "customer"), _settings()).metrics["columns"]]
    return _long(spark, rows, "name string, kind string, evidence string, format string, matched long, checked long")


@query
def univariate_metrics(spark, sf_dir):
    from .plans.eda import univariate

    df = read(spark, sf_dir, "orders").select("o_totalprice", "o_orderpriority")
    rows = []
    for m in univariate(Table(df, "orders"), _settings()).metrics["columns"]:
        s = m["statistics"]
        if m["semantic_type"] == "numeric":
            rows += [(m["name"], k, None, float(s[k])) for k in ("count", "missing", "mean", "std", "min", "q1", "median", "q3", "max", "skew")]
        else:
            rows += [(m["name"], "label", t["label"], float(t["count"])) for t in s["top"]] + [(m["name"], "distinct", None, float(s["distinct"]))]
    return _long(spark, rows, "name string, statistic string, label string, value double").withColumn("value", F.round("value", 6))


def _for_target(spark, sf_dir) -> Table:
    df = read(spark, sf_dir, "orders").select("o_orderstatus", F.concat(F.lit("s-"), F.col("o_orderstatus")).alias("status_copy"), "o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return Table(df, "orders", target="o_orderstatus")


@query
def relationships_metrics(spark, sf_dir):
    from .plans.eda import relationships

    target = relationships(_for_target(spark, sf_dir), _settings()).metrics["target"]
    rows = [(m["name"], m["kind"], m["effect"]) for m in target["associations"]]
    rows += [(m["label"], "share", m["share"]) for m in target["class_balance"]["classes"]]
    return _long(spark, rows, "name string, kind string, effect double").withColumn("effect", F.round("effect", 6))


@query
def leakage_metrics(spark, sf_dir):
    from .plans.diagnostics import leakage

    m = leakage(_for_target(spark, sf_dir), _settings()).metrics
    rows = [(c, e, c in m["near_perfect"]["flagged"], c in m["duplicated"]["flagged"]) for c, e in m["near_perfect"]["effects"].items()]
    return _long(spark, rows, "name string, effect double, near_perfect boolean, copied boolean").withColumn("effect", F.round("effect", 6))


@query
def splits_metrics(spark, sf_dir):
    from .plans.diagnostics import split_strategy

    m = split_strategy(_for_target(spark, sf_dir), _settings()).metrics
    rows = [("expected_test_rows", m["small_n"]["expected_test_rows"], m["small_n"]["flagged"]), ("minority_share", m["stratification"]["minority_share"], m["stratification"]["flagged"])]
    rows += [(c, e, c in m["temporal"]["flagged"]) for c, e in m["temporal"]["effects"].items()]
    return _long(spark, rows, "name string, value double, flagged boolean").withColumn("value", F.round("value", 6))


@query
def embedded_phones(spark, sf_dir):
    n = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    text = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("call +49 30 1234 "), n, F.lit(" now"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("write to a.b@c.org, "), n)).otherwise(F.concat(F.lit("order "), n))
    return read(spark, sf_dir, "customer").select(text.alias("t")).agg(F.count("t").alias("checked"), F.count_if(P.has_contact(F.col("t"))).alias("contact"))


@query
def findings_ranked(spark, sf_dir):
    from .core.results import Settings
    from .plans.runs import findings_frame, quality_checks

    return findings_frame(spark, quality_checks(Table(with_gaps(read(spark, sf_dir, "lineitem")), "lineitem", target="l_returnflag"), Settings()).findings)


@query
def report_findings(spark, sf_dir):
    from .core.results import Settings
    from .plans.runs import build_report, findings_frame

    return findings_frame(spark, build_report(Table(read(spark, sf_dir, "orders"), "orders", target="o_orderstatus"), Settings(), write=False).findings)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
