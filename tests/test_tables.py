import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeprobe import Settings, Table
from lakeprobe.core.errors import SettingsError, StrictJsonError, TableError
from lakeprobe.core.results import Finding, Result, Severity, by_severity, strict_dumps
from lakeprobe.core.table import guarded, sample_positions, with_positions
from lakeprobe.functions import names as N
from lakeprobe.functions import predicates as P
from lakeprobe.functions import tails
from lakeprobe.operators import aggregates as A
from lakeprobe.operators import association as S
from lakeprobe.plans import diagnostics as D
from lakeprobe.plans import quality as Q
from lakeprobe.plans.eda import bin_edges, explore
from lakeprobe.plans.privacy import pii
from lakeprobe.plans.runs import build_report, diagnose, quality_checks
from lakeprobe.plans.schema import profile
from lakeprobe.synthetic import Recipe, make_table


def keys(result):
    return {(f.category, f.affected_columns) for f in result.findings}


def test_settings_are_strict():
    for bad in ({"random_seed": -1}, {"row_threshold": True}, {"column_threshold": 0}, {"output_dir": " "}):
        with pytest.raises(SettingsError):
            Settings(**bad)


def test_results_round_trip():
    f = Finding(category="c", severity=Severity.LOW, confidence=0.5, title="t", evidence="e", interpretation="i", limitations="l", affected_columns=("a",))
    r = Result(findings=[f], metrics={"x": 1.5}, settings=Settings())
    assert Result.from_json(r.to_json()) == r
    with pytest.raises(StrictJsonError):
        Result(metrics={"x": float("nan")})
    with pytest.raises(StrictJsonError):
        strict_dumps({"x": (1, 2)})
    g = Finding(**{**f.__dict__, "severity": Severity.HIGH})
    assert by_severity([f, g, f])[0] is g


def test_tail_probabilities():
    assert math.isclose(tails.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-10)
    assert math.isclose(tails.f_tail(54, 1, 4), 1 - math.sqrt(54 / 58) * (1 + 2 / 58), rel_tol=1e-9)
    assert math.isclose(tails.t_tail_both(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(tails.t_tail_both(60, 500), 1.3e-230, rel_tol=0.2)
    assert tails.pearson_p(1.0, 10) == 0 and math.isclose(tails.pearson_p(0.5, 20), 0.0247696, rel_tol=1e-4)


def test_sample_is_pinned():
    assert sample_positions(1000, 10, 42).tolist() == [136, 411, 513, 521, 626, 660, 678, 737, 740, 859]


def test_positions_have_no_gaps(spark):
    df = with_positions(spark.range(1000, numPartitions=7))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(i, i) for i in range(1000)]


def test_positions_follow_files_and_not_their_sizes(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    sizes = [3, 500, 40, 1, 2000]  # Spark deals out large files first
    ends = np.cumsum(sizes)
    for k, (n, end) in enumerate(zip(sizes, ends, strict=True)):
        table = pa.table({"v": np.arange(end - n, end), "text": [f"{(end - n + i) % 1200} of some length" for i in range(n)]})
        pq.write_table(table, tmp_path / f"part {k}.parquet", row_group_size=300)
    files = spark.read.parquet(str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # files are cut as well
    try:
        for df in (files, files.where("v % 3 = 0")):
            rows = with_positions(df).orderBy("v").collect()
            assert [r["__pos"] for r in rows] == list(range(df.count()))
        assert [r[0] for r in A.repeat_positions(with_positions(files), ["text"], "__pos").collect()] == [1200, 1201, 1202, 1203, 1204]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    joined = with_positions(files.join(files.select("v"), "v").groupBy("v").count())
    assert sorted(r["__pos"] for r in joined.collect()) == list(range(int(ends[-1])))


def test_guard_samples_exactly(spark):
    t = Table(spark.range(1000, numPartitions=3).toDF("v"))
    g = guarded(t, Settings(row_threshold=10))
    assert g.sampled and [r[0] for r in g.rows.collect()] == sample_positions(1000, 10, 42).tolist()
    assert not guarded(Table(spark.range(5).toDF("v")), Settings(column_threshold=1)).sampled


VECTORS = {
    P.is_email: (["a@b.de", "Müller@exämple.com", "x.y+z@a-b.co.uk"], ["a@b", "a b@c.de", "@b.de", "a@b.d", "x"]),
    P.is_phone: (["+49 30 1234567", "555-123-4567", "(030) 123 45 67"], ["1234567890", "10.0.12.123", "123-45-6789", "2024-01-05", "12-34"]),
    P.is_us_ssn: (["123-45-6789"], ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "123-45-67890"]),
    P.is_uk_nino: (["AB 12 34 56 C", "AB123456C"], ["GB123456C", "AO123456C", "AB123456E"]),
    P.is_iban: (["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], ["DE88370400440532013000", "DE89", "XX00"]),
    P.is_person_name: (["Anna", "Anna-Marie O’Neil", "Ludwig van Beethoven", "J. Doe"], ["anna", "Anna 3", "A B C D E", "Anna  B"]),
    P.is_number_text: ([" 1 ", "-1.5e3", "1,234,567.8", ".5"], ["1,23", "x", "", "1.234,5"]),
    P.is_iso_moment: (["2024-02-29", "2024-01-01T23:59:59Z", "2024-01-01 10:00+05:30", "9999-12-31"], ["2023-02-29", "2024-01-01T24:00", "2024-1-1", "2024-01-01\n"]),
    P.has_contact: (["write to a@b.de now", "call 555-123-4567 today"], ["nothing here", "v1.555-123-4567"]),
}


@pytest.mark.parametrize("test", list(VECTORS), ids=lambda f: f.__name__)
def test_predicates(spark, test):
    good, bad = VECTORS[test]
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    wrong = df.where(~test(F.col("v")).eqNullSafe(F.col("want"))).collect()
    assert not wrong


def test_names():
    assert N.is_identifier_name("customer_id") and N.is_identifier_name("orderId") and not N.is_identifier_name("o_orderkey") and not N.is_identifier_name("paid")
    assert N.is_email_name("user_email") and not N.is_email_name("email_opt_in".replace("opt_in", "optin"))
    assert N.is_phone_name("mobilePhone") and not N.is_phone_name("phone_model")
    assert N.is_national_id_name("tax_id") and N.person_name_kind("first_name") == "person" and N.person_name_kind("name") == "bare" and N.person_name_kind("product_name") is None


def test_profile_types(spark):
    n = 60
    rows = [(i, i % 7, f"u{i}", f"{'abc'[i % 3]}", f"word {i} of text", float(i) + 0.5, dt.datetime(2024, 1, 1), f"2024-01-{i % 28 + 1:02d}", i % 2 == 0, None, [i]) for i in range(n)]
    schema = "row_number long, parent_id long, order_ref string, city string, comment string, score double, at timestamp_ntz, day string, active boolean, empty string, nested array<int>"
    got = {m["name"]: m["semantic_type"] for m in profile(Table(spark.createDataFrame(rows, schema))).metrics["columns"]}
    assert got == {"row_number": "identifier", "parent_id": "numeric", "order_ref": "identifier", "city": "categorical", "comment": "text", "score": "numeric", "at": "datetime", "day": "datetime", "active": "boolean", "empty": "unknown", "nested": "unknown"}


def test_nan_is_missing_and_labels_may_repeat(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "a double, b int").toDF("a", "a")
    m = Q.missingness(Table(df), Settings()).metrics
    assert [c["n_missing"] for c in m["columns"]] == [2, 0]


def test_empty_table_is_refused(spark):
    t = Table(spark.createDataFrame([], "a int"))
    for f in (lambda: quality_checks(t, Settings()), lambda: explore(t, Settings(), False), lambda: D.split_strategy(t, Settings()), lambda: D.readiness(t, Settings())):
        with pytest.raises(TableError):
            f()


def test_outliers_by_hand(spark):
    df = spark.createDataFrame([(float(v),) for v in [-1000, *range(1, 101), 1000]], "planted double").coalesce(1)
    e = Q.outliers(Table(df), Settings()).metrics["columns"][0]
    assert (e["q1"], e["q3"], e["mild_low"], e["mild_high"], e["extreme_low"], e["extreme_high"]) == (25.25, 75.75, -50.5, 151.5, -126.25, 227.25)
    assert e["first_positions"] == [0, 101] and e["extreme"] == 2


def test_quantiles_by_brackets_equal_the_builtin(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values = [float(x) for x in rng.normal(size=3000).round(3)] + [5.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = A.exact_quantiles(df, ["x"], [0.25, 0.5, 0.9])
    monkeypatch.setattr(A, "SMALL_ROWS", 10)
    monkeypatch.setattr(A, "BRACKET_PARTS", 16)
    got = A.exact_quantiles(df, ["x"], [0.25, 0.5, 0.9])
    assert np.allclose(got["x"], want["x"]) and np.allclose(want["x"], np.quantile(values, [0.25, 0.5, 0.9]))


def test_quantiles_between_heavy_values(spark, monkeypatch):
    """Two values of many rows each, others between them, and numbers of very different size."""
    monkeypatch.setattr(A, "BRACKET_PARTS", 16)
    heavy = [0.0] * 2000 + [k / 300 for k in range(1, 300)] + [1.0] * 2000
    wide = [10.0**k for k in range(-300, 300, 7)] + [-1e308, 1e308]
    for values in (heavy, wide, [4.0], [2.0] * 9):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        probabilities = [0.0, 0.25, 0.5, 0.75, 1.0]
        assert A._by_brackets(df, probabilities) == pytest.approx(np.quantile(values, probabilities).tolist(), rel=1e-12)
    assert A._by_brackets(spark.createDataFrame([], "x double"), [0.5]) is None



def test_effects_by_hand(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "a"), (7.0, "b"), (8.0, "b"), (9.0, "b")], "y double, g string")
    e = S.eta(df, F.col("y"), F.col("g"))
    assert math.isclose(e.effect**2, 54 / 58) and math.isclose(e.p, tails.f_tail(54, 1, 4))
    cells = [("a", "x")] * 30 + [("a", "y")] * 10 + [("b", "x")] * 10 + [("b", "y")] * 50
    v = S.cramers_v(spark.createDataFrame(cells, "a string, b string"), F.col("a"), F.col("b"))
    assert math.isclose(v.effect, 1400 / 2400)
    assert math.isclose(S.phi(100, 40, 40, 30), 1400 / 2400) and S.phi(100, 2, 40, 1) is None
    assert S.cramers_v(spark.createDataFrame(cells[:3], "a string, b string"), F.col("a"), F.col("b")) is None


def test_wide_correlations_equal_the_narrow(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 14))
    x[:, 1] = x[:, 0] * 2 + x[:, 1] * 0.1
    rows = [[None if rng.random() < 0.1 else float(v) for v in r] for r in x]
    rows = [[*r[:13], 3.0] for r in rows]
    names = [f"c{i}" for i in range(14)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    wide = S.correlation_matrix(df, names)
    narrow = {(a, b): (n, r) for part in (names[:5], names[9:]) for a, b, n, r in S.correlation_matrix(df, part)}
    for a, b, n, r in wide:
        if (a, b) in narrow:
            assert (r is None) == (narrow[a, b][1] is None) == ("c13" in (a, b)), (a, b, r, narrow[a, b])
            assert narrow[a, b][0] == n and (r is None and narrow[a, b][1] is None or math.isclose(r, narrow[a, b][1], abs_tol=1e-9))


def test_missing_values_that_depend(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        x, region = rng.gauss(0, 1), rng.choice("nsew")
        both = rng.random() < 0.1
        rows.append((x, region, None if x > 0.8 and rng.random() < 0.9 else rng.random(), None if region == "n" else 1.0 + rng.random(), None if both else 1.0, None if both else 2.0, None if rng.random() < 0.3 else 5.0 * rng.random()))
    t = Table(spark.createDataFrame(rows, "x double, region string, depends double, by_region double, pair_a double, pair_b double, mcar double"))
    m = Q.missingness(t, Settings()).metrics
    label = {c["name"]: c["dependence"] for c in m["columns"]}
    assert label["depends"] == label["by_region"] == "detected" and label["mcar"] == "not_detected" and label["x"] == "no_missing"
    assert m["pairs"]["listed"][0]["phi"] == pytest.approx(1.0)
    skipped = Q.missingness(t, Settings(column_threshold=2)).metrics
    assert not skipped["pairwise"]["performed"] and skipped["columns"][2]["dependence_reason"] == "pairwise_skipped"


def test_duplicates(spark):
    base = [(i * 3 + i % 2, i, f"v{i}") for i in range(100)]
    rows = base + base[:5] + [(1000 + i, *base[i][1:]) for i in range(4)] + [(base[10][0], 999, "other")]
    t = Table(spark.createDataFrame(rows, "row_id long, b long, c string").coalesce(1))
    m = Q.duplicates(t, Settings()).metrics
    assert m["rows"]["duplicate_rows"] == 5 and m["rows"]["first_positions"] == [100, 101, 102, 103, 104]
    assert m["identifiers"][0] | {"rate": 0} == {"name": "row_id", "repeated_values": 6, "extra_rows": 6, "exact": 5, "conflicting": 1, "rate": 0}


def test_constants(spark):
    rows = [("s", -0.0 if i % 2 else 0.0, i if i < 10 else 0, None, i, None if i % 3 else 1) for i in range(1000)]
    m = Q.constants(Table(spark.createDataFrame(rows, "a string, zero double, near long, nothing string, v long, same int")), Settings()).metrics
    assert {c["name"]: c["kind"] for c in m["columns"]} == {"a": "constant", "zero": "constant", "near": "near_constant", "nothing": "all_null", "v": "varying", "same": "constant"}


def test_quality_finds_exactly_what_was_planted(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        rows.append((170 + rng.gauss(0, 5) if i else 900.0, None if i % 3 == 0 else rng.random(), -3 if i < 2 else 30 + i % 40, "x" if i % 2 else "y", "?" if i < 4 else str(rng.randint(1, 9999)), "on", f"2024-0{i % 9 + 1}-11" if i else "2999-01-01", f"p{i}@mail.example"))
    rows += rows[:12]
    t = Table(spark.createDataFrame(rows, "height double, income double, age long, region string, units string, flag string, visit string, contact string"))
    got = keys(quality_checks(t, Settings(), dt.date(2025, 6, 1)))
    assert got == {
        ("missingness", ("income",)), ("missingness", ()), ("duplicates", ()), ("constants", ("flag",)), ("outliers", ("height",)), ("outliers", ("age",)), ("dtypes", ("units",)),
        ("impossible_values", ("age",)), ("impossible_values", ("visit",)), ("privacy", ("contact",)),
    }


def test_no_personal_value_is_shown(spark, tmp_path):
    rows = [(f"p{i}@mail.example", f"+49 30 55{i:05d}", f"Anna{'abcdefgh'[i % 8]} Meier", f"please write to p{i}@mail.example about the order soon", 491700000 + i) for i in range(60)]
    t = Table(spark.createDataFrame(rows, "email string, contact_number string, first_name string, comments string, phone long"), "t", target="email")
    found = {(d["name"], d["kind"], d["evidence"]) for d in pii(t, Settings()).metrics["columns"]}
    assert found == {("email", "email", "column"), ("contact_number", "phone", "column"), ("first_name", "name", "corroborated"), ("comments", "free_text", "embedded"), ("phone", "phone", "name")}
    text = build_report(t, Settings(output_dir=str(tmp_path))).to_json()
    assert "mail.example" not in text and "+49" not in text and "Meier" not in text


def test_personal_data_is_counted_over_all_rows(spark):
    t = Table(spark.range(500).select(F.when(F.col("id") % 10 < 8, F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@mail.example"))).otherwise("none").alias("contact")))
    told = pii(t, Settings(row_threshold=100))
    assert [(d["evidence"], d["matched"], d["checked"]) for d in told.metrics["columns"]] == [("column", 400, 500)]
    assert told.metrics["rows_examined"] == 500 and [f.category for f in told.findings] == ["privacy"]


def test_bins():
    assert len(bin_edges(1000, 0, 100, 25, 75)) - 1 == 11 and bin_edges(5, 3, 3, 3, 3) == [2.5, 3.5] and len(bin_edges(10**6, 0, 1e9, 1, 2)) - 1 == 50


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_leaks_time_and_groups_are_found(spark, task):
    t = make_table(spark, Recipe(n_rows=400), leaks=("future", "duplicate"), temporal=True, groups=True, effects={0: 0.5}, task=task).table
    leaks, splits = D.leakage(t, Settings()).metrics, D.split_strategy(t, Settings()).metrics
    assert leaks["duplicated"]["flagged"] == ["leak_duplicate"]
    assert task == "classification" or leaks["near_perfect"]["flagged"] == ["leak_future"]
    assert splits["temporal"]["flagged"] == ["event_time"]
    ready = D.readiness(t, Settings()).metrics
    assert {e["source"] for e in ready["blocking"]} == {"splits", "leakage"}


def test_silence_without_structure(spark):
    t = make_table(spark, Recipe(n_rows=400, seed=5)).table
    assert D.leakage(t, Settings()).metrics["near_perfect"]["flagged"] == [] and D.readiness(t, Settings()).findings[0].title == "No obstacle to modelling was found"


def test_planted_correlation_is_exact(spark):
    t = make_table(spark, Recipe(n_rows=100), effects={1: -0.4}).table
    r = explore(t, Settings(), write=False).metrics["relationships"]["target"]["associations"]
    assert r[0]["name"] == "feature_1" and math.isclose(r[0]["effect"], -0.4, abs_tol=1e-9)


def test_imbalance_is_one_recommendation(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.random(), rng.random(), "rare" if i < 6 else "common") for i in range(200)]
    t = Table(spark.createDataFrame(rows, "a double, b double, target string"), "t", target="target")
    told = diagnose(t, Settings(), write=False)
    merged = [r for r in told.metrics["recommendations"] if r["columns"] == ["target"]]
    assert len(merged) == 1 and {f["category"] for f in merged[0]["findings"]} == {"eda", "split_strategy"}
    report = build_report(t, Settings(output_dir=str(tmp_path)))
    assert sum(f.affected_columns == ("target",) and f.category in ("eda", "recommendation") for f in report.findings) == 1
    again = build_report(Table(t.df.toDF("a", "b", "target"), "t", target="target"), Settings(output_dir=str(tmp_path)))
    assert json.loads(report.to_json()) == json.loads(again.to_json())


def test_text_of_recommendations():
    assert D.together(["One.", "One. Two.", None, "Three", "One"]) == "One. Two.; Three"
