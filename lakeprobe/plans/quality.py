"""Quality analyzers: missing values, duplicates, constants, outliers, types, impossible values.

Each asks Spark for small aggregates and grades them on the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..core.results import Finding, Result, Settings, Severity, count_of, listed, number
from ..core.table import POSITION, Table, guarded
from ..functions import predicates as P
from ..functions.names import words_of
from ..functions.tails import chi2_tail
from ..operators import aggregates as A
from ..operators import association as S
from .schema import facts, profile, semantic_types
from .wording import finding

# Grades and cut-offs of the analyzers.
MISSING_GRADES = ((0.8, Severity.CRITICAL), (0.4, Severity.HIGH), (0.2, Severity.MEDIUM), (0.05, Severity.LOW))
DUPLICATE_GRADES = ((0.5, Severity.CRITICAL), (0.1, Severity.HIGH), (0.01, Severity.MEDIUM), (0.0, Severity.LOW))
STRONG_PHI, VERY_STRONG_PHI, ALPHA, LEAST_D, LEAST_V, SURE_P, LISTED_PAIRS, LISTED_PREDICTORS = 0.5, 0.8, 0.05, 0.5, 0.3, 0.001, 200, 5
CODE_SHARE = 0.95
NEAR_CONSTANT = 0.99
LEAST_VALUES, LEAST_DISTINCT, MILD, FAR, Z = 30, 10, 1.5, 3.0, 3.0
POSITIONS_KEPT = 10
TEXT_ROWS, TEXT_SHARE, TOKEN_LENGTH, TOKENS_LISTED = 20, 0.95, 20, 5
AGE_WORDS, AGE_MOST = {"age", "ages"}, 120
QUANTITY_WORDS = {"count", "counts", "depth", "distance", "duration", "height", "length", "population", "weight", "width"}
LATER_WORDS = {"deadline", "delivery", "due", "end", "eta", "expected", "expiration", "expire", "expires", "expiry", "forecast", "next", "planned", "renew", "renewal", "scheduled", "until"}
MANY_IMPOSSIBLE = 0.05


def graded(share: float, grades) -> Severity | None:
    return next((s for least, s in grades if share >= least), None)


# --- missing values


def _dependence(rows, partial, numeric, categorical) -> tuple[int, dict[str, dict]]:
    """Tests run, and for each partly missing column: comparisons, reasons why not, and the predictors found."""
    flags = {c.id: F.col(c.id).isNull() for c in partial}
    records: list[tuple[str, str, S.Effect]] = []
    out = {c.id: {"tested": 0, "skipped": {}, "found": []} for c in partial}

    def take(j: str, name: str, reason: str | None, effect) -> None:
        if effect is None:
            out[j]["skipped"][reason] = out[j]["skipped"].get(reason, 0) + 1
        else:
            records.append((j, name, effect))
            out[j]["tested"] += 1

    names = {c.id: c.name for c in [*numeric, *categorical]}
    if numeric:
        for r in S.welch_table(rows, flags, {c.id: P.finite(F.col(c.id)) for c in numeric}).collect():
            if r["indicator"] != r["value"]:
                take(r["indicator"], names[r["value"]], *S.welch(r))
    for c in categorical:
        cells = S.flags_by_category(rows, flags, F.col(c.id)).limit(S.MOST_CATEGORIES + 1).collect()
        for j in flags:
            if j != c.id:
                take(j, c.name, *S.chi2_of_flag([(r["n"], r[f"m_{j}"]) for r in cells]))
    for j, name, e in records:
        p = min(1.0, e.p * len(records))
        if p < ALPHA and abs(e.effect) >= (LEAST_D if e.kind == "numeric" else LEAST_V):
            out[j]["found"].append({"name": name, "kind": e.kind, "effect": e.effect, "p_adjusted": p})
    for o in out.values():
        o["found"].sort(key=lambda f: (f["p_adjusted"], -abs(f["effect"])))
    return len(records), out


def _phi_pairs(rows, partial) -> dict:
    n, ones, both = S.flag_pairs(rows, {c.id: F.col(c.id).isNull() for c in partial})
    name = {c.id: c.name for c in partial}
    values = {k: S.phi(n, ones[k[0]], ones[k[1]], m) for k, m in both.items()}
    tested = sum(v is not None for v in values.values())
    strong = []
    for (a, b), v in values.items():
        if v is not None and abs(v) >= STRONG_PHI:
            p = min(1.0, chi2_tail(n * v * v, 1) * tested)
            if p < ALPHA:
                strong.append({"a": name[a], "b": name[b], "phi": v, "n_both": both[a, b], "p_adjusted": p})
    strong.sort(key=lambda x: -abs(x["phi"]))
    return {"tested": tested, "skipped_small_counts": len(values) - tested, "above_threshold": len(strong), "listed": strong[:LISTED_PAIRS]}


def missingness(table: Table, settings: Settings) -> Result:
    n = table.need_rows("missing values")
    guard, known, kinds = guarded(table, settings), facts(table), semantic_types(table)
    counts = {c.id: n - known[c.id]["n"] for c in table.columns}
    overall = A.null_overview(table.df).first()
    pairs = {"tested": 0, "skipped_small_counts": 0, "above_threshold": 0, "listed": []}
    tests, found, here = 0, {}, {}
    if guard.pairwise:
        row = guard.rows.agg(*(F.count_if(F.col(c.id).isNull()).alias(c.id) for c in table.columns)).first()
        here = row.asDict()
        partial = [c for c in table.columns if 0 < here[c.id] < guard.n]
        if partial:
            numeric = [c for c in table.columns if kinds[c.id] == "numeric"]
            categorical = [c for c in table.columns if kinds[c.id] in ("categorical", "boolean")]
            tests, found = _dependence(guard.rows, partial, numeric, categorical)
            if len(partial) > 1:
                pairs = _phi_pairs(guard.rows, partial)

    def label(c) -> tuple[str, str | None, int]:
        if not counts[c.id]:
            return "no_missing", None, 0
        if not guard.pairwise:
            return "not_tested", "pairwise_skipped", 0
        if c.id not in found:
            return "not_tested", "all_missing" if here[c.id] else "none_in_sample", 0
        f = found[c.id]
        if f["tested"]:
            return "detected" if f["found"] else "not_detected", None, f["tested"]
        order = ("small_group", "small_expected", "no_variation", "too_many_categories")
        reason = min(f["skipped"], key=lambda r: (-f["skipped"][r], order.index(r))) if f["skipped"] else "no_predictors"
        return "not_tested", reason, 0

    labels = {c.id: label(c) for c in table.columns}
    out: list[Finding] = []
    for c in table.columns:
        rate = counts[c.id] / n
        severity = graded(rate, MISSING_GRADES)
        text = f"'{c.name}' lacks {counts[c.id]:,} of {n:,} values ({rate:.1%})."
        if c.name == table.target and counts[c.id]:
            severity = max(severity or Severity.HIGH, Severity.HIGH, key=lambda s: s.rank)
            out.append(finding("missing_target", severity, 1.0, text, [c.name]))
        elif severity:
            out.append(finding("missing_column", severity, 1.0, text, [c.name]))
    row_rate = overall["rows_with_missing"] / n
    if severity := graded(row_rate, MISSING_GRADES):
        out.append(finding("missing_rows", severity, 1.0, f"{overall['rows_with_missing']:,} of {n:,} rows ({row_rate:.1%}) lack a value."))
    if pairs["listed"]:
        strongest = abs(pairs["listed"][0]["phi"])
        names = dict.fromkeys(x for p in pairs["listed"] for x in (p["a"], p["b"]))
        out.append(finding("missing_pairs", *((Severity.MEDIUM, 0.9) if strongest >= VERY_STRONG_PHI else (Severity.LOW, 0.7)), f"{count_of(pairs['above_threshold'], 'pair')}; the strongest has phi {pairs['listed'][0]['phi']:.2f}.", names))
    for c in table.columns:
        if labels[c.id][0] == "detected":
            f = found[c.id]["found"]
            out.append(finding("missing_depends", Severity.MEDIUM, 0.8 if f[0]["p_adjusted"] < SURE_P else 0.6, f"Absence of '{c.name}' goes with {listed(x['name'] for x in f)}.", [c.name]))
    untested = [c for c in table.columns if labels[c.id][0] == "not_tested" and counts[c.id] / n >= MISSING_GRADES[-1][0] and labels[c.id][1] != "pairwise_skipped"]
    if untested:
        out.append(finding("missing_untested", Severity.INFO, 1.0, "; ".join(f"'{c.name}': {labels[c.id][1].replace('_', ' ')}" for c in untested[:5]), [c.name for c in untested]))
    tokens = getattr(table.provenance, "converted_tokens", None) or {}
    for c in table.of_kind("string"):
        if tokens.get(c.name, {}).get("NA"):
            share = table.df.agg(F.avg(P.whole(F.col(c.id), P.COUNTRY_CODE).cast("double"))).first()[0]
            if share is not None and share >= CODE_SHARE:
                out.append(finding("missing_token", Severity.MEDIUM, 0.6, f"'{c.name}' had NA {count_of(tokens[c.name]['NA'], 'time')} among short codes.", [c.name]))
    out += [g for g in guard.findings if guard.pairwise or "sample" not in g.title]
    metrics = {
        "n_rows": n,
        "n_columns": len(table.columns),
        "overall": {"cells": overall["cells"], "missing_cells": overall["missing_cells"], "cell_rate": overall["missing_cells"] / overall["cells"], "rows_with_missing": overall["rows_with_missing"], "row_rate": row_rate},
        "columns": [{"name": c.name, "n_missing": counts[c.id], "rate": counts[c.id] / n, "dependence": labels[c.id][0], "dependence_reason": labels[c.id][1], "comparisons_run": labels[c.id][2], "predictors": found.get(c.id, {"found": []})["found"][:LISTED_PREDICTORS]} for c in table.columns],
        "pairwise": {"performed": guard.pairwise, "rows_used": guard.n if guard.pairwise else None, "sampled": guard.pairwise and guard.sampled},
        "pairs": pairs,
        "dependence": {"tests_run": tests},
    }
    return Result(findings=out, metrics=metrics, settings=settings)


# --- duplicates


def _row_metrics(table: Table, ids: list[str], n: int) -> dict:
    row = A.duplicate_summary(table.df, ids).first()
    first = [r[0] for r in A.repeat_positions(table.positioned, ids, POSITION).collect()] if row["duplicate_rows"] else []
    return {"duplicate_rows": row["duplicate_rows"], "duplicate_groups": row["duplicate_groups"], "largest_group": row["largest_group"] if row["duplicate_rows"] else 0, "rate": row["duplicate_rows"] / n, "first_positions": first}


def duplicates(table: Table, settings: Settings) -> Result:
    n = table.need_rows("duplicates")
    shapes = {m["name"]: m for m in profile(table).metrics["columns"]}
    kinds = semantic_types(table)
    plain = [c for c in table.columns if c.kind not in ("nested", "variant")]
    left_out = [c.name for c in table.columns if c not in plain]
    out: list[Finding] = []
    rows, hidden = None, None
    identifiers = [c for c in plain if kinds[c.id] == "identifier"]
    if plain:
        rows = _row_metrics(table, [c.id for c in plain], n)
        rest = [c for c in plain if c not in identifiers]
        if identifiers and rest:
            hidden = _row_metrics(table, [c.id for c in rest], n)
        if rows["duplicate_rows"]:
            out.append(finding("duplicate_rows", graded(rows["rate"], DUPLICATE_GRADES), 1.0, f"{rows['duplicate_rows']:,} of {n:,} rows repeat an earlier one, in {count_of(rows['duplicate_groups'], 'group')}; the largest has {rows['largest_group']:,}."))
        if hidden and hidden["duplicate_rows"] > rows["duplicate_rows"]:
            sure = min(shapes[c.name]["identifier_confidence"] for c in identifiers)
            out.append(finding("duplicate_hidden", graded(hidden["rate"], DUPLICATE_GRADES), sure, f"Without {listed(c.name for c in identifiers)}, {hidden['duplicate_rows']:,} rows repeat an earlier one."))
    repeated = []
    for c in plain:
        shape = shapes[c.name]
        if not shape["identifier_named"]:
            continue
        r = A.repeated_identifiers(table.df, c.id, [x.id for x in plain]).first()
        if not r["repeated"]:
            continue
        share = r["rows"] / n
        repeated.append({"name": c.name, "repeated_values": r["repeated"], "extra_rows": r["rows"], "exact": r["exact"], "conflicting": r["conflicting"], "rate": share})
        severity = Severity.MEDIUM if share < 0.01 else Severity.CRITICAL if r["conflicting"] else Severity.HIGH
        out.append(finding("duplicate_ids", severity, shape["identifier_confidence"], f"{count_of(r['repeated'], 'value')} of '{c.name}' occur again; the rows of {r['conflicting']:,} differ.", [c.name]))
    if left_out:
        out.append(finding("duplicate_left_out", Severity.INFO, 1.0, f"Left out: {listed(left_out)}.", left_out))
    metrics = {"n_rows": n, "rows": rows, "rows_ignoring_identifiers": hidden, "identifiers": repeated, "identifiers_not_checked": [c.name for c in identifiers if not shapes[c.name]["identifier_named"]], "left_out": left_out}
    return Result(findings=out, metrics=metrics, settings=settings)


# --- constants


def constants(table: Table, settings: Settings) -> Result:
    n = table.need_rows("constants")
    known = facts(table)
    rows = []
    for c in table.columns:
        f = known[c.id]
        top = None if f["top"] is None or not f["n"] else f["top"] / f["n"]
        kind = "all_null" if not f["n"] else "not_checked" if f["n_distinct"] is None else "constant" if f["n_distinct"] == 1 else "near_constant" if top >= NEAR_CONSTANT else "varying"
        rows.append({"name": c.name, "kind": kind, "non_null": f["n"], "distinct": f["n_distinct"] if f["n"] else 0, "top_share": top, "missing": n - f["n"], "is_target": c.name == table.target})
    named = lambda kind, target=False: [r["name"] for r in rows if r["kind"] == kind and r["is_target"] == target]
    out = []
    if named("constant", True):
        out.append(finding("constant_target", Severity.CRITICAL, 1.0, f"'{table.target}' has one value.", [table.target]))
    for kind, key, severity in (("constant", "constants", Severity.LOW), ("near_constant", "near_constants", Severity.INFO), ("not_checked", "constants_unchecked", Severity.INFO)):
        if names := named(kind):
            out.append(finding(key, severity, 1.0, f"{listed(names)}.", names))
    return Result(findings=out, metrics={"n_rows": n, "columns": rows}, settings=settings)


# --- outliers


def _outlier_counts(table: Table, columns, fences: dict) -> dict[str, dict]:
    aggs = []
    for c in columns:
        x, f = P.finite(F.col(c.id)), fences[c.id]
        mild = (x < f["mild_low"]) | (x > f["mild_high"])
        far = (x < f["extreme_low"]) | (x > f["extreme_high"])
        z = F.abs((x - f["mean"]) / f["std"]) > Z
        for k, v in (("iqr_flagged", mild), ("iqr_extreme", far), ("z_flagged", z), ("both_flagged", mild & z), ("flagged", mild | z), ("extreme", far & z)):
            aggs.append(F.count_if(v).alias(f"{c.id}_{k}"))
    row = table.df.agg(*aggs).first()
    return {c.id: {k: row[f"{c.id}_{k}"] for k in ("iqr_flagged", "iqr_extreme", "z_flagged", "both_flagged", "flagged", "extreme")} for c in columns}


def numeric_summary(table: Table) -> dict[str, dict]:
    """By column id: moments and quartiles of the finite values of every number column; kept."""

    def make():
        columns = table.of_kind("integer", "floating")
        if not columns:
            return {}
        row = table.df.agg(*(m for c in columns for m in A.moments(F.col(c.id), f"{c.id}_"))).first()
        quartiles = A.exact_quantiles(table.df, [c.id for c in columns], [0.25, 0.5, 0.75], table.n_rows)
        out = {}
        for c in columns:
            out[c.id] = {k: number(row[f"{c.id}_{k}"]) for k in ("n", "mean", "std", "min", "max", "skew")}
            out[c.id] |= dict(zip(("q1", "median", "q3"), quartiles[c.id] or (None,) * 3, strict=True))
        return out

    return table.remember("numeric_summary", make)


def _first_odd(table: Table, fences: dict) -> dict[str, list[int]]:
    """By column the first positions of flagged values, in one job; ranks are cut off before rows are moved."""
    if not fences:
        return {}
    odd = []
    for c, f in fences.items():
        x = P.finite(F.col(c.id))
        odd.append(F.when((x < f["mild_low"]) | (x > f["mild_high"]) | (F.abs((x - f["mean"]) / f["std"]) > Z), F.lit(c.id)))
    rows = table.positioned.select(POSITION, F.explode(F.array_compact(F.array(*odd))).alias("c"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(POSITION))).where(F.col("r") <= POSITIONS_KEPT)
    out: dict[str, list[int]] = {c.id: [] for c in fences}
    for c, position in sorted(map(tuple, ranked.select("c", POSITION).collect())):
        out[c].append(position)
    return out


def outliers(table: Table, settings: Settings) -> Result:
    n = table.need_rows("outliers")
    kinds, known, numbers = semantic_types(table), facts(table), numeric_summary(table)
    columns = [c for c in table.columns if kinds[c.id] == "numeric"]
    blank = ("min", "max", "q1", "q3", "iqr", "mild_low", "mild_high", "extreme_low", "extreme_high")
    entries, fences = {}, {}
    for c in columns:
        s = numbers[c.id]
        e = {"name": c.name, "status": "skipped", "reason": None, "n": s["n"], "n_infinite": known[c.id]["inf"]} | dict.fromkeys(blank)
        e |= dict.fromkeys(("iqr_flagged", "iqr_extreme", "z_flagged", "both_flagged", "flagged", "extreme"), 0) | {"rate": 0.0, "first_positions": []}
        entries[c.id] = e
        if s["n"] < LEAST_VALUES:
            e["reason"] = "too_few_values"
        elif known[c.id]["n_distinct"] - min(2, known[c.id]["inf"]) < LEAST_DISTINCT:
            e["reason"] = "too_few_distinct"
        elif s["q3"] == s["q1"]:
            e["reason"] = "zero_iqr"
        else:
            iqr = s["q3"] - s["q1"]
            e |= {"status": "assessed", "min": s["min"], "max": s["max"], "q1": s["q1"], "q3": s["q3"], "iqr": iqr}
            e |= {"mild_low": s["q1"] - MILD * iqr, "mild_high": s["q3"] + MILD * iqr, "extreme_low": s["q1"] - FAR * iqr, "extreme_high": s["q3"] + FAR * iqr}
            fences[c.id] = {**e, "mean": s["mean"], "std": s["std"]}
    assessed = [c for c in columns if c.id in fences]
    if assessed:
        counts = _outlier_counts(table, assessed, fences)
        for c, positions in _first_odd(table, {c: fences[c.id] for c in assessed if counts[c.id]["flagged"]}).items():
            entries[c]["first_positions"] = positions
        for c in assessed:
            e = entries[c.id]
            e |= counts[c.id]
            e["rate"] = e["flagged"] / e["n"]
    out = []
    extreme = [e for e in entries.values() if e["extreme"]]
    some = [e for e in entries.values() if e["flagged"] and not e["extreme"]]
    skipped = [e for e in entries.values() if e["reason"] in ("too_few_values", "zero_iqr")]
    infinite = [e for e in entries.values() if e["n_infinite"]]
    if extreme:
        out.append(finding("outliers_extreme", Severity.MEDIUM, 0.7, "; ".join(f"'{e['name']}': {e['extreme']:,} of {e['n']:,}" for e in extreme[:5]), [e["name"] for e in extreme]))
    if some:
        out.append(finding("outliers_some", Severity.LOW, 0.4, "; ".join(f"'{e['name']}': {e['flagged']:,} of {e['n']:,}" for e in some[:5]), [e["name"] for e in some]))
    if skipped:
        out.append(finding("outliers_skipped", Severity.INFO, 1.0, "; ".join(f"'{e['name']}': {e['reason'].replace('_', ' ')}" for e in skipped[:5]), [e["name"] for e in skipped]))
    if infinite:
        out.append(finding("outliers_infinite", Severity.INFO, 1.0, "; ".join(f"'{e['name']}': {e['n_infinite']:,}" for e in infinite[:5]), [e["name"] for e in infinite]))
    return Result(findings=out, metrics={"n_rows": n, "numeric_columns": len(columns), "assessed": len(assessed), "columns": list(entries.values())}, settings=settings)


# --- types


def _text_numbers(table: Table, skip: set[str]) -> list[dict]:
    columns = [c for c in table.of_kind("string") if c.name not in skip]
    if not columns:
        return []
    aggs = []
    for c in columns:
        v = F.col(c.id)
        ok = P.is_number_text(v)
        aggs += [F.count(v).alias(f"{c.id}_n"), F.count_if(ok).alias(f"{c.id}_ok"), F.count_if(ok & P.has_leading_zero(v)).alias(f"{c.id}_zero")]
    row = table.df.agg(*aggs).first()
    out = []
    for c in columns:
        n, ok, zero = (row[f"{c.id}_{k}"] for k in ("n", "ok", "zero"))
        if n < TEXT_ROWS or ok / n < TEXT_SHARE:
            continue
        tokens = []
        if ok < n:
            bare = table.df.where(~P.is_number_text(F.col(c.id))).select(P.stripped(F.col(c.id)).alias("t"))
            tokens = [{"token": r["value"], "count": r["n"]} for r in A.frequency(bare, "t").where(F.length("value") <= TOKEN_LENGTH).orderBy(F.desc("n"), "value").limit(TOKENS_LISTED).collect()]
        out.append({"name": c.name, "kind": "numeric_codes" if zero else "numbers_as_text", "non_null": n, "numeric_share": ok / n, "non_numeric": n - ok, "leading_zero": zero, "tokens": tokens, "tokens_not_listed": n - ok - sum(t["count"] for t in tokens)})
    return out


def _mixed(table: Table) -> list[dict]:
    # Names of the types of JSON values.
    names = {"BOOLEAN": "bool", "BIGINT": "int", "DOUBLE": "float", "STRING": "str"}
    out = []
    for c in table.of_kind("variant"):
        types: dict[str, int] = {}
        for r in table.df.where(F.col(c.id).isNotNull()).groupBy(F.schema_of_variant(c.id).alias("t")).count().collect():
            t = r["t"]
            name = names.get(t) or ("float" if t.startswith("DECIMAL") else "list" if t.startswith("ARRAY") else "dict" if t.startswith("OBJECT") else t.lower())
            types[name] = types.get(name, 0) + r["count"]
        types.pop("void", None)
        if len(types) > 1:
            out.append({"name": c.name, "kind": "mixed_types", "types": dict(sorted(types.items()))})
    return out


def dtypes(table: Table, settings: Settings) -> Result:
    n = table.need_rows("types of values")
    lost_before = getattr(table.provenance, "leading_zeros", None) or {}
    kept = set(getattr(table.provenance, "text_columns", None) or ())
    text, mixed = _text_numbers(table, kept), _mixed(table)
    numeric_now = {c.name for c in table.of_kind("integer", "floating")}
    lost = [{"name": k, "kind": "codes_lost", **v} for k, v in lost_before.items() if k in numeric_now]
    out = []
    numbers = [t for t in text if t["kind"] == "numbers_as_text"]
    codes = [t for t in text if t["kind"] == "numeric_codes"]
    if numbers:
        pure = all(not t["non_numeric"] for t in numbers)
        out.append(finding("text_numbers", Severity.MEDIUM, 0.9 if pure else 0.8, "; ".join(f"'{t['name']}': {t['numeric_share']:.1%} numeric" for t in numbers[:5]), [t["name"] for t in numbers]))
    if codes:
        out.append(finding("text_codes", Severity.INFO, 0.6, "; ".join(f"'{t['name']}': {t['leading_zero']:,} with leading zeros" for t in codes[:5]), [t["name"] for t in codes]))
    if lost:
        out.append(finding("lost_zeros", Severity.MEDIUM, 0.7, "; ".join(f"'{t['name']}': {t['values']:,} of {t['checked']:,} checked" for t in lost[:5]), [t["name"] for t in lost]))
    if mixed:
        out.append(finding("mixed_types", Severity.MEDIUM, 1.0, "; ".join(f"'{m['name']}': {', '.join(f'{v:,} {k}' for k, v in m['types'].items())}" for m in mixed[:5]), [m["name"] for m in mixed]))
    return Result(findings=out, metrics={"n_rows": n, "columns": [*text, *lost, *mixed]}, settings=settings)


# --- impossible values


def _reference_day(table: Table, as_of: dt.date | None) -> dt.date:
    if as_of is not None:
        return as_of
    loaded = getattr(table.provenance, "loaded_at", None)
    return dt.date.fromisoformat(str(loaded)[:10]) if loaded else dt.datetime.now(dt.timezone.utc).date()


def impossible(table: Table, settings: Settings, as_of: dt.date | None = None) -> Result:
    n = table.need_rows("impossible values")
    kinds, day = semantic_types(table), _reference_day(table, as_of)
    rules, aggs = [], []
    for c in table.columns:
        words, v = words_of(c.name), F.col(c.id)
        if kinds[c.id] == "numeric" and words & AGE_WORDS:
            rule = "age"
        elif kinds[c.id] == "numeric" and words & QUANTITY_WORDS:
            rule = "non_negative"
        elif c.kind in ("date", "moment", "string") and not words & LATER_WORDS:
            rule = "date"
        else:
            continue
        rules.append((c, rule))
        if rule == "date":
            d = P.day_of(v, c.kind)
            aggs += [F.count(v).alias(f"{c.id}_n"), F.count_if(d > F.lit(day)).alias(f"{c.id}_future"), F.date_format(F.max(d), "yyyy-MM-dd").alias(f"{c.id}_latest")]
            shape = P.looks_like_date(v) if c.kind == "string" else F.lit(True)
            aggs += [F.bool_and(shape).alias(f"{c.id}_shape"), F.count_if(v.isNotNull() & d.isNull()).alias(f"{c.id}_invalid")]
        else:
            x = P.finite(v)
            aggs += [F.count(x).alias(f"{c.id}_n"), F.count_if(x < 0).alias(f"{c.id}_negative"), F.count_if(x > AGE_MOST).alias(f"{c.id}_high"), F.min(x).alias(f"{c.id}_min"), F.max(x).alias(f"{c.id}_max")]
    row = table.df.agg(*aggs).first() if aggs else {}
    out, entries = [], []
    for c, rule in rules:
        get = lambda k, c=c: row[f"{c.id}_{k}"]
        checked = get("n")
        if not checked or rule == "date" and not get("shape"):
            continue
        many = lambda k: Severity.HIGH if k / checked >= MANY_IMPOSSIBLE else Severity.MEDIUM  # noqa: B023, E731
        share = lambda k: f"'{c.name}': {k:,} of {checked:,} values ({k / checked:.1%})."  # noqa: B023, E731
        if rule == "date":
            invalid, future = get("invalid"), get("future")
            entries.append({"name": c.name, "rule": "date", "checked": checked, "invalid": invalid, "future": future, "rate": (invalid + future) / checked, "latest": get("latest")})
            if invalid:
                out.append(finding("dates_invalid", many(invalid), 0.9, share(invalid), [c.name]))
            if future:
                out.append(finding("dates_future", many(future), 0.5, share(future) + f" The reference day is {day}.", [c.name]))
            continue
        negative = get("negative")
        entry = {"name": c.name, "rule": rule, "checked": checked, "negative": negative, "rate": negative / checked, "min": get("min"), "max": get("max")}
        if rule == "age":
            high = get("high")
            entry |= {"above_maximum": high, "rate": (negative + high) / checked}
            if negative:
                out.append(finding("age_negative", many(negative), 0.9, share(negative), [c.name]))
            if high:
                out.append(finding("age_high", Severity.LOW, 0.6, share(high), [c.name]))
        elif negative:
            out.append(finding("quantity_negative", many(negative), 0.7, share(negative), [c.name]))
        entries.append(entry)
    return Result(findings=out, metrics={"n_rows": n, "as_of": day.isoformat(), "columns": entries}, settings=settings)
