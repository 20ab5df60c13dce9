"""Exploration: distributions of columns, correlations, associations with the target."""

from __future__ import annotations

import math
import os

from pyspark.sql import functions as F

from ..core.results import Result, Settings, Severity, by_severity, count_of, listed, without_repeats
from ..core.table import ColumnInfo, Table, guarded
from ..functions import predicates as P
from ..operators import aggregates as A
from ..operators import association as S
from ..report import svg
from .privacy import pii
from .quality import numeric_summary
from .schema import facts, semantic_types
from .wording import finding

# Limits and thresholds of the exploration.
TOP, DISCRETE, FENCE, BINS_MOST, PLOTS_ON_PAGE, PAGES = 10, 15, 3.0, 50, 12, 4
ALPHA, LEAST_EFFECT, RARE_MEDIUM, RARE_LOW = 0.05, 0.1, 0.05, 0.1
TASKS = {"numeric": "regression", "categorical": "classification", "boolean": "classification"}


def wide_range(table: Table, columns: list[ColumnInfo]) -> dict[str, dict | None]:
    """Where to cut a picture that a few far values would squeeze: three quartile ranges beyond the quartiles, with the numbers outside."""
    s = numeric_summary(table)
    out: dict[str, dict | None] = {c.id: None for c in columns}
    ends = {}
    for c in columns:
        v = s[c.id]
        if v["n"] and v["q3"] > v["q1"]:
            spread = v["q3"] - v["q1"]
            ends[c.id] = (max(v["min"], v["q1"] - FENCE * spread), min(v["max"], v["q3"] + FENCE * spread))
    if ends:
        row = table.df.agg(*(x for k, (a, b) in ends.items() for x in (F.count_if(P.finite(F.col(k)) < a).alias(f"{k}_b"), F.count_if(P.finite(F.col(k)) > b).alias(f"{k}_a")))).first()
        for k, (a, b) in ends.items():
            if row[f"{k}_b"] or row[f"{k}_a"]:
                out[k] = {"low": a, "high": b, "below": row[f"{k}_b"], "above": row[f"{k}_a"]}
    return out


def bin_edges(n: int, low: float, high: float, q1: float, q3: float) -> list[float]:
    """Equal bins: as many as the finer of Sturges' and Freedman and Diaconis' rules, BINS_MOST at most."""
    if high <= low:
        return [low - 0.5, low + 0.5]
    width = (high - low) / (math.log2(n) + 1)
    if q3 > q1:
        width = min(width, 2 * (q3 - q1) / n ** (1 / 3))
    k = min(BINS_MOST, max(1, math.ceil((high - low) / width)))
    return [low + (high - low) * i / k for i in range(k + 1)]


def histogram(table: Table, column: ColumnInfo, edges: list[float]) -> list[int]:
    """Rows in each bin; the last one has both its ends."""
    k, low, high = len(edges) - 1, edges[0], edges[-1]
    x = P.finite(F.col(column.id))
    place = F.least(F.width_bucket(x, F.lit(low), F.lit(high), F.lit(k)), F.lit(k))
    counts = dict(map(tuple, table.df.where((x >= low) & (x <= high)).groupBy(place.alias("b")).count().collect()))
    return [counts.get(i + 1, 0) for i in range(k)]


def _numeric(table: Table, c: ColumnInfo, range_shown: dict | None) -> dict:
    s, f = numeric_summary(table)[c.id], facts(table)[c.id]
    distinct = f["n_distinct"] - (1 if f["inf"] else 0)
    return {"count": s["n"], "missing": table.n_rows - f["n"], "infinite": f["inf"], "mean": s["mean"], "std": s["std"], "min": s["min"], "q1": s["q1"], "median": s["median"], "q3": s["q3"], "max": s["max"], "skew": s["skew"] if distinct >= 3 else None, "range_shown": range_shown}


def _categorical(table: Table, c: ColumnInfo, hidden: bool) -> dict:
    shown = table.df.select(P.label_text(F.col(c.id), c.kind).alias("v"))
    rows = A.ranked_top(shown, "v", TOP).orderBy("rank").collect()
    top = [{"label": None if hidden else r["label"], "count": r["n"]} for r in rows if r["rank"] <= TOP]
    rest = next((r for r in rows if r["rank"] > TOP), None)
    f = facts(table)[c.id]
    return {"count": f["n"], "missing": table.n_rows - f["n"], "distinct": f["n_distinct"], "top": top, "other_count": rest["n"] if rest else 0, "other_distinct": rest["pooled"] if rest else 0}


def univariate(table: Table, settings: Settings, write: bool = True) -> Result:
    n = table.need_rows("distributions")
    kinds, known = semantic_types(table), facts(table)
    personal = {d["name"] for d in pii(table, settings).metrics["columns"]}
    numbers = [c for c in table.columns if kinds[c.id] == "numeric"]
    shown = wide_range(table, numbers)
    rows, figures, undrawn, hidden, pages = [], [], [], [], {"numeric": 0, "categorical": 0}
    for c in table.columns:
        kind, f = kinds[c.id], known[c.id]
        entry = {"name": c.name, "semantic_type": kind, "plot": None, "figure": None, "labels_hidden": False, "skipped_reason": None}
        if kind == "numeric" and numeric_summary(table)[c.id]["n"]:
            s = _numeric(table, c, shown[c.id])
            entry |= {"statistics": s, "plot": "histogram"}
            if f["whole"] and f["n_distinct"] <= DISCRETE:
                bars = [(f"{r['value']:g}", r["n"]) for r in A.frequency(table.df.select(P.finite(F.col(c.id)).alias("v")), "v").orderBy("value").limit(DISCRETE).collect()]
                entry["plot"] = "value_bars"
            else:
                low, high = (shown[c.id]["low"], shown[c.id]["high"]) if shown[c.id] else (s["min"], s["max"])
                edges = bin_edges(s["count"], low, high, s["q1"], s["q3"])
                bars = list(zip([f"{e:.3g}" for e in edges[:-1]], histogram(table, c, edges), strict=True))
        elif kind in ("categorical", "boolean") and f["n"]:
            entry |= {"labels_hidden": c.name in personal, "plot": "bars"}
            entry["statistics"] = s = _categorical(table, c, c.name in personal)
            bars = [(t["label"] or "", t["count"]) for t in s["top"]]
            if c.name in personal:
                hidden.append(c.name)
        else:
            entry |= {"statistics": {"count": f["n"], "missing": n - f["n"], "distinct": f["n_distinct"]}, "skipped_reason": "no values" if not f["n"] else kind}
            undrawn.append(c.name)
            rows.append(entry)
            continue
        page = "numeric" if kind == "numeric" else "categorical"
        if pages[page] < PLOTS_ON_PAGE * PAGES:
            pages[page] += 1
            if write:
                entry["figure"] = svg.save(svg.bars(c.name, bars), svg.safe_path(settings.output_dir, f"column_{c.name}"))
                figures.append(os.path.basename(entry["figure"]))
        rows.append(entry)
    out = []
    if undrawn:
        out.append(finding("eda_not_plotted", Severity.INFO, 1.0, f"{listed(undrawn)}."))
    over = sum(e["plot"] is not None for e in rows) - sum(pages.values())
    if over:
        out.append(finding("eda_pages", Severity.INFO, 1.0, f"{count_of(over, 'column')} beyond the limit."))
    if hidden:
        out.append(finding("eda_hidden", Severity.INFO, 1.0, f"{listed(hidden)}."))
    return Result(findings=out, metrics={"n_rows": n, "columns": rows, "figures": figures}, settings=settings)


# --- relations


def associate(rows, column: ColumnInfo, numeric: bool, target: ColumnInfo, task: str, as_ordinal: bool = False) -> S.Effect | None:
    """Pearson, the correlation ratio or Cramer's V, by what the two columns are; None where there is too little to go on."""
    value = P.ordinal(F.col(column.id), column.kind) if as_ordinal else F.col(column.id)
    if numeric or as_ordinal:
        x = value if as_ordinal else P.finite(value)
        if task == "regression":
            return S.pearson(rows, x, P.finite(F.col(target.id)))
        return S.eta(rows, x, F.col(target.id))
    if task == "regression":
        return S.eta(rows, P.finite(F.col(target.id)), value)
    return S.cramers_v(rows, value, F.col(target.id))


def is_discrete(table: Table, c: ColumnInfo) -> bool:
    """Whole numbers, few of them: shown and balanced like classes."""
    f = facts(table)[c.id]
    return c.kind in ("integer", "floating") and bool(f["n"]) and bool(f["whole"]) and f["n_distinct"] - min(2, f["inf"]) <= DISCRETE


def class_balance(table: Table, c: ColumnInfo, hidden: bool) -> dict:
    shown = table.df.select(P.label_text(F.col(c.id), c.kind).alias("v"))
    counts = A.frequency(shown, "v")
    total = facts(table)[c.id]["n"]
    top = counts.orderBy(F.desc("n"), "value").limit(TOP).collect()
    least = counts.orderBy("n", "value").limit(1).first()
    classes = [({} if hidden else {"label": r["value"]}) | {"count": r["n"], "share": r["n"] / total} for r in top]
    return {"classes": classes, "other_count": total - sum(r["n"] for r in top), "minority_label": None if hidden else least["value"], "minority_share": least["n"] / total}


def imbalance_grade(share: float) -> Severity | None:
    return Severity.MEDIUM if share < RARE_MEDIUM else Severity.LOW if share < RARE_LOW else None


def _target(table: Table, settings: Settings, guard, kinds, personal, write: bool) -> tuple[dict | None, list, dict]:
    target = table.target_column
    if target is None:
        return None, [], {}
    kind = kinds[target.id]
    if kind not in TASKS:
        return {"name": target.name, "usable": False, "reason": kind}, [finding("eda_target", Severity.INFO, 1.0, f"'{target.name}' is {kind}.", [target.name])], {}
    task, out, artifacts = TASKS[kind], [], {}
    records, untested = [], []
    for c in table.columns:
        if c is target or kinds[c.id] not in TASKS:
            continue
        numeric = kinds[c.id] == "numeric"
        if not numeric:
            few = guard.rows.where(F.col(c.id).isNotNull()).select(c.id).distinct().limit(S.MOST_CATEGORIES + 1).count()
            if few > S.MOST_CATEGORIES:
                untested.append({"name": c.name, "reason": "too_many_categories"})
                continue
        e = associate(guard.rows, c, numeric, target, task)
        if e is None:
            untested.append({"name": c.name, "reason": "not_enough_data"})
        else:
            records.append((c.name, e))
    found = sorted(({"name": n, "kind": e.kind, "effect": e.effect, "p_adjusted": min(1.0, e.p * len(records))} for n, e in records), key=lambda a: -abs(a["effect"]))
    strong = [a for a in found if abs(a["effect"]) >= LEAST_EFFECT and a["p_adjusted"] < ALPHA]
    if strong:
        out.append(finding("eda_predictors", Severity.INFO, 1.0, "; ".join(f"'{a['name']}': {a['effect']:.2f}" for a in strong[:5]), [a["name"] for a in strong]))
    if untested:
        out.append(finding("eda_not_tested", Severity.INFO, 1.0, "; ".join(f"'{u['name']}': {u['reason'].replace('_', ' ')}" for u in untested[:5])))
    distribution = balance = None
    if kind in ("categorical", "boolean") or is_discrete(table, target):
        balance = class_balance(table, target, target.name in personal)
        bars = [(c.get("label", ""), c["count"]) for c in balance["classes"]]
        if severity := imbalance_grade(balance["minority_share"]):
            out.append(finding("eda_imbalance", severity, 1.0, f"The rarest class of '{target.name}' has {balance['minority_share']:.1%} of the rows.", [target.name]))
    else:
        shown = wide_range(table, [target])[target.id]
        distribution = {k: v for k, v in _numeric(table, target, shown).items() if k != "skew"}
        bars = []
        if distribution["count"]:
            low, high = (shown["low"], shown["high"]) if shown else (distribution["min"], distribution["max"])
            edges = bin_edges(distribution["count"], low, high, distribution["q1"], distribution["q3"])
            bars = list(zip([f"{e:.3g}" for e in edges[:-1]], histogram(table, target, edges), strict=True))
    if write and bars:
        artifacts["target_distribution"] = svg.save(svg.bars(target.name, bars), svg.safe_path(settings.output_dir, "target_distribution"))
    return {"name": target.name, "usable": True, "task": task, "associations": found, "not_tested": untested, "distribution": distribution, "class_balance": balance}, out, artifacts


def relationships(table: Table, settings: Settings, write: bool = True) -> Result:
    n = table.need_rows("relations")
    kinds, guard = semantic_types(table), guarded(table, settings)
    personal = {d["name"] for d in pii(table, settings).metrics["columns"]}
    target = table.target_column
    numbers = [c for c in table.columns if kinds[c.id] == "numeric" and c is not target]
    out, artifacts = list(guard.findings), {}
    correlation = {"computed": False, "columns": [], "matrix": None, "pairs": []}
    if guard.pairwise and len(numbers) >= 2:
        name = {c.id: c.name for c in numbers}
        cells = S.correlation_matrix(guard.rows, [c.id for c in numbers])
        r = {(a, b): v for a, b, _, v in cells} | {(b, a): v for a, b, _, v in cells}
        flat = numeric_summary(table)
        for c in numbers:
            r[c.id, c.id] = 1.0 if flat[c.id]["std"] else None
        strong = sorted(({"a": name[a], "b": name[b], "r": v} for a, b, _, v in cells if v is not None and abs(v) >= S.STRONG_CORRELATION), key=lambda p: -abs(p["r"]))
        matrix = [[r[a.id, b.id] for b in numbers] for a in numbers]
        correlation = {"computed": True, "columns": [c.name for c in numbers], "matrix": matrix, "pairs": strong}
        if write:
            artifacts["correlation_heatmap"] = svg.save(svg.heatmap([c.name for c in numbers], matrix), svg.safe_path(settings.output_dir, "correlation_heatmap"))
        if strong:
            names = sorted({x for p in strong for x in (p["a"], p["b"])})
            out.append(finding("eda_correlated", Severity.LOW, 1.0, "; ".join(f"'{p['a']}' and '{p['b']}': {p['r']:.2f}" for p in strong[:5]), names))
    metrics, found, more = _target(table, settings, guard, kinds, personal, write)
    out += found
    unused = [c.name for c in table.columns if c is not target and kinds[c.id] not in TASKS]
    if unused:
        out.append(finding("eda_not_used", Severity.INFO, 1.0, f"{listed(unused)}."))
    return Result(findings=out, metrics={"n_rows": n, "n_columns": len(table.columns), "correlation": correlation, "target": metrics}, artifacts=artifacts | more, settings=settings)


def explore(table: Table, settings: Settings, write: bool = True) -> Result:
    parts = {"univariate": univariate(table, settings, write), "relationships": relationships(table, settings, write)}
    found = by_severity(without_repeats(f for r in parts.values() for f in r.findings))
    return Result(findings=found, metrics={k: r.metrics for k, r in parts.items()}, artifacts={k: v for r in parts.values() for k, v in r.artifacts.items()}, settings=settings)
