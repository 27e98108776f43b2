"""The whole diagnostics report as one row, from one pass over scored rows.

A dialogue gives cells of measures: one for itself, one for each item, one for each juror. These are summed by
(kind, place), a handful of groups; a second aggregate sets the sums beside each other, and closed formulas follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GATES, ITEMS, TOTAL
from ..functions import numeric as N
from ..functions.tails import f_quantile, t_two_sided
from .aggregate import once

_BASES = ("imputed", "prorated")
_SIDES = ("mdd", "control")
#: Measures of a dialogue's cell, an item's and a juror's; all are summed. The item's 16 coincidences come besides.
_DIALOGUE = ("dialogues", "triggered", "min_coverage", "proration_valid", "discussed", "discussed_sq", "total", "total_sq", *(f"{b}_{s}_{m}" for b in _BASES for s in _SIDES for m in ("n", "sum", "sq")))
_ITEM = ("na", "score", "score_sq", "score_total", "contested", "units", "unit_sum", "unit_sum_sq", "vote_sq", "comparable", "agreeing")
_JUROR = ("juror_sum",)
_NAMES = (*_DIALOGUE, *_ITEM, *_JUROR)


def _cell(kind: str, place: Column, values: dict[str, Column], o: Column | None = None, jurors: Column | None = None) -> Column:
    empty = F.array_repeat(F.lit(0.0), 16)
    fields = [values.get(n, F.lit(0)).cast("double").alias(n) for n in _NAMES]
    return F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), (empty if o is None else o).alias("o"), (F.lit(None).cast("int") if jurors is None else jurors).alias("jurors"), *fields)


def _coincidences(votes: Column) -> Column:
    """16 coincidences of a unit's values, none with less than two."""
    count = F.transform(F.array(*map(F.lit, range(4))), lambda k: F.size(F.filter(votes, lambda v: v["score"] == k)).cast("double"))
    m = F.size(F.filter(votes, lambda v: v["score"].isNotNull()))
    pair = lambda v, w: F.get(count, F.lit(v)) * (F.get(count, F.lit(w)) - (1.0 if v == w else 0.0)) / (m - 1)
    return F.when(m >= 2, F.array(*(pair(v, w) for v in range(4) for w in range(4)))).otherwise(F.array_repeat(F.lit(0.0), 16))


def _cells(scored: DataFrame) -> DataFrame:
    """(kind, place, o, jurors, measures): 9 cells and one for each juror from every dialogue, in place."""
    prorated, imputed = F.col("total_prorated"), F.col("total_imputed").cast("double")
    own = {
        "dialogues": F.lit(1), "triggered": F.col("triggered_arbitration").cast("int"), "min_coverage": F.col("meets_min_coverage").cast("int"), "proration_valid": F.col("proration_valid").cast("int"),
        "discussed": F.col("discussed_count"), "discussed_sq": F.col("discussed_count") * F.col("discussed_count"), "total": F.col("final_total"), "total_sq": F.col("final_total") * F.col("final_total"),
    }
    for basis, x in (("imputed", imputed), ("prorated", prorated)):
        for side in _SIDES:
            there = (F.col("condition") == side) & x.isNotNull()
            own |= {f"{basis}_{side}_{m}": F.when(there, v).otherwise(0.0) for m, v in (("n", F.lit(1.0)), ("sum", x), ("sq", x * x))}
    every = F.array_contains("arbitration_items", F.lit(TOTAL))
    judged = "judge_resolution" in scored.columns
    scores = lambda v: F.transform(v, lambda x: F.coalesce(x["score"], F.lit(0)).cast("double"))

    def item(i: Column, at: Column) -> Column:
        x = F.get("final_item_scores", at).cast("double")
        answer = F.when(F.col("judge_resolution").isNotNull(), F.try_element_at("judge_resolution", i["item"])["final_score"]) if judged else F.lit(None).cast("int")
        both = answer.isNotNull() & i["mode"].isNotNull()
        row = N.total(scores(i["votes"]))
        values = {
            "na": (i["consensus_assertion"] == "not_mentioned").cast("int"), "score": x, "score_sq": x * x, "score_total": x * F.col("final_total"), "contested": (every | F.array_contains("arbitration_items", i["item"])).cast("int"),
            "units": F.lit(1), "unit_sum": row, "unit_sum_sq": row * row, "vote_sq": N.total(F.transform(scores(i["votes"]), lambda v: v * v)),
            "comparable": both.cast("int"), "agreeing": (both & (answer == i["mode"])).cast("int"),
        }
        return _cell("item", at, values, _coincidences(i["votes"]), F.size(i["votes"]))

    first = F.size(F.get("items", F.lit(0))["votes"])
    juror = lambda j: _cell("juror", j, {"juror_sum": F.aggregate("items", F.lit(0.0), lambda s, i: s + F.coalesce(F.get(i["votes"], j)["score"], F.lit(0)))})
    jurors = F.transform(F.sequence(F.lit(0), F.greatest(first, F.lit(1)) - 1), juror)
    cells = F.concat(F.array(_cell("dialogue", F.lit(0), own)), F.transform("items", item), jurors)
    return scored.select(F.explode(cells).alias("c")).select("c.*")


def sums(scored: DataFrame) -> DataFrame:
    """One row: d_* (sums over dialogues), items (sums of each item, in order), jurors (sums of each juror)."""
    o = [F.sum(F.get("o", F.lit(k))).alias(f"o{k}") for k in range(16)]
    cells = _cells(scored).groupBy("kind", "place").agg(F.min("jurors").alias("least"), F.max("jurors").alias("most"), *o, *(F.sum(n).alias(n) for n in _NAMES))
    of = lambda kind, names: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", *names))))
    matrix = F.array(*(F.col(f"o{k}") for k in range(16))).alias("o")
    gathered = cells.groupBy().agg(of("dialogue", _DIALOGUE).alias("d"), of("item", ("least", "most", matrix, *_ITEM)).alias("items"), of("juror", _JUROR).alias("jurors"))  # of 9 rows and the jurors'
    first = once(gathered, {"__d": F.get("d", F.lit(0))})
    return first.select(*(F.col("__d")[n].alias(f"d_{n}") for n in _DIALOGUE), "items", "jurors")


def _alpha(o: Column) -> Column:
    """Ordinal alpha of a matrix of 16 coincidences; null where only one value occurs."""
    cell = lambda v, w: F.get(o, F.lit(4 * v + w))
    n = [sum((cell(v, w) for w in range(1, 4)), cell(v, 0)) for v in range(4)]
    total = n[0] + n[1] + n[2] + n[3]
    seen = chance = F.lit(0.0)
    for v in range(4):
        for w in range(v + 1, 4):
            d = sum(n[v + 1 : w + 1], n[v]) - (n[v] + n[w]) / 2
            seen, chance = seen + 2 * cell(v, w) * d * d, chance + 2 * n[v] * n[w] * d * d
    return F.when(chance > 0, 1 - (total - 1) * seen / chance)


def _variance(n: Column, s: Column, sq: Column) -> Column:
    """Sample variance from sums; null below two."""
    return F.when(n >= 2, F.greatest(F.lit(0.0), sq - s * s / n) / (n - 1))


def _icc(row: DataFrame, confidence: float) -> DataFrame:
    add = lambda f: F.aggregate("items", F.lit(0.0), lambda s, i: s + i[f])
    n, k = add("units"), F.array_max(F.transform("items", lambda i: i["most"])).cast("double")
    s, sq, rr = add("unit_sum"), add("vote_sq"), add("unit_sum_sq")
    cc = F.aggregate("jurors", F.lit(0.0), lambda t, j: t + j["juror_sum"] * j["juror_sum"])
    row = once(row, {"n": n, "k": k, "ss_rows": rr / k - s * s / (n * k), "ss_cols": cc / n - s * s / (n * k), "ss_total": sq - s * s / (n * k)})
    same = F.array_min(F.transform("items", lambda i: i["least"])) == F.col("k")
    fit = F.when(~same, F.raise_error(F.lit("units with different numbers of jurors")).cast("double")).when((F.col("n") < 2) | (F.col("k") < 2), F.raise_error(F.lit("ICC needs two units and two jurors at least")).cast("double"))
    n, k = F.coalesce(fit, F.col("n")), F.col("k")
    rest = F.greatest(F.lit(0.0), F.col("ss_total") - F.col("ss_rows") - F.col("ss_cols"))
    row = once(row, {"msr": F.col("ss_rows") / (n - 1), "msc": F.col("ss_cols") / (k - 1), "mse": rest / ((n - 1) * (k - 1))})
    msr, msc, mse, exact = F.col("msr"), F.col("msc"), F.col("mse"), F.col("mse") < 1e-12
    d1, d2 = F.col("n") - 1, (F.col("n") - 1) * (k - 1)
    row = once(row, {"f": F.when(~exact, msr / mse), "q1": f_quantile(0.5 + confidence / 2, d1, d2), "q2": f_quantile(0.5 + confidence / 2, d2, d1)})
    one, bound = F.when(msr > 0, 1.0).otherwise(0.0), lambda f: (f - 1) / (f + k - 1)
    return row.withColumn(
        "icc",
        F.struct(
            F.when(exact, one).otherwise((msr - mse) / (msr + (k - 1) * mse)).alias("icc3"),
            F.when(exact, one).otherwise(bound(F.col("f") / F.col("q1"))).alias("icc3_low"),
            F.when(exact, one).otherwise(bound(F.col("f") * F.col("q2"))).alias("icc3_high"),
            F.when(exact, F.when(msr > 0, msr / (msr + k * F.greatest(F.lit(0.0), msc) / F.col("n"))).otherwise(0.0)).otherwise((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / F.col("n"))).alias("icc2"),
        ),
    )


def _separation(row: DataFrame, basis: str) -> DataFrame:
    """Cohen's d and Welch's test of the conditions on one basis; null with less than two dialogues on a side."""
    get = lambda side, m: F.col(f"d_{basis}_{side}_{m}")
    n = {s: get(s, "n") for s in _SIDES}
    mean = {s: F.when(n[s] > 0, get(s, "sum") / n[s]) for s in _SIDES}
    var = {s: _variance(n[s], get(s, "sum"), get(s, "sq")) for s in _SIDES}
    row = once(row, {f"sep_{s}_{x}": c[s] for s in _SIDES for x, c in (("mean", mean), ("var", var), ("n", n))})
    m, v, size = ({s: F.col(f"sep_{s}_{x}") for s in _SIDES} for x in ("mean", "var", "n"))
    a, b = _SIDES
    pooled = F.sqrt(((size[a] - 1) * v[a] + (size[b] - 1) * v[b]) / (size[a] + size[b] - 2))
    va, vb = v[a] / size[a], v[b] / size[b]
    some = va + vb > 0
    row = once(row, {"cohens_d": F.when(pooled > 0, (m[a] - m[b]) / pooled).otherwise(0.0), "t_statistic": F.when(some, (m[a] - m[b]) / F.sqrt(va + vb)), "df": F.when(some, F.pow(va + vb, F.lit(2)) / (va * va / (size[a] - 1) + vb * vb / (size[b] - 1)))})
    row = once(row, {"p_value": t_two_sided(F.col("t_statistic"), F.col("df"))})
    valid = F.coalesce((m[a] > m[b]) & (F.col("p_value") < GATES["p_value"]) & (F.col("cohens_d") >= GATES["cohens_d"]), F.lit(False))
    row = once(row, {"valid": valid})
    figures = F.struct(*(m[s].alias(f"{s}_mean") for s in _SIDES), *(F.sqrt(v[s]).alias(f"{s}_std") for s in _SIDES), "cohens_d", "t_statistic", "p_value", F.col("valid").alias("is_valid"))
    enough = F.least(*size.values()) >= 2
    row = once(row, {basis: F.when(enough, figures), f"{basis}_valid": enough & F.col("valid"), f"{basis}_there": enough})
    return row.drop("cohens_d", "t_statistic", "df", "p_value", "valid", *(f"sep_{s}_{x}" for s in _SIDES for x in ("mean", "var", "n")))


def report_row(scored: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row: n_dialogues, alpha, alpha_by_item, icc, cronbach, item_total, coverage, separation (with gate_basis),
    arbitration, judge_agreement, gates and passes. Arrays are in the items' order.

    scored: rows before or after a judge. Without rows, with less than two dialogues of each condition, or with units
    of different numbers of jurors it is an error. A statistic without variance is 0, alpha of a single value null.
    """
    row = once(sums(scored), {"count": F.coalesce(F.col("d_dialogues"), F.raise_error(F.lit("no scored rows")).cast("double"))})
    count = F.col("count")
    whole = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate("items", F.lit(0.0), lambda s, i: s + F.get(i["o"], k)))
    row = once(row, {"whole": whole})
    row = once(row, {"alpha": _alpha(F.col("whole")), "alpha_by_item": F.transform("items", lambda i: _alpha(i["o"]))}).drop("whole")
    row = _icc(row, confidence)
    total_var = _variance(count, F.col("d_total"), F.col("d_total_sq"))
    item_var = F.aggregate("items", F.lit(0.0), lambda s, i: s + _variance(count, i["score"], i["score_sq"]))
    k = len(ITEMS)
    cronbach = F.when(count < 2, None).when(total_var <= 0, 0.0).otherwise(k / (k - 1) * (1 - item_var / total_var))
    spread = lambda s, sq: count * sq - s * s

    def correlation(i: Column) -> Column:
        flat = (spread(i["score"], i["score_sq"]) <= 0) | (spread(F.col("d_total"), F.col("d_total_sq")) <= 0)
        return F.when(flat, 0.0).otherwise((count * i["score_total"] - i["score"] * F.col("d_total")) / F.sqrt(spread(i["score"], i["score_sq"]) * spread(F.col("d_total"), F.col("d_total_sq"))))

    add = lambda f: F.aggregate("items", F.lit(0.0), lambda s, i: s + i[f])
    each = F.transform("items", lambda i: 1 - i["na"] / count)
    mean = F.col("d_discussed") / count / k
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("d_discussed_sq") / count - F.pow(F.col("d_discussed") / count, F.lit(2)))) / k
    coverage = F.struct(
        (add("na") / (count * k)).alias("corpus_na_rate"), add("na").cast("long").alias("na_cells"), each.alias("item_coverage"), F.array_min(each).alias("min_item_coverage"), F.array_max(each).alias("max_item_coverage"),
        F.col("d_min_coverage").cast("long").alias("dialogues_with_min_coverage"), F.col("d_proration_valid").cast("long").alias("dialogues_with_proration_valid"), mean.alias("dialogue_coverage_mean"), deviation.alias("dialogue_coverage_std"),
    )
    agreed = F.when(add("comparable") > 0, add("agreeing") / add("comparable")).otherwise(1.0)
    arbitration = F.struct((F.col("d_triggered") / count).alias("overall"), F.transform("items", lambda i: i["contested"] / count).alias("by_item"))
    row = once(row, {"cronbach": cronbach, "item_total": F.transform("items", correlation), "coverage": coverage, "arbitration": arbitration, "judge_agreement": agreed})
    for basis in _BASES:
        row = _separation(row, basis)
    needed = F.when(~F.col("imputed_there"), F.raise_error(F.lit("separation needs two dialogues of each condition at least")).cast("string"))
    basis = F.coalesce(needed, F.when(F.col("prorated_there"), "prorated").otherwise("imputed"))
    row = row.withColumn("separation", F.struct(basis.alias("gate_basis"), "imputed", "prorated"))
    least = F.array_min(each)
    gates = {
        "alpha": F.coalesce(F.col("alpha") >= GATES["alpha"], F.lit(False)),
        "cronbach": F.coalesce(F.col("cronbach") >= GATES["cronbach"], F.lit(False)),
        "coverage": (least >= GATES["item_coverage"]) & (add("na") / (count * k) <= GATES["na_rate"]) & (F.col("d_min_coverage") / count >= GATES["min_coverage_rate"]),
        "separation": F.when(F.col("prorated_there"), F.col("prorated_valid")).otherwise(F.col("imputed_valid")),
        "arbitration": F.col("d_triggered") / count < GATES["arbitration_rate"],
    }
    row = once(row, {f"gate_{n}": g for n, g in gates.items()})
    row = row.withColumn("gates", F.struct(*(F.col(f"gate_{n}").alias(n) for n in gates)))
    passes = F.col("gate_alpha") & F.col("gate_cronbach") & F.col("gate_coverage") & F.col("gate_separation") & F.col("gate_arbitration")
    names = ("alpha", "alpha_by_item", "icc", "cronbach", "item_total", "coverage", "separation", "arbitration", "judge_agreement", "gates")
    return row.select(count.cast("long").alias("n_dialogues"), *names, passes.alias("passes"))


def report(scored: DataFrame) -> dict:
    """report_row as a dictionary, with items by name."""
    found = report_row(scored).first().asDict(True)
    by_name = lambda xs: dict(zip(ITEMS, xs, strict=True))
    found |= {n: by_name(found[n]) for n in ("alpha_by_item", "item_total")}
    found["coverage"]["item_coverage"] = by_name(found["coverage"]["item_coverage"])
    found["arbitration"]["by_item"] = by_name(found["arbitration"]["by_item"])
    return found


def markdown(found: dict) -> str:
    """The report for people: a line for each gate, then the figures."""
    out = ["# Diagnostics", "", f"Overall: {'PASS' if found['passes'] else 'FAIL'}", ""]
    out += [f"- {name}: {'PASS' if ok else 'FAIL'}" for name, ok in found["gates"].items()]
    out += ["", "| figure | value |", "|---|---|"]
    out += [f"| {k} | {found[k]} |" for k in ("n_dialogues", "alpha", "cronbach", "judge_agreement")]
    test = found["separation"][found["separation"]["gate_basis"]]
    figures = [*found["icc"].items(), *((k, v) for k, v in found["coverage"].items() if k != "item_coverage"), *test.items(), ("arbitration_rate", found["arbitration"]["overall"])]
    out += [f"| {k} | {v} |" for k, v in figures]
    out += ["", "| item | alpha | item-total | coverage | arbitration |", "|---|---|---|---|---|"]
    out += [f"| {i} | {found['alpha_by_item'][i]} | {found['item_total'][i]} | {found['coverage']['item_coverage'][i]} | {found['arbitration']['by_item'][i]} |" for i in ITEMS]
    return "\n".join(out) + "\n"
