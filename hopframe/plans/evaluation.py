"""Evaluation of predicted decompositions against gold: join, per-item scores, aggregates, comparison of two systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions import graphs, metrics, text
from ..operators import aggregate, joins, stats

PER_ITEM = ["exact_match", "step_f1", "ordered_accuracy", "rouge_l_f1", "reference_validity", "break_exact", "sari", "ged", "chain_validity", "count_error"]
WEIGHTS = {"step_f1": 0.4, "ordered_accuracy": 0.3, "reference_validity_micro": 0.2}
COUNT_WEIGHT, COUNT_SCALE = 0.1, 3.0


def items(pred: DataFrame, gold: DataFrame, ordinal: str | None = None) -> DataFrame:
    """pred (question, steps) with gold (question, steps) by normalized question; unmatched rows have gold_found false."""
    return joins.by_question(pred, gold, "question", ordinal)


def score(rows: DataFrame, with_ged: bool = True) -> DataFrame:
    """All row-level scores of rows with steps, gold_steps and question, each computed once."""
    p, g = F.col("steps"), F.col("gold_steps")
    line = lambda s: text.tokenize(text.join_steps(s))
    steps, rouge = metrics.step_scores(p, g), metrics.rouge_l(line(p), line(g))
    ref, chain = metrics.reference_validity(p), metrics.chain_validity(p, g)
    out = rows.withColumns({"\x00steps": steps, "\x00rouge": rouge, "\x00ref": ref, "\x00chain": chain})
    out = out.withColumns({
        "exact_match": F.col("\x00steps")["exact_match"], "ordered_accuracy": F.col("\x00steps")["ordered_accuracy"],
        **{f"step_{k}": F.col("\x00steps")[k] for k in ("precision", "recall", "f1")}, **{f"rouge_l_{k}": F.col("\x00rouge")[k] for k in ("precision", "recall", "f1")},
        "reference_validity": F.col("\x00ref")["score"], "references_valid": F.col("\x00ref")["valid"], "references_total": F.col("\x00ref")["total"],
        "chain_validity": F.col("\x00chain")["score"], "break_exact": metrics.break_exact(p, g), "sari": metrics.sari(F.col("question"), text.break_string(p), text.break_string(g)),
        "count_error": F.size(p) - F.size(g), "hop_count_error": F.coalesce(*(F.col(c) for c in ("predicted_hop_count",) if c in rows.columns), F.size(p)) - F.coalesce(*(F.col(c) for c in ("gold_hop_count",) if c in rows.columns), F.size(g)), "gold_hops": F.size(g), "predicted_hops": F.size(p),
    })
    if with_ged:
        out = out.withColumn("\x00ged", graphs.ged(text.break_steps(p), text.break_steps(g))).withColumns({"ged": F.col("\x00ged")["ged"], "ged_fallback": F.col("\x00ged")["ged_fallback"]})
    return out.drop(*[c for c in out.columns if c.startswith("\x00")])


def aggregates(with_ged: bool = True) -> list[Column]:
    names = ["exact_match", "step_precision", "step_recall", "step_f1", "ordered_accuracy", "rouge_l_precision", "rouge_l_recall", "rouge_l_f1", "reference_validity", "chain_validity", "break_exact", "sari"]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.count("*").alias("n_items"), *(zero(F.avg(n)).alias(n) for n in names + ["ged"] * with_ged)]
    out += [aggregate.micro(F.col("references_valid"), F.col("references_total")).alias("reference_validity_micro"), zero(F.avg(F.abs("count_error"))).alias("count_mae"), zero(F.avg("count_error")).alias("count_signed_error")]
    rate = lambda c: zero(F.avg(c.cast("double")))
    e = F.col("count_error")
    h = F.col("hop_count_error")
    out += [rate(h == 0).alias("hop_count_exact_rate"), zero(F.avg(F.abs(h))).alias("hop_count_mae")]
    return [*out, rate(e > 0).alias("over_rate"), rate(e < 0).alias("under_rate"), rate(e == 0).alias("count_exact_rate")]


def summarize(scored: DataFrame, with_ged: bool = True) -> DataFrame:
    """Overall (gold_hops null) and per gold hop, in one pass, with the weighted composite."""
    out = aggregate.grouped_and_total(scored, "gold_hops", *aggregates(with_ged))
    comp = metrics.composite([(F.col(k), w) for k, w in WEIGHTS.items()], F.col("count_mae"), COUNT_WEIGHT, COUNT_SCALE)
    return out.withColumn("composite", comp)


def distribution(scored: DataFrame, column: str) -> DataFrame:
    """(gold_hops, is_total, value, n): how often each value of a column (predicted_hops, ged_fallback) occurs, per gold
    hop and in all, nulls left out."""
    some = scored.where(F.col(column).isNotNull())
    return some.groupBy("gold_hops", column).agg(F.count("*").alias("n")).rollup(column, "gold_hops").agg(
        F.grouping("gold_hops").cast("boolean").alias("is_total"), F.grouping(column).alias("\x00all"), F.sum("n").alias("n")
    ).where(F.col("\x00all") == 0).select("gold_hops", "is_total", F.col(column).alias("value"), "n")


RATIOS = {"reference_validity_micro": ("references_valid", "references_total")}  # sums over sums


def compare_arms(arms: dict[str, DataFrame], baseline: str, key: str, names: list[str], resamples: int = 1000, alpha: float = 0.05) -> dict[str, DataFrame]:
    """Bootstrap intervals, t-tests and McNemar tests of every other arm's items against the baseline's, as tables with a
    column `arm`; all arms have the baseline's items.

    The arms are joined once and stored; each kind of test then takes one pass over that table for all arms and columns.
    Besides means of the named columns, ratios of sums (RATIOS) and the weighted composite are resampled where an arm has
    their columns."""
    others = [a for a in arms if a != baseline]
    more = sorted(({c for cs in RATIOS.values() for c in cs} | {"count_error", *WEIGHTS}) - set(RATIOS))
    have = lambda arm: [c for c in dict.fromkeys([*names, *more]) if c in arms[arm].columns and c in arms[baseline].columns]
    own = {arm: i for i, arm in enumerate([baseline, *others])}
    side = lambda arm: arms[arm].select(key, *(F.col(c).cast("double").alias(f"{c}__{own[arm]}") for c in have(arm)))
    both = side(baseline)
    for arm in others:
        both = joins.complete(both, side(arm), key)
    both = runtime.stored(both, "arms")
    of = lambda c, arm: F.col(f"{c}__{own[arm]}")

    sums: dict[str, Column] = {}
    statistics: dict[str, Column] = {}
    for arm in others:
        for c in (c for c in names if c in have(arm)):
            d = of(c, arm) - of(c, baseline)
            sums |= {f"{arm}|{c}|d": d, f"{arm}|{c}|n": d.isNotNull().cast("int")}
            statistics[f"{arm}|{c}"] = F.try_divide(F.col(f"`{arm}|{c}|d`"), F.col(f"`{arm}|{c}|n`"))
    for arm in others:
        full = have(arm)
        sides = {}
        for s in (arm, baseline):
            base = f"{arm}|{s}"
            mean = lambda c: F.coalesce(F.try_divide(F.col(f"`{base}|{c}`"), F.col(f"`{base}|{c}|n`")), F.lit(0.0))  # noqa: B023, E731
            micro = {}
            for r, (valid, total) in RATIOS.items():
                if valid in full and total in full:
                    sums |= {f"{base}|{valid}": of(valid, s), f"{base}|{total}": of(total, s)}
                    micro[r] = F.coalesce(F.try_divide(F.col(f"`{base}|{valid}`"), F.col(f"`{base}|{total}`")), F.lit(1.0))
            means = [c for c in WEIGHTS if c not in RATIOS]
            whole = all(c in full for c in [*means, "count_error"]) and all(r in micro for r in RATIOS)
            if whole:
                for c, v in [*((c, of(c, s)) for c in means), ("count_error", F.abs(of("count_error", s)))]:
                    sums |= {f"{base}|{c}": v, f"{base}|{c}|n": v.isNotNull().cast("int")}
                micro["composite"] = metrics.composite([(micro[c] if c in RATIOS else mean(c), w) for c, w in WEIGHTS.items()], mean("count_error"), COUNT_WEIGHT, COUNT_SCALE)
            sides[s] = micro
        statistics |= {f"{arm}|{c}": sides[arm][c] - sides[baseline][c] for c in sides[arm]}
    split = lambda rows: rows.withColumn("arm", F.substring_index("statistic", "|", 1)).withColumn("statistic", F.substring_index("statistic", "|", -1))
    boot = split(stats.intervals(stats.resampled(both, key, sums, resamples), statistics, alpha)).withColumnRenamed("value", "mean_diff")
    lower = F.when(F.col("statistic").isin(sorted(stats.LOWER_IS_BETTER)), -1).otherwise(1)
    better = F.col("mean_diff") * lower
    boot = boot.withColumn("favours", F.when(F.col("significant") & (better != 0), F.when(better > 0, "a").otherwise("b")))
    tests = {f"{arm}|{c}": (of(c, arm), of(c, baseline)) for arm in others for c in names if c in have(arm)}
    return {"bootstrap": boot, "t_test": split(stats.paired_t(both, tests)), "mcnemar": split(stats.mcnemar_many(both, tests, alpha))}


def compare(a: DataFrame, b: DataFrame, key: str, names: list[str], resamples: int = 1000) -> dict[str, DataFrame]:
    """`compare_arms` of two scored tables of the same items."""
    return {kind: rows.drop("arm") for kind, rows in compare_arms({"a": a, "b": b}, "b", key, names, resamples).items()}


def coverage(status: DataFrame) -> DataFrame:
    """(status, reason, n, rate): reasons cut at the first ":"."""
    rows = status.groupBy("status", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))
    total = status.agg(F.count("*").alias("total"))
    return rows.join(total).withColumn("rate", metrics.safe_div(F.col("n"), F.col("total"))).drop("total")  # a one-row side
