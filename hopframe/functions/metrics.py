"""Row-level scores as native expressions over arrays. Arrays must not be null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import text as T
from .binding import let


def indexes(n: Column) -> Column:
    """1..n, empty for n < 1 (sequence would count down)."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_prf(pred: Column, gold: Column) -> Column:
    """struct(precision, recall, f1) of distinct items; both empty: 1."""

    def of(s: Column) -> Column:
        both, n, m = F.size(F.array_intersect(s["p"], s["g"])), F.size(s["p"]), F.size(s["g"])
        return let(F.struct(both.alias("both"), n.alias("n"), m.alias("m")), rates)

    def rates(c: Column) -> Column:
        empty = (c["n"] == 0) & (c["m"] == 0)
        one = lambda x: F.when(empty, F.lit(1.0)).otherwise(x)
        pr, rc = safe_div(c["both"], c["n"]), safe_div(c["both"], c["m"])
        return F.struct(one(pr).alias("precision"), one(rc).alias("recall"), one(safe_div(2 * pr * rc, pr + rc)).alias("f1"))

    return let(F.struct(F.array_distinct(pred).alias("p"), F.array_distinct(gold).alias("g")), of)


def _real(steps: Column) -> Column:
    return F.filter(steps, lambda x: F.trim(x) != "")


def _in_order(p: Column, g: Column) -> Column:
    same = F.aggregate(F.zip_with(p, g, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")), F.lit(0), lambda n, x: n + x)
    longer = F.greatest(F.size(p), F.size(g))
    return F.when(longer == 0, F.lit(1.0)).otherwise(same / longer)


def _normalized(pred: Column, gold: Column, body):
    return let(F.struct(F.transform(pred, T.normalize_step).alias("p"), F.transform(gold, T.normalize_step).alias("g")), body)


def step_scores(pred: Column, gold: Column) -> Column:
    """struct(precision, recall, f1, ordered_accuracy, exact_match), the steps normalized once."""

    def of(s: Column) -> Column:
        every = F.struct(set_prf(_real(s["p"]), _real(s["g"])).alias("prf"), _in_order(s["p"], s["g"]).alias("ordered_accuracy"), (s["p"] == s["g"]).cast("double").alias("exact_match"))
        return let(every, lambda c: F.struct(*(c["prf"][k].alias(k) for k in ("precision", "recall", "f1")), c["ordered_accuracy"], c["exact_match"]))

    return _normalized(pred, gold, of)


def step_prf(pred: Column, gold: Column) -> Column:
    """set_prf of normalized steps, blank ones left out."""
    return _normalized(pred, gold, lambda s: set_prf(_real(s["p"]), _real(s["g"])))


def ordered_accuracy(pred: Column, gold: Column) -> Column:
    """Places with equal normalized steps, over the longer length; both empty: 1."""
    return _normalized(pred, gold, lambda s: _in_order(s["p"], s["g"]))


def exact_match(pred: Column, gold: Column) -> Column:
    return _normalized(pred, gold, lambda s: (s["p"] == s["g"]).cast("double"))


def answer_exact(gold: Column, pred: Column) -> Column:
    return (T.normalize_answer(gold) == T.normalize_answer(pred)).cast("double")


def numbered(tokens: Column) -> Column:
    """The tokens, sorted, each with its number among its equals as a 64-bit hash: multisets as sets."""

    def of(t: Column) -> Column:
        n = F.size(t)
        begins = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)), lambda i: i.isNotNull())
        return let(begins, lambda b: F.flatten(F.transform(b, lambda at, k: F.transform(indexes(F.coalesce(F.get(b, k + 1), n) - at), lambda j: F.xxhash64(F.get(t, at), j)))))

    return let(F.array_sort(tokens), of)


def multiset_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token lists; with an empty one 1 if both are, else 0."""

    def of(c: Column) -> Column:
        p, r = safe_div(c["same"], c["m"]), safe_div(c["same"], c["n"])
        return F.when((c["n"] == 0) | (c["m"] == 0), (c["n"] == c["m"]).cast("double")).otherwise(safe_div(2 * p * r, p + r))

    counts = lambda s: F.struct(F.size(s["a"]).alias("n"), F.size(s["b"]).alias("m"), multiset_overlap(s["a"], s["b"]).alias("same"))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: let(counts(s), of))


def answer_f1(gold: Column, pred: Column) -> Column:
    return token_f1(T.answer_tokens(gold), T.answer_tokens(pred))


def gold_answers(answer: Column, aliases: Column) -> Column:
    """The answer and its aliases, distinct, blanks and nulls dropped."""
    every = F.concat(F.array(answer), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (F.trim(x) != "")))


def score_answer(pred: Column, golds: Column) -> Column:
    """struct(exact, f1): the best over the golds; none: 0."""
    best = lambda f: F.coalesce(F.array_max(F.transform(golds, lambda g: f(g, pred))), F.lit(0.0))
    return F.struct(best(answer_exact).alias("exact"), best(answer_f1).alias("f1"))


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token lists. Higher-order functions can say it, but they are
    interpreted cell by cell; here a row of the table is one integer, whose bits are updated at once."""

    def one(x, y) -> int:
        places: dict = {}
        for i, t in enumerate(x):
            places[t] = places.get(t, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for t in y:
            if m := places.get(t):
                u = row & m
                row = ((row + u) | (row - u)) & full
        return len(x) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_l(pred: Column, gold: Column) -> Column:
    """struct(precision, recall, f1) on token lists; both empty: 1, one empty: 0."""
    n = lcs_length(pred, gold)
    empty = (F.size(pred) == 0) & (F.size(gold) == 0)
    p, r = safe_div(n, F.size(pred)), safe_div(n, F.size(gold))
    one = lambda c: F.when(empty, F.lit(1.0)).otherwise(c)
    return F.struct(one(p).alias("precision"), one(r).alias("recall"), one(safe_div(2 * p * r, p + r)).alias("f1"))


def _references(steps: Column, pattern: str) -> Column:
    """array<array<int>>: the references of each step."""
    return F.transform(steps, lambda s: F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), lambda k: k.try_cast("int")))


def _valid_total(steps: Column, pattern: str) -> tuple[Column, Column]:
    refs = _references(steps, pattern)
    valid = F.aggregate(F.transform(refs, lambda r, i: F.size(F.filter(r, lambda k: (k >= 1) & (k < i + 1)))), F.lit(0), lambda s, x: s + x)
    total = F.aggregate(F.transform(refs, F.size), F.lit(0), lambda s, x: s + x)
    return valid, total


def reference_validity(steps: Column) -> Column:
    """struct(score, valid, total) of [#k]: valid where 1 <= k < the step's number; none: 1."""
    valid, total = _valid_total(steps, r"\[#(\d+)\]")
    return F.struct(F.when(total == 0, F.lit(1.0)).otherwise(safe_div(valid, total)).alias("score"), valid.alias("valid"), total.alias("total"))


def chain_validity(pred: Column, gold: Column) -> Column:
    """struct(score, valid, total) of bare #k; without any in the gold 1, without any in the prediction alone 0."""
    valid, total = _valid_total(pred, r"#(\d+)")
    _, wanted = _valid_total(gold, r"#(\d+)")
    score = F.when(total > 0, safe_div(valid, total)).when(wanted == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.struct(score.alias("score"), valid.alias("valid"), total.alias("total"))


def break_exact(pred: Column, gold: Column) -> Column:
    return (F.lower(T.break_string(pred)) == F.lower(T.break_string(gold))).cast("double")


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams, as 64-bit hashes."""
    return F.array_distinct(F.transform(indexes(F.size(tokens) - (n - 1)), lambda i: F.xxhash64(F.slice(tokens, i, n))))


def f_beta(hits: Column, selected: Column, relevant: Column, beta: float = 1.0) -> Column:
    """0/0 is 1; beta 0 is precision."""
    p = F.when(selected == 0, F.lit(1.0)).otherwise(hits / F.greatest(selected, F.lit(1)))
    if beta == 0:
        return p
    r = F.when(relevant == 0, F.lit(1.0)).otherwise(hits / F.greatest(relevant, F.lit(1)))
    b = beta * beta
    return F.when((p > 0) & (r > 0), (1 + b) * p * r / (b * p + r)).otherwise(F.lit(0.0))


def sari(question: Column, pred: Column, gold: Column) -> Column:
    """Keep F1, add F1 and delete precision over 1- to 4-grams of strings split at single spaces."""

    def parts(g: Column) -> Column:
        a, b, c = g["a"], g["b"], g["c"]
        sets = {"kept": F.array_intersect(a, b), "keep": F.array_intersect(a, c), "cut": F.array_except(a, b), "lose": F.array_except(a, c), "added": F.array_except(b, a), "add": F.array_except(c, a)}
        return let(F.struct(*(v.alias(k) for k, v in sets.items()), c.alias("gold")), sizes)

    def sizes(s: Column) -> Column:
        n = {k: F.size(s[k]) for k in ("kept", "keep", "cut", "lose", "added", "add")}
        n |= {"both": F.size(F.array_intersect(s["kept"], s["keep"])), "gone": F.size(F.array_intersect(s["cut"], s["lose"])), "right": F.size(F.array_intersect(s["added"], s["gold"]))}
        return let(F.struct(*(v.alias(k) for k, v in n.items())), lambda c: f_beta(c["both"], c["kept"], c["keep"]) + f_beta(c["gone"], c["cut"], c["lose"], 0.0) + f_beta(c["right"], c["added"], c["add"]))

    def total(w: Column) -> Column:
        by_n = [let(F.struct(ngrams(w["s"], n).alias("a"), ngrams(w["p"], n).alias("b"), ngrams(w["t"], n).alias("c")), parts) for n in (1, 2, 3, 4)]
        return sum(by_n[1:], by_n[0]) / 12.0

    return let(F.struct(*(F.split(c, " ").alias(k) for c, k in ((question, "s"), (pred, "p"), (gold, "t")))), total)


def score_ladder(hop: Column, neighbour_hops: Column, windows: list[tuple[int, int]]) -> Column:
    """Points of the first window (first k neighbours, points) that has the hop; null hop or none: 0."""
    out = F.lit(0)
    for k, points in reversed(windows):
        out = F.when(F.array_contains(F.slice(neighbour_hops, 1, k), hop), F.lit(points)).otherwise(out)
    return F.when(hop.isNull() | (F.size(neighbour_hops) == 0), F.lit(0)).otherwise(F.coalesce(out, F.lit(0)))


def mean_of_first(scores: Column, k: int) -> Column:
    some = F.filter(F.slice(scores, 1, max(k, 0)) if k > 0 else F.array().cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x))
    return safe_div(F.aggregate(some, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(some))


def unique_best_bonus(scores: dict[str, Column], points: int) -> dict[str, Column]:
    """Points to the best mode if no other has its score."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    ties = sum(((c == best).cast("int") for c in scores.values()), F.lit(0))
    return {k: F.when((c == best) & (ties == 1), F.lit(points)).otherwise(F.lit(0)) for k, c in scores.items()}


def best_mode(scores: dict[str, Column]) -> Column:
    """Name of the best; ties: the first."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    return F.coalesce(*(F.when(c == best, F.lit(k)) for k, c in scores.items()))


def composite(parts: list[tuple[Column, float]], count_error: Column, count_weight: float, scale: float) -> Column:
    """Weighted sum of aggregates and of 1 - error / scale, that one not below 0."""
    total = F.lit(0.0)
    for c, w in parts:
        total = total + c * w
    return total + F.greatest(F.lit(0.0), 1 - count_error / scale) * count_weight
