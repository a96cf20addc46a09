"""Scanner evaluation against labelled truth: matching, metrics, posteriors, calibration, agreement of reviewers."""

from __future__ import annotations

from math import lgamma
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import repository_path
from ..session import durable

# What each identity signal counts when candidates are ranked, and how close a second one is ambiguous.
WEIGHTS = {"vulnerability_id": 100, "scanner_rule": 60, "code_region_hash": 55, "source_sink": 45, "symbol": 30, "cwe": 20, "file": 10, "line_proximity": 1}
CLOSE = 10
NEAR_LINES = 5


def normal(value: Column) -> Column:
    """Text for comparison: lower case, trimmed, null if empty."""
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


COMPARED = ("file", "symbol", "cwe", "source", "sink", "code_region_hash")
QUALIFYING = (("file", "rule"), ("file", "code_region_hash"), ("file", "source", "sink"), ("file", "symbol", "cwe"))


def truth_groups(truth: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Every truth with ``variants``, the sorted set of what its rows say, and ``group``, the least id of those that say the same: findings cannot tell them apart but by id."""
    said = [F.lower("scanner_rule").alias("t_rule"), F.col("line").alias("t_line"), *[normal(repository_path(F.col(c)) if c == "file" else F.col(c)).alias(f"t_{c}") for c in COMPARED]]
    each = truth.groupBy(*scope, "truth_id").agg(F.array_sort(F.collect_set(F.struct(*said))).alias("variants"))
    return each.withColumn("group", F.min("truth_id").over(Window.partitionBy(*scope, "variants")))


def candidate_groups(findings: DataFrame, groups: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """(scope, finding_key, group, n, score, named): the score of a finding with all ``n`` truths of a group by what they say, null if that does not qualify, and the truths of the group that the finding names, scored one by one.

    Rows grow with findings and groups that meet, not with pairs of findings and truths.
    """
    f = findings.select(*scope, "finding_key", F.lower(F.concat_ws(":", "scanner", "rule_id")).alias("f_rule"), F.upper("truth_ref").alias("f_ref"), F.col("start_line").alias("f_line"), *[normal(repository_path(F.col(c)) if c == "file" else F.col(c)).alias(f"f_{c}") for c in COMPARED])
    keys = lambda side: F.array_compact(F.array(*[F.when(sum((F.col(f"{side}_{c}").isNull().cast("int") for c in rule), F.lit(0)) == 0, F.xxhash64(F.lit(n), *[f"{side}_{c}" for c in rule])) for n, rule in enumerate(QUALIFYING)]))
    same = lambda c: F.coalesce(F.col(f"f_{c}") == F.col(f"t_{c}"), F.lit(False))
    file = same("file")
    signals = {
        "scanner_rule": same("rule"),
        "code_region_hash": file & same("code_region_hash"),
        "source_sink": file & same("source") & same("sink"),
        "symbol": file & same("symbol"),
        "cwe": same("cwe"),
        "file": file,
        "line_proximity": file & F.coalesce(F.abs(F.col("f_line") - F.col("t_line")) <= NEAR_LINES, F.lit(False)),
    }
    qualifies = (signals["scanner_rule"] & file) | signals["code_region_hash"] | signals["source_sink"] | (signals["symbol"] & signals["cwe"])
    score = sum((F.when(c, WEIGHTS[n]).otherwise(0) for n, c in signals.items()), F.lit(0))
    one = groups.groupBy(*scope, "group").agg(F.count("*").alias("n"), F.first("variants").alias("variants"))
    said = one.select(*scope, "group", "n", F.explode("variants").alias("v")).select(*scope, "group", "n", "v.*").withColumn("key", F.explode(keys("t")))
    nobody = F.lit(None).cast("struct<truth_id:string,score:int>")
    alike = f.drop("f_ref").withColumn("key", F.explode(keys("f"))).join(said, [*scope, "key"]).where(qualifies).select(*scope, "finding_key", "group", "n", score.alias("score"), nobody.alias("one"))
    ids = groups.select(*scope, "truth_id", "group", F.upper("truth_id").alias("f_ref"), F.explode("variants").alias("v")).select(*scope, "truth_id", "group", "f_ref", "v.*")
    called = f.where("f_ref is not null").join(ids, [*scope, "f_ref"]).groupBy(*scope, "finding_key", "group", "truth_id").agg(F.max(score + WEIGHTS["vulnerability_id"]).alias("score"))
    named = called.select(*scope, "finding_key", "group", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("int").alias("score"), F.struct("truth_id", "score").alias("one"))
    return alike.unionByName(named).groupBy(*scope, "finding_key", "group").agg(F.max("n").alias("n"), F.max("score").alias("score"), F.collect_set("one").alias("named"))


def match_candidates(findings: DataFrame, truth: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, finding_key, truth_id, score) of pairs whose identity signals qualify; a near line alone never does.

    A pair qualifies by the truth id that a finding names, or in one file by the rule, the code region's hash, source
    and sink, or symbol and CWE. Each of these is one key. Truths that say the same are one group, which a finding
    meets and is scored with once; its pairs are spelled out at the end and never shuffled. ``scope`` names columns of
    both sides that must agree, as the benchmark or the repository. Findings bring finding_key, scanner, rule_id, file,
    symbol, cwe, source, sink, code_region_hash, start_line and truth_ref; truth the like with truth_id, scanner_rule
    (``scanner:rule``) and line.
    """
    groups = truth_groups(truth, scope)
    met = candidate_groups(findings, groups, scope)
    named = met.select(*scope, "finding_key", "score", F.explode("named").alias("x")).select(*scope, "finding_key", "x.truth_id", F.greatest("score", "x.score").alias("score"))
    others = met.where("score is not null").join(groups.select(*scope, "group", "truth_id"), [*scope, "group"]).where(~F.exists("named", lambda x: x["truth_id"] == F.col("truth_id")))
    return others.select(*scope, "finding_key", "truth_id", "score").unionByName(named)


def counted_candidates(findings: DataFrame, truth: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """``match_candidates`` without spelling out pairs: (scope, finding_key, truth_id, score, n), where n truths share a score and truth_id is one of them (if a finding names none of them, the least)."""
    met = candidate_groups(findings, truth_groups(truth, scope), scope)
    part = lambda truth_id, score, n: F.struct(truth_id.alias("truth_id"), score.alias("score"), n.cast("bigint").alias("n"))
    rest = F.col("n") - F.size("named")
    others = F.when(F.col("score").isNotNull() & (rest > 0), part(F.col("group"), F.col("score"), rest))
    parts = F.array_compact(F.concat(F.array(others), F.transform("named", lambda x: part(x["truth_id"], F.greatest("score", x["score"]), F.lit(1)))))
    return met.select(*scope, "finding_key", F.explode(parts).alias("x")).select(*scope, "finding_key", "x.*")


def match_decisions(candidates: DataFrame) -> DataFrame:
    """Per finding: matched with its best truth, or ambiguous if another is within ten points of the best; ties by truth id.

    ``candidates`` are pairs, or what ``counted_candidates`` makes of them. There a truth_id need not be the least of
    its n, but then the one that the finding names scores no less and the finding is ambiguous or matched with that.
    """
    n = F.col("n") if "n" in candidates.columns else F.lit(1)
    counted = candidates.groupBy("finding_key", "score").agg(F.sum(n).alias("n"), F.min("truth_id").alias("truth_id"))  # few scores, so few rows per finding
    out = counted.groupBy("finding_key").agg(F.collect_list(F.struct("score", "n")).alias("scores"), F.max_by("truth_id", "score").alias("first"), F.max("score").alias("best"))
    close = F.aggregate(F.filter("scores", lambda x: F.col("best") - x["score"] < CLOSE), F.lit(0).cast("bigint"), lambda done, x: done + x["n"])
    out = out.withColumn("close", close)
    return out.select("finding_key", F.when(F.col("close") > 1, "ambiguous").otherwise("matched").alias("status"), F.when(F.col("close") == 1, F.col("first")).alias("truth_id"))


def adjudicate(findings: DataFrame, decisions: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Final decision per finding: a person's (approved or rejected) before the matcher's, else unmatched."""
    manual = adjudications.select("finding_key", F.when(F.col("verdict") == "approved", "matched").otherwise("unmatched").alias("m_status"), F.when(F.col("verdict") == "approved", F.col("target")).alias("m_truth"))
    joined = findings.select("finding_key").join(decisions, "finding_key", "left").join(manual, "finding_key", "left")
    by_hand = F.col("m_status").isNotNull()
    return joined.select("finding_key", F.coalesce("m_status", "status", F.lit("unmatched")).alias("status"), F.when(by_hand, F.col("m_truth")).otherwise(F.col("truth_id")).alias("truth_id"), by_hand.alias("manual"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def classification(counts: DataFrame) -> DataFrame:
    """``counts`` (tp, fp, fn) with precision, recall and f1; 0 where nothing was predicted or expected."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibration(forecasts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Brier score, ten-bin calibration error and its quality per key from (label, probability). The last bin is closed."""
    bins = sum((F.when(F.col("probability") >= i / 10, 1).otherwise(0) for i in range(1, 10)), F.lit(0))
    binned = forecasts.groupBy(*keys, bins.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("hits"), F.sum("probability").alias("p"), F.sum(F.pow(F.col("probability") - F.col("label"), 2)).alias("squares"))
    out = binned.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("squares") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("hits") - F.col("p"))) / F.sum("n")).alias("calibration_error"))
    return out.withColumn("quality", F.when(F.col("calibration_error") <= 0.05, "good").when(F.col("calibration_error") <= 0.15, "moderate").otherwise("poor"))


BROAD = 3000  # from here on, in both counts, the distribution is narrow and smooth enough to be integrated directly
NODES, NODE_WEIGHTS = np.polynomial.legendre.leggauss(32)
MOST_STEPS = 20_000


def stirling_rest(z: np.ndarray) -> np.ndarray:
    """What Stirling's formula for ln gamma(z) leaves, for z of at least 10."""
    return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln B(a, b) without the loss of digits that large arguments bring to differences of ln gamma."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    out = np.array([lgamma(x) for x in small])
    plain = large < 10
    out[plain] += [lgamma(y) - lgamma(x + y) for x, y in zip(small[plain], large[plain], strict=True)]
    x, y = small[~plain], large[~plain]
    out[~plain] += x - x * np.log(x + y) - (y - 0.5) * np.log1p(x / y) + stirling_rest(y) - stirling_rest(x + y)
    return out


def integrated(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta for large a and b, by Gauss-Legendre quadrature of the density from x into the nearer tail."""
    mean, sd = a / (a + b), np.sqrt(a * b / (a + b + 1)) / (a + b)
    right = x > mean
    far = np.where(right, np.minimum(1, np.maximum(mean + 10 * sd, x + 5 * sd)), np.maximum(0, np.minimum(mean - 10 * sd, x - 5 * sd)))
    off = (x + (far - x) * (NODES[:, None] + 1) / 2) - mean
    with np.errstate(divide="ignore"):
        density = np.exp((a - 1) * np.log1p(off / mean) + (b - 1) * np.log1p(-off / (1 - mean)))
    peak = np.sqrt(a * b / (2 * np.pi * (a + b))) * np.exp(stirling_rest(a + b) - stirling_rest(a) - stirling_rest(b)) / (mean * (1 - mean))
    tail = np.abs(far - x) / 2 * (NODE_WEIGHTS @ density) * peak
    return np.where(right, 1 - tail, tail)


def continued(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (evaluated by Lentz's method), on the side where it converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    value, live = np.zeros(len(x)), np.flatnonzero(y > 0)
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    z, pp, qq = y[live], p[live], q[live]
    d = 1 / away(1 - (pp + qq) * z / (pp + 1))
    c, h = np.ones_like(d), d.copy()
    for m in range(1, MOST_STEPS):
        for top in (m * (qq - m) * z / ((pp + 2 * m - 1) * (pp + 2 * m)), -(pp + m) * (pp + qq + m) * z / ((pp + 2 * m) * (pp + 2 * m + 1))):
            d, c = 1 / away(1 + top * d), away(1 + top / c)
            h *= d * c
        done = np.abs(d * c - 1) < 1e-15
        if done.any():
            at = live[done]
            value[at] = np.exp(p[at] * np.log(y[at]) + q[at] * np.log1p(-y[at]) - log_beta(p[at], q[at])) / p[at] * h[done]
            live, z, pp, qq, d, c, h = (v[~done] for v in (live, z, pp, qq, d, c, h))
        if not len(live):
            return np.where(flip, 1 - value, value)
    raise ArithmeticError("the incomplete beta function did not converge")


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta of all rows at once, for any counts."""
    x, a, b = (np.asarray(v, float) for v in (x, a, b))
    broad, out = np.minimum(a, b) > BROAD, np.empty(len(x))
    out[broad] = integrated(x[broad], a[broad], b[broad])
    out[~broad] = continued(x[~broad], a[~broad], b[~broad])
    return out


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the distribution reaches ``p``: Newton's method inside a bracket that shrinks with every step."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    mean, sd = a / (a + b), np.sqrt(a * b / (a + b + 1)) / (a + b)
    low, high = np.zeros(len(a)), np.ones(len(a))
    x = np.clip(mean + NormalDist().inv_cdf(p) * sd, mean / 4, mean + 0.75 * (1 - mean))
    norm, live = log_beta(a, b), np.arange(len(a))
    for _ in range(200):
        if not len(live):
            return x
        at, aa, bb = x[live], a[live], b[live]
        over = beta_cdf(at, aa, bb) - p
        low[live], high[live] = np.where(over < 0, at, low[live]), np.where(over < 0, high[live], at)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            to = at - over / np.exp((aa - 1) * np.log(at) + (bb - 1) * np.log1p(-at) - norm[live])
        inside = (to > low[live]) & (to < high[live])
        to = np.where(inside, to, (low[live] + high[live]) / 2)
        x[live] = to
        live = live[(np.abs(to - at) > 1e-11 * to) & (high[live] - low[live] > 1e-14 * high[live])]
    raise ArithmeticError("the beta quantile did not converge")


def maturity(n: Column, reproduced: Column | None = None) -> Column:
    level = F.when(n < 5, "Experimental").when(n < 30, "Directional").when(n < 100, "Moderate").otherwise("Mature")
    return level if reproduced is None else F.when(reproduced & (n >= 100), "Verified").otherwise(level)


def tier(n: Column, lower: Column) -> Column:
    return F.when(n < 5, "Experimental").when(n < 30, "Directional").when(lower >= 0.7, "High").when(lower >= 0.3, "Likely").otherwise("Noise")


def posteriors(counts: DataFrame, alpha: float = 1.0, beta: float = 1.0, level: float = 0.95) -> DataFrame:
    """``counts`` (tp, fp) with the beta-binomial posterior's mean, bounds, maturity and tier.

    Quantiles are computed once per distinct (tp, fp) and joined back.
    """

    def bounds(batches):
        for pdf in batches:
            a, b = pdf["tp"].to_numpy(float) + alpha, pdf["fp"].to_numpy(float) + beta
            tail = (1 - level) / 2
            yield pd.DataFrame({"tp": pdf["tp"], "fp": pdf["fp"], "lower": np.round(beta_quantile(tail, a, b), 6), "upper": np.round(beta_quantile(1 - tail, a, b), 6)})

    distinct = counts.select(F.col("tp").cast("bigint"), F.col("fp").cast("bigint")).distinct()
    made = distinct.mapInPandas(bounds, "tp bigint, fp bigint, lower double, upper double")
    n = F.col("tp") + F.col("fp")
    mean = F.bround((F.col("tp") + alpha) / (n + alpha + beta), 6)
    return counts.join(made, ["tp", "fp"]).withColumns({"mean": mean, "maturity": maturity(n), "tier": tier(n, F.col("lower"))})


def evaluate_tools(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Per tool: tp and fp of emitted findings (ambiguous ones left out), distinct truths detected and missed.

    ``decisions`` has tool, status and truth_id; ``truth`` has truth_id and tool, for each truth a tool should find.
    """
    emitted = decisions.groupBy("tool").agg(F.count_if(F.col("status") == "matched").alias("tp"), F.count_if(F.col("status") == "unmatched").alias("fp"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"))
    found = decisions.where("status = 'matched'").select("tool", "truth_id").distinct()
    expected = truth.select("tool", "truth_id").distinct()
    missed = expected.join(found, ["tool", "truth_id"], "left_anti").groupBy("tool").agg(F.count("*").alias("fn"))
    hit = expected.join(found, ["tool", "truth_id"], "left_semi").groupBy("tool").agg(F.count("*").alias("detected"))
    out = emitted.join(missed, "tool", "left").join(hit, "tool", "left").fillna(0, ["fn", "detected"])
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("detected"), F.col("detected") + F.col("fn"))
    return out.withColumn("precision", F.bround(precision, 6)).withColumn("recall", recall).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rule_scores(decisions: DataFrame) -> DataFrame:
    """Posterior precision per tool and rule of emitted findings; ambiguous ones are left out."""
    counted = decisions.groupBy("tool", F.coalesce("rule_id", F.lit("unknown")).alias("rule_id")).agg(F.count_if(F.col("status") == "matched").alias("tp"), F.count_if(F.col("status") == "unmatched").alias("fp"))
    return posteriors(durable(counted.where("tp + fp > 0")))  # which reads its counts twice


def truth_states(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """(tool, truth_id, state) of every truth a tool should find: matched or missed."""
    found = decisions.where("status = 'matched'").select("tool", "truth_id", F.lit("matched").alias("state")).distinct()
    return truth.select("tool", "truth_id").distinct().join(found, ["tool", "truth_id"], "left").fillna("missed", ["state"])


def detection_rate(decisions: DataFrame, seeded: DataFrame) -> DataFrame:
    """(truth_id, detected, rate): whether any tool found each seeded truth, and the whole per cent of them that were found."""
    found = decisions.where("status = 'matched'").select("truth_id", F.lit(True).alias("hit")).distinct()
    each = seeded.select("truth_id").distinct().join(found, "truth_id", "left").select("truth_id", F.coalesce("hit", F.lit(False)).alias("detected"))
    rate = each.agg(F.bround(F.count_if("detected") / F.count("*") * 100).cast("int").alias("rate"))
    return each.crossJoin(rate)  # one row


def overall(tools: DataFrame) -> DataFrame:
    """One row over all tools of ``evaluate_tools``: sums, precision of emitted findings, recall of distinct truths, and the posterior."""
    sums = tools.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "ambiguous", "detected")])
    precision, recall = F.bround(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6), ratio(F.col("detected"), F.col("detected") + F.col("fn"))
    scored = sums.withColumns({"precision": precision, "recall": recall}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return posteriors(durable(scored))


def independent_runs(runs: DataFrame) -> DataFrame:
    """Byte-identical runs count once: the first by (recorded_at, run_id) of each digest, with how many there were."""
    w = Window.partitionBy("sha256")
    return runs.withColumns({"_n": F.row_number().over(w.orderBy("recorded_at", "run_id")), "copies": F.count("*").over(w)}).where("_n = 1").drop("_n")


def reviewer_agreement(reviews: DataFrame) -> DataFrame:
    """Raw agreement and Cohen's kappa of two reviewers over their shared cases (case_id, first, second); kappa is 1 if chance agreement is certain."""
    n = reviews.groupBy("first", "second").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("first") == F.col("second"), F.col("n")).otherwise(0)).alias("agreed"))
    a, b = n.groupBy(F.col("first").alias("label")).agg(F.sum("n").alias("a")), n.groupBy(F.col("second").alias("label")).agg(F.sum("n").alias("b"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)).alias("chance"))
    out = total.crossJoin(chance)  # one row each
    observed, expected = F.col("agreed") / F.col("total"), F.col("chance") / (F.col("total").cast("double") * F.col("total"))
    return out.select(F.col("total").alias("cases"), "agreed", observed.alias("agreement"), F.when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected)).alias("kappa"))


UNCERTAINTY = {"certain": 0, "likely": 1, "uncertain": 2}


def merge_labels(reviews: DataFrame, adjudications: DataFrame) -> DataFrame:
    """One label per case: the agreed one with the larger uncertainty, or the adjudicated one; disputed until then."""
    joined = reviews.join(adjudications, "case_id", "left")
    agreed = F.col("first") == F.col("second")
    label = F.when(agreed, F.col("first")).otherwise(F.col("final"))
    return joined.select("case_id", label.alias("label"), F.greatest("first_uncertainty", "second_uncertainty").alias("uncertainty"), F.when(agreed, "agreed").when(F.col("final").isNotNull(), "adjudicated").otherwise("disputed").alias("state"))


def rule_calibration(feedback: DataFrame, enough: int = 5) -> DataFrame:
    """Per scanner and rule: confirmed true and false positives, the local posterior mean, and whether there are enough."""
    tp, fp = F.count_if(F.col("feedback_type") == "confirmed_true_positive"), F.count_if(F.col("feedback_type") == "confirmed_false_positive")
    out = feedback.groupBy("scanner", "rule_id").agg(tp.alias("tp"), fp.alias("fp"))
    n = F.col("tp") + F.col("fp")
    return out.where(n > 0).select("scanner", "rule_id", "tp", "fp", ((F.col("tp") + 1) / (n + 2)).alias("local"), (n >= enough).alias("sufficient"))


def merge_global(local: DataFrame, estimates: DataFrame, weight: float = 0.3, drift: float = 0.2) -> DataFrame:
    """Local rates shrunk towards the global estimate; drift if they differ by more than ``drift``.

    ``weight`` is the pull of the global estimate at the least sufficient sample and falls with the sample's size.
    Rules without enough feedback keep the global estimate.
    """
    joined = estimates.join(local, ["scanner", "rule_id"], "left")
    pull = F.lit(weight) * F.least(F.lit(1.0), F.lit(5.0) / (F.col("tp") + F.col("fp")))
    enough = F.coalesce("sufficient", F.lit(False))
    merged = F.when(enough, (1 - pull) * F.col("local") + pull * F.col("global")).otherwise(F.col("global"))
    return joined.withColumn("merged", merged).withColumn("drifted", enough & (F.abs(F.col("local") - F.col("global")) > drift))


def regressions(before: DataFrame, after: DataFrame, drop: float = 0.05, runtime_factor: float = 2.0) -> DataFrame:
    """(tool, code) of every metric drop beyond ``drop``, slowdown, missing tool and version change; the limits themselves pass."""
    b, a = before.select("tool", F.struct("*").alias("b")), after.select("tool", F.struct("*").alias("a"))
    joined = b.join(a, "tool", "full_outer")
    gone = F.col("a").isNull() & F.col("b").isNotNull()
    fell = [(f"{m}_drop", F.col(f"a.{m}") < F.col(f"b.{m}") - drop) for m in ("precision", "recall", "f1", "gating_estimate")]
    pairs = [("missing", gone), *fell, ("runtime", F.col("a.runtime_seconds") > F.col("b.runtime_seconds") * runtime_factor), ("version", ~F.col("a.scanner_version").eqNullSafe(F.col("b.scanner_version")) & F.col("a").isNotNull() & F.col("b").isNotNull())]
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in pairs]))
    return joined.select("tool", F.explode(codes).alias("code"))
