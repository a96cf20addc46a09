"""Benchmark, posterior, calibration and confidence queries: J3, J4, W1, A4 to A11, J22, P16, P17, W5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import benchmark as ops
from ..operators import confidence
from ._registry import query
from .portfolio import R6

SOME = "SELECT DISTINCT row_id, concat_ws('|', cast(row_id AS string), scanner, rule_id, file, cast(start_line AS string)) AS finding_key, scanner AS tool, scanner, rule_id, file, symbol, cwe, start_line, CASE WHEN row_id % 97 = 0 THEN concat('t', cast(20 * (row_id % 40) AS string)) END AS truth_ref FROM findings WHERE row_id % 4 = 1"
TRUTH = "SELECT truth_id, concat('bandit:', rule_id) AS scanner_rule, file, symbol, cwe, cast(100 + length(file) AS int) AS line FROM truth"


def inputs(findings: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    rest = {"source": none, "sink": none, "code_region_hash": none}
    f = findings.sparkSession.sql(SOME.replace("FROM findings", "FROM {f}"), f=findings).withColumns(rest)
    return f, truth.sparkSession.sql(TRUTH.replace("FROM truth", "FROM {t}"), t=truth).withColumns(rest)


CANDIDATES = f"""f AS ({SOME}), t AS ({TRUTH}), j AS (SELECT DISTINCT finding_key, truth_id, upper(f.truth_ref) = upper(t.truth_id) AS i, concat(f.scanner, ':', lower(f.rule_id)) = lower(t.scanner_rule) AS r, f.file = t.file AS fi, f.file = t.file AND f.symbol = t.symbol AS y, f.cwe = t.cwe AS w, f.file = t.file AND abs(start_line - line) <= 5 AS n FROM f JOIN t ON f.file = t.file OR upper(f.truth_ref) = upper(t.truth_id)),
    candidates AS (SELECT finding_key, truth_id, max(CASE WHEN i THEN 100 ELSE 0 END + CASE WHEN r THEN 60 ELSE 0 END + CASE WHEN y THEN 30 ELSE 0 END + CASE WHEN w THEN 20 ELSE 0 END + CASE WHEN fi THEN 10 ELSE 0 END + CASE WHEN n THEN 1 ELSE 0 END) AS score FROM j WHERE i OR (r AND fi) OR (fi AND y AND w) GROUP BY 1, 2)"""


@query(f"WITH {CANDIDATES} SELECT * FROM candidates", findings="findings", truth="truth")
def j3_truth_candidates(findings, truth):
    return ops.match_candidates(*inputs(findings, truth))


DECISIONS = f"""{CANDIDATES}, k AS (SELECT *, max(score) OVER (PARTITION BY finding_key) AS best, row_number() OVER (PARTITION BY finding_key ORDER BY score DESC, truth_id) AS p FROM candidates),
    d AS (SELECT finding_key, count(*) FILTER (best - score < 10) AS c, max(truth_id) FILTER (p = 1) AS first FROM k GROUP BY 1),
    decisions AS (SELECT finding_key, CASE WHEN c > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN c = 1 THEN first END AS truth_id FROM d)"""


@query(f"WITH {DECISIONS} SELECT * FROM decisions", findings="findings", truth="truth")
def w1_match_decisions(findings, truth):
    return ops.match_decisions(ops.counted_candidates(*inputs(findings, truth)))


FINAL = f"""{DECISIONS}, final AS (SELECT f.finding_key, CASE WHEN row_id % 50 = 1 THEN 'matched' WHEN row_id % 50 = 13 THEN 'unmatched' ELSE coalesce(status, 'unmatched') END AS status, CASE WHEN row_id % 50 = 1 THEN 'T20' WHEN row_id % 50 = 13 THEN NULL ELSE truth_id END AS truth_id, row_id % 50 IN (1, 13) AS manual FROM f LEFT JOIN decisions USING (finding_key))"""


def final(findings: DataFrame, truth: DataFrame) -> DataFrame:
    f, t = inputs(findings, truth)
    by_hand = f.where("row_id % 50 in (1, 13)").select("finding_key", F.when(F.col("row_id") % 50 == 1, "approved").otherwise("rejected").alias("verdict"), F.lit("T20").alias("target"))
    return ops.adjudicate(f, ops.match_decisions(ops.counted_candidates(f, t)), by_hand)


@query(f"WITH {FINAL} SELECT * FROM final", findings="findings", truth="truth")
def j4_adjudicated(findings, truth):
    return final(findings, truth)


TOOLS = f"""{FINAL}, dd AS (SELECT scanner AS tool, status, truth_id FROM final JOIN f USING (finding_key)), x AS (SELECT DISTINCT scanner AS tool, truth_id FROM (SELECT DISTINCT scanner FROM f) AS s JOIN truth ON length(scanner) % 2 = length(truth_id) % 2),
    e AS (SELECT tool, count(*) FILTER (status = 'matched') AS tp, count(*) FILTER (status = 'unmatched') AS fp, count(*) FILTER (status = 'ambiguous') AS ambiguous FROM dd GROUP BY 1), h AS (SELECT DISTINCT tool, truth_id FROM dd WHERE status = 'matched'),
    n AS (SELECT tool, count(*) FILTER (h.truth_id IS NULL) AS fn, count(h.truth_id) AS detected FROM x LEFT JOIN h USING (tool, truth_id) GROUP BY 1),
    tools AS (SELECT tool, tp, fp, ambiguous, coalesce(fn, 0) AS fn, coalesce(detected, 0) AS detected FROM e LEFT JOIN n USING (tool)),
    metrics AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN detected + fn = 0 THEN 0 ELSE detected / (detected + fn) END AS recall FROM tools)"""


def decided(findings: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    f, _ = inputs(findings, truth)
    decisions = final(findings, truth).join(f.select("finding_key", "tool", "rule_id"), "finding_key")
    return decisions, f.select("tool").distinct().join(truth.select("truth_id"), F.length("tool") % 2 == F.length("truth_id") % 2)


def tools(findings: DataFrame, truth: DataFrame) -> DataFrame:
    return ops.evaluate_tools(*decided(findings, truth))


MATURITY = "CASE WHEN tp + fp < 5 THEN 'Experimental' WHEN tp + fp < 30 THEN 'Directional' WHEN tp + fp < 100 THEN 'Moderate' ELSE 'Mature' END AS maturity"


@query(
    f"""WITH {TOOLS}, rr AS (SELECT scanner AS tool, rule_id, count(*) FILTER (status = 'matched') AS tp, count(*) FILTER (status = 'unmatched') AS fp FROM final JOIN f USING (finding_key) GROUP BY 1, 2)
    SELECT tool, rule_id, tp, fp, round_even((tp + 1) / (tp + fp + 2), 6) AS mean, {MATURITY} FROM rr WHERE tp + fp > 0""",
    findings="findings",
    truth="truth",
)
def a7_rule_scores(findings, truth):
    return R6(ops.rule_scores(decided(findings, truth)[0]).select("tool", "rule_id", "tp", "fp", "mean", "maturity"), "mean")


@query(f"WITH {TOOLS} SELECT x.tool, x.truth_id, CASE WHEN h.truth_id IS NULL THEN 'missed' ELSE 'matched' END AS state FROM x LEFT JOIN h USING (tool, truth_id)", findings="findings", truth="truth")
def a7_truth_states(findings, truth):
    return ops.truth_states(*decided(findings, truth))


@query(f"WITH {TOOLS}, w AS (SELECT truth_id, truth_id IN (SELECT truth_id FROM dd WHERE status = 'matched') AS detected FROM truth) SELECT truth_id, detected, cast(round_even((SELECT count(*) FILTER (detected) / count(*) * 100 FROM w), 0) AS int) AS rate FROM w", findings="findings", truth="truth")
def a28_detection_rate(findings, truth):
    return ops.detection_rate(decided(findings, truth)[0], truth)


@query(
    f"""WITH {TOOLS}, o AS (SELECT cast(sum(tp) AS bigint) AS tp, cast(sum(fp) AS bigint) AS fp, cast(sum(fn) AS bigint) AS fn, cast(sum(ambiguous) AS bigint) AS ambiguous, cast(sum(detected) AS bigint) AS detected FROM tools), m AS (SELECT *, round(tp / (tp + fp), 6) AS precision, detected / (detected + fn) AS recall FROM o)
    SELECT tp, fp, fn, ambiguous, detected, precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, round_even((tp + 1) / (tp + fp + 2), 6) AS mean, {MATURITY} FROM m""",
    findings="findings",
    truth="truth",
)
def a7_overall(findings, truth):
    return R6(ops.overall(tools(findings, truth)).select("tp", "fp", "fn", "ambiguous", "detected", "precision", "recall", "f1", "mean", "maturity"), "precision", "recall", "f1", "mean")


@query(f"WITH {TOOLS} SELECT tool, tp, fp, ambiguous, fn, detected, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM metrics", findings="findings", truth="truth")
def a7_evaluate_tools(findings, truth):
    return R6(tools(findings, truth), "precision", "recall", "f1")


@query(
    """WITH c AS (SELECT scanner, count(*) FILTER (status = 'open') AS tp, count(*) FILTER (status = 'resolved') AS fp, count(*) FILTER (status = 'suppressed') AS fn FROM findings GROUP BY 1), m AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c)
    SELECT scanner, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM m""",
    findings="findings",
)
def a5_classification(findings):
    counts = findings.groupBy("scanner").agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in (("tp", "open"), ("fp", "resolved"), ("fn", "suppressed"))])
    return R6(ops.classification(counts), "precision", "recall", "f1")


@query(
    """WITH f AS (SELECT scanner, CASE WHEN status = 'open' THEN 1 ELSE 0 END AS label, cast(start_line % 101 AS double) / 100.0 AS probability FROM findings), b AS (SELECT scanner, least(9, (SELECT count(*) FROM (VALUES (0.1), (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)) AS e(v) WHERE probability >= cast(v AS double))) AS bin, label, probability FROM f),
    g AS (SELECT scanner, bin, count(*) AS n, sum(label) AS h, sum(probability) AS p, sum(power(probability - label, 2)) AS s FROM b GROUP BY 1, 2), o AS (SELECT scanner, cast(sum(n) AS bigint) AS n, sum(s) / sum(n) AS brier, sum(abs(h - p)) / sum(n) AS e FROM g GROUP BY 1)
    SELECT scanner, n, round(brier, 6) AS brier, round(e, 6) AS calibration_error, CASE WHEN e <= 0.05 THEN 'good' WHEN e <= 0.15 THEN 'moderate' ELSE 'poor' END AS quality FROM o""",
    findings="findings",
)
def a6_calibration(findings):
    f = findings.select("scanner", F.when(F.col("status") == "open", 1).otherwise(0).alias("label"), ((F.col("start_line") % 101).cast("double") / 100.0).alias("probability"))
    return R6(ops.calibration(f, ("scanner",)), "brier", "calibration_error")


COUNTS = "SELECT scanner, rule_id, count(*) FILTER (WHERE status = 'open' AND row_id % 7 = 0) AS tp, count(*) FILTER (WHERE status = 'resolved' AND row_id % 11 = 0) AS fp FROM findings GROUP BY 1, 2"
# For whole a and b the incomplete beta is a binomial tail; thirty halvings settle six digits.
QUANTILES = f"""c AS ({COUNTS}), q AS (SELECT DISTINCT tp, fp FROM c), s(tp, fp, p, low, high, k) AS (SELECT tp, fp, p, cast(0 AS double), cast(1 AS double), 0 FROM q, (VALUES (0.025), (0.975)) AS v(p)
    UNION ALL SELECT tp, fp, p, CASE WHEN below THEN mid ELSE low END, CASE WHEN below THEN high ELSE mid END, k + 1 FROM (SELECT *, (low + high) / 2 AS mid, (SELECT sum(exp(lgamma(tp + fp + 2) - lgamma(i + 1) - lgamma(tp + fp + 2 - i) + i * ln((low + high) / 2) + (tp + fp + 1 - i) * ln(1 - (low + high) / 2))) FROM range(tp + 1, tp + fp + 2) AS r(i)) < p AS below FROM s WHERE k < 34)),
    b AS (SELECT tp, fp, max(CASE WHEN p < 0.5 THEN (low + high) / 2 END) AS lower, max(CASE WHEN p > 0.5 THEN (low + high) / 2 END) AS upper FROM s WHERE k = 34 GROUP BY 1, 2)"""


def posteriors(findings: DataFrame) -> DataFrame:
    counts = findings.sparkSession.sql(COUNTS.replace("FROM findings", "FROM {f}"), f=findings)
    return ops.posteriors(counts)


@query(
    f"""WITH RECURSIVE {QUANTILES} SELECT scanner, rule_id, tp, fp, round(lower, 4) AS lower, round(upper, 4) AS upper, round((tp + 1) / (tp + fp + 2), 4) AS mean, CASE WHEN tp + fp < 5 THEN 'Experimental' WHEN tp + fp < 30 THEN 'Directional' WHEN tp + fp < 100 THEN 'Moderate' ELSE 'Mature' END AS maturity,
    CASE WHEN tp + fp < 5 THEN 'Experimental' WHEN tp + fp < 30 THEN 'Directional' WHEN lower >= 0.7 THEN 'High' WHEN lower >= 0.3 THEN 'Likely' ELSE 'Noise' END AS tier FROM c JOIN b USING (tp, fp)""",
    findings="findings",
)
def a4_posteriors(findings):
    return posteriors(findings).withColumns({c: F.round(c, 4) for c in ("lower", "upper", "mean")})


RUNS = "SELECT concat('b', cast(event_id AS string)) AS run_id, sha256_of AS sha256, event_id AS recorded_at FROM (SELECT event_id, concat(cast(user_id AS string), ':', cast(event_id % 3 AS string)) AS sha256_of FROM scanner_runs)"


@query(f"WITH r AS ({RUNS}), k AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY recorded_at, run_id) AS n, count(*) OVER (PARTITION BY sha256) AS copies FROM r) SELECT run_id, sha256, recorded_at, copies FROM k WHERE n = 1", runs="scanner_runs")
def a8_independent_runs(runs):
    return ops.independent_runs(runs.sparkSession.sql(RUNS.replace("FROM scanner_runs", "FROM {r}"), r=runs))


@query(
    """WITH n AS (SELECT count(*) AS t, count(*) FILTER (first_label = second_label) AS g FROM reviews), a AS (SELECT first_label AS l, count(*) AS x FROM reviews GROUP BY 1), b AS (SELECT second_label AS l, count(*) AS y FROM reviews GROUP BY 1), c AS (SELECT sum(x * y) AS e FROM a JOIN b USING (l))
    SELECT t AS cases, g AS agreed, round(g / t, 6) AS agreement, round((g / t - e / (t * t)) / (1 - e / (t * t)), 6) AS kappa FROM n, c""",
    reviews="reviews",
)
def a9_reviewer_agreement(reviews):
    out = ops.reviewer_agreement(reviews.select("case_id", F.col("first_label").alias("first"), F.col("second_label").alias("second")))
    return R6(out, "agreement", "kappa")


@query(
    """SELECT case_id, CASE WHEN first_label = second_label THEN cast(first_label AS varchar) WHEN length(case_id) % 2 = 0 THEN '1' END AS label, greatest(length(case_id) % 3, first_label) AS uncertainty,
    CASE WHEN first_label = second_label THEN 'agreed' WHEN length(case_id) % 2 = 0 THEN 'adjudicated' ELSE 'disputed' END AS state FROM reviews""",
    reviews="reviews",
)
def a9_merged_labels(reviews):
    r = reviews.select("case_id", F.col("first_label").alias("first"), F.col("second_label").alias("second"), (F.length("case_id") % 3).cast("bigint").alias("first_uncertainty"), F.col("first_label").cast("bigint").alias("second_uncertainty"))
    out = ops.merge_labels(r, reviews.where("length(case_id) % 2 = 0").select("case_id", F.lit(1).alias("final")))
    return out.withColumn("label", F.col("label").cast("string"))


FEEDBACK = "SELECT scanner, rule_id, CASE row_id % 4 WHEN 0 THEN 'confirmed_true_positive' WHEN 1 THEN 'confirmed_false_positive' ELSE 'risk_accepted' END AS feedback_type FROM findings WHERE row_id % 37 < 8"
LOCAL = f"""fb AS ({FEEDBACK}), c AS (SELECT scanner, rule_id, count(*) FILTER (feedback_type = 'confirmed_true_positive') AS tp, count(*) FILTER (feedback_type = 'confirmed_false_positive') AS fp FROM fb GROUP BY 1, 2), l AS (SELECT *, (tp + 1) / (tp + fp + 2) AS local, tp + fp >= 5 AS sufficient FROM c WHERE tp + fp > 0)"""


def local(findings: DataFrame) -> DataFrame:
    return ops.rule_calibration(findings.sparkSession.sql(FEEDBACK.replace("FROM findings", "FROM {f}"), f=findings))


@query(f"WITH {LOCAL} SELECT scanner, rule_id, tp, fp, round(local, 6) AS local, sufficient FROM l", findings="findings")
def a10_rule_calibration(findings):
    return R6(local(findings), "local")


@query(
    f"""WITH {LOCAL}, g AS (SELECT scanner, rule_id, avg(confidence) AS g FROM findings GROUP BY 1, 2)
    SELECT scanner, rule_id, round(CASE WHEN sufficient THEN (1 - 0.3 * least(1, 5 / (tp + fp))) * local + 0.3 * least(1, 5 / (tp + fp)) * g ELSE g END, 6) AS merged, coalesce(sufficient AND abs(local - g) > 0.2, false) AS drifted FROM g LEFT JOIN l USING (scanner, rule_id)""",
    findings="findings",
)
def a11_merge_global(findings):
    estimates = findings.groupBy("scanner", "rule_id").agg(F.avg("confidence").alias("global"))
    return R6(ops.merge_global(local(findings), estimates).select("scanner", "rule_id", "merged", "drifted"), "merged")


METRICS = "SELECT scanner AS tool, run_year, avg(confidence) AS precision, count(*) FILTER (WHERE status = 'open') / count(*) AS recall, count(*) FILTER (WHERE severity = 'high') / count(*) AS f1, min(confidence) AS gating_estimate, cast(max(start_line) AS double) AS runtime_seconds, concat('v', cast(count(*) % 3 AS string)) AS scanner_version FROM findings WHERE run_year IN (1997, 1998) AND (scanner <> 'zap' OR run_year = 1997) GROUP BY 1, 2"


@query(
    f"""WITH m AS ({METRICS}), b AS (SELECT * FROM m WHERE run_year = 1997), a AS (SELECT * FROM m WHERE run_year = 1998), j AS (SELECT b.tool, a.tool AS later, b.precision - a.precision AS p, b.recall - a.recall AS r, b.f1 - a.f1 AS f, b.gating_estimate - a.gating_estimate AS g, a.runtime_seconds > 2 * b.runtime_seconds AS t, a.scanner_version <> b.scanner_version AS v FROM b LEFT JOIN a ON a.tool = b.tool)
    SELECT tool, 'missing' AS code FROM j WHERE later IS NULL UNION ALL SELECT tool, 'precision_drop' FROM j WHERE p > 0.001 UNION ALL SELECT tool, 'recall_drop' FROM j WHERE r > 0.001 UNION ALL SELECT tool, 'f1_drop' FROM j WHERE f > 0.001 UNION ALL SELECT tool, 'gating_estimate_drop' FROM j WHERE g > 0.001 UNION ALL SELECT tool, 'runtime' FROM j WHERE t UNION ALL SELECT tool, 'version' FROM j WHERE v""",
    findings="findings",
)
def j22_regressions(findings):
    m = findings.sparkSession.sql(METRICS.replace("FROM findings", "FROM {f}"), f=findings)
    return ops.regressions(m.where("run_year = 1997").drop("run_year"), m.where("run_year = 1998").drop("run_year"), drop=0.001)


KINDS = "SELECT cast(row_id AS string) AS finding_id, scanner, rule_id, reachability, CASE WHEN row_id % 3 = 0 THEN 0.8 END AS corroboration_bound, cast(row_id % 4 AS int) AS independent_sources, cast(row_id % 2 AS int) AS n_references, row_id FROM findings"


@query(findings="findings")
def p16_confidence_components(findings):
    f = findings.sparkSession.sql(KINDS.replace("FROM findings", "FROM {f}"), f=findings)
    kinds = F.array_compact(F.array(*[F.when(F.col("row_id") % n == 0, k) for n, k in ((2, "corroboration"), (5, "manual_validation"), (7, "exploit_validation"), (9, "known_exploited"))]))
    out = confidence.components(f.withColumn("evidence_kinds", kinds), posteriors(findings))
    return out.select("finding_id", *[F.col(f"{p}.{k}").alias(f"{p}_{k}") for p in ("validity", "reach", "exploit", "fix") for k in ("estimate", "bound")], "overall_estimate", "overall_bound", "overall_tier")


@query("SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 'Likely' WHEN row_id % 3 = 0 THEN 'Noise' WHEN confidence >= 0.7 THEN 'High' WHEN confidence >= 0.3 THEN 'Likely' ELSE 'Noise' END AS tier FROM findings", findings="findings")
def p17_tier_label(findings):
    return findings.select("row_id", confidence.tier_label(F.when(F.col("row_id") % 5 == 0, "Likely"), F.when(F.col("row_id") % 3 == 0, "Noise").otherwise(""), F.col("confidence")).alias("tier"))


@query("SELECT cast(row_id AS string) AS finding_id, 'High' AS tier, confidence FROM findings WHERE confidence >= 0.7", findings="findings")
def w5_act_first(findings):
    return confidence.act_first(findings.select(F.col("row_id").cast("string").alias("finding_id"), confidence.tier_label(F.lit(None).cast("string"), F.lit(""), F.col("confidence")).alias("tier"), "confidence"))
