"""State histories, suppressions, tickets and feedback. Windows partition by finding; nothing is gathered per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import glob_regex_column

# The states of a finding, and those that need an approval.
FINDING_STATES = ("open", "acknowledged", "suppressed", "resolved", "false_positive", "accepted_risk")
APPROVAL_REQUIRED = ("suppressed", "accepted_risk", "false_positive")


FINDING = ("repository", "fingerprint")


def codes(*pairs: tuple[str, Column]) -> Column:
    """The codes whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for code, c in pairs]))


def audit_history(history: DataFrame, status: DataFrame, keys: tuple[str, ...] = FINDING) -> DataFrame:
    """(keys, sequence, code) of every breach of the rules of a state history, read by sequence, then time and state. ``status`` has each finding's current state."""
    w = Window.partitionBy(*keys).orderBy("sequence", "changed_at", "to_state")
    before = lambda c: F.lag(c).over(w)
    checked = history.withColumns({"_n": F.row_number().over(w), "_to": before("to_state"), "_at": before("changed_at"), "_last": F.lead("sequence").over(w).isNull()})
    joined = checked.join(status, list(keys), "left")
    found = codes(
        ("sequence", F.col("sequence") != F.col("_n")),
        ("transition", F.col("_to").isNotNull() & ~F.col("from_state").eqNullSafe(F.col("_to"))),
        ("chronology", F.col("changed_at") < F.col("_at")),
        ("approval", F.col("to_state").isin(*APPROVAL_REQUIRED) & F.col("approved_at").isNull()),
        ("approval_late", F.col("approved_at") > F.col("changed_at")),
        ("open_expires", (F.col("to_state") == "open") & F.col("expires_at").isNotNull()),
        ("expiry", F.col("expires_at") <= F.col("changed_at")),
        ("status", F.col("_last") & ~F.col("status").eqNullSafe(F.col("to_state"))),
    )
    return joined.select(*keys, "sequence", F.explode(found).alias("code"))


def lint_suppressions(suppressions: DataFrame, now: float, window: float = 7 * 86400.0) -> DataFrame:
    """Issue per suppression: invalid, permanent, expired (at or before now) or expiring within the window."""
    at = F.col("expires_at")
    issue = (
        F.when(~F.coalesce("valid", F.lit(False)), "INVALID_SUPPRESSION").when(at.isNull(), "PERMANENT_SUPPRESSION").when(at <= now, "SUPPRESSION_EXPIRED").when(at <= now + window, "SUPPRESSION_EXPIRING")
    )
    level = F.when(F.col("issue").isin("PERMANENT_SUPPRESSION", "SUPPRESSION_EXPIRING"), "warning").otherwise("error")
    return suppressions.select("suppression_id", issue.alias("issue")).where("issue is not null").withColumn("level", level)


def match_suppressions(findings: DataFrame, suppressions: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(matches, rejects with a reason) of findings and suppressions with the same repository and fingerprint.

    Empty scopes match everything; branches and paths are shell patterns. A match needs the risk context unchanged
    and created_at <= now < expires_at (null: permanent). Patterns are tried once for each distinct kind of finding
    and kind of suppression that meet; pairs are only spelled out, by equi-joins on these kinds.
    """
    any_glob = lambda patterns, value: (F.size(patterns) == 0) | F.coalesce(F.exists(patterns, lambda p: F.rlike(value, glob_regex_column(p))), F.lit(False))
    kind_f = F.struct("repository", "fingerprint", "ref", "file", "environment", "context")
    kind_s = F.struct("repository", "fingerprint", "branches", "paths", "environments", "recorded_context", (F.col("created_at") > now).alias("late"), (F.col("expires_at") <= now).alias("over"))
    f, s = findings.withColumn("_f", kind_f), suppressions.withColumn("_s", kind_s)
    met = f.select("_f", "_f.*").distinct().join(s.select("_s", "_s.*").distinct(), ["repository", "fingerprint"])
    reason = (
        F.when(~any_glob("branches", F.col("ref")), "branch")
        .when(~any_glob("paths", F.col("file")), "path")
        .when((F.size("environments") > 0) & ~F.coalesce(F.array_contains("environments", F.col("environment")), F.lit(False)), "environment")
        .when(~F.col("context").eqNullSafe(F.col("recorded_context")), "context_changed")
        .when(F.col("late"), "not_created")
        .when(F.col("over"), "expired")
    )
    judged = met.select("_f", "_s", reason.alias("_why"))
    own = [c for c in findings.columns if c not in FINDING]
    columns = [c for c in (*FINDING, *own, *[c for c in suppressions.columns if c not in FINDING]) if c != "reason"]
    spelled = lambda some: f.join(some, "_f").join(s.drop(*FINDING), "_s")
    return spelled(judged.where("_why is null")).select(columns), spelled(judged.where("_why is not null")).select(*columns, F.col("_why").alias("reason"))


REVALIDATED = ("code_region_hash", "reachability", "kev_status", "exploit_evidence_digest", "policy_digest")


def revalidate(findings: DataFrame, suppressions: DataFrame, now: float) -> DataFrame:
    """Suppressions (by fingerprint) with the reasons to reopen: expired, or any recorded risk fact changed (``was_<fact>``)."""
    met = suppressions.join(findings, ["repository", "fingerprint"])
    reasons = codes(("expired", F.col("expires_at") <= now), *[(f, ~F.col(f).eqNullSafe(F.col(f"was_{f}"))) for f in REVALIDATED])
    out = met.select("suppression_id", "repository", "fingerprint", reasons.alias("reasons"))
    return out.select("suppression_id", "repository", "fingerprint", F.array_join("reasons", ",").alias("reasons"), F.when(F.size("reasons") > 0, "open").otherwise("suppressed").alias("status"))


def append_transitions(history: DataFrame, requests: DataFrame, keys: tuple[str, ...] = FINDING) -> tuple[DataFrame, DataFrame]:
    """(new history rows, rejects with a reason). Sequences go on from each finding's last; several requests of one finding follow by time.

    A rejected request changes nothing. All reasons but "already in this state" depend on the request alone, and after
    a request that is sound by itself the finding is in its state whether it was just put there or was there before.
    So the state before each request is the target of the last sound one: a running window, not a fold.
    """
    last = history.groupBy(*keys).agg(F.max("sequence").alias("last"), F.max_by("to_state", "sequence").alias("state"))
    w = Window.partitionBy(*keys).orderBy("changed_at", "request_id")
    known, to = F.col("to_state").isin(*FINDING_STATES), F.col("to_state")
    unsound = (
        F.when(to.isin(*APPROVAL_REQUIRED) & F.col("approved_at").isNull(), "approval required")
        .when((to == "suppressed") & F.col("expires_at").isNull() & ~F.coalesce("allow_permanent", F.lit(False)), "permanent not authorised")
        .when((to == "open") & F.col("expires_at").isNotNull(), "open cannot expire")
        .when(F.col("expires_at") <= F.col("changed_at"), "expiry not after transition")
        .when(F.col("approved_at") > F.col("changed_at"), "approval after transition")
    )
    checked = requests.withColumn("known", F.coalesce(known, F.lit(False))).withColumn("unsound", unsound)
    sound = F.when(F.col("known") & F.col("unsound").isNull(), to)
    before = F.last(sound, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = checked.join(last, list(keys), "left").withColumn("from_state", F.coalesce(before, "state", F.lit("open")))
    reason = F.when(~F.col("known"), "unsupported state").when(F.col("from_state") == to, "already in this state").otherwise(F.col("unsound"))
    judged = placed.withColumn("reason", reason)
    ok = judged.where("reason is null").withColumn("sequence", F.coalesce("last", F.lit(0)) + F.row_number().over(w))
    return ok.select(*keys, "sequence", "from_state", "to_state", "changed_at", "expires_at"), judged.where("reason is not null").select(*keys, "request_id", "reason")


def reopen_expired(history: DataFrame, now: float, keys: tuple[str, ...] = FINDING) -> DataFrame:
    """A new row back to open for every finding whose latest state has expired at or before now."""
    latest = history.groupBy(*keys).agg(F.max("sequence").alias("sequence"), F.max_by(F.struct("to_state", "expires_at"), "sequence").alias("x"))
    due = latest.where((F.col("x.to_state") != "open") & (F.col("x.expires_at") <= now))
    return due.select(*keys, (F.col("sequence") + 1).alias("sequence"), F.col("x.to_state").alias("from_state"), F.lit("open").alias("to_state"))


def append_once(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``stored`` and those of ``incoming`` whose key is new, the first by ``order`` of each."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return stored.unionByName(first.join(stored.select(key), key, "left_anti").select(stored.columns))


def close_by_tickets(events: DataFrame) -> DataFrame:
    """Finding status by its ticket's latest event: only validated closes change it (wont_fix: suppressed, else resolved)."""
    last = events.groupBy("ticket_key").agg(F.max_by(F.struct("state", "resolution", "validated", "fingerprint"), F.struct("changed_at", "event_id")).alias("x"))
    closed = (F.col("x.state") == "closed") & F.coalesce(F.col("x.validated"), F.lit(False))
    status = F.when(closed & (F.col("x.resolution") == "wont_fix"), "suppressed").when(closed, "resolved").otherwise("open")
    return last.select("ticket_key", F.col("x.fingerprint").alias("fingerprint"), status.alias("status"))
