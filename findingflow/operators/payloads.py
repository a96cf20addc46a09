"""What other systems are sent about findings: one scan gives every target's payload in its own shape, as canonical JSON."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from .export import CEF

Config = Mapping[str, str | None]
FIELDS = "finding_id fingerprint severity scanner rule_id description file_path line category".split()


def _given(config: Config, name: str, default: str | None = None) -> Column:
    return F.lit(config.get(name, default)).cast("string")


def _field(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _severity(upper: bool = False) -> Column:
    return F.upper(_field("severity", "info")) if upper else _field("severity", "info")


def ticket(**more: Column) -> dict[str, Column]:
    labels = F.array(F.concat(F.lit("security:"), _severity()), F.concat(F.lit("scanner:"), _field("scanner", "unknown")))
    return {"description": _field("description"), "file_path": F.col("file_path"), "line": F.col("line"), "labels": labels, **more}


def linear(config: Config) -> dict[str, Column]:
    return ticket(team_id=_given(config, "team_id"), project_id=_given(config, "project_id"))


def jira(config: Config) -> dict[str, Column]:
    return ticket(project_key=_given(config, "project_key"), issue_type=_given(config, "issue_type", "Bug"))


def slack(config: Config) -> dict[str, Column]:
    text = F.concat(F.lit(":warning: *"), _severity(True), F.lit("* finding in `"), _field("scanner", "?"), F.lit("`: "), _field("rule_id", "?"))
    return {"channel": _given(config, "channel"), "text": text}


def microsoft_teams(config: Config) -> dict[str, Column]:
    card = F.concat(F.lit("**"), _severity(True), F.lit("** from "), _field("scanner", "unknown"))
    return {"webhook_url": _given(config, "webhook_url"), "card_title": F.concat(F.lit("Security Finding: "), _field("rule_id", "?")), "card_text": card}


def email(config: Config) -> dict[str, Column]:
    subject = F.concat(F.lit(f"[{config.get('sender', 'Findings')}] "), _severity(True), F.lit(" finding: "), _field("rule_id", "?"))
    return {"to": _given(config, "to"), "subject": subject}


def webhook(config: Config) -> dict[str, Column]:
    finding = F.struct(*[F.col(c) for c in ("finding_id", "fingerprint", "severity", "scanner", "rule_id", "file_path", "line")])
    return {"webhook_url": _given(config, "url"), "payload": F.struct(F.lit("finding.created").alias("event"), finding.alias("finding"))}


def siem(config: Config) -> dict[str, Column]:
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CEF.items() for x in pair]), _severity()), F.lit(0))
    return {
        "event_type": F.lit("security_finding"), "siem_format": _given(config, "format", "json"), "cef_severity": rank, "src_scanner": F.col("scanner"), "src_file": F.col("file_path"), "src_line": F.col("line"),
        "category": _field("category", "application-security"),
    }


#: Kinds of targets; a kind of your own is a function from its configuration to the columns it adds.
KINDS: dict[str, Callable[[Config], dict[str, Column]]] = {"linear": linear, "jira": jira, "slack": slack, "microsoft_teams": microsoft_teams, "email": email, "webhook": webhook, "siem": siem}


def payloads(findings: DataFrame, targets: Mapping[str, Config], kinds: Mapping[str, Callable[[Config], dict[str, Column]]] = KINDS) -> DataFrame:
    """A row for each finding and target: target, finding_id and payload.

    ``findings`` has the columns of ``FIELDS``; ``targets`` the configuration of each kind. A payload says who is told
    what (integration_type, schema_version, finding_id, title, severity, scanner, rule_id) and what its kind adds;
    fields without a value are null. The findings are read once, whatever the number of targets.
    """
    title = F.concat(F.lit("["), _severity(True), F.lit("] "), _field("scanner"), F.lit(": "), _field("rule_id", "unknown"))
    made = []
    for target, config in targets.items():
        common = {
            "integration_type": F.lit(target), "schema_version": F.lit("1.0.0"), "finding_id": F.coalesce("finding_id", "fingerprint"), "title": title, "severity": _severity(), "scanner": _field("scanner", "unknown"), "rule_id": F.col("rule_id"),
        }
        fields = F.struct(*[c.alias(n) for n, c in {**common, **kinds[target](config)}.items()])
        shape = findings.select(fields.alias("x")).schema["x"].dataType
        made.append(F.struct(F.lit(target).alias("target"), canonical_json(fields, shape, ascii_only=False).alias("payload")))
    each = findings.select(F.coalesce("finding_id", "fingerprint").alias("finding_id"), F.explode(F.array(*made)).alias("x"))
    return each.select("x.target", "finding_id", "x.payload")


def write_payloads(rows: DataFrame, path: str) -> None:
    """One folder of JSON lines for each target, as its sender reads them."""
    rows.select("target", "payload").write.mode("overwrite").partitionBy("target").text(path)
