"""Redaction of secrets in texts and in JSON documents of any shape."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a secret looks like, and what stands in its place.
PATTERNS = (
    (r"""(?im)\b([A-Z0-9_]*(?:API[_-]?KEY|PASSWORD|PASSWD|SECRET|TOKEN|PRIVATE[_-]?KEY)[A-Z0-9_]*\s*[:=]\s*)(["'])[^"'\r\n]+\2""", r"$1$2[REDACTED]$2"),
    (r"(?i)\b(Bearer\s+)[A-Za-z0-9._~+/=-]{8,}", r"$1[REDACTED]"),
    (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[REDACTED]"),
    (r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[REDACTED]"),
)
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "credential", "private_key")


def redact_text(text: Column) -> Column:
    """struct(text, n_redacted): each pattern is counted on the text that the one before it left."""
    count, value = F.lit(0), text
    for pattern, instead in PATTERNS:
        count = count + F.coalesce(F.regexp_count(value, F.lit(pattern)), F.lit(0))
        value = F.regexp_replace(value, pattern, instead)
    return F.struct(value.alias("text"), count.cast("bigint").alias("n_redacted"))


def hide(value: object) -> object:
    """A JSON value with everything under a sensitive key replaced, at any depth."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if any(s in k.lower().replace("-", "_") for s in SENSITIVE) else hide(v) for k, v in value.items()}
    return [hide(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def redact_json(documents: pd.Series) -> pd.Series:
    """JSON texts with sensitive values replaced; texts that are not JSON, and nulls, become null."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(hide(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return documents.map(one)
