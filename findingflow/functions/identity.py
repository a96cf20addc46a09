"""Identities: canonical JSON, digests, portable paths, fingerprints and stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """A string as JSON; null stays visible as ``null``. Only strings that need escapes go through a JSON writer."""
    whole = F.to_json(F.struct(value.alias("v")))
    escaped = F.substring(whole, F.lit(6), F.length(whole) - 6)
    return F.when(value.isNull(), "null").when(F.rlike(value, F.lit(r'["\\\x00-\x1f\x7f-\x9f\u2028\u2029]')), escaped).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


def json_list(values: Column) -> Column:
    """An array of strings as a JSON list."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, json_text), ","), F.lit("]"))


def json_object(fields: dict[str, Column]) -> Column:
    """An object with sorted keys whose values are JSON already."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def clean(value: Column) -> Column:
    """Trimmed text; empty for null."""
    return F.trim(F.coalesce(value, F.lit("")))


def identifiers(values: Column) -> Column:
    """Sorted distinct upper-case identifiers without blanks; empty for null."""
    upper = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.upper(F.trim(v)))
    return F.array_sort(F.array_distinct(F.filter(upper, lambda v: v.isNotNull() & (v != ""))))


def repository_path(path: Column) -> Column:
    """A portable relative path: forward slashes, no drive, ``.`` and ``..`` resolved where they can be; null and empty stay.

    Segments are folded from left to right; ``..`` removes the segment before it, is dropped at the root of an
    absolute path, and stays at the start of a relative one. Paths that are portable already are not taken apart.
    """
    slashed = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^[A-Za-z]:/", "/")
    absolute = F.startswith(slashed, F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s != "..", F.concat(done, F.array(s)))
        .when((F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != ".."), F.slice(done, 1, F.size(done) - 1))
        .when(absolute, done)
        .otherwise(F.concat(done, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    odd = F.rlike(path, F.lit(r"\\|//|/$|^[A-Za-z]:|(^|/)\.\.?(/|$)"))
    return F.when((path == "") | ~odd, path).when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def split_identifiers(values: Column) -> Column:
    """struct(cve, ghsa, osv): trimmed identifiers by namespace, distinct, in order."""
    given = F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))
    is_cve, is_ghsa = (lambda v: F.startswith(F.upper(v), F.lit("CVE-"))), (lambda v: F.startswith(F.upper(v), F.lit("GHSA-")))
    return F.struct(F.filter(given, is_cve).alias("cve"), F.filter(given, is_ghsa).alias("ghsa"), F.filter(given, lambda v: ~is_cve(v) & ~is_ghsa(v)).alias("osv"))


def cwe_list(text: Column) -> Column:
    """Every CWE in a text, ``CWE-n`` or a bare number, as sorted distinct ``CWE-n``."""
    named = F.regexp_extract_all(F.upper(text), F.lit(r"CWE[-_ :]?(\d+)"), 1)
    bare = F.regexp_extract_all(text, F.lit(r"^\s*(\d+)\s*$"), 1)
    numbers = F.transform(F.concat(named, bare), lambda n: F.concat(F.lit("CWE-"), n.cast("bigint").cast("string")))
    return F.coalesce(F.array_sort(F.array_distinct(numbers)), F.array().cast("array<string>"))


def ecosystem_alias(ecosystem: Column) -> Column:
    low = F.lower(clean(ecosystem))
    return F.when(low.isin("pip", "python"), "pypi").otherwise(low)


def fingerprint(category: Column, rule: Column, file: Column, symbol: Column, source: Column, sink: Column, cwe: Column, cve: Column, ghsa: Column, osv: Column, dep_name: Column, dep_ecosystem: Column) -> Column:
    """The line-independent identity of a finding: a dependency and its advisories where it has one, else a place in code."""
    ecosystem = ecosystem_alias(dep_ecosystem)
    name = F.lower(clean(dep_name))
    name = F.when(ecosystem == "pypi", F.regexp_replace(name, "[-_.]+", "-")).otherwise(name)
    known = [identifiers(c) for c in (cve, ghsa, osv)]
    advisories = F.when(F.size(known[0]) > 0, known[0]).when(F.size(known[1]) > 0, known[1]).when(F.size(known[2]) > 0, known[2]).otherwise(identifiers(F.array(rule)))
    dependency = json_object(
        {"kind": F.lit('"dependency"'), "category": F.lit('"sca"'), "component": json_object({"ecosystem": json_text(ecosystem), "name": json_text(name)}), "advisory_identifiers": json_list(advisories)}
    )
    kind = F.lower(F.trim(F.when(F.coalesce(category, F.lit("")) == "", "unknown").otherwise(category)))
    code = json_object(
        {
            "kind": json_text(kind),
            "rule_id": json_text(F.lower(clean(rule))),
            "file": json_text(repository_path(file)),
            "symbol": json_text(clean(symbol)),
            "source": json_text(clean(source)),
            "sink": json_text(clean(sink)),
            "cwe": json_list(identifiers(cwe)),
        }
    )
    identity = json_object({"algorithm": F.lit('"v2"'), "identity": F.when(dep_name.isNotNull(), dependency).otherwise(code)})
    return F.concat(F.lit("v2:sha256:"), F.sha2(identity, 256))


def finding_id(scanner: Column, rule: Column, print_: Column) -> Column:
    """The scanner's own id for a fingerprint."""
    who = F.lower(F.trim(F.when(F.coalesce(scanner, F.lit("")) == "", "unknown").otherwise(scanner)))
    text = json_object({"algorithm": F.lit('"v2"'), "scanner": json_text(who), "rule_id": json_text(F.lower(clean(rule))), "fingerprint": json_text(print_)})
    return F.concat(F.lit("finding-v2-"), F.substring(F.sha2(text, 256), 1, 24))


def region_hash(text: Column) -> Column:
    """Digest of code without blank lines, whole-line remarks and drift of white space; null if nothing is left."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    kept = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("//")))
    return F.when(F.size(kept) > 0, F.sha2(F.array_join(kept, "\n"), 256))


def short_key(*parts: Column) -> Column:
    """A deterministic key of 16 hexadecimal digits over parts joined by ``|``; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression: ``*`` also matches slashes; case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]")
            i = end
        else:
            out.append("\\" + c if c in r"\.^$+{}()|[]" else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_regex_column(pattern: Column) -> Column:
    """``glob_regex`` for patterns that are data: each piece (a bracket expression, or one character) is translated by itself."""
    pieces = F.regexp_extract_all(pattern, F.lit(r"(?s)\[.[^\]]*\]|."), F.lit(0))

    def translated(piece: Column) -> Column:
        held = F.replace(F.substring(piece, F.lit(2), F.length(piece) - 2), F.lit("\\"), F.lit("\\\\"))
        negated = F.when(F.startswith(held, F.lit("!")), F.concat(F.lit("^"), F.substring(held, F.lit(2), F.length(held)))).otherwise(held)
        quoted = F.when(F.rlike(piece, F.lit(r"^[\\.^$+{}()|\[\]]$")), F.concat(F.lit("\\"), piece)).otherwise(piece)
        return F.when(piece == "*", ".*").when(piece == "?", ".").when(F.length(piece) > 1, F.concat(F.lit("["), negated, F.lit("]"))).otherwise(quoted)

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(pieces, translated), ""), F.lit("$"))
