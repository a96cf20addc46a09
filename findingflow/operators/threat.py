"""Advisories and reachability evidence on findings. Feeds are first reduced to one row per advisory id, so a popular advisory is no skewed key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .policy import FINDING, RUN

FRESH = ("fresh-cache", "refreshed")


def reduce_records(records: DataFrame) -> DataFrame:
    """One row per advisory id: greatest CVSS and EPSS, whether any record is known exploited, sources seen, any stale."""
    return records.groupBy("advisory_id").agg(
        F.max("cvss_score").alias("cvss_score"), F.max("epss").alias("epss"), F.max(F.coalesce("kev", F.lit(False))).alias("kev"), F.collect_set("source").alias("sources"), F.max(F.coalesce("stale", F.lit(False))).alias("stale")
    )


def enrich(findings: DataFrame, records: DataFrame, kev_checked: bool) -> DataFrame:
    """(finding_id, cvss_score, epss, kev_status, sources, stale) for findings with identifiers.

    ``kev_status`` is true with any exploited record, false only if the exploited list was freshly checked, else null.
    Distinct identifier sets are enriched once and joined back.
    """
    sets = findings.select("finding_id", F.array_sort(F.array_distinct("advisories")).alias("ids")).where(F.size("ids") > 0)
    each = sets.select("ids").distinct().select("ids", F.explode("ids").alias("advisory_id"))
    merged = each.join(reduce_records(records), "advisory_id", "left").groupBy("ids").agg(
        F.max("cvss_score").alias("cvss_score"),
        F.max("epss").alias("epss"),
        F.when(F.max(F.coalesce("kev", F.lit(False))), True).when(F.lit(kev_checked), False).alias("kev_status"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sources", F.array().cast("array<string>")))))), ",").alias("sources"),
        F.coalesce(F.max("stale"), F.lit(False)).alias("stale"),
    )
    return sets.join(merged, "ids").drop("ids")


def first_by(value: Column, *order: Column) -> Column:
    """The value that comes first in ``order``, of rows whose value is not null."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])))


def best_fields() -> list[Column]:
    """One aggregation that keeps, per field, the best record's value and its source: the greatest scores (then the least source), the earliest exploitation, all fixes and ids, the first publication and the last change.

    It reads structs cvss, epss and kev, so what it gives can be aggregated by it again.
    """
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))))
    return [
        first_by(F.col("cvss"), -F.col("cvss.score"), F.col("cvss.source"), F.col("cvss.vector")).alias("cvss"),
        first_by(F.col("epss"), -F.col("epss.probability"), F.col("epss.source"), F.col("epss.percentile")).alias("epss"),
        first_by(F.col("kev"), F.col("kev.date").isNull(), F.col("kev.date"), F.col("kev.source"), F.col("kev.ransomware")).alias("kev"),
        every(F.col("advisory_ids")).alias("advisory_ids"), every(F.col("fixed_versions")).alias("fixed_versions"), every(F.col("record_sources")).alias("record_sources"),
        F.min("published").alias("published"), F.max("modified").alias("modified"), F.max("stamped").alias("stamped"),
    ]


def enrich_fields(findings: DataFrame, records: DataFrame, statuses: DataFrame, keys: tuple[str, ...] = FINDING) -> DataFrame:
    """What all feeds say of each finding with identifiers, field by field, each with the source it comes from.

    ``findings`` has keys and advisories; ``records`` the shape of ``sources.feeds``; ``statuses`` what was asked for a
    finding: keys, source, status, fetched_at, stale and failure. kev_status is true if any record is on the list of
    exploited ones, false only if that list was freshly checked for this finding, else null. Records are reduced per
    advisory, then per distinct set of identifiers, so neither a popular advisory nor a repeated finding is joined twice.
    """
    some = lambda condition, *fields: F.when(condition, F.struct(*fields))
    source = F.col("source").alias("source")
    given = records.select(
        F.explode(F.array_distinct("advisory_ids")).alias("advisory_id"), "advisory_ids", "fixed_versions", F.array("source").alias("record_sources"), "published", "modified", F.col("data_source_timestamp").alias("stamped"),
        some(F.col("cvss_score").isNotNull(), F.col("cvss_score").alias("score"), F.col("cvss_vector").alias("vector"), source).alias("cvss"),
        some(F.col("epss").isNotNull(), F.col("epss").alias("probability"), F.col("epss_percentile").alias("percentile"), source).alias("epss"),
        some(F.coalesce("kev", F.lit(False)), F.col("known_exploitation_date").alias("date"), F.col("ransomware_association").alias("ransomware"), source).alias("kev"),
    )
    reduced = given.groupBy("advisory_id").agg(*best_fields())
    sets = findings.select(*keys, F.array_sort(F.array_distinct(F.array_compact("advisories"))).alias("ids")).where(F.size("ids") > 0)
    each = sets.select("ids").distinct().select("ids", F.explode("ids").alias("advisory_id"))
    merged = each.join(reduced, "advisory_id", "left").groupBy("ids").agg(*best_fields())
    fresh = (F.col("source") == "cisa-kev") & F.col("status").isin(*FRESH)
    asked = statuses.groupBy(*keys).agg(
        F.coalesce(F.max(fresh), F.lit(False)).alias("kev_checked"), F.coalesce(F.max("stale"), F.lit(False)).alias("stale"), F.max("fetched_at").alias("fetched_at"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set(F.when(F.col("failure").isNotNull(), F.struct("source", "failure")))).alias("failures"),
    )
    joined = sets.join(merged, "ids").join(asked, list(keys), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *keys, F.array_sort(F.array_union("ids", F.coalesce("advisory_ids", none))).alias("advisory_ids"),
        F.col("cvss.score").alias("cvss_score"), F.col("cvss.vector").alias("cvss_vector"), F.col("cvss.source").alias("cvss_source"), F.col("epss.probability").alias("epss_probability"), F.col("epss.percentile").alias("epss_percentile"), F.col("epss.source").alias("epss_source"),
        F.when(F.col("kev").isNotNull(), True).when(F.coalesce("kev_checked", F.lit(False)), False).alias("kev_status"), F.col("kev.date").alias("known_exploitation_date"), F.col("kev.ransomware").alias("ransomware_association"),
        "fixed_versions", F.col("published").alias("published_date"), F.col("modified").alias("modified_date"), F.greatest("stamped", "fetched_at").alias("data_source_timestamp"), F.coalesce("stale", F.lit(False)).alias("stale"),
        "record_sources", F.coalesce("sources", none).alias("sources"), F.coalesce("failures", F.array().cast("array<struct<source:string,failure:string>>")).alias("failures"),
    )


def cache_status(keys: DataFrame, cache: DataFrame, now: float) -> DataFrame:
    """fresh, stale (at or past expiry), miss or not-applicable per key and source; nvd is skipped once a CVSS score is known."""
    joined = keys.join(cache, ["source", "key"], "left")
    status = F.when((F.col("source") == "nvd") & F.col("cvss_known"), "not-applicable").when(F.col("expires_at").isNull(), "cache-miss").when(F.lit(now) >= F.col("expires_at"), "stale-cache").otherwise("fresh-cache")
    return joined.select("source", "key", "cvss_known", status.alias("status"))


def threat_data_status(enriched: DataFrame) -> DataFrame:
    """Per run: enriched and stale findings, failed sources, and stale, degraded, unavailable or fresh in that order."""
    out = enriched.groupBy("run_id").agg(F.count("*").alias("enriched"), F.count_if("stale").alias("stale_findings"), F.sum("failures").alias("failed_sources"), F.every(~F.col("any_usable")).alias("unusable"))
    status = F.when(F.col("stale_findings") > 0, "stale").when(F.col("failed_sources") > 0, "degraded").when(F.col("unusable"), "unavailable").otherwise("fresh")
    return out.select("run_id", "enriched", "stale_findings", "failed_sources", status.alias("status"))


def reachability_summary(findings: DataFrame) -> DataFrame:
    """Per run: dependency and source findings analysed, paths found, unsupported, incomplete, confirmed reachable and dynamically confirmed.

    ``findings`` has the analyses as structs, null where there is none: dependency_reachability (status,
    analysis_incomplete), source_to_sink (support, status, analysis_incomplete) and dynamic_correlation (status).
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    dependency, source, dynamic = (F.col(c) for c in ("dependency_reachability", "source_to_sink", "dynamic_correlation"))
    supported = yes(source["support"] != "unsupported")
    return findings.groupBy("run_id").agg(
        F.count_if(dependency.isNotNull()).alias("dependency_findings_analyzed"),
        F.count_if(supported).alias("source_findings_analyzed"),
        F.count_if(yes(source["status"] == "path-found")).alias("source_paths_found"),
        F.count_if(yes(source["support"] == "unsupported")).alias("unsupported_findings"),
        (F.count_if(yes(dependency["analysis_incomplete"])) + F.count_if(yes(source["analysis_incomplete"]))).alias("incomplete_findings"),
        F.count_if(yes(dependency["status"] == "CONFIRMED_REACHABLE")).alias("confirmed_reachable"),
        F.count_if(yes(dynamic["status"] == "confirmed")).alias("dynamically_confirmed"),
    )


# What a runtime attempt came to, strongest first.
OUTCOMES = ("confirmed", "blocked-authentication", "failed-reproduction", "inconclusive", "not-attempted")
GRAM = 3


def normal_endpoint(value: Column) -> Column:
    """The path of an endpoint between slashes: scheme, host, query and fragment are dropped; a value without a path counts as its own."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?", "")
    return F.concat(F.lit("/"), F.trim(F.when(bare == "", F.trim(value)).otherwise(bare), F.lit("/")))


def grams(text: Column, size: int) -> Column:
    """Hashes of all pieces of ``size`` characters."""
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.lit(size), F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))


def containing_keys(text: Column) -> Column:
    """Keys of a text that may contain another: it has ``contained_key`` of whatever it contains."""
    return F.array_distinct(F.concat(F.array(F.xxhash64(F.lit(0), F.lit(""))), *[grams(text, n) for n in range(1, GRAM + 1)]))


def contained_key(text: Column) -> Column:
    """One key of a text that may be contained in another: its least piece of up to three characters."""
    short = F.when(F.length(text) < GRAM, F.xxhash64(F.length(text), text))
    return F.coalesce(short, F.array_min(grams(text, GRAM)))


def last_name(symbol: Column) -> Column:
    """What follows the last dot, in lower case."""
    return F.element_at(F.split(F.lower(symbol), r"\."), -1)


def contained_in(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(text, part) of distinct ``texts.text`` and ``parts.part`` where the first contains the second, met by a piece of it."""
    offered = texts.select("text").distinct().withColumn("piece", F.explode(containing_keys(F.col("text"))))
    asked = parts.select("part").distinct().withColumn("piece", contained_key(F.col("part")))
    return offered.join(asked, "piece").where(F.contains("text", F.col("part"))).select("text", "part")


def match_observations(findings: DataFrame, observations: DataFrame, keys: tuple[str, ...] = FINDING, scope: tuple[str, ...] = ("repository",)) -> DataFrame:
    """What runtime observations of its repository say of each finding: one row per finding that any matches.

    An observation matches by a common endpoint and, besides, by a parameter that a source of the finding contains or a
    sink with the same last name. ``findings`` has arrays endpoints, sources and sinks; ``observations`` the columns of
    ``scope``, observation_id, endpoint, parameter, sink, outcome and authentication_state. The status is that of the
    strongest outcome, then of the least id; a failed attempt never makes a match weaker. Findings of one scope with
    the same endpoints, sources and sinks are matched once. Which distinct source contains which distinct parameter is
    found first; both sides then meet in an equi-join on scope, endpoint and the parameter or the sink's last name,
    never on the endpoint alone.
    """
    lower = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda s: s.isNotNull()), F.lower)))
    routes = F.array_sort(F.array_distinct(F.transform(F.filter("endpoints", lambda e: e.isNotNull()), normal_endpoint)))
    alike = [*scope, "routes", "sources", "sinks"]
    f = findings.select(*keys, routes.alias("routes"), lower(F.col("sources")).alias("sources"), lower(F.col("sinks")).alias("sinks")).where(F.size("routes") > 0)
    kinds = f.select(*alike).distinct()
    parameter, sink = F.lower(F.coalesce("parameter", F.lit(""))), F.lower(F.coalesce("sink", F.lit("")))
    state = F.coalesce(F.nullif("authentication_state", F.lit("")), F.lit("unknown"))
    o = observations.where(F.col("outcome").isin(*OUTCOMES)).select(*scope, normal_endpoint(F.coalesce("endpoint", F.lit(""))).alias("at"), "observation_id", "outcome", state.alias("state"), parameter.alias("parameter"), sink.alias("sink"))
    pairs = contained_in(kinds.select(F.explode("sources").alias("text")), o.where("parameter <> ''").select(F.col("parameter").alias("part")))
    named = kinds.select(*alike, F.explode("sources").alias("text")).join(pairs, "text").select(*alike, F.lit("parameter").alias("how"), F.col("part").alias("value"))
    ending = kinds.select(*alike, F.lit("sink").alias("how"), F.explode(F.array_distinct(F.transform("sinks", last_name))).alias("value"))
    offered = named.distinct().unionByName(ending).withColumn("at", F.explode("routes"))
    given = F.array_compact(F.array(F.when(F.col("parameter") != "", F.struct(F.lit("parameter").alias("how"), F.col("parameter").alias("value"))), F.when(F.col("sink") != "", F.struct(F.lit("sink").alias("how"), last_name(F.col("sink")).alias("value")))))
    judged = offered.join(o.withColumn("x", F.explode(given)).select(*scope, "at", "observation_id", "outcome", "state", "x.how", "x.value"), [*scope, "at", "how", "value"])
    place = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    failed = F.collect_set(F.when(F.col("outcome") == "failed-reproduction", F.col("observation_id")))
    found = judged.groupBy(*alike).agg(  # a pair that meets twice changes none of these
        F.min_by(F.struct("outcome", "state", "observation_id"), F.struct(place, "observation_id")).alias("x"), F.array_sort(F.collect_set("observation_id")).alias("matched_observation_ids"),
        F.max(F.col("how") == "parameter").alias("parameter_matched"), F.max(F.col("how") == "sink").alias("sink_matched"), F.array_sort(failed).alias("failed_attempts"),
    )
    priority = F.when(F.col("x.outcome") == "confirmed", "increased").otherwise("unchanged")
    return f.join(found, alike).select(*keys, F.col("x.observation_id").alias("observation_id"), F.col("x.outcome").alias("status"), F.col("x.state").alias("authentication_state"), "matched_observation_ids", "parameter_matched", "sink_matched", "failed_attempts", priority.alias("priority_adjustment"))


def first_on_lines(ranges: DataFrame, lines: DataFrame, keys: tuple[str, ...], at: list[str]) -> DataFrame:
    """keys, file and rank: the least rank of ``lines`` (at, sink_line, rank) between start and end of ``ranges``, where there is one.

    A range of more than one line crosses the middle of exactly one cell of 2, 4, 8 ... lines in which it begins left
    and ends right: what it holds is the left half from its start and the right half up to its end. So a line has a
    place in one half per width, a range in two, and a running minimum towards the outside, or the inside, gives both.
    """
    extent = lines.groupBy(*at).agg(F.min("sink_line").alias("low"), F.max("sink_line").alias("high"))
    bit = lambda value: F.when(value > 0, F.length(F.bin(value)) - 1).otherwise(0)
    half = lambda line, level: F.expr(f"shiftright({line}, {level})")
    place = F.when(F.col("half") % 2 == 1, F.col("line")).otherwise(-F.col("line"))
    offset = {"line": F.col("sink_line") - F.col("low"), "level": F.explode(F.sequence(F.lit(0), bit(F.col("high") - F.col("low"))))}
    given = lines.join(extent, at).withColumns(offset).select(*at, "level", half("line", "level").alias("half"), "line", "rank", F.lit(None).cast(ranges.select(F.struct(*keys).alias("k")).schema["k"].dataType).alias("who"))
    inside = ranges.where("start <= end").join(extent, at).select(*keys, "file", (F.greatest("start", "low") - F.col("low")).alias("start"), (F.least("end", "high") - F.col("low")).alias("end")).where("start <= end")  # no line lies beyond
    asked = inside.withColumn("level", bit(F.col("start").bitwiseXOR(F.col("end")))).withColumn("line", F.explode(F.array_distinct(F.array("start", "end"))))
    asked = asked.select(*at, "level", half("line", "level").alias("half"), "line", F.lit(None).cast("bigint").alias("rank"), F.struct(*keys).alias("who"))
    outwards = Window.partitionBy(*at, "level", "half").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = given.unionByName(asked).withColumn("place", place).withColumn("rank", F.min("rank").over(outwards)).where("who is not null and rank is not null")
    return found.select("who.*", "file", "rank")


def attach_flows(findings: DataFrame, flows: DataFrame, keys: tuple[str, ...] = FINDING, scope: tuple[str, ...] = RUN) -> DataFrame:
    """keys, flow_id and how: the flow path of the finding's run whose sink lies on its lines; else one that agrees with its symbols. Of several the most confident, then the least id.

    Symbols agree if those that the finding has do: its sink is the path's or has the same last name, and of the two
    sources one contains the other. Paths of a file are ranked, and only the first of each line, and of each pair of
    symbols, is looked at. The first on a range of lines is found by running minima (``first_on_lines``), not by
    pairs; symbols meet by the sink's last name or, without a sink, by a piece of the shorter source. No join of paths
    and findings is on the file alone; what meets is numbers, of which the least is kept.
    """
    at = [*scope, "file"]
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    f = findings.select(*keys, "file", F.col("start_line").cast("bigint").alias("start"), F.coalesce("end_line", "start_line").cast("bigint").alias("end"), F.trim(low("source")).alias("source"), F.trim(low("sink")).alias("sink"))
    f = durable(f)  # both sides are read several times
    confidence = F.coalesce("path_confidence", F.lit(0.0))
    ranked = flows.select(*scope, F.col("sink_file").alias("file"), "flow_id", F.col("sink_line").cast("bigint").alias("sink_line"), low("source_symbol").alias("path_source"), low("sink_symbol").alias("path_sink"), confidence.alias("confidence"))
    p = durable(ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy(-F.col("confidence"), "flow_id")).cast("bigint")))
    first = F.min("rank").alias("rank")
    by_line = first_on_lines(f, p.where("sink_line is not null").groupBy(*at, "sink_line").agg(first), keys, at).select(*keys, "file", F.lit(0).cast("bigint").alias("how"), "rank")
    either = F.contains("path_source", F.col("source")) | F.contains("source", F.col("path_source"))
    ends = p.groupBy(*at, "path_source", last_name(F.col("path_sink")).alias("name")).agg(first)
    begins = ends.groupBy(*at, "path_source").agg(first)
    named = f.where("sink <> ''").withColumn("name", last_name(F.col("sink"))).join(ends, [*at, "name"]).where((F.col("source") == "") | either)
    sourced = f.where("sink = '' and source <> ''")
    inner = sourced.withColumn("key", contained_key(F.col("source"))).join(begins.withColumn("key", F.explode(containing_keys(F.col("path_source")))), [*at, "key"])
    outer = sourced.withColumn("key", F.explode(containing_keys(F.col("source")))).join(begins.withColumn("key", contained_key(F.col("path_source"))), [*at, "key"])
    every = by_line
    for alike in (named, inner.where(either), outer.where(either)):
        every = every.unionByName(alike.select(*keys, "file", F.lit(1).cast("bigint").alias("how"), "rank"))
    best = every.groupBy(*keys, "file").agg(F.min(F.shiftleft("how", 62) + F.col("rank")).alias("x"))
    chosen = best.withColumns({"how": F.shiftright("x", 62), "rank": F.col("x").bitwiseAND(F.lit((1 << 62) - 1))}).join(p.select(*at, "rank", "flow_id", "confidence"), [*at, "rank"])
    order = F.struct("how", -F.col("confidence"), "flow_id")
    return chosen.groupBy(*keys).agg(F.min_by(F.struct("flow_id", F.when(F.col("how") == 0, "line").otherwise("symbols").alias("how")), order).alias("x")).select(*keys, "x.flow_id", "x.how")


# What each status of a dependency's analysis says of the finding.
REACHES = {"CONFIRMED_REACHABLE": "reachable", "LIKELY_REACHABLE": "potentially_reachable"}


def dependency_reachability(findings: DataFrame, evidence: DataFrame, scans: DataFrame, scope: tuple[str, ...] = RUN) -> DataFrame:
    """``findings`` with what local evidence says of their dependency: dep_status, dep_reachability, dep_relationship, dep_in_scope, dep_deployed, dep_called, dep_installed and dep_incomplete.

    ``findings`` has dep_name, dep_version, dep_direct (null: not known) and dependency_scope; ``evidence`` one or more
    rows per package: declared, scope (runtime or not), locked, imported, called, deployed and known_symbols (whether it
    is known what is vulnerable in it); ``scans`` per run how many files did not parse and whether there is an inventory
    of what is deployed. A call counts as confirmed only if nothing is missing from the analysis. Without evidence of a
    path nothing is called unreachable: all other states leave reachability unknown.
    """
    name = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[-_.]+", "-")
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    e = evidence.groupBy(*scope, name(F.col("package")).alias("_name")).agg(
        *[some(c).alias(f"_{c}") for c in ("declared", "locked", "imported", "called", "deployed", "known_symbols")], some(F.col("declared") & (F.col("scope") == "runtime")).alias("_runtime")
    )
    s = scans.groupBy(*scope).agg(F.sum(F.coalesce("parse_failures", F.lit(0))).alias("_failures"), some("has_inventory").alias("_inventory"))
    joined = findings.withColumn("_name", name(F.col("dep_name"))).join(e, [*scope, "_name"], "left").join(s, list(scope), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    relationship = F.when(F.col("dep_direct").isNotNull(), F.when(F.col("dep_direct"), "direct").otherwise("transitive")).when(yes("_declared"), "direct").when(yes("_locked"), "transitive").otherwise("unknown")
    given = F.coalesce(F.nullif("dependency_scope", F.lit("")), F.lit("unknown"))
    in_scope = F.when((given == "unknown") & yes("_declared"), F.when(yes("_runtime"), "runtime").otherwise("development")).otherwise(given)
    known = joined.withColumns({
        "dep_relationship": relationship, "dep_in_scope": in_scope, "dep_deployed": F.when(yes("_inventory"), yes("_deployed")), "dep_called": F.when(yes("_known_symbols"), yes("_called")),
        "dep_installed": yes("_declared") | yes("_locked") | (F.coalesce("dep_version", F.lit("")) != ""),
    })
    missing = (F.col("dep_relationship") == "unknown") | (F.col("dep_in_scope") == "unknown") | F.col("dep_deployed").isNull() | F.col("dep_called").isNull() | (F.coalesce("_failures", F.lit(0)) > 0)
    status = (
        F.when(F.coalesce("dep_name", F.lit("")) == "", "NOT_ANALYSED").when(~F.col("dep_installed"), "NO_PATH_FOUND").when(yes("dep_called") & ~F.col("dep_incomplete"), "CONFIRMED_REACHABLE")
        .when(F.col("dep_incomplete"), "ANALYSIS_INCOMPLETE").when(yes("_imported"), "LIKELY_REACHABLE").otherwise("NO_PATH_FOUND")
    )
    reach = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in REACHES.items() for x in pair]), F.col("dep_status")), F.lit("unknown"))
    judged = known.withColumn("dep_incomplete", missing).withColumn("dep_status", status).withColumn("dep_reachability", reach)
    return judged.drop("_name", "_failures", "_inventory", "_runtime", *[f"_{c}" for c in ("declared", "locked", "imported", "called", "deployed", "known_symbols")])
