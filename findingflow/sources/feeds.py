"""Advisory feeds in one record shape: who says what of which advisories, with scores, vectors, exploitation, fixes and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "source string, advisory_ids array<string>, cvss_score double, cvss_version string, cvss_vector string, epss double, epss_percentile double, kev boolean, known_exploitation_date string, ransomware_association string,"
    " fixed_versions array<string>, published string, modified string, data_source_timestamp string"
)


def records(df: DataFrame, source: str, **fields: Column) -> DataFrame:
    """Any DataFrame as records; fields not given are null."""
    types = dict(part.strip().split(" ", 1) for part in RECORD.split(","))
    given = {"source": F.lit(source), **fields}
    return df.select(*[(given[c] if c in given else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """One document per line. Fixed versions come from all nested ranges, distinct and sorted."""
    schema = "id string, aliases array<string>, published string, modified string, severity array<struct<type:string,score:string>>, affected array<struct<ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>"
    d = spark.read.schema(schema).json(path).where("id is not null")
    events = F.flatten(F.flatten(F.transform("affected", lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    fixed = F.array_sort(F.array_distinct(F.array_compact(F.transform(events, lambda e: e["fixed"]))))
    ids = F.array_distinct(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return records(d, "osv", advisory_ids=ids, cvss_vector=F.get("severity", F.lit(0))["score"], fixed_versions=fixed, published=F.col("published"), modified=F.col("modified"), data_source_timestamp=F.col("modified"))


def read_github(spark: SparkSession, path: str) -> DataFrame:
    schema = "ghsa_id string, cve_id string, published_at string, updated_at string, cvss struct<score:double,vector_string:string>, vulnerabilities array<struct<first_patched_version:string>>"
    d = spark.read.schema(schema).json(path).where("ghsa_id is not null")
    fixed = F.array_sort(F.array_distinct(F.array_compact(F.transform("vulnerabilities", lambda v: v["first_patched_version"]))))
    return records(d, "github-advisories", advisory_ids=F.array_compact(F.array("ghsa_id", "cve_id")), cvss_score=F.col("cvss.score"), cvss_vector=F.col("cvss.vector_string"), fixed_versions=fixed, published=F.col("published_at"), modified=F.col("updated_at"), data_source_timestamp=F.col("updated_at"))


def read_nvd(spark: SparkSession, path: str) -> DataFrame:
    """One response per file. The newest CVSS version that is there counts: 4, 3.1, 3.0, then 2."""
    metric = "array<struct<cvssData:struct<baseScore:double,vectorString:string>>>"
    versions = {"4.0": "cvssMetricV40", "3.1": "cvssMetricV31", "3.0": "cvssMetricV30", "2.0": "cvssMetricV2"}
    metrics = ",".join(f"{m}:{metric}" for m in versions.values())
    d = spark.read.schema(f"timestamp string, vulnerabilities array<struct<cve:struct<id:string,published:string,lastModified:string,metrics:struct<{metrics}>>>>").option("multiLine", True).json(path)
    cve = d.select("timestamp", F.explode("vulnerabilities").alias("v")).select("timestamp", "v.cve.*")
    data = lambda m: F.get(F.col(f"metrics.{m}"), F.lit(0))["cvssData"]
    score = lambda m: data(m)["baseScore"]
    best = F.coalesce(*[score(m) for m in versions.values()])
    version = F.coalesce(*[F.when(score(m).isNotNull(), v) for v, m in versions.items()])
    vector = F.coalesce(*[F.when(score(m).isNotNull(), data(m)["vectorString"]) for m in versions.values()])
    return records(cve, "nvd", advisory_ids=F.array("id"), cvss_score=best, cvss_version=version, cvss_vector=vector, data_source_timestamp=F.col("timestamp"), published=F.col("published"), modified=F.col("lastModified"))


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("cve string, epss string, percentile string, date string").json(path).where("cve is not null")
    score = lambda c: F.col(c).try_cast("double")
    return records(d, "epss", advisory_ids=F.array("cve"), epss=score("epss"), epss_percentile=score("percentile"), data_source_timestamp=F.concat("date", F.lit("T00:00:00+00:00")))


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("dateReleased string, vulnerabilities array<struct<cveID:string,dateAdded:string,knownRansomwareCampaignUse:string>>").option("multiLine", True).json(path)
    listed = d.select("dateReleased", F.explode("vulnerabilities").alias("v"))
    used = F.when(F.lower(F.trim("v.knownRansomwareCampaignUse")) == "known", "known").otherwise("unknown")
    return records(listed, "cisa-kev", advisory_ids=F.array("v.cveID"), kev=F.lit(True), known_exploitation_date=F.col("v.dateAdded"), ransomware_association=used, published=F.col("v.dateAdded"), data_source_timestamp=F.col("dateReleased"))
