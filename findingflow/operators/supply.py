"""Repositories, packages, corpora and compliance: inventories, ownership, pins, evidence. Pattern tables are small parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import glob_regex

# What file names and dependencies say about a repository.
LANGUAGES = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".go": "go", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".kt": "kotlin", ".kts": "kotlin",
    ".php": "php", ".py": "python", ".rb": "ruby", ".rs": "rust", ".swift": "swift", ".ts": "typescript", ".tsx": "typescript",
}
LOCKS = {
    "package-lock.json": "npm", "npm-shrinkwrap.json": "npm", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm", "poetry.lock": "poetry", "uv.lock": "uv", "Pipfile.lock": "pipenv",
    "go.sum": "go-modules", "Cargo.lock": "cargo", "Gemfile.lock": "bundler", "composer.lock": "composer", "packages.lock.json": "nuget",
}
MANAGERS = LOCKS | {
    "package.json": "npm", "pyproject.toml": "pip", "setup.py": "pip", "go.mod": "go-modules", "Cargo.toml": "cargo", "pom.xml": "maven", "build.gradle": "gradle",
    "build.gradle.kts": "gradle", "Gemfile": "bundler", "composer.json": "composer",
}
BUILDS = {
    "package.json": "npm", "pyproject.toml": "python", "setup.py": "python", "go.mod": "go", "Cargo.toml": "cargo", "pom.xml": "maven", "build.gradle": "gradle",
    "build.gradle.kts": "gradle", "Gemfile": "ruby", "composer.json": "php", "Makefile": "make", "CMakeLists.txt": "cmake", "WORKSPACE": "bazel", "WORKSPACE.bazel": "bazel", "MODULE.bazel": "bazel",
}
FRAMEWORKS = {
    "flask": "flask", "django": "django", "fastapi": "fastapi", "react": "react", "next": "nextjs", "express": "express", "@nestjs/core": "nestjs", "github.com/gin-gonic/gin": "gin",
    "github.com/labstack/echo": "echo", "github.com/gofiber/fiber": "fiber", "axum": "axum", "actix-web": "actix-web", "rocket": "rocket", "rails": "rails",
    "org.springframework.boot": "spring-boot", "laravel/framework": "laravel", "symfony/framework-bundle": "symfony", "vue": "vue", "@angular/core": "angular", "svelte": "svelte",
}
VENDORED = r"(^|/)(node_modules|vendor|\.venv|venv|site-packages)/"
IGNORED = r"(^|/)(\.git|\.hg|\.svn|\.tox)/"
GENERATED = r"(?i)(^|/)(build|dist|coverage|\.next|out|target|generated)/|\.min\.js$|\.min\.css$|\.map$|\.generated\.[^/]*$|_pb2\.py$|\.designer\.cs$"
TEST_FOLDERS = ("test", "tests", "spec", "specs", "__tests__")
COMPOSE = ("compose.yml", "compose.yaml", "docker-compose.yml", "docker-compose.yaml")
REQUIREMENTS = r"(?i)^requirements.*\.(txt|in)$"


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def base_name(path: str) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def language_of(path: str) -> Column:
    """Language by the suffix of the file's name; a name that is all suffix has none."""
    return lookup(LANGUAGES, F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def scannable(files: DataFrame) -> DataFrame:
    """Files outside vendored and version-control folders that are not generated."""
    return files.where(~F.rlike("path", F.lit(VENDORED)) & ~F.rlike("path", F.lit(IGNORED)) & ~F.rlike("path", F.lit(GENERATED)))


def inventory(files: DataFrame, dependencies: DataFrame, keys: tuple[str, ...] = ("repository",)) -> DataFrame:
    """Technologies per repository, or per package with ``keys`` (repository, root).

    ``files`` has path and text (null unless it is small and may describe infrastructure), ``dependencies`` name and
    scope. Languages, managers, build systems and frameworks are sorted and joined by commas. Vendored, ignored and
    generated files count as such only; lock files count even if generated.
    """
    name, end = F.element_at(F.split("path", "/"), -1), base_name("path")
    inside = ~F.rlike("path", F.lit(VENDORED)) & ~F.rlike("path", F.lit(IGNORED))
    generated = inside & F.rlike("path", F.lit(GENERATED))
    seen = inside & ~generated
    config, text = seen & end.rlike(r"\.(ya?ml|json)$"), F.coalesce("text", F.lit(""))
    python = F.rlike(name, F.lit(REQUIREMENTS))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    tests = F.filter(F.transform(folders, lambda part, i: F.when(F.lower(part).isin(*TEST_FOLDERS), F.array_join(F.slice(folders, F.lit(1), i + 1), "/"))), lambda t: t.isNotNull())
    joined = lambda sets: F.array_join(F.array_sort(F.array_distinct(F.flatten(sets))), ",")
    both = lambda *found: F.collect_set(F.when(seen, F.array_compact(F.array(*found))))
    made = files.groupBy(*keys).agg(
        F.count_if(seen).alias("files"),
        joined(both(language_of("path"), F.when(name == "package.json", "javascript"))).alias("languages"),
        joined(both(lookup(MANAGERS, name), F.when(python, "pip"))).alias("managers"),
        joined(both(lookup(BUILDS, name), F.when(python, "python"))).alias("build_systems"),
        F.count_if(inside & lookup(LOCKS, name).isNotNull()).alias("lock_files"),
        F.count_if(seen & (F.startswith(name, F.lit("Dockerfile")) | name.isin(*COMPOSE))).alias("container_files"),
        F.count_if(config & F.contains(text, F.lit("apiVersion:")) & text.rlike(r"(?m)^kind:\s*\S+")).alias("kubernetes_files"),
        F.count_if(seen & F.rlike("path", F.lit(r"\.tf(\.json)?$"))).alias("terraform_files"),
        F.count_if(config & (F.contains(text, F.lit("AWSTemplateFormatVersion")) | (F.contains(text, F.lit("Resources:")) & F.contains(text, F.lit("AWS::"))))).alias("cloudformation_files"),
        F.count_if(config & text.rlike(r'(?m)^\s*(openapi|swagger)\s*:|"(openapi|swagger)"\s*:')).alias("openapi_specifications"),
        joined(F.collect_set(F.when(seen, tests))).alias("test_directories"),
        F.count_if(generated).alias("generated_files"),
        F.count_if(F.rlike("path", F.lit(VENDORED))).alias("vendored_files"),
    )
    low = F.lower("name")
    framework = F.coalesce(lookup(FRAMEWORKS, low), F.array_max(F.array(*[F.when(F.startswith(low, F.lit(f"{d}/")) | F.startswith(low, F.lit(f"{d}:")), f) for d, f in FRAMEWORKS.items()])))
    used = dependencies.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(framework)), ",").alias("frameworks"), F.count_if(F.col("scope") == "runtime").alias("runtime_dependencies"), F.count_if(F.col("scope") == "development").alias("development_dependencies")
    )
    return made.join(used, list(keys), "left").fillna("", ["frameworks"]).fillna(0, ["runtime_dependencies", "development_dependencies"])


def dependencies_from_text(files: DataFrame) -> DataFrame:
    """(repository, path, name, constraint, scope) from package.json maps, requirements, go.mod and Gemfile lines and pom.xml blocks."""
    base = ["repository", "path"]
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    npm = files.where(base_name("path") == "package.json").select(*base, F.from_json("text", schema).alias("j"))
    maps = [npm.select(*base, F.explode(f"j.{c}").alias("name", "constraint"), F.lit(s).alias("scope")) for c, s in (("dependencies", "runtime"), ("devDependencies", "development"))]
    lines = files.select(*base, base_name("path").alias("_b"), F.explode(F.split("text", r"\r?\n")).alias("_l"))

    def by_line(name: str, pattern: str) -> DataFrame:
        got = lines.where(F.col("_b").rlike(name)).where(F.col("_l").rlike(pattern))
        return got.select(*base, F.regexp_extract("_l", pattern, 1).alias("name"), F.regexp_extract("_l", pattern, 2).alias("constraint"), F.when(F.col("path").rlike("dev|test"), "development").otherwise("runtime").alias("scope"))

    flat = [
        by_line(r"^requirements.*\.txt$", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*((?:[=<>!~]=?|===)[^#;]*)?"),
        by_line(r"^go\.mod$", r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+(v\S+)"),
        by_line(r"^gemfile$", r"""^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?"""),
    ]
    poms = files.where(base_name("path") == "pom.xml").select(*base, F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("_d"))
    tag = lambda t: F.regexp_extract("_d", rf"<{t}>\s*([^<]*?)\s*</{t}>", 1)
    maven = poms.select(*base, F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), tag("version").alias("constraint"), F.when(tag("scope") == "test", "development").otherwise("runtime").alias("scope"))
    out = maps[0]
    for more in (maps[1], *flat, maven):
        out = out.unionByName(more)
    return out.withColumn("constraint", F.trim("constraint"))


def package_owner(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Longest package root that contains each file: the file's own ancestors meet the roots by equality."""
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = files.select("repository", "path", F.explode(above).alias("root"))
    met = each.join(roots.select("repository", F.col("root")).distinct(), ["repository", "root"])
    return files.select("repository", "path").join(met.groupBy("repository", "path").agg(F.max_by("root", F.length("root")).alias("root")), ["repository", "path"], "left")


def scanner_plan(files: DataFrame, adapters: list[tuple[str, tuple[str, ...], tuple[str, ...], bool]]) -> DataFrame:
    """(repository, scanner, root, files): which scanners apply to which package, and to how many of its files.

    ``files`` has the package root of each path (``.``: the repository itself). An adapter (scanner, languages, globs,
    everywhere) applies to a package that holds a file of one of its languages, or one whose path inside the package or
    name matches a glob; one that applies everywhere has the repository's root as target, with all files.
    """
    inside = F.when(F.col("root") == ".", F.col("path")).otherwise(F.substring("path", F.length("root") + 2, F.length("path")))
    placed = scannable(files).select("repository", "root", inside.alias("path"), language_of("path").alias("language"))
    name = F.element_at(F.split("path", "/"), -1)

    def fits(languages: tuple[str, ...], globs: tuple[str, ...]) -> Column:
        found = F.coalesce(F.col("language").isin(*languages), F.lit(False))
        for glob in globs:
            found = found | F.rlike("path", F.lit(glob_regex(glob))) | F.rlike(name, F.lit(glob_regex(glob)))
        return found

    target = lambda scanner, root: F.struct(F.lit(scanner).alias("scanner"), root.alias("root"))
    each = [target(s, F.lit(".")) if everywhere else F.when(fits(languages, globs), target(s, F.col("root"))) for s, languages, globs, everywhere in adapters]
    return placed.select("repository", F.explode(F.array_compact(F.array(*each))).alias("t")).groupBy("repository", "t.scanner", "t.root").agg(F.count("*").alias("files"))


def unpinned(lines: DataFrame) -> DataFrame:
    """(path, line_number, code): requirements without ``==``, actions not at a commit, images not at a digest."""
    name, line = base_name("path"), F.trim("line")
    code = (
        F.when(name.rlike(r"^requirements.*\.txt$") & (line != "") & ~line.rlike(r"^(#|-)") & ~line.rlike(r"=="), "requirement")
        .when(F.col("path").rlike(r"\.ya?ml$") & line.rlike(r"uses:\s*\S+@") & ~line.rlike(r"uses:\s*\S+@[0-9a-f]{40}"), "action")
        .when((name == "dockerfile") & line.rlike(r"(?i)^from\s") & ~line.rlike(r"(?i)^from\s+(scratch|\S+@sha256:[0-9a-f]{64})"), "image")
    )
    return lines.select("path", "line_number", code.alias("code")).where("code is not null")


def changed_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.join(changed.select("repository", "path"), ["repository", "path"], "left_semi")


def changed_packages(packages: DataFrame, previous: DataFrame) -> DataFrame:
    """Packages whose checksum is new or differs."""
    was = previous.select("repository", "name", F.col("checksum").alias("_was"))
    return packages.join(was, ["repository", "name"], "left").where(~F.col("checksum").eqNullSafe(F.col("_was"))).drop("_was")


def corpus_check(cases: DataFrame, files: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(subject, code): values outside their domain, dimension values that no case covers, pairs that do not point back, files unreferenced or undeclared."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c).isin(*v), F.lit(False)), f"{c}:domain") for c, v in required.items()]))
    domain = cases.select(F.col("case_id").alias("subject"), F.explode(codes).alias("code"))
    spark = cases.sparkSession
    wanted = spark.createDataFrame([(f"{c}={v}",) for c, vs in required.items() for v in vs], "subject string")
    seen = cases.select(F.explode(F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit(""))) for c in required])).alias("subject")).distinct()
    coverage = wanted.join(seen, "subject", "left_anti").withColumn("code", F.lit("coverage"))
    other = cases.select(F.col("case_id").alias("_id"), F.col("paired_case_id").alias("_back"))
    pairs = cases.where("paired_case_id is not null").join(other, F.col("paired_case_id") == F.col("_id"), "left")
    pairing = pairs.where(~F.col("_back").eqNullSafe(F.col("case_id"))).select(F.col("case_id").alias("subject"), F.lit("pairing").alias("code"))
    used = cases.select(F.explode("files").alias("path")).distinct()
    unreferenced = files.select("path").join(used, "path", "left_anti").select(F.col("path").alias("subject"), F.lit("unreferenced").alias("code"))
    undeclared = used.join(files.select("path"), "path", "left_anti").select(F.col("path").alias("subject"), F.lit("undeclared").alias("code"))
    return domain.unionByName(coverage).unionByName(pairing).unionByName(unreferenced).unionByName(undeclared)


def leakage(development: DataFrame, blind: DataFrame, tuning: DataFrame, allowed: DataFrame) -> DataFrame:
    """(value, code): hashes or ids in both partitions, and tuning inputs that are not allowed."""
    shared = lambda c: development.select(c).intersect(blind.select(c)).select(F.col(c).cast("string").alias("value"), F.lit(f"shared {c}").alias("code"))
    return shared("hash").unionByName(shared("item_id")).unionByName(tuning.join(allowed, "name", "left_anti").select(F.col("name").alias("value"), F.lit("tuning input").alias("code")))


def compliance_evidence(findings: DataFrame, controls: DataFrame) -> DataFrame:
    """Findings per control evidence text that names their category or scanner. Findings are reduced to distinct pairs first; empty names match nothing."""
    pairs = findings.groupBy(F.lower("category").alias("category"), F.lower("scanner").alias("scanner")).agg(F.count("*").alias("n"))
    text = F.lower("evidence")
    named = lambda c: F.coalesce((F.col(c) != "") & F.contains(text, F.col(c)), F.lit(False))
    met = controls.join(pairs, named("category") | named("scanner"), "left")
    return met.groupBy("control_id", "evidence").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("status", F.when(F.col("n") > 0, "evidence_available").otherwise("no_evidence"))


def attach_guidance(findings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Guidance profiles of a finding's rule whose CWEs overlap its own."""
    return findings.join(profiles, "rule_id").where(F.arrays_overlap("cwe", "profile_cwe"))


def sbom(locked: DataFrame, direct: DataFrame, licences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, parent edges, gaps) per repository: locked packages with licence and whether direct; direct ones not locked and parents unknown are gaps."""
    key = ["repository", "name"]
    components = locked.join(direct.select(*key, F.lit(True).alias("direct")), key, "left").join(licences, key, "left")
    components = components.select(*key, "version", F.coalesce("direct", F.lit(False)).alias("direct"), F.coalesce("licence", F.lit("NOASSERTION")).alias("licence"))
    edges = locked.select("repository", F.explode("parents").alias("parent"), F.col("name").alias("child")).distinct()
    unlocked = direct.select(*key).distinct().join(locked, key, "left_anti").select(*key, F.lit("direct but not locked").alias("gap"))
    orphans = edges.select("repository", F.col("parent").alias("name")).distinct().join(locked, key, "left_anti").select(*key, F.lit("parent not locked").alias("gap"))
    return components, edges, unlocked.unionByName(orphans)


def verify_fix(before: DataFrame, after: DataFrame, targets: DataFrame, health: DataFrame) -> DataFrame:
    """Per repository: is the original fingerprint gone, is no new critical or high finding there, are required scanners healthy."""
    still = targets.join(after, ["repository", "fingerprint"], "left_semi").groupBy("repository").agg(F.count("*").alias("still"))
    new = after.join(before, ["repository", "fingerprint"], "left_anti").where(F.col("severity").isin("critical", "high")).groupBy("repository").agg(F.count("*").alias("new_serious"))
    sick = health.where("required and not healthy").groupBy("repository").agg(F.count("*").alias("unhealthy"))
    out = targets.select("repository").distinct()
    for part in (still, new, sick):
        out = out.join(part, "repository", "left")
    out = out.fillna(0, ["still", "new_serious", "unhealthy"])
    return out.withColumn("verified", (F.col("still") == 0) & (F.col("new_serious") == 0) & (F.col("unhealthy") == 0))
