"""Project detection and the choice of modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = {
    "package.json": ("javascript", True, True), "package-lock.json": ("javascript", True, False), "yarn.lock": ("javascript", True, False),
    "requirements.txt": ("python", True, False), "Pipfile": ("python", True, False), "poetry.lock": ("python", True, False), "uv.lock": ("python", True, False), "pyproject.toml": ("python", True, True),
    "Cargo.toml": ("rust", True, True), "Cargo.lock": ("rust", True, False), "go.mod": ("go", True, True), "go.sum": ("go", True, False),
    "pom.xml": ("java", True, True), "build.gradle": ("java", True, True), "build.gradle.kts": ("java", True, True),
    "composer.json": ("php", True, True), "composer.lock": ("php", True, False),
    "Dockerfile": (None, False, True), "docker-compose.yml": (None, False, True), "docker-compose.yaml": (None, False, True),
}
EXTENSIONS = {"py": ["python"], "js": ["javascript"], "jsx": ["javascript"], "ts": ["typescript", "javascript"], "tsx": ["typescript", "javascript"], "rs": ["rust"], "go": ["go"], "java": ["java"], "php": ["php"]}
FRAMEWORKS = {"react": ("react", "react-dom"), "nextjs": ("next",), "vue": ("vue",), "nuxt": ("nuxt",), "angular": ("@angular/core",), "svelte": ("svelte", "@sveltejs/kit")}
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
SKIPPED = ("node_modules", "target", "vendor", "venv", "__pycache__")
SIZE_SKIPPED = (".git", "target", "node_modules", "vendor", ".venv", "venv", "dist", "build", "__pycache__")


def lang_detect(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with languages, frameworks, is_dependency_file and is_config_file; exact names first."""
    spark = files.sparkSession
    exact = spark.createDataFrame([(k, *v) for k, v in EXACT.items()], "name string, l string, dep boolean, conf boolean")
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_extract("n", "^.+\\.([^.]+)$", 1)
    none = F.array().cast("array<string>")
    by_ext = none
    for ext, langs in EXTENSIONS.items():
        by_ext = F.when(F.col("x") == ext, F.array(*map(F.lit, langs))).otherwise(by_ext)
    hit = F.col("name").isNotNull()
    joined = files.withColumn("n", name).withColumn("x", stem).join(F.broadcast(exact), F.col("n") == F.col("name"), "left")  # a fixed table of 20 names
    frameworks = (
        F.when(F.col("n").isin("Dockerfile", "docker-compose.yml", "docker-compose.yaml"), F.array(F.lit("docker")))
        .when(~hit & (F.col("x") == "py") & F.col("n").contains("manage.py"), F.array(F.lit("django")))
        .when(~hit & F.col("x").isin("js", "jsx") & F.col("n").contains("react"), F.array(F.lit("react")))
        .otherwise(none)
    )
    languages = F.when(hit, F.when(F.col("l").isNotNull(), F.array("l")).otherwise(none)).otherwise(by_ext)
    return joined.select(*files.columns, languages.alias("languages"), frameworks.alias("frameworks"), F.coalesce("dep", F.lit(False)).alias("is_dependency_file"), F.coalesce("conf", F.lit(False)).alias("is_config_file"))


def agg_project(detected: DataFrame, key: str = "project_id") -> DataFrame:
    """Sorted languages and frameworks, and the number of dependency and config files, of each project."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return detected.groupBy(key).agg(flat("languages").alias("languages"), flat("frameworks").alias("frameworks"), F.count_if("is_dependency_file").alias("n_dependency_files"), F.count_if("is_config_file").alias("n_config_files"))


def fw_from_package_json(text: Column) -> Column:
    """Frameworks that a package.json names in any dependency section, in fixed order; none if it is no JSON object."""
    framework_of = F.create_map(*[F.lit(x) for name, packages in FRAMEWORKS.items() for package in packages for x in (package, name)])

    def named(value: Column) -> Column:
        packages = F.flatten(F.array_compact(F.array(*[F.map_keys(F.try_variant_get(value, f"$.{s}", "map<string,variant>")) for s in SECTIONS])))
        return F.transform(packages, lambda p: F.try_element_at(framework_of, p))

    # An array of one element, so that a text is parsed once and not for each section and package.
    found = F.flatten(F.transform(F.array(F.try_parse_json(text)), named))
    return F.array_intersect(F.array(*map(F.lit, FRAMEWORKS)), found)


def module_select(projects: DataFrame, entitled: tuple[str, ...]) -> DataFrame:
    """``projects`` (languages, frameworks, depth) with the ordered ``modules`` that apply and are entitled to."""
    source = F.size("languages") > 0
    any_of = lambda *names: F.arrays_overlap("frameworks", F.array(*map(F.lit, names)))
    full = F.col("depth") == "Full"
    table = [
        ("DependencyAnalyzer", F.lit(True)),
        ("SAST", source & F.col("depth").isin("Full", "FastScan")),
        ("SecretDetection", full),
        ("ApiSecurity", full & (source | any_of("django", "fastapi", "spring"))),
        ("LicenseCompliance", full),
        ("SBOM", full),
        ("IaC", full & any_of("terraform", "docker", "kubernetes")),
    ]
    return projects.withColumn("modules", F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in table if m in entitled])))


def module_available(wanted: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, missing) rows of (job, module_type)."""
    return wanted.join(registry, "module_type", "left_semi"), wanted.join(registry, "module_type", "left_anti")


def join_registry(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """``results`` (job_id, module_type, error) and a failed row for each wanted module without one."""
    missing = wanted.join(results, ["job_id", "module_type"], "left_anti").withColumn("error", F.concat(F.lit("no result: "), F.col("module_type")))
    return results.select("job_id", "module_type", "error").unionByName(missing.select("job_id", "module_type", "error"))
