"""What a .NET tree is made of (AGG-14): projects, their style, and what tools can do with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIR = r"[^/]*\z"


def project_files(files: DataFrame) -> DataFrame:
    """One row for each project file of ``(project, path, text)``, with its flags."""
    f = files.where("path IS NOT NULL").select(F.coalesce("project", F.lit("")).alias("project"), F.translate("path", "\\", "/").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    folder = F.regexp_replace("path", _DIR, "")
    beside = f.where(F.lower(F.regexp_extract("path", r"([^/]*)\z", 1)).isin("packages.config", "packages.lock.json")).groupBy("project", folder.alias("folder")).agg(
        F.bool_or(F.lower("path").endswith("packages.config")).alias("packages_config"), F.bool_or(F.lower("path").endswith("packages.lock.json")).alias("lock_file")
    )
    p = f.where(F.col("path").rlike(r"(?i)\.(csproj|vbproj|fsproj)\z")).withColumn("folder", folder).join(beside, ["project", "folder"], "left")
    text, name = F.col("text"), F.regexp_extract("path", r"([^/]*)\.[^./]*\z", 1)
    tfm = F.trim(F.coalesce(_some(F.regexp_extract(text, "(?i)<TargetFrameworks?>([^<]+)<", 1)), _some(F.regexp_extract(text, "(?i)<TargetFrameworkVersion>([^<]+)<", 1)), F.lit("")))
    return p.select(
        "project", "path", name.alias("name"), text.rlike(r"<Project\s+[^>]*Sdk\s*=").alias("sdk_style"), F.coalesce(_some(tfm), F.lit("unknown")).alias("target_framework"),
        text.rlike(r"(?i)Microsoft\.WebApplication\.targets|<UseIISExpress>|Microsoft\.NET\.Sdk\.Web").alias("is_web"), (text.rlike(r"(?i)<IsTestProject>\s*true|Microsoft\.NET\.Test\.Sdk|xunit|nunit|MSTest") | name.rlike(r"(?i)\.tests?\z")).alias("is_test"),
        F.coalesce("packages_config", F.lit(False)).alias("packages_config"), text.rlike(r"<PackageReference\b").alias("package_reference"), F.coalesce("lock_file", F.lit(False)).alias("lock_file"),
        text.rlike(r"(?i)<EnableNETAnalyzers>\s*true|<AnalysisMode>|<CodeAnalysisRuleSet>").alias("analyzers"), text.rlike(r"(?i)<TreatWarningsAsErrors>\s*true").alias("warnings_as_errors"), text.rlike(r"(?i)<NuGetAudit>\s*true").alias("nuget_audit"),
    )


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def discover(files: DataFrame) -> DataFrame:
    """One row a project tree: its stack, counts, flags and what is supported."""
    p = project_files(files)
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    web = ~F.col("sdk_style") & F.col("is_web")
    g = p.groupBy("project").agg(
        F.count("*").alias("projects"), F.count_if("is_test").alias("test_projects"), F.bool_and("sdk_style").alias("all_sdk"), F.bool_or("sdk_style").alias("any_sdk"), has(F.col("packages_config")).alias("any_packages_config"),
        has(~F.col("sdk_style")).alias("any_non_sdk"), has(web).alias("any_web_non_sdk"), has(F.col("lock_file")).alias("has_lock_file"), has(F.col("analyzers")).alias("analyzers"),
    )
    base = F.lower(F.regexp_extract(F.translate("path", "\\", "/"), r"([^/]*)\z", 1))
    tree = files.where("path IS NOT NULL").groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(
        F.count_if(base.endswith(".sln")).alias("solutions"), F.count_if(base.rlike(r"^(web|app)\.(\w+\.)?config\z|^appsettings(\.\w+)?\.json\z")).alias("config_files"), F.bool_or(base.isin("directory.build.props", ".editorconfig")).alias("root_rules"), F.bool_or(base == "dockerfile").alias("has_docker"),
        F.bool_or(F.col("path").rlike(r"(?i)(^|/)(\.github/workflows/[^/]+\.ya?ml|azure-pipelines\.ya?ml|\.gitlab-ci\.yml|jenkinsfile)\z")).alias("has_ci"),
    )
    t = tree.join(g, "project", "left").na.fill(0, ["projects", "test_projects"]).na.fill(False, ["any_packages_config", "any_non_sdk", "any_web_non_sdk", "has_lock_file", "analyzers"])
    stack = F.when(F.col("projects") == 0, "unknown").when(F.col("all_sdk"), "core").when(F.col("any_sdk"), "mixed").otherwise("framework")
    return t.select(
        "project", stack.alias("stack"), "solutions", "projects", "test_projects", "config_files", "any_packages_config", "any_non_sdk", "any_web_non_sdk", "has_lock_file", (F.col("test_projects") > 0).alias("has_tests"), "has_docker", "has_ci",
        (~F.col("any_packages_config") & ~F.col("any_web_non_sdk")).alias("can_list_packages"), (~F.col("any_web_non_sdk")).alias("can_build"), (F.col("test_projects") > 0).alias("can_test"), (F.col("analyzers") | F.col("root_rules")).alias("analyses_at_build"),
    )


def discovery_findings(discovered: DataFrame) -> DataFrame:
    """``(project, rule, severity, title)``: what a project's make-up rules out or leaves open."""
    rules = F.array(
        *[
            F.when(cond, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(t).alias("title")))
            for cond, r, s, t in (
                (~F.col("has_tests") & (F.col("projects") > 0), "discover-no-tests", "MEDIUM", "No test project"), (~F.col("has_lock_file") & (F.col("projects") > 0), "discover-no-lockfile", "MEDIUM", "Restores cannot be repeated"), (~F.col("analyses_at_build") & (F.col("projects") > 0), "discover-no-analyzers", "LOW", "Analysers are off"),
                (F.col("any_packages_config"), "discover-packages-config", "LOW", "Packages listed in the old form"), (F.col("any_web_non_sdk"), "discover-legacy-web", "LOW", "Web project of the old style"), (~F.col("has_ci") & (F.col("projects") > 0), "discover-no-ci", "LOW", "No build pipeline in the tree"),
            )
        ]
    )
    return discovered.select("project", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("r")).select("project", "r.*")
