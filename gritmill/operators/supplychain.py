"""Supply-chain checks over NuGet items (SC-01 to SC-16): joins, anti-joins and roll-ups within a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritmill.operators.baseline import first_by_key
from gritmill.session import materialise
from gritmill.sources.nuget import nuget_inventory

FOUND = ["project", "rule", "severity", "confidence", "path", "line", "snippet"]
LIST_MOST, HOOK_MOST, NAME_MOST = 12, 8, 20
#: Package ids whose near-misses are suspicious.
WELL_KNOWN = (
    "Newtonsoft.Json", "EntityFramework", "Microsoft.EntityFrameworkCore", "Dapper", "AutoMapper", "Serilog",
    "NLog", "log4net", "Moq", "xunit", "NUnit", "MSTest.TestFramework", "FluentAssertions", "RestSharp",
    "HtmlAgilityPack", "MediatR", "FluentValidation", "Polly", "StackExchange.Redis", "RabbitMQ.Client",
    "protobuf-net", "CsvHelper", "EPPlus", "MailKit", "MimeKit", "Autofac", "Ninject", "Hangfire", "Quartz",
    "Castle.Core", "NSubstitute", "Shouldly", "Bogus", "Swashbuckle.AspNetCore", "Microsoft.Extensions.Logging",
    "Microsoft.Extensions.DependencyInjection", "Microsoft.Extensions.Configuration",
    "Microsoft.Extensions.Hosting", "Microsoft.AspNetCore.Mvc", "Microsoft.Data.SqlClient", "System.Data.SqlClient",
    "Npgsql", "MySql.Data", "Microsoft.Owin", "Owin", "Microsoft.AspNet.WebApi.Client", "Microsoft.AspNet.Mvc",
    "jQuery", "bootstrap", "Microsoft.IdentityModel.Tokens", "System.IdentityModel.Tokens.Jwt", "IdentityServer4",
    "Grpc.AspNetCore", "Microsoft.AspNetCore.SignalR", "WindowsAzure.Storage", "Azure.Storage.Blobs", "AWSSDK.Core",
    "SixLabors.ImageSharp", "SkiaSharp", "iTextSharp", "PdfSharp", "NodaTime", "Humanizer", "Refit", "Mapster",
    "Microsoft.EntityFrameworkCore.SqlServer", "Microsoft.AspNetCore.Authentication.JwtBearer",
    "Microsoft.NET.Test.Sdk", "Coverlet.Collector", "StyleCop.Analyzers", "SonarAnalyzer.CSharp",
)


def _row(df: DataFrame, rule: str, severity: Column | str, confidence: Column | str, path: str = "path", line: Column | str = "line", snippet: Column | str = "snippet") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select("project", F.lit(rule).alias("rule"), lit(severity).alias("severity"), lit(confidence).alias("confidence"), F.col(path).alias("path"), col(line).cast("int").alias("line"), col(snippet).alias("snippet"))


def folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*\z", ""), r"/\z", "")


def _list(order: Column, text: Column, most: int = LIST_MOST) -> Column:
    """The first `most` texts in order, and how many more there are."""
    every = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"])
    n = F.size(every)
    return F.concat(F.array_join(F.slice(every, 1, most), "\n"), F.when(n > most, F.concat(F.lit("\n... and "), (n - most).cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def enabled_feeds(inv: dict[str, DataFrame]) -> DataFrame:
    """SC-01: feeds that their own file neither removes nor disables, names compared without case."""
    off = inv["removed"].unionByName(inv["disabled"]).select("project", "path", F.lower("name").alias("n")).distinct()
    f = inv["feed"].withColumn("n", F.lower("name"))
    return f.join(off, ["project", "path", "n"], "left_anti")


def feed_picture(inv: dict[str, DataFrame]) -> DataFrame:
    """SC-02: for each project whether a public feed is listed or inherited, and how many private feeds there are."""
    feeds = enabled_feeds(inv).groupBy("project").agg(F.bool_or("public").alias("explicit_public"), F.count_distinct(F.when(~F.col("public"), F.lower(F.concat_ws("|", "name", "host")))).alias("private_feeds"))
    gone = inv["removed"].unionByName(inv["disabled"]).where(F.lower("name").contains("nuget.org")).select("project").distinct().withColumn("taken_off", F.lit(True))
    clear = inv["clear"].select("project").distinct().withColumn("cleared", F.lit(True))
    p = feeds.join(gone, "project", "left").join(clear, "project", "left").na.fill(False, ["taken_off", "cleared"])
    inherited = ~F.col("explicit_public") & ~F.col("cleared") & ~F.col("taken_off")
    return p.select("project", "explicit_public", inherited.alias("inherited_public"), (F.col("explicit_public") | inherited).alias("public_enabled"), "private_feeds")


def glob(pattern: Column) -> Column:
    """A mapping pattern as an anchored regular expression without case."""
    return F.concat(F.lit(r"(?i)^"), F.replace(F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit(r"\z"))


def covered(packages: DataFrame, mapping: DataFrame) -> DataFrame:
    """SC-03: packages ``(project, name)`` that a mapping pattern of their project matches. The match is a residual of the join on the project."""
    m = mapping.where("value IS NOT NULL").select("project", glob(F.col("value")).alias("re")).distinct()
    return packages.join(m, "project").where(F.expr("name RLIKE re")).select("project", F.lower("name").alias("id")).distinct()


def declared_packages(inv: dict[str, DataFrame]) -> DataFrame:
    """SC-04: each id once: its first Include reference by path and line, else its first packages.config entry."""
    refs = inv["reference"].where("value = 'Include'").withColumn("src", F.lit(0))
    every = refs.unionByName(inv["config_package"].withColumn("src", F.lit(1))).where("name <> ''").withColumn("id", F.lower("name"))
    return first_by_key(every, [F.col("project"), F.col("id")], [F.col("src"), F.col("path"), F.col("no")])


def dependency_confusion(inv: dict[str, DataFrame]) -> DataFrame:
    """SC-05: packages that a private and the public feed could both supply and no mapping pins."""
    pic = feed_picture(inv).where("public_enabled AND private_feeds > 0")
    mapped = inv["mapping"].select("project").distinct().withColumn("mapped", F.lit(True))
    p = declared_packages(inv).join(pic, "project").join(mapped, "project", "left")
    p = p.join(covered(declared_packages(inv), inv["mapping"]), ["project", "id"], "left_anti")
    return _row(p, "nuget-dependency-confusion", F.when(F.col("mapped"), "MEDIUM").otherwise("HIGH"), F.when(F.col("explicit_public"), "CONFIRMED").otherwise("LIKELY"))


def central_versions(inv: dict[str, DataFrame]) -> DataFrame:
    first = first_by_key(inv["central_version"].withColumn("id", F.lower("name")), [F.col("project"), F.col("id")], [F.col("path"), F.col("no")])
    return first.select("project", "id", F.col("text").alias("central"))


def pinning(inv: dict[str, DataFrame]) -> DataFrame:
    """SC-06 and SC-07: references, central versions and packages.config entries that are not exact."""
    refs = inv["reference"].withColumn("id", F.lower("name")).join(central_versions(inv), ["project", "id"], "left")
    bad = refs.where("kind IN ('floating', 'range') OR (kind = 'missing' AND central IS NULL)")
    late = F.when(F.col("kind") == "missing", 1).otherwise(0)
    text = F.when(F.col("kind") == "missing", F.concat("name", F.lit(": no version (line "), F.col("line").cast("string"), F.lit(")"))).otherwise(F.concat("name", F.lit(' Version="'), "text", F.lit('"'), F.when(F.col("unbounded"), ", upper bound open").otherwise(""), F.lit(" (line "), F.col("value_line").cast("string"), F.lit(")")))
    by_file = bad.groupBy("project", "path").agg(_list(F.struct(late.alias("l"), F.col("no").alias("n")), text).alias("snippet"), F.min_by("value_line", "no").alias("line"))
    out = _row(by_file, "nuget-floating-version", "MEDIUM", "CONFIRMED")
    for item, rule in (("central_version", "nuget-floating-version"), ("config_package", "nuget-packages-config-range")):
        loose = inv[item].where("kind IN ('floating', 'range')")
        g = loose.groupBy("project", "path").agg(_list(F.col("no"), F.concat("name", F.lit(' version="'), "text", F.lit('"'))).alias("snippet"), F.min_by("line", "no").alias("line"))
        out = out.unionByName(_row(g, rule, "MEDIUM", "CONFIRMED"))
    return out


def lock_files(inv: dict[str, DataFrame], files: DataFrame | None = None) -> DataFrame:
    """SC-08 to SC-11: absent, invalid, stale and incomplete lock files beside projects, and orphans without hashes."""
    locks = first_by_key(inv["lockfile"].withColumn("dir", folder(F.col("path"))), [F.col("project"), F.col("dir")], [F.col("path")]).select("project", "dir", F.col("path").alias("lock"))
    n_refs = inv["reference"].groupBy("project", "path").agg(F.count("*").alias("n_refs"))
    projects = inv["project"].select("project", "path").join(n_refs, ["project", "path"]).withColumn("dir", folder(F.col("path")))
    switch = inv["lock_enabled"].groupBy("project", "path").agg(F.min("line").alias("switch_line"))
    pl = projects.join(locks, ["project", "dir"], "left").join(switch, ["project", "path"], "left")
    invalid = inv["lock_invalid"].select("project", F.col("path").alias("lock")).distinct().withColumn("invalid", F.lit(True))
    pl = pl.join(invalid, ["project", "lock"], "left")
    absent = _row(pl.where("lock IS NULL"), "nuget-lockfile-absent", "MEDIUM", "CONFIRMED", line=F.coalesce("switch_line", F.lit(1)), snippet=F.concat(F.col("n_refs").cast("string"), F.lit(" references, no lock file")))
    broken = _row(pl.where("lock IS NOT NULL AND invalid"), "nuget-lockfile-invalid", "MEDIUM", "CONFIRMED", path="lock", line=F.lit(1), snippet=F.lit("not valid JSON"))
    good = pl.where("lock IS NOT NULL AND invalid IS NULL").select("project", "path", "lock")
    entries = first_by_key(inv["lock_entry"].withColumn("id", F.lower("name")), [F.col("project"), F.col("path"), F.col("id")], [F.col("no")]).select("project", F.col("path").alias("lock"), "id", F.col("requested").alias("wanted"), F.col("line").alias("entry_line"))
    refs = inv["reference"].withColumn("id", F.lower("name")).join(central_versions(inv), ["project", "id"], "left").withColumn("pin", F.when(F.col("kind") != "missing", F.col("text")).otherwise(F.col("central")))
    cmp = refs.join(good, ["project", "path"]).join(entries, ["project", "lock", "id"], "left")
    lower = F.trim(F.split_part(F.regexp_replace("wanted", r"^\[|\)\z", ""), F.lit(","), F.lit(1)))
    conflict = (F.col("pin") != "") & (lower != "") & (lower != F.trim("pin")) & ~F.col("pin").contains("*")
    cmp = cmp.withColumn("what", F.when(F.col("entry_line").isNull(), F.concat("name", F.lit(": not in the lock file"))).when(conflict, F.concat("name", F.lit(": pinned "), "pin", F.lit(", locked for "), "wanted"))).where("what IS NOT NULL")
    stale = cmp.groupBy("project", "path", "lock").agg(_list(F.struct(F.when(F.col("entry_line").isNull(), 1).otherwise(0).alias("l"), F.col("no").alias("n")), F.col("what")).alias("snippet"))
    stale = _row(stale, "nuget-lockfile-stale", "MEDIUM", "CONFIRMED", path="lock", line=F.lit(1))
    bare = inv["lock_entry"].where("NOT has_hash AND (coalesce(resolved, '') <> '' OR kind = 'Direct')").join(invalid.withColumnRenamed("lock", "path"), ["project", "path"], "left_anti")
    bare = bare.groupBy("project", "path").agg(_list(F.col("no"), F.concat_ws(" ", "name", "resolved")).alias("snippet"), F.min_by("line", "no").alias("line"))
    # a lock file counts where a project with references has it beside itself, or where no project is in its folder
    dirs = inv["project"].select("project", folder(F.col("path")).alias("dir")).distinct()
    orphan = bare.withColumn("dir", folder(F.col("path"))).join(dirs, ["project", "dir"], "left_anti").drop("dir")
    owned = bare.join(good.select("project", F.col("lock").alias("path")).distinct(), ["project", "path"], "left_semi")
    hashes = _row(owned.unionByName(orphan), "nuget-lockfile-missing-hash", "MEDIUM", "CONFIRMED")
    out = absent.unionByName(broken).unionByName(stale).unionByName(hashes)
    if files is not None and "modified" in files.columns:
        at = files.select("project", F.translate("path", "\\", "/").alias("path"), "modified")
        old = good.join(at, ["project", "path"]).join(at.select("project", F.col("path").alias("lock"), F.col("modified").alias("locked_at")), ["project", "lock"]).where("modified > locked_at + 1.0")
        out = out.unionByName(_row(old, "nuget-lockfile-mtime-stale", "LOW", "UNVERIFIED", path="lock", line=F.lit(1), snippet=F.lit("the project file is newer")))
    return out


def name_risk(ids: DataFrame, known: list[str] | None = None) -> DataFrame:
    """SC-12: ``(name, nearest, distance)`` of ids ``(name)`` with odd characters or close to a well-known id.

    The known ids are a fixed list, so they go along as one array and no pairs are made as rows. The nearest is the first in
    the list's order among the closest whose length differs by at most two.
    """
    known = known or WELL_KNOWN
    low = F.lower(F.trim("name"))
    table = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(i).alias("i")) for i, k in enumerate(known)])
    near = F.transform(F.filter(table, lambda t: F.abs(F.length(t["k"]) - F.length(low)) <= 2), lambda t: F.struct(F.levenshtein(low, t["k"]).alias("distance"), t["i"].alias("i"), t["k"].alias("nearest")))
    odd = F.col("name").rlike(r"[^A-Za-z0-9._\- ]")
    d = ids.where("name IS NOT NULL AND trim(name) <> ''").select("name", low.alias("low"), odd.alias("odd"), F.array_min(near).alias("n"))
    d = d.where(~F.col("low").isin([k.lower() for k in known]))
    close = ((F.col("n.distance") == 1) & (F.length("low") >= 6)) | ((F.col("n.distance") == 2) & (F.length("low") >= 14))
    return d.where(F.col("odd") | F.coalesce(close, F.lit(False))).select("name", F.when(~F.col("odd"), F.col("n.nearest")).alias("nearest"), F.when(~F.col("odd"), F.col("n.distance")).alias("distance"))


def risky_names(inv: dict[str, DataFrame]) -> DataFrame:
    """The first NAME_MOST suspicious ids of a project, in order of where ids are declared; a report's cap, not a limit of the search."""
    parts = [inv[k].withColumn("src", F.lit(i)) for i, k in enumerate(("reference", "config_package", "central_version", "lock_entry"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = first_by_key(every.where("trim(name) <> ''").withColumn("id", F.lower(F.trim("name"))), [F.col("project"), F.col("id")], [F.col("src"), F.col("path"), F.col("no")])
    risky = name_risk(every.select(F.col("id").alias("name")).distinct()).select(F.col("name").alias("id"), "nearest", "distance")
    hit = every.join(risky, "id")
    from pyspark.sql import Window

    hit = hit.withColumn("rn", F.row_number().over(Window.partitionBy("project").orderBy("src", "path", "no"))).where(F.col("rn") <= NAME_MOST)
    return _row(hit, "nuget-package-name-risk", "LOW", "POSSIBLE", line=F.coalesce("value_line", "line", F.lit(1)), snippet=F.coalesce("snippet", "name"))


def package_folder(path: Column) -> Column:
    """The folder of a restored package: the part of the path up to one step below ``packages``."""
    return F.coalesce(F.when(F.regexp_extract(path, r"(?i)^(.*?(?:^|/)packages/[^/]+)/", 1) != "", F.regexp_extract(path, r"(?i)^((?:.*/)?packages/[^/]+)/", 1)), path)


def restore_execution(inv: dict[str, DataFrame]) -> DataFrame:
    """SC-13 to SC-15: install scripts, build files that run something, imports of them, and declared hooks."""
    scripts = inv["install_script"].withColumn("dir", package_folder(F.col("path")))
    installs = scripts.groupBy("project", "dir").agg(F.min("path").alias("path"), _list(F.col("path"), F.col("path"), HOOK_MOST).alias("snippet"))
    out = _row(installs, "nuget-install-script", "HIGH", "CONFIRMED", line=F.lit(1))
    first_exec = first_by_key(inv["executes"], [F.col("project"), F.col("path")], [F.col("no")]).select("project", "path", F.col("line").alias("exec_line"), F.col("kind").alias("why"), F.col("snippet").alias("exec_snippet"))
    builds = inv["build_file"].select("project", "path").join(first_exec, ["project", "path"], "left").withColumn("dir", package_folder(F.col("path")))
    runs = builds.groupBy("project", "dir").agg(
        F.bool_or(F.col("exec_line").isNotNull()).alias("executes"), F.min(F.when(F.col("exec_line").isNotNull(), F.struct("path", "exec_line", "exec_snippet"))).alias("head"), F.min("path").alias("first"),
    )
    hooks = runs.where("executes").select("project", F.col("head.path").alias("path"), F.col("head.exec_line").alias("line"), F.col("head.exec_snippet").alias("snippet"))
    out = out.unionByName(_row(hooks, "nuget-package-msbuild-hook", "HIGH", "CONFIRMED"))
    plain = runs.where("NOT executes").groupBy("project").agg(F.min("first").alias("path"), _list(F.col("dir"), F.col("dir"), HOOK_MOST).alias("snippet"))
    out = out.unionByName(_row(plain, "nuget-package-msbuild-declarative", "INFO", "CONFIRMED", line=F.lit(1)))
    want = F.lower(F.regexp_replace(F.translate("name", "\\", "/"), r"^(\.\./)+", ""))
    imports = inv["import"].withColumn("want", want)
    have = builds.select("project", F.col("path").alias("target"), F.lower("path").alias("have"), "exec_line", "why", "exec_snippet")
    # matched by the file's own name, which both sides share, so the suffix test is a residual of a hash join
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    pairs = imports.withColumn("leaf", last(F.col("want"))).join(have.withColumn("leaf", last(F.col("have"))), ["project", "leaf"], "left").withColumn("fits", (F.col("have") == F.col("want")) | F.expr("endswith(have, concat('/', want))") | F.expr("endswith(want, have)"))
    best = pairs.groupBy("project", "path", "line", "snippet", "name").agg(F.min(F.when(F.col("fits"), F.struct("target", "exec_line", "exec_snippet"))).alias("t"))
    run = best.where("t.exec_line IS NOT NULL")
    out = out.unionByName(_row(run, "nuget-project-imports-package-targets", "HIGH", "CONFIRMED", snippet=F.concat("snippet", F.lit("\n"), F.col("t.target"), F.lit(": "), F.col("t.exec_snippet"))))
    rest = best.where("t.exec_line IS NULL").groupBy("project").agg(F.min(F.struct("path", "line")).alias("f"), _list(F.struct("path", "line"), F.concat("path", F.lit(" -> "), "name"), HOOK_MOST).alias("snippet")).select("project", "f.path", "f.line", "snippet")
    out = out.unionByName(_row(rest, "nuget-project-imports-package-declarative", "INFO", "CONFIRMED"))
    return out.unionByName(_row(inv["nuspec_script"], "nuget-nuspec-declares-install-hook", "HIGH", "CONFIRMED"))


def supplychain_hits(items: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """All checks over NuGet items: FOUND columns. The items are written once, so files are parsed once for all checks."""
    inv = nuget_inventory(materialise(items, "nuget-items"))
    parts = [dependency_confusion(inv), pinning(inv), lock_files(inv, files), risky_names(inv), restore_execution(inv)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def version_conflicts(refs: DataFrame) -> DataFrame:
    """COR-22: names ``(project, name, version)`` found in more than one version outside package folders."""
    g = refs.where("name IS NOT NULL AND version IS NOT NULL").groupBy("project", F.lower("name").alias("name")).agg(F.sort_array(F.collect_set("version")).alias("versions"))
    return g.where(F.size("versions") > 1)
