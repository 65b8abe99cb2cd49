"""Manifests, configuration merges, policies, retention and lessons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import commands
from runlens.functions.globs import is_cache
from runlens.functions.text import set_front_matter, short_hash


def manifest_drift(recorded: DataFrame, disk: DataFrame, source: DataFrame) -> DataFrame:
    """recorded (path, tpl, cur), disk (path, hash), source (path, tpl) -> (path, local, upstream): ok, edited, deleted, untracked; ok, changed, new, gone."""
    d, s = disk.select("path", F.col("hash").alias("now")), source.select("path", F.col("tpl").alias("template"))
    both = recorded.join(d, "path", "full_outer").join(s, "path", "full_outer")
    local = F.when(F.col("cur").isNull() & F.col("now").isNotNull(), "untracked").when(F.col("cur").isNotNull() & F.col("now").isNull(), "deleted").when(F.col("cur") != F.col("now"), "edited").otherwise("ok")
    upstream = F.when(F.col("tpl").isNull() & F.col("template").isNotNull(), "new").when(F.col("tpl").isNotNull() & F.col("template").isNull(), "gone").when(F.col("tpl") != F.col("template"), "changed").otherwise("ok")
    return both.select("path", local.alias("local"), upstream.alias("upstream"))


def merged(user: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): the user's values, and the template's where the user has no row; a blank or null value of the user's stays. Merging again changes nothing."""
    u = user.select(*keys, F.col("value").alias("_u"), F.lit(True).alias("_own"))
    both = template.select(*keys, F.col("value").alias("_t")).join(u, keys, "full_outer")
    return both.select(*keys, F.when(F.col("_own"), F.col("_u")).otherwise(F.col("_t")).alias("value"))


def managed_sync(installed: DataFrame, template: DataFrame) -> DataFrame:
    """(event, script, command, managed): managed entries as in the template, gone where it has none, others untouched."""
    t = template.select("event", "script", F.col("command").alias("_new"))
    both = installed.join(t, ["event", "script"], "full_outer")
    mine = F.coalesce(~F.col("managed"), F.lit(False))
    kept = both.where(mine | F.col("_new").isNotNull())
    return kept.select("event", "script", F.when(mine, F.col("command")).otherwise(F.col("_new")).alias("command"), (~mine).alias("managed"))


def unmanaged(installed: DataFrame) -> DataFrame:
    """What is left of (event, script, command, managed) without managed entries; events without any others are gone with them."""
    return installed.where("NOT coalesce(managed, false)")


def compared(current: DataFrame, template: DataFrame, stamped: tuple[str, str]) -> DataFrame:
    """current and template (name, field, value) -> (name, same), but for one stamped field (name, field) that every machine sets by itself."""
    own = lambda t, v: t.where(~((F.col("name") == stamped[0]) & (F.col("field") == stamped[1]))).select("name", "field", F.struct("value").alias(v))
    both = own(current, "_c").join(own(template, "_t"), ["name", "field"], "full_outer")
    names = current.select("name").union(template.select("name")).distinct()
    told = both.groupBy("name").agg(F.bool_and(F.col("_c").eqNullSafe(F.col("_t"))).alias("_same"))
    return names.join(told, "name", "left").select("name", F.coalesce("_same", F.lit(True)).alias("same"))


def stamped_models(roles: DataFrame, models: DataFrame, default: str = "default") -> DataFrame:
    """roles (role, text), models (role, model) -> (role, model, text): each role's own model, else the default's, set in the front matter; a blank one leaves the text as it is."""
    named = models.select(F.col("role").alias("_r"), "model")
    fallback = models.where(F.col("role") == default).select(F.lit(1).alias("_one"), F.col("model").alias("_default"))
    told = roles.withColumn("_one", F.lit(1)).join(named, F.col("role") == F.col("_r"), "left").join(fallback, "_one", "left")
    model = F.nullif(F.when(F.col("_r").isNotNull(), F.col("model")).otherwise(F.col("_default")), F.lit(""))
    return told.select("role", model.alias("model"), F.when(model.isNotNull(), set_front_matter(F.col("text"), "model", model)).otherwise(F.col("text")).alias("text"))


def unranked_models(models: DataFrame, ladder: DataFrame) -> DataFrame:
    """models (role, model), ladder (model) -> (role, model, status): warn for models that the ladder doesn't rank, or for all if it is empty; blank ones inherit and are left out."""
    ranked = ladder.select("model", F.lit(True).alias("_ranked")).distinct()
    told = models.where(F.trim(F.coalesce("model", F.lit(""))) != "").join(ranked, "model", "left")
    return told.select("role", "model", F.when(F.col("_ranked"), "ok").otherwise("warn").alias("status"))


def drift_status(drift: DataFrame, has_source: bool = True) -> DataFrame:
    """manifest_drift's rows as checks (axis, status, n): warn for edited or changed files, fail for deleted ones, ok without any; without a source it cannot be told what came from there."""
    rows = drift.agg(F.count_if(F.col("local") == "deleted").alias("deleted"), F.count_if(F.col("local") == "edited").alias("edited"), F.count_if(F.col("upstream").isin("changed", "new", "gone")).alias("upstream"))
    local = F.struct(F.lit("local").alias("axis"), F.when(F.col("deleted") > 0, "fail").when(F.col("edited") > 0, "warn").otherwise("ok").alias("status"), (F.col("deleted") + F.col("edited")).alias("n"))
    up = F.when(F.col("upstream") > 0, "warn").otherwise("ok") if has_source else F.lit("cannot tell")
    return rows.select(F.explode(F.array(local, F.struct(F.lit("upstream").alias("axis"), up.alias("status"), F.col("upstream").alias("n")))).alias("c")).select("c.*")


def manifest_entries(files: DataFrame, template: DataFrame) -> DataFrame:
    """files (path, text), template (path, text) -> (path, tpl, cur): hashes of what was installed and of what is there, without tool caches."""
    side = lambda t, c: t.where(~is_cache(F.col("path"))).select("path", short_hash(F.col("text")).alias(c))
    return side(files, "cur").join(side(template, "tpl"), "path", "left").select("path", "tpl", "cur")


def verdict(kind: Column, value: Column) -> Column:
    """The reason why a command (see commands.denied) or a path is denied, null if it isn't."""
    path = commands.sensitive(commands.normal_path(value))
    return F.when(kind == "command", commands.denied(value)).when((kind == "path") & path, "sensitive place")


#: Commands that change the repository; the branch helper is no git command.
MUTATION = r"\bgit\b(?:\s+-\S+(?:\s+[^\s-]\S*)?)*\s+(commit|merge|rebase|reset|push|checkout|switch|branch|tag|cherry-pick|revert|stash)\b"


def mutates(role: Column, command: Column) -> Column:
    """Whether a command changes the repository while a role is active; without a role everything is allowed."""
    return F.coalesce(role.isNotNull() & (role != "") & command.rlike(MUTATION), F.lit(False))


def denied_by_configuration(value: Column, substrings: list[str]) -> Column:
    """The first configured substring that a command or path holds, null if none."""
    return F.coalesce(*[F.when(value.contains(s), F.lit(s)) for s in substrings], F.lit(None).cast("string"))


def outside_role(role: Column, path: Column, allowed: dict[str, list[str]]) -> Column:
    """Whether a role writes where it may not; without a role, or with one that has no list, everything is allowed."""
    out = F.lit(False)
    for name, prefixes in allowed.items():
        inside = F.lit(False)
        for p in prefixes:
            inside = inside | path.startswith(p)
        out = F.when(role == name, ~inside).otherwise(out)
    return out


def retention(items: DataFrame, protected: DataFrame, now: Column, days: int = 30, key: str = "run") -> DataFrame:
    """items (run, mtime, ...) older than so many days, or empty folders (n_files 0) of any age, that no row of protected names. This is the dry run: nothing is deleted."""
    empty = F.col("n_files") == 0 if "n_files" in items.columns else F.lit(False)
    return items.where(F.coalesce(empty, F.lit(False)) | (F.col("mtime") < now - F.make_dt_interval(F.lit(days)))).join(protected.select(key).distinct(), key, "left_anti")


def stale(markers: DataFrame, now: Column, limit_s: int = 3600, logs: DataFrame | None = None) -> DataFrame:
    """(run, stale): whether the newest of a run's markers, and of its log's records if logs (run, mtime) are given, is older than the limit. The log of calls without a run doesn't count."""
    if logs is not None:
        markers = markers.select("run", "mtime").union(logs.where("run <> '_no-run'").select("run", "mtime").join(markers.select("run").distinct(), "run", "left_semi"))
    newest = markers.groupBy("run").agg(F.max("mtime").alias("newest"))
    return newest.select("run", (F.col("newest") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(limit_s))).alias("stale"))


def lessons(rows: DataFrame, cap: int = 30) -> DataFrame:
    """(seq, lesson): the newest cap lessons, of those alike but for case and white space the first; blank ones are left out."""
    norm = F.lower(F.trim(F.regexp_replace("lesson", r"\s+", " ")))
    first = rows.withColumn("_n", norm).where("_n <> ''").groupBy("_n").agg(F.min(F.struct("seq", "lesson")).alias("r")).select("r.*")
    return first.orderBy(F.desc("seq")).limit(cap)
