"""Settings as JSON documents: their values as rows, default-filling merges, what is managed taken out again, and the documents rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.shared import materialize


def values(docs: DataFrame, lists: bool = True) -> DataFrame:
    """(doc, path, text) of docs (doc, text): each value of a JSON document with the way to it, and with its own JSON.

    A step of a path is a key as JSON, with its quotes, or the place in a list, from 0. Values are what isn't an object or list,
    and empty ones; without `lists`, a list is one value. A text that is null or no JSON, or an object of it that has a key twice, gives no
    row. Levels are opened one after the other, each written, so there are as many rounds as a document is deep.
    """
    level = docs.select("doc", F.array().cast("array<string>").alias("path"), F.to_json(F.try_parse_json("text")).alias("text")).where("text IS NOT NULL")
    told, opens = [], F.col("text").rlike(r"^[{\[]" if lists else r"^\{") & ~F.col("text").isin("{}", "[]")
    while True:
        level = materialize(level, "settings-level")
        told.append(level.where(~opens))
        inside = level.where(opens)
        if inside.isEmpty():
            break
        each = inside.lateralJoin(docs.sparkSession.tvf.variant_explode(F.parse_json(F.col("text").outer())))
        key = F.to_json(F.array("key"))
        step = F.when(F.col("key").isNull(), F.col("pos").cast("string")).otherwise(F.substring(key, F.lit(2), F.length(key) - 2))
        level = each.select("doc", F.concat("path", F.array(step)).alias("path"), F.coalesce(F.to_json("value"), F.lit("null")).alias("text"))
    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    return out


def rebuilt(rows: DataFrame, managed: str | None = None) -> DataFrame:
    """(doc, text) of rows as in values, keys in the order of their names; the text is null where nothing is left.

    With `managed`, objects whose member of that name is true are left out, and so is what is emptied by that: lists and objects
    that have nothing else, and an item of a list that loses a list of its own. What was empty before stays. Rows are exchanged once, by doc.
    """
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    rows = rows.select("doc", "path", "text", F.lit(False).alias("_list")).repartition("doc")
    for d in range(deepest, 0, -1):
        here = F.size("path") == d
        step = F.get("path", F.lit(d - 1))
        place = F.when(step.startswith('"'), -1).otherwise(F.try_to_number(step, F.lit("999999999999")).cast("long"))
        member = F.when(here, F.struct(place.alias("place"), step.alias("step"), "text", "_list"))
        grouped = rows.groupBy("doc", F.when(here, F.slice("path", 1, d - 1)).otherwise(F.col("path")).alias("path")).agg(F.array_sort(F.collect_list(member)).alias("_own"), F.max(F.when(~here, F.col("text"))).alias("_text"), F.bool_or(~here & F.col("_list")).alias("_was"))
        listed = F.get("_own", F.lit(0))["place"] >= 0
        alive = F.filter("_own", lambda m: m["text"].isNotNull())
        gone = F.size(alive) == 0
        if managed is not None:
            name = F.to_json(F.array(F.lit(managed)))
            flagged = F.exists("_own", lambda m: (m["step"] == F.substring(name, F.lit(2), F.length(name) - 2)) & (m["text"] == "true"))
            item = F.coalesce(F.get("path", F.lit(d - 2)).rlike(r"^\d"), F.lit(False)) if d > 1 else F.lit(False)
            gone = gone | flagged | (item & ~listed & F.exists("_own", lambda m: m["text"].isNull() & m["_list"]))
        joined = lambda parts: F.array_join(parts, ",")
        made = F.when(gone, None).when(listed, F.concat(F.lit("["), joined(F.transform(alive, lambda m: m["text"])), F.lit("]"))).otherwise(F.concat(F.lit("{"), joined(F.transform(alive, lambda m: F.concat(m["step"], F.lit(":"), m["text"]))), F.lit("}")))
        built = F.size("_own") > 0
        rows = grouped.select("doc", "path", F.when(built, made).otherwise(F.col("_text")).alias("text"), F.when(built, listed).otherwise(F.col("_was")).alias("_list"))
    return rows.select("doc", "text")


def _prefixes(rows: DataFrame) -> DataFrame:
    """rows with each begin of their path, the empty and the whole one too, as upto."""
    return rows.withColumn("upto", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda i: F.slice("path", 1, i))))


def merged_documents(user: DataFrame, template: DataFrame) -> DataFrame:
    """user, template (doc, text) -> (doc, text): the user's documents, filled with what only the template's have. doc names one document.

    Objects are merged at all depths. Any other value of the user's stays as it is, null and lists too, as does an object where the template has
    none. A user's text that is no JSON stays untouched; one that is null is as none. Merging again changes nothing.
    """
    odd = user.where(F.col("text").isNotNull() & F.try_parse_json("text").isNull()).select("doc", "text")
    own = values(user, lists=False)
    theirs = values(template.join(odd, "doc", "left_anti"), lists=False)
    whole = F.col("upto") == F.col("path")
    taken = _prefixes(own).groupBy("doc", "upto").agg(F.bool_or(whole & (F.col("text") != "{}")).alias("_value"))
    told = _prefixes(theirs).join(taken, ["doc", "upto"]).groupBy("doc", "path").agg(F.bool_or(F.col("_value") | whole).alias("_out"))
    fills = theirs.join(told.where("_out"), ["doc", "path"], "left_anti")
    return rebuilt(own.unionByName(fills)).unionByName(odd)


def without_managed(docs: DataFrame, managed: str = "_managed") -> DataFrame:
    """docs (doc, text) without what is managed (see rebuilt); a text that is no JSON stays untouched, null is left where nothing is."""
    odd = docs.where(F.try_parse_json("text").isNull()).select("doc", "text")
    return rebuilt(values(docs), managed).unionByName(odd)
