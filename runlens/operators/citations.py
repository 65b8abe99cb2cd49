"""Review reports as claims: cleared items and findings with what they cite, citations checked against files, and the verdict."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.evidence import line_cells, lines, sites
from runlens.shared import prepare

#: Headings under which a report says what it found in order, statuses that fail it, and roles whose items are counted.
CLEARED = ["sections cleared", "categories cleared", "dimensions with no issues", "dimensions cleared"]
FAILING = ["mismatch", "failed", "uncited", "unrunnable"]
ENUMERATED_ROLES = ["design-critic", "security-reviewer", "auditor"]

_COUNT = r"`([^`]+)`\s*(?:->|→)\s*(\d{1,3}(?:,\d{3})+|\d+|no|zero)\b"
_PLACE = r"`?([\w./-]+\.\w+|[\w.-]*/[\w./-]+):(\d+)(?:-(\d+))?`?\s+\"([^\"]+)\""
_HEADING = r"^(#{1,6})\s+(.*?)\s*$"


def sections(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, text, section, block): each line with the second-level heading above it (lower case) and the number of the third-level block that it is in, 0 before the first."""
    level = F.when(F.col("text").startswith("#"), F.length(F.regexp_extract("text", _HEADING, 1)))
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    named = F.last(F.when(level == 2, F.lower(F.regexp_extract("text", _HEADING, 2))).when(level == 1, ""), ignorenulls=True)
    told = lines(docs, key).withColumn("section", F.coalesce(named.over(order), F.lit("")))
    return told.withColumn("block", F.sum(F.when(level == 3, 1).otherwise(0)).over(Window.partitionBy(key, "section").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))


def bullets(docs: DataFrame, headings: list[str] | None = None, key: str = "path") -> DataFrame:
    """(key, line, section, item): bullets, their continuation lines joined by a blank, of the sections named (all by default). A blank line, a heading or the next bullet ends one."""
    told = sections(docs, key)
    if headings is not None:
        told = told.where(F.col("section").isin(*headings))
    begins = F.col("text").rlike(r"^\s*[-*]\s+")
    stops = F.when(F.col("text").startswith("#"), F.col("text").rlike(_HEADING)).otherwise(F.col("text").rlike(r"^\s*$"))
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    run = told.withColumn("_begin", F.last(F.when(begins, F.col("line")).when(stops, -1), ignorenulls=True).over(order)).where("_begin > 0")
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"^\s*[-*]\s+", ""), r"\s+", " "))
    joined = run.groupBy(key, "section", F.col("_begin").alias("line")).agg(F.array_sort(F.collect_list(F.struct(F.col("line").alias("n"), text.alias("t")))).alias("_all"))
    return joined.select(key, "line", "section", F.array_join(F.transform("_all", lambda x: x["t"]), " ").alias("item"))


def cleared(docs: DataFrame, key: str = "path") -> DataFrame:
    """The bullets of sections that say what is in order; other sections need no citations."""
    return bullets(docs, CLEARED, key)


def citation(item: Column) -> Column:
    """(kind, command, claimed, path, first, last, snippet) of what an item cites.

    search: the first backticked command with a count behind it, whatever prose comes before; no and zero are 0, and 1,234 is
    1234. place: path:line or path:line-line and a quoted snippet; a path has an ending or a slash, and may lead anywhere (see places). unverified: an item that says so. Else none.
    """
    count = F.regexp_extract(item, _COUNT, 2)
    claimed = F.when(count.isin("no", "zero"), 0).otherwise(F.replace(count, F.lit(","), F.lit("")).try_cast("long"))
    part = lambda i: F.nullif(F.regexp_extract(item, _PLACE, i), F.lit(""))
    says = item.rlike(r"(?i)\b(cleared|enumerated)\b")
    search, place = says & item.rlike(_COUNT), says & item.rlike(_PLACE)
    kind = F.when(search, "search").when(place, "place").when(item.rlike(r"(?i)\bunverified\b"), "unverified").otherwise("none")
    first = part(2).try_cast("long")
    only = lambda test, value: F.when(test, value)
    at = place & ~search
    return F.struct(kind.alias("kind"), only(search, F.regexp_extract(item, _COUNT, 1)).alias("command"), only(search, claimed.cast("long")).alias("claimed"), only(at, part(1)).alias("path"), only(at, first).alias("first"), only(at, F.coalesce(part(3).try_cast("long"), first)).alias("last"), only(at, F.regexp_replace(part(4), r"^`|`$", "")).alias("snippet"))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _in_order(snippet: Column) -> Column:
    """A pattern for a snippet whose ... stand for anything between its parts."""
    parts = F.filter(F.transform(F.split(snippet, r"\.\.\."), _flat), lambda p: p != "")
    return F.concat(F.lit("(?s)"), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), ".*"))


def places(citations: DataFrame, text_lines: DataFrame, near: int = 2) -> DataFrame:
    """citations (claim_id, path, first, last, snippet), text_lines (path, line, text) -> (claim_id, status).

    unrunnable: a path that leaves the project. failed: no such file. reproduced: the cited lines, joined, hold the
    snippet, its parts in order where ... elides something. stale: so do they with `near` lines more on both sides; else
    mismatch. White space counts as one blank. Only the cited lines of a file are gathered.

    Citations and lines are exchanged once, by path, and never broadcast: lines are many more than the texts' size lets expect, and
    what is gathered before an exchange would be all citations of one file of the table in one task. They go to as many tasks as the
    session has shuffle partitions; fewer, larger ones would each sort much more.
    """
    n = int(citations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = citations.select("claim_id", F.col("path").alias("_path"), "first", "last", "snippet").repartition(n, "_path")
    leaves = F.col("_path").startswith("/") | F.array_contains(F.split("_path", "/"), "..")
    known = text_lines.select("path").distinct().withColumnRenamed("path", "_file")
    around = (F.col("_path") == F.col("path")) & F.col("line").between(F.col("first") - near, F.col("last") + near)
    met = c.join(text_lines.repartition(n, "path").hint("merge"), around, "left").groupBy("claim_id", "_path").agg(
        F.any_value("first").alias("first"), F.any_value("last").alias("last"), F.any_value("snippet").alias("snippet"),
        F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", "text")))).alias("_lines"),
    ).join(known.hint("merge"), F.col("_path") == F.col("_file"), "left")
    text = lambda some: _flat(F.array_join(F.transform(some, lambda x: x["text"]), " "))
    own = text(F.filter("_lines", lambda x: x["line"].between(F.col("first"), F.col("last"))))
    pattern = _in_order(F.col("snippet"))
    status = F.when(leaves, "unrunnable").when(F.col("_file").isNull(), "failed").when(F.regexp_like(own, pattern), "reproduced").when(F.regexp_like(text(F.col("_lines")), pattern), "stale").otherwise("mismatch")
    return met.select("claim_id", status.alias("status"))


def findings(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, block, title, sites, cites): third-level blocks of the section Findings, the distinct places that each names, and whether it cites a search with a count."""
    inside = sections(docs, key).where("section = 'findings' AND block > 0")
    whole = inside.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_all"))
    body = F.array_join(F.transform("_all", lambda x: x["text"]), "\n")
    return whole.select(key, "block", F.regexp_extract(F.col("_all")[0]["text"], _HEADING, 2).alias("title"), sites(body).alias("sites"), (citation(body)["kind"] == "search").alias("cites"))


def unenumerated(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, block, title, status, detail) of findings that name several places and no search that counts them all."""
    many = findings(docs, key).where("size(sites) > 1 AND NOT cites")
    return many.select(key, "block", "title", F.lit("uncited").alias("status"), F.format_string("lists %d sites without a search", F.size("sites")).alias("detail"))


def declared_enumerations(docs: DataFrame, reviewer: str, key: str = "path") -> DataFrame:
    """(key, item, kind, command, baseline) of a reviewer's section of tables (#, item, kind, enumerate, baseline).

    Rows whose command is a <placeholder> declare nothing; a missing kind is candidates; only the last column is a baseline.
    """
    rows = line_cells(sections(docs, key), key).where(F.col("section") == reviewer.lower())
    cell = lambda i: F.trim(F.coalesce(F.try_element_at("cells", F.lit(i)), F.lit("")))
    command = F.regexp_extract(cell(4), r"^`([^`]+)`$", 1)
    told = rows.select(key, cell(1).try_cast("int").alias("item"), F.when(cell(3) == "violations", "violations").otherwise("candidates").alias("kind"), command.alias("command"), cell(5).try_cast("long").alias("baseline"))
    return told.where(F.col("item").isNotNull() & (F.col("command") != "") & ~F.col("command").rlike(r"^<.*>$"))


def verdict(claims: DataFrame, coverage: DataFrame | None = None, key: str = "report") -> DataFrame:
    """claims (report, status), coverage (report, status) -> (report, event, failing, coverage, exit): one event a report, exit 1 if a claim fails or its coverage isn't complete (no-checklist and no row count as nothing to cover)."""
    counted = claims.groupBy(key).agg(F.count_if(F.col("status").isin(*FAILING)).alias("failing"))
    if coverage is not None:
        counted = counted.join(coverage.select(key, F.col("status").alias("coverage")), key, "full_outer").withColumn("failing", F.coalesce("failing", F.lit(0)))
    else:
        counted = counted.withColumn("coverage", F.lit(None).cast("string"))
    short = F.coalesce(F.col("coverage").isin("incomplete", "missing"), F.lit(False))
    return counted.select(key, F.lit("verification").alias("event"), "failing", "coverage", F.when((F.col("failing") > 0) | short, 1).otherwise(0).alias("exit"))


def unreported_roles(reports: DataFrame) -> DataFrame:
    """(role): roles whose items are counted for which reports (role, location) has no place to look."""
    roles = reports.sparkSession.range(len(ENUMERATED_ROLES)).select(F.array(*map(F.lit, ENUMERATED_ROLES))[F.col("id").cast("int")].alias("role"))
    return roles.join(reports.where("location IS NOT NULL"), "role", "left_anti")


def searched_files(text_lines: DataFrame, pattern: str, glob: str | None = None, without: str | None = None) -> DataFrame:
    """(path, n): matching lines by file, of the files whose name a glob matches; a search that is counted by file, listed, or counted as files reads off this."""
    from runlens.functions.globs import matches

    hit = F.regexp_like("text", F.lit(pattern))
    if without is not None:
        hit = hit & ~F.regexp_like("text", F.lit(without))
    own = text_lines.where(matches(F.col("path"), [glob])) if glob else text_lines
    return own.where(hit).groupBy("path").agg(F.count("*").alias("n"))


def distinct_lines(text_lines: DataFrame, pattern: str) -> DataFrame:
    """(text): matching lines without repeats (sort and uniq)."""
    return text_lines.where(F.regexp_like("text", F.lit(pattern))).select("text").distinct()


def digest(skills: DataFrame, enabled: DataFrame) -> DataFrame:
    """enabled (pos, skill), skills (skill, text) -> (pos, skill, body, note): purpose and hints of each enabled skill, in order by pos.

    A missing section is (none), and a note if it is the purpose; a skill without a document has a note and no body.
    """
    from runlens.operators.evidence import section

    told = enabled.join(skills, "skill", "left")
    purpose, hints = (section(F.col("text"), name) for name in ("Purpose", "Planner hints"))
    body = F.concat(F.lit("## "), "skill", F.lit("\n### Purpose\n"), F.coalesce(purpose, F.lit("(none)")), F.lit("\n### Planner hints\n"), F.coalesce(hints, F.lit("(none)")))
    note = F.when(F.col("text").isNull(), F.concat("skill", F.lit(": no document"))).when(purpose.isNull(), F.concat("skill", F.lit(": missing '## Purpose'")))
    return told.select("pos", "skill", F.when(F.col("text").isNotNull(), body).alias("body"), note.alias("note"))


def digest_text(parts: DataFrame) -> DataFrame:
    """The digest of enabled skills as one text: they are as few as a configuration names."""
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("pos", "skill", "body"))).alias("all"))
    names = F.array_join(F.transform("all", lambda x: x["skill"]), ", ")
    return whole.select(F.concat(F.lit("Enabled skills: "), F.when(names == "", "(none)").otherwise(names), F.lit("\n\n"), F.array_join(F.transform(F.filter("all", lambda x: x["body"].isNotNull()), lambda x: x["body"]), "\n\n")).alias("text"))


_BLANK = " \t\n\x0b\f\r"
_WORDS = re.compile(rf"[^{_BLANK}]+")


def _units(text: str, most: int) -> Iterator[tuple[int, int, str]]:
    """(paragraph, words, text): paragraphs, those of more than `most` words by sentences, and longer sentences by words."""
    for number, whole in enumerate(re.split(r"\n[ \t]*\n", text)):
        paragraph = whole.strip(_BLANK)
        parts = [paragraph] if len(_WORDS.findall(paragraph)) <= most else re.split(rf"(?<=[.!?])[{_BLANK}]+", paragraph)
        for part in parts:
            words = _WORDS.findall(part)
            if len(words) > most:
                yield from ((number, len(words[i : i + most]), " ".join(words[i : i + most])) for i in range(0, len(words), most))
            elif words:
                yield number, len(words), part


def chunks(docs: DataFrame, tokens: int = 400, key: str = "path") -> DataFrame:
    """(key, chunk, anchor, text, words) of docs (key, text): paragraphs in order, as many to a chunk as have `tokens` words at most.

    A paragraph with more is cut where sentences end, a sentence with more between words, so no chunk has more. anchor is the
    last heading at or above the chunk's begin, null without one. Texts that are null or blank have no chunk. A text is one row, and is cut in
    one pass with about twice its own memory.
    """
    prepare(docs.sparkSession)
    heading = re.compile(r"(?m)^#{1,6}[ \t]+(.*?)[ \t]*$")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                parts, filled, last, above, number = [], 0, None, None, 0
                for paragraph, n, unit in _units(text or "", tokens):
                    found = heading.search(unit)
                    above = found[1] if found and found[1] else above
                    if filled + n > tokens:
                        rows.append((row, number, anchor, "".join(parts), filled))
                        parts, filled, number = [], 0, number + 1
                    if not parts:
                        anchor = above
                    parts += [("\n\n" if paragraph != last else " ") if parts else "", unit]
                    filled, last = filled + n, paragraph
                if parts:
                    rows.append((row, number, anchor, "".join(parts), filled))
            at, *columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, "chunk", "anchor", "text", "words"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(cut, f"{key} {kind}, chunk long, anchor string, text string, words long")


def changed_files(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """files (path, hash) that aren't in the index (path, hash) as they are now: those to be indexed again."""
    return files.join(indexed.select("path", "hash").distinct(), ["path", "hash"], "left_anti")
