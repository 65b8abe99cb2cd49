"""Retrieval, planning, text evidence and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import evidence, retrieval, searches, upkeep, vectors
from runlens.plans import filling
from runlens.plans import tasks as planning
from runlens.queries import query, table
from runlens.sources import adapters

_COSINE = """list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_inner_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_inner_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("skill"), "embedding")


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest id: one row."""
    return list(_chunks(spark, sf_dir).orderBy("id").limit(1).collect()[0]["embedding"])


@query(f"SELECT e.vec_id AS id, round({_COSINE.format(a='e.embedding', b='q.embedding')}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY {_COSINE.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id LIMIT 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve(_chunks(spark, sf_dir), _vector(spark, sf_dir), 10).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"""
SELECT query, id, round(s, 6) AS similarity, place FROM (
  SELECT q.vec_id AS query, e.vec_id AS id, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS place
  FROM embeddings q JOIN embeddings e ON e.label = q.label, LATERAL (SELECT {_COSINE.format(a='e.embedding', b='q.embedding')} AS s) WHERE q.vec_id % 100 = 0
) WHERE place <= 6
""")
def knn_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    queries = chunks.where("id % 100 = 0").withColumnRenamed("id", "query")
    return retrieval.retrieve_many(chunks, queries).select("query", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query("SELECT count(*) FILTER (WHERE vec_id % 9 = 0) AS skipped, count(*) AS chunks FROM embeddings")
def knn_dim_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _chunks(spark, sf_dir).withColumn("embedding", F.when(F.col("id") % 9 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    return retrieval.mismatched(cut, 64)


@query(f"""
SELECT query, id, round(s, 6) AS similarity, place FROM (
  SELECT q.vec_id AS query, e.vec_id AS id, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS place
  FROM embeddings q, embeddings e, LATERAL (SELECT {_COSINE.format(a='e.embedding', b='q.embedding')} AS s) WHERE q.vec_id % 100 = 0
) WHERE place <= 6
""")
def knn_exact_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a scope: every vector whose id is divisible by 100 against all."""
    chunks = _chunks(spark, sf_dir)
    queries = chunks.where("id % 100 = 0").select(F.col("id").alias("query"), "embedding")
    return vectors.exact(chunks, queries, 64).select("query", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query()
def knn_ann_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    queries = chunks.where("id % 100 = 0").select(F.col("id").alias("query"), "embedding")
    return vectors.approximate(chunks, queries, 64).select("query", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query("""
SELECT user_id AS id, role, model, baseline, model <> baseline AS applied, k FROM (
  SELECT *, CASE WHEN complexity = 'low' AND role <> 'architect' AND baseline = 'opus' THEN 'sonnet' WHEN complexity = 'high' AND baseline = 'haiku' THEN 'sonnet' ELSE baseline END AS model FROM (
    SELECT *, CASE role WHEN 'architect' THEN 'opus' WHEN 'coder' THEN 'haiku' ELSE 'opus' END AS baseline,
      CASE role WHEN 'coder' THEN 4 ELSE 6 END AS k FROM (
      SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'architect' WHEN 1 THEN 'coder' ELSE 'tester' END AS role, CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS complexity FROM events)))
""")
def resolve_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    role = F.when(u % 3 == 0, "architect").when(u % 3 == 1, "coder").otherwise("tester")
    complexity = F.when(u % 4 == 0, "low").when(u % 4 == 1, "high").otherwise("medium")
    tasks = table(spark, sf_dir, "events").select("user_id").distinct().select(u.alias("id"), role.alias("role"), complexity.alias("complexity"), F.lit(None).cast("int").alias("k"), F.array().cast("array<string>").alias("skills_to_load"))
    models = {"architect": "opus", "coder": "haiku", "tester": "opus"}
    done = planning.resolve(tasks, models, ["haiku", "sonnet", "opus"], "sonnet", "sonnet", ["architect"], {"coder": 4})
    return done.select("id", "role", "model", "baseline", "applied", "k")


_FILES = "WITH f AS (SELECT coalesce(source, '') || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.' || coalesce(lang, '') AS path, coalesce(source, '') AS dir, n_chars FROM documents), "
_BATCHES = _FILES.replace("WITH ", "WITH RECURSIVE ", 1) + """o AS (SELECT *, row_number() OVER (ORDER BY dir, path) - 1 AS pos, sum(greatest(coalesce(n_chars, 0), 0)) OVER (ORDER BY dir, path) AS upto, greatest(coalesce(n_chars, 0), 0) AS size FROM f),
d AS (SELECT dir, min(pos) AS b, count(*) <= 20 AND sum(size) <= 80000 AS fits FROM o GROUP BY dir),
t AS (SELECT i.pos, greatest(count(j.pos), 1) AS taken FROM o i LEFT JOIN o j ON j.pos >= i.pos AND j.pos < i.pos + 20 AND j.upto - i.upto + i.size <= 80000 GROUP BY i.pos),
x AS (SELECT t.pos, CASE WHEN b > t.pos AND b < t.pos + taken AND fits THEN b ELSE t.pos + taken END AS nxt FROM t LEFT JOIN (SELECT pos, b, fits FROM o JOIN d USING (dir)) c ON c.pos = t.pos + taken),
w AS (SELECT CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS batch UNION ALL SELECT nxt, batch + 1 FROM w JOIN x ON x.pos = w.pos WHERE nxt < (SELECT count(*) FROM o)),
b AS (SELECT o.path, o.dir, o.n_chars, w.batch FROM o ASOF JOIN w ON o.pos >= w.pos)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.file_tree(table(spark, sf_dir, "documents"))


@query(_BATCHES + " SELECT path, dir, batch FROM b")
def sweep_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filling.batches(_files(spark, sf_dir)).select("path", "dir", "batch")


@query(_BATCHES + """, g AS (SELECT batch, count(*) AS n, batch % 3 <> 0 AS told FROM b GROUP BY ALL)
SELECT count(*) AS batches, count(*) FILTER (WHERE told) AS reported, CAST(coalesce(sum(n), 0) AS BIGINT) AS files, CAST(coalesce(sum(n) FILTER (WHERE told), 0) AS BIGINT) AS covered, CASE WHEN count(*) = 0 THEN 2 WHEN bool_and(told) THEN 0 ELSE 1 END AS exit_code FROM g""")
def sweep_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = filling.batches(_files(spark, sf_dir))
    return planning.coverage(planned, planned.where("batch % 3 <> 0"))


_SEARCHES = [(i, f"source{i % 4}", p, w, a, m, c) for i, (p, w, a, m, c) in enumerate([("the", None, None, "lines", 3), ("[0-9]{3}", "the", None, "lines", None), ("on", None, "en", "files", 5), (None, None, None, "lines", 1), ("zzzzqq", None, None, "lines", 0), ("th", "en", None, "files", 0)])] + [(9, "nowhere", "x", None, None, "lines", 0)]
_LINES = "WITH l AS (SELECT 'source' || doc_id % 4 AS dir, doc_id AS path, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL), "
_SEARCH_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in _SEARCHES)


@query(_LINES + f"""c(claim_id, dir, pattern, without, also, mode, claimed) AS (VALUES {_SEARCH_ROWS}),
f AS (SELECT claim_id, path, count(*) FILTER (WHERE regexp_matches(text, pattern) AND NOT coalesce(regexp_matches(text, without), false)) AS n, bool_or(also IS NULL OR regexp_matches(text, also)) AS a FROM l JOIN c USING (dir) GROUP BY ALL),
g AS (SELECT claim_id, CAST(sum(CASE WHEN a THEN n ELSE 0 END) AS BIGINT) AS n_lines, count(*) FILTER (WHERE n > 0 AND a) AS n_files FROM f GROUP BY claim_id),
t AS (SELECT c.*, CASE WHEN mode = 'files' THEN n_files ELSE n_lines END AS actual, n_lines FROM c LEFT JOIN g USING (claim_id))
SELECT claim_id, actual, CASE WHEN pattern IS NULL THEN 'uncited' WHEN n_lines IS NULL THEN 'failed' WHEN claimed IS NULL THEN 'unverified' WHEN actual = claimed THEN 'reproduced' ELSE 'mismatch' END AS status FROM t""")
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.createDataFrame(_SEARCHES, "claim_id long, dir string, pattern string, without string, also string, mode string, claimed long")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("source"), F.col("doc_id") % 4).alias("dir"), F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return searches.searched(claims, docs).select("claim_id", "actual", "status")


@query("SELECT coalesce(source, '') AS list, count(*) AS items, count(l.doc_id) AS covered, CASE WHEN count(l.doc_id) = 0 THEN 'missing' WHEN count(l.doc_id) < count(*) THEN 'incomplete' ELSE 'complete' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("list"), F.col("doc_id").alias("item"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"))
    return evidence.coverage_status(docs, docs.join(labels, "item", "left_semi"))


@query("""SELECT l_orderkey % 500 AS site, kind, baseline, actual, CASE WHEN kind = 'violations' THEN CASE WHEN actual > baseline THEN 'regressed' WHEN actual = 0 AND baseline > 0 THEN 'closed' WHEN actual < baseline THEN 'progress' END
  ELSE CASE WHEN actual = 0 AND baseline > 0 THEN 'search-broken' WHEN actual < baseline * 0.5 THEN 'search-suspect' END END AS drift
FROM (SELECT l_orderkey % 500 AS l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'violations' ELSE 'candidates' END AS kind, count(*) FILTER (WHERE l_linenumber <= 3) AS baseline, count(*) FILTER (WHERE l_returnflag = 'R') AS actual FROM lineitem GROUP BY 1, 2)""")
def baseline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_orderkey") % 2 == 0, "violations").otherwise("candidates")
    results = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("site"), kind.alias("kind")).agg(F.count_if(F.col("l_linenumber") <= 3).alias("baseline"), F.count_if(F.col("l_returnflag") == "R").alias("actual"))
    return evidence.baseline_drift(results)


_PARTS = "WITH p AS (SELECT p_partkey AS path, substr(sha256(p_name), 1, 16) AS h, substr(sha256(p_name || '!'), 1, 16) AS other FROM part), "


@query(_PARTS + """r AS (SELECT path, h AS tpl, h AS cur FROM p WHERE path % 10 <> 0), d AS (SELECT path, CASE WHEN path % 7 = 0 THEN other ELSE h END AS now FROM p WHERE path % 11 <> 0), s AS (SELECT path, CASE WHEN path % 13 = 0 THEN other ELSE h END AS template FROM p WHERE path % 17 <> 0)
SELECT path, CASE WHEN cur IS NULL AND now IS NOT NULL THEN 'untracked' WHEN cur IS NOT NULL AND now IS NULL THEN 'deleted' WHEN cur <> now THEN 'edited' ELSE 'ok' END AS local,
  CASE WHEN tpl IS NULL AND template IS NOT NULL THEN 'new' WHEN tpl IS NOT NULL AND template IS NULL THEN 'gone' WHEN tpl <> template THEN 'changed' ELSE 'ok' END AS upstream
FROM r FULL JOIN d USING (path) FULL JOIN s USING (path)""")
def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other, path = text.short_hash(F.col("p_name")), text.short_hash(F.concat("p_name", F.lit("!"))), F.col("path")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), own.alias("h"), other.alias("other"))
    recorded = p.where(path % 10 != 0).select("path", F.col("h").alias("tpl"), F.col("h").alias("cur"))
    disk = p.where(path % 11 != 0).select("path", F.when(path % 7 == 0, F.col("other")).otherwise(F.col("h")).alias("hash"))
    return upkeep.manifest_drift(recorded, disk, p.where(path % 17 != 0).select("path", F.when(path % 13 == 0, F.col("other")).otherwise(F.col("h")).alias("tpl")))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'user' END AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    user = c.where("key % 2 = 0").select("key", F.when(F.col("key") % 3 == 0, "").otherwise("user").alias("value"))
    return upkeep.merged(upkeep.merged(user, c, ["key"]), c, ["key"])


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN NOT starts_with(url, 'https://') WHEN 1 THEN false ELSE NOT starts_with(url, 'http://') END AS outside FROM pages")
def role_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("page_id") % 3 == 0, "coder").when(F.col("page_id") % 3 == 2, "tester")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(upkeep.outside_role(role, F.col("url"), {"coder": ["https://"], "tester": ["http://"]}), F.lit(False)).alias("outside"))


@query("SELECT o_orderkey AS run, o_orderdate AS mtime FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 30 DAY AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("mtime"), "o_orderstatus")
    return upkeep.retention(runs, runs.where("o_orderstatus = 'P'"), F.lit("2001-01-01").cast("timestamp_ntz")).select("run", "mtime")


@query("SELECT user_id AS run, max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 3600 SECOND AS stale FROM events GROUP BY user_id")
def stale_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("ts").alias("mtime"))
    return upkeep.stale(markers, F.lit("2024-01-31").cast("timestamp_ntz"))


@query("""WITH n AS (SELECT event_id AS seq, event_type || ' ' || user_id AS lesson FROM events), f AS (SELECT lower(lesson) AS k, min(seq) AS seq FROM n GROUP BY 1)
SELECT f.seq, n.lesson FROM f JOIN n USING (seq) ORDER BY f.seq DESC LIMIT 30""")
def lessons_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.lessons(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", "user_id").alias("lesson")))


#: A report for each document of several lines: cleared items and coverage rows about its first two words, with claims that hold for some only.
_REPORTED = """SELECT doc_id AS n, source AS src, regexp_extract(text, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 1) AS a, regexp_extract(text, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 2) AS b FROM documents
WHERE source <> '' AND regexp_extract(text, '([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)', 2) <> '' AND contains(text, chr(10))"""


@query(f"""
WITH r AS ({_REPORTED}), l AS (SELECT source AS src, doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE source <> ''),
k AS (SELECT DISTINCT src, a, b FROM r),
c AS (SELECT k.src, a, b, count(*) FILTER (WHERE contains(t, a)) AS na, count(*) FILTER (WHERE contains(t, b) AND NOT contains(t, a)) AS nb, count(DISTINCT doc_id) FILTER (WHERE contains(t, b)) AS nf FROM k JOIN l ON l.src = k.src GROUP BY ALL),
w AS (SELECT n, (1 + n % 3 <> na)::INT + (1 <> nb)::INT + (n % 5 = 0)::INT + (nf <> 2)::INT AS failing, (n % 2 = 0 OR nf > 2)::INT AS partly FROM r JOIN c USING (src, a, b))
SELECT n, CAST(3 + (n % 5 = 0)::INT AS BIGINT) AS claims, CAST(failing AS BIGINT) AS failing, CAST(partly AS BIGINT) AS partly, CASE WHEN n % 6 > 0 THEN 'complete' ELSE 'incomplete' END AS coverage, CASE WHEN failing > 0 OR partly > 0 OR n % 6 = 0 THEN 1 ELSE 0 END AS exit FROM w""")
def report_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports about the documents, read, searched again over all lines of their folders, and judged."""
    docs = table(spark, sf_dir, "documents").where("source <> ''")
    lines = docs.select(F.col("source").alias("dir"), F.col("doc_id").alias("path"), F.explode(F.split("text", "\n", -1)).alias("text"))
    word = lambda i: F.regexp_extract("text", r"([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)", i)
    known = docs.where(F.col("text").contains("\n")).select(F.col("doc_id").alias("n"), "source", word(1).alias("a"), word(2).alias("b")).where("b <> ''")
    n = F.col("n")
    cited = F.format_string("# R\n## Categories cleared\n- **A** cleared by: `grep -rn '%s' %s/` -> %d matches\n- **B** cleared by: `grep -rn \"%s\" %s | grep -v %s` -> 1 matches\n", "a", "source", 1 + n % 3, "b", "source", "a")
    third = F.when(n % 5 > 0, "- **C** — unverified, nothing to look at\n").otherwise("- **C** is fine\n")
    first_row = F.format_string("## Coverage\n| # | item | search | seen | result |\n|---|---|---|---|---|\n| 1 | words | `grep -rlF %s %s` -> 2 files | %d of 2 | none |\n", "b", "source", 1 + n % 2)
    reports = known.select("n", F.concat(cited, third, first_row, F.when(n % 6 > 0, "| 2 | other | — | — | unverified |\n").otherwise("")).alias("text"))
    expected = spark.range(1, 3).select(F.col("id").cast("int").alias("item"))
    return searches.report_verdicts(reports, lines, expected, "n")
