"""Operators that no query covers: files and folders, rules over odd texts, replays of streams."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.functions import documents, globs, text
from runlens.operators import citations, cost, evidence, registry, retrieval, upkeep
from runlens.plans import tasks
from runlens.shared import carried, discard, materialize, salted_join, shared_dir
from runlens.sources import readers, sinks
from runlens.streaming import budgets


@pytest.mark.parametrize(("path", "rules", "out"), [
    ("shop/cart.g.dart", [], True), ("shop/cart.freezed.dart", [], True), ("lib/globals.d.ts", [], True), ("rpc/orders.pb.go", [], True), ("rpc/orders_pb2.py", [], True), ("gql/query.generated.ts", [], True), ("ui/Card.snap", [], True),
    ("shop/cart.dart", [], False), ("lib/globals.ts", [], False), ("rpc/orders.go", [], False),
    ("svc/.venv/site/mod.py", [], True), ("web/node_modules/left/pad.js", [], True), ("app/build/main.dart", [], True), (".venv/mod.py", [], True), ("maps/buildings/tower.dart", [], False),
    ("seed/rows.dart", ["seed/**"], True), ("x/seed/y/rows.dart", ["seed/**"], True), ("shop/cart.g.dart", ["seed/**"], True), ("tests/test_cart.py", [], True), ("tests/test_cart.py", ["!tests/**"], False), ("shop/cart.g.dart", ["!tests/**"], True),
    ("m.dart", ["**/*.dart"], True), ("p/q/m.dart", ["**/*.dart"], True), ("p/m.kt", ["p/*.kt"], True), ("p/q/m.kt", ["p/*.kt"], False), ("hold/m", ["hold/"], True), ("m.n+o", ["m.n+o"], True), ("mXn+o", ["m.n+o"], False),
])
def test_globs(spark, path, rules, out):
    assert spark.range(1).select(globs.excluded(F.lit(path), rules)).first()[0] is out


def test_front_matter(spark):
    rows = [(1, '---\nid: t2\nrole: tester\nintent: "fix #42 crash"\nstatus: pending  # a real comment\ndepends_on: [t1, "a, b", \'c,d\' , e]\nskills_to_load:\n  - playwright\n  - \'project\'\nnone:\n---\nbody\nid: x\n'), (2, "no block"), (3, None), (4, "---\n---\n"), (5, "---\nid: a\nid: b\nk: 3\n---")]
    got = {r["n"]: r["m"] for r in spark.createDataFrame(rows, "n int, text string").select("n", documents.front_matter(F.col("text")).alias("m")).collect()}
    assert got[1] == {"id": ["t2"], "role": ["tester"], "intent": ["fix #42 crash"], "status": ["pending"], "depends_on": ["t1", "a, b", "c,d", "e"], "skills_to_load": ["playwright", "project"], "none": []}
    assert got[2] is None and got[3] is None and got[4] == {} and got[5] == {"id": ["b"], "k": ["3"]}


def test_front_matter_is_set_as_it_stands(spark):
    rows = [("---\nmodel: a\nx: 1\n---\nmodel: keep\n", "p$1\\q"), ("---\nx: 1\n---\nmodel: keep\n", "n"), ("plain", "n")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, v string").coalesce(1).select(text.set_front_matter(F.col("t"), "model", F.col("v"))).collect()]
    assert got == ["---\nmodel: p$1\\q\nx: 1\n---\nmodel: keep\n", "---\nmodel: n\nx: 1\n---\nmodel: keep\n", "plain"]


@pytest.mark.parametrize(("item", "kind", "command", "claimed"), [
    ("**Contrast** is cleared by `rg -c tint ui` → 12 uses", "search", "rg -c tint ui", 12), ("**Contrast** is cleared by `rg tint` -> 1,204 uses", "search", "rg tint", 1204),
    ("**Focus** cleared by: `rg outline` -> no uses", "search", "rg outline", 0), ("**Focus** cleared by: `rg outline` -> zero uses", "search", "rg outline", 0),
    ("**Icons** enumerated from `IconSet` (out of: `rg -c icon ui` -> 40 uses)", "search", "rg -c icon ui", 40), ("**Icons** cleared in part: `rg icon ui/a` -> 3 uses", "search", "rg icon ui/a", 3),
    ("**Focus** cleared by: `ui/nav.ts:40` (it keeps the ring)", "none", None, None), ("**Focus** is fine", "none", None, None), ("**Focus** — unverified, nothing renders it", "unverified", None, None), (None, None, None, None),
])
def test_citations(spark, item, kind, command, claimed):
    got = spark.range(1).select(citations.citation(F.lit(item).cast("string")).alias("c")).first()["c"]
    assert (got["kind"] or "none", got["command"], got["claimed"]) == (kind or "none", command, claimed)


def test_places_name_ranges_and_snippets(spark):
    got = spark.range(1).select(citations.citation(F.lit('**Size** — cleared by: `ui/nav.ts:7-9` "`const side = 44`"')).alias("c")).first()["c"]
    assert (got["kind"], got["path"], got["first"], got["last"], got["snippet"]) == ("place", "ui/nav.ts", 7, 9, "const side = 44")


def test_places_outside_are_not_run(spark):
    items = [(i, f'**Keys** cleared by: {p} "some words"') for i, p in enumerate(("../../srv/keys:3", "/srv/keys:3", "ui/Makefile:1", "`a/../b.ts:2`"))]
    told = spark.createDataFrame(items, "claim_id int, item string").select("claim_id", citations.citation(F.col("item")).alias("c")).select("claim_id", "c.*")
    there = spark.createDataFrame([("ui/Makefile", 1, "some  words")], "path string, line int, text string")
    assert {r["claim_id"]: r["status"] for r in citations.places(told, there).collect()} == {0: "unrunnable", 1: "unrunnable", 2: "reproduced", 3: "unrunnable"}


def test_citations_and_lines_are_exchanged_once_by_path(spark):
    text = spark.createDataFrame([(f"f{i}", "one\ntwo\nthree\nfour") for i in range(20)], "path string, text string")
    cited = spark.createDataFrame([(10 * i + k, f"f{i}", line, line, "two") for i in range(22) for k, line in enumerate((2, 3, 4, 900))] + [(900, None, 1, 1, "one")], "claim_id long, path string, first long, last long, snippet string")
    told = citations.places(cited, citations.lines(text))
    want = {10 * i + k: s if i < 20 else "failed" for i in range(22) for k, s in enumerate(("reproduced", "stale", "stale", "mismatch"))} | {900: "failed"}
    rows = told.collect()
    assert len(rows) == len(want) and {r["claim_id"]: r["status"] for r in rows} == want
    plan = told._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 3  # citations, lines, names of files


def test_used_searches_are_those_declared(spark):
    declared = spark.createDataFrame([("r", 1, "rg  -c a"), ("r", 2, "rg b"), ("r", 2, "rg c"), ("s", 3, None)], "report string, item int, command string")
    used = spark.createDataFrame([("r", 1, " rg -c\ta "), ("r", 1, "rg -c ab"), ("r", 2, "rg c"), ("r", 2, None), ("r", 2, " "), ("r", 9, "rg z"), ("s", 1, "rg x"), ("s", 3, "rg x")], "report string, item int, command string")
    got = sorted((r["report"], r["item"], r["command"], r["status"]) for r in evidence.undeclared(used, declared, ["report"]).collect())
    assert got == [("r", 1, "rg -c ab", "substituted"), ("r", 2, "", "uncited"), ("r", 2, "", "uncited")]


def test_headings_and_ratios(spark):
    docs = [(h, f"# R\n\n## {h}\n- **Item** — x\n  more\n\n  not this\n## Findings\n- prose\n### U1\n`a.dart:118` stops read 3.24:1, v1.2:3\n") for h in ("Sections cleared", "Categories cleared", "Dimensions with no issues", "Dimensions Cleared", "Other")]
    frame = spark.createDataFrame(docs, "path string, text string")
    assert sorted((r["path"], r["item"]) for r in citations.cleared(frame).collect()) == sorted((h, "**Item** — x more") for h, _ in docs[:4])
    assert all(len(r["sites"]) == 1 for r in citations.findings(frame).collect()) and citations.unenumerated(frame).count() == 0
    assert citations.digest_text(citations.digest(frame.limit(0).select(F.lit("").alias("skill"), "text"), frame.limit(0).select(F.lit(1).alias("pos"), F.lit("").alias("skill")))).first()[0].startswith("Enabled skills: (none)")


def test_logs_are_read_back(spark, tmp_path):
    assert readers.jsonl(spark, f"{tmp_path}/none").count() == 0 and readers.whole_text(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "log.jsonl").write_text('{"run_id":"a","tool":"x"}\n\n{broken\n{"run_id":"b"}\n')
    assert sorted(r["run_id"] for r in readers.jsonl(spark, str(tmp_path / "log.jsonl")).collect()) == ["a", "b"]
    assert readers.jsonl(spark, str(tmp_path / "log.jsonl"), strict=True).where("_corrupt_record IS NOT NULL").count() == 1
    (tmp_path / "t.md").write_text("  text \n")
    (tmp_path / "u.md").write_text(" \n")
    assert sorted(str(r["text"]) for r in readers.whole_text(spark, f"{tmp_path}/*.md").collect()) == ["None", "text"]
    events = spark.range(100).select(F.concat(F.lit("r"), F.col("id") % 2).alias("run_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), F.repeat(F.lit("x"), 50).alias("args"))
    for low, high in ((0, 7), (7, 60), (60, 100)):
        sinks.append_events(events.where(f"event_id >= {low} AND event_id < {high}"), f"{tmp_path}/out", max_bytes=1000)
    (tmp_path / "out/log/append=4/run=r0/generation=0").mkdir(parents=True)
    (tmp_path / "out/log/append=4/run=r0/generation=0/part.json").write_text('{"run_id":"r0","event_id":1000}\n')  # of an append that failed
    sinks.append_events(events.limit(0), f"{tmp_path}/empty")
    back = {r["event_id"]: r["generation"] for r in sinks.read_events(spark, f"{tmp_path}/out").collect()}
    assert back == {r["event_id"]: r["generation"] for r in sinks.generations(events, 1000).collect()} and max(back.values()) > 4
    entries = spark.createDataFrame([("p", "1", "2"), ("q", "3", None)], "path string, tpl string, cur string")
    assert sorted(map(tuple, readers.manifest(sinks.manifest_document(entries)).collect())) == [("p", "1", "2"), ("q", "3", None)]
    assert '"n":1' in sinks.index_document(spark.createDataFrame([("c", "active", "pass")], "id string, status string, last_result string")).first()[0]
    assert {r["path"].rsplit("/", 1)[1] for r in readers.files(spark, str(tmp_path / "t.md")).collect()} == {"t.md"}


def test_transcripts(spark):
    files = spark.createDataFrame([("s", "old", 1, True, False), ("s", "new", 2, True, False), ("t", "main", 9, False, False), ("u", "given", 1, False, True), ("u", "newer", 5, True, False)], "session string, path string, mtime int, subagent boolean, direct boolean")
    assert {r["session"]: r["path"] for r in readers.newest_transcript(files).collect()} == {"s": "new", "t": None, "u": "given"}


def test_rates_by_row(spark):
    used = spark.createDataFrame([("s", "opus-1", 1), ("s", "haiku-2", 2), ("s", "who", 3), ("s", None, 4)], "session string, model string, input int")
    got = {r["input"]: r["prefix"] for r in cost.prefix_join(used, cost.rates_table(spark)).collect()}
    assert got == {1: "opus", 2: "haiku", 3: "", 4: None}


def test_runs_are_recorded_in_order(spark):
    cases = spark.createDataFrame([("a", ("pass", "c1"), [("fail", "c0")], "e"), ("b", None, None, "e")], "id string, last_run struct<result:string,commit:string>, history array<struct<result:string,commit:string>>, expect string")
    runs = spark.createDataFrame([("a", 2, "fail", "c3"), ("a", 1, "error", "c2"), ("b", 1, "pass", "c2"), ("b", 2, "odd", "c3"), ("z", 1, "pass", "c2")], "id string, ts int, result string, commit string")
    got = {r["id"]: (r["last_run"]["commit"], [h["commit"] for h in r["history"]], r["expect"]) for r in registry.record(cases, runs).collect()}
    assert got == {"a": ("c3", ["c2", "c1", "c0"], "e"), "b": ("c2", [], "e")}
    assert {(r["id"], r["reason"]) for r in registry.rejected_runs(cases, runs).collect()} == {("b", "unknown result"), ("z", "unknown case")}


def test_scopes_and_stale_markers(spark):
    chunks = spark.createDataFrame([(1, "react"), (2, "fastapi")], "id int, skill string")
    assert [retrieval.scoped(chunks, a, b).count() for a, b in ((["fastapi"], ["react"]), (None, ["react"]), (None, None), ([], []))] == [1, 1, 2, 2]
    at = lambda *rows: spark.createDataFrame(rows, "run string, mtime timestamp")
    stamp = lambda s: F.timestamp_seconds(F.lit(s))
    markers = spark.range(2).select(F.when(F.col("id") == 0, "a").otherwise("b").alias("run"), stamp(0).alias("mtime"))
    logs = spark.range(1).select(F.lit("b").alias("run"), stamp(9000).alias("mtime")).unionByName(spark.range(1).select(F.lit("_no-run").alias("run"), stamp(9999).alias("mtime")))
    assert {r["run"]: r["stale"] for r in upkeep.stale(markers, stamp(10_000), 3600, logs).collect()} == {"a": True, "b": False} and at
    items = spark.range(3).select(F.col("id").alias("run"), stamp(10_000).alias("mtime"), F.col("id").alias("n_files"))
    assert [r["run"] for r in upkeep.retention(items, items.where("run = 9"), stamp(10_000)).collect()] == [0]
    assert upkeep.unmanaged(spark.createDataFrame([("e", True), ("e", False), ("f", True), ("g", None)], "event string, managed boolean")).count() == 2


def test_a_failed_batch_replaces_its_own_rows(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    out, errors = f"{tmp_path}/out", f"{tmp_path}/errors"
    budgets.isolated(stream(), lambda b: b.withColumn("x", F.lit(1)), out, errors)
    budgets.isolated(stream(), lambda b: b.withColumn("x", F.lit(1)), out, errors)
    (tmp_path / "out-checkpoint").rename(tmp_path / "gone")
    budgets.isolated(stream(), lambda b: b.withColumn("x", F.lit(1)), out, errors)
    assert spark.read.parquet(out).count() == 5
    budgets.isolated(stream(), lambda b: b.select("missing"), f"{tmp_path}/o2", errors)
    assert spark.read.json(errors).select("event").first()[0] == "hook_error"


def test_windows_of_event_time(spark, tmp_path):
    spark.range(10).select(F.timestamp_seconds(F.col("id") * 1200).alias("ts"), F.lit("t").alias("tool"), (F.col("id") % 2 == 0).alias("ok")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, tool string, ok boolean").parquet(f"{tmp_path}/in")
    budgets.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["calls"], r["failures"]) for r in spark.table("counts").collect()) == [(1, 1), (3, 1), (3, 1), (3, 2)]


def test_a_circle_stops_a_plan(spark):
    rows = spark.createDataFrame([("t1", "pending", ["t2"]), ("t2", "pending", ["t1"]), ("t3", "pending", [])], "id string, status string, depends_on array<string>")
    got = tasks.plan(rows).first()
    assert (got["id"], got["runnable"], got["exit_code"]) == (None, 0, tasks.CIRCLE)
    assert tasks.plan(rows.where("id = 't3'")).first()["exit_code"] == tasks.OK


def test_joins_of_frequent_keys(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, F.col("id") + 100_000).otherwise(F.col("id") % 2).alias("k"), "id")
    counts = materialize(rows.groupBy("k").agg(F.count("*").alias("n")), "counts")
    told = spark.range(2).select(F.col("id").alias("k"), F.col("id").alias("v")).union(spark.range(1).select(F.lit(100_003), F.lit(7)))
    joined = salted_join(rows, told, "k", counts, ["id"], per=100)
    assert joined.count() == rows.where("k < 2").count() + 1 and joined.where("k < 2 AND k <> v").count() == 0 and joined.select("id").distinct().count() == joined.count()
    path = counts._written
    discard(counts, None)
    assert path.startswith(shared_dir(spark)) and readers.whole_text(spark, path).count() == 0


def test_coverage_of_lists(spark):
    lists = lambda *rows: spark.createDataFrame(rows, "list string, item string")
    got = {r["list"]: (r["items"], r["covered"], r["status"]) for r in evidence.coverage_status(lists(("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("a", "1")), lists(("a", "1"), ("a", "x"), ("b", "1"), ("d", "1"))).collect()}
    assert got == {"a": (2, 1, "incomplete"), "b": (1, 1, "complete"), "c": (1, 0, "missing"), "d": (0, 0, "no-checklist")}


def test_running_totals_over_buckets(spark):
    rows = spark.range(200).select(F.lit("r").alias("k"), F.when(F.col("id") % 17 != 0, F.timestamp_seconds(F.col("id") * 700)).alias("ts"), "id")
    told = carried(rows, ["k"], {"before": (F.sum("id"), F.sum)}).collect()
    assert len(told) == 200
    for r in told:
        hour = r["ts"].replace(minute=0, second=0) if r["ts"] else None
        want = sum(x["id"] for x in told if (x["ts"] is None) > (r["ts"] is None) or x["ts"] and r["ts"] and x["ts"] < hour)
        assert (r["before"] or 0) == want


@pytest.mark.parametrize("seed", range(3))
def test_circles_match_plain_search(spark, seed):
    rng = random.Random(seed)
    needs = {f"t{i}": [f"t{j}" for j in rng.sample(range(40), rng.choice([0, 1, 1, 2]))] for i in range(40)}

    def reached(start):
        seen, todo = set(), [start]
        while todo:
            for n in needs[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    rows = spark.createDataFrame([(k, v) for k, v in needs.items()], "id string, depends_on array<string>")
    got = [r["id"] for r in tasks.on_circles(rows).collect()]
    assert sorted(got) == sorted(t for t in needs if t in reached(t)) and tasks.on_circles(rows.limit(0)).count() == 0


def test_a_way_between_circles_is_on_none(spark):
    rows = [("a", ["b"]), ("b", ["a", "c"]), ("c", ["d"]), ("d", ["e"]), ("e", ["d"]), ("f", ["f"])]
    assert sorted(r["id"] for r in tasks.on_circles(spark.createDataFrame(rows, "id string, depends_on array<string>")).collect()) == ["a", "b", "d", "e", "f"]
