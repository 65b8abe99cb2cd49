"""Nested front matter: maps, lists and scalars in all their spellings."""

from runlens.sources import nested

TEXT = """---
# a comment
id: TC-1
title: "a: b # c"
empty:
expect:
  exit_code: 0   # fine
  assertions:
    - "x, y"
    - 'it''s'
covers: {requirements: [R1, "R2, R3"], other: {deep: 1}}
same:
- one
- two
history:
  - result: pass
    commit: c1
  -
    result: fail
  - [a, [b, c]]
steps: |
  first
    second
note: >-
  one
  two
"quoted key": v
---
id: not this
"""


def test_leaves():
    want = {
        "id": "TC-1", "title": "a: b # c", "empty": "", "expect.exit_code": "0", "expect.assertions.0": "x, y", "expect.assertions.1": "it's", "covers.requirements.0": "R1", "covers.requirements.1": "R2, R3", "covers.other.deep": "1",
        "same.0": "one", "same.1": "two", "history.0.result": "pass", "history.0.commit": "c1", "history.1.result": "fail", "history.2.0": "a", "history.2.1.0": "b", "history.2.1.1": "c", "steps": "first\nsecond", "note": "one two", "quoted key": "v",
    }
    assert {".".join(p): v for p, v in nested.nested_values(TEXT)} == want
    for text in ("", "no block", "---\n---\n", "---\nid: x", "---\n- \n-\n: :\n[\n{\n---\n"):
        assert isinstance(list(nested.nested_values(text)), list)


def test_cases(spark):
    got = {r["path"]: r for r in nested.cases(spark.createDataFrame([("a", TEXT), ("b", None), ("c", "none"), ("d", "---\nid: D\nrevision: x\n---\n")], "path string, text string")).collect()}
    assert set(got) == {"a", "d"} and got["d"]["revision"] is None and got["d"]["history"] == []
    a = got["a"]
    assert (a["id"], a["title"], a["expect"]["exit_code"], a["expect"]["assertions"], a["requirements"]) == ("TC-1", "a: b # c", 0, ["x, y", "it's"], ["R1", "R2, R3"])
    assert [tuple(h) for h in a["history"]] == [("pass", "c1"), ("fail", None), (None, None)]


def test_cases_are_what_the_rows_of_a_document_say_and_nothing_is_exchanged(spark):
    texts = [TEXT, "---\nid: a\nid: b\nid: ''\nhistory: {x: {result: p}, 1: {result: q, commit: ''}}\nexpect:\n  assertions: {k: v, 2: w, 1: u, 0: ''}\n  exit_code: x\n---\n", "---\nhistory: [[a, b]]\n---\n", "---\n" + "history:\n" + "".join(f"- result: r{i}\n" for i in range(12)) + "---\n", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    rows = nested.nested_rows(docs)
    want = rows.groupBy("path").agg(nested.at("id").alias("id"), nested.listed("expect", "assertions").alias("a"), nested.listed("covers", "requirements").alias("r"), nested.structs(["result", "commit"], "history").alias("h"), nested.at("last_run", "result").alias("l"))
    got = nested.cases(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.selectExpr("path", "id", "expect.assertions", "requirements", "history", "last_run.result").collect()) == sorted(want.collect())
    assert nested.cases(docs.union(docs)).count() == 8
