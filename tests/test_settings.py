import json
import random

import pytest

from runlens.operators import settings


def plain_merge(user, template):
    if not (isinstance(user, dict) and isinstance(template, dict)):
        return user
    return {**{k: v for k, v in template.items() if k not in user}, **{k: plain_merge(v, template[k]) if k in template else v for k, v in user.items()}}


def grown(rng, deep=0):
    kind = rng.choice(["object", "object", "list", "scalar"] if deep < 4 else ["scalar"])
    if kind == "object":
        return {k: grown(rng, deep + 1) for k in rng.sample(["a", "b", 'q"uote', "1", "é\n", "", "_managed"], rng.randrange(5))}
    if kind == "list":
        return [grown(rng, deep + 1) for _ in range(rng.choice([0, 1, 3, 12]))]
    return rng.choice([None, True, False, 0, -7, 2.5, "", "x", "{}", "[]", 'a"b\\\n', 10**17])


GONE = object()


def plain_strip(value, item=False):
    """By walking: what is managed goes, and what that empties."""
    if isinstance(value, list) and value:
        left = [x for x in (plain_strip(v, True) for v in value) if x is not GONE]
        return left or GONE
    if isinstance(value, dict) and value:
        told = {k: plain_strip(v) for k, v in value.items()}
        if value.get("_managed") is True or (item and any(t is GONE and isinstance(value[k], list) for k, t in told.items())):
            return GONE
        return {k: t for k, t in told.items() if t is not GONE} or GONE
    return value


@pytest.fixture(scope="module")
def grown_documents():
    rng = random.Random(5)
    return [(i, grown(rng), grown(rng)) for i in range(120)]


def read(frame):
    return {r["doc"]: r["text"] if r["text"] is None or r["text"] == "{broken" else json.loads(r["text"]) for r in frame.collect()}


def test_documents_are_rebuilt_from_their_values(spark, grown_documents):
    docs = spark.createDataFrame([(i, json.dumps(a)) for i, a, _ in grown_documents], "doc int, text string")
    assert read(settings.rebuilt(settings.values(docs))) == {i: a for i, a, _ in grown_documents}
    assert read(settings.rebuilt(settings.values(docs, lists=False))) == {i: a for i, a, _ in grown_documents}


def test_merge_fills_what_is_missing_at_all_depths(spark, grown_documents):
    user = spark.createDataFrame([*((i, json.dumps(a)) for i, a, _ in grown_documents), (500, "{broken"), (501, None), (502, "{}")], "doc int, text string")
    template = spark.createDataFrame([*((i, json.dumps(b)) for i, _, b in grown_documents), (500, '{"a": 1}'), (501, '{"a": 1}'), (502, '{"a": {}}'), (503, "[1]"), (504, None)], "doc int, text string")
    once = settings.merged_documents(user, template)
    wanted = {**{i: plain_merge(a, b) for i, a, b in grown_documents}, 500: "{broken", 501: {"a": 1}, 502: {"a": {}}, 503: [1]}
    assert read(once) == wanted
    assert read(settings.merged_documents(once, template)) == wanted
    assert settings.merged_documents(user.limit(0), template.limit(0)).count() == 0


def test_managed_entries_go_with_what_they_leave_empty(spark, grown_documents):
    shown = {"on": {"start": [{"match": "x", "run": [{"cmd": "a", "_managed": True}]}], "stop": [{"match": "y", "run": [{"cmd": "b", "_managed": True}, {"cmd": "own"}]}, {"run": []}]}, "servers": {"s": {"_managed": True}}, "rest": {}}
    docs = [(i, a) for i, a, _ in grown_documents] + [(500, shown), (501, {"servers": {"s": {"_managed": True}}}), (502, {"_managed": "true"})]
    frame = spark.createDataFrame([*((i, json.dumps(a)) for i, a in docs), (503, "{broken"), (504, None)], "doc int, text string")
    told = {i: plain_strip(a) for i, a in docs}
    got = read(settings.without_managed(frame))
    assert got == {**{i: None if t is GONE else t for i, t in told.items()}, 503: "{broken", 504: None}
    assert got[500] == {"on": {"stop": [{"match": "y", "run": [{"cmd": "own"}]}, {"run": []}]}, "rest": {}} and got[501] is None
