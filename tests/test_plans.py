"""Plans against plain loops: batches and their order."""

import random

import pytest

from runlens.plans import filling, order, tasks


def plain_fill(rows, most, chars):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    folders = {}
    for k, r in enumerate(rows):
        folders.setdefault(r[1], []).append(k)
    out, i, batch = {}, 0, 0
    while i < len(rows):
        j, total = i, 0
        while j < len(rows) and j - i < most and (j == i or total + rows[j][2] <= chars):
            total += rows[j][2]
            j += 1
        own = folders[rows[j][1]] if j < len(rows) else []
        if own and i < own[0] < j and len(own) <= most and sum(rows[k][2] for k in own) <= chars:
            j = own[0]
        out |= {rows[k][0]: batch for k in range(i, j)}
        i, batch = j, batch + 1
    return out


@pytest.mark.parametrize(("seed", "n", "most", "chars"), [(1, 5000, 7, 50), (2, 1200, 20, 300), (3, 1, 3, 3), (4, 1100, 1, 10)])
def test_batches_are_those_of_a_plain_fill(spark, seed, n, most, chars):
    rng = random.Random(seed)
    folder = lambda: f"d{rng.choice([rng.randrange(3), rng.randrange(n // 4 + 1)])}"
    rows = [(f"{d}/f{i}", d, rng.choice([1, 5, 9, rng.randrange(60)])) for i, d in ((i, folder()) for i in range(n))]
    files = spark.createDataFrame(rows, "path string, dir string, n_chars long")
    got = {r["path"]: r["batch"] for r in filling.batches(files, most, chars).collect()}
    assert got == plain_fill(rows, most, chars)


def test_batches_of_odd_files(spark):
    rows = [("a", None, None, 1), ("b", "", -5, 2), ("c", "x", 200_000, 3), ("d", "x", 100, 4)]
    files = spark.createDataFrame(rows, "path string, dir string, n_chars long, batch int")
    assert {r["path"]: r["batch"] for r in filling.batches(files).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}
    assert filling.batches(files.limit(0)).count() == 0


def plain_levels(needs):
    """Longest ways by plain peeling; what is never free is on or above a circle."""
    left, out, level = {k: {n for n in v if n in needs} for k, v in needs.items()}, dict.fromkeys(needs), 0
    while free := [k for k, v in left.items() if not v]:
        for k in free:
            out[k] = level
            del left[k]
        left = {k: v - set(free) for k, v in left.items()}
        level += 1
    return out


def plain_circles(needs):
    def reached(start):
        seen, todo = set(), [start]
        while todo:
            for n in needs.get(todo.pop(), ()):
                if n in needs and n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    return sorted(t for t in needs if t in reached(t))


def tasks_of(spark, needs):
    return spark.createDataFrame(list(needs.items()), "id string, depends_on array<string>")


@pytest.mark.parametrize("kind", ["sparse", "chains", "circles"])
def test_levels_and_circles_match_plain_search(spark, kind):
    rng = random.Random(kind)
    n = 60
    if kind == "sparse":
        needs = {f"t{i}": [f"t{rng.randrange(i)}" for _ in range(rng.choice([0, 1, 1, 2]))] if i else [] for i in range(n)}
    elif kind == "chains":  # chains that branch and meet, with a leaf here and there, and what no task is
        needs = {f"t{i}": [f"t{i - 1}"] * (i % 13 > 0) + [f"t{i // 2}"] * (i % 11 == 5) + ["gone"] * (i % 17 == 0) for i in range(n)}
    else:  # circles of chains, one behind another, a pure one, and ways to and from them
        needs = {f"t{i}": [f"t{i - 1}"] if i % 10 else [f"t{i + 9}"] for i in range(n)} | {"t15": ["t14", "t3"], "t28": ["t27", "t12"], "x": ["t28"], "y": ["x"], "z": ["z"], "w": [], "t40": ["t49", "w"]}
    tasks_ = tasks_of(spark, needs)
    assert {r["id"]: r["level"] for r in tasks.levels(tasks_).collect()} == plain_levels(needs)
    assert sorted(r["id"] for r in tasks.on_circles(tasks_).collect()) == plain_circles(needs)


def test_a_long_chain_takes_few_rounds(spark):
    n = 100_000
    ids = spark.range(n).select("id")
    state = order.contract(ids, spark.range(1, n).selectExpr("id", "id - 1 AS needs"))
    assert state.rounds < 5 and state.nodes.isEmpty()
    got = tasks.levels(spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN array(id - 1) ELSE array() END AS depends_on"))
    assert got.count() == n and got.where("level <> id OR level IS NULL").count() == 0
    circle = spark.range(n).selectExpr("id", f"array((id + 1) % {n}) AS depends_on")
    assert tasks.on_circles(circle).count() == n and tasks.levels(circle).where("level IS NOT NULL").count() == 0


def test_joins_of_tasks_are_never_broadcast(spark):
    """Files of ids are small and what is read from them isn't: with every size taken for small, no join may go through the driver."""
    chain = spark.range(400).selectExpr("CAST(id AS STRING) AS id", "'pending' AS status", "CASE WHEN id % 5 > 0 THEN array(CAST(id - 1 AS STRING)) WHEN id % 3 = 0 THEN array(CAST(id + 4 AS STRING)) ELSE CAST(array() AS array<string>) END AS depends_on")
    sent = []
    write = type(spark.range(1).write).parquet

    def spied(self, *a, **k):
        sent.append("Broadcast" in self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *a, **k)

    type(spark.range(1).write).parquet = spied
    try:
        assert tasks.on_circles(chain).count() == 5 * len([n for n in range(0, 400, 5) if n % 3 == 0])
        tasks.levels(chain)
    finally:
        type(spark.range(1).write).parquet = write
    assert len(sent) > 10 and not any(sent)
    for df in (tasks.readiness(chain), tasks.invalid_deps(chain), tasks.single_task(chain, chain.select("id"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
