"""Searches of reports: commands read as searches, required texts, and the literal index against the plain join."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.operators import citations, evidence, searches


@pytest.mark.parametrize(("pattern", "text"), [
    ("abc", "abc"), ("a b=c", "a b=c"), ("ab+c", "ab"), ("abc*d", "ab"), ("abc?def", "def"), ("a\\.bc", "a.bc"), ("\\bword\\b", "word"), ("[0-9]{3}", ""), ("ab[cd]efg", "efg"), ("x(yz)w1", "w1"), ("a|b", ""), ("(a|b)cd", ""), ("(?i)abc", ""),
    ("\\Qa.b*c\\E", "a.b*c"), ("ab{2}cd", "cd"), ("ab{,", "a"), ("[]x]yz", "yz"), ("^from .* import", " import"), ("", ""), ("a\\x41b", "a"), ("\\(x\\)", "(x)"), ("a\\|bc", "a|bc"),
])
def test_required_texts(pattern, text):
    assert searches.required(pattern) == text


def test_matches_hold_what_is_required():
    rng = random.Random(4)
    for _ in range(3000):
        pattern = "".join(rng.choice(["a", "b", "ab", "c", ".", "a*", "b+", "c?", "[ab]", "(ab)", "(c)*", "a{2}", "\\.", "^", "$", "\\w", "b{0,1}"]) for _ in range(rng.randrange(6)))
        word = searches.required(pattern)
        for _ in range(20):
            text = "".join(rng.choices("abc.", k=rng.randrange(8)))
            assert not re.search(pattern, text) or word in text


def test_commands_as_searches(spark):
    rows = ["grep -rn 'a b' src/ui", 'rg -F "a.b" src/', "grep -riw x .", "grep -rl x src | grep -v 'y z' | wc -l", "cat src | grep x", "grep", None, "grep -rv x src"]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(list(enumerate(rows)), "n int, c string").orderBy("n").select(searches.search_of(F.col("c"))).collect()]
    assert got == [("a b", "src/ui", None, "lines"), ("\\Qa.b\\E", "src", None, "lines"), ("(?i)\\b(?:x)\\b", ".", None, "lines"), ("x", "src", "y z", "files"), None, None, None, None]


@pytest.mark.parametrize("per_block", [4, 20_000])
def test_the_index_gives_what_the_join_gives(spark, per_block):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choices(["alpha", "beta", "Gamma", "x1", "a.b", ""], k=rng.randrange(5)))
    lines = spark.createDataFrame([(f"d{i % 3}", f"f{i % 17}-{i % 3}", i, rng.choice([text(), text(), None])) for i in range(300)], "dir string, path string, line int, text string")
    patterns = ["alpha", "beta.*x1", "[A-Z]", "alpha|x1", "\\Qa.b\\E", "a.b", "(?i)gamma", None, "zzz", "^$", "alpha"]
    claims = [(i, f"d{i % 4}", p, w, a, m, c) for i, (p, w, a, m, c) in enumerate((p, rng.choice([None, "beta"]), rng.choice([None, None, "x1", "nothing"]), rng.choice(["lines", "files"]), rng.choice([None, 0, 3])) for p in patterns * 4)]
    frame = spark.createDataFrame(claims, "claim_id int, dir string, pattern string, without string, also string, mode string, claimed long")
    told = lambda df: sorted((r["claim_id"], r["actual"], r["status"], r["is_failing"]) for r in df.collect())
    assert told(searches.searched(frame, lines, per_block)) == told(evidence.searched(frame, lines))
    assert told(searches.searched(frame, lines.limit(0))) == told(evidence.searched(frame, lines.limit(0)))
    assert searches.searched(frame.limit(0), lines).count() == 0


def test_chunks_are_within_the_limit_and_hold_all_words(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abc", k=3)) + rng.choice(["", "", "", ".", "!"])
    texts = ["\n\n".join(rng.choice(["", "# Top\n", "  "]) + " ".join(word() for _ in range(rng.choice([1, 5, 30, 90]))) for _ in range(8)) for _ in range(20)] + ["", None, " \n\n ", "one", "x " * 500]
    got = citations.chunks(spark.createDataFrame(list(enumerate(texts)), "path int, text string"), 25).collect()
    assert max(r["words"] for r in got) <= 25 and all(len(r["text"].split()) == r["words"] > 0 for r in got)
    for i, text in enumerate(texts):
        own = sorted((r["chunk"], r["text"]) for r in got if r["path"] == i)
        assert [c for c, _ in own] == list(range(len(own))) and " ".join(t for _, t in own).split() == (text or "").split()


def test_tables_of_a_section_need_no_join(spark):
    text = "## Coverage\n| # | item | search | seen | result |\n|---|---|---|---|---|\n| 1 | w | `grep -r a b` -> 2 | 1 of 2 | none |\n## Other\n| 2 | x | `grep b c` | | 3 |\n| h |\n|---|\n| 4 | y \\| z | | `grep d` | 7 |"
    docs = spark.createDataFrame([("p", text), ("q", "| 1 | a | b | `grep e` | 2 |"), ("r", None)], "path string, text string")
    rows, declared = searches.coverage_rows(docs), citations.declared_enumerations(docs, "Other")
    assert [tuple(r) for r in rows.collect()] == [("p", 1, "grep -r a b", 2, 1, 2, False)]
    assert [tuple(r) for r in declared.collect()] == [("p", 4, "candidates", "grep d", 7)]
    for df in (rows, declared):  # rows that a join brought together were broadcast, as their size was taken for that of the files
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("per_block", [3, 200_000])
def test_plain_texts_are_counted_as_the_join_counts_them(spark, per_block):
    rng = random.Random(5)
    words = ["a", "ab", "abc", "b", "bc", "zz", "c d", "é#1"]
    text = lambda: "".join(rng.choices(["a", "b", "c", " ", "c d", "é#1", "zz"], k=rng.randrange(7)))
    lines = spark.createDataFrame([(f"d{i % 3}", f"f{i % 17}", i, rng.choice([text(), text(), None])) for i in range(400)], "dir string, path string, line int, text string")
    quoted = lambda w: rng.choice([w, f"\\Q{w}\\E"])
    claims = [(i, f"d{i % 4}", quoted(rng.choice(words)), rng.choice([None, quoted(rng.choice(words)), "[b]"]), rng.choice([None, None, None, "a"]), rng.choice(["lines", "files"]), rng.choice([None, 0, 3])) for i in range(300)]
    frame = spark.createDataFrame(claims, "claim_id int, dir string, pattern string, without string, also string, mode string, claimed long")
    told = lambda df: sorted((r["claim_id"], r["actual"], r["status"]) for r in df.collect())
    assert told(searches.searched(frame, lines, 100, per_block)) == told(evidence.searched(frame, lines))


def test_a_line_costs_what_it_holds_however_many_searches_name_its_words():
    asked = [("d", "the", f"w{i}", 1, 10 + i, False) for i in range(50_000)] + [("d", "the", None, 1, None, True)]
    batch = pa.RecordBatch.from_arrays([pa.array(["d"] * 3000), pa.array(["f"] * 3000), pa.array(["the cat"] * 2999 + ["the w7"])], ["dir", "path", "text"])
    rows = [r for out in searches._count_texts(asked, iter([batch])) for r in out.to_pylist()]
    assert sorted(map(tuple, (r.values() for r in rows))) == [(1, 3000, 1), (17, 1, 0)]


@pytest.mark.parametrize("most", [7, 60, 1 << 15])
def test_blocks_of_lines_are_counted_as_plain_loops_count_them(monkeypatch, most):
    monkeypatch.setattr(searches, "_LINES", most)
    monkeypatch.setattr(searches, "_MET", 50)
    rng = random.Random(most)
    words = ["a", "b", "é", "ab", "ba", "é#", "abc", "b.a", "aba", "abab", "c b", " ", "cabc", "😀b", "zzz"]
    files = [(folder, f"f{i}", ["".join(rng.choices(["a", "b", "c", " ", "é", "#", ".", "😀"], k=rng.choice([0, 2, 9, 40]))) for _ in range(rng.choice([1, 3, 90]))]) for folder in ("d", "e") for i in range(9)]
    pairs = [(folder, w, o, by_file) for folder in ("d", "x") for w in words for o in (None, *words) for by_file in (False, True) if rng.random() < 0.7]
    number = {}
    of = lambda *key: number.setdefault(key, len(number))
    asked = [(folder, w, o, of(folder, w), None if o is None else of(folder, w, o), by_file) for folder, w, o, by_file in pairs]
    rows = [(folder, path, text) for folder, path, lines in files for text in lines]
    cuts = sorted(rng.sample(range(len(rows)), 12))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[i:j], strict=True)], ["dir", "path", "text"]) for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True) if i < j]
    got = {r["id"]: (r["n_lines"], r["n_files"]) for out in searches._count_texts(asked, iter(batches)) for r in out.to_pylist()}
    want = {}
    for folder, w, o, _ in pairs:
        own = [lines for d, _, lines in files if d == folder]
        by = {k for f, v, x, by_file in pairs if by_file and (f, v) == (folder, w) for k in [(v,), *([(v, x)] if x is not None else [])]}
        n_lines, n_files = sum(w in t for lines in own for t in lines), sum(any(w in t for t in lines) for lines in own)
        want[of(folder, w)] = n_lines, n_files if (w,) in by else 0
        if o is not None:
            both = sum(w in t and o in t for lines in own for t in lines), sum(any(w in t for t in lines) and all(o in t for t in lines if w in t) for lines in own)
            want[of(folder, w, o)] = both[0], both[1] if (w, o) in by else 0
    assert got == {k: v for k, v in want.items() if v[0]}


def test_searches_take_one_pass_however_many_blocks(spark, monkeypatch):
    """A scan of the lines for each block of searches, one after the other and each sent by the driver, took longer than there was time."""
    lines = spark.createDataFrame([("d", f"f{i % 5}", i, f"w{i} w{i % 7}") for i in range(90)], "dir string, path string, line int, text string")
    claims = spark.createDataFrame([(i, "d", f"w{i}", None, None, "lines", 1) for i in range(60)], "claim_id int, dir string, pattern string, without string, also string, mode string, claimed long")
    written = []
    monkeypatch.setattr(searches, "materialize", lambda df, name, real=searches.materialize: written.append(name) or real(df, name))
    told = {r["claim_id"]: r["actual"] for r in searches.searched(claims, lines, texts_per_block=3).collect()}
    assert told == {i: sum(f"w{i}" in f"w{j} w{j % 7}" for j in range(90)) for i in range(60)}
    assert len(written) < 6
