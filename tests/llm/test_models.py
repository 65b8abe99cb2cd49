import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from runlens.llm import chat, langid, queries
from runlens.llm.common import discard, materialize, settled, shared_dir

from .conftest import DATA
from .test_decontam import flat, holds
from .test_dedup import brute_components, brute_lines


def brute_entropy(texts, text, symbols):
    """Cross-entropy of text under an interpolated Kneser-Ney model of order 4, by plain counting."""
    fold = lambda t: "\x01\x01\x01" + "".join(c.lower() if c.isalpha() else " " for c in t)
    squeeze = lambda t: "".join(c for i, c in enumerate(t) if not (c == " " and i and t[i - 1] == " "))
    runs = lambda t: [t[i - 3 : i + 1] for i in range(3, len(t))]
    tables = {4: Counter(g for t in texts for g in runs(squeeze(fold(t))))}
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discount, total, kinds = {}, defaultdict(int), defaultdict(int)
    for k, table in tables.items():
        ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        discount[k] = min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))
        for g, v in table.items():
            total[k, g[:-1]] += v
            kinds[k, g[:-1]] += 1

    def p(k, g):
        if k == 0:
            return 1 / symbols
        context = (k, g[:-1])
        if not total[context]:
            return p(k - 1, g[1:])
        return max(tables[k][g] - discount[k], 0) / total[context] + discount[k] * kinds[context] / total[context] * p(k - 1, g[1:])

    own = runs(squeeze(fold(text)))
    return -sum(math.log2(p(4, g)) for g in own) / len(own)


def test_language_model_matches_plain_counting(spark, awkward, empty):
    rng = random.Random(6)
    say = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(30))
    by = {"a": [say("abcde") for _ in range(8)], "b": [say("cdefg") for _ in range(8)]}
    model = langid.learn(spark.createDataFrame([(i, x, t) for x in by for i, t in enumerate(by[x])], "doc_id long, lang string, text string"))
    symbols = len({c for ts in by.values() for t in ts for c in t}) + 1
    for text in (say("abcde"), say("defgz"), "a"):
        bits, _, _ = model.score([text])
        assert bits[0].tolist() == pytest.approx([brute_entropy(by[x], text, symbols) for x in ("a", "b")], rel=1e-4)
    told = {r["doc_id"]: r for r in langid.identify(awkward, model).collect()}
    assert [told[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and told[0]["rejected"]
    assert langid.identify(empty, model).count() == 0 and langid.learn(empty) is None


def test_symbols_beyond_the_basic_plane(spark):
    codes, begins = langid.symbols(["a\U00020000b", "😀😀x", "", "\U00010400"])
    start = [1, 1, 1]
    assert codes.tolist() == [*start, 97, 0xD840, 0xDC00, 98, *start, 32, 120, *start, *start, 0xD801, 0xDC28] and begins.tolist() == [0, 7, 12, 15, 20]
    rng = random.Random(2)
    kinds = [chr(0x20000 + i) for i in range(0, 40_000, 13)]
    model = langid.learn(spark.createDataFrame([("a", "".join(rng.choices(kinds, k=3000))), ("b", "".join(rng.choices(kinds[::2], k=3000)))], "lang string, text string"))
    assert model.tables.where("k = 1 AND lang = 'b'").count() <= len(kinds[::2]) + 1024


def test_long_texts_are_scored_in_windows(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 6))) for _ in range(n)) for n in (3, 400_000, 1)]
    model = langid.learn(spark.createDataFrame([("a", t) for t in texts], "lang string, text string"))
    model = model.sent(0).value
    whole, n, letters = model.sums(texts)
    packed = langid.grams(langid.symbols(texts[1:2])[0])[1]
    assert n[1] == len(packed) > 1 << 20 and letters.all() and whole[1, 0] == pytest.approx(-model._log(langid.ORDER, packed).sum(dtype=float), rel=1e-6)


def test_a_stray_label_has_a_limit_of_its_own(spark):
    rng = random.Random(9)
    say = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(n))
    rows = [(i, "ab"[i % 2], say(("abcde", "cdefg")[i % 2], 6)) for i in range(12_000)]
    strays = [(20_000 + i, x, say("hijklmnop", 60)) for i, x in enumerate(("xx", "yy", "zz"))]
    foreign = spark.createDataFrame([(i, say("qrstuvwxyzäöüßéèñ", 80)) for i in range(20)], "doc_id long, text string")
    for stray in strays:
        model = langid.learn(spark.createDataFrame([*rows, stray], "doc_id long, lang string, text string"))
        assert np.isfinite(model.limits).all()
        assert langid.identify(foreign, model).where("rejected").count() == 20
        assert langid.identify(spark.createDataFrame([stray, rows[0]], "doc_id long, lang string, text string"), model).where("rejected").count() == 0


def test_a_label_never_predicted_takes_the_pooled_limit(spark):
    rows = [(i, x, "abab baba abba") for i in range(4) for x in "ab"]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert (model.limits[0] == model.limits[1]).all()


def test_few_texts_show_no_tail(spark):
    rng = random.Random(14)
    say = lambda: " ".join("".join(rng.choices("ab", k=4)) for _ in range(30))
    model = langid.learn(spark.createDataFrame([(x, say()) for _ in range(40) for x in "ab"], "lang string, text string"))
    assert (model.limits[0, :5] == model.limits[1, :5]).all() and np.isinf(model.limits[:, 4]).all()
    known, odd = "abba abab", "bzqx jvkw" * 20
    told = langid.identify(spark.createDataFrame([(0, known), (1, odd)], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["rejected"] for r in told.collect()} == {0: False, 1: True}


def test_rejection_by_held_back_texts(spark):
    """Known texts of all lengths stay, foreign ones and random letters go."""
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").where("lang IS NOT NULL")
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.learn(docs.where(seen != 1))
    known = langid.identify(docs.where(seen == 1), model, ["doc_id", "lang"]).where("lang_pred = lang")
    assert known.where("rejected").count() <= 0.001 * known.count()
    rng = random.Random(3)
    strange = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(60)) for _ in range(20)]
    strange += ["Съешь ещё этих мягких французских булок да выпей чаю", "Pchnąć w tę łódź jeża lub ośm skrzyń fig, zażółć gęślą jaźń", "Törkylempijävongahdus, hyvää yötä ja huomenta kaikille ystäville"]
    gone = langid.identify(spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string"), model).where("rejected").count()
    assert gone == len(strange)


def test_no_sequence_is_left_out_however_many_there_are(spark):
    rng = random.Random(10)
    say = lambda first: "".join(chr(first + rng.randrange(4000)) for _ in range(20_000))
    by = {"a": [say(0x4E00), say(0x4E00)], "b": [say(0x5800)]}
    labelled = spark.createDataFrame([(i, x, t) for x in by for i, t in enumerate(by[x])], "doc_id long, lang string, text string")
    symbols = len({c for ts in by.values() for t in ts for c in t}) + 1
    docs = spark.createDataFrame([(0, by["a"][0]), (1, by["b"][0][:500]), (2, say(0x5200)[:300]), (3, None), (4, "?!"), (2, "again")], "doc_id long, text string")
    told = []
    for cells in (1 << 23, 60_000):
        model = langid.learn(labelled, cells=cells)
        bits, _, _ = model.score([by["a"][0][:2000]])
        assert bits[0].tolist() == pytest.approx([brute_entropy(by[x], by["a"][0][:2000], symbols) for x in by], rel=1e-4)
        told.append((len(model.pieces), sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in langid.identify(docs, model).collect())))
    assert told[0][0] == 1 < told[1][0] and told[0][1] == told[1][1] and len(told[0][1]) == 6
    tables = model.tables.where("k = 4 AND lang = 'a'")
    assert tables.count() == len({("\x01\x01\x01" + t)[i : i + 4] for t in by["a"] for i in range(len(t))})


def test_pieces_keep_to_their_size_where_one_symbol_has_half_of_all_places(spark):
    rng = random.Random(12)
    say = lambda first, n: "".join(" " + chr(first + rng.randrange(300)) for _ in range(n))
    by = {"a": say(0x4E00, 20_000), "b": say(0x4E80, 20_000), "c": say(0x5200, 40), "d": say(0x5200, 40)}
    labelled = spark.createDataFrame(list(by.items()), "lang string, text string")
    cells = 8_000
    model = langid.learn(labelled, cells=cells)
    assert [p[:2] for p in model.pieces if p[3] == 1] == [(2, 4)] and {p[:2] for p in model.pieces if p[3] > 1} == {(0, 1), (1, 2)}
    for i, (_, _, _, parts) in enumerate(model.pieces):
        longer = sum(len(model.sent(i).value.logs[k]) for k in (2, 3))
        assert longer <= 2 * cells if parts > 1 else longer * 2 <= cells
    symbols = len({c for t in by.values() for c in t}) + 1
    bits, _, _ = model.score([by["a"][:500]])
    assert bits[0].tolist() == pytest.approx([brute_entropy([t], by["a"][:500], symbols) for t in by.values()], rel=1e-4)
    whole = langid.learn(labelled)
    docs = spark.createDataFrame([(i, t[:n]) for i, t in enumerate(by.values()) for n in (1, 7, 300)], "doc_id long, text string")
    rows = lambda m: sorted((r["doc_id"], r["n_symbols"], r["lang_pred"], round(r["score"], 5), r["rejected"]) for r in langid.identify(docs, m).collect())
    assert len(whole.pieces) == 1 and rows(whole) == rows(model)


def test_limits_follow_the_tail_of_held_back_texts():
    normal = np.quantile(np.random.default_rng(1).normal(size=100_000), langid.QUANTILES)
    heavy = np.quantile(np.random.default_rng(1).exponential(size=100_000) * 2, langid.QUANTILES)
    assert 6 < langid._reach(list(normal)) < 14 < 30 < langid._reach(list(heavy)) < 55 and langid._reach([0.0, 0.0, 0.0]) == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    told = queries.op1_language_id(spark, f"{DATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right = told.where("lang = lang_pred").count()
    assert right >= 0.95 * told.count() > 0


def test_reply_trees(spark):
    rng = random.Random(8)
    nodes = [(c, i, rng.randrange(i) if i else None, "assistant" if i % 2 else "user", f"<|m{i}\\", float(rng.randrange(9))) for c in range(4) for i in range(12)]
    got = chat.best_paths(spark.createDataFrame(nodes, "conv_id long, node_id long, parent_id long, role string, text string, score double"), 2).collect()
    for c in range(4):
        parent = {i: p for cc, i, p, *_ in nodes if cc == c}
        score = {i: s for cc, i, _, _, _, s in nodes if cc == c}
        paths = []
        for leaf in set(parent) - set(parent.values()):
            way = [leaf]
            while parent[way[-1]] is not None:
                way.append(parent[way[-1]])
            paths.append((-sum(score[i] for i in way) / len(way), -len(way), leaf, way[::-1]))
        for k, (*_, way) in enumerate(sorted(paths)[:2], 1):
            assert [r["node_id"] for r in sorted(got, key=lambda r: r["pos"]) if (r["conv_id"], r["path"]) == (c, k)] == way


def test_awkward_reply_trees(spark, empty):
    schema = "conv_id long, node_id long, parent_id long, role string, text string, score double, path long, pos long"
    rows = [
        (1, 1, None, "user", None, None, 9, 9), (1, 2, 1, None, "", 1.0, 9, 9), (1, 3, 1, "assistant", "b", 1.0, 9, 9), (1, 3, 1, "assistant", "a", 1.0, 9, 9),  # a tie, and a repeated node_id
        (2, 1, 2, "user", "x", 0.0, 9, 9), (2, 2, 1, "user", "y", 0.0, 9, 9),  # a circle
        (3, 5, 4, "assistant", "lone", None, 9, 9), (3, 5, 4, "assistant", "lone", None, 9, 9),  # a parent that isn't there, repeated rows
        (None, 1, None, "user", "n", None, 9, 9), (None, 2, 1, "assistant", "m", None, 9, 9), (4, None, None, "user", "z", None, 9, 9),
    ]
    trees = spark.createDataFrame(rows, schema)
    told = {}
    for r in chat.best_paths(trees, 2).collect():
        told.setdefault((r["conv_id"], r["path"]), []).append((r["pos"], r["node_id"], r["text"]))
    assert {k: sorted(v) for k, v in told.items()} == {(1, 1): [(0, 1, None), (1, 2, "")], (1, 2): [(0, 1, None), (1, 3, "a")], (3, 1): [(0, 5, "lone")], (None, 1): [(0, 1, "n"), (1, 2, "m")]} | ({(4, 1): told[4, 1]} if (4, 1) in told else {})
    whole = {r["conv_id"]: r for r in chat.parse_formatted(chat.format_chats(trees)).collect()}
    assert [(t["role"], t["text"]) for t in whole[1]["turns"]] == [("user", ""), ("", "")] and whole[None]["loss_text"] == "m"
    assert chat.format_chats(trees.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "<|turn|>\\"), (1, 0, "user", "<|turn|>\\"), (1, None, None, None), (2, 5, "assistant", "x" * 300_000)], "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat.parse_formatted(chat.format_chats(chat.as_reply_trees(rows))).collect()}
    assert [t["text"] for t in back[1]["turns"]] == ["", "<|turn|>\\", "<|turn|>\\"] and len(back[2]["loss_text"]) == 300_000
    assert chat.format_chats(chat.as_reply_trees(rows.limit(0))).count() == 0


CLASH = ["lang_pred", "score", "cross_entropy", "n_symbols", "rejected", "n_lines", "n_dropped", "node", "version", "row", "_gone", "_bad", "_text", "key", "kept", "component_id", "start", "label"]


def test_pipeline_stages_on_awkward_rows(spark, awkward, empty):
    """Nulls, empty and very long texts, repeated rows, empty tables, and columns named like those of the stages."""
    extra = [F.lit(i).alias(c) if i % 2 else F.lit(f"own {c}").alias(c) for i, c in enumerate(CLASH)]
    docs = awkward.drop("node", "label", "start").select("*", *extra)
    docs = corpus_pipeline.materialize(docs, "awkward")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty.drop("node", "label", "start").select("*", *extra), f"{DATA}/sf0.001").count() == 0
        out = corpus_pipeline.materialize(stage(spark, docs, f"{DATA}/sf0.001"), name)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[c] == (i if i % 2 else f"own {c}") for r in rows for i, c in enumerate(CLASH))
        ids = sorted(str(r["doc_id"]) for r in rows)
        if name == "language_id":
            assert not {"0", "1", "2"} & set(ids) and len(ids) == docs.count() - 3
        if name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in (8, 9, 10)} == {8: "second", 9: "x\ny", 10: "\n".join(["A line that many documents share, word for word"] * 2)}
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None and r["n_chars"] is not None)
        if name == "near_dedup":
            assert ids.count("5") == 1 and ids.count("9") == 1 and "6" not in ids and "7" not in ids and "None" in ids
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def brute_pipeline(docs, benchmark):
    """Line dedup, near-dedup and decontamination by plain loops on (doc_id, text)."""
    texts = {d: t for d, (_, _, t) in brute_lines(docs).items()}
    groups = brute_components(list(texts.items()), 5, 80)
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    return {d: t for d, t in texts.items() if not any(holds(flat(item), flat(t)) for item in benchmark)}


def test_pipeline_matches_plain_loops(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))
    benchmark = [" ".join(word() for _ in range(20)) for _ in range(3)]
    shared = ["a footer line that recurs in many documents", "another line that is in several of them too"]
    base = [[word() for _ in range(110)] for _ in range(25)]
    docs = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(110)] = word()
        rows = [" ".join(words)] + [x for x in shared if rng.random() < 0.3] + ([rng.choice(benchmark).upper()] if rng.random() < 0.2 else [])
        docs.append((i, "\n".join(rows), "en", "s", None))
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    want = brute_pipeline([(d, t) for d, t, *_ in docs], benchmark)
    pieces = corpus_pipeline.run(spark, sf).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids.setdefault(p["doc_id"], []).extend(np.frombuffer(p["ids"], "<u4").tolist())
    assert ids == {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in want.items()} and 10 < len(want) < 70


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, f"{DATA}/sf0.001"), name)
        assert docs.columns == columns and 0 < docs.count() <= rows
        rows = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, f"{DATA}/sf0.001")
    assert pieces.select("doc_id").distinct().count() == rows


def test_the_row_that_stays_does_not_depend_on_the_order_of_rows(spark):
    row = lambda x: spark.createDataFrame([(1, "the same words in both rows of it", "en", "s", 33, x)], "doc_id long, text string, lang string, source string, n_chars long, other string")
    kept = lambda one, two: [r["other"] for r in corpus_pipeline.near_dedup(spark, row(one).union(row(two)), "").collect()]
    assert kept("a", "b") == kept("b", "a") == ["a"] and kept(None, "a") == kept("a", None)


def test_only_results_stay_in_the_shared_folder(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    inner = lambda: materialize(materialize(spark.range(3), "step"), "other").withColumn("x", F.lit(1))
    out = settled(spark, "result", lambda: settled(spark, "middle", inner).where("id > 0"))
    assert out.count() == 2 and [p.name.partition("-")[0] for p in set(folder.iterdir()) - before] == ["result"]
    discard(out)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert {x for x in left if x.startswith("stage-")} == {"stage-decontamination"} and len(left) == 1
