"""Top-k search, periodic runs and conversation repair on odd small tables, against plain versions."""
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from bourselake.llm import periodic, repair, topk  # noqa: E402

NAN, INF = float("nan"), float("inf")


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(seed: int, n: int, width: int):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)) / 8
    smooth = np.cumsum(base, axis=1) * (rng.random((n, 1)) < 0.5) + base
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(smooth)]
    return rows + [(n, None), (n + 50, [0.1, None]), (n + 100, [NAN] * width), (n + 150, [INF] + [0.0] * (width - 1)), (-50, rows[3][1]), (None, rows[3][1])]


@pytest.mark.parametrize(("n", "width", "most"), [(330, 64, 32), (330, 40, 2048), (120, 3, 16), (90, 200, 7)])
def test_top_k_equals_all_scores(spark, n, width, most):
    rows = vectors(n, n, width)
    schema = "vec_id long, embedding array<float>, rank int, score string, id int, v int"
    df = spark.createDataFrame([(*r, 1, "s", 2, 3) for r in rows], schema).repartition(5)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, most=most).orderBy("query_id", "rank").collect()]
    assert got == brute.top_scores(rows)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, []), (50, [1e30, -1.0]), (3, [-1e30, 5.0]), (4, [1.0, 2.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()]
    top = 2 ** 63 - 1
    assert got[:3] == [(0, 1, 50, top), (0, 2, 50, top), (0, 3, 1, 256 * 256 * 5)] and [g[2:] for g in got[3:]] == [(0, top), (0, top), (1, top)]
    few = [tuple(r) for r in topk.top_k(df.where("vec_id < 3"), F.col("vec_id") == 2).orderBy("rank").collect()]
    assert few == [(2, 1, 0, 0), (2, 2, 0, 0), (2, 3, 1, 0), (2, 4, 1, 0)]


def test_bounds_never_pass_over_a_better_row():
    rng = np.random.default_rng(4)
    whole = rng.integers(-300, 300, size=(60, 48))
    block = topk.Block(np.arange(60).tobytes(), whole.tobytes(), 60)
    scores = block.x @ block.x.T
    last = np.full_like(scores, np.inf)
    for parts in (1, 2, 4, 8, 16):
        bound = block.level(48, parts) @ block.level(48, parts).T
        assert (bound >= scores - 1e-6).all() and (bound <= last + 1e-6).all()
        last = bound


def test_periodic_runs_equal_all_periods():
    rng = random.Random(7)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words, letters = [], "ab" if rng.random() < 0.5 else "abcd"
            while len(words) < rng.randint(0, 90):
                words += [rng.choice(letters) for _ in range(rng.randint(1, 8))] * rng.randint(1, 6)
            texts.append(" ".join(words))
        for text, row in zip(texts, periodic.described(pa.array(texts), None)):
            assert row["runs"] == brute.runs(text.split())


def test_periodic_query_equals_plain(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "one", "a " * 5, "a " * 6, "x y " * 4 + "x", "  é\x1cb c\x85d " * 9, " ".join(f"w{i % 700}" for i in range(6000)), "a b a b a b a b c a a b a a b a a b a a b " * 5]
    texts += [" ".join(rng.choice(["aa", "b", "c"]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    rows = [*enumerate(texts), (8, texts[8]), (None, texts[9]), (None, None)]
    schema = "doc_id long, text string, runs int, start string, key int, n_runs string"
    df = spark.createDataFrame([(*r, 1, "s", 2, "n") for r in rows], schema).repartition(4)
    got = sorted_rows(periodic.periodic_runs(df, plant=True))
    assert got == sorted(((d, *brute.periodic(d, t)) for d, t in rows), key=repr)
    whole = periodic.periodic_runs(df, whole=True).where("doc_id = 6").first()
    assert [tuple(r) for r in whole.runs] == [(0, 9, 2)] and whole.collapsed == "x y"
    assert periodic.periodic_runs(df.where("false")).count() == 0


SAID = ["Yes.", "No", "", " \t", "Why?", "ok!  \n", "x", None, "long " * 2000 + "."]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]


def talks(seed: int):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(ROLES), rng.choice(SAID)) for c in range(40) for t in range(rng.randint(1, 14)) if rng.random() < 0.9]
    return [*rows, (None, 1, "user", "Hi."), (None, None, "user", "Hi."), (7, None, "assistant", "No"), (7, None, "assistant", "No"), (90, -(2 ** 62), "user", "a."), (90, 2 ** 62, "assistant", "b.")]


@pytest.mark.parametrize(("segment", "rules"), [(1024, 512), (3, 512), (4, 0)])
def test_repair_equals_plain_search(spark, segment, rules):
    rows = talks(segment)
    schema = "conv_id long, turn long, role string, text string, key int, known string, copies string, audit int"
    df = spark.createDataFrame([(*r, 1, "k", "c", 2) for r in rows], schema).repartition(4)
    made = repair.repair(df, damage=True, segment=segment, rules=rules)
    got = {r.conv_id: tuple(r)[1:] for r in made.collect()}
    assert got == {k: (min(v[0], 2 ** 63 - 1), *v[1:]) for k, v in brute.repaired(rows).items()}
    assert repair.repair(df.where("false")).count() == 0


def test_repaired_lines(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Hello."), (1, 2, "user", "Anyone?"), (2, 0, "assistant", "Hi."), (3, 0, "system", "Be kind.")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: (r.audit, r.repaired) for r in repair.repair(df, whole=True).collect()}
    assert got == {1: ("KDR", ["user:Hello.", "assistant:Anyone?"]), 2: ("IK", ["user:", "assistant:Hi."]), 3: ("D", [])}


def test_rules_keep_the_words():
    rng = random.Random(5)
    rules, ends = [(1, 2), (8, 8), (9, 9), (11, 1)], [2, 4]
    for _ in range(200):
        word = "".join(rng.choice("uaD") for _ in range(rng.randint(0, 40)))
        symbols = repair.compressed(word, rules, ends)

        def spelt(x):
            return repair.LETTERS[x] if x < len(repair.LETTERS) else spelt(rules[x - 9][0]) + spelt(rules[x - 9][1])
        assert "".join(map(spelt, symbols)) == word
