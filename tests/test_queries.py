import difflib
import random

import pytest
from pyspark.sql import functions as F

from clonewright import queries
from clonewright.functions.model import DEFINITION_SCHEMA
from clonewright.kernels import kernel
from clonewright.operators import named

from test_passes import brute_labels, row


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def definitions(spark, path, rows):
    spark.createDataFrame(rows, DEFINITION_SCHEMA).withColumn("ingested_at", F.lit("2026-01-01").cast("timestamp")).write.parquet(f"{path}/definitions.parquet")


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A name that 120 definitions share: one cluster of 70 distinct texts, copies among them."""
    path = str(tmp_path_factory.mktemp("hot"))
    texts = ["block of calls " * 4 + chr(0x4E00 + i % 70) for i in range(120)]
    definitions(spark, path, [row(i, "main", canonical=t) for i, t in enumerate(texts)] + [row(500 + i, "pair", canonical="x") for i in range(2)])
    return path


def test_pass_named_keeps_names_of_any_size(spark, hot):
    got = {r.name: r for r in queries.pass_named(spark, hot).collect()}
    assert set(got) == {"main", "pair"}
    assert got["main"].n == 120 and got["main"].min_sim == round(120 / 122, 6)


def test_all_passes_counts_names_of_any_size(spark, hot):
    got = {(r["pass"], r.kind_id): r.n for r in queries.all_passes(spark, hot).groupBy("pass", "kind_id").agg(F.sum("n").alias("n")).collect()}
    assert got == {("name", "functions"): 2}


def test_all_passes_link_large_names_in_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(named, "BLOCK", 4)
    done = []
    paired = named._paired_blocks
    monkeypatch.setattr(named, "_paired_blocks", lambda texts, tasks, key, stages: done.append(stages) or paired(texts, tasks, key, stages))
    texts = [f"{'first' if i % 2 else 'OTHER'} " * 9 + chr(0x4E00 + i) for i in range(70)] + ["nothing like it", "0123456789"]
    definitions(spark, str(tmp_path), [row(i, "main", canonical=t) for i, t in enumerate(texts)])
    got = {(r["pass"], r.severity): r.n for r in queries.all_passes(spark, str(tmp_path)).collect()}
    assert got == {("name", "ERROR"): 2} and done == [[0], [1], [2], [0, 1, 2]]


def clusters(spark, texts, floor):
    """(members, least ratio) of every cluster that the kernel finds, by first member."""
    made = kernel(spark, "NameClusters", "array<struct<rep:bigint,cluster:bigint,min_sim:double>>")
    one = spark.createDataFrame([(list(range(len(texts))), texts, floor)], "reps array<bigint>, texts array<string>, floor double")
    found = {}
    for r in one.select(F.inline(made("reps", "texts", "floor"))).collect():
        found.setdefault((r.cluster, r.min_sim), []).append(r.rep)
    return sorted((own, least) for (_, least), own in found.items())


def texts_of(seed):
    draw = random.Random(seed)
    texts = ["", "a"]
    for letters in ("ab", "abcdef", "abcdefghi \u00e9\u6f22\U0001f600"):
        base = [draw.choice(letters) for _ in range(60)]
        for _ in range(8):
            own = [c for c in base if draw.random() < 0.85]
            own.insert(draw.randrange(len(own)), draw.choice(letters))
            texts.append("".join(own))
    return texts


@pytest.mark.parametrize("floor", [0.0, 0.4, 0.6, 0.8, 0.95])
def test_kernel_clusters_match_difflib(spark, floor):
    texts = texts_of(6)
    pairs = {(i, j): ratio(texts[i], texts[j]) for j in range(len(texts)) for i in range(j)}
    label = brute_labels([p for p, r in pairs.items() if r >= floor])
    want = []
    for k in sorted(set(label.values())):
        own = sorted(i for i, x in label.items() if x == k)
        want.append((own, min(pairs[i, j] for y, j in enumerate(own) for i in own[:y])))
    assert clusters(spark, texts, floor) == want


def test_kernels_of_two_sides_match_difflib(spark):
    texts = texts_of(7)
    sides = [i % 2 for i in range(len(texts))]
    across = {(i, j): ratio(texts[i], texts[j]) for j in range(len(texts)) for i in range(j) if sides[i] != sides[j]}
    one = spark.createDataFrame([(list(range(len(texts))), texts, sides)], "reps array<bigint>, texts array<string>, sides array<bigint>")
    joined = kernel(spark, "BlockLinks", "array<struct<a:bigint,b:bigint>>")
    edges = [(r.a, r.b) for r in one.select(F.inline(joined("reps", "texts", "sides", F.lit(0.6)))).collect()]
    assert brute_labels(edges) == brute_labels([p for p, r in across.items() if r >= 0.6])
    least = kernel(spark, "BlockLeast", "double")
    assert one.select(least("texts", "sides", F.lit(1.0))).first()[0] == min(across.values())


def test_known_groups_are_not_compared_again(spark):
    texts = texts_of(8)
    n = len(texts)
    sides = [i % 2 for i in range(n)]
    groups = [100 + (i % 3 if i % 5 == 0 else 10 + i) for i in range(n)]
    across = {(i, j) for j in range(n) for i in range(j) if sides[i] != sides[j] and ratio(texts[i], texts[j]) >= 0.6}
    known = [(groups.index(g), i) for i, g in enumerate(groups) if groups.index(g) != i]
    one = spark.createDataFrame([(list(range(n)), texts, sides, groups)], "reps array<bigint>, texts array<string>, sides array<bigint>, groups array<bigint>")
    further = kernel(spark, "FurtherLinks", "array<struct<a:bigint,b:bigint>>")
    edges = [(r.a, r.b) for r in one.select(F.inline(further("reps", "texts", "sides", F.lit(0.6), "groups"))).collect()]
    assert known and edges and brute_labels(edges + known) == brute_labels([*across, *known])
    assert not {b for _, b in edges} & {b for _, b in known}


def test_kernel_of_many_long_texts_matches_difflib(spark):
    draw = random.Random(9)
    parts = ["".join(draw.choice("abcdefgh(), ") for _ in range(k)) for k in (3, 5, 9, 12, 17, 20, 33, 40, 70) for _ in range(3)]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(3, 14))) for _ in range(34)]
    pairs = {(i, j): ratio(texts[i], texts[j]) for j in range(len(texts)) for i in range(j)}
    for floor in (0.3, 0.5):
        label = brute_labels([p for p, r in pairs.items() if r >= floor])
        want = [sorted(i for i, x in label.items() if x == k) for k in sorted(set(label.values()))]
        assert clusters(spark, texts, floor) == [(own, min(pairs[i, j] for y, j in enumerate(own) for i in own[:y])) for own in want]


def test_long_repetitive_texts_go_through_the_automaton(spark):
    a, b, c = "ab" * 6000, "ab" * 5000, "x" + "ab" * 5500
    assert clusters(spark, [a, b], 0.5) == [([0, 1], 2 * 10000 / 22000)]
    assert clusters(spark, [a, c], 0.5) == [([0, 1], 2 * 11000 / 23001)]


def test_texts_of_many_letters_are_counted_at_fewer_places(spark):
    draw = random.Random(11)
    a = "".join(chr(0x4E00 + draw.randrange(9_000)) for _ in range(60_000))
    b = a[:20_003] + a[29_998:]  # 120,000 / 32 places of 9,000 counts are too many
    assert clusters(spark, [a, b], 0.5) == [([0, 1], 2 * len(b) / (len(a) + len(b)))]


def test_canonical_forms_of_every_language(spark, tmp_path):
    texts = {"py": "def f(a):\n    b = a + 1\n    return b\n", "ts": "function f(a) {\n  const b = a + 1;\n  return b;\n}\n", "rs": "fn f(a: i32) -> i32 {\n    let b = a + 1;\n    b\n}\n"}
    rows = [(r[0], lang, *r[2:]) for i, (lang, t) in enumerate(texts.items()) for r in [row(i, "f", text=t)]]
    definitions(spark, str(tmp_path), [*rows, row(9, "broken", text="def f(")])
    got = {r.def_id: r for r in queries.canonical_forms(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2}
    assert all(r.xname and r.n_lines > 0 and r.size > 0 for r in got.values())
