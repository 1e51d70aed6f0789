import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from clonewright.llm import components, cutoffs

FINDING = "finding_id long, members array<struct<file:string,line:int,col:int>>, loaded_at long, extra string, n long"


def brute(findings):
    newest = {}
    for i, m, t in findings:
        if i is not None and (i not in newest or t > newest[i][1]):
            newest[i] = (m, t)
    groups = []
    for m, _ in newest.values():
        own = {":".join(map(str, x)) for x in m or [] if x is not None and None not in x}
        if own:
            groups.append(own)
    merged = True
    while merged:
        merged = False
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                if groups[i] and groups[j] and groups[i] & groups[j]:
                    groups[i] |= groups[j]
                    groups[j] = set()
                    merged = True
    return {x: min(g, key=str.encode) for g in groups for x in g}


@pytest.mark.parametrize("seed", [1, 5])
def test_groups_match_brute_force(spark, seed):
    draw = random.Random(seed)
    place = lambda: (f"é{draw.randrange(9)}.py", draw.randrange(4), draw.randrange(2))
    rows = [(i, [place() for _ in range(draw.randrange(1, 4))], 1) for i in range(30)]
    rows += [(3, [place()], 2), (40, None, 1), (41, [], 1), (42, [None, ("a", None, 1), (None, 1, 1)], 1), (43, [("z", 1, 1)] * 3, 1), (None, [("q", 1, 1)], 1)]
    rows += [(44, [("hub", 0, 0), (f"n{k}", 0, 0)], 1) if k == 0 else (100 + k, [("hub", 0, 0), (f"n{k}", 0, 0)], 1) for k in range(20)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], FINDING)
    got = {r.member: r.group_member for r in components.named_groups(components.finding_links(df)).collect()}
    assert got == brute(rows)


def test_no_findings(spark):
    empty = spark.createDataFrame([], FINDING)
    assert components.named_groups(components.finding_links(empty)).count() == 0


def test_ordered_ids_follow_bytes(spark):
    names = ["b", "a", "é", "Z", "", "b", None, "\U0001f600", "�"]
    got = components.ordered_ids(spark.createDataFrame([(n,) for n in names], "name string"), "name").orderBy("id").collect()
    assert [r.name for r in got] == sorted({n for n in names if n is not None}, key=str.encode)


def brute_cuts(scores, targets):
    best = {}
    for k, s, p in targets:
        if None not in (k, s, p):
            best[k, s] = max(p, best.get((k, s), p))
    out = {}
    for key, p in best.items():
        own = [t for k, s, t in scores if (k, s) == key and t is not None and t == t]
        if own:
            ok = [c for c in own if sum(x >= c for x in own) >= Fraction(len(own) * p, 1000)]
            cut = max(ok)
            out[key] = (cut, len(own), sum(x >= cut for x in own))
    return out


@pytest.mark.parametrize("seed", [2, 9])
def test_cutoffs_match_brute_force(spark, seed):
    draw = random.Random(seed)
    scores = [(draw.choice("ab"), draw.choice("xy"), draw.choice([0.0, -0.0, 0.25, draw.random(), draw.random(), None, float("nan")])) for _ in range(300)]
    scores += [("hot", "x", 0.5)] * 200 + [("hot", "x", 0.7)] * 3 + [("one", "x", 0.1), (None, "x", 0.2), ("gone", "x", None)]
    targets = [("a", "x", 250), ("a", "y", 1), ("b", "x", 1000), ("b", "y", 0), ("b", "y", 333), ("hot", "x", 500), ("one", "x", 500), ("gone", "x", 10), ("none", "x", 5), (None, "x", 500), ("a", "x", None)]
    rows = [(i, k, s, t, i, "c") for i, (k, s, t) in enumerate(scores)]
    df = spark.createDataFrame(rows, "finding_id long, kind string, severity string, thickness double, n long, cutoff string")
    cuts = cutoffs.cutoffs(df, spark.createDataFrame(targets, "kind string, severity string, keep int"), ["kind", "severity"], "thickness", "keep")
    want = brute_cuts(scores, targets)
    assert {(r.kind, r.severity): (r.cutoff, r.n, r.n_kept) for r in cuts.collect()} == want
    kept = cutoffs.kept(df, cuts, ["kind", "severity"], "thickness")
    assert kept.columns == df.columns
    assert sorted(r.finding_id for r in kept.collect()) == [i for i, k, s, t, *_ in rows if (k, s) in want and t is not None and t == t and t >= want[k, s][0]]


def test_cutoffs_of_nothing(spark):
    df = spark.createDataFrame([], "kind string, thickness double")
    cuts = cutoffs.cutoffs(df, spark.createDataFrame([("a", 500)], "kind string, keep int"), ["kind"], "thickness", "keep")
    assert cuts.count() == 0 and cutoffs.kept(df, cuts, ["kind"], "thickness").count() == 0


def test_latest_finding_wins(spark):
    rows = [(1, "k", "E", 0.5, 2), (1, "k", "W", 0.9, 1), (2, "k", "E", None, 1), (None, "k", "E", 0.1, 1), (1, "k", "E", 0.5, 2)]
    df = spark.createDataFrame(rows, "finding_id long, kind string, severity string, thickness double, loaded_at long")
    assert sorted(map(tuple, cutoffs.latest_findings(df).collect())) == [(1, "k", "E", 0.5), (2, "k", "E", None)]
