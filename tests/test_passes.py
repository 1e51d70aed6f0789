import difflib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clonewright.functions.model import DEFINITION_SCHEMA, KINDS
from clonewright.operators import graph, named
from clonewright.operators.graph import smallest_label
from clonewright.operators.named import BLOCK, large_name_groups, named_clusters, named_findings
from clonewright.operators.nearcopy import TOKEN, type3_clusters, type3_findings
from clonewright.operators.renamed import renamed_findings


def kind(k):
    return tuple(getattr(KINDS[k], f) for f in ("id", "label", "noun_plural", "section", "body", "fn_like"))


def row(i, name, k="functions", canonical=None, text="t", analysis=None, file=None, loc=3, args=1):
    return (i, "py", kind(k), name, file or f"f{i}.py", i, 0, loc, args, text, canonical, analysis)


def table(spark, rows):
    return spark.createDataFrame(rows, DEFINITION_SCHEMA)


def brute_labels(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize(("seed", "at_once"), [(1, 0), (1, 100_000), (2, 40)])
def test_components_match_brute_force(spark, monkeypatch, seed, at_once):
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    draw = random.Random(seed)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(5, 5), (1, 2), (2, 1), (1, 2)]
    chain = [(k, k + 1) for k in range(100, 160)]
    hub = [(999, k) for k in range(200, 260)]
    edges += chain + hub
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    assert {r.id: r.label for r in smallest_label(df).collect()} == brute_labels(edges)


def test_components_of_nothing(spark):
    assert smallest_label(spark.createDataFrame([], "a long, b long")).count() == 0


def test_named_clusters_small_and_blocked_agree_with_brute_force(spark):
    draw = random.Random(3)
    words = ["".join(draw.choice("abc") for _ in range(8)) for _ in range(BLOCK + 20)]
    rows = [row(i, "same", canonical=w) for i, w in enumerate(words)]
    rows += [row(1000 + i, "few", canonical=w) for i, w in enumerate(words[:6])]
    rows += [row(2000, "pair", canonical="x"), row(2001, "pair", canonical="x"), row(2002, "pair", canonical=None), row(2003, None, canonical="x")]
    got = {r.def_id: (r.cluster, r.min_sim) for r in named_clusters(table(spark, rows), 0.7).collect()}

    def ratio(a, b):
        return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()

    for base, own in ((0, words), (1000, words[:6])):
        pairs = {(i, j): ratio(own[i], own[j]) for j in range(len(own)) for i in range(j)}
        label = brute_labels([p for p, r in pairs.items() if r >= 0.7])
        for i in range(len(own)):
            if i in label:
                inside = [r for (x, y), r in pairs.items() if label.get(x) == label[i] == label.get(y)]
                assert got[base + i] == (base + label[i], min(inside))
            else:
                assert base + i not in got
    assert got[2000] == got[2001] == (2000, 1.0) and 2002 not in got and 2003 not in got


def test_named_clusters_in_stages_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(named, "BLOCK", 5)
    draw = random.Random(4)
    words = sorted({"".join(draw.choice("abcd") for _ in range(9)) for _ in range(110)})
    draw.shuffle(words)
    done = []
    paired = named._paired_blocks
    monkeypatch.setattr(named, "_paired_blocks", lambda texts, tasks, key, stages: done.append(stages) or paired(texts, tasks, key, stages))
    rows = [row(i, "same", canonical=w) for i, w in enumerate(words)] + [row(1000 + i, "few", canonical=w) for i, w in enumerate(words[:12])]
    got = {r.def_id: (r.cluster, r.min_sim) for r in named_clusters(table(spark, rows), 0.75).collect()}
    want = {}
    for base, own in ((0, words), (1000, words[:12])):
        pairs = {(i, j): difflib.SequenceMatcher(None, own[i], own[j], autojunk=False).ratio() for j in range(len(own)) for i in range(j)}
        label = brute_labels([p for p, r in pairs.items() if r >= 0.75])
        for i, x in label.items():
            want[base + i] = (base + x, min(r for (a, b), r in pairs.items() if label.get(a) == x == label.get(b)))
    assert len({c for c, _ in want.values()}) > 3 and got == want
    assert done == [[0], [1], [2], [0, 1, 2]]


def test_large_names_are_cut_into_few_blocks(spark):
    sizes = [(150, 9), (2_133, 1_400), (6_704, 1_400), (21_821, 1_400), (6_704, 100_000)]
    found = []
    for n, chars in sizes:
        found.append(spark.range(n).select(F.lit(chars).alias("n_chars")).agg(named._blocks().alias("b")).first().b)
    assert found == [2, 16, 16, 44, 53]


def test_named_findings_severity(spark):
    rows = [row(1, "K", "constants", text="K = 1"), row(2, "K", "constants", text="K = 1"), row(3, "K", "constants", text="something else entirely")]
    rows += [row(4, "f", canonical="abcdefgh"), row(5, "f", canonical="abcdefgx"), row(6, "g", canonical="abc"), row(7, "g", canonical="xyz")]
    got = {r.name: r for r in named_findings(table(spark, rows)).collect()}
    assert got["K"].severity == "INFO" and len(got["K"].members) == 3 and got["K"].snippet == "K = 1"
    assert got["f"].severity == "ERROR" and got["f"].min_sim == 0.875 and got["f"].members[0].line == 5
    assert "g" not in got
    assert named_findings(table(spark, rows), min_size=3).count() == 1
    assert named_findings(table(spark, rows), max_group=2).count() == 1
    assert [(r.name, r.n) for r in large_name_groups(table(spark, rows), 3).collect()] == [("K", 3)]


def test_renamed_findings(spark):
    big, small = ("X", ["a"], 20), ("Y", ["a"], 19)
    rows = [row(1, "b", analysis=big), row(2, "a", "methods", analysis=big), row(3, "m", "methods", analysis=small), row(4, "n", "methods", analysis=small)]
    rows += [row(5, "z", analysis=("Z", [], 50)), row(6, "z", analysis=("Z", [], 50)), row(7, "q"), row(8, "r", analysis=(None, None, None)), row(9, "s", analysis=(None, None, None))]
    got = {r.name: r for r in renamed_findings(table(spark, rows)).collect()}
    assert set(got) == {"a/b", "m/n"}
    assert got["a/b"].severity == "ERROR" and got["a/b"].kind.id == "functions" and got["a/b"].min_sim is None
    assert got["m/n"].severity == "WARNING" and got["m/n"].kind.id == "methods"


def brute_type3(defs, theta):
    """defs: (id, name, lines); clusters as in the definition, all pairs."""
    token = re.compile(r"[A-Za-z_]\w*|[0-9]+|[^\s]")
    occ = Counter(x for _, _, ls in defs for x in ls)
    total = sum(occ.values())
    df = Counter()
    for line, n in occ.items():
        for t in set(token.findall(line)):
            df[t] += n
    weight = {line: sum(math.log(total / df[t]) for t in token.findall(line)) for line in occ}
    vec = {i: {x: weight[x] * k for x, k in Counter(ls).items()} for i, _, ls in defs}
    norm = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in vec.items()}

    def cos(i, j):
        dot = sum(w * vec[j].get(x, 0) for x, w in vec[i].items())
        return dot / (norm[i] * norm[j]) if norm[i] * norm[j] else 0.0

    edges = []
    for y, (j, nj, lj) in enumerate(defs):
        for i, ni, li in defs[:y]:
            if li != lj and ni != nj and ni != "a" + nj and nj != "a" + ni and cos(i, j) > theta:
                edges.append((i, j))
    label = brute_labels(edges)
    out = {}
    for i in label:
        group = sorted(k for k in label if label[k] == label[i])
        out[i] = (label[i], min(cos(x, y) for n, y in enumerate(group) for x in group[:n]))
    return out


@pytest.mark.parametrize("seed", [4, 11])
def test_type3_matches_brute_force(spark, seed):
    draw = random.Random(seed)
    pool = [f"call_{k}(x{k % 3}, {k})" for k in range(14)]
    defs = []
    for i in range(40):
        lines = [draw.choice(pool) for _ in range(draw.randrange(2, 7))]
        defs.append((i, draw.choice("pqrst"), lines))
    defs += [(100, "get", pool[:5]), (101, "aget", pool[:5]), (102, "aget", [*pool[:4], pool[5]])]
    rows = [row(i, n, analysis=("x", ls, 9)) for i, n, ls in defs] + [row(500, "none"), row(501, "nul", analysis=("x", None, 9))]
    got = {r.def_id: (r.cluster, r.min_sim) for r in type3_clusters(table(spark, rows), 0.7).collect()}
    want = brute_type3([d for d in defs if len(d[2]) >= 3], 0.7)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in want)
    assert all(len(set(r.name.split("/"))) >= 2 for r in type3_findings(table(spark, rows)).collect())


def test_token_pattern(spark):
    got = spark.range(1).select(F.regexp_extract_all(F.lit("naïve_x1 = 12é"), F.lit(TOKEN), F.lit(0)).alias("t")).first().t
    assert got == ["naïve_x1", "=", "12", "é"]


def test_passes_of_an_empty_table(spark):
    empty = table(spark, [])
    assert named_findings(empty).count() == renamed_findings(empty).count() == type3_findings(empty).count() == 0
