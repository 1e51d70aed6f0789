import random

import pytest
from pyspark.sql import functions as F

from clonewright.functions.model import FINDING_SCHEMA
from clonewright.operators import calibration as c

from test_passes import kind


def finding(t, name="n", severity="ERROR", files=("a/f.py",), k="functions", loc=3, args=1):
    return ("name", kind(k), name, severity, 1.0, loc, args, t, "s", [], [(f, 1, 0) for f in files])


def table(spark, rows):
    return spark.createDataFrame(rows, FINDING_SCHEMA)


def test_histogram(spark):
    got = [r.n for r in c.histogram(table(spark, [finding(t) for t in (0.0, 0.1, 0.3, 0.29999, 0.95, 1.0, 1.5)])).orderBy("bin").collect()]
    edges = [i * (1.0 / 10) for i in range(11)]
    want = [sum(v >= edges[i] and (v < edges[i + 1] or i == 9) for v in (0.0, 0.1, 0.3, 0.29999, 0.95, 1.0, 1.5)) for i in range(10)]
    assert got == want
    assert [r.n for r in c.histogram(table(spark, [])).collect()] == [0] * 10


def test_suggestions_against_brute_force(spark):
    draw = random.Random(2)
    rows = [finding(round(draw.random(), 2), name=f"n{draw.randrange(4)}", loc=draw.randrange(9), args=draw.randrange(4)) for _ in range(23)]
    ts = sorted(r[7] for r in rows)
    for s in c.suggestions(table(spark, rows)).collect():
        at = s.percentile / 100 * (len(ts) - 1)
        lo = int(at)
        want = ts[lo] if at == lo else ts[lo] * (1 - (at - lo)) + ts[lo + 1] * (at - lo)
        kept = [r for r in rows if r[7] >= s.threshold]
        assert abs(s.threshold - want) < 1e-12 and s.kept == len(kept)
        assert s.median_loc == sorted(r[5] for r in kept)[len(kept) // 2] and s.median_args == sorted(r[6] for r in kept)[len(kept) // 2]
        assert (s.thickness, s.name) == min((r[7], r[2]) for r in kept)
    assert c.suggestions(table(spark, [])).count() == 0


def test_path_predicates(spark):
    cases = {
        "is_i18n": ("a/LOCALE/b.py", "a/locale.py"),
        "is_test": ("a/Tests/b.py", "a/testimony/b.py"),
        "is_test_named": ("a/b.spec.ts", "a/spec.ts"),
        "is_generated": ("a/b_pb2.py", "a/b_pb2.ts"),
        "is_migration": ("a/migrations/b.py", "a/migration/b.py"),
        "is_declaration": ("a/b.d.ts", "a/bd.ts"),
        "is_story": ("a/b.stories.tsx", "a.stories.x/b.tsx"),
        "is_example": ("a/examples/b.py", "a/exam/b.py"),
    }
    for name, (yes, no) in cases.items():
        row = spark.range(1).select(getattr(c, name)(F.lit(yes)).alias("y"), getattr(c, name)(F.lit(no)).alias("n")).first()
        assert (row.y, row.n) == (True, False), name


def test_inferred_rules(spark):
    rows = [finding(0.5, files=("a/tests/x.py", "b/tests/y.py")) for _ in range(3)] + [finding(0.5, severity="INFO", files=("a/x_pb2.py", "b/y.py"))] * 3
    got = {r[0].split(":")[0]: r[2:] for r in c.inferred_rules(table(spark, rows))}
    assert got == {"de-escalate": (3, 3, 0, 0), "suppress": (3, 0, 0, 3)}
    assert c.inferred_rules(table(spark, [])) == []
    groups = spark.createDataFrame([("functions", f"n{k}", 300 - k) for k in range(6)], "kind_id string, name string, n long").orderBy(F.col("n").desc())
    assert c.inferred_cap(groups.where("n < 0")) == []
    (rule, why, total, *_), = c.inferred_cap(groups)
    assert rule == "settings:max-name-group=256" and total == 1785 and "functions:n3 ×297, +2 more" in why and "n4" not in why


def test_vendored_roots(spark):
    rows = [finding(0.5, files=(f"src/core/m{i}.py", f"x/vendor/copy/src/core/m{i}.py")) for i in range(4)]
    rows += [finding(0.5, files=("a/one.py", "b/two.py")), finding(0.5, files=("a/one.py", "b/one.py"))]
    got = c.vendored_roots(table(spark, rows), 3).collect()
    assert [(r.anchor, r.source, r.n) for r in got] == [("x/vendor/copy", "src/core", 4)]
    assert c.vendored_roots(table(spark, rows), 30).count() == 0


def test_quantiles_match_numpy(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    values = [float(x) for x in draw.integers(0, 40, 300) / 7] + [float(x) for x in draw.random(200)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.5, 0.75, 0.9, 1.0]
    assert c.quantiles(rows, "v", shares) == pytest.approx(list(np.quantile(values, shares)), abs=1e-12)
    assert c.quantiles(rows.where("v is null"), "v", shares) is None
    assert c.quantiles(spark.createDataFrame([(2.5,)] * 9, "v double"), "v", shares) == [2.5] * 5
