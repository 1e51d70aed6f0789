"""The command line on a small tree in two languages, with what the report must say."""

import json
from pathlib import Path

import pytest

from clonewright import cli
from clonewright.sources.snapshot import load_definitions, load_findings, load_type3_inputs, save_definitions, save_findings, type3_inputs
from clonewright.sources.walk import definitions, read_sources, source_paths

PY = '''LIMIT = 5


def score(values, weight):
    total = 0
    for v in values:
        total += v * weight
    return total / len(values)


def {name}(a, b):
    result = a + b
    return result * 2


class Repo:
    def fetch(self, key):
        record = self.store.get(key)
        if record is None:
            raise KeyError(key)
        return record
'''
TS = "export const LIMIT = 5;\n\nexport type Ids = number[];\n\nexport function {name}(a: number, b: number) {{\n    const result = a + b;\n    return result * 2;\n}}\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "tests" / "mixed"
    for path, text in {
        "py/a.py": PY.replace("{name}", "add"),
        "py/__init__.py": PY.replace("{name}", "plus"),
        "ts/a.ts": TS.format(name="addUp"),
        "ts/b.ts": TS.format(name="plusUp"),
        "node_modules/x/a.py": PY,
        "pkg.egg-info/a.py": PY,
        "py/broken.py": "def (",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "py/latin.py").write_bytes(b"X = '\xe9'\n")
    return root


SEEN = {}


def run(spark, tree, *extra):
    """(report, code) of one invocation; the same one is run once."""
    if extra not in SEEN or "--save" in extra:
        SEEN[extra] = _run(spark, tree, *extra)
    return SEEN[extra]


def _run(spark, tree, *extra):
    parts, code = cli.run(spark, cli.parser().parse_args([str(tree), "--repo-root", str(tree), *extra]))
    return "".join(parts), code


def test_walk(tree):
    names = [p[len(str(tree)) + 1 :] for _, p in source_paths([str(tree)])]
    assert sorted(names) == ["py/__init__.py", "py/a.py", "py/broken.py", "py/latin.py", "ts/a.ts", "ts/b.ts"]
    assert source_paths([str(tree / "node_modules" / "x" / "a.py")], ["py"]) and not source_paths([str(tree)], ["rs"])


def test_text_report(spark, tree):
    text, code = run(spark, tree, "--show-info")
    assert code == 1 and text.count("--- duplicate ") == 10
    assert "DUPLICATE FUNCTION [ERROR]: score  [ast sim 1.00, T=0.34, n=2, loc=5, args=2]\n  py/__init__.py:4\n  py/a.py:4" in text
    assert "DUPLICATE FUNCTION [WARNING]: add/plus  [normalized-exact, T=0.30, n=2, loc=3, args=2]" in text
    assert "DUPLICATE FUNCTION [WARNING]: addUp/plusUp  [normalized-exact" in text
    assert "LIMIT  [ast sim 1.00, T=0.27, n=4, loc=1]" in text and text.rstrip().splitlines()[-1].startswith("# summary: ")


def test_json_only_and_rules(spark, tree):
    text, _ = run(spark, tree, "--json", "--only", "py", "-D", "suppress:CONSTANT:*", "-D", "note:Repo*=look", "-D", "de-escalate:score")
    report = json.loads(text)
    names = {g["name"]: g for g in report["groups"]}
    assert "LIMIT" not in names and names["Repo"]["notes"] == ["look"] and names["score"]["severity"] == "WARNING"
    assert names["add/plus"]["allowlist_key"] == "dup-xname add/plus" and report["summary"]["total"] == len(report["groups"])


def test_calibration(spark, tree):
    text, code = run(spark, tree, "--calibrate")
    assert code == 0 and "=== thickness calibration (ERROR):" in text and "suggested thresholds" in text
    report = json.loads(run(spark, tree, "--calibrate", "--json")[0])
    assert len(report["error"]["histogram"]) == 10 and report["warning"]["target_flag"] == "warning-thickness"
    assert run(spark, tree, "--only", "rs", "--calibrate")[0].startswith("=== thickness calibration: 0 findings")


def test_nothing_found_and_usage_errors(spark, tree, capsys):
    assert run(spark, tree, "--only", "rs") == (run(spark, tree, "--only", "rs")[0], 0)
    assert cli.main([str(tree), "--only", "xx"]) == 2 and cli.main([str(tree), "-D", "bad"]) == 2
    assert "unknown language" in capsys.readouterr().err


def test_snapshots(spark, tree, tmp_path):
    defs = definitions(read_sources(spark, [str(tree)]))
    save_definitions(defs, str(tmp_path / "d"))
    again = load_definitions(spark, str(tmp_path / "d"))
    assert sorted(map(str, again.collect())) == sorted(map(str, defs.select(again.columns).collect()))
    found = cli.cluster(again)
    save_findings(found, str(tmp_path / "f"), "json")
    assert {r.name for r in load_findings(spark, str(tmp_path / "f"), "json").collect()} == {r.name for r in found.collect()}
    assert type3_inputs(defs).count() == 6


GOLDEN = Path(__file__).parent / "golden"


@pytest.mark.parametrize(
    ("name", "flags"),
    [
        ("report.txt", ["--show-info"]),
        ("report.json", ["--json"]),
        ("calibrate.txt", ["--calibrate"]),
        ("report.py.txt", ["--only", "py", "--show-info"]),
        ("report.ts.txt", ["--only", "ts", "--show-info"]),
    ],
)
def test_reports_to_the_byte(spark, tree, name, flags):
    assert run(spark, tree, *flags)[0] == (GOLDEN / name).read_text(encoding="utf-8")


def test_saved_stages_give_the_same_report(spark, tree, tmp_path, capsys):
    saved = str(tmp_path / "stages")
    text, code = run(spark, tree, "--save", saved, "--timing")
    err = capsys.readouterr().err
    assert all(f"{stage}: " in err for stage in ("scan", "name", "cross-name", "type-3", "cluster"))
    assert load_type3_inputs(spark, f"{saved}/type3").count() == 6
    parts, again = cli.run(spark, cli.parser().parse_args(["--load", saved, "--repo-root", str(tree)]))
    assert ("".join(parts), again) == (text, code)
    parts, code = cli.run(spark, cli.parser().parse_args(["--load", saved, "--bench", "cross-name:2"]))
    assert "".join(parts).startswith("cross-name: least ") and code == 0
    assert cli.main(["--load", saved, "--bench", "other:1"]) == 2 and cli.main([]) == 2
