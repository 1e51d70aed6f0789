"""Reports as text and JSON, made on the driver from the findings that are to be read."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import Row

from clonewright.functions.model import KINDS
from clonewright.operators.calibration import BINS


class Paths:
    """Paths relative to a root, each resolved once; paths elsewhere stay as they are."""

    def __init__(self, root: str):
        self.root = os.path.realpath(root)
        self.known: dict[str, str] = {}

    def __call__(self, path: str) -> str:
        if path not in self.known:
            real = os.path.realpath(path)
            inside = os.path.commonpath([real, self.root]) == self.root if os.path.isabs(real) else False
            self.known[path] = os.path.relpath(real, self.root) if inside and os.path.exists(path) else path
        return self.known[path]


def is_cross_name(which: str) -> bool:
    return which in ("cross-name", "type-3")


def section(finding: Row) -> int:
    offset = {"cross-name": 1, "type-3": 2}.get(finding["pass"], 0)
    return finding.kind.section + (offset if finding.kind.fn_like else 0)


def sections(kind_ids: Iterable[str], warn: float, error: float) -> list[tuple[int, str]]:
    """(index, heading) of the sections that the kinds have, in order."""
    out = []
    for k in sorted({KINDS[i] for i in kind_ids}, key=lambda k: k.section):
        how = f"cross-file, AST sim warn={warn:g} error={error:g}" if k.body else "cross-file, by name"
        out.append((k.section, f"duplicate {k.noun_plural} ({how})"))
        if k.fn_like:
            out.append((k.section + 1, f"duplicate {k.noun_plural} (cross-name, exact AST-normalized)"))
            out.append((k.section + 2, f"duplicate {k.noun_plural} (cross-name Type-3, IDF-weighted cosine)"))
    return out


def suffix(finding: Row) -> str:
    """The bracket behind a finding's name, and its notes."""
    marks = []
    if finding.min_sim is not None:
        marks.append(f"ast sim {finding.min_sim:.2f}")
    elif is_cross_name(finding["pass"]):
        marks.append("normalized-exact")
    marks += [f"T={finding.thickness:.2f}", f"n={len(finding.members)}", f"loc={finding.loc}"]
    if finding.args > 0:
        marks.append(f"args={finding.args}")
    return f"  [{', '.join(marks)}]" + (f"  # {'; '.join(finding.notes)}" if finding.notes else "")


# The wording of the report's lines.
NOTHING = "No cross-file duplicates."


def text_report(findings: Iterable[Row], kind_ids: Iterable[str], warn: float, error: float, root: str) -> Iterator[str]:
    """Lines of the report: findings, which come in report order, by section, and a count. INFO counts as WARNING there, as the report has always had it."""
    short = Paths(root)
    n = errors = 0
    open_sections = iter(sections(kind_ids, warn, error))
    index = -1

    def headed(upto: float) -> Iterator[str]:
        nonlocal index
        while index < upto and (following := next(open_sections, None)) is not None:
            yield from [""] * (index >= 0)
            index = following[0]
            yield f"--- {following[1]} ---"

    for f in findings:
        yield from headed(section(f))
        n += 1
        errors += f.severity == "ERROR"
        yield f"DUPLICATE {f.kind.label} [{f.severity}]: {f.name}{suffix(f)}"
        yield from (f"  {short(m.file)}:{m.line}" for m in f.members)
        yield ""
    yield from headed(float("inf"))
    yield f"# summary: {errors} ERROR, {n - errors} WARNING groups" if n else NOTHING


def json_report(findings: Iterable[Row], root: str) -> Iterator[str]:
    """Lines of the JSON report: all findings and counts by severity, in the order they are first seen."""
    short = Paths(root)
    summary: dict[str, int] = {}
    n = 0
    for f in findings:
        cross = is_cross_name(f["pass"])
        rule = "dup-xname" if cross else f"dup-{f.kind.label.lower()}"
        group = {
            "kind": f.kind.label,
            "name": f.name,
            "severity": f.severity,
            "min_sim": f.min_sim,
            "cross_name": cross,
            "thickness": f.thickness,
            "loc": f.loc,
            "args": f.args,
            "members": [{"file": short(m.file), "line": m.line} for m in f.members],
            "allowlist_key": f"{rule} {f.name}",
            "notes": list(f.notes),
        }
        yield ("{\n  \"groups\": [\n" if n == 0 else ",\n") + _indented(group, 4)
        n += 1
        summary[f.severity] = summary.get(f.severity, 0) + 1
    summary["total"] = n
    opened = "\n  ],\n" if n else "{\n  \"groups\": [],\n"
    yield opened + '  "summary": ' + _indented(summary, 2).lstrip() + "\n}\n"


def _indented(value: dict, by: int) -> str:
    return "\n".join(" " * by + x for x in json.dumps(value, indent=2, ensure_ascii=False).split("\n"))


def dedented(snippet: str) -> str:
    """A method's text as a function's: a body indented by more than four spaces moves left to four."""
    lines = snippet.splitlines()
    depths = [len(x) - len(x.lstrip(" ")) for x in lines[1:] if x.strip()]
    extra = min(depths, default=0) - 4
    if extra <= 0:
        return snippet
    return "\n".join([lines[0]] + [x[extra:] if x.startswith(" " * extra) else x for x in lines[1:]])


def boxed(snippet: str, most: int = 15) -> str:
    """A snippet with a bar at its left, cut after ``most`` lines."""
    lines = dedented(snippet).splitlines()
    out = ["    ┌──"] + [f"    │ {x}" for x in lines[:most]]
    if len(lines) > most:
        out.append(f"    │ … (+{len(lines) - most} more lines)")
    return "\n".join([*out, "    └──"])


def locations(members: list[str], most: int = 3) -> str:
    """``file:line`` places; runs in one file name it once, and what is left out is counted."""
    parts, last = [], None
    for place in members[:most]:
        file, _, line = place.rpartition(":")
        parts.append(f":{line}" if file == last else place)
        last = file
    rest = len(members) - most
    return ", ".join(parts) + (f" (+{rest} more)" if rest > 0 else "")


def text_calibration(tiers: list[tuple[str, str, list[Row], list[Row]]], inferred: list[tuple], root: str) -> str:
    """Calibration from (severity, flag, histogram rows, suggestion rows) and the inferred rules."""
    short = Paths(root)
    if not any(r.n for *_, hist, _ in tiers for r in hist):
        return "=== thickness calibration: 0 findings — nothing to calibrate against. ===\n"
    out: list[str] = []
    for severity, flag, hist, picks in tiers:
        total = sum(r.n for r in hist)
        if not total:
            out += [f"=== thickness calibration ({severity}): 0 clusters — skip.", ""]
            continue
        out += [f"=== thickness calibration ({severity}): {total} clusters analyzed ===", ""]
        out.append(f"distribution (each ▇ ≈ one {severity} cluster, scaled to fit):")
        most = max(r.n for r in hist)
        out += [f"  T [{r.lo:.1f}, {r.hi:.1f})  {'▇' * -(-r.n * 30 // most)} {r.n}" for r in hist]
        out += ["", f"suggested thresholds (p50/p75/p90 of current {severity} thickness distribution):"]
        for p in picks:
            out.append("")
            out.append(f"  {p.label:<11}  --{flag} {p.threshold:.2f}  → {p.kept} {severity} remain  (median dup: {p.median_loc} loc, {p.median_args} args)")
            out.append(f"    e.g. {p.name}  [T={p.thickness:.2f}, loc={p.loc}, args={p.args}]")
            places = locations([f"{short(m.file)}:{m.line}" for m in p.members])
            out += [f"         {places}"] * bool(places) + [boxed(p.snippet or "")]
        out.append("")
    if inferred:
        out += ["=== inferred directives (auto-detected noise patterns) ===", ""]
        for directive, why, total, errors, warnings, infos in inferred:
            out += [f"  → -D '{directive}'", f"    rationale: {why}"]
            out += [f"    affects: {total} total ({errors} ERROR, {warnings} WARNING, {infos} INFO)", ""]
        out.append("(Paste any of these into your CI invocation — patterns matched repeatably,")
        out += ["not heuristics on individual clusters. Review the rationale before applying.)", ""]
    out.append("workflow: dial `--error-thickness` to focus the gate; dial `--warning-thickness`")
    out.append("to control how much low-confidence noise stays in WARNING vs falls to INFO.")
    return "\n".join(out) + "\n"


def json_calibration(tiers: list[tuple[str, str, list[Row], list[Row]]], inferred: list[tuple], root: str) -> str:
    """The calibration as JSON; both tiers are always there."""
    short = Paths(root)
    report: dict = {}
    for severity, flag, hist, picks in tiers:
        report[severity.lower()] = {
            "total": sum(r.n for r in hist),
            "target_flag": flag,
            "histogram": [{"thickness_lo": r.lo, "thickness_hi": r.hi, "count": r.n} for r in hist][:BINS],
            "suggestions": [
                {
                    "label": p.label,
                    "percentile": p.percentile,
                    "error_thickness": p.threshold,
                    "errors_kept": p.kept,
                    "median_loc": p.median_loc,
                    "median_args": p.median_args,
                    "example_name": p.name,
                    "example_thickness": p.thickness,
                    "example_loc": p.loc,
                    "example_args": p.args,
                    "example_members": [f"{short(m.file)}:{m.line}" for m in p.members],
                    "example_snippet": p.snippet,
                }
                for p in picks
            ],
        }
    names = ("directive", "rationale", "affects_total", "affects_error", "affects_warning", "affects_info")
    report["inferred_directives"] = [dict(zip(names, row, strict=True)) for row in inferred]
    return json.dumps(report, indent=2, ensure_ascii=False) + "\n"
