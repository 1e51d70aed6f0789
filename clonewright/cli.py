"""Command line: ``python -m clonewright PATH... [options]``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clonewright.functions.model import KINDS
from clonewright.operators import calibration
from clonewright.operators.directives import DirectiveError, parse_directive, settings
from clonewright.operators.named import large_name_groups
from clonewright.plans import render
from clonewright.plans.pipeline import Options, bench, cluster, in_report_order, report_findings, timed
from clonewright.plans.scratch import materialise
from clonewright.plans.session import local_session
from clonewright.sources.frontends import FRONTENDS
from clonewright.sources.snapshot import load_definitions, save_stages
from clonewright.sources.walk import definitions, read_sources

STAGES = ("name", "cross-name", "type-3", "cluster")
TIERS = (("ERROR", "error-thickness"), ("WARNING", "warning-thickness"))


class UsageError(ValueError):
    """Arguments that can't be used together or at all."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clonewright", description="Find duplicated definitions in source trees.")
    p.add_argument("paths", nargs="*", help="files or folders to scan")
    p.add_argument("-t", "--threshold", type=float, default=0.5, help="same-named definitions link from this similarity")
    p.add_argument("-e", "--error-threshold", type=float, default=0.85, help="clusters whose least similarity reaches this are errors")
    p.add_argument("--error-thickness", type=float, default=0.0, help="errors thinner than this become warnings")
    p.add_argument("--warning-thickness", type=float, default=0.0, help="warnings thinner than this become info")
    p.add_argument("--escalate-thickness", type=float, default=0.0, help="anything as thick as this becomes an error; applied last")
    p.add_argument("--show-info", action="store_true", help="show info findings in the text report")
    p.add_argument("--repo-root", default=".", help="paths below this are shown relative to it")
    p.add_argument("--type3-theta", type=float, default=0.7, help="near-copies link above this cosine")
    p.add_argument("--min-size", type=int, default=2, help="least number of definitions in a cluster")
    p.add_argument("--max-name-group", type=int, help="skip names that more definitions share")
    p.add_argument("--kinds", type=lambda s: tuple(s.split(",")), help="only these kinds, comma-separated")
    p.add_argument("--only", type=lambda s: s.split(","), help="only these languages (py, ts, rs), comma-separated")
    p.add_argument("--no-cross-name", action="store_true", help="skip the pass for renamed copies")
    p.add_argument("--no-type3", action="store_true", help="skip the pass for renamed near-copies")
    p.add_argument("--errors-only", action="store_true", help="report errors only")
    p.add_argument("--json", action="store_true", help="JSON instead of text")
    p.add_argument("--calibrate", action="store_true", help="distribution of thickness and suggested thresholds")
    p.add_argument("-D", "--directive", dest="directives", action="append", default=[], help="ACTION:[KIND:]NAME[@PATH][=NOTE]; repeatable")
    p.add_argument("--save", metavar="FOLDER", help="write definitions, inputs of the third pass and findings below this folder")
    p.add_argument("--load", metavar="FOLDER", help="read the definitions of an earlier --save in place of scanning")
    p.add_argument("--bench", metavar="STAGE:LOOPS", help="seconds of a stage (name, cross-name, type-3, cluster) instead of a report")
    p.add_argument("--timing", action="store_true", help="seconds of each stage on stderr")
    return p


def options(args: argparse.Namespace) -> Options:
    """Pipeline options from flags and rules; settings among the rules override their flags."""
    unknown = sorted(set(args.only or []) - set(FRONTENDS))
    if unknown:
        raise UsageError(f"unknown language {unknown[0]!r}; known are {', '.join(FRONTENDS)}")
    if bool(args.paths) == bool(args.load):
        raise UsageError("give paths to scan or --load, not both")
    stage, _, loops = (args.bench or "cluster:1").partition(":")
    if stage not in STAGES or not loops.isdecimal() or int(loops) < 1:
        raise UsageError(f"--bench takes one of {', '.join(STAGES)}, a colon and a number of loops")
    rules = tuple(map(parse_directive, args.directives))
    overrides, warnings = settings(list(rules))
    for w in warnings:
        print(f"clonewright: {w}", file=sys.stderr)
    plain = Options(
        threshold=args.threshold,
        error_threshold=args.error_threshold,
        error_thickness=args.error_thickness,
        warning_thickness=args.warning_thickness,
        escalate_thickness=args.escalate_thickness,
        type3_theta=args.type3_theta,
        min_size=args.min_size,
        max_name_group=args.max_name_group,
        kinds=args.kinds,
        cross_name=not args.no_cross_name,
        type3=not args.no_type3,
        directives=rules,
    )
    return replace(plain, **overrides)


def calibration_parts(found: DataFrame, defs: DataFrame) -> tuple[list[tuple[str, str, list[Row], list[Row]]], list[tuple]]:
    """Tiers and inferred rules, as the renderers take them."""
    tiers = []
    for severity, flag in TIERS:
        own = found.where(F.col("severity") == severity)
        tiers.append((severity, flag, calibration.histogram(own).orderBy("bin").collect(), calibration.suggestions(own).collect()))
    inferred = calibration.inferred_cap(large_name_groups(defs, calibration.SUGGESTED_CAP)) + calibration.inferred_rules(found)
    return tiers, inferred


def vendored_rules(found: DataFrame, root: str) -> list[tuple]:
    """Suggestions to suppress folders of copied sources."""
    short = render.Paths(root)
    out = []
    for r in calibration.vendored_roots(found).collect():
        folder, source = short(r.anchor), short(r.source)
        out.append(
            (
                f"suppress:*:*@*{folder}*=likely vendored / fork snapshot mirroring {source}",
                f"{r.n} clusters have all members in same-named files across `{folder}` and a parallel source root",
                r.n, r.n_error, r.n_warning, r.n_info,
            )
        )
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[Iterator[str], int]:
    """(parts of the report, exit code) of one invocation: 1 if any error is left, 0 if none or when calibrating.

    The findings are sorted by the cluster and come to the driver one partition
    at a time, as the report is written.
    """
    opts = options(args)
    langs = args.only or list(FRONTENDS)
    with timed("scan", args.timing):
        defs = load_definitions(spark, f"{args.load}/definitions") if args.load else definitions(read_sources(spark, args.paths, langs))
    if args.load and args.only:
        defs = defs.where(F.col("lang").isin(langs))
    if args.bench:
        stage, _, loops = args.bench.partition(":")
        least, middle = bench(defs, stage, int(loops), opts)
        return iter([f"{stage}: least {least:.3f} s, median {middle:.3f} s\n"]), 0
    with timed("cluster", args.timing):
        found = materialise(cluster(defs, opts, args.timing))
    if args.save:
        save_stages(defs, found, args.save)
    ordered = materialise(report_findings(found, opts, args.errors_only)) if opts.directives or args.errors_only else found
    if args.calibrate:
        tiers, inferred = calibration_parts(ordered, defs)
        inferred += vendored_rules(ordered, args.repo_root)
        show = render.json_calibration if args.json else render.text_calibration
        return iter([show(tiers, inferred, args.repo_root)]), 0
    code = int(not ordered.where(F.col("severity") == "ERROR").isEmpty())
    shown = ordered if args.json or args.show_info else ordered.where(F.col("severity") != "INFO")
    rows = in_report_order(shown).toLocalIterator(prefetchPartitions=True)
    if args.json:
        return render.json_report(rows, args.repo_root), code
    kinds = {k for lang in langs for k in FRONTENDS[lang].kinds}
    assert kinds <= set(KINDS)
    return (line + "\n" for line in render.text_report(rows, kinds, opts.threshold, opts.error_threshold, args.repo_root)), code


def main(argv: list[str] | None = None) -> int:
    """Print the report and give the exit code; 2 for arguments that can't be used."""
    args = parser().parse_args(argv)
    try:
        options(args)
    except (DirectiveError, UsageError) as error:
        print(f"clonewright: {error}", file=sys.stderr)
        return 2
    spark = local_session("*")
    parts, code = run(spark, args)
    sys.stdout.writelines(parts)
    sys.stdout.flush()
    return code
