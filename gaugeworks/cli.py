"""Command line: suite, report, compare and verify-adapter over JSON-lines logs.

spark-submit gaugeworks/cli.py [--json] report RUN.jsonl [--out FILE] | compare A.jsonl B.jsonl | suite FOLDER [--axis X]... [--env E]... [--limit N]
    | verify-adapter EXCHANGE.jsonl [--held HELD.jsonl]

Results are aligned tables, or with --json a JSON line a row.  ``verify-adapter`` judges a recorded exchange; it starts no system.
"""

from __future__ import annotations

import argparse
import itertools
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gaugeworks")
    top.add_argument("--json", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    report = sub.add_parser("report")
    report.add_argument("run")
    report.add_argument("--out")
    report.add_argument("--exclude-errors", action="store_true")
    compare = sub.add_parser("compare")
    compare.add_argument("memory")
    compare.add_argument("baseline")
    suite = sub.add_parser("suite")
    suite.add_argument("folder")
    suite.add_argument("--axis", action="append", default=[])
    suite.add_argument("--env", action="append", default=[])
    suite.add_argument("--limit", type=int)
    verify = sub.add_parser("verify-adapter")
    verify.add_argument("log")
    verify.add_argument("--held")
    return top


def run(spark: SparkSession, argv: list[str]) -> tuple[int, list[dict]]:
    """Exit code and result rows."""
    from gaugeworks.operators import compare, corpus, report, runs, scoring
    from gaugeworks.sources import readers

    args = parser().parse_args(argv)
    if args.command == "report":
        rows = readers.read_predictions(spark, args.run, keep_order=True)
        scores = scoring.score_predictions(rows)
        overall = report.run_report(rows, include_errors=not args.exclude_errors).select("run_id", "system_id", "context_mode", "n", "mean", "ci95_low", "ci95_high", "n_pending_judge", "notes")
        axes = scoring.breakdown(scores, "axis", include_errors=not args.exclude_errors).orderBy("axis")
        out = [r.asDict() for r in overall.collect()] + [r.asDict() for r in axes.collect()]
        if args.out:
            Path(args.out).write_text(json.dumps(out, ensure_ascii=False, indent=1))
        return (0 if out else 2), out
    if args.command == "compare":
        a, b = (scoring.score_predictions(readers.read_predictions(spark, p)) for p in (args.memory, args.baseline))
        gains = compare.paired_gain(a, b).withColumn("axis", F.lit("overall")).unionByName(compare.paired_gain_by_axis(a, b))
        out = [r.asDict() for r in gains.collect()]
        return (0 if out else 2), out
    if args.command == "verify-adapter":
        held = readers.read_jsonl(spark, args.held, "system string, path string") if args.held else None
        checks = runs.exchange_conformance(readers.read_jsonl(spark, args.log, runs.EXCHANGE), held)
        names = [n for n, _ in runs.EXCHANGE_CHECKS]
        out = sorted((r.asDict() for r in checks.collect()), key=lambda r: (r["system"], names.index(r["check"])))  # ten rows a system
        failed = any(r["required"] and not r["passed"] for r in out)
        return (2 if not out else 1 if failed else 0), out
    items, _ = readers.read_suite(spark, args.folder)
    kept = corpus.suite_filter(items, args.axis, args.env, args.limit, "item_id")
    return 0, [r.asDict() for r in corpus.axis_counts(kept, F.coalesce("certificate.cross_session", F.lit(False))).orderBy("axis").collect()]


def _cell(value) -> str:
    if value is None:
        return "-"
    return f"{value:.3f}" if isinstance(value, float) else "; ".join(map(str, value)) if isinstance(value, list) else str(value)


def table(rows: list[dict]) -> list[str]:
    """Rows as aligned lines, a table for each run of rows with the same columns; numbers stand to the right."""
    out: list[str] = []
    for names, group in itertools.groupby(rows, key=lambda r: tuple(r)):
        group = list(group)
        cells = [[_cell(r[n]) for n in names] for r in group]
        width = [max(len(n), *(len(c[i]) for c in cells)) for i, n in enumerate(names)]
        right = [all(isinstance(r[n], (int, float, type(None))) and not isinstance(r[n], bool) for r in group) for n in names]
        line = lambda c: "  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(c, width, right, strict=True)).rstrip()  # noqa: B023, E731
        out += ([""] if out else []) + [line(names), "-" * (sum(width) + 2 * len(width) - 2), *map(line, cells)]
    return out


def verdicts(rows: list[dict]) -> list[str]:
    """Checks of systems as PASS, FAIL or, where they are advice only, WARN, with their count."""
    mark = lambda r: "PASS" if r["passed"] else "FAIL" if r["required"] else "WARN"
    warned = sum(mark(r) == "WARN" for r in rows)
    last = f"{sum(r['passed'] for r in rows)}/{len(rows)} checks passed" + (f" ({warned} advisory warning(s))" if warned else "")
    return [f"[{mark(r)}] {r['system']}: {r['check']}" for r in rows] + ["", last]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    code, rows = run(spark or SparkSession.builder.appName("gaugeworks").getOrCreate(), argv)
    args = parser().parse_args(argv)
    lines = [json.dumps(row, ensure_ascii=False) for row in rows] if args.json else verdicts(rows) if args.command == "verify-adapter" else table(rows)
    print("\n".join(lines))
    return code


if __name__ == "__main__":
    sys.exit(main())
