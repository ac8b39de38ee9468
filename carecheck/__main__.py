"""spark-submit entry point.

    spark-submit -m carecheck validate <path> [--profile NAME] [--template T] [--compliance] --out DIR
    spark-submit -m carecheck compliance <path> [--template T] --out DIR
    spark-submit -m carecheck profile <path> [--time-column C] [--as-of TS] --out DIR

Results are written as Parquet tables under ``--out`` (issues, violations,
scores, metrics, ...); one JSON summary line goes to stdout.  ``validate``
exits with 1 when an error-severity issue was found, like a validation gate.
"""

from __future__ import annotations

import argparse
import json
import os
import sys


def _args(argv):
    p = argparse.ArgumentParser(prog="carecheck")
    sub = p.add_subparsers(dest="cmd", required=True)
    v = sub.add_parser("validate")
    v.add_argument("path")
    v.add_argument("--profile")
    v.add_argument("--template")
    v.add_argument("--compliance", action="store_true")
    v.add_argument("--no-phi", action="store_true")
    v.add_argument("--required", nargs="*", default=None)
    v.add_argument("--out", required=True)
    c = sub.add_parser("compliance")
    c.add_argument("path")
    c.add_argument("--template")
    c.add_argument("--out", required=True)
    a = sub.add_parser("profile")
    a.add_argument("path")
    a.add_argument("--time-column")
    a.add_argument("--as-of")
    a.add_argument("--out", required=True)
    return p.parse_args(argv)


def main(argv=None) -> int:
    args = _args(argv if argv is not None else sys.argv[1:])
    from carecheck.session import get_spark
    from carecheck.sources.io import read_table, result_json
    spark = get_spark(app=f"carecheck-{args.cmd}")
    df = read_table(spark, args.path)
    out = args.out.rstrip("/")

    def write(name, frame):
        frame.write.mode("overwrite").parquet(os.path.join(out, name))

    if args.cmd == "validate":
        from carecheck.operators.rulesets import rules_from_options
        from carecheck.operators.validate import validate
        rules = rules_from_options(profile=args.profile, phi=not args.no_phi, required_columns=args.required)
        r = validate(df, rules, compliance=args.compliance, template=args.template)
        write("issues", r.issues)
        summary = result_json(spark.read.parquet(os.path.join(out, "issues"))).first().asDict()
        if r.compliance is not None:
            write("violations", r.compliance.violations)
            write("scores", r.compliance.scores())
        print(json.dumps(summary))
        return 0 if summary["is_valid"] else 1
    if args.cmd == "compliance":
        from carecheck.operators.compliance import compliance_report
        rep = compliance_report(df, template=args.template)
        write("violations", rep.violations)
        write("scores", rep.scores())
        print(json.dumps(rep.overall().first().asDict()))
        return 0
    from carecheck.operators.analytics import full_report
    rep = full_report(df, args.time_column, as_of=args.as_of)
    for name, frame in rep.items():
        write(name, frame)
    print(json.dumps(rep["overall"].first().asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
