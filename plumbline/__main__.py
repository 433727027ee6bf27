"""python -m plumbline scan FOLDER | list-checks | explain CHECK | history | prefer NAME=VALUE | version. Exit code 0: fine, 1: findings at or above --fail-on, 2: the folder, an
option or the configuration can't be used."""

from __future__ import annotations

import argparse
import difflib
import os
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from . import __version__
from .plans.audit import audit, home, past_audits, preferences
from .plans.findings import SECTIONS, ConfigError, Options, OptionsError, all_checks, selected, severity_of


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan")
    scan.add_argument("path")
    for f in fields(Options):
        if f.name not in ("path", "cache"):
            scan.add_argument("--" + f.name.replace("_", "-"), type=int if "int" in f.type else str, default=f.default if f.name != "out" else preferences()["out"])
    scan.add_argument("--cache", help="folder of known features; by default one in the user's folder, in local sessions")
    scan.add_argument("--no-cache", action="store_true", help="read every file")
    scan.add_argument("--quiet", "-q", action="store_true", default=preferences()["quiet"], help="no progress")
    listed = commands.add_parser("list-checks")
    listed.add_argument("--type", default="image-cls")
    listed.add_argument("--section", choices=list(SECTIONS))
    commands.add_parser("explain").add_argument("check")
    commands.add_parser("history")
    prefer = commands.add_parser("prefer", help="NAME=VALUE, kept for later scans")
    prefer.add_argument("changes", nargs="*")
    commands.add_parser("version")
    return parser


def _scan(a: dict) -> int:
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    from .sources.images import LoaderError

    no_cache, quiet = a.pop("no_cache"), a.pop("quiet")
    own = f"file://{os.path.abspath(home('features'))}" if spark.sparkContext.master.startswith("local") else None
    a["cache"] = None if no_cache else a["cache"] or preferences()["cache"] or own
    told = None if quiet else lambda check, done, of: print(f"\r{done}/{of} {check:<24}", end="" if done < of else "\n", file=sys.stderr, flush=True)
    try:
        report = audit(spark, write=True, progress=told, **a)
    except (OptionsError, ConfigError, LoaderError) as x:
        print(x, file=sys.stderr)
        return 2
    print(report.summary())
    for what, where in report.outputs.items():
        print(f"{what}: {where}")
    return int(a["fail_on"] is not None and report.worst >= severity_of(a["fail_on"]))


def main(args: list[str] | None = None) -> int:
    a = vars(_parser().parse_args(args))
    match a.pop("command"):
        case "version":
            print(__version__)
        case "list-checks":
            for c in selected(a["type"]):
                if a["section"] in (None, c.section):
                    print(f"{c.id:<22} {c.section:<10} {c.title} ({c.rule})")
        case "explain":
            c = all_checks().get(a["check"])
            if c is None:
                near = difflib.get_close_matches(a["check"], all_checks())
                print(f"no check {a['check']}" + (f"; did you mean {', '.join(near)}?" if near else ""), file=sys.stderr)
                return 2
            print(f"{c.id}: {c.title}\n{c.rule}\nsection: {c.section}")
        case "history":
            for x in past_audits():
                print("{when}  {verdict:<18} {path}".format(**{"when": "", "verdict": "", "path": ""} | x))
        case "prefer":
            pairs = [x.partition("=")[::2] for x in a["changes"]]
            print(preferences(**{k: v.lower() == "true" if k == "quiet" else v or None for k, v in pairs}))
        case _:
            return _scan(a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
