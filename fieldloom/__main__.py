"""python -m fieldloom inspect|source-report|materialize ARCHIVE [STATE]: profiles of a backup archive, and its state folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .sources import backup


def main() -> None:
    parser = argparse.ArgumentParser(prog="fieldloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("inspect", "source-report", "materialize"):
        sub = commands.add_parser(name)
        sub.add_argument("archive")
        if name == "materialize":
            sub.add_argument("state")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("fieldloom").config("spark.ui.enabled", "false").getOrCreate()
    members = backup.read_backup(spark, args.archive).cache()
    if args.command == "inspect":
        print(json.dumps(backup.summarize(members), ensure_ascii=False, indent=2))
    elif args.command == "source-report":
        report = backup.compatibility_report(backup.source_table(members))
        rows = [json.loads(r) for r in report.select("bookSourceName", "text_source", "css", "json", "regex", "replacements", "xpath", "javascript", "templates", "unsupported", "fully_supported").toJSON().toLocalIterator()]
        print(json.dumps({"sources": rows, "totals": backup.report_totals(report).first().asDict()}, ensure_ascii=False, indent=2))
    else:
        backup.write_state(members, args.state)
        print(json.dumps({"state": args.state, "members": members.count()}))
    spark.stop()


if __name__ == "__main__":
    main()
