"""Command line: scan a directory or repository and write the report.

    python -m riskloom.cli [URL] [--ref REF] [--subdir DIR] [--output-dir DIR]
"""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from riskloom.operators import report
from riskloom.plans import engine
from riskloom.sources import advisories, manifests, targets
from riskloom.sources.corpus import Corpus
from riskloom.sources.tree import read_tree

META = "last_commit_ts long, author_count int, last_tag_ts long, archived boolean, now_ts long"


def scan(spark: SparkSession, s: targets.Settings, advisory_table: str | None = None, ask: bool = False) -> tuple[str | None, int, list[tuple[str, str]]]:
    """(where the report is, findings, errors) of one target. The report goes to s.output_dir, or is printed. ask: advisories come from the services."""
    now = datetime.now(timezone.utc)
    with targets.resolved(s) as path:
        files = read_tree(spark, path, subdir=s.subdir or "", maxFiles=s.max_files, maxTotalBytes=s.max_total, maxFileBytes=s.max_file).cache()
        meta = None
        if os.path.isdir(os.path.join(path, ".git")):
            row = targets.git_metadata(path, int(time.time()))
            meta = spark.createDataFrame([tuple(row.values())], META)
        known, how = spark.read.parquet(advisory_table) if advisory_table else None, advisories.lookup()
        if ask:
            known = advisories.fetched(manifests.deps(Corpus(spark, files)), how).cache()
        findings, errors = engine.run_rules(Corpus(spark, files, repo_meta=meta, advisories=known, lookup=how))
        findings = findings.cache()
        n, name, where = findings.count(), s.local_dir or s.repo_url, None
        if s.output_dir:
            parts = os.path.join(s.output_dir, f".report-{uuid.uuid4().hex}")
            where = os.path.join(s.output_dir, f"report_{now:%Y%m%d_%H%M%S}.md")
            report.write_markdown(findings, errors, name, now, f"file://{parts}")
            report.join_parts(parts, where)
            shutil.rmtree(parts)
            findings.write.mode("overwrite").parquet(os.path.join(s.output_dir, "findings.parquet"))
        else:
            for line in report.lines(findings, errors, name, now):
                print(line)
        findings.unpersist()
        files.unpersist()
    return where, n, errors


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="riskloom", description=__doc__)
    p.add_argument("url", nargs="?")
    p.add_argument("--ref")
    p.add_argument("--subdir")
    p.add_argument("--output-dir")
    p.add_argument("--advisories", help="Parquet table of advisories (ecosystem, name, version, vuln_id, severity_score, and source, summary, refs)")
    p.add_argument("--ask-services", action="store_true", help="ask the advisory services about every pinned dependency")
    a = p.parse_args(argv)
    try:
        s = targets.settings(targets.dotenv(".env"), a.url, a.ref, a.subdir, a.output_dir)
    except targets.BadTarget as e:
        print(e, file=sys.stderr)
        return 2
    where, n, errors = scan(engine.spark_session(), s, a.advisories, a.ask_services)
    if where:
        print(f"{n} findings, {len(errors)} rule errors; report in {where}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
