"""Line rules over a stream of files (an addition of this engine: rules judged as files arrive).

Line rules look at one file at a time, so the plan is stateless; ``windowed_counts`` adds
an event-time count by severity with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.plans.engine import line_findings
from riskloom.sources.corpus import Corpus


def stream_findings(files: DataFrame) -> DataFrame:
    """Findings of the line rules for a streaming DataFrame files(path, content or text)."""
    return line_findings(Corpus(files.sparkSession, files))


def windowed_counts(findings: DataFrame, ts: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings per window and severity; ts is an event time column of findings."""
    return findings.withWatermark(ts, late).groupBy(F.window(ts, window), "severity").agg(F.count(F.lit(1)).alias("n"))
