"""Advisories of several providers as one relation.

A table of advisories has ecosystem, name, version, vuln_id and severity_score, and may have
source (the provider), summary and refs (addresses). Providers are asked in an order: an
advisory that several have counts once, as the first of them has it, and without fallback
the first provider that knows a package version is the only one for it.

``fetched`` makes such a table from the providers' services: every pinned package version is
asked for once, by a few tasks, so that the services see no more than PARALLEL
requests at a time. A service that fails, after its retries, has no advisories.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.dialect import SPARK
from riskloom.operators.relational_rules import advisory_version, pinned
from riskloom.sources.targets import retried

SCHEMA = "ecosystem string, name string, version string, vuln_id string, severity_score double, source string, summary string, refs array<string>"


#: Tasks that ask the services.
PARALLEL = 8


@dataclass(frozen=True)
class Lookup:
    order: tuple[str, ...] = ("osv", "github", "nvd")
    fallback: bool = True
    timeout_s: int = 10
    retries: int = 2


def lookup(env: Mapping[str, str] = os.environ) -> Lookup:
    """VULN_PROVIDER_ORDER (names with commas between), VULN_ENABLE_FALLBACK (true or false), VULN_API_TIMEOUT_SEC, VULN_MAX_RETRIES."""
    order = tuple(x.strip().lower() for x in env.get("VULN_PROVIDER_ORDER", "osv,github,nvd").split(",") if x.strip())
    timeout, retries = int(env.get("VULN_API_TIMEOUT_SEC") or 10), int(env.get("VULN_MAX_RETRIES") or 2)
    return Lookup(order or ("osv",), env.get("VULN_ENABLE_FALLBACK", "true").strip().lower() == "true", timeout, retries)


# ---------------------------------------------------------------- services


def _list(value) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _dict(value) -> dict:
    return value if isinstance(value, dict) else {}


def _number(value) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _urls(value) -> list[str]:
    return [r["url"] for r in _list(value) if isinstance(r.get("url"), str)]


def _ask_osv(ecosystem: str, name: str, version: str, env: Mapping[str, str]) -> urllib.request.Request:
    body = {"package": {"name": name, "ecosystem": "PyPI" if ecosystem == "python" else "npm"}, "version": version}
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if (key := env.get("OSV_API_KEY", "").strip()) else {})
    return urllib.request.Request("https://api.osv.dev/v1/query", json.dumps(body).encode(), headers, method="POST")


def _cvss(text) -> float | None:
    """The number after the last slash of a CVSS text, if it is one."""
    try:
        return float(text.rsplit("/", 1)[-1]) if isinstance(text, str) and "CVSS:" in text else None
    except ValueError:
        return None


def _read_osv(answer) -> Iterator[tuple]:
    for v in _list(_dict(answer).get("vulns")):
        score = next((n for x in _list(v.get("severity")) if (n := _cvss(x.get("score"))) is not None), None)
        yield str(v.get("id", "OSV-UNKNOWN")), score, str(v.get("summary") or "Known vulnerability found"), _urls(v.get("references"))


def _ask_github(ecosystem: str, name: str, version: str, env: Mapping[str, str]) -> urllib.request.Request:
    query = urlencode({"ecosystem": "pip" if ecosystem == "python" else "npm", "affects": name, "per_page": 20})
    token = env.get("GITHUB_TOKEN", "").strip() or env.get("GH_TOKEN", "").strip()
    headers = {"Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    return urllib.request.Request(f"https://api.github.com/advisories?{query}", headers=headers)


def _read_github(answer) -> Iterator[tuple]:
    for v in _list(answer):
        refs = [v["html_url"]] if isinstance(v.get("html_url"), str) else []
        yield str(v.get("ghsa_id") or "GHSA-UNKNOWN"), _number(_dict(v.get("cvss")).get("score")), str(v.get("summary") or "GitHub advisory found"), refs


def _ask_nvd(ecosystem: str, name: str, version: str, env: Mapping[str, str]) -> urllib.request.Request:
    query = urlencode({"keywordSearch": f"{name} {version}", "resultsPerPage": 20})
    key = env.get("NVD_API_KEY", "").strip()
    return urllib.request.Request(f"https://services.nvd.nist.gov/rest/json/cves/2.0?{query}", headers={"apiKey": key} if key else {})


#: The metrics of an entry, newest version first.
NVD_METRICS = ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")


def _read_nvd(answer) -> Iterator[tuple]:
    for item in _list(_dict(answer).get("vulnerabilities")):
        if cve := _dict(item.get("cve")):
            metrics = _dict(cve.get("metrics"))
            first = (_dict(m[0]).get("cvssData") for k in NVD_METRICS if isinstance(m := metrics.get(k), list) and m)
            score = next((n for x in first if (n := _number(_dict(x).get("baseScore"))) is not None), None)
            summary = next((d["value"] for d in _list(cve.get("descriptions")) if d.get("lang") == "en" and isinstance(d.get("value"), str)), "NVD vulnerability found")
            yield str(cve.get("id") or "CVE-UNKNOWN"), score, summary, _urls(cve.get("references"))


SERVICES: dict[str, tuple[Callable, Callable]] = {"osv": (_ask_osv, _read_osv), "github": (_ask_github, _read_github), "nvd": (_ask_nvd, _read_nvd)}


def asked(provider: str, ecosystem: str, name: str, version: str, how: Lookup, env: Mapping[str, str], opener: Callable = urllib.request.urlopen, sleep: Callable | None = None) -> list[tuple]:
    """(vuln_id, severity_score, summary, refs) of one provider for one package version; none from an unknown or failing one."""
    if provider not in SERVICES:
        return []
    ask, read = SERVICES[provider]
    request = ask(ecosystem, name, version, env)

    def call():
        with opener(request, timeout=how.timeout_s) as answer:
            try:
                return json.loads(answer.read().decode("utf-8", "ignore"))
            except ValueError as e:
                raise OSError("no JSON") from e  # tried again like a network error

    try:
        return list(read(retried(call, how.retries, **({"sleep": sleep} if sleep else {}))))
    except OSError:
        return []


def fetched(deps: DataFrame, how: Lookup = Lookup(), env: Mapping[str, str] | None = None, opener: Callable = urllib.request.urlopen, parallel: int = PARALLEL) -> DataFrame:
    """The advisories (SCHEMA) of the pinned ones among deps(name, spec, ecosystem); keys of the services come from env."""
    keys = {k: v for k, v in (os.environ if env is None else env).items() if k in ("OSV_API_KEY", "GITHUB_TOKEN", "GH_TOKEN", "NVD_API_KEY")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ecosystem, name, version in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for provider in how.order:
                    found = asked(provider, ecosystem, name, version, how, keys, opener)
                    rows += [{"ecosystem": ecosystem, "name": name, "version": version, "vuln_id": i, "severity_score": n, "source": provider, "summary": text, "refs": refs} for i, n, text, refs in found]
                    if found and not how.fallback:
                        break
            kinds = [(n, pa.list_(pa.string()) if n == "refs" else pa.float64() if n == "severity_score" else pa.string()) for n in ("ecosystem", "name", "version", "vuln_id", "severity_score", "source", "summary", "refs")]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    versions = deps.where(pinned(SPARK)).select("ecosystem", "name", F.expr(advisory_version(SPARK)).alias("version")).distinct()
    return versions.repartition(parallel).mapInArrow(run, SCHEMA)


# ---------------------------------------------------------------- ranking


def ranked(table: DataFrame, how: Lookup = Lookup()) -> DataFrame:
    """The advisories that count, one for each package version and id. A table without providers is one provider's."""
    have = set(table.columns)
    source = F.lower("source") if "source" in have else F.lit(how.order[0])
    df = table.select(
        F.lower("ecosystem").alias("ecosystem"), F.lower("name").alias("name"), "version", "vuln_id", "severity_score", source.alias("source"),
        (F.coalesce("summary", F.lit("")) if "summary" in have else F.lit("")).alias("summary"),
        (F.coalesce("refs", F.array().cast("array<string>")) if "refs" in have else F.array().cast("array<string>")).alias("refs"),
    )
    rank = F.array_position(F.array(*[F.lit(x) for x in how.order]), F.col("source"))
    df = df.withColumn("rank", rank).where("rank > 0")
    if not how.fallback:
        package = Window.partitionBy("ecosystem", "name", "version")
        df = df.withColumn("first", F.min("rank").over(package)).where("rank = first").drop("first")
    once = Window.partitionBy("ecosystem", "name", "version", "vuln_id").orderBy("rank", F.desc("severity_score"), "summary")
    return df.withColumn("k", F.row_number().over(once)).where("k = 1").drop("k", "rank")
