"""Advisory services: requests, answers of any shape, retries, order and fallback, without a network."""

import io
import json
import urllib.error

import pytest

from riskloom.sources import advisories as A

OSV = {"vulns": [{"id": "O-1", "summary": "s", "severity": [{"score": 3}, {"score": "CVSS:3.1/AV:N"}, {"score": "CVSS:3.1/7.5"}], "references": [{"url": "http://r"}, {"url": 1}, "x"]}, {}, "odd"]}
GITHUB = [{"ghsa_id": "G-1", "summary": "t", "html_url": "http://g", "cvss": {"score": 9}}, {"cvss": "odd"}, 3]
NVD = {"vulnerabilities": [
    {"cve": {"id": "C-1", "descriptions": [{"lang": "fr", "value": "non"}, {"lang": "en", "value": "yes"}], "metrics": {"cvssMetricV31": [], "cvssMetricV2": [{"cvssData": {"baseScore": 4.5}}]}, "references": [{"url": "http://n"}]}},
    {"cve": {"metrics": [1]}}, {"cve": None}, 7,
]}


def serve(request, timeout):
    """Answers like the services, for package a alone."""
    body = json.loads(request.data) if request.data else {}
    if "osv" in request.full_url:
        answer = OSV if body["package"]["name"] == "a" else {}
    elif "github" in request.full_url:
        answer = GITHUB if "affects=a&" in request.full_url else {"message": "odd"}
    else:
        answer = NVD if "keywordSearch=a+" in request.full_url else None
    return io.BytesIO(json.dumps(answer).encode())


def test_answers():
    how = A.Lookup()
    assert A.asked("osv", "python", "a", "1", how, {}, serve) == [("O-1", 7.5, "s", ["http://r"]), ("OSV-UNKNOWN", None, "Known vulnerability found", [])]
    assert A.asked("github", "node", "a", "1", how, {}, serve) == [("G-1", 9.0, "t", ["http://g"]), ("GHSA-UNKNOWN", None, "GitHub advisory found", [])]
    assert A.asked("nvd", "node", "a", "1", how, {}, serve) == [("C-1", 4.5, "yes", ["http://n"]), ("CVE-UNKNOWN", None, "NVD vulnerability found", [])]
    for provider in ("osv", "github", "nvd", "unknown"):
        assert A.asked(provider, "python", "b", "1", how, {}, serve) == []


def test_requests():
    seen = []

    def opener(request, timeout):
        seen.append((request, timeout))
        return io.BytesIO(b"[]")

    keys = {"OSV_API_KEY": "k1", "GH_TOKEN": "k2", "NVD_API_KEY": "k3"}
    for provider in ("osv", "github", "nvd"):
        A.asked(provider, "python", "n", "1.0", A.Lookup(timeout_s=3), keys, opener)
    (osv, t), (git, _), (nvd, _) = seen
    assert t == 3 and json.loads(osv.data) == {"package": {"name": "n", "ecosystem": "PyPI"}, "version": "1.0"} and osv.get_header("Authorization") == "Bearer k1"
    assert git.full_url == "https://api.github.com/advisories?ecosystem=pip&affects=n&per_page=20" and git.get_header("Authorization") == "Bearer k2"
    assert nvd.full_url.endswith("keywordSearch=n+1.0&resultsPerPage=20") and nvd.get_header("Apikey") == "k3"


@pytest.mark.parametrize("fails,retries,found", [(2, 2, 2), (3, 2, 0), (1, 0, 0), (0, 0, 2)])
def test_retries(fails, retries, found):
    left, pauses = [fails], []

    def opener(request, timeout):
        left[0] -= 1
        if left[0] >= 0:
            if left[0] % 2:
                raise urllib.error.URLError("down")
            return io.BytesIO(b"no json")
        return serve(request, timeout)

    assert len(A.asked("osv", "python", "a", "1", A.Lookup(retries=retries), {}, opener, sleep=pauses.append)) == found
    assert pauses == [min(0.5 * 2**i, 2.0) for i in range(min(fails, retries))]


def test_settings():
    assert A.lookup({}) == A.Lookup()
    assert A.lookup({"VULN_API_TIMEOUT_SEC": "3", "VULN_MAX_RETRIES": "0", "VULN_PROVIDER_ORDER": "nvd"}) == A.Lookup(("nvd",), True, 3, 0)


def test_fetched_table(spark):
    deps = [("a", "==1", "python"), ("a", "==1", "python"), ("a", ">=1", "python"), ("a", "1.0.0", "node"), ("b", "==2", "python")]
    df = spark.createDataFrame(deps, "name string, spec string, ecosystem string")
    rows = A.fetched(df, A.Lookup(), {}, serve, parallel=2).collect()
    assert sorted({(r["ecosystem"], r["name"], r["version"]) for r in rows}) == [("node", "a", "1.0.0"), ("python", "a", "1")]
    assert sorted(r["vuln_id"] for r in rows if r["ecosystem"] == "python") == ["C-1", "CVE-UNKNOWN", "G-1", "GHSA-UNKNOWN", "O-1", "OSV-UNKNOWN"]
    once = A.fetched(df, A.Lookup(("github", "osv"), fallback=False), {}, serve).collect()
    assert {r["source"] for r in once} == {"github"}
    assert A.fetched(df.limit(0), A.Lookup(), {}, serve).count() == 0
    ranked = A.ranked(A.fetched(df, A.Lookup(), {}, serve))
    assert ranked.where("ecosystem = 'python'").count() == 6
