"""What to scan: settings, repository addresses, archives and git metadata.

Fetching runs on the driver, before Spark reads anything.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import tempfile
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import urlsplit

_OWNER = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})")
_REPO = re.compile(r"[A-Za-z0-9_.-]+")
CHUNK = 1024 * 1024


class BadTarget(ValueError):
    """The target can't be scanned as it is given."""


@dataclass(frozen=True)
class Settings:
    local_dir: str | None
    repo_url: str | None
    ref: str | None
    subdir: str | None
    output_dir: str | None
    timeout_s: int
    max_download: int
    max_total: int
    max_files: int
    max_file: int


def _value(env: Mapping[str, str], key: str) -> str:
    """A setting without the quotes that may stand around it."""
    return env.get(key, "").strip().strip('"').strip("'")


def dotenv(path: str, env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """env and, for what it lacks, the NAME=VALUE lines of a file, if there is one."""
    out: dict[str, str] = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                m = re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*", line.rstrip("\n"))
                if m and not line.lstrip().startswith("#"):
                    quoted = re.fullmatch(r"(['\"])(.*)\1(?:\s+#.*)?", m[2])
                    out[m[1]] = quoted[2] if quoted else re.sub(r"\s+#.*$", "", m[2])
    return out | dict(env)


def _positive(env: Mapping[str, str], key: str, default: int) -> int:
    raw = _value(env, key)
    if not raw:
        return default
    if not raw.isdigit() or int(raw) == 0:
        raise BadTarget(f"{key} must be a positive number")
    return int(raw)


def settings(env: Mapping[str, str] = os.environ, url: str | None = None, ref: str | None = None, subdir: str | None = None, output_dir: str | None = None) -> Settings:
    """Settings from the environment; arguments win. A target is a directory or an address, never both."""
    local, remote = _value(env, "TARGET_DIR") or None, _value(env, "TARGET_REPO_URL") or None
    if url:
        local, remote = None, url
    if bool(local) == bool(remote):
        raise BadTarget("give either TARGET_DIR or TARGET_REPO_URL")
    if local and not os.path.isdir(local):
        raise BadTarget(f"no such directory: {local}")
    out = output_dir or _value(env, "OUTPUT_DIR") or None
    if out and os.path.exists(out) and not os.path.isdir(out):
        raise BadTarget(f"not a directory: {out}")
    if out:
        os.makedirs(out, exist_ok=True)
    mb = 1024 * 1024
    return Settings(
        local, remote, ref or _value(env, "TARGET_REF") or None, subdir or _value(env, "TARGET_SUBDIR") or None, out,
        _positive(env, "TARGET_FETCH_TIMEOUT_SEC", 60), _positive(env, "TARGET_MAX_DOWNLOAD_MB", 100) * mb, _positive(env, "TARGET_MAX_EXTRACTED_MB", 300) * mb,
        _positive(env, "TARGET_MAX_FILES", 30_000), _positive(env, "TARGET_MAX_SINGLE_FILE_MB", 10) * mb,
    )


def target_dir(env: Mapping[str, str] = os.environ) -> str:
    """The absolute path that TARGET_DIR names, which must be a directory; addresses aren't looked at."""
    raw = _value(env, "TARGET_DIR")
    if not raw:
        raise BadTarget("TARGET_DIR is not set")
    path = os.path.realpath(os.path.expanduser(raw))
    if not os.path.isdir(path):
        raise BadTarget(f"no such directory: {path}")
    return path


def repository(url: str) -> tuple[str, str]:
    """(owner, repository) of an https://github.com address without credentials or port; what follows these two (a branch, a query) is not looked at."""
    parts = urlsplit(url.strip())
    if parts.scheme != "https" or parts.hostname != "github.com" or "@" in parts.netloc or ":" in parts.netloc:
        raise BadTarget(f"not a repository address: {url}")
    names = [p for p in parts.path.split("/") if p]
    if len(names) < 2:
        raise BadTarget(f"not a repository address: {url}")
    owner, repo = names[0], names[1].removesuffix(".git")
    if not _OWNER.fullmatch(owner) or not _REPO.fullmatch(repo) or repo in (".", ".."):
        raise BadTarget(f"not a repository address: {url}")
    return owner, repo


def retried(call: Callable, times: int = 2, sleep: Callable[[float], None] = time.sleep):
    """The result of call(), tried again up to ``times`` times after a network error, with growing pauses of at most two seconds."""
    for attempt in range(times + 1):
        try:
            return call()
        except OSError:  # what urllib raises, time-outs included
            if attempt == times:
                raise
            sleep(min(0.5 * 2**attempt, 2.0))


def archived(owner: str, repo: str, env: Mapping[str, str] = os.environ, opener: Callable = urllib.request.urlopen) -> bool | None:
    """Whether the hosting service calls a repository archived; None when it can't be asked."""
    headers = {"Accept": "application/vnd.github+json"}
    if token := env.get("GITHUB_TOKEN") or env.get("GH_TOKEN"):
        headers["Authorization"] = f"Bearer {token}"
    request = urllib.request.Request(f"https://api.github.com/repos/{owner}/{repo}", headers=headers)
    try:
        with opener(request, timeout=5) as answer:
            value = json.loads(answer.read().decode("utf-8", "ignore")).get("archived")
    except (OSError, ValueError, AttributeError):
        return None
    return value if isinstance(value, bool) else None


def download(url: str, to: str, timeout_s: int, max_bytes: int, opener: Callable = urllib.request.urlopen) -> str:
    """Copies url to a file, at most max_bytes."""
    done = 0
    with retried(lambda: opener(url, timeout=timeout_s)) as src, open(to, "wb") as dst:
        while chunk := src.read(CHUNK):
            done += len(chunk)
            if done > max_bytes:
                raise BadTarget(f"download exceeds {max_bytes} bytes")
            dst.write(chunk)
    return to


@contextmanager
def resolved(s: Settings, fetch: Callable[..., str] = download) -> Iterator[str]:
    """The directory or archive to read; a download is removed afterwards."""
    if s.local_dir:
        yield s.local_dir
        return
    owner, repo = repository(s.repo_url)
    work = tempfile.mkdtemp(prefix="riskloom-")
    try:
        address = f"https://api.github.com/repos/{owner}/{repo}/zipball/{s.ref or 'HEAD'}"
        yield fetch(address, os.path.join(work, "target.zip"), s.timeout_s, s.max_download)
    finally:
        shutil.rmtree(work, ignore_errors=True)


def _git(path: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, errors="ignore", check=False)
    except OSError:
        return None
    return done.stdout.strip() if done.returncode == 0 else None


#: Fixed value: how a remote names its repository.
_REMOTE = re.compile(r"github\.com[:/](?P<owner>[A-Za-z0-9_.-]+)/(?P<repo>[A-Za-z0-9_.-]+?)(?:\.git)?$", re.IGNORECASE)


def git_remote(path: str) -> tuple[str, str] | None:
    """(owner, repository) of the remote named origin."""
    found = _REMOTE.search(_git(path, "remote", "get-url", "origin") or "")
    return (found["owner"], found["repo"]) if found else None


def git_metadata(path: str, now_ts: int, ask: Callable[[str, str], bool | None] = archived) -> dict:
    """One row of repo_meta for a checked-out repository; what is unknown is None."""
    remote = git_remote(path)
    commit = _git(path, "log", "-1", "--format=%ct")
    authors = _git(path, "shortlog", "-sne", "--all")
    tags = _git(path, "for-each-ref", "--sort=-creatordate", "--format=%(creatordate:unix)", "refs/tags") or ""
    times = [int(t) for t in tags.split() if t.isdigit()]
    return {
        "last_commit_ts": int(commit) if commit and commit.isdigit() else None,
        "author_count": len([a for a in authors.splitlines() if a.strip()]) if authors else None,
        "last_tag_ts": times[0] if times else None,
        "archived": ask(*remote) if remote else None,
        "now_ts": now_ts,
    }
