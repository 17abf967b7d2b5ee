import io
import os
import stat
import zipfile

import pytest

from riskloom.sources import targets
from riskloom.sources.tree import UnsafeArchive, checked_entries, read_tree


def _zip(entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data, attr in entries:
            info = zipfile.ZipInfo(name)
            info.external_attr = attr
            z.writestr(info, data)
    buf.seek(0)
    return zipfile.ZipFile(buf)


def test_hidden_and_empty_files_are_seen(spark, tmp_path):
    for name, data in ((".github/workflows/a.yml", "x"), ("_p/b", "y"), (".env", "z"), ("SECURITY.md", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    os.chmod(tmp_path / ".env", 0o600)
    rows = {r["path"]: r for r in read_tree(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [".env", ".github/workflows/a.yml", "SECURITY.md", "_p/b"]
    assert rows[".env"]["mode"] == 0o600 and rows["SECURITY.md"]["content"] == b""
    assert [r["path"] for r in read_tree(spark, str(tmp_path), subdir="_p").collect()] == ["b"]


def test_zip_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/a.txt", "1")
        z.writestr("top/sub/b.txt", "2")
    got = sorted((r["path"], bytes(r["content"])) for r in read_tree(spark, str(tmp_path / "a.zip")).collect())
    assert got == [("a.txt", b"1"), ("sub/b.txt", b"2")]
    assert [r["path"] for r in read_tree(spark, str(tmp_path / "a.zip"), subdir="sub").collect()] == ["b.txt"]


@pytest.mark.parametrize("entries,limits", [
    ([("../x", b"1", 0)], (9, 99, 99)),
    ([("/x", b"1", 0)], (9, 99, 99)),
    ([("a/l", b"x", (stat.S_IFLNK | 0o777) << 16)], (9, 99, 99)),
    ([("a", b"1", 0), ("b", b"1", 0)], (1, 99, 99)),
    ([("a", b"12345", 0)], (9, 99, 4)),
    ([("a", b"123", 0), ("b", b"123", 0)], (9, 5, 4)),
])
def test_unsafe_archives(entries, limits):
    with pytest.raises(UnsafeArchive):
        checked_entries(_zip(entries), *limits)


def test_repository_addresses():
    assert targets.repository("https://github.com/a/b") == ("a", "b")
    assert targets.repository("https://github.com/a/b.git") == ("a", "b")
    assert targets.repository("https://github.com/a/b/tree/main/c?x=1#y") == ("a", "b")
    for bad in ("http://github.com/a/b", "https://x.com/a/b", "https://u@github.com/a/b", "https://github.com:1/a/b", "https://github.com/a", "https://github.com/a/..", "git@github.com:a/b", ""):
        with pytest.raises(targets.BadTarget):
            targets.repository(bad)


def test_settings(tmp_path):
    s = targets.settings({"TARGET_DIR": str(tmp_path)}, url="https://github.com/a/b", ref="v1")
    assert (s.local_dir, s.repo_url, s.ref) == (None, "https://github.com/a/b", "v1")
    s = targets.settings({"TARGET_DIR": str(tmp_path), "TARGET_MAX_FILES": "7"}, output_dir=str(tmp_path / "out"))
    assert s.max_files == 7 and os.path.isdir(tmp_path / "out")
    for env in ({}, {"TARGET_DIR": str(tmp_path), "TARGET_REPO_URL": "x"}, {"TARGET_DIR": "/no/such"}, {"TARGET_DIR": str(tmp_path), "TARGET_MAX_FILES": "0"}):
        with pytest.raises(targets.BadTarget):
            targets.settings(env)


def test_settings_from_a_file(tmp_path):
    (tmp_path / ".env").write_text("# TARGET_DIR=/no\nexport TARGET_REPO_URL='https://github.com/a/b' # here\nTARGET_REF=v1 # tag\nTARGET_SUBDIR = \"x y\"\nTARGET_MAX_FILES='7'\nodd line\n")
    s = targets.settings(targets.dotenv(str(tmp_path / ".env"), {"TARGET_REF": '"v2"'}))
    assert (s.repo_url, s.ref, s.subdir, s.max_files, s.local_dir) == ("https://github.com/a/b", "v2", "x y", 7, None)
    assert targets.dotenv(str(tmp_path / "none"), {"A": "b"}) == {"A": "b"}


def test_target_dir(tmp_path):
    (tmp_path / "d").mkdir()
    assert targets.target_dir({"TARGET_DIR": f" '{tmp_path}/d/../d' ", "TARGET_REPO_URL": "x"}) == os.path.realpath(tmp_path / "d")
    for env in ({}, {"TARGET_DIR": " "}, {"TARGET_DIR": str(tmp_path / "none")}):
        with pytest.raises(targets.BadTarget):
            targets.target_dir(env)


def test_resolver_removes_downloads(tmp_path):
    seen = []
    s = targets.settings({"TARGET_REPO_URL": "https://github.com/a/b"})
    with targets.resolved(s, fetch=lambda url, to, *a: (seen.append((url, to)), open(to, "w").close(), to)[-1]) as path:
        assert os.path.exists(path)
    assert seen[0][0].endswith("/repos/a/b/zipball/HEAD") and not os.path.exists(seen[0][1])


def test_scan_writes_a_report(spark, tmp_path, capsys):
    from riskloom.cli import scan

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\nos.system(input())\nverify = False\n")
    where, n, errors = scan(spark, targets.settings({"TARGET_DIR": str(tmp_path / "src")}, output_dir=str(tmp_path / "out")))
    assert n > 0 and errors == [] and sorted(f.partition("_")[0] for f in os.listdir(tmp_path / "out")) == ["findings.parquet", "report"]
    with open(where, encoding="utf-8") as f:
        text = f.read()
    assert "### High: A-1 Command Injection (code)\n\n- `a.py`:2 External input" in text and text.index("## 3.") < text.index("## 4.") < text.index("## 5.")
    assert scan(spark, targets.settings({"TARGET_DIR": str(tmp_path / "src")}))[0] is None
    assert "### High: A-1 Command Injection (code)\n\n- `a.py`:2 External input" in capsys.readouterr().out


def test_report_lists_every_finding(spark):
    from datetime import datetime

    from riskloom.operators import report

    f = spark.range(10_050).selectExpr("'C-1' as rule_id", "'c' as category", "'t' as title", "if(id < 10040, 'High', 'Info') as severity", "concat('f', id) as file_path", "cast(id as int) as line", "'m' as message")
    text = report.markdown(f, [], "x", datetime(2024, 1, 1))
    detail = text[text.index("## 4. Details") :].splitlines()
    assert {x for x in detail if x.startswith("- ")} == {f"- `f{i}`:{i} m" for i in range(10_050)}
    assert [x for x in detail if x.startswith("### ")] == ["### High: C-1 t (c)", "### Info: C-1 t (c)"]


def test_executors_write_the_same_report(spark, tmp_path, monkeypatch):
    """Parts by name are the report; many partitions, groups that span them, and places out of order."""
    from datetime import datetime

    from pyspark.sql import DataFrame

    from riskloom.operators import report

    rows = [(f"R-{i % 3}", "c", f"t{i % 3}", ("High", "Low", "Critical")[i % 7 % 3], None if i % 11 == 0 else f"d/{997 * i % 500}", i % 5 or None, None if i % 13 == 0 else f"m {i}") for i in range(2000)]
    f = spark.createDataFrame(rows, "rule_id string, category string, title string, severity string, file_path string, line long, message string").repartition(7)
    now, errors = datetime(2024, 1, 1), [("X-1", "boom\nmore")]
    want = report.markdown(f, errors, "x", now)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a: pytest.fail("findings on the driver"))
    report.write_markdown(f, errors, "x", now, f"file://{tmp_path}/parts")
    report.join_parts(f"{tmp_path}/parts", f"{tmp_path}/r.md")
    with open(f"{tmp_path}/r.md", encoding="utf-8") as got:
        assert got.read() == want
    # the definition: sorted findings, a heading where a group begins
    order = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3, "Info": 4}
    lines, group = [], None
    text = lambda r: (f"- `{r[4] or '-'}`" + (f":{r[5]}" if r[5] is not None else "") + f" {r[6] or ''}").rstrip()
    for r in sorted(rows, key=lambda r: (order[r[3]], r[0], r[4] or "", r[5] or 0, text(r))):
        if (r[3], r[0]) != group:
            group = (r[3], r[0])
            lines += [f"### {r[3]}: {r[0]} {r[2]} ({r[1]})", ""]
        lines.append(text(r))
    assert want.split("## 4. Details\n\n")[1] == "\n".join([*lines, "", "## 5. Errors", "", "- X-1: boom"]) + "\n"


def test_stream(spark, tmp_path):
    from riskloom.streaming.findings import stream_findings

    spark.createDataFrame([("a.py", "get(u, verify=False)")], "path string, text string").write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in"))
    q = stream_findings(files).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [r["rule_id"] for r in spark.sql("SELECT rule_id FROM found").collect()] == ["H-2"]


def test_remote_and_archived(tmp_path):
    import io
    import subprocess

    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True)

    git("init")
    assert targets.git_metadata(str(tmp_path), 5, ask=lambda o, r: True)["archived"] is None  # no remote, nobody is asked
    git("remote", "add", "origin", "git@github.com:acme/tool.git")
    asked = []
    assert targets.git_metadata(str(tmp_path), 5, ask=lambda o, r: asked.append((o, r)) or True)["archived"] is True and asked == [("acme", "tool")]

    def opener(body):
        def run(request, timeout):
            asked.append((request.full_url, request.headers.get("Authorization")))
            return io.BytesIO(body)

        return run

    assert targets.archived("a", "b", {"GH_TOKEN": "t"}, opener(b'{"archived": true}')) is True and asked[-1] == ("https://api.github.com/repos/a/b", "Bearer t")
    assert targets.archived("a", "b", {}, opener(b'{"archived": "no"}')) is None and targets.archived("a", "b", {}, opener(b"no json")) is None

    def broken(request, timeout):
        raise OSError

    assert targets.archived("a", "b", {}, broken) is None


def test_retries():
    pauses, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert targets.retried(call, 2, pauses.append) == "ok" and pauses == [0.5, 1.0]
    calls.clear()
    with pytest.raises(OSError):
        targets.retried(call, 1, pauses.append)


def test_archive_is_read_in_ranges(spark, tmp_path, monkeypatch):
    """Planning parses the directory once; a partition's reads stay inside its entries."""
    import random

    from riskloom.sources import tree

    rng = random.Random(1)
    texts = {f"top/d{i % 3}/f{i}.bin": rng.randbytes(2000) if i % 2 else b"abc" * 5000 for i in range(30)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, data) in enumerate(texts.items()):
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if i % 5 == 0 else zipfile.ZIP_DEFLATED)
    monkeypatch.setattr(tree, "ARCHIVE_BYTES", 4000)
    reader = tree._Reader({"path": str(tmp_path / "a.zip")}, True)
    parts = reader.partitions()
    assert len(parts) > 4
    monkeypatch.setattr(tree.zipfile, "ZipFile", lambda *a: pytest.fail("a reader opened the archive as a whole"))
    real, spans = open, []

    class Watched:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            spans.append((self.f.tell(), self.f.tell() + n))
            return self.f.read(n)

    monkeypatch.setattr("builtins.open", lambda path, *a, **k: Watched(real(path, *a, **k)) if str(path).endswith("a.zip") else real(path, *a, **k))
    got, ends = {}, 0
    for p in parts:
        spans.clear()
        got |= {path: data for path, _, data in reader.read(p)}
        if spans:
            assert min(s for s, _ in spans) >= ends
            ends = max(e for _, e in spans)
    assert got == {k.removeprefix("top/"): v for k, v in texts.items()}


def test_damaged_archive(tmp_path):
    from riskloom.sources import tree

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a", b"x" * 100)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[40] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(data))
    reader = tree._Reader({"path": str(tmp_path / "a.zip")}, True)
    with pytest.raises(UnsafeArchive):
        [row for p in reader.partitions() for row in reader.read(p)]


def _tree(top):
    names = [".env", "a.py", "src/b.py", "src/c.js", "src/deep/er/d.py", "src/deep/x.txt", "web/.hidden/e.js", "web/empty.js", "z/.git/f"]
    for name in names:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("" if "empty" in name else name)
    (top / "none").mkdir()
    os.symlink(top / "src", top / "link")
    os.symlink(top / "a.py", top / "web" / "a-link.py")
    return [*names, "web/a-link.py"]


def test_planning_lists_the_top_level_only(tmp_path, monkeypatch):
    from riskloom.sources import tree

    names = _tree(tmp_path)
    seen, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: seen.append(os.path.relpath(p, tmp_path)) or scan(p))
    monkeypatch.setattr(os, "walk", lambda *a: pytest.fail("walked"))
    reader = tree._Reader({"path": str(tmp_path)}, True)
    parts = reader.partitions()
    assert seen == ["."] and [p.directory for p in parts] == ["", "none/", "src/", "web/", "z/"]
    assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted(names)


def test_directories_are_expanded_by_a_job(spark, tmp_path, monkeypatch):
    from riskloom.sources import tree

    names = _tree(tmp_path)
    found = tree.directories(spark, str(tmp_path), 100)
    assert found[0] == ("", False) and ("src/deep/", False) in found and ("src/deep/er/", True) in found
    assert tree.directories(spark, str(tmp_path), 5) == [("", False), ("none/", True), ("src/", True), ("web/", True), ("z/", True)]
    assert tree.directories(spark, str(tmp_path), 100, most=2)[-1] == ("z/", True)  # a level of three is too many
    assert sorted(r["path"] for r in read_tree(spark, str(tmp_path)).collect()) == sorted(names)
    assert [r["path"] for r in read_tree(spark, str(tmp_path), subdir="src/deep").orderBy("path").collect()] == ["er/d.py", "x.txt"]


def test_only_what_is_wanted_is_opened(spark, tmp_path, monkeypatch):
    from riskloom.sources import tree

    names = _tree(tmp_path)
    cases = {
        ("", ".py", ""): lambda p: p.endswith(".py"), ("src/deep", "", ""): lambda p: p.startswith("src/deep"), ("src/", ".js, .txt", ""): lambda p: p.startswith("src/") and p.endswith((".js", ".txt")),
        ("", "", "f,a.py"): lambda p: p in ("a.py", "z/.git/f"), ("src/c.js", "", ""): lambda p: p == "src/c.js", ("no", "", ""): lambda p: False,
    }
    for (prefix, suffixes, files), holds in cases.items():
        got = read_tree(spark, str(tmp_path), prefix=prefix, suffixes=suffixes, names=files).collect()
        assert sorted(r["path"] for r in got) == sorted(filter(holds, names))
    # files opened and directories entered, in this process
    opened, entered, read, scan = [], [], tree.read_file, os.scandir
    monkeypatch.setattr(tree, "read_file", lambda p: opened.append(os.path.relpath(p, tmp_path)) or read(p))
    monkeypatch.setattr(os, "scandir", lambda p: entered.append(os.path.relpath(p, tmp_path)) or scan(p))
    reader = tree._Reader({"path": str(tmp_path), "prefix": "src/deep", "suffixes": ".py"}, True)
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["src/deep/er/d.py"]
    assert opened == ["src/deep/er/d.py"] and set(entered) == {".", "src", "src/deep", "src/deep/er"}
    opened.clear()
    bare = tree._Reader({"path": str(tmp_path)}, False)
    assert sorted(r[0] for p in bare.partitions() for r in bare.read(p)) == sorted(names) and opened == []
    files = spark.read.format("sourcetree").schema("path string, mode int").load(str(tmp_path))
    assert files.count() == len(names) and files.where("endswith(path, '.py')").count() == 4
    assert files.where("path > 'src'").count() == len([n for n in names if n > "src"])
