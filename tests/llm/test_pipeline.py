"""Each pipeline stage against a brute-force version on its own input."""

import collections
import random
import re

import corpus_pipeline as pipeline
from riskloom.llm import quality
from riskloom.llm.common import materialize, table


def _input(spark, path):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    shared = "\n".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(4))
    docs, labels = [], []
    for i in range(160):
        lines = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(6)]
        if i % 4 == 0:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) for x in lines]
        elif i % 7 == 0:
            lines[2:2] = shared.split("\n")
        elif i % 11 == 0 and (i - 1) % 4:
            lines = docs[-1][1].split("\n")[:]
            lines[0] += " tail"
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}", len("\n".join(lines))))
        labels.append((i, 0 if i % 4 == 0 else 1, 0))
    docs.append((1000, None, "en", "s0", 0))
    docs.append((1001, "", "en", None, 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def _rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    _input(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram jaccard join", "source mixing", "packing"]
    (_, keep), (_, lines), (_, near), (_, mix), (_, pack) = pipeline.STAGES

    # quality: the model's own decisions, clean documents stay
    first = materialize(spark, keep(spark, docs, sf), "t")
    model = quality.train_quality(spark, docs, table(spark, sf, "labels"))
    want = {r["doc_id"] for r in quality.score_quality(spark, docs, model).where(f"quality_score >= {pipeline.MIN_QUALITY}").collect()}
    kept = _rows(first)
    assert set(kept) == want and first.columns == columns
    assert {i for i in range(160) if i % 4} <= set(kept) and sum(i in kept for i in range(0, 160, 4)) <= 2

    # line dedup
    second = materialize(spark, lines(spark, first, sf), "t")
    seen, gone = {}, collections.defaultdict(set)
    for d, t in sorted(kept.items()):
        ls = t.split("\n") if t is not None else []
        for i in range(len(ls) - 2):
            if seen.setdefault(tuple(ls[i : i + 3]), (d, i)) != (d, i):
                gone[d] |= {i, i + 1, i + 2}
    want_lines = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in kept.items()}
    assert _rows(second) == want_lines and gone
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in second.collect())

    # n-gram Jaccard join: the smallest of each component stays
    third = materialize(spark, near(spark, second, sf), "t")
    sets = {}
    for d, t in want_lines.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if x]
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {d: d for d in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    moved = True
    assert _rows(third) == {d: want_lines[d] for d in sets if comp[d] == d}

    # mixing: every document once or twice, whole
    fourth = materialize(spark, mix(spark, third, sf), "t")
    uses = collections.Counter(r["doc_id"] for r in fourth.collect())
    assert set(uses) == set(_rows(third)) and max(uses.values()) <= 2 and _rows(fourth) == _rows(third)

    # packing: each use is packed whole
    pieces = pack(spark, fourth, sf).toPandas()
    for d, g in pieces.groupby("doc_id"):
        assert g.length.sum() == uses[d] * g.doc_tokens.iloc[0]
    assert set(pieces.doc_id) == set(uses)


def test_run(spark, tmp_path):
    _input(spark, str(tmp_path))
    assert pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"


NAMES = ["quality_score", "n_lines", "n_removed", "mix_block", "__mix_id", "rid", "sha", "comp", "h", "n", "k", "passes", "at", "id"]


def test_stages_keep_extra_columns_and_odd_rows(spark, tmp_path):
    """Nulls, empties, repeated and missing ids, a very long text, and columns named as the operators name theirs."""
    sf = str(tmp_path)
    _input(spark, sf)
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{n}` long" for n in NAMES)
    texts = [(1, None), (2, ""), (3, "a calm line of words\nanother calm line\na third one\nand a fourth"), (3, "unlike text of one id"), (4, "word " * 40_000), (5, "same text here"), (5, "same text here"), (None, "no id at all"), (6, " \n\n \n\n")]
    rows = [(d, t, None, None if d == 2 else "s", len(t or ""), *[100 * k + j for j in range(len(NAMES))]) for k, (d, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = [tuple(r[n] for n in NAMES) for r in out.collect()]
        assert set(got) <= {r[5:] for r in rows}, name
        if name != "quality classifier":
            kept = {r[0] for r in out.select("doc_id").collect()}
            assert kept == {1, 2, 3, 4, 5, 6, None}, name
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    pieces = pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == 7 and pipeline.STAGES[-1][1](spark, docs.where("false"), sf).count() == 0


def test_copies_caught_end_to_end(spark, tmp_path):
    """Exact copies are emptied or go, near ones that share no three lines go; clean documents stay whole."""
    rng = random.Random(12)
    words = [f"word{i}" for i in range(600)]
    docs, labels, exact, near, clean = [], [], set(), set(), set()
    for i in range(200):
        lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(8)]
        kind = i % 5
        if kind == 4 and i > 10:
            source = docs[rng.choice([k for k, (d, *_) in enumerate(docs) if d in clean])]
            if i % 2:
                exact.add(i)
                lines = source[1].split("\n")
            else:  # a word of every third line changes
                near.add(i)
                lines = source[1].split("\n")
                for k in range(1, len(lines), 3):
                    lines[k] = lines[k].rsplit(" ", 1)[0] + " other"
        elif kind == 3:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) for x in lines]
        else:
            clean.add(i)
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}", len("\n".join(lines))))
        labels.append((i, 0 if kind == 3 else 1, 0))
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    out = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:3]:
        out = materialize(spark, stage(spark, out, sf), "t")
    left = _rows(out)
    text = {d: t for d, t, *_ in docs}
    caught = lambda ids: [d for d in ids if len(left.get(d) or "") <= 0.5 * len(text[d])]
    assert len(exact) > 10 and len(near) > 10
    assert len(caught(exact)) == len(exact) and len(caught(near)) >= 0.9 * len(near)
    assert all(left[d] == text[d] for d in clean)
