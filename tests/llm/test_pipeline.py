"""The whole pipeline on planted documents, against plain Python."""

import contextlib
import random
from pathlib import Path

import pytest

import corpus_pipeline
from grovewise.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _bad long, _text int"
LICENSE = "All rights reserved by the authors of this page."


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_on_planted_documents(spark, tmp_path):
    """Of 60 clean documents all but the one that holds a benchmark item stay, without a license that eight of them have; copies, near copies,
    NULL, empty and short texts go; the other columns, of names that the stages use themselves, are as they were."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnoprstu", k=draw.randint(3, 9))) for _ in range(2000)]
    body = {i: "\n".join(" ".join(draw.choices(words, k=20)).capitalize() + "." for _ in range(5)) for i in range(60)}
    text = {i: body[i] + ("\n" + LICENSE) * (i < 8) for i in body}
    item = " ".join(body[20].split()[30:50])
    text |= {100: text[0], 101: text[1].replace(body[1].split()[-1], "changed."), 200: None, 201: "", 202: "Too short."}
    docs = [(i, t, "en", "s", len(t or ""), f"g{i}", None if i % 2 else i, i) for i, t in text.items()]
    out = corpus_pipeline.run(spark, write(spark, tmp_path, docs, [(1, item), (2, None)]))
    got = {r.doc_id: r for r in out.collect()}

    assert len(got) == out.count() and out.columns[:8] == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(i % 100 for i in got) == sorted(i for i in body if i != 20)
    assert len({0, 100} & set(got)) == 1 and len({1, 101} & set(got)) == 1
    before = {d[0]: d for d in docs}
    for i, r in got.items():
        want = "\n".join(x for x in text[i].split("\n") if x != LICENSE)
        assert r.text == want and r.n_chars == len(want)
        assert (r.lang, r.source, r._gone, r._bad, r._text) == before[i][2:4] + before[i][5:]
        assert r.lossless and r.n_pieces == len(r.ids) > 0


@pytest.mark.parametrize("n", [0, 1])
def test_run_on_nothing(spark, tmp_path, n):
    """An empty table, and one of a single NULL text, give an empty result with all columns."""
    out = corpus_pipeline.run(spark, write(spark, tmp_path, [(1, None, None, None, None, None, None, None)] * n, []))
    assert out.isEmpty() and out.columns[:8] == [c.split()[0] for c in SCHEMA.split(", ")]


def test_stored_tables_leave_no_full_heap(spark, monkeypatch):
    """The driver collects its garbage after a stored table if its heap has grown beyond half, and only then; the plan's text is cut meanwhile, and no longer."""
    collected, texts = [], []
    monkeypatch.setattr(common, "release", lambda s: collected.append(s))
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    short = common.short_plans

    @contextlib.contextmanager
    def seen(s):
        with short(s):
            texts.append(s.conf.get(key))
            yield

    monkeypatch.setattr(common, "short_plans", seen)
    for full in (False, True):
        monkeypatch.setattr(common, "crowded", lambda s, full=full: full)
        assert common.stored(spark.range(5), "t").count() == 5
    assert len(collected) == 1 and texts == ["4096"] * 2 and before != "4096"
    assert spark.conf.get(key) == before


def test_stored_tables_return_free_memory_outside_the_heap(spark):
    """What the driver's JVM has freed outside its heap, below memory still in use, goes back to the system with the next stored table."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    mb = lambda: int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * 4096 >> 20
    common.trim_driver(spark)
    zips = [jvm.java.util.zip.Deflater() for _ in range(800)]
    full = mb()
    for z in zips[:-1]:
        z.end()
    kept = mb()
    common.stored(spark.range(5), "t")
    assert kept > full - 20 and mb() < full - 40
    zips[-1].end()
