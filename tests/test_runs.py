"""State across runs, the store of answers, and searches of streams: killed runs, two writers, late files, restarts."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from docloom import api
from docloom.operators import review, runs
from docloom.operators.answers import AnswerStore
from docloom.streaming import search

PAGE = "page_id string, title string, parent_id string, status string, version long, labels array<string>"
EVERY = "page_id string, space_id string, space_key string"


def pages(spark, *rows):
    return spark.createDataFrame([(i, t, "0", s, v, ["l"]) for i, t, s, v in rows], PAGE)


def failing(*ids):
    return lambda events: events.withColumn("error", F.when(F.col("page_id").isin(*ids), "refused"))


def test_runs_of_a_space(spark, tmp_path):
    folder, nowhere = str(tmp_path / "state"), spark.createDataFrame([("3", "B", "other")], EVERY)
    first = pages(spark, ("1", "a", "current", 1), ("2", "b", "current", 1), ("3", "c", "current", 1))
    sync = lambda desired, **more: runs.sync_space(spark, folder, desired, nowhere, "A", now="2024-01-01 00:00:00", **more)
    one = sync(first, apply=failing("2"))
    assert (one.version, one.changed, one.counts) == (1, True, {"NEW": 2, "failed": 1})
    two = sync(first)  # only what failed comes up again
    assert (two.version, two.counts) == (2, {"NEW": 1}) and [r.page_id for r in two.listed("NEW").collect()] == ["2"]
    again = sync(first)
    assert (again.version, again.changed, again.events.count()) == (2, False, 0)

    def dies(events):
        raise RuntimeError("killed")

    changed = pages(spark, ("1", "a2", "current", 2), ("2", "b", "archived", 1))
    with pytest.raises(RuntimeError):
        sync(changed, apply=dies)
    assert runs.versions(spark, folder) == [1, 2]
    three = sync(changed)
    assert three.counts == {"RENAME": 1, "CONTENT_EDIT": 1, "ARCHIVE": 1, "CROSS_SPACE_MOVE": 1}
    assert "RENAME: 1" in three.message("sync A") and runs.details(spark, folder, 3)["counts"] == three.counts
    _, state = runs.load(spark, folder, runs.STATE)
    assert sorted((r.page_id, r.title, r.status, r.version) for r in state.collect()) == [("1", "a2", "current", 2), ("2", "b", "archived", 1)]
    assert runs.load(spark, folder, runs.STATE, 1)[1].count() == 2  # older versions can still be read
    assert not sync(changed).changed and not sync(pages(spark), no_delete=True).changed


def test_a_run_that_died_while_writing_changes_nothing(spark, tmp_path, monkeypatch):
    folder, state = str(tmp_path / "s"), pages(spark, ("1", "a", "current", 1))
    monkeypatch.setattr(runs.json, "dumps", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed after its table")))
    with pytest.raises(RuntimeError):
        runs.keep(state, folder, 0, "r1")
    monkeypatch.undo()
    assert runs.versions(spark, folder) == [] and len(os.listdir(folder)) == 1
    assert runs.keep(state, folder, 0, "r1") == 1
    with pytest.raises(runs.LostRace):
        runs.keep(state, folder, 0, "r2")
    (tmp_path / "s" / "versions" / "000000000002.json").touch()  # died between making its version's file and writing it
    assert runs.versions(spark, folder) == [1]
    with pytest.raises(runs.LostRace):
        runs.keep(state, folder, 1, "r3")
    os.utime(tmp_path / "s" / "versions" / "000000000002.json", (1, 1))
    assert runs.keep(state, folder, 1, "r3") == 2 and runs.versions(spark, folder) == [1, 2]


def test_only_one_of_two_runs_counts(spark, tmp_path):
    folder, state, out = str(tmp_path / "s"), pages(spark, ("1", "a", "current", 1)), []

    def go(name):
        try:
            out.append(runs.keep(state, folder, 0, name))
        except runs.LostRace:
            out.append(None)

    threads = [threading.Thread(target=go, args=(f"r{i}",)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, out)) == ["1", "None", "None", "None"] and runs.versions(spark, folder) == [1]


def test_runs_of_a_folder(spark, tmp_path):
    folder = str(tmp_path / "pairs")
    sources = spark.createDataFrame([("a.docx", "o1", False), ("b.docx", "o2", False)], "path string, sha256 string, locked boolean")
    files = {"a.docx.md": "m1", "b.docx.md": "m2"}
    outputs = lambda: spark.createDataFrame(list(files.items()), "path string, sha256 string")
    plan = lambda state: api.plan_folder(sources, outputs(), state)
    digests = lambda done: spark.createDataFrame([("a.docx.md", "o1", "m1"), ("b.docx.md", "o2", files["b.docx.md"])], "markdown string, office_sha256 string, md_sha256 string").join(done.select("markdown"), "markdown", "left_semi")
    one = runs.sync_folder(spark, folder, plan, digests)
    assert one.counts == {"first_sync_both_docx_wins": 2}
    assert not runs.sync_folder(spark, folder, plan, digests).changed
    files["b.docx.md"] = "m3"
    assert runs.sync_folder(spark, folder, plan, digests).counts == {"md_to_docx": 1}
    assert not runs.sync_folder(spark, folder, plan, digests).changed


def test_answers_are_kept_and_not_asked_again(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "answers"))
    assert store.entries().count() == 0 and store.clear() == 0
    prompts = spark.createDataFrame([("p1",), ("p2",), ("p1",), ("bad",)], "prompt string")

    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    got = [tuple(r) for r in review.ask(prompts.where("prompt <> 'bad'"), model, cache=store).select("prompt", "answer", "cached", "error").collect()]
    assert sorted(got) == [("p1", "P1", False, None), ("p1", "P1", False, None), ("p2", "P2", False, None)]
    again = review.ask(prompts, lambda texts: [1 / 0 for _ in texts], cache=store)
    assert sorted((r.prompt, r.answer, r.cached, r.error) for r in again.collect()) == [("bad", None, False, "ZeroDivisionError: division by zero"), ("p1", "P1", True, None), ("p1", "P1", True, None), ("p2", "P2", True, None)]
    assert review.ask_counts([again]) == {"pairs": 4, "calls": 1, "cached": 3, "errors": 1}
    vectors = review.embed(prompts.select(F.col("prompt").alias("text")), lambda texts: [[len(t), 0.5] for t in texts], cache=AnswerStore(spark, str(tmp_path / "vectors")))
    assert {(r.text, tuple(r.embedding)) for r in vectors.collect()} == {("p1", (2.0, 0.5)), ("p2", (2.0, 0.5)), ("bad", (3.0, 0.5))}


def test_last_write_wins_and_old_answers_go(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "answers"), ttl_seconds=100)
    at = lambda s: F.timestamp_seconds(F.lit(s))
    rows = lambda *r: spark.createDataFrame(r, "prompt_hash string, answer string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    store.put(rows(("aa1", "old", 10), ("bb2", "x", 10), ("cc3", None, 10), (None, "y", 10)))
    writers = [threading.Thread(target=store.put, args=(rows(("aa1", f"new{i}", 100 + i)),)) for i in range(3)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    os.makedirs(tmp_path / "answers" / "write-unfinished")  # a writer that died: not read
    assert {(r.prompt_hash, r.answer) for r in store.entries(at(105)).collect()} == {("aa1", "new2"), ("bb2", "x")}
    assert [r.prompt_hash for r in store.entries(at(150)).collect()] == ["aa1"]
    assert [r.answer for r in store.get(spark.createDataFrame([("bb2",)], "prompt_hash string"), at(105)).collect()] == ["x"]
    assert store.prune(at(150)) == 1 and len(store.writes()) == 1
    assert [(r.prompt_hash, r.answer) for r in store.entries(at(150)).collect()] == [("aa1", "new2")]
    assert store.clear() == 1 and store.entries(at(150)).count() == 0


def test_report_counts_what_was_asked(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "red green blue words here"), ("b.md", "red green blue words there"), ("c.md", "other things")], "path string, text string")
    store = AnswerStore(spark, str(tmp_path / "answers"))
    model = lambda prompts: ['{"overlap": "high", "summary": "same"}' for _ in prompts]
    report = lambda: api.review_report(docs, model, ["inconsistencies"], "all", "2024-01-01", F.current_timestamp(), 1, {"inconsistencies": "inc"}, cache=store).first().text
    assert "**Pairs judged:** 3\n- **API calls:** 3  |  **Cached:** 0\n- **Errors:** 0" in report()
    assert "**Pairs judged:** 3\n- **API calls:** 0  |  **Cached:** 3\n- **Errors:** 0" in report()


def run_search(spark, tmp_path, **more):
    stream = search.file_stream(spark, str(tmp_path / "in"), files_per_batch=more.pop("files", 1000))
    query = search.search_stream(stream, "needle", str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True, **more)
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted((os.path.basename(r.path), r.line_no, r.line) for r in search.kept_matches(spark, str(tmp_path / "out")).collect())


def test_streamed_search_finds_late_files_and_keeps_its_limit(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    put = lambda name, text: (tmp_path / "in" / name).write_text(text)
    put("a.md", "x\nneedle 1\nneedle 2\nneedle 3\n")
    put("b.txt", "needle")
    assert run_search(spark, tmp_path, per_document=2, limit=4) == [("a.md", 2, "needle 1"), ("a.md", 3, "needle 2")]
    put("c.md", "Needle here")
    found = run_search(spark, tmp_path, per_document=2, limit=4)  # from the checkpoint: only the new file is read
    assert found[-1] == ("c.md", 1, "Needle here") and len(found) == 3
    assert not search.reached(spark, str(tmp_path / "out"), 4)
    put("d.md", "needle\nneedle")
    assert len(run_search(spark, tmp_path, per_document=2, limit=4)) == 4 and search.reached(spark, str(tmp_path / "out"), 4)
    put("e.md", "needle")
    assert len(run_search(spark, tmp_path, per_document=2, limit=4)) == 4


def test_cap_holds_over_parts_of_a_document(spark, tmp_path):
    shape = "path string, text string, first_line int"
    parts = str(tmp_path / "parts")
    spark.createDataFrame([("p", "needle a\nneedle b", 0), ("q", "none", 0)], shape).write.parquet(parts)

    def go():
        stream = spark.readStream.schema(shape).parquet(parts)
        query = search.search_stream(stream, "needle", str(tmp_path / "out"), str(tmp_path / "cp"), per_document=3, limit=None, once=True)
        query.awaitTermination(120)
        return sorted((r.path, r.line_no) for r in search.kept_matches(spark, str(tmp_path / "out")).collect())

    assert go() == [("p", 1), ("p", 2)]
    spark.createDataFrame([("p", "needle c\nneedle d", 2), ("q", "needle", 1)], shape).write.mode("append").parquet(parts)
    assert go() == [("p", 1), ("p", 2), ("p", 3), ("q", 2)]
