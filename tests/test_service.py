"""States, batches to backends, detection in flight, profiles, heads of books, uploads and publication: each against brute force, a fold or a count of calls."""

import random
import subprocess
import sys
import textwrap
import threading
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from versolane.operators import analyze, batches, detection, jobs, profiles, translate
from versolane.plans import service
from versolane.sources import books, epub, shelf
from versolane.streaming import machine, progress, uploads

REPO = str(Path(__file__).resolve().parents[1])
HOUR = 3600


def events(spark, rows):
    """Rows of (event_id, job_id, seconds, kind)."""
    return spark.createDataFrame(rows, "event_id long, job_id long, s long, kind string").select("event_id", "job_id", F.timestamp_seconds("s").alias("ts"), "kind")


def moves(df):
    return sorted((r["job_id"], r["at_ms"] // 1000, r["event_id"] if r["event_id"] is not None else -1, r["from_state"], r["to_state"], r["verdict"]) for r in df.collect())


def test_job_machine(spark):
    rows = [(0, 1, 0, "progress"), (1, 1, 10, "started"), (2, 1, 5, "completed"), (3, 1, 20, "progress"), (4, 1, 30, "completed"), (5, 1, 40, "started"), (6, 1, 30 * HOUR, "started"), (7, 1, 30 * HOUR, "error"), (8, 2, 0, None)]
    got = moves(machine.folded(events(spark, rows)))
    assert got == sorted([
        (1, 0, 0, "pending", "pending", "illegal"), (1, 10, 1, "pending", "processing", "moved"), (1, 5, 2, "processing", "processing", "late"), (1, 20, 3, "processing", "processing", "moved"),
        (1, 30, 4, "processing", "completed", "moved"), (1, 40, 5, "completed", "completed", "illegal"), (1, 40 + 6 * HOUR, -1, "completed", None, "evicted"),
        (1, 30 * HOUR, 6, "pending", "processing", "moved"), (1, 30 * HOUR, 7, "processing", "error", "moved"), (2, 0, 8, "pending", "pending", "illegal"),
    ], key=lambda r: r)


def test_job_machine_over_micro_batches_and_a_restart(spark, tmp_path):
    draw = random.Random(5)
    rows = [(i, draw.randrange(6), i * 1800 + draw.randrange(-900, 900) + 10_000, draw.choice(["started", "progress", "completed", "error"])) for i in range(240)]
    table = events(spark, rows)
    folder, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))

    def run():
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        start = lambda: machine.transitions(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", offsets).trigger(availableNow=True).start()
        machine.with_timers(spark, start).awaitTermination()

    for part in range(4):  # a new query from the same checkpoint each time
        table.where(F.floor(F.col("event_id") / 60) == part).coalesce(1).write.mode("append").parquet(folder)
        run()
    mark = max(r[2] for r in rows) * 1000 - HOUR * 1000
    assert moves(spark.read.schema(machine.ROWS).parquet(out)) == moves(machine.folded(table, mark))
    held = lambda: spark.read.format("statestore").option("stateVarName", "job").load(offsets).count()
    assert 0 < held() <= 6
    # long after, one event moves the watermark: all others are forgotten, and a second one forgets this one's job too
    for number, s in ((240, 10_000_000), (241, 20_000_000)):
        events(spark, [(number, number, s, "started")]).coalesce(1).write.mode("append").parquet(folder)
        run()
    assert held() == 1
    last = events(spark, rows + [(240, 240, 10_000_000, "started"), (241, 241, 20_000_000, "started")])
    assert moves(spark.read.schema(machine.ROWS).parquet(out)) == moves(machine.folded(last, 20_000_000_000 - HOUR * 1000))


def units(spark, rows):
    return spark.createDataFrame(rows, "seq_key string, pos int, text string")


def told(df, *columns):
    return sorted((tuple(r[c] for c in ("seq_key", "pos", *columns)) for r in df.collect()), key=str)


def random_units(spark, seed, scopes=23):
    draw = random.Random(seed)
    return units(spark, [(draw.choice([None, *"abcdefgh"]) if k == 0 else f"s{k}", i, draw.choice(["one", "12", "", None, "bad", "two three", " ", "…"])) for k in range(scopes) for i in range(draw.randrange(1, 12))])


@pytest.mark.parametrize("width", [1, 3, 64])
@pytest.mark.parametrize("advance", [False, True])
def test_batches_give_the_rows_of_single_requests(spark, width, advance):
    def backend(text, context):
        if text == "bad":
            raise RuntimeError("no")
        return None if text == "…" else f" {text}<{context[-9:]}> "

    rows = random_units(spark, width)
    rows = rows.where("seq_key IS NOT NULL")
    one = translate.run_units(rows, backend, wait=lambda s: None, advance_on_failure=advance)
    many = batches.run_batches(rows, batches.singly(backend), width=width, wait=lambda s: None, advance_on_failure=advance)
    assert told(many, "translated", "attempts", "error") == told(one, "translated", "attempts", "error")


def test_null_scope_is_a_scope(spark):
    rows = units(spark, [(None, 0, "a"), (None, 1, "b"), ("x", 0, "c")])
    got = told(batches.run_batches(rows, lambda requests: [f"{t}<{c}>" for t, c in requests]), "translated")
    assert got == sorted([(None, 0, "a<>"), (None, 1, "b<a<>>"), ("x", 0, "c<>")], key=str)


def test_a_call_carries_a_wave(spark, tmp_path):
    log = tmp_path / "calls"

    def backend(requests):
        with log.open("a") as f:
            f.write(f"{len(requests)}\n")
        return [t for t, _ in requests]

    rows = units(spark, [(f"s{k}", i, "text") for k in range(40) for i in range(5)])
    assert batches.run_batches(rows, backend, width=64).count() == 200
    calls = [int(x) for x in log.read_text().split()]
    assert calls == [40] * 5  # one lane, five waves
    log.unlink()
    assert batches.run_batches(rows, backend, width=8).count() == 200
    calls = [int(x) for x in log.read_text().split()]
    assert max(calls) <= 8 and sum(calls) == 200 and len(calls) <= 50


def test_failed_requests_of_a_call_are_sent_again_alone():
    seen, kept, waits = [], [], []

    def backend(requests):
        seen.append([t for t, _ in requests])
        if len(seen) == 1:
            return ["A", ValueError("busy"), None]
        if len(seen) == 2:
            raise OSError("gone")
        return ["B"]

    got = batches.ask(backend, [("a", ""), ("b", ""), ("c", "")], 3, waits.append, kept.append)
    assert got == [("A", 1, None), ("B", 3, None), (None, 1, None)]
    assert seen == [["a", "b", "c"], ["b"], ["b"]] and waits == [1.0, 2.0] and kept == [{0: "A", 2: None}, {}, {1: "B"}]
    assert batches.ask(lambda r: [], [("a", "")], 2, waits.append, kept.append) == [(None, 2, "0 answers to 1 requests")]


def counted(tmp_path):
    log = tmp_path / "calls"

    def backend(text, context):
        with log.open("a") as f:
            f.write(text + "\n")
        if text == "bad":
            raise RuntimeError("no")
        return f"{text}<{context}>"

    return backend, lambda: log.read_text().split() if log.exists() else []


def test_kept_answers_follow_the_units(spark, tmp_path):
    backend, calls = counted(tmp_path)
    store = str(tmp_path / "store")
    keep = lambda rows, **how: told(translate.stored(units(spark, rows), store, backend, wait=lambda s: None, **how), "translated", "reused")
    rows = [("a", 0, "one"), ("a", 1, "two"), ("a", 2, "three"), ("b", 0, "four"), ("c", 0, "7")]
    assert keep(rows) == [("a", 0, "one<>", False), ("a", 1, "two<one<>>", False), ("a", 2, "three<two<one<>>>", False), ("b", 0, "four<>", False), ("c", 0, "7", False)]
    assert sorted(calls()) == ["four", "one", "three", "two"]
    assert [r[3] for r in keep(rows)] == [True] * 4 + [False] and len(calls()) == 4  # nothing new, nothing asked
    # a unit and a scope go: neither is given back, and what stood behind the unit has a new context
    assert keep([("a", 0, "one"), ("a", 2, "three")]) == [("a", 0, "one<>", True), ("a", 2, "three<one<>>", False)]
    assert calls()[4:] == ["three"]
    # another language asks anew, and its answers don't stand for the first one's
    assert keep([("a", 0, "one")], settings="fr") == [("a", 0, "one<>", False)] and calls()[5:] == ["one"]
    assert keep([("a", 0, "one"), ("a", 1, "bad")], settings="fr")[0] == ("a", 0, "one<>", True)
    assert calls()[6:] == ["bad"] * 3


def test_a_failed_run_leaves_its_answers(spark, tmp_path):
    backend, calls = counted(tmp_path)
    store = str(tmp_path / "store")
    rows = units(spark, [(f"s{k}", i, f"t{k}-{i}") for k in range(6) for i in range(4)])

    def breaks(text, context):
        if text == "t3-2":
            raise SystemExit("the worker goes")
        return backend(text, context)

    with pytest.raises(Exception, match="the worker goes|crashed|exited"):
        translate.stored(rows, store, breaks, width=2)
    assert shelf.latest(spark, store) == (0, None) and 0 < len(calls()) < 24
    done = translate.stored(rows, store, backend, width=3)  # other lanes than before
    assert done.count() == 24 and sorted(set(calls())) == sorted(f"t{k}-{i}" for k in range(6) for i in range(4))
    assert len(calls()) <= 24 + 2  # what a call had answered when the worker went, one batch of two at most


def test_a_task_that_runs_again_asks_one_batch_again(tmp_path):
    """A worker dies in the middle of a task and Spark runs the task again: in a session of its own, as sessions of tests don't repeat tasks."""
    script = textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        from versolane.operators import batches
        spark = SparkSession.builder.master("local[2,4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
        log, once = {str(tmp_path / "calls")!r}, {str(tmp_path / "once")!r}
        def backend(requests):
            with open(log, "a") as f:
                f.writelines(t + chr(10) for t, _ in requests)
            if any(t == "t5-4" for t, _ in requests) and not os.path.exists(once):
                open(once, "w").close()
                os._exit(1)
            return [t.upper() for t, _ in requests]
        rows = spark.createDataFrame([(f"s{{k}}", i, f"t{{k}}-{{i}}") for k in range(12) for i in range(6)], "seq_key string, pos int, text string")
        got = batches.run_batches(rows, backend, width=4, journal={str(tmp_path / "journal")!r}).collect()
        assert len(got) == 72 and all(r["translated"] == r["text"].upper() for r in got)
        spark.stop()
    """)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, env={**__import__("os").environ, "PYTHONPATH": REPO})
    assert done.returncode == 0, done.stderr[-3000:]
    calls = (tmp_path / "calls").read_text().split()
    assert (tmp_path / "once").exists() and len(set(calls)) == 72 and len(calls) <= 72 + 4


def test_detection_in_flight(spark):
    lock, now, most = threading.Lock(), [0], [0]

    def backend(provider, model, prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep({"slow": 30, "late": 0.2}.get(prompt, 0.01))
        with lock:
            now[0] -= 1
        if prompt == "bad":
            raise ValueError("y" * 100)
        return f"'{prompt}'.\n"

    flight, order, sent = detection.Flight(backend, 3, 1.0), [], 0
    prompts = ["late", "a", "slow", "b", "bad", "c", "d"]
    for prompt in prompts:
        while len(flight.open) >= 3:
            order += flight.landed()
        flight.send(sent, ("p", "m", prompt))
        sent += 1
    while flight.open:
        order += flight.landed()
    outcome = {prompts[n]: (a, o) for n, a, o in order}
    assert most[0] <= 4 and len(order) == 7  # three that count, and the one given up
    assert [prompts[n] for n, _, _ in order].index("a") < [prompts[n] for n, _, _ in order].index("late")
    assert outcome["slow"] == (None, "timed out") and outcome["bad"][1] == ("failed: " + "y" * 100)[:60] and outcome["late"] == ("'late'.\n", "answered")
    rows = spark.createDataFrame([(i, "p", "m", x) for i, x in enumerate(["a", "bad", "Unknown"])], "job_id int, provider string, model string, prompt string")
    all_jobs = spark.createDataFrame([(i,) for i in range(4)], "job_id int")

    def quick(provider, model, prompt):
        if prompt == "bad":
            raise ValueError("no")
        return f"'{prompt}'.\n"

    got = {r["job_id"]: (r["language"], r["outcome"]) for r in detection.detected(all_jobs, rows, quick, width=2).collect()}
    assert got == {0: ("a", "answered"), 1: ("Unknown", "failed: no"), 2: ("Unknown", "not recognised"), 3: ("Unknown", "not asked")}


def test_detection_gives_up_on_a_backend_that_never_comes_back():
    flight = detection.Flight(lambda *r: time.sleep(60), 2, 0.01, lost=3)
    with pytest.raises(RuntimeError, match="never came back"):
        for i in range(20):
            while len(flight.open) >= 2:
                list(flight.landed())
            flight.send(i, ("", "", ""))


def profile_brute(text, size=300):
    x = "".join(c.lower() if c.isascii() else c for c in text)
    x = " " + "".join(c if c.isalpha() else " " for c in x) + " "
    while "  " in x:
        x = x.replace("  ", " ")
    n = {}
    for k in (1, 2, 3):
        for i in range(len(x) - k + 1):
            g = x[i : i + k]
            if g.strip() and (k < 3 or g[1] != " "):
                n[g] = n.get(g, 0) + 1
    return sorted(n, key=lambda g: (-n[g], g))[:size]


@pytest.mark.parametrize("text", ["The cat", "", "  ", "a", "Ünder é 日本語 x1y", "aa aa!aa", "I'm 12"])
def test_profiles_as_brute_force(text):
    got = ["".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0)).rstrip("\0") for g in profiles.profile(text, 300).tolist()]
    assert got == profile_brute(text)


def test_languages_of_documents_not_learnt_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = profiles.nearest(docs.where("doc_id % 3 = 1"), profiles.learn(docs.where("doc_id % 3 <> 1")))
    right = got.join(docs.where("lang IS NOT NULL AND text RLIKE '[a-z]'"), "doc_id").agg(F.avg((F.col("language") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right[0] >= 0.95 and right[1] > 250
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (None, "the")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["language"], r["distance"] is None) for r in profiles.nearest(odd, profiles.learn(docs)).collect())[1:] == [(1, "Unknown", True), (2, "Unknown", True), (3, "Unknown", True)]
    assert {r["language"] for r in profiles.nearest(odd, profiles.learn(docs.limit(0))).collect()} == {"Unknown"}


@pytest.mark.parametrize("cap", [1, 7, 50, 10_000])
def test_heads_are_those_of_the_whole_book(spark, cap):
    draw = random.Random(cap)
    rows = [(book, i * 3, draw.choice(["", None, "é" * draw.randrange(9), "ab\n" * draw.randrange(5)])) for book in ("a", "b", None) for i in range(60)] + [("c", 0, "")]
    whole = {}
    for book, _, piece in rows:
        whole[book] = whole.get(book, "") + (piece or "")
    pieces = spark.createDataFrame(draw.sample(rows, len(rows)), "book_id string, idx int, piece string")
    got = {r["book_id"]: (r["head"], r["length"]) for r in analyze.heads(pieces, cap, part=4).collect()}
    assert got == {b: (t[:cap], len(t)) for b, t in whole.items() if t}


def test_uploads_after_any_split(spark, tmp_path):
    chapters = [(f"c{i}.xhtml", f"<h1>Chapter {i}</h1><p>{'word ' * (i + 3)}</p>") for i in range(10)]
    volumes = {"x.vol-0.epub": chapters[:4], "x.vol-1.epub": chapters[4:5], "x.vol-2.epub": chapters[5:], "y.epub": chapters[:2]}
    batch = analyze.books(spark.createDataFrame([("x", i, n, h) for i, (n, h) in enumerate(chapters)] + [("y", i, n, h) for i, (n, h) in enumerate(chapters[:2])], "book_id string, doc_idx int, name string, html string"))
    want = sorted(batch.collect())
    for split in (1, 2, 9):
        inbox, store, offsets = (str(tmp_path / f"{x}{split}") for x in ("in", "store", "offsets"))
        Path(inbox).mkdir()
        names = list(volumes)
        random.Random(split).shuffle(names)
        for i in range(0, len(names), split):
            for name in names[i : i + split]:
                (Path(inbox) / name).write_bytes(epub.archive([n for n, _ in volumes[name]], [h for _, h in volumes[name]]))
            uploads.arrive(spark, inbox, store, offsets, files_per_batch=1 if split == 9 else 100)
        # the same content again under another name, and what is no book
        (Path(inbox) / "x.vol-1.again.epub").write_bytes((Path(inbox) / "x.vol-1.epub").read_bytes())
        (Path(inbox) / "z.epub").write_bytes(b"no archive")
        uploads.arrive(spark, inbox, store, offsets)
        assert sorted(uploads.analysed(spark, store).collect()) == want
        assert [(r["book_id"], r["error"][:10]) for r in uploads.stored(spark, store).where("error IS NOT NULL").collect()] == [("z", "BadZipFile")]


def chapters_of(spark, rows):
    return spark.createDataFrame([(b, i, f"n{i}", h, "Italian") for b, i, h in rows], "book_id string, doc_idx int, name string, html string, target_lang string")


def test_books_are_published_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "shelf")
    shown = lambda: sorted((r["book_id"], r["doc_idx"], r["html"]) for r in books.published(spark, out).collect())
    assert shown() == []
    first = [("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3")]
    assert books.publish(chapters_of(spark, first), out) == 1 and shown() == first
    assert books.publish(chapters_of(spark, first), out) == 1 and shown() == first  # nothing changed, nothing done
    second = [("a", 0, "new"), ("c", 0, "4")]

    def fails(*args):
        raise OSError("the driver goes")

    with monkeypatch.context() as m:
        m.setattr(shelf, "commit", fails)
        with pytest.raises(OSError, match="the driver goes"):
            books.publish(chapters_of(spark, second), out)
    assert shown() == first  # staged, not committed: readers see what was there
    assert books.publish(chapters_of(spark, second), out) == 2
    assert shown() == [("a", 0, "new"), ("b", 0, "3"), ("c", 0, "4")]
    assert {r["book_id"]: r["n_chapters"] for r in books.manifest(spark, out).collect()} == {"a": 1, "b": 1, "c": 1}
    # what is staged and not committed can't be downloaded
    state = spark.createDataFrame([("a", "completed"), ("b", "processing"), ("staged", "completed")], "job_id string, status string")
    shelf.stage(chapters_of(spark, [("staged", 0, "5")]), f"{out}/data", ("book_id",))
    asked = spark.createDataFrame([("a",), ("b",), ("staged",), ("unknown",)], "job_id string")
    assert {r["job_id"]: r["code"] for r in jobs.lookup(asked, state, books.outputs(spark, out)).collect()} == {"a": 200, "b": 400, "staged": 404, "unknown": 404}


def test_one_of_two_writers_commits_a_version(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "shelf")
    folders = [shelf.stage(spark.range(n), out) for n in (1, 2)]
    shelf.commit(spark, out, folders[0], 1)
    with pytest.raises(shelf.Taken):
        shelf.commit(spark, out, folders[1], 1)
    assert shelf.latest(spark, out) == (1, folders[0])
    monkeypatch.setattr(shelf, "versions", lambda *a: [])  # both looked before either committed
    with pytest.raises(shelf.Taken):
        shelf.commit(spark, out, folders[1], 1)
    monkeypatch.undo()
    assert shelf.latest(spark, out) == (1, folders[0])
    shelf.commit(spark, out, folders[1], 2)
    assert shelf.latest(spark, out) == (2, folders[1])


def test_progress_stream_makes_its_answers_once(spark, monkeypatch):
    made, answers = spark.sparkContext.accumulator(0), service._answers

    def counted(s, d):
        rows = answers(s, d)

        def run(batches):
            for batch in batches:
                made.add(len(batch))
                yield batch

        return rows.mapInPandas(run, rows.schema)

    monkeypatch.setattr(service, "_answers", counted)
    rows = service.progress_stream(spark, "/root/testdata/sf0.001").where("doc_idx IS NOT NULL").count()
    assert made.value == rows > 0


def test_bars_close_within_a_batch(spark):
    class Kept:
        def __init__(self, now):
            self.now = now

        exists = lambda self: self.now is not None
        get = lambda self: self.now

        def update(self, now):
            self.now = now

    bars = progress.Bars()
    bars.bar = Kept((1, 0.5))
    batch = pd.DataFrame({"book_id": "b", "doc_idx": [1, 0, 2], "block_no": [0, None, 1], "step": "block", "progress": [0.4, 0.7, 0.6], "message": "m", "units": 3})
    out = pd.concat(bars.handleInputRows(("b",), iter([batch.iloc[:0], batch]), None))
    assert list(zip(out["step"], out["shown"])) == [("block", 0.5), ("block", 0.7), ("saving", 0.99), ("done", 1.0), ("block", 1.0)]
    assert out["block_no"].isna().tolist() == [False, True, True, True, False] and bars.bar.now == (4, 1.0)


def test_uploads_are_opened_once(spark, tmp_path, monkeypatch):
    opened, chapters = spark.sparkContext.accumulator(0), epub.chapters

    def counted(files):
        def run(batches):
            for batch in batches:
                opened.add(len(batch))
                yield batch

        return chapters(files.mapInPandas(run, files.schema))

    monkeypatch.setattr(epub, "chapters", counted)
    for name, content in {"a.vol-1.epub": "<p>one of them, again</p>", "a.vol-1.x.epub": "<p>one of them, again</p>", "b.epub": "<p>another one of them</p>"}.items():
        (tmp_path / name).write_bytes(epub.archive(["c.xhtml"], [content]))
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {(r["book_id"], r["volume"]): (r["num_chapters"], r["error"]) for r in uploads.partials(files).collect()}
    assert got == {("a", 1): (1, None), ("b", 0): (1, None), ("broken", 0): (0, "BadZipFile: File is not a zip file")} and opened.value == 3


def test_machine_takes_all_files_of_the_table(spark, tmp_path):
    held = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    held.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "events.parquet"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(service.job_machine_stream(spark, str(tmp_path))) == key(service.job_machine(spark, str(tmp_path)))


def test_ids_stay_whole_beside_an_eviction():
    rows = [(1, 2**53 + 1, 0, "started", "pending", "processing", "moved"), (1, None, 5, None, "processing", None, "evicted")]
    assert [tuple(x) for x in machine._frame(rows).to_numpy()] == rows and list(machine._frame([]).columns) == machine.NAMES
