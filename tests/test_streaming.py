import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tipwatch.schemas import JOB_EVENT
from tipwatch.sources import paged
from tipwatch.sources.paged import PageRangesReader, PageReader
from tipwatch.streaming import intake, monitor
from tipwatch.streaming.monitor import Limits, News, RunState, advance
from tipwatch.streaming.runs import batches, drain, start_append

LIMITS = Limits(hang_ms=5_000, timeout_ms=60_000)


def replay(*steps, limits=LIMITS, start=0):
    """Statuses along (time, news) steps of a clock that moves only here."""
    state = RunState("running", start, start)
    out = []
    for now, news in steps:
        state, message = advance(state, news, now, limits)
        out.append((state.status, message))
    return out


def test_clean_stop():
    assert replay((1000, News(3)), (2000, News(stopped=True)), (9000, News())) == [("running", None), ("stopped", ""), ("stopped", None)]


def test_crash_is_reported_once():
    steps = replay((1000, News(2, crash="Oops: 1")), (2000, News(2, crash="BUG: 2")))
    assert steps == [("crash", "kernel crash detected in VM: Oops: 1"), ("crash", None)]


def test_hang_counts_from_the_last_arrival():
    assert [s for s, _ in replay((4000, News(1)), (9000, News()), (9001, News()))] == ["running", "running", "hang"]


def test_timeout_comes_first():
    limits = Limits(hang_ms=5_000, timeout_ms=3_000)
    assert replay((3000, News(1)), (3001, News(1, True, "Oops: 1")), limits=limits) == [("running", None), ("timeout", "task wait timeout exceeded after 3s")]


def test_stop_before_crash_before_hang():
    assert replay((9000, News(1, True, "Oops: 1")))[0][0] == "stopped"
    assert replay((9000, News(1, False, "Oops: 1")))[0][0] == "crash"
    assert replay((9000, News(0)))[0][0] == "hang"


def test_deadline():
    state = RunState("running", 0, 57_000)
    assert state.deadline(LIMITS) == 60_001
    assert advance(state, News(), 60_000, LIMITS)[0].status == "running"
    assert advance(state, News(), 60_001, LIMITS)[0].status == "timeout"


SCHEMA = "run string, ts timestamp, seq long, message string, stopped boolean"


def write_console(spark, path, rows):
    rows = [(run, float(at), *rest) for run, at, *rest in rows]
    df = spark.createDataFrame(rows, "run string, at double, seq long, message string, stopped boolean")
    df.selectExpr("run", "timestamp_millis(cast(at * 1000 as bigint)) as ts", "seq", "message", "stopped").coalesce(1).write.mode("append").parquet(path)


ROWS = [("crash", 3, 2, "BUG: later", False), ("crash", 2, 1, "Oops: first", False), ("stop", 1, 3, "x", True), ("alive", 100, 4, "x", False), ("old", 1, 5, "x", False)]
ROWS += [("long", 1, 6, "x", False), ("long", 99, 7, "Oops: too late", False)]
EXPECTED = {
    "crash": ("crash", "kernel crash detected in VM: Oops: first"), "stop": ("stopped", ""), "alive": ("running", ""),
    "old": ("hang", "no VM console output for 30s"), "hot": ("hang", "no VM console output for 30s"), "long": ("hang", "no VM console output for 30s"),
}
REPLAY = Limits(30_000, 97_000)
HOT = [("hot", 50 + i / 100, 100 + i, "Call Trace:", False) for i in range(1500)]


def test_replay_of_one_file(spark, tmp_path):
    path = str(tmp_path / "in")
    write_console(spark, path, ROWS + HOT)
    alerts = monitor.replay(spark, spark.readStream.schema(SCHEMA).parquet(path), REPLAY)
    assert {r.run: (r.status, r.message) for r in monitor.final_states(alerts).collect()} == EXPECTED


@pytest.mark.parametrize("turn", [1, -1])
def test_many_files_in_any_order_say_the_same(spark, tmp_path, turn):
    """One file a batch, the newest lines first or last: a crash in an old file that comes late still counts."""
    path, rows = str(tmp_path / "in"), ROWS + [(f"r{i}", i, 1000 + i, "Oops: here" if i % 3 == 0 else "x", False) for i in range(12)]
    for row in sorted(rows, key=lambda r: turn * r[1]):
        write_console(spark, path, [row])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    many = {r.run: (r.status, r.message) for r in monitor.replay(spark, stream, REPLAY).collect()}
    one = monitor.judged(monitor.facts(spark.read.schema(SCHEMA).parquet(path), REPLAY), REPLAY)
    assert many == {r.run: (r.status, r.message) for r in one.collect()}
    assert many["crash"] == EXPECTED["crash"] and many["long"] == EXPECTED["long"]
    assert sum(s == "crash" for s, _ in many.values()) == 5


def polled(rows, limits):
    """Status and end of each run by polling every half millisecond, as a watcher that never pauses would."""
    rows, limits = [(r[0], 2 * r[1], *r[2:]) for r in rows], Limits(2 * limits.hang_ms, 2 * limits.timeout_ms)
    end, out = max(r[1] for r in rows), {}
    for run in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == run]
        first = min(r[1] for r in mine)
        state = RunState("running", first, first)
        for now in range(first, end + 1):
            news = [r for r in mine if r[1] == now]
            crash = next((m for _, _, _, m, stop in sorted(news, key=lambda r: r[2]) if m.startswith("Oops")), None)
            state, message = advance(state, News(sum(not r[4] for r in news), any(r[4] for r in news), crash), now, limits)
            if state.ended:
                out[run] = (state.status, message, now // 2)
                break
        else:
            out[run] = ("running", "", end // 2)
    return out


def replayed(spark, rows, limits):
    """The same from the facts of single events, of which slots are made by merging."""
    df = spark.createDataFrame(rows, "run string, at long, seq long, message string, stopped boolean")
    events = df.selectExpr("run", "timestamp_millis(at) as ts", "seq", "message", "stopped")
    halves = [monitor.facts(events.filter(f"seq % 2 = {i}"), limits) for i in (0, 1)]
    found = monitor.judged(monitor.merged(halves[0].unionByName(halves[1])), limits).collect()
    return {r.run: (r.status, r.message, r.at_ms) for r in found}


MINUTE = 60_000
PROBES = {  # default limits: 20 minutes of silence, 60 of age
    "inner silence": ("hang", [(0, "x", False), (30, "x", False), (35, "x", False), (61, "x", False)]),
    "crash, then a stop": ("crash", [(0, "x", False), (5, "Oops: 1", False), (10, "", True)]),
    "crash, then a long end": ("crash", [(0, "x", False), (4, "Oops: 1", False), (20, "x", False), (39, "x", False), (58, "x", False), (61, "x", False)]),
    "stop after a silence": ("hang", [(0, "x", False), (25, "", True)]),
    "stop, then a crash": ("stopped", [(0, "x", False), (5, "", True), (10, "Oops: 1", False)]),
    "lines up to the limit": ("timeout", [(m, "x", False) for m in range(0, 62, 10)]),
    "a crash beyond the limit": ("timeout", [(m, "x", False) for m in range(0, 61, 10)] + [(60.01, "Oops: 1", False)]),
    "both at one moment": ("stopped", [(0, "x", False), (5, "Oops: 1", False), (5, "", True)]),
    "a silence just long enough": ("running", [(m, "x", False) for m in (22, 42, 61)]),
}


def test_the_first_ending_counts(spark):
    rows = [(run, int(m * MINUTE), i, text, stop) for run, (_, lines) in PROBES.items() for i, (m, text, stop) in enumerate(lines)]
    rows.append(("another", 62 * MINUTE, 0, "x", False))
    assert {run: s for run, (s, _, _) in replayed(spark, rows, Limits()).items()} == {**{r: s for r, (s, _) in PROBES.items()}, "another": "running"}


def test_the_replay_is_a_poll_without_pauses(spark):
    draw = random.Random(8)
    for turn in range(6):
        limits = Limits(draw.choice([3, 10, 40]), draw.choice([20, 60, 200]))
        rows = []
        for run in range(60):
            at, n = draw.randrange(50), draw.randrange(1, 12)
            for _ in range(n):
                at += draw.choice([0, 1, 2, 3, 4, limits.hang_ms - 1, limits.hang_ms, limits.hang_ms + 1, limits.hang_ms + 2])
                rows.append((f"r{run}", at, len(rows), draw.choice(["x", "x", "x", "x", "Oops: 1"]), draw.random() < 0.06))
        want, got = polled(rows, limits), replayed(spark, rows, limits)
        assert {r: (s, at) for r, (s, _, at) in got.items()} == {r: (s, at) for r, (s, _, at) in want.items()}, turn
        assert all(got[r][1] == want[r][1] for r in want if want[r][0] == "crash")


def test_a_folder_of_files_reads_as_one_file(spark, tmp_path):
    from tipwatch.plans import streams

    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("tail_new_events", "run_state", "stream_first_crash"):
        one = sorted(map(tuple, getattr(streams, name)(spark, "/root/testdata/sf0.001").collect()))
        assert one and one == sorted(map(tuple, getattr(streams, name)(spark, str(tmp_path)).collect()))


def test_silence_on_processing_time(spark, tmp_path):
    """Nothing arrives after the first batch; the timer alone raises the alert."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_console(spark, path, [("quiet", 1, 1, "booting", False), ("crashed", 1, 2, "Oops: 1", False)])
    stream = monitor.run_monitor(spark.readStream.schema(SCHEMA).parquet(path), Limits(4_000, 10**9))
    query = start_append(stream, out, str(tmp_path / "checkpoint"), processingTime="1 second")
    try:
        deadline = time.time() + 90
        found = {}
        while time.time() < deadline and found.get("quiet") != "hang":
            time.sleep(2)
            if query.lastProgress:
                found = {r.run: r.status for r in monitor.final_states(spark.read.schema(monitor.ALERTS).parquet(out)).collect()}
    finally:
        query.stop()
    assert found == {"quiet": "hang", "crashed": "crash"}


def job(node, ts, **data):
    return json.dumps({"timestamp": ts, "node": {"id": node, "kind": "job", "state": "available", "data": {"runtime": "lab", **data}, "artifacts": {"job_definition": "https://j/" + node}}})


def taken(spark, source, tmp_path, files=1000, **more):
    stream = intake.read_job_events(spark, str(source), files)
    out = str(tmp_path / "out")
    intake.job_intake(stream, out, str(tmp_path / "checkpoint"), "lab", availableNow=True, **more).awaitTermination()
    return sorted(r.node_id for r in batches(spark, f"{out}/taken", intake.TAKEN).collect())


def test_intake_claims_once_across_restarts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join([job("n1", "2024-01-01T00:00:00"), job("n1", "2024-01-01T00:00:05"), job("n2", "2024-01-01T00:00:01", job_id="lab:x")]))
    assert taken(spark, source, tmp_path) == ["n1"]
    (source / "b.json").write_text("\n".join([job("n1", "2024-01-02T00:00:00"), job("n3", "2024-01-02T00:00:00")]))
    assert taken(spark, source, tmp_path) == ["n1", "n3"]
    assert taken(spark, source, tmp_path) == ["n1", "n3"]


def test_late_jobs_come_out_and_bad_stamps_do_not_stop_the_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stamps = ["2024-03-01T00:00:00", "2024-03-02T00:00:00", "not a time", "2024-01-05T00:00:00", "2024-03-03T00:00:00"]
    for i, stamp in enumerate(stamps):
        (source / f"{i}.json").write_text(job(f"n{i}", stamp))
        time.sleep(0.01)
    nodes = spark.createDataFrame([("n1", "running", None), ("n4", "available", "lab:9"), ("n0", "available", "")], "node_id string, state string, job_id string")
    assert taken(spark, source, tmp_path, files=1, nodes=nodes) == ["n0", "n3"]
    bad = batches(spark, str(tmp_path / "out" / "rejected"), intake.REJECTED).collect()
    assert [(r.node_id, r.timestamp, r.error_code) for r in bad] == [("n2", "not a time", "invalid_timestamp")]


def test_stamps_of_any_kind_are_seen(spark, tmp_path):
    """Stamps that sort before all dates are set aside, and an event without one claims its node."""
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join([job("n1", "12/31/2024"), job("n2", None), job("n3", ""), job("n4", "2024-01-01T00:00:00"), job("n4", "0")]))
    assert taken(spark, source, tmp_path) == ["n2", "n4"]
    bad = batches(spark, str(tmp_path / "out" / "rejected"), intake.REJECTED).collect()
    assert sorted((r.node_id, r.timestamp) for r in bad) == [("n1", "12/31/2024"), ("n3", ""), ("n4", "0")]


def test_claims_are_looked_up_by_node(spark, tmp_path):
    """Fifty batches, of which the state alone remembers the claims: what they wrote is gone when the last ones run."""
    source = tmp_path / "in"
    source.mkdir()
    for i in range(50):
        (source / f"{i:03}.json").write_text("\n".join(job(f"n{n}", f"2024-01-01T00:00:{i:02}") for n in (i // 2, i % 7, 100 + i)))
        time.sleep(0.002)
    first = taken(spark, source, tmp_path, files=1)
    assert first == sorted([f"n{n}" for n in range(25)] + [f"n{100 + i}" for i in range(50)])
    (tmp_path / "out").rename(tmp_path / "elsewhere")
    for i in range(3):
        (source / f"x{i}.json").write_text("\n".join([job(f"n{i}", "2024-01-02T00:00:00"), job(f"n{200 + i}", "2024-01-02T00:00:00")] * 3))
    assert taken(spark, source, tmp_path) == ["n200", "n201", "n202"]
    state = [f for f in (tmp_path / "checkpoint" / "state").rglob("*") if f.is_file()]
    assert state


def pages(folder, rows):
    folder.mkdir(exist_ok=True)
    for name, text in rows.items():
        (folder / name).write_text(text)


def test_pages_are_read_by_place_and_not_by_stamp(tmp_path):
    stamps = ["2024-03-01", "2024-01-01", None, "2024-02-01", "2024-02-01", "2023-01-01", "x"]
    lines = [json.dumps({"timestamp": s, "n": i}) for i, s in enumerate(stamps)]
    pages(tmp_path / "p", {"0": "\n".join(lines[:3]) + "\n", "1": lines[3] + "\n\nno event\n" + lines[4], "2": "\n".join(lines[5:]) + "\n" + '{"half', "_made": "x\n", ".x": "y\n"})
    for limit in (1, 2, 3, 100):
        reader, at, got, cursors = PageReader(str(tmp_path / "p"), limit), None, [], []
        at = reader.initialOffset()
        while True:
            rows, end = reader.read(at)
            rows = list(rows)
            assert len(rows) <= limit and list(reader.readBetweenOffsets(at, end)) == rows
            if end == at:
                break
            got, at = got + rows, json.loads(json.dumps(end))
            cursors.append(end["stamp"])
        assert [r[0] for r in got] == [*lines[:4], "no event", *lines[4:]]
        assert cursors[-1] == "x" and (limit > 1 or cursors == ["2024-03-01", "2024-01-01", "2024-01-01", "2024-02-01", "2024-02-01", "2024-02-01", "2023-01-01", "x"])
    pages(tmp_path / "p", {"2": "\n".join(lines[5:]) + "\n" + '{"half": 1}\n'})  # the last page grows
    rows, end = reader.read(at)
    assert [r[0] for r in rows] == ['{"half": 1}'] and end["stamp"] == "x"
    assert PageReader(str(tmp_path / "none"), 5).read(reader.initialOffset())[1] == reader.initialOffset()


def test_a_poll_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stamps go back and forth over pages and polls; three starts lose and repeat nothing."""
    draw, folder, n = random.Random(3), tmp_path / "p", 0
    for start in range(3):
        for _ in range(4):
            rows = [job(f"n{n + i}", f"2024-01-{draw.randrange(1, 28):02}T00:00:00") for i in range(draw.randrange(1, 40))]
            pages(folder, {f"{n:06}.json": "\n".join(rows) + "\n"})
            n += len(rows)
        query = start_append(intake.poll_job_events(spark, str(folder), 17).select("node.id"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), processingTime="0 seconds")
        query.processAllAvailable()
        assert all(p["numInputRows"] <= 17 for p in query.recentProgress)
        query.stop()
        found = [r.id for r in spark.read.schema("id string").parquet(str(tmp_path / "out")).collect()]
        assert sorted(found) == sorted(f"n{i}" for i in range(n)), start


def test_polls_side_by_side_read_the_same_lines(tmp_path, monkeypatch):
    """Ranges and batches cut anywhere, pages that end in the middle of a line, a last page that grows."""
    monkeypatch.setattr(paged, "BLOCK", 7)
    draw, folder = random.Random(5), tmp_path / "p"
    for turn in range(30):
        lines = [draw.choice(["", " ", "no event", "é" * draw.randrange(9), json.dumps({"timestamp": draw.choice([None, "a", "b", "c"])})]) for _ in range(draw.randrange(1, 30))]
        cuts = sorted(draw.randrange(len(lines) + 1) for _ in range(3))
        shown = ["\n".join(lines[a:b]) + draw.choice(["", "\n"]) for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True)]
        root = folder / str(turn)
        root.mkdir(parents=True)
        pages(root, {str(i): body for i, body in enumerate(shown)})
        alone = PageReader(str(root), 1000)
        for size, room, limit in ((1, 3, 2), (5, 1, 1), (40, 11, 3), (10**6, 10**6, 1000)):
            monkeypatch.setattr(paged, "RANGE", room)
            reader, got, at = PageRangesReader(str(root), limit, size), [], alone.initialOffset()
            while (end := json.loads(json.dumps(reader.latestOffset()))) != at:
                again = PageRangesReader(str(root), limit, size)  # as after a restart
                polls = [p for part in again.partitions(at, end) for p in again.read(part)]
                assert all(0 < p.num_rows <= limit for p in polls)
                found = [tuple(r.values()) for p in polls for r in p.to_pylist()]
                assert found == list(alone.readBetweenOffsets(at, end)) and again.at == end
                assert end["stamp"] == next((s for r in reversed(found) if (s := paged.stamp_of(r[0].encode()))), at["stamp"])
                got, at = got + found, end
            rows, last = alone.read(alone.initialOffset())
            assert got == list(rows) and at["stamp"] == last["stamp"]
        pages(root, {str(len(shown)): "more\n"})
        assert reader.latestOffset()["page"] == str(len(shown))
    assert PageRangesReader(str(tmp_path / "none"), 5, 5).latestOffset() == alone.initialOffset()


def test_a_batch_takes_many_polls(spark, tmp_path):
    """Three thousand events in polls of 17 take a few batches, over starts that lose and repeat nothing."""
    folder, n = tmp_path / "p", 0
    for start in range(3):
        rows = [job(f"n{n + i}", "2024-01-01T00:00:00") for i in range(1000)]
        pages(folder, {f"{n:06}.json": "\n".join(rows) + "\n"})
        n += len(rows)
        stream = intake.poll_job_events(spark, str(folder), 17, batch_bytes=60_000).select("node.id")
        query = start_append(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), processingTime="0 seconds")
        query.processAllAvailable()
        read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        query.stop()
        assert 2 <= len(read) <= 10 and sum(read) == 1000
        found = [r.id for r in spark.read.schema("id string").parquet(str(tmp_path / "out")).collect()]
        assert sorted(found) == sorted(f"n{i}" for i in range(n)), start


def test_new_events(spark, tmp_path):
    path = str(tmp_path / "in")
    write_console(spark, path, [("r", 1, 1, "a", False), ("r", 2, 2, "b", False)])
    stream = intake.new_events(spark.readStream.schema(SCHEMA).parquet(path), "1970-01-01 00:00:01")
    assert [r.seq for r in drain(spark, stream, "t").collect()] == [2]


def test_an_ended_run_stays_ended(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_console(spark, path, [("r", 1, 1, "Oops: 1", False)])
    stream = monitor.run_monitor(spark.readStream.schema(SCHEMA).parquet(path), LIMITS)
    query = start_append(stream, out, str(tmp_path / "checkpoint"), processingTime="1 second")

    def alerts():
        return [(r.status, r.message) for r in spark.read.schema(monitor.ALERTS).parquet(out).collect()]

    def rows_read():
        return sum(p["numInputRows"] for p in query.recentProgress)

    try:
        for turn, line in enumerate(["x", "BUG: 2"], 1):
            deadline = time.time() + 40
            while time.time() < deadline and rows_read() < turn:
                time.sleep(0.5)
            write_console(spark, path, [("r", 10**6, 9, line, False)])
        deadline = time.time() + 40
        while time.time() < deadline and rows_read() < 3:
            time.sleep(0.5)
    finally:
        query.stop()
    assert rows_read() == 3
    assert alerts() == [("crash", "kernel crash detected in VM: Oops: 1")]


def test_shared_folder(spark):
    from tipwatch import session

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: {"spark.sql.warehouse.dir": "hdfs:///warehouse/"}.get(key, default))})
        sparkContext = type("S", (), {"master": "yarn", "applicationId": "app-1"})

    assert session.shared_dir(Far) == "hdfs:///warehouse/_scratch/app-1"
    Far.conf = type("C", (), {"get": staticmethod(lambda key, default=None: "hdfs:///shared/")})
    assert session.shared_dir(Far) == "hdfs:///shared"


def test_scratch_tables_are_removed(spark):
    from tipwatch import session

    given, session._GIVEN[:] = list(session._GIVEN), []
    held = session.materialise(spark.range(3).toDF("id"))
    assert held.count() == 3 and len(session._GIVEN) == 1
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session._GIVEN[0])
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(place)
    session.clear_scratch(spark)
    assert not files.exists(place) and not session._GIVEN
    session._GIVEN[:] = given
