import random
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from runwarden.operators import enrich, profile
from runwarden.sources import readers
from runwarden.streaming import parent_links, pipelines, window_log

NOW = datetime(2026, 7, 21, 12, 0)


def files(spark, rows, schema, folder, parts):
    """One file per part, in order."""
    for part in range(parts):
        chosen = [r for i, r in enumerate(rows) if i * parts // len(rows) == part]
        spark.createDataFrame(chosen, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return stream.parquet(folder)


def test_parents_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    schema = (
        "event_id string, sensor_instance_id string, docker_host_id string, container_id string, "
        "process_pid bigint, process_ppid bigint, time_nano bigint, occurred_at timestamp"
    )
    rows = []
    for i in range(30):
        at = NOW + timedelta(seconds=i * 97)
        nanos = int((at - datetime(1970, 1, 1)).total_seconds()) * 1_000_000_000
        rows.append((f"e{i:02}", "s", "h", f"c{i % 2}", i % 4, (i + 2) % 5, nanos, at))
    where = str(tmp_path)
    mixed = rows + rows[:4]
    random.Random(6).shuffle(mixed)
    stream = files(spark, mixed, schema, f"{where}/in", 3)
    parent_links.parent_stream(stream, f"{where}/l", f"{where}/ck").awaitTermination()
    written = spark.read.parquet(f"{where}/l")
    want = enrich.correlate_parent(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, parent_links.latest_links(written).collect()), key=str) == sorted(map(tuple, want), key=str)
    assert any(r.parent_event_id for r in want) and written.count() > len(want)


def test_tools_after_shells_however_late(spark, tmp_path):
    schema = "container_id string, event_id string, occurred_at timestamp, shell boolean"
    rng, where = random.Random(4), str(tmp_path)
    rows = [("c0" if i % 3 else f"c{i % 4}", f"e{i:03}", NOW + timedelta(seconds=rng.randrange(200_000)), i % 2 == 0) for i in range(240)]
    rows += [("c0", "edge-shell", NOW.replace(hour=23, minute=59, second=30), True), (None, "no container", NOW, True)]
    rows += [("c0", "edge-tool", NOW.replace(day=22, hour=0, minute=1), False), ("c0", "no time", None, False)]
    rng.shuffle(rows)
    # Any order: rows come days behind the newest one.  Some come twice.
    stream = files(spark, rows + rows[:20], schema, f"{where}/in", 4)
    places = f"{where}/seen", f"{where}/pairs", f"{where}/ck"
    pipelines.shell_then_tool_stream(stream.where("shell"), stream.where("NOT shell"), *places, 600).awaitTermination()
    got = sorted(map(tuple, pipelines.shell_tool_pairs(spark, f"{where}/pairs").collect()))
    usable = [r for r in rows if r[0] and r[2]]
    shells, tools = [r for r in usable if r[3]], [r for r in usable if not r[3]]
    near = lambda s, t: s[0] == t[0] and timedelta(0) <= t[2] - s[2] <= timedelta(seconds=600)
    want = sorted((s[0], s[1], t[1]) for s in shells for t in tools if near(s, t))
    assert got == want and ("c0", "edge-shell", "edge-tool") in got


def test_alerts_are_committed_once(spark, tmp_path):
    rows = [(f"i{i % 5}", "open" if i % 7 else "closed", "high" if i % 2 else "low") for i in range(30)]
    where = str(tmp_path)
    stream = files(spark, rows, "incident_id string, status string, severity_level string", f"{where}/in", 3)
    for run in range(2):  # the second query has no memory of the first one
        pipelines.alert_stream(stream, f"{where}/told", "high", f"{where}/ck{run}").awaitTermination()
    told = [r.incident_id for r in pipelines.stored(spark, f"{where}/told", "incident_id").read().collect()]
    assert sorted(told) == sorted({r[0] for r in rows if r[1:] == ("open", "high")})


class _Handle:
    """State and timers of one key, as the processor sees them."""

    def __init__(self):
        self.rows, self.timers, self.watermark = [], [], 0
        self.get, self.put, self.clear = lambda: iter(self.rows), lambda r: setattr(self, "rows", r), lambda: setattr(self, "rows", [])
        self.exists = lambda: bool(self.rows)
        self.listTimers, self.deleteTimer, self.registerTimer = lambda: iter(list(self.timers)), self.timers.remove, self.timers.append
        self.getCurrentWatermarkInMs = lambda: self.watermark

    def getListState(self, name, schema):
        return self


def test_state_of_a_pid_is_bounded_by_the_look_back():
    handle, links = _Handle(), parent_links.ParentLinks(60)
    links.init(handle)
    row = lambda at, kind, name: Row(time_nano=at * 1_000_000_000, kind=kind, event_id=name)
    sizes, answers = [], {}
    for at in range(0, 6000, 10):
        handle.watermark = max(at - 30, 0) * 1000
        for out in links.handleInputRows(("s", 1), iter([row(at, 0, f"c{at}"), row(at + 1, 1, f"p{at}")]), handle):
            answers[out.event_id] = out.parent_event_id
        sizes.append(len(handle.rows))
    assert max(sizes) < 20 and answers == {f"p{at}": f"c{at}" for at in range(0, 6000, 10)} and len(handle.timers) == 1
    handle.watermark = 10_000_000
    list(links.handleExpiredTimer(("s", 1), handle, None))
    assert handle.rows == []


def test_identity_of_a_stream_ignores_arrival_order(spark, tmp_path):
    schema = (
        "docker_host_id string, container_id string, container_name string, image_id string, image_ref string, "
        "image_digest string, image_digest_status string, occurred_at timestamp, received_at timestamp"
    )
    rows = []
    for i in (5, 1, 9, 3, 7, 2, 8, 0):
        at = NOW + timedelta(minutes=i)
        name = f"n{i}" if i % 3 else None
        status = "inspection_failed" if i > 6 else "resolved"
        rows.append(("h", f"c{i % 2}", name, "i", f"r{i}" if i < 4 else None, f"d{i}", status, at, at))
    where = str(tmp_path)
    stream = files(spark, rows, schema, f"{where}/in", 4)
    pipelines.identity_stream(stream, f"{where}/s", f"{where}/ck").awaitTermination()
    got = enrich.identity_view(pipelines.identity_table(spark, f"{where}/s").read()).collect()
    want = enrich.container_identities(spark.createDataFrame(rows, schema)).collect()
    assert sorted(got) == sorted(want) and len(got) == 2


def test_lines_are_stored_once(spark, tmp_path):
    where = str(tmp_path)
    line = '{"rule": "R", "output_fields": {"evt.rawtime": 5000, "evt.num": %d, "proc.pid": 1}}'
    for name, numbers in (("a", (1, 2)), ("b", (2, 3))):
        text = [(line % n,) for n in numbers] + [("{bad",)] * 2
        spark.createDataFrame(text, "value string").coalesce(1).write.mode("append").text(f"{where}/in")
    for run in ("one", "two"):
        stream = readers.stream_sensor_lines(spark, f"{where}/in", files_per_batch=1)
        pipelines.normalise_stream(
            stream, "s", "R", None, f"{where}/events", f"{where}/letters", f"{where}/{run}"
        ).awaitTermination()
    events = pipelines.stored(spark, f"{where}/events", "event_id").read()
    assert sorted(r.event_number for r in events.collect()) == [1, 2, 3]
    letters = pipelines.stored(spark, f"{where}/letters", "letter_id").read().collect()
    assert len(letters) == 4 and len({r.letter_id for r in letters}) == 4


def executions(count, seed):
    """Executions of three containers over four hours with programs from a small list."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        at = NOW + timedelta(seconds=rng.randrange(4 * 3600))
        rows.append(("img", f"c{rng.randrange(3)}", f"e{i:04}", at, rng.choice(["sh", "ls", "nc"]), None, "p", None, rng.choice([0, 1000, None])))
    return rows


EXECUTIONS = (
    "image_digest string, container_id string, event_id string, occurred_at timestamp, process_name string, "
    "executable string, parent_name string, parent_executable string, user_uid bigint"
)
HOUR = 3_600_000_000


def log_of(spark, rows, where, parts=4):
    stream = files(spark, rows, EXECUTIONS, f"{where}/in", parts)
    log = window_log.WindowLog(spark, f"{where}/log", HOUR)
    window_log.window_stream(window_log.feed(stream), log, f"{where}/ck").awaitTermination()
    return log


def test_windows_lose_no_late_rows(spark, tmp_path):
    """Rows in random order, some twice: counts and bigrams equal those of the batch operators."""
    rows = executions(300, 1)
    mixed = rows + rows[::5]
    random.Random(2).shuffle(mixed)
    log = log_of(spark, mixed, str(tmp_path))
    frame = spark.createDataFrame(rows, EXECUTIONS).withColumn("w", F.expr(f"unix_micros(occurred_at) div {HOUR}"))
    want = profile.exec_tokens(frame, ["image_digest", "w"], with_shell=True).unionByName(
        profile.sequence_bigrams(frame, ["image_digest", "w"])
    )
    assert sorted(map(tuple, log.counts().collect())) == sorted(map(tuple, want.collect()))
    stored = log.events()
    assert stored.count() == 300 and 0 < stored.where("late").count() < 300


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = executions(60, 3)
    log = window_log.WindowLog(spark, str(tmp_path / "log"), HOUR)
    batches = [window_log.feed(spark.createDataFrame(rows[i::3], EXECUTIONS)) for i in range(3)]
    for number, batch in enumerate(batches):
        log.add(batch, number)
    before = sorted(map(tuple, log.counts().collect()))
    log.add(batches[2], 2)  # as after a failure
    assert sorted(map(tuple, log.counts().collect())) == before and log.events().count() == 60


def test_null_times_and_ids_and_an_empty_batch(spark, tmp_path):
    log = window_log.WindowLog(spark, str(tmp_path / "log"), HOUR)
    odd = [("img", "c", None, NOW, "sh", None, None, None, None)] * 2 + [("img", "c", "e", None, "sh", None, None, None, None)]
    assert log.add(window_log.feed(spark.createDataFrame([], EXECUTIONS)), 0) is None
    log.add(window_log.feed(spark.createDataFrame(odd, EXECUTIONS)), 1)
    assert log.events().count() == 2
    assert log.counts().where("family = 'process_name'").first().n == 2


def test_a_late_row_makes_a_new_revision(spark, tmp_path):
    baseline = spark.createDataFrame([("img", "process_name", "sh", 3)], "image_digest string, family string, token string, n bigint")
    training = spark.createDataFrame(executions(50, 5), EXECUTIONS).withColumn("w", F.lit(-1).cast("bigint"))
    numbers = profile.window_numbers(profile.exec_tokens(training, ["image_digest", "w"], with_shell=True), HOUR)
    summary = profile.numeric_summary(numbers)
    log = window_log.WindowLog(spark, str(tmp_path / "log"), HOUR)
    first = int((NOW - datetime(1970, 1, 1)).total_seconds()) // 3600
    shell = ("img", "c", "a", NOW, "sh", None, None, None, 0)
    for number, row in enumerate([shell, (*shell[:2], "b", NOW + timedelta(hours=1), *shell[4:]), (*shell[:2], "c", NOW, "nc", *shell[5:])]):
        fresh, windows = log.add(window_log.feed(spark.createDataFrame([row], EXECUTIONS)), number)
        log.score_revised(fresh, windows, baseline, summary, 1, number)
    log.finish(first, 3, baseline, summary, 1)
    got = {r.w - first: (r.revision, r.exec_count, r.status) for r in log.scores().collect()}
    assert got == {0: (2, 2, "scored"), 1: (1, 1, "scored"), 2: (-1, 0, "insufficient_data")}


def test_parent_stream_keeps_rows_by_day_and_no_list_per_pid(spark, tmp_path):
    schema = (
        "event_id string, sensor_instance_id string, docker_host_id string, container_id string, "
        "process_pid bigint, process_ppid bigint, time_nano bigint, occurred_at timestamp"
    )
    where, rng, day = str(tmp_path), random.Random(9), 86_400

    def row(name, second):
        at = datetime(2026, 7, 1) + timedelta(seconds=second)
        nanos = int((at - datetime(1970, 1, 1)).total_seconds()) * 1_000_000_000
        return (name, "s", "h" if second % 3 else None, f"c{second % 2}" if second % 5 else None, 1, 1, nanos, at)

    # One busy pid; batches 0 and 1 overlap, with one row without time; the others are 20 days later, with one row too late.
    times = sorted(rng.sample(range(3 * day), 90))
    late = [t for t in times if rng.random() < 0.3 and t > day]
    first = [row(f"a{t}", t) for t in times if t not in late]
    second = [row(f"a{t}", t) for t in late] + first[:5] + [("no time", "s", "h", "c0", 1, 1, None, None)]
    third = [row("new0", 23 * day + 7), row("new1", 23 * day + 13)]
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    run = parent_links.parent_stream(stream, f"{where}/l", f"{where}/ck", 2 * day, "3 days")
    run.awaitTermination()
    assert not any(p.stateOperators for p in run.recentProgress)
    written = spark.read.parquet(f"{where}/l")
    # A batch writes no link again that stayed the same.
    assert written.distinct().count() == written.count() > len(first) + len(set(second)) - 5
    got = sorted(map(tuple, parent_links.latest_links(written).collect()), key=str)
    kept = [r for r in {*first, *second} if r[6]] + third
    want = [tuple(r) for r in enrich.correlate_parent(spark.createDataFrame(kept, schema), 2 * day).collect()]
    assert got == sorted([*want, ("no time", None)], key=str)
    # One more batch removes the days that no accepted row can meet.
    spark.createDataFrame([row("new2", 23 * day + 99), row("too late", day + 1)], schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
    parent_links.parent_stream(stream, f"{where}/l", f"{where}/ck", 2 * day, "3 days").awaitTermination()
    days = {p.name for p in (tmp_path / "ck" / "rows" / "seen").glob("day=*")}
    links = dict(map(tuple, parent_links.latest_links(spark.read.parquet(f"{where}/l")).collect()))
    assert len(days) == 2 and links["new2"] and "too late" not in links


def test_a_batch_of_a_test_stream_is_cut_into_files(spark, tmp_path):
    from runwarden.plans import streaming_queries
    from runwarden.plans.views import CUT_US, Tables

    at = lambda days: datetime(1970, 1, 1) + timedelta(microseconds=CUT_US, days=days)
    rows = [(i, at(-25 + i % 7 if i < 30 else -5 if i < 31 else 3), i, "click", 1.0, '{"k": 1}') for i in range(60)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = streaming_queries.slices(Tables(spark, str(tmp_path)), str(tmp_path / "s"))
    sizes = {}
    pipelines.start(stream, lambda batch, n: sizes.update({n: batch.count()}), f"{tmp_path}/ck").awaitTermination()
    assert [sizes[n] for n in sorted(sizes)] == [30, 1, 29]
    assert len(list((tmp_path / "s" / "in").glob("part-*.parquet"))) > 3
