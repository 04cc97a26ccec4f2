import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runwarden import schemas
from runwarden.functions import context, documents
from runwarden.functions import text as clean
from runwarden.operators import normalize
from runwarden.operators import vulnerability as vuln
from runwarden.sources import readers, sinks


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    return [r.x for r in rows.select(column.alias("x")).collect()]


def test_redaction(spark):
    line = '"apiKey":"json-secret" token="super-secret" --password hunter2 Bearer abc123 π'
    want = '"apiKey":"<redacted>" token=<redacted> --password=<redacted> Bearer <redacted> π'
    assert one(spark, clean.redact(F.col("v")), line) == [want]


def test_utf8_clip_cuts_whole_characters(spark):
    text = "aé漢😀b�"
    for n in range(0, 16):
        want = text.encode()[:n].decode(errors="ignore")
        assert one(spark, clean.clip_utf8(F.col("v"), n), text) == [want]


def test_primary_digest(spark):
    digests = F.array(F.lit("example/other@sha256:" + "b" * 64), F.lit("alpine@sha256:" + "a" * 64))
    got = one(spark, clean.primary_digest(F.col("v"), digests), "docker.io/library/alpine:3.20", "unknown", None)
    assert got[0] == "alpine@sha256:" + "a" * 64 and got[1] == got[2] == got[0]


def line(**changes):
    fields = {"evt.rawtime": 1_700_000_000_123_456_789, "evt.num": 7, "proc.pid": 42, "proc.ppid": 1,
              "proc.name": "sh", "proc.exepath": "/bin/sh", "proc.cmdline": "sh -c \"é\"", "container.id": "abc",
              "user.uid": 0}
    fields.update(changes.pop("fields", {}))
    doc = {"rule": "R", "source": "syscall", "time": "2026-07-21T10:00:00.5Z", "tags": ["a", None, ""],
           "output_fields": {k: v for k, v in fields.items() if v is not ...}}
    return json.dumps({**doc, **changes}, ensure_ascii=False)


def test_exec_lines(spark):
    lines = [
        line(),
        line(fields={"evt.rawtime": "<NA>", "proc.pid": "43"}),
        line(rule="other"),
        line(source="k8s"),
        line(fields={"container.id": "host"}),
        line(fields={"proc.pid": -1}),
        line(fields={"evt.rawtime": None}, time="soon"),
        line(output_fields="text"),
        "{broken",
        "[1]",
    ]
    rows = spark.createDataFrame([(x,) for x in lines], "raw string")
    outcomes = [r.outcome for r in normalize.classify_sensor_lines(rows, "R").collect()]
    assert outcomes == ["ok", "ok", "ignored", "ignored", "ignored", "error", "error", "error", "malformed", "malformed"]
    events, letters = normalize.normalize_exec_lines(rows, "s", "R", "h")
    got = {r.process_pid: r for r in events.drop("raw_event").collect()}
    identity = {"command_line": 'sh -c "é"', "container_id": "abc", "event_number": 7, "event_type": "execve",
                "process_pid": 42, "process_ppid": 1, "sensor_instance_id": "s", "time_nano": 1_700_000_000_123_456_789}
    text = json.dumps(identity, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[42].event_id == hashlib.sha256(text.encode()).hexdigest()
    assert got[42].user_uid == 0 and got[42].tags == ["a"]
    assert got[43].time_nano == 1_784_628_000_500_000_000
    assert letters.count() == 5
    counters = normalize.ingest_counters(normalize.classify_sensor_lines(rows, "R"), events).first()
    assert (counters.lines, counters.ignored, counters.malformed, counters.enqueued) == (10, 3, 5, 2)


@pytest.mark.parametrize("small", [False, True])
def test_retention(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr("runwarden.operators.ordering.TIME_STEP", 120_000_000)
    rows = spark.createDataFrame(
        [(i, datetime(2026, 1, 1, 0, i % 30), "x" * (i % 7)) for i in range(60)], "id bigint, recorded_at timestamp, excerpt string"
    )
    kept = normalize.retain_dead_letters(rows, F.lit(datetime(2026, 1, 1, 0, 5)), 40, 70).collect()
    order = sorted((r for r in rows.collect() if r.recorded_at.minute >= 5), key=lambda r: (r.recorded_at, r.id))[-40:]
    while sum(len(r.excerpt) for r in order) > 70:
        order.pop(0)
    assert sorted(r.id for r in kept) == sorted(r.id for r in order)


def test_lifecycle_line(spark):
    doc = {"Type": "Container", "Action": "exec_create: /bin/sh -c x", "timeNano": 0, "time": 5,
           "Actor": {"ID": "cid", "Attributes": {"name": "n", "image": "alpine", "b": "2", "a": 1}}}
    rows = spark.createDataFrame([(json.dumps(doc),), ("nope",)], "raw string")
    r = normalize.lifecycle_events(rows, "h").drop("container_snapshot").first()
    identity = {"docker_host_id": "h", "event_type": "container", "action": "exec_create", "scope": None, "actor_id": "cid",
                "time_nano": 5_000_000_000, "attributes": {"name": "n", "image": "alpine", "b": "2", "a": "1"}}
    text = json.dumps(identity, sort_keys=True, separators=(",", ":"))
    assert r.event_id == hashlib.sha256(text.encode()).hexdigest()
    assert (r.command, r.container_name, r.image_digest_status) == ("/bin/sh -c x", "n", "inspection_failed")


def test_context_hash_ignores_order(spark):
    def inspection(caps, binds):
        return json.dumps({"Config": {"Entrypoint": ["/a/srv", "--Key", "k", "é"], "User": "0:0"},
                           "HostConfig": {"CapAdd": caps, "PortBindings": {p: [{"HostIp": "", "HostPort": ""}] for p in binds}},
                           "Mounts": []})

    rows = [(1, inspection(["NET_RAW", "CAP_SYS_ADMIN"], ["80/tcp", "53/udp"])), (2, inspection(["cap_sys_admin", "NET_RAW"], ["53/udp", "80/tcp"])),
            (3, inspection(["NET_RAW"], ["53/udp"]))]
    df = context.composed(spark.createDataFrame(rows, "id int, i string"), "i")
    df = df.withColumn("i", F.from_json("i", schemas.INSPECTION)).withColumn("c", context.runtime_context("i"))
    got = {r.id: r for r in df.select("id", "c", context.context_hash("c").alias("h")).collect()}
    assert got[1].h == got[2].h != got[3].h
    assert got[1].c.entrypoint_shape == ["exe:srv", "flag:<secret>", "<secret-value>", "<positional>"]
    assert (got[1].c.configured_user, got[1].c.network_mode, got[1].c.mounts) == ("root", None, [])


def test_secret_scan_names_paths_only(spark):
    doc = json.dumps({"a": [{"x": "my PASSWORD"}], "token": 1, "ok": "<secret-value>"})
    rows = spark.createDataFrame([(1, doc)], "id int, d string")
    got = documents.secret_findings(rows, "d", "id").collect()
    assert sorted((r.path, r.marker) for r in got) == [("$.a[0].x", "password"), ("$.token", "token")]


def test_findings(spark):
    report = {"Results": [{"Target": "t", "Vulnerabilities": [
        {"VulnerabilityID": "cve-2025-0003", "PkgName": "curl", "PkgPath": "/usr/bin/curl", "FixedVersion": "2", "Severity": "high",
         "CVSS": {"a": {"V2Score": 5.0}, "b": {"V3Score": "x"}, "c": {"V3Score": 9.1, "V3Vector": "v"}, "d": {"V3Score": 9.1}}},
        {"VulnerabilityID": "GHSA-1"}, {"VulnerabilityID": "CVE-2025-1"}, {"VulnerabilityID": "CVE-2025-0003"}]}]}
    rows = spark.createDataFrame([("s", "img", json.dumps(report))], "scan_id string, image_digest string, d string")
    reports = rows.withColumn("d", F.from_json("d", schemas.SCAN_REPORT)).select("scan_id", "image_digest", "d.*")
    assert [r.cve_id for r in vuln.extract_cves(reports).collect()] == ["CVE-2025-0003"]
    found = vuln.normalize_findings(reports)
    first = found.where("fixed_version = '2'").first()
    assert (first.severity, first.cvss_score, first.cvss_source, first.cvss_vector) == ("HIGH", 9.1, "c", "v")
    summary = vuln.severity_summary(found, ["scan_id"]).first()
    assert (summary.finding_count, summary.distinct_cves, summary.fixable_findings) == (2, 1, 1)
    execs = spark.createDataFrame([("img", datetime(2026, 1, 1), "e", "/usr/bin/curl", None)], "image_digest string, occurred_at timestamp, event_id string, executable string, process_name string")
    containers = spark.createDataFrame([("img", True)], "image_digest string, published boolean")
    staged = vuln.exposure_stage(found.withColumn("finding_id", F.monotonically_increasing_id()), containers, vuln.observed_programs(execs))
    assert {r.package_name: r.evidence_stage for r in staged.collect()} == {
        "curl": "runtime_observed_and_port_published", "unknown": "deployed"
    }


def test_intelligence_rows_are_spread(spark):
    # The first slice holds every finding whose CVE has twenty intelligence rows.
    findings = spark.range(0, 400, 1, 4).select("id", F.concat(F.lit("CVE-"), F.col("id")).alias("cve_id"))
    many = spark.range(2000).select(F.concat(F.lit("CVE-"), F.col("id") % 100).alias("cve_id"), (F.col("id") / 2).alias("epss_score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = vuln.with_intel(findings, many)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 2300 and max(sizes) < 1150
    assert rows.where("intel_snapshot IS NULL").count() == 300


def test_coverage_counts_intelligence_rows(spark):
    rows = [("s", "i", "A"), ("s", "i", "A"), ("s", "i", "B"), ("s", "i", None), ("t", "i", "C")]
    findings = spark.createDataFrame([(*r, None, "HIGH") for r in rows], "scan_id string, image_digest string, cve_id string, fixed_version string, severity string")
    intel = [("A", 0.5, True), ("A", None, True), ("A", 0.1, None), ("B", None, False), (None, 0.3, True)]
    known = spark.createDataFrame(intel, "cve_id string, epss_score double, kev boolean")
    none = spark.createDataFrame([], "image_digest string")
    got = {r.scan_id: r for r in vuln.scan_summary(findings, known, none, none).collect()}
    assert [(r.finding_count, r.epss_covered_findings, r.kev_findings) for r in (got["s"], got["t"])] == [(4, 4, 4), (1, 0, 0)]


def test_files(spark, tmp_path):
    rows = spark.range(6).withColumn("x", F.col("id") * 2)
    sinks.append_new(rows, str(tmp_path / "t"), key="id")
    sinks.append_new(spark.range(3, 9).withColumn("x", F.lit(0).cast("bigint")), str(tmp_path / "t"), key="id")
    table = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.id, r.x) for r in table.collect()) == [(i, i * 2 if i < 6 else 0) for i in range(9)]
    (tmp_path / "trials").mkdir()
    for i, status in enumerate(["completed", "failed"]):
        (tmp_path / "trials" / f"{i}.json").write_text(json.dumps({"trial_id": str(i), "status": status}, indent=1))
    assert [r.trial_id for r in readers.trials(spark, str(tmp_path / "trials")).collect()] == ["0"]
    (tmp_path / "m").mkdir()
    for name in "abc":
        (tmp_path / "m" / name).write_text(name)
    hashes = sinks.file_hashes(spark, str(tmp_path / "m"))
    manifest = spark.createDataFrame(
        [("a", hashlib.sha256(b"a").hexdigest()), ("b", "0"), ("gone", "0")], "path string, sha256 string"
    )
    got = {r.path: r.problem for r in sinks.verify_manifest(hashes, manifest).collect()}
    assert got == {"b": "mismatch", "c": "unrecorded", "gone": "missing"}


def test_texts_are_composed_in_pieces():
    import unicodedata

    import pyarrow as pa

    texts = ["e\u0301" * 60_000, None, "plain", "x" * 3_000_000 + "o\u0308", *["u\u0308" * 100_000] * 20]
    batch = pa.record_batch({"id": pa.array(range(len(texts))), "i": pa.array(texts)})
    pieces = list(context._composed_batches(iter([batch]), "i"))
    assert len(pieces) > 5 and max(p.num_rows for p in pieces) <= 4
    want = [t and unicodedata.normalize("NFC", t) for t in texts]
    assert [x for p in pieces for x in p["i"].to_pylist()] == want
    assert [x for p in pieces for x in p["id"].to_pylist()] == list(range(len(texts)))


def test_reports_are_shuffled_once_as_plain_columns(spark, tmp_path):
    from collections import Counter

    from runwarden.plans.views import Tables
    from runwarden.plans.vulnerability_queries import report_documents

    schema = (
        "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string, l_linestatus string, "
        "l_suppkey bigint, l_tax double, l_discount double"
    )
    rows = [(i % 5, i, i % 3, "RAN"[i % 3], "OF"[i % 2], i % 7 or None, 0.01 * (i % 2), 0.02) for i in range(60)]
    spark.createDataFrame(rows * 2, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = report_documents(Tables(spark, str(tmp_path)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    got = Counter()
    for row in found.collect():
        for layer in json.loads(row["document"])["Results"]:
            got.update((row["scan_id"], layer.get("Target"), v["VulnerabilityID"]) for v in layer["Vulnerabilities"])
            if "Target" not in layer:
                assert {v.get("Severity") for v in layer["Vulnerabilities"]} <= {"MEDIUM", None}
    name = lambda p: f"GHSA-{p}" if p % 11 == 0 else f"cve-2024-{p % 900}" if p % 13 == 0 else f"CVE-2024-{p:05}"
    assert got == Counter((f"s{r[0]}", None if r[5] is None else f"layer{r[5] % 5}", name(r[1])) for r in rows * 2)
    sinks.store_documents(found, f"{tmp_path}/stored")
    assert all(f.name.endswith(".gz") for f in (tmp_path / "stored").glob("part-*"))
    back = readers.stored_documents(spark, f"{tmp_path}/stored", "scan_id STRING, image_digest STRING", "Results ARRAY<STRUCT<Target:STRING>>")
    assert sorted(r.scan_id for r in back.collect()) == [f"s{i}" for i in range(5)]
