from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runwarden.operators import custom_rules, enrich, incidents, rules

START = datetime(2026, 7, 21, 10, 0)
EXEC = (
    "image_digest string, w bigint, event_id string, occurred_at timestamp, container_id string, process_name string, "
    "executable string, command_line string, parent_name string, parent_executable string, "
    "parent_command_line string, user_uid bigint, parent_event_id string"
)
LIFE = (
    "image_digest string, w bigint, event_id string, occurred_at timestamp, container_id string, event_type string, "
    "action string, privileged boolean"
)
SCORES = (
    "image_digest string, w bigint, status string, total_score double, exec_count bigint, lifecycle_count bigint"
)
END = F.timestamp_micros


def process(name, seconds, executable, uid=0, process=None, command=None, parent=None, up=None, container="c1"):
    at = START + timedelta(seconds=seconds)
    return ("img", 0, name, at, container, process or executable.split("/")[-1], executable, command, None, parent, None, uid, up)


def execs(spark, *rows):
    return spark.createDataFrame(list(rows), EXEC)


@pytest.fixture(scope="module")
def baseline(spark):
    rows = [("executable", "/usr/bin/python"), ("executable", "/usr/bin/gunicorn"), ("executable", "/bin/busybox"),
            ("process_name", "Python"), ("process_name", "gunicorn"), ("user_uid", "1000")]
    return spark.createDataFrame([("img", f, t, 1) for f, t in rows], "image_digest string, family string, token string, n bigint")


def run(spark, baseline, events, allow=None, score=0.82, lifecycle=0):
    scores = spark.createDataFrame([("img", 0, "scored", score, events.count(), lifecycle)], SCORES)
    life = spark.createDataFrame([], LIFE)
    unseen = rules.unseen_table(events, baseline)
    found = rules.built_in_matches(events, life, baseline, unseen, scores, F.lit(START + timedelta(minutes=1)))
    types = "allowlist_id string, image_digest string, rule_id string, executable string, parent_executable string, active boolean, expires_at timestamp"
    entries = rules.active_allowlists(spark.createDataFrame(allow or [], types), F.lit(START))
    matches = rules.apply_allowlists(rules.deduplicate(found), entries)
    return matches, incidents.detection_runs(scores, matches).first(), scores


SHELL = process("p-shell", 5, "/bin/sh", parent="/usr/bin/gunicorn")
TOOL = process("p-tool", 20, "/usr/bin/wget", up="p-shell")


def test_shell_then_tool_chain(spark, baseline):
    matches, summary, _ = run(spark, baseline, execs(spark, SHELL, TOOL))
    assert sorted(r.rule_id for r in matches.collect()) == ["DET-001", "DET-002", "DET-003", "DET-003", "DET-004", "DET-005"]
    assert summary.run_status == "incident_created"
    assert summary.severity_score == pytest.approx(0.992)
    assert summary.confidence_score == pytest.approx(0.8249985)


def test_published_severity_and_confidence(spark):
    scores = spark.createDataFrame([("img", 0, "scored", 0.273, 3, 1)], SCORES)
    rows = [("img", 0, r, s, c, e, t, None) for r, s, c, e, t in [
        ("a", 0.72, 0.90, True, "process_event"), ("b", 0.64, 0.80, True, "runtime_event"),
        ("c", 0.90, 0.95, True, "derived_correlation"), ("d", 0.35, 0.95, False, "runtime_event")]]
    types = "image_digest string, w bigint, rule_id string, severity_weight double, confidence_weight double, incident_eligible boolean, source_type string, suppressed_by string"
    got = incidents.detection_runs(scores, spark.createDataFrame(rows, types)).first()
    assert got.severity_score == pytest.approx(0.74055, abs=1e-4)
    assert got.confidence_score == pytest.approx(0.9250, abs=1e-4)


def test_multicall_binaries(spark, baseline):
    events = execs(
        spark,
        process("a", 1, "/bin/busybox", process="base64"),
        process("b", 2, "/bin/busybox", process="busybox", command="busybox wget https://example.invalid/payload"),
        process("c", 3, "/bin/busybox", process="busybox", command="busybox --help"),
        process("d", 4, "/bin/busybox", process="sh"),
    )
    got = {r.event_id: r.program for r in rules.resolve_identity(events).collect()}
    assert got == {"a": "base64", "b": "wget", "c": "busybox", "d": "sh"}
    matches, _, _ = run(spark, baseline, events)
    assert {r.source_id for r in matches.where("rule_id = 'DET-002'").collect()} == {"d"}
    # The binary is known by path, but its applets are judged by name only.
    assert {"a", "b", "c"} == {r.source_id for r in matches.where("rule_id = 'DET-004'").collect()}


def test_allowlist(spark, baseline):
    entry = ("a1", "img", "DET-002", "/bin/sh", "/usr/bin/gunicorn", True, None)
    shell = process("p1", 5, "/bin/sh", uid=1000, parent="/usr/bin/gunicorn")
    matches, summary, _ = run(spark, baseline, execs(spark, shell), [entry], score=0.1)
    assert summary.run_status == "no_findings" and summary.suppressed_matches == 1
    bash = process("p1", 5, "/bin/bash", uid=1000, parent="/usr/bin/gunicorn")
    _, summary, _ = run(spark, baseline, execs(spark, bash), [entry], score=0.1)
    assert summary.run_status == "incident_created"
    expired = (*entry[:6], START - timedelta(1))
    _, summary, _ = run(spark, baseline, execs(spark, shell), [expired], score=0.1)
    assert summary.run_status == "incident_created"


def test_allowlisted_tool_suppresses_the_pair(spark, baseline):
    entry = ("a1", "img", "DET-004", "/usr/bin/wget", None, True, None)
    matches, _, _ = run(spark, baseline, execs(spark, SHELL, TOOL), [entry])
    assert {r.rule_id for r in matches.where("suppressed_by = 'a1'").collect()} == {"DET-004", "DET-005"}


def test_tool_cap_counts_the_rest(spark, baseline):
    events = execs(spark, *[process(f"t{i:02}", i, f"/opt/t{i}", uid=1000) for i in range(13)], process("s", 0, "/bin/sh", uid=1000))
    unseen = rules.unseen_table(events, baseline)
    assert [r.source_id for r in rules.new_tool(unseen).orderBy("source_id").collect()] == [f"t{i:02}" for i in range(13)]
    assert rules.surplus_tools(unseen).first().additional_unseen_executables == 3
    # The pair rule looks at all tools, not only the listed ones.
    assert rules.shell_then_tool_pairs(unseen).count() == 13


def test_pair_counts_agree_with_pairs(spark, baseline, hot):
    rows = [process(f"s{i}", i * 7 % 400, "/bin/sh") for i in range(20)]
    rows += [process(f"t{i}", i * 13 % 400, "/opt/t") for i in range(30)]
    unseen = rules.unseen_table(execs(spark, *rows), baseline)
    pairs = rules.shell_then_tool_pairs(unseen).groupBy("tool_event_id").count().collect()
    counted = rules.shell_then_tool_counts(unseen).collect()
    assert sorted((r.tool_event_id, r["count"]) for r in pairs) == sorted((r.tool_event_id, r.shells) for r in counted)


def leaf(field, op, value, **more):
    return {"field": field, "op": op, "value": value, **more}


def rule(slug, condition, target="process"):
    return {"slug": slug, "name": slug, "category": "x", "target": target, "condition": condition,
            "severity_weight": 0.5, "confidence_weight": 0.5, "incident_eligible": True}


def test_custom_rules(spark):
    events = execs(
        spark,
        process("root", 0, "/usr/bin/sshd", uid=None),
        process("mid", 1, "/bin/sh", uid=0, up="root", parent="/usr/bin/SSHD"),
        process("end", 2, "/usr/bin/nc", uid=5, up="mid", command="nc -L 80"),
    )
    life = spark.createDataFrame([("img", 0, "l", START, "c1", "container", "start", None)], LIFE)
    tests = [
        rule("text-uid", leaf("user_uid", "equals", "0")),
        rule("odd-uid", leaf("user_uid", "equals", "zero")),
        rule("absent", leaf("user_uid", "not_equals", 0)),
        rule("not-in", leaf("user_uid", "not_in", [0, 5])),
        rule("is-null", leaf("user_uid", "in", [None])),
        rule("search", leaf("command_line", "contains", "-l 8")),
        rule("parent", leaf("parent_executable", "equals", "sshd")),
        rule("up", leaf("executable", "equals", "sshd", scope="ancestor")),
        rule("not-up", {"not": leaf("executable", "equals", "sshd", scope="ancestor")}),
        rule("words", "executable = 'nc' AND exists(ancestors, a -> a.executable = 'sh')"),
        rule("plain", leaf("privileged", "not_equals", True), "lifecycle"),
        rule("empty", {"any": []}),
        rule("deep", {"not": {"not": {"not": {"not": {"not": {"not": {"not": leaf("user_uid", "equals", 1)}}}}}}}),
        rule("wide", {"any": [leaf("user_uid", "equals", 1)] * 41}),
        rule("field", leaf("action", "equals", "x")),
        rule("contains", leaf("process_name", "contains", "x")),
        rule("scope", leaf("action", "equals", "x", scope="ancestor"), "lifecycle"),
        rule("call", "reflect('java.lang.System', 'exit') = '0'"),
        rule("unfinished", "executable = "),
        rule("not-boolean", "executable"),
        rule("no-list", "exists(executable, a -> true)"),
        rule("mixed", "user_uid = command_line OR user_uid / 0 > 1 OR user_uid = 'zero'"),
        {"slug": "hollow"},
    ]
    found, errors = custom_rules.custom_matches(tests, events, life)
    got = {}
    for r in found.collect():
        got.setdefault(r.rule_id.removeprefix("CUS-"), set()).add(r.source_id)
    assert got == {
        "text-uid": {"mid"}, "absent": {"root", "end"}, "not-in": {"root"}, "is-null": {"root"},
        "search": {"end"}, "parent": {"mid"}, "up": {"mid", "end"}, "not-up": {"root"},
        "words": {"end"}, "plain": {"l"}, "deep": {"root", "mid", "end"},
    }
    assert {r.slug for r in errors.collect()} == {
        "empty", "field", "contains", "scope", "call", "hollow", "unfinished", "not-boolean", "no-list"
    }


def test_status_fold(spark):
    rows = [("i", 1, "c1", "acknowledged"), ("i", 2, "c2", "open"), ("i", 3, "c3", "resolved"), ("i", 4, "c4", "dismissed")]
    changes = spark.createDataFrame(rows, "incident_id string, changed_at bigint, change_id string, new_status string")
    got = {r.change_id: (r.result, r.status) for r in incidents.fold_status(changes).collect()}
    assert got == {"c1": ("applied", "resolved"), "c2": ("rejected", "resolved"),
                   "c3": ("applied", "resolved"), "c4": ("rejected", "resolved")}


def test_process_chain(spark):
    events = execs(spark, SHELL, TOOL)
    got = {r.event_id: [n.event_id for n in r.process_chain] for r in enrich.process_chain(events).collect()}
    assert got == {"p-shell": ["p-shell"], "p-tool": ["p-tool", "p-shell"]}


def test_the_first_of_many_allowlist_entries(spark):
    """A hundred thousand entries for one digest and rule: the smallest id that agrees suppresses."""
    entry = "allowlist_id string, image_digest string, rule_id string, executable string, parent_executable string"
    many = spark.range(100_000).select(
        F.format_string("a%06d", F.col("id") + 10).alias("allowlist_id"), F.lit("d").alias("image_digest"), F.lit("DET-004").alias("rule_id"),
        F.format_string("/bin/t%d", F.col("id") % 1000).alias("executable"),
        F.when(F.col("id") % 2 == 0, F.format_string("/bin/p%d", F.col("id") % 7)).alias("parent_executable"),
    )
    few = spark.createDataFrame([("a000001", "d", "DET-004", None, "/bin/only"), ("z", "e", "DET-004", None, None)], entry)
    wanted = [("1", "d", "/bin/t5", "/bin/p0"), ("2", "d", "/bin/t4", None), ("3", "d", "/bin/t4", "/bin/only"), ("4", "d", None, None), ("5", "e", None, None)]
    rows = [(d, 0, "DET-004", i, x, p) for i, d, x, p in wanted]
    matches = spark.createDataFrame(rows, "image_digest string, w bigint, rule_id string, source_id string, executable string, parent_executable string")
    matches = matches.withColumns({"shell_event_id": F.lit(None).cast("string"), "tool_event_id": F.lit(None).cast("string")})
    found = rules.apply_allowlists(matches, many.unionByName(few))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert {r.source_id: r.suppressed_by for r in found.collect()} == {"1": "a000015", "2": None, "3": "a000001", "4": None, "5": "z"}


def test_status_of_an_incident_with_a_million_changes(spark):
    changes = spark.range(1_000_000).select(
        F.lit("i").alias("incident_id"), F.timestamp_seconds("id").alias("changed_at"), F.format_string("c%07d", "id").alias("change_id"),
        F.when(F.col("id") == 700_000, "dismissed").when(F.col("id") > 800_000, "resolved").when(F.col("id") >= 5, "acknowledged")
        .otherwise("open").alias("new_status"),
    )
    found = incidents.fold_status(changes)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = {(r.status, r.before, r.result): r.n for r in found.groupBy("status", "before", "result").agg(F.count("*").alias("n")).collect()}
    assert got == {
        ("dismissed", "open", "unchanged"): 5, ("dismissed", "open", "applied"): 1, ("dismissed", "acknowledged", "unchanged"): 699_994,
        ("dismissed", "acknowledged", "applied"): 1, ("dismissed", "dismissed", "rejected"): 299_999,
    }


def test_bits_of_a_long_chain_a_loop_and_many_conditions(spark):
    """Ten thousand nodes in one chain; rows hold one number each, whatever the depth."""
    chain = spark.range(10_000).select(
        F.lit("d").alias("image_digest"), F.col("id").cast("string").alias("event_id"),
        F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_event_id"), F.col("id").alias("number"),
    )
    loop = spark.createDataFrame([("d", "x", "y", -1), ("d", "y", "x", -2), ("d", "z", "x", -3), ("e", "o", "0", -4)], chain.schema)
    tests = [F.col("number") == 0, F.col("number") == 9_998, F.col("number") == -2] + [F.lit(False)] * 70 + [F.col("number") == -1]
    bits = enrich.ancestor_bits(chain.unionByName(loop), ["image_digest"], tests)
    assert dict(bits.dtypes)["bits0"] == dict(bits.dtypes)["bits1"] == "bigint"
    got = {r.event_id: (r.bits0, r.bits1) for r in bits.collect()}
    assert len(got) == 9_999 + 3 and got["1"] == (1, 0) and got["9999"] == (3, 0)
    assert all(got[str(i)] == (1, 0) for i in range(1, 9_999))
    last = 1 << (73 - 62)
    assert got["x"] == got["y"] == got["z"] == (4, last)


def test_evidence_behind_matches(spark, baseline):
    """Command line, user, raw names, chain and elapsed time of the event a match is about."""
    shell = process("p-shell", 5, "/bin/sh", parent="/usr/bin/gunicorn", command="sh -c wget")
    tool = process("p-tool", 20, "/usr/bin/wget", uid=7, up="p-shell", command="wget http://x")
    events = execs(spark, shell, tool)
    matches, _, _ = run(spark, baseline, events)
    found = {(r.rule_id, r.source_id): r for r in incidents.match_evidence(matches, events).collect()}
    assert len(found) == matches.count()
    pair = found["DET-005", "p-shell:p-tool"]
    assert pair.elapsed_seconds == 15.0 and pair.command_line == "wget http://x" and pair.process_chain == ["p-tool", "p-shell"]
    new = found["DET-004", "p-tool"]
    assert (new.raw_executable, new.user_uid, new.parent_event_id) == ("/usr/bin/wget", 7, "p-shell")
    assert found["DET-002", "p-shell"].raw_parent_executable == "/usr/bin/gunicorn"
    score = found["DET-001", "img:0"]
    assert score.command_line is None and score.process_chain is None
