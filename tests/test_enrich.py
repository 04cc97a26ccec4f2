from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runwarden.operators import enrich

NOW = datetime(2026, 7, 21, 12, 0)
SCHEMA = (
    "event_id string, sensor_instance_id string, docker_host_id string, container_id string, "
    "process_pid bigint, process_ppid bigint, time_nano bigint, occurred_at timestamp"
)


def event(name, seconds, pid, ppid, host="h", container="c", sensor="s"):
    at = NOW + timedelta(seconds=seconds)
    nanos = int((at - datetime(1970, 1, 1)).total_seconds()) * 1_000_000_000
    return (name, sensor, host, container, pid, ppid, nanos, at)


def links(spark, *events):
    rows = enrich.correlate_parent(spark.createDataFrame(list(events), SCHEMA)).collect()
    return {r.event_id: r.parent_event_id for r in rows}


def test_reused_pid_outside_the_lookback(spark):
    assert links(spark, event("old", -7200, 42, 1), event("probe", 0, 9, 42))["probe"] is None
    got = links(spark, event("old", -7200, 42, 1), event("near", -30, 42, 1), event("probe", 0, 9, 42))
    assert got["probe"] == "near"


def test_parent_at_the_edge_of_the_lookback(spark):
    parent, probe = event("edge", -600, 42, 1), event("probe", 0, 9, 42)
    later = (*probe[:6], probe[6] + 900, probe[7])
    assert links(spark, parent, later)["probe"] == "edge"
    after = (*probe[:6], probe[6] + 1000, probe[7])
    assert links(spark, parent, after)["probe"] is None


def test_scope_and_self(spark):
    got = links(
        spark,
        event("other", -5, 42, 0, container="x"),
        event("self", 0, 42, 42),
        event("host-only", 0, 7, 42, container=None),
        event("nothing", 1, 8, 42, host=None, container=None),
        event("init", 0, 5, 0),
    )
    assert got["self"] is None
    # At the same instant the largest id wins; a host-only probe may use any container.
    assert got["host-only"] == "self"
    assert got["nothing"] == "self"
    assert "init" not in got


def test_parents_with_hot_keys(spark, hot):
    events = [event(f"e{i:03}", i * 20, 1, 1) for i in range(40)]
    got = links(spark, *events)
    assert got == {f"e{i:03}": (f"e{i - 1:03}" if i else None) for i in range(40)}


def test_resolve_container(spark):
    containers = spark.createDataFrame(
        [("h1", "abcdef0123456789"), ("h1", "abcdef0123999999"), ("h2", "ffff00001111aaaa")],
        "docker_host_id string, container_id string",
    )
    reported = spark.createDataFrame(
        [("1", "abcdef012345", None), ("2", "abcdef0123", None), ("3", "host", None), ("4", None, None),
         ("5", "ffff", "h1"), ("6", "ffff", "h2"), ("7", "abcdef0123456789", "h1"), ("8", "", None),
         ("9", "ffff", "")],
        "event_id string, reported_container_id string, reported_docker_host_id string",
    )
    got = {r.event_id: r.correlation_status for r in enrich.resolve_container(reported, containers).collect()}
    assert got == {
        "1": "resolved", "2": "ambiguous", "3": "unresolved", "4": "unresolved",
        "5": "unresolved", "6": "resolved", "7": "resolved", "8": "unresolved",
        "9": "resolved",
    }


def chain_events(spark, parents):
    rows = [(k, p, k, k, f"/bin/{k}", None, None, None, NOW) for k, p in parents.items()]
    return spark.createDataFrame(
        rows,
        "event_id string, parent_event_id string, process_name string, command_line string, executable string, "
        "parent_executable string, parent_name string, parent_command_line string, occurred_at timestamp",
    )


def test_chain_limit_and_cycles(spark):
    line = {f"n{i:02}": (f"n{i - 1:02}" if i else None) for i in range(40)}
    line |= {"x": "y", "y": "x", "in": "x", "lost": "gone"}
    line |= {f"loop{i}": f"loop{(i - 1) % 10}" for i in range(10)}
    rows = enrich.ancestor_chain(chain_events(spark, line)).collect()
    got = {r.event_id: [n.event_id for n in r.ancestors] for r in rows}
    assert got["n39"] == [f"n{i:02}" for i in range(38, -1, -1)]
    assert got["n03"] == ["n02", "n01", "n00"]
    assert got["x"] == ["y", "x"] and got["in"] == ["x", "y"]
    assert got["loop9"] == [f"loop{i}" for i in (8, 7, 6, 5, 4, 3, 2, 1, 0, 9)]
    short = enrich.ancestor_chain(chain_events(spark, line), limit=25).collect()
    assert {r.event_id: len(r.ancestors) for r in short}["n39"] == 25
    assert "lost" not in got and "n00" not in got


def test_status_folds_ignore_arrival_order(spark):
    rows = [("h", "c", "old", None, "i", "d1", "resolved", NOW, NOW),
            ("h", "c", None, "r", "i", "d2", "inspection_failed", NOW + timedelta(1), NOW + timedelta(1))]
    names = ["docker_host_id", "container_id", "container_name", "image_ref", "image_id", "image_digest",
             "image_digest_status", "occurred_at", "received_at"]
    types = "docker_host_id string, container_id string, container_name string, image_ref string, image_id string, image_digest string, image_digest_status string, occurred_at timestamp, received_at timestamp"
    a = enrich.container_identities(spark.createDataFrame(rows, types)).first()
    b = enrich.container_identities(spark.createDataFrame(rows[::-1], types)).first()
    assert a == b and len(names) == 9
    assert (a.container_name, a.image_ref, a.image_digest, a.image_digest_status) == ("old", "r", "d2", "resolved")


def test_pages_keep_ties(spark):
    rows = spark.createDataFrame([(5, "a"), (5, "b"), (5, "c"), (4, "d")], "time_nano bigint, event_id string")
    first = enrich.keyset_page(rows, 2).collect()
    second = enrich.keyset_page(rows, 2, (first[-1].time_nano, first[-1].event_id)).collect()
    assert [r.event_id for r in first + second] == ["a", "b", "c", "d"]


def test_filter_vocabulary(spark):
    rows = spark.range(3).withColumn("status", F.lit("open"))
    with pytest.raises(ValueError):
        enrich.filter_events(rows, equals={"status": "odd"}, allowed={"status": ["open", "closed"]})
