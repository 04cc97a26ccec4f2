"""The resumable line source: half lines, restarts, rotation and cut files."""

import os

from pyspark.sql import functions as F

from runwarden.sources.line_source import SensorLineReader, SensorLineSource, position


def append(path, text):
    with open(path, "a", encoding="utf-8") as file:
        file.write(text)


def read_on(spark, where, pattern="*.jsonl*"):
    """Lines that one run of the stream adds to a table; the run ends when all files are read."""
    spark.dataSource.register(SensorLineSource)
    lines = spark.readStream.format("sensor_lines").option("path", f"{where}/{pattern}").option("sliceBytes", 40).load()
    writer = lines.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/ck")
    query = writer.start()
    query.processAllAvailable()
    query.stop()
    return [r.raw for r in spark.read.schema("raw string").parquet(f"{where}/out").orderBy("raw").collect()]


def test_a_half_line_waits_and_a_restart_goes_on(spark, tmp_path):
    log = f"{tmp_path}/a.jsonl"
    append(log, "a1 first\na2 é second\n\na3 half")
    assert read_on(spark, tmp_path) == ["a1 first", "a2 é second"]
    append(log, " and whole\na4 another")
    assert read_on(spark, tmp_path) == ["a1 first", "a2 é second", "a3 half and whole"]
    append(log, "\n")
    os.rename(log, f"{tmp_path}/a.jsonl.1")  # rotated: the old file is read to its end, the new one from its start
    append(f"{tmp_path}/a.jsonl.1", "a5 late\n")
    append(log, "b1 new file\n")
    assert read_on(spark, tmp_path) == ["a1 first", "a2 é second", "a3 half and whole", "a4 another", "a5 late", "b1 new file"]
    with open(log, "w", encoding="utf-8") as file:  # cut and written again, longer than before
        file.write("c1 after the cut, a longer line\n")
    assert read_on(spark, tmp_path)[-1] == "c1 after the cut, a longer line"
    assert len(read_on(spark, tmp_path)) == 7


def test_slices_hold_whole_lines(tmp_path):
    log, lines = f"{tmp_path}/a.jsonl", [f"line {i} {'x' * (i % 13)}" for i in range(300)]
    append(log, "\n".join(lines) + "\n")
    reader = SensorLineReader(log, 100)
    offset = reader.latestOffset()
    slices = reader.partitions({}, offset)
    assert len(slices) > 30 and [text for s in slices for text, _, _ in reader.read(s)] == lines
    assert position(offset) == {log: os.path.getsize(log)} and reader.partitions(offset, offset) == []
    assert max(s.end - s.start for s in slices) < 140


def test_no_files(tmp_path):
    reader = SensorLineReader(f"{tmp_path}/*.jsonl", 100)
    assert reader.latestOffset() == {} and reader.partitions({}, {}) == []


def test_a_batch_reads_each_line_once(spark, tmp_path):
    append(f"{tmp_path}/x.jsonl", "".join(f"{i}\n" for i in range(1000)))
    spark.dataSource.register(SensorLineSource)
    lines = spark.readStream.format("sensor_lines").option("path", f"{tmp_path}/x.jsonl").option("sliceBytes", 500).load()
    writer = lines.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
    query = writer.start()
    query.processAllAvailable()
    query.stop()
    row = spark.read.parquet(f"{tmp_path}/out").agg(F.count("*"), F.count_distinct("raw"), F.sum(F.col("raw").cast("long"))).first()
    assert tuple(row) == (1000, 1000, 499500)
