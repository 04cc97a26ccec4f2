"""Tables that a stream adds to: atomic, repeatable, and no slower as they grow.

A commit writes its rows as a new run of files and then puts a manifest beside them with one
rename; readers take the newest manifest.  A batch that fails in between leaves files that no
manifest names, and its repetition commits once.  Stored rows are not read by a commit: rows of
one key are merged when the table is read, and in compactions.  ``FANOUT`` runs of one level
are merged into one run of the next, so a row is rewritten a logarithmic number of times and a
reader meets few runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8
_LOG = "_manifests"


def first_of_key(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps the row of each key that was committed first; a null key is a key."""

    def merge(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (*keys, "_commit")]
        kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), "_commit").alias("_row"), F.min("_commit").alias("_commit"))
        return kept.select(*keys, "_row.*", "_commit").select(*rows.columns)

    return merge


class MergeTable:
    """Rows below ``folder`` that ``merge`` brings to one row per key; it must not mind repeated merging."""

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame], fanout: int = FANOUT):
        self.spark, self.folder, self.merge, self.fanout = spark, folder.rstrip("/"), merge, fanout

    # --- manifests -----------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        system, path = self._path(name)
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def manifest(self) -> dict:
        """Newest manifest: ``number``, ``committed`` (last batch of each source), ``schema`` and ``runs``."""
        names = [n for n in self._names(_LOG) if n.endswith(".json")]
        if not names:
            return {"number": -1, "committed": {}, "schema": None, "runs": []}
        system, path = self._path(f"{_LOG}/{names[-1]}")
        stream = system.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        system, passing = self._path(f"{_LOG}/{uuid.uuid4().hex}.tmp")
        stream = system.create(passing)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        _, final = self._path(f"{_LOG}/{manifest['number']:012d}.json")
        if system.exists(final) or not system.rename(passing, final):
            raise RuntimeError(f"someone else committed {manifest['number']} to {self.folder}")

    # --- rows ----------------------------------------------------------------------------

    def _write(self, rows: DataFrame, level: int) -> dict:
        run = {"level": level, "path": f"runs/{uuid.uuid4().hex}"}
        rows.write.parquet(f"{self.folder}/{run['path']}")
        return run

    def _rows(self, runs: Sequence[dict], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{run['path']}" for run in runs]
        return self.spark.read.schema(schema).parquet(*paths)

    def commit(self, rows: DataFrame, source: str, batch_id: int) -> bool:
        """Add a batch; False if this batch of this source has been committed before."""
        manifest = self.manifest()
        if manifest["committed"].get(source, -1) >= batch_id:
            return False
        number = manifest["number"] + 1
        stamped = self.merge(rows.withColumn("_commit", F.lit(number).cast("bigint")))
        schema = manifest["schema"] or ", ".join(f"`{n}` {k}" for n, k in stamped.dtypes)
        runs = [*manifest["runs"], self._write(stamped, 0)]
        level = 0
        while len(same := [r for r in runs if r["level"] == level]) >= self.fanout:
            merged = self._write(self.merge(self._rows(same, schema)), level + 1)
            runs = [*[r for r in runs if r["level"] != level], merged]
            level += 1
        committed = {**manifest["committed"], source: batch_id}
        self._publish({"number": number, "committed": committed, "schema": schema, "runs": runs})
        return True

    def read(self) -> DataFrame | None:
        """One row per key as of the newest manifest, None before the first commit."""
        manifest = self.manifest()
        if not manifest["runs"]:
            return None
        return self.merge(self._rows(manifest["runs"], manifest["schema"])).drop("_commit")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove what none of the last ``keep`` manifests names; readers of older ones must be done."""
        names = [n for n in self._names(_LOG) if n.endswith(".json")]
        used = set()
        for name in names[-keep:]:
            system, path = self._path(f"{_LOG}/{name}")
            stream = system.open(path)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            used |= {run["path"].removeprefix("runs/") for run in json.loads(text)["runs"]}
        gone = [f"runs/{n}" for n in self._names("runs") if n not in used] + [f"{_LOG}/{n}" for n in names[:-keep]]
        for name in gone:
            system, path = self._path(name)
            system.delete(path, True)
        return gone
