"""Short codes for the vectors of behaviour profiles: a learned codebook for each part of a vector."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from runwarden.session import materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components are clipped to this before they are squared, so that sums of squares stay in 64 bits.
MOST = float(2**25)
#: Distinct parts that are handled side by side.
LEAVES = 4096
#: Distinct parts that a task holds.
CHUNK = 65_536
_BIAS = 1 << 31


def profile_vectors(counts: DataFrame, dimensions: int = 64) -> DataFrame:
    """One vector per image and window from the engine's token counts.

    ``counts``: ``image_digest, window, family, token, n`` (one or more rows per token; ``Behaviour.counts``
    has them).  Every token of a family goes to one dimension with a sign, both by its hash; the
    vector is the sum of the tokens' shares of the window's counts.  Returns ``profile_id``
    (hash of image and window), ``image_digest, window, vector`` (array of doubles).  Rows with a
    null or zero count, or a null token, add nothing; a window without any other row has no vector.
    """
    used = counts.where("token IS NOT NULL AND n > 0").groupBy("image_digest", "window", "family", "token").agg(F.sum("n").alias("n"))
    hashed = F.xxhash64("family", "token")
    signed = used.select(
        "image_digest", "window", F.pmod(hashed, F.lit(dimensions)).alias("at"),
        (F.col("n") * F.when(F.shiftright(hashed, 40).bitwiseAND(1) == 0, 1).otherwise(-1)).alias("signed"), "n",
    )
    placed = signed.groupBy("image_digest", "window", "at").agg(F.sum("signed").alias("signed"), F.sum("n").alias("n"))
    keyed = placed.groupBy("image_digest", "window").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "signed"))).alias("held"), F.sum("n").alias("total")
    )
    value = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda i: F.coalesce(F.try_element_at("held", i.cast("bigint")), F.lit(0)) / F.col("total"),
    )
    return keyed.select(F.xxhash64("image_digest", "window").alias("profile_id"), "image_digest", "window", value.alias("vector"))


def _parts_of(vectors: np.ndarray) -> np.ndarray:
    """(rows, parts, components) of scaled vectors; what is missing from the last part is 0."""
    width = -(-vectors.shape[1] // PARTS)
    padded = np.zeros((len(vectors), PARTS * width), dtype=np.int64)
    padded[:, : vectors.shape[1]] = vectors
    return padded.reshape(len(vectors), PARTS, width)


def _keys(parts: np.ndarray) -> np.ndarray:
    """Bytes of each part that sort like its components, first component first."""
    return np.ascontiguousarray((parts + _BIAS).astype(">u4"))


def _of_keys(keys: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u4").reshape(len(keys), width).astype(np.int64) - _BIAS


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of distinct parts in lexicographic order; ties to the lower entry.

    The parts are the leaves of a trie with one component per level.  The walk is depth first
    and carries, for the prefix it stands at, the distances to all entries over the
    components so far; a prefix that many parts share is met once.  Subtrees of at most
    ``LEAVES`` leaves, neighbours together, are finished level by level as arrays.
    """
    count, width = parts.shape
    near, distance = np.empty(count, dtype=np.int64), np.empty(count, dtype=np.int64)
    stack = [(0, count, 0, np.zeros(len(entries), dtype=np.int64))] if count else []
    while stack:
        low, high, depth, sums = stack.pop()
        if high - low <= LEAVES or depth == width:
            some = parts[low:high]
            opened = np.ones((high - low, max(width, 1)), dtype=bool)
            opened[1:, :width] = np.logical_or.accumulate(some[1:] != some[:-1], axis=1)
            carried, owner = sums[None, :], np.zeros(high - low, dtype=np.int64)
            for level in range(depth, width):
                at = np.flatnonzero(opened[:, level])
                carried = carried[owner[at]] + (some[at, level, None] - entries[None, :, level]) ** 2
                owner = np.cumsum(opened[:, level]) - 1
            best = carried.argmin(axis=1)
            near[low:high] = best[owner]
            distance[low:high] = carried[np.arange(len(best)), best][owner]
            continue
        column = parts[low:high, depth]
        heads = low + np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])
        tails = np.concatenate([heads[1:], [high]])
        children, start = [], None
        for head, tail in zip(heads.tolist(), tails.tolist(), strict=True):
            if start is not None and tail - start > LEAVES:
                children.append((start, head, depth, sums))
                start = None
            if tail - head > LEAVES:
                children.append((head, tail, depth + 1, sums + (parts[head, depth] - entries[:, depth]) ** 2))
            elif start is None:
                start = head
        if start is not None:
            children.append((start, high, depth, sums))
        stack.extend(reversed(children))
    return near, distance


def _by_length(batch: pa.RecordBatch):
    """(rows, matrix of scaled components) for each length of vector in a batch."""
    column = batch["vector"]
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.astype(np.int64).reshape(len(rows), length)


def _distinct_parts(kept: DataFrame) -> DataFrame:
    """(length, position, part, n), the distinct parts in lexicographic order within range partitions.

    Equal parts of a batch are counted before they move, so a part that a third of all vectors
    has stands once per batch.
    """

    def cut(batches):
        for batch in batches:
            for _, vectors in _by_length(batch):
                parts = _parts_of(vectors)
                width = parts.shape[2]
                for position in range(PARTS if width else 0):
                    keys = _keys(parts[:, position]).view(f"V{4 * width}").ravel()
                    keys, n = np.unique(keys, return_counts=True)
                    yield pa.record_batch(
                        {
                            "length": pa.array(np.full(len(keys), vectors.shape[1], np.int32)),
                            "position": pa.array(np.full(len(keys), position, np.int32)),
                            "part": pa.array([k.tobytes() for k in keys], pa.binary()),
                            "n": pa.array(n.astype(np.int64)),
                        }
                    )

    order = ["length", "position", "part"]
    parts = kept.select("vector").mapInArrow(cut, "length int, position int, part binary, n bigint")
    return parts.repartitionByRange(*order).groupBy(*order).agg(F.sum("n").alias("n")).sortWithinPartitions(*order)


def _chunks(batches):
    """(length, position, parts, n) of sorted rows, at most ``CHUNK`` at a time."""
    now, parts, counts = None, [], []

    def done():
        return (*now, _of_keys(parts, -(-now[0] // PARTS)), np.concatenate(counts))

    for batch in batches:
        if not batch.num_rows:
            continue
        length, position, n = (batch[c].to_numpy() for c in ("length", "position", "n"))
        keys = batch["part"].to_pylist()
        edges = np.flatnonzero((length[1:] != length[:-1]) | (position[1:] != position[:-1])) + 1
        bounds = [0, *edges.tolist(), len(keys)]
        for low, high in zip(bounds, bounds[1:]):
            here = int(length[low]), int(position[low])
            if parts and (here != now or len(parts) >= CHUNK):
                yield done()
                parts, counts = [], []
            now = here
            parts.extend(keys[low:high])
            counts.append(n[low:high])
    if parts:
        yield done()


def _first_books(kept: DataFrame, entries: int) -> dict[int, np.ndarray]:
    """Per length of vector the parts of the profiles with the smallest ids, (parts, entries, components)."""
    order = Window.partitionBy("length").orderBy("profile_id")
    narrow = kept.where("profile_id IS NOT NULL").select("length", "profile_id")
    ids = narrow.withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries).select("length", "profile_id").distinct()
    rows = kept.join(ids, ["length", "profile_id"], "left_semi").select("length", "profile_id", "vector")
    order = Window.partitionBy("length").orderBy("profile_id", "vector")
    chosen = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries)
    books: dict[int, list] = {}
    for row in chosen.orderBy("length", "place").collect():
        books.setdefault(row.length, []).append(row.vector)
    return {k: _parts_of(np.array(v, dtype=np.int64).reshape(len(v), k)).transpose(1, 0, 2) for k, v in books.items()}


def _next_books(parts: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """One round: every distinct part to its nearest entry, entries to the floor of their parts' mean."""

    def add_up(batches):
        for length, position, some, n in _chunks(batches):
            if length not in books:
                continue
            near, _ = nearest_entries(some, books[length][position])
            used = np.unique(near)
            sums = np.array([np.append(n[near == e] @ some[near == e], n[near == e].sum()) for e in used])
            size = sums.shape[1]
            yield pa.record_batch(
                {
                    "length": pa.array(np.full(sums.size, length, np.int32)),
                    "position": pa.array(np.full(sums.size, position, np.int32)),
                    "entry": pa.array(np.repeat(used, size).astype(np.int32)),
                    "component": pa.array(np.tile(np.arange(size, dtype=np.int32), len(used))),
                    "value": pa.array(sums.ravel().astype(np.int64)),
                }
            )

    found = parts.mapInArrow(add_up, "length int, position int, entry int, component int, value bigint")
    total = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    sums: dict[tuple, dict[int, int]] = {}
    # At most parts x entries x (components + 1) rows for each length of vector.
    for row in found.groupBy("length", "position", "entry", "component").agg(total).collect():
        sums.setdefault((row.length, row.position, row.entry), {})[row.component] = int(row.value)
    following = {k: v.copy() for k, v in books.items()}
    for (length, position, entry), values in sums.items():
        count = values.pop(max(values))
        following[length][position, entry] = [values[c] // count for c in range(len(values))]
    return following


def compress_profiles(profiles: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Codes of profile vectors: eight parts, each the number of its nearest codebook entry.

    ``profiles``: ``profile_id``, ``image_digest`` (any type), ``vector`` (array of numbers), as
    ``profile_vectors`` returns them.  Returns for every profile with a usable vector
    ``profile_id, image_digest, code`` (two hex digits per part), ``error`` (squared distance of the
    scaled vector to its entries), ``image_error`` (sum over the profiles of the image, null images
    together) and ``codebooks_sha256`` (of all entries' components, joined by commas).

    A component x becomes ``floor(scale * x)``.  Codebooks start with the profiles of the
    smallest ids and are refined in ``rounds`` rounds of nearest entry and floored mean; all
    numbers are integers, so any order of work gives the same codebooks.

    Method: the distinct parts of all vectors with their counts are range partitioned and sorted,
    which makes them the leaves of a trie in depth-first order.  Each round walks it
    (``nearest_entries``), and only sums per entry leave a task.  The vectors themselves are
    coded batch by batch with the same walk over the distinct parts of a batch, so no vector is
    shuffled.

    Defined cases: a vector that is null or holds a null or a non-finite number gives no row; an
    empty vector has code 00 everywhere and error 0; vectors of different lengths have their own
    codebooks, and a length that is no multiple of eight is filled up with zeros; fewer
    vectors than entries make fewer entries; a null id starts no entry, and vectors of a length
    where all ids are null get a null code and error; repeated rows count as often as they occur
    and the smaller vector of an id comes first; components beyond 2^25 after scaling are clipped;
    an empty table gives no rows; other columns are ignored.
    """
    value = F.col("vector").cast("array<double>")
    rows = profiles.select("profile_id", "image_digest", value.alias("vector")).where("vector IS NOT NULL")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(
        "vector", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(MOST)), F.lit(-MOST))).cast("bigint")
    )
    kept = rows.where(~bad).select("profile_id", "image_digest", scaled.alias("vector"), F.size("vector").alias("length"))
    parts = materialize(_distinct_parts(kept))
    books = _first_books(kept, entries)
    for _ in range(rounds):
        books = _next_books(parts, books)
    digests = {k: hashlib.sha256(",".join(map(str, b.ravel().tolist())).encode()).hexdigest() for k, b in books.items()}
    kinds = [to_arrow_type(kept.schema[c].dataType) for c in ("profile_id", "image_digest")]

    def code(batches):
        for batch in batches:
            for at, vectors in _by_length(batch):
                length, places = vectors.shape[1], pa.array(at)
                names = {c: batch[c].take(places).cast(k) for c, k in zip(("profile_id", "image_digest"), kinds, strict=True)}
                if length not in books:
                    codes, error = [None] * len(at), pa.nulls(len(at), pa.int64())
                else:
                    cut, width = _parts_of(vectors), -(-length // PARTS)
                    near, total = np.zeros((len(at), PARTS), dtype=np.uint8), np.zeros(len(at), dtype=np.int64)
                    for position in range(PARTS if width else 0):
                        keys = _keys(cut[:, position]).view(f"V{4 * width}").ravel()
                        _, first, leaf = np.unique(keys, return_index=True, return_inverse=True)
                        found, distance = nearest_entries(cut[first, position], books[length][position])
                        near[:, position] = found[leaf]
                        total += distance[leaf]
                    codes, error = [row.tobytes().hex() for row in near], pa.array(total)
                yield pa.record_batch(
                    names
                    | {
                        "code": pa.array(codes, pa.string()),
                        "error": error,
                        "codebooks_sha256": pa.array([digests.get(length)] * len(at), pa.string()),
                    }
                )

    image = kept.schema["image_digest"].dataType.simpleString()
    coded = materialize(
        kept.drop("length").mapInArrow(
            code,
            f"profile_id {kept.schema['profile_id'].dataType.simpleString()}, image_digest {image}, "
            "code string, error bigint, codebooks_sha256 string",
        )
    )
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint")
    images = coded.groupBy(F.col("image_digest").alias("image")).agg(total.alias("image_error"))
    return coded.join(images, F.col("image_digest").eqNullSafe(F.col("image"))).select(
        "profile_id", "image_digest", "code", "error", "image_error", "codebooks_sha256"
    )
