"""Exact Jaccard join of the word shingles of command lines, with set-relation skipping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runwarden.llm.components import connected_components
from runwarden.llm.text_blocks import blocks, mix, words_of
from runwarden.session import bound_batches, materialize

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
#: Frequent shingles that get a place of their own in the order of elements.  The order only
#: decides the work, never the links.
ORDERED_SHINGLES = 1 << 19
_FACTOR = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: pa.Array, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    words = words_of(texts)
    hashes, first = words.hashes(), words.first
    rolled = hashes[: max(len(hashes) - width + 1, 0)].copy()
    for step in range(1, width):
        rolled = rolled * _FACTOR + hashes[step : step + len(rolled)]
    rolled = mix(rolled)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= width:
            out.append(np.unique(rolled[low : high - width + 1]))
        elif high > low:
            value = np.uint64(high - low)
            with np.errstate(over="ignore"):
                for h in hashes[low:high]:
                    value = value * _FACTOR + h
            out.append(mix(np.array([value], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _frequencies(executions: DataFrame, width: int) -> DataFrame:
    """(element, texts) of shingles found in more than two texts; element: the upper 40 bits.

    Every block sends, for each range of elements, the sorted rests as packed 32-bit numbers.
    There are at least as many ranges as shuffle partitions, and one range is counted at a time.
    """
    spark = executions.sparkSession
    bits = max(8, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    ranges, width_bits = 1 << bits, 40 - bits

    def pack(batches):
        for block in blocks(batches, "command_line"):
            found = [s >> np.uint64(24) for s in shingle_sets(block.column("command_line"), width)]
            all_found = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            edges = np.arange(ranges + 1, dtype=np.uint64) << np.uint64(width_bits)
            cuts = np.searchsorted(all_found, edges)
            rests = (all_found & np.uint64((1 << width_bits) - 1)).astype(np.uint32)
            parts = [rests[cuts[i] : cuts[i + 1]].tobytes() for i in range(ranges)]
            yield pa.record_batch({"range": pa.array(range(ranges), pa.int32()), "rests": pa.array(parts, pa.binary())})

    def counted(key: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        keep = counts > 2
        elements = values[keep].astype(np.int64) + (key << width_bits)
        return pa.record_batch({"element": elements, "texts": counts[keep].astype(np.int64)})

    def count(batches):
        now, parts = None, []
        for batch in batches:
            for key, rests in zip(batch["range"].to_pylist(), batch["rests"], strict=True):
                if parts and key != now:
                    yield counted(now, parts)
                    parts = []
                now = key
                parts.append(np.frombuffer(rests.as_py(), dtype=np.uint32))
        if parts:
            yield counted(now, parts)

    packed = executions.select("command_line").mapInArrow(pack, "range int, rests binary")
    ranged = packed.repartition("range").sortWithinPartitions("range")
    return ranged.mapInArrow(count, "element bigint, texts bigint")


def frequent_shingles(executions: DataFrame, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent elements and their numbers of texts, at most ``most`` of them."""
    counted = materialize(_frequencies(executions, width))
    steps = counted.groupBy(F.floor(F.log2("texts") * 4).cast("int").alias("step")).agg(
        F.count(F.lit(1)).alias("n")
    )
    least, total = None, 0
    for row in sorted(steps.collect(), key=lambda r: -r["step"]):  # at most 4 x 64 steps
        total += row["n"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    chosen = counted.where(F.floor(F.log2("texts") * 4) >= least).toArrow()
    elements = chosen["element"].to_numpy().astype(np.uint64)
    order = np.argsort(elements)
    return elements[order], chosen["texts"].to_numpy()[order]


def _prefixes(executions: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """Set size, set fingerprint and index prefix of every text."""
    schema = executions.select("event_id").schema
    ddl = f"event_id {schema[0].dataType.simpleString()}, n int, rare int, f1 bigint, f2 bigint, prefix array<bigint>"
    shared = executions.sparkSession.sparkContext.broadcast(frequent)  # bounded by ORDERED_SHINGLES

    def ordered(found: np.ndarray, elements, texts) -> tuple[np.ndarray, int]:
        """Rare elements by hash, then frequent ones by rising frequency."""
        if not len(elements):
            return found, len(found)
        short = found >> np.uint64(24)
        place = np.minimum(np.searchsorted(elements, short), len(elements) - 1)
        hit = elements[place] == short
        rare, often = found[~hit], found[hit]
        return np.concatenate([rare, often[np.lexsort((often, texts[place[hit]]))]]), len(rare)

    def work(batches):
        elements, texts = shared.value
        for block in blocks(batches, "command_line"):
            sets = shingle_sets(block.column("command_line"), width)
            prefixes, rare, f1, f2 = [], [], [], []
            for found in sets:
                line, rest = ordered(found, elements, texts)
                size = len(line)
                take = size - (percent * size + 99) // 100 + 1 if size else 0
                prefixes.append(line[:take])
                rare.append(rest)
                f1.append(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                f2.append(mix(found + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
            ends = np.cumsum([0] + [len(p) for p in prefixes])
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            yield pa.record_batch(
                {
                    "event_id": block.column("event_id"),
                    "n": pa.array([len(s) for s in sets], pa.int32()),
                    "rare": pa.array(rare, pa.int32()),
                    "f1": np.array(f1, np.uint64).view(np.int64),
                    "f2": np.array(f2, np.uint64).view(np.int64),
                    "prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                }
            )

    return executions.mapInArrow(work, ddl)


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with the size of both sets and of what they share."""
    left = sets.select(F.col("event_id").alias("a"), F.col("elements").alias("in_a"))
    right = sets.select(F.col("event_id").alias("b"), F.col("elements").alias("in_b"))
    shared = F.size(F.array_intersect("in_a", "in_b"))
    joined = pairs.join(right, "b").join(left, "a")
    out = joined.select("a", "b", F.size("in_a").alias("n_a"), F.size("in_b").alias("n_b"), shared.alias("shared"))
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return materialize(out.withColumn("linked", 100 * F.col("shared") >= percent * union))


def _sets_of(executions: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the texts that some pair needs."""
    kind = executions.schema["event_id"].dataType.simpleString()

    def work(batches):
        for block in blocks(batches, "command_line"):
            sets = shingle_sets(block.column("command_line"), width)
            ends = np.cumsum([0] + [len(s) for s in sets])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.record_batch({"event_id": block.column("event_id"), "elements": lists})

    wanted = executions.join(ids, "event_id", "left_semi")
    single = wanted.groupBy("event_id").agg(F.min("command_line").alias("command_line"))
    return materialize(single.mapInArrow(work, f"event_id {kind}, elements array<bigint>"))


def near_duplicate_commands(
    executions: DataFrame,
    width: int = SHINGLE_WORDS,
    percent: int = SIMILARITY_PERCENT,
    ordered_shingles: int = ORDERED_SHINGLES,
) -> DataFrame:
    """Components of command lines whose shingle sets have a Jaccard similarity of ``percent``.

    ``executions``: ``event_id`` (any ordered type, identifies the text) and ``command_line``.
    Returns ``event_id, n_shingles, component_id`` for every row.

    A set is the distinct ``width``-word shingles of the lower-cased (A-Z) text, or the whole
    word sequence where it is shorter; elements are 64-bit hashes.  Equal sets are one class.
    Classes are indexed by the first elements in a global order, rare before frequent, so a
    passage that many texts share does not reach the index.  Then relations are used:

    * Index lists are blocks of (size, position); blocks whose sizes or positions leave too
      little to overlap are skipped.
    * Every set first meets one leader, the set of its lists with the fewest rare elements.  Sets
      that link to the same leader need not meet each other.
    * Across groups only leaders are compared.  For members x of h and z of g the answer follows
      from ``|h and g|``: it is at most ``|h and g| + |x not h| + |z not g|``.  Only member pairs
      that this bound leaves open, in groups not yet connected, are computed.

    So no link between different components is lost, and no group is expanded into all pairs.

    Defined cases: a null or blank text has an empty set, 0 shingles and its own id as
    component; a null id gives a null component; repeated rows are all returned, and of an id
    with several texts the smallest is compared; an empty table gives no rows; other columns
    are ignored.
    """
    bound_batches(executions.sparkSession)
    executions = executions.select("event_id", "command_line")
    frequent = frequent_shingles(executions, width, ordered_shingles)
    rows = materialize(_prefixes(executions, width, percent, frequent))

    classes = rows.where("n > 0").groupBy("n", "f1", "f2").agg(
        F.min("event_id").alias("event_id"),
        F.min_by("prefix", "event_id").alias("prefix"),
        F.min("rare").alias("rare"),
    ).where("event_id IS NOT NULL")
    postings = classes.select("event_id", "n", "rare", F.posexplode("prefix").alias("pos", "element"))
    length = F.count(F.lit(1)).over(Window.partitionBy("element"))
    lists = materialize(postings.withColumn("length", length).where("length > 1").drop("length"))

    def enough(n1, n2):
        """Least overlap of linked sets of these sizes, times (100 + percent)."""
        return percent * (n1 + n2)

    # Blocks by size; the leader of a block is its set with the fewest rare elements.
    block = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent)).cast("int")
    own = F.struct((F.col("rare") / F.col("n")).alias("r"), "event_id", "n", "pos")
    led = lists.withColumn("lead", F.min(own).over(Window.partitionBy("element", block)))
    reach = F.least(F.col("n") - F.col("pos"), F.col("lead.n") - F.col("lead.pos"))
    met = led.where(F.col("lead.event_id") != F.col("event_id")).where(
        (100 + percent) * reach >= enough(F.col("n"), F.col("lead.n"))
    )
    votes = met.groupBy(F.col("event_id").alias("a"), F.col("lead.event_id").alias("b")).count()
    star = materialize(votes.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b")))

    known = lists.groupBy("event_id").agg(F.max("n").alias("n"))
    sets = _sets_of(executions, known.select("event_id"), width)
    starred = _overlaps(star, sets, percent)
    links = starred.where("linked").select("a", "b")
    reached = connected_components(links, "a", "b")

    inside = starred.where("linked").select(
        F.col("a").alias("event_id"), F.col("b").alias("leader"), (F.col("n_a") - F.col("shared")).alias("extra")
    )
    members = known.join(inside, "event_id", "left").join(
        reached.withColumnRenamed("node", "event_id"), "event_id", "left"
    )
    members = materialize(
        members.select(
            "event_id", "n",
            F.coalesce("leader", "event_id").alias("leader"),
            F.coalesce("extra", F.lit(0)).alias("extra"),
            F.coalesce("component", "event_id").alias("component"),
        )
    )

    # Lists of leaders, each with the sizes and the farthest reach of its members there.
    grouped = lists.drop("n").join(members, "event_id").groupBy("element", "leader", "component").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("reach")
    )
    several = F.min("component").over(Window.partitionBy("element")) != F.max("component").over(
        Window.partitionBy("element")
    )
    grouped = materialize(grouped.withColumn("several", several).where("several").drop("several"))
    p, q = grouped.alias("p"), grouped.alias("q")
    across = p.join(
        q,
        (F.col("p.element") == F.col("q.element"))
        & (F.col("p.leader") < F.col("q.leader"))
        & (F.col("p.component") != F.col("q.component"))
        & (100 * F.col("p.high") >= percent * F.col("q.low"))
        & (100 * F.col("q.high") >= percent * F.col("p.low"))
        & ((100 + percent) * F.least("p.reach", "q.reach") >= enough(F.col("p.low"), F.col("q.low"))),
    ).select(F.col("p.leader").alias("a"), F.col("q.leader").alias("b")).distinct()
    led_pairs = _overlaps(across, sets, percent)
    links = links.unionByName(led_pairs.where("linked").select("a", "b"))
    reached = connected_components(links, "a", "b")

    now = reached.select(F.col("node").alias("event_id"), F.col("component").alias("now"))
    members = members.join(now, "event_id", "left").withColumn("component", F.coalesce("now", "component"))
    fields = ("event_id", "n", "leader", "extra", "component")
    x = members.select(*[F.col(c).alias(f"x_{c}") for c in fields])
    z = members.select(*[F.col(c).alias(f"z_{c}") for c in fields])
    open_pairs = (
        led_pairs.where("NOT linked")
        .join(x, F.col("a") == F.col("x_leader"))
        .join(z, F.col("b") == F.col("z_leader"))
        .where("x_component <> z_component AND NOT (x_event_id = a AND z_event_id = b)")
        .where((100 + percent) * (F.col("shared") + F.col("x_extra") + F.col("z_extra")) >= enough(F.col("x_n"), F.col("z_n")))
        .where((100 * F.col("x_n") >= percent * F.col("z_n")) & (100 * F.col("z_n") >= percent * F.col("x_n")))
        .select(F.col("x_event_id").alias("a"), F.col("z_event_id").alias("b"))
        .distinct()
    )
    last = _overlaps(open_pairs, sets, percent).where("linked").select("a", "b")
    final = connected_components(links.unionByName(last), "a", "b")

    # Copies take the component of their class; map-side minima make this safe for large classes.
    heads = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("event_id").alias("head"))
    heads = heads.join(final.withColumnRenamed("node", "head"), "head", "left").select(
        "n", "f1", "f2", F.coalesce("component", "head").alias("component")
    )
    out = rows.select("event_id", "n", "f1", "f2").join(heads, ["n", "f1", "f2"], "left")
    component = F.when(F.col("event_id").isNotNull(), F.coalesce("component", "event_id"))
    return out.select("event_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"))
