"""Near-equal behaviour profiles of an image by balls of vectors and NN-descent between the balls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runwarden.llm.components import connected_components
from runwarden.session import materialize

COSINE = 0.93
NEIGHBOURS = 8
TABLES = 8
#: Most rounds of neighbours of neighbours; they end when few lists change.
ROUNDS = 8
#: Neighbours of one node, nearest first, that are compared with each other at once.
LOCAL = 256
#: Nodes whose neighbours are searched for exactly, half of them by chance, half among nodes with links.
AUDIT_NODES = 4096
#: Rows that are compared with the audited nodes at once.
SLICE = 256
#: Images with a smaller audited share of their true neighbours are completed exactly.
AUDIT_RECALL = 0.98
#: Mean number of vectors of a block of the exact completion; two blocks are compared in one matrix product.
BLOCK = 1024
#: Angles are compared with this slack where the vectors themselves are compared afterwards.
SLACK = 1e-7
_LINK = ["a", "b", "cosine"]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _groups(batches, keys: list[str], most: int | None):
    """Rows of sorted batches with equal keys, in pieces of at most ``most`` rows if it is given."""
    held: list[pa.RecordBatch] = []

    def joined():
        return pa.Table.from_batches(held).combine_chunks()

    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(starts, starts[1:]):
            key = tuple(c[low] for c in columns)
            if held and key != now:
                yield joined()
                held = []
            now = key
            while low < high:
                room = most - sum(h.num_rows for h in held) if most else high - low
                held.append(batch.slice(low, min(room, high - low)))
                low += min(room, high - low)
                if most and sum(h.num_rows for h in held) >= most:
                    yield joined()
                    held = []
    if held:
        yield joined()


def _links(a, b, cosine) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(cosine, pa.float64())})


_LINK_DDL = "a bigint, b bigint, cosine double"


def _first_graph(nodes: DataFrame, count: int, seed: int) -> DataFrame:
    """Pairs with their cosine that stand close together in several random orders of the nodes.

    An order sorts by the signs of random projections and then by one projection.  Rows are
    range partitioned on the whole sort key, so a crowded place is cut like any other.
    """
    bits = int(np.clip(np.log2(max(count, 2) / 8), 1, 40))

    def place(batches):
        for batch in batches:
            unit = _unit(_matrix(batch["vector"]))
            rng = np.random.default_rng([seed, unit.shape[1]])
            for table in range(TABLES):
                planes = rng.standard_normal((unit.shape[1], bits + 1))
                side = unit @ planes
                code = (side[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.record_batch(
                    {
                        "part": batch["part"], "turn": pa.array(np.full(len(code), table, np.int32)),
                        "code": pa.array(code), "side": pa.array(side[:, bits]), "node": batch["node"], "vector": batch["vector"],
                    }
                )

    def sweep(batches):
        for rows in _groups(batches, ["part", "turn"], 4096):
            node, unit = rows["node"].to_numpy(), _unit(_matrix(rows["vector"].combine_chunks()))
            for step in range(1, NEIGHBOURS + 1):
                if len(node) > step:
                    yield _links(node[:-step], node[step:], (unit[:-step] * unit[step:]).sum(axis=1))

    order = ["part", "turn", "code", "side", "node"]
    placed = nodes.mapInArrow(place, "part bigint, turn int, code bigint, side double, node bigint, vector array<double>")
    swept = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sweep, _LINK_DDL)
    return swept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def _both(links: DataFrame, *more: str) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine", *more)
    return links.select(*_LINK, *more).unionByName(turned)


def _cosines(pairs: DataFrame) -> DataFrame:
    """``a, b, cosine`` of rows with both vectors."""

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x, z = _unit(_matrix(batch["vector_x"])), _unit(_matrix(batch["vector_z"]))
                yield _links(batch["a"], batch["b"], (x * z).sum(axis=1))

    # One length of vectors at a time, as a batch is handled as a matrix.
    sized = pairs.select("a", "b", "vector_x", "vector_z")

    def by_length(batches):
        for batch in batches:
            lengths = batch["vector_x"].value_lengths().to_numpy()
            for length in np.unique(lengths):
                yield batch.filter(pa.array(lengths == length))

    return sized.mapInArrow(lambda batches: work(by_length(batches)), _LINK_DDL)


def _balls(nodes: DataFrame, tight: float) -> DataFrame:
    """Adds ``leader`` and the ``cosine`` to it; members are within ``tight``, half a link's angle.

    Any two members of a ball are linked, by the triangle inequality of angles.  Nodes that are
    connected by such close pairs have one candidate, the one closest to those next to it.
    """
    close = _first_graph(nodes, nodes.count(), 1_000).where(F.col("cosine") >= tight)
    close = materialize(close.groupBy("a", "b").agg(F.max("cosine").alias("cosine")))
    group = connected_components(close, "a", "b")
    central = _both(close).groupBy(F.col("a").alias("node")).agg(F.avg("cosine").alias("mean"))
    chosen = group.join(central, "node").groupBy("component").agg(F.max_by("node", F.struct("mean", "node")).alias("leader"))
    asked = group.join(chosen, "component").where("node <> leader").select("node", "leader")
    x = nodes.select("node", F.col("vector").alias("vector_x"))
    z = nodes.select(F.col("node").alias("leader"), F.col("vector").alias("vector_z"))
    met = asked.join(z, "leader").join(x, "node").select(F.col("node").alias("a"), F.col("leader").alias("b"), "vector_x", "vector_z")
    inside = _cosines(met).where(F.col("cosine") >= tight).select(F.col("a").alias("node"), F.col("b").alias("leader"), "cosine")
    out = nodes.join(inside, "node", "left")
    return materialize(
        out.withColumn("leader", F.coalesce("leader", "node")).withColumn("cosine", F.coalesce("cosine", F.lit(1.0)))
    )


def _with_reach(links: DataFrame, nodes: DataFrame, angle: float) -> DataFrame:
    """Adds ``reach``: the balls of two nodes may hold members that link."""
    left = nodes.select(F.col("node").alias("a"), F.col("radius").alias("_ra"))
    right = nodes.select(F.col("node").alias("b"), F.col("radius").alias("_rb"))
    apart = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0)))
    reach = apart <= F.lit(angle + SLACK) + F.col("_ra") + F.col("_rb")
    return links.join(left, "a").join(right, "b").select(*_LINK, reach.alias("reach"))


def _nearest(links: DataFrame, widths: DataFrame | None, most: int) -> DataFrame:
    """Each node's nearest neighbours, as many as its width; ``most`` is the largest width."""
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    ranked = links.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    if widths is not None:
        ranked = ranked.join(widths, "a", "left").where(F.col("rank") <= F.coalesce("width", F.lit(NEIGHBOURS))).drop("width")
    return ranked.drop("rank")


def _local_join(graph: DataFrame, nodes: DataFrame, angle: float) -> DataFrame:
    """Pairs of neighbours of one node, at least one of them new to it, that improve a list or reach.

    Neighbours are those in the node's list and the nodes that have it in theirs.  A long row of
    them is compared in pieces; what that misses, the audit sees.
    """
    forward = graph.select(F.col("a").alias("centre"), F.col("b").alias("node"), "cosine", "fresh")
    back = graph.select(F.col("b").alias("centre"), F.col("a").alias("node"), "cosine", "fresh")
    members = forward.unionByName(back).groupBy("centre", "node").agg(F.max("cosine").alias("cosine"), F.max("fresh").alias("fresh"))
    active = members.groupBy("centre").agg(F.max("fresh").alias("any")).where("any").select("centre")
    full = F.count(F.lit(1)) >= NEIGHBOURS
    worst = graph.groupBy(F.col("a").alias("node")).agg(F.when(full, F.min("cosine")).otherwise(-2.0).alias("worst"))
    known = nodes.select("node", "radius", "vector").join(worst, "node", "left")
    rows = members.join(active, "centre", "left_semi").join(known, "node")

    def compare(batches):
        for group in _groups(batches, ["centre"], LOCAL):
            node, fresh = group["node"].to_numpy(), group["fresh"].to_numpy(zero_copy_only=False).astype(bool)
            if len(node) < 2 or not fresh.any():
                continue
            unit, radius = _unit(_matrix(group["vector"].combine_chunks())), group["radius"].to_numpy()
            worst = np.nan_to_num(group["worst"].to_numpy(zero_copy_only=False).astype(np.float64), nan=-2.0)
            x, y = np.triu_indices(len(node), 1)
            keep = fresh[x] | fresh[y]
            x, y = x[keep], y[keep]
            cosine = (unit[x] * unit[y]).sum(axis=1)
            reach = np.arccos(np.clip(cosine, -1, 1)) <= angle + radius[x] + radius[y] + SLACK
            use = reach | (cosine > worst[x]) | (cosine > worst[y])
            x, y = x[use], y[use]
            yield pa.record_batch(
                {
                    "a": pa.array(np.minimum(node[x], node[y]), pa.int64()), "b": pa.array(np.maximum(node[x], node[y]), pa.int64()),
                    "cosine": pa.array(cosine[use]), "reach": pa.array(reach[use]),
                }
            )

    ordered = rows.repartition("centre").sortWithinPartitions("centre", F.desc("cosine"), "node")
    columns = ordered.select("centre", "node", "fresh", "radius", "worst", "vector")
    return columns.mapInArrow(compare, f"{_LINK_DDL}, reach boolean").groupBy("a", "b").agg(
        F.max("cosine").alias("cosine"), F.max("reach").alias("reach")
    )


def _descend(nodes: DataFrame, count: int, angle: float) -> DataFrame:
    """NN-descent: pairs of nodes found to reach each other, ``a, b, cosine``.

    Lists start with the neighbours in several random orders.  A round compares the neighbours of
    every node with each other and keeps each node's nearest; a node whose list is full of
    neighbours that reach is saturated, and its list is doubled.  Every pair that any round finds
    to reach is kept, in a list or not.
    """
    seeds = _first_graph(nodes, count, 0).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    seeds = materialize(_with_reach(seeds, nodes, angle))
    kept = seeds.where("reach").select(*_LINK)
    graph = materialize(_nearest(_both(seeds, "reach").withColumn("fresh", F.lit(True)), None, NEIGHBOURS))
    for _ in range(ROUNDS):
        found = materialize(_local_join(graph, nodes, angle))
        kept = materialize(kept.unionByName(found.where("reach").select(*_LINK)).groupBy("a", "b").agg(F.max("cosine").alias("cosine")))
        full = graph.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("all"))
        widths = materialize(full.where(F.col("all") & (F.col("n") >= NEIGHBOURS)).select("a", (F.col("n") * 2).alias("width")))
        most = widths.agg(F.max("width")).first()[0] or NEIGHBOURS
        old = graph.withColumn("fresh", F.lit(False))
        merged = _both(found, "reach").withColumn("fresh", F.lit(True)).unionByName(old).groupBy("a", "b")
        merged = merged.agg(F.max("cosine").alias("cosine"), F.max("reach").alias("reach"), F.min("fresh").alias("fresh"))
        graph = materialize(_nearest(merged, widths, most))
        if graph.where("fresh").count() <= 0.001 * NEIGHBOURS * count:
            break
    return kept


def _audit(nodes: DataFrame, count: int, pairs: DataFrame, angle: float) -> tuple[DataFrame, list[int]]:
    """(true pairs of the audited nodes, parts whose recall is too low).

    A part without a true pair of an audited node is judged by all parts together.
    """
    linked = _both(pairs).select(F.col("a").alias("node")).distinct()
    some = linked.count()

    def chosen(rows: DataFrame, size: int, seed: int) -> DataFrame:
        share = int(2**32 * min(1.0, AUDIT_NODES / 2 / max(size, 1)))
        return rows.where(F.shiftrightunsigned(F.xxhash64("node", F.lit(seed)), 32) < F.lit(share)).select("node")

    picked = chosen(linked, some, 1).unionByName(chosen(nodes, count, 2)).distinct()
    # About AUDIT_NODES rows, whatever the table's size.
    sample = nodes.join(materialize(picked), "node").select("part", "node", "radius", "vector").toArrow()
    wanted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    parts = sample["part"].to_numpy()
    for part in np.unique(parts):
        rows = sample.take(pa.array(np.flatnonzero(parts == part)))
        wanted[int(part)] = (rows["node"].to_numpy(), rows["radius"].to_numpy(), _unit(_matrix(rows["vector"].combine_chunks())))
    shared = nodes.sparkSession.sparkContext.broadcast(wanted)

    def scan(batches):
        for batch in batches:
            here = batch["part"].to_numpy()
            for part in np.unique(here).tolist():
                if part not in shared.value:
                    continue
                probe, wide, unit = shared.value[part]
                rows = np.flatnonzero(here == part)
                for start in range(0, len(rows), SLICE):
                    at = rows[start : start + SLICE]
                    node, radius = batch["node"].to_numpy()[at], batch["radius"].to_numpy()[at]
                    cosine = unit @ _unit(_matrix(batch["vector"].take(pa.array(at)))).T
                    reach = np.minimum(angle + wide[:, None] + radius + SLACK, np.pi)
                    x, y = np.nonzero(cosine >= np.cos(reach))
                    other = probe[x] != node[y]
                    x, y = x[other], y[other]
                    yield pa.record_batch(
                        {
                            "part": pa.array(np.full(len(x), part)), "a": pa.array(np.minimum(probe[x], node[y])),
                            "b": pa.array(np.maximum(probe[x], node[y])), "cosine": pa.array(cosine[x, y]),
                        }
                    )

    true = nodes.select("part", "node", "radius", "vector").mapInArrow(scan, f"part bigint, {_LINK_DDL}")
    true = materialize(true.groupBy("part", "a", "b").agg(F.max("cosine").alias("cosine")))
    hit = pairs.select("a", "b").withColumn("_hit", F.lit(1))
    judged = true.join(hit, ["a", "b"], "left").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("k"))
    counts = {r.part: (r.k or 0, r.n) for r in judged.collect()}  # at most one row per audited part
    low = [part for part, (k, n) in counts.items() if k < AUDIT_RECALL * n]
    if sum(k for k, _ in counts.values()) < AUDIT_RECALL * sum(n for _, n in counts.values()):
        low += [r.part for r in nodes.select("part").distinct().collect() if r.part not in counts]
    return true.select(*_LINK), low


def _search(nodes: DataFrame, angle: float) -> DataFrame:
    """The exact completion: all pairs of nodes whose balls may hold linked members.

    The nodes of an image are dealt into blocks by hash.  Each row goes to all pairs of blocks
    that its own is in, and a pair of blocks is compared at once.
    """
    sizes = nodes.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = nodes.join(sizes, "part").withColumn("own", F.pmod(F.xxhash64("node", "vector_key"), "blocks"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = met.select(
        "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "radius", "vector"
    )

    def compare(batches):
        for group in _groups(batches, ["part", "low", "high"], None):
            node, radius, own = (group[c].to_numpy() for c in ("node", "radius", "own"))
            unit, first = _unit(_matrix(group["vector"].combine_chunks())), own == group["low"].to_numpy()
            inside = first.all() and group["low"][0] == group["high"][0]
            left, right = (np.arange(len(node)),) * 2 if inside else (np.flatnonzero(first), np.flatnonzero(~first))
            for start in range(0, len(left), BLOCK):
                at = left[start : start + BLOCK]
                reach = np.minimum(angle + radius[at, None] + radius[right] + SLACK, np.pi)
                x, y = np.nonzero(unit[at] @ unit[right].T >= np.cos(reach) - SLACK)
                x, y = at[x], right[y]
                keep = (x < y) & (node[x] != node[y]) if inside else node[x] != node[y]
                x, y = x[keep], y[keep]
                yield _links(np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), (unit[x] * unit[y]).sum(axis=1))

    keys = ["part", "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, _LINK_DDL)


def near_profiles(profiles: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Groups of behaviour profiles of one image whose vectors have a cosine of at least ``cosine``.

    ``profiles``: ``profile_id`` (long), ``image_digest`` (any type), ``vector`` (array of numbers).
    Returns ``profile_id, n_links`` (other profiles linked directly), ``component_id`` (smallest
    profile reachable) and ``kept`` (it is that one) for every row.

    Method: equal vectors of an image are one node.  Nodes within half a link's angle of a leader
    form a ball; all of them are linked with each other, which is counted and not expanded.
    NN-descent (``_descend``) then finds the pairs of leaders whose balls reach each other.  An audit
    searches exactly for the neighbours of up to ``AUDIT_NODES`` leaders, half of them leaders
    with links; what it finds is added.  Images whose audited recall is below ``AUDIT_RECALL`` are
    completed by comparing all their leaders in blocks, whose work grows with the square of
    their number.  For a pair of balls the angle of the leaders and the radii tell whether all or
    no members are linked; only in between members are compared.

    Cosines are computed in double precision from scaled vectors, so none below the threshold
    is linked.  Links are symmetric; copies of a node are linked with each other and with all its
    neighbours, and counted without being expanded.

    Defined cases: a vector that is null, empty, zero, or holds a null or a non-finite number
    links with nothing, as does a null image; vectors of different lengths are never linked;
    repeated rows are copies; a null id is never the smallest and gets a null component; an
    empty table gives no rows; other columns are ignored.
    """
    rows = profiles.select("profile_id", "image_digest", F.col("vector").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    usable = F.col("image_digest").isNotNull() & F.coalesce(~bad & some, F.lit(False))
    # -0.0 and 0.0 are one value.
    same = F.transform("vector", lambda x: x + F.lit(0.0))
    part = F.xxhash64("image_digest", F.size("vector"))
    marked = rows.where(usable).select("profile_id", part.alias("part"), same.alias("vector"))
    key = F.xxhash64("vector").alias("vector_key")
    # The vector itself is compared, the hash only spreads it.
    nodes = materialize(
        marked.withColumn("vector_key", key)
        .groupBy("part", "vector_key", "vector")
        .agg(F.min("profile_id").alias("node"), F.count(F.lit(1)).alias("copies"))
        .where("node IS NOT NULL")
    )
    angle = float(np.arccos(cosine))
    balls = _balls(nodes, float(np.cos(angle / 2)))
    grouped = balls.groupBy(F.col("leader").alias("node")).agg(
        F.sum("copies").alias("total"), F.max(F.acos(F.least("cosine", F.lit(1.0)))).alias("radius")
    )
    leaders = materialize(nodes.drop("copies").join(grouped, "node"))
    count = leaders.count()
    found = _descend(leaders, count, angle)
    true, low = _audit(leaders, count, found, angle)
    found = found.unionByName(true)
    if low:
        found = found.unionByName(_search(leaders.where(F.col("part").isin(low)), angle))
    pairs = materialize(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")))

    # From pairs of leaders to links of their members.
    left = leaders.select(F.col("node").alias("a"), F.col("total").alias("total_a"), F.col("radius").alias("radius_a"))
    right = leaders.select(F.col("node").alias("b"), F.col("total").alias("total_b"), F.col("radius").alias("radius_b"))
    apart = F.acos(F.least("cosine", F.lit(1.0)))
    spread = F.col("radius_a") + F.col("radius_b")
    judged = materialize(
        pairs.join(left, "a").join(right, "b")
        .withColumn("all", F.when(spread == 0, F.col("cosine") >= cosine).otherwise(apart + spread <= angle - SLACK))
        .where(F.col("all") | ((spread > 0) & (apart - spread <= angle + SLACK)))
    )
    whole = judged.where("all")
    some_of = judged.where("NOT all").select("a", "b")
    x = balls.select(F.col("leader").alias("a"), F.col("node").alias("x"), F.col("vector").alias("vector_x"))
    z = balls.select(F.col("leader").alias("b"), F.col("node").alias("z"), F.col("vector").alias("vector_z"))
    single = materialize(
        _cosines(some_of.join(x, "a").join(z, "b").select(F.col("x").alias("a"), F.col("z").alias("b"), "vector_x", "vector_z"))
        .where(F.col("cosine") >= cosine)
    )

    per_leader = whole.select(F.col("a").alias("leader"), F.col("total_b").alias("more")).unionByName(
        whole.select(F.col("b").alias("leader"), F.col("total_a").alias("more"))
    ).groupBy("leader").agg(F.sum("more").alias("more"))
    copies = balls.select(F.col("node").alias("b"), F.col("copies").alias("others"))
    per_node = _both(single).join(copies, "b").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("near"))
    links = (
        whole.select("a", "b")
        .unionByName(single.select("a", "b"))
        .unionByName(balls.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))
    )
    reached = connected_components(links, "a", "b")
    totals = leaders.select(F.col("node").alias("leader"), "total")
    heads = balls.join(totals, "leader").join(per_leader, "leader", "left").join(per_node, "node", "left")
    heads = heads.join(reached, "node", "left").select(
        "part", "vector_key", "vector",
        (F.col("total") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("near", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component"),
    )
    plain = rows.select(
        "profile_id",
        F.when(usable, part).alias("part"),
        F.when(usable, F.xxhash64(same)).alias("vector_key"),
        F.when(usable, same).alias("vector"),
    )
    out = plain.join(materialize(heads), ["part", "vector_key", "vector"], "left")
    component = F.when(F.col("profile_id").isNotNull(), F.coalesce("component", "profile_id"))
    return out.select(
        "profile_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("profile_id"), F.lit(False)).alias("kept"),
    )
