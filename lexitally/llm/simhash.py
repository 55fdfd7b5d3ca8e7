"""SimHash near-duplicates, with vantage-point trees for the pairs.

1. Each whole text gets a 64-bit fingerprint: A-Z lower-cased, words, shingles, XXH64, majority of bits.
2. Equal fingerprints become one point. A vantage-point tree is built from a bounded sample of
   points and only cuts the space into shards; every point is sent through it. At a node with
   vantage point v and radius mu, points with d(p, v) <= mu go inside, points with
   d(p, v) > mu - r go outside. So a pair within r bits meets in a shard, by the triangle
   inequality: if a is inside and b isn't, d(a, v) >= d(b, v) - r > mu - r and a goes outside too.
3. A shard with more points than a task should compare gets a tree of its own, from a sample of its own,
   built by a task. What is still too large (a dense ball, which no tree cuts) is compared in tiles, pairs of
   blocks of it.
4. A task finds its shard's linked points and returns its connected groups, not the pairs.
5. Groups that share a point are linked; large-star and small-star rounds over these links, each
   written to the shared folder, give the components.

Cost: with n distinct fingerprints the copies at shard borders make up about n ** 0.3 rows a point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import Batches, join_counted, named, utf8
from lexitally.sources.workdir import written

#: Fixed by the definition of the fingerprint.
SEED, BITS = 42, 64
#: Points that a shard should have, and the number from which it is cut into tiles.
SHARD, TILE = 2048, 8192
#: Points that the tree is built from: a few for each shard, within these bounds (give or take a half). They
#: bound the tree, not the points that it is used on.
SAMPLE_A_SHARD, LEAST_SAMPLE, LARGEST_SAMPLE = 16, 1 << 14, 1 << 19
#: Shingles whose bits are counted at a time, and points of a large shard that a task sends through its tree.
CHUNK = 1 << 15
_NODE = np.dtype([("vantage", "<u8"), ("mu", "<i4"), ("inside", "<i4"), ("outside", "<i4")])
_NO_POINTS = pa.table({n: pa.array([], pa.int64()) for n in ("shard", "fp", "first_id", "sub")})


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer; a text without words has 0.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` (just what ``bytes.split`` gives). Fewer words than a
    shingle: the whole sequence is the one shingle. Repeated shingles count again.
    """
    words = text.lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, last, CHUNK):
        digests = b"".join([xxhash.xxh64_digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(last, at + CHUNK))])
        votes += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > last).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id long, fp long`` for each row; null text counts as empty."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    slim = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, total: int, radius: int, shard: int = SHARD, tries: int = 24) -> list[tuple]:
    """Nodes ``(vantage, mu, inside, outside)``; a child below 0 is shard ``-child - 1``.

    The vantage point and the radius are those, of some tried, that leave the fewest pairs to
    compare. A part that no cut makes much cheaper (a dense ball) stays one shard.
    """
    nodes: list[tuple] = []
    rng = np.random.default_rng(SEED)
    least = max(SAMPLE_A_SHARD, int(len(sample) * shard / max(total, 1)))
    shards = 0

    def leaf() -> int:
        nonlocal shards
        shards += 1
        return -shards

    def grow(points: np.ndarray) -> int:
        if len(points) <= least:
            return leaf()
        best = (0.9, None, 0)
        for v in points[rng.choice(len(points), min(tries, len(points)), replace=False)]:
            d = distance(points, v).astype(np.int64)
            upto = np.cumsum(np.bincount(d, minlength=BITS + 1)) / len(points)  # share within each radius
            for mu in range(BITS):
                inside, outside = upto[mu], 1 - (upto[mu - radius] if mu >= radius else 0)
                cost = inside * inside + outside * outside
                if cost < best[0] and 0 < inside < 1:
                    best = (cost, v, mu)
        cost, v, mu = best
        if v is None:
            return leaf()
        d = distance(points, v).astype(np.int64)
        at = len(nodes)
        nodes.append(())
        nodes[at] = (int(v), mu, grow(points[d <= mu]), grow(points[d > mu - radius]))
        return at

    grow(sample)
    return nodes


def route(nodes: list[tuple], points: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """``(shard, positions of its points)`` for every shard that one of the points belongs to."""
    out, todo = [], [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node < 0:
            out.append((-node - 1, at))
            continue
        v, mu, inside, outside = nodes[node]
        d = distance(points[at], np.uint64(v)).astype(np.int64)
        todo += [(inside, at[d <= mu]), (outside, at[d > mu - radius])]
    return out


def groups_within(points: np.ndarray, radius: int, rows: int = 256) -> np.ndarray:
    """For each point the position of its group's first point; groups are joined by links of at most ``radius``."""
    root = np.arange(len(points))
    for at in range(0, len(points), rows):
        near = distance(points[at : at + rows, None], points[None, at:]) <= radius
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            roots = np.unique(root[at + np.flatnonzero(near[i])])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    return root


def _shards(points: DataFrame, nodes: list[tuple], radius: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, at in route(nodes, fps, radius):
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int64)), part.column(0), part.column(1)], names=["shard", "fp", "first_id"])

    return points.select("fp", "first_id").mapInArrow(run, "shard long, fp long, first_id long")


def _resharded(routed: DataFrame, radius: int, shard: int, tile: int) -> DataFrame:
    """``routed`` with ``sub``: shards of more than ``tile`` points are cut again, each by its own tree.

    The first tree bounds the number of shards, so their table can be broadcast. Large shards are sent
    through their trees in chunks; a task sees a chunk, or a sample, never a whole shard.
    """
    sizes = written(routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile), "large-shards")
    if sizes.isEmpty():
        return routed.withColumn("sub", F.lit(0).cast("long"))
    large = routed.join(F.broadcast(sizes), "shard")

    def plant(key: tuple, table: pa.Table) -> pa.Table:
        nodes = build_tree(np.sort(table.column("fp").to_numpy()).view(np.uint64), table.column("n")[0].as_py(), radius, shard)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([np.array(nodes, _NODE).tobytes()], pa.binary())})

    def send(table: pa.Table, trees: pa.Table) -> pa.Table:
        nodes = np.frombuffer(trees.column("tree")[0].as_py(), _NODE).tolist()
        points = table.column("fp").to_numpy().view(np.uint64)
        parts = [table.take(pa.array(at)).append_column("sub", pa.array(np.full(len(at), sub, np.int64))) for sub, at in route(nodes, points, radius)]
        return pa.concat_tables(parts).select(["shard", "fp", "first_id", "sub"])

    sample = large.where(F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), F.floor(F.col("n") / LEAST_SAMPLE)).cast("long")) == 0)
    trees = written(sample.groupBy("shard").applyInArrow(plant, "shard long, tree binary"), "shard-trees")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rows = large.select("shard", "fp", "first_id", F.pmod(F.xxhash64(F.lit(1), "fp"), chunks).cast("int").alias("chunk"))
    copies = trees.join(F.broadcast(sizes), "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    sent = rows.groupBy("shard", "chunk").cogroup(copies.groupBy("shard", "chunk")).applyInArrow(lambda x, y: send(x, y) if len(x) else _NO_POINTS, "shard long, fp long, first_id long, sub long")
    small = routed.join(F.broadcast(sizes.select("shard")), "shard", "left_anti").withColumn("sub", F.lit(0).cast("long"))
    return small.unionByName(sent)


def _tiles(routed: DataFrame, tile: int) -> DataFrame:
    """Cuts shards that are still large into blocks; each pair of blocks is a tile."""
    keys = ["shard", "sub"]
    large = routed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > tile)
    large = written(large.select(*keys, F.ceil(F.col("__n") / (tile // 2)).cast("int").alias("__blocks")), "tiled-shards")
    block = F.pmod(F.xxhash64("fp"), F.col("__blocks")).cast("int")
    other = F.explode(F.when(F.col("__blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    # the table is written, so Spark knows its size and only broadcasts it below its limit
    placed = routed.join(large, keys, "left").withColumn("__own", F.coalesce(block, F.lit(0))).withColumn("__other", other)
    return placed.select(*keys, F.least("__own", "__other").alias("i"), F.greatest("__own", "__other").alias("j"), "fp", "first_id")


def _groups(tiles: DataFrame, radius: int) -> DataFrame:
    """One row ``grp, members, first_id`` for each connected group of at least two points in a tile."""
    schema = pa.schema([("grp", pa.string()), ("members", pa.list_(pa.int64())), ("first_id", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        signed = table.column("fp").to_numpy()
        root = groups_within(signed.view(np.uint64), radius)
        order = np.argsort(root, kind="stable")
        heads, starts, sizes = np.unique(root[order], return_index=True, return_counts=True)
        ids, name = table.column("first_id"), ":".join(str(k.as_py()) for k in key)
        rows: dict[str, list] = {"grp": [], "members": [], "first_id": []}
        for head, start, size in zip(heads, starts, sizes, strict=True):
            if size > 1:
                at = order[start : start + size]
                known = [x for x in ids.take(pa.array(at)).to_pylist() if x is not None]
                rows["grp"].append(f"{name}:{signed[head]}")
                rows["members"].append(signed[at].tolist())
                rows["first_id"].append(min(known, default=None))
        return pa.table(rows, schema=schema)

    return tiles.groupBy("shard", "sub", "i", "j").applyInArrow(run, "grp string, members array<long>, first_id long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` of an undirected graph with edges ``a, b``; the root is the component's smallest node.

    Alternates large-star and small-star until nothing changes. Each round is a written table, so a
    lost executor costs one round at most.
    """

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        lower = e.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        edges = written(small_star(large_star(edges)), "edges")
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest id reachable. All texts without words have fingerprint 0 and are linked like others.
    Null ids are never a component's name unless it has no other (then it is null); rows with equal
    ids and repeated rows stay separate rows. Texts of any length are read whole. An empty table gives an empty one. Only
    the id and text columns are read, whatever others are called.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "points")
    total = points.count()
    wanted = min(LARGEST_SAMPLE, max(LEAST_SAMPLE, total // shard * SAMPLE_A_SHARD))
    sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, total // wanted))) == 0).select("fp").toArrow()
    nodes = build_tree(np.sort(sample.column("fp").to_numpy()).view(np.uint64), total, radius, shard)
    routed = _resharded(written(_shards(points, nodes, radius), "routed"), radius, shard, tile)
    groups = written(_groups(_tiles(routed, tile), radius), "groups")
    members = groups.select("grp", F.explode("members").alias("fp"))
    # a point of several groups links each to its first
    first = members.groupBy("fp").agg(F.min("grp").alias("b"), F.count(F.lit(1)).alias("times")).where("times > 1")
    links = members.join(first, "fp").select(F.col("grp").alias("a"), "b")
    roots = components(links)
    rooted = groups.join(roots, groups.grp == roots.node, "left").select("grp", "members", "first_id", F.coalesce("root", "grp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = rooted.join(named, "root").select(F.explode("members").alias("fp"), "component_id")
    linked = linked.groupBy("fp").agg(F.min("component_id").alias("component_id"))
    labels = points.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id"))
    return join_counted(fps, labels, "fp", "n", fps.count(), "inner").select("doc_id", "fp", "component_id")

