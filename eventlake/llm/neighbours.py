"""Near-duplicate embeddings by NN-descent, lists enlarged to groups and across them, exact links, an audit of recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import written
from eventlake.llm.components import components

THRESHOLD = 0.9
NEIGHBOURS = 8
TABLES = 8
LEAF = 96  # vectors of a starting leaf, about
ROUNDS = 3
SETTLED = 0.002  # share of improved list entries below which the graph has settled
BLOCK = 256  # vectors of a group that a task compares with as many others, at least
MOST_BLOCK = 4096  # and at most
STRIP = 512  # rows of a block compared at once
AUDITED = 256  # vectors whose links are counted by brute force, and so many more of each size of group:
AUDITED_OF_SIZE = 16
LEAST_RECALL = 0.97
ATTEMPTS = 3
JOINING = 24  # rounds in which groups are offered each other, at most
MOST_DOUBLINGS = 3  # of contracted lists that hold nothing but possible links
SLACK = 0.03  # what quantised cosines may be off
SEED = 8


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=kind).reshape(len(column), -1)


def _bytes_matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.int8).reshape(len(values), -1).astype(np.float32)


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null or zero, all components finite."""
    limit = F.lit(float("inf"))
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(member, reps): the usable vectors as (vec_id, rep), and each different one once.

    ``reps``: (id, copies, dims, vector of unit length in double precision, q: the same in bytes).
    """
    good = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    once = written(
        good.groupBy("vector").agg(
            F.min("vec_id").alias("id"), F.count(F.lit(1)).cast("bigint").alias("copies")
        ),
        "neighbours-distinct",
    )
    member = good.join(once.select("vector", "id"), "vector").select("vec_id", F.col("id").alias("rep"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column("vector").to_pylist():
                x = np.array(v, dtype=np.float64)
                x /= np.abs(x).max()
                rows.append(x / np.sqrt(x @ x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("copies"),
                    pa.array([len(r) for r in rows], pa.int32()),
                    pa.array(rows, pa.list_(pa.float64())),
                    pa.array([np.round(r * 127).astype(np.int8).tobytes() for r in rows], pa.binary()),
                ],
                ["id", "copies", "dims", "vector", "q"],
            )

    reps = once.select("id", "copies", "vector").mapInArrow(
        unit, "id BIGINT, copies BIGINT, dims INT, vector ARRAY<DOUBLE>, q BINARY"
    )
    return written(member, "neighbours-members"), written(reps, "neighbours-vectors")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Of (u, v, s) the ``k`` nearest v of each u."""
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def start(reps: DataFrame, n: int, k: int, tables: int, leaf: int = LEAF, seed: int = SEED) -> DataFrame:
    """A first graph (u, v, s): the nearest within leaves of vectors on the same side of random planes.

    Every table has planes of its own. A leaf that holds much more than ``leaf`` vectors is dealt to
    random parts, so a crowd of near copies is never compared as a whole here.
    """
    planes = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims in set(batch.column("dims").to_pylist()):
                some = batch.filter(pa.compute.equal(batch.column("dims"), dims))
                x = _bytes_matrix(some.column("q").to_pylist())
                for table in range(tables):
                    rng = np.random.default_rng([seed, table, dims])
                    above = x @ rng.normal(size=(dims, planes)).astype(np.float32) > 0
                    side = above @ (1 << np.arange(planes, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column("id"),
                            some.column("q"),
                            some.column("dims"),
                            pa.array(np.full(len(x), table, dtype=np.int32)),
                            pa.array(np.asarray(side, dtype=np.int64)),
                        ],
                        ["id", "q", "dims", "tab", "side"],
                    )

    placed = reps.select("id", "q", "dims").mapInArrow(
        sides, "id BIGINT, q BINARY, dims INT, tab INT, side BIGINT"
    )
    keys = ["tab", "dims", "side"]
    sizes = placed.groupBy(*keys).count()
    parts = F.ceil(F.col("count") / (2 * leaf))
    dealt = placed.join(sizes, keys).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(seed), "id", "tab"), parts)
    )

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].to_numpy()
        x = _bytes_matrix(group["q"].tolist())
        s = x @ x.T / np.float32(127 * 127)
        np.fill_diagonal(s, -2)
        most = min(k, len(ids) - 1)
        if most < 1:
            return pd.DataFrame({"u": [], "v": [], "s": []}).astype({"u": "int64", "v": "int64"})
        best = np.argpartition(-s, most - 1, axis=1)[:, :most]
        row = np.repeat(np.arange(len(ids)), most)
        return pd.DataFrame(
            {"u": ids[row], "v": ids[best.ravel()], "s": s[row, best.ravel()].astype(np.float64)}
        )

    found = dealt.groupBy(*keys, "part").applyInPandas(nearest, "u BIGINT, v BIGINT, s DOUBLE")
    return _best(found, k)


def descend(graph: DataFrame, reps: DataFrame, k: int) -> tuple[DataFrame, int]:
    """One round: neighbours of neighbours are offered to both ends. The new graph, and how many lists' entries changed.

    A list travels to whoever names its owner, with its vectors as bytes and its worst cosine; only pairs
    better than the worst of a full list come back.
    """
    vectors = reps.select("id", "q", "dims")
    worst = graph.groupBy("u").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(F.lit(-2.0)).alias("worst")
    )
    named = (
        graph.join(vectors.withColumnRenamed("id", "v"), "v")
        .join(worst.withColumnRenamed("u", "v"), "v", "left")
        .withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    )
    lists = named.groupBy("u").agg(
        F.collect_list("v").alias("ids"), F.collect_list("q").alias("qs"), F.collect_list("worst").alias("limits")
    )  # k entries each
    asking = (
        graph.select("u", "v")
        .join(vectors.select(F.col("id").alias("u"), "q"), "u")
        .join(worst, "u")
        .join(lists.withColumnRenamed("u", "v"), "v")
    )

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("ids").value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            u = batch.column("u").to_numpy()[row]
            w = batch.column("ids").flatten().to_numpy()
            own = _bytes_matrix(batch.column("q").to_pylist())
            theirs = _bytes_matrix(batch.column("qs").flatten().to_pylist())
            s = np.einsum("ij,ij->i", own[row], theirs).astype(np.float64) / (127 * 127)
            mine = (u != w) & (s > batch.column("worst").to_numpy()[row])
            yours = (u != w) & (s > batch.column("limits").flatten().to_numpy())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([u[mine], w[yours]])),
                    pa.array(np.concatenate([w[mine], u[yours]])),
                    pa.array(np.concatenate([s[mine], s[yours]])),
                ],
                ["u", "v", "s"],
            )

    offers = asking.select("u", "q", "worst", "ids", "qs", "limits").mapInArrow(
        offer, "u BIGINT, v BIGINT, s DOUBLE"
    )
    both = graph.withColumn("old", F.lit(1)).unionByName(offers.withColumn("old", F.lit(0)))
    once = both.groupBy("u", "v").agg(F.max("s").alias("s"), F.max("old").alias("old"))
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    following = written(
        once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n"), "neighbours-graph"
    )
    return following.drop("old"), following.where("old = 0").count()


def verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose cosine in double precision reaches the threshold."""
    vectors = reps.select("id", "vector")
    both = pairs.join(vectors.toDF("u", "x"), "u").join(vectors.toDF("v", "y"), "v")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = [
                len(x) == len(y) and float(np.dot(x, y)) >= threshold
                for x, y in zip(
                    batch.column("x").to_numpy(zero_copy_only=False),
                    batch.column("y").to_numpy(zero_copy_only=False),
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep)) for c in ("u", "v")], ["a", "b"]
            )

    return both.select("u", "v", "x", "y").mapInArrow(exact, "a BIGINT, b BIGINT")


def _blocks(size: Column, block: int) -> Column:
    """How many blocks a group is cut into: about 16 if it is large, more where they would pass ``MOST_BLOCK``."""
    each = F.least(F.greatest(F.ceil(size / 16), F.lit(block)), F.lit(max(block, MOST_BLOCK)))
    return F.ceil(size / each).cast("int")


def _tiles(groups: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    """The vectors of every group once for each pair of blocks they take part in: as often as it has blocks."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return (
        groups.join(sizes, "component")
        .withColumn("blocks", _blocks(F.col("size"), block))
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .join(reps.select("id", "vector", "copies"), "id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "id",
            "vector",
            "copies",
            "component",
            "mine",
            F.least("mine", "other").alias("low"),
            F.greatest("mine", "other").alias("high"),
        )
    )


def links_within(groups: DataFrame, reps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, links): for each vector of a group, how many vectors of it, copies counted, it links to.

    ``groups``: (id, component). This is the list of a vector enlarged as far as its group goes. A
    group is cut into blocks; each pair of blocks is compared by itself, and only counts leave it.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["vector"].to_numpy()).astype(np.float64)
        copies, ids = group["copies"].to_numpy(), group["id"].to_numpy()
        mine, within = group["mine"].to_numpy(), group["low"].iloc[0] == group["high"].iloc[0]
        links = np.zeros(len(ids), dtype=np.int64)
        for i in range(0, len(x), STRIP):
            near = x[i : i + STRIP] @ x.T >= threshold
            at = np.arange(i, i + len(near))
            near[at - i, at] = False
            if not within:  # pairs within a block are counted where it meets itself
                near &= mine[at][:, None] != mine[None, :]
            links[at] = near @ copies
        return pd.DataFrame({"id": ids, "links": links})

    return (
        _tiles(groups, reps, block)
        .groupBy("component", "low", "high")
        .applyInPandas(compare, "id BIGINT, links BIGINT")
        .groupBy("id")
        .agg(F.sum("links").alias("links"))
    )


def edges_within(groups: DataFrame, reps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links within ``groups`` (id, component), enough of them to connect whatever is connected.

    From each pair of blocks comes at most one for each vector, to the smallest id it reaches in there.
    """

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        x, ids = np.stack(group["vector"].to_numpy()).astype(np.float64), group["id"].to_numpy()
        lowest, before = np.arange(len(ids)), None
        while before is None or (before != lowest).any():
            before = lowest.copy()
            for i in range(0, len(x), STRIP):
                near = x[i : i + STRIP] @ x.T >= threshold
                at = np.arange(i, i + len(near))
                near[at - i, at] = True
                lowest[at] = np.where(near, lowest[None, :], len(ids)).min(axis=1)
        some = lowest != np.arange(len(ids))
        return pd.DataFrame({"a": ids[some], "b": ids[lowest[some]]})

    return _tiles(groups, reps, block).groupBy("component", "low", "high").applyInPandas(connect, "a BIGINT, b BIGINT")


def edges_between(pairs: DataFrame, blobs: DataFrame, reps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b): for the members of each pair (x, y) of ``blobs`` (id, blob) a link to the other, where there is one.

    The larger of a pair is compared in blocks with the members of all its partners together, so it is copied
    as often as these make blocks, not once for each of them.
    """
    sizes = written(blobs.groupBy("blob").agg(F.count(F.lit(1)).alias("size")), "neighbours-sizes")
    sized = pairs.join(sizes.toDF("x", "size_x"), "x").join(sizes.toDF("y", "size_y"), "y")
    turned = F.col("size_x") >= F.col("size_y")
    large, small = F.when(turned, F.col("x")).otherwise(F.col("y")), F.when(turned, F.col("y")).otherwise(F.col("x"))
    asked = written(
        sized.select(large.alias("large"), small.alias("blob")).distinct().join(blobs, "blob").select("large", "id"),
        "neighbours-partners",
    )
    cut = written(
        asked.groupBy("large")
        .agg(F.count(F.lit(1)).alias("partners"))
        .join(sizes.toDF("large", "size"), "large")
        .select("large", _blocks(F.col("size"), block).alias("of_x"), _blocks(F.col("partners"), block).alias("of_y")),
        "neighbours-cuts",
    )

    def side(rows: DataFrame, own: str, other: str, name: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return rows.join(cut, "large").select(
            "large", "id", F.lit(name).alias("side"), mine.alias(own), theirs.alias(other)
        )

    members = blobs.withColumnRenamed("blob", "large")
    both = side(members, "of_x", "of_y", 0).unionByName(side(asked, "of_y", "of_x", 1))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own = (group["side"] == 0).to_numpy()
        x, y = (
            np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.empty((0, 0))
            for v in (group["vector"][own], group["vector"][~own])
        )
        out_a, out_b = [], []
        if len(x) and len(y):
            of_x, of_y = group["id"][own].to_numpy(), group["id"][~own].to_numpy()
            for i in range(0, len(y), STRIP):
                near = y[i : i + STRIP] @ x.T >= threshold
                some = np.flatnonzero(near.any(axis=1))
                out_a.append(of_y[i + some])
                out_b.append(of_x[near[some].argmax(axis=1)])
        return pd.DataFrame({"a": np.concatenate([np.empty(0, np.int64), *out_a]), "b": np.concatenate([np.empty(0, np.int64), *out_b])})

    return (
        both.join(reps.select("id", "vector"), "id")
        .groupBy("large", "of_x", "of_y")
        .applyInPandas(compare, "a BIGINT, b BIGINT")
    )


def _groups_of(edges: DataFrame) -> DataFrame:
    found = components(edges)
    return written(found.select(F.col("node").alias("id"), "component").distinct(), "neighbours-groups")


def joined_groups(
    edges: DataFrame, reps: DataFrame, threshold: float, k: int, tables: int, rounds: int = ROUNDS
) -> DataFrame:
    """(id, component): the groups of the links (a, b), those made one that hold a link between them.

    A list that is full of its own group's members never reaches another group, however long the group makes
    it. So each group is contracted to one vector, and NN-descent runs among these and the vectors without
    a group. A group's radius is the largest angle to its vector: two whose angle passes both radii and the
    threshold's angle have no link. Others are compared, by their vectors first, then by all their members in blocks. This
    goes on while groups join, and with longer lists while some list holds nothing but possible links.
    """
    forest, doublings = edges, 0
    for step in range(JOINING):
        groups = _groups_of(forest)
        if groups.isEmpty():
            return groups
        chosen = F.min_by("id", F.struct(F.xxhash64(F.lit(SEED), "id"), "id"))
        heads = groups.groupBy("component").agg(chosen.alias("id"))
        alone = reps.select("id").join(groups.select("id"), "id", "left_anti").select("id", F.col("id").alias("blob"))
        core = written(heads.select("id", F.col("component").alias("blob")).unionByName(alone), "neighbours-core")
        some = written(reps.join(core, "id"), "neighbours-contracted")
        n = some.count()
        if n < 2:
            return groups
        graph = written(start(some, n, k, tables, seed=SEED + 1 + step), "neighbours-graph")
        for _ in range(rounds):
            graph, changed = descend(graph, some, k)
            if changed <= SETTLED * n * k:
                break
        centers = some.select(F.col("blob").alias("component"), F.col("vector").alias("center"))
        dot = F.aggregate(F.zip_with("vector", "center", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        radii = written(
            groups.join(reps.select("id", "vector"), "id")
            .join(centers, "component")
            .groupBy("component")
            .agg(F.max(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))).alias("radius")),
            "neighbours-radii",
        )
        wide = written(
            core.join(radii, core["blob"] == radii["component"], "left").select(
                "id", "blob", F.coalesce("radius", F.lit(0.0)).alias("radius")
            ),
            "neighbours-radii",
        )
        angle = F.lit(float(np.arccos(threshold))) + F.col("radius_u") + F.col("radius_v")
        near = written(
            graph.join(wide.toDF("u", "of_u", "radius_u"), "u")
            .join(wide.toDF("v", "of_v", "radius_v"), "v")
            .where(F.col("s") >= F.cos(F.least(angle, F.lit(float(np.pi)))) - SLACK),
            "neighbours-offers",
        )
        direct = written(
            verified(near.where(F.col("s") >= threshold - SLACK).select("u", "v"), reps, threshold), "neighbours-edges"
        )
        linked = direct.select(F.col("a").alias("u"), F.col("b").alias("v"))
        pairs = near.join(linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v"))), ["u", "v"], "left_anti")
        pairs = pairs.select(F.least("of_u", "of_v").alias("x"), F.greatest("of_u", "of_v").alias("y")).distinct()
        blobs = groups.select("id", F.col("component").alias("blob")).unionByName(alone)
        between = written(edges_between(pairs, blobs, reps, threshold), "neighbours-between")
        if direct.isEmpty() and between.isEmpty():
            full = near.groupBy("u").count().where(F.col("count") >= min(k, n - 1))
            if k >= n - 1 or doublings == MOST_DOUBLINGS or full.isEmpty():
                return groups
            k, doublings = 2 * k, doublings + 1
            continue
        again = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
        forest = again.unionByName(direct).unionByName(between)
    return _groups_of(forest)


def audit(
    reps: DataFrame, found: DataFrame, groups: DataFrame, threshold: float, audited: int = AUDITED, seed: int = SEED
) -> float:
    """The least share of true links found, of any size of group and of all sampled vectors.

    Some vectors are compared with all: ``audited`` of all, and ``AUDITED_OF_SIZE`` of each size of group (by
    powers of two, none included), both chosen by hash. A vector's share is its own: large groups hide no
    lost link of small ones. ``found``: (id, links) with links to other vectors, copies counted.
    """
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = groups.join(sizes, "component").select("id", F.floor(F.log2("size")).cast("int").alias("size"))
    placed = reps.select("id", F.xxhash64(F.lit(seed), "id").alias("h")).join(sized, "id", "left")
    placed = placed.withColumn("size", F.coalesce("size", F.lit(-1)))
    by_size = placed.withColumn("nth", F.row_number().over(Window.partitionBy("size").orderBy("h", "id")))
    some = (
        by_size.where(F.col("nth") <= AUDITED_OF_SIZE)
        .select("id", "size")
        .union(placed.orderBy("h", "id").limit(audited).select("id", "size"))
        .distinct()
    )
    sampled = written(some, "neighbours-audited")
    chosen = reps.select("id", "vector").join(sampled, "id").collect()  # audited + AUDITED_OF_SIZE * 64 at most
    by_dims: dict[int, tuple[list[int], np.ndarray]] = {}
    for dims in {len(r["vector"]) for r in chosen}:
        some = [r for r in chosen if len(r["vector"]) == dims]
        by_dims[dims] = ([r["id"] for r in some], np.array([r["vector"] for r in some]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, (ids, queries) in by_dims.items():
                some = batch.filter(pa.compute.equal(batch.column("dims"), dims))
                if not some.num_rows:
                    continue
                near = queries @ _matrix(some.column("vector"), np.float64).T >= threshold
                near &= np.array(ids)[:, None] != some.column("id").to_numpy()[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(near @ some.column("copies").to_numpy())],
                    ["id", "true_links"],
                )

    true = (
        reps.select("id", "copies", "dims", "vector")
        .mapInArrow(count, "id BIGINT, true_links BIGINT")
        .groupBy("id")
        .agg(F.sum("true_links").alias("true_links"))
    )
    own = (
        true.join(found, "id", "left")
        .join(sampled, "id")
        .where(F.col("true_links") > 0)
        .select("size", (F.coalesce("links", F.lit(0)) / F.col("true_links")).alias("share"))
    )
    shares = own.groupBy("size").agg(F.avg("share").alias("share")).union(own.agg(F.lit(-2), F.avg("share")))
    return min((row["share"] for row in shares.collect() if row["share"] is not None), default=1.0)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    neighbours: int = NEIGHBOURS,
    tables: int = TABLES,
    rounds: int = ROUNDS,
    least_recall: float = LEAST_RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Equal vectors are one until the end. NN-descent refines a neighbour graph; its edges that reach the
    threshold join vectors into groups, and groups that hold a link between them into larger ones
    (`joined_groups`). Within a group all links are counted exactly: a full list of links is thereby enlarged to
    all its group. An audit compares some vectors with all others; if it finds less than ``least_recall`` of
    the links of any size of group, the graph is made anew with twice the neighbours and tables. After ``ATTEMPTS`` such
    graphs all vectors are compared in blocks, which is exact. Tables grow with the number of vectors.
    No pair below the threshold counts.

    A vector that is null, zero, or holds null or non-finite components links with nothing: 0 links, a
    component of its own, kept. So does a row without vec_id, whose component is null and which is
    kept. Vectors of different lengths never link. Rows that repeat vec_id and vector are copies.
    An empty table gives an empty result.
    """
    member, reps = distinct_vectors(vectors)
    n = reps.count()
    k, many = neighbours, tables + max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    for _ in range(ATTEMPTS):
        graph = written(start(reps, n, k, many), "neighbours-graph")
        for _ in range(rounds):
            graph, changed = descend(graph, reps, k)
            if changed <= SETTLED * n * k:
                break
        edges = written(
            verified(graph.where(F.col("s") >= threshold - SLACK).select("u", "v"), reps, threshold),
            "neighbours-edges",
        )
        groups = joined_groups(edges, reps, threshold, k, many, rounds)
        found = written(links_within(groups, reps, threshold), "neighbours-links")
        if audit(reps, found, groups, threshold) >= least_recall:
            break
        k, many = 2 * k, 2 * many
    else:
        every = reps.select("id", F.col("dims").cast("bigint").alias("component"))
        groups = _groups_of(edges_within(every, reps, threshold))
        found = written(links_within(groups, reps, threshold), "neighbours-links")
    each = reps.join(found, "id", "left").join(groups, "id", "left").select(
        F.col("id").alias("rep"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("links"),
        F.coalesce("component", "id").alias("component"),
    )
    linked = member.join(each, "rep").groupBy("vec_id").agg(
        F.max("links").alias("links"), F.min("component").alias("component")
    )
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"))
        .join(linked, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )
