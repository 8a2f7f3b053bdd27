"""The trie of conversation prefixes, built as a burst trie: containers of suffixes under heads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import written

# A container above either is burst, unless it holds a single sequence.
CONTAINER_SEQUENCES = 512
CONTAINER_TURNS = 1 << 16
# So many consecutive conv_ids of one sequence are joined to text at once.
ID_BLOCK = 256
SHARED_TURNS = 5
GROUP = 100
ROOT = "root"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_TURNS = "ARRAY<STRUCT<key: BINARY, chars: INT>>"
_SEQUENCE = f"conv BIGINT, n BIGINT, sha STRING, turns {_TURNS}"
_NODE = (
    "head STRING, parent STRING, top BOOLEAN, conv_id BIGINT, depth BIGINT, parent_conv_id BIGINT, n_convs BIGINT, "
    "n_children BIGINT, n_leaves BIGINT, saved_tokens BIGINT, ends_sha256 STRING"
)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv, turns): each conversation's turns in order, as digests of role and text and the texts' lengths.

    Turns go by number, null first; equal numbers by digest. A null role or text is an empty one. Texts
    stay behind: a turn is 20 bytes from here on. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    # The role's length keeps role and text apart.
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"), key.alias("key"), F.char_length(text).alias("chars")
        ).alias("t"),
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv").agg(
        F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns")
    )


def with_shared_starts(turns: DataFrame, group: int = GROUP, most: int = SHARED_TURNS) -> DataFrame:
    """(conv, turns): each conversation with the start of its group's first one in place of its own.

    The first h turns of conversation c - c % group, then c's own after its first h; h = crc32(c) % (most + 1).
    """
    first = F.col("conv") - F.col("conv") % group
    starts = turns.where(F.col("conv") % group == 0).select(
        F.col("conv").alias("first"), F.slice("turns", 1, most).alias("start")
    )
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    none = F.array().cast(_TURNS)
    joined = turns.withColumns({"first": first, "h": h}).join(starts, "first", "left")
    start = F.slice(F.coalesce("start", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select("conv", F.concat(start, rest).alias("turns"))


def sequences(turns: DataFrame, block: int = ID_BLOCK) -> DataFrame:
    """(conv, n, sha, turns): each different sequence once, with its smallest conversation.

    ``sha`` is the digest of the conv_ids, ascending, joined by commas. Ids of one sequence are first
    joined within blocks of ids, so copies of a conversation are spread over many tasks; then a task sees a
    row for each block and feeds it to the digest, whatever the number of copies.
    """
    blocks = turns.groupBy("turns", F.expr(f"conv div {block}").alias("block")).agg(
        F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"),
    )

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n", "sha", "turns"]
        types = [pa.int64(), pa.int64(), pa.string()]
        conv = n = sha = of = None
        for batch in batches:
            out: list[tuple] = []
            whole = batch.column("turns")
            ids = zip(*(batch.column(c).to_pylist() for c in ("conv", "n", "ids")))
            for i, (least, count, text) in enumerate(ids):
                same = of is not None and of.equals(whole.slice(i, 1))
                if of is not None and not same:
                    out.append((conv, n, sha.hexdigest(), of))
                if same:
                    conv, n = min(conv, least), n + count
                    sha.update(b"," + text.encode())
                else:
                    conv, n, sha, of = least, count, hashlib.sha256(text.encode()), whole.slice(i, 1)
            if out:
                columns = [pa.array(c, t) for c, t in zip(list(zip(*out))[:3], types)]
                yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([r[3] for r in out])], names)
        if of is not None:
            columns = [pa.array([v], t) for v, t in zip((conv, n, sha.hexdigest()), types)]
            yield pa.RecordBatch.from_arrays([*columns, of], names)

    dealt = blocks.repartition("turns").sortWithinPartitions("turns", "block")
    return dealt.select("conv", "n", "ids", "turns").mapInArrow(fed, _SEQUENCE)


def _shared(a: Column, b: Column) -> Column:
    """How many first turns two sequences share."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, F.lit(1), n), lambda t, i: t["key"] == F.get(b, i)["key"])
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, n).otherwise(first - 1)


def burst(found: DataFrame, most_sequences: int, most_turns: int) -> tuple[DataFrame, list[DataFrame]]:
    """(containers, burst heads by round).

    Containers: (head, parent, depth, chars, conv, n, sha, turns), the suffixes that follow a head. Every round
    deals the suffixes of oversized containers to new heads by their next turn; those that end
    there stay behind. What all suffixes of a container share (the first and the last of them tell) is passed over
    at once: the head is a path of nodes then. Heads: (head, parent, depth, path, conv_id, n_convs,
    ends_sha256), where ``path`` has the lengths of the turns from the head itself downwards.
    """
    active = found.select(
        F.lit(ROOT).alias("head"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(0).alias("chars"),
        *found.columns,
    )
    done, heads = None, []
    while True:
        large = written(
            active.groupBy("head")
            .agg(
                F.count(F.lit(1)).alias("sequences"),
                F.sum(F.size("turns")).alias("held"),
                F.min("turns").alias("first"),
                F.max("turns").alias("last"),
            )
            .where((F.col("sequences") > 1) & ((F.col("sequences") > most_sequences) | (F.col("held") > most_turns)))
            .select("head", _shared(F.col("first"), F.col("last")).alias("shared"), "first")
            .select("head", "shared", F.expr("transform(slice(first, 1, shared), t -> t.chars)").alias("path")),
            "trie-large",
        )
        if large.isEmpty():
            return active if done is None else done.unionByName(active), heads
        small = active.join(large, "head", "left_anti")
        done = small if done is None else done.unionByName(small)
        split = active.join(large, "head")
        ended = F.size("turns") == F.col("shared")  # one sequence at most
        heads.append(
            written(
                split.groupBy("head")
                .agg(
                    F.first("parent").alias("parent"),
                    F.first("depth").alias("depth"),
                    F.first(F.concat(F.array("chars"), "path")).alias("path"),
                    F.min("conv").alias("conv_id"),
                    F.sum("n").alias("n_convs"),
                    F.coalesce(F.max(F.when(ended, F.col("sha"))), F.lit(EMPTY_SHA)).alias("ends_sha256"),
                ),
                "trie-heads",
            )
        )
        following = F.get("turns", F.col("shared"))
        active = written(
            split.where(~ended).select(
                F.md5(F.concat(F.col("head").cast("binary"), following["key"])).alias("head"),
                F.col("head").alias("parent"),
                (F.col("depth") + F.col("shared") + 1).alias("depth"),
                following["chars"].alias("chars"),
                "conv",
                "n",
                "sha",
                F.slice("turns", F.col("shared") + 2, F.size("turns")).alias("turns"),
            ),
            "trie-suffixes",
        )


@dataclass
class _Node:
    depth: int
    chars: int
    parent: _Node | None
    conv: int
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    sha: str = EMPTY_SHA


def swept(rows: list[tuple]) -> list[_Node]:
    """The nodes of one container, its head first; ``rows``: (depth, chars, conv, n, sha, keys, lengths), sorted by keys.

    A sweep keeps the path to the last suffix open. What the next one doesn't share is closed, deepest first,
    and adds its leaves and savings to its parent.
    """
    depth, chars = rows[0][0], rows[0][1]
    head = _Node(depth, chars, None, rows[0][2])
    nodes, path, before = [head], [head], []

    def close(node: _Node) -> None:
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.chars
        if node.parent is not None:
            above = node.parent
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved

    for _, _, conv, n, sha, keys, lengths in rows:
        shared = 0
        for a, b in zip(before, keys):
            if a != b:
                break
            shared += 1
        while len(path) > shared + 1:
            close(path.pop())
        for k in range(shared, len(keys)):
            path.append(_Node(depth + k + 1, lengths[k], path[-1], conv))
            nodes.append(path[-1])
        for node in path:
            node.n += n
            node.conv = min(node.conv, conv)
        path[-1].sha = sha
        before = keys
    while path:
        close(path.pop())
    return nodes


def sweep(containers: DataFrame) -> DataFrame:
    """All nodes of all containers. Of a container's head (``top``) only the parent's conv_id is missing."""

    def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("head", pa.string()),
                ("parent", pa.string()),
                ("top", pa.bool_()),
                *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")),
                ("n_leaves", pa.int64()),
                ("saved_tokens", pa.int64()),
                ("ends_sha256", pa.string()),
            ]
        )
        head = parent = None
        rows: list[tuple] = []

        def flush() -> list[tuple]:
            return [
                (
                    head,
                    parent,
                    node.parent is None,
                    node.conv,
                    node.depth,
                    None if node.parent is None else node.parent.conv,
                    node.n,
                    node.children,
                    node.leaves,
                    node.saved,
                    node.sha,
                )
                for node in swept(rows)
            ]

        for batch in batches:
            out: list[tuple] = []
            turns = batch.column("turns")
            flat = turns.flatten()
            keys, lengths = flat.field("key").to_pylist(), flat.field("chars").to_pylist()
            at = 0
            names = ("head", "parent", "depth", "chars", "conv", "n", "sha")
            for row, size in zip(
                zip(*(batch.column(c).to_pylist() for c in names)), turns.value_lengths().to_pylist()
            ):
                if row[0] != head:
                    if rows:
                        out += flush()
                    head, parent, rows = row[0], row[1], []
                rows.append((*row[2:], keys[at : at + size], lengths[at : at + size]))
                at += size
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
                )
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*flush()), schema)], schema=schema
            )

    dealt = containers.repartition("head").sortWithinPartitions("head", "turns")
    return dealt.select("head", "parent", "depth", "chars", "conv", "n", "sha", "turns").mapInArrow(nodes_of, _NODE)


def _totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.col("parent").alias("head")).agg(
        F.count(F.lit(1)).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("below"),
    )


def prefix_nodes(
    turns: DataFrame, most_sequences: int = CONTAINER_SEQUENCES, most_turns: int = CONTAINER_TURNS
) -> DataFrame:
    """One row for each different sequence of first turns of (conv, turns), see `trie`."""
    found = written(sequences(turns), "trie-sequences")
    containers, heads = burst(found, most_sequences, most_turns)
    inner = written(sweep(containers), "trie-nodes")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not heads:
        return inner.select(*out)
    # Burst heads take what lies below them, from the last round upwards: one small table for each round.
    tops = inner.where("top").select("parent", "n_leaves", "saved_tokens")
    below = written(_totals(tops), "trie-totals")
    finished, last = [], None
    for level in reversed(heads):
        under = below if last is None else below.unionByName(_totals(last))
        summed = under.groupBy("head").agg(
            F.sum("n_children").alias("children"), F.sum("n_leaves").alias("n_leaves"), F.sum("below").alias("below")
        )
        saved = F.col("below") + (F.col("n_convs") - 1) * F.expr("aggregate(path, 0L, (a, c) -> a + c)")
        last = written(level.join(summed, "head").withColumn("saved_tokens", saved), "trie-heads")
        finished.append(last)
    upper = finished[0]
    for level in finished[1:]:
        upper = upper.unionByName(level)
    named = upper.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv"))
    inside = F.col("k") < F.size("path") - 1
    # What lies above a node of its path: lengths of the turns before it.
    places = F.expr("transform(path, (c, k) -> struct(k, aggregate(slice(path, 1, k), 0L, (a, x) -> a + x) AS passed))")
    paths = upper.join(named, "parent", "left").select("*", F.inline(places))
    paths = paths.select(
        "conv_id",
        (F.col("depth") + F.col("k")).alias("depth"),
        F.when(F.col("k") == 0, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(inside, F.lit(1).cast("bigint")).otherwise(F.col("children")).alias("n_children"),
        "n_leaves",
        (F.col("saved_tokens") - (F.col("n_convs") - 1) * F.col("passed")).alias("saved_tokens"),
        F.when(inside, F.lit(EMPTY_SHA)).otherwise(F.col("ends_sha256")).alias("ends_sha256"),
    )
    tops = inner.where("top").join(named, "parent", "left").withColumn("parent_conv_id", F.col("parent_conv"))
    return inner.where("NOT top").select(*out).unionByName(tops.select(*out)).unionByName(paths.select(*out))


def trie(
    conversations: DataFrame, most_sequences: int = CONTAINER_SEQUENCES, most_turns: int = CONTAINER_TURNS
) -> DataFrame:
    """The prefix trie of ``conversations`` (conv_id, turn, role, text), each rebuilt by `with_shared_starts`.

    One row for each different sequence of the first d turns, d from 0 (the root): conv_id, the smallest of its
    conversations; depth; parent_conv_id; n_convs; n_children; n_leaves, the nodes without children in its
    subtree; saved_tokens, what its subtree saves if every node's last text is read once (in code
    points); ends_sha256, the digest of the conversations that end there. Subtrees include their top.

    Conversations are sequences of digests (128 bits a turn). Equal ones are one with a weight. Containers of
    suffixes are burst by the next turn until they are small, then each is sorted and swept. What all suffixes of
    a container share is passed over in one round, so rounds are as many as branchings lie above
    one another in oversized containers; a container of a single sequence is never burst. One
    conversation's digests (20 bytes a turn) are one row.

    Equal turn numbers go by digest, null turns come first, null roles and texts are empty. Rows without
    conv_id belong to no conversation. Repeated rows are turns of their own. An empty table gives an empty result.
    """
    turns = written(conversation_turns(conversations), "trie-turns")
    return prefix_nodes(with_shared_starts(turns), most_sequences, most_turns)
