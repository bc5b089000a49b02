"""Merkle manifest of a dataset: a SHA-256 tree whose parents keep their midstates.

Documents are leaves, numbered within their group. Blocks of consecutive leaves make
subtrees; the roots of blocks are the nodes of the next stage, until each group has one
root, and the roots of all groups make a tree of their own. A parent keeps a copy of its
hash state before each child: to fold a changed leaf, the state before its slot goes on
with the new digest and the siblings to the right, and what lies left is not hashed again.

No task sees more than a block and the path of its root, nothing passes through the driver.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscan.operators.skew import number_rows
from flockscan.storage import save

ARITY = 2
# Leaves of a block at most.
BLOCK = 4_096

# Trees


class Node:
    """A parent: the hash states before each child and the siblings to the right of each."""

    __slots__ = ("before", "digest", "left", "right")

    def __init__(self, children: list[bytes]):
        state = hashlib.sha256()
        self.before, self.left, self.right = [], [], []
        for i, child in enumerate(children):
            self.before.append(state.copy())
            self.left.append(b"".join(children[:i]))
            self.right.append(b"".join(children[i + 1 :]))
            state.update(child)
        self.digest = state.hexdigest().encode()

    def folded(self, slot: int, digest: bytes) -> bytes:
        """The parent's digest with another one in a slot."""
        state = self.before[slot].copy()
        state.update(digest)
        state.update(self.right[slot])
        return state.hexdigest().encode()


def subtree(digests: list[bytes], arity: int, height: int | None) -> tuple[list[list[Node]], bytes]:
    """``(levels, root)``: the parents over some digests, in ``height`` levels.

    Without a height levels end when one node remains.
    """
    levels, row = [], digests
    while len(row) > 1 if height is None else len(levels) < height:
        levels.append([Node(row[i : i + arity]) for i in range(0, len(row), arity)])
        row = [node.digest for node in levels[-1]]
    return levels, row[0]


def steps_of(levels: list[list[Node]], arity: int, place: int) -> list[tuple[Node, int]]:
    """The parents above a leaf, each with the slot that leads to it."""
    steps = []
    for level in levels:
        steps.append((level[place // arity], place % arity))
        place //= arity
    return steps


def root_of(leaf: str, proof: list) -> str:
    """The root that a leaf and the ``(left, right)`` siblings of each level lead to."""
    for left, right in proof:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


# Stages. Nodes are rows (tree, place, n, digest): node ``place`` of the ``n`` of a tree.

PATH = "array<struct<left:string,right:string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def _sizes(arity: int, block: int) -> tuple[int, int]:
    """``(size, height)``: the largest full subtree of at most ``block`` leaves."""
    size, height = arity, 1
    while size * arity <= block:
        size, height = size * arity, height + 1
    return size, height


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def _grown(table: pa.Table, arity: int, size: int, height: int):
    """Subtree of a block; the last block of several is as high as the others."""
    digests = [d.hex().encode() for d in table.column("digest").to_pylist()]
    alone = table.column("n")[0].as_py() <= size
    return (digests, *subtree(digests, arity, None if alone else height))


def _raised(nodes: DataFrame, arity: int, size: int, height: int) -> DataFrame:
    """The nodes of the next stage: one for each block."""

    def root(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        _, _, digest = _grown(table, arity, size, height)
        first = {c: table.column(c)[0].as_py() for c in ("tree", "place", "n")}
        row = {"tree": first["tree"], "place": first["place"] // size, "n": -(-first["n"] // size)}
        return pa.Table.from_pylist(
            [{**row, "digest": bytes.fromhex(digest.decode())}],
            pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]),
        )

    blocks = nodes.select("tree", "place", "n", "digest", _block(size)).groupBy("tree", "block")
    return blocks.applyInArrow(root, "tree long, place long, n long, digest binary")


def _block(size: int) -> Column:
    return F.floor(F.col("place") / F.lit(size)).cast("long").alias("block")


def _paths(lefts: list, rights: list, counts: list[int]) -> pa.Array:
    """A column of paths from their flat steps."""
    ends = [0]
    for n in counts:
        ends.append(ends[-1] + n)
    steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(_STEP))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)


def _lowered(nodes: DataFrame, above: DataFrame, arity: int, size: int, height: int) -> DataFrame:
    """``(tree, place, path)`` of all nodes of a stage, from the paths of the stage above."""

    def paths(table: pa.Table, over: pa.Table) -> pa.Table:
        table = _ordered(table)
        _, levels, _ = _grown(table, arity, size, height)
        upper = over.column("path")[0].as_py()
        lefts, rights, counts = [], [], []
        for i in range(table.num_rows):
            own = steps_of(levels, arity, i)
            lefts += [node.left[slot].decode() for node, slot in own] + [s["left"] for s in upper]
            rights += [node.right[slot].decode() for node, slot in own] + [s["right"] for s in upper]
            counts.append(len(own) + len(upper))
        return pa.table(
            [table.column("tree"), table.column("place"), _paths(lefts, rights, counts)], ["tree", "place", "path"]
        )

    left = nodes.select("tree", "place", "n", "digest", _block(size)).groupBy("tree", "block")
    right = above.select("tree", F.col("place").alias("block"), "path").groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(paths, f"tree long, place long, path {PATH}")


def _height(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def _climb(nodes: DataFrame, arity: int, size: int, height: int) -> list[DataFrame]:
    """The stages from ``nodes`` up to one node for each tree."""
    stages = [nodes]
    while _height(stages[-1]) > 1:
        stages.append(save(_raised(stages[-1], arity, size, height), "nodes").frame)
    return stages


def _descend(stages: list[DataFrame], above: DataFrame, arity: int, size: int, height: int) -> DataFrame:
    """Paths of the first stage's nodes, ``above`` those of the last stage's."""
    for nodes in reversed(stages[:-1]):
        above = save(_lowered(nodes, above, arity, size, height), "paths").frame
    return above


# The manifest


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields: each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [field.cast("string") for field in fields]
    parts = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(part, F.lit("-")) for part in parts)), 256))


def _fold(table: pa.Table, over: pa.Table, arity: int, size: int, height: int) -> pa.Table:
    """Proof of every leaf of a block, and the root that its claimed digest leads to."""
    table = _ordered(table)
    digests, levels, _ = _grown(table, arity, size, height)
    above = over.to_pylist()[0]
    upper = []
    for step in above["path"]:
        # The midstate behind the left siblings, kept for all leaves of the block.
        upper.append((hashlib.sha256(step["left"].encode()), step["right"].encode()))
    upper_left, upper_right = ([step[side] for step in above["path"]] for side in ("left", "right"))
    lefts, rights, counts, folded = [], [], [], []
    for i, claim in enumerate(table.column("claim").to_pylist()):
        digest = digests[i] if claim is None else claim.hex().encode()
        own = steps_of(levels, arity, i)
        for node, slot in own:
            digest = node.folded(slot, digest)
        for kept, right in upper:
            state = kept.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        folded.append(digest.decode())
        lefts += [node.left[slot].decode() for node, slot in own] + upper_left
        rights += [node.right[slot].decode() for node, slot in own] + upper_right
        counts.append(len(own) + len(upper))
    n = table.num_rows
    return pa.table(
        [
            table.column("doc_id"),
            pa.array([d.decode() for d in digests]),
            pa.array([above["subroot"]] * n, pa.string()),
            pa.array([above["root"]] * n, pa.string()),
            _paths(lefts, rights, counts),
            pa.array(folded, pa.string()),
        ],
        ["doc_id", "leaf", "subroot", "root", "proof", "folded_root"],
    )


def merkle_manifest(
    documents: DataFrame,
    fields: list[str],
    group: str = "lang",
    altered: Column | None = None,
    changed: dict[str, Column] | None = None,
    arity: int = ARITY,
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof, folded_root)`` for every row of ``documents``.

    A leaf is the digest of the row's ``fields``. Within each ``group`` leaves ascend by
    ``doc_id``; every ``arity`` consecutive nodes become the digest of their hex digests,
    the last of them possibly fewer or one, until one node is left, the ``subroot``. Subroots in
    ascending order of their group, bytewise, make the ``root`` likewise. ``proof`` holds the
    siblings to the left and right of each level, from the leaf to the root.
    ``folded_root`` is the root with this row alone changed: where ``altered`` holds, the columns
    in ``changed`` are taken in place of the row's own.

    Null groups and ids come before all others. Rows of equal id are ordered by their leaf,
    repeated rows are leaves of their own. Null and empty fields differ. Other columns are
    ignored; an empty table gives an empty one. Blocks hold at most ``block`` leaves.
    """
    size, height = _sizes(arity, block)
    own = [F.col(f"`{c}`") for c in fields]
    new = [changed[c] if c in (changed or {}) else F.col(f"`{c}`") for c in fields]
    claim = F.when(altered, leaf_digest(new)) if altered is not None else F.lit(None).cast("binary")
    key = F.col(f"`{group}`")
    made = documents.select("doc_id", key.alias("group"), leaf_digest(own).alias("digest"), claim.alias("claim"))
    # Repeated rows are told apart, so that a range sort can spread them.
    leaves = save(made.withColumn("tie", F.monotonically_increasing_id()), "leaves").frame
    placed = number_rows(leaves, ["group", "doc_id", "digest", "tie"], "at")
    groups = placed.groupBy("group").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    trees = save(number_rows(groups, ["begin"], "tree"), "trees").frame
    named = trees.select(F.col("group").alias("name"), "begin", "n", "tree")
    nodes = placed.join(named, F.col("group").eqNullSafe(F.col("name"))).select(
        "tree", (F.col("at") - F.col("begin")).alias("place"), "n", "digest", "doc_id", "claim"
    )

    stages = _climb(nodes, arity, size, height)
    subroots = stages[-1].select("tree", F.col("digest").alias("subroot"))
    every = trees.agg(F.count(F.lit(1))).first()[0]
    heads = stages[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest")
    upper = _climb(heads.withColumn("n", F.lit(every).cast("long")), arity, size, height)
    tops = upper[-1].select("tree", "place", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    paths = _descend(upper, tops.drop("root"), arity, size, height)

    # Each tree's path and subroot, then down to the blocks of leaves. There is one root.
    root = tops.select(F.lower(F.hex("root"))).first() or (None,)
    above = paths.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "path")
    if len(stages) > 1:
        above = _descend(stages[1:], above, arity, size, height)
    over = above.join(subroots, "tree").select(
        "tree",
        F.col("place").alias("block"),
        "path",
        F.lower(F.hex("subroot")).alias("subroot"),
        F.lit(root[0]).cast("string").alias("root"),
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    left = nodes.select("*", _block(size)).groupBy("tree", "block")
    return left.cogroup(over.groupBy("tree", "block")).applyInArrow(
        lambda table, path: _fold(table, path, arity, size, height),
        f"doc_id {kind}, leaf string, subroot string, root string, proof {PATH}, folded_root string",
    )
