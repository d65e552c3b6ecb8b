"""Merkle manifest of a dataset: one root digest that vouches for every row, and proofs per row.

Rows are hashed to leaves and put in order per group. A level is a slot pivot: the children of a parent
are spread into ``fanout`` columns by conditional aggregates, and the parent's digest is the hash of these
columns put together. Leaving out one's own slot column gives the siblings, so paths go down from the root
by joins of parents with their parents' paths, and a proof is never looked up per row and level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import in_order, stored

STEP = "struct<before:string,after:string>"


def entry(value: Column) -> Column:
    """A value as hash input: ``-`` if null, else its length in UTF-8 bytes, a colon and the value."""
    return F.coalesce(F.concat(F.octet_length(value.cast("string")).cast("string"), F.lit(":"), value.cast("string")), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[entry(f) for f in fields]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """Root that follows from a leaf and its path: one hash a level, siblings before and after the own digest."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _slots(fanout: int) -> list[str]:
    return [f"c{k}" for k in range(fanout)]


def _parents(nodes: DataFrame, fanout: int, payload: Sequence[str] = ()) -> DataFrame:
    """Parents of nodes (tree, i, n, digest): slot columns c0, c1 ..., each with the digest and the payload."""
    child = F.struct("digest", *payload)
    slot = F.col("i") % fanout
    spread = [F.max(F.when(slot == k, child)).alias(c) for k, c in enumerate(_slots(fanout))]
    parent = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("i") / fanout).alias("i"), F.ceil(F.col("n") / fanout).alias("n"))
    digests = F.concat(*[F.coalesce(F.col(f"{c}.digest"), F.lit("")) for c in _slots(fanout)])
    return parent.agg(*spread).withColumn("digest", F.sha2(digests, 256))


def _levels(leaves: DataFrame, fanout: int, payload: Sequence[str] = ()) -> list[DataFrame]:
    """All levels above the leaves, each written; every pass shrinks a tree by ``fanout`` until one node is left."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while most > 1:
        nodes = stored(_parents(nodes, fanout, () if levels else payload), "level")
        levels.append(nodes)
        most = -(-most // fanout)
    return levels


def _children(parents: DataFrame, fanout: int, extra: Sequence[str]) -> DataFrame:
    """One row per child of parents with ``path``: its place, slot column and the path with its own siblings in front."""
    def beside(columns: list[str]) -> Column:
        return F.concat(F.lit(""), *[F.coalesce(F.col(f"{c}.digest"), F.lit("")) for c in columns])

    slots = _slots(fanout)
    each = F.array(*[F.struct(
        F.lit(k).alias("slot"), F.col(c).alias("child"),
        F.struct(beside(slots[:k]).alias("before"), beside(slots[k + 1:]).alias("after")).alias("step"))
        for k, c in enumerate(slots)])
    rows = parents.select("tree", "i", "path", *extra, F.explode(F.filter(each, lambda e: e["child"].isNotNull())).alias("e"))
    return rows.select("tree", (F.col("i") * fanout + F.col("e.slot")).alias("i"), "e.child",
                       F.concat(F.array("e.step"), F.col("path")).alias("path"), *extra)


@dataclass
class Manifest:
    """Nodes of all trees. ``tree`` is the group as text behind a 1, or 0 for the null group.

    leaves: tree, i, n, digest and what is carried; levels: the parents of leaves and so on; subroots: tree, depth,
    subroot, path and root.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    fanout: int
    payload: list[str]

    def nodes(self) -> DataFrame:
        """The manifest as one table: tree, level (0: leaves), i and digest, subroots included."""
        every = [self.leaves, *self.levels]
        out = None
        for level, nodes in enumerate(every):
            rows = nodes.select("tree", F.lit(level).alias("level"), "i", "digest")
            out = rows if out is None else out.unionByName(rows)
        return out

    def proofs(self) -> DataFrame:
        """One row per leaf: what was carried, ``leaf``, ``subroot``, ``root`` and its ``path`` of siblings.

        Goes down level by level: children of the parents of a level, and the roots of smaller trees.
        """
        extra = ["subroot", "root"]
        own = ["tree", "i", "path", *extra]
        top = self.subroots.withColumn("i", F.lit(0).cast("long"))
        known = top.filter(F.col("depth") == len(self.levels)).select(*own)
        for level in range(len(self.levels), 1, -1):
            below = _children(self.levels[level - 1].drop("n", "digest").join(known, ["tree", "i"]), self.fanout, extra)
            known = below.select(*own).unionByName(top.filter(F.col("depth") == level - 1).select(*own))
        carried = [F.col(f"child.{c}").alias(c) for c in self.payload]
        last = ["child", "path", *extra]
        alone = self.leaves.filter("n = 1").drop("i").join(top.filter("depth = 0"), "tree").select(
            F.struct("digest", *self.payload).alias("child"), "path", *extra)
        rows = alone
        if self.levels:
            rows = _children(self.levels[0].drop("n", "digest").join(known, ["tree", "i"]), self.fanout, extra).select(*last).unionByName(alone)
        return rows.select(*carried, F.col("child.digest").alias("leaf"), *extra, "path")


def build(docs: DataFrame, fields: Sequence[str], order: str = "doc_id", group: str = "lang", fanout: int = 8,
          carry: dict[str, Column] | None = None) -> Manifest:
    """Manifest of a table: leaves hash ``fields``, ascend by ``order`` per ``group``, ``fanout`` children a parent.

    ``carry`` maps names to expressions of the row that proofs bring along (the order column is always there, as
    ``_order``). Null fields hash as ``-``, so a null and an empty text differ. Null groups form one group, first of
    all; null ids come first in their group. Rows of equal id are ordered by leaf; rows that agree in both are
    interchangeable. A group of one row has its leaf as subroot. An empty table has an empty manifest. Texts are
    hashed whole where they are read, and only digests move on.
    """
    carry = dict(carry or {})
    payload = ["_order", *carry]
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = stored(docs.select(
        tree.alias("tree"), F.col(order).alias("_order"), leaf_of([F.col(f) for f in fields]).alias("digest"),
        *[c.alias(n) for n, c in carry.items()], F.monotonically_increasing_id().alias("_row")), "leaves")
    placed = in_order(leaves, [F.col("tree"), F.col("_order").asc_nulls_first(), F.col("digest"), F.col("_row")], ["tree"], "i", "n")
    levels = _levels(placed, fanout, payload)

    tops = [n.filter("n = 1").select("tree", F.lit(d).alias("depth"), "digest") for d, n in enumerate([placed, *levels])]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    subroots = stored(subroots, "subroots")
    # The tree over the subroots: one tree, whose leaves are the subroots in the order of their groups.
    over = in_order(subroots, [F.col("tree")], [], "i", "n").select(
        F.lit("").alias("tree"), "i", "n", "digest", F.col("tree").alias("_tree"), "depth")
    peak = _levels(over, fanout, ["_tree", "depth"])
    known = (peak[-1] if peak else over.filter("n = 1")).select(
        "tree", "i", F.array().cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("root"))
    for level in range(len(peak), 1, -1):
        known = _children(peak[level - 1].drop("n", "digest").join(known, ["tree", "i"]), fanout, ["root"]).select("tree", "i", "path", "root")
    if peak:
        rows = _children(peak[0].drop("n", "digest").join(known, ["tree", "i"]), fanout, ["root"]).select("child.*", "path", "root")
    else:
        rows = over.join(known, ["tree", "i"]).select("digest", "_tree", "depth", "path", "root")
    paths = stored(rows.select(F.col("_tree").alias("tree"), "depth", F.col("digest").alias("subroot"), "path", "root"), "paths")
    return Manifest(placed, levels, paths, fanout, payload)


def verify(proofs: DataFrame, claimed: str, sound: str = "verified") -> DataFrame:
    """Add ``proof_sha256``, ``folded_root`` and whether it equals the root, from a column of claimed leaves."""
    folded = proofs.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", fold(F.col(claimed), F.col("path")))
    return folded.withColumn(sound, F.col("folded_root") == F.col("root"))


def tampered(text: Column, doc_id: Column) -> Column:
    """A test forgery: A-Z of the text in lower case where 3 divides the CRC of the id, the text itself elsewhere."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, lowered).otherwise(text)


def check_forgeries(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
                    doc_id: str = "doc_id", group: str = "lang", text: str = "text", fanout: int = 8) -> DataFrame:
    """Manifest of ``docs``, and each row's proof held against a tampered copy of the row.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, one row per document. A null id is
    never tampered with. Other columns of the table do not matter.
    """
    claim = [tampered(F.col(text), F.col(doc_id)) if f == text else F.col(f) for f in fields]
    manifest = build(docs, fields, doc_id, group, fanout, {"_claimed": leaf_of(claim)})
    proofs = verify(manifest.proofs().withColumnRenamed("_order", doc_id), "_claimed")
    return proofs.select(doc_id, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
