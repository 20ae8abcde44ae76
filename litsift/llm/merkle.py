"""Merkle manifest of a dataset: a hash tree over each group's rows, and one over the groups' roots.

Only every ``STEP``-th level is stored, as blocks of 2^STEP neighbouring nodes. A block is an aligned
subtree: the levels inside it are regenerated from its stored nodes when a proof is asked for,
give their siblings, and are gone with the row. Positions come from a range partitioning on
(group, order), so a group of any size is spread over the tasks; blocks hold 2^STEP rows at
most, and each further stored level has a 2^STEP-th of the nodes.

A proof is an array from leaf to root. An entry is ``L`` or ``R`` and the sibling's digest, by the
side on which it stands, or empty where a node is alone in its run and is hashed by itself.

Rows of one group are in the order of their id, null first; rows that share an id are in the order
of their leaves, so equal rows are told apart by place alone. A null group is a group, the
first. No field is special: null and empty values have different leaves. An empty table has
no tree and no proofs. Extra columns are ignored unless they are named as fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Levels between two stored ones; a block holds 2^STEP nodes.
STEP = 8


def digest(text: Column) -> Column:
    """Lowercase hexadecimal SHA-256."""
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value with its byte count before it, or a mark for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields."""
    return digest(F.concat(*map(field, values)))


# ------------------------------------------------------------------ inside one aligned subtree


def _up(level: Column) -> Column:
    """The next level of a run of nodes: every two consecutive ones together, a last one alone."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: digest(
        F.concat(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.lit("")))))


def _levels(nodes: Column, whole: Column) -> Column:
    """All levels of a subtree from its stored nodes. That of a ``whole`` group ends where one node is left."""
    def grow(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        return F.when(whole & (F.size(last) == 1), levels).otherwise(F.concat(levels, F.array(_up(last))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEP)), F.array(nodes), grow)


def _siblings(levels: Column, place: Column) -> Column:
    """The proof of a subtree's node up to the subtree's top; ``place`` counts within the subtree."""
    def mark(level: Column, k: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(2.0), k)).cast("int")
        left = own % 2 == 1
        other = F.get(level, F.when(left, own - 1).otherwise(own + 1))
        return F.coalesce(F.concat(F.when(left, F.lit("L")).otherwise(F.lit("R")), other), F.lit(""))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), mark)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    def step(node: Column, entry: Column) -> Column:
        other = F.substring(entry, 2, 64)
        return digest(F.when(F.substring(entry, 1, 1) == "L", F.concat(other, node)).otherwise(F.concat(node, other)))

    return F.aggregate(proof, start, step)


def proof_digest(proof: Column) -> Column:
    """One digest over a proof's siblings, from leaf to root."""
    return digest(F.array_join(F.transform(proof, lambda x: F.substring(x, 2, 64)), ""))


# ------------------------------------------------------------------ stored levels


def _numbered(nodes: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``nodes`` with ``pos`` within their ``grp`` and the group's size ``n``.

    The rows are written where the range partitioning put them, so the counts and the rows that
    are read for the numbers are the same.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in ["grp", *order, "tie"]]
    held = scratch.keep(nodes.withColumn("tie", F.monotonically_increasing_id()), f"{name}-rows")
    ranged = held.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = scratch.keep(ranged.withColumn("seat", F.monotonically_increasing_id()).drop("tie"), f"{name}-ranged")
    ranged = ranged.withColumn("part", F.shiftright("seat", 33))
    counts = ranged.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("here"), F.min("seat").alias("first"))
    own = Window.partitionBy("grp")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("grp", "part", "first", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"),
                           F.sum("here").over(own).alias("n"))
    return ranged.join(counts, ["grp", "part"]).withColumn("pos", F.col("before") + F.col("seat") - F.col("first")) \
        .drop("part", "seat", "first", "before")


def _store(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Write the stored levels over (grp, n, pos, hash, row): blocks of nodes, until each group is one block."""
    levels: list[DataFrame] = []
    while True:
        member = F.struct(*[c for c in ("pos", "hash", "row") if c in nodes.columns])
        blocks = nodes.groupBy("grp", "n", F.shiftright("pos", STEP).alias("block")).agg(
            F.sort_array(F.collect_list(member)).alias("members"))
        levels.append(scratch.keep(blocks.withColumn("whole", F.col("n") <= 1 << STEP), f"{name}-{len(levels)}"))
        if levels[-1].filter(~F.col("whole")).isEmpty():
            return levels
        nodes = levels[-1].select("grp", F.ceil(F.col("n") / (1 << STEP)).alias("n"), F.col("block").alias("pos"),
                                  F.element_at(F.element_at(_tree(), -1), 1).alias("hash"))


def _tree() -> Column:
    return _levels(F.col("members.hash"), F.col("whole"))


def _roots(levels: list[DataFrame]) -> DataFrame:
    return levels[-1].select("grp", F.element_at(F.element_at(_tree(), -1), 1).alias("hash"))


class Manifest:
    """The stored levels of the groups' trees and of the tree over their roots."""

    def __init__(self, groups: list[DataFrame], top: list[DataFrame]):
        self.groups, self.top = groups, top

    def root(self) -> DataFrame:
        """(root) of the whole dataset; no row without any data."""
        return _roots(self.top).select(F.col("hash").alias("root"))

    def subroots(self) -> DataFrame:
        """(grp, subroot) of every group; a null group is ``-``, others have ``=`` before their name."""
        return _roots(self.groups).withColumnRenamed("hash", "subroot")

    def proofs(self) -> DataFrame:
        """(row, hash, proof, subroot, root) of every leaf; ``row`` holds what was kept with it."""
        roots = _roots(self.top).select("grp", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>")
                                        .alias("above"), F.col("hash").alias("root"))
        heads = _descend(self.top, roots, ["root"])
        heads = heads.select(F.col("row.grp").alias("grp"), F.lit(0).cast("long").alias("block"),
                             F.col("proof").alias("above"), F.col("hash").alias("subroot"), "root")
        return _descend(self.groups, heads, ["subroot", "root"]).drop("grp", "pos")


def _descend(levels: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """Proofs of the lowest stored level's nodes, from those of the blocks' tops, level by level."""
    for level in reversed(levels):
        joined = level.join(above, ["grp", "block"])
        names = joined.schema["members"].dataType.elementType.names

        def entries(tree: Column) -> Column:
            return F.transform("members", lambda m, i: F.struct(
                *[m[c].alias(c) for c in names], F.concat(_siblings(tree, i), F.col("above")).alias("proof")))

        # the tree is bound to a name, so it is regenerated once for the block and not for each node
        found = joined.select("grp", *carried, F.inline(F.element_at(F.transform(F.array(_tree()), entries), 1)))
        above = found.withColumnsRenamed({"pos": "block", "proof": "above"})
    return found


def build(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> Manifest:
    """The manifest of (group, order, hash, row): ``row`` is a struct to be kept with each leaf."""
    name = F.col(group).cast("string")
    rows = rows.select(F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), name)).alias("grp"),
                       *[F.col(c).alias(f"order_{i}") for i, c in enumerate(order)], "hash", "row")
    keys = [f"order_{i}" for i in range(len(order))]
    groups = _store(_numbered(rows, [*keys, "hash"], scratch, "leaves").drop(*keys), scratch, "groups")
    heads = _roots(groups).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash",
                                  F.struct("grp").alias("row"))
    return Manifest(groups, _store(_numbered(heads, ["name"], scratch, "heads").drop("name"), scratch, "top"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether a tampered copy's proof still holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    parts[3] = parts[3].cast("decimal(38,0)")
    own = leaf(*parts)
    more = leaf(*parts[:3], parts[3] + 1, parts[4])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = docs.select("lang", "doc_id", own.alias("hash"), F.when(tampered, more).alias("more"))
    rows = rows.withColumn("row", F.struct("doc_id", F.coalesce("more", "hash").alias("shown")))
    found = build(rows, "lang", ["doc_id"], Scratch(spark, "merkle")).proofs()
    return found.select("row.doc_id", F.col("hash").alias("leaf"), "subroot", "root",
                        proof_digest(F.col("proof")).alias("proof_sha256"),
                        folded(F.col("row.shown"), F.col("proof")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
