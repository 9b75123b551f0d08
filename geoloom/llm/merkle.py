"""Merkle manifest of a dataset: a tree of digests for each partition of the rows, and one over the partitions' roots.

Rows become leaves where they are read; what moves afterwards is digests, never texts. Leaves are numbered within their
partition by a range sort and the counts of the ranges. Each aligned block of ``FANOUT ** BLOCK_LEVELS`` leaves is one
subtree: a task visits it in postorder, returns its digest, and while unwinding gives every leaf below a child the
digests of the child's siblings. Roots of blocks are the nodes of another such traversal, until each partition has one
root; these go through the same traversals to the root of the dataset. On the way down each block gets the siblings of
its own root as one row, so that a leaf's whole proof is put together, hashed and folded in the task that has its block.

Defined results: a null field is ``-``; leaves of equal id stand in the order of their digests (equal rows are alike, so
their order changes nothing); a null id comes first and is never tampered with; a null partition is a partition and comes
first; a partition of one leaf has that leaf as its root, and the digest of its proof is that of the empty text if it is
the only one; an empty table gives an empty result; ids of any type that has an order; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm import common

FANOUT = 8
#: Levels of a tree that one task visits at once: blocks of 4,096 leaves.
BLOCK_LEVELS = 4
#: Fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One id of so many is tampered with.
TAMPERED = 3
ROWS_PER_TASK = 1_000_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def levels_for(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def traverse(nodes: list[str], levels: int, paths: list[list[str]] | None = None, fanout: int = FANOUT) -> str:
    """The digest of the subtree of ``levels`` levels over ``nodes``. Each of ``paths`` gets, level by level, what stands
    left and right of the digest that its node is in."""

    def visit(a: int, z: int, level: int) -> str:
        if not level:
            return nodes[a]
        step = fanout ** (level - 1)
        children = [(i, min(i + step, z)) for i in range(a, z, step)]
        found = [visit(*child, level - 1) for child in children]
        if paths is not None:
            for k, child in enumerate(children):
                beside = ("".join(found[:k]), "".join(found[k + 1 :]))
                for i in range(*child):
                    paths[i].extend(beside)
        return digest("".join(found))

    return visit(0, len(nodes), levels)


def fold(node: str, path: list[str]) -> str:
    """The root that ``node`` and the siblings of its path give."""
    for left, right in zip(path[::2], path[1::2]):
        node = digest(left + node + right)
    return node


def numbered(rows: DataFrame, order: list[str], tasks: int) -> DataFrame:
    """``rows`` with their place ``pos`` in their ``tree`` (a string, null for one of them) by ``order``, and ``n``, how many
    the tree has. Ranges are sorted and counted; a tree may span many of them."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_tie")]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("_tie")
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    place = ranged.columns.index("tree")

    def count(batches):
        tree, at = None, 0
        for b in batches:
            local = []
            for name in b.column(place).to_pylist():
                at = at + 1 if name == tree and at else 1
                tree = name
                local.append(at - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64())], names=[*b.schema.names, "_local"])

    local = common.materialize(ranged.mapInArrow(count, T.StructType([*ranged.schema.fields, T.StructField("_local", T.LongType())])))
    parts = local.groupBy("_part", "tree").agg(F.count("*").alias("_rows"))
    by_part = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_part").alias("_part2"), F.col("tree").alias("_tree2"), F.coalesce(F.sum("_rows").over(by_part), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy("tree")).alias("n"))
    met = local.join(parts.hint("merge"), (F.col("_part") == F.col("_part2")) & F.col("tree").eqNullSafe(F.col("_tree2")))
    return met.select(*rows.columns, (F.col("_local") + F.col("_before")).alias("pos"), "n")


def _groups(batches, keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows whose first ``keys`` values are equal."""
    name, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != name:
                if held:
                    yield name, held
                name, held = row[:keys], []
            held.append(row)
    if held:
        yield name, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048):
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _block(pos: Column, levels: int) -> Column:
    return F.floor(pos / F.lit(FANOUT**levels)).cast("long")


def _levels_of(n: int, levels: int) -> int:
    """Levels that a block of a tree of ``n`` nodes is visited through: all, unless it is the tree's only one."""
    return levels if n > FANOUT**levels else levels_for(n)


def block_roots(nodes: DataFrame, levels: int, tasks: int) -> DataFrame:
    """The roots of the aligned blocks of ``nodes`` (tree, pos, n, digest), in the same columns."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def up(batches):
        def rows():
            for (tree, block), held in _groups(batches, 2):
                n = held[0][3]
                yield tree, block, -(-n // FANOUT**levels), traverse([r[4] for r in held], _levels_of(n, levels))

        yield from _batches(rows(), schema)

    placed = nodes.select("tree", _block(F.col("pos"), levels).alias("block"), "pos", "n", "digest").repartition(tasks, "tree", "block").sortWithinPartitions("tree", "block", "pos")
    return placed.mapInArrow(up, "tree string, pos long, n long, digest string")


def climb(nodes: DataFrame, levels: int, tasks: int) -> list[DataFrame]:
    """``nodes``, the roots of their blocks, the roots of those, and so on to one root for each tree."""
    found = [nodes]
    while len(found) == 1 or (found[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tasks = max(1, tasks // FANOUT**levels) if len(found) > 1 else tasks
        found.append(common.materialize(block_roots(found[-1], levels, tasks)))
    return found


def descend(nodes: DataFrame, above: DataFrame, levels: int, tasks: int, carry: list[str], proofs: bool) -> DataFrame:
    """``nodes`` with the path of each to the root; ``above`` has the paths of their blocks' roots: tree, pos, path, subroot,
    root. The result has the columns of ``carry``, subroot and root, and pos and path, or else what the path proves."""
    kinds = [nodes.schema[c] for c in carry]
    own = nodes.select("tree", _block(F.col("pos"), levels).alias("block"), F.lit(1).alias("side"), "pos", "n", "digest", F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"), *(F.col(c).alias(f"c_{c}") for c in carry))
    zero = F.lit(0).cast("long")
    up = above.select("tree", F.col("pos").alias("block"), F.lit(0).alias("side"), zero.alias("pos"), zero.alias("n"), F.lit("").alias("digest"), "path", "subroot", "root", *(F.lit(None).cast(k.dataType).alias(f"c_{k.name}") for k in kinds))
    met = own.unionByName(up).repartition(tasks, "tree", "block").sortWithinPartitions("tree", "block", "side", "pos")
    if proofs:
        last = [T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType())]
        altered = 9 + carry.index("altered")
    else:
        last = [T.StructField("pos", T.LongType()), T.StructField("path", T.ArrayType(T.StringType()))]
        altered = 0
    out = T.StructType([*(T.StructField(k.name, k.dataType) for k in kinds), T.StructField("digest", T.StringType()), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), *last])

    def down(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        def rows():
            for _, (first, *held) in _groups(batches, 2):
                paths: list[list[str]] = [[] for _ in held]
                traverse([r[5] for r in held], _levels_of(held[0][4], levels), paths)
                for r, path in zip(held, paths):
                    path.extend(first[6])
                    ends = (digest("".join(path)), fold(r[altered], path)) if proofs else (r[3], path)
                    yield *r[9:], r[5], first[7] or r[5], first[8], *ends

        yield from _batches(rows(), to_arrow_schema(out))

    return met.mapInArrow(down, out)


def manifest(df: DataFrame, partition: str = "lang", doc_id: str = "doc_id", fields: tuple[str, ...] = FIELDS, text: str = "text", levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of ``df``: doc_id, leaf, subroot, root, proof_sha256, and folded_root and verified: the root that the
    proof gives for the row as a tamperer left it, and whether it is the true one."""
    spark = df.sparkSession
    common.ship(spark)
    own = df.select(F.col(doc_id).alias("id"), F.col(partition).cast("string").alias("tree"), *(F.col(c).alias(f"f{i}") for i, c in enumerate(fields)))
    values = [F.col(f"f{i}") for i in range(len(fields))]
    lowered = [F.translate(v, string.ascii_uppercase, string.ascii_lowercase) if c == text else v for v, c in zip(values, fields)]
    touched = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0, F.lit(False))
    leaves = own.select("tree", F.col("id").alias("doc_id"), leaf(*values).alias("digest"), F.when(touched, leaf(*lowered)).alias("altered"))
    leaves = common.materialize(leaves.withColumn("altered", F.coalesce("altered", "digest")))
    tasks = common.tasks_for(spark, leaves.count(), ROWS_PER_TASK)
    placed = common.materialize(numbered(leaves, ["doc_id", "digest"], tasks))
    trees = climb(placed, levels, tasks)
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("part"), "digest")
    forest = climb(common.materialize(numbered(subroots, ["part"], int(spark.conf.get("spark.sql.shuffle.partitions")))), levels, tasks)
    paths = forest[-1].select("tree", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for i in range(len(forest) - 2, -1, -1):
        found = descend(forest[i], paths, levels, tasks, [] if i else ["part"], False)
        paths = common.materialize(found.select(F.lit("").alias("tree") if i else F.col("part").alias("tree"), F.col("pos") if i else F.lit(0).cast("long").alias("pos"), "path", F.lit(None).cast("string").alias("subroot") if i else F.col("digest").alias("subroot"), "root"))
    for i in range(len(trees) - 2, 0, -1):
        paths = common.materialize(descend(trees[i].withColumn("name", F.col("tree")), paths, levels, tasks, ["name"], False).select(F.col("name").alias("tree"), "pos", "path", "subroot", "root"))
    out = descend(placed, paths, levels, tasks, ["doc_id", "altered"], True)
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
