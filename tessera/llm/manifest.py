"""A Merkle manifest of a dataset: a digest for every row, a tree of digests for every group, and one root over all.

A row's leaf is the hash of its fields. Per group, leaves stand in order, and runs of `FAN` neighbours are hashed to their
parent until one node is left, the group's subroot; subroots in order of their groups are hashed to the root alike. Digests
are lowercase hex SHA-256, and are hashed as text.

A level is one window: nodes are partitioned by group and parent, and the whole run, in order, is collected beside each of
them, which gives the parent's preimage and the node's siblings at once; parents are deduplicated before the next level. A
run has at most `FAN` nodes, so the largest group costs no task more than another. Paths go down again by joins of nodes
with their parents. Places of leaves come from ranges of the order and a running sum over the ranges, without a window over
a group. Levels are tables in the shared folder, each a third of the one below; their number is the logarithm of the
largest group. Texts are read once and never shuffled.

Defined cases: a null field is `-`, so that it differs from an empty one; a null group is a group, the first; null orders
come last in their group, equal ones go by leaf, and repeated rows are leaves each; texts of any length are hashed whole; a
lone leaf is its subroot, a lone group's subroot the root; an empty table has no root and gives no rows; other columns do
not matter, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, small, stored

FAN = 3
#: Groups are structs of one field: a null one can be joined, and comes first.
_STEPS = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """How a value stands in a leaf: its size in bytes and itself, or `-`."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return digest(*map(field, fields))


def proof(steps: Column) -> Column:
    """The hash of all siblings from the leaf up, left to right in each level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its path make."""
    return F.aggregate(steps, start, lambda h, s: digest(s["left"], h, s["right"]))


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds pos, the place of a row within its group g (from 0), and m, the group's size."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = rows.repartitionByRange(n, F.col("g"), *order).sortWithinPartitions(F.col("g"), *order)
    line = stored(line.withColumn("id", F.monotonically_increasing_id()), "manifest-line")
    line_part = line.withColumn("part", F.shiftright("id", 33))
    parts = line_part.groupBy("g", "part").agg(F.min("id").alias("from"), F.count("*").alias("n"))
    w = W.partitionBy("g").orderBy("part")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = stored(parts.select("g", "part", (before - F.col("from")).alias("add"), F.sum("n").over(W.partitionBy("g")).alias("m")), "manifest-parts")
    return line_part.join(small(parts), ["g", "part"]).withColumn("pos", F.col("id") + F.col("add")).drop("id", "part", "add")


def _levels(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """Tables of g, pos, m, h, run (the whole run of a node), from the leaves up; a group's last node has m = 1."""
    most = nodes.agg(F.max("m")).first()[0] or 0
    out: list[DataFrame] = []
    while True:
        up = F.floor(F.col("pos") / fan).cast("long")
        run = W.partitionBy("g", "up").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        out.append(stored(nodes.withColumn("up", up).withColumn("run", F.collect_list("h").over(run)), "manifest-level"))
        if most <= 1:
            return out
        most = -(-most // fan)
        parents = out[-1].filter("m > 1").select("g", F.col("up").alias("pos"), F.ceil(F.col("m") / fan).cast("long").alias("m"), F.sha2(F.array_join("run", ""), 256).alias("h"))
        nodes = parents.dropDuplicates(["g", "pos"])


def _tops(levels: list[DataFrame]) -> DataFrame:
    """g, h: the last node of every group."""
    out = levels[0].filter("m = 1").select("g", "h")
    for level in levels[1:]:
        out = out.unionByName(level.filter("m = 1").select("g", "h"))
    return out


def _paths(levels: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """The lowest level's rows with subroot and steps, the siblings of each node up to the root; above: g and the steps
    from its subroot on."""
    place = F.pmod(F.col("pos"), F.lit(fan)).cast("int")
    left, right = F.array_join(F.slice("run", F.lit(1), place), ""), F.array_join(F.slice("run", place + 2, F.lit(fan)), "")
    path = None
    for level in reversed(levels):
        rest = [c for c in level.columns if c in ("row", "h")] if level is levels[0] else []
        last = level.filter("m = 1").join(above, "g").select("g", "pos", *rest, F.col("h").alias("subroot"), "steps")
        if path is None:
            path = last
            continue
        up = path.select("g", F.col("pos").alias("up"), "subroot", "steps")
        own = F.array(F.struct(left.alias("left"), right.alias("right"))).cast(_STEPS)
        path = level.filter("m > 1").withColumn("own", own).join(up, ["g", "up"]).select("g", "pos", *rest, "subroot", F.concat("own", "steps").alias("steps")).unionByName(last)
    return path


def manifest(docs: DataFrame, fields: list[str], keep: dict[str, Column], group: str = "source", order: str = "doc_id", fan: int = FAN) -> DataFrame:
    """The columns of keep, and leaf, subroot, root, steps (array of left and right siblings, from the leaf up), for
    `proof` and `fold`. keep: columns over docs by name, other than these four."""
    rows = docs.select(
        F.struct(docs[f"`{group}`"].alias("name")).alias("g"), docs[f"`{order}`"].alias("o"),
        leaf(*(docs[f"`{c}`"] for c in fields)).alias("h"), F.struct(*(c.alias(n) for n, c in keep.items())).alias("row"),
    )
    rows = stored(rows, "manifest-leaves")
    levels = _levels(_numbered(rows, F.col("o").asc_nulls_last(), F.col("h")).drop("o"), fan)
    tops = stored(_tops(levels).select(F.struct(F.lit("").alias("name")).alias("g"), F.col("g").alias("row"), "h"), "manifest-tops")
    over = _levels(_numbered(tops, F.col("row")), fan)
    found = _tops(over).first()
    none = docs.sparkSession.range(1).select(F.struct(F.lit("").alias("name")).alias("g"), F.array().cast(_STEPS).alias("steps"))
    above = stored(_paths(over, none, fan).select(F.col("row").alias("g"), "steps"), "manifest-above")
    discard(rows, tops, *over)
    root = F.lit(found["h"] if found else None).cast("string")
    return _paths(levels, above, fan).select("row.*", F.col("h").alias("leaf"), "subroot", root.alias("root"), "steps")
