"""Merkle manifest of a dataset, with coordinate lookup proofs.

A row is a leaf; leaves of a group (here a language) form a binary tree in order of their ids, and the groups' roots form
one above them. All nodes are written as a table by coordinate: (group, level, index). To prove a leaf, its index and its
group's size give the coordinates of the siblings on its path; they are exploded, joined with the node table, ordered,
concatenated (the proof) and folded into the leaf, which must give the root.

Indices come from a range-sorted table: a row's place in its partition, plus the group's rows in the partitions before. No
group, however large, is ordered in one task. Levels are built STEP at a time in blocks of 2**STEP nodes. A node near the
top is looked up by a large share of all leaves: `common.lookup` broadcasts those, which are few, and joins the others.

Defined cases: nulls in any column have a form of their own ("-") in the leaf; a null group is a group, the first one; a
null id stands before all others of its group. Rows that repeat an id stand in order of their leaves, and equal rows may
stand for each other. Extra columns are not read. An empty table gives an empty result. Very long texts are hashed whole
where they are read; only digests shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import lookup, materialize, release, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = 8  # levels that one shuffle builds
TOP = -1  # the group of the tree over the groups' roots
GROUPS = 100_000  # groups that are broadcast; more are joined by shuffle


def hashed(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return hashed(*(field(values[c]) for c in FIELDS))


def text_of(digest: Column) -> Column:
    """Digests are stored as 32 bytes and hashed as hex text."""
    return F.lower(F.hex(digest))


def _one_of(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= GROUPS else rows


def indexed(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df, written, with `idx`, a row's place among those of its group in the given order, and `size`, their number. group and order tell rows apart and group has no nulls."""
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = materialize(dealt.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), name)
    runs = placed.groupBy("part", *group).agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first"))
    before = F.sum("rows").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumns({"before": F.coalesce(before, F.lit(0)), "size": F.sum("rows").over(Window.partitionBy(*group))}).drop("rows")
    return placed.join(runs, ["part", *group]).withColumn("idx", F.col("pos") - F.col("first") + F.col("before")).drop("part", "pos", "first", "before")


def height(size: Column) -> Column:
    """Levels above the leaves until one node remains."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def tree(leaves: DataFrame, most: int) -> DataFrame:
    """All nodes as (gid, level, idx, size, digest, below): size is the group's number of leaves, below the leaves under the node. leaves: the nodes of level 0; most: the largest size."""
    levels = leaves.select("gid", F.lit(0).alias("level"), "idx", "size", "digest", "below")
    out = [levels]
    for base in range(0, max(0, (most - 1).bit_length()), STEP):
        block = F.shiftright("idx", STEP).alias("block")
        members = F.sort_array(F.collect_list(F.struct("idx", "digest", "below")))  # 2**STEP at most
        blocks = levels.where(F.col("size") > (1 << base)).groupBy("gid", "size", block).agg(members.alias("l0"))
        for i in range(1, STEP + 1):
            blocks = blocks.withColumn(f"l{i}", _parents(F.col(f"l{i - 1}")))
        made = F.concat(*(_at_level(F.col(f"l{i}"), base + i) for i in range(1, STEP + 1)))
        nodes = blocks.select("gid", "size", F.explode(made).alias("n")).where(F.col("n.level") <= height(F.col("size")))
        above = materialize(nodes.select("gid", "n.level", "n.idx", "size", "n.digest", "n.below"), "nodes")
        out.append(above)
        levels = above.where(F.col("level") == base + STEP)
    nodes = out[0]
    for more in out[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _at_level(nodes: Column, level: int) -> Column:
    return F.transform(nodes, lambda x: F.struct(F.lit(level).alias("level"), x["idx"].alias("idx"), x["digest"].alias("digest"), x["below"].alias("below")))


def _parents(nodes: Column) -> Column:
    """The next level: every two consecutive nodes, or a last one alone, become their H."""

    def parent(i: Column) -> Column:
        a, b = F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)
        digest = F.unhex(hashed(text_of(a["digest"]), F.coalesce(text_of(b["digest"]), F.lit(""))))
        return F.struct(F.shiftright(a["idx"], 1).alias("idx"), digest.alias("digest"), (a["below"] + F.coalesce(b["below"], F.lit(0))).alias("below"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), parent)


@dataclass
class Manifest:
    """leaves: (doc_id, gid, idx, size, leaf, tampered), groups: (gid, subroot, ...), nodes: by coordinate `at`; root: hex."""

    leaves: DataFrame
    groups: DataFrame
    nodes: DataFrame
    root: str | None
    n_leaves: int
    n_groups: int


def build(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of docs. `tampered`, if given, is a condition on rows for which a second leaf, with n_chars + 1, is kept as well."""
    values = {c: F.col(c) for c in FIELDS}
    changed = leaf(values | {"n_chars": F.col("n_chars") + 1})
    has, group = F.col("lang").isNotNull(), F.coalesce("lang", F.lit(""))
    other = F.when(tampered, F.unhex(changed)) if tampered is not None else F.lit(None).cast("binary")
    own = docs.select(*FIELDS).select(has.alias("has"), group.alias("name"), F.col("doc_id").cast("long"), F.unhex(leaf(values)).alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("uid"))
    digests = materialize(own, "leaves")
    placed = indexed(digests, ["has", "name"], ["doc_id", "leaf", "uid"], "placed")
    sizes = materialize(placed.groupBy("has", "name").agg(F.max("size").alias("size")), "sizes")
    langs = indexed(sizes.withColumnRenamed("size", "rows"), [], ["has", "name"], "groups").select("has", "name", "rows", F.col("idx").alias("gid"), F.col("size").alias("n_groups"))
    n_groups, most, n = sizes.agg(F.count(F.lit(1)), F.max("size"), F.sum("size")).first()
    leaves = materialize(placed.join(_one_of(langs.select("has", "name", "gid"), n_groups), ["has", "name"]).select("doc_id", "gid", "idx", "size", "leaf", "tampered"), "indexed")
    release(digests)
    nodes = tree(leaves.select("gid", "idx", "size", F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("below")), most or 0)
    subroots = nodes.where(F.col("level") == height(F.col("size"))).select("gid", F.col("digest").alias("subroot"))
    groups = materialize(langs.join(subroots, "gid"), "subroots")
    top = tree(groups.select(F.lit(TOP).cast("long").alias("gid"), F.col("gid").alias("idx"), F.col("n_groups").alias("size"), F.col("subroot").alias("digest"), F.col("rows").alias("below")), n_groups)
    root = top.where(F.col("level") == height(F.col("size"))).select(text_of(F.col("digest"))).first()
    at = F.struct("gid", F.col("level").cast("int").alias("level"), "idx").alias("at")
    return Manifest(leaves, groups, nodes.unionByName(top).select(at, "digest", "below"), root[0] if root else None, n or 0, n_groups)


def _path(gid: Column, idx: Column, size: Column, first: int) -> Column:
    """Coordinates of the siblings from a node of level 0 to the top of its tree, in order; where there is none, the node is hashed alone."""

    def step(level: Column) -> Column:
        beside = F.call_function("shiftright", idx, level).bitwiseXOR(F.lit(1).cast("long"))
        there = beside < F.call_function("shiftright", size + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        return F.struct((level + first).alias("step"), there.alias("there"), F.struct(gid.alias("gid"), level.alias("level"), beside.alias("idx")).alias("at"))

    return F.when(size > 1, F.transform(F.sequence(F.lit(0), height(size) - 1), step)).otherwise(F.array())


def prove(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf; folded from the tampered leaf where there is one."""
    groups = manifest.groups.select("gid", "subroot", "n_groups")
    rows = manifest.leaves.join(_one_of(groups, manifest.n_groups), "gid")
    kind = "array<struct<step:int,there:boolean,at:struct<gid:bigint,level:int,idx:bigint>>>"
    path = F.concat(_path(F.col("gid"), F.col("idx"), F.col("size"), 0).cast(kind), _path(F.lit(TOP).cast("long"), F.col("gid"), F.col("n_groups"), 64).cast(kind))
    rows = rows.withColumn("path", path)
    asked = rows.select("gid", "idx", F.explode(F.filter("path", lambda s: s["there"])).alias("s")).select("gid", "idx", "s.step", "s.at")
    met = lookup(asked, "at", _asked(manifest), manifest.n_leaves)
    siblings = met.groupBy("gid", "idx").agg(F.sort_array(F.collect_list(F.struct("step", "digest"))).alias("siblings"))  # a path's length
    proved = rows.join(siblings, ["gid", "idx"], "left")
    hexes = F.transform(F.coalesce("siblings", F.array().cast("array<struct<step:int,digest:binary>>")), lambda s: text_of(s["digest"]))
    proved = proved.withColumn("siblings", hexes)
    fold = F.aggregate("path", F.struct(text_of(F.coalesce("tampered", "leaf")).alias("digest"), F.lit(0).alias("used")), _fold(F.col("siblings")), lambda s: s["digest"])
    out = proved.select("doc_id", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), F.lit(manifest.root).cast("string").alias("root"), F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _asked(manifest: Manifest) -> DataFrame:
    """The node table with `members`, how many leaves look a node up: those below its sibling."""
    beside = F.struct(F.col("at.gid"), F.col("at.level"), F.col("at.idx").bitwiseXOR(F.lit(1).cast("long")).alias("idx"))
    wide = manifest.nodes.where(F.col("below") * F.lit(1000) > manifest.n_leaves)  # at most a thousand a level
    weights = wide.select(beside.alias("at"), F.col("below").alias("members"))
    return manifest.nodes.select("at", "digest").join(F.broadcast(weights), "at", "left").withColumn("members", F.coalesce("members", F.lit(1).cast("long")))


def _fold(siblings: Column):
    def step(state: Column, s: Column) -> Column:
        mine, other = state["digest"], F.get(siblings, state["used"])
        left = (s["at"]["idx"] % 2) == 1  # the sibling stands to the right: the node itself is even
        joined = F.when(~s["there"], hashed(mine)).when(left, hashed(mine, other)).otherwise(hashed(other, mine))
        return F.struct(joined.alias("digest"), (state["used"] + s["there"].cast("int")).alias("used"))

    return step


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return prove(build(table(spark, sf_dir, "documents"), tampered))
