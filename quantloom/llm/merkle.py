"""A Merkle manifest of a data set: leaves a row, a tree for each group, a tree over the groups, proofs by lookup.

Trees are built in rounds. A round takes blocks of at most BLOCK neighbouring nodes into one row each and hashes their
levels there, so a tree with a fan of 2 costs one shuffle for each ten levels. All nodes go into a table with their coordinates
(round, group, block, level, place). A proof's coordinates follow from a leaf's index and its group's size alone: each
leaf explodes those of the round's levels, joins them with the node table, collects what it found in order, and then adds
the proof of its block's root, which the block's leaves share. No key has more rows than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, staged

BLOCK = 1024  # nodes that one row may hold


def levels(fan: int) -> int:
    """Levels of a round: as many as a block of at most BLOCK nodes has."""
    return max(k for k in range(1, 11) if fan**k <= max(BLOCK, fan))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's values."""
    return digest(F.concat(*[encoded(v) for v in values]))


def next_level(nodes: Column, fan: int) -> Column:
    """The level above: digests of each ``fan`` neighbours, the last run with what is left."""
    runs = F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(fan)), lambda i: F.slice(nodes, i, fan))
    return F.transform(runs, lambda run: digest(F.array_join(run, "")))


def height(size: Column, fan: int) -> Column:
    """Levels above ``size`` nodes until one is left; exact, unlike logarithms."""
    powers = [fan**k for k in range(64) if fan**k < 2**62]
    return F.aggregate(F.array(*[F.lit(p) for p in powers]), F.lit(0), lambda n, p: n + (p < size).cast("int"))


def build(items: DataFrame, fan: int, scope: str) -> tuple[DataFrame, DataFrame]:
    """Trees over ``grp, idx, size, hash`` (hex). Gives the tops (``grp, top, size``) and the node table, with a round's
    blocks in it: ``round, grp, block, level, place, hash``, levels counted in the round, places in the block."""
    high = levels(fan)
    span = fan**high
    level, tables, tops, k = items.select("grp", "idx", "size", "hash"), [], None, 0
    while True:
        blocks = level.groupBy("grp", (F.col("idx") / span).cast("long").alias("block"), "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("nodes"))
        up = F.aggregate(F.sequence(F.lit(1), F.least(height(F.col("size"), fan), F.lit(high))), F.array("nodes"), lambda done, _: F.concat(done, F.array(next_level(F.element_at(done, -1), fan))))
        up = F.when(F.col("size") > 1, up).otherwise(F.array("nodes"))
        blocks = blocks.select("grp", "block", "size", F.posexplode(up).alias("level", "nodes"))
        nodes = blocks.select("grp", "block", "size", "level", F.posexplode("nodes").alias("place", "hash"))
        nodes = staged(nodes.withColumns({"round": F.lit(k), "hash": F.unhex("hash")}), "nodes", scope)
        tables.append(nodes)
        over = nodes.filter((F.col("size") <= span) & (F.col("level") == height(F.col("size"), fan))).select("grp", F.lower(F.hex("hash")).alias("top"))
        tops = over if tops is None else tops.unionByName(over)
        level = nodes.filter((F.col("size") > span) & (F.col("level") == high)).select("grp", F.col("block").alias("idx"), F.ceil(F.col("size") / span).alias("size"), F.lower(F.hex("hash")).alias("hash"))
        if level.isEmpty():
            break
        k += 1
    table = tables[0]
    for nodes in tables[1:]:
        table = table.unionByName(nodes)
    return staged(tops, "tops", scope), table


def siblings(items: DataFrame, nodes: DataFrame, k: int, fan: int) -> DataFrame:
    """``grp, idx, size`` of round ``k`` with ``own``: the digests beside the path through this round's levels, in order.
    Their coordinates come from index and size alone."""
    high = levels(fan)
    span = fan**high
    block, place = (F.col("idx") / span).cast("long"), (F.col("idx") % span).cast("long")
    within = F.least(F.lit(span).cast("long"), F.col("size") - block * span)  # nodes of the block
    none = F.array().cast("array<struct<level:int,place:int>>")

    def beside(level: int) -> Column:
        """Coordinates of the run's other nodes; there are none beside a block's only node."""
        mine, left = (place / fan**level).cast("long"), F.ceil(within / fan**level)
        start = mine - mine % fan
        others = F.filter(F.sequence(start, F.least(start + fan, left) - 1), lambda p: p != mine)
        return F.when(left > 1, F.transform(others, lambda p: F.struct(F.lit(level).alias("level"), p.cast("int").alias("place")))).otherwise(none)

    coordinates = [beside(level) for level in range(high)]
    keyed = items.select("grp", "idx", block.alias("block"), F.explode(F.concat(*coordinates)).alias("at")).select("grp", "idx", "block", "at.*")
    table = nodes.filter(F.col("round") == k).select("grp", "block", "level", "place", "hash")
    found = keyed.join(table, ["grp", "block", "level", "place"]).groupBy("grp", "idx")
    found = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "place", "hash"))), lambda x: x["hash"]).alias("own"))
    return items.join(found, ["grp", "idx"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<binary>")))


def proofs(items: DataFrame, nodes: DataFrame, rounds: int, fan: int, above: DataFrame, scope: str) -> DataFrame:
    """``items`` (``grp, idx, size`` and more) with ``proof``: siblings up to the group's top, then ``grp``'s from ``above``
    (``grp, proof`` and more, all carried down)."""
    span = fan ** levels(fan)
    carried = [c for c in above.columns if c not in ("grp", "proof")]
    parents = above.withColumn("idx", F.lit(0).cast("long"))
    groups = items.select("grp", "size").distinct()
    for k in reversed(range(rounds)):
        if k:
            size = F.ceil(F.col("size") / span**k)
            at = nodes.filter((F.col("round") == k) & (F.col("level") == 0)).select("grp", (F.col("block") * span + F.col("place")).alias("idx"), "size")
        else:
            size, at = F.col("size"), items
        here = siblings(at, nodes, k, fan).withColumn("_up", (F.col("idx") / span).cast("long"))
        up = parents.select(F.col("grp"), F.col("idx").alias("_up"), F.col("proof").alias("_more"), *carried)
        here = here.join(up, ["grp", "_up"]).withColumn("proof", F.concat("own", "_more")).drop("own", "_more", "_up")
        if k:
            # groups that end below this round have no nodes here: theirs come from ``above`` at their own last round
            ended = above.join(groups.filter(size <= 1).select("grp"), "grp", "left_semi").withColumn("idx", F.lit(0).cast("long"))
            parents = staged(here.select("grp", "idx", "proof", *carried).unionByName(ended), "proofs", scope)
    return here


def folded(start: Column, proof: Column, path: list[tuple[Column, Column]], fan: int) -> Column:
    """The root that a leaf's digest and its proof (binary digests) give; ``path``: index and size of each tree on the way up."""
    none = F.array().cast("array<struct<own:boolean,last:boolean>>")

    def walk(idx: Column, size: Column) -> Column:
        """The nodes of all runs on the way up one tree, the own one among them."""

        def places(level: Column) -> Column:
            unit = F.lit(fan).cast("double") ** level
            mine, nodes = F.floor(idx / unit), F.ceil(size / unit)
            first = mine - mine % fan
            last = F.least(first + fan, nodes) - 1
            return F.transform(F.sequence(first, last), lambda p: F.struct((p == mine).alias("own"), (p == last).alias("last")))

        return F.when(size > 1, F.flatten(F.transform(F.sequence(F.lit(0), height(size, fan) - 1), places))).otherwise(none)

    steps = [walk(idx, size) for idx, size in path]

    def step(s, x):
        text = F.concat(s["run"], F.when(x["own"], s["hash"]).otherwise(F.lower(F.hex(F.get(proof, s["k"])))))
        return F.struct((s["k"] + (~x["own"]).cast("int")).alias("k"), F.when(x["last"], F.lit("")).otherwise(text).alias("run"), F.when(x["last"], digest(text)).otherwise(s["hash"]).alias("hash"))

    begin = F.struct(F.lit(0).alias("k"), F.lit("").alias("run"), start.alias("hash"))
    return F.aggregate(F.concat(*steps), begin, step)["hash"]


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", tampered: dict[str, Column] | None = None, fan: int = 2, scope: str = "query") -> DataFrame:
    """A row for each document: ``doc_id, leaf, subroot, root, proof`` (digests from the leaf's level to the root),
    ``folded_root, verified``.

    A leaf is the digest of the row's ``columns``. Leaves of a ``group`` ascend by ``order`` (nulls first, equal ones by their
    digests), groups by name (null first). ``tampered``: columns as an attacker left them; the fold begins with the leaf of
    those, with the siblings of the true tree, and ``verified`` says whether it still meets the root. Null values have
    a code of their own, so null and empty texts differ. Further columns are ignored; an empty table gives no rows.
    """
    hashed = leaf(*[F.col(c) for c in columns])
    forged = leaf(*[(tampered or {}).get(c, F.col(c)) for c in columns]) if tampered else hashed
    name = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(F.col(order).alias("doc_id"), name.alias("grp"), F.unhex(hashed).alias("leaf"), F.unhex(forged).alias("start"))
    leaves = staged(ranked(staged(rows, "leaves", scope), ("grp",), F.col("doc_id"), F.col("leaf"), scope=scope), "ranked", scope)

    hexed = lambda c: F.lower(F.hex(c))
    tops, nodes = build(leaves.withColumn("hash", hexed("leaf")), fan, scope)
    groups = ranked(tops.select("grp", "top"), (), F.col("grp"), scope=scope)
    groups = staged(groups.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "idx", "size", F.col("top").alias("hash")), "groups", scope)
    root, over = build(groups, fan, scope)
    root = root.select("grp", F.array().cast("array<binary>").alias("proof"), F.col("top").alias("root"))
    rounds = lambda table: (table.agg(F.max("round")).first()[0] or 0) + 1
    above = proofs(groups, over, rounds(over), fan, root, scope)
    above = staged(above.select(F.col("name").alias("grp"), "proof", "root", F.col("hash").alias("subroot"), F.col("idx").alias("_idx"), F.col("size").alias("_size")), "above", scope)

    out = proofs(leaves, nodes, rounds(nodes), fan, above, scope)
    way = [(F.col("idx"), F.col("size")), (F.col("_idx"), F.col("_size"))]
    out = out.withColumn("folded_root", folded(hexed("start"), F.col("proof"), way, fan))
    return out.select("doc_id", hexed("leaf").alias("leaf"), "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
