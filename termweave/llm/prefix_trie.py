"""The prefix trie of conversations by fixed-length block hashing.

Every turn has a 128-bit digest of its place, role and text; the sums of these digests along a conversation (in four parts of
32 bits) name its prefixes, so a prefix is a key that any task can build and no path is ever carried along. Conversations are
grouped by the prefixes at the ends of blocks of four turns first: an edge is one block under one parent block, with the number
of its conversations and the smallest of them. Where a parent has one block below it, the turns of one conversation stand for
all. Only where siblings diverge are the turns of the distinct blocks grouped one by one.

Totals over subtrees take no rounds over the depth. A node belongs to its smallest member; along that conversation the values
of the nodes it owns are summed up from the end, and every prefix of the conversation receives what lies behind it. Each turn
adds one row to one grouped sum.

Long conversations are numbered and summed in stretches of 4,096 turns, so none is held by one task; joins whose keys may be
shared by many rows are salted. The ids of a node's ends are put in order in stretches of 4,096 ids; a digest of the whole
list is sequential by its nature, so one task streams the stretches of one node through it and holds one at a time.

Defined results. Rows without conv_id belong to no conversation. Turns are in order of turn (null first), then role and text;
null role or text is the empty string. Repeated rows are repeated turns. Conversations without turns are members of the root.
An empty table gives no rows. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.llm.common import written
from termweave.session import salted_join

BLOCK = 4
#: Turns or ids one task puts in order; a multiple of BLOCK.
STRETCH = 4096
_PARTS = ("s1", "s2", "s3", "s4")
KEY = ["depth", "ka", "kb"]


def ordered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, body, bytes): turns numbered from 1, the digest of role and text, and the UTF-8 bytes of the text."""
    said, words = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    body = F.md5(F.concat(F.length(said), F.lit(" "), said, words).cast("binary"))
    turns = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), said.alias("said"), words.alias("words"),
        body.alias("body"), F.octet_length(words).cast("bigint").alias("bytes"), F.floor(F.col(turn) / STRETCH).alias("stretch"),
    )
    ahead = W.partitionBy("conv").orderBy(F.asc_nulls_first("stretch")).rowsBetween(W.unboundedPreceding, -1)
    sizes = turns.groupBy("conv", "stretch").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(ahead))
    place = F.row_number().over(W.partitionBy("conv", "stretch").orderBy(F.asc_nulls_first("turn"), "said", "words"))
    more = sizes.filter("before > 0").select(F.col("conv").alias("c"), F.col("stretch").alias("s"), "before")
    joined = turns.withColumn("place", place).join(more, (F.col("conv") == F.col("c")) & F.col("stretch").eqNullSafe(F.col("s")), "left")
    return joined.select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).cast("bigint").alias("pos"), "body", "bytes")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations of which those of a group share a head, and all ids: the first h turns of conversation c - c % group, then
    c's own turns after its first h, with h = crc32(c) % heads. A head has `heads` - 1 turns at most and `group` takers."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = turns.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % group).alias("first"), h.alias("h"))
    start = turns.filter(F.col("pos") < heads).withColumnRenamed("conv", "first")
    shared = convs.join(start, "first").filter("pos <= h").select("conv", "pos", "body", "bytes")
    sizes = start.groupBy("first").agg(F.count("*").alias("n"))
    taken = convs.join(sizes, "first", "left").select("conv", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    rest = salted_join(turns.withColumn("h", h).filter("pos > h"), taken, ["conv"], ["pos"])
    own = rest.select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "body", "bytes")
    return shared.unionByName(own), convs.select("conv")


def _part(pos: Column, body: Column, k: int) -> Column:
    name = F.md5(F.concat(pos.cast("string"), F.lit(" "), body).cast("binary"))
    return F.conv(F.substring(name, 8 * k + 1, 8), 16, 10).cast("bigint")


def _pair(a: Column, b: Column) -> Column:
    low = 2**32
    return F.shiftleft(F.pmod(a, F.lit(low)), 32).bitwiseOR(F.pmod(b, F.lit(low)))


def _summed(rows: DataFrame, columns: list[str], backwards: bool = False) -> DataFrame:
    """The sums of columns along each conversation (conv, pos, stretch), in stretches; `more`: whether a stretch follows."""
    order = F.desc if backwards else F.asc
    ahead = W.partitionBy("conv").orderBy(order("stretch")).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "stretch").agg(*[F.sum(c).alias(c) for c in columns])
    before = sums.select(
        "conv", "stretch", *[F.sum(c).over(ahead).alias(f"{c}_before") for c in columns],
        (F.max("stretch").over(W.partitionBy("conv")) > F.col("stretch")).alias("more"), F.count("*").over(W.partitionBy("conv")).alias("n"),
    ).filter("n > 1").drop("n")
    inside = W.partitionBy("conv", "stretch").orderBy(order("pos")).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({c: F.sum(c).over(inside) for c in columns}).join(before, ["conv", "stretch"], "left")
    return local.withColumns(
        {c: F.col(c) + F.coalesce(f"{c}_before", F.lit(0)) for c in columns} | {"more": F.coalesce("more", F.lit(False))}
    ).drop(*[f"{c}_before" for c in columns])


def paths(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every prefix of every conversation: (conv, pos, bytes), its key (ka, kb), that of its parent (pa, pb) and of the start of
    its block (ba, bb), the block and whether the conversation ends there."""
    rows = turns.select(
        "conv", "pos", "bytes", F.floor((F.col("pos") - 1) / STRETCH).alias("stretch"), F.floor((F.col("pos") - 1) / block).alias("block"),
        *[_part(F.col("pos"), F.col("body"), k).alias(f"t{k + 1}") for k in range(4)],
    ).withColumns({s: F.col(f"t{k + 1}") for k, s in enumerate(_PARTS)})
    summed = _summed(rows, list(_PARTS))
    here = W.partitionBy("conv", "stretch", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    within = {f"b{k}": F.sum(f"t{k}").over(here) for k in range(1, 5)}
    last = F.lead("pos").over(W.partitionBy("conv", "stretch").orderBy("pos")).isNull() & ~F.col("more")
    whole = summed.withColumns(within | {"ends": last})

    def key(back: str | None) -> list[Column]:
        s = [F.col(f"s{k}") - (F.col(f"{back}{k}") if back else F.lit(0)) for k in range(1, 5)]
        return [_pair(s[0], s[1]), _pair(s[2], s[3])]

    named = {}
    for back, (a, b) in ((None, ("ka", "kb")), ("t", ("pa", "pb")), ("b", ("ba", "bb"))):
        named[a], named[b] = key(back)
    return whole.select("conv", "pos", "bytes", "stretch", "block", "ends", *[c.alias(n) for n, c in named.items()])


def block_edges(prefixes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct blocks under their parents: n conversations, the smallest of them, and whether siblings stand beside them."""
    reached = prefixes.filter((F.col("pos") % block == 0) | F.col("ends"))
    edges = reached.groupBy("block", "pos", "ka", "kb").agg(
        F.count("*").alias("n"), F.min("conv").alias("conv"), F.first("ba").alias("ba"), F.first("bb").alias("bb")
    )
    beside = edges.groupBy("block", "ba", "bb").agg((F.count("*") > 1).alias("diverging"))
    return salted_join(edges, beside, ["block", "ba", "bb"], ["ka", "kb"]).select("conv", "block", "n", "diverging")


def nodes(prefixes: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(depth, ka, kb, pa, pb, conv, n, bytes) of every node, the root included."""
    edges = block_edges(prefixes, block)
    turns = prefixes.select("conv", "block", F.col("pos").alias("depth"), "ka", "kb", "pa", "pb", "bytes").join(edges, ["conv", "block"])
    columns = [*KEY, "pa", "pb", "conv", "n", "bytes"]
    alone = turns.filter(~F.col("diverging")).select(*columns)
    split = turns.filter("diverging").groupBy(*KEY).agg(
        F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.first("bytes").alias("bytes")
    )
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).filter("n > 0").select(
        zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), F.lit(None).cast("bigint").alias("pa"), F.lit(None).cast("bigint").alias("pb"),
        "conv", "n", zero.alias("bytes"),
    )
    return alone.unionByName(split.select(*columns)).unionByName(root)


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined lists of each key; rows come in order of key and stretch, and one list is held at a time."""
    now = digest = None
    schema = pa.schema([(c, pa.int64()) for c in KEY] + [("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for *key, ids in zip(*[batch.column(c).to_pylist() for c in KEY], batch.column("ids")):
            if key == now:
                digest.update(b",")
            else:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            digest.update(ids.as_buffer())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), schema)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*now, digest.hexdigest()), schema)], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, ka, kb, ends_sha256): digest of the ids that end at a node, ascending and joined by commas."""
    lists = ends.groupBy(*KEY, F.floor(F.col("conv") / STRETCH).alias("stretch")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )
    sorted_lists = lists.repartition(*KEY).sortWithinPartitions(*KEY, "stretch")
    return sorted_lists.select(*KEY, "ids").mapInArrow(_digested, "depth long, ka long, kb long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of `turns` (conv, pos, body, bytes); `convs` names all conversations, turnless ones too.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    prefixes = written(paths(turns, block), "trie-paths")
    all_convs = written(convs, "trie-convs")
    found = written(nodes(prefixes, all_convs, block), "trie-nodes")
    children = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(
        F.count("*").alias("n_children")
    )
    known = written(found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-known")
    owned = known.filter("depth > 0").select(
        "conv", F.col("depth").alias("pos"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaf")
    )
    # unique keys on both sides: a node is named by its smallest member and its depth
    valued = prefixes.select("conv", "pos", "stretch", "ka", "kb").join(owned, ["conv", "pos"], "left").fillna(0, ["saved", "leaf"])
    behind = _summed(valued, ["saved", "leaf"], backwards=True).filter("saved > 0 or leaf > 0").withColumn("depth", F.col("pos"))
    top = behind.filter("pos = 1").withColumns({c: F.lit(0).cast("bigint") for c in KEY})
    totals = behind.select(*KEY, "saved", "leaf").unionByName(top.select(*KEY, "saved", "leaf")).groupBy(*KEY).agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")
    )
    ended = prefixes.filter("ends").select("conv", F.col("pos").alias("depth"), "ka", "kb")
    turnless = all_convs.join(prefixes.filter("pos = 1").select("conv"), "conv", "left_anti")
    ends = ended.unionByName(turnless.select("conv", *[F.lit(0).cast("bigint").alias(c) for c in KEY]))
    above = known.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv").alias("parent_conv_id"))
    below = salted_join(known, above, ["depth", "pa", "pb"], ["ka", "kb"], "left")
    return (
        below.join(totals, KEY, "left").join(end_digests(ends), KEY, "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
            F.greatest(F.coalesce("n_leaves", F.lit(0)), (F.col("n_children") == 0).cast("bigint")).alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0)).cast("bigint").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
