"""Prefix trie of conversations by a splitter skeleton.

A conversation is cut into *strands* of at most :data:`TURNS` turns, so no row grows with it. A strand's key is its start (number of the
strand and a digest of all turns before it) followed by the digests of its turns: in key order the trie is met in preorder. Rows are
dealt to shards by sampled splitter keys. The trie of the splitters' paths, the skeleton, is broadcast: any other node lies in one
shard, which finishes it in one pass over its sorted rows. Skeleton nodes leave one partial row in each shard that
holds members of theirs, and these are summed up in one reduction. What has to reach the driver are the splitters, one key for each shard.

Conversations longer than a strand make a forest: every further strand hangs below the last turn of the one before. Sums over such a
forest need no walk along it: a node belongs to its smallest conversation, which then holds everything below the node on its
own path, so the sum below a start is that of what its members own, less what its owner owns above.
"""

from __future__ import annotations

import hashlib
import os.path
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from winnow.session import broadcast_if_small, cut

#: Turns of a strand.
TURNS = 256
#: Bytes of a strand's start and of a turn in a key.
START, STEP = 20, 16
#: Conversation ids in one piece of a skeleton node's list.
PIECE = 4096
#: Strands sampled for each shard to find the splitters.
SAMPLED = 64

NODE = (
    "kind string, node int, parent_node int, start binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, goes_on boolean, size long, shard int, place long, piece string, ends_sha256 string"
)
NODE_ARROW = pa.schema(
    [("kind", pa.string()), ("node", pa.int32()), ("parent_node", pa.int32()), ("start", pa.binary()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))]
    + [("goes_on", pa.bool_()), ("size", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("piece", pa.string()), ("ends_sha256", pa.string())]
)
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, size``: 128 bits of the SHA-256 of role and text, and the text's bytes; null counts as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(turns with place, conv_id and n)``: places count from 0 by turn (null first), then role, then digest.

    One range order over all turns; a conversation that holds any share of them is cut like the rest, and what its turns before a
    partition count is added from one row for each partition that it reaches.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    local = cut(turns.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "digest", "size", F.monotonically_increasing_id().alias("at")))
    local = local.withColumn("part", F.shiftright("at", 33))
    of = W.partitionBy("conv_id")
    runs = local.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(of.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("conv_id", "part", "first", before.alias("before"), F.sum("here").over(of).alias("n")))
    places = local.join(runs.drop("n"), ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("place"), "digest", "size")
    return cut(places), runs.where("before = 0").select("conv_id", "n")


def rebuilt(turns: DataFrame, convs: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of the rebuilt conversations: the first h turns of conversation ``c - c % family`` before what follows
    the first h turns of ``c``, where h is the CRC-32 of the id's decimal digits modulo ``heads``."""
    c = F.col("conv_id")
    own = convs.select("conv_id", "n", (c - c % family).alias("base"), (F.crc32(c.cast("string").cast("binary")) % heads).alias("h"))
    of_base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    own = cut(own.join(of_base, "base", "left").select("conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    # Which turns stay is known from the id alone; the shift of the rest is carried by one head marker of each conversation.
    h = F.crc32(c.cast("string").cast("binary")) % heads
    tails = turns.where(F.col("place") >= h)
    shift = own.where("taken <> h").select("conv_id", (F.col("h") - F.col("taken")).alias("missing"))
    tails = tails.join(shift, "conv_id", "left").select("conv_id", (F.col("place") - F.coalesce("missing", F.lit(0))).alias("place"), "digest", "size")
    first = turns.where(F.col("place") < heads - 1).withColumnRenamed("conv_id", "base")
    copied = first.join(own.select("base", "conv_id", "h"), "base").where("place < h").select("conv_id", "place", "digest", "size")
    return tails.unionByName(copied), own.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def strands_of(turns: DataFrame, lengths: DataFrame, most: int = TURNS) -> tuple[DataFrame, bool]:
    """``conv_id, strand, key, sizes, ends, goes_on`` and whether any conversation has a second strand."""
    n, strand = F.col("n"), (F.col("n") / most).cast("long")
    last = F.struct(strand.alias("strand"), ((n % most > 0) | (n == 0)).alias("ends"))
    full = F.struct((strand - 1).alias("strand"), F.lit(True).alias("ends"))
    marks = lengths.select("conv_id", F.explode(F.when((n > 0) & (n % most == 0), F.array(last, full)).otherwise(F.array(last))).alias("m")).select("conv_id", "m.*")
    turn = F.struct("place", "digest", "size")
    rows = turns.select("conv_id", (F.col("place") / most).cast("long").alias("strand"), turn.alias("t"), F.lit(None).cast("boolean").alias("ends"))
    rows = rows.unionByName(marks.withColumn("t", F.lit(None).cast(rows.schema["t"].dataType)))
    strands = rows.groupBy("conv_id", "strand").agg(F.sort_array(F.collect_list("t")).alias("turns"), F.coalesce(F.max("ends"), F.lit(False)).alias("ends"))
    deep = lengths.where(F.col("n") >= most).limit(1).count() > 0
    prefix: Column = F.lit("0" * 2 * (START - 4))
    if deep:
        strands = cut(strands)

        def xor(salt: int) -> Column:
            return F.aggregate("turns", F.lit(0).cast("long"), lambda all_, t: all_.bitwiseXOR(F.xxhash64(F.lit(salt), t["place"], t["digest"])))

        before = W.partitionBy("conv_id").orderBy("strand").rowsBetween(W.unboundedPreceding, -1)
        starts = strands.select("conv_id", "strand", xor(1).alias("a"), xor(2).alias("b"))
        starts = starts.select("conv_id", "strand", *(F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(x) for x in ("a", "b")))
        strands = strands.join(starts, ["conv_id", "strand"])
        prefix = F.concat(*(F.lpad(F.hex(x), 16, "0") for x in ("a", "b")))
    key = F.unhex(F.concat(F.lpad(F.hex("strand"), 8, "0"), prefix, F.array_join(F.transform("turns", lambda t: t["digest"]), "")))
    goes_on = (F.size("turns") == most) & ~F.col("ends")
    return cut(strands.select("conv_id", "strand", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"), "ends", goes_on.alias("goes_on"))), deep


def splitters_of(strands: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards - 1`` keys in order, from a sample of :data:`SAMPLED` strands for each shard. They decide the balance only."""
    rows = strands.select("key", "conv_id")
    share = shards * SAMPLED / max(1, rows.count())
    rows = rows.sample(share, seed=11) if share < 1 else rows
    parts = rows.repartitionByRange(shards, "key", "conv_id").withColumn("part", F.spark_partition_id())
    least = parts.groupBy("part").agg(F.min(F.struct("key", "conv_id")).alias("s")).select("s.*").collect()
    return sorted((bytes(r["key"]), r["conv_id"]) for r in least)[1:]


class Skeleton:
    """Trie of the splitters' paths: ``ids[i][j]`` is the node of splitter i at step j; each node has its ancestors and child count."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.ids: list[list[int]] = []
        self.parents: list[int | None] = []
        self.depths: list[tuple[int, int]] = []
        last, path = b"", []
        for key, _ in splitters:
            path = path[: steps_shared(last, key)]
            for j in range(len(path), (len(key) - START) // STEP + 1):
                path.append(len(self.parents))
                self.parents.append(path[-2] if j else None)
                self.depths.append((int.from_bytes(key[:4], "big"), j))
            self.ids.append(list(path))
            last = key

    def rows(self) -> list[tuple]:
        """``node, parent_node, strand, step, skeleton_children, above`` (the node itself and its ancestors)."""
        kids = [0] * len(self.parents)
        above: list[list[int]] = []
        for i, up in enumerate(self.parents):
            above.append([*(above[up] if up is not None else []), i])
            if up is not None:
                kids[up] += 1
        return [(i, up, *self.depths[i], kids[i], above[i]) for i, up in enumerate(self.parents)]


def steps_shared(a: bytes, b: bytes) -> int:
    """Nodes that the paths of two keys share, the start included."""
    same = len(os.path.commonprefix((a, b)))
    return 0 if same < START else (same - START) // STEP + 1


class _Node:
    __slots__ = ("ends", "ends_n", "goes_on", "id", "kids", "least", "leaves", "n", "pieces", "rows", "saved", "size", "step")

    def __init__(self, node_id, step, size):
        self.id, self.step, self.size = node_id, step, size
        self.n = self.kids = self.leaves = self.saved = self.ends_n = self.pieces = 0
        self.least = None
        self.goes_on = False
        self.ends = [] if node_id is not None else hashlib.sha256()
        self.rows: list[tuple] = []


class _Shard:
    """One pass over rows in key order with the open path as its stack. A finished node waits for its parent, whose
    smallest conversation it names, unless the parent is a skeleton node."""

    def __init__(self, skeleton: Skeleton, most: int):
        self.skeleton, self.most = skeleton, most
        self.path: list[_Node] = []
        self.out: list[tuple] = []
        self.key, self.shard = b"", -1

    def add(self, shard, key, conv, sizes, ends, goes_on, more_kids, more_leaves, more_saved):
        shared = steps_shared(self.key, key) if shard == self.shard else 0
        while len(self.path) > shared:
            self.close()
        if len(self.path) <= len(sizes):
            left = self.border(shard - 1, key)
            right = self.border(shard, key)
            for j in range(len(self.path), len(sizes) + 1):
                node = left[j] if j < len(left) else right[j] if j < len(right) else None
                self.path.append(_Node(node, j, sizes[j - 1] if j else 0))
        self.key, self.shard = key, shard
        top = self.path[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        top.goes_on |= goes_on
        top.kids += more_kids
        top.leaves += more_leaves
        top.saved += more_saved
        if ends:
            if top.id is None:
                top.ends.update(b",%d" % conv if top.ends_n else b"%d" % conv)
                top.ends_n += 1
            else:
                top.ends.append(conv)
                if len(top.ends) >= PIECE:
                    self.piece(top)

    def border(self, i, key) -> list[int]:
        """Skeleton nodes on the row's path that splitter i has."""
        if not 0 <= i < len(self.skeleton.splitters):
            return []
        return self.skeleton.ids[i][: steps_shared(self.skeleton.splitters[i][0], key)]

    def piece(self, node: _Node):
        self.out.append(("piece", node.id, None, None, *[None] * 7, None, None, self.shard, node.pieces, ",".join(map(str, node.ends)), None))
        node.pieces += 1
        node.ends = []

    def close(self):
        node = self.path.pop()
        up = self.path[-1] if self.path else None
        strand = int.from_bytes(self.key[:4], "big")
        leaves, saved = node.leaves, node.saved
        if node.id is None:
            leaves += not node.kids and not node.goes_on and not (strand and not node.step)
            saved += (node.n - 1) * node.size
            self.out.extend((*r[:6], node.least, *r[7:]) for r in node.rows)
            start = self.key[:START] if not node.step else None
            row = ("node", None, None, start, node.least, strand * self.most + node.step, None, node.n, node.kids, leaves, saved, None, None, None, None, None, node.ends.hexdigest())
            if up is not None and up.id is None:
                up.rows.append(row)
            else:
                self.out.append(row if up is None else (*row[:2], up.id, *row[3:]))
        else:
            if node.ends:
                self.piece(node)
            self.out.append(("part", node.id, None, self.key[:START], node.least, None, None, node.n, node.kids, leaves, saved, node.goes_on, node.size, None, None, None, None))
        if up is not None:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
            up.kids += node.id is None
            up.leaves += leaves
            up.saved += saved

    def batch(self, at_least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= at_least:
            columns = zip(*self.out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE_ARROW, strict=True)], schema=NODE_ARROW)
            self.out = []


def sweep(strands: DataFrame, skeleton: Skeleton, shards: int, most: int) -> DataFrame:
    """Finished nodes, partial rows of skeleton nodes and pieces of their lists of conversations."""
    given = strands.sparkSession.sparkContext.broadcast(skeleton)

    def deal(batches):
        splitters = given.value.splitters
        for batch in batches:
            keys, convs = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            shard = pa.array([bisect_right(splitters, x) for x in zip(keys, convs, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], [*batch.schema.names, "shard"])

    def walk(batches):
        state = _Shard(given.value, most)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "conv_id", "sizes", "ends", "goes_on", "more_children", "more_leaves", "more_saved")), strict=True):
                state.add(*row)
                yield from state.batch(5000)
        while state.path:
            state.close()
        yield from state.batch()

    dealt = strands.mapInArrow(deal, StructType([*strands.schema.fields, StructField("shard", IntegerType())]))
    return cut(dealt.repartitionById(shards, "shard").sortWithinPartitions("key", "conv_id").mapInArrow(walk, NODE))


def _digest_pieces(batches):
    """SHA-256 over the pieces of each skeleton node, in order; only the state of one digest is held."""
    out = pa.schema([("node", pa.int32()), ("ends_sha256", pa.string())])
    at, digest = None, None
    for batch in batches:
        done = []
        for node, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if node != at:
                if at is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = node, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out, strict=True)], schema=out)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([digest.hexdigest()])], schema=out)


def reduced(found: DataFrame, skeleton: Skeleton, most: int) -> DataFrame:
    """All nodes, with those of the skeleton put together from their partial rows."""
    spark = found.sparkSession
    frame = spark.createDataFrame(skeleton.rows(), "node int, up int, strand int, step int, skeleton_children long, above array<int>")
    parts = found.where("kind = 'part'").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("goes_on").alias("goes_on"), F.max("size").alias("size"), F.min("start").alias("start")
    )
    known = cut(frame.join(parts, "node").withColumn("n_children", F.col("n_children") + F.col("skeleton_children")))
    leaf = (F.col("n_children") == 0) & ~F.col("goes_on") & ~((F.col("strand") > 0) & (F.col("step") == 0))
    own = known.select(F.explode("above").alias("node"), leaf.cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("own"))
    own = own.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    names = known.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    pieces = found.where("kind = 'piece'").select("node", "shard", "place", "piece").repartition("node").sortWithinPartitions("node", "shard", "place")
    ends = pieces.mapInArrow(_digest_pieces, "node int, ends_sha256 string")
    nothing = F.lit(hashlib.sha256().hexdigest())
    wide = known.join(own, "node").join(names, "up", "left").join(ends, "node", "left")
    start = F.when(F.col("step") == 0, F.col("start")).alias("start")
    border = wide.select(
        start, "conv_id", (F.col("strand") * most + F.col("step")).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    whole = found.where("kind = 'node' and parent_node is null").select(border.columns)
    below = found.where("kind = 'node' and parent_node is not null").drop("parent_conv_id")
    below = below.join(broadcast_if_small(names.withColumnRenamed("up", "parent_node")), "parent_node").select(border.columns)
    return whole.unionByName(below).unionByName(border)


def trie(turns: DataFrame, lengths: DataFrame, most: int = TURNS, shards: int | None = None) -> DataFrame:
    """One row for each distinct sequence of first turns of ``turns (conv_id, place, digest, size)``; ``lengths (conv_id, n)`` names
    every conversation once, those without turns too. Columns are :data:`RESULT`. No conversation gives no node."""
    shards = shards or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strands, deep = strands_of(turns, lengths, most)
    skeleton = Skeleton(splitters_of(strands, shards))

    def nodes(rows: DataFrame) -> DataFrame:
        return reduced(sweep(rows, skeleton, shards, most), skeleton, most)

    plain = strands.withColumns({c: F.lit(0).cast("long") for c in ("more_children", "more_leaves", "more_saved")})
    found = nodes(plain)
    if deep:
        starts = cut(found.where(F.col("start").isNotNull() & (F.col("depth") > 0)).select("start", "conv_id", "depth", "n_children", "n_leaves", "saved_tokens"))
        found = nodes(strands.join(below_starts(strands, starts, most), ["conv_id", "strand"], "left").na.fill(0, ["more_children", "more_leaves", "more_saved"]))
    return found.where(F.col("start").isNull() | (F.col("depth") == 0)).select(*RESULT)


def below_starts(strands: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """What hangs below the end of a strand, given to the strand of the start's owner: children, leaves and saved bytes."""
    sums = ("n_leaves", "saved_tokens")
    owned = starts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in sums))
    members = strands.where("strand > 0").select("conv_id", F.substring("key", 1, START).alias("start")).join(owned, "conv_id")
    all_of = members.groupBy("start").agg(*(F.sum(c).alias(f"all_{c}") for c in sums))
    before = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    above = starts.withColumns({f"above_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})
    return above.join(all_of, "start").select(
        "conv_id", ((F.col("depth") / most).cast("long") - 1).alias("strand"), F.col("n_children").alias("more_children"),
        (F.col("all_n_leaves") - F.col("above_n_leaves")).alias("more_leaves"), (F.col("all_saved_tokens") - F.col("above_saved_tokens")).alias("more_saved"),
    )


def conversation_trie(conversations: DataFrame, most: int = TURNS, shards: int | None = None) -> DataFrame:
    """Trie of the rebuilt conversations of ``conversations (conv_id, turn, role, text, ...)``.

    Rows without conv_id belong to no conversation and are left out. A null turn comes first; equal turns are ordered by role,
    then by digest; repeated rows are turns of their own. A null role or text is empty. A conversation of which nothing is left is a
    member of the root. Other columns are ignored; an empty table has no node. The list of conversations
    that end at a node is digested in order, as SHA-256 asks for: for a group of copies of any size one task reads its ids, in pieces.
    """
    turns, convs = numbered(turns_of(conversations))
    return trie(*rebuilt(turns, convs), most, shards)
