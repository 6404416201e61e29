"""Merkle manifest of a dataset by a butterfly exchange.

The leaves of a tree are numbered and cut into aligned blocks of ``fanout ** depth``. A block hashes its own subtree. Then, round by round,
groups of ``fanout`` neighbouring subtrees swap their roots: the members of a group are paired across its subtrees by their place
in them, every member hashes the parent for itself and keeps the roots it was sent as the next step of its proof. After the last
round each block knows the root and the upper part of its proofs; nothing has to be sent down again. A subtree at the end with
fewer blocks sends each of its roots to as many places as its neighbours have. The roots of the sources are the leaves of one more tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.operators.ranking import global_position
from winnow.session import broadcast_if_small, cut

FANOUT, DEPTH = 3, 5
STEPS = "array<struct<left:string,right:string>>"


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """SHA-256 of the values, each as ``-`` if null, else its UTF-8 length, a colon and itself."""
    return F.sha2(F.concat(*map(_part, values)), 256)


def levels_of(n: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree of n leaves; one leaf is its own root."""
    powers = [fanout**k for k in range(63) if fanout**k < 1 << 62]
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < n))


def _parents(level: Column, fanout: int) -> Column:
    starts = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / fanout).cast("int"))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(level, i * fanout + 1, F.lit(fanout)), ""), 256))


def blocks_of(leaves: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``tree, block, n_blocks, levels, root, members`` from ``leaves (tree, place, n, digest, payload)``: the subtree of each aligned block.

    ``members`` are the block's leaves as ``payload, steps``, the steps reaching up to ``root``, the block's own. A block holds at
    most ``fanout ** depth`` leaves."""
    width = fanout**depth
    block = F.floor(F.col("place") / width).cast("long")
    rows = leaves.groupBy("tree", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "payload"))).alias("leaves"), F.max("n").alias("n"))
    levels = levels_of(F.col("n"), fanout)
    rows = rows.select("tree", "block", F.ceil(F.col("n") / width).cast("long").alias("n_blocks"), levels.alias("levels"), F.least(levels, F.lit(depth)).alias("own"), "leaves")
    first = F.array(F.transform("leaves", lambda x: x["digest"]))
    grown = F.aggregate(F.sequence(F.lit(1), F.col("own")), first, lambda all_, _: F.concat(all_, F.array(_parents(F.element_at(all_, -1), fanout))))
    rows = rows.withColumn("tiers", F.when(F.col("own") > 0, grown).otherwise(first))

    def steps(i: Column) -> Column:
        def step(k: Column) -> Column:
            tier = F.get("tiers", k)
            at = F.floor(i / F.pow(F.lit(float(fanout)), k)).cast("int")
            run = (at / fanout).cast("int") * fanout
            return F.struct(F.array_join(F.slice(tier, run + 1, at - run), "").alias("left"), F.array_join(F.slice(tier, at + 2, run + fanout - at - 1), "").alias("right"))

        return F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.col("own") - 1), step)).otherwise(F.array().cast(STEPS))

    members = F.transform("leaves", lambda x, i: F.struct(x["payload"].alias("payload"), steps(i).alias("steps")))
    return rows.select("tree", "block", "n_blocks", "levels", F.get(F.element_at("tiers", -1), F.lit(0)).alias("root"), members.alias("members"))


def _answer(roots: Column, fanout: int):
    """What a member of a group keeps of the roots that it was sent."""

    def answer(letter: Column, i: Column) -> Column:
        left, right = F.slice(roots, F.lit(1), i), F.slice(roots, i + 2, F.lit(fanout))
        step = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
        own = letter["own"]
        return F.struct(*(own[c].alias(c) for c in ("block", "n_blocks", "levels")), F.concat(own["steps"], F.array(step)).alias("steps"))

    return answer


def exchanged(blocks: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``tree, block, root, steps``: the tree's root and the steps above the block's own, from ``blocks (tree, block, n_blocks, levels, root)``."""
    state = cut(blocks.select("tree", "block", "n_blocks", "levels", "root", F.array().cast(STEPS).alias("steps")))
    rounds = (state.agg(F.max("levels")).first()[0] or 0) - depth
    done = state.where(F.col("levels") <= depth)
    for r in range(max(0, rounds)):
        span = fanout**r
        block, lane = F.col("block"), F.col("block") % span
        group = F.floor(block / span).cast("long")
        # Blocks of the last subtree, if it is not full, speak for the places that it lacks.
        held = F.least(F.lit(span), F.col("n_blocks") - group * span)
        lanes = F.when((held < span) & (group % fanout > 0), F.sequence(lane, F.lit(span - 1), held)).otherwise(F.array(lane))
        sent = state.where(F.col("levels") > depth + r).select("*", (group % fanout).alias("digit"), F.floor(group / fanout).cast("long").alias("up"), F.explode(lanes).alias("lane"))
        real = F.col("lane") == lane
        letter = F.struct("digit", "root", F.when(real, F.struct("block", "n_blocks", "levels", "steps")).alias("own"))
        met = sent.groupBy("tree", "up", "lane").agg(F.sort_array(F.collect_list(letter)).alias("letters"))
        roots = F.transform("letters", lambda x: x["root"])

        told = met.select("tree", F.sha2(F.array_join(roots, ""), 256).alias("root"), F.inline(F.transform("letters", _answer(roots, fanout)))).where("block is not null")
        state = cut(told.select("tree", "block", "n_blocks", "levels", "root", "steps"))
        done = done.unionByName(state.where(F.col("levels") == depth + r + 1))
    return done.select("tree", "block", "root", "steps")


def manifest(leaves: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``leaf``'s row with ``subroot, root, steps`` from ``leaves (source, doc_id, leaf, shown)``.

    Leaves of a source (null is one) ascend by doc_id (null first), then leaf; sources ascend by UTF-8 bytes, null first. ``steps`` lead
    from the leaf to the root, each with the digests left and right of the way. Numbers come from one range order over all leaves, so a source
    with any share of the rows is cut like the rest; equal rows are leaves of their own. An empty table gives an empty manifest.
    """
    rows = leaves.withColumn("twin", F.monotonically_increasing_id())
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("twin")]
    placed = global_position(rows, order).drop("twin")
    sources = placed.groupBy("source").agg(F.min("position").alias("start"), F.count("*").alias("n"))
    sources = cut(global_position(sources, [F.col("start")], name="tree"))
    known = broadcast_if_small(sources.withColumnRenamed("source", "of"))
    numbered = placed.join(known, placed["source"].eqNullSafe(known["of"]))
    payload = F.struct("doc_id", "leaf", "shown")
    blocks = cut(blocks_of(numbered.select("tree", (F.col("position") - F.col("start")).alias("place"), "n", F.col("leaf").alias("digest"), payload.alias("payload")), fanout, depth))
    upper = exchanged(blocks, fanout, depth)
    subroots = cut(upper.where("block = 0").select(F.col("tree").alias("place"), F.col("root").alias("digest")))
    n = subroots.count()
    tops = blocks_of(subroots.select(F.lit(0).cast("long").alias("tree"), "place", F.lit(n).cast("long").alias("n"), "digest", F.struct(F.col("place").alias("of"), F.col("digest").alias("subroot")).alias("payload")), fanout, depth)
    tops = cut(tops)
    over = exchanged(tops, fanout, depth).withColumnsRenamed({"steps": "over", "root": "top"})
    top = tops.select("tree", "block", F.inline("members")).join(over.drop("tree"), "block")
    top = cut(top.select(F.col("payload.of").alias("tree"), "payload.subroot", F.col("top").alias("root"), F.concat("steps", "over").alias("over")))
    upper = upper.select("tree", "block", F.col("steps").alias("upper"))
    joined = blocks.select("tree", "block", "members").join(upper, ["tree", "block"]).join(broadcast_if_small(top), "tree")
    each = joined.select("subroot", "root", "upper", "over", F.inline("members"))
    return each.select("payload.doc_id", "payload.leaf", "payload.shown", "subroot", "root", F.concat("steps", "upper", "over").alias("steps"))


def folded(digest, steps) -> Column:
    """Root that a digest leads to over the steps of a proof."""
    return F.aggregate(steps, F.col(digest), lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def document_manifest(docs: DataFrame, shown: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Manifest of ``docs (doc_id, source, lang, n_chars, text, ...)``; ``shown`` is the text that is verified, by default the row's own."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    leaves = docs.select("source", "doc_id", leaf_of(*columns, text).alias("leaf"), leaf_of(*columns, text if shown is None else shown).alias("shown"))
    return manifest(leaves, fanout, depth)


def without_newlines(docs: DataFrame) -> Column:
    """The text without its line ends where the CRC-32 of the id's decimal digits is even, else as it is; a null id changes nothing."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def audit(docs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``, whose texts :func:`without_newlines` tampers with."""
    rows = document_manifest(docs, without_newlines(docs), fanout, depth)
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded("shown", "steps").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


CRC_SQL = """
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS tab)"""


def crc_of(text: str) -> str:
    """DuckDB expression: CRC-32 of an ASCII text, beside the one row of :data:`CRC_SQL`."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


def sql(fanout: int = FANOUT, levels: int = 16) -> str:
    """The audit as DuckDB SQL for trees of at most ``fanout ** levels`` leaves."""

    def part(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"

    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [
        f"""{CRC_SQL.strip()},
d AS (SELECT row_number() OVER () AS r, doc_id, source, {head} AS head, text, coalesce({crc_of('doc_id::VARCHAR')} % 2 = 0, false) AS even FROM documents, crc),
l AS (SELECT r, doc_id, source, sha256(head || {part('text')}) AS leaf, sha256(head || {part("(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)")}) AS shown FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source IS NOT NULL, source::BLOB) - 1 AS tree FROM l),
a0 AS (SELECT tree, place, n, leaf AS h FROM o)"""
    ]

    def climb(name: str, key: str, size: str) -> None:
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS (SELECT {key}, place // {fanout} AS place, any_value({size}) AS {size}, CASE WHEN any_value({size}) > {fanout**k} THEN sha256(string_agg(h, '' ORDER BY place)) ELSE any_value(h) END AS h "
                f"FROM {name}{k} GROUP BY {key}, place // {fanout})"
            )

    climb("a", "tree", "n")
    parts.append(f"b0 AS (SELECT 0 AS one, tree AS place, (SELECT count(*) FROM a{levels}) AS m, h FROM a{levels})")
    climb("b", "one", "m")

    def siblings(name: str, k: int, place: str, size: str, tree: str) -> str:
        at = f"({place} // {fanout**k})"
        inside = f"{tree} x.place // {fanout} = {at} // {fanout} AND {size} > {fanout**k}"
        return f"coalesce((SELECT string_agg(h, '' ORDER BY place) FROM {name}{k} x WHERE {inside} AND x.place {{}} {at}), '')"

    def folds() -> None:
        before = "SELECT o.*, shown AS f, '' AS proof FROM o"
        parts.append(f"c0 AS ({before})")
        at = 0
        for name, place, size, tree in (("a", "c.place", "c.n", "x.tree = c.tree AND"), ("b", "c.tree", "(SELECT any_value(m) FROM b0)", "")):
            for k in range(levels):
                left, right = (siblings(name, k, place, size, tree).format(s) for s in "<>")
                grown = f"SELECT c.* EXCLUDE (f, proof), CASE WHEN {size} > {fanout**k} THEN sha256({left} || f || {right}) ELSE f END AS f, proof || {left} || {right} AS proof FROM c{at} c"
                parts.append(f"c{at + 1} AS ({grown})")
                at += 1
        parts.append(f"z AS (SELECT c.*, a.h AS subroot, (SELECT h FROM b{levels}) AS root FROM c{at} c JOIN a{levels} a ON a.tree = c.tree)")

    folds()
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM z"
