"""Anchor assignment against the sequential rule, including hot blocks and carried chunks."""

import random

import pytest
from pyspark.sql import functions as F

from winnow.functions.hashing import band_keys, band_layout, hamming
from winnow.operators import groups, leaders, scenes
from winnow.operators.ranking import gap_sessions, global_position, rank_within


def sequential(rows, match):
    anchors, out = [], {}
    for node, value in rows:
        hit = next((a for a, v in anchors if match(value, v)), None)
        if hit is None:
            anchors.append((node, value))
        out[node] = node if hit is None else hit
    return out


@pytest.mark.parametrize("pivots", [2, 5, 64])
def test_hot_block_equals_sequential_walk(spark, pivots):
    rng = random.Random(pivots)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = []
    for i in range(160):
        h = base[0] if i % 3 == 0 else rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            h ^= 1 << rng.randint(0, 62)
        rows.append((i, h))
    df = spark.createDataFrame(rows, "node long, h long")
    got = leaders.assign_leaders(
        df, node="node", blocks=band_keys("h", 6), features=["h"], pivots=pivots,
        match=lambda a, b: hamming(a("h"), b("h")) <= 6,
    )
    want = sequential(rows, lambda x, y: bin(x ^ y).count("1") <= 6)
    assert {r["node"]: r["leader"] for r in got.collect()} == want


def test_rounds_grow_with_the_log_of_a_hot_block(spark, monkeypatch):
    """Rows of one block that match nothing: every round takes four times as many pivots."""
    rounds = []
    inner = leaders._round
    monkeypatch.setattr(leaders, "_round", lambda *a: rounds.append(a[-2]) or inner(*a))
    rows = spark.range(1500).select(F.col("id").alias("node"), (F.col("id") * 1000).alias("v"))
    got = leaders.assign_leaders(
        rows, node="node", blocks=F.array(F.lit(1)), features=["v"], pivots=4,
        match=lambda a, b: F.abs(a("v") - b("v")) < 10,
    )
    assert got.filter("node <> leader").count() == 0 and got.count() == 1500
    assert rounds == [4, 16, 64, 256, 1024, 4096][: len(rounds)] and len(rounds) <= 6


def test_random_graphs_from_edges(spark):
    rng = random.Random(7)
    nodes = list(range(60))
    links = {(a, b) for a in nodes for b in nodes if b < a and rng.random() < 0.06}
    want = {}
    for n in nodes:
        hits = [p for p in nodes if (n, p) in links and want.get(p) == p]
        want[n] = min(hits) if hits else n
    got = leaders.assign_from_edges(
        spark.createDataFrame([(n,) for n in nodes], "node long"),
        spark.createDataFrame(sorted(links), "node long, pivot long"), node="node",
    )
    assert {r["node"]: r["leader"] for r in got.collect()} == want


def test_a_long_chain_is_settled_in_few_passes(spark, monkeypatch):
    """Every row matches the one before it: a chain as long as the table, in time and in id order."""
    written = []
    inner = leaders.cut
    monkeypatch.setattr(leaders, "cut", lambda df: written.append(1) or inner(df))
    monkeypatch.setattr(leaders, "LINKS", 100)
    n = 600
    nodes = spark.range(n).withColumn("node", F.struct((-F.col("id").cast("double")).alias("c"), "id"))
    links = spark.range(1, n)
    place = lambda i: F.struct((-i.cast("double")).alias("c"), i.alias("id"))
    for df, edges, at in (
        (nodes.select(F.col("id").alias("node")), links.select(F.col("id").alias("node"), (F.col("id") - 1).alias("pivot")), lambda r: r.node),
        (nodes.select("node"), links.select(place(F.col("id") - 1).alias("node"), place(F.col("id")).alias("pivot")), lambda r: n - 1 - r.node.id),
    ):
        written.clear()
        got = {at(r): r.leader for r in leaders.assign_from_edges(df, edges, node="node").collect()}
        got = {k: v if isinstance(v, int) else n - 1 - v.id for k, v in got.items()}
        assert got == {i: i - i % 2 for i in range(n)}
        assert len(written) < 40


def test_bands_cover_all_bits_and_find_every_close_pair(spark):
    for d in (1, 2, 8, 16, 20):
        layout = band_layout(d)
        assert len(layout) == d + 1 and sum(w for _, w in layout) == 64
    assert [w for _, w in band_layout(8)] == [7] * 8 + [8]
    assert [w for _, w in band_layout(2)] == [21, 21, 22]


def rows_for(spark, items):
    schema = "node long, phash long, taken_s long, aspect double, structure array<float>, score double"
    return spark.createDataFrame([(*i, 1.0) for i in items], schema)


def test_burst_does_not_chain_and_needs_time(spark):
    s = [0.5] * 64
    df = rows_for(spark, [(1, 0, 1, 1.5, s), (2, 0xFF, 2, 1.5, s), (3, 0xFFFF, 3, 1.5, s), (4, 0, None, 1.5, s)])
    got = groups.group_similar(df, node="node").select("node", "leader").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1)]


def test_eight_bits_in_eight_bands_still_match(spark):
    s = [0.5] * 64
    spread = sum(1 << (7 * b) for b in range(8))
    df = rows_for(spark, [(1, 0, 1, 1.5, s), (2, spread, 2, 1.5, s)])
    assert groups.group_similar(df, node="node").count() == 2


def test_duplicates_ignore_time_and_collapse_copies(spark):
    s = [0.5] * 64
    off = s[:4] + [0.7] + s[5:]
    items = [(1, 0, None, 1.5, s), (2, (1 << 0) | (1 << 21), 999_999, 1.5, s), (3, 0, 5, 1.5, off)]
    items += [(10 + i, 0, None, 1.5, s) for i in range(300)]
    got = groups.group_duplicates(rows_for(spark, items), node="node", pivots=4).select("node", "leader").collect()
    assert {r["node"] for r in got} == {1, 2} | {10 + i for i in range(300)}
    assert {r["leader"] for r in got} == {1}


def test_scenes_known_boundaries(spark):
    flat = lambda v: [v] * 64
    rows = [(1, 0, flat(0.0)), (2, 60, flat(0.1)), (3, 120, flat(0.25)), (4, 300, flat(0.25)), (5, None, flat(0.0)), (6, None, flat(0.0))]
    df = spark.createDataFrame(
        [(9, i, t, 0, s) for i, t, s in rows], "project_id long, photo_id long, taken_s long, phash long, structure array<float>"
    )
    members = scenes.scenes(df).collect()
    by = {}
    for r in members:
        by.setdefault(r["scene_id"], set()).add(r["photo_id"])
    assert sorted(map(sorted, by.values())) == [[1, 2], [3], [4], [5], [6]]


def test_scene_chunks_equal_one_fold(spark):
    rng = random.Random(3)
    t, rows = 0, []
    for i in range(400):
        t += rng.choice([1, 5, 20, 40, 100])
        rows.append((i % 2, i, t, rng.getrandbits(8), [rng.choice([0.0, 0.15, 0.3])] * 64))
    df = spark.createDataFrame(rows, "project_id long, photo_id long, taken_s long, phash long, structure array<float>")
    one = {r["photo_id"]: r["anchor_id"] for r in scenes.scene_members(df).collect()}
    many = {r["photo_id"]: r["anchor_id"] for r in scenes.scene_members(df, chunk_rows=25).collect()}
    assert one == many


def test_scene_rows_are_written_without_what_no_later_fold_needs(spark, monkeypatch):
    """Only rows before a chunk's first break keep their structure: whole rows are shuffled once."""
    written, inner = [], scenes.cut
    monkeypatch.setattr(scenes, "cut", lambda df: written.append(inner(df)) or written[-1])
    rows = [(i // 4, i, i * (500 if i == 30 else 1), 0, [0.0] * 64) for i in range(80)]
    df = spark.createDataFrame(rows, "project_id long, photo_id long, taken_s long, phash long, structure array<float>")
    got = {r["photo_id"]: r["anchor_id"] for r in scenes.scene_members(df, chunk_rows=20).collect()}
    want = {i: (i if i == 30 else i // 4 * 4) for i in range(80)}
    assert got == want
    kept = written[-1].filter("s is not null").count()
    assert written[-1].count() == 80 and 0 < kept < 40


def test_global_position_and_group_ranks(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    placed = global_position(df, [F.col("id").desc()]).collect()
    assert all(r["position"] == 999 - r["id"] for r in placed)
    ranks = rank_within(df, group=["g"], order=[F.col("id")]).filter("g = 0").orderBy("id").collect()
    assert [r["rank"] for r in ranks] == list(range(1, len(ranks) + 1))


def test_gap_sessions_cross_piece_borders(spark):
    times = [0, 90, 180, 271, 272, 272, 500]
    df = spark.createDataFrame([("u", t) for t in times], "u string, t long")
    got = gap_sessions(df, entity="u", time="t", gap=90, chunk=100).orderBy("t").collect()
    assert [r["session_no"] for r in got] == [0, 0, 0, 1, 1, 1, 2]


def test_rows_are_compared_where_they_meet(spark, monkeypatch):
    """Pairs with close hashes and other structures are neither written nor joined; a hot block is cut into shares and lots."""
    import numpy as np

    monkeypatch.setattr(leaders, "LOT", 6)
    monkeypatch.setattr(leaders, "SHARE", 25)
    monkeypatch.setattr(leaders, "PAIRS", 40)
    plans = []
    inner = leaders.cut

    def seen(df):
        if df.columns == ["node", "pivot"]:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return inner(df)

    monkeypatch.setattr(leaders, "cut", seen)
    rng = random.Random(3)
    looks = [[rng.random() * 0.05 + 0.5 for _ in range(64)] for _ in range(9)]
    rows = []
    for i in range(150):
        cells = [float(np.float32(v + rng.random() * 0.02)) for v in rng.choice(looks)]
        rows.append((i, (1 << 40) ^ (1 << rng.randint(0, 5)), 1.5 + (i % 3) * 0.006, cells))
    df = spark.createDataFrame(rows, "photo_id long, phash long, aspect double, structure array<float>")

    def alike(a, b):
        far = np.abs(np.float32(a[3]) - np.float32(b[3]))
        total = np.float32(0)
        for x in far:
            total += x
        return (
            (a[1] ^ b[1]).bit_count() <= 2 and abs(a[2] / b[2] - 1) <= 0.005
            and float(total / np.float32(64)) <= 0.015 and float(far.max()) <= 0.06
        )

    want = sequential([(r[0], r) for r in rows], alike)
    sizes = {}
    for leader in want.values():
        sizes[leader] = sizes.get(leader, 0) + 1
    got = groups.group_duplicates(df, node="photo_id", pivots=3)
    assert {r.photo_id: r.leader for r in got.collect()} == {n: x for n, x in want.items() if sizes[x] > 1}
    assert len(plans) > 1 and not any("Join" in p.split("MapInArrow")[0] for p in plans)


def test_bursts_of_a_hot_second_equal_the_walk_and_travel_once(spark, monkeypatch):
    """Half the rows in one second, lists cut short; a row is written a few times, not once for each band of its hash."""
    from winnow.operators import sweep

    written, real = [], leaders.cut

    def seen(df):
        out = real(df)
        if "x_structure" in df.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(leaders, "cut", seen)
    monkeypatch.setattr(sweep, "cut", seen)
    monkeypatch.setattr(leaders, "LINKS", 50)
    monkeypatch.setattr(leaders, "PAIRS", 90)
    monkeypatch.setattr(leaders, "STEP", 300)
    rng = random.Random(11)
    looks = [([rng.random() * 0.3 for _ in range(64)], rng.getrandbits(64) - (1 << 63)) for _ in range(8)]
    rows = []
    for i in range(400):
        cells, h = rng.choice(looks)
        for _ in range(rng.randint(0, 5)):
            h ^= 1 << rng.randint(0, 62)
        cells = [c + rng.random() * 0.22 for c in cells]
        t = 7000 if i % 2 else rng.choice([-9_000, 0, 6_995, 7_008, 7_020])
        rows.append((i * 7 % 400, rng.choice(["p", "q"]), h, t, 1.5 + i % 3 * 0.03, cells, 1.0))
    rows = sorted([*rows, (500, "p", 5, None, 1.5, [0.5] * 64, 1.0), (501, None, 5, 1, 1.5, [0.5] * 64, 1.0), (502, None, 5, 1, 1.5, [0.6] * 64, 1.0)])
    df = spark.createDataFrame(rows, "photo_id long, project string, phash long, taken_s long, aspect double, structure array<float>, score double")

    def alike(a, b):
        total = 0.0
        for x, y in zip(a[5], b[5], strict=True):
            total += abs(x - y)
        return a[1] == b[1] and abs(a[3] - b[3]) <= 8 and (a[2] ^ b[2]).bit_count() <= 8 and abs(a[4] - b[4]) < 0.05 and total / 64 < 0.10

    live = [r for r in rows if r[3] is not None and r[1] is not None]
    want = sequential([(r[0], r) for r in live], alike)
    sizes = {}
    for leader in want.values():
        sizes[leader] = sizes.get(leader, 0) + 1
    assert max(sizes.values()) > 5 and len(sizes) > 30
    for pivots in (64, 2):
        written.clear()
        for node, names in ((F.col("photo_id"), lambda x: x), (F.format_string("%05d", "photo_id"), int)):
            got = groups.group_similar(df.withColumn("photo_id", node), node="photo_id", project="project", pivots=pivots)
            assert {names(r.photo_id): names(r.leader) for r in got.collect()} == {n: x for n, x in want.items() if sizes[x] > 1}
        if pivots == 64:
            assert sum(written) <= 6 * len(rows)


def test_rows_of_a_range_are_settled_like_one_by_one():
    import pyarrow as pa

    rng = random.Random(5)
    for n, span in ((300, 30), (300, 1), (40, 40)):
        links = []
        for node in range(0, 2 * n, 2):
            for pivot in sorted(rng.sample(range(max(-span, node - 2 * span), node), rng.randint(1, min(3, span)))):
                links.append((node, pivot, "A" if pivot < 0 and rng.random() < 0.3 else "M" if pivot % 2 else "?", node % 22 != 0))
        columns = list(zip(*links, strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])], names=["node", "pivot", "ps", "seen"])

        def told(walk):
            return {k: v for b in walk([batch.slice(0, 17), batch.slice(17)]) for k, v in zip(*(c.to_pylist() for c in b.columns), strict=True)}

        assert told(leaders._walk_numbers) == told(leaders._walk)


def test_a_grouping_run_makes_its_rows_once_and_ranks_narrow_ones(spark, monkeypatch):
    from winnow.operators import ranking

    plans, ranked, inner, place = [], [], groups.collapse_copies, ranking.global_position
    monkeypatch.setattr(groups, "collapse_copies", lambda rows, **k: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or inner(rows, **k))
    monkeypatch.setattr(ranking, "global_position", lambda df, *a, **k: ranked.append(df.columns) or place(df, *a, **k))
    df = rows_for(spark, [(i, 0, 1, 1.5, [0.5] * 64) for i in range(4)]).withColumn("part", F.explode(F.array(F.lit(0), F.lit(10))))
    df = df.select((F.col("node") + F.col("part")).alias("photo_id"), "phash", "taken_s", "aspect", "structure", "score").withColumns(
        {"missing": F.col("photo_id") == 3, "quarantined": F.lit(False), "closed_eye": F.col("photo_id") == 0, "capture_variant_id": F.lit(None).cast("string")}
    )
    got = sorted(tuple(r) for r in groups.build_groups(df).collect())
    left = [1, 2, 10, 11, 12, 13]
    assert got == sorted([("burst", 0, i, n) for n, i in enumerate([*left, 0], 1)] + [("duplicate", 0, i, n) for n, i in enumerate(sorted([0, *left], key=str), 1)])
    assert len(plans) == 2 and not any("Generate" in p for p in plans)
    assert len(ranked) == 2 and not any("structure" in c for c in ranked)
