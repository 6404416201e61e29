"""Prefix trie, licence scan and Merkle manifest against brute force in plain Python and DuckDB."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest

from winnow.llm import license_scan, merkle_manifest, prefix_trie
from winnow.llm.queries import ORACLES


def trie_by_hand(rows):
    """Every node from every rebuilt conversation, subtrees summed over all prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(conv, []).append((turn is not None, turn or 0, role.encode(), digest, (role, text)))
    own = {c: [x[-1] for x in sorted(turns, key=lambda x: x[:4])] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = own.get(c - int(math.fmod(c, 5)), [])[:h]  # SQL's remainder has the sign of the id
        path = tuple(head + turns[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path, ms in members.items():
        kids.setdefault(path, 0)
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, ms in members.items():
        cost = (len(ms) - 1) * (len(path[-1][1].encode()) if path else 0)
        for d in range(len(path) + 1):
            saved[path[:d]] = saved.get(path[:d], 0) + cost
            leaves[path[:d]] = leaves.get(path[:d], 0) + (not kids[path])
    return sorted(
        (
            min(ms), len(path), min(members[path[:-1]]) if path else None, len(ms), kids[path], leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest(),
        )
        for path, ms in members.items()
    )


def nodes(spark, rows, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "'x' as strand")
    found = prefix_trie.conversation_trie(df, **how)
    assert found.columns == list(prefix_trie.RESULT)
    return sorted(map(tuple, found.collect()))


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(5)
    rows = []
    for c in range(-7, 90):
        for t in range(draw.choice([0, 1, 2, 3, 6, 7, 13])):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "bb", "é", ""])))
    # Copies of one conversation that is longer than a strand, and continuations of it.
    for c in range(100, 140):
        rows += [(c, t, "user", f"turn {t}") for t in range(17)] + [(c, 17 + t, "user", f"own {c % 3}") for t in range(c % 4)]
    # Nulls, ties, repeated rows, a conversation that is copied away to nothing.
    rows += [(None, 1, "user", "lost"), (200, None, None, None), (200, 1, "b", "y"), (200, 1, "a", "z"), (200, 1, "a", "z"), (201, 1, "user", "only")]
    return rows


@pytest.mark.parametrize(("most", "shards"), [(256, 1), (256, 5), (3, 4), (1, 7)])
def test_trie_equals_brute_force(spark, talks, most, shards):
    assert nodes(spark, talks, most=most, shards=shards) == trie_by_hand(talks)


def test_one_talk_holds_a_third_of_the_turns(spark):
    rows = [(10, t, "user", f"turn {t}") for t in range(700)] + [(c, t, "user", f"turn {t}") for c in range(11, 15) for t in range(90 * (c - 10))]
    assert nodes(spark, rows, most=50, shards=6) == trie_by_hand(rows)


def test_trie_of_nothing_and_of_copies_in_pieces(spark, monkeypatch):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 0, "user", "x")]) == []
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(60) for t in range(2)]
    assert nodes(spark, rows, shards=4) == trie_by_hand(rows)


def test_a_border_that_cuts_copies_is_a_skeleton_node(spark):
    key = b"\0" * 20 + b"a" * 16
    skeleton = prefix_trie.Skeleton([(key, 3), (key + b"b" * 16, 1)])
    assert skeleton.ids == [[0, 1], [0, 1, 2]]
    assert skeleton.rows()[2][-1] == [0, 1, 2]
    assert [r[4] for r in skeleton.rows()] == [1, 1, 0]


LICENCES = [
    (1, "Intro.\nReleased under the MIT License.\n"),
    (2, "All rights\treserved, all rights reserved. ALL RIGHTS RESERVED"),
    (3, "This work is licensed under the GNU General Public License, version 3."),
    (4, "Licensed under CC BY-NC 4.0."),
    (5, "Mit der Lizenz und general license public, rights all reserved"),
    (6, "Licensed under the Apache License, Version 2.0 (the License)"),
    (7, "Permission is hereby granted, free of charge, to every human obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    (8, "general public licenſe, all rightK reserved CCé BY"),
    (9, None), (10, ""), (11, " . "), (None, "cc by"), (12, "cc by"), (12, "cc by"),
]


def test_licences_are_found_and_equal_to_sql(spark):
    docs = spark.createDataFrame(LICENCES, "doc_id long, text string").selectExpr("*", "1 as word", "'x' as labels", "2 as row")
    found = license_scan.scan(docs)
    rows = sorted((tuple(r) for r in found.collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", LICENCES)
    assert rows == sorted(con.execute(license_scan.sql()).fetchall(), key=str)
    labels = {r[0]: r[6] for r in rows}
    assert labels[1] == "mit" and labels[2] == "reserved" and labels[3] == "gpl,gpl-3.0" and labels[4] == "cc-by,cc-by-nc"
    assert labels[5] == "" and labels[6] == "apache-2.0" and labels[7] == "mit" and labels[8] == ""
    two = next(r for r in rows if r[0] == 2)
    assert two[1:6] == (9, 3, 0, 6, "reserved") and two[7] == 1.0
    assert [r[1:] for r in rows if r[0] in (9, 10, 11)] == [(0, 0, None, None, "", "", 0.0)] * 3
    plan = found._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_licence_scan_of_a_long_text_and_of_nothing(spark):
    long = "word " * 3000 + "released under the mit license " * 500 + "all rights reserved"
    docs = spark.createDataFrame([(1, long), (2, "word")], "doc_id long, text string")
    first = sorted(map(tuple, license_scan.scan(docs).collect()))[0]
    assert first == (1, 3000 + 2500 + 3, 1, 5500, 5500, "reserved", "mit,reserved", 1.0)
    assert license_scan.scan(docs.where("1 = 0")).collect() == []


def test_a_key_phrase_is_mandatory(spark):
    docs = spark.createDataFrame([(1, "licensed under the apache license version 3 0"), (2, "licensed under the apache license version 2 0")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(docs).collect()} == {1: "", 2: "apache-2.0"}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(digests, fanout):
    """Root and the siblings of every leaf as (left, right) by level."""
    steps, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, p in enumerate(at):
            s = p - p % fanout
            steps[i].append(("".join(level[s:p]), "".join(level[p + 1 : s + fanout])))
        at = [p // fanout for p in at]
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], steps


def audit_by_hand(rows, fanout):
    def leaf(row, text):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))

    sources = {}
    for row in rows:
        cut = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None
        sources.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), leaf(row, row[1].replace("\n", "") if cut else row[1]), row[0]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(sources[s])], fanout) for s in order}
    root, over = climb([trees[s][0] for s in order], fanout)
    out = []
    for s, up in zip(order, over, strict=True):
        for x, steps in zip(sorted(sources[s]), trees[s][1], strict=True):
            at = x[3]
            for left, right in steps + up:
                at = h(left, at, right)
            out.append((x[4], x[2], trees[s][0], root, h(*(a + b for a, b in steps + up)), at, at == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "depth"), [(3, 1), (3, 2), (2, 1), (3, 5)])
def test_manifest_equals_brute_force(spark, fanout, depth):
    draw, rows = random.Random(3), []
    for s, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4), ("é", 28), ("z", 82), ("y", 10), (None, 5), ("q", 9), ("r", 55), ("B", 27)):
        rows += [(len(rows) * 7 + i, draw.choice(["x\ny", "é\n", "plain", "", None]), draw.choice(["en", None]), s, draw.choice([1, 22, None])) for i in range(n)]
    rows += [(None, "no id\n", "en", "z", 3), (7, "twin\n", "en", "z", 3), (7, "twin\n", "en", "z", 3)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as leaf", "1 as tree", "2 as root")
    found = sorted((tuple(r) for r in merkle_manifest.audit(docs, fanout, depth).collect()), key=str)
    assert found == audit_by_hand(rows, fanout)
    assert {True, False} == {r[-1] for r in found}


def test_manifest_of_edge_rows_equals_sql(spark, documents, nothing):
    assert merkle_manifest.audit(nothing).collect() == []
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [tuple(r)[:5] for r in documents.collect()])
    found = sorted((tuple(r) for r in merkle_manifest.audit(documents).collect()), key=str)
    assert found == sorted(con.execute(ORACLES["op13_merkle_manifest"]).fetchall(), key=str)
