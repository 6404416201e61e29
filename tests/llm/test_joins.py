"""Jaccard join, line dedup and decontamination against brute force."""

import itertools
import random

import numpy as np
import pytest

from winnow.llm import decontamination, jaccard_join, line_dedup
from winnow.llm.components import components
from winnow.llm.words import PUNCTUATION

SCHEMA = "doc_id long, text string"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def components_by_hand(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rng, size, words, edits):
    """A text and edited copies of it, none of which is the same."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [base]
    for _ in range(size - 1):
        copy = list(rng.choice(out))
        for _ in range(rng.randrange(1, edits + 1)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [copy[at], f"n{rng.randrange(10**6)}"]])
        out.append(copy)
    return [" ".join(c) for c in out]


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 60)])
def test_components_match_all_pairs(spark, width, num):
    rng = random.Random(width)
    texts = [t for _ in range(6) for n in (4, 8, 13, 19, 27, 60, 300) for t in family(rng, 5, n, 2)]
    texts += family(rng, 80, 120, 1) + ["same text of five words"] * 30 + ["ONE", "one", "", " ", None, "a b", "A b"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, width, num, 100).collect()}
    assert found == components_by_hand(rows, width, num, 100)


def test_chain_of_copies_is_one_component(spark):
    """Each text is linked with its neighbours only, so pivots need several rounds."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 200])) for i in range(50)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components_by_hand(rows, 3, 90, 100)


def test_star_whose_rays_are_not_linked(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(120), 2):
            copy[at] = f"n{i}_{at}"
        rows.append((i, " ".join(copy)))
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components_by_hand(rows, 3, 90, 100)


def test_bounds_never_part_a_linked_pair():
    rng = random.Random(9)
    import numpy as np

    for num in (60, 80, 90):
        bounds = jaccard_join.Bounds(num, 100)
        for _ in range(400):
            size = rng.choice([bounds.least, 5, 9, 16, 17, 20, 26, 40, 90, 300])
            row = np.unique(np.array([rng.getrandbits(64) for _ in range(size)], np.uint64))
            other = set(row.tolist())
            while True:
                nxt = set(other)
                nxt.discard(rng.choice(sorted(nxt))) if rng.random() < 0.5 else nxt.add(rng.getrandbits(64))
                if len(set(row.tolist()) & nxt) * 100 < num * len(set(row.tolist()) | nxt):
                    break
                other = nxt
            other = np.array(sorted(other), np.uint64)
            if len(other) == len(row) and (other == row).all():
                continue
            assert set(bounds.keys(row).tolist()) & set(bounds.keys(other).tolist()), (num, len(row), len(other))


def test_components_of_links(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, 101), (102, 101), (102, 103), (7, 7)]
    found = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 10 for i in range(10, 61)} | {i: 100 for i in range(100, 104)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_takes_odd_rows(documents, nothing):
    found = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(documents).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (None, None), (6, 6), (7, 7)} <= found
    kept = jaccard_join.one_of_each(documents)
    assert kept.columns == documents.columns and kept.count() == documents.count() - 1
    assert jaccard_join.jaccard_components(nothing).count() == 0


def dedup_by_hand(rows, least=8):
    """First holders of long lines, then common blocks found by trying every pair of starts."""
    lines = {i: t.split("\n") for i, t in rows if t is not None}
    first = {}
    for i in sorted(lines):
        for x in lines[i]:
            if len(x.split()) >= least:
                first.setdefault(x, i)
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = None
            continue
        gone = {k for k, x in enumerate(lines[i]) if first.get(x, i) != i}
        out[i] = gone
    return out


def test_repeated_passages_stay_once(spark):
    rng = random.Random(2)

    def line(n):
        return " ".join(f"v{rng.randrange(10**7)}" for _ in range(n))

    passage, boiler = line(60), line(9)
    rows = []
    for i in range(60):
        body = [line(20) for _ in range(4)]
        if i % 3 == 0:
            body.insert(rng.randrange(5), passage)
        if i % 2:
            body.insert(rng.randrange(5), boiler)
        rows.append((i, "\n".join(body + ["The end."])))
    rows.append((70, rows[5][1]))
    found = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert [i for i, r in sorted(found.items()) if passage in r.text] == [0]
    assert [i for i, r in sorted(found.items()) if boiler in r.text] == [1]
    want = dedup_by_hand(rows)
    for i, t in rows[:60]:
        assert found[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
        assert found[i].n_gone_lines == len(want[i]) and found[i].n_lines == len(t.split("\n"))
    assert found[70].text == ""


def test_blocks_of_short_lines_go_together():
    later, first = [1, 2, 3, 9, 4, 8], [7, 1, 2, 3, 4, 5]
    assert line_dedup.aligned_blocks(later, first, [3] * 6, 9) == [0, 1, 2]
    assert line_dedup.aligned_blocks(later, first, [3] * 6, 3) == [0, 1, 2, 4]
    assert line_dedup.aligned_blocks([5, 6, 1, 2], [1, 2, 5, 6], [4] * 4, 8) in ([0, 1, 2, 3], [2, 3, 0, 1])
    assert sorted(line_dedup.aligned_blocks([1, 1, 1], [1], [9] * 3, 9)) == [0, 1, 2]
    assert line_dedup.aligned_blocks([], [1], [], 1) == []


def test_passages_of_short_lines_go_from_later_documents(spark):
    """Verse, code with repeated lines, blank lines between, and short lines around a long one whose first holder is another document."""
    rng = random.Random(9)

    def line(n):
        return " ".join(f"s{rng.randrange(10**6)}" for _ in range(n))

    verse, long = [line(rng.randrange(1, 7)) for _ in range(20)], line(12)
    code = ["if a b:", "}", "do c d", "}", "end of it", "}"]
    mixed = [line(5), line(4), long, line(7), line(2), line(1)]
    own = [[line(3), line(2)] for _ in range(9)]
    rows = [
        (1, [long, *own[0]]), (2, [*own[1], *verse, *own[2]]), (3, [*own[3], *mixed]), (4, ["}", "}", *own[4], *code]),
        (5, [own[5][0], *verse, own[5][1]]), (6, [own[6][0], *[x for v in verse for x in (v, "")], own[6][1]]), (7, [own[7][0], *mixed]), (8, [own[8][0], *code]),
    ]
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], SCHEMA).repartition(4)).collect()}
    assert {i: [x for x in found[i].split("\n") if x] for i in found} == {**{i: x for i, x in rows[:4]}, 3: [*own[3], *(x for x in mixed if x != long)], 5: own[5], 6: own[6], 7: [own[7][0]], 8: [own[8][0]]}


def test_runs_cover_every_passage():
    rng = random.Random(10)
    for _ in range(200):
        words = np.array([rng.randrange(1, 12) for _ in range(rng.randrange(12))], np.int64)
        lines = np.array([rng.randrange(5) for _ in words], np.int64)
        first, last, keys = line_dedup.runs(lines, words, 8)
        assert len(keys) <= 2 * len(words) and all(words[a : b + 1].sum() >= 8 for a, b in zip(first, last, strict=True))
        for i in range(len(words)):
            for e in range(i, len(words)):
                if words[i : e + 1].sum() >= 8:
                    assert {k for a, b in zip(first, last, strict=True) if i <= a and b <= e for k in range(a, b + 1)} == set(range(i, e + 1))
        same = {}
        for a, b, key in zip(first.tolist(), last.tolist(), keys.tolist(), strict=True):
            assert same.setdefault(key, lines[a : b + 1].tolist()) == lines[a : b + 1].tolist()


def test_line_dedup_takes_odd_rows(documents, nothing):
    found = line_dedup.dedup_lines(documents)
    assert found.count() == documents.count()
    assert {r.text for r in found.where("doc_id = 2").collect()} == {""}
    assert found.where("doc_id = 1").first().text == documents.where("doc_id = 1").first().text
    assert line_dedup.dedup_lines(nothing).count() == 0


def plain(text):
    return [w for w in (PUNCTUATION.sub(b"", x) for x in (text or "").encode().lower().split()) if w]


def bag(words, width):
    out = {}
    width = min(width, len(words))
    for i in range(len(words) - width + 1):
        key = tuple(words[i : i + width])
        out[key] = out.get(key, 0) + sum(len(w.decode()) for w in key)
    return out


def leaks_by_hand(docs, items, width=5, least=0.8):
    out = {}
    for d, text in docs:
        words = plain(text)
        for i, item in items:
            iw = plain(item)
            if not iw or i is None or len(words) < min(width, len(iw)):
                continue
            want, best = bag(iw, width), 0
            for s in range(max(1, len(words) - len(iw) + 1)):
                got = bag(words[s : s + len(iw)], min(width, len(iw)))
                low = sum(min(got[k], want[k]) for k in got.keys() & want.keys())
                best = max(best, low / (sum(got.values()) + sum(want.values()) - low))
            if best >= least:
                out[d, i] = round(best, 9)
    return out


def test_leaks_match_every_window(spark):
    rng = random.Random(6)

    def prose(n):
        return [f"{rng.choice(['ba', 'ku', 'so', 'ti'])}{rng.randrange(300)}" for _ in range(n)]

    items = [(i, " ".join(prose(n))) for i, n in enumerate([14, 20, 36, 36, 59, 3, 1])] + [(50, None), (51, "..."), (None, "x y z")]
    docs = []
    for i in range(120):
        words = prose(rng.choice([5, 60, 300]))
        item = items[i % 7][1].split()
        if i % 2:
            for _ in range(i % 5):
                item[rng.choice([0, 1, -1, -2, rng.randrange(len(item))]) % len(item)] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in item]
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "?!")]
    found = decontamination.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = leaks_by_hand(docs, items)
    assert len(want) > 30
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == want
    assert all(r.bits <= decontamination.RADIUS for r in found)


def test_every_item_in_the_radius_is_a_candidate():
    import numpy as np

    rng = random.Random(1)
    items = decontamination.Items([(i, " ".join(f"w{rng.randrange(999)}" for _ in range(20))) for i in range(40)], 5)
    for _ in range(500):
        at = rng.randrange(40)
        flipped = int(items.prints[at])
        for bit in rng.sample(range(64), rng.randrange(decontamination.RADIUS + 1)):
            flipped ^= 1 << bit
        found = [item for _, item, _ in items._candidates(20, np.array([0]), np.array([flipped], np.uint64))]
        near = [i for i in range(40) if (flipped ^ int(items.prints[i])).bit_count() <= decontamination.RADIUS]
        assert sorted(found) == near and at in found


def test_decontamination_takes_odd_rows(documents, nothing, spark):
    items = spark.createDataFrame([(1, "Three four FIVE six seven eight"), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.find_leaks(documents, items).collect()} == {1, 2, None, 8}
    kept = decontamination.without_leaks(documents, items)
    assert kept.columns == documents.columns and kept.count() == documents.count() - 4
    assert decontamination.find_leaks(nothing, items).count() == 0
    assert decontamination.find_leaks(documents, items.where("1 = 0")).count() == 0


def test_items_in_several_passes(documents, spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE_CHARS", 20)
    items = spark.createDataFrame([(1, "Three four FIVE six seven eight"), (2, "alpha beta gamma delta epsilon zeta"), (3, "nothing of it is there at all")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(documents, items).collect()} == {(1, 1), (2, 1), (None, 1), (8, 1), (1, 2), (2, 2)}
    assert decontamination.without_leaks(documents, items).count() == documents.count() - 4


