"""Listing of folders against os.walk."""

import os

import __spark_entry__ as entry
from winnow.sources import files


def test_listing_equals_a_walk(spark, tmp_path):
    root = tmp_path / "root [1]"
    for name in ("a.jpg", "x/b c.png", "x/y/d,e.raw", "x/y=1/f.dng", "z/y=2/k=3/g.heic", ".curation/no.jpg", "x/.curation-cache/deep/no.jpg", "w/.curation-note", "{q}/h*.jpg", "_DSC1.jpg", "x/_k/_l/m.jpg", "x/_k/n.jpg", "v/_o/p.jpg", "v/_o/.curation/no.jpg", "v/q.jpg"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    os.symlink(root, root / "x" / "loop")
    os.symlink(root / "a.jpg", root / "w" / "link.jpg")
    (root / "empty").mkdir()
    want = {}
    for folder, names, found in os.walk(root):
        names[:] = [n for n in names if n not in files.MANAGED and not os.path.islink(os.path.join(folder, n))]
        for f in found:
            path = os.path.join(folder, f)
            if not os.path.islink(path):
                want[os.path.relpath(path, root)] = os.path.getsize(path)
    assert len(want) == 12
    assert {r["path"]: r["size_bytes"] for r in files.list_files(spark, str(root)).collect()} == want
    assert files.list_files(spark, str(root / "empty")).collect() == []


def test_the_query_lists_the_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = entry.queries()["listed_files"](spark, folder).collect()
    assert {r["path"]: r["size_bytes"] for r in rows} == {f: os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)}
    assert all(r["safe"] for r in rows)
