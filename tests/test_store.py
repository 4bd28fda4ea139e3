"""The store of reports: versions, changes that die, pruned look-ups."""

import os
import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators.store import Store
from codestrata.sources import snapshots

ROWS = "result_id string, analyzed_at int, report_json string"


def made(spark, tmp_path, **options):
    return Store(spark, str(tmp_path / "store"), ROWS, **options)


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


def held(kept, version=None):
    return {r["result_id"]: (r["analyzed_at"], r["report_json"]) for r in kept.table.read(version).collect()}


def files(d):
    return {f.rsplit("/", 1)[1] for f in d.inputFiles()}


def test_against_a_dictionary(spark, tmp_path):
    """Upserts of random ids into small files: every version is what a dictionary holds, files stay apart and no larger than asked for."""
    dice = random.Random(3)
    kept, want, versions = made(spark, tmp_path, file_bytes=3000), {}, {}
    for turn in range(4):
        new = [(dice.choice("abcé\U0001f600") + f"-{dice.randrange(400)}", dice.randrange(50), f"{turn}-{i}" * 20) for i in range(dice.choice((5, 300)))]
        version = kept.upsert(rows(spark, new))
        for k in {k for k, _, _ in new}:
            want[k] = max((at, j) for x, at, j in new if x == k)
        versions[version] = dict(want)
        entries = kept.table.entries()
        assert held(kept) == want and sum(e.rows for e in entries) == len(want)
        assert all(a.hi.encode() < b.lo.encode() for a, b in zip(entries, entries[1:], strict=False))
    assert len(entries) > 8 and sorted(versions) == [1, 2, 3, 4]
    for version, then in versions.items():
        assert held(kept, version) == then
    before = len(entries)
    last = [4]
    while (version := kept.table.compact()) != last[-1] and len(last) < 9:  # joined files take fewer bytes, so more may join
        last.append(version)
    assert 1 < len(last) < 9 and len(kept.table.entries()) < before and held(kept) == want
    assert kept.table.vacuum(keep=1) > 0 and kept.table.versions() == last[-1:] and held(kept) == want and kept.table.vacuum(keep=1) == 0


def test_lookups_read_what_they_need(spark, tmp_path):
    kept = made(spark, tmp_path, file_bytes=4000)
    kept.upsert(rows(spark, [("m", 1, "x")]))
    assert len(kept.table.entries()) == 1
    kept.upsert(rows(spark, [(f"{p}-{i:04}", i, os.urandom(60).hex()) for p in "abcd" for i in range(300)]))
    entries = kept.table.entries()
    assert len(entries) > 10
    for wanted in ("b-0123", " d-0299 "):
        exact = kept.table.exact(wanted.strip())
        assert len(files(exact)) == 1 and kept.lookup(wanted).first()["result_id"] == wanted.strip()
    assert kept.lookup("zz").first() is None and kept.lookup("").first() is None and kept.lookup("a%").first() is None and kept.lookup("a-9").first() is None
    have = held(kept)
    for prefix in ("b-01", "c"):
        found = kept.table.starting_with(prefix)
        reach = {e.file.rsplit("/", 1)[1] for e in entries if any(k.startswith(prefix) for k in (e.lo, e.hi)) or e.lo < prefix < e.hi}
        assert files(found) <= reach and len(files(found)) < len(entries) and {r["result_id"] for r in found.collect()} == {k for k in have if k.startswith(prefix)}
        assert kept.lookup(prefix).first()["result_id"] == max((at, k) for k, (at, _) in have.items() if k.startswith(prefix))[1]
    assert [r[0] for r in kept.some_ids(4).collect()] == ["a-0000", "a-0001", "a-0002", "a-0003"] and len(files(kept.some_ids(4))) == 1
    # A change of one row writes one file anew, whatever the store's size.
    kept.upsert(rows(spark, [("b-0123", 999, "new")]))
    assert len({e.file for e in entries} - {e.file for e in kept.table.entries()}) == 1 and kept.lookup("b-0123").first()["report_json"] == "new"


@pytest.mark.parametrize("step", ["_write", "_commit", "create", "rename"])
def test_a_change_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    kept = made(spark, tmp_path)
    kept.upsert(rows(spark, [("a", 1, "one"), ("b", 1, "one")]))
    new = rows(spark, [("a", 2, "two"), ("c", 2, "two")])
    if step in ("create", "rename"):  # after the manifest, before the version has its name
        monkeypatch.setattr(snapshots.SnapshotTable, "_name", lambda self, version, name: dying(self, version, name, step))
    else:
        real = getattr(snapshots.SnapshotTable, step)

        def after(self, *args):
            if step != "_name":
                real(self, *args)
            raise OSError("died")

        if step == "_commit":
            monkeypatch.setattr(snapshots.SnapshotTable, "_name", lambda self, *a: None)
        monkeypatch.setattr(snapshots.SnapshotTable, step, after)
    with pytest.raises(OSError, match="died"):
        kept.upsert(new)
    monkeypatch.undo()
    assert held(kept) == {"a": (1, "one"), "b": (1, "one")} and kept.table.versions() == [1]
    assert kept.upsert(new) == 2 and held(kept) == {"a": (2, "two"), "b": (1, "one"), "c": (2, "two")}
    kept.table.vacuum(keep=2)
    assert held(kept, 1) == {"a": (1, "one"), "b": (1, "one")}


def dying(table, version, name, step):
    os.makedirs(f"{table.path}/versions", exist_ok=True)
    with open(f"{table.path}/versions/.{name}", "w") as f:
        f.write(name if step == "rename" else "")
    raise OSError("died")


def test_two_changes_at_once(spark, tmp_path, monkeypatch):
    kept, other = made(spark, tmp_path), made(spark, tmp_path)
    kept.upsert(rows(spark, [("a", 1, "one")]))
    real, done = snapshots.SnapshotTable._write, []

    def write(self, *args):
        out = real(self, *args)
        if not done:
            done.append(1)
            other.upsert(rows(spark, [("b", 5, "other"), ("a", 5, "other")]))
        return out

    monkeypatch.setattr(snapshots.SnapshotTable, "_write", write)
    assert kept.upsert(rows(spark, [("a", 9, "mine"), ("c", 9, "mine")])) == 3
    assert held(kept) == {"a": (9, "mine"), "b": (5, "other"), "c": (9, "mine")}


def test_empty_and_without_ids(spark, tmp_path):
    kept = made(spark, tmp_path)
    assert kept.lookup("a").first() is None and kept.some_ids().count() == 0 and kept.table.read().count() == 0
    assert kept.upsert(rows(spark, [])) == 0 and kept.table.versions() == []
    with pytest.raises(ValueError, match="result_id"):
        kept.upsert(rows(spark, [(None, 1, "x")]))
    kept.upsert(rows(spark, [("a", None, None), ("a", 1, None)]).withColumn("slot", F.lit("mine")))
    assert held(kept) == {"a": (1, None)}
