"""Inventories as a data source: against a walk of the folders, planning, and streams that go on from an offset."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from larder.sources.catalog import Catalog
from larder.sources.files import list_files
from larder.sources.inventory import Folder, Inventory, _Batch, inventory, watch
from larder.streaming import streams as X


def put(root, name, text="x", at=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if at is not None:
        os.utime(path, (at, at))


def walked(root):
    out = set()
    for folder, _, names in os.walk(root):
        for name in names:
            st = os.stat(os.path.join(folder, name))
            out.add((f"file:{folder}/{name}", st.st_size, st.st_mtime_ns // 1000))
    return out


def listed(df):
    rows = df.select("path", "size", F.unix_micros("mtime").alias("us")).collect()
    assert len(rows) == len({r["path"] for r in rows})
    return {tuple(r) for r in rows}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "lib"
    for i in range(40):
        put(root, f"d{i % 7}/e{i % 3}/n={i}/file {i} é.txt", "y" * i)
    for name in ("a.png", ".hidden", "_under", "d1/.git/config", "d0/empty.txt"):
        put(root, name, "" if "empty" in name else "z")
    (root / "none/below").mkdir(parents=True)
    put(root, "old.txt", at=0)
    put(root, "older.txt", at=-5.25)
    return root


@pytest.mark.parametrize("tasks", [1, 2, 9, 30, 500])
def test_every_file_once(spark, tree, tasks):
    assert listed(inventory(spark, str(tree), tasks=tasks)) == walked(tree)


def test_addresses_and_levels(spark, tree):
    assert listed(inventory(spark, f"file://{tree}/")) == listed(inventory(spark, f"file:{tree}")) == walked(tree)
    alone = {x for x in walked(tree) if x[0].rpartition("/")[0] == f"file:{tree}"}
    assert listed(inventory(spark, str(tree), recursive=False)) == alone
    assert listed(inventory(spark, str(tree / "none"))) == set()
    with pytest.raises(Exception, match="no folder"):
        inventory(spark, str(tree / "nowhere")).count()


def test_paths_are_those_of_the_readers(spark, tree):
    plain = {r["path"] for r in list_files(spark, str(tree)).collect()}
    assert plain < {x[0] for x in listed(inventory(spark, str(tree)))}  # Spark's readers leave out names that begin with . or _


def test_links(spark, tree, tmp_path):
    put(tmp_path, "far/seen.txt")
    (tree / "to").symlink_to(tmp_path / "far")
    (tree / "d1/back").symlink_to(tree)
    (tree / "gone").symlink_to(tmp_path / "nowhere")
    names = [x[0].removeprefix(f"file:{tree}/") for x in listed(inventory(spark, str(tree)))]
    assert "to/seen.txt" in names and "gone" not in names and not any("back" in x for x in names)


def test_planning_opens_folders_only(tree):
    plan = _Batch({"path": str(tree), "tasks": "8"}).folders()
    assert all(isinstance(x, Folder) for x in plan)
    alone, deep = [x.path for x in plan if not x.deep], [x.path for x in plan if x.deep]
    assert str(tree) in alone and len(deep) >= 8 and len(set(alone + deep)) == len(plan)
    assert not any(os.path.isfile(x) for x in alone + deep)
    assert Inventory.name() == "inventory"


def drained(stream, checkpoint):
    out = []
    query = stream.writeStream.foreachBatch(lambda b, _: out.extend(r["path"].rpartition("/")[2] for r in b.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(out)


def test_stream_gives_each_change_once(spark, tmp_path):
    root, checkpoint = tmp_path / "in", tmp_path / "c"
    put(root, "a", at=0)
    put(root, "s/b")
    follow = lambda **o: drained(watch(spark, str(root), settle=0, **o), checkpoint)
    assert follow() == ["a", "b"]
    assert follow() == []
    time.sleep(0.01)
    put(root, "s/b", "more")
    put(root, "s/t/c")
    (root / "a").unlink()
    assert follow() == ["b", "c"]
    put(root, "early", at=time.time() + 3600)  # not yet: its time has not come
    assert follow() == []
    assert drained(watch(spark, str(root), settle=7200), tmp_path / "c2") == []
    assert drained(watch(spark, str(root), whole=True), tmp_path / "c3") == ["b", "c", "early"]


def test_ingest_of_a_watched_folder(spark, tmp_path):
    """Files that come, change and go, merged into a catalogue by a stream of whole inventories."""
    root, catalog = tmp_path / "in", Catalog(spark, str(tmp_path / "catalog"))
    place = F.col("path")
    shaped = lambda s: s.select("path", F.sha2(F.concat_ws(":", place, "size").cast("binary"), 256).alias("content_hash"), F.lit("image").alias("kind"), place.alias("title"), F.lit("indexed").alias("mode"), F.lit(0).cast("long").alias("root_id"), "size", F.col("mtime").cast("timestamp_ntz").alias("mtime"))

    def merged():
        X.start_ingest(shaped(watch(spark, str(root), whole=True)), catalog, str(tmp_path / "c"), spark.range(1)).awaitTermination()
        return {r["abs_path"].rpartition("/")[2]: (r["present"], r["size"]) for r in catalog.read("location").collect()}

    put(root, "a")
    put(root, "s/b", "bb")
    assert merged() == {"a": (True, 1), "b": (True, 2)}
    put(root, "s/b", "longer")
    put(root, "n")
    shutil.move(root / "a", tmp_path / "a")
    assert merged() == {"a": (False, 1), "b": (True, 6), "n": (True, 1)}
