"""Stores by key: the newest value wins, removals, compaction, and writes that fail half way."""

import pytest

from revscope.sources import keyed as K


@pytest.fixture
def store(spark, tmp_path):
    return K.KeyStore(spark, f"file://{tmp_path}/store")


def everything(store):
    return {r.key: bytes(r.value) for r in store.latest().collect()}


def test_newest_value_wins_and_removals_remove(spark, store):
    assert store.get("a") is None and everything(store) == {}
    store.set("a", b"1")
    store.put(spark.createDataFrame([("b", b"x"), ("c", b"y"), ("c", b"z")], "key string, value binary"))
    store.set("a", b"2")
    assert everything(store) == {"a": b"2", "b": b"x", "c": b"z"}
    store.set("b", None)
    assert everything(store) == {"a": b"2", "c": b"z"} and store.get("b") is None


def test_compaction_changes_nothing_that_is_read(spark, store):
    for k in range(6):
        store.set(f"k{k % 3}", str(k).encode())
    store.set("k0", None)
    before = everything(store)
    held = store.latest()
    store.compact()
    assert everything(store) == before == {r.key: bytes(r.value) for r in held.collect()}
    assert len(store._live()[1]) == 1
    store.set("k0", b"new")
    assert everything(store) == {**before, "k0": b"new"}


def test_a_failed_write_is_not_seen(spark, store, monkeypatch):
    store.set("a", b"1")
    bad = spark.createDataFrame([("a", 1), ("b", 0)], "key string, n int").selectExpr("key", "cast(if(n = 1, 'x', raise_error('no')) as binary) as value")
    with pytest.raises(Exception, match="no"):
        store.put(bad)
    assert everything(store) == {"a": b"1"}
    # rows are there, but the writer died before it named them
    monkeypatch.setattr(spark.__class__, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("died")))
    good = spark.range(1).selectExpr("'a' as key", "cast('2' as binary) as value")
    with pytest.raises(RuntimeError, match="died"):
        store.put(good)
    monkeypatch.undo()
    assert everything(store) == {"a": b"1"}


def test_altitude(store):
    assert K.altitude(store) == K.DEFAULT_ALTITUDE_FT
    assert K.set_altitude(store, "900.4") and K.altitude(store) == 900
    assert not K.set_altitude(store, 20_000) and not K.set_altitude(store, "high") and not K.set_altitude(store, "nan")
    assert K.altitude(store) == 900
    store.set("altitude_ft", b"rubbish")
    assert K.altitude(store) == K.DEFAULT_ALTITUDE_FT


def test_stock_image(store):
    assert K.stock_image(store) is None
    K.set_stock_image(store, "stock.bin", bytes(range(256)) * 4)
    assert K.stock_image(store) == ("stock.bin", bytes(range(256)) * 4)
    K.clear_stock_image(store)
    assert K.stock_image(store) is None


def test_last_patch_set_replaces_the_one_before(spark, store):
    assert K.last_patches(store).collect() == []
    patch = lambda *rows: spark.createDataFrame(rows, K.PATCH)
    K.set_last_patches(store, patch(("fuel", "Main VE", 1000, 40, 1.5), ("fuel", "Main VE", 1000, 40, 1.5), ("spark", "Spark", 2000, 50, -1.0)))
    assert K.last_patches(store).count() == 3
    K.set_last_patches(store, patch(("fuel", "Main VE", 1500, 30, -2.25)))
    store.compact()
    assert [tuple(r) for r in K.last_patches(store).collect()] == [("fuel", "Main VE", 1500, 30, -2.25)]


def test_library(spark, store):
    tables = spark.createDataFrame([("Main VE", 0x100, 17), ("Spark", 0x300, 20)], "title string, address int, n_rows int")
    K.add_to_library(store, tables)
    K.add_to_library(store, tables.where("title = 'Spark'").selectExpr("title", "address + 1 as address", "n_rows"))
    K.remove_from_library(store, ["Main VE", "nothing"])
    assert [tuple(r) for r in K.library(store, "address int, n_rows int").collect()] == [("Spark", 0x301, 20)]
