"""Tables that are kept between runs."""

from loomgraph.sources import stores


def test_hash_store(spark, tmp_path):
    s = stores.HashStore(spark, f"file://{tmp_path}/hashes")
    rows = lambda *r: spark.createDataFrame(list(r), stores.HASHES)
    assert s.read().count() == 0 and s.get("a").count() == 0
    s.upsert(rows(("a", "1", 5, 10), ("b", "2", 6, 20), ("a", "0", 5, 9)))
    assert s.get("a").first()["hash"] == "1" and s.changed_since(10).count() == 1
    s.upsert(rows(("a", "9", 7, 5), ("c", "3", 1, 30)))
    assert {r["path"]: r["hash"] for r in s.read().collect()} == {"a": "9", "b": "2", "c": "3"}
    s.delete(spark.createDataFrame([("b",), ("zz",)], "path string"))
    assert sorted(r["path"] for r in s.paths().collect()) == ["a", "c"]
    (tmp_path / "hashes/v99").mkdir()  # a write that did not end
    assert s.read().count() == 2


def test_logs_vectors_and_reports(spark, tmp_path):
    log = stores.AuditLog(spark, f"file://{tmp_path}/audit")
    log.append("update", "x")
    log.append("update", "y")
    assert sorted(r["detail"] for r in log.read().collect()) == ["x", "y"]
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("f", [1.0, 0.0])], "id string, embedding array<float>")

    v = stores.VectorStore(spark, f"file://{tmp_path}/vectors")
    assert v.load("k1", make).count() == v.load("k1", make).count() == 1 and len(made) == 1
    v.load("k2", make)
    assert len(made) == 2
    stores.write_reports({"main": spark.createDataFrame([("graph LR\n  a",)], "report string")}, f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out/main", wholetext=True).first()[0].startswith("graph LR")


def test_cache():
    now, loads = [0.0], []
    c = stores.Cached(lambda: loads.append(1) or len(loads), 30, lambda v: v == 2, lambda: now[0])
    assert c.get() == c.get() == 1
    now[0] = 31
    assert c.get() == 2 and c.get() == 3 and c.get() == 3
