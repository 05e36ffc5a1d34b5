"""Versioned tables, the merged batch log, stored cells and the median under outliers."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarry.operators import dense
from quarry.operators import extraction as kg
from quarry.operators.ordered import exact_median
from quarry.sources import files
from quarry.sources.versions import Manifest, VersionedTable
from quarry.streaming import jobs
from quarry.streaming.log import BatchLog


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    rows = lambda pairs: spark.createDataFrame(pairs, "id long, v string")
    table.replace(rows([(1, "a"), (2, "b")]))
    before = table.read()
    # a run that stops after its rows were written and before they are committed
    monkeypatch.setattr(Manifest, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        table.upsert(rows([(2, "x"), (3, "c")]))
    monkeypatch.undo()
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "b")]
    for _ in range(2):
        table.upsert(rows([(2, "x"), (3, "c")]))
        assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "x"), (3, "c")]
    assert sorted(map(tuple, before.collect())) == [(1, "a"), (2, "b")]  # a reader of the old version goes on


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "m"))
    manifest.commit(["a"], 0)
    with pytest.raises(RuntimeError):
        manifest.commit(["b"], 0)
    assert manifest.read() == ["a"] and manifest.number() == 1


def test_rebuild_fills_positions(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, "one", None, 0, 5), ("y", 1, "t" * 70_000, 7, 1, 5)],
                                 "id string, document_id long, content string, chunk_index int, position int, extra int")
    out = files.rebuild_vectors(rows, lambda c: F.array(F.length(c).cast("double")), VersionedTable(spark, str(tmp_path / "v")))
    assert {(r.id, r.chunk_index, len(r.content), r.embedding[0]) for r in out.collect()} == {
        ("x", 0, 3, 3.0), ("y", 7, 65_000, 70_000.0)}
    assert "extra" not in out.columns


def test_what_is_replaced_is_not_read_in_full(spark, tmp_path, monkeypatch):
    table, plans, stage = VersionedTable(spark, str(tmp_path / "t")), [], VersionedTable.stage
    rows = lambda pairs: spark.createDataFrame(pairs, "id long, v string")
    table.replace(rows([(1, "a"), (2, "b"), (None, "n")]).withColumn("old", F.lit(1)))
    monkeypatch.setattr(VersionedTable, "stage", lambda self, df: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or stage(self, df))
    table.upsert(rows([(2, "x"), (3, "c")]))
    assert sorted(map(str, table.read().collect())) == sorted(map(str, [
        Row(id=1, v="a", old=1), Row(id=None, v="n", old=1), Row(id=2, v="x", old=None), Row(id=3, v="c", old=None)]))
    table.replace(rows([(1, "a"), (2, "b")]).withColumn("old", F.lit(1)))
    table.upsert(rows([(1, "x"), (2, "y"), (3, "z")]))
    assert sorted(map(tuple, table.read().collect())) == [(1, "x", None), (2, "y", None), (3, "z", None)]
    assert "Join" in plans[0] and "Join" not in plans[2]


def test_rebuild_deals_rows_out_before_it_embeds(spark, tmp_path):
    rows = spark.range(4000).coalesce(1).select(F.col("id").cast("string").alias("id"), F.lit("a text").alias("content"))
    out = files.rebuild_vectors(rows, lambda c: F.array(F.length(c).cast("double")), VersionedTable(spark, str(tmp_path / "v")))
    assert out.count() == 4000 and len(out.inputFiles()) == spark.sparkContext.defaultParallelism


def test_merged_log_keeps_few_folders(spark, tmp_path):
    """Ten batches of overlapping documents, one of them again: the entities of the plain log, from three folders at most."""
    text = lambda i: f"精灵名称: fox {i % 4}\n主属性: fire{i % 3}\n体型: {i}\n更新版本: v{i}"
    schema = "document_id long, text string, filename string, created_at timestamp"
    batches = [spark.createDataFrame([(i, text(i), f"{i}.txt", None), (50 - i, text(i + 1), "x.txt", None)],
                                     "document_id long, text string, filename string, created_at string").withColumn(
        "created_at", F.timestamp_seconds(F.col("document_id") % 7)) for i in range(10)]
    for b in batches:
        b.select(*[F.col(c) for c in ("document_id", "text", "filename", "created_at")]).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    mapping = kg.mapping_table(spark)
    key = lambda df: sorted(map(str, df.withColumn("properties", F.array_sort(F.map_entries("properties"))).collect()))
    plain = jobs.entity_upserts(stream(), mapping, BatchLog(spark, "plain", str(tmp_path / "plain")))
    log = jobs.entity_log(spark, "merged", str(tmp_path / "merged"))
    merged = jobs.entity_upserts(stream(), mapping, log)
    assert key(merged) == key(plain) and len(log.segments()) <= 3
    assert [s[1:] for s in log.segments()][0][0] == 0 and log.segments()[-1][2] == 9
    low, high = log.segments()[0][1:]
    log.write(spark.read.parquet(str(tmp_path / "plain/data")).filter(f"batch = {low}").drop("batch"), low)  # arrives again
    assert key(kg.upsert_entities(log.read(), ["created_at", "document_id"])) == key(plain) and len(log.segments()) <= 3


def test_stored_cells(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    points = [(i, (centres[i % 12] + rng.normal(scale=0.6, size=16)).tolist()) for i in range(1200)] + [(5000, [0.0] * 16)]
    corpus = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, points[i * 29][1]) for i in range(30)], "query_id long, vec array<double>")
    index = dense.CellIndex.build(corpus.filter("vec_id < 800"), n_cells=64, path=str(tmp_path / "cells"))
    index.add(corpus.filter("vec_id >= 800"))
    again = dense.CellIndex(spark, str(tmp_path / "cells"))  # from its folder, without a fit
    assert again.cells.count() == 1200
    want = {(r.query_id, r.id) for r in dense.dense_topk(corpus, queries, 10, "cosine", "vec_id", "embedding", "query_id", "vec").collect()}
    got = {(r.query_id, r.id) for r in again.search(queries, 10, n_probe=16).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert {(r.query_id, r.id) for r in again.search(queries, 10, n_probe=64).collect()} == want
    one = again.probed(spark.createDataFrame([(3,)], "cell int"))
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString() and one.count() < 1200


@pytest.mark.parametrize("cells", [4, 100, 4096])
def test_median_with_outliers(spark, cells):
    rng = np.random.default_rng(3)
    values = {"wide": [*rng.normal(size=1500), 1e12], "powers": [2.0**i for i in range(-500, 501)], "copies": [7.0] * 900 + [1.0, 9.0],
              "two": [1.0, 4.0], "one": [5.0], "even": list(range(1000)), "low": [-1e300, *rng.uniform(size=700)]}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("even", None)]
    got = {r.metric: r.median for r in exact_median(spark.createDataFrame(rows, "metric string, value double"), ["metric"], "value", cells).collect()}
    assert got == {k: float(np.median(v)) for k, v in values.items()}


def test_rebuild_leaves_rows_where_they_are_well_spread(spark, tmp_path):
    """Rows in enough tasks are not shuffled to be embedded, and what an upsert stages on the way is deleted."""
    table, plans = VersionedTable(spark, str(tmp_path / "v")), []
    stage = table.stage
    table.stage = lambda rows: plans.append(rows._jdf.queryExecution().toString()) or stage(rows)
    rows = spark.range(0, 40, 1, 8).select(F.col("id").cast("string").alias("id"), F.lit("text").alias("content"))
    embed = lambda c: F.array(F.length(c).cast("double"))
    for given in (rows, rows.filter("id < 9"), rows.coalesce(1)):
        files.rebuild_vectors(given, embed, table)
    assert ["Repartition" in plan for plan in plans] == [False, False, True]
    assert sorted(int(r.id) for r in table.read().collect()) == list(range(40))


def test_upsert_deletes_the_keys_it_staged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarry.session.shared_dir", lambda spark, purpose: str(tmp_path / "staged" / purpose))
    table = VersionedTable(spark, str(tmp_path / "v"))
    table.replace(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"))
    table.upsert(spark.createDataFrame([(2, "c")], "id long, x string"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "c")]
    assert list((tmp_path / "staged").iterdir()) == []
