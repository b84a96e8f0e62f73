"""Saves by key, files from executors, and tables of an embedded database."""

import os
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.sources import artifacts, files, saves, tables

ROW = "id string, batch_id string, text string, updated_at string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def read(spark, folder, **k):
    return sorted(tuple(r) for r in saves.load(spark, folder, ROW, **k).collect())


def test_the_last_save_of_a_key_counts(spark, tmp_path):
    folder = str(tmp_path / "docs")
    assert read(spark, folder) == []
    assert saves.save(rows(spark, ("a", "x", "1", "2024-01-01"), ("b", "x", "1", "2024-01-01")), folder, "one", partition="batch_id")
    assert saves.save(rows(spark, ("a", "x", "2", "2024-02-01"), ("c", "y", "1", None)), folder, "two", partition="batch_id")
    # delivered late, but older; delivered again under its token
    assert saves.save(rows(spark, ("a", "x", "0", "2023-01-01"), ("c", "y", "2", "2020-01-01")), folder, "three", partition="batch_id")
    assert not saves.save(rows(spark, ("a", "x", "9", "2030-01-01")), folder, "two", partition="batch_id")
    want = [("a", "x", "2", "2024-02-01"), ("b", "x", "1", "2024-01-01"), ("c", "y", "2", "2020-01-01")]
    assert read(spark, folder) == want
    assert read(spark, folder, where=F.col("batch_id") == "y") == want[2:]
    plan = saves.load(spark, folder, ROW, where=F.col("batch_id") == "y")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "batch_id" in plan.split("PartitionFilters")[1].split("]")[0]
    saves.compact(spark, folder, ROW, partition="batch_id")
    assert len(saves.tokens(spark, folder)) == 1 and read(spark, folder) == want


def test_writers_and_failures(spark, tmp_path):
    folder = str(tmp_path / "docs")
    two = [threading.Thread(target=saves.save, args=(rows(spark, ("a", "x", who, "2024-01-01")), folder, token)) for who, token in (("p", "same"), ("q", "same"), ("r", "other"))]
    for t in two:
        t.start()
    for t in two:
        t.join()
    assert saves.tokens(spark, folder) == ["other", "same"] and len(read(spark, folder)) == 1
    before = read(spark, folder)
    bad = rows(spark, ("b", "x", "1", "2024-01-01")).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        saves.save(bad, folder, "broken")
    with pytest.raises(Exception, match="without id"):
        saves.save(rows(spark, (None, "x", "1", "2024-01-01")), folder, "keyless")
    assert read(spark, folder) == before and saves.tokens(spark, folder) == ["other", "same"]
    assert saves.save(rows(spark, ("b", "x", "1", "2024-01-01")), folder, "broken") and len(read(spark, folder)) == 2


def test_files_hold_their_pieces_in_order(spark, tmp_path):
    folder = str(tmp_path / "out" / "v1")
    pieces = [("a/one.md", 0, "Né\n"), ("a/two.html", 0, "<p>"), ("a/two.html", 2, "</p>"), ("a/two.html", 1, "x" * 100_000), ("b/empty.md", 0, None), (None, 0, "lost")]
    d = spark.createDataFrame(pieces, "path string, part int, content string").repartition(5)
    assert artifacts.write_files(d, folder) and not artifacts.write_files(d, folder)
    want = {"a/one.md": "Né\n", "a/two.html": "<p>" + "x" * 100_000 + "</p>", "b/empty.md": ""}
    got = {os.path.relpath(os.path.join(top, n), folder): open(os.path.join(top, n), encoding="utf-8").read() for top, _, names in os.walk(folder) for n in names if not top.endswith("/" + artifacts.LISTING)}
    assert got == want
    assert {(r.path, r.bytes, r.crc32) for r in artifacts.listing(spark, folder).collect()} == {(p, len(c.encode()), zlib.crc32(c.encode())) for p, c in want.items()}
    broken = d.withColumn("content", F.when(F.col("part") == 2, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        artifacts.write_files(broken, str(tmp_path / "out" / "v2"))
    assert not files.exists(spark, str(tmp_path / "out" / "v2"))


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    """An embedded database in the session's JVM."""
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true"
    jvm = spark._jvm
    jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    c = jvm.java.sql.DriverManager.getConnection(url)
    run = c.createStatement().execute
    run("CREATE TABLE voice_packs (id VARCHAR(9), name VARCHAR(20), source VARCHAR(20), sample_text VARCHAR(99), sample_size INT, profile VARCHAR(99), created_at VARCHAR(30))")
    run("INSERT INTO voice_packs VALUES ('p', 'Pack', NULL, 'x', 3, '{}', '2024'), ('q', 'Other', 'import', NULL, NULL, NULL, NULL)")
    run("CREATE TABLE batch_runs (id VARCHAR(9), name VARCHAR(20), status VARCHAR(20))")
    run("INSERT INTO batch_runs VALUES ('b1', 'One', 'done'), ('b2', 'Two', 'queued'), ('b3', 'Empty', 'done')")
    run("CREATE TABLE batch_documents (id VARCHAR(9), batch_run_id VARCHAR(9), sequence_no INT, original_text VARCHAR(99))")
    run("INSERT INTO batch_documents VALUES " + ", ".join(f"('d{i}', 'b{i % 2 + 1}', {20 - i}, 'text {i}')" for i in range(20)))
    return url


def test_tables_are_scanned_in_ranges_and_joined_once(spark, database):
    packs = {r.id: r for r in tables.voice_packs(spark, database).collect()}
    assert packs["p"].source == "manual" and (packs["q"].sample_text, packs["q"].sample_size, packs["q"].profile, packs["q"].created_at) == ("", 0, "{}", "")
    got = tables.batches(spark, database, F.col("status") == "done", split=("SEQUENCE_NO", 1, 20, 4))
    rows = {r.id: r for r in got.collect()}
    assert set(rows) == {"b1", "b3"} and rows["b3"].documents == []
    assert [d.id for d in rows["b1"].documents] == [f"d{i}" for i in range(18, -1, -2)] and rows["b1"].documents[0].original_text == "text 18"
    assert tables.scan(spark, database, "batch_documents", split=("SEQUENCE_NO", 1, 20, 4)).rdd.getNumPartitions() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(STATUS), *EqualTo(STATUS,done)" in plan
    index = tables.document_index(spark, database)
    assert {(r.doc_id, r.batch_id) for r in index.collect()} == {(f"d{i}", f"b{i % 2 + 1}") for i in range(20)}
    assert "ORIGINAL_TEXT" not in index._jdf.queryExecution().executedPlan().toString()
