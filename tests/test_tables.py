"""Published tables: pruning, publication all at once, crashes, replays and compaction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import tables as S
from tidemark.streaming import intake as Z

TABLE_DDL = "stock_id bigint, trade_date date, adjust_type string, close double"
FEED = "stock_id bigint, date string, adjust_type string, close double, seq bigint"


def frame(spark, rows, part="part"):
    return spark.createDataFrame(rows, f"id int, {part} string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_parts_are_exchanged_and_appended(spark, tmp_path):
    store = S.TableStore(spark, str(tmp_path))
    first = store.publish(store.manifest(), replace={"t": frame(spark, [(1, "a"), (2, "b")])})
    second = store.publish(first, replace={"t": frame(spark, [(3, "b")])}, append={"u": frame(spark, [(9, "x")])})
    assert ids(store.read("t")) == [1, 3] and ids(store.read("u")) == [9]
    third = store.publish(second, append={"t": frame(spark, [(4, "b")])}, emptied={"t": ["a"]})
    assert ids(store.read("t")) == [3, 4] and ids(store.read("t", parts=["a"])) == []
    assert ids(store.read("t", manifest=first)) == [1, 2]  # readers keep what they began with
    assert len(store.read("t", parts=["b"]).inputFiles()) == len(third.folders("t", ["b"]))


def test_two_writers_cannot_both_publish(spark, tmp_path):
    store = S.TableStore(spark, str(tmp_path))
    base = store.publish(store.manifest(), replace={"t": frame(spark, [(1, "a")])})
    store.publish(base, append={"t": frame(spark, [(2, "a")])})
    with pytest.raises(S.Conflict):
        store.publish(base, append={"t": frame(spark, [(3, "a")])})
    assert ids(store.read("t")) == [1, 2]


def test_crash_between_two_tables_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = S.TableStore(spark, str(tmp_path))
    base = store.publish(store.manifest(), replace={"t": frame(spark, [(1, "a")]), "u": frame(spark, [(1, "a")])})
    write = S.TableStore.write

    def dies(self, table, rows, *level):
        if table == "u":
            raise KeyboardInterrupt
        return write(self, table, rows, *level)

    monkeypatch.setattr(S.TableStore, "write", dies)
    with pytest.raises(KeyboardInterrupt):
        store.publish(base, append={"t": frame(spark, [(2, "a")]), "u": frame(spark, [(2, "a")])})
    monkeypatch.undo()
    assert ids(store.read("t")) == ids(store.read("u")) == [1]
    store.publish(store.manifest(), append={"t": frame(spark, [(3, "a")]), "u": frame(spark, [(3, "a")])})
    assert ids(store.read("t")) == ids(store.read("u")) == [1, 3]
    assert store.vacuum(1) >= 1 and ids(store.read("t")) == [1, 3]


def test_folders_of_a_part_are_joined_in_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FAN", 3)
    store = S.TableStore(spark, str(tmp_path))
    now, put = store.manifest(), S.TableStore._put
    for n in range(8):
        now = store.publish(now, append={"t": frame(spark, [(n, "a"), (100 + n, f"p{n}")])})
        assert len(now.folders("t", ["a"])) <= 4  # two levels
    # A crash during compaction changes nothing.
    monkeypatch.setattr(S.TableStore, "_put", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    for n in (8, 9):
        with pytest.raises(KeyboardInterrupt):
            store.publish(now, append={"t": frame(spark, [(n, "a")])})
    monkeypatch.setattr(S.TableStore, "_put", put)
    assert ids(store.read("t")) == [*range(8), *range(100, 108)]
    store.vacuum(1)
    assert ids(store.read("t")) == [*range(8), *range(100, 108)]


def test_upsert_reads_only_the_months_that_come_in(spark, tmp_path):
    store, TABLE = S.TableStore(spark, str(tmp_path)), StructType.fromDDL(TABLE_DDL)
    days = [dt.date(2025, m, d) for m in range(1, 13) for d in (3, 17)]
    rows = [(s, str(d), "qfq", 1.0, k) for k, d in enumerate(days) for s in range(20)]
    Z.publish_bars(store, spark.createDataFrame(rows, FEED), "2026-01-06 08:00:00", TABLE, buckets=4)
    before = store.manifest()
    counts = Z.publish_bars(store, spark.createDataFrame(
        [(1, "2025-05-03", "qfq", 2.0, 1), (1, "2025-05-04", "qfq", 3.0, 2), (1, "bad", "qfq", 3.0, 3)], FEED), "2026-01-06 08:00:00", TABLE)
    assert [tuple(r) for r in counts.collect()] == [(1, 1, 1, 1)]
    after = store.manifest()
    part = [p for p in after.parts["bars"] if after.parts["bars"][p] != before.parts["bars"].get(p)]
    assert len(part) == 1 and part[0].startswith("2025-05-b")
    got = {(r.stock_id, str(r.trade_date)): r.close for r in store.read("bars", TABLE).collect()}
    assert len(got) == len(rows) + 1 and got[1, "2025-05-03"] == 1.0 and got[1, "2025-05-04"] == 3.0
    assert len(store.read("bars", TABLE, part).inputFiles()) == 1 < len(store.read("bars", TABLE).inputFiles())


def test_topic_batches_read_no_more_as_the_table_grows(spark, tmp_path, monkeypatch):
    schema = "topic_id string, title string, content string, seq bigint"
    read, reads = S.TableStore.read, []

    def counted(self, table, *args, **kw):
        df = read(self, table, *args, **kw)
        reads.append((table, len(df.inputFiles())))
        return df

    for n in range(4):
        spark.createDataFrame([(f"t{i}", "", f"text {n}", i) for i in range(10 * n, 10 * n + 14)], schema).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
        stream = Z.read_stream(spark, str(tmp_path / "in"), StructType.fromDDL(schema))
        if n == 3:
            monkeypatch.setattr(S.TableStore, "read", counted)
        Z.stream_topics(stream, str(tmp_path / "out"), str(tmp_path / "state"), buckets=4).awaitTermination()
    monkeypatch.undo()
    assert sum(k for t, k in reads if t == "keys") <= 4 * 3
    got = {r.topic_id: r.content for r in Z.current_topics(spark, str(tmp_path / "out"), StructType.fromDDL(schema)).collect()}
    assert got == {f"t{i}": f"text {max(0, min((i - 4) // 10, 3))}" for i in range(44)}


def test_replayed_batch_finds_itself_done(spark, tmp_path, monkeypatch):
    """The driver dies after publishing, before Spark notes the batch: the batch comes again and changes nothing."""
    schema = StructType.fromDDL("topic_id string, title string, content string, seq bigint")
    spark.createDataFrame([("a", "", "x", 1), ("b", "", "y", 2)], schema).write.parquet(str(tmp_path / "in"))
    publish = S.TableStore.publish

    def dies(self, *args, **kw):
        publish(self, *args, **kw)
        raise RuntimeError("lost driver")

    monkeypatch.setattr(S.TableStore, "publish", dies)
    def run():
        Z.stream_topics(Z.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    with pytest.raises(Exception, match="lost driver"):
        run()
    monkeypatch.undo()
    state = Z.topic_store(spark, str(tmp_path / "out")).manifest()
    run()
    assert Z.topic_store(spark, str(tmp_path / "out")).manifest() == state
    assert Z.current_topics(spark, str(tmp_path / "out"), schema).count() == 2
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("topic_id") == "a").count() == 1
