"""The state log: newest rows whatever is folded, also after a compaction that died."""

from pyspark.sql import functions as F

from litweave.sources.state_log import StateLog

DDL = "k string, v int, updated_at long"


def rows(spark, *found):
    return spark.createDataFrame(found, DDL)


def newest(log):
    return sorted(tuple(r) for r in log.read().collect())


def test_newest_rows_with_and_without_snapshots(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "log"), DDL, ["k"], ["updated_at", "v"])
    assert newest(log) == []
    log.compact()
    log.append(rows(spark, ("a", 1, 1), ("b", 1, 1), ("a", 2, 2)))
    log.append(rows(spark))
    assert newest(log) == [("a", 2, 2), ("b", 1, 1)]
    log.compact()
    log.compact()  # nothing new
    assert newest(log) == [("a", 2, 2), ("b", 1, 1)]
    log.append(rows(spark, ("a", 0, 1), ("b", 9, 3), ("c", 5, None)))
    assert newest(log) == [("a", 2, 2), ("b", 9, 3), ("c", 5, None)]
    log.compact()
    assert newest(log) == [("a", 2, 2), ("b", 9, 3), ("c", 5, None)]


def test_folded_batches_are_not_read(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "log"), DDL, ["k"], ["updated_at"])
    for v in range(3):
        log.append(rows(spark, ("a", v, v)))
    log.compact()
    log.append(rows(spark, ("b", 7, 7)))
    _, snapshot, folded = log._pointer()
    assert len(folded) == 3
    files = log._versions(snapshot, folded).select(F.input_file_name()).distinct().collect()
    assert len(files) == 2 and sum("/snapshots/" in r[0] for r in files) == 1


def test_a_compaction_that_died_changes_nothing(spark, tmp_path):
    log = StateLog(spark, str(tmp_path / "log"), DDL, ["k"], ["updated_at"])
    log.append(rows(spark, ("a", 1, 1)))
    rows(spark, ("a", 99, 99)).write.parquet(f"{log.path}/snapshots/left-behind")
    assert newest(log) == [("a", 1, 1)]
    log.compact()
    version = log._pointer()[0]
    # two at once: both pointers name whole snapshots, one is taken
    log.append(rows(spark, ("b", 2, 2)))
    spark.createDataFrame([(version + 1, log._pointer()[1], log._pointer()[2])], "version long, snapshot string, folded array<string>").write.mode("append").parquet(f"{log.path}/pointers")
    log.compact()
    assert newest(log) == [("a", 1, 1), ("b", 2, 2)]
