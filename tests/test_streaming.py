from pyspark.sql import functions as F

from kavak.streaming import study

ROWS = [
    (1, 7, "2025-01-01", "Tarih", "a", 10, 50.0, "2025-01-01 10:00:00"),
    (1, 7, "2025-01-01", "Tarih", "a", 10, 50.0, "2025-01-01 10:00:00"),
    (2, 7, "2025-01-01", "Tarih", "a", 20, 90.0, "2025-01-01 11:00:00"),
    (3, 8, "2025-01-02", "Tarih", "b", 5, None, "2025-01-01 18:00:00"),
]


def folder(spark, path):
    rows = spark.createDataFrame(ROWS, "log_id bigint, student_id bigint, date string, subject string, topic string, duration int, score double, logged_at string")
    rows.withColumn("logged_at", F.to_timestamp("logged_at")).write.parquet(path)
    return study.study_stream(spark, path)


def test_windows_and_sessions(spark, tmp_path):
    log = folder(spark, str(tmp_path / "log"))
    for name, rows, mode in (("w", study.windowed(log), "append"), ("s", study.sessions(log), "append")):
        q = study.run_to_folder(rows, str(tmp_path / name), str(tmp_path / f"c{name}"), mode)
        q.awaitTermination(120)
        assert q.exception() is None
    query = study.windowed(log).writeStream.format("memory").queryName("w_all").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("w_all").orderBy(F.desc("n_rows")).first().minutes == 35


def test_progress_state(spark, tmp_path):
    log = folder(spark, str(tmp_path / "log"))
    q = study.progress_stream(log).writeStream.format("memory").queryName("progress_state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.student_id, r.topic): r for r in spark.table("progress_state").collect()}
    assert (got[(7, "a")].attempts, got[(7, "a")].best_score, got[(7, "a")].last_score) == (3, 90.0, 90.0)
    assert got[(8, "b")].last_score is None or got[(8, "b")].last_score != got[(8, "b")].last_score
