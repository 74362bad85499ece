from echotrace.sources.store import Store
from echotrace.streaming import ingest

ROWS = [(v, t / 2, 0, [float(v), float(t)]) for v in range(3) for t in range(5)]


def test_restart_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    one = lambda rows: spark.createDataFrame(rows, ingest.ARRIVING).coalesce(1).write.mode("append").parquet(src)
    one(ROWS[:7])
    store = Store(spark, str(tmp_path / "s"))
    progress = ingest.Progress()
    spark.streams.addListener(progress)
    ingest.write_frames(ingest.frame_stream(spark, src, 1), store, str(tmp_path / "c")).awaitTermination()
    one(ROWS[5:])  # two rows arrive again
    ingest.write_frames(ingest.frame_stream(spark, src, 1), store, str(tmp_path / "c")).awaitTermination()
    spark.streams.removeListener(progress)
    got = {(r["video_id"], float(r["ts"]), r["mirrored"], tuple(r["embedding"])) for r in store.frames(complete=False).collect()}
    assert got == {(v, t, m, tuple(e)) for v, t, m, e in ROWS} and store.n_vectors() == 15


def test_videos_complete_once(spark, tmp_path):
    src = str(tmp_path / "b")
    rows = [(1, 2, 0, 64, True), (1, 2, 1, 64, True), (2, 3, 0, 10, True), (2, 3, 0, 10, False), (3, 1, 0, 5, False)]
    spark.createDataFrame(rows, ingest.BATCHES).coalesce(1).write.parquet(src)
    spark.createDataFrame([(2, 3, 0, 10, True), (1, 2, 0, 9, True)], ingest.BATCHES).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ingest.BATCHES).option("maxFilesPerTrigger", 1).parquet(src)
    q = ingest.completed_videos(stream).writeStream.format("memory").queryName("done").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["video_id"]: (r["received"], r["n_frames"], r["status"]) for r in spark.sql("SELECT * FROM done").collect()}
    assert got[3] == (1, 0, "failed") and got[2] == (3, 20, "failed") and got[1][2] == "complete"
