import json
import os

from siftstone.operators.cache import SNAPSHOT
from siftstone.plans.store import Store
from siftstone.sources.logs import ActivityReader, LogSink
from siftstone.streaming import feeds

LISTING = "hash string, path string, normalized_path string, file_name string, source_root string, size long, modified_ns long"


def entry(i, level="info"):
    return json.dumps({"seq": i, "ts": f"2024-01-01T00:{i:02d}:00+00:00", "level": level, "message": str(i)})


def test_log_feed_resumes_where_it_stopped(spark, tmp_path):
    logs, out, mark = (str(tmp_path / x) for x in ("logs", "out", "mark"))
    os.makedirs(logs)

    def add(name, numbers):
        with open(f"{logs}/{name}", "w") as f:
            f.write("\n".join(entry(i) for i in numbers))

    def run():
        q = feeds.log_feed(spark, logs, since=2).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r["seq"] for r in spark.read.parquet(out).collect())

    add("1.json", range(4))
    assert run() == [2, 3]
    add("2.json", range(4, 6))
    assert run() == [2, 3, 4, 5]


def test_activity_is_read_once_over_restarts(spark, tmp_path):
    """Entries are neither lost nor repeated, in tasks of a few bytes; a line that is being written waits."""
    sink, out, mark = LogSink(f"{tmp_path}/logs/activity.jsonl"), str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        feed = feeds.activity_feed(spark, sink.path, taskBytes="64")
        feed.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r["seq"], r["message"]) for r in spark.read.schema(feed.schema).parquet(out).collect())

    said = ["one", "zwei ü", "x" * 300, "four"]
    for m in said:
        sink.info(m)
    with open(sink.path, "a", encoding="utf-8") as f:
        f.write('{"seq": 4, "ts": "t", "level": "warn", "mess')
    assert run() == list(enumerate(said))
    with open(sink.path, "a", encoding="utf-8") as f:
        f.write('age": "five"}\n')
    assert run() == run() == list(enumerate([*said, "five"]))
    sink.warn("six")
    assert sorted(m for _, m in run()) == sorted([*said, "five", "six"])


def test_offsets_count_entries(tmp_path):
    path = tmp_path / "a.jsonl"
    reader = ActivityReader({"path": str(path), "taskbytes": "10"})
    assert reader.latestOffset() == {"entries": 0, "byte": 0} == reader.initialOffset()
    lines = [json.dumps({"seq": i, "message": "m" * (i * 7 % 40)}) + "\n" for i in range(50)]
    path.write_text("".join(lines[:30]))
    first = reader.latestOffset()
    path.write_text("".join(lines))
    last = reader.latestOffset()
    assert (first["entries"], last["entries"]) == (30, 50)
    for a, b, want in ((reader.initialOffset(), first, range(30)), (first, last, range(30, 50)), (last, last, [])):
        assert [r[0] for p in reader.partitions(a, b) for r in reader.read(p)] == list(want)


def test_level_counts_by_event_time(spark, tmp_path):
    logs = str(tmp_path / "logs")
    os.makedirs(logs)
    with open(f"{logs}/a.json", "w") as f:
        f.write("\n".join([entry(1), entry(2), entry(7), entry(8, "warn")]))
    q = feeds.level_counts(feeds.log_feed(spark, logs)).writeStream.format("memory").queryName("levels").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["window"]["start"].minute, r["level"], r["n"]) for r in spark.sql("select * from levels").collect())
    assert got == [(0, "info", 2), (5, "info", 1), (5, "warn", 1)]


def test_ingest_keeps_the_cache_up_to_date(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    at, mark = str(tmp_path / "in"), str(tmp_path / "mark")

    def add(rows):
        spark.createDataFrame(rows, LISTING).select(SNAPSHOT).coalesce(1).write.mode("append").parquet(at)

    def run():
        stream = spark.readStream.schema(LISTING).parquet(at)
        feeds.ingest(store, stream, mark, lambda: "now").start().awaitTermination()
        return {r["normalized_path"]: r["hash"] for r in store.read("files").collect()}

    add([("h1", "/a", "/a", "a", "/", 1, 1), ("h1", "/b", "/b", "b", "/", 1, 1)])
    assert run() == {"/a": "h1", "/b": "h1"}
    add([("h2", "/a", "/a", "a", "/", 2, 2)])
    assert run() == {"/a": "h2", "/b": "h1"}


def test_running_duplicates(spark, tmp_path):
    at = str(tmp_path / "in")
    spark.createDataFrame([("h", "/a", "/a", "a", "/", 1, 1), ("h", "/b", "/b", "b", "/", 1, 1)], LISTING).write.parquet(at)
    q = feeds.duplicate_counts(spark.readStream.schema(LISTING).parquet(at)).writeStream.format("memory").queryName("dups").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select copies from dups").first()[0] == 2
