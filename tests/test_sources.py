import os
import struct
import time

from pyspark.sql import functions as F

from sluiceway.operators.rules import PathRules
from sluiceway.sources import journal, retry, text
from sluiceway.streaming.run import chain, supervise
from sluiceway.streaming.sink import BatchSink, BatchWriter, DeliveryError, dropped_bodies, http_post, saved_offsets, send_due
from sluiceway.streaming.stateful import exact_batches, high_water_stream, use_rocksdb
from sluiceway.streaming.tail import TailReader, TailSource


def test_journal_records():
    binary = b"MESSAGE\n" + struct.pack("<Q", 7) + b"foo\nbar\n" + b"_SYSTEMD_UNIT=u\n\n"
    data = b"MESSAGE=one\nCONTAINER_NAME=c\n\nnot a field\nMESSAGE=lost\n\n" + binary + b"MESSAGE=last\n"
    got = list(journal.records(data))
    assert [r["MESSAGE"] for r in got] == [b"one", b"foo\nbar", b"last"]


def test_read_journal(spark, tmp_path):
    (tmp_path / "a.export").write_bytes(b"MESSAGE=hi\n__REALTIME_TIMESTAMP=1700000000123456\nSYSLOG_IDENTIFIER=s\n\nPRIORITY=6\n\nMESSAGE=\xff\n")
    rows = sorted(map(tuple, journal.read_journal(spark, str(tmp_path)).collect()))
    assert rows == [("hi", "s", 1700000000), ("�", "UNKNOWN_SYSTEMD_APP", None)]


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\xff\n")
    (tmp_path / "b.txt").write_text("no\n")
    rows = text.read_text(spark, [str(tmp_path)], PathRules()).collect()
    assert sorted(r.line for r in rows) == ["one\r", "two�"] and all(r.file.endswith("/a.log") for r in rows)
    docs = spark.createDataFrame([(1, "a\nbé\n"), (2, ""), (3, None), (4, "x")], "k int, text string")
    got = text.with_offsets(text.split_lines(docs), "k").orderBy("k", "n").collect()
    assert [(r.k, r.line, r.start, r.end) for r in got] == [(1, "a", 0, 2), (1, "bé", 2, 6), (2, "", 0, 1), (3, "", 0, 1), (4, "x", 0, 2)]
    assert [r.line for r in text.split_lines(docs.where("k = 4"), whole_only=True).collect()] == []


def test_retry_quota_counts_what_is_kept():
    names = [(str(i), 40) for i in range(4)] + [("small", 15), ("rest", 5)]
    assert retry.keep_within(names, 100, 0) == (["0", "1", "small", "rest"], ["2", "3"])
    assert retry.keep_within(names, 100, 90) == (["rest"], ["0", "1", "2", "3", "small"]) and retry.keep_within(names, None, 9)[1] == []


def test_retry_files_replay(spark, tmp_path):
    """Named files, written twice as a task that runs again would, read when due, plain ones too, and deleted."""
    folder = f"file://{tmp_path}/files"
    failed = spark.createDataFrame([("s", 1, '{"lines":[]}', "o1"), ("s", 2, "{}", None)], "stream string, batch_id bigint, body string, offsets string")
    for _ in range(2):
        assert retry.write_files(failed, folder, F.lit(1000)).count() == 2
    (tmp_path / "files" / "1001_plain.retry").write_text('{"body": "plain", "offsets": null}')
    (tmp_path / "files" / "5000_late.retry").write_text('{"body": "late"}')
    (tmp_path / "files" / "1000_x.other").write_text("no")
    ready = retry.read_files(spark, folder, F.lit(2000), 15)
    assert sorted((r.body, r.offsets) for r in ready.collect()) == [("plain", None), ('{"lines":[]}', "o1"), ("{}", None)]
    assert all(r.deleted for r in retry.delete_files(ready).collect())
    assert sorted(x.name for x in (tmp_path / "files").iterdir() if not x.name.startswith(".")) == ["1000_x.other", "5000_late.retry"]


def test_tail_reads_a_line_longer_than_a_trigger_and_restarts_where_it_was(tmp_path):
    (tmp_path / "a.log").write_text("x" * 50 + "\nshort\n")
    options = {"path": str(tmp_path), "lookback": "start", "maxbytespertrigger": "10"}
    reader = TailReader(options)
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert [(r.start, r.end) for r in reader.partitions(start, end)] == [(0, 51)]
    later = reader.latestOffset()
    assert [(r.start, r.end) for r in reader.partitions(end, later)] == [(51, 57)]
    with open(tmp_path / "a.log", "a") as f:
        f.write("more\n" * 10)
    again = TailReader(options)  # a new reader of a query that goes on from its checkpoint
    now = again.latestOffset()
    assert [(r.start, r.end) for r in again.partitions(later, now)] == [(57, 107)]
    with open(tmp_path / "a.log", "a") as f:
        f.write("last\n" * 4)
    assert [(r.start, r.end) for r in again.partitions(now, again.latestOffset())] == [(107, 117)]


def test_tail_reads_gaps_first_and_keeps_its_limit_after_a_restart(tmp_path):
    from sluiceway.streaming.tail import gaps, union, without

    assert union([[5, 7], [0, 2], [2, 3], [6, 9], [4, 4]]) == [[0, 3], [5, 9]]
    assert without([[0, 10], [20, 30]], [[2, 4], [8, 22], [29, 40]]) == [[0, 2], [4, 8], [22, 29]]
    assert gaps([[3, 5], [9, 12]], 20) == [(0, 3, True), (5, 9, True), (12, 20, False)] and gaps([[0, 9]], 4) == []
    logs, state, saved = tmp_path / "logs", tmp_path / "reader", tmp_path / "sink"
    logs.mkdir()
    saved.mkdir()
    (logs / "a.log").write_text("0123\n" * 20)
    inode = (logs / "a.log").stat().st_ino
    # what a sink has saved: ends are inclusive
    (saved / "part.json").write_text(f'{{"file_id": {inode}, "start": 0, "end": 9}}\n{{"file_id": {inode}, "start": 30, "end": 49}}\n')
    options = {"path": str(logs), "lookback": "none", "maxbytespertrigger": "13", "state": str(state), "saved": str(saved)}
    reader = TailReader(options)
    at, seen = reader.initialOffset(), []
    for _ in range(10):
        end = reader.latestOffset()
        ranges = reader.partitions(at, end)
        assert sum(r.end - r.start for r in ranges) <= 13
        seen += [(r.start, r.end) for r in ranges]
        lines = [x for r in ranges for b in reader.read(r) for x in b.to_pylist()]
        assert all(x["line"] == "0123" and x["end"] - x["start"] == 5 and x["tries"] == 0 for x in lines) and len(lines) * 5 == sum(r.end - r.start for r in ranges)
        at, reader = end, TailReader(options)  # each trigger is one of a new process
    assert seen == [(10, 20), (20, 30), (50, 60), (60, 70), (70, 80), (80, 90), (90, 100)]
    (logs / "a.log").write_text("new\n")  # truncated, under the same inode
    reader = TailReader(options)
    assert [(r.start, r.end) for r in reader.partitions(at, reader.latestOffset())] == [(0, 4)]


def test_tail_remembers_a_file_that_is_missed_for_a_moment(tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("one\n")
    for seconds, again in (("60", []), ("0", [(0, 4)])):
        reader = TailReader({"path": str(logs), "lookback": "start", "forgetafterseconds": seconds})
        start = reader.initialOffset()
        at = reader.latestOffset()
        assert [(r.start, r.end) for r in reader.partitions(start, at)] == [(0, 4)]
        (logs / "a.log").rename(tmp_path / "elsewhere")
        (logs / "b.log").write_text("two\n")
        now = reader.latestOffset()
        assert [(r.path[-5:], r.start, r.end) for r in reader.partitions(at, now)] == [("b.log", 0, 4)]
        (tmp_path / "elsewhere").rename(logs / "a.log")
        back = reader.latestOffset()
        assert [(r.start, r.end) for r in reader.partitions(now, back)] == again
        (logs / "b.log").unlink()


def test_tail_deals_its_limit_over_files(tmp_path):
    for name, n in (("a", 100), ("b", 2), ("c", 100)):
        (tmp_path / f"{name}.log").write_text("0123\n" * n)
    reader = TailReader({"path": str(tmp_path), "lookback": "start", "maxbytespertrigger": "100"})
    start = reader.initialOffset()
    assert sorted((r.path[-5], r.end) for r in reader.partitions(start, reader.latestOffset())) == [("a", 45), ("b", 10), ("c", 45)]


def test_lines_that_are_asked_for_again_come_back_through_the_tail(spark, tmp_path):
    """Ten triggers and more: a limit of one line, a restart in between, and lines without metadata that are read again as gaps."""
    from sluiceway.streaming.tail import ask_again

    spark.dataSource.register(TailSource)
    logs, again = tmp_path / "logs", str(tmp_path / "again")
    logs.mkdir()
    (logs / "a.log").write_text("".join(f"line{i}\n" for i in range(10)))
    seen, sizes = [], []

    def batch(lines, epoch):
        lines = lines.persist()
        rows = lines.collect()
        sizes.append(len(rows))
        waits = lines.where("line IN ('line3', 'line7')").where("tries < 2 OR line = 'line7'")
        given_up = ask_again(waits, again, delay_ms=300, most=3).collect()
        asked = {r.line for r in waits.collect()} - {r.line for r in given_up}
        seen.extend((r.line, r.tries) for r in rows if r.line not in asked)
        lines.unpersist()

    def run(until):
        lines = spark.readStream.format("tail").options(path=str(logs), lookback="start", maxBytesPerTrigger="6", retries=again, state=str(tmp_path / "reader")).load()
        query = lines.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
        for _ in range(300):
            if until() or not query.isActive:
                break
            time.sleep(0.1)
        query.stop()
        assert query.exception() is None

    run(lambda: len(sizes) >= 4)
    run(lambda: len(seen) >= 10)
    assert sorted(seen) == sorted([(f"line{i}", {3: 2, 7: 3}.get(i, 0)) for i in range(10)])
    assert max(sizes) <= 2 and len(sizes) >= 10


def test_supervision_counts_failures_not_intervals():
    class Query:
        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self, seconds):  # noqa: N802
            if self.fails:
                raise ValueError
            return False

        def stop(self):
            pass

    plan = [False] * 20 + [True, False, True, False]
    queries = iter(plan)
    assert supervise(lambda: Query(next(queries)), restarts=1, every_seconds=0.0, delay_seconds=0.0, until=lambda: queries.__length_hint__() == 0) == len(plan) - 1
    try:
        supervise(lambda: Query(True), restarts=2, every_seconds=0.0, delay_seconds=0.0)
        raise AssertionError("it must give up")
    except ValueError:
        pass


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_tail_follows_growth_rotation_and_partial_lines(spark, tmp_path):
    spark.dataSource.register(TailSource)
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("one\ntwo\npart")
    lines = spark.readStream.format("tail").option("path", str(logs)).option("lookback", "start").load()
    query = lines.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    with open(logs / "a.log", "a") as f:
        f.write("ial\nthree\n")
    (logs / "a.log").rename(logs / "b.log")
    (logs / "a.log").write_text("new\n")
    time.sleep(0.2)
    _drain(query)
    got = [r.line for r in spark.sql("SELECT line FROM tailed ORDER BY file_id, start").collect()]
    assert sorted(got) == sorted(["one", "two", "partial", "three", "new"])


def _rows(*lines):
    from pyspark.sql import Row

    return iter([Row(line=x, file=f"/f{f}", file_id=f, start=s, end=e, tries=0) for x, f, s, e in lines])


def test_sink_stages_marks_and_commits(spark, tmp_path):
    """A task that fails for good, and one that runs again: nothing is posted or stored twice."""
    folder, state, posted = str(tmp_path / "retry"), str(tmp_path / "state"), []

    def post(body, key):
        posted.append(body)
        return 503 if '"c"' in body else 404 if '"bad"' in body and len(posted) < 4 else 200

    writer = BatchWriter({"retries": folder, "state": state, "capacity": "4"}, post)
    rows = [("a", 1, 0, 2), ("b", 1, 2, 4), ("c", 2, 0, 2), ("bad", 1, 4, 8)]
    for _ in range(2):  # the second run meets what the first one left; the receiver takes the body by then
        try:
            message = writer.write(_rows(*rows))
        except DeliveryError as e:
            assert str(e) == "status 404" and len(posted) == 3 and retry.stored_bytes(folder) == 0
            writer.abort([None], 7)
    assert len(posted) == 4 and len(message.delivered) == 2 and len(message.staged) == 1
    for _ in range(2):  # a commit that runs again
        writer.commit([message, None], 7)
    assert sorted(map(tuple, saved_offsets(spark, state).select("file_id", "start", "end").collect())) == [(1, 0, 7), (2, 0, 1)]
    assert not list((tmp_path / "retry" / "staged").iterdir())
    # Spark didn't learn of the commit: all runs again, and all is done
    writer.commit([writer.write(_rows(*rows))], 7)
    assert len(posted) == 4 and len(list((tmp_path / "retry").glob("*.retry"))) == 1
    writer.commit([writer.write(_rows(("d", 9, 0, 2)))], 8)
    assert len(posted) == 5 and len(list((tmp_path / "state" / "delivered").iterdir())) == 1  # marks of the batch before are gone
    assert TailReader({"path": str(tmp_path), "saved": f"{state}/offsets"})._begin()["files"] is not None
    kept = retry.read_files(spark, folder, F.lit(4_000_000_000), 15).collect()
    assert [(r.body, r.offsets) for r in kept] == [('{"lines":[{"line":"c","file":"/f2"}]}', '[{"file_id": 2, "start": 0, "end": 1}]')]
    # what waits is sent again when due: refused once more, then taken, and then there is nothing left
    assert send_due(spark, folder, lambda body, key: 200, int(time.time()), 1000) == {}
    assert send_due(spark, folder, lambda body, key: None, 3_000_000_000, 15) == {"retry": 1}
    assert send_due(spark, folder, lambda body, key: 200, 3_000_000_010, 15) == {}
    assert send_due(spark, folder, lambda body, key: 200, 3_000_000_020, 15) == {"delivered": 1}
    assert retry.stored_bytes(folder) == 0
    # a quota: a body that doesn't fit is dropped and counted, a smaller one behind it is kept
    small = BatchWriter({"retries": folder, "state": state, "limitBytes": "200"}, lambda body, key: 500)
    import random

    noise = "".join(random.Random(1).choices("abcdefghijklmnop", k=2000))
    small.commit([small.write(_rows((noise, 3, 0, 2001), ("x", 4, 0, 2)))], 9)
    assert 0 < retry.stored_bytes(folder) <= 200 and dropped_bodies(state) == 1


def test_lines_flow_from_the_tail_to_a_receiver(spark, tmp_path):
    """A receiver that fails at first: every line arrives once, and all offsets are committed."""
    import gzip
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    got, keys = [], []

    class Receiver(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            lines = json.loads(gzip.decompress(self.rfile.read(int(self.headers["Content-Length"]))))["lines"]
            keys.append(self.headers["Idempotency-Key"])
            late = len(keys) <= 2
            self.send_response(503 if late else 200)
            self.end_headers()
            if not late:
                got.extend(x["line"] for x in lines)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/"
    logs, folder, state = tmp_path / "logs", str(tmp_path / "retry"), str(tmp_path / "state")
    logs.mkdir()
    for name in "ab":
        (logs / f"{name}.log").write_text("".join(f"{name}{i}\n" for i in range(40)))
    spark.dataSource.register(TailSource)
    spark.dataSource.register(BatchSink)
    lines = spark.readStream.format("tail").options(path=str(logs), lookback="start", maxBytesPerTrigger="100", state=str(tmp_path / "reader")).load()
    query = lines.writeStream.format("batches").options(url=url, retries=folder, state=state, capacity="50").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert len(got) < 80 and retry.stored_bytes(folder) > 0
    assert send_due(spark, folder, http_post(url), int(time.time()) + 100, 15) == {"delivered": 2}
    server.shutdown()
    assert sorted(got) == sorted(f"{x}{i}" for x in "ab" for i in range(40)) and len(set(keys)) == len(keys) - 2
    size = (logs / "a.log").stat().st_size
    assert sorted((r.start, r.end) for r in saved_offsets(spark, state).collect()) == [(0, size - 1)] * 2


def test_stateful(spark, tmp_path):
    use_rocksdb(spark)
    spark.createDataFrame([(1, f"line{i}", i * 6, i * 6 + 6) for i in range(10)], "file_id bigint, line string, start bigint, end bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_id bigint, line string, start bigint, end bigint").parquet(str(tmp_path / "in"))
    query = exact_batches(stream, 18, 200).writeStream.format("memory").queryName("exact").outputMode("append").option("checkpointLocation", str(tmp_path / "cp1")).start()
    for _ in range(120):  # timers keep the query busy, so it never says that all is processed
        if spark.sql("SELECT * FROM exact").count() == 4:
            break
        time.sleep(0.5)
    query.stop()
    got = [(r.batch_id, len(r.lines)) for r in spark.sql("SELECT * FROM exact ORDER BY batch_id").collect()]
    assert got[:3] == [(0, 3), (1, 3), (2, 3)] and sum(n for _, n in got) in (9, 10)
    spark.sql("SELECT id AS seq, 'k' AS k, timestamp_seconds(CASE id WHEN 2 THEN 0 ELSE id * 10 END) AS ts FROM range(4)").coalesce(1).write.parquet(str(tmp_path / "ev"))
    ev = spark.readStream.schema("seq bigint, k string, ts timestamp").parquet(str(tmp_path / "ev"))
    query = high_water_stream(ev, "k", "seq", "ts").writeStream.format("memory").queryName("high").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    _drain(query)
    assert sorted(r.seq for r in spark.sql("SELECT seq FROM high").collect()) == [0, 1, 3]


def test_deleted_pods_go_once_their_files_are_closed(spark, tmp_path):
    from sluiceway.streaming.stateful import pod_release_stream

    use_rocksdb(spark)
    rows = [("n", "a", 1, "create"), ("n", "a", 2, "open"), ("n", "a", 3, "delete"), ("n", "b", 4, "open"), ("n", "b", 5, "delete"), ("n", "b", 6, "close"), ("n", "c", 7, "delete"), ("n", "c", 8, "create")]
    schema = "namespace string, pod string, seq bigint, kind string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "pods"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "pods"))
    query = pod_release_stream(stream).writeStream.format("memory").queryName("released").outputMode("append").option("checkpointLocation", str(tmp_path / "cp3")).start()
    query.processAllAvailable()
    assert [tuple(r) for r in spark.sql("SELECT * FROM released").collect()] == [("n", "b")]
    spark.createDataFrame([("n", "a", 9, "close")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "pods"))
    _drain(query)
    assert sorted(r.pod for r in spark.sql("SELECT * FROM released").collect()) == ["a", "b"]


def test_lines_without_metadata_are_tried_again(spark, tmp_path):
    from sluiceway.streaming.stateful import line_retries

    use_rocksdb(spark)
    schema = "file_id bigint, start bigint, end bigint, line string, ready boolean"
    write = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    write((1, 0, 5, "late", False), (1, 5, 9, "here", True), (2, 0, 3, "never", False))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "late"))
    query = line_retries(stream, 1, 1000).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp4")).start()

    def wait(outcome, count):
        for _ in range(120):
            if spark.sql("SELECT * FROM late").where(f"outcome = '{outcome}'").count() >= count:
                return
            time.sleep(0.5)

    wait("retry", 2)
    write((1, 0, 5, "late", True), (2, 0, 3, "never", False))
    wait("sent_as_is", 1)
    query.stop()
    got = sorted((r.file_id, r.line, r.tries, r.outcome) for r in spark.sql("SELECT * FROM late").collect())
    assert got == [(1, "here", 0, "sent"), (1, "late", 1, "retry"), (1, "late", 1, "sent"), (2, "never", 1, "retry"), (2, "never", 1, "sent_as_is")]


def test_a_directory_that_is_not_there_holds_nothing(spark, tmp_path):
    assert text.listing(spark, str(tmp_path / "none")).count() == 0


def test_walk_lists_a_tree_with_cycles_once(spark, tmp_path):
    from sluiceway.sources.walk import walk

    root, other = tmp_path / "root", tmp_path / "other"
    for p in ("a/b/c", "a/skip/deep", "z"):
        (root / p).mkdir(parents=True)
    (other / "in").mkdir(parents=True)
    for p in (root / "a/1.log", root / "a/b/2.log", root / "a/b/c/3.tmp", root / "a/skip/4.log", root / "a/skip/deep/5.log", other / "in/6.log"):
        p.write_text(p.name)
    (root / "z/up").symlink_to(root)  # a cycle
    (root / "z/out").symlink_to(other)
    (root / "a/out2").symlink_to(other / "in")  # the same directory by another way, and earlier
    (root / "z/7.log").symlink_to(root / "a/1.log")
    (root / "z/gone").symlink_to(root / "nothing")
    os.link(root / "a/1.log", root / "z/hard.log")

    def plain():
        s = os.stat(root)
        level, seen, out = [str(root)], {(s.st_dev, s.st_ino)}, []
        while level:
            found = [(os.path.join(d, n), os.stat(os.path.join(d, n))) for d in level for n in os.listdir(d) if os.path.exists(os.path.join(d, n))]
            out += [(p, "dir" if os.path.isdir(p) else "file", os.path.realpath(p) if os.path.islink(p) else None, s.st_ino, None if os.path.isdir(p) else s.st_size) for p, s in found]
            ways = {}
            for p, s in sorted(found, key=lambda x: x[0]):
                if os.path.isdir(p) and (s.st_dev, s.st_ino) not in seen:
                    ways.setdefault((s.st_dev, s.st_ino), p)
            seen |= set(ways)
            level = list(ways.values())
        return sorted(out, key=str)

    rows = lambda df: sorted((tuple(r)[:5] for r in df.collect()), key=str)
    assert rows(walk(spark, [str(root)])) == plain()
    files = lambda df: sorted(r.path for r in df.where("kind = 'file'").collect())
    kept = files(walk(spark, [str(root)], PathRules(("*.log",), ("*/skip/*",), (), (r"/z/out(/|$)",))))
    assert kept == [str(root / p) for p in ("a/1.log", "a/b/2.log", "a/out2/6.log", "z/7.log", "z/hard.log")]
    assert walk(spark, [str(tmp_path / "none")]).count() == 0
    uri = {p.removeprefix("file://") for p in files(walk(spark, [f"file://{root}/a/b"]))}
    assert uri == {str(root / "a/b/2.log"), str(root / "a/b/c/3.tmp")}
    skips = PathRules((), ("/x/*", "*.gz", "/y"), (), ("/q/", "/r$", "(?=k)"))
    dirs = ["/x", "/x/a", "/xx", "/y", "/q", "/r", "/k"]
    got = spark.createDataFrame([(p,) for p in dirs], "p string").select(skips.excludes_all(F.col("p")).alias("e")).collect()
    assert [r.e for r in got] == [True, True, False, False, True, False, False]


def test_metrics_of_a_running_query_are_served(spark, tmp_path):
    from urllib.request import urlopen

    from sluiceway.operators.metrics import observed_stream
    from sluiceway.streaming.live import LiveMetrics, serve

    live = LiveMetrics()
    spark.streams.addListener(live)
    server = serve(live, host="127.0.0.1")
    try:
        spark.createDataFrame([("one",), ("three",)], "line string").coalesce(1).write.parquet(str(tmp_path / "in"))
        lines = observed_stream(spark.readStream.schema("line string").parquet(str(tmp_path / "in")), "ingress")
        _drain(lines.writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).start())
        url = f"http://127.0.0.1:{server.server_address[1]}/metrics"
        for _ in range(100):
            with urlopen(url) as r:
                said = dict(line.rsplit(" ", 1) for line in r.read().decode().splitlines())
            if 'ingress_lines_total{query="watched"}' in said and "queries_stopped_total" in said:
                break
            time.sleep(0.1)
        assert said['ingress_lines_total{query="watched"}'] == "2" and said['ingress_bytes_total{query="watched"}'] == "8" and said['rows_total{query="watched"}'] == "2"
        assert int(said['process_bytes{kind="resident"}']) > 1_000_000
    finally:
        spark.streams.removeListener(live)
        server.shutdown()


def test_requests_of_all_tasks_have_one_limit(spark, tmp_path):
    from sluiceway.streaming.sink import admitted, backoff

    lines = spark.range(1000).repartition(16)
    for requests, tasks, own in ((4, 1, 4), (16, 2, 8), (3, 1, 3), (20, 2, 8), (1, 1, 1)):
        dealt, options = admitted(lines, requests)
        assert (dealt.rdd.getNumPartitions(), options) == (tasks, {"concurrent": str(own)}) and tasks * own <= requests
    assert [backoff(n) for n in (0, 1, 2, 5, 40)] == [0.0, 0.02, 0.04, 0.32, 10.0]


def _until(name, spark, count):
    for _ in range(200):
        rows = spark.sql(f"SELECT * FROM {name}").collect()
        if len(rows) >= count:
            return rows
        time.sleep(0.2)
    return rows


def test_events_are_debounced_and_delayed(spark, tmp_path):
    """Runs of writes are one, resumed writes stand in front, an event with a longer delay holds those behind it, errors pass at once."""
    from sluiceway.streaming.watch import debounced_stream, merged_events

    use_rocksdb(spark)
    schema = "path string, seq bigint, kind string, ts timestamp"
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", 1, "create", at(5)), ("a", 2, "write", at(6)), ("a", 3, "write", at(4)), ("a", 4, "remove", at(7)), ("b", 5, "write", at(8)), ("c", 6, "error", at(9))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "watch"))
    spark.createDataFrame([("a", 10, "write", at(1), True, None), ("b", 11, "write", at(2), True, None), ("d", 12, "write", at(3), False, 1200)], schema + ", front boolean, delay_ms bigint").coalesce(1).write.parquet(str(tmp_path / "resumed"))
    watch = spark.readStream.schema(schema).parquet(str(tmp_path / "watch"))
    resumed = spark.readStream.schema(schema + ", front boolean, delay_ms bigint").parquet(str(tmp_path / "resumed"))
    query = debounced_stream(merged_events(watch, resumed), 300).writeStream.format("memory").queryName("calm").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    got = _until("calm", spark, 7)
    query.stop()
    by = {p: [(r.kind, r.seq, r.ts.second, r.n) for r in got if r.path == p] for p in "abcd"}
    assert by == {"a": [("write", 10, 1, 1), ("create", 1, 5, 1), ("write", 2, 4, 2), ("remove", 4, 7, 1)], "b": [("write", 5, 2, 2)], "c": [("error", 6, 9, 1)], "d": [("write", 12, 3, 1)]}


def test_lines_meet_what_a_watch_says_of_their_pods(spark, tmp_path):
    from sluiceway.streaming.watch import with_watched_pods

    use_rocksdb(spark)
    said, written = "namespace string, pod string, version bigint, kind string, meta string", "namespace string, pod string, seq bigint, line string"
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    write([("n", "a", 2, "apply", "a2"), ("n", "a", 1, "apply", "a1"), ("n", "gone", 1, "apply", "g"), ("n", "gone", 2, "delete", None)], said, "watch")
    write([("n", "a", 1, "one"), ("n", "late", 2, "two"), ("n", "never", 3, "three"), ("n", "gone", 4, "four")], written, "lines")
    streams = [spark.readStream.schema(s).parquet(str(tmp_path / n)) for s, n in ((written, "lines"), (said, "watch"))]
    query = with_watched_pods(*streams, patience_ms=15_000).writeStream.format("memory").queryName("met").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    assert {(r.line, r.meta) for r in _until("met", spark, 2)} == {("one", "a2"), ("four", "g")}
    write([("n", "late", 1, "apply", "l")], said, "watch")
    write([("n", "a", 5, "five")], written, "lines")
    rows = _until("met", spark, 5)
    query.stop()
    assert sorted((r.seq, r.line, r.meta) for r in rows) == [(1, "one", "a2"), (2, "two", "l"), (3, "three", None), (4, "four", "g"), (5, "five", "a2")]


def test_journal_files_are_read_in_ranges(spark, tmp_path):
    """Binary values full of empty lines and of what looks like records, values longer than ranges, spoilt records, ends without an empty line."""
    import random

    rng = random.Random(8)

    def export(n):
        out = b""
        for i in range(n):
            out += b"MESSAGE=line %d\n" % i if i % 7 else b""
            if i % 3 == 0:
                value = rng.choice([b"\n\nMESSAGE=fake\n\n" * 4, bytes(rng.choices(b"\n\nA=x", k=rng.choice((5, 400)))), b"\n" * 30])
                out += b"BLOB\n" + struct.pack("<Q", len(value)) + value + b"\n"
            out += b"not a field\n" if i % 11 == 5 else b""
            out += b"_SYSTEMD_UNIT=u%d\n" % (i % 4) + b"\n" * rng.choice((1, 1, 2))
        return out

    (tmp_path / "x").mkdir()
    data = {"a": export(60), "b": export(25).rstrip(b"\n"), "c": b"", "d": b"MESSAGE=one"}
    for name, content in data.items():
        (tmp_path / "x" / name).write_bytes(content)
    want = sorted(r["MESSAGE"].decode("utf-8", "replace") for content in data.values() for r in journal.records(content) if "MESSAGE" in r)
    assert len(want) > 60 and "fake" not in want
    for size in (37, 200, 1 << 20):
        assert sorted(r.line for r in journal.read_journal(spark, str(tmp_path / "x"), size).collect()) == want, size


def test_changes_of_a_tree_between_listings(spark, tmp_path):
    """Directories that move with all that is in them, one into another that moves, hard links, and files that change, by their real inodes."""
    from sluiceway.sources.walk import changes

    t, state = tmp_path / "t", str(tmp_path / "state")
    for p in ("a/deep", "b", "c"):
        (t / p).mkdir(parents=True)
    for p in ("a/1", "a/deep/2", "b/3", "c/4", "c/5", "6"):
        (t / p).write_text("x")
    events = lambda: sorted((r.path.removeprefix(f"{t}/"), r.kind, (r.to_path or "").removeprefix(f"{t}/")) for r in changes(spark, [str(t)], state).collect())
    assert events() == sorted((p, "create", "") for p in ("a", "a/deep", "b", "c", "a/1", "a/deep/2", "b/3", "c/4", "c/5", "6"))
    assert events() == []
    (t / "a").rename(t / "moved")
    (t / "b").rename(t / "moved/b")  # into a directory that moved
    (t / "moved/deep/2").rename(t / "moved/deep/two")
    os.link(t / "c/4", t / "c/link")
    (t / "c/5").write_text("longer")
    (t / "6").unlink()
    (t / "new").write_text("x")
    (t / "c/symbolic").symlink_to(t / "c/5")
    got = events()
    new = ("new", "create", "")
    want = [("a", "rename", "moved"), ("b", "rename", "moved/b"), ("a/deep/2", "rename", "moved/deep/two"), ("c/link", "link", ""), ("c/5", "write", "")]
    # the inode of the deleted file may be given to the new one at once, which then is its rename
    assert got in (sorted([*want, ("6", "remove", ""), new]), sorted([*want, ("6", "rename", "new")]))
    (t / "c/4").unlink()
    assert events() == [("c/4", "remove", "")]


def test_trees_are_read_in_ranges(spark, tmp_path):
    from sluiceway.sources.walk import read_tree

    (tmp_path / "t/x").mkdir(parents=True)
    texts = {"a.log": b"one\ntwo\r\n\nthree", "x/b.log": b"\xff\n" + b"long " * 40 + b"\nend\n", "c.log": b"", "d.txt": b"no\n", "e.log": b"\n\n\n"}
    for name, content in texts.items():
        (tmp_path / "t" / name).write_bytes(content)
    want, places = [], []
    for name, content in texts.items():
        at = 0
        for line in content.splitlines(keepends=True) if name != "a.log" else [b"one\n", b"two\r\n", b"\n", b"three"]:
            if name.endswith(".log"):
                want.append((line.removesuffix(b"\n").decode("utf-8", "replace"), name.rpartition("/")[2]))
                places.append((at, at + len(line)))
            at += len(line)
    for size in (1, 7, 64, 1 << 20):
        rows = read_tree(spark, [str(tmp_path / "t")], PathRules(("*.log",), ()), size).collect()
        assert sorted((r.line, r.file.rpartition("/")[2]) for r in rows) == sorted(want)
        assert sorted((r.start, r.end) for r in rows) == sorted(places)


def test_chain_skips_missing_stages(spark):
    assert chain(spark.range(3), None, lambda d: d.where("id > 0")).count() == 2
