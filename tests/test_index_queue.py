"""The queue's state machine, and the streams that keep it across micro-batches and a restart."""

import random

from pyspark.sql import functions as F

from vellumspark.streaming import index_queue as iq

KINDS = ["request", "request", "request", "started", "finished", "failed", "cancel"]


def run(events, wait=600_000):
    state, out = iq.NEW, []
    for kind, mode, rerun in events:
        state, made = iq.step(state, kind, mode, rerun, 0, wait)
        out.append(made)
    return state, out


def test_one_job_a_key():
    state, out = run([("request", "deferred", False), ("request", "deferred", True), ("request", "full", False), ("request", "full", False)])
    assert out == [[("queue", "deferred", "request")], [], [("upgrade", "full", "request")], []] and state[:2] == ("queued", "full")


def test_reruns_follow_an_active_job():
    begin = [("request", "deferred", False), ("started", None, False)]
    assert run([*begin, ("request", "deferred", False), ("finished", None, False)])[1][-1] == []
    assert run([*begin, ("request", "deferred", True), ("finished", None, False)])[1][-1] == [("queue", "deferred", "rerun")]
    assert run([*begin, ("request", "full", False), ("failed", None, False)])[1][-1] == [("queue", "full", "rerun")]
    assert run([*begin, ("request", "full", False), ("finished", None, False), ("started", None, False), ("finished", None, False)])[0] == ("idle", "full", False, False, 0)
    assert run([("started", None, False), ("finished", None, False)])[0] == iq.NEW
    assert run([("request", "full", False), ("cancel", None, False), ("request", "full", False)])[1] == [[("queue", "full", "request")], [("drop", "full", "cancel")], [("queue", "full", "request")]]


def test_deferred_jobs_come_back():
    state, _ = run([("request", "deferred", False), ("started", None, False), ("finished", None, False)], wait=5)
    assert state == ("idle", "deferred", False, False, 5) and iq.due(state, 4) == (state, [])
    assert iq.due(state, 5) == (("queued", "full", False, False, 0), [("queue", "full", "deferred")])


def stream(spark, folder, schema, sink, make, checkpoint):
    made = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    q = made.writeStream.outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{sink}/batch={n}")).start()
    q.awaitTermination()


def test_queue_stream_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randrange(3), rng.choice(KINDS), rng.choice(["full", "deferred", "deferred"]), rng.random() < 0.3, 1_000_000 + 60 * i, i) for i in range(400)]
    schema = "db string, document_id int, kind string, mode string, rerun boolean, s long, seq long"

    def put(n, part):
        rng.shuffle(part)
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return df.schema

    make = lambda s: iq.queue_actions(s, ["db", "document_id"], wait="1 minutes", delay="0 minutes")
    for n in range(2):
        kind = put(n, rows[n * 100 : n * 100 + 100])
        stream(spark, tmp_path / "in", kind, tmp_path / "out", make, tmp_path / "mark")
    for n in range(2, 4):  # after a restart
        put(n, rows[n * 100 : n * 100 + 100])
    stream(spark, tmp_path / "in", kind, tmp_path / "out", make, tmp_path / "mark")
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("db", "document_id", "action", "mode", "reason", "seq").collect()]

    # by hand, one event after another; a timer fires in the first micro-batch that sees the watermark past it
    want, states = [], {}
    for n in range(4):
        part = sorted(rows[n * 100 : n * 100 + 100], key=lambda r: r[-1])
        keys = {r[:2] for r in part}
        for db, doc, kind_, mode, rerun, s, seq in part:
            states[db, doc], made = iq.step(states.get((db, doc), iq.NEW), kind_, mode, rerun, s * 1000, 60_000)
            want += [(db, doc, *a, seq) for a in made]
        mark = (1_000_000 + 60 * (n * 100 + 99)) * 1000  # that of the batch without data that follows
        for k in states:
            states[k], made = iq.due(states[k], mark)
            want += [(*k, *a, None) for a in made]
        assert keys
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_deferred_timer_in_a_stream(spark, tmp_path):
    schema = "k int, kind string, mode string, rerun boolean, ts timestamp, seq long"
    batches = [[(1, "request", "deferred", 0), (1, "started", None, 1), (1, "finished", None, 2)], [(2, "request", "full", 3000)], [(2, "started", None, 3001)], [(2, "finished", None, 6000)]]
    seq = 0
    for b in batches:
        rows = []
        for k, kind, mode, s in b:
            rows.append((k, kind, mode, False, s, seq))
            seq += 1
        df = spark.createDataFrame(rows, "k int, kind string, mode string, rerun boolean, s long, seq long").select("k", "kind", "mode", "rerun", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"), "seq")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream(spark, tmp_path / "in", schema, tmp_path / "out", lambda s: iq.queue_actions(s, ["k"], delay="1 minutes"), tmp_path / "mark")
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "action", "mode", "reason", "seq").collect()), key=repr)
    assert got == [(1, "queue", "deferred", "request", 0), (1, "queue", "full", "deferred", None), (2, "queue", "full", "request", 3)]


def test_watch_tells_once(spark, tmp_path):
    polls = [(1, 0, 3, 0), (1, 2, 0, 0), (1, 1, 1, 0), (1, 0, 2, 0), (1, 0, 2, 0), (2, 0, 0, 1), (2, 1, 0, 0), (2, 0, 0, 1), (1, 4, 2, 0)]
    rows = [(*p, i) for i, p in enumerate(polls)]
    for part in (rows[:4], rows[4:7], rows[7:]):
        df = spark.createDataFrame(part, "k int, pending int, ready int, error int, seq long")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream(spark, tmp_path / "in", df.schema, tmp_path / "out", lambda s: iq.watch(s, ["k"]), tmp_path / "mark")
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("seq", "k", "state").collect())
    assert got == [(1, 1, "waiting"), (3, 1, "complete"), (6, 2, "waiting"), (7, 2, "error"), (8, 1, "waiting")]


def test_queue_query_is_the_machine_event_by_event(spark):
    from vellumspark.plans import entries

    sf = "/root/testdata/sf0.001"
    want, states = [], {}
    for r in sorted(entries._queue_events(spark, sf).collect(), key=lambda r: r.seq):
        states[r.user_id], made = iq.step(states.get(r.user_id, iq.NEW), r.kind, r.mode, r.rerun, 0, 0)
        want += [(r.user_id, *a, r.seq) for a in made]
    got = [tuple(r) for r in entries.QUERIES["index_queue_actions"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len({r[1:4] for r in want}) > 3


def test_rows_of_a_key_are_taken_in_order_without_a_frame_of_them_all(monkeypatch):
    import pandas as pd

    frames = [pd.DataFrame({"kind": ["b", "d"], "mode": ["full", None], "seq": [2, 4]}), pd.DataFrame({"kind": ["a", "c"], "mode": [None, "x"], "seq": [1, 3]})]
    monkeypatch.setattr(pd, "concat", None)
    assert [tuple(r) for r in iq.in_order(iter(frames), "kind", "mode", "seq")] == [("a", None, 1), ("b", "full", 2), ("c", "x", 3), ("d", None, 4)]
