import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lodewright.sources import files
from lodewright.storage import materialize
from lodewright.streaming import broker, events, geofence, live


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_queue_rules():
    q = broker.Queue()
    assert [q.publish("a", 0), q.publish("b", 0, "key"), q.publish("b2", 0, "key"), q.publish("late", 0, delay=50)] == [0, 1, 1, 2]
    assert [m["seq"] for m in q.consume("w1", 1, 5, visibility=10)] == [0, 1] and q.consume("w2", 1, 5) == []
    with pytest.raises(ValueError):
        q.ack("w2", [0], 2)
    with pytest.raises(ValueError):
        q.ack("w1", [0, 99], 2)
    q.ack("w1", [0], 2)
    assert [(m["seq"], m["attempts"]) for m in q.consume("w2", 12, 5)] == [(1, 2)]
    q.nack("w2", 1, 13)
    q.consume("w2", 14, 1)
    assert q.stats() == {"ready": 1, "in_flight": 1, "settled": 1, "dead": 0, "next_seq": 3}


def test_dead_letters_and_retention():
    q = broker.Queue()
    q.publish("x", 0, max_attempts=2)
    for now in (1, 20, 40):
        q.consume("w", now, visibility=10)
    assert len(q.dead) == 1 and q.redrive(50) == [0] and q.redrive(50) == [] and q.consume("w", 51)[0]["attempts"] == 1
    for i in range(5):
        q.publish(str(i), 60 + i)
    assert [len(q.trim(most=3)), len(q.trim(oldest=63)), len(q.purge())] == [2, 1, 2]


class Plain(broker.Queue):
    """The rules as sorts of one list."""

    def at_hand(self):
        return sorted(self.held, key=lambda m: (m["attempts"] == 0, m["seq"]))

    def run(self, kind, now, seq, worker, batch):
        late = [m for m in self.out if m["until"] <= now] if kind in ("consume", "ack") else []
        self.out = [m for m in self.out if m not in late]
        self.held += late
        if kind == "publish":
            self.held.append({"seq": self.next_seq, "at": now + seq % 3, "attempts": 0})
            self.next_seq += 1
            return [self.next_seq - 1]
        if kind == "consume":
            given = []
            for m in self.at_hand():
                if len(given) == batch or m["at"] > now:
                    break
                self.held.remove(m)
                if m["attempts"] >= broker.MAX_ATTEMPTS:
                    self.dead.append(m)
                else:
                    given.append({**m, "attempts": m["attempts"] + 1, "until": now + 4, "worker": worker})
            self.out += given
            return [m["seq"] for m in given]
        if kind == "trim":
            gone = sorted(self.held, key=lambda m: m["seq"])[: max(0, len(self.held) - batch * 9)]
            self.held = [m for m in self.held if m not in gone]
            return [m["seq"] for m in gone]
        if kind == "redrive":
            back, self.dead = self.dead, []
            self.held += [{**m, "attempts": 0, "at": now} for m in back]
            return [m["seq"] for m in back]
        own = [m for m in self.out if m["seq"] == seq and m["worker"] == worker]
        self.out = [m for m in self.out if m not in own]
        self.held += [{**m, "at": now + 2} for m in own] if kind == "nack" else []
        return [m["seq"] for m in own]


def test_queue_is_held_against_sorted_lists():
    draw = random.Random(5)
    q, plain = broker.Queue(), Plain()
    plain.held, plain.out = [], []
    for now in range(4_000):
        kind = draw.choice(["publish"] * 4 + ["consume"] * 6 + ["ack", "nack"] + ["trim", "redrive"] * (now % 97 == 0))
        seq, worker, batch = max(0, q.next_seq - draw.randrange(30)), draw.choice("vw"), draw.randrange(1, 4)
        op = {"op": kind, "now": now, "worker": worker, "seq": seq, "payload": "", "delay": {"publish": seq % 3, "consume": 4, "nack": 2}.get(kind), "batch": batch * 9 if kind == "trim" else batch}
        got = [e["seq"] for e in q.apply(op) if e["event"] not in ("refused", "dead")]
        assert got == plain.run(kind, now, seq, worker, batch)
        assert [m["seq"] for m in q.ready] == [m["seq"] for m in plain.at_hand()] and len(q.dead) == len(plain.dead)
        q = broker.Queue.of(json.loads(json.dumps(q.state())))


def test_an_operation_costs_what_it_moves():
    q = broker.Queue()
    begun = time.monotonic()
    for i in range(60_000):
        q.publish("x", i)
    for i in range(60_000):
        q.consume("w", 60_000 + i, visibility=5)
        q.expire(60_000 + i)
    assert time.monotonic() - begun < 20 and q.next_seq == 60_000


def log(spark):
    ops = [("q", "g", 0, "publish", 0, None, None, "a"), ("q", "g", 1, "publish", 1, None, None, "b"), ("q", "g", 2, "consume", 2, "w", None, None), ("q", "g", 3, "ack", 3, "w", 0, None), ("q", "g", 4, "ack", 4, "v", 1, None), ("p", "g", 0, "publish", 0, None, None, "z")]
    return spark.createDataFrame([(*o, None, None, 2) for o in ops], "queue string, consumer string, offset long, op string, now long, worker string, seq long, payload string, key string, delay long, batch long")


def test_broker_replay_and_stream(spark, tmp_path):
    want = [("p", "published", 0), ("q", "acked", 0), ("q", "delivered", 0), ("q", "delivered", 1), ("q", "published", 0), ("q", "published", 1), ("q", "refused", 1)]
    assert rows(broker.replay(log(spark)).select("queue", "event", "seq"), "queue", "event", "seq") == want
    path = str(tmp_path / "log")
    for part in ("offset < 2", "offset >= 2"):
        log(spark).filter(part).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(log(spark).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = events.run_to_end(broker.stream(source), "broker_out", "append", str(tmp_path / "cp"))
    assert rows(out.select("queue", "event", "seq"), "queue", "event", "seq") == want
    assert rows(broker.group_info(broker.replay(log(spark))).select("queue", "published", "acked", "lag"), "queue") == [("p", 1, 0, 1), ("q", 2, 1, 1)]


def test_points_of_one_second_follow_their_sequence(spark):
    """Several assets, each outside, inside and outside again within one second, in shuffled rows."""
    points = [(f"a{i}", 5, n, x, 0.0) for i in range(40) for n, x in enumerate((9.0, 1.0, 2.0, -3.0, 4.0))]
    random.Random(1).shuffle(points)
    df = spark.createDataFrame(points, "asset string, at long, seq long, x double, y double").repartition(4)
    fences = spark.createDataFrame([("campus", 0.0, -5.0, 5.0, 5.0)], "fence string, x0 double, y0 double, x1 double, y1 double")
    want = sorted((f"a{i}", 5, event, 0) for i in range(40) for event in ("enter", "dwell", "exit", "enter"))
    assert rows(geofence.transitions(df, fences).select("asset", "at", "event", "seconds"), "asset", "at", "event") == want


def test_geofences_in_batch_and_stream(spark, tmp_path):
    points = spark.createDataFrame([("m", 0, -1.0, 0.0), ("m", 10, 1.0, 0.0), ("m", 25, 2.0, 0.0), ("m", 40, 9.0, 0.0)], "asset string, at long, x double, y double")
    want = [("m", "campus", 10, "enter", 0), ("m", "campus", 25, "dwell", 15), ("m", "campus", 40, "exit", 30)]
    fences = spark.createDataFrame([("campus", 0.0, -5.0, 5.0, 5.0)], "fence string, x0 double, y0 double, x1 double, y1 double")
    assert rows(geofence.transitions(points, fences), "at") == want
    path = str(tmp_path / "points")
    for part in ("at < 20", "at >= 20"):
        points.filter(part).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = events.run_to_end(geofence.stream(source, [("campus", 0.0, -5.0, 5.0, 5.0)]), "fence_out", "append", str(tmp_path / "cp"))
    assert rows(out, "at") == want


def test_live_query_changelog(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    for n in (1, 2):
        spark.createDataFrame([("a", n), ("b", 1)] if n == 1 else [("a", n)], "k string, v long").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(path)
    query = live.subscribe(source, lambda rows: rows.groupBy("k").agg(F.sum("v").alias("v")), str(tmp_path / "state"), str(tmp_path / "cp"), lambda changed: seen.append(sorted(map(tuple, changed.collect()))))
    query.awaitTermination()
    assert sum(len(s) for s in seen) == 4 and [c[1:] for s in seen for c in s if c[1] == "-"][0][0] == "-"
    assert live.notifications(live.changes(None, spark.createDataFrame([(1,)], "x int"), 3)).first()["payload"] == '{"commit_seq":3,"change":"+","x":1}'


def test_hot_view(spark):
    version, runs = [1], []
    view = live.HotView(lambda: runs.append(1) or spark.range(version[0]), lambda: tuple(version))
    assert view.read().count() == 1 and view.read().count() == 1 and len(runs) == 1
    version[0] = 2
    assert view.read().count() == 2 and len(runs) == 2


def test_live_cube(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in ([("a", 5.0, 1), ("a", 7.0, 1), ("b", 1.0, 1)], [("a", 5.0, -1), ("b", 1.0, -1)]):
        spark.createDataFrame(part, "k string, v double, sign int").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema("k string, v double, sign int").parquet(path)
    events.maintain_cube(source, ["k"], "v", "sign", str(tmp_path / "cube"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "cube" / "batch=0")).filter("count > 0")) == [("a", 1, 7.0)]


def test_late_rows_miss_a_closed_window(spark, tmp_path):
    path = str(tmp_path / "in")
    for stamps in (["2024-01-01 00:01:00", "2024-01-01 01:00:00"], ["2024-01-01 00:02:00"], ["2024-01-01 03:00:00"]):
        spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema("ts timestamp_ntz").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    counted = events.windowed(source, "ts", "10 minutes", None, [], "5 minutes", n=F.count("*"))
    out = events.run_to_end(counted, "late_out", "append", str(tmp_path / "cp"))
    assert sum(r[0] for r in out.select("n").collect()) <= 3


def test_files(spark, sf, tmp_path):
    t = spark.createDataFrame([(1, 'a "q", b'), (2, None), (3, "")], "id int, x string")
    files.copy_to(t, str(tmp_path / "csv"))
    assert rows(files.copy_from(spark, str(tmp_path / "csv"), "id int, x string"), "id")[:2] == [(1, 'a "q", b'), (2, None)]
    files.export_json(t, str(tmp_path / "json"), "id", after=1)
    assert [r["id"] for r in spark.read.json(str(tmp_path / "json")).orderBy("id").collect()] == [2, 3]
    assert [p.count() for p in files.pages(spark.range(7), "id", 3)] == [3, 3, 1]
    mark = files.write_sidecar(t, str(tmp_path / "side"), ["id"])
    assert files.verify_sidecar(spark, str(tmp_path / "side"), ["id"], mark) and not files.verify_sidecar(spark, str(tmp_path / "side"), ["id"], "no")
    assert set(files.load(spark, sf)) == set(files.TABLES) and materialize(t).count() == 3


def test_intermediates_can_be_dropped(spark):
    from lodewright import drop_intermediates, shared_dir

    kept = materialize(spark.range(3))
    assert kept.count() == 3 and shared_dir(spark)
    drop_intermediates(spark)
    with pytest.raises(Exception):
        kept.count()
