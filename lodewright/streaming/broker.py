"""A durable queue as a fold over its log: publish, consume, ack, nack, redelivery, dead letters, retention.

Time comes with the operations, so a replay gives the same result every time. The same
state machine runs over a static log (``replay``) and inside a stream (``stream``).
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ATTEMPTS = 16


def _told(m: tuple) -> dict:
    return dict(zip(("seq", "payload", "at", "attempts", "max"), m, strict=True))


def _kept(m: dict) -> tuple:
    return m["seq"], m["payload"], m["at"], m["attempts"], m["max"]


@dataclass
class Queue:
    """One queue as one consumer group sees it. Sequences start at 0 and are never used again.

    Ready messages are (seq, payload, at, attempts, max) in two heaps by sequence: those
    delivered before and fresh ones. ``ends`` is a heap of (until, seq), in which entries of
    messages that are not in flight until then are passed over. So an operation costs the
    messages it moves, not those that wait.
    """

    next_seq: int = 0
    again: list = field(default_factory=list)
    fresh: list = field(default_factory=list)
    flying: dict = field(default_factory=dict)
    ends: list = field(default_factory=list)
    settled: int = 0
    dead: list = field(default_factory=list)
    keys: dict = field(default_factory=dict)

    @property
    def ready(self) -> list[dict]:
        """Messages in the order of delivery."""
        return [_told(m) for m in (*sorted(self.again), *sorted(self.fresh))]

    def state(self) -> dict:
        """What JSON can hold."""
        return {"next_seq": self.next_seq, "ready": self.ready, "flying": self.flying, "settled": self.settled, "dead": self.dead, "keys": self.keys}

    @classmethod
    def of(cls, state: dict) -> Queue:
        queue = cls(**{k: v for k, v in state.items() if k != "ready"})
        for m in state["ready"]:
            queue._back(m)
        queue.ends = sorted((m["until"], m["seq"]) for m in queue.flying.values())
        return queue

    def _back(self, m: dict) -> None:
        heapq.heappush(self.again if m["attempts"] else self.fresh, _kept(m))

    def publish(self, payload: str, now: int, key: str | None = None, delay: int = 0, max_attempts: int = MAX_ATTEMPTS) -> int:
        """The sequence; an idempotency key that was seen gives its first one."""
        if key is not None and key in self.keys:
            return self.keys[key]
        seq = self.next_seq
        self.next_seq += 1
        heapq.heappush(self.fresh, (seq, payload, now + delay, 0, max_attempts))
        if key is not None:
            self.keys[key] = seq
        return seq

    def expire(self, now: int) -> None:
        """Messages whose visibility ran out go back, before fresh ones and in sequence."""
        while self.ends and self.ends[0][0] <= now:
            until, seq = heapq.heappop(self.ends)
            if self.flying.get(str(seq), {}).get("until") == until:
                self._back(self.flying.pop(str(seq)))

    def consume(self, worker: str, now: int, batch: int = 1, visibility: int = 30) -> list[dict]:
        """Up to ``batch`` messages; a delayed head holds fresh ones back, and one delivered too often is dead."""
        self.expire(now)
        out = []
        while (heap := self.again or self.fresh) and len(out) < batch:
            if heap[0][2] > now:
                break
            m = _told(heapq.heappop(heap))
            if m["attempts"] >= m["max"]:
                self.dead.append(m)
                continue
            m = {**m, "attempts": m["attempts"] + 1, "worker": worker, "until": now + visibility}
            self.flying[str(m["seq"])] = m
            heapq.heappush(self.ends, (m["until"], m["seq"]))
            out.append(m)
        return out

    def ack(self, worker: str, seqs: list[int], now: int) -> None:
        """All or none; only the owner may."""
        self.expire(now)
        for s in seqs:
            if self.flying.get(str(s), {}).get("worker") != worker:
                raise ValueError(f"message {s} is not held by {worker}")
        for s in seqs:
            del self.flying[str(s)]
            self.settled += 1

    def nack(self, worker: str, seq: int, now: int, delay: int = 0) -> None:
        if self.flying.get(str(seq), {}).get("worker") != worker:
            raise ValueError(f"message {seq} is not held by {worker}")
        m = self.flying.pop(str(seq))
        m["at"] = now + delay
        self._back(m)

    def redrive(self, now: int) -> list[int]:
        """Dead letters start anew, each once: their sequences."""
        found = [m["seq"] for m in self.dead]
        for m in self.dead:
            self._back({**m, "attempts": 0, "at": now})
        self.dead = []
        return found

    def purge(self) -> list[int]:
        """Drop what is ready: the sequences."""
        found = [m[0] for m in (*sorted(self.again), *sorted(self.fresh))]
        self.again, self.fresh = [], []
        return found

    def trim(self, most: int | None = None, oldest: int | None = None) -> list[int]:
        """Drop ready messages beyond a number or older than a time; what is in flight stays. The sequences dropped."""
        gone = []
        if oldest is not None:
            gone = [m[0] for m in (*self.again, *self.fresh) if m[2] < oldest]
            self.again, self.fresh = (sorted(m for m in heap if m[2] >= oldest) for heap in (self.again, self.fresh))
        while most is not None and len(self.again) + len(self.fresh) > most:
            gone.append(heapq.heappop(min((heap for heap in (self.again, self.fresh) if heap), key=lambda heap: heap[0][0]))[0])
        return sorted(gone)

    def stats(self) -> dict:
        return {"ready": len(self.again) + len(self.fresh), "in_flight": len(self.flying), "settled": self.settled, "dead": len(self.dead), "next_seq": self.next_seq}

    def apply(self, op: dict) -> list[dict]:
        """One row of the log: op, now, worker, seq, payload, key, delay, batch. redrive, purge and trim (to ``batch`` messages) name what they move."""
        kind, now = op["op"], int(op["now"])
        given = lambda k, default: default if op.get(k) is None or op[k] != op[k] else op[k]
        if kind == "publish":
            return [{"event": "published", "seq": self.publish(op["payload"], now, op.get("key"), int(given("delay", 0)))}]
        if kind == "consume":
            dead = len(self.dead)
            out = [{"event": "delivered", "seq": m["seq"], "worker": op["worker"], "attempts": m["attempts"], "payload": m["payload"]} for m in self.consume(op["worker"], now, int(given("batch", 1)), int(given("delay", 30)))]
            return out + [{"event": "dead", "seq": m["seq"]} for m in self.dead[dead:]]
        swept = {"redrive": ("redriven", lambda: self.redrive(now)), "purge": ("purged", self.purge), "trim": ("trimmed", lambda: self.trim(int(given("batch", 0))))}
        if kind in swept:
            event, run = swept[kind]
            return [{"event": event, "seq": seq} for seq in run()]
        try:
            if kind == "ack":
                self.ack(op["worker"], [int(op["seq"])], now)
            elif kind == "nack":
                self.nack(op["worker"], int(op["seq"]), now, int(given("delay", 0)))
            else:
                raise ValueError(f"no operation {kind}")
        except ValueError:
            return [{"event": "refused", "seq": int(op["seq"]), "worker": op["worker"]}]
        return [{"event": "acked" if kind == "ack" else "nacked", "seq": int(op["seq"]), "worker": op["worker"]}]


RESULT = "queue string, consumer string, at long, event string, seq long, worker string, attempts int, payload string"
COLUMNS = ["queue", "consumer", "at", "event", "seq", "worker", "attempts", "payload"]


def _rows(state: Queue, ops: pd.DataFrame, key: tuple) -> pd.DataFrame:
    out = [{"queue": key[0], "consumer": key[1], "at": op["now"], **e} for op in ops.to_dict("records") for e in state.apply(op)]
    found = pd.DataFrame(out, columns=COLUMNS, dtype=object)
    return found.where(found.notna(), None)


def replay(log: DataFrame) -> DataFrame:
    """Everything that happened in each (queue, consumer), from a log with columns queue, consumer, offset, op, now, worker, seq, payload, key, delay, batch.

    Sorted operations come to a worker batch by batch; it holds the state of one queue.
    """

    def run(frames):
        key, queue = None, Queue()
        for frame in frames:
            changed = (frame[["queue", "consumer"]].fillna("\0") != frame[["queue", "consumer"]].fillna("\0").shift()).any(axis=1)
            for _, ops in frame.groupby(changed.cumsum(), sort=False):
                first = (ops["queue"].iloc[0], ops["consumer"].iloc[0])
                if first != key:
                    key, queue = first, Queue()
                yield _rows(queue, ops, key)

    dealt = log.repartition("queue", "consumer").sortWithinPartitions("queue", "consumer", "offset")
    return dealt.mapInPandas(run, RESULT)


def stream(log: DataFrame) -> DataFrame:
    """The same over a stream: the state of each (queue, consumer) is kept between batches."""

    def fold(key, batches, state):
        queue = Queue.of(json.loads(state.get[0])) if state.exists else Queue()
        ops = pd.concat(list(batches)).sort_values("offset")
        out = _rows(queue, ops, key)
        state.update((json.dumps(queue.state()),))
        yield out

    return log.groupBy("queue", "consumer").applyInPandasWithState(fold, RESULT, "state string", "append", "NoTimeout")


def group_info(results: DataFrame) -> DataFrame:
    """queue, consumer, published, delivered, redelivered, acked, dead, lag from replayed results: plain aggregation."""
    n = lambda e: F.count(F.when(F.col("event") == e, 1))
    counted = results.groupBy("queue", "consumer").agg(n("published").alias("published"), n("delivered").alias("delivered"), F.count(F.when(F.col("attempts") > 1, 1)).alias("redelivered"), n("acked").alias("acked"), n("dead").alias("dead"))
    return counted.withColumn("lag", F.col("published") - F.col("acked") - F.col("dead"))
