"""A sliding-log rate limiter over one or more identities of each request (say, user and address).

A request is accepted if none of its identities has ``limit`` accepted requests within the last ``seconds``, and only
then counts, for all of them. So one identity's log depends on the others': rejected requests don't count, which is
state and no window. Requests are taken in order of time and id.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import components

LIMIT, SECONDS = 30, 60


@dataclass(frozen=True)
class Limits:
    """What is limited: the columns of the request's id, time and identities (null ones aren't checked), and how
    many requests an identity may have accepted within how many seconds. ``part``: a column that requests which
    share an identity also share (an organisation, say); identities of two parts have nothing to do with each other."""

    limit: int = LIMIT
    seconds: int = SECONDS
    keys: tuple[str, ...] = ("user_id",)
    part: str | None = None
    event_id: str = "event_id"
    ts: str = "ts"

    @property
    def micros(self) -> int:
        return self.seconds * 1_000_000


class Logs:
    """The accepted times of each identity, at most ``limit`` within the window."""

    def __init__(self, limit: int, micros: int, kept: dict | None = None):
        self.limit, self.micros, self.kept = limit, micros, kept or {}

    def accept(self, identities: list, now: int, sure: bool = False) -> bool:
        logs = []
        for i in identities:
            log = self.kept.setdefault(i, deque())
            while log and log[0] < now - self.micros:
                log.popleft()
            logs.append(log)
        if not sure and any(len(log) >= self.limit for log in logs):
            return False
        for log in logs:
            log.append(now)
        return True

    def forget(self, now: int) -> None:
        """Drop what no request from ``now`` on can need."""
        self.kept = {i: own for i, log in self.kept.items() if (own := deque(t for t in log if t >= now - self.micros))}


def _limits(limit, seconds, key, part) -> Limits:
    return Limits(limit, seconds, (key,) if isinstance(key, str) else tuple(key), part)


def limited(requests: DataFrame, limit: int = LIMIT, seconds: int = SECONDS, key: str | tuple[str, ...] = "user_id", part: str | None = None, rules: Limits | None = None) -> DataFrame:
    """requests(event_id, keys, ts) with accepted.

    A request all of whose identities have fewer than ``limit`` requests before it in the window, accepted or not, is
    accepted without more ado. An identity's requests fall into sessions with gaps beyond the window; only sessions
    with a request that this doesn't decide are busy. Undecided requests link their identities' busy
    sessions, and each connected part of these is passed through once, in order, from a sorted partition: no part is
    gathered, and its state is a log of at most ``limit`` times for each identity in it. A part is as long as its
    identities stay busy without a pause, which is the least that an order of decisions allows.

    Null keys aren't checked; a request with null keys only is accepted. Equal times go by id; a null time is before
    all others. Repeated rows are requests of their own; no rows give none.
    """
    rules = rules or _limits(limit, seconds, key, part)
    columns = list(dict.fromkeys([rules.event_id, *rules.keys, rules.ts]))
    scope = F.col(rules.part).cast("string") if rules.part else F.lit("")
    rows = requests.select(*columns, scope.alias("_part"), F.coalesce(F.unix_micros(F.col(rules.ts).cast("timestamp")), F.lit(-(1 << 62))).alias("_at"))
    undecided = F.lit(False)
    for k, name in enumerate(rules.keys):
        own = [F.col("_part"), F.col(name), F.when(F.col(name).isNull(), F.xxhash64(rules.event_id))]  # nulls needn't meet
        within = Window.partitionBy(*own).orderBy("_at").rangeBetween(-rules.micros, 0)
        order = Window.partitionBy(*own).orderBy("_at", rules.event_id)
        rows = rows.withColumn("_tight", F.col(name).isNotNull() & (F.count("*").over(within) > rules.limit)).withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(order) > rules.micros).cast("int"), F.lit(0)))
        rows = rows.withColumn("_session", F.sum("_new").over(order))
        busy = F.max("_tight").over(Window.partitionBy(*own, "_session"))
        rows = rows.withColumn(f"_node{k}", F.when(busy, F.xxhash64(F.lit(k), "_part", name, "_session"))).withColumn(f"_tight{k}", F.col("_tight"))
        undecided = undecided | F.col(f"_tight{k}")
    nodes = [F.when(F.col(f"_node{k}").isNotNull(), F.struct(F.lit(k).alias("k"), F.col(f"_node{k}").alias("node"))) for k in range(len(rules.keys))]
    rows = rows.withColumn("_sure", ~undecided).withColumn("_nodes", F.array_compact(F.array(*nodes))).select(*columns, "_part", "_at", "_sure", "_nodes")
    if len(rules.keys) > 1:
        linked = rows.filter("not _sure and size(_nodes) > 1").select(F.explode(F.transform(F.slice("_nodes", 2, len(rules.keys)), lambda n: F.struct(F.col("_nodes")[0]["node"].alias("a"), n["node"].alias("b")))).alias("e")).select("e.*").filter("a != b")
        parts = components(linked)
        placed = rows.select("*", F.posexplode_outer("_nodes").alias("_place", "_own")).select("*", F.col("_own.k").alias("_k"), F.col("_own.node").alias("_node"))
        placed = placed.join(parts.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_pass", F.coalesce("part", "_node"))
        # a sure request counts for each busy identity in that one's part and comes out with the first; an undecided one has one part
        placed = placed.withColumn("_out", F.coalesce(F.col("_place") == 0, F.lit(True))).filter("_out or _sure")
    else:
        placed = rows.withColumn("_pass", F.get("_nodes", F.lit(0))["node"]).withColumn("_k", F.lit(0)).withColumn("_out", F.lit(True))
    schema = requests.select(*columns).schema.add("accepted", "boolean")
    free = placed.filter("_pass is null").select(*columns, F.lit(True).alias("accepted"))
    tied = placed.filter("_pass is not null").repartition("_pass").sortWithinPartitions("_pass", "_at", rules.event_id).select(*columns, *(F.col(k).cast("string").alias(f"_key{n}") for n, k in enumerate(rules.keys)), "_part", "_at", F.when(F.col("_sure"), F.col("_k")).otherwise(-1).alias("_only"), "_pass", "_out")

    def run(batches):
        current, logs = None, None
        for pdf in batches:
            ok = []
            keys = zip(*(pdf[f"_key{n}"] for n in range(len(rules.keys))), strict=True)
            for p, own, scope, now, only in zip(pdf["_pass"], keys, pdf["_part"], pdf["_at"], pdf["_only"], strict=True):
                if p != current:
                    current, logs = p, Logs(rules.limit, rules.micros)
                ok.append(logs.accept([(n, scope, k) for n, k in enumerate(own) if k is not None and only in (-1, n)], now, only >= 0))
            yield pdf.assign(accepted=ok)[pdf["_out"]][[*columns, "accepted"]]

    return free.unionByName(tied.mapInPandas(run, schema))


def limited_stream(requests: DataFrame, limit: int = LIMIT, seconds: int = SECONDS, key: str | tuple[str, ...] = "user_id", part: str | None = None, delay: str | None = None) -> DataFrame:
    """The same over a stream, by event time.

    With a ``delay`` requests up to that late are taken in their order, later ones are dropped (Spark counts
    them). A request waits in the state until the watermark passes it; its decision comes then, so it doesn't
    depend on how the stream is cut into batches. Without one, requests are decided as they arrive, in order within a
    batch; one that comes late counts at the latest time its identity was seen, and is dropped beyond an hour (or the
    window, if that is longer). State goes by identity or, for several, by ``part``, which is needed then; logs
    go when the watermark has left their window behind, however long that takes. Requests without a time are dropped.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    rules = _limits(limit, seconds, key, part)
    if len(rules.keys) > 1 and not part:
        raise ValueError("a stream with several identities needs a part that their requests share")
    columns = list(dict.fromkeys([rules.event_id, *rules.keys, rules.ts]))
    types = dict(requests.dtypes)
    by = part or rules.keys[0]
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", accepted boolean"
    kinds = {c: types[c] for c in columns}
    state_schema = ", ".join([*(f"p{n} array<{kinds[c]}>" for n, c in enumerate(columns)), "at array<long>", "log_kind array<int>", "log_key array<string>", "log_at array<long>"])

    def run(_, frames, state):
        held = state.get if state.exists else tuple([] for _ in range(len(columns) + 4))
        waiting = pd.DataFrame({c: pd.Series(list(held[n]), dtype="object") for n, c in enumerate(columns)})
        waiting["_at"] = pd.Series(list(held[len(columns)]), dtype="int64")
        logs = Logs(rules.limit, rules.micros)
        for kind, k, t in zip(*held[-3:], strict=True):
            logs.kept.setdefault((kind, k), deque()).append(t)
        if not state.hasTimedOut:
            for f in frames:
                own = f[columns].astype("object").where(f[columns].notna(), None)
                own["_at"] = f["_at"]
                waiting = pd.concat([waiting, own]) if len(waiting) else own
        passed = state.getCurrentWatermarkMs() * 1000
        waiting = waiting.sort_values(["_at", rules.event_id])
        done = waiting["_at"] <= passed if delay else waiting["_at"].notna()
        ready, waiting = waiting[done], waiting[~done]
        ok = []
        for row in ready.itertuples(index=False):
            own = [(n, str(getattr(row, k))) for n, k in enumerate(rules.keys) if getattr(row, k) is not None]
            ok.append(logs.accept(own, max([row[-1], *(logs.kept[i][-1] for i in own if logs.kept.get(i))])))
        logs.forget(passed)
        flat = [(kind, k, t) for (kind, k), log in logs.kept.items() for t in log]
        if len(waiting) or flat:
            state.update((*(waiting[c].tolist() for c in columns), waiting["_at"].tolist(), *(list(x) for x in (zip(*flat, strict=True) if flat else ([], [], [])))))
            # a timer for the first that waits, else for when the last log entry leaves the window
            due = waiting["_at"].iloc[0] if len(waiting) else max(t for _, _, t in flat) + rules.micros
            state.setTimeoutTimestamp(max(int(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if len(ready):
            yield ready[columns].assign(accepted=ok)

    event = F.col(rules.ts).cast("timestamp")
    timed = requests.filter(event.isNotNull()).withColumn("_event", event).withWatermark("_event", delay or f"{max(seconds, 3600)} seconds").withColumn("_at", F.unix_micros("_event"))
    return timed.groupBy(by).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
