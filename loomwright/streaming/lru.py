"""A least-recently-used cache with a lifetime as streaming state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = ("organization_id", "namespace")


def lru_stream(uses: DataFrame, capacity: int, ttl: int, scope: tuple[str, ...] = SCOPE, key: str = "query_hash", ts: str = "last_accessed", delay: str = "0 seconds") -> DataFrame:
    """The changes that a stream of uses (scope, key, ts; a store is a use) makes to a cache of ``capacity`` entries a
    scope: scope, key, ts and change, which is ``put`` (stored, or used again), ``out`` (used longer ago than
    ``capacity`` others; ties go to the smaller key) or ``expired`` (``ttl`` seconds after its last use, once the
    watermark says so).

    After every batch the puts less what went out or expired are what ``least_recent_out`` keeps of all uses'
    latest. The state is at most ``capacity`` keys and times a scope. Uses without a time are dropped; so are, by the
    watermark, those that come later than ``delay``.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    types = dict(uses.dtypes)
    columns = [*scope, key, ts]
    micros = ttl * 1_000_000

    def run(names, frames, state):
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        passed, seen = state.getCurrentWatermarkMs() * 1000, {}
        for f in [] if state.hasTimedOut else frames:
            for k, at in zip(f[key], f["_at"], strict=True):
                seen[k] = max(at, seen.get(k, at))
        came = {k for k, at in seen.items() if at >= held.get(k, at)}
        before = dict(held)
        held |= {k: seen[k] for k in came}
        expired = {k: at for k, at in held.items() if at + micros <= passed}
        live = sorted(((k, at) for k, at in held.items() if k not in expired), key=lambda x: (-x[1], x[0]))
        kept, out = dict(live[:capacity]), dict(live[capacity:])
        if kept:
            state.update((list(kept), list(kept.values())))
            state.setTimeoutTimestamp(max((min(kept.values()) + micros) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        # what came and left within the batch was never in the cache
        rows = [(k, kept[k], "put") for k in came if k in kept] + [(k, at, c) for c, gone in (("out", out), ("expired", expired)) for k, at in gone.items() if k in before]
        if rows:
            ids, at, change = zip(*sorted(rows, key=lambda r: (r[2], r[0])), strict=True)
            yield pd.DataFrame({**dict(zip(scope, names, strict=True)), key: ids, ts: pd.to_datetime(pd.Series(at), unit="us"), "change": change})[[*columns, "change"]]

    event = F.col(ts).cast("timestamp")
    timed = uses.select(*scope, key, ts).filter(event.isNotNull()).withColumn("_event", event).withWatermark("_event", delay).withColumn("_at", F.unix_micros("_event"))
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", change string"
    return timed.groupBy(*scope).applyInPandasWithState(run, schema, f"ids array<{types[key]}>, at array<long>", "append", GroupStateTimeout.EventTimeTimeout)
