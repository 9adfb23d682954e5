"""Models as pluggable column producers: embedders and tools."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import settled
from .relational import ROLE_LEVELS


def embedded(df: DataFrame, encode: Callable[[list[str]], list[list[float]]], text_col: str, out_col: str = "embedding", dim: int | None = None, batch: int = 32) -> DataFrame:
    """``df`` with unit vectors of the texts. ``encode`` runs on the executors over lists of texts; vectors that
    aren't of length ``dim`` or finite become null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(texts), batch):
            out += [None if v is None else [float(x) for x in v] for v in encode([t or "" for t in texts.iloc[k : k + batch]])]
        return pd.Series(out)

    rows = df.withColumn(out_col, run(F.col(text_col)))
    ok = V.valid(F.col(out_col), dim) if dim else F.col(out_col).isNotNull()
    return rows.withColumn(out_col, F.when(ok, V.unit(F.col(out_col))))


@dataclass
class Tool:
    """A named DataFrame function with the types of its arguments, and the role that may run it."""

    name: str
    run: Callable[..., DataFrame]
    schema: dict[str, type]
    role: str = "viewer"


@dataclass
class Registry:
    """Tools by name; ``call`` checks arguments and role, runs the tool and records the time it took."""

    tools: dict[str, Tool] = field(default_factory=dict)
    calls: list[tuple[str, float, str]] = field(default_factory=list)  # name, seconds, and how it ended

    def register(self, name: str, run: Callable[..., DataFrame], schema: dict[str, type], role: str = "viewer") -> None:
        if name in self.tools:
            raise ValueError(f"there is a tool {name}")
        self.tools[name] = Tool(name, run, schema, role)

    def _checked(self, name: str, role: str, arguments: dict) -> Tool:
        tool = self.tools.get(name)
        if tool is None:
            raise KeyError(name)
        if ROLE_LEVELS.get(role, 0) < ROLE_LEVELS[tool.role]:
            raise PermissionError(f"{name} needs the role {tool.role}")
        wrong = [k for k, v in arguments.items() if k not in tool.schema or not isinstance(v, tool.schema[k])] + [k for k in tool.schema if k not in arguments]
        if wrong:
            raise ValueError(f"wrong or missing arguments: {', '.join(sorted(wrong))}")
        return tool

    def call(self, name: str, role: str, **arguments) -> DataFrame:
        """The tool's DataFrame; what Spark does for it later isn't timed. See ``run``."""
        tool, start, ended = self._checked(name, role, arguments), time.perf_counter(), "failed"
        try:
            out, ended = tool.run(**arguments), "ok"
            return out
        finally:
            self.calls.append((name, time.perf_counter() - start, ended))

    def run(self, spark: SparkSession, name: str, role: str, timeout: float | None = None, progress: Callable[[float, int, int], None] | None = None, **arguments) -> DataFrame:
        """The tool's rows, worked out and stored, within ``timeout`` seconds: then its Spark jobs, which carry a tag of
        their own, are cancelled and TimeoutError is raised (what a tool does in Python alone can't be stopped, but isn't
        waited for). ``progress`` gets the seconds passed and the tasks done and known so far, at last all of them."""
        tool, tag, out = self._checked(name, role, arguments), f"tool-{uuid.uuid4().hex}", {}
        context, start = spark.sparkContext, time.perf_counter()

        def work():
            context.addJobTag(tag)
            try:
                out["rows"] = settled(tool.run(**arguments), "tool")
            except BaseException as e:  # given to the caller below
                out["error"] = e

        thread = InheritableThread(target=work, daemon=True)
        thread.start()
        while thread.is_alive():
            left = 0.1 if timeout is None else min(0.1, timeout - (time.perf_counter() - start))
            if left <= 0:
                break
            thread.join(left)
            if progress:
                progress(time.perf_counter() - start, *self._tasks(context, tag))
        late = thread.is_alive()
        if late:
            context.cancelJobsWithTag(tag)
        took = time.perf_counter() - start
        self.calls.append((name, took, "timeout" if late else "failed" if "error" in out else "ok"))
        if late:
            raise TimeoutError(f"{name} took longer than {timeout} seconds")
        if "error" in out:
            raise out["error"]
        if progress:
            _, known = self._tasks(context, tag)
            progress(took, known, known)
        return out["rows"]

    @staticmethod
    def _tasks(context, tag: str) -> tuple[int, int]:
        """Tasks done and known of a tag's jobs, without stages that were skipped."""
        tracker, done, known = context._jsc.sc().statusTracker(), 0, 0
        for job in tracker.getJobIdsForTag(tag):
            info = tracker.getJobInfo(job)
            if info.isEmpty():
                continue
            running = info.get().status().toString() == "RUNNING"
            for stage in info.get().stageIds():
                of = tracker.getStageInfo(stage)
                if of.isDefined() and (running or of.get().numCompletedTasks()):
                    done, known = done + of.get().numCompletedTasks(), known + of.get().numTasks()
        return done, known

    def metrics(self, spark: SparkSession) -> DataFrame:
        """The calls as metric rows (name, seq, value in seconds, ended), for ``metrics.tool_latencies``."""
        rows = [(n, k, s, ended) for k, (n, s, ended) in enumerate(self.calls)]
        return spark.createDataFrame(rows, "name string, seq long, value double, ended string")


def leave_days(start: Column, end: Column) -> Column:
    """Days of leave, both ends counted; null if it ends before it starts."""
    days = F.datediff(end, start) + 1
    return F.when(days > 0, days)


def leave_balance(balance: Column, kind: Column, days: Column) -> Column:
    """What is left, never below 0; unpaid leave takes nothing."""
    return F.when(kind == "unpaid", balance).otherwise(F.greatest(F.lit(0), balance - days))


def leave_approved(kind: Column, days: Column) -> Column:
    return kind.isin("sick", "bereavement") & (days <= 3)
