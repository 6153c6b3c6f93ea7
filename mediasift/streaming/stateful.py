"""Stateful stream operators.

They need the RocksDB state store (``use_rocksdb``). A batch's rows of one key
are sorted in its task, so bound the batch with ``files_per_trigger``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mediasift.sources.records import sign, signed_text

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Links(StatefulProcessor):
    """Puts a case's entries into time order inside a bounded delay and hands each the signature before it.

    State: the last released entry (its time and signature), the latest time seen,
    and the entries still inside the delay. Entries older than the last released one come too late to be placed.
    """

    def __init__(self, delay_us: int, idle_ms: int):
        self.delay, self.idle = delay_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, signature string, seen bigint")
        self.wait = handle.getListState("wait", "at bigint, entry_id string, body string, signature string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        at, sign, seen = self._last(key)
        fresh = []
        for pdf in rows:
            seen = max(seen, int(pdf["at"].max()))
            old = pdf["at"] < at
            if old.any():
                yield self._out(key, pdf[old].assign(previous=None), True)
            fresh.append(pdf.loc[~old, ["at", "entry_id", "body", "signature"]])
        yield from self._release(key, fresh, at, sign, seen, seen - self.delay)
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        # nothing has come for a while: the rest is released
        at, sign, seen = self._last(key)
        yield from self._release(key, [], at, sign, seen, seen)

    def _last(self, key):
        return self.last.get() if self.last.exists() else (-(2**62), str(key[0]), -(2**62))

    def _release(self, key, fresh, at, sign, seen, until) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.wait.get()) if self.wait.exists() else [], columns=["at", "entry_id", "body", "signature"])
        held = pd.concat([held, *fresh], ignore_index=True).sort_values("at", kind="stable")
        ready = held["at"] <= until
        out, rest = held[ready], held[~ready]
        if len(out):
            previous = [sign, *out["signature"].iloc[:-1]]
            at, sign = int(out["at"].iloc[-1]), out["signature"].iloc[-1]
            yield self._out(key, out.assign(previous=previous), False)
        self.last.update((at, sign, seen))
        if len(rest):
            self.wait.put([(int(r.at), r.entry_id, r.body, r.signature) for r in rest.itertuples(index=False)])
        else:
            self.wait.clear()

    @staticmethod
    def _out(key, pdf: pd.DataFrame, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"case_id": str(key[0]), "entry_id": pdf["entry_id"], "body": pdf["body"], "signature": pdf["signature"], "previous": pdf["previous"], "late": late})

    def close(self) -> None:
        pass


def linked_stream(stream: DataFrame, order: str = "timestamp", delay: int = 0, idle: int = 0) -> DataFrame:
    """Entries in time order per case with the signature before them, and those too late to be placed.

    ``delay`` seconds of a case's own time bound how far entries may arrive out of
    order; that many are held in state. ``idle`` seconds without an entry release the rest (zero: only
    newer entries do). Entries of equal time keep their order of arrival; entries without a time
    or case are passed on as late.
    """
    at = F.unix_micros(F.to_timestamp(order))
    s = stream.select("case_id", "entry_id", F.coalesce(at, F.lit(-(2**63) + 1)).alias("at"), signed_text().alias("body"), "signature")
    schema = "case_id string, entry_id string, body string, signature string, previous string, late boolean"
    return s.groupBy("case_id").transformWithStateInPandas(_Links(delay * 1_000_000, idle * 1000), schema, "append", "ProcessingTime" if idle else "None")


def verify_stream(stream: DataFrame, key: bytes, order: str = "timestamp", delay: int = 0, idle: int = 0) -> DataFrame:
    """Chain violations and late entries as they arrive, across batches: case_id, entry_id, problem.

    State only orders the entries; the signatures are checked by built-in expressions.
    """
    s = linked_stream(stream, order, delay, idle)
    wrong = ~F.col("signature").eqNullSafe(sign(key, F.col("previous"), F.col("body")))
    return s.withColumn("problem", F.when(F.col("late"), "late").when(wrong, "violation")).filter("problem IS NOT NULL").select("case_id", "entry_id", "problem")


class _Change(StatefulProcessor):
    """Reference moments, then a run counter. Reports the first persistent exceedance once.

    The reference is the rows up to ``ref``, or the first three rows if those are fewer; rows
    past ``ref`` wait in the state until three are known.
    """

    def __init__(self, ref: float, warmup: float, z_cut: float, persist: int, std_floor: float, order: list[str]):
        self.p = (ref, warmup, z_cut, persist, std_floor)
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        # count, mean, squared deviations of the reference; run length, run start, done flag
        self.s = handle.getValueState("s", "n bigint, mean double, m2 double, run int, start double, done boolean, wait_t array<double>, wait_x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        ref, warmup, z_cut, persist, floor = self.p
        n, mean, m2, run, start, done, wt, wx = self.s.get() if self.s.exists() else (0, 0.0, 0.0, 0, 0.0, False, [], [])
        wait = list(zip(wt, wx))
        hit = None
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")

        def learn(x):
            nonlocal n, mean, m2
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)

        def judge(t, x):
            nonlocal run, start, done, hit
            if abs(x - mean) / ((m2 / n) ** 0.5 + floor) > z_cut and t > ref + warmup:
                start = t if run == 0 else start
                run += 1
                if run >= persist and not done:
                    done, hit = True, start
            else:
                run = 0

        for t, x in zip(pdf["t"], pdf["x"]):
            if t <= ref:
                learn(x)
            elif n < 3:
                learn(x)
                wait.append((t, x))
            if n >= 3 and wait:
                late, wait = wait, []
                for p in late:
                    judge(*p)
            elif t > ref and not wait:
                judge(t, x)
        self.s.update((int(n), float(mean), float(m2), int(run), float(start), bool(done), [float(p[0]) for p in wait], [float(p[1]) for p in wait]))
        if hit is not None:
            yield pd.DataFrame({"k": [key[0]], "change_t": [float(hit)]})

    def close(self) -> None:
        pass


def change_stream(stream: DataFrame, ref: float, warmup: float, z_cut: float = 4.0, persist: int = 3, std_floor: float = 1e-6) -> DataFrame:
    """Columns k, t, tie, x; rows must arrive in time order across batches."""
    s = stream.select(F.col("k").cast("bigint").alias("k"), "t", "tie", "x")
    p = _Change(ref, warmup, z_cut, persist, std_floor, ["t", "tie"])
    return s.groupBy("k").transformWithStateInPandas(p, "k bigint, change_t double", "append", "None")
