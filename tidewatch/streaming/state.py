"""Keyed state of the streaming stages.

Each processor sees the rows of one key in one micro-batch. Every input holds at most
one row per key and window, so a group is bounded by the windows of the batch. A key that
is silent for its TTL leaves no state behind. Flows, of which there are nearly as many as
rows, are kept by buckets of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.config import Profile
from tidewatch.functions.entropy import frame_entropies
from tidewatch.operators.flows import FLOW_KEY
from tidewatch.operators.volumetric import EntropyModel

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# fixed, as stored state is found by it
FLOW_BUCKETS = 1024

GAP_ROWS = (
    "window_start timestamp, src_ip string, src_port int, dst_ip string, dst_port int, "
    "syn_count bigint, ack_count bigint, gap_us bigint, gap_count bigint"
)
KINEMATIC_ROWS = (
    "ts timestamp, source_ip string, residual double, velocity double, acceleration double"
)
SIMILARITY_ROWS = "window_start timestamp, target_port int, jaccard_score double"
POSTERIOR_ROWS = "time timestamp, source_ip string, posterior double"


def use_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def micros(ts) -> int:
    return round(ts.timestamp() * 1_000_000)


class FlowGaps(StatefulProcessor):
    """Last packet time of each flow of a bucket, forgotten after the TTL.

    A flow has few rows in a batch, so a bucket of flows is a key: one state is read,
    written and timed for all of them.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl_us = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState(
            "last", "src_ip array<string>, src_port array<int>, dst_ip array<string>, dst_port array<int>, us array<bigint>"
        )

    def _read(self) -> dict[tuple, int]:
        state = self.last.get()
        return dict(zip(zip(*state[:4]), state[4])) if state is not None else {}

    def _keep(self, last: dict[tuple, int], expired_ms: int) -> None:
        """Stores the flows whose memory ends after the given time."""
        last = {flow: us for flow, us in last.items() if self._expiry(us) > expired_ms}
        if not last:
            self.last.clear()
            return
        self.last.update((*([flow[i] for flow in last] for i in range(4)), list(last.values())))
        self.handle.registerTimer(self._expiry(max(last.values())))

    def _expiry(self, us: int) -> int:
        return (us + self.ttl_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self._read()
        out = []
        for row in sorted(rows, key=lambda r: r.window_start):
            flow = (row.src_ip, row.src_port, row.dst_ip, row.dst_port)
            previous = last.get(flow)
            remembered = previous is not None and row.start_us - previous <= self.ttl_us
            gap = row.last_us - row.first_us + (row.first_us - previous if remembered else 0)
            count = row.packets - 1 + (1 if remembered else 0)
            out.append(
                Row(
                    window_start=row.window_start,
                    src_ip=row.src_ip,
                    src_port=row.src_port,
                    dst_ip=row.dst_ip,
                    dst_port=row.dst_port,
                    syn_count=row.syn_count,
                    ack_count=row.ack_count,
                    gap_us=gap,
                    gap_count=count,
                )
            )
            last[flow] = row.last_us
        self._keep(last, timerValues.getCurrentWatermarkInMs())
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._keep(self._read(), expiredTimerInfo.getExpiryTimeInMs())
        return iter([])

    def close(self) -> None:
        pass


class Expiring(StatefulProcessor):
    """A processor that forgets a key when the watermark passes the key's last event.

    The watermark of these stages lies the TTL behind the newest event, so that is the
    silence after which a key is forgotten.
    """

    def watch(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def touch(self, us: int) -> None:
        if not self.last.exists() or us > self.last.get()[0]:
            self.last.update((us,))
            self.handle.registerTimer(us // 1000 + 1)

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and self.last.get()[0] // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            self.forget()
        return iter([])

    def close(self) -> None:
        pass


class Kinematics(Expiring):
    """Trailing volumes and the last two residuals per source."""

    def __init__(self, p: Profile, model: EntropyModel):
        self.size, self.alpha, self.model = p.trailing_rows, p.renyi_alpha, model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watch(handle)
        self.memory = handle.getValueState(
            "memory", "t array<double>, n array<double>, s array<double>, r array<double>"
        )

    def forget(self) -> None:
        self.memory.clear()

    def _residuals(self, series: list[list[float]], new: int) -> list[float]:
        """Residuals of the frames that end at the last `new` rows, in one entropy call."""
        n = len(series[0])
        frames = [x[max(0, end - self.size):end] for x in series for end in range(n - new + 1, n + 1)]
        h = frame_entropies(np.concatenate([np.array(f, float) for f in frames]), np.array([len(f) for f in frames]), self.alpha)
        t, u, v = h.reshape(3, new).tolist()
        return [abs(a - self.model.predict(b, c)) for a, b, c in zip(t, u, v)]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.memory.get() if self.memory.exists() else ([], [], [], [])
        t, n, s, memory = (list(x) for x in state)
        rows = sorted(rows, key=lambda x: x.window_start)
        before = len(t)
        series = [[*old, *(getattr(row, c) for row in rows)] for old, c in ((t, "t_vol"), (n, "n_req"), (s, "s_len"))]
        out = []
        for at, (row, residual) in enumerate(zip(rows, self._residuals(series, len(rows))), before + 1):
            velocity = acceleration = 0.0
            if at < 2:  # a frame of one row has no residual yet
                residual = 0.0
            else:
                memory = [*memory, residual][-3:]
                if len(memory) >= 2:
                    velocity = abs(memory[-1] - memory[-2])
                if len(memory) == 3:
                    acceleration = abs((memory[2] - memory[1]) - (memory[1] - memory[0]))
            out.append(
                Row(
                    ts=row.window_start,
                    source_ip=key[0],
                    residual=residual,
                    velocity=velocity,
                    acceleration=acceleration,
                )
            )
        self.memory.update((*(x[-self.size:] for x in series), memory))
        self.touch(micros(rows[-1].window_start))
        return iter(out)


class PreviousSignature(Expiring):
    """Last signature per port; only the adjacent window can score."""

    def __init__(self, p: Profile):
        self.step_us, self.min_sources = p.capture_seconds * 1_000_000, p.min_sources

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watch(handle)
        self.previous = handle.getValueState("previous", "us bigint, signature array<bigint>")

    def forget(self) -> None:
        self.previous.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, signature = self.previous.get() if self.previous.exists() else (None, None)
        out = []
        for row in sorted(rows, key=lambda x: x.window_start):
            now, current = micros(row.window_start), list(row.signature)
            if at is not None:
                adjacent = at == now - self.step_us and row.n_sources >= self.min_sources
                same = sum(a == b for a, b in zip(current, signature)) if adjacent else 0
                out.append(
                    Row(
                        window_start=row.window_start,
                        target_port=key[0],
                        jaccard_score=same / len(current),
                    )
                )
            at, signature = now, current
        self.previous.update((at, signature))
        self.touch(at)
        return iter(out)


class Posterior(Expiring):
    """Running posterior and last evaluation time per source."""

    def __init__(self, p: Profile):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watch(handle)
        self.belief = handle.getValueState("belief", "posterior double, seen double")

    def forget(self) -> None:
        self.belief.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        p = self.p
        prior, seen = self.belief.get() if self.belief.exists() else (p.base_prior, None)
        out = []
        for row in sorted(rows, key=lambda x: x.time):
            if row.skip:
                out.append(Row(time=row.time, source_ip=key[0], posterior=None))
                continue
            now = micros(row.time) / 1e6
            if seen is not None and now - seen > p.gap_seconds:
                prior = max(prior * p.decay ** int((now - seen) / p.step_seconds), p.base_prior)
            a = min(max(row.probability, 1e-5), 1.0 - 1e-5)
            prior = a * prior / (a * prior + (1.0 - a) * (1.0 - prior))
            seen = now
            out.append(Row(time=row.time, source_ip=key[0], posterior=prior))
        if seen is not None:
            self.belief.update((prior, seen))
            self.touch(round(seen * 1_000_000))
        return iter(out)


def flow_gaps(summaries: DataFrame, p: Profile) -> DataFrame:
    """`summaries` carries a watermark on window_start and start_us next to it."""
    use_rocksdb(summaries)
    bucket = F.pmod(F.xxhash64(*FLOW_KEY), F.lit(FLOW_BUCKETS))
    return summaries.withColumn("bucket", bucket).groupBy("bucket").transformWithState(
        FlowGaps(p.flow_ttl_seconds), GAP_ROWS, "Append", "EventTime"
    )


def remembered(rows: DataFrame, time: str, p: Profile) -> DataFrame:
    """The watermark by which keys are forgotten; no row within the TTL is late."""
    use_rocksdb(rows)
    return rows.withWatermark(time, f"{p.state_ttl_seconds} seconds")


def kinematics(flows: DataFrame, p: Profile, model: EntropyModel) -> DataFrame:
    return remembered(flows, "window_start", p).groupBy("source_ip").transformWithState(
        Kinematics(p, model), KINEMATIC_ROWS, "Append", "EventTime"
    )


def similarity(signatures: DataFrame, p: Profile) -> DataFrame:
    return remembered(signatures, "window_start", p).groupBy("target_port").transformWithState(
        PreviousSignature(p), SIMILARITY_ROWS, "Append", "EventTime"
    )


def posterior(rows: DataFrame, p: Profile) -> DataFrame:
    return remembered(rows, "time", p).groupBy("source_ip").transformWithState(
        Posterior(p), POSTERIOR_ROWS, "Append", "EventTime"
    )
