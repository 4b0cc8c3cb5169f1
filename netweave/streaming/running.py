"""Per-packet running flow features as keyed state with timers.

State of a flow (RocksDB state store): its running totals, one small value, and a map
from time slice to the packets of that slice that the watermark has not passed. A
packet adds to one slice and sets that slice's event-time timer; nothing else of the
flow is read or written, however many packets wait. When the watermark passes a slice,
its timer continues the totals in time order, emits the feature rows, and drops the
entry. Timers fire in time order, so packets may arrive in any order within the
watermark. One more timer a flow evicts its totals after idle event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUNNING_SCHEMA = ("packet_id long, ts timestamp, src_ip string, dst_ip string, proto_num int, "
                  "flow_duration double, total_fwd_packets long, total_backward_packets long, "
                  "total_length_fwd_packets long, total_length_bwd_packets long, "
                  "fwd_packet_length_mean double, bwd_packet_length_mean double, "
                  "flow_bytes_per_s double, flow_packets_per_s double, "
                  "fwd_iat_total double, bwd_iat_total double")
TOTALS = "n long, nbytes long, first_us long, last_us long, evict_ms long"
SLICE = "start_ms long"
WAITING = "us array<long>, packet_id array<long>, length array<long>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(pdf: pd.DataFrame) -> pd.Series:
    return pd.to_datetime(pdf["ts"], utc=True).dt.tz_localize(None).astype("datetime64[us]").astype("int64")


class RunningFeatures(StatefulProcessor):
    """One flow's packets to feature rows, slice by slice of ``slice_ms``."""

    def __init__(self, idle_ms: int, slice_ms: int):
        self.idle_ms, self.slice_ms = idle_ms, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.waiting = handle.getMapState("waiting", SLICE, WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pd.DataFrame({"us": micros(p), "packet_id": p["packet_id"], "length": p["length"]}) for p in rows]).astype("int64")
        start = new["us"] // 1000 // self.slice_ms * self.slice_ms
        for at, part in new.groupby(start, sort=False):
            at, lists = (int(at),), [part[c].tolist() for c in ("us", "packet_id", "length")]
            if self.waiting.containsKey(at):
                lists = [list(old) + more for old, more in zip(self.waiting.getValue(at), lists)]
            else:
                self.handle.registerTimer(at[0] + self.slice_ms)
            self.waiting.updateValue(at, tuple(lists))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        at = (due - self.slice_ms,)
        state = self.totals.get() if self.totals.exists() else None
        if self.waiting.containsKey(at):
            us, ids, length = (np.array(x, np.int64) for x in self.waiting.getValue(at))
            self.waiting.removeKey(at)
            order = np.lexsort((ids, us))
            state, out = self._advance(key, us[order], ids[order], length[order], state)
            yield out
        if state is not None:
            self._arm(state, due)

    def _arm(self, state, now: int) -> None:
        """Keep one eviction timer a flow; evict when it is due."""
        n, nbytes, first, last, evict = state
        idle = last // 1000 + self.idle_ms + 1
        if idle <= now:
            self.totals.clear()
            return
        if evict <= now:  # none set, or the one that fires now
            evict = idle
            self.handle.registerTimer(evict)
        self.totals.update((n, nbytes, first, last, evict))

    def _advance(self, key, us, ids, length, state):
        """Feature rows of packets in time order, and the totals after them. A gap
        longer than the idle time starts the flow anew."""
        n, nbytes, first, last, evict = state or (0, 0, None, None, 0)
        before = np.concatenate([[us[0] if last is None else last], us[:-1]])
        fresh = us - before > self.idle_ms * 1000
        fresh[0] |= first is None
        run = np.cumsum(fresh)
        head = np.flatnonzero(fresh)
        start = np.where(run > 0, head[np.maximum(run, 1) - 1] if len(head) else 0, 0)
        old = run == 0
        cnt = np.arange(len(us)) - start + 1 + np.where(old, n, 0)
        upto = np.cumsum(length)
        cum = upto - upto[start] + length[start] + np.where(old, nbytes, 0)
        began = np.where(old, first if first is not None else 0, us[start])
        dur = (us - began) / 1e6
        with np.errstate(divide="ignore", invalid="ignore"):
            per_s = [np.where(dur > 0, x / dur, 0.0) for x in (cum, cnt)]
        out = pd.DataFrame({
            "packet_id": ids, "ts": pd.to_datetime(us, unit="us", utc=True), "src_ip": key[0], "dst_ip": key[1], "proto_num": key[2],
            "flow_duration": dur, "total_fwd_packets": cnt, "total_backward_packets": 0, "total_length_fwd_packets": cum,
            "total_length_bwd_packets": 0, "fwd_packet_length_mean": cum / cnt, "bwd_packet_length_mean": 0.0,
            "flow_bytes_per_s": per_s[0], "flow_packets_per_s": per_s[1], "fwd_iat_total": np.where(cnt > 1, dur, 0.0), "bwd_iat_total": 0.0})
        return (int(cnt[-1]), int(cum[-1]), int(began[-1]), int(us[-1]), evict), out

    def close(self) -> None:
        pass


def use_rocksdb(packets: DataFrame) -> None:
    """Keyed state with maps and timers needs the RocksDB state store."""
    conf = packets.sparkSession.conf
    if conf.get(PROVIDER, None) != ROCKSDB:
        conf.set(PROVIDER, ROCKSDB)
