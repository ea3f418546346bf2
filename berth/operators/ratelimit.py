"""Request-rate verdicts (T1): fixed window anchored at the client's first
request after the previous window ended; the first ``limit`` requests of a
window pass; rejected requests never move the window.

One plan for every client. The requests are range-partitioned by (client, ms,
request_id), so a burst of one client is cut like any other rows, and stored
once. What crosses a cut is the open window of one client, (anchor, used):

1. ``_edges``: each partition says what state it leaves behind. A client that
   starts inside the partition leaves one state. A client that fills the whole
   partition leaves one state per entry: an entry only matters through the
   first request at or after ``anchor + window``, which is one of the times of
   the partition's first window or the first after it. Chains from all these
   times are followed at once; chains that meet are merged.
2. ``_thread``: the states are passed along each client's partitions.
3. ``_fold_batches``: each partition is folded from its true entry.

All three walk Arrow batches in order and carry O(window) state at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berth.session import ensure_checkpoint_dir, ship_package

# Fixed values (reference settings).
RATE_LIMIT = 10
WINDOW_MS = 60_000

ORDER = ["client", "ms", "request_id"]


def verdict_schema(requests: DataFrame) -> str:
    """Client and request ids keep their own types."""
    kind = {f.name: f.dataType.simpleString() for f in requests.schema}
    return (f"client {kind['client']}, request_id {kind['request_id']}, ms long, allowed boolean, "
            "retry_after_ms long, retry_after_sec long")


def _fold_client(t: np.ndarray, state: tuple[int, int] | None, limit: int, window: int):
    """Verdicts for one client's sorted times. ``state`` = (anchor, tokens)
    carried from the previous batch. Returns (allowed, anchor_per_row, state)."""
    n = len(t)
    allowed = np.zeros(n, dtype=bool)
    anchors = np.empty(n, dtype=np.int64)
    if state is None:
        anchor, tokens = int(t[0]), limit
    else:
        anchor, tokens = state
    i = 0
    while i < n:
        if t[i] - anchor >= window:          # refill: the window is anchored here
            anchor, tokens = int(t[i]), limit
        j = int(np.searchsorted(t, anchor + window, side="left"))  # end of this window
        j = max(j, i + 1)
        take = min(tokens, j - i)
        allowed[i:i + take] = True
        anchors[i:j] = anchor
        tokens -= take
        i = j
    return allowed, anchors, (anchor, tokens)


def _runs(clients: np.ndarray) -> list[tuple[int, int]]:
    """Contiguous runs of one client."""
    cuts = np.flatnonzero(clients[1:] != clients[:-1]) + 1
    return list(zip([0, *cuts], [*cuts, len(clients)], strict=True))


def verdicts(client, request_id, t: np.ndarray, allowed: np.ndarray, anchors: np.ndarray, window: int) -> pd.DataFrame:
    retry = np.where(allowed, 0, window - (t - anchors))
    return pd.DataFrame({
        "client": client, "request_id": request_id, "ms": t, "allowed": allowed,
        "retry_after_ms": pd.array(np.where(allowed, None, retry), dtype="Int64"),
        "retry_after_sec": pd.array(np.where(allowed, None, -(-retry // 1000)), dtype="Int64"),
    })


def _fold_batches(limit: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_client = None
        state = None
        first = True
        for pdf in batches:
            if pdf.empty:
                continue
            clients = pdf["client"].to_numpy()
            if first and pd.notna(pdf["in_anchor"].iloc[0]):
                cur_client = clients[0]
                state = int(pdf["in_anchor"].iloc[0]), limit - int(pdf["in_used"].iloc[0])
            first = False
            t = pdf["ms"].to_numpy(dtype=np.int64)
            allowed = np.zeros(len(pdf), dtype=bool)
            anchors = np.empty(len(pdf), dtype=np.int64)
            for s, e in _runs(clients):
                c = clients[s]
                st = state if c == cur_client else None
                allowed[s:e], anchors[s:e], state = _fold_client(t[s:e], st, limit, window)
                cur_client = c
            yield verdicts(pdf["client"], pdf["request_id"], t, allowed, anchors, window)
    return run


class _Chains:
    """Windows of one client from every possible entry, over batches of sorted
    times. Chain i stands for entries whose ``anchor + window`` lies above
    ``until[i - 1]`` and not above ``until[i]``."""

    def __init__(self, t0: int, window: int):
        self.window, self.end, self.open, self.n = window, t0 + window, True, 0
        self.until = self.anchor = self.used = np.zeros(0, np.int64)

    def add(self, t: np.ndarray) -> None:
        self.n += len(t)
        pos = np.zeros(len(self.until), np.int64)
        if self.open:
            stop = int(np.searchsorted(t, self.end, side="left"))
            self.open = stop == len(t)
            times, at = np.unique(t[:stop + 1], return_index=True)
            if len(self.until):
                new = times > self.until[-1]
                times, at = times[new], at[new]
            self.until = np.concatenate((self.until, times))
            self.anchor = np.concatenate((self.anchor, times))
            self.used = np.concatenate((self.used, np.zeros(len(times), np.int64)))
            pos = np.concatenate((pos, at))
        act = np.arange(len(self.until))
        while len(act):
            stop = np.maximum(np.searchsorted(t, self.anchor[act] + self.window, side="left"), pos[act])
            self.used[act] += stop - pos[act]
            pos[act] = stop
            more = stop < len(t)
            act, stop = act[more], stop[more]
            self.anchor[act] = t[stop]
            self.used[act] = 0
        keep = np.append(self.anchor[1:] != self.anchor[:-1], True)  # chains that met go on as one
        self.until, self.anchor, self.used = self.until[keep], self.anchor[keep], self.used[keep]


def _edges(limit: int, window: int):
    """(client, part, n, until, anchor, used): a row without chains asks for
    the entry of the partition's first client; one with chains also says what
    the partition leaves behind."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = first = cur = state = chains = None
        for pdf in batches:
            if pdf.empty:
                continue
            clients = pdf["client"].to_numpy()
            t = pdf["ms"].to_numpy(dtype=np.int64)
            runs = _runs(clients)
            if part is None:
                part, first, chains = int(pdf["part"].iloc[0]), clients[0], _Chains(int(t[0]), window)
            if cur is None and clients[0] == first:
                chains.add(t[slice(*runs[0])])
            s, e = runs[-1]  # clients that end inside the batch leave nothing
            if clients[s] != first:
                _, _, state = _fold_client(t[s:e], state if clients[s] == cur else None, limit, window)
                cur = clients[s]
        if part is None:
            return
        if cur is None:
            rows = [(first, part, chains.n, chains.until, chains.anchor, np.minimum(chains.used, limit))]
        else:
            anchor, tokens = state
            rows = [(first, part, 0, [], [], []), (cur, part, 0, [anchor], [anchor], [limit - tokens])]
        yield pd.DataFrame(rows, columns=["client", "part", "n", "until", "anchor", "used"])
    return run


def _thread(limit: int, window: int):
    """Entry (part, in_anchor, in_used) of every partition whose first client
    comes from the one before; input sorted by client and part."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, a, u = None, None, 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.client != cur:
                    cur, a, u = row.client, None, 0
                if a is not None:
                    out.append((row.part, a, u))
                if not len(row.until):
                    continue
                i = 0 if a is None else int(np.searchsorted(row.until, a + window, side="left"))
                if i == len(row.until):          # the whole partition is in the carried window
                    u = min(limit, u + int(row.n))
                else:
                    a, u = int(row.anchor[i]), int(row.used[i])
            yield pd.DataFrame(out, columns=["part", "in_anchor", "in_used"])
    return run


def rate_limit(requests: DataFrame, limit: int = RATE_LIMIT, window_ms: int = WINDOW_MS,
               partitions: int | None = None) -> DataFrame:
    """``requests(client, request_id, ms)`` -> verdict per request, exact.
    ``client`` and ``request_id`` are not null and keep their types; requests
    of one client at the same ms are taken in the order of their ids.

    The rows are stored once in the checkpoint folder, so that both passes see
    the same partitions. The broadcast side has at most one row per partition."""
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    r = requests.select("client", "request_id", F.col("ms").cast("long"))
    schema = verdict_schema(r)
    r = r.repartitionByRange(partitions, *ORDER) if partitions else r.repartitionByRange(*ORDER)
    r = r.sortWithinPartitions(*ORDER).checkpoint().withColumn("part", F.spark_partition_id())
    kind = r.schema["client"].dataType.simpleString()
    edges = r.mapInPandas(_edges(limit, window_ms), f"client {kind}, part int, n long, until array<long>, "
                                                    "anchor array<long>, used array<long>")
    entries = (edges.repartition("client").sortWithinPartitions("client", "part")
               .mapInPandas(_thread(limit, window_ms), "part int, in_anchor long, in_used long"))
    return r.join(F.broadcast(entries), "part", "left").mapInPandas(_fold_batches(limit, window_ms), schema)


def client_key(forwarded_for: str, peer: str) -> F.Column:
    """Client identity: first X-Forwarded-For entry (trimmed), else the peer
    address, else ``unknown``."""
    xff = F.col(forwarded_for)
    first = F.trim(F.split(xff, ",").getItem(0))
    return F.when(xff.isNotNull(), first).otherwise(F.coalesce(F.col(peer), F.lit("unknown")))
