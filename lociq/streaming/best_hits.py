"""Window annotation of a stream, with a bounded window of rows as state. Chromosomes and motifs are dealt into a
fixed number of shares, whose rows are handled together: a call costs the same for one row as for thousands.

Positions are event time: a base is a second, and position 0 is second 1. A site is annotated once the watermark says that no row can
come any more that has a say in it; rows are kept only as long as a site that isn't annotated yet, or one
that may still come, can need them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "site_id long, motif string, shift long, score double, strand_equal int, num_in_window long"
STATE = "rows binary"
COLUMNS = ["kind", "chrom", "motif", "id", "start", "end", "strand", "score"]
#: Pairs of a site and a hit that are looked at together, and rows in a piece of state.
PAIRS, PIECE = 1 << 21, 1 << 17


def annotated(sites: pd.DataFrame, hits: pd.DataFrame, wanted: np.ndarray, distance: int) -> pd.DataFrame:
    """Best hit and number of hits in the window of the wanted sites (numbers of rows), as best_hits() has them
    in mode admitted, of each chromosome and motif (columns that may be left out if there is only one).

    Chromosomes and motifs are laid out one after the other on one line, farther apart than a window reaches."""
    by = [c for c in ("chrom", "motif") if c in sites.columns]
    names = ["site_id", *(["motif"] if "motif" in by else []), "shift", "score", "strand_equal", "num_in_window"]
    if not len(hits) or not len(wanted):
        return pd.DataFrame([], columns=names)
    lane = pd.concat([sites[by], hits[by]], ignore_index=True).groupby(by, sort=False).ngroup().to_numpy(np.int64) if by else np.zeros(len(sites) + len(hits), np.int64)
    position = lambda rows, c: rows[c].to_numpy(np.int64)
    low = min(position(rows, c).min() for rows in (sites, hits) for c in ("start", "end"))
    high = max(position(rows, c).max() for rows in (sites, hits) for c in ("start", "end"))
    place = lane * (high - low + 4 * distance + 4) - low
    s_start, s_end = (position(sites, c) + place[: len(sites)] for c in ("start", "end"))
    h_start, h_end = (position(hits, c) + place[len(sites) :] for c in ("start", "end"))
    by_start = np.argsort(s_start, kind="stable")
    reach = np.maximum.accumulate(s_end[by_start])
    earlier = np.searchsorted(s_start[by_start], h_start + distance, "right")
    admitted = np.flatnonzero((earlier > 0) & (reach[earlier - 1] >= h_end - distance))
    kept = admitted[np.argsort(h_end[admitted], kind="stable")]
    h_start, h_end = h_start[kept], h_end[kept]
    score, strand = hits["score"].to_numpy(float)[kept], hits["strand"].to_numpy(object)[kept]
    order = np.lexsort((-position(hits, "id")[kept], -h_start, score))
    rank = np.empty(len(kept), np.int64)
    rank[order] = np.arange(len(kept))  # the best has the highest
    first, last = np.searchsorted(h_end, s_start[wanted] - distance), np.searchsorted(h_end, s_end[wanted] + distance, "right")
    wanted, first, n = wanted[last > first], first[last > first], (last - first)[last > first]
    best = np.full(len(wanted), -1)
    piece = (np.cumsum(n) - n) // PAIRS
    for rows in np.split(np.arange(len(wanted)), np.flatnonzero(np.diff(piece)) + 1) if len(wanted) else []:
        begins = np.cumsum(n[rows]) - n[rows]
        hit = np.arange(n[rows].sum()) + np.repeat(first[rows] - begins, n[rows])
        may = np.abs(h_start[hit] - np.repeat(s_start[wanted[rows]], n[rows])) <= distance
        best[rows] = np.maximum.reduceat(np.where(may, rank[hit], -1), begins)
    wanted, n, hit = wanted[best >= 0], n[best >= 0], order[best[best >= 0]]
    out = {"site_id": position(sites, "id")[wanted], "shift": h_start[hit] - s_start[wanted], "score": score[hit], "strand_equal": (strand[hit] == sites["strand"].to_numpy(object)[wanted]).astype(int), "num_in_window": n}
    if "motif" in by:
        out["motif"] = sites["motif"].to_numpy(object)[wanted]
    return pd.DataFrame(out)[names]


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as one value of the state: a call to the state store costs far more than a row in it."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


class WindowAnnotation(StatefulProcessor):
    """State of a share of the chromosomes and motifs: their sites, open until annotated, and their hits, in pieces
    of many rows."""

    def __init__(self, distance: int):
        self.distance = distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", STATE)

    def _due(self, end: int) -> int:
        """Milliseconds beyond which a site is decided: its hits begin at end + distance at the latest, and what
        lets them in begins at most `distance` after that."""
        return (end + 2 * self.distance + 2) * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            mine = frame["kind"] == "site"
            self.rows.appendValue(_packed(frame[COLUMNS].assign(open=mine)))
            if mine.any():
                first = min(int(frame["end"][mine].min()), first if first is not None else int(frame["end"][mine].min()))
        timers = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        if not timers:
            # One timer at a time: of the first site to be decided, or to look whether hits may go.
            now = max(0, timerValues.getCurrentWatermarkInMs())
            self.handle.registerTimer(self._due(first) if first is not None else now + self._due(self.distance))
        elif first is not None and self._due(first) < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(self._due(first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        d, now = self.distance, timerValues.getCurrentWatermarkInMs()
        rows = pd.concat([pa.ipc.open_stream(piece[0]).read_pandas() for piece in self.rows.get()], ignore_index=True)
        sites, hits = (rows[rows["kind"] == kind].reset_index(drop=True) for kind in ("site", "hit"))
        decided = sites["open"].to_numpy(bool) & ((sites["end"].to_numpy(np.int64) + 2 * d + 2) * 1000 <= now)
        out = annotated(sites, hits, np.flatnonzero(decided), d)
        sites["open"] = sites["open"].to_numpy(bool) & ~decided
        # The first start of a site that is open or may still come.
        begins = min([now // 1000 - 1, *sites.loc[sites["open"], "start"].tolist()])
        hits = hits[hits["end"].to_numpy(np.int64) + d >= begins]
        sites = sites[sites["open"] | (sites["end"].to_numpy(np.int64) + 2 * d >= begins)]
        kept = pd.concat([sites, hits], ignore_index=True)
        if len(kept):
            self.rows.put([_packed(kept.iloc[i : i + PIECE]) for i in range(0, len(kept), PIECE)])
        else:
            self.rows.clear()
        left = sites.loc[sites["open"], "end"].tolist()
        if left:
            self.handle.registerTimer(self._due(min(left)))
        elif len(kept):
            self.handle.registerTimer(now + self._due(d))
        if len(out):
            yield out

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """State kept in RocksDB, as this kind of state needs, in no more parts than there are cores: each part's task starts
    a Python process of its own in each batch. The session's settings come back afterwards."""
    shuffle = "spark.sql.shuffle.partitions"
    few = str(min(int(spark.conf.get(shuffle)), spark.sparkContext.defaultParallelism))
    before = {name: spark.conf.get(name, None) for name in ("spark.sql.streaming.stateStore.providerClass", shuffle)}
    for name, value in zip(before, (PROVIDER, few)):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def stream_best_hits(sites: DataFrame, hits: DataFrame, motifs: list[str], distance: int = 100, *, late: int = 1_000, shares: int = 64) -> DataFrame:
    """The rows of annotate.best_hits() in mode admitted, from two streams. sites: (site_id, chrom, start, end,
    strand); hits: (hit_id, chrom, start, end, motif, score, strand), positions not below 0.

    Rows may come in any order, as long as none starts more than `late` bases before the furthest start seen:
    later ones are dropped. A site comes out, in append mode, when the furthest start is more than 2 * distance +
    late behind its end; a marker far behind flushes the last ones. The state is what starts or ends within a
    few distances, `late` and the longest open site; (chromosome, motif) is dealt into `shares` by a hash.
    Start the query within rocksdb().
    """
    at = lambda c: F.timestamp_seconds(F.col(c) + 1).alias("ts")  # noqa: E731; a first watermark of 0 would drop time 0
    left = sites.select("chrom", F.explode(F.array(*map(F.lit, motifs))).alias("motif"), at("start"), F.lit("site").alias("kind"), F.col("site_id").alias("id"), "start", "end", "strand", F.lit(None).cast("double").alias("score"))
    right = hits.where(F.col("motif").isin(motifs)).select("chrom", "motif", at("start"), F.lit("hit").alias("kind"), F.col("hit_id").alias("id"), "start", "end", "strand", "score")
    rows = left.unionByName(right).withColumn("share", F.pmod(F.hash("chrom", "motif"), F.lit(shares))).withWatermark("ts", f"{late} seconds")
    return rows.groupBy("share").transformWithStateInPandas(WindowAnnotation(distance), OUT, "Append", "EventTime")
