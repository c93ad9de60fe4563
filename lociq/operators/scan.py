"""Scan of sequences with position-specific scoring matrices."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.motif import BASES
from .range_join import contained_in

#: Letters that one numpy pass looks at.
PASS_LETTERS = 1 << 20
#: Letters that are looked up together.
GROUP = 4
#: Motifs whose matrices are sent to the tasks together; more of them go in several passes.
SENT_MOTIFS = 2_000

_CODE = np.full(256, 5, np.uint8)  # 0 to 3: a base, 4: N, 5: another letter or the end of a sequence
for _i, _c in enumerate((BASES + "N").encode()):
    _CODE[_c] = _i
_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"ACGT", b"TGCA"):
    _COMPLEMENT[_a] = _b


def _sides(w: list[dict[str, float]], skip_n: bool) -> dict[str, np.ndarray]:
    """Scores by position and letter code. A hit on - is a window of the forward sequence that fits the
    matrix read backwards on the complement."""

    def matrix(rows, bases):
        out = np.full((len(rows), 6), -np.inf)
        for i, row in enumerate(rows):
            for k, base in enumerate(bases):
                if row.get(base) is not None:
                    out[i, k] = row[base]
        if not skip_n:
            out[:, 4] = 0.0
        return out

    return {"+": matrix(w, BASES), "-": matrix(w[::-1], BASES[::-1])}


def _four(codes: np.ndarray) -> np.ndarray:
    """Each place's next four letters as one code; there are fives beyond the end."""
    wide = np.concatenate([codes, np.full(GROUP, 5, np.uint8)]).astype(np.uint16)
    n = len(codes)
    return ((wide[:n] * 6 + wide[1 : n + 1]) * 6 + wide[2 : n + 2]) * 6 + wide[3 : n + 3]


def _groups(w: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray, float]]:
    """The matrix by groups of four letters: (first position, score of each code, least score to go on with after
    it). The group that the fewest windows of bases pass comes first."""
    found = []
    for at in range(0, len(w), GROUP):
        a, b, c, d = np.concatenate([w[at : at + GROUP], np.zeros((max(0, at + GROUP - len(w)), 6))])
        found.append((at, (a[:, None, None, None] + b[:, None, None] + c[:, None] + d).ravel().astype(np.float32)))
    most = sum(float(t.max()) for _, t in found)
    passing = lambda t: np.mean(t.reshape(6, 6, 6, 6)[:4, :4, :4, :4] >= threshold - (most - t.max()))
    found.sort(key=lambda g: passing(g[1]))
    out, rest = [], most
    slack = 1e-4 * (1 + abs(threshold) + abs(most)) if np.isfinite(most) else 0.0
    for at, table in found:
        rest -= float(table.max())
        out.append((at, table, threshold - rest - slack))
    return out


def _candidates(four: np.ndarray, n: int, w: np.ndarray, threshold: float) -> np.ndarray:
    """The windows that may reach the threshold: one look at a group's scores for each window, and at the next
    group's only for those that could still reach it with the best of all others."""
    if not np.isfinite(w).any(axis=1).all():
        return np.zeros(0, np.int64)  # a place where no letter may stand
    (at, table, least), *others = _groups(w, threshold)
    score = table.take(four[at : at + n])
    alive = np.flatnonzero(score >= least)
    score = score[alive]
    for at, table, least in others:
        score += table.take(four[alive + at])
        keep = score >= least
        alive, score = alive[keep], score[keep]
    return alive


def _pieces(batch: pa.RecordBatch, reach: int):
    """(row, first letter, letters of its own, bytes in upper case) of each sequence; a long one in several
    pieces, each with the first `reach` letters of what follows."""
    for row, (seq, own) in enumerate(zip(batch.column("seq"), batch.column("own").to_pylist())):
        raw = (seq.as_py() or "").upper().encode("ascii", "replace")
        own = len(raw) if own is None else min(own, len(raw))
        for start in range(0, own, PASS_LETTERS):
            yield row, start, min(PASS_LETTERS, own - start), raw[start : start + PASS_LETTERS + reach]


def _passes(pieces):
    """Pieces gathered until they have PASS_LETTERS."""
    group, size = [], 0
    for piece in pieces:
        group.append(piece)
        size += len(piece[3])
        if size >= PASS_LETTERS:
            yield group
            group, size = [], 0
    if group:
        yield group


def scan(sequences: DataFrame, motifs: DataFrame, threshold: float = 0.0, *, skip_n: bool = True) -> DataFrame:
    """Hits (motif_id, chrom, start, end, score, strand, match) with a score of `threshold` or more.

    sequences: (chrom, seq), or pieces of sequences (chrom, seq, chunk_start, own) as read_fasta_chunks()
    makes them, with an overlap of the longest motif less one; of any length and case. motifs: motif_id
    and w (see weights()). start is 1-based and end is start + length, on both strands in forward
    coordinates. A window with a letter that can't occur at its place has no score. A sequence is encoded
    once, four letters to a code; a matrix looks up its most selective group of four for all windows at once, and the
    others only where the threshold can still be reached. Only hits leave the task: nothing is shuffled. Null
    and empty sequences have no hits; without motifs there are none.
    """
    pieces = "chunk_start" in sequences.columns
    start = F.col("chunk_start").cast("long") if pieces else F.lit(0).cast("long")
    own = F.col("own").cast("long") if pieces else F.lit(None).cast("long")
    rows = sequences.select("chrom", "seq", start.alias("chunk_start"), own.alias("own"))
    chrom_type = rows.schema["chrom"].dataType.simpleString()
    schema = f"motif_id string, chrom {chrom_type}, start long, end long, score double, strand string, match string"
    blocks = -(-motifs.count() // SENT_MOTIFS)
    parts = [_scan(rows, motifs if blocks == 1 else motifs.where(F.pmod(F.xxhash64("motif_id"), F.lit(blocks)) == k), threshold, skip_n, schema) for k in range(blocks)]
    return reduce(DataFrame.unionAll, parts) if parts else sequences.sparkSession.createDataFrame([], schema)


def _scan(rows: DataFrame, motifs: DataFrame, threshold: float, skip_n: bool, schema: str) -> DataFrame:
    matrices = [(r["motif_id"], _sides([dict(m) for m in r["w"]], skip_n)) for r in motifs.select("motif_id", "w").collect()]
    sent = rows.sparkSession.sparkContext.broadcast(matrices)
    reach = max((len(s["+"]) for _, s in matrices), default=1) - 1

    def run(batches):
        for batch in batches:
            chroms, chunk_start = batch.column("chrom"), batch.column("chunk_start").to_numpy()
            for group in _passes(_pieces(batch, reach)):
                letters = np.frombuffer(b"\n".join(p[3] for p in group) + b"\n", np.uint8)
                codes = _CODE[letters]
                four = _four(codes)
                begins = np.concatenate([[0], np.cumsum([len(p[3]) + 1 for p in group])])[:-1]
                row, first, mine = (np.array([p[k] for p in group]) for k in range(3))
                for motif, sides in sent.value:
                    for strand, w in sides.items():
                        n = len(codes) - len(w) + 1
                        if n <= 0:
                            continue
                        at = _candidates(four, n, w, threshold)
                        score = w[0][codes[at]]
                        for i in range(1, len(w)):
                            score += w[i][codes[at + i]]
                        at, score = at[score >= threshold], score[score >= threshold]
                        piece = np.searchsorted(begins, at, side="right") - 1
                        inside = at - begins[piece] < mine[piece]
                        at, piece, score = at[inside], piece[inside], score[inside]
                        if not len(at):
                            continue
                        match = letters[at[:, None] + np.arange(len(w))]
                        if strand == "-":
                            match = _COMPLEMENT[match[:, ::-1]]
                        match = pa.array(np.ascontiguousarray(match).view(f"S{len(w)}").ravel().tolist(), pa.binary()).cast(pa.string())
                        begin = chunk_start[row[piece]] + first[piece] + at - begins[piece] + 1
                        same = lambda x: pa.array([x] * len(at), pa.string())  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([same(motif), chroms.take(pa.array(row[piece])), pa.array(begin), pa.array(begin + len(w)), pa.array(score), same(strand), match], names=["motif_id", "chrom", "start", "end", "score", "strand", "match"])

    return rows.mapInArrow(run, schema)


def in_regions(hits: DataFrame, regions: DataFrame) -> DataFrame:
    """Hits that lie within one of the regions (chrom, start, end)."""
    return contained_in(hits, regions)
