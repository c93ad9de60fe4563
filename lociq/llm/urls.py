"""URL filters: glob rules as one bit-parallel wildcard automaton.

All globs are packed, one after the other, into the bits of a row of 64-bit words (Shift-And). A
step on one character moves every state of every glob at once: shift by one bit with carry from word
to word, mask by the character's bits, keep the bits that stand before a `*`. The URLs of a batch go
through the automaton side by side, a numpy row each.

A glob is matched against the whole canonical URL: the host in lower case, a mark that no text has, and
the path; query and fragment are left out. `*` stands for any run of characters and `?` for any one
byte, but neither stands for the mark, so that a host in a path (archives, redirects) is no host.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lower_ascii, read_table, text_bytes


#: Stands between host and path: a byte that UTF-8 text never has.
MARK = b"\xff"


def glob(host: str, path: str = "*") -> bytes:
    return host.encode() + MARK + path.encode()


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> list[bytes]:
        return [glob(self.host, self.path + "*"), glob("*." + self.host, self.path + "*")]


# The rules of the query.
RULES = [
    HostRule("block", "com", "/en/"),
    HostRule("allow", "example.com", "/en/7"),
    HostRule("allow", "net", "/de/"),
    HostRule("block", "example.net", "/de/8"),
    HostRule("block", "org", "/es/"),
]
# Fixed values: (host, path) globs of what is blocked where no rule fits.
BLOCKED = [
    *((h, "*") for h in ("*casino*", "*free-bets*", "*spam-farm*", "*cheap-pills*", "*adult-x*", "*payday-loan*", "*replica-watch*", "*link-farm*", "doubleclick.*", "*.doubleclick.*", "adserver.*", "tracking.*")),
    *(("*", p) for p in ("/wp-login.php*", "/wp-admin/*", "/xmlrpc.php*", "/cgi-bin/*", "*/ads/click/*", "*.exe", "*.apk", "*.torrent", "*.zip", "*/feed/rss.xml")),
]


class GlobAutomaton:
    """Shift-And masks of all globs. Each glob takes a bit for each of its bytes but stars, and one
    before them that stands for "nothing read yet"."""

    def __init__(self, globs: list[bytes]):
        place, initial, final, stay, on = 0, [], [], [], []
        for glob in globs:
            initial.append(place)
            for c in glob:
                if c == ord("*"):
                    stay.append(place)
                else:
                    place += 1
                    on.append((place, c))
            final.append(place)
            place += 1
        self.words = -(-max(place, 1) // 64)
        self.final = final
        self.initial = self._bits(initial)
        self.stay = np.tile(self._bits(stay), (256, 1))
        self.stay[MARK[0]] = 0
        self.by_char = np.zeros((256, self.words), np.uint64)
        for p, c in on:
            for row in range(256) if c == ord("?") else [c]:
                if row != MARK[0] or c == MARK[0]:
                    self.by_char[row, p // 64] |= np.uint64(1 << p % 64)

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for p in places:
            out[p // 64] |= np.uint64(1 << p % 64)
        return out

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of flags for each text: which globs match all of it."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, longest = offsets[:-1][order], int(lengths.max(initial=0))
        alive = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
        state = np.tile(self.initial, (len(lengths), 1))
        for i in range(longest):
            n = alive[i]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            read = data[begin[:n] + i]
            state[:n] = (moved & self.by_char[read]) | (now & self.stay[read])
        flags = np.empty((len(lengths), len(self.final)), bool)
        flags[order] = np.stack([(state[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1) for p in self.final], axis=1).astype(bool) if self.final else False
        return flags


def url_parts(url: str = "url"):
    """Host and path as columns; both empty for null and for text without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^?#]*)", 1)
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: list[HostRule] = RULES, blocked: list[tuple[str, str]] = BLOCKED) -> DataFrame:
    """id, host, path, rule and verdict of each row of pages; no shuffle.

    Of the rules that fit, the one with the longest host + path counts (of equals, the first); where none
    fits, rule is null and the URL is blocked if one of the `blocked` pairs of globs matches host and
    path, else allowed. The host runs from the first :// to /, ?, # or the end, the path from there to ?, # or
    the end. Null and text without :// have an empty host and path and are allowed unless globs
    match these. Repeated rows come back repeated; other columns are left out; any length.
    """
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    ranked = [rules[i] for i in ranked]

    def run(batches):
        machine = GlobAutomaton([g for r in ranked for g in r.globs] + [glob(*pair) for pair in blocked])
        names = np.array([r.name for r in ranked] + [""], object)
        verdicts = np.array([r.verdict for r in ranked] + ["allow", "block"], object)
        n = len(ranked)
        for batch in batches:
            host, path = (batch.column(c).cast(pa.large_binary()) for c in ("host", "path"))
            flags = machine.match(*text_bytes(pc.binary_join_element_wise(host, path, pa.scalar(MARK, pa.large_binary()))))
            fits = flags[:, : 2 * n].reshape(len(flags), n, 2).any(2)
            which = np.where(fits.any(1), fits.argmax(1), n) if n else np.zeros(len(flags), np.int64)
            bad = flags[:, 2 * n :].any(1)
            rule = pa.array(names[which], pa.string(), mask=which == n)
            verdict = pa.array(verdicts[np.where(which == n, n + bad, which)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), rule, verdict], names=[id_col, "host", "path", "rule", "verdict"])

    host, path = url_parts(url_col)
    source = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    return bounded_batches(source).mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read_table(spark, sf_dir, "pages"))


_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: -len(r.name))
)
_VERDICT = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in RULES)
_LIKE = lambda column, glob: "TRUE" if glob == "*" else f"{column} LIKE '{glob.replace('*', '%')}'"
_BLOCKED = " OR ".join(f"({_LIKE('host', h)} AND {_LIKE('path', p)})" for h, p in BLOCKED)
QUERIES = {"op5_url_filters": op5_url_filters}
ORACLES = {
    "op5_url_filters": f"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path
  FROM r
), f AS (SELECT *, CASE {_FITS} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {_VERDICT} ELSE CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END END AS verdict
FROM f
"""
}
