"""Joins on interval predicates, planned as equi-joins on (partition key, level, bin).

Spark would compare all rows of a chromosome with each other; with a bin of the position as a further
key, rows meet only near each other, and a dense bin is one that adaptive execution can split. Bins are
nested: a level's are twice as wide as those of the one below. An interval stands in the bins of the lowest level whose
width exceeds its length, two at most, and looks at each higher level that the other side's intervals stand
in, two bins there at most. So an interval makes a few rows for each level in use, however long it is, and
two intervals meet at the level of the longer one. The exact predicate always remains, so widths decide the
cost and never the result. Rows with a null bound or partition key match nothing.

Where pairs are wanted, the right rows of a bin come in chunks that are in order of position. An interval is first held
against the bounds of a chunk, and only rows of chunks that it reaches are taken out and tested, so that few
pairs are looked at that aren't wanted. The join is never a broadcast, because it would run in as few tasks as the left
table has blocks, however many pairs there are. Pairs come chunk by chunk: for each left row that reaches a chunk, its rows in
the same order. So the pairs of a written file are runs of a left row beside a sequence that repeats, which take a fraction
of the room that they take in order of the left rows; and a task has few enough rows of each side for a file's dictionaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: kind: (a starts before b's end, b starts before a's end), for rows a of the left and b of the right.
KINDS = ("half_open", "closed", "contained")
#: Right rows of a bin that are one row of the join.
CHUNK = 128
#: So many rows of both sides are a task of the join, and so many rows of a side in a bin are taken as one; a bin of more is dealt out.
BLOCK = 32_768


def level_of(low: Column, high: Column, width: int) -> Column:
    """The lowest level whose bins, width * 2 ** level, are wider than the interval is long."""
    q = F.floor((high - low) / F.lit(width)).cast("long")
    return F.when(q < 1, 0).otherwise(F.length(F.bin(q))).cast("int")


def _bin(position: Column, level: Column, width: float) -> Column:
    return F.floor(position / (F.lit(width) * F.call_function("shiftleft", F.lit(1).cast("long"), level))).cast("long")


def _levels(rows: DataFrame, level: Column) -> Column:
    """The levels that rows stand in, found in the same job: a short array."""
    return F.coalesce(rows.select(F.collect_set(level)).scalar(), F.array().cast("array<int>"))


def _places(levels: Column, low: Column, high: Column, width: int, side: str) -> Column:
    """The bins between two positions at each of the levels, as (side, level, bin)."""
    at = lambda level: F.transform(F.sequence(_bin(low, level, width), _bin(high, level, width)), lambda b: F.struct(F.lit(side).alias("side"), level.alias("level"), b.alias("bin")))
    return F.flatten(F.transform(levels, at))


def overlap_join(left: DataFrame, right: DataFrame, *, kind: str = "half_open", by: str = "chrom", start: str = "start", end: str = "end", width: int = 10_000, suffix: str = "_r") -> DataFrame:
    """All pairs of a left and a right row with the same `by` whose intervals meet, with all columns of
    both; the right's `by` is left out, its other columns get `suffix` where the left has their name.

    kind half_open: a.start < b.end and b.start < a.end; closed: <= in both; contained: b lies within a.
    Each pair comes once: at the level of the longer interval, in the bin of the later of the two starts.
    """
    if kind not in KINDS:
        raise ValueError(kind)
    renamed = {c: c + suffix if c in left.columns else c for c in right.columns if c != by}
    b = right.select(F.col(by).alias("_by"), *(F.col(c).alias(n) for c, n in renamed.items())).where(F.col("_by").isNotNull() & F.col(renamed[start]).isNotNull() & F.col(renamed[end]).isNotNull())
    a = left.where(F.col(by).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    a_start, a_end, b_start, b_end = F.col(start), F.col(end), F.col(renamed[start]), F.col(renamed[end])
    a_low, a_high, b_low, b_high = F.least(a_start, a_end), F.greatest(a_start, a_end), F.least(b_start, b_end), F.greatest(b_start, b_end)
    a_level, b_level = level_of(a_low, a_high, width), level_of(b_low, b_high, width)
    # Side 0 are the bins of a level of the left, for pairs whose left row is as long as the right one or longer; side 1 those of the right.
    if kind == "contained":  # b isn't longer, and its start says where the pair is made
        at_least = F.when(b_end >= b_start, b_level).otherwise(0)
        a, plain_a = _cells(a, F.array(_side(0, a_level)), F.lit(True), a_low, a_high, width, "_cell", "_starts"), a
        b = _cells(b, _sides(plain_a, a_level, 0), F.col("_at.level") >= at_least, b_start, b_start, width, "_cell_r", "_starts_r")
        test = (b_start >= a_start) & (b_end <= a_end)
    else:
        longer = (F.col("_at.side") == 0) | (F.col("_at.level") > a_level)
        a, plain_a = _cells(a, F.concat(F.array(_side(0, a_level)), _sides(b, b_level, 1)), longer, a_low, a_high, width, "_cell", "_starts"), a
        any_shorter = F.array_min(_levels(plain_a, a_level)) < b_level
        as_long = F.when(F.col("_at.side") == 0, F.col("_at.level") >= b_level).otherwise(any_shorter)
        b = _cells(b, F.concat(_sides(plain_a, a_level, 0), F.array(_side(1, b_level))), as_long, b_low, b_high, width, "_cell_r", "_starts_r")
        test = (a_start < b_end) & (b_start < a_end) if kind == "half_open" else (a_start <= b_end) & (b_start <= a_end)
        test &= F.col("_starts") | F.col("_starts_r")  # the bin of the later start is the first of one of them
    tasks, crowds = _crowds(a, b, by)
    b = _chunks(b, [*renamed.values(), "_starts_r"], b_low, b_high, width, fixed=bool(crowds))
    same = {"_cell": "_cell_r", by: "_by"}
    if crowds:
        a, b = _dealt(a, b, left.columns, by, crowds)
        same["_deal"] = "_deal_r"
    reached = (a_low <= F.col("_high_r")) & (F.col("_low_r") <= a_high)
    for x, y in same.items():
        reached &= F.col(x) == F.col(y)
    # The chunks come first: they are gone through one by one, with the left rows of their bin that hold them whole, then with the others.
    whole = (a_low <= F.col("_low_r")) & (F.col("_high_r") <= a_high)
    b = b.repartition(tasks, *same.values()).withColumn("_whole", F.explode(F.array(F.lit(True), F.lit(False))))
    met = b.hint("merge").join(a.repartition(tasks, *same), reached & (F.col("_whole") == whole))
    return met.select(*left.columns, "_starts", F.inline("_rows")).where(test).select(*left.columns, *renamed.values())


def _side(side: int, level: Column) -> Column:
    return F.struct(F.lit(side).alias("side"), level.alias("level"))


def _sides(rows: DataFrame, level: Column, side: int) -> Column:
    """The levels that rows stand in, each with the side that they are of."""
    return F.coalesce(rows.select(F.collect_set(_side(side, level))).scalar(), F.array().cast("array<struct<side: int, level: int>>"))


def _cells(rows: DataFrame, places: Column, kept: Column, low: Column, high: Column, width: int, cell: str, starts: str) -> DataFrame:
    """rows, once for each bin from `low` to `high` of those places that are kept: its number, and whether it is the first."""
    level, first = F.col("_at.level"), F.col("_first")
    rows = rows.withColumn("_at", F.explode(places)).where(kept).withColumn("_first", _bin(low, level, width))
    rows = rows.withColumn("_bin", F.explode(F.sequence(first, _bin(high, level, width))))
    number = F.col("_bin") * 128 + level * 2 + F.col("_at.side")
    return rows.withColumns({cell: number, starts: F.col("_bin") == first})


def _hash(rows: DataFrame, columns: list[str]) -> Column:
    return F.xxhash64(*(c for c in columns if "map<" not in rows.schema[c].dataType.simpleString()))


def _chunks(rows: DataFrame, columns: list[str], low: Column, high: Column, width: int, *, fixed: bool = False) -> DataFrame:
    """(_by, _cell_r, _low_r, _high_r, _rows): rows of the same bin as arrays of `CHUNK` at most, with their bounds. A
    bin is put in order in 16 parts, by different tasks. fixed: a task that is run again makes the same chunks, which matters where
    the chunks of a bin go to several tasks."""
    part, order = _bin(low, F.col("_at.level"), width / 16), ["_low_r"]
    if fixed:
        rows, order = rows.withColumn("_hash", _hash(rows, columns)), ["_low_r", "_hash"]
    rows = rows.select("_by", "_cell_r", part.alias("_part"), low.alias("_low_r"), high.alias("_high_r"), F.struct(*columns).alias("_row"), *order[1:])
    place = F.row_number().over(Window.partitionBy("_part", "_cell_r", "_by").orderBy(*order))
    chunks = rows.withColumn("_chunk", F.floor((place - 1) / CHUNK)).groupBy("_part", "_cell_r", "_by", "_chunk")
    return chunks.agg(F.min("_low_r").alias("_low_r"), F.max("_high_r").alias("_high_r"), F.collect_list("_row").alias("_rows"))


def _crowds(a: DataFrame, b: DataFrame, by: str) -> tuple[int, list[tuple]]:
    """The number of tasks for the join, and (bin, by, deals of a, deals of b) of the bins with more than `BLOCK` rows of a
    side. These are counted first; there are no more such bins than blocks of rows."""
    side = lambda rows, cell, by, n: rows.select(F.lit(n).alias("side"), F.col(cell).alias("cell"), F.col(by).alias("by"))
    counts = side(a, "_cell", by, 0).union(side(b, "_cell_r", "_by", 1)).groupBy("side", "cell", "by").count()
    crowd = F.when(F.col("count") > BLOCK, F.struct("cell", "by", "side", F.ceil(F.col("count") / BLOCK).cast("int")))
    rows, large = counts.agg(F.sum("count"), F.collect_list(crowd)).first()
    deals: dict[tuple, list[int]] = {}
    for cell, of, at, n in large:
        deals.setdefault((cell, of), [1, 1])[at] = n
    tasks = max(-(-(rows or 0) // BLOCK), sum(m * n for m, n in deals.values()), 1)
    return tasks, [(*key, *n) for key, n in deals.items()]


def _dealt(a: DataFrame, b: DataFrame, columns: list[str], by: str, crowds: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Both with a number of their deal, `_deal` and `_deal_r`. In a crowded bin the rows of a and the chunks of b are dealt out, and each
    deal of the one meets each of the other once."""
    schema = f"_crowd long, _of {a.schema[by].dataType.simpleString()}, _m int, _n int"
    known = F.broadcast(a.sparkSession.createDataFrame(crowds, schema))
    in_crowd = lambda rows, cell, by: rows.join(known, (F.col(cell) == F.col("_crowd")) & (F.col(by) == F.col("_of")), "left").withColumns({"_m": F.coalesce("_m", F.lit(1)), "_n": F.coalesce("_n", F.lit(1))}).drop("_crowd", "_of")
    own = F.pmod(_hash(a, columns), F.col("_m")) * F.col("_n")
    a = in_crowd(a, "_cell", by).withColumn("_deal", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: (own + x).cast("int"))))
    chunk = F.pmod(F.xxhash64("_part", "_chunk"), F.col("_n"))
    b = in_crowd(b, "_cell_r", "_by").withColumn("_deal_r", F.explode(F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda x: (x * F.col("_n") + chunk).cast("int"))))
    return a.drop("_m", "_n"), b.drop("_m", "_n")


def window_join(left: DataFrame, right: DataFrame, low: Column, high: Column, position: str, *, by: str = "chrom", width: int = 1_000, suffix: str = "_r") -> DataFrame:
    """All pairs where the right's `position` lies between `low` and `high` (columns of the left), both
    included. A window stands in the bins of its level, a position looks at each level in use."""
    renamed = {c: c + suffix if c in left.columns else c for c in right.columns if c != by}
    b = right.select(F.col(by).alias("_by"), *(F.col(c).alias(n) for c, n in renamed.items()))
    a = left.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    level = level_of(F.col("_low"), F.col("_high"), width)
    at = F.col(renamed[position])
    b = b.where(at.isNotNull()).withColumn("_levels", _levels(a, level))
    b = b.withColumn("_at_r", F.explode(_places(F.col("_levels"), at, at, width, "left")))
    a = a.withColumn("_at", F.explode(_places(F.array(level), F.col("_low"), F.col("_high"), width, "left")))
    same = (F.col("_at.level") == F.col("_at_r.level")) & (F.col("_at.bin") == F.col("_at_r.bin"))
    return a.join(b, (F.col(by) == F.col("_by")) & same & at.between(F.col("_low"), F.col("_high"))).drop("_by", "_at", "_at_r", "_levels", "_low", "_high")


def furthest_ends(left: DataFrame, right: DataFrame, ends: dict[str, Column], *, kind: str = "closed", by: str = "chrom", start: str = "start", end: str = "end", width: int = 10_000) -> DataFrame:
    """left with a column for each of `ends` (expressions over the right): the furthest among the right rows that start
    before the left row ends (or there, if closed); null without any. A left row meets one of those exactly if
    the furthest isn't before its own start. No pairs are made: both sides are put in order of position, and a running
    maximum is taken in pieces of `width`, each of which goes on from the pieces before it."""
    known = lambda rows: rows.where(F.col(by).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    a = known(left).select(F.struct(*left.columns).alias("_row"), F.col(by).alias("_by"), F.col(end).alias("_at"), F.lit(1 if kind == "closed" else -1).alias("_turn"))
    b = known(right).select(F.col(by).alias("_by"), F.col(start).alias("_at"), F.lit(0).alias("_turn"), *(e.alias(n) for n, e in ends.items()))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_piece", F.floor(F.col("_at") / width).cast("long"))
    here = Window.partitionBy("_by", "_piece").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_of").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = both.groupBy(F.col("_by").alias("_of"), F.col("_piece").alias("_p")).agg(*(F.max(n).alias(n) for n in ends))
    pieces = pieces.select("_of", "_p", *(F.max(n).over(before).alias(f"_{n}") for n in ends))
    running = both.select("_row", "_by", "_piece", *(F.max(n).over(here).alias(n) for n in ends)).where("_row IS NOT NULL")
    joined = running.join(pieces, (F.col("_by") == F.col("_of")) & (F.col("_piece") == F.col("_p")))
    return joined.select("_row.*", *(F.greatest(n, f"_{n}").alias(n) for n in ends))


def best_overlaps(left: DataFrame, right: DataFrame, best: Column, *, key: str, by: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """(key, best): for each key of the left, the largest `best` (an expression over the right) of the right rows that meet
    one of its rows (closed). Rows that end before they start meet nothing. No pairs are made.

    A right row meets a left one if it starts within it or covers its start. A range of n positions has, in blocks of
    the largest power of two up to n, the end of one block, the start of another and perhaps a whole one between
    them. So running maxima of blocks, up and down, tell the largest of the starts within a left row, and of the right
    rows over a position. Each row makes a few rows for each level (power of two) of the other side."""
    low, high = F.col(start).cast("long"), F.col(end).cast("long")
    known = lambda rows: rows.where(F.col(by).isNotNull() & (F.col(start) <= F.col(end)))
    a = known(left).select(F.col(key).alias("_key"), F.col(by).alias("_by"), low.alias("_low"), high.alias("_high"), F.lit(1).alias("_turn"))
    b = known(right).select(best.alias("_best"), F.col(by).alias("_by"), low.alias("_low"), high.alias("_high"), F.lit(0).alias("_turn"))
    low, high = F.col("_low"), F.col("_high")
    level = (F.length(F.bin(high - low + 1)) - 1).cast("int")
    block = lambda position, level: F.call_function("shiftright", position, level)
    first, last = block(low, level), block(high, level)

    def place(part, position, level, down):
        return F.struct(F.lit(part).alias("part"), level.alias("level"), block(position, level).alias("block"), F.lit(down).alias("down"), (-position if down else position).alias("position"))

    def of_range(part, up, whole, down):
        return F.array_compact(F.array(place(part, up, level, False), F.when(first + 1 < last, place(part, whole, level, False)), F.when(first < last, place(part, down, level, True))))

    def of_point(part, levels):
        return F.flatten(F.transform(levels, lambda x: F.array(place(part, low, x, False), place(part, low, x, True))))

    begin_of = lambda n: F.call_function("shiftleft", n, level)
    asked = a.withColumn("_levels", _levels(b, level)).select("_key", "_by", "_turn", F.explode(F.concat(of_range("within", high, begin_of(first + 2) - 1, low), of_point("over", F.col("_levels")))).alias("_at"))
    given = b.withColumn("_levels", _levels(a, level)).select("_best", "_by", "_turn", F.explode(F.concat(of_range("over", low, begin_of(first + 1), high), of_point("within", F.col("_levels")))).alias("_at"))
    order = Window.partitionBy("_by", "_at.part", "_at.level", "_at.block", "_at.down").orderBy("_at.position", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    running = asked.unionByName(given, allowMissingColumns=True).select("_key", "_turn", F.max("_best").over(order).alias("best"))
    return running.where("_turn = 1 AND best IS NOT NULL").groupBy(F.col("_key").alias(key)).agg(F.max("best").alias("best"))


def has_overlap(left: DataFrame, right: DataFrame, *, key: str, kind: str = "closed", by: str = "chrom", start: str = "start", end: str = "end", width: int = 10_000) -> DataFrame:
    """Keys of left rows that meet any right row."""
    a, b = left.select(key, by, start, end), right.select(by, start, end)
    if kind == "contained":
        return overlap_join(a, b, kind=kind, by=by, start=start, end=end, width=width).select(key).distinct()
    reach = F.col("_reach") >= F.col(start) if kind == "closed" else F.col("_reach") > F.col(start)
    return furthest_ends(a, b, {"_reach": F.col(end)}, kind=kind, by=by, start=start, end=end, width=width).where(reach).select(key).distinct()


def contained_in(rows: DataFrame, regions: DataFrame, *, by: str = "chrom", start: str = "start", end: str = "end", width: int = 10_000) -> DataFrame:
    """Rows that lie within one of the regions; each once, as it is."""
    r = regions.select(F.col(by).alias("_by"), F.col(start).alias("_from"), F.col(end).alias("_to")).where("_from <= _to")
    level = level_of(F.col("_from"), F.col("_to"), width)
    numbered = rows.withColumns({"_row": F.monotonically_increasing_id(), "_levels": _levels(r, level)})
    r = r.withColumn("_at_r", F.explode(_places(F.array(level), F.col("_from"), F.col("_to"), width, "left")))
    looks = numbered.where(F.col(start).isNotNull()).withColumn("_at", F.explode(_places(F.col("_levels"), F.col(start), F.col(start), width, "left")))
    same = (F.col("_at.level") == F.col("_at_r.level")) & (F.col("_at.bin") == F.col("_at_r.bin"))
    inside = (F.col(start) >= F.col("_from")) & (F.col(end) <= F.col("_to"))
    found = looks.join(r, (F.col(by) == F.col("_by")) & same & inside, "left_semi").drop("_at", "_levels")
    return found.dropDuplicates(["_row"]).drop("_row")  # a row that lies in regions of several levels
