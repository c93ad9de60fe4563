"""Preference formatting of conversations, with DataFrame functions only.

Turns of a chosen and a rejected conversation are matched place by place. The longest common prefix
is rendered once as the prompt; what follows becomes two completions, each with the spans that a
trainer should learn from: the assistant's turns. All other turns are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

# How a turn is written.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def turn_texts(turns: Column) -> Column:
    """Turns (array of role, text) as they are written, one text each."""
    return F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE)))


def learned_spans(turns: Column, role: str) -> Column:
    """Where the turns of `role` have their text and end mark, as (start, stop) in the joined text."""
    head = lambda t: F.length(F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE)))
    body = lambda t: F.length(F.coalesce(t["text"], F.lit(""))) + len(CLOSE)
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def add(acc, t):
        start = acc["at"] + head(t)
        span = F.struct(start.alias("start"), (start + body(t)).alias("stop"))
        return F.struct((start + body(t)).alias("at"), F.when(t["role"].eqNullSafe(role), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])


def _listed(turns: Column) -> Column:
    """Turns in order, exact repeats once."""
    return F.array_distinct(F.array_sort(F.collect_list(turns)))


def _turn(turn_col: str, role_col: str, text_col: str) -> Column:
    return F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))


def formatted(pairs: DataFrame, learn: str = "assistant") -> DataFrame:
    """(pair_id, c, r), with c and r the turns (turn, role, text) of the chosen and the rejected
    conversation in order, as in preference_pairs()."""
    same = F.zip_with("c", "r", lambda a, b: F.coalesce(a["role"], F.lit("\0")).eqNullSafe(F.coalesce(b["role"], F.lit("\0"))) & a["text"].eqNullSafe(b["text"]) & a["turn"].isNotNull().eqNullSafe(b["turn"].isNotNull()))
    shorter = F.least(F.size("c"), F.size("r"))
    both = pairs.withColumn("n", F.least(shorter, F.coalesce(F.nullif(F.array_position(F.transform(F.slice(same, F.lit(1), shorter), lambda x: x.cast("int")), 0), F.lit(0)) - 1, shorter)).cast("int"))
    after = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    return both.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        F.array_join(turn_texts(F.slice("c", F.lit(1), F.col("n"))), "").alias("prompt"),
        F.array_join(turn_texts(after("c")), "").alias("chosen"),
        F.array_join(turn_texts(after("r")), "").alias("rejected"),
        learned_spans(after("c"), learn).alias("chosen_spans"),
        learned_spans(after("r"), learn).alias("rejected_spans"),
    )


def preference_pairs(turns: DataFrame, pair: Column, side: Column, *, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans; one row for each
    pair that has a chosen and a rejected turn.

    pair: which pair a turn belongs to; side: true in the chosen conversation, false in the rejected
    one (turns with null in either are left out). Turns are ordered by turn, then role and text, and
    exact repeats of a row count once, so the result doesn't depend on the order of rows. Two turns are
    the same if role and text are; null equals null and is written as empty. Where one conversation is
    a prefix of the other, its completion is empty. Spans are character positions in the completion.
    Texts of any length are written whole. A pair's turns are gathered in one row, since a rendered
    conversation is one; different pairs are never brought together, so common turns and conversations
    make no hot group. An empty table gives no rows. Other columns are left out.
    """
    rows = turns.select(pair.alias("pair_id"), side.alias("side"), _turn(turn_col, role_col, text_col).alias("t")).where("pair_id IS NOT NULL AND side IS NOT NULL")
    of = lambda s: _listed(F.when(F.col("side") == F.lit(s), F.col("t")))
    return formatted(rows.groupBy("pair_id").agg(of(True).alias("c"), of(False).alias("r")).where("size(c) > 0 AND size(r) > 0"), learn)


def swapped_answers(turns: DataFrame, conversation: str = "conv_id", *, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", answers: str = "assistant") -> DataFrame:
    """(pair_id, c, r) from conversations without preferences, for formatted(): c is a conversation up to
    its last answer, r the same with the last answer of its partner instead, a wrong one. Conversations
    2k and 2k + 1 are partners; one without an answer, or whose partner has none, makes no pair. Turns are
    ordered and counted as in preference_pairs(); an id that is null or no whole number makes no pair."""
    rows = turns.select(F.col(conversation).try_cast("long").alias("id"), _turn(turn_col, role_col, text_col).alias("t")).where("id IS NOT NULL")
    whole = rows.groupBy("id").agg(_listed(F.col("t")).alias("all"))
    places = F.transform("all", lambda t, i: F.when(t["role"] == answers, i + 1))
    whole = whole.withColumn("at", F.array_max(places)).where("at IS NOT NULL").withColumn("answer", F.element_at("all", F.col("at")))
    theirs = whole.select(F.col("id").bitwiseXOR(F.lit(1)).alias("partner"), F.col("answer.text").alias("wrong"))
    joined = whole.join(theirs, F.col("id") == F.col("partner"))
    before = F.slice("all", F.lit(1), F.col("at") - 1)
    wrong = F.struct(F.col("answer.turn").alias("turn"), F.col("answer.role").alias("role"), F.col("wrong").alias("text"))
    return joined.select(F.col("id").alias("pair_id"), F.slice("all", F.lit(1), F.col("at")).alias("c"), F.concat(before, F.array(wrong)).alias("r"))


def op10_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its partner's last answer: the given ones have no preferences."""
    out = formatted(swapped_answers(read_table(spark, sf_dir, "conversations")))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return out.withColumns({c: written(c) for c in ("chosen_spans", "rejected_spans")})


_TURN = "'<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10)"
_SPANS = "coalesce(string_agg((stop - body) || '-' || stop, ',' ORDER BY place) FILTER (WHERE side = {s} AND place > n AND role = 'assistant'), '')"
_TEXT = "coalesce(string_agg(w, '' ORDER BY place) FILTER (WHERE {c}), '')"
QUERIES = {"op10_preference_formatting": op10_preference_formatting}
ORACLES = {
    "op10_preference_formatting": f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM t),
l AS (SELECT conv_id, max(place) AS last FROM a WHERE role = 'assistant' GROUP BY conv_id),
p AS (
  SELECT l.conv_id AS pair_id, l.last, x.text AS wrong FROM l JOIN l other ON other.conv_id = xor(l.conv_id, 1) JOIN a x ON x.conv_id = other.conv_id AND x.place = other.last
),
o AS (
  SELECT pair_id, TRUE AS side, role, text, place FROM a JOIN p ON conv_id = pair_id AND place <= last
  UNION ALL SELECT pair_id, FALSE, role, CASE WHEN place = last THEN wrong ELSE text END, place FROM a JOIN p ON conv_id = pair_id AND place <= last
),
sizes AS (SELECT pair_id, count(*) FILTER (WHERE side) AS nc, count(*) FILTER (WHERE NOT side) AS nr FROM o GROUP BY pair_id),
differ AS (
  SELECT c.pair_id, min(c.place) AS place FROM o c JOIN o r ON c.pair_id = r.pair_id AND c.place = r.place AND c.side AND NOT r.side
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY c.pair_id
),
n AS (SELECT pair_id, CAST(least(nc, nr, coalesce(place - 1, nc)) AS INTEGER) AS n FROM sizes LEFT JOIN differ USING (pair_id)),
w AS (
  SELECT o.*, n.n, {_TURN} AS w, length(coalesce(text, '')) + 9 AS body,
    sum(CASE WHEN place > n THEN length({_TURN}) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY place) AS stop
  FROM o JOIN n USING (pair_id)
)
SELECT pair_id, any_value(n) AS n_prompt_turns, {_TEXT.format(c="side AND place <= n")} AS prompt,
  {_TEXT.format(c="side AND place > n")} AS chosen, {_TEXT.format(c="NOT side AND place > n")} AS rejected,
  {_SPANS.format(s="TRUE")} AS chosen_spans, {_SPANS.format(s="FALSE")} AS rejected_spans
FROM w GROUP BY pair_id
"""
}
