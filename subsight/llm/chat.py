"""Chat formatting (operator 10): budgeted, turn-aligned windows, in DataFrame functions only.

A prefix sum of turn tokens lays a conversation's turns on a line that is marked every ``step`` tokens:
the budget less the system turn's tokens. The turns that lie between two marks are a window; a turn
across a mark is a window of its own. So a window's system turn and new turns keep to the budget,
unless the one new turn is too long for it: that turn stays whole, as a window that is over the
budget. What is left of the budget takes up to ``history`` turns from before the window, the nearest
first. Only new assistant turns are targets, so a repeated target is masked. A turn is written as

    <s>role[INST]text[/INST]</s>

with ``~``, ``<`` and ``[`` inside role and text written as ``~0``, ``~1`` and ``~2``: a text can
then hold no control string, and reading back is exact.

Every turn costs at least ``TURN_COST`` tokens, so a window holds a bounded number of new turns
and no conversation, however long, is collected into one row while it is formatted. Reading a
conversation back as one digest needs its whole text in one row, as the result itself asks.

Cases: a null text or role is empty; turns with equal numbers are ordered by role, then text
(null turn numbers first), repeated rows are turns of their own; a null conv_id is one
conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words

# Control strings of the template and the escapes of their first characters.
TURN, TEXT, TEXT_END, TURN_END = "<s>", "[INST]", "[/INST]", "</s>"
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
TURN_COST = 4  # tokens of a turn's control strings
BUDGET = 512
HISTORY = 2


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, text, n_repeated (leading turns that repeat earlier
    ones) and loss (spans of the text under the mask: start, length in code points)."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", count_words(F.col("text")) + TURN_COST)
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("pos", F.row_number().over(in_order))
    first = (F.col("pos") == 1) & (F.col("role") == "system")
    # the system turn is in every window: its tokens are off the budget, not on the line
    t = t.withColumns({"size": F.when(first, 0).otherwise(F.col("tokens")),
                       "step": F.greatest(F.lit(budget) - F.first(F.when(first, F.col("tokens")).otherwise(0)).over(in_order), F.lit(1))})
    t = t.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    mark = F.floor(F.col("start") / F.col("step"))
    across = F.col("start") + F.col("size") > (mark + 1) * F.col("step")
    t = t.withColumn("window", (2 * mark + across.cast("int")).cast("long"))
    t = t.withColumn("used", F.sum("size").over(Window.partitionBy("conv_id", "window")))
    # the windows that repeat this turn as history: those that begin k turns later, if these k turns fit
    ahead = lambda c, k: F.lead(c, k).over(in_order)
    repeats = [F.when((ahead("window", k) != (F.col("window") if k == 1 else ahead("window", k - 1)))
                      & (ahead("start", k) - F.col("start") + ahead("used", k) <= F.col("step")) & ~first, ahead("window", k))
               for k in range(1, history + 1)]
    t = t.withColumn("later", F.array_compact(F.array(*repeats).cast("array<bigint>")))
    t = t.withColumn("body", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")),
                                      F.lit(TEXT_END + TURN_END)))
    t = t.withColumn("lead", F.length(escape(F.col("role"))) + len(TURN) + len(TEXT))
    t = t.withColumn("target", F.col("role") == "assistant")
    cols = ["conv_id", "pos", "body", "lead", "target"]
    placed = t.select(*cols, F.explode(F.concat(
        F.array(F.struct(F.col("window"), F.lit(True).alias("new"))),
        F.transform("later", lambda w: F.struct(w.alias("window"), F.lit(False).alias("new"))))).alias("at"))
    placed = placed.select(*cols, "at.window", "at.new")
    # a leading system turn stays in every window
    system = t.filter((F.col("pos") == 1) & (F.col("role") == "system")).select(*cols)
    where = t.select(F.col("conv_id").alias("c"), F.col("window").alias("w")).distinct()
    kept = (system.join(where, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("w") > 0))
            .select(*cols, F.col("w").alias("window"), F.lit(False).alias("new")))
    rows = placed.unionByName(kept).groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("pos", "body", "lead", "target", "new"))).alias("rows"))
    spans = F.aggregate(
        "rows", F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r["body"])).alias("at"),
            F.when(r["target"] & r["new"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + r["lead"]).alias("start"),
                (F.length(r["body"]) - r["lead"] - len(TEXT_END + TURN_END)).alias("length")))))
            .otherwise(acc["spans"]).alias("spans")))
    return rows.select(
        "conv_id", "window", F.array_join(F.transform("rows", lambda r: r["body"]), "").alias("text"),
        F.size(F.filter("rows", lambda r: ~r["new"])).alias("n_repeated"), spans["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window: its new turns (role, text) parsed from the formatted text, and the unescaped
    texts under the loss mask."""
    pieces = F.split("text", TURN_END)  # the last piece is what follows the last end: nothing
    turn = F.transform(F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated")), lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(TURN) + 1, F.length(p)), TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, TEXT, -1), TEXT_END, 1)).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "window", F.length("text").cast("long").alias("chars"),
                            turn.alias("turns"), loss.alias("loss_texts"))


def digests(read: DataFrame) -> DataFrame:
    """Per conversation: the digests of all turns and of all text under the loss mask."""
    row = read.select(
        "conv_id", "window", "chars", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join("loss_texts", "").alias("loss"))
    g = row.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sum(F.length("loss")).cast("long").alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("window", "all", "loss"))).alias("ws"))
    joined = lambda c: F.array_join(F.transform("ws", lambda w: w[c]), "")
    return g.select("conv_id", "n_turns", F.sha2(joined("all"), 256).alias("turns_sha256"), "loss_chars",
                    F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars")


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    from .common import read

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(read_back(windows(turns.unionByName(own))))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER o AS pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
        3 + length(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2')) + 6
          + length(replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2')) + 11 AS chars
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, pos = 1 AND role = 'system' AS sys, CASE WHEN sys THEN 0 ELSE tokens END AS size,
        greatest(512 - max(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id), 1) AS step FROM n),
l AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s),
p AS (SELECT *, 2 * (start // step) + (start + size > (start // step + 1) * step)::INT AS w FROM l),
u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, w) AS used FROM p),
q AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(start, 1) OVER o - start + lead(used, 1) OVER o AS need1,
        lead(start, 2) OVER o - start + lead(used, 2) OVER o AS need2 FROM u
      WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
nw AS (SELECT conv_id, count(DISTINCT w) AS n_windows FROM p GROUP BY conv_id),
r AS (SELECT q.*, CASE WHEN sys THEN n_windows
        ELSE 1 + coalesce(w1 <> w AND need1 <= step, false)::INT + coalesce(w2 <> w1 AND need2 <= step, false)::INT END AS times
      FROM q JOIN nw ON q.conv_id IS NOT DISTINCT FROM nw.conv_id)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars * times)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""
