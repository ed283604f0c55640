r"""Operator 1: multi-party perspective rotation of conversations.

Every participant of a conversation (any role but ``system``) gets a rendering of its own: that speaker is the
assistant, everyone else is a named user, system turns stay system turns.  The mask lists the spans (code points,
start-end, end exclusive) of the assistant's contents with their end marks: the only text to train on.

A rendering is cut every ``CHUNK`` turns, so that a row holds a bounded number of turns however long a conversation is.
``start`` is where the row's text begins in the whole rendering: the chunks of a speaker, joined in order, are one text,
and their spans plus ``start`` its mask.  Turns are ranked by one global sort and prefix counts of its partitions, so a
conversation (or turn number) that holds most of the rows is spread like any other.  Everything is built-in functions.

Contents escape the marks (backslash before ``<|`` and before a backslash), names also ``|>`` and line ends, so a
rendering can be parsed back.  Defined results: a null role is the participant ``unknown``, a null text is empty, rows of
null conv_id are one conversation, rows of null turn come first; turns that tie are ordered by role and text; a
conversation of system turns only, or an empty table, gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stages

CHUNK = 512


def ranked(turns: DataFrame) -> DataFrame:
    """conv_id, role, text (escaped) and n, the turn's place in its conversation from 0."""
    stages = Stages(turns.sparkSession, "chat")
    t = turns.selectExpr("conv_id", "turn", "coalesce(role, 'unknown') as role", r"replace(replace(coalesce(text, ''), '\\', '\\\\'), '<|', '\\<|') as text")
    order = ["conv_id", "turn", "role", "text", "row"]  # equal rows may be cut anywhere
    t = t.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    t = stages.write(t.withColumn("pos", F.monotonically_increasing_id()).select("conv_id", "role", "text", "pos", F.shiftright("pos", 33).alias("part")))
    runs = t.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
    runs = runs.select("c", "p", (F.col("first") - before).alias("zero"))
    return t.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv_id", "role", "text", (F.col("pos") - F.col("zero")).alias("n"))


def rotate(turns: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """conv_id, speaker, chunk, n_turns, start, text, mask: one row per participant and chunk of each conversation."""
    stages = Stages(turns.sparkSession, "rotated")
    t = stages.write(ranked(turns).withColumn("chunk", F.floor(F.col("n") / chunk)))
    parts = t.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("turns"))
    who = t.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    rows = parts.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    name = r"replace(replace(replace(replace(t.role, '\\', '\\\\'), '<|', '\\<|'), '|>', '\\|>'), '\n', '\\n')"
    rows = rows.withColumn("heads", F.expr(rf"transform(turns, t -> case when t.role = speaker then '<|assistant|>\n' when t.role = 'system' then '<|system|>\n' else concat('<|user name=', {name}, '|>\n') end)"))
    rows = rows.withColumn("bodies", F.expr(r"transform(turns, t -> concat(t.text, '<|end|>\n'))"))
    mask = F.expr("""aggregate(sequence(0, size(turns) - 1), named_struct('at', 0L, 'spans', cast(array() as array<string>)),
        (a, i) -> named_struct('at', a.at + length(heads[i]) + length(bodies[i]), 'spans', if(turns[i].role = speaker,
            array_append(a.spans, concat(cast(a.at + length(heads[i]) as string), '-', cast(a.at + length(heads[i]) + length(bodies[i]) - 1 as string))), a.spans)),
        a -> array_join(a.spans, ','))""")
    rows = stages.write(rows.select("conv_id", "speaker", "chunk", F.size("turns").cast("bigint").alias("n_turns"), F.array_join(F.zip_with("heads", "bodies", lambda a, b: F.concat(a, b)), "").alias("text"), mask.alias("mask")))
    w = Window.partitionBy("c", "s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("chunk").alias("k"), F.length("text").cast("bigint").alias("size"))
    starts = starts.withColumn("start", F.sum("size").over(w)).where("k > 0").drop("size")
    out = rows.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("chunk") == F.col("k")), "left")
    return out.select("conv_id", "speaker", "chunk", "n_turns", F.coalesce("start", F.lit(0)).cast("bigint").alias("start"), "text", "mask")


#: The same for DuckDB (``conversations`` is the table).
SQL = r"""
with r as (
  select conv_id, coalesce(role, 'unknown') as role, replace(replace(coalesce(text, ''), '\', '\\'), '<|', '\<|') as text, turn from conversations),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as n from r),
who as (select distinct conv_id, role as speaker from t where role <> 'system'),
s as (
  select t.conv_id, w.speaker, t.n // 512 as chunk, t.n, t.role,
         case when t.role = w.speaker then '<|assistant|>' when t.role = 'system' then '<|system|>'
              else '<|user name=' || replace(replace(replace(replace(t.role, '\', '\\'), '<|', '\<|'), '|>', '\|>'), chr(10), '\n') || '|>' end || chr(10) as head,
         t.text || '<|end|>' || chr(10) as body
  from t join who w on t.conv_id is not distinct from w.conv_id),
o as (
  select *, sum(length(head) + length(body)) over (partition by conv_id, speaker, chunk order by n rows unbounded preceding) as stop from s),
g as (
  select conv_id, speaker, chunk, count(*) as n_turns, string_agg(head || body, '' order by n) as text,
         coalesce(string_agg(cast(stop - length(body) as varchar) || '-' || cast(stop - 1 as varchar), ',' order by n) filter (where role = speaker), '') as mask
  from o group by conv_id, speaker, chunk)
select conv_id, speaker, chunk, n_turns, cast(coalesce(sum(length(text)) over (partition by conv_id, speaker order by chunk rows between unbounded preceding and 1 preceding), 0) as bigint) as start, text, mask
from g
"""
