"""Source divergence audit: how far the word use of each source is from the other sources of its language.

Plain relational: matches of the term pattern are exploded and counted by language, source and term; terms in at least
``least`` documents of a language are its vocabulary; groups (lang, source) are crossed with their language's vocabulary, so
that absent terms count zero; a self-join on lang and term compares sources; sums and a ranking window close it.

The exploded rows carry whether a term is new in its document, so one aggregation, combined before the shuffle, gives both
occurrences and documents, and a hot source or a frequent word costs one row per task.  Languages are few and may hold most
rows, so nothing is dealt by language alone: groups and vocabularies meet in a join whose smaller side, the groups, is
broadcast if it is small, and every other join is by (lang, source, term) or (lang, term).

Smoothed shares are integers: p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in decimals of 38 digits, exact for up to 10^19
occurrences.  Defined results: null text, lang and source count as empty; groups without terms appear; a language without
vocabulary has pairs of value 0 and no terms; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import Stages
from .shared import small

LEAST, TOP = 30, 50
#: The characters between terms, the ASCII ones that are no letters.  Splitting there gives the matches of the
#: complement; Spark's ``regexp_extract_all`` copies the whole text for every match, which is quadratic in long texts.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def source_divergence(docs: DataFrame, *, text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank (see the module's text)."""
    stages = Stages(docs.sparkSession, "divergence")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    terms = F.split(F.translate(empty(text_col), UPPER, UPPER.lower()), BETWEEN)
    rows = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), terms.alias("terms"))
    rows = rows.select(F.struct("lang", "source").alias("g"), "terms")
    # every occurrence once, and every term of a document once more
    both = rows.select("g", F.explode_outer(F.array(F.struct(F.col("terms").alias("t"), F.lit(1).alias("c")), F.struct(F.array_distinct("terms").alias("t"), F.lit(0).alias("c")))).alias("x"))
    each = both.select("g", F.explode_outer("x.t").alias("term"), F.col("x.c").alias("c"))
    counts = each.groupBy("g", "term").agg(F.sum("c").alias("count"), F.sum(1 - F.col("c")).alias("docs"))
    # the empty string stands before a first and after a last separator
    counts = stages.write(counts.select("g.*", F.nullif("term", F.lit("")).alias("term"), "count", "docs"))
    groups = counts.select("lang", "source").distinct()
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all")).where(F.col("docs") >= least).select("lang", "term", "all")
    kept = stages.write(kept)
    totals = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("n_all"))

    def share(count: str, n: str):
        return F.expr(f"1 + cast(1000000000 * cast({count} + 5 as decimal(19, 0)) as decimal(38, 0)) div cast({n} + 5 * v as decimal(38, 0))")

    some = stages.write(counts.select("lang", "source", "term", "count").join(kept.select("lang", "term"), ["lang", "term"]))
    sums = some.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = stages.write(groups.join(sums, ["lang", "source"], "left").join(totals, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "v", "n_all"))
    dense = kept.join(small(groups), "lang").join(some, ["lang", "source", "term"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    p = stages.write(dense.select("lang", "source", "term", "count", share("count", "n").alias("p"), share("all", "n_all").alias("q")))
    groups = groups.select("lang", "source")
    one, two = p.select("lang", "term", "source", "p"), p.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    far = one.join(two, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    far = stages.write(far)
    far = far.union(far.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item").join(far, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    over = p.where("count > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(over.withColumn("rank", rank).where(F.col("rank") <= top))


#: The same for DuckDB (``documents`` is the table).
SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
e as (select id, lang, source, unnest(terms) as term from d),
c as (select lang, source, term, count(*) as n from e group by all),
k as (select lang, term from e group by all having count(distinct id) >= 30),
v as (select g.lang, count(k.term) as v from (select distinct lang from d) g left join k on k.lang = g.lang group by g.lang),
g as (select distinct lang, source from d),
dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
whole as (select lang, term, sum(n) as n from dense group by all),
p as (
  select lang, source, term, n, 1 + (1000000000 * (n::hugeint + 5)) // (sum(n) over (partition by lang, source) + 5 * v)::hugeint as p from dense join v using (lang)),
q as (select lang, term, 1 + (1000000000 * (n::hugeint + 5)) // (sum(n) over (partition by lang) + 5 * v)::hugeint as q from whole join v using (lang)),
far as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(far.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join far on far.lang = a.lang and far.source = a.source and far.item = b.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from p join q using (lang, term) where n > 0 and p > q),
s as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from r)
select lang, source, part, item, value, rank from s where part = 'pair' or rank <= 50
"""
