"""Mixing sources to target weights by Pareto order sampling (operator 3).

Each document of a source is wanted target / size times.  The whole part of that goes to every
document; its fraction is the inclusion probability p of one more copy.  Documents are ranked
by Pareto's q = u / (1 - u) * (1 - p) / p, with a uniform u from the document's id, and those
of the lowest q are taken until the source's words come as near to its target as a whole
document allows.

Ranks are found without a window over a source: a histogram of u by source gives the words
before each of its bins, and a window orders the documents within a bin only.  Sources that need
no more copies (p = 0) aren't ranked.

Cases: null or empty text has size 0 and gives 0 words; a null source is a source, the last;
rows that repeat a doc_id are ranked one after another by text size; an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablespan.llm.common import WORD, stored

#: Bins of the histogram of u in each source.
BINS = 4096


def words_in(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from 52 bits of the id's MD5."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """source_key, source_size and target of each source.

    Sources in code-point order of their names (null last) take the weights in turn and share
    share[0] / share[1] of all words; none gets over most times its size, and what it would
    get beyond goes to the others by weight.  With t words for each unit of weight a source gets
    least(cap, weight * t); sources fill up in ascending order of cap / weight, so t follows
    from how many of them are full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").isNull(), F.col("source"))  # a row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * (share[0] / share[1]) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left / rest
    # The level with which the first source that isn't full leaves off; all full: none is needed.
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("t")))).over(every)["t"]
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * level), F.col("cap").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def binned(wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """The rows of wanted that are ranked, with q and bin. q ascends with u, as p is the same in all rows of a
    source; bins of u hold about equally many rows whatever p is."""
    u = uniform(F.col("doc_id"))
    q = F.when(F.col("p") > 0, u / (1 - u) * ((1 - F.col("p")) / F.col("p")))
    return wanted.filter("p > 0").withColumn("q", q).withColumn("bin", F.floor(u * bins).cast("int"))


def pareto_take(wanted: DataFrame, by: str, bins: int = BINS, ties: tuple[str, ...] = ()) -> DataFrame:
    """wanted, and taken: the words each row gives.

    wanted has doc_id, size, certain (whole copies), p (of one more copy, 0 <= p < 1, the same in all rows of a value of by) and left
    (words that the rows of its value of by should give beyond certain copies).  ties: columns that
    order rows of equal doc_id and size.
    """
    ranked = binned(wanted, bins)
    sums = ranked.groupBy(by, "bin").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(by).alias("_by"), F.col("bin").alias("_bin"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy(by, "bin").orderBy("q", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranked.join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("bin") == F.col("_bin")))
    ahead_of = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    extra = F.when(2 * ahead_of + F.col("size") <= 2 * F.col("left"), F.col("size")).otherwise(0)
    taken = lambda more: (F.col("certain") * F.col("size") + more).cast("bigint")
    some = joined.withColumn("taken", taken(extra)).drop("_by", "_bin", "base", "bin", "q")
    return some.unionByName(wanted.filter("p = 0").withColumn("taken", taken(F.lit(0))))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, and the columns keep, which also
    order documents of equal id and size."""
    sizes = stored(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), *keep), "sizes")
    targets = source_targets(sizes, weights, share, most).select(F.col("source").alias("_source"), "source_size", "target")
    times = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    wanted = (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("certain", F.floor(times))
        .withColumn("p", times - F.floor(times))
        .withColumn("left", F.col("target") - F.col("certain") * F.col("source_size"))
    )
    return pareto_take(wanted, "source", ties=keep).select("doc_id", "size", "source_size", "target", "taken", *keep)


#: The same in DuckDB's SQL.
MIXING_SQL = """
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents
), per0 as (
  select source, sum(size)::bigint as source_size, (2 * sum(size))::bigint as cap from sizes group by source
), per1 as (
  select *, ([3, 1, 2])[((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight from per0
), per2 as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over before, 0))
      / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from per1 window before as (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding)
), per3 as (
  select source, source_size, least(cap::double, weight * coalesce((
      select arg_min(level, cap / weight) from per2 where level * weight <= cap), 1e300)) as target from per2
), wanted as (
  select doc_id, size, s.source, source_size, target,
    case when source_size > 0 then target / source_size else 0.0 end as times
  from sizes s join per3 p on s.source is not distinct from p.source
), ranked as (
  select *, floor(times) as certain, times - floor(times) as p, target - floor(times) * source_size as rest,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from wanted
), keyed as (
  select *, case when p > 0 then u / (1 - u) * ((1 - p) / p) end as q from ranked
), ahead as (
  select *, coalesce(sum(size) over (partition by source order by q, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from keyed
)
select doc_id, size, source_size, target,
  (certain * size + case when q is not null and 2 * before + size <= 2 * rest then size else 0 end)::bigint as taken
from ahead
"""
