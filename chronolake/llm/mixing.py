"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source named in the targets, and all the others together, is given a target share of a
budget of characters (epochs x the corpus). Its mean repetition rate is share x budget over
its own characters. Each document is repeated a Poisson number of times with that mean: the
distribution is inverted at a uniform number hashed from (seed, doc_id), so a rerun, a lost
executor or another partitioning gives the same counts. Copies are then dealt out and
ordered by a hash of (seed, doc_id, copy): a global shuffle.

The totals are one row for each named source and one for the rest, so what is broadcast is
bounded by the parameter, whatever the corpus holds. They are summed map-side first.

Cases: null source belongs to the rest; null or empty text has no characters but is repeated
at its source's rate; repeated rows (same doc_id) are repeated alike, each on its own; a null
doc_id is hashed as the word "null"; a source without any character has rate 0; an empty
table gives an empty result; other columns are carried along, but mix puts its own copy, rate
and shuffle_key in the place of columns of these names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mix:
    """targets: share of the budget by source; the rest of 1 goes to all other sources together."""

    targets: dict = field(default_factory=dict)
    epochs: float = 1.0
    seed: str = "mix"
    #: A rate beyond this is an error, not a cap: the inversion sums so many terms.
    max_rate: float = 64.0

    def terms(self) -> int:
        return int(self.max_rate + 12 * math.sqrt(self.max_rate) + 20)


PRODUCTION = Mix({"src0": 0.20, "src1": 0.10, "src2": 0.10})


def _rest(mix: Mix) -> float:
    return 1.0 - sum(mix.targets.values())


def _bucket(mix: Mix) -> Column:
    return F.when(F.col("source").isin(*mix.targets), F.col("source")) if mix.targets else F.lit(None).cast("string")


def rates(docs: DataFrame, mix: Mix) -> DataFrame:
    """(bucket, rate): a row for each named source that occurs, and one (null) for the rest."""
    sums = docs.groupBy(_bucket(mix).alias("bucket")).agg(F.sum(F.length("text").cast("long")).alias("own"), F.count(F.lit(1)).alias("rows"))
    share = F.lit(_rest(mix))
    for name, w in mix.targets.items():
        share = F.when(F.col("bucket") == name, F.lit(float(w))).otherwise(share)
    sized = sums.withColumn("total", F.sum("own").over(Window.partitionBy()))  # over these few rows
    rate = F.when(F.col("own") > 0, share * F.lit(float(mix.epochs)) * F.col("total") / F.col("own")).otherwise(F.lit(0.0))
    checked = F.when(rate <= mix.max_rate, rate).otherwise(F.raise_error(F.concat(F.lit("repetition rate too large for source "), F.coalesce("bucket", F.lit("(rest)")))).cast("double"))
    return sized.select("bucket", checked.alias("rate"))


def uniform(*parts) -> Column:
    """In [0, 1): 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def cumulative(rate: Column, terms: int) -> Column:
    """The cumulative probabilities of 0, 1, .. terms - 1 repetitions."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(s, i):
        p = s["p"] * rate / i
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms - 1)), start, step, lambda s: s["c"])


def poisson(cdf: Column, u: Column, terms: int) -> Column:
    """The smallest k whose cumulative probability exceeds u; terms where none does. cdf may lack equal ones at its end."""
    below = F.size(F.filter(cdf, lambda c: c <= u))
    return F.when(below < F.size(cdf), below).otherwise(F.lit(terms))


def _dealt(docs: DataFrame, mix: Mix) -> DataFrame:
    """docs with each row repeated, and __copy, __rate and __key; dealt out by __key, and in its order within each partition."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # the probabilities no longer grow after some terms; a row need not look at these
    cdf = F.array_distinct(cumulative(F.col("rate"), mix.terms()))
    r = rates(docs, mix).select(F.col("bucket").alias("__bucket"), F.col("rate").alias("__rate"), cdf.alias("__cdf"))
    rated = docs.withColumn("__bucket", _bucket(mix)).alias("d").join(F.broadcast(r.alias("r")), F.col("d.__bucket").eqNullSafe(F.col("r.__bucket"))).select(*[F.col(f"d.`{c}`") for c in docs.columns], "__rate", "__cdf")
    drawn = rated.withColumn("__count", poisson(F.col("__cdf"), uniform(F.lit(mix.seed), ident), mix.terms())).drop("__cdf").where("__count > 0")
    copies = drawn.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)))
    keyed = copies.withColumn("__key", F.md5(F.concat_ws("|", F.lit(mix.seed), F.lit("order"), ident, F.col("__copy"))))
    return keyed.repartition("__key").sortWithinPartitions("__key")


def mix(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """docs with each row repeated, plus copy (from 0), rate and shuffle_key; dealt out by shuffle_key, and in its order within each partition."""
    own = [f"`{c}`" for c in docs.columns if c not in ("copy", "rate", "shuffle_key")]
    return _dealt(docs, mix).select(*own, F.col("__copy").cast("long").alias("copy"), F.col("__rate").alias("rate"), F.col("__key").alias("shuffle_key"))


def repeated(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """The rows of mix, in its order, with the columns of docs alone, whatever their names are."""
    return _dealt(docs, mix).select(*[f"`{c}`" for c in docs.columns])


def sql(mix: Mix, documents: str = "documents", columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same in DuckDB's SQL."""
    names = ", ".join(f"'{x}'" for x in mix.targets) or "null"
    share = "".join(f" when bucket = '{k}' then {float(w)!r}::double" for k, w in mix.targets.items())
    share = f"(case{share} else {_rest(mix)!r}::double end)" if share else f"{_rest(mix)!r}::double"
    return f"""
with recursive src as (select {columns} from {documents}),
b as (select *, case when source in ({names}) then source end bucket,
             ('0x' || substr(md5('{mix.seed}|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double / {2**52}.0::double u from src),
s as (select bucket, sum(length(text))::double own from b group by 1),
r as (select bucket, case when own > 0 then {share} * {float(mix.epochs)!r}::double * (select sum(own) from s) / own else 0.0::double end rate from s),
cdf as (select bucket, rate, 0 k, exp(-rate) p, exp(-rate) c from r
        union all select bucket, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from cdf where k < {mix.terms()}),
drawn as (select b.*, cdf.rate, (select count(*) from cdf x where x.bucket is not distinct from b.bucket and x.c <= b.u and x.k < {mix.terms()}) n
          from b join cdf on cdf.k = 0 and cdf.bucket is not distinct from b.bucket),
copies as (select *, unnest(range(n::bigint)) copy from drawn)
select {columns}, copy::bigint as "copy", rate, md5('{mix.seed}|order|' || coalesce(doc_id::varchar, 'null') || '|' || copy) shuffle_key from copies
"""
