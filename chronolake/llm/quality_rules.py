"""Quality rules with robust multivariate outlier rejection, in DataFrame operations only.

Statistics of every whole text feed two base rules (too few words, too much repetition).
The rest is judged by a minimum covariance determinant (MCD) estimate for each language and
source. From each of several starts (medians and MADs, all rows, two hashed quarters of the rows),
concentration steps re-estimate mean and covariance from the share COVER of rows nearest by
Mahalanobis distance, until its determinant no longer falls; the estimate of the lowest determinant
is a group's. Rows beyond CUTOFF are rejected.

A step is two aggregates that combine map-side: a histogram of distances per group gives the
distance that COVER of the rows do not exceed, then counts, sums and products of the rows
within it. A group of any size moves as a few rows, and no text is shuffled at all.
The Cholesky factor and the distance are plain column expressions.

Cases: null or empty text: no words, so base_failed; null lang or source: a group of their
own; groups under MIN_ROWS rows are judged by the estimate from all rows of their language, and
if that is small too, by the one from all rows of the table; a variance may not fall below FLOOR (constant statistics); repeated rows count
each; empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 8
COVER = 0.75
#: Steps go on while a determinant's logarithm falls by more than this: distances are known to a bin only.
GAIN = 1e-2
MIN_ROWS = 60
#: Bins per unit of a statistic, and per e-fold of a squared distance.
BINS, DISTANCE_BINS = 500.0, 50.0
#: The least standard deviation of each statistic in X.
FLOOR = (0.25, 0.05, 0.04, 0.12, 0.12)
#: Squared Mahalanobis distance; with five statistics about one normal row in 10^8 lies beyond.
CUTOFF = 46.0
#: A group's rows meet its estimate in so many parts, so that a large group spreads over tasks.
SALTS = 32
X = ("x0", "x1", "x2", "x3", "x4")
PAIRS = [(i, j) for i in range(len(X)) for j in range(i + 1)]


def _chi2_cdf(x: float, k: int) -> float:
    term = total = 1.0 / (k / 2)
    for n in range(1, 500):
        term *= (x / 2) / (k / 2 + n)
        total += term
    return total * math.exp(-x / 2 + (k / 2) * math.log(x / 2) - math.lgamma(k / 2))


def _consistency(cover: float, k: int) -> float:
    """What the covariance of the nearest rows of a normal sample has to be multiplied with."""
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < cover else (low, mid)
    return cover / _chi2_cdf(low, k + 2)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    base = docs.select(
        "doc_id",
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), has_word).alias("lines"),
        F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    counted = base.select(
        "doc_id", "lang", "source", "n_symbols",
        n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("grams"),
    )
    # most texts repeat no window and are not sorted
    twice = F.size("grams") > F.size(F.array_distinct("grams"))
    placed = F.when(twice, F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))
    sorted_ = counted.select(*[c for c in counted.columns if c != "grams"], placed.alias("placed"))
    equal = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    hits = F.filter("placed", lambda x, k: equal(x, F.get("placed", k - 1)) | equal(x, F.get("placed", k + 1)))
    found = sorted_.select(*[c for c in sorted_.columns if c != "placed"], F.array_sort(F.transform(hits, lambda x: x["i"])).alias("at"))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1), p + WINDOW) - p)), F.lit(0).cast("long"), lambda a, w: a + w)
    return found.select(*[c for c in found.columns if c != "at"], covered.alias("n_repeat_words"))


def _vector(stats: DataFrame) -> DataFrame:
    """The statistics, transformed to be near normal."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    xs = (F.log(n), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / n))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select("*", failed.alias("base_failed"), *(x.cast("double").alias(name) for x, name in zip(xs, X)))


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds grp, the group whose estimate judges a row, and fits, the groups whose estimates it is in: level 0 language and source, 1 language, 2 all.

    A level's estimate is made from all of its rows, but only where a small group looks it up.
    """
    sizes = rows.where("not base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.select("lang", "source").distinct().alias("a").join(sizes.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.lang", "a.source", F.coalesce("b.n", F.lit(0)).alias("n"))
    language = Window.partitionBy("lang")
    sizes = sizes.withColumn("in_lang", F.sum("n").over(language)).withColumn("least", F.min("n").over(language))
    sizes = cut(sizes.withColumn("level", F.when(F.col("n") >= MIN_ROWS, 0).when(F.col("in_lang") >= MIN_ROWS, 1).otherwise(2)))
    whole = not sizes.where("level = 2").isEmpty()
    name = lambda level: F.concat_ws("\x01", F.lit(level), *(F.coalesce(c, F.lit("\x02")) for c in ("lang", "source")[: 2 - level]))
    used = (F.col("n") >= MIN_ROWS, (F.col("in_lang") >= MIN_ROWS) & (F.col("least") < MIN_ROWS), F.lit(whole))
    fits = F.filter(F.array(*(F.when(u, name(k)) for k, u in enumerate(used))), lambda x: x.isNotNull())
    grp = F.when(F.col("level") == 0, name(0)).when(F.col("level") == 1, name(1)).otherwise(name(2))
    sizes = sizes.select("lang", "source", grp.alias("grp"), fits.alias("fits"))
    return rows.alias("r").join(sizes.alias("s"), F.col("r.lang").eqNullSafe(F.col("s.lang")) & F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.grp", "s.fits")


def _meet(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with the one row of few that has their keys."""
    return rows.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"], how)


def _quantile(rows: DataFrame, keys: list[str], bin_: Column, share: float) -> DataFrame:
    """(keys, bin): the smallest bin up to which at least share of a key's rows lie. Counts are combined map-side."""
    counts = rows.groupBy(*keys, bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return upto.where(F.col("upto") >= share * F.col("total")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _start(fit: DataFrame) -> DataFrame:
    """(grp, m0.., s0..): medians and robust standard deviations."""
    long = fit.select("grp", "salt", F.posexplode(F.array(*X)).alias("dim", "x"))
    median = _quantile(long, ["grp", "dim"], F.round(F.col("x") * BINS), 0.5).withColumnRenamed("bin", "mid")
    off = _meet(long, median, ["grp", "dim"]).select("grp", "dim", F.abs(F.round(F.col("x") * BINS) - F.col("mid")).alias("off"))
    mad = _quantile(off, ["grp", "dim"], F.col("off"), 0.5)
    both = median.join(mad, ["grp", "dim"])
    pick = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c))) / BINS
    return both.groupBy("grp").agg(*(pick("mid", i).alias(f"m{i}") for i in range(len(X))), *(F.greatest(1.4826 * pick("bin", i), F.lit(FLOOR[i])).alias(f"s{i}") for i in range(len(X))))


def _moments(rows: DataFrame) -> DataFrame:
    """(grp, m0.., c00..): mean and covariance of the rows of each group, the latter made consistent and floored."""
    n = F.count(F.lit(1))
    agg = rows.groupBy("grp").agg(n.alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(X)), *(F.avg(F.col(X[i]) * F.col(X[j])).alias(f"p{i}{j}") for i, j in PAIRS))
    scale = _consistency(COVER, len(X))
    cov = lambda i, j: scale * (F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOOR[i] ** 2 if i == j else 0.0)
    return agg.select("grp", *(f"m{i}" for i in range(len(X))), *(cov(i, j).alias(f"c{i}{j}") for i, j in PAIRS))


def _factor(moments: DataFrame) -> DataFrame:
    """(grp, m0.., l00.., logdet): the Cholesky factor of each covariance, and the logarithm of its determinant."""
    out = moments
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 * 0.01))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, len(X))), 2 * F.log("l00"))
    return out.select("grp", *(f"m{i}" for i in range(len(X))), *(f"l{i}{j}" for i, j in PAIRS), logdet.alias("logdet"))


def _distance(rows: DataFrame, factor: DataFrame, how: str = "left") -> DataFrame:
    """rows with d2, the squared Mahalanobis distance; null (or, by an inner join, no row) where the group has no estimate."""
    out = _meet(rows, factor, ["grp"], how)
    for i in range(len(X)):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(X))), F.col("y0") * F.col("y0"))
    return out.select(*rows.columns, d2.alias("d2"))


def _nearest(rows: DataFrame) -> DataFrame:
    """The rows of each group within the distance bin that COVER of them do not exceed."""
    bin_ = F.floor(F.log(F.col("d2") + 1e-6) * DISTANCE_BINS)
    edge = _quantile(rows, ["grp"], bin_, COVER).withColumnRenamed("bin", "edge")
    return _meet(rows, edge, ["grp"]).where(bin_ <= F.col("edge"))


def _least(estimates: DataFrame) -> DataFrame:
    """The estimate of the lowest determinant of each group."""
    own = [c for c in estimates.columns if c != "grp"]
    return estimates.groupBy("grp").agg(F.min_by(F.struct(*own), "logdet").alias("e")).select("grp", *(f"e.{c}" for c in own))


def estimates(fit: DataFrame) -> DataFrame:
    """(grp, m0.., l00.., logdet) of rows (grp, salt, x0..): the MCD estimate of each group."""
    first = _meet(fit, _start(fit), ["grp"])
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(X)]
    near = _nearest(first.select("grp", "salt", *X, sum((v * v for v in z[1:]), z[0] * z[0]).alias("d2"))).select("grp", "salt", *X)
    starts = (near, fit, fit.where(F.col("salt") < SALTS // 4), fit.where(F.col("salt") >= SALTS - SALTS // 4))
    # each start of a group is a group of its own until the best is chosen
    named = lambda rows, k: rows.withColumn("grp", F.concat_ws("|", F.lit(k), "grp"))
    begin = named(starts[0], 0)
    for k in range(1, len(starts)):
        begin = begin.unionByName(named(starts[k], k).select(*begin.columns))
    runs = fit.withColumn("start", F.explode(F.array(*map(F.lit, range(len(starts)))))).withColumn("grp", F.concat_ws("|", "start", "grp")).drop("start")
    now = found = cut(_factor(_moments(begin)))
    while not now.isEmpty():
        was = now.select("grp", F.col("logdet").alias("was"))
        after = cut(_factor(_moments(_nearest(_distance(runs, now, "inner")))).join(was, "grp"))
        found = found.unionByName(after.drop("was"))
        # a start whose determinant no longer falls is done
        now = after.where(F.col("was") - F.col("logdet") > GAIN).drop("was")
    return _least(found.withColumn("grp", F.expr("substring(grp, 3)")))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: statistics, base_failed, kept and d2 (the method's squared distance)."""
    rows = cut(_grouped(cut(_vector(statistics(docs)))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))
    fit = rows.where("not base_failed").select(F.explode("fits").alias("grp"), "salt", *X)
    judged = _distance(rows.drop("fits"), cut(estimates(fit)))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2")
