"""Quality classifier: a sparse rule ensemble over statistics of whole texts.

Small trees are boosted on a bounded sample of labelled rows; every path from a root becomes
a conjunctive rule over the statistics. A logistic model with an L1 penalty weighs the rules
(and the clipped statistics themselves), most of them with 0. What is left is compiled into
one Spark column expression, so scoring is a projection beside the pass that makes the
statistics. Only the statistics of the sample reach the driver, at most SAMPLE rows.

Cases: null text counts as empty; empty texts have all statistics 0 and get a score; labels
of null are left out, repeated labels count each; without labels of both kinds every score is
the share of good labels (1 where there is none: nothing is known against a document);
repeated rows are scored alike; empty tables give empty results; other columns never enter a
score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: The most labelled rows that a model is fitted on.
SAMPLE = 20_000
TREES, DEPTH, CUTS, LEAST = 40, 3, 24, 10
PENALTY, STEPS = 0.002, 400
THRESHOLD = 0.7
SEED = 7
STATS = (
    "log_words", "word_chars", "symbol_share", "upper_share", "digit_share", "bang_rate", "punct_share", "dup_line_share",
    "distinct_words", "repeat_trigrams", "line_words", "top_word_share", "entropy", "long_word_share",
)
_SYMBOLS = frozenset("#*$%&|<>{}[]\\^~=+_@")
_ENDS = frozenset(".,;:?")


def statistics(text: str) -> tuple[float, ...]:
    """The values of STATS for one text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    counts: dict[str, int] = {}
    chars: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    for c in set(text):
        chars[c] = text.count(c)
    size = sum(map(len, words))
    total = len(text)
    upper = sum(k for c, k in chars.items() if c.isupper())
    letters = sum(k for c, k in chars.items() if c.isalpha())
    lines = [x for x in text.split("\n") if x.strip()]
    grams = set(zip(words, words[1:], words[2:]))
    p = np.fromiter(chars.values(), float, len(chars)) / total
    return (
        float(np.log1p(n)),
        size / n,
        sum(k for c, k in chars.items() if c in _SYMBOLS) / size,
        upper / max(1, letters),
        sum(k for c, k in chars.items() if c.isdigit()) / size,
        chars.get("!", 0) / n,
        sum(k for c, k in chars.items() if c in _ENDS) / size,
        1 - len(set(lines)) / len(lines),
        len(counts) / n,
        1 - len(grams) / (n - 2) if n > 2 else 0.0,
        float(np.log1p(n / len(lines))),
        max(counts.values()) / n,
        float(-(p * np.log2(p)).sum()),
        sum(k for w, k in counts.items() if len(w) > 25) / n,
    )


def with_statistics(docs: DataFrame, keep: list[str], name: str = "__stats") -> DataFrame:
    """The columns keep of docs, and the statistics of its text as the struct name."""
    fields = T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, fields)])
    kinds = [pa.field(s, pa.float64()) for s in STATS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t or "") for t in b.column("__text").to_pylist()], float).reshape(-1, len(STATS))
            made = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATS))], fields=kinds)
            yield pa.record_batch([*(b.column(c) for c in keep), made], [*keep, name])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, bound): the value is > bound where above, else <= bound."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, bound in self.terms:
            out &= (x[:, i] > bound) if above else (x[:, i] <= bound)
        return out

    def column(self, stat) -> Column:
        out = F.lit(True)
        for i, above, bound in self.terms:
            value = stat(STATS[i])
            out = out & ((value > bound) if above else (value <= bound))
        return out


@dataclass
class Model:
    """score = sigmoid(bias + the weights of the rules that hold + slopes of clipped statistics)."""

    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    slopes: list[tuple[int, float, float, float]] = field(default_factory=list)  # statistic, low, high, slope
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * rule.holds(x)
        for i, low, high, w in self.slopes:
            z += w * np.clip(x[:, i], low, high)
        return 1 / (1 + np.exp(-z))

    def column(self, struct: str = "__stats") -> Column:
        if self.constant is not None:
            return F.lit(float(self.constant))
        stat = lambda name: F.col(f"{struct}.{name}")
        z = F.lit(float(self.bias))
        for rule, w in self.rules:
            z = z + F.when(rule.column(stat), F.lit(float(w))).otherwise(F.lit(0.0))
        for i, low, high, w in self.slopes:
            z = z + F.lit(float(w)) * F.least(F.greatest(stat(STATS[i]), F.lit(float(low))), F.lit(float(high)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: tuple, rules: list, fitted: np.ndarray) -> None:
    """A least-squares tree on target; adds the path of each node below the root to rules and its leaf means to fitted."""
    if path:
        rules.append(Rule(path))
    best = None
    if depth and len(rows) >= 2 * LEAST:
        y = target[rows]
        for i in features:
            if not len(cuts[i]):
                continue
            b = binned[rows, i]
            n = np.bincount(b, minlength=len(cuts[i]) + 1)
            s = np.bincount(b, weights=y, minlength=len(cuts[i]) + 1)
            n_left, s_left = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
            n_right, s_right = len(rows) - n_left, y.sum() - s_left
            ok = (n_left >= LEAST) & (n_right >= LEAST)
            if ok.any():
                gain = np.where(ok, s_left**2 / np.maximum(n_left, 1) + s_right**2 / np.maximum(n_right, 1), -np.inf)
                k = int(np.argmax(gain))
                if best is None or gain[k] > best[0]:
                    best = gain[k], i, k
        if best is not None and best[0] - y.sum() ** 2 / len(rows) < 1e-9:
            best = None
    if best is None:
        fitted[rows] = target[rows].mean()
        return
    _, i, k = best
    left = binned[rows, i] <= k
    for side, above in ((left, False), (~left, True)):
        _grow(x, binned, cuts, target, rows[side], features, depth - 1, (*path, (int(i), above, float(cuts[i][k]))), rules, fitted)


def _boost(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    random = np.random.default_rng(SEED)
    cuts = []
    for i in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, i], np.linspace(0, 1, CUTS + 2)[1:-1], method="lower"))
        cuts.append(edges[edges < x[:, i].max()])
    binned = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1)
    z, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        target = y - 1 / (1 + np.exp(-z))
        rows = np.sort(random.choice(len(y), max(2 * LEAST, len(y) * 6 // 10) if len(y) > 2 * LEAST else len(y), replace=False))
        features = random.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False)
        made: list[Rule] = []
        _grow(x, binned, cuts, target, rows, features, DEPTH, (), made, np.zeros(len(y)))
        # the tree's rules as a step: leaves are the rules with no longer rule below them
        leaves = [r for r in made if not any(len(o.terms) > len(r.terms) and o.terms[: len(r.terms)] == r.terms for o in made)]
        for r in leaves:
            hit = r.holds(x)
            if hit.any():
                p = 1 / (1 + np.exp(-z[hit]))
                z[hit] += 0.3 * np.clip((y[hit] - p).sum() / max(1e-3, (p * (1 - p)).sum()), -4, 4)
        rules += made
    return list(dict.fromkeys(rules))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The rule ensemble of rows x (statistics) and labels y (0 or 1)."""
    if not len(y) or y.min() == y.max():
        return Model(0.0, constant=float(y.mean()) if len(y) else 1.0)
    rules = _boost(x, y)
    low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    a = np.concatenate([np.stack([r.holds(x) for r in rules], 1).astype(float) if rules else np.zeros((len(x), 0)), np.clip(x, low, high)], 1)
    mean, scale = a.mean(0), a.std(0)
    live = scale > 1e-9
    a = (a[:, live] - mean[live]) / scale[live]
    w, bias = np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    step = 4.0 / max(1e-9, float(np.linalg.eigvalsh(a.T @ a / len(a))[-1]) + 1.0)
    v, c, t = w.copy(), bias, 1.0
    for _ in range(STEPS):  # accelerated proximal gradient
        off = 1 / (1 + np.exp(-(a @ v + c))) - y
        new = v - step * (a.T @ off / len(a))
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * PENALTY)
        new_bias = c - step * float(off.mean())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    full = np.zeros(len(mean))
    full[live] = w / scale[live]
    bias -= float(full @ mean)
    kept = [(r, float(k)) for r, k in zip(rules, full) if k]
    slopes = [(i, float(low[i]), float(high[i]), float(k)) for i, k in enumerate(full[len(rules) :]) if k]
    return Model(bias, kept, slopes)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of docs (doc_id, and __stats or text) and labels (doc_id, quality); held-out rows are not used.

    The sample is the SAMPLE labelled rows whose doc_id hashes lowest. Labels leave by a threshold
    on the hash before they meet their documents, so few more than SAMPLE rows are ever sorted;
    where too many of them have no document, the threshold rises.
    """
    at = F.xxhash64("doc_id")
    known = labels.where(~held_out() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    share = min(1.0, 1.1 * SAMPLE / max(1, known.count()))
    while True:
        low = known if share >= 1 else known.where(at < F.lit(min(int((share - 0.5) * 2.0**64), 2**63 - 1)))
        met = docs.join(low, "doc_id")
        if "__stats" not in docs.columns:
            met = with_statistics(met, ["doc_id", "quality"])
        rows = met.select("quality", "__stats.*", at.alias("at"), "doc_id").orderBy("at", "doc_id", "quality").limit(SAMPLE).toPandas()
        if len(rows) >= SAMPLE or share >= 1:
            return fit(rows[list(STATS)].to_numpy(float), rows["quality"].to_numpy(float))
        share = min(1.0, 4 * share)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = cut(with_statistics(own, ["doc_id"]))
    score = train(stats, labels).column()
    scored = stats.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with all their columns."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return with_statistics(docs, docs.columns).where(model.column() >= THRESHOLD).drop("__stats")
