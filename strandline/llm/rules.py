"""Quality rules: fixed limits first, then robust multivariate outliers of each language and source.

Every whole text gives seven transformed statistics: log of words, log of letters a word, and the square roots of the shares of
symbols, repeated lines, repeated words, capitals and other marks. For each language and source the minimum-covariance-
determinant estimate is found by concentration steps over all documents of the group: the share KEPT_SHARE with the smallest
Mahalanobis distances gives the next mean and covariance. The last estimate is reweighted once, and documents whose squared
distance passes LIMIT are rejected.

A step is one pass: distances in the JVM under the group's parameters, sums per group and distance range. Statistics are
fixed-point integers, so sums are exact, results don't depend on how rows are dealt, and a group of any size costs BINS rows.
Starting values are medians and quartiles from counts per value. Covariances get the squares of FLOORS added to their diagonal,
since statistics that are zero for most texts have no spread of their own.

Defined cases: null texts have no words and fail the base rule; documents that fail it count in no estimate. Null languages and
sources are groups of their own. Documents of groups with fewer than LEAST are judged by the estimate of their whole language,
those of languages with fewer by the estimate of all documents, and kept if there are fewer than LEAST in all. Repeated rows are documents of their own; an empty table
gives an empty result; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common, vectorcodes

MIN_WORDS, MAX_REPEATED, SYMBOLS = 50, 50, b"#*$%&|<>"
MARKS, CAPITALS = b"!\"'(),-./:;=?@[]^_`{}~+\\", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAMES = ("words", "letters", "symbols", "lines", "repeats", "capitals", "marks")
SIZE = len(NAMES)
#: Fixed point: statistics times SCALE; the histograms of the start have 1 / COARSE of that.
SCALE, COARSE = 1024, 8
#: Least standard deviations, as the statistics are.
FLOORS = (0.5, 0.08, 0.035, 0.2, 0.16, 0.05, 0.05)
KEPT_SHARE, REWEIGHT, STEPS, LEAST, LIMIT = 0.75, 0.975, 6, 60, 40.0
#: Ranges of distances: PER_E of them where 1 + distance grows by the factor e.
BINS, PER_E = 640, 40
#: So many groups (some 400 bytes each) are broadcast; more are joined by shuffle, large ones in salted copies.
BROADCAST_GROUPS = 20_000
PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three found twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pairs = np.unique(at[:-2] * len(ids) + at[1:-1], return_inverse=True)[1]
    _, which, n = np.unique(pairs * len(ids) + at[2:], return_inverse=True, return_counts=True)
    twice = n[which] > 1
    held = np.zeros(len(words), bool)
    for k in range(3):
        held[k : k + len(twice)] |= twice
    return int(held.sum())


def measures(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five counts of a text and its transformed statistics."""
    raw = text.encode()
    words = raw.split()  # at the six ASCII white spaces
    n, chars = len(words), len(b"".join(words).decode())
    without = lambda some: len(raw) - len(raw.translate(None, some))
    symbols, capitals, marks = without(SYMBOLS), without(CAPITALS), without(MARKS)
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    dup, repeats = len(lines) - len(set(lines)), repeated_words(words)
    share = lambda part, whole: math.sqrt(part / max(1, whole))
    return (n, chars, symbols, dup, repeats), (math.log1p(n), math.log(max(1, chars) / max(1, n)), share(symbols, chars), share(dup, len(lines)), share(repeats, n), share(capitals, chars), share(marks, chars))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, stats = [], []
        for text in b.column("text"):
            c, s = measures(text.as_py() or "")
            counts.append(c)
            stats.append(s)
        c = np.array(counts, np.int64).reshape(-1, 5)
        x = np.rint(np.array(stats).reshape(-1, SIZE) * SCALE).astype(np.int64)
        kept = [b.column(k) for k in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c[:, k]) for k in range(5)), *(pa.array(x[:, k]) for k in range(SIZE))], ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"x{k}" for k in range(SIZE))])


def statistics(docs: DataFrame) -> DataFrame:
    """docs: doc_id, lang, source, text. The three, the five counts, base_failed and the statistics x0 to x6 as integers."""
    common.prepare(docs.sparkSession)
    first = docs.select("doc_id", "lang", "source").schema.simpleString()[len("struct<") : -1]
    schema = f"{first}, {BASE}, " + ", ".join(f"x{k} long" for k in range(SIZE))
    out = docs.select("doc_id", "lang", "source", "text").mapInArrow(_measure, schema)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def _gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    term = total = 1 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi_square(share: float, df: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma(df / 2, mid / 2) < share else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """What the covariance of the central share of a normal distribution has to be multiplied with."""
    return share / _gamma(SIZE / 2 + 1, chi_square(share, SIZE) / 2)


def groups(stats: DataFrame) -> DataFrame:
    """lang, source, n, g, fits: rows, the group whose estimate judges each language and source (its own, its language's or that
    of all, the first that LEAST documents passing the base rule make up, else null), and the groups it counts in."""
    sizes = common.durable(stats.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum((~F.col("base_failed")).cast("long")).alias("passed")), "sizes")
    name = lambda kind, *cols: F.to_json(F.struct(F.lit(kind).alias("kind"), *cols))
    own, lang, every = name("source", "lang", "source"), name("lang", "lang"), name("all")
    small = F.col("passed") < LEAST
    by_lang = common.durable(sizes.groupBy(F.col("lang").alias("_lang")).agg(F.sum("passed").alias("in_lang"), F.max(small).alias("any_small")), "langs")
    total = by_lang.agg(F.coalesce(F.sum("in_lang"), F.lit(0)).alias("n"), F.coalesce(F.max((F.col("in_lang") < LEAST) & F.col("any_small")), F.lit(False)).alias("wanted")).first()
    told = F.broadcast(by_lang) if by_lang.count() <= BROADCAST_GROUPS else by_lang
    large = F.lit(total.n >= LEAST)
    g = F.when(~small, own).when(F.col("in_lang") >= LEAST, lang).when(large, every)
    fits = F.array_compact(F.array(F.when(~small, own), F.when(F.col("any_small") & (F.col("in_lang") >= LEAST), lang), F.when(large & F.lit(total.wanted), every)))
    return common.durable(sizes.join(told, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "source", "n", g.alias("g"), fits.alias("fits")), "groups")


_PARAMS = "g string, mean array<double>, inverse array<double>"


def _packed(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float]]:
    inv = np.linalg.inv(cov)
    return mean.tolist(), [float(inv[i, j] * (1 if i == j else 2)) for i, j in PAIRS]


def _solve(factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means, inverses = [], []
            for n, s1, s2 in zip(*(b.column(c).to_pylist() for c in ("n", "s1", "s2")), strict=True):
                mean = np.array(s1, float) / n / SCALE
                cov = np.zeros((SIZE, SIZE))
                for (i, j), s in zip(PAIRS, s2, strict=True):
                    # in integers, so that nothing is lost between large sums
                    cov[i, j] = cov[j, i] = (s * n - s1[i] * s1[j]) / (n * n) / SCALE**2
                m, v = _packed(mean, factor * cov + np.diag(np.square(FLOORS)))
                means.append(m)
                inverses.append(v)
            yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(means, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64()))], ["g", "mean", "inverse"])

    return run


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        means, inverses = [], []
        for held in b.column("q").to_pylist():
            q = {r["k"]: r for r in held}
            low, mid, high = (np.array([q[k][name] for k in range(SIZE)], float) * COARSE / SCALE for name in ("low", "mid", "high"))
            m, v = _packed(mid, np.diag(np.maximum((high - low) / 1.349, FLOORS) ** 2))
            means.append(m)
            inverses.append(v)
        yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(means, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64()))], ["g", "mean", "inverse"])


def start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each group, from counts per value."""
    values = rows.select("g", F.posexplode(F.array(*(F.expr(f"x{k} div {COARSE}") for k in range(SIZE)))).alias("k", "v")).groupBy("g", "k", "v").agg(F.count("*").alias("n"))
    each = Window.partitionBy("g", "k")
    upto = F.sum("n").over(each.orderBy("v")) / F.sum("n").over(each)
    at = values.withColumn("upto", upto).groupBy("g", "k").agg(*(F.min(F.when(F.col("upto") >= share, F.col("v"))).alias(name) for name, share in (("low", 0.25), ("mid", 0.5), ("high", 0.75))))
    return at.groupBy("g").agg(F.collect_list(F.struct("k", "low", "mid", "high")).alias("q")).mapInArrow(_start, _PARAMS)


def with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows with d2, the squared distance under the parameters of the group g; rows: g, x0 to x6. A group without parameters has null."""
    if params.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(params), "g", "left")
    else:
        sizes = common.durable(rows.groupBy("g").agg(F.count("*").alias("n")), "sizes")  # a row a group, the null one included
        total = sizes.agg(F.sum("n")).first()[0]
        joined = vectorcodes.salted(rows, sizes.join(params, "g", "left"), ["g"], total, F.xxhash64("doc_id", "x0"))
    gap = [F.col(f"x{k}") / F.lit(float(SCALE)) - F.col("mean")[k] for k in range(SIZE)]
    d2 = sum((F.col("inverse")[p] * gap[i] * gap[j] for p, (i, j) in enumerate(PAIRS)), F.lit(0.0))
    return joined.withColumn("d2", d2).drop("mean", "inverse")


def _estimate(cells: DataFrame, factor: float) -> DataFrame:
    """Parameters from sums of the groups' cells."""
    sums = cells.groupBy("g").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _sum_names()))
    sums = sums.select("g", "n", F.array(*(f"s{k}" for k in range(SIZE))).alias("s1"), F.array(*(f"s{i}_{j}" for i, j in PAIRS)).alias("s2"))
    return common.durable(sums.mapInArrow(_solve(factor), _PARAMS), "estimate")


def _sum_names() -> list[str]:
    return [f"s{k}" for k in range(SIZE)] + [f"s{i}_{j}" for i, j in PAIRS]


def _cells(rows: DataFrame, by: Column | None = None) -> DataFrame:
    keys = ["g"] if by is None else ["g", by.alias("bin")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(f"x{k}").alias(f"s{k}") for k in range(SIZE)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS))


def estimate(rows: DataFrame) -> DataFrame:
    """g, mean, inverse (of the covariance, upper triangle, off-diagonal doubled). rows: doc_id, g, x0 to x6."""
    params = common.durable(start(rows), "start")
    share, factor = KEPT_SHARE, consistency(KEPT_SHARE)
    for _ in range(STEPS):
        cells = _cells(with_distance(rows, params), F.least(F.floor(F.log1p("d2") * PER_E), F.lit(BINS - 1)))
        run = Window.partitionBy("g").orderBy("bin")  # BINS rows a group
        upto = F.sum("n").over(run) - F.col("n")
        params = _estimate(cells.withColumn("before", upto).withColumn("all", F.sum("n").over(Window.partitionBy("g"))).where(F.col("before") < share * F.col("all")), factor)
    near = with_distance(rows, params).where(F.col("d2") <= chi_square(REWEIGHT, SIZE))
    return _estimate(_cells(near), consistency(REWEIGHT))


def judge(docs: DataFrame) -> DataFrame:
    """docs: doc_id, lang, source, text. doc_id, the five counts, base_failed, distance (squared; null where there is none), kept."""
    stats = common.durable(statistics(docs), "statistics")
    dealt = common.durable(_with_group(stats, groups(stats)), "grouped")
    xs = [f"x{k}" for k in range(SIZE)]
    params = estimate(dealt.where(~F.col("base_failed")).select("doc_id", F.explode("fits").alias("g"), *xs))
    judged = with_distance(dealt, params)
    far = F.coalesce(F.col("d2") > LIMIT, F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("d2").alias("distance"), (~F.col("base_failed") & ~far).alias("kept"))


def _with_group(stats: DataFrame, named: DataFrame) -> DataFrame:
    if named.count() <= BROADCAST_GROUPS:
        small = F.broadcast(named.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "g", "fits"))
        return stats.join(small, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source")
    return vectorcodes.salted(stats, named, ["lang", "source"], stats.count(), F.xxhash64("doc_id", "x0"))


def op13_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
