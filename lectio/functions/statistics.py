"""Driver-side kernels over small aggregated results (T-01 to T-20): exact tests, power, draws, ridge fits."""

from __future__ import annotations

import bisect
import math
import random
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectio.operators import scan


def _stirling_error(k: np.ndarray) -> np.ndarray:
    """log(k!) less Stirling's formula, for k of 1 and more."""
    near = np.array([math.lgamma(i + 1) - (0.5 * math.log(2 * math.pi * i) + i * math.log(i) - i) for i in range(1, 16)])
    far = np.maximum(k, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * far**2)) / far**2) / far**2) / far
    return np.where(k < 16, near[np.clip(k, 1, 15).astype(int) - 1], series)


def binomial_pmf(k, n: int, p: float) -> np.ndarray:
    """P(k of n) for each k, in the saddle-point form, which keeps its digits for any n."""
    k = np.asarray(k, float)
    if p <= 0 or p >= 1 or n == 0:
        return (k == (n if p >= 1 else 0)).astype(float)

    def deviance(x, mean):
        d = (x - mean) / mean
        return mean * ((1 + d) * np.log1p(d) - d)

    if n == 1:
        return np.where(k == 1, p, 1 - p)
    j = np.clip(k, 1, n - 1)
    inner = _stirling_error(np.array([n]))[0] - _stirling_error(j) - _stirling_error(n - j) - deviance(j, n * p) - deviance(n - j, n * (1 - p)) + 0.5 * np.log(n / (2 * math.pi * j * (n - j)))
    return np.exp(np.where(k == 0, n * math.log1p(-p), np.where(k == n, n * math.log(p), inner)))


def binomial_reach(n: int, p: float, nats: float = 70.0) -> int:
    """How far from the mean outcomes have a chance of exp(-nats) in all at most (Bernstein's bound): about the root of n."""
    return math.ceil(nats / 3 + math.sqrt((nats / 3) ** 2 + 2 * nats * n * p * (1 - p))) + 1


def exact_two_sided(k: int, n: int) -> float:
    """T-08: exact two-sided binomial p of k in n at one half.

    Of many trials the tail is summed from its greatest term down, as far as terms count: about the root of n of them.
    """
    if n == 0:
        return 1.0
    tail = min(k, n - k)
    if n <= 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(tail + 1)) / 2**n)
    i = np.arange(min(tail, binomial_reach(n, 0.5)))
    return min(1.0, float(2 * binomial_pmf(tail, n, 0.5) * (1 + np.cumprod((tail - i) / (n - tail + 1 + i)).sum())))


def mcnemar(only_first: int, only_second: int) -> float:
    """T-07: exact p from the discordant counts."""
    return exact_two_sided(only_first, only_first + only_second)


def wilson(successes: int, n: int, alpha: float = 0.05) -> tuple[float, float, float] | None:
    """T-03: (share, low, high); None without trials."""
    if not n:
        return None
    z = NormalDist().inv_cdf(1 - alpha / 2)
    p, f = successes / n, z * z / n
    middle, half = (p + f / 2) / (1 + f), z * math.sqrt(p * (1 - p) / n + f / (4 * n)) / (1 + f)
    return p, max(0.0, middle - half), min(1.0, middle + half)


def wilson_columns(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """T-03 as columns; null without trials."""
    p, f = F.try_divide(successes.cast("double"), n), F.try_divide(F.lit(z * z), n)
    middle = (p + f / 2) / (1 + f)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(f, 4 * n)) / (1 + f)
    return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))


def percentile_positions(n: int, level: float = 0.95, rule: str = "inclusive") -> tuple[int, int]:
    """T-04: positions of the bounds among n ascending values; no interpolation."""
    tail = (1 - level) / 2
    span = n - 1 if rule == "inclusive" else n
    low, high = int(tail * span), int((1 - tail) * span) - (rule == "symmetric")
    return max(0, min(low, n - 1)), max(0, min(high, n - 1))


def holm(p_values: dict[str, float], alpha: float = 0.05) -> dict[str, tuple[float, bool]]:
    """T-10, W-14: (adjusted p, rejected); rejection stops at the first failure."""
    out, running, going = {}, 0.0, True
    ordered = sorted(p_values.items(), key=lambda x: x[1])
    for i, (name, p) in enumerate(ordered):
        running = max(running, min(1.0, (len(ordered) - i) * p))
        going = going and running <= alpha
        out[name] = (running, going)
    return out


def holm_frame(tests: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """T-10 as windows; the number of tests is that of metrics or scorers compared."""
    by_p = Window.orderBy(p, name)
    step = tests.withColumn("_i", F.row_number().over(by_p)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    adjusted = F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))).over(by_p.rowsBetween(Window.unboundedPreceding, 0))
    done = step.withColumn("adjusted", adjusted)
    return done.withColumn("rejected", F.min((F.col("adjusted") <= alpha).cast("int")).over(by_p.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_i", "_m")


def draw_table(n: int, resamples: int, seed: int = 0) -> list[list[int]]:
    """T-01, T-02: n draws with replacement from range(n), once per resample, from one seeded generator."""
    rng = random.Random(seed)
    return [[rng.randrange(n) for _ in range(n)] for _ in range(resamples)]


def cluster_bootstrap_mean(observations: DataFrame, cluster: str, value: str, ordinal: str, resamples: int = 2000, seed: int = 0, level: float = 0.95, rule: str = "inclusive"):
    """T-01: (mean, low, high) of the pooled mean, resampling clusters; no interval for fewer than two.

    Only (sum, n) of each cluster comes to the driver. Clusters stand in the order of first appearance.
    """
    rows = observations.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.min(ordinal).alias("o")).orderBy("o", cluster).collect()
    if not rows:
        return None, None, None
    mean = sum(r.s for r in rows) / sum(r.n for r in rows)
    if len(rows) < 2:
        return mean, None, None
    draws = np.array(draw_table(len(rows), resamples, seed))
    s, n = np.array([r.s for r in rows]), np.array([r.n for r in rows])
    values = np.sort(s[draws].sum(1) / n[draws].sum(1))
    low, high = percentile_positions(resamples, level, rule)
    return mean, float(values[low]), float(values[high])


#: Units that one task draws from.
BUCKET_UNITS = 65_536


def _path_draws(sizes: np.ndarray, bucket: int, resamples: int, seed: int) -> np.ndarray:
    """How many of each resample's draws fall on a bucket: a binomial split at each node of a binary tree over the buckets.

    A node's generator is seeded with its range, so that tasks that share a node draw alike; together the
    buckets' draws are multinomial.
    """
    before = np.r_[0, np.cumsum(sizes)]
    low, high = 0, len(sizes)
    draws = np.full(resamples, before[-1], np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        whole, left = before[high] - before[low], before[middle] - before[low]
        own = np.random.default_rng([seed, low, high]).binomial(draws, left / whole if whole else 0.0)
        draws, low, high = (own, low, middle) if bucket < middle else (draws - own, middle, high)
    return draws


def resampled_sums(values: np.ndarray, draws: np.ndarray, seed: int, bucket: int) -> np.ndarray:
    """Per resample the sum of so many of a bucket's values, drawn with replacement."""
    rng = np.random.default_rng([seed, bucket])
    return np.array([values[rng.integers(0, len(values), int(k))].sum() if k else 0.0 for k in draws])


def unit_bootstrap_mean(observations: DataFrame, unit: str, value: str, resamples: int = 2000, seed: int = 0, level: float = 0.95, rule: str = "inclusive", bucket_units: int = BUCKET_UNITS):
    """T-02: (mean, low, high) of the pooled mean, resampling units; no interval for fewer than two.

    Units are dealt into buckets by a hash. Every bucket finds its share of each resample's draws by itself and
    gives a sum per resample, so the driver holds a number per resample and the size of each bucket. A unit
    is one row; rows without a value don't count.
    """
    known = observations.where(F.col(value).isNotNull()).select(F.xxhash64(unit).alias("_u"), F.col(value).cast("double").alias("_x"))
    n = known.count()
    if not n:
        return None, None, None
    buckets = -(-n // bucket_units)
    dealt = known.withColumn("_b", F.pmod("_u", F.lit(buckets)).cast("int"))
    sums = {r._b: (r.n, r.s) for r in dealt.groupBy("_b").agg(F.count("*").alias("n"), F.sum("_x").alias("s")).collect()}
    mean = sum(s for _, s in sums.values()) / n
    if n < 2:
        return mean, None, None
    sizes = np.array([sums.get(b, (0, 0.0))[0] for b in range(buckets)], np.int64)

    def run(table):
        import pyarrow as pa

        b = table.column("_b")[0].as_py()
        values = table.sort_by([("_u", "ascending"), ("_x", "ascending")]).column("_x").to_numpy()
        drawn = resampled_sums(values, _path_draws(sizes, b, resamples, seed), seed, b)
        return pa.table({"r": pa.array(range(resamples), pa.int32()), "s": pa.array(drawn)})

    parts = dealt.groupBy("_b").applyInArrow(run, "r int, s double").groupBy("r").agg(F.sum("s").alias("s"))
    values = np.sort([r.s / n for r in parts.collect()])
    low, high = percentile_positions(resamples, level, rule)
    return mean, float(values[low]), float(values[high])


#: Bins that a group's range is cut into at each pass; a range of at most so many rows is sorted out by its distinct values.
BINS, SETTLED = 256, 4096
#: As a share: the upper of the two middle values (the lower one is 1 / 2), the only one of an odd number.
UPPER = (-1, 2)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """(by, name, quantile): for each named share (p, q) the value number ceil(n * p / q), at least the first, of a group's n.

    Selection by refinement: each pass counts a group's values in BINS bins of the range that is still
    open, with a partial sum where the rows are, and goes on in the bin that holds the rank, until it
    holds SETTLED rows at most or a single value. So a group's values never meet in one task, whatever their number.
    """
    names = [f"_k{i}" for i in range(len(by))]
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*(F.col(c).alias(k) for c, k in zip(by, names, strict=True)), F.col(value).cast("double").alias("_x"))
    ends = known.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    rank = lambda p, q: F.greatest(F.expr("_n div 2 + 1" if (p, q) == UPPER else f"(_n * {p}L + {q - 1}L) div {q}L"), F.lit(1))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank(p, q).alias("_rank")) for name, (p, q) in shares.items()]))
    state = ends.select(*names, "_n", "_low", "_high", wanted.alias("_w")).select(*names, "_n", "_low", "_high", "_w.*")
    keys = [*names, "_name"]
    spark = rows.sparkSession
    local = lambda df: spark.createDataFrame(df.collect(), df.schema) if df.limit(10_001).count() <= 10_000 else df  # noqa: E731  a row per group and name
    state = local(state)
    same = lambda prefix: [F.col(k).eqNullSafe(F.col(prefix + k)) for k in names]
    renamed = lambda df, *more: df.select(*(F.col(k).alias("s" + k) for k in names), *more)
    for _ in range(8):  # 256 ** 8 bins tell all doubles of a range apart
        if state.where(f"_n > {SETTLED} AND _low < _high").isEmpty():
            break
        opened = renamed(state.where(f"_n > {SETTLED} AND _low < _high"), "_name", "_n", "_low", "_high", "_rank")
        width = (F.col("_high") - F.col("_low")) / BINS
        spot = F.least(F.floor((F.col("_x") - F.col("_low")) / width), F.lit(BINS - 1))
        met = known.join(opened, same("s")).where("_x >= _low AND _x <= _high")
        bins = met.groupBy(*keys, "_rank", spot.alias("_bin")).agg(F.count("*").alias("_m"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        listed = bins.groupBy(*keys, "_rank").agg(F.sort_array(F.collect_list(F.struct("_bin", "_m", "_a", "_b"))).alias("_bs"))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("struct<_m:bigint,_a:double,_b:double,before:bigint>").alias("hit"))
        step = lambda s, b: F.when(s["hit"].isNotNull(), s).otherwise(F.struct((s["seen"] + b["_m"]).alias("seen"), F.when(s["seen"] + b["_m"] >= F.col("_rank"), F.struct(b["_m"].alias("_m"), b["_a"].alias("_a"), b["_b"].alias("_b"), s["seen"].alias("before"))).alias("hit")))
        chosen = listed.select(*keys, "_rank", F.aggregate("_bs", start, step)["hit"].alias("h"))
        narrowed = chosen.select(*names, F.col("h._m").alias("_n"), F.col("h._a").alias("_low"), F.col("h._b").alias("_high"), "_name", (F.col("_rank") - F.col("h.before")).alias("_rank"))
        state = local(state.where(f"NOT (_n > {SETTLED} AND _low < _high)").unionByName(narrowed))
    single = state.where("_low = _high").select(*keys, F.col("_low").alias("quantile"))
    rest = renamed(state.where("_low < _high"), "_name", "_low", "_high", "_rank")
    counts = known.join(rest, same("s")).where("_x >= _low AND _x <= _high").groupBy(*keys, "_rank", "_x").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_x"))
    found = counts.withColumn("_upto", upto).where("_upto >= _rank").groupBy(*keys).agg(F.min("_x").alias("quantile"))
    return single.unionByName(found).select(*(F.col(k).alias(c) for c, k in zip(by, names, strict=True)), F.col("_name").alias("name"), "quantile")


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A-02: (by, median) of each group with a value, the mean of the two middle ones."""
    middle = exact_quantiles(rows, by, value, {"low": (1, 2), "high": UPPER})
    return middle.groupBy(*by).agg(F.avg("quantile").alias("median"))


def average_ranks(values) -> np.ndarray:
    x = np.asarray(values, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def spearman(a, b) -> float | None:
    """T-05: correlation of average ranks; None where a side is constant."""
    x, y = average_ranks(a), average_ranks(b)
    x, y = x - x.mean(), y - y.mean()
    spread = math.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / spread) if spread else None


def spearman_with_interval(a, b, resamples: int = 2000, seed: int = 0, level: float = 0.95):
    """T-06: bootstrap over units, constant resamples left out, symmetric bounds."""
    whole = spearman(a, b)
    x, y = np.asarray(a, float), np.asarray(b, float)
    values = sorted(v for d in draw_table(len(x), resamples, seed) if (v := spearman(x[d], y[d])) is not None)
    if whole is None or not values:
        return whole, None, None
    low, high = percentile_positions(len(values), level, "symmetric")
    return whole, values[low], values[high]


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, rank): the average rank of each value in its group, less the group's mean rank.

    Ranks come from counts per value and a segmented scan of their sums, so that a group of any size is spread.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    before = scan.scan(counts, by, [value], _before=scan.sum_before("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    same = [F.col(c).eqNullSafe(F.col("t_" + c)) for c in by]
    joined = before.join(totals.withColumnsRenamed({c: "t_" + c for c in by}), same)
    return joined.select(*by, value, (F.coalesce("_before", F.lit(0)) + (F.col("_n") + 1) / 2 - (F.col("_all") + 1) / 2).alias("rank"))


def spearman_frame(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """T-05 within groups: rho and n; rows without one of the values are left out, rho is null where a side is constant."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"))
    cells = known.groupBy(*by, "_a", "_b").agg(F.count("*").alias("_n"))
    for side in ("_a", "_b"):
        ranked = value_ranks(known, by, side).withColumnsRenamed({c: f"r_{c}" for c in [*by, side]} | {"rank": f"_rank{side}"})
        cells = cells.join(ranked, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in [*by, side]]).drop(*(f"r_{c}" for c in [*by, side]))
    n, x, y = F.col("_n"), F.col("_rank_a"), F.col("_rank_b")
    spread = F.sqrt(F.sum(n * x * x) * F.sum(n * y * y))
    return cells.groupBy(*by).agg(F.try_divide(F.sum(n * x * y), spread).alias("rho"), F.sum("_n").alias("n"))


def krippendorff(pairs: dict[tuple, float]) -> float:
    """T-11: nominal alpha from the coincidence counts of ordered label pairs."""
    total = sum(pairs.values())
    if total <= 1:
        return 1.0
    margins: dict = {}
    for (label, _), count in pairs.items():
        margins[label] = margins.get(label, 0) + count
    expected = (total * total - sum(v * v for v in margins.values())) / (total * (total - 1))
    observed = sum(c for (a, b), c in pairs.items() if a != b) / total
    return 1 - observed / expected if expected else 1.0


def coincidences(labels: DataFrame, unit: str, rater: str, label: str) -> DataFrame:
    """T-11: (l1, l2, weight) over units with two labels or more.

    Per unit and label a count is enough, so that no pair of raters is joined.
    """
    known = labels.where(F.col(label).isNotNull())
    counts = known.groupBy(unit, label).agg(F.count("*").alias("n"))
    sizes = known.groupBy(unit).agg(F.count("*").alias("m")).where("m >= 2")
    per = counts.join(sizes, unit)
    lists = per.groupBy(unit, "m").agg(F.collect_list(F.struct(F.col(label).alias("l"), "n")).alias("ls"))
    one = lists.select("m", "ls", F.explode("ls").alias("x")).select("m", "x", F.explode("ls").alias("y"))
    same = F.col("x.l") == F.col("y.l")
    weight = F.col("x.n") * F.when(same, F.col("y.n") - 1).otherwise(F.col("y.n")) / (F.col("m") - 1)
    return one.select(F.col("x.l").alias("l1"), F.col("y.l").alias("l2"), weight.alias("w")).groupBy("l1", "l2").agg(F.sum("w").alias("weight")).where("weight > 0")


def critical(n: int, alpha: float, two_sided: bool) -> int | None:
    """T-12, T-13: the least number of successes that the exact test at one half rejects above; None if there is none.

    The two-sided test rejects as few successes as failures.
    """
    k = np.arange(n // 2 + 1, min(n, n // 2 + binomial_reach(n, 0.5, 70 - math.log(alpha))) + 1)
    above = np.cumsum(binomial_pmf(k, n, 0.5)[::-1])[::-1]
    hits = np.flatnonzero((2 if two_sided else 1) * above <= alpha * (1 + 1e-12))
    return int(k[hits[0]]) if len(hits) else None


def power_of(n: int, shares, alpha: float = 0.05, two_sided: bool = True) -> np.ndarray:
    """The chance that the test rejects, for each true share."""
    least = critical(n, alpha, two_sided)

    def chance(p: float) -> float:
        reach = binomial_reach(n, p)
        k = np.arange(max(0, int(n * p) - reach), min(n, int(n * p) + reach) + 1)
        return float(binomial_pmf(k[(k >= least) | (two_sided & (k <= n - least))], n, p).sum())

    return np.array([0.0 if least is None else chance(p) for p in np.atleast_1d(np.asarray(shares, float)).tolist()])


def least_detectable(n: int, alpha: float, power: float, two_sided: bool) -> float | None:
    """The share above one half from which the power stays at the target; None if no share reaches it.

    The power grows with the share, so the first share at the target is searched for on ever finer grids.
    """
    if n <= 0 or critical(n, alpha, two_sided) is None:
        return None
    low, high = 0.5, 1.0
    for cells in (1000, 100, 100, 100, 100, 100):
        shares = np.linspace(low, high, cells + 1)
        first = bisect.bisect_left(range(cells + 1), True, key=lambda i: bool(power_of(n, shares[i], alpha, two_sided)[0] >= power))
        if first == 0:
            return float(low) if low > 0.5 else float(shares[1])
        if first > cells:
            return None
        low, high = shares[first - 1], shares[first]
    return float(high)


def detectable_agreement(n: int, alpha: float = 0.05, power: float = 0.8) -> float | None:
    """T-12: smallest agreement that a one-sided exact test detects with the given power."""
    return least_detectable(n, alpha, power, two_sided=False)


def detectable_difference(discordant: int, shared: int, alpha: float = 0.05, power: float = 0.8) -> tuple[float | None, float | None]:
    """T-13: (share of discordant pairs, difference in points) from which power stays at the target."""
    share = least_detectable(discordant, alpha, power, two_sided=True) if shared > 0 else None
    return (None, None) if share is None else (share, 100 * (2 * share - 1) * discordant / shared)


# ---------------------------------------------------------------- a preference head


def solve(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """T-16: the one solution; a matrix without one (collinear features) is refused."""
    if np.linalg.matrix_rank(matrix) < len(matrix):
        raise ValueError("the features are collinear, so the fit has no single answer")
    return np.linalg.solve(matrix, vector)


def head_rows(pairs: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """T-21, T-22, V-02: one row per pair and side chosen: chose_a, weight (raters who chose it), the features' differences.

    pairs: (pair_id, group, a and b: maps); labels: (pair_id, rater, side). Ties and pairs that lack a feature are left out.
    """
    apart = [(F.col("a")[f] - F.col("b")[f]).alias(f) for f in features]
    votes = labels.where(F.col("side").isin("a", "b")).groupBy("pair_id", "side").agg(F.count("*").cast("double").alias("weight"))
    rows = pairs.select("pair_id", "group", *apart).join(votes, "pair_id").na.drop(subset=features)
    return rows.select("pair_id", "group", (F.col("side") == "a").cast("double").alias("chose_a"), "weight", *features)


def _newton_sums(weights: dict, features: list[str], target: str, weight: str, fold: str):
    """Per partition and fold: the gradient and Hessian sums of the other folds' models, as one long row each."""
    import pyarrow as pa

    names = list(weights)
    w = np.array([weights[n] for n in names])

    def run(batches):
        d = len(features) + 1
        sums = np.zeros((len(names), d + d * d))
        for batch in batches:
            frame = batch.to_pandas()
            z = np.c_[frame[features].to_numpy(float), np.ones(len(frame))]
            y, m = frame[target].to_numpy(float), frame[weight].to_numpy(float)
            p = 1 / (1 + np.exp(-np.clip(z @ w.T, -40, 40)))
            use = frame[fold].to_numpy()[:, None] != np.array(names, dtype=object)[None, :]
            sums[:, :d] += ((use * m[:, None]) * (y[:, None] - p)).T @ z
            curve = use * m[:, None] * p * (1 - p)
            sums[:, d:] += np.einsum("if,ij,ik->fjk", curve, z, z).reshape(len(names), -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["model", "sums"])

    return run


def fit_folds(rows: DataFrame, features: list[str], target: str, weight: str, fold: str, strength: float = 1.0, rounds: int = 25) -> dict:
    """T-15, T-18: {fold: weights and intercept} of a ridge logistic regression on all other folds.

    Newton steps on sums: a pass gives each fold's gradient and Hessian, so rows stay where they are and
    the driver holds numbers per fold and feature. The intercept is hardly penalised.
    """
    rows = rows.select(fold, target, weight, *features).persist()
    names = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    d = len(features) + 1
    penalty = np.r_[np.full(d - 1, strength), 1e-8]
    weights = {n: np.zeros(d) for n in names}
    for _ in range(rounds):
        parts = rows.mapInArrow(_newton_sums(weights, features, target, weight, fold), "model int, sums array<double>")
        per = parts.select("model", F.posexplode("sums").alias("i", "x")).groupBy("model", "i").agg(F.sum("x").alias("x")).collect()
        sums = np.zeros((len(names), d + d * d))
        for r in per:
            sums[r.model, r.i] = r.x
        moved = 0.0
        for k, name in enumerate(names):
            step = solve(sums[k, d:].reshape(d, d) + np.diag(penalty), sums[k, :d] - penalty * weights[name])
            weights[name] = weights[name] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    rows.unpersist()
    return weights


def logistic_weights(x: np.ndarray, weight: np.ndarray, target: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """T-15 on arrays: ridge logistic regression by Newton steps; the intercept is fitted, hardly penalised, and dropped."""
    z = np.c_[x, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1], strength), 1e-8]
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = solve((z.T * (weight * p * (1 - p))) @ z + np.diag(penalty), z.T @ (weight * (target - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1]


def out_of_fold(rows: DataFrame, features: list[str], target: str, weight: str, fold: str, strength: float = 1.0) -> DataFrame:
    """T-18, T-20: (id, fold, margin): each row's margin under the model of the other folds; rows carry ``id``."""
    weights = fit_folds(rows, features, target, weight, fold, strength)
    if not weights:
        return rows.select("id", fold, F.lit(None).cast("double").alias("margin"))
    models = rows.sparkSession.createDataFrame([(n, *map(float, w[:-1])) for n, w in weights.items()], ", ".join([f"{fold} {dict(rows.dtypes)[fold]}", *(f"_w_{f} double" for f in features)]))
    margin = sum((F.col(f) * F.col(f"_w_{f}") for f in features), F.lit(0.0))
    return rows.join(F.broadcast(models), fold).select("id", fold, margin.alias("margin"))


def fit_whole(rows: DataFrame, features: list[str], strength: float = 1.0) -> np.ndarray:
    """T-15: the weights of a ridge logistic regression on all rows of :func:`head_rows`, without the intercept."""
    # the model of a fold of its own that no row with a weight belongs to
    other = rows.limit(1).withColumns({"_fold": F.lit("none"), "weight": F.lit(0.0)})
    return fit_folds(rows.withColumn("_fold", F.lit("rows")).unionByName(other), features, "chose_a", "weight", "_fold", strength)["none"][:-1]


def sign_stable(pairs: DataFrame, labels: DataFrame, features: list[str], keep: tuple[str, ...] = (), raters: int = 1000) -> tuple[list[str], list[str]]:
    """T-17: the features that every rater pulls the same way, and those that they don't, both in the given order.

    A model is fitted to each rater's own choices; weights of zero have no sign, a rater without a usable choice says
    nothing. Features in ``keep`` stay whatever their signs. At most ``raters`` raters are compared, more are refused.
    """
    names = [r[0] for r in labels.select("rater").distinct().orderBy("rater").limit(raters + 1).collect()]
    if len(names) > raters:
        raise ValueError(f"more than {raters} raters")
    signs: dict[str, set[float]] = {f: set() for f in features}
    for name in names:
        rows = head_rows(pairs, labels.where(F.col("rater") == name), features)
        if not rows.isEmpty():
            for feature, weight in zip(features, fit_whole(rows, features), strict=True):
                if weight:
                    signs[feature].add(math.copysign(1.0, weight))
    stable = [f for f in features if len(signs[f]) < 2 or f in keep]
    return stable, [f for f in features if f not in stable]


def freeze(pairs: DataFrame, labels: DataFrame, features: list[str], held_out: str, strength: float = 1.0) -> np.ndarray:
    """T-19: weights fitted on all raters but one, so that they never saw its answers."""
    raters = {r[0] for r in labels.select("rater").distinct().collect()}
    if held_out not in raters or len(raters) < 2:
        raise ValueError("the rater to hold out is unknown, or the only one")
    return fit_whole(head_rows(pairs, labels.where(F.col("rater") != held_out), features), features, strength)


def score_frozen(weights: np.ndarray, pairs: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """T-19: agreed, disagreed, agreement with its Wilson interval of frozen weights against one rater's choices."""
    apart = [F.col("a")[f] - F.col("b")[f] for f in features]
    total = sum((d * float(w) for d, w in zip(apart, weights, strict=True)), F.lit(0.0))
    judged = labels.where(F.col("side").isin("a", "b")).join(pairs, "pair_id").withColumn("m", total).where("m IS NOT NULL")
    side = F.when(F.col("m") > 0, "a").otherwise("b")
    n, agreed = F.count("*"), F.count_if(side == F.col("side"))
    low, high = wilson_columns(F.col("agreed"), F.col("n"))
    return judged.agg(agreed.alias("agreed"), n.alias("n")).select("agreed", (F.col("n") - F.col("agreed")).alias("disagreed"), F.try_divide("agreed", "n").alias("agreement"), low.alias("low"), high.alias("high"))


def margin(weights: list[float], a: Column, b: Column) -> Column:
    """T-20: weighted sum of a pair's feature differences (arrays); null if a feature is missing (T-21)."""
    difference = F.zip_with(a, b, lambda x, y: x - y)
    total = F.aggregate(F.zip_with(difference, F.array(*map(F.lit, weights)), lambda d, w: d * w), F.lit(0.0), lambda s, v: s + v)
    return F.when(~F.exists(difference, lambda d: d.isNull()), total)
