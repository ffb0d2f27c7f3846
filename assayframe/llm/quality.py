"""Quality rules: text statistics, fixed rules, and robust multivariate outliers per language and source.

All of it is DataFrame expressions. The statistics never leave the document's row: repeated word windows are found by
sorting an array of windows inside the row, not by exploding words into a shuffle. What is estimated per group
are sums over the small table of statistics, combined before the shuffle, so that a source with a third of all rows is
one key of an aggregation and nothing else.

The outlier rule is the minimum covariance determinant of each group of language and source. Concentration
steps take the share `SUPPORT` of rows with the smallest Mahalanobis distance and estimate mean and
covariance anew, each of which lowers the determinant. They start from three places (the coordinatewise medians with the least spreads, the same with
the variances of all rows, and mean and covariance of all rows), go on until no step lowers the determinant any more, and the
smallest determinant of the three wins. Distances are ranked by counting them in fine logarithmic bins, which is the same
for any order of rows and needs no sort of a group. Statistics are fixed-point integers, so the sums, too,
don't depend on the order of rows. Clean groups have statistics that are all zero, and small groups have few rows; `FLOORS` is added to the
standard deviations, which keeps every group's covariance regular, down to groups of one row, which is never an outlier of itself.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, let, table

SYMBOLS = "#*$%&|<>"
#: Rows of a group that the estimate rests on.
SUPPORT = 0.75
#: A step that lowers the determinant by a smaller share was the last.
LEAST_GAIN = 1e-6
#: Smallest standard deviations of the four transformed statistics.
FLOORS = (0.06, 0.06, 0.2, 0.15)
#: The chi-square quantile of 0.9999 at four degrees of freedom.
CUTOFF = 23.512742
SCALE = 1 << 16
BINS_PER_E = 64
P = len(FLOORS)
PAIRS = list(combinations_with_replacement(range(P), 2))


def _consistency(support: float) -> float:
    """What makes the covariance of the central part consistent for normal data of P = 4 dimensions."""

    def cdf(x: float, half: int) -> float:  # chi-square with 2 * half degrees of freedom
        return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))

    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, P // 2) < support else (low, mid)
    return support / cdf(low, P // 2 + 1)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in words. Windows are sorted by hash, then by their words, and those are compared."""

    def covered(s: Column) -> Column:
        same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        again = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total"))
        return F.aggregate(at, start, step, lambda acc: acc["total"])

    def windows(w: Column) -> Column:
        of = lambda i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(*of(i)).alias("h"), *[x.alias(n) for x, n in zip(of(i), "abc", strict=True)], i.alias("i")))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows(words)), covered))


def statistics_of(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long) of a text that is not null."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    of_words = let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("x")),
        lambda s: F.struct(
            s["w"]["n_words"].alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            s["x"]["n_dup_lines"].alias("n_dup_lines"),
            s["x"]["n_lines"].alias("n_lines"),
            s["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def _failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _vector(s: Column) -> list[Column]:
    """The transformed statistics as fixed-point numbers; only of rows that have words."""
    share = lambda a, b: s[a] / F.greatest(s[b], F.lit(1).cast("long"))
    raw = [F.log(F.greatest(share("word_chars", "n_words"), F.lit(1.0))), F.sqrt(share("n_symbols", "word_chars")), F.sqrt(share("n_dup_lines", "n_lines")), F.sqrt(share("n_repeat_words", "n_words"))]
    return [F.round(x * SCALE).cast("long") for x in raw]


def _cholesky(cov: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    """The lower factor, written out as expressions."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(P):
        for j in range(i + 1):
            rest = cov[j, i]
            for k in range(j):
                rest = rest - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(rest) if i == j else rest / low[j, j]
    return low


def _determinant(cov: dict[tuple[int, int], Column]) -> Column:
    low = _cholesky(cov)
    return math.prod((low[i, i] * low[i, i] for i in range(1, P)), start=low[0, 0] * low[0, 0])


def _distance(x: list[Column], mean: list[Column], cov: dict[tuple[int, int], Column]) -> Column:
    """The squared Mahalanobis distance, by forward substitution."""
    low = _cholesky(cov)
    y: list[Column] = []
    for i in range(P):
        d = x[i] - mean[i]
        for k in range(i):
            d = d - low[i, k] * y[k]
        y.append(d / low[i, i])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _binned(distance: Column) -> Column:
    return F.least(F.floor(F.log1p(distance) * BINS_PER_E), F.lit(4095)).cast("int")


def _reach(counts: DataFrame, group: list[str], bin_col: str, share: float) -> DataFrame:
    """Per group the first bin at which `share` of the rows are reached. counts (group, bin, n) has a bounded number of bins."""
    w = Window.partitionBy(*group).orderBy(bin_col)
    total = F.sum("n").over(Window.partitionBy(*group))
    return counts.withColumn("up_to", F.sum("n").over(w)).withColumn("total", total).where(F.col("up_to") >= F.ceil(F.col("total") * share)).groupBy(*group).agg(F.min(bin_col).alias("reach"))


_X = [f"x{i}" for i in range(P)]
_M = [f"m{i}" for i in range(P)]
_C = {p: f"c{p[0]}{p[1]}" for p in PAIRS}
_STATE = ["grp", "start", *_M, *_C.values()]


def _sums() -> list[Column]:
    """Row count, sums and sums of products of x0..x3, exact."""
    return [F.count("*").alias("n"), *[F.sum(F.col(x).cast("decimal(20,0)")).alias(f"s{i}") for i, x in enumerate(_X)], *[F.sum((F.col(_X[i]) * F.col(_X[j])).cast("decimal(20,0)")).alias(f"s{i}{j}") for i, j in PAIRS]]


def _moments(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean and covariance, times factor and with the floors added, from summed-up rows of _sums()."""
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c)
    total = sums.groupBy(*keys).agg(F.sum("n").alias("n"), *[whole(f"s{i}") for i in range(P)], *[whole(f"s{i}{j}") for i, j in PAIRS])
    m = [F.col(f"s{i}") / F.col("n") / SCALE for i in range(P)]
    c = {(i, j): factor * (F.col(f"s{i}{j}") / F.col("n") / SCALE / SCALE - m[i] * m[j]) + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    return total.select(*keys, *[m[i].alias(_M[i]) for i in range(P)], *[c[p].alias(_C[p]) for p in PAIRS])


def _starts(rows: DataFrame) -> DataFrame:
    """Three states (grp, start, m0..m3, c00..c33) for each group."""
    # the median of each coordinate, by counting values in 1/256
    coarse = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(x) / (SCALE // 256)).alias("v")) for i, x in enumerate(_X)])).alias("k")).groupBy("grp", "k.dim", "k.v").agg(F.count("*").alias("n"))
    medians = _reach(table(coarse, "coarse"), ["grp", "dim"], "v", 0.5).groupBy("grp").agg(*[F.max(F.when(F.col("dim") == i, (F.col("reach") + 0.5) / 256)).alias(f"med{i}") for i in range(P)])
    every = _moments(rows.groupBy("grp").agg(*_sums()), ["grp"], 1.0).join(medians, "grp")
    narrow = {p: F.lit(FLOORS[p[0]] ** 2 if p[0] == p[1] else 0.0) for p in PAIRS}
    spread = {p: F.col(_C[p]) if p[0] == p[1] else F.lit(0.0) for p in PAIRS}
    own = {p: F.col(_C[p]) for p in PAIRS}
    state = lambda k, centre, cov: F.struct(F.lit(k).alias("start"), *[F.col(f"{centre}{i}").alias(_M[i]) for i in range(P)], *[cov[p].alias(_C[p]) for p in PAIRS])
    return every.select("grp", F.inline(F.array(state(0, "med", narrow), state(1, "med", spread), state(2, "m", own)))).select(*_STATE)


def _concentrated(rows: DataFrame, states: DataFrame, name: str) -> DataFrame:
    """One concentration step of each state; adds det, the new determinant."""
    mean, cov = [F.col(m) for m in _M], {p: F.col(c) for p, c in _C.items()}
    near = rows.join(states, "grp").select("grp", "start", *_X, _binned(_distance([F.col(x) / SCALE for x in _X], mean, cov)).alias("bin"))
    # sums by bin, at most 4096 rows for each state, written once: its reach and its estimates come from these
    by_bin = table(near.groupBy("grp", "start", "bin").agg(*_sums()), f"{name}-bins")
    reach = _reach(by_bin.select("grp", "start", "bin", "n"), ["grp", "start"], "bin", SUPPORT)
    found = _moments(by_bin.join(reach, ["grp", "start"]).where("bin <= reach"), ["grp", "start"], _consistency(SUPPORT))
    return table(found.withColumn("det", _determinant({p: F.col(c) for p, c in _C.items()})), name)


def estimates(rows: DataFrame) -> DataFrame:
    """rows (grp, x0..x3 long): per grp m0..m3 and c00..c33 of the subset with the least determinant that the starts lead to, the floors included."""
    active = _concentrated(rows, table(_starts(rows), "mcd-starts"), "mcd-1")
    settled, step = [], 1
    while not active.isEmpty():
        step += 1
        new = _concentrated(rows, active.drop("det"), f"mcd-{step}")
        both = new.join(active.select("grp", "start", F.col("det").alias("old")), ["grp", "start"])
        going = table(both.where(F.col("det") < F.col("old") * (1 - LEAST_GAIN)).drop("old"), f"mcd-{step}-on")
        settled.append(active.join(going, ["grp", "start"], "left_anti"))
        active = going
    best = F.min_by(F.struct(*_M, *_C.values()), F.struct("det", "start"))
    every = reduce(DataFrame.unionAll, settled) if settled else active
    return table(every.groupBy("grp").agg(best.alias("s")).select("grp", "s.*"), "mcd")


def _group(lang: Column, source: Column) -> Column:
    """The key of a language and source; JSON tells a null from an empty string."""
    return F.to_json(F.struct(lang.cast("string").alias("lang"), source.cast("string").alias("source")))


def _rated(text: Column, lang: Column, source: Column) -> Column:
    """struct of grp, stats, failed and x0..x3 of a row, the statistics evaluated once."""
    counted = statistics_of(F.coalesce(text.cast("string"), F.lit("")))
    return let(counted, lambda s: F.struct(_group(lang, source).alias("grp"), s.alias("stats"), _failed(s).alias("failed"), *[x.alias(n) for x, n in zip(_vector(s), _X, strict=True)]))


def _judged(rows: DataFrame) -> DataFrame:
    """rows (grp, failed, x0..x3, and others), stored ones: adds distance and kept, drops the helpers."""
    fitted = estimates(rows.where(~F.col("failed")).select("grp", *_X))
    distance = _distance([F.col(x) / SCALE for x in _X], [F.col(m) for m in _M], {p: F.col(c) for p, c in _C.items()})
    out = rows.join(fitted, "grp", "left").withColumn("distance", F.when(~F.col("failed"), distance))
    return out.withColumn("kept", ~F.col("failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).drop("grp", *_X, *_M, *_C.values())


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed, distance, kept), a row for each row of docs.

    A null text counts as empty and fails the base rules. A null language or source is a group of its own. A group of any size, one row included, is judged
    by its own estimate. Repeated rows are judged alike, each on its own row. Other columns of docs, whatever their names, are ignored. An empty table
    gives an empty result. A long text is sorted within its row, in memory in proportion. distance is null where the base rules failed.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.inline(F.array(_rated(docs[text_col], docs[lang_col], docs[source_col]))))
    return _judged(table(own, "rated").select("doc_id", "stats.*", "grp", "failed", *_X)).withColumnRenamed("failed", "base_failed")


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs, with its columns, that pass. Cases are those of judge(); columns of any name are handed through.

    The rows are written once with their statistics; the estimate reads these columns only.
    """
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    # inline() makes the struct's fields columns of one evaluation; extracting them one by one could compute it for each
    rated = table(docs.select(whole, F.inline(F.array(_rated(docs[text_col], docs[lang_col], docs[source_col])))).drop("stats"), "rated")
    return _judged(rated).where("kept").select("doc.*")
