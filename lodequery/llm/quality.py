"""Quality rules with risk-controlled thresholds.

Every rule scores a document (higher is worse) and has a fixed grid of cutoffs. Some of the
labelled documents, a quarter by hash and from all strata together, choose a path: joint settings of all
rules, each a little stricter than the one before, first those that reject most bad documents for
each good one. All other labelled documents are the holdout. In each stratum the settings are
tested on it in the path's order: the null hypothesis that a setting rejects more than ALPHA of
the good documents is refuted by an exact binomial tail, and the first setting that can't be
refuted ends the sequence, which keeps its error without further correction (fixed sequence). The
level is DELTA over the number of strata (Bonferroni). So with probability 1 - DELTA no stratum
loses more than ALPHA of its good documents to all rules together. Among the settings that hold,
the one that rejects most bad documents, each good one counting COST times, is used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, text_of

ALPHA = 0.02
DELTA = 0.05
COST = 4.0
#: One of PATH_PART labelled documents chooses the path, all others are the holdout.
PATH_PART = 4
SYMBOLS = "#*$%&|<>"

#: Cutoffs by rule, mildest first. A score above the cutoff rejects.
GRID = {
    "symbols": [0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "repeated_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeated_words": [0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.13, 0.12, 0.11, 0.1, 0.08, 0.06, 0.05, 0.04],
    "capitals": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1],
    "exclaiming": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05],
    "long_words": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0],
    "few_words": [-10.0, -11.0, -12.0, -13.0, -14.0, -15.0, -17.0, -20.0],
}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    key, top = code[:n].copy(), len(ids)
    for k in range(1, width):  # exact: keys are numbered anew before they could overflow
        if top * len(ids) >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            top = len(values)
        key = key * len(ids) + code[k : k + n]
        top *= len(ids)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' scores of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII spaces only
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    codes = np.frombuffer(raw, np.uint8)
    capitals = int(((codes >= 65) & (codes <= 90)).sum())
    small = int(((codes >= 97) & (codes <= 122)).sum())
    scores = [
        symbols / max(1, word_chars),
        dup_lines / max(1, len(lines)),
        repeats / max(1, n),
        capitals / max(1, capitals + small),
        text.count("!") / max(1, n),
        word_chars / max(1, n),
        -float(n),
    ]
    return n, word_chars, symbols, dup_lines, repeats, scores


FEATURES = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, bins array<int>, mark long"


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Base counts and, for each rule, how many of its cutoffs the document exceeds."""
    grids = [np.array([-g for g in grid]) for grid in GRID.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for text in batch.column(2):
                n, chars, symbols, lines, repeats, scores = measure(text.as_py())
                # cutoffs below the score: in the negated grid, which ascends, values above the negated score
                bins = [len(g) - int(np.searchsorted(g, -s, side="right")) for g, s in zip(grids, scores, strict=True)]
                for out, value in zip(rows, (n, chars, symbols, lines, repeats, n < 10 or 100 * repeats > 20 * n, bins), strict=True):
                    out.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True)), batch.column(3)], names=names)

    group = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("stratum"), text_of().alias("text"), F.xxhash64(text_of()).alias("mark")).mapInArrow(run, FEATURES)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1.0 - p
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, p)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function for x <= (a + 1) / (a + b + 2), by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h, m = d, 1
    while m < 1_000_000:
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-13:
            break
        m += 1
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return min(1.0, front * h / a)


def least_good(level: float, alpha: float) -> int:
    """Good documents a stratum needs for its mildest setting to hold at all."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def choose_path(bins: np.ndarray, good: np.ndarray, cost: float = COST, many: np.ndarray | None = None) -> list[list[int]]:
    """Joint settings from mild to strict; of each rule the number of cutoffs that a document must exceed to be rejected.

    bins (documents, rules), good (documents), and if rows stand for several documents, how many. Each step tightens the one rule by whose next
    cutoffs most bad documents go for each good one, until no rule rejects more bad ones at least at cost.
    """
    sizes = [len(g) for g in GRID.values()]
    now, path, left = [n + 1 for n in sizes], [], np.ones(len(good), bool)
    many = np.ones(len(good), np.int64) if many is None else many
    while True:
        best, found = 0.0, None
        for r, top in enumerate(now):
            # documents left by how many cutoffs they exceed, and with every larger number
            of = [np.bincount(bins[rows, r], many[rows], sizes[r] + 1)[::-1].cumsum()[::-1] for rows in (left & ~good, left & good)]
            for cut in range(top - 1, 0, -1):
                caught, lost = int(of[0][cut]), int(of[1][cut])
                if caught and caught > cost * lost and (worth := caught / (lost + 0.5)) > best:
                    best, found = worth, (r, cut)
        if found is None:
            return path
        r, cut = found
        left &= bins[:, r] < cut
        now = [*now[:r], cut, *now[r + 1 :]]
        path.append(now)


def first_steps(path: list[list[int]]) -> list[list[int]]:
    """By rule and number of exceeded cutoffs, the first step of the path, from 1, that rejects; else one past the last."""
    none = len(path) + 1
    return [[next((t for t, cuts in enumerate(path, 1) if j >= cuts[r]), none) for j in range(len(grid) + 1)] for r, grid in enumerate(GRID.values())]


def select_step(good: list[int], bad: list[int], level: float, alpha: float = ALPHA, cost: float = COST) -> int:
    """The step that a stratum uses, 0 for none. good and bad: holdout documents by the first step that rejects them, from step 1; then those that none does."""
    n, lost, caught, best, worth = sum(good), 0, 0, 0, 0.0
    for step in range(1, len(good)):
        lost += good[step - 1]
        caught += bad[step - 1]
        if not n or binomial_tail(lost, n, alpha) > level:
            break
        if caught - cost * lost > worth:
            best, worth = step, caught - cost * lost
    return best


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Features with `failed`, the rules that reject a document, and `kept`.

    labels (doc_id, quality): 1 good, 0 bad, null unknown; documents labelled more than once count
    as good if any label says so. Documents that fail the base rules aren't part of the holdout,
    and equal texts of a stratum count once in it (near copies each, so they are best dropped
    before). A null or empty text fails for its few words; very long texts are judged whole.
    Without labels, or in strata with too few, only the base rules reject. Rows that are repeated
    are judged alike; an empty table gives an empty one; other columns, whatever their names, aren't read.
    """
    table = materialise(features(docs, stratum), "quality")
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    labelled = table.filter(~F.col("base_failed")).join(known, "doc_id").groupBy("stratum", "mark").agg(F.max("quality").alias("quality"), F.first("bins").alias("bins"))
    part = F.pmod(F.xxhash64("mark", F.lit(PATH_PART)), F.lit(PATH_PART))
    # all of the path's documents, as counts of the settings they exceed: 5 bits for each rule
    key = F.aggregate("bins", F.lit(0).cast("long"), lambda k, j: k * 32 + j)
    fitted = labelled.filter(part == 0).groupBy(key.alias("key"), (F.col("quality") > 0).alias("good")).count().toArrow()
    keys, good, many = (fitted.column(c).to_numpy() for c in ("key", "good", "count"))
    bins = keys[:, None] >> (5 * np.arange(len(GRID) - 1, -1, -1)) & 31
    path = choose_path(bins.astype(np.int64), good.astype(bool), many=many)
    lookup = F.array(*[F.array(*map(F.lit, steps)) for steps in first_steps(path)])
    steps = F.transform("bins", lambda j, r: F.get(F.get(lookup, r), j))
    held = labelled.filter(part != 0).select("stratum", "quality", F.array_min(steps).alias("step"))
    bins = range(1, len(path) + 2)
    counted = held.groupBy("stratum").agg(
        F.array(*[F.count_if((F.col("quality") > 0) & (F.col("step") == t)) for t in bins]).alias("good"),
        F.array(*[F.count_if((F.col("quality") <= 0) & (F.col("step") == t)) for t in bins]).alias("bad"),
    )
    counted = materialise(counted, "quality-strata")
    # strata too small for any setting are known from their size alone and aren't tested
    tested = counted.filter(F.aggregate("good", F.lit(0).cast("long"), lambda s, x: s + x) >= least_good(delta, alpha))
    level = delta / max(1, tested.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [select_step(g, b, level, alpha) for g, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.int32())], names=["stratum", "chosen"])

    judged = table.join(tested.mapInArrow(run, "stratum string, chosen int"), "stratum", "left")
    failing = F.transform(steps, lambda t, r: F.when(t <= F.col("chosen"), F.get(F.array(*[F.lit(x) for x in GRID]), r)))
    failed = F.when(F.col("chosen").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(failing))
    return judged.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("chosen", "bins", "mark")
