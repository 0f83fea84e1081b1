"""N-gram Jaccard join: documents whose sets of word n-grams are alike, as connected components.

The overlap counts of all documents are the product of the sparse document by n-gram incidence
matrix with its transpose. Only the columns that can matter are multiplied: under one order of
all n-grams (common ones last), two sets that are alike share one of each other's first
n - ceil(t * n) + 1 n-grams, a bound on each document's part of the matrix from its size alone.
The product runs in blocks of columns: a block's rows of one n-gram are multiplied with those of
like size, counts are summed by pair, and pairs whose count can't reach what their sizes ask are
dropped. What is left is verified on whole sets.

Equal sets are one row of the matrix. Sets are first compared with pivots with which they share a
min-hash pair. That links most near copies, and sets that are at least FAMILY percent alike to a
pivot form families, whose members crowd around the threshold. Within a family the product runs
in tiles of documents by documents: a task loads two blocks of whole sets, accumulates their
overlap counts, drops the cells below what the sizes ask, and writes a spanning forest of what is
left. Blocks of one component aren't multiplied with each other. The product by columns then skips
pairs of one family, so no table holds the pairs of a group. Nothing is capped: all pairs that
aren't connected yet are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, drop_scratch, materialise, parts_for, text_of
from .simhash import scramble

SIZE = 4
PERCENT = 85
#: The most common n-grams, at most MOST_COMMON and none of fewer than 2 ** LEAST_COMMON sets, come last in the order of all n-grams.
LEAST_COMMON = 3
MOST_COMMON = 4_000_000
#: Likeness to a pivot that makes a set a member of its family, and the bounds of a block of a family's sets.
FAMILY = 30
BLOCK_SETS, BLOCK_NGRAMS = 1024, 2_000_000
#: Cells and counts that a task multiplies at once.
CELLS, COUNTS = 4_000_000, 20_000_000
#: N-grams that a task gathers before it reports them, and code points of text whose n-grams one task counts.
CHUNK = 1_500_000
RANGE_CHARS = 24_000_000
#: Salts of the min-hash pairs that tie a document to a pivot.
SALTS = tuple(k * 0x5BD1E995A7C15D3B & (1 << 64) - 1 for k in range(8))
#: Words of the fixed-size bitmap that thins the table read for verification.
BITMAP = 1 << 17
REMEMBERED = 300_000


class Shingler:
    """The sorted distinct 64-bit hashes of a text's word n-grams; a shorter text is one n-gram."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.known: dict[bytes, int] = {}

    def hash(self, word: bytes) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
        if not words:
            return np.empty(0, np.uint64)
        known, find = self.known, self.hash
        one = np.fromiter((known.get(w) or find(w) for w in words), np.uint64, len(words))
        width = min(self.size, len(words))
        n = len(words) - width + 1
        key = np.full(n, width, np.uint64)
        for k in range(width):
            key = scramble(key * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n])
        return np.unique(key)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed halves."""
    raw = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with any set it links with."""
    return -(-percent * n // 100)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): mark, a hash of the text, tells rows apart whose ids are null or repeated."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("mark"))


def _sets(docs: DataFrame, size: int, ranges: int) -> DataFrame:
    """Rows (doc_id, mark, n, hi, lo) of all documents and, with null n, rows (range, first, gaps): the n-grams of a chunk's distinct sets.

    Of an n-gram's hash the upper 32 bits are kept, sorted within ranges of values and written as
    the gaps between them, 2 bytes each where the chunk is large.
    """
    schema = "doc_id long, mark long, n long, hi long, lo long, range int, first long, gaps binary"
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(size)
        chunk: dict[tuple[int, int], np.ndarray] = {}
        total = 0

        def held() -> pa.RecordBatch:
            values = np.sort(upper(np.concatenate(list(chunk.values())))).astype(np.int64)
            chunk.clear()
            edges = np.searchsorted(values, [-(-(r << 32) // ranges) for r in range(ranges + 1)])
            at, first, gaps = [], [], []
            for r in np.flatnonzero(np.diff(edges)):
                part = values[edges[r] : edges[r + 1]]
                gap = np.diff(part)
                at.append(int(r))
                first.append(int(part[0]))
                gaps.append(b"2" + gap.astype(np.uint16).tobytes() if not len(gap) or gap.max() < 1 << 16 else b"4" + gap.astype(np.uint32).tobytes())
            gone = pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([gone, gone, gone, gone, gone, pa.array(at, kinds[5]), pa.array(first, kinds[6]), pa.array(gaps, kinds[7])], names=names)

        for batch in batches:
            out = []
            for text in batch.column(1):
                hashes = make(text.as_py())
                key = set_key(hashes) if len(hashes) else (None, None)
                out.append((len(hashes), *key))
                if len(hashes) and key not in chunk:
                    chunk[key] = hashes
                    total += len(hashes)
                if total >= CHUNK:
                    yield held()
                    total = 0
            if out:
                gone = [pa.nulls(len(out), k) for k in kinds[5:]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=False)), *gone], names=names)
        if chunk:
            yield held()

    return materialise(_rows(docs).mapInArrow(run, schema), "ngram-sets")


def upper(hashes: np.ndarray) -> np.ndarray:
    """What the common order knows of an n-gram: the upper half of its hash."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _common(chunks: DataFrame) -> np.ndarray:
    """The common n-grams, sorted: all in 2 ** k sets or more, for the least k from LEAST_COMMON on that leaves at most MOST_COMMON."""

    def count(table: pa.Table) -> pa.Table:
        parts = []
        for first, gaps in zip(table.column("first").to_pylist(), table.column("gaps"), strict=True):
            raw = gaps.as_py()
            gap = np.frombuffer(raw[1:], np.uint16 if raw[:1] == b"2" else np.uint32).astype(np.int64)
            parts.append(first + np.concatenate([[0], np.cumsum(gap)]))
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        level = np.log2(n).astype(np.int64)
        found = [(k, values[level == k].astype(np.uint32)) for k in range(LEAST_COMMON, 64) if (level == k).any()]
        return pa.table({"level": pa.array([k for k, _ in found], pa.int32()), "n": pa.array([len(v) for _, v in found], pa.int64()), "often": pa.array([v.tobytes() for _, v in found], pa.binary())})

    found = materialise(chunks.groupBy("range").applyInArrow(count, "level int, n long, often binary"), "ngram-common")
    least, total = 64, 0
    for level, n in sorted(found.groupBy("level").agg(F.sum("n")).collect(), reverse=True):
        total += n
        if total > MOST_COMMON:
            break
        least = level
    packed = found.filter(F.col("level") >= least).select("often").collect()
    drop_scratch(found)
    return np.sort(np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(r[0], np.uint32) for r in packed)]))


def star_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set, each of two of its n-grams: the least and the greatest two under each salted order.

    Sets of likeness J agree on a key with probability near J squared, so near copies meet several
    pivots, while sets that share only a passage seldom meet any.
    """
    out = []
    for salt in SALTS:
        order = scramble(hashes ^ np.uint64(salt))
        if len(order) > 4:
            order = np.partition(order, (0, 1, len(order) - 2, len(order) - 1))
        else:
            order = np.sort(order)
        out += [order[0], order[min(1, len(order) - 1)], order[-1], order[max(-2, -len(order))]]
    pairs = np.array(out, np.uint64).reshape(-1, 2)
    return scramble(scramble(pairs[:, 0]) * np.uint64(3) + scramble(pairs[:, 1]) + np.arange(1, len(pairs) + 1, dtype=np.uint64))


def _prefixes(docs: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """(key, n, hi, lo, star) of every set, each set once a task: its first n-grams under the common order, and its star keys."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    schema = "key long, n long, hi long, lo long, star boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, last = Shingler(size), set(), shared.value
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            parts, n, hi, lo, lengths, stars = [], [], [], [], [], []
            for text in batch.column(1):
                hashes = make(text.as_py())
                if not len(hashes) or (key := set_key(hashes)) in seen:
                    continue
                seen.add(key)
                keys = star_keys(hashes)
                first = len(hashes) - needed(len(hashes), percent) + 1
                if len(last):
                    known = upper(hashes)
                    late = last[np.minimum(np.searchsorted(last, known), len(last) - 1)] == known
                    hashes = np.concatenate([hashes[~late], hashes[late]])
                parts += [keys, hashes[:first]]
                n.append(len(hashes))
                hi.append(key[0])
                lo.append(key[1])
                lengths.append(first + len(keys))
                stars.append(np.arange(first + len(keys)) < len(keys))
            if parts:
                spread = lambda x: pa.array(np.repeat(np.array(x, np.int64), lengths))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), spread(n), spread(hi), spread(lo), pa.array(np.concatenate(stars))], names=names)

    return _rows(docs).mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of the first column, many runs at once; rows are sorted by it."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
        if cut:
            yield [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield held


def _shared(postings: DataFrame, percent: int) -> DataFrame:
    """Postings of keys that two sets or more hold; those of star keys with a pivot of like size (pivots with the pivot before), the others without."""
    schema = "shingle long, n long, hi long, lo long, pivot_n long, pivot_hi long, pivot_lo long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for key, n, hi, lo, star in _runs(batches):
            same = key[1:] == key[:-1]
            fresh = np.append(True, ~(same & (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])))  # sets that several tasks posted
            key, n, hi, lo, star = (x[fresh] for x in (key, n, hi, lo, star))
            same = key[1:] == key[:-1]
            keep = np.flatnonzero(np.append(False, same) | np.append(same, False))
            key, n, hi, lo, star = (x[keep] for x in (key, n, hi, lo, star))
            pivot = np.full(len(key), -1)
            now = -1
            for i in np.flatnonzero(star):
                if now >= 0 and key[now] == key[i]:
                    pivot[i] = now
                if pivot[i] < 0 or 100 * n[now] < percent * n[i]:
                    now = i  # the pivot of larger sets, itself compared with the one before
            has = pivot >= 0
            out = has | ~star
            if out.any():
                gone = lambda x: pa.array(np.where(has, x[np.maximum(pivot, 0)], 0)[out], mask=~has[out])
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, n, hi, lo)] + [gone(n), gone(hi), gone(lo)], names=names)

    parts = max(8, int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return postings.repartition(parts, "key").sortWithinPartitions("key", "n", "hi", "lo").mapInArrow(run, schema)


PAIR = ["a_n", "a_hi", "a_lo", "b_n", "b_hi", "b_lo"]


def _product(rows: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """(pair, overlap): counts of shared columns, of pairs of like size in different families.

    rows (shingle, n, hi, lo, c): c is the family. A block of a column's rows is
    multiplied with the rows of like size that follow, at most block * block cells at once.
    """
    schema = ", ".join(f"{x} long" for x in PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(a: np.ndarray, b: np.ndarray, n, hi, lo) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (n[a], hi[a], lo[a], n[b], hi[b], lo[b])], names=PAIR)

        for shingle, n, hi, lo, c in _runs(batches):
            edges = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
            ends = np.append(edges[1:], len(shingle))
            left, right, held = [], [], 0
            for s, e in zip(edges, ends, strict=True):
                if e - s < 2 or (c[s:e] == c[s]).all():
                    continue
                for i in range(s, e, block):
                    rows_i = np.arange(i, min(i + block, e))
                    # sizes ascend: only rows up to the largest size that any row of the block links with
                    stop = s + int(np.searchsorted(n[s:e], 100 * n[rows_i[-1]] // percent, side="right"))
                    for j in range(i, stop, block):
                        rows_j = np.arange(j, min(j + block, stop))
                        cells = (rows_i[:, None] < rows_j[None, :]) & (100 * n[rows_i][:, None] >= percent * n[rows_j][None, :]) & (c[rows_i][:, None] != c[rows_j][None, :])
                        x, y = np.nonzero(cells)
                        left.append(rows_i[x])
                        right.append(rows_j[y])
                        held += len(x)
                        if held >= 100_000:
                            yield pairs(np.concatenate(left), np.concatenate(right), n, hi, lo)
                            left, right, held = [], [], 0
            if held:
                yield pairs(np.concatenate(left), np.concatenate(right), n, hi, lo)

    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.select("shingle", "n", "hi", "lo", "c").repartition(parts, "shingle").sortWithinPartitions("shingle", "n", "hi", "lo")
    # a pair's order follows sizes, then keys: the same in every column
    counts = ordered.mapInArrow(run, schema).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("overlap"))
    least = lambda n: F.floor((F.lit(percent) * n + 99) / 100)
    a, b = F.col("a_n"), F.col("b_n")
    asked = F.ceil(F.lit(percent) * (a + b) / (100 + percent))
    return counts.filter(F.col("overlap") + F.greatest(least(a), least(b)) - 1 >= asked)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).union(pairs.select("b_hi", "b_lo")).distinct()


def _loaded(docs: DataFrame, classes: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """(hi, lo, hashes) of the sets in ends. Only documents that stand for such a set are read beyond their id, or of those without an id the text's hash.

    A bitmap of fixed size thins the documents first; rows that pass it by chance go at the join.
    """
    stand = classes.join(ends, ["hi", "lo"]).select("hi", "lo", F.coalesce("first", "mark").alias("key"))
    slot = F.pmod(F.xxhash64("key"), F.lit(BITMAP * 64))
    word = F.floor(slot / 64).cast("long")
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key), {BITMAP * 64}) % 64 as int))")
    bitmap = stand.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))  # at most BITMAP rows
    rows = _rows(docs).withColumn("key", F.coalesce("doc_id", "mark"))
    thin = rows.join(F.broadcast(bitmap), word == F.col("_word")).filter(F.col("_bits").bitwiseAND(bit) != 0).select("key", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(size)
        for batch in batches:
            ids, hi, lo, raw = [], [], [], []
            for row_key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = make(text.as_py())
                if len(hashes):
                    key = set_key(hashes)
                    ids.append(row_key)
                    hi.append(key[0])
                    lo.append(key[1])
                    raw.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(raw, pa.binary())], names=["key", "hi", "lo", "hashes"])

    return thin.mapInArrow(sets, "key long, hi long, lo long, hashes binary").join(stand, ["key", "hi", "lo"], "left_semi").dropDuplicates(["hi", "lo"]).select("hi", "lo", "hashes")


def _verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a_hi, a_lo, b_hi, b_lo, links) of the pairs whose whole sets link or are of one family.

    A set that is the first of many pairs is dealt by its partners' hashes, one copy a part.
    """
    parts = max(8, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.select("a_hi", "a_lo", "b_hi", "b_lo", F.pmod(F.xxhash64("b_hi", "b_lo"), F.lit(parts)).alias("part"))
    a = sets.select(F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("hashes").alias("a"))
    a = dealt.select("a_hi", "a_lo", "part").distinct().join(a, ["a_hi", "a_lo"])
    b = sets.select(F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), F.col("hashes").alias("b"))
    joined = dealt.join(b, ["b_hi", "b_lo"]).join(a, ["a_hi", "a_lo", "part"]).select("a_hi", "a_lo", "b_hi", "b_lo", "a", "b")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, links = [], []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                links.append(100 * both >= percent * (len(p) + len(q) - both))
                keep.append(links[-1] or 100 * both >= FAMILY * (len(p) + len(q) - both))
            out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(links, pa.bool_())], names=["a_hi", "a_lo", "b_hi", "b_lo", "links"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(link, "a_hi long, a_lo long, b_hi long, b_lo long, links boolean")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """The product of two blocks of sets, some rows of left at a time: (first row, overlap counts)."""
    values = np.concatenate(right)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(right)), [len(x) for x in right])[order]
    most = max(1, CELLS // len(right))
    i = 0
    while i < len(left):
        spans, total, stop = [], 0, i
        while stop < len(left) and stop - i < most and (stop == i or total < COUNTS):
            lo, hi = np.searchsorted(values, left[stop], "left"), np.searchsorted(values, left[stop], "right")
            spans.append((lo, hi - lo))
            total += int(spans[-1][1].sum())
            stop += 1
        counts = np.zeros((stop - i, len(right)), np.int64)
        for row, (lo, n) in enumerate(spans):
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(lo, n)
            counts[row] = np.bincount(owner[at], minlength=len(right))
        yield i, counts
        i = stop


def tile_links(left: list[np.ndarray], right: list[np.ndarray], left_c: np.ndarray, right_c: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, over the components so far, of the links of two blocks of sets."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    for i, counts in overlaps(left, right):
        size = a[i : i + len(counts), None] + b[None, :]
        x, y = np.nonzero((counts * (100 + percent) >= percent * size) & (left_c[i : i + len(counts), None] != right_c[None, :]))
        for p, q in zip((x + i).tolist(), y.tolist(), strict=True):
            u, v = find(int(left_c[p])), find(int(right_c[q]))
            if u != v:
                root[u] = v
                out.append((p, q))
    return out


def _families(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a_hi, a_lo, b_hi, b_lo): links that connect the components c within each family f; members has (hi, lo, n, c, f).

    A family of more than a block is cut by size class (a class's sets link only with its own
    and the next), then by whether they are in the family's largest component, then by hash.
    """
    salts = 16
    salted = lambda small: small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    grouped = members.groupBy("f", "c").agg(F.count(F.lit(1)).alias("n_sets"), F.sum("n").alias("n_grams"))
    family = grouped.groupBy("f").agg(F.count(F.lit(1)).alias("parts"), F.max_by("c", F.struct("n_sets", "c")).alias("main"), F.sum("n_sets").alias("n_sets"), F.sum("n_grams").alias("n_grams"))
    family = family.filter("parts > 1").withColumn("small", (F.col("n_sets") <= BLOCK_SETS) & (F.col("n_grams") <= BLOCK_NGRAMS)).select("f", "main", "small")
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("hi", "lo", F.lit(1)), F.lit(salts)).cast("int"))
    kind = F.floor(F.log("n") / F.lit(float(np.log(100 / percent)) * 1.001)).cast("int")
    split = dealt.join(salted(family), ["f", "salt"])
    split = split.select("f", "salt", "hi", "lo", "n", "c", F.when(F.col("small"), 0).otherwise(kind).alias("k"), (~F.col("small") & (F.col("c") == F.col("main"))).alias("pure"))
    split = materialise(split, "ngram-members")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_NGRAMS)).cast("int")
    groups = split.groupBy("f", "k", "pure").agg(blocks.alias("blocks"))
    groups = groups.groupBy("f").agg(F.collect_list(F.struct("k", "pure", "blocks")).alias("groups"))  # two a size class
    placed = split.join(salted(groups), ["f", "salt"])
    own = F.filter("groups", lambda g: (g["k"] == F.col("k")) & (g["pure"] == F.col("pure")))[0]["blocks"]
    placed = placed.withColumn("own", F.struct("k", "pure", F.pmod(F.xxhash64("hi", "lo"), own).cast("int").alias("block")))
    near = F.filter("groups", lambda g: (F.abs(g["k"] - F.col("k")) <= 1) & ~(g["pure"] & F.col("pure")))
    others = F.flatten(F.transform(near, lambda g: F.transform(F.sequence(F.lit(0), g["blocks"] - 1), lambda j: F.struct(g["k"].alias("k"), g["pure"].alias("pure"), j.cast("int").alias("block")))))
    tiles = placed.withColumn("other", F.explode(others))
    tiles = tiles.select("f", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("own") == F.col("other")).alias("self"), "c", "hi", "lo")
    names = ["a_hi", "a_lo", "b_hi", "b_lo"]

    def product(table: pa.Table) -> pa.Table:
        side, c, hi, lo = (table.column(x).to_numpy() for x in ("side", "c", "hi", "lo"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        rows = [np.flatnonzero(side == k) for k in (0, 1)]
        if table.column("self")[0].as_py():
            rows[1] = rows[0]
        found = tile_links([sets[i] for i in rows[0]], [sets[i] for i in rows[1]], c[rows[0]], c[rows[1]], percent) if len(rows[0]) and len(rows[1]) else []
        a = rows[0][[p for p, _ in found]] if found else np.empty(0, np.int64)
        b = rows[1][[q for _, q in found]] if found else np.empty(0, np.int64)
        return pa.table([hi[a], lo[a], hi[b], lo[b]], names=names)

    return tiles.join(sets, ["hi", "lo"]).groupBy("f", "x", "y").applyInArrow(product, ", ".join(f"{x} long" for x in names))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hi, lo, c): the smallest `first` of each linked node's component; nodes has (hi, lo, first).

    Alternating large-star and small-star steps, each written out; a component of any diameter
    takes a number of steps that grows with the logarithm of its size.
    """
    named = nodes.select("hi", "lo", F.struct(F.coalesce("first", F.lit(2**63 - 1)).alias("first"), "hi", "lo").alias("node"))
    of = lambda s: named.select(F.col("hi").alias(f"{s}_hi"), F.col("lo").alias(f"{s}_lo"), F.col("node").alias(s))
    edges = links.join(of("a"), ["a_hi", "a_lo"]).join(of("b"), ["b_hi", "b_lo"])
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, mark = materialise(edges, "ngram-edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "ngram-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u <> v").distinct(), "ngram-small")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select("u.hi", "u.lo", F.col("v").alias("root")).union(edges.select(F.col("v.hi"), F.col("v.lo"), F.col("v").alias("root")).distinct())


def _joined(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, root) of every document; root tells components apart, also those without any id, and is null for empty sets."""
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    both = _sets(docs, size, parts_for(total, RANGE_CHARS, 16))
    sets = materialise(both.filter("n is not null").select("doc_id", "mark", "n", "hi", "lo"), "ngram-keys")
    common = _common(both.filter("n is null").select("range", "first", "gaps"))
    drop_scratch(both)
    classes = sets.filter("n > 0").groupBy("hi", "lo").agg(F.min("n").alias("n"), F.min("doc_id").alias("first"), F.min("mark").alias("mark"))
    classes = materialise(classes, "ngram-classes")
    shared = materialise(_shared(_prefixes(docs, common, size, percent), percent), "ngram-shared")
    star = shared.filter("pivot_n is not null").select(
        F.col("pivot_hi").alias("a_hi"), F.col("pivot_lo").alias("a_lo"), F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo")
    )
    star = materialise(star.distinct(), "ngram-star")
    whole = materialise(_loaded(docs, classes, _ends(star), size), "ngram-whole")
    alike = materialise(_verify(whole, star, percent), "ngram-alike")
    first = alike.filter("links").drop("links")
    label = lambda edges, name: components(edges, classes).select("hi", "lo", F.xxhash64("root").alias(name))
    # a set that isn't linked yet is its own component
    family = label(alike.drop("links"), "f").join(label(first, "c"), ["hi", "lo"], "left").withColumn("c", F.coalesce("c", F.xxhash64("hi", "lo")))
    family = materialise(family, "ngram-families")
    inside = materialise(_families(family.join(classes.select("hi", "lo", "n"), ["hi", "lo"]), whole, percent), "ngram-inside")
    rows = shared.filter("pivot_n is null").select("shingle", "n", "hi", "lo").join(family.select("hi", "lo", F.col("f").alias("c")), ["hi", "lo"], "left")
    pairs = materialise(_product(rows.withColumn("c", F.coalesce("c", F.xxhash64("hi", "lo"))), percent), "ngram-pairs")
    across = _verify(_loaded(docs, classes, _ends(pairs), size), pairs, percent).filter("links").drop("links")
    links = materialise(first.union(inside).union(across), "ngram-links")
    for done in (shared, star, whole, pairs):
        drop_scratch(done)
    roots = components(links, classes)
    own = F.struct(F.coalesce("first", F.lit(2**63 - 1)).alias("first"), "hi", "lo")
    known = classes.join(roots, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("root", own).alias("root"))
    return sets.join(known, ["hi", "lo"], "left").select("doc_id", "mark", "n", "root")


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Two documents link when 100 * overlap >= percent * union of their sets. Null and empty texts
    have empty sets and link with nothing: their component is their own id. Very long texts are sets
    like others. Rows that are repeated are one row of the matrix; null ids count as larger than all
    others, and a component without any id has none; an empty table gives no rows.
    """
    component = F.nullif(F.coalesce("root.first", "doc_id"), F.lit(2**63 - 1))
    return _joined(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that with the smallest id and then hash of its text, with its own columns.

    Rows without words link with nothing, so all of them stay. Rows that share their id, or have none, but not their component stay too.
    """
    columns = docs.columns
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "mark")).alias("least")
    chosen = _joined(docs, size, percent).filter("n > 0").groupBy("root").agg(least).select(F.col("least.id").alias("_id"), F.col("least.mark").alias("_mark"))
    words = text_of().rlike(WORD)
    named = docs.filter(words).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("_mark", F.xxhash64(text_of()))
    kept = named.join(chosen, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"])
    return kept.select(*columns).unionByName(docs.filter(~words).select(*columns))
