"""SimHash fingerprints and an exact search within a Hamming radius.

A text's terms are its words and its pairs of neighbouring words. Each term's 128-bit hash votes
for every bit with the term's weight, 1 + ln(count), up for a set bit and down for a clear one;
the signs of the sums are the fingerprint. The search cuts fingerprints into blocks, each the key
of a table: two that differ in at most `radius` bits differ in at most radius // blocks bits of
some block, so a query that looks up all keys so close to its own in every table finds every answer.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, parts_for, text_of

BITS = 128
#: The largest distance of two documents whose sets of five-word shingles are 80 % alike or more, by brute force over those pairs in the sf0.1 documents.
RADIUS = 17
BLOCKS = 9
REMEMBERED = 300_000
#: Code points in a bucket of neighbouring ids, more where there would be too many buckets.
BUCKET_CHARS = 16_000_000
MOST_BUCKETS = 100_000
#: Fingerprints and queries of one key that are compared at once.
TILE = (2048, 512)
#: Up to so many pairs, tiles are compared together with others.
FEW = 2048


class Fingerprinter:
    """Fingerprints texts, remembering words' hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hash(self, word: bytes) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def __call__(self, text: str) -> bytes:
        words = text.encode("utf-8", "surrogatepass").split()
        if not words:
            return bytes(BITS // 8)
        known, find = self.known, self.hash
        one = np.fromiter((known.get(w) or find(w) for w in words), np.uint64, len(words))
        terms = np.concatenate([one, scramble(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])])
        terms, counts = np.unique(terms, return_counts=True)
        votes = np.zeros(BITS)
        weights = (1.0 + np.log(counts)).astype(np.float32)
        for at in range(0, len(terms), 8192):
            part = terms[at : at + 8192]
            both = np.stack([scramble(part ^ np.uint64(0xD6E8FEB86659FD93)), scramble(part ^ np.uint64(0xA5A3564E27F88D4B))], axis=1)
            bits = np.unpackbits(both.view(np.uint8).reshape(len(part), BITS // 8), axis=1)
            votes += weights[at : at + 8192] @ (bits.astype(np.float32) * 2.0 - 1.0)
        return np.packbits(votes > 0).tobytes()


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit hangs on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def likeness(a: bytes, b: bytes) -> float:
    """1 less the share of bits that differ."""
    return 1.0 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as long a beginning of the other, or all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _ordered_buckets(docs: DataFrame, chars: int) -> DataFrame:
    """(bucket, guest, doc_id, tie, text): rows by ranges of id, and in each bucket as guest the row that follows its last.

    Buckets are numbered in descending order of id, null ids last; the row at the top of a bucket
    is also the guest of the bucket before, and the very first row that of the last bucket. An id
    with many rows, or the null ids, are ranges of their own, cut further by the hash of the text.
    There are at most MOST_BUCKETS ranges, so what is known of all of them stays small at any size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    chars = max(chars, -(-total // MOST_BUCKETS))
    n = parts_for(total, chars, spark.sparkContext.defaultParallelism)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    often = {int(c) for c, times in Counter(found).items() if times > 1}  # such an id fills a range alone
    cuts = sorted({int(c) for c in found} | {c - 1 for c in often if c > -(2**63)}, reverse=True)
    # a row's range is the number of cuts from its id on, found among the first cuts of runs and then in one run
    run = max(1, math.isqrt(len(cuts)))
    array = lambda values: F.array(*[F.lit(c) for c in values]).cast("array<long>")
    not_below = lambda cut: cut >= F.col("doc_id")
    whole = F.greatest(F.size(F.filter(array(cuts[::run]), not_below)) - 1, F.lit(0)) * run
    place = whole + F.size(F.filter(F.slice(array(cuts), whole + 1, run), not_below))
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(place))
    sizes = rows.groupBy("range").agg(F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    parts = F.when(F.col("low").eqNullSafe(F.col("high")), F.greatest(F.lit(1), F.ceil(F.col("chars") / chars))).otherwise(F.lit(1))
    rows = rows.join(F.broadcast(sizes.select("range", parts.alias("parts"))), "range")
    rows = rows.withColumn("part", F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * F.col("parts")), F.col("parts") - 1).cast("int")).drop("parts")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("down"), "tie")
    tops = rows.groupBy("range", "part").agg(F.min(order).alias("top"))
    every = W.orderBy("range", "part")  # a row for each bucket
    tops = tops.select("range", "part", "top", (F.row_number().over(every) - 1).alias("bucket"), F.count(F.lit(1)).over(W.partitionBy()).alias("buckets"))
    tops = materialise(tops, "simhash-buckets")
    placed = rows.join(F.broadcast(tops), ["range", "part"])
    own = F.struct("bucket", F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("bucket") - 1, F.col("buckets")).cast("int").alias("bucket"), F.lit(True).alias("guest"))
    placed = placed.withColumn("at", F.explode(F.when(order == F.col("top"), F.array(own, guest)).otherwise(F.array(own))))
    return placed.select("at.bucket", "at.guest", "doc_id", "tie", "text").repartitionByRange(max(1, tops.count()), "bucket")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, chars: int = BUCKET_CHARS) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness to it and to the next document.

    The next document is that with the next smaller id; after the last comes the first, so a lone
    document follows itself. Null ids come last; rows with the same id are ordered by a hash of
    their text, then by the text, and null texts count as empty. Rows are ordered within ranges of
    ids, each range as many rows as a task handles as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, kinds = Fingerprinter(), [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        held = None  # the row before, which waits for the one that follows it
        for batch in batches:
            out = []
            for bucket, guest, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                text = text.as_py()
                print_ = make(text)
                if held is not None and held[0] == bucket:
                    _, old_id, old, old_print = held
                    changed = edited(old, text)
                    new = make(changed)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((old_id, len(old), sha, old_print.hex(), new.hex(), likeness(old_print, new), likeness(old_print, print_)))
                held = None if guest else (bucket, doc_id, text, print_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)

    rows = _ordered_buckets(docs, chars)
    # equal rows may all be guests: the first is the one that follows, the others are passed over
    rows = rows.sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "tie", "text")
    return rows.mapInArrow(run, SCHEMA)


def halves(fingerprint: Column) -> tuple[Column, Column]:
    """The upper and lower 64 bits of a hexadecimal fingerprint."""
    signed = lambda c: F.conv(c, 16, -10).cast("long")
    return signed(F.substring(fingerprint, 1, 16)), signed(F.substring(fingerprint, 17, 16))


def block_keys(high: Column, low: Column, blocks: int, tolerance: int = 0) -> Column:
    """array<struct<table, key>>: in each block's table all keys at most `tolerance` bits from the fingerprint's own."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for t, (a, b) in enumerate(zip(edges, edges[1:])):
        mask = lambda n: F.lit((1 << n) - 1 if n < 64 else -1).cast("long")
        if b <= 64:
            own = F.shiftrightunsigned(high, 64 - b).bitwiseAND(mask(b - a))
        elif a >= 64:
            own = F.shiftrightunsigned(low, 128 - b).bitwiseAND(mask(b - a))
        else:
            upper = high.bitwiseAND(mask(64 - a))
            own = F.shiftleft(upper, b - 64).bitwiseOR(F.shiftrightunsigned(low, 128 - b).bitwiseAND(mask(b - 64)))
        flips = [sum(1 << k for k in c) for n in range(tolerance + 1) for c in combinations(range(b - a), n)]
        keys.append(F.array(*[F.struct(F.lit(t).alias("table"), own.bitwiseXOR(F.lit(x).cast("long")).alias("key")) for x in flips]))
    return F.flatten(F.array(*keys))


def _first_table(query: np.ndarray, other: np.ndarray, blocks: int, tolerance: int) -> np.ndarray:
    """The first block's number in which two fingerprints (rows of 16 bytes) differ in at most `tolerance` bits, or `blocks`."""
    bits = np.unpackbits(query ^ other, axis=1)
    edges = [BITS * k // blocks for k in range(blocks)]
    near = np.add.reduceat(bits, edges, axis=1, dtype=np.int64) <= tolerance
    return np.where(near.any(axis=1), near.argmax(axis=1), blocks)


def _met(prints: DataFrame, queries: DataFrame, radius: int, blocks: int, pairs: bool, tile: tuple[int, int] = TILE) -> DataFrame:
    """Looks up the queries' keys in the tables and compares what meets there, each pair in the first table where it meets.

    prints (fingerprint, n) and queries (fingerprint), distinct and not null. The rows of a key are
    compared by one matrix of distances, those of a common key tile by tile in several tasks, so no
    row is made for a pair that meets but isn't near. With `pairs` all near pairs are returned, else
    for each query and tile the sum of n.
    """
    if radius < 0 or not 3 <= blocks <= BITS:
        raise ValueError("the radius must not be negative, and there must be 3 to 128 blocks")
    tolerance = radius // blocks
    if sum(math.comb(-(-BITS // blocks), n) for n in range(tolerance + 1)) > 10_000:
        raise ValueError("too many keys a table: take more blocks")

    widths = [BITS * (t + 1) // blocks - BITS * t // blocks for t in range(blocks)]
    flips = [sum(1 << k for k in c) for n in range(tolerance + 1) for c in combinations(range(max(widths)), n)]

    def keyed(df: DataFrame, tolerance: int, n: Column) -> DataFrame:
        high, low = halves(F.col("fingerprint"))
        one = df.select(high.alias("high"), low.alias("low"), n.cast("long").alias("n"))
        own = one.withColumn("k", F.explode(block_keys(F.col("high"), F.col("low"), blocks))).select("k.table", "k.key", "high", "low", "n")
        if not tolerance:
            return own
        # keys nearby in a second step: one array of them all makes code too long to be compiled
        inside = F.col("flip") < F.element_at(F.array(*[F.lit(1 << w) for w in widths]), F.col("table") + 1)
        return own.withColumn("flip", F.explode(F.array(*[F.lit(x) for x in flips]).cast("array<long>"))).filter(inside).withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")

    held, asked = keyed(prints, 0, F.col("n")), keyed(queries, tolerance, F.lit(None))
    many = lambda df, most: df.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("tiles")).filter("tiles > 1")
    # common keys only: at most a row for each full tile
    rows = many(held, tile[0]).withColumn("wide", F.lit(1)).unionByName(many(asked, tile[1]).select("table", "key", F.lit(1).alias("tiles"), F.col("tiles").alias("wide")))
    common = F.broadcast(rows.groupBy("table", "key").agg(F.max("tiles").alias("tiles"), F.max("wide").alias("wide")))
    tiles, wide = F.coalesce("tiles", F.lit(1)), F.coalesce("wide", F.lit(1))
    own = lambda count: F.pmod(F.xxhash64("high", "low"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    place = lambda df, a, b: df.join(common, ["table", "key"], "left").withColumn("a", a).withColumn("b", b).select("table", "key", "a", "b", "high", "low", "n")
    both = place(held, own(tiles), every(wide)).unionByName(place(asked, every(tiles), own(wide)))
    names = ["q_high", "q_low", "p_high", "p_low", "distance"] if pairs else ["q_high", "q_low", "n"]

    def compare(rows: np.ndarray) -> pa.RecordBatch:
        """What lies near in whole tiles: columns table, key, a, b, high, low, n, in each tile queries (n of -1) first."""
        starts = np.concatenate([[0], np.nonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))[0] + 1])
        sizes = np.diff(starts, append=len(rows))
        q = np.add.reduceat((rows[:, 6] < 0).astype(np.int64), starts)
        p = sizes - q
        bits = np.ascontiguousarray(rows[:, 4:6]).view(np.uint64)
        apart = lambda i, j: np.bitwise_count(bits[i, 0] ^ bits[j, 0]) + np.bitwise_count(bits[i, 1] ^ bits[j, 1])
        i_of, j_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in np.nonzero(q * p > FEW)[0]:
            at, end = starts[t], starts[t] + sizes[t]
            i, j = np.nonzero(apart(np.arange(at, at + q[t])[:, None], np.arange(at + q[t], end)[None, :]) <= radius)
            i_of.append(i + at)
            j_of.append(j + at + q[t])
        few = np.nonzero((q * p > 0) & (q * p <= FEW))[0]
        for at in range(0, len(few), 1024):  # small tiles together
            some = few[at : at + 1024]
            pairs_of = q[some] * p[some]
            tile_of = np.repeat(some, pairs_of)
            place = np.arange(len(tile_of)) - np.repeat(np.cumsum(pairs_of) - pairs_of, pairs_of)
            i, j = starts[tile_of] + place // p[tile_of], starts[tile_of] + q[tile_of] + place % p[tile_of]
            near = apart(i, j) <= radius
            i_of.append(i[near])
            j_of.append(j[near])
        i, j = np.concatenate(i_of), np.concatenate(j_of)
        wire = np.ascontiguousarray(bits.astype(">u8")).view(np.uint8).reshape(len(rows), BITS // 8)
        first = [_first_table(wire[i[at : at + 65_536]], wire[j[at : at + 65_536]], blocks, tolerance) == rows[i[at : at + 65_536], 0] for at in range(0, len(i), 65_536)]
        first = np.concatenate([np.zeros(0, bool), *first])
        i, j = i[first], j[first]
        if pairs:
            found = [rows[i, 4], rows[i, 5], rows[j, 4], rows[j, 5], apart(i, j).astype(np.int64)]
        else:
            some, place = np.unique(i, return_inverse=True)
            sums = np.zeros(len(some), np.int64)
            np.add.at(sums, place, rows[j, 6])
            found = [rows[some, 4], rows[some, 5], sums]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 7), np.int64)  # the last tile, which may go on in the next batch
        for batch in batches:
            if batch.num_rows:
                rows = np.stack([c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
                rows = np.concatenate([rest, rows])
                other = np.nonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))[0]
                whole = other[-1] + 1 if len(other) else 0
                rest = rows[whole:]
                if whole:
                    yield compare(rows[:whole])
        if len(rest):
            yield compare(rest)

    spread = both.repartition("table", "key", "a", "b").sortWithinPartitions("table", "key", "a", "b", F.col("n").asc_nulls_first())
    return spread.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _hexadecimal(high: str, low: str) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in (high, low)])


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fingerprint, distance) of all pairs of distinct fingerprints at most `radius` bits apart, themselves included.

    Both tables have a hexadecimal `fingerprint`; null ones find nothing. Copies are one
    fingerprint each, so no group of copies is expanded; whoever needs documents joins these back.
    """
    one = lambda df: df.filter("fingerprint is not null").select("fingerprint").distinct()
    found = _met(one(prints).withColumn("n", F.lit(1)), one(queries), radius, blocks, pairs=True)
    return found.select(_hexadecimal("q_high", "q_low").alias("query"), _hexadecimal("p_high", "p_low").alias("fingerprint"), F.col("distance").cast("int").alias("distance"))


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: tuple[int, int] = TILE) -> DataFrame:
    """(query, n_near): for each distinct query fingerprint the sum of n over the prints (fingerprint, n) within the radius; no pair is listed."""
    one = queries.filter("fingerprint is not null").select("fingerprint").distinct()
    found = _met(prints.filter("fingerprint is not null"), one, radius, blocks, pairs=False, tile=tile)
    sums = found.groupBy("q_high", "q_low").agg(F.sum("n").alias("n_near"))
    return sums.select(_hexadecimal("q_high", "q_low").alias("query"), "n_near")


def report(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fingerprints() with n_near: for ids divisible by 20, how many documents lie within the radius, itself included."""
    table = materialise(fingerprints(docs), "simhash")
    asks = table.filter(F.col("doc_id") % 20 == 0)
    counts = table.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    near = near_counts(counts, asks, radius, blocks)
    # a merge join: estimates of the few queries' size know nothing of what a search returns, and a broadcast goes through the driver
    joined = asks.join(near.hint("merge"), asks["fingerprint"] == near["query"], "left").drop("query")
    rest = table.filter(~F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False)))
    return joined.unionByName(rest.withColumn("n_near", F.lit(None).cast("long")))
