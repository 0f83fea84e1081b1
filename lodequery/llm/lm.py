"""Language-model scoring: a causal self-attention model in numpy, and a smoothed word model as base.

The attention model reads subword ids of the lower-cased text. One attention head looks back over
at most a window. The next id is predicted in two steps, by a softmax over classes and one over the
ids of a class, both from the same state; frequent ids are a class each, and rare ones that no class
has room for share the last one by their frequency. Long texts are cut into overlapping windows;
every id is scored once, in the first window where it has enough context, many windows at a time
under a causal mask.

The base model needs every word's count over the whole corpus. A pass over the texts turns them
into ids and into places in a list of their block's words; a block of neighbouring texts reports
its distinct words once, counts are added up by ranges of the words' hashes, and each block gets
back only the counts of its own words, so no task or machine holds the vocabulary. Texts are read
once and never shuffled.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, fold, materialise, parts_for, text_of
from .packing import bpe
from .simhash import scramble

HELD_OUT = 1
#: Ids of a window, and how many of them are context from the window before.
WINDOW, OVERLAP = 64, 16
WIDTH, HIDDEN = 24, 32
#: Ids with a class of their own, and classes of CLASS_SIZE ids after them; all other ids are in one class.
OWN_CLASS, CLASSES, CLASS_SIZE = 96, 32, 128
#: Up to so many code points (as four an id) the attention model learns all windows of the training fold on the driver; beyond, as many make its start, from which every task learns all windows of its texts.
ALL_CHARS = 4_000_000
#: Windows of a step, and the least number of steps; more windows mean more steps.
STEPS, BATCH, RATE = 500, 16, 0.02
#: The same of a task that learns from the start, its windows mixed at once, and ids of the embeddings that are averaged together.
TASK_BATCH, TASK_RATE, MIXED, SLICE = 64, 0.008, 4096, 512
#: Ids that one of these tasks has at least and about at most, as each reports a model.
TASK_LEAST, TASK_MOST = 500_000, 16_000_000
#: Code points of a block of texts, and of the texts whose words a range of hashes is cut for.
BLOCK_CHARS, RANGE_CHARS = 24_000_000, 128_000_000
SEED = 5
TOKENIZER = "byte_bpe_50k.tiktoken"
LN10 = np.log(10.0)


@dataclass
class Model:
    """Parameters of the attention model; of every id its class, its place in it (-1: a class of its own or the last) and, in the last, its log probability."""

    embed: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    back: np.ndarray  # by distance
    own: np.ndarray
    seen: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray
    fine: np.ndarray  # by class
    fine_shift: np.ndarray
    classes: np.ndarray
    inner: np.ndarray
    within: np.ndarray
    end: int

    PARTS = ("embed", "query", "key", "value", "back", "own", "seen", "shift", "out", "out_shift", "fine", "fine_shift")


def make_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id's class, place in its class and log probability in the last class, by descending frequency."""
    order = np.argsort(-counts, kind="stable")
    classes, inner, within = np.full(len(counts), OWN_CLASS + CLASSES), np.full(len(counts), -1), np.zeros(len(counts))
    classes[order[:OWN_CLASS]] = np.arange(min(OWN_CLASS, len(order)))
    middle = order[OWN_CLASS : OWN_CLASS + CLASSES * CLASS_SIZE]
    classes[middle] = OWN_CLASS + np.arange(len(middle)) // CLASS_SIZE
    inner[middle] = np.arange(len(middle)) % CLASS_SIZE
    last = order[OWN_CLASS + CLASSES * CLASS_SIZE :]
    if len(last):
        within[last] = np.log((counts[last] + 0.5) / (counts[last] + 0.5).sum())
    return classes, inner, within


def untrained(vocabulary: int, end: int, counts: np.ndarray) -> Model:
    """Random weights; both softmaxes start at the frequencies."""
    r = np.random.default_rng(SEED)
    normal = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    classes, inner, within = make_classes(counts)
    n_classes = OWN_CLASS + CLASSES + 1
    share = np.bincount(classes, counts + 0.5, n_classes) + 1e-9
    shift = np.full((CLASSES, CLASS_SIZE), -1e9, np.float32)
    placed = np.flatnonzero(inner >= 0)
    shift[classes[placed] - OWN_CLASS, inner[placed]] = np.log((counts[placed] + 0.5) / share[classes[placed]])
    embed = (r.standard_normal((vocabulary, WIDTH)) * 0.3).astype(np.float32)
    return Model(embed, normal(WIDTH, WIDTH), normal(WIDTH, WIDTH), normal(WIDTH, WIDTH), np.zeros(WINDOW, np.float32), normal(WIDTH, HIDDEN), normal(WIDTH, HIDDEN),
                 np.zeros(HIDDEN, np.float32), normal(HIDDEN, n_classes) * 0.1, np.log(share / share.sum()).astype(np.float32),
                 (r.standard_normal((CLASSES, HIDDEN, CLASS_SIZE)) * 0.02).astype(np.float32), shift, classes, inner, within.astype(np.float32), end)


def distances() -> tuple[np.ndarray, np.ndarray]:
    gap = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
    return np.maximum(gap, 0), gap >= 0


def step(m: Model, ids: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[float, dict]:
    """Mean loss of the target ids over a batch of windows, and its gradients, with the rows of the embeddings and the classes that they concern.

    Matrices with the same input are one product, a column of ones takes shifts and sums into the
    products, and softmaxes are divided by their sums where the numbers are few.
    """
    gap, past = distances()
    scale = WIDTH**-0.5  # a Python float: float32 stays float32
    x = m.embed[ids.ravel()]
    joined = np.concatenate([m.query * scale, m.key, m.value, np.zeros_like(m.value[:, :1]), m.own], axis=1)
    split = [slice(0, WIDTH), slice(WIDTH, 2 * WIDTH), slice(2 * WIDTH, 3 * WIDTH + 1), slice(3 * WIDTH + 1, None)]
    by_window = lambda t: t.reshape(*ids.shape, -1)
    found = x @ joined
    found[:, 3 * WIDTH] = 1.0
    q, k, v = (by_window(found)[..., at] for at in split[:3])
    a, c = _attend(q, k, v, np.where(past, m.back[gap], -1e9).astype(x.dtype))
    sums = c[..., WIDTH:].reshape(-1, 1)
    c = c[..., :WIDTH].reshape(-1, WIDTH) / sums
    h = c @ m.seen
    h += found[:, split[3]]
    h += m.shift
    state = np.ones((len(h), HIDDEN + 1), h.dtype)
    h = state[:, :HIDDEN] = _tanh(h)
    at = np.flatnonzero(real)
    n = max(1, len(at))
    goal, g = targets.ravel()[at], {}
    if len(at) < len(state):
        state = state[at]
    p, total, lost = _missed(state @ np.vstack([m.out, m.out_shift]), m.classes[goal])
    loss = lost - float(m.within[goal].sum())
    each = (1.0 / (total * n))[:, None]
    grad = (p.T @ (state * each)).T
    g["out"], g["out_shift"] = grad[:HIDDEN], grad[HIDDEN]
    dstate = p @ m.out.T
    dstate *= each
    order, kinds, edges = _by_class(m.classes[goal] - OWN_CLASS, np.flatnonzero(m.inner[goal] >= 0))
    weights = np.concatenate([m.fine, m.fine_shift[:, None]], axis=1)
    fine = np.empty((len(kinds), *weights.shape[1:]), h.dtype)
    if len(order):
        own = state[order]
        p, total, lost = _missed(_by_weights(own, weights, kinds, edges), m.inner[goal[order]])
        loss += lost
        each = (1.0 / (total * n))[:, None]
        own *= each
        more = np.empty((len(order), HIDDEN), h.dtype)
        for i, kind in enumerate(kinds):
            part = slice(edges[i], edges[i + 1])
            np.matmul(own[part].T, p[part], out=fine[i])
            np.matmul(p[part], m.fine[kind].T, out=more[part])
        more *= each
        dstate[order] += more
    g["used"], g["fine"], g["fine_shift"] = kinds, fine[:, :HIDDEN], fine[:, HIDDEN]
    dfound = np.empty_like(found)
    dh = dfound[:, split[3]]
    if len(at) < len(dh):
        dfound[:] = 0.0
        dh[at] = dstate
    else:
        dfound[:, 3 * WIDTH] = 0.0
        dh[:] = dstate
    dh *= 1.0 - h * h
    g["seen"], g["shift"] = c.T @ dh, np.ones(len(dh), dh.dtype) @ dh
    dc = np.empty((len(c), WIDTH + 1), h.dtype)
    np.matmul(dh, m.seen.T, out=dc[:, :WIDTH])
    dc[:, :WIDTH] /= sums
    np.einsum("ij,ij->i", dc[:, :WIDTH], c, out=dc[:, WIDTH])  # what a weighs of dc @ v
    dc[:, WIDTH] *= -1.0
    dc = by_window(dc)
    ds = dc @ v.transpose(0, 2, 1)
    ds *= a
    g["back"] = np.bincount(gap.ravel(), ds.sum(0).ravel() * past.ravel(), WINDOW)
    into = by_window(dfound)
    np.matmul(ds, k, out=into[..., split[0]])  # of q as it is in joined, scaled
    np.matmul(ds.transpose(0, 2, 1), q, out=into[..., split[1]])
    np.matmul(a.transpose(0, 2, 1), dc[..., :WIDTH], out=into[..., 2 * WIDTH : 3 * WIDTH])
    grad = x.T @ dfound
    g["query"], g["key"], g["value"], g["own"] = grad[:, split[0]] * scale, grad[:, split[1]], grad[:, 2 * WIDTH : 3 * WIDTH], grad[:, split[3]]
    g["rows"], g["embed"] = _sums_by_id(ids.ravel(), dfound @ joined.T)
    return loss / n, g


def _attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention's weights, not divided by their sums, and what they weigh of v; v's last column is ones, so the result's has the sums."""
    z = q @ k.transpose(0, 2, 1)
    z += bias
    with np.errstate(over="ignore", invalid="ignore"):
        a = np.exp(z)
        c = a @ v
    if not _in_range(c[..., -1]):
        z -= z.max(-1, keepdims=True)
        a = np.exp(z, out=z)
        c = a @ v
    return a, c


def _tanh(x: np.ndarray) -> np.ndarray:
    """Quicker than numpy's; x is overwritten."""
    with np.errstate(over="ignore"):
        x *= 2.0
        np.exp(x, out=x)
        x += 1.0
        np.divide(-2.0, x, out=x)
        x += 1.0
    return x


def _in_range(total: np.ndarray) -> bool:
    return bool(total.min() > 1e-20 and total.max() < 1e28)


def _exp_rows(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) and its rows' sums; where they could leave the range of float32, each row's greatest is taken off z first."""
    ones = np.ones(z.shape[-1], z.dtype)
    with np.errstate(over="ignore"):
        p = np.exp(z)
        total = p @ ones
    if z.size and not _in_range(total):
        z -= z.max(-1, keepdims=True)
        np.exp(z, out=p)
        total = p @ ones
    return p, total


def _missed(z: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The gradient of a softmax's loss by its inputs z, times the rows' sums, these sums, and the loss, summed up."""
    p, total = _exp_rows(z)
    place = np.arange(len(goal)), goal
    hit = p[place]
    p[place] = hit - total
    return p, total, -float(np.log(hit / total + 1e-12).sum())


def _by_class(kinds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in the order of their classes, the classes that occur, and their edges there."""
    kinds = kinds[rows].astype(np.int16)  # sorted by radix
    order = np.argsort(kinds, kind="stable")
    counts = np.bincount(kinds, minlength=1)
    found = np.flatnonzero(counts)
    return rows[order], found, np.append(0, np.cumsum(counts[found]))


def _by_weights(state: np.ndarray, weights: np.ndarray, kinds: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each class's rows, as _by_class has them, times that class's weights."""
    z = np.empty((len(state), weights.shape[-1]), state.dtype)
    for i, kind in enumerate(kinds):
        np.matmul(state[edges[i] : edges[i + 1]], weights[kind], out=z[edges[i] : edges[i + 1]])
    return z


def _sums_by_id(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and the sums of their rows."""
    order = np.argsort(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[first], np.add.reduceat(values[order], first, axis=0)


def train(sequences: list[np.ndarray], vocabulary: int, end: int, steps: int = STEPS) -> tuple[Model, list[float]]:
    """Adam over random windows of the sequences (each ends with `end`); also the losses."""
    counts = np.bincount(np.concatenate([*sequences, np.array([end])]).astype(np.int64), minlength=vocabulary).astype(float)
    m = untrained(vocabulary, end, counts)
    stream = np.concatenate([np.array([end]), *sequences]).astype(np.int64)
    if len(stream) < 2:
        return m, []
    r = np.random.default_rng(SEED)
    span = np.arange(WINDOW + 1)

    def batch() -> np.ndarray:
        at = r.integers(0, max(1, len(stream) - WINDOW), BATCH)[:, None] + span
        return np.where(at < len(stream), stream[np.minimum(at, len(stream) - 1)], -1)

    return learn(m, (batch() for _ in range(steps)), steps)


def learn(m: Model, batches: Iterable[np.ndarray], steps: int | None) -> tuple[Model, list[float]]:
    """Adam over batches of windows: rows of WINDOW + 1 ids, -1 after their end. Of the embeddings and the classes only those that a batch reads move.

    The rate falls over that many steps; without a number it is TASK_RATE throughout.
    """
    losses: list[float] = []
    first = {k: np.zeros_like(getattr(m, k)) for k in m.PARTS}
    second = {k: np.zeros_like(getattr(m, k)) for k in m.PARTS}
    for t, block in enumerate(batches, 1):
        real = block[:, 1:] >= 0
        ids, targets = np.maximum(block[:, :-1], 0), np.maximum(block[:, 1:], 0)
        loss, g = step(m, ids, targets, real)
        losses.append(loss)
        rate = min(1.0, t / 20) * (TASK_RATE if steps is None else RATE * (1.0 - 0.9 * t / steps))
        for k in m.PARTS:
            at = g["rows"] if k == "embed" else g["used"] if k in ("fine", "fine_shift") and len(g["used"]) < len(m.fine) else slice(None)
            grad, one, two = g[k], first[k][at], second[k][at]  # parts of first and second, or copies of their rows
            one *= 0.9
            one += 0.1 * grad
            two *= 0.99
            two += 0.01 * (grad * grad)
            move = two * (1 / (1 - 0.99**t))
            np.sqrt(move, out=move)
            move += 1e-8
            np.divide(one, move, out=move)
            move *= rate / (1 - 0.9**t)
            getattr(m, k)[at] -= move
            if not isinstance(at, slice):
                first[k][at], second[k][at] = one, two
    return m, losses


class Scorer:
    """Scores id sequences. What attention needs of an id hangs on the id alone, so it is looked up."""

    def __init__(self, m: Model, window_batch: int = 64):
        self.m, self.window_batch = m, window_batch
        query = (m.embed @ m.query) / np.sqrt(WIDTH).astype(np.float32)
        self.asks = np.concatenate([query, m.embed @ m.own + m.shift], axis=1)
        self.gives = np.concatenate([m.embed @ m.key, m.embed @ m.value, np.ones_like(query[:, :1])], axis=1)
        self.out, self.fine = np.vstack([m.out, m.out_shift]), np.concatenate([m.fine, m.fine_shift[:, None]], axis=1)
        gap, past = distances()
        self.bias = np.where(past, m.back[gap], -1e9).astype(np.float32)

    def windows(self, length: int) -> list[tuple[int, int]]:
        """(start, first position scored) of the windows over a sequence of that many inputs."""
        out, start = [(0, 0)], 0
        while start + WINDOW < length:
            out.append((start + WINDOW - OVERLAP, OVERLAP))
            start += WINDOW - OVERLAP
        return out

    def __call__(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each sequence of ids with its end; an empty one is the end alone."""
        total = np.zeros(len(sequences))
        rows: dict[int, list[np.ndarray]] = {0: [], OVERLAP: []}
        owner: dict[int, list[int]] = {0: [], OVERLAP: []}
        for i, ids in enumerate(sequences):
            whole = np.concatenate([[self.m.end], ids, [self.m.end]]).astype(np.int32)
            for start, skip in self.windows(len(whole) - 1):
                rows[skip].append(whole[start : start + WINDOW + 1])
                owner[skip].append(i)
        for skip, mine in rows.items():
            # windows of like length share a block, so little of a block is empty
            lengths = np.array([len(r) for r in mine], int)
            order = np.argsort(lengths, kind="stable")
            for at in range(0, len(order), self.window_batch):
                part = order[at : at + self.window_batch]
                block = np.full((len(part), lengths[part].max()), -1, np.int32)
                for i, k in enumerate(part):
                    block[i, : lengths[k]] = mine[k]
                self._add(total, block, np.array([owner[skip][k] for k in part]), skip)
        return total

    def _add(self, total: np.ndarray, block: np.ndarray, owner: np.ndarray, skip: int) -> None:
        """Adds the log probabilities of a block's ids from place `skip` on; only their rows of attention are computed."""
        m = self.m
        width = block.shape[1] - 1
        ids, targets = np.maximum(block[:, :-1], 0), block[:, 1 + skip :]
        asks, gives = self.asks[ids[:, skip:]], self.gives[ids]
        c = _attend(asks[..., :WIDTH], gives[..., :WIDTH], gives[..., WIDTH:], self.bias[skip:width, :width])[1]
        at = np.flatnonzero(targets >= 0)
        goal, c, own = targets.ravel()[at], c.reshape(-1, WIDTH + 1), asks.reshape(-1, asks.shape[-1])[:, WIDTH:]
        if len(at) < len(c):
            c, own = c[at], own[at]
        h = (c[:, :WIDTH] / c[:, WIDTH:]) @ m.seen
        h += own
        state = np.ones((len(at), HIDDEN + 1), h.dtype)
        state[:, :HIDDEN] = _tanh(h)
        got = _log_share(state @ self.out, m.classes[goal]) + m.within[goal]
        order, kinds, edges = _by_class(m.classes[goal] - OWN_CLASS, np.flatnonzero(m.inner[goal] >= 0))
        if len(order):
            got[order] += _log_share(_by_weights(state[order], self.fine, kinds, edges), m.inner[goal[order]])
        total += np.bincount(owner[at // targets.shape[1]], got, len(total))


def _log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax of each row at one place; z may be overwritten."""
    total = _exp_rows(z)[1]
    return z[np.arange(len(at)), at] - np.log(total)


ENCODED = "block long, row long, doc_id long, held_out boolean, places binary, ids binary, range int, hashes binary, at binary, counts binary, training long"


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, chars: int = BLOCK_CHARS) -> DataFrame:
    """Every text as ids and places in its block's list of words, and with null ids the blocks' words, by ranges of their hashes.

    A block is a run of a task's texts of about `chars` code points, a longer text included. Null
    texts count as empty, null ids as the empty text's fold.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = parts_for(total, RANGE_CHARS, 3 * docs.sparkSession.sparkContext.defaultParallelism)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    names = [x.split()[0] for x in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe(tokenizer)
        small = np.uint16 if tok.size <= 1 << 16 else np.uint32
        block, row, held, training = TaskContext.get().partitionId() << 32, 0, 0, 0
        known: dict[bytes, int] = {}
        learned: list[np.ndarray] = []

        def words() -> list[tuple]:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
            counts = np.bincount(np.concatenate([np.empty(0, np.int32), *learned]), minlength=len(known))
            of = (hashes % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(of, kind="stable").astype(np.int32)
            edges = np.searchsorted(of[order], np.arange(ranges + 1))
            out = [(block, None, None, None, None, None, -1, b"", b"", b"", training)]
            for r in np.flatnonzero(np.diff(edges)):
                part = order[edges[r] : edges[r + 1]]
                out.append((block, None, None, None, None, None, int(r), hashes[part].tobytes(), part.tobytes(), counts[part].astype(np.int64).tobytes(), 0))
            return out

        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, held_out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass").lower()
                low = raw.decode("utf-8", "surrogatepass")
                place = np.fromiter([known.setdefault(w, len(known)) for w in raw.split()], np.int32)
                row += 1
                out.append((block, row, doc_id, held_out, place.tobytes(), tok.encode(low).astype(small).tobytes(), None, None, None, None, None))
                if not held_out:
                    training += 1
                    learned.append(place)
                held += len(low)
                if held >= chars:
                    out += words()
                    known, learned, training, held, block = {}, [], 0, 0, block + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)
        if held or training or known:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*words()), kinds, strict=True)], names=names)

    return materialise(rows.select("doc_id", "text", "held_out").mapInArrow(run, ENCODED), "lm-encoded", "zstd")


def _ids(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if size <= 1 << 16 else np.uint32)


def _lessons(rows: DataFrame, tokenizer: str, share: float) -> DataFrame:
    """Rows (order, window) of a share of the texts' windows by hash and, with null order, a task's counts of all its ids.

    Windows start at every WINDOW-th input of a text of any length; order is a hash of text and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe(tokenizer)
        end = tok.special["<|endoftext|>"]
        counts = np.zeros(tok.size, np.int64)
        limit = np.uint64(min(2**64 - 1, int(share * 2**64)))
        rows_of = lambda order, windows: pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(windows, pa.binary())], names=["order", "window"])
        for batch in batches:
            orders, windows = [], []
            for raw in batch.column(0):
                raw = raw.as_py()
                whole = np.concatenate([[end], _ids(raw, tok.size), [end]]).astype(np.int32)
                counts += np.bincount(whole[1:], minlength=tok.size)
                starts = np.arange(0, len(whole) - 1, WINDOW)
                own = np.uint64(xxhash.xxh3_64_intdigest(raw, SEED))
                hashes = scramble(own + starts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                for k in np.flatnonzero(hashes <= limit):
                    orders.append(hashes[k].view(np.int64))
                    windows.append(whole[starts[k] : starts[k] + WINDOW + 1].tobytes())
            if orders:
                yield rows_of(np.array(orders), windows)
        yield rows_of([None], [counts.tobytes()])

    return materialise(rows.select("ids").mapInArrow(run, "order long, window binary"), "lm-lessons")


def _padded(windows: list[bytes]) -> np.ndarray:
    out = np.full((len(windows), WINDOW + 1), -1, np.int64)
    for i, raw in enumerate(windows):
        ids = np.frombuffer(raw, np.int32)
        out[i, : len(ids)] = ids
    return out


def _parts(m: Model) -> dict[int, list[tuple[str, slice]]]:
    """What is averaged together: slices of the embeddings, each class of ids, and all the rest."""
    out: dict[int, list[tuple[str, slice]]] = {0: [(k, slice(None)) for k in m.PARTS if k not in ("embed", "fine", "fine_shift")]}
    for kind in range(len(m.fine)):
        out[1 + kind] = [(k, slice(kind, kind + 1)) for k in ("fine", "fine_shift")]
    for at in range(0, len(m.embed), SLICE):
        out[1 + len(m.fine) + at // SLICE] = [("embed", slice(at, at + SLICE))]
    return out


def learn_everywhere(rows: DataFrame, start: Model) -> Model:
    """Every task learns from all windows of its texts, each once, beginning with `start`; then the tasks' parameters are averaged.

    rows (ids). A task weighs by its windows, in an id's embedding by how often it read the id, and
    in a class by how often it predicted one of its ids. What no task read stays as it is. Tasks
    report slices of parameters, which are averaged where they meet; the driver gets one model.
    """
    shared, size, end = rows.sparkSession.sparkContext.broadcast(start), len(start.classes), start.end
    schema = "part int, weights binary, values binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = dataclasses.replace(shared.value, **{k: getattr(shared.value, k).copy() for k in Model.PARTS})
        read, aimed, seen = np.zeros(size), np.zeros(len(m.fine)), 0
        r = np.random.default_rng([SEED, TaskContext.get().partitionId()])

        def blocks() -> Iterator[np.ndarray]:
            nonlocal read, aimed, seen
            held: list[np.ndarray] = []
            many = 0

            def mixed() -> Iterator[np.ndarray]:
                block = np.concatenate(held)
                block = block[r.permutation(len(block))]
                for at in range(0, len(block), TASK_BATCH):
                    yield block[at : at + TASK_BATCH]

            for batch in batches:
                for raw in batch.column(0):
                    whole = np.concatenate([[end], _ids(raw.as_py(), size), [end]]).astype(np.int64)
                    n = -(-(len(whole) - 1) // WINDOW)
                    targets = np.full(n * WINDOW, -1, np.int64)
                    targets[: len(whole) - 1] = whole[1:]
                    block = np.column_stack([whole[:-1:WINDOW], targets.reshape(n, WINDOW)])
                    read += np.bincount(whole[:-1], minlength=size)
                    placed = whole[1:][m.inner[whole[1:]] >= 0]
                    aimed += np.bincount(m.classes[placed] - OWN_CLASS, minlength=len(aimed))
                    seen += n
                    held.append(block)
                    many += n
                    if many >= MIXED:
                        yield from mixed()
                        held, many = [], 0
            if held:
                yield from mixed()

        learn(m, blocks(), None)
        if not seen:
            return
        for part, pieces in _parts(m).items():
            weights = np.array([seen], float) if not part else aimed[part - 1 : part] if part <= len(aimed) else read[pieces[0][1]]
            if weights.any():
                values = b"".join(getattr(m, k)[at].astype(np.float32).tobytes() for k, at in pieces)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([weights.tobytes()], pa.binary()), pa.array([values], pa.binary())], names=["part", "weights", "values"])

    def average(table: pa.Table) -> pa.Table:
        weight, total = 0.0, 0.0
        for w, v in sorted(zip(table.column("weights").to_pylist(), table.column("values").to_pylist(), strict=True)):
            w = np.frombuffer(w)
            weight = weight + w
            total = total + w[:, None] * np.frombuffer(v, np.float32).reshape(len(w), -1)
        weight, mean = np.asarray(weight), total / np.maximum(weight, 1)[:, None]
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "weights": pa.array([weight.tobytes()], pa.binary()), "values": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    learned = materialise(rows.select("ids").mapInArrow(run, schema), "lm-learned")
    out = dataclasses.replace(start, **{k: getattr(start, k).copy() for k in Model.PARTS})
    parts = _parts(out)
    for row in learned.groupBy("part").applyInArrow(average, schema).collect():
        moved, values, at = np.frombuffer(row["weights"]) > 0, np.frombuffer(row["values"], np.float32), 0
        for k, piece in parts[row["part"]]:
            old = getattr(out, k)[piece]
            new = values[at : at + old.size].reshape(old.shape)
            getattr(out, k)[piece] = np.where(moved[:, None], new, old) if k == "embed" else new
            at += old.size
    drop_scratch(learned)
    return out


def fit(docs: DataFrame, tokenizer: str = TOKENIZER, full: int = ALL_CHARS, steps: int = STEPS) -> Model:
    """Counts the ids and learns from all windows of all documents outside the held-out fold.

    docs may be documents or what encoded() made of them. Up to `full` code points the driver
    learns, and a small corpus's windows are repeated until `steps` are done. Beyond, it learns the
    start from about that many code points' windows by hash, in the order of a hash, and then every
    task learns from all windows of its texts.
    """
    rows = (docs if "places" in docs.columns else encoded(docs, tokenizer)).filter("range is null and not held_out")
    total = 4 * (rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // (2 if bpe(tokenizer).size <= 1 << 16 else 4)
    lessons = _lessons(rows, tokenizer, min(1.0, full / max(1, total)))
    tok = bpe(tokenizer)
    end = tok.special["<|endoftext|>"]
    counts = np.zeros(tok.size)
    for r in lessons.filter("order is null").select("window").toLocalIterator():  # one for each task
        counts += np.frombuffer(r[0], np.int64)
    counts[end] += 1
    m = untrained(tok.size, end, counts)
    few = [r[0] for r in lessons.filter("order is not null").orderBy("order", "window").select("window").collect()]
    drop_scratch(lessons)
    if few:
        steps = max(steps, -(-len(few) // BATCH))
        m = learn(m, (_padded([few[i % len(few)] for i in range(t * BATCH, (t + 1) * BATCH)]) for t in range(steps)), steps)[0]
    if total <= full:
        return m
    tasks = max(min(3 * docs.sparkSession.sparkContext.defaultParallelism, total // 4 // TASK_LEAST), total // 4 // TASK_MOST, 1)
    return learn_everywhere(rows.coalesce(tasks), m)  # tasks take neighbouring blocks together, nothing is shuffled


def _word_counts(rows: DataFrame) -> DataFrame:
    """(block, at, counts, words, kinds): for places of each block's list, the words' counts in the whole training fold, in slices.

    Rows of block -1 carry what adds up to the number of training tokens and of distinct ones,
    without the end token; rows of block -2 the number of training documents.
    """
    schema = "block long, at binary, counts binary, words long, kinds long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def merge(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts")])
        values, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, counts, len(values)).astype(np.int64)
        back, start = total[place], 0
        out = [(-1, b"", b"", int(total.sum()), int((total > 0).sum()))]
        for block, at, h in zip(table.column("block").to_pylist(), table.column("at").to_pylist(), hashes, strict=True):
            out.append((block, at, back[start : start + len(h)].tobytes(), 0, 0))
            start += len(h)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)

    lists = rows.filter("range >= 0").select("range", "block", "hashes", "at", "counts")
    ends = rows.filter("range = -1").agg(F.coalesce(F.sum("training"), F.lit(0)).alias("words"))
    ends = ends.select(F.lit(-2).cast("long").alias("block"), F.lit(b"").alias("at"), F.lit(b"").alias("counts"), "words", F.lit(0).cast("long").alias("kinds"))
    return lists.groupBy("range").applyInArrow(merge, schema).union(ends)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, tokenizer: str = TOKENIZER, chars: int = BLOCK_CHARS) -> DataFrame:
    """Base and model log10 probabilities of every document; columns as in SCHEMA. docs may be documents or what encoded() made of them.

    Null texts count as empty: the end token alone. A null id is in the fold of the empty text.
    Repeated rows are counted and scored each, very long texts whole; an empty table gives no rows,
    and other columns, whatever their names, aren't read. Without training documents every word is
    unknown.
    """
    rows = docs if "places" in docs.columns else encoded(docs, tokenizer, chars)
    counts = materialise(_word_counts(rows), "lm-counts")
    sums = counts.filter("block < 0").groupBy("block").agg(F.sum("words"), F.sum("kinds")).collect()
    by = {r[0]: (r[1], r[2]) for r in sums}
    ends = by.get(-2, (0, 0))[0]
    words, distinct = by.get(-1, (0, 0))
    n_train, v_train = words + ends, distinct + (ends > 0)
    scale = np.log10(n_train + 0.5 * (v_train + 1))
    end_value = float(np.log10(ends + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Table, table: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        at = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(x.as_buffer(), np.int32) for x in table.column("at"))])
        found = np.zeros(len(at), np.int64)
        found[at] = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))])
        value = np.log10(found + 0.5)
        out: list[tuple] = []
        for *named, raw in zip(*(texts.column(c).to_pylist() for c in ("block", "row", "doc_id", "held_out", "places")), strict=True):
            place = np.frombuffer(raw, np.int32)
            tokens = len(place) + 1
            out.append((*named, tokens, int((found[place] > 0).sum()) + (ends > 0), n_train, float(value[place].sum()) + end_value - tokens * scale))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 8, kinds, strict=True)], names=base_names)

    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, size = _scorer(shared.value), len(shared.value.classes)
        for batch in batches:
            scores = [scorer([_ids(x.as_py(), size) for x in batch.column(2)[at : at + 64]]) / LN10 for at in range(0, batch.num_rows, 64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.empty(0), *scores]))], names=["block", "row", "score"])

    base_schema = "block long, row long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double"
    base_names = [x.split()[0] for x in base_schema.split(", ")]
    mine = counts.filter("block >= 0").select("block", "at", "counts")
    asked = rows.filter("range is null")
    base = asked.select("block", "row", "doc_id", "held_out", "places").groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(run, base_schema)
    # ids are scored where they lie; only places meet their block's counts
    attended = asked.select("block", "row", "ids").mapInArrow(attend, "block long, row long, score double")
    return base.join(attended, ["block", "row"]).select(*[x.split()[0] for x in SCHEMA.split(", ")])


_SCORERS: dict[int, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """One scorer in each Python process and model."""
    if id(model) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model)] = Scorer(model)
    return _SCORERS[id(model)]
