"""Hierarchical multi-length packing of token sequences.

Each task tokenises its documents and packs them as it goes, so token ids never cross the
network and nothing but lengths outlives a chunk. A chunk of documents is routed to context
tiers: whole windows of the longest tier are cut off first, and what is left of a document goes
to the shortest tier that holds it. Each tier is packed best fit, longest first. Gaps in the
windows of the longest tier are filled from the shorter tiers, cutting where needed; shorter
tiers' windows that are exactly full stay as they are, so that they need no padding, and the
contents of the others move up to fill longer windows. Only a task's last window can be padded.
Windows are then dealt to step groups whose token counts differ by at most one window of a tier.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

TIERS = (128, 256, 512, 1024)
END = 0
#: Tokens a task gathers before it packs them.
CHUNK = 1 << 20
STEP = 8 * 1024

_BPE: dict[str, "Bpe"] = {}


class Bpe:
    """A byte-level BPE vocabulary read from a rank file; ids are those of the same vocabulary's JSON file."""

    def __init__(self, path: str, special: dict[str, int] | None = None):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = special or {}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.size = max([*ranks.values(), *self.special.values()]) + 1

    def encode(self, text: str) -> np.ndarray:
        if self.special and any(s in text for s in self.special):
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4")
        try:
            return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False)
        except UnicodeEncodeError:  # lone surrogates
            return np.array(self.encoding.encode_ordinary(text), "<u4")


def bpe(name: str = "byte_bpe_50k.tiktoken") -> Bpe:
    """The tokenizer of that file, one in each Python process. The special token's text gives its id, as in the JSON file."""
    if name not in _BPE:
        from public_tokenizers import path

        _BPE[name] = Bpe(path(name), {"<|endoftext|>": 50256})
    return _BPE[name]


class Packer:
    """Packs pieces (key, start, length) into windows; open windows are carried from chunk to chunk.

    A window is a list of pieces. full() returns windows that are exactly as long as a tier; the
    rest stays open until close().
    """

    def __init__(self, tiers=TIERS):
        self.tiers = sorted(tiers)
        self.top = self.tiers[-1]
        self.loose: list[tuple] = []  # what no full window has taken yet

    def full(self, documents: list[tuple]) -> list[list[tuple]]:
        """documents: (key, start, length). Windows that are full; what doesn't fill one is kept."""
        done: list[list[tuple]] = []
        routed: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        for key, start, length in [*self.loose, *documents]:
            while length >= self.top:
                done.append([(key, start, self.top)])
                start, length = start + self.top, length - self.top
            if length:
                routed[self.tiers[bisect_left(self.tiers, length)]].append((key, start, length))
        rest: list[tuple[int, list[tuple]]] = []  # (room, pieces) of windows of the top tier
        spare: list[tuple] = []
        for tier in self.tiers:
            for room, pieces in best_fit(routed[tier], tier):
                if not room:
                    done.append(pieces)
                elif tier == self.top:
                    rest.append((room, pieces))
                else:
                    spare.extend(pieces)
        # fill the long windows' gaps from the shorter tiers: the longest piece that fits, then a cut one
        spare.sort(key=lambda p: p[2])
        lengths = [p[2] for p in spare]
        rest.sort(key=lambda w: w[0])
        open_windows = []
        for room, pieces in rest:
            while room and spare:
                at = max(0, bisect_left(lengths, room + 1) - 1)
                key, start, length = spare.pop(at)
                lengths.pop(at)
                used = min(room, length)
                pieces.append((key, start, used))
                room -= used
                if used < length:
                    place = bisect_left(lengths, length - used)
                    spare.insert(place, (key, start + used, length - used))
                    lengths.insert(place, length - used)
            (open_windows if room else done).append(pieces)
        # without shorter pieces left, open windows are joined end to end; so are spare pieces without windows
        done_more, self.loose = chain([*(p for w in open_windows for p in w), *reversed(spare)], self.top)
        return done + done_more

    def close(self) -> list[list[tuple]]:
        last, self.loose = self.loose, []
        return [last] if last else []


def best_fit(pieces: list[tuple], size: int) -> list[list]:
    """[room, pieces] of windows of that size, each piece whole: longest first, into the fullest window that holds it."""
    rooms: list[tuple[int, int]] = []
    windows: list[list] = []
    for piece in sorted(pieces, key=lambda p: -p[2]):
        at = bisect_left(rooms, (piece[2], -1))
        if at < len(rooms):
            room, w = rooms.pop(at)
        else:
            room, w = size, len(windows)
            windows.append([size, []])
        windows[w][0] = room - piece[2]
        windows[w][1].append(piece)
        if room > piece[2]:
            insort(rooms, (room - piece[2], w))
    return windows


def chain(pieces: list[tuple], size: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Windows of exactly that size, cut where they are full, and the pieces that are left."""
    done, now, room = [], [], size
    for key, start, length in pieces:
        while length:
            used = min(room, length)
            now.append((key, start, used))
            start, length, room = start + used, length - used, room - used
            if not room:
                done.append(now)
                now, room = [], size
    return done, now


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", tiers=TIERS, chunk: int = CHUNK, step: int = STEP) -> DataFrame:
    """(doc_id, text) -> a row for each piece of a document in a sequence.

    A null text counts as empty: its document is the end id alone. Repeated rows are packed each
    on its own. sequence_id: the task's number times 2**32 plus the sequence's in the task;
    step_group likewise numbers groups of at most `step` tokens, made of sequences of all tiers in
    the order they were filled. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = bpe(tokenizer).encode, Packer(tiers)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        held: dict[int, tuple] = {}  # key -> doc_id, ids, tokens not written yet
        state = {"sequence": 0, "step": 0, "in_step": 0}
        end = np.array([END], "<u4")

        def rows(windows: list[list[tuple]]) -> pa.RecordBatch:
            out: list[tuple] = []
            for window in windows:
                total = sum(p[2] for p in window)
                if state["in_step"] + total > step and state["in_step"]:
                    state["step"], state["in_step"] = state["step"] + 1, 0
                state["in_step"] += total
                offset, tier = 0, next(t for t in packer.tiers if t >= total)
                for key, start, length in window:
                    doc_id, ids, left = held[key]
                    out.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), base + state["sequence"], offset, tier, base + state["step"]))
                    offset += length
                    if left > length:
                        held[key] = (doc_id, ids, left - length)
                    else:
                        del held[key]
                state["sequence"] += 1
            columns = list(zip(*out)) or [()] * 9
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        waiting, tokens, serial = [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py()), end])
                held[serial] = (doc_id, ids, len(ids))
                waiting.append((serial, 0, len(ids)))
                serial, tokens = serial + 1, tokens + len(ids)
                if tokens >= chunk:
                    yield rows(packer.full(waiting))
                    waiting, tokens = [], 0
        yield rows(packer.full(waiting))
        yield rows(packer.close())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA)
