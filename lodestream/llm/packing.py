"""Packing of token streams into windows by Karmarkar-Karp multiway differencing.

Documents are cut into whole windows and a remainder. The remainders of a
block of documents are spread over m windows by differencing: every item
starts as a partial partition with one load; the two partial partitions of the
largest spread are merged, the fullest windows of one with the emptiest of the
other, until one is left. m starts at the least count that could hold the
tokens and rises whenever a window is over capacity. The emptiest of the
near-equal windows are then cut up to fill the others, and the one partly
filled window left is written as sequences whose lengths are powers of two, so
nothing is padded.

Blocks are runs of an input partition's rows: nothing is shuffled, memory is a
block's, and a lost task is redone alone. sequence_id is the input partition's
number and a counter.

Defined results: a null or empty text is its end token; repeated rows are
packed as often as they occur; a null doc_id is carried through; very long
texts become many full windows; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .tokens import Encoder, default_tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Item numbers of each of m windows, by largest differencing.

    A partial partition is its non-zero windows, ascending by load, above
    m - len(...) empty ones. A window is load << 40 | the number of the tree
    that holds its items.
    """
    trees: list = list(range(len(sizes)))
    low = (1 << 40) - 1
    heap = [(-s, i, [s << 40 | i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    ticket = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # the emptiest of a meet the fullest of b: as many as there are windows too many
        over = max(0, len(a) + len(b) - m)
        merged = a[over:] + b[over:]
        for x, y in zip(a[:over], b[:over][::-1]):
            trees.append((x & low, y & low))
            merged.append(((x >> 40) + (y >> 40)) << 40 | len(trees) - 1)
        merged.sort()
        spread = (merged[-1] >> 40) - (merged[0] >> 40 if len(merged) == m else 0)
        heapq.heappush(heap, (-spread, ticket, merged))
        ticket += 1
    out = []
    for w in heap[0][2] if heap else []:
        flat, stack = [], [w & low]
        while stack:
            x = trees[stack.pop()]
            if isinstance(x, int):
                flat.append(x)
            else:
                stack.extend(x)
        out.append(flat)
    return out


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers, none over capacity; each size is at most capacity."""
    total = sum(sizes)
    m = max(1, -(-total // capacity))
    while True:
        windows = differencing(sizes, m)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in windows)
        if not over:
            return windows
        m += max(1, over // capacity)


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length): every token once, every length capacity or a power of two."""
    sequences, rest = [], []
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        sequences += [[(d, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            rest.append((d, whole, n - whole))
    windows = [[rest[i] for i in w] for w in near_equal([r[2] for r in rest], capacity)] if rest else []
    windows.sort(key=lambda w: sum(p[2] for p in w))
    i, j = 0, len(windows) - 1
    while i < j:
        room = capacity - sum(p[2] for p in windows[j])
        while room and i < j:
            d, s, n = windows[i].pop()
            take = min(n, room)
            if take < n:
                windows[i].append((d, s, n - take))
            windows[j].append((d, s + n - take, take))
            room -= take
            if not windows[i]:
                i += 1
        if not room:
            sequences.append(windows[j])
            j -= 1
    if i == j and windows:
        pieces = windows[i]
        total = sum(p[2] for p in pieces)
        for power in (1 << b for b in range(total.bit_length() - 1, -1, -1)):
            if total & power:
                room, seq = power, []
                while room:
                    d, s, n = pieces.pop()
                    take = min(n, room)
                    if take < n:
                        pieces.append((d, s + take, n - take))
                    seq.append((d, s, take))
                    room -= take
                sequences.append(seq)
    return sequences


def packed(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 1, block: int = 512) -> DataFrame:
    """One row per piece of a document in a sequence."""
    path = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        encoder = Encoder.held(path)
        sequence = TaskContext.get().partitionId() << 36
        for b in batches:
            for s in range(0, b.num_rows, block):
                part = b.slice(s, block)
                ids = part.column("doc_id").to_pylist()
                codes = [c + end for c in encoder.encode(part.column("text").to_pylist())]
                cols = [[] for _ in range(7)]
                for seq in pack([len(c) // 4 for c in codes], capacity):
                    at = 0
                    for d, start, n in seq:
                        for col, v in zip(cols, (ids[d], start, n, zlib.crc32(codes[d][4 * start : 4 * (start + n)]), len(codes[d]) // 4, sequence, at)):
                            col.append(v)
                        at += n
                    sequence += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), SCHEMA)
