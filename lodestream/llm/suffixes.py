"""Removal of repeated substrings by suffix sorting.

A byte is removed if it lies in a string of LENGTH bytes that also starts in a
document with a smaller doc_id. Strings are judged on the input.

1. anchors: every window of LENGTH bytes names the smallest hash of its GRAM-byte
   strings as its anchor (leftmost of equal ones). Equal windows have equal
   anchors, so an anchor found in one document only rules its windows out. The
   windows of an anchor are consecutive and are handled as one run. Anchors are
   dealt out by hash, packed, with the document part they came from; the
   reducers answer each part with the anchors that occur elsewhere too.
2. contexts: parts look up their runs and send the bytes they span to the
   anchor's task, those of equal contexts of the part once, for the smallest
   doc_id (combined before the shuffle).
3. suffix sorting: each task concatenates its contexts, equal ones once with all
   their owners, and sorts their suffixes in two stages: those smaller than
   their successor are sorted directly, the rest are induced by scanning the
   buckets of first bytes in order. Neighbours whose common prefix is LENGTH or
   more form groups; a group's windows are removed from every owner with a
   larger doc_id than its smallest.
4. windows found are merged to spans, document part by document part.

Documents are dealt into parts of about DOC_PART bytes and anchors to reducers
for about ASK_PART bytes of text each, by hash, so a task's memory follows
neither the input nor a key's frequency: an anchor counts once per batch and
part, a context once per part.

Defined results: a null text is empty; texts under LENGTH bytes are kept whole;
rows with a null doc_id are kept whole and remove nothing; rows that repeat a
doc_id get the same result if they have the same text; different texts under one
doc_id all take part, and none removes from another; repeats within a document
stay; equal strings are ordered by doc_id alone, so ties change nothing; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, partitions, tidy, worker_cache

LENGTH = 50
GRAM = 20
#: Bytes hashed at a time; longer documents are cut with an overlap.
BLOCK = 1 << 18
#: Bytes of contexts sorted at a time; sorting takes some fifty bytes of memory for each.
SORTED = 1 << 22
#: Bytes of text in a document part, and for each reducer, about.
DOC_PART, ASK_PART = 8 << 20, 6 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64, to the powers 0..n-1."""
    cache = worker_cache()
    held = cache.get("powers")
    if held is None or len(held[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        out = []
        for b in (BASE, inverse):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        held = cache["powers"] = tuple(out)
    return held[0][:n], held[1][:n]


def anchor_runs(text: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor in concatenated texts that end at `ends`.

    -> (start, windows, key): where a run's first window starts, how many
    windows it has, and the anchor's hash. len(text) < 2^24.
    """
    n = len(text)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    have, want = 1, length - gram + 1
    while have < want:
        step = min(have, want - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    at = (m & low).astype(np.int64)
    # windows that cross the end of a text don't count
    ok = np.ones(len(at), bool)
    for e in ends[:-1]:
        ok[max(0, e - length + 1) : e] = False
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(at)))
    use = ok[start]
    start, count = start[use], count[use]
    return start, count, h[at[start]]


def blocks(ids: list, texts: list, length: int, most: int):
    """(bytes, ends, owner, base) of concatenated pieces; owner: row of each piece, base: its place in the text."""
    held, size, owner, base = [], 0, [], []
    for row, (i, t) in enumerate(zip(ids, texts)):
        if i is None or t is None or len(t) < length:
            continue
        for s in range(0, max(1, len(t) - length + 1), most):
            piece = t[s : s + most + length - 1]
            held.append(piece)
            owner.append(row)
            base.append(s)
            size += len(piece)
            if size >= most:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), np.array(owner), np.array(base, np.int64)
                held, size, owner, base = [], 0, [], []
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), np.array(owner), np.array(base, np.int64)


def runs_of(ids: list, texts: list, length: int, gram: int):
    """(row, start, windows, key) of all runs of these documents."""
    rows, starts, counts, keys = [], [], [], []
    for text, ends, owner, base in blocks(ids, texts, length, BLOCK):
        s, c, k = anchor_runs(text, ends, length, gram)
        piece = np.searchsorted(ends, s, side="right")
        begin = np.concatenate(([0], ends[:-1]))
        rows.append(owner[piece])
        starts.append(s - begin[piece] + base[piece])
        counts.append(c)
        keys.append(k)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in (rows, starts, counts, keys))


def utf8(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def short(key: np.ndarray) -> np.ndarray:
    """47 bits of an anchor's hash: enough to rule anchors out, bytes decide later."""
    return key >> np.uint64(17)


def anchor_rows(docs: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(p, doc_parts, sizes, keys): the anchors of a batch for reducer p, sorted by document part."""

    def emit(acc):
        key = np.concatenate([a[0] for a in acc])
        part = np.concatenate([a[1] for a in acc])
        row = np.concatenate([a[2] for a in acc])
        order = np.lexsort((row, part, key))
        key, part, row = key[order], part[order], row[order]
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new = new_key | np.concatenate(([True], part[1:] != part[:-1]))
        # shared already here: two documents of this batch have the anchor
        group = np.cumsum(new_key) - 1
        begin = np.flatnonzero(new_key)
        many = np.maximum.reduceat(row, begin) != np.minimum.reduceat(row, begin)
        key, part, flag = key[new], part[new], many[group[new]]
        p = (key % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((part, p))
        key, part, flag, p = key[order], part[order], flag[order], p[order]
        value = key << np.uint64(1) | flag.astype(np.uint64)
        cut = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        out = []
        for s, e in zip(cut, np.append(cut[1:], len(p))):
            d, n = np.unique(part[s:e], return_counts=True)
            out.append((int(p[s]), d.astype("<u4").tobytes(), n.astype("<u4").tobytes(), pack48(value[s:e])))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["p", "doc_parts", "sizes", "keys"])

    def run(batches):
        acc, held, row0 = [], 0, 0
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                ids, texts = part.column("doc_id").to_pylist(), utf8(part.column("text"))
                row, _, _, key = runs_of(ids, texts, length, gram)
                if len(row):
                    place = part.column("part").to_numpy().astype(np.int64)
                    acc.append((short(key), place[row], row + row0))
                    held += len(row)
                row0 += part.num_rows
                if held > 1_000_000:
                    yield emit(acc)
                    acc, held = [], 0
        if acc:
            yield emit(acc)

    return docs.mapInArrow(tidy(run), "p int, doc_parts binary, sizes binary, keys binary")


def shared_anchors(table: pa.Table) -> pa.Table:
    """One reducer's answer: per document part, its anchors that occur in another document."""
    keys, places = [], []
    for d, n, k in zip(*(table.column(c).to_pylist() for c in ("doc_parts", "sizes", "keys"))):
        keys.append(unpack48(k))
        places.append(np.repeat(np.frombuffer(d, "<u4"), np.frombuffer(n, "<u4")))
    value, place = np.concatenate(keys), np.concatenate(places).astype(np.int64)
    key, flag = value >> np.uint64(1), (value & np.uint64(1)).astype(bool)
    order = np.argsort(key, kind="stable")
    key, place, flag = key[order], place[order], flag[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(key)))
    shared = (size > 1) | np.logical_or.reduceat(flag, begin)
    use = np.repeat(shared, size)
    key, place = key[use], place[use]
    order = np.lexsort((key, place))
    key, place = key[order], place[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    key, place = key[fresh], place[fresh]
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, int)
    rows = [(int(place[s]), pack48(key[s:e])) for s, e in zip(cut, np.append(cut[1:], len(place)))]
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary())})


def variants(ids: list, texts: list, length: int) -> list[int]:
    """The place of each text of at least `length` bytes among the different ones of its doc_id, in their order (-1: shorter)."""
    of: dict = {}
    for i, t in zip(ids, texts):
        if len(t) >= length:
            of.setdefault(i, set()).add(t)
    order = {i: {t: n for n, t in enumerate(sorted(ts))} for i, ts in of.items() if len(ts) > 1}
    return [-1 if len(t) < length else order[i][t] if i in order else 0 for i, t in zip(ids, texts)]


SENT = "q int, keys binary, docs binary, variants binary, starts binary, windows binary, bytes binary, parts binary, found binary"
#: A removed interval; part: of its document.
SPAN = [("part", np.int32), ("doc", np.int64), ("variant", np.int32), ("start", np.int64), ("end", np.int64)]
SENT_SCHEMA = pa.schema([("q", pa.int32())] + [(f.split()[0], pa.binary()) for f in SENT.split(", ")[1:]])


def spans(part, doc, variant, start, end) -> np.ndarray:
    out = np.zeros(len(doc), SPAN)
    for name, x in zip(out.dtype.names, (part, doc, variant, start, end)):
        out[name] = x
    return out


def merged(x: np.ndarray) -> np.ndarray:
    """Disjoint, non-touching intervals per document and variant, by part."""
    if not len(x):
        return x
    x = x[np.lexsort((x["start"], x["variant"], x["doc"], x["part"]))]
    # running maximum of ends within a document: shift documents apart
    rank = np.concatenate(([0], np.cumsum((x["doc"][1:] != x["doc"][:-1]) | (x["variant"][1:] != x["variant"][:-1]) | (x["part"][1:] != x["part"][:-1]))))
    wide = int(x["end"].max()) + 1
    reach = np.maximum.accumulate(x["end"] + rank * wide)
    new = np.concatenate(([True], x["start"][1:] + rank[1:] * wide > reach[:-1]))
    begin = np.flatnonzero(new)
    out = x[begin]
    out["end"] = reach[np.append(begin[1:], len(x)) - 1] - rank[begin] * wide
    return out


def contexts(left: pa.Table, right: pa.Table, parts: int, length: int, gram: int) -> pa.Table:
    """A document part's shared runs, packed for their reducers, and what is known already."""
    blobs = right.column("keys").to_pylist()
    if not blobs or not left.num_rows:
        return SENT_SCHEMA.empty_table()
    wanted = np.sort(np.concatenate([unpack48(b) for b in blobs]))
    own = left.column("part")[0].as_py()
    ids, texts = left.column("doc_id").to_pylist(), utf8(left.column("text"))
    of = variants(ids, texts, length)
    first: dict = {}
    found, kept = [], []
    seen = set()
    for s in range(0, len(ids), 256):
        sub_ids = ids[s : s + 256]
        for k, i in enumerate(sub_ids):  # rows that repeat a document count once
            if i is not None:
                if (i, of[s + k]) in seen:
                    sub_ids[k] = None
                seen.add((i, of[s + k]))
        row, start, count, key = runs_of(sub_ids, texts[s : s + 256], length, gram)
        brief = short(key)
        at = np.searchsorted(wanted, brief)
        at[at == len(wanted)] = 0
        hit = np.flatnonzero(wanted[at] == brief)
        for r, a, n, k in zip((row[hit] + s).tolist(), start[hit].tolist(), count[hit].tolist(), key[hit].tolist()):
            c = texts[r][a : a + n + length - 1]
            doc, place = ids[r], (of[r], a)
            e = first.get((k, c))
            if e is None or doc < e[0]:
                if e is not None:
                    found += [(own, e[0], v, x, x + len(c)) for v, x in e[1:]]
                first[k, c] = [doc, place]
            elif doc > e[0]:
                found.append((own, doc, *place, a + len(c)))
            else:
                e.append(place)
    for (k, c), e in first.items():
        kept += [(k, e[0], v, a, len(c) - length + 1, c) for v, a in e[1:]]
    columns = list(zip(*kept)) if kept else [()] * 6
    key, doc, variant, start, count = (np.array(x, t) for x, t in zip(columns, (np.uint64, np.int64, np.int32, np.int64, "<u2")))
    q = ((key >> np.uint64(17)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(q, kind="stable")
    q_sorted = q[order]
    cut = np.flatnonzero(np.concatenate(([True], q_sorted[1:] != q_sorted[:-1]))) if len(q) else np.zeros(0, int)
    rows = []
    for s, e in zip(cut, np.append(cut[1:], len(q))):
        o = order[s:e]
        rows.append((int(q_sorted[s]), *(x[o].tobytes() for x in (key, doc, variant, start, count)), b"".join([columns[5][i] for i in o]), np.full(len(o), own, np.int32).tobytes(), b""))
    known = merged(np.array(found, SPAN))
    if len(known):
        rows.append((own % parts, *[b""] * 7, known.tobytes()))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SENT_SCHEMA)], schema=SENT_SCHEMA) if rows else SENT_SCHEMA.empty_table()


def words_at(text: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte words from every position (zeros behind the end)."""
    padded = np.concatenate([text, np.zeros(72, np.uint8)])
    w = np.zeros(len(text) + 64, np.uint64)
    for k in range(8):
        w <<= np.uint64(8)
        w |= padded[k : k + len(w)]
    return w


def two_stage(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of concatenated strings, sorted to at least `depth` bytes; a string's end comes before any byte.

    text has a free position after each string (its end mark); ends: those
    positions. Returned without the end marks.
    """
    n = len(text)
    t = text.astype(np.int16) + 1
    t[ends] = 0
    # smaller than the successor: the next different symbol is larger
    step = np.sign(np.diff(t, append=np.int16(0)))
    change = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(change[::-1])[::-1]
    nxt[nxt == n] = n - 1
    b = (step[nxt] > 0) & (t > 0)
    # first stage: direct sort, words of 7 symbols, refining what is still tied
    pos = np.flatnonzero(b)
    word = np.zeros(n + depth + 8, np.int64)
    wide = np.concatenate([t, np.zeros(depth + 16, np.int16)]).astype(np.int64)
    for k in range(7):
        word <<= 9
        word |= wide[k : k + len(word)]
    order = np.argsort(word[pos], kind="stable")
    pos = pos[order]
    v = word[pos]
    tied = np.concatenate(([False], v[1:] == v[:-1]))
    for d in range(7, depth, 7):
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            break
        group = np.cumsum(~tied[at])
        v = word[pos[at] + d]
        o = np.lexsort((v, group))
        pos[at] = pos[at][o]
        v, group = v[o], group[o]
        tied[at] = np.concatenate(([False], (v[1:] == v[:-1]) & (group[1:] == group[:-1])))
    # second stage: scan the buckets in order; predecessors that are larger than their successor fall into later places
    start_b = np.searchsorted(t[pos], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def induce(done: np.ndarray, c: int) -> np.ndarray:
        """Deals the predecessors of `done` to later buckets; returns those of bucket c itself."""
        p = done[done > 0] - 1
        p = p[~b[p] & (t[p] >= max(c, 1))]
        own = p[t[p] == c]
        p = p[t[p] > c]
        if len(p):
            ch = t[p]
            o = np.argsort(ch, kind="stable")
            p, ch = p[o], ch[o]
            cut = np.flatnonzero(np.concatenate(([True], ch[1:] != ch[:-1])))
            for s, e in zip(cut, np.append(cut[1:], len(p))):
                waiting[ch[s]].append(p[s:e])
        return own

    induce(ends, 0)
    for c in range(1, 257):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(level):
            out.append(level)
            level = induce(level, c)
        direct = pos[start_b[c] : start_b[c + 1]]
        if len(direct):
            out.append(direct)
            induce(direct, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, counted up to `most` (at most 56) bytes."""
    w = words_at(text)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(0, most, 8):
        x = w[order[live] + k] ^ w[order[live - 1] + k]
        same = x == 0
        part = x[~same]
        lead = np.zeros(len(part), np.int64)
        for s in (32, 16, 8):
            zero = part >> np.uint64(64 - s) == 0
            lead += zero * (s // 8)
            part = np.where(zero, part << np.uint64(s), part)
        out[live[~same]] = k + lead
        live = live[same]
    out[live] = most
    return np.minimum(out, most)


def batches_of(use: np.ndarray, anchor: np.ndarray, at: np.ndarray, most: int = SORTED):
    """Contexts ordered by anchor, in batches of whole anchors of about `most` bytes: only those of one anchor can share a window."""
    if len(use):
        size = np.cumsum(at[use + 1] - at[use])
        first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
        cut = first[np.concatenate(([True], np.diff(size[first] // most) > 0))]
        yield from np.split(use, cut[1:])


def sorted_out(pieces: list[bytes], least: np.ndarray, length: int):
    """(piece, place, low) of every window of distinct contexts: low the smallest of `least` among the contexts that hold it."""
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    order = two_stage(text, ends, length)
    piece = np.searchsorted(ends, order, side="left")
    whole = ends[piece] - order >= length
    order, piece = order[whole], piece[whole]
    new = common_prefixes(text, order, length) < length
    new[:1] = True
    low = np.minimum.reduceat(least[piece], np.flatnonzero(new))[np.cumsum(new) - 1]
    return piece, order - np.concatenate(([0], ends[:-1] + 1))[piece], low


def windows_found(table: pa.Table, length: int) -> pa.Table:
    """One reducer's answer: intervals to remove, per document part."""
    cols = {c: table.column(c).to_pylist() for c in SENT_SCHEMA.names[1:] if c != "bytes"}
    join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in cols[c]])
    key, doc, variant, start, count, part = join("keys", np.uint64), join("docs", np.int64), join("variants", np.int32), join("starts", np.int64), join("windows", "<u2").astype(np.int64), join("parts", np.int32)
    found = [join("found", SPAN)]
    if len(key):
        raw = b"".join([memoryview(x.as_buffer()) for x in table.column("bytes")])
        at = np.concatenate(([0], np.cumsum(count + length - 1)))
        by_key = np.argsort(key, kind="stable")
        for some in batches_of(by_key, key[by_key], at):
            # equal contexts are sorted once, for all their owners
            number: dict = {}
            cls = np.array([number.setdefault((key[i], raw[at[i] : at[i + 1]]), len(number)) for i in some])
            least, most = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), np.iinfo(np.int64).min)
            np.minimum.at(least, cls, doc[some])
            np.maximum.at(most, cls, doc[some])
            # contexts of one document whose anchor has no other have nothing to be compared with
            _, inv, size = np.unique(np.array([k for k, _ in number], np.uint64), return_inverse=True, return_counts=True)
            use = np.flatnonzero((size[inv] > 1) | (most > least))
            if not len(use):
                continue
            pieces = [c for _, c in number]
            piece, place, low = sorted_out([pieces[i] for i in use], least[use], length)
            new_number = np.full(len(number), -1)
            new_number[use] = np.arange(len(use))
            # an owner with a larger doc_id than all of its windows' smallest loses the whole context, the smallest owner single windows
            highest = np.full(len(use), -1, np.int64)
            np.maximum.at(highest, piece, low)
            mine = new_number[cls]
            some, mine = some[mine >= 0], mine[mine >= 0]
            gone = doc[some] > highest[mine]
            x = some[gone]
            found.append(spans(part[x], doc[x], variant[x], start[x], start[x] + count[x] + length - 1))
            x, mine = some[~gone], mine[~gone]
            single = low < least[use][piece]
            piece, place = piece[single], place[single]
            o = np.argsort(piece, kind="stable")
            piece, place = piece[o], place[o]
            lo, hi = np.searchsorted(piece, mine), np.searchsorted(piece, mine, side="right")
            owner = np.repeat(x, hi - lo)
            where = start[owner] + place[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(len(owner))] if len(owner) else np.zeros(0, np.int64)
            found.append(spans(part[owner], doc[owner], variant[owner], where, where + length))
    x = merged(np.concatenate(found))
    cut = np.flatnonzero(np.concatenate(([True], x["part"][1:] != x["part"][:-1]))) if len(x) else np.zeros(0, int)
    rows = [(int(x["part"][s]), x[s:e].tobytes()) for s, e in zip(cut, np.append(cut[1:], len(x)))]
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "found": pa.array([r[1] for r in rows], pa.binary())})


#: Names that a table of documents won't have.
ID, PART = "_lodestream_id", "_lodestream_part"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_out(left: pa.Table, right: pa.Table, length: int, rewrite: bool) -> pa.Table:
    """What is left of a part's documents: digests, or their rows with the text rewritten."""
    ids, whole = left.column(ID).to_pylist(), [t or b"" for t in utf8(left.column("text"))]
    x = merged(np.concatenate([np.zeros(0, SPAN), *(np.frombuffer(b, SPAN) for b in right.column("found").to_pylist())]))
    a, z, lo = x["start"], x["end"], {}
    if len(x):
        cut = np.flatnonzero(np.concatenate(([True], (x["doc"][1:] != x["doc"][:-1]) | (x["variant"][1:] != x["variant"][:-1]))))
        lo = {(int(x["doc"][s]), int(x["variant"][s])): (s, e) for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(x)])}
    out = []
    for i, t, v in zip(ids, whole, variants(ids, whole, length)):
        s, e = lo.get((i, v), (0, 0))
        kept, at, gone = [], 0, 0
        for x, y in zip(a[s:e].tolist(), z[s:e].tolist()):
            kept.append(t[at:x])
            at = y
            gone += y - x
        kept.append(t[at:])
        # characters that were cut into are dropped from rewritten texts
        out.append("".join(k.decode("utf-8", "ignore") for k in kept) if rewrite else (i, len(t), gone, e - s, hashlib.sha256(b"".join(kept)).hexdigest()))
    if not rewrite:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=[f.split()[0] for f in RESULT.split(", ")])
    left = left.drop_columns([ID, PART])
    same = [t is None for t in left.column("text").to_pylist()]
    new = pa.array([None if s else t for s, t in zip(same, out)], left.schema.field("text").type)
    left = left.set_column(left.schema.get_field_index("text"), "text", new)
    if "n_chars" in left.column_names:
        n = pa.array([None if t is None else len(t) for t in new.to_pylist()], left.schema.field("n_chars").type)
        left = left.set_column(left.schema.get_field_index("n_chars"), "n_chars", n)
    return left


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, rewrite: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    rewrite: the rows of docs instead, with the bytes gone from text and n_chars
    counted again.
    """
    least = partitions(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    parts, n_doc_parts = max(least, size // ASK_PART), max(least, size // DOC_PART) | 1

    def part_of(doc_id: str):
        h = F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64("text"))
        return F.pmod(h, F.lit(n_doc_parts)).cast("int")

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("part", part_of("doc_id"))
    rows = anchor_rows(placed, parts, length, gram)
    shared = materialize(rows.groupBy("p").applyInArrow(lambda t: shared_anchors(t), "part int, keys binary"))
    sent = placed.where(F.octet_length("text") >= length).groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(lambda l, r: contexts(l, r, parts, length, gram), SENT)
    found = materialize(sent.groupBy("q").applyInArrow(lambda t: windows_found(t, length), "part int, found binary"))
    drop(shared)
    own = (docs if rewrite else placed.drop("part")).withColumn(ID, F.col("doc_id").cast("long")).withColumn(PART, part_of(ID))
    schema = docs.schema if rewrite else RESULT
    return own.groupBy(PART).cogroup(found.groupBy("part")).applyInArrow(lambda l, r: cut_out(l, r, length, rewrite), schema)
