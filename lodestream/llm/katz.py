"""Language-model scores: a Katz backoff n-gram model, learned and evaluated over parts of bounded size.

For k = ORDER down to 2, with h the k - 1 tokens before w and h' the last k - 2:

    P_k(w | h) = d_k(c) * c(h, w) / t(h)     if the k-gram was seen c > 0 times
               = a_k(h) * P_{k-1}(w | h')    if h was seen and the k-gram was not
               = P_{k-1}(w | h')             if h was never seen
    P_1(w)     = (c(w) + 0.5) / (N + 0.5 * (V + 1))

d_k are Good-Turing discounts for counts up to 5 (1 above), from the k-grams'
own counts of counts. t(h) is c(h), or c(h) + 1 where all of h's counts are too
large to be discounted. a_k(h) is normalised exactly: the mass the discounts
free, over the P_{k-1} mass of the words not seen after h. So every P_k sums to
1 over the V known words and one for all others.

Documents are encoded once into parts: runs of an input partition's rows of
about PART bytes of text, each a row of word hashes and positions, written to
shared storage. Every later step handles one part, or one reducer's share of
keys, at a time, so a task's memory follows PART and not the corpus; there are
as many reducers as the keys need. A part asks reducers for the counts of its
distinct k-grams, combined beforehand, so the commonest word is asked for once
per part. What is learned are tables in shared storage: `grams` (k, key,
count), one row per distinct k-gram, and `backoff` (k, history, log10 weight,
whether t is c + 1), both partitioned by k. The weights of each order come
from the next lower one: each distinct k-gram is counted by one part, its
owner, which knows P_{k-1} of its word. The driver sees a few sums per reducer.

k-grams are known by 64-bit hashes.

Defined results: a null or empty text is the end token alone; documents with a
null doc_id are scored, not learned from and not held out; repeated rows are
learned from and scored as often as they occur; without any training document
every count is 0; an empty table gives no rows; extra columns are ignored;
equal counts need no order, so ties cannot change a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_class, drop, materialize, partitions, tidy

BEGIN, FINISH = 1, 2
DISCOUNTED = 5
ORDER = 2
#: Bytes of text in a part, about; a longer document is a part of its own.
PART = 8 << 20
#: Distinct k-grams that a reducer is asked for, about.
SHARE = 1_000_000

PARTS = "part long, ids array<long>, train binary, sizes binary, words binary, tokens binary, grams long"
ASK = "q int, part long, k int, n int, keys binary, x binary, y binary"
TOLD = "what string, part long, q int, k int, n int, x binary, key long, history long, count long, weight double, plus_one boolean"


def columns_of(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return [(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]


def table_of(rows: list[dict], schema: str) -> pa.Table:
    return pa.table([pa.array([r.get(n) for r in rows], kind) for n, kind in columns_of(schema)], names=[n for n, _ in columns_of(schema)])


def packed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), 1)


def unpacked(raw: bytes, kind) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences: Spark compresses the empty planes."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def mixed(a, b):
    """64-bit hashes of pairs of hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (a >> np.uint64(29))
    x = (x + b) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def beginning(k: int) -> np.uint64:
    """The key of k begin tokens."""
    out = np.array([BEGIN], np.uint64)
    for _ in range(k - 1):
        out = mixed(out, np.array([BEGIN], np.uint64))
    return out[0]


def encoded(docs: DataFrame, order: int, size: int) -> DataFrame:
    """docs (doc_id, text, train) -> one row per part: its documents and tokens, `grams` an upper bound of its distinct k-grams."""

    def row(number, held, task):
        import xxhash

        digest, place, words, tokens, sizes = xxhash.xxh64_intdigest, {}, [FINISH], [], []
        for text in held[1]:
            own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            for w in set(own):
                if w not in place:
                    place[w] = len(words)
                    words.append(digest(w))
            tokens.append(np.fromiter(map(place.__getitem__, own), np.uint32, len(own)))
            tokens.append(np.zeros(1, np.uint32))
            sizes.append(len(own) + 1)
        all_tokens = np.concatenate(tokens)
        out = {"part": task << 32 | number, "ids": held[0], "train": np.array(held[2], np.uint8).tobytes(), "sizes": np.array(sizes, np.int64).tobytes()}
        return table_of([out | {"words": np.array(words, np.uint64).tobytes(), "tokens": packed(all_tokens), "grams": len(all_tokens) * (order - 1) + len(words)}], PARTS).to_batches()[0]

    def run(batches):
        from pyspark import TaskContext

        task, number, held, n = TaskContext.get().partitionId(), 0, ([], [], []), 0
        for b in batches:
            for some in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "train"))):
                for into, v in zip(held, some):
                    into.append(v)
                n += len(some[1] or "") + 16
                if n >= size:
                    yield row(number, held, task)
                    number, held, n = number + 1, ([], [], []), 0
        if held[0]:
            yield row(number, held, task)

    return docs.mapInArrow(tidy(run), PARTS)


class Part:
    """The tokens of a part's documents; per order the distinct k-grams, sorted, and which each token ends."""

    def __init__(self, t: pa.Table, order: int):
        get = lambda c, kind: np.frombuffer(t.column(c)[0].as_py(), kind)
        self.number = t.column("part")[0].as_py()
        self.ids = t.column("ids").combine_chunks().flatten()
        self.sizes = get("sizes", np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.learned = np.repeat(get("train", np.uint8).astype(bool), self.sizes)
        word = get("words", np.uint64)[unpacked(t.column("tokens")[0].as_py(), np.uint32)]
        # keys[k], at[k]: a token's place among them, lead[k]: a token each ends at, before[k]: place of a token's history among keys[k - 1] (-1: only begin tokens)
        self.keys, self.at, self.lead, self.before = {}, {}, {}, {}
        gram = word
        for k in range(1, order + 1):
            if k > 1:
                gram = mixed(self._previous(gram, beginning(k - 1)), word)
                self.before[k] = self._previous(self.at[k - 1], -1)
            self.keys[k], self.lead[k], self.at[k] = np.unique(gram, return_index=True, return_inverse=True)

    def _previous(self, x: np.ndarray, start):
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out


def reducer(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def asked(keys: np.ndarray, part: int, k: int, parts: int, x: np.ndarray, y: np.ndarray | None = None) -> list[dict]:
    """Rows of sorted keys, cut by reducer: reducer numbers grow with the keys."""
    cut = np.searchsorted(reducer(keys, parts), np.arange(parts + 1))
    rows = []
    for q in np.flatnonzero(np.diff(cut)).tolist():
        s = slice(cut[q], cut[q + 1])
        rows.append({"q": q, "part": part, "k": k, "n": int(cut[q + 1] - cut[q]), "keys": packed_keys(keys[s]), "x": packed(x[s]), "y": None if y is None else packed(y[s])})
    return rows


def ask_counts(docs: pa.Table, parts: int, order: int) -> pa.Table:
    p, rows = Part(docs, order), []
    for k in range(1, order + 1):
        rows += asked(p.keys[k], p.number, k, parts, np.bincount(p.at[k], p.learned, len(p.keys[k])).astype(np.uint32))
    return table_of(rows, ASK)


def joined(column: list, kind) -> np.ndarray:
    return np.concatenate([unpacked(x, kind) for x in column]) if column else np.zeros(0, kind)


def joined_keys(column: list) -> np.ndarray:
    return np.concatenate([unpacked_keys(x) for x in column])


def tell_counts(asks: pa.Table, order: int) -> pa.Table:
    """Counts of the asked k-grams (lowest bit: the asking part owns it), the table of those seen, and sums for the driver."""
    q = asks.column("q")[0].as_py()
    rows = sorted(asks.select(["part", "k", "n", "keys", "x"]).to_pylist(), key=lambda r: r["part"])
    out, sums = [], np.zeros((order + 1, DISCOUNTED + 1), np.int64)
    tables = []
    for k in range(1, order + 1):
        mine = [r for r in rows if r["k"] == k]
        if not mine:
            continue
        key, x = joined_keys([r["keys"] for r in mine]), joined([r["x"] for r in mine], np.uint32)
        distinct, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, x, len(distinct)).astype(np.int64)
        holds = np.flatnonzero(x)
        _, first = np.unique(at[holds], return_index=True)
        owner = np.zeros(len(key), np.int64)
        owner[holds[first]] = 1
        answer = total[at] * 2 + owner
        sums[k] = [(total == r).sum() for r in range(1, DISCOUNTED + 2)]
        if k == 1:
            sums[0, :3] = total.sum(), (total > 0).sum(), total[distinct == FINISH].sum()
        seen = total > 0
        tables.append(learned_rows("grams", k, key=distinct[seen], count=total[seen]))
        end = np.cumsum([r["n"] for r in mine])
        out += [{"what": "counts", "part": r["part"], "q": q, "k": k, "n": r["n"], "x": packed(a)} for r, a in zip(mine, np.split(answer, end[:-1]))]
    out.append({"what": "sums", "q": q, "x": packed(sums.ravel())})
    return pa.concat_tables([table_of(out, TOLD), *tables])


def learned_rows(what: str, k: int, **columns: np.ndarray) -> pa.Table:
    n = len(next(iter(columns.values())))
    made = {c: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for c, v in columns.items()} | {"what": pa.array([what] * n, pa.string()), "k": pa.array(np.full(n, k, np.int32))}
    return pa.table([made[c] if c in made else pa.nulls(n, kind) for c, kind in columns_of(TOLD)], names=[c for c, _ in columns_of(TOLD)])


def discounts(n: list[int]) -> np.ndarray:
    """d(0..DISCOUNTED + 1) from n[r - 1] k-grams of count r: Good-Turing in Katz's form.

    Where counts of counts are too thin for it to lie in (0, 1), the discount
    for r is r / (r + 1).
    """
    k = DISCOUNTED
    d = np.ones(k + 2)
    common = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        turing = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 0.0
        x = (turing - common) / (1 - common) if common < 1 else 0.0
        d[r] = x if 0 < x < 1 else r / (r + 1)
    return d


@dataclass
class Sums:
    """What the driver knows: tokens, distinct words, training documents, discounts per order."""

    tokens: int
    words: int
    documents: int
    d: dict


class Known:
    """A part's answers: per order the counts of its k-grams, whether it owns them, and the weights of its histories."""

    def __init__(self, p: Part, told: pa.Table, order: int, sums: Sums):
        self.p, self.sums = p, sums
        rows = sorted(told.select(["what", "q", "k", "n", "x"]).to_pylist(), key=lambda r: (r["k"], r["q"]))
        self.count, self.owned, self.weight, self.plus = {}, {}, {}, {}
        for k in range(1, order + 1):
            answer = joined([r["x"] for r in rows if r["what"] == "counts" and r["k"] == k], np.int64)
            self.count[k], self.owned[k] = answer >> 1, (answer & 1).astype(bool)
            raw = joined([r["x"] for r in rows if r["what"] == "weights" and r["k"] == k], np.float64)
            # the last entry is the history of begin tokens
            self.plus[k] = raw > 500
            self.weight[k] = np.where(self.plus[k], raw - 1000, raw)

    def after(self, k: int, lead: np.ndarray) -> np.ndarray:
        """Counts of the histories of the k-grams that end at tokens `lead`."""
        h = self.p.before[k][lead]
        return np.where(h < 0, self.sums.documents, self.count[k - 1][h])

    def log10(self, k: int, at: np.ndarray) -> np.ndarray:
        """log10 P_k of the tokens at places `at`."""
        p, s = self.p, self.sums
        if k == 1:
            return np.log10(self.count[1][p.at[1][at]] + 0.5) - np.log10(s.tokens + 0.5 * (s.words + 1))
        c, h = self.count[k][p.at[k][at]], p.before[k][at]
        total = self.after(k, at) + self.plus[k][h]
        lower = self.weight[k][h] + self.log10(k - 1, at)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log10(s.d[k][np.minimum(c, DISCOUNTED + 1)] * c / total)
        return np.where(c > 0, seen, lower)


def ask_weights(docs: pa.Table, told: pa.Table, parts: int, order: int, k: int, sums: Sums) -> pa.Table:
    """Per history of the part's k-grams: the mass that the discounts of its owned k-grams free, times the history's count, and their P_{k-1} mass."""
    p = Part(docs, order)
    known = Known(p, told, order, sums)
    at = p.lead[k][known.owned[k]]
    c, h, n = known.count[k][known.owned[k]], p.before[k][at], len(p.keys[k - 1])
    h = np.where(h < 0, n, h)
    freed = np.bincount(h, (1 - sums.d[k][np.minimum(c, DISCOUNTED + 1)]) * c, n + 1)
    mass = np.bincount(h, 10 ** known.log10(k - 1, at), n + 1)
    total = np.append(known.count[k - 1], sums.documents)
    keys = np.append(p.keys[k - 1], beginning(k - 1))
    return table_of(weight_rows(keys, p.number, k, parts, freed, mass, total), ASK)


def weight_rows(keys, part, k, parts, freed, mass, total) -> list[dict]:
    """The last key, of begin tokens, is asked for apart, so that the others stay sorted."""
    both = np.zeros(len(keys), [("freed", np.float64), ("mass", np.float64)])
    both["freed"], both["mass"] = freed, mass
    total = total.astype(np.int64)
    last = asked(keys[-1:], part, -k, parts, both[-1:], total[-1:])
    return asked(keys[:-1], part, k, parts, both[:-1], total[:-1]) + last


def tell_weights(asks: pa.Table, k: int) -> pa.Table:
    """Per history: log10 of the backoff weight (1000 more where one part in c + 1 is given up), to who asked and as a table."""
    q = asks.column("q")[0].as_py()
    rows = sorted(asks.select(["part", "k", "n", "keys", "x", "y"]).to_pylist(), key=lambda r: (r["part"], -r["k"]))
    key = joined_keys([r["keys"] for r in rows])
    both = joined([r["x"] for r in rows], [("freed", np.float64), ("mass", np.float64)])
    distinct, lead, at = np.unique(key, return_index=True, return_inverse=True)
    freed, mass = np.bincount(at, both["freed"], len(distinct)), np.bincount(at, both["mass"], len(distinct))
    c = joined([r["y"] for r in rows], np.int64)[lead].astype(float)
    plus = (freed <= 0) & (c > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(plus, 1 / (c + 1), freed / c)
        weight = np.where(c > 0, np.log10(left) - np.log10(np.maximum(1 - mass, 1e-15)), 0.0)
    seen = mass > 0  # what ends a text is no history
    table = learned_rows("backoff", k, history=distinct[seen], weight=weight[seen], plus_one=plus[seen])
    end = np.cumsum([r["n"] for r in rows])
    # begin tokens come last of a part's answers
    out = [{"what": "weights", "part": r["part"], "q": q if r["k"] > 0 else 1 << 30, "k": k, "n": r["n"], "x": packed(a)} for r, a in zip(rows, np.split((weight + 1000 * plus)[at], end[:-1]))]
    return pa.concat_tables([table_of(out, TOLD), table])


#: Sorted keys take five bytes instead of eight.
DELTA = {"parquet.writer.version": "v2"}
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scored(docs: pa.Table, told: pa.Table, order: int, sums: Sums) -> pa.Table:
    p = Part(docs, order)
    known = Known(p, told, order, sums)
    every = np.arange(len(p.learned))
    add = lambda x: np.add.reduceat(x, p.first)
    n_known = add((known.count[1][p.at[1]] > 0).astype(np.int64))
    return pa.table([p.ids.cast(pa.int64()), pa.array(p.sizes), pa.array(n_known), pa.array(add(known.log10(1, every))), pa.array(add(known.log10(order, every)))], names=[f.split()[0] for f in SCORES.split(", ")])


class Model:
    """A learned model: tables `grams` and `backoff` and the driver's sums; `parts` and `told` belong to the corpus it was learned from."""

    def __init__(self, parts: DataFrame, told: list[DataFrame], order: int, sums: Sums):
        self.parts, self.told, self.order, self.sums = parts, told, order, sums

    def grams(self) -> DataFrame:
        """(k, key, count) of every distinct k-gram of the training documents."""
        return self.told[0].where("what = 'grams'").select("k", "key", "count")

    def backoff(self) -> DataFrame:
        """(k, history, weight, plus_one): log10 of the backoff weight of every history of k - 1 training tokens."""
        rows = [t.where("what = 'backoff'").select("k", "history", "weight", "plus_one") for t in self.told[1:]]
        out = rows[0]
        for r in rows[1:]:
            out = out.union(r)
        return out

    def answers(self) -> DataFrame:
        out = self.told[0].where("what = 'counts'")
        for t in self.told[1:]:
            out = out.union(t.where("what = 'weights'"))
        return out.select("what", "part", "q", "k", "n", "x")

    def with_answers(self, f, schema: str) -> DataFrame:
        def run(l, r):
            return f(l, r) if l.num_rows else pa.table([pa.array([], kind) for _, kind in columns_of(schema)], names=[n for n, _ in columns_of(schema)])

        return self.parts.groupBy("part").cogroup(self.answers().groupBy("part")).applyInArrow(run, schema)


def weights(model: Model, k: int, n: int) -> DataFrame:
    """The backoff weights of order k, from the answers about lower orders, by n reducers."""
    order, sums = model.order, model.sums
    asks = model.with_answers(lambda l, r: ask_weights(l, r, n, order, k, sums), ASK)
    return asks.groupBy("q").applyInArrow(lambda t: tell_weights(t, k), TOLD)


def learn(docs: DataFrame, train, order: int = ORDER, part: int = PART, share: int = SHARE) -> Model:
    """docs (doc_id, text), train: a boolean column, whom to learn from."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    parts = materialize(encoded(chosen, order, part))
    n = max(partitions(docs.sparkSession), -(-int(parts.agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]) // share))

    def each_part(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from ask_counts(pa.Table.from_batches([b.slice(i, 1)]), n, order).to_batches()

    told = [materialize(parts.mapInArrow(tidy(each_part), ASK).groupBy("q").applyInArrow(lambda t: tell_counts(t, order), TOLD), "what", "k", **DELTA)]
    held = sum((unpacked(r.x, np.int64) for r in told[0].where("what = 'sums'").select("x").collect()), np.zeros((order + 1) * (DISCOUNTED + 1), np.int64)).reshape(order + 1, -1)
    # every training document ends once: the end token's count is their number
    sums = Sums(*map(int, held[0, :3]), {k: discounts(held[k].tolist()) for k in range(2, order + 1)})
    model = Model(parts, told, order, sums)
    for k in range(2, order + 1):
        told.append(materialize(weights(model, k, n), "what", "k"))
    return model


def score(docs: DataFrame, train, order: int = ORDER, part: int = PART) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score); train: a boolean column, whom to learn from."""
    model = learn(docs, train, order, part)
    sums = model.sums
    out = materialize(model.with_answers(lambda l, r: scored(l, r, order, sums), SCORES))
    drop(model.parts, *model.told)
    return out.withColumn("train_tokens", F.lit(sums.tokens).cast("long"))


def score_documents(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    fold = crc_class("doc_id", folds)
    out = score(docs, fold != held_out)
    return out.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
