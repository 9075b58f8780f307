r"""Toxicity by a sparse factorization machine over hashed terms.

Terms are the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z and their beginnings of 4 to 8 bytes (an insult
keeps its stem when it is inflected or compounded), hashed into 2**40 buckets; a text is the set of its terms. The logit is w0 + sum w_i + sum over pairs <v_i, v_j>, so a pair of terms can weigh what neither does alone. A
proximal step (L1 on w, group lasso on each v_i) leaves terms that tell the classes apart, alone or beside others. All inputs that at
least 5 texts of the sample have are fitted, so the model that goes to the executors (80 bytes an input) is bounded by the sample.

Learning uses rows of `labels` for which crc32(doc_id as text) mod 5 is not 0, at most about ``max_rows`` of them, half of each
class, drawn by a hash of doc_id (the sample's bound is the only thing that does not grow with the input), and the text of those
documents alone. Class weights restore the base rate of the labels. lang, source and doc_id are never inputs.

Edge cases: null and empty text get the score of the offset alone; without labels, or with one class, every score is the base
rate (0.5 if unknown); null doc_id counts as held out; repeated rows are scored row by row; several labels of a document count
as toxic if one is; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .language_id import held_out

MAX_ROWS = 4_000
FIRST_TERMS = 4_000
FACTORS = 8
RATE, SPARSITY = 0.03, 5e-4
#: An input is a bucket and a level: the bucket's words number at least that many in the text.
LEVELS = (1, 2, 3, 5)
STEMS = (4, 5, 6, 7, 8)
_BUCKET = np.uint64((1 << 40) - 1)


def _terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each term."""
    w = C.Words(buf, offsets, C.ALNUM)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    terms, owners = [w.hash & _BUCKET], [text]
    size = w.ends - w.starts
    for k in STEMS:
        long = np.flatnonzero(size > k)
        terms.append(w.beginnings(long, k) & _BUCKET)
        owners.append(text[long])
    return np.concatenate(terms), np.concatenate(owners)


def _levels(buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (bucket * 4 + level number) and the position in `buckets` that each comes from."""
    reached = np.array([counts >= k for k in LEVELS])
    level, where = np.nonzero(reached)
    return buckets[where] * np.uint64(4) + level.astype(np.uint64), where


class Model:
    def __init__(self, rows: list[np.ndarray] | None = None, y: np.ndarray | None = None, rate: float = 0.5, *, epochs: int = 40, seed: int = 11):
        self.keys = np.empty(0, np.uint64)
        self.w, self.v = np.empty(0), np.empty((0, FACTORS))
        self.b = math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
        if rows and len(set(y.tolist())) == 2:
            self._learn(rows, y, rate, epochs, seed)
        self._index()

    def _index(self) -> None:
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.keys >> np.uint64(2)) & np.uint64(0xFFFF)] = True

    def _learn(self, rows, y, rate, epochs, seed) -> None:
        """Fits by Adagrad with proximal steps: first the FIRST_TERMS inputs that differ most between the classes, then, from there, all
        inputs that are seen often enough. What the first explain leaves nothing to fit for chance differences of the others, and an
        input that tells nothing alone can still be found beside another one."""
        rng = np.random.default_rng(seed)
        keys, which = np.unique(np.concatenate(rows), return_inverse=True)
        doc = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        ones, zeros = y.sum(), (1 - y).sum()
        in_one = np.bincount(which, y[doc], len(keys))
        seen = np.bincount(which, minlength=len(keys))
        p1, p0 = (in_one + 0.5) / (ones + 1), (seen - in_one + 0.5) / (zeros + 1)
        z = np.abs(p1 - p0) / np.sqrt(p1 * (1 - p1) / (ones + 1) + p0 * (1 - p0) / (zeros + 1))
        often = np.flatnonzero(seen >= 5)  # an input of a few texts of the sample cannot be told from noise
        keys, z = keys[often], z[often]
        first = np.sort(np.argsort(-z, kind="stable")[:FIRST_TERMS])
        weight = np.where(y > 0, rate * len(y) / ones, (1 - rate) * len(y) / zeros)
        d = len(keys)
        w, v = np.zeros(d), np.zeros((d, FACTORS))
        sw, sv = np.full(d, 1e-3), np.full(d, 1e-3)  # sums of squared gradients
        sb = 1e-2
        v[first] = rng.normal(0, 0.01, (len(first), FACTORS))
        for own in [first] if len(first) == d else [first, np.arange(d)]:
            if len(own) > len(first):
                rest = np.setdiff1d(own, first)
                v[rest] = rng.normal(0, 0.01, (len(rest), FACTORS))
            idx = [np.searchsorted(keys[own], x[np.isin(x, keys[own], assume_unique=True)]) for x in rows]
            w[own], v[own], sw[own], sv[own], sb = self._descend(idx, y, weight, w[own], v[own], sw[own], sv[own], sb, epochs, rng)
        used = np.flatnonzero((w != 0) | (np.square(v).sum(1) > 1e-6))
        self.keys, self.w, self.v = keys[used], w[used], v[used]

    def _descend(self, idx, y, weight, w, v, sw, sv, sb, epochs, rng):
        d, b = len(w), self.b
        for _ in range(epochs):
            for take in np.array_split(rng.permutation(len(idx)), max(1, len(idx) // 128)):
                flat = np.concatenate([idx[i] for i in take])
                own = np.repeat(np.arange(len(take)), [len(idx[i]) for i in take])
                total = np.stack([np.bincount(own, v[flat, f], len(take)) for f in range(FACTORS)], 1)
                square = np.bincount(own, np.square(v[flat]).sum(1), len(take))
                logit = b + np.bincount(own, w[flat], len(take)) + 0.5 * (np.square(total).sum(1) - square)
                g = weight[take] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[take]) / len(take)
                gw = np.bincount(flat, g[own], d)
                gv = np.stack([np.bincount(flat, g[own] * (total[own, f] - v[flat, f]), d) for f in range(FACTORS)], 1)
                sw += np.square(gw)
                sv += np.square(gv).mean(1)
                sb += g.sum() ** 2
                rw, rv = RATE / np.sqrt(sw), RATE / 3 / np.sqrt(sv)
                b -= RATE * g.sum() / math.sqrt(sb)
                w -= rw * gw
                w = np.sign(w) * np.maximum(np.abs(w) - rw * SPARSITY, 0)
                v -= rv[:, None] * gv
                v *= np.maximum(1 - rv * SPARSITY / np.maximum(np.sqrt(np.square(v).sum(1)), 1e-12), 0)[:, None]
        self.b = float(b)
        return w, v, sw, sv, sb

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        terms, doc = _terms(buf, offsets)
        maybe = np.flatnonzero(self.bits[terms & np.uint64(0xFFFF)])
        order = np.lexsort((terms[maybe], doc[maybe]))
        terms, doc = terms[maybe][order], doc[maybe][order]
        new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1])])) if len(terms) else np.empty(0, np.int64)
        inputs, where = _levels(terms[new], np.diff(np.append(new, len(terms))))
        doc = doc[new][where]
        at = np.searchsorted(self.keys, inputs)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == inputs[known]
        doc, at = doc[known], at[known]
        z = self.b + np.bincount(doc, self.w[at], n)
        for f in range(FACTORS):
            own = self.v[at, f]
            z += 0.5 * (np.square(np.bincount(doc, own, n)) - np.bincount(doc, np.square(own), n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out("doc_id"))
    one = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {int(r.y > 0): r.n for r in one.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Model(rate=0.5 if not total else counts.get(1, 0) / total)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity sample")), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("y") > 0, F.lit(min(1.0, max_rows / 2 / counts[1]))).otherwise(F.lit(min(1.0, max_rows / 2 / counts[0])))
    chosen = one.where(draw < share)  # about max_rows rows at most: small enough to broadcast whatever the size of the tables
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")  # a repeated doc_id comes to the driver once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, y = C.as_array(batch, "doc_id"), C.as_array(batch, "y")
            for a, b, buf, offsets in C.segments(C.as_array(batch, "text")):
                terms, doc = _terms(buf, offsets)
                own = [_levels(*np.unique(terms[doc == d], return_counts=True))[0].tobytes() for d in range(b - a)]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), y.slice(a, b - a), pa.array(own, pa.binary())], names=["doc_id", "y", "terms"])

    found = texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, y int, terms binary").collect()
    found.sort(key=lambda r: (str(r.doc_id), r.terms))
    return Model([np.frombuffer(r.terms, np.uint64) for r in found], np.array([float(r.y > 0) for r in found]), counts[1] / total)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    C.small_batches(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [handle.value.score(buf, offsets) for _, _, buf, offsets in C.segments(C.as_array(batch, "text"))]
            s = np.concatenate(got) if got else np.empty(0)
            yield pa.RecordBatch.from_arrays([C.as_array(batch, "doc_id"), C.as_array(batch, "held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
