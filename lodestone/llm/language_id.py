r"""Language identification by hierarchical discrimination: the family first, then one-versus-one linear SVMs inside it.

Features of a text are the shares of its hashed byte trigrams (letters lower-cased for A-Z, runs of other bytes are word
breaks) and of its hashed words. A one-versus-rest linear SVM for each family picks the family; inside it every pair of
languages has a linear SVM, and the language with the highest mean pair probability wins. Margins become probabilities by a
logistic slope fitted on a fifth of the sample that the SVMs did not see. The score is family probability times pair probability.

Learning uses text and lang alone, of rows with non-null lang for which crc32(doc_id as text) mod 5 is not 0, drawn by a hash
of doc_id: about ``max_rows`` rows, in equal parts for each language, but eight of each language where there are so many that
their parts would be smaller; so every language is learned. Of rows with one doc_id and language one counts (that with the least
text). The sample is the only part that does not grow with the input. Whole texts are read, in learning and in prediction.

Languages outside the table of families form a family of their own. Edge cases: null text, empty text and text without a letter
get `und` with score 0; so does everything if no row has a language; a single language is predicted with score 1; null doc_id
counts as held out; repeated rows are predicted row by row; further columns are not read by `predict` and pass through `keep`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

#: Family of a language code (fixed values; ISO 639-1).
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "be": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic", "sl": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic", "kk": "turkic",
    "ar": "semitic", "he": "semitic", "hi": "indo-aryan", "ur": "indo-aryan", "bn": "indo-aryan", "zh": "sinitic", "ja": "japonic", "ko": "koreanic",
}

MAX_ROWS = 2_400
LEAST_ROWS = 8
DIM = 1 << 12
#: The filtering stage keeps a document whose score reaches this.
KEEP_SCORE = 0.4

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bins, trigrams in each text, word bins, words in each text), in order. Trigrams may reach into a break of one byte."""
    w = C.Words(buf, offsets, _LETTERS)
    plain = np.where(_LETTERS[w.buf], w.buf, 32).astype(np.uint32)
    n = len(plain)
    left = np.concatenate([[32], plain[:-1]]).astype(np.uint32) if n else plain
    right = np.concatenate([plain[1:], [32]]).astype(np.uint32) if n else plain
    inner = offsets[1:-1]
    left[inner[inner < n]] = 32
    right[offsets[1:][offsets[1:] > 0] - 1] = 32
    letters = np.flatnonzero(plain != 32)
    gram = (left[letters] << np.uint32(16)) | (plain[letters] << np.uint32(8)) | right[letters]
    bins = ((gram * np.uint32(2654435761)) >> np.uint32(32 - int(math.log2(DIM)))).astype(np.int64)
    return bins, np.diff(np.searchsorted(letters, offsets)), (w.hash >> np.uint64(64 - int(math.log2(DIM)))).astype(np.int64), np.diff(w.first)


def _sample(docs: DataFrame, max_rows: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the row's language numbers, and its feature shares (rows x 2 DIM)."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()}  # as many rows as languages
    if not counts:
        return [], np.empty(0, np.int64), np.empty((0, 2 * DIM), np.float32)
    each = max(max_rows // len(counts), LEAST_ROWS)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1 << 40)) / float(1 << 40)
    chosen = labelled.where(F.col("text").isNotNull() & (draw < F.coalesce(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])[F.col("lang")], F.lit(0.0))))
    # however often a row is repeated, it comes to the driver once
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys = C.as_array(batch, "lang"), C.as_array(batch, "doc_id")
            for a, b, buf, offsets in C.segments(C.as_array(batch, "text")):
                bins, n_bins, words, n_words = _features(buf, offsets)
                rows = []
                for ends, values, shift in ((np.cumsum(n_bins), bins, 0), (np.cumsum(n_words), words, DIM)):
                    begin = ends - (n_bins if shift == 0 else n_words)
                    rows.append([np.unique(values[s:e], return_counts=True) for s, e in zip(begin, ends, strict=True)])
                idx = [np.concatenate([x[0], y[0] + DIM]).astype(np.int16) for x, y in zip(*rows, strict=True)]
                val = [np.concatenate([x[1] / max(x[1].sum(), 1), y[1] / max(y[1].sum(), 1)]).astype(np.float32) for x, y in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), langs.slice(a, b - a), pa.array([i.tobytes() for i in idx], pa.binary()), pa.array([v.tobytes() for v in val], pa.binary())], names=["doc_id", "lang", "idx", "val"])

    # columns, not rows: the sample's buffers go back whole when the matrix is made
    found = chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, lang string, idx binary, val binary").toArrow()
    ids, own = found["doc_id"].to_pylist(), found["lang"].to_pylist()
    idx, val = found["idx"].combine_chunks(), found["val"].combine_chunks()
    order = sorted(range(len(own)), key=lambda k: (own[k], zlib.crc32(str(ids[k]).encode()), idx[k].as_py()))  # Model takes the rows of a language together
    langs = sorted(set(own))
    at = {x: k for k, x in enumerate(langs)}
    x = np.zeros((len(own), 2 * DIM), np.float32)
    for row, k in enumerate(order):
        x[row, np.frombuffer(idx[k].as_buffer(), np.int16)] = np.frombuffer(val[k].as_buffer(), np.float32)
    return langs, np.array([at[own[k]] for k in order], np.int64), x


def _svm(parts: list[tuple[np.ndarray, float]], rounds: int = 120, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, classes weighted alike, by accelerated gradient steps. parts: rows (views, never copied) and
    their class, -1 or 1."""
    count = {c: max(sum(len(x) for x, y in parts if y == c), 1) for c in (-1.0, 1.0)}
    size = parts[0][0].shape[1]
    w = np.zeros(size + 1, np.float32)
    look, t = w.copy(), 1.0
    norm = sum(float(np.einsum("ij,ij->", x, x) + len(x)) * 0.5 / count[y] for x, y in parts)
    step = 1.0 / (2 * norm + ridge)
    for _ in range(rounds):
        grad = ridge * look
        for x, y in parts:
            slack = np.maximum(0, 1 - y * (x @ look[:-1] + look[-1])) * np.float32(y * 0.5 / count[y])
            grad[:-1] -= 2 * (slack @ x)
            grad[-1] -= 2 * slack.sum()
        new = look - step * grad
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w[:-1], float(w[-1])


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The logistic slope of greatest likelihood on a grid."""
    if not len(margin):
        return 4.0
    grid = np.array([0.5, 1, 2, 3, 4, 6, 8, 12])
    return float(grid[np.argmin([np.logaddexp(0, -a * y * margin).mean() + 0.002 * a for a in grid])])


class Model:
    """label is ascending, as the rows of a language stand together in x. families: names, languages of each; problems: (kind, i, j) with weights (2 DIM x problems), offsets and slopes."""

    def __init__(self, langs: list[str], label: np.ndarray, x: np.ndarray, families: dict[str, str] | None = None):
        table = FAMILY if families is None else families
        self.langs = langs
        names = [table.get(c, f"own:{c}") for c in langs]
        self.families = sorted(set(names))
        self.members = [[k for k, f in enumerate(names) if f == name] for name in self.families]
        # x is scaled in place, and the weights are brought back to shares at the end
        n = max(len(x), 1)
        mean = x.sum(0, dtype=np.float64) / n
        spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / n - mean**2, 0))
        scale = (8 / math.sqrt(x.shape[1]) / (spread + 1e-4)).astype(np.float32)
        x *= scale
        cut = np.searchsorted(label, np.arange(len(langs) + 1))
        held = [e - (e - a) // 5 for a, e in zip(cut[:-1], cut[1:], strict=True)]  # the last fifth of each language
        self.problems: list[tuple[str, int, int]] = []
        w, b, slopes = [], [], []

        def learn(kind: str, i: int, j: int, plus: list[int], minus: list[int]) -> None:
            sides = [(k, 1.0) for k in plus] + [(k, -1.0) for k in minus]
            v, c = _svm([(x[cut[k] : held[k]], y) for k, y in sides])
            margins = np.concatenate([x[held[k] : cut[k + 1]] @ v + c for k, _ in sides])
            self.problems.append((kind, i, j))
            slopes.append(_slope(margins, np.concatenate([np.full(cut[k + 1] - held[k], y) for k, y in sides])))
            w.append(v * scale)
            b.append(c)

        every = set(range(len(langs)))
        if len(self.families) == 2:
            learn("family", 0, 1, *self.members)
        elif len(self.families) > 2:
            for k, own in enumerate(self.members):
                learn("family", k, -1, own, sorted(every - set(own)))
        for own in self.members:
            for a, i in enumerate(own):
                for j in own[a + 1 :]:
                    learn("pair", i, j, [i], [j])
        self.w = np.ascontiguousarray(np.array(w, np.float32).T) if w else np.zeros((2 * DIM, 0), np.float32)
        self.b, self.slopes = np.array(b), np.array(slopes)

    def margins(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bins, n_bins, words, n_words = _features(buf, offsets)
        out = np.tile(self.b, (len(offsets) - 1, 1))
        for values, counts, shift in ((bins, n_bins, 0), (words, n_words, DIM)):
            doc = np.repeat(np.arange(len(counts)), counts)
            for p in range(self.w.shape[1]):
                own = np.ascontiguousarray(self.w[shift : shift + DIM, p])
                out[:, p] += np.bincount(doc, own[values], len(counts)) / np.maximum(counts, 1)
        return out

    def predict(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        p = 1 / (1 + np.exp(-np.clip(self.slopes * self.margins(buf, offsets), -40, 40))) if len(self.b) else np.zeros((n, 0))
        if len(self.families) == 1:
            family = np.ones((n, 1))
        elif len(self.families) == 2:
            family = np.stack([p[:, 0], 1 - p[:, 0]], 1)
        else:
            family = p[:, : len(self.families)]
            family = family / family.sum(1, keepdims=True)
        within = np.zeros((n, len(self.langs)))
        for q, (kind, i, j) in enumerate(self.problems):
            if kind == "pair":
                within[:, i] += p[:, q]
                within[:, j] += 1 - p[:, q]
        score = np.zeros((n, len(self.langs)))
        best = family.argmax(1)
        for f, own in enumerate(self.members):
            share = within[:, own] / (len(own) - 1) if len(own) > 1 else np.ones((n, 1))
            score[:, own] = np.where(best == f, family[:, f], -1)[:, None] * share
            if len(own) == 1:
                score[best != f, own[0]] = -1
            else:
                score[np.ix_(best != f, own)] = -1
        top = score.argmax(1)
        return [self.langs[k] for k in top], np.clip(score[np.arange(n), top], 0, 1)


def fit(docs: DataFrame, *, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    return Model(*_sample(docs, max_rows, id_col, text_col, lang_col))


def _predictions(model: Model, texts: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    langs, scores = [], []
    for a, b, buf, offsets in C.segments(texts):
        got, score = model.predict(buf, offsets) if model.langs else (["und"] * (b - a), np.zeros(b - a))
        langs += [x if y else "und" for x, y in zip(got, letters[a:b], strict=True)]
        scores.append(np.where(letters[a:b], score, 0.0))
    return langs, np.concatenate(scores) if scores else np.empty(0)


def _letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    C.small_batches(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), _letter(text_col).alias("letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predictions(handle.value, C.as_array(batch, "text"), C.as_array(batch, "letter").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([C.as_array(batch, "doc_id"), C.as_array(batch, "held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, *, model: Model | None = None, min_score: float = KEEP_SCORE) -> DataFrame:
    """The documents in a learned language with a score of at least min_score, filtered where they are read, all columns kept."""
    C.small_batches(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    columns = docs.columns
    # the row travels as one column beside ours, whatever its columns are called
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").cast("string").alias("text"), _letter("text").alias("letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predictions(handle.value, C.as_array(batch, "text"), C.as_array(batch, "letter").to_numpy(zero_copy_only=False))
            fine = np.array([x != "und" for x in langs], bool) & (scores >= min_score)
            yield pa.RecordBatch.from_arrays(C.as_array(batch, "row").filter(pa.array(fine)).flatten(), names=columns)

    return source.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
