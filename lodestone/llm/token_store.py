r"""Token ids in a content-addressed store: rolling hashes cut id streams into chunks, unique chunks are stored once, document
recipes and Merkle manifests verify the reconstruction.

A store is a folder with three Parquet tables:

* ``chunks``: digest (first 16 bytes of the SHA-256 of the chunk's ids as little-endian unsigned 32-bit integers), n_ids, width (2
  or 4 bytes an id on file) and payload. One row for each distinct chunk.
* ``recipes``: one row for each document in ascending doc_id order over its files (null first): part (the file's number), doc_id,
  first (ids before it in the part), n_tokens, ids_crc32, lengths and digests of its chunks, and the Merkle root of the digests.
* ``manifest``: one row for each part: documents, ids, start (ids of all parts before it), Merkle root of its documents' roots; and
  the row -1 for the whole store, whose root is that of the parts' roots.

Each document is a stream of its ids and the end id. A chunk ends where the polynomial hash of the last 16 ids has its low bits
all set (512 ids on average), but not before 128 ids and at 4,096 at the latest, so equal passages of different documents
mostly give equal chunks wherever they stand. A task keeps the digests that it has seen and ships a payload once; the payloads
of all tasks then meet by digest, pre-aggregated.

`verify` reads the files: each payload is checked against its digest and gives the CRC-32 of its ids; recipes are joined with
these by digest, and CRC-32s of a document's chunks are combined in order (CRC(A+B) follows from CRC(A), CRC(B) and the length of
B), and so are the Merkle roots. So every id is read and checked, while payloads do not move. `reconstruct` does move them and
returns the ids.

Encoding is the tokenizers library's. Where its file is a byte-level BPE without a normaliser, a Latin-1 text is cut into words as
the library's pattern cuts it, and each distinct word (by a 64-bit fingerprint) goes through the library's model once in a Python
process; a text with other characters is encoded whole by the library.

Edge cases: null and empty text are the end id alone; null doc_ids come first; repeated rows are documents of their own, in any
order; very long texts are whole (a recipe grows with its text); an empty table gives an empty store with a null root; further
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
WINDOW, AVERAGE, LEAST, MOST = 16, 512, 128, 4096
CACHED_WORDS = 1_500_000


def tokenizer_json(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


# character classes of Latin-1: letters, numbers, white space, other (fixed by Unicode since its first versions)
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 256)]] = _LETTER
_CLASS[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_CLASS[[*range(9, 14), 32, 0x85, 0xA0]] = _SPACE


def word_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern ('s|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|space before space|space) begins a word, in
    Latin-1 texts that stand one after the other."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64)
    kind = _CLASS[buf]
    blank = kind == _SPACE
    first = np.zeros(n, bool)  # of a text
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    last = np.zeros(n, bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    before = np.concatenate([[_SPACE], kind[:-1]])
    after_blank = np.concatenate([[False], blank[:-1]]) & ~first
    after_plain = np.concatenate([[False], buf[:-1] == 32]) & ~first
    before_word = np.concatenate([~blank[1:], [False]]) & ~last
    # a word takes one plain space before it along; a run of white space gives its last character away
    start = np.where(blank, ~after_blank | before_word, ((kind != before) | first) & ~after_plain)
    quote = np.flatnonzero((buf == 39) & start)
    if len(quote):
        room = np.concatenate([buf, np.zeros(3, np.uint8)])
        text_end = offsets[np.searchsorted(offsets, quote, side="right")]
        one, two = room[quote + 1], room[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quote + 1 < text_end)
        pair = one.astype(np.int32) * 256 + two
        long = np.isin(pair, [ord("r") * 256 + ord("e"), ord("v") * 256 + ord("e"), ord("l") * 256 + ord("l")]) & (quote + 2 < text_end)
        for which, size in ((short, 2), (long, 3)):
            q = quote[which]
            start[q + 1] = False
            rest = q + size
            start[rest[rest < text_end[which]]] = True
    return np.flatnonzero(start | first)


class Encoder:
    """ids of texts. Known words: sorted fingerprints, and their ids in one flat array."""

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        form = json.loads(spec)
        pre, model = form.get("pre_tokenizer") or {}, form["model"]
        self.plain = (
            model.get("type", "BPE") == "BPE" and not form.get("normalizer") and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        )
        # how a byte-level vocabulary writes bytes: printable ones as they are, the others from 256 on
        shown = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 256)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        tokenize, shown = self.tokenizer.model.tokenize, self.shown
        ids = [[t.id for t in tokenize(w.decode("latin-1").encode().decode("latin-1").translate(shown))] for w in words]
        counts = np.array([len(x) for x in ids], np.int64)
        at = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, np.array(list(chain.from_iterable(ids)), np.uint32)])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.counts = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.counts, where, counts)

    def _latin(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        starts = word_starts(buf, offsets)
        ends = np.append(starts[1:], len(buf))
        up, down = C._power(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(C._LETTER[buf] * up[: len(buf)], out=total[1:])
        prints = C.mix((total[ends] - total[starts]) * down[starts]) if len(buf) else np.empty(0, np.uint64)
        distinct, where, inverse = np.unique(prints, return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_WORDS:
            self._forget()
        found = np.searchsorted(self.keys, distinct)
        known = found < len(self.keys)
        known[known] = self.keys[found[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = buf.tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            found = np.searchsorted(self.keys, distinct)
        counts = self.counts[found][inverse]
        ids = self.flat[C.gathered(self.at[found][inverse], counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(sums[np.searchsorted(starts, offsets)])

    def __call__(self, texts: list[str], tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids of each); each text's ids are followed by `tail`."""
        easy, hard, latin = [], [], []
        for i, t in enumerate(texts):
            try:
                if not self.plain:
                    raise ValueError
                latin.append(t.encode("latin-1"))
                easy.append(i)
            except ValueError:
                hard.append(i)
        ids, counts = self._latin(latin)
        if hard:
            own = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False)]
            parts: list[np.ndarray] = [None] * len(texts)
            for i, x in zip(easy, np.split(ids, np.cumsum(counts)[:-1]) if easy else [], strict=True):
                parts[i] = x
            for i, x in zip(hard, own, strict=True):
                parts[i] = x
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        if tail is not None:
            ids, counts = np.insert(ids, np.cumsum(counts), tail), counts + 1
        return ids.astype("<u4", copy=False), counts


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def cut_points(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Chunk ends of each stream, counted from the stream's start."""
    up, down = C._power(len(ids) + 1)
    values = C.mix(ids.astype(np.uint64) + np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(ids)], dtype=np.uint64)])
    ends = np.arange(WINDOW, len(ids) + 1)
    rolled = C.mix((total[ends] - total[ends - WINDOW]) * down[ends - WINDOW])
    low = np.uint64(AVERAGE - 1)
    found = ends[(rolled & low) == low]
    first = np.searchsorted(found, offsets[:-1] + WINDOW)
    last = np.searchsorted(found, offsets[1:])
    out = []
    for a, b, s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), last.tolist(), strict=True):
        at, cuts = a, []
        for c in [*found[s:e].tolist(), b]:
            if c - at < LEAST and c != b:
                continue
            while c - at > MOST:
                at += MOST
                cuts.append(at - a)
            if c > at:
                cuts.append(c - a)
                at = c
        out.append(cuts)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last node moves up as it is."""
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\x01" + leaves[i] + leaves[i + 1]).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else b""


class _Merkle:
    """merkle_root of a stream in memory that grows with its logarithm."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for k in range(len(self.levels)):
            if self.levels[k] is None:
                self.levels[k] = leaf
                return
            leaf = hashlib.sha256(b"\x01" + self.levels[k] + leaf).digest()
            self.levels[k] = None
        self.levels.append(leaf)

    def root(self) -> bytes:
        out = None
        for node in self.levels:
            if node is not None:
                out = node if out is None else hashlib.sha256(b"\x01" + node + out).digest()
        return out or b""


# CRC-32 of A+B from those of A and B: CRC(A) moves by the length of B, a product modulo the polynomial
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = (b >> 1) ^ _POLYNOMIAL if b & 1 else b >> 1
    return out


@functools.lru_cache(1 << 16)
def _shift(n: int) -> int:
    """x ** (8 n) modulo the polynomial."""
    out, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, square)
        square = _times(square, square)
        n >>= 1
    return out


def crc_joined(a: int, b: int, b_bytes: int) -> int:
    return _times(_shift(b_bytes), a) ^ b


def _encoded(docs: DataFrame, spec: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """One row per document; fresh: payloads that this task has not shipped yet."""
    C.small_batches(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(spec)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(handle.value), set()
        for batch in batches:
            keys, column = C.as_array(batch, "doc_id"), C.as_array(batch, "text")
            for a, b, _, _ in C.segments(column, 2 << 20):
                ids, counts = encode(column.slice(a, b - a).to_pylist(), end_id)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                raw = ids.tobytes()
                lengths, digests, roots, crcs, fresh = [], [], [], [], []
                for at, end, cuts in zip(offsets[:-1].tolist(), offsets[1:].tolist(), cut_points(ids, offsets), strict=True):
                    s, own, new, before = raw[4 * at : 4 * end], [], [], 0
                    for c in cuts:
                        part = s[4 * before : 4 * c]
                        d = hashlib.sha256(part).digest()[:16]
                        own.append(d)
                        if d not in seen:
                            seen.add(d)
                            piece = ids[at + before : at + c]
                            narrow = int(piece.max()) < 1 << 16
                            new.append({"digest": d, "n_ids": c - before, "width": 2 if narrow else 4, "payload": piece.astype("<u2").tobytes() if narrow else part})
                        before = c
                    lengths.append(np.diff([0, *cuts]).tolist())
                    digests.append(own)
                    roots.append(merkle_root(own))
                    crcs.append(zlib.crc32(s))
                    fresh.append(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(a, b - a), pa.array(counts), pa.array(crcs, pa.int64()), pa.array(lengths, pa.list_(pa.int32())),
                        pa.array(digests, pa.list_(pa.binary())), pa.array(roots, pa.binary()),
                        pa.array(fresh, pa.list_(pa.struct([("digest", pa.binary()), ("n_ids", pa.int32()), ("width", pa.int32()), ("payload", pa.binary())]))),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "lengths", "digests", "root", "fresh"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, lengths array<int>, digests array<binary>, root binary, fresh array<struct<digest:binary,n_ids:int,width:int,payload:binary>>")


def _numbered(recipes: DataFrame) -> DataFrame:
    """Adds part and first to recipes that are in order within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = C.as_array(batch, "n_tokens").to_numpy()
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(first), *batch.columns], names=["part", "first", *batch.schema.names])

    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("part int, first long")
    return recipes.mapInArrow(run, StructType([*schema.fields, *recipes.schema.fields]))


def write(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs and writes a store to the folder `path`."""
    spark = docs.sparkSession
    staged = C.written(_encoded(docs, tokenizer_json(tokenizer), end_id, id_col, text_col), "encoded")
    chunks = staged.select(F.explode("fresh").alias("c")).select("c.*").groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n_ids", "width", "payload")))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    ordered = staged.drop("fresh").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids_crc32", "n_tokens")
    _numbered(ordered).write.option("compression", "zstd").parquet(f"{path}/recipes")
    C.dropped(staged)

    out = _manifest(spark, path)
    spark.createDataFrame(out, "part int, n_documents long, n_ids long, start long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> list[tuple]:
    """(part, n_documents, n_ids, start, root) of each part of the recipes as they are, and (-1, ...) of the store."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for part, n, root in zip(*(C.as_array(batch, c).to_pylist() for c in ("part", "n_tokens", "root")), strict=True):
                row = parts.setdefault(part, [0, 0, _Merkle()])
                row[0] += 1
                row[1] += n
                row[2].add(root)
        out = [(k, v[0], v[1], v[2].root()) for k, v in parts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "n_documents", "n_ids", "root"])

    recipes = spark.read.parquet(f"{path}/recipes")
    # a part's rows stay in order: one task has a part, sorted by its first ids
    rows = recipes.select("part", "first", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "first")
    parts = sorted(rows.mapInArrow(summed, "part int, n_documents long, n_ids long, root binary").collect())  # as many rows as files
    out, start = [], 0
    for p in parts:
        out.append((p.part, p.n_documents, p.n_ids, start, bytes(p.root)))
        start += p.n_ids
    out.append((-1, sum(p.n_documents for p in parts), start, 0, merkle_root([bytes(p.root) for p in parts]) or None))
    return out


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with start, the number of ids of all documents before."""
    manifest = spark.read.parquet(f"{path}/manifest").where("part >= 0").select("part", F.col("start").alias("base"))
    return spark.read.parquet(f"{path}/recipes").join(F.broadcast(manifest), "part").withColumn("start", F.col("base") + F.col("first")).drop("base", "first")


def damaged_parts(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Ranges of start of the parts whose recipes do not agree with the manifest."""
    told = {r.part: (r.n_documents, r.n_ids, r.start, None if r.root is None else bytes(r.root)) for r in spark.read.parquet(f"{path}/manifest").collect()}
    store = told.pop(-1, None)
    parts = [told[k] for k in sorted(told)]
    if store is None or store[:2] != (sum(p[0] for p in parts), sum(p[1] for p in parts)) or (merkle_root([p[3] for p in parts]) or None) != store[3]:
        raise ValueError("the manifest does not agree with its store root")
    now = {p[0]: (p[1], p[2], p[4]) for p in _manifest(spark, path) if p[0] >= 0}
    if lost := sorted(set(told) - set(now)):
        raise ValueError(f"recipes of the parts {lost[:10]} are lost")
    return [(told[k][2], told[k][2] + max(told[k][1], now[k][1])) for k in sorted(told) if (told[k][0], told[k][1], told[k][3]) != now[k]]


def verify(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and n_chunks of every document from the files; verified: digests, lengths, CRC and Merkle
    root all agree with the recipe, and the root and counts of the document's part with the manifest. A store whose manifest does not
    agree with its own store root, or of which a whole part is lost, is an error."""
    bad = damaged_parts(spark, path)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, sound = [], []
            for digest, n, width, payload in zip(*(C.as_array(batch, c).to_pylist() for c in ("digest", "n_ids", "width", "payload")), strict=True):
                ids = np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()
                crc.append(zlib.crc32(ids))
                sound.append(len(ids) == 4 * n and hashlib.sha256(ids).digest()[:16] == digest)
            yield pa.RecordBatch.from_arrays([C.as_array(batch, "digest"), C.as_array(batch, "n_ids"), pa.array(crc, pa.int64()), pa.array(sound, pa.bool_())], names=["digest", "n_ids", "crc", "sound"])

    read = spark.read.parquet(f"{path}/chunks").select("digest", "n_ids", "width", "payload").mapInArrow(opened, "digest binary, n_ids int, crc long, sound boolean")
    recipes = _recipes(spark, path)
    # every document has an id at least, so start names its row
    used = recipes.select("start", F.posexplode("digests").alias("k", "digest")).join(read, "digest")
    found = used.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("k", "digest", "n_ids", "crc", "sound"))).alias("found"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [C.as_array(batch, c).to_pylist() for c in ("n_tokens", "ids_crc32", "lengths", "digests", "root", "found")]
            total, crcs, good = [], [], []
            for n, crc, lengths, digests, root, found in zip(*columns, strict=True):
                found = found or []
                joined = 0
                for x in found:
                    joined = crc_joined(joined, x["crc"], 4 * x["n_ids"])
                total.append(sum(x["n_ids"] for x in found))
                crcs.append(joined)
                good.append(
                    all(x["sound"] for x in found) and [x["n_ids"] for x in found] == lengths and [x["digest"] for x in found] == digests
                    and total[-1] == n and joined == crc and merkle_root([x["digest"] for x in found]) == root
                )
            yield pa.RecordBatch.from_arrays(
                [C.as_array(batch, "doc_id"), C.as_array(batch, "start"), pa.array(total, pa.int64()), pa.array(crcs, pa.int64()), pa.array([len(d) for d in columns[3]], pa.int64()), pa.array(good, pa.bool_())],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "verified"],
            )

    kind = recipes.schema["doc_id"].dataType.simpleString()
    out = recipes.join(found, "start", "left").select("doc_id", "start", "n_tokens", "ids_crc32", "lengths", "digests", "root", "found").mapInArrow(
        checked, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, n_chunks long, verified boolean"
    )
    if not bad:
        return out
    spans = spark.createDataFrame(bad, "low long, high long")
    here = out.join(F.broadcast(spans), (F.col("start") >= F.col("low")) & (F.col("start") < F.col("high")), "left")
    return here.select(*out.columns[:-1], (F.col("verified") & F.col("low").isNull()).alias("verified"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids of every document, from recipes and chunks."""
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "width", "payload")
    used = _recipes(spark, path).select("doc_id", "start", F.posexplode("digests").alias("k", "digest")).join(chunks, "digest")
    found = used.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "width", "payload"))).alias("found"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.concatenate([np.frombuffer(x["payload"], f"<u{x['width']}").astype(np.int64) for x in f]) for f in C.as_array(batch, "found").to_pylist()]
            yield pa.RecordBatch.from_arrays([C.as_array(batch, "doc_id"), C.as_array(batch, "start"), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return found.mapInArrow(joined, f"doc_id {used.schema['doc_id'].dataType.simpleString()}, start long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.scratch_path(spark, "token-store")
    write(C.table(spark, sf_dir, "documents"), path)
    return verify(spark, path)
