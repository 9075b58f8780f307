"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is ten consecutive words of an item; an item
of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit. Every hit of the hash
set is verified word by word before it counts.

Size check: the windows go to the executors as one broadcast while they are at most ``max_broadcast_windows`` (about 120 bytes
each). A larger benchmark is scanned in blocks of that many windows: every input row gets a key (rows and keys are written once),
each block's hits are written before the next block is made and broadcast, and the blocks' spans meet by that key. So one broadcast
lives at a time, none outgrows the bound, no window is left out, and repeated rows and null ids stay rows of their own.

Edge cases: null or empty text has no words, no hits and is clean; an item with null or wordless text has no window; a null
item_id counts as the empty string; repeated items count once for each distinct id; an empty benchmark leaves every document
clean; further columns of the inputs are not read by `scan` and pass through `decontaminate`.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from . import common as C

NGRAM = 10
MAX_BROADCAST_WINDOWS = 1_000_000
MAX_COLLECTED_BYTES = 64 << 20


def _item_windows(ids: list, texts: list, n: int) -> dict[tuple[bytes, ...], set[str]]:
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in zip(ids, texts, strict=True):
        data = (text or "").encode()
        w = C.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), C.ALNUM)
        raw = w.buf.tobytes()
        words = [raw[a:b] for a, b in zip(w.starts, w.ends, strict=True)]
        k = min(n, len(words))
        for i in range(len(words) - k + 1 if words else 0):
            found[tuple(words[i : i + k])].add("" if item is None else str(item))
    return found


class _Index:
    """Windows by length: sorted fingerprints, a bitmap that spares most look-ups, and the words for the verification."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.items = sorted({i for s in windows.values() for i in s})
        at = {x: k for k, x in enumerate(self.items)}
        self.by_length = {}
        for k in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == k]
            data = [b" ".join(w) for w in own]
            offsets = np.cumsum([0, *map(len, data)])
            buf = np.frombuffer(b"".join(data), np.uint8)
            words = C.Words(buf, offsets, C.ALNUM)
            prints = words.windows(k)[words.first[:-1]]
            order = np.argsort(prints, kind="stable")
            bits = np.zeros(1 << 21, bool)
            bits[prints & np.uint64((1 << 21) - 1)] = True
            self.by_length[k] = (prints[order], bits, [own[i] for i in order], [np.array(sorted(at[x] for x in windows[own[i]])) for i in order])

    def hits(self, w: C.Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are hit, and the items of each text."""
        n = len(w.hash)
        cover = np.zeros(n + 1, np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        raw = None
        for k, (prints, bits, words, owners) in self.by_length.items():
            h = w.windows(k)
            maybe = np.flatnonzero(bits[h & np.uint64((1 << 21) - 1)])
            if not len(maybe):
                continue
            doc = np.searchsorted(w.first, maybe, side="right") - 1
            whole = maybe + k <= w.first[np.minimum(doc + 1, len(w.first) - 1)]
            maybe, doc = maybe[whole], doc[whole]
            left, right = np.searchsorted(prints, h[maybe]), np.searchsorted(prints, h[maybe], side="right")
            for p, d, a, b in zip(maybe[left < right], doc[left < right], left[left < right], right[left < right], strict=True):
                raw = w.buf.tobytes() if raw is None else raw
                here = tuple(raw[w.starts[i] : w.ends[i]] for i in range(p, p + k))
                for c in range(a, b):
                    if words[c] == here:
                        cover[p] += 1
                        cover[p + k] -= 1
                        items[int(d)].update(owners[c].tolist())
        return np.cumsum(cover[:-1]) > 0, items


_SPANS = ("word_from", "word_to", "byte_from", "byte_to")
_FOUND = f"n_words long, {', '.join(f'{c} array<int>' for c in _SPANS)}, items array<string>"


def _scan(source: DataFrame, handle) -> DataFrame:
    """source: key (of any type, handed through), text. key, n_words, hit word spans (starts, ends as word numbers), the byte spans of
    those words, item ids. handle: a broadcast index."""
    C.small_batches(source.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = handle.value
        for batch in batches:
            texts, keys = C.as_array(batch, "text"), C.as_array(batch, "key")
            for a, b, buf, offsets in C.segments(texts):
                w = C.Words(buf, offsets, C.ALNUM)
                hit, items = index.hits(w)
                rows = b - a
                step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                cut = [[] for _ in range(rows)]
                for s, e in zip(begin, end, strict=True):  # a run may go on into the next text
                    d = int(np.searchsorted(w.first, s, side="right")) - 1
                    while s < e:
                        stop = min(e, int(w.first[d + 1]))
                        if stop > s:
                            cut[d].append((int(s - w.first[d]), int(stop - w.first[d]), int(w.starts[s] - offsets[d]), int(w.ends[stop - 1] - offsets[d])))
                        s, d = stop, d + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(a, rows),
                        pa.array(np.diff(w.first).astype(np.int64)),
                        *(pa.array([[x[k] for x in c] for c in cut], pa.list_(pa.int32())) for k in range(4)),
                        pa.array([sorted(index.items[i] for i in items.get(d, ())) for d in range(rows)], pa.list_(pa.string())),
                    ],
                    names=["key", "n_words", *_SPANS, "items"],
                )

    kind = source.schema["key"]
    return source.mapInArrow(run, StructType([StructField("key", kind.dataType, kind.nullable), *StructType.fromDDL(_FOUND).fields]))


def _found(source: DataFrame, blocks: Iterator[_Index]) -> DataFrame:
    """`_scan` over all blocks, one row for each row of source(key, text)."""
    share = source.sparkSession.sparkContext.broadcast
    first = next(blocks, None)
    second = next(blocks, None) if first is not None else None
    if second is None:
        return _scan(source, share(first if first is not None else _Index({})))
    # not deleted here: what is returned reads them
    rows = C.written(source.select(F.monotonically_increasing_id().alias("row"), "key", "text"), "benchmark-rows")
    keyed, merged = rows.select(F.col("row").alias("key"), "text"), None
    for index in itertools.chain([first, second], blocks):
        handle = share(index)
        one = _scan(keyed, handle)
        # the first block tells n_words of every row; of the others only hits matter
        one = C.written(one if merged is None else one.where(F.size("items") > 0), "benchmark-hits")
        merged = one if merged is None else merged.unionByName(one)
        handle.unpersist()
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(*_SPANS))))
    empty = "cast(array() as array<struct<word_from:int,word_to:int,byte_from:int,byte_to:int>>)"
    folded = F.expr(
        f"""aggregate(s, {empty}, (acc, x) -> case when size(acc) > 0 and x.word_from <= element_at(acc, -1).word_to
        then concat(slice(acc, 1, size(acc) - 1), array(named_struct('word_from', element_at(acc, -1).word_from, 'word_to', greatest(element_at(acc, -1).word_to, x.word_to),
        'byte_from', element_at(acc, -1).byte_from, 'byte_to', greatest(element_at(acc, -1).byte_to, x.byte_to)))) else concat(acc, array(x)) end)"""
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    met = merged.groupBy(F.col("key").alias("row")).agg(F.max("n_words").alias("n_words"), spans.alias("s"), items.alias("items")).withColumn("s", folded)
    return rows.select("row", "key").join(met, "row").select("key", "n_words", *(F.col(f"s.{c}").alias(c) for c in _SPANS), "items")


def _clean_rows(docs: DataFrame, index: _Index) -> DataFrame:
    C.small_batches(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for a, _, buf, offsets in C.segments(C.as_array(batch, "text").cast(pa.string())):
                _, items = handle.value.hits(C.Words(buf, offsets, C.ALNUM))
                clean[[a + d for d in items]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, most: int) -> Iterator[_Index]:
    """Indexes of at most about `most` windows each. Rows of the benchmark come to the driver partition by partition."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").orderBy("t", "i")
    small = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] <= MAX_COLLECTED_BYTES
    for row in rows.collect() if small else rows.toLocalIterator():
        for w, ids in _item_windows([row.i], [row.t], n).items():
            found.setdefault(w, set()).update(ids)
        if len(found) >= most:
            yield _Index(found)
            found = {}
    if found:
        yield _Index(found)


def scan(docs: DataFrame, benchmark: DataFrame, *, ngram: int = NGRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, hit spans in words and bytes, and the sorted ids of the items found."""
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return _found(source, _blocks(benchmark, item_col, "text", ngram, max_broadcast_windows)).withColumnRenamed("key", "doc_id")


def report(found: DataFrame) -> DataFrame:
    """The digest of `scan`: n_hit, n_items, the SHA-256 of the item list, contaminated."""
    n_hit = F.expr("aggregate(zip_with(word_to, word_from, (a, b) -> cast(a - b as bigint)), 0L, (a, b) -> a + b)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    """What `report` writes for a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "document", ngram: int = NGRAM, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """mode "document": contaminated documents go. mode "span": the hit words are cut from the text, and documents stay.

    Needs doc_id and text; all columns are kept, whatever their names (n_chars, where there is one, is counted again after a cut). A row
    is judged by its own text, so null or repeated doc_ids do no harm. With one block of windows, documents are filtered or cut where
    they are scanned, without a join or shuffle.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"mode must be document or span, not {mode!r}")
    blocks = _blocks(benchmark, "item_id", "text", ngram, max_broadcast_windows)
    if mode == "document":
        ahead = list(itertools.islice(blocks, 2))
        if len(ahead) < 2:
            return _clean_rows(docs, ahead[0]) if ahead else docs
        blocks = itertools.chain(ahead, blocks)
    # the whole row is the key, so no name of ours meets one of theirs
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = _found(docs.select(whole.alias("key"), F.col("text").cast("string").alias("text")), blocks)
    if mode == "document":
        return found.where(F.size("items") == 0).select("key.*")
    # spans are byte spans of the UTF-8 text
    raw = F.expr(
        """decode(concat(aggregate(arrays_zip(byte_from, byte_to), named_struct('at', 0, 'out', cast('' as binary)),
        (s, x) -> named_struct('at', x.byte_to, 'out', concat(s.out, substring(cast(key.text as binary), s.at + 1, x.byte_from - s.at))),
        s -> concat(s.out, substring(cast(key.text as binary), s.at + 1)))), 'UTF-8')"""
    )
    hit = F.size("byte_from") > 0
    kind = docs.schema["text"].dataType
    done = found.select("key", hit.alias("hit"), F.when(hit, raw).otherwise(F.col("key.text").cast("string")).alias("cut"))

    def column(c: str):
        if c == "text":
            return F.col("cut").cast(kind).alias(c)
        if c == "n_chars":
            return F.when(F.col("hit"), F.length("cut").cast(docs.schema[c].dataType)).otherwise(F.col(f"key.`{c}`")).alias(c)
        return F.col(f"key.`{c}`").alias(c)

    return done.select(*map(column, docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return report(scan(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")))


#: Lower-casing touches A-Z alone, as in the operator.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT cast(item_id AS varchar) AS item, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), {NGRAM}) AS k, unnest(range(1, len(w) - least(len(w), {NGRAM}) + 2)) AS p FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, lengths WHERE len(w) >= k)),
hit AS (SELECT doc_id, k, p, item FROM dw JOIN iw USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(named.s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
