r"""N-gram Jaccard join by multiple-global-order filtering; links, and components of linked documents.

A document's set holds the 64-bit fingerprints of its distinct 4-word shingles (words `[^\x20\x09-\x0D]+` after lower-casing A-Z;
a shorter text is one shingle; a text without words has the empty set and no link). Documents link when
100 * |A and B| >= 85 * |A or B|. Equal sets are found first, by a 128-bit fingerprint of the set, and only one document of each
such class goes on, so groups of exact copies never meet pair by pair.

Candidates must share prefix tokens under three global orders of the shingles:

1. By fingerprint, ascending. A document of n shingles may miss q(n) = floor(15 n / 100) of them in a partner, so a pair shares at
   least l + 1 of the first q + 1 + l tokens of both. l(n) = min(n - q - 1, max(48, q // 2)) grows with n.
2. By rarity: how many of these first tokens there are in the corpus, ties by fingerprint. As a pair shares l + 1 of them, a
   document may strike its d(n) = l(ceil(85 n / 100)) commonest ones (a partner has at least 85 % of its size, so strikes no
   more tokens than the pair is sure to share) and still keeps the rarest common one. So a passage that many documents share
   brings nobody together. A token that occurs once is never shipped: rows are counted first (pre-aggregated by the mapper), and
   a document all of whose counted tokens may be struck drops out here.
3. By fingerprint, descending: the last q + 1 tokens of both sets must meet too. Only those tokens travel to a pair for this test;
   whole sets follow for the pairs that pass all three.

Pairs come from buckets of documents that keep the same token, in rounds: first each document meets one centre of its bucket
(the document with the largest share of counted tokens, which in a group of near copies is the one that the others are made
from), which needs rows in proportion to the bucket; links merge documents into components. What is left are documents of different
components that keep a common token. For these, order 2 is taken again over their whole sets: tokens found in one component alone
come first, as no partner in another one can have them, then the others by exact rarity. A document with more than q(n) of the
former is done; two of the rest meet if they keep a common token, and their sizes and the places of the token leave room for the
overlap that a link needs.

In a large group of near copies of one text, of which most link with nobody, the text's own tokens are common and bring all pairs
together. Where documents would meet too many partners so, they are compared by their differences from a centre c instead: for
X = A xor c, |A xor B| = |X_A xor X_B|, so a link asks for a stated overlap of X_A and X_B, and that is more than nothing unless both
are linked to c, which would make them one component. The text's tokens vanish from X, and what is left, a document's own edits, is
rare. Prefixes, orders, places and rounds are the same over X as over sets, whose centre is empty. So a large group of near copies
costs a star and its edits, and no component is torn apart; whatever buckets are still large in the end meet pair by pair.

These rounds do not look at every link inside a component. `join` counts them all afterwards: a component is dealt into blocks, and
every two blocks meet in one task that counts the exact intersections of their sets. This takes work in proportion to the square of
a component's representatives, as the links themselves may; `grouped` and `keep_one` need components alone and leave it out.

State is Parquet in the shared folder; nothing is collected but counts. Components come from min-label propagation with pointer
jumping over links. Shingle fingerprints may agree by chance for two different shingles of a pair with a probability of about
n**2 / 2**64.

Edge cases: null and empty text: size 0, a component of its own; null doc_id: its sizes are given, its component is null; repeated
rows (equal doc_id) share a component and each give a row; an empty table gives no rows; further columns are not read by `join`
and pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

SHINGLE = 4
PERCENT = 85
LEAST_SPARE = 48
STAR_ROUNDS = 2
SIEVES = 2
#: Where documents would meet more partners than this in their buckets, on average, the buckets over so many documents get a centre; and
#: again, up to so many times, while they shrink and the average is 16 times as high each time, as differences from a second centre are
#: longer. Such a meeting compares places in the join; few of them become pairs.
PARTNERS = 1_000
SMALL_BUCKET = 32
LEVELS = 6
SPREAD = 32
#: A block of a component, where links are counted: about this many documents and tokens at most (a longer document is a block by itself).
BLOCK_ROWS = 1_024
BLOCK_TOKENS = 1 << 20
TOKEN_RUN = 4_096


def allowed_misses(n, percent: int = PERCENT):
    """How many of n shingles a linked partner may lack."""
    return n - -(-percent * n // 100)


def spare(n, percent: int = PERCENT):
    """l(n): tokens read beyond the plain prefix; never falls as n grows."""
    q = allowed_misses(n, percent)
    return np.minimum(n - q - 1, np.maximum(LEAST_SPARE, q // 2))


def struck(n, percent: int = PERCENT):
    """d(n): how many of the commonest first tokens a document may leave out."""
    return np.minimum(spare(n, percent), spare(-(-percent * n // 100), percent))


def _sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    w = C.Words(buf, offsets, C.SPACED)
    grams = w.windows(k)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:  # the whole sequence as one
            h = w.hash[a:b]
            yield C.mix(np.array([np.bitwise_xor.reduce(C.mix(h + np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + np.uint64(b - a)], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def _print(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        a = np.add.reduce(C.mix(s ^ np.uint64(0xA0761D6478BD642F))) + np.uint64(len(s))
        b = np.add.reduce(C.mix(s * np.uint64(0xE7037ED1A0B428DB) + np.uint64(0x8EBC6AF09C88C6E3)))
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def _mapped(docs: DataFrame, schema: str, rows) -> DataFrame:
    """rows(task state, doc ids, sets) gives the columns of an output batch for a run of texts; the state lives as long as a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            ids = C.as_array(batch, "doc_id")
            for a, b, buf, offsets in C.segments(C.as_array(batch, "text")):
                yield rows(state, ids.slice(a, b - a), buf, offsets)

    C.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def signatures(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n (set size), hi, lo (fingerprint of the set)."""

    def rows(_, ids, buf, offsets):
        n, prints = [], []
        for s in _sets(buf, offsets, shingle):
            n.append(len(s))
            prints.append(_print(s))
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())], names=["doc_id", "n", "hi", "lo"])

    return _mapped(docs, "doc_id long, n long, hi long, lo long", rows)


def _prefixes(docs: DataFrame, shingle: int, percent: int, counting: bool) -> DataFrame:
    """The first tokens of each document under order 1: their classes c (the lower 32 bits) alone, or (c, t, doc_id, n).
    Of documents of one task with equal sets only the first speaks."""

    def rows(state, ids, buf, offsets):
        seen = state.setdefault("seen", set())
        tokens, sizes, owners, full = [], [], [], []
        for i, s in enumerate(_sets(buf, offsets, shingle)):
            n = len(s)
            if not n or not ids[i].is_valid:
                continue
            p = _print(s)
            if p in seen:
                continue
            seen.add(p)
            take = s[: int(allowed_misses(n, percent) + 1 + spare(n, percent))]
            tokens.append(take)
            sizes.append(len(take))
            owners.append(i)
            full.append(n)
        t = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
        c = pa.array(t.astype(np.uint32).view(np.int32))
        if counting:
            return pa.RecordBatch.from_arrays([c], names=["c"])
        who = np.repeat(np.array(owners, np.int64), sizes)
        own = ids.take(pa.array(who))
        return pa.RecordBatch.from_arrays([c, pa.array(t.view(np.int64)), own, pa.array(np.repeat(np.array(full, np.int32), sizes))], names=["c", "t", "doc_id", "n"])

    return _mapped(docs, "c int" if counting else "c int, t long, doc_id long, n int", rows)


def _token_sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, s, tail): the set in the order of fingerprints, and its prefix under order 3, the last q + 1 of them."""

    def rows(_, ids, buf, offsets):
        sets = list(_sets(buf, offsets, shingle))
        tails = [s[len(s) - min(len(s), allowed_misses(len(s), percent) + 1) :] for s in sets]
        flat, ends = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (sets, tails))
        counts = [np.array([len(s) for s in x], np.int64) for x in (sets, tails)]
        return pa.RecordBatch.from_arrays([ids, C.ragged(flat.view(np.int64), counts[0], pa.int64()), C.ragged(ends.view(np.int64), counts[1], pa.int64())], names=["doc_id", "s", "tail"])

    return _mapped(docs, "doc_id long, s array<long>, tail array<long>", rows)


def kept_tokens(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(t, doc_id, n, share): tokens that a document keeps under orders 1 and 2. share: of its first tokens, how many are counted."""
    counts = _prefixes(docs, shingle, percent, True).groupBy("c").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    posts = _prefixes(docs, shingle, percent, False)
    counted = posts.join(counts, "c")
    mine = counted.groupBy("doc_id", "n").agg(F.array_sort(F.collect_set(F.struct("m", "t"))).alias("x"))
    q = f"(n - cast(ceil({percent} * n / 100D) as int))"
    n_small = f"cast(ceil({percent} * n / 100D) as int)"
    q_small = f"({n_small} - cast(ceil({percent} * {n_small} / 100D) as int))"
    ell = f"least(n - {q} - 1, greatest({LEAST_SPARE}, cast(floor({q} / 2D) as int)))"
    ell_small = f"least({n_small} - {q_small} - 1, greatest({LEAST_SPARE}, cast(floor({q_small} / 2D) as int)))"
    keep = F.expr(f"greatest(size(x) - least({ell}, {ell_small}), 0)")
    return (
        mine.select("doc_id", "n", F.expr(f"size(x) / ({q} + 1 + {ell})").alias("share"), keep.alias("k"), "x").where("k > 0")
        .select("doc_id", "n", "share", F.explode(F.slice("x", F.lit(1), F.col("k"))).alias("e"))
        .select(F.col("e.t").alias("t"), "doc_id", "n", "share")
    )


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (node, label) joined over links (a, b): the least label reachable, by propagation and pointer jumping until
    nothing changes. Labels are nodes."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b").withColumnRenamed("label", "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(around, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        # a label that got a smaller label takes its nodes along
        lower = C.written(step.groupBy("label").agg(F.min("new").alias("root")), "lower")
        lower = lower.join(lower.select(F.col("label").alias("root"), F.col("root").alias("further")), "root").select("label", F.col("further").alias("root"))
        new = C.written(step.join(lower, "label").select("node", F.col("root").alias("label"), (F.col("root") < F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        C.dropped(labels)
        path = new._lodestone_path
        labels = new.select("node", "label")
        labels._lodestone_path = path
        if not moved:
            return labels


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with both, inter: the sizes' sum and the exact intersection."""
    x = sets.join(_small(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("s").alias("x"))
    y = sets.join(_small(pairs.select(F.col("b").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
    joined = pairs.join(y, "b").join(x, "a")
    return C.written(joined.select("a", "b", F.expr("size(x) + size(y)").alias("both"), F.expr("size(array_intersect(x, y))").alias("inter")), "met")


def _linked(met: DataFrame, percent: int) -> DataFrame:
    return met.where(f"100 * inter >= {percent} * (both - inter)").select("a", "b")


def _left(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What is left of the documents of open buckets when order 2 is taken over their whole sets."""
    rows = _open(buckets, labels)
    for _ in range(SIEVES):  # who dropped out is nobody's partner, so its tokens count no more
        fewer = _sieved(_whole(rows.select("doc_id", "label").distinct(), sets), percent)
        C.dropped(rows)
        rows = fewer
    return rows


def _grouped(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scratch tables: signatures of all rows; (doc_id, rep) of every doc_id; (node, label) and (doc_id, s) of the representatives that can
    have a link."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = C.written(signatures(source, shingle=shingle), "signatures")
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # written, so that the join deals both sides out itself and a hot class can be split there
    classes = C.written(classes.where("copies > 1"), "classes")
    equal = C.written(signed.where("n > 0 AND doc_id IS NOT NULL").join(classes, ["hi", "lo"]).select("doc_id", "rep").where("doc_id <> rep").distinct(), "equal")
    # a bucket holds representatives
    kept = kept_tokens(source, shingle=shingle, percent=percent)
    kept = kept.join(equal, "doc_id", "left").select("t", F.coalesce("rep", "doc_id").alias("doc_id"), "n", "share").distinct()
    kept = C.written(kept, "kept")
    shared = C.written(kept.groupBy("t").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("t"), "shared")
    buckets = C.written(kept.join(shared, "t"), "buckets")
    C.dropped(kept, shared)
    C.swept(spark)
    members = buckets.select("doc_id").distinct()
    sets = C.written(_token_sets(source.join(_small(members), "doc_id", "left_semi"), shingle, percent), "sets")
    labels = C.written(members.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label")), "labels")
    met: DataFrame | None = None  # every pair that was verified

    def meet(pairs: DataFrame | None, found: DataFrame | None = None) -> None:
        nonlocal met, labels
        if found is None:
            pairs = _fresh(pairs, met, sets, percent)
            found = _verified(pairs, sets)
            C.dropped(pairs)
        met = found if met is None else met.unionByName(found)
        if _linked(found, percent).limit(1).count():
            labels = components(_linked(found, percent), labels)
        C.swept(spark)

    for turn in range(STAR_ROUNDS):
        meet(_starred(buckets, labels, turn))
    rows, before = _left(buckets, labels, sets, percent), None
    for level in range(LEVELS):
        sizes = rows.groupBy("c", "t").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("u"), F.max("label").alias("v")).where("u <> v").select("c", "t", "m")
        sized = C.written(rows.join(C.written(sizes, "sizes"), ["c", "t"]), "sized")
        C.dropped(rows)
        large = sized.where(F.col("m") > SMALL_BUCKET)
        meetings, members = large.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count_distinct("doc_id")).first()
        if meetings > (PARTNERS << 4 * level) * members and (before is None or 10 * meetings <= 9 * before):
            meet(_met_in(sized.where(F.col("m") <= SMALL_BUCKET), percent))
            # the document that stands in most of these buckets is the centre wherever it stands
            often = large.groupBy("doc_id").agg(F.count(F.lit(1)).alias("often"))
            centres = C.written(large.join(often, "doc_id").groupBy("c", "t").agg(F.max_by("doc_id", F.struct("often", "doc_id")).alias("z")), "centres")
            members = large.join(centres, ["c", "t"]).where("doc_id <> z").select(F.col("z").alias("c"), "doc_id").distinct()
            apart = _differences(members, sets)
            meet(None, apart.selectExpr("c AS a", "doc_id AS b", "n + nc AS both", "cast((n + nc - x) / 2 AS int) AS inter"))
            tokens = apart.join(labels.withColumnRenamed("node", "doc_id"), "doc_id").select("c", "nc", "doc_id", "n", "x", "label", F.explode("e").alias("t"))
            rows, before = _sieved(tokens, percent), meetings
            C.dropped(sized)
        else:
            meet(_met_in(sized, percent))
            break
    else:
        meet(_met_in(rows, percent))
    known = signed.select("doc_id").where("doc_id IS NOT NULL").distinct().join(equal, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    return signed, known, labels, sets


def _placed(signed: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    placed = known.join(labels.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("component_id"))
    return signed.join(placed, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def grouped(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row: what `join` says without its count of links."""
    signed, known, labels, _ = _grouped(docs, shingle, percent, id_col, text_col)
    return _placed(signed, known, labels)


def join(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (links of the document's set with other sets, all counted), one row per row."""
    signed, known, labels, sets = _grouped(docs, shingle, percent, id_col, text_col)
    linked = known.join(_link_counts(labels, sets, percent, block_rows), "rep").groupBy("doc_id").agg(F.max("n_links").alias("n_links"))
    return _placed(signed, known, labels).join(linked, "doc_id", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _link_counts(labels: DataFrame, sets: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """(rep, n_links): all links of a representative. A link lies inside a component, so each component is dealt into blocks by a hash
    and every two blocks of it (and each with itself) meet in one task, where the exact intersections are counted."""
    held = sets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id").select("label", "doc_id", "s")
    size = held.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("s")).alias("tokens")).where("m > 1")
    size = size.select("label", F.expr(f"cast(ceil(greatest(m / {block_rows}D, tokens / {BLOCK_TOKENS}D)) as int)").alias("blocks"))
    dealt = held.join(size, "label").select("label", "doc_id", "s", "blocks", F.expr("cast(pmod(xxhash64(doc_id, 'block'), blocks) as int)").alias("own"))
    met = dealt.select("label", "doc_id", "s", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    met = met.select("label", "doc_id", "s", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def count(group: pa.Table) -> pa.Table:
        ids, own, i, j = (group.column(c).to_numpy() for c in ("doc_id", "own", "i", "j"))
        rows = group.column("s").combine_chunks()
        n = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        left = np.flatnonzero(own == i[0])
        right = left if i[0] == j[0] else np.flatnonzero(own == j[0])
        inter = _intersections(rows.flatten().to_numpy(), n, left, right)
        link = (100 * inter >= percent * (n[left][:, None] + n[right][None, :] - inter)) & (ids[left][:, None] != ids[right][None, :])
        a, b = np.nonzero(link)
        # a repeated doc_id is one document
        pairs = np.unique(np.stack([ids[left][a], ids[right][b]], 1), axis=0) if len(set(ids.tolist())) < len(ids) else np.stack([ids[left][a], ids[right][b]], 1)
        ends = pairs[:, 0] if i[0] == j[0] else pairs.ravel()
        who, many = np.unique(ends, return_counts=True)
        return pa.table({"rep": pa.array(who, pa.int64()), "n": pa.array(many, pa.int64())})

    return met.groupBy("label", "i", "j").applyInArrow(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n_links"))


def _intersections(tokens: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens the sets left x right share, by products of 0/1 matrices over runs of tokens; sets of n tokens each stand in `tokens`."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1  # a token of one set is in no intersection
    row, new = row[common], new[common]
    column = np.cumsum(new) - 1
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, TOKEN_RUN):
        a, b = np.searchsorted(column, (at, at + TOKEN_RUN))
        x = np.zeros((len(n), int(column[b - 1]) - at + 1), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        out += (x[left] @ x[right].T).astype(np.int64)
    return out


def _small(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A broadcast of ids while they are few (8 bytes each); beyond that they are joined by a shuffle."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def _sieved(tokens: DataFrame, percent: int) -> DataFrame:
    """(c, t, doc_id, n, x, place, label): what documents keep when order 2 is taken over their differences from a centre c, and the
    place of each token in that order. tokens: (c, nc, doc_id, n, x, label, t), a row for each of the x tokens that stand in one of
    document (n tokens) and centre (nc tokens; 0 for the empty centre, where the differences are the set itself).

    Two documents a, b link if their differences share o = (x_a + x_b - h (n_a + n_b)) / 2 tokens, h = (100 - p) / (100 + p). Partners
    lie in different components, so one of them at most is linked to the centre; with that, the least o that any partner leaves
    follows from x, n and nc alone, and x - o + 1 tokens are the prefix. Tokens that stand in one component only cannot be shared with
    a partner in another: they come first in the order and leave. A document with too many of them has no partner and drops out."""
    across = tokens.groupBy("c", "t").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("u"), F.max("label").alias("v")).where("u <> v").select("c", "t", "m")
    across = C.written(across, "across")  # so that the join deals both sides out itself and a hot token can be split there
    mine = tokens.join(across, ["c", "t"]).groupBy("c", "nc", "doc_id", "n", "x", "label").agg(F.array_sort(F.collect_list(F.struct("m", "t"))).alias("able"))
    more, less = 100 + percent, 100 - percent
    linked = f"{more} * x <= {less} * (n + nc)"
    least = f"""greatest(1, x - cast(floor({less} * n / {percent}D) as int), cast(ceil(({more} * x - {less} * (n + nc)) / 200D) as int),
        CASE WHEN {linked} THEN cast(floor(({more} * x - {less} * (n - nc)) / {2 * more}D) as int) + 1 ELSE 1 END)"""
    kept = mine.withColumn("k", F.expr(f"size(able) + 1 - ({least})")).where("k > 0")
    rows = kept.select("c", "doc_id", "n", "x", "label", F.size("able").alias("many"), F.posexplode(F.slice("able", F.lit(1), F.col("k"))).alias("i", "e"))
    return C.written(rows.select("c", F.col("e.t").alias("t"), "doc_id", "n", "x", (F.col("x") - F.col("many") + F.col("i") + 1).alias("place"), "label"), "sieved")


def _whole(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Documents (doc_id, label) as differences from the empty centre."""
    own = sets.join(_small(open_.select("doc_id")), "doc_id", "left_semi").join(open_, "doc_id")
    return own.select(F.lit(0).cast("long").alias("c"), F.lit(0).alias("nc"), "doc_id", F.size("s").alias("n"), F.size("s").alias("x"), "label", F.explode("s").alias("t"))


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, nc, doc_id, n, x, e) of (c, doc_id): the x tokens e that stand in one of document and centre."""
    centres = sets.join(members.select(F.col("c").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("c"), F.col("s").alias("z"))
    # the members of a large group share a centre: each centre goes to SPREAD places, and a member to one of them
    centres = centres.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int")
    rows = members.join(sets.select("doc_id", "s"), "doc_id").withColumn("place", place).join(centres, ["c", "place"])
    rows = rows.select("c", F.size("z").alias("nc"), "doc_id", F.size("s").alias("n"), F.expr("concat(array_except(s, z), array_except(z, s))").alias("e"))
    return C.written(rows.select("c", "nc", "doc_id", "n", F.size("e").alias("x"), "e"), "differences")


def _fresh(pairs: DataFrame, met: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that were not met before, whose sizes can link and that also share a token under order 3. Only the few
    tokens of that prefix travel here."""
    pairs = pairs.where(f"100 * na >= {percent} * nb AND 100 * nb >= {percent} * na")
    pairs = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
    if met is not None:
        pairs = pairs.join(met.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), ["lo", "hi"], "left_anti")
    pairs = pairs.select("a", (F.col("lo") + F.col("hi") - F.col("a")).alias("b"))
    last = sets.select("doc_id", "tail")
    met3 = pairs.join(last.withColumnsRenamed({"doc_id": "a", "tail": "ta"}), "a").join(last.withColumnsRenamed({"doc_id": "b", "tail": "tb"}), "b")
    return C.written(met3.where("arrays_overlap(ta, tb)").select("a", "b"), "pairs")


def _starred(buckets: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b, na, nb) of each document with a centre of its bucket."""
    rows = buckets if turn == 0 else _open(buckets, labels)
    order = F.struct("share", "n", "doc_id") if turn == 0 else F.struct(F.xxhash64("doc_id", F.lit(turn)), "n", "doc_id")
    fields = [F.col("doc_id"), F.col("n")] + ([F.col("label")] if turn else [])
    centre = C.written(rows.groupBy("t").agg(F.max_by(F.struct(*fields), order).alias("c")), "centres")
    apart = "label <> c.label" if turn else "TRUE"
    return rows.join(centre, "t").where(f"doc_id <> c.doc_id AND {apart}").selectExpr("c.doc_id AS a", "doc_id AS b", "c.n AS na", "n AS nb")


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their labels, without the buckets that lie in one component."""
    rows = buckets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id")
    open_ = C.written(rows.groupBy("t").agg(F.min("label").alias("u"), F.max("label").alias("v")).where("u <> v").select("t"), "open")
    return rows.join(open_, "t")


def _met_in(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of rows of a bucket whose places leave room for the overlap that a link needs. At the first common token no
    more can be common than what follows in either; later tokens need not bring the pair again."""
    other = rows.selectExpr("c", "t", "doc_id AS b", "n AS nb", "x AS xb", "place AS pb", "label AS lb")
    more, less = 100 + percent, 100 - percent
    enough = f"{2 * more} * (1 + least(x - place, xb - pb)) >= {more} * (x + xb) - {less} * (n + nb)"
    sized = f"100 * n >= {percent} * nb AND 100 * nb >= {percent} * n"
    return rows.join(other, ["c", "t"]).where(f"doc_id < b AND label <> lb AND {sized} AND {enough}").selectExpr("doc_id AS a", "b", "n AS na", "nb")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents whose doc_id is the least of their component, and those with a null doc_id; all columns kept."""
    found = grouped(docs, **options)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(C.table(spark, sf_dir, "documents"))


def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(C.table(spark, sf_dir, "documents"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Brute force: all pairs that share a shingle, counted; components by a walk from every document.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {PERCENT} * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
"""
