r"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The model file is a parameter (its pieces and scores are read with the sentencepiece library; nothing is trained). The text is
normalised as the model says, spaces become U+2581. The automaton reads a text once; at each position the output links of its
state name every piece that ends there, longest first, and each relaxes the best score of that position. A character that no
piece covers costs the least piece score less 10 and is written as byte pieces (as <unk> if the model has none). Ties go to the
longest last piece.

No piece holds a U+2581 after another character (checked on loading), so the best path never crosses the start of a run of
spaces: the text falls into units there, each distinct unit of a batch is solved once, and units of like length advance through
the automaton together as arrays. This is exact; if a vocabulary breaks the condition, each text is one unit. A long unit (Chinese,
a token of megabytes) is cut further where the automaton's state is the character's first byte alone or the root, as no piece can then
span that place; the states of all positions come from blocks of the unit that advance together, each started as many bytes early as
the longest piece has, after which its state is the true one. What is still long (a repeated letter) goes through the same recurrence
one position at a time, without arrays: its cost is a fixed number of steps for each byte and output link.

The score of a segmentation is the sum of its piece scores, as in a unigram model. The supplied vocabulary was made for BPE
merges, so the ids are the best-scoring segmentation, not the library's merge order; decoding either gives the same text.

Decoding joins the pieces, byte pieces as bytes, U+2581 as a space, without the dummy prefix. It returns the text exactly, but
that a U+2581 in the input comes back as a space. Edge cases: null and empty text have no ids and decode to the empty text;
texts without spaces and very long texts are whole; repeated rows are coded row by row; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MODEL = "piece_bpe_32k.model"
#: Bytes from which a unit is looked over for further cuts, and of a block in that look.
LONG_UNIT = 96
RUN = 1_024
#: Fewer units than this do not go together as arrays.
FEW = 24
#: Bytes of text that are coded together: arrays of eight bytes a position are made of them.
SEGMENT = 1 << 19


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Automaton and tables of one model; built once in each Python process."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        probe = "ﬁ  Å x"
        plain = sp.normalize(probe)
        self.prefix = sp.normalize("a").startswith(SPACE)
        self.identity = plain.lstrip(SPACE) == probe.replace(" ", SPACE) and sp.normalize(" a ").endswith("a" + SPACE)
        self.unk = sp.unk_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = np.full(256, -1, np.int32)
        texts = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            else:
                texts.append(b"" if special[i] else piece.replace(SPACE, " ").encode())
        usable = [i for i in range(n) if not special[i] and not sp.is_byte(i) and texts[i]]
        self.by_word = not any(" " in texts[i].decode().lstrip(" ") for i in usable)
        scores = np.array([sp.get_score(i) for i in range(n)], np.float64)
        self.unknown = float(scores[usable].min()) - UNKNOWN_PENALTY if usable else -UNKNOWN_PENALTY
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self._automaton(usable, texts, scores)

    def _automaton(self, usable: list[int], texts: list[bytes], scores: np.ndarray) -> None:
        children: list[dict[int, int]] = [{}]
        depth, piece = [0], [-1]
        for i in usable:
            s = 0
            for c in texts[i]:
                t = children[s].get(c)
                if t is None:
                    t = children[s][c] = len(children)
                    children.append({})
                    depth.append(depth[s] + 1)
                    piece.append(-1)
                s = t
            if piece[s] < 0 or scores[i] > scores[piece[s]]:
                piece[s] = i
        n = len(children)
        goto = np.zeros((n, 256), np.int32)
        fail, out = np.zeros(n, np.int32), np.zeros(n, np.int32)  # out: the nearest state on the failure path, itself too, that ends a piece
        level = [0]
        ends = np.array(piece, np.int32)
        while level:
            below = []
            for s in level:  # the failure state is shallower, so its row is complete
                if s:
                    goto[s] = goto[fail[s]]
                    out[s] = s if ends[s] >= 0 else out[fail[s]]
                for c, t in children[s].items():
                    fail[t] = goto[s, c] if s else 0
                    below.append(t)
                for c, t in children[s].items():
                    goto[s, c] = t
            level = below
        self.goto, self.out = goto, out
        self.depth = np.array(depth, np.int32)
        self.longest = int(self.depth.max())
        self._links: dict[int, list[tuple[int, float, int]]] = {0: []}
        self.next = out[fail]  # the next shorter piece that ends where this one does
        self.piece = ends
        self.piece_length = np.array(depth, np.int32)
        self.piece_score = np.where(ends >= 0, scores[np.maximum(ends, 0)], 0.0)

    def solve(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, number of ids of each unit) by Viterbi; units of like length go together."""
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(0, np.int64)
        order = np.argsort(lengths, kind="stable")
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]]) + 4
            stop = at + int(np.searchsorted(lengths[order[at:]], longest, side="right"))
            stop = min(stop, at + max(1, (2 << 20) // (longest + 1)))
            take = order[at:stop]
            if len(take) < FEW and longest > FEW:  # arrays of so few columns cost more than they save
                one = [self._walk(buf[s : s + n]) for s, n in zip(starts[take].tolist(), lengths[take].tolist(), strict=True)]
                parts.append((take, np.concatenate(one), np.array([len(x) for x in one], np.int64)))
            else:
                parts.append((take, *self._solve(buf, starts[take], lengths[take])))
            at = stop
        counts = np.zeros(len(starts), np.int64)
        for take, _, n in parts:
            counts[take] = n
        begin = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for take, ids, n in parts:
            flat[C.gathered(begin[take], n)] = ids
        return flat, counts

    def _ends(self, o: int) -> list[tuple[int, float, int]]:
        """(length, score, state) of the pieces that end at a state, longest first."""
        found = self._links.get(o)
        if found is None:
            found = self._links[o] = [(int(self.piece_length[o]), float(self.piece_score[o]), o), *self._ends(int(self.next[o]))]
        return found

    def _walk(self, text: np.ndarray) -> np.ndarray:
        """The ids of one unit, a position at a time."""
        data, n = text.tobytes(), len(text)
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        goto, out, links = self.goto, self.out, self._links
        state = char = 0
        for t, b in enumerate(data):
            char = char + 1 if b & 0xC0 == 0x80 else 1
            state = goto.item(state, b)
            o = out.item(state)
            top, how, single = best[t + 1], 0, False
            for size, score, ends in links.get(o) or self._ends(o):
                value = best[t + 1 - size] + score
                if value > top:
                    top, how = value, ends
                single = single or size == char
            if not single and (t + 1 == n or data[t + 1] & 0xC0 != 0x80):
                value = best[t + 1 - char] + self.unknown
                if value > top:
                    top, how = value, -char
            best[t + 1], back[t + 1] = top, how
        fallback = (self.byte_id >= 0).all()
        ids, at = [], n
        while at:
            how = back[at]
            if how > 0:
                ids.append(int(self.piece[how]))
                at -= int(self.piece_length[how])
            else:
                ids.extend(self.byte_id[np.frombuffer(data[at + how : at], np.uint8)][::-1].tolist() if fallback else [self.unk])
                at += how
        return np.array(ids[::-1], np.int32)

    def _cuts(self, buf: np.ndarray) -> np.ndarray:
        """Places of buf (long units, one after the other) that no piece spans and where a character begins."""
        n, early = len(buf), self.longest
        columns = -(-n // RUN)
        state = np.zeros(columns, np.int32)
        begin = np.arange(columns) * RUN
        depth = np.zeros(columns * RUN, np.int32)
        for k in range(-early, RUN):
            at = begin + k
            inside = (at >= 0) & (at < n)
            state = np.where(inside, self.goto[state, buf[np.clip(at, 0, n - 1)]], 0)
            if k >= 0:
                depth[at] = self.depth[state]
        return np.flatnonzero((depth[:n] <= 1) & ((buf & 0xC0) != 0x80))

    def _solve(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, most = len(starts), int(lengths.max())
        text = np.zeros((most, n), np.uint8)
        for t in range(most):
            text[t] = buf[np.minimum(starts + t, len(buf) - 1)]
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((most + 1, n), np.int32)  # > 0: a state that ends a piece; < 0: an unknown character of so many bytes
        state = np.zeros(n, np.int32)
        char = np.zeros(n, np.int32)  # bytes of the character so far
        rows = np.arange(n)
        for t in range(most):
            b = text[t]
            char = np.where((b & 0xC0) == 0x80, char + 1, 1)
            state = self.goto[state, b]
            o = self.out[state]
            live = rows
            here, link = best[t + 1], back[t + 1]
            single = np.zeros(n, bool)
            o = o[live]
            some = o > 0
            live, o = live[some], o[some]
            while len(live):
                size = self.piece_length[o]
                value = best[t + 1 - size, live] + self.piece_score[o]
                better = value > here[live]
                won = live[better]
                here[won], link[won] = value[better], o[better]
                single[live[size == char[live]]] = True
                o = self.next[o]
                some = o > 0
                live, o = live[some], o[some]
            # at the end of a character that is no piece
            following = text[t + 1] if t + 1 < most else np.zeros(n, np.uint8)
            end = ~single & (((following & 0xC0) != 0x80) | (t + 1 >= lengths))
            lost = rows[end]
            value = best[t + 1 - char[lost], lost] + self.unknown
            better = value > here[lost]
            here[lost[better]], link[lost[better]] = value[better], -char[lost[better]]
        # back from the ends, all units a piece at a time
        steps, pos, live = [], lengths.astype(np.int64).copy(), rows
        while len(live):
            b = back[pos[live], live]
            steps.append((live, b, pos[live]))
            pos[live] -= np.where(b > 0, self.piece_length[np.maximum(b, 0)], -b)
            live = live[pos[live] > 0]
        rank = np.concatenate([np.full(len(s[0]), k) for k, s in enumerate(steps)])
        who, what, stop = (np.concatenate([s[k] for s in steps]) for k in range(3))
        fallback = (self.byte_id >= 0).all()
        width = np.where(what > 0, 1, -what if fallback else 1)
        order = np.lexsort((-rank, who))
        who, what, stop, width = who[order], what[order], stop[order], width[order]
        ids = np.repeat(np.where(what > 0, self.piece[np.maximum(what, 0)], self.unk), width).astype(np.int32)
        odd = np.flatnonzero(what < 0)
        if len(odd) and fallback:
            first = np.cumsum(width) - width
            slots = C.gathered(first[odd], width[odd])
            source = C.gathered(starts[who[odd]] + stop[odd] + what[odd], width[odd])
            ids[slots] = self.byte_id[buf[source]]
        return ids, np.bincount(who, width, n).astype(np.int64)

    def normalised(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes with spaces for U+2581 and the dummy prefix in front of each text that is not empty."""
        raw = buf.tobytes()
        if not self.identity or b"\xe2\x96\x81" in raw:
            parts = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                text = raw[a:b].decode()
                text = text if self.identity else self.sp.normalize(text).removeprefix(SPACE if self.prefix else "")
                parts.append(text.replace(SPACE, " ").encode())
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            buf = np.frombuffer(b"".join(parts), np.uint8)
        if not self.prefix:
            return buf, offsets
        some = np.diff(offsets) > 0
        return np.insert(buf, offsets[:-1][some], 32), offsets + np.concatenate([[0], np.cumsum(some)])

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each text, normalised bytes, their offsets)."""
        buf, offsets = self.normalised(buf, offsets)
        n = len(buf)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64), buf, offsets
        cut = np.zeros(n, bool)
        if self.by_word:
            space = buf == 32
            cut[1:] = space[1:] & ~space[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, n))
        if (long_ := lengths > LONG_UNIT).any():
            # long units stand next to each other in `own`; a state that reaches back over a seam only spares a cut
            own = C.gathered(starts[long_], lengths[long_])
            cut[own[self._cuts(buf[own])]] = True
            starts = np.flatnonzero(cut)
            lengths = np.diff(np.append(starts, n))
        up, down = C._power(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C._LETTER[buf] * up[:n], dtype=np.uint64)])
        print_ = C.mix((total[starts + lengths] - total[starts]) * down[starts] + lengths.astype(np.uint64))
        _, first, inverse = np.unique(print_, return_index=True, return_inverse=True)
        flat, counts = self.solve(buf, starts[first], lengths[first])
        begin = np.cumsum(counts) - counts
        own = counts[inverse]
        ids = flat[C.gathered(begin[inverse], own)]
        sums = np.concatenate([[0], np.cumsum(own)])
        at = np.searchsorted(starts, offsets)
        each = np.diff(sums[at])
        # two units with one fingerprint would show here
        same = self.decoded(ids)
        if len(same) != n or not np.array_equal(same, buf):
            flat, counts = self.solve(buf, starts, lengths)
            sums = np.concatenate([[0], np.cumsum(counts)])
            ids, each = flat, np.diff(sums[at])
        return ids, each, buf, offsets

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, with spaces for U+2581 and the dummy prefix still there."""
        return self.blob[C.gathered(self.at[ids], self.lengths[ids])]

    def decode(self, ids: np.ndarray) -> str:
        text = self.decoded(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(proto: bytes) -> Codec:
    key = hashlib.sha256(proto).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(proto)
    return _codecs[key]


def encode(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int; only with_ids), ids_crc32 (little-endian unsigned 32-bit ids), decoded_crc32 and
    decoded_bytes of the text that the ids decode to, exact: whether that is the normalised text."""
    C.small_batches(docs.sparkSession)
    proto = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        c = codec(proto.value)
        for batch in batches:
            keys = C.as_array(batch, "doc_id")
            for a, b, buf, offsets in C.segments(C.as_array(batch, "text"), SEGMENT):
                ids, each, norm, norm_at = c.encode(buf, offsets)
                ends = np.cumsum(each)
                back = c.decoded(ids).tobytes()
                size = np.concatenate([[0], np.cumsum(c.lengths[ids])])[np.concatenate([[0], ends])]
                skip = 1 if c.prefix else 0
                raw, wide = norm.tobytes(), ids.astype("<u4")
                crc, text_crc, text_len, exact = [], [], [], []
                for k in range(b - a):
                    crc.append(zlib.crc32(wide[ends[k] - each[k] : ends[k]].tobytes()))
                    got = back[size[k] + (skip if each[k] else 0) : size[k + 1]]
                    text_crc.append(zlib.crc32(got))
                    text_len.append(len(got))
                    exact.append(got == raw[norm_at[k] + (skip if norm_at[k + 1] > norm_at[k] else 0) : norm_at[k + 1]])
                columns = [keys.slice(a, b - a), pa.array(each), pa.array(crc, pa.int64()), pa.array(text_crc, pa.int64()), pa.array(text_len, pa.int64()), pa.array(exact, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "decoded_bytes", "exact"]
                if with_ids:
                    columns.append(C.ragged(ids, each, pa.int32()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_crc32 long, decoded_bytes long, exact boolean" + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, *, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of the ids; null ids give null."""
    proto = encoded.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto.value)
        for batch in batches:
            got = [None if x is None else c.decode(x) for x in C.as_array(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([C.as_array(batch, "doc_id"), pa.array(got, pa.string())], names=["doc_id", "text"])

    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(C.table(spark, sf_dir, "documents"))
