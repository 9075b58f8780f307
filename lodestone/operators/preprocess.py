"""Text normalisation and chunking, as expressions over whole texts; a text never leaves its row.

Offsets and sizes are characters. Decisions: a size chunker stops when it has reached the end of the text (no chain of shrinking
tails); a sentence chunk starts at the first sentence that it holds, seed included."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_SIZE, OVERLAP = 1000, 100


def whitespace(c: Column) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), " {2,}", " ")
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$", "")


#: Mis-decoded and typographic characters, in order (fixed values).
ENCODING = (("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("’", "'"), ("“", '"'), ("”", '"'), ("—", "-"), ("–", "-"), ("…", "..."), ("‘", "'"))


def encoding(c: Column) -> Column:
    for a, b in ENCODING:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def punctuation(c: Column) -> Column:
    """A space after a full stop before A-Z, after commas, colons and semicolons, none before them or inside parentheses. It also
    parts URLs, times and numbers with thousands; extraction therefore reads raw text."""
    c = F.regexp_replace(c, r"\.([A-Z])", r". $1")
    for mark in (",", ":", ";"):
        c = F.replace(c, F.lit(" " + mark), F.lit(mark))
        c = F.replace(F.replace(c, F.lit(mark), F.lit(mark + " ")), F.lit(mark + "  "), F.lit(mark + " "))
    return F.replace(F.replace(c, F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))


def preprocess(c: Column) -> Column:
    return punctuation(encoding(whitespace(c)))


#: A sentence reaches to the end of its terminator and the white space after it.
SENTENCE = r"(?s).*?[.!?]+[\t\n\f\r ]+|.+"


def sentences(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(SENTENCE), 0), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n[\t\n\f\r ]*\n"), lambda x: F.regexp_replace(x, r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$", "")), lambda x: x != "")


def _size_chunks(most: int, overlap: int):
    """A function of a text column: array of (start, end, chunk), in time proportional to the text; null gives null."""

    @F.pandas_udf("array<struct<start:int,end:int,chunk:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[tuple[int, int, str]] | None:
            if t is None:
                return None
            out, at, n = [], 0, len(t)
            while n:
                end = n
                if at + most < n:
                    space = t.rfind(" ", at, at + most)
                    end = space if space - at > most // 2 else at + most
                out.append((at, end, t[at:end]))
                if end >= n:
                    break
                at = max(end - overlap, at + 1)
            return out

        return texts.map(one)

    return cut


def chunk_by_size(rows: DataFrame, *, most: int = MAX_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, ordinal, start, end, chunk, strategy: windows of at most `most` characters that end at a space in their second half where
    there is one; the next starts `overlap` characters before the end. The chunks leave the text in one pass, and the text stays behind."""
    one = rows.select("id", _size_chunks(most, overlap)("content").alias("c")).select("id", F.posexplode("c").alias("ordinal", "c"))
    return one.select("id", "ordinal", "c.start", "c.end", "c.chunk", F.lit("size").alias("strategy"))


def _pack_sql(lengths: str, most: int, overlap: int) -> str:
    """array of (a, b, kind): runs of sentences packed greedily; kind 1: one sentence longer than `most`."""
    seed1 = f"(i - 1 >= s.a AND l[i - 2] <= {overlap})"
    seed2 = f"({seed1} AND i - 2 >= s.a AND l[greatest(i - 3, 0)] + l[i - 2] <= {overlap})"
    push = lambda a, b, k: f"concat(s.out, array(named_struct('a', {a}, 'b', {b}, 'kind', {k})))"
    return f"""transform(array({lengths}), l -> aggregate(sequence(1, size(l) + 1), named_struct('a', 0, 'size', 0, 'out', cast(array() as array<struct<a:int,b:int,kind:int>>)),
      (s, i) -> CASE
        WHEN i > size(l) THEN named_struct('a', 0, 'size', 0, 'out', CASE WHEN s.a > 0 THEN {push('s.a', 'i - 1', '0')} ELSE s.out END)
        WHEN l[i - 1] > {most} THEN named_struct('a', 0, 'size', 0, 'out', concat(CASE WHEN s.a > 0 THEN {push('s.a', 'i - 1', '0')} ELSE s.out END, array(named_struct('a', i, 'b', i, 'kind', 1))))
        WHEN s.a = 0 THEN named_struct('a', i, 'size', l[i - 1], 'out', s.out)
        WHEN s.size + l[i - 1] <= {most} THEN named_struct('a', s.a, 'size', s.size + l[i - 1], 'out', s.out)
        ELSE named_struct('a', CASE WHEN {seed2} THEN i - 2 WHEN {seed1} THEN i - 1 ELSE i END,
          'size', l[i - 1] + CASE WHEN {seed1} THEN l[i - 2] ELSE 0 END + CASE WHEN {seed2} THEN l[greatest(i - 3, 0)] ELSE 0 END, 'out', {push('s.a', 'i - 1', '0')}) END, s -> s.out))[0]"""


def pack_sentences(rows: DataFrame, *, most: int = MAX_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, content, packs: array of (a, b, kind, start, end); a and b number the sentences from 1."""
    cut = rows.select("id", "content", F.transform(sentences(F.col("content")), lambda x: F.length(x)).alias("l"))
    # every array is bound once: a generator above makes the optimizer write expressions out again, also inside lambdas
    ends = "aggregate(v, array(0), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))"
    spans = f"transform(array({ends}), e -> transform({_pack_sql('v', most, overlap)}, x -> named_struct('a', x.a, 'b', x.b, 'kind', x.kind, 'start', e[x.a - 1], 'end', e[x.b])))[0]"
    none = "cast(array() as array<struct<a:int,b:int,kind:int,start:int,end:int>>)"
    return cut.select("id", "content", F.expr(f"transform(array(l), v -> CASE WHEN size(v) > 0 THEN {spans} ELSE {none} END)[0]").alias("packs"))


def chunk_by_sentence(rows: DataFrame, *, most: int = MAX_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, ordinal, start, end, chunk, strategy. A sentence longer than `most` is cut by size ("sentence-size")."""
    packs = pack_sentences(rows, most=most, overlap=overlap)
    one = packs.select("id", "content", F.posexplode("packs").alias("n", "p")).select("id", "n", F.col("p.kind").alias("kind"), F.col("p.start").alias("start"), F.expr("substring(content, p.start + 1, p.end - p.start)").alias("t"))
    long = _size_chunks(most, overlap)(F.when(F.col("kind") == 1, F.col("t")))  # nulls, which cost nothing, for all others
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("t").alias("end"), F.col("t").alias("chunk")))
    out = one.withColumn("long", long).select("id", "n", "kind", "start", F.posexplode(F.coalesce("long", whole)).alias("m", "s"))

    ordinal = F.row_number().over(Window.partitionBy("id").orderBy("n", "m")) - 1
    return out.select(
        "id", ordinal.alias("ordinal"), (F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"),
        F.col("s.chunk").alias("chunk"), F.when(F.col("kind") == 1, "sentence-size").otherwise("sentence").alias("strategy"),
    )


def chunk_by_paragraph(rows: DataFrame, *, most: int = MAX_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, ordinal, chunk, strategy: paragraphs packed greedily, joined by a blank line that is counted after the fit test; a longer
    paragraph is cut by sentence ("paragraph-sentence")."""
    packed = rows.select("id", paragraphs(F.col("content")).alias("p")).select("id", F.expr(
        f"""aggregate(p, named_struct('now', '', 'out', cast(array() as array<struct<chunk:string,long:boolean>>)),
        (s, x) -> CASE WHEN length(x) > {most} THEN named_struct('now', '', 'out', concat(CASE WHEN s.now != '' THEN concat(s.out, array(named_struct('chunk', s.now, 'long', false))) ELSE s.out END, array(named_struct('chunk', x, 'long', true))))
          WHEN s.now = '' THEN named_struct('now', x, 'out', s.out)
          WHEN length(s.now) + length(x) <= {most} THEN named_struct('now', concat(s.now, '\\n\\n', x), 'out', s.out)
          ELSE named_struct('now', x, 'out', concat(s.out, array(named_struct('chunk', s.now, 'long', false)))) END,
        s -> CASE WHEN s.now != '' THEN concat(s.out, array(named_struct('chunk', s.now, 'long', false))) ELSE s.out END)"""
    ).alias("c")).select("id", F.posexplode("c").alias("n", "c"))
    short = packed.where("NOT c.long").select("id", "n", F.lit(0).alias("m"), F.col("c.chunk").alias("chunk"), F.lit("paragraph").alias("strategy"))
    long = packed.where("c.long").select(F.struct("id", "n").alias("id"), F.col("c.chunk").alias("content"))
    cut = chunk_by_sentence(long, most=most, overlap=overlap).select("id.id", "id.n", F.col("ordinal").alias("m"), "chunk", F.lit("paragraph-sentence").alias("strategy"))
    return short.unionByName(cut).select("id", (F.row_number().over(Window.partitionBy("id").orderBy("n", "m")) - 1).alias("ordinal"), "chunk", "strategy")


def chunk(rows: DataFrame, strategy: str = "sentence", *, most: int = MAX_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """By size or paragraph; anything else is by sentence."""
    if overlap >= most:
        raise ValueError("the overlap must be less than the size")
    return {"size": chunk_by_size, "paragraph": chunk_by_paragraph}.get(strategy, chunk_by_sentence)(rows, most=most, overlap=overlap)
