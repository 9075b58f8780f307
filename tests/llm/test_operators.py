"""The corpus operators: brute force, round trips, held-out accuracy, and odd inputs for each."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common as C, decontaminate as DC, jaccard_join as JJ, language_id as LI, license_scan as LS, minimax_shards as MS, piece_codec as PC, quality_cascade as QC, queries, token_store as TS, toxicity_fm as TX, warc_revisit as WR

from ..oracle import SF, connect, same

#: Nulls in every column, empty, wordless, repeated, odd and long texts; columns with names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, n string, label string, items string, t string"
LONG = " ".join(f"word{i % 700} filler{i}" for i in range(12_000))


def odd_rows():
    texts = [None, "", "   \n\t ", "123 456 !!", "word", "one two three", "a\x00b \x1c c\u00a0d \u2581 é 日本語 😀", LONG, "x" * 30_000, "one two three", "One  TWO three", "\n\n", "tail space "]
    rows = [(k, t, "en" if k % 3 else None, "s", None, "w", "n", "l", "i", "t") for k, t in enumerate(texts)]
    return rows + [rows[5], (None, "null id here", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), connect().execute(queries.ORACLES[name]).df())


# ---------------------------------------------------------------- words


def test_words_against_patterns():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB1 \t\n.é\x00日-") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    for kind, pattern in ((C.SPACED, rb"[^\x20\x09-\x0D]+"), (C.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = C.Words(np.frombuffer(b"".join(data), np.uint8), offsets, kind)
        raw = w.buf.tobytes()
        got = [[raw[a:b] for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
        assert got == [re.findall(pattern, re.sub(rb"[A-Z]", lambda m: m[0].lower(), d)) for d in data]
        seen = {}
        for h, a, b in zip(w.hash.tolist(), w.starts, w.ends):
            assert seen.setdefault(h, raw[a:b]) == raw[a:b]


# ---------------------------------------------------------------- 1


def library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(TS.TOKENIZER))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_is_the_library():
    rng = random.Random(1)
    alphabet = "ab'sretvmld  \n\t.,!1²é\xa0\x85\x1c\x0b\"S½ªÿ×\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["don't you'll we've 'store", "日本 it's", "<|endoftext|>x", "", " ", "  ", "a  ", "''s", "'l"]
    ids, counts = TS.Encoder(TS.tokenizer_json())(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library(texts)


def test_crc_of_joined_parts():
    a, b = b"some bytes", bytes(range(256)) * 9
    assert TS.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert TS.crc_joined(0, zlib.crc32(a), len(a)) == zlib.crc32(a)


def test_streamed_merkle_root():
    for n in range(1, 40):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        m = TS._Merkle()
        for x in leaves:
            m.add(x)
        # a stream pairs equal subtrees, as the levels do, when the number of leaves is a power of two
        if n & (n - 1) == 0:
            assert m.root() == TS.merkle_root(leaves)
        assert len(m.root()) == 32


def test_store_round_trip(spark, odd, tmp_path):
    path = str(tmp_path / "store")
    many = odd.unionByName(odd.where("doc_id = 7").withColumn("doc_id", F.lit(1000).cast("long")))
    TS.write(many, path)
    got = sorted(TS.verify(spark, path).collect(), key=lambda r: r.start)
    assert all(r.verified for r in got) and len(got) == many.count()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in many.collect()), key=lambda x: (x is not None, x))
    back = {r.start: r.ids for r in TS.reconstruct(spark, path).collect()}
    start = 0
    rows = many.collect()
    by_id = {}
    for r, x in zip(rows, library([r.text for r in rows])):
        by_id.setdefault(r.doc_id, []).append(x + [2])
    for r in got:
        assert r.start == start and back[start] in by_id[r.doc_id]
        assert r.n_tokens == len(back[start]) and r.ids_crc32 == zlib.crc32(np.array(back[start], "<u4").tobytes())
        start += r.n_tokens
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() < sum(r.n_chunks for r in got)


def test_store_of_nothing_and_damage(spark, empty, odd, tmp_path):
    TS.write(empty, str(tmp_path / "none"))
    assert TS.verify(spark, str(tmp_path / "none")).count() == 0
    TS.write(odd, str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a/chunks")).withColumn("payload", F.when(F.col("n_ids") > 100, F.expr("overlay(payload PLACING X'FFFF' FROM 3)")).otherwise(F.col("payload")))
    bad.write.parquet(str(tmp_path / "b"))
    import shutil

    shutil.rmtree(tmp_path / "a/chunks")
    shutil.move(tmp_path / "b", tmp_path / "a/chunks")
    out = TS.verify(spark, str(tmp_path / "a"))
    assert 0 < out.where("NOT verified").count() < out.count()


def test_lost_recipes_show(spark, odd, tmp_path):
    import shutil

    TS.write(odd.repartition(4), str(tmp_path / "a"))
    assert TS.damaged_parts(spark, str(tmp_path / "a")) == []
    recipes = spark.read.parquet(str(tmp_path / "a/recipes"))
    recipes.where("doc_id IS NULL OR doc_id <> 7").write.parquet(str(tmp_path / "b"))
    shutil.rmtree(tmp_path / "a/recipes")
    shutil.move(tmp_path / "b", tmp_path / "a/recipes")
    out = TS.verify(spark, str(tmp_path / "a"))
    assert out.count() == odd.count() - 1 and out.where("NOT verified").count() > 0
    spark.read.parquet(str(tmp_path / "a/manifest")).where("part <> 0").write.parquet(str(tmp_path / "m"))
    shutil.rmtree(tmp_path / "a/manifest")
    shutil.move(tmp_path / "m", tmp_path / "a/manifest")
    with pytest.raises(ValueError):
        TS.verify(spark, str(tmp_path / "a"))


# ---------------------------------------------------------------- 2


def test_language(spark, docs, odd, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = LI.fit(big)
    got = LI.predict(big, model).join(big.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    out = {r.doc_id: r for r in LI.predict(odd, model).collect()}
    assert {k for k, r in out.items() if r.lang_pred == "und"} >= {0, 1, 2, 3, 11} and out[0].score == 0 and out[None].held_out
    assert all(0 <= r.score <= 1 for r in out.values()) and LI.predict(odd, model).count() == odd.count()
    assert LI.predict(empty, model).count() == 0 and LI.keep(empty).count() == 0
    kept = LI.keep(odd, model=model)
    assert kept.columns == odd.columns and 3 not in {r.doc_id for r in kept.collect()}
    none = LI.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in LI.predict(odd, none).collect()} == {"und"}
    one = LI.fit(big.where("lang = 'fr'"))
    assert {(r.lang_pred, r.score) for r in LI.predict(docs, one).collect()} <= {("fr", 1.0), ("und", 0.0)}


def test_family_of_five_languages_stays(spark):
    rng = random.Random(4)
    words = {c: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(80)] for c, letters in (("en", "abcdef"), ("de", "ghijkl"), ("nl", "mnopqr"), ("sv", "stuvwx"), ("da", "yzacegi"), ("fr", "bdfhjln"))}
    rows = [(k, " ".join(rng.choices(words[c], k=60)), c) for k, c in enumerate(list(words) * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = LI.fit(table)
    assert sorted(map(len, model.members)) == [1, 5]
    got = LI.predict(table, model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {k: c for k, _, c in rows}
    assert min(r.score for r in got) > LI.KEEP_SCORE and max(r.score for r in got) <= 1
    assert LI.keep(table, model=model).count() == len(rows)


def brute_language(model, text):
    """Prediction of one text, straight from the definition: shares of trigrams and words, margins, votes."""
    raw = (text or "").encode()
    letters = [bytes([b + 32 if 65 <= b <= 90 else b]) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else b" " for b in raw]
    padded = [b" ", *letters, b" "]
    size = int(np.log2(LI.DIM))
    x = np.zeros(2 * LI.DIM)
    grams = [(padded[i] + padded[i + 1] + padded[i + 2]) for i in range(len(letters)) if padded[i + 1] != b" "]
    for g in grams:
        x[(int.from_bytes(g, "big") * 2654435761 % (1 << 32)) >> (32 - size)] += 1 / len(grams)
    words = b"".join(letters).split()
    for w in words:
        x[LI.DIM + (int(C.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), LI._LETTERS).hash[0]) >> (64 - size))] += 1 / len(words)
    p = 1 / (1 + np.exp(-model.slopes * (x @ model.w + model.b)))
    names = model.families
    if len(names) == 2:
        family = [p[0], 1 - p[0]]
    else:
        family = [p[k] for k in range(len(names))] if len(names) > 1 else [1.0]
        family = [f / sum(family) for f in family]
    f = int(np.argmax(family))
    votes = {k: [] for k in model.members[f]}
    for q, (kind, i, j) in enumerate(model.problems):
        if kind == "pair" and i in votes and j in votes:
            votes[i].append(p[q])
            votes[j].append(1 - p[q])
    mean = {k: np.mean(v) if v else 1.0 for k, v in votes.items()}
    best = max(mean, key=lambda k: mean[k])
    return model.langs[best], family[f] * mean[best]


def test_language_against_brute_force(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = LI.fit(big)
    rows = [r for r in big.select("doc_id", "text").collect() if r.text and re.search(r"[^\W\d_]", r.text)][:150]
    got = {r.doc_id: r for r in LI.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for r in rows:
        lang, score = brute_language(model, r.text)
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-4) and (got[r.doc_id].lang_pred == lang or abs(score - 0.5) < 1e-3)


def test_many_languages_and_repeated_rows(spark):
    """Every language is learned, whatever their number and the bound; a row repeated very often comes to the driver once."""
    rng = random.Random(12)
    rows = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) + f"q{'xyzw'[c % 4]}{'klmn'[c // 4 % 4]}{'uvst'[c // 16]}" for _ in range(30)), f"l{c:02}") for k, c in enumerate(list(range(40)) * 12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hot = table.unionByName(table.where("doc_id = 3").crossJoin(spark.range(3000)).select("doc_id", "text", "lang"))
    langs, label, x = LI._sample(hot, 80, "doc_id", "text", "lang")
    assert len(langs) == 40 and len(x) <= 40 * LI.LEAST_ROWS * 2 and len(label) == len(x)
    assert sorted(LI.fit(table, max_rows=80).langs) == sorted({r[2] for r in rows})


def test_language_keeps_any_columns(odd):
    named = odd.withColumnsRenamed({"words": "__letter", "n": "letter", "label": "row"})
    assert LI.keep(named).columns == named.columns


# ---------------------------------------------------------------- 3


def base_numbers(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for own in at.values() if len(own) > 1 for i in own for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, odd, empty):
    for d in (docs, odd):
        texts = {(r.doc_id, r.text) for r in d.collect()}
        got = QC.measure(d).collect()
        assert len(got) == d.count()
        want = {}
        for i, t in texts:
            want.setdefault(i, []).append(base_numbers(t))
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in want[r.doc_id]
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
        assert QC.keep(d).columns == d.columns and QC.keep(d).count() == sum(r.kept for r in got)
        assert QC.measure(d).where("kept").count() == sum(r.kept for r in got)
    assert QC.measure(empty).count() == 0 and len(QC.plan(empty)) == len(QC.RULES)


def test_rules_by_measured_cost(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cheap = QC.Rule("cheap", "n_words < 60")
    slow = QC.Rule("slow", "n_words < 60 AND size(transform(sequence(1, 3000), x -> sha2(cast(x as string), 256))) >= 0 OR size(filter(sequence(1, 3000), x -> sha2(cast(x as string), 256) = '')) > 0")
    never = QC.Rule("never", "n_words < 0")
    for rules in itertools.permutations((cheap, slow, never)):
        assert [r.name for r in QC.plan(d, rules)] == ["cheap", "slow", "never"]
    names = [r.name for r in QC.plan(d, QC.BASE_RULES + QC.RULES)]
    assert names.index("base_words") < names.index("base_repeats") and names.index("symbol_share") < names.index("base_repeats")
    assert sorted(r.doc_id for r in QC.keep(d, rules=(slow, never)).collect()) == sorted(r.doc_id for r in QC.measure(d, rules=(cheap,)).where("kept").collect())


# ---------------------------------------------------------------- 4


def brute_viterbi(codec, text, pieces):
    text = " " + text.replace(PC.SPACE, " ") if text else ""
    best, back = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 40), j):
            s = pieces.get(text[i:j], codec.unknown if i == j - 1 else None)
            if s is not None and best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, i
    return best[len(text)]


def test_pieces(spark, odd, empty):
    codec = PC.codec(PC.model_bytes())
    sp = codec.sp
    pieces = {sp.id_to_piece(i).replace(PC.SPACE, " "): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    rng = random.Random(5)
    texts = ["".join(rng.choice("the of ing ation é日\n\u2581😀zq ") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["hello world", "  two  spaces ", "", "日本語"]
    # without spaces: cut where no piece spans, or walked a position at a time
    texts += ["".join(rng.choice(a) for _ in range(n)) for a in ("theofingation", "中文日本語的是不了人我在有他这为之大来", "ab😀", "x", "=-", "éàü") for n in (90, 97, 400, 2500)]
    for t in texts:
        b = t.encode()
        ids, each, _, _ = codec.encode(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        assert codec.decode(ids) == t.replace(PC.SPACE, " ")
        assert sp.decode(ids.tolist()) == t.replace(PC.SPACE, " ") or t.startswith(" ")
        # byte ids stand for characters that no piece covers, and cost once for each of these
        score, at = 0.0, 0
        while at < len(ids):
            if sp.is_byte(int(ids[at])):
                lead = int(sp.id_to_piece(int(ids[at]))[3:5], 16)
                at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                score += codec.unknown
            else:
                score += sp.get_score(int(ids[at]))
                at += 1
        assert score == pytest.approx(brute_viterbi(codec, t, pieces))
    assert [codec._walk(np.frombuffer(t.encode(), np.uint8)).tolist() for t in texts if t] == [codec._solve(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t.encode())]))[0].tolist() for t in texts if t]


def test_cost_without_spaces():
    """A byte of unspaced text costs no more than a few bytes of English, whatever the length."""
    import time

    codec = PC.codec(PC.model_bytes())
    rng = random.Random(6)

    def cost(t):
        b = np.frombuffer(t.encode(), np.uint8)
        began = time.process_time()
        codec.encode(b, np.array([0, len(b)]))
        return (time.process_time() - began) / len(b) * 1e6

    chinese = "".join(rng.choice("的一是不了人我在有他这为之大来以个中上们") for _ in range(300_000))
    cost(chinese[:2000])
    assert cost(chinese) < 1 and cost("ab" * 200_000) < 6


def test_pieces_of_odd_rows(spark, odd, empty):
    out = PC.encode(odd)
    assert out.count() == odd.count() and out.where("NOT exact").count() == 0
    back = {(r.doc_id, r.text) for r in PC.decode(out).collect()}
    assert back == {(r.doc_id, (r.text or "").replace(PC.SPACE, " ")) for r in odd.collect()}
    assert PC.encode(empty).count() == 0


# ---------------------------------------------------------------- 5


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_near_copies(spark, k, percent):
    rng = random.Random(k)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(rng.choice((12, 60, 150, 300)))]
        for _ in range(rng.randint(2, 16)):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
            if rng.random() < 0.2:
                w = w[: -rng.randint(1, max(1, len(w) // 10))]
            rows.append(" ".join(w))
    rows += [" ".join(passage + [f"u{d}x{i}" for i in range(rng.randint(5, 60))]) for d in range(60)]
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in JJ.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shingle=k, percent=percent).collect()}
    assert got == brute_components(rows, k, percent)


@pytest.mark.parametrize(("k", "percent", "levels"), [(4, 85, 6), (5, 80, 1)])
def test_many_near_copies_that_do_not_link(spark, monkeypatch, k, percent, levels):
    """Copies of two texts with so many edits that most link with no other, some of them edited alike, over buckets that are large."""
    monkeypatch.setattr(JJ, "SMALL_BUCKET", 4)
    monkeypatch.setattr(JJ, "PARTNERS", 0)
    monkeypatch.setattr(JJ, "LEVELS", levels)
    rng = random.Random(levels + k)
    inserts = [[f"i{g}x{j}" for j in range(6)] for g in range(8)]
    rows = []
    for g in range(2):
        base = [f"b{g}w{i}" for i in range(120)]
        for _ in range(110):
            w = list(base)
            for _ in range(rng.choice((1, 2, 3, 3, 4, 4, 5))):
                at = rng.randrange(len(w))
                if rng.random() < 0.4:  # the same edit in many copies
                    w[at // 20 * 20 : at // 20 * 20 + 3] = rng.choice(inserts)
                elif rng.random() < 0.3:
                    del w[at : at + 3]
                else:
                    w[at] = f"e{rng.randrange(40)}"
            rows.append(" ".join(w))
    rows = list(enumerate(rows))
    want = brute_components(rows, k, percent)
    assert 20 < len({c for _, c in want.values()}) < len(rows) - 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in JJ.grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shingle=k, percent=percent).collect()}
    assert got == want


def test_near_copies_odd(odd, empty):
    out = JJ.join(odd).collect()
    assert len(out) == odd.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got[0] == (0, 0) and got[5] == (1, 5) and got[9] == (1, 5) and got[10] == (1, 5) and got[None] == (1, None)
    kept = JJ.keep_one(odd)
    assert kept.columns == odd.columns and {5} == {r.doc_id for r in kept.collect()} & {5, 9, 10}
    assert JJ.join(empty).count() == 0 and JJ.keep_one(empty).count() == 0


def brute_links(rows, k, percent):
    """Links of each document's set with other sets."""
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    different = set(sets.values()) - {frozenset()}
    return {i: sum(100 * len(s & x) >= percent * len(s | x) for x in different if x != s) if s else 0 for i, s in sets.items()}


@pytest.mark.parametrize("block_rows", [JJ.BLOCK_ROWS, 16])
def test_every_link_is_counted(spark, block_rows):
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(200)], []
    for _ in range(120):  # near copies of one text, some of them linked only through others
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        rows.append(" ".join(w))
    rows += [" ".join([f"s{i + shift}" for i in range(40)]) for shift in range(12)] + ["", "alone", "two words", "two words"]
    rows = list(enumerate(rows))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_links(rows, 4, 85)
    assert max(want.values()) > 60
    got = JJ.join(table.unionByName(table.limit(30)).repartition(5), block_rows=block_rows).collect()
    assert len(got) == len(rows) + 30 and {r.doc_id: r.n_links for r in got} == want
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 85)


def test_prefix_lengths():
    n = np.arange(1, 5000)
    for p in (80, 85):
        ell = JJ.spare(n, p)
        assert (np.diff(ell) >= 0).all() and (ell >= 0).all() and (JJ.struck(n, p) <= ell).all()
        assert (JJ.allowed_misses(n, p) + 1 + ell <= n).all()


# ---------------------------------------------------------------- 6


def test_toxicity(spark, odd, empty):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = TX.fit(docs, labels)
    got = TX.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    pos = got.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.97 and (got.predicted == got.toxic).mean() > 0.96
    out = TX.score(odd, model)
    assert out.count() == odd.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert TX.score(empty, model).count() == 0
    none = TX.fit(odd, labels.limit(0))
    assert {round(r.score, 6) for r in TX.score(odd, none).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, None, None), (1, None, None)], "doc_id long, quality int, toxic int")
    assert len(TX.fit(odd, nulls).keys) == 0


def test_scores_against_brute_force(spark):
    """The score of each text from its inputs, by the sum over pairs."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = TX.fit(docs, labels)
    rows = [r for r in docs.select("doc_id", "text").collect() if r.text is not None][:120]
    got = {r.doc_id: r.score for r in TX.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    at = {int(k): i for i, k in enumerate(model.keys)}
    far = 0
    for r in rows:
        b = r.text.encode()
        terms, _ = TX._terms(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        inputs, _ = TX._levels(*np.unique(terms, return_counts=True))
        own = [at[int(i)] for i in inputs if int(i) in at]
        z = model.b + sum(model.w[i] for i in own) + sum(float(model.v[i] @ model.v[j]) for i, j in itertools.combinations(own, 2))
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-5)
        far += len(own) > 1
    assert far > 10


def test_repeated_labelled_rows(spark):
    docs = spark.createDataFrame([(k, f"text {k % 7} here") for k in range(60)], "doc_id long, text string")
    hot = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(2000)).select("doc_id", "text"))
    labels = spark.createDataFrame([(k, 0, int(k % 7 == 3)) for k in range(60)], "doc_id long, quality int, toxic int")
    assert TX.fit(hot, labels).b == pytest.approx(TX.fit(docs, labels).b)


def test_pairs_tell_what_words_do_not():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique(np.concatenate([rng.integers(10, 60, 6), [1] if a else [], [2] if b else []])).astype(np.uint64) * np.uint64(4))
        y.append(float(a == b))
    m = TX.Model(rows, np.array(y), 0.5, epochs=80)
    at = {int(k) // 4: i for i, k in enumerate(m.keys)}
    assert 1 in at and 2 in at and m.v[at[1]] @ m.v[at[2]] > 0.5


def test_pair_among_many_neutral_inputs():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(2400):
        a, b = i % 2, i // 2 % 2  # as common in either class, each alone
        rows.append(np.unique(np.concatenate([rng.integers(10, 20_010, 80), [1] if a else [], [2] if b else []])).astype(np.uint64) * np.uint64(4))
        y.append(float(a == b))
    keys, seen = np.unique(np.concatenate(rows), return_counts=True)
    assert (seen >= 5).sum() > 15_000
    m = TX.Model(rows, np.array(y), 0.5)
    at = {int(k) // 4: i for i, k in enumerate(m.keys)}
    assert 1 in at and 2 in at and m.v[at[1]] @ m.v[at[2]] > 0.5


# ---------------------------------------------------------------- 7


def test_revisits(spark):
    schema = "record_id long, kind string, url string, at long, status int, headers map<string,string>, digest string, length long, bucket int, r string"
    r = lambda i, k, u, t, h=None, d=None, s=None: (i, k, u, t, s or (200 if k == "response" else 304), h, d, 5, 0, "x")
    rows = [
        r(1, "response", "http://A.com:80/x/?utm_source=q&b=2&a=1#f", 10, {"etag": '"v1"', "date": "d1", "content-type": "t"}, "D1"),
        r(2, "response", "https://www.a.com/x?a=1&b=2", 20_000, {"etag": 'W/"v2"', "date": "d2"}, "D2"),
        r(3, "revisit", "http://a.com/x?b=2&a=1", 15_000, {"etag": 'W/"v1"', "date": "new", "content-type": "no"}),
        r(4, "revisit", "http://a.com/x?b=2&a=1", 30_000, {"etag": '"v1"'}),
        r(5, "revisit", "http://a.com/x?b=2&a=1", 30_000, None, "D2"),
        r(6, "revisit", "http://a.com/x?b=2&a=1", 20_000),
        r(7, "revisit", "http://a.com/other", 20_000),
        r(8, "revisit", None, 5), r(9, "revisit", "", 5), r(10, "revisit", "http://a.com/x?a=1&b=2", None),
        r(11, "response", "http://a.com/other", 25_000, None, "late"), r(12, "response", "http://a.com/other", 1, None, "err", 500),
    ]
    records = spark.createDataFrame(rows, schema)
    got = {x.record_id: x for x in WR.resolve(records.unionByName(records.where("record_id = 1"))).collect()}
    assert {k: (v.outcome, v.response_id) for k, v in got.items()} == {
        3: ("etag", 1), 4: ("mismatch", None), 5: ("digest", 2), 6: ("unverified", 2), 7: ("no_prior", None), 8: ("no_url", None), 9: ("no_url", None), 10: ("no_time", None)
    }
    assert got[3].headers == {"etag": 'W/"v1"', "date": "new", "content-type": "t"} and got[3].url == "a.com/x?a=1&b=2"
    assert WR.resolve(records.limit(0)).count() == 0


def test_revisits_that_share_an_id_and_hot_responses(spark):
    schema = "record_id long, kind string, url string, at long, status int, headers map<string,string>, digest string, length long, near string, far string, u string, spread long, headers_ string"
    row = lambda i, k, u, t, d, h=None: (i, k, u, t, 200 if k == "response" else 304, h, d, 5, None, None, None, None, "x" * 9)
    rows = [row(1, "response", "http://a.com/x", 10, "DX"), row(2, "response", "http://a.com/y", 20, "DY")]
    rows += [row(7, "revisit", "http://a.com/x", 5000, "DX"), row(7, "revisit", "http://a.com/y", 5000, "DY"), row(7, "revisit", "http://a.com/y", 9000, "DX"), row(None, "revisit", "http://a.com/y", 9000, "DY")]
    rows += [row(100 + k, "revisit", "http://hot.com/p" if k % 2 else "http://cold.com/p", 50_000 + k, "H") for k in range(600)] + [row(3, "response", "http://hot.com/p", 1, "H")]
    got = WR.resolve(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 604
    assert sorted((r.record_id or 0, r.url, r.at, r.outcome, r.response_id) for r in got if (r.record_id or 0) < 100) == [
        (0, "a.com/y", 9000, "digest", 2), (7, "a.com/x", 5000, "digest", 1), (7, "a.com/y", 5000, "digest", 2), (7, "a.com/y", 9000, "mismatch", None)
    ]
    assert {(r.url, r.outcome, r.response_id) for r in got if (r.record_id or 0) >= 100} == {("hot.com/p", "digest", 3), ("cold.com/p", "no_prior", None)}


def test_revisits_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice(("response", "revisit")), f"http://h{rng.randrange(4)}.org/p", rng.randrange(20_000), None, None, f"D{rng.randrange(3)}", 1) for k in range(400)]
    rows = [(*r[:4], 200 if r[1] == "response" else 304, *r[5:]) for r in rows]
    got = {r.record_id: (r.outcome, r.response_id) for r in WR.resolve(spark.createDataFrame(rows, "record_id long, kind string, url string, at long, status int, headers map<string,string>, digest string, length long")).collect()}
    for r in rows:
        if r[1] == "revisit":
            before = [x for x in rows if x[1] == "response" and x[2] == r[2] and (x[3], x[0]) < (r[3], r[0])]
            last = max(before, key=lambda x: (x[3], x[0])) if before else None
            want = ("no_prior", None) if last is None else ("digest", last[0]) if last[6] == r[6] else ("mismatch", None)
            assert got[r[0]] == want


def test_warc_files(spark, tmp_path):
    def record(kind, n, date, http, extra=""):
        body = http.replace("\n", "\r\n")
        head = f"WARC/1.0\nWARC-Type: {kind}\nWARC-Record-ID: <urn:uuid:{n}>\nWARC-Target-URI: http://Site.org/page\nWARC-Date: {date}\n{extra}Content-Length: {len(body)}\n\n"
        return head.replace("\n", "\r\n") + body + "\r\n\r\n"

    (tmp_path / "a.warc").write_text(
        record("warcinfo", 0, "2024-01-01T00:00:00Z", "software: x\n") + record("request", 1, "2024-01-01T00:00:00Z", "GET /page HTTP/1.1\nHost: Site.org\n\n")
        + record("response", 2, "2024-01-01T00:00:00Z", 'HTTP/1.1 200 OK\nETag: "v1"\nContent-Type: text/html\n\n<p>text\n\nmore: text</p>', "WARC-Payload-Digest: sha1:AAA\n")
        + record("revisit", 3, "2024-01-02T00:00:00Z", 'HTTP/1.1 304 Not Modified\nETag: W/"v1"\nDate: later\nDate: again\n\n', "WARC-Payload-Digest: sha1:AAA\n"),
        newline="",
    )
    records = WR.read_warc(spark, str(tmp_path / "a.warc"))
    assert sorted((r.kind, r.status, r.at, r.digest) for r in records.collect()) == [("response", 200, 1704067200, "sha1:AAA"), ("revisit", 304, 1704153600, "sha1:AAA")]
    got = WR.resolve(records).collect()
    assert [(r.outcome, r.url, r.digest) for r in got] == [("etag", "site.org/page", "sha1:AAA")] and got[0].headers == {"etag": 'W/"v1"', "content-type": "text/html", "date": "later"}


# ---------------------------------------------------------------- 8


def brute_capacity(sizes, shards):
    best = None
    for cut in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        edges = [0, *cut, len(sizes)]
        worst = max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:]))
        best = worst if best is None else min(best, worst)
    return best


def test_capacity():
    rng = random.Random(2)
    for _ in range(60):
        sizes = np.array([rng.randint(1, 30) for _ in range(rng.randint(1, 9))], np.int64)
        shards = rng.randint(1, 4)
        c = MS.capacity(sizes, shards)
        assert c == brute_capacity(sizes.tolist(), shards)
        ends = MS.cuts(sizes, shards)
        assert len(ends) == shards and ends == sorted(ends) and ends[-1] == len(sizes)
        assert max(sizes[a:b].sum() for a, b in zip([0, *ends], ends)) == c or max(sizes[a:b].sum() for a, b in zip([0, *ends], ends)) <= c
    assert MS.cuts(np.empty(0, np.int64), 3) == [0, 0, 0]


def test_capacity_of_groups_inside_units():
    rng = random.Random(8)
    for turn in range(300):
        groups = np.array([rng.randint(1, 30) if rng.random() < 0.9 else rng.randint(100, 300) for _ in range(rng.randint(1, 60))], np.int64)
        unit = np.sort([rng.randrange(12) for _ in groups])
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        many = np.diff(np.append(first, len(groups)))

        def look(keys):
            own = np.concatenate([np.arange(k, k + many[first.tolist().index(k)]) for k in keys])
            return own, groups[own]

        shards = rng.randint(1, 6)
        keys, sizes = MS.refined(first, np.add.reduceat(groups, first), many == 1, shards, look, probes=1 + turn % 4)
        assert sizes.sum() == groups.sum() and MS.capacity(sizes, shards) == MS.capacity(groups, shards)


def test_shards_against_brute_force(spark, docs):
    """The capacity over all groups in their order, whatever the units; the cuts keep under it."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).toPandas()
    rows["size"] = [len((t or "").encode()) + 16 for t in rows.text]
    groups = rows.groupby("h")["size"].sum().sort_index()
    for shards, bits in ((40, 20), (40, 3), (7, 1), (3, 20)):
        got = MS.assign(docs, shards=shards, unit_bits=bits).toPandas().merge(rows[["doc_id", "h"]], on="doc_id")
        loads = got.groupby("shard")["size"].sum()
        want = MS.capacity(groups.to_numpy(), shards)
        assert loads.max() <= want and (loads.max() == want or MS.feasible(groups.to_numpy(), int(loads.max()), shards))
        assert got.groupby("h").shard.nunique().max() == 1
        order = got.drop_duplicates("h").sort_values("h").shard.to_list()
        assert order == sorted(order)
    few = spark.createDataFrame([(k, "x" * (k * 7 % 11) + str(k % 9)) for k in range(14)], "doc_id long, text string")
    sizes = few.select((F.length("text") + 16).alias("n"), F.xxhash64("text").alias("h")).groupBy("h").agg(F.sum("n").alias("n")).orderBy("h").toPandas().n.tolist()
    for bits in (1, 2, 20):
        assert MS.assign(few, shards=3, unit_bits=bits).groupBy("shard").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] <= brute_capacity(sizes, 3)


def test_shards(spark, docs, odd, empty):
    for d in (docs, odd):
        got = MS.assign(d).join(d.select("doc_id", "text").distinct(), "doc_id", "left").collect()
        plain = MS.assign(d).collect()
        assert len(plain) == d.count() and all(0 <= r.shard < 40 and r.grown_shard is None and r.law == "bytes" for r in plain)
        for s in {r.shard for r in plain}:
            assert sorted(r.slot for r in plain if r.shard == s) == list(range(sum(r.shard == s for r in plain)))
        where = {}
        for r in got:
            where.setdefault(r.text or "", set()).add(r.shard)
        if d is docs:
            assert all(len(x) == 1 for x in where.values())
            assert all(r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    assert MS.assign(empty).count() == 0


# ---------------------------------------------------------------- 9


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(1, LONG[:200]), (2, "One two THREE"), (3, None), (4, "!!"), (5, "word"), (5, "word")], "item_id long, text string")
    one = DC.report(DC.scan(odd, bench)).collect()
    got = {r.doc_id: r for r in one}
    assert len(one) == odd.count() and {k for k, r in got.items() if r.contaminated} == {4, 5, 7, 9, 10}
    assert got[5].n_hit == 3 and got[10].items_sha256 == DC.items_digest(["2"]) and got[0].items_sha256 == DC.items_digest([])
    # several blocks, over repeated rows and null ids
    more = odd.unionByName(odd.where("doc_id IN (5, 7, 9)").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.where("doc_id = 7"))
    for most in (1, 40):
        same(DC.report(DC.scan(more, bench, max_broadcast_windows=most)).toPandas(), DC.report(DC.scan(more, bench)).toPandas())
        for mode in ("document", "span"):
            blocks = DC.decontaminate(more, bench, mode=mode, max_broadcast_windows=most)
            assert blocks.columns == more.columns and blocks.exceptAll(DC.decontaminate(more, bench, mode=mode)).count() == 0
            assert blocks.count() == (more.count() if mode == "span" else DC.decontaminate(more, bench).count())
    named = odd.withColumnsRenamed({"words": "b", "n": "__key", "items": "key", "t": "cut"})
    for most in (1, 1000):
        out = DC.decontaminate(named, bench, mode="span", max_broadcast_windows=most)
        assert out.columns == named.columns and {(r["b"], r["__key"], r["key"], r["cut"]) for r in out.collect()} == {("w", "n", "i", "t"), (None,) * 4}
    clean = DC.decontaminate(odd, bench)
    assert clean.columns == odd.columns and not {4, 5, 7, 9, 10} & {r.doc_id for r in clean.collect()} and clean.count() == odd.count() - 6
    cut = {r.doc_id: r.text for r in DC.decontaminate(odd, bench, mode="span").collect()}
    assert cut[5] == "" and cut[3] == "123 456 !!"
    assert DC.report(DC.scan(DC.decontaminate(odd, bench, mode="span"), bench)).where("contaminated").count() == 0
    assert DC.scan(empty, bench).count() == 0 and DC.report(DC.scan(odd, bench.limit(0))).where("contaminated").count() == 0
    with pytest.raises(ValueError):
        DC.decontaminate(odd, bench, mode="other")


# ---------------------------------------------------------------- 10


HELD_OUT = ("You may use and share this file under the {}.", "Made available by its authors under the conditions of the {}.", "The code in this folder is covered by the {} unless stated otherwise.")


def test_licences(spark, docs, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = LS.fit(d)
    found = LS.scan(d, model)
    flagged = LS.report(found).join(d, "doc_id")
    named = {"MIT License": "mit", "Apache License": "apache-2.0", "GNU General": "gpl", "CC BY-NC": "cc"}
    for words, family in named.items():
        has = flagged.where(F.col("text").contains(words))
        assert has.count() and has.where(~F.col("families").contains(family)).count() == 0
    assert flagged.where("families != ''").where(~F.col("text").rlike("(?i)licen|rights reserved|copyright")).count() == 0
    out = LS.report(LS.scan(odd, model))
    assert out.count() == odd.count() and out.where("n_confirmed > 0").count() == 0
    assert LS.report(LS.scan(empty, model)).count() == 0 and LS.report(LS.scan(odd, LS.fit(empty))).count() == odd.count()


def test_every_paragraph_against_the_model(spark, docs):
    """Gate, line by line work, probabilities and confirmation of all paragraphs, flagged or not."""
    model = LS.fit(docs)
    extra = [(10**6 + k, t) for k, t in enumerate([*LS.LOOK_ALIKES, *(p for own in LS.PASSAGES.values() for p in own), "\n".join(f.format(n) for f in HELD_OUT for own in LS.NAMES.values() for n in own)])]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(200).collect()] + extra
    got = {r.doc_id: [(p.line, p.family, round(p.probability, 6), p.confirmed) for p in r.paragraphs] for r in LS.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        want = []
        for n, line in enumerate((text or "").split("\n"), 1):
            own = model.probabilities(line)
            best = max(own, key=own.get)
            if best != LS.UNKNOWN and own[best] >= LS.MIN_PROBABILITY:
                want.append((n, best, round(own[best], 6), any(LS.covers(set(LS.words(line)), set(t)) for t in model.notices[best])))
        assert got[i] == want


def test_unseen_licence_wordings():
    """Recall over wordings that were not learned, whole passages left out, and a family left out."""
    model = LS.Model([], {}, 0)
    unseen = [(f, w.format(n)) for f, own in LS.NAMES.items() for n in own for w in HELD_OUT]
    right = [f for f, p in unseen if max(model.probabilities(p).items(), key=lambda x: x[1])[0] == f]
    assert len(right) / len(unseen) >= 0.9
    best = lambda m, p: max(m.probabilities(p).items(), key=lambda x: x[1])[0]
    assert sum(best(model, x) != LS.UNKNOWN for x in LS.LOOK_ALIKES) <= 0.1 * len(LS.LOOK_ALIKES)
    told = [(x, best(model, x)) for x in LS.LOOK_ALIKES]
    assert not any(f != LS.UNKNOWN and any(LS.covers(set(LS.words(x)), set(t)) for t in model.notices[f]) for x, f in told)
    rng = random.Random(10)
    cut = []
    for f, own in LS.PASSAGES.items():  # two thirds of a passage, as a line break or an editor may leave it
        for p in own:
            w = p.split()
            if len(w) >= 9:
                at = rng.randrange(len(w) - 2 * len(w) // 3 + 1)
                cut.append(best(model, " ".join(w[at : at + 2 * len(w) // 3])) == f)
    assert sum(cut) / len(cut) >= 0.9
    others = tuple(f for f in LS.PASSAGES if f != "mpl")
    m = LS.Model([], {}, 0, LS.notices(others), rounds=150)
    for name in LS.NAMES["mpl"]:
        f = best(m, f"Distributed under the {name}.")
        assert f == LS.UNKNOWN or not any(LS.covers(set(LS.words(f"Distributed under the {name}.")), set(t)) for t in m.notices[f])


def test_licence_sample_is_bounded(spark):
    copies = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one line\nanother line\n" + "a long line " * 900).alias("text"))
    seen = []

    class Spy(LS.Model):
        def __init__(self, negatives, counts, lines, rows=None, **o):
            seen.append(negatives)

    real, LS.Model = LS.Model, Spy
    try:
        LS.fit(copies, negative_rows=50)
        LS.fit(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("line a"), F.col("id").cast("string")).alias("text")), negative_rows=50)
    finally:
        LS.Model = real
    assert len(seen[0]) in (0, 3) and all(len(x) <= 50 for x in seen)


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "jaccard_join", "decontamination", "piece_encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for n, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        out.write.parquet(str(tmp_path / n))
        out = spark.read.parquet(str(tmp_path / n))
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
        docs = out
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(i == root for i, (_, root) in brute_components(rows, 5, 80).items())
    assert not any(re.sub(r"\W+", " ", b.lower()) in re.sub(r"\W+", " ", t.lower()) for b in bench for _, t in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("NOT exact").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(i for i, _ in rows)


@pytest.mark.parametrize("stage", range(4))
def test_stage_keeps_columns(spark, odd, empty, stage):
    import corpus_pipeline

    for d in (odd, empty):
        out = corpus_pipeline.STAGES[stage][1](spark, d, SF)
        assert out.columns == d.columns and out.count() <= d.count()
