"""Each operator against a brute-force version, an exact round trip, or held-out labels; and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate, jaccard, licenses, linededup, passages, pieces, pii, quality, queries, shingles, tokenbin, toxicity
from factloom.llm.components import components
from factloom.llm.wordmemo import ByteBpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th long, keep string, p string"
LONG = " ".join(f"w{k}" for k in range(40_000))


def awkward(spark, texts):
    """Nulls in every column, repeated rows, equal ids, and columns whose names operators might use themselves."""
    rows = [(k, t, "en", "s", len(t or ""), 1, "x", "y") for k, t in enumerate(texts)]
    rows += [(None, "null id", None, None, None, None, None, None), (0, None, None, "s", None, 3, None, None), (1, texts[1], "en", "s", 0, 1, "x", "y"), (1, texts[1], "en", "s", 0, 1, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


TEXTS = ["", "one", " \n\t\n ", "a b c d e f g h\na b c d e f g h\n", "Ünïcode wörds ñ 日本 \U0001d11e\n\nx", LONG, "mail me at a.b@c.org or +1 (222) 333-4444 now"]


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- lines

def lines_by_hand(rows, least, keep_first=False, chars=1):
    """rows: (doc_id, text); documents are told apart by id and text."""
    where = defaultdict(set)
    first = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], r[1])):
        for k, line in enumerate(t.split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            where[key].add((d, t))
    gone = {k for k, v in where.items() if len(v) >= least and len(k) >= chars}
    return gone, first


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines(spark, keep_first):
    r = random.Random(1)
    rows = [(k, "\n".join(r.choice(["Hot", " hot ", "x%d" % r.randint(0, 60), "", "É"]) for _ in range(r.randint(0, 8)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(df, 10, keep_first).collect()}
    gone, _ = lines_by_hand(rows, 10)
    norm = lambda line: line.strip().lower() if line.isascii() else line
    left = Counter(norm(x) for t in got.values() for x in t.split("\n"))
    for d, t in rows:
        kept = [x for x in t.split("\n") if norm(x) not in gone]
        if not keep_first:
            assert got[d] == "\n".join(kept)
    if keep_first:
        assert gone and all(left[k] == 1 for k in gone)
        assert sum(left.values()) - left[""] == sum(1 for _, t in rows for x in t.split("\n") if norm(x) not in gone and norm(x)) + len(gone)


def test_lines_awkward(docs, none):
    out = linededup.dedup_lines(docs, 2)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert linededup.dedup_lines(none, 2).count() == 0
    texts = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (0, None) in texts and (5, LONG) in texts


def test_bitmap():
    keep = np.random.default_rng(0).random(1001) < 0.5
    assert (linededup.unpack(linededup.pack(keep), 1001) == keep).all()


def test_streamed_runs_over_partitions(spark):
    """A hash with a third of all lines, over many partitions, is decided like any other."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id"))).alias("text"))
        out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df, 10).collect()}
        assert all((t == "") == (d % 3 == 0) for d, t in out.items())
        first = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df, 10, keep_first=True).collect()}
        assert [d for d, t in first.items() if t == "hot"] == [0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- token files

ODD = ["", " ", "  a", "a  ", "a   b", " \n a", "a \n  b", "\n\n x", "x \n", "<|endoftext|> a", "it's  'll", "\x1c \x1c a", "​ a", "日本 語", "a  b"]


def test_word_by_word_equals_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, r = Tokenizer.from_file(path), random.Random(3)
    texts = ODD + ["".join(r.choice([" ", "  ", "\n", "ab", "Ü9", "'s", "\t", "é", ".", "ç"]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    got = ByteBpe(path, most=12_000)(texts)
    assert got == [np.asarray(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [False, True])
def test_shards(tmp_path, bits):
    import io

    from pyarrow import fs

    g = np.random.default_rng(1)
    docs = [g.integers(0, 50_000, n).astype("<u4") for n in (0, 1, 100, 9000, 0, 3)]
    with open(tmp_path / "s", "wb") as f:
        w = tokenbin.ShardWriter(f, bits, 256)
        for d in docs:
            w.add(d.tobytes(), [len(d)])
        assert w.close() == (6, 9104)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "s")) as f:
        r = tokenbin.ShardReader(f, 256)
        assert [x for x in r.documents()] == [d.tobytes() for d in docs]
        assert (r.ids(3) == np.concatenate(docs)[768:1024]).all()
    with pytest.raises(ValueError), fs.LocalFileSystem().open_input_file(__file__) as f:
        tokenbin.ShardReader(f)
    assert io is not None


def test_byte_memo_holds_the_words_of_a_corpus():
    """Words that come again after 300,000 others aren't encoded again."""
    e = ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    letters = "abcdefghij"
    texts = [" ".join(["", *("q" + "".join(letters[int(d)] for d in f"{k:06d}") for k in range(lo, lo + 1000))]) for lo in range(0, 350_000, 1000)]
    first = e(texts)
    fill, filled = e.memo.fill, []
    e.memo.fill = lambda word: filled.append(word) or fill(word)
    assert e(texts) == first and not filled


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = tokenbin.read_tokens(tokenbin.write_tokens(docs, path)).orderBy("start").collect()
    assert len(got) == docs.count()
    start = 0
    want = Counter()
    for r in docs.collect():
        ids = np.asarray([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want[r["doc_id"], len(ids) // 4, zlib.crc32(ids)] += 1
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert tokenbin.read_tokens(tokenbin.write_tokens(none, path)).count() == 0
    large = [None, 2**53 + 1, 2**53 + 3, -(2**62) - 1]
    odd = docs.sparkSession.createDataFrame([(k, "a b") for k in large], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in tokenbin.read_tokens(tokenbin.write_tokens(odd, path)).collect()} == set(large)


# --- pieces

PIECE = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library_without_dropout():
    import sentencepiece

    lib, r = sentencepiece.SentencePieceProcessor(model_file=PIECE), random.Random(2)
    e = pieces.Encoder(PIECE, 0.0, 2)
    texts = ["", " ", "  a", "a  b", "é日本\n\t", "a" * 200] + ["".join(r.choice(["a", " ", "  ", "the", "\n", "é", "ing", "0", "\U0001d11e"]) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    for t, ids in zip(texts, e(texts, [0] * len(texts)), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == lib.encode(t)
        assert e.decode(ids) == t


def test_dropout_is_lossless_varied_and_repeatable():
    e, again, other = pieces.Encoder(PIECE, 0.3, 2), pieces.Encoder(PIECE, 0.3, 2, kept=10), pieces.Encoder(PIECE, 0.3, 3)
    text = " ".join(["tokenization ▁ of words, étudiées internationalization_of_everything \u4e00\u9fff"] * 200)
    a, b = e([text, text], [1, 2])
    assert a != b and e.decode(a) == e.decode(b) == text
    assert again(["warm words"], [5]) and again([text], [1]) == [a] and other([text], [1]) != [a]
    plain = pieces.Encoder(PIECE, 0.0, 2)([text], [1])[0]
    assert len(a) > len(plain)
    every = pieces.Encoder(PIECE, 1.0, 2)(["abc"], [1])[0]
    assert len(every) // 4 == 4


def test_each_occurrence_draws_anew():
    """A word of one merge is split in p of its occurrences, and a longer one takes as many forms as its merges allow."""
    e = pieces.Encoder(PIECE, 0.1, 2)
    one = next(p for p in (x.replace(pieces.SPACE, " ") for x in e.model.ids) if len(p) == 2 and p[0] == " " and p[1].isalpha())
    n = 20_000
    ids = np.frombuffer(e([one[1:] + one * (n - 1)], [1])[0], "<i4")
    whole = int((ids == e.model.ids[pieces.SPACE + one[1:]]).sum())
    assert abs(whole / n - 0.9) < 0.01 and len(ids) == 2 * n - whole
    forms = {e([w], [k])[0] for k in range(3000) for w in ["international"]}
    assert len(forms) > 30


def test_memo_equals_heap():
    """The trie of skipped steps, the matrix and the heap agree, occurrence by occurrence."""
    r = random.Random(4)
    e = pieces.Encoder(PIECE, 0.2, 7)
    parts = [" " + "".join(r.choice("aeinrstlthé.") for _ in range(r.randint(1, 60))) for _ in range(800)] + [" the", " token"] * 400
    occurrence = np.arange(len(parts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    want = [pieces.agenda(e.model, e.model.symbols(x), o, 0.2) for x, o in zip(parts, occurrence.tolist(), strict=True)]
    ids, at, n, steps = e.merged(parts, occurrence)
    assert [ids[a : a + m].tolist() for a, m in zip(at, n, strict=True)] == want
    assert all(len(x) > pieces.WIDE or t <= 3 * (len(x) - 1) for x, t in zip(parts, steps, strict=True))
    short = [k for k, x in enumerate(parts) if len(x) <= pieces.NARROW]
    root, count, long = e._numbered([parts[k] for k in short])
    own = np.repeat(np.arange(len(short)), count)
    assert not long
    node = e._walk(root[count[own] == 1], occurrence[short][own][count[own] == 1])
    got = [e.arena[e.at[k] : e.at[k] + e.size[k]].tolist() for k in node]
    assert got == [want[short[i]] for i in own[count[own] == 1]]


def test_words_that_come_once_stay_out_of_the_memo():
    e, every = pieces.Encoder(PIECE, 0.1, 2), pieces.Encoder(PIECE, 0.1, 2)
    numbered = every._numbered
    every._numbered = lambda words, new_too: numbered(words)
    r = random.Random(6)
    once = " ".join("".join(r.choice("aeinrstlthé") for _ in range(9)) + ".,"[k % 2] for k in range(3000))
    assert e([once], [1]) == every([once], [1])
    assert e.held < every.held / 20
    # From the second time on they are in the memo; the pieces are the same either way.
    assert e([once], [2]) == every([once], [2]) and e.held > every.held / 2
    assert e([once, once], [3, 1]) == every([once, once], [3, 1])


def test_pieces_awkward(docs, none):
    x = docs.withColumn("ids", pieces.encode(F.col("text"), F.col("doc_id"), PIECE))
    back = x.withColumn("back", pieces.decode(F.col("ids"), PIECE))
    assert back.filter(~F.col("back").eqNullSafe(F.col("text"))).count() == 0
    assert back.filter("text = '' AND size(ids) <> 0").count() == 0
    assert none.withColumn("ids", pieces.encode(F.col("text"), F.col("doc_id"), PIECE)).count() == 0


# --- quality

def base_by_hand(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    rep = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def test_quality_base(spark, docs, none):
    r = random.Random(5)
    texts = TEXTS + [" ".join(r.choice(["a", "b", "#", "c|d", "\n", "é"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for row in quality.measures(df).collect():
        assert tuple(row[c] for c in cols) == base_by_hand(texts[row["doc_id"]]), texts[row["doc_id"]][:80]
    labels = spark.createDataFrame([(1, 1, None), (None, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels)
    assert out.count() == docs.count() and out.filter("kept AND base_failed").count() == 0
    assert quality.judge(none, labels).count() == 0


def test_binomial_bound(spark):
    from math import comb, log

    df = spark.createDataFrame([(n, k) for n in (1, 50, 700, 3000) for k in (0, 1, 5, 20) if k <= n], "n long, k long")
    for r in df.select("n", "k", quality.log_binomial_cdf(F.col("n"), F.col("k"), 0.02).alias("x")).collect():
        if r["k"] < r["n"] * 0.02:
            assert r["x"] == pytest.approx(log(sum(comb(r["n"], j) * 0.02**j * 0.98 ** (r["n"] - j) for j in range(r["k"] + 1))), abs=1e-9)
        else:
            assert r["x"] == 0


def test_quality_cutoffs_keep_the_risk(spark):
    """Junk full of symbols goes where labels suffice; good texts stay within the risk; a small stratum has no rule."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(3000):
        junk = k % 5 == 0
        rows.append((k, " ".join(word() + ("***" if junk else "") for _ in range(40)), "fr" if k % 100 == 7 else "en", int(not junk)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    out = quality.judge(df.drop("quality"), df.select("doc_id", "quality")).join(df.select("doc_id", "quality"), "doc_id").collect()
    good = [x for x in out if x["quality"] == 1]
    assert sum(not x["kept"] for x in good) <= quality.ALPHA * len(good)
    assert not any(x["kept"] for x in out if x["quality"] == 0 and x["lang"] == "en")
    assert all(x["kept"] for x in out if x["lang"] == "fr")


# --- toxicity

def test_toxicity(spark, docs, none):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7)))
    rows = []
    for k in range(500):
        toxic = k % 5 == 0
        ws = [word() for _ in range(r.randint(20, 80))]
        if toxic:
            ws[r.randrange(len(ws))] = r.choice(["Scumbag", "wretch", "vermin"])
            ws[r.randrange(len(ws))] = r.choice(["scumbags", "Wretched", "vermins"])
        rows.append((k, " ".join(ws), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(df.select("doc_id", "text"), labels)
    out = df.select("toxic", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.score(F.col("text"), model).alias("s")).filter("h").collect()
    assert len(out) > 80
    right = sum((x["s"] >= toxicity.THRESHOLD) == bool(x["toxic"]) for x in out)
    assert right >= 0.95 * len(out)
    scored = docs.withColumn("score", toxicity.score(F.col("text"), model)).collect()
    assert all(0 <= x["score"] <= 1 for x in scored) and scored[0]["score"] == scored[len(TEXTS) + 1]["score"]
    assert toxicity.train(docs, labels.limit(0)).scores(["x"])[0] < 1e-9
    assert none.withColumn("score", toxicity.score(F.col("text"), model)).count() == 0
    again = toxicity.train(df.select("doc_id", "text").orderBy(F.desc("doc_id")), labels)
    assert (again.buckets == model.buckets).all() and np.allclose(again.weights, model.weights)


# --- personal data

def base_spans_by_hand(t):
    out = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in pii.IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in pii.CARD.finditer(t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    r = random.Random(8)
    for _ in range(20_000):
        t = "".join(r.choice("a1@.b2-+ ()3%é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == base_spans_by_hand(t), t
    assert pii.base_spans("x" * 1000 + "@y.z") == [(0, 0, 1004)]


@pytest.mark.parametrize("part", ["@ ", "a", "1", "1.", "+1 ", "a@", "a.b@c.", "1.2.3.4.", "-", "4 4", "+1("])
def test_hostile_texts(part):
    """Long texts without an end of a candidate in sight take time in proportion, and give what the patterns give."""
    import time

    text = "x " + part * 300 + "@b.cd 1.2.3.4"
    assert pii.base_spans(text) == base_spans_by_hand(text)
    t = time.thread_time()
    pii.base_spans(part * 40_000)
    list(pii.candidates(part * 4_000))
    assert time.thread_time() - t < 8


#: Sentences that the generator of the training examples didn't write, with what is to be found beside the base spans.
WRITTEN = [
    ("write to john dot doe at example dot com please", ["john dot doe at example dot com"]), ("server 192[.]168[.]0[.]17 is down", ["192[.]168[.]0[.]17"]),
    ("listening on fe80::1ff:fe23:4567:890a port 22", ["fe80::1ff:fe23:4567:890a"]), ("SSN 078-05-1120 on file", []), ("meet at 10:30:15 sharp", []), ("invoice 20210304-0012345", []),
    ("my number is (212) 555-0187", ["(212) 555-0187"]), ("ratio 3.14159265 of 2,000,000", []), ("ISBN 978-3-16-148410-0", []), ("order no 12345678901", []), ("fax 030/1234567", ["030/1234567"]),
    ("mail bob [at] corp [dot] org", ["bob [at] corp [dot] org"]), ("the years 1914-1918 and 1939-1945", []), ("pages 100-200, chapter 3.1.4", []), ("call 555 at 9", []), ("std::vector of std::string", []),
    ("in 2021 there were 331,449,281 people", []), ("arXiv 2106.01234 and doi 10.1000/182", []), ("Tel. 0171 1234567", ["0171 1234567"]), ("commit 4f2a9c1e77 at line 1024", []),
]


def test_spans_of_foreign_sentences():
    model = pii.train()
    right = wrong = missed = 0
    for text, want in WRITTEN:
        got = {text[a:b] for a, _, b in model.added(text, pii.base_spans(text))}
        right += len(got & set(want))
        wrong += len(got - set(want))
        missed += len(set(want) - got)
    assert wrong <= 1 and right >= 0.85 * (right + missed)


def test_added_spans(spark, docs, none):
    model = pii.train()
    found = missed = wrong = 0
    for text, spans in pii.examples(1500, seed=77):
        base = pii.base_spans(text)
        got = set(base) | set(model.added(text, base))
        found += len(set(spans) & got)
        missed += len(set(spans) - got)
        wrong += len(got - set(spans) - set(base))
    assert found > 0.95 * (found + missed) and wrong < 0.02 * found
    text = "see +1 (314) 555-6532 4663622617512349 there"
    assert pii.base_spans(text) == [] and [text[a:b] for a, _, b in model.added(text, [])] == ["+1 (314) 555-6532", "4663622617512349"]
    assert pii.redact("call a@b.cd now", pii.base_spans("call a@b.cd now")) == "call <EMAIL> now"
    out = docs.select("doc_id", "text", pii.find(F.col("text"), model).alias("f")).collect()
    for x in out:
        base = pii.base_spans(x["text"] or "")
        assert [(s["start"], s["kind"], s["end"]) for s in x["f"]["base"]] == base
        named = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert x["f"]["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
    assert none.select(pii.find(F.col("text"), model)).count() == 0


# --- licenses

MIT = """ * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
 * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_licenses(docs, none):
    name = lambda t: licenses.apply_rules(licenses.recognise(t))
    assert name(MIT) == ["MIT"] and name("text\nReleased under the MIT Licence.\nmore") == ["MIT"]
    assert name("Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.") == ["CC-BY-NC-4.0", "Apache-2.0"]
    assert name("the license of the zoo. all rights were reserved. not released under the mit license at all") == []
    assert name("Copyright (c) 2001 Jane Doe. All rights reserved.") == ["proprietary"]
    bsd = ". ".join(licenses.SENTENCES[x][0].replace("*", "Acme Corp") for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"))
    assert name(bsd) == ["BSD-3-Clause"] and name(bsd[: bsd.index("Neither")]) == ["BSD-2-Clause"]
    # Every known sentence stands for itself.
    for ident, texts in licenses.SENTENCES.items():
        for t in texts:
            assert ident in [x[0] for x in licenses.recognise(t.replace("*", "some name"))], t
    for text in ("All rights\nreserved.", "All  rights  reserved.", "// All rights\n// reserved."):
        assert name(text) == ["proprietary"]
    assert name("This is free and unencumbered software released into the public\ndomain.") == ["Unlicense"]
    assert name("// SPDX-License-Identifier: MIT\nint x;") == ["MIT"] and name("/* SPDX-License-Identifier: (GPL-2.0-only OR Apache-2.0) */") == ["GPL-2.0-only", "Apache-2.0"]
    assert name("Copyright 2001 " + "and more holders " * 20 + "\nAll rights reserved.") == ["proprietary"]
    # What is left out for want of a trigger holds nothing, wherever lines break.
    r = random.Random(15)
    for _ in range(400):
        ws = " ".join(r.choice([t for ts in licenses.SENTENCES.values() for t in ts] + ["some words. ", "of the", "software"]).replace("*", "Jane") for _ in range(3)).split()
        text = "".join(w + r.choice([" ", " ", "  ", "\n", " \n * "]) for w in ws[r.randrange(3) :])
        assert licenses.recognise(text) == licenses.recognise(text, filtered=False)
    out = docs.select("doc_id", licenses.scan(F.col("text")).alias("s")).collect()
    assert all(x["s"]["n_known"] == 0 for x in out)
    assert none.select(licenses.scan(F.col("text"))).count() == 0


# --- decontamination

def test_edit_distances():
    r = random.Random(9)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for n in (1, 5, 12):
        item = np.asarray([r.randint(0, 4) for _ in range(n)])
        rows = np.asarray([[r.randint(0, 4) for _ in range(n)] for _ in range(50)])
        assert decontaminate.edit_distances(rows, item).tolist() == [plain(x.tolist(), item.tolist()) for x in rows]


def test_decontamination(spark, small, docs, none):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    r = random.Random(10)
    noise = [f"n{k}" for k in range(500)]
    texts, want = [], []
    for _ in range(400):
        k = r.randrange(len(items))
        w = [x.decode() for x in decontaminate.words(items[k][1])]
        for _ in range(r.randint(0, decontaminate.allowed(len(w), 0.9))):
            w[r.randrange(len(w))] = r.choice(noise)
        texts.append(" ".join(r.choices(noise, k=30) + w + r.choices(noise, k=30)))
        want.append(items[k][0])
    hits = index.hits(texts)
    assert sum(i in {h[0] for h in hs} for i, hs in zip(want, hits, strict=True)) >= 0.97 * len(texts)
    # Whatever is reported is near, exactly.
    seqs = dict(zip(index.ids, index.seqs, strict=True))
    for t, hs in zip(texts, hits, strict=True):
        ids = [index.vocabulary.get(x, 0) for x in decontaminate.words(t)]
        for i, s, n, d in hs:
            assert d == decontaminate.edit_distances(np.asarray([ids[s : s + n]]), seqs[i])[0] <= decontaminate.allowed(n, 0.8)
    assert index.hits([" ".join(r.choices(noise, k=500)), ""]) == [[], []]
    b = spark.createDataFrame([(1, None), (None, ""), (2, "one"), (3, "w7 w8 w9 w10 w11 w12 w13"), (3, "w7 w8 w9 w10 w11 w12 w13")], "item_id long, text string")
    got = decontaminate.contaminated(docs, b).filter("size(passages) > 0").collect()
    assert [x["doc_id"] for x in got] == [5] and {(p["item_id"], p["start"]) for p in got[0]["passages"]} == {(3, 7)}
    assert decontaminate.contaminated(none, b).count() == 0 and decontaminate.contaminated(docs, b.limit(0)).filter("size(passages) > 0").count() == 0
    all_items = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate.indexes(all_items, block=7))
    assert len(blocks) > 1 and sorted(x for i in blocks for x in i.ids) == sorted(index.ids)
    # Blocks one by one give what one block gives, but for what chance finds.
    few = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:60])] + [(None, None), (3, texts[3])], "doc_id long, text string")
    one, many = ({(x["doc_id"], p["item_id"], p["start"]) for x in decontaminate.contaminated(few, all_items, block=b).collect() for p in x["passages"]} for b in (1000, 15))
    assert len(one & many) >= 0.97 * len(one | many) > 40


def scanned(index, text):
    """Every item that some window of the text is near to: all windows, exact distances."""
    ids = [index.vocabulary.get(x, 0) for x in decontaminate.words(text)]
    out = set()
    for item, seq in zip(index.ids, index.seqs, strict=True):
        n = len(seq)
        windows = np.asarray([ids[k : k + n] for k in range(max(1, len(ids) - n + 1)) if len(ids[k : k + n]) == n]).reshape(-1, n)
        if len(windows) and decontaminate.edit_distances(windows, seq).min() <= decontaminate.allowed(n, 0.8):
            out.add(item)
    return out


def test_short_benchmark_items(spark):
    """Items of one to four words match equal windows alone, each text by its first one; against a scan of all windows."""
    r = random.Random(5)
    some = lambda n: " ".join(r.choice("abcde") for _ in range(n))
    items = [(k, some(r.randint(0, 4))) for k in range(30)] + [(30, None), (31, "B, a"), (32, "zz"), (33, "a b c d e a b c d e")]
    texts = [some(n) for n in (0, 1, 2, 3, 5, 8, 20, 20)] + ["", "A b", "a\n--B", "x a b c d e a b c d e y zz"]
    index, short = decontaminate.Index(items, shortest=1), decontaminate.Index(items[:33], shortest=1)
    for t, got, alone in zip(texts, index.hits(texts), short.hits(texts), strict=True):
        w, want = decontaminate.words(t), set()
        for i, x in items:
            x = decontaminate.words(x or "")
            at = next((k for k in range(len(w) - len(x) + 1) if x and len(x) < 5 and w[k : k + len(x)] == x), None)
            if at is not None:
                want.add((i, at, len(x), 0))
        assert len(got) == len(set(got)) and {h for h in got if h[2] < 5} == want == set(alone)
    assert {h[0] for h in index.hits(texts)[-1]} >= {32, 33}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one, many = ({(x["doc_id"], *p) for x in decontaminate.contaminated(docs, b, block=n, shortest=1).collect() for p in x["passages"]} for n in (1000, 9))
    assert one == many and len(one) > 50


@pytest.mark.parametrize("where", ["anywhere", "head", "tail", "middle", "indels"])
def test_decontamination_recall(spark, small, where):
    """Copies with as many edits as the limit allows, wherever they are, against a scan of all windows."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    r = random.Random(where)
    noise = [f"n{k}" for k in range(500)]
    found = wanted = 0
    texts = []
    for _ in range(120):
        w = [x.decode() for x in decontaminate.words(r.choice(items)[1])]
        n = len(w)
        most = decontaminate.allowed(n, 0.8)
        spans = {"anywhere": (0, n), "head": (0, n // 2), "tail": (n // 2, n), "middle": (n // 4, 3 * n // 4), "indels": (0, n)}
        places = range(*spans[where])
        if where == "indels":
            for k in range(most // 2):
                at = r.randrange(len(w))
                w[at : at + (k % 2)] = [] if k % 2 else [r.choice(noise)]
        else:
            for at in r.sample(places, min(most, len(places))):
                w[at] = r.choice(noise)
        texts.append(" ".join(r.choices(noise, k=20) + w + r.choices(noise, k=20)))
    for t, hs in zip(texts, index.hits(texts), strict=True):
        want = scanned(index, t)
        got = {h[0] for h in hs}
        assert got <= want
        wanted += len(want)
        found += len(got & want)
    assert wanted >= 100 and found >= 0.95 * wanted, (found, wanted)


# --- Jaccard join

def classes_by_hand(ids, texts):
    words, bounds = shingles.word_hashes(texts)
    s, sb = shingles.shingle_hashes(words, bounds)
    sets = [set(s[a:b].tolist()) for a, b in zip(sb[:-1], sb[1:], strict=True)]
    link = [[i != j and bool(x) and bool(y) and len(x & y) >= 0.8 * len(x | y) - 1e-9 for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            best = min([label[i], *(label[j] for j in range(len(ids)) if link[i][j])])
            changed |= best != label[i]
            label[i] = best
    members = defaultdict(list)
    for i, x in enumerate(label):
        members[x].append(ids[i])
    return {ids[i]: (min(members[label[i]]), sum(link[i])) for i in range(len(ids))}


def test_shingles():
    texts = ["", "One two", "a b c d e f", "a-b c. d\ne  f", "É é", "x" * 9000]
    words, bounds = shingles.word_hashes(texts)
    assert np.diff(bounds).tolist() == [0, 2, 6, 6, 2, 1]
    assert (words[bounds[2] : bounds[3]] == words[bounds[3] : bounds[4]]).all() and words[bounds[4]] == words[bounds[4] + 1]
    s, sb = shingles.shingle_hashes(words, bounds)
    assert np.diff(sb).tolist() == [0, 1, 2, 2, 1, 1] and s[sb[2]] != s[sb[2] + 1]
    f = shingles.fingerprints(words, bounds)
    assert (f[2] == f[3]).all() and not (f[1] == f[2]).all()
    assert (shingles.word_hashes(["b a"])[0][::-1] == shingles.word_hashes(["a b"])[0]).all()


def test_jaccard_classes(spark, small):
    r = random.Random(11)
    rows = [(x["doc_id"], x["text"] or "") for x in spark.read.parquet(f"{small}/documents.parquet").collect()][:120]
    base = "the quick brown fox jumps over a lazy dog " * 4
    for k in range(60):
        w = (base + " ".join(f"t{j}" for j in range(60))).split()
        for _ in range(k % 3):
            w[r.randrange(len(w))] = f"z{k}"
        rows.append((10_000 + k, " ".join(w)))
    rows += [(20_000, "three words only"), (20_001, "Three words, only!"), (20_002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard.near_duplicates(df).collect()}
    want = classes_by_hand([d for d, _ in rows], [t for _, t in rows])
    assert got == want and want[20_001] == (20_000, 1)
    kept = [x["doc_id"] for x in jaccard.keep_one(df).collect()]
    assert sorted(kept) == sorted({c for c, _ in want.values()})


def test_jaccard_blocks(spark, monkeypatch):
    """A component dealt into many blocks has the same links and classes."""
    r = random.Random(12)
    rows = []
    for k in range(60):
        w = [f"t{j}" for j in range(100)]
        w[r.randrange(100)] = f"z{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 7)
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard.near_duplicates(df).collect()}
    assert got == classes_by_hand([d for d, _ in rows], [t for _, t in rows])


def test_jaccard_awkward(docs, none):
    out = jaccard.near_duplicates(docs)
    assert out.count() == docs.count()
    by = defaultdict(list)
    for x in out.collect():
        by[x["doc_id"]].append((x["class_id"], x["n_links"]))
    assert sorted(by[1]) == [(1, 2)] * 3 and sorted(by[0]) == [(0, 0)] * 2 and by[None] == [(None, 0)]
    assert jaccard.keep_one(docs).columns == docs.columns and jaccard.near_duplicates(none).count() == 0


def test_intersections():
    g = np.random.default_rng(2)
    sets = [np.unique(g.integers(0, 80, g.integers(0, 60)).astype(np.uint64)) for _ in range(70)]
    got = jaccard.intersections(sets)
    for i in range(70):
        for j in range(70):
            if i != j:
                assert got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


def test_prefix_reaches_recall():
    k = jaccard.prefix_length()
    assert 1 - (1 - 0.8**k) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** jaccard.TREES


def test_tied_runs():
    """Near texts of a run are tied whatever stands between them; those that only share a prefix aren't."""
    g = np.random.default_rng(5)
    n = jaccard.TREES * jaccard.DEPTH // 2
    for _ in range(60):
        groups = g.integers(0, 4, 12)
        bases = g.integers(0, 256, (4, n)).astype(np.uint8)
        sketch = bases[groups].copy()
        for row in sketch:
            row[g.integers(0, n, 6)] = g.integers(0, 256, 6)
        sig = np.zeros((12, 16), np.uint8)
        sig[:, 8:] = g.integers(0, 2, (12, 8))
        sig[6:, 0] = 1  # two runs
        order = np.lexsort([sig[:, j] for j in range(15, -1, -1)])
        tied = jaccard.tie_runs(sig[order], sketch[order], 4, jaccard.least_agreeing())
        for i in range(12):
            for j in range(12):
                same = groups[order][i] == groups[order][j] and (i < 6) == (j < 6)
                assert (tied[i] == tied[j]) == same
    assert 40 < jaccard.least_agreeing() < 55


def test_jaccard_chain(spark, monkeypatch):
    """In a chain of texts, each near the next only, a text meets a few blocks of many, and no link is lost."""
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 20)
    rows = [(k, " ".join(f"c{j}" for j in range(10 * k, 10 * k + 104))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard.near_duplicates(df).collect()}
    want = classes_by_hand([d for d, _ in rows], [t for _, t in rows])
    assert want[5] == (0, 2) and 0.97 * 238 <= sum(n for _, n in got.values()) <= 238


def test_jaccard_recall(spark):
    """Pairs at 0.8 to 0.85, the hardest, among texts that share boilerplate."""
    r = random.Random(21)
    rows = []
    for k in range(300):
        w = [f"b{j}" for j in range(60)] + [f"u{k}x{j}" for j in range(60)]
        other = list(w)
        for j in r.sample(range(4, 116), 2):
            other[j] = f"e{k}x{j}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["n_links"] for x in jaccard.near_duplicates(df).collect()}
    want = classes_by_hand([d for d, _ in rows], [t for _, t in rows])
    assert sum(n for _, n in want.values()) > 500
    assert sum(got.values()) >= 0.98 * sum(n for _, n in want.values())


def test_components(spark):
    r = random.Random(13)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k in got} and all(a in got for a, b in edges if a != b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbers_in_long_runs():
    """Each number of a long list is a candidate, wherever it stands, and so is one in seven groups."""
    numbers = [f"01{70 + k} {1234567 + 11 * k}" for k in range(40)]
    text = "tel " + " ".join(numbers)
    found = {text[a:b] for a, kind, b in pii.candidates(text) if kind == 3}
    assert set(numbers) <= found
    text = "call 00 33 1 23 45 67 89 now"
    assert (5, 3, 24) in set(pii.candidates(text))
    assert list(pii.candidates("7" * 100)) == []


# --- passages

def test_compact_windows():
    g = np.random.default_rng(3)
    for _ in range(50):
        n = g.integers(0, 40, 4).tolist()
        b = np.concatenate([[0], np.cumsum(n)])
        t = g.integers(0, 2**63, b[-1], np.uint64)
        l, c, r, v = passages.compact_windows(t, b, 1, 5)
        # Each passage of at least 5 tokens lies in the one window whose minimum it has.
        for d in range(4):
            for i in range(b[d], b[d + 1]):
                for j in range(i + 5, b[d + 1] + 1):
                    inside = (l <= i) & (j <= r) & (i <= c) & (c < j)
                    assert inside.sum() == 1


def test_passages(spark, docs, none):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    shared = [[word() for _ in range(n)] for n in (60, 80, 51, 40)]
    rows = []
    for k in range(80):
        w = [word() for _ in range(r.randint(100, 300))]
        if k % 4 != 3:
            p = list(shared[k % 4])
            if k % 4 == 1 and k > 40:
                p[5] = word()
            at = r.randrange(len(w))
            w[at:at] = p
        elif k % 8 == 3:
            at = r.randrange(len(w))
            w[at:at] = shared[3]
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    docs_found = {x["doc_id"] for x in got} | {x["other_id"] for x in got}
    assert docs_found == {k for k in range(80) if k % 4 != 3}
    texts = {d: t.split() for d, t in rows}
    for x in got:
        a = texts[x["doc_id"]][x["start_word"] : x["start_word"] + x["n_words"]]
        b = texts[x["other_id"]][x["other_start"] : x["other_start"] + x["other_words"]]
        s, q = ({tuple(v[k : k + 5]) for k in range(len(v) - 4)} for v in (a, b))
        assert len(a) >= passages.MIN_WORDS and len(s & q) / len(s | q) >= 0.8 - 1e-9 and x["similarity"] == pytest.approx(len(s & q) / len(s | q))
    out = passages.repeated_passages(docs).collect()
    assert out == [] and passages.repeated_passages(none).count() == 0


def shares(a, b):
    s, q = ({tuple(v[k : k + 5]) for k in range(len(v) - 4)} for v in (a, b))
    return len(s & q) / len(s | q)


def near_passages(a, b, least=passages.T):
    """verify() of two lists of words, told all places where a token is common."""
    s, q = (shingles.shingle_hashes(*shingles.word_hashes([" ".join(w)]))[0].view(np.int64) for w in (a, b))
    x, y = np.nonzero(s[:, None] == q[None, :])
    return passages.verify(s, 0, q, x, y, 0.8, least)


@pytest.mark.parametrize(("n", "edits"), [(60, [30]), (80, [40]), (90, [45]), (100, [33, 66]), (200, [40, 80, 120, 160])])
def test_passage_edits_in_the_middle(n, edits):
    """A whole passage that brute force finds near is found whole, wherever words were replaced."""
    a = [f"p{k}" for k in range(n)]
    b = [f"x{k}" if k in edits else w for k, w in enumerate(a)]
    assert shares(a, b) >= 0.8
    left, right = ([f"{s}{k}" for k in range(70)] for s in "lr")
    for one, two in ((a, b), (b, a)):
        got = near_passages(left + one + right, right + two + left)
        assert [x[4] for x in got if x[:4] == (70, n - 4, 70, n - 4)] == [pytest.approx(shares(a, b))]


def test_stretches():
    """The longest stretch is as long as the longest that brute force finds."""
    g = np.random.default_rng(7)
    for _ in range(200):
        m = g.random(60) < 0.85
        at = np.flatnonzero(m)
        longest = max((y + 1 - x for x in at for y in at if y >= x and m[x : y + 1].sum() >= 4 * (~m[x : y + 1]).sum()), default=0)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(int), [0]])))
        starts, ends = edges[::2], edges[1::2]
        got = passages.stretches(starts, ends, starts - np.concatenate([starts[:1], ends[:-1]]), 4.0, 5)
        assert max((ends[y] - starts[x] for x, y in got), default=0) == (longest if longest >= 5 else 0)
        assert all(p[1] < q[0] for p, q in zip(got, got[1:], strict=False))


@pytest.mark.parametrize(("n", "lacks"), [(85, 4), (85, 5), (100, 6), (120, 12), (400, 30)])
def test_passage_lacks_words_in_a_row(n, lacks):
    a = [f"p{k}" for k in range(n)]
    b = a[: n // 2 - lacks // 2] + a[n // 2 - lacks // 2 + lacks :]
    assert shares(a, b) >= 0.8
    left, right = ([f"{s}{k}" for k in range(70)] for s in "lr")
    for one, two in ((a, b), (b, a)):
        got = near_passages(left + one + right, right + two + left)
        assert [x[4] for x in got if x[:4] == (70, len(one) - 4, 70, len(two) - 4)] == [pytest.approx(shares(a, b))]


def test_passage_far_from_its_window():
    """One joined window is enough for a passage that goes on further than 4 T tokens."""
    s = np.arange(600, dtype=np.int64)
    assert passages.verify(s, 0, s + 0, np.array([0]), np.array([0]), 0.8, passages.T) == [(0, 600, 0, 600, 1.0)]


def test_rest_of_overlapping_passage():
    """What a passage has beyond those found is reported if it is long enough, and later diagonals look at it again."""
    doc = np.arange(200, dtype=np.int64)
    hub = np.concatenate([doc[:120], np.arange(1000, 1100), doc[20:200]])
    # Two windows on the first diagonal, one on that of the 180 tokens, 100 of which were found before.
    got = passages.verify(doc, 0, hub, np.array([10, 50, 150]), np.array([10, 50, 350]), 0.8, passages.T)
    assert set(range(200)) == {k for x in got for k in range(x[0], x[0] + x[1])}


def test_crowded_rectangles():
    """Against all pairs of rectangles, one by one."""
    g = np.random.default_rng(8)
    for _ in range(60):
        m = int(g.integers(1, 12))
        c, hc = g.integers(0, 300, m), g.integers(0, 300, m)
        w, hw = ((g.integers(0, 3, m) << 48) | (g.integers(0, 90, m) << 24) | g.integers(1, 90, m) for _ in range(2))
        hw = hw & ((1 << 48) - 1)
        side = lambda at, reach: (at - (reach >> 24 & passages.REACH), at + (reach & passages.REACH))
        want = []
        for i in range(m):
            functions = set()
            for j in range(m):
                overlaps = [min(side(a[i], b[i])[1], side(a[j], b[j])[1]) - max(side(a[i], b[i])[0], side(a[j], b[j])[0]) for a, b in ((c, w), (hc, hw))]
                if min(overlaps) >= 20:
                    functions.add(int(w[j]) >> 48)
            want.append(len(functions) >= 2)
        assert passages.crowded(c, w, hc, hw, 2, 20).tolist() == want


def test_crowded_copies_settled_by_largest(monkeypatch):
    """Rectangles of two copies overlap with the largest ones, so they aren't held against each other."""
    tokens = np.random.default_rng(9).integers(0, 2**63, 10_000).astype(np.uint64)
    c, w = [], []
    for f in range(passages.HASHES):
        l, at, r, _ = passages.compact_windows(tokens, np.asarray([0, len(tokens)]), f)
        c.append(at)
        w.append(f << 48 | (at - l) << 24 | (r - at))
    c, w = np.concatenate(c), np.concatenate(w)
    held, repeat = [0], np.repeat
    monkeypatch.setattr(np, "repeat", lambda *a: held.append(len(x := repeat(*a))) or x)
    assert passages.crowded(c, w, c + 3, w & ((1 << 48) - 1), 2, passages.T).all()
    assert sum(held) < 5 * len(c)


def test_near_passages_end_to_end(spark):
    """Passages with edits anywhere, beside those that a scan of both texts finds; a third text that shares only a piece leads."""
    r = random.Random(16)
    rows, want = [], []
    for n, edits in ((50, 0), (60, 1), (80, 1), (100, 2), (150, 3), (200, 4)) * 8:
        while True:
            d = len(rows)
            p = [f"p{d}x{k}" for k in range(n)]
            q = [f"e{d}x{k}" if k in set(r.sample(range(n), edits)) else w for k, w in enumerate(p)]
            if shares(p, q) >= 0.8:
                break
        pad = lambda m: [f"u{d}m{m}x{k}" for k in range(r.randint(30, 90))]
        rows += [(d, " ".join(pad(1) + p + pad(2))), (d + 1, " ".join(pad(3) + q + pad(4))), (d + 2, " ".join(pad(5) + p[:40] + pad(6)))]
        want.append(d)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {min(x["doc_id"], x["other_id"]) for x in got}
    assert len(found & set(want)) >= 0.95 * len(want) and not any(x["doc_id"] % 3 == 2 or x["other_id"] % 3 == 2 for x in got)


@pytest.mark.parametrize(("piece", "beside", "inserted", "least"), [(44, 8, False, 38), (40, 8, False, 38), (44, 3, True, 35)])
def test_near_passages_beside_pieces_of_them(spark, piece, beside, inserted, least):
    """40 passages of 60 words and their copies with a word replaced or inserted, beside texts that share only their first or last
    words: those are too short for passages, and they stand first in groups without a place of their own in any result."""
    r = random.Random(3)
    pad = lambda: [f"u{r.getrandbits(60)}" for _ in range(r.randint(30, 90))]
    texts, pairs = [], []
    for k in range(40):
        p = [f"p{k}x{j}" for j in range(60)]
        q, at = list(p), r.randrange(60)
        q[at : at + (not inserted)] = [f"e{k}"]
        pairs.append((len(texts), len(texts) + 1))
        texts += [pad() + p + pad(), pad() + q + pad()]
        for _ in range(beside):
            texts += [pad() + p[:piece] + pad(), pad() + p[-piece:] + pad()]
    ids = r.sample(range(len(texts)), len(texts))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in zip(ids, texts, strict=True)], "doc_id long, text string")
    found = {frozenset((x["doc_id"], x["other_id"])) for x in passages.repeated_passages(df).collect()}
    want = {frozenset((ids[a], ids[b])) for a, b in pairs}
    assert found <= want and len(found) >= least


def test_stretch_keys():
    """Windows share a key just where both hold two equal tokens about their minima, as far apart as a stretch is long."""
    r = np.random.default_rng(5)
    text = r.integers(0, 2**63, 400, np.uint64)
    other = r.integers(0, 2**63, 400, np.uint64)
    for same in (40, passages.T - 2, passages.T, 60):
        s = other.copy()
        s[100 : 100 + same] = text[200 : 200 + same]
        for c in (200, 210, 200 + same - 1):
            reach = np.array([60 << 24 | 60])
            keys = [set(passages.stretch_keys(x, np.array([7]), np.array([at]), reach)[1].tolist()) for x, at in ((text, c), (s, c - 100))]
            # Both begin at tokens an even number of places before c.
            far = [k for k in passages.SPANS if any(c - b >= 200 and c - b + k < 200 + same and c - b + k >= c for b in range(0, passages.SPANS[0] + 1, 2))]
            assert len(keys[0] & keys[1]) >= bool(far) and (far or same > passages.SPANS[0] or not keys[0] & keys[1]), (same, c)
    near = passages.smallest_from(text, 8)
    assert all(text[near[k]] >> np.uint64(9) == min(text[k : k + 8] >> np.uint64(9)) for k in range(390))
    short = np.array([1, 2, 3], np.uint64)
    assert len(passages.stretch_keys(short, np.array([7]), np.array([1]), np.array([1 << 24 | 2]))[0]) == 0


def test_hot_passage_over_partitions(spark):
    """A passage that all documents share ties them together, through the first document of each partition."""
    shared = " ".join(f"p{k}" for k in range(70))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: F.concat(F.lit("u"), F.col("id"), F.lit("x"), k)), F.lit(shared)).alias("text"))
        got = passages.repeated_passages(df).collect()
        label = list(range(300))
        for _ in range(8):
            for x in got:
                label[x["doc_id"]] = label[x["other_id"]] = min(label[x["doc_id"]], label[x["other_id"]])
        assert set(label) == {0} and len(got) < 10 * 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- queries and pipeline

def test_queries(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name, f in queries.queries().items():
        if name not in ("op1_decontaminate", "op7_passages"):
            out = f(spark, small)
            assert out.count() == n and "doc_id" in out.columns, name


def test_pipeline(spark, small):
    import corpus_pipeline as p

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    state = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(state, labels)
    scores = dict(zip(docs, model.scores(list(docs.values())), strict=True))
    left = {d: t for d, t in docs.items() if scores[d] < toxicity.THRESHOLD}
    gone, _ = lines_by_hand(list(left.items()), 10)
    norm = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    left = {d: "\n".join(x for x in t.split("\n") if norm(x) not in gone) for d, t in left.items()}
    classes = classes_by_hand(list(left), list(left.values()))
    left = {d: t for d, t in left.items() if classes[d][0] == d}
    index = decontaminate.Index([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    left = {d: t for (d, t), h in zip(left.items(), index.hits(list(left.values())), strict=True) if not h}
    got = {r["doc_id"]: r["text_sha256"] for r in p.run(spark, small).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in left.items()}
    assert [k for k, _ in p.STAGES][0] == "toxicity" and len(p.STAGES) == 5


def test_pipeline_stages_awkward(spark, small, docs, none):
    import corpus_pipeline as p

    plain = docs.select(*p.COLUMNS)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, plain, small)
        assert out.columns == p.COLUMNS, name
        assert stage(spark, none.select(*p.COLUMNS), small).count() == 0
    assert p.STAGES[-1][1](spark, plain, small).count() == plain.count()
