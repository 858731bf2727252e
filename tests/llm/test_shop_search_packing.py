"""Operators 11 to 13 against brute force, on random and awkward tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factloom.llm import asof, lexical, packing
from factloom.llm.wordmemo import WordBpe

HOURS = asof.HOUR

# --- as-of join

LEFT, RIGHT = "id long, k long, t long, time long, n_tied string, __fl_k string", "k long, t long, p long, s long, cents long, match string"


def asof_by_hand(left, right, tolerance):
    by = defaultdict(list)
    for k, t, p, s, cents, *_ in right:
        if k is not None and t is not None:
            by[k].append((t, p, s, cents))
    out = []
    for i, k, t, *_ in left:
        near = [r for r in by[k] if k is not None and t is not None and r[0] <= t <= r[0] + tolerance]
        if not near:
            out.append((i, k, t, None, None, None))
            continue
        at = max(r[0] for r in near)
        tied = [r for r in near if r[0] == at]
        low = float("-inf")
        first = max(tied, key=lambda r: (low if r[1] is None else -r[1], low if r[2] is None else r[2], low if r[3] is None else r[3]))
        out.append((i, k, t, at, first[2], len(tied)))
    return Counter(out)


def asof_rows(spark, left, right, tolerance):
    one, two = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    out = asof.asof_join(one, two, "k", "t", "t", tolerance, [-F.col("p"), F.col("s")], ["s", "cents"])
    assert out.columns == [*one.columns, "match"]
    return Counter((r["id"], r["k"], r["t"], r["match"] and r["match"]["time"], r["match"] and r["match"]["s"], r["match"] and r["match"]["n_tied"]) for r in out.collect())


@pytest.mark.parametrize("limits", [(8, 4096, 64), (1, 6, 3)])
def test_asof(spark, monkeypatch, limits):
    for name, v in zip(("PAIRS", "ROWS", "PARTS"), limits, strict=True):
        monkeypatch.setattr(asof, name, v)
    r = random.Random(5)
    # One hot key, times in bursts, ties, nulls everywhere, times before 1970, repeated rows.
    key = lambda: r.choice([1, 1, 1, 2, 3, None])
    time = lambda: r.choice([r.randint(-3000, 3000), r.randint(100, 140), 100, 500, None])
    left = [(i, key(), time(), i, "x", "y") for i in range(500)] + [(7, 1, 120, 7, None, None)] * 2
    right = [(key(), time(), r.choice([1, 2, None]), r.choice([r.randint(0, 9), None]), r.randint(0, 3), "m") for _ in range(400)]
    right += right[:5]
    for tolerance in (1, 70, 1000):
        assert asof_rows(spark, left, right, tolerance) == asof_by_hand(left, right, tolerance)


def test_asof_hot_bucket_is_cut(spark, monkeypatch):
    """All of one key within a bucket: rows are cut to slices, and no slice makes a product."""
    made = []
    inner = asof.written
    monkeypatch.setattr(asof, "written", lambda df, tag="t": made.append(tag) or inner(df, tag))
    r = random.Random(6)
    left = [(i, 1, r.randint(0, 10**6), i, "", "") for i in range(3000)]
    right = [(1, r.randint(0, 10**6), 1, i, i, "") for i in range(3000)]
    assert asof_rows(spark, left, right, 10**7) == asof_by_hand(left, right, 10**7)
    assert made.count("slices") >= 1


def test_asof_empty(spark):
    row = [(1, 1, 5, 0, "", "")]
    assert asof_rows(spark, row, [], 10) == Counter([(1, 1, 5, None, None, None)])
    assert not asof_rows(spark, [], [(1, 5, 1, 1, 1, "")], 10)
    assert not asof_rows(spark, [], [], 10)
    clash = spark.createDataFrame(row, LEFT).withColumn("match", F.lit(1))
    with pytest.raises(ValueError):
        asof.asof_join(clash, spark.createDataFrame([], RIGHT), "k", "t", "t", 1, [F.col("s")], ["s"])


def test_micros_ignore_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00.000123' a, timestamp_ntz'1969-12-31 23:59:59.999999' b, CAST(null AS timestamp_ntz) c, timestamp'2024-03-31 00:00:00Z' d")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = df.select(*(asof.micros(df, c) for c in "abcd")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(got) == (1_711_852_200_000_123, -1, None, 1_711_843_200_000_000)


def test_orders_and_clicks(spark):
    sales = spark.sql("SELECT * FROM VALUES (9L, 1L, 1.005D, timestamp_ntz'2024-01-01 10:20:30', 4), (9L, null, double('NaN'), timestamp_ntz'2024-01-01 10:20:30', null), (9L, 7L, null, null, 2) AS t(client_id, sale_id, total, sold_at, priority)")
    got = {(r["sale_id"], r["priority"], r["time_us"], r["total_cents"]) for r in asof.orders_of(sales).collect()}
    want, us = set(), 1_704_104_430_000_000
    for sale, total, t, p in ((1, 1.005, us, 4), (None, float("nan"), us, None), (7, None, None, 2)):
        h = None if sale is None else zlib.crc32(str(sale).encode())
        t = t - t % HOURS if t and h is not None and h % 2 else t
        cents = None if total is None or total != total else math.floor(100 * total + 0.5)
        want.add((sale, p, t, cents))
        if h is not None and h % 3:
            want.add((-1 - sale, None if p is None else 6 - p, t, cents))
    assert got == want
    clicks = spark.sql("SELECT * FROM VALUES (3L, 1L, timestamp_ntz'2024-01-01 10:20:30'), (3L, 1L, timestamp_ntz'2024-01-01 10:20:30'), (4L, null, null), (null, 2L, timestamp_ntz'2024-01-01 00:00:00') AS t(click_id, client_id, ts)")
    assert asof.clicks_of(clicks).count() == 3


# --- ranked search

DOCS = "doc_id long, text string, n long, terms string, tf string, score long"


def search_by_hand(docs, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = [(d, Counter(term.findall((t or "").translate(low)))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, length = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = Counter()
    for item, text in items:
        rows = []
        for d, c, size in counts:
            m = 25 + 75 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in term.findall((text or "").translate(low)) if c[t])
            if s > 0:
                rows.append((-s, d is None, d))
        out.update((item, k, d, -s) for k, (s, _, d) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1))
    return out


def ranked(spark, docs, items, **how):
    one = spark.createDataFrame([(d, t, 1, "x", "y", 2) for d, t in docs], DOCS)
    out = lexical.search(one, spark.createDataFrame(items, "item_id long, text string"), **how)
    return Counter(tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, monkeypatch, small):
    if small:
        for name, v in (("DOCS", 7), ("MOST_BYTES", 16)):
            monkeypatch.setattr(lexical, name, v)
    r = random.Random(2)
    words = ["the", "THE", "Über", "ÜBER", "日本", "a1", "b", "c-d", "é́", "x\x00y", *(f"w{k}" for k in range(40))]
    docs = [(k, r.choice([" ", "\n", "--"]).join(r.choices(words, k=r.choice([0, 1, 3, 30, 200])))) for k in range(150)]
    docs += [(None, "the a1 w3"), (5, None), (6, ""), (7, "...")] + [(9, docs[9][1])] * 3 + [(k, "w1 w2") for k in range(200, 230)]
    items = [(k, " ".join(r.choices(words, k=r.choice([1, 4, 12])))) for k in range(20)] + [(3, "w1 w1 W2 the"), (None, "b b"), (21, None), (22, ""), (23, "zzz unknown")]
    want = search_by_hand(docs, items, 10)
    assert ranked(spark, docs, items) == want and len(want) > 150
    # Items in several blocks.
    assert ranked(spark, docs, items, most=300) == want
    assert ranked(spark, docs, items, top=3) == search_by_hand(docs, items, 3)


def test_search_empty(spark):
    assert not ranked(spark, [], [(1, "a")]) and not ranked(spark, [(1, "a")], []) and not ranked(spark, [(1, "..")], [(1, "a")])


def test_search_long(spark):
    long = "the quick " * 300_000 + "x" * 5_000_000 + " end"
    docs = [(1, long), (2, "end of the text"), (3, "quick")]
    assert ranked(spark, docs, [(1, "the end"), (2, "quick")]) == search_by_hand(docs, [(1, "the end"), (2, "quick")], 10)


# --- packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def held_to_rules(rows, docs, size=4096):
    """Every id in one piece, sequences gapless, and nothing padded."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    want = Counter((d, np.asarray([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in docs)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    used = []
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size and at & (at - 1) == 0
        used.append(at)
    for d, parts in pieces.items():
        mine = Counter({ids: n for (x, ids), n in want.items() if x == d})
        if sum(mine.values()) == 1:
            assert b"".join(p[1] for p in sorted(parts)) == next(iter(mine)) and {p[2] for p in parts} == {len(next(iter(mine))) // 4}
        else:
            assert sum(len(p[1]) for p in parts) == sum(len(ids) * n for ids, n in mine.items())
    assert set(pieces) == {d for d, _ in want}
    return used


def test_packing(spark):
    r = random.Random(3)
    docs = [(k, " ".join(r.choice(["alpha", "beta,", "Gamma", "42", "日本", "it's"]) for _ in range(r.choice([0, 1, 5, 60, 900, 9000])))) for k in range(200)]
    docs += [(None, "null id"), (None, None), (500, None), (501, ""), (502, "x <|endoftext|> y\x1cz"), (503, "same"), (503, "same")]
    df = spark.createDataFrame([(d, t, 1, "") for d, t in docs], "doc_id long, text string, length long, ids string").repartition(3)
    out = packing.pack(df, lambda: WordBpe(PATH), block=20_000).collect()
    used = held_to_rules(out, docs)
    assert sum(x < 4096 for x in used) <= 3 * 12
    assert packing.pack(df.limit(0), lambda: WordBpe(PATH)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, lambda: WordBpe(PATH), size=1000)


def test_packing_balances_costs():
    """Against the plain greedy rule written out, and against sequences filled in the given order."""
    r = random.Random(4)
    for _ in range(30):
        lengths = [r.choice([r.randint(1, 40), r.randint(200, 400)]) for _ in range(r.randint(1, 300))]
        room = np.full(max(1, sum(lengths) // 512), 512)
        got = packing.assign(lengths, room, 0.01)
        left, spent, want = room.tolist(), [0.0] * len(room), []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            at, n = 0, lengths[k]
            while n and any(left):
                some = [s for s in range(len(left)) if left[s] >= n] or [s for s in range(len(left)) if left[s] == max(left)]
                s = min(some, key=lambda s: (spent[s], s))
                take = min(n, left[s])
                want.append((k, at, take, s))
                left[s] -= take
                spent[s] += take + 0.01 * take * take
                at, n = at + take, n - take
        assert got == want
        if sum(lengths) >= 512:
            assert not any(left)
    lengths = [400] * 20 + [10] * 2000
    spread = lambda rows: np.ptp([sum(n + 0.01 * n * n for _, _, n, t in rows if t == s) for s in range(50)])
    in_order, s, free = [], 0, 512
    for k, n in enumerate(lengths):
        at = 0
        while n and s < 50:
            take = min(n, free)
            in_order.append((k, at, take, s))
            at, n, free = at + take, n - take, free - take
            if not free:
                s, free = s + 1, 512
    assert spread(packing.assign(lengths, np.full(50, 512), 0.01)) <= spread(in_order)


def test_words_equal_the_library():
    bpe, r = WordBpe(PATH, 1 << 16), random.Random(1)
    letters = "aB1'sΣσ́é é  \x85\x1c᠎​\n\t\r\x0bÅİ'RE'll日本ﬁ½ẛ̣\U0001f600-.,"
    for k in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30))) + (" <|endoftext|> x" if k % 50 == 0 else "")
        assert bpe(text) == bpe.whole(text)
    bpe.PART = 10
    text = "Some words, it's 1234 of them " * 50
    assert bpe(text) == bpe.whole(text) and bpe("") == b"" and bpe("a" * 50) == bpe.whole("a" * 50)
