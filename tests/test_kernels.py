"""Kernels over methods hold few of them as Python objects."""

import pyarrow as pa

from factloom.operators import effects, flow


def test_batches_are_cut_whole_and_in_order():
    batches = [pa.RecordBatch.from_pydict({"g": list(range(k))}) for k in (0, 1, 40, 16)]
    got = list(flow.some(iter(batches)))
    assert max(b.num_rows for b in got) <= 16 and [x for b in got for x in b.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]


def test_aliases_of_many_methods(spark):
    f = spark.createDataFrame([(g, 1, 2) for g in range(50)], "g long, src long, dst long").coalesce(1)
    a = spark.createDataFrame([(g, 1, "x", "y") for g in range(50)], "g long, node long, left string, right string")
    assert sorted(tuple(r) for r in effects.alias_pairs(f, a).collect()) == sorted((g, n, "x", "y") for g in range(50) for n in (1, 2))


def test_common_words_need_no_pattern(monkeypatch):
    """Words of letters with a mark or a line's end behind them are cut without the splitting rule; ids are the library's."""
    import public_tokenizers

    from factloom.llm import wordmemo

    e = wordmemo.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["it's a.\nB", "a.\n\nB c", "a²b, ² x", "\nA b", "A\n", "a.b, c..", "ǆ. ɐb, Ω.", "1.\nA 2, b3.", "a?\r\nb", "a, b c,", "x\ty, z.", "ª, º.\nµ"]
    assert e(odd) == [e.whole(t) for t in odd]
    monkeypatch.setattr(wordmemo, "PIECES", None)
    plain = ["Words, more.\nOthers; here: été!\nÀ la fin? yes.", "one.\nTwo\nThree. four,"]
    assert e(plain) == [e.whole(t) for t in plain]
