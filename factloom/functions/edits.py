"""Edit distances, stems and text differences. Characters are compared natively; lists and stems need a kernel in Arrow batches."""

from __future__ import annotations

import difflib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def char_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.levenshtein(a, b)


def list_distance(a: list, b: list) -> int:
    """Levenshtein distance of two lists, in memory of the shorter one."""
    if len(b) > len(a):
        a, b = b, a
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays; null if either is."""

    @F.arrow_udf(IntegerType())
    def distance(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else list_distance(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    return distance(a, b)




def _is_consonant(w: str, i: int) -> bool:
    if w[i] in "aeiou":
        return False
    return w[i] != "y" or i == 0 or not _is_consonant(w, i - 1)


def _measure(w: str) -> int:
    """The number of vowel-consonant changes."""
    kinds = [_is_consonant(w, i) for i in range(len(w))]
    return sum(1 for p, q in zip(kinds, kinds[1:], strict=False) if not p and q)


def _has_vowel(w: str) -> bool:
    return any(not _is_consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _is_consonant(w, n - 1) and not _is_consonant(w, n - 2) and _is_consonant(w, n - 3) and w[-1] not in "wxy"


#: The suffix tables of Porter's algorithm (1980), steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The Porter stem of a lower-case word; words of one or two letters stay."""
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in STEP4 if w.endswith(e)), key=len, default=None)
    if end:
        rest = w[: -len(end)]
        if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(words: Column) -> Column:
    """The stems of an array of words. Apply it to distinct words where there are few."""

    @F.arrow_udf(ArrayType(StringType()))
    def stemmed(x: pa.Array) -> pa.Array:
        return pa.array([None if ws is None else [stem(w) for w in ws] for ws in x.to_pylist()], pa.list_(pa.string()))

    return stemmed(words)


DIFF = StructType([StructField("op", StringType()), StructField("text", StringType())])


def text_diff(a: Column, b: Column, lines: bool = False) -> Column:
    """The edits from a to b: an array of (equal | delete | insert, text), by characters or whole lines."""

    @F.arrow_udf(ArrayType(DIFF))
    def differ(x: pa.Array, y: pa.Array) -> pa.Array:
        rows = []
        for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
            if p is None or q is None:
                rows.append(None)
                continue
            p, q = (p.splitlines(True), q.splitlines(True)) if lines else (p, q)
            out = []
            for op, i, j, k, m in difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
                join = "".join
                out += [("equal", join(p[i:j]))] if op == "equal" else [z for z in (("delete", join(p[i:j])), ("insert", join(q[k:m]))) if z[1]]
            rows.append([{"op": o, "text": t} for o, t in out])
        return pa.array(rows, pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())])))

    return differ(a, b)


def patch(old: Column, diff: Column) -> Column:
    """The new text of a diff made from old."""
    kept = F.filter(diff, lambda d: d["op"] != "delete")
    return F.when(old == F.array_join(F.transform(F.filter(diff, lambda d: d["op"] != "insert"), lambda d: d["text"]), ""), F.array_join(F.transform(kept, lambda d: d["text"]), ""))
