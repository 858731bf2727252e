"""Personal data (operator 10): generators of high recall, boosted trees over their candidates, calibrated thresholds.

Base spans (e-mail, IP address, card, phone) follow fixed patterns and checks and always stay. Beside them, generators
propose overlapping candidates: sequences of digit groups in every split, and mail and IP addresses written out or in six. Boosted trees judge
each candidate of each kind from its format and its context; a kind's threshold is the lowest at which a held-out fold
has PRECISION. Accepted candidates that touch no base span are added, the most probable first.

No table labels spans, so the trees learn from sentences that `examples` writes by rule from a fixed seed: numbers and
addresses in the forms people use, and dates, versions, amounts, identifiers and broken checksums as counter-examples.

Defined results: a null or empty text has no spans; offsets count code points; repeated rows get equal spans; extra
columns stay; an empty table gives an empty result; of candidates as probable the first wins. Work is linear in the text:
base patterns are matched over disjoint stretches, a number has at most MOST_DIGITS digits, and names in addresses have the
lengths that mail and domain names allow (64 and 63 characters).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .boosting import Boosted, fit
from .common import table, text_of

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
GROUP = re.compile(r"[0-9]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

MOST_DIGITS, PRECISION = 19, 0.98
RUN = re.compile(r"[+(]{0,2}[0-9](?:[0-9]|[\x20()./-]{1,3}(?=[0-9(+])){5,}")
SPLIT = re.compile(r"[+(]*[0-9]+\)?")
TRIGGER = re.compile("@|＠|[(\\[] ?at ?[)\\]]|[\\s(\\[]dot[\\s)\\]]", re.IGNORECASE)
WRITTEN = re.compile(r"(?:[\w%+-]{1,64}(?:\s?[(\[] ?dot ?[)\]]\s?|\sdot\s)){0,3}[\w.%+-]{1,64}\s?(?:@|＠|[(\[] ?at ?[)\]]|\sat\s)\s?[\w-]{1,64}(?:(?:\.|\s?[(\[] ?dot ?[)\]]\s?|\sdot\s)[A-Za-z][\w-]{0,63}){1,6}", re.IGNORECASE)
CONTEXT = {"phone": ("tel", "phone", "call", "fax", "mobile", "cell", "anruf", "llam"), "card": ("card", "visa", "master", "karte", "tarjeta", "carte"), "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address")}
AROUND = 24
#: IP addresses with their dots written out, and those of version 6.
APART = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:[(\[] ?(?:\.|dot) ?[)\]]|\sdot\s)\s?[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
COLONS = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?:(?::?[0-9A-Fa-f]{1,4}){1,7}|:)(?![\w:])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer; neither part of an address holds an @, so the stretches between them are looked at once."""
    free, at = 0, text.find("@")  # where the first part may begin
    while at >= 0:
        start = at - LOCAL.match(text[free:at][::-1]).end()
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def _ips(text: str, at: int) -> Iterator[tuple[int, int]]:
    """As IP.finditer: groups in a row, four by four."""
    for m in CHAIN.finditer(text, at):
        groups = list(GROUP.finditer(text, m.start(), m.end()))
        for k in range(0, len(groups) - 3, 4):
            yield groups[k].start(), groups[k + 3].end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, leftmost and not overlapping within a kind; failing matches are dropped."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    first = DIGIT.search(text)
    if first:
        at = first.start()
        for a, b in _ips(text, at):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text[a:b].split(".")):
                out.append((a, 1, b))
        for m in CARD.finditer(text, at):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end), overlapping: everything that may be personal data."""
    if DIGIT.search(text):
        for m in RUN.finditer(text):
            groups = [(g.start(), g.end()) for g in SPLIT.finditer(text, m.start(), m.end())]
            for i in range(len(groups)):
                for j in range(i, len(groups)):
                    a, b = groups[i][0], groups[j][1]
                    n = len(_digits(text[a:b]))
                    if n > MOST_DIGITS:
                        break
                    if 7 <= n <= 15:
                        yield a, 3, b
                    if 13 <= n:
                        yield a, 2, b
                    if j - i == 3 and n <= 12 and "." in text[a:b]:
                        yield a, 1, b
        for m in APART.finditer(text):
            yield m.start(), 1, m.end()
    if ":" in text:
        for m in COLONS.finditer(text):
            if "::" in m[0] or m[0].count(":") == 7:
                yield m.start(), 1, m.end()
    seen = -1
    for t in TRIGGER.finditer(text):
        lo = max(0, t.start() - 210)
        for m in WRITTEN.finditer(text, lo, min(len(text), t.end() + 210)):
            if m.start() > seen and m.start() <= t.end() and m.end() > t.start():
                seen = m.start()
                yield m.start(), 0, m.end()


def _class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    d, groups = _digits(s), [len(g) for g in re.findall("[0-9]+", s)] or [0]
    values = [int(g) for g in re.findall("[0-9]+", s)] or [0]
    low, tight_before, tight_after = before.lower(), before.rstrip(" -./("), after.lstrip(" -./)")
    return [
        *(float(kind == k) for k in range(4)), len(d), len(s), len(groups), min(groups), max(groups), groups[0], groups[-1],
        s.count(" "), s.count("-"), s.count("."), s.count("("), s.count("/"), s.startswith("+"), s.startswith("("), len(d) > 1 and luhn(d),
        _class(before[-1:]), _class(after[:1]), _class(tight_before[-1:]), _class(tight_after[:1]),
        *(any(w in low for w in CONTEXT[k]) for k in KINDS), "@" in s, bool(re.search(r"[(\[]", s)), len(re.split(r"[.\s\])]", s)[-1]),
        min(values[0], 10_000), max(values) <= 255, 1900 <= values[0] <= 2100 or 1900 <= values[-1] <= 2100, d[:1] == "0", before[-1:] in "$€#=_:" and bool(before),
        len(set(s.replace(" ", "")) - set("0123456789")),
    ]


def _fake_card(r: random.Random, n: int, good: bool) -> str:
    while True:
        d = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(n - 1))
        if luhn(d) == good:
            return d


def _grouped(d: str, sizes: tuple[int, ...], sep: str) -> str:
    parts, at = [], 0
    for n in sizes:
        parts.append(d[at : at + n])
        at += n
    return sep.join(parts)


def examples(n: int = 4000, seed: int = 10) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with the spans to be found. One in five has two items side by side, which a greedy pattern runs together."""
    r = random.Random(seed)
    digits = lambda n: str(r.randint(1, 9)) + "".join(r.choice("0123456789") for _ in range(n - 1))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))
    say = {"phone": ["tel", "phone:", "call", "fax", "my number is", "mobile"], "card": ["card", "visa", "card number:"], "email": ["mail", "contact", "write to"], "ip": ["ip", "from host"]}
    whole = lambda: r.choice([(3, f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"), (3, f"+{digits(2)} {digits(3)} {digits(6)}"), (2, _fake_card(r, r.choice([15, 16, 16, 16]), True)), (2, _grouped(_fake_card(r, 16, True), (4, 4, 4, 4), r.choice(" -"))), (1, ".".join(str(r.randint(0, 255)) for _ in range(4))), (None, digits(r.randint(1, 8))), (None, _fake_card(r, 16, False))])
    for _ in range(n):
        if r.random() < 0.2:
            text, spans = " ".join(word() for _ in range(r.randint(0, 3))), []
            for kind, item in (whole(), whole()):
                text += " " if text else ""
                spans += [] if kind is None else [(len(text), kind, len(text) + len(item))]
                text += item
            yield text + r.choice(["", ".", " " + word()]), spans
            continue
        kind, sep = r.choice([0, 1, 2, 3, 3, None, None, None]), r.choice([" ", "-", ".", "/"])
        clue = ""
        if kind == 3:
            clue = r.choice(say["phone"]) if r.random() < 0.6 else ""
            item = r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}){digits(3)}-{digits(4)}", _grouped(digits(10), (3, 3, 4), r.choice("-. ")), f"1-{_grouped(digits(10), (3, 3, 4), '-')}", f"00{digits(2)} {digits(3)} {digits(7)}", f"0{digits(3)} {digits(6)}", f"0{digits(2)}/{digits(7)}", f"+{digits(2)}/{digits(3)}/{digits(6)}", f"00 {digits(2)} {digits(1)} {' '.join(digits(2) for _ in range(4))}"])
            if item[0] in "0123456789" and "-" not in item and "." not in item:
                clue = r.choice(say["phone"])
        elif kind == 2:
            clue = r.choice(say["card"]) if r.random() < 0.6 else ""
            item = _grouped(_fake_card(r, 16, True), (4, 4, 4, 4), r.choice(["/", ".", " - ", " . "])) if r.random() < 0.7 else _grouped(_fake_card(r, 15, True), (4, 6, 5), r.choice("./"))
        elif kind == 0:
            clue = r.choice(say["email"]) if r.random() < 0.6 else ""
            a, d = r.choice([(" (at) ", "."), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), ("(at)", "(dot)"), ("＠", ".")])
            item = f"{word()}{r.choice(['', '.' + word(), str(r.randint(1, 99)), ' dot ' + word() if d.strip() == 'dot' else ''])}{a}{word()}{d}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"
        elif kind == 1:
            clue = r.choice(say["ip"]) if r.random() < 0.6 else ""
            part = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4)))
            item = r.choice([r.choice(["[.]", "(.)", "[dot]", "(dot)", " dot ", " [.] "]).join(str(r.randint(0, 255)) for _ in range(4)), ":".join(part() for _ in range(8)), f"{part()}:{part()}::{part()}", f"fe80::{part()}:{part()}:{part()}:{part()}"])
        else:
            y = r.randint(1900, 2035)
            item = r.choice([
                f"{y}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{y}", f"{r.randint(1, 12):02}/{r.randint(1, 28):02}/{y}", f"{y}-{y + 9}", f"{y}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}",
                ".".join(str(r.randint(0, 40)) for _ in range(r.randint(3, 6))), digits(r.randint(7, 12)), digits(r.randint(13, 22)), _fake_card(r, 16, False), _grouped(_fake_card(r, 16, False), (4, 4, 4, 4), sep), f"{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(1)} {digits(3)} {digits(3)} {digits(3)}", f"{digits(6)}.{digits(4)}",
                f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", " ".join(digits(r.randint(1, 4)) for _ in range(r.randint(4, 9))), f"#{digits(9)}", f"${digits(3)}.{digits(3)}.{digits(3)}", "".join(r.choice("0123456789abcdef") for _ in range(40)), f"id={digits(10)}", f"{word()}_{digits(10)}",
                f"@{word()}", f"{word()} @ {digits(2)}.{digits(2)}", f"{word()} at {word()}. {word()}", f"{word()} dot {word()} at {word()}", f"10.{digits(4)}/{digits(8)}", f"{digits(3)}-{digits(2)}", f"{r.choice(['AKIA', 'x', 'no'])}{digits(11)}", f"{digits(3)}/{digits(3)} {digits(3)}/{digits(4)}",
                f"{digits(3)}-{digits(2)}-{digits(4)}", f"0{digits(2)}-{digits(2)}-{digits(4)}", "[.]".join(str(r.randint(256, 999)) for _ in range(4)), f"{r.choice(['std', 'map', word()])}::{word()}", f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", ":".join(f"{r.randint(16, 255):02x}" for _ in range(6)), f"{word()} dot {word()}",
            ])
            clue = r.choice([*sum(say.values(), []), *[""] * 30])
        left = " ".join([*(word() for _ in range(r.randint(0, 4))), *([clue] if clue else [])])
        left += " " if left else ""
        right = r.choice(["", ".", ",", " " + word(), ". " + word().title(), "\n" + word()])
        yield left + item + right, [] if kind is None else [(len(left), kind, len(left) + len(item))]


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _free(busy: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a..b touches none of these disjoint stretches."""
    k = bisect_left(busy, (b, 0))
    return k == 0 or busy[k - 1][1] <= a


@dataclass
class Model:
    trees: Boosted
    thresholds: tuple[float, ...]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        busy = _joined(base)
        found = [c for c in dict.fromkeys(candidates(text)) if _free(busy, c[0], c[2])]
        if not found:
            return []
        p = self.trees.probability(np.asarray([features(text, *c) for c in found], float))
        taken: list[tuple[int, int, int]] = []
        busy = []
        for k in sorted(range(len(found)), key=lambda k: (-p[k], found[k])):
            a, kind, b = found[k]
            if p[k] >= self.thresholds[kind] and _free(busy, a, b):
                taken.append((a, kind, b))
                insort(busy, (a, b))
        return sorted(taken)


@lru_cache(maxsize=2)
def train(n: int = 4000, seed: int = 10) -> Model:
    """Trees on three quarters of the sentences, thresholds on the rest."""
    x, y, fold = [], [], []
    for k, (text, spans) in enumerate(examples(n, seed)):
        busy = _joined(base_spans(text))
        for c in dict.fromkeys(candidates(text)):
            if _free(busy, c[0], c[2]):
                x.append(features(text, *c))
                y.append(c in spans)
                fold.append(k % 4 == 0)
    x, y, fold = np.asarray(x, float), np.asarray(y, float), np.asarray(fold)
    trees = fit(x[~fold], y[~fold])
    p, thresholds = trees.probability(x[fold]), []
    for kind in range(len(KINDS)):
        rows = x[fold][:, kind] == 1
        order = np.argsort(-p[rows], kind="stable")
        q, good = p[rows][order], y[fold][rows][order]
        right = np.cumsum(good) / np.arange(1, len(good) + 1)
        ok = np.flatnonzero((right >= PRECISION) & (q >= 0.5))
        thresholds.append(float(q[ok[-1]]) if len(ok) and good.sum() else 2.0)
    return Model(trees, tuple(thresholds))


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = StructType([StructField(k, IntegerType()) for k in ("start", "kind", "end")])
FOUND = StructType([StructField("base", ArrayType(SPAN)), StructField("added", ArrayType(SPAN)), StructField("base_sha256", StringType()), StructField("spans", StringType())])


def find(text: Column, model: Model) -> Column:
    """base, added (lists of start, kind, end), base_sha256 and spans of the whole text."""

    @F.arrow_udf(FOUND)
    def found(t: pa.Array) -> pa.Array:
        rows = []
        for s in t.to_pylist():
            s = s or ""
            base = base_spans(s)
            more = model.added(s, base)
            rows.append((base, more, hashlib.sha256(_named(base).encode()).hexdigest(), _named(sorted([*base, *more]))))
        span = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "kind", "end")]))
        listed = lambda spans: pa.array([[dict(zip(("start", "kind", "end"), x, strict=True)) for x in s] for s in spans], span)
        base, more, sha, named = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.StructArray.from_arrays([listed(base), listed(more), pa.array(sha, pa.string()), pa.array(named, pa.string())], names=["base", "added", "base_sha256", "spans"])

    return found(text)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by its first kind in capitals."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", find(text_of(), train()).alias("f"))
    n = lambda k: F.size(F.filter("f.base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return docs.select("doc_id", *(n(k) for k in KINDS), "f.base_sha256", "f.spans", F.size("f.added").cast("long").alias("n_added"))
