"""SentencePiece encoding and decoding with seeded merge-dropout (operator 2).

The encoder is the BPE agenda of a SentencePiece model: adjacent symbols whose concatenation is a piece are candidates,
the best score goes first, the leftmost among equals. With dropout p, the candidate that comes to the top is skipped for good
if a keyed hash of (seed, document, place of the part in it, number of the step) falls below p: every occurrence of a word
draws anew, and the same seed gives the same pieces on any cluster, at any retry and in any partitioning; p = 0 gives the
library's own result. Each step has 16 bits of hash, so p is rounded to 1 / 65536.

No piece goes on after a space sign, so merges never cross from a word to the next word's space, nor do they where no piece
has two characters side by side. A text is encoded part by part between such places.

The result for a part depends on the steps skipped alone, so a worker memoises (part, steps skipped) in a trie: an edge is the
next step skipped, a node knows the number of steps taken if no more are skipped. Occurrences walk it all at once; those
that it doesn't hold go through the agenda together as rows of a matrix. Words that come for the first time go there
without the memo, for most of a corpus's words come once. Parts over NARROW characters or with characters
outside the vocabulary aren't memoised. The memo is bounded by bytes (KEPT) and starts afresh when it is full.

Decoding is lossless for every text: characters outside the vocabulary, and the space sign itself, become byte pieces.

Defined results: a null text gives null ids and decodes to null; an empty text has no pieces; repeated rows with equal
doc_id get equal pieces; a null doc_id counts as 0; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count, repeat
from operator import add, not_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import crc32, mix64, table

SPACE = "▁"
#: A part of n characters takes 3 (n - 1) steps at most, since a merge makes two new candidates: 60 fit into a mask.
NARROW, WIDE, STEPS = 21, 48, 64
#: Bytes of the memo, by estimate, at which it starts afresh; UNKNOWN marks nodes whose steps aren't known.
KEPT, UNKNOWN = 160 << 20, 255
#: Slots that tell whether a word may have come before: those that come once don't enter the memo.
SLOTS = 1 << 22
NONE = np.int32(2**31 - 1)
CHUNK = re.compile(" *[^ ]+| +")


class Pieces:
    """A BPE model with byte fallback: its pieces and its table of merges."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.byte) < 256 or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) or lib.encode("a", out_type=str)[0][0] != SPACE:
            raise ValueError("a model with byte fallback, a leading space and no spaces inside pieces is needed")
        self.text = [b""] * n
        for p, i in self.ids.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for value, i in self.byte.items():
            self.text[i] = bytes([value])
        # Ranks: the better score, the lower; equal scores rank equally.
        scores = np.asarray([lib.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.size = n
        left, right, to = [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(i)
        key = np.asarray(left, np.int64) * n + np.asarray(right, np.int64)
        order = np.argsort(key)
        to = np.asarray(to, np.int64)
        self.merge_key, self.merge_to, self.merge_rank = key[order], to[order].astype(np.int32), rank[to[order]].astype(np.int32)
        # An open table for the vectorised search: 2^19 slots for some 1e5 merges.
        self.bits = max(16, int(np.ceil(np.log2(len(key) * 6 + 1))))
        slots = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(key)), self._slot(self.merge_key)
        while len(todo):
            free = slots[at] < 0
            slots[at[free]] = todo[free]
            lost = slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        self.slots = slots
        self.as_dict: dict[int, tuple[int, int]] | None = None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The index of the merge of each pair, -1 for none."""
        key = left.astype(np.int64) * self.size + right
        at = self._slot(key)
        found = self.slots[at]
        out = np.full(len(key), -1, np.int32)
        rows = np.flatnonzero(found >= 0)
        while len(rows):
            f = found[rows]
            same = self.merge_key[f] == key[rows]
            out[rows[same]] = f[same]
            rows = rows[~same]
            at[rows] = (at[rows] + 1) & ((1 << self.bits) - 1)
            found[rows] = self.slots[at[rows]]
            rows = rows[found[rows] >= 0]
        return out

    def symbols(self, chunk: str) -> list[int]:
        """Ids of the characters; bytes never merge, so theirs are negative: -1 - id. The space sign itself is spelt in bytes."""
        out = []
        for c in chunk:
            i = self.ids.get(SPACE if c == " " else c) if c != SPACE else None
            out += [-1 - self.byte[b] for b in c.encode()] if i is None else [i]
        return out

    @property
    def by_code(self) -> np.ndarray:
        """The symbol of each code point, 0 where it takes several bytes."""
        if "_by_code" not in self.__dict__:
            t = np.zeros(0x110000, np.int32)
            for c in map(chr, range(128)):
                t[ord(c)] = self.symbols(c)[0]
            for c, i in self.ids.items():
                if len(c) == 1 and c != SPACE:
                    t[ord(c)] = i
            self._by_code = t
        return self._by_code

    @property
    def known(self) -> frozenset[str]:
        """The characters that are one symbol."""
        if "_known" not in self.__dict__:
            self._known = frozenset(c for c in map(chr, np.flatnonzero(self.by_code > 0).tolist()))
        return self._known

    @property
    def beside(self) -> set[str]:
        """The pairs of characters that some piece has side by side; others never merge. A space is written as itself."""
        if "_beside" not in self.__dict__:
            self._beside = {p[k : k + 2] for p in (x.replace(SPACE, " ") for x in self.ids) for k in range(len(p) - 1)}
        return self._beside


def skips(occurrence: np.ndarray, step: int, p: float) -> np.ndarray:
    """Whether the keyed hash of each occurrence skips the candidate of this step."""
    x = mix64(occurrence + np.uint64((step >> 2) * (0x9E3779B97F4A7C15 >> 1) & 0xFFFFFFFFFFFFFFFF))
    return (x >> np.uint64(16 * (step & 3)) & np.uint64(0xFFFF)) < np.uint64(round(p * 65536))


def masks(occurrence: np.ndarray, p: float, size: np.ndarray | None = None) -> np.ndarray:
    """The first STEPS of `skips`, a bit for each; of parts of these sizes at least those steps that they can take."""
    out = np.zeros(len(occurrence), np.uint64)
    if not p:
        return out
    below = 1
    for most in (3, 6, 11, NARROW) if size is not None else (NARROW,):
        rows = np.flatnonzero((size > below) & (size <= most)) if size is not None else slice(None)
        n = -(-3 * (most - 1) // 8) * 2 if size is not None else STEPS // 4
        x = occurrence[rows][:, None] + np.arange(n, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15 >> 1)
        drawn = np.packbits(mix64(x).astype("<u8").view("<u2") < round(p * 65536), axis=1, bitorder="little")
        bits = np.zeros((len(x), 8), np.uint8)
        bits[:, : drawn.shape[1]] = drawn
        out[rows] = bits.view("<u8").ravel()
        below = most
    return out


def agenda(model: Pieces, symbols: list[int], occurrence: int, p: float) -> list[int]:
    """One part, with a heap."""
    if model.as_dict is None:
        model.as_dict = {k: (t, r) for k, t, r in zip(model.merge_key.tolist(), model.merge_to.tolist(), model.merge_rank.tolist(), strict=True)}
    n = len(symbols)
    ids, start, nxt, prev = list(symbols), list(range(n)), [*range(1, n), -1], list(range(-1, n - 1))
    end, live, heap = list(range(1, n + 1)), [True] * n, []
    drawn: list[bool] = []
    step = 0

    def offer(i: int) -> None:
        j = nxt[i]
        if j >= 0 and ids[i] >= 0 and ids[j] >= 0 and (m := model.as_dict.get(ids[i] * model.size + ids[j])):
            heapq.heappush(heap, (m[1], start[i], i, j, end[i], end[j], m[0]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, _, i, j, cut, right, to = heapq.heappop(heap)
        if not live[i] or not live[j] or end[i] != cut or end[j] != right or nxt[i] != j:
            continue
        if p:
            if step == len(drawn):
                groups = np.arange(step >> 2, (step >> 2) + 64, dtype=np.uint64)
                x = mix64(np.uint64(occurrence) + groups * np.uint64(0x9E3779B97F4A7C15 >> 1))
                drawn += (x.astype("<u8").view("<u2") < round(p * 65536)).tolist()
            step += 1
            if drawn[step - 1]:
                continue
        ids[i], end[i], nxt[i], live[j] = to, right, nxt[j], False
        if nxt[i] >= 0:
            prev[nxt[i]] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    return [x if x >= 0 else -1 - x for x, alive in zip(ids, live, strict=True) if alive]


def merge_rows(model: Pieces, ids: np.ndarray, n: np.ndarray, occurrence: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The agenda on many parts of like width: ids is (parts, width), n their lengths. Returns both after merging, and the steps.

    rank[r, j] is the rank of the candidate of the symbols j and j + 1. A step takes each row's first best candidate.
    """
    rows, width = ids.shape
    rank = np.full(ids.shape, NONE, np.int32)
    cols = np.arange(width)

    def offer(r: np.ndarray, j: np.ndarray) -> None:
        ok = (j >= 0) & (j + 1 < n[r])
        r, j = r[ok], j[ok]
        m = model.merges(ids[r, j], ids[r, j + 1])
        rank[r, j] = np.where(m >= 0, model.merge_rank[m], NONE)

    offer(*np.nonzero(cols[None, :] + 1 < n[:, None]))
    out_ids, out_n, place = ids, n, np.arange(rows)
    steps = np.zeros(rows, np.int64)
    step = 0
    while True:
        j = rank.argmin(1)
        go = rank[np.arange(len(rank)), j] < NONE
        steps[place[go]] = step + 1
        if not go.any():
            out_ids[place] = ids
            out_n[place] = n
            return out_ids, out_n, steps
        if go.mean() < 0.6 and len(go) > 64:  # finished rows leave
            done = ~go
            out_ids[place[done]], out_n[place[done]] = ids[done], n[done]
            ids, n, rank, occurrence, place, j = ids[go], n[go], rank[go], occurrence[go], place[go], j[go]
            go = np.ones(len(ids), bool)
        if p:
            skip = go & skips(occurrence, step, p)
            rank[np.flatnonzero(skip), j[skip]] = NONE
            go &= ~skip
        step += 1
        r = np.flatnonzero(go)
        if not len(r):
            continue
        jr = j[r]
        m = model.merges(ids[r, jr], ids[r, jr + 1])
        ids[r, jr] = model.merge_to[m]
        shift = (cols[None, :] > j[:, None]) & go[:, None]
        for x, last in ((ids, 0), (rank, NONE)):
            moved = np.empty_like(x)
            moved[:, :-1], moved[:, -1] = x[:, 1:], last
            np.copyto(x, moved, where=shift)
        n[r] -= 1
        rank[r, jr] = NONE
        rank[r, np.maximum(n[r] - 1, 0)] = NONE
        offer(r, jr - 1)
        offer(r, jr)


def lowest_bit(x: np.ndarray) -> np.ndarray:
    """The number of the lowest bit set, STEPS for none."""
    low = x & (~x + np.uint64(1))
    return np.where(x == 0, STEPS, np.frexp(low.astype(np.float64))[1] - 1)


class Encoder:
    """Ids of texts as little-endian i32 bytes, with a memo of parts by the steps that they skip."""

    def __init__(self, path: str, p: float, seed: int, kept: int = KEPT):
        self.model, self.p, self.seed, self.kept = Pieces(path), p, seed, kept
        self._afresh()

    def _afresh(self) -> None:
        self.number: dict[str, int] = {}  # words, which are lists of parts
        self.seen = bytearray(SLOTS)  # by hash: words and parts that came before
        self.parts_at, self.parts_n = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.parts_of: array = array("q")
        self.root: dict[str, int] = {}  # the nodes of parts
        self.child: dict[int, int] = {}  # by node * STEPS + step
        self.part: dict[int, str] = {}
        self.nodes = self.used = self.held = 0
        self.steps, self.at, self.size = np.full(1024, UNKNOWN, np.uint8), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.chars = np.zeros(1024, np.uint8)  # of the part, if the node is one's root
        self.arena = np.zeros(4096, np.int32)

    def _node(self) -> int:
        self.nodes += 1
        return self.nodes - 1

    def _grow(self) -> None:
        """Room for all nodes and words."""
        if (more := self.nodes - len(self.steps)) > 0:
            more = max(more, len(self.steps))
            self.steps = np.concatenate([self.steps, np.full(more, UNKNOWN, np.uint8)])
            self.at, self.size, self.chars = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.at, self.size, self.chars))
        if (more := len(self.number) - len(self.parts_n)) > 0:
            more = max(more, len(self.parts_n))
            self.parts_at, self.parts_n = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.parts_at, self.parts_n))

    def merged(self, parts: list[str], occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of each part in this occurrence: all ids, where each part's start, their number, and the steps taken (0 for
        parts that aren't memoised)."""
        size = np.asarray(list(map(len, parts)))
        flat = self.model.by_code[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        at = np.concatenate([[0], np.cumsum(size)])
        many = np.zeros(len(parts), bool)
        many[np.searchsorted(at, np.flatnonzero(flat == 0), "right") - 1] = True
        out_at, out_n, out_steps = (np.zeros(len(parts), np.int64) for _ in range(3))
        out, end = [np.zeros(0, np.int32)], 0
        for r in np.flatnonzero(many | (size > WIDE)).tolist():
            ids = np.asarray(agenda(self.model, self.model.symbols(parts[r]), int(occurrence[r]), self.p), np.int32)
            out.append(ids)
            out_at[r], out_n[r], end = end, len(ids), end + len(ids)
        size[many] = WIDE + 1
        for lo, hi in ((1, 5), (6, 8), (9, 11), (12, 15), (16, 24), (25, WIDE)):
            rows = np.flatnonzero((size >= lo) & (size <= hi))
            for k in range(0, len(rows), 4096):
                rs = rows[k : k + 4096]
                n = size[rs].copy()
                inside = np.arange(hi)[None, :] < n[:, None]
                ids = np.where(inside, flat[np.minimum(at[rs][:, None] + np.arange(hi)[None, :], len(flat) - 1)], 0)
                ids, n, out_steps[rs] = merge_rows(self.model, ids, n, occurrence[rs], self.p)
                ids = ids[np.arange(hi)[None, :] < n[:, None]]
                out.append(np.where(ids < 0, -1 - ids, ids))
                out_n[rs], out_at[rs], end = n, end + np.cumsum(n) - n, end + len(ids)
        return np.concatenate(out), out_at, out_n, out_steps

    def parts(self, word: str) -> list[str]:
        """The word, cut where no piece has the characters side by side; a word of letters alone isn't cut."""
        if word[1:].isalpha():
            return [word]
        beside = map(self.model.beside.__contains__, map(add, word, word[1:]))
        cuts = [0, *compress(count(1), map(not_, beside))]
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]

    def _numbered(self, words: list[str], new_too: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The node of each part of the words, the number of parts of each word, and the parts that aren't memoised: -1 - k.

        new_too: memoise words and parts at once, not when they come again.
        """
        own = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(own < 0)
        long: list[str] = []
        whole: dict[int, list[int]] = {}  # words of which a part isn't memoised
        known, number, root, part, of, seen = self.model.known, self.number, self.root, self.part, self.parts_of, self.seen
        new: list[tuple[int, int, int]] = []
        roots: list[int] = []
        for i in missing.tolist():
            w = words[i]
            k = number.get(w)
            if k is None:
                slot = hash(w) % SLOTS
                kept = again = new_too or seen[slot]
                seen[slot] = 1
                numbers = []
                for x in (w,) if w[1:].isalpha() else self.parts(w):
                    node = root.get(x)
                    if node is None:
                        if x != w:
                            slot = hash(x) % SLOTS
                            again = new_too or seen[slot]
                            seen[slot] = 1
                        if again and len(x) <= NARROW and known.issuperset(x):
                            root[x] = node = self._node()
                            part[node] = x
                            roots.append(node)
                            self.held += 280 + len(x)
                        else:
                            long.append(x)
                            node, kept = -len(long), False
                    numbers.append(node)
                if not kept:
                    whole[i] = numbers
                    continue
                k = number[w] = len(number)
                new.append((k, len(of), len(numbers)))
                of.extend(numbers)
            own[i] = k
        self._grow()
        self.chars[roots] = [len(part[node]) for node in roots]
        if new:
            k, at, n = np.asarray(new).T
            self.parts_at[k], self.parts_n[k] = at, n
            self.held += 160 * len(new)
        count = np.where(own >= 0, self.parts_n[own], 0).astype(np.int64)
        if whole:
            rows = np.fromiter(whole, np.int64, len(whole))
            count[rows] = list(map(len, whole.values()))
        first = np.cumsum(count) - count
        place = np.arange(count.sum())
        all_parts = np.frombuffer(of, np.int64) if len(of) else np.zeros(1, np.int64)
        take = np.repeat(np.where(own >= 0, self.parts_at[own], 0) - first, count) + place
        out = all_parts[np.minimum(take, len(all_parts) - 1)]
        if whole:
            n = count[rows]
            out[np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = [k for got in whole.values() for k in got]
        del all_parts
        return out, count, long

    def _learn(self, rows: np.ndarray, root: np.ndarray, occurrence: np.ndarray, mask: np.ndarray) -> None:
        node = root[rows].copy()
        ids, at, n, steps = self.merged([self.part[k] for k in node.tolist()], occurrence[rows])
        skipped = mask[rows] & ((np.uint64(1) << steps.astype(np.uint64)) - np.uint64(1))
        child = self.child
        for r in np.flatnonzero(skipped).tolist():
            bits, k = int(skipped[r]), int(node[r])
            while bits:
                low = bits & -bits
                key = k * STEPS + low.bit_length() - 1
                k = child.get(key, -1)
                if k < 0:
                    k = child[key] = self._node()
                    self.held += 190
                bits ^= low
            node[r] = k
        self._grow()
        if self.used + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(max(len(ids), len(self.arena)), np.int32)])
        self.arena[self.used : self.used + len(ids)] = ids
        self.steps[node], self.at[node], self.size[node] = steps, at + self.used, n
        self.used += len(ids)
        self.held += 4 * len(ids)

    def _walk(self, root: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """The node of each occurrence of a memoised part."""
        mask = masks(occurrence, self.p, self.chars[root])
        node, rest, active = root.copy(), mask.copy(), np.arange(len(root))
        stuck: list[np.ndarray] = []
        while len(active) or stuck:
            if not len(active):
                # Of each node that stops occurrences: where its steps are unknown, one that skips latest; else one for each step.
                rows = np.concatenate(stuck)
                b, unknown = lowest_bit(rest[rows]), self.steps[node[rows]] == UNKNOWN
                order = np.lexsort((b, node[rows]))
                nd, bit = node[rows][order], b[order]
                last = np.append(nd[1:] != nd[:-1], True)
                pick = np.where(unknown[order], last, last | np.append(bit[1:] != bit[:-1], True))
                self._learn(rows[order][pick], root, occurrence, mask)
                active, stuck = rows, []
            nd, b = node[active], lowest_bit(rest[active])
            on = self.steps[nd] > b  # UNKNOWN is above all steps
            active, nd, b = active[on], nd[on], b[on]
            key, back = np.unique(nd * STEPS + np.minimum(b, STEPS - 1), return_inverse=True)
            child = np.fromiter(map(self.child.get, key.tolist(), repeat(-1)), np.int64, len(key))[back]
            child[b == STEPS] = -1
            ok = child >= 0
            if not ok.all():
                stuck.append(active[~ok])
            active = active[ok]
            node[active] = child[ok]
            rest[active] &= rest[active] - np.uint64(1)
        return node

    def __call__(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """A word is a run of spaces and what follows up to the next space."""
        if self.held > self.kept:
            self._afresh()
        words: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                words += CHUNK.findall(" " + t) if "  " in t or t[0] == " " or t[-1] == " " else [" " + w for w in t.split(" ")]
            ends.append(len(words))
        if not words:
            return [b""] * len(texts)
        root, count, long = self._numbered(words, False)
        bounds = np.concatenate([[0], np.cumsum(count)])[ends]
        del words
        first = mix64(np.asarray([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) ^ mix64(np.asarray([self.seed], np.uint64)))
        own = np.repeat(np.arange(len(texts)), np.diff(bounds))
        occurrence = mix64(first[own] + (np.arange(len(root)) - bounds[own]).astype(np.uint64))
        some = np.flatnonzero(root >= 0)
        at, size = np.zeros(len(root), np.int64), np.zeros(len(root), np.int64)
        node = self._walk(root[some], occurrence[some])
        at[some], size[some] = self.at[node], self.size[node]
        flat = self.arena[: self.used]
        if long:
            rows = np.flatnonzero(root < 0)
            ids, start, size[rows], _ = self.merged([long[-1 - k] for k in root[rows].tolist()], occurrence[rows])
            at[rows] = len(flat) + start
            flat = np.concatenate([flat, ids])
        after = np.cumsum(size)
        data = flat[np.repeat(at - (after - size), size) + np.arange(after[-1])].astype("<i4")
        cuts = np.concatenate([[0], after])[bounds].tolist()
        return [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: bytes) -> str:
        """The text of these ids."""
        return b"".join(map(self.model.text.__getitem__, array("i", ids))).decode()[1:]


@lru_cache(maxsize=1)
def _encoder(path: str, p: float, seed: int) -> Encoder:
    return Encoder(path, p, seed)


@lru_cache(maxsize=1)
def _decoder(path: str) -> Encoder:
    return Encoder(path, 0.0, 0)


def _batches(texts: list[str | None], keys: list[int | None], encoder: Encoder) -> Iterator[tuple[str | None, bytes | None]]:
    """Texts with their ids, some 2^20 characters at a time."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < 1 << 20):
            size += len(texts[to] or "")
            to += 1
        for t, ids in zip(texts[at:to], encoder([t or "" for t in texts[at:to]], [k or 0 for k in keys[at:to]]), strict=True):
            yield t, None if t is None else ids
        at = to


def encode(text: Column, key: Column, path: str, p: float = 0.1, seed: int = 2) -> Column:
    """The ids of the text's pieces, array<int>; key varies the dropout between documents."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def encoded(t: pa.Array, k: pa.Array) -> pa.Array:
        ids = [x for _, x in _batches(t.to_pylist(), k.to_pylist(), _encoder(path, p, seed))]
        at = np.cumsum([0] + [len(x or b"") // 4 for x in ids])
        flat = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<i4"))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat, mask=pa.array([x is None for x in ids], pa.bool_()))

    return encoded(text, key.cast("long"))


def decode(ids: Column, path: str) -> Column:
    """The text of an array<int> of piece ids."""

    @F.arrow_udf(StringType())
    def decoded(x: pa.Array) -> pa.Array:
        e = _decoder(path)
        return pa.array([None if i is None else e.decode(array("i", i).tobytes()) for i in x.to_pylist()], pa.string())

    return decoded(ids)


DIGEST = StructType([StructField("n_pieces", IntegerType()), StructField("ids_crc32", StringType()), StructField("decoded", StringType())])


def round_trip(text: Column, key: Column, path: str, p: float = 0.1, seed: int = 2) -> Column:
    """n_pieces, ids_crc32 and the decoded text in one pass, without a row of ids leaving the worker."""

    @F.arrow_udf(DIGEST)
    def tripped(t: pa.Array, k: pa.Array) -> pa.Array:
        e = _encoder(path, p, seed)
        n, crc, back = [], [], []
        for _, ids in _batches(t.to_pylist(), k.to_pylist(), e):
            n.append(None if ids is None else len(ids) // 4)
            crc.append(None if ids is None else str(crc32(ids)))
            back.append(None if ids is None else e.decode(ids))
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(crc, pa.string()), pa.array(back, pa.string())], names=["n_pieces", "ids_crc32", "decoded"])

    return tripped(text, key.cast("long"))


def op2_pieces(spark: SparkSession, sf_dir: str, p: float = 0.1) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.withColumn("r", round_trip(F.col("text"), F.col("doc_id"), public_tokenizers.path("piece_bpe_32k.model"), p))
    return out.select(
        "doc_id", F.coalesce(F.col("r.n_pieces"), F.lit(0)).cast("long").alias("n_pieces"), F.col("r.ids_crc32").cast("long").alias("ids_crc32"),
        F.sha2(F.col("r.decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("r.decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
