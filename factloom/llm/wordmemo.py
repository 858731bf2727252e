"""Encode texts word by word with a memo: a tokenizer that never merges across words gives the same ids either way."""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from collections.abc import Callable
from string import ascii_letters

import numpy as np
import regex

if sys.byteorder != "little" or array("I").itemsize != 4:  # pragma: no cover
    raise ImportError("a little-endian machine with 4-byte integers is needed")


class Memo(dict):
    """Ids of words as bytes, in two generations of some `most` bytes each; a word in use moves to the younger one."""

    #: What Python takes for a word beside its characters and ids: the two objects' heads and the place in the table.
    EACH = 230

    def __init__(self, fill: Callable[[str], bytes], most: int):
        super().__init__()
        self.fill, self.most, self.old, self.held = fill, most, {}, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.fill(word)
        self[word] = ids
        self.held += self.EACH + len(word) + len(ids)
        return ids

    def turn(self) -> None:
        """To be called now and then: drops the older generation when the younger one is full."""
        if self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()


#: A space with white space on both sides, or on one side and the end on the other: the words around it aren't
#: encoded apart there, so such a text is encoded whole.
TOGETHER = re.compile(r" (?<=\s )(?:\s|\Z)")
#: Fixed value: the splitting rule of this family of byte-level tokenizers.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Letters up to here are letters in every version of Unicode; words with later ones go whole to the library.
LAST_LATIN = "\u024f"
#: Fixed value: characters that are a piece of their own between a letter and the end of a line or word.
MARKS = frozenset(".,;:!?")


class ByteBpe:
    """A byte-level BPE of the tokenizers library: ids of whole texts as little-endian u32 bytes.

    Its splitting rule starts a new piece at each single space, so a text is the sequence of its words, each with the
    space before it, and a word is a run of letters and what follows it. Each distinct run is encoded once by the
    library. Texts for which that doesn't hold (TOGETHER, or a special token's string) are encoded whole by the library.
    """

    def __init__(self, path: str, most: int = 120 << 20):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.lib = Tokenizer.from_file(path)
        self.tokenize = self.lib.model.tokenize
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        kind = str(self.lib.pre_tokenizer)
        if "ByteLevel" not in kind or "add_prefix_space=False" not in kind or self.lib.normalizer is not None:
            raise ValueError("a byte-level tokenizer without normalizer or added space is needed")
        # The character that stands for each byte, asked of the library: one that no rule splits from others.
        plain = ByteLevel(add_prefix_space=False, use_regex=False)
        self.stands = {i: plain.pre_tokenize_str(chr(i))[0][0][-1] for i in range(128)}
        for i in range(128, 256):
            shown = plain.pre_tokenize_str(chr(i))[0][0]  # two bytes in UTF-8
            for byte, char in zip(chr(i).encode(), shown, strict=True):
                self.stands[byte] = char
        self.plain = all(self.stands[ord(c)] == c for c in ascii_letters)
        self.inner = Memo(self._piece, min(most, 8 << 20))
        self.memo = Memo(self._word, most)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, run: str) -> bytes:
        """A run of letters, perhaps with a space before it: one piece for the splitting rule."""
        if run.isascii() and self.plain:
            shown = self.stands[32] + run[1:] if run[0] == " " else run
        else:
            shown = run.encode().decode("latin-1").translate(self.stands)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _piece(self, text: str) -> bytes:
        """A text without a word before it."""
        return self._letters(text) if text.isalpha() and (text.isascii() or max(text) <= LAST_LATIN) else self.whole(text)

    def _lines(self, word: str) -> bytes | None:
        """A word whose lines are letters with one mark at most behind them; None for others."""
        out, get = [], self.memo.__getitem__
        for line in word.split("\n"):
            if out:
                out.append(self.inner["\n"])
                get = self.inner.__getitem__
            if line.isalpha():
                out.append(get(line))
            elif line[:-1].isalpha() and line[-1] in MARKS:
                out += (get(line[:-1]), self.inner[line[-1]])
            else:
                return None
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """A word with a space before it."""
        latin = word.isascii() or max(word) <= LAST_LATIN
        if word.isalpha():
            return self._letters(" " + word) if latin else self.whole(" " + word)
        if not word or not latin:
            return self.whole(" " + word)
        if (ids := self._lines(word)) is not None:
            return ids
        first, *rest = PIECES.findall(" " + word)
        ids = self.memo[first[1:]] if first[1:].isalpha() else self.inner[first]
        return ids + b"".join(map(self.inner.__getitem__, rest))

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, get, inner = [], self.memo.__getitem__, self.inner
        for text in texts:
            if TOGETHER.search(text) or any(s in text for s in self.specials):
                out.append(self.whole(text))
                continue
            first, *rest = text.split(" ")
            out.append(inner[first] + b"".join(map(get, rest)) if first else b"".join(map(get, rest)))
            self.memo.turn()
            inner.turn()
        return out


#: What Python's split takes for white space and Unicode doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Those, what lies beyond LAST_LATIN, and the one letter below whose lower case is longer.
ODD = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]")


def latin_pieces() -> re.Pattern:
    """The splitting rule of the tokenizers with word ends, over lower-case text with no character beyond LAST_LATIN."""
    of = lambda kind: "".join(re.escape(c) for c in map(chr, range(ord(LAST_LATIN) + 1)) if unicodedata.category(c)[0] == kind)
    letters, numbers = of("L"), of("N")
    # Fixed value: the endings that the rule splits off.
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")


def byte_stands() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies, asked of the library."""
    from tokenizers.pre_tokenizers import ByteLevel

    plain, out = ByteLevel(add_prefix_space=False, use_regex=False), {}
    for i in range(256):
        for byte, char in zip(chr(i).encode(), plain.pre_tokenize_str(chr(i))[0][0], strict=True):
            out[byte] = char
    return out


class WordBpe:
    """A BPE with word ends of the tokenizers library that drops white space: ids of whole texts as little-endian u32 bytes.

    Such a tokenizer gives a text the ids of its words, one after another. A text without characters beyond LAST_LATIN is split
    into pieces by the tokenizer's rule, and only a new piece meets the library's merges. Other texts are split at white space
    and their new words are encoded by the library, as is all of a text with a special token's string or an ASCII separator.
    """

    #: Characters split at a time.
    PART = 1 << 22

    def __init__(self, path: str, most: int = 120 << 20):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        rule = str(self.lib.pre_tokenizer)
        if not self.lib.model.end_of_word_suffix or "behavior=Removed" not in rule or "add_prefix_space=False" not in rule:
            raise ValueError("a byte-level tokenizer that ends words and drops white space is needed")
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.stands = byte_stands()
        self.pieces = latin_pieces().findall
        self.memo, self.words = Memo(self._piece, most), Memo(self.whole, most // 4)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(self.stands)
        return array("I", [t.id for t in self.lib.model.tokenize(shown)]).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self.whole(text)
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + self.PART) if len(text) - at > self.PART else -1
            part = text[at : end if end >= 0 else len(text)]
            if not ODD.search(part):
                out.append(b"".join(map(self.memo.__getitem__, self.pieces(part.lower()))))
            elif SEPARATORS.search(part):
                out.append(self.whole(part))
            else:
                out.append(b"".join(map(self.words.__getitem__, part.split())))
            self.memo.turn()
            self.words.turn()
            at += len(part)
        return b"".join(out)
