"""Byte-level BPE with the tokenizers library, with a cache by pre-token and one by word.

The library encodes each pre-token by itself, so a text's ids are those of its pre-tokens in order, and a
corpus has far fewer distinct pre-tokens than pre-tokens. Where no space stands beside other white space,
no pre-token crosses from one word (what stands between two spaces, with the space before it) to the
next, so most words need no look at the pattern. Texts are split here by the published byte-level
pattern where this surely agrees with the library (characters below U+0500, no added token, no
control character that counts as white space to one of the two only); other texts go to the library whole. So do all
texts of a tokenizer whose file says something else: another pre-tokenizer or pattern, a prefix space, a normalizer,
a model that isn't plain BPE, or added tokens that look beyond themselves.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
from array import array
from collections.abc import Callable

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
UNSURE = re.compile("[^\t\n\r\x20-\x7e\xa1-ӿ]")
#: A space beside other white space; of sure texts' characters no others are white space.
MIXED = (" \n", "\n ", " \t", "\t ", " \r", "\r ")
SPECIAL = "<|endoftext|>"
DEFAULT = "byte_bpe_50k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


#: Byte-level vocabularies write printable Latin-1 bytes as they are, and the others, in order, as letters from U+0100 on.
_PLAIN = {b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)}
LETTERS = {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}
LETTERS_SPACE = chr(LETTERS[0x20])

_LOADED: dict[tuple[str, int], Encoder] = {}


def encoder_for(path: str, width: int = 2) -> Encoder:
    """This process's encoder: its caches serve all tasks that run here."""
    if (path, width) not in _LOADED:
        _LOADED[path, width] = Encoder(path, width)
    return _LOADED[path, width]


class _Cache(dict):
    """Text to ids; what isn't known is made. Forgets all when it grows beyond ``most`` entries."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, text: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        value = self[text] = self.make(text)
        return value


class Encoder:
    """Ids of pre-tokens, as bytes of little-endian unsigned numbers of ``width`` bytes. Its two caches hold ``most`` entries each."""

    def __init__(self, path: str, width: int = 2, most: int = 600_000):
        from tokenizers import Tokenizer

        self.library, self.width = Tokenizer.from_file(path), width
        if self.library.get_vocab_size(with_added_tokens=True) > 1 << 8 * width:
            raise ValueError("ids don't fit the width")
        self.added, self.plain = self._read(self.library.to_str())
        #: Code points before an edit whose pre-tokens it may change: one for greedy ends, one for white space that looks ahead, else an added token that the edit completes.
        self.context = max(map(len, self.added), default=0) + 2
        self.kind, self.code = np.dtype(f"<u{width}"), {1: "B", 2: "H", 4: "I"}[width]
        self.tokenize = self.library.model.tokenize  # the model alone takes one pre-token, its bytes written as letters
        self.known, self.words = _Cache(self._piece, most), _Cache(self._word, most)

    @staticmethod
    def _read(config: str) -> tuple[list[str], bool]:
        """The added tokens, and whether a text's ids are those of the published pattern's pre-tokens."""
        c = json.loads(config)
        added, pre, model = c["added_tokens"], c["pre_tokenizer"] or {}, c["model"]
        looks = any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added)
        level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        bpe = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        return [x["content"] for x in added], bool(level and bpe and c["normalizer"] is None and not looks and not c["truncation"] and not c["padding"])

    def sure(self, text: str) -> bool:
        return self.plain and not UNSURE.search(text) and not any(x in text for x in self.added)

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()
        letters = piece.replace(" ", LETTERS_SPACE) if plain else piece.encode().decode("latin-1").translate(LETTERS)
        ids = array(self.code, [t.id for t in self.tokenize(letters)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        """Of what stands between two spaces, with the space before it."""
        if word.isalpha():
            return self._piece(" " + word)
        stem = word.rstrip(string.punctuation)
        if stem.isalpha():  # letters are one pre-token, and marks behind them another
            return self.words[stem] + self.known[word[len(stem) :]]
        return self._by_pattern(" " + word)

    def _by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, PATTERN.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """All ids of a text."""
        if not text:
            return b""
        if not self.sure(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if text[0] == " " or text[-1] == " " or "  " in text or any(x in text for x in "\n\t\r") and any(x in text for x in MIXED):
            return self._by_pattern(text)
        first, *rest = text.split(" ")
        return self._by_pattern(first) + b"".join(map(self.words.__getitem__, rest))

    def pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths in code points and numbers of ids of a text's pre-tokens; a special token is one."""
        if self.sure(text):
            found = PATTERN.findall(text)
            return list(map(len, found)), [len(self.known[x]) // self.width for x in found]
        found = self.library.encode(text, add_special_tokens=False)
        lengths, counts, at = [], [], 0
        # tokens of one pre-token share its number; an added token is one by itself
        spans: list[list] = []
        for word, (a, b) in zip(found.word_ids, found.offsets, strict=True):
            if spans and word is not None and spans[-1][0] == word and spans[-1][1] == word:
                spans[-1][3], spans[-1][4] = max(spans[-1][3], b), spans[-1][4] + 1
            else:
                spans.append([word, word, a, b, 1])
        for n, (_, _, _, end, count) in enumerate(spans):
            end = len(text) if n + 1 == len(spans) else max(at, spans[n + 1][2])
            lengths.append(end - at)
            counts.append(count)
            at = end
        return lengths, counts
