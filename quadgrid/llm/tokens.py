"""Token ids of whole texts, by the tokenizers library.

A tokenizer splits a text into pre-tokens and encodes each on its own, so a text may be cut
wherever a pre-token must end, and what was encoded before may be reused. TextEncoder splits a
text of plain characters into pre-tokens, and any other at white space into pieces, of which
those with other characters are split by the library; it keeps the ids of the pre-tokens it has
seen (bounded), and gives every new one to the library's model. The ids are those of `Tokenizer.encode(text, add_special_tokens=False)`;
a text that holds the string of an added token (`<|endoftext|>`) goes to the library as a whole,
and so does every text with a tokenizer of another build than the two known here.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

#: Pre-tokens, and pieces of texts that aren't plain, whose ids an encoder remembers, at most;
#: each task has its own encoder.
PRETOKENS, PIECES = 1_200_000, 100_000
#: Longer ones aren't remembered, so that memory is bounded in bytes too.
LONGEST = 64

_SPACE_PIECE = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?!\S)")
# The two tokenizers' own pre-token patterns, for pieces of plain characters (below
# U+0250, none that is a rare space or changes its length in lower case), whose letters and
# numbers are spelt out. Letters and numbers stand first, as they are found most; no other
# alternative matches where one of them does.
_GPT_PLAIN = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼-¾]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+|\s+(?!\S)|\s+")
_WORD_PLAIN = re.compile(r"[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-zªµºß-öø-ɏ0-9²³¹¼-¾]+")
_GPT_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_WORD_ASCII = re.compile(r"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-z0-9]+", re.ASCII)
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]")
#: What str.split() parts at but the library's `\s` doesn't match.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}


class _Memory(dict):
    """Remembers what make() gave. When half full, the entries become the old generation, of
    which only those asked for again are carried over."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.half, self.old = make, limit // 2, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= LONGEST:
            self[key] = out
        return out


class TextEncoder:
    """ids(text): the little-endian ids of a whole text, as bytes of `dtype`."""

    def __init__(self, path: str):
        self.tokenizer, self.dtype = Tokenizer.from_file(path), id_type(path)
        state = json.loads(self.tokenizer.to_str())
        pre, norm = state.get("pre_tokenizer") or {}, state.get("normalizer") or {}
        parts = [p.get("type") for p in pre.get("pretokenizers", [])]
        bpe = state["model"].get("type") == "BPE" and not state["model"].get("dropout")
        # The library takes these out of the text before it splits and normalizes the rest.
        self.added = tuple(t["content"] for t in state["added_tokens"])
        bpe = bpe and not any(t["normalized"] for t in state["added_tokens"])
        self.ids, self.model = self._whole, self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.space = chr(self.alphabet[32])
        self.pretokens = _Memory(self._pretoken, PRETOKENS)
        self.pieces = _Memory(self._piece, PIECES)
        if bpe and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.ascii, self.plain, self.lower, self.ids = _GPT_ASCII, _GPT_PLAIN, False, self._spaced
        elif bpe and parts == ["Split", "ByteLevel"] and [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            if pre["pretokenizers"][0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
                self.ascii, self.plain, self.lower, self.ids = _WORD_ASCII, _WORD_PLAIN, True, self._words

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pretoken(self, plain: str) -> bytes:
        if plain.isascii():
            # Of printable ASCII only the space has another character in the byte-level alphabet.
            plain = plain.replace(" ", self.space) if plain.isprintable() else plain.translate(self.alphabet)
        else:
            plain = plain.encode().decode("latin-1").translate(self.alphabet)
        return self._mapped(plain)

    def _mapped(self, mapped: str) -> bytes:
        return array(self.dtype.char, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _plain(self, text: str) -> bytes | None:
        """The ids of a text of plain characters; None for any other."""
        if text.isascii():
            split = self.ascii
        elif _NOT_PLAIN.search(text) is None:
            split = self.plain
        else:
            return None
        return b"".join(map(self.pretokens.__getitem__, split.findall(text.lower() if self.lower else text)))

    def _piece(self, piece: str) -> bytes:
        found = self._plain(piece)
        if found is not None:
            return found
        if self.tokenizer.normalizer is not None:
            piece = self.tokenizer.normalizer.normalize_str(piece)
        return b"".join(self._mapped(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece))

    def _holds_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def _spaced(self, text: str) -> bytes:
        if self._holds_added(text):
            return self._whole(text)
        if (found := self._plain(text)) is not None:
            return found
        parts = text.split(" ") if _ODD_SPACE.search(text) is None else _SPACE_PIECE.split(text)
        first = self._piece(parts[0])
        return first + b"".join(map(self.pieces.__getitem__, [" " + p for p in parts[1:]]))

    def _words(self, text: str) -> bytes:
        if _NOT_SPACE.search(text) or self._holds_added(text):
            return self._whole(text)
        if (found := self._plain(text)) is not None:
            return found
        return b"".join(map(self.pieces.__getitem__, text.split()))


def id_type(path: str) -> np.dtype:
    """The type that holds every id of a vocabulary."""
    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
