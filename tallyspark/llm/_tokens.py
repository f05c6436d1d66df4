"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache
of words.

Both vocabularies used here split a text into words by a pattern and encode
each word on its own, so the ids of a text are those of its words in a row.
Words are encoded by the library once and then kept; a text holding a
character beyond the plain set below, or the opening of a special token, goes
to the library whole, so the result is always the library's."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa

from ._shared import text_slabs

_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
# Characters on which the library's Unicode tables and Python's agree and NFC
# changes nothing: printable ASCII, tab, line ends, Latin-1 letters, a few marks.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÿ–—‘’“”…€]*")
# The splitting patterns of the two vocabulary files, for plain texts (fixed values).
_PATTERNS = {
    "word_bpe_49k.json": (rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+", True),
    "byte_bpe_50k.json": (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+", False),
}
# The byte-level form: a printable byte is its own character, the n-th other byte is chr(256 + n).
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_FORM = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
CACHE_CHUNKS, CACHE_PIECES = 400_000, 400_000
CACHE_WORDS = 200_000  # pieces of the byte vocabulary are its words: fewer differ
SLAB_CHARS = 4_000_000
_APART = ("\t", "\r", "  ", "\n\n", " \n", "\n ")  # white space that isn't one space or line end alone
_WORD = re.compile(f"[{_LETTERS}]+")
_SPACE = chr(_BYTE_FORM[32])
# Class of each byte in the byte vocabulary's pattern: 1 letters, 2 digits, 3 marks; 0 what
# may end no word here: white space, the apostrophe and bytes of longer characters.
_BYTE_CLASS = np.zeros(256, np.uint8)
_BYTE_CLASS[0x21:0x7F] = 3
_BYTE_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_BYTE_CLASS[0x30:0x3A] = 2
_BYTE_CLASS[0x27] = 0
_encoders: dict[str, "Encoder"] = {}


class _Chunks(dict):
    """Chunk (what stands between two white spaces) -> its ids as little-endian
    unsigned 32-bit bytes; a missing one is encoded and kept. A full dictionary
    becomes the old generation, from which what is used again moves over."""

    def __init__(self, encode, before: str = "", most: int = CACHE_CHUNKS):
        super().__init__()
        self.encode, self.before, self.most, self.old = encode, before, most, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(chunk)
        if out is None:
            out = self.encode(self.before + chunk)
        self[chunk] = out
        return out


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        pattern = _PATTERNS.get(path.rsplit("/", 1)[-1])
        self.split = re.compile(pattern[0]).findall if pattern else None
        self.lower = bool(pattern and pattern[1])
        self.words = _Chunks(self.merge)
        self.first, self.spaced = _Chunks(self.plain), _Chunks(self.plain, " ")
        self.pieces = _Chunks(self.piece, b"", CACHE_PIECES if self.lower else CACHE_WORDS)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def plain(self, text: str) -> bytes:
        """Ids of a plain (and lower-case, if the vocabulary is) text, word by
        word through the library's merges."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def merge(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_FORM))]).tobytes()

    def merged(self, shown: str) -> bytes:
        """Ids of a word in the byte-level form."""
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def piece(self, piece: bytes) -> bytes:
        """:meth:`plain` of a piece: most are one word, which needs no splitting."""
        text = piece.decode()
        if self.lower:  # a word and the white space after it
            word = text.rstrip()
            return self.merge(word) if _WORD.fullmatch(word) else self.plain(text)
        word = text[1:] if text[0] == " " else text
        if word.isalpha() and _WORD.fullmatch(word):
            return self.merged(_SPACE + word if word is not text else word) if word.isascii() else self.merge(text)
        return self.plain(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of one whole text (null: empty) as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if self.split is None or "<|" in text or not _PLAIN.fullmatch(text):
            return self.whole(text)
        if self.lower:  # white space is dropped and parts any two words
            return b"".join(map(self.first.__getitem__, text.lower().split()))
        if any(x in text for x in _APART):
            return self.plain(text)
        lines = []  # a lone line end is a word of its own; a lone space belongs to the next word
        for line in text.split("\n"):
            head, _, rest = line.partition(" ")
            lines.append(self.first[head] + b"".join(map(self.spaced.__getitem__, rest.split(" "))) if _ else self.first[head])
        return self.first["\n"].join(lines)

    def _in_pieces(self, text: str) -> bool:
        """Whether the text is one of words with a space before and lone line ends; where
        white space is dropped, it may be any."""
        if self.split is None or "<|" in text or not self.lower and any(x in text for x in _APART):
            return False
        return _PLAIN.fullmatch(text) is not None

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """:meth:`encode` of each text. Texts of plain words are cut together, as bytes:
        a piece begins at a space, at a line end and after it and where letters, digits and
        marks meet, or where white space is dropped after any. Different pieces are encoded once, and the ids of all are gathered by their pieces' numbers."""
        out: list = [None] * len(texts)
        cut = [i for i, t in enumerate(texts) if t and self._in_pieces(t)]
        for i in set(range(len(texts))).difference(cut):
            out[i] = self.encode(texts[i])
        slab = SLAB_CHARS if self.lower else SLAB_CHARS // 4  # beside the ids of a whole group to be packed
        for lo, hi in text_slabs([texts[i] for i in cut], slab):
            parts = [(texts[i].lower() if self.lower else texts[i]).encode() for i in cut[lo:hi]]
            data = b"".join(parts)
            raw = np.frombuffer(data, np.uint8)
            if self.lower:
                space = (raw == 32) | (raw == 10) | (raw == 13) | (raw == 9)
                begins = ~space
                begins[1:] &= space[:-1]
            else:
                begins = (raw == 32) | (raw == 10)
                begins[1:] |= raw[:-1] == 10
                kind = _BYTE_CLASS[raw]  # a word of the pattern ends where the class changes
                begins[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0)
            at = np.cumsum([0] + [len(p) for p in parts])
            begins[at[:-1]] = True
            offsets = np.append(np.flatnonzero(begins), len(raw))
            pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            codes = pieces.indices.to_numpy()
            known = list(map(self.pieces.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()))
            size = np.fromiter(map(len, known), np.int64, len(known)) // 4
            first, ids = np.cumsum(size) - size, np.frombuffer(b"".join(known), "<u4")
            n = size[codes]
            ends = np.cumsum(n)
            ids = ids[np.arange(int(ends[-1])) + np.repeat(first[codes] - (ends - n), n)]
            place = np.concatenate([np.zeros(1, np.int64), ends])[np.searchsorted(offsets, at)]
            for i, a, b in zip(cut[lo:hi], place[:-1].tolist(), place[1:].tolist()):
                out[i] = ids[a:b].tobytes()
        return out


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
