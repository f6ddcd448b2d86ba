"""Ids of whole texts by a word-level BPE file (lower case, word ends, white space dropped).

The tokenizers library gives the ids. No token of this kind of vocabulary spans
white space, so the texts of a slice are split at blanks and dictionary-encoded in
Arrow: each distinct piece of a slice is encoded once and its ids are taken by
index. Pieces of plain Latin characters skip the library's normaliser and splitter,
which do nothing to them but lower-case and cut at class borders; their words are
kept per worker in bounded dictionaries.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from lumaprof.llm.bpe import CACHE_ENTRIES, Kept, byte_symbols


def _values(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).tolist()
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class WordIds:
    """Text bytes to ids, as little-endian unsigned 32-bit integers."""

    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+\\Z")
    MARKS = frozenset([b".", b",", b";", b":", b"!", b"?", b")", b'"'])
    CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = dict(enumerate(byte_symbols()))
        self.as_bytes = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.words = Kept(self._word, CACHE_ENTRIES // 2)
        self.ascii_words = Kept(lambda word: self._ids(word.decode()), CACHE_ENTRIES // 2)

    def _ids(self, symbols: str) -> bytes:
        as_bytes = self.as_bytes
        return b"".join([as_bytes[t.id] for t in self.model.tokenize(symbols)])

    def _word(self, word: str) -> bytes:
        return self._ids(word.encode().decode("latin-1").translate(self.table))

    def _piece(self, piece: bytes) -> bytes:
        # ASCII letters stand for themselves in the vocabulary, and so does one mark after them.
        if piece.isalpha():
            return self.ascii_words[piece.lower()]
        if piece[:-1].isalpha() and piece[-1:] in self.MARKS:
            return self.ascii_words[piece[:-1].lower()] + self.ascii_words[piece[-1:]]
        text = piece.decode()
        if self.PLAIN.match(text) and "<|" not in text:
            words = [text.lower()] if text.isalpha() else self.CUT.findall(text.lower())
            return b"".join(map(self.words.__getitem__, words))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self._piece, text.split()))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """What ``encode`` gives for each text of a column; null texts count as empty."""
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        pieces = split.flatten().cast(pa.binary()).dictionary_encode()
        # Ids of a long text may need more than 32-bit offsets.
        ids = pa.array(map(self._piece, _values(pieces.dictionary)), pa.large_binary()).take(pieces.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1, 8 * ids.offset)[split.offsets.to_numpy()].tolist()
        data = data or pa.py_buffer(b"")
        return [data[a:b].to_pybytes() for a, b in zip(ends, ends[1:])]


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    """One per worker process."""
    return WordIds(path)
