"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one encoding, and that encoding has one last token:
the only token ending there that is compatible with the last token of the prefix
before it. An automaton over the vocabulary (the suffix matches of each prefix)
proposes the tokens, a walk along the merges of both tokens tests a pair, and the
back-pointers from the whole word give exactly the ids that merging in rank order
would give, in one pass over the word.

The work is per row and needs no shuffle. A worker keeps a bounded dictionary of
pieces it has encoded; text is cut for it only where a token can never span.

Null texts count as empty. Special tokens in a text become their own id, as the
tokenizers library does by default. Repeated rows are encoded each; an empty table
gives no row. Texts of any length are encoded whole, one at a time where they are
long. Extra columns are not touched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumaprof.llm.common import slices

#: Entries of each of the two generations that a worker's dictionary of encoded pieces keeps.
CACHE_ENTRIES = 200_000
#: Pieces longer than this are encoded but not kept.
CACHE_PIECE = 48
#: The first code point for symbols that end a word.
_WORD_END = 0x100000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class PrefixEncoder:
    """Ids of one word, given as symbols, by the unique last token of every prefix."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None = None):
        def symbols(token: str) -> str:
            if suffix and token.endswith(suffix):
                body = token[:-len(suffix)]
                return body[:-1] + chr(_WORD_END + ord(body[-1]))
            return token

        ids = {symbols(t): i for t, i in vocab.items()}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(merges):
            left, right = (symbols(p) for p in (pair.split(" ") if isinstance(pair, str) else pair))
            made = ids[left + right]
            self.merge.setdefault((ids[left], ids[right]), rank)
            if made not in self.rank:
                self.rank[made] = rank
                self.parts[made] = (ids[left], ids[right])
        self.length = {i: len(t) for t, i in ids.items()}
        self.as_bytes = {i: i.to_bytes(4, "little") for i in ids.values()}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            if len(token) == 1 or (i in self.parts and self.stays_apart(*self.parts[i], self.rank[i])):
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()

    def stays_apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge across the border of a and b comes up before rank ``before``.

        Walks back in time: the token formed later is replaced by its part at the
        border, and a merge across must not have been due before that token formed.
        Of equal ranks the left one is merged first.
        """
        rank, merge = self.rank, self.merge
        across = merge.get((a, b))
        if across is not None and across < before:
            return False
        while True:
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a, due = self.parts[a][1], ra
            else:
                b, due = self.parts[b][0], rb + 1
            across = merge.get((a, b))
            if across is not None and across < due:
                return False

    def packed_ids(self, word: str) -> bytes:
        """The ids of a word as little-endian unsigned 32-bit integers."""
        last = [-1] * (len(word) + 1)
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(word):
            if last[end + 1] >= 0:
                continue
            before = end + 1 - size
            if before:
                key = last[before] << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= 2 * CACHE_ENTRIES:
                        pairs.clear()
                    fits = pairs[key] = self.stays_apart(last[before], token)
                if not fits:
                    continue
            last[end + 1] = token
        at, size, as_bytes = len(word), self.length, self.as_bytes
        if at and size[last[at]] == at:
            return as_bytes[last[at]]
        found = []
        while at:
            token = last[at]
            found.append(as_bytes[token])
            at -= size[token]
        found.reverse()
        return b"".join(found)


class Kept(dict):
    """A dictionary that fills itself; when it is full it starts anew, and takes over what is asked for again."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries
        self.before: dict = {}

    def __missing__(self, piece):
        value = self.before.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= CACHE_PIECE:
            if len(self) >= self.entries:
                self.before = dict(self)
                self.clear()
            self[piece] = value
        return value


class ByteBpe:
    """Whole texts to packed ids and back for a byte-level vocabulary file without a normaliser."""

    #: Only for texts of code points below 0x250, where all libraries agree on the classes.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    PLAIN = re.compile("[\0-ɏ]*\\Z")
    #: A token spans a blank only as its first character, so a text may be cut before a blank that follows one of these.
    ODD = re.compile("[^!-~¡-ɏ] ")
    CUT = re.compile("(?<=[!-~¡-ɏ]) ")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        symbols = byte_symbols()
        self.table = {b: symbols[b] for b in range(256)}
        self.encoder = PrefixEncoder(model["vocab"], model["merges"])
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.words = Kept(lambda word: self.encoder.packed_ids(word.encode().decode("latin-1").translate(self.table)))
        self.after_blank = Kept(lambda piece: self.piece(" " + piece))

    def piece(self, piece: str) -> bytes:
        if self.PLAIN.match(piece):
            return b"".join(map(self.words.__getitem__, self.SPLIT.findall(piece)))
        return b"".join([self.encoder.packed_ids(word) for word, _ in self.splitter.pre_tokenize_str(piece)])

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            parts = self.special_split.split(text)
            return b"".join([self.special[p].to_bytes(4, "little") if n % 2 else self.plain(p) for n, p in enumerate(parts) if p])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        pieces = text.split(" ") if self.ODD.search(text) is None else self.CUT.split(text)
        found = list(map(self.after_blank.__getitem__, pieces))
        found[0] = self.piece(pieces[0])
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        whole = memoryview(ids).cast("I")
        return b"".join(map(self.bytes_of.__getitem__, whole)).decode("utf-8", "replace")


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path)


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the binary column ``ids``: the text's ids as little-endian unsigned 32-bit integers."""
    return _mapped(docs, tokenizer_path, text, {ids: ("binary", lambda bpe, value: bpe.encode(value or ""))})


def decode(docs: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of packed ids; null ids decode to the empty text."""
    return _mapped(docs, tokenizer_path, ids, {text: ("string", lambda bpe, value: bpe.decode(value or b""))})


def round_trip(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids",
               decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts."""
    rows = docs.drop(ids, decoded)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c != text), f"`{ids}` binary", f"`{decoded}` string"])
    others = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_path)
        for batch in batches:
            for part in slices(batch, text):
                coded = [bpe.encode(v or "") for v in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), pa.array(coded, pa.binary()),
                     pa.array([bpe.decode(c) for c in coded], pa.string())], [*others, ids, decoded])

    return rows.mapInArrow(run, schema)


def _mapped(rows: DataFrame, path: str, source: str, made: dict) -> DataFrame:
    (name, (kind, function)), = made.items()
    rows = rows.drop(name) if name != source else rows
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{name}` {kind}"])
    names = [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        arrow = pa.binary() if kind == "binary" else pa.string()
        for batch in batches:
            for part in slices(batch, source):
                values = [function(bpe, v) for v in part.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, arrow)], names)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document its number of ids and the hashes of its packed ids and of its decoded text."""
    coded = round_trip(docs.select("doc_id", "text"), tokenizer_path)
    return coded.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
