"""BPE, packing and token shards against the tokenizers library and brute force."""

import hashlib
import random
import struct
from collections import Counter
from pathlib import Path
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumaprof.llm import bpe, packing, token_shards
from lumaprof.llm.word_ids import WordIds

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(WORD)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(spark, odd_docs, odd_texts, byte_tokenizer):
    found = Counter(map(tuple, bpe.digests(odd_docs, BYTE).collect()))
    expected = Counter()
    for row in odd_docs.select("doc_id", "text").collect():
        ids = ids_of(byte_tokenizer, row.text)
        decoded = byte_tokenizer.decode(ids, skip_special_tokens=False)
        expected[(row.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                  hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert found == expected


def test_bpe_encode_and_decode_keep_other_columns(spark, odd_docs):
    coded = bpe.decode(bpe.encode(odd_docs, BYTE), BYTE)
    assert coded.columns == [*odd_docs.columns, "ids", "decoded"]
    assert coded.filter("coalesce(text, '') <> decoded").count() == 0


def test_prefix_encoder_against_the_library_on_random_pieces(byte_tokenizer):
    random.seed(17)
    own = bpe.ByteBpe(BYTE)
    for _ in range(1500):
        text = "".join(random.choices("aeinorst ABC'.,09\n\té", k=random.randrange(1, 30)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids_of(byte_tokenizer, text), repr(text)


def test_word_ids_equal_the_library(odd_texts, word_tokenizer):
    random.seed(19)
    own = WordIds(WORD)
    for text in [t or "" for t in odd_texts] + ["".join(random.choices("aeinorst ABC'.,09\n\téÉ×", k=random.randrange(1, 30))) for _ in range(1500)]:
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == ids_of(word_tokenizer, text), repr(text[:80])


def test_word_ids_of_a_column_ask_once_for_each_piece(odd_texts, word_tokenizer):
    own, asked = WordIds(WORD), Counter()
    piece = own._piece
    own._piece = lambda p: (asked.update([p]), piece(p))[1]
    texts = odd_texts * 3 + ["a\x0bb\x0cc\rd"]
    for column in (pa.array(texts), pa.array(["cut off", *texts, "cut off"]).slice(1, len(texts))):
        asked.clear()
        found = own.encode_all(column)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [ids_of(word_tokenizer, t) for t in texts]
        assert set(asked.values()) == {1} and b"cut" not in asked
    assert own.encode_all(pa.array([], pa.string())) == [] and own.encode_all(pa.array([None, "", " \n"])) == [b""] * 3


def check_packing(rows, docs, tokenizer, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    covered, wanted = Counter(), Counter()
    for row in docs:
        ids = ids_of(tokenizer, row.text) + [2]
        wanted.update((row.doc_id, n) for n in range(len(ids)))
        for r in by_doc.get((row.doc_id, len(ids)), []):
            assert r.ids_crc32 == crc32(struct.pack(f"<{r.length}I", *ids[r.start:r.start + r.length]))
    for r in rows:
        covered.update((r.doc_id, n) for n in range(r.start, r.start + r.length))
    return covered, wanted


def test_packing_covers_every_id_once(spark, odd_docs, word_tokenizer):
    docs = odd_docs.filter("doc_id is not null")
    rows = packing.pack(docs, WORD, capacity=256, batch_windows=8).collect()
    covered, wanted = check_packing(rows, docs.collect(), word_tokenizer, 256)
    assert covered == wanted
    assert packing.pack(odd_docs, WORD).filter("doc_id is null").count() >= 2


def test_packing_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    loads = packing.pack(docs, WORD, with_ids=True).selectExpr("sequence_id", "length", "octet_length(ids) = 4 * length as whole").toPandas()
    assert loads["whole"].all()
    sums = loads.groupby("sequence_id")["length"].sum()
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sums)
    assert sums.max() <= 4096 and padding < 0.01 * sums.sum()


def test_packing_gives_rows_before_many_pieces_are_held(spark, monkeypatch):
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    taken = []
    docs = type("Docs", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, run, schema: taken.append(run)})()
    packing.pack(docs, WORD, capacity=64, batch_windows=4)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": ["one two three four"] * 4000})
    parts = list(taken[0]([batch]))
    assert max(p.num_rows for p in parts) < 2 * packing.PIECES and sum(sum(p.column("length").to_pylist()) for p in parts) == 4000 * 5


def test_differencing_balances():
    random.seed(23)
    sizes = [random.randrange(1, 900) for _ in range(400)]
    loads = np.bincount(packing.difference(sizes, 40), sizes, minlength=40)
    assert loads.sum() == sum(sizes) and loads.max() - loads.min() <= 16
    assert packing.difference([5], 1).tolist() == [0]
    # Sizes that do not fit together: the window count rises and pieces are cut.
    packer = packing.Packer(100, 10, 2)
    for n in range(30):
        packer.add(n, bytes(4 * 67))
    packer.finish()
    loads = Counter()
    for piece, sequence, _ in packer.out:
        loads[sequence] += piece[2]
    assert max(loads.values()) <= 100 and sum(loads.values()) == 30 * 67 and len(loads) <= 26


def test_packing_of_nothing(spark, no_docs):
    assert packing.pack(no_docs, WORD).count() == 0 and bpe.digests(no_docs, BYTE).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 1000, 4096, 5000])
def test_permutation_is_a_bijection(count):
    slots = token_shards.permuted(np.arange(count), count, 7)
    assert sorted(slots.tolist()) == list(range(count))
    if count >= 1000:
        assert slots.tolist() != token_shards.permuted(np.arange(count), count, 8).tolist()
        assert abs(np.corrcoef(np.arange(count), slots)[0, 1]) < 0.1


def test_shards_round_trip(spark, odd_docs, word_tokenizer, tmp_path):
    path = str(tmp_path / "shards")
    docs = odd_docs.coalesce(2)
    total = token_shards.materialised(docs, WORD, path, length=64, shard_sequences=16)
    rows = token_shards.read(spark, path, length=64, shard_sequences=16).collect()
    assert sorted(r.slot for r in rows) == list(range(total))
    assert {(r.slot, r.shard, r.byte_offset) for r in rows} == {(s, s // 16, s % 16 * 129) for s in range(total)}
    for folder in Path(path).glob("shard=*"):
        files = list(folder.glob("part-*"))
        assert len(files) == 1 and files[0].stat().st_size % 129 == 0
    cut = Counter(bytes(r.ids) for r in token_shards.sequences(docs, WORD, 64).collect())
    assert Counter(bytes(r.ids) for r in rows) == cut
    ids = Counter(np.concatenate([np.frombuffer(i, "<u2") for i in cut.elements()]).tolist())
    wanted = Counter(x for row in docs.collect() for x in [*ids_of(word_tokenizer, row.text), 2])
    assert wanted <= ids and set(ids - wanted) <= {2}
    resumed = token_shards.read(spark, path, length=64, shard_sequences=16, from_slot=37).collect()
    assert sorted(r.slot for r in resumed) == list(range(37, total))


def test_shards_of_nothing(spark, no_docs):
    assert token_shards.ordered(no_docs, WORD).count() == 0
