"""Quality scores from compression with a good and a bad dictionary.

Two zstandard dictionaries are built from texts labelled good and bad. A text is
compressed whole with both, in pieces of ``PIECE_BYTES`` that each have the full
dictionary in reach, so that a long text counts to its end; the difference of the sizes over their sum says which
side it resembles, and the smaller size over the text's own length how regular it
is. A logistic calibration turns both into a score between 0 and 1. The labelled rows fall into two folds with a
pair of dictionaries each: the calibration measures a labelled text with the pair of
the other fold, and a score is the mean (of logits) over both pairs.

The labelled sample is bounded: ``per_class`` rows of each label, lowest id hashes
first, and of the pieces of ``SAMPLE_BYTES`` into which their whole texts are cut,
``samples`` of each label and fold, lowest hashes first; nothing else is. The calibration
measures whole texts and weighs the sampled rows so that
the classes have their shares of all rows that may be learned from. Rows whose ``crc32(id) mod 4`` is 2 are never
learned from. Scores use the text alone.

Null and empty texts get the score of an empty text. Folds alternate within a label, so
two rows of it fill both; with a single row both folds share one pair of dictionaries.
Where some group has too little text to train on, the texts themselves, repeated to
one length, are the dictionaries of all groups (``trained`` is false). Without rows of
both labels every score is the share of good labels (0.5 without any). Ids with differing
labels count as good if at least half of them are; null labels and ids are not
learned from. Repeated rows get equal scores; an empty table gives no row. ``kept``
returns the columns of its input, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.llm.common import slices, written

#: Labelled rows of each class that are learned from, at most.
PER_CLASS = 3000
#: Pieces of whole labelled texts that train a dictionary: their bytes, and how many of a label and fold at most.
SAMPLE_BYTES, SAMPLES = 4000, 3000
DICTIONARY_BYTES, LEVEL = 112_640, 3
#: Bytes of a text that are compressed at once; a text's sizes are the sums over its pieces.
PIECE_BYTES = 16_384


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


@dataclass(frozen=True)
class Model:
    """Pairs of a good and a bad dictionary, one pair per fold; without any, all scores are the prior."""

    pairs: tuple[tuple[bytes, bytes], ...]
    weights: tuple[float, ...]
    prior: float
    trained: bool = False

    def compressors(self) -> list[list[zstandard.ZstdCompressor]]:
        return [[_compressor(d) for d in pair] for pair in self.pairs]


def _dictionaries(groups: list[list[bytes]]) -> tuple[list[bytes], bool]:
    """A dictionary for each group of samples, all made the same way so that they compare; and whether they are trained."""
    try:
        return [zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes() for samples in groups], True
    except zstandard.ZstdError:  # too few or too short samples in some group
        joined = [b"\n".join(samples) or b"\n" for samples in groups]
        size = max(8, min(DICTIONARY_BYTES, max(map(len, joined))))
        return [(text * -(-size // len(text)))[:size] for text in joined], False


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_dict_id=False)


def sizes(compressors: list[zstandard.ZstdCompressor], text: bytes) -> tuple[int, int, int]:
    good, bad = compressors
    pieces = [text[at:at + PIECE_BYTES] for at in range(0, max(1, len(text)), PIECE_BYTES)]
    return sum(len(good.compress(p)) for p in pieces), sum(len(bad.compress(p)) for p in pieces), len(text)


def features(measured: np.ndarray) -> np.ndarray:
    """Rows of (size with the good dictionary, with the bad one, bytes) as inputs of the calibration."""
    good, bad, length = measured.astype(float).reshape(-1, 3).T
    lean = 20 * np.clip((bad - good) / np.maximum(1, bad + good), -0.5, 0.5)
    regular = 5 * np.clip(np.minimum(good, bad) / np.maximum(1, length), 0, 1)
    return np.stack([np.ones_like(lean), lean, regular, regular ** 2, lean * regular], axis=1)


def logistic(inputs: np.ndarray, labels: np.ndarray, mass: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of the inputs; ``mass`` is how many rows each row counts for."""
    weights = np.zeros(inputs.shape[1])
    for _ in range(60):
        guess = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        slope = inputs.T @ (mass * (labels - guess)) - ridge * weights
        curve = inputs.T @ (inputs * (mass * guess * (1 - guess))[:, None]) + ridge * np.eye(weights.size)
        step = np.linalg.solve(curve, slope)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return weights


def scores(model: Model, compressors: list, texts: list[bytes]) -> np.ndarray:
    if not compressors:
        return np.full(len(texts), model.prior)
    weights = np.array(model.weights)
    logits = [features(np.array([sizes(pair, t) for t in texts], np.int64)) @ weights for pair in compressors]
    return 1 / (1 + np.exp(-np.clip(np.mean(logits, axis=0), -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, samples: int = SAMPLES) -> Model:
    """Learn from at most ``per_class`` labelled rows of each class, none of them held out.

    Of their texts' pieces at most ``samples`` of each class and fold train the dictionaries.
    """
    marked = (labels.filter("doc_id is not null and quality is not null").filter(~held_out())
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_label")))
    marked = written(marked.join(docs.select("doc_id"), "doc_id", "left_semi"), "marked")
    total = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = None
    for label in (1, 0):
        some = marked.filter(F.col("_label") == label).orderBy(order, "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * per_class rows of an id and a label.
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    # The window is over the sampled rows of a label, ``per_class`` at most.
    fold = (F.row_number().over(Window.partitionBy("_label").orderBy(order, "doc_id")) % 2).cast("int")
    sample = written(chosen.select("_label", fold.alias("_fold"), order.alias("_order"),
                                   F.coalesce("text", F.lit("")).cast("binary").alias("_text")), "labelled")
    counts = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    prior = total.get(1, 0) / sum(total.values()) if total else 0.5
    if len(counts) < 2:
        return Model((), (), prior)
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length("_text"), F.lit(1)), F.lit(SAMPLE_BYTES))
    pieces = sample.select("_label", "_fold", "_order", "_text", F.explode(starts).alias("_at")).withColumn("_rank", F.xxhash64("_order", "_at"))
    texts: dict[tuple[int, int], list[bytes]] = {}
    for label in (1, 0):
        for side in (0, 1):
            group = pieces.filter((F.col("_label") == label) & (F.col("_fold") == side))
            group = group.select("_rank", "_at", F.substring("_text", F.col("_at"), F.lit(SAMPLE_BYTES)).alias("t"))
            texts[label, side] = [bytes(r["t"]) for r in group.orderBy("_rank", "_at", "t").limit(samples).collect()]
    if all(texts.values()):
        made, trained = _dictionaries([texts[label, side] for side in (0, 1) for label in (1, 0)])
        pairs = ((made[0], made[1]), (made[2], made[3]))
    else:
        made, trained = _dictionaries([texts[label, 0] + texts[label, 1] for label in (1, 0)])
        pairs = ((made[0], made[1]),) * 2

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = [[_compressor(d) for d in pair] for pair in pairs]
        for batch in batches:
            # What calibrates a text comes from dictionaries that have not seen its fold.
            found = [sizes(compressors[1 - f], t) for f, t in zip(batch.column("_fold").to_pylist(), batch.column("_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), *(pa.array([f[n] for f in found], pa.int64()) for n in range(3))],
                                             ["label", "good", "bad", "length"])

    rows = sample.select("_label", "_fold", "_text").mapInArrow(measure, "label int, good bigint, bad bigint, length bigint")
    measured = rows.orderBy("label", "good", "bad", "length").toPandas()
    # Sampled rows stand for all of their class; as many in all as were sampled.
    mass = {label: n / counts[label] * sum(counts.values()) / sum(total.values()) for label, n in total.items()}
    weights = logistic(features(measured[["good", "bad", "length"]].to_numpy()), measured["label"].to_numpy(float), measured["label"].map(mass).to_numpy(float))
    return Model(pairs, tuple(weights.tolist()), prior, trained)


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(model, compressors, texts))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array(scores(model, compressors, texts) >= threshold))

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
