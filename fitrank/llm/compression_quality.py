"""Quality scores by compression with two zstandard dictionaries.

One dictionary is built from windows of well rated texts, one from windows of badly rated texts.
Every text is compressed window by window with either; the difference of the two sizes over the
length of the text is calibrated to a score by logistic regression.

The dictionaries and the calibration are fitted on bounded samples of the labelled rows (see the
parameters); which rows, is decided by a hash of the id.  Scoring reads whole texts.

Defined results: an empty or null text has difference 0 and the score that belongs to it; if only
one label or none was there to learn from, every score is that label (0.5 for none); several labels
of one document count as separate examples; rows with null labels or ids teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitrank.llm.batches import as_batch, hash_place, hash_share, narrow, text_slices

WINDOW = 2048  # bytes that are compressed at once
DICTIONARY_BYTES = 110_000
DICTIONARY_WINDOWS = 3000  # expected number of windows for each dictionary
CALIBRATION_ROWS = 6000  # expected number of texts to calibrate on
LEVEL = 3


class Model(NamedTuple):
    """Dictionaries of good and bad text (None: nothing to tell apart), weight and offset."""

    good: bytes | None
    bad: bytes | None
    weight: float
    offset: float


def windows(data: bytes) -> list[bytes]:
    return [data[at : at + WINDOW] for at in range(0, len(data), WINDOW)]


def compressor(dictionary: bytes):
    import zstandard

    loaded = zstandard.ZstdCompressionDict(dictionary)
    loaded.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL,
        dict_data=loaded,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    ).compress


def differences(texts: list[str], good, bad) -> np.ndarray:
    """Bytes saved by the good dictionary over the bad one, for each byte of text."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        saved = sum(len(bad(part)) - len(good(part)) for part in windows(data))
        out[i] = saved / max(len(data), 1)
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and offset by Newton steps, with a small ridge on the weight."""
    scale = x.std() or 1.0
    inputs = np.stack([x / scale, np.ones(len(x))], axis=1)
    ridge, beta = np.array([1e-2, 0.0]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(inputs @ beta, -30, 30)))
        curve = (inputs * (p * (1 - p))[:, None]).T @ inputs + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, inputs.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def build_dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary; the parts themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, k=100, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY_BYTES]


def learn(docs: DataFrame, labels: DataFrame, use: Column) -> Model:
    """Fit on the labelled rows where ``use``, an expression of doc_id, holds.

    Rows are dealt by a hash of the id: one half gives the dictionaries (one window of each text,
    at a place that the hash names), the other half the calibration (whole texts).
    """
    rated = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & use
    )
    counts = {r["label"]: r["count"] for r in rated.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(None, None, 0.0, {(): 0.0, (0,): -40.0, (1,): 40.0}[tuple(counts)])
    for_dictionary = hash_place("half") < hash_share(1, 2)
    by_label = F.when(F.col("label") == 1, hash_share(2 * DICTIONARY_WINDOWS, counts[1])).otherwise(
        hash_share(2 * DICTIONARY_WINDOWS, counts[0])
    )
    chosen = rated.filter(
        F.when(for_dictionary, hash_place("row") < by_label).otherwise(
            hash_place("row") < hash_share(2 * CALIBRATION_ROWS, sum(counts.values()))
        )
    ).withColumn("for_dictionary", for_dictionary)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    # The broadcast side has about CALIBRATION_ROWS + 2 * DICTIONARY_WINDOWS rows at any scale.
    sample = texts.join(F.broadcast(chosen), "doc_id")

    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    place = F.pmod(F.xxhash64("doc_id", F.lit("window")), room).cast("int") + 1
    parts = (
        sample.filter("for_dictionary")
        .select("doc_id", "label", F.substring("text", place, F.lit(WINDOW)).alias("part"))
        .distinct()
        .collect()
    )
    by_class: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(parts):
        by_class[row["label"]].append(row["part"].encode("utf-8", "surrogatepass")[:WINDOW])
    good, bad = build_dictionary(by_class[1]), build_dictionary(by_class[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_good, by_bad = compressor(good), compressor(bad)
        for part, texts in text_slices(batches, "text"):
            saved = differences(texts, by_good, by_bad)
            yield as_batch({"label": part.column("label"), "saved": pa.array(saved)})

    measured = (
        sample.filter(~F.col("for_dictionary"))
        .select("label", "text")
        .mapInArrow(run, "label int, saved double")
        .toPandas()
        .sort_values(["saved", "label"])
    )
    label = measured["label"].to_numpy(np.float64)
    if len(set(label)) < 2:
        rate = counts[1] / sum(counts.values())
        return Model(good, bad, 0.0, float(np.log(rate / (1 - rate))))
    return Model(good, bad, *logistic(measured["saved"].to_numpy(), label))


def score(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``saved`` (the difference) and ``score``, the calibrated chance of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.good is not None and (compressor(model.good), compressor(model.bad))
        for part, texts in text_slices(batches, "text"):
            saved = differences(texts, *tools) if tools else np.zeros(len(texts))
            chance = 1 / (1 + np.exp(-np.clip(model.weight * saved + model.offset, -40, 40)))
            yield as_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "saved": pa.array(saved),
                    "score": pa.array(chance),
                }
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return narrow(docs, id_column, text_column).mapInArrow(
        run, f"doc_id {kind}, saved double, score double"
    )
