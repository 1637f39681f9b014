"""Language identification with string kernels.

Kernel: the blended-spectrum presence kernel. A text's set holds its distinct byte n-grams of 1 to MAX_N
bytes (of the lower-cased UTF-8 text, whole), hashed to DIMS places; k(x, y) is the size of the intersection
divided by the geometric mean of the sizes. Nystroem: LANDMARKS texts, as many of each language as possible,
span the feature space. One-versus-rest kernel ridge regression is solved in it on the driver, over a sample
of at most SAMPLE labelled texts (a bound of the training alone, as many of each language as possible, chosen by
a hash of doc_id; the texts are read whole, and what is collected is DIMS bits of each). Scoring is one matrix product of a block's presence
matrix with the landmarks' and one with the weights.

Edge cases: a text that is null or has no letter is `und` with score 0, as is every text if nothing can be
learned. Ties go to the language that sorts first. Rows that repeat a doc_id, or have none, are scored one by
one. Extra columns are ignored. A text of any length is read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MAX_N = 3
DIMS = 1 << 15
SAMPLE = 2000
LANDMARKS = 96
RIDGE = 1e-3
#: Texts whose presence is held as floats at a time.
ROWS = 128
UNKNOWN = "und"


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, DIMS) float32 of 0 and 1: which hashed n-grams stand in each row."""
    n_rows = len(offsets) - 1
    out = np.zeros(n_rows * DIMS, np.float32)
    base = np.repeat(np.arange(n_rows, dtype=np.int64) * DIMS, np.diff(offsets))
    code = np.zeros(len(data), np.uint32)
    for n in range(1, MAX_N + 1):
        if len(data) < n:
            break
        code = code[: len(data) - n + 1] * np.uint32(256) + data[n - 1 :]
        place = ((code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMS.bit_length() + 1)
        own = base[: len(code)]
        inside = own == base[n - 1 :]
        out[own[inside] + place[inside]] = 1
    return out.reshape(n_rows, DIMS)


def sized(x: np.ndarray) -> np.ndarray:
    """Square roots of the rows' set sizes, 1 at least."""
    return np.sqrt(np.maximum(x.sum(1, dtype=np.float64), 1))


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Presence as floats from packed bits."""
    return np.unpackbits(bits, axis=1).astype(np.float32)


def fit(bits: np.ndarray, langs: list[str]) -> dict | None:
    """The model: landmarks (DIMS, m), weights (m, classes) and the languages in order.

    bits: packed presence of the sample, of which only ROWS are floats at a time.
    """
    classes = sorted(set(langs))
    if not classes:
        return None
    y = np.array([classes.index(x) for x in langs])
    each = max(1, LANDMARKS // len(classes))
    marks = np.concatenate([np.flatnonzero(y == c)[:each] for c in range(len(classes))])
    landmarks = unpacked(bits[marks])
    landmarks /= sized(landmarks)[:, None].astype(np.float32)
    kernel = []
    for a in range(0, len(bits), ROWS):
        x = unpacked(bits[a : a + ROWS])
        kernel.append((x @ landmarks.T).astype(np.float64) / sized(x)[:, None])
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.c_[np.concatenate(kernel) @ root, np.ones(len(bits))]
    target = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    weight = (len(y) / (len(classes) * np.bincount(y, minlength=len(classes))))[y][:, None]
    gram = features.T @ (features * weight)
    beta = np.linalg.solve(gram + RIDGE * len(y) * np.eye(len(gram)), features.T @ (target * weight))
    return {"landmarks": np.ascontiguousarray(landmarks.T), "weights": root @ beta[:-1], "bias": beta[-1], "classes": classes}


def scores(model: dict, sets: np.ndarray) -> np.ndarray:
    """(rows, classes) from 0 to 1."""
    kernel = (sets @ model["landmarks"]).astype(np.float64) / sized(sets)[:, None]
    return np.clip((kernel @ model["weights"] + model["bias"] + 1) / 2, 0, 1)


def _lowered(docs: DataFrame) -> DataFrame:
    """text as lower-cased; null where it has no letter."""
    text = docs["text"].cast("string")
    return docs.withColumn("_lower", F.when(text.rlike(r"\p{L}"), F.lower(text)))


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Fits the model on docs(doc_id, text, lang), of which at most `sample` are used: as many of each language as possible.

    The documents of a language come in the order of a hash of doc_id, and the languages in turn. Of the rows that
    share a doc_id (or have none) one is learned from.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.xxhash64("doc_id").alias("_order"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # Of a language with many documents only those with a hash in a part that holds some four times the sample are put in order.
    ids = rows.select("lang", "_order")
    part = F.pmod("_order", F.lit(1 << 30)) * F.col("n") < F.lit(4.0 * sample * (1 << 30))
    some = ids.join(ids.groupBy("lang").agg(F.count("*").alias("n")), "lang").where(part).select("lang", "_order").distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("_order"))
    chosen = some.withColumn("turn", turn).where(F.col("turn") <= sample).orderBy("turn", "_order", "lang").limit(sample).toPandas()
    if chosen.empty:
        return None

    def make(batch):
        data, offsets = C.column_bytes(batch.column("_lower"))
        for a, b in C.blocks(offsets, rows=ROWS):
            sets = presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            bits = np.packbits(sets.astype(bool), axis=1)
            yield pa.record_batch([batch.column("_order").slice(a, b - a), batch.column("lang").slice(a, b - a), pa.array([x.tobytes() for x in bits], pa.binary())], ["_order", "lang", "bits"])

    # At most `sample` hashes: they filter the scan.
    some = _lowered(rows.where(F.col("_order").isin([int(x) for x in chosen["_order"].unique()]))).where(F.col("_lower").isNotNull())
    found = C.map_texts(some.select("_order", "lang", "_lower"), make, "_order long, lang string, bits binary")
    got = found.groupBy("_order").agg(F.min(F.struct("lang", "bits")).alias("x")).select("_order", "x.lang", "x.bits").toPandas()
    if got.empty:
        return None
    got = got.sort_values("_order", kind="stable")
    return fit(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), DIMS // 8), got["lang"].tolist())


def predict(docs: DataFrame, model: dict | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with lang_pred and score added, from the column text alone."""
    plain = docs.columns if keep is None else keep
    if model is None:
        return docs.select(*plain, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    classes = np.array([*model["classes"], UNKNOWN], dtype=object)

    def make(batch):
        column = batch.column("_lower")
        data, offsets = C.column_bytes(column)
        known = ~np.asarray(column.is_null())
        for a, b in C.blocks(offsets, rows=ROWS):
            all_scores = scores(model, presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            best = np.where(known[a:b], all_scores.argmax(1), len(classes) - 1)
            score = np.where(known[a:b], all_scores.max(1), 0.0)
            rows = batch.slice(a, b - a)
            yield pa.record_batch([*(rows.column(c) for c in plain), pa.array(classes[best], pa.string()), pa.array(score)], [*plain, "lang_pred", "score"])

    schema = docs.select(*plain).schema.add("lang_pred", "string").add("score", "double")
    return C.map_texts(_lowered(docs).select(*plain, "_lower"), make, schema)


def accepted(docs: DataFrame, model: dict | None, least: float = 0.0) -> DataFrame:
    """The documents whose language is known with a score of at least `least`; a null lang takes the prediction.

    With the default of 0, only documents without a letter go, whatever the model says: README has the scores of
    clean and of junk texts, which no threshold divides. A stated lang is not checked against the prediction.
    Without a model, the documents that have a letter.
    """
    columns = docs.columns
    if model is None:
        return docs.where(docs["text"].cast("string").rlike(r"\p{L}"))
    renamed = docs.select(*[F.col(c).alias(f"_in_{c}") for c in columns if c != "text"], "text")
    kept = predict(renamed, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    back = {c: F.col("text") if c == "text" else F.col(f"_in_{c}") for c in columns}
    if "lang" in back:
        back["lang"] = F.coalesce(back["lang"], F.col("lang_pred"))
    return kept.select(*[v.alias(c) for c, v in back.items()])


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.select("doc_id", "text", "lang").where(C.crc_mod("doc_id", 4) != 2)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = train(training_rows(docs))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (C.crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return predict(asked, model, ["doc_id", "held_out"])
