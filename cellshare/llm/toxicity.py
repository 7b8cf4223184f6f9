"""Toxicity by compression distance.

Each class has a zstandard dictionary trained on its own text.  Toxic documents consist of ordinary words but for a
few, so what a dictionary learns from is its class's distinctive text: the words most of whose byte grams are
significantly more frequent in documents of the class than in those of the other.  Behind both stands the same base,
trained on all ordinary windows, so that lengths differ by what tells the classes apart.  A text is compressed in
windows of ``WINDOW`` words with both; how much shorter the toxic dictionary makes each window gives a few numbers for
the text, and a logistic curve fitted on training rows that the dictionaries haven't seen turns them into a calibrated
score.

The fit uses a bounded sample of the labelled training rows: ``PER_CLASS`` rows of each class (smallest hash of
the id) and at most ``SAMPLE_BYTES`` of text, in that order.  Scoring reads all rows and whole texts.

Null and empty texts are scored as one empty window.  Rows with a null id are scored and count as not held out.
A label that is null is ignored; of several labels for an id the largest counts.  Without training rows of both
classes every score is the share of toxic training labels (0 without any).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PER_CLASS = 3000
SAMPLE_BYTES = 32 << 20
WINDOW = 8
GRAM = 6
#: Bytes of a class's own dictionary and of the base.
DICTIONARY = 768
BASE = 16384
#: The three start offsets 1, 4, 8 of the format.
OFFSETS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])
LEVEL = 6
SIGNIFICANT = 5.0


def windows(text: bytes) -> list[bytes]:
    words = C.lower_ascii(np.frombuffer(text, np.uint8)).tobytes().split()
    return [b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)] or [b""]


def _words(text: bytes) -> set[bytes]:
    return {b" %b " % w for w in text.lower().split()}


def _grams(word: bytes) -> set[bytes]:
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def typical(own: list[bytes], other: list[bytes]) -> set[bytes]:
    """Byte grams that significantly more texts of ``own`` hold than of ``other``."""

    def frequency(texts: list[bytes]) -> Counter:
        n: Counter = Counter()
        for t in texts:
            n.update(set().union(*map(_grams, _words(t))))
        return n

    a, b, out = frequency(own), frequency(other), set()
    for g, n in a.items():
        p, q = n / len(own), (b[g] + 1) / (len(other) + 1)
        mean = (n + b[g] + 1) / (len(own) + len(other) + 1)
        if p > 2 * q and (p - q) / np.sqrt(mean * (1 - mean) * (1 / len(own) + 1 / len(other)) + 1e-12) > SIGNIFICANT:
            out.add(g)
    return out


def distinctive(own: list[bytes], other: list[bytes]) -> list[bytes]:
    """Of each text of ``own`` its distinct words at least half of whose grams are typical."""
    grams, out = typical(own, other), []
    for t in own if grams else []:
        if words := sorted(w for w in _words(t) if (g := _grams(w)) and 2 * len(g & grams) >= len(g)):
            out.append(b"".join(words))
    return out


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """The content of a zstandard dictionary trained on the samples; too few of them are the dictionary themselves."""
    if not samples:
        return b""
    try:
        whole = zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))
    # entropy tables end with the three start offsets; the content follows
    return whole.partition(OFFSETS)[2] or whole


class Model:
    """The two dictionaries and the fitted curve; small, so it travels with the task."""

    def __init__(self, toxic: list[bytes], plain: list[bytes], share: float) -> None:
        self.constant: float | None = None
        if len(toxic) < 4 or len(plain) < 4:
            self.constant = share
            return
        # two of three rows for the dictionaries, the third for the curve
        fit = lambda rows: [r for i, r in enumerate(rows) if i % 3]
        rest = lambda rows: rows[::3]
        base = trained([w for t in fit(plain) for w in windows(t)], BASE, 64, 8)
        self.toxic = trained(distinctive(fit(toxic), fit(plain)), DICTIONARY, 32, 8) + base
        self.plain = trained(distinctive(fit(plain), fit(toxic)), DICTIONARY, 32, 8) + base
        held = [rest(toxic), rest(plain)]
        x = self.measure([t for rows in held for t in rows])
        y = np.concatenate([np.ones(len(held[0])), np.zeros(len(held[1]))])
        weight = np.concatenate([np.full(len(held[0]), share / len(held[0])), np.full(len(held[1]), (1 - share) / len(held[1]))]) * len(y)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        x, self.coef = self._design(x), None
        coef = np.zeros(x.shape[1])
        ridge = np.full(len(coef), 1.0)
        ridge[-1] = 1e-3
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
            slope = x.T @ (weight * (p - y)) + ridge * coef
            coef -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        self.coef = coef

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, z**2, np.ones((len(z), 1))], 1)

    def _press(self, content: bytes) -> zstandard.ZstdCompressor:
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)

    def measure(self, texts: Iterable[bytes]) -> np.ndarray:
        toxic, plain, out = self._press(self.toxic).compress, self._press(self.plain).compress, []
        for t in texts:
            d = np.array([len(plain(w)) - len(toxic(w)) for w in windows(t)], float)
            top = np.sort(d)[-3:]
            out.append((d.mean(), top[-1], top.mean(), np.maximum(d - 1, 0).mean(), np.maximum(d - 2, 0).mean(), (d >= 1).mean(), (d >= 2).mean(), (d >= 3).mean(), (d >= 4).mean(), np.log(len(d))))
        return np.array(out, float).reshape(-1, 10)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._design(self.measure(texts)) @ self.coef, -30, 30)))


def crc_of(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 0) -> Model:
    """Fit on labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(crc_of("doc_id") % folds != fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = C.materialise(known, "labels")
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    order = F.xxhash64("doc_id")
    picked = [(r.doc_id, r.toxic) for c in (1, 0) for r in known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(PER_CLASS).collect()]
    if not picked:
        return Model([], [], 0.0)
    # at most 2 * PER_CLASS rows
    ids = spark.createDataFrame(picked, "doc_id long, toxic int")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    sizes = sorted((r.h, r.doc_id, r.toxic, r.size) for r in own.groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).alias("size")).withColumn("h", order).collect())
    total, chosen = 0, []
    for _, i, toxic, size in sizes:
        if total + size <= SAMPLE_BYTES:
            total += size
            chosen.append((i, toxic))
    wanted = spark.createDataFrame(chosen, "doc_id long, toxic int") if chosen else ids.limit(0)
    rows = own.drop("toxic").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).toPandas().sort_values("doc_id")
    texts = {c: [t.encode() for t in rows.loc[rows["toxic"] == c, "text"]] for c in (0, 1)}
    return Model(texts[1], texts[0], share)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.blocks(batches):
            data, offs = C.utf8(b.column(b.num_columns - 1))
            raw = data.tobytes()
            s = model.score([raw[x:y] for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=[*b.schema.names[:-1], "score"])

    return run


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    C.ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = own.mapInArrow(C.lean(_score(model)), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _accept(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = C.utf8(batch.column(at))
            raw = data.tobytes()
            s = model.score([raw[x:y] for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
            yield batch.filter(pa.array(s < 0.5))

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; every column stays."""
    C.ship(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.mapInArrow(C.lean(_accept(model, docs.columns.index("text"))), docs.schema)
