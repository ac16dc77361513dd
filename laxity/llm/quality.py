"""Quality classifier by compression with two zstandard dictionaries.

From a bounded sample of labelled texts two dictionaries are built, one of good and one of bad text. A text is cut into
blocks and each is compressed with either; the difference of the compressed sizes, normalised by the text's bytes, is the one input of
a logistic function that is fitted on the sample, so that a score is a share of label 1. To each text PAD bytes of the average difference
are added, so that a few bytes alone decide little. Only text enters a score.

The sample: of the labelled rows whose crc32(doc_id) mod 5 is not 0, at most SAMPLE rows of each label, those with the smallest hash of
doc_id, with whole texts. A dictionary holds DICT_BYTES, made of slices that are spread evenly over all the sampled texts of its label.
For the fit each label's rows are halved, and a text is compressed with dictionaries of the other half. Everything else covers all rows.

Defined results: null and empty texts have the average difference and its score; rows with one doc_id get each their own score; a doc_id that is
labelled both good and bad is not learnt from; of differing texts of a labelled doc_id the smallest is; without labelled texts of both kinds
every text gets the share of label 1 (0.5 without labels). An empty table gives an empty result. A column that has the name of the score is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, drop_stored, forget, in_batches, release, stored, table

SAMPLE = 1500
DICT_BYTES = 128 * 1024
SLICE = 64
BLOCK = 2048
LEVEL = 7
#: Bytes of average difference that are added to each text.
PAD = 128
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def slices(text: bytes, most: int) -> list[bytes]:
    """At most `most` slices, spread evenly over the whole text."""
    n = -(-len(text) // SLICE)
    if n <= most:
        picked = range(n)
    else:
        shift = zlib.crc32(text)
        picked = [(i * n // most + shift) % n for i in range(most)]
    return [text[k * SLICE : (k + 1) * SLICE] for k in picked]


def dictionary(texts: list[list[bytes]]) -> bytes:
    """A raw dictionary of slices of all texts in turn, until the size is reached."""
    parts, size, turn = [], 0, 0
    while size < DICT_BYTES and any(turn < len(t) for t in texts):
        for t in texts:
            if turn < len(t):
                parts.append(t[turn])
                size += len(t[turn])
        turn += 1
    return b"".join(parts)[:DICT_BYTES]


@dataclass
class Model:
    good: bytes
    bad: bytes
    bias: float = 0.0
    slope: float = 0.0
    average: float = 0.0

    def coders(self) -> list:
        if not hasattr(self, "_coders"):
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=18, write_checksum=0, write_content_size=0, write_dict_id=0)
            self._coders = []
            for content in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
                if d:
                    d.precompute_compress(compression_params=params)
                self._coders.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d) if d else zstandard.ZstdCompressor(compression_params=params))
        return self._coders

    def difference(self, text: bytes) -> int:
        """Bytes more with the bad dictionary than with the good one."""
        good, bad = (sum(len(c.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for c in self.coders())
        return bad - good

    def score(self, texts: list[bytes]) -> np.ndarray:
        more, size = np.array([self.difference(t) for t in texts] if self.slope else [0] * len(texts)), np.array([len(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * normalised(more, size, self.average), -30, 30)))


def normalised(difference: np.ndarray, size: np.ndarray, average: float) -> np.ndarray:
    return (difference + PAD * average) / (size + PAD)


def calibrated(d: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Bias and slope of the logistic function of d, for a share `prior` of label 1 where the rows were drawn from."""
    share, scale = y.mean(), d.std() + 1e-9
    a = np.column_stack([np.ones(len(d)), d / scale])
    weight, w = np.where(y == 1, prior / share, (1 - prior) / (1 - share)), np.zeros(2)
    for _ in range(60):  # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - 0.01 * w)
        w += step * min(1, 4 / max(1e-9, abs(step).max()))
        if abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1] / scale)


def halves(labels: list[int]) -> list[int]:
    """A half (0 or 1) for each row, so that each label's rows are halved."""
    seen, out = {}, []
    for y in labels:
        seen[y] = seen.get(y, -1) + 1
        out.append(seen[y] % 2)
    return out


def dictionaries(found: list[tuple[int, list[bytes]]], half: list[int]) -> list[Model]:
    """Of (label, slices): models with the dictionaries of half 0, of half 1 and of all rows."""
    of = lambda label, side: [s for (y, s), h in zip(found, half) if y == label and h != side]
    return [Model(*(dictionary(of(label, side) or of(label, None)) for label in (1, 0))) for side in (1, 0, None)]


def fit(rows: list[tuple[str, int]], prior: float | None = None) -> Model:
    """The model of (text, label) rows held in memory. prior: the share of label 1 where they were drawn from."""
    most = -(-2 * DICT_BYTES // SLICE // max(1, len(rows)))
    data = [(t or "").encode("utf-8", "surrogatepass") for t, _ in rows]
    half = halves([y for _, y in rows])
    models = dictionaries([(y, slices(t, most)) for t, (_, y) in zip(data, rows)], half)
    return fitted(models[2], [(models[1 - h].difference(t), len(t), y) for t, h, (_, y) in zip(data, half, rows)], prior)


def fitted(model: Model, rows: list[tuple[int, int, int]], prior: float | None) -> Model:
    """The model with the logistic function of (difference, bytes, label) rows."""
    more, size, y = np.array(rows, float).reshape(-1, 3).T
    share = float(np.mean(y)) if rows else 0.5
    prior = min(max(share if prior is None else prior, 1e-6), 1 - 1e-6)
    if not rows or not 0 < share < 1:
        return Model(b"", b"", float(np.log(prior / (1 - prior))))
    average = sum(p * float(more[y == k].sum() / max(1, size[y == k].sum())) for k, p in ((1, prior), (0, 1 - prior)))
    return Model(model.good, model.bad, *calibrated(normalised(more, size, average), y, prior), average)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t.as_py() or b"" for t in column.cast(pa.binary())]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the bounded sample. The driver holds slices of twice the dictionaries' size, and a number for each sampled text."""
    in_batches(docs)
    own = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_label"), F.max("quality").alias("_other"))
    own = own.where("_label = _other").select("_id", "_label")
    n = {r["_label"]: r["count"] for r in own.groupBy("_label").count().collect()}  # two rows
    ids = None
    for label in (0, 1):
        part = own.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
        ids = part if ids is None else ids.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("_id", "_label").agg(F.min("text").alias("text"))
    sample = stored(found, "sample")
    most = {label: -(-2 * DICT_BYTES // SLICE // max(1, min(SAMPLE, n.get(label, 0)))) for label in (0, 1)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [slices(t, most[y]) for y, t in zip(b.column(1).to_pylist(), _bytes(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.list_(pa.binary()))], names=["_id", "_label", "parts"])

    rows = sorted(sample.mapInArrow(alone(cut), "_id long, _label int, parts array<binary>").collect(), key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_id"]))
    half = halves([r["_label"] for r in rows])
    models = dictionaries([(r["_label"], [bytes(p) for p in r["parts"]]) for r in rows], half)
    side = {r["_id"]: 1 - h for r, h in zip(rows, half)}  # at most 2 * SAMPLE entries

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _bytes(b.column(2))
            found = [models[side[i]].difference(t) for i, t in zip(b.column(0).to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(map(len, texts), pa.int64()), b.column(1)], names=["difference", "bytes", "_label"])

    met = sorted(tuple(r) for r in sample.mapInArrow(alone(compare), "difference long, bytes long, _label int").collect())
    drop_stored(sample)
    return fitted(models[2], met, n.get(1, 0) / max(1, sum(n.values())) if n else None)


def score(text: Column, model: Model) -> Column:
    """The score of a text. Only the text goes to Python; a row's other columns stay where they are."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for texts in batches:
            yield pa.array(model.score(_bytes(texts)), pa.float64())
        release()

    return scored(text)


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of the given name, from whole texts."""
    return in_batches(docs).withColumn(name, score(F.col("text"), model))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all their columns, without those that score below the threshold."""
    return docs.where(score(F.col("text"), train(docs, labels)) >= threshold)
