"""A quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

1. One pass over the texts computes some thirty statistics per document.
2. Labelled rows are standardised; cos(Wx + b) with fixed random W approximates a Gaussian kernel.
3. Tasks sum their rows' normal equations; the sums are added up in two levels and the driver solves the ridge system.
4. Isotonic regression (pool adjacent violators) on labelled rows that the fit has not seen turns the raw score into the
   share of good documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, give_back, small_batches

STATISTICS = (
    "log_chars", "log_words", "word_len", "word_len_sd", "upper", "lower", "digit", "punct", "exclaim", "bar", "symbols", "high_bytes", "space", "newline",
    "byte_entropy", "distinct_words", "top_word", "repeat_words", "repeat_lines", "line_len", "stops", "sentence_len", "upper_words", "long_words", "odd_words", "title_words", "comma", "brackets",
)

_CLASS = np.zeros((256, 9))
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), map(ord, ".,;:!?'\"()[]{}-"), b"!", b"|", b"#$%&*@^~_+=<>\\/", range(128, 256), b" \t\r\x0b\x0c")):
    for _b in _chars:
        _CLASS[_b, _i] = 1


def statistics(text: str) -> list[float]:
    """The text's statistics, in the order of STATISTICS; all 0 where there is nothing to measure."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    upper, lower, digit, punct, exclaim, bar, symbols, high, space = (counts @ _CLASS) / n
    p = counts[counts > 0] / n
    words = text.split()
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    freq = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    stops = int(counts[46] + counts[33] + counts[63])
    return [
        np.log1p(len(text)), np.log1p(len(words)), min(40.0, sizes.mean()), min(40.0, sizes.std()), upper, lower, digit, punct, exclaim, bar, symbols, high, space, counts[10] / n,
        float(-(p * np.log2(p)).sum()), len(freq) / k, (max(freq.values()) if freq else 0) / k, sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        1 - len(set(lines)) / m, np.log1p(n / m), stops / k, np.log1p(k / (stops + 1)), sum(map(str.isupper, words)) / k, float((sizes > 15).mean()), sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words) / k,
        sum(map(str.istitle, words)) / k, counts[44] / k, (counts[40] + counts[91] + counts[123] + counts[60]) / k,
    ]


@dataclass
class Model:
    """A fitted classifier; its size depends on the parameters alone."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(raw: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by raw score: the blocks' mean raw scores and their shares of good.

    Shares are smoothed by one row at the overall share, so that no small block claims certainty.
    """
    overall = float((good * weight).sum() / weight.sum())
    blocks: list[list[float]] = []
    for r, g, w in zip(raw, good, weight, strict=True):
        blocks.append([r * w, g * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    x = np.array([b[0] / b[2] for b in blocks])
    y = np.maximum.accumulate([(b[1] + overall) / (b[2] + 1) for b in blocks])
    return x, np.asarray(y)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id as text, the statistics as an array, and the columns to keep; whole texts, one pass."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("_id", pa.string()), ("stats", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], schema=schema)
        give_back()

    slim = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInArrow(run, "_id string, stats array<double>")


def held_out(id_as_text) -> object:
    """True for rows whose labels are never learnt from: crc32 of the id modulo 5 is 0, or there is no id."""
    return F.coalesce(F.pmod(F.crc32(id_as_text.cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit(measured: DataFrame, labels: DataFrame, width: int = 256, ridge: float = 1e-3, bandwidth: float = 6.0, most_rows: int = 400_000, seed: int = 7) -> Model:
    """Fits on the measured rows that have a label and are not held out.

    ``most_rows`` bounds the labelled rows used, by a hash of the id; more labels than that hardly move a model of
    ``width`` weights. One labelled row in four calibrates and is not fitted on.
    """
    truth = labels.select(F.col("doc_id").cast("string").alias("_id"), F.col("quality").cast("double").alias("y")).dropna().groupBy("_id").agg(F.avg("y").alias("y"))
    rows = measured.join(truth, "_id").filter(~held_out(F.col("_id")))
    work = Workspace(measured.sparkSession, "quality-fit")
    rows = work.cut(rows, "labelled")
    n = rows.count()
    if n > most_rows:
        rows = rows.filter(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    neutral = Model(np.zeros(d), np.ones(d), rng.normal(0, 1 / bandwidth, (d, width)), rng.uniform(0, 2 * np.pi, width), np.zeros(width + 1), np.zeros(1), np.full(1, 0.5))
    if n == 0:
        return neutral
    tasks = int(min(16, max(1, n // 2000)))  # rows are bounded, and so are the tasks and what they send back
    rows = rows.repartition(tasks, "_id")
    calibrates = F.pmod(F.crc32(F.concat(F.col("_id"), F.lit("/calibrate")).cast("binary")), F.lit(4)) == 0
    moments = rows.select(*[x for i in range(d) for x in (F.col("stats")[i].alias(f"s{i}"),)]).agg(*[f(f"s{i}") for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    neutral.mean = np.array(moments[0::2], float)
    neutral.scale = np.maximum(np.array(moments[1::2], float), 1e-6)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 2))
        for pdf in batches:
            z = neutral.features(np.array(pdf["stats"].tolist(), float))
            total += z.T @ np.hstack([z, pdf["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"total": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 2))
        for pdf in batches:
            for x in pdf["total"]:
                total += np.frombuffer(x).reshape(total.shape)
        yield pd.DataFrame({"total": [total.tobytes()]})

    def solve(part: DataFrame) -> np.ndarray:
        # The sums are added in two levels, whatever the number of tasks: four matrices come to the driver, one by one.
        sent = part.select("stats", "y").mapInPandas(sums, "total binary").repartition(4).mapInPandas(add, "total binary")
        total = np.zeros((width + 1, width + 2))
        for r in sent.toLocalIterator():
            total += np.frombuffer(r["total"]).reshape(total.shape)
        count = max(1.0, total[-1, -2])
        return np.linalg.solve(total[:, :-1] + ridge * count * np.eye(width + 1), total[:, -1])

    neutral.beta = solve(rows.filter(~calibrates))
    model = neutral

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"raw": np.round(model.raw(np.array(pdf["stats"].tolist(), float)), 3), "y": pdf["y"]})

    points = rows.filter(calibrates).select("stats", "y").mapInPandas(scored, "raw double, y double").groupBy("raw").agg(F.avg("y").alias("good"), F.count("*").alias("n")).orderBy("raw").toPandas()
    if len(points):
        model.knots, model.values = isotonic(points["raw"].to_numpy(), points["good"].to_numpy(), points["n"].to_numpy(float))
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold).

    Only the text enters a score. Defined cases: a null text counts as empty and is scored like any other; a null id
    is held out; labels that are null are ignored, several of one id are averaged; without any label every score is 0.5;
    repeated rows score alike; texts are whole, however long; an empty table gives an empty result. Other columns are left
    behind, whatever their names.
    """
    work = Workspace(docs.sparkSession, "quality")
    measured = work.cut(measure(docs, id_col, text_col), "measured")
    model = fit(measured, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = model.score(np.array(pdf["stats"].tolist(), float).reshape(len(pdf), len(STATISTICS)))
            yield pd.DataFrame({"_id": pdf["_id"], "score": score, "predicted": (score >= threshold).astype("int32")})

    out = measured.select("_id", "stats").mapInPandas(run, "_id string, score double, predicted int")
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, all columns, that ``classify`` predicts to be good. Texts are measured once more in place
    rather than shuffled to meet their scores. Defined cases as there; columns may have any names; without any label all
    rows stay."""
    model = fit(Workspace(docs.sparkSession, "quality").cut(measure(docs, id_col, text_col), "measured"), labels)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t or "") for t in batch.column(at).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.score(stats) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
