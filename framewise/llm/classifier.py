"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each token has a sparse ternary index vector drawn from its hash; the vector of a word is the sum of its
neighbours' index vectors over the labelled sample. Words share a fixed number of hashed rows, so the table has a
proven size. A document is the mean of its words' vectors and of its words' shapes' vectors. A numpy network of
two layers is trained on these means, and its temperature is fitted on rows it has not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, save, tidied

#: Labelled rows that the model is fitted on, at most: those of the smallest hashed ids.
SAMPLE_ROWS = 6_000
ROWS, DIMS, NONZERO, WINDOW, REPEAT_WITHIN = 1 << 14, 64, 8, 2, 6
PARTS = 16
#: Longer words, as of texts without white space, are read in pieces of so many characters.
PIECE = 64
CACHE_WORDS = 200_000


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """Ternary index vectors of all rows: NONZERO places of +1 or -1, the same in every process."""
    rng = np.random.default_rng(20_240_601)
    out = np.zeros((ROWS, DIMS), np.int32)
    place = np.argsort(rng.random((ROWS, DIMS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, place, rng.integers(0, 2, (ROWS, NONZERO), dtype=np.int32) * 2 - 1, axis=1)
    return out


def row_of(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % ROWS


#: The row of words that are met again.
AGAIN = row_of("\x02again")


class Kinds(dict):
    """For str.translate: 'X' and 'x' for letters, '9' for digits, other characters as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self[code] = ("9" if c.isdecimal() else "X" if c.isupper() else "x") if c.isalnum() else c
        return out


KINDS = Kinds()


def shape_of(word: str) -> str:
    """Letters and digits by kind, runs shortened: 'Rewh.###' -> 'Xx.#'."""
    return re.sub(r"(.)\1+", r"\1", word.translate(KINDS))


class Tokens:
    """Rows of a text's words and of their shapes, with a bounded memory of words and of kinds of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.shapes: dict[str, int] = {}

    def __missing(self, word: str) -> int:
        kinds = word.translate(KINDS)
        shape = self.shapes.get(kinds)
        if shape is None:
            if len(self.shapes) >= CACHE_WORDS:
                self.shapes = {}
            shape = self.shapes[kinds] = row_of("\x01" + shape_of(word))
        if len(self.known) >= CACHE_WORDS:
            self.known = {}
        out = self.known[word] = row_of(word) * ROWS + shape
        return out

    def rows(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words (of a long one's pieces), and of shapes; a word met again within REPEAT_WITHIN words has a row of its own instead of its shape's."""
        words = (text or "").split()
        if max(map(len, words), default=0) > PIECE:
            words = [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]
        get, missing = self.known.get, self.__missing
        both = np.array([(x if (x := get(w)) is not None else missing(w)) for w in words], np.int64)
        again = np.zeros(len(both), bool)
        for k in range(1, min(REPEAT_WITHIN, len(both) - 1) + 1):
            again[k:] |= both[k:] == both[:-k]
        shape = both % ROWS
        shape[again] = AGAIN
        return both // ROWS, shape


def context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors by row, in PARTS blocks."""
    index, tokens = index_vectors(), Tokens()
    total, seen = np.zeros((ROWS, DIMS), np.int32), False
    for batch in batches:
        for text in batch.column(0):
            seen = True
            word, shape = tokens.rows(text.as_py())
            vectors = index[word] + index[shape]
            near = np.zeros_like(vectors)
            for k in range(1, WINDOW + 1):
                near[k:] += vectors[:-k]
                near[:-k] += vectors[k:]
            np.add.at(total, word, near)
            np.add.at(total, shape, near)
    if seen:
        blocks = [x.tobytes() for x in np.split(total, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blocks, pa.binary())], names=["part", "sums"])


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Unit word vectors by row, from all texts of the sample; ROWS x DIMS floats reach the driver, whatever its size."""

    def add(group):
        sums = np.sum([np.frombuffer(x, np.int32) for x in group["sums"]], axis=0, dtype=np.int32)
        return group.head(1).assign(sums=[sums.tobytes()])

    got = sample.select("text").mapInArrow(tidied(context_sums), "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").toPandas()
    out = np.zeros((PARTS, ROWS // PARTS, DIMS))
    for part, sums in zip(got["part"], got["sums"], strict=True):
        out[part] = np.frombuffer(sums, np.int32).reshape(-1, DIMS)
    out = out.reshape(ROWS, DIMS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=index_vectors() / np.sqrt(NONZERO), where=norm > 0).astype(np.float32)  # unseen rows keep their index vectors


def pooled(texts: list[str | None], vectors: np.ndarray, tokens: Tokens) -> np.ndarray:
    """A row for each text: the mean vectors of its words and of their shapes, and 1 if it has words."""
    out = np.zeros((len(texts), 2 * DIMS + 1), np.float32)
    for i, text in enumerate(texts):
        word, shape = tokens.rows(text)
        if len(word):
            rows, times = np.unique(shape, return_counts=True)
            out[i, :DIMS] = np.mean([vectors[word[k : k + 65_536]].mean(0) for k in range(0, len(word), 65_536)], axis=0)
            out[i, DIMS:-1] = times @ vectors[rows] / len(shape)
            out[i, -1] = 1
    return out


@dataclass(frozen=True)
class Network:
    """score = sigmoid(logit / temperature) of a layer of tanh units over standardised inputs."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(float)) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 400, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> Network:
    """Full-batch Adam on four fifths of the rows; the temperature is that of least loss on the other fifth.

    Of fewer than 50 rows, or where four fifths are of one kind, all are trained on and the temperature is 1, as ten rows
    or fewer calibrate nothing.
    """
    rng = np.random.default_rng(seed)
    x, y = x.astype(float), y.astype(float)
    held = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or len(set(y[~held])) < 2:
        held[:] = False
    xt, yt = x[~held], y[~held]
    mean, scale = xt.mean(0), xt.std(0) + 1e-3
    z = (xt - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = np.where(yt == 1, 0.5 / max(yt.mean(), 1e-9), 0.5 / max(1 - yt.mean(), 1e-9))
    for step in range(1, steps + 1):
        h = np.tanh(z @ p[0] + p[1])
        d = weight * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yt) / len(yt)
        back = np.outer(d, p[2]) * (1 - h * h)
        for i, g in enumerate((z.T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], np.array([d.sum()]))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if not held.any():
        return net
    logit, target = net.logit(x[held]), y[held]
    loss = lambda t: float(np.mean(np.logaddexp(0, logit / t) - target * logit / t))
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), min(np.geomspace(0.2, 10, 80).tolist(), key=loss))


def in_fold(column: str = "doc_id"):
    """True for the rows labels may not be learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network | None]:
    """Word vectors and network from at most ``rows`` different labelled rows outside the held-out fold."""
    chosen = labels.where("quality is not null and doc_id is not null").where(~in_fold()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids are broadcast
    sample = save(bounded_rows(labelled, "doc_id", "text", rows, "quality"), "classifier-sample")
    vectors = word_vectors(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            x = pooled(batch.column(2).to_pylist(), shared.value, tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    got = sample.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("bigint"), "text").mapInArrow(tidied(features), "doc_id bigint, quality bigint, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"]).reset_index(drop=True)
    if got["quality"].nunique() < 2:
        return vectors, None
    x = np.array([np.frombuffer(r, np.float32) for r in got["x"]])
    return vectors, train(x, (got["quality"] == 1).to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id by default), held_out, score and predicted per row of ``docs``.

    Whole texts are scored; a null text counts as empty and gets the score of a text without words. Null ids are
    scored and not held out. Labels with null id or quality are not learned from, and of several labels of an id the
    lowest counts. Without labels of both kinds every score is 0.5; with fewer than 50 labelled rows scores are not
    calibrated (see ``train``). Other columns are not read unless kept.
    """
    vectors, net = fit(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    kept = [c for c in (["doc_id"] if keep is None else keep) if c not in ("held_out", "score", "predicted")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], in_fold().alias("held_out"), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, model), tokens = shared.value, Tokens()
        for batch in batches:
            scores = []
            for k in range(0, batch.num_rows, 512):
                texts = batch.column(batch.num_columns - 1).slice(k, 512).to_pylist()
                scores.append(np.full(len(texts), 0.5) if model is None else model.score(pooled(texts, table, tokens)))
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=[*kept,
                "held_out", "score", "predicted"])

    return source.mapInArrow(tidied(run), source.drop("__text").schema.add("score", "double").add("predicted", "integer"))
