"""Quality classifier: random-indexing word vectors, a two-layer network in numpy, calibrated probabilities.

Random indexing: every hashed word has a fixed sparse ternary index vector; its
context vector is the sum, over the whole corpus, of the index vectors of the
words within two places of it, each rotated by its distance so that order
counts. The table has a fixed number of buckets, so tasks send at most that
many rows, Spark adds them up, and the sum fits a broadcast of a size that
parameters bound.

A document is three pools of its words' vectors: their mean, their standard
deviation, and the mean product of neighbours. The network is fitted on a
bounded sample of labelled rows. A temperature calibrates the probabilities: it is
fitted by cross-validation, on what networks say of the labelled rows that they
didn't see, with smoothed targets, so that it stays finite where the classes
come apart. Only the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small

WINDOW = 2
NONZERO = 4
_RUN = 1 << 14


@dataclass(frozen=True)
class Space:
    """The random index: buckets words of dim entries, NONZERO of them set."""

    buckets: int = 1 << 14
    dim: int = 64
    seed: int = 11

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """For each bucket: the set dimensions and their signs."""
        draw = np.random.default_rng(self.seed)
        places = np.argsort(draw.random((self.buckets, self.dim)), axis=1)[:, :NONZERO]
        return places.astype(np.int64), draw.choice(np.array([-1.0, 1.0]), (self.buckets, NONZERO))

    def dense(self) -> np.ndarray:
        places, signs = self.index()
        out = np.zeros((self.buckets, self.dim), np.float32)
        np.put_along_axis(out, places, signs.astype(np.float32), axis=1)
        return out / np.sqrt(NONZERO)

    def bucket(self, token: bytes) -> int:
        return crc32(token) & (self.buckets - 1)


def buckets_of(text: bytes, mask: int) -> np.ndarray:
    """The bucket of each word."""
    words = text.lower().split()
    return np.fromiter(map(crc32, words), np.int64, len(words)) & mask


def context_sums(docs: DataFrame, text_col: str, space: Space) -> np.ndarray:
    """The context vectors of all buckets, counted over every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = space.index()
        size = space.buckets * space.dim
        total = np.zeros(size)

        def add(parts: list[np.ndarray]) -> None:
            ids = np.concatenate(parts)
            doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            for far in range(1, WINDOW + 1):
                inside = np.flatnonzero(doc[:-far] == doc[far:])
                before, after = ids[inside], ids[inside + far]
                for a, b, turn in ((before, after, far), (after, before, -far)):
                    for k in range(NONZERO):
                        total[:] += np.bincount(a * space.dim + (places[b, k] + turn) % space.dim, signs[b, k], size)

        for batch in small(batches):
            parts, held = [], 0
            for text in as_bytes(batch.column(0)):
                parts.append(buckets_of(text, space.buckets - 1))
                held += len(parts[-1])
                if held >= 64 * _RUN:
                    add(parts)
                    parts, held = [], 0
            if parts:
                add(parts)
        table = total.reshape(space.buckets, space.dim)
        used = np.flatnonzero(np.abs(table).sum(axis=1))
        columns = [pa.array(used.astype(np.int32)), *(pa.array(table[used, j].astype(np.int64)) for j in range(space.dim))]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", *(f"v{j}" for j in range(space.dim))])

    schema = ", ".join(["bucket int", *(f"v{j} long" for j in range(space.dim))])
    parts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, schema)
    sums = parts.groupBy("bucket").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(space.dim)))
    out = np.zeros((space.buckets, space.dim), np.float32)
    got = sums.toArrow()  # at most `buckets` rows
    if got.num_rows:
        out[got["bucket"].to_numpy()] = np.column_stack([got[f"v{j}"].to_numpy() for j in range(space.dim)])
    return out


def word_vectors(sums: np.ndarray, space: Space) -> np.ndarray:
    """Context vectors at unit length, on the word's own index vector."""
    damped = np.sign(sums) * np.log1p(np.abs(sums))
    length = np.linalg.norm(damped, axis=1, keepdims=True)
    return (damped / np.maximum(length, 1e-9) + 0.5 * space.dense()).astype(np.float32)


def pool(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """The features of a document: mean, standard deviation and mean neighbour product of its words' vectors; zeros for one without words."""
    dim = vectors.shape[1]
    sums = np.zeros((3, dim))
    ids = buckets_of(text, len(vectors) - 1)
    if not len(ids):
        return sums.ravel().astype(np.float32)
    for at in range(0, len(ids), _RUN):
        own = vectors[ids[at : at + _RUN + 1]].astype(float)  # with the neighbour beyond
        inside = own[:_RUN]
        sums[0] += inside.sum(axis=0)
        sums[1] += np.einsum("ij,ij->j", inside, inside)
        sums[2] += np.einsum("ij,ij->j", own[:-1], own[1:])
    sums /= len(ids)
    sums[1] = np.sqrt(np.maximum(sums[1] - sums[0] ** 2, 0))
    return sums.ravel().astype(np.float32)


@dataclass
class Network:
    """Standardised inputs, one hidden layer, one output, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature
        small = np.exp(-np.abs(z))  # never overflows, and keeps the order of scores near 0
        return np.where(z >= 0, 1, small) / (1 + small)


def _trained(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, batch: int, rate: float, decay: float, draw: np.random.Generator) -> Network:
    """Fit by Adam on all rows. One class only: its smoothed share for every input."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = (x.std(axis=0) if len(x) else np.zeros(x.shape[1])) + 1e-3
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network(mean, scale, draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, np.sqrt(1 / hidden), hidden), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        net.w2[:] = 0
        return net
    z, t = (x - mean) / scale, y.astype(float)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs)
        shuffled = draw.permutation(len(x))
        for at in range(0, len(shuffled), batch):
            rows = shuffled[at : at + batch]
            raw = z[rows] @ params[0] + params[1]
            act = np.maximum(raw, 0)
            error = (1 / (1 + np.exp(-np.clip(act @ params[2] + params[3][0], -30, 30))) - t[rows]) / len(rows)
            back = np.outer(error, params[2]) * (raw > 0)
            step += 1
            for i, g in enumerate((z[rows].T @ back + decay * params[0], back.sum(axis=0), act.T @ error + decay * params[2], np.array([error.sum()]))):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                params[i] -= now * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    return net


#: What a temperature is looked for among.
TEMPERATURES = np.exp(np.linspace(np.log(0.05), np.log(50), 400))


def fitted_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss against smoothed targets: of n rows of a class, as if one more were of the other."""
    ones = y.sum()
    targets = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    loss = lambda temp: np.mean(np.logaddexp(0, logits / temp) - targets * logits / temp)
    return float(min(TEMPERATURES, key=loss))


def fit(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5, folds: int = 4) -> Network:
    """A network of all rows, with the temperature that fits what networks of the other folds say of each fold."""
    draw = np.random.default_rng(seed)
    net = _trained(x, y, hidden, epochs, batch, rate, decay, draw)
    fold = draw.permutation(len(x)) % folds
    if len(np.unique(y)) == 2 and all(len(np.unique(y[fold != f])) == 2 for f in range(folds)):
        logits = np.zeros(len(x))
        for f in range(folds):
            logits[fold == f] = _trained(x[fold != f], y[fold != f], hidden, epochs, batch, rate, decay, draw).logits(x[fold == f])
        net.temperature = fitted_temperature(logits, y)
    return net


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(folds)) == 0, F.lit(False))


@dataclass
class Classifier:
    """What scoring needs; it travels to the workers by broadcast."""

    vectors: np.ndarray
    net: Network

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = [pool(t, self.vectors) for t in texts]
        return self.net.probability(np.array(x, float).reshape(-1, 3 * self.vectors.shape[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample_rows: int = 20_000, space: Space | None = None) -> Classifier:
    """Word vectors from all documents, the network from at most sample_rows labelled rows.

    Those are the rows whose hashed id comes first among labelled rows that
    aren't held out; the bound holds for rows of documents too, should ids
    repeat. Null labels and ids aren't learnt from. Without labels the network
    gives one half for every text.
    """
    spark, space = docs.sparkSession, space or Space()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label_id is not null and label in (0, 1)")
    sample = known.where(~held_out("label_id")).orderBy(F.xxhash64("label_id"), "label").limit(sample_rows)
    vectors = word_vectors(context_sums(rows, "text", space), space)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = [pool(t, shared.value).tobytes() for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["place", "label", "x"])

    # The sample has at most sample_rows rows of two numbers.
    labelled = rows.join(F.broadcast(sample), F.col("id") == F.col("label_id")).select(F.xxhash64("label_id").alias("place"), "label", "text")
    labelled = labelled.mapInArrow(features, "place long, label int, x binary")
    got = labelled.orderBy("place", "label", "x").limit(sample_rows).toArrow().sort_by([("label", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, 3 * space.dim).astype(float)
    return Classifier(vectors, fit(x, got["label"].to_numpy().astype(float)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, threshold: float = 0.3, **options) -> DataFrame:
    """id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold`) for each row.

    Null texts are empty and empty texts are scored like others; a null id is
    not held out. Repeated rows get equal scores. Other columns are not
    carried. options go to train().
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, **options))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            p = shared.value.scores(as_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(score, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, threshold: float = 0.3, **options) -> DataFrame:
    """docs that the classifier doesn't reject, with all columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, **options))
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(shared.value.scores(as_bytes(batch.column(place))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
