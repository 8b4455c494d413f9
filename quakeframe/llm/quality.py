"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: word unigrams and bigrams, and trigrams of bytes. A word
that equals the one before is read as a mark for "the same again", so that any stuttering text
shares its n-grams. Indicators are scaled by the log ratio of their (smoothed) counts in the two
classes, vectors have length 1, and a linear hinge-loss model is fitted by dual coordinate descent; a
logistic curve, fitted on a fifth of the sample with the classes weighted as in all labels, turns
margins into scores; the model itself is then fitted again on the whole sample.

Training rows are a bounded sample: of each class the ``per_class`` labelled documents whose ids come
first by hash. Every text is scored whole.

Defined results: a null or empty text has no features and gets the score of the bias alone. A label
row with a null is left out, as are documents whose label rows differ; repeated labels count once.
With labels of one class only, or none, every score is that class' share (0.5 without labels).
Repeated documents get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import gives_back
from .texthash import ODD, Words, chunks, mix, ngram_hashes

BITS = 18
SAME = np.uint64(0x5A5A5A5A)


def features(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text its distinct feature numbers, sorted."""
    seen = np.zeros(1 << BITS, bool)
    shift = np.uint64(64 - BITS)
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi])
        h = w.hash.copy()
        if len(h) > 1:
            again = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
            h[1:][again] = SAME
        buf = w.buf.astype(np.uint64)
        tri = (mix(buf[:-2] | buf[1:-1] << np.uint64(8) | buf[2:] << np.uint64(16) | np.uint64(1 << 40)) >> shift).astype(np.int64) if len(buf) > 2 else np.zeros(0, np.int64)
        uni = (mix(h) >> shift).astype(np.int64)
        bi = (mix(ngram_hashes(h, 2) * ODD) >> shift).astype(np.int64)
        for i in range(hi - lo):
            a, b = w.first[i], w.first[i + 1]
            at = w.row_start[i]
            n = len(texts[lo + i] or b"")
            seen[uni[a:b]] = True
            seen[bi[a : max(a, b - 1)]] = True
            seen[tri[at : at + max(0, n - 2)]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


def log_ratio(rows: list[np.ndarray], y: np.ndarray, size: int = 1 << BITS, smooth: float = 50.0) -> np.ndarray:
    """Log ratio of the normalised counts of each feature in class 1 and class 0."""
    counts = np.full((2, size), smooth)
    for x, c in zip(rows, y, strict=True):
        counts[int(c), x] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def unit(r: np.ndarray, x: np.ndarray) -> np.ndarray:
    v = r[x]
    norm = np.sqrt(v @ v)
    return (v / norm if norm > 0 else v).astype(np.float32)


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: float = 10.0, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum c_i max(0, 1 - y_i w.x_i), by dual coordinate descent.
    Both classes weigh the same together; the bias is the weight of a constant feature."""
    sign = np.where(y > 0, 1.0, -1.0)
    most = c * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y <= 0).sum()))
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            slope = sign[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def fit_logistic(margin: np.ndarray, y: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))), with softened targets; class 1 weighs ``share``."""
    pos, neg = max(1, (y > 0).sum()), max(1, (y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, share / pos, (1 - share) / neg)
    center, scale = margin.mean(), max(margin.std(), 1e-9)
    x = np.stack([(margin - center) / scale, np.ones_like(margin)], 1)
    ab = np.zeros(2)

    def loss(ab: np.ndarray) -> float:
        z = x @ ab
        return float(weight @ (np.logaddexp(0, z) - target * z))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (weight * (p - target))
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        while loss(ab - step) > loss(ab) and abs(step).max() > 1e-7:
            step = step / 2
        ab = ab - step
        if abs(step).max() < 1e-6:
            break
    ab = np.array([ab[0] / scale, ab[1] - ab[0] * center / scale])
    return float(ab[0]), float(ab[1])


def fit(rows: list[np.ndarray], y: np.ndarray, share: float | None = None) -> dict:
    """The model of one sample; see the module's text. ``share``: class 1's part of all labels."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return {"r": np.zeros(1 << BITS), "w": np.zeros(1 << BITS), "bias": 0.0, "a": 0.0, "b": float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))}

    def fitted(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        r = log_ratio([rows[i] for i in own], y[own])
        # one array for all values, which the system takes back as a whole
        edges = np.cumsum([0, *(len(rows[i]) for i in own)])
        flat = np.empty(edges[-1], np.float32)
        for i, a, b in zip(own, edges[:-1], edges[1:], strict=True):
            flat[a:b] = unit(r, rows[i])
        w, bias = fit_hinge([rows[i] for i in own], [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], y[own], 1 << BITS)
        return r, w, bias

    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[4::5]] = True
    if len(set(y[held].tolist())) < 2:
        held[:] = True
    r, w, bias = fitted(np.flatnonzero(~held) if not held.all() else np.arange(len(y)))
    margin = np.array([w[rows[i]] @ unit(r, rows[i]) + bias for i in np.flatnonzero(held)])
    a, b = fit_logistic(margin, y[held], float(y.mean()) if share is None else share)
    r, w, bias = fitted(np.arange(len(y)))
    return {"r": r, "w": w, "bias": bias, "a": a, "b": b}


def agreed_labels(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id and y (0, 1) of the labelled documents that ``learn`` admits."""
    agreed = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top"))
    return agreed.where(F.col("y") == F.col("top")).select("doc_id", "y")


def labelled_sample(docs: DataFrame, agreed: DataFrame, per_class: int) -> DataFrame:
    """doc_id, raw text and y of at most ``per_class`` documents of each class; ids are chosen from
    the labels alone, so the broadcast side has at most twice as many rows."""
    first = [agreed.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = first[0].unionByName(first[1])
    raw = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("raw"))
    return raw.join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = 3000) -> dict:
    """A model of documents' ``label``; its sample, the only thing sent to the driver, is bounded."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x.astype("<i4").tobytes() for x in features(b.column("raw").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(found, pa.binary())], names=["doc_id", "y", "x"])

    agreed = agreed_labels(labels, label, learn)
    counts = {r.y: r.n for r in agreed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    sample = labelled_sample(docs, agreed, per_class).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "raw")
    found = sample.mapInArrow(gives_back(extract), "doc_id long, y int, x binary").toArrow().sort_by([(c, "ascending") for c in ("doc_id", "y", "x")]).combine_chunks()
    # views of one buffer, as thousands of arrays of their own would stay in the driver's memory
    model = fit([np.frombuffer(x.as_buffer(), "<i4") for x in found.column("x")], found.column("y").to_numpy(), share)
    del found, sample
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: dict, into: str = "score") -> DataFrame:
    """docs with the score in column ``into``, instead of any it had; other columns pass through."""
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weighted, square = m["w"] * m["r"], m["r"] ** 2
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                raw = part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                margin = np.full(len(raw), m["bias"])
                for i, x in enumerate(features(raw)):
                    if len(x) and (norm := square[x].sum()) > 0:
                        margin[i] += weighted[x].sum() / np.sqrt(norm)
                p = 1 / (1 + np.exp(-np.clip(m["a"] * margin + m["b"], -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, into])

    return docs.mapInArrow(gives_back(apply), schema)


def learnable(n: int, held: int) -> Column:
    """Rows whose crc32 of doc_id as text isn't ``held`` modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n != held
