"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as words, in overlapping windows of ``WINDOW`` words, each ``STRIDE`` after the one before; the
last window ends with the text, and all windows are scored. A word's input is the sum of a vector of
the whole word (by hash) and of its mean character vector (hashed 3- to 5-grams of its bytes between
marks, ASCII letters in lower case), and of its evidence in a direction that is learnt: the smoothed log ratio of the
shares of toxic and of other texts that have the word, 0 for words of few texts. While learning, a text sees the evidence
of the texts of other folds only, so rare words that it has itself tell it nothing. The states of a forward and a backward gated recurrent layer are pooled by attention, and a
linear layer gives the window's logit. A text's margin is its greatest logit; a logistic curve, fitted with
the classes weighted as in all labels (of many texts on a fifth that the network doesn't learn from), turns margins into scores.

Training rows are a bounded sample: of each class the ``per_class`` labelled documents whose ids come first by hash.
At first each of their windows has its document's label, later a toxic text's best window stands for it. Every text is scored whole.

Defined results: a null text counts as empty; a text without words is one window without words, whose pooled state is 0.
Labels: as in ``quality``. With labels of one class only, or none, every score is that class' share (0.5
without labels); with so few that margins don't rise with the labels, the share of class 1. Rows are independent: repeated documents get equal scores; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .quality import agreed_labels, fit_logistic, labelled_sample
from .texthash import ODD, Words, chunks, flat_ranges, mix

WINDOW, STRIDE = 64, 32
#: Rows of the tables of word and character vectors, their width, and the states of each direction.
BITS, WIDTH, STATES = 16, 8, 8
#: Bits of a word's place in the table of evidence, and folds of texts whose words get their evidence from the other folds.
EVIDENCE_BITS, FOLDS = 18, 5
#: Rows of the tables that fewer sample texts have stay 0, as they would only be learnt by heart.
LEAST_TEXTS = 4
GRAMS = (3, 4, 5)
#: ASCII but letters and digits separates words.
SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Sample texts with which the tables learn at the full rate; with fewer, which they would only learn by heart, slower.
ENOUGH = 1600
#: Twice the steps that a network of few texts makes on all windows, in whole epochs.
STEPS = 60
#: Windows that are run at once.
AT_ONCE = 4096
f32 = np.float32


def encode(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of some texts: each word's number among the distinct ones, first word of each text (one more than texts), and for
    the distinct words their character grams' rows (in a row, and how many each has), and their places in the table of evidence, whose upper bits are their word rows."""
    w = Words([(t or b"").translate(SEPARATE) for t in texts], lower=True)
    shift, places = np.uint64(64 - BITS), np.uint64(64 - EVIDENCE_BITS)
    kinds, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
    size = (w.end - w.start)[first]
    n = size + 2
    at = np.cumsum(n) - n
    buf = np.full(int(n.sum()) + 4, 3, np.uint64)
    buf[at] = 1
    buf[at + n - 1] = 2
    buf[flat_ranges(at + 1, size)] = w.buf[flat_ranges(w.start[first], size)].astype(np.uint64) + np.uint64(4)
    rows, counts = [], []
    for g in GRAMS:
        h = buf[: len(buf) - 4] + np.uint64(g)
        for k in range(1, g):
            h = h * ODD + buf[k : len(buf) - 4 + k]
        have = np.maximum(n - g + 1, 1)
        rows.append((mix(h) >> shift).astype(np.int64)[flat_ranges(at, have)])
        counts.append(have)
    where = np.argsort(np.concatenate([np.repeat(np.arange(len(n)), c) for c in counts]), kind="stable")
    return number, w.first, [np.concatenate(rows)[where], sum(counts)], (mix(kinds * ODD) >> places).astype(np.int64)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of each window; each text has one at least."""
    size = np.diff(first)
    n = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(k * STRIDE, np.maximum(0, size[text] - WINDOW))
    return first[text] + start, np.minimum(size[text], WINDOW), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * np.tanh(f32(0.5) * x) + f32(0.5)


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(f32)

    p = {"words": normal(1 << BITS, WIDTH, scale=0.05), "chars": normal(1 << BITS, WIDTH, scale=0.1)}
    for d in "fb":
        p |= {f"in_{d}": normal(WIDTH, 3 * STATES, scale=WIDTH**-0.5), f"rec_{d}": normal(STATES, 3 * STATES, scale=STATES**-0.5), f"bias_{d}": np.zeros(3 * STATES, f32)}
    p |= {"att": normal(2 * STATES, 2 * STATES, scale=(2 * STATES) ** -0.5), "key": normal(2 * STATES, scale=0.5), "out": normal(2 * STATES, scale=0.3), "bias": np.zeros(1, f32)}
    p |= {"voice": normal(WIDTH, scale=1.0)}
    return p


def evidence(text: np.ndarray, place: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each place of the table its evidence, from the texts with labels ``y`` and the (text, place) of their words."""
    have = np.unique(text << EVIDENCE_BITS | place)
    of, place = y[have >> EVIDENCE_BITS], have & (1 << EVIDENCE_BITS) - 1
    pos, neg = (np.bincount(place[of == c], minlength=1 << EVIDENCE_BITS) for c in (1, 0))
    out = np.log((pos + 1) / ((y == 1).sum() + 2)) - np.log((neg + 1) / ((y == 0).sum() + 2))
    return np.where(pos + neg >= LEAST_TEXTS, np.clip(out, -3, 3), 0).astype(f32)


def vectors(p: dict, grams: list[np.ndarray], rows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Input of each distinct word; ``known``: its evidence."""
    flat, n = grams
    if not len(n):
        return np.zeros((0, WIDTH), f32)
    return known[:, None] * p["voice"] + p["words"][rows] + np.add.reduceat(p["chars"][flat], np.cumsum(n) - n) / n[:, None].astype(f32)


def run_layer(x: np.ndarray, there: np.ndarray, p: dict, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (steps, windows, STATES) of one direction over inputs x (steps, windows, 3 * STATES), already
    multiplied by the input weights. Steps that aren't ``there`` leave the state as it is."""
    rec, s = p[f"rec_{d}"], STATES
    h = np.zeros((x.shape[1], s), f32)
    out, kept = np.zeros((len(x), x.shape[1], s), f32), []
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        gate = sigmoid(x[t, :, : 2 * s] + h @ rec[:, : 2 * s])
        r, z = gate[:, :s], gate[:, s:]
        hr = h * r
        c = np.tanh(x[t, :, 2 * s :] + hr @ rec[:, 2 * s :])
        on = there[t][:, None]
        if keep:
            kept.append((t, h, r, z, hr, c))
        h = h + (c - h) * z * on
        out[t] = h
    return out, kept


def forward(p: dict, inputs: dict[str, np.ndarray], index: np.ndarray, there: np.ndarray, keep: bool = False):
    """Logit of each window. inputs: of each distinct word by direction, with a last row for none."""
    parts = {d: run_layer(inputs[d][index], there, p, d, keep) for d in "fb"}
    h = np.concatenate([parts["f"][0], parts["b"][0]], axis=2)
    u = np.tanh(h @ p["att"])
    e = np.where(there > 0, u @ p["key"], f32(-1e9))
    a = np.exp(e - e.max(axis=0)) * there
    a /= np.maximum(a.sum(axis=0), f32(1e-9))
    pooled = (a[:, :, None] * h).sum(axis=0)
    logit = pooled @ p["out"] + p["bias"][0]
    return logit, (parts, h, u, a, pooled)


def backward(p: dict, d_logit: np.ndarray, state: tuple, there: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
    """Gradients of the weights, and of the inputs of each direction (steps, windows, 3 * STATES)."""
    parts, h, u, a, pooled = state
    s = STATES
    g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], f32)}
    d_pool = d_logit[:, None] * p["out"]
    dh = a[:, :, None] * d_pool
    da = (h * d_pool).sum(axis=2)
    de = a * (da - (a * da).sum(axis=0))
    g["key"] = np.tensordot(de, u, ([0, 1], [0, 1]))
    du = de[:, :, None] * p["key"] * (1 - u * u)
    g["att"] = np.tensordot(h, du, ([0, 1], [0, 1]))
    dh = dh + du @ p["att"].T
    dx = {}
    for d, lo in (("f", 0), ("b", s)):
        rec = p[f"rec_{d}"]
        grad, carry = np.zeros_like(rec), np.zeros((h.shape[1], s), f32)
        dx[d] = np.zeros((len(h), h.shape[1], 3 * s), f32)
        for t, before, r, z, hr, c in reversed(parts[d][1]):
            total = dh[t, :, lo : lo + s] + carry
            step = total * there[t][:, None]
            dz = step * (c - before) * z * (1 - z)
            dc = step * z * (1 - c * c)
            d_hr = dc @ rec[:, 2 * s :].T
            dr = d_hr * before * r * (1 - r)
            gates = np.concatenate([dr, dz], axis=1)
            carry = total - step * z + d_hr * r + gates @ rec[:, : 2 * s].T
            grad[:, : 2 * s] += before.T @ gates
            grad[:, 2 * s :] += hr.T @ dc
            dx[d][t, :, : 2 * s], dx[d][t, :, 2 * s :] = gates, dc
        g[f"rec_{d}"] = grad
        g[f"bias_{d}"] = dx[d].sum(axis=(0, 1))
    return g, dx


def layer_inputs(p: dict, x: np.ndarray) -> dict[str, np.ndarray]:
    return {d: np.concatenate([x @ p[f"in_{d}"] + p[f"bias_{d}"], np.zeros((1, 3 * STATES), f32)]) for d in "fb"}


def laid_out(number: np.ndarray, start: np.ndarray, n: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, windows): the word at each step, and 1 where there is one."""
    t = np.arange(max(1, int(n.max())))[:, None]
    there = t < n
    index = np.full(there.shape, none, np.int64)
    index[there] = number[(start + t)[there]]
    return index, there.astype(f32)


def window_logits(p: dict, number: np.ndarray, start: np.ndarray, n: np.ndarray, grams: list[np.ndarray], rows: np.ndarray, known: np.ndarray) -> np.ndarray:
    inputs, out = layer_inputs(p, vectors(p, grams, rows, known)), []
    for at in range(0, len(start), AT_ONCE):
        own = slice(at, at + AT_ONCE)
        out.append(forward(p, inputs, *laid_out(number, start[own], n[own], len(rows)))[0].astype(np.float64))
    return np.concatenate(out)


def margins(p: dict, texts: list[bytes | None]) -> np.ndarray:
    """Greatest logit of each text's windows."""
    out = np.full(len(texts), -np.inf)
    for lo, hi in chunks(texts, 1 << 21):
        number, first, grams, places = encode(texts[lo:hi])
        start, n, text = windows(first)
        np.maximum.at(out, lo + text, window_logits(p, number, start, n, grams, places >> EVIDENCE_BITS - BITS, p["evidence"][places]))
    return out


def fit_network(texts: list[bytes], y: np.ndarray, epochs: int = 1, refine: int | None = None, batch: int = 256, rate: float = 0.01, seed: int = 11) -> dict:
    """Weights after Adam on the windows' log loss; both classes weigh the same together. In the last ``refine`` epochs (more with few texts)
    a text of class 1 gives only its best window, as most of a toxic text may be harmless."""
    rng = np.random.default_rng(seed)
    p = start_weights(rng)
    number, first, (flat, n_grams), places = encode(texts)
    start, n, text = windows(first)
    label = y[text].astype(f32)
    # a word of each fold is one of its own, with the evidence of the other folds
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    p["evidence"] = evidence(of, places[number], y)
    kinds, number = np.unique(number * FOLDS + of % FOLDS, return_inverse=True)
    word, fold = kinds // FOLDS, kinds % FOLDS
    known = np.zeros(len(kinds), f32)
    for k in range(FOLDS):
        own = np.arange(len(texts)) % FOLDS == k
        others = np.cumsum(~own) - 1
        rest = ~own[of]
        known[fold == k] = evidence(others[of[rest]], places[word[number[rest]]], y[~own])[places[word[fold == k]]]
    at = np.cumsum(n_grams) - n_grams
    flat, n_grams, rows = flat[flat_ranges(at[word], n_grams[word])], n_grams[word], places[word] >> EVIDENCE_BITS - BITS
    gram_at = np.cumsum(n_grams) - n_grams
    # texts that have a row, by distinct words of each
    words_in = np.unique(np.repeat(np.arange(len(texts)), np.diff(first)) * len(rows) + number)
    whose, which = words_in // max(1, len(rows)), words_in % max(1, len(rows))
    common = {}
    for name, own, row in (("words", whose, rows[which]), ("chars", np.repeat(whose, n_grams[which]), flat[flat_ranges(gram_at[which], n_grams[which])])):
        common[name] = np.bincount(np.unique(own << BITS | row) & (1 << BITS) - 1, minlength=1 << BITS) >= LEAST_TEXTS
        p[name][~common[name]] = 0
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items() if k != "evidence"}
    refine = refine or (4 if len(texts) >= ENOUGH else 12)
    step, epochs = 0, epochs * max(1, STEPS // 2 * batch // max(1, len(start)))
    for epoch in range(epochs + refine):
        order = np.arange(len(start))
        if epoch >= epochs:
            logit = window_logits(p, number, start, n, [flat, n_grams], rows, known)
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, text, logit)
            order = order[(label == 0) | (logit == best[text])]
        weight = np.where(label > 0, 0.5 / max(1, label[order].sum()), 0.5 / max(1, (1 - label[order]).sum())).astype(f32) * len(order)
        order = rng.permutation(order)
        for at in range(0, len(order), batch):
            here = order[at : at + batch]
            words = np.unique(np.concatenate([np.zeros(0, np.int64), number[flat_ranges(start[here], n[here])]]))
            grams = flat[flat_ranges(gram_at[words], n_grams[words])]
            x = vectors(p, [grams, n_grams[words]], rows[words], known[words])
            index, there = laid_out(number, start[here], n[here], -1)
            index = np.where(there > 0, np.searchsorted(words, index), len(words))
            logit, state = forward(p, layer_inputs(p, x), index, there, keep=True)
            d_logit = (sigmoid(logit) - label[here]) * weight[here] / f32(len(here))
            g, dx = backward(p, d_logit, state, there)
            dw = np.zeros((len(words), WIDTH), f32)
            for d in "fb":
                flat_dx = np.zeros((len(words) + 1, 3 * STATES), f32)
                np.add.at(flat_dx, index.ravel(), dx[d].reshape(-1, 3 * STATES))
                g[f"in_{d}"] = x.T @ flat_dx[:-1]
                dw += flat_dx[:-1] @ p[f"in_{d}"].T
            g["voice"] = known[words] @ dw
            for name, where, value in (("words", rows[words], dw), ("chars", grams, np.repeat(dw / n_grams[words, None].astype(f32), n_grams[words], axis=0))):
                g[name] = (where, value)
            step += 1
            size = rate / (1 + step / 400)
            slow = size * min(1.0, len(texts) / ENOUGH) ** 2
            for name, grad in g.items():
                m, v = moments[name]
                if isinstance(grad, tuple):  # only the rows that the batch has
                    hit, back = np.unique(grad[0], return_inverse=True)
                    value = np.zeros((len(hit), WIDTH), f32)
                    np.add.at(value, back, grad[1])
                    hit, value = hit[common[name][hit]], value[common[name][hit]]
                else:
                    hit, value = slice(None), grad
                own = slow if name in ("words", "chars") else size
                m[hit] = f32(0.9) * m[hit] + f32(0.1) * value
                v[hit] = f32(0.99) * v[hit] + f32(0.01) * value * value
                p[name][hit] -= f32(own) * m[hit] / (1 - f32(0.9) ** step) / (np.sqrt(v[hit] / (1 - f32(0.99) ** step)) + f32(1e-6))
    return p


def fit(texts: list[bytes], y: np.ndarray, share: float) -> dict:
    """Network and logistic curve. Of many texts every fifth of each class, in the order given, is for the curve alone. Fewer than ``ENOUGH``
    can't spare any: their margins are those of the network that learns from them, whose evidence comes from other texts and whose tables
    hardly move."""
    if len(set(y.tolist())) < 2:
        share = min(max(share if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return {"net": None, "a": 0.0, "b": float(np.log(share / (1 - share)))}
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[4::5]] = True
    if len(y) < ENOUGH or len(set(y[held].tolist())) < 2:
        held[:] = True
    learn = held.all() | ~held
    net = fit_network([t for t, k in zip(texts, learn, strict=True) if k], y[learn])
    margin, y = margins(net, [t for t, k in zip(texts, held, strict=True) if k]), y[held]
    a, b = fit_logistic(margin, y, share)
    if a < 0:  # margins of other texts tell nothing, as there are too few to learn from
        a, b = 0.0, float(np.log(share / (1 - share)))
    return {"net": net, "a": a, "b": b}


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = 1200) -> dict:
    """A model of documents' ``label``; its sample, the only thing sent to the driver, is bounded."""
    agreed = agreed_labels(labels, label, learn)
    counts = {r.y: r.n for r in agreed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    found = labelled_sample(docs, agreed, per_class).select("doc_id", F.col("y").cast("int").alias("y"), "raw").collect()
    rows = sorted((r.doc_id, r.y, bytes(r.raw or b"")) for r in found)
    return fit([t for _, _, t in rows], np.array([y for _, y, _ in rows]), share)


def score(docs: DataFrame, model: dict, into: str = "score") -> DataFrame:
    """docs with the score in column ``into``, instead of any it had; other columns pass through."""
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 2 MB, whatever the input's size
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                raw = part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                margin = margins(m["net"], raw) if m["net"] else np.zeros(len(raw))
                p = 1 / (1 + np.exp(-np.clip(m["a"] * margin + m["b"], -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, into])

    return docs.mapInArrow(apply, schema)
