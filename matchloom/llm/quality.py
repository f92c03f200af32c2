"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is described by its bytes and words and
encoded by a learned layer; gated attention weighs the passages, and the weighted sum of
their encodings gives the score. Encoder, gates and output are learned together from
document labels, on a bounded sample of labelled documents (``max_docs``); every text is
scored whole.

Defined cases: a null or empty text is one empty passage and gets a score like any
other; without labelled rows every score is 0.5; with one label only the model learns
just that; a document labelled more than once counts with its smallest label; rows with
a null label are left out; repeated rows are scored alike; other columns pass through
inside ``doc``.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.flat import BLANK, PART_BYTES, Texts, Words, released

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PASSAGE_WORDS = 128
BUCKETS = 256
HIDDEN, GATES = 32, 16
# Labelled documents that a model is fitted on at most.
MAX_DOCS = 4000
EPOCHS = 40
THRESHOLD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_WIDE = np.arange(256) >= 128
_BREAK = np.zeros(256, bool)
_BREAK[10] = True
CLASSES = (_UPPER, _DIGIT, _MARK, _WIDE, _BREAK)
FEATURES = BUCKETS + len(CLASSES) + 5


def passages(texts: Texts, width: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the first passage of each text; every text has one.

    Made by parts: a part's arrays are many times as large as its bytes.
    """
    found = []
    for before, part in texts.parts(PART_BYTES):
        rest = texts.data[before + len(part.data) :]
        solid = ~BLANK[rest]
        # A passage's last byte makes a pair with the first of the next one.
        found.append(_passages(part, width, rest[[solid.argmax()]] if solid.any() else rest[:0]))
    before = np.cumsum([0, *(len(x) for x, _ in found)])
    x = np.concatenate([np.zeros((0, FEATURES), np.float32), *(x for x, _ in found)])
    return x, np.concatenate([np.zeros(0, np.int64), *(first + n for (_, first), n in zip(found, before))])


def _passages(texts: Texts, width: int, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words.of(texts)
    n_words = np.diff(words.first)
    n = np.maximum(1, -(-n_words // width))
    first = np.concatenate([[0], np.cumsum(n)])
    total = int(first[-1])
    of_text = np.repeat(np.arange(len(n)), n)
    # Passage of each word, then of each byte between a passage's first and last word.
    text_of_word = np.repeat(np.arange(len(n)), n_words)
    of_word = first[text_of_word] + (np.arange(len(words.start)) - words.first[text_of_word]) // width
    out = np.zeros((total, FEATURES), np.float32)
    if not len(of_word):
        return out, first[:-1]
    from_word = np.searchsorted(of_word, np.arange(total))
    to_word = np.searchsorted(of_word, np.arange(total), "right")
    filled = from_word < to_word
    start = np.zeros(total, np.int64)
    end = np.zeros(total, np.int64)
    start[filled] = words.start[from_word[filled]]
    end[filled] = words.end[to_word[filled] - 1]
    size = end - start
    of_byte = np.repeat(np.arange(total), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + start[of_byte]
    byte = texts.data[at]
    scale = 1.0 / np.maximum(size, 1)
    after = np.append(byte[1:], follows)
    pair = (byte[: len(after)].astype(np.int64) * 151 + after * 59) % BUCKETS
    pair += of_byte[: len(after)] * BUCKETS
    counts = np.bincount(pair, minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(counts * scale[:, None])
    for i, table in enumerate(CLASSES):
        out[:, BUCKETS + i] = np.bincount(of_byte[table[byte]], minlength=total) * scale
    count = (to_word - from_word).astype(float)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(of_word, length, total) / np.maximum(count, 1)
    square = np.bincount(of_word, length**2, total) / np.maximum(count, 1)
    order = np.lexsort((words.hashes, of_word))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (
        of_word[order][1:] != of_word[order][:-1]
    )
    distinct = np.bincount(of_word[order][fresh], minlength=total)
    out[:, BUCKETS + len(CLASSES) :] = np.stack(
        [
            np.log1p(count),
            mean / 10,
            np.sqrt(np.maximum(square - mean**2, 0)) / 10,
            distinct / np.maximum(count, 1),
            np.log1p(n_words[of_text]),
        ],
        axis=1,
    )
    return out, first[:-1]


@dataclass
class Model:
    """Weights by name, and what features are scaled by."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        x = np.clip((x - self.mean) * self.scale, -8, 8)
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (t * g) @ w["w"]
        e = np.exp(a - np.maximum.reduceat(a, first)[of])
        alpha = e / np.add.reduceat(e, first)[of]
        z = np.add.reduceat(alpha[:, None] * h, first)
        logit = np.clip(z @ w["c"] + w["d"], -30, 30)
        return {"of": of, "x": x, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "p": 1 / (1 + np.exp(-logit))}

    def gradients(self, f: dict, y: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, of = self.weights, f["of"]
        error = (f["p"] - y) / len(y)
        dz = (error[:, None] * w["c"])[of]
        d_alpha = (dz * f["h"]).sum(1)
        da = f["alpha"] * (d_alpha - np.add.reduceat(f["alpha"] * d_alpha, first)[of])
        gated = da[:, None] * w["w"]
        dt = gated * f["g"] * (1 - f["t"] ** 2)
        dg = gated * f["t"] * f["g"] * (1 - f["g"])
        dh = f["alpha"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T
        pre = dh * (1 - f["h"] ** 2)
        return {
            "c": f["z"].T @ error, "d": error.sum(keepdims=True), "w": (f["t"] * f["g"]).T @ da,
            "V": f["h"].T @ dt, "U": f["h"].T @ dg, "W": f["x"].T @ pre, "b": pre.sum(0),
        }


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Adam on the cross entropy of the documents' labels."""
    random = np.random.default_rng(seed)
    draw = lambda *shape: random.normal(0, shape[0] ** -0.5, shape)
    weights = {
        "W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES),
        "U": draw(HIDDEN, GATES), "w": draw(GATES), "c": draw(HIDDEN), "d": np.zeros(1),
    }
    if not len(labels):
        return Model({k: np.zeros_like(v) for k, v in weights.items()}, np.zeros(FEATURES), np.ones(FEATURES))
    x = x.astype(float)
    model = Model(weights, x.mean(0), 1 / (x.std(0) + 1e-3))
    ends = np.append(first[1:], len(x))
    one = {k: np.zeros_like(v) for k, v in weights.items()}
    two = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        order = random.permutation(len(labels))
        for a in range(0, len(order), 64):
            docs = order[a : a + 64]
            rows = np.concatenate([np.arange(first[i], ends[i]) for i in docs])
            own = np.concatenate([[0], np.cumsum(ends[docs] - first[docs])[:-1]])
            found = model.forward(x[rows], own)
            step += 1
            for k, g in model.gradients(found, labels[docs], own).items():
                g = g + 1e-4 * weights[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                m, v = one[k] / (1 - 0.9**step), two[k] / (1 - 0.999**step)
                weights[k] = weights[k] - rate * m / (np.sqrt(v) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit on at most ``max_docs`` labelled documents, chosen by a hash of their id."""
    marked = (
        labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
    )
    # At most max_docs pairs of numbers.
    chosen = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, first = passages(Texts.of(batch.column("text")))
            ends = np.append(first[1:], len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()),
                 pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())],
                names=["doc_id", "quality", "x"],
            )

    rows = chosen.mapInArrow(released(encode), "doc_id bigint, quality int, x binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])[: len(bags)].astype(np.int64)
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    return fit(x, first, np.array([float(r["quality"] >= 1) for r in rows]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Columns ``doc`` (a struct of all input columns), ``score`` and ``n_passages``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    schema = T.StructType(
        [rows.schema["doc"], T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType())]
    )

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = Texts.of(batch.column("doc").field("text"))
            scores, counts = [], []
            for _, part in texts.parts(1 << 20):  # about 1 MB of text at a time
                x, first = passages(part)
                scores.append(model.forward(x, first)["p"])
                counts.append(np.diff(np.append(first, len(x))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(np.concatenate(scores)), pa.array(np.concatenate(counts))],
                names=["doc", "score", "n_passages"],
            )

    return rows.mapInArrow(released(score), schema)


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Train on ``labels`` and score all ``docs``: doc, score, predicted, held_out, n_passages."""
    model = train(docs, labels, max_docs)
    return score_documents(docs, model).withColumns(
        {
            "predicted": (F.col("score") >= THRESHOLD).cast("int"),
            "held_out": held_out(F.col("doc.doc_id")),
        }
    )
