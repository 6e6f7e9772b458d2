"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, arrow_map, drop, flat, sliced, stream, text_bytes, trim, written

#: Bytes of a passage, at most; a document's passages are of nearly equal length.
PASSAGE_BYTES = 512
#: Labelled documents that training takes, about (chosen by a hash of the id), each whole.
TRAINING_DOCS = 4000
#: Passages that the documents of training may have in all; those that do not fit any more are not of the sample.
TRAINING_PASSAGES = 100_000
KINDS = 16

#: The kind of each byte: spaces 0-1, vowels 2, other small letters 3, capitals 4, digits 5, marks 6-13, UTF-8 14-15.
KIND = np.full(256, 13, np.uint8)
for kind, chars in enumerate((" ", "\n\r\t\v\f", "aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "|", "!?", "#$%&*@^~_+=<>\\/", "'\"-:;", "()[]{}")):
    KIND[[ord(c) for c in chars]] = kind
KIND[0x80:0xC0] = 15
KIND[0xC0:] = 14
WORD_CODES = np.random.default_rng(11).integers(1, 1 << 62, 256, np.int64)
FEATURES = KINDS * KINDS + 4


def passages(lengths: np.ndarray) -> np.ndarray:
    """How many passages each document has: one at least, also if empty."""
    return np.maximum(1, -(-lengths // PASSAGE_BYTES))


def segments(text: bytes) -> list[bytes]:
    """A text as parts of nearly equal length of at most STEP_BYTES, that are encoded one by one."""
    n = -(-len(text) // STEP_BYTES)
    return [text] if n < 2 else [text[k * len(text) // n : (k + 1) * len(text) // n] for k in range(n)]


def by_steps(texts: list[bytes], made) -> tuple[np.ndarray, np.ndarray]:
    """made(encoded()) of all passages of whole texts, a step of about STEP_BYTES after the other, and the number of
    passages of each text."""
    out, number = [], np.zeros(len(texts), np.int64)
    held, own, size = [], [], 0

    def step():
        x, n = encoded(held)
        out.append(made(x))
        np.add.at(number, own, n)

    for i, text in enumerate(texts):
        for part in segments(text):
            if held and size + len(part) > STEP_BYTES:
                step()
                held, own, size = [], [], 0
            held.append(part)
            own.append(i)
            size += len(part)
    if held:
        step()
    return np.concatenate(out), number


def encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of texts, or segments of texts, and the number of passages of each.

    Shares of pairs of adjacent kinds of byte (square roots), words, their mean length, words that repeat the last one,
    and bytes; all a function of the text alone.
    """
    data, bounds = flat(texts)
    lengths = np.diff(bounds)
    number = passages(lengths)
    total = int(number.sum())
    of = np.repeat(np.arange(len(texts)), number)
    k = np.arange(total) - np.repeat(np.cumsum(number) - number, number)
    starts = bounds[of] + k * lengths[of] // number[of]
    sizes = np.diff(starts, append=len(data))
    x = np.zeros((total, FEATURES), np.float32)
    if not len(data):
        return x, number
    own = np.repeat(np.arange(total), sizes)
    kinds = KIND[data]
    pair = (own[:-1] * KINDS + kinds[:-1]).astype(np.int64) * KINDS + kinds[1:]
    pair = pair[own[:-1] == own[1:]]
    shares = np.bincount(pair, minlength=total * KINDS * KINDS).reshape(total, -1)
    x[:, : KINDS * KINDS] = np.sqrt(shares / np.maximum(1, shares.sum(axis=1, keepdims=True)))
    inside = kinds > 1
    apart = np.concatenate([[True], ~inside[:-1]])
    apart[bounds[:-1][lengths > 0]] = True  # a text's first word is its own
    begin = np.flatnonzero(inside & apart)
    if len(begin):
        place = np.arange(begin[0], len(data)) - np.repeat(begin, np.diff(begin, append=len(data)))
        words = np.add.reduceat(np.where(inside[begin[0] :], WORD_CODES[data[begin[0] :]] * (2 * place + 1), 0), begin - begin[0])
        text = of[own[begin]]
        again = np.concatenate([[False], (words[1:] == words[:-1]) & (text[1:] == text[:-1])])
        count = np.bincount(own[begin], minlength=total)
        x[:, -4] = count / np.maximum(1, sizes) * 5
        x[:, -3] = np.minimum(4, np.bincount(own[inside], minlength=total) / np.maximum(1, count) / 8)
        x[:, -2] = np.bincount(own[begin], again, minlength=total) / np.maximum(1, count)
    x[:, -1] = sizes / PASSAGE_BYTES
    return x, number


class Model:
    """Gated attention over encoded passages: h = tanh(x W + b); attention softmax(w . tanh(h V) sigmoid(h U));
    score = sigmoid(u . sum(a h) + c). Attention's logits are summed over a document alone."""

    def __init__(self, seed: int = 5, hidden: int = 32, gate: int = 16):
        r = np.random.default_rng(seed)
        s = lambda *n: r.normal(0, n[0] ** -0.5, n)
        self.p = {"W": s(FEATURES, hidden) * 3, "b": np.zeros(hidden), "V": s(hidden, gate), "U": s(hidden, gate), "w": s(gate), "u": s(hidden), "c": np.zeros(1)}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean.astype(np.float32)) / self.scale.astype(np.float32)).astype(np.float32)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """The passages' hidden layer; x: scaled features."""
        return np.tanh((x @ self.p["W"].astype(np.float32)).astype(float) + self.p["b"])

    def forward(self, h: np.ndarray, number: np.ndarray) -> dict:
        """What attention makes of the passages' hidden layer."""
        p, starts = self.p, np.cumsum(number) - number
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * g) @ p["w"]
        top = np.repeat(np.maximum.reduceat(e, starts), number)
        a = np.exp(e - top)
        a /= np.repeat(np.add.reduceat(a, starts), number)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["u"] + p["c"], -30, 30)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "starts": starts}

    def gradient(self, x: np.ndarray, number: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by parameter; x: scaled features."""
        p, own, f = self.p, np.repeat(np.arange(len(number)), number), self.forward(self.hidden(x), number)
        dy = (f["y"] - label) / len(label)
        dz = dy[:, None] * p["u"]
        da = (dz[own] * f["h"]).sum(axis=1)
        mean = np.add.reduceat(f["a"] * da, f["starts"])
        de = f["a"] * (da - mean[own])
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[own] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": (x.T @ dh.astype(np.float32)).astype(float), "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "u": f["z"].T @ dy, "c": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, number: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.01, decay: float = 1e-4) -> Model:
        """Adam on the whole sample's mean log loss."""
        self.mean, self.scale = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float) + 0.02
        x = self.scaled(x)
        p, m, v = self.p, {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        for step in range(1, rounds + 1):
            grad = self.gradient(x, number, label)
            for k, g in grad.items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.forward(*by_steps(texts, lambda x: self.hidden(self.scaled(x))))["y"]


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", training_docs: int = TRAINING_DOCS, training_passages: int = TRAINING_PASSAGES) -> Model:
    """A model of the labelled rows given: about training_docs of them, by a hash of the id, with all their passages.

    Whole documents are taken in the order of the hash, without those that would make it more than training_passages
    passages. Rows without id or label teach nothing; a null text is one empty passage; without any row the model is
    untrained and scores all documents alike. Rows that repeat an id teach each.
    """
    known = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label_col}`").cast("double").alias("label"))
    share = min(1.0, training_docs / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # about training_docs rows
    rows = docs.select(F.col(f"`{id_col}`").alias("label_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "label_id")
    taken = written(rows.select("text", F.xxhash64("label_id", "text").alias("k"), "label"), "sample")
    sizes = taken.select("k", F.octet_length("text").alias("n")).toArrow().sort_by([("k", "ascending"), ("n", "ascending")])  # a row a document of the sample
    whole = taken.where(~F.col("k").isin(over)) if (over := fits_not(sizes, training_passages)) else taken

    def step(cols, state):
        parts = [by_steps([x], lambda f: f.astype(np.float16))[0].tobytes() for x in text_bytes(cols[0])]
        return [cols[1], cols[2], pa.array(parts, pa.large_binary()).cast(pa.binary())]

    sample = stream(whole, step, [F.col("text"), F.col("k"), F.col("label")], "k long, label double, x binary").toArrow().sort_by([("k", "ascending"), ("label", "ascending")])
    drop(taken)
    model = Model()
    if sample.num_rows:
        xs = [np.frombuffer(b, np.float16).reshape(-1, FEATURES) for b in sample["x"].to_pylist()]
        number, label, x = np.array([len(x) for x in xs]), sample["label"].to_numpy(), np.concatenate(xs)
        del sample, xs
        model.fit(x, number, label)
    trim()
    return model


def fits_not(sizes: pa.Table, most: int) -> list[int]:
    """Keys of the documents (k, n bytes), in order, that would make it more than so many passages."""
    out = []
    for k, n in zip(sizes["k"].to_pylist(), passages(sizes["n"].to_numpy()).tolist()):
        if n > most:
            out.append(k)
        else:
            most -= n
    return out


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold) of every row, from all passages of its whole text; a null or
    empty text is one passage of nothing. Repeated rows get a row each."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(cols, state):
        y = model.scores(text_bytes(cols[1]))
        return [cols[0], y, (y >= threshold).astype(np.int32)]

    return stream(docs, step, [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")], f"doc_id {kind}, score double, predicted int")


def kept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all their columns, whose text the model gives at least the threshold. Each row is judged by its
    whole text alone, so rows of one text, ids that repeat or are null, stay or go alike; a null or empty text is one
    passage of nothing. An empty table gives no rows."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for few in sliced(batch):
                yield few.filter(pa.array(model.scores(text_bytes(few.column(at).cast(pa.string()))) >= threshold))

    return arrow_map(docs, run, docs.schema)
