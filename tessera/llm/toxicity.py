"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, all hashed into
one table; a window's vector is the mean over its words; a linear layer and softmax give its class. Table and
layer are trained together in numpy. Labels are of documents, while a few words make one toxic, so training
goes in two passes: first every window carries its document's label, then a toxic document is represented by
the windows that the first pass holds for toxic. A document's score is that of its most toxic window, so
length doesn't dilute it. As averages and the layer are linear, scoring needs one number for each word."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_rows, map_texts, stash, table

WORDS = re.compile(r"[^\W\d_]+").findall
SCHEMA = "doc_id long, score double"


def grams(word: str, buckets: int) -> list[int]:
    """Hashed n-grams of 3 to 5 characters of <word>, and the word itself; buckets is a power of two."""
    b, mask = f"<{word}>".encode("utf-16-le", "replace"), buckets - 1
    out = [zlib.crc32(b[i : i + n]) & mask for n in (6, 8, 10) for i in range(0, len(b) - n + 1, 2)]
    out.append(zlib.crc32(b) & mask)
    return out


@dataclass
class Model:
    table: np.ndarray  # buckets x dim
    layer: np.ndarray  # dim x 2
    bias: np.ndarray  # 2
    window: int
    scale: float = 1.0  # of a document's lead and
    shift: float = 0.0  # what is added to it, fitted on documents kept back from training

    def leads(self) -> list[float]:
        """What each n-gram adds to the toxic class's lead over the other."""
        return (self.table @ (self.layer[:, 1] - self.layer[:, 0])).astype(float).tolist()

    def lead(self):
        """A function from a text to the lead of its most toxic window."""
        memo: dict[str, float] = {}
        lead, n, margin, width, memo_size = self.leads(), len(self.table), float(self.bias[1] - self.bias[0]), self.window, 100_000

        def known(w: str) -> float:
            if len(memo) >= memo_size:
                memo.clear()
            g = grams(w, n)
            memo[w] = out = sum([lead[i] for i in g]) / len(g)
            return out

        def most(text: str) -> float:
            x = np.array([memo[w] if w in memo else known(w) for w in WORDS(text.lower())])
            if not len(x):
                return margin
            starts = windows(len(x), width)
            return float((np.add.reduceat(x, starts) / np.diff(np.append(starts, len(x)))).max()) + margin

        return most

    def scorer(self):
        lead = self.lead()
        return lambda text: float(1 / (1 + np.exp(-np.clip(self.scale * lead(text) + self.shift, -500, 500))))


def windows(n: int, width: int) -> np.ndarray:
    """Starts of consecutive windows of `width` words; a rest of less than half joins the window before."""
    return np.arange(0, max(1, n - width // 2), width)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """scale and shift of a logistic curve from leads to labels, by Newton's steps with a weak prior on 1 and 0."""
    w, t = np.array([1.0, 0.0]), np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    f = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -500, 500)))
        h = (f * (p * (1 - p))[:, None]).T @ f + np.diag([1e-3, 1e-3])
        w = w - np.clip(np.linalg.solve(h, f.T @ (p - t) + 1e-3 * (w - np.array([1.0, 0.0]))), -3, 3)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _fit(words: list[list[int]], gram_lists: list[list[int]], label: np.ndarray, model: Model, steps: int, rate: float, ridge: float, slack: float) -> None:
    """Adam on all windows (word numbers) at once; each class has half the weight. The slack is well above the
    gradient of an n-gram that one text holds, and a ridge holds the table: n-grams that many toxic windows
    share move far, those of single texts hardly."""
    used, flat = np.unique(np.concatenate(words), return_inverse=True)
    size = np.array([len(x) for x in words])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    own = [gram_lists[i] for i in used]
    g_size = np.array([len(g) for g in own])
    g_all, g_start = np.concatenate(own), np.concatenate([[0], np.cumsum(g_size)[:-1]])
    share = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    params = [model.table, model.layer, model.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def spread(to: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(to, values[:, j], n) for j in range(values.shape[1])], 1).astype("f4")

    for step in range(steps):
        vec = np.add.reduceat(model.table[g_all], g_start) / g_size[:, None]
        win = np.add.reduceat(vec[flat], start) / size[:, None]
        z = win @ model.layer + model.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = p
        dz[np.arange(len(p)), label] -= 1
        dz *= share[:, None]
        d_win = (dz @ model.layer.T) / size[:, None]
        d_vec = spread(flat, np.repeat(d_win, size, 0), len(used)) / g_size[:, None]
        grads = [spread(g_all, np.repeat(d_vec, g_size, 0), len(model.table)) + ridge * model.table, win.T @ dz, dz.sum(0)]
        for x, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.05 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.95 ** (step + 1))) + slack)


def train(rows: list[tuple[str, int]], buckets: int = 1 << 16, dim: int = 4, window: int = 4, steps: int = 30, rate: float = 0.3, ridge: float = 3e-5, slack: float = 1e-5, rounds: int = 2, prior: float = 0.5, seed: int = 7) -> Model:
    """Fit on four fifths of rows (text, 0 or 1), scale and shift on the rest.

    In each round one model is fitted on each half of the documents and chooses, in the other half, the
    windows that stand for a toxic document: its most toxic one and those close to it. The last fit, from a
    fresh start, sees these windows against all windows of clean documents. rows hold as many texts of either
    class; prior is the share of toxic ones where the scores will be used."""
    rng = np.random.default_rng(seed)

    def fresh() -> Model:
        return Model(rng.normal(0, 0.01, (buckets, dim)).astype("f4"), rng.normal(0, 0.5, (dim, 2)).astype("f4"), np.zeros(2, "f4"), window)

    order = rng.permutation(len(rows))
    kept_back = [rows[i] for i in order[: len(rows) // 5]]
    rows = [rows[i] for i in order[len(rows) // 5 :]]
    ids: dict[str, int] = {}
    words, owners, labels = [], [], []
    for n, (text, y) in enumerate(rows):
        seq = [ids.setdefault(w, len(ids)) for w in WORDS((text or "").lower())]
        cuts = [*windows(len(seq), window).tolist(), len(seq)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                words.append(seq[a:b])
                owners.append(n)
                labels.append(y)
    if not words or len(set(labels)) < 2:
        return Model(np.zeros((buckets, dim), "f4"), np.zeros((dim, 2), "f4"), np.zeros(2, "f4"), window)
    gram_lists = [grams(w, buckets) for w in ids]
    owner, label = np.array(owners), np.array(labels)
    g_flat, g_size = np.concatenate(gram_lists), np.array([len(g) for g in gram_lists])
    g_start = np.concatenate([[0], np.cumsum(g_size)[:-1]])
    flat, size = np.concatenate(words), np.array([len(x) for x in words])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    use = np.ones(len(words), bool)
    for _ in range(rounds):
        lead = np.zeros(len(words))
        for half in (0, 1):
            pick = np.flatnonzero(use & (owner % 2 == half))
            m = fresh()
            if len(set(label[pick])) == 2:
                _fit([words[i] for i in pick], gram_lists, label[pick], m, steps, rate, ridge, slack)
            per_gram = np.array(m.leads())
            per_word = np.add.reduceat(per_gram[g_flat], g_start) / g_size
            lead = np.where(owner % 2 != half, np.add.reduceat(per_word[flat], start) / size, lead)
        best = np.full(len(rows), -np.inf)
        np.maximum.at(best, owner, lead)
        level = np.quantile(lead[label == 0], 0.995)
        use = (label == 0) | (lead >= best[owner] - 1e-9) | (lead >= level + 0.5 * np.maximum(0, best[owner] - level))
    pick = np.flatnonzero(use)
    model = fresh()
    _fit([words[i] for i in pick], gram_lists, label[pick], model, 2 * steps, rate, ridge, slack)
    if kept_back and len({y for _, y in kept_back}) == 2:
        of = model.lead()
        model.scale, model.shift = calibrate(np.array([of(t or "") for t, _ in kept_back]), np.array([y for _, y in kept_back]))
        model.shift += float(np.log(prior / (1 - prior)))
    return model


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[tuple[str, int]], float]:
    """At most per_class labelled texts of each class, by a hash of doc_id, and the share of toxic labels; only
    of rows whose crc32(doc_id as text) mod 4 isn't 2. Of contradicting labels the toxic one counts, a null
    label counts for nothing."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    known = stash(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    ids = {r["doc_id"]: r["toxic"] for r in picked.collect()}  # at most 2 x per_class rows
    if len(set(ids.values())) < 2:
        return [], 0.5
    prior = known.agg(F.avg("toxic")).first()[0]
    wanted = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, toxic long")
    got = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return sorted((r["text"] or "", int(r["toxic"])) for r in got.select("text", "toxic").toLocalIterator()), float(prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score in [0, 1] for every row; null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x dim floats, 2 MB whatever the input

    def make():
        score = shared.value.scorer()
        return lambda keys, texts: {"doc_id": keys, "score": [score(t) for t in texts]}

    return map_texts(docs, make, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 800, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    The model is fitted on at most 2 x per_class labelled documents (whole texts); every document is scored.
    Null doc_id: never learnt from, held_out null becomes false. Of texts that share a labelled doc_id the first in
    order is learnt from. Without labels of both classes nothing can be learnt: all scores are 0, none is
    predicted toxic. An empty table gives no rows; extra columns are ignored."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    rows, prior = sample(docs, labels, per_class)
    scored = score(docs, train(rows, prior=prior)) if rows else docs.select("doc_id", F.lit(0.0).alias("score"))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, per_class: int = 800, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that the model, fitted as in toxicity(), holds for toxic. Without labels of both
    classes there is no model and every row stays."""
    rows, prior = sample(docs, labels, per_class)
    if not rows:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, prior=prior))

    def make():
        score = shared.value.scorer()
        return lambda rows, texts: rows.filter(pa.array([score(t) < threshold for t in texts], pa.bool_()))

    return map_rows(docs, make)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
