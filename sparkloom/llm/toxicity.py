"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as two parts: an embedding of the word (hashed) and the mean of embeddings of its characters' n-grams.  Both
directions read windows of WINDOW words; attention pools each window to one logit, and a text's logit is the log of the summed
exponentials over all its overlapping windows, less a share SPREAD of the log of their number: no word of a text goes unread, and a stray word in a long
text stays one.  Short texts have one padded window;
null and empty texts, and texts without words, one of padding alone.

The network is trained on the driver on a bounded sample of labelled rows: by hash of the id, at most POSITIVES
toxic and NEGATIVES other rows of the learning part, of at most LONGEST_TRAINED words (what is scored has no such
bounds).  The true shares of both labels, counted over all labelled rows of the learning part, set the
bias right.  The first column of the embeddings starts from smoothed log-odds in the sample.  Labels, language,
source and id are never inputs of a score.  Where one label is missing, every score is the toxic share.  Of rows with the same id the one with the
least text is learnt from; every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import slices
from sparkloom.llm.words import Words, mixed, pieces, words_of

WINDOW, STRIDE, HIDDEN, PART, BUCKETS, ATTENTION = 64, 48, 8, 6, 1 << 15, 8
GRAMS, LETTERS = (3, 6), 18
POSITIVES, NEGATIVES, LONGEST_TRAINED, EPOCHS, DOCS_AT_ONCE, RATE = 1_200, 2_400, 1_500, 8, 64, 1e-2
WINDOWS_AT_ONCE, SPREAD = 4_096, 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def windows_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of each window; the last one of a longer text ends with it."""
    counts = np.diff(words.first)
    n = np.maximum(1, 1 + -(-(counts - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = words.first[:-1][text] + np.minimum(k * STRIDE, np.maximum(counts[text] - WINDOW, 0))
    return text, first, np.minimum(counts[text], WINDOW)


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, n-gram buckets and their mask of every distinct word; the distinct word of every word."""
    hashes, at, index = np.unique(words.hashes, return_index=True, return_inverse=True)
    starts, sizes = words.starts[at], words.ends[at] - words.starts[at]
    # letters behind a border mark; longer words show their first ones, whole words are in the other part
    place = np.arange(LETTERS - 1)
    letters = np.zeros((len(hashes), LETTERS), np.uint64)
    if len(hashes):
        letters[:, 0] = 1
        letters[:, 1:] = words.bytes[np.minimum(starts[:, None] + place, len(words.bytes) - 1)] * (place < sizes[:, None])
    rows, masks = [], []
    for size in GRAMS:
        for p in range(LETTERS - size + 1):
            h = np.full(len(hashes), size, np.uint64)
            for k in range(size):
                h = h * np.uint64(0x100000001B3) + letters[:, p + k]
            rows.append((mixed(h) % np.uint64(BUCKETS)).astype(np.int32))
            masks.append(p + size <= sizes + 1)
    return (hashes % np.uint64(BUCKETS)).astype(np.int32), np.stack(rows, 1), np.stack(masks, 1), index


def pooled_logits(logits: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """A logit for each text, and the share of each window in it."""
    begin = np.searchsorted(text, np.arange(texts))
    total = np.logaddexp.reduceat(logits, begin) if texts else logits
    return total - SPREAD * np.log(np.bincount(text, minlength=texts)), np.exp(logits - total[text])


class Network:
    """Weights by name; both directions lie on one axis."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        shape = {"word": (BUCKETS, PART), "gram": (BUCKETS, PART), "in": (2 * PART, 6 * HIDDEN), "bias": (6 * HIDDEN,), "back": (2, HIDDEN, 3 * HIDDEN), "new": (2, 1, HIDDEN), "look": (2 * HIDDEN, ATTENTION), "tilt": (ATTENTION,), "see": (ATTENTION,), "out": (2 * HIDDEN,), "base": (1,)}
        scale = {"word": 0.05, "gram": 0.05, "in": 0.3, "back": 0.3, "look": 0.3, "see": 0.3, "out": 0.3}
        w = {k: (rng.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in shape.items()}
        w["bias"][:HIDDEN] = w["bias"][3 * HIDDEN : 4 * HIDDEN] = 1  # start by remembering
        w["base"][0] = -3
        return cls(w)

    def embed(self, word: np.ndarray, grams: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = mask / np.maximum(mask.sum(1, keepdims=True), 1)
        chars = np.zeros((len(word), PART), np.float32)
        for k in range(grams.shape[1]):
            chars += self.w["gram"][grams[:, k]] * share[:, k : k + 1].astype(np.float32)
        return np.concatenate([self.w["word"][word], chars], 1), share

    def run(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, ...]:
        """Window logits. gates: of every distinct word, the last row padding; index: N x T; keep: gets what training needs."""
        n, t = index.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((t, n, 2 * HIDDEN), np.float32)
        for s in range(t):
            own = (index[:, s], index[:, t - 1 - s])
            live = np.stack([mask[:, s], mask[:, t - 1 - s]])[:, :, None]
            g = np.stack([gates[own[0], : 3 * HIDDEN], gates[own[1], 3 * HIDDEN :]])
            a = h @ self.w["back"]
            zr = np.tanh((g[:, :, : 2 * HIDDEN] + a[:, :, : 2 * HIDDEN]) * 0.5) * 0.5 + 0.5
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            an = a[:, :, 2 * HIDDEN :] + self.w["new"]
            new = np.tanh(g[:, :, 2 * HIDDEN :] + r * an)
            k = live * (1 - z)
            if keep is not None:
                keep.append((h, z, r, an, new, k, live))
            h = h + k * (new - h)
            states[s, :, :HIDDEN], states[t - 1 - s, :, HIDDEN:] = h[0], h[1]
        seen = np.tanh(states @ self.w["look"] + self.w["tilt"])
        e = seen @ self.w["see"] - 1e4 * (1 - mask.T)
        e = np.exp(e - e.max(0)) * mask.T
        share = e / np.maximum(e.sum(0), 1e-9)
        pooled = (share[:, :, None] * states).sum(0)
        return pooled @ self.w["out"] + self.w["base"][0], states, seen, share, pooled

    def score(self, texts: pa.Array) -> np.ndarray:
        """Logits of whole texts (no nulls)."""
        words = words_of(texts)
        word, grams, mask, index = distinct(words)
        x, _ = self.embed(word, grams, mask)
        gates = np.concatenate([x @ self.w["in"] + self.w["bias"], np.zeros((1, 6 * HIDDEN), np.float32)])
        text, first, size = windows_of(words)
        out = np.empty(len(text), np.float32)
        index = np.append(index, len(word))
        for a in range(0, len(text), WINDOWS_AT_ONCE):
            place = np.arange(WINDOW)
            live = place < size[a : a + WINDOWS_AT_ONCE, None]
            at = index[np.where(live, first[a : a + WINDOWS_AT_ONCE, None] + place, len(index) - 1)]
            out[a : a + WINDOWS_AT_ONCE] = self.run(gates, at, live.astype(np.float32))[0]
        return pooled_logits(out, text, len(texts))[0]

    def gradients(self, word: np.ndarray, grams: np.ndarray, mask: np.ndarray, at: np.ndarray, live: np.ndarray, text: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, keep = self.w, []
        x, share = self.embed(word, grams, mask)
        gates = np.concatenate([x @ w["in"] + w["bias"], np.zeros((1, 6 * HIDDEN), np.float32)])
        logits, states, seen, att, pooled = self.run(gates, at, live, keep)
        whole, part = pooled_logits(logits, text, len(labels))
        error = (1 / (1 + np.exp(-whole)) - labels) / len(labels)
        d = (error[text] * part).astype(np.float32)
        g: dict[str, np.ndarray] = {"base": np.array([d.sum()]), "out": pooled.T @ d}
        dp = d[:, None] * w["out"]
        ds = att[:, :, None] * dp
        da = (states * dp).sum(2)
        de = att * (da - (att * da).sum(0))
        g["see"] = np.einsum("tn,tna->a", de, seen)
        dt = de[:, :, None] * w["see"] * (1 - seen * seen)
        g["tilt"], g["look"] = dt.sum((0, 1)), np.einsum("tnh,tna->ha", states, dt)
        ds += dt @ w["look"].T
        t, n = len(states), len(at)
        g["back"], g["new"] = np.zeros_like(w["back"]), np.zeros_like(w["new"])
        dg = np.zeros((t, n, 6 * HIDDEN), np.float32)
        dh = np.zeros((2, n, HIDDEN), np.float32)
        for s in range(t - 1, -1, -1):
            h, z, r, an, new, k, alive = keep[s]
            dh = dh + np.stack([ds[s, :, :HIDDEN], ds[t - 1 - s, :, HIDDEN:]])
            dn = dh * k * (1 - new * new)
            dz = -alive * dh * (new - h) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            dan = dn * r
            back = np.concatenate([dz, dr, dan], 2)
            g["back"] += h.transpose(0, 2, 1) @ back
            g["new"] += dan.sum(1, keepdims=True)
            into = np.concatenate([dz, dr, dn], 2)
            dg[s, :, : 3 * HIDDEN], dg[t - 1 - s, :, 3 * HIDDEN :] = into[0], into[1]
            dh = dh * (1 - k) + back @ w["back"].transpose(0, 2, 1)
        rows, flat = dg.reshape(-1, 6 * HIDDEN), at.T.ravel()
        order = np.argsort(flat, kind="stable")
        named, cut = np.unique(flat[order], return_index=True)
        per = np.zeros((len(word) + 1, 6 * HIDDEN), np.float32)
        per[named] = np.add.reduceat(rows[order], cut, axis=0)
        per = per[:-1]
        g["in"], g["bias"] = x.T @ per, per.sum(0)
        dx = per @ w["in"].T
        both = [(word, dx[:, :PART]), (grams.ravel(), (share[:, :, None] * dx[:, None, PART:]).reshape(-1, PART))]
        for name, (where, grad) in zip(("word", "gram"), both, strict=True):
            g[name] = np.stack([np.bincount(where, grad[:, j], BUCKETS) for j in range(PART)], 1)
        return g


class Sample:
    """The words of the training texts, every distinct word once: the texts hold places in its table."""

    def __init__(self, texts: list[str]) -> None:
        self.texts: list[tuple[np.ndarray, ...]] = []  # distinct words, each word's place among them, first word and size of each window
        place: dict[int, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        for t in texts:
            words = words_of(pa.array([t], pa.string()))
            word, grams, mask, index = distinct(words)
            hashes = np.unique(words.hashes).tolist()
            fresh = [k for k, h in enumerate(hashes) if h not in place]
            for k in fresh:
                place[hashes[k]] = len(place)
            parts.append((word[fresh], grams[fresh], mask[fresh]))
            _, first, size = windows_of(words)
            self.texts.append((np.array([place[h] for h in hashes], np.int32), index.astype(np.int32), first.astype(np.int32), size.astype(np.int32)))
        self.word, self.grams, self.mask = (np.concatenate([p[j] for p in parts]) for j in range(3))

    def batch(self, some: np.ndarray) -> tuple[np.ndarray, ...]:
        """Arguments of Network.gradients for some texts, but for their labels."""
        base, own, at, live, text = 0, [], [], [], []
        for k, i in enumerate(some):
            words, index, first, size = self.texts[i]
            there = np.arange(WINDOW) < size[:, None]
            at.append(np.where(there, np.append(index, 0)[np.where(there, first[:, None] + np.arange(WINDOW), len(index))] + base, -1))
            live.append(there)
            text.append(np.full(len(first), k))
            own.append(words)
            base += len(words)
        own = np.concatenate(own)
        kinds, back = np.unique(own, return_inverse=True)
        at = np.concatenate(at)
        at = np.where(at < 0, len(kinds), np.append(back, 0)[at])
        return self.word[kinds], self.grams[kinds], self.mask[kinds], at, np.concatenate(live).astype(np.float32), np.concatenate(text)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5, start: bool = True) -> Network:
    """Adam on whole texts; labels of both kinds are there.  start: the first columns of the embeddings start from log-odds."""
    net = Network.fresh(seed)
    sample = Sample(texts)
    seen = {"word": np.zeros((2, BUCKETS)), "gram": np.zeros((2, BUCKETS))}
    for (own, _, _, _), label in zip(sample.texts, labels, strict=True):
        seen["word"][int(label), np.unique(sample.word[own])] += 1
        seen["gram"][int(label), np.unique(sample.grams[own][sample.mask[own]])] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    for name, (no, yes) in seen.items() if start else ():
        odds = np.log((yes + 1) / (n[1] + 2)) - np.log((no + 1) / (n[0] + 2))
        net.w[name][:, 0] = np.where(yes + no >= 4, np.clip(odds, -1.5, 4), 0) * 0.5
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros(v.shape), np.zeros(v.shape)) for k, v in net.w.items()}
    step, total = 0, epochs * -(-len(texts) // DOCS_AT_ONCE)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(texts)), -(-len(texts) // DOCS_AT_ONCE)):
            grads = net.gradients(*sample.batch(some), labels[some])
            step += 1
            rate = RATE * min(1, step / 20) * (1 - 0.9 * step / total)
            size = np.sqrt(sum(float(np.square(v).sum()) for v in grads.values()))
            for k, v in grads.items():
                v = v * min(1, 5 / max(size, 1e-9))
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.w[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Network | float:
    """A network, or the toxic share where one label is missing."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id", F.lit("sample"))
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(positives).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(negatives))
    # at most positives + negatives ids, and texts of at most LONGEST_TRAINED words
    near = F.length("text") <= 24 * LONGEST_TRAINED
    rows = docs.where(near).select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    texts = {r.text: r.toxic for r in sorted(rows, key=lambda r: (r.doc_id, r.text)) if len(r.text.split()) <= LONGEST_TRAINED}
    truth = np.array(list(texts.values()), float)
    if len(set(texts.values())) < 2:
        return count.get(1, 0) / max(1, sum(count.values()))
    net = train(list(texts), truth)
    # one in so many was sampled of each label
    net.w["base"] += np.float32(np.log(count[1] / count[0]) - np.log(truth.sum() / (len(truth) - truth.sum())))
    return net


def score(docs: DataFrame, net: Network | float, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, in the place of a column of that name if there is one; no exchange."""
    docs = docs.drop(out)
    if isinstance(net, float):
        return docs.withColumn(out, F.lit(net))
    sent = docs.sparkSession.sparkContext.broadcast(net.w)
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns may have clashing names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(sent.value)
        for batch in slices(batches, at):
            parts = [model.score(part) for _, part in pieces(batch.column(at))]
            logits = np.concatenate([np.empty(0, np.float32), *parts]).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-logits)))], [*names, "score"])

    schema = docs.toDF(*names).select("*", F.lit(0.0).alias("score")).schema
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, out)
