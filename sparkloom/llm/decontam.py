"""Benchmark passages in documents, paraphrased ones too, by latent semantic retrieval.

1. Each document becomes the sequence of its words' places in the benchmark's vocabulary (-1: another word); one pass over
   the texts, written to the shared folder.  All later passes read that.
2. Frequencies of the terms in all blocks of STRIDE words give TF-IDF weights (to the power POWER); terms in more than COMMON of the blocks weigh nothing in the space of 3.
3. A randomised SVD over the TF-IDF vectors of all passages (WINDOW words, STRIDE apart), the benchmark's items being rows too, together as heavy as
   the corpus: each task multiplies its passages with a random matrix, the products are summed over the tasks level by level, and the Nystrom formula
   gives the right singular vectors.
4. Passages and items are compared by cosine in that space; items of over WINDOW words in parts of WINDOW words.  Whatever
   the weights, passages that hold enough of an item's pairs of neighbouring words (of items of one or two words: one of them) are
   candidates too.  Those of the space pass a cheap bound on the shared weight; all are decided by the longest common subsequence of words within a stretch little longer than the item, and for paraphrases by the words of the
   item's answer, its last sentence.

The benchmark is taken in blocks of ITEMS items, so nothing broadcast grows with it or the corpus.  Items without words find nothing;
items shorter than SHORT words must be there whole.  Null and empty texts contain nothing; a null item_id is left out; several texts of an item_id are looked
for each; a document occurs once for each item found, with its best match; rows with the same doc_id count as one document.  Other columns are dropped.
Removing goes by the texts, so rows without an id, or with an id of others, are judged by what they hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import shared_table, slices, small_batches
from sparkloom.llm.words import pieces, words_of

WINDOW, STRIDE, RANK, OVER = 64, 32, 64, 16
COMMON, POWER, COSINE, SHARED = 0.02, 1.5, 0.4, 0.3
#: Share of an item's words in order: enough alone, or with so many of the answer's words.
WHOLE, PARAPHRASE, ANSWER = 0.75, 0.55, 0.75
STRETCH, SHORT, ITEMS, FAN = 1.3, 8, 1_024, 8
#: Words whose vectors are held at a time.
TERMS = 1 << 17


class Items:
    """A block of benchmark items and its vocabulary."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        words = words_of(pa.array(texts, pa.string()))
        self.vocabulary = np.unique(words.hashes)
        terms = np.searchsorted(self.vocabulary, words.hashes).astype(np.int32)
        self.ids, self.terms = ids, [terms[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.answers = []
        for text, own in zip(texts, self.terms, strict=True):
            sentences = [s for s in re.split(r"[.!?\n]+", text) if re.search(r"\w", s)]
            n = len(words_of(pa.array(sentences[-1:] or [""], pa.string())).hashes)
            self.answers.append(np.unique(own[len(own) - n :]))
        self.parts = [(i, a) for i, t in enumerate(self.terms) for a in range(0, max(1, len(t)), WINDOW)]
        self._index()

    def _index(self) -> None:
        """Grams (pairs of neighbouring words; words of items of at most two) with the items that have them, and how many a passage must hold."""
        size, grams, owners = len(self.vocabulary), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.least = np.ones(len(self.terms), np.int64)
        for i, t in enumerate(self.terms):
            own = np.unique(t.astype(np.int64) - size if len(t) <= 2 else t[:-1].astype(np.int64) * size + t[1:])
            grams.append(own)
            owners.append(np.full(len(own), i))
            n = len(t)
            if n > 2:
                wide = int(np.ceil(STRETCH * n))
                # of distinct pairs; a lost or put-in word breaks some; a stretch lies in so many passages
                held = len(own) - (wide - n) if n < SHORT else len(own) - int(0.8 * (n - 1)) - 1
                self.least[i] = max(1, -(-held // (-(-(-(-(wide - 1) // STRIDE) + 1) // 2))))
        grams, owners = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.owners, self.posting = owners[order], np.append(first, len(grams))

    def held(self, b: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """(block, item) of the passages that hold enough grams of an item."""
        size = len(self.vocabulary)
        gram = np.concatenate([b.term.astype(np.int64) - size, b.term[:-1].astype(np.int64) * size + b.term[1:]])
        next_to = (np.diff(b.at) == 1) & (b.doc[1:] == b.doc[:-1])
        block = np.concatenate([b.block, b.block[:-1]])
        there = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        hit = np.flatnonzero((self.grams[there] == gram) & np.concatenate([np.ones(len(b.term), bool), next_to]))
        there, block = there[hit], block[hit]
        # each gram counts once in a block
        there, block = np.divmod(np.unique(there * (b.n + 1) + block), b.n + 1)
        n = self.posting[there + 1] - self.posting[there]
        item = self.owners[np.repeat(self.posting[there], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        block = np.repeat(block, n)
        before = np.flatnonzero((block > 0) & ~b.last[block - 1])
        cells, count = np.unique(np.concatenate([block * len(self.terms) + item, (block[before] - 1) * len(self.terms) + item[before]]), return_counts=True)
        block, item = np.divmod(cells, len(self.terms))
        enough = np.flatnonzero(count >= self.least[item])
        return block[enough], item[enough]

    def terms_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Term of every word, and each text's first word."""
        words = words_of(texts)
        if not len(self.vocabulary):
            return np.full(len(words.hashes), -1, np.int32), words.first
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words.hashes, at, -1).astype(np.int32), words.first


class Blocks:
    """All documents of an Arrow batch as one sequence of terms, cut in blocks of STRIDE words."""

    def __init__(self, column: pa.Array) -> None:
        parts = [np.frombuffer(x.as_buffer(), np.int32) for x in column]
        sizes = np.array([len(p) for p in parts], np.int64)
        self.terms = np.concatenate([np.empty(0, np.int32), *parts])
        self.start = np.cumsum(sizes) - sizes
        self.size = sizes
        self.blocks = np.maximum(1, -(-sizes // STRIDE)) if len(sizes) else sizes
        self.first = np.cumsum(self.blocks) - self.blocks
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.flatnonzero(self.terms >= 0)  # of words in the vocabulary
        self.term = self.terms[self.at]
        self.doc = doc[self.at]
        self.block = (self.first[doc] + (np.arange(len(doc)) - self.start[doc]) // STRIDE)[self.at] if len(doc) else np.empty(0, np.int64)
        self.n = int(self.blocks.sum())
        self.last = np.zeros(self.n, bool)
        self.last[(self.first + self.blocks - 1)[self.blocks > 0]] = True

    def passages(self, weights: np.ndarray) -> np.ndarray:
        """Summed weight vectors of each block and the next one of its document."""
        out = np.zeros((self.n, weights.shape[1]), np.float32)
        every = np.flatnonzero(np.abs(weights).sum(1)[self.term] > 0) if len(self.block) else self.block
        for a in range(0, len(every), TERMS):
            live = every[a : a + TERMS]
            where = self.block[live]
            cut = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            out[where[cut]] += np.add.reduceat(weights[self.term[live]], cut, axis=0)
        both = out.copy()
        both[:-1][~self.last[:-1]] += out[1:][~self.last[:-1]]
        return both


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices held as bytes, a task's worth at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float32)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.float32).reshape(shape)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["m"])

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(add, "m binary")
    return sum((np.frombuffer(bytes(r.m), np.float32).reshape(shape) for r in parts.collect()), np.zeros(shape, np.float32))


def latent_space(terms: DataFrame, idf: np.ndarray, items: np.ndarray, passages: float, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF matrix of passages and items (rows of length one)."""
    size = len(idf)
    wide = min(size, rank + OVER)
    weights = terms.sparkSession.sparkContext.broadcast(idf)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        omega = np.random.default_rng(seed).standard_normal((size, wide)).astype(np.float32)
        aimed = omega * idf[:, None]
        total = np.zeros((size, wide), np.float32)
        for batch in slices(batches, 1):
            b = Blocks(batch.column(1))
            y = b.passages(aimed)
            # lengths of the passages, so that all weigh the same
            square = b.passages((idf * idf)[:, None])
            y /= np.maximum(square, 1e-9)
            # each word adds its passages' products: its block's passage and the one before
            z = y.copy()
            z[1:][~b.last[:-1]] += y[:-1][~b.last[:-1]]
            live = np.flatnonzero(idf[b.term] > 0)
            order = live[np.argsort(b.term[live], kind="stable")]
            for a in range(0, len(order), TERMS):  # a long text has many
                some = order[a : a + TERMS]
                t = b.term[some]
                cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                total[t[cut]] += np.add.reduceat(z[b.block[some]], cut, axis=0) * idf[t[cut], None]
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["m"])

    y = _summed(terms.mapInArrow(sketch, "m binary"), (size, wide)).astype(float)
    omega = np.random.default_rng(seed).standard_normal((size, wide)).astype(np.float32).astype(float)
    y += passages / max(1, len(items)) * (items.T @ (items @ omega))
    shift = 1e-7 * max(float(np.linalg.norm(y)), 1e-9)
    y += shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-10
    if not good.any():  # every term is a frequent one: the space is empty
        return np.zeros((size, 1), np.float32)
    left, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :rank].astype(np.float32)


def common_subsequence(masks: dict[int, int], full: int, other: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits: masks has the places of each term of one sequence."""
    s = full
    for t in other.tolist():
        u = s & masks.get(t, 0)
        if u:
            s = ((s + u) | (s - u)) & full
    return full.bit_count() - s.bit_count()


def matched(item: np.ndarray, masks: dict[int, int], region: np.ndarray) -> tuple[int, int, int]:
    """(length, from, to) of the best stretch of about the item's length."""
    wide, best = int(np.ceil(STRETCH * len(item))), (0, 0, 0)
    for a in range(0, max(1, len(region) - wide + max(1, len(item) // 6)), max(1, len(item) // 6)):
        n = common_subsequence(masks, (1 << len(item)) - 1, region[a : a + wide])
        best = max(best, (n, a, min(len(region), a + wide)), key=lambda x: x[0])
    return best


def _find(docs: DataFrame, items: Items) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(items)
    size = len(items.vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in pieces(batch.column(1)):
                terms, first = sent.value.terms_of(part)
                found = [terms[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array([t.tobytes() for t in found], pa.binary())], ["doc_id", "terms"])

    terms = shared_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(read, "doc_id long, terms binary"), "benchmark-terms")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(size, np.int64), 0
        for batch in slices(batches, 1):
            b = Blocks(batch.column(1))
            count += np.bincount(np.unique(b.block * size + b.term) % size, minlength=size)
            n += b.n
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(count[some], n))], ["term", "n"])

    rows = terms.mapInArrow(frequency, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term of the benchmark
    df = np.zeros(size + 1)
    for r in rows:
        df[r.term] = r.n  # -1, the last, counts the blocks
    total = max(1.0, df[-1])
    idf = (np.where(df[:-1] > max(COMMON * total, 3), 0, np.log((1 + total) / (1 + df[:-1]))) ** POWER).astype(np.float32)
    rows_of = np.zeros((len(items.terms), size))
    for i, t in enumerate(items.terms):
        np.add.at(rows_of[i], t, idf[t])
    rows_of /= np.maximum(np.linalg.norm(rows_of, axis=1, keepdims=True), 1e-9)
    space = latent_space(terms, idf, rows_of, total)
    aimed = space * idf[:, None]
    parts = [items.terms[i][a : a + WINDOW] for i, a in items.parts]
    query = np.stack([aimed[t].sum(0) for t in parts])
    query /= np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-9)
    inside = np.zeros((len(parts), size), np.float32)
    for k, t in enumerate(parts):
        inside[k, t] = idf[t] / max(float(idf[t].sum()), 1e-9)
    sent_more = spark.sparkContext.broadcast((aimed, query, inside, np.array([i for i, _ in items.parts], np.int64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (aimed, query, inside, item_of) = sent.value, sent_more.value
        masks: dict[int, dict[int, int]] = {}
        sorted_terms: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, 1):
            b = Blocks(batch.column(1))
            doc = np.repeat(np.arange(len(b.size)), b.blocks)
            x = b.passages(aimed)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            asked: dict[tuple[int, int], float] = {}
            for a in range(0, b.n, 8192):
                cosine = x[a : a + 8192] @ query.T
                block, part = np.nonzero(cosine >= COSINE)
                value, block = cosine[block, part], block + a
                begin = b.start[doc[block]] + (block - b.first[doc[block]]) * STRIDE
                end = np.minimum(begin + WINDOW, b.start[doc[block]] + b.size[doc[block]])
                for c in range(0, len(block), 65_536):
                    s = slice(c, c + 65_536)
                    place = begin[s, None] + np.arange(WINDOW)
                    there = b.terms[np.minimum(place, len(b.terms) - 1)]
                    share = np.where((place < end[s, None]) & (there >= 0), inside[part[s, None], there], 0).sum(1)
                    for k in np.flatnonzero(share >= SHARED) + c:
                        cell = int(block[k]), int(item_of[part[k]])
                        asked[cell] = max(float(value[k]), asked.get(cell, -1.0))
            for block, i in zip(*(v.tolist() for v in items.held(b)), strict=True):
                if (block, i) not in asked:
                    asked[block, i] = float((query[item_of == i] @ x[block]).max())
            best: dict[tuple[int, int], tuple] = {}
            for (k, i), value in sorted(asked.items()):
                d, own = int(doc[k]), items.terms[i]
                if (d, i) in best and best[d, i][0] == len(own):
                    continue
                if i not in masks:
                    masks[i] = {}
                    for p, t in enumerate(own.tolist()):
                        masks[i][t] = masks[i].get(t, 0) | 1 << p
                    sorted_terms[i] = np.unique(own, return_counts=True)
                begin = b.start[d] + (k - b.first[d]) * STRIDE
                lo = max(b.start[d], begin - len(own))
                region = b.terms[lo : min(b.start[d] + b.size[d], begin + max(WINDOW, len(own)) + len(own))]
                # no subsequence is longer than what is there in any order
                kinds, times = sorted_terms[i]
                at = np.minimum(np.searchsorted(kinds, region), len(kinds) - 1)
                there = np.bincount(at[kinds[at] == region], minlength=len(kinds))
                if np.minimum(there, times).sum() < (1 if len(own) < SHORT else PARAPHRASE) * len(own):
                    continue
                n, f, t = matched(own, masks[i], region)
                if (d, i) not in best or n > best[d, i][0]:
                    answer = items.answers[i]
                    known = np.isin(answer, region[f:t]).mean() if len(answer) else 0.0
                    best[d, i] = (n, value, float(known), int(lo + f - b.start[d]))
            out = []
            for (d, i), (n, value, known, at) in best.items():
                share = n / len(items.terms[i])
                if share >= (1 if len(items.terms[i]) < SHORT else WHOLE) or (len(items.terms[i]) >= SHORT and share >= PARAPHRASE and known >= ANSWER):
                    out.append((batch.column(0)[d].as_py(), items.ids[i], share, known, value, at))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
            yield pa.record_batch([pa.array([o[j] for o in out], t) for j, t in enumerate(types)], ["doc_id", "item_id", "common", "answer", "cosine", "word"])

    return terms.mapInArrow(search, "doc_id long, item_id long, common double, answer double, cosine double, word int")


def find_contaminated(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, common (share of the item's words in order), answer, cosine, word (where it begins): contaminated pairs only."""
    with small_batches(docs.sparkSession):
        return _found(docs, benchmark, items)


def _found(docs: DataFrame, benchmark: DataFrame, items: int) -> DataFrame:
    spark = docs.sparkSession
    asked = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    blocks = max(1, -(-asked.count() // items))
    found: DataFrame | None = None
    for k in range(blocks):
        rows = sorted(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect())
        block = Items([r.item_id for r in rows], [r.text for r in rows])
        if len(block.vocabulary):
            some = shared_table(_find(docs, block), "benchmark-found")
            found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, common double, answer double, cosine double, word int")
    top = F.max(F.struct("common", "answer", "cosine", "word")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "m.common", "m.answer", "m.cosine", "m.word")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in whose texts no item was found; columns as they are."""
    key = F.xxhash64(F.col("text").cast("string"))
    gone = find_contaminated(docs.where(F.length("text") > 0).select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, key == F.col("__gone"), "left_anti")
