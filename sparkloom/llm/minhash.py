"""Near-duplicates by DartMinHash signatures, bands and exact verification.

Every shingle (five words; of a shorter text, all its words) owns a region of the plane of weight and rank.  Hashed darts fall
on it as a Poisson process that depends on the shingle alone: along a slab of one unit of weight the next
dart's rank is one exponential step further, and its height in the slab, its coordinate and its
name are hashed with it.  A text keeps, for each of BANDS x ROWS coordinates, the earliest dart that lies inside its weight; ranks are
looked at up to a bound that gives each coordinate some darts, and twice that for texts with a coordinate left empty.  Two texts
agree in a coordinate with the probability of their (weighted) similarity.

A shingle weighs as often as its text holds it, in the signatures and in the comparison.  Texts with the same words are one class from the start,
and only one of each goes on.  Bands of equal darts make buckets.  Each bucket names one centre, the text that meets most others in all its buckets, so the buckets of a
group of copies name the same one; it is compared by true shingles with all in the bucket, a pair once in however many buckets it met, and the links make
classes.  Texts that then still share a bucket with another class are joined exactly by prefixes: in an order of the shingles by rarity, two similar texts
share one of the first few of each.  Texts of a group just under the bound share their frequent shingles, which come last, so few pairs are left to
compare.  No pair that shares a bucket stays uncompared unless its sizes or prefixes rule it out, and the number of steps is fixed.  Pairs and
links are counted first: up to FEW ids and pairs are broadcast to the texts and their sets and up to FEW links made classes by the driver, more are joined by exchanges; both give the same classes.

Null and empty texts, and texts without words, are classes of their own.  Rows with the same doc_id are one document
(its least text counts).  A null doc_id has no class and is left out.  An empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import shared_table, slices, small_batches
from sparkloom.operators.graph import components
from sparkloom.llm.words import mixed, pieces, shingles_of, words_of

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 6
#: Expected darts a coordinate of the first look; beyond what the coupon collector asks.
SURE = 3.0
#: Ids and pairs of texts that are broadcast, and links that the driver joins into classes (two numbers each); more take exchanges, which cost seconds each however few the rows.
FEW = 1 << 17
_STEP, _COORDINATE, _HEIGHT, _NAME = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9))


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def darts(shingles: np.ndarray, text: np.ndarray, weights: np.ndarray, texts: int, coordinates: int) -> np.ndarray:
    """uint64 names, texts x coordinates, of the earliest dart of each coordinate; 0 for texts without shingles.

    shingles: distinct within a text; weights: positive.
    """
    names = np.zeros((texts, coordinates), np.uint64)
    total = np.bincount(text, weights, texts)
    wanted = coordinates * (np.log(coordinates) + SURE)
    todo = np.flatnonzero(total > 0)
    bound = np.zeros(texts)
    bound[todo] = wanted / total[todo]
    # one slab for each begun unit of weight
    slabs = np.ceil(weights).astype(np.int64)
    row = np.repeat(np.arange(len(shingles)), slabs)
    slab = np.arange(len(row)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    while len(todo):
        wait = np.zeros(texts, bool)
        wait[todo] = True
        own = np.flatnonzero(wait[text[row]])
        state = mixed(shingles[row[own]] + slab[own].astype(np.uint64) * _NAME)
        rank = np.zeros(len(own))
        found: list[tuple[np.ndarray, ...]] = []
        while len(own):
            state = mixed(state + _STEP)
            rank = rank - np.log(_unit(state))
            live = np.flatnonzero(rank <= bound[text[row[own]]])
            own, state, rank = own[live], state[live], rank[live]
            height = slab[own] + _unit(mixed(state ^ _HEIGHT))
            hit = np.flatnonzero(height <= weights[row[own]])
            found.append((text[row[own[hit]]] * coordinates + (mixed(state[hit] ^ _COORDINATE) % np.uint64(coordinates)).astype(np.int64), rank[hit], mixed(state[hit] ^ _NAME) | np.uint64(1)))
        cell, rank, name = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rank, cell))
        cell, first = np.unique(cell[order], return_index=True)
        names.reshape(-1)[cell] = name[order[first]]
        todo = todo[(names[todo] == 0).any(1)]
        bound[todo] *= 2
    return names


def _distinct(shingles: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((shingles, text))
    s, t = shingles[order], text[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return s[at], t[at], np.diff(np.append(at, len(s)))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, by_count: bool = True) -> DataFrame:
    """id, words (a key of the words in order, null without words), bands array<long>. by_count: shingles weigh as often as they occur, else one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in pieces(batch.column(1)):
                words = words_of(part)
                s, t, n = _distinct(*shingles_of(words, SHINGLE))
                names = darts(s, t, n.astype(float) if by_count else np.ones(len(s)), len(part), bands * rows)
                keys = np.zeros((len(part), bands), np.uint64)
                for r in range(rows):
                    keys = mixed(keys * _STEP + names.reshape(len(part), bands, rows)[:, :, r])
                keys = mixed(keys + np.arange(1, bands + 1, dtype=np.uint64) * _NAME)
                # two sums over (place, word), so that the order of the words counts
                place = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], np.diff(words.first))
                one = np.add.reduceat(np.append(mixed(words.hashes ^ mixed(place.astype(np.uint64))), np.uint64(0)), words.first[:-1]) if len(part) else np.empty(0, np.uint64)
                two = np.add.reduceat(np.append(mixed(words.hashes * _STEP + mixed(place.astype(np.uint64) + _NAME)), np.uint64(0)), words.first[:-1]) if len(part) else one
                some = np.diff(words.first) > 0
                key = pa.array([f"{a:016x}{b:016x}" if k else None for a, b, k in zip(one.tolist(), two.tolist(), some.tolist(), strict=True)], pa.string())
                flat = pa.ListArray.from_arrays(np.arange(0, len(part) * bands + 1, bands, dtype=np.int32), keys.view(np.int64).reshape(-1))
                yield pa.record_batch([batch.column(0).slice(at, len(part)), key, flat], ["id", "words", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(run, "id long, words string, bands array<long>")


def _counted(shingles: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted elements (a shingle and which of its occurrences in the text) as 32-bit hashes, and their texts: their sets are as similar as the weighted shingles."""
    s, t, n = _distinct(shingles, text)
    row = np.repeat(np.arange(len(s)), n)
    time = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    element = (mixed(s[row] + time.astype(np.uint64) * _STEP) >> np.uint64(32)).astype(np.uint32)
    return _distinct(element, t[row])[:2]


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id, set: sorted elements of the weighted shingles as the bytes of 32-bit hashes (two of a pair of texts coincide by chance less than once in 100 pairs of 5,000 words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in pieces(batch.column(1)):
                s, t = _counted(*shingles_of(words_of(part), SHINGLE))
                cut = np.searchsorted(t, np.arange(len(part) + 1))
                yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array([s[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["id", "set"])

    return docs.mapInArrow(run, "id long, set binary")


def similar(pairs: DataFrame, least: float) -> DataFrame:
    """id, centre, near: whether the sets `a` and `b` have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32)
                if min(len(a), len(b)) < least * max(len(a), len(b)):
                    near.append(False)
                    continue
                both = np.concatenate([a, b])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                near.append(common >= least * (len(both) - common) and len(both) > 0)
            yield pa.record_batch([*batch.columns[:2], pa.array(near, pa.bool_())], ["id", "centre", "near"])

    return pairs.select("id", "centre", "a", "b").mapInArrow(run, "id long, centre long, near boolean")


def _open(rows: DataFrame) -> DataFrame:
    """Rows (key, id, label) of the keys that hold more than one label."""
    many = rows.groupBy("key").agg(F.min("label").alias("__a"), F.max("label").alias("__b")).where("__a <> __b").select("key")
    return rows.join(many, "key", "left_semi")


def _needed(n: Column, share: float) -> Column:
    return F.ceil(n * share - 1e-9)


def prefixes(rest: DataFrame, least: float) -> DataFrame:
    """key (an element), id, label, n, place: of each text's n elements the rarest, one of which each similar text of at most its size has among its own.

    rest: id, label, set.  Elements of one text alone come first in the order and join nothing, so they only count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2)]
            sizes = np.array([len(p) for p in parts], np.int32)
            row = pa.array(np.repeat(np.arange(len(parts)), sizes))
            key = pa.array(np.concatenate([np.empty(0, np.uint32), *parts]).astype(np.int64))
            yield pa.record_batch([key, *(batch.column(k).take(row) for k in (0, 1)), pa.array(sizes).take(row)], ["key", "id", "label", "n"])

    elements = rest.select("id", "label", "set").mapInArrow(run, "key long, id long, label long, n int")
    often = elements.groupBy("key").agg(F.count("*").alias("often"), (F.min("label") != F.max("label")).alias("open")).where("often > 1")
    listed = elements.join(often, "key").groupBy("id", "label", "n").agg(F.array_sort(F.collect_list(F.struct("often", "key", "open"))).alias("s"))
    alone = F.col("n") - F.size("s")
    some = F.greatest(F.lit(0), F.col("n") - _needed(F.col("n"), least) + 1 - alone).cast("int")
    first = listed.select("id", "label", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), some)).alias("at", "e")).where("e.open")
    return first.select("e.key", "id", "label", "n", (F.col("alone") + F.col("at")).alias("place"))


def prefix_pairs(rest: DataFrame, least: float) -> DataFrame:
    """id, centre: all pairs of different labels that can be similar, each once.

    The larger text of a pair offers its whole prefix, the smaller one the shorter prefix that texts of at least its size ask for.
    """
    rows = shared_table(prefixes(rest, least), "dart-prefixes")
    a, b = (rows.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "label", "n", "place"))) for k in "ab")
    b = b.where(F.col("place_b") <= F.col("n_b") - _needed(F.col("n_b"), 2 * least / (1 + least)))
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") > F.col("id_b")))
    sized = F.col("n_b") >= F.col("n_a") * least - 1e-9
    # the first shared element leaves so many that can be shared
    reach = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) * (1 + least) >= (F.col("n_a") + F.col("n_b")) * least - 1e-9
    pairs = a.join(b, "key").where((F.col("label_a") != F.col("label_b")) & larger & sized & reach)
    return pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("centre")).distinct()


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in links from a to b, and the smallest id of the component of each."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def _roots(links: DataFrame) -> DataFrame:
    """id, root: the smallest id of its class, for every id in a link.  links: id, centre, a written table."""
    if links.count() > FEW:
        return shared_table(components(links, "id", "centre"), "dart-roots")
    told = links.select("id", "centre").toArrow()
    ids, root = _joined(*(c.to_numpy().astype(np.int64) for c in told.columns))
    return F.broadcast(links.sparkSession.createDataFrame(pa.table({"id": ids, "root": root})))


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")


def labels(signed: DataFrame, docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The rows of signed without their bands, with label: the smallest id of its class.

    signed: id, bands, one row for each different text; docs: doc_id, text, one row an id.
    """
    rows = signed.select(F.explode("bands").alias("key"), "id")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # a text has one row a band, so the window's groups are bounded
    buckets = shared_table(rows.join(shared, "key").select("key", "id", F.sum("n").over(Window.partitionBy("id")).alias("met")), "dart-buckets")
    if buckets.isEmpty():
        return signed.drop("bands").withColumn("label", F.col("id"))
    ids = shared_table(buckets.select("id").distinct(), "dart-ids")
    ids = F.broadcast(ids) if ids.count() <= FEW else ids  # so that the other texts aren't moved
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id", "left_semi")
    sets = shared_table(shingle_sets(texts), "dart-shingles")
    a, b = sets.withColumnRenamed("set", "a"), sets.select(F.col("id").alias("centre"), F.col("set").alias("b"))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = shared_table(pairs, "dart-pairs")
        if pairs.count() > FEW:
            told = pairs.join(a, "id").join(b, "centre")
        else:  # each set goes to its pairs, which are dealt out evenly, whatever text they share
            told = a.join(F.broadcast(pairs), "id").join(b.join(F.broadcast(pairs), "centre"), ["id", "centre"])
        return shared_table(similar(told, least).where("near").select("id", "centre"), "dart-links")

    centres = buckets.groupBy("key").agg(F.min(F.struct((-F.col("met")).alias("met"), "id")).alias("c")).select("key", F.col("c.id").alias("centre"))
    links = linked(buckets.join(centres, "key").where("id <> centre").select(F.greatest("id", "centre").alias("id"), F.least("id", "centre").alias("centre")).distinct())
    roots = _roots(links)
    # texts that still share a bucket with another class, dealt by id once for two steps: a text has one row a band at most
    left = _open(_labelled(buckets.select("key", "id"), roots)).select("id", "label").repartition("id").distinct()
    rest = shared_table(left.join(sets, "id"), "dart-rest")
    more = linked(prefix_pairs(rest, least))
    return _labelled(signed.drop("bands"), roots if more.isEmpty() else _roots(links.unionByName(more)))


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of the class.  All Python work ends in written tables here; what is returned only joins them."""
    with small_batches(docs.sparkSession):
        return _classes(docs, bands, rows, least)


def _classes(docs: DataFrame, bands: int, rows: int, least: float) -> DataFrame:
    signed = shared_table(signatures(docs, bands, rows), "dart-signatures")
    whole, texts = signed, docs
    if _repeats(signed):  # the order of texts is that of their keys' strings only by chance, so ask the texts
        texts = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
        whole = shared_table(signatures(texts, bands, rows), "dart-signatures")
    first = whole.where("words is not null").groupBy("words").agg(F.min(F.struct("id", "bands")).alias("first"))
    leads = shared_table(first.select("first.id", "words", "first.bands"), "dart-leads")
    lead = labels(leads, texts, least).select("words", F.col("label").alias("class_id"))
    return whole.select("id", "words").join(lead, "words", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))


def _repeats(signed: DataFrame) -> bool:
    return not signed.groupBy("id").count().where("count > 1").isEmpty()


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose document leads its class, of equal ids the row with the least text; rows without an id stay."""
    gone = classes(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    first = docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    if not _repeats(docs.where("doc_id is not null").select(F.col("doc_id").alias("id"))):
        return first
    row, order = F.struct(*first.columns), F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.to_json(F.struct(*first.columns)).alias("row"))
    one = first.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(row, order).alias("__row")).select("__row.*")
    return one.unionByName(first.where("doc_id is null"))
