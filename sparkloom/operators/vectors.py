"""Vectors as arrays of doubles: products, norms, neighbours, centroids, alignment of spaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.split import numbered
from sparkloom.sources.tables import shared_table


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Length one; zero vectors stay."""
    # an array of one binds the length, which would be made again for every component
    return F.get(F.transform(F.array(norm(v)), lambda n: F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def mean(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """group, vector: mean by position, combined on the map side."""
    at = df.select(*group, F.posexplode(vector).alias("pos", "x")).groupBy(*group, "pos").agg(F.avg("x").alias("m"))
    return at.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias(vector))


def _best_of(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best for each query: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, at))
    first = np.searchsorted(at[order], at[order], side="left")
    return order[np.arange(len(order)) - first < k]


def _products(asked: Broadcast, k: int, digits: int, kind: pa.DataType):
    """qid, key, score: for each query the k best rows of a task, from matrix products of 1,024 queries with 4,096 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = asked.value
        blocks = range(0, len(qids), 1024)
        held: dict[int, tuple] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                ids = np.array(part.column(0).to_pylist())
                rows = part.column(1).flatten().to_numpy().reshape(len(ids), -1)
                for at in blocks:
                    own, s = qids[at : at + 1024], q[at : at + 1024] @ rows.T
                    lo, hi = np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right")
                    for j in np.flatnonzero(lo < hi):
                        s[lo[j] : hi[j], j] = -np.inf
                    if at in held:
                        least = held[at][3]
                    else:
                        least = np.full(len(own), -np.inf)
                    if len(ids) >= k:  # those of these rows alone can't be worse than the k-th of them
                        few = np.isneginf(least)
                        least[few] = np.partition(s[few], len(ids) - k, axis=1)[:, len(ids) - k]
                    # rounded scores may tie where the others don't
                    i, j = np.nonzero(s >= (least - 2 * 10.0**-digits)[:, None])
                    x = s[i, j]
                    fine = ~np.isneginf(x)
                    i, found, x = i[fine], ids[j[fine]], x[fine]
                    x = np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x) + 0.0
                    if at in held:
                        i, found, x = (np.concatenate(y) for y in zip(held[at][:3], (i, found, x), strict=True))
                    best = _best_of(i, found, x, k)
                    i, found, x = i[best], found[best], x[best]
                    n = np.bincount(i, minlength=len(own))
                    least = np.full(len(own), -np.inf)
                    least[n == k] = x[(np.cumsum(n) - 1)[n == k]]
                    held[at] = i, found, x, least
        for at, (i, found, x, _) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(qids[at + i].tolist(), kind), pa.array(found.tolist(), kind), pa.array(x)], names=["qid", "key", "score"])

    return run


def best_products(queries: DataFrame, rows: DataFrame, k: int, digits: int = 6, block: int = 32_768) -> DataFrame:
    """qid, key, score, rank: for each query the k other rows of the largest product, rounded; ties by key.  queries: qid, q; rows: key, v; arrays of doubles.

    All rows are compared with all queries, a block of queries at a time, by products of matrices; a task gives k rows a query.
    Pairs with a vector that is null, of another size or not finite throughout are scored one by one.
    """
    queries, rows = shared_table(queries.where("qid is not null"), "product-queries"), shared_table(rows.where("key is not null"), "product-rows")
    kind = rows.schema["key"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    size = queries.agg(F.max(F.size("q"))).first()[0] or 0
    plain = lambda c: F.coalesce((F.size(c) == size) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    fine, every = queries.where(plain("q")), rows.where(plain("v"))
    blocks = max(1, -(-fine.count() // block))
    out = None
    pairs = [(queries.where(~plain("q")), rows), (fine, rows.where(~plain("v")))]
    for asked, some in pairs:
        odd = some.join(asked, F.col("key") != F.col("qid")).select("qid", "key", F.round(dot(F.col("q"), F.col("v")), digits).alias("score"))
        out = odd if out is None else out.unionByName(odd)
    for b in range(blocks):
        table = fine.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
        if not table.num_rows:
            continue
        qids = np.array(table["qid"].to_pylist())
        q = table["q"].combine_chunks().flatten().to_numpy().reshape(len(qids), -1)
        order = np.argsort(qids, kind="stable")
        sent = rows.sparkSession.sparkContext.broadcast((qids[order], q[order]))
        schema = T.StructType([T.StructField("qid", kind), T.StructField("key", kind), T.StructField("score", T.DoubleType())])
        out = out.unionByName(every.select("key", "v").mapInArrow(_products(sent, k, digits, arrow), schema))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)


def neighbours(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """qid, key, cos_r, rank for a stated query set against all rows."""
    q = queries.select(F.col(key).alias("qid"), unit(F.col(vector)).alias("q"))
    v = vectors.select(F.col(key).alias("key"), unit(F.col(vector)).alias("v"))
    return best_products(q, v, k, digits).select("qid", F.col("key").alias(key), F.col("score").alias("cos_r"), "rank")


def near_pairs(df: DataFrame, key: str, vector: str, least: float = 0.9999) -> DataFrame:
    """a, b, cosine: pairs (a < b) of vectors with at least that cosine; vectors of length nought take no part.

    Of vectors with equal directions the first stands for all: it is paired with each of them and with the first of others.
    Unit vectors that are so near differ by at most sqrt(2 - 2 least) in every component, so cells of that width over three
    components and their neighbours hold all of a vector's partners.
    """
    width = float(np.sqrt(2 - 2 * least)) * (1 + 1e-9)
    units = df.where(norm(F.col(vector)) > 0).select(F.col(key).alias("id"), unit(F.col(vector)).alias("u"))
    leads = units.groupBy("u").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    copies = units.join(leads.where("n > 1").withColumnRenamed("id", "a"), "u").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    cells = F.transform(F.slice("u", 1, 3), lambda x: F.floor(x / width))
    near = F.array(*(F.zip_with("cell", F.array(*map(F.lit, (i, j, k))), lambda c, d: c + F.coalesce(d, F.lit(0))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    own = leads.select("id", "u", cells.alias("cell"))
    left = own.select(F.col("id").alias("a"), F.col("u").alias("ua"), F.explode(F.array_distinct(near)).alias("cell"))
    pairs = left.join(own.select(F.col("id").alias("b"), F.col("u").alias("ub"), "cell"), "cell").where("a < b").select("a", "b", dot(F.col("ua"), F.col("ub")).alias("cosine"))
    return pairs.where(F.col("cosine") >= least).unionByName(copies)


def gram(df: DataFrame, left: str, right: str) -> np.ndarray:
    """The sum of outer products, size x size whatever the rows."""
    pairs = df.select(F.posexplode(left).alias("i", "x"), F.col(right).alias("__r")).select("i", "x", F.posexplode("__r").alias("j", "y"))
    cells = pairs.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("g")).collect()
    out = np.zeros((1 + max(r.i for r in cells), 1 + max(r.j for r in cells)))
    for r in cells:
        out[r.i, r.j] = r.g
    return out


def centered(df: DataFrame, vector: str) -> DataFrame:
    m = mean(df.withColumn("__g", F.lit(1)), ["__g"], vector).select(F.col(vector).alias("__m"))
    return df.crossJoin(F.broadcast(m)).withColumn(vector, F.zip_with(vector, "__m", lambda x, y: x - y)).drop("__m")


def linear_cka(df: DataFrame, a: str, b: str) -> float:
    """Similarity of two representations of the same rows, from three small matrices."""
    both = centered(centered(df, a), b)
    cross, own_a, own_b = gram(both, a, b), gram(both, a, a), gram(both, b, b)
    return float(np.square(cross).sum() / (np.linalg.norm(own_a) * np.linalg.norm(own_b)))


def procrustes(df: DataFrame, a: str, b: str) -> np.ndarray:
    """The rotation of a that comes nearest to b."""
    u, _, v = np.linalg.svd(gram(df, a, b))
    return u @ v


#: Rows or columns of a block at most: a place in it takes 16 bits.  Cells of a piece; what Spark hands over at once has 10,000 pieces.
_BLOCK, _PIECE = 1 << 16, 256
_CELL = np.dtype([("to", "<u2"), ("from", "<u2"), ("v", "<f8")])
_PACKED = T.StructType([T.StructField("source", T.IntegerType()), T.StructField("target", T.IntegerType()), T.StructField("data", T.BinaryType())])


def _slices(data: np.ndarray, most: int) -> pa.Array:
    """The bytes of data, `most` items a value."""
    ends = np.minimum(np.arange(0, len(data) + most, most), len(data)) if len(data) else np.zeros(1, int)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _joined(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """All values of a binary column as one array."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind)


def _packed(block: int, most: int = 1 << 21):
    """Cells (i, j, v) in pieces, each of one block of rows and one of columns."""

    def pieces(held: list) -> Iterator[pa.RecordBatch]:
        i, j, v = (np.concatenate(x) for x in zip(*held, strict=True))
        to, source = i // block, j // block
        order = np.lexsort((to, source))
        to, source = to[order].astype(np.int32), source[order].astype(np.int32)
        cells = np.empty(len(v), _CELL)
        cells["to"], cells["from"], cells["v"] = i[order] % block, j[order] % block, v[order]
        cuts = np.flatnonzero((to[1:] != to[:-1]) | (source[1:] != source[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(v)], strict=True):
            data = _slices(cells[lo:hi], _PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), x[lo])) for x in (source, to)] + [data], names=_PACKED.names)

    def run(batches):
        held, n = [], 0
        for part in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
            n += part.num_rows
            if n >= most:
                yield from pieces(held)
                held, n = [], 0
        if n:
            yield from pieces(held)

    return run


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of the transposed matrix."""
    for part in batches:
        if part.num_rows:
            source, to, data = part.columns
            cells = _joined(data, _CELL)
            swapped = np.empty_like(cells)
            swapped["to"], swapped["from"], swapped["v"] = cells["from"], cells["to"], cells["v"]
            ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
            yield pa.RecordBatch.from_arrays([to, source, pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(swapped.tobytes())])], names=_PACKED.names)


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]], axis=1)


def _numbers(schema: str, f, rows: DataFrame) -> DataFrame:
    """Rows (at, y0, ...) with f of their matrix instead."""

    def run(batches):
        for part in batches:
            if part.num_rows:
                y = f(part.column(0).to_numpy(zero_copy_only=False), _matrix(part))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, np.ascontiguousarray(y.T))], names=["at", *(f"y{k}" for k in range(y.shape[1]))])

    return rows.mapInArrow(run, schema)


def _normals(at: np.ndarray, wide: int, seed: int) -> np.ndarray:
    """Standard normal numbers that depend on place and seed alone."""

    def uniform(x: np.ndarray) -> np.ndarray:
        x = (x + np.uint64((seed * 2 + 1) * 0x632BE59BD9B4E019 % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53

    x = (at.astype(np.uint64)[:, None] * np.uint64(wide) + np.arange(wide, dtype=np.uint64)) * np.uint64(2)
    return np.sqrt(-2 * np.log1p(-uniform(x))) * np.cos(2 * np.pi * uniform(x + np.uint64(1)))


def _gram_of_rows(rows: DataFrame, wide: int) -> np.ndarray:
    """y'y, wide x wide; one such matrix a task comes to the driver."""

    def run(batches):
        out = np.zeros((wide, wide))
        for part in batches:
            y = _matrix(part)
            out += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()])], names=["g"])

    return sum((np.array(r.g).reshape(wide, wide) for r in rows.mapInArrow(run, "g array<double>").toLocalIterator()), np.zeros((wide, wide)))


def _whitening(g: np.ndarray) -> np.ndarray:
    """m with m'gm = 1; directions of length nought become nought."""
    scale = 1 / np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1))
    values, m = np.linalg.eigh(g * scale[:, None] * scale)
    own = values > len(g) * 1e-15 * max(values.max(initial=0), 1e-300)
    return scale[:, None] * m * np.where(own, 1 / np.sqrt(np.where(own, values, 1)), 0)


def _sparse_times(packed: DataFrame, right: DataFrame, wide: int, schema: str, block: int, blocks: int) -> DataFrame:
    """(at, y0, ...): packed cells times the matrix with rows (at, y0, ...).

    A task has one block of `right` at a time and adds up one block of rows, whatever the number of cells; of a block of rows only those with cells leave it.
    """
    item = np.dtype([("at", "<u2"), ("y", "<f8", (wide,))])

    def sent(batches):
        for part in batches:
            at = part.column(0).to_numpy(zero_copy_only=False)
            rows = np.empty(len(at), item)
            if len(at):
                rows["at"], rows["y"] = at % block, _matrix(part)
                yield pa.RecordBatch.from_arrays([pa.array((at // block).astype(np.int32)), pa.array(np.full(len(at), -1, np.int32)), _slices(rows, 1)], names=_PACKED.names)

    def run(batches):
        source = target = None
        q, out, hit = np.zeros((wide, block)), np.zeros((wide, block)), np.zeros(block, bool)

        def done():
            at = np.flatnonzero(hit)
            for lo in range(0, len(at), 8192):
                some = at[lo : lo + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(some + int(target) * block), *(pa.array(o[some]) for o in out)], names=["at", *(f"y{k}" for k in range(wide))])
            out[:], hit[:] = 0, False

        for part in batches:
            s, t = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = np.flatnonzero((s[1:] != s[:-1]) | (t[1:] != t[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(s)], strict=True) if len(s) else ():
                if (s[lo], t[lo]) != (source, target):
                    yield from done()
                    if s[lo] != source:
                        q[:] = 0
                    source, target = s[lo], t[lo]
                data = part.column(2).slice(lo, hi - lo)
                if target < 0:
                    rows = _joined(data, item)
                    q[:, rows["at"]] = rows["y"].T
                    continue
                cells = _joined(data, _CELL)
                for first in range(0, len(cells), 1 << 18):
                    to, at, v = (np.ascontiguousarray(cells[name][first : first + (1 << 18)]) for name in ("to", "from", "v"))
                    to, at = to.astype(np.intp), at.astype(np.intp)
                    hit[to] = True
                    for k in range(wide):
                        out[k] += np.bincount(to, v * q[k][at], block)
        yield from done()

    both = packed.unionByName(right.mapInArrow(sent, _PACKED)).repartition(4 * blocks, "source").sortWithinPartitions("source", "target")
    names = [f"y{k}" for k in range(wide)]
    return both.mapInArrow(run, schema).groupBy("at").agg(*(F.sum(n).alias(n) for n in names))


def placed_svd(cells: DataFrame, sizes: tuple[int, int], rank: int, seed: int = 0, rounds: int = 2, over: int = 8, mirrored: bool = False, block: int = _BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(at, u array<double>) scaled by the root of singular values, and the singular values, of a sparse matrix of `sizes`.

    cells: i, j (places from 0), v.  Where `mirrored`, the matrix is symmetric and each pair of cells is given once, as i < j.
    Only matrices of rank + over rows and columns come to the driver; products are made a block of rows by a block of columns.
    """
    spark, (high, broad) = cells.sparkSession, sizes
    wide = max(1, min(broad, rank + over))
    packed = shared_table(cells.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double")).dropna().mapInArrow(_packed(block), _PACKED), "svd-cells")
    schema = ", ".join(["at long", *(f"y{k} double" for k in range(wide))])
    turned = packed.mapInArrow(_turned, _PACKED)

    def times(right: DataFrame, turn: bool) -> DataFrame:
        own = packed.unionByName(turned) if mirrored else turned if turn else packed
        return shared_table(_sparse_times(own, right, wide, schema, block, max(1, -(-(high if turn else broad) // block))), "svd-rows")

    def combined(rows: DataFrame, m: np.ndarray) -> DataFrame:
        return _numbers(", ".join(schema.split(", ")[: 1 + m.shape[1]]), lambda _, y: y @ m, rows)

    start = spark.range(broad).select(F.col("id").alias("at"), *(F.lit(0.0).alias(f"y{k}") for k in range(wide)))
    q = _numbers(schema, lambda at, y: _normals(at, y.shape[1], seed), start)
    for _ in range(rounds):
        z = times(times(q, False), True)
        m = _whitening(_gram_of_rows(z, wide))
        m = m @ _whitening(_gram_of_rows(combined(z, m), wide))  # the first leaves what rounding took from near directions
        q = combined(z, m)
    if not rounds:
        q = combined(q, _whitening(_gram_of_rows(q, wide)))
    y = times(q, False)
    values, turn = np.linalg.eigh(_gram_of_rows(y, wide))
    best = np.argsort(-values)[:rank]
    sigma = np.sqrt(np.maximum(values[best], 0))
    known = sigma > 1e-7 * sigma.max(initial=0)
    y = combined(y, turn[:, best] * np.where(known, 1 / np.sqrt(np.where(known, sigma, 1)), 0))
    return y.select("at", F.array(*(f"y{k}" for k in range(len(best)))).alias("u")), sigma


def randomized_svd(cells: DataFrame, row: str, column: str, value: str, rank: int, seed: int = 0, rounds: int = 2, over: int = 8) -> tuple[DataFrame, np.ndarray]:
    """(row, u array<double>) scaled by the root of singular values, and the singular values, of a sparse matrix in long form.

    Rows and columns are numbered by their order, see placed_svd; where that is done already, it saves the joins.
    """
    names = []
    for name, place in ((row, "__i"), (column, "__j")):
        found = shared_table(cells.select(name).where(F.col(name).isNotNull()).distinct(), "svd-names")
        names.append(shared_table(numbered(found, [name], "__n").select(name, (F.col("__n") - 1).alias(place)), "svd-places"))
    rows, columns = names
    placed = cells.join(rows, row).join(columns, column).select(F.col("__i").alias("i"), F.col("__j").alias("j"), F.col(value).alias("v"))
    u, sigma = placed_svd(placed, (rows.count(), columns.count()), rank, seed, rounds, over)
    return u.join(rows, F.col("at") == F.col("__i")).select(row, "u"), sigma
