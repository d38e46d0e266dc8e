"""Vector functions as column expressions, and a blocked product as an Arrow kernel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column, eps: float = 1e-9) -> Column:
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v)) + eps), lambda n: F.transform(v, lambda x: x / n)), 1)


def mean_vector(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors of equal length."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), F.element_at(vectors, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))


def above(rows: DataFrame, queries: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """Like :func:`scores`, of unit vectors and only where the product is ``least`` or more; the others don't leave the kernel."""
    return scores(rows, queries, block, least)


def scores(rows: DataFrame, queries: DataFrame, block: int = 4096, least: float | None = None, second: str | None = None, cells: int = 2_000_000) -> DataFrame:
    """(query_id, score) with all columns of rows but emb: products of every row with every query.

    Queries (query_id, emb) are a stated set; they go to the executors in blocks of ``block`` rows. ``second`` names another vector of both sides, which
    may be null: its product takes its place in the rows, null where the query has none and 0 where only the row has none. A
    task holds about ``cells`` products at a time.
    """
    keep = [c for c in rows.columns if c not in ("emb", second)]
    names = rows.columns
    at = names.index("emb")
    schema = rows.select(*keep).withColumns({"query_id": F.lit(0).cast("bigint"), "score": F.lit(0.0)} | ({second: F.lit(None).cast("double")} if second else {})).schema
    out = None
    held: list = []

    def add(part: list):
        of = [k for k, (*_, x) in enumerate(part) if x is not None]
        more = (np.array(of, np.int64), np.array([part[k][2] for k in of], np.float64))
        sent = rows.sparkSession.sparkContext.broadcast((np.array([q for q, *_ in part], np.int64), np.array([e for _, e, _ in part], np.float64), more))

        def other(piece, n):
            """Products of the second vectors, and which are null."""
            of, matrix = sent.value[2]
            product, null = np.zeros((piece.num_rows, n)), np.ones((piece.num_rows, n), bool)
            column = piece.column(names.index(second))
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            null[:, of] = False
            if len(of) and len(there):
                product[np.ix_(there, of)] = np.array(column.take(pa.array(there)).to_pylist(), np.float64) @ matrix.T
            return pa.array(product.ravel(), mask=null.ravel())

        def run(batches):
            ids, matrix, _ = sent.value
            step = max(1, cells // max(len(ids), 1))
            for batch in batches:
                for k in range(0, batch.num_rows, step):
                    piece = batch.slice(k, step)
                    vectors = np.array(piece.column(at).to_pylist(), np.float64).reshape(piece.num_rows, -1)
                    product = vectors @ matrix.T
                    if least is None:
                        row, query, product = np.repeat(np.arange(piece.num_rows), len(ids)), np.tile(ids, piece.num_rows), product.ravel()
                    else:
                        row, query = np.nonzero(product >= least)
                        product, query = product[row, query], ids[query]
                    columns = [piece.column(names.index(c)).take(pa.array(row)) for c in keep]
                    extra = [other(piece, len(ids))] if second else []
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(query), pa.array(product), *extra], names=schema.names)

        return rows.mapInArrow(run, schema)

    for row in queries.select("query_id", "emb", (F.col(second) if second else F.lit(None)).alias("more")).toLocalIterator():
        held.append((row.query_id, row.emb, row.more))
        if len(held) == block:
            out, held = add(held) if out is None else out.unionByName(add(held)), []
    if held or out is None:
        part = add(held) if held else rows.sparkSession.createDataFrame([], schema)
        out = part if out is None else out.unionByName(part)
    return out


def query_blocks(queries: DataFrame, block: int = 4096) -> list:
    """Queries (query_id, emb), a stated set, as broadcasts of (ids, matrix), ``block`` rows each."""
    held, out = [], []

    def add(part):
        out.append(queries.sparkSession.sparkContext.broadcast((np.array([q for q, _ in part], np.int64), np.array([e for _, e in part], np.float64))))

    for row in queries.select("query_id", "emb").toLocalIterator():
        held.append((row.query_id, row.emb))
        if len(held) == block:
            add(held)
            held = []
    if held:
        add(held)
    return out


def flat_lists(videos: DataFrame) -> DataFrame:
    """videos (video_id, protos and more) with protos as k and emb, the vectors one after the other, for :func:`pooled_blocks`."""
    more = [c for c in videos.columns if c not in ("video_id", "protos")]
    return videos.select("video_id", F.transform("protos", lambda p: p["k"].cast("int")).alias("k"), F.flatten(F.transform("protos", lambda p: p["emb"])).alias("emb"), *more)


def pooled_blocks(ks, tau: float, cells: int = 2_000_000):
    """A function of batches of :func:`flat_lists` and a matrix of queries that gives (part of a batch, base, qamp), the latter by video and query, see :func:`pooled_scores`."""
    finest, t, n_ks = max(ks), max(tau, 1e-6), len(ks)

    def pool(batch, matrix):
        n, dim = batch.num_rows, matrix.shape[1]
        k = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        base, qamp = np.full((n, len(matrix)), np.nan), np.zeros((n, len(matrix)))
        if len(k):
            product = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) @ matrix.T
            video = np.repeat(np.arange(n), sizes)
            first = np.flatnonzero(np.concatenate(([True], (np.diff(k) != 0) | (np.diff(video) != 0))))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
            best = np.maximum.reduceat(product, first)
            weight = np.exp((product - best[group]) / t)
            each = np.add.reduceat(weight * product, first) / (np.add.reduceat(weight, first) + 1e-9)
            np.add.at(qamp, video[first], each)
            fine = k[first] == finest
            base[video[first][fine]] = best[fine]
        # Rounded, so that equal vectors tie, and a pair that is worked out twice is the same, wherever they stand in a product.
        return np.round(base, 12), np.round(qamp / n_ks, 12)

    def blocks(batches, matrix):
        for batch in batches:
            step = max(1, cells // (max(len(matrix), 1) * 12))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield part, *pool(part, matrix)

    return blocks


def best_blocks(ks, tau: float, cells: int = 2_000_000):
    """Like :func:`pooled_blocks`, with a function of places of videos and of queries, which gives qamp of these pairs, instead of qamp of all: only a few of the best need it."""
    layout = np.repeat(sorted(ks), sorted(ks)).astype(np.int64)
    width, finest, t, whole = len(layout), max(ks), max(tau, 1e-6), pooled_blocks(ks, tau, cells)

    def known(qamp):
        return lambda v, q: qamp[v, q]

    def pooled(vectors, matrix):
        def at(v, q):
            out, dim = np.zeros(len(v)), matrix.shape[1]
            # Where many are asked for, one product of all is cheaper than one of each.
            many = len(v) * 8 > len(vectors) * len(matrix)
            every = (vectors.reshape(-1, dim) @ matrix.T).reshape(len(vectors), width, -1) if many else None
            step = max(1, cells // (width if many else width * dim))
            for k in range(0, len(v), step):
                row, column = v[k : k + step], q[k : k + step]
                product = every[row, :, column] if many else np.matmul(vectors[row], matrix[column][:, :, None])[:, :, 0]
                for size in np.unique(layout):
                    part = product[:, layout == size]
                    weight = np.exp((part - part.max(axis=1, keepdims=True)) / t)
                    out[k : k + step] += (weight * part).sum(axis=1) / (weight.sum(axis=1) + 1e-9)
            return np.round(out / len(ks), 12)

        return at

    def blocks(batches, matrix):
        for batch in batches:
            step = max(1, cells // (max(len(matrix), 1) * width))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n, k = part.num_rows, part.column(1).flatten().to_numpy(zero_copy_only=False)
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                if len(k) != n * width or (sizes != width).any() or (k.reshape(n, width) != layout).any():
                    for one, base, qamp in whole([part], matrix):
                        yield one, base, known(qamp)
                    continue
                vectors = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, width, matrix.shape[1])
                product = vectors[:, width - finest :].reshape(n * finest, -1) @ matrix.T
                base = product.reshape(n, finest, -1).max(axis=1)
                # Rounded as there.
                np.divide(np.rint(np.multiply(base, 1e12, out=base), out=base), 1e12, out=base)
                yield part, base, pooled(vectors, matrix)

    return blocks


def pooled_scores(videos: DataFrame, queries: DataFrame, ks, tau: float, block: int = 4096, cells: int = 2_000_000) -> DataFrame:
    """video_id, query_id, base, qamp of every video with every query: a row for each pair leaves the kernel, not one for each prototype.

    videos: video_id and protos, an array of (k, emb) in the order of k. base is the best product over the prototypes of the greatest of ``ks``, null where there is none;
    qamp the mean over ``ks`` of the products pooled by their softmax at ``tau``; a k without prototypes adds 0. Queries (query_id, emb) are a
    stated set, sent to the executors in blocks of ``block`` rows. A task holds about ``cells`` products at a time.
    """
    schema = videos.select("video_id").withColumns({"query_id": F.lit(0).cast("bigint"), "base": F.lit(None).cast("double"), "qamp": F.lit(0.0)}).schema
    slim, blocks = flat_lists(videos.select("video_id", "protos")), pooled_blocks(ks, tau, cells)

    def run_with(sent):
        def run(batches):
            ids, matrix = sent.value
            for part, base, qamp in blocks(batches, matrix):
                names = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(ids))))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.tile(ids, part.num_rows)), pa.array(base.ravel(), from_pandas=True), pa.array(qamp.ravel())], names=schema.names)

        return run

    out = None
    for sent in query_blocks(queries, block):
        one = slim.mapInArrow(run_with(sent), schema)
        out = one if out is None else out.unionByName(one)
    return videos.sparkSession.createDataFrame([], schema) if out is None else out
