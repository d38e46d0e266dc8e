"""Identity of frames: digests of sampled pixels, perceptual hashes, and joins by Hamming distance."""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import above

#: Weights of red, green and blue; side of the resized frame and of its block of low frequencies; step of sampled pixels.
GREY = (0.299, 0.587, 0.114)
SIDE, LOW, STRIDE = 32, 8, 16
#: Bits and cosine within which frames count as the same.
BITS, COSINE = 5, 0.97


def _shrunk(images: np.ndarray, side: int) -> np.ndarray:
    """Means of side x side cells of (n, h, w); a cell has one pixel at least."""
    for axis in (1, 2):
        size = images.shape[axis]
        edges = np.linspace(0, size, side + 1).astype(int)
        sums = np.add.reduceat(images, np.minimum(edges[:-1], size - 1), axis)
        counts = np.maximum(np.diff(edges), 1)
        images = sums / counts.reshape((1, side, 1) if axis == 1 else (1, 1, side))
    return images


def _cosines(side: int, low: int) -> np.ndarray:
    """The first ``low`` rows of the orthonormal DCT-II of ``side`` points."""
    basis = np.array([[math.cos(math.pi * (2 * n + 1) * k / (2 * side)) for n in range(side)] for k in range(low)]) * math.sqrt(2.0 / side)
    basis[0] *= math.sqrt(0.5)
    return basis


def _low(grey: np.ndarray, side: int) -> np.ndarray:
    """The block of low frequencies of each of (n, h, w).

    Where two in the middle are equal but for rounding, the order of additions decides on which side of the median they lie. Small frames are added pixel by pixel, line by line,
    as SQL does in one thread; with more threads its own order, and such bits, differ from run to run.
    """
    basis, (h, w) = _cosines(side, LOW), grey.shape[1:]
    if side % h or side % w:
        return basis @ _shrunk(grey, side) @ basis.T
    # A pixel of a small frame stands for a run of points.
    rows, columns = (np.cumsum(basis.reshape(LOW, n, side // n), axis=2)[..., -1] for n in (h, w))
    out = np.zeros((len(grey), LOW, LOW))
    for y in range(h):
        for x in range(w):
            out += (grey[:, y, x, None] * rows[:, y])[:, :, None] * columns[:, x]
    return out


def perceptual_hashes(images: np.ndarray, side: int = SIDE) -> np.ndarray:
    """64 bits (as signed numbers) of each of (n, h, w) or (n, h, w, 3) pixels: which low frequencies lie above their median; the constant part counts as 0."""
    grey = images.astype(np.float64)
    if grey.ndim == 4:
        grey = grey @ np.array(GREY)
    low = _low(grey, side).reshape(-1, LOW * LOW)
    low[:, 0] = 0.0
    bits = low > np.median(low, axis=1, keepdims=True)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def hashed(frames: DataFrame, side: int = SIDE, stride: int = STRIDE) -> DataFrame:
    """Columns of frames but pixels, with exact_key (digest of every ``stride``-th pixel of every such line) and phash.

    frames: height, width, channels (1 or 3) and pixels, one byte each, line by line. A frame without pixels has phash 0 and the key of no bytes.
    """
    keep = [c for c in frames.columns if c != "pixels"]
    at = {c: k for k, c in enumerate(frames.columns)}

    def run(batches):
        for batch in batches:
            # Frames are large: few are held as numbers at a time.
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                shape = np.stack([np.nan_to_num(part.column(at[c]).to_numpy(zero_copy_only=False).astype(float)).astype(int) for c in ("height", "width", "channels")], 1)
                pixels = [p.as_buffer() if p.is_valid else b"" for p in part.column(at["pixels"])]
                hashes, keys = np.zeros(len(shape), np.int64), [hashlib.sha256(b"").hexdigest()] * len(shape)
                for one in np.unique(shape, axis=0):
                    rows = np.flatnonzero((shape == one).all(1))
                    if not one.all():
                        continue
                    images = np.stack([np.frombuffer(pixels[r], np.uint8).reshape(one) for r in rows])
                    hashes[rows] = perceptual_hashes(images if one[2] == 3 else images[..., 0], side)
                    for r, image in zip(rows, images, strict=True):
                        keys[r] = hashlib.sha256(np.ascontiguousarray(image[::stride, ::stride]).tobytes()).hexdigest()
                yield pa.RecordBatch.from_arrays([*(part.column(at[c]) for c in keep), pa.array(keys, pa.string()), pa.array(hashes)], names=[*keep, "exact_key", "phash"])

    return frames.mapInArrow(run, frames.select(*keep).schema.add("exact_key", "string").add("phash", "long"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def masks_of(tolerance: int, bands: int) -> list[int]:
    """Masks of bits of which hashes at most ``tolerance`` bits apart agree on one at least: every choice of bands - tolerance bands."""
    edges = [64 * k // bands for k in range(bands + 1)]
    out = []
    for chosen in combinations(range(bands), bands - tolerance):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def bands_for(n: int, tolerance: int) -> int:
    """Bands so that the keys' 64 (bands - tolerance) / bands bits part n even hashes into buckets of some 64."""
    bands = tolerance + 1
    while n > 64 * 2 ** (64 * (bands - tolerance) // bands) and bands < tolerance + 5:
        bands += 1
    return bands


def close_hashes(left: DataFrame, right: DataFrame, tolerance: int = BITS, bands: int | None = None) -> DataFrame:
    """Pairs (a, b, distance) of the different hashes of left and right that are at most ``tolerance`` bits apart.

    left, right: phash, one row for each. Both are dealt by masked hashes of which close ones share one at least; a pair that shares several is
    compared once. With more hashes more bands make the masks longer and the buckets smaller.
    """
    masks = masks_of(tolerance, bands or bands_for(right.count(), tolerance))
    held = F.array(*[F.lit(m).cast("long") for m in masks])

    def keys(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("phash").alias(name), F.posexplode(F.transform(held, lambda m: F.col("phash").bitwiseAND(m))).alias("_mask", "_key"))

    pairs = keys(left, "a").join(keys(right, "b"), ["_mask", "_key"])
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.array_position(F.transform(held, lambda m: differ.bitwiseAND(m) == 0), True) - 1
    return pairs.withColumn("distance", F.bit_count(differ)).where((F.col("distance") <= tolerance) & (first == F.col("_mask"))).select("a", "b", "distance")


def nearest_by_hash(queries: DataFrame, store: DataFrame, tolerance: int = BITS, bands: int | None = None) -> DataFrame:
    """Columns of queries with match_id and distance of the nearest frame of the store; nulls where none is within the tolerance.

    queries: phash; store: frame_id, phash. Of equally near hashes the one that was stored first counts, of frames with that hash the
    one stored last. Groups of frames with one hash, however large, meet as one.
    """
    held = store.where("phash IS NOT NULL").groupBy("phash").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"))
    pairs = close_hashes(queries.select("phash").where("phash IS NOT NULL").distinct(), held.select("phash"), tolerance, bands)
    best = pairs.join(held.withColumnRenamed("phash", "b"), "b").groupBy("a").agg(F.min(F.struct("distance", "first", "last")).alias("m"))
    return queries.join(best.select(F.col("a").alias("phash"), F.col("m.last").alias("match_id"), F.col("m.distance").alias("distance")), "phash", "left")


def matched(queries: DataFrame, store: DataFrame, mode: str = "embedding", tolerance: int = BITS, cosine: float = COSINE) -> DataFrame:
    """query_id, level (exact, perceptual, embedding or miss) and match_id: the first level at which the store holds a frame.

    queries: query_id, exact_key, phash, emb; store: frame_id, exact_key, phash, emb. By key the frame stored last, by hash the nearest, by cosine
    the one stored last that reaches it. ``mode`` names the last level tried. Only queries without a match go to the next level.
    """
    by_key = store.groupBy("exact_key").agg(F.max("frame_id").alias("match_id"))
    one = queries.select("query_id", "exact_key").join(by_key, "exact_key", "left").select("query_id", "match_id", F.lit("exact").alias("level"))
    found, left = one.where("match_id IS NOT NULL"), one.where("match_id IS NULL").select("query_id")
    if mode in ("perceptual", "embedding"):
        two = nearest_by_hash(queries.select("query_id", "phash").join(left, "query_id"), store.select("frame_id", "phash"), tolerance)
        two = two.select("query_id", "match_id", F.lit("perceptual").alias("level"))
        found, left = found.unionByName(two.where("match_id IS NOT NULL")), two.where("match_id IS NULL").select("query_id")
    if mode == "embedding":
        near = above(store.select("frame_id", "emb"), queries.select("query_id", "emb").join(left, "query_id"), cosine)
        three = near.groupBy("query_id").agg(F.max("frame_id").alias("match_id"))
        found = found.unionByName(three.withColumn("level", F.lit("embedding")))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("level", F.lit("miss")).alias("level"), "match_id")
