"""Main frequencies of series, and motion of sensor streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.metadata import motion_class

#: Rows of a series from which its transform is spread over tasks.
LONG = 1 << 16
#: Gravity, and rows that a stream has at least for a judgement.
GRAVITY, GYRO_ROWS, ACCEL_ROWS = 9.80, 2, 5


def main_frequency(rows: DataFrame, key: str, i: str, value: str, long: int = LONG) -> DataFrame:
    """key, n_rows, bin: rows of a series and the place of its strongest frequency, which is bin / n_rows of the rows' rate. Null for fewer than two rows.

    i numbers a series' rows from 0. The constant part doesn't count; of equal frequencies the lowest does. Series of up to ``long`` rows are transformed
    in Arrow batches, a series as a row; of longer ones no task holds more than some square roots of their length.
    """
    rows = rows.select(F.col(key).alias("_key"), F.col(i).cast("long").alias("i"), F.col(value).cast("double").alias("x"))
    counts = rows.groupBy("_key").agg(F.count("*").alias("n"))
    same = F.col("a._key").eqNullSafe(F.col("b._key"))
    sized = rows.alias("a").join(counts.alias("b"), same).select("a._key", "i", "x", "n")
    short = sized.where(F.col("n") <= long).groupBy("_key", "n").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))

    def strongest(batches):
        for batch in batches:
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            values = batch.column(2).flatten().field("x").to_numpy(zero_copy_only=False)
            best = []
            for x in np.split(values, ends[:-1]) if len(ends) else []:
                spectrum = np.abs(np.fft.rfft(x - x.mean()))
                best.append(1 + int(spectrum[1:].argmax()) if len(spectrum) > 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.int64())], names=["_key", "n", "k"])

    one = counts.schema.add("k", "long")
    out = short.mapInArrow(strongest, one)
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    half = spread_transform(sized.where(F.col("n") > long)).where((F.col("i") > 0) & (F.col("i") <= F.floor(F.col("n") / 2)))
    wide = half.groupBy("_key", "n").agg(F.max_by(F.col("i"), F.struct(size, -F.col("i"))).alias("k"))
    return out.unionByName(wide).select(F.col("_key").alias(key), F.col("n").alias("n_rows"), F.col("k").alias("bin"))


def spread_transform(series: DataFrame) -> DataFrame:
    """_key, n, i, re, im: the discrete Fourier transform of whole series (_key, i, x, n), however long.

    A transform of n points is a convolution with exp(i pi k^2 / n), done at a power of two of at least 2 n - 1 points. Such a transform is two rounds
    of short ones: rows are grouped by their place modulo a root of the length, and their results by the other part of their place.
    """
    m = F.pow(F.lit(2.0), F.ceil(F.log2(2 * F.col("n") - 1))).cast("long")
    angle = F.lit(np.pi) * ((F.col("i") * F.col("i")) % (2 * F.col("n"))) / F.col("n")
    turned = series.withColumn("m", m).select("_key", "n", "m", "i", (F.col("x") * F.cos(angle)).alias("re"), (-F.col("x") * F.sin(angle)).alias("im"))
    sizes = series.select("_key", "n").distinct().withColumn("m", m)
    wave = sizes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumns({"re": F.cos(angle), "im": F.sin(angle)})
    mirror = F.when(F.col("i") == 0, F.array("i")).otherwise(F.array("i", F.col("m") - F.col("i")))
    wave = wave.withColumn("i", F.explode(mirror)).select("_key", "n", "m", "i", "re", "im")
    a, b = _powers(turned, False), _powers(wave, False)
    at = a.alias("a").join(b.alias("b"), F.col("a._key").eqNullSafe(F.col("b._key")) & (F.col("a.i") == F.col("b.i")))
    re, im = (F.col(f"a.{c}") for c in ("re", "im"))
    product = at.select("a._key", "a.n", "a.m", "a.i", (re * F.col("b.re") - im * F.col("b.im")).alias("re"), (re * F.col("b.im") + im * F.col("b.re")).alias("im"))
    back = _powers(product, True).where(F.col("i") < F.col("n"))
    return back.select("_key", "n", "i", (F.col("re") * F.cos(angle) + F.col("im") * F.sin(angle)).alias("re"), (F.col("im") * F.cos(angle) - F.col("re") * F.sin(angle)).alias("im"))


def _powers(points: DataFrame, inverse: bool) -> DataFrame:
    """The transform of points (_key, n, m, i, re, im) of m, a power of two, by rows i; rows that are missing are 0."""
    bits = F.log2(F.col("m")).cast("int")
    # i is i1 * m2 + i2 before, and k1 + m1 * k2 after.
    m1 = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(bits / 2).cast("int"))
    m2 = (F.col("m") / m1).cast("long")
    one = _round(points.withColumns({"_g": F.col("i") % m2, "_p": F.floor(F.col("i") / m2)}), m1, inverse)
    sign = 1.0 if inverse else -1.0
    angle = F.lit(sign * 2 * np.pi) * ((F.col("_g") * F.col("_p")) % F.col("m")) / F.col("m")
    twisted = one.select("_key", "n", "m", F.col("_p").alias("_g"), F.col("_g").alias("_p"), (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("re"), (F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)).alias("im"))
    two = _round(twisted, m2, inverse)
    return two.select("_key", "n", "m", (F.col("_g") + m1 * F.col("_p")).alias("i"), "re", "im")


def _round(points: DataFrame, length: Column, inverse: bool) -> DataFrame:
    """Transforms each group (_key, _g) of ``length`` places _p."""
    lists = points.groupBy("_key", "n", "m", "_g").agg(F.collect_list(F.struct(F.col("_p").alias("i"), "re", "im")).alias("x")).withColumn("l", length)

    def run(batches):
        for batch in batches:
            sizes = batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(4).flatten()
            at, re, im = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("i", "re", "im"))
            lengths = batch.column(5).to_numpy(zero_copy_only=False)
            done = []
            for k, end in enumerate(np.cumsum(sizes)):
                full = np.zeros(lengths[k], complex)
                cells = slice(end - sizes[k], end)
                full[at[cells]] = re[cells] + 1j * im[cells]
                done.append(np.fft.ifft(full) if inverse else np.fft.fft(full))
            whole = np.concatenate(done) if done else np.zeros(0, complex)
            place = np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else np.zeros(0, np.int64)
            cells = pa.StructArray.from_arrays([pa.array(place.astype(np.int64)), pa.array(whole.real), pa.array(whole.imag)], names=["i", "re", "im"])
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.ListArray.from_arrays(offsets, cells)], names=["_key", "n", "m", "_g", "x"])

    kind = T.ArrayType(T.StructType().add("i", "long").add("re", "double").add("im", "double"))
    out = lists.mapInArrow(run, lists.select("_key", "n", "m", "_g").schema.add("x", kind))
    return out.select("_key", "n", "m", "_g", F.explode("x").alias("x")).select("_key", "n", "m", "_g", F.col("x.i").alias("_p"), "x.re", "x.im")


def sensor_motion(gyro: DataFrame, accel: DataFrame, key: str, rate: float = 50.0, long: int = LONG) -> DataFrame:
    """key, label, confidence, gyro_mag, accel_mag, hz of each stream with gyroscope rows.

    gyro: key, gx, gy, gz; accel: key, i (from 0), ax, ay, az at ``rate`` rows a second. A stream of fewer than two gyroscope rows is unknown with confidence 0; of an
    accelerometer with fewer than five rows nothing is used.
    """
    norm = lambda *c: F.sqrt(sum((F.col(x) * F.col(x) for x in c[1:]), F.col(c[0]) * F.col(c[0])))
    turns = gyro.groupBy(F.col(key).alias("_g")).agg(F.avg(norm("gx", "gy", "gz")).alias("gyro_mag"), F.count("*").alias("_n"))
    pull = accel.select(key, "i", (norm("ax", "ay", "az") - GRAVITY).alias("v"))
    enough = pull.groupBy(F.col(key).alias("_a")).agg(F.avg(F.abs("v")).alias("accel_mag"), F.count("*").alias("_rows")).where(F.col("_rows") >= ACCEL_ROWS).drop("_rows")
    beat = main_frequency(pull, key, "i", "v", long).select(F.col(key).alias("_f"), (F.col("bin") * rate / F.col("n_rows")).alias("hz"))
    out = turns.join(enough, F.col("_g").eqNullSafe(F.col("_a")), "left").join(beat, F.col("_a").eqNullSafe(F.col("_f")) & F.col("accel_mag").isNotNull(), "left")
    none = F.struct(F.lit("unknown").alias("label"), F.lit(0.0).alias("confidence"))
    few = F.col("_n") < GYRO_ROWS
    motion = F.when(few, none).otherwise(motion_class(F.col("gyro_mag"), F.col("accel_mag"), F.col("hz")))
    shown = [F.when(~few, F.col(c)).alias(c) for c in ("gyro_mag", "accel_mag", "hz")]
    return out.select(F.col("_g").alias(key), motion.alias("m"), *shown).select(key, "m.label", "m.confidence", "gyro_mag", "accel_mag", "hz")
