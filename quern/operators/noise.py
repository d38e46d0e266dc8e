"""Noise for robustness: draws that depend on a seed, a row's key and a name alone, so that any engine and any rerun gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of places, motions and makers that a wrong label is drawn from; degrees of a kilometre.
PLACES = ("indoor_home", "indoor_public", "urban", "suburban", "rural", "coast", "mountain", "road")
MOTIONS = ("stationary", "walking", "running", "cycling", "vehicle")
MAKERS = ("HUAWEI", "Apple", "Samsung", "Xiaomi")
SCENES = ("indoor", "outdoor", "nature", "urban", "beach", "sport")
DEGREE = 1.0 / 111.0
#: The levels of noise.
FIELDS = ("shift_days", "time_missing", "jitter_km", "wrong_place", "place_missing", "motion_flip", "motion_missing", "device_flip", "device_missing")
LEVELS = {
    "clean": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "mild": (3.0, 0.05, 5.0, 0.02, 0.05, 0.05, 0.05, 0.02, 0.05),
    "medium": (7.0, 0.2, 20.0, 0.1, 0.3, 0.15, 0.2, 0.05, 0.1),
    "heavy": (14.0, 0.4, 50.0, 0.2, 0.5, 0.3, 0.4, 0.1, 0.3),
    "missing": (0.0, 0.8, 20.0, 0.1, 0.8, 0.15, 0.8, 0.05, 0.8),
    "conflict": (30.0, 0.1, 20.0, 0.5, 0.1, 0.5, 0.1, 0.05, 0.1),
}


def uniform(seed: int, key: Column, name: str) -> Column:
    """A number from 0 up to 1, out of the first 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(name)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / 2.0**52


def normal(seed: int, key: Column, name: str) -> Column:
    """A standard normal number, of two uniform ones."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, key, name + "/a"))) * F.cos(F.lit(6.283185307179586) * uniform(seed, key, name + "/b"))


def choice(seed: int, key: Column, name: str, values) -> Column:
    place = F.floor(uniform(seed, key, name) * len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), place)


def levels(spark: SparkSession, names=tuple(LEVELS)) -> DataFrame:
    """level and its ``FIELDS``: a stated table of a few rows."""
    return spark.createDataFrame([(n, *LEVELS[n]) for n in names], "level string, " + ", ".join(f"{f} double" for f in FIELDS))


def noisy(metadata: DataFrame, noise: DataFrame, key: str = "video_id", seed: int = 42) -> DataFrame:
    """Columns of metadata with level, for every level of ``noise`` (see :func:`levels`): values shifted, replaced or missing.

    metadata: key, creation_time, latitude, longitude, geo_category, motion_class, motion_confidence, device_make, device_model. What is null stays null. A place whose coordinates get lost loses its
    kind too; a wrong motion has 0.3 less confidence, 0.3 at least.
    """
    by = F.concat_ws("/", F.col("level"), F.col(key).cast("string"))
    u = lambda name: uniform(seed, by, name)
    at = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    lost = u("place missing") < F.col("place_missing")
    wrong = u("place wrong") < F.col("wrong_place")
    off = lambda name: F.col("jitter_km") * DEGREE * normal(seed, by, name)
    still = u("motion missing") < F.col("motion_missing")
    flip = u("motion flip") < F.col("motion_flip")
    gone = u("device missing") < F.col("device_missing")
    known = F.col("device_make").isNotNull()
    moved = F.when(F.col("motion_class").isNull(), F.col("motion_confidence")).when(still, None).when(flip, F.greatest(F.lit(0.3), F.coalesce("motion_confidence", F.lit(0.8)) - 0.3)).otherwise(F.col("motion_confidence"))
    made = {
        "creation_time": F.when(u("time missing") >= F.col("time_missing"), F.col("creation_time") + F.col("shift_days") * 86400 * normal(seed, by, "time")),
        "latitude": F.when(~at, F.col("latitude")).when(~lost, F.col("latitude") + off("latitude")),
        "longitude": F.when(~at, F.col("longitude")).when(~lost, F.col("longitude") + off("longitude")),
        "geo_category": F.when(~lost & (at | F.col("geo_category").isNotNull()), F.when(wrong, choice(seed, by, "place", PLACES)).otherwise(F.col("geo_category"))),
        "motion_class": F.when(F.col("motion_class").isNotNull() & ~still, F.when(flip, choice(seed, by, "motion", MOTIONS)).otherwise(F.col("motion_class"))),
        "motion_confidence": moved,
        "device_make": F.when(known & ~gone, F.when(u("device flip") < F.col("device_flip"), choice(seed, by, "device", MAKERS)).otherwise(F.col("device_make"))),
        "device_model": F.when(~(known & gone), F.col("device_model")),
    }
    rows = metadata.crossJoin(F.broadcast(noise))
    return rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in metadata.columns], "level")


def perturbed(signals: DataFrame, level: float, seed: int = 42) -> DataFrame:
    """Signals of a gallery (see ``gallery.gallery_signals``) as weaker models would give them: scores moved and kept in 0..1, some faces and scenes wrong."""
    key = F.concat_ws("/", F.lit(str(level)), F.col("video_id").cast("string"))
    moved = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) + level * normal(seed, key, c)))
    hit = lambda name: uniform(seed, key, name) < level
    face = F.transform("face_emb", lambda x, i: x + level * normal(seed, F.concat_ws("/", key, i.cast("string")), "face value"))
    scene = choice(seed, key, "scene", SCENES)
    change = F.col("scenes").isNotNull() & hit("scene wrong")
    made = {
        "highlight": moved("highlight"), "face": moved("face"), "face_emb": F.when(hit("face wrong"), face).otherwise(F.col("face_emb")),
        "scene": F.when(change, scene).otherwise(F.col("scene")), "scenes": F.when(change, F.create_map(scene, F.lit(1.0))).otherwise(F.col("scenes")),
    }
    return signals.select(*[made[c].alias(c) if c in made else F.col(c) for c in signals.columns])
