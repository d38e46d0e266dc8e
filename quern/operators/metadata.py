"""Metadata predicates: hard filter, soft score, rules for geography and motion, text to intent."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK = 3600.0
#: Keywords of each class, in the order in which classes are tried.
GEO = {
    "coast": ("coast", "beach", "ocean", "seaside", "shore", "海边", "沙滩", "海滩", "海岸", "岸边"),
    "mountain": ("mountain", "summit", "hill", "peak", "山", "山上", "山顶", "山里", "爬山"),
    "urban": ("city", "downtown", "street", "urban", "skyline", "商场", "市区", "市中心", "街道", "城市"),
    "indoor_home": ("home", "room", "bedroom", "kitchen", "living room", "家", "家里", "卧室", "厨房", "客厅", "屋里", "室内"),
    "indoor_public": ("restaurant", "cafe", "mall", "office", "餐厅", "饭店", "咖啡", "商场", "办公室"),
    "rural": ("countryside", "farm", "village", "乡下", "农村", "田野", "村庄"),
    "road": ("highway", "road", "traffic", "高速", "马路", "公路"),
}
MOTION = {
    "running": ("running", "jogging", "跑步", "跑", "晨跑", "夜跑", "奔跑"),
    "walking": ("walk", "walking", "strolling", "hiking", "散步", "走路", "徒步", "漫步", "走"),
    "cycling": ("cycling", "biking", "bike", "骑行", "骑车", "自行车"),
    "vehicle": ("driving", "car ride", "bus", "train", "开车", "乘车", "坐车", "行车", "公交", "地铁"),
    "stationary": ("sitting", "still", "静态", "静止", "坐着"),
}
DEVICE = {"huawei": ("huawei", "mate", "华为", "荣耀"), "iphone": ("iphone", "apple"), "samsung": ("samsung", "galaxy", "三星")}
#: First and last month of the seasons, in the order in which they are tried.
SEASONS = (("spring|春天|春季", 3, 5), ("summer|夏天|夏季", 6, 8), ("autumn|fall|秋天|秋季", 9, 11), ("winter|冬天|冬季", 12, 2))
EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


#: Boxes of coasts (least and greatest latitude, least and greatest longitude).
COASTS = ((18.0, 20.0, 108.5, 111.0), (36.5, 38.5, 120.0, 122.5), (22.0, 23.5, 113.5, 114.7))


def geo_class(lat: Column, lon: Column, alt: Column, coasts=COASTS) -> Column:
    """coast inside one of the (lat, lat, lon, lon) boxes, mountain from 800 m, else unknown; unknown without coordinates."""
    near = F.lit(False)
    for a, b, c, d in coasts:
        near = near | (lat.between(a, b) & lon.between(c, d))
    return F.when(lat.isNull() | lon.isNull(), "unknown").when(near, "coast").when(alt >= 800, "mountain").otherwise("unknown")


def motion_class(gyro: Column, acc: Column, hz: Column) -> Column:
    """Label and confidence from mean gyroscope norm, mean deviation from gravity (or null) and main frequency."""
    def out(name, conf):
        return F.struct(F.lit(name).alias("label"), F.lit(conf).alias("confidence"))

    return (
        F.when((gyro < 0.05) & (acc.isNull() | (acc < 0.3)), out("stationary", 0.9))
        .when((hz >= 2.2) & (hz <= 4) & (acc > 1.5), out("running", 0.85))
        .when((hz >= 1.2) & (hz < 2.2) & (acc > 0.5), out("walking", 0.8))
        .when((hz < 1) & (gyro < 0.2) & (acc < 0.5), out("vehicle", 0.6))
        .when((gyro >= 0.05) & (gyro <= 0.5), out("walking", 0.5))
        .when(gyro > 1, out("running", 0.5))
        .otherwise(out("unknown", 0.3))
    )


def constrained(axis: str) -> Column:
    """Whether the intent says something about time, geo, motion or device: an empty list or name doesn't."""
    if axis == "time":
        return F.col("t_start").isNotNull()
    if axis == "device":
        return F.coalesce(F.col("q_device") != "", F.lit(False))
    return F.coalesce(F.size(f"q_{axis}") > 0, F.lit(False))


AXES = ("time", "geo", "motion", "device")


def has_constraint() -> Column:
    return constrained("time") | constrained("geo") | constrained("motion") | constrained("device")


def axis_pass(axis: str, strict: bool, slack: float = SLACK, lower=F.lower) -> Column:
    """Whether a video meets an intent on one axis: an unconstrained one is met, a missing value is unless strict. lower: of devices' names, where they aren't."""
    if axis == "time":
        ok = F.col("created").between(F.col("t_start") - slack, F.col("t_end") + slack)
    elif axis == "device":
        ok = F.instr(lower(F.nullif(F.col("device"), F.lit(""))), lower(F.col("q_device"))) > 0
    else:
        ok = F.when(F.col(axis).isNotNull(), F.array_contains(f"q_{axis}", F.col(axis)))
    return ~constrained(axis) | F.coalesce(ok, F.lit(not strict))


def hard_pass(strict: bool, slack: float = SLACK) -> Column:
    """Whether a video (created, geo, motion, device) meets an intent (t_start, t_end, q_geo, q_motion, q_device) on all axes."""
    out = F.lit(True)
    for axis in AXES:
        out = out & axis_pass(axis, strict, slack)
    return out


def fired() -> Column:
    """The axes that an intent constrains, in fixed order."""
    return F.array_compact(F.array(*[F.when(constrained(axis), F.lit(axis)) for axis in AXES]))


def axis_score(axis: str, slack: float = SLACK, lower=F.lower) -> Column:
    """How well a video meets an intent on one axis, from 0 to 1: a missing value counts 0.5, a motion confidence of 0 as 1."""
    if axis == "time":
        c, h = (F.col("t_start") + F.col("t_end")) / 2, F.greatest((F.col("t_end") - F.col("t_start")) / 2, F.lit(1.0))
        k, d = F.greatest(F.lit(slack), h), F.abs(F.col("created") - c)
        return F.when(F.col("created").isNull(), 0.5).when(d <= h, 1.0).when(d >= h + k, 0.0).otherwise(1 - (d - h) / k)
    if axis == "device":
        device = F.nullif(F.col("device"), F.lit(""))
        return F.when(device.isNull(), 0.5).otherwise((F.instr(lower(device), lower(F.col("q_device"))) > 0).cast("double"))
    full = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0)) if axis == "motion" else F.lit(1.0)
    return F.when(F.col(axis).isNull(), 0.5).when(F.array_contains(f"q_{axis}", F.col(axis)), full).otherwise(0.0)


def soft_score(slack: float = SLACK) -> Column:
    """Geometric mean of the scores of the constrained axes; 1 if there are none."""
    product, n = F.lit(1.0), F.lit(0)
    for axis in AXES:
        product = product * F.when(constrained(axis), axis_score(axis, slack)).otherwise(1.0)
        n = n + constrained(axis).cast("int")
    return F.when(n > 1, F.pow(product, 1 / n)).otherwise(product)


def axis_blocks(slack: float = SLACK):
    """A function of columns of videos and of queries that gives has, by axis and query, and ok and score, by axis, video and query.

    The same as :func:`constrained`, :func:`axis_pass` (not strict) and :func:`axis_score`, for kernels that hold pairs as blocks. Columns are numpy arrays (nan or None for
    null); names of devices are lowered, and q_geo and q_motion have tuples.
    """
    axes = AXES

    def listed(values, asked, within):
        """Whether a value is within what is asked, for each distinct one of both."""
        names, wanted = list(dict.fromkeys(values)), list(dict.fromkeys(asked))
        met = np.array([[v is not None and within(v, w) for w in wanted] for v in names], bool).reshape(len(names), len(wanted))
        row, column = ({x: k for k, x in enumerate(of)} for of in (names, wanted))
        return met[np.ix_([row[v] for v in values], [column[w] for w in asked])]

    def block(v: dict, q: dict):
        has, ok, score = [], [], []
        for axis in axes:
            if axis == "time":
                made, t0, t1 = v["created"][:, None], q["t_start"], q["t_end"]
                with np.errstate(invalid="ignore"):
                    h = np.maximum((t1 - t0) / 2, 1.0)
                    k, d, null = np.maximum(slack, h), np.abs(made - (t0 + t1) / 2), np.isnan(made)
                    has.append(~np.isnan(t0))
                    ok.append(~has[-1] | null | ((made >= t0 - slack) & ((made <= t1 + slack) | np.isnan(t1))))
                    score.append(np.where(null, 0.5, np.where(d <= h, 1.0, np.where(d >= h + k, 0.0, 1 - (d - h) / k))))
                continue
            if axis == "device":
                values, asked = [x or None for x in v["device"]], list(q["q_device"])
                has.append(np.array([bool(w) for w in asked], bool))
                met = listed(values, asked, lambda x, w: bool(w) and w in x)
            else:
                values, asked = list(v[axis]), list(q[f"q_{axis}"])
                has.append(np.array([bool(w) for w in asked], bool))
                met = listed(values, asked, lambda x, w: bool(w) and x in w)
            null, full = np.array([x is None for x in values], bool)[:, None], 1.0
            if axis == "motion":
                sure = v["confidence"]
                full = np.where(np.isnan(sure) | (sure == 0), 1.0, sure)[:, None]
            ok.append(~has[-1] | null | met)
            score.append(np.where(null, 0.5, np.where(met, full, 0.0)))
        return has, ok, score

    return block


def classes(text: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """Classes of which a keyword is a substring of the lower-cased text, in the lexicon's order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(_any(low, words), F.lit(name)) for name, words in lexicon.items()]))


def first_class(text: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(_any(low, words), F.lit(name)) for name, words in lexicon.items()])


def _any(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (F.instr(low, w) > 0)
    return out


def time_window(text: Column, now: dt.datetime) -> Column:
    """struct<t_start, t_end> in epoch seconds of the first time rule that the text meets; null for none."""
    day = dt.datetime(now.year, now.month, now.day, tzinfo=dt.timezone.utc)
    one = dt.timedelta(days=1)
    week, month = day - one * day.weekday(), day.replace(day=1)
    before = (month - one).replace(day=1)
    after = (month + 32 * one).replace(day=1)
    year = day.replace(month=1, day=1)
    saturday = day - one * ((day.weekday() - 5) % 7)
    low = F.lower(text)

    def span(a, b):
        return F.struct(F.lit(float(a.timestamp())).alias("t_start"), F.lit(float(b.timestamp())).alias("t_end"))

    def season(first: int, last: int):
        start = year.replace(month=first)
        end = year.replace(year=year.year + 1, month=last + 1) if last < first else year.replace(month=last + 1)
        return span(start, end)

    # Patterns of the time rules, in their order.
    rules = [
        (r"\btoday\b|今天|今日", span(day, day + one)),
        (r"\byesterday\b|昨天|昨日", span(day - one, day)),
        ("前天", span(day - 2 * one, day - one)),
        (r"\bthis week\b|本周|这周", span(week, week + 7 * one)),
        (r"\blast week\b|上周|上个星期|上星期", span(week - 7 * one, week)),
        (r"\bthis month\b|本月|这个月", span(month, after)),
        (r"\blast month\b|上月|上个月", span(before, month)),
        (r"\bthis year\b|今年", span(year, year.replace(year=year.year + 1))),
        (r"\blast year\b|去年", span(year.replace(year=year.year - 1), year)),
    ]
    # Days end at the present moment, not with the day.
    days = F.regexp_extract(low, r"(?:last|past|最近|过去|这)\s*(\d+)\s*(?:days|day|天)", 1).try_cast("double")
    present = now.timestamp()
    stated = F.regexp_extract(low, r"(\d{4})\s*(?:年|/|$)", 1).try_cast("int")
    january = lambda y: F.unix_timestamp(F.make_timestamp(y, *[F.lit(x) for x in (1, 1, 0, 0, 0)])).cast("double")
    return F.coalesce(
        *[F.when(low.rlike(r), w) for r, w in rules],
        F.when(days.isNotNull(), F.struct((F.lit(present) - days * 86400).alias("t_start"), F.lit(present).alias("t_end"))),
        F.when(low.rlike(r"\bweekend\b|周末|礼拜"), span(saturday, saturday + 2 * one)),
        *[F.when(low.rlike(names), season(a, b)) for names, a, b in SEASONS],
        F.when(stated.between(1, 9998), F.struct(january(stated).alias("t_start"), january(stated + 1).alias("t_end"))),
    )
