"""Column functions: boxes, places, vectors, time support, link scores, tokens and name parsing.

All are built-in expressions, so they stay inside generated code and can be pushed down; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The earth's radius, and metres of a degree on the plane.
EARTH_M = 6371000.0
METRES_PER_DEGREE = 111320.0


def half_open(x1: str, y1: str, x2: str, y2: str) -> tuple[Column, Column, Column, Column]:
    return F.col(x1), F.col(y1), F.col(x2), F.col(y2)


def iou(a: tuple, b: tuple, empty: str = "zero") -> Column:
    """Intersection over union of two boxes of corners. ``empty``: what a union of nothing gives, ``zero`` or ``null``."""
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    shared = wide * high
    area = lambda r: F.greatest(r[2] - r[0], F.lit(0)) * F.greatest(r[3] - r[1], F.lit(0))
    united = area(a) + area(b) - shared
    ratio = F.when(united > 0, shared.cast("double") / united)
    return F.coalesce(ratio, F.lit(0.0)) if empty == "zero" else ratio


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null where a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2.0)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat0: float = 38.9209) -> Column:
    """Metres on a plane that touches the earth at ``lat0``."""
    return F.hypot((lat2 - lat1) * METRES_PER_DEGREE, (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians(F.lit(lat0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector divided by its length plus 1e-9."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + 1e-9))


def interval_gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Between closed intervals; 0 where they meet."""
    return F.greatest(F.lit(0), lo_b - hi_a, lo_a - hi_b)


def meets(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return (lo_a <= hi_b) & (lo_b <= hi_a)


def decay(gap: Column, window: float) -> Column:
    """exp(-gap / window), 0 beyond the window."""
    return F.when(gap <= window, F.exp(-gap / F.lit(float(window)))).otherwise(0.0)


def log_ratio(a: Column, b: Column) -> Column:
    """|log(a / b)| of sizes of at least 1; a null size counts as 1."""
    one = F.lit(1.0)
    return F.abs(F.log(F.greatest(a.cast("double"), one) / F.greatest(b.cast("double"), one)))


def size_likeness(h_a: Column, w_a: Column, h_b: Column, w_b: Column) -> Column:
    return F.exp(-(log_ratio(h_a, h_b) + 0.5 * log_ratio(w_a, w_b)))


def link_score(visual: Column, a: str, b: str, gap: Column, reach: float, weights: tuple[float, float, float, float], pace: float = 1.0) -> Column:
    """How well the track whose columns start with ``b`` continues the one that start with ``a``: appearance, distance from
    where constant velocity leads, frame gap and size, in ``weights``' shares."""
    c = lambda side, name: F.col(f"{side}{name}").cast("double")
    lasted = F.greatest(c(a, "frame1") - c(a, "frame0"), F.lit(1.0))
    ahead = [c(a, f"last_{k}") + (c(a, f"last_{k}") - c(a, f"first_{k}")) / lasted * gap for k in ("cx", "cy")]
    away = F.hypot(ahead[0] - c(b, "first_cx"), ahead[1] - c(b, "first_cy"))
    scale = F.greatest((c(a, "last_h") + c(b, "first_h")) * 0.5 * pace, F.lit(1.0))
    place = F.exp(-0.5 * F.pow(away / scale, 2.0))
    near = F.exp(-gap / F.lit(max(reach, 1.0)))
    size = size_likeness(c(a, "last_h"), c(a, "last_w"), c(b, "first_h"), c(b, "first_w"))
    return weights[0] * F.greatest(visual, F.lit(0.0)) + weights[1] * place + weights[2] * near + weights[3] * size


#: Shares of appearance, place, gap and size.
TRAJECTORY, ENDPOINT = (0.55, 0.25, 0.15, 0.05), (0.52, 0.25, 0.13, 0.10)


def quality(n: Column, w: Column, h: Column, conf: Column) -> Column:
    """Of a track: detections, area and confidence count for it, odd proportions and tiny boxes against it. A null confidence counts as 0, null sizes as 1."""
    one = F.lit(1.0)
    tall = F.greatest(h, one) / F.greatest(w, one)
    odd = F.least(F.abs(F.log(F.greatest(tall, F.lit(1e-6)) / 2.4)) / 1.25, one)
    tiny = F.least(F.greatest(F.lit(0.0), F.log(80.0 / F.greatest(h, one))) / 2.0, one)
    seen = F.log1p(n.cast("double")) / F.log1p(F.lit(120.0))
    area = F.log1p(F.greatest(w * h, one)) / F.log1p(F.lit(50000.0))
    return 0.30 * seen + 0.35 * area + 0.25 * F.least(F.greatest(conf, F.lit(0.0)), one) - 0.06 * odd - 0.04 * tiny


#: Upper bounds and names of the buckets of box and track measures.
BUCKETS = {
    "height": ([(80, "tiny"), (150, "small"), (260, "medium"), (420, "large")], "xlarge"),
    "area": ([(6000, "tiny"), (18000, "small"), (45000, "medium"), (90000, "large")], "xlarge"),
    "aspect": ([(1.7, "wide"), (2.5, "body"), (3.4, "tall")], "very_tall"),
    "duration": ([(8, "very_short"), (24, "short"), (90, "medium"), (240, "long")], "very_long"),
    "conf": ([(0.35, "low"), (0.55, "medium"), (0.75, "high")], "very_high"),
}


def bucket(value: Column, kind: str) -> Column:
    cuts, rest = BUCKETS[kind]
    out = F
    for most, name in cuts:
        out = out.when(value < most, name)
    return out.otherwise(rest)


def motion(delta: Column, scale: Column, names: tuple[str, str]) -> Column:
    still = (scale <= 1e-6) | (F.abs(delta) / scale < 0.04)
    return F.when(still, "stable").when(delta > 0, names[1]).otherwise(names[0])


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, which keeps generated code small where it is used often."""
    return F.get(F.transform(F.array(value), then), 0)


def colour(r: Column, g: Column, b: Column) -> Column:
    """A coarse colour name by hue, saturation and value; channels are clipped to 0..255, null or NaN is unknown."""
    channels = [c.cast("double") for c in (r, g, b)]
    known = [c.isNotNull() & ~F.isnan(c) for c in channels]  # before clipping, which skips nulls
    clipped = F.struct(*[F.greatest(F.least(c, F.lit(255.0)), F.lit(0.0)).alias(n) for n, c in zip("rgb", channels, strict=True)])

    def spread(c: Column) -> Column:
        return F.struct(c.alias("c"), F.greatest(c["r"], c["g"], c["b"]).alias("most"), F.least(c["r"], c["g"], c["b"]).alias("least"))

    def shade(s: Column) -> Column:
        c, most, span = s["c"], s["most"], s["most"] - s["least"]
        turn = F.when(span == 0, 0.0).when(c["r"] == most, (c["g"] - c["b"]) / span).when(c["g"] == most, 2.0 + (c["b"] - c["r"]) / span).otherwise(4.0 + (c["r"] - c["g"]) / span)
        return F.struct(most.alias("most"), span.alias("span"), (F.pmod(turn / 6.0, F.lit(1.0)) * 360.0).alias("hue"), F.when(most > 0, span / most).otherwise(0.0).alias("saturation"))

    def name(s: Column) -> Column:
        hue, value = s["hue"], s["most"] / 255.0
        return (
            F.when(s["most"] < 45, "black").when((s["most"] > 220) & (s["span"] < 28), "white").when(s["span"] < 30, "gray")
            .when((hue >= 20) & (hue < 50) & (value < 0.65), "brown").when((hue < 15) | (hue >= 345), "red").when(hue < 45, "orange")
            .when(hue < 75, "yellow").when(hue < 165, "green").when(hue < 250, "blue").when(hue < 310, "purple")
            .when((s["saturation"] < 0.55) | (value > 0.65), "pink").otherwise("red")
        )

    return F.when(known[0] & known[1] & known[2], _let(_let(_let(clipped, spread), shade), name)).otherwise("unknown")


def tokens_of_text(text: Column) -> Column:
    """``a:b|c, d`` as distinct lower-case tokens in order."""
    parts = F.transform(F.split(F.replace(text, F.lit(","), F.lit("|")), "\\|"), lambda t: F.lower(F.trim(t)))
    return F.array_distinct(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda t: t != ""))


def tokens_of_map(tokens: Column) -> Column:
    """A map's ``key:value`` tokens, lower-case and sorted, without unknown values."""
    clean = lambda x: F.lower(F.trim(x))
    known = F.map_filter(tokens, lambda _, v: v.isNotNull() & ~clean(v).isin("", "unknown", "none", "nan"))
    return F.array_sort(F.array_distinct(F.transform(F.map_entries(known), lambda e: F.concat(clean(e["key"]), F.lit(":"), clean(e["value"])))))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared > 0, shared / F.size(F.array_union(a, b)).cast("double")).otherwise(0.0)


def box_hash(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """SHA-256 of the corners as a JSON list of numbers with one decimal (whole coordinates)."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *[F.concat(c.cast("long").cast("string"), F.lit(".0")) for c in (x1, y1, x2, y2)]), F.lit("]")), 256)


def json_box_hash(*corners: Column) -> Column:
    """SHA-256 of corners as a JSON list of numbers, each rounded to six decimals and written without trailing zeros (one decimal at least)."""
    number = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.round(c.cast("double"), 6)), "0+$", ""), "\\.$", ".0")
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *[number(c) for c in corners]), F.lit("]")), 256)


def pair(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))


def clock_ms(text: Column) -> Column:
    """``HH:MM:SS.fff`` as milliseconds since midnight."""
    part = F.split(text, ":")
    return (F.get(part, 0).cast("long") * 3600 + F.get(part, 1).cast("long") * 60) * 1000 + F.round(F.get(part, 2).cast("double") * 1000).cast("long")


def version_of(name: Column) -> Column:
    """The numbers of ``_v1.2.3`` as an array, which compares like a version."""
    return F.transform(F.split(F.regexp_extract(name, "_v([0-9]+(?:\\.[0-9]+)*)", 1), "\\."), lambda x: x.cast("int"))


def ridge(values: Column, fill: Column, mean: Column, scale: Column, weights: Column, base: Column, lo: Column, hi: Column, margin: float = 0.05) -> Column:
    """A stored linear model: fill what is missing, standardise, weigh, clamp to the target's range and a margin."""
    rows = F.arrays_zip(values.alias("v"), fill.alias("f"), mean.alias("m"), scale.alias("s"), weights.alias("w"))
    total = F.aggregate(rows, base.cast("double"), lambda t, r: t + r["w"] * (F.coalesce(r["v"], r["f"]) - r["m"]) / F.when(r["s"] == 0, 1.0).otherwise(r["s"]))
    return F.least(F.greatest(total, lo - margin), hi + margin)


def local_track(video: Column, key: Column) -> Column:
    """``video:part`` of a tracklet key: the part after its video, else the last part but one; null where there is neither."""
    prefix, parts = F.concat(video, F.lit(":")), F.split(key, ":")
    after = F.substring_index(F.substring(key, F.length(prefix) + 1, F.length(key)), ":", 1)
    return F.when(F.startswith(key, prefix), F.concat(prefix, after)).when(F.size(parts) >= 2, F.concat(prefix, F.try_element_at(parts, F.lit(-2))))


def numeric_ids(keys: DataFrame, key: str) -> DataFrame:
    """``key, id`` for distinct names: their last digits where positive and no name before has them, else numbers above all of
    these, in order of names. Only names without a number of their own are ordered in one task."""
    digits = F.expr(f"try_cast(nullif(regexp_extract(`{key}`, '([0-9]+)$', 1), '') AS bigint)")
    d = keys.select(F.col(key).alias("key"), digits.alias("digits"))
    first = d.where("digits > 0").groupBy("digits").agg(F.min("key").alias("key"))
    own = first.select("key", F.col("digits").alias("id"))
    rest = d.join(own, "key", "left_anti").select("key").crossJoin(F.broadcast(d.agg(F.coalesce(F.max("digits"), F.lit(0)).alias("most"))))  # one row
    return own.unionByName(rest.select("key", (F.col("most") + F.row_number().over(Window.orderBy("key"))).alias("id")))
