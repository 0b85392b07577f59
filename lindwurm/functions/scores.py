"""Blocking keys, signal scores, combination and decision, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lindwurm.config import DEFAULTS
from lindwurm.functions.similarity import token_ratios, token_sort_ratio
from lindwurm.functions.text import casefolded, stripped

# Cells and bounds of the geographic blocking.
GRID_LAT, GRID_LON = 0.09, 0.13
BOX = {"lat": (47.5, 48.5), "lon": (7.3, 8.5)}
TRUSTED = 0.85


def parse_time(text: Column) -> Column:
    """'HH:mm:ss' of H:M or H:M:S, else null; hours and minutes out of range give null."""
    parts = F.split(F.trim(text), ":")
    n = F.size(parts)
    h, m = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    s = F.when(n == 3, F.try_element_at(parts, F.lit(3)).try_cast("int")).otherwise(F.lit(0))
    good = n.isin(2, 3) & h.between(0, 23) & m.between(0, 59) & s.between(0, 59)
    return F.when(good, F.format_string("%02d:%02d:%02d", h, m, s))


def seconds(text: Column) -> Column:
    time = parse_time(text)
    return F.substring(time, 1, 2).cast("int") * 3600 + F.substring(time, 4, 2).cast("int") * 60 + F.substring(time, 7, 2).cast("int")


def geo_grid_key(lat: Column, lon: Column) -> Column:
    """Cell of about 10 km a side, rounded half to even."""
    return F.concat(F.format_string("%.2f", F.rint(lat / GRID_LAT) * GRID_LAT), F.lit("|"), F.format_string("%.2f", F.rint(lon / GRID_LON) * GRID_LON))


def trusted_position(lat: Column, lon: Column, confidence: Column) -> Column:
    return F.coalesce((confidence >= TRUSTED) & lat.between(*BOX["lat"]) & lon.between(*BOX["lon"]), F.lit(False))


def blocking_keys(dates: Column, city: Column, lat: Column, lon: Column, confidence: Column) -> Column:
    """'dc|date|city' and 'dg|date|cell' of every date, in order, each once."""
    own = F.transform(dates, lambda d: F.filter(F.array(
        F.when(F.coalesce(city, F.lit("")) != "", F.concat(F.lit("dc|"), d["date"], F.lit("|"), city)),
        F.when(trusted_position(lat, lon, confidence), F.concat(F.lit("dg|"), d["date"], F.lit("|"), geo_grid_key(lat, lon))),
    ), lambda k: k.isNotNull()))
    return F.array_distinct(F.flatten(F.coalesce(own, F.array().cast("array<array<string>>"))))


def day_range(first: Column, last: Column) -> Column:
    """Days from first to last; none if either is no date or they run backwards."""
    a, b = F.try_to_date(first), F.try_to_date(last)
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<date>"))


def time_factor(a: Column, b: Column, config: dict = DEFAULTS) -> Column:
    """1 for times that are missing or near, less the farther apart they are."""
    return gap_factor(seconds(a), seconds(b), config)


def gap_factor(a: Column, b: Column, config: dict = DEFAULTS) -> Column:
    """``time_factor`` of times in seconds."""
    c = config["date"]
    gap = F.abs(a - b) / 60.0
    return (
        F.when(gap.isNull() | (gap <= c["time_tolerance_minutes"]), 1.0).when(gap <= c["time_close_minutes"], float(c["close_factor"]))
        .when(gap <= c["time_gap_penalty_hours"] * 60, float(c["far_factor"])).otherwise(float(c["time_gap_penalty_factor"]))
    )


def date_score(a: Column, b: Column, config: dict = DEFAULTS) -> Column:
    """Jaccard share of common dates times the mean time factor on them.

    The first entry of a date gives its time; 0 without a common date.
    """
    return start_score(starts(a), starts(b), config)


def starts(dates: Column) -> Column:
    """(date, start) of each distinct date, with the seconds of its first entry."""
    days = F.array_distinct(F.filter(F.transform(dates, lambda d: d["date"]), lambda d: d.isNotNull()))
    first = lambda day: F.try_element_at(F.filter(dates, lambda d: d["date"] == day), F.lit(1))["start_time"]
    return F.transform(days, lambda day: F.struct(day.alias("date"), seconds(first(day)).alias("start")))


def start_score(a: Column, b: Column, config: dict = DEFAULTS) -> Column:
    """``date_score`` of what ``starts`` makes of the dates; listings of one date each, as most are, take no loops."""
    x, y = F.try_element_at(a, F.lit(1)), F.try_element_at(b, F.lit(1))
    single = F.when(x["date"] == y["date"], gap_factor(x["start"], y["start"], config)).otherwise(0.0)
    shared, either = F.array_intersect(a["date"], b["date"]), F.array_union(a["date"], b["date"])
    first = lambda z, day: F.try_element_at(F.filter(z, lambda d: d["date"] == day), F.lit(1))["start"]
    factors = F.transform(shared, lambda day: gap_factor(first(a, day), first(b, day), config))
    mean = F.aggregate(factors, F.lit(0.0), lambda s, x: s + x) / F.size(shared)
    many = F.when(F.coalesce(F.size(shared), F.lit(0)) > 0, F.size(shared) / F.size(either) * mean).otherwise(0.0)
    return F.when((F.size(a) == 1) & (F.size(b) == 1), single).otherwise(many)


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    h = F.least(h, F.lit(1.0))
    return 6371.0 * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def geo_score(a: Column, b: Column, config: dict = DEFAULTS, venue: Column | None = None) -> Column:
    """Linear decay of the distance; neutral where a position is missing or doubtful.

    ``venue`` is a factor for places close to each other (1 if not given).
    """
    c = config["geo"]
    missing = a["geo_latitude"].isNull() | a["geo_longitude"].isNull() | b["geo_latitude"].isNull() | b["geo_longitude"].isNull()
    equal = (F.abs(a["geo_latitude"] - b["geo_latitude"]) < 1e-6) & (F.abs(a["geo_longitude"] - b["geo_longitude"]) < 1e-6)
    doubtful = F.coalesce(a["geo_confidence"] < c["min_confidence"], F.lit(False)) | F.coalesce(b["geo_confidence"] < c["min_confidence"], F.lit(False))
    km = haversine_km(a["geo_latitude"], a["geo_longitude"], b["geo_latitude"], b["geo_longitude"])
    near = F.greatest(F.lit(0.0), 1 - km / c["max_distance_km"])
    if venue is not None:
        near = near * F.when(km < c["venue_match_distance_km"], venue).otherwise(1.0)
    return F.when(missing | (~equal & doubtful), float(c["neutral_score"])).otherwise(near)


def venue_factor(a: Column, b: Column, config: dict = DEFAULTS) -> Column:
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    alike = token_sort_ratio(F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))) >= 50
    return F.when(blank | alike, 1.0).otherwise(float(config["geo"]["venue_mismatch_factor"]))


def title_score(a: Column, b: Column, config: dict = DEFAULTS) -> Column:
    """Token-sort ratio, blended with the token-set ratio in a middle band."""
    one, two = casefolded(stripped(F.coalesce(a["title"], F.lit("")))), casefolded(stripped(F.coalesce(b["title"], F.lit(""))))
    both = token_ratios(one, two)
    sort, sets = both["sort"] / 100, both["set"] / 100

    def blend(c: dict) -> Column:
        return F.when(sort.between(c["blend_lower"], c["blend_upper"]), c["primary_weight"] * sort + c["secondary_weight"] * sets).otherwise(sort)

    score, cross = blend(config["title"]), config["title"].get("cross_source_type")
    if cross:
        kinds = ("artikel", "terminliste")
        score = F.when((a["source_type"] != b["source_type"]) & a["source_type"].isin(*kinds) & b["source_type"].isin(*kinds), blend(cross)).otherwise(score)
    return F.when((one == "") | (two == ""), 0.0).otherwise(score)


def description_score(a: Column, b: Column) -> Column:
    """Token-sort ratio of the descriptions (else the short ones); 0.5 with neither, 0.4 with one."""
    text = lambda x: F.coalesce(F.nullif(x["description"], F.lit("")), F.nullif(x["short_description"], F.lit("")))
    one, two = text(a), text(b)
    return F.when(one.isNull() & two.isNull(), 0.5).when(one.isNull() | two.isNull(), 0.4).otherwise(token_sort_ratio(one, two) / 100)


def weights(a: Column, b: Column, config: dict = DEFAULTS) -> dict[str, Column]:
    """Weight of each signal: that of the first priority category both share, else the default."""
    shared = F.array_intersect(a["categories"], b["categories"])
    out = {}
    for signal, default in config["scoring"].items():
        chain = F.lit(float(default))
        for category in reversed(config["category_weights"]["priority"]):
            if category in config["category_weights"]["overrides"]:
                chain = F.when(F.coalesce(F.array_contains(shared, category), F.lit(False)), float(config["category_weights"]["overrides"][category][signal])).otherwise(chain)
        out[signal] = chain
    return out


def combined(signals: dict[str, Column], by: dict[str, Column]) -> Column:
    """Weighted mean of the signals; 0 if the weights sum to 0."""
    total = by["date"] + by["geo"] + by["title"] + by["description"]
    weighted = sum((signals[s] * by[s] for s in ("geo", "title", "description")), signals["date"] * by["date"])
    return F.when(total > 0, weighted / total).otherwise(0.0)


def decide(score: Column, title: Column, config: dict = DEFAULTS) -> Column:
    """match, no_match or ambiguous; a low title score keeps a high score from matching."""
    t = config["thresholds"]
    vetoed = (title < t["title_veto"]) if t["title_veto"] else F.lit(False)
    return F.when((score >= t["high"]) & vetoed, "ambiguous").when(score >= t["high"], "match").when(score <= t["low"], "no_match").otherwise("ambiguous")
