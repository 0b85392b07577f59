"""Points near other points, and points in regions.

Positions become three-dimensional unit vectors, so that a distance on the
sphere is a chord and neither the poles nor the date line need a special case.
The space is cut into cells by k-d splits fitted on a bounded sample of the
points; every ball or outline is copied to each cell it may touch (its halo),
so one shuffle by cell brings together all that can meet. A cell that holds
many equal positions cannot be split further and is salted instead; where very
many balls or outlines meet a cell they are split into parts, for each of which
its points are copied. Inside a
cell, balls query a local k-d tree by chord radius and outlines are answered by
a plane sweep over their edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
#: Rows of the sample the splits are fitted on; they only steer balance.
SPLIT_SAMPLE_ROWS = 20_000
#: Rows a cell should hold; a cell is one task's unit of memory.
CELL_ROWS = 20_000
LEAF = 16


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def chord(metres: np.ndarray | float) -> np.ndarray | float:
    """Chord of a great-circle distance; 2 (everything) beyond half the globe."""
    return 2 * np.sin(np.minimum(np.asarray(metres, float) / EARTH_RADIUS_M, math.pi) / 2)


class KdSplits:
    """Axis splits as arrays: node i has axis, value, children, or a cell number."""

    def __init__(self, sample: np.ndarray, rows: float, cell_rows: int):
        self.axis, self.value, self.left, self.right, self.cell = [], [], [], [], []
        self.salts: list[int] = []
        weight = rows / max(1, len(sample))
        self._grow(sample, weight, cell_rows)
        self.axis, self.value = np.array(self.axis), np.array(self.value)
        self.left, self.right, self.cell = np.array(self.left), np.array(self.right), np.array(self.cell)

    def _node(self) -> int:
        for column, empty in ((self.axis, -1), (self.value, 0.0), (self.left, -1), (self.right, -1), (self.cell, -1)):
            column.append(empty)
        return len(self.axis) - 1

    def _grow(self, points: np.ndarray, weight: float, cell_rows: int) -> int:
        node, rows = self._node(), len(points) * weight
        if rows > cell_rows and len(points) > 1:
            spread = points.max(0) - points.min(0)
            axis = int(spread.argmax())
            cut = float(np.median(points[:, axis]))
            below = points[:, axis] <= cut
            if below.all():  # the median is the largest value
                below = points[:, axis] < cut
                cut = float(points[below, axis].max()) if below.any() else cut
            if spread[axis] > 0 and 0 < below.sum() < len(points):
                self.axis[node], self.value[node] = axis, cut
                self.left[node] = self._grow(points[below], weight, cell_rows)
                self.right[node] = self._grow(points[~below], weight, cell_rows)
                return node
        self.cell[node] = len(self.salts)
        self.salts.append(max(1, math.ceil(rows / cell_rows)))
        return node

    def locate(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), int)
        inner = self.cell[at] < 0
        while inner.any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            low = points[rows, self.axis[node]] <= self.value[node]
            at[rows] = np.where(low, self.left[node], self.right[node])
            inner[rows] = self.cell[at[rows]] < 0
        return self.cell[at]

    def touched(self, centre: np.ndarray, radius: float) -> list[int]:
        """Cells a ball may reach into."""
        found, todo = [], [0]
        while todo:
            node = todo.pop()
            if self.cell[node] >= 0:
                found.append(int(self.cell[node]))
                continue
            offset = centre[self.axis[node]] - self.value[node]
            if offset <= radius:
                todo.append(self.left[node])
            if offset >= -radius:
                todo.append(self.right[node])
        return found


class LocalTree:
    """A k-d tree over the points of one cell, queried by chord radius."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple] = []
        if len(points):
            self._build(0, len(points))

    def _build(self, lo: int, hi: int) -> int:
        own = self.points[self.order[lo:hi]]
        low, high = own.min(0), own.max(0)
        number = len(self.nodes)
        self.nodes.append(())
        left = right = -1
        if hi - lo > LEAF and (high > low).any():
            axis, mid = int((high - low).argmax()), (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, axis], mid)]
            left, right = self._build(lo, lo + mid), self._build(lo + mid, hi)
        self.nodes[number] = (low, high, lo, hi, left, right)
        return number

    def within(self, centre: np.ndarray, radius: float) -> np.ndarray:
        if not self.nodes:
            return np.empty(0, int)
        found, todo, limit = [], [0], radius * radius
        while todo:
            low, high, lo, hi, left, right = self.nodes[todo.pop()]
            near = np.maximum(0, np.maximum(low - centre, centre - high))
            if near @ near > limit:
                continue
            far = np.maximum(np.abs(low - centre), np.abs(high - centre))
            if far @ far <= limit:
                found.append(self.order[lo:hi])
            elif left < 0:
                rows = self.order[lo:hi]
                gap = self.points[rows] - centre
                found.append(rows[np.einsum("ij,ij->i", gap, gap) <= limit])
            else:
                todo += [left, right]
        return np.concatenate(found) if found else np.empty(0, int)


def sweep_inside(lon: np.ndarray, lat: np.ndarray, by_lat: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Rows inside a ring (even-odd rule), by a sweep over rising latitude.

    ``by_lat`` holds the rows in order of latitude; the edges that start and
    end bound the run of points between two events, and each active edge flips
    the parity of the points to its left.
    """
    ring = ring[~np.isnan(ring).any(1)]
    if len(ring) < 3:
        return np.empty(0, int)
    x1, y1 = ring.T
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    keep = y1 != y2
    x1, y1, x2, y2 = x1[keep], y1[keep], x2[keep], y2[keep]
    if not len(x1):
        return np.empty(0, int)
    bottom, top = np.minimum(y1, y2), np.maximum(y1, y2)
    events = np.unique(np.concatenate([bottom, top]))
    at = np.searchsorted(lat[by_lat], events, "left")
    inside = []
    for k in range(len(events) - 1):
        rows = by_lat[at[k] : at[k + 1]]
        if not len(rows):
            continue
        active = np.flatnonzero((bottom <= events[k]) & (top >= events[k + 1]))
        slope = (x2[active] - x1[active]) / (y2[active] - y1[active])
        crossing = x1[active][:, None] + slope[:, None] * (lat[rows] - y1[active][:, None])
        odd = (crossing > lon[rows]).sum(0) % 2 == 1
        inside.append(rows[odd])
    return np.concatenate(inside) if inside else np.empty(0, int)


def fit_splits(points: DataFrame, lat: str, lon: str, cell_rows: int = CELL_ROWS) -> KdSplits:
    """Splits from at most ``SPLIT_SAMPLE_ROWS`` positions; every row is placed by them."""
    valid = points.where(_valid(lat, lon)).select(lat, lon)
    rows = valid.count()
    share = min(1.0, 0.8 * SPLIT_SAMPLE_ROWS / max(1, rows))
    sample = valid if share == 1.0 else valid.sample(share, seed=7)
    got = sample.limit(SPLIT_SAMPLE_ROWS).toPandas()
    return KdSplits(unit_vectors(got[lat].to_numpy(float), got[lon].to_numpy(float)), rows, cell_rows)


def _valid(lat: str, lon: str):
    return F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)


def _placed(points: DataFrame, splits: KdSplits, key: str, lat: str, lon: str, parts: dict[int, int]) -> DataFrame:
    """Each point with its cell and salt, once per part of the cell's regions."""

    @F.pandas_udf("struct<cell:int,salts:int,parts:int>")
    def cell_of(la: pd.Series, lo: pd.Series) -> pd.DataFrame:
        cells = splits.locate(unit_vectors(la.to_numpy(), lo.to_numpy()))
        return pd.DataFrame({"cell": cells.astype("int32"), "salts": np.asarray(splits.salts, "int32")[cells], "parts": np.array([parts.get(int(c), 1) for c in cells], "int32")})

    placed = points.where(_valid(lat, lon)).select(
        F.col(key).alias("p_key"), F.col(lat).cast("double").alias("p_lat"), F.col(lon).cast("double").alias("p_lon")
    )
    placed = placed.withColumn("at", cell_of("p_lat", "p_lon")).select("p_key", "p_lat", "p_lon", "at.*")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("p_key"), "salts").cast("int"))
    if not parts:
        return placed.drop("salts", "parts").withColumn("part", F.lit(0))
    return placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("salts", "parts")


def _parts(regions: DataFrame, splits: KdSplits, schema: str, cell_rows: int) -> dict[int, int]:
    """Into how many parts the regions of a cell are split, where there are more than ``cell_rows``; at most one entry a cell."""
    if regions.limit(cell_rows + 1).count() <= cell_rows:
        return {}
    dense = _halo(regions, splits, schema, {}).where("salt = 0").groupBy("cell").count().where(F.col("count") > cell_rows).collect()
    return {r["cell"]: math.ceil(r["count"] / cell_rows) for r in dense}


def _halo(regions: DataFrame, splits: KdSplits, schema: str, parts: dict[int, int]) -> DataFrame:
    """Copies of each ball for every cell and salt it may meet, in one part of the cell. Columns: r_key, lat, lon, reach, ..."""

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            centres = unit_vectors(batch["lat"].to_numpy(float), batch["lon"].to_numpy(float))
            rows, cells, salts = [], [], []
            for i, (centre, reach) in enumerate(zip(centres, batch["reach"])):
                for cell in splits.touched(centre, float(reach) + 1e-9):
                    for salt in range(splits.salts[cell]):
                        rows.append(i), cells.append(cell), salts.append(salt)
            out = batch.iloc[rows].copy()
            out["cell"], out["salt"] = np.array(cells, "int32"), np.array(salts, "int32")
            out["parts"] = np.array([parts.get(c, 1) for c in cells], "int32")
            yield out

    copied = regions.mapInPandas(copies, schema + ", cell int, salt int, parts int")
    return copied.withColumn("part", F.pmod(F.xxhash64("r_key"), "parts").cast("int")).drop("parts")


def within_distance(points: DataFrame, centres: DataFrame, *, key: str, lat: str, lon: str, centre_key: str, centre_lat: str, centre_lon: str, radius_m: str, cell_rows: int = CELL_ROWS, splits: KdSplits | None = None) -> DataFrame:
    """(point key, centre key) for each point at most the centre's radius away.

    ``centres`` may be any table, also the points themselves; rows of either
    side whose position is null, NaN or off the globe meet nothing, as do null
    or negative radii. The result is distinct; empty inputs give an empty one.
    """
    splits = splits or fit_splits(points, lat, lon, cell_rows)
    key_type = dict(points.dtypes)[key]
    centre_type = dict(centres.dtypes)[centre_key]
    balls = (
        centres.where(_valid(centre_lat, centre_lon) & (F.col(radius_m) >= 0) & ~F.isnan(F.col(radius_m).cast("double")))
        .select(F.col(centre_key).alias("r_key"), F.col(centre_lat).cast("double").alias("lat"), F.col(centre_lon).cast("double").alias("lon"),
                (2 * F.sin(F.least(F.col(radius_m) / EARTH_RADIUS_M, F.lit(math.pi)) / 2)).alias("reach"))
    )
    shape = f"r_key {centre_type}, lat double, lon double, reach double"
    parts = _parts(balls, splits, shape, cell_rows)
    copied = _halo(balls, splits, shape, parts)

    def meet(own: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(regions):
            return _met(own["p_key"], regions["r_key"], [])
        tree = LocalTree(unit_vectors(own["p_lat"].to_numpy(), own["p_lon"].to_numpy()))
        centre = unit_vectors(regions["lat"].to_numpy(), regions["lon"].to_numpy())
        hits = [tree.within(c, r) for c, r in zip(centre, regions["reach"])]
        return _met(own["p_key"], regions["r_key"], hits)

    return _cogrouped(_placed(points, splits, key, lat, lon, parts), copied, meet, key_type, centre_type, key, centre_key)


def inside_outlines(points: DataFrame, outlines: DataFrame, *, key: str, lat: str, lon: str, outline_key: str, ring: str, cell_rows: int = CELL_ROWS, splits: KdSplits | None = None) -> DataFrame:
    """(point key, outline key) for each point inside an outline.

    ``ring`` is an array of structs with ``lon`` and ``lat``, open or closed,
    in either direction; rings of fewer than three corners hold nothing.
    Invalid positions meet nothing; the result is distinct.
    """
    splits = splits or fit_splits(points, lat, lon, cell_rows)
    key_type = dict(points.dtypes)[key]
    outline_type = dict(outlines.dtypes)[outline_key]
    rings = outlines.where(F.size(ring) >= 3).select(F.col(outline_key).alias("r_key"), F.col(ring + ".lon").alias("lons"), F.col(ring + ".lat").alias("lats"))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lat_mid, lon_mid, reach = [], [], []
            for lons, lats in zip(batch["lons"], batch["lats"]):
                lo, la = np.asarray(lons, float), np.asarray(lats, float)
                west, east, south, north = np.nanmin(lo), np.nanmax(lo), np.nanmin(la), np.nanmax(la)
                lat_mid.append((south + north) / 2), lon_mid.append((west + east) / 2)
                if east - west > 90 or north - south > 90:
                    reach.append(2.0)
                    continue
                edge = np.linspace(0, 1, 9)
                grid = unit_vectors(np.repeat(south + (north - south) * edge, 9), np.tile(west + (east - west) * edge, 9))
                middle = unit_vectors(np.array(lat_mid[-1:]), np.array(lon_mid[-1:]))[0]
                reach.append(float(np.sqrt(((grid - middle) ** 2).sum(1).max())) * 1.05 + 1e-6)
            yield batch.assign(lat=lat_mid, lon=lon_mid, reach=reach)[["r_key", "lat", "lon", "reach", "lons", "lats"]]

    shape = f"r_key {outline_type}, lat double, lon double, reach double, lons array<double>, lats array<double>"
    bounded = rings.mapInPandas(bound, shape)
    parts = _parts(bounded, splits, shape, cell_rows)
    copied = _halo(bounded, splits, shape, parts)

    def meet(own: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(regions):
            return _met(own["p_key"], regions["r_key"], [])
        la, lo = own["p_lat"].to_numpy(), own["p_lon"].to_numpy()
        by_lat = np.argsort(la, kind="stable")
        hits = [sweep_inside(lo, la, by_lat, np.column_stack([np.asarray(x, float), np.asarray(y, float)])) for x, y in zip(regions["lons"], regions["lats"])]
        return _met(own["p_key"], regions["r_key"], hits)

    return _cogrouped(_placed(points, splits, key, lat, lon, parts), copied, meet, key_type, outline_type, key, outline_key)


def _met(keys: pd.Series, regions: pd.Series, hits: list[np.ndarray]) -> pd.DataFrame:
    """(p_key, r_key) of the rows each region hit."""
    rows = np.concatenate(hits) if hits else np.empty(0, int)
    own = keys.to_numpy(dtype=object)[rows]
    theirs = np.repeat(regions.to_numpy(dtype=object)[: len(hits)], [len(h) for h in hits])
    return pd.DataFrame({"p_key": pd.Series(own, dtype=object), "r_key": pd.Series(theirs, dtype=object)})


def _cogrouped(placed: DataFrame, copied: DataFrame, meet, key_type: str, region_type: str, key: str, region_key: str) -> DataFrame:
    found = placed.groupBy("cell", "salt", "part").cogroup(copied.groupBy("cell", "salt", "part")).applyInPandas(meet, f"p_key {key_type}, r_key {region_type}")
    return found.distinct().select(F.col("p_key").alias(key), F.col("r_key").alias(region_key))


def zones_of_points(points: DataFrame, zones: DataFrame, *, key: str = "id", lat: str = "geo_latitude", lon: str = "geo_longitude", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(key, zone_id) for every zone, circle or outline, that holds a position."""
    points = points.select(key, lat, lon).distinct()
    splits = fit_splits(points, lat, lon, cell_rows)
    circles = within_distance(points, zones.where(F.col("kind") == "circle"), key=key, lat=lat, lon=lon, centre_key="zone_id", centre_lat="centre_lat", centre_lon="centre_lon", radius_m="radius_m", splits=splits)
    rings = inside_outlines(points, zones.where(F.col("kind") == "polygon"), key=key, lat=lat, lon=lon, outline_key="zone_id", ring="ring", splits=splits)
    return circles.unionByName(rings).distinct()


def neighbours(points: DataFrame, metres: float, *, lat: str = "geo_latitude", lon: str = "geo_longitude", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(lat, lon, rows, near): per distinct valid position the rows there and the rows at other positions within a distance.

    Rows of one position are counted before anything meets, so many of them
    stay one point.
    """
    placed = points.where(_valid(lat, lon)).groupBy(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).agg(F.count(F.lit(1)).alias("rows"))
    placed = placed.withColumn("at", F.struct("lat", "lon", "rows")).withColumn("reach_m", F.lit(float(metres)))
    met = within_distance(placed, placed.withColumnsRenamed({"at": "other", "lat": "y", "lon": "x"}), key="at", lat="lat", lon="lon", centre_key="other", centre_lat="y", centre_lon="x", radius_m="reach_m", cell_rows=cell_rows)
    return met.groupBy("at").agg(F.sum(F.when(F.col("at") == F.col("other"), 0).otherwise(F.col("other.rows"))).alias("near")).select("at.lat", "at.lon", "at.rows", "near")
