"""Mapping freely entered place values to a reference list.

Token-level repair: each distinct token of the values is joined to the
vocabulary of the reference list by edit distance (cut-off words by prefix),
and the repaired tokens are combined by soft TF-IDF to rank complete entries.
What the other fields of a row say (postcode, the other place field, position)
then decides between entries, or that none is meant.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindwurm.llm.edits import kept_keys, osa, piece_key, sought_keys
from lindwurm.llm.folding import digits_to_letters, folded, squeezed, zip5
from lindwurm.runtime import Scratch

#: Distance up to which a token is joined to a vocabulary entry.
MAX_EDITS = 3
#: Accuracy of the middle position of a combination: a rank is off by at most one in so many rows.
MIDDLE_ACCURACY = 1000
#: Letters of a cut-off word from which one of them may be wrong.
CUT_SLIP_FROM = 5
#: Listed places that may be sent to the workers for the decision (far above the municipalities and districts of a country).
MAX_PLACES = 200_000
# Words around a name that don't belong to it.
NOISE = ["stadt", "gemeinde", "raum", "naehe", "nahe", "region", "ortsteil", "ot", "stadtteil", "markt", "bei", "kreis", "landkreis", "lkr", "d", "de"]
ARTICLES = ["am", "an", "der", "im", "a", "d", "i", "in"]


def tokens_of(value: Column) -> Column:
    """Distinct folded tokens of a place value; a cut-off word keeps its period."""
    text = digits_to_letters(folded(squeezed(value)))
    text = F.regexp_replace(text, r"\(kreis [^)]*\)", " ")
    text = F.regexp_replace(text, r"\b(d\s*-\s*)?\d{5}\b", " ")
    text = F.regexp_replace(text, r"\bst\.\s*", "sankt ")
    words = F.split(F.regexp_replace(text, r"[^a-z0-9.]+", " "), " ")
    words = F.transform(words, lambda w: F.when(F.regexp_like(w, F.lit(r"^[^.]{4,}\.$")), w).otherwise(F.replace(w, F.lit("."), F.lit(""))))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 0) & ~w.isin(NOISE)))


def reach_of(length: int, most: int = MAX_EDITS) -> int:
    """Edits within which a token of a length is joined."""
    return min(most, 0 if length < 4 else 1 if length < 7 else 2 if length < 9 else most)


def _cut_keys(head: str) -> list[int]:
    """Keys of a beginning: its halves, or all of it where no letter may be wrong."""
    length = len(head)
    if length < CUT_SLIP_FROM:
        return [piece_key(head, 9, length)]
    half = length // 2
    swapped = head[: half - 1] + head[half], head[half - 1] + head[half + 1 :]
    return [piece_key(head[:half], 9, length, 0), piece_key(head[half:], 9, length, 1), piece_key(swapped[0], 9, length, 0), piece_key(swapped[1], 9, length, 1)]


def repair(tokens: DataFrame, vocabulary: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(token, word, edits, cut) of each distinct token and the entries within reach.

    ``edits`` counts changes and swaps; up to 1 for words of 4 to 6 letters, 2
    to 8 and ``max_edits`` beyond; shorter words must be equal. A token that
    ends in a period also joins the words it begins, with ``cut`` set, from
    five letters on with one of them wrong. Words and tokens meet in a join on
    segments that no word within reach can avoid, so a vocabulary of any size
    gives the same rows.
    """
    reach = partial(reach_of, most=max_edits)

    def keyed(how, heads: bool) -> Column:
        # two arrays of numbers leave a worker much sooner than one of structs
        @F.pandas_udf("struct<whole:array<bigint>,cut:array<bigint>>")
        def keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                whole, cut = [], []
                for text in batch:
                    bare = text.rstrip(".")
                    whole.append(np.array(how(bare), np.int64))
                    if heads:  # of a word, all beginnings
                        found = [k for n in range(1, len(bare)) for k in _cut_keys(bare[:n])[:2]]
                    else:
                        found = _cut_keys(bare) if text.endswith(".") else []
                    cut.append(np.array(found, np.int64))
                yield pd.DataFrame({"whole": pd.Series(whole, dtype=object), "cut": pd.Series(cut, dtype=object)})

        return keys

    def parted(rows: DataFrame, name: str, key: Column) -> DataFrame:
        both = rows.select(name, key.alias("k")).select(name, F.explode(F.array(*[F.struct(F.col(f"k.{c}").alias("keys"), F.lit(c == "cut").alias("cut")) for c in ("whole", "cut")])).alias("k"))
        return both.select(name, F.explode("k.keys").alias("key"), "k.cut")

    words = vocabulary.select("word").where("word <> ''").distinct()
    kept = parted(words, "word", keyed(partial(kept_keys, reach=reach, most=max_edits), True)("word"))
    sought = parted(tokens, "token", keyed(partial(sought_keys, reach=reach), False)("token"))
    # the estimate takes a word's keys for one row, so the engine might broadcast them all
    pairs = sought.join(kept.hint("merge"), ["key", "cut"]).select("token", "word", "cut").distinct()

    @F.pandas_udf("int")
    def distance(token: pd.Series, word: pd.Series, cut: pd.Series) -> pd.Series:
        bare = [t.rstrip(".") for t in token]
        return pd.Series(osa(bare, [w[: len(t)] if c else w for t, w, c in zip(bare, word, cut)]), dtype="int32")

    size = F.length(F.rtrim("token", F.lit(".")))
    whole = F.least(F.when(size < 4, 0).when(size < 7, 1).when(size < 9, 2).otherwise(max_edits), F.lit(max_edits))
    limit = F.when(F.col("cut"), F.when(size < CUT_SLIP_FROM, 0).otherwise(1)).otherwise(whole)
    return pairs.withColumn("edits", distance("token", "word", "cut")).where(F.col("edits") <= limit).select("token", "word", "edits", "cut")


def rank_entries(values: DataFrame, entries: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(value, candidates) with the entries whose main word a value's token repairs to.

    ``values`` has a column ``value``; ``entries`` has ``entry`` and ``name``
    (several rows per entry are its aliases). A candidate is a struct of entry,
    score (soft TF-IDF), edits of the main word, cut, and rest: how many of the
    value's own tokens the entry leaves unexplained.
    """
    named = entries.select("entry", "name", tokens_of(F.col("name")).alias("words")).where(F.size("words") > 0)
    words = named.select("entry", "name", F.explode("words").alias("word"))
    total = named.count()
    weights = words.groupBy("word").agg((F.log(F.lit(float(total))) - F.log(F.count(F.lit(1)).cast("double")) + 0.5).alias("weight"))
    postings = words.join(weights, "word")
    norms = postings.groupBy("entry", "name").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.max_by("word", F.struct("weight", F.length("word"), "word")).alias("main"))
    postings = postings.join(norms, ["entry", "name"])
    split = values.select("value", tokens_of(F.col("value")).alias("tokens")).where(F.size("tokens") > 0)
    each = split.select("value", F.size(F.filter("tokens", lambda t: ~t.isin(ARTICLES))).alias("own"), F.explode("tokens").alias("token"))
    repaired = repair(each.select("token").distinct(), weights.select("word"), max_edits)
    near = repaired.withColumn("likeness", F.when(F.col("cut"), 0.9 - 0.1 * F.col("edits")).otherwise(1 - F.col("edits") / F.greatest(F.length("word"), F.lit(1))))
    hits = each.join(near, "token").join(postings, "word")
    hits = hits.groupBy("value", "own", "entry", "name", "norm", "main", "word").agg(F.max_by(F.struct("token", "edits", "cut", "likeness", "weight"), F.struct("likeness", "token")).alias("best"))
    scored = (
        hits.groupBy("value", "own", "entry", "name", "norm", "main")
        .agg(
            F.sum(F.col("best.likeness") * F.col("best.weight") * F.col("best.weight")).alias("dot"),
            F.count_if(~F.col("best.token").isin(ARTICLES)).alias("explained"),
            F.max(F.when(F.col("word") == F.col("main"), F.struct("best.edits", "best.cut"))).alias("at_main"),
        )
        .where("at_main is not null")
        .withColumn("score", F.col("dot") / (F.col("norm") * F.col("norm")))
    )
    return scored.groupBy("value").agg(
        F.collect_list(F.struct("entry", "name", F.round("score", 6).alias("score"), F.col("at_main.edits").alias("edits"), F.col("at_main.cut").alias("cut"), (F.col("own") - F.col("explained")).alias("rest"))).alias("candidates")
    )


class Decider:
    """Decides, from the candidates and the other fields, which entry is meant."""

    def __init__(self, places: list[dict]):
        self.cities = {p["place_id"]: p for p in places if p["kind"] == "city"}
        self.districts = {p["place_id"]: p for p in places if p["kind"] == "district"}
        self.by_name = {p["name"]: i for i, p in self.cities.items()}
        self.by_zip: dict[str, list[int]] = {}
        for i, p in self.cities.items():
            for z in p["zipcodes"] or ():
                self.by_zip.setdefault(z, []).append(i)
        for i, p in self.districts.items():
            for z in p["zipcodes"] or ():
                if p["parent_place_id"] not in self.by_zip.setdefault(z, []):
                    self.by_zip[z].append(p["parent_place_id"])
        self.zips: dict[int, set[str]] = {i: set() for i in self.cities}
        for z, own in self.by_zip.items():
            for i in own:
                self.zips.get(i, set()).add(z)
        self.of_city: dict[int, dict[str, int]] = {}
        for i, p in self.districts.items():
            self.of_city.setdefault(p["parent_place_id"], {})[p["name"]] = i

    def zip_says(self, city: int, code: str) -> int:
        """2 it agrees, 1 it may be a slip, 0 there is none, -1 it speaks against."""
        if not code:
            return 0
        own = self.zips[city]
        if code in own:
            return 2
        if any(sum(a != b for a, b in zip(code, z)) <= 1 for z in own) and code not in self.by_zip:
            return 1
        return -1

    def _nearest(self, ids: list[int], lat: float, lon: float) -> int | None:
        placed = [(self._gap(i, lat, lon), i) for i in ids]
        placed = [x for x in placed if x[0] is not None]
        return min(placed)[1] if placed else None

    def _gap(self, i: int, lat: float, lon: float) -> float | None:
        p = self.cities.get(i) or self.districts[i]
        if lat is None or lon is None or lat != lat or lon != lon or p["centre_lat"] is None or p["centre_lon"] is None:
            return None
        return math.hypot((p["centre_lat"] - lat) * 111.2, (p["centre_lon"] - lon) * 111.2 * math.cos(math.radians(lat)))

    def city(self, value: str | None, candidates, code: str, lat: float, lon: float) -> int:
        if value is None:
            return -1
        if value in self.by_name:
            return self.by_name[value]
        own, parts = [], []
        for c in candidates if candidates is not None else ():
            i, edits, cut = c["entry"], c["edits"], c["cut"]
            if i in self.cities:
                says = self.zip_says(i, code)
                length = len(c["name"])
                if cut:
                    good = says >= 0
                elif edits == 0:
                    good = True
                elif edits == 1:
                    # a namesake outside the list has a postcode of its own, which the list doesn't know
                    good = length > 5 and (says >= 0 or code in self.by_zip)
                elif edits == 2:
                    good = says >= 0
                else:
                    good = says == 2
                if good:
                    own.append(((-c["rest"], says, round(c["score"], 3), -edits), i))
            elif i in self.districts and c["rest"] <= 0 and (cut or edits <= 2):
                parent = self.districts[i]["parent_place_id"]
                says = self.zip_says(parent, code)
                if says >= 0 and (edits < 2 and not cut or says > 0):
                    parts.append(((says, round(c["score"], 3), -edits), i))
        if own:
            best = max(k for k, _ in own)
            ids = [i for k, i in own if k == best]
            first = max(own, key=lambda x: (x[0][1] > 0, x[0]))
            if first[0][1] > 0 and (best[1] <= 0 or first[0][0] >= best[0]):
                ids = [i for k, i in own if k == first[0]]
            if len(set(ids)) == 1:
                return ids[0]
            return self._nearest(ids, lat, lon) or min(ids)
        if parts:
            best = max(k for k, _ in parts)
            ids = sorted({self.districts[i]["parent_place_id"] for k, i in parts if k == best})
            if len(ids) == 1:
                return ids[0]
            near = self._nearest(ids, lat, lon)
            return near if near is not None else -1
        return -1

    def municipality(self, city: int, value: str | None, district_candidates, code: str, lat: float, lon: float) -> int:
        """The municipality of an event, also where the city field does not tell."""
        if city >= 0:
            return city
        if len(self.by_zip.get(code, ())) == 1:
            return self.by_zip[code][0]
        for c in district_candidates if district_candidates is not None else ():
            if c["entry"] in self.cities and c["edits"] <= 1 and not c["cut"] and self.zip_says(c["entry"], code) >= 0:
                return c["entry"]
        if not code and not (value or "").strip("  \t"):
            near = self._nearest(list(self.cities), lat, lon)
            if near is not None and self._gap(near, lat, lon) <= 5:
                return near
        return -1

    def district(self, municipality: int, value: str | None, candidates, code: str) -> int:
        if value is None:
            return -1
        own = self.of_city.get(municipality, {})
        if value in own:
            return own[value]
        best = None
        ids = set(own.values())
        for c in candidates if candidates is not None else ():
            if c["entry"] in ids and (c["cut"] or c["edits"] <= (2 if len(c["name"]) > 6 else 1) or c["edits"] == 3 and len(c["name"]) > 9):
                key = (round(c["score"], 3), -c["edits"], -c["entry"])
                best = max(best, (key, c["entry"])) if best else (key, c["entry"])
        return best[1] if best else -1


def place_rows(places: DataFrame) -> list[dict]:
    """The reference list on the driver; its size is checked."""
    rows = places.select("place_id", "name", "kind", "parent_place_id", "zipcodes", "centre_lat", "centre_lon").limit(MAX_PLACES + 1).collect()
    if len(rows) > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} listed places")
    return [r.asDict() for r in rows]


def entries_of(places: DataFrame) -> DataFrame:
    """(entry, name) of every name and alias."""
    return places.where(F.col("name").isNotNull()).select(F.col("place_id").alias("entry"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))


def resolve_places(events: DataFrame, places: DataFrame, *, city: str = "location_city", district: str = "location_district", zipcode: str = "location_zipcode", lat: str = "geo_latitude", lon: str = "geo_longitude") -> DataFrame:
    """(city, district, code, spot, city_id, district_id, municipality) per distinct combination.

    -1 where none is meant. ``municipality`` is told by the postcode, the
    district or the position where the city field is empty or says nothing.
    Rows without city and postcode are told apart by their position (``spot``).
    """
    spark = events.sparkSession
    sent = spark.sparkContext.broadcast(Decider(place_rows(places)))
    keyed = combination(events, city, district, zipcode, lat, lon)
    middle = lambda c: F.percentile_approx(c, 0.5, MIDDLE_ACCURACY).alias(c)
    combos = keyed.groupBy("city", "district", "code", "spot").agg(middle("glat"), middle("glon"))
    values = keyed.select(F.explode(F.array("city", "district")).alias("value")).where("value is not null").distinct()
    ranked = rank_entries(values, entries_of(places))
    joined = (
        combos.join(ranked.select(F.col("value").alias("city"), F.col("candidates").alias("city_candidates")), "city", "left")
        .join(ranked.select(F.col("value").alias("district"), F.col("candidates").alias("district_candidates")), "district", "left")
    )

    @F.pandas_udf("struct<city_id:int,district_id:int,municipality:int>")
    def decide(city: pd.Series, district: pd.Series, code: pd.Series, glat: pd.Series, glon: pd.Series, cc: pd.Series, dc: pd.Series) -> pd.DataFrame:
        d = sent.value
        out = []
        for c, v, z, la, lo, own, parts in zip(city, district, code, glat, glon, cc, dc):
            i = d.city(c, own, z, la, lo)
            m = d.municipality(i, c, parts, z, la, lo)
            out.append((i, d.district(m, v, parts, z), m))
        return pd.DataFrame(out, columns=["city_id", "district_id", "municipality"])

    decided = joined.withColumn("ids", decide("city", "district", "code", "glat", "glon", "city_candidates", "district_candidates"))
    return decided.select("city", "district", "code", "spot", F.col("ids.city_id").alias("city_id"), F.col("ids.district_id").alias("district_id"), F.col("ids.municipality").alias("municipality"))


def spot_of(city: Column, code: Column, lat: Column, lon: Column) -> Column:
    """A square of about a kilometre where neither city nor postcode is given, else ''."""
    bare = (squeezed(F.coalesce(city, F.lit(""))) == "") & (code == "")
    return F.when(bare & lat.isNotNull() & lon.isNotNull(), F.concat_ws(",", F.round(lat, 2), F.round(lon, 2))).otherwise("")


def _usable(lat: str, lon: str) -> Column:
    return F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & (F.abs(F.col(lat)) + F.abs(F.col(lon)) > 1)


def combination(events: DataFrame, city: str, district: str, zipcode: str, lat: str, lon: str, *keep: str) -> DataFrame:
    """The columns places are decided by."""
    code, usable = zip5(F.col(zipcode)), _usable(lat, lon)
    glat, glon = F.when(usable, F.col(lat)), F.when(usable, F.col(lon))
    return events.select(
        *keep, F.col(city).alias("city"), F.col(district).alias("district"), code.alias("code"), spot_of(F.col(city), code, glat, glon).alias("spot"), glat.alias("glat"), glon.alias("glon")
    )


def combination_of_event() -> Column:
    """The combination key of a source event."""
    code, usable = zip5(F.col("location_zipcode")), _usable("geo_latitude", "geo_longitude")
    spot = spot_of(F.col("location_city"), code, F.when(usable, F.col("geo_latitude")), F.when(usable, F.col("geo_longitude")))
    return combination_key(F.col("location_city"), F.col("location_district"), code, spot)


def map_places(events: DataFrame, places: DataFrame) -> DataFrame:
    """(id, field, place_id) of every place value that is not exactly a listed name.

    Fields 'city' and 'district'; null and blank values give no row, values
    that stand for nothing in the list give -1. Rows are distinct.
    """
    keyed = combination(events, "location_city", "location_district", "location_zipcode", "geo_latitude", "geo_longitude", "id").select("id", "city", "district", "code", "spot").distinct()
    listed = places.where("kind in ('city', 'district')").select("kind", "name").distinct()
    resolved = resolve_places(events, places)
    both = keyed.alias("k").join(resolved.alias("r"), F.col("k.city").eqNullSafe(F.col("r.city")) & F.col("k.district").eqNullSafe(F.col("r.district")) & (F.col("k.code") == F.col("r.code")) & (F.col("k.spot") == F.col("r.spot")))
    rows = both.select("id", F.explode(F.array(
        F.struct(F.lit("city").alias("field"), F.col("k.city").alias("value"), F.col("city_id").alias("place_id")),
        F.struct(F.lit("district").alias("field"), F.col("k.district").alias("value"), F.col("district_id").alias("place_id")),
    )).alias("x")).select("id", "x.*")
    rows = rows.where(F.col("value").isNotNull() & (squeezed(F.col("value")) != ""))
    free = rows.join(listed.select(F.col("kind").alias("field"), F.col("name").alias("value")), ["field", "value"], "left_anti")
    return free.select("id", "field", "place_id").distinct()


def combination_key(city: Column, district: Column, code: Column, spot: Column) -> Column:
    """One number for a combination of place fields, null told from empty."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.xxhash64(told(city), told(district), told(code), spot)


def municipalities(events: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """(combo, muni): one text per municipality, listed or not, by combination key.

    Municipalities outside the list are named by the spelling most common for
    their postcode. Null where neither field nor position says anything.
    """
    resolved = scratch.put(resolve_places(events, places))
    scratch.settle()
    keyed = combination(events, "location_city", "location_district", "location_zipcode", "geo_latitude", "geo_longitude")
    open_ = resolved.where("municipality < 0").select("city", "code").distinct()
    same = F.col("n.city").eqNullSafe(F.col("u.city")) & (F.col("n.code") == F.col("u.code"))
    spelt = F.array_join(tokens_of(F.coalesce("city", F.lit(""))), " ")
    counted = keyed.groupBy("city", "code").count().alias("n").join(open_.alias("u"), same, "left_semi").withColumn("spelt", spelt).where("code <> ''")
    # no filter on what is spelt: it would be pushed down to every row read
    usual = counted.groupBy("code", "spelt").agg(F.sum("count").alias("n")).groupBy("code").agg(F.max_by("spelt", F.when(F.col("spelt") != "", F.struct("n", "spelt"))).alias("usual"))
    return resolved.join(usual, "code", "left").select(
        combination_key(F.col("city"), F.col("district"), F.col("code"), F.col("spot")).alias("combo"),
        F.when(F.col("municipality") >= 0, F.concat(F.lit("c"), F.col("municipality").cast("string"))).otherwise(F.concat(F.lit("u"), F.coalesce(F.col("usual"), F.nullif(spelt, F.lit(""))))).alias("muni"),
    )
