"""Best representative of each duplicate group, field by field.

The fields of the linked records are unpivoted to long rows of (group, field,
record, value). Each record votes for its normalised value with the trust in
its source times the decay of its age times the quality of the value it holds
(damage, additions, cut ends, slips that the rest of the group contradicts, how
much it says, its confidence). The value with the most votes wins by ``max_by``
per group and field, so a group of any size is aggregated, never collected,
and pivots back to one row per group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

from lindwurm.llm.edits import osa
from lindwurm.llm.folding import folded, folded_text, one_row, squeezed
from lindwurm.llm.history import EMPTY_TITLES, KINDS_ALONE, REMARKS, bare_title
from lindwurm.llm.listings import COUNTED_WORDS, MARKUP, plain
from lindwurm.runtime import Scratch

#: Days after which a record's vote counts half.
HALF_LIFE_DAYS = 180.0
#: What a vote counts for a value that says nothing, and for one that is damaged, added to or cut.
EMPTY_VOTE, DAMAGED_VOTE = 1e-12, 1e-6
#: A vote grows with this power of what its value says: one that says a tenth less counts a fifth.
AMOUNT_POWER = 16
#: A vote for a position grows e-fold with each 0.002 of its confidence.
CONFIDENCE_STEP = 0.002
#: A sentence is boilerplate if more than BOILERPLATE_ROWS and this share of the texts hold it.
BOILERPLATE_SHARE, BOILERPLATE_ROWS = 0.035, 12
#: Degrees around the centres of the places that still belong to their area.
AREA_MARGIN = 0.1
#: Words of a group up to which all are compared; more are joined by deletion signatures (LONG_WORD letters at most). Both find the same.
PAIRED_WORDS, LONG_WORD = 500, 32
# Marks of cut texts.
CUT = r"(…|\.\.\.|\[mehr\]|\(weiterlesen\)|mehr lesen|weiterlesen|»)\s*$"


def damaged(text: Column) -> Column:
    """Whether a text shows broken encoding, mark-up, odd blanks, odd case or a cut end."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return (
        F.regexp_like(text, F.lit(r"<[^>]*>|&[A-Za-z#0-9]{2,6}|Ã|Â|â[€\u0080-\u009f]|�|(?U)^\s|\s$|\s\s"))
        | F.regexp_like(text, F.lit(CUT))
        | (letters == F.upper(letters)) | (letters == F.lower(letters))
        | F.regexp_like(text, F.lit(r"\p{L}[01]\p{L}"))
        | ((F.length(text) - F.length(F.replace(text, F.lit("„"), F.lit("")))) != (F.length(text) - F.length(F.replace(text, F.lit("“"), F.lit("")))))
    )


def linked_events(events: DataFrame, links: DataFrame) -> DataFrame:
    """Events of canonical records with two or more distinct linked events. Column grp.

    Of an id that was delivered again the row of the smallest file counts.
    """
    pairs = links.where("canonical_event_id is not null and source_event_id is not null").select(F.col("canonical_event_id").alias("grp"), F.col("source_event_id").alias("id")).distinct()
    many = pairs.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("grp")
    fields = ["source_code", "title", "description", "location_city", "geo_latitude", "geo_longitude", "geo_confidence", "created_at"]
    own = pairs.join(many, "grp").join(events.select("id", "file_ingestion_id", *fields), "id")
    return own.groupBy("id", "grp").agg(F.min(F.struct("file_ingestion_id", *fields)).alias("x")).select("grp", "id", *[f"x.{f}" for f in fields])


def trusts(events: DataFrame) -> DataFrame:
    """(source_code, trust): the share of a source's titles that show no damage."""
    sound = F.when(F.col("title").isNotNull() & ~damaged(F.col("title")) & (F.col("title") != ""), 1.0).otherwise(0.0)
    return events.groupBy("source_code").agg((0.2 + 0.8 * F.avg(sound)).alias("trust"))


_TAGS, _BREAK, _MARKS = re.compile("<[^>]*>"), re.compile(r"(?<=[.!?…])\s+"), re.compile(r"[^\w.!?]+|_")
_DAMAGE = re.compile(r"<[^>]*>|&[A-Za-z#0-9]{2,6}|Ã|Â|â[€\u0080-\u009f]|\ufffd|^\s|\s$|\s\s|[^\W\d_][01][^\W\d_]|" + CUT)
_WHOLE, _LETTERS, _WORDS = re.compile(r"[.!?][”“\")]?$"), re.compile(r"[\W\d_]+"), re.compile("[a-z0-9]{5,}")


def sentence_keys(text: str) -> dict[int, int]:
    """The distinct complete sentences of a text as hashes of their letters, with their lengths."""
    found = {}
    for piece in _BREAK.split(_TAGS.sub(" ", text)):
        if len(piece) > 1:
            normal = _MARKS.sub("", piece.lower())
            if normal[-1:] in (".", "!", "?"):
                found[xxhash.xxh64_intdigest(normal.encode("utf-8", "surrogatepass")) - (1 << 63)] = len(normal)
    return found


def boilerplate(events: DataFrame) -> list[int]:
    """Hashes of sentences in too many texts to tell anything; at most (sentences per text) / BOILERPLATE_SHARE of them.

    Workers count while they read, so only counts are shuffled.
    """
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uses: Counter = Counter()
        for batch in batches:
            for text in batch["description"]:
                uses.update(sentence_keys(text).keys())
            if len(uses) > COUNTED_WORDS:
                yield pd.DataFrame({"sentence": list(uses), "uses": list(uses.values())})
                uses.clear()
        yield pd.DataFrame({"sentence": list(uses), "uses": list(uses.values())}, dtype="int64")

    texts = events.where("description is not null").select("description")
    often = texts.mapInPandas(counted, "sentence bigint, uses bigint").groupBy("sentence").agg(F.sum("uses").alias("uses"))
    return [r[0] for r in often.where(F.col("uses") > BOILERPLATE_ROWS + BOILERPLATE_SHARE * texts.count()).select("sentence").collect()]


def described(text: str, known: frozenset[int]) -> tuple[str, list[str], int, int, int, float]:
    """(normal, words, says, sound, whole, amount) of a description; ``known`` sentences tell nothing."""
    telling = {k: n for k, n in sentence_keys(text).items() if k not in known}
    letters = _LETTERS.sub("", text)
    sound = not (_DAMAGE.search(text) or letters == letters.upper() or letters == letters.lower() or text.count("„") != text.count("“"))
    low = folded_text(text)
    words = list(dict.fromkeys(_WORDS.findall(MARKUP.sub(" ", low) if "<" in low or "&" in low else low)))
    amount = sum(telling.values())
    return "|".join(map(str, sorted(telling))), words, int(amount > 0), int(sound), int(bool(_WHOLE.search(text.rstrip()))), float(amount)


@F.pandas_udf(ArrayType(LongType()))
def _signatures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Keys of which words within the slips' edits share one: what is left after up to two deletions, the beginning, and one for all long words."""
    def of(word: str) -> list[int]:
        found = {"^" + word[:5]} | ({"long"} if len(word) >= LONG_WORD - 2 else set())
        if len(word) <= LONG_WORD:
            once = {word[:i] + word[i + 1 :] for i in range(len(word))}
            found |= {word} | once | ({w[:i] + w[i + 1 :] for w in once for i in range(len(w))} if len(word) >= 7 else set())
        return [zlib.crc32(f.encode()) << 31 ^ zlib.adler32(f.encode()) for f in found]

    for batch in batches:
        yield pd.Series([of(w) for w in batch], dtype=object)


def _rivals(weak: DataFrame, strong: DataFrame, by: list[str]) -> DataFrame:
    """(grp, word, right) of words and the better used ones that they may be slips of."""
    met = weak.alias("w").join(strong.alias("s"), by).where(
        "w.word <> s.word and s.uses >= w.uses and (s.uses > w.uses or s.overall > w.overall) and w.overall <= greatest(2, s.overall / 10) and abs(length(w.word) - length(s.word)) <= 6"
    )
    # a swap is two plain edits
    met = met.where("(startswith(s.word, w.word) or (abs(length(w.word) - length(s.word)) <= 2 and levenshtein(w.word, s.word, 4) >= 0))")
    return met.select("grp", F.col("w.word").alias("word"), F.col("s.word").alias("right"))


def _slips(rows: DataFrame, scratch: Scratch, paired_words: int = PAIRED_WORDS) -> DataFrame:
    """(grp, id, field) of values with a word that the group spells otherwise.

    ``rows`` has grp, id, field, words. A word is a slip if a word of the same
    group that more records of it (or, where equal, of all groups) use is
    within two edits of it or goes on where it breaks off.
    """
    each = rows.select("grp", "id", "field", F.explode(F.array_distinct("words")).alias("word")).where(F.length("word") >= 5)
    each = scratch.put(each)
    inside = each.select("grp", "id", "word").distinct().groupBy("grp", "word").agg(F.count(F.lit(1)).alias("uses"))
    overall = inside.groupBy("word").agg(F.sum("uses").alias("overall"))
    told = scratch.put(inside.join(overall, "word"))
    # only a word that is rare beside its group's commonest can be a slip, and only of one used twice at least
    sized = told.join(told.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("overall").alias("top")), "grp")
    weak, strong = sized.where("overall <= greatest(2, top / 10)"), sized.where("overall >= 2")
    small = _rivals(weak.where(F.col("n") <= paired_words), strong.where(F.col("n") <= paired_words), ["grp"])
    signed = [side.where(F.col("n") > paired_words).withColumn("key", F.explode(_signatures("word"))) for side in (weak, strong)]
    pairs = small.unionByName(_rivals(*signed, ["grp", "key"])).distinct()

    @F.pandas_udf(BooleanType())
    def slipped(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for word, right in batches:
            edits = osa(word.tolist(), right.tolist())
            yield pd.Series([bool(e <= (1 if min(len(w), len(r)) < 7 else 2) or r.startswith(w) and len(r) - len(w) <= 6) for w, r, e in zip(word, right, edits)])

    wrong = pairs.where(slipped("word", "right")).select("grp", "word").distinct()
    return each.join(wrong, ["grp", "word"]).select("grp", "id", "field").distinct()


def ranked_values(events: DataFrame, links: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, field, id, raw, normal, weight, quality): the long rows; a vote is weight times quality."""
    own = scratch.put(linked_events(events, links).join(trusts(events), "source_code", "left"))
    newest = own.agg(F.max("created_at")).first()[0]
    age = F.greatest(F.lit(0.0), F.coalesce((F.unix_timestamp(F.lit(newest).cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 86400.0, F.lit(365.0)))
    own = own.withColumn("weight", F.coalesce("trust", F.lit(0.2)) * F.pow(F.lit(0.5), age / HALF_LIFE_DAYS))

    # titles
    titles = own.where(F.col("title").isNotNull() & (squeezed(F.col("title")) != ""))
    text = squeezed(plain(F.col("title")))
    ending = F.regexp_extract(text, r" in ([a-z .-]+)$", 1)
    towns = own.select(F.col("grp").alias("town_grp"), squeezed(folded(F.col("location_city"))).alias("town")).where("town <> ''").distinct()
    listed = places.where("kind = 'city'").select(squeezed(folded(F.col("name"))).alias("listed")).distinct()
    titles = titles.withColumn("text", text).withColumn("ending", ending).join(towns, (F.col("grp") == F.col("town_grp")) & (F.col("ending") == F.col("town")), "left").drop("town_grp").join(listed, F.col("ending") == F.col("listed"), "left")
    added = F.regexp_like("text", F.lit(REMARKS)) | F.regexp_like("text", F.lit(r"\([^)]*\)\s*$| am \d{1,2}\.\s?\d{1,2}\.?(\d{2,4})?$| um \d{1,2}([:.]\d{2})? uhr$")) | F.col("town").isNotNull() | F.col("listed").isNotNull()
    nothing = F.regexp_like("text", F.lit(EMPTY_TITLES)) | F.regexp_like(F.regexp_replace("text", r"\s*\([^)]*\)\s*$", ""), F.lit(KINDS_ALONE + "|" + EMPTY_TITLES))
    letters = F.regexp_extract_all("text", F.lit("([a-z0-9]{5,})"), F.lit(1))
    long_titles = titles.select(
        "grp", F.lit("title").alias("field"), "id", F.col("title").alias("raw"), bare_title(F.col("title")).alias("normal"), "weight", letters.alias("words"),
        (~nothing).cast("int").alias("says"), (~damaged(F.col("title"))).cast("int").alias("sound"), (~added).cast("int").alias("alone"), F.length("text").cast("double").alias("amount"),
    )

    # descriptions
    bodies = own.where(F.col("description").isNotNull() & (squeezed(F.col("description")) != ""))
    sent = events.sparkSession.sparkContext.broadcast(frozenset(boilerplate(events)))

    @F.pandas_udf("struct<normal:string,words:array<string>,says:int,sound:int,alone:int,amount:double>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            facts = list(zip(*[described(t, known) for t in batch])) or [()] * 6
            yield pd.DataFrame({n: pd.Series(v, dtype=k) for n, k, v in zip(("normal", "words", "says", "sound", "alone", "amount"), (object, object, "int32", "int32", "int32", "float64"), facts)})

    long_bodies = bodies.select("grp", F.lit("description").alias("field"), "id", F.col("description").alias("raw"), read("description").alias("x"), "weight").select(
        "grp", "field", "id", "raw", F.xxhash64("x.normal").cast("string").alias("normal"), "weight", "x.words", "x.says", "x.sound", "x.alone", "x.amount"
    )
    both = scratch.put(long_titles.unionByName(long_bodies))
    slips = _slips(both.select("grp", "id", "field", "words"), scratch).withColumn("slip", F.lit(1))
    clean = F.col("sound") * F.col("alone") * (1 - F.coalesce("slip", F.lit(0)))
    quality = F.when(F.col("says") == 1, 1.0).otherwise(EMPTY_VOTE) * F.when(clean == 1, 1.0).otherwise(DAMAGED_VOTE) * F.pow(F.col("amount") + 1, F.lit(float(AMOUNT_POWER)))
    worded = both.join(slips, ["grp", "id", "field"], "left").select("grp", "field", "id", "raw", "normal", "weight", quality.alias("quality"))

    # positions
    area = places.agg(F.min("centre_lat"), F.max("centre_lat"), F.min("centre_lon"), F.max("centre_lon")).first()
    if area[0] is None:
        return worded
    scale = F.when(F.col("geo_confidence") > 1, F.col("geo_confidence") / 100.0).otherwise(F.col("geo_confidence"))
    here = own.withColumn("scaled", scale).where(
        F.col("geo_latitude").between(area[0] - AREA_MARGIN, area[1] + AREA_MARGIN) & F.col("geo_longitude").between(area[2] - AREA_MARGIN, area[3] + AREA_MARGIN) & F.col("scaled").between(0, 1)
    )
    held = F.concat_ws(" ", F.round("geo_latitude", 6).cast("string"), F.round("geo_longitude", 6).cast("string"))
    return worded.unionByName(here.select("grp", F.lit("geo").alias("field"), "id", held.alias("raw"), held.alias("normal"), "weight", F.exp(F.col("scaled") / CONFIDENCE_STEP).alias("quality")))


def provenance(events: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """(canonical_event_id, field, source_event_id) of the records that supply the best values.

    Fields 'title', 'description' and 'geo'; a field that no linked event
    holds gives no row, nor does 'geo' where no complete position lies in the
    area of the places. Of several records with one value the smallest id.
    """
    scratch = Scratch(events.sparkSession, "survivors")
    votes = scratch.put(ranked_values(events, links, places, scratch))
    values = votes.groupBy("grp", "field", "normal", "raw").agg(F.sum(F.col("weight") * F.col("quality")).alias("votes"), F.max("quality").alias("quality"), F.min("id").alias("id"))
    # of the spellings of the chosen value the soundest, the briefest
    spelt = values.groupBy("grp", "field", "normal").agg(F.sum("votes").alias("votes"), F.max_by("id", F.struct("quality", -F.length("raw"), "raw")).alias("id"))
    chosen = spelt.groupBy("grp", "field").agg(F.min_by("id", F.struct(-F.col("votes"), "id")).alias("id"))
    return chosen.select(F.col("grp").alias("canonical_event_id"), "field", F.col("id").alias("source_event_id"))


def survivors(events: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """One row per group: the best title, description and position, and where they come from."""
    chosen = provenance(events, links, places).groupBy("canonical_event_id").pivot("field", ["title", "description", "geo"]).agg(F.first("source_event_id"))
    held = ["title", "description", "geo_latitude", "geo_longitude", "geo_confidence"]
    own = one_row(events.select("id", "file_ingestion_id", *held), "id", "file_ingestion_id")
    out = chosen.select("canonical_event_id", F.col("title").alias("title_from"), F.col("description").alias("description_from"), F.col("geo").alias("geo_from"))
    for field, columns in (("title", ["title"]), ("description", ["description"]), ("geo", ["geo_latitude", "geo_longitude", "geo_confidence"])):
        out = out.join(own.select(F.col("id").alias(f"{field}_from"), *columns), f"{field}_from", "left")
    return out
