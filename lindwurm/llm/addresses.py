"""Address records that denote the same place.

Each distinct address is read into the tokens of a venue name (the kind of
venue first, as it is spelt) and of a street with a house number, whichever
fields they were written in. Within a municipality, pairs of forms are proposed
that have a proper word in common but for what an alignment forgives: both meet
on what is left of the word's beginning when as many letters are struck out as
it may have edits (MinHash banding can propose besides). An affine-gap
alignment of their whole token lists, whose substitution costs know
abbreviations, cut-off words and slips, verifies them. Every form then takes
the place of the commonest form it leads to, and the venue ties together
records that give only a name with those that give only a street.
"""

from __future__ import annotations

import itertools
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lindwurm.llm.canonical import combination_of_event, municipalities
from lindwurm.llm.edits import as_codes, letter_counts, osa
from lindwurm.llm.folding import folded, one_row, squeezed
from lindwurm.runtime import Scratch

# Kinds of venues and how they are abbreviated.
KINDS = """kino kurhaus naturzentrum kapelle scheune festhalle weingut museum sporthalle schloss freilichtbuehne waldheim gemeindesaal jugendhaus
kulturkeller pfarrheim atelier vereinsheim mehrzweckhalle zehntscheuer hofladen feuerwehrhaus grundschule schuetzenhaus bibliothek brauerei
seniorenzentrum gasthaus stadthalle buergerhaus kirche rathaus turnhalle gemeindehaus pfarrsaal kindergarten schwimmbad theater galerie""".split()
SHORT = {
    "gs": "grundschule", "gh": "gasthaus", "gasthof": "gasthaus", "mzh": "mehrzweckhalle", "fwhaus": "feuerwehrhaus", "feuerwehrgeraetehaus": "feuerwehrhaus",
    "buecherei": "bibliothek", "bibl": "bibliothek", "gemsaal": "gemeindesaal", "senzentrum": "seniorenzentrum", "jz": "jugendhaus", "jugendzentrum": "jugendhaus",
    "schuetzenh": "schuetzenhaus", "weing": "weingut", "sh": "stadthalle", "fh": "festhalle",
}
# Endings of streets and how they are abbreviated.
LANE_ENDINGS = "strasse str weg gasse allee platz ring graben ufer halde hof steig".split()
SHORT_ENDINGS = {"str": "strasse", "pl": "platz", "al": "allee"}
ASIDES = {"eg", "og", "ug", "foyer", "nebenraum", "hintereingang", "vordereingang", "ortsmitte", "innenhof", "saal", "eingang"}
NUMBER = re.compile(r"^(?:#|nr\.?|no\.?|hausnr\.?)?\s*(\d+)\s*([a-z]?)\s*(?:[-–/]\s*(\d+)\s*([a-z]?))?\s*\.?$")
AT_END = re.compile(r"^(.*?[^\d\s])[\s,]+((?:#|nr\.?|no\.?)?\s*\d+\s?[a-z]?(?:\s?[-–/]\s?\d+\s?[a-z]?)?\.?)$")
#: MinHash bands and rows that suit names within a municipality.
NAME_BANDS, NAME_ROWS = 12, 2
#: Letters of a word's beginning that its keys are made from. Any number finds the same; more give more keys and fewer chance meetings.
BEGINNING = 8
#: Proper words of a block up to which all pairs are aligned; a word has about twice as many keys.
PAIRED_TEXTS = 16
#: Costs of a gap in an alignment and up to which two forms are one: a gap of two tokens is within it, or one and a slip.
OPENING, EXTENDING, LIMIT = 0.28, 0.1, 0.42


@lru_cache(50_000)
def house_number(text: str | None) -> str:
    """A house number with its letter, or range, in one spelling; '' if there is none."""
    found = NUMBER.match((text or "").strip())
    if not found:
        return ""
    a, b, c, d = found.groups()
    return a.lstrip("0") + b + (f"-{c}{d}" if c else "")


def _words(text: str) -> str:
    """Figures inside words read as letters."""
    if "0" not in text and "1" not in text:
        return text
    return re.sub(r"[a-z01]{4,}", lambda m: m.group().replace("0", "o").replace("1", "l") if len(re.sub(r"\d", "", m.group())) >= 3 else m.group(), text)


def _bigrams(word: str) -> set[str]:
    return {word[i : i + 2] for i in range(len(word) - 1)}


KIND_BIGRAMS = {k: _bigrams(k) for k in KINDS}
KIND_LETTERS = letter_counts(KINDS)


@lru_cache(100_000)
def _kind(word: str) -> tuple[str, float]:
    """The kind of venue a word stands for, and how far it is from it."""
    bare = word.replace("-", "").replace(".", "")
    if bare in KINDS:
        return bare, 0
    if bare in SHORT:
        return SHORT[bare], 0.1
    if word.endswith(".") and len(bare) >= 3:
        for k in KINDS:
            if k.startswith(bare):
                return k, 0.2
    if len(bare) >= 3:
        # an edit touches three pairs of letters and two letter counts at most
        most, own = 1 if len(bare) < 7 else 2, _bigrams(bare)
        changed = np.abs(KIND_LETTERS - letter_counts([bare])).sum(1)
        near = [KINDS[i] for i in np.flatnonzero(changed <= 2 * most) if len(KIND_BIGRAMS[KINDS[i]] & own) >= len(KIND_BIGRAMS[KINDS[i]]) - 3 * most and abs(len(KINDS[i]) - len(bare)) <= most]
        away = osa([bare] * len(near), near)
        if len(near) and away.min() <= most:
            return near[int(away.argmin())], float(away.min())
        if word.endswith(".") and len(bare) >= 5:
            heads = [k for k in KINDS if len(k) > len(bare)]
            away = osa([bare] * len(heads), [k[: len(bare)] for k in heads])
            if len(heads) and away.min() <= 1:
                return heads[int(away.argmin())], 1.2
    return "", 9


@lru_cache(200_000)
def venue(name: str) -> tuple[str, str]:
    """(kind, proper words) of a folded venue name, both as they are spelt; words are parted by blanks."""
    text = _words(name)
    if "(" in text:
        text = re.sub(r"\([^)]*\)?", " ", text)
    if ":" in text:
        text = re.sub(r"^[^:]*:\s*", "", text)
    text = re.split(r"\s[–—-]\s|,", text)[0]
    text = re.sub(r"^\s*saal (im|in der|in)\s+", "", text)
    text = re.sub(r"\be\.?\s?v\.?\s*$|\b(saal|raum)\s*\d*\s*$|\b(kath|ev|evang)\b\.?", " ", text)
    text = re.sub(r"\b(fw|gem\.|sen\.)-", lambda m: m.group(1).rstrip("."), text)
    hyphen = "-" in text
    words = re.findall(r"[a-z]+\.?", text)
    if not words:
        return "", ""
    off, at = min((_kind(w)[1], i) for i, w in enumerate(words))
    if off > 8:
        return "", " ".join(words)
    rest = [w for i, w in enumerate(words) if i != at]
    if at > 0 and not hyphen and rest[at - 1].endswith("er") and len(rest[at - 1]) > 6:
        rest[at - 1] = rest[at - 1][:-2]  # the adjective of a proper name
    return words[at], " ".join(rest)


@lru_cache(200_000)
def street(text: str) -> tuple[str, str]:
    """(words of the street, house number) of one folded piece; a bare ending is joined to the word before it."""
    text = (re.sub(r"\([^)]*\)?", " ", text) if "(" in text else text).strip()
    text = re.sub(r"\s+(?:ecke [a-z]+|hintereingang|innenhof)(?=\s+\d|$)", "", text).strip()
    number = ""
    if found := AT_END.match(text):
        text, number = found.group(1), house_number(found.group(2))
    words: list[str] = []
    for word in _words(text).split():
        cut = "." if word.endswith(".") else ""
        word = re.sub(r"[^a-z]", "", word)
        if words and word in LANE_ENDINGS:
            words[-1] = words[-1].rstrip(".") + word + cut
        elif word:
            words.append(word + cut)
    return " ".join(words), number


@lru_cache(200_000)
def _pieces(road: str) -> tuple[tuple[str, ...], str]:
    """The pieces of a street field that may be a street or a venue, and the house number that stands alone in it."""
    own, pieces = "", []
    for piece in re.sub(r"\([^)]*\)?", " ", road).split(","):
        piece = re.sub(r"^(?:ecke [a-z]+|hintereingang|vordereingang|innenhof|ortsmitte)\s+(?=\S*\d)", "", piece.strip())
        if NUMBER.match(piece):
            own = own or house_number(piece)
        elif piece and re.sub(r"[\s\d.]", "", piece) not in ASIDES and not piece.startswith("ecke "):
            pieces.append(piece)
    return tuple(pieces), own


def parts(name: str | None, road: str | None, number: str | None) -> tuple[str, str, str, str]:
    """(kind, proper words, street, house number) from folded fields."""
    pieces, alone = _pieces(road or "")
    own, lane = house_number(number) or alone, ""
    blank = not (name or "").strip()
    if pieces:
        lane, found = street(pieces[-1])
        own = own or found
        if len(pieces) > 1 and blank:
            name = pieces[0]
        elif blank and not found and not own and _kind(pieces[-1].split()[0])[1] < 2 and len(pieces[-1].split()) > 1:
            name, lane = pieces[-1], ""
    kind, proper = venue(name or "")
    return kind, proper, lane, own


def shingles(text: str) -> set[int]:
    """Hashes of the words of a text and of their padded bigrams."""
    found = set()
    for word in text.split():
        padded = f"^{word}$"
        found |= {ord(a) * 131 + ord(b) for a, b in zip(padded, padded[1:])}
        found.add(zlib.crc32(word.encode("utf-8", "surrogatepass")) >> 1)
    return found


def signatures(texts: list[str], bands: int, rows: int) -> np.ndarray:
    """MinHash bands of the token and q-gram shingles of each text, one row per text."""
    random = np.random.default_rng(11)
    prime = (1 << 31) - 1
    a, b = random.integers(1, prime, bands * rows), random.integers(0, prime, bands * rows)
    sets = [list(shingles(t)) or [0] for t in texts]
    if not sets:
        return np.empty((0, bands), np.int64)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = np.fromiter((x for s in sets for x in s), np.int64)
    key = np.zeros((len(texts), bands), np.int64)
    for r in range(rows):
        least = np.stack([np.minimum.reduceat((a[k] * flat + b[k]) % prime, starts) for k in range(r, bands * rows, rows)], 1)
        key = key * 1_000_003 + least
    return key * 64 + np.arange(bands)


def _spelled_out(word: str) -> str:
    """A token without its period, abbreviations of kinds and street endings written out."""
    bare = word.rstrip(".")
    if bare in SHORT:
        return SHORT[bare]
    for short, full in SHORT_ENDINGS.items():
        if bare.endswith(short) and len(bare) > len(short) + 3:
            return bare[: -len(short)] + full
    return bare


def swap_costs(words: list[str], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """What it costs to read one word as another; pairs are given by their numbers in ``words``.

    Nothing for itself, little for its abbreviation (dictionary) or the word it
    was cut from, its share of edits for a slip, and 1.5 for another word. A
    word that begins with a figure is another one unless it is equal.
    """
    full = [_spelled_out(w) for w in words]
    sizes = np.array([len(w) for w in full], int)
    short = np.array([f != w.rstrip(".") for f, w in zip(full, words)], bool)
    cut = np.array([w.endswith(".") for w in words], bool)
    figure = np.array([w[:1].isdigit() for w in words], bool)
    counts = letter_counts(full).astype(np.int16)
    size = np.minimum(sizes[first], sizes[second])
    allowed = np.select([size < 4, size < 7], [0, 1], 2)
    # an edit changes two letter counts at most, so no pair within reach is left out
    near = np.flatnonzero((np.abs(sizes[first] - sizes[second]) <= allowed) & (np.abs(counts[first] - counts[second]).sum(1) <= 2 * allowed))
    out = np.full(len(first), 1.5)
    edits = osa([full[k] for k in first[near]], [full[k] for k in second[near]])
    good = edits <= allowed[near]
    out[near[good]] = edits[good] / np.maximum(size[near[good]], 1) + np.where(short[first] | short[second], 0.1, 0.0)[near[good]]
    maybe: tuple[list, list, list] = ([], [], [])
    heads = [w.rstrip(".") for w in words]
    for k in np.flatnonzero((cut[first] | cut[second]) & (out > 0.2)):
        for x, y in ((int(first[k]), int(second[k])), (int(second[k]), int(first[k]))):
            if cut[x] and full[y].startswith(heads[x]):
                out[k] = 0.2
            elif cut[x] and len(heads[x]) >= 6:
                for own, value in zip(maybe, (k, heads[x], full[y][: len(heads[x])])):
                    own.append(value)
    if maybe[0]:
        out[np.array(maybe[0])[osa(maybe[1], maybe[2]) <= 1]] = 0.2
    out[figure[first] | figure[second]] = 9.0
    out[first == second] = 0.0
    return out


def aligned(first: list[tuple[str, ...]], second: list[tuple[str, ...]], opening: float = OPENING, extending: float = EXTENDING) -> np.ndarray:
    """Cost of the cheapest affine-gap alignment of the tokens of each pair.

    Substitutions cost what ``swap_costs`` says, a gap ``opening`` plus
    ``extending`` for each further token. Pairs of equal shape are aligned
    together, cell by cell, and each pair of words is rated once.
    """
    ids: dict[str, int] = {}
    shapes: dict[tuple[int, int], list[int]] = {}
    left = [[ids.setdefault(w, len(ids)) for w in p] for p in first]
    right = [[ids.setdefault(w, len(ids)) for w in q] for q in second]
    for k, (p, q) in enumerate(zip(left, right)):
        shapes.setdefault((len(p), len(q)), []).append(k)
    words, out, far = list(ids), np.empty(len(first)), 99.0
    for (m, n), members in shapes.items():
        if m and n:
            a, b = np.array([left[k] for k in members], np.int64), np.array([right[k] for k in members], np.int64)
            pairs, back = np.unique(a[:, :, None] * len(words) + b[:, None, :], return_inverse=True)
            costs = swap_costs(words, pairs // len(words), pairs % len(words))[back].reshape(len(members), m, n)
        cell = lambda v: np.full(len(members), float(v))
        # per cell: last tokens aligned, gap in the second, gap in the first
        above = [(cell(0), cell(far), cell(far))]
        for j in range(n):
            above.append((cell(far), cell(far), cell(opening + j * extending)))
        for i in range(m):
            row = [(cell(far), cell(opening + i * extending), cell(far))]
            for j in range(n):
                over, before, corner = above[j + 1], row[j], above[j]
                row.append((
                    np.minimum(np.minimum(corner[0], corner[1]), corner[2]) + costs[:, i, j],
                    np.minimum(np.minimum(over[0], over[2]) + opening, over[1] + extending),
                    np.minimum(np.minimum(before[0], before[1]) + opening, before[2] + extending),
                ))
            above = row
        out[members] = np.minimum(np.minimum(above[-1][0], above[-1][1]), above[-1][2])
    return out


#: A token cut off so early, or so unlike what it stands for, that what it was cut from has no key of its spelt-out form.
CUT_SHORT = re.compile("(?:^|(?<= ))(?:[^ ]{0,%d}|%s)[.]+(?= |$)" % (BEGINNING - 1, "|".join(k for k, v in SHORT.items() if len(k) >= BEGINNING and not v.startswith(k))))


def _struck(words: list[str], letters: int, edits: int) -> np.ndarray:
    """Numbers for what is left of the first ``letters`` letters without any ``edits`` of them, one row per word.

    Words within that many edits, or with such beginnings, share one: what both
    keep of each other has ``letters - edits`` letters or, filled up, blanks.
    """
    codes = as_codes([w[:letters].ljust(letters, "\0") for w in words])[0].astype(np.uint64)
    out = []
    for kept in itertools.combinations(range(letters), letters - edits):
        key = np.full(len(words), letters * 8 + edits, np.uint64)
        for c in kept:
            key = (key ^ codes[:, c]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out.append(key)
    return np.stack(out, 1)


def meeting_keys(texts: list[str], cut: list[bool]) -> list[np.ndarray]:
    """Keys on which every two texts meet that align within the limit; the last two bits are 0, or 1 for a cut token, which meets 2.

    Such an alignment has at least one token in the place of another, as
    gaps on both sides cost more. ``cut`` says for which texts those keys are
    wanted by which a token cut off early meets the words it may begin.
    """
    jobs: dict[tuple[int, int, int], tuple[list[int], list[str]]] = {}

    def add(owner: int, word: str, letters: int, edits: int, role: int) -> None:
        owners, words = jobs.setdefault((letters, edits, role), ([], []))
        owners.append(owner), words.append(word)

    for owner, (text, heads) in enumerate(zip(texts, cut)):
        for token in dict.fromkeys(text.split()):
            full = _spelled_out(token)
            # as swap_costs allows: the shorter of two words decides
            for edits in [0] if len(full) < 4 else [1] if len(full) < 7 else [1, 2] if len(full) == 7 else [2]:
                add(owner, full, BEGINNING, edits, 0)
            if heads:
                for letters in range(min(len(full), 5) + 1):
                    add(owner, full, letters, 0, 2)
                for letters in (6, 7):
                    add(owner, full, letters, 1, 2)
                if CUT_SHORT.fullmatch(token):
                    head = token.rstrip(".")
                    add(owner, head, min(len(head), 7), int(len(head) >= 6), 1)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for (letters, edits, role), (owners, words) in jobs.items():
        for owner, row in zip(owners, (_struck(words, letters, edits) << np.uint64(2) | np.uint64(role)).view(np.int64)):
            found[owner].append(row)
    return [np.unique(np.concatenate(rows)) if rows else np.empty(0, np.int64) for rows in found]


def representatives(forms: DataFrame, scratch: Scratch, bands: int = 0, rows: int = 1, limit: float = LIMIT, paired_texts: int = PAIRED_TEXTS) -> DataFrame:
    """(block, form, rep) with the commonest form that each form leads to.

    ``forms`` has block, form (tokens parted by blanks), key (its proper words)
    and n, the records that use it. Keys of a block that align within the limit
    are candidates, as are forms of one key; of those whose whole token lists
    align within it each form follows the commonest, up to one that follows
    none. ``rep`` is an id. Up to LIMIT no pair of keys is missed; ``bands`` of
    MinHash ``rows`` propose besides, which a higher limit needs. Blocks of up
    to ``paired_texts`` keys are compared pair by pair, with the same result.
    """
    own = scratch.put(forms.select("block", "form", "key", "n", F.xxhash64("block", "form").alias("no"), F.xxhash64("block", "key").alias("text")))

    @F.pandas_udf("array<bigint>")
    def proposed(text: pd.Series, cut: pd.Series) -> pd.Series:
        found = meeting_keys(text.tolist(), cut.tolist())
        if bands:
            found = [np.concatenate([x, y << 2]) for x, y in zip(found, signatures(text.tolist(), bands, rows))]
        return pd.Series(found, dtype=object)

    def close(first: pd.Series, second: pd.Series) -> np.ndarray:
        # each pair once, as the forms of two keys bring the keys again
        once: dict[tuple[str, str], int] = {}
        at = [once.setdefault(pair, len(once)) for pair in zip(first, second)]
        return (aligned([tuple(p.split()) for p, _ in once], [tuple(q.split()) for _, q in once]) <= limit)[at]

    @F.pandas_udf(BooleanType())
    def within(form: pd.Series, other: pd.Series, key: pd.Series, other_key: pd.Series) -> pd.Series:
        good = (key == other_key).to_numpy(bool)
        good[~good] = close(key[~good], other_key[~good])
        left = good & ((form != key) | (other != other_key) | (key == other_key)).to_numpy(bool)
        good[left] = close(form[left], other[left])
        return pd.Series(good)

    # blocks of one key need no keys; in those of a few, all pairs are fewer than keys
    texts = own.groupBy("block", "key", "text").agg(F.count(F.lit(1)).alias("forms"))
    many = texts.groupBy("block").agg(F.count(F.lit(1)).alias("texts"), F.max(F.regexp_like("key", F.lit(CUT_SHORT.pattern))).alias("cut")).where("texts > 1")
    few = texts.join(many.where(F.col("texts") <= paired_texts), "block").select("block", "text")
    paired = few.alias("a").join(few.alias("b"), "block").where("a.text < b.text").select(F.col("a.text").alias("x"), F.col("b.text").alias("y"))
    keyed = texts.join(many.where(F.col("texts") > paired_texts), "block").select("block", "text", F.explode(proposed("key", "cut")).alias("band"))
    keyed = keyed.select(F.xxhash64("block", F.shiftright("band", 2)).alias("bucket"), "text", F.col("band").bitwiseAND(3).cast("byte").alias("role"))
    # asked in a way that is not pushed down, so that both sides are one shuffle
    meet = F.element_at(F.array(F.col("a.role") * 4 + F.col("b.role"), F.lit(0)), 1)
    # the estimate takes a text's keys for one row, so the engine might broadcast them all
    met = keyed.alias("a").join(keyed.alias("b").hint("merge"), "bucket").where((meet == 0) & (F.col("a.text") < F.col("b.text")) | (meet == 6) & (F.col("a.text") != F.col("b.text")))
    met = met.select(F.least("a.text", "b.text").alias("x"), F.greatest("a.text", "b.text").alias("y")).distinct()
    met = met.unionByName(paired).unionByName(texts.where("forms > 1").select(F.col("text").alias("x"), F.col("text").alias("y")))
    left = own.select(F.col("text").alias("x"), F.col("no").alias("f"), F.col("form").alias("f_form"), F.col("key").alias("f_key"), F.col("n").alias("f_n"))
    right = own.select(F.col("text").alias("y"), F.col("no").alias("g"), F.col("form").alias("g_form"), F.col("key").alias("g_key"), F.col("n").alias("g_n"))
    pairs = met.join(left, "x").join(right, "y").where("x <> y or f < g")
    good = pairs.where(within("f_form", "g_form", "f_key", "g_key")).select("f", "f_n", "g", "g_n")
    # each pair leads from the rarer to the commoner form
    lower = (F.col("f_n") < F.col("g_n")) | (F.col("f_n") == F.col("g_n")) & (F.col("f") < F.col("g"))
    steps = good.select(F.when(lower, F.col("f")).otherwise(F.col("g")).alias("no"), F.when(lower, F.struct(F.col("g_n").alias("n"), F.col("g").alias("to"))).otherwise(F.struct(F.col("f_n").alias("n"), F.col("f").alias("to"))).alias("step"))
    roots = scratch.put(steps.groupBy("no").agg(F.max("step").alias("step")).select("no", F.col("step.to").alias("to")))
    while True:  # the commonest form of the commonest form: numbers rise along every way, so the ways end
        jumped = scratch.put(roots.alias("r").join(roots.select(F.col("no").alias("to"), F.col("to").alias("next")), "to", "left").select("r.no", F.coalesce("next", "r.to").alias("to"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(roots)
        roots, open_ = jumped, not jumped.where("moved").isEmpty()
        if not open_:
            break
    scratch.settle()
    return own.join(roots.select("no", "to"), "no", "left").select("block", "form", F.coalesce("to", "no").alias("rep"))


def places_of(events: DataFrame, reference: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, muni, place, stem, lane, number, raw) of every event with a municipality.

    ``place`` is null where an address says too little. ``stem`` is the longest
    proper word of the venue, ``lane`` the street's letters, ``raw`` a hash of
    the four address fields as delivered. Of an id that was delivered again
    the row of the smallest file counts.
    """
    fields = ["location_name", "location_street", "location_street_no", "location_zipcode"]

    @F.pandas_udf("struct<form:string,key:string,lane:string,number:string>")
    def read(name: pd.Series, road: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = []
        for x in zip(name, road, number):
            kind, proper, lane, own = parts(*x)
            out.append((f"{kind} {proper}".strip(), proper, lane, own))
        return pd.DataFrame(out, columns=["form", "key", "lane", "number"], dtype=object)

    # read before any shuffle, so that only short columns travel
    own = events.where("id is not null").select(
        "id", "file_ingestion_id", combination_of_event().alias("combo"),
        F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(f)), F.lit("")) for f in fields]).alias("raw"),
        read(*[folded(squeezed(F.col(f))) for f in fields[:3]]).alias("p"),
    ).select("id", "file_ingestion_id", "raw", "combo", "p.*")
    # ids hardly come again within a part, so nothing is sorted there
    told = scratch.put(one_row(own.repartition("id"), "id", "file_ingestion_id").join(municipalities(events, reference, scratch), "combo", "left").drop("combo"))
    scratch.settle()
    known = told.where("muni is not null")
    names = known.where("key <> ''").groupBy(F.col("muni").alias("block"), "form", "key").agg(F.count(F.lit(1)).alias("n"))
    lanes = known.where("lane <> '' and number <> ''").groupBy(F.concat_ws("|", "muni", "number").alias("block"), F.col("lane").alias("form"), F.col("lane").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    by_name = representatives(names, scratch).select(F.xxhash64("block", "form").alias("name_no"), F.col("rep").alias("name_rep"))
    by_lane = representatives(lanes, scratch).select(F.xxhash64("block", "form").alias("lane_no"), F.col("rep").alias("lane_rep"))
    # forms are looked up by their numbers, and only what is asked for later travels
    stem = F.aggregate(F.split("key", " "), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    short = told.select(
        "id", "muni", "number", "raw", F.replace(stem, F.lit("."), F.lit("")).alias("stem"), F.regexp_replace("lane", " ", "").alias("lane"),
        F.when(F.col("muni").isNotNull() & (F.col("form") != ""), F.xxhash64("muni", "form")).alias("name_no"),
        F.when(F.col("muni").isNotNull() & (F.col("lane") != "") & (F.col("number") != ""), F.xxhash64(F.concat_ws("|", "muni", "number"), "lane")).alias("lane_no"),
    )
    tied = scratch.put(short.join(by_name, "name_no", "left").join(by_lane, "lane_no", "left").drop("name_no", "lane_no"))
    scratch.drop(told)
    scratch.settle()
    usual = (
        tied.where("name_rep is not null and lane_rep is not null").groupBy("name_rep", "lane_rep", "number").count()
        .groupBy("name_rep").agg(F.max_by(F.struct("lane_rep", "number"), F.struct("count", "lane_rep")).alias("usual"))
    )
    named = tied.join(usual, "name_rep", "left")
    agrees = (F.col("number") == "") | (F.col("number") == F.col("usual.number"))
    place = F.when(agrees & F.col("usual").isNotNull(), F.col("usual.lane_rep")).otherwise(F.coalesce("lane_rep", F.when(F.col("number") == "", F.col("name_rep"))))
    return named.select("id", "muni", place.alias("place"), "stem", "lane", "number", "raw")


def memberships(events: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, place_id): one row per id with a place; ``place_id`` is the smallest id there."""
    scratch = Scratch(events.sparkSession, "memberships")
    own = scratch.put(places_of(events, reference, scratch).where("place is not null").select("id", "place"))
    return own.join(own.groupBy("place").agg(F.min("id").alias("place_id")), "place").select("id", "place_id")


def same_places(events: DataFrame, reference: DataFrame) -> DataFrame:
    """(id_a, id_b), the smaller first, of ids that give one place in different ways.

    At least one of the four address fields differs, null counting as a value;
    ids whose fields are all equal are no pair. Another house number, letter
    included, is another place. ``memberships`` says the same without pairs.
    """
    scratch = Scratch(events.sparkSession, "addresses")
    own = scratch.put(places_of(events, reference, scratch).where("place is not null").select("id", "place", "raw"))
    pairs = own.alias("a").join(own.alias("b"), "place").where("a.id < b.id and a.raw <> b.raw")
    return pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
