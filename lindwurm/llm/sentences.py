"""Sentence boundaries across languages and scripts.

A pushdown automaton runs over each paragraph (a blank line always ends one).
A first pass pairs quotation marks and brackets on a stack, so that a mark
without a partner loses its meaning instead of swallowing the rest; a second
pass walks the terminators, with the depth of nesting at hand, and decides at
each one by what stands before it (abbreviation tries, ordinals, initials,
numbers, links) and by what follows (case, script, further closers). Scripts
without terminators are cut at their spaces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations, in lower case and without their last period.
#: They lead on to what follows and never end a sentence.
LEADING = """
dr prof hr fr frl fa fam ing dipl hptm lt st nr art abs abb bd s vgl ca rd max min. mind evtl ggf inkl exkl zzgl bzw sog geb gest tel
z.b z. d.h d. u. i.d i. d.r h. h.c a. a.d v.a o. o.g b.w z.t z.zt zz vs ev ehem verst str. mr mrs ms gen col capt sgt rev hon approx fig p pp no vol ch
e.g i.e cf mme mlle mm env égl egl av n art chap fig dott dott.ssa sig sig.ra sigg prof.ssa ing avv cap n. pag tel ca κ κα κκ περ αρ σελ τηλ د أ م डॉ श्री. प्रो
oct sept sep nov dec jan feb mar apr jun jul aug lic phil med rer nat habil mag op hg hrsg mt sr. jg
""".split()
#: They may stand inside or at the end; what follows decides.
TRAILING = """
usw etc ecc mo di mi do sa so u.ä u.a u.s.w s.u s.o a.m p.m jr sr std min sek km kg str pl jh jhd pers mio mrd og eg ug e.v g.mbh co kg inc ltd corp
κ.λπ κλπ κ.ά κ.α π.χ ά v.chr n.chr
""".split()
#: Months written as in English, where a day after them is no ordinal.
ENGLISH_MONTHS = set("january february march may june july october december jan feb mar apr jun jul aug sep sept oct nov dec".split())
TIMES_OF_DAY = {"a.m", "p.m", "am", "pm"}
THAI_MONTHS = "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม".split()
#: A word by which sentences begin; after a short number with a period it tells a new sentence from an ordinal.
STARTERS = set("""
der die das ein eine am an auf aus bei beim bis dann den dem dieser diese dieses doch einer er es sie wir ihr für gegen geöffnet im in ins jeder jede kein kurz lt los man mehr mit mitten
nach näheres noch nun ob oder rund schon seit sogar so traditionell trotz um und unter vom von vor während was wer wie wo zu zum zur zwischen zwar anmeldung bitte veranstalter mitgebracht ab
the a at after around on this nobody tickets why please see no in it he she they we there when from for to
le la les il elle ils elles un une dès vers comme après samedi apportez qui quelle alle come dopo sabato si portate chi che uno
το η ο στις μετά κάθε τα οι ποιος τι φέρτε
""".split())

OPEN_TO_CLOSE = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "„": "“”", "‚": "‘’", "«": "»", "‹": "›", "“": "”", "»": "«", '"': '"'}
CLOSERS = set(")]}）］】」』》〉”“»«›\"’‘")
QUOTES = set("„“”«»‹›\"「」『』‚‘")
BRACKETS = set("()[]{}（）［］【】")
HARD = "!?。！？｡।॥؟۔⁇⁈⁉‼‽"
TERMINATORS = ".…" + HARD + "．"
SIGNS = re.compile("[" + re.escape(TERMINATORS + "".join(OPEN_TO_CLOSE) + "".join(CLOSERS)) + ";\u037e\u061b]")
#: Blank lines, whatever the line ends and the blanks on them.
BLANK = re.compile("(?:\\r\\n|\\r|\\n)[^\\S\\r\\n]*(?:\\r\\n|\\r|\\n)\\s*|\\u2029\\s*")
THAI = "\u0e00-\u0e7f"
THAI_GAP = re.compile(rf"(?<=[{THAI}])\s+(?=[{THAI}])")
ROMAN = re.compile(r"^[IVXLC]{1,6}$")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]")
#: What may follow a closing mark in an unspaced script and carry the sentence on.
QUOTING = ("と", "って", "との", "という", "とか", "など")


class Trie:
    """Abbreviations read backwards, so that one walk finds the longest ending."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for letter in reversed(word):
                node = node.setdefault(letter, {})
            node[""] = True

    def ends(self, text: str, end: int, start: int) -> int:
        """Length of the longest entry that ends at ``end`` and begins a word, else 0."""
        node, at, best = self.root, end, 0
        while at > start:
            letter = text[at - 1].lower()
            node = node.get(letter)
            if node is None:
                break
            at -= 1
            if "" in node and (at == start or not (text[at - 1].isalnum() or text[at - 1] == ".")):
                best = end - at
        return best


LEADING_TRIE, TRAILING_TRIE = Trie(LEADING), Trie(TRAILING)


def _pairs(text: str, start: int, end: int, signs: list[int]) -> dict[int, int]:
    """Opening position to closing position, of marks that have a partner."""
    stack: list[int] = []
    found: dict[int, int] = {}
    for at in signs:
        sign = text[at]
        if sign in CLOSERS:
            for k in range(len(stack) - 1, -1, -1):
                if sign in OPEN_TO_CLOSE[text[stack[k]]]:
                    found[stack[k]] = at
                    del stack[k:]
                    break
            else:
                if sign in OPEN_TO_CLOSE:
                    stack.append(at)
        elif sign in OPEN_TO_CLOSE:
            stack.append(at)
    return found


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, without outer white space."""
    if not text:
        return []
    found: list[tuple[int, int]] = []
    at = 0
    for blank in BLANK.finditer(text):
        _paragraph(text, at, blank.start(), found)
        at = blank.end()
    _paragraph(text, at, len(text), found)
    return found


def _trimmed(text: str, start: int, end: int, found: list[tuple[int, int]]) -> None:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if start < end:
        found.append((start, end))


def _paragraph(text: str, start: int, end: int, found: list[tuple[int, int]]) -> None:
    signs = [m.start() for m in SIGNS.finditer(text, start, end)]
    pairs = _pairs(text, start, end, signs)
    closing = {c: o for o, c in pairs.items()}
    tops: list[tuple[int, int]] = []  # outermost pairs in order
    for o in sorted(pairs):
        if not tops or o > tops[-1][1]:
            tops.append((o, pairs[o]))
    top_starts = [o for o, _ in tops]
    begin = start  # of the current sentence
    cuts = {m.end(): m.start() for m in THAI_GAP.finditer(text, start, end)} if re.search(f"[{THAI}]", text[start:end]) else {}
    k, done = 0, start
    events = sorted([*signs, *cuts]) if cuts else signs
    while k < len(events):
        here = events[k]
        k += 1
        if here < done:
            continue
        if here in cuts:
            if not _inside(tops, top_starts, here) and not _thai_joined(text, cuts[here], here, start):
                _trimmed(text, begin, cuts[here], found)
                begin = done = here
            continue
        cut = None
        inside = _inside(tops, top_starts, here)
        if inside is None:
            if text[here] in TERMINATORS or text[here] in ";\u037e\u061b":
                cut = _after_terminator(text, here, begin, end, closing, pairs)
        elif here == inside[1]:  # a closing mark of the outermost level
            cut = _after_closing(text, inside[0], here, begin, end, closing, pairs)
        if cut is not None:
            _trimmed(text, begin, cut, found)
            begin = done = cut
    _trimmed(text, begin, end, found)


def _inside(tops: list[tuple[int, int]], starts: list[int], at: int) -> tuple[int, int] | None:
    k = bisect_right(starts, at) - 1
    return tops[k] if k >= 0 and tops[k][0] <= at <= tops[k][1] else None


def _thai_joined(text: str, left: int, right: int, start: int) -> bool:
    """Whether a Thai space follows a date and so stands inside the sentence."""
    return any(text.endswith(month, start, left) for month in THAI_MONTHS)


def _tail(text: str, at: int, end: int, closing: dict[int, int], floor: int) -> int:
    """Past further terminators and the closing marks of pairs open before them."""
    while at < end and (text[at] in TERMINATORS or text[at] in CLOSERS and at in closing and closing[at] < floor):
        at += 1
    return at


def _symbols(text: str, at: int, end: int) -> int:
    """Past trailing symbols such as emoji, with the blanks between."""
    last, look = at, at
    while look < end:
        letter = text[look]
        if letter.isspace():
            if letter in "\r\n" and last != at:
                break
            look += 1
        elif _symbol(letter):
            look += 1
            last = look
        else:
            break
    return last


def _symbol(letter: str) -> bool:
    point = ord(letter)
    return 0x1F000 <= point <= 0x1FAFF or 0x2190 <= point <= 0x21FF or 0x2300 <= point <= 0x27BF or 0x2B00 <= point <= 0x2BFF or point in (0x200D, 0xFE0F, 0x20E3, 0x203B, 0x266A, 0x266B)


def _next(text: str, at: int, end: int) -> tuple[int, str]:
    """Position of the next character that isn't blank, and the word there."""
    while at < end and text[at].isspace():
        at += 1
    stop = at
    while stop < end and not text[stop].isspace():
        stop += 1
    return at, text[at:stop]


def _first_letter(word: str) -> str:
    """The first letter or digit of a word, past opening marks."""
    for letter in word:
        if letter.isalnum():
            return letter
        if letter not in OPEN_TO_CLOSE and letter not in "¡¿'’-–—":
            return letter
    return ""


def _cased(letter: str) -> bool:
    return letter.lower() != letter.upper()


def _starts(text: str, at: int, word: str) -> bool:
    """Whether the word may begin a sentence: not a small letter, comma or the like."""
    if not word:
        return True
    if word[0] in ",;:)]}%&/=+*،；：、，":
        return False
    if word[0] in "-–—" and len(word) == 1:
        return False
    letter = _first_letter(word)
    return not (letter.isalpha() and letter.islower())


def _after_terminator(text: str, here: int, begin: int, end: int, closing: dict[int, int], pairs: dict[int, int]) -> int | None:
    """End of the sentence that stops at a terminator outside all marks, or None."""
    sign = text[here]
    if sign == "\u061b":
        return None
    if sign in ";\u037e":
        before = text[here - 1] if here > begin else ""
        if not ("Ͱ" <= before <= "Ͽ" or "ἀ" <= before <= "῿"):
            return None
    stop = _tail(text, here + 1, end, closing, here)
    run = text[here:stop]
    marked = _symbols(text, stop, end)
    at, word = _next(text, marked, end)
    if at >= end:
        return end
    if marked > stop:
        return marked if _starts(text, at, word) else None
    spaced = at > stop
    hard = any(c in HARD for c in run) or sign in (";", "\u037e")
    if hard:
        if CJK.match(text[at]) or any(c in "。！？｡" for c in run):
            if text.startswith(QUOTING, stop) and run[-1] in "！？!?":
                return None
            return None if word[0] in "，、；：,;:" else stop
        if not spaced and (text[at].islower() or text[at].isdigit() or text[at] in "/=&" or "www." in (text[max(begin, here - 200) : here].split() or [""])[-1].lower()):
            return None
        return stop if _starts(text, at, word) else None
    if "…" in run or len(run) >= 2 and set(run) <= {"."}:
        if not spaced and not text[at].isupper():
            return None
        if here <= begin or not text[begin:here].strip():
            return None
        if spaced and CJK.search(text[max(begin, here - 3) : here]):
            return stop
        if _shouted(text, begin, here, word):
            return None
        return stop if _starts(text, at, word) else None
    return stop if _period(text, here, begin, end, at, word, spaced) else None


def _period(text: str, here: int, begin: int, end: int, at: int, word: str, spaced: bool) -> bool:
    """Whether a single period outside all marks ends its sentence."""
    back = here
    while back > begin and not text[back - 1].isspace():
        back -= 1
    token = text[back:here].lstrip("„“\"«»([{（「‚'")
    letter = _first_letter(word)
    if not token or not _starts(text, at, word):
        return False
    if not spaced:
        if not letter.isalpha() or not letter.isupper() and _cased(letter):
            return False
        if "www" in token.lower() or "://" in token or "@" in token:
            return False
        if token[-1].isdigit() and len(token) - len(token.rstrip("0123456789")) < 3 and not CJK.match(letter):
            return False
        if LEADING_TRIE.ends(text, here, begin) or len(re.sub(r"\W", "", token)) < 2 or "." in token and token[-2:-1] == ".":
            return False
        if not _cased(letter):
            return len(token) >= 2
        return not (len(word) > 1 and word[1] == ".") or token[-1].islower() and len(token) > 2
    tail = token.rsplit("-", 1)[-1].rsplit("/", 1)[-1] if not token[-1].isdigit() else token
    capital = len(word) > 1 and word.rstrip(".,!?:;").isupper() and len(word.rstrip(".,!?:;")) > 1
    shouting = capital and token.isupper() and len(token) > 1
    trailing = TRAILING_TRIE.ends(text, here, begin) or (3 if small_ending(text, here) else 0)
    leading = LEADING_TRIE.ends(text, here, begin)
    small = tail.lower()
    if trailing >= max(1, leading):
        ending = text[here - trailing : here].lower()
        if shouting or capital and text[here - trailing : here].isupper():
            return False
        if ending in TIMES_OF_DAY:
            return re.sub(r"\W+$", "", word).lower() in STARTERS
        if ending in ("min", "km", "kg", "std", "sek", "pers", "mio", "mrd", "jh", "jhd"):
            return letter.isupper() or not letter.isalpha() and not letter.isdigit()
        if ending in ("co",):
            return False
        return not letter.isdigit() or ending in ("usw", "etc", "ecc", "κ.λπ")
    if leading:
        if small in ("no", "p", "s", "n", "art", "ch", "fig", "mar", "jun", "av", "mm", "ms"):
            # words of their own elsewhere: abbreviations only before a number, a name's initial or a capital letter
            if small in ("s", "p", "n", "ms", "mm") and (letter.isdigit() or letter.isupper()):
                return False
            return not letter.isdigit()
        return False
    if len(tail) == 1 and tail.isalpha():
        if tail.lower() == "v" and re.search(r"(?i)\be\.\s?v$", text[max(begin, here - 5) : here]):
            return not shouting and not (capital and text[here - 1].isupper() and text[max(begin, here - 4) : here].isupper())
        if tail.lower() in "äa" and re.search(r"(?i)\bu\.\s?[äa]$", text[max(begin, here - 5) : here]):
            return not capital
        return False  # an initial
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", tail):
        if small == "e.v":
            return True
        return False
    if token[-1].isdigit():
        digits = re.search(r"\d+$", token).group()
        if re.fullmatch(r"\d{1,2}\.\d{1,2}", token):
            return letter.isupper() and not _shouted(text, begin, here, word)
        if len(digits) <= 2 and len(token) <= 3 and letter.isupper() and letter.isalpha():
            first = re.sub(r"^\W+|\W+$", "", word).lower()
            if word[0] in QUOTES:
                return True
            previous = text[max(begin, here - 80) : here].split()[-2:-1]
            if previous and previous[0].lower().rstrip(".") in ENGLISH_MONTHS:
                return True
            if previous and previous[0].lower().rstrip(".") in ("nr", "no", "n", "n°", "s", "p", "seite", "αρ"):
                return True
            return first in STARTERS and first not in ("lt",)
        return True
    if ROMAN.match(tail) and letter.isupper() and len(tail) <= 5:
        if _shouted(text, begin, here, word):
            return False
        first = re.sub(r"\W+$", "", word).lower()
        return first in STARTERS
    return True


def small_ending(text: str, here: int) -> bool:
    """Whether the word before is a street name cut to 'str'."""
    return text[max(0, here - 3) : here].lower() == "str" and here > 3 and text[here - 4].isalpha()


def _shouted(text: str, begin: int, here: int, word: str) -> bool:
    """Whether a sentence in capitals goes on in capitals, so that case tells nothing."""
    bare = "".join(c for c in word if c.isalpha())
    if len(bare) < 2 or not bare.isupper():
        return False
    before = "".join(c for c in text[max(begin, here - 60) : here] if c.isalpha())
    return len(before) > 1 and before.isupper()


def _after_closing(text: str, opened: int, here: int, begin: int, end: int, closing: dict[int, int], pairs: dict[int, int]) -> int | None:
    """End of the sentence that stops at the closing mark of an outermost pair, or None."""
    inner = text[opened + 1 : here].rstrip()
    ended = inner[-1:] in TERMINATORS and inner[-1:] != "" or inner[-1:] in CLOSERS and inner.rstrip("".join(CLOSERS) + " ")[-1:] in TERMINATORS
    if not ended or here + 1 < end and text[here + 1] in TERMINATORS + ",;:،，、；：":
        return None
    alone = not text[begin:opened].strip()
    marked = _symbols(text, here + 1, end)
    at, word = _next(text, marked, end)
    if at >= end:
        return end
    spaced = at > marked or marked > here + 1
    bracket = text[opened] in BRACKETS
    if bracket:
        return marked if alone and (spaced or not text[at].islower()) and _starts(text, at, word) else None
    if not _starts(text, at, word):
        return None
    before = text[begin:opened].rstrip()
    introduced = before != "" and before[-1] in ":：,，،、"
    following = _first_letter(word)
    if CJK.match(text[at]) or CJK.search(inner):
        return marked if introduced and (spaced or before[-1] in ":：") else None
    if not _cased(following) or not following.isalpha():
        if following.isalpha():
            return marked if introduced else None
        return marked if introduced or alone else None
    if introduced or alone:
        return marked if spaced or following.isupper() else None
    return None


def sentence_offsets(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_start, sent_end), one row per sentence.

    Offsets count code points from 0, the end is exclusive, and neither end is
    white space; every other character belongs to exactly one sentence. Null
    and blank texts give no row; rows with equal keys are cut each by itself.
    """

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"s": s, "e": e} for s, e in sentences(t if isinstance(t, str) else None)] for t in batch], dtype=object)

    spans = F.pandas_udf(cut, "array<struct<s:int,e:int>>")
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key), F.explode(spans(F.col(text))).alias("span"))
    return rows.select(F.col(key), F.col("span.s").alias("sent_start"), F.col("span.e").alias("sent_end"))
