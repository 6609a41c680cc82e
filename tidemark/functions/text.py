"""Folding, tokens and small parsers of names, numbers and codes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# How letters of other alphabets are written in Latin ones, and spellings that mean one sound.
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "i", "й": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ь": "", "ю": "iu",
    "я": "ia", "ё": "e", "ы": "y", "э": "e", "ъ": "", "'": "", "’": "", "ʼ": "", "`": "",
}
DIGRAPHS = (("ye", "ie"), ("yu", "iu"), ("ya", "ia"))
#: Words for kinds of streets and places (folded), which a query may leave out.
STOPWORDS = (
    "vulytsia", "vul", "provulok", "prov", "prospekt", "prosp", "ploshcha", "pl", "bulvar", "bulv", "shose", "naberezhna", "nab", "uzviz", "proizd", "aleia", "tupyk", "maidan",
    "mikroraion", "mkr", "mkrn", "kvartal", "ulytsa", "ul", "pereulok", "per", "ploshchad", "street", "st", "avenue", "ave", "lane", "ln", "square", "sq", "boulevard", "blvd",
    "road", "rd", "misto", "selo", "selyshche", "smt",
)


def _accented() -> dict[str, str]:
    """Small letters with marks and their plain Latin letter, by the canonical decomposition."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f")
        if c == c.lower() and len(plain) == 1 and plain.isascii() and plain.isalpha():
            out[c] = plain
    return out


def latin(x: Column) -> Column:
    """Lower case in Latin letters, marks gone, two spellings of one sound as one; built-in expressions only.

    Letters that become one letter go through one translation, those that become several or none are replaced.
    """
    out = F.lower(x)
    # letters that were written as a base and a mark but have a spelling of their own
    for parts, whole in (("и\u0306", "й"), ("і\u0308", "ї"), ("е\u0308", "ё")):
        out = F.replace(out, F.lit(parts), F.lit(whole))
    single = {k: v for k, v in LETTERS.items() if len(v) == 1} | _accented()
    dropped = "".join(k for k, v in LETTERS.items() if not v) + "".join(map(chr, range(0x300, 0x370)))
    for k, v in LETTERS.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    # letters without a counterpart in the second list are dropped
    out = F.translate(out, "".join(single) + dropped, "".join(single.values()))
    for a, b in DIGRAPHS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ascii_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(x: Column) -> Column:
    """Search tokens: runs of Latin letters and digits of the folded text."""
    return F.regexp_extract_all(latin(x), F.lit("[a-z0-9]+"), F.lit(0))


def name_key(x: Column, stop: tuple[str, ...] = ()) -> Column:
    """The folded tokens but for stop words, in order, joined by spaces."""
    return F.array_join(F.filter(tokens(x), lambda t: ~t.isin(*stop) if stop else F.lit(True)), " ")


def parsed_query(x: Column) -> Column:
    """A struct of tokens (text, prefix, optional, house) and house of a query as it is typed.

    The last piece that starts with a digit and is at most ten long is the house, if other words come with it.
    The last token is a prefix unless a separator follows it. Kinds of streets, single letters and beginnings of
    kinds while typing are optional.
    """
    pieces = F.filter(F.split(x, r"[\s,;]+"), lambda p: p != "")
    typing = ~x.rlike(r"[\s,;]$")
    at = F.array_max(F.filter(F.transform(pieces, lambda p, i: F.when(p.rlike("^[0-9]") & (F.length(p) <= 10), i)), lambda i: i.isNotNull()))
    stop = F.array(*map(F.lit, STOPWORDS))

    def of_piece(p, i):
        words = tokens(p)
        last = i == F.size(pieces) - 1

        def token(t, j):
            prefix = typing & last & (j == F.size(words) - 1)
            optional = F.array_contains(stop, t) | ((F.length(t) == 1) & ~t.rlike("[0-9]")) | (prefix & F.exists(stop, lambda w: w.startswith(t)))
            return F.struct(t.alias("text"), prefix.alias("prefix"), optional.alias("optional"), F.coalesce(i == at, F.lit(False)).alias("house"))

        return F.transform(words, token)

    parts = F.flatten(F.transform(pieces, of_piece))
    named = F.exists(parts, lambda t: ~t["house"] & ~t["text"].rlike("^[0-9]+$"))
    house = F.when(at.isNotNull() & named, F.nullif(house_fold(F.get(pieces, at.cast("int"))), F.lit("")))
    return F.struct(parts.alias("tokens"), house.alias("house"))


def house_fold(x: Column) -> Column:
    """A house number for matching: Latin letters, digits and slashes only."""
    return F.regexp_replace(latin(x), "[^a-z0-9/]", "")


# Latin letters that look like Cyrillic ones (in road numbers, in names), apostrophes, words for kinds of streets.
REF_LETTERS = ("MHPTEABCOKX", "МНРТЕАВСОКХ")
NAME_LETTERS = ("aceiopxyk", "асеіорхук")
APOSTROPHES = ("’ʼ`‘´ʹ", "'" * 6)
STREET_TYPES = (
    "вул", "вулиця", "вулиці", "просп", "проспект", "пр", "пр-т", "пр-кт", "бульв", "бульвар", "б-р", "пл", "площа", "площі", "пров", "провулок", "шосе", "узвіз", "майдан", "м",
    "міст", "мосту", "спуск", "тупик", "проїзд",
)


def road_ref(x: Column) -> Column:
    """A road's number as signed: Cyrillic letter, hyphens between the groups."""
    flat = F.regexp_replace(F.translate(F.upper(F.trim(x)), *REF_LETTERS), r"\s+", "")
    pattern = r"^([МНРТ])-?([0-9]+)(?:-?([0-9]+))?(?:-?([0-9]+))?$"
    parts = F.filter(F.array(*(F.regexp_extract(flat, pattern, k) for k in range(1, 5))), lambda p: p != "")
    return F.when(flat.rlike(pattern), F.array_join(parts, "-")).otherwise(flat)


def street_key(x: Column) -> Column:
    """A street's words, sorted, without kinds and initials, look-alike letters in one alphabet."""
    plain = F.translate(F.lower(F.coalesce(x, F.lit(""))), APOSTROPHES[0] + NAME_LETTERS[0], APOSTROPHES[1] + NAME_LETTERS[1])
    spaced = F.regexp_replace(plain, r"(?<=\p{L})\.(?=\S)", ". ")
    words = F.transform(F.split(spaced, r"[\s,]+"), lambda w: F.regexp_replace(w, "^[.,'\"]+|[.,'\"]+$", ""))
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*STREET_TYPES) & ~(w.rlike(r"^\p{L}\.?$")))
    return F.array_join(F.array_sort(kept), " ")


def same_street(a: Column, b: Column) -> Column:
    """Equal keys, or the words of one within those of the other with one of five letters or more."""
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    less = F.when(F.size(wa) <= F.size(wb), wa).otherwise(wb)
    more = F.when(F.size(wa) <= F.size(wb), wb).otherwise(wa)
    within = (F.size(F.array_except(less, more)) == 0) & F.exists(less, lambda w: F.length(w) >= 5)
    return (a != "") & (b != "") & ((a == b) | within)


def limits_with_unit(x: Column, unit: str = "км") -> Column:
    """All whole numbers that stand before the unit."""
    return F.transform(F.regexp_extract_all(x, F.lit(rf"([0-9]+)\s*{unit}"), F.lit(1)), lambda v: v.cast("int"))


def geo_uri(x: Column) -> Column:
    """A struct of lat, lon and label of a geo: link: its query's point if the path has none, a label in brackets."""
    number = r"([+-]?[0-9]{1,3}(?:\.[0-9]+)?)"
    path, query = F.regexp_extract(x, rf"(?i)^geo:{number},{number}", 0), F.regexp_extract(x, r"[?&]q=([^&]*)", 1)
    text = F.coalesce(F.try_url_decode(query), F.lit(""))
    of = lambda s, k: F.regexp_extract(s, rf"^(?:(?i)geo:)?{number},\s*{number}", k).try_cast("double")
    none = (of(path, 1) == 0) & (of(path, 2) == 0)
    lat, lon = (F.coalesce(F.when(~none, of(path, k)), of(text, k)) for k in (1, 2))
    label = F.nullif(F.trim(F.coalesce(F.nullif(F.regexp_extract(text, r"\((.*)\)\s*$", 1), F.lit("")), F.when(~text.rlike(rf"^{number},"), text), F.lit(""))), F.lit(""))
    ok = x.rlike("(?i)^geo:") & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(x.rlike("(?i)^geo:"), F.struct(F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"), label.alias("label")))


def natural_order(x: Column) -> tuple[Column, Column]:
    """Sort keys: the number in front (none: after all numbers), then the text."""
    return F.coalesce(F.regexp_extract(x, r"^([0-9]{1,9})", 1).try_cast("long"), F.lit(1 << 30)), F.lower(x)


def typo_budget(token: Column, prefix: bool = False) -> Column:
    n = F.length(token)
    return F.when(token.rlike("[0-9]"), 0).when(n >= 8, 2).when(n >= (5 if prefix else 4), 1).otherwise(0)


def speed_limit(x: Column) -> Column:
    """A speed tag as km/h: a number with an optional unit, kept within 1 to 250, ties to even."""
    n = F.regexp_extract(x, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(mph|km/h|kph)?\s*$", 1).try_cast("double")
    mph = F.regexp_extract(x, r"(mph)\s*$", 1) == "mph"
    kmh = F.bround(F.when(mph, n * 1.609344).otherwise(n))
    return F.when(kmh.between(1, 250), kmh.cast("int"))


def coordinates(x: Column) -> Column:
    """A struct of lat and lon from 'lat, lon' in decimals, or degrees with hemisphere letters; null otherwise."""
    d = r"^\s*([+-]?[0-9]{1,3}(?:\.[0-9]+)?)\s*[,; ]\s*([+-]?[0-9]{1,3}(?:\.[0-9]+)?)\s*$"
    h = r"(?i)^\s*([0-9]{1,3}(?:\.[0-9]+)?)\s*°?\s*([NS])[,; ]*\s*([0-9]{1,3}(?:\.[0-9]+)?)\s*°?\s*([EW])\s*$"
    a, b = F.regexp_extract(x, d, 1).try_cast("double"), F.regexp_extract(x, d, 2).try_cast("double")
    la = F.regexp_extract(x, h, 1).try_cast("double") * F.when(F.upper(F.regexp_extract(x, h, 2)) == "S", -1).otherwise(1)
    lo = F.regexp_extract(x, h, 3).try_cast("double") * F.when(F.upper(F.regexp_extract(x, h, 4)) == "W", -1).otherwise(1)
    lat, lon = F.coalesce(a, la), F.coalesce(b, lo)
    # one of the two over 90 degrees tells the order
    swap = (F.abs(lat) > 90) & (F.abs(lon) <= 90)
    lat, lon = F.when(swap, lon).otherwise(lat), F.when(swap, lat).otherwise(lon)
    return F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def road_km(x: Column) -> Column:
    """'113+864' as 113.864; the metres are padded on the right."""
    km, m = F.regexp_extract(x, r"^\s*([0-9]+)\s*(?:\+\s*([0-9]{1,3}))?\s*$", 1), F.regexp_extract(x, r"^\s*([0-9]+)\s*(?:\+\s*([0-9]{1,3}))?\s*$", 2)
    return F.concat(F.nullif(km, F.lit("")), F.lit("."), F.rpad(m, 3, "0")).try_cast("double")


def hex_bytes(x: Column) -> Column:
    """The bytes of a hexadecimal string as an array of int; null if it is none."""
    clean = F.regexp_replace(x, r"\s", "")
    pairs = F.regexp_extract_all(clean, F.lit("[0-9A-Fa-f]{2}"), F.lit(0))
    return F.when(clean.rlike("^(?:[0-9A-Fa-f]{2})+$"), F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int")))


def bit_field(bytes_: Column, start: int, bits: int, big: bool = False, signed: bool = False) -> Column:
    """A field of up to 62 bits of a byte array: from bit start upward, or with big from that bit of the whole number; null on a short frame."""
    first, last = start // 8, (start + bits - 1) // 8
    value = F.lit(0).cast("long")
    for i in range(first, last + 1):
        weight = (last - i) if big else (i - first)
        value = value + F.shiftleft(F.get(bytes_, F.lit(i)).cast("long"), 8 * weight)
    drop = (8 * (last + 1) - start - bits) if big else start - 8 * first
    value = F.shiftright(value, drop).bitwiseAND(F.lit((1 << bits) - 1))
    if signed:
        value = F.when(value >= (1 << (bits - 1)), value - (1 << bits)).otherwise(value)
    return F.when(F.size(bytes_) > last, value)


def code_normal(x: Column, size: int = 4) -> Column:
    """A code as typed, in upper-case groups of size with dashes: letters that look like digits become those, all else goes."""
    plain = F.regexp_replace(F.translate(F.upper(x), "OIL", "011"), "[^0-9A-Z]", "")
    return F.regexp_replace(plain, f"(.{{{size}}})(?=.)", "$1-")


def house_key(x: Column) -> Column:
    """A house number for comparison: lower case, look-alike letters in one alphabet, a block as its letter, no spaces or dashes."""
    plain = F.translate(F.lower(x), *NAME_LETTERS)
    return F.regexp_replace(F.regexp_replace(plain, r",?\s*корп(?:ус)?\.?\s*", "к"), r"[\s-]", "")


#: Phrases of camera lists' address rows. Fixed values.
PHRASES = {
    "toward": r"^(?:у|в)\s+напрямку\s*",
    "near": r"^біля",
    "crossing": r"(?i)^(?:перехр(?:естя)?\.?|перех\.)\s*",
    "and": r"\s+(?:та|і)\s+(?:вулиці\s+)?",
    "house": r",?\s*([0-9]+[\p{L}0-9_/-]*(?:,\s*корп\.\s*[0-9]+)?)$",
}


def _bare(x: Column) -> Column:
    """Without blanks and commas at both ends."""
    return F.regexp_replace(x, "^[ ,]+|[ ,]+$", "")


def _said(notes: Column, phrase: str) -> Column:
    """What follows the phrase in the first note that begins with it."""
    return F.get(F.transform(F.filter(notes, lambda n: n.rlike(PHRASES[phrase])), lambda n: F.regexp_replace(n, PHRASES[phrase], "")), F.lit(0))


def address(x: Column) -> Column:
    """A struct of street, house, crossing, near, toward of a list's address row.

    A row is a place, with notes in brackets. A place is one of three kinds: streets that meet, told by a word or by a
    slash that no digit stands before; a street and a house number; a street.
    """
    notes = F.transform(F.regexp_extract_all(x, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda n: F.trim(n))
    place = _bare(F.regexp_replace(F.regexp_replace(x, r"\([^()]*\)", " "), r"\s+", " "))
    kind = F.when(place.rlike(PHRASES["crossing"] + "."), "word").when(place.rlike(r"[^0-9]\s*/"), "slash").when(place.rlike("^.+?" + PHRASES["house"]), "house").otherwise("street")
    by_word = F.regexp_replace(F.regexp_replace(place, PHRASES["crossing"], ""), PHRASES["and"], " - ")
    streets = F.when(kind == "word", F.split(by_word, r"\s*[-–—]\s*")).when(kind == "slash", F.split(place, "/"))
    return F.struct(
        F.when(kind == "house", _bare(F.regexp_extract(place, "^(.+?)" + PHRASES["house"], 1))).when(kind == "street", place).alias("street"),
        F.when(kind == "house", F.regexp_extract(place, "^(.+?)" + PHRASES["house"], 2)).alias("house"),
        F.filter(F.transform(streets, _bare), lambda s: s != "").alias("crossing"),
        F.trim(_said(notes, "near")).alias("near"),
        F.trim(F.get(F.split(_said(notes, "toward"), ","), F.lit(0))).alias("toward"),
    )
