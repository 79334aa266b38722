"""Scalar functions on columns: names, codes, numbers and keys. All stay in the JVM but for ``similarity``, which Spark has
no function for."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import NICKNAMES, POSITION_GROUPS, PROBABILITY_FLOOR, SUFFIXES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is named, and computed, once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _without_marks(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


def _tables() -> tuple[dict[str, str], str, dict[str, str]]:
    """Characters that compatibility decomposition makes one other character, none (marks), or several, marks left out.
    Hangul syllables follow from a rule and are in none of them."""
    one, several, none = {}, {}, []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or _HANGUL <= code < _HANGUL + 11172:
            continue
        c = chr(code)
        if (x := _without_marks(c)) == "":
            none.append(c)
        elif len(x) > 1:
            several[c] = x
        elif x != c:
            one[c] = x
    return one, "".join(none), several


def _ranges(chars: list[str], gap: int = 256) -> str:
    """A character class that holds at least these characters; from U+0500 on, up to ``gap`` others in between too."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c - runs[-1][1] <= (gap if c > 0x500 else 1):
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


_HANGUL = 0xAC00
_ONE, _NONE, _SEVERAL = _tables()
#: ASCII is told by the first test of the class.
_RARE = f"[\\x{{80}}-\\x{{10ffff}}&&[{_ranges([*_SEVERAL, chr(_HANGUL), chr(_HANGUL + 11171)], 12000)}]]"
_LEAD, _VOWEL, _TAIL = ("".join(chr(a + i) for i in range(n)) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _character(x: Column) -> Column:
    """What one character that may stand for several decomposes to."""
    at = F.instr(F.lit("".join(_SEVERAL)), x)
    listed = F.get(F.split(F.lit("\x00".join(_SEVERAL.values())), "\x00"), at - 1)
    syllable = F.ascii(x) - _HANGUL
    tail = F.when(syllable % 28 > 0, F.substring(F.lit(_TAIL), syllable % 28, F.lit(1))).otherwise(F.lit(""))
    lead = F.substring(F.lit(_LEAD), F.floor(syllable / 588).cast("int") + 1, F.lit(1))
    vowel = F.substring(F.lit(_VOWEL), F.floor(syllable % 588 / 28).cast("int") + 1, F.lit(1))
    hangul = (syllable >= 0) & (syllable < 11172)
    return F.when(F.octet_length(x) == 1, x).when(hangul, F.concat(lead, vowel, tail)).when(at > 0, listed).otherwise(x)


def fold(c: Column) -> Column:
    """Compatibility decomposition without marks, of all of Unicode (NFKD less its combining characters).

    Texts of ASCII only, told by their length in bytes, are left alone. One ``translate`` covers all characters that become
    one other or none. Only texts that may hold a character that becomes several are looked at one by one before.
    """
    each = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), _character), "")
    whole = F.when(c.rlike(_RARE), each).otherwise(c)
    plain = F.translate(whole, "".join(_ONE) + _NONE, "".join(_ONE.values()))
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(plain)


def normalize_token(c: Column) -> Column:
    """Folded, lower case, a sharp s as two, runs of anything but a-z and 0-9 one blank; null gives an empty text."""
    return F.coalesce(F.trim(F.regexp_replace(F.replace(F.lower(fold(c)), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " ")), F.lit(""))


normalize_team = normalize_token


def normalize_last_name(c: Column) -> Column:
    """``normalize_token`` without one generational suffix at the end, even if that is all there is."""
    return F.trim(F.regexp_replace(normalize_token(c), f"(^| )({'|'.join(SUFFIXES)})$", ""))


def _nickname_group(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, names in enumerate(NICKNAMES) for n in names for x in (n, i)])
    return F.try_element_at(table, c)


def first_name_alias(a: Column, b: Column) -> Column:
    """Equal or of one nickname group, on normalised names; empty names match nothing."""

    def match(p: Column) -> Column:
        same = F.coalesce(_nickname_group(p["a"]) == _nickname_group(p["b"]), F.lit(False))
        return (p["a"] != "") & (p["b"] != "") & ((p["a"] == p["b"]) | same)

    return let(F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")), match)


def _code(c: Column) -> Column:
    """A raw code normalised: "D/T" is DT."""
    return F.upper(F.replace(normalize_token(c), F.lit(" "), F.lit("")))


def _group(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in POSITION_GROUPS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, raw), raw)


def position_group(c: Column) -> Column:
    """The group of a raw code; unknown codes are their own group."""
    return let(_code(c), _group)


def model_position_group(c: Column) -> Column:
    """Like ``position_group``, with kickers, punters and snappers apart; an empty code is OTHER."""
    return let(
        _code(c),
        lambda raw: F.when(raw.isin("K", "PK"), F.lit("K")).when(raw.isin("P", "LS"), raw).when(raw == "", F.lit("OTHER")).otherwise(_group(raw)),
    )


def ascii_json(c: Column) -> Column:
    """JSON text with every character beyond ASCII as an escape (two for those beyond U+FFFF)."""

    def unit(x: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))

    def escaped(x: Column) -> Column:
        high = F.ascii(x) - 0x10000
        pair = F.concat(unit(0xD800 + F.floor(high / 1024).cast("int")), unit(0xDC00 + high % 1024))
        return F.when(F.ascii(x) < 0x80, x).when(high < 0, unit(F.ascii(x))).otherwise(pair)

    each = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), escaped), "")
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(each)


def canonical_json(c: Column) -> Column:
    """JSON text with keys in order and without blanks, nested values included; texts that are no JSON are errors."""
    return ascii_json(F.to_json(F.parse_json(c)))


def first_present(columns: list[str], *names: str) -> Column:
    """The first of the columns that a table has, even if its value is null (a choice on the schema, not a coalesce)."""
    return next((F.col(n) for n in names if n in columns), F.lit(None).cast("string"))


def first_value(*cols: Column) -> Column:
    """The first non-null value, as text."""
    return F.coalesce(*[c.cast("string") for c in cols])


def identity_key(fields: dict[str, Column], numbers: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the compact JSON of fields in key order: texts, but for those that ``numbers`` names. A null counts as an
    empty text, or as 0."""
    parts: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        if name in numbers:
            parts += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), F.coalesce(fields[name].cast("string"), F.lit("0"))]
            continue
        value = F.coalesce(fields[name].cast("string"), F.lit(""))
        value = ascii_json(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
        parts += [F.lit(("{" if i == 0 else ",") + f'"{name}":"'), value, F.lit('"')]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def entry_identity(columns: list[str]) -> dict[str, Column]:
    """The ten canonical fields of an entry, from a table that has them in snake or camel case; absent ones are empty."""

    def text(*names: str) -> Column:
        return F.coalesce(first_present(columns, *names).cast("string"), F.lit(""))

    def amount(name: str) -> Column:
        # A zero counts as absent.
        c = first_present(columns, name)
        return F.when(c.try_cast("double") == 0, F.lit("")).otherwise(text(name))

    return {
        "season": F.coalesce(first_present(columns, "season").cast("int"), F.lit(0)),
        "first_name": normalize_token(text("first_name", "firstName")),
        "last_name": normalize_last_name(text("last_name", "lastName")),
        "position": position_group(text("position")),
        "origin": normalize_team(text("origin")),
        "destination": normalize_team(text("destination")),
        "transfer_date": normalize_token(text("transfer_date", "transferDate")),
        "rating": amount("rating"),
        "stars": amount("stars"),
        "eligibility": normalize_token(text("eligibility")),
    }


def entry_key(columns: list[str]) -> Column:
    """The key of an entry: ``identity_key`` of its ten fields, the season a number."""
    return identity_key(entry_identity(columns), ("season",))


def similarity(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two texts, 0 if either is empty; not symmetric, the first is the one looked up."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(x, y, strict=True):
            if p not in seen:
                seen[p] = difflib.SequenceMatcher(None, *p).ratio() if p[0] and p[1] else 0.0
            out.append(seen[p])
        return pd.Series(out)

    return ratio(a, b)


def slug(c: Column) -> Column:
    """Folded lower case with single underscores between runs of letters and digits."""
    return F.replace(normalize_token(c), F.lit(" "), F.lit("_"))


def feature_name(*parts: Column) -> Column:
    """Slugs joined by underscores; an empty part is an error."""
    slugs = [slug(p) for p in parts]
    empty = F.greatest(*[(s == "").cast("int") for s in slugs]) == 1
    return F.when(empty, F.raise_error(F.lit("a feature name has an empty part"))).otherwise(F.concat_ws("_", *slugs))


_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strict_number(c: Column) -> Column:
    """A number that may have thousands commas and a percent sign; anything else, and non-finite numbers, are errors."""
    text = F.regexp_replace(F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")), "%$", "")
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    bad = c.isNotNull() & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a finite number: "), c.cast("string")))).otherwise(value)


def lenient_number(c: Column, commas: bool = False) -> Column:
    """Blank gives null, non-finite gives null, other texts are errors."""
    text = F.trim(c.cast("string"))
    text = F.replace(text, F.lit(","), F.lit("")) if commas else text
    value = text.try_cast("double")
    bad = (text != "") & value.isNull()
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return F.when(bad, F.raise_error(F.concat(F.lit("not a number: "), text))).otherwise(finite)


def plain_number(c: Column) -> Column:
    """Blank gives null, texts that are no numbers are errors, NaN and infinities stay."""
    text = F.trim(c.cast("string"))
    return F.when(text == "", F.lit(None)).otherwise(text.cast("double"))


def season(c: Column) -> Column:
    return F.trim(c.cast("string")).cast("int")


def present(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def binary_flag(c: Column) -> Column:
    """1 for 1, true and True; 0 for 0, false, False, an empty text and null; other texts are errors."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return (
        F.when(text.isin("1", "true", "True"), 1).when(text.isin("", "0", "false", "False"), 0)
        .otherwise(F.raise_error(F.concat(F.lit("not a flag: "), text)).cast("int"))
    )


def boolean(c: Column) -> Column:
    """true/1/yes and false/0/no; other texts and null are errors."""
    text = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("null"))))
    return (
        F.when(text.isin("true", "1", "yes"), F.lit(True)).when(text.isin("false", "0", "no"), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))
    )


def sigmoid(c: Column) -> Column:
    """The logistic function, kept away from 0 and 1 and safe for large arguments of either sign."""
    e = F.exp(-F.abs(c))
    p = F.when(c >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
    return F.least(F.lit(1 - PROBABILITY_FLOOR), F.greatest(F.lit(PROBABILITY_FLOOR), p))


def title(c: Column) -> Column:
    """``a_b`` as ``A B`` for display."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def share(part: Column, whole: Column) -> Column:
    """A ratio that is null where the whole is 0."""
    return F.when(whole != 0, part / whole)


def contains_text(c: Column, part: str) -> Column:
    """Whether a text holds another literally, ignoring case; null holds nothing."""
    return F.coalesce(F.lower(c).contains(part.lower()), F.lit(False))
