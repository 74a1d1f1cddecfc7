"""Text columns: two normalisers, phrase tests, cleaning and guarded parsing."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import LABELS

#: White space as the source's language has it: ASCII, no-break and other Unicode spaces, and the byte-order mark.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _decompose(text: str | None) -> str | None:
    return None if text is None else re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", text))


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(_decompose)


_BEYOND_ASCII = r"[^\x00-\x7F]"


def unaccented(text: Column) -> Column:
    """Compatibility decomposition without combining marks, which the JVM lacks. Arrow batches carry a null for plain ASCII
    text. Give it a plain column, and once: every call is another one for Python."""
    return F.coalesce(_decomposed(F.when(text.rlike(_BEYOND_ASCII), text)), text)


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """Canonical composition, with nulls for plain ASCII as above."""
    return F.coalesce(_composed(F.when(text.rlike(_BEYOND_ASCII), text)), text)


def searchable(*values: Column, ascii_only: bool = False) -> Column:
    """Joined by blanks, unaccented, lower case, runs of anything but letters and digits as one blank."""
    joined = F.concat_ws(" ", *values)
    return F.trim(F.regexp_replace(F.lower(joined if ascii_only else unaccented(joined)), "[^a-z0-9]+", " "))


def lowered(*values: Column) -> Column:
    """Joined by blanks and in lower case, nothing more: the timeline's own reading of a permit."""
    return F.lower(F.concat_ws(" ", *values))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def phrase(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", _decompose(text).lower()).strip()


def _phrases(keywords: list[str]) -> list[str]:
    return [p for p in dict.fromkeys(map(phrase, keywords)) if p]


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whole words or phrases of normalised text, by plain substring search."""
    phrases = _phrases(keywords)
    if not phrases:
        return F.lit(False)
    return let(F.concat(F.lit(" "), text, F.lit(" ")), lambda t: reduce(lambda a, b: a | b, [t.contains(f" {p} ") for p in phrases]))


def holds_any(column: str, keywords: list[str]) -> Column:
    """The same for a named column of text that has a blank at both ends. Its tests are parsed from one text, as every
    column that Python makes is several calls to the JVM. Phrases are letters, digits and blanks, which need no quoting."""
    phrases = _phrases(keywords)
    return F.expr(" or ".join(f"contains(`{column}`, ' {p} ')" for p in phrases)) if phrases else F.lit(False)


def literal_array(words: list[str]) -> Column:
    """Plain words (no quotes among them) as one literal, parsed from one text."""
    return F.expr(f"array({', '.join(map(repr, words))})")


def literal_map(words: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(map(repr, (x for pair in words.items() for x in pair)))})")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def clean(text: Column, length: int) -> Column:
    """Trimmed of any white space, empty as null, cut to a length."""
    own = strip(text.cast("string"))
    return F.when(own != "", F.substring(own, 1, length))


def label(code: Column) -> Column:
    """What people read for a category, stage or review status."""
    return F.try_element_at(literal_map(LABELS), code)


def uri_part(text: Column) -> Column:
    """Percent-encoding as browsers do it for a component: blanks as %20, and ``!'()*~`` as they are."""
    own = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        own = F.replace(own, F.lit(coded), F.lit(plain))
    return own


def failure_message(text: Column, length: int = 1000) -> Column:
    """A message on one line."""
    return F.substring(F.regexp_replace(text, r"[\r\n\t]+", " "), 1, length)


def guarded_cell(value: Column) -> Column:
    """A CSV cell: formulas made harmless, quoted where it must be."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[\t\r\n ]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


# ---- guarded parsing: null where the text is not exactly of the form


def civil_date(text: Column) -> Column:
    """``YYYY-MM-DD``, with a midnight time or without."""
    own = strip(text)
    return F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}(?:T00:00:00(?:\.0+)?)?$"), F.try_to_date(F.substring(own, 1, 10), "yyyy-MM-dd"))


def strict_date(text: Column) -> Column:
    own = strip(text)
    return F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(own, "yyyy-MM-dd"))


def decimal_text(text: Column) -> Column:
    """Money and quantities: currency signs, commas and spaces dropped; a plain number or null."""
    own = F.regexp_replace(text, rf"[$,]|{SPACE}", "")
    return F.when(own.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), own)


def number(text: Column) -> Column:
    return decimal_text(text).try_cast("double")


def integer(text: Column) -> Column:
    value = number(text)
    return F.when(value == F.floor(value), value.try_cast("long"))


def instant(text: Column) -> Column:
    """Seconds below 10^10, milliseconds from there on, or ISO text."""
    value = text.try_cast("double")
    of_number = F.when(F.abs(value) < 1e10, F.timestamp_millis((value * 1000).cast("long"))).otherwise(F.timestamp_millis(value.cast("long")))
    return F.when(text.rlike(r"^-?\d+(?:\.\d+)?$"), of_number).otherwise(F.try_to_timestamp(text))


# ---- stored payloads: a field of a JSON object, null where it is missing, of another type or out of bounds

COORDINATE_BOUNDS = {"latitude": 90, "longitude": 180}


def _field(payload: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")


def payload_text(payload: Column, key: str) -> Column:
    """A text field without white space around it; blank ones and other types are null."""
    value = _field(payload, key)
    own = strip(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")))
    return F.when(own != "", own)


def payload_coordinate(payload: Column, key: str) -> Column:
    """``latitude`` or ``longitude`` as a number, given as a number or as text (blank text reads as zero), within bounds."""
    value = _field(payload, key)
    kind, written = F.schema_of_variant(value), strip(F.try_variant_get(value, "$", "string"))
    number_ = F.when((kind == "STRING") & (written == ""), 0.0).when(~kind.isin("BOOLEAN", "VOID"), written.try_cast("double"))
    return F.when(number_.between(-COORDINATE_BOUNDS[key], COORDINATE_BOUNDS[key]), number_)
