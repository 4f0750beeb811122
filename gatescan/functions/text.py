"""Column functions on text: seat codes, names, keys, coercions and messages."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it, with the four separators U+001C to U+001F.
_SPACES = r"(?U)[\s\x1c-\x1f]+"
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: Words of labels on a ticket, words that are no names, and what a name has at least one of.
_LABEL = r"(?iu)(seat|座位|姓名|name)"
_EXCLUDED = ("sample", "graduate")
_LETTER = r"[A-Za-z一-鿿]"
_SEAT = r"([0-9]{2}[A-Z]{2}[0-9]{2})"
_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, _ENDS, "")


def sanitize_seat(c: Column) -> Column:
    """Upper-cased, and only A-Z and 0-9 of that."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def find_seat(c: Column) -> Column:
    """The leftmost seat code of a line, or the empty string."""
    return F.regexp_extract(sanitize_seat(c), _SEAT, 1)


def extract_seat(c: Column) -> Column:
    """The leftmost seat code (two digits, two letters, two digits) of a line, or null."""
    return F.nullif(find_seat(c), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding, which lower() lacks. Use it on distinct or selected names, not on every line."""
    return s.map(lambda x: x.casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode normalisation form KC, which Spark lacks. Use it on distinct or selected names."""
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def expected_name_key(c: Column, exact: bool = True) -> Column:
    """A name for comparison; null is empty. exact folds case fully, else lower() is used."""
    name = normalize_name(F.coalesce(c, F.lit("")))
    return casefold(name) if exact else F.lower(name)


def name_like(name: Column, folded_fully: bool = True) -> Column:
    """looks_like_name() of text that is already normalised."""
    # of all other characters only the long s folds to a letter of the excluded words
    folded = F.lower(F.translate(name, "ſ", "s") if folded_fully else name)
    return (F.length(name) >= 2) & name.rlike(_LETTER) & ~name.rlike(_LABEL) & ~folded.isin(*_EXCLUDED)


def looks_like_name(c: Column) -> Column:
    """At least two characters, one a Latin letter or CJK ideograph, no label word inside and no excluded word."""
    return name_like(normalize_name(c))


def lookup_key(c: Column, exact: bool = True) -> Column:
    """The key of a name in the seat directory. exact also applies compatibility normalisation."""
    return F.lower(normalize_name(nfkc(c) if exact else c))


def item_text(c: Column) -> Column:
    """The text of an item: null is empty, white space at the ends goes."""
    return strip(F.coalesce(c, F.lit("")))


def confidence_of(text: Column) -> Column:
    """item_confidence() of text without white space at its ends."""
    value = F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    value = value.when(text.rlike("(?i)^[+]?inf(inity)?$"), F.lit(float("inf"))).when(text.rlike("(?i)^-inf(inity)?$"), F.lit(float("-inf")))
    return F.coalesce(value, F.lit(0.0))


def item_confidence(c: Column) -> Column:
    """A confidence from text or a number: what is no number, or NaN, is 0."""
    return confidence_of(strip(c.cast("string")))


def rounded(c: Column, places: int) -> Column:
    """Rounded half-even for reports."""
    return F.bround(c, places)


def utc_timestamp(c: Column) -> Column:
    """Epoch seconds as yyyy-MM-ddTHH:mm:ssZ in UTC, cut to whole seconds, whatever the session's time zone is. Years beyond 9999
    have all their digits and no sign."""
    day = F.floor(c / 86400)
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(day.cast("int"), secs=F.floor(c) - day * 86400)
    return F.concat(F.replace(F.ltrim(at.cast("string"), F.lit("+")), F.lit(" "), F.lit("T")), F.lit("Z"))


def audio_url(seat: Column) -> Column:
    """The address of a seat's recording, the seat encoded as a component of a URI."""
    code = F.replace(F.url_encode(seat), F.lit("+"), F.lit("%20"))
    for plain, encoded in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        code = F.replace(code, F.lit(encoded), F.lit(plain))
    return F.concat(F.lit("/audio/"), code, F.lit(".wav"))


def clean_threshold(c: Column, default: float) -> Column:
    """A threshold from text: what is unset, empty or not finite gives the default; then held within 0 and 1."""
    value = strip(c.cast("string")).try_cast("double")
    value = F.when(F.abs(value) < float("inf"), value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(float(default)))))


def preview(items: Column, n: int) -> Column:
    """The first n items."""
    return F.slice(items, 1, n)


def attempt_label(n: Column) -> Column:
    return F.format_string("try_%04d", n)


def attempt_number(label: Column) -> Column:
    """The number in a label, or null."""
    return F.regexp_extract(label, r"try_([0-9]+)", 1).try_cast("int")


def request_failed(status: Column, readable: Column, error: Column, elapsed_ms: Column, timeout_ms: Column) -> Column:
    """Not a 2xx status, an unreadable body, a non-blank error, or too long (500 ms is always allowed)."""
    bad = ~status.between(200, 299) | ~readable | (strip(F.coalesce(error, F.lit(""))) != "") | (elapsed_ms > F.greatest(F.lit(500), timeout_ms))
    return F.coalesce(bad, F.lit(True))


def request_failure_message(status: Column, error: Column) -> Column:
    """The error text if it isn't blank, else a text with the status."""
    return F.coalesce(F.nullif(strip(error), F.lit("")), F.concat(F.lit("OCR backend returned "), status.cast("string")))


def resolve_path(path: Column, folder: str) -> Column:
    """Relative paths are taken from the folder of the manifest. A leading `~` is the home of whoever starts the job; repeated
    slashes and parts that are a single dot go."""
    home = os.path.expanduser("~")
    at_home = F.when(path == "~", F.lit(home)).when(path.startswith("~/"), F.concat(F.lit(home), F.substr(path, F.lit(2)))).otherwise(path)
    plain = F.regexp_replace(F.regexp_replace(at_home, r"/(?:\.?/)+", "/"), r"^(?:\./)+|(?<=.)/\.?$", "")
    return F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), plain))


def plain_path(path: Column) -> Column:
    """A file's path without scheme and host, so that file:/a, hdfs://host/a and /a are the same file."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*", "/")
