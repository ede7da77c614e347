"""Text cleaning and comparison as native column expressions (no UDFs)."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.settings import DEFAULTS

# Phrases removed once from the start of a headline, whatever their case.
NOISE_PREFIXES = (
    "breaking:", "breaking news:", "update:",
    "exclusive:", "just in:", "alert:",
)

# What cleaning removes. Character classes are spelled out because the engine's
# own \w and \s are ASCII-only: a word character is a letter, a number or an underscore.
SPACE_CLASS = r"\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}"
TAG_PATTERN = r"<[^>]+>"
URL_PATTERN = rf"https?://[^{SPACE_CLASS}]+|www\.[^{SPACE_CLASS}]+"
SPECIAL_PATTERN = rf"""[^\p{{L}}\p{{N}}_{SPACE_CLASS}.,!?;:'"-]"""
SPACES_PATTERN = rf"[{SPACE_CLASS}]+"
EDGES_PATTERN = rf"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$"

# A character reference: a number in either notation, or a name; old names need no semicolon.
REFERENCE_PATTERN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
# Numbers 128 to 159 stand for what Windows put there, the rest of that row for nothing.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}


def strip(text: Column) -> Column:
    """Remove white space, including non-ASCII spaces, from both ends."""
    return F.regexp_replace(text, EDGES_PATTERN, "")


def blank_to_empty(text: Column) -> Column:
    """Null and white-space-only text becomes the empty string."""
    return F.when(text.rlike(rf"[^{SPACE_CLASS}]"), text).otherwise("")


def strip_markup(text: Column) -> Column:
    """Drop tags, then URLs, then replace special characters by spaces; the order matters."""
    untagged = F.regexp_replace(text, TAG_PATTERN, "")
    unlinked = F.regexp_replace(untagged, URL_PATTERN, "")
    return F.regexp_replace(unlinked, SPECIAL_PATTERN, " ")


def drop_noise_prefix(text: Column) -> Column:
    """Remove one leading noise phrase."""
    phrases = "|".join(NOISE_PREFIXES)
    return F.regexp_replace(text, rf"(?i)\A(?:{phrases})", "")


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES_PATTERN, " "))


def clean(text: Column, max_length: int | None = DEFAULTS.max_headline_length) -> Column:
    """The whole cleaning chain. ``max_length=None`` keeps texts whole."""
    cleaned = collapse_spaces(drop_noise_prefix(strip_markup(blank_to_empty(text))))
    return cleaned if max_length is None else F.substring(cleaned, 1, max_length)


def normalized(text: Column) -> Column:
    """Lower case, trimmed: the form near-duplicate comparison and hashing use."""
    return strip(F.lower(text))


def headline_hash(text: Column) -> Column:
    """MD5 of the normalised headline."""
    return F.md5(normalized(text))


def word_set(text: Column) -> Column:
    """Distinct words of a text; empty for blank text."""
    words = F.split(F.lower(text), SPACES_PATTERN)  # spaces at the ends leave only an empty word
    return F.array_remove(F.array_distinct(words), "")


def set_jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two distinct-word arrays; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    joined = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        F.try_divide(shared, joined)
    )


def _numbered_character(number: Column) -> Column:
    """The character of a code point; the replacement character where there can be none."""
    windows = F.create_map(*[F.lit(v) for pair in _WINDOWS.items() for v in pair])
    code = F.lpad(F.hex(number), 8, "0")
    none = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    silent = number.between(1, 8) | number.between(14, 31) | (number == 11) | (number == 127)
    return (
        F.when(number.between(32, 126), F.char(number)).when(none, "\ufffd").when(silent, "")
        .when(number.between(128, 159), F.try_element_at(windows, number.cast("int")))
        .otherwise(F.decode(F.unhex(code), "UTF-32"))
    )


def unescape(text: Column) -> Column:
    """Every character reference turned into its character, in one pass.

    The names are the public table of the standard library; a name without semicolon counts up to its
    longest old form, and what is no reference stays as it is.
    """
    by_letter: dict[str, list] = {}
    for name, shown in sorted(html5.items()):
        by_letter.setdefault(name[0], []).extend([F.lit(name), F.lit(shown)])
    names = F.create_map(*[c for k, v in by_letter.items() for c in (F.lit(k), F.create_map(*v))])
    # Each step is a transform of its own, which computes what the next one reads several times only once.
    references = F.regexp_extract_all(text, F.lit(REFERENCE_PATTERN), F.lit(0))

    def number(reference: Column) -> Column:
        digits = F.regexp_replace(reference, "[&#xX;]", "")
        decimal = digits.try_cast("decimal(20,0)").try_cast("bigint")
        hexadecimal = F.when(F.length(digits) <= 8, F.conv(digits, 16, 10).try_cast("bigint"))
        return F.when(reference.startswith("&#"), F.when(reference.rlike("^&#[xX]"), hexadecimal).otherwise(decimal))

    def own(name: Column) -> Column:
        return F.try_element_at(names, F.substring(name, F.lit(1), F.lit(1)))

    def shown(name: Column, of: Column) -> Column:
        """The longest known start of ``name`` as its character, and the rest of the name; null if there is none."""
        ends = F.sequence(F.length(name) - 1, F.lit(1), F.lit(-1))
        known = F.filter(ends, lambda n: F.try_element_at(of, F.substring(name, F.lit(1), n)).isNotNull())
        return F.get(F.transform(F.slice(known, 1, 1), lambda n: F.concat(
            F.try_element_at(of, F.substring(name, F.lit(1), n)), F.substring(name, n + 1, F.length(name))
        )), F.lit(0))

    numbers = F.transform(references, lambda r: F.struct(
        r.alias("reference"), r.startswith("&#").alias("numbered"), number(r).alias("number"),
        F.when(~r.startswith("&#"), F.substring(r, F.lit(2), F.length(r))).alias("name"),
    ))
    maps = F.transform(numbers, lambda s: F.struct(
        s["reference"].alias("reference"), s["numbered"].alias("numbered"), s["number"].alias("number"),
        s["name"].alias("name"), own(s["name"]).alias("own"),
    ))
    characters = F.transform(maps, lambda s: F.when(s["numbered"], _numbered_character(s["number"])).otherwise(
        F.coalesce(
            F.try_element_at(s["own"], s["name"]),
            F.when(F.length(s["name"]) > 1, shown(s["name"], s["own"])), s["reference"],
        )
    ))
    joined = F.array_join(F.transform(
        F.arrays_zip(F.split(text, REFERENCE_PATTERN, -1).alias("before"), characters.alias("character")),
        lambda s: F.concat(s["before"], F.coalesce(s["character"], F.lit(""))),
    ), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def html_to_text(markup: Column) -> Column:
    """Tags removed, then every character reference turned into its character."""
    return unescape(F.regexp_replace(markup, TAG_PATTERN, ""))


def preview(text: Column, length: int = 80) -> Column:
    """The first characters of a headline, for hover labels."""
    return F.substring(text, 1, length)


def symbol(ticker: Column) -> Column:
    """Feed symbol of a ticker: the part before the first dot, no dashes, upper case."""
    return F.upper(F.replace(F.split_part(ticker, F.lit("."), F.lit(1)), F.lit("-"), F.lit("")))
