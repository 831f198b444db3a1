"""Field normalisers (B1-B14, B24-B25, B29-B33): built-in column expressions only.

The status-bearing ones return struct<value:string, status:string, reason:string> with status NORMALIZED, SKIPPED,
CONFLICT or UNSUPPORTED. A null input counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"

# Fixed values.
NULL_WORDS = ("unknown", "", "-", ",", "null", "none", "na", "nas")
NO_AGE = ("nas", "no age statement", "no age", "none", "n/a")
REGIONS = {
    "islay": "Islay",
    "highland": "Highland",
    "speyside": "Speyside",
    "lowland": "Lowland",
    "campbeltown": "Campbeltown",
    "islands": "Islands",
    "orkney": "Islands",
    "ireland": "Ireland",
    "japan": "Japan",
    "usa": "USA",
    "usa bourbon": "USA",
    "tennessee": "USA",
    "canada": "Canada",
    "india": "India",
    "taiwan": "Taiwan",
    "australia": "Australia",
    "new zealand": "New Zealand",
    "south africa": "South Africa",
    "england": "England",
    "sweden": "Sweden",
    "france": "France",
    "germany": "Germany",
    "switzerland": "Switzerland",
    "wales": "Wales",
}
COUNTRIES = {
    "scotland": "Scotland",
    "ireland": "Ireland",
    "northern ireland": "Ireland",
    "usa": "USA",
    "united states": "USA",
    "japan": "Japan",
    "canada": "Canada",
    "india": "India",
    "taiwan": "Taiwan",
    "australia": "Australia",
    "new zealand": "New Zealand",
    "south africa": "South Africa",
    "england": "England",
    "sweden": "Sweden",
    "france": "France",
    "germany": "Germany",
    "switzerland": "Switzerland",
    "wales": "Wales",
    "netherlands": "Netherlands",
    "denmark": "Denmark",
    "iceland": "Iceland",
}
AXES = ("smoky", "peaty", "fruity", "sweet", "spicy", "maritime", "sherry")
MARKERS = ("nose", "palate", "finish", "conclusion", "overall", "comment")
# Field names by the pattern that is found in them, in order of precedence.
FIELD_PATTERNS = {
    "abv": r"(?:^|:|\s)abv\b",
    "product_name": r"(?:^|:|\s)(?:product|name|whisky|whiskey|bottle)\s*(?:_|name)?",
    "source_identifier": r"(?:^|:|\s)source\s*_?id(?:entifier)?",
    "flavor_axis": r"(?:^|:|\s)(?:smoky|peaty|fruity|sweet|spicy|maritime|sherry)\b",
    "nose": r"(?:^|:|\s)nose\b",
    "palate": r"(?:^|:|\s)palate\b",
    "finish": r"(?:^|:|\s)finish\b",
    "rating": r"(?:^|:|\s)rating\b",
    "age": r"(?:^|:|\s)(?:age|year)\b",
    "region": r"(?:^|:|\s)region\b",
    "country": r"(?:^|:|\s)country\b",
}
# What values look like.
PERCENT = r"(-?)(\d{1,3}(?:\.\d+)?)\s*%"
SCORE = r"(\d{1,3}(?:\.\d+)?)"
YEARS = r"(?i)(\d{1,3})\s*(?:year\s*(?:old)?|yo|y\b)"
REGION_NOTE = r"(?i)\s*\([^)]*region[^)]*\)\s*"
SCORE_IN_PROSE = r"(?i)(?:score|rating)[:\s]+(\d{1,3})(?:[/\s]*(\d{2,3}))?"

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def stripped(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACE))


def number(c: Column) -> Column:
    """The number a whole text spells, else null."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def made(value: Column | None, status: str = "NORMALIZED", reason: Column | str | None = None) -> Column:
    reason = F.lit(reason) if reason is None or isinstance(reason, str) else reason
    value = F.lit(None) if value is None else value
    return F.struct(value.cast("string").alias("value"), F.lit(status).alias("status"), reason.cast("string").alias("reason"))


def unparsed(what: str, raw: Column) -> Column:
    return made(None, "CONFLICT", F.concat(F.lit(f"{what}: '"), raw, F.lit("'")))


def null_words(c: Column) -> Column:
    """B1: trimmed text, null for words that mean nothing."""
    t = F.btrim(c, F.lit(SPACE))
    return F.when(~F.lower(t).isin(*NULL_WORDS), t)


def safe_number(c: Column, kind: str = "double") -> Column:
    """B2: struct<value, error>: the digits, dots and signs of a text as a number; an integer goes through a double."""
    left = F.regexp_replace(c, r"[^\d.\-]", "")
    ok = left.rlike(r"^-?([0-9]+[.]?[0-9]*|[.][0-9]+)$")
    value = F.when(ok, left.try_cast("double"))
    value = value.cast("long") if kind == "long" else value
    error = F.when(c.isNull() | ok, F.lit(None)).when(left.isin("", "-", "."), F.lit("no number")).otherwise(F.lit("not castable"))
    return F.struct(value.alias("value"), error.cast("string").alias("error"))


def enum(c: Column, allowed: tuple[str, ...]) -> Column:
    """struct<value, error>."""
    low = F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    bad = F.concat(F.lit("invalid value '"), c, F.lit("'"))
    return F.struct(F.when(low.isin(*allowed), low).alias("value"), F.when(~low.isin(*allowed), bad).alias("error"))


def split_values(c: Column, separators: str = r"[&,/;]+") -> Column:
    """Parts of a text, trimmed, empty ones left out; a JSON array of strings is taken as it is."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separators), lambda x: F.btrim(x, F.lit(SPACE))), lambda x: x != "")
    listed = F.when(c.startswith("[") & c.endswith("]"), F.from_json(c, "array<string>"))
    return F.coalesce(F.transform(listed, lambda x: F.btrim(x, F.lit(SPACE))), parts)


def split_urls(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), r"[\s,;|]+")
    return F.filter(parts, lambda x: x != "")


def abv(c: Column) -> Column:
    """The first ``n%``, as it is spelt; a bare number within 0..100."""
    raw = stripped(c)
    sign, digits = F.regexp_extract(raw, PERCENT, 1), F.regexp_extract(raw, PERCENT, 2)
    value, bare = digits.try_cast("double"), number(raw)
    return (
        F.when(raw == "", made(None, "SKIPPED"))
        .when((digits != "") & (sign == "-"), made(None, "CONFLICT", F.concat(F.lit("strength below 0: "), digits)))
        .when((digits != "") & (value > 100), made(None, "CONFLICT", F.concat(F.lit("strength above 100: "), value.cast("string"))))
        .when(digits != "", made(digits))
        .when(bare.between(0, 100), made(bare.cast("string")))
        .otherwise(unparsed("no strength in", raw))
    )


def clean_name(c: Column) -> Column:
    s = F.regexp_replace(F.lower(stripped(c)), "[_\"'`]+", " ")
    s = F.btrim(F.regexp_replace(s, r"\s+", " "))
    return F.replace(s, F.lit(" & "), F.lit(" and "))


def name(c: Column) -> Column:
    """B6."""
    return F.when(stripped(c) == "", made(None, "SKIPPED")).otherwise(made(clean_name(c)))


def storage_scale(c: Column) -> Column:
    """0..1 as a double; what is above 1 counts as percent; null if not a number."""
    v = number(stripped(c.cast("string")))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v))) + v * 0


def axis_value(c: Column) -> Column:
    raw = stripped(c)
    v = storage_scale(c)
    text = F.format_string("%.2f", F.bround(v, 2))
    return F.when(raw == "", made(None, "SKIPPED")).when(v.isNull(), unparsed("axis is no number", raw)).otherwise(made(text))


def profile_scale(c: Column) -> Column:
    """0..100 as an integer, halves to even; what is 1 or less counts as a fraction."""
    v = number(stripped(c.cast("string")))
    scaled = F.bround(F.when(v <= 1, v * 100).otherwise(v), 0)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), scaled))).cast("int")


def tidy(c: Column) -> Column:
    """White space collapsed, case kept."""
    raw = stripped(c)
    return F.when(raw == "", made(None, "SKIPPED")).otherwise(made(F.regexp_replace(raw, r"\s+", " ")))


def rating(c: Column, strict: bool = False) -> Column:
    """0..100. A value of 10 or less with ``/10`` in the text counts tenfold, ``8/100`` included unless ``strict``."""
    raw = stripped(c)
    digits = F.regexp_extract(raw, SCORE, 1)
    v = digits.try_cast("double")
    tenth = raw.rlike(r"/\s*10(?!\d)") if strict else raw.contains("/10")
    v = F.when((v <= 10) & tenth, v * 10).otherwise(v)
    return (
        F.when(raw == "", made(None, "SKIPPED"))
        .when(digits == "", unparsed("no score in", raw))
        .when(v > 100, made(None, "CONFLICT", F.concat(F.lit("score above 100: "), v.cast("string"))))
        .otherwise(made(F.bround(v, 0).cast("int").cast("string")))
    )


def age(c: Column) -> Column:
    """B11."""
    raw = stripped(c)
    digits = F.regexp_extract(raw, YEARS, 1)
    bare = F.floor(number(raw)).cast("long")
    return (
        F.when(raw == "", made(None, "SKIPPED"))
        .when(F.lower(raw).isin(*NO_AGE), made(F.lit("0")))
        .when(digits != "", made(digits))
        .when(bare.between(1, 100), made(bare.cast("string")))
        .otherwise(unparsed("no age in", raw))
    )


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def region(c: Column) -> Column:
    """The map, else its first key that begins the value or that the value begins (an empty value: the first)."""
    raw = stripped(c)
    key = F.lower(F.btrim(F.regexp_replace(raw, REGION_NOTE, ""), F.lit(SPACE)))
    first = F.get(F.filter(F.array(*map(F.lit, REGIONS)), lambda k: F.startswith(key, k) | F.startswith(k, key)), F.lit(0))
    exact, near = _lookup(REGIONS, key), _lookup(REGIONS, first)
    return (
        F.when(raw == "", made(None, "SKIPPED"))
        .when(exact.isNotNull(), made(exact))
        .when((key == "") & near.isNotNull(), made(near, reason="empty after cleaning"))
        .when(near.isNotNull(), made(near))
        .otherwise(unparsed("no such region", raw))
    )


def country(c: Column) -> Column:
    """B13."""
    raw = stripped(c)
    found = _lookup(COUNTRIES, F.lower(raw))
    return (
        F.when(raw == "", made(None, "SKIPPED")).when(found.isNotNull(), made(found)).otherwise(unparsed("no such country", raw))
    )


def locale_lower(c: Column) -> Column:
    """Lower case with the Turkish dotted and dotless i told apart."""
    return F.lower(F.translate(c, "İI", "iı"))


def noisy(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Under four characters, a stop word, or over 30 percent of it no letters."""
    t = stripped(c)
    others = F.length(F.regexp_replace(t, "[A-Za-z]", ""))
    return (F.length(t) < 4) | F.lower(t).isin(*(stop or ("",))) | (10 * others > 3 * F.length(t))


def slug(c: Column, empty: str = "other") -> Column:
    """B31."""
    s = F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", empty).otherwise(s)


def repaired_abv(c: Column) -> Column:
    """A text such as ``46,3%`` as a number."""
    t = F.replace(F.regexp_replace(stripped(c), "%", ""), F.lit(","), F.lit("."))
    return number(F.btrim(t))


def score_in_prose(text: Column) -> Column:
    """struct<value, scale_max, normalized> of ``score: 89/100`` or ``rating 8``."""
    v = F.regexp_extract(text, SCORE_IN_PROSE, 1).try_cast("double")
    given = F.regexp_extract(text, SCORE_IN_PROSE, 2).try_cast("double")
    scale = F.coalesce(given, F.when(v > 10, 100.0).otherwise(10.0))
    scale = F.when(v > scale, 100.0).otherwise(scale)
    normal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / scale))
    return F.when(v.isNotNull(), F.struct(v.alias("value"), scale.alias("scale_max"), normal.alias("normalized")))


def section(text: Column, marker: str, most: int = 1000) -> Column:
    """What follows ``marker`` up to the first of MARKERS, in their order, that occurs in it."""
    low = F.lower(text)
    at = F.locate(marker, low)
    rest = F.substring(text, at + len(marker), F.length(text))
    cut = reduce(
        lambda other, m: F.when(F.locate(m, F.lower(rest)) > 1, F.substring(rest, F.lit(1), F.locate(m, F.lower(rest)) - 1)).otherwise(other),
        reversed(MARKERS),
        rest,
    )
    body = F.substring(F.btrim(F.regexp_replace(F.lower(cut), r"\s+", " ")), 1, most)
    return F.when((at > 0) & (body != ""), body)


# Name, builder, field pattern; the first pattern that is found in the field name decides.
REGISTRY: list[tuple[str, object, str]] = []


def register(key: str, build, pattern: str) -> None:
    """M1: add a normaliser (Column to status struct) for field names that ``pattern`` is found in."""
    REGISTRY.append((key, build, pattern))


BUILDERS = {
    "abv": abv,
    "product_name": name,
    "source_identifier": name,
    "flavor_axis": axis_value,
    "nose": tidy,
    "palate": tidy,
    "finish": tidy,
    "rating": rating,
    "age": age,
    "region": region,
    "country": country,
}
for _key, _pattern in FIELD_PATTERNS.items():
    register(_key, BUILDERS[_key], _pattern)


def dispatch(field: Column, value: Column, registry=None) -> Column:
    """struct<field_type, value, status, reason> of any field; one pass, no Python."""
    none = made(None, "UNSUPPORTED", F.concat(F.lit("nothing normalises field '"), field, F.lit("'")))
    kind, out = F.lit("unknown"), none
    for key, build, pattern in reversed(registry or REGISTRY):
        hit = field.rlike("(?i)" + pattern)
        kind, out = F.when(hit, F.lit(key)).otherwise(kind), F.when(hit, build(value)).otherwise(out)
    return F.struct(kind.alias("field_type"), out["value"].alias("value"), out["status"].alias("status"), out["reason"].alias("reason"))
