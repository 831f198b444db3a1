"""Keys, match texts and features of names (B15-B20, B26-B27, A13): built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements for spelling and number words, in order; words that carry no identity; kept words; patterns of what names say.
SPELLING = (
    ("laphroig", "laphroaig"),
    ("glenfraclas", "glenfarclas"),
    ("kilochman", "kilchoman"),
    ("clynliesh", "clynelish"),
    ("jonnie walker", "johnnie walker"),
    ("glenkinnchie", "glenkinchie"),
    ("glen garrioch", "glen garioch"),
    ("y.o.", "year"),
    ("yo", "year"),
    ("year old", "year"),
    ("years old", "year"),
    ("yrs", "year"),
    ("yr", "year"),
    ("ten", "10"),
    ("twelve", "12"),
    ("fifteen", "15"),
    ("eighteen", "18"),
    ("twenty one", "21"),
    ("twenty five", "25"),
    ("thirty", "30"),
    ("forty", "40"),
    ("cs", "cask strength"),
    ("a'bunadh", "abunadh"),
)
DISTINCTIVE = ("dusgadh", "general", "legacy", "alpha", "portonova")
GENERIC = ("whisky", "whiskey", "scotch", "single malt", "straight bourbon", "kentucky", "limited edition", "release", "blended", "malt")
STOP = ("the", "a", "an", "and", "by", "of", "at", "de", "le", "la", "das", "der", "di", "da", "del", "les", "el")
CASKS = ("sherry", "port", "rum", "wine", "cask finish", "wood finish", "amarone", "lustau", "madera", "bourbon")
MATCH_STEPS = (
    (r"\(?distilled\s+\d{4}\)?", ""),
    (r"bottled\s+\d{4}", ""),
    (r"\d{4}\s+vintage", ""),
    (r"vintage\s+\d{4}", ""),
    (r"(\d+)\s*y(?:ears?)?\s*o(?:ld)?\.?", "$1"),
    (r"(\d+)\s*yo", "$1"),
)
FEATURE_PATTERNS = {
    "year": r"\b(\d+)\s*year\b",
    "usual age": r"\b(10|12|15|18|21|25|30|40)\b",
    "vintage": r"\b(19\d{2}|20\d{2})\b",
    "release": r"\b(\d+)(?:st|nd|rd|th)\s*release\b",
    "batch": r"\bbatch\s*([a-z0-9]+)\b",
    "cask": r"\bcask\s*(\d+)\b",
}
AGE_IN_NAME = r"\b(\d+)\s*(?:yo|years?|yr)\b"
ORDINAL_IN_NAME = r"\b(\d+)(?:st|nd|rd|th)\b"
NAME_AGE = r"\b(\d{1,2})\b\s*(?:years|year|yo|y\.o\.|y|old)"
NAME_ABV = r"\b(\d{2}(?:\.\d+)?)\s*(?:%|vol)\b"
BATCH_WORDS = ("batch", "release", "edition", "cask strength", "ltd", "limited", "single cask", "bottled", "distilled")


def _chain(c: Column, steps) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def name_key(c: Column, variant: str = "alnum", suffixes: tuple[str, ...] = ()) -> Column:
    """``alnum`` (letters and digits, no leading the; suffix words go before the spaces do), ``quotes``, ``space``, ``marks``."""
    low = F.lower(F.coalesce(c, F.lit("")))
    if variant == "alnum":
        s = F.regexp_replace(F.regexp_replace(low, "['’]", ""), "^the ", "")
        for word in suffixes:
            s = F.regexp_replace(s, rf"(^|\s){word}(?=\s|$)", "$1")
        return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")
    if variant == "quotes":
        return F.trim(F.regexp_replace(F.trim(_chain(F.trim(low), [("[‘’'\"`]", ""), (r"\bthe\b", "")])), r"\s+", " "))
    if variant == "space":
        return F.regexp_replace(F.trim(low), r"\s+", " ")
    if variant == "marks":
        return F.trim(_chain(low, [(r"[^\p{L}\p{N}\s]", " "), (r"\s+", " ")]))
    raise ValueError(f"no name key called {variant!r}")


def match_text(c: Column) -> Column:
    """B17."""
    s = F.replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\d+(\.\d+)?\s*%", ""), F.lit("cask strength"), F.lit(""))
    steps = [
        *MATCH_STEPS,
        *[(rf"\b{g}\b", "") for g in GENERIC],
        (r"[^a-z0-9\s]", " "),
        (r"\s+", " "),
    ]
    return F.trim(_chain(s, steps))


def spelled(c: Column) -> Column:
    """Known misspellings and number words replaced in order, other signs as spaces; words with an apostrophe before that."""
    quoted = [p for p in SPELLING if "'" in p[0]]
    s = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), quoted, F.lower(F.coalesce(c, F.lit(""))))
    s = F.regexp_replace(s, r"[^a-z0-9\s]", " ")
    return F.trim(_chain(s, [*[(rf"\b{a}\b", b) for a, b in SPELLING if "'" not in a], (r"\s+", " ")]))


def features(c: Column) -> Column:
    """Struct of arrays: age, vintage, release, batch, cask, distinctive; of a text as ``spelled`` makes it."""
    every = lambda name: F.array_distinct(F.regexp_extract_all(c, F.lit(FEATURE_PATTERNS[name]), F.lit(1)))
    ages = F.array_distinct(F.concat(every("year"), every("usual age")))
    return F.struct(
        F.array_sort(ages).alias("age"),
        *[F.array_sort(every(name)).alias(name) for name in ("vintage", "release", "batch", "cask")],
        F.filter(F.array(*map(F.lit, DISTINCTIVE)), lambda w: F.contains(c, w)).alias("distinctive"),
    )


def age_of(c: Column) -> Column:
    """B20."""
    return F.regexp_extract(F.lower(c), NAME_AGE, 1).try_cast("int")


def abv_of(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), NAME_ABV, 1).try_cast("double")


def cask_of(c: Column) -> Column:
    found = F.filter(F.array(*map(F.lit, CASKS)), lambda w: F.contains(F.lower(c), w))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("standard")


def stripped_name(c: Column) -> Column:
    s = _chain(F.lower(c), [(NAME_AGE, ""), (NAME_ABV, "")])
    s = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), BATCH_WORDS, s)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def block_key(text: Column) -> Column:
    """The first token of a match text that is no stop word; the first token if all are."""
    tokens = F.filter(F.split(text, " "), lambda t: t != "")
    kept = F.filter(tokens, lambda t: ~t.isin(*STOP))
    return F.coalesce(F.get(kept, F.lit(0)), F.get(tokens, F.lit(0)), F.lit(""))


def digest_id(*parts: Column, prefix: str = "", length: int = 32, sep: str = ":") -> Column:
    """The first hex digits of a SHA-256 over the parts; a null part counts as empty."""
    text = F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 over the JSON of the columns in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
