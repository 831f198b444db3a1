"""Section B: scalar operators over texts derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import normalize as N

from . import Catalog, table

C = Catalog()

_T = "trim(coalesce(raw, ''))"
_NUM = "CASE WHEN regexp_matches({0}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast({0} AS DOUBLE) END"


def scalar(name: str, raw: str, build, sql: str, cols: str = "part") -> None:
    """A query (p_partkey, raw, and what ``build`` makes of raw), and its SQL over the same raw."""

    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(raw).alias("raw"))
        made = build(F.col("raw"))
        if isinstance(made, dict):
            return rows.select("p_partkey", "raw", *[c.alias(k) for k, c in made.items()])
        return rows.select("p_partkey", "raw", made.alias("o")).select("p_partkey", "raw", "o.*")

    C.add(name, f"WITH r AS (SELECT p_partkey, {raw} AS raw FROM part) SELECT p_partkey, raw, {sql} FROM r")(run)


def status_sql(*branches: tuple[str, str, str, str]) -> str:
    """CASE columns value, status, reason from (condition, value, status, reason)."""
    out = []
    for i, col in enumerate(("value", "status", "reason"), 1):
        out.append("CASE " + " ".join(f"WHEN {b[0]} THEN {b[i]}" for b in branches) + f" END AS {col}")
    return ", ".join(out)


def unparsed(what: str) -> tuple[str, str, str, str]:
    return ("TRUE", "NULL", "'CONFLICT'", f"'{what}: ''' || {_T} || ''''")


EMPTY = (f"{_T} = ''", "NULL", "'SKIPPED'", "NULL")

scalar(
    "b1_null_words",
    "CASE p_partkey % 5 WHEN 0 THEN '  NA ' WHEN 1 THEN '-' WHEN 2 THEN p_name WHEN 3 THEN 'Unknown' ELSE concat(' ', p_brand) END",
    lambda c: {"cleaned": N.null_words(c)},
    "CASE WHEN lower(trim(raw)) NOT IN ('unknown','','-',',','null','none','na','nas') THEN trim(raw) END AS cleaned",
)
scalar(
    "b2_safe_number",
    "CASE p_partkey % 6 WHEN 0 THEN concat('$ ', p_retailprice) WHEN 1 THEN 'none' WHEN 2 THEN concat(p_size, ' cl') WHEN 3 THEN '1.2.3' WHEN 4 THEN '-' ELSE concat(p_size, '-') END",
    lambda c: N.safe_number(c),
    "CASE WHEN regexp_matches(regexp_replace(raw,'[^0-9.\\-]','','g'), '^-?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN try_cast(regexp_replace(raw,'[^0-9.\\-]','','g') AS DOUBLE) END AS value, "
    "CASE WHEN raw IS NULL OR regexp_matches(regexp_replace(raw,'[^0-9.\\-]','','g'), '^-?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN NULL "
    "WHEN regexp_replace(raw,'[^0-9.\\-]','','g') IN ('','-','.') THEN 'no number' ELSE 'not castable' END AS error",
)
scalar(
    "b3_enum",
    "CASE p_partkey % 4 WHEN 0 THEN 'Single Cask' WHEN 1 THEN 'blend' WHEN 2 THEN p_type ELSE NULL END",
    lambda c: N.enum(c, ("single_cask", "blend", "official")),
    "CASE WHEN replace(lower(raw),' ','_') IN ('single_cask','blend','official') THEN replace(lower(raw),' ','_') END AS value, "
    "CASE WHEN replace(lower(raw),' ','_') NOT IN ('single_cask','blend','official') THEN 'invalid value ''' || raw || '''' END AS error",
)
scalar(
    "b4_split_values",
    "CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' & ', p_brand, '/', p_size) WHEN 1 THEN '[\"oak\", \" sherry \"]' WHEN 2 THEN ' ,; ' ELSE p_name END",
    lambda c: {"parts": F.array_join(N.split_values(c), "|"), "n": F.size(N.split_values(c))},
    "CASE WHEN raw LIKE '[%]' THEN 'oak|sherry' ELSE array_to_string(list_filter(list_transform(regexp_split_to_array(raw,'[&,/;]+'), lambda x: trim(x)), lambda x: x <> ''),'|') END AS parts, "
    "CASE WHEN raw LIKE '[%]' THEN 2 ELSE len(list_filter(list_transform(regexp_split_to_array(raw,'[&,/;]+'), lambda x: trim(x)), lambda x: x <> ''))::INT END AS n",
)
_ABV = r"'(-?)(\d{1,3}(?:\.\d+)?)\s*%'"
_D = f"regexp_extract({_T}, {_ABV}, 2)"
scalar(
    "b5_abv",
    "CASE p_partkey % 7 WHEN 0 THEN concat(p_size, '.5% ABV') WHEN 1 THEN concat('-', p_size, '%') WHEN 2 THEN concat(p_size + 90, '%') WHEN 3 THEN concat('', p_size) WHEN 4 THEN '' WHEN 5 THEN 'N/A' ELSE concat(p_size + 90, '') END",
    N.abv,
    status_sql(
        EMPTY,
        (f"{_D} <> '' AND regexp_extract({_T}, {_ABV}, 1) = '-'", "NULL", "'CONFLICT'", f"'strength below 0: ' || {_D}"),
        (f"{_D} <> '' AND try_cast({_D} AS DOUBLE) > 100", "NULL", "'CONFLICT'", f"'strength above 100: ' || try_cast({_D} AS DOUBLE)::VARCHAR"),
        (f"{_D} <> ''", _D, "'NORMALIZED'", "NULL"),
        (f"({_NUM.format(_T)}) BETWEEN 0 AND 100", f"({_NUM.format(_T)})::VARCHAR", "'NORMALIZED'", "NULL"),
        unparsed("no strength in"),
    ),
)
_NAME = "replace(trim(regexp_replace(regexp_replace(lower(" + _T + "), '[_\"''`]+', ' ', 'g'), '\\s+', ' ', 'g')), ' & ', ' and ')"
scalar(
    "b6_name",
    "CASE p_partkey % 4 WHEN 0 THEN concat('  \"', p_name, '\"_', p_brand) WHEN 1 THEN concat(p_name, ' & ', p_type) WHEN 2 THEN '' ELSE concat('The  ', p_name) END",
    N.name,
    status_sql(EMPTY, ("TRUE", _NAME, "'NORMALIZED'", "NULL")),
)
_AX = "CASE p_partkey % 6 WHEN 0 THEN concat(p_size, '') WHEN 1 THEN concat('0.', p_size) WHEN 2 THEN 'abc' WHEN 3 THEN '-3' WHEN 4 THEN '150' ELSE '' END"
_V = _NUM.format(_T)
_S = f"greatest(0.0, least(1.0, CASE WHEN ({_V}) > 1 THEN ({_V}) / 100 ELSE ({_V}) END))"
scalar(
    "b7_storage_scale",
    _AX,
    lambda c: {"scaled": N.storage_scale(c), "status": N.axis_value(c)["status"], "value": N.axis_value(c)["value"]},
    f"CASE WHEN ({_V}) IS NOT NULL THEN {_S} END::DOUBLE AS scaled, CASE WHEN {_T} = '' THEN 'SKIPPED' WHEN ({_V}) IS NULL THEN 'CONFLICT' ELSE 'NORMALIZED' END AS status, "
    f"CASE WHEN ({_V}) IS NOT NULL THEN printf('%.2f', round_even({_S}, 2)) END AS value",
)
scalar(
    "b8_profile_scale",
    _AX,
    lambda c: {"scaled": N.profile_scale(c)},
    f"CASE WHEN ({_V}) IS NOT NULL THEN greatest(0, least(100, round_even(CASE WHEN ({_V}) <= 1 THEN ({_V}) * 100 ELSE ({_V}) END, 0)))::INT END AS scaled",
)
scalar(
    "b9_tidy",
    "CASE p_partkey % 3 WHEN 0 THEN concat('  ', p_name, '   and ', p_type) WHEN 1 THEN ' ' ELSE p_type END",
    N.tidy,
    status_sql(EMPTY, ("TRUE", f"regexp_replace({_T}, '\\s+', ' ', 'g')", "'NORMALIZED'", "NULL")),
)
_RD = f"regexp_extract({_T}, '(\\d{{1,3}}(?:\\.\\d+)?)', 1)"
_RV = f"CASE WHEN try_cast({_RD} AS DOUBLE) <= 10 AND contains({_T}, '/10') THEN try_cast({_RD} AS DOUBLE) * 10 ELSE try_cast({_RD} AS DOUBLE) END"
scalar(
    "b10_rating",
    "CASE p_partkey % 6 WHEN 0 THEN concat(p_size + 50, '/100') WHEN 1 THEN concat(p_size % 10, '.5/10') WHEN 2 THEN concat(p_size * 4, ' points') WHEN 3 THEN '8/100' WHEN 4 THEN 'good' ELSE '' END",
    N.rating,
    status_sql(
        EMPTY,
        (f"{_RD} = ''", "NULL", "'CONFLICT'", f"'no score in: ''' || {_T} || ''''"),
        (f"({_RV}) > 100", "NULL", "'CONFLICT'", f"'score above 100: ' || ({_RV})::VARCHAR"),
        ("TRUE", f"round_even({_RV}, 0)::INT::VARCHAR", "'NORMALIZED'", "NULL"),
    ),
)
_AD = f"regexp_extract({_T}, '(?i)(\\d{{1,3}})\\s*(?:year\\s*(?:old)?|yo|y\\b)', 1)"
scalar(
    "b11_age",
    "CASE p_partkey % 7 WHEN 0 THEN concat(p_size, ' Year Old') WHEN 1 THEN concat(p_size, 'yo') WHEN 2 THEN 'NAS' WHEN 3 THEN concat(p_size, '.7') WHEN 4 THEN concat(p_size + 90, '') WHEN 5 THEN p_name ELSE ' ' END",
    N.age,
    status_sql(
        EMPTY,
        (f"lower({_T}) IN ('nas','no age statement','no age','none','n/a')", "'0'", "'NORMALIZED'", "NULL"),
        (f"{_AD} <> ''", _AD, "'NORMALIZED'", "NULL"),
        (f"floor({_V}) BETWEEN 1 AND 100", f"floor({_V})::INT::VARCHAR", "'NORMALIZED'", "NULL"),
        unparsed("no age in"),
    ),
)
_KEY = f"lower(trim(regexp_replace({_T}, '(?i)\\s*\\([^)]*region[^)]*\\)\\s*', '', 'g')))"
_LIST = lambda m: "[" + ",".join(f"'{k}'" for k in m) + "]"
_MAP = lambda m: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"
_NEAR = f"list_filter({_LIST(N.REGIONS)}, lambda k: starts_with({_KEY}, k) OR starts_with(k, {_KEY}))[1]"
scalar(
    "b12_region",
    "CASE p_partkey % 7 WHEN 0 THEN 'Islay' WHEN 1 THEN 'Highlands' WHEN 2 THEN 'Speyside (region)' WHEN 3 THEN '(Region)' WHEN 4 THEN 'new' WHEN 5 THEN p_brand ELSE '' END",
    N.region,
    status_sql(
        EMPTY,
        (f"{_MAP(N.REGIONS)}[{_KEY}] IS NOT NULL", f"{_MAP(N.REGIONS)}[{_KEY}]", "'NORMALIZED'", "NULL"),
        (f"{_KEY} = ''", "'Islay'", "'NORMALIZED'", "'empty after cleaning'"),
        (f"{_NEAR} IS NOT NULL", f"{_MAP(N.REGIONS)}[{_NEAR}]", "'NORMALIZED'", "NULL"),
        unparsed("no such region"),
    ),
)
scalar(
    "b13_country",
    "CASE p_partkey % 4 WHEN 0 THEN ' Scotland ' WHEN 1 THEN 'UNITED STATES' WHEN 2 THEN p_brand ELSE '' END",
    N.country,
    status_sql(
        EMPTY,
        (f"{_MAP(N.COUNTRIES)}[lower({_T})] IS NOT NULL", f"{_MAP(N.COUNTRIES)}[lower({_T})]", "'NORMALIZED'", "NULL"),
        unparsed("no such country"),
    ),
)
scalar(
    "b24_score_in_prose",
    "CASE p_partkey % 5 WHEN 0 THEN concat('a fine dram. Score: ', p_size + 50, '/100') WHEN 1 THEN concat('rating ', p_size % 10) WHEN 2 THEN concat('Rating: ', p_size, '/20') ELSE p_name END",
    lambda c: {k: N.score_in_prose(c)[k] for k in ("value", "scale_max", "normalized")},
    "try_cast(regexp_extract(raw, '(?i)(?:score|rating)[:\\s]+(\\d{1,3})', 1) AS DOUBLE) AS value, "
    "CASE p_partkey % 5 WHEN 0 THEN 100.0::DOUBLE WHEN 1 THEN 10.0::DOUBLE WHEN 2 THEN CASE WHEN p_partkey % 5 = 2 AND try_cast(regexp_extract(raw, '(\\d+)', 1) AS DOUBLE) > 20 THEN 100.0::DOUBLE ELSE 20.0::DOUBLE END END AS scale_max, "
    "try_cast(regexp_extract(raw, '(?i)(?:score|rating)[:\\s]+(\\d{1,3})', 1) AS DOUBLE) / CASE p_partkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 10 WHEN 2 THEN CASE WHEN try_cast(regexp_extract(raw, '(\\d+)', 1) AS DOUBLE) > 20 THEN 100 ELSE 20 END END AS normalized",
)
scalar(
    "b25_sections",
    "concat('Nose: ', p_name, '. Palate: ', p_type, ' finish: ', p_brand, ' overall good')",
    lambda c: {m: N.section(c, m) for m in ("nose", "palate", "finish")},
    ", ".join(
        [
            r"trim(regexp_replace(regexp_extract(lower(raw), 'nose(.*?)palate', 1), '\s+', ' ', 'g')) AS nose",
            r"trim(regexp_replace(regexp_extract(lower(raw), 'palate(.*?)finish', 1), '\s+', ' ', 'g')) AS palate",
            r"trim(regexp_replace(regexp_extract(lower(raw), 'finish(.*?)overall', 1), '\s+', ' ', 'g')) AS finish",
        ]
    ),
)
scalar(
    "b29_locale_lower",
    "CASE p_partkey % 3 WHEN 0 THEN concat('İI ', p_name) WHEN 1 THEN upper(p_name) ELSE p_brand END",
    lambda c: {"low": N.locale_lower(c)},
    "lower(translate(raw, 'İI', 'iı')) AS low",
)
scalar(
    "b30_noise",
    "CASE p_partkey % 4 WHEN 0 THEN 'abc' WHEN 1 THEN concat(p_size, '%%', p_size) WHEN 2 THEN 'contents' ELSE p_name END",
    lambda c: {"noisy": N.noisy(c, ("contents", "index"))},
    f"(length({_T}) < 4 OR lower({_T}) IN ('contents','index') OR 10 * length(regexp_replace({_T}, '[A-Za-z]', '', 'g')) > 3 * length({_T})) AS noisy",
)
scalar(
    "b31_slug",
    "CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' & ', p_brand, '!') WHEN 1 THEN '--' ELSE p_type END",
    lambda c: {"slug": N.slug(c)},
    f"CASE WHEN regexp_replace(regexp_replace(lower({_T}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'other' ELSE regexp_replace(regexp_replace(lower({_T}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS slug",
)
scalar(
    "b33_repaired_abv",
    "CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ',3%') WHEN 1 THEN concat(p_size, '.5 %') WHEN 2 THEN 'strong' ELSE concat(p_size, '') END",
    lambda c: {"abv": N.repaired_abv(c)},
    "try_cast(trim(replace(replace(raw, '%', ''), ',', '.')) AS DOUBLE) AS abv",
)


_FIELDS = "abv product_name source_id smoky nose palate finish rating age region country other".split()
_FIELD_SQL = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FIELDS)) + " END"
_VALUE_SQL = "CASE WHEN p_partkey % 36 < 12 THEN concat(p_size, '') WHEN p_partkey % 36 < 24 THEN concat(p_size, '%') ELSE '' END"


@C.add(
    "b14_dispatch",
    f"""WITH r AS (SELECT p_partkey, {_FIELD_SQL} AS field, {_VALUE_SQL} AS raw FROM part),
s AS (SELECT *, CASE field WHEN 'source_id' THEN 'source_identifier' WHEN 'smoky' THEN 'flavor_axis' WHEN 'other' THEN 'unknown' ELSE field END AS field_type,
  try_cast(replace(raw, '%', '') AS INT) AS n, contains(raw, '%') AS pct FROM r)
SELECT p_partkey, field, raw, field_type,
 CASE WHEN field = 'other' OR raw = '' THEN NULL WHEN field = 'abv' THEN CASE WHEN pct THEN n::VARCHAR ELSE n || '.0' END
  WHEN field IN ('product_name','source_id','nose','palate','finish') THEN raw
  WHEN field = 'smoky' AND NOT pct THEN printf('%.2f', CASE WHEN n > 1 THEN n / 100.0 ELSE n END)
  WHEN field = 'rating' OR (field = 'age' AND NOT pct) THEN n::VARCHAR END AS value,
 CASE WHEN field = 'other' THEN 'UNSUPPORTED' WHEN raw = '' THEN 'SKIPPED' WHEN field IN ('region','country') OR (field IN ('smoky','age') AND pct) THEN 'CONFLICT' ELSE 'NORMALIZED' END AS status
FROM s""",
)
def b14(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_FIELD_SQL).alias("field"), F.expr(_VALUE_SQL).alias("raw"))
    out = N.dispatch(F.col("field"), F.col("raw"))
    return rows.select("p_partkey", "field", "raw", out.alias("o")).select("p_partkey", "field", "raw", "o.field_type", "o.value", "o.status")
