"""Catalogue reads: filters, search, paging, facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_LIMIT, MAX_OFFSET = 50, 10_000
# Columns that no public read may show.
FORBIDDEN = frozenset("price price_original price_currency retail_price source_url source_urls source_id provenance reviewer".split())


def active(df: DataFrame, banned: str, texts: tuple[str, ...] = ("brand", "name"), superseded: str = "superseded_by") -> DataFrame:
    """Rows that nothing supersedes and whose texts do not hold the banned word; a null text holds nothing."""
    clean = [~F.contains(F.lower(F.coalesce(F.col(t), F.lit(""))), F.lit(banned.lower())) for t in texts]
    return df.where(reduce(lambda a, b: a & b, clean, F.col(superseded).isNull()))


def holds(text: Column, query: str) -> Column:
    """Literal, case-blind containment; a null text holds nothing."""
    return F.coalesce(F.contains(F.lower(text), F.lit(query.lower())), F.lit(False))


def search(df: DataFrame, query: str, texts: tuple[str, ...], order: list, cap: int = MAX_LIMIT) -> DataFrame:
    """Rows with ``query`` (two characters at least) in any of the texts, first ``cap`` in a total order."""
    if len(query) < 2:
        return df.limit(0)
    found = df.where(reduce(lambda a, b: a | b, (holds(F.col(t), query) for t in texts)))
    return found.orderBy(*order).limit(min(cap, MAX_LIMIT))


def certified_first(text: Column, prefix: str) -> Column:
    """F8: sort key, 0 for texts that begin with ``prefix``."""
    return F.when(F.startswith(text, F.lit(prefix)), 0).otherwise(1)


def chip_filter(chips: str, known: dict[str, Column]) -> Column | None:
    """All known chips of a comma list together; a list of unknown ones only matches nothing, an empty list all."""
    names = [c.strip().lower() for c in chips.split(",") if c.strip()]
    found = [known[c] for c in names if c in known]
    if names and not found:
        return F.lit(False)
    return reduce(lambda a, b: a & b, found) if found else None


def chipped(df: DataFrame, chips: str, known: dict[str, Column]) -> DataFrame:
    condition = chip_filter(chips, known)
    return df if condition is None else df.where(condition)


def page(df: DataFrame, order: list, limit: int = 20, offset: int = 0) -> DataFrame:
    """C4: a page in a total order; the limit is held to 1..50, an offset beyond 10,000 is an error."""
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset {offset} is not within 0..{MAX_OFFSET}")
    return df.orderBy(*order).offset(offset).limit(max(1, min(MAX_LIMIT, limit)))


def allowed(df: DataFrame, allowlist: DataFrame, key: str) -> DataFrame:
    """Rows of listed keys."""
    return df.join(allowlist.select(key).distinct(), key, "left_semi")


def page_with_total(df: DataFrame, order: list, limit: int, offset: int, key: str) -> DataFrame:
    """A page, each row with the number of keys before paging."""
    total = df.agg(F.countDistinct(key).alias("total_count"))
    return page(df, order, limit, offset).crossJoin(F.broadcast(total))  # one row


def fillable(proposals: DataFrame, current: DataFrame, key: str, target: str, source: str, least: float = 0.90) -> DataFrame:
    """Proposals (key, value, confidence, source) for rows whose target is null, from ``source`` and sure enough."""
    ok = (F.trim("value") != "") & (F.col("confidence") >= least) & (F.col("source") == source)
    empty = current.where(F.col(target).isNull()).select(key)
    return proposals.where(ok).join(empty, key, "left_semi")


def facets(dimension: DataFrame, facts: DataFrame, key: str, label: str) -> DataFrame:
    """Labels of the dimension that still have facts."""
    return dimension.join(facts.select(key), key, "left_semi").select(label).distinct()


def redacted(df: DataFrame, forbidden: frozenset[str] = FORBIDDEN) -> DataFrame:
    """Without the columns that must not be shown."""
    return df.drop(*[c for c in df.columns if c.lower() in forbidden])


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """one row per key, the first in ``order``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def catalogue(entities: DataFrame, producers: DataFrame, profiles: DataFrame, producer_key: str, entity_key: str, order: list) -> DataFrame:
    """Entities with producer and one profile each; profiles are made one per entity before the join."""
    one = latest(profiles, entity_key, order)
    return entities.join(one, entity_key, "left").join(producers, producer_key, "left")


def first_wins(df: DataFrame, name: str, order: list) -> DataFrame:
    """one row per case-blind name, the first in ``order``."""
    low = F.lower(F.col(name))
    place = F.row_number().over(Window.partitionBy(low).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
