"""Market catalogue pages and the market dimension."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.catalog import active_markets
from tickloom.operators.keyed import latest_per_key
from tickloom.schemas import MARKET_PAGE, RECORD_VERSION

# A JSON array of texts (or null), as it must appear inside the page's strings.
_TEXT_ARRAY = r'^\s*(null|\[\s*("([^"\\]|\\.)*"(\s*,\s*"([^"\\]|\\.)*")*)?\s*\])\s*$'


def read_market_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed catalogue pages (each file one JSON array), active markets only."""
    pages = spark.read.schema(MARKET_PAGE).option("multiLine", True).json(path)
    return active_markets(pages)


def normalize_markets(pages: DataFrame, mode: str = "failfast") -> DataFrame:
    """Page rows to market rows; the condition id is the market id.

    The two lists arrive as JSON inside strings. ``failfast`` stops at a list that
    does not decode; ``permissive`` keeps the row with null lists and says why in
    ``error``.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError(f"unknown mode {mode!r}")

    def bad(c: str):
        return (F.coalesce(F.col(c), F.lit("")) != "") & ~F.col(c).rlike(_TEXT_ARRAY)

    def texts(c: str):
        return F.when(~bad(c), F.from_json(F.nullif(F.col(c), F.lit("")), "array<string>"))

    if mode == "failfast":
        # A condition on the row: no projection above can prune it.
        for c in ("outcomes", "clobTokenIds"):
            broken = F.concat(F.lit(f"cannot decode {c} of market "), F.coalesce("id", F.lit("")))
            pages = pages.filter(F.when(bad(c), F.raise_error(broken).cast("boolean")).otherwise(F.lit(True)))
    empty, off = F.lit(""), F.lit(False)
    out = pages.select(
        F.lit(RECORD_VERSION).alias("v"), F.coalesce("conditionId", empty).alias("market_id"),
        F.coalesce("question", empty).alias("question"), F.coalesce("slug", empty).alias("slug"),
        F.coalesce("endDate", empty).alias("end_date"), F.lit("").alias("category"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.coalesce("volumeNum", F.lit(0.0)).alias("volume"),
        F.coalesce("active", off).alias("active"), F.coalesce("closed", off).alias("closed"),
        texts("outcomes").alias("outcomes"), texts("clobTokenIds").alias("clob_token_ids"),
        *([F.when(bad("outcomes"), "outcomes").when(bad("clobTokenIds"), "clobTokenIds").alias("error")]
          if mode == "permissive" else []),
    )
    return out


def read_markets_catalog(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    return normalize_markets(read_market_pages(spark, path), mode)


def market_export(markets: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Newest version of each market as JSON text, one row per market."""
    newest = latest_per_key(markets, ("market_id",), order) if order else markets
    rest = [c for c in newest.columns if c not in order]
    return newest.select("market_id", F.to_json(F.struct(*rest)).alias("value"))
