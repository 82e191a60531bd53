"""Cleaning the raw sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import MISSING_TEXT, strip
from tallybook.model import COPIES, CORRUPT, RAW_COLUMNS, SOURCE_ORDER
from tallybook.operators.scratch import materialize

# The sheet's text columns.
TEXT_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Country"]
KEY_COLUMNS = ["InvoiceNo", "StockCode", "Country"]
CLEAN_COLUMNS = [*RAW_COLUMNS, "is_cancellation"]
REASON = "reason"
# The longest keys the tables hold, and the first price that rounds
# to more than DECIMAL(10,2) holds.
KEY_LENGTHS = {"InvoiceNo": 20, "StockCode": 20, "Country": 64}
PRICE_LIMIT = 99_999_999.995
#: So many digests of repeated lines are broadcast at most.
REPEATED_DIGESTS = 4_000_000


def trim_strings(raw: DataFrame) -> DataFrame:
    """White space of every kind goes from both ends; inside it stays."""
    return raw.withColumns({c: strip(c) for c in TEXT_COLUMNS})


def _missing_keys() -> Column:
    missing = F.lit(False)
    for key in KEY_COLUMNS:
        missing = missing | F.col(key).isNull()
    return missing


def _unreadable(raw: DataFrame) -> Column:
    return F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)


def _fractional_customer() -> Column:
    customer = F.nanvl(F.col("CustomerID"), F.lit(None).cast("double"))
    return F.coalesce(customer != F.floor(customer), F.lit(False))


def _too_long() -> Column:
    long = F.lit(False)
    for key, most in KEY_LENGTHS.items():
        long = long | F.coalesce(F.char_length(strip(key)) > most, F.lit(False))
    return long


def _price_out_of_range() -> Column:
    price = F.nanvl(F.col("UnitPrice"), F.lit(None).cast("double"))
    return F.coalesce(price >= PRICE_LIMIT, F.lit(False))


def quarantine_reason(raw: DataFrame, null_keys: str = "quarantine") -> Column:
    """Why a raw row cannot be loaded; null when it can.

    Every rule that the tables have for single rows is one of the reasons, so what
    is left can be loaded. A column ``reason`` that is there already is taken.
    """
    if REASON in raw.columns:
        return F.col(REASON)
    reason = F.when(_unreadable(raw), "unreadable line").when(_fractional_customer(), "fractional customer")
    if null_keys != "text":
        reason = reason.when(_missing_keys(), "missing key")
    return (
        reason.when(F.col("Quantity").isNull(), "missing quantity")
        .when(F.col("InvoiceDate").isNull(), "missing date")
        .when(_too_long(), "key too long")
        .when(_price_out_of_range(), "price out of range")
    )


def quarantined(raw: DataFrame, null_keys: str = "quarantine") -> DataFrame:
    """The rows that cleaning sets aside, each with its reason."""
    return raw.withColumn(REASON, quarantine_reason(raw, null_keys)).filter(F.col(REASON).isNotNull())


def null_as_text(raw: DataFrame) -> DataFrame:
    """A missing key becomes the text ``nan``."""
    return raw.withColumns({c: F.coalesce(c, F.lit(MISSING_TEXT)) for c in KEY_COLUMNS})


def drop_no_description(raw: DataFrame) -> DataFrame:
    """Missing descriptions go, and the text they turn into; empty ones stay."""
    return raw.filter(F.col("Description").isNotNull() & (F.col("Description") != MISSING_TEXT))


def drop_nonpositive_price(raw: DataFrame) -> DataFrame:
    """Spark sorts NaN above every number, so NaN needs its own test."""
    return raw.filter((F.col("UnitPrice") > 0) & ~F.isnan("UnitPrice"))


def flag_cancellation(raw: DataFrame) -> DataFrame:
    """An invoice number that starts with a capital C is a cancellation."""
    return raw.withColumn("is_cancellation", F.startswith(F.col("InvoiceNo"), F.lit("C")))


def cast_customer(raw: DataFrame) -> DataFrame:
    """Whole-number floats become BIGINT, missing ones null."""
    return raw.withColumn("CustomerID", F.nanvl(F.col("CustomerID"), F.lit(None).cast("double")).cast("bigint"))


def drop_duplicates(lines: DataFrame) -> DataFrame:
    """One row per distinct line, keeping the first in source order.

    The number of copies is kept too: it gives the row count before this step
    without another pass. Both aggregates are plain numbers, so Spark hashes
    instead of sorting and folds a line repeated any number of times on the map
    side.
    """
    return lines.groupBy(*CLEAN_COLUMNS).agg(
        F.min(SOURCE_ORDER).alias(SOURCE_ORDER), F.count(F.lit(1)).alias(COPIES)
    )


def drop_written_duplicates(lines: DataFrame) -> DataFrame:
    """The same rows as ``drop_duplicates`` of lines made from a written table. Runs jobs.

    Lines are read several times instead of being shuffled: a digest that occurs once
    is the digest of a line without copies. Only the 8 bytes of the digests are
    shuffled, and whole lines where a digest occurs again, so lines that differ under
    one digest stay apart. Lines without copies stay in the order they were written in.
    """
    marked = lines.withColumn("_digest", F.xxhash64(*CLEAN_COLUMNS))
    digests = marked.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_digest")
    again = materialize(digests, "repeated-digests")
    if again.count() > REPEATED_DIGESTS:
        return drop_duplicates(lines)
    again = F.broadcast(again)  # bounded by the line above
    once = marked.join(again, "_digest", "left_anti").withColumn(COPIES, F.lit(1).cast("bigint"))
    repeated = drop_duplicates(marked.join(again, "_digest", "left_semi"))
    return once.select(*repeated.columns).union(repeated)


def loadable(raw: DataFrame, null_keys: str = "quarantine") -> DataFrame:
    """Raw rows without those set aside, trimmed."""
    kept = trim_strings(raw.filter(quarantine_reason(raw, null_keys).isNull()))
    return null_as_text(kept) if null_keys == "text" else kept


def clean_sales(raw: DataFrame, null_keys: str = "quarantine", written: bool | None = None) -> DataFrame:
    """The whole cleaning: the nine clean columns, source order and copies.

    ``written`` says that ``raw`` is a written table: it may be read several times, which
    saves the shuffle of all lines. Rows that have their reason already are taken as written.

    ``null_keys="text"`` keeps rows without invoice number, stock code or country
    under the key ``nan`` instead of setting them aside.
    """
    if null_keys not in ("quarantine", "text"):
        raise ValueError(f"null_keys must be 'quarantine' or 'text', not {null_keys!r}")
    priced = drop_nonpositive_price(drop_no_description(loadable(raw, null_keys)))
    lines = cast_customer(flag_cancellation(priced))
    return drop_written_duplicates(lines) if (REASON in raw.columns if written is None else written) else drop_duplicates(lines)
