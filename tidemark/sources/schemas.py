"""Read schemas. Numbers arrive as text with sentinels among them, so raw fields are strings and the functions type them."""

from __future__ import annotations

from pyspark.sql import types as T

STRING = T.StringType()


def strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, STRING) for n in names]


#: Further spellings of fields whose names differ in case alone, which one table cannot hold side by side.
SPELLINGS = {"date": ("Date",), "ticker": ("Ticker",)}
#: One observation of a raw history file, with every alias of a field that occurs.
RAW_OBSERVATION = T.StructType(
    strings("date", "ticker", "reportedFiscalPeriodEnding", "reportedFiscalLabel", "fiscalKey", "Fiscal Year", "reported_fiscal_label", "fiscalPeriodEnding")
    + strings("consensus", "eps", "analysts", "analystCount", "updateTime", "Update Time", "mappedYear", "slot", "source", "collectionFailed", "usingLastKnownGood")
)
LEAF = T.StructType(strings("consensus", "high", "low", "analysts", "rev_1M_pct", "rev_3M_pct", "rev_6M_pct", "reported_fiscal_label", "reportedFiscalLabel", "reportedFiscalPeriodEnding", "calendar_alignment"))
SNAPSHOT = T.StructType(
    [
        *strings("snapshot_utc", "collectedAt", "sourceDataAsOf", "source"),
        T.StructField(
            "tickers",
            T.MapType(
                STRING,
                T.StructType(
                    [
                        *strings("price", "price_as_of", "last_earnings", "next_earnings", "source_url", "update_time", "collection_failed", "collectionFailed", "usingLastKnownGood"),
                        T.StructField("data_gaps", T.ArrayType(STRING)),
                        T.StructField("eps", T.MapType(STRING, LEAF)),
                        T.StructField("all_reported_rows", T.ArrayType(LEAF)),
                    ]
                ),
            ),
        ),
    ]
)
EVENT = T.StructType(
    strings("Date", "Ticker", "Fiscal Year", "Calendar Alignment", "Previous EPS", "Current EPS", "Change", "Revision %", "Reason", "Source", "Source Date", "Update Time", "Reported Fiscal Period Ending", "eventId")
)
UNIVERSE = T.StructType(
    [
        T.StructField("tickers", T.ArrayType(STRING)),
        T.StructField("fiscalEndMonthByTicker", T.MapType(STRING, STRING)),
        T.StructField("officialDomainsByTicker", T.MapType(STRING, T.ArrayType(STRING))),
    ]
)
STATUS = T.StructType(strings("previousStatus", "currentStatus", "status", "changedAt", "eventDate", "asOf", "reason", "note"))
DRIVERS = T.StructType(
    [
        *strings("ticker", "updated", "updatedAt", "status"),
        T.StructField("drivers", T.ArrayType(T.StructType([*strings("name", "fiscalPeriod", "sourceUrl"), *STATUS.fields, T.StructField("statusHistory", T.ArrayType(STATUS))]))),
    ]
)
SOURCED = T.StructType(strings("label", "value", "text", "title", "url", "source", "sourceUrl", "sourceTier", "type", "date"))
#: ``results`` and ``guidanceDetail`` are objects in full digests and empty lists in stubs, so they stay text here.
DIGEST = T.StructType(
    [
        *strings("ticker", "hasDigest", "reportDate", "periodLabel", "guidance", "comparison", "commentary", "updatedAt", "results", "guidanceDetail", "actuals", "consensusComparison"),
        *[T.StructField(n, T.ArrayType(SOURCED)) for n in ("revenue", "eps", "margins", "positives", "negatives", "uncertainties", "sources")],
    ]
)
