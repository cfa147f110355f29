"""Readers of the JSON sources. Strict readers fail the job on the first bad line; tolerant ones keep bad lines as rejects."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import aware_timestamp_of
from tidemark.functions.fiscal import slot_from_alignment
from tidemark.functions.numbers import to_num
from tidemark.operators import history
from tidemark.sources import schemas

CORRUPT = "_corrupt_record"
#: Names of validated snapshot files.
SNAPSHOT_NAME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{4,6}Z?)?(-[0-9A-Za-z]+)?\.json$"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return copy.deepcopy(schema).add(CORRUPT, T.StringType())


FLAT = T.MapType(T.StringType(), T.StringType())


def _record(fields: Column, schema: T.StructType) -> Column:
    """A flat object, read as a map, as a struct of ``schema`` (all strings)."""
    return F.struct(*[F.coalesce(fields[n], *[fields[x] for x in schemas.SPELLINGS.get(n, ())]).alias(n) for n in schema.names])


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line of the files at ``path`` as ``file, line_no, raw, parsed``; a line that isn't one object of the schema has no ``parsed``.
    Line numbers count within a file. The texts stay where they are read: only the first place and the number of lines of each block of a
    file are gathered, added up by file and joined back."""
    raw = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    numbered = raw.join(blocks.select("file", "block", (before + 1 - F.col("first")).alias("shift")), ["file", "block"])
    numbered = numbered.withColumn("line_no", F.col("at") + F.col("shift")).where(F.trim("raw") != "")
    if all(isinstance(f.dataType, T.StringType) for f in schema):
        rows = numbered.withColumn("fields", F.from_json("raw", FLAT))
        return rows.select("file", "line_no", "raw", F.when(F.trim("raw").startswith("{") & F.col("fields").isNotNull(), _record(F.col("fields"), schema)).alias("parsed"))
    parsed = F.from_json("raw", _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    good = F.trim("raw").startswith("{") & parsed[CORRUPT].isNull()
    return numbered.select("file", "line_no", "raw", F.when(good, parsed.dropFields(CORRUPT)).alias("parsed"))


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows (``file, seq`` and the fields) and rejects (``file, line_no, raw, reason``)."""
    good = lines.where("parsed is not null").select("file", F.col("line_no").alias("seq"), "parsed.*")
    bad = lines.where("parsed is null").select("file", "line_no", "raw", F.lit("malformed_jsonl").alias("reason"))
    return good, bad


def canonical_history(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Admitted observations of a history. Strict: a malformed or inadmissible row makes any action fail; lenient: it's left out."""
    rows = json_lines(spark, path, schemas.RAW_OBSERVATION)
    classified = history.classified(rows.select("parsed.*", "file", F.col("line_no").alias("seq"), F.col("parsed").isNull().alias("malformed")))
    ok = ~F.col("malformed") & F.col("reject_reason").isNull()
    if not strict:
        return classified.where(ok).select(*history.OBSERVATION, "seq")
    why = F.concat_ws(" ", F.lit("inadmissible row:"), "file", F.col("seq").cast("string"), F.when(F.col("malformed"), "malformed_jsonl").otherwise(F.col("reject_reason")))
    return classified.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(why).cast("boolean"))).select(*history.OBSERVATION, "seq")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files, one row each: ``snapshot_id`` (the file's name) and the nested fields; unreadable files have a corrupt record."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(_with_corrupt(schemas.SNAPSHOT)).json(path)
    return rows.select(F.col("_metadata.file_name").alias("snapshot_id"), *schemas.SNAPSHOT.names, CORRUPT)


def validated(snaps: DataFrame, now: Column, gate: DataFrame | None = None) -> DataFrame:
    """Snapshots with a dated name and a zoned time that isn't more than ten minutes ahead; ``gate`` (snapshot_id, publishable) takes the
    rejected ones out."""
    ts = aware_timestamp_of(F.coalesce("collectedAt", "snapshot_utc"))
    out = snaps.where(F.col("snapshot_id").rlike(SNAPSHOT_NAME) & (ts <= now + F.expr("INTERVAL 10 MINUTES")))
    return out if gate is None else out.join(gate.where("not publishable").select("snapshot_id"), "snapshot_id", "left_anti")


def latest(snaps: DataFrame) -> DataFrame:
    return snaps.join(snaps.agg(F.max("snapshot_id").alias("snapshot_id")), "snapshot_id", "left_semi")


def flat_snapshot(snaps: DataFrame) -> DataFrame:
    """A row per snapshot, entity and slot, with the raw texts that the gate checks."""
    entities = snaps.select("snapshot_id", F.explode("tickers").alias("entity", "t"))
    rows = entities.select("snapshot_id", F.upper("entity").alias("entity"), "t", F.explode("t.eps").alias("slot", "r"))
    label = F.coalesce("r.reported_fiscal_label", "r.reportedFiscalLabel", "r.reportedFiscalPeriodEnding")
    failed = F.coalesce(F.lower("t.collection_failed") == "true", F.lower("t.collectionFailed") == "true", F.lower("t.usingLastKnownGood") == "true", F.lit(False))
    return rows.select(
        "snapshot_id", "entity", "slot", label.alias("label"), F.col("r.consensus").alias("value"), "r.high", "r.low", F.col("r.analysts").alias("coverage"),
        F.col("r.rev_1M_pct").alias("rev_1m"), F.col("r.rev_3M_pct").alias("rev_3m"), F.col("r.rev_6M_pct").alias("rev_6m"), F.coalesce(slot_from_alignment(F.col("r.calendar_alignment")), "slot").alias("display_slot"), failed.alias("failed"),
    )


def snapshot_entities(snaps: DataFrame) -> DataFrame:
    rows = snaps.select("snapshot_id", F.explode("tickers").alias("entity", "t"))
    return rows.select("snapshot_id", F.upper("entity").alias("entity"), "t.price", "t.price_as_of", "t.next_earnings", F.col("t.data_gaps").alias("data_gaps"))


def revision_events(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant reader of revision events, with the columns renamed and typed."""
    good, _ = split_lines(json_lines(spark, path, schemas.EVENT))
    return normalized_events(good)


def normalized_events(raw: DataFrame) -> DataFrame:
    c = lambda n: F.col(f"`{n}`")
    period = F.coalesce(c("Reported Fiscal Period Ending"), c("Fiscal Year"))
    return raw.select(
        c("Date").alias("date"), F.upper(c("Ticker")).alias("entity"), period.alias("period"), slot_from_alignment(c("Calendar Alignment")).alias("slot"), c("Previous EPS").alias("previous"), to_num(c("Previous EPS")).alias("previous_value"),
        c("Current EPS").alias("current"), to_num(c("Current EPS")).alias("current_value"), c("Revision %").alias("revision"), to_num(c("Revision %")).alias("pct"), c("Reason").alias("reason"), c("Update Time").alias("update_time"), c("eventId").alias("event_id"), "seq",
    )


def universe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Watchlist (``entity``), fiscal-end months (``entity, fiscal_end_month``) and official domains (``entity, domain``)."""
    one = spark.read.option("multiLine", True).schema(schemas.UNIVERSE).json(path)
    watch = one.select(F.explode("tickers").alias("entity")).select(F.upper("entity").alias("entity"))
    months = one.select(F.explode("fiscalEndMonthByTicker").alias("entity", "m")).select(F.upper("entity").alias("entity"), F.col("m").try_cast("int").alias("fiscal_end_month"))
    domains = one.select(F.explode("officialDomainsByTicker").alias("entity", "ds")).select(F.upper("entity").alias("entity"), F.explode("ds").alias("domain"))
    return watch, months, domains


def digests(spark: SparkSession, path: str, previous: DataFrame | None = None) -> DataFrame:
    """Digest files; a corrupt file keeps its row of ``previous`` (the table of the last run, by ``file``) where there is one. ``is_corrupt``
    tells."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(_with_corrupt(schemas.DIGEST)).json(path)
    rows = rows.select(F.col("_metadata.file_name").alias("file"), F.struct(*schemas.DIGEST.names).alias("d"), F.col(CORRUPT).isNotNull().alias("is_corrupt"))
    if previous is not None:
        old = previous.select("file", F.struct(*schemas.DIGEST.names).alias("o"))
        rows = rows.join(old, "file", "left").withColumn("d", F.when(F.col("is_corrupt"), F.col("o")).otherwise(F.col("d"))).drop("o")
    return rows.select("file", "is_corrupt", "d.*")


def drivers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Driver states as the transition rule wants them, and a table of files that could not be read."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    parsed = F.from_json("value", _with_corrupt(schemas.DRIVERS), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = text.select("file", parsed.alias("j")).select("file", "j.*")
    errors = rows.where(F.col(CORRUPT).isNotNull()).select("file", F.lit("malformed_json").alias("error"))
    past = F.transform("d.statusHistory", lambda h: F.struct(h["previousStatus"].alias("previous_status"), F.coalesce(h["currentStatus"], h["status"]).alias("current_status"), h["changedAt"].alias("changed_at"), h["eventDate"].alias("event_date"), h["asOf"].alias("as_of"), h["reason"].alias("reason"), h["note"].alias("note")))
    out = rows.where(F.col(CORRUPT).isNull()).select(F.upper("ticker").alias("entity"), F.coalesce("updated", "updatedAt").alias("updated"), F.explode("drivers").alias("d"))
    return out.select(
        "entity", "updated", "d.name", F.col("d.previousStatus").alias("previous_status"), F.coalesce("d.currentStatus", "d.status").alias("current_status"), F.col("d.changedAt").alias("changed_at"), F.col("d.eventDate").alias("event_date"),
        F.col("d.asOf").alias("as_of"), "d.reason", "d.note", F.col("d.fiscalPeriod").alias("fiscal_period"), F.col("d.sourceUrl").alias("source_url"), past.alias("history"),
    ), errors


def nested_series(spark: SparkSession, path: str) -> DataFrame:
    """A chart export (entity to slot to points) as raw rows. A point without an ``updateTime`` key cannot prove its update time and is
    marked; an explicit null is provably none."""
    points = T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.MapType(T.StringType(), T.StringType()))))
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", points)).alias("ticker", "slots")).select("ticker", F.explode("slots").alias("slot", "series"))
    rows = rows.select("ticker", "slot", F.posexplode("series").alias("seq", "p"))
    get = lambda *names: F.coalesce(*[F.col("p")[n] for n in names])
    return rows.select(
        "ticker", "slot", F.col("seq").cast("long").alias("seq"), get("date").alias("date"), get("reportedFiscalPeriodEnding", "reportedFiscalLabel").alias("reportedFiscalPeriodEnding"), get("consensus", "eps").alias("consensus"), get("updateTime").alias("updateTime"),
        (F.map_contains_key("p", "updateTime") & get("reportedFiscalPeriodEnding", "reportedFiscalLabel").isNotNull()).alias("provable"),
    )


def tagged_sources(sources: list[tuple[str, str, int, bool, DataFrame]]) -> DataFrame:
    """One classified table of several sources: (name, kind, priority, trusted, raw rows). Untrusted sources are rejected as a whole."""
    out = None
    for name, kind, priority, trusted, rows in sources:
        tagged = history.classified(rows).select(*history.OBSERVATION, "had_update_time", "reject_reason")
        if not trusted:
            tagged = tagged.withColumn("reject_reason", F.lit("untrusted_source"))
        tagged = tagged.withColumns({"source_name": F.lit(name), "kind": F.lit(kind), "priority": F.lit(priority)})
        out = tagged if out is None else out.unionByName(tagged)
    return out


def staged_batch(spark: SparkSession, path: str) -> DataFrame:
    """A staged batch of raw observations: a list of objects, an object with ``rows``, or nothing; anything else raises before a merge."""
    try:
        text = spark.read.option("wholetext", True).text(path)
        texts = text.select(F.trim("value").alias("value")).where("value <> ''")
        bad = texts.where(F.expr("try_parse_json(value)").isNull() | ~(F.col("value").startswith("[") | F.col("value").startswith("{")))
    except Exception as error:  # a missing path is an empty batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schemas.RAW_OBSERVATION)
    fields = T.ArrayType(FLAT)
    listed = F.when(F.col("value").startswith("["), F.from_json("value", fields)).otherwise(F.from_json("value", T.StructType([T.StructField("rows", fields)]))["rows"])
    parsed = texts.select(listed.alias("rows"))
    if not bad.isEmpty() or not parsed.where("rows is null or exists(rows, r -> r is null)").isEmpty():
        raise ValueError(f"the staged batch at {path} is neither a list of objects nor an object with rows")
    return parsed.select(F.explode("rows").alias("fields")).select(_record(F.col("fields"), schemas.RAW_OBSERVATION).alias("r")).select("r.*")


def variant_fields(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """``rows`` with the text ``column`` read as JSON of any shape: ``reject_reason`` (``empty``, ``malformed``, ``not_an_object``, null for an object) and, for each name and type of
    ``fields``, its value and ``<name>_state``: ``ok``, ``absent``, ``null`` or ``wrong_type``. A text is parsed once; no schema is needed, and a key that isn't there is told from a null."""
    whole = "_variant"
    kind = F.schema_of_variant(whole)
    parsed = rows.withColumn(whole, F.try_parse_json(F.col(column)))
    reason = F.when(F.coalesce(F.trim(column), F.lit("")) == "", "empty").when(F.col(whole).isNull(), "malformed").when(~kind.startswith("OBJECT"), "not_an_object")
    made = {"reject_reason": reason}
    for name, kind_of in fields.items():
        path = f'$["{name}"]'
        raw, value = F.try_variant_get(whole, path, "variant"), F.try_variant_get(whole, path, kind_of)
        made[name] = F.when(reason.isNull(), value)
        made[f"{name}_state"] = F.when(reason.isNull(), F.when(raw.isNull(), "absent").when(F.is_variant_null(raw), "null").when(value.isNull(), "wrong_type").otherwise("ok"))
    return parsed.withColumns(made).drop(whole)


def variant_keys(rows: DataFrame, column: str) -> DataFrame:
    """Every top-level key of the objects in ``column`` with the number of objects that have it (``n``) and that have null there (``n_null``)."""
    objects = rows.select(F.try_parse_json(F.col(column)).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    return objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("v").outer())).groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.is_variant_null("value")).alias("n_null"))
