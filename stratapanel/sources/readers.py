"""Readers for bar partitions, daily files, memberships, event ledgers and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratapanel.operators.quality import row_hashes

# Column names of the two daily file layouts and of the event sources.
OLD_COLUMNS = {"DATE1": "date", "SYMBOL": "symbol", "SERIES": "series", "OPEN_PRICE": "open", "HIGH_PRICE": "high",
               "LOW_PRICE": "low", "CLOSE_PRICE": "close", "TTL_TRD_QNTY": "volume", "TURNOVER_LACS": "turnover"}
NEW_COLUMNS = {"TradDt": "date", "TckrSymb": "symbol", "SctySrs": "series", "OpnPric": "open", "HghPric": "high",
               "LwPric": "low", "ClsPric": "close", "TtlTradgVol": "volume", "TtlTrfVal": "turnover", "ISIN": "isin",
               "FinInstrmId": "instrument_id", "FinInstrmNm": "security_name"}
OLD_DATE, NEW_DATE, LAKH = "dd-MMM-yyyy", "yyyy-MM-dd", 100000
LEDGER_COLUMNS = ["DATE", "SYMBOL", "SERIES", "FACE VALUE", "adj_factor", "dividend", "valid", "demerger", "merger", "buyback"]
OFFICIAL_COLUMNS = ["bcEndDate", "bcStartDate", "caBroadcastDate", "comp", "exDate", "faceVal", "ind", "isin", "ndEndDate",
                    "ndStartDate", "recDate", "series", "subject", "symbol"]
SYMBOL_PATTERN = r"^[A-Z0-9&_\-]+$"

BAR_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.LongType()), T.StructField("instrument_token", T.LongType()),
       T.StructField("symbol", T.StringType()), T.StructField("year", T.IntegerType())]
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


#: What the listing of a folder of files knows, with the partition columns as the bars have them.
LISTING = "path string, modificationTime timestamp, length long, content binary, symbol string, year int"


def partition_problems(spark: SparkSession, root: str, *, schema: T.StructType = BAR_SCHEMA, ts: str = "timestamp", token: str = "instrument_token") -> DataFrame:
    """(symbol, year, problem) of partitions that are empty, hold rows of another year, or several tokens.

    The listing of the files, whose content is not read, is compared with the rows that the files give; of the bars only time and token are read.
    """
    listed = spark.read.format("binaryFile").schema(LISTING).option("pathGlobFilter", "*.parquet").load(root).select("symbol", "year").distinct()
    rows = spark.read.schema(schema).parquet(root).groupBy("symbol", "year").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.year(ts).eqNullSafe(F.col("year"))).alias("_same"), F.min(token).alias("_a"), F.max(token).alias("_b"),
        F.count(token).alias("_t"))
    problem = (
        F.when(F.col("_n").isNull(), "EMPTY_PARTITION").when(F.col("_same") < F.col("_n"), "WRONG_YEAR")
        .when((F.col("_a") != F.col("_b")) | (F.col("_t") < F.col("_n")), "NOT_ONE_TOKEN"))
    return listed.join(rows, ["symbol", "year"], "left").select("symbol", "year", problem.alias("problem")).where(F.col("problem").isNotNull())


def scan_partitioned_bars(
    spark: SparkSession, root: str, *, schema: T.StructType = BAR_SCHEMA, ts: str = "timestamp", token: str = "instrument_token", check: bool = True,
) -> DataFrame:
    """Read symbol=*/year=* Parquet; fails if a partition is empty or holds several tokens, and if a row's year differs from its partition.

    ``check``: look for such partitions first; without it only the rows that are read are tested for their year.  Filters on symbol and year
    prune partitions before any file is opened.
    """
    if check:
        found = partition_problems(spark, root, schema=schema, ts=ts, token=token).orderBy("symbol", "year").limit(20).collect()
        if found:
            raise ValueError("partitions to mend: " + ", ".join(f"{r['symbol']}/{r['year']} {r['problem']}" for r in found))
    bars = spark.read.schema(schema).parquet(root)
    same = F.year(ts) == F.col("year")
    return bars.where(F.when(same, True).otherwise(F.raise_error(F.lit("row outside its year partition")).cast("boolean")))


def partition_tokens(bars: DataFrame, *, token: str = "instrument_token") -> DataFrame:
    """Rows and tokens per (symbol, year); a partition must carry one token."""
    out = bars.groupBy("symbol", "year").agg(
        F.count(F.lit(1)).alias("rows"), F.min(token).alias("token"), F.max(token).alias("_last"))
    return out.withColumn("one_token", F.col("token") == F.col("_last")).drop("_last")


def _trimmed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Trim header names and values, keep and rename the known columns."""
    header = {c.strip(): c for c in df.columns}
    missing = [c for c in names if c not in header]
    if missing:
        raise ValueError(f"columns missing from source: {missing}")
    return df.select(*[F.trim(F.col(f"`{header[c]}`")).alias(n) for c, n in names.items()], "_source_file")


def _strings(spark: SparkSession, path) -> DataFrame:
    """CSV rows as strings; a file whose header differs from the first file's fails the job instead of swapping columns."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def _csv(spark: SparkSession, path) -> DataFrame:
    raw = _strings(spark, path)
    return raw.withColumn("_source_file", file_name(F.col("_metadata.file_path")))


def scan_daily_two_formats(spark: SparkSession, old_path, new_path) -> DataFrame:
    """Daily rows of both layouts under one schema: prices double, turnover in base units, ids NULL in the old layout."""
    old = _trimmed(_csv(spark, old_path), OLD_COLUMNS).withColumn("source_format", F.lit("OLD"))
    new = _trimmed(_csv(spark, new_path), NEW_COLUMNS).withColumn("source_format", F.lit("NEW"))
    old = old.withColumn("date", F.to_date("date", OLD_DATE)).withColumn("turnover", F.col("turnover").cast("double") * LAKH)
    new = new.withColumn("date", F.to_date("date", NEW_DATE)).withColumn("turnover", F.col("turnover").cast("double"))
    both = new.unionByName(old, allowMissingColumns=True)
    for c in ("open", "high", "low", "close"):
        both = both.withColumn(c, F.col(c).cast("double"))
    return both.withColumn("volume", F.col("volume").cast("double").cast("long")).withColumnRenamed("_source_file", "source_file")


def pick_canonical_file(audit: DataFrame) -> DataFrame:
    """One file per internal date: file date equal to internal date first, then file name.

    ``min`` of a struct is a partial aggregate, so a date with very many files is no problem.
    """
    mismatch = F.coalesce(F.col("file_date") != F.col("internal_date"), F.lit(True))
    best = F.min(F.struct(mismatch.alias("mismatch"), F.col("source_name"), F.col("file_date"))).alias("_b")
    picked = audit.groupBy("internal_date").agg(best, F.count(F.lit(1)).alias("candidate_files"))
    return picked.select(
        "internal_date", F.col("_b.source_name").alias("source_name"), F.col("_b.file_date").alias("file_date"),
        (~F.col("_b.mismatch")).alias("file_date_matches"), "candidate_files")


def scan_headerless_membership(spark: SparkSession, path, *, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, issues) of one-column files named <group>_<code>.csv, one entity per line.

    ``name`` derives the file's name from its path (``_metadata.file_path``) where it is not the last part.

    Blank, malformed and duplicated records are reported; duplicates stay members once.
    """
    raw = spark.read.text(path).select(
        (file_name(F.col("_metadata.file_path")) if name is None else name).alias("source_file"), F.regexp_replace("value", "^﻿", "").alias("line"))
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    rows = raw.select(
        "source_file", F.trim("line").alias("entity"),
        F.regexp_extract(stem, r"^(.*)_([^_]*)$", 1).alias("group_name"), F.regexp_extract(stem, r"^(.*)_([^_]*)$", 2).alias("group_code"))
    kind = F.when(F.col("entity") == "", "BLANK_RECORD").when(~F.col("entity").rlike(SYMBOL_PATTERN), "MALFORMED_RECORD")
    rows = rows.withColumn("issue", kind)
    good = rows.where("issue IS NULL")
    counted = good.groupBy("source_file", "group_name", "group_code", "entity").agg(F.count(F.lit(1)).alias("copies"))
    bad = rows.where("issue IS NOT NULL").groupBy("source_file", "issue", "entity").agg(F.count(F.lit(1)).alias("records"))
    twice = counted.where("copies > 1").select("source_file", F.lit("DUPLICATE_RECORD").alias("issue"), "entity", F.col("copies").alias("records"))
    return counted, bad.unionByName(twice)


def scan_event_ledger(spark: SparkSession, path) -> DataFrame:
    """All-string event CSVs with fixed columns; adds the record as JSON and stable ids.

    An event id hashes file, record and the copy number among equal records of the file,
    so repeated rows stay apart without relying on line order.
    """
    raw = _strings(spark, path)
    if raw.columns != LEDGER_COLUMNS:
        raise ValueError(f"unexpected ledger columns: {raw.columns}")
    raw = raw.fillna("")
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(LEDGER_COLUMNS)]))
    rows = raw.withColumn("source_file", file_name(F.col("_metadata.file_path"))).withColumn("source_record_json", record)
    # Equal records collapse to a count (map-side) and are numbered out again.
    copies = rows.groupBy("source_file", "source_record_json", *LEDGER_COLUMNS).agg(F.count(F.lit(1)).alias("_n"))
    copies = copies.withColumnRenamed("DATE", "source_date")
    numbered = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")
    return (
        numbered.withColumn("event_id", F.sha2(F.concat_ws(":", "source_file", "copy", "source_record_json"), 256))
        .withColumn("duplicate_key_group", F.sha2(F.concat_ws("|", "SYMBOL", "SERIES", "source_date"), 256))
        .withColumn("date", F.to_date("source_date", "yyyyMMdd"))
    )


def scan_json_events(spark: SparkSession, path, *, lines: bool = False) -> DataFrame:
    """Official events: fixed columns, '-' as missing date, day-month-year dates.

    A file is one JSON array, or one object per line (``lines``), which Spark can split.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in OFFICIAL_COLUMNS])
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)

    def day(c):
        return F.to_date(F.nullif(F.trim(F.col(c)), F.lit("-")), OLD_DATE)

    return raw.select(
        F.col("symbol").alias("entity"), "series", "isin", F.col("comp").alias("company_name"), "subject",
        day("exDate").alias("ex_date"), day("recDate").alias("record_date"), day("exDate").alias("session"))


def file_inventory(spark: SparkSession, path, *, pattern: str = "*", name: Column | None = None) -> DataFrame:
    """Size, modification time, lines and content hash of every text file that has a line.

    Files of any size are read in splits: a file's hash combines the hashes of its lines, copies counted, so only their order
    escapes it.  ``name`` derives the file's name from its path (``_metadata.file_path``).
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    meta, (one, two) = F.col("_metadata"), row_hashes(["value"])
    named = file_name(meta.file_path) if name is None else name
    per_file = lines.select(
        named.alias("file"), meta.file_path.alias("_path"), meta.file_size.alias("size"), meta.file_modification_time.alias("modified"), one.alias("_h1"), two.alias("_h2"))
    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(f"_s{c}") for c in ("_h1", "_h2")]
    sums = per_file.groupBy("file", "_path").agg(
        F.max("size").alias("size"), F.max("modified").alias("modified"), F.count(F.lit(1)).alias("rows"), *total, F.bit_xor("_h1").alias("_x1"), F.bit_xor("_h2").alias("_x2"))
    body = F.concat_ws(":", *[F.col(c).cast("string") for c in ("rows", "_s_h1", "_s_h2", "_x1", "_x2")])
    return sums.select("file", "size", "modified", "rows", F.sha2(body, 256).alias("sha256"))


def inventory_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """ADDED, REMOVED, CHANGED or SAME per file, by content hash."""
    a = current.select("file", F.col("sha256").alias("_now"))
    b = stored.select("file", F.col("sha256").alias("_then"))
    status = (
        F.when(F.col("_then").isNull(), "ADDED").when(F.col("_now").isNull(), "REMOVED")
        .when(F.col("_now") != F.col("_then"), "CHANGED").otherwise("SAME"))
    return a.join(b, "file", "full_outer").select("file", status.alias("status"))


def source_coverage_audit(df: DataFrame, *, session: str, cutoff: str, expected: list[str], source: str = "source_file") -> DataFrame:
    """Rows, span and schema agreement per source, and whether it reaches past the cutoff."""
    matches = [c for c in df.columns if c != source] == expected
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"), F.min(session).alias("first_session"), F.max(session).alias("last_session"),
    ).withColumn("schema_matches", F.lit(matches)).withColumn(
        "extends_past_cutoff", F.col("last_session") > F.lit(cutoff).cast("date"))


def scan_session_overrides(spark: SparkSession, path) -> DataFrame:
    """Dated session exceptions: date, session_type, intervals, force_ineligible."""
    from stratapanel.operators.bars import interval_minutes

    raw = spark.read.option("header", True).csv(path).fillna("")
    return raw.select(
        F.to_date("date").alias("session_date"), "session_type", interval_minutes(F.col("intervals")).alias("expected"),
        (F.lower("force_ineligible") == "true").alias("force_ineligible"))
