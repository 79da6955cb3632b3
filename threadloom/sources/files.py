"""Files in and out. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom import schemas as S
from threadloom.functions import arrays as A
from threadloom.operators.packing import ROW_PARTS, packed_lines, unpack_lines
from threadloom.session import Scratch, broadcast_if_small


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message CSV with a header; quoted texts may hold line ends and quotes.

    Columns are matched by their header names, so extra columns do no harm. A
    file is read by one task; ``read_messages_split`` reads large ones by many. Keep
    a Parquet copy for repeated use (``parquet_copy``). A
    value that is no number or boolean is NULL, not an error.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in S.MESSAGES.fields])


def _numbered_records(spark: SparkSession, path: str, tables: Scratch) -> DataFrame:
    """Lines (value, file, block, at) with ``record``, the number of their record in the file, and ``alone``.

    Whether a line begins inside quotes follows from the number of quotes before
    it: those of the blocks before, over one row per block, and those of its own
    block. Records are counted in the same way, for either state of the block's begin.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"')))).cast("long")
    lines = tables.table(lines.withColumn("quotes", quotes), "lines")
    # a window sees one block of one file, which is what a task reads
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    odd = F.col("upto") % 2 != F.col("quotes") % 2
    counted = lines.withColumn("upto", F.sum("quotes").over(inside)).withColumn("odd", odd)
    counted = counted.withColumn("starts_even", F.count_if(~F.col("odd")).over(inside))
    counted = counted.withColumn("starts_odd", F.count_if(F.col("odd")).over(inside))
    blocks = counted.groupBy("file", "block").agg(
        F.sum("quotes").alias("n"), F.max("starts_even").alias("even"), F.max("starts_odd").alias("odd")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)) % 2)
    starts = F.when(F.col("ahead") == 0, F.col("even")).otherwise(F.col("odd"))
    blocks = blocks.withColumn("records", F.coalesce(F.sum(starts).over(before), F.lit(0)))
    told = counted.join(broadcast_if_small(blocks.select("file", "block", "ahead", "records")), ["file", "block"])
    own = F.when(F.col("ahead") == 0, F.col("starts_even")).otherwise(F.col("starts_odd"))
    begins_inside = F.col("odd") != (F.col("ahead") == 1)
    ends_inside = (F.col("upto") + F.col("ahead")) % 2 == 1
    return told.select(
        "value", "file", "block", "at", (F.col("records") + own).alias("record"), (~begins_inside & ~ends_inside).alias("alone")
    )


def read_messages_split(spark: SparkSession, path: str, tables: Scratch | None = None) -> DataFrame:
    """``read_messages`` for large files: one file feeds as many tasks as it has blocks.

    Lines are read by byte ranges, and only the lines of records that have several are
    brought together. Columns are matched by the header of the first file,
    which all files share. Lines end with a line feed.
    """
    tables = tables or Scratch(spark, "csv")
    lines = tables.table(_numbered_records(spark, path, tables), "records")
    whole = lines.filter("alone").select("file", "record", F.col("value").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    cut = lines.filter("not alone").groupBy("file", "record").agg(ordered.alias("parts"))
    joined = cut.select("file", "record", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("text"))
    records = whole.unionByName(joined)
    head = records.filter("record = 1").orderBy("file").limit(1).collect()
    if not head:
        return spark.createDataFrame([], S.MESSAGES)
    names = head[0]["text"].replace('"', "").split(",")
    schema = ", ".join(f"`{i}` string" for i in range(len(names)))
    parsed = records.filter((F.col("record") > 1) & (F.length("text") > 0)).select(
        F.from_csv("text", schema, {"escape": '"', "multiLine": "true"}).alias("row")
    )
    place = {name.strip(): i for i, name in enumerate(names)}
    return parsed.select(
        *[
            (F.col(f"row.`{place[f.name]}`") if f.name in place else F.lit(None)).try_cast(f.dataType).alias(f.name)
            for f in S.MESSAGES.fields
        ]
    )


def write_messages(messages: DataFrame, path: str) -> None:
    """The counterpart of ``read_messages``."""
    columns = [f.name for f in S.MESSAGES.fields]
    messages.select(*columns).write.option("header", True).option("escape", '"').csv(path)


def parquet_copy(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Messages of ``path`` written once as Parquet, which splits and prunes, and read from there."""
    read_messages(spark, path).write.parquet(to)
    return spark.read.schema(S.MESSAGES).parquet(to)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list as ``(place, entry)``, places counted from 0 over all files in name order.

    Blocks of the files are numbered first, and lines then inside their block,
    so a list may be of any size. Empty lines at the end are no entries.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    blocks = lines.groupBy("file", "block").agg(
        F.min("at").alias("first"),
        F.count("*").alias("n"),
        F.max(F.when(F.col("value") != "", F.col("at"))).alias("last"),
    )
    before = Window.orderBy("file", "block")  # one row per block
    placed = blocks.select(
        "file",
        "block",
        "first",
        (F.sum("n").over(before) - F.col("n")).alias("offset"),
        "last",
    )
    ends = placed.withColumn(
        "end",
        F.max(F.col("offset") + F.col("last") - F.col("first")).over(
            Window.partitionBy(F.lit(1))
        ),
    ).drop("last")
    numbered = lines.join(F.broadcast(ends), ["file", "block"])
    place = (F.col("offset") + F.col("at") - F.col("first")).cast("int")
    return numbered.select(
        place.alias("place"),
        F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("entry"),
        "end",
    ).filter("place <= end").drop("end")


def read_authors(spark: SparkSession, path: str) -> DataFrame:
    """``(author_id, code)``: codes from 1 by line; a repeated name keeps the last."""
    return (
        read_list(spark, path)
        .groupBy(F.col("entry").alias("author_id"))
        .agg((F.max("place") + 1).alias("code"))
    )


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Base vocabulary ``(subword, id)``: ids from 0 by line, the last line wins."""
    return (
        read_list(spark, path)
        .groupBy(F.col("entry").alias("subword"))
        .agg(F.max("place").alias("id"))
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Mined samples from JSON lines; numeric ids are read as text."""
    return spark.read.schema(S.SAMPLES).json(path)


def write_samples(samples: DataFrame, path: str, form: str = "json") -> None:
    """Samples as JSON lines (the exchange form) or Parquet, one file per task."""
    columns = [f.name for f in S.SAMPLES.fields]
    samples.select(*columns).write.format(form).save(path)


def write_chains(paths: DataFrame, path: str) -> None:
    """Id paths as CSV with comma lists; merged turns write all their ids."""
    context = F.array_join(F.flatten("context"), ",")
    sender = F.array_join("sender", ",")
    paths.select(
        sender.alias("sender"), context.alias("context"), "response", "author_id", "id"
    ).write.option("header", True).option("escape", '"').csv(path)


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """Chain CSV back to arrays: ``sender``, flat ``context``, ``response``."""
    raw = (
        spark.read.schema(S.CHAIN_FILE).option("header", True).option("escape", '"').csv(path)
    )
    return raw.select(
        "id",
        F.split("sender", ",").alias("sender"),
        F.split("context", ",").cast("array<bigint>").alias("context"),
        "response",
        "author_id",
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Plain text, one text per line."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def write_corpus(texts: DataFrame, path: str, column: str = "text") -> None:
    """One text per line; line ends inside a text become blanks."""
    texts.select(F.regexp_replace(column, r"[\r\n]", " ").alias("value")).write.text(path)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as lines of integers without a header."""
    packed_lines(packed).select("line").write.text(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of 512 integers to four arrays; malformed lines in ``bad_record``."""
    return unpack_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def write_split(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Rows with a ``split`` column into one folder per split, replacing old output.

    ``form="text"`` writes packed rows as lines of integers.
    """
    if form == "text":
        rows = rows.select(A.packed_line(*ROW_PARTS).alias("line"), "split")
    rows.write.mode("overwrite").partitionBy("split").format(form).save(path)


def write_embeddings(table: DataFrame, path: str) -> None:
    table.select("id", "vector").write.parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.EMBEDDINGS).parquet(path)


def register(messages: DataFrame, name: str = "data") -> None:
    """Make a table known to SQL text."""
    messages.createOrReplaceTempView(name)
