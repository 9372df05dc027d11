"""Export files to entries, conversations and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmap.functions import text as X
from gistmap.functions import timestamps

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
#: Words in the key of a list that holds conversations.
HINTS = ["conversation", "chat", "message", "item", "entr", "session", "thread"]


def parse_entries(entries: DataFrame) -> DataFrame:
    """Add chat_id, user_text and assistant_text (readable parts of the answer, two lines apart)."""
    key = ["source_file", "entry_id"]
    parts = entries.select(*key, F.posexplode("safeHtmlItem").alias("pos", "i")).where(F.regexp_replace("i.html", r"(?U)\s+", "") != "")
    parts = parts.select(*key, "pos", X.html_to_text(F.col("i.html")).alias("t")).where("t <> ''")
    answer = parts.groupBy(*key).agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"])).alias("assistant_text"))
    e = entries.select("entry_id", "source_file", "entry_index", "time", X.chat_id(F.col("details")).alias("chat_id"), X.user_text(F.col("title")).alias("user_text"))
    return e.join(answer, key, "left")


def with_instants(entries: DataFrame) -> DataFrame:
    """Parsed entries with ``micros`` and, in ``missing``, the required fields they lack."""
    e = parse_entries(entries)
    e = e.withColumn("time", F.when(F.trim("time").rlike(ISO), F.trim("time")))
    e = timestamps.utc_micros(e, "time", None, None, "micros")
    lack = [F.when(F.col(c).isNull(), n) for c, n in (("chat_id", "chat_id"), ("micros", "timestamp"), ("user_text", "user_text"), ("assistant_text", "assistant_text"))]
    return e.withColumn("missing", F.concat_ws(",", *lack))


def build_conversations(good: DataFrame) -> DataFrame:
    """(source_file, chat_id, turn_index, role, text): entries of a chat by time, two turns each, per file."""
    order = Window.partitionBy("source_file", "chat_id").orderBy("micros", "entry_index", "entry_id")
    e = good.withColumn("k", F.row_number().over(order) - 1)
    both = F.array(F.struct((2 * F.col("k")).alias("turn_index"), F.lit("user").alias("role"), F.col("user_text").alias("text")), F.struct((2 * F.col("k") + 1).alias("turn_index"), F.lit("assistant").alias("role"), F.col("assistant_text").alias("text")))
    return e.select("source_file", "chat_id", F.inline(both))


def read_exports(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(path, body) of all files below ``root`` whose names match, read whole (an export is one JSON array)."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def write_exports(entries: DataFrame, root: str) -> None:
    """Write entries as an export tree below ``root``: one folder per source_file with one JSON array in it (``part-*.txt``), entries in their order."""
    fields = [c for c in ("header", "title", "time", "details", "safeHtmlItem") if c in entries.columns]
    row = F.struct(F.col("entry_index"), F.col("entry_id"), F.to_json(F.struct(*fields)).alias("json"))
    files = entries.groupBy("source_file").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["json"]).alias("rows"))
    files.select("source_file", F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]")).alias("value")).write.mode("overwrite").partitionBy("source_file").text(root)


def file_of(path: Column) -> Column:
    """The name of the export a path belongs to: its ``source_file`` folder, else the file's own name."""
    folder = F.regexp_extract(path, r"source_file=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.element_at(F.split(path, "/"), -1))


def typed_entries(parsed: DataFrame) -> DataFrame:
    """Parsed entries as rows of entries: fields of another type than expected are null. ``entry_id`` is their place in the file."""
    get = lambda name, kind: F.try_variant_get("entry", f"$.{name}", kind)
    return parsed.where("entry is not null").select(
        F.col("entry_index").cast("bigint").alias("entry_id"), file_of(F.col("path")).alias("source_file"), "entry_index", get("header", "string").alias("header"), get("title", "string").alias("title"),
        get("time", "string").alias("time"), get("details", "array<struct<url:string,name:string>>").alias("details"), get("safeHtmlItem", "array<struct<html:string>>").alias("safeHtmlItem"),
    )


def parse_exports(files: DataFrame) -> DataFrame:
    """(path, reason, entry_index, entry): entries of arrays; files that are none with a reason."""
    v = files.select("path", F.try_parse_json("body").alias("v"))
    kind = v.withColumn("reason", F.when(F.col("v").isNull(), "unreadable").when(~F.schema_of_variant("v").startswith("ARRAY"), "not an array"))
    kind.createOrReplaceTempView("__exports")
    good = files.sparkSession.sql("SELECT path, CAST(NULL AS STRING) AS reason, e.pos AS entry_index, e.value AS entry FROM __exports, LATERAL variant_explode(v) AS e WHERE reason IS NULL")
    bad = kind.where("reason is not null").select("path", "reason", F.lit(None).cast("int").alias("entry_index"), F.lit(None).cast("variant").alias("entry"))
    return good.unionByName(bad)


def infer_schemas(files: DataFrame) -> DataFrame:
    return files.select("path", F.coalesce(F.schema_of_variant(F.try_parse_json("body")), F.lit("unreadable")).alias("schema"))


def pick_collections(files: DataFrame) -> DataFrame:
    """(path, collection, length): of the top-level lists the one whose key holds the longest hint, then the longest."""
    files.select("path", F.try_parse_json("body").alias("v")).where("v is not null").createOrReplaceTempView("__collections")
    spark = files.sparkSession
    lists = spark.sql("""
      SELECT path, 'root' AS collection, v FROM __collections WHERE schema_of_variant(v) LIKE 'ARRAY%'
      UNION ALL SELECT c.path, e.key, e.value FROM __collections c, LATERAL variant_explode(c.v) AS e WHERE schema_of_variant(c.v) LIKE 'OBJECT%' AND schema_of_variant(e.value) LIKE 'ARRAY%'""")
    hint = F.greatest(F.lit(0), *[F.when(F.lower("collection").contains(h), len(h)).otherwise(0) for h in HINTS])
    lists = lists.select("path", "collection", F.size(F.expr("cast(v as array<variant>)")).alias("length"), hint.alias("hint"))
    return lists.groupBy("path").agg(F.max_by(F.struct("collection", "length"), F.struct("hint", "length", "collection")).alias("best")).select("path", "best.collection", "best.length")
