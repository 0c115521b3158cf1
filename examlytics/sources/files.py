"""File sources (A1-A4, A6): explicit schemas, never inference.

Question numbers are always read as text; inference would turn ``12`` into
``12.0`` for a numeric-looking column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Display names of the transcription file, in file order.
DISPLAY_COLUMNS = [
    "Student Name", "Question No", "Question", "Answer", "Grading", "ScanPageNo", "ClassName", "SubjectName",
]
SNAKE = {
    "Student Name": "student_name",
    "Question No": "question_no",
    "Question": "question",
    "Answer": "answer",
    "Grading": "grading",
    "ScanPageNo": "page_no",
    "ClassName": "class_name",
    "SubjectName": "subject_name",
}
NULL_TOKEN = "\\N"
CORRUPT = "_corrupt_record"


def transcription_schema(extra: list[tuple[str, T.DataType]] | None = None) -> T.StructType:
    fields = [T.StructField(c, T.IntegerType() if c == "ScanPageNo" else T.StringType()) for c in DISPLAY_COLUMNS]
    return T.StructType(fields + [T.StructField(n, t) for n, t in (extra or [])])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True,
             null_token: str | None = NULL_TOKEN, multi_line: bool = False) -> DataFrame:
    """A1/A2: CSV with an explicit schema; quoted fields may hold commas and
    quotes. Short rows get trailing nulls (PERMISSIVE). ``multi_line`` also
    allows newlines in quoted fields, at the price of one task per file."""
    r = (
        spark.read.schema(schema).option("header", header).option("sep", sep).option("escape", '"')
        .option("multiLine", multi_line).option("mode", "PERMISSIVE")
    )
    if null_token is not None:
        r = r.option("nullValue", null_token)
    return r.csv(path)


def to_snake(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in SNAKE.items() if k in df.columns})


def read_question_list_lenient(spark: SparkSession, path: str, header: tuple[str, str]) -> DataFrame:
    """A1b + C3: a two-column question list whose last column may hold unquoted
    commas: everything after the first comma is the question; blank lines are
    dropped and a line without a comma has a null question. ``header`` is the
    file's header line (its names are mapped by C3); header lines are dropped."""
    from ..operators.clean import discover_question_columns

    names = discover_question_columns(list(header))
    first, second = (names[header[0]], names[header[1]])
    parts = F.split(F.col("value"), ",", 2)
    d = spark.read.text(path).where((F.col("value") != F.lit(",".join(header))) & (F.trim("value") != ""))
    return d.select(F.try_element_at(parts, F.lit(1)).alias(first), F.try_element_at(parts, F.lit(2)).alias(second))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A3: JSON lines with an explicit schema; missing keys are null, blank lines
    are skipped, unparseable lines keep their text in ``_corrupt_record``."""
    s = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(s).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_import_folder(spark: SparkSession, path: str, glob: str = "*.csv") -> list[tuple[str, DataFrame]]:
    """A4: the matching files of a folder (not recursive) as (file name, rows of
    text columns), each with its own header. Files that differ in their headers
    are different tables; listing them is metadata work on the driver. A file
    without a readable header line gives a table without columns, so that it is
    counted and does not stop the others."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path, glob)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    files = sorted((x.getPath().getName(), x.getPath().toString()) for x in found if x.isFile())
    return [(name, spark.read.option("header", True).option("escape", '"').csv(p)) for name, p in files]


def csv_fields(line: str) -> Column:
    """The fields of a CSV line as an array; quoted fields may hold commas, and quotes written twice."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), F.col(line)), F.lit(',("(?:[^"]++|"")*+"|[^,]*)'), 1)
    inner = lambda c: F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(parts, lambda c: F.when(F.startswith(c, F.lit('"')) & (F.length(c) > 1), inner(c)).otherwise(c))


def read_folder_cells(spark: SparkSession, path: str, name: Callable[[Column], Column] = lambda header: header) -> DataFrame:
    """A4 in one scan: every record of the CSV and JSONL files below ``path`` as
    ``source_file`` and ``cells``, an array of (name, value) in file order, where
    ``name`` maps a header cell (for CSV once per file). The source is the file's
    name; of part files (``part-...``), the name of their folder.

    All files are one text relation, so the plan does not grow with their number.
    A CSV file's header is its first line, found as the line with the smallest
    position in the file's first block (a map-side reduced ``min_by`` per file)
    and joined back by file; a JSON line brings its own names. Blank lines are
    skipped; a JSON line that cannot be parsed gives one cell named
    ``_corrupt_record`` with its text (A3). Fields hold no line feeds.
    """
    meta = F.col("_metadata")
    folder = F.element_at(F.split(meta["file_path"], "/"), -2)
    source = F.when(F.startswith(meta["file_name"], F.lit("part-")), folder).otherwise(meta["file_name"])
    lines = spark.read.option("pathGlobFilter", "*.{csv,jsonl,json}").option("recursiveFileLookup", True).text(path).select(
        F.col("value").alias("line"), meta["file_path"].alias("file"), meta["file_name"].alias("name"), source.alias("source"),
        (meta["file_block_start"] == 0).alias("first_block"), F.monotonically_increasing_id().alias("pos"),
    ).where(F.trim("line") != "")
    is_json = F.col("name").rlike("\\.jsonl?$")
    csv = lines.where(~is_json).withColumn("_v", csv_fields("line"))
    heads = csv.where("first_block").groupBy(F.col("file").alias("_file")).agg(F.min("pos").alias("_at"), F.min_by("_v", "pos").alias("_h"))
    heads = heads.select("_file", "_at", F.transform("_h", lambda h: F.struct(name(h).alias("name"), (h != "").alias("given"))).alias("_names"))
    of_csv = csv.join(heads, F.col("file") == F.col("_file")).where("pos <> _at")
    cells = F.filter(F.arrays_zip("_names", "_v"), lambda c: c["_names"]["given"])
    cells = F.transform(cells, lambda c: F.struct(c["_names"]["name"].alias("name"), c["_v"].alias("value")))
    of_csv = of_csv.select(F.col("source").alias("source_file"), cells.alias("cells"))
    entries = F.transform(F.map_entries("_m"), lambda e: F.struct(name(e["key"]).alias("name"), e["value"].alias("value")))
    broken = F.array(F.struct(F.lit(CORRUPT).alias("name"), F.col("line").alias("value")))
    of_json = lines.where(is_json).withColumn("_m", F.from_json("line", "map<string,string>"))
    of_json = of_json.select(F.col("source").alias("source_file"), F.coalesce(entries, broken).alias("cells"))
    return of_csv.unionByName(of_json)


#: Partitions of page images that a task reads, if there are many.
TASK_PARTITIONS = 16
#: Columns of the binaryFile source, named for streams, which infer no schema.
IMAGE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _images(d: DataFrame) -> DataFrame:
    return d.select(F.element_at(F.split("path", "/"), -1).alias("image_name"), "path", "length", "content")


def read_page_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Landed page images as rows: file name, path, length, content. Files are read in whole, one row each.

    Spark counts 4 MB for opening a file, so a partition holds some 30 small ones;
    ``TASK_PARTITIONS`` of them are read by a task where there are many.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    n, least = files.select("path").rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism
    return _images(files.coalesce(max(least, -(-n // TASK_PARTITIONS))) if n > least else files)


def stream_page_images(spark: SparkSession, path: str, glob: str = "*.png", files_per_batch: int = 1000) -> DataFrame:
    """A6 as a stream: page images as they land, ``files_per_batch`` at most in a micro-batch, which few tasks read."""
    d = spark.readStream.format("binaryFile").schema(IMAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    files = d.option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return _images(files.coalesce(4 * spark.sparkContext.defaultParallelism))
