"""The stored article table and the files around it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("publication_date", T.DateType()),
        T.StructField("publication_types", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("relevant", T.IntegerType()),
    ]
)

# Dates are still text in the JSON map.
JSON_ARTICLE = "map<string, struct<url:string,publication_date:string,publication_types:string,title:string,abstract:string>>"


def write_articles(articles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The six fixed columns, one folder per publication year for date pruning.

    The rebalance hint gives each year files of about the advisory partition size:
    a year that holds most of the corpus is split, small years are not scattered.
    """
    columns = [F.col(f.name).cast(f.dataType) for f in ARTICLE_SCHEMA]
    table = articles.select(*columns, F.year("publication_date").alias("year"))
    table.hint("rebalance", "year").write.mode(mode).partitionBy("year").parquet(path)


def read_articles(
    spark: SparkSession, path: str, since: dt.date | None = None, before: dt.date | None = None, undated: bool = False
) -> DataFrame:
    """The stored articles from the date ``since`` on and up to ``before``, that day left out.

    Only the year folders that can hold such dates are read. With either bound
    articles without a date are left out, unless ``undated`` asks for them.
    """
    table = spark.read.parquet(path)
    year, day = F.col("year"), F.col("publication_date")
    inside = F.lit(True)
    if since:
        inside = inside & (year >= since.year) & (day >= F.lit(since))
    if before:
        inside = inside & (year <= before.year) & (day < F.lit(before))
    if since or before:
        table = table.filter(inside | year.isNull() if undated else inside)
    return table.select(*[F.col(f.name).cast(f.dataType) for f in ARTICLE_SCHEMA])


def parse_json_map(texts: DataFrame, column: str = "value") -> DataFrame:
    """Values of JSON objects ``id -> article``, one row per article."""
    parsed = F.from_json(column, JSON_ARTICLE, {"mode": "FAILFAST"})
    return texts.select(F.explode(F.map_entries(parsed)).alias("_e")).select(
        F.col("_e.key").alias("article_key"), "_e.value.*"
    )


# Between two entries of a map that is not written on a single line. No text inside a
# string can look like it: a line break within a JSON string is always escaped.
ENTRY_BORDER = "},\n"


def read_json_map(
    spark: SparkSession, path: str, border: str | None = ENTRY_BORDER, lines: bool = False
) -> DataFrame:
    """Articles of one JSON object per file, ``{id: article, ...}``, read in splits.

    The file is cut at the ``border`` between entries by the reader's record delimiter,
    so several tasks share a large file and none holds it whole. Each piece is made an
    object of its own and parsed strictly: a border that cut inside an entry fails
    instead of losing it. A file without any border is one piece. ``border=None``
    reads each file as one row; ``lines`` is for one object per line, as
    ``write_json_map`` writes it.
    """
    if lines:
        return parse_json_map(spark.read.text(path))
    if border is None:
        return parse_json_map(spark.read.text(path, wholetext=True))
    if not border.startswith("}"):
        raise ValueError("a border begins with the closing brace of an entry")
    piece = F.regexp_replace("value", r"^[\s\x{FEFF}]+|\s+\z", "")
    # The first piece opens the object; the last one closes its entry and the object, while
    # in all others the border took the closing brace of the entry. A flat entry ends in a
    # value, so a brace at the end tells the last piece; an entry may also be empty.
    opened = F.when(piece.startswith("{"), piece).otherwise(F.concat(F.lit("{"), piece))
    whole = F.when(piece.endswith("}"), opened).otherwise(F.concat(opened, F.lit("}}")))
    pieces = spark.read.option("lineSep", border).text(path).filter(piece != "")
    return parse_json_map(pieces.select(whole.alias("value")))


def write_json_map(articles: DataFrame, path: str, key: str = "article_id", objects: bool = False) -> None:
    """One single-entry object per line; with ``objects`` one object per file, an entry on each line."""
    body = F.struct("url", F.col("publication_date").cast("string").alias("publication_date"),
                    "publication_types", "title", "abstract")
    entry = F.to_json(F.create_map(F.col(key).cast("string"), body))
    if not objects:
        articles.select(entry.alias("value")).write.text(path)
        return

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An entry is followed by a comma if another one comes.
        last = "{"
        for batch in batches:
            found = [last]
            for text in batch.column(0).to_pylist():
                found[-1] += "," if len(found) > 1 or last != "{" else ""
                found.append(text)
            last = found.pop()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([last, "}"], pa.string())], names=["value"])

    bare = F.substring(entry, F.lit(2), F.length(entry) - 2)
    articles.select(bare.alias("value")).mapInArrow(lines, "value string").write.text(path)


# How a title is written so that it stays on one line and whole.
ESCAPES = (("\\", "\\\\"), ("|", "\\p"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\z"))
EMPTY, NULL = "\\e", "\\0"
# Blanks at the ends, which a file of fields may lose.
_BLANK = "\\s"


def encode_title(title: Column) -> Column:
    """Reversible: no separator, no line break, no blank at either end, never empty."""
    text = title
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    # Blanks, tabs and other characters up to the blank are cut at the ends of a field, and a
    # hash at its beginning makes the writer quote it.
    text = F.regexp_replace(text, r"^([\x01-\x20#])", r"\\s$1\\s")
    text = F.regexp_replace(text, r"([\x01-\x20])\z", r"\\s$1\\s")
    return F.when(title.isNull(), F.lit(NULL)).when(title == "", F.lit(EMPTY)).otherwise(text)


def decode_title(text: Column) -> Column:
    """The title that ``encode_title`` was given. An escape it never writes stays as it is."""
    # No written title holds a bare separator, so a backslash before one can stand for a doubled one.
    marked = "\\|"
    plain = F.replace(text, F.lit(ESCAPES[0][1]), F.lit(marked))
    for character, written in (*ESCAPES[1:], ("", _BLANK)):
        plain = F.replace(plain, F.lit(written), F.lit(character))
    plain = F.replace(plain, F.lit(marked), F.lit("\\"))
    return F.when(text == NULL, F.lit(None)).when(text == EMPTY, F.lit("")).otherwise(plain)


def read_label_file(spark: SparkSession, path: str, escaped: bool = True) -> DataFrame:
    """Pipe-separated with a header; quotes and brackets belong to the title.

    ``escaped`` for files of ``write_label_file``; without it titles are taken as they stand.
    """
    titles = spark.read.schema("title string").csv(path, sep="|", header=True, quote="")
    return titles.select(decode_title(F.col("title")).alias("title")) if escaped else titles


def write_label_file(titles: DataFrame, path: str) -> None:
    """Every title can be read back, whatever its characters; see ``encode_title``."""
    titles.select(encode_title(F.col("title")).alias("title")).write.csv(path, sep="|", header=True, quote="", escapeQuotes=False)


def write_in_order(
    df: DataFrame, path: str, order: Sequence[Column], kind: str, slices: int | None = None, **options
) -> None:
    """Numbered files whose rows, read in the order of their names, rise along ``order``.

    Rows are cut into ranges of ``order``, one file for each of about ``slices`` ranges; by default
    of as many as the session shuffles in, of which small neighbours are merged.
    """
    ranges = df.repartitionByRange(*order) if slices is None else df.repartitionByRange(slices, *order)
    placed = ranges.sortWithinPartitions(*order)
    placed.write.format(kind).options(**options).save(path)


def write_curves(curves: DataFrame, path: str) -> None:
    """One ``x,y`` file per ``plot`` and ``fold``, its points from left to right.

    A curve is a picture of as many points as there are different scores; curves go to
    different tasks.
    """
    columns = curves.select("plot", "fold", "x", "y")
    rising = columns.repartition("plot", "fold").sortWithinPartitions("plot", "fold", "x", "y")
    rising.write.partitionBy("plot", "fold").option("maxRecordsPerFile", 0).csv(path, header=True)


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("x double, y double, plot string, fold string").csv(path, header=True)


def write_ranked(ranked: DataFrame, path: str, slices: int | None = None) -> None:
    """JSON rows of one export table in the order of their ``rank``, in ``slices`` files, see ``write_in_order``."""
    write_in_order(ranked, path, [F.col("rank")], "json", slices)
