"""Run logs -> long table of (time, power) points: of texts that a row holds, or of files that many tasks read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.operators.scale import stage

# ---- fixed values ---------------------------------------------------------------------------
RESULTS_HEADER = "TRANSIENT RESULTS"
# what ends the results: the readers of closed-loop and training runs stop at the first, those of scheduled gains at the second
RESULTS_END = "CPU time breakdown"
ANY_CPU_TIME = "CPU time"
SKIPPED_AFTER_HEADER = 2
NUMBER = r"([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan)))"
ANY = r"(\S+)"
FOUR_TOKENS = (r"^\s*\S+\s+", r"\s+\S+\s+", r"(?:\s|$)")
# ---------------------------------------------------------------------------------------------


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file: run_id (file name) and text. A log is the output of one run."""
    files = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return files.select(name.alias("run_id"), F.col("value").alias("text"))


def _positions(lines: str, test) -> Column:
    hits = F.transform(lines, lambda s, i: F.when(test(s), i))
    return F.filter(hits, lambda i: i.isNotNull())


def run_log_points(df: DataFrame, ids: list[str], text: str = "text", end: str = RESULTS_END,
                   end_anywhere: bool = False, power_only: bool = False) -> DataFrame:
    """(ids, line, t, power) from the results section.

    A header line opens the section and swallows the two lines after it (so a header among those is
    not seen; a later one swallows two again). The first readable line that starts with `end` - or
    holds it, with `end_anywhere` - closes the log. Data lines have >= 4 tokens, numbers in the 4th and,
    unless `power_only`, in the 2nd. NaN and infinities are numbers: a run that diverged keeps its last points.

    The section borders are computed per log from the few header and end positions, then only the lines of the
    sections are exploded: no window and no shuffle, a run is parsed inside the task that read it.
    """
    is_end = _end_test(end, end_anywhere)
    marked = _split(df, ids, text).select(
        *ids, "_lines", F.size("_lines").alias("_size"),
        _positions("_lines", lambda s: F.contains(s, F.lit(RESULTS_HEADER))).alias("_seen"),
        _positions("_lines", is_end).alias("_ends"),
    )
    marked, stop, sections = _sections(marked, "int")
    bordered = marked.select(*ids, "_lines", stop.alias("_stop"), F.explode(sections).alias("_s"))
    bordered = bordered.select(*ids, "_lines", F.col("_s.start").alias("_start"), F.least("_s.end", "_stop").alias("_end"))
    return _points(bordered, ids, power_only)


def _end_test(end: str, anywhere: bool):
    return (lambda s: F.contains(s, F.lit(end))) if anywhere else (lambda s: F.startswith(F.ltrim(s), F.lit(end)))


def _sections(marked: DataFrame, kind: str) -> tuple[DataFrame, Column, Column]:
    """The table with the accepted headers, the line that ends the log, and the borders (start, end) of each section, from the
    sorted line numbers `_seen` of headers and `_ends` of end markers and the number `_size` of lines."""
    skip = SKIPPED_AFTER_HEADER
    headers = F.aggregate(
        "_seen",
        F.array().cast(f"array<{kind}>"),
        lambda kept, i: F.when(
            (F.size(kept) == 0) | (i > F.get(kept, F.size(kept) - 1) + skip), F.concat(kept, F.array(i))
        ).otherwise(kept),
    )
    marked = marked.withColumn("_headers", headers)
    opened = lambda i: F.array_max(F.filter("_headers", lambda h: h <= i)) + skip
    stop = F.array_min(F.filter("_ends", lambda i: F.coalesce(i > opened(i), F.lit(False))))
    sections = F.transform("_headers", lambda h, k: F.struct(
        (h + 1 + skip).alias("start"), F.coalesce(F.get("_headers", k + 1), F.col("_size")).alias("end")))
    return marked, stop, sections


def read_log_points(spark: SparkSession, path: str, end: str = RESULTS_END, end_anywhere: bool = False,
                    power_only: bool = False, by_folder: bool = False) -> DataFrame:
    """(run_id, line, t, power) of all log files of a folder, as `run_log_points` of whole texts, however large a log is.

    Logs are read line by line in blocks, which Spark cuts at any byte. The first pass counts the lines of every block and notes
    where in it headers and end markers stand; the counts of earlier blocks then give their line numbers, and those the sections'
    borders, a few for each log. The second pass reads the points of every block and keeps those inside a section. Only the
    marks and the data points move. A run is named after its file, or with `by_folder` after the folder that holds it alone.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = read.withColumn("at", F.monotonically_increasing_id())  # consecutive inside a block
    line = F.col("value")
    is_header, is_end = F.contains(line, F.lit(RESULTS_HEADER)), _end_test(end, end_anywhere)(line)
    mark = F.when(is_header | is_end, F.struct("at", is_header.alias("header"), is_end.alias("end")))
    blocks = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.collect_list(mark).alias("marks"))
    blocks = stage(blocks, "log-blocks")
    if not blocks.where("last - first != n - 1").isEmpty():
        raise ValueError("the lines of a block are not in one task")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    number = lambda kind: F.transform(F.filter("marks", lambda m: m[kind]), lambda m: m["at"] + F.col("before"))
    of_files = placed.groupBy("file").agg(
        F.sum("n").alias("_size"), F.array_sort(F.flatten(F.collect_list(number("header")))).alias("_seen"),
        F.array_sort(F.flatten(F.collect_list(number("end")))).alias("_ends"))
    of_files, stop, sections = _sections(of_files, "bigint")
    sections = of_files.select("file", stop.alias("_stop"), sections.alias("_sections")).where(F.size("_sections") > 0)
    from_line, to_line = F.col("before") + F.col("first"), F.col("before") + F.col("last")
    inside = placed.join(sections, "file").withColumn(
        "_own", F.filter("_sections", lambda s: (s["start"] <= to_line) & (s["end"] > from_line)))
    inside = inside.withColumn("_stop", F.coalesce("_stop", F.lit(1 << 62)))
    inside = stage(inside.where(F.size("_own") > 0).select("file", "block", "before", "_stop", "_own"), "log-sections")
    points = lines.select("file", "block", "at", _point(line, power_only).alias("_p")).where("_p.power is not null")
    kept = points.join(inside, ["file", "block"]).withColumn("line", F.col("at") + F.col("before"))
    kept = kept.where(F.col("line") < F.col("_stop")).where(F.exists("_own", lambda s: (s["start"] <= F.col("line")) & (F.col("line") < s["end"])))
    name = F.element_at(F.split("file", "/"), -2 if by_folder else -1)
    return kept.select(name.alias("run_id"), "line", F.col("_p.t").alias("t"), F.col("_p.power").alias("power"))


def run_log_points_unskipped(df: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Variant reader: nothing skipped, no end; lines that start with Time or CPU are ignored."""
    first = F.array_min(_positions("_lines", lambda s: F.contains(s, F.lit(RESULTS_HEADER))))
    bordered = _split(df, ids, text).select(*ids, "_lines", (first + 1).alias("_start"), F.size("_lines").alias("_end"))

    def other(line: Column) -> Column:
        bare = F.ltrim(line)
        ignored = F.startswith(bare, F.lit("Time")) | F.startswith(bare, F.lit("CPU"))
        return ~F.contains(line, F.lit(RESULTS_HEADER)) & ~ignored

    return _points(bordered, ids, power_only=True, keep=other)


def _split(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """Lines of the logs that have a results header at all; any of the three line ends."""
    unix = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return df.where(F.contains(F.col(text), F.lit(RESULTS_HEADER))).select(*ids, F.split(unix, "\n").alias("_lines"))


def _points(bordered: DataFrame, ids: list[str], power_only: bool, keep=None) -> DataFrame:
    """Data points among the lines _start.._end-1.

    The numbers are read before the lines are exploded, so that the filter on them does not read them again.
    """
    point = lambda line: _point(line, power_only, keep)
    body = F.slice("_lines", F.col("_start") + 1, F.col("_end") - F.col("_start"))
    points = bordered.where(F.col("_end") > F.col("_start")).select(
        *ids, "_start", F.posexplode(F.transform(body, point)).alias("_k", "_p"))
    return points.select(
        *ids, (F.col("_start") + F.col("_k")).alias("line"), F.col("_p.t").alias("t"), F.col("_p.power").alias("power")
    ).where(F.col("power").isNotNull())


def _point(line: Column, power_only: bool, keep=None) -> Column:
    """(t, power) of a line, null where it is no data line."""
    pattern = f"{FOUR_TOKENS[0]}{NUMBER if not power_only else ANY}{FOUR_TOKENS[1]}{NUMBER}{FOUR_TOKENS[2]}"
    text = lambda k: F.regexp_extract(line, pattern, k)
    number = lambda k: F.nullif(text(k), F.lit("")).try_cast("double")
    value = F.struct((F.lit(None) if power_only else number(1)).cast("double").alias("t"), number(2).alias("power"))
    return value if keep is None else F.when(keep(line), value)
