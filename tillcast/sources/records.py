"""CSV records from byte ranges: quoted line breaks without reading a file in one task.

Spark splits text files into byte ranges and hands each task whole lines. Where
records may hold line breaks, whether a line starts a record depends on all
quotes before it. Two passes settle that:

1. Each range reports where it would end - inside a quoted field or not - for
   either way it may begin (two booleans a range). A running composition of
   these per file tells how every range really begins.
2. Each range joins its lines to records. Only the pieces of records that
   cross a range's border are grouped, one group a record, and joined.

Quotes count where CSV gives them a meaning: a field is quoted if it begins
with a quote, and ends at a quote that is not doubled; elsewhere a quote is text.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

MAX_OPEN = 1_000_000  # ranges that begin inside a field (their names go to the tasks); beyond it an error

_CLOSE = re.compile(r'(?:[^"]|"")*+"')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of ``line`` lies inside a quoted field, if its begin does (or does not)."""
    at = 0
    while True:
        if inside:
            m = _CLOSE.match(line, at)
            if not m:
                return True
            inside, at = False, line.find(",", m.end())
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        else:
            at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, block, first, end): neighbouring rows of one range."""
    files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    lo = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or files[i] != files[lo] or blocks[i] != blocks[lo]:
            yield files[lo], blocks[lo], lo, i
            lo = i


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(list(files))
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _ends(lines: DataFrame) -> DataFrame:
    """(file, block, from_outside, from_inside): how each range ends for either begin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            quoted = pc.match_substring(batch.column(0), '"').to_numpy(zero_copy_only=False)
            for file, block, lo, hi in _runs(batch):
                ends = state.setdefault((file, block), [False, True])
                for i in quoted[lo:hi].nonzero()[0]:  # a line without quotes ends as it begins
                    line = batch.column(0)[lo + int(i)].as_py()
                    ends[:] = [ends_inside(line, e) for e in ends]
        rows = [(f, b, *e) for (f, b), e in state.items()]
        yield pa.RecordBatch.from_pydict({"file": pa.array([r[0] for r in rows], pa.string()), "block": pa.array([r[1] for r in rows], pa.int64()),
                                          "from_outside": pa.array([r[2] for r in rows], pa.bool_()),
                                          "from_inside": pa.array([r[3] for r in rows], pa.bool_())})
    return lines.mapInArrow(run, "file string, block long, from_outside boolean, from_inside boolean")


def _begins(ends: DataFrame) -> DataFrame:
    """(file, block, inside): whether the range begins inside a field.

    A range either forces its end (both begins end alike), or passes its begin
    on, or turns it over. One row a range is ordered per file."""
    w = Window.partitionBy("file").orderBy("block")
    turns = F.when(F.col("from_outside") == F.col("from_inside"), 0).otherwise(F.col("from_outside").cast("int"))
    seen = F.sum("turn").over(w) % 2
    forced = F.when(F.col("from_outside") == F.col("from_inside"), (F.col("from_outside").cast("int") + F.col("turns")) % 2)
    out = ends.withColumn("turn", turns).withColumn("turns", seen).withColumn("forced", forced)
    end = (F.coalesce(F.last("forced", True).over(w), F.lit(0)) + F.col("turns")) % 2 == 1  # where the range really ends
    out = out.withColumn("ends", end).withColumn("inside", F.coalesce(F.lag("ends").over(w), F.lit(False)))
    return out.select("file", "block", "inside")


def _joined(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """Records and pieces: (file, block, kind, record); kind 0 a whole record, 1 the end of one, 2 the begin of one,
    3 a range without any border of a record. The header line is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_lines, borders, began, first = None, [], 0, False, False

        def left() -> list[tuple]:
            if at is None or not open_lines or first:
                return []
            return [(*at, 3 if began and not borders else 2, "\n".join(open_lines))]
        for batch in batches:
            out = []
            special = pc.match_substring_regex(batch.column(0), "[\"\r]")
            for file, block, lo, hi in _runs(batch):
                if (file, block) != at:
                    out += left()
                    at, open_lines, borders = (file, block), [], 0
                    began, first = (file, block) in inside, block == 0
                    now = began
                lines = batch.column(0).slice(lo, hi - lo)
                if not (now or open_lines or first) and not pc.any(special.slice(lo, hi - lo)).as_py():
                    yield _whole(file, block, lines)  # every line is a record
                    borders += hi - lo
                    continue
                for line in lines.to_pylist():
                    open_lines.append(line)
                    now = ends_inside(line, now) if '"' in line else now
                    if not now:
                        whole = began is False or borders > 0
                        if first:
                            first = False
                        else:
                            out.append((*at, 0 if whole else 1, "\n".join(open_lines).removesuffix("\r")))
                        open_lines, borders = [], borders + 1
            yield _batch(out)
        yield _batch(left())

    def _whole(file: str, block: int, records: pa.Array) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_pydict({"file": pa.repeat(pa.scalar(file, pa.string()), n), "block": pa.repeat(pa.scalar(block, pa.int64()), n),
                                           "kind": pa.repeat(pa.scalar(0, pa.int32()), n), "record": records.cast(pa.string())})

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": pa.array([r[0] for r in rows], pa.string()), "block": pa.array([r[1] for r in rows], pa.int64()),
                                           "kind": pa.array([r[2] for r in rows], pa.int32()), "record": pa.array([r[3] for r in rows], pa.string())})
    return lines.mapInArrow(run, "file string, block long, kind int, record string")


def records(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(record): the CSV records of files with a header each, without the headers and empty lines."""
    ship_package(spark)
    lines = _lines(spark, files)
    open_ranges = _begins(cut_lineage(_ends(lines), "ranges")).where("inside").select("file", "block")
    inside = {(r.file, r.block) for r in open_ranges.limit(MAX_OPEN + 1).collect()}
    if len(inside) > MAX_OPEN:
        raise ValueError(f"more than {MAX_OPEN} ranges begin inside a quoted field: set larger spark.sql.files.maxPartitionBytes")
    parts = _joined(lines, inside)
    if not inside:  # one reading; kind 2 is a last field that no quote closes
        return parts.where(F.col("kind").isin(0, 2) & (F.length(F.trim("record")) > 0)).select("record")
    whole = parts.where("kind = 0").select("record")
    # A crossing record is a begin (2), ranges inside it (3) and an end (1), in the order of blocks; within a
    # range the end of the earlier record comes before the begin of the next. At most two pieces a range.
    begins = F.when(F.col("kind") == 2, 1).otherwise(0)
    w = Window.partitionBy("file").orderBy("block", "begins").rowsBetween(Window.unboundedPreceding, 0)
    pieces = parts.where("kind > 0").withColumn("begins", begins)
    crossing = (pieces.withColumn("number", F.sum("begins").over(w)).where("number > 0").groupBy("file", "number")
                .agg(F.array_sort(F.collect_list(F.struct("block", "begins", "record"))).alias("p"))
                .select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))
    whole = whole.unionByName(crossing)
    return whole.where(F.length(F.trim("record")) > 0)


def layouts(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """(header, files) of each distinct header among the files, in the order of their first file.

    The first record of every file is read on the driver, 16 files at a time;
    files without one are left out."""
    uri = lambda f: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(f)).toString()
    files = sorted(uri(f) for f in spark.read.text(paths if isinstance(paths, str) else list(paths)).inputFiles())
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: _header(spark, f), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(headers, files, strict=True):
        if header:
            out.setdefault(tuple(header), []).append(file)
    if not out:
        raise ValueError("no file with a header")
    return [(list(h), f) for h, f in out.items()]


def _header(spark: SparkSession, file: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        line = reader.readLine()
        if line is None:
            return []
        text, inside = line, ends_inside(line, False)
        while inside and (line := reader.readLine()) is not None:
            text, inside = f"{text}\n{line}", ends_inside(line, True)
    finally:
        reader.close()
    names, seen = [], {}
    for i, name in enumerate(next(csv.reader([text.removeprefix("﻿")], strict=False))):
        name = name or f"_c{i}"
        seen[name.lower()] = seen.get(name.lower(), 0) + 1
        names.append(name)
    return [f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(names)]
