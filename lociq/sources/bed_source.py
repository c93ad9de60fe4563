"""BED files as a data source: read by byte ranges with filters pushed into it, and written as one file for each
motif, strand and stretch of a chromosome, named as the scan names its files.

    read_beds(spark, path).where("chrom = '1' AND motif = 'TP73_MA0861.1'")
    write_motif_files(hits, path)

Paths are anything that pyarrow.fs opens on the driver and the executors alike.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import file_safe
from ..schema import SITE

#: Bytes that one task reads, and bases of a chromosome that one file holds.
RANGE, STRETCH = 32 << 20, 1 << 24
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: <name>_<id>_<side>[_<chromosome>[_<from>-<to>]][_thresh_<number>].bed
FILE = re.compile(r"(?P<motif>.+)_(?P<side>positive|negative)(?:_(?!thresh_)(?P<chrom>[^_]+?)(?:_\d+-\d+)?)?(?:_thresh_[-\d.]+)?\.bed(?:\.gz)?$")
COLUMNS = ["chrom", "start", "end", "name", "score", "strand"]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^(file:)?(?=/(?!/))", "file://", path))


@dataclass
class Range:
    path: str
    start: int
    end: int
    motif: str | None


@dataclass
class Share(InputPartition):
    """What one task reads: a range of a large file, or several small files."""

    ranges: list[Range]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # temporary and final names


class BedSource(DataSource):
    """Columns chrom, start, end, name, score, strand, motif (of the file's name, null if it has none)."""

    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> StructType:
        return StructType([*SITE.fields, StructField("motif", StringType())])

    def reader(self, schema: StructType) -> BedReader:
        return BedReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BedWriter:
        return BedWriter(self.options, overwrite)


class BedReader(DataSourceReader):
    """Each task reads ranges of bytes: the lines that begin in them. Compressed files are read whole by one task.

    Equality with constants on chrom and motif is taken over: files whose name tells another one aren't opened, and
    other lines are left out before they become rows."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("bytes", RANGE))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("chrom",), ("motif",)):
                values = set(f.value if isinstance(f, In) else [f.value])
                mine = self.wanted.setdefault(f.attribute[0], values)
                mine &= values
            else:
                yield f  # Spark's own work

    def _asked_for(self, column: str, value: str | None) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[Share]:
        files, where = opened(self.path)
        found = files.get_file_info(fs.FileSelector(where, recursive=True)) if files.get_file_info(where).type == fs.FileType.Directory else [files.get_file_info(where)]
        out = []
        for info in sorted((i for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))), key=lambda i: i.path):
            said = FILE.match(info.base_name)
            motif = said["motif"] if said else None
            if not self._asked_for("motif", motif) or said and said["chrom"] and not self._asked_for("chrom", said["chrom"]):
                continue
            step = info.size if info.base_name.endswith(".gz") else self.size
            out += [Range(info.path, a, min(a + step, info.size), motif) for a in range(0, info.size, max(1, step))]
        shares, taken = [], 0
        for part in out:
            if not shares or taken + part.end - part.start > self.size:
                shares.append(Share([]))
                taken = 0
            shares[-1].ranges.append(part)
            taken += part.end - part.start
        return shares

    def _lines(self, part: Range) -> Iterator[bytes]:
        files, _ = opened(self.path)
        if part.path.endswith(".gz"):
            with files.open_input_stream(part.path, compression=None) as raw, gzip.open(raw) as text:
                yield from text
            return
        with files.open_input_file(part.path) as raw:
            at = max(0, part.start - 1)
            raw.seek(at)
            rest, skip = b"", part.start > 0  # what was begun in the range before ends at the first line break
            while True:
                block = raw.read(1 << 20)
                lines = (rest + block).split(b"\n")
                rest = lines.pop() if block else b""
                for line in lines:
                    if not skip:
                        if at >= part.end:
                            return
                        yield line
                    skip, at = False, at + len(line) + 1
                if not block:
                    return

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        for part in share.ranges:
            yield from self._batches(part)

    def _batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]

        def batch(rows):
            columns = list(zip(*rows)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), pa.array([part.motif] * len(rows), pa.string())], names=[*COLUMNS, "motif"])

        rows = []
        for line in self._lines(part):
            if line.startswith((b"Chr", b"#")):
                continue
            fields = line.decode("utf-8", "replace").split()
            if len(fields) < 6 or not self._asked_for("chrom", fields[0]):
                continue
            try:
                rows.append((fields[0], int(fields[1]), int(fields[2]), fields[3], float(fields[4]), fields[5]))
            except ValueError:  # not a line of a BED file
                continue
            if len(rows) == 50_000:
                yield batch(rows)
                rows = []
        yield batch(rows)


class BedWriter(DataSourceArrowWriter):
    """Rows (file, and the fields of a line), those of a file together. A task writes under hidden names of this job;
    only when all tasks are done do the files get their own, so that a failed task or job leaves none."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, where = opened(self.path)
        files.create_dir(where, recursive=True)
        now, out, done = None, None, Written()
        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in batch.schema.names]
            at = {c: columns[i] for i, c in enumerate(batch.schema.names)}
            match = at.get("match")
            for k, name in enumerate(at["file"]):
                if name != now:
                    if out:
                        out.close()
                    if name in {f for _, f in done.files}:
                        raise ValueError(f"the rows of {name} aren't together")
                    done.files.append((f".{self.job}-{uuid.uuid4().hex}", name))
                    now, out = name, files.open_output_stream(f"{where}/{done.files[-1][0]}")
                line = f"{at['chrom'][k]}\t{at['start'][k]}\t{at['end'][k]}\t{at['name'][k]}\t{at['score'][k]:.3f}\t{at['strand'][k]}"
                out.write((line + (f"\t{match[k]}" if match else "") + "\n").encode())
        if out:
            out.close()
        return done

    def _left_over(self) -> None:
        files, where = opened(self.path)
        for info in files.get_file_info(fs.FileSelector(where, allow_not_found=True)):
            if info.base_name.startswith(f".{self.job}-"):
                files.delete_file(info.path)

    def commit(self, messages) -> None:
        files, where = opened(self.path)
        if self.overwrite:
            for info in files.get_file_info(fs.FileSelector(where)):
                if info.type == fs.FileType.File and FILE.match(info.base_name):
                    files.delete_file(info.path)
        for message in messages:
            for own, name in message.files if message else []:
                files.move(f"{where}/{own}", f"{where}/{name}")
        self._left_over()

    def abort(self, messages) -> None:
        self._left_over()


def motif_file(*, threshold: float | None = None, stretch: int | None = STRETCH) -> F.Column:
    """The name of a hit's file: of its motif and strand, its stretch of a chromosome, and the threshold."""
    side = F.when(F.col("strand") == "-", "negative").otherwise("positive")
    first = F.floor((F.col("start") - 1) / F.lit(stretch or 1)).cast("long") * (stretch or 1)
    where = F.concat(F.lit("_"), "chrom", F.lit("_"), (first + 1).cast("string"), F.lit("-"), (first + (stretch or 1)).cast("string")) if stretch else F.lit("")
    return F.concat(file_safe(F.col("name")), F.lit("_"), file_safe(F.col("motif_id")), F.lit("_"), side, where, F.lit(f"_thresh_{threshold:f}.bed" if threshold else ".bed"))


def write_motif_files(hits: DataFrame, path: str, *, threshold: float | None = None, stretch: int | None = STRETCH, mode: str = "append") -> None:
    """hits (motif_id, name, chrom, start, end, score, strand, perhaps match) as BED files in one folder; stretch None:
    one file for each motif and strand, however large, which one task writes."""
    spark = hits.sparkSession
    spark.dataSource.register(BedSource)
    columns = ["chrom", "start", "end", "name", "score", "strand", *(["match"] if "match" in hits.columns else [])]
    rows = hits.select(motif_file(threshold=threshold, stretch=stretch).alias("file"), *columns).repartition("file").sortWithinPartitions("file", "chrom", "start")
    rows.write.format("bed").mode(mode).save(path)


def read_beds(spark: SparkSession, path: str, *, size: int = RANGE) -> DataFrame:
    """BED files by byte ranges; filters on chrom and motif are pushed down (a setting of the session, which stays)."""
    spark.dataSource.register(BedSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("bed").option("bytes", size).load(path)
