"""Recordings and their annotations: signal files, channel names, sampling rates, event texts.

Signal files are in the European Data Format, whose header and 16-bit records are public. The source `signal_files`
deals the records of a file to tasks by ranges of bytes; decode() takes files as binary values, one task a file. Both
give the same chunks of a bounded number of samples. Names and rates are checked as columns beside the chunks, so that
a file is read once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sigwarn.operators.ordered import rebuild_clock

#: The channels of a complete recording, in order.
CHANNELS = ("FP1-F7", "F7-T7", "T7-P7", "P7-O1", "FP1-F3", "F3-C3", "C3-P3", "P3-O1", "FP2-F4", "F4-C4", "C4-P4", "P4-O2", "FP2-F8", "F8-T8", "T8-P8", "P8-O2", "FZ-CZ", "CZ-PZ")
#: Samples of one channel in a row of the chunk table.
CHUNK_SAMPLES = 65_536
CHUNKS = "path string, place int, start_sample long, fs double, samples array<float>, names array<string>, error string"
CHUNK_ROWS = pa.schema([("path", pa.string()), ("place", pa.int32()), ("start_sample", pa.int64()), ("fs", pa.float64()), ("samples", pa.list_(pa.float32())), ("names", pa.list_(pa.string())), ("error", pa.string())])
#: Bytes that a task of the source reads, about; a file counts as this part of them at least.
TASK_BYTES, LEAST_SHARE = 64 << 20, 256
_SCALE = {"V": 1.0, "MV": 1e-3, "UV": 1e-6}


def header(content: bytes, size: int | None = None) -> dict:
    """Names, rates, scales and places of the signals of a file of `size` bytes, from its first bytes. Raises ValueError where it is no such file."""
    size = len(content) if size is None else size
    if len(content) < 256 or content[:8].strip() != b"0":
        raise ValueError("no signal file header")
    text = lambda a, b: content[a:b].decode("latin-1").strip()
    count, seconds, start, records = int(text(252, 256)), float(text(244, 252)), int(text(184, 192)), int(text(236, 244))
    if count < 1 or seconds <= 0 or start != 256 * (count + 1) or len(content) < start:
        raise ValueError("header and size disagree")
    at, fields = 256, {}
    for name, width in (("name", 16), ("sensor", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 80), ("samples", 8)):
        fields[name] = [text(at + k * width, at + (k + 1) * width) for k in range(count)]
        at += count * width
    low, high, d_low, d_high = (np.array(fields[k], dtype=float) for k in ("low", "high", "digital_low", "digital_high"))
    samples = np.array(fields["samples"], dtype=np.int64)
    if (d_high == d_low).any() or (samples < 1).any():
        raise ValueError("a signal without range or samples")
    unit = np.array([_SCALE.get(u.upper().replace("µ", "U"), 1.0) for u in fields["unit"]])
    gain = (high - low) / (d_high - d_low) * unit
    held = (size - start) // (2 * int(samples.sum()))
    return {"names": fields["name"], "samples": samples, "rates": samples / seconds, "gain": gain, "shift": low * unit - d_low * gain, "start": start, "records": held if records < 0 else min(records, held)}


def encode(names: list[str], signals: list[np.ndarray], rate: int, unit: str = "uV") -> bytes:
    """A signal file of 16-bit integers that stand for tenths of a unit, in records of a second, filled up with 0."""
    records = max(-(-len(s) // rate) for s in signals)
    field = lambda values, width: b"".join(str(v).encode("latin-1").ljust(width)[:width] for v in values)
    n, same = len(names), lambda v: [v] * len(names)
    head = field(["0"], 8) + field(["", ""], 80) + field(["01.01.00", "00.00.00", 256 * (n + 1)], 8) + field([""], 44) + field([records, 1], 8) + field([n], 4)
    head += field(names, 16) + field(same(""), 80) + b"".join(field(same(v), 8) for v in (unit, "-3276.8", "3276.7", -32768, 32767)) + field(same(""), 80) + field(same(rate), 8) + field(same(""), 32)
    padded = np.stack([np.pad(np.asarray(s, dtype="<i2"), (0, records * rate - len(s))).reshape(records, rate) for s in signals], axis=1)
    return head + padded.tobytes()


def piece_records(h: dict, chunk: int) -> int:
    """Records of a piece of a file: its fastest signal has about `chunk` samples in them."""
    return max(1, chunk // int(h["samples"].max()))


def piece_chunks(path: str, h: dict, first: int, content: bytes) -> Iterator[dict]:
    """A chunk row for each signal of the records in content, which begin at record `first` of their file."""
    data = np.frombuffer(content, "<i2").reshape(-1, int(h["samples"].sum()))
    ends = np.cumsum(h["samples"])
    for k, n in enumerate(h["samples"].tolist()):
        values = data[:, ends[k] - n : ends[k]].ravel() * h["gain"][k] + h["shift"][k]
        yield {"path": path, "place": k, "start_sample": first * n, "fs": float(h["rates"][k]), "samples": values.astype(np.float32), "names": h["names"]}


def _decoded(path: str, content: bytes, chunk: int) -> Iterator[dict]:
    try:
        h = header(content)
    except ValueError as error:
        yield {"path": path, "error": str(error)}
        return
    width, step = 2 * int(h["samples"].sum()), piece_records(h, chunk)
    for r in range(0, h["records"], step):
        yield from piece_chunks(path, h, r, content[h["start"] + r * width : h["start"] + min(r + step, h["records"]) * width])


def decode(files: DataFrame, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Chunk rows of files(path, content), in volts: CHUNKS. A file that can't be read is one row with its error.

    A file cut short gives its complete records. place is a signal's place among names, the names of the file. A chunk
    has the records in which the file's fastest signal has about `chunk` samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for row in _decoded(path, content.as_py() or b"", chunk):
                    yield pa.RecordBatch.from_pylist([row], schema=CHUNK_ROWS)

    return files.select("path", "content").mapInArrow(run, CHUNKS)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range:
    """Bytes of a file; a piece of records belongs to the range in which it begins."""

    path: str
    size: int
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What a task reads: a part of a long file, or several short files."""

    ranges: list[Range]


class SignalFiles(DataSource):
    """Chunk rows of the signal files below a folder, as decode() gives them, read by ranges of bytes.

    Options: path, a folder on a file system that all executors reach (a local or mounted one, or an address that
    pyarrow.fs knows: hdfs, s3, gs); pattern of file names (*.edf); chunk (CHUNK_SAMPLES); task_bytes (TASK_BYTES).
    The driver sees names and sizes alone. A task reads its file's header and then one piece of records at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "signal_files"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return SignalReader(self.options["path"], self.options.get("pattern", "*.edf"), int(self.options.get("chunk", CHUNK_SAMPLES)), int(self.options.get("task_bytes", TASK_BYTES)))


class SignalReader(DataSourceReader):
    """The reader of SignalFiles."""

    def __init__(self, folder: str, pattern: str, chunk: int, task_bytes: int) -> None:
        if chunk < 1 or task_bytes < 1:
            raise ValueError("chunk and task_bytes are at least 1")
        self.folder, self.pattern, self.chunk, self.task_bytes = folder, pattern, chunk, task_bytes

    def partitions(self) -> Sequence[InputPartition]:
        store, folder = file_system(self.folder)
        found = [f for f in store.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file and fnmatch(f.base_name, self.pattern)]
        # an empty file still has one range, which reports it
        ranges = [Range(f.path, f.size, at, min(at + self.task_bytes, f.size)) for f in sorted(found, key=lambda f: f.path) for at in range(0, max(1, f.size), self.task_bytes)]
        tasks, room = [Ranges([])], self.task_bytes
        for r in ranges:
            cost = max(r.end - r.start, self.task_bytes // LEAST_SHARE)
            if cost > room and tasks[-1].ranges:
                tasks.append(Ranges([]))
                room = self.task_bytes
            tasks[-1].ranges.append(r)
            room -= cost
        return tasks

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.folder)
        rows, held = [], 0
        for part in partition.ranges:
            with store.open_input_file(part.path) as file:
                for row in self._rows(file, part):
                    rows.append(row)
                    held += len(row.get("samples", ())) + 100
                    if held >= self.chunk:
                        yield pa.RecordBatch.from_pylist(rows, schema=CHUNK_ROWS)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=CHUNK_ROWS)

    def _rows(self, file: pa.NativeFile, part: Range) -> Iterator[dict]:
        try:
            head = file.read_at(min(256, part.size), 0)
            count = int(head[252:256].decode("latin-1").strip() or 0) if len(head) == 256 else 0
            h = header(file.read_at(min(256 * (max(count, 0) + 1), part.size), 0), part.size)
        except ValueError as error:
            if part.start == 0:
                yield {"path": part.path, "error": str(error)}
            return
        width, step = 2 * int(h["samples"].sum()), piece_records(h, self.chunk)
        begin = max(0, -(-(part.start - h["start"]) // (step * width))) * step
        for r in range(begin, h["records"], step):
            if h["start"] + r * width >= part.end:
                return
            n = min(step, h["records"] - r)
            yield from piece_chunks(part.path, h, r, file.read_at(n * width, h["start"] + r * width))


def read_ranges(spark: SparkSession, path: str, chunk: int = CHUNK_SAMPLES, task_bytes: int = TASK_BYTES, pattern: str = "*.edf") -> DataFrame:
    """Chunk rows of the signal files below a folder; files of any size, several tasks a file (SignalFiles)."""
    spark.dataSource.register(SignalFiles)
    return spark.read.format("signal_files").option("chunk", chunk).option("task_bytes", task_bytes).option("pattern", pattern).load(path)


def write_files(files: DataFrame, folder: str) -> int:
    """Write content of each (path, content) to path below a folder that all executors reach; the number of files.

    A file appears under its name when it is complete, so a task that is run again leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                parent, _, name = f"{root}/{path}".rpartition("/")
                store.create_dir(parent, recursive=True)
                unfinished = f"{parent}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(unfinished) as out:
                    out.write(content.as_py() or b"")
                store.move(unfinished, f"{parent}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_files(spark: SparkSession, path: str, pattern: str = "*.edf") -> DataFrame:
    """(path, content) of the signal files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def normal_name(name: Column) -> Column:
    """Upper case, without outer white space, one hyphen without blanks around it, no double blanks."""
    out = F.upper(F.regexp_replace(name, r"^\s+|\s+$", ""))
    for old, new in ((" - ", "-"), (" -", "-"), ("- ", "-"), ("  ", " ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def channel_places(names: Column, targets: tuple[str, ...] = CHANNELS) -> Column:
    """An array of (ch_idx, channel, place) of the targets among the names of a recording; place is null where missing.

    A name counts after normal_name(). Of equal names the last counts. A target without its name takes the name with
    -0 behind it, which the first of several equal channels is given.
    """
    normal = F.transform(names, normal_name)

    def one(target: Column, k: Column) -> Column:
        key = normal_name(target)
        last = lambda x: F.size(names) - F.array_position(F.reverse(normal), x)
        place = F.when(F.array_contains(normal, key), last(key)).when(F.array_contains(normal, F.concat(key, F.lit("-0"))), last(F.concat(key, F.lit("-0"))))
        return F.struct(k.alias("ch_idx"), target.alias("channel"), place.cast("int").alias("place"))

    return F.transform(F.array(*[F.lit(t) for t in targets]), one)


def map_channels(raw: DataFrame, by: list[str], name: str = "name", order: str = "place", targets: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(by, channels, missing) of recordings given by a row per raw channel: channel_places() and the targets not found."""
    listed = raw.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name]).alias("names"))
    found = listed.select(*by, channel_places(F.col("names"), targets).alias("channels"))
    return found.withColumn("missing", missing_channels(F.col("channels")))


def missing_channels(channels: Column) -> Column:
    return F.transform(F.filter(channels, lambda c: c["place"].isNull()), lambda c: c["channel"])


def check_rate(recordings: DataFrame, expected: int, rate: str = "fs") -> DataFrame:
    """recordings with `accepted`: whether the rate, without its fraction, is the expected one; a null rate is not."""
    return recordings.withColumn("accepted", F.coalesce(F.floor(rate) == expected, F.lit(False)))


def load(files: DataFrame, expected: int, targets: tuple[str, ...] = CHANNELS, chunk: int = CHUNK_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """complete() of files(path, content)."""
    return complete(decode(files, chunk), expected, targets)


def complete(chunks: DataFrame, expected: int, targets: tuple[str, ...] = CHANNELS) -> tuple[DataFrame, DataFrame]:
    """The chunk table (path, channel, ch_idx, start_sample, fs, samples) of complete files with the expected rate, and (path, reason) of the others."""
    chunks = check_rate(chunks, expected).withColumn("channels", channel_places(F.col("names"), targets))
    missing = missing_channels(F.col("channels"))
    reason = F.coalesce("error", F.when(~F.col("accepted"), F.concat(F.lit("rate "), F.col("fs").cast("string"))), F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))))
    chunks = chunks.withColumn("reason", reason)
    own = F.filter("channels", lambda c: c["place"] == F.col("place"))
    kept = chunks.where("reason is null").select("path", F.inline(own), "start_sample", "fs", "samples").drop("place")
    return kept, chunks.where("reason is not null").select("path", "reason").distinct()


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(subject_id, text) of the annotation texts below a folder; the subject is the name of a text's own folder."""
    texts = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    folder = F.regexp_extract(F.input_file_name(), r"([^/]*)/[^/]*$", 1)
    return texts.select(F.regexp_replace(folder, "^[^=]*=", "").alias("subject_id"), F.col("value").alias("text"))


def annotation_blocks(texts: DataFrame, event: str = "Seizure") -> DataFrame:
    """(subject_id, seq, recording_id, declared, onsets, offsets, start_clock, end_clock): a row per file that a text names.

    Blocks begin at `File Name:`. Times are whole seconds after `<event> Start Time:` or `<event> 3 Start Time:`, upper
    or lower case; declared is null where a block has no number of events.
    """
    block = F.col("block")
    pick = lambda rule: F.nullif(F.regexp_extract(block, "(?i)" + rule, 1), F.lit(""))
    times = lambda end: F.transform(F.regexp_extract_all(block, F.lit(rf"(?i){event}(?:\s+\d+)?\s+{end} Time:\s*(\d+)\s+seconds"), F.lit(1)), lambda x: x.cast("double"))
    blocks = texts.select("subject_id", F.posexplode(F.split("text", "(?i)(?=File Name:)")).alias("seq", "block"))
    rows = blocks.select(
        "subject_id", "seq", pick(r"File Name:\s*(\S+\.edf)").alias("recording_id"), pick(rf"Number of {event}s in File:\s*(\d+)").cast("int").alias("declared"),
        times("Start").alias("onsets"), times("End").alias("offsets"), pick(r"File Start Time:\s*([\d:]+)").alias("start_clock"), pick(r"File End Time:\s*([\d:]+)").alias("end_clock"),
    )
    return rows.where("recording_id is not null")


def agrees() -> Column:
    """Whether a block has as many onsets and offsets as it declares."""
    return F.coalesce((F.size("onsets") == F.col("declared")) & (F.size("offsets") == F.col("declared")), F.lit(False))


def annotated_events(blocks: DataFrame) -> DataFrame:
    """(subject_id, recording_id, event_idx from 1, onset, offset) of the blocks whose counts agree; of a file named twice the last."""
    last = blocks.where(agrees() & (F.col("declared") > 0)).groupBy("subject_id", "recording_id").agg(F.max_by(F.arrays_zip("onsets", "offsets"), "seq").alias("e"))
    return last.select("subject_id", "recording_id", F.posexplode("e").alias("k", "e")).select("subject_id", "recording_id", (F.col("k") + 1).alias("event_idx"), F.col("e.onsets").alias("onset"), F.col("e.offsets").alias("offset"))


def disagreeing(blocks: DataFrame) -> DataFrame:
    """(subject_id, recording_id, declared, found_onsets, found_offsets) of the blocks that annotated_events() drops for their counts."""
    wrong = blocks.where((F.col("declared") > 0) & ~agrees())
    return wrong.select("subject_id", "recording_id", "declared", F.size("onsets").alias("found_onsets"), F.size("offsets").alias("found_offsets"))


def subject_counts(texts: DataFrame, excluded: tuple[str, ...] = (), event: str = "Seizure") -> DataFrame:
    """(subject_id, n_files, n_events) of all subjects with a text but the excluded ones; 0 for those without events."""
    texts = texts.where(~F.col("subject_id").isin(*excluded)) if excluded else texts
    events = annotated_events(annotation_blocks(texts, event))
    per = events.groupBy("subject_id").agg(F.countDistinct("recording_id").alias("n_files"), F.count(F.lit(1)).alias("n_events"))
    zero = F.lit(0).cast("long")
    return texts.select("subject_id").distinct().join(per, "subject_id", "left").select("subject_id", F.coalesce("n_files", zero).alias("n_files"), F.coalesce("n_events", zero).alias("n_events"))


def timeline(blocks: DataFrame) -> DataFrame:
    """(subject_id, seq, recording_id, abs_start, abs_end, has_event) of the files with both clock texts, in the order of their text."""
    t = rebuild_clock(blocks.where("start_clock is not null and end_clock is not null"), ["subject_id"])
    return t.select("subject_id", "seq", "recording_id", "abs_start", "abs_end", (agrees() & (F.col("declared") > 0)).alias("has_event"))
