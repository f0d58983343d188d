"""Run-time observations from outside: framed logs amid console noise, and import traces."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbuild.functions.features import FNV_PRIME, FNV_START, WORD
from twinbuild.plans.store import stored

# Limits of one log.
MAX_LOG_BYTES, MAX_LINES, MAX_LINE_BYTES = 1 << 20, 20_000, 16 * 1024
MAX_DECODED_BYTES, MAX_RECORDS, MAX_NAME_BYTES = 256 * 1024, 4_096, 512
FRAME = "TRACE-V1"
AT_ONCE = 64  # logs that a task reads together
_blank = b" \t\r"


class Rejected(Exception):
    """Why a log is refused."""


def checksum(data: bytes, h: int = FNV_START) -> int:
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & WORD
    return h


def checksums(values: list[bytes], few: int = 40) -> list[int]:
    """The checksum of each value, one byte of all of them at a time; the longest ones, when only `few` are left, each alone."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-sizes, kind="stable")
    starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(values), np.uint8)
    starts, state = starts[order], np.full(len(values), FNV_START, np.uint64)
    alive = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # values longer than k
    common = int((alive > few).sum())
    for k in range(common):
        state[: alive[k]] = (state[: alive[k]] ^ data[starts[: alive[k]] + k]) * np.uint64(FNV_PRIME)
    out = [0] * len(values)
    for h, at in zip(state.tolist(), order.tolist(), strict=True):
        out[at] = checksum(values[at][common:], h)
    return out


def _need(ok: bool, reason: str) -> None:
    if not ok:
        raise Rejected(reason)


def _body(log: bytes, frame: str) -> tuple[bytes, bytes]:
    """The encoded text between the first begin line and the next end line, and that end line."""
    _need(len(log) <= MAX_LOG_BYTES, "too_large")
    lines = log.split(b"\n")
    early = next((k for k, x in enumerate(lines[:MAX_LINES]) if len(x) > MAX_LINE_BYTES), None)
    _need(early is None, "line_too_long")
    _need(len(lines) <= MAX_LINES, "too_many_lines")
    lines = [x.strip(_blank) for x in lines]
    begin, end = f"{frame} BEGIN".encode(), f"{frame} END".encode()
    _need(begin in lines, "no_frame")
    start = lines.index(begin) + 1
    stop = next((k for k in range(start, len(lines)) if lines[k].startswith(end)), None)
    _need(stop is not None, "no_frame")
    body = b"".join(lines[start:stop])
    _need(len(body) <= MAX_DECODED_BYTES // 3 * 4 + 8, "decoded_too_large")
    return body, lines[stop]


def decode_log(log: bytes, frame: str = FRAME) -> tuple[bytes, int]:
    """What the frame of a log holds, of the declared length, and its declared checksum; Rejected if there is no such thing."""
    body, last = _body(log, frame)
    declared = {k: v for k, _, v in (t.partition("=") for t in last.decode("utf-8", "replace").split())}
    size, mark = declared.get("len", ""), declared.get("fnv", "")
    _need(re.fullmatch(r"\+?[0-9]+", size) is not None and re.fullmatch(r"\+?0*[0-9a-fA-F]{1,16}", mark) is not None, "no_frame")
    try:
        data = base64.b64decode(body, validate=True)
    except binascii.Error:
        raise Rejected("bad_base64") from None
    _need(len(data) <= MAX_DECODED_BYTES, "decoded_too_large")
    _need(len(data) == int(size), "len_mismatch")
    return data, int(mark, 16)


def edges_of_log(data: bytes) -> list[tuple[str, str, int]]:
    """(from, to, confidence) of the JSON that a frame holds; Rejected if anything at all is wrong with it."""
    try:
        trace = json.loads(data)
    except (ValueError, RecursionError):
        raise Rejected("bad_json") from None
    edges = trace.get("edges") if isinstance(trace, dict) else None
    _need(isinstance(edges, list), "not_an_array")
    _need(len(edges) <= MAX_RECORDS, "too_many_records")
    out = []
    for e in edges:
        e = e if isinstance(e, dict) else {}
        names, sure = [e.get("from"), e.get("to")], e.get("confidence")
        _need(all(isinstance(x, str) for x in names) and type(sure) is int and sure >= 0, "bad_field")
        _need(all(0 < len(x.encode("utf-8", "surrogatepass")) <= MAX_NAME_BYTES for x in names) and sure <= 100, "bad_field")
        out.append((*names, sure))
    return out


def parse_logs(logs: list[bytes], frame: str = FRAME) -> list[list[tuple[str, str, int]] | Rejected]:
    """For each log its edges, or why it is refused. Checksums are made for all logs together."""
    out: list = []
    for log in logs:
        try:
            out.append(decode_log(log, frame))
        except Rejected as e:
            out.append(e)
    framed = [k for k, x in enumerate(out) if not isinstance(x, Rejected)]
    for k, mark in zip(framed, checksums([out[k][0] for k in framed]), strict=True):
        data, declared = out[k]
        try:
            _need(mark == declared, "checksum_mismatch")
            out[k] = edges_of_log(data)
        except Rejected as e:
            out[k] = e
    return out


def parse_log(log: bytes, frame: str = FRAME) -> list[tuple[str, str, int]]:
    """(from, to, confidence) of one log; Rejected if anything at all is wrong with it."""
    found = parse_logs([log], frame)[0]
    if isinstance(found, Rejected):
        raise found
    return found


def read_observation_logs(logs: DataFrame, frame: str = FRAME) -> tuple[DataFrame, DataFrame]:
    """logs (program_id, run_id, log binary) to (edges, rejected): a log counts whole or not at all."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch, rows = whole.slice(at, AT_ONCE), []
                read = parse_logs([log or b"" for log in batch.column("log").to_pylist()], frame)
                for program, run, large, found in zip(*(batch.column(c).to_pylist() for c in ("program_id", "run_id", "large")), read, strict=True):
                    if large or isinstance(found, Rejected):
                        rows.append((program, run, None, None, None, "too_large" if large else str(found)))
                    else:
                        rows += [(program, run, a, b, n, None) for a, b, n in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    names, types = ("program_id", "run_id", "from_name", "to_name", "confidence", "reason"), [pa.string()] * 4 + [pa.int32(), pa.string()]
    # a log that is too large is not sent to Python at all; what was read is stored, not the logs, of which a batch of Parquet would hold thousands
    large = F.coalesce(F.octet_length("log") > MAX_LOG_BYTES, F.lit(False))
    sent = logs.select("program_id", "run_id", large.alias("large"), F.when(~large, F.col("log")).alias("log"))
    both = stored(sent.mapInArrow(parsed, "program_id string, run_id string, from_name string, to_name string, confidence int, reason string"), "read-logs")
    return both.where("reason is null").drop("reason"), both.where("reason is not null").select("program_id", "run_id", "reason")


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """Log files as (program_id, run_id, log): the folder is the program, the file the run. Longer files are cut just above the limit, which refuses them."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("program_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("run_id"), F.substring("content", 1, MAX_LOG_BYTES + 1).alias("log"))


TRACES = "resolved_imports array<struct<function:string,import:string>>"


def _trace_rows(raw: DataFrame) -> DataFrame:
    rows = raw.select("program_id", F.explode("resolved_imports").alias("r"))
    return rows.select("program_id", "r.function", "r.import").where("`function` is not null and `import` is not null")


def parse_import_traces(texts: DataFrame) -> DataFrame:
    """(program_id, function, import) from rows (program_id, text) of JSON {resolved_imports: [{function, import}]}; other text gives none."""
    return _trace_rows(texts.select("program_id", F.from_json("text", TRACES).alias("t")).select("program_id", "t.resolved_imports"))


def read_import_traces(spark: SparkSession, path: str) -> DataFrame:
    """The same from files; the file is the program."""
    raw = spark.read.schema(TRACES).option("multiLine", True).json(path)
    return _trace_rows(raw.withColumn("program_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1)))
