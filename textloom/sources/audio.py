"""Audio files as tables, read in tasks: WAV frames, MP3 frame counts; and JSON values that follow each other in one text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the MPEG Layer III header: kbit/s by index (0 and 15 are not used) and Hz by index.
MPEG1_KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MPEG2_KBITS = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
MPEG1_HZ = (44100, 48000, 32000)
#: Version bits of the header: how far the sampling rate is halved.
HALVED = {3: 1, 2: 2, 0: 4}


def audio_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of the files of a folder and those below it; Spark leaves empty files out."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def wav_parts(content: bytes) -> tuple[dict, bytes]:
    """Format and samples of a RIFF file; ValueError says what is wrong."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    chunks, at = {}, 12
    while at + 8 <= len(content):
        size = int.from_bytes(content[at + 4 : at + 8], "little")
        if at + 8 + size > len(content):
            raise ValueError("chunk beyond the end")
        chunks[content[at : at + 4]] = content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if len(chunks.get(b"fmt ", b"")) < 16 or not chunks.get(b"data"):
        raise ValueError("no format or no samples")
    codec, channels = np.frombuffer(chunks[b"fmt "], "<u2", 2).tolist()
    rate, bits = int.from_bytes(chunks[b"fmt "][4:8], "little"), int.from_bytes(chunks[b"fmt "][14:16], "little")
    if (codec, channels, bits) != (1, 1, 16) or len(chunks[b"data"]) % 2:
        raise ValueError("not 16-bit mono PCM")
    return {"rate": rate}, chunks[b"data"]


def wav_frames(files: DataFrame, millis: int = 10) -> DataFrame:
    """(path, rate, frame_no, n, sum_sq, peak, problem): frames of so many milliseconds; samples count from -1 to 1.

    A file that cannot be read gives one row with its problem. Frames leave a file in slices, so a task holds one file.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path, content in ((p, c) for b in batches for p, c in zip(b["path"], b["content"])):
            try:
                form, data = wav_parts(content or b"")
            except ValueError as e:
                yield pd.DataFrame({"path": [path], "rate": [None], "frame_no": [None], "n": [None], "sum_sq": [None], "peak": [None], "problem": [str(e)]})
                continue
            size = max(form["rate"] * millis // 1000, 1)
            for start in range(0, len(data) // 2, size * 10_000):
                x = np.frombuffer(data, "<i2")[start : start + size * 10_000] / 32768.0
                edges = np.arange(0, len(x), size)
                yield pd.DataFrame({
                    "path": path, "rate": form["rate"], "frame_no": start // size + np.arange(len(edges)), "n": np.diff(np.append(edges, len(x))),
                    "sum_sq": np.add.reduceat(x * x, edges), "peak": np.maximum.reduceat(np.abs(x), edges), "problem": None,
                })

    return files.select("path", "content").mapInPandas(cut, "path string, rate int, frame_no long, n int, sum_sq double, peak double, problem string")


def mp3_header(head: int) -> tuple[int, int, int, int, int] | None:
    """(bytes, samples, Hz, kbit/s, channels) of a Layer III frame from its first 32 bits; None if it is no such frame."""
    version, layer, kbit, hz = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
    if head >> 21 != 0x7FF or version not in HALVED or layer != 1 or kbit in (0, 15) or hz == 3:
        return None
    kbits, samples = (MPEG1_KBITS, 1152) if version == 3 else (MPEG2_KBITS, 576)
    rate = MPEG1_HZ[hz] // HALVED[version]
    return samples * 125 * kbits[kbit] // rate + (head >> 9 & 1), samples, rate, kbits[kbit], 1 if head >> 6 & 3 == 3 else 2


def mp3_info(content: bytes) -> dict:
    """What a file of whole Layer III frames holds, or the problem; tags before and after the frames are stepped over."""
    at, end, seen, samples, frames = 0, len(content), None, 0, 0
    if content[:3] == b"ID3":
        if end < 10 or max(content[6:10]) > 127:
            return {"problem": "bad tag"}
        at = 10 + sum(b << 7 * (3 - i) for i, b in enumerate(content[6:10]))
    if end - at >= 128 and content[-128:-125] == b"TAG":
        end -= 128
    while at < end:
        frame = mp3_header(int.from_bytes(content[at : at + 4], "big")) if at + 4 <= end else None
        if frame is None or at + frame[0] > end:
            return {"problem": f"no whole frame at byte {at}"}
        if seen and (frame[2], frame[4]) != (seen[2], seen[4]):
            return {"problem": f"rate or channels change at byte {at}"}
        seen, samples, frames, at = seen or frame, samples + frame[1], frames + 1, at + frame[0]
    if not seen or at != end:
        return {"problem": "no whole frame"}
    return {"bytes": len(content), "frames": frames, "seconds": round(samples / seen[2], 3), "rate": seen[2], "kbits": seen[3], "channels": seen[4]}


def mp3_table(files: DataFrame) -> DataFrame:
    """(path, bytes, frames, seconds, rate, kbits, channels, problem) of MP3 files; null content is a problem too."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "bytes", "frames", "seconds", "rate", "kbits", "channels", "problem"]
        for b in batches:
            found = [{"path": p} | mp3_info(c or b"") for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame([[f.get(n) for n in names] for f in found], columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(read, "path string, bytes long, frames long, seconds double, rate int, kbits int, channels int, problem string")


def json_values_of(text: str) -> tuple[list[str], str]:
    """The whole objects and arrays at the front of a text, and the rest; ValueError if something else comes first."""
    found, at, decoder = [], 0, json.JSONDecoder()
    while True:
        at += len(text[at:]) - len(text[at:].lstrip())
        if at == len(text):
            return found, ""
        if text[at] not in "{[":
            raise ValueError(f"not a JSON object or array at {at}")
        try:
            _, end = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            return found, text[at:]
        found.append(text[at:end])
        at = end


def json_values(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, value, rest, problem): each text's JSON values in order; `rest` is what has no end yet, to be put
    before the next piece. A text without values gives one row with place null; null counts as empty."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                try:
                    values, rest, problem = *json_values_of(t or ""), None
                except ValueError as e:
                    values, rest, problem = [], t, str(e)
                out += [(k, i, v, rest, problem) for i, v in enumerate(values)] or [(k, None, None, rest, problem)]
            yield pd.DataFrame(out, columns=["k", "place", "value", "rest", "problem"], dtype=object)

    kind = rows.schema[key].dataType.simpleString()
    cutting = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(cut, f"k {kind}, place int, value string, rest string, problem string")
    return cutting.withColumnRenamed("k", key)
