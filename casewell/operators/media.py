"""Evidence files: digests, image and container metadata, audio segments and coefficients.

Rows are those of the ``binaryFile`` source. Metadata is parsed with the standard library and
NumPy; what needs an image or video codec (error levels, frames, scene cuts) runs only where such a
library can be imported, and says so otherwise.
"""

from __future__ import annotations

import importlib.util
import io
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = ("jpg", "jpeg", "png", "webp", "tif", "tiff")
VIDEO = ("mp4", "mov", "avi", "mkv")
AUDIO = ("wav", "mp3", "flac", "m4a")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*IMAGE), "image").when(e.isin(*VIDEO), "video").when(e.isin(*AUDIO), "audio").otherwise("unsupported")


def stamped(files: DataFrame) -> DataFrame:
    """``path, kind, length, sha256, analyzed_at`` in UTC."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return files.select("path", kind(F.col("path")).alias("kind"), "length", F.sha2("content", 256).alias("sha256"), now.alias("analyzed_at"))


# --- image metadata ------------------------------------------------------------------------------

#: Tags of image metadata that are read.
TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "modified", 0x9003: "taken", 0x8769: "exif", 0x8825: "gps"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _directory(data: bytes, at: int, order: str, names: dict[int, str]) -> dict:
    out: dict = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for i in range(n):
        tag, form, count, value = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i)
        if tag not in names or form not in SIZES:
            continue
        size = SIZES[form] * count
        raw = value[:size] if size <= 4 else data[(p := struct.unpack(order + "I", value)[0]) : p + size]
        if form == 2:
            out[names[tag]] = raw.split(b"\0")[0].decode("latin-1").strip()
        elif form in (5, 10):
            pairs = struct.unpack(order + ("II" if form == 5 else "ii") * count, raw)
            out[names[tag]] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        elif form in (3, 4):
            out[names[tag]] = struct.unpack(order + ("H" if form == 3 else "I") * count, raw)[0]
    return out


def exif(data: bytes) -> dict:
    """Make, model, software, times and coordinates of a JPEG or TIFF; empty if it has none."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                data = data[at + 10 : at + 2 + size]
                break
            if mark == 0xDA:
                return {}
            at += 2 + size
        else:
            return {}
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        return {}
    try:
        (first,) = struct.unpack_from(order + "I", data, 4)
        out = _directory(data, first, order, TAGS)
        if isinstance(out.get("exif"), int):
            out |= _directory(data, out["exif"], order, TAGS)
        if isinstance(out.get("gps"), int):
            out |= _directory(data, out["gps"], order, GPS_TAGS)
    except struct.error:
        return {}
    for axis, negative in (("lat", "S"), ("lon", "W")):
        v = out.get(axis)
        if isinstance(v, list) and len(v) == 3:
            out[axis] = (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if out.get(f"{axis}_ref") == negative else 1)
        else:
            out.pop(axis, None)
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType() if c in ("lat", "lon") else T.StringType()) for c in ("make", "model", "software", "taken", "lat", "lon")]))
def image_metadata(content: pd.Series) -> pd.DataFrame:
    rows = [exif(bytes(c)) for c in content]
    pick = lambda k, kind: pd.Series([r.get(k) for r in rows], dtype=kind)
    taken = pd.Series([r.get("taken") or r.get("modified") for r in rows], dtype="object")
    return pd.DataFrame({"make": pick("make", "object"), "model": pick("model", "object"), "software": pick("software", "object"), "taken": taken, "lat": pick("lat", "float64"), "lon": pick("lon", "float64")})


def error_level(content: bytes, quality: int = 95, scale: int = 10):
    """Difference of a JPEG to its recompression; needs an image codec."""
    if importlib.util.find_spec("PIL") is None:
        raise NotImplementedError("error level analysis needs an image codec, which is not installed")
    from PIL import Image, ImageChops

    original = Image.open(io.BytesIO(content)).convert("RGB")
    again = io.BytesIO()
    original.save(again, "JPEG", quality=quality)
    return ImageChops.difference(original, Image.open(again)).point(lambda v: min(255, v * scale))


# --- containers ----------------------------------------------------------------------------------


def movie(data: bytes) -> dict:
    """Duration in seconds, width and height of an MP4 or MOV, from its header boxes."""
    out: dict = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            head = 8
            if size == 1:
                size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
            size = end - at if size == 0 else size
            if size < head:
                return
            body = at + head
            if name in (b"moov", b"trak"):
                walk(body, min(at + size, end))
            elif name == b"mvhd":
                wide = data[body] == 1
                unit, length = struct.unpack_from(">IQ" if wide else ">II", data, body + (20 if wide else 12))
                out["duration"] = round(length / unit, 3) if unit else None
            elif name == b"tkhd":
                w, h = struct.unpack_from(">II", data, body + (88 if data[body] == 1 else 76))
                if w and h:
                    out["width"], out["height"] = w >> 16, h >> 16
            at += size

    try:
        walk(0, len(data))
    except (struct.error, IndexError):
        pass
    return out


@F.pandas_udf(T.StructType([T.StructField("duration", T.DoubleType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def movie_metadata(content: pd.Series) -> pd.DataFrame:
    rows = [movie(bytes(c)) for c in content]
    return pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=t) for k, t in (("duration", "float64"), ("width", "Int32"), ("height", "Int32"))})


def time_entities(seconds: Column) -> Column:
    """Seconds into a recording as ``PT{n}S``."""
    return F.transform(seconds, lambda s: F.concat(F.lit("PT"), s.cast("long").cast("string"), F.lit("S")))


def sample_seconds(duration: Column, most: int = 600) -> Column:
    """One second each, ``most`` at most, over the whole length."""
    step = F.greatest(F.lit(1), F.ceil(duration / most)).cast("int")
    return F.when(duration > 0, F.sequence(F.lit(0), F.greatest(F.ceil(duration).cast("int") - 1, F.lit(0)), step))


# --- audio ---------------------------------------------------------------------------------------


def samples(data: bytes) -> tuple[np.ndarray, int, int]:
    """Mono samples in -1..1, rate and channels of a PCM WAV."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
        x = x - 128 if width == 1 else x
    x = x.astype(np.float64).reshape(-1, channels).mean(1) / float(1 << (8 * width - 1))
    return x, rate, channels


def sounding(x: np.ndarray, rate: int, below: float = 40.0, frame: int = 2048, hop: int = 512) -> list[tuple[float, float]]:
    """Segments in seconds whose frames are at most ``below`` decibels under the loudest frame."""
    if not len(x):
        return []
    padded = np.pad(x, frame // 2, mode="constant")
    n = 1 + (len(padded) - frame) // hop
    power = np.concatenate([[0.0], np.cumsum(padded * padded)])
    starts = np.arange(n) * hop
    rms = np.sqrt((power[starts + frame] - power[starts]).clip(0) / frame)
    top = rms.max()
    if top <= 0:
        return []
    loud = np.concatenate([[False], 20 * np.log10(np.maximum(rms, 1e-10) / top) > -below, [False]])
    edges = np.flatnonzero(loud[1:] != loud[:-1])
    return [(round(float(a * hop / rate), 3), round(float(min(b * hop, len(x)) / rate), 3)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def mel_coefficients(x: np.ndarray, rate: int, n: int = 13, bands: int = 40, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """``n`` cepstral coefficients per frame: log energies of mel bands, cosine transformed."""
    x = np.pad(x, (0, max(0, frame - len(x))))
    windows = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop] * np.hanning(frame)
    spectrum = np.abs(np.fft.rfft(windows, axis=1)) ** 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)
    rise, fall = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    energy = np.log10(np.maximum(spectrum @ np.clip(np.minimum(rise, fall), 0, None).T, 1e-10)) * 10
    k = np.arange(n)[:, None] * (np.arange(bands) + 0.5)[None] * np.pi / bands
    basis = np.cos(k) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return energy @ basis.T


_SEGMENT = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
AUDIO_SCHEMA = T.StructType(
    [T.StructField("duration", T.DoubleType()), T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType())]
    + [T.StructField("segments", T.ArrayType(_SEGMENT)), T.StructField("mfcc_mean", T.ArrayType(T.DoubleType()))]
    + [T.StructField("mfcc_variance", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())]
)


@F.pandas_udf(AUDIO_SCHEMA)
def audio_analysis(content: pd.Series) -> pd.DataFrame:
    """Metadata, sounding segments, mean and variance of coefficients; an error instead of a failure."""
    out = []
    for c in content:
        try:
            x, rate, channels = samples(bytes(c))
            m = mel_coefficients(x, rate)
            parts = [{"start": a, "end": b} for a, b in sounding(x, rate)]
            out.append((len(x) / rate, rate, channels, parts, m.mean(0).tolist(), m.var(0).tolist(), None))
        except (wave.Error, EOFError, ValueError, KeyError) as e:
            out.append((None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
    names = ["duration", "rate", "channels", "segments", "mfcc_mean", "mfcc_variance", "error"]
    return pd.DataFrame(out, columns=names).astype({"rate": "Int32", "channels": "Int32", "duration": "float64"})


def analyze(files: DataFrame, module: str, analyzer, case_id: str) -> DataFrame:
    """The result rows of one analyzer: what the file is, its digest, and the analyzer's struct."""
    rows = files.filter(kind(F.col("path")) == module) if module in ("image", "video", "audio") else files
    result = rows.select("path", "length", F.sha2("content", 256).alias("sha256"), analyzer(F.col("content")).alias("result"))
    return result.select(F.lit(case_id).alias("case_id"), F.lit(module).alias("module"), "path", "length", "sha256", "result")


def tone_fixture(parts: list[tuple[float, float]], rate: int = 16_000, amplitude: float = 0.3) -> bytes:
    """A mono 16-bit WAV of ``(seconds, frequency)`` parts; frequency zero is silence."""
    x = np.concatenate([amplitude * np.sin(2 * np.pi * f * np.arange(int(s * rate)) / rate) for s, f in parts])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return out.getvalue()
