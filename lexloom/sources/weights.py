"""Weights of the sequence model as a source: half floats with a directory, checked against the model size they are for."""

from __future__ import annotations

import functools
import gzip
import hashlib
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexloom.functions import vocabulary as V

CATEGORICAL = 22
#: Bytes that a file of weights may have; the largest model's are under a megabyte.
MOST_BYTES = 64 << 20


def shapes(size: str) -> dict[str, tuple[int, ...]]:
    """Weights by name, of a model size."""
    if size not in V.MODEL_SIZES:
        raise ValueError(f"unknown model size: {size}")
    cb, cd, bb, bd, h = V.MODEL_SIZES[size]
    out: dict[str, tuple[int, ...]] = {"codepoint": (cb, cd), "bigram": (bb, bd), "project.w": (cd + bd + CATEGORICAL, h), "project.b": (h,)}
    for k in range(len(V.DILATIONS)):
        out |= {f"conv{k}.depth": (3, h), f"conv{k}.depth_b": (h,), f"conv{k}.w": (h, h), f"conv{k}.b": (h,), f"conv{k}.scale": (h,), f"conv{k}.shift": (h,)}
    for way in ("forward", "backward"):
        out |= {f"{way}.w": (h, h), f"{way}.b": (h,), f"{way}.decay": (h,)}
    for head, n in V.HEADS.items():
        out |= {f"{head}.w": (h, n), f"{head}.b": (n,)}
    return out


def pack_fp16(weights: dict[str, np.ndarray]) -> tuple[bytes, dict]:
    """Weights as half floats, two in a 32-bit word, low half first, an odd count padded; and their directory."""
    out, directory, at = [], {}, 0
    for name, w in weights.items():
        flat = np.ascontiguousarray(w, np.float16).ravel().view(np.uint16)
        flat = np.append(flat, np.uint16(0)) if len(flat) % 2 else flat
        directory[name] = {"offset": at, "shape": list(w.shape)}
        out.append(flat.astype("<u2").tobytes())
        at += len(flat) // 2
    return b"".join(out), directory


def unpack_fp16(data: bytes, directory: dict) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(data, "<f2", int(np.prod(v["shape"])), 4 * v["offset"]).astype(np.float32).reshape(v["shape"]) for k, v in directory.items()}


def check(size: str, found: dict[str, tuple[int, ...]]) -> None:
    """An error unless these are the names and shapes of the model size."""
    want = shapes(size)
    wrong = [f"{k}: {found.get(k)} for {want.get(k)}" for k in sorted({*want, *found}) if found.get(k) != want.get(k)]
    if wrong:
        raise ValueError(f"weights do not fit model size {size}: " + "; ".join(wrong[:5]))


@dataclass(frozen=True)
class Weights:
    """Packed weights of one model size; what is sent to workers."""

    size: str
    data: bytes
    directory: str
    checksum: str

    @classmethod
    def of(cls, size: str, weights: dict[str, np.ndarray]) -> Weights:
        check(size, {k: tuple(w.shape) for k, w in weights.items()})
        data, directory = pack_fp16(weights)
        return cls(size, data, json.dumps(directory), hashlib.sha256(data).hexdigest())

    def unpacked(self) -> dict[str, np.ndarray]:
        """The weights as floats, unpacked once a process."""
        return _unpacked(self.checksum, self)

    def file(self) -> tuple[bytes, str]:
        """The contents of the file of weights (gzipped, the same bytes each time) and of its description."""
        return gzip.compress(self.data, 9, mtime=0), json.dumps({"size": self.size, "sha256": self.checksum, "weights": json.loads(self.directory)}, indent=2)


def write_weights(spark: SparkSession, weights: Weights, data: str, description: str) -> None:
    """Writes the weights (gzipped) and their description to two paths of any store that Spark reaches."""
    packed, about = weights.file()
    for path, content in ((data, packed), (description, about.encode())):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()


@functools.lru_cache(4)
def _unpacked(checksum: str, packed: Weights) -> dict[str, np.ndarray]:
    return unpack_fp16(packed.data, json.loads(packed.directory))


def _bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path)
    size = rows.agg(F.count("*"), F.sum("length")).head()
    if size[0] != 1 or size[1] > MOST_BYTES:
        raise ValueError(f"{path}: one file of at most {MOST_BYTES} bytes is expected, found {size[0]} of {size[1]}")
    return bytes(rows.select("content").head()[0])


def read_weights(spark: SparkSession, data: str, description: str, size: str) -> Weights:
    """The weights in the files at two paths that Spark reads: half floats, gzipped or raw, and their description.

    Refused with an error: another model size, names or shapes that are not those of the size, ranges outside the data or
    that overlap, another checksum.
    """
    about = json.loads(_bytes(spark, description))
    if about["size"] != size:
        raise ValueError(f"weights are of model size {about['size']}, not {size}")
    check(size, {k: tuple(v["shape"]) for k, v in about["weights"].items()})
    raw = _bytes(spark, data)
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    if hashlib.sha256(raw).hexdigest() != about["sha256"]:
        raise ValueError("the checksum of the weights is not that of their description")
    at = 0
    for v in sorted(about["weights"].values(), key=lambda v: v["offset"]):
        if v["offset"] < at:
            raise ValueError("weights overlap")
        at = v["offset"] + -(-int(np.prod(v["shape"])) // 2)
    if 4 * at > len(raw):
        raise ValueError("weights lie outside the data")
    return Weights(size, raw, json.dumps(about["weights"]), about["sha256"])
