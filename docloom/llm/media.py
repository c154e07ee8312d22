"""Media columns: progressive JPEG bytes in a binary column, and the RGB tensors in them."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table

#: Payload bytes come in whole groups of three blocks of 64.
GROUP = 192
#: Luma has twice the resolution of chroma in both directions: six blocks make an MCU.
FACTORS = ((2, 2), (1, 1), (1, 1))
PER_MCU = 6


def shape_of(payload_bytes: int) -> tuple:
    """The image that holds a payload: up to 64 MCUs across, more only for very long ones."""
    mcus = -(-payload_bytes // (64 * PER_MCU))
    across = max(min(mcus, 64), int(np.ceil(np.sqrt(mcus / 15.0))) if mcus > 200_000 else 1)
    down = -(-mcus // across)
    across = -(-mcus // down)
    return down * 16, across * 16, FACTORS


def pad(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text and their number; filled up with spaces to a positive multiple of GROUP."""
    body = (text or "").encode("utf-8", "surrogatepass")
    return len(body), body + b" " * (-len(body) % GROUP if body else GROUP)


def store_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a progressive JPEG whose coefficients are its bytes minus 128, in MCU order."""
    from docloom.llm.progressive_jpeg import Layout, encode

    shapes = [shape_of(len(p)) for p in payloads]
    layout = Layout(shapes)
    coefficients = np.zeros((layout.blocks, 64), np.int16)
    rows = np.concatenate([layout.order(i, (0, 1, 2))[0][: len(p) // 64] for i, p in enumerate(payloads)])
    coefficients[rows] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64).astype(np.int16) - 128
    return encode(shapes, coefficients)


def read_media(images: list[bytes], sizes: list[int] | None = None) -> list[dict]:
    """The tensor of each image, and the first `size` bytes of its payload if sizes are given."""
    from docloom.llm.progressive_jpeg import read_coefficients, rgb_tensors

    layout, coefficients, parsed = read_coefficients(images)
    tensors = rgb_tensors(layout, coefficients, parsed)
    out = [{"rgb": t} for t in tensors]
    for i, size in enumerate(sizes or []):
        order, _ = layout.order(i, (0, 1, 2))
        out[i]["payload"] = (coefficients[order[: size // 64]] + 128).astype(np.uint8).tobytes()
    return out


def in_portions(sizes: list[int], most: int):
    """Ranges of rows of about `most` bytes together; a longer one goes alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def decode_images(df: DataFrame, column: str, portion_bytes: int = 2_000_000) -> DataFrame:
    """df with height, width, rgb (uint8 rows of pixels) and media_error of a binary column of progressive JPEGs.

    Null bytes give nulls without an error; what is no progressive JPEG gives nulls and the reason.
    height, width, rgb and media_error of the input are replaced.
    """
    df = df.drop("height", "width", "rgb", "media_error")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            data = batch.column(column).to_pylist()
            found: list[tuple] = [(None, None, None, None)] * len(data)
            whole = [i for i, x in enumerate(data) if x is not None]
            for a, b in in_portions([len(data[i]) for i in whole], portion_bytes):
                rows = whole[a:b]
                try:
                    got = [(*x["rgb"].shape[:2], x["rgb"].tobytes(), None) for x in read_media([data[i] for i in rows])]
                except Exception:  # one by one, so that a broken image spoils no other
                    got = []
                    for i in rows:
                        try:
                            t = read_media([data[i]])[0]["rgb"]
                            got.append((*t.shape[:2], t.tobytes(), None))
                        except Exception as e:
                            got.append((None, None, None, f"{type(e).__name__}: {e}"))
                for i, x in zip(rows, got):
                    found[i] = x
            h, w, rgb, error = zip(*found) if found else ((), (), (), ())
            more = [pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(rgb, pa.binary()), pa.array(error, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "height", "width", "rgb", "media_error"])

    return df.mapInArrow(decode, f"{kept}, height int, width int, rgb binary, media_error string")


def store_texts(docs: DataFrame, portion_bytes: int = 2_000_000) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and the media column of each text. Null counts as empty."""

    def store(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            bodies = [pad(t) for t in texts]
            del texts
            for a, b in in_portions([len(p) for _, p in bodies], portion_bytes):
                media = store_payloads([p for _, p in bodies[a:b]])
                columns = [ids.slice(a, b - a), pa.array([n for n, _ in bodies[a:b]], pa.int64()), pa.array([len(p) for _, p in bodies[a:b]], pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, payload_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest_media(stored: DataFrame, portion_bytes: int = 2_000_000) -> DataFrame:
    """Read the media column back: digests of payload and media, and a feature of the RGB tensor.

    feature: height, width, the sums of red, green and blue, and the crc32 of the tensor; all whole
    numbers, so equal media give equal features whatever batch they are in.
    """

    def digest(batches):
        import pyarrow as pa

        for batch in batches:
            data, sizes = batch.column("media").to_pylist(), batch.column("payload_bytes").to_pylist()
            out = []
            for a, b in in_portions([len(x) for x in data], portion_bytes):
                for x, found in zip(data[a:b], read_media(data[a:b], sizes[a:b])):
                    payload, rgb = found["payload"], found["rgb"]
                    sums = ":".join(map(str, rgb.reshape(-1, 3).sum(0, dtype=np.int64).tolist()))
                    feature = f"rgb {rgb.shape[0]}x{rgb.shape[1]} {sums} {zlib.crc32(rgb):08x}"
                    out.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(x), hashlib.sha256(x).hexdigest(), feature))
            sha, crc, n, media_sha, feature = zip(*out) if out else [()] * 5
            columns = [*(batch.column(c) for c in ("doc_id", "n_bytes", "payload_bytes")), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(media_sha, pa.string()), pa.array(feature, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGEST.split(", ")])

    return stored.mapInArrow(digest, DIGEST)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored in a progressive JPEG, read back and digested.

    Null and empty texts are 192 spaces; repeated rows give equal values; no documents give no rows.
    """
    return digest_media(store_texts(table(spark, sf_dir, "documents")))


QUERIES = {"op10_media": op10_media}
ORACLES: dict[str, str] = {}
