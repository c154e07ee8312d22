import hashlib
import zlib

import numpy as np
from docloom.llm.media import decode_images, digest_media, op10_media, pad, read_media, store_payloads, store_texts
from docloom.llm.progressive_jpeg import Layout, encode, read_coefficients, rgb_tensors

SF = "/root/testdata/sf0.001"


def java_pixels(spark, data):
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    h, w = image.getHeight(), image.getWidth()
    flat = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), dtype=np.int64)
    return np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255], -1).reshape(h, w, 3)


def java_progressive(spark, rgb, quality):
    """A progressive JPEG from the JVM's own writer: other scans, runs over blocks, no restarts."""
    jvm = spark.sparkContext._jvm
    h, w, _ = rgb.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, rgb[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)  # MODE_DEFAULT
    param.setCompressionMode(2)  # MODE_EXPLICIT
    param.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.close()
    return bytes(out.toByteArray())


def test_payload_round_trip():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (1, 2, 3, 7, 131)]
    payloads += [rng.integers(126, 131, 192 * 5, dtype=np.uint8).tobytes(), bytes([128] * 192), bytes([127, 128, 129] * 64), bytes([0] * 192), bytes([255] * 384)]
    payloads += [pad(t)[1] for t in (None, "", "wörld " * 50, "こんにちは" * 40)]
    stored = store_payloads(payloads)
    assert [r["payload"] for r in read_media(stored, [len(p) for p in payloads])] == payloads
    assert [store_payloads([p])[0] for p in payloads] == stored


def test_other_decoder_agrees(spark):
    rng = np.random.default_rng(1)
    shapes = [(40, 33, ((1, 1), (1, 1), (1, 1)))]
    coefficients = np.zeros((Layout(shapes).blocks, 64), np.int16)
    coefficients[:, 0] = rng.integers(-300, 300, len(coefficients))
    coefficients[:, 1:20] = rng.integers(-12, 13, (len(coefficients), 19))
    data = encode(shapes, coefficients)[0]
    layout, got, parsed = read_coefficients([data])
    assert (got == coefficients).all()
    off = np.abs(rgb_tensors(layout, got, parsed)[0].astype(int) - java_pixels(spark, data))
    # a sample may round the other way in each plane: 1 of luma and 1.772 of chroma
    assert off.max() <= 3 and off.mean() < 0.5


def test_reads_other_encoder(spark):
    y, x = np.mgrid[:37, :50]
    smooth = np.stack([128 + 90 * np.sin(x / 9.0), 128 + 90 * np.cos(y / 7.0), (x + y) * 2.0], -1).astype(np.uint8)
    flat = np.full((20, 70, 3), 77, np.uint8)
    for rgb, quality in ((smooth, 0.95), (smooth, 0.4), (flat, 0.9)):
        data = java_progressive(spark, rgb, quality)
        layout, got, parsed = read_coefficients([data])
        mine = rgb_tensors(layout, got, parsed)[0]
        assert mine.shape == rgb.shape
        # chroma is repeated here and interpolated there
        assert np.abs(mine.astype(int) - java_pixels(spark, data)).mean() < 4


def test_decode_column(spark):
    good = store_payloads([pad("abc")[1], pad("x" * 3000)[1]])
    rows = [(1, good[0], "a"), (2, None, "b"), (3, b"", "c"), (4, b"\xff\xd8junk", "d"), (5, good[1], "e"), (6, good[1][:150], "f")]
    df = spark.createDataFrame(rows, "id long, data binary, rgb string")
    got = {r.id: r for r in decode_images(df, "data").collect()}
    assert got[1].height * got[1].width * 3 == len(got[1].rgb) and got[1].media_error is None
    assert got[2].rgb is None and got[2].media_error is None
    assert got[3].media_error and got[4].media_error and got[4].rgb is None
    assert decode_images(df.where("false"), "data").count() == 0


def expected(text):
    n, payload = pad(text)
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_edges(spark):
    texts = [None, "", " ", "a" * 192, "a" * 193, "ü" * 5000, "dup", "dup"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in digest_media(store_texts(df)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(t)
    assert got[6][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    assert digest_media(store_texts(df.where("false"))).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in op10_media(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(d.text)
