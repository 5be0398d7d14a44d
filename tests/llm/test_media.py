import hashlib
import zlib

import numpy as np
import pytest

from ledgerloom.llm import media
from ledgerloom.llm.queries import op4_media_columns


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000])
def test_round_trip(n):
    text = ("wörd " * n)[:n]
    payload, size = media.payload_of(text)
    assert size == len(text.encode()) and len(payload) % 192 == 0 and payload.rstrip(b" ") == text.encode().rstrip(b" ")
    png = media.encode_png(payload)
    assert media.decode_png(png).tobytes() == payload
    damaged = bytearray(png)
    damaged[len(png) // 2] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(damaged))
    with pytest.raises(ValueError):
        media.decode_png(png[:-3])


def test_all_row_filters():
    rng = np.random.default_rng(3)
    rows, step = rng.integers(0, 256, (10, 30), dtype="u1"), 3
    filtered = np.zeros((10, 31), "u1")
    for i in range(10):
        kind = i % 5
        up = rows[i - 1].astype(int) if i else np.zeros(30, int)
        for x in range(30):
            a = int(rows[i, x - step]) if x >= step else 0
            c = int(up[x - step]) if x >= step else 0
            predicted = (0, a, up[x], (a + up[x]) // 2, media._paeth(a, int(up[x]), c))[kind]
            filtered[i, x + 1] = (int(rows[i, x]) - predicted) & 255
        filtered[i, 0] = kind
    assert (media.unfilter(filtered, step) == rows).all()


def test_hash_sees_low_frequencies():
    coarse = np.random.default_rng(2).integers(0, 256, (6, 6))
    picture = np.repeat(np.kron(coarse, np.ones((11, 11)))[:64, :64, None], 3, axis=2).astype("u1")
    noisy = np.clip(picture.astype(int) + np.random.default_rng(0).integers(-2, 3, picture.shape), 0, 255).astype("u1")
    other = np.random.default_rng(1).integers(0, 256, picture.shape, dtype="u1")
    bits = lambda x: int.from_bytes(media.cosine_hash(x), "big")
    assert (bits(picture) ^ bits(other)).bit_count() > 12
    assert media.cosine_hash(picture) == media.cosine_hash(picture.copy()) and (bits(noisy) ^ bits(picture)).bit_count() < (bits(noisy) ^ bits(other)).bit_count()


def brute(text):
    payload, n = media.payload_of(text)
    png = media.encode_png(payload)
    return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest())


def test_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op4_media_columns(spark, small).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows} == {i: brute(t) for i, t in docs.items()}
    assert all(len(r.feature) == 16 for r in rows)


def test_tricky_rows(tricky, nothing):
    rows = media.media_features(media.media_columns(tricky)).collect()
    assert len(rows) == tricky.count()
    assert {r.payload_bytes for r in rows if r.n_bytes == 0} == {192}
    assert media.media_features(media.media_columns(nothing)).count() == 0
