"""Image files become pixel arrays with the right statistics."""

import struct
import zlib

import numpy as np
import pytest

from voltmill.operators.images import image_statistics, read_images


def png(values):
    height, width = values.shape
    raw = b"".join(b"\x00" + bytes(row) for row in values.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_statistics_of_a_file(spark, tmp_path):
    values = np.random.default_rng(4).integers(0, 256, size=(6, 5))
    (tmp_path / "cell.png").write_bytes(png(values))
    row = image_statistics(read_images(spark, str(tmp_path))).first()
    assert [int(p) for p in row.pixels] == values.ravel().tolist()
    scaled = values / 255.0
    gy, gx = np.gradient(scaled)
    magnitude = np.hypot(gx, gy)
    assert row["mean"] == pytest.approx(scaled.mean()) and row["std"] == pytest.approx(scaled.std())
    assert row.p10 == pytest.approx(np.percentile(scaled, 10)) and row.p90 == pytest.approx(np.percentile(scaled, 90))
    assert row.mean_gradient == pytest.approx(magnitude.mean())
    assert row.edge_share == pytest.approx((magnitude > 0.12).mean())
    share = np.histogram(values, bins=32, range=(0, 256))[0] / values.size
    assert row.entropy == pytest.approx(-(share[share > 0] * np.log2(share[share > 0])).sum())
