"""JPEG files as Spark's image source decodes them."""

import numpy as np
import pytest

from mediaspark.sources import jpeg as jpegs
from mediaspark.sources.jpeg import jpeg


def pictures():
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:213, 0:320]
    smooth = np.stack([x * 255 / 319, y * 255 / 212, 128 + 100 * np.sin(x / 40) * np.cos(y / 30)], axis=2)
    shapes = np.zeros((64, 90, 3))
    shapes[10:40, 20:70] = (200, 30, 90)
    shapes[(np.mgrid[0:64, 0:90][0] - 40) ** 2 + (np.mgrid[0:64, 0:90][1] - 30) ** 2 < 150] = (20, 220, 240)
    return {
        "smooth": smooth, "shapes": shapes, "flat": np.full((8, 8, 3), 77), "dot": np.full((1, 1, 3), (10, 200, 30)), "line": smooth[:1, :7],
        "odd": smooth[:13, :7], "white": np.full((30, 30, 3), 255), "soft": np.clip(smooth + rng.normal(scale=3, size=smooth.shape), 0, 255),
    }


def decoded(spark, folder):
    rows = spark.read.format("image").load(str(folder)).select("image.*").collect()
    return {r["origin"].rsplit("/", 1)[1].split(".")[0]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])[:, :, ::-1] for r in rows}


def test_files_decode_to_their_pixels(spark, tmp_path):
    """Within two grey levels on average, at sizes that are no whole blocks too; fine noise, of 2.4 on average, may go."""
    want = {k: np.rint(v).astype(np.uint8) for k, v in pictures().items()}
    for name, px in want.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg(px))
    got = decoded(spark, tmp_path)
    assert set(got) == set(want)
    for name, px in want.items():
        assert got[name].shape == px.shape
        assert np.abs(got[name].astype(int) - px).mean() <= (2.4 if name == "soft" else 1), name


def test_any_pixels_make_a_file(spark, tmp_path):
    """Noise at all qualities: long codes, runs of zeros, large coefficients."""
    rng = np.random.default_rng(2)
    noise = rng.integers(0, 256, (70, 50, 3)).astype(np.uint8)
    sparse = np.where(rng.random((64, 64, 1)) < 0.01, 255, 0).repeat(3, axis=2).astype(np.uint8)
    for quality in (5, 30, 75, 100):
        (tmp_path / f"noise{quality}.jpg").write_bytes(jpeg(noise, quality))
        (tmp_path / f"sparse{quality}.jpg").write_bytes(jpeg(sparse, quality))
    got = decoded(spark, tmp_path)
    assert len(got) == 8
    assert np.abs(got["noise100"].astype(int) - noise).mean() < 2 and np.abs(got["sparse100"].astype(int) - sparse).mean() < 2
    assert np.abs(got["noise5"].astype(int) - noise).mean() > np.abs(got["noise75"].astype(int) - noise).mean()


@pytest.mark.parametrize("counts", [[1], [5, 1], [2**i for i in range(40)], list(range(1, 257)), [1] * 256])
def test_codes_are_prefix_free_and_short(counts):
    code, length, numbers, order = jpegs._huffman(np.array(counts + [0] * (256 - len(counts))))
    assert sum(numbers) == len(order) == len(counts)
    words = [format(code[s], f"0{length[s]}b") for s in range(len(counts))]
    assert all(1 <= len(w) <= 16 and "0" in w for w in words)
    assert not any(a != b and b.startswith(a) for a in words for b in words) and len(set(words)) == len(words)
