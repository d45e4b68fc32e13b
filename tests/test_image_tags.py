"""Orientation and colour profiles from image files' bytes."""

import struct
import zlib

import numpy as np
import pytest

from rasterloom.sources import images, tags


def _profile(matrix, curve):
    xyz = lambda c: b"XYZ \0\0\0\0" + struct.pack(">3i", *[round(v * 65536) for v in c])
    parts = {f"{c}XYZ": xyz(matrix[:, i]) for i, c in enumerate("rgb")} | {f"{c}TRC": curve for c in "rgb"}
    table, body, at = b"", b"", 132 + 12 * len(parts)
    for name, value in parts.items():
        table += name.encode() + struct.pack(">II", at + len(body), len(value))
        body += value + b"\0" * (-len(value) % 4)
    head = bytearray(128)
    head[8:12], head[12:16], head[16:20], head[20:24], head[36:40] = b"\x02\x10\0\0", b"mntr", b"RGB ", b"XYZ ", b"acsp"
    head[68:80] = struct.pack(">3i", 63190, 65536, 54061)
    out = bytes(head) + struct.pack(">I", len(parts)) + table + body
    return struct.pack(">I", len(out)) + out[4:]


GAMMA = b"curv\0\0\0\0" + struct.pack(">IH", 1, round(2.2 * 256))
#: Red and blue change places.
SWAPPED = _profile(tags.SRGB_D50[:, [2, 1, 0]], GAMMA)


def _exif(turn, order=">"):
    mark = b"MM\0*" if order == ">" else b"II*\0"
    return mark + struct.pack(f"{order}IH", 8, 2) + struct.pack(f"{order}HHIHH", 0x0100, 3, 1, 9, 0) + struct.pack(f"{order}HHIHH", 0x0112, 3, 1, turn, 0) + struct.pack(f"{order}I", 0)


def _in_png(png, name, body):
    return png[:33] + struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body)) + png[33:]


def _in_jpeg(jpeg, kind, body):
    return jpeg[:2] + b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body + jpeg[2:]


@pytest.fixture(scope="module")
def encoded(spark, tmp_path_factory):
    """A picture of four fields as PNG and JPEG, written by the JVM."""
    at, jvm = tmp_path_factory.mktemp("encoded"), spark._jvm
    picture = np.zeros((8, 16, 3), int)
    picture[:4, :8], picture[:4, 8:], picture[4:, :8], picture[4:, 8:] = (250, 10, 10), (10, 250, 10), (10, 10, 250), (100, 150, 200)
    image = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for y in range(8):
        for x in range(16):
            r, g, b = picture[y, x].tolist()
            image.setRGB(x, y, r << 16 | g << 8 | b)
    for kind in ("png", "jpg"):
        assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(at / f"plain.{kind}")))
    return picture, (at / "plain.png").read_bytes(), (at / "plain.jpg").read_bytes()


def _read(spark, folder):
    out = {}
    for r in images.read_pixels(spark, f"file://{folder}").collect():
        out.setdefault(r["image_id"].rsplit("/", 1)[1], np.zeros((r["height"], r["width"], 3), int))[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    return out


def test_eight_orientations(spark, encoded, tmp_path):
    picture, png, jpeg = encoded
    shown = {1: lambda p: p, 2: np.fliplr, 3: lambda p: np.rot90(p, 2), 4: np.flipud, 5: lambda p: p.transpose(1, 0, 2), 6: lambda p: np.rot90(p, -1), 7: lambda p: np.rot90(p, 2).transpose(1, 0, 2), 8: np.rot90}
    for turn in shown:
        (tmp_path / f"{turn}.png").write_bytes(_in_png(png, b"eXIf", _exif(turn)))
        (tmp_path / f"{turn}.jpg").write_bytes(_in_jpeg(jpeg, 0xE1, b"Exif\0\0" + _exif(turn, "<")))
    (tmp_path / "9.png").write_bytes(_in_png(png, b"eXIf", _exif(9)))
    (tmp_path / "none.png").write_bytes(png)
    (tmp_path / "none.jpg").write_bytes(jpeg)
    got = _read(spark, tmp_path)
    for turn, shift in shown.items():
        # a JPEG's own colours are those of the untagged file
        assert np.array_equal(got[f"{turn}.png"], shift(picture)) and np.array_equal(got[f"{turn}.jpg"], shift(got["none.jpg"])), turn
    assert np.array_equal(got["9.png"], picture) and np.array_equal(got["none.png"], picture)


def test_profiles(spark, encoded, tmp_path):
    picture, png, jpeg = encoded
    chunk = lambda icc: b"own\0\0" + zlib.compress(icc)
    (tmp_path / "swapped.png").write_bytes(_in_png(png, b"iCCP", chunk(SWAPPED)))
    (tmp_path / "table.png").write_bytes(_in_png(png, b"iCCP", chunk(SWAPPED.replace(b"rTRC", b"A2B0"))))
    (tmp_path / "broken.png").write_bytes(_in_png(png, b"iCCP", b"own\0\0xx"))
    # the decoder applies a JPEG's profile: once, not twice
    (tmp_path / "swapped.jpg").write_bytes(_in_jpeg(jpeg, 0xE2, b"ICC_PROFILE\0\x01\x01" + SWAPPED))
    got = _read(spark, tmp_path)
    assert np.abs(got["swapped.png"][6, 12] - [200, 150, 100]).max() <= 2 and np.abs(got["swapped.jpg"][6, 12] - [200, 150, 100]).max() <= 8
    assert np.array_equal(got["table.png"], picture) and np.array_equal(got["broken.png"], picture)


def test_curves_and_cut_files(encoded):
    _, png, jpeg = encoded
    x = np.linspace(0, 1, tags.CURVE_POINTS)
    assert np.allclose(tags._curve(b"curv\0\0\0\0" + struct.pack(">I", 0)), x)
    assert np.allclose(tags._curve(b"curv\0\0\0\0" + struct.pack(">I3H", 3, 0, 16384, 65535)), np.interp(x, [0, 0.5, 1], [0, 16384 / 65535, 1]))
    srgb = [2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045]
    para = b"para\0\0\0\0" + struct.pack(">HH5i", 3, 0, *[round(v * 65536) for v in srgb])
    assert np.abs(tags._curve(para) - np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)).max() < 1e-3
    assert tags._curve(b"curv\0\0\0\0" + struct.pack(">I", 9)) is None and tags._curve(b"mft2") is None
    whole = _in_png(_in_png(png, b"iCCP", b"own\0\0" + zlib.compress(SWAPPED)), b"eXIf", _exif(6))
    for data in (whole, _in_jpeg(jpeg, 0xE1, b"Exif\0\0" + _exif(3))):
        for n in range(0, min(len(data), 900), 7):  # a file cut off anywhere has some answer
            assert tags.orientation_of(data[:n]) in range(1, 9) and (tags.profile_of(data[:n]) is None or n > 40)
    assert tags.orientation_of(b"") == 1 and tags.orientation_of(b"GIF89a") == 1 and tags.profile_of(whole) is not None


def test_srgb_stays():
    rgb = np.random.default_rng(0).integers(0, 256, (5, 7, 3))
    curve = tags._curve(b"para\0\0\0\0" + struct.pack(">HH5i", 3, 0, *[round(v * 65536) for v in (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)]))
    assert np.abs(tags.to_srgb(rgb, tags.SRGB_D50, [curve] * 3) - rgb).max() < 0.6
