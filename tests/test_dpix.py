"""Scene folders: every interleave, database files, windows, swath angles on the grid."""

import numpy as np
import pytest

from shoalspark.sources import dpix, envi

R, C, B = 7, 6, 4


def stored(cube, how):
    """(band, line, sample) as bytes."""
    return {"bsq": cube, "bil": cube.transpose(1, 0, 2), "bip": cube.transpose(1, 2, 0)}[how].tobytes()


def database(cube, how):
    """A file of blocks: its header, one block of channel headers each of 1024 bytes, the channels."""
    bands, lines, samples = cube.shape
    head = bytearray(b" " * 512)
    head[:6] = b"PCIDSK"
    start = 2 + 2 * bands
    for at, n, v in ((304, 16, start), (336, 16, 2), (376, 8, bands), (384, 8, samples), (392, 8, lines)):
        head[at : at + n] = str(v).rjust(n).encode()
    head[360:368] = how.ljust(8).encode()
    channel = bytearray(b" " * 1024)
    channel[201:202] = b"N"
    big = cube.astype(">i2")
    if how == "BAND":
        data = big.tobytes()
    else:
        rows = [r.tobytes() for r in big.transpose(1, 2, 0)]
        data = b"".join(r + b"\0" * (-len(r) % 512) for r in rows)
    return bytes(head) + bytes(channel) * bands + data


def folder(path, how="bsq", geometry=True):
    rng = np.random.default_rng(5)
    cube = rng.integers(-3, 40, (B, R, C)).astype("<i2")
    cube[0, 2, 3] = -9
    path.mkdir()
    raw = stored(cube, how) if how.islower() else database(cube, how)
    (path / "A-12-L1.pix").write_bytes(raw)
    (path / "A-12-L1.pix.hdr").write_text(f"ENVI\nsamples = {C}\nlines = {R}\nbands = {B}\ndata type = 2\ninterleave = {how if how.islower() else 'bsq'}\nscale factor = 10\ndata ignore value = -9\nmap info = {{UTM, 1, 1, 500000, 5500000, 2, 2, 20, North, WGS84}}\nwavelength = {{400, 500, 600, 700}}\nfwhm = {{5, 6, 7, 8}}\nbbl = {{1, 0, 1, 1}}\nacquisition time = 2024-06-01T15:00:00Z\n")
    x = 500001.0 + 4 * np.arange(3)[None, :] + 0 * np.arange(R)[:, None]
    y = 5499999.0 - 2 * np.arange(R)[:, None] + 0 * x
    if geometry:
        (path / "A-12-L1.glu").write_bytes(np.stack([x, y]).astype("<f8").tobytes())
        (path / "A-12-L1.glu.hdr").write_text(f"ENVI\nsamples = 3\nlines = {R}\nbands = 2\ndata type = 5\npixel size = {{4.0, 4.0}}\n")
        (path / "A-12-Navcor_sum.log").write_text("x\nAverage Value +1.0 -2.0 350.0 9.0 800.0 500000 5500000 + ground pixel size\n")
    return cube


@pytest.mark.parametrize("how", ["bsq", "bil", "bip", "BAND", "PIXEL"])
def test_every_layout_and_window(spark, tmp_path, how):
    cube = folder(tmp_path / "a.dpix", how)
    for window, bands in ((None, None), ((2, 5, 1, 4), [3, 1]), ((3, 3, 0, C), [0])):
        s = dpix.open_scene(spark, str(tmp_path / "a.dpix"), bands=bands, window=window, block=2)
        r0, r1, c0, c1 = window or (0, R, 0, C)
        k = list(range(B)) if bands is None else bands
        got = {(x["row"], x["col"]): x for x in s.pixels.collect()}
        assert set(got) == {(r, c) for r in range(r0, r1) for c in range(c0, c1)}
        for (r, c), x in got.items():
            assert x["radiance"] == [None if v in (0, -9) else pytest.approx(v / 10) for v in cube[k, r, c].tolist()]
            assert x["valid"] == (cube[0, r, c] != -9) and (x["x"], x["y"]) == (500000 + 2 * c, 5500000 - 2 * r)
        assert s.name == "A-12" and s.wavelengths == [[400, 500, 600, 700][i] for i in k] and s.good == [[True, False, True, True][i] for i in k]


def test_swath_angles_on_the_grid(spark, tmp_path):
    folder(tmp_path / "a.dpix")
    s = dpix.open_scene(spark, str(tmp_path / "a.dpix"), block=3)
    assert s.flight == envi.FlightLine(3, R, 4.0, 800.0, 350.0)
    got = {(x["row"], x["col"]): x for x in dpix.with_geometry(s).collect()}
    for (r, c), x in got.items():
        if (r, c) == (2, 3):
            assert x["view_zenith"] is None and x["sun_zenith"] is None and x["line_index"] is None
            continue
        k = c // 2
        assert (x["sample_index"], x["line_index"]) == (k, r)
        assert x["view_zenith"] == pytest.approx(np.degrees(np.arctan(abs(6 - (4 * k + 2)) / 800)))
        assert x["view_azimuth"] == (80 if k < 1 else 260)
        assert 20 < x["sun_zenith"] < 40 and x["relative_azimuth"] == pytest.approx(abs(x["view_azimuth"] - x["sun_azimuth"]))


def test_boxes_and_errors(spark, tmp_path):
    folder(tmp_path / "a.dpix", geometry=False)
    path = str(tmp_path / "a.dpix")
    whole = dpix.with_geometry(dpix.open_scene(spark, path))
    assert whole.where("view_zenith is not null").count() == 0
    at = {(x["row"], x["col"]): x for x in whole.collect()}
    low, high = at[(4, 1)], at[(1, 3)]
    part = dpix.open_scene(spark, path, box=(low["lon"] - 1e-7, low["lat"] - 1e-7, high["lon"] + 1e-7, high["lat"] + 1e-7))
    assert part.window == (1, 5, 1, 4) and part.pixels.count() == 12
    with pytest.raises(ValueError):
        dpix.open_scene(spark, path, box=(10, 10, 11, 11))
    with pytest.raises(ValueError):
        dpix.open_scene(spark, path, window=(0, R + 1, 0, C))
    (tmp_path / "b.dpix").mkdir()
    with pytest.raises(ValueError):
        dpix.open_scene(spark, str(tmp_path / "b.dpix"))


def test_swath_samples_without_a_position_fall_into_no_cell(spark, tmp_path):
    folder(tmp_path / "a.dpix")
    path = tmp_path / "a.dpix" / "A-12-L1.glu"
    at = np.frombuffer(path.read_bytes(), "<f8").copy().reshape(2, R, 3)
    at[:, R - 1, 1:] = np.nan
    path.write_bytes(at.tobytes())
    got = {(x["row"], x["col"]): x for x in dpix.with_geometry(dpix.open_scene(spark, str(tmp_path / "a.dpix"))).collect()}
    assert (got[0, 0]["sample_index"], got[0, 0]["line_index"]) == (0, 0)
    assert (got[R - 1, C - 1]["sample_index"], got[R - 1, C - 1]["line_index"]) == (0, R - 1)
