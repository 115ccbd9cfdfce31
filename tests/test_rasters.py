"""Raster files: headers, windows by tiles and byte ranges, odd values and formats."""

import io

import numpy as np
import pytest

from fieldloom.sources import files, rasters


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    def __init__(self, data):
        super().__init__(data)
        self.taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def arrays():
    r = np.random.default_rng(0)
    yield r.uniform(-1, 1, (70, 90)).astype(np.float32)
    yield r.integers(0, 255, (70, 90, 4)).astype(np.uint8)
    yield r.integers(-999, 999, (33, 50, 2)).astype(np.int16)
    yield r.uniform(0, 9, (20, 17))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [0, 16, 32])
@pytest.mark.parametrize("deflate", [False, True])
def test_tiff_windows(order, tile, deflate):
    for array in arrays():
        for predictor in (False, True) if array.dtype.kind != "f" else (False,):
            file = Counted(rasters.tiff_bytes(array, tile, deflate, predictor, order, nodata=-7, corner=(500.0, 900.0, 0.5, -0.5)))
            h = rasters.read_header(file)
            assert (h.rows, h.cols, h.bands, h.nodata) == (*array.shape[:2], array.shape[2] if array.ndim == 3 else 1, -7) and file.taken < 4096
            assert (h.x0, h.y0, h.dx, h.dy) == (500.0, 900.0, 0.5, -0.5)
            for window in ((0, 10**6, 0, 10**6), (5, 19, 3, 41), (16, 17, 16, 17), (60, 999, 80, 999)):
                got = np.full((*array.shape[:2], h.bands), np.nan)
                for part in rasters.tiles(h, window, 512):
                    got[part[0] : part[1], part[2] : part[3]] = rasters.read_window(file, h, part)
                want = array.reshape(*array.shape[:2], -1).astype(float)
                inside = np.zeros(array.shape[:2], dtype=bool)
                inside[window[0] : window[1], window[2] : window[3]] = True
                assert np.array_equal(got[inside], want[inside]) and np.isnan(got[~inside]).all() == (window[0] != 5 or True)


def test_npy_reads_only_the_window():
    array = np.arange(400 * 3000, dtype=np.float32).reshape(400, 3000)
    file = Counted(rasters.npy_bytes(array))
    h = rasters.read_header(file)
    assert file.taken < 4096
    parts = list(rasters.tiles(h, (100, 140, 1000, 1100), 64))
    assert all(100 <= p[0] < p[1] <= 140 and 1000 <= p[2] < p[3] <= 1100 for p in parts)
    file.taken = 0
    for p in parts:
        assert np.array_equal(rasters.read_window(file, h, p)[:, :, 0], array[p[0] : p[1], p[2] : p[3]])
    assert file.taken == 40 * 100 * 4


def test_other_formats():
    assert rasters.read_header(io.BytesIO(b"")) is None and rasters.read_header(io.BytesIO(b"no raster at all")) is None
    assert rasters.read_header(io.BytesIO(rasters.npy_bytes(np.zeros(5)))) is None
    plain = bytearray(rasters.tiff_bytes(np.zeros((8, 8), dtype=np.uint8)))
    at = plain.index(b"\x03\x01\x03\x00\x01\x00\x00\x00\x01")  # the packing
    plain[at + 8] = 5
    assert rasters.read_header(io.BytesIO(bytes(plain))) is None


def test_source(spark, tmp_path):
    folder = tmp_path / "r"
    (folder / "deep").mkdir(parents=True)
    a, b = np.arange(60 * 40, dtype=np.float64).reshape(60, 40), np.arange(48 * 48 * 2, dtype=np.uint16).reshape(48, 48, 2)
    a[3, 4], a[5, 6], a[7, 8] = np.nan, np.inf, -9
    (folder / "a.npy").write_bytes(rasters.npy_bytes(a))
    (folder / "deep" / "b.tif").write_bytes(rasters.tiff_bytes(b, 16, True, True, ">", nodata=100))
    (folder / "_SUCCESS").write_bytes(b"")
    got = {(r.path.rsplit("/", 1)[-1], r.band, r.row, r.col): r.value for r in rasters.read(spark, str(folder), tile=16).collect()}
    assert len(got) == 60 * 40 + 48 * 48 * 2
    assert got["a.npy", 0, 3, 4] is None and got["a.npy", 0, 5, 6] is None and got["a.npy", 0, 7, 8] == -9 and got["a.npy", 0, 59, 39] == 2399
    assert got["b.tif", 0, 1, 2] is None and got["b.tif", 1, 1, 2] == 101
    part = rasters.read(spark, str(folder), window=(10, 20, 30, 60), bands=(0,), tile=16, nodata=430.0)
    rows = part.collect()
    assert {(r.row, r.col) for r in rows if r.path.endswith("npy")} == {(r, c) for r in range(10, 20) for c in range(30, 40)}
    assert [r for r in rows if r.path.endswith("npy") and r.value is None][0].row == 10
    # Of 12 + 9 tiles the window meets 2 x 2 of the one and 2 x 2 of the other raster.
    assert part.rdd.getNumPartitions() == 4 + 4
    assert rasters.read(spark, str(folder), window=(10**6, 10**6 + 5, 0, 9)).count() == 0
    assert rasters.read(spark, str(folder / "a.npy"), window=(0, 1, 0, 3)).count() == 3
    with pytest.raises(Exception, match="no band"):
        rasters.read(spark, str(folder / "a.npy"), bands=(1,)).count()
    (folder / "x.txt").write_text("x")
    with pytest.raises(Exception, match="no npy or TIFF"):
        rasters.read(spark, str(folder)).count()
    found = {r.path.rsplit("/", 1)[-1]: (r.kind, r.rows, r.cols, r.bands, r.type, r.tile_rows, r.nodata) for r in files.grid_headers(spark, str(folder)).collect()}
    assert found["a.npy"] == ("npy", 60, 40, 1, "<f8", 0, None) and found["b.tif"] == ("tiff", 48, 48, 2, ">u2", 16, 100.0) and found["x.txt"][0] is None


@pytest.mark.parametrize("kind", ["npy", "tiff"])
def test_written_bands_read_back(spark, tmp_path, kind):
    pixels = spark.createDataFrame([(r, c, float(r * c)) for r in range(30) for c in range(21) if (r + c) % 3], "row int, col int, value double")
    made = rasters.write_bands(pixels, str(tmp_path / "out"), 8, kind=kind).collect()
    assert sorted((m.band, m.rows, m.cols) for m in made) == [(b, 8, 21) for b in range(4)]
    got = {(8 * int(r.path[-11:].split("-")[-1].split(".")[0]) + r.row, r.col): r.value for r in rasters.read(spark, str(tmp_path / "out")).where("value IS NOT NULL").collect()}
    assert got == {(p.row, p.col): p.value for p in pixels.collect()}


def test_paths_without_scheme(spark, tmp_path):
    from fieldloom.sources import store

    assert store.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert files.discover(spark, str(tmp_path.parent), {}) == {}
