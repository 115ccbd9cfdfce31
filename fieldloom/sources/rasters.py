"""Raster files as tables: a Python data source whose partitions are tiles, read by byte ranges.

    rasters.register(spark)
    spark.read.format("raster").option("window", "0,256,512,768").option("bands", "0").load(folder)

gives (path, band, row, col, value). Only the tiles that the window meets are planned, and of a tile only the bytes that
the window and the bands need are read: rows of an npy file, strips or tiles of a TIFF file. Known formats: npy in C order
(rows, cols) or (rows, cols, bands); TIFF and BigTIFF, either byte order, in strips or tiles, plain or deflate, with
horizontal predictor, bands together. Files of other formats are an error in a read and have null figures in headers().

Options: window (first row, end row, first col, end col; beyond a raster nothing is read), bands (numbers from 0),
tile (rows and cols of a partition of an npy file, 512), nodata (a value that becomes null, as NaN and infinities do; the
default of a TIFF is its own).
"""

from __future__ import annotations

import ast
import io
import math
import struct
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldloom.sources.store import qualified

SCHEMA = "path string, band int, row int, col int, value double"
HEADER = "kind string, rows long, cols long, bands int, type string, tile_rows long, tile_cols long, x0 double, y0 double, dx double, dy double, nodata double"
#: Bytes of a first read: the whole header of an npy or PNG file, and the directory of most TIFF files.
FIRST = 1024


class Header(NamedTuple):
    kind: str
    rows: int
    cols: int
    bands: int
    type: str
    tile_rows: int
    tile_cols: int
    #: Upper left corner and size of a pixel, where the file says so.
    x0: float | None = None
    y0: float | None = None
    dx: float | None = None
    dy: float | None = None
    nodata: float | None = None
    #: For readers: where the data begin (npy), or the directory's own fields (TIFF).
    more: Any = None


def file_system(path: str):
    """pyarrow's file system of a qualified path, and the path in it."""
    from pyarrow import fs

    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


# Headers


def read_header(file) -> Header | None:
    """Of an open random access file; None for another format. Reads FIRST bytes, and of a TIFF its directory."""
    file.seek(0)
    head = file.read(FIRST)
    if head[:6] == b"\x93NUMPY":
        size = struct.unpack("<H", head[8:10])[0] if head[6] == 1 else struct.unpack("<I", head[8:12])[0]
        begin = 10 if head[6] == 1 else 12
        if begin + size > len(head):
            file.seek(0)
            head = file.read(begin + size)
        found = ast.literal_eval(head[begin : begin + size].decode("latin1"))
        shape = found["shape"]
        if found["fortran_order"] or len(shape) not in (2, 3) or np.dtype(found["descr"]).kind not in "uif":
            return None
        return Header("npy", shape[0], shape[1], shape[2] if len(shape) == 3 else 1, found["descr"], 0, 0, more=begin + size)
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        cols, rows, depth, colour = struct.unpack(">IIBB", head[16:26])
        return Header("png", rows, cols, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 1), f"uint{depth}", 0, 0)
    if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return _tiff_header(file, head)
    return None


#: TIFF field types: format letter and bytes of a value.
_FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}


class _Tiff(NamedTuple):
    order: str
    #: Tag: type, number of values, and the place of the values in the file.
    tags: dict[int, tuple[int, int, int]]

    def values(self, file, tag: int, low: int = 0, high: int | None = None) -> tuple:
        """Values low to high of a tag, read from the file."""
        if tag not in self.tags:
            return ()
        kind, n, at = self.tags[tag]
        letter, size = _FIELDS[kind]
        high = n if high is None else min(high, n)
        file.seek(at + low * size)
        data = file.read((high - low) * size)
        return (data.split(b"\0")[0].decode("latin1"),) if letter == "s" else struct.unpack(self.order + letter * (high - low), data)


def _tiff_header(file, head: bytes) -> Header | None:
    order, big = "<" if head[:2] == b"II" else ">", 43 in (head[2], head[3])
    at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
    width, entry, place = (8, 20, "Q") if big else (2, 12, "I")
    file.seek(at)
    n = struct.unpack(order + ("Q" if big else "H"), file.read(width))[0]
    data, tags = file.read(n * entry), {}
    for k in range(n):
        tag, kind = struct.unpack_from(order + "HH", data, k * entry)
        count = struct.unpack_from(order + place, data, k * entry + 4)[0]
        if kind in _FIELDS:
            inline = count * _FIELDS[kind][1] <= (8 if big else 4)
            where = at + width + k * entry + (12 if big else 8)
            tags[tag] = (kind, count, where if inline else struct.unpack_from(order + place, data, k * entry + (12 if big else 8))[0])
    tiff = _Tiff(order, tags)
    one = lambda tag, default: (tiff.values(file, tag, 0, 1) or (default,))[0]
    cols, rows, bands = one(256, 0), one(257, 0), one(277, 1)
    bits, form = one(258, 1), one(339, 1)
    if one(259, 1) not in (1, 8, 32946) or bits % 8 or bits > 64 or form > 3 or one(317, 1) not in (1, 2) or (bands > 1 and one(284, 1) != 1):
        return None
    tiled = 322 in tags
    tile_rows, tile_cols = (one(323, 0), one(322, 0)) if tiled else (min(one(278, rows), rows), cols)
    scale, tie = tiff.values(file, 33550), tiff.values(file, 33922)
    place = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], -scale[1]) if len(scale) >= 2 and len(tie) >= 6 else (None,) * 4
    try:
        nodata = float((tiff.values(file, 42113) or ("",))[0])
    except ValueError:
        nodata = None
    kind = f"{order}{'u' if form == 1 else 'i' if form == 2 else 'f'}{bits // 8}"
    return Header("tiff", rows, cols, bands, kind, tile_rows, tile_cols, *place, nodata, (tiff, tiled, one(259, 1), one(317, 1)))


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, kind, rows, cols, bands, type, ...) of the files under a folder. Spark lists them and reads none;
    tasks read the first bytes of each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                system, own = file_system(path)
                with system.open_input_file(own) as file:
                    h = read_header(file)
                found.append(h[:-1] if h else (None,) * (len(Header._fields) - 1))
            columns = list(zip(*found, strict=True)) if found else [()] * (len(Header._fields) - 1)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 5]
            yield pa.record_batch([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names, *Header._fields[:-1]])

    return files.mapInArrow(scan, f"path string, bytes long, {HEADER}")


# Windows


class Tile(InputPartition):
    """A part of one raster: rows and columns, of which one partition reads the bytes."""

    def __init__(self, path: str, header: Header, window: tuple[int, int, int, int]):
        super().__init__(path)
        self.path, self.header, self.window = path, header, window


def tiles(header: Header, window: tuple[int, int, int, int], side: int) -> Iterator[tuple[int, int, int, int]]:
    """The parts of the raster's own tiles (or of squares of this side) that lie in the window."""
    r0, r1, c0, c1 = max(window[0], 0), min(window[1], header.rows), max(window[2], 0), min(window[3], header.cols)
    h, w = header.tile_rows or side, header.tile_cols or side
    if r0 < r1 and c0 < c1:
        for r in range(r0 // h * h, r1, h):
            for c in range(c0 // w * w, c1, w):
                yield max(r, r0), min(r + h, r1), max(c, c0), min(c + w, c1)


def read_window(file, header: Header, window: tuple[int, int, int, int]) -> np.ndarray:
    """(rows, cols, bands) of a window that lies inside one tile of the raster."""
    r0, r1, c0, c1 = window
    kind = np.dtype(header.type)
    if header.kind == "npy":
        line, out = header.cols * header.bands * kind.itemsize, np.empty((r1 - r0, c1 - c0, header.bands), dtype=kind)
        for r in range(r0, r1):
            file.seek(header.more + r * line + c0 * header.bands * kind.itemsize)
            out[r - r0] = np.frombuffer(file.read((c1 - c0) * header.bands * kind.itemsize), dtype=kind).reshape(-1, header.bands)
        return out
    tiff, tiled, packing, predictor = header.more
    h, w = header.tile_rows, header.tile_cols
    number = r0 // h * -(-header.cols // w) + c0 // w
    (at,), (size,) = (tiff.values(file, tag, number, number + 1) for tag in ((324, 325) if tiled else (273, 279)))
    file.seek(at)
    data = file.read(size)
    data = zlib.decompress(data) if packing != 1 else data
    rows = h if tiled else min(h, header.rows - r0 // h * h)
    tile = np.frombuffer(data, dtype=kind, count=rows * w * header.bands).reshape(rows, w, header.bands)
    if predictor == 2:
        tile = np.cumsum(tile, axis=1, dtype=kind)
    top, left = r0 // h * h, c0 // w * w
    return tile[r0 - top : r1 - top, c0 - left : c1 - left]


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        numbers = lambda name, default: tuple(int(x) for x in options[name].split(",")) if options.get(name) else default
        if "path" not in options:
            raise ValueError("load() needs a folder or file")
        self.path = options["path"]
        self.window = numbers("window", (0, 1 << 62, 0, 1 << 62))
        self.bands, self.side = numbers("bands", None), int(options.get("tile", 512))
        self.nodata = float(options["nodata"]) if options.get("nodata") else None
        if len(self.window) != 4:
            raise ValueError("a window is first row, end row, first col, end col")

    def partitions(self) -> list[Tile]:
        from pyarrow import fs

        system, own = file_system(self.path)
        info = system.get_file_info(own)
        prefix = self.path[: len(self.path) - len(own.rstrip("/"))] if self.path.rstrip("/").endswith(own.rstrip("/")) else ""
        files = [info] if info.is_file else sorted((f for f in system.get_file_info(fs.FileSelector(own, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        out = []
        for f in files:
            with system.open_input_file(f.path) as file:
                header = read_header(file)
            if header is None or header.kind == "png":
                raise ValueError(f"{f.path} is no npy or TIFF raster that can be read in parts")
            out += [Tile(prefix + f.path, header, w) for w in tiles(header, self.window, self.side)]
        return out

    def read(self, tile: Tile | None) -> Iterator[pa.RecordBatch]:
        if tile is None:  # the one partition of a plan without tiles
            return
        system, own = file_system(tile.path)
        r0, r1, c0, c1 = tile.window
        with system.open_input_file(own) as file:
            values = read_window(file, tile.header, tile.window)
        nodata = tile.header.nodata if self.nodata is None else self.nodata
        row, col = (g.ravel().astype(np.int32) for g in np.meshgrid(np.arange(r0, r1), np.arange(c0, c1), indexing="ij"))
        for band in self.bands if self.bands is not None else range(tile.header.bands):
            if not 0 <= band < tile.header.bands:
                raise ValueError(f"{tile.path} has no band {band}")
            v = values[:, :, band].ravel().astype(np.float64)
            unknown = ~np.isfinite(v) | ((v == nodata) if nodata is not None else False)
            n = len(v)
            yield pa.record_batch([pa.array([tile.path] * n, pa.string()), pa.array(np.full(n, band, np.int32)), pa.array(row), pa.array(col), pa.array(v, mask=unknown)], names=["path", "band", "row", "col", "value"])


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)


def read(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, bands: tuple[int, ...] | None = None, tile: int = 512, nodata: float | None = None) -> DataFrame:
    """(path, band, row, col, value) of the rasters under a path, as Spark resolves it."""
    register(spark)
    options = {"window": window and ",".join(map(str, window)), "bands": bands and ",".join(map(str, bands)), "tile": tile, "nodata": nodata}
    return spark.read.format("raster").options(**{k: str(v) for k, v in options.items() if v is not None}).load(qualified(spark, path))


# Files


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array))
    return out.getvalue()


def tiff_bytes(array: np.ndarray, tile: int = 0, deflate: bool = False, predictor: bool = False, order: str = "<", nodata: float | None = None, corner: tuple[float, float, float, float] | None = None) -> bytes:
    """A TIFF file of (rows, cols) or (rows, cols, bands), in square tiles (a multiple of 16) or in one strip for 8 rows.
    corner: x0, y0, dx, dy."""
    array = array if array.ndim == 3 else array[:, :, None]
    rows, cols, bands = array.shape
    kind = array.dtype.newbyteorder(order)
    h, w = (tile, tile) if tile else (8, cols)
    blocks = []
    for r in range(0, rows, h):
        for c in range(0, cols, w):
            part = array[r : r + h, c : c + w]
            if tile:
                part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
            if predictor:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            data = part.astype(kind).tobytes()
            blocks.append(zlib.compress(data) if deflate else data)
    fields: list[tuple[int, str, tuple]] = [
        (256, "I", (cols,)), (257, "I", (rows,)), (258, "H", (8 * kind.itemsize,) * bands), (259, "H", (8 if deflate else 1,)), (262, "H", (1,)), (277, "H", (bands,)), (284, "H", (1,)),
        (339, "H", ({"u": 1, "i": 2, "f": 3}[kind.kind],) * bands), *([(317, "H", (2,))] if predictor else []), *([(322, "I", (w,)), (323, "I", (h,))] if tile else [(278, "I", (h,))]),
        *([(33550, "d", (corner[2], -corner[3], 0.0)), (33922, "d", (0.0, 0.0, 0.0, corner[0], corner[1], 0.0))] if corner else []), *([(42113, "s", (f"{nodata:g}\0".encode(),))] if nodata is not None else []),
    ]
    at = 8 + np.cumsum([0, *map(len, blocks)])
    fields += [(324 if tile else 273, "I", tuple(at[:-1].tolist())), (325 if tile else 279, "I", tuple(map(len, blocks)))]
    fields.sort()
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    directory, extra = b"", b""
    rest = int(at[-1]) + 2 + 12 * len(fields) + 4
    for tag, letter, values in fields:
        data = values[0] if letter == "s" else struct.pack(order + letter * len(values), *values)
        n = len(data) if letter == "s" else len(values)
        if len(data) > 4:
            place, extra = struct.pack(order + "I", rest + len(extra)), extra + data
        else:
            place = data.ljust(4, b"\0")
        directory += struct.pack(order + "HHI", tag, codes[letter], n) + place
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, int(at[-1]))
    return head + b"".join(blocks) + struct.pack(order + "H", len(fields)) + directory + struct.pack(order + "I", 0) + extra


def write_bands(pixels: DataFrame, folder: str, height: int, value: str = "value", kind: str = "npy") -> DataFrame:
    """Write pixels (row, col, value) as one raster for each band of so many rows, missing ones as NaN; rows count from the
    band's first one. A task holds one band. Returns (band, path, rows, cols), once the files are there."""
    folder = qualified(pixels.sparkSession, folder)
    if kind not in ("npy", "tiff"):
        raise ValueError("npy or tiff")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        band = key[0].as_py()
        row, col, v = (table.column(k).to_numpy(zero_copy_only=False) for k in ("row", "col", "value"))
        array = np.full((height, int(table.column("cols")[0].as_py())), np.nan)
        array[row - band * height, col] = v.astype(float)
        path = f"{folder.rstrip('/')}/rows-{band:06d}.{kind}"
        system, own = file_system(path)
        system.create_dir(own.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(own) as out:
            out.write(npy_bytes(array) if kind == "npy" else tiff_bytes(array, 16, deflate=True))
        return pa.table({"band": pa.array([band], pa.int64()), "path": [path], "rows": pa.array([height], pa.int64()), "cols": pa.array([array.shape[1]], pa.int64())})

    cols = (pixels.agg(F.max("col")).first()[0] or 0) + 1
    if not math.isfinite(cols):
        raise ValueError("columns without an end")
    own = pixels.select(F.floor(F.col("row") / height).alias("band"), "row", "col", F.col(value).alias("value"), F.lit(cols).alias("cols"))
    return own.groupBy("band").applyInArrow(write, "band long, path string, rows long, cols long")
