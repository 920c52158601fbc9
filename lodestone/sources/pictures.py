"""Picture files: headers and grey values, a failure staying in its row."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The signature of PNG files, and channels and names by colour type.
SIGNATURE = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A])
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}


def _number(content: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, size)), 16, 10).cast("int")


def headers(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds width, height, bit_depth, mode, channels, format and read_ok from the first 33 bytes; no pixel is decoded.

    What is no PNG has read_ok false and nulls.
    """
    c = F.col(content)
    png = F.coalesce((F.substring(c, 1, 8) == F.lit(SIGNATURE)) & (F.octet_length(c) >= 33) & (F.substring(c, 13, 4) == F.lit(b"IHDR")), F.lit(False))
    kind = _number(c, 26, 1)
    pick = lambda names: F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])[kind]
    found = {"width": _number(c, 17, 4), "height": _number(c, 21, 4), "bit_depth": _number(c, 25, 1), "mode": pick(MODES), "channels": pick(CHANNELS | {3: 1}), "format": F.lit("PNG")}
    return files.withColumns({k: F.when(png, v) for k, v in found.items()} | {"read_ok": png})


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(height, width, grey values 0 to 255 or 65535) of a PNG of 8 or 16 bits without a palette; anything else raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body = 8, None, []
    while at + 12 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size or zlib.crc32(name + chunk) != struct.unpack(">I", data[at + 8 + size : at + 12 + size].rjust(4, b"\0"))[0]:
            raise ValueError("a broken chunk")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif name == b"IDAT":
            body.append(chunk)
        elif name == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] not in (8, 16) or head[3] not in CHANNELS or head[6]:
        raise ValueError("a kind of PNG that is not read")
    width, height, depth, kind = head[:4]
    step = CHANNELS[kind] * depth // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    except zlib.error as e:
        raise ValueError("broken pixel data") from e
    if raw.size != height * (width * step + 1):
        raise ValueError("other than its size")
    lines = raw.reshape(height, -1)
    out = np.zeros((height, width * step), dtype=np.uint8)
    above = np.zeros(width * step, dtype=np.int64)
    for y in range(height):
        above = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:].astype(np.int64), above, step)
        above = above.astype(np.int64)
    values = out.reshape(height, width, CHANNELS[kind], depth // 8).astype(np.int64)
    values = values[..., 0] if depth == 8 else values[..., 0] * 256 + values[..., 1]
    if CHANNELS[kind] < 3:
        return height, width, values[..., 0]
    # The weights of red, green and blue in grey.
    return height, width, (values[..., :3] @ np.array([19595, 38470, 7471]) + 0x8000) >> 16


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One line of bytes without its filter."""
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) % 256
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0).ravel() % 256
    if kind not in (3, 4):
        raise ValueError("an unknown filter")
    out, up = line.tolist(), above.tolist()
    for i, x in enumerate(out):
        a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            out[i] = (x + (a + b) // 2) % 256
        else:
            # The neighbour nearest to left + above - corner.
            out[i] = (x + min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]) % 256
    return np.array(out)


def pixels(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds grey (values by rows), grey_height, grey_width and grey_error of each file; a file that cannot be decoded has its error and nulls.

    The contents are dropped: what is read after this carries pixels, not files.
    """
    rest = [c for c in files.columns if c != content]
    kinds = dict(files.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One picture at a time: a batch of decoded ones could be large.
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                try:
                    height, width, grey = decode(row.column(content)[0].as_py() or b"")
                    found = [[grey.ravel().astype(float)], [height], [width], [None]]
                except ValueError as e:
                    found = [[None], [None], [None], [str(e)]]
                types = [pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.string()]
                added = [pa.array(v, type=t) for v, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in rest), *added], names=[*rest, "grey", "grey_height", "grey_width", "grey_error"])

    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in rest)
    return files.mapInArrow(run, f"{ddl}, grey array<double>, grey_height int, grey_width int, grey_error string")


def records(files: DataFrame, root: str) -> DataFrame:
    """Adds rel, split, class_dir, name and warning from a path under a root: split / class / name; another depth gives a warning and no row is dropped."""
    rel = F.regexp_replace("path", "^" + "".join(f"\\{c}" if not c.isalnum() else c for c in root.rstrip("/")) + "/", "")
    parts = F.split(rel, "/")
    fits = F.size(parts) == 3
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return files.withColumns({
        "rel": rel, "split": F.when(fits, F.get(parts, F.lit(0))), "class_dir": F.when(fits, F.get(parts, F.lit(1))), "name": name,
        "warning": F.when(~fits, F.concat(F.lit("depth "), F.size(parts).cast("string"), F.lit(": "), rel)),
    })
