"""Bytes of volume formats to (z, y, x) arrays with a header, and back; numpy and the standard library only.

Every decoder raises ``ValueError`` on what it cannot read.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Volume:
    data: np.ndarray
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)  # x, y, z
    header: dict[str, str] = field(default_factory=dict)


# Amira ------------------------------------------------------------------------------------------

#: Lattice types and their little-endian layouts; ``byte`` is unsigned.
AMIRA_TYPES = {"byte": "<u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "long": "<i8", "ulong": "<u8", "float": "<f4", "double": "<f8"}


def rle_decode(data: bytes, size: int) -> bytes:
    """Runs: a count above 127 is followed by (count & 127) literal bytes, any other by one byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n > 127:
            out += data[at + 1 : at + 1 + (n & 127)]
            at += 1 + (n & 127)
        else:
            out += data[at + 1 : at + 2] * n
            at += 2
    if len(out) < size:
        raise ValueError("run-length data end early")
    return bytes(out[:size])


def rle_encode(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]])
    out, literal = bytearray(), bytearray()

    def end_literal() -> None:
        for i in range(0, len(literal), 127):
            part = literal[i : i + 127]
            out.append(128 + len(part))
            out.extend(part)
        literal.clear()

    for low, high in zip(edges[:-1], edges[1:]):
        n, value = int(high - low), data[low]
        if n < 3:
            literal.extend(data[low:high])
            continue
        end_literal()
        while n:
            run = min(127, n)
            out += bytes((run, value))
            n -= run
    end_literal()
    return bytes(out)


def parse_amira_header(text: str) -> dict:
    """Lattice size, bounding box and the streams (number, name, type, encoding, length) of a header."""
    lattice = re.search(r"define\s+Lattice\s+(\d+)\s+(\d+)\s+(\d+)", text)
    if not lattice:
        raise ValueError("no lattice in the header")
    box = re.search(r"BoundingBox\s+((?:[-+.\deE]+\s*){6})", text)
    streams = []
    for m in re.finditer(r"Lattice\s*\{\s*(\w+)(?:\[(\d+)\])?\s+(\w+)\s*\}\s*=?\s*@(\d+)(?:\((\w+),(\d+)\))?", text):
        streams.append({"type": m[1], "channels": int(m[2] or 1), "name": m[3], "number": int(m[4]), "encoding": m[5] or "", "length": int(m[6] or 0)})
    return {"lattice": tuple(map(int, lattice.groups())), "box": tuple(map(float, box[1].split())) if box else None, "streams": streams, "ascii": "ASCII" in text.split("\n", 1)[0]}


AMIRA_TOKEN = re.compile(r'"(?:[^"\\\\]|\\\\.)*"|[{}\[\]=,]|[^\s{}\[\]=,"]+')


def _amira_value(text: str):
    if text.startswith('"'):
        return text[1:-1].replace('\\\\"', '"')
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_amira_tree(text: str) -> dict:
    """All of a header: ``define`` (sizes by name) and ``Parameters`` with their groups, materials included, as nested dicts.

    A key has its value, a list where several follow, or a dict where a group does; unknown statements are passed over.
    """
    lines = [x for x in text.splitlines() if not x.lstrip().startswith("#")]
    tokens = [(m[0], n) for n, x in enumerate(lines) for m in AMIRA_TOKEN.finditer(x)]
    at = 0

    def group() -> dict:
        nonlocal at
        out: dict = {}
        while at < len(tokens) and tokens[at][0] != "}":
            key, row = tokens[at]
            at += 1
            if key == ",":
                continue
            key = str(_amira_value(key))
            if at < len(tokens) and tokens[at][0] == "{":
                at += 1
                out[key] = group()
                at += 1
                continue
            values = []
            while at < len(tokens) and tokens[at][1] == row and tokens[at][0] not in ("{", "}", ","):
                values.append(_amira_value(tokens[at][0]))
                at += 1
            out[key] = values[0] if len(values) == 1 else values
        return out

    found = {"define": {}, "Parameters": {}}
    while at < len(tokens):
        word, row = tokens[at]
        at += 1
        if word == "define" and at < len(tokens):
            name = tokens[at][0]
            at += 1
            sizes = []
            while at < len(tokens) and tokens[at][1] == row:
                sizes.append(int(tokens[at][0]))
                at += 1
            found["define"][name] = sizes
        elif word == "Parameters" and at < len(tokens) and tokens[at][0] == "{":
            at += 1
            found["Parameters"] = group()
            at += 1
    return found


def decode_amira(data: bytes) -> list[Volume]:
    start = re.search(rb"\n@1[ \t\r]*\n", data)
    if not data.startswith((b"# AmiraMesh", b"# Avizo")) or not start:
        raise ValueError("not an Amira mesh file")
    text = data[: start.start()].decode("latin-1")
    head = parse_amira_header(text)
    nx, ny, nz = head["lattice"]
    spacing = tuple((b - a) / max(1, n - 1) for a, b, n in zip(head["box"][::2], head["box"][1::2], (nx, ny, nz))) if head["box"] else (1.0, 1.0, 1.0)
    out, at = [], start.start()
    for s in sorted(head["streams"], key=lambda s: s["number"]):
        mark = re.compile(rb"\n@%d[ \t\r]*\n" % s["number"]).search(data, at)
        if not mark or s["type"] not in AMIRA_TYPES:
            raise ValueError(f"stream @{s['number']} is missing or of unknown type")
        kind = np.dtype(AMIRA_TYPES[s["type"]])
        n = nx * ny * nz * s["channels"]
        body = mark.end()
        if head["ascii"]:
            end = data.find(b"\n@", body)
            values = np.array(data[body : end if end >= 0 else None].split()[:n], float).astype(kind)
            at = end if end >= 0 else len(data)
        else:
            length = s["length"] or n * kind.itemsize
            raw = data[body : body + length]
            at = body + length - 1
            if s["encoding"] == "HxByteRLE":
                raw = rle_decode(raw, n * kind.itemsize)
            elif s["encoding"] == "HxZip":
                raw = zlib.decompress(raw)
            elif s["encoding"]:
                raise ValueError(f"encoding {s['encoding']} is not known")
            values = np.frombuffer(raw, kind, n)
        shape = (nz, ny, nx, s["channels"]) if s["channels"] > 1 else (nz, ny, nx)
        out.append(Volume(values.reshape(shape), spacing, {"amira": text, "name": s["name"], "encoding": s["encoding"]}))
    return out


def rewrite_amira_header(text: str, shape: tuple[int, int, int], spacing: tuple[float, float, float]) -> str:
    """The header with another lattice size, and a bounding box to match."""
    nz, ny, nx = shape
    box = " ".join(f"0 {s * (n - 1):g}" for s, n in zip(spacing, (nx, ny, nz)))
    text = re.sub(r"define\s+Lattice\s+\d+\s+\d+\s+\d+", f"define Lattice {nx} {ny} {nz}", text)
    text = re.sub(r'Content\s+"\d+x\d+x\d+', f'Content "{nx}x{ny}x{nz}', text)
    return re.sub(r"BoundingBox\s+(?:[-+.\deE]+[ \t]*){6}", f"BoundingBox {box}", text)


def encode_amira(volume: Volume, encoding: str = "HxByteRLE") -> bytes:
    kinds = {np.dtype(v): k for k, v in AMIRA_TYPES.items()}
    a = volume.data
    kind = kinds.get(a.dtype.newbyteorder("<"))
    if kind is None or a.ndim != 3:
        raise ValueError(f"{a.dtype} volumes of {a.ndim} axes have no lattice type")
    raw = a.astype(a.dtype.newbyteorder("<")).tobytes()
    packed = {"": lambda: raw, "HxByteRLE": lambda: rle_encode(raw), "HxZip": lambda: zlib.compress(raw)}[encoding]()
    nz, ny, nx = a.shape
    box = " ".join(f"0 {s * (n - 1):g}" for s, n in zip(volume.spacing, (nx, ny, nz)))
    stream = f"@1({encoding},{len(packed)})" if encoding else "@1"
    head = f'# AmiraMesh BINARY-LITTLE-ENDIAN 2.1\n\ndefine Lattice {nx} {ny} {nz}\n\nParameters {{\n    Content "{nx}x{ny}x{nz} {kind}, uniform coordinates",\n    BoundingBox {box},\n    CoordType "uniform"\n}}\n\nLattice {{ {kind} Data }} {stream}\n\n# Data section follows\n@1\n'
    return head.encode() + packed + b"\n"


# NRRD, MetaImage, NIfTI, MRC ----------------------------------------------------------------------

#: Type names of the formats.
NRRD_TYPES = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "signed char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "int64": "i8", "uint64": "u8", "float": "f4", "double": "f8"}
NRRD_NAMES = {"u1": "uint8", "i1": "int8", "i2": "int16", "u2": "uint16", "i4": "int32", "u4": "uint32", "i8": "int64", "u8": "uint64", "f4": "float", "f8": "double"}
META_TYPES = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_LONG_LONG": "i8", "MET_ULONG_LONG": "u8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
MRC_TYPES = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}


def decode_nrrd(data: bytes) -> Volume:
    if not data.startswith(b"NRRD"):
        raise ValueError("not an NRRD file")
    head, _, body = data.partition(b"\n\n")
    fields, keys = {}, {}
    for line in head.decode("latin-1").replace("\r", "").split("\n")[1:]:
        if line.startswith("#"):
            continue
        if ":=" in line:
            k, v = line.split(":=", 1)
            keys[k] = v
        elif ":" in line:
            k, v = line.split(":", 1)
            fields[k.strip().lower()] = v.strip()
    if fields.get("type", "").lower() not in NRRD_TYPES:
        raise ValueError(f"NRRD type {fields.get('type')} is not known")
    order = ">" if fields.get("endian", "little") == "big" else "<"
    if fields["encoding"] in ("gzip", "gz"):
        body = gzip.decompress(body)
    elif fields["encoding"] != "raw":
        raise ValueError(f"NRRD encoding {fields['encoding']} is not read")
    sizes = list(map(int, fields["sizes"].split()))
    a = np.frombuffer(body, order + NRRD_TYPES[fields["type"].lower()], int(np.prod(sizes))).reshape(sizes[::-1])
    spacing = (1.0, 1.0, 1.0)
    if "space directions" in fields:
        found = [np.linalg.norm(list(map(float, m.split(",")))) for m in re.findall(r"\(([^)]*)\)", fields["space directions"])]
        spacing = tuple(map(float, found[-3:])) if len(found) >= 3 else spacing
    elif "spacings" in fields:
        spacing = tuple(map(float, fields["spacings"].split()[-3:]))
    return Volume(a, spacing, fields | keys)


def encode_nrrd(volume: Volume, compress: bool = True) -> bytes:
    a = volume.data
    kind = NRRD_NAMES[a.dtype.str[1:]]
    x, y, z = volume.spacing
    keys = "".join(f"{k}:={v}\n" for k, v in volume.header.items() if "_" in k or k[:1].isupper())
    head = f"NRRD0004\ntype: {kind}\ndimension: 3\nspace: left-posterior-superior\nsizes: {' '.join(map(str, a.shape[::-1]))}\nspace directions: ({x:g},0,0) (0,{y:g},0) (0,0,{z:g})\nkinds: domain domain domain\nendian: little\nencoding: {'gzip' if compress else 'raw'}\nspace origin: (0,0,0)\n{keys}\n"
    raw = a.astype(a.dtype.newbyteorder("<")).tobytes()
    return head.encode() + (gzip.compress(raw, mtime=0) if compress else raw)


def decode_mha(data: bytes) -> Volume:
    """MetaImage with its data in the same file."""
    mark = re.search(rb"ElementDataFile\s*=\s*LOCAL\s*\n", data)
    if not mark:
        raise ValueError("not a MetaImage with local data")
    fields = dict(re.split(r"\s*=\s*", x, maxsplit=1) for x in data[: mark.start()].decode("latin-1").strip().splitlines() if "=" in x)
    size = list(map(int, fields["DimSize"].split()))
    body = data[mark.end() :]
    if fields.get("CompressedData", "False") == "True":
        body = zlib.decompress(body)
    if fields["ElementType"] not in META_TYPES:
        raise ValueError(f"MetaImage type {fields['ElementType']} is not known")
    order = ">" if "True" in (fields.get("BinaryDataByteOrderMSB"), fields.get("ElementByteOrderMSB")) else "<"
    a = np.frombuffer(body, order + META_TYPES[fields["ElementType"]], int(np.prod(size))).reshape(size[::-1])
    spacing = tuple(map(float, fields.get("ElementSpacing", "1 1 1").split()))
    return Volume(a, spacing, fields)


def encode_mha(volume: Volume, compress: bool = True) -> bytes:
    a = volume.data
    kind = {v: k for k, v in META_TYPES.items()}[a.dtype.str[1:]]
    raw = a.astype(a.dtype.newbyteorder("<")).tobytes()
    body = zlib.compress(raw) if compress else raw
    sizes = " ".join(map(str, a.shape[::-1]))
    head = f"ObjectType = Image\nNDims = 3\nBinaryData = True\nBinaryDataByteOrderMSB = False\nCompressedData = {compress}\n" + (f"CompressedDataSize = {len(body)}\n" if compress else "")
    return f"{head}ElementSpacing = {' '.join(f'{s:g}' for s in volume.spacing)}\nDimSize = {sizes}\nElementType = {kind}\nElementDataFile = LOCAL\n".encode() + body


def decode_nifti(data: bytes) -> Volume:
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(order + "i", data)[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(order + "8h", data, 40)
    code = struct.unpack_from(order + "h", data, 70)[0]
    pix = struct.unpack_from(order + "8f", data, 76)
    offset, slope, inter = struct.unpack_from(order + "3f", data, 108)
    if code not in NIFTI_TYPES:
        raise ValueError(f"NIfTI type {code} is not read")
    shape = dim[1 : dim[0] + 1][::-1]
    a = np.frombuffer(data, order + NIFTI_TYPES[code], int(np.prod(shape)), int(offset)).reshape(shape)
    if slope not in (0.0, 1.0) or inter:
        a = a * (slope or 1.0) + inter
    return Volume(a, tuple(map(float, pix[1:4])), {"datatype": str(code)})


def encode_nifti(volume: Volume, compress: bool = True) -> bytes:
    a = volume.data
    code = {v: k for k, v in NIFTI_TYPES.items()}[a.dtype.str[1:]]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *a.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, a.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *volume.spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    raw = bytes(head) + a.astype(a.dtype.newbyteorder("<")).tobytes()
    return gzip.compress(raw, mtime=0) if compress else raw


def decode_mrc(data: bytes) -> Volume:
    """Flipped on the y axis, as its rows run upwards."""
    nx, ny, nz, mode = struct.unpack_from("<4i", data)
    if mode not in MRC_TYPES or min(nx, ny, nz) <= 0:
        raise ValueError("not an MRC file of a known mode")
    extra = struct.unpack_from("<i", data, 92)[0]
    cell = struct.unpack_from("<3f", data, 40)
    a = np.frombuffer(data, "<" + MRC_TYPES[mode], nx * ny * nz, 1024 + extra).reshape(nz, ny, nx)[:, ::-1]
    return Volume(a, tuple(c / n if c else 1.0 for c, n in zip(cell, (nx, ny, nz))), {"mode": str(mode)})


def encode_mrc(volume: Volume) -> bytes:
    a = volume.data
    mode = {v: k for k, v in MRC_TYPES.items()}[a.dtype.str[1:]]
    nz, ny, nx = a.shape
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, nx, ny, nz, mode)
    struct.pack_into("<3i", head, 28, nx, ny, nz)
    struct.pack_into("<3f", head, 40, *(s * n for s, n in zip(volume.spacing, (nx, ny, nz))))
    struct.pack_into("<3f", head, 52, 90, 90, 90)
    struct.pack_into("<3i", head, 64, 1, 2, 3)
    head[208:216] = b"MAP \x44\x44\0\0"
    return bytes(head) + a[:, ::-1].astype(a.dtype.newbyteorder("<")).tobytes()


# TIFF ---------------------------------------------------------------------------------------------

_TIFF_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_TIFF_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def tiff_pages(data: bytes) -> list[dict[int, tuple]]:
    """The tags of every page, classic or BigTIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    magic = struct.unpack_from((order or "<") + "H", data, 2)[0]
    if not order or magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    pages = []
    while at:
        n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        tags = {}
        for i in range(n):
            p = at + i * (20 if big else 12)
            tag, kind = struct.unpack_from(order + "2H", data, p)
            count = struct.unpack_from(order + ("Q" if big else "I"), data, p + 4)[0]
            where = p + (12 if big else 8)
            size = _TIFF_SIZE.get(kind, 1) * count
            if size > (8 if big else 4):
                where = struct.unpack_from(order + ("Q" if big else "I"), data, where)[0]
            if kind in _TIFF_CODE:
                tags[tag] = struct.unpack_from(f"{order}{count}{_TIFF_CODE[kind]}", data, where)
        tags[0] = (order,)
        pages.append(tags)
        at = struct.unpack_from(order + ("Q" if big else "I"), data, at + n * (20 if big else 12))[0]
    return pages


def tiff_info(data: bytes) -> tuple[tuple[int, int, int], str]:
    """(z, y, x) and type from the tags alone."""
    pages = tiff_pages(data)
    return (len(pages), pages[0][257][0], pages[0][256][0]), _tiff_type(pages[0])


def _tiff_type(tags: dict) -> str:
    return {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]] + str(tags.get(258, (1,))[0] // 8)


def decode_tiff_page(data: bytes, tags: dict) -> np.ndarray:
    h, w, samples = tags[257][0], tags[256][0], tags.get(277, (1,))[0]
    packing = tags.get(259, (1,))[0]
    if tags.get(258, (1,))[0] % 8 or 322 in tags:
        raise ValueError("only strips of whole bytes are read")
    raw = b"".join(_tiff_strip(data[o : o + n], packing) for o, n in zip(tags[273], tags[279]))
    kind = np.dtype(tags[0][0] + _tiff_type(tags))
    a = np.frombuffer(raw, kind, h * w * samples).reshape((h, w, samples) if samples > 1 else (h, w))
    if tags.get(317, (1,))[0] == 2:
        a = np.cumsum(a, axis=1, dtype=kind)
    return a


def _tiff_strip(raw: bytes, packing: int) -> bytes:
    if packing == 1:
        return raw
    if packing in (8, 32946):
        return zlib.decompress(raw)
    if packing == 32773:
        out, at = bytearray(), 0
        while at < len(raw):
            n = raw[at] - 256 if raw[at] > 127 else raw[at]
            if n >= 0:
                out += raw[at + 1 : at + 2 + n]
                at += 2 + n
            else:
                if n != -128:
                    out += raw[at + 1 : at + 2] * (1 - n)
                at += 2 if n != -128 else 1
        return bytes(out)
    raise ValueError(f"TIFF compression {packing} is not read")


def decode_tiff(data: bytes, low: int = 0, high: int | None = None) -> Volume:
    """Pages [low, high) stacked; other pages are not touched."""
    pages = tiff_pages(data)[low:high]
    return Volume(np.stack([decode_tiff_page(data, p) for p in pages]))


def encode_tiff(volume: Volume, compress: bool = True) -> bytes:
    """One strip a page; BigTIFF beyond two thousand megabytes."""
    a = volume.data
    big = int(a.nbytes * 10e-7) > 2000
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    out = bytearray(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0) if big else b"II" + struct.pack("<HI", 42, 0))
    link = len(out) - (8 if big else 4)
    for page in a:
        raw = page.astype(page.dtype.newbyteorder("<")).tobytes()
        raw = zlib.compress(raw) if compress else raw
        start = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        tags = [(256, page.shape[1]), (257, page.shape[0]), (258, a.dtype.itemsize * 8), (259, 8 if compress else 1), (262, 1), (273, start), (277, 1), (278, page.shape[0]), (279, len(raw)), (339, kind)]
        struct.pack_into("<Q" if big else "<I", out, link, len(out))
        out += struct.pack("<Q" if big else "<H", len(tags))
        for tag, value in tags:
            out += struct.pack("<HHQQ" if big else "<HHII", tag, 16 if big else 4, 1, value)
        link = len(out)
        out += b"\0" * (8 if big else 4)
    return bytes(out)


# Zarr, NPY, STL, PNG --------------------------------------------------------------------------------


def zarr_meta(shape: tuple[int, ...], chunks: tuple[int, ...], dtype: str, level: int = 5) -> bytes:
    return json.dumps({"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "compressor": {"id": "zlib", "level": level}, "fill_value": 0, "order": "C", "filters": None}).encode()


def encode_zarr(volume: Volume, chunks: tuple[int, int, int] = (100, 100, 100), level: int = 5) -> dict[str, bytes]:
    """Names and bytes of a version 2 array; edge chunks are padded with zeros."""
    a = volume.data.astype(volume.data.dtype.newbyteorder("<"))
    out = {".zarray": zarr_meta(a.shape, chunks, a.dtype.str, level)}
    for i in range(0, a.shape[0], chunks[0]):
        for j in range(0, a.shape[1], chunks[1]):
            for k in range(0, a.shape[2], chunks[2]):
                part = a[i : i + chunks[0], j : j + chunks[1], k : k + chunks[2]]
                whole = np.zeros(chunks, a.dtype)
                whole[tuple(map(slice, part.shape))] = part
                out[f"{i // chunks[0]}.{j // chunks[1]}.{k // chunks[2]}"] = zlib.compress(whole.tobytes(), level)
    return out


def decode_zarr_chunk(meta: dict, name: str, raw: bytes) -> tuple[tuple[int, ...], np.ndarray]:
    """(corner, array) of one chunk, cut at the edge of the volume."""
    packer = (meta.get("compressor") or {}).get("id")
    if packer not in (None, "zlib", "gzip") or meta.get("filters") or meta["order"] != "C":
        raise ValueError("only raw, zlib and gzip chunks in C order are read")
    raw = zlib.decompress(raw, 47) if packer else raw
    sep = "/" if meta.get("dimension_separator") == "/" else "."
    corner = tuple(int(i) * c for i, c in zip(name.split(sep), meta["chunks"]))
    a = np.frombuffer(raw, meta["dtype"]).reshape(meta["chunks"])
    return corner, a[tuple(slice(0, n - o) for n, o in zip(meta["shape"], corner))]


def decode_npy(data: bytes) -> Volume:
    import io

    return Volume(np.load(io.BytesIO(data), allow_pickle=False))


def encode_npy(volume: Volume) -> bytes:
    import io

    out = io.BytesIO()
    np.save(out, volume.data, allow_pickle=False)
    return out.getvalue()


def encode_stl(triangles: np.ndarray, attributes: np.ndarray | None = None) -> bytes:
    """Binary STL of (n, 3, 3) corner points in x, y, z; attributes are the two bytes of each triangle."""
    t = np.asarray(triangles, "<f4").reshape(-1, 3, 3)
    normal = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    length = np.linalg.norm(normal, axis=1, keepdims=True)
    rows = np.zeros(len(t), np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")]))
    rows["n"], rows["p"] = np.divide(normal, length, out=np.zeros_like(normal), where=length > 0), t
    if attributes is not None:
        rows["a"] = attributes
    return b"stratavox".ljust(80, b"\0") + struct.pack("<I", len(t)) + rows.tobytes()


def decode_stl(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", data, 80)[0]
    rows = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")]), n, 84)
    return rows["p"].copy(), rows["a"].copy()


def encode_png(pixels: np.ndarray) -> bytes:
    """8-bit grey (h, w) or colour (h, w, 3)."""
    h, w = pixels.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """8- or 16-bit PNG without interlace; alpha is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, colour, _, _, interlace = head
    planes = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if planes is None or depth not in (8, 16) or interlace:
        raise ValueError("this kind of PNG is not read")
    step = planes * depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * step + 1)
    out = np.zeros((h, w * step), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(w * step, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            left = np.zeros(step, np.int64)
            corner = np.zeros(step, np.int64)
            for x in range(0, w * step, step):
                u = up[x : x + step]
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + u) // 2
                else:
                    p = left + u - corner
                    pa, pb, pc = np.abs(p - left), np.abs(p - u), np.abs(p - corner)
                    guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, u, corner))
                left = (line[x : x + step] + guess) & 255
                corner = u
                out[y, x : x + step] = left
    a = out.reshape(h, w, planes, depth // 8)
    a = a[..., 0].astype(np.uint16) << 8 | a[..., 1] if depth == 16 else a[..., 0]
    return a[..., 0] if planes <= 2 else a[..., :3]


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (grey palette) or 24-bit BMP."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start = struct.unpack_from("<I", data, 10)[0]
    w, h, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or depth not in (8, 24):
        raise ValueError("this kind of BMP is not read")
    step = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, step * abs(h), start).reshape(abs(h), step)[:, : w * depth // 8]
    rows = rows[::-1] if h > 0 else rows
    return rows.copy() if depth == 8 else rows.reshape(abs(h), w, 3)[:, :, ::-1].copy()


# pairs of a header and a body ------------------------------------------------------------------


def encode_mhd(volume: Volume, body_name: str, compress: bool = False) -> tuple[bytes, bytes]:
    """MetaImage as a header that names its body, and the body."""
    head, mark, body = encode_mha(volume, compress).partition(b"ElementDataFile = LOCAL\n")
    return head + b"ElementDataFile = " + body_name.encode() + b"\n", body


def decode_mhd(head: bytes, body: bytes) -> Volume:
    return decode_mha(re.sub(rb"ElementDataFile\s*=.*", b"ElementDataFile = LOCAL", head).rstrip(b"\n") + b"\n" + body)


def encode_nifti_pair(volume: Volume) -> tuple[bytes, bytes]:
    """NIfTI-1 as .hdr and .img."""
    raw = encode_nifti(volume, False)
    head = bytearray(raw[:348])
    struct.pack_into("<f", head, 108, 0.0)
    head[344:348] = b"ni1\0"
    return bytes(head), raw[352:]


def decode_nifti_pair(head: bytes, body: bytes) -> Volume:
    order = "<" if struct.unpack_from("<i", head)[0] == 348 else ">"
    offset = int(struct.unpack_from(order + "f", head, 108)[0])
    whole = bytearray(head[:348]) + b"\0" * 4
    struct.pack_into(order + "f", whole, 108, 352.0)
    return decode_nifti(bytes(whole) + body[offset:])


#: Endings of headers whose body is another file of the same name, the body's endings and what reads both.
PAIRS = {".mhd": ((".raw", ".zraw"), decode_mhd), ".hdr": ((".img",), decode_nifti_pair)}
BODIES = tuple(x for names, _ in PAIRS.values() for x in names)

# NetCDF classic ------------------------------------------------------------------------------------

#: External types of the classic formats, big-endian.
NETCDF_TYPES = {1: ">i1", 2: ">S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
NETCDF_DIMENSIONS, NETCDF_VARIABLES, NETCDF_ATTRIBUTES = 10, 11, 12


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 4)


def encode_netcdf(volume: Volume, name: str = "data") -> bytes:
    """NetCDF classic with 64-bit offsets: one variable over z, y, x; unsigned bytes are marked ``_Unsigned``."""
    a = volume.data
    unsigned = a.dtype == np.uint8
    kinds = {np.dtype(t): k for k, t in NETCDF_TYPES.items()}
    kind = 1 if unsigned else kinds.get(a.dtype.newbyteorder(">"))
    if kind is None:
        raise ValueError(f"NetCDF classic has no type for {a.dtype}")
    raw = _padded(a.tobytes() if unsigned else a.astype(NETCDF_TYPES[kind]).tobytes())
    text = lambda s: struct.pack(">i", len(s)) + _padded(s.encode())
    head = b"CDF\x02" + struct.pack(">3i", 0, NETCDF_DIMENSIONS, 3) + b"".join(text(c) + struct.pack(">i", n) for c, n in zip("zyx", a.shape))
    head += struct.pack(">2i", 0, 0) + struct.pack(">2i", NETCDF_VARIABLES, 1) + text(name) + struct.pack(">4i", 3, 0, 1, 2)
    notes = [("spacing", 6, struct.pack(">3d", *volume.spacing), 3)] + ([("_Unsigned", 2, b"true", 4)] if unsigned else [])
    head += struct.pack(">2i", NETCDF_ATTRIBUTES, len(notes)) + b"".join(text(k) + struct.pack(">2i", t, n) + _padded(v) for k, t, v, n in notes)
    return head + struct.pack(">2iq", kind, min(len(raw), (1 << 31) - 4), len(head) + 16) + raw


def decode_netcdf(data: bytes) -> Volume:
    """The first variable of three axes of a classic file (versions 1 and 2) without record axes."""
    if data[:3] != b"CDF" or data[3:4] not in (b"\x01", b"\x02"):
        raise ValueError("not a NetCDF classic file")
    at = 8
    wide = data[3] == 2

    def number(form: str = ">i") -> int:
        nonlocal at
        at += struct.calcsize(form)
        return struct.unpack_from(form, data, at - struct.calcsize(form))[0]

    def text() -> str:
        nonlocal at
        n = number()
        at += n + -n % 4
        return data[at - (n + -n % 4) :][:n].decode()

    def attributes() -> dict:
        nonlocal at
        number()
        out = {}
        for _ in range(number()):
            key, kind, n = text(), number(), number()
            size = np.dtype(NETCDF_TYPES[kind]).itemsize * n
            out[key] = data[at : at + n].decode() if kind == 2 else np.frombuffer(data, NETCDF_TYPES[kind], n, at).tolist()
            at += size + -size % 4
        return out

    number()
    sizes = [(text(), number())[1] for _ in range(number())]
    attributes()
    number()
    for _ in range(number()):
        name, axes = text(), [number() for _ in range(number())]
        notes, kind, _, begin = attributes(), number(), number(), number(">q" if wide else ">i")
        shape = [sizes[k] for k in axes]
        if len(shape) == 3 and all(shape) and kind in NETCDF_TYPES:
            a = np.frombuffer(data, NETCDF_TYPES[kind], int(np.prod(shape)), begin).reshape(shape)
            a = a.view(np.uint8) if notes.get("_Unsigned") == "true" and kind == 1 else a
            return Volume(a, tuple(notes.get("spacing", (1.0, 1.0, 1.0))), {"name": name})
    raise ValueError("no variable of three fixed axes in the NetCDF file")


#: What reads a whole file of each kind.
DECODERS = {".am": lambda d: decode_amira(d)[0], ".nrrd": decode_nrrd, ".mha": decode_mha, ".nii": decode_nifti, ".nii.gz": decode_nifti, ".tif": decode_tiff, ".tiff": decode_tiff, ".mrc": decode_mrc, ".npy": decode_npy, ".nc": decode_netcdf}
ENCODERS = {".am": encode_amira, ".nrrd": encode_nrrd, ".mha": encode_mha, ".nii": lambda v: encode_nifti(v, False), ".nii.gz": encode_nifti, ".tif": encode_tiff, ".tiff": encode_tiff, ".mrc": encode_mrc, ".npy": encode_npy, ".nc": encode_netcdf}
IMAGES = {".png": decode_png, ".bmp": decode_bmp, ".tif": lambda d: decode_tiff(d, 0, 1).data[0], ".tiff": lambda d: decode_tiff(d, 0, 1).data[0]}


def suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return ".nii.gz" if name.endswith(".nii.gz") else name[name.rfind(".") :] if "." in name else ""


def decode(path: str, data: bytes) -> Volume:
    """By the name's ending; ``.bz2`` and ``.gz`` are unpacked first."""
    name = path
    if name.lower().endswith(".bz2"):
        import bz2

        name, data = name[:-4], bz2.decompress(data)
    elif name.lower().endswith(".gz") and suffix(name) != ".nii.gz":
        name, data = name[:-3], gzip.decompress(data)
    if suffix(name) not in DECODERS:
        raise ValueError(f"no reader for {path}")
    return DECODERS[suffix(name)](data)
