"""Well-known binary of shapes: dicts of a type and parts of points, as Arrow hands them over."""

from __future__ import annotations

import struct

from geoflow.functions import planar


def _points(line) -> bytes:
    return struct.pack("<I", len(line)) + b"".join(struct.pack("<2d", x, y) for x, y in line)


def encode(shape) -> bytes | None:
    if shape is None or shape["parts"] is None or not len(shape["parts"]):
        return None
    parts = [[(p["x"], p["y"]) for p in part] for part in shape["parts"]]
    one = lambda kind, body: b"\x01" + struct.pack("<I", kind) + body
    if shape["type"] == "point":
        each = [one(1, struct.pack("<2d", *p[0])) for p in parts]
    elif shape["type"] == "polyline":
        each = [one(2, _points(p)) for p in parts]
    else:
        polygons: list[list] = []
        for ring in parts:
            if not polygons or planar.signed_area(ring) >= 0:
                polygons.append([])
            polygons[-1].append(ring)
        each = [one(3, struct.pack("<I", len(p)) + b"".join(map(_points, p))) for p in polygons]
    if len(each) == 1:
        return each[0]
    return one({"point": 4, "polyline": 5, "polygon": 6}[shape["type"]], struct.pack("<I", len(each)) + b"".join(each))


def decode(data) -> dict | None:
    """Points, lines, polygons and collections of one of them; further dimensions are left out."""
    if data is None:
        return None
    data, at = bytes(data), 0

    def take(form: str):
        nonlocal at
        out = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return out

    def shape() -> tuple[str, list]:
        order = "<" if take("<B")[0] else ">"
        kind = take(order + "I")[0]
        if kind & 0x20000000:
            take(order + "I")
        size = 2 + (kind & 0x80000000 > 0) + (kind & 0x40000000 > 0)
        kind &= 0xFFFFFF
        size = max(size, {0: 2, 1: 3, 2: 3, 3: 4}[kind // 1000])
        kind %= 1000
        point = lambda: take(f"{order}{size}d")[:2]
        line = lambda: [point() for _ in range(take(order + "I")[0])]
        if kind == 1:
            p = point()
            return "point", [] if p[0] != p[0] else [[p]]
        if kind == 2:
            return "polyline", [line()]
        if kind == 3:
            rings = [line() for _ in range(take(order + "I")[0])]
            return "polygon", [r if (planar.signed_area(r) >= 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)]
        found = [shape() for _ in range(take(order + "I")[0])]
        name = {4: "point", 5: "polyline", 6: "polygon"}.get(kind) or (found[0][0] if found else "point")
        return name, [p for k, parts in found if k == name for p in parts]

    name, parts = shape()
    return {"type": name, "parts": [[{"x": x, "y": y} for x, y in part] for part in parts]} if parts else None
