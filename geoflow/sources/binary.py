"""DBF tables and shapefiles, read by Spark as binary files and decoded on the executors."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.functions.aggregates import FID
from geoflow.operators.geometry import GEOM

#: A DBF field's type letter and the column type that holds it.
DBF_TYPES = {"C": T.StringType(), "N": T.DoubleType(), "F": T.DoubleType(), "I": T.IntegerType(), "L": T.BooleanType(), "D": T.DateType()}
#: Shape type numbers (with z and m kinds) by geometry.
SHAPES = {1: "point", 11: "point", 21: "point", 8: "multipoint", 18: "multipoint", 28: "multipoint", 3: "polyline", 13: "polyline", 23: "polyline", 5: "polygon", 15: "polygon", 25: "polygon"}


def dbf_fields(data: bytes) -> tuple[list[tuple[str, str, int]], int, int, int]:
    """((name, letter, size) of each field, records, header size, record size)."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(data[at + 11]), data[at + 16]))
        at += 32
    return fields, n, head, size


def dbf_rows(data: bytes, encoding: str = "utf-8") -> Iterator[tuple]:
    """(place in the file, values) of each record that isn't deleted; blanks are null except in text."""
    fields, n, head, size = dbf_fields(data)
    for k in range(n):
        at = head + k * size
        if data[at : at + 1] == b"*":
            continue
        at, row = at + 1, []
        for _, letter, width in fields:
            raw = data[at : at + width]
            at += width
            text = raw.decode(encoding, "replace").rstrip(" \0")
            if letter in "NF":
                try:
                    row.append(float(text.strip().replace(",", ".")))
                except ValueError:
                    row.append(None)
            elif letter == "I":
                row.append(struct.unpack("<i", raw)[0])
            elif letter == "L":
                row.append({"t": True, "y": True, "f": False, "n": False}.get(text.strip().lower()))
            elif letter == "D":
                row.append(datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if text.strip().isdigit() else None)
            else:
                row.append(text)
        yield k, tuple(row)


def shp_shapes(data: bytes) -> Iterator[tuple[str, list] | None]:
    """(kind, parts) of each record; None for null shapes."""
    at = 100
    while at + 8 <= len(data):
        words = struct.unpack_from(">i", data, at + 4)[0]
        kind = SHAPES.get(struct.unpack_from("<i", data, at + 8)[0])
        body = at + 12
        if kind == "point":
            yield "point", [[struct.unpack_from("<2d", data, body)]]
        elif kind == "multipoint":
            n = struct.unpack_from("<i", data, body + 32)[0]
            yield "point", [[struct.unpack_from("<2d", data, body + 36 + 16 * k)] for k in range(n)]
        elif kind:
            parts, n = struct.unpack_from("<2i", data, body + 32)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 40), n]
            first = body + 40 + 4 * parts
            yield kind, [[struct.unpack_from("<2d", data, first + 16 * k) for k in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            yield None
        at += 8 + 2 * words


def read_dbf(spark: SparkSession, path: str, *, encoding: str | None = None, keep_places: bool = False) -> DataFrame:
    """The records of one DBF file, numbered in file order (keep_places: by their places, deleted ones counted).  One file is one task's work, as its records have no index."""
    encoding = encoding or _code_page(spark, path)
    files = spark.read.format("binaryFile").load(path).select("content")
    head = files.select(F.substring("content", 1, 8192).alias("head")).first().head
    fields = dbf_fields(bytes(head))[0]
    schema = T.StructType([T.StructField(FID, T.LongType()), *(T.StructField(n, DBF_TYPES.get(t, T.StringType())) for n, t, _ in fields)])

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = dbf_rows(bytes(content), encoding)
                yield pd.DataFrame([(place if keep_places else k, *r) for k, (place, r) in enumerate(rows)], columns=schema.names, dtype=object)

    return files.mapInPandas(run, schema)


def _beside(spark: SparkSession, path: str, ending: str) -> str | None:
    """The text of a small file beside one, if it is there."""
    from geoflow.sources.files import exists

    name = path.rsplit(".", 1)[0] + ending
    return spark.read.text(name, wholetext=True).first()[0] if exists(spark, name) else None


def _code_page(spark: SparkSession, path: str) -> str:
    """The encoding that a .cpg file beside tells, else UTF-8."""
    import codecs

    told = (_beside(spark, path, ".cpg") or "utf-8").strip()
    told = f"cp{told}" if told.isdigit() else told
    try:
        return codecs.lookup(told).name
    except LookupError:
        return "utf-8"


def read_shapefile(spark: SparkSession, path: str, *, encoding: str | None = None) -> DataFrame:
    """Shapes with the records of the .dbf file beside them, if there is one; a shape whose record is deleted goes with it."""
    shp = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for k, s in enumerate(shp_shapes(bytes(content))):
                    rows.append((k, s and {"type": s[0], "parts": [[{"x": x, "y": y} for x, y in p] for p in s[1]]}))
                yield pd.DataFrame(rows, columns=[FID, "geom"], dtype=object)

    shapes = shp.mapInPandas(run, f"{FID} long, geom {GEOM}")
    table = path.removesuffix(".shp") + ".dbf"
    files = spark._jvm.org.apache.hadoop.fs.Path(table)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        from geoflow.operators.rows import with_fid

        both = read_dbf(spark, table, encoding=encoding, keep_places=True).withColumnRenamed(FID, "_place").join(shapes.withColumnRenamed(FID, "_place"), "_place", "left")
        return with_fid(both, "_place").drop("_place")
    return shapes


def _ordered(df: DataFrame) -> Iterator:
    """The rows in order, a partition at a time, for formats that are one file with a header of its own."""
    return df.orderBy(FID).toLocalIterator(prefetchPartitions=True)


def _save(spark: SparkSession, path: str, chunks) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    for chunk in chunks:
        out.write(bytearray(chunk))
    out.close()


def write_dbf(df: DataFrame, path: str) -> None:
    """Numbers as N or F, text as C of the longest value's bytes (254 at most), booleans as L, dates as D."""
    from geoflow.operators.rows import field

    names = [c for c in df.columns if c not in (FID, "geom")]
    kinds = {f.name: f.dataType for f in df.schema}
    texts = [n for n in names if not isinstance(kinds[n], (T.NumericType, T.BooleanType, T.DateType))]
    sizes = df.agg(F.count(F.lit(1)).alias("_n"), *(F.max(F.octet_length(field(n).cast("string"))).alias(f"_{k}") for k, n in enumerate(texts))).first()
    spec = []
    for n in names:
        kind = kinds[n]
        if isinstance(kind, (T.IntegralType,)):
            spec.append((n, "N", 20, 0))
        elif isinstance(kind, T.NumericType):
            spec.append((n, "N", 24, 15))
        elif isinstance(kind, T.BooleanType):
            spec.append((n, "L", 1, 0))
        elif isinstance(kind, T.DateType):
            spec.append((n, "D", 8, 0))
        else:
            spec.append((n, "C", max(1, min(254, sizes[f"_{texts.index(n)}"] or 1)), 0))
    used: list[str] = []
    for n, *_ in spec:
        name, k = n.encode()[:10].decode("utf-8", "ignore"), 2
        while name in used:
            name, k = f"{n[: 10 - len(str(k))]}{k}", k + 1
        used.append(name)

    def cell(v, letter: str, size: int) -> bytes:
        if letter == "L":
            return b" " if v is None else b"T" if v else b"F"
        if letter == "D":
            return b" " * 8 if v is None else v.strftime("%Y%m%d").encode()
        if letter == "N":
            if v is None or v != v:
                return b" " * size
            shown = str(int(v)) if float(v).is_integer() and abs(v) < 1e18 else repr(float(v))
            return shown[:size].rjust(size).encode()
        text = ("" if v is None else str(v)).encode()[:size]
        return text.decode("utf-8", "ignore").encode().ljust(size)

    def chunks():
        yield struct.pack("<4BIHH20x", 3, 95, 7, 26, sizes["_n"], 33 + 32 * len(spec), 1 + sum(x[2] for x in spec))
        for name, (_, letter, size, digits) in zip(used, spec, strict=True):
            yield struct.pack("<11sc4xBB14x", name.encode(), letter.encode(), size, digits)
        yield b"\r"
        for r in _ordered(df.select(FID, *map(field, names))):
            yield b" " + b"".join(cell(r[k + 1], letter, size) for k, (_, letter, size, _) in enumerate(spec))
        yield b"\x1a"

    _save(df.sparkSession, path, chunks())
    _save(df.sparkSession, path.rsplit(".", 1)[0] + ".cpg", [b"UTF-8"])


def shp_record(shape) -> bytes:
    if shape is None or shape["parts"] is None or not len(shape["parts"]):
        return struct.pack("<i", 0)
    parts = [[(p["x"], p["y"]) for p in part] for part in shape["parts"]]
    every = [p for part in parts for p in part]
    xs, ys = [x for x, _ in every], [y for _, y in every]
    box = struct.pack("<4d", min(xs), min(ys), max(xs), max(ys))
    body = b"".join(struct.pack("<2d", *p) for p in every)
    if shape["type"] == "point":
        return struct.pack("<i", 1) + body if len(every) == 1 else struct.pack("<i", 8) + box + struct.pack("<i", len(every)) + body
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
    return struct.pack("<i", 3 if shape["type"] == "polyline" else 5) + box + struct.pack(f"<2i{len(parts)}i", len(parts), len(every), *starts) + body


def write_shapefile(df: DataFrame, path: str) -> None:
    """A .shp file with its .shx index and .dbf table; shapes are made by the executors and pass through the driver in order.  A layer holds one type of shape; points are multipoints if one is."""
    from geoflow.operators.overlay import of_shapes
    from geoflow.shared import discard, materialise

    base = path.rsplit(".", 1)[0]
    made = materialise(df.select(FID, of_shapes(shp_record, "binary")(F.col("geom")).alias("record")), "records")
    kinds = {int.from_bytes(r[0], "little") for r in made.select(F.substring("record", 1, 4)).distinct().collect()} - {0}
    if len(kinds - {1, 8}) > 1 or (kinds & {1, 8} and kinds - {1, 8}):
        raise ValueError("a shapefile holds shapes of one type")
    kind = 8 if kinds == {1, 8} else kinds.pop() if kinds else 0
    multi = kind == 8

    def fitted(record: bytes) -> bytes:
        if multi and record[:4] == struct.pack("<i", 1):
            x, y = struct.unpack_from("<2d", record, 4)
            return struct.pack("<i4di2d", 8, x, y, x, y, 1, x, y)
        return record

    total, n = 100, 0
    box = [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for r in made.select("record").toLocalIterator():
        record = fitted(bytes(r.record))
        total, n = total + 8 + len(record), n + 1
        if len(record) > 4:
            b = struct.unpack_from("<2d", record, 4) * 2 if record[0] == 1 else struct.unpack_from("<4d", record, 4)
            box = [min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])]
    if total >= 1 << 32:
        raise ValueError("a shapefile holds 4 GB at most")
    box = box if n and box[0] <= box[2] else [0.0] * 4
    head = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)

    def shapes():
        yield head(total)
        for k, r in enumerate(_ordered(made)):
            record = fitted(bytes(r.record))
            yield struct.pack(">2i", k + 1, len(record) // 2) + record

    def index():
        yield head(100 + 8 * n)
        at = 100
        for r in _ordered(made.select(FID, "record")):
            size = len(fitted(bytes(r.record)))
            yield struct.pack(">2i", at // 2, size // 2)
            at += 8 + size

    _save(df.sparkSession, base + ".shp", shapes())
    _save(df.sparkSession, base + ".shx", index())
    discard(made)
    names = [c for c in df.columns if c not in (FID, "geom")]
    write_dbf(df.drop("geom") if names else df.select(FID, F.col(FID).alias("FID")), base + ".dbf")


def read_topojson(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """One object of a TopoJSON file: arcs are summed up from their differences and joined end to end.  A file is one task's work, as its objects share their arcs."""
    import json

    def decode(text: str):
        topo = json.loads(text)
        scale, move = (topo.get("transform") or {}).get("scale"), (topo.get("transform") or {}).get("translate")
        arcs = []
        for arc in topo.get("arcs", []):
            x = y = 0
            line = []
            for p in arc:
                if scale:
                    x, y = x + p[0], y + p[1]
                    line.append((x * scale[0] + move[0], y * scale[1] + move[1]))
                else:
                    line.append((float(p[0]), float(p[1])))
            arcs.append(line)

        def path_of(ids):
            out: list = []
            for i in ids:
                line = arcs[i] if i >= 0 else arcs[~i][::-1]
                out += line[1:] if out else line
            return out

        at = lambda p: (p[0] * scale[0] + move[0], p[1] * scale[1] + move[1]) if scale else tuple(map(float, p[:2]))
        name = layer or next(iter(topo["objects"]))
        top = topo["objects"][name]
        for k, geo in enumerate(top["geometries"] if top.get("type") == "GeometryCollection" else [top]):
            t = geo.get("type")
            parts = {"Point": lambda c=geo: [[at(c["coordinates"])]], "MultiPoint": lambda c=geo: [[at(p)] for p in c["coordinates"]], "LineString": lambda c=geo: [path_of(c["arcs"])], "MultiLineString": lambda c=geo: [path_of(a) for a in c["arcs"]], "Polygon": lambda c=geo: [path_of(a) for a in c["arcs"]], "MultiPolygon": lambda c=geo: [path_of(a) for poly in c["arcs"] for a in poly]}.get(t, lambda: [])()
            kind = "point" if t and "Point" in t else "polyline" if t and "Line" in t else "polygon"
            yield k, json.dumps(geo.get("properties") or {}), {"type": kind, "parts": [[{"x": x, "y": y} for x, y in p] for p in parts]} if parts else None

    def run(batches):
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(list(decode(text)), columns=[FID, "p", "geom"], dtype=object)

    raw = spark.read.text(path, wholetext=True).mapInPandas(run, f"{FID} long, p string, geom {GEOM}")
    from geoflow.sources.files import _schema_of

    schema = _schema_of(spark, raw.select("p"))
    props = F.from_json("p", schema)
    return raw.select(FID, *(props[f.name].alias(f.name) for f in schema), "geom")
