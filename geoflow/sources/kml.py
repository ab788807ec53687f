"""KML placemarks, read by Spark as whole files and written as one."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.functions import planar
from geoflow.functions.aggregates import FID
from geoflow.operators.geometry import GEOM
from geoflow.operators.rows import field


def placemarks(text: str):
    """(fields, shape) of each placemark: its name, description and data, and the shapes of its first type."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    points = lambda e: [tuple(map(float, c.split(",")[:2])) for c in (e.text or "").split()]
    for mark in (e for e in ET.fromstring(text.encode()).iter() if tag(e) == "Placemark"):
        fields, shapes = {}, []
        for e in mark.iter():
            if tag(e) in ("name", "description"):
                fields[tag(e)] = e.text or ""
            elif tag(e) == "Data":
                fields[e.get("name")] = next((v.text or "" for v in e if tag(v) == "value"), "")
            elif tag(e) == "SimpleData":
                fields[e.get("name")] = e.text or ""
            elif tag(e) in ("Point", "LineString"):
                shapes.append(("point" if tag(e) == "Point" else "polyline", [points(c) for c in e.iter() if tag(c) == "coordinates"]))
            elif tag(e) == "Polygon":
                rings = [points(c) for side in ("outerBoundaryIs", "innerBoundaryIs") for b in e if tag(b) == side for c in b.iter() if tag(c) == "coordinates"]
                shapes.append(("polygon", [r if (planar.signed_area(r) >= 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)]))
        kind = shapes[0][0] if shapes else None
        parts = [[{"x": x, "y": y} for x, y in p] for k, ps in shapes if k == kind for p in ps]
        yield json.dumps(fields), {"type": kind, "parts": parts} if parts else None


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with their data as text fields.  A file is one task's work."""
    from geoflow.sources.files import _schema_of

    def run(batches):
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame([(k, *row) for k, row in enumerate(placemarks(text))], columns=[FID, "p", "geom"], dtype=object)

    raw = spark.read.text(path, wholetext=True).mapInPandas(run, f"{FID} long, p string, geom {GEOM}")
    schema = _schema_of(spark, raw.select("p"))
    props = F.from_json("p", schema)
    return raw.select(FID, *(props[f.name].cast("string").alias(f.name) for f in schema), "geom")


def write_kml(df: DataFrame, path: str) -> None:
    from geoflow.sources.files import single_file

    def escaped(c):
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    names = [c for c in df.columns if c not in (FID, "geom")]
    data = F.concat(F.lit(""), *(F.concat(F.lit(f'<Data name="{n}"><value>'), escaped(F.coalesce(field(n).cast("string"), F.lit(""))), F.lit("</value></Data>")) for n in names))
    at = lambda part: F.array_join(F.transform(part, lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))), " ")
    coords = lambda part: F.concat(F.lit("<coordinates>"), at(part), F.lit("</coordinates>"))
    from geoflow.operators.geometry import ring_area

    parts = F.col("geom.parts")
    ring = lambda p, i: F.when((ring_area(p) >= 0) | (i == 0), F.concat(F.when(i > 0, "</Polygon>").otherwise(""), F.lit("<Polygon><outerBoundaryIs><LinearRing>"), coords(p), F.lit("</LinearRing></outerBoundaryIs>"))).otherwise(F.concat(F.lit("<innerBoundaryIs><LinearRing>"), coords(p), F.lit("</LinearRing></innerBoundaryIs>")))
    polygons = F.concat(F.array_join(F.transform(parts, ring), ""), F.lit("</Polygon>"))
    single = lambda name: F.array_join(F.transform(parts, lambda p: F.concat(F.lit(f"<{name}>"), coords(p), F.lit(f"</{name}>"))), "")
    body = F.when(F.col("geom.type") == "point", single("Point")).when(F.col("geom.type") == "polyline", single("LineString")).when(F.col("geom").isNotNull(), polygons).otherwise("") if "geom" in df.columns else F.lit("")
    row = F.concat(F.lit("<Placemark><ExtendedData>"), data, F.lit("</ExtendedData><MultiGeometry>"), body, F.lit("</MultiGeometry></Placemark>"))
    single_file(df.select(row.alias("value"), FID), path, '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>\n', "\n</Document></kml>")
