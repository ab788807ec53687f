"""Delimited text, JSON, newline-delimited JSON, GeoJSON and Parquet, read and written by Spark."""

from __future__ import annotations

import csv
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.functions.aggregates import FID
from geoflow.operators.geometry import GEOM
from geoflow.operators.rows import field

#: Fixed value: delimiters in the order in which a header line is searched for them.
DELIMITERS = ("|", "\t", ",", ";", " ")


def sniff(header: str) -> str:
    return next((d for d in DELIMITERS if d in header), ",")


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get a number."""
    out: list[str] = []
    for n in names:
        name, k = n, 2
        while name in out:
            name, k = f"{n}{k}", k + 1
        out.append(name)
    return out


#: Where a row stands: its file, the split's first byte, and its place in the partition; read() numbers rows by them.
PLACE = ("_file", "_block", "_pos")


def placed(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_pos", F.monotonically_increasing_id())


def in_order(df: DataFrame) -> DataFrame:
    """`__fid` from 0 without gaps in the order of the files' names and of the rows in each."""
    from geoflow.operators.rows import numbered

    return numbered(df, [F.col(c) for c in PLACE]).drop(*PLACE)


def read_delimited(spark: SparkSession, path: str, **options) -> DataFrame:
    """Text columns, and double where every value that isn't blank (or NA, NaN) is a number and one is there.

    Blanks are "" in text and null in numbers; short rows are padded with "".  Types take one pass over
    all rows.  where and fields act before it.  skip_lines lines are left out before the header (of one file).  Files
    are split unless a quoted value runs over a line's end.  A space as delimiter means columns of fixed width, which
    begin where the header's words do.
    """
    return _delimited(spark, path, **options).drop(*PLACE)


def _delimited(spark: SparkSession, path: str, *, delimiter: str | None = None, string_fields: list[str] = (), field_types: dict[str, str] | None = None, skip_lines: int = 0, lines: int | None = None, field_names: list[str] | None = None, decimal_comma: bool = False, encoding: str = "UTF-8", where: str | None = None, fields: list[str] | None = None) -> DataFrame:
    text = spark.read.option("encoding", encoding).text(path)
    first = text.limit(skip_lines + 1).collect()
    header = re.sub("^\ufeff", "", first[-1].value) if len(first) > skip_lines else ""
    sep = delimiter or sniff(header)
    if sep == " ":
        starts = [m.start() for m in re.finditer(r"\S+", header)]
        sampled = [r.value for r in text.limit(skip_lines + 1000).collect()][skip_lines + 1 :]
        starts = [c for k, c in enumerate(starts) if k == 0 or all(len(x) < c or x[c - 1] == " " for x in sampled)]
        names = [header[c:e].strip() for c, e in zip(starts, [*starts[1:], len(header)], strict=True)]
        df = placed(text).where((F.col("_block") > 0) | (F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)) > skip_lines))
        df = df.select(*(F.trim(F.substring("value", c + 1, e - c)).alias(n) for n, c, e in zip(unique_names(field_names or names), starts, [*starts[1:], 1 << 20], strict=True)), *PLACE)
    else:
        head = next(csv.reader([header], delimiter=sep, skipinitialspace=False), [])
        names = unique_names(field_names or head)
        types = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(head))])
        how = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\u0000", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        if skip_lines:
            rows = placed(text).where((F.col("_block") > 0) | (F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)) > skip_lines)).where(F.trim("value") != "")
            df = rows.select(F.from_csv("value", ", ".join(f"c{k} string" for k in range(len(head))), how).alias("r"), *PLACE).select("r.*", *PLACE)
        else:
            long_quotes = not text.where((F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()
            df = placed(spark.read.schema(types).options(**how).csv(path, header=True, multiLine=long_quotes, encoding=encoding, enforceSchema=True)) if head else spark.createDataFrame([], "_file string, _block long, _pos long")
        df = df.toDF(*names, *PLACE) if len(names) == len(head) else df.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names[: len(head)])), *PLACE)
    names = [c for c in df.columns if c not in PLACE]
    df = df.select(*(F.coalesce(field(c), F.lit("")).alias(c) for c in names), *PLACE)
    if fields:
        df = df.select(*map(field, fields), *PLACE)
    if where:
        from geoflow.operators.rows import condition

        df = df.where(condition(df, where))
    if lines is not None:
        df = df.orderBy(*PLACE).limit(lines)
    return infer_numbers(df, string_fields=string_fields, field_types=field_types, decimal_comma=decimal_comma)


def as_number(c: Column, decimal_comma: bool = False) -> Column:
    """A number from text with thousands separators; null if it isn't one."""
    text = F.trim(c)
    if decimal_comma:
        text = F.replace(F.regexp_replace(text, r"^([+-]?\d{1,3})(\.\d{3})+(?=,|$)", F.regexp_replace(F.regexp_extract(text, r"^([+-]?\d{1,3}(?:\.\d{3})+)", 1), r"\.", "")), F.lit(","), F.lit("."))
    else:
        text = F.when(F.regexp_like(text, F.lit(r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$")), F.replace(text, F.lit(","), F.lit(""))).otherwise(text)
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.when(F.regexp_like(text, F.lit(number)), text.try_cast("double"))


def infer_numbers(df: DataFrame, *, string_fields: list[str] = (), field_types: dict[str, str] | None = None, decimal_comma: bool = False) -> DataFrame:
    types = dict(field_types or {}) | dict.fromkeys(PLACE, "str")
    if string_fields == ["*"]:
        return df
    types |= dict.fromkeys(string_fields, "str")
    open_ = [c for c in df.columns if c not in types]
    blank = lambda c: F.trim(field(c)).isin("", "NA", "NaN")
    if open_:
        got = df.agg(*(F.struct(F.bool_and(blank(c) | as_number(field(c), decimal_comma).isNotNull()).alias("all"), F.bool_or(~blank(c) & as_number(field(c), decimal_comma).isNotNull()).alias("any")).alias(f"_{k}") for k, c in enumerate(open_))).first()
        types |= {c: "num" for k, c in enumerate(open_) if got[f"_{k}"]["all"] and got[f"_{k}"]["any"]}
    return df.select(*(as_number(field(c), decimal_comma).alias(c) if types.get(c, "str").startswith("num") else field(c) for c in df.columns))


def read_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """An array of records, or a record on each line; json_path (a.b[0] or a/b[0]) picks a part first."""
    return _json(spark, path, **options).drop(*PLACE)


def _json(spark: SparkSession, path: str, *, lines: bool = False, json_path: str | None = None) -> DataFrame:
    df = placed(spark.read.json(path, multiLine=not lines))
    names = [c for c in df.columns if c not in PLACE]
    if lines and "type" in names and len(df.schema) > 4 and {"geometry", "properties"} & set(names) and not df.where("type = 'Feature'").isEmpty() and not df.where("type is null or type != 'Feature'").isEmpty():
        raise ValueError("features and plain records in one file")
    if json_path:
        steps = re.findall(r"[^./\[\]]+", json_path)
        c = F.col("`" + steps[0] + "`")
        for step in steps[1:]:
            c = F.get(c, F.lit(int(step))) if step.isdigit() else c[step]
        df = df.select(F.col("_file"), F.col("_block"), F.col("_pos"), c.alias("c"))
        if isinstance(df.schema["c"].dataType, T.ArrayType):
            df = df.select("_file", F.lit(0).cast("long").alias("_block"), F.posexplode("c").alias("_pos", "c"))
        df = df.select("c.*", *PLACE)
    return df



def read_geojson(spark: SparkSession, path: str, *, lines: bool = False, id_field: str | None = None) -> DataFrame:
    """Features with their properties as columns, geom, and `__fid` in the order of the file.

    Properties get their types from all features.  The shape is read from its JSON text by its own type.
    """
    if lines:
        one = in_order(placed(spark.read.text(path)).where(F.trim("value") != "")).select(F.regexp_replace("value", r"^[\x1e\s]+|[,\s]+$", "").alias("feature"), FID)
    else:
        whole = spark.read.text(path, wholetext=True)
        listed = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
        single = F.array(F.when(F.get_json_object("value", "$.type") == "Feature", F.col("value")).otherwise(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.col("value"), F.lit("}"))))
        each = F.when(F.get_json_object("value", "$.type") == "FeatureCollection", listed).otherwise(single)
        one = whole.select(F.posexplode(each).alias(FID, "feature")).withColumn(FID, F.col(FID).cast("long"))
    return features_from(one, id_field=id_field)


def features_from(one: DataFrame, *, id_field: str | None = None) -> DataFrame:
    """Fields and shapes from `feature`, the JSON text of one each; a collection of shapes of one type is one shape."""
    spark = one.sparkSession
    one = one.select(FID, F.get_json_object("feature", "$.properties").alias("p"), F.get_json_object("feature", "$.geometry").alias("g"), F.get_json_object("feature", "$.id").alias("i"))
    schema = _schema_of(spark, one.select("p").where("p is not null"))
    props = F.from_json("p", schema) if len(schema) else None
    cols = [props[f.name].alias(f.name) for f in schema] if props is not None else []
    if id_field:
        cols.append(F.col("i").alias(id_field))
    return one.select(FID, *cols, geometry_from_json(F.col("g")).alias("geom"))


def _schema_of(spark: SparkSession, texts: DataFrame) -> T.StructType:
    """The schema of JSON texts: written once as lines and read by Spark's own reader."""
    from geoflow.shared import shared_dir

    path = shared_dir(spark, "json")
    texts.select(F.regexp_replace("p", r"[\r\n]+", " ").alias("value")).write.text(path)
    return spark.read.json(path).schema


def read_wkb(df: DataFrame, name: str = "geometry") -> DataFrame:
    """geom from a column of well-known binary."""
    from geoflow.functions import wkb
    from geoflow.operators.overlay import PARTS, udf1

    kind = udf1(lambda data: (wkb.decode(data) or {"type": None})["type"], "string")
    parts = udf1(lambda data: (wkb.decode(data) or {"parts": None})["parts"], PARTS)
    return df.withColumn("geom", F.when(field(name).isNotNull(), F.struct(kind(field(name)).alias("type"), parts(field(name)).alias("parts"))).cast(GEOM)).withColumn("geom", F.when(F.col("geom.parts").isNotNull(), F.col("geom"))).drop(name)


def geometry_from_json(g: Column) -> Column:
    kind, coords = F.get_json_object(g, "$.type"), F.get_json_object(g, "$.coordinates")
    as_points = lambda line: F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    read = lambda depth: F.from_json(coords, "array<" * depth + "double" + ">" * depth)
    one = lambda c: F.array(c)
    parts = (
        F.when(kind == "Point", one(as_points(one(read(1)))))
        .when(kind == "MultiPoint", F.transform(read(2), lambda p: as_points(F.array(p))))
        .when(kind == "LineString", one(as_points(read(2))))
        .when(kind.isin("MultiLineString", "Polygon"), F.transform(read(3), as_points))
        .when(kind == "MultiPolygon", F.flatten(F.transform(read(4), lambda poly: F.transform(poly, as_points))))
    )
    name = F.when(F.contains(kind, F.lit("Point")), "point").when(F.contains(kind, F.lit("Line")), "polyline").otherwise("polygon")
    shaped = F.struct(name.alias("type"), F.when(name == "polygon", oriented(parts)).otherwise(parts).alias("parts"))
    return F.when(F.size(parts) > 0, shaped).cast(GEOM)


def oriented(parts: Column) -> Column:
    """The first ring clockwise, and the others turned with it."""
    from geoflow.operators.geometry import ring_area

    return F.when(ring_area(parts[0]) < 0, F.transform(parts, F.reverse)).otherwise(parts)


def geometry_to_json(geom: Column) -> Column:
    from geoflow.operators.geometry import ring_area

    pairs = lambda part: F.transform(part, lambda p: F.array(p["x"], p["y"]))
    text = lambda kind, c: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(c), F.lit("}"))
    parts = geom["parts"]
    outer = F.filter(F.transform(parts, lambda p, i: F.when((ring_area(p) >= 0) | (i == 0), i).otherwise(-1)), lambda i: i >= 0)
    until = F.concat(F.slice(outer, F.lit(2), F.greatest(F.size(outer), F.lit(1))), F.array(F.size(parts)))
    polygons = F.transform(F.zip_with(outer, until, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: F.transform(F.slice(parts, r["a"] + 1, r["b"] - r["a"]), pairs))
    lines = F.transform(parts, pairs)
    return (
        F.when((geom["type"] == "point") & (F.size(parts) == 1), text("Point", F.get(F.get(lines, F.lit(0)), F.lit(0))))
        .when(geom["type"] == "point", text("MultiPoint", F.transform(lines, lambda x: F.get(x, F.lit(0)))))
        .when((geom["type"] == "polyline") & (F.size(parts) == 1), text("LineString", F.get(lines, F.lit(0))))
        .when(geom["type"] == "polyline", text("MultiLineString", lines))
        .when(F.size(polygons) == 1, text("Polygon", F.get(polygons, F.lit(0))))
        .when(geom["type"] == "polygon", text("MultiPolygon", polygons))
        .otherwise(F.lit("null"))
    )


def features(df: DataFrame, *, id_field: str | None = None) -> DataFrame:
    """One GeoJSON feature text in each row, in `value`; id_field's value becomes the feature's id."""
    own_id = F.concat(F.lit('"id":'), F.get_json_object(F.to_json(F.struct(field(id_field).alias("i")), {"ignoreNullFields": "false"}), "$.i"), F.lit(",")) if id_field and not isinstance(df.schema[id_field].dataType, T.StringType) else F.concat(F.lit('"id":'), F.substring(F.to_json(F.struct(field(id_field).alias("i"))), 6, 1 << 20), F.lit(",")) if id_field else F.lit("")
    own_id = F.regexp_replace(own_id, r"\},$", ",")
    names = [c for c in df.columns if c not in (FID, "geom")]
    props = F.to_json(F.struct(*map(field, names)), {"ignoreNullFields": "false"}) if names else F.lit("null")
    shape = geometry_to_json(F.col("geom")) if "geom" in df.columns else F.lit("null")
    return df.select(F.concat(F.lit('{"type":"Feature",'), own_id, F.lit('"geometry":'), F.coalesce(shape, F.lit("null")), F.lit(',"properties":'), props, F.lit("}")).alias("value"), *([FID] if FID in df.columns else []))


def single_file(lines: DataFrame, path: str, head: str = "", tail: str = "", between: str = "\n") -> None:
    """One file from the column `value` in the order of `__fid`: parts are written by the executors, then put end to end by the file system."""
    from geoflow.shared import shared_dir

    spark = lines.sparkSession
    first = lines.agg(F.min(FID)).first()[0]
    parts = shared_dir(spark, "parts")
    ordered = lines.repartitionByRange(FID).sortWithinPartitions(FID)
    ordered.select(F.when(F.col(FID) == first, F.col("value")).otherwise(F.concat(F.lit(between), F.col("value"))).alias("value")).write.option("lineSep", "\u0000").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    out = target.getFileSystem(conf).create(target, True)
    out.write(bytearray(head.encode()))
    files = folder.getFileSystem(conf)
    names = sorted(f.getPath().toString() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for name in names:
        source = files.open(jvm.org.apache.hadoop.fs.Path(name))
        while True:
            chunk = source.readNBytes(1 << 20)
            if not len(chunk):
                break
            out.write(bytearray(bytes(chunk).replace(b"\0", b"")))
        source.close()
    out.write(bytearray(tail.encode()))
    out.close()
    files.delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write(df: DataFrame, path: str, format: str | None = None, *, precision: float | None = None, drop_table: bool = False, cut_table: bool = False, id_field: str | None = None, field_order: str | None = None, single: bool = False, delimiter: str | None = None, **options) -> None:
    """csv, tsv, json (one record a line), geojson, kml, dbf, shapefile, geoparquet or parquet.

    geojson (one feature a line), json, csv and parquet are folders of part files, in row order within each; single makes
    one file of a geojson FeatureCollection, a json array or a csv table.  kml, dbf and shapefile are always one file.
    precision rounds coordinates; drop_table leaves the fields out; cut_table writes them to a json folder beside;
    field_order=ascending sorts the fields.
    """
    from geoflow.operators import geometry

    kind = format or (re.search(r"\.(\w+)$", path) or [None, "parquet"])[1]
    if precision and "geom" in df.columns:
        df = df.withColumn("geom", geometry.round_points(F.col("geom"), precision))
    names = [c for c in df.columns if c not in (FID, "geom")]
    if field_order == "ascending":
        df = df.select(*(map(field, sorted(names, key=str.lower))), *(c for c in (FID, "geom") if c in df.columns))
    if cut_table:
        df.drop("geom", FID).write.mode("overwrite").option("ignoreNullFields", "false").json(re.sub(r"\.\w+$", "", path) + "-table.json")
    if cut_table or drop_table:
        df = df.drop(*names)
    plain = df.drop(FID)
    if single and FID not in df.columns:
        raise ValueError("a single file needs the rows' order")
    if kind in ("csv", "tsv", "dsv", "txt"):
        sep = delimiter or ("\t" if kind == "tsv" else ",")
        flat = plain.drop("geom")
        flat = flat.select(*(F.to_json(field(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else field(f.name) for f in flat.schema))
        if single:
            said = lambda x: '"' + x.replace('"', '""') + '"' if re.search(f'[{re.escape(sep)}"\n]', x) else x
            row = F.to_csv(F.struct(*(field(c) for c in flat.columns)), {"sep": sep, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""})
            both = df.withColumns({f.name: F.to_json(field(f.name)) for f in df.schema if f.name not in (FID, "geom") and isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}) if flat.columns else df
            single_file(both.select(row.alias("value"), FID), path, sep.join(map(said, flat.columns)) + "\n")
        else:
            flat.write.mode("overwrite").csv(path, sep=sep, header=True, quote='"', escape='"', emptyValue="", **options)
    elif kind == "geojson":
        each = features(df, id_field=id_field)
        if single:
            single_file(each, path, '{"type":"FeatureCollection","features":[\n', "\n]}", ",\n")
        else:
            each.select("value").write.mode("overwrite").text(path)
    elif kind in ("json", "ndjson"):
        if single:
            row = F.to_json(F.struct(*(field(c) for c in df.columns if c not in (FID, "geom"))), {"ignoreNullFields": "false"})
            single_file(df.select(row.alias("value"), FID), path, "[" if kind == "json" else "", "]" if kind == "json" else "\n", ",\n" if kind == "json" else "\n")
        else:
            plain.drop("geom").write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif kind == "kml":
        from geoflow.sources import kml

        kml.write_kml(df, path)
    elif kind in ("dbf", "shapefile", "shp"):
        from geoflow.sources import binary

        binary.write_shapefile(df, path) if kind != "dbf" else binary.write_dbf(df, path)
    elif kind == "geoparquet":
        from geoflow.functions import wkb
        from geoflow.operators.overlay import of_shapes

        coded = plain.withColumn("geometry", of_shapes(wkb.encode, "binary")(F.col("geom"))).drop("geom") if "geom" in plain.columns else plain
        coded.write.mode("overwrite").parquet(path, compression=options.pop("compression", "zstd"))
    elif kind == "parquet":
        plain.write.mode("overwrite").parquet(path, compression=options.pop("compression", "zstd"))
    else:
        raise ValueError(f"unknown format {kind}")


def sniffed(spark: SparkSession, path: str) -> str:
    """A kind of file from its first line, where its name tells nothing."""
    first = spark.read.text(path).limit(1).collect()
    text = first[0].value.lstrip("\ufeff \t") if first else ""
    if text.startswith(("{", "[")):
        return "geojson" if re.search(r'"type"\s*:\s*"(Feature|FeatureCollection|Point|Multi\w+|LineString|Polygon|GeometryCollection)"', text) else "topojson" if re.search(r'"type"\s*:\s*"Topology"', text) else "json"
    return "kml" if text.startswith("<") else "csv"


def read(spark: SparkSession, path: str, *, key: str | None = None, **options) -> DataFrame:
    """By extension, else by content, with `__fid` from 0 in file order.  Options that the reader of a kind doesn't have are errors."""
    name = re.sub(r"\.gz$", "", path.rstrip("/").lower())
    kind = (re.search(r"\.(\w+)$", name) or [None, ""])[1]
    if kind in ("", "dat", "data"):
        kind = "parquet" if not kind and exists(spark, path + "/_SUCCESS") else sniffed(spark, path)
    from geoflow.operators.rows import with_fid
    from geoflow.sources import binary, kml

    if kind == "json" and options.get("json_path") is None and sniffed(spark, path) != "json":
        kind = sniffed(spark, path)
    own = {"geojson": read_geojson, "dbf": binary.read_dbf, "shp": binary.read_shapefile, "topojson": binary.read_topojson, "kml": kml.read_kml}
    try:
        if kind in own:
            return own[kind](spark, path, **options)
        if kind in ("csv", "tsv", "txt", "dsv"):
            df = _delimited(spark, path, **options)
        elif kind in ("json", "ndjson"):
            df = _json(spark, path, **{"lines": kind == "ndjson", **options})
        else:
            df = _parquet(spark, path, **options)
    except TypeError as e:
        raise ValueError(f"{kind} files don't take these options: {', '.join(options)}") from e
    return with_fid(df.drop(*PLACE), key) if key else in_order(df)


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    df = placed(spark.read.parquet(path))
    return read_wkb(df) if "geometry" in df.columns and isinstance(df.schema["geometry"].dataType, T.BinaryType) and "geom" not in df.columns else df


def inline(spark: SparkSession, text: str, **options) -> DataFrame:
    """A table from JSON or delimited text given as it is."""
    if text.lstrip().startswith(("{", "[")):
        records = json.loads(text)
        if isinstance(records, dict) and records.get("type") in ("FeatureCollection", "Feature") or isinstance(records, dict) and "coordinates" in records:
            rows = [json.dumps(f) for f in records.get("features", [records if records.get("type") == "Feature" else {"type": "Feature", "properties": {}, "geometry": records}])]
            return features_from(spark.createDataFrame([(k, t) for k, t in enumerate(rows)], f"{FID} long, feature string"))
        records = records if isinstance(records, list) else [records]
        names = list(dict.fromkeys(k for r in records for k in r))
        schema = spark.range(1).select(F.schema_of_json(F.lit(json.dumps(records)))).first()[0]
        one = spark.createDataFrame([(json.dumps(records),)], "value string").select(F.posexplode(F.from_json("value", schema)).alias(FID, "r"))
        return one.select(F.col(FID).cast("long").alias(FID), *(F.col("r")[n].cast("double").alias(n) if one.schema["r"].dataType[n].dataType.typeName() == "long" else F.col("r")[n].alias(n) for n in names))
    rows = list(csv.reader(text.replace("\\n", "\n").strip("\n").split("\n"), delimiter=sniff(text.split("\n")[0])))
    names = unique_names(rows[0])
    df = spark.createDataFrame([(k, *[*r, *[""] * len(names)][: len(names)]) for k, r in enumerate(rows[1:])], T.StructType([T.StructField(FID, T.LongType()), *(T.StructField(n, T.StringType()) for n in names)]))
    return infer_numbers(df, string_fields=[*options.get("string_fields", []), FID]).select(F.col(FID).cast("long").alias(FID), *map(field, names))
