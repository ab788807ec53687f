"""A session: named layers, and pipelines of commands over them.

run("-each 'b = a * 2' -filter 'b > 2' -dissolve g calc='n = count()'") builds one lazy plan; only
commands that need a value on the driver (calc, if, class breaks, boxes) run jobs.
"""

from __future__ import annotations

import fnmatch
import importlib
import os
import re
import shlex
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.functions.aggregates import FID
from geoflow.functions.expressions import Parser
from geoflow.operators import classes, geometry, groups, joins, overlay, rows, shapes
from geoflow.sources import files

#: Other names of commands.
ALIASES = {"filter-islands2": "filter-islands", "grid2": "grid", "f": "filter"}
#: The options that reach a reader, and how their text is taken.
READER_OPTIONS = {"csv-skip-lines": ("skip_lines", int), "csv-lines": ("lines", int), "csv-field-names": ("field_names", "list"), "csv-filter": ("where", str), "csv-fields": ("fields", "list"), "string-fields": ("string_fields", "list"), "field-types": ("field_types", "types"),
                  "encoding": ("encoding", str), "delimiter": ("delimiter", str), "csv-delimiter": ("delimiter", str), "json-path": ("json_path", str), "id-field": ("id_field", str), "key": ("key", str)}
READER_FLAGS = {"decimal-comma": ("decimal_comma", True), "ndjson": ("lines", True)}
#: What each command takes besides its expression: options, and words.
COMMANDS = {
    "each": ("where ids", ""), "filter": ("ids bbox", "invert remove-empty"), "filter-geom": ("bbox", ""), "filter-fields": ("fields", "invert"), "rename-fields": ("fields", ""), "drop": ("fields", "geometry holes"),
    "sort": ("", "ascending descending"), "uniq": ("max-count", "invert index verbose"), "split": ("", ""), "split-on-grid": ("cols rows id-field", ""), "calc": ("where", ""), "info": ("", ""), "inspect": ("", ""),
    "dissolve": ("fields calc sum-fields copy-fields where weight", "multipart group-points planar"), "dissolve2": ("fields calc sum-fields copy-fields where", ""),
    "join": ("source keys fields calc sum-fields where prefix cell max-distance interpolate min-overlap-pct min-overlap-area", "force duplication unmatched unjoined largest-overlap point-method"),
    "fuzzy-join": ("field fields cell", ""), "data-fill": ("field", ""),
    "classify": ("field method breaks classes values colors categories null-value other save-as outer-breaks index-field", "invert continuous quantile equal-interval hybrid nice indexed categorical non-adjacent"),
    "points": ("x y interval", "centroid inner vertices vertices2 endpoints midpoints interpolated"), "lines": ("groupby", ""), "innerlines": ("", ""), "polygons": ("", ""), "explode": ("", ""), "rectangles": ("", ""),
    "rectangle": ("bbox offset aspect-ratio", ""), "grid": ("type interval bbox", ""), "point-grid": ("interval bbox cols rows", ""), "graticule": ("interval", ""), "point-to-grid": ("bbox interval radius calc", ""), "dots": ("fields per-dot seed save-as", ""),
    "clip": ("source bbox", ""), "erase": ("source bbox", ""), "slice": ("source id-field", ""), "inlay": ("source", ""), "divide": ("source fields calc", ""), "mosaic": ("calc", ""), "union": ("fields", ""),
    "clean": ("overlap-rule gap-area", ""), "snap": ("interval", ""), "buffer": ("radius vertices", ""), "subdivide": ("", ""),
    "simplify": ("percentage interval weighting", "dp visvalingam weighted planar keep-shapes"), "smooth": ("distance", ""), "densify": ("interval", ""), "dashlines": ("dash-length gap-length", ""),
    "filter-slivers": ("min-area sliver-control", "remove-empty"), "filter-islands": ("min-area min-vertices", "remove-empty"), "check-geometry": ("cell", ""), "affine": ("shift scale rotate anchor where", ""),
    "proj": ("", "inverse"), "rotate": ("lat roll", "invert"),
}
PLUGINS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, command: Callable[..., DataFrame]) -> None:
    """Adds a command: a function of (layer, *words, **options)."""
    PLUGINS[name] = command


def tokenise(line: str) -> list[tuple[str, list[str], dict[str, str]]]:
    """(command, words, options) of each command; # starts a comment, a backslash at a line's end goes on."""
    line = re.sub(r"\\\n", " ", line)
    line = "\n".join(re.sub(r"^\s*#.*$", "", x) for x in line.split("\n"))
    out: list[tuple[str, list[str], dict[str, str]]] = []
    for word in shlex.split(line):
        if re.match(r"-[a-z]", word):
            out.append((ALIASES.get(word[1:], word[1:]), [], {}))
        elif not out:
            out.append(("i", [word], {}))
        elif m := re.match(r"([a-z][a-z0-9-]*)=(?!=)(.*)$", word, re.S):
            if out[-1][0] in ("each", "calc", "define", "filter", "filter-fields", "rename-fields", "rename-layers", "subdivide", "inspect", "run") and not out[-1][1] and m[1] not in OPTIONS:
                out[-1][1].append(word)
            else:
                out[-1][2][m[1]] = m[2]
        else:
            out[-1][1].append(word)
    return out


OPTIONS = {"where", "name", "target", "fields", "calc", "keys", "ids", "sum-fields", "copy-fields", "prefix", "save-as", "method", "breaks", "classes", "values", "categories", "null-value", "other", "max-count", "format", "source", "cell", "interval", "bbox", "weight"}


def listed(text: str | None) -> list[str]:
    return [x.strip() for x in text.split(",")] if text else []


class Session:
    def __init__(self, spark: SparkSession, layers: dict[str, DataFrame] | None = None):
        self.spark, self.layers, self.targets = spark, dict(layers or {}), list(layers or {})[-1:]
        self.defs: dict[str, Any] = {}
        self.vars: dict[str, str] = {}
        self.stopped = False
        self.written: set[str] = set()

    def run(self, line: str) -> DataFrame | None:
        """Runs a command line; the first target layer afterwards."""
        branch: list[list[bool]] = []  # of each open if: (this branch runs, some branch has run)
        for name, words, options in tokenise(line):
            fill = lambda s: re.sub(r"\{\{\s*([\w.]+)\s*\}\}", lambda m: os.environ.get(m[1][4:], "") if m[1].startswith("env.") else str(self.vars.get(m[1], self.defs.get(m[1], m[0]))), s)
            words, options = [fill(w) for w in words], {k: fill(v) for k, v in options.items()}
            if name == "if":
                on = all(b[0] for b in branch) and self.test(words[0])
                branch.append([on, on])
            elif name == "elif":
                on = not branch[-1][1] and self.test(words[0])
                branch[-1] = [on, branch[-1][1] or on]
            elif name == "else":
                branch[-1] = [not branch[-1][1], True]
            elif name == "endif":
                branch.pop()
            elif all(b[0] for b in branch) and not self.stopped:
                self.command(name, words, options)
        return self.layers.get(self.targets[0]) if self.targets else None

    def test(self, expression: str) -> bool:
        """layer_exists('x'), file_exists('x'), empty('x') or a comparison of constants and defs."""
        if m := re.fullmatch(r"\s*(!?)\s*file_exists\(\s*['\"](.+?)['\"]\s*\)\s*", expression):
            return files.exists(self.spark, m[2]) != bool(m[1])
        if m := re.fullmatch(r"\s*(!?)\s*layer_exists\(\s*['\"](.+?)['\"]\s*\)\s*", expression):
            return (m[2] in self.layers) != bool(m[1])
        if m := re.fullmatch(r"\s*(!?)\s*empty\(\s*['\"](.+?)['\"]\s*\)\s*", expression):
            return self.layers[m[2]].isEmpty() != bool(m[1])
        one = self.spark.range(1)
        return bool(one.select(rows.flag(one.drop("id"), expression, self.defs)).first()[0])

    def find(self, pattern: str) -> list[str]:
        names = list(self.layers)
        return [names[int(p) - 1] if p.isdigit() else n for p in listed(pattern) for n in (names if not p.isdigit() else [""]) if p.isdigit() or fnmatch.fnmatch(n, p)]

    def command(self, name: str, words: list[str], options: dict[str, str]) -> None:
        targets = self.find(options.pop("target")) if "target" in options else list(self.targets)
        keep, rename = "+" in words, options.pop("name", None)
        words = [w for w in words if w != "+"]
        if name == "i":
            self.read(words, options, rename)
        elif name == "target":
            self.targets = self.find(words[0])
        elif name in ("vars", "defaults"):
            for k, v in [*options.items(), *(w.split("=", 1) for w in words)]:
                self.vars.setdefault(k, v) if name == "defaults" else self.vars.__setitem__(k, v)
        elif name == "define":
            for node in Parser(words[0]).program():
                self.defs[node[1]] = rows.each(self.spark.range(1), words[0], defs=self.defs).first()[node[1]]
        elif name == "run":
            self.run(words[0] if words[0].lstrip().startswith("-") else self.text(words[0]))
        elif name == "include":
            for node in Parser(self.text(words[0])).program():
                self.defs[node[1]] = rows.each(self.spark.range(1), self.text(words[0]), defs=self.defs).first()[node[1]]
        elif name == "require":
            module = importlib.import_module(words[0])
            for command, function in getattr(module, "COMMANDS", {}).items():
                register(command, function)
            self.defs.update(getattr(module, "DEFS", {}))
        elif name == "stop":
            self.stopped = True
        elif name == "ignore":
            self.stopped = bool(targets) and self.layers[targets[0]].isEmpty()
        elif name in ("comment", "print", "quiet", "verbose", "debug"):
            if name == "print":
                print(*words)
        elif name == "rename-layers":
            for k, new in enumerate(x for w in words for x in listed(w)):
                old, new = new.split("=")[::-1] if "=" in new else (targets[k], new)
                self.layers = {new if n == old else n: df for n, df in self.layers.items()}
                self.targets = [new if n == old else n for n in self.targets]
        elif name == "merge-layers":
            out = rows.merge_layers([self.layers[t] for t in targets], force="force" in words)
            self.put(rename or targets[0], out, [] if keep else targets)
        elif name == "calc" and not keep:
            self.defs.update(groups.calc(self.layers[targets[0]], words[0], where=options.get("where"), defs=self.defs).first().asDict())
        elif name == "union":
            others = [self.layers[t] for t in targets]
            self.check(name, words, options)
            self.put(rename or targets[0], overlay.union(others, fields=listed(options["fields"]) if "fields" in options else None), [] if keep else targets)
        elif name in GENERATORS:
            self.check(name, words, options)
            around = self.layers[targets[0]] if targets else None
            self.put(rename or name, GENERATORS[name](self.spark, around, options, words), [])
        elif name == "o":
            self.write(words, options, targets)
        elif name == "drop" and not words and not options:
            for t in targets:
                del self.layers[t]
        else:
            for t in targets:
                out = self.apply(name, self.layers[t], t, words, options)
                self.put(rename or (f"{t}-{name}" if keep else t), out, [] if keep else [t])

    def text(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def read(self, words: list[str], options: dict[str, str], rename: str | None) -> None:
        """Each file is a layer of its own; merge-files makes one of all, combine-files targets all."""
        taken: dict[str, Any] = {}
        for k, v in options.items():
            if k not in READER_OPTIONS and k != "precision":
                raise ValueError(f"unknown option {k} of -i")
            if k != "precision":
                to, how = READER_OPTIONS[k]
                taken[to] = listed(v) if how == "list" else dict(x.split(":") for x in listed(v)) if how == "types" else how(v)
        flags = [w for w in words if w in READER_FLAGS or w in ("merge-files", "combine-files", "no-topology")]
        taken |= {READER_FLAGS[w][0]: READER_FLAGS[w][1] for w in flags if w in READER_FLAGS}
        found = {}
        for path in (w for w in words if w not in flags):
            if path.lstrip().startswith(("{", "[")) or "\n" in path or "\\n" in path:
                found[rename or "layer"] = files.inline(self.spark, path, **taken)
                continue
            base = re.sub(r"\.\w+$", "", re.sub(r"\.gz$", "", path.rstrip("/")).split("/")[-1])
            found[rename if rename and len(words) - len(flags) == 1 else base] = files.read(self.spark, path, **taken)
        if "precision" in options:
            found = {n: df.withColumn("geom", geometry.round_points(F.col("geom"), float(options["precision"]))) if "geom" in df.columns else df for n, df in found.items()}
        if "merge-files" in flags:
            found = {rename or "layer": rows.merge_layers(list(found.values()), force=True)}
        self.layers |= found
        self.targets = list(found) if "combine-files" in flags or "merge-files" in flags else list(found)[-1:]

    def write(self, words: list[str], options: dict[str, str], targets: list[str]) -> None:
        allowed = {"format", "precision", "delimiter", "id-field", "field-order", "bbox-index", "compression"}
        if bad := set(options) - allowed:
            raise ValueError(f"unknown options {', '.join(sorted(bad))} of -o")
        flags = {w for w in words if w in ("drop-table", "cut-table", "single", "force", "bbox-index")}
        places = [w for w in words if w not in flags]
        more = {"precision": float(options["precision"])} if "precision" in options else {}
        more |= {k.replace("-", "_"): options[k] for k in ("delimiter", "id-field", "field-order", "compression") if k in options}
        for t in targets:
            path = places[0] if places else t
            if len(targets) > 1 and places:
                path = f"{path.rstrip('/')}/{t}"
            if path in self.written and "force" not in flags:
                raise ValueError(f"{path} has been written in this session")
            self.written.add(path)
            files.write(self.layers[t], path, options.get("format"), drop_table="drop-table" in flags, cut_table="cut-table" in flags, single="single" in flags, **more)
            if "bbox-index" in flags:
                files.write(geometry.extent(self.layers[t]).withColumn("layer", F.lit(t)), re.sub(r"\.\w+$", "", path) + "-bbox.json", "json")

    def save(self, path: str) -> None:
        """All layers, as Parquet in a folder with a list of their names; load() brings them back."""
        for name, df in self.layers.items():
            df.write.mode("overwrite").parquet(f"{path}/layers/{name}")
        listing = [(n, n in self.targets) for n in self.layers]
        self.spark.createDataFrame(listing, "name string, target boolean").coalesce(1).write.mode("overwrite").json(f"{path}/names")

    def load(self, path: str) -> None:
        got = self.spark.read.schema("name string, target boolean").json(f"{path}/names").collect()
        self.layers |= {r.name: self.spark.read.parquet(f"{path}/layers/{r.name}") for r in got}
        self.targets = [r.name for r in got if r.target]

    def check(self, name: str, words: list[str], options: dict[str, str], free: int = 0) -> None:
        """Options that a command doesn't have, and more words than it takes, are errors."""
        if name not in COMMANDS:
            return
        allowed, flags = (x.split() for x in COMMANDS[name])
        if bad := set(options) - set(allowed):
            raise ValueError(f"-{name} has no option {', '.join(sorted(bad))}")
        rest = [w for w in words if w not in flags]
        if len(rest) > (free or 1):
            raise ValueError(f"-{name} doesn't know what to do with {' '.join(rest[1:])}")

    def source(self, name: str) -> DataFrame:
        """A layer by its name or number, or a file."""
        if name in self.layers:
            return self.layers[name]
        if name.isdigit() and 0 < int(name) <= len(self.layers):
            return list(self.layers.values())[int(name) - 1]
        return files.read(self.spark, name)

    def put(self, name: str, df: DataFrame, replaced: list[str]) -> None:
        for r in replaced:
            if r != name:
                self.layers.pop(r, None)
        self.layers[name] = df
        self.targets = [name]

    def apply(self, name: str, df: DataFrame, layer: str, words: list[str], o: dict[str, str]) -> DataFrame:
        self.check(name, words, o)
        known = set(COMMANDS.get(name, ("", ""))[1].split())
        flags, first = set(words), next((w for w in words if w not in known), None)
        ids = [int(x) for x in listed(o.get("ids"))] or None
        if name == "each":
            return rows.each(df, first, where=o.get("where"), ids=ids, defs=self.defs)
        if name == "filter":
            return rows.filter_rows(df, first, invert="invert" in flags, ids=ids, remove_empty="remove-empty" in flags, bbox=tuple(float(x) for x in listed(o["bbox"])) if "bbox" in o else None, defs=self.defs)
        if name == "filter-geom":
            return geometry.filter_geom(df, tuple(float(x) for x in listed(o["bbox"])))
        if name == "inspect":
            found = rows.filter_rows(df, first, defs=self.defs).limit(2).collect()
            print(f"{'no' if not found else 'more than one' if len(found) > 1 else 'one'} feature", *([found[0].asDict(True)] if len(found) == 1 else []))
            return df
        if name == "filter-fields":
            return rows.filter_fields(df, listed(o.get("fields") or first), invert="invert" in flags)
        if name == "rename-fields":
            return rows.rename_fields(df, listed(o.get("fields") or first))
        if name == "drop":
            return rows.drop(df, listed(o.get("fields")), geometry="geometry" in flags, holes="holes" in flags)
        if name == "sort":
            return rows.sort(df, first, descending="descending" in flags, defs=self.defs)
        if name == "uniq":
            return rows.uniq(df, first, max_count=int(o.get("max-count", 1)), invert="invert" in flags, index="index" in flags, defs=self.defs)
        if name == "split":
            return rows.split(df, first, name=layer, defs=self.defs)
        if name == "split-on-grid":
            cols, lines = (int(x) for x in listed(first)) if first else (int(o["cols"]), int(o["rows"]))
            return geometry.split_on_grid(df, cols, lines)
        if name == "calc":
            return groups.calc_layer(df, [first], layer_name=layer, defs=self.defs)
        if name in ("dissolve", "dissolve2"):
            return groups.dissolve(df, listed(o.get("fields") or first), calc=o.get("calc"), sum_fields=listed(o.get("sum-fields")), copy_fields=listed(o.get("copy-fields")), where=o.get("where"), weight=o.get("weight"), multipart=bool(flags & {"multipart", "group-points"}), overlapping=name == "dissolve2", defs=self.defs)
        if name == "join":
            return self.join(df, first or o.pop("source"), flags, o)
        if name == "classify":
            n = lambda k: [float(x) for x in listed(o[k])] if k in o else None
            method = o.get("method") or next((w for w in words if w in classes.METHODS), None)
            values = n("values") if "values" in o and all(re.fullmatch(r"-?[\d.]+", x) for x in listed(o["values"])) else listed(o.get("values") or o.get("colors")) or None
            return classes.classify(df, o.get("field") or o.get("index-field") or first, method=method or ("indexed" if "index-field" in o else None), outer_breaks=tuple(n("outer-breaks")) if "outer-breaks" in o else None, breaks=n("breaks"), classes=int(o["classes"]) if "classes" in o else None, values=values, categories=listed(o.get("categories")) or None, null_value=o.get("null-value"), other=o.get("other"), invert="invert" in flags, continuous="continuous" in flags, save_as=o.get("save-as", "class"))
        number = lambda k, default=None: float(o[k]) if k in o else default
        box = lambda k="bbox": tuple(float(x) for x in listed(o[k]))
        if name == "points" and "interpolated" in flags:
            dense = df.withColumn("geom", geometry.densify(F.col("geom"), number("interval")))
            return shapes.to_points(dense, "vertices")
        if name == "points" and flags & {"centroid", "inner", "vertices", "vertices2", "endpoints", "midpoints"}:
            return shapes.to_points(df, next(iter(flags & {"centroid", "inner", "vertices", "vertices2", "endpoints", "midpoints"})).rstrip("2"))
        if name == "lines":
            kind = df.where("geom is not null").select("geom.type").first()
            return shapes.points_to_line(df, listed(o.get("groupby"))) if kind and kind[0] == "point" else shapes.border_lines(df)
        if name in ("clip", "erase") and "bbox" in o:
            return shapes.clip_box(df, box(), erase=name == "erase")
        if name in ("clip", "erase", "slice", "inlay", "divide"):
            other = self.source(first or o["source"])
            if name in ("clip", "erase"):
                return overlay.clip(df, other, erase=name == "erase")
            if name == "slice":
                return overlay.slices(df, other, id_field=o.get("id-field"))
            if name == "inlay":
                return overlay.inlay(df, other)
            return overlay.divide(df, other, fields=listed(o["fields"]) if "fields" in o else None, calc=o.get("calc"))
        if name == "mosaic":
            return overlay.mosaic(df, calc=o.get("calc"))
        if name == "clean":
            return overlay.clean(df, overlap_rule=o.get("overlap-rule", "max-area"), gap_area=number("gap-area"))
        if name == "snap":
            return overlay.snap(df, number("interval"))
        if name == "polygons":
            return overlay.polygons_from_lines(df)
        if name == "dots":
            return shapes.dots(df, listed(o.get("fields") or first), per_dot=number("per-dot", 1.0), seed=int(number("seed", 1)), save_as=o.get("save-as", "field"))
        if name == "smooth":
            return shapes.smooth(df, float(o.get("distance") or first))
        if name == "rotate":
            turn = [float(x) for x in listed(first)]
            return shapes.rotate_sphere(df, *turn, invert="invert" in flags)
        if name == "subdivide":
            return shapes.subdivide(df, first, defs=self.defs)
        if name == "filter-slivers":
            return shapes.filter_slivers(df, number("min-area", 0.0), sliver_control=number("sliver-control", 0.0), remove_empty="remove-empty" in flags)
        if name == "filter-islands":
            return shapes.filter_islands(df, min_area=number("min-area"), min_vertices=number("min-vertices"), remove_empty="remove-empty" in flags)
        if name == "proj":
            return df.withColumn("geom", shapes.project(F.col("geom"), first, inverse="inverse" in flags))
        if name == "dashlines":
            return shapes.dashes(df, number("dash-length"), number("gap-length"))
        if name == "buffer":
            return overlay.buffer(df, float(o.get("radius") or first), vertices=int(number("vertices", 72)))
        if name == "data-fill":
            return shapes.data_fill(df, o.get("field") or first)
        if name == "check-geometry":
            return shapes.crossings(df, number("cell", 1.0))
        if name == "fuzzy-join":
            return shapes.fuzzy_join(df, self.source(first), o.get("field") or o["fields"], number("cell"))
        if name == "point-to-grid":
            return shapes.point_to_grid(df, box(), number("interval"), radius=number("radius"), calc=o.get("calc"))
        if name == "simplify":
            share = o.get("percentage") or first
            share = None if share is None else float(share.rstrip("%")) / 100 if share.endswith("%") else float(share)
            return shapes.simplify_shared(df, percentage=share, interval=number("interval"), method="dp" if "dp" in flags else "visvalingam" if "visvalingam" in flags else "weighted", weighting=number("weighting", 0.7), keep_shapes="keep-shapes" in flags)
        if name == "points":
            return geometry.points_from_xy(df, o.get("x"), o.get("y"))
        if name == "explode":
            return geometry.explode_parts(df)
        if name == "rectangles":
            return geometry.rectangles(df)
        if name == "innerlines":
            return geometry.inner_lines(df)
        if name == "affine":
            pair = lambda k: tuple(float(x) for x in listed(o[k]))
            return geometry.affine(df, shift=pair("shift") if "shift" in o else (0, 0), scale=float(o.get("scale", 1)), rotate=float(o.get("rotate", 0)), anchor=pair("anchor") if "anchor" in o else None, where=o.get("where"))
        if name == "densify":
            return df.withColumn("geom", geometry.densify(F.col("geom"), float(o["interval"])))
        if name == "info":
            return groups.info(df, layer_name=layer)
        if name in PLUGINS:
            return PLUGINS[name](df, *words, **o)
        raise ValueError(f"unknown command -{name}")

    def join(self, df: DataFrame, source: str, flags: set[str], o: dict[str, str]) -> DataFrame:
        other = self.source(source)
        options = {"fields": listed(o["fields"]) if "fields" in o else None, "calc": o.get("calc"), "sum_fields": listed(o.get("sum-fields")), "prefix": o.get("prefix", ""), "force": "force" in flags, "duplication": "duplication" in flags, "defs": self.defs}
        if "keys" in o:
            a, b = listed(o["keys"])
            for word, find in (("unmatched", joins.unmatched), ("unjoined", joins.unjoined)):
                if word in flags:
                    self.layers[word] = find(df, other, (a, b), where=o.get("where"), defs=self.defs)
            return joins.join(df, other, (a, b), where=o.get("where"), **options)
        if options["fields"] is None:
            options["fields"] = [] if options["calc"] or "interpolate" in o else [c for c in other.columns if c not in (FID, "geom")]
        elif options["fields"] == ["*"]:
            options["fields"] = [c for c in other.columns if c not in (FID, "geom")]
        kinds = [(df.where("geom is not null").select("geom.type").first() or ["point"])[0] for df in (df, other)]
        cell = float(o["cell"]) if "cell" in o else None
        if kinds == ["point", "point"]:
            return geometry.join_near_points(df, other, float(o.get("max-distance", 1e-3)), **options)
        if kinds == ["polygon", "polygon"] and "point-method" not in flags:
            least = lambda k: float(o[k].rstrip("%")) / (100 if o[k].endswith("%") else 1) if k in o else None
            return overlay.join_polygons(df, other, largest_overlap="largest-overlap" in flags, min_overlap_area=least("min-overlap-area"), min_overlap_pct=least("min-overlap-pct"), interpolate=listed(o.get("interpolate")), **options)
        if "point-method" in flags:
            return overlay.by_points(df, other, **options)
        if sorted(kinds) != ["point", "polygon"]:
            raise ValueError(f"can't join {kinds[1]} shapes to {kinds[0]} shapes")
        meet = geometry.join_points_to_polygons if kinds[0] == "polygon" else geometry.join_polygons_to_points
        return meet(df, other, cell, **options)


def _box(around: DataFrame | None, o: dict[str, str], default: tuple | None = None) -> tuple[float, float, float, float]:
    if "bbox" in o:
        return tuple(float(x) for x in listed(o["bbox"]))
    if around is not None and "geom" in around.columns:
        r = geometry.extent(around).first()
        return r.xmin, r.ymin, r.xmax, r.ymax
    if default is None:
        raise ValueError("a bbox or a layer with shapes is needed")
    return default


def _grid(spark, around, o, words):
    kind = o.get("type", "square")
    if kind not in ("square", "hex", "hex2"):
        raise ValueError(f"unknown type of grid {kind}")
    return (geometry.square_grid if kind == "square" else shapes.hex_grid)(spark, _box(around, o), float(o["interval"]))


def _point_grid(spark, around, o, words):
    box = _box(around, o, (-180.0, -90.0, 180.0, 90.0))
    interval = float(o["interval"]) if "interval" in o else (box[2] - box[0]) / int(o["cols"])
    return geometry.point_grid(spark, box, interval)


def _rectangle(spark, around, o, words):
    if "bbox" in o:
        at = [F.lit(float(x)) for x in listed(o["bbox"])]
        around = spark.range(1).select(F.col("id").alias(FID), geometry.rectangle(*at).alias("geom"))
    return shapes.rectangle_around(around, offset=float(o.get("offset", 0)), aspect=float(o["aspect-ratio"]) if "aspect-ratio" in o else None)


#: Commands that make a layer, around the target's shapes where they have no box of their own.
GENERATORS = {"grid": _grid, "point-grid": _point_grid, "rectangle": _rectangle, "graticule": lambda spark, around, o, words: shapes.graticule(spark, float(o.get("interval", 10)))}
