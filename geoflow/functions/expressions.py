"""A subset of JavaScript expressions, parsed here and lowered to Spark columns.

Values follow JavaScript where columns can: null counts as 0 in arithmetic and as "null" in
concatenation, + joins if a side is text, && and || yield an operand, truth is "not null, not 0, not
NaN, not empty".  Numbers are doubles.  Everything stays in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    """The text isn't in the supported subset, or mixes types that don't go together."""


TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')"""
    r"""|(?P<id>[A-Za-z_$][\w$]*)|(?P<op>===|!==|\*\*|==|!=|<=|>=|&&|\|\||[-+*/%<>!?:.,()\[\]=;]))"""
)
LEVELS = [["||"], ["&&"], ["==", "!=", "===", "!=="], ["<", ">", "<=", ">="], ["+", "-"], ["*", "/", "%"], ["**"]]
Node = tuple


def tokenise(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"can't read {text[at : at + 20]!r}")
        out.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    """Nodes: (num, x) (str, x) (name, x) (member, of, x) (index, of, i) (call, of, args) (unary, op, x) (binary, op, a, b) (if, c, a, b) (set, name, x) (delete, name) (list, xs)."""

    def __init__(self, text: str):
        self.tokens, self.at = tokenise(text), 0

    def peek(self, *ops: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind == "op" and value in ops

    def take(self, op: str) -> None:
        if not self.peek(op):
            raise ExpressionError(f"expected {op!r} before {self.tokens[self.at][1]!r}")
        self.at += 1

    def program(self) -> list[Node]:
        """Statements, divided by , or ;"""
        out = []
        while self.tokens[self.at][0] != "end":
            out.append(self.statement())
            while self.peek(",", ";"):
                self.at += 1
        return out

    def statement(self) -> Node:
        (kind, value), (_, after) = self.tokens[self.at], self.tokens[min(self.at + 1, len(self.tokens) - 1)]
        if kind == "id" and value == "delete":
            self.at += 1
            target = self.postfix()
            return ("delete", target[-1])
        start = self.at
        left = self.postfix() if kind == "id" else None
        if left is not None and self.peek("="):
            self.at += 1
            if left[0] not in ("name", "member", "index"):
                raise ExpressionError("can't assign to that")
            return ("set", left[2][1] if left[0] == "index" else left[-1], self.statement())
        self.at = start
        return self.choice()

    def choice(self) -> Node:
        test = self.binary(0)
        if self.peek("?"):
            self.at += 1
            a = self.choice()
            self.take(":")
            return ("if", test, a, self.choice())
        return test

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek(*LEVELS[level]):
            op = self.tokens[self.at][1]
            self.at += 1
            left = ("binary", op, left, self.binary(level if op == "**" else level + 1))
        return left

    def unary(self) -> Node:
        if self.peek("!", "-", "+"):
            op = self.tokens[self.at][1]
            self.at += 1
            return ("unary", op, self.unary())
        if self.tokens[self.at] == ("id", "typeof"):
            self.at += 1
            return ("unary", "typeof", self.unary())
        return self.postfix()

    def postfix(self) -> Node:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            node: Node = ("num", float(value))
        elif kind == "str":
            node = ("str", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1]))
        elif kind == "id":
            if value == "new":
                return self.postfix()
            node = ("name", value)
        elif value == "(":
            node = self.choice()
            self.take(")")
        elif value == "[":
            node = ("list", self.arguments("]"))
        else:
            raise ExpressionError(f"unexpected {value or 'end'!r}")
        while True:
            if self.peek("."):
                self.at += 1
                node = ("member", node, self.tokens[self.at][1])
                self.at += 1
            elif self.peek("["):
                self.at += 1
                node = ("index", node, self.choice())
                self.take("]")
            elif self.peek("("):
                self.at += 1
                node = ("call", node, self.arguments(")"))
            else:
                return node

    def arguments(self, close: str) -> list[Node]:
        out = []
        while not self.peek(close):
            out.append(self.choice())
            if self.peek(","):
                self.at += 1
        self.take(close)
        return out


@dataclass
class Value:
    """A column and its kind: num, str, bool, date, list, null or other."""

    column: Column
    kind: str


@dataclass
class Scope:
    """What names mean: fields by name, defs (constants), and values of `this`."""

    fields: dict[str, Value]
    defs: dict[str, Any] = field(default_factory=dict)
    this: dict[str, Value] = field(default_factory=dict)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "num"
    for cls, kind in ((T.StringType, "str"), (T.BooleanType, "bool"), (T.DateType, "date"), (T.TimestampType, "date"), (T.TimestampNTZType, "date"), (T.ArrayType, "list"), (T.NullType, "null")):
        if isinstance(t, cls):
            return kind
    return "other"


def scope_of(schema: T.StructType, defs: dict[str, Any] | None = None, this: dict[str, Value] | None = None) -> Scope:
    quote = lambda n: F.col("`" + n.replace("`", "``") + "`")
    return Scope({f.name: Value(quote(f.name), kind_of(f.dataType)) for f in schema}, defs or {}, this or {})


def constant(x: Any) -> Value:
    if x is None:
        return Value(F.lit(None), "null")
    if isinstance(x, bool):
        return Value(F.lit(x), "bool")
    if isinstance(x, (int, float)):
        return Value(F.lit(float(x)), "num")
    if isinstance(x, (list, tuple)):
        return Value(F.array(*(constant(v).column for v in x)), "list")
    return Value(F.lit(x), "str")


def number(v: Value) -> Column:
    if v.kind == "null":
        return F.lit(0.0)
    if v.kind == "str":
        text = F.trim(v.column)
        return F.when(v.column.isNull() | (text == ""), F.lit(0.0)).otherwise(F.coalesce(text.try_cast("double"), F.lit(float("nan"))))
    if v.kind == "bool":
        return F.coalesce(v.column.cast("int").cast("double"), F.lit(0.0))
    if v.kind == "date":
        return F.unix_millis(v.column.cast("timestamp")).cast("double")
    if v.kind == "num":
        return F.coalesce(v.column.cast("double"), F.lit(0.0))
    raise ExpressionError(f"a number is needed, not a {v.kind}")


def text(v: Value) -> Column:
    """String(v): whole numbers without a fraction."""
    if v.kind == "null":
        return F.lit("null")
    if v.kind == "num":
        x = v.column.cast("double")
        whole = (x == F.floor(x).cast("double")) & (F.abs(x) < 1e15)
        out = F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity")).when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))
    elif v.kind == "list":
        out = F.array_join(F.transform(v.column, lambda z: z.cast("string")), ",")
    else:
        out = v.column.cast("string")
    return F.coalesce(out, F.lit("null"))


def truth(v: Value) -> Column:
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "num":
        out = (v.column != 0) & ~F.isnan(v.column.cast("double"))
    elif v.kind == "str":
        out = v.column != ""
    elif v.kind == "bool":
        out = v.column
    else:
        out = v.column.isNotNull()
    return F.coalesce(out, F.lit(False))


def js_round(x: Column, digits: Column | None = None) -> Column:
    """Halves go up, towards positive infinity; null stays null."""
    if digits is None:
        return F.floor(x + 0.5).cast("double")
    k = F.pow(F.lit(10.0), digits)
    return F.floor(x * k + 0.5).cast("double") / k


def divide(a: Column, b: Column) -> Column:
    inf = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, inf).otherwise(F.try_divide(a, b))


MATH = {"abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": js_round, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan, "asin": F.asin, "acos": F.acos, "sign": F.signum, "cbrt": F.cbrt,
        "sqrt": lambda x: F.when(x < 0, float("nan")).otherwise(F.sqrt(x)), "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"),
        "log": lambda x: F.when(x > 0, F.log(x)).when(x == 0, float("-inf")).otherwise(float("nan")), "log10": lambda x: F.when(x > 0, F.log10(x)).when(x == 0, float("-inf")).otherwise(float("nan")), "log2": lambda x: F.when(x > 0, F.log2(x)).when(x == 0, float("-inf")).otherwise(float("nan"))}
CONSTANTS = {"PI": 3.141592653589793, "E": 2.718281828459045, "SQRT2": 1.4142135623730951}


class Lowering:
    """Turns nodes into values within a scope; aggregates: calls by name that a caller has computed already."""

    def __init__(self, scope: Scope, aggregate=None):
        self.scope, self.aggregate = scope, aggregate

    def lower(self, node: Node) -> Value:
        return getattr(self, f"on_{node[0]}")(*node[1:])

    def on_num(self, x: float) -> Value:
        return Value(F.lit(x), "num")

    def on_str(self, x: str) -> Value:
        return Value(F.lit(x), "str")

    def on_list(self, xs: list[Node]) -> Value:
        return Value(F.array(*(self.lower(x).column for x in xs)), "list")

    def on_name(self, name: str) -> Value:
        scope = self.scope
        if name in scope.fields:
            return scope.fields[name]
        if name in scope.defs:
            return constant(scope.defs[name])
        if name in ("true", "false", "null", "undefined", "NaN", "Infinity"):
            return constant({"true": True, "false": False, "NaN": float("nan"), "Infinity": float("inf")}.get(name))
        raise ExpressionError(f"unknown name {name!r}; fields: {', '.join(scope.fields)}")

    def on_member(self, of: Node, name: str) -> Value:
        if of == ("name", "Math") and name in CONSTANTS:
            return constant(CONSTANTS[name])
        if of in (("name", "this"), ("name", "$")) and name in self.scope.this:
            return self.scope.this[name]
        if of in (("name", "d"), ("member", ("name", "this"), "properties"), ("member", ("name", "$"), "properties")) and "d" not in self.scope.fields:
            return self.scope.fields.get(name, constant(None))
        if of == ("name", "global"):
            return constant(self.scope.defs.get(name))
        if of[0] == "name" and f"{of[1]}.{name}" in self.scope.fields:
            return self.scope.fields[f"{of[1]}.{name}"]
        if name == "length":
            v = self.lower(of)
            return Value((F.size(v.column) if v.kind == "list" else F.length(text(v))).cast("double"), "num")
        raise ExpressionError(f"unknown member {name!r}")

    def on_index(self, of: Node, i: Node) -> Value:
        if i[0] == "str":
            return self.on_member(of, i[1])
        v = self.lower(of)
        at = number(self.lower(i)).cast("int")
        if v.kind == "list":
            return Value(F.get(v.column, at), "other")
        return Value(F.substring(text(v), at + F.lit(1), F.lit(1)), "str")

    def on_unary(self, op: str, x: Node) -> Value:
        v = self.lower(x)
        if op == "!":
            return Value(~truth(v), "bool")
        if op == "typeof":
            return Value(F.lit({"num": "number", "str": "string", "bool": "boolean"}.get(v.kind, "object")), "str")
        return Value(-number(v) if op == "-" else number(v), "num")

    def on_if(self, test: Node, a: Node, b: Node) -> Value:
        return self.either(truth(self.lower(test)), self.lower(a), self.lower(b))

    @staticmethod
    def either(test: Column, a: Value, b: Value) -> Value:
        kind = a.kind if b.kind in (a.kind, "null") else b.kind if a.kind == "null" else "str"
        if kind == "str" and "str" not in (a.kind, b.kind):
            raise ExpressionError(f"one column can't hold both a {a.kind} and a {b.kind}")
        as_kind = lambda v: v.column if v.kind in (kind, "null") else text(v)
        if kind == "num":
            as_kind = lambda v: v.column.cast("double")
        return Value(F.when(test, as_kind(a)).otherwise(as_kind(b)), kind)

    def on_binary(self, op: str, a: Node, b: Node) -> Value:
        x, y = self.lower(a), self.lower(b)
        if op == "&&":
            return self.either(truth(x), y, x) if x.kind != "bool" or y.kind != "bool" else Value(truth(x) & truth(y), "bool")
        if op == "||":
            return self.either(truth(x), x, y) if x.kind != "bool" or y.kind != "bool" else Value(truth(x) | truth(y), "bool")
        if op in ("==", "===", "!=", "!=="):
            same = self.equal(x, y, strict=len(op) == 3)
            return Value(same if op[0] == "=" else ~same, "bool")
        if op in ("<", ">", "<=", ">="):
            l, r = (x.column, y.column) if x.kind == y.kind == "str" else (number(x), number(y))
            bad = F.lit(False) if x.kind == y.kind == "str" else F.isnan(l) | F.isnan(r)
            out = {"<": l < r, ">": l > r, "<=": l <= r, ">=": l >= r}[op]
            return Value(F.coalesce(out & ~bad, F.lit(False)), "bool")
        if op == "+" and "str" in (x.kind, y.kind):
            return Value(F.concat(text(x), text(y)), "str")
        l, r = number(x), number(y)
        if op == "%":
            return Value(F.when(r == 0, float("nan")).otherwise(F.try_mod(l, r)), "num")
        return Value({"+": lambda: l + r, "-": lambda: l - r, "*": lambda: l * r, "/": lambda: divide(l, r), "**": lambda: F.pow(l, r)}[op](), "num")

    @staticmethod
    def equal(x: Value, y: Value, strict: bool) -> Column:
        if "null" in (x.kind, y.kind):
            return (y if x.kind == "null" else x).column.isNull()
        if x.kind == y.kind:
            out = x.column == y.column
            if x.kind == "num":
                out &= ~F.isnan(x.column.cast("double"))
            return F.coalesce(out, x.column.isNull() & y.column.isNull())
        if strict:
            return F.lit(False)
        return F.coalesce((number(x) == number(y)) & x.column.isNotNull() & y.column.isNotNull(), F.lit(False))

    def on_set(self, name: str, x: Node) -> Value:
        raise ExpressionError("an assignment can't be part of an expression")

    def on_call(self, of: Node, args: list[Node]) -> Value:
        if of[0] == "name" and self.aggregate is not None:
            found = self.aggregate(of[1], args)
            if found is not None:
                return found
        v = [self.lower(a) for a in args]
        if of[0] == "member" and of[1] == ("name", "Math"):
            return Value(self.math(of[2], [number(x) for x in v]), "num")
        if of[0] == "member" and of[1] in (("name", "this"), ("name", "$")) and of[2] in BOX_TESTS and "bbox" in self.scope.this:
            box = self.scope.this["bbox"].column
            return Value(F.coalesce(BOX_TESTS[of[2]](*(F.get(box, F.lit(k)) for k in range(4)), *(number(x) for x in v)), F.lit(False)), "bool")
        if of == ("member", ("name", "JSON"), "stringify"):
            return Value(text(v[0]) if v[0].kind in ("num", "bool", "null") else F.when(v[0].column.isNull(), "null").otherwise(F.to_json(v[0].column) if v[0].kind in ("list", "other") else F.substring(F.to_json(F.array(v[0].column)), F.lit(2), F.length(F.to_json(F.array(v[0].column))) - 2)), "str")
        if of[0] == "member":
            return self.method(self.lower(of[1]), of[2], v)
        name = of[1]
        if name == "round":
            x = v[0].column.cast("double")
            return Value(js_round(x, number(v[1]) if len(v) > 1 else None), "num")
        if name in ("Number", "parseFloat", "parseInt"):
            if name != "Number" and v[0].kind == "str":
                pattern = r"^\s*([+-]?\d+)" if name == "parseInt" else r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
                return Value(F.coalesce(F.regexp_extract(v[0].column, pattern, 1).try_cast("double"), F.lit(float("nan"))), "num")
            x = number(v[0])
            return Value(MATH["trunc"](x) if name == "parseInt" else x, "num")
        if name == "String":
            return Value(text(v[0]), "str")
        if name == "Boolean":
            return Value(truth(v[0]), "bool")
        if name in ("isNaN", "isFinite"):
            x = number(v[0])
            return Value(F.isnan(x) if name == "isNaN" else ~F.isnan(x) & (F.abs(x) < float("inf")), "bool")
        if name == "Date":
            return Value(F.try_to_timestamp(v[0].column) if v[0].kind == "str" else v[0].column.cast("timestamp"), "date")
        if name == "sprintf":
            if args[0][0] != "str":
                raise ExpressionError("sprintf() takes a constant format")
            return Value(sprintf(args[0][1], v[1:]), "str")
        if name == "int_median":
            return Value(int_median(v[0].column, v[1].column), "num")
        if name == "format_dms":
            return Value(format_dms(number(v[0])), "str")
        if name == "parse_dms":
            return Value(parse_dms(text(v[0])), "num")
        raise ExpressionError(f"unknown function {name!r}")

    @staticmethod
    def math(name: str, x: list[Column]) -> Column:
        if name in MATH:
            return MATH[name](x[0])
        if name in ("min", "max"):
            return x[0] if len(x) == 1 else (F.least if name == "min" else F.greatest)(*x)
        if name in ("pow", "atan2", "hypot"):
            return getattr(F, name)(*x)
        raise ExpressionError(f"unknown function Math.{name}")

    @staticmethod
    def method(of: Value, name: str, v: list[Value]) -> Value:
        if of.kind == "list":
            x = of.column
            if name == "includes":
                return Value(F.array_contains(x, v[0].column), "bool")
            if name == "join":
                by = text(v[0]) if v else F.lit(",")
                return Value(F.aggregate(F.transform(x, lambda z: z.cast("string")), F.lit(None).cast("string"), lambda a, z: F.when(a.isNull(), z).otherwise(F.concat(a, by, z))), "str")
            if name == "indexOf":
                return Value((F.array_position(x, v[0].column) - 1).cast("double"), "num")
            if name == "slice":
                size = F.size(x)
                place = lambda i: F.when(i < 0, F.greatest(size + i, F.lit(0))).otherwise(F.least(i, size))
                start = place(number(v[0]).cast("int")) if v else F.lit(0)
                end = place(number(v[1]).cast("int")) if len(v) > 1 else size
                return Value(F.slice(x, start + 1, F.greatest(end - start, F.lit(0))), "list")
            if name == "concat":
                return Value(F.concat(x, *(y.column for y in v)), "list")
        if of.kind == "date":
            x = of.column
            part = {"getFullYear": F.year, "getMonth": lambda c: F.month(c) - 1, "getDate": F.dayofmonth, "getDay": lambda c: F.dayofweek(c) - 1, "getHours": F.hour, "getMinutes": F.minute, "getSeconds": F.second, "getTime": lambda c: F.unix_millis(c.cast("timestamp"))}
            if name in part:
                return Value(part[name](x).cast("double"), "num")
        if name == "toFixed":
            digits = number(v[0]).cast("int") if v else F.lit(0)
            shown = js_round(number(of), digits).cast("decimal(38,15)").cast("string")
            return Value(F.when(digits == 0, js_round(number(of)).cast("long").cast("string")).otherwise(F.substring(shown, F.lit(1), F.instr(shown, F.lit(".")) + digits)), "str")
        s = text(of)
        n = lambda k: number(v[k]).cast("int")
        size = F.length(s)
        clip = lambda i: F.when(i < 0, F.greatest(size + i, F.lit(0))).otherwise(F.least(i, size))
        simple = {"toUpperCase": F.upper, "toLowerCase": F.lower, "trim": lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")}
        if name in simple:
            return Value(simple[name](s), "str")
        if name in ("includes", "startsWith", "endsWith"):
            return Value({"includes": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[name](s, text(v[0])), "bool")
        if name == "indexOf":
            return Value((F.instr(s, text(v[0])) - 1).cast("double"), "num")
        if name == "charAt":
            return Value(F.substring(s, n(0) + F.lit(1), F.lit(1)), "str")
        if name in ("substr", "substring", "slice"):
            start = clip(n(0)) if name != "substring" else F.least(F.greatest(n(0), F.lit(0)), size)
            if name == "substr":
                count = n(1) if len(v) > 1 else size
            else:
                end = size if len(v) < 2 else clip(n(1)) if name == "slice" else F.least(F.greatest(n(1), F.lit(0)), size)
                if name == "substring":
                    start, end = F.least(start, end), F.greatest(start, end)
                count = end - start
            return Value(F.substring(s, start + F.lit(1), F.greatest(count, F.lit(0))), "str")
        if name == "replace":
            at = F.instr(s, text(v[0]))
            return Value(F.when(at == 0, s).otherwise(F.concat(F.substring(s, F.lit(1), at - F.lit(1)), text(v[1]), F.substring(s, at + F.length(text(v[0])), size))), "str")
        if name == "replaceAll":
            return Value(F.replace(s, text(v[0]), text(v[1])), "str")
        if name == "split":
            return Value(F.split(s, F.concat(F.lit(r"\Q"), text(v[0]), F.lit(r"\E"))), "list")
        if name in ("padStart", "padEnd"):
            width = F.greatest(n(0), size)
            fill = text(v[1]) if len(v) > 1 else F.lit(" ")
            return Value((F.lpad if name == "padStart" else F.rpad)(s, width, fill), "str")
        if name == "repeat":
            return Value(F.repeat(s, n(0)), "str")
        raise ExpressionError(f"unknown method {name!r}")


#: Tests of a box against a point or another box: the box's four sides, then the arguments.
BOX_TESTS = {
    "bboxContainsPoint": lambda a, b, c, d, x, y: x.between(a, c) & y.between(b, d),
    "bboxIntersectsRectangle": lambda a, b, c, d, e, f, g, h: (a <= g) & (c >= e) & (b <= h) & (d >= f),
    "bboxContainsRectangle": lambda a, b, c, d, e, f, g, h: (a <= e) & (b <= f) & (c >= g) & (d >= h),
    "bboxContainedByRectangle": lambda a, b, c, d, e, f, g, h: (a >= e) & (b >= f) & (c <= g) & (d <= h),
}


def sprintf(form: str, values: list[Value]) -> Column:
    """%s %d %i %f %x %X with the flags + 0 ' and , (thousands), a width and a precision; a negative number gets a minus sign (U+2212)."""
    out, at, values = [], 0, list(values)
    for m in re.finditer(r"%([+0',]*)(\d?)(?:\.(\d))?([sdifxX%])", form):
        out.append(F.lit(form[at : m.start()]))
        at = m.end()
        flags, width, precision, kind = m[1], int(m[2] or 0), m[3], m[4]
        if kind == "%":
            out.append(F.lit("%"))
            continue
        if not values:
            raise ExpressionError("sprintf() has fewer values than its format")
        v = values.pop(0)
        if kind == "s":
            out.append(F.lpad(text(v), F.greatest(F.lit(width), F.length(text(v))), F.lit(" ")))
            continue
        x = number(v)
        size = F.abs(x)
        if kind in "xX":
            digits = F.hex(F.floor(size + 0.5).cast("long"))
            shown = F.lower(digits) if kind == "x" else digits
        else:
            places = int(precision) if kind == "f" and precision else 6 if kind == "f" else 0
            rounded = js_round(size, F.lit(float(places))) if kind == "f" else F.floor(size).cast("double")
            shown = F.format_number(rounded, places)
            shown = shown if "," in flags or "'" in flags else F.replace(shown, F.lit(","), F.lit(""))
        sign = F.when(x < 0, "\u2212").otherwise("+" if "+" in flags else "")
        if "0" in flags:
            shown = F.lpad(shown, F.greatest(F.lit(width) - F.length(sign), F.length(shown)), F.lit("0"))
        whole = F.concat(sign, shown)
        out.append(F.lpad(whole, F.greatest(F.lit(width), F.length(whole)), F.lit(" ")))
    out.append(F.lit(form[at:]))
    return F.concat(*out)


def int_median(counts: Column, breaks: Column) -> Column:
    """The interpolated median of numbers counted in bins between breaks; null without any, or if the lists don't fit."""
    total = F.aggregate(counts, F.lit(0.0), lambda t, c: t + c.cast("double"))
    half = F.floor(total / 2)
    start = F.struct(F.lit(0.0).alias("before"), F.lit(None).cast("double").alias("at"))

    def step(t: Column, z: Column) -> Column:
        n = z["c"].cast("double")
        here = t["at"].isNull() & (t["before"] + n >= half) & (n > 0)
        low, high = z["low"].cast("double"), z["high"].cast("double")
        return F.struct((t["before"] + n).alias("before"), F.when(here, low + (half - t["before"]) / n * (high - low)).otherwise(t["at"]).alias("at"))

    bins = F.zip_with(counts, F.zip_with(F.slice(breaks, 1, F.size(counts)), F.slice(breaks, 2, F.size(counts)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda c, e: F.struct(c.alias("c"), e["a"].alias("low"), e["b"].alias("high")))
    return F.when((total > 0) & (F.size(counts) == F.size(breaks) - 1), F.aggregate(bins, start, step)["at"])


def format_dms(x: Column) -> Column:
    """Degrees, minutes and whole seconds, like -12°34'56\"."""
    total = F.floor(F.abs(x) * 3600 + 0.5)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(total / 3600).cast("string"), F.lit("°"), two(F.floor(total / 60) % 60), F.lit("'"), two(total % 60), F.lit('"'))


def parse_dms(s: Column) -> Column:
    """Degrees with optional minutes, seconds, sign and hemisphere letter; null if it reads otherwise."""
    pattern = r"""^\s*([NSEWnsew])?\s*([+-]?)\s*(\d+(?:\.\d+)?)\s*[°d:]?\s*(?:(\d+(?:\.\d+)?)\s*['′m:]?\s*)?(?:(\d+(?:\.\d+)?)\s*["″s]?\s*)?([NSEWnsew])?\s*$"""
    part = lambda k: F.regexp_extract(s, pattern, k)
    num = lambda k: F.coalesce(part(k).try_cast("double"), F.lit(0.0))
    size = num(3) + num(4) / 60 + num(5) / 3600
    south = part(1).isin(*"SWsw") | part(6).isin(*"SWsw") | (part(2) == "-")
    return F.when(F.regexp_like(s, F.lit(pattern)), F.when(south, -size).otherwise(size))


def parse(source: str) -> list[Node]:
    return Parser(source).program()


def compile_value(source: str, scope: Scope) -> Value:
    """The last statement's value."""
    nodes = parse(source)
    if len(nodes) != 1:
        raise ExpressionError("one expression is needed")
    return Lowering(scope).lower(nodes[0])
