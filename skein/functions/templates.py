"""Prompt templates as column expressions.

A template with values, loops, conditions and filters is compiled once, against
the types of the columns it names, into one native expression; what it doesn't
know is an error then, not at run time.

    {{ name }}  {{ a.b | default("-") | upper }}  {# remark #}
    {% for x in list %} {{ loop.index }} {{ x.field }} {% else %} none {% endfor %}
    {% if a and b | length > 1 %} {% elif c == "x" %} {% else %} {% endif %}
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TemplateError(ValueError):
    """What a template says can't be done with these columns."""


#: A value: its column and its type.
Value = tuple[Column, T.DataType]
Scope = dict[str, Value]

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_NUMBER = (T.IntegralType, T.FractionalType, T.DecimalType)
_STRING, _LONG, _BOOL = T.StringType(), T.LongType(), T.BooleanType()


def _parts(template: str) -> list[tuple[str, str]]:
    """(kind, body): text, value or tag; a dash beside a tag takes the white space on its side away."""
    out: list[tuple[str, str]] = []
    strip = False
    pieces = _TAG.split(template)
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            text = piece.lstrip() if strip else piece
            if i + 1 < len(pieces) and pieces[i + 1][2] == "-":
                text = text.rstrip()
            out.append(("text", text))
            strip = False
        else:
            strip = piece[-3] == "-"
            if piece[1] != "#":
                out.append(("value" if piece[1] == "{" else "tag", piece[2:-2].strip("-").strip()))
    return out


def _text(value: Value) -> Column:
    """How a value is printed: null as nothing, lists and structs not at all."""
    column, kind = value
    if isinstance(kind, T.BooleanType):
        column = F.when(column, "True").when(~column, "False")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise TemplateError(f"a value of type {kind.simpleString()} is printed; join it, or name a field")
    return F.coalesce(column.cast("string"), F.lit(""))


def _true(value: Value) -> Column:
    """Whether a value counts as true: neither null, false, zero nor empty."""
    column, kind = value
    if isinstance(kind, T.BooleanType):
        held = column
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        held = F.size(column) > 0
    elif isinstance(kind, T.StringType):
        held = column != ""
    elif isinstance(kind, _NUMBER):
        held = column != 0
    else:
        held = column.isNotNull()
    return F.coalesce(held, F.lit(False))


def _listed(value: Value, what: str) -> T.DataType:
    if not isinstance(value[1], T.ArrayType):
        raise TemplateError(f"{what} needs a list, not {value[1].simpleString()}")
    return value[1].elementType


def _join(value: Value, separator: Value | None = None, attribute: Value | None = None) -> Value:
    inner = _listed(value, "join")
    column = value[0]
    if attribute is not None:
        if not isinstance(inner, T.StructType) or _constant(attribute) not in inner.names:
            raise TemplateError(f"no field {_constant(attribute)} to join")
        column, inner = F.transform(column, lambda x: x[_constant(attribute)]), inner[_constant(attribute)].dataType
    return F.array_join(F.transform(column, lambda x: _text((x, inner))), _constant(separator) if separator else ""), _STRING


def _default(value: Value, other: Value, empty: Value | None = None) -> Value:
    """The other value where there is none; with true as a second argument, where the value counts as false."""
    if empty is not None and _constant(empty):
        return F.when(_true(value), _text(value)).otherwise(_text(other)), _STRING
    return F.when(value[0].isNotNull(), _text(value)).otherwise(_text(other)), _STRING


def _length(value: Value) -> Value:
    column, kind = value
    size = F.size(column) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(column.cast("string"))
    return F.coalesce(F.when(column.isNotNull(), size), F.lit(0)).cast("long"), _LONG


def _of_text(function: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda value: (function(_text(value)), _STRING)


FILTERS: dict[str, Callable[..., Value]] = {
    "default": _default,
    "join": _join,
    "length": _length,
    "upper": _of_text(F.upper),
    "lower": _of_text(F.lower),
    "trim": _of_text(F.trim),
    "first": lambda v: (F.get(v[0], F.lit(0)), _listed(v, "first")),
    "last": lambda v: (F.get(v[0], F.size(v[0]) - 1), _listed(v, "last")),
    "replace": lambda v, old, new: (F.replace(_text(v), F.lit(_constant(old)), F.lit(_constant(new))), _STRING),
    "tojson": lambda v: (F.to_json(v[0]) if isinstance(v[1], (T.ArrayType, T.MapType, T.StructType)) else F.regexp_replace(F.to_json(F.struct(v[0].alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1"), _STRING),
    "round": lambda v, digits=None: (F.round(v[0].cast("double"), _constant(digits) if digits else 0), T.DoubleType()),
}


class _Literal(tuple):
    """A value that is written in the template."""

    def __new__(cls, plain):
        kind = _BOOL if isinstance(plain, bool) else _LONG if isinstance(plain, int) else T.DoubleType() if isinstance(plain, float) else _STRING
        made = super().__new__(cls, (F.lit(plain), kind))
        made.plain = plain
        return made


def _constant(value):
    if not isinstance(value, _Literal):
        raise TemplateError("an argument of a filter must be written out")
    return value.plain


def _compare(op: ast.cmpop, a: Value, b: Value) -> Column:
    if isinstance(op, (ast.In, ast.NotIn)):
        inner = _listed(b, "in") if isinstance(b[1], T.ArrayType) else None
        held = F.exists(b[0], lambda x: x == a[0]) if inner is not None else F.contains(_text(b), _text(a))
        return F.coalesce(held, F.lit(False)) if isinstance(op, ast.In) else ~F.coalesce(held, F.lit(False))
    x, y = (a[0], b[0]) if isinstance(a[1], _NUMBER) == isinstance(b[1], _NUMBER) else (_text(a), _text(b))
    if isinstance(op, ast.Eq):
        return x.eqNullSafe(y)
    if isinstance(op, ast.NotEq):
        return ~x.eqNullSafe(y)
    found = {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]
    return F.coalesce(found, F.lit(False))


def _evaluate(node: ast.expr, scope: Scope) -> Value:
    match node:
        case ast.Constant(value=value):
            return _Literal(value) if value is not None else (F.lit(None).cast("string"), _STRING)
        case ast.Name(id=("true" | "false") as word):
            return _Literal(word == "true")
        case ast.Name(id="none"):
            return F.lit(None).cast("string"), _STRING
        case ast.Name(id=name):
            if name not in scope:
                raise TemplateError(f"no value is named {name}")
            return scope[name]
        case ast.Attribute(value=inner, attr=name):
            column, kind = _evaluate(inner, scope)
            if not isinstance(kind, T.StructType) or name not in kind.names:
                raise TemplateError(f"no field {name} in {kind.simpleString()}")
            return column[name], kind[name].dataType
        case ast.BinOp(left=left, op=ast.BitOr(), right=right):
            name, args, named = (right.func.id, right.args, right.keywords) if isinstance(right, ast.Call) else (getattr(right, "id", None), [], [])
            if name not in FILTERS:
                raise TemplateError(f"no filter is named {name}")
            more = {k.arg: _evaluate(k.value, scope) for k in named}
            try:
                return FILTERS[name](_evaluate(left, scope), *[_evaluate(a, scope) for a in args], **more)
            except TypeError as e:
                raise TemplateError(f"filter {name}: {e}") from None
        case ast.Compare(left=left, ops=[op], comparators=[right]):
            return _compare(op, _evaluate(left, scope), _evaluate(right, scope)), _BOOL
        case ast.BoolOp(op=op, values=values):
            found = [_true(_evaluate(v, scope)) for v in values]
            out = found[0]
            for f in found[1:]:
                out = out & f if isinstance(op, ast.And) else out | f
            return out, _BOOL
        case ast.UnaryOp(op=ast.Not(), operand=inner):
            return ~_true(_evaluate(inner, scope)), _BOOL
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=value)):
            return _Literal(-value)
    raise TemplateError(f"can't be read: {ast.unparse(node)}")


def _expression(text: str, scope: Scope) -> Value:
    try:
        return _evaluate(ast.parse(text.strip(), mode="eval").body, scope)
    except SyntaxError:
        raise TemplateError(f"can't be read: {text}") from None


def _block(parts: list[tuple[str, str]], at: int, scope: Scope, ends: tuple[str, ...]) -> tuple[Column, int, str]:
    """The text up to a tag that begins with one of ``ends``: (column, where that tag is, the tag)."""
    out: list[Column] = [F.lit("")]
    while at < len(parts):
        kind, body = parts[at]
        word = body.split(None, 1)[0] if body.strip() else ""
        if kind == "text":
            out.append(F.lit(body))
        elif kind == "value":
            out.append(_text(_expression(body, scope)))
        elif word in ends:
            return F.concat(*out), at, body
        elif word == "if":
            column, at = _condition(parts, at, scope)
            out.append(column)
        elif word == "for":
            column, at = _loop(parts, at, scope)
            out.append(column)
        else:
            raise TemplateError(f"no tag is named {word}")
        at += 1
    if ends:
        raise TemplateError(f"{' or '.join(ends)} is missing")
    return F.concat(*out), at, ""


def _condition(parts: list[tuple[str, str]], at: int, scope: Scope) -> tuple[Column, int]:
    tag, cases, last = parts[at][1], [], F.lit("")
    while True:
        word, _, rest = tag.partition(" ")
        body, at, following = _block(parts, at + 1, scope, ("endif",) if word == "else" else ("elif", "else", "endif"))
        if word == "else":
            last = body
        else:
            cases.append((_true(_expression(rest, scope)), body))
        if following == "endif":
            break
        tag = following
    out = F.when(*cases[0])
    for held, body in cases[1:]:
        out = out.when(held, body)
    return out.otherwise(last), at


def _loop(parts: list[tuple[str, str]], at: int, scope: Scope) -> tuple[Column, int]:
    found = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", parts[at][1], re.S)
    if not found:
        raise TemplateError(f"can't be read: {parts[at][1]}")
    value = _expression(found[2], scope)
    inner = _listed(value, "for")
    size = F.size(value[0])
    begin, where = at + 1, {}
    kind = T.StructType([T.StructField(n, _LONG) for n in ("index", "index0", "length")] + [T.StructField(n, _BOOL) for n in ("first", "last")])

    def item(x: Column, i: Column) -> Column:
        loop = F.struct((i + 1).alias("index"), i.alias("index0"), size.alias("length"), (i == 0).alias("first"), (i == size - 1).alias("last"))
        body, where["at"], where["tag"] = _block(parts, begin, scope | {found[1]: (x, inner), "loop": (loop, kind)}, ("else", "endfor"))
        return body

    rows = F.array_join(F.transform(value[0], item), "")
    at, none = where["at"], F.lit("")
    if where["tag"] == "else":
        none, at, _ = _block(parts, at + 1, scope, ("endfor",))
    return F.when(F.coalesce(size, F.lit(0)) > 0, rows).otherwise(none), at


def render(df: DataFrame, template: str, **values: Column | str) -> Column:
    """The template filled with columns of ``df``: all by their names, or those of ``values`` by theirs.

    Nulls print as nothing, are false, and have the length 0; a null list is an
    empty one. Equal compares nulls as equal. Other names, fields and filters
    raise ``TemplateError``.
    """
    chosen = {name: (F.col(v) if isinstance(v, str) else v) for name, v in values.items()} or {c: F.col(f"`{c}`") for c in df.columns}
    schema = df.select(*[c.alias(name) for name, c in chosen.items()]).schema
    scope = {name: (c, schema[name].dataType) for name, c in chosen.items()}
    column, _, _ = _block(_parts(template), 0, scope, ())
    return column
