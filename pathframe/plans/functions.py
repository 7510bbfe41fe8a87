"""The built-in functions over Columns: the part that Spark's own functions can say exactly."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathframe.errors import EvalError
from pathframe.plans.values import (
    BOOLEAN,
    DOUBLE,
    MISSING,
    NUMERIC,
    STRING,
    Unsupported,
    Val,
    constant,
    from_column,
    kind,
    need_number,
    raised,
    text_of,
    truthy,
)


def _array(v: Val) -> Val:
    """A scalar as an array of one, missing as null."""
    if v.many:
        return v
    if v.fields is not None or v.col is not None:
        col = v.as_column()
        dtype = v.dtype if v.dtype is not None else T.StructType([T.StructField(k, f.dtype) for k, f in v.fields.items()])
        return Val(F.when(col.isNotNull(), F.array(col)), dtype, True)
    return MISSING


def _numbers(v: Val) -> Val:
    a = _array(v)
    if a.missing:
        return a
    if not isinstance(a.dtype, NUMERIC):
        raise EvalError("T0412", kind(v))
    return Val(F.transform(a.col, lambda x: x.cast("double")), DOUBLE, True)


def _text(v: Val, place: int = 1) -> Column:
    if v.missing:
        return F.lit(None).cast("string")
    if v.many:
        raise Unsupported("text is needed, an array is given")
    if not v.string:
        raise EvalError("T0410", f"argument {place} is a {kind(v)}")
    return v.col


def _number(v: Val, place: int = 1) -> Column:
    return need_number(v, "T0410")


def _literal(v: Val, what: str) -> Any:
    if not v.is_const:
        raise Unsupported(f"{what} must be a constant here")
    return v.const


def f_sum(ctx, v):
    a = _numbers(v)
    total = F.aggregate(a.col, F.lit(0.0), lambda s, x: s + x) if not a.missing else None
    # Nothing found has no sum; an empty array that is there has 0.
    return a if a.missing else Val(F.when(F.size(a.col) > 0, total) if v.extra.get("found") else total, DOUBLE)


def f_count(ctx, v):
    if v.missing:
        return constant(0.0)
    a = _array(v)
    return Val(F.coalesce(F.size(a.col), F.lit(0)).cast("double"), DOUBLE)


def f_max(ctx, v):
    a = _numbers(v)
    return a if a.missing else Val(F.array_max(a.col), DOUBLE)


def f_min(ctx, v):
    a = _numbers(v)
    return a if a.missing else Val(F.array_min(a.col), DOUBLE)


def f_average(ctx, v):
    a = _numbers(v)
    return a if a.missing else Val(F.when(F.size(a.col) > 0, F.aggregate(a.col, F.lit(0.0), lambda s, x: s + x) / F.size(a.col)), DOUBLE)


def f_string(ctx, v, pretty=None):
    return v if v.missing else Val(text_of(v), STRING)


def f_length(ctx, v):
    return Val(F.length(_text(v)).cast("double"), DOUBLE)


def f_substring(ctx, v, start, length=None):
    s, a = _text(v), _number(start, 2).cast("int")
    n = F.length(s)
    first = F.when(a >= 0, a + 1).otherwise(F.greatest(n + a, F.lit(0)) + 1)
    if length is None or length.missing:
        return Val(F.substring(s, first, n), STRING)
    many = _number(length, 3).cast("int")
    return Val(F.when(many <= 0, F.lit("")).otherwise(F.substring(s, first, many)), STRING)


def f_before(ctx, v, mark):
    s, m = _text(v), _text(mark, 2)
    at = F.call_function("instr", s, m)
    return Val(F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(s), STRING)


def f_after(ctx, v, mark):
    s, m = _text(v), _text(mark, 2)
    at = F.call_function("instr", s, m)
    return Val(F.when(at > 0, F.substring(s, at + F.length(m), F.length(s))).otherwise(s), STRING)


def f_lower(ctx, v):
    return Val(F.lower(_text(v)), STRING)


def f_upper(ctx, v):
    return Val(F.upper(_text(v)), STRING)


def f_trim(ctx, v):
    return Val(F.trim(F.regexp_replace(_text(v), "[ \\t\\n\\r]+", " ")), STRING)


def f_pad(ctx, v, width, fill=None):
    s, w = _text(v), int(_literal(width, "a width"))
    c = " " if fill is None or fill.missing else _literal(fill, "a filling") or " "
    n = abs(w)
    padded = F.rpad(s, n, c) if w > 0 else F.lpad(s, n, c)
    return Val(F.when(F.length(s) >= n, s).otherwise(padded), STRING)


def _java(pattern: tuple[str, str]) -> str:
    source, flags = pattern
    return (f"(?{flags})" if flags else "") + source.replace("\\/", "/")


def _is_regex(v: Val) -> bool:
    return isinstance(v.fn, tuple)


def f_contains(ctx, v, what):
    if _is_regex(what):
        return Val(F.regexp_like(_text(v), F.lit(_java(what.fn))), BOOLEAN)
    return Val(F.contains(_text(v), _text(what, 2)), BOOLEAN)


def f_split(ctx, v, by, limit=None):
    s = _text(v)
    if _is_regex(by):
        parts = F.split(s, _java(by.fn), -1)
    else:
        mark = _literal(by, "a separator")
        parts = F.split(s, "", -1) if mark == "" else F.split(s, _quoted(mark), -1)
        if mark == "":
            parts = F.filter(parts, lambda x: x != "")
    if limit is not None and not limit.missing:
        n = _number(limit, 3).cast("int")
        parts = F.when(n < 0, raised("D3020", T.ArrayType(STRING))).otherwise(F.slice(parts, F.lit(1), F.greatest(n, F.lit(0))))
    return Val(parts, STRING, True)


def _quoted(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def f_replace(ctx, v, what, by, limit=None):
    if limit is not None and not limit.missing:
        raise Unsupported("a limit of replacements")
    if by.fn is not None:
        raise Unsupported("a replacing function")
    new = _literal(by, "a replacement")
    if _is_regex(what):
        import re

        # Of a group's number the digits count that name a group; Java reads it the same way.
        java = re.sub(r"\\|\$\$|\$(?![0-9])", lambda m: "\\\\" if m[0] == "\\" else "\\$", new)
        return Val(F.regexp_replace(_text(v), F.lit(_java(what.fn)), F.lit(java)), STRING)
    old = _literal(what, "what is replaced")
    if old == "":
        raise EvalError("D3010")
    return Val(F.replace(_text(v), F.lit(old), F.lit(new)), STRING)


def f_match(ctx, v, what, limit=None):
    if not _is_regex(what):
        raise Unsupported("a matching function")
    import re

    source = _java(what.fn)
    groups = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", what.fn[0])).groups
    s = _text(v)
    names = [F.regexp_extract_all(s, F.lit(source), F.lit(g)) for g in range(groups + 1)]
    size = F.size(names[0])
    group = lambda i: F.array(*[F.element_at(g, i) for g in names[1:]]).cast("array<string>")
    whole = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.element_at(names[0], i).alias("match"), group(i).alias("groups")))
    found = F.when(size > 0, whole)
    dtype = T.StructType([T.StructField("match", STRING), T.StructField("groups", T.ArrayType(STRING))])
    if limit is not None and not limit.missing:
        found = F.slice(found, F.lit(1), _number(limit, 3).cast("int"))
    return Val(found, dtype, True)


def f_join(ctx, v, by=None):
    a = _array(v)
    if a.missing:
        return a
    if not isinstance(a.dtype, T.StringType):
        raise EvalError("T0412", kind(v))
    sep = F.lit("") if by is None or by.missing else _text(by, 2)
    return Val(F.array_join(a.col, _literal(by, "a separator") if by is not None and by.is_const else ""), STRING) if by is None or by.is_const else Val(F.call_function("array_join", a.col, sep), STRING)


def f_base64encode(ctx, v):
    return Val(F.base64(F.encode(_text(v), "ISO-8859-1")), STRING)


def f_base64decode(ctx, v):
    return Val(F.decode(F.unbase64(_text(v)), "ISO-8859-1"), STRING)


def _unescaped(col: Column, signs: str) -> Column:
    for c in signs:
        col = F.replace(col, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return col


def f_encode_component(ctx, v):
    return Val(_unescaped(F.replace(F.url_encode(_text(v)), F.lit("+"), F.lit("%20")), "!'()~"), STRING)


def f_encode_url(ctx, v):
    return Val(_unescaped(F.replace(F.url_encode(_text(v)), F.lit("+"), F.lit("%20")), "!'()~;,/?:@&=+$#"), STRING)


def f_decode_component(ctx, v):
    s = _text(v)
    got = F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
    return Val(F.when(s.isNotNull() & got.isNull(), raised("D3140", STRING)).otherwise(got), STRING)


def f_decode_url(ctx, v):
    s = _text(v)
    # Escapes of signs that part a URL stay as they are.
    kept = F.regexp_replace(s, "%(2[346BbCcFf]|3[AaBbDdFf]|40)", "%25$1")
    plain = F.replace(kept, F.lit("+"), F.lit("%2B"))
    got = F.try_url_decode(plain)
    return Val(F.when(s.isNotNull() & got.isNull(), raised("D3140", STRING)).otherwise(got), STRING)


def f_format_base(ctx, v, radix=None):
    r = 10 if radix is None or radix.missing else int(_literal(radix, "a radix"))
    if not 2 <= r <= 36:
        raise EvalError("D3100")
    x = F.bround(_number(v)).cast("bigint")
    return Val(F.concat(F.when(x < 0, "-").otherwise(""), F.lower(F.conv(F.abs(x).cast("string"), 10, r))), STRING)


def f_number(ctx, v):
    if v.missing or v.number:
        return Val(v.double(), DOUBLE) if v.number else v
    if v.boolean:
        return Val(v.col.cast("double"), DOUBLE)
    s = _text(v)
    plain = F.regexp_like(s, F.lit(r"^-?[0-9]+(\.[0-9]+)?([Ee][-+]?[0-9]+)?$"))
    hexa, octal, binary = (F.regexp_like(s, F.lit(p)) for p in ("^0[xX][0-9a-fA-F]+$", "^0[oO][0-7]+$", "^0[bB][01]+$"))
    rest = F.substring(s, 3, 1 << 20)
    conv = lambda b: F.conv(rest, b, 10).cast("double")
    got = F.when(plain, s.try_cast("double")).when(hexa, conv(16)).when(octal, conv(8)).when(binary, conv(2))
    return Val(F.when(s.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(got, raised("D3030", DOUBLE))), DOUBLE)


def _numeric(fn):
    return lambda ctx, v: v if v.missing else Val(fn(_number(v)).cast("double"), DOUBLE)


def f_round(ctx, v, places=None):
    p = 0 if places is None or places.missing else int(_literal(places, "a number of places"))
    return v if v.missing else Val(F.bround(_number(v), p).cast("double"), DOUBLE)


def f_sqrt(ctx, v):
    x = _number(v)
    return Val(F.when(x < 0, raised("D3060", DOUBLE)).otherwise(F.sqrt(x)), DOUBLE)


def f_power(ctx, v, e):
    p = F.pow(_number(v), _number(e, 2))
    bad = F.isnan(p) | (F.abs(p) == float("inf"))
    return Val(F.when(bad, raised("D3061", DOUBLE)).otherwise(p), DOUBLE)


def f_boolean(ctx, v):
    if v.missing:
        return v
    there = v.as_column().isNotNull() if v.fields is None else F.lit(True)
    return Val(F.when(there, truthy(v)), BOOLEAN)


def f_not(ctx, v):
    b = f_boolean(ctx, v)
    return b if b.missing else Val(~b.col, BOOLEAN)


def f_exists(ctx, v):
    if v.missing:
        return constant(False)
    if v.is_const or v.fn is not None or v.fields is not None:
        return constant(True)
    return Val(F.coalesce(F.size(v.col) > 0, F.lit(False)) if v.many else v.col.isNotNull(), BOOLEAN)


def f_type(ctx, v):
    if v.missing:
        return v
    if v.many:
        raise Unsupported("the type of what may be one or many")
    return Val(F.when(v.as_column().isNotNull(), F.lit(kind(v))) if not v.is_const and v.fields is None else F.lit(kind(v)), STRING)


def f_error(ctx, message=None):
    return Val(F.raise_error(F.concat(F.lit("D3137: "), F.lit("") if message is None else _text(message))).cast("string"), STRING)


def f_assert(ctx, ok, message=None):
    text = F.lit("$assert() statement failed") if message is None or message.missing else _text(message, 2)
    return Val(F.when(~truthy(ok), F.raise_error(F.concat(F.lit("D3141: "), text)).cast("string")), STRING)


def _lambda(ctx, v: Val, most: int):
    """A function value as a Python function over values, for at most so many arguments."""
    if v.fn is None or isinstance(v.fn, tuple):
        raise EvalError("T0410", "a function is needed")
    return lambda *args: ctx.invoke(v, list(args)[: max(1, min(ctx.arity(v), most))])


def _of(x: Column, dtype: T.DataType) -> Val:
    return from_column(x, dtype)


def f_map(ctx, v, fn):
    a = _array(v)
    if a.missing:
        return a
    call = _lambda(ctx, fn, 2)
    seen: dict[str, Val] = {}

    def body(x, i):
        got = call(_of(x, a.dtype), Val(i.cast("double"), DOUBLE))
        seen["v"] = got
        return got.as_column()

    col = F.transform(a.col, body)
    got = seen["v"]
    dtype = _dtype(got)
    return Val(F.filter(col, lambda x: x.isNotNull()), dtype, True)


def _dtype(v: Val) -> T.DataType:
    if v.fields is not None:
        return T.StructType([T.StructField(k, _dtype(f)) for k, f in v.fields.items()])
    if v.dtype is None:
        raise Unsupported("a value without a type")
    return T.ArrayType(v.dtype, False) if v.many else v.dtype


def f_filter(ctx, v, fn):
    a = _array(v)
    if a.missing:
        return a
    call = _lambda(ctx, fn, 2)
    return Val(F.filter(a.col, lambda x, i: truthy(call(_of(x, a.dtype), Val(i.cast("double"), DOUBLE)))), a.dtype, True)


def f_single(ctx, v, fn=None):
    a = f_filter(ctx, v, fn) if fn is not None and not fn.missing else _array(v)
    if a.missing:
        return a
    n = F.size(a.col)
    first = F.try_element_at(a.col, F.lit(1))
    return from_column(F.when(n == 1, first).when(n > 1, raised("D3138", a.dtype)).when(n == 0, raised("D3139", a.dtype)), a.dtype)


def f_reduce(ctx, v, fn, start=None):
    a = _array(v)
    if a.missing:
        return a
    if ctx.arity(fn) < 2:
        raise EvalError("D3050")
    call = _lambda(ctx, fn, 2)
    item = lambda x: Val(x.cast("double"), DOUBLE) if isinstance(a.dtype, NUMERIC) else _of(x, a.dtype)
    dtype = DOUBLE if isinstance(a.dtype, NUMERIC) else a.dtype
    step = lambda s, x: call(Val(s, dtype), item(x)).as_column()
    if start is not None and not start.missing:
        if start.dtype != dtype:
            raise Unsupported("a fold to another type")
        return Val(F.aggregate(a.col, start.col, step), dtype)
    first = F.try_element_at(a.col, F.lit(1)).cast(dtype)
    rest = F.slice(a.col, F.lit(2), F.greatest(F.size(a.col) - 1, F.lit(0)))
    return Val(F.when(F.size(a.col) > 0, F.aggregate(rest, first, step)), dtype)


def f_sort(ctx, v, fn=None):
    a = _array(v)
    if a.missing:
        return a
    if fn is None or fn.missing:
        if not isinstance(a.dtype, (*NUMERIC, T.StringType)):
            raise EvalError("D3070")
        return Val(F.array_sort(a.col), a.dtype, True)
    call = _lambda(ctx, fn, 2)
    after = lambda p, q: truthy(call(_of(p, a.dtype), _of(q, a.dtype)))
    return Val(F.array_sort(a.col, lambda p, q: F.when(after(p, q), 1).when(after(q, p), -1).otherwise(0)), a.dtype, True)


def f_distinct(ctx, v):
    if not v.many:
        return v
    if isinstance(v.dtype, T.MapType):
        raise Unsupported("distinct maps")
    return Val(F.array_distinct(v.col), v.dtype, True)


def f_reverse(ctx, v):
    a = _array(v)
    return a if a.missing else Val(F.reverse(a.col), a.dtype, True)


def f_shuffle(ctx, v):
    a = _array(v)
    return a if a.missing else Val(F.shuffle(a.col), a.dtype, True)


def f_append(ctx, a, b):
    if a.missing:
        return b
    if b.missing:
        return a
    x, y = _array(a), _array(b)
    dtype = x.dtype
    if x.dtype != y.dtype:
        if not (isinstance(x.dtype, NUMERIC) and isinstance(y.dtype, NUMERIC)):
            raise Unsupported("arrays of two types")
        dtype = DOUBLE
        x, y = _numbers(x), _numbers(y)
    none = F.array().cast(T.ArrayType(dtype))
    both = F.concat(F.coalesce(x.col, none), F.coalesce(y.col, none))
    return Val(F.when(x.col.isNotNull() | y.col.isNotNull(), both), dtype, True)


def f_zip(ctx, *lists):
    if not lists:
        raise EvalError("T0410")
    arrays = [_array(v) for v in lists]
    if any(a.missing for a in arrays) or len({a.dtype.simpleString() for a in arrays}) > 1:
        raise Unsupported("rows of values of several types")
    n = F.coalesce(F.least(*[F.size(a.col) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0].col), F.lit(0))
    empty = F.array().cast(T.ArrayType(T.ArrayType(arrays[0].dtype)))
    rows = F.transform(F.sequence(F.lit(1), n), lambda i: F.array(*[F.element_at(a.col, i) for a in arrays]))
    return Val(F.when(n > 0, rows).otherwise(empty), T.ArrayType(arrays[0].dtype), True)


def f_keys(ctx, v):
    if v.fields is not None:
        names = [F.when(f.as_column().isNotNull(), F.lit(k)) for k, f in v.fields.items()]
        return Val(F.array_compact(F.array(*names)), STRING, True)
    if isinstance(v.dtype, T.StructType) and not v.many:
        return Val(F.array_compact(F.array(*[F.when(v.col.getField(k).isNotNull(), F.lit(k)) for k in v.dtype.names])), STRING, True)
    if isinstance(v.dtype, T.MapType) and not v.many:
        return Val(F.map_keys(v.col), STRING, True)
    raise Unsupported("keys of this value")


def f_lookup(ctx, v, key):
    if isinstance(v.dtype, T.MapType) and not v.many:
        return from_column(F.try_element_at(v.col, _text(key, 2)), v.dtype.valueType)
    if key.is_const:
        from pathframe.plans.values import field_of

        return field_of(v, key.const)
    raise Unsupported("a computed key of a struct")


def _entries(v: Val) -> list[tuple[str, Val]]:
    if v.fields is not None:
        return list(v.fields.items())
    if isinstance(v.dtype, T.StructType) and not v.many:
        return [(f.name, from_column(v.col.getField(f.name), f.dataType)) for f in v.dtype.fields]
    raise Unsupported("entries of this value")


def f_each(ctx, v, fn):
    call = _lambda(ctx, fn, 2)
    if isinstance(v.dtype, T.MapType):
        seen = {}

        def body(e):
            seen["v"] = call(from_column(e["value"], v.dtype.valueType), Val(e["key"], STRING))
            return seen["v"].as_column()

        col = F.transform(F.map_entries(v.col), body)
        return Val(F.filter(col, lambda x: x.isNotNull()), _dtype(seen["v"]), True)
    got = []
    for k, f in _entries(v):
        r = call(f, constant(k))
        got.append((F.when(f.as_column().isNotNull(), r.as_column()), _dtype(r)))
    if len({d.simpleString() for _, d in got}) != 1:
        raise Unsupported("results of several types")
    return Val(F.array_compact(F.array(*[c for c, _ in got])), got[0][1], True)


def f_sift(ctx, v, fn):
    call = _lambda(ctx, fn, 2)
    if isinstance(v.dtype, T.MapType):
        kept = F.map_filter(v.col, lambda k, x: truthy(call(from_column(x, v.dtype.valueType), Val(k, STRING))))
        return Val(F.when(F.size(kept) > 0, kept), v.dtype)
    fields = {}
    for k, f in _entries(v):
        fields[k] = Val(F.when(truthy(call(f, constant(k))), f.as_column()), _dtype(f)) if not f.many else f
    return Val(fields=fields)


def f_spread(ctx, v):
    if isinstance(v.dtype, T.MapType) and not v.many:
        return Val(F.transform(F.map_entries(v.col), lambda e: F.create_map(e["key"], e["value"])), v.dtype, True)
    entries = _entries(v)
    types = {_dtype(f).simpleString() for _, f in entries}
    if len(types) != 1:
        raise Unsupported("fields of several types")
    maps = [F.when(f.as_column().isNotNull(), F.create_map(F.lit(k), f.as_column())) for k, f in entries]
    return Val(F.array_compact(F.array(*maps)), T.MapType(STRING, _dtype(entries[0][1])), True)


def f_merge(ctx, v):
    if v.extra.get("items"):
        fields: dict[str, Val] = {}
        for item in v.extra["items"]:
            for k, f in _entries(item):
                old = fields.get(k)
                fields[k] = f if old is None or kind(old) != kind(f) else Val(F.coalesce(f.as_column(), old.as_column()), f.dtype, f.many)
        return Val(fields=fields)
    if isinstance(v.dtype, T.MapType) and v.many:
        start = F.create_map().cast(v.dtype)
        joined = lambda a, b: F.map_concat(F.map_filter(a, lambda k, x: ~F.coalesce(F.map_contains_key(b, k), F.lit(False))), b)
        return Val(F.aggregate(v.col, start, joined), v.dtype)
    raise Unsupported("merging an array of structs")


def f_flatten(ctx, v):
    col, dtype = v.col, v.dtype
    while isinstance(dtype, T.ArrayType):
        col, dtype = F.flatten(col), dtype.elementType
    return Val(col, dtype, v.many) if v.many else v


def f_clone(ctx, v):
    return v


def f_to_millis(ctx, v, picture=None):
    if picture is not None and not picture.missing:
        at = F.try_to_timestamp(_text(v), F.lit(_java_date(_literal(picture, "a picture"))))
        return Val(F.unix_millis(at).cast("double"), DOUBLE)
    if "timestamp" in v.extra:
        return Val(F.unix_millis(v.extra["timestamp"]).cast("double"), DOUBLE)
    s = _text(v)
    fits = F.regexp_like(s, F.lit(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?(T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"))
    full = F.when(F.length(s) == 4, F.concat(s, F.lit("-01-01"))).when(F.length(s) == 7, F.concat(s, F.lit("-01"))).otherwise(s)
    full = F.regexp_replace(full, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    at = F.when(fits, F.try_to_timestamp(F.when(F.regexp_like(full, F.lit(r"T.*(Z|[+-]..:..)$")), full).otherwise(F.concat(full, F.lit(""))) ))
    return Val(F.when(s.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(F.unix_millis(at).cast("double"), raised("D3110", DOUBLE))), DOUBLE)


# Components of date pictures and Java's letters for them.
JAVA_DATE = {
    "Y0001": "yyyy", "Y": "y", "M01": "MM", "M": "M", "M1": "M", "D01": "dd", "D": "d", "D1": "d", "H01": "HH", "H": "H", "H1": "H", "h01": "hh", "h": "h", "h1": "h",
    "m01": "mm", "m": "mm", "s01": "ss", "s": "ss", "f001": "SSS", "MNn": "MMMM", "MNn,3-3": "MMM", "FNn": "EEEE", "FNn,3-3": "EEE", "d001": "DDD", "Y0001,4-4": "yyyy", "d": "D",
}


def _java_date(picture: str) -> str:
    import re

    out = []
    for literal, marker in re.findall(r"([^\[\]]+)|\[([^\]]*)\]", picture):
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
        elif marker in JAVA_DATE:
            out.append(JAVA_DATE[marker])
        else:
            raise Unsupported(f"the date component [{marker}]")
    return "".join(out)


def f_from_millis(ctx, v, picture=None, zone=None):
    if zone is not None and not zone.missing:
        raise Unsupported("a time zone")
    at = F.timestamp_millis(_number(v).cast("bigint"))
    if picture is None or picture.missing:
        return Val(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), STRING)
    return Val(F.date_format(at, _java_date(_literal(picture, "a picture"))), STRING)


def f_now(ctx, picture=None, zone=None):
    from pathframe.functions import dates

    if picture is not None and not picture.missing:
        return constant(dates.from_millis(ctx.now, _literal(picture, "a picture"), *([] if zone is None or zone.missing else [_literal(zone, "a zone")])))
    return constant(dates.from_millis(ctx.now))


def f_millis(ctx):
    return constant(ctx.now)


def f_random(ctx):
    return Val(F.rand(), DOUBLE)


#: Name: builder, fewest and most arguments, whether a lacking first one is the context.
FUNCTIONS: dict[str, tuple[Any, int, int, bool]] = {
    "sum": (f_sum, 1, 1, False), "count": (f_count, 1, 1, False), "max": (f_max, 1, 1, False), "min": (f_min, 1, 1, False), "average": (f_average, 1, 1, False),
    "string": (f_string, 1, 2, True), "length": (f_length, 1, 1, True), "substring": (f_substring, 2, 3, True), "substringBefore": (f_before, 2, 2, True),
    "substringAfter": (f_after, 2, 2, True), "lowercase": (f_lower, 1, 1, True), "uppercase": (f_upper, 1, 1, True), "trim": (f_trim, 1, 1, True),
    "pad": (f_pad, 2, 3, True), "contains": (f_contains, 2, 2, True), "split": (f_split, 2, 3, True), "replace": (f_replace, 3, 4, True), "match": (f_match, 2, 3, True),
    "join": (f_join, 1, 2, False), "base64encode": (f_base64encode, 1, 1, True), "base64decode": (f_base64decode, 1, 1, True),
    "encodeUrlComponent": (f_encode_component, 1, 1, True), "encodeUrl": (f_encode_url, 1, 1, True), "decodeUrlComponent": (f_decode_component, 1, 1, True), "decodeUrl": (f_decode_url, 1, 1, True),
    "formatBase": (f_format_base, 1, 2, True), "number": (f_number, 1, 1, True), "abs": (_numeric(F.abs), 1, 1, True), "floor": (_numeric(F.floor), 1, 1, True),
    "ceil": (_numeric(F.ceil), 1, 1, True), "round": (f_round, 1, 2, True), "sqrt": (f_sqrt, 1, 1, True), "power": (f_power, 2, 2, True), "random": (f_random, 0, 0, False),
    "boolean": (f_boolean, 1, 1, True), "not": (f_not, 1, 1, True), "exists": (f_exists, 1, 1, False), "type": (f_type, 1, 1, False), "error": (f_error, 0, 1, False),
    "assert": (f_assert, 1, 2, False), "map": (f_map, 2, 2, False), "filter": (f_filter, 2, 2, False), "single": (f_single, 1, 2, False), "reduce": (f_reduce, 2, 3, False),
    "sort": (f_sort, 1, 2, False), "distinct": (f_distinct, 1, 1, False), "reverse": (f_reverse, 1, 1, False), "shuffle": (f_shuffle, 1, 1, False),
    "append": (f_append, 2, 2, False), "zip": (f_zip, 0, 99, False), "keys": (f_keys, 1, 1, True), "lookup": (f_lookup, 2, 2, True), "each": (f_each, 2, 2, True),
    "sift": (f_sift, 2, 2, True), "spread": (f_spread, 1, 1, True), "merge": (f_merge, 1, 1, False), "flatten": (f_flatten, 1, 1, True), "clone": (f_clone, 1, 1, True),
    "toMillis": (f_to_millis, 1, 2, True), "fromMillis": (f_from_millis, 1, 3, True), "now": (f_now, 0, 2, False), "millis": (f_millis, 0, 0, False),
}
