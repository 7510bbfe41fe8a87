"""Expressions over one typed row, lowered to a Column of built-in functions.

What can't be typed raises :class:`Unsupported`; :func:`as_column` then runs
the document evaluator over the row as JSON instead.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathframe.errors import EvalError
from pathframe.plans.functions import FUNCTIONS, _dtype
from pathframe.plans.values import (
    BOOLEAN,
    DOUBLE,
    MISSING,
    NUMERIC,
    STRING,
    Unsupported,
    Val,
    constant,
    field_of,
    from_column,
    kind,
    need_number,
    raised,
    text_of,
    truthy,
)
from pathframe.syntax import Node, parse


#: Built-ins that only the document evaluator has.
DYNAMIC = frozenset({"formatNumber", "formatInteger", "parseInteger", "eval"})


@dataclass
class Scope:
    """Names, the context item, the root, and the items above it."""

    item: Val
    root: Val
    names: dict[str, Val] = field(default_factory=dict)
    up: Scope | None = None
    parents: dict[str, Val] = field(default_factory=dict)

    def get(self, name: str) -> Val | None:
        s: Scope | None = self
        while s is not None:
            if name in s.names:
                return s.names[name]
            s = s.up
        return None

    def parent(self, label: str) -> Val | None:
        s: Scope | None = self
        while s is not None:
            if label in s.parents:
                return s.parents[label]
            s = s.up
        return None


@dataclass
class Closure:
    node: Node
    scope: Scope


@dataclass
class Builtin:
    name: str


@dataclass
class PartialCall:
    fn: Val
    args: list[Val | None]


class ColumnCompiler:
    """Lowers nodes; ``functions`` are registered Column builders by name."""

    def __init__(self, functions: dict[str, Any] | None = None, now: float | None = None, relations: Any = None):
        self.functions = functions or {}
        self.now = float(int(time.time() * 1000)) if now is None else now
        self.depth = 0
        #: Hook of the relational tier for paths that leave the row.
        self.relations = relations

    # -- entry

    def lower(self, n: Node, s: Scope) -> Val:
        v = self._kind(n, s)
        if n.kind != "path":
            for stage in n.stages or ():
                v = self.filter(v, stage, s)
            if n.group is not None:
                raise Unsupported("grouping inside a row")
        return v

    def _kind(self, n: Node, s: Scope) -> Val:
        method = getattr(self, f"_{n.kind}", None)
        if method is None:
            raise Unsupported(n.kind)
        return method(n, s)

    # -- leaves

    def _string(self, n: Node, s: Scope) -> Val:
        return constant(n.value)

    _number = _value = _string

    def _regex(self, n: Node, s: Scope) -> Val:
        return Val(fn=n.value)

    def _name(self, n: Node, s: Scope) -> Val:
        return field_of(s.item, n.value)

    def _variable(self, n: Node, s: Scope) -> Val:
        if n.value == "":
            return s.item
        if n.value == "$":
            return s.root
        got = s.get(n.value)
        if got is not None:
            return got
        if n.value in self.functions or n.value in FUNCTIONS or n.value in DYNAMIC:
            return Val(fn=Builtin(n.value))
        return MISSING

    def _parent(self, n: Node, s: Scope) -> Val:
        got = s.parent(n.slot.label)
        if got is None:
            raise Unsupported("the parent of this step")
        return got

    def _wildcard(self, n: Node, s: Scope) -> Val:
        return self._values(s.item)

    def _values(self, v: Val) -> Val:
        if v.fields is None and isinstance(v.dtype, T.MapType) and not v.many:
            return from_column(F.map_values(v.col), T.ArrayType(v.dtype.valueType))
        if v.fields is not None:
            parts = list(v.fields.values())
        elif isinstance(v.dtype, T.StructType) and not v.many:
            parts = [from_column(v.col.getField(f.name), f.dataType) for f in v.dtype.fields]
        else:
            raise Unsupported("a wildcard over this value")
        return self._gather(parts)

    def _gather(self, parts: list[Val]) -> Val:
        """All items of several values as one array; numbers as doubles."""
        parts = [p for p in parts if not p.missing]
        if not parts:
            return MISSING
        types = {p.dtype.simpleString() if p.fields is None else "struct" for p in parts}
        if all(isinstance(p.dtype, NUMERIC) for p in parts) and len(types) > 1:
            parts = [Val(F.transform(p.col, lambda x: x.cast("double")), DOUBLE, True) if p.many else Val(p.double(), DOUBLE) for p in parts]
            types = {"double"}
        if len(types) > 1:
            raise Unsupported("values of several types in one array")
        dtype = _dtype(Val(parts[0].col, parts[0].dtype, False, parts[0].fields))
        if not any(p.many for p in parts):
            return Val(F.array_compact(F.array(*[p.as_column() for p in parts])), dtype, True)
        none = F.array().cast(T.ArrayType(dtype))
        lists = [F.coalesce(p.col, none) if p.many else F.array_compact(F.array(p.as_column())) for p in parts]
        return Val(F.concat(*lists), dtype, True, extra={"found": True})

    def _descendants(self, n: Node, s: Scope) -> Val:
        raise Unsupported("descendants without a name")

    def _find(self, v: Val, name: str) -> list[Val]:
        """Every field of that name in the schema below, outer ones first."""
        out = []
        got = field_of(v, name)
        if not got.missing:
            out.append(got)
        if v.fields is not None:
            names = list(v.fields)
        elif isinstance(v.dtype, T.StructType):
            names = v.dtype.names
        else:
            names = []
        for k in names:
            inner = field_of(v, k)
            if inner.fields is not None or isinstance(inner.dtype, T.StructType):
                out += self._find(inner, name)
        return out

    # -- operators

    def _neg(self, n: Node, s: Scope) -> Val:
        v = self.lower(n.arg, s)
        return v if v.missing else Val(-need_number(v, "D1002"), DOUBLE)

    def _op(self, n: Node, s: Scope) -> Val:
        op = n.op
        if op in ("and", "or"):
            a, b = truthy(self.lower(n.lhs, s)), truthy(self.lower(n.rhs, s))
            # The right side is only reached where the left leaves it open.
            return Val(F.when(a, b).otherwise(F.lit(False)) if op == "and" else F.when(a, F.lit(True)).otherwise(b), BOOLEAN)
        if op == "in" and self.relations is not None:
            got = self.relations.membership(n, s)
            if got is not None:
                return got
        a, b = self.lower(n.lhs, s), self.lower(n.rhs, s)
        if op in "+-*/%":
            x, y = need_number(a, "T2001"), need_number(b, "T2002")
            if op == "/":
                inf = F.lit(float("inf"))
                zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, inf).otherwise(-inf)
                return Val(F.when(y == 0, zero).otherwise(F.try_divide(x, y)), DOUBLE, extra={"nan": True})
            if op == "%":
                return Val(F.when(y == 0, F.lit(float("nan"))).otherwise(F.try_mod(x, y)), DOUBLE, extra={"nan": True})
            odd = {"nan": True} if a.extra.get("nan") or b.extra.get("nan") else {}
            return Val(x + y if op == "+" else x - y if op == "-" else x * y, DOUBLE, extra=odd)
        if op == "&":
            texts = [F.coalesce(text_of(v), F.lit("")) if not v.missing else F.lit("") for v in (a, b)]
            return Val(F.concat(*texts), STRING)
        if op in ("=", "!="):
            return self.equality(a, b, op == "=")
        if op == "in":
            return self.contains(a, b)
        for v in (a, b):
            if not v.missing and not v.many and kind(v) not in ("number", "string"):
                raise EvalError("T2010", kind(v), n.pos)
        if a.missing or b.missing:
            return Val(F.lit(None).cast("boolean"), BOOLEAN)
        if a.many or b.many:
            raise Unsupported("comparing arrays")
        if kind(a) != kind(b):
            raise EvalError("T2009", f"{kind(a)} and {kind(b)}", n.pos)
        x, y = (a.col, b.col) if not a.number else self._alike(a, b)
        test = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if a.extra.get("nan") or b.extra.get("nan"):
            # For Spark not-a-number is the largest and equals itself; here it compares with nothing.
            test = F.when(F.isnan(x.cast("double")) | F.isnan(y.cast("double")), F.lit(False)).otherwise(test)
        return Val(test, BOOLEAN)

    @staticmethod
    def _alike(a: Val, b: Val) -> tuple[Column, Column]:
        """Two numbers of one type; whole constants take the column's type, so that filters reach the scan."""
        for v, w in ((a, b), (b, a)):
            if w.is_const and isinstance(w.const, float) and w.const == int(w.const) and isinstance(v.dtype, (T.IntegerType, T.LongType)) and abs(w.const) < 2**31:
                c = F.lit(int(w.const)).cast(v.dtype)
                return (v.col, c) if v is a else (c, v.col)
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        if isinstance(a.dtype, whole) and isinstance(b.dtype, whole):
            return a.col, b.col
        return a.double(), b.double()

    def equality(self, a: Val, b: Val, wanted: bool) -> Val:
        if a.missing or b.missing:
            return constant(False)
        if a.many and b.many:
            if a.dtype == b.dtype:
                x, y = a.col, b.col
            elif isinstance(a.dtype, NUMERIC) and isinstance(b.dtype, NUMERIC):
                x, y = a.col.cast("array<double>"), b.col.cast("array<double>")
            else:
                raise Unsupported("equality of arrays of two types")
            return Val(F.coalesce(x == y if wanted else x != y, F.lit(False)), BOOLEAN)
        if a.many or b.many:
            raise Unsupported("equality of one and many")
        if kind(a) != kind(b):
            there = a.as_column().isNotNull() & b.as_column().isNotNull()
            nulls = any(v.is_const and v.const is None for v in (a, b))
            return constant(False) if wanted else (constant(True) if nulls else Val(there, BOOLEAN))
        if a.number:
            x, y = self._alike(a, b)
        elif isinstance(a.dtype, T.MapType):
            raise Unsupported("equality of maps")
        else:
            x, y = a.as_column(), b.as_column()
        if a.is_const and a.const is None:
            return constant(wanted)
        return Val(F.coalesce(x == y if wanted else x != y, F.lit(False)), BOOLEAN)

    def contains(self, a: Val, b: Val) -> Val:
        if a.missing or b.missing:
            return constant(False)
        if a.many:
            raise Unsupported("membership of an array")
        items = b.extra.get("items")
        if items is not None and all(i.is_const for i in items):
            fitting = [i.const for i in items if kind(i) == kind(a)]
            col = a.double() if a.number else a.col
            return Val(F.coalesce(col.isin(fitting), F.lit(False)) if fitting else F.lit(False), BOOLEAN)
        if not b.many:
            return self.equality(a, b, True)
        if a.number and isinstance(b.dtype, NUMERIC):
            return Val(F.coalesce(F.array_contains(b.col.cast("array<double>"), a.double()), F.lit(False)), BOOLEAN)
        if a.dtype != b.dtype:
            return constant(False)
        return Val(F.coalesce(F.array_contains(b.col, a.col), F.lit(False)), BOOLEAN)

    # -- choices

    def _merge(self, test: Column, a: Val, b: Val) -> Val:
        if a.missing and b.missing:
            return MISSING
        if a.fields is not None or b.fields is not None:
            if a.missing or b.missing or a.fields is None or b.fields is None:
                v = a if b.missing else b
                if not (a.missing or b.missing):
                    raise Unsupported("a choice between an object and something else")
                return Val(fields={k: self._merge(test, f, MISSING) if b.missing else self._merge(test, MISSING, f) for k, f in v.fields.items()})
            names = list(dict.fromkeys([*a.fields, *b.fields]))
            return Val(fields={k: self._merge(test, a.fields.get(k, MISSING), b.fields.get(k, MISSING)) for k in names})
        if a.missing or b.missing:
            v = b if a.missing else a
            none = F.lit(None).cast(_dtype(v))
            return Val(F.when(test, v.col if not a.missing else none).otherwise(v.col if not b.missing else none), v.dtype, v.many)
        if a.many != b.many:
            raise Unsupported("a choice between one and many")
        if a.dtype == b.dtype:
            return Val(F.when(test, a.col).otherwise(b.col), a.dtype, a.many)
        if a.number and b.number:
            return Val(F.when(test, a.double()).otherwise(b.double()), DOUBLE)
        raise Unsupported("a choice between two types")

    def _cond(self, n: Node, s: Scope) -> Val:
        test = self.lower(n.test, s)
        then = self.lower(n.then, s)
        other = self.lower(n.other, s) if n.other is not None else MISSING
        if test.is_const:
            return then if test.const else other
        return self._merge(truthy(test), then, other)

    def _elvis(self, n: Node, s: Scope) -> Val:
        a, b = self.lower(n.lhs, s), self.lower(n.rhs, s)
        return b if a.missing else self._merge(truthy(a), a, b)

    def _coalesce(self, n: Node, s: Scope) -> Val:
        a, b = self.lower(n.lhs, s), self.lower(n.rhs, s)
        if a.missing:
            return b
        if a.is_const or a.fields is not None:
            return a
        return self._merge(F.size(a.col) > 0 if a.many else a.col.isNotNull(), a, b)

    # -- construction

    def _object(self, n: Node, s: Scope) -> Val:
        if s.item.many:
            raise Unsupported("grouping an array inside a row")
        if all(k.kind == "string" for k, _ in n.pairs):
            return Val(fields={k.value: self.lower(v, s) for k, v in n.pairs})
        pairs = [(self.lower(k, s), self.lower(v, s)) for k, v in n.pairs]
        for k, _ in pairs:
            if not k.missing and not k.string:
                raise EvalError("T1003", kind(k))
        kinds = {_dtype(v).simpleString() for _, v in pairs}
        if len(kinds) != 1:
            raise Unsupported("computed keys with values of several types")
        entries = F.array(*[F.when(k.col.isNotNull() & v.as_column().isNotNull(), F.struct(k.col.alias("key"), v.as_column().alias("value"))) for k, v in pairs])
        return Val(F.map_from_entries(F.array_compact(entries)), T.MapType(STRING, _dtype(pairs[0][1])))

    def _array(self, n: Node, s: Scope) -> Val:
        parts = []
        for i in n.items:
            v = self.lower(i, s)
            if i.kind == "array":
                v = Val(v.col, T.ArrayType(v.dtype, False), False) if not v.missing else Val(F.array().cast("array<array<string>>"), T.ArrayType(T.ArrayType(STRING)), False)
            parts.append(v)
        if not parts:
            return Val(F.array().cast("array<string>"), STRING, True, extra={"items": []})
        out = self._gather(parts)
        if out.missing:
            return Val(F.array().cast("array<string>"), STRING, True, extra={"items": []})
        out.extra["items"] = parts
        return out

    def _range(self, n: Node, s: Scope) -> Val:
        a, b = self.lower(n.lhs, s), self.lower(n.rhs, s)
        for v, code in ((a, "T2003"), (b, "T2004")):
            if not v.missing and (not v.number or v.is_const and v.const != int(v.const)):
                raise EvalError(code, kind(v))
        if a.missing or b.missing:
            return MISSING
        x, y = a.double(), b.double()
        numbers = F.transform(F.sequence(x.cast("bigint"), y.cast("bigint")), lambda v: v.cast("double"))
        fails = F.when(x != F.floor(x), raised("T2003", T.ArrayType(DOUBLE))).when(y != F.floor(y), raised("T2004", T.ArrayType(DOUBLE)))
        return Val(fails.when(y - x >= 10_000_000, raised("D2014", T.ArrayType(DOUBLE))).when(x <= y, numbers), DOUBLE, True)

    # -- scopes and functions

    def _block(self, n: Node, s: Scope) -> Val:
        inner = Scope(s.item, s.root, {}, s)
        out = MISSING
        for p in n.parts:
            out = self.lower(p, inner)
        return out

    def _bind(self, n: Node, s: Scope) -> Val:
        v = s.names[n.name] = self.lower(n.value, s)
        return v

    def _lambda(self, n: Node, s: Scope) -> Val:
        return Val(fn=Closure(n, s))

    def _partial(self, n: Node, s: Scope) -> Val:
        fn = self.lower(n.fn, s)
        if fn.fn is None:
            raise EvalError("T1008", position=n.pos)
        return Val(fn=PartialCall(fn, [None if a.kind == "hole" else self.lower(a, s) for a in n.args]))

    def arity(self, v: Val) -> int:
        f = v.fn
        if isinstance(f, Closure):
            return len(f.node.params)
        if isinstance(f, PartialCall):
            return sum(a is None for a in f.args)
        if isinstance(f, Builtin):
            return 1 if f.name == "string" else FUNCTIONS[f.name][2] if f.name in FUNCTIONS else 1
        return 1

    def invoke(self, v: Val, args: list[Val], s: Scope | None = None) -> Val:
        f = v.fn
        if isinstance(f, Closure):
            self.depth += 1
            if self.depth > 60:
                raise Unsupported("recursion")
            try:
                names = dict(zip(f.node.params, [*args, *[MISSING] * len(f.node.params)], strict=False))
                return self.lower(f.node.body, Scope(f.scope.item, f.scope.root, names, f.scope))
            finally:
                self.depth -= 1
        if isinstance(f, PartialCall):
            rest = iter(args)
            return self.invoke(f.fn, [next(rest, MISSING) if a is None else a for a in f.args], s)
        if isinstance(f, Builtin):
            if f.name in self.functions:
                return self._registered(f.name, args)
            if f.name not in FUNCTIONS:
                raise Unsupported(f"${f.name} over columns")
            build, least, most, context = FUNCTIONS[f.name]
            if context and s is not None and len(args) == least - 1:
                args = [s.item, *args]
            if not least <= len(args) <= most:
                raise EvalError("T0410", f.name)
            return build(self, *args)
        if callable(f):
            return f(*args)
        raise EvalError("T1006")

    def _registered(self, name: str, args: list[Val]) -> Val:
        fn, returns = self.functions[name]
        return from_column(fn(*[a.double() if a.number else a.as_column() for a in args]), returns)

    def _call(self, n: Node, s: Scope, before: list[Val] | None = None) -> Val:
        fn = n.fn
        if fn.kind == "variable" and fn.value == "eval" and s.get("eval") is None:
            return self._eval(n, s)
        callee = self.lower(fn, s)
        if callee.fn is None or isinstance(callee.fn, tuple):
            if callee.missing and fn.kind == "path" and len(fn.steps) == 1 and (fn.steps[0].value in FUNCTIONS or s.get(fn.steps[0].value) is not None):
                raise EvalError("T1005", position=n.pos)
            if fn.kind == "variable" and fn.value and s.get(fn.value) is None:
                raise Unsupported(f"${fn.value}")
            raise EvalError("T1006", position=n.pos)
        if self.relations is not None and isinstance(callee.fn, Builtin):
            got = self.relations.aggregate(callee.fn.name, n, s, before)
            if got is not None:
                return got
        return self.invoke(callee, [*(before or []), *[self.lower(a, s) for a in n.args]], s)

    def _eval(self, n: Node, s: Scope) -> Val:
        source = self.lower(n.args[0], s)
        if not source.is_const:
            raise Unsupported("$eval of data")
        inner = s
        if len(n.args) > 1:
            inner = Scope(self.lower(n.args[1], s), s.root, {}, s)
        return self.lower(parse(source.const), inner)

    def _chain(self, n: Node, s: Scope) -> Val:
        a = self.lower(n.lhs, s)
        if n.rhs.kind == "call":
            return self._call(n.rhs, s, [a])
        if n.rhs.kind == "transform":
            return self.transform(n.rhs, a, s)
        b = self.lower(n.rhs, s)
        if b.fn is None or isinstance(b.fn, tuple):
            raise EvalError("T2006", position=n.pos)
        if a.fn is not None:
            return Val(fn=lambda *args: self.invoke(b, [self.invoke(a, list(args)[:1], s)], s))
        return self.invoke(b, [a], s)

    def _transform(self, n: Node, s: Scope) -> Val:
        return Val(fn=lambda v, *rest: self.transform(n, v, s))

    def transform(self, n: Node, v: Val, s: Scope) -> Val:
        """Nested update at a static path of fields, with a predicate at its end."""
        if n.pattern.kind == "variable" and n.pattern.value == "":
            path, tests = [], n.pattern.stages or []
        elif n.pattern.kind == "path" and n.pattern.group is None and all(p.kind == "name" for p in n.pattern.steps):
            path, tests = [p.value for p in n.pattern.steps], n.pattern.steps[-1].stages or []
            if any(p.stages for p in n.pattern.steps[:-1]):
                raise Unsupported("a predicate inside a pattern")
        else:
            raise Unsupported("this pattern of a transform")
        return self._at(v, path, lambda m: self._updated(m, n, tests, s))

    def _at(self, v: Val, path: list[str], change) -> Val:
        if v.many:
            inner = v.dtype
            seen: dict[str, Val] = {}

            def body(x: Column) -> Column:
                seen["v"] = self._at(Val(x, inner), path, change)
                return seen["v"].as_column()

            col = F.transform(v.col, body)
            return Val(col, _dtype(seen["v"]), True)
        if not path:
            return change(v)
        fields = self._fields(v)
        if fields is None:
            raise Unsupported("updating what isn't a struct")
        if path[0] in fields:
            fields = {**fields, path[0]: self._at(fields[path[0]], path[1:], change)}
        return Val(fields=fields)

    @staticmethod
    def _fields(v: Val) -> dict[str, Val] | None:
        if v.fields is not None:
            return dict(v.fields)
        if isinstance(v.dtype, T.StructType):
            return {f.name: from_column(v.col.getField(f.name), f.dataType) for f in v.dtype.fields}
        return None

    def _updated(self, m: Val, n: Node, tests: list, s: Scope) -> Val:
        inner = Scope(m, s.root, {}, s)
        cond = F.lit(True)
        for what, test in tests:
            if what != "filter" or test.kind == "number":
                raise Unsupported("a position in a pattern")
            cond = cond & truthy(self.lower(test, inner))
        old = self._fields(m)
        if old is None:
            raise Unsupported("updating what isn't a struct")
        new = self.lower(n.update, inner)
        if new.fields is None:
            if new.missing:
                new = Val(fields={})
            elif kind(new) != "object":
                raise EvalError("T2011", kind(new))
            else:
                raise Unsupported("an update that isn't a literal object")
        gone: list[str] = []
        if n.delete is not None:
            d = self.lower(n.delete, inner)
            items = d.extra.get("items", [d])
            for i in items:
                if not (i.is_const and isinstance(i.const, str)):
                    if i.is_const:
                        raise EvalError("T2012")
                    raise Unsupported("computed deletions")
                gone.append(i.const)
        whole = not tests
        fields: dict[str, Val] = dict(old)
        for k, v in new.fields.items():
            fields[k] = v if whole else self._merge(cond, v, old.get(k, MISSING))
        for k in gone:
            if k in fields:
                if whole:
                    del fields[k]
                else:
                    fields[k] = self._merge(cond, MISSING, fields[k])
        return Val(fields=fields)

    # -- paths

    def _path(self, n: Node, s: Scope) -> Val:
        if self.relations is not None:
            got = self.relations.path(n, s)
            if got is not None:
                return got
        if n.group is not None:
            raise Unsupported("grouping inside a row")
        v, steps = s.item, list(n.steps)
        scope = s
        i = 0
        while i < len(steps):
            step = steps[i]
            if step.focus or step.index:
                raise Unsupported("bindings inside a row")
            if step.kind == "descendants" and i + 1 < len(steps) and steps[i + 1].kind == "name" and not step.stages:
                v = self._gather(self._find(v, steps[i + 1].value))
                for stage in steps[i + 1].stages or ():
                    v = self.filter(v, stage, scope)
                i += 2
                continue
            v = self.step(step, v, scope, first=i == 0)
            i += 1
            if v.missing:
                return MISSING
        return v

    def step(self, n: Node, v: Val, s: Scope, first: bool) -> Val:
        if n.kind == "sort":
            out = self.sorted(n, v, s)
        elif n.kind == "name":
            if n.stages and v.many and any(t.kind == "number" or self._numeric(t, v, n, s) for _, t in n.stages):
                return self._each(n, v, s)
            out = field_of(v, n.value)
            if n.ancestor is not None:
                raise Unsupported("a parent inside a row")
        elif first and not v.many:
            out = self._kind(n, s)
        else:
            return self._each(n, v, s)
        for stage in n.stages or ():
            out = self.filter(out, stage, s)
        return out

    def _numeric(self, test: Node, v: Val, n: Node, s: Scope) -> bool:
        return test.kind in ("array", "neg") or test.kind == "op" and test.op in "+-*/%"

    def _each(self, n: Node, v: Val, s: Scope) -> Val:
        """A step for every item, with its own predicates."""
        bare = Node(n.kind, n.pos, **{k: x for k, x in n.__dict__.items() if k not in ("kind", "pos", "stages")})
        inner_kind = "name" if n.kind == "name" else n.kind

        def of(item: Val) -> Val:
            inner = Scope(item, s.root, {}, s)
            got = field_of(item, n.value) if inner_kind == "name" else self._kind(bare, inner)
            for stage in n.stages or ():
                got = self.filter(got, stage, inner)
            return got

        if not v.many:
            return of(v)
        seen: dict[str, Val] = {}

        def body(x: Column) -> Column:
            seen["v"] = of(from_column(x, v.dtype))
            return seen["v"].as_column()

        col = F.transform(v.col, body)
        got = seen["v"]
        if got.missing:
            return MISSING
        col = F.filter(col, lambda x: x.isNotNull())
        if got.many and n.kind != "array":
            return Val(F.flatten(col), got.dtype, True, extra={"found": True})
        return Val(col, _dtype(got), True, extra={"found": True})

    def filter(self, v: Val, stage: tuple[str, Any], s: Scope) -> Val:
        what, test = stage
        if what != "filter":
            raise Unsupported("positions inside a row")
        if v.missing:
            return v
        if test.kind == "number":
            k = int(test.value // 1)
            if not v.many:
                return v if k in (0, -1) else MISSING
            at = F.try_element_at(v.col, F.lit(k + 1 if k >= 0 else k))
            return from_column(at, v.dtype)
        if test.kind == "array" and len(test.items) == 1 and test.items[0].kind == "range" or test.kind == "array" and all(i.kind == "number" for i in test.items):
            if not v.many:
                raise Unsupported("a slice of one value")
            return self._slice(v, test, s)
        if not v.many:
            t = self.lower(test, Scope(v, s.root, {}, s))
            if t.number:
                raise Unsupported("a computed position in one value")
            keep = truthy(t)
            if v.fields is not None:
                return self._merge(keep, v, MISSING)
            return Val(F.when(keep, v.col), v.dtype)
        probe: dict[str, Val] = {}

        def body(x: Column) -> Column:
            probe["v"] = self.lower(test, Scope(from_column(x, v.dtype), s.root, {}, s))
            return truthy(probe["v"])

        kept = F.filter(v.col, body)
        got = probe["v"]
        if got.number or got.many and isinstance(got.dtype, NUMERIC):
            raise Unsupported("a computed position")
        return Val(kept, v.dtype, True, extra={"found": True})

    def _slice(self, v: Val, test: Node, s: Scope) -> Val:
        first = test.items[0]
        if first.kind == "range":
            a, b = self.lower(first.lhs, s), self.lower(first.rhs, s)
            if not (a.is_const and b.is_const and a.const >= 0):
                raise Unsupported("a slice with computed or negative ends")
            return Val(F.slice(v.col, int(a.const) + 1, max(0, int(b.const) - int(a.const) + 1)), v.dtype, True)
        n = F.size(v.col)
        wanted = [F.lit(int(i.value // 1)) for i in test.items]
        return Val(F.filter(v.col, lambda x, i: F.array_contains(F.array(*[F.when(w < 0, w + n).otherwise(w) for w in wanted]), i)), v.dtype, True)

    def sorted(self, n: Node, v: Val, s: Scope) -> Val:
        if not v.many:
            return v

        def keys(x: Column) -> list[tuple[Val, bool]]:
            return [(self.lower(t, Scope(from_column(x, v.dtype), s.root, {}, s)), down) for t, down in n.terms]

        def order(a: Column, b: Column) -> Column:
            out = None
            for (p, down), (q, _) in zip(keys(a), keys(b), strict=True):
                if p.many or kind(p) not in ("number", "string"):
                    raise EvalError("T2008", kind(p)) if not p.many else Unsupported("ordering by arrays")
                less, more = (F.lit(1), F.lit(-1)) if down else (F.lit(-1), F.lit(1))
                c = F.when(p.col.isNull() & q.col.isNull(), 0).when(p.col.isNull(), 1).when(q.col.isNull(), -1).when(p.col < q.col, less).when(p.col > q.col, more).otherwise(0)
                out = c if out is None else F.when(out != 0, out).otherwise(c)
            return out

        # Equal items keep their order: the place is the last key.
        placed = F.transform(v.col, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        both = F.array_sort(placed, lambda a, b: self._then(order(a["x"], b["x"]), a["i"] - b["i"]))
        return Val(F.transform(both, lambda p: p["x"]), v.dtype, True)

    @staticmethod
    def _then(first: Column, second: Column) -> Column:
        return F.when(first != 0, first).otherwise(second)


def row_of(source: DataFrame | T.StructType) -> Val:
    schema = source.schema if isinstance(source, DataFrame) else source
    get = (lambda c: source[c]) if isinstance(source, DataFrame) else F.col
    return Val(fields={f.name: from_column(get(f"`{f.name}`"), f.dataType) for f in schema.fields})


def lower_row(expression: Any, source: DataFrame | T.StructType) -> Val:
    row = row_of(source)
    scope = Scope(row, row, {k: constant(v) for k, v in expression._names.items() if isinstance(v, (str, float, bool)) or v is None})
    functions = {k: v.column for k, v in expression._names.items() if getattr(v, "column", None)}
    return ColumnCompiler(functions).lower(expression.tree, scope)


def as_column(expression: Any, source: DataFrame | T.StructType, strict: bool = False) -> Column:
    """The expression's value for each row; JSON text by the document evaluator where types don't suffice."""
    try:
        return lower_row(expression, source).as_column()
    except Unsupported:
        if strict:
            raise
        from pathframe.operators.documents import document_column

        names = source.columns if isinstance(source, DataFrame) else source.names
        return document_column(expression, F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
