"""Paths over tables, lowered to DataFrame operators.

A relation is a DataFrame with, beside its columns, what the expression calls
its item, its variables and its parents: Columns over it.  Steps change the
item; only filters, joins, unnesting, ordering and limits touch the DataFrame,
so Catalyst sees one plan over the scans.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from pathframe.errors import EvalError
from pathframe.operators.intervals import interval_join
from pathframe.operators.ordinal import with_ordinal
from pathframe.operators.documents import node_column
from pathframe.plans.column import Builtin, Closure, ColumnCompiler, Scope, from_column
from pathframe.plans.functions import _dtype
from pathframe.plans.values import DOUBLE, MISSING, NUMERIC, Unsupported, Val, constant, field_of, kind, truthy
from pathframe.sources.catalog import Catalog
from pathframe.syntax import Node

_fresh = count()


@dataclass
class Rel:
    df: DataFrame
    item: Val
    names: dict[str, Val] = field(default_factory=dict)
    parents: dict[str, Val] = field(default_factory=dict)
    #: Keys, and whether they go down.
    order: list[tuple[Column, bool]] | None = None
    #: Whether the order's last key is one for ties, and whether the result is to come in this order.
    extra_key: bool = False
    asked: bool = False
    #: The DataFrame before the filters in ``conds``, for aggregates to share.
    base: DataFrame | None = None
    conds: list[Column] = field(default_factory=list)
    label: str = "value"
    #: Whether the context is the catalog again, after a binding.
    at_root: bool = False
    #: Whether rows still come in the order of the table's files.
    as_read: bool = False

    def changed(self, df: DataFrame, **more: Any) -> Rel:
        return replace(self, df=df, base=df, conds=[], **more)

    def placed(self) -> Rel:
        """With a last key of the order for ties: the place in the table, or after a shuffle a hash of the row."""
        if not self.order or self.extra_key:
            return self
        c = f"_{next(_fresh)}"
        hashed = [F.col(f"`{f.name}`") for f in self.df.schema.fields if "map<" not in f.dataType.simpleString()]
        tie = F.monotonically_increasing_id() if self.as_read or not hashed else F.xxhash64(*hashed)
        return self.changed(self.df.withColumn(c, tie), order=[*self.order, (F.col(c), False)], extra_key=True)

    def where(self, cond: Column) -> Rel:
        return replace(self, df=self.df.where(cond), base=self.base if self.base is not None else self.df, conds=[*self.conds, cond])


def _mentions(n: Any, what: str, value: str) -> bool:
    """Whether a node of this kind and value is in the tree."""
    if isinstance(n, Node):
        if n.kind == what and n.__dict__.get("value") == value:
            return True
        return any(_mentions(v, what, value) for v in n.__dict__.values())
    return isinstance(n, (list, tuple)) and any(_mentions(v, what, value) for v in n)


_AGGREGATES = ("sum", "count", "max", "min", "average")


class Relational:
    """Lowers an expression over a catalog."""

    def __init__(self, catalog: Catalog, spark: SparkSession, functions: dict[str, Any] | None = None, names: dict[str, Val] | None = None):
        self.catalog, self.spark = catalog, spark
        self.compiler = ColumnCompiler(functions, relations=self)
        self.root = Val(extra={"root": True}, fields={})
        self.scope = Scope(self.root, self.root, dict(names or {}))
        self.pending: list[tuple[str, Rel, Any]] = []
        #: The relation whose rows an expression is lowered over.
        self.current: list[list[Rel]] = []
        #: Sources that aggregates share, while one is lowered: those not yet used in it.
        self.shared: dict[str, Rel] = {}
        self.open: set[str] | None = None

    # -- results

    def run(self, n: Node) -> DataFrame:
        v = self.lower(n, self.scope)
        if isinstance(v, Rel):
            return self.output(v)
        if self.pending:
            return self._frame(self._scalars().select(*self._columns(v, "value")), v)
        return self._frame(self.spark.range(1).select(*self._columns(v, "value")), v)

    def _frame(self, df: DataFrame, v: Val) -> DataFrame:
        if not v.many:
            return df
        rows = df.select(F.explode("value").alias("value"))
        return rows.select("value.*") if isinstance(v.dtype, T.StructType) else rows

    def _columns(self, v: Val, label: str) -> list[Column]:
        if v.fields is not None:
            return [f.as_column().alias(k) for k, f in v.fields.items()]
        if not v.many and isinstance(v.dtype, T.StructType):
            return [v.col.getField(k).alias(k) for k in v.dtype.names]
        return [v.as_column().alias(label)]

    def output(self, r: Rel) -> DataFrame:
        if r.order and r.asked:
            r = r.placed()
            return r.df.orderBy(*ordered(r.order)).select(*self._columns(r.item, r.label))
        return r.df.select(*self._columns(r.item, r.label))

    def _scalars(self) -> DataFrame:
        """One row of all aggregates: those over one source share its scan."""
        groups: dict[int, tuple[DataFrame, list]] = {}
        for name, rel, build in self.pending:
            base = rel.base if rel.base is not None else rel.df
            conds = rel.conds if rel.base is not None else []
            key = next((k for k, (b, _) in groups.items() if b is base), None)
            if key is None:
                key = len(groups)
                groups[key] = (base, [])
            groups[key][1].append((name, build, conds))
        out = None
        for base, aggs in groups.values():
            # A condition of every aggregate filters the scan.
            shared = [c for c in aggs[0][2] if all(any(c is d for d in conds) for _, _, conds in aggs)]
            df = base
            for c in shared:
                df = df.where(c)
            cols = []
            for name, build, conds in aggs:
                cond = None
                for c in conds:
                    if not any(c is d for d in shared):
                        cond = c if cond is None else cond & c
                cols.append(build(cond).alias(name))
            one = df.agg(*cols)
            out = one if out is None else out.crossJoin(one)  # one row and one row
        self.pending = []
        return out

    # -- nodes that may be relations

    def lower(self, n: Node, s: Scope) -> Rel | Val:
        if n.kind == "path":
            r = self._relation_path(n, s)
            if r is not None:
                return r
        elif n.kind == "variable":
            v = self._bound(n, s)
            if isinstance(v, Rel):
                for stage in n.stages or ():
                    v = self._stage(v, stage, s)
                return self._group(v, n.group, s) if n.group is not None else v
        elif n.kind == "block":
            inner = Scope(s.item, s.root, {}, s)
            out: Rel | Val = MISSING
            for p in n.parts:
                out = self.lower(p, inner)
            if isinstance(out, Rel):
                for stage in n.stages or ():
                    out = self._stage(out, stage, s)
                return self._group(out, n.group, s) if n.group is not None else out
            return out
        elif n.kind == "bind":
            v = self.lower(n.value, s)
            s.names[n.name] = Val(extra={"rel": v}) if isinstance(v, Rel) else v
            return v
        elif n.kind == "call":
            r = self._call(n, s, [])
            if r is not None:
                return r
        elif n.kind == "chain":
            a = self.lower(n.lhs, s)
            if isinstance(a, Rel):
                if n.rhs.kind == "transform":
                    return replace(a, item=self._over(a, lambda sc: self.compiler.transform(n.rhs, a.item, sc)))
                r = self._call(n.rhs, s, [a]) if n.rhs.kind == "call" else self._apply(n.rhs, a, s)
                if r is not None:
                    return r
                raise Unsupported("this function of a table")
        elif n.kind == "array" and not n.stages and n.group is None:
            parts = [self.lower(i, s) for i in n.items]
            if len(parts) == 1 and isinstance(parts[0], Val) and n.items[0].kind == "range" and parts[0].many:
                return self._range(n.items[0], s)
            if any(isinstance(p, Rel) for p in parts):
                out = parts[0]
                for p in parts[1:]:
                    out = self._union(out, p)
                return out
        return self.compiler.lower(n, s)

    def _bound(self, n: Node, s: Scope) -> Rel | Val | None:
        if n.value == "" and s.item.extra.get("rel") is not None:
            return s.item.extra["rel"]
        if n.value == "" and s.item is self.root and "" in self.catalog:
            return self._source("")
        got = s.get(n.value)
        return got.extra["rel"] if got is not None and got.extra.get("rel") is not None else got

    def _range(self, n: Node, s: Scope) -> Rel | Val:
        a, b = self.compiler.lower(n.lhs, s), self.compiler.lower(n.rhs, s)
        if not (a.is_const and b.is_const):
            return self.compiler.lower(Node("array", n.pos, items=[n]), s)
        df = self.spark.range(int(a.const), int(b.const) + 1)
        c = f"_{next(_fresh)}"
        return Rel(df.select(F.col("id").cast("double").alias(c)), Val(F.col(c), DOUBLE), order=[(F.col(c), False)], extra_key=True)

    def _source(self, name: str) -> Rel:
        if self.open is not None and name not in self.open:
            self.open.add(name)
            if name not in self.shared:
                self.shared[name] = self._new_source(name)
            return self.shared[name]
        return self._new_source(name)

    def _new_source(self, name: str) -> Rel:
        df, k = self.catalog[name], next(_fresh)
        named = df.select(*[F.col(f"`{f.name}`").alias(f"{f.name}_{k}") for f in df.schema.fields])
        item = Val(fields={f.name: from_column(F.col(f"`{f.name}_{k}`"), f.dataType) for f in df.schema.fields})
        return Rel(named, item, base=named, as_read=True)

    # -- paths

    def _relation_path(self, n: Node, s: Scope) -> Rel | None:
        steps = list(n.steps)
        first = steps[0]
        if first.kind == "variable" and first.value == "$" and len(steps) > 1 and steps[1].kind == "name" and steps[1].value in self.catalog:
            steps = steps[1:]
            first = steps[0]
            at_root = True
        else:
            at_root = s.item is self.root
        r: Rel | None = None
        if first.kind == "name" and at_root and first.value in self.catalog:
            r = self._source(first.value)
            r = self._after(first, r, MISSING, s)
            steps = steps[1:]
        elif first.kind == "name" and s.item is self.root and "" in self.catalog:
            r = self._source("")
        elif first.kind == "variable":
            v = self._bound(first, s)
            if isinstance(v, Rel):
                r = self._after(first, v, MISSING, s)
                steps = steps[1:]
        elif first.kind in ("block", "call", "array", "object", "wildcard"):
            if first.kind in ("object", "wildcard") and s.item is self.root and "" in self.catalog:
                r = self._source("")
            elif first.kind not in ("object", "wildcard"):
                v = self.lower(Node(first.kind, first.pos, **{k: x for k, x in first.__dict__.items() if k not in ("kind", "pos", "stages", "cons")}), s)
                if isinstance(v, Rel):
                    r = self._after(first, v, MISSING, s)
                    steps = steps[1:]
                elif s.item is self.root and not v.missing:
                    return None
        if r is None:
            return None
        tuples = any(step.tuple for step in n.steps)
        for step in steps:
            r = self._step(r, step, s, tuples)
        return self._group(r, n.group, s) if n.group is not None else r

    def _scope(self, r: Rel, s: Scope) -> Scope:
        return Scope(r.item, s.root, dict(r.names), s, dict(r.parents))

    def _over(self, r: Rel, build: Any) -> Val:
        """Lower over the rows of a relation; lookups that it needs are joined to it."""
        self.current.append([r])
        try:
            v = build(self._scope(r, self.scope))
            joined = self.current[-1][0]
            if joined is not r:
                r.df, r.base, r.conds, r.as_read = joined.df, joined.df, [], False
            return v
        finally:
            self.current.pop()

    def _after(self, step: Node, r: Rel, before: Val, s: Scope) -> Rel:
        """Bindings and predicates of a step whose items ``r`` has."""
        if step.ancestor is not None:
            r = replace(r, parents={**r.parents, step.ancestor.label: before})
        if step.index:
            r = self._numbered(r, step.index)
        if step.focus:
            r = replace(r, names={**r.names, step.focus: r.item})
        for stage in step.stages or ():
            r = self._stage(r, stage, s)
        if step.focus:
            back = before if not before.missing else self.root
            r = replace(r, item=back, at_root=back is self.root)
        return r

    def _numbered(self, r: Rel, name: str) -> Rel:
        r, c = self._positions(r)
        return replace(r, names={**r.names, name: Val(F.col(c), DOUBLE)})

    @staticmethod
    def _positions(r: Rel) -> tuple[Rel, str]:
        """Rows with their positions, and the column that has them."""
        r, c = r.placed(), f"_{next(_fresh)}"
        return r.changed(with_ordinal(r.df, c, ordered(r.order)), order=[(F.col(c), False)], extra_key=True, as_read=False), c

    def _step(self, r: Rel, step: Node, s: Scope, tuples: bool = False) -> Rel:
        before = r.item
        # Without bindings, positions count in what each item gives, not in the whole stream.
        own = not tuples and step.kind != "sort" and any(what == "filter" and self._positional(t) for what, t in step.stages or ())
        if step.kind == "sort":
            keys = []
            for t, down in step.terms:
                v = self._over(r, lambda sc, t=t: self.compiler.lower(t, self._scope(r, s)))
                if v.missing:
                    continue
                if v.many or kind(v) not in ("number", "string"):
                    raise EvalError("T2008", kind(v))
                keys.append((v.col, bool(down)))
            return self._after(step, r.changed(r.df, order=keys, extra_key=False, asked=True) if keys else r, before, s)
        if step.kind == "name":
            got = MISSING if r.at_root else field_of(r.item, step.value)
            if got.missing and step.value in self.catalog and (r.at_root or r.names):
                return self._join(r, step, s)
            out = self._items(r, self._own(r, got, step, s) if own else got, step.value)
        else:
            bare = Node(step.kind, step.pos, **{k: x for k, x in step.__dict__.items() if k not in ("kind", "pos", "stages", "focus", "index", "cons")})
            try:
                got = self._over(r, lambda sc: self.compiler._kind(bare, self._scope(self.current[-1][0], s)))
            except Unsupported:
                got = self._document(r, bare, s)
            if step.kind == "array" and got.many:
                got = Val(got.col, T.ArrayType(got.dtype, False))
            out = self._items(r, self._own(r, got, step, s) if own else got, "value")
        if own:
            step = Node(step.kind, step.pos, **{k: x for k, x in step.__dict__.items() if k not in ("kind", "pos", "stages")})
        return self._after(step, replace(out, at_root=False), before, s)

    def _own(self, r: Rel, got: Val, step: Node, s: Scope) -> Val:
        for stage in step.stages:
            got = self.compiler.filter(got, stage, self._scope(r, s))
        return got

    def _document(self, r: Rel, n: Node, s: Scope) -> Val:
        """A step that types don't carry, by the document evaluator over each item: JSON text.

        Variables and parents of the row go with it.
        """
        if r.at_root and (self._names_tables(n) or _mentions(n, "variable", "$")):
            raise Unsupported("a dynamic step with a table in a row")
        names: dict[str, Any] = {}
        bound: dict[str, Column] = {k: v.as_column() for k, v in r.parents.items() if not v.missing}
        for k, v in r.names.items():
            if not v.is_const and v.fn is None and v.extra.get("rel") is None:
                bound[k] = v.as_column()
        scope: Scope | None = s
        while scope is not None:
            for k, v in scope.names.items():
                if k in bound or not _mentions(n, "variable", k):
                    continue
                if v.is_const:
                    names.setdefault(k, v.const)
                elif isinstance(v.fn, Closure):
                    names.setdefault(k, v.fn.node)
                else:
                    raise Unsupported("a dynamic step with this variable")
            scope = scope.up
        # Functions in scope are defined again around the step.
        defined = [Node("bind", n.pos, name=k, value=v) for k, v in names.items() if isinstance(v, Node)]
        body = Node("block", n.pos, parts=[*defined, n]) if defined else n
        plain = {k: v for k, v in names.items() if not isinstance(v, Node)}
        if r.at_root:
            text = F.lit(None).cast("string")
        else:
            item = r.item.as_column()
            whole = r.item.fields is not None or isinstance(r.item.dtype, T.StructType)
            text = F.to_json(item if whole else F.array(item))
            if not whole:
                body = Node("path", n.pos, steps=[Node("variable", n.pos, value=""), body])
        used = {k: c for k, c in bound.items() if k in r.parents or _mentions(n, "variable", k)}
        beside = F.to_json(F.struct(*[c.alias(k) for k, c in used.items()])) if used else None
        return Val(node_column(body, plain, text, beside), T.StringType())

    def _names_tables(self, n: Node) -> bool:
        return any(_mentions(n, "name", t) for t in self.catalog.tables)

    def _items(self, r: Rel, got: Val, label: str) -> Rel:
        if got.missing:
            return r.changed(r.df.where(F.lit(False)), item=Val(F.lit(None).cast("string"), T.StringType()), label=label)
        if got.many:
            c = f"_{next(_fresh)}"
            return r.changed(r.df.withColumn(c, F.explode(got.col)), item=from_column(F.col(c), got.dtype), label=label, order=None)
        if got.fields is not None:
            return replace(r, item=got, label=label)
        out = replace(r, item=got, label=label)
        # A missing item is no item.
        return out if got.is_const else out.where(got.col.isNotNull())

    def _join(self, r: Rel, step: Node, s: Scope) -> Rel:
        """A table beside the rows so far; predicates that follow are the join's condition."""
        other = self._source(step.value)
        if step.index:
            other = self._numbered(other, step.index)
        names = {**r.names, **other.names}
        if step.focus:
            names[step.focus] = other.item
        both = Rel(r.df, other.item, names, dict(r.parents))
        stages, cond, tests = list(step.stages or ()), None, []
        while stages and stages[0][0] == "filter" and not self._positional(stages[0][1]):
            test = stages.pop(0)[1]
            tests += self._conjuncts(test)
            c = self.condition(test, self._scope(both, s), False)
            cond = c if cond is None else cond & c
        df = r.df.crossJoin(other.df) if cond is None else self._by_range(r.df, other.df, tests, cond, self._scope(both, s))
        out = Rel(df, other.item, names, dict(r.parents), base=df, label=step.value)
        for stage in stages:
            out = self._stage(out, stage, s)
        return replace(out, item=self.root, at_root=True) if step.focus else out

    def _by_range(self, left: DataFrame, right: DataFrame, tests: list[Node], cond: Column, s: Scope) -> DataFrame:
        """The join; if all that ties the sides is that a number lies in an interval, by buckets as wide as intervals."""
        bounds: list[tuple[tuple[bool, Column], tuple[bool, Column]]] = []
        for t in tests:
            if t.kind != "op" or t.op not in ("=", "<", "<=", ">", ">="):
                continue
            a, b = self.compiler.lower(t.lhs, s), self.compiler.lower(t.rhs, s)
            if not (a.number and b.number) or a.is_const or b.is_const:
                if t.op == "=" and not (a.is_const or b.is_const):
                    return left.join(right, cond, "inner")
                continue
            sides = [_side(v.col, left, right) for v in (a, b)]
            if None in sides or sides[0] == sides[1]:
                continue
            if t.op == "=":
                return left.join(right, cond, "inner")
            ends = [(side, v.double()) for side, v in zip(sides, (a, b), strict=True)]
            bounds.append((ends[0], ends[1]) if t.op in ("<", "<=") else (ends[1], ends[0]))
        for (of_low, low), (of_point, point) in bounds:
            for (of_point2, point2), (of_high, high) in bounds:
                if of_low == of_high and of_point == of_point2 != of_low and str(point) == str(point2):
                    return interval_join(left, right, cond, low, high, point, of_low)
        return left.join(right, cond, "inner")

    @staticmethod
    def _positional(test: Node) -> bool:
        return test.kind == "number" or test.kind == "array" or test.kind == "neg"

    def _stage(self, r: Rel, stage: tuple[str, Any], s: Scope) -> Rel:
        what, test = stage
        if what == "index":
            return self._numbered(r, test)
        if test.kind == "number":
            return self._limit(r, int(test.value // 1), 1)
        if test.kind == "array":
            first = test.items[0] if len(test.items) == 1 else None
            if first is not None and first.kind == "range":
                a, b = self.compiler.lower(first.lhs, s), self.compiler.lower(first.rhs, s)
                if a.is_const and b.is_const and a.const >= 0:
                    return self._limit(r, int(a.const), max(0, int(b.const) - int(a.const) + 1))
            if all(i.kind == "number" and i.value >= 0 for i in test.items):
                r, c = self._positions(r)
                return r.changed(r.df.where(F.col(c).isin([float(int(i.value)) for i in test.items])))
            raise Unsupported("these positions of a table")
        for t in self._conjuncts(test):
            r = self._filter(r, t, s)
        return r

    @staticmethod
    def _conjuncts(n: Node) -> list[Node]:
        if n.kind == "op" and n.op == "and":
            return [*Relational._conjuncts(n.lhs), *Relational._conjuncts(n.rhs)]
        if n.kind == "block" and len(n.parts) == 1 and not n.stages:
            return Relational._conjuncts(n.parts[0])
        return [n]

    def _filter(self, r: Rel, t: Node, s: Scope) -> Rel:
        negated = t.kind == "call" and t.fn.kind == "variable" and t.fn.value == "not" and len(t.args) == 1
        inner = t.args[0] if negated else t
        if inner.kind == "op" and inner.op == "in":
            other = self.lower(inner.rhs, Scope(self.root, s.root, {}, s)) if inner.rhs.kind in ("path", "variable") and self._leaves(inner.rhs, s) else None
            if isinstance(other, Rel):
                v = self.compiler.lower(inner.lhs, self._scope(r, s))
                o = other.item
                c = f"_{next(_fresh)}"
                if kind(v) != kind(o):
                    return r if negated else r.where(F.lit(False))
                x, y = (v.col, o.col) if v.dtype == o.dtype else (v.double(), o.double())
                keys = other.df.select(y.alias(c))
                return r.changed(r.df.join(keys, x == F.col(c), "left_anti" if negated else "left_semi"), as_read=False)
        self.current.append([r])
        try:
            cond = self.condition(t, self._scope(r, s))
            r = self.current[-1][0]
        finally:
            self.current.pop()
        return self._at(r, cond) if isinstance(cond, Val) else r.where(cond)

    def _at(self, r: Rel, v: Val) -> Rel:
        """The rows whose position is the number that the predicate gives for them; from the end if it is negative."""
        if v.is_const:
            return self._limit(r, int(v.const // 1), 1)
        r, c = self._positions(r)
        wanted = F.floor(v.double())
        # One number, counted over stored rows.
        total = r.df.count()
        return r.where(F.col(c) == F.when(wanted < 0, wanted + F.lit(total)).otherwise(wanted))

    def _leaves(self, n: Node, s: Scope) -> bool:
        """Whether a path starts at a table."""
        if n.kind == "variable":
            got = s.get(n.value)
            return got is not None and got.extra.get("rel") is not None
        first = n.steps[0]
        if first.kind == "variable":
            return first.value == "$" or self._leaves(first, s)
        return False

    def condition(self, n: Node, s: Scope, top: bool = True) -> Column | Val:
        """A predicate that may be null where it isn't true: so that joins and scans see plain comparisons.

        One that gives a number, a position, comes as a value.
        """
        if n.kind == "op" and n.op in ("and", "or") and not n.stages:
            a, b = self.condition(n.lhs, s, False), self.condition(n.rhs, s, False)
            return a & b if n.op == "and" else a | b
        if n.kind == "block" and len(n.parts) == 1 and not n.stages:
            return self.condition(n.parts[0], s, top)
        if n.kind == "op" and n.op == "=" and not n.stages:
            a, b = self.compiler.lower(n.lhs, s), self.compiler.lower(n.rhs, s)
            if not (a.missing or b.missing or a.many or b.many) and kind(a) == kind(b) and kind(a) in ("number", "string", "boolean") and not (a.is_const and b.is_const):
                x, y = self.compiler._alike(a, b) if a.number else (a.col, b.col)
                return x == y
            return truthy(self.compiler.equality(a, b, True))
        v = self.compiler.lower(n, s)
        if v.number:
            if not top:
                raise Unsupported("a number beside a test in a table")
            return v
        return v.col if n.kind == "op" and n.op in ("<", "<=", ">", ">=") and v.col is not None else truthy(v)

    def _limit(self, r: Rel, skip: int, take: int) -> Rel:
        if skip < 0:
            if not r.order and not r.as_read:
                raise Unsupported("the end of a table without an order")
            # The last few are the first few from the end, so no position is counted.
            r, c = r.placed(), f"_{next(_fresh)}"
            if not r.order:
                r = r.changed(r.df.withColumn(c, F.monotonically_increasing_id()), order=[(F.col(c), False)], extra_key=True)
            end = r.df.orderBy(*ordered(r.order, True)).limit(-skip)
            if skip < -1:
                # Fewer rows than that have none at this position; of so many, one task's work.
                n = f"_{next(_fresh)}"
                end = end.withColumn(n, F.count("*").over(Window.partitionBy(F.lit(0)))).where(F.col(n) == -skip).orderBy(*ordered(r.order)).limit(take)
            return r.changed(end, as_read=False, asked=False)
        r = r.placed()
        df = r.df.orderBy(*ordered(r.order)) if r.order else r.df
        if skip:
            df = df.offset(skip)
        return r.changed(df.limit(take), as_read=False, asked=False)

    # -- grouping

    def _group(self, r: Rel, pairs: list[tuple[Node, Node]], s: Scope) -> Rel:
        """One row a key.

        Of several pairs each row gives a key for each, and one aggregation
        serves all; a key that two pairs give is an error.
        """
        row = self._scope(r, s)
        keys: list[tuple[int, Val]] = []
        for i, (k, _) in enumerate(pairs):
            key = self.compiler.lower(k, row)
            if key.missing:
                continue
            if not key.string:
                raise EvalError("T1003", kind(key))
            keys.append((i, key))
        if not keys:
            return r.changed(r.df.where(F.lit(False)), item=Val(fields={"key": Val(F.lit(""), T.StringType())}))
        kname, pname = f"_{next(_fresh)}", f"_{next(_fresh)}"
        if len(pairs) == 1:
            key = keys[0][1]
            rows = (r.df if key.is_const else r.df.where(key.col.isNotNull())).withColumn(kname, key.col)
        else:
            given = F.array(*[F.when(key.col.isNotNull(), F.struct(F.lit(i).alias("p"), key.col.alias("k"))) for i, key in keys])
            rows = r.df.withColumn(pname, F.explode(F.array_compact(given)))
            rows = rows.withColumn(kname, F.col(f"{pname}.k")).withColumn(pname, F.col(f"{pname}.p"))
        made: dict[str, list[tuple[int, str, Val]]] = {}
        plain: list[str] = []
        for i, _ in keys:
            bucket = Bucket(self, r, F.col(pname) == i if len(pairs) > 1 else None)
            value = ColumnCompiler(self.compiler.functions, self.compiler.now, bucket).lower(pairs[i][1], Scope(r.item, s.root, dict(r.names), s, dict(r.parents)))
            for f, x in (value.fields if value.fields is not None else {"value": value}).items():
                if not x.missing:
                    made.setdefault(f, []).append((i, f"_{next(_fresh)}", x))
            if value.fields is None and not value.missing:
                plain.append(made["value"][-1][1])
        cols = [x.as_column().alias(c) for of in made.values() for _, c, x in of]
        if len(pairs) > 1:
            cols += [F.min(pname).alias(pname), F.max(pname).alias(pname + "m")]
        df = rows.groupBy(kname).agg(*cols) if cols else rows.select(kname).distinct()
        got = {"key": Val(F.col(kname), T.StringType())}
        if len(pairs) == 1:
            if plain:
                df = df.where(F.col(plain[0]).isNotNull())
            for f, [(_, c, x)] in made.items():
                got[f] = from_column(F.col(c), T.ArrayType(x.dtype, False)) if x.many else Val(F.col(c), _dtype(x)) if x.fields is None else from_column(F.col(c), _dtype(x))
            return Rel(df, Val(fields=got), base=df, label="value")
        clash = F.raise_error(F.concat(F.lit("D1009: keys of an object are not unique: "), F.col(kname))).cast("boolean")
        df = df.where(F.when(F.col(pname) != F.col(pname + "m"), clash).otherwise(F.lit(True)))
        shown = [F.col(kname)]
        for f, of in made.items():
            types = [T.ArrayType(x.dtype, False) if x.many else _dtype(x) for _, _, x in of]
            if any(t != types[0] for t in types) and not all(isinstance(t, NUMERIC) for t in types):
                raise Unsupported("values of several types under one name")
            dtype = types[0] if all(t == types[0] for t in types) else DOUBLE
            c = f"_{next(_fresh)}"
            shown.append(F.coalesce(*[F.when(F.col(pname) == i, F.col(k).cast(dtype)) for i, k, _ in of]).alias(c))
            got[f] = from_column(F.col(c), dtype)
        if plain and set(made) == {"value"}:
            # A pair without a value gives no entry.
            there = F.coalesce(*[F.when(F.col(pname) == i, F.col(k).isNotNull()) for i, k, _ in made["value"]], F.lit(True))
            df = df.where(there)
        df = df.select(*shown)
        return Rel(df, Val(fields=got), base=df, label="value")

    def _union(self, a: Rel | Val, b: Rel | Val) -> Rel | Val:
        if isinstance(a, Val) or isinstance(b, Val):
            a, b = (x if isinstance(x, Rel) else self._inline(x) for x in (a, b))
        x, y = self.output(a), self.output(b)
        if a.item.fields is None and b.item.fields is None:
            if a.item.dtype != b.item.dtype and a.item.number and b.item.number:
                x, y = x.select(F.col(x.columns[0]).cast("double")), y.select(F.col(y.columns[0]).cast("double"))
            y = y.toDF(*x.columns)
        return self._rel(x.unionByName(y, allowMissingColumns=True), a.label, a.item.fields is not None)

    def _inline(self, v: Val) -> Rel:
        df = self.spark.range(1)
        df = df.select(F.explode(v.col).alias("value")) if v.many else df.select(*self._columns(v, "value"))
        return self._rel(df, "value", v.fields is not None)

    def _rel(self, df: DataFrame, label: str, rows: bool) -> Rel:
        k = next(_fresh)
        named = df.toDF(*[f"{c}_{k}" for c in df.columns])
        if rows:
            item = Val(fields={f.name: from_column(F.col(f"`{f.name}_{k}`"), f.dataType) for f in df.schema.fields})
        else:
            item = from_column(F.col(f"`{df.columns[0]}_{k}`"), df.schema.fields[0].dataType)
        return Rel(named, item, base=named, label=label)

    # -- functions of relations

    def _apply(self, fn: Node, a: Rel, s: Scope) -> Rel | Val | None:
        return self._call(Node("call", fn.pos, fn=fn, args=[]), s, [a])

    def _call(self, n: Node, s: Scope, before: list[Rel | Val]) -> Rel | Val | None:
        if n.fn.kind != "variable" or n.fn.value == "" or s.get(n.fn.value) is not None:
            return None
        name, args = n.fn.value, list(n.args)
        if name in _AGGREGATES:
            if before and isinstance(before[0], Rel):
                return self._pend(name, before[0])
            return None
        if name not in ("distinct", "sort", "reverse", "shuffle", "append", "filter", "map"):
            return None
        first = before[0] if before else self.lower(args.pop(0), s) if args else MISSING
        if not isinstance(first, Rel):
            if name == "append" and args:
                second = self.lower(args[0], s)
                if isinstance(second, Rel):
                    return self._union(first, second)
            return None
        r = first
        if name == "distinct":
            return self._rel(self.output(r).distinct(), r.label, r.item.fields is not None)
        if name == "append":
            return self._union(r, self.lower(args[0], s))
        if name == "shuffle":
            return r.changed(r.df, order=[(F.rand(), False)], extra_key=True, asked=True)
        if name == "reverse":
            if not r.order and not r.as_read:
                raise Unsupported("reversing a table without an order")
            r, c = self._positions(r)
            return replace(r, order=[(F.col(c), True)], asked=True)
        if name == "sort" and not args:
            if r.item.fields is not None or kind(r.item) not in ("number", "string"):
                raise EvalError("D3070")
            return r.changed(r.df, order=[(r.item.col, False)], extra_key=False, asked=True)
        if name in ("filter", "map") and args:
            fn = self.compiler.lower(args[0], s)
            if self.compiler.arity(fn) > 1:
                raise Unsupported("positions in a table")
            got = self._over(r, lambda sc: self.compiler.invoke(fn, [r.item], sc))
            return r.where(truthy(got)) if name == "filter" else self._items(r, Val(got.col, T.ArrayType(got.dtype, False)) if got.many else got, "value")
        raise Unsupported(f"${name} of a table by a function")

    def _pend(self, name: str, r: Rel) -> Val:
        c = f"_{next(_fresh)}"
        distinct = r.item.extra.get("distinct")
        self.pending.append((c, r, lambda cond: aggregate_column(name, r.item, cond, distinct)))
        v = Val(F.col(c), DOUBLE)
        return Val(F.coalesce(v.col, F.lit(0.0)), DOUBLE) if name == "count" else v

    # -- hooks of the column compiler

    def path(self, n: Node, s: Scope) -> Val | None:
        if not self._starts_at_table(n, s):
            return None
        if self.current:
            return self._looked_up(n, s)
        if self._relation_path(n, s) is None:
            return None
        raise Unsupported("a table inside a row")

    def _looked_up(self, n: Node, s: Scope) -> Val:
        """Values of the rows of another table that match the current one: the first, the last or all, in order.

        One pass over that table by its key, then a join; what is kept of a
        key's rows is one value unless all are asked for.
        """
        steps = [x for x in n.steps if not (x.kind == "variable" and x.value == "$")]
        other, inner, outer, rest = self._matching(steps[0], s)
        here = Scope(self.root, self.root, {}, None)
        at: int | None = None
        steps = steps[1:]
        if rest:
            at = self._first_or_last(rest)
        elif steps and steps[0].kind == "sort":
            sort = steps.pop(0)
            if sort.stages:
                at = self._first_or_last(sort.stages)
            other = self._step(other, Node("sort", sort.pos, terms=sort.terms), here, False)
        for step in steps:
            other = self._step(other, step, here, False)
        if other.item.many:
            raise Unsupported("arrays of a table that is looked up")
        order = other.order or []
        if not order and not other.as_read:
            raise Unsupported("matches without an order")
        place, c = f"_{next(_fresh)}", f"_{next(_fresh)}"
        value = F.struct(other.item.as_column().alias("v"))
        keys = [f"_{next(_fresh)}" for _ in inner]
        rows = other.df.withColumn(place, F.monotonically_increasing_id())
        parts = []
        for i, (k, down) in enumerate(order):
            if down and not isinstance(other.df.select(k).schema.fields[0].dataType, NUMERIC):
                raise Unsupported("a descending order by text of a table that is looked up")
            parts.append((-k if down else k, f"{place}_{i}"))
        for k, name in parts:
            rows = rows.withColumn(name, k)
        by = F.struct(*[F.col(name) for _, name in parts], F.col(place))
        best = {0: F.min_by(value, by), -1: F.max_by(value, by)}
        every = F.transform(F.array_sort(F.collect_list(F.struct(by.alias("o"), other.item.as_column().alias("v")))), lambda x: x["v"])
        grouped = rows.groupBy(*[k.alias(x) for k, x in zip(inner, keys, strict=True)]).agg((every if at is None else best[at].getField("v")).alias(c))
        self._joined(grouped, keys, outer)
        dtype = _dtype(other.item)
        return Val(F.col(c), dtype, True) if at is None else from_column(F.col(c), dtype)

    def _first_or_last(self, stages: Any) -> int:
        if len(stages) == 1 and stages[0][0] == "filter":
            test = stages[0][1]
            if test.kind == "number" and test.value in (0, -1):
                return int(test.value)
            if test.kind == "neg" and test.arg.kind == "number" and test.arg.value == 1:
                return -1
        raise Unsupported("these positions in a table that is looked up")

    def _starts_at_table(self, n: Node, s: Scope) -> bool:
        first = n.steps[0]
        if first.kind == "variable":
            if first.value == "$":
                return len(n.steps) > 1 and n.steps[1].kind == "name" and n.steps[1].value in self.catalog
            got = s.get(first.value)
            return got is not None and got.extra.get("rel") is not None
        return first.kind == "name" and s.item is self.root and (first.value in self.catalog or "" in self.catalog)

    def membership(self, n: Node, s: Scope) -> Val | None:
        return None

    def aggregate(self, name: str, n: Node, s: Scope, before: list[Val] | None) -> Val | None:
        if name not in _AGGREGATES or before or len(n.args) != 1:
            return None
        arg = n.args[0]
        if self.current:
            return self._lookup(name, arg, s)
        if arg.kind == "call" and name == "count" and arg.fn.kind == "variable" and arg.fn.value == "distinct":
            inner = self.lower(arg.args[0], s)
            if isinstance(inner, Rel) and inner.item.fields is None:
                inner = replace(inner, item=replace(inner.item, extra={**inner.item.extra, "distinct": True}))
                return self._pend("count", inner)
        self.open, before_open = set(), self.open
        try:
            r = self.lower(arg, s)
        finally:
            self.open = before_open
        return self._pend(name, r) if isinstance(r, Rel) else None

    def _lookup(self, name: str, arg: Node, s: Scope) -> Val | None:
        """An aggregate over the rows of another table that match the current one: grouped by the key, then joined."""
        if arg.kind != "path" or not self._starts_at_table(arg, s):
            return None
        steps = [x for x in arg.steps if not (x.kind == "variable" and x.value == "$")]
        other, inner, outer, rest = self._matching(steps[0], s)
        if rest:
            raise Unsupported("positions in a table that is looked up")
        for step in steps[1:]:
            other = self._step(other, step, Scope(self.root, self.root, {}, None), False)
        names = [f"_{next(_fresh)}" for _ in inner]
        c = f"_{next(_fresh)}"
        grouped = other.df.groupBy(*[k.alias(x) for k, x in zip(inner, names, strict=True)]).agg(aggregate_column(name, other.item, None, False).alias(c))
        self._joined(grouped, names, outer)
        return Val(F.coalesce(F.col(c), F.lit(0.0)) if name == "count" else F.col(c), DOUBLE)

    def _matching(self, step: Node, s: Scope) -> tuple[Rel, list[Column], list[Column], list]:
        """A table that is looked up, its keys, the current row's, and the stages after the predicates."""
        other = self._source(step.value)
        inner: list[Column] = []
        outer: list[Column] = []
        stages = list(step.stages or ())
        while stages and stages[0][0] == "filter" and not self._positional(stages[0][1]):
            for t in self._conjuncts(stages.pop(0)[1]):
                pair = self._correlated(t, other, s)
                if pair is None:
                    other = other.where(self.condition(t, Scope(other.item, s.root, {}, None), False))
                else:
                    inner.append(pair[0])
                    outer.append(pair[1])
        if not inner:
            raise Unsupported("a table inside a row")
        return other, inner, outer, stages

    def _joined(self, grouped: DataFrame, names: list[str], outer: list[Column]) -> None:
        """The current rows with what was grouped for their keys."""
        r = self.current[-1][0]
        cond = None
        for x, k in zip(names, outer, strict=True):
            one = F.col(x) == k
            cond = one if cond is None else cond & one
        self.current[-1][0] = r.changed(r.df.join(grouped, cond, "left"), as_read=False)

    def _correlated(self, t: Node, other: Rel, s: Scope) -> tuple[Column, Column] | None:
        if not (t.kind == "op" and t.op == "="):
            return None
        for a, b in ((t.lhs, t.rhs), (t.rhs, t.lhs)):
            inner = self.compiler.lower(a, Scope(other.item, s.root, {}, None)) if self._only_fields(a, other.item) else MISSING
            if inner.missing or inner.is_const:
                continue
            if self._only_fields(b, other.item):
                continue
            outer = self.compiler.lower(b, s)
            if outer.missing or outer.is_const:
                continue
            if kind(inner) != kind(outer):
                return None
            return (inner.col, outer.col) if inner.dtype == outer.dtype else (inner.double(), outer.double())
        return None

    @staticmethod
    def _only_fields(n: Node, item: Val) -> bool:
        return n.kind == "path" and n.steps[0].kind == "name" and not field_of(item, n.steps[0].value).missing


def aggregate_column(name: str, item: Val, cond: Column | None, distinct: Any) -> Column:
    """A Spark aggregate of a relation's items, of those that ``cond`` holds for."""
    if item.many:
        return _appended(name, item, cond, distinct)
    if name == "count":
        x = F.lit(1) if item.fields is not None else item.as_column()
        if cond is not None:
            x = F.when(cond, x)
        return (F.count_distinct(x) if distinct else F.count(x)).cast("double")
    if item.fields is not None or item.many or not isinstance(item.dtype, NUMERIC):
        raise EvalError("T0412", kind(item))
    x = item.double() if name in ("sum", "average") else item.col
    if cond is not None:
        x = F.when(cond, x)
    return {"sum": F.sum, "max": F.max, "min": F.min, "average": F.avg}[name](x).cast("double")


def _appended(name: str, item: Val, cond: Column | None, distinct: Any) -> Column:
    """An aggregate of arrays as if they were one: each gives a part, and parts are combined before the shuffle."""
    x = item.col if cond is None else F.when(cond, item.col)
    if distinct:
        return F.size(F.array_distinct(F.flatten(F.collect_list(x)))).cast("double")
    size = F.sum(F.coalesce(F.size(F.array_compact(x)), F.lit(0))).cast("double")
    if name == "count":
        return size
    if not isinstance(item.dtype, NUMERIC):
        raise EvalError("T0412", kind(item))
    numbers = F.array_compact(x).cast("array<double>")
    total = F.sum(F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b)))
    return {"sum": total, "max": F.max(F.array_max(numbers)), "min": F.min(F.array_min(numbers)), "average": total / size}[name].cast("double")


def _side(col: Column, left: DataFrame, right: DataFrame) -> bool | None:
    """Whether a column is of the left side; None if it is of neither alone."""
    for is_left, df in ((True, left), (False, right)):
        try:
            df.select(col).schema  # noqa: B018  analysed here
            return is_left
        except AnalysisException:
            continue
    return None


def ordered(order: list[tuple[Column, bool]] | None, backwards: bool = False) -> list[Column] | None:
    """Sort columns: what is missing comes last."""
    if backwards:
        return [c.asc_nulls_first() if down else c.desc_nulls_first() for c, down in order]
    return order and [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in order]


class Bucket:
    """Hooks for the value of a grouping: aggregates of the bucket's items."""

    def __init__(self, rel: Relational, r: Rel, only: Column | None = None):
        self.rel, self.r, self.only = rel, r, only

    def membership(self, n: Node, s: Scope) -> Val | None:
        return None

    def _part(self, n: Node, s: Scope) -> tuple[Val, Column | None] | None:
        """Item and condition of a path from the bucket, of the rows that are its own."""
        part = self._path(n, s)
        if part is None or self.only is None:
            return part
        return part[0], self.only if part[1] is None else self.only & part[1]

    def _path(self, n: Node, s: Scope) -> tuple[Val, Column | None] | None:
        if n.kind == "variable" and n.value == "" and s.item is self.r.item:
            cond = self._conds(n.stages, s.item, s)
            return self.r.item, cond
        if n.kind == "variable" and self.r.names.get(n.value) is not None and s.get(n.value) is self.r.names[n.value]:
            return self.r.names[n.value], self._conds(n.stages, self.r.names[n.value], s)
        if n.kind != "path" or n.group is not None or s.item is not self.r.item:
            if n.kind == "block" and len(n.parts) == 1 and not n.stages:
                return self._path(n.parts[0], s)
            return None
        item, cond = self.r.item, None
        for i, step in enumerate(n.steps):
            if step.kind == "variable" and i == 0:
                if step.value == "":
                    pass
                elif step.value in self.r.names:
                    item = self.r.names[step.value]
                else:
                    return None
            elif step.kind == "name":
                item = field_of(item, step.value)
                if item.missing or item.many and (step.stages or item.fields is not None):
                    return None
            elif step.kind == "sort" or step.focus or step.index:
                return None
            else:
                plain = ColumnCompiler(self.rel.compiler.functions, self.rel.compiler.now)
                bare = Node(step.kind, step.pos, **{k: x for k, x in step.__dict__.items() if k not in ("kind", "pos", "stages", "cons")})
                item = plain._kind(bare, Scope(item, s.root, {}, Scope(item, s.root, dict(self.r.names), None)))
                if item.many:
                    return None
            c = self._conds(step.stages, item, s)
            cond = c if cond is None else cond if c is None else cond & c
        return item, cond

    def _conds(self, stages: Any, item: Val, s: Scope) -> Column | None:
        out = None
        for what, test in stages or ():
            if what != "filter" or Relational._positional(test):
                raise Unsupported("positions in a group")
            plain = ColumnCompiler(self.rel.compiler.functions, self.rel.compiler.now)
            c = truthy(plain.lower(test, Scope(item, s.root, {}, Scope(item, s.root, dict(self.r.names), s.up))))
            out = c if out is None else out & c
        return out

    def aggregate(self, name: str, n: Node, s: Scope, before: list[Val] | None) -> Val | None:
        if before or len(n.args) != 1:
            return None
        arg = n.args[0]
        if name == "count" and arg.kind == "call" and arg.fn.kind == "variable" and arg.fn.value == "distinct":
            part = self._part(arg.args[0], s)
            if part is not None:
                return Val(aggregate_column("count", part[0], part[1], True), DOUBLE)
        if name in _AGGREGATES:
            part = self._part(arg, s)
            if part is None:
                return None
            return Val(aggregate_column(name, part[0], part[1], False), DOUBLE)
        if name == "distinct":
            part = self._part(arg, s)
            if part is not None and part[0].fields is None:
                x = part[0].as_column() if part[1] is None else F.when(part[1], part[0].as_column())
                return Val(F.array_sort(F.collect_set(x)), part[0].dtype, True)
        return None

    def path(self, n: Node, s: Scope) -> Val | None:
        part = self._part(n, s)
        if part is None:
            return None
        item, cond = part
        if item.many:
            x = item.col if cond is None else F.when(cond, item.col)
            return Val(F.flatten(F.collect_list(x)), item.dtype, True)
        x = item.as_column() if cond is None else F.when(cond, item.as_column())
        return Val(F.collect_list(x), _dtype(item), True)


def run(expression: Any, source: Any, spark: SparkSession | None = None) -> DataFrame:
    """The expression over a DataFrame or a catalog, as a DataFrame."""
    catalog = Catalog.of(source)
    spark = spark or next(iter(catalog.tables.values())).sparkSession
    names = {k: constant(v) for k, v in expression._names.items() if isinstance(v, (str, float, bool)) or v is None}
    functions = {k: v.column for k, v in expression._names.items() if getattr(v, "column", None)}
    return Relational(catalog, spark, functions, names).run(expression.tree)


__all__ = ["Builtin", "Relational", "run"]
