"""The public interface: compile an expression once, evaluate it many times."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pathframe.dynamic.evaluate import Frame, Native, Run, evaluate, program
from pathframe.dynamic.values import MISSING, Function, Outer, number, plain
from pathframe.errors import CompileError, EvalError, PathError
from pathframe.functions.registry import BUILTINS
from pathframe.syntax import Node, parse


class _Registered(Native):
    """A Python callable as a function value: ordinary data in and out."""

    def __init__(self, name: str, fn: Callable, signature: str | None):
        arity = getattr(getattr(fn, "__code__", None), "co_argcount", 1)
        super().__init__(name, fn, signature, arity=arity if signature is None else None)

    def call(self, args: list, context: Any) -> Any:
        if self.signature is not None:
            args = self.signature.check(args, context)
        return number(self.fn(*[a if isinstance(a, Function) else plain(a) for a in args]))


class _ColumnFunction(_Registered):
    """Built into the plan on typed rows; elsewhere a Python callable, if there is one."""

    def __init__(self, name: str, build: Callable, returns: str, fn: Callable | None):
        super().__init__(name, fn or (lambda *args: _no_documents(name)), None)
        self.build, self.returns = build, returns

    @property
    def column(self) -> tuple[Callable, Any]:
        from pyspark.sql.types import _parse_datatype_string

        return self.build, _parse_datatype_string(self.returns)


def _no_documents(name: str) -> Any:
    raise EvalError("T1006", f"${name} has a Column form only")


class Expression:
    """A compiled expression."""

    def __init__(self, text: str):
        self.text = text
        self.tree: Node = parse(text)
        self._code = program(text)
        self._names: dict[str, Any] = {}
        self._timeout: float | None = None
        self._depth: int | None = None

    def assign(self, name: str, value: Any) -> Expression:
        """Bind a variable for every evaluation."""
        self._names[name] = value if isinstance(value, Function) else number(value)
        return self

    def register_function(self, name: str, fn: Callable | Function, signature: str | None = None) -> Expression:
        self._names[name] = fn if isinstance(fn, Function) else _Registered(name, fn, signature)
        return self

    def register_column(self, name: str, build: Callable, returns: str, fn: Callable | None = None) -> Expression:
        """A function as a builder of Columns, for typed rows; ``fn`` is its form over documents."""
        self._names[name] = _ColumnFunction(name, build, returns, fn)
        return self

    def use_library(self, library: Library) -> Expression:
        for name, fn in library.functions.items():
            self._names[name] = fn
        return self

    def set_timeout(self, ms: float) -> Expression:
        self._timeout = ms
        return self

    def set_max_depth(self, n: int) -> Expression:
        self._depth = n
        return self

    def evaluate_value(self, value: Any, bindings: dict[str, Any] | None = None) -> Any:
        """Over internal values: missing is ``MISSING``, functions are function values."""
        names = {k: v if isinstance(v, Function) else _Registered(k, v, None) if callable(v) else number(v) for k, v in (bindings or {}).items()}
        run = Run(self._timeout, self._depth)
        frame = Frame(Frame(_ROOT, run, self._names), run, names)
        return evaluate(self._code, value, frame)

    def evaluate(self, document: Any = MISSING, bindings: dict[str, Any] | None = None) -> Any:
        """Over ordinary data; missing comes back as None."""
        return plain(self.evaluate_value(number(document), bindings))

    def evaluate_json(self, document: str | None, bindings: dict[str, Any] | None = None) -> str | None:
        """JSON text in and out; null in is missing, missing comes out as null."""
        value = MISSING if document is None else json.loads(document, parse_int=float)
        out = self.evaluate_value(value, bindings)
        return None if out is MISSING else json.dumps(plain(out), ensure_ascii=False, separators=(",", ":"))

    # -- on Spark

    def on(self, source: Any, **options: Any) -> Any:
        """The expression over a DataFrame, or over named DataFrames as one document: a DataFrame."""
        from pathframe.plans.relational import run

        return run(self, source, **options)

    def as_column(self, source: Any, strict: bool = False) -> Any:
        """The expression over each row of ``source`` (a DataFrame or schema): a Column."""
        from pathframe.plans.column import as_column

        return as_column(self, source, strict=strict)

    def on_json(self, df: Any, column: str, output: str = "result") -> Any:
        """``df`` with the expression's result over a column of JSON text, as JSON text."""
        from pathframe.operators.documents import evaluate_json_column

        return evaluate_json_column(self, df, column, output)


_ROOT = Frame(None, Run(), dict(BUILTINS))


def compile(text: str) -> Expression:  # noqa: A001
    return Expression(text)


@dataclass
class Compiled:
    """Outcome of :func:`compile_all`."""

    results: dict[str, Expression] = field(default_factory=dict)
    failures: dict[str, CompileError] = field(default_factory=dict)


def compile_all(texts: dict[str, str] | Iterable[str]) -> Compiled:
    """Compile each; those that fail are listed, not raised."""
    named = texts if isinstance(texts, dict) else {t: t for t in texts}
    out = Compiled()
    for name, text in named.items():
        try:
            out.results[name] = compile(text)
        except CompileError as e:
            out.failures[name] = e
    return out


class _Guarded(Function):
    def __init__(self, library: Library, fn: Function):
        self.library, self.fn, self.arity, self.signature = library, fn, fn.arity, fn.signature

    def call(self, args: list, context: Any) -> Any:
        if self.library.closed:
            raise EvalError("T2006", "the library is closed")
        return self.fn.call(args, context)


class Library:
    """Functions compiled from definitions; after :meth:`close` a call is an error."""

    def __init__(self, definitions: dict[str, str]):
        self.closed = False
        self.functions: dict[str, Function] = {}
        for name, text in definitions.items():
            fn = compile(text).evaluate_value(MISSING)
            if not isinstance(fn, Function):
                raise CompileError("T2006", name)
            self.functions[name] = _Guarded(self, fn)

    def close(self) -> None:
        self.closed = True


def compile_library(definitions: dict[str, str]) -> Library:
    return Library(definitions)


def run_cases(cases: Iterable[dict[str, Any]]) -> dict[str, dict[str, Any]]:
    """``{id: {"ok": value} | {"err": "eval:CODE" | "compile:CODE"}}`` for cases ``{id, expr, input}``."""
    out: dict[str, dict[str, Any]] = {}
    for c in cases:
        try:
            e = compile(c["expr"])
        except CompileError as x:
            out[c["id"]] = {"err": f"compile:{x.code}"}
            continue
        try:
            out[c["id"]] = {"ok": e.evaluate(c.get("input", MISSING), c.get("bindings"))}
        except PathError as x:
            out[c["id"]] = {"err": f"eval:{x.code}"}
    return out


__all__ = ["Compiled", "Expression", "Library", "Outer", "compile", "compile_all", "compile_library", "run_cases"]
