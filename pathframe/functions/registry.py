"""Every built-in by name: signature and implementation."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from functools import cmp_to_key
from typing import Any

from pathframe.dynamic.evaluate import Frame, Native, Run, compare_keys, evaluate, program, same, settle
from pathframe.dynamic.values import MISSING, Function, Outer, Seq, append, hashable, is_number, lookup, precise, truthy, yes
from pathframe.errors import CompileError, EvalError
from pathframe.functions import dates, numbers, regex, text


# -- aggregates ---------------------------------------------------------------------


def _over_numbers(fn: Callable[[list], float], empty: Any) -> Callable[[Any], Any]:
    def run(a: Any) -> Any:
        if a is MISSING:
            return MISSING
        return fn(a) if a else empty

    return run


def count(a: Any) -> float:
    return 0.0 if a is MISSING else float(len(a))


# -- callbacks --------------------------------------------------------------------


def _callback(fn: Any, *values: Any) -> Any:
    """Call with as many of the values as the function declares, one at least."""
    return fn.call(list(values[: max(1, min(fn.arity, len(values)))]), MISSING)


def _function(fn: Any, place: int) -> Function:
    if not isinstance(fn, Function):
        raise EvalError("T0410", f"argument {place}", value=place)
    return fn


def map_(a: Any, fn: Any) -> Any:
    if a is MISSING:
        return MISSING
    out = Seq()
    for i, v in enumerate(a):
        got = _callback(fn, v, float(i), a)
        if got is not MISSING:
            out.append(got)
    return out


def filter_(a: Any, fn: Any) -> Any:
    if a is MISSING:
        return MISSING
    return Seq(v for i, v in enumerate(a) if yes(_callback(fn, v, float(i), a)))


def single(a: Any, fn: Any = MISSING) -> Any:
    if a is MISSING:
        return MISSING
    found = [v for i, v in enumerate(a) if fn is MISSING or yes(_callback(fn, v, float(i), a))]
    if len(found) > 1:
        raise EvalError("D3138")
    if not found:
        raise EvalError("D3139")
    return found[0]


def reduce(a: Any, fn: Any, start: Any = MISSING) -> Any:
    if a is MISSING:
        return MISSING
    if fn.arity < 2:
        raise EvalError("D3050")
    items = list(a)
    at = 0
    if start is MISSING and items:
        start, at = items[0], 1
    for i in range(at, len(items)):
        start = fn.call([start, items[i], float(i), a][: max(2, min(fn.arity, 4))], MISSING)
    return start


def sift(x: Any, fn: Any = MISSING) -> Any:
    if x is MISSING:
        return MISSING
    out = {k: v for k, v in x.items() if yes(_callback(fn, v, k, x))}
    return out or MISSING


def each(x: Any, fn: Any) -> Any:
    if x is MISSING:
        return MISSING
    return Seq(got for k, v in x.items() if (got := _callback(fn, v, k, x)) is not MISSING)


def sort(a: Any, fn: Any = MISSING) -> Any:
    if a is MISSING or len(a) <= 1:
        return a
    if fn is MISSING:
        if not (all(type(v) is float for v in a) or all(type(v) is str for v in a)):
            raise EvalError("D3070")
        return sorted(a, key=cmp_to_key(compare_keys))
    return _merge_sort(list(a), lambda p, q: yes(fn.call([p, q], MISSING)))


def _merge_sort(a: list, after: Callable[[Any, Any], bool]) -> list:
    """Stable; asks only whether the left comes after the right."""
    if len(a) <= 1:
        return a
    half = len(a) // 2
    left, right = _merge_sort(a[:half], after), _merge_sort(a[half:], after)
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if after(left[i], right[j]):
            out.append(right[j])
            j += 1
        else:
            out.append(left[i])
            i += 1
    return out + left[i:] + right[j:]


def distinct(a: Any) -> Any:
    if not isinstance(a, list) or len(a) <= 1:
        return a
    seen: dict = {}
    for v in a:
        seen.setdefault(hashable(v), v)
    return Seq(seen.values()) if isinstance(a, Seq) else list(seen.values())


# -- arrays and objects ----------------------------------------------------------


def keys(x: Any) -> Any:
    if isinstance(x, list):
        out: dict = {}
        for v in x:
            got = keys(v)
            out.update(dict.fromkeys(got if isinstance(got, list) else ()))
        return Seq(out)
    return Seq(x) if type(x) is dict else Seq()


def lookup_(x: Any, key: Any) -> Any:
    return lookup(x, key)


def spread(x: Any) -> Any:
    if isinstance(x, list):
        out: Any = Seq()
        for v in x:
            got = spread(v)
            out.extend(got) if isinstance(got, list) else out.append(got)
        return out
    if type(x) is dict:
        return Seq({k: v} for k, v in x.items())
    return x


def merge(a: Any) -> Any:
    if a is MISSING:
        return MISSING
    out: dict = {}
    for v in a:
        out.update(v)
    return out


def zip_(*lists: Any) -> Any:
    if not lists:
        raise EvalError("T0410")
    return [list(t) for t in zip(*([] if a is MISSING else a if isinstance(a, list) else [a] for a in lists), strict=False)]


def flatten(x: Any) -> Any:
    if not isinstance(x, list):
        return x
    out: list = []
    for v in x:
        out.extend(flatten(v)) if isinstance(v, list) else out.append(v)
    return out


def shuffle(a: Any) -> Any:
    if a is MISSING or len(a) <= 1:
        return a
    return random.sample(list(a), len(a))


def clone(x: Any) -> Any:
    if type(x) is dict:
        return {k: clone(v) for k, v in x.items() if not isinstance(v, Function)}
    if isinstance(x, list):
        return [clone(v) for v in x]
    return precise(x) if type(x) is float else x


# -- types and errors ------------------------------------------------------------------


def type_(x: Any) -> Any:
    if x is MISSING:
        return MISSING
    names = {float: "number", str: "string", bool: "boolean", dict: "object"}
    return "null" if x is None else "array" if isinstance(x, list) else names.get(type(x), "function")


def error(message: Any = MISSING) -> Any:
    raise EvalError("D3137", "$error() function evaluated" if message is MISSING else message)


def assert_(ok: Any, message: Any = MISSING) -> Any:
    if ok is not True:
        raise EvalError("D3141", "$assert() statement failed" if message is MISSING else message)
    return MISSING


def not_(x: Any) -> Any:
    got = truthy(x)
    return MISSING if got is MISSING else not got


def boolean(x: Any) -> Any:
    if type(x) is float:
        is_number(x)
    return truthy(x)


# -- with the evaluation's own state ---------------------------------------------------


def _once(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key twice")
    return out


def _no_constant(name: str) -> Any:
    raise ValueError(name)


def _data(source: str) -> Any:
    """The value of JSON text, which as an expression stands for itself; MISSING if it isn't JSON."""
    if source[:1] not in ("{", "["):
        return MISSING
    try:
        return json.loads(source, parse_int=float, parse_constant=_no_constant, object_pairs_hook=_once)
    except (ValueError, RecursionError):
        return MISSING


def eval_(frame: Frame, context: Any, source: Any, focus: Any = MISSING) -> Any:
    if source is MISSING:
        return MISSING
    value = _data(source)
    if value is not MISSING:
        return value
    if focus is not MISSING:
        context = Outer([focus]) if isinstance(focus, list) and not isinstance(focus, Outer) else focus
    try:
        code = program(source)
    except CompileError as e:
        raise EvalError("D3120", str(e), value=e.code) from e
    try:
        return settle(code(context, frame))
    except EvalError as e:
        raise EvalError("D3121", str(e), value=e.code) from e


def now(frame: Frame, context: Any, picture: Any = MISSING, zone: Any = MISSING) -> Any:
    return dates.from_millis(frame.run.now, picture, zone)


def millis(frame: Frame, context: Any) -> Any:
    return frame.run.now


def to_millis(frame: Frame, context: Any, s: Any, picture: Any = MISSING) -> Any:
    return dates.to_millis(s, picture, frame.run.now)


_PLAIN: list[tuple[str, str | None, Callable]] = [
    ("sum", "<a<n>:n>", _over_numbers(lambda a: float(sum(a)), 0.0)),
    ("count", "<a:n>", count),
    ("max", "<a<n>:n>", _over_numbers(max, MISSING)),
    ("min", "<a<n>:n>", _over_numbers(min, MISSING)),
    ("average", "<a<n>:n>", _over_numbers(lambda a: sum(a) / len(a), MISSING)),
    ("string", "<x-b?:s>", text.string),
    ("substring", "<s-nn?:s>", text.substring),
    ("substringBefore", "<s-s:s>", text.before),
    ("substringAfter", "<s-s:s>", text.after),
    ("lowercase", "<s-:s>", text.lowercase),
    ("uppercase", "<s-:s>", text.uppercase),
    ("length", "<s-:n>", text.length),
    ("trim", "<s-:s>", text.trim),
    ("pad", "<s-ns?:s>", text.pad),
    ("match", "<s-f<s:o>n?:a<o>>", regex.match),
    ("contains", "<s-(sf):b>", regex.contains),
    ("replace", "<s-(sf)(sf)n?:s>", regex.replace),
    ("split", "<s-(sf)n?:a<s>>", regex.split),
    ("join", "<a<s>s?:s>", text.join),
    ("formatNumber", "<n-so?:s>", numbers.format_number),
    ("formatBase", "<n-n?:s>", numbers.format_base),
    ("formatInteger", "<n-s:s>", dates.format_integer),
    ("parseInteger", "<s-s:n>", dates.parse_integer),
    ("number", "<(nsb)-:n>", numbers.number),
    ("floor", "<n-:n>", numbers.floor),
    ("ceil", "<n-:n>", numbers.ceil),
    ("round", "<n-n?:n>", numbers.rounded),
    ("abs", "<n-:n>", numbers.absolute),
    ("sqrt", "<n-:n>", numbers.square_root),
    ("power", "<n-n:n>", numbers.power),
    ("random", "<:n>", numbers.random),
    ("boolean", "<x-:b>", boolean),
    ("not", "<x-:b>", not_),
    ("exists", "<x:b>", lambda x: x is not MISSING),
    ("type", "<x:s>", type_),
    ("error", "<s?:x>", error),
    ("assert", "<bs?:x>", assert_),
    ("clone", "<(oa)-:o>", clone),
    ("map", "<af>", map_),
    ("filter", "<af>", filter_),
    ("single", "<af?>", single),
    ("reduce", "<afj?:j>", reduce),
    ("sift", "<o-f?:o>", sift),
    ("each", "<o-f:a>", each),
    ("sort", "<af?:a>", sort),
    ("distinct", "<x:x>", distinct),
    ("keys", "<x-:a<s>>", keys),
    ("lookup", "<x-s:x>", lookup_),
    ("append", "<xx:a>", append),
    ("spread", "<x-:a<o>>", spread),
    ("flatten", "<x-:x>", flatten),
    ("reverse", "<a:a>", lambda a: a if a is MISSING or len(a) <= 1 else list(reversed(a))),
    ("shuffle", "<a:a>", shuffle),
    ("zip", "<a+>", zip_),
    ("merge", "<a<o>:o>", merge),
    ("base64encode", "<s-:s>", text.base64encode),
    ("base64decode", "<s-:s>", text.base64decode),
    ("encodeUrlComponent", "<s-:s>", text.encode_component),
    ("encodeUrl", "<s-:s>", text.encode_url),
    ("decodeUrlComponent", "<s-:s>", text.decode_component),
    ("decodeUrl", "<s-:s>", text.decode_url),
    ("fromMillis", "<n-s?s?:s>", dates.from_millis),
]
_WITH_FRAME: list[tuple[str, str, Callable]] = [
    ("eval", "<sx?:x>", eval_),
    ("now", "<s?s?:s>", now),
    ("millis", "<:n>", millis),
    ("toMillis", "<s-s?:n>", to_millis),
]


def builtins() -> dict[str, Native]:
    out = {name: Native(name, fn, signature) for name, signature, fn in _PLAIN}
    out |= {name: Native(name, fn, signature, wants_run=True) for name, signature, fn in _WITH_FRAME}
    # As a callback it gets the value alone.
    out["string"].arity = 1
    return out


BUILTINS = builtins()
__all__ = ["BUILTINS", "Run", "evaluate", "same"]
