"""Regular expressions of the language on Python's ``re``, and matcher functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

from pathframe.dynamic.values import MISSING, Function, Regex, Seq
from pathframe.errors import EvalError


@lru_cache(maxsize=512)
def compile_regex(source: str, flags: str) -> re.Pattern:
    pattern = re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", source)
    pattern = pattern.replace("\\/", "/").replace("\\d", "[0-9]") if "[" not in source else re.sub(r"\\/", "/", pattern)
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\$(?!\))", r"\1(?!\\n)\\Z" if "m" not in flags else r"\1$", pattern) if pattern.endswith("$") and not pattern.endswith("\\$") else pattern
    return re.compile(pattern, (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0))


class _Next(Function):
    def __init__(self, regex: Regex, text: str, at: int):
        self.regex, self.text, self.at = regex, text, at

    def call(self, args: list, context: Any) -> Any:
        return match_object(self.regex, self.text, self.at)


def match_object(regex: Regex, text: Any, at: int) -> Any:
    """``{match, start, end, groups, next}`` of the first match from ``at``."""
    if not isinstance(text, str):
        return MISSING
    m = regex.compiled.search(text, at)
    if m is None:
        return MISSING
    if m.end() == m.start():
        raise EvalError("D1004", regex.source)
    return {
        "match": m[0],
        "start": float(m.start()),
        "end": float(m.end()),
        "groups": [g if g is not None else "" for g in m.groups()] if m.groups() else [],
        "next": _Next(regex, text, m.end()),
    }


def matches(pattern: Function, text: str) -> Iterator[dict]:
    """Matches of a regex, or of a function that returns match objects."""
    if isinstance(pattern, Regex):
        at = 0
        while at <= len(text):
            m = pattern.compiled.search(text, at)
            if m is None:
                return
            if m.end() == m.start():
                raise EvalError("D1004", pattern.source)
            yield {"match": m[0], "start": float(m.start()), "end": float(m.end()), "groups": [g if g is not None else "" for g in m.groups()]}
            at = m.end()
        return
    found = pattern.call([text], MISSING)
    while found is not MISSING:
        if not (type(found) is dict and (type(found.get("start")) is float or type(found.get("end")) is float)):
            raise EvalError("T1010")
        yield found
        following = found.get("next", MISSING)
        if not isinstance(following, Function):
            raise EvalError("T1010")
        found = following.call([], MISSING)


def contains(text: Any, pattern: Any) -> Any:
    if text is MISSING or pattern is MISSING:
        return MISSING
    if type(pattern) is str:
        return pattern in text
    return next(matches(pattern, text), None) is not None


def match(text: Any, pattern: Any, limit: Any = MISSING) -> Any:
    if text is MISSING:
        return MISSING
    if limit is not MISSING and limit < 0:
        raise EvalError("D3040", value=limit)
    out = Seq()
    for m in matches(pattern, text) if limit is MISSING or limit > 0 else ():
        out.append({"match": m["match"], "index": m["start"], "groups": list(m.get("groups", []))})
        if limit is not MISSING and len(out) >= limit:
            break
    return out


def split(text: Any, by: Any, limit: Any = MISSING) -> Any:
    if text is MISSING:
        return MISSING
    if limit is not MISSING and limit < 0:
        raise EvalError("D3020", value=limit)
    if type(by) is str:
        parts = text.split(by) if by else list(text)
    else:
        parts, at = [], 0
        for m in matches(by, text):
            parts.append(text[at : int(m["start"])])
            at = int(m["end"])
        parts.append(text[at:])
    if limit is not MISSING:
        parts = parts[: int(limit)]
    return parts


def _fill(template: str, m: dict) -> str:
    """``$n`` groups and ``$$`` in a replacement; of the digits as many count as there are groups."""
    groups = m.get("groups", [])
    out, i = [], 0
    while True:
        k = template.find("$", i)
        if k < 0:
            out.append(template[i:])
            return "".join(out)
        out.append(template[i:k])
        i = k + 1
        digits = re.match(r"[0-9]+", template[i:])
        if template[i : i + 1] == "$":
            out.append("$")
            i += 1
        elif digits is None:
            out.append("$")
        elif template[i] == "0":
            out.append(m["match"])
            i += 1
        else:
            width = min(len(str(len(groups))), len(digits[0])) if groups else 1
            n = int(digits[0][:width])
            if width > 1 and n > len(groups):
                width -= 1
                n = int(digits[0][:width])
            if groups and n <= len(groups):
                out.append(groups[n - 1])
            i += width


def replace(text: Any, pattern: Any, by: Any, limit: Any = MISSING) -> Any:
    if text is MISSING:
        return MISSING
    if type(pattern) is str and pattern == "":
        raise EvalError("D3010")
    if limit is not MISSING and limit < 0:
        raise EvalError("D3011", value=limit)
    times = -1 if limit is MISSING else int(limit)
    if type(pattern) is str:
        if isinstance(by, Function):
            raise EvalError("T0410", value=3)
        return text.replace(pattern, by, times) if times else text
    out, at = [], 0
    if times:
        for m in matches(pattern, text):
            new = _fill(by, m) if type(by) is str else by.call([m], MISSING)
            if type(new) is not str:
                raise EvalError("D3012", value=new)
            out += (text[at : int(m["start"])], new)
            at = int(m["end"])
            times -= 1
            if not times:
                break
    return "".join(out) + text[at:]
