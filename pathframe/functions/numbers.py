"""Numbers: rounding, conversion, and number pictures."""

from __future__ import annotations

import math
import random as _random
import re
from decimal import ROUND_HALF_EVEN, Decimal
from functools import lru_cache
from typing import Any

from pathframe.dynamic.values import MISSING, js_number
from pathframe.errors import EvalError

_NUMERIC = re.compile(r"-?[0-9]+(\.[0-9]+)?([Ee][-+]?[0-9]+)?\Z")
_RADIX = re.compile(r"0[xX][0-9a-fA-F]+\Z|0[oO][0-7]+\Z|0[bB][01]+\Z")


def number(x: Any) -> Any:
    if x is MISSING or type(x) is float:
        return x
    if type(x) is bool:
        return float(x)
    if type(x) is str:
        if _NUMERIC.match(x) and not math.isinf(float(x)):
            return float(x)
        if _RADIX.match(x):
            return float(int(x, 0))
    raise EvalError("D3030", value=x)


def _over(fn):
    return lambda x: MISSING if x is MISSING else float(fn(x))


absolute, floor, ceil = _over(abs), _over(math.floor), _over(math.ceil)


def rounded(x: Any, places: Any = MISSING) -> Any:
    """Half to even, on the number's decimal text."""
    if x is MISSING:
        return MISSING
    p = 0 if places is MISSING else int(places)
    d = Decimal(repr(x)) if not math.isinf(x) else None
    if d is None:
        return x
    return float(d.quantize(Decimal(1).scaleb(-p), ROUND_HALF_EVEN)) if p < 300 else x


def square_root(x: Any) -> Any:
    if x is MISSING:
        return MISSING
    if x < 0:
        raise EvalError("D3060", value=x)
    return math.sqrt(x)


def power(x: Any, y: Any) -> Any:
    if x is MISSING:
        return MISSING
    try:
        out = float(x) ** float(y)
    except (OverflowError, ZeroDivisionError):
        raise EvalError("D3061", value=x) from None
    if isinstance(out, complex) or out != out or math.isinf(out):
        raise EvalError("D3061", value=x)
    return out


def random() -> float:
    return _random.random()


def format_base(x: Any, radix: Any = MISSING) -> Any:
    if x is MISSING:
        return MISSING
    n = int(rounded(x))
    base = 10 if radix is MISSING else int(rounded(radix))
    if not 2 <= base <= 36:
        raise EvalError("D3100", value=radix)
    digits, m = "", abs(n)
    while m:
        m, d = divmod(m, base)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return ("-" if n < 0 else "") + (digits or "0")


# -- number pictures, after the XPath and XQuery functions recommendation --------

# The default format.
FORMAT = {
    "decimal-separator": ".", "grouping-separator": ",", "exponent-separator": "e", "infinity": "Infinity", "minus-sign": "-",
    "NaN": "NaN", "percent": "%", "per-mille": "‰", "zero-digit": "0", "digit": "#", "pattern-separator": ";",
}


class _Part:
    """One sub-picture, analysed."""

    def __init__(self, text: str, f: dict[str, str]):
        zero = f["zero-digit"]
        self.family = "".join(chr(ord(zero) + k) for k in range(10))
        active = set(self.family) | {f["decimal-separator"], f["grouping-separator"], f["digit"]}
        e = f["exponent-separator"]
        spots = [i for i, c in enumerate(text) if c in active]
        if not spots:
            raise EvalError("D3085")
        first, last = spots[0], spots[-1]
        self.prefix, self.suffix, body = text[:first], text[last + 1 :], text[first : last + 1]
        at = body.find(e)
        # An exponent separator counts between active characters only.
        self.exponent = ""
        mantissa = body
        if at > 0:
            mantissa, self.exponent = body[:at], body[at + 1 :]
        point = f["decimal-separator"]
        if text.count(point) > 1:
            raise EvalError("D3081")
        if text.count(f["percent"]) > 1:
            raise EvalError("D3082")
        if text.count(f["per-mille"]) > 1:
            raise EvalError("D3083")
        if f["percent"] in text and f["per-mille"] in text:
            raise EvalError("D3084")
        whole, dot, frac = mantissa.partition(point)
        if not any(c in self.family or c == f["digit"] for c in mantissa):
            raise EvalError("D3085")
        if any(c not in active for c in mantissa):
            raise EvalError("D3086")
        group = f["grouping-separator"]
        if dot and (whole.endswith(group) or frac.startswith(group)):
            raise EvalError("D3087")
        if not dot and whole.endswith(group):
            raise EvalError("D3088")
        if group * 2 in text:
            raise EvalError("D3089")
        if re.search("[" + re.escape(self.family) + "].*" + re.escape(f["digit"]), whole.replace(group, "")):
            raise EvalError("D3090")
        if re.search(re.escape(f["digit"]) + ".*[" + re.escape(self.family) + "]", frac.replace(group, "")):
            raise EvalError("D3091")
        if self.exponent and (f["percent"] in text or f["per-mille"] in text):
            raise EvalError("D3092")
        if at > 0 and (not self.exponent or any(c not in self.family for c in self.exponent)):
            raise EvalError("D3093")
        digits = lambda s: [c for c in s if c in self.family or c == f["digit"]]
        fixed = lambda s: sum(c in self.family for c in s)
        self.groups = self._groups(whole, group, digits)
        self.frac_groups = []
        n = 0
        for c in frac:
            if c == group:
                self.frac_groups.append(n)
            else:
                n += 1
        sizes = sorted(self.groups)
        self.every = sizes[0] if sizes and all(p % sizes[0] == 0 for p in sizes) and sizes == [sizes[0] * (k + 1) for k in range(len(sizes))] else 0
        self.least, self.scale = fixed(whole), fixed(whole)
        self.least_frac, self.most_frac = fixed(frac), len(digits(frac))
        if self.least == 0 and self.most_frac == 0:
            if self.exponent:
                self.least_frac = self.most_frac = 1
            else:
                self.least = 1
        if self.exponent and self.least == 0 and f["digit"] in whole:
            self.least = 1
        if self.least == 0 and self.least_frac == 0:
            self.least_frac = 1
        self.least_exp = fixed(self.exponent)
        self.percent, self.mille = f["percent"] in text, f["per-mille"] in text

    @staticmethod
    def _groups(whole: str, group: str, digits) -> list[int]:
        return [len(digits(whole[i + 1 :])) for i, c in enumerate(whole) if c == group]


@lru_cache(maxsize=256)
def _picture(text: str, options: tuple) -> tuple[list[_Part], dict[str, str]]:
    f = {**FORMAT, **dict(options)}
    parts = text.split(f["pattern-separator"])
    if len(parts) > 2:
        raise EvalError("D3080")
    return [_Part(p, f) for p in parts], f


def format_number(x: Any, picture: str, options: Any = MISSING) -> Any:
    if x is MISSING:
        return MISSING
    parts, f = _picture(picture, tuple(sorted(options.items())) if options is not MISSING else ())
    part, prefix = parts[0], parts[0].prefix
    if x < 0:
        if len(parts) > 1:
            part = parts[1]
            prefix = part.prefix
        else:
            prefix = f["minus-sign"] + prefix
    if math.isinf(x):
        return prefix + f["infinity"] + part.suffix
    d = Decimal(repr(abs(x)))
    if part.percent:
        d *= 100
    elif part.mille:
        d *= 1000
    exponent = 0
    if part.exponent:
        if d:
            exponent = d.adjusted() + 1 - part.scale
            d = d.scaleb(-exponent)
    d = d.quantize(Decimal(1).scaleb(-part.most_frac), ROUND_HALF_EVEN)
    whole, _, frac = f"{d:f}".partition(".")
    whole = whole.lstrip("0").rjust(part.least, "0")
    frac = frac.rstrip("0").ljust(part.least_frac, "0")
    if part.every:
        spots = range(part.every, len(whole), part.every)
    else:
        spots = [p for p in sorted(part.groups) if p < len(whole)]
    for k, p in enumerate(sorted(spots)):
        at = len(whole) - p - k
        whole = whole[:at] + f["grouping-separator"] + whole[at:]
    for k, p in enumerate(q for q in part.frac_groups if q < len(frac)):
        frac = frac[: p + k] + f["grouping-separator"] + frac[p + k :]
    text = whole + (f["decimal-separator"] + frac if frac else "")
    if part.exponent:
        text += f["exponent-separator"] + (f["minus-sign"] if exponent < 0 else "") + str(abs(exponent)).rjust(part.least_exp, "0")
    if f["zero-digit"] != "0":
        text = text.translate({ord("0") + k: c for k, c in enumerate(part.family)})
    return prefix + text + part.suffix


__all__ = ["js_number"]
