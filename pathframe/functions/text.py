"""Strings and encodings."""

from __future__ import annotations

import base64
import math
import re
from typing import Any
from urllib.parse import quote, unquote_to_bytes

from pathframe.dynamic.values import MISSING, Function, Outer, to_json
from pathframe.errors import EvalError


def _finite(x: Any, code: str = "D3001") -> None:
    if type(x) is float and (x != x or math.isinf(x)):
        raise EvalError(code, value=x)
    for v in x.values() if type(x) is dict else x if isinstance(x, list) else ():
        _finite(v, "D1001")


def string(x: Any, prettify: Any = MISSING) -> Any:
    if x is MISSING:
        return MISSING
    if type(x) is str:
        return x
    if isinstance(x, Function):
        return ""
    _finite(x)
    if isinstance(x, Outer):
        x = x[0]
    return to_json(x, 2 if prettify is True else 0)


def substring(s: Any, start: float, length: Any = MISSING) -> Any:
    if s is MISSING:
        return MISSING
    n = len(s)
    begin = int(start) if start == int(start) else math.trunc(start)
    if n + begin < 0:
        begin = 0
    if length is MISSING:
        return s[begin:] if begin >= 0 else s[n + begin :]
    if length <= 0:
        return ""
    first = begin if begin >= 0 else n + begin
    stop = int(math.trunc(first + length))
    return s[first:stop]


def before(s: Any, mark: Any) -> Any:
    if s is MISSING:
        return MISSING
    at = s.find(mark) if mark is not MISSING else -1
    return s[:at] if at >= 0 else s


def after(s: Any, mark: Any) -> Any:
    if s is MISSING:
        return MISSING
    at = s.find(mark) if mark is not MISSING else -1
    return s[at + len(mark) :] if at >= 0 else s


def over(fn):
    """A function of one argument for which missing stays missing."""

    def run(x: Any) -> Any:
        return MISSING if x is MISSING else fn(x)

    return run


lowercase = over(str.lower)
uppercase = over(str.upper)
length = over(lambda s: float(len(s)))


@over
def trim(s: str) -> str:
    s = re.sub(r"[ \t\n\r]+", " ", s)
    return s.removeprefix(" ").removesuffix(" ")


def pad(s: Any, width: float, fill: Any = MISSING) -> Any:
    if s is MISSING:
        return MISSING
    fill = fill if fill is not MISSING and fill else " "
    need = int(abs(width)) - len(s)
    if need <= 0:
        return s
    padding = (fill * (need // len(fill) + 1))[:need]
    return s + padding if width > 0 else padding + s


def join(parts: Any, by: Any = MISSING) -> Any:
    if parts is MISSING:
        return MISSING
    return ("" if by is MISSING else by).join(parts)


@over
def base64encode(s: str) -> str:
    return base64.b64encode(s.encode("latin-1", "replace")).decode()


@over
def base64decode(s: str) -> str:
    return base64.b64decode(s + "=" * (-len(s) % 4)).decode("latin-1")


# Characters that the encodings leave as they are.
_COMPONENT = "-_.!~*'()"
_URL = _COMPONENT + ";,/?:@&=+$#"


def _encoded(s: str, safe: str, name: str) -> str:
    try:
        return quote(s, safe=safe)
    except UnicodeEncodeError:
        raise EvalError("D3140", name, value=s) from None


def _decoded(s: str, name: str) -> str:
    if re.search(r"%(?![0-9a-fA-F]{2})", s):
        raise EvalError("D3140", name, value=s)
    try:
        return unquote_to_bytes(s).decode()
    except UnicodeDecodeError:
        raise EvalError("D3140", name, value=s) from None


encode_component = over(lambda s: _encoded(s, _COMPONENT, "encodeUrlComponent"))
encode_url = over(lambda s: _encoded(s, _URL, "encodeUrl"))
decode_component = over(lambda s: _decoded(s, "decodeUrlComponent"))


@over
def decode_url(s: str) -> str:
    """Escapes of reserved characters stay."""
    kept = re.sub(r"%(?=3B|2C|2F|3F|3A|40|26|3D|2B|24|23)", "%25", s, flags=re.I)
    return _decoded(kept, "decodeUrl")
