"""Signatures like ``<s-nn?:s>``: what arguments a function takes.

Letters are types: s string, n number, b boolean, l null, a array, o object,
f function, x any, j any but a function, ``(sn)`` one of several; ``?``
optional, ``+`` one or more, ``-`` defaults to the context.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from pathframe.dynamic.values import MISSING, symbol
from pathframe.errors import CompileError, EvalError


@dataclass
class Param:
    letters: str
    pattern: str
    items: str | None = None
    context: str | None = None

    @property
    def array(self) -> bool:
        return self.letters == "a"


class Signature:
    def __init__(self, text: str):
        self.text = text
        self.params: list[Param] = []
        i, body = 1, text.rstrip()
        while i < len(body) and body[i] not in ":>":
            c = body[i]
            if c in "snblo":
                self.params.append(Param(c, f"[{c}m]"))
            elif c == "a":
                self.params.append(Param("a", "[asnblfom]"))
            elif c == "f":
                self.params.append(Param("f", "f"))
            elif c == "j":
                self.params.append(Param("j", "[asnblom]"))
            elif c in "xu":
                self.params.append(Param(c, "[asnblfom]"))
            elif c == "-" and self.params:
                p = self.params[-1]
                p.context, p.pattern = p.pattern, p.pattern + "?"
            elif c in "?+" and self.params:
                self.params[-1].pattern += c
            elif c == "(":
                end = body.find(")", i)
                choice = body[i + 1 : end]
                if "<" in choice:
                    raise CompileError("S0402", choice)
                self.params.append(Param(f"({choice})", f"[{choice}m]"))
                i = end
            elif c == "<" and self.params:
                if self.params[-1].letters not in ("a", "f"):
                    raise CompileError("S0401", self.params[-1].letters)
                depth, end = 1, i
                while depth and end + 1 < len(body):
                    end += 1
                    depth += (body[end] == "<") - (body[end] == ">")
                self.params[-1].items = body[i + 1 : end]
                i = end
            i += 1
        self.regex = re.compile("".join(f"({p.pattern})" for p in self.params) + r"\Z")

    @staticmethod
    @lru_cache(maxsize=512)
    def of(text: str) -> Signature:
        return Signature(text)

    def check(self, args: list, context: Any) -> list:
        """The arguments as the function gets them: context filled in, scalars wrapped where arrays are wanted."""
        given = "".join(map(symbol, args))
        m = self.regex.match(given)
        if not m:
            raise self.mismatch(given)
        out, at = [], 0
        for k, p in enumerate(self.params):
            found = m[k + 1]
            if not found:
                if p.context:
                    if not re.match(p.context, symbol(context)):
                        raise EvalError("T0411", value=at + 1)
                    out.append(context)
                else:
                    out.append(args[at] if at < len(args) else MISSING)
                    at += 1
                continue
            for letter in found:
                value = args[at] if at < len(args) else MISSING
                at += 1
                if p.array and letter != "m":
                    if p.items is not None and not self._fits(p.items, letter, value):
                        raise EvalError("T0412", value=value)
                    if letter != "a":
                        value = [value]
                out.append(value)
        return out

    @staticmethod
    def _fits(items: str, letter: str, value: Any) -> bool:
        if letter != "a":
            return letter == items
        return all(symbol(v) == items[0] for v in value)

    def mismatch(self, given: str) -> EvalError:
        """T0410 for the first argument that can't be."""
        ok = 0
        pattern = ""
        for p in self.params:
            pattern += p.pattern
            m = re.match(pattern, given)
            if not m:
                break
            ok = m.end()
        return EvalError("T0410", f"argument {ok + 1}", value=ok + 1)
