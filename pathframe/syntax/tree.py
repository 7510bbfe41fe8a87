"""Nodes of the tree."""

from __future__ import annotations

from typing import Any


class Node:
    """A node of some kind; what a kind doesn't have is None.

    Kinds: string, number, value, regex, name, variable, wildcard,
    descendants, parent, array, object, neg, op, bind, block, cond, elvis,
    coalesce, call, partial, hole, lambda, chain, transform, range, path, sort.
    """

    def __init__(self, kind: str, pos: int = 0, **fields: Any):
        self.kind, self.pos = kind, pos
        self.__dict__.update(fields)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        return None

    def __repr__(self) -> str:
        shown = {k: v for k, v in self.__dict__.items() if k not in ("kind", "pos") and v not in (None, False, [])}
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in shown.items())})"

    def key(self) -> Any:
        """A comparable form without positions."""

        def of(v: Any) -> Any:
            if isinstance(v, Node):
                return v.key()
            if isinstance(v, (list, tuple)):
                return tuple(of(x) for x in v)
            return v

        return (self.kind, *sorted((k, of(v)) for k, v in self.__dict__.items() if k not in ("kind", "pos") and v not in (None, False)))
