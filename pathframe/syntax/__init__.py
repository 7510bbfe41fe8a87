"""From text to a shaped tree."""

from pathframe.syntax.parser import parse
from pathframe.syntax.tree import Node

__all__ = ["Node", "parse"]
