"""The document evaluator over columns of JSON text, in Arrow batches."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathframe.dynamic.values import plain

if TYPE_CHECKING:
    from pathframe.api import Expression
    from pathframe.syntax import Node


def _sent(expression: Expression) -> tuple[str, dict[str, Any], float | None, int | None]:
    return expression.text, expression._names, expression._timeout, expression._depth


def _received(sent: tuple) -> Expression:
    from pathframe.api import Expression

    text, names, timeout, depth = sent
    e = Expression(text)
    e._names, e._timeout, e._depth = dict(names), timeout, depth
    return e


def document_column(expression: Expression, json_text: Column) -> Column:
    """The result for each document, as JSON text; missing is null.

    Workers compile an expression once; compiled programs are cached.
    """
    sent = _sent(expression)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        e = _received(sent)
        return pd.Series([e.evaluate_json(t if isinstance(t, str) else None) for t in texts], dtype="object")

    return run(json_text)


def evaluate_json_column(expression: Expression, df: DataFrame, column: str, output: str = "result") -> DataFrame:
    return df.withColumn(output, document_column(expression, F.col(f"`{column}`")))


def node_column(node: Node, names: dict[str, Any], json_text: Column, beside: Column | None = None) -> Column:
    """A sub-expression over each item as JSON, with the scalars in scope as variables: JSON text.

    ``beside`` has each row's own variables, as one JSON object.
    """

    def evaluated(texts: pd.Series, variables: pd.Series | None) -> pd.Series:
        from pathframe.dynamic.evaluate import Frame, Run, compile_node, evaluate
        from pathframe.dynamic.values import MISSING
        from pathframe.functions.registry import BUILTINS

        code = compile_node(node)
        root = Frame(None, Run(), dict(BUILTINS))
        out = []
        for i, t in enumerate(texts):
            own = json.loads(variables[i], parse_int=float) if variables is not None else {}
            frame = Frame(root, Run(), {**names, **own})
            got = evaluate(code, json.loads(t, parse_int=float) if isinstance(t, str) else MISSING, frame)
            out.append(None if got is MISSING else json.dumps(plain(got), ensure_ascii=False, separators=(",", ":")))
        return pd.Series(out, dtype="object")

    if beside is None:

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return evaluated(texts, None)

        return run(json_text)

    @F.pandas_udf("string")
    def run_bound(texts: pd.Series, variables: pd.Series) -> pd.Series:
        return evaluated(texts, variables)

    return run_bound(json_text, beside)
