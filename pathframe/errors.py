"""Error codes and the exceptions that carry them."""

from __future__ import annotations

import re

# Code, meaning.
MESSAGES = {
    "S0101": "String literal is not closed",
    "S0102": "Number is out of range",
    "S0103": "Unknown escape in a string",
    "S0104": "\\u needs four hex digits",
    "S0105": "Backtick name is not closed",
    "S0106": "Comment is not closed",
    "S0201": "Syntax error",
    "S0202": "Another symbol is expected here",
    "S0203": "The expression ends where a symbol is expected",
    "S0204": "Unknown operator",
    "S0205": "Unexpected symbol",
    "S0206": "Unknown expression",
    "S0207": "The expression ends too early",
    "S0208": "A parameter must be a variable",
    "S0209": "A predicate can't follow a grouping in a step",
    "S0210": "A step can be grouped once",
    "S0211": "The symbol can't begin an expression",
    "S0212": "The left side of := must be a variable",
    "S0213": "A literal can't be a step of a path",
    "S0214": "The right side of a binding must be a variable",
    "S0215": "A binding must come before predicates of its step",
    "S0216": "A binding must come before the ordering of its step",
    "S0217": "The parent can't be derived here",
    "S0301": "Empty regular expression",
    "S0302": "Regular expression is not closed",
    "S0401": "Type parameters are for arrays and functions only",
    "S0402": "A choice can't hold parameterised types",
    "D1001": "Number is out of range",
    "D1002": "Only numbers can be negated",
    "D1004": "The expression matches an empty string",
    "D1009": "Keys of an object are not unique",
    "D2014": "The range is too large",
    "D3001": "Not a finite number",
    "D3010": "The second argument can't be empty",
    "D3011": "The limit must be positive",
    "D3012": "A replacement must be a string",
    "D3020": "The limit must be positive",
    "D3030": "Not a number",
    "D3040": "The limit must be positive",
    "D3050": "The function must take two arguments",
    "D3060": "Square root of a negative number",
    "D3061": "Power is out of range",
    "D3070": "Only numbers or only strings have a natural order",
    "D3080": "A picture has two parts at most",
    "D3081": "A part has one decimal separator at most",
    "D3082": "A part has one percent sign at most",
    "D3083": "A part has one per-mille sign at most",
    "D3084": "A part has one of percent and per-mille",
    "D3085": "A part needs a digit",
    "D3086": "A passive character stands inside a part",
    "D3087": "Grouping beside the decimal separator",
    "D3088": "Grouping at the end of the integer part",
    "D3089": "Two grouping separators in a row",
    "D3090": "An optional digit follows a mandatory one",
    "D3091": "A mandatory digit follows an optional one",
    "D3092": "Percent and exponent in one part",
    "D3093": "An exponent needs digits",
    "D3100": "The radix must be from 2 to 36",
    "D3110": "Not an ISO 8601 timestamp",
    "D3120": "Syntax error in $eval",
    "D3121": "Error in $eval",
    "D3130": "The sequence can't be formatted",
    "D3131": "Digits of two families in a picture",
    "D3132": "Unknown component in a date picture",
    "D3133": "Only years and numbers can be named",
    "D3134": "The time zone picture has too many digits",
    "D3135": "A component is not closed",
    "D3136": "The date lacks a component",
    "D3137": "Error",
    "D3138": "More than one value matches",
    "D3139": "No value matches",
    "D3140": "Malformed URL",
    "D3141": "Assertion failed",
    "T0410": "An argument doesn't fit the signature",
    "T0411": "The context doesn't fit the signature",
    "T0412": "An array holds a value of another type",
    "T1003": "A key must be a string",
    "T1005": "Not a function; a variable was meant",
    "T1006": "Not a function",
    "T1007": "A partially applied value is not a function; a variable was meant",
    "T1008": "A partially applied value is not a function",
    "T1010": "The matcher doesn't return a match",
    "T2001": "The left side must be a number",
    "T2002": "The right side must be a number",
    "T2003": "The left side of a range must be an integer",
    "T2004": "The right side of a range must be an integer",
    "T2006": "The right side must be a function",
    "T2007": "Values of two types are ordered",
    "T2008": "Only numbers and strings are ordered",
    "T2009": "Values of two types are compared",
    "T2010": "Only numbers and strings are compared",
    "T2011": "An update must be an object",
    "T2012": "Deletions must be strings",
    "T2013": "$clone is not a function",
    "U1001": "The evaluation is too deep or takes too long",
}


class PathError(Exception):
    """An error with a code; ``position`` is in the expression's text."""

    def __init__(self, code: str, detail: str = "", position: int | None = None, value: object = None):
        self.code, self.position, self.value = code, position, value
        text = MESSAGES.get(code, "")
        super().__init__(f"{code}: {text}{': ' + detail if detail else ''}")
        self.detail = detail


class CompileError(PathError):
    """The expression's text is wrong."""


class EvalError(PathError):
    """The evaluation of an expression went wrong."""


_CODE = re.compile(r"\b([DSTU]\d{4})\b")


def code_of(error: BaseException) -> str | None:
    """The code of an error, also where Spark wraps it in its own exception."""
    if isinstance(error, PathError):
        return error.code
    found = _CODE.search(str(error))
    return found[1] if found else None
