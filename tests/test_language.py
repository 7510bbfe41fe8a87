"""The document evaluator: own cases, and a folder of conformance cases where one is named."""

import glob
import json
import os

import pytest

from pathframe.api import compile, compile_all, compile_library, run_cases
from pathframe.dynamic.values import MISSING, js_number, number, plain
from pathframe.errors import CompileError, EvalError, PathError

DOC = {
    "lib": {"books": [{"isbn": 1, "title": "A"}, {"isbn": 2, "title": "B"}], "loans": [{"isbn": 2, "who": "x"}, {"isbn": 1, "who": "y"}, {"isbn": 9, "who": "z"}]},
    "orders": [{"id": 1, "lines": [{"p": 5, "q": 2}, {"p": 7, "q": 1}]}, {"id": 2, "lines": [{"p": 1, "q": 10}]}],
    "one": [1],
    "n": None,
}

CASES = [
    ("orders.lines.p", [5, 7, 1]),
    ("orders.lines[0].p", [5, 1]),
    ("(orders.lines)[0].p", 5),
    ("orders[-1].id", 2),
    ("orders.lines[p > 4].q", [2, 1]),
    ("$sum(orders.lines.(p * q))", 27),
    ("one", [1]),
    ("orders[id = 2].id", 2),
    ("orders[id = 2].id[]", [2]),
    ("lib.loans@$l.lib.books@$b[$l.isbn = $b.isbn].{'t': $b.title, 'w': $l.who}", None),
    ("lib.loans@$l.$$.lib.books@$b[$l.isbn = $b.isbn].{'t': $b.title, 'w': $l.who}", [{"t": "B", "w": "x"}, {"t": "A", "w": "y"}]),
    ("orders.lines.{'o': %.id, 'p': p}", [{"o": 1, "p": 5}, {"o": 1, "p": 7}, {"o": 2, "p": 1}]),
    ("orders.lines#$i.{'i': $i, 'p': p}", [{"i": 0, "p": 5}, {"i": 1, "p": 7}, {"i": 0, "p": 1}]),
    ("orders^(>id).id", [2, 1]),
    ("orders.lines{ $string(p): q }", {"5": 2, "7": 1, "1": 10}),
    ("orders.lines ~> |$|{'p': 0}, 'q'|", [{"p": 0}, {"p": 0}, {"p": 0}]),
    ("n", None),
    ("$type(n)", "null"),
    ("nothing ?? 'd'", "d"),
    ("0 ?: 'd'", "d"),
    ("[1..5][$ % 2 = 0]", [2, 4]),
    ("($f := function($n) { $n <= 1 ? 1 : $n * $f($n - 1) }; $f(10))", 3628800),
    ("($f := function($n, $a) { $n = 0 ? $a : $f($n - 1, $a + $n) }; $f(5000, 0))", 12502500),
    ("$map([1, 2], function($v) { [$v, $v] })", [[1, 1], [2, 2]]),
    ("$reduce([1..4], function($a, $b) { $a * $b })", 24),
    ("[1..3] ~> $map(function($x) { $x * 2 }) ~> $sum()", 12),
    ("($inc := function($x) { $x + 1 }; $two := $inc ~> $inc; $two(1))", 3),
    ("$filter([1..9], function($v, $i, $a) { $v = $max($a) })", 9),
    ("$eval('1 + 2')", 3),
    ("$match('ab12', /[a-z]+([0-9])/)", {"match": "ab1", "index": 0, "groups": ["1"]}),
    ("$replace('john smith', /(\\w+) (\\w+)/, '$2, $1')", "smith, john"),
    ("$formatNumber(1234.5678, '#,##0.00')", "1,234.57"),
    ("$formatNumber(0.14, '01%')", "14%"),
    ("$formatInteger(1999, 'I')", "MCMXCIX"),
    ("$formatInteger(123, 'w')", "one hundred and twenty-three"),
    ("$parseInteger('twelve thousand, four hundred and seventy-six', 'w')", 12476),
    ("$fromMillis(1510067557121)", "2017-11-07T15:12:37.121Z"),
    ("$fromMillis(1521801216617, '[FNn], [D1o] [MNn] [Y]')", "Friday, 23rd March 2018"),
    ("$toMillis('2017-11-07T15:12:37.121Z')", 1510067557121),
    ("$toMillis('23/3/2018', '[D]/[M]/[Y]')", 1521763200000),
    ("$string({'a': [1, 2.5, 1e21]})", '{"a":[1,2.5,1e+21]}'),
    ("$round(2.5) & ' ' & $round(-0.5) & ' ' & $round(1.005, 2)", "2 0 1"),
    ("$pad('x', -3, '#')", "##x"),
    ("$split('a1b22c', /[0-9]+/)", ["a", "b", "c"]),
    ("**.p", [5, 7, 1]),
    ("$keys(lib)", ["books", "loans"]),
    ("$distinct([1, 1, {'a': 1}, {'a': 1}])", [1, {"a": 1}]),
    ("'a' in ['a', 'b']", True),
    ("$zip([1, 2], [3, 4, 5])", [[1, 3], [2, 4]]),
    ("$merge([{'a': 1}, {'a': 2, 'b': 3}])", {"a": 2, "b": 3}),
    ("$spread({'a': 1, 'b': 2})", [{"a": 1}, {"b": 2}]),
    ("$sift({'a': 1, 'b': 2}, function($v) { $v > 1 })", {"b": 2}),
    ("$single([1, 2], function($v) { $v = 2 })", 2),
    ("/* note */ 1", 1),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_case(text, expected):
    assert compile(text).evaluate(DOC) == expected


ERRORS = [
    ("'a", "S0101"), ("1e999", "S0102"), (r"'\y'", "S0103"), (r"'\u12'", "S0104"), ("`a", "S0105"), ("/* a", "S0106"), ("1 2", "S0201"), ("[1", "S0203"),
    ("(1]", "S0202"), ("a.1", "S0213"), ("1 := 2", "S0212"), ("a@b", "S0214"), ("a[0]@$b", "S0215"), ("a{'x': 1}{'y': 2}", "S0210"), ("%", "S0217"), ("function(x){1}", "S0208"),
    ("'a' + 1", "T2001"), ("1 + 'a'", "T2002"), ("1 < 'a'", "T2009"), ("true < 1", "T2010"), ("-'a'", "D1002"), ("[1.5..2]", "T2003"), ("[1..2.5]", "T2004"),
    ("$sum('a')", "T0412"), ("$nothere(1)", "T1006"), ("sum(1)", "T1005"), ("$sqrt(-1)", "D3060"), ("$number('x')", "D3030"), ("$error('no')", "D3137"),
    ("$assert(false)", "D3141"), ("$single([1, 2])", "D3138"), ("1 ~> 2", "T2006"), ("{1: 2}", "T1003"), ("$toMillis('x')", "D3110"), ("$sort([1, 'a'])", "D3070"),
    ("($f := function() { 1 + $f() }; $f())", "U1001"), ("$eval('1 +')", "D3120"), ("$eval('1 + \"a\"')", "D3121"), ("$decodeUrl('%E0%A4%A')", "D3140"),
]


@pytest.mark.parametrize(("text", "code"), ERRORS)
def test_error(text, code):
    with pytest.raises(PathError) as e:
        compile(text).evaluate(DOC)
    assert e.value.code == code


def test_number_words_go_round():
    from pathframe.functions.dates import number_words

    some = [*range(1200), *(7919 * k for k in range(500)), 10**6, 10**9 + 1, 10**12, 10**15 + 7, 999_999_999_999, 1_000_100, 20_000_020]
    for n in some:
        for picture in ("w", "Ww", "W", "w;o"):
            text = compile(f"$formatInteger({n}, '{picture}')").evaluate()
            assert compile(f"$parseInteger('{text}', '{picture}')").evaluate() == n, text
    assert number_words(1_023_045) == "one million, twenty-three thousand and forty-five"
    assert [compile(f"$parseInteger('{t}', 'w')").evaluate() for t in ("hundred and", "and", "ten-", ", ", "twelve")] == [None, None, 10, None, 12]


def test_dates_far_away():
    import datetime

    for ms in (0, -1, 1e15, -1e14, 8.64e15, -8.64e15, 951782400000, -62135596800001):
        text = compile(f"$fromMillis({int(ms)}, '[Y]-[M]-[D] [H]:[m]:[s].[f001]')").evaluate()
        if -62135596800000 <= ms <= 253402300799999:
            d = datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)
            assert text == f"{d.year}-{d.month}-{d.day} {d.hour}:{d.minute:02d}:{d.second:02d}.{d.microsecond // 1000:03d}"
    assert compile("$fromMillis(1e15, '[Y]-[M01]-[D01]')").evaluate() == "33658-09-27"
    for ms in ("8.64e15 + 1", "-8.64e15 - 1"):
        with pytest.raises(EvalError):
            compile(f"$fromMillis({ms})").evaluate()
    with pytest.raises(EvalError):
        compile("$toMillis('2023-02-30')").evaluate()
    assert compile("$toMillis('2024-02-29T00:00:00Z')").evaluate() == 1709164800000


def test_all_codes_but_those_that_can_not_occur():
    from pathframe.errors import MESSAGES
    from pathframe.queries import CODES

    got = run_cases([{"id": t, "expr": t, "input": {}} for t in CODES])
    assert {t: x["err"].split(":")[1] for t, x in got.items()} == CODES
    assert len(set(CODES.values())) >= 83 and set(CODES.values()) <= set(MESSAGES)


def test_numbers_as_text():
    shown = {0.1 + 0.2: "0.30000000000000004", 1e21: "1e+21", 1e-7: "1e-7", 123456789012: "123456789012", 1.5: "1.5", -0.001: "-0.001", 1e20: "100000000000000000000"}
    assert {js_number(float(k)) for k in shown} == set(shown.values())


def test_bindings_functions_and_libraries():
    e = compile("$twice($n) + $lib(1)")
    library = compile_library({"lib": "function($x) { $x + 0.5 }"})
    e.assign("n", 4).register_function("twice", lambda x: x * 2, "<n:n>").use_library(library)
    assert e.evaluate(None) == 9.5
    assert e.evaluate(None, {"n": 5}) == 11.5
    library.close()
    with pytest.raises(EvalError) as x:
        e.evaluate(None)
    assert x.value.code == "T2006"


def test_compile_all_keeps_going():
    got = compile_all({"a": "1 +", "b": "1 + 1"})
    assert isinstance(got.failures["a"], CompileError) and got.results["b"].evaluate() == 2


def test_limits():
    e = compile("($f := function($n) { $n + $f($n + 1) }; $f(0))").set_max_depth(50)
    with pytest.raises(EvalError):
        e.evaluate()
    slow = compile("($f := function($n) { $f($n + 1) }; $f(0))").set_timeout(200)
    with pytest.raises(EvalError) as x:
        slow.evaluate()
    assert x.value.code == "U1001"


def test_batch_contract():
    got = run_cases([{"id": "a", "expr": "x + 1", "input": {"x": 1}}, {"id": "b", "expr": "'a' + 1"}, {"id": "c", "expr": "["}, {"id": "d", "expr": "$sum"}])
    assert got == {"a": {"ok": 2}, "b": {"err": "eval:T2001"}, "c": {"err": "compile:S0207"}, "d": {"ok": "<fn>"}}


#: A folder with ``datasets/*.json`` and ``groups/<topic>/*.json``; a case has expr or expr-file, data or
#: dataset, bindings, and one of result, undefinedResult and code.
SUITE = os.environ.get("CONFORMANCE_CASES", "")


def _shared_cases():
    tables = {os.path.basename(p)[:-5]: json.load(open(p)) for p in glob.glob(f"{SUITE}/datasets/*.json")}
    for p in sorted(glob.glob(f"{SUITE}/groups/*/*.json")):
        found = json.load(open(p))
        for k, c in enumerate(found if isinstance(found, list) else [found]):
            if c.get("dataset") is not None and c["dataset"] not in tables:
                continue
            text = c.get("expr")
            if text is None:
                text = open(os.path.join(os.path.dirname(p), c["expr-file"])).read()
            data = c["data"] if "data" in c else tables[c["dataset"]] if c.get("dataset") else MISSING
            yield f"{p.split('/')[-2]}/{os.path.basename(p)}/{k}", text, data, c


def _near(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= 1e-12 * max(1, abs(a), abs(b))
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_near, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_near(v, b[k]) for k, v in a.items())
    return a == b


@pytest.mark.skipif(not os.path.isdir(SUITE), reason="no folder of conformance cases is named")
def test_shared_cases():
    wrong, n = [], 0
    for name, text, data, c in _shared_cases():
        n += 1
        try:
            e = compile(text)
            if "timelimit" in c and "depth" in c:
                e.set_timeout(c["timelimit"]).set_max_depth(c["depth"])
            v = e.evaluate_value(number(data), c.get("bindings"))
            got = ("value", v if v is MISSING else plain(v))
        except PathError as x:
            got = ("error", x.code)
        if "code" in c or "error" in c:
            ok = got == ("error", c.get("code") or c["error"]["code"])
        elif c.get("undefinedResult"):
            ok = got == ("value", MISSING)
        else:
            ok = got[0] == "value" and got[1] is not MISSING and _near(got[1], c["result"])
        if not ok:
            wrong.append((name, got))
    assert n >= 490 and not wrong
