"""Formula texts as Spark columns.

A formula is plain arithmetic over readings: `value > 50 ? value * 1.1 : window_avg(10)`.
The text is respelled as a Python expression, Python's own `ast` module reads it, and
every node becomes a Column, so that the result runs inside Spark's generated code.
A null result means that the formula fails on that row.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*|&&|\|\||[=!<>]=|[-+*/%<>!?:(),])")
_RESPELLED = {"&&": "and", "||": "or", "!": "~"}
WINDOW_NAME = re.compile(r"window_[A-Za-z]\w*")

NAN, INFINITY = float("nan"), float("inf")


# Words that Python would read as more than a name; the language has none of them.
FOREIGN = frozenset(keyword.kwlist) | {"print", "__import__"}


class FormulaError(ValueError):
    """The text is no formula."""


@dataclass(frozen=True)
class WindowCall:
    """One `window_<name>(size)` call."""

    name: str
    size: int

    @property
    def column(self) -> str:
        return f"window_{self.name}_{self.size}".replace("-", "m")


@dataclass
class _Term:
    column: Column
    kind: str  # "long", "double" or "bool"
    fails: bool = False  # may be null
    constant: float | None = None


def _tokens(text: str) -> list[str]:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match:
            raise FormulaError(f"cannot read {text[at:at + 20]!r}")
        if match.group(1) in FOREIGN:
            raise FormulaError(f"{match.group(1)!r} is not part of a formula")
        found.append(match.group(1))
        at = match.end()
    return found


def _conditional(items: list[str]) -> str:
    """Respell the outermost `c ? a : b` of a bracket level, right to left."""
    if "?" not in items:
        return " ".join(items)
    first, open_marks = items.index("?"), 0
    for at in range(first + 1, len(items)):
        if items[at] == "?":
            open_marks += 1
        elif items[at] == ":":
            if not open_marks:
                yes, no = _conditional(items[first + 1:at]), _conditional(items[at + 1:])
                return f"(({yes}) if ({' '.join(items[:first])}) else ({no}))"
            open_marks -= 1
    raise FormulaError("a ? has no :")


def _respell(text: str) -> str:
    levels: list[list[list[str]]] = [[[]]]  # open brackets > arguments > items
    for token in _tokens(text):
        if token == "(":
            levels.append([[]])
        elif token == ",":
            levels[-1].append([])
        elif token == ")":
            if len(levels) == 1:
                raise FormulaError("a ) has no (")
            closed = "(" + ", ".join(_conditional(argument) for argument in levels.pop()) + ")"
            levels[-1][-1].append(closed)
        else:
            levels[-1][-1].append(_RESPELLED.get(token, token))
    if len(levels) > 1 or len(levels[0]) > 1:
        raise FormulaError("brackets or commas do not match")
    return _conditional(levels[0][0])


def parse_formula(text: str) -> ast.expr:
    """The syntax tree of a formula."""
    try:
        return ast.parse(_respell(text).strip(), mode="eval").body
    except (SyntaxError, RecursionError) as error:
        raise FormulaError(f"not a formula: {text!r}") from error


def _call_name(node: ast.Call) -> str:
    if isinstance(node.func, ast.Name):
        return node.func.id
    if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id in ("math", "Math"):
        return node.func.attr
    raise FormulaError("only functions by name can be called")


def _window_call(node: ast.Call) -> WindowCall | None:
    name = _call_name(node)
    if not WINDOW_NAME.fullmatch(name):
        return None
    try:
        (size,) = [ast.literal_eval(argument) for argument in node.args]
        return WindowCall(name.removeprefix("window_"), int(size))
    except (ValueError, TypeError) as error:
        raise FormulaError(f"{name} takes one constant number") from error


def window_calls(text: str) -> set[WindowCall]:
    """All window calls of a formula."""
    calls = (_window_call(n) for n in ast.walk(parse_formula(text)) if isinstance(n, ast.Call))
    return {call for call in calls if call}


def formula_names(text: str) -> set[str]:
    """All free names of a formula."""
    tree = parse_formula(text)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    called |= {id(n.func.value) for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


def _null(kind: str = "double") -> Column:
    return F.lit(None).cast({"long": "bigint", "bool": "boolean"}.get(kind, kind))


def _kept(result: Column, kind: str, *inputs: _Term) -> Column:
    """`result`, but null as soon as one input is null."""
    failing = [term.column.isNull() for term in inputs if term.fails]
    if not failing:
        return result
    any_failed = failing[0]
    for test in failing[1:]:
        any_failed = any_failed | test
    return F.when(any_failed, _null(kind)).otherwise(result)


class _Translator:
    """Turns one syntax tree into a Column for a given set of bound names."""

    def __init__(self, scope: dict[str, Column | tuple[Column, str]] | Callable, windows: dict[WindowCall, Column], dialect: str):
        self.scope, self.windows, self.javascript = scope, windows, dialect == "ui"

    # -- kinds ---------------------------------------------------------------
    def number(self, term: _Term) -> _Term:
        if term.kind != "bool":
            return term
        if not self.javascript:
            return _Term(_null(), "double", True)
        return _Term(term.column.cast("double"), "double", term.fails)

    def double(self, term: _Term) -> _Term:
        term = self.number(term)
        return term if term.kind == "double" else _Term(term.column.cast("double"), "double", term.fails, term.constant)

    def truth(self, term: _Term) -> _Term:
        if term.kind == "bool":
            return term
        if not self.javascript:
            return _Term(_null("bool"), "bool", True)
        return _Term((term.column != 0) & ~F.isnan(term.column.cast("double")), "bool", term.fails)

    # -- nodes ---------------------------------------------------------------
    def term(self, node: ast.expr) -> _Term:
        visit = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if visit is None:
            raise FormulaError(f"{type(node).__name__} is not part of a formula")
        return visit(node)

    def on_constant(self, node: ast.Constant) -> _Term:
        number = node.value
        if isinstance(number, bool) or not isinstance(number, (int, float)):
            raise FormulaError(f"{number!r} is not a number")
        if isinstance(number, int) and not self.javascript and number < 2 ** 63:
            return _Term(F.lit(number).cast("bigint"), "long", constant=number)
        return _Term(F.lit(float(number)), "double", constant=float(number))

    def on_name(self, node: ast.Name) -> _Term:
        if node.id in ("true", "false"):
            return _Term(F.lit(node.id == "true"), "bool")
        bound = self.scope(node.id) if callable(self.scope) else self.scope.get(node.id)
        if bound is None:
            return _Term(_null(), "double", True)
        column, kind, fails = (*bound, False)[:3] if isinstance(bound, tuple) else (bound, "double", False)
        return _Term(column.cast("double") if self.javascript and kind == "long" else column,
                     "double" if self.javascript and kind == "long" else kind, fails)

    def on_unaryop(self, node: ast.UnaryOp) -> _Term:
        inner = self.term(node.operand)
        if isinstance(node.op, ast.Invert):
            inner = self.truth(inner)
            return _Term(~inner.column, "bool", inner.fails)
        inner = self.number(inner)
        if isinstance(node.op, ast.UAdd):
            return inner
        if isinstance(node.op, ast.USub):
            constant = None if inner.constant is None else -inner.constant
            return _Term(F.negative(inner.column), inner.kind, inner.fails, constant)
        raise FormulaError("unknown sign")

    def on_binop(self, node: ast.BinOp) -> _Term:
        left, right = self.number(self.term(node.left)), self.number(self.term(node.right))
        whole = left.kind == right.kind == "long"
        if not whole:
            left, right = self.double(left), self.double(right)
        kind, fails = ("long" if whole else "double"), left.fails or right.fails
        a, b = left.column, right.column
        if isinstance(node.op, (ast.Add, ast.Sub, ast.Mult)):
            plain, tried = {
                ast.Add: (a + b, F.try_add), ast.Sub: (a - b, F.try_subtract), ast.Mult: (a * b, F.try_multiply),
            }[type(node.op)]
            return _Term(tried(a, b), kind, True) if whole else _Term(plain, kind, fails)
        if not isinstance(node.op, (ast.Div, ast.Mod)):
            raise FormulaError("unknown operator")
        divide = isinstance(node.op, ast.Div)
        if whole:
            quotient = F.call_function("div", a, b) if divide else a % b
            return _Term(F.when(b != 0, quotient), kind, True)
        if right.constant:
            return _Term(a / b if divide else a % b, kind, fails)
        # a * Infinity is what a / 0 gives: an infinity with the sign of a, NaN for 0 and NaN.
        safe = F.coalesce(F.try_divide(a, b), a * INFINITY) if divide else F.coalesce(F.try_mod(a, b), F.lit(NAN))
        return _Term(_kept(safe, kind, left, right), kind, fails)

    def on_compare(self, node: ast.Compare) -> _Term:
        # Relations bind closer than equality, so a chain is folded in two rounds.
        terms, signs = [self.term(node.left), *map(self.term, node.comparators)], list(node.ops)
        for group in ((ast.Lt, ast.LtE, ast.Gt, ast.GtE), (ast.Eq, ast.NotEq)):
            at = 0
            while at < len(signs):
                if isinstance(signs[at], group):
                    terms[at:at + 2] = [self.compared(signs.pop(at), terms[at], terms[at + 1])]
                else:
                    at += 1
        if signs:
            raise FormulaError("unknown comparison")
        return terms[0]

    def compared(self, sign: ast.cmpop, left: _Term, right: _Term) -> _Term:
        fails = left.fails or right.fails
        if left.kind == right.kind == "bool" and isinstance(sign, (ast.Eq, ast.NotEq)):
            same = left.column == right.column
            return _Term(same if isinstance(sign, ast.Eq) else ~same, "bool", fails)
        left, right = self.number(left), self.number(right)
        fails = left.fails or right.fails
        a, b = left.column, right.column
        # Spark holds NaN for the largest number and equal to itself; here it compares with nothing.
        a_nan = F.isnan(a) if left.kind == "double" and left.constant is None else None
        b_nan = F.isnan(b) if right.kind == "double" and right.constant is None else None
        test, guard = {
            ast.Gt: (a > b, a_nan), ast.GtE: (a >= b, a_nan), ast.Lt: (a < b, b_nan),
            ast.LtE: (a <= b, b_nan), ast.Eq: (a == b, a_nan), ast.NotEq: (a != b, a_nan),
        }[type(sign)]
        if guard is not None:
            test = test | guard if isinstance(sign, ast.NotEq) else test & ~guard
        return _Term(_kept(test, "bool", left, right), "bool", fails)

    def on_boolop(self, node: ast.BoolOp) -> _Term:
        result = self.truth(self.term(node.values[0]))
        both = isinstance(node.op, ast.And)
        for value in node.values[1:]:
            other = self.truth(self.term(value))
            joined = result.column & other.column if both else result.column | other.column
            # A failing left side is never saved by the right side.
            result = _Term(_kept(joined, "bool", result), "bool", result.fails or other.fails)
        return result

    def on_ifexp(self, node: ast.IfExp) -> _Term:
        test, yes, no = self.truth(self.term(node.test)), self.term(node.body), self.term(node.orelse)
        if yes.kind != no.kind:
            yes, no = self.double(yes), self.double(no)
        chosen = F.when(test.column, yes.column).otherwise(no.column)
        return _Term(_kept(chosen, yes.kind, test), yes.kind, test.fails or yes.fails or no.fails)

    def on_call(self, node: ast.Call) -> _Term:
        if node.keywords:
            raise FormulaError("arguments go by position")
        window = _window_call(node)
        if window is not None:
            column = self.windows.get(window)
            return _Term(_null(), "double", True) if column is None else _Term(column, "double")
        name, given = _call_name(node), [self.number(self.term(argument)) for argument in node.args]
        try:
            return getattr(self, f"call_{name}")(*given)
        except (AttributeError, TypeError) as error:
            raise FormulaError(f"cannot call {name} with {len(given)} arguments") from error

    # -- functions -----------------------------------------------------------
    def of_double(self, make: Callable[[Column], Column], given: _Term) -> _Term:
        given = self.double(given)
        return _Term(_kept(make(given.column), "double", given), "double", given.fails)

    def call_abs(self, x: _Term) -> _Term:
        return _Term(F.abs(x.column), x.kind, x.fails)

    def call_sqrt(self, x: _Term) -> _Term:
        return self.of_double(F.sqrt, x)

    def call_sin(self, x: _Term) -> _Term:
        return self.of_double(F.sin, x)

    def call_cos(self, x: _Term) -> _Term:
        return self.of_double(F.cos, x)

    def call_log(self, x: _Term) -> _Term:
        return self.of_double(lambda v: F.when(v > 0, F.ln(v)).when(v == 0, -INFINITY).otherwise(NAN), x)

    def whole(self, make: Callable[[Column], Column], x: _Term, shift: float = 0.0) -> _Term:
        # Doubles beyond 2^53 are whole already and do not fit the long that floor() gives.
        def rounded(v: Column) -> Column:
            return F.when(F.abs(v) < 9e15, make(v + shift if shift else v).cast("double")).otherwise(v)

        return self.of_double(rounded, x)

    def call_round(self, x: _Term) -> _Term:
        return self.whole(F.floor, x, 0.5)

    def call_floor(self, x: _Term) -> _Term:
        return self.whole(F.floor, x)

    def call_ceil(self, x: _Term) -> _Term:
        return self.whole(F.ceil, x)

    def call_pow(self, x: _Term, y: _Term) -> _Term:
        x, y = self.double(x), self.double(y)
        return _Term(F.pow(x.column, y.column), "double", x.fails or y.fails)

    def extreme(self, make: Callable[..., Column], given: tuple[_Term, ...]) -> _Term:
        if len(given) < 2:
            raise FormulaError("min and max take two numbers or more")
        if all(x.kind == "long" for x in given):
            return _Term(_kept(make(*[x.column for x in given]), "long", *given), "long", any(x.fails for x in given))
        given = tuple(self.double(x) for x in given)
        any_nan = F.lit(False)
        for x in given:
            if x.constant is None:
                any_nan = any_nan | F.isnan(x.column)
        result = F.when(any_nan, NAN).otherwise(make(*[x.column for x in given]))
        return _Term(_kept(result, "double", *given), "double", any(x.fails for x in given))

    def call_min(self, *given: _Term) -> _Term:
        return self.extreme(F.least, given)

    def call_max(self, *given: _Term) -> _Term:
        return self.extreme(F.greatest, given)


def formula_column(
    text: str,
    scope: dict[str, Column | tuple] | Callable[[str], Column | tuple | None],
    windows: dict[WindowCall, Column] | None = None,
    dialect: str = "server",
) -> Column:
    """The formula as a double Column; null where it fails.

    `scope` gives the Column of a name, as a mapping or a function; a pair also names its
    kind ("long", "double" or "bool") and a triple says whether it may be null. Dialect
    "server" divides whole numbers as such and wants conditions to be truth values;
    dialect "ui" knows doubles only and takes numbers as conditions.
    """
    translator = _Translator(scope, windows or {}, dialect)
    term = translator.term(parse_formula(text))
    if term.kind == "bool":  # a truth value is no reading
        return _null() if dialect == "server" else F.lit(0.0)
    return translator.double(term).column


def all_windows(texts: Iterable[str]) -> set[WindowCall]:
    """Window calls of several formulas; texts that are no formulas have none."""
    found: set[WindowCall] = set()
    for text in texts:
        try:
            found |= window_calls(text)
        except FormulaError:
            continue
    return found
