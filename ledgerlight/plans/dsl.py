"""The rule language: text to tree, and tree to a pair of columns, value and error.

Expressions are literals, fields (Tx.usd, Entity.name, Entity?.name), lists, ranges of whole numbers (1..5), calls, arithmetic,
comparison, boolean logic, membership and string tests, the ternary, a default for nothing (??), named parts (let x = ...;
...), pipes (x | f(y) is f(x, y)), and any, all, none, one and count of a list or range with a test of its items (#). Errors are values: a rule that cannot be evaluated for a row yields an error there,
never an exception. As `&&` and `||` don't look at their right side when the left one decides, neither does its error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_RULE = 2048
_TOKEN = re.compile(r"""\s*(?:(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_][A-Za-z_0-9]*)|(\*\*|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\.\.|[-+*/%<>!()\[\]{},.?:^|;=#]))""")
_WORDS = {"and": "&&", "or": "||", "not": "!"}
_TIGHT = {"|": 1, "..": 4.5, "??": 9, "?": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "in": 4, "contains": 4, "startsWith": 4, "endsWith": 4, "matches": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "**": 8, "^": 8}


class RuleError(ValueError):
    """A rule that is refused."""


@dataclass(frozen=True)
class Node:
    kind: str  # number, text, flag, nothing, field, list, call, unary, binary, choice
    value: object = None
    parts: tuple = ()


def parse(text: str) -> Node:
    if len(text.encode()) > LONGEST_RULE:
        raise RuleError(f"a rule has at most {LONGEST_RULE} bytes")
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(f"unexpected {text[at:].strip()[:10]!r}")
        kind = ("number", "text", "name", "sign")[m.lastindex - 1]
        word = m[m.lastindex]
        tokens.append(("sign", _WORDS[word]) if word in _WORDS else ("sign", ".") if word == "?." else (kind, word))
        at = m.end()
    while tokens[:1] == [("name", "let")]:
        tokens = _let(tokens[1:])
    tree, rest = _binary(tokens, 0)
    if rest:
        raise RuleError(f"unexpected {rest[0][1]!r}")
    return tree


def _let(tokens: list) -> list:
    """The tokens after a named part, with its tree in the place of its name."""
    if len(tokens) < 2 or tokens[0][0] != "name" or tokens[0][1] in ("Tx", "Entity", "let"):
        raise RuleError("let takes a name")
    name, (tree, rest) = tokens[0][1], _binary(_expect(tokens[1:], "="), 1)
    rest = _expect(rest, ";")
    alone = lambda i: rest[i - 1 : i] != [("sign", ".")] and rest[i + 1 : i + 2] != [("sign", "(")]
    return [("tree", tree) if t == ("name", name) and alone(i) else t for i, t in enumerate(rest)]


def _binary(tokens: list, least: float) -> tuple[Node, list]:
    left, tokens = _unary(tokens)
    while tokens:
        sign = tokens[0][1]
        negated = sign == "!" and len(tokens) > 1 and tokens[1][1] == "in"
        if negated:
            tokens, sign = tokens[1:], "in"
        tight = _TIGHT.get(sign, 0) if tokens[0][0] in ("sign", "name") else 0
        if not tight or tight < least:
            break
        if sign == "?":
            yes, tokens = _binary(tokens[1:], 1)
            no, tokens = _binary(_expect(tokens, ":"), 1)
            left = Node("choice", None, (left, yes, no))
        elif sign == "|":
            call, tokens = _unary(tokens[1:])
            if call.kind != "call":
                raise RuleError("| takes a call")
            left = Node("call", call.value, (left, *call.parts))
        else:
            right, tokens = _binary(tokens[1:], tight + (0.25 if sign not in ("**", "^") else 0))
            left = Node("binary", sign, (left, right))
            if negated:
                left = Node("unary", "!", (left,))
    return left, tokens


def _expect(tokens: list, sign: str) -> list:
    if not tokens or tokens[0] != ("sign", sign):
        raise RuleError(f"{sign!r} is missing")
    return tokens[1:]


def _unary(tokens: list) -> tuple[Node, list]:
    if not tokens:
        raise RuleError("the rule ends too early")
    (kind, word), rest = tokens[0], tokens[1:]
    if kind == "tree":
        return word, rest
    if (kind, word) == ("sign", "#"):
        return Node("item"), rest
    if (kind, word) == ("sign", "{"):
        inner, rest = _binary(rest, 1)
        return inner, _expect(rest, "}")
    if kind == "sign" and word in "!-+":
        inner, rest = _binary(rest, 7)
        return Node("unary", word, (inner,)), rest
    if kind == "number":
        return Node("number", float(word) if re.search(r"[.eE]", word) else int(word)), rest
    if kind == "text":
        return Node("text", re.sub(r"\\(.)", r"\1", word[1:-1])), rest
    if (kind, word) == ("sign", "("):
        inner, rest = _binary(rest, 1)
        return inner, _expect(rest, ")")
    if (kind, word) == ("sign", "["):
        parts, rest = _several(rest, "]")
        return Node("list", None, parts), rest
    if kind != "name":
        raise RuleError(f"unexpected {word!r}")
    if word in ("true", "false"):
        return Node("flag", word == "true"), rest
    if word in ("nil", "null"):
        return Node("nothing"), rest
    if rest and rest[0] == ("sign", "."):
        if len(rest) < 2 or rest[1][0] != "name" or word not in ("Tx", "Entity"):
            raise RuleError(f"unknown field {word}")
        return Node("field", (word, rest[1][1])), rest[2:]
    if rest and rest[0] == ("sign", "("):
        parts, rest = _several(rest[1:], ")")
        return Node("call", word, parts), rest
    raise RuleError(f"unknown name {word}")


def _several(tokens: list, end: str) -> tuple[tuple, list]:
    parts = []
    while tokens and tokens[0] != ("sign", end):
        part, tokens = _binary(tokens, 1)
        parts.append(part)
        if tokens and tokens[0] == ("sign", ","):
            tokens = tokens[1:]
        elif not tokens or tokens[0] != ("sign", end):
            raise RuleError(f"{end!r} is missing")
    return tuple(parts), _expect(tokens, end)


#: Whole numbers in a range at most.
LONGEST_RANGE = 1000
_TESTS = ("any", "all", "none", "one", "count")


def _put(node: Node, item: Node) -> Node:
    """node with item in the place of #; tests within it have items of their own."""
    if node.kind == "item":
        return item
    if node.kind == "call" and node.value in _TESTS and len(node.parts) == 2:
        return Node(node.kind, node.value, (_put(node.parts[0], item), node.parts[1]))
    return Node(node.kind, node.value, tuple(_put(p, item) for p in node.parts))


def _whole(node: Node) -> int | None:
    """The value of a constant whole number, sums and products of some included."""
    if node.kind == "number":
        return node.value if isinstance(node.value, int) else None
    parts = [_whole(p) for p in node.parts] if node.kind in ("unary", "binary") else [None]
    if None in parts or node.value not in ("+", "-", "*"):
        return None
    if node.kind == "unary":
        return -parts[0] if node.value == "-" else parts[0]
    return {"+": parts[0] + parts[1], "-": parts[0] - parts[1], "*": parts[0] * parts[1]}[node.value]


def _listed(node: Node) -> tuple | None:
    """The items of a list or range, as nodes."""
    if node.kind == "list":
        return node.parts
    if node.kind == "binary" and node.value == "..":
        low, high = map(_whole, node.parts)
        if low is None or high is None or high - low >= LONGEST_RANGE:
            raise RuleError(f"a range has whole numbers at both ends, {LONGEST_RANGE} of them at most")
        return tuple(Node("number", i) for i in range(low, high + 1))
    return None


def walk(node: Node):
    yield node
    for part in node.parts:
        yield from walk(part)


@dataclass(frozen=True)
class Value:
    """kind: number, text, flag, list or nothing. error is a string, null where there is none."""

    column: Column
    kind: str
    error: Column | None = None
    items: tuple = ()


def _first(*errors: Column | None) -> Column | None:
    some = [e for e in errors if e is not None]
    return F.coalesce(*some) if len(some) > 1 else some[0] if some else None


@dataclass
class Compiler:
    """fields: the column and kind of each field. terms: what each call of the vocabulary compiles to, given its arguments."""

    fields: dict[tuple[str, str], tuple[Column, str]]
    terms: dict[str, Callable[[list[Node], list[Value]], Value]] = field(default_factory=dict)

    def rule(self, node: Node) -> Value:
        value = self.compile(node)
        if value.kind != "flag":
            raise RuleError(f"a rule is true or false, not a {value.kind}")
        return value

    def compile(self, node: Node) -> Value:
        return getattr(self, "_" + node.kind)(node)

    def _number(self, node: Node) -> Value:
        return Value(F.lit(node.value), "number")

    def _text(self, node: Node) -> Value:
        return Value(F.lit(node.value), "text")

    def _flag(self, node: Node) -> Value:
        return Value(F.lit(node.value), "flag")

    def _nothing(self, node: Node) -> Value:
        return Value(F.lit(None).cast("string"), "nothing")

    def _field(self, node: Node) -> Value:
        if node.value not in self.fields:
            raise RuleError(f"unknown field {'.'.join(node.value)}")
        column, kind = self.fields[node.value]
        empty = {"text": F.lit(""), "number": F.lit(0.0), "flag": F.lit(False)}[kind]
        return Value(F.coalesce(column, empty), kind)

    def _list(self, node: Node) -> Value:
        items = tuple(self.compile(p) for p in node.parts)
        if len({i.kind for i in items}) > 1:
            raise RuleError("a list has values of one kind")
        return Value(F.array(*(i.column for i in items)), "list", _first(*(i.error for i in items)), items)

    def _unary(self, node: Node) -> Value:
        x = self.compile(node.parts[0])
        self._need(x, "flag" if node.value == "!" else "number", node.value)
        return Value({"!": lambda c: ~c, "-": lambda c: -c, "+": lambda c: c}[node.value](x.column), x.kind, x.error)

    def _choice(self, node: Node) -> Value:
        test, yes, no = map(self.compile, node.parts)
        self._need(test, "flag", "?")
        if yes.kind != no.kind:
            raise RuleError("both sides of ? : have one kind")
        none = F.lit(None).cast("string")
        side = F.when(test.column, yes.error if yes.error is not None else none).otherwise(no.error if no.error is not None else none)
        return Value(F.when(test.column, yes.column).otherwise(no.column), yes.kind, _first(test.error, side if yes.error is not None or no.error is not None else None))

    def _item(self, node: Node) -> Value:
        raise RuleError("# stands for an item of a list")

    def _test(self, node: Node) -> Value:
        """any, all, none, one or count of the items that a test holds for."""
        items = _listed(node.parts[0])
        if items is None:
            raise RuleError(f"{node.value} takes a list or a range")
        found = [self.compile(_put(node.parts[1], item)) for item in items]
        for f in found:
            self._need(f, "flag", node.value)
        error, n = _first(*(f.error for f in found)), F.lit(0)
        for f in found:
            n = n + F.coalesce(f.column, F.lit(False)).cast("int")
        if node.value == "count":
            return Value(n, "number", error)
        return Value({"any": n > 0, "all": n == len(found), "none": n == 0, "one": n == 1}[node.value], "flag", error)

    def _binary(self, node: Node) -> Value:
        if node.value == "..":
            return self._list(Node("list", None, _listed(node)))
        sign, (a, b) = node.value, map(self.compile, node.parts)
        if sign == "??":
            if a.kind == "nothing":
                return b
            if b.kind not in (a.kind, "nothing"):
                raise RuleError("both sides of ?? have one kind")
            return Value(F.coalesce(a.column, b.column), a.kind, _first(a.error, F.when(a.column.isNull(), b.error) if b.error is not None else None))
        if sign in ("&&", "||"):
            self._need(a, "flag", sign)
            self._need(b, "flag", sign)
            left, seen = F.coalesce(a.column, F.lit(False)), None
            if b.error is not None:
                seen = F.when(left if sign == "&&" else ~left, b.error)
            both = left & F.coalesce(b.column, F.lit(False)) if sign == "&&" else left | F.coalesce(b.column, F.lit(False))
            return Value(both, "flag", _first(a.error, seen))
        error = _first(a.error, b.error)
        if sign == "in":
            self._need(b, "list", sign)
            if b.items and b.items[0].kind != a.kind:
                raise RuleError("in compares values of one kind")
            return Value(a.column.isin(*(i.column for i in b.items)) if b.items else F.lit(False), "flag", error)
        if sign in ("contains", "startsWith", "endsWith", "matches"):
            self._need(a, "text", sign)
            self._need(b, "text", sign)
            found = {"contains": a.column.contains, "startsWith": a.column.startswith, "endsWith": a.column.endswith, "matches": lambda c: F.regexp_like(a.column, c)}[sign](b.column)
            return Value(found, "flag", error)
        if sign in ("==", "!="):
            if "nothing" not in (a.kind, b.kind) and a.kind != b.kind:
                raise RuleError(f"{a.kind} {sign} {b.kind}")
            same = a.column.eqNullSafe(b.column)
            return Value(same if sign == "==" else ~same, "flag", error)
        if sign in ("<", "<=", ">", ">="):
            if a.kind != b.kind or a.kind not in ("number", "text"):
                raise RuleError(f"{a.kind} {sign} {b.kind}")
            return Value({"<": a.column < b.column, "<=": a.column <= b.column, ">": a.column > b.column, ">=": a.column >= b.column}[sign], "flag", error)
        if sign == "+" and a.kind == b.kind == "text":
            return Value(F.concat(a.column, b.column), "text", error)
        self._need(a, "number", sign)
        self._need(b, "number", sign)
        x, y = a.column.cast("double"), b.column.cast("double")
        if sign in "/%":
            zero = F.when(y == 0, F.lit("division by zero"))
            return Value(F.try_divide(x, y) if sign == "/" else F.when(y != 0, x % y), "number", _first(error, zero))
        return Value({"+": x + y, "-": x - y, "*": x * y, "**": F.pow(x, y), "^": F.pow(x, y)}[sign], "number", error)

    def _call(self, node: Node) -> Value:
        if node.value in _TESTS and len(node.parts) == 2:
            return self._test(node)
        args = [self.compile(p) for p in node.parts]
        if node.value in self.terms:
            return self.terms[node.value](list(node.parts), args)
        error, cols = _first(*(a.error for a in args)), [a.column for a in args]
        kinds = [a.kind for a in args]
        one = {"lower": ("text", F.lower, "text"), "upper": ("text", F.upper, "text"), "trim": ("text", F.trim, "text"), "len": ("text", F.length, "number"), "abs": ("number", F.abs, "number"), "round": ("number", F.round, "number"), "floor": ("number", F.floor, "number"), "ceil": ("number", F.ceil, "number")}
        if node.value == "len" and kinds == ["list"]:
            return Value(F.size(cols[0]), "number", error)
        if node.value in one and kinds == [one[node.value][0]]:
            return Value(one[node.value][1](cols[0]), one[node.value][2], error)
        if node.value in ("min", "max") and kinds and set(kinds) == {"number"}:
            cols = [c.cast("double") for c in cols]
            return Value((F.least if node.value == "min" else F.greatest)(*cols) if len(cols) > 1 else cols[0], "number", error)
        raise RuleError(f"unknown call {node.value}({', '.join(kinds)})")

    @staticmethod
    def _need(value: Value, kind: str, sign: str) -> None:
        if value.kind != kind:
            raise RuleError(f"{sign} takes a {kind}, not a {value.kind}")
