"""The structured query language, compiled to Catalyst expressions.

    query  := or [ORDER BY field [ASC|DESC] {, ...}] [LIMIT n]
    or     := and {OR and}     and := not {AND not}     not := NOT not | prim
    prim   := '(' or ')' | field op value | field [NOT] IN '(' v {, v} [,] ')'
            | field IS [NOT] EMPTY
    op     := = != ~ !~ > >= < <=      value := 'str' | "str" | word | fn()

Text is parsed once on the driver; the outcome is a Column, so the optimiser
sees plain predicates. Anything unknown or illegal raises FilterError at
compile time: a bad filter never runs as an empty one. Functions are accepted
wherever a value is, dates included. An unset clock is the Unix epoch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FilterError(ValueError):
    """The text is not a query of this language, or not one for these fields."""


_TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<op>!=|!~|>=|<=|[=~<>!])|(?P<mark>[(),])|(?P<word>[A-Za-z0-9_.:@%/+*\-]+))""",
    re.X,
)
#: name -> (column, kind, tag prefix)
FIELDS = {n: (c, "text", "") for n, c in (("text", "body"), ("body", "body"), ("title", "title"), ("description", "description"), ("intent_terms", "intent_terms"), ("source_uri", "source_uri"))}
FIELDS |= {n: (n, "name", "") for n in ("type", "id", "language")}
FIELDS |= {"tag": ("tags", "tag", "")} | {n: ("tags", "tag", f"{n}:") for n in ("domain", "lei", "livro", "titulo", "capitulo", "secao")}
FIELDS |= {"epoch": ("last_epoch", "int", ""), "updated": ("updated_at", "date", "")}
_SETS = {"in", "not in"}
_EMPTY = {"empty", "not empty"}
LEGAL = {"text": {"~", "!~", "=", "!="} | _SETS | _EMPTY, "name": {"=", "!="} | _SETS, "int": {"=", "!=", ">", ">=", "<", "<="}, "date": {"=", "!=", ">", ">=", "<", "<="}, "tag": {"=", "!="} | _SETS | _EMPTY}
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
_KEYWORDS = {"and", "or", "not", "in", "is", "empty", "order", "by", "limit", "asc", "desc"}


@dataclass(frozen=True)
class Token:
    kind: str  # string, op, mark, word, end
    text: str

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.text.lower() in words


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    values: tuple = ()


@dataclass(frozen=True)
class Not:
    term: object


@dataclass(frozen=True)
class Both:
    word: str  # and, or
    terms: tuple


@dataclass(frozen=True)
class Query:
    where: object = None
    order: tuple = field(default=())  # (field, descending)
    limit: int = 0  # 0: none


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"cannot read {text[at:].strip()[:20]!r}; quote values with other characters")
        kind, value, at = m.lastgroup, m[m.lastgroup], m.end()
        out.append(Token(kind, value[1:-1].replace(value[0] * 2, value[0]) if kind == "string" else value))
    return [*out, Token("end", "")]


class _Reader:
    def __init__(self, text: str):
        self.rest = tokens(text)[::-1]

    @property
    def next(self) -> Token:
        return self.rest[-1]

    def take(self) -> Token:
        return self.rest.pop() if len(self.rest) > 1 else self.rest[-1]

    def word(self, *words: str) -> bool:
        return self.next.is_word(*words) and bool(self.take())

    def need(self, ok: bool, what: str) -> None:
        if not ok:
            raise FilterError(f"expected {what} before {self.next.text or 'the end'!r}")

    def mark(self, text: str) -> bool:
        return self.next == Token("mark", text) and bool(self.take())

    def query(self) -> Query:
        where = None if self.next.kind == "end" or self.next.is_word("order", "limit") else self.chain("or")
        order, limit = [], 0
        if self.word("order"):
            self.need(self.word("by"), "BY")
            while True:
                self.need(self.next.kind == "word" and self.next.text.lower() not in _KEYWORDS, "a field")
                name = self.take().text
                down = self.next.is_word("desc")
                self.word("asc", "desc")
                order.append((name, down))
                if not self.mark(","):
                    break
        if self.word("limit"):
            self.need(self.next.text.isdecimal() and self.next.kind == "word", "a number")
            limit = int(self.take().text)
        self.need(self.next.kind == "end", "the end")
        return Query(where, tuple(order), limit)

    def chain(self, word: str):
        part = (lambda: self.chain("and")) if word == "or" else self.negated
        terms = [part()]
        while self.word(word):
            terms.append(part())
        return terms[0] if len(terms) == 1 else Both(word, tuple(terms))

    def negated(self):
        depth = 0
        while self.word("not"):
            depth += 1
        term = self.primary()
        for _ in range(depth):
            term = Not(term)
        return term

    def primary(self):
        if self.mark("("):
            inner = self.chain("or")
            self.need(self.mark(")"), "')'")
            return inner
        self.need(self.next.kind == "word" and self.next.text.lower() not in _KEYWORDS, "a field")
        name = self.take().text
        if self.word("is"):
            no = self.word("not")
            self.need(self.word("empty"), "EMPTY")
            return Compare(name, "not empty" if no else "empty")
        no = self.word("not")
        if self.word("in"):
            self.need(self.mark("("), "'('")
            values = []
            while not self.mark(")"):
                values.append(self.value())
                if not self.mark(","):
                    self.need(self.mark(")"), "')'")
                    break
            self.need(bool(values), "a value")
            return Compare(name, "not in" if no else "in", tuple(values))
        self.need(not no and self.next.kind == "op", "an operator")
        return Compare(name, self.take().text, (self.value(),))

    def value(self):
        self.need(self.next.kind in ("string", "word"), "a value")
        token = self.take()
        if token.kind == "word" and self.mark("("):
            args = []
            while not self.mark(")"):
                args.append(self.value())
                if not self.mark(","):
                    self.need(self.mark(")"), "')'")
                    break
            return Call(token.text, tuple(args))
        return token.text


def parse(text: str) -> Query:
    return _Reader(text).query()


def _call(call: Call, now: datetime) -> datetime:
    name = call.name.lower()
    if name not in ("now", "today", "startofday", "endofday"):
        raise FilterError(f"no function {call.name}()")
    if call.args:
        raise FilterError(f"{call.name}() takes no arguments")
    return now if name == "now" else now.replace(hour=23, minute=59, second=59, microsecond=0) if name == "endofday" else now.replace(hour=0, minute=0, second=0, microsecond=0)


def date_value(value, now: datetime) -> datetime:
    """A point of time: a function, an offset such as -7d, YYYY-MM-DD, or RFC 3339."""
    if isinstance(value, Call):
        return _call(value, now)
    if m := re.fullmatch(r"([+-]?\d+)([smhdw])", value):
        return now + timedelta(**{_UNITS[m[2]]: int(m[1])})
    if re.fullmatch(r"\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d))?", value):
        try:
            at = datetime.fromisoformat(value)
            return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        except ValueError:
            pass
    raise FilterError(f"{value!r} is not a date")


def _resolve(name: str):
    found = FIELDS.get(name.lower())
    if not found:
        raise FilterError(f"no field {name!r}")
    return found


def _compare(c: Compare, now: datetime) -> Column:
    column, kind, prefix = _resolve(c.field)
    legal = LEGAL[kind] | ({"~", "!~"} if c.field.lower() == "id" else set())
    if c.op not in legal:
        raise FilterError(f"{c.op!r} does not go with {c.field}")
    col = F.col(column)
    if kind == "date":
        return _ordered(col, c.op, F.lit(date_value(c.values[0], now)))
    plain = [str(_call(v, now)) if isinstance(v, Call) else v for v in c.values]
    if kind == "int":
        if not re.fullmatch(r"[+-]?\d+", plain[0]):
            raise FilterError(f"{c.field} is compared with a whole number, not {plain[0]!r}")
        return _ordered(col, c.op, F.lit(int(plain[0])))
    if kind == "tag":
        some = [F.lit(prefix + v) for v in plain]
        if c.op in _EMPTY:
            none = F.coalesce(F.size(col) <= 0, F.lit(True)) if not prefix else ~F.coalesce(F.exists(col, lambda t: t.startswith(prefix)), F.lit(False))
            return none if c.op == "empty" else ~none
        hit = F.array_contains(col, some[0]) if c.op in ("=", "!=") else F.arrays_overlap(col, F.array(*some))
        return ~hit if c.op in ("!=", "not in") else hit
    if c.op in _EMPTY:
        none = col.isNull() | (col == "")
        return none if c.op == "empty" else ~none
    if c.op in ("~", "!~"):
        hit = F.contains(F.lower(col), F.lower(F.lit(plain[0])))
        return ~hit if c.op == "!~" else hit
    hit = col.isin(*plain) if c.op in _SETS else col == plain[0]
    return ~hit if c.op in ("!=", "not in") else hit


def _ordered(col: Column, op: str, value: Column) -> Column:
    return {"=": col == value, "!=": col != value, ">": col > value, ">=": col >= value, "<": col < value, "<=": col <= value}[op]


def predicate(where, now: datetime = datetime(1970, 1, 1, tzinfo=timezone.utc)) -> Column:
    """A where-tree as a Column; nulls follow three-valued logic."""
    if where is None:
        return F.lit(True)
    if isinstance(where, Not):
        return ~predicate(where.term, now)
    if isinstance(where, Both):
        out = predicate(where.terms[0], now)
        for t in where.terms[1:]:
            out = out & predicate(t, now) if where.word == "and" else out | predicate(t, now)
        return out
    return _compare(where, now)


def ordering(order) -> list[Column]:
    """Sort keys: nulls last going up, first going down."""
    out = []
    for name, down in order:
        column, kind, _ = _resolve(name)
        if kind == "tag":
            raise FilterError(f"cannot order by {name}")
        out.append(F.col(column).desc_nulls_first() if down else F.col(column).asc_nulls_last())
    return out


def query(df: DataFrame, text: str, limit: int = 0, now: datetime = datetime(1970, 1, 1, tzinfo=timezone.utc)) -> DataFrame:
    """Rows of ``df`` that the query text selects, ordered and cut as it says; ``limit`` outweighs its own."""
    q = parse(text)
    out = df.where(predicate(q.where, now))
    if keys := ordering(q.order):
        out = out.orderBy(*keys)
    most = limit or q.limit
    return out.limit(most) if most else out
