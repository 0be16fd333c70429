"""Algebra of graph-pattern queries: what the parser gives and the compiler takes."""

from __future__ import annotations

from dataclasses import dataclass, field


class InvalidQuery(ValueError):
    """The text is not a query that the engine accepts."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    value: str
    numeric: bool = False


@dataclass(frozen=True)
class Step:
    """A predicate of a path, forwards or inverse."""

    predicate: Iri | Var
    inverse: bool = False


@dataclass(frozen=True)
class Triple:
    s: object
    path: tuple[Step, ...]
    o: object


@dataclass(frozen=True)
class Quoted:
    """<< s p o >> key value: an annotation of an edge."""

    s: object
    p: object
    o: object
    key: object
    value: object


@dataclass
class Values:
    names: tuple[str, ...]
    rows: list[tuple]


@dataclass
class Filter:
    expression: tuple


@dataclass
class NotExists:
    group: Group
    negated: bool = True


@dataclass
class Optional_:
    group: Group


@dataclass
class Union_:
    groups: list[Group]


@dataclass
class Minus:
    group: Group


@dataclass
class Bind:
    expression: tuple
    name: str


@dataclass
class Group:
    items: list = field(default_factory=list)


@dataclass
class Query:
    """projection: (name, expression or None); expressions are nested tuples (operator, arguments...)."""

    ask: bool
    projection: list[tuple[str, tuple | None]]
    distinct: bool
    where: Group
    group_by: list[str] = field(default_factory=list)
    having: tuple | None = None
    order_by: list[tuple[tuple, bool]] = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0


AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def aggregates(expression) -> bool:
    return isinstance(expression, tuple) and (expression[0] == "agg" or any(aggregates(x) for x in expression[1:]))


def variables(expression) -> set[str]:
    if isinstance(expression, Var):
        return {expression.name}
    if isinstance(expression, tuple):
        return set().union(*(variables(x) for x in expression)) if expression else set()
    return set()
