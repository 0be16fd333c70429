"""Compiles the query algebra to DataFrame plans.

A solution is a DataFrame with a string column for each variable, null where it is
unbound; ``<name>__kind`` ('iri' or 'literal') is there for variables whose kind
the pattern does not fix.  Patterns are joined seeds first, then along shared
variables; under set semantics variables that nothing needs any more are dropped
and duplicates removed after each hop.  Of a predicate that is made of parts only
those are read whose terms the other patterns of the group can meet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .algebra import Bind, Filter, Group, InvalidQuery, Iri, Lit, Minus, NotExists, Optional_, Query, Quoted, Step, Triple, Union_, Values, Var, aggregates, variables
from .sparql import parse

SMALL = 1000  # rows of a VALUES block that is broadcast


@dataclass
class Solution:
    df: DataFrame
    kinds: dict[str, str | None]  # of every variable: 'iri', 'literal', or None if the column has it
    maybe: frozenset[str] = frozenset()  # variables that may be unbound

    @property
    def names(self) -> list[str]:
        return list(self.kinds)

    def columns(self, names) -> list[str]:
        return [c for n in names for c in ([n] if self.kinds[n] else [n, f"{n}__kind"])]

    def keep(self, names) -> Solution:
        names = [n for n in self.names if n in set(names)]
        return Solution(self.df.select(*self.columns(names)), {n: self.kinds[n] for n in names}, self.maybe & set(names))

    def kind(self, name: str) -> Column:
        fixed = self.kinds[name]
        return F.when(F.col(name).isNotNull(), F.lit(fixed)) if fixed else F.col(f"{name}__kind")

    def with_kinds(self, names) -> Solution:
        """The kinds of these variables as columns."""
        new = {f"{n}__kind": self.kind(n) for n in names if self.kinds[n]}
        return Solution(self.df.withColumns(new), self.kinds | {n: None for n in names}, self.maybe) if new else self


class Compiler:
    """graph: ``scan(predicate, parts)`` -> (s, p, o, o_kind), ``spaces(predicate)``, ``object_kind(predicate)``, ``annotations()``."""

    def __init__(self, graph, seeds: DataFrame | None = None, seed_kinds: dict[str, str] | None = None):
        """seeds: values of variables, a column for each (IRIs, unless seed_kinds says otherwise); they take the place of VALUES blocks of these variables."""
        self.graph, self.seeds, self.seed_kinds = graph, seeds, seed_kinds or {}
        self.fresh = 0

    def hidden(self) -> str:
        self.fresh += 1
        return f"_h{self.fresh}"

    # --- queries ---------------------------------------------------------------------------
    def run(self, query: Query) -> DataFrame:
        if query.ask:
            found = self.group(query.where, set(), True).df.limit(1).agg((F.count("*") > 0).alias("found"))
            return found.select(F.col("found").cast("string").alias("boolean"))
        projection = query.projection or [(n, None) for n in sorted(self._visible(query.where))]
        grouped = bool(query.group_by) or any(aggregates(e) for _, e in projection) or aggregates(query.having)
        needed = {n for n, e in projection if e is None} | set().union(*(variables(e) for _, e in projection), variables(query.having), *(variables(e) for e, _ in query.order_by)) | set(query.group_by)
        as_set = query.distinct and not grouped or grouped and all(e is None or self._distinct_only(e) for _, e in projection) and self._distinct_only(query.having)
        found = self.group(query.where, needed, as_set)
        if grouped:
            return self._aggregate(query, projection, found)
        for name, expression in projection:
            if expression is not None:
                found = self.bind(found, expression, name)
            elif name not in found.kinds:
                found = Solution(found.df.withColumn(name, F.lit(None).cast("string")), found.kinds | {name: "literal"}, found.maybe | {name})
        names = [n for n, _ in projection]
        if query.distinct:
            extra = sorted(set().union(*(variables(e) for e, _ in query.order_by)) - set(names)) if query.order_by else []
            found = found.keep(names if not extra else [*names, *extra])
            found = Solution(found.df.distinct(), found.kinds, found.maybe)
        df = self._ordered(query, found)
        return df.select(*names)

    def _visible(self, group: Group) -> set[str]:
        out: set[str] = set()
        for item in group.items:
            if isinstance(item, Triple):
                out |= variables((item.s, item.o, *(s.predicate for s in item.path)))
            elif isinstance(item, Quoted):
                out |= variables((item.s, item.p, item.o, item.key, item.value))
            elif isinstance(item, Values):
                out |= set(item.names)
            elif isinstance(item, Bind):
                out.add(item.name)
            elif isinstance(item, Optional_):
                out |= self._visible(item.group)
            elif isinstance(item, Union_):
                out |= set().union(*(self._visible(g) for g in item.groups))
        return out

    def _distinct_only(self, expression) -> bool:
        """Whether duplicates of solutions can't change the expression."""
        if not isinstance(expression, tuple):
            return True
        if expression[0] == "agg":
            return expression[2] or expression[1] in ("MIN", "MAX")
        return all(self._distinct_only(x) for x in expression[1:])

    def _aggregate(self, query: Query, projection, found: Solution) -> DataFrame:
        own: dict[tuple, str] = {}

        def lift(expression):
            if isinstance(expression, tuple) and expression[0] == "agg":
                return Var(own.setdefault(expression, f"_a{len(own)}"))
            return tuple(lift(x) for x in expression) if isinstance(expression, tuple) else expression

        lifted = [(n, lift(e) if e is not None else None) for n, e in projection]
        having = lift(query.having) if query.having else None
        order = [(lift(e), down) for e, down in query.order_by]
        columns = []
        for (_, kind, distinct, inner), name in own.items():
            value = F.lit(1) if inner is None else self.expression(found, inner)
            if kind == "COUNT":
                if inner is None and distinct:
                    value = F.struct(*found.columns(found.names))
                columns.append((F.count_distinct(value) if distinct else F.count(value)).cast("long").alias(name))
            else:
                number = value.try_cast("double") if kind in ("SUM", "AVG") or distinct else value
                columns.append({"SUM": F.sum_distinct if distinct else F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[kind](number).alias(name))
        keys = found.columns(query.group_by)
        df = found.df.groupBy(*keys).agg(*columns) if columns else found.df.select(*keys).distinct()
        result = Solution(df, {n: found.kinds[n] for n in query.group_by} | {n: "literal" for n in own.values()})
        if having is not None:
            result = Solution(result.df.where(self.expression(result, having)), result.kinds)
        alias = {}
        for name, expression in lifted:
            if expression is not None:
                alias[name] = self.expression(result, expression)
            elif name not in result.kinds:
                raise InvalidQuery(f"?{name} is neither grouped nor aggregated")
        result = Solution(result.df.withColumns(alias), result.kinds | {n: "literal" for n in alias})
        return self._ordered(Query(False, [], False, query.where, order_by=order, limit=query.limit, offset=query.offset), result).select(*[n for n, _ in projection])

    def order_keys(self, found: Solution, expression, down: bool) -> list[Column]:
        """Unbound before IRIs before literals."""
        value = self.expression(found, expression)
        parts = [value.isNotNull()]
        if isinstance(expression, Var):
            if expression.name not in found.kinds:
                return []
            parts.append(found.kind(expression.name) == "literal")
        return [p.desc() if down else p.asc() for p in [*parts, value]]

    def _ordered(self, query: Query, found: Solution) -> DataFrame:
        df = found.df
        if query.order_by:
            df = df.orderBy(*[key for expression, down in query.order_by for key in self.order_keys(found, expression, down)])
        if query.offset:
            df = df.offset(query.offset)
        return df.limit(query.limit) if query.limit is not None else df

    # --- patterns --------------------------------------------------------------------------
    def group(self, group: Group, needed: set[str], as_set: bool) -> Solution:
        """needed: variables used outside; as_set: whether duplicates may go."""
        items = []
        for item in group.items:
            items += self._steps(item) if isinstance(item, Triple) else [item]
        late = [i for i in items if isinstance(i, (Filter, NotExists))]
        uses = {id(i): self._item_variables(i) for i in items}
        patterns = [i for i in items if isinstance(i, (Values, Triple, Quoted))]
        others = [i for i in items if not isinstance(i, (Values, Triple, Quoted, Filter, NotExists))]
        later = set(needed).union(*(uses[id(i)] for i in others + late))
        iris = {t.name for i in patterns if not isinstance(i, Values) for t in ((i.s,) if isinstance(i, Triple) else (i.s, i.p, i.o)) if isinstance(t, Var)}
        parts = self._parts(patterns)
        found: Solution | None = None
        while patterns:
            item = self._pick(patterns, set(found.names) if found else set())
            patterns.remove(item)
            found = self.join(found, self.pattern(item, iris, parts.get(id(item))))
            found = self._filtered(found, late, done=False)
            if as_set and not isinstance(item, Values):
                live = later.union(*(uses[id(i)] for i in patterns))
                if set(found.names) - live:
                    found = found.keep(live)
                    found = Solution(found.df.distinct(), found.kinds, found.maybe) if found.names else Solution(found.df.limit(1), {})
        if found is None and not others:
            raise InvalidQuery("an empty pattern")
        for item in others:
            if isinstance(item, Union_):
                parts = [self.group(g, later | set(found.names if found else []), as_set) for g in item.groups]
                found = self.join(found, reduce(self._united, parts))
            elif found is None:
                raise InvalidQuery("nothing before OPTIONAL, MINUS or BIND")
            elif isinstance(item, Optional_):
                found = self.left_join(found, self.group(item.group, later | set(found.names), as_set))
            elif isinstance(item, Minus):
                found = self.without(found, self.group(item.group, set(found.names), True))
            else:
                found = self.bind(found, item.expression, item.name)
            found = self._filtered(found, late, done=False)
        return self._filtered(found, late, done=True)

    def _filtered(self, found: Solution, late: list, done: bool) -> Solution:
        """Apply and remove the filters whose variables are all there (in the end, all that are left)."""
        for item in list(late):
            own = self._item_variables(item)
            if isinstance(item, Filter) and (done or own <= set(found.names) and not own & found.maybe):
                found = Solution(found.df.where(self.expression(found, item.expression)), found.kinds, found.maybe)
            elif isinstance(item, NotExists) and done:
                inner = self.group(item.group, set(found.names), True)
                found = self.without(found, inner, exists=not item.negated, empty_matters=True)
            else:
                continue
            late.remove(item)
        return found

    def _steps(self, item: Triple) -> list[Triple]:
        """A path as one triple for each step, over hidden variables."""
        out, s = [], item.s
        for i, step in enumerate(item.path):
            o = item.o if i == len(item.path) - 1 else Var(self.hidden())
            out.append(Triple(o, (Step(step.predicate),), s) if step.inverse else Triple(s, (step,), o))
            s = o
        return out

    def _item_variables(self, item) -> set[str]:
        if isinstance(item, Filter):
            return variables(item.expression)
        if isinstance(item, Bind):
            return variables(item.expression) | {item.name}
        if isinstance(item, (NotExists, Optional_, Minus)):
            return set().union(*(self._item_variables(i) for i in item.group.items))
        if isinstance(item, Union_):
            return set().union(*(self._item_variables(i) for g in item.groups for i in g.items))
        return self._visible(Group([item]))

    def _pick(self, patterns: list, bound: set[str]):
        """Seeds first, then a connected pattern, of several the one with most constants."""

        def rank(item) -> tuple:
            own = self._item_variables(item)
            if isinstance(item, Values):
                return (0 if not bound or own & bound else 1, 0, 0)
            terms = (item.s, item.o) if isinstance(item, Triple) else (item.s, item.p, item.o, item.value)
            constants = sum(not isinstance(t, Var) for t in terms)
            kind = isinstance(item, Triple) and isinstance(item.o, Iri) and item.path[0].predicate == Iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#type")
            # (a class of what is bound is a filter, which goes first)
            return (2 if own & bound else 3 if not bound else 4, -constants + 2 * (kind and not own <= bound), len(own - bound))

        return min(patterns, key=lambda i: (rank(i), patterns.index(i)))

    def _parts(self, patterns: list) -> dict[int, list[int]]:
        """For each pattern of a constant predicate (by id) the parts of it that can meet parts of all other patterns.

        Terms of which neither beginning goes on with the other are never equal.
        """
        own = {id(i): i for i in patterns if isinstance(i, Triple) and isinstance(i.path[0].predicate, Iri)}
        spaces = {key: self.graph.spaces(i.path[0].predicate.value) for key, i in own.items()}
        meet = lambda a, b: a is None or b is None or a.startswith(b) or b.startswith(a)
        at = lambda term, space: not isinstance(term, Iri) or space is None or term.value.startswith(space)
        left = {key: [n for n, (s, o) in enumerate(spaces[key]) if at(i.s, s) and at(i.o, o)] for key, i in own.items()}
        uses = [(key, place, term.name) for key, i in own.items() for place, term in enumerate((i.s, i.o)) if isinstance(term, Var)]
        while True:
            size = sum(map(len, left.values()))
            for key, place, name in uses:
                for other, there, same in uses:
                    if same == name and (other, there) != (key, place):
                        left[key] = [n for n in left[key] if any(meet(spaces[key][n][place], spaces[other][m][there]) for m in left[other])]
            if sum(map(len, left.values())) == size:
                return left

    def pattern(self, item, iris: set[str] = frozenset(), parts: list[int] | None = None) -> Solution:
        """iris: variables that another pattern of the group binds to IRIs; literals in their place are never joined. parts: those of the predicate that are read."""
        if isinstance(item, Values) and self.seeds is not None and item.names == tuple(self.seeds.columns):
            return Solution(self.seeds, {n: self.seed_kinds.get(n, "iri") for n in item.names})
        if isinstance(item, Values):
            spark = self.graph.spark
            kinds = {n: ("iri" if all(isinstance(r[i], Iri) for r in item.rows) else "literal" if all(isinstance(r[i], Lit) for r in item.rows) else None) for i, n in enumerate(item.names)}
            names = [c for n in item.names for c in ([n] if kinds[n] else [n, f"{n}__kind"])]
            rows = [tuple(v for i, n in enumerate(item.names) for v in ([r[i].value] if kinds[n] else [r[i].value, "iri" if isinstance(r[i], Iri) else "literal"])) for r in item.rows]
            df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names))
            return Solution(F.broadcast(df) if len(rows) <= SMALL else df, kinds)
        if isinstance(item, Quoted):
            df = self.graph.annotations()
            return self._matched(df, {"s": (item.s, "iri"), "p": (item.p, "iri"), "o": (item.o, "iri"), "key": (item.key, "iri"), "value": (item.value, "literal")})
        predicate = item.path[0].predicate
        fixed = predicate.value if isinstance(predicate, Iri) else None
        df = self.graph.scan(fixed, parts)
        kind = self.graph.object_kind(fixed) if fixed else None
        if isinstance(item.o, (Iri, Lit)) and kind is None:
            df = df.where(F.col("o_kind") == ("iri" if isinstance(item.o, Iri) else "literal"))
        elif kind is None and item.o.name in iris:
            df, kind = df.where("o_kind = 'iri'"), "iri"
        return self._matched(df, {"s": (item.s, "iri"), **({} if fixed else {"p": (predicate, "iri")}), "o": (item.o, kind)})

    def _matched(self, df: DataFrame, terms: dict) -> Solution:
        columns, kinds, seen = [], {}, {}
        for place, (term, kind) in terms.items():
            if not isinstance(term, Var):
                df = df.where(F.col(place) == term.value)
            elif term.name in seen:
                df = df.where(F.col(place) == F.col(seen[term.name]))
            else:
                seen[term.name] = place
                kinds[term.name] = kind
                columns.append(F.col(place).alias(term.name))
                if kind is None:
                    columns.append(F.col("o_kind").alias(f"{term.name}__kind"))
        return Solution(df.select(*columns) if columns else df.select(F.lit(1).alias("_one")).limit(1).select(), kinds)

    # --- joins -----------------------------------------------------------------------------
    def _shared(self, a: Solution, b: Solution) -> tuple[Solution, Solution, list[str]]:
        shared = [n for n in a.names if n in b.kinds]
        mixed = [n for n in shared if a.kinds[n] != b.kinds[n] or a.kinds[n] is None]
        return a.with_kinds(mixed), b.with_kinds(mixed), shared

    @staticmethod
    def _by_bound(found: Solution, names: list[str]) -> list[tuple[frozenset[str], DataFrame]]:
        """Solutions split by which of the names are bound: (bound names, rows)."""
        out = [(frozenset(names) - found.maybe, found.df)]
        for n in names:
            if n in found.maybe:
                out = [part for bound, df in out for part in ((bound | {n}, df.where(F.col(n).isNotNull())), (bound, df.where(F.col(n).isNull())))]
        return out

    def _meetings(self, a: Solution, b: Solution, shared: list[str]):
        """For each way in which shared variables are bound: (bound in a, rows of a, [(keys bound in both, bound in b, rows of b)])."""
        theirs = self._by_bound(b, shared)
        for bound, df in self._by_bound(a, shared):
            yield bound, df, [([n for n in shared if n in bound and n in other], other, rows) for other, rows in theirs]

    def join(self, a: Solution | None, b: Solution) -> Solution:
        """Compatible solutions: those that agree in every variable that both bind."""
        if a is None:
            return b
        a, b, shared = self._shared(a, b)
        kinds = a.kinds | {n: k for n, k in b.kinds.items() if n not in a.kinds}
        both = frozenset(n for n in shared if n in a.maybe and n in b.maybe)
        out = Solution(a.df, kinds, frozenset(n for n in a.maybe | b.maybe if n not in shared) | both)
        parts = []
        for bound, df, others in self._meetings(a, b, shared):
            for keys, _, rows in others:
                # a shared variable that is no key is unbound on one side at least
                left = df.drop(*a.columns([n for n in shared if n not in bound]))
                right = rows.drop(*b.columns([n for n in shared if n in bound and n not in keys]))
                # (without keys: two seeds, or patterns that nothing connects)
                met = left.join(right, a.columns(keys)) if keys else left.crossJoin(right)
                parts.append(met.select(*out.columns(out.names)))
        return Solution(reduce(DataFrame.unionByName, parts), out.kinds, out.maybe)

    def left_join(self, a: Solution, b: Solution) -> Solution:
        """Compatible solutions, and those of a that have none."""
        a, b, shared = self._shared(a, b)
        new = [n for n in b.names if n not in a.kinds]
        maybe = a.maybe | (b.maybe & set(new)) | frozenset(new)
        if shared and not set(shared) & (a.maybe | b.maybe):
            return Solution(a.df.join(b.df, a.columns(shared), "left"), a.kinds | {n: b.kinds[n] for n in new}, maybe)
        met, alone = self.join(a, b), self.without(a, b, empty_matters=True)
        alone = alone.with_kinds([n for n in a.names if met.kinds[n] is None])
        empty = {c: F.lit(None).cast("string") for c in met.columns(new)}
        return Solution(met.df.unionByName(alone.df.withColumns(empty) if empty else alone.df), met.kinds, maybe)

    def without(self, a: Solution, b: Solution, exists: bool = False, empty_matters: bool = False) -> Solution:
        """Solutions of a with no (or, exists, with a) compatible one in b; empty_matters: even if they have no bound variable in common."""
        a, b, shared = self._shared(a, b)
        if not shared and not empty_matters:
            return a  # MINUS with no variable in common removes nothing
        parts = []
        for _, df, others in self._meetings(a, b, shared):
            flags = []
            for keys, _, rows in others:
                flag = self.hidden()
                if keys:
                    some = rows.select(*b.columns(keys)).distinct()
                    if len(others) == 1:
                        df = df.join(some, a.columns(keys), "left_semi" if exists else "left_anti")
                        continue
                    df = df.join(some.withColumn(flag, F.lit(True)), a.columns(keys), "left")
                elif empty_matters:
                    df = df.crossJoin(F.broadcast(rows.limit(1).agg((F.count("*") > 0).alias(flag))))
                else:
                    continue
                flags.append(flag)
            if flags:
                met = reduce(Column.__or__, [F.coalesce(F.col(f), F.lit(False)) for f in flags])
                df = df.where(met if exists else ~met).drop(*flags)
            elif exists and not any(keys for keys, _, _ in others):
                df = df.where(F.lit(False))
            parts.append(df.select(*a.columns(a.names)))
        return Solution(reduce(DataFrame.unionByName, parts), a.kinds, a.maybe)

    def _united(self, a: Solution, b: Solution) -> Solution:
        names = list(dict.fromkeys([*a.names, *b.names]))
        mixed = [n for n in names if a.kinds.get(n, b.kinds.get(n)) != b.kinds.get(n, a.kinds.get(n))]
        a, b = a.with_kinds([n for n in mixed if n in a.kinds]), b.with_kinds([n for n in mixed if n in b.kinds])
        kinds = {n: a.kinds.get(n, b.kinds.get(n)) for n in names}
        maybe = a.maybe | b.maybe | frozenset(n for n in names if n not in a.kinds or n not in b.kinds)
        return Solution(a.df.unionByName(b.df, allowMissingColumns=True), kinds, maybe)

    def bind(self, found: Solution, expression, name: str) -> Solution:
        if name in found.kinds:
            raise InvalidQuery(f"?{name} is bound twice")
        if isinstance(expression, Var) and expression.name in found.kinds:
            new = {name: F.col(expression.name)} | ({} if found.kinds[expression.name] else {f"{name}__kind": F.col(f"{expression.name}__kind")})
            return Solution(found.df.withColumns(new), found.kinds | {name: found.kinds[expression.name]}, found.maybe)
        return Solution(found.df.withColumn(name, self.expression(found, expression).cast("string")), found.kinds | {name: "iri" if isinstance(expression, Iri) else "literal"}, found.maybe)

    # --- expressions -----------------------------------------------------------------------
    def expression(self, found: Solution, e) -> Column:
        if isinstance(e, Var):
            return F.col(e.name) if e.name in found.kinds else F.lit(None).cast("string")
        if isinstance(e, Iri):
            return F.lit(e.value)
        if isinstance(e, Lit):
            return F.lit(float(e.value)) if e.numeric else F.lit(e.value)
        of = lambda x: self.expression(found, x)
        number = lambda x: of(x).try_cast("double")
        head = e[0]
        if head in ("&&", "||"):
            return of(e[1]) & of(e[2]) if head == "&&" else of(e[1]) | of(e[2])
        if head == "!":
            return ~of(e[1])
        if head in ("+", "-", "*", "/"):
            a, b = number(e[1]), number(e[2])
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[head]
        if head in ("=", "!=", "<", "<=", ">", ">="):
            numeric = any(isinstance(x, Lit) and x.numeric or isinstance(x, tuple) and (x[0] in ("+", "-", "*", "/", "agg") or x[:2] == ("call", "STRLEN")) for x in e[1:])
            a, b = (number(x) if numeric else of(x) for x in e[1:])
            return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[head]
        if head == "call":
            name, args = e[1], e[2:]
            if name in ("ISIRI", "ISLITERAL"):
                kind = "iri" if name == "ISIRI" else "literal"
                return (found.kind(args[0].name) == kind) if isinstance(args[0], Var) else F.lit(isinstance(args[0], Iri if kind == "iri" else Lit))
            if name == "BOUND":
                return of(args[0]).isNotNull()
            a = [of(x) for x in args]
            return {"STR": lambda: a[0], "LCASE": lambda: F.lower(a[0]), "UCASE": lambda: F.upper(a[0]), "STRLEN": lambda: F.length(a[0]), "STRSTARTS": lambda: F.startswith(a[0], a[1]), "STRENDS": lambda: F.endswith(a[0], a[1]), "CONTAINS": lambda: F.contains(a[0], a[1]), "REGEX": lambda: F.regexp_like(a[0], a[1])}[name]()
        raise InvalidQuery(f"unknown expression {head!r}")


def execute(graph, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The result of a query text over a graph."""
    return Compiler(graph).run(parse(text, {**graph.prefixes, **(prefixes or {})}))


def execute_for(graph, text: str, seeds: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The result for every row of seeds at once: its columns, then those of the query.

    The query has a VALUES block for each seed variable; one plan answers all seeds.
    """
    query = parse(text, {**graph.prefixes, **(prefixes or {})})
    names = list(seeds.columns)
    if query.ask or query.limit is not None:
        raise InvalidQuery("ASK and LIMIT are of one seed; write the query without them")
    found = [i for i in query.where.items if isinstance(i, Values) and set(i.names) <= set(names)]
    if {n for v in found for n in v.names} != set(names):
        raise InvalidQuery(f"there must be a VALUES block for each of {names}")
    query.where.items = [Values(tuple(names), []), *(i for i in query.where.items if i not in found)]
    query.projection = [(n, None) for n in names] + [p for p in query.projection if p[0] not in names]
    if query.group_by or any(aggregates(e) for _, e in query.projection):
        query.group_by = names + [n for n in query.group_by if n not in names]
    query.order_by = []
    return Compiler(graph, seeds.distinct()).run(query)
