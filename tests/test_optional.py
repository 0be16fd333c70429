"""OPTIONAL, MINUS and NOT EXISTS over variables that may be unbound, against an evaluator of solution sets."""

import random
from collections import Counter

import pytest

from kgspark.plans.compiler import execute
from kgspark.sources.graph import PREDICATE, Graph


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(2)
    return {p: sorted({(f"n:{rng.randrange(6)}", f"n:{rng.randrange(6)}") for _ in range(7)}) for p in "pqrs"}


@pytest.fixture(scope="module")
def graph(spark, edges):
    return Graph(spark, {PREDICATE + p: (spark.createDataFrame(rows, "s string, o string"), "iri") for p, rows in edges.items()})


def scan(edges, s, p, o):
    return [{s: a, o: b} for a, b in edges[p] if s != o or a == b]


def agree(m, n):
    return all(m[v] == n[v] for v in m if v in n)


def join(a, b):
    return [m | n for m in a for n in b if agree(m, n)]


def optional(a, b):
    return join(a, b) + [m for m in a if not any(agree(m, n) for n in b)]


def minus(a, b):
    return [m for m in a if not any(agree(m, n) and set(m) & set(n) for n in b)]


def not_exists(a, b):
    return [m for m in a if not any(agree(m, n) for n in b)]


CASES = {
    "chain": ("?a kg:p ?b . OPTIONAL { ?b kg:q ?c } OPTIONAL { ?c kg:r ?d }", lambda t: optional(optional(t("a", "p", "b"), t("b", "q", "c")), t("c", "r", "d"))),
    "same variable twice": ("?a kg:p ?b . OPTIONAL { ?a kg:q ?c } OPTIONAL { ?b kg:r ?c }", lambda t: optional(optional(t("a", "p", "b"), t("a", "q", "c")), t("b", "r", "c"))),
    "two at once": ("?a kg:p ?b . OPTIONAL { ?a kg:q ?c } OPTIONAL { ?b kg:r ?d } OPTIONAL { ?c kg:s ?d }", lambda t: optional(optional(optional(t("a", "p", "b"), t("a", "q", "c")), t("b", "r", "d")), t("c", "s", "d"))),
    "nothing shared": ("?a kg:p ?b . OPTIONAL { ?c kg:q ?d }", lambda t: optional(t("a", "p", "b"), t("c", "q", "d"))),
    "nested": ("?a kg:p ?b . OPTIONAL { ?b kg:q ?c . OPTIONAL { ?c kg:r ?d } } OPTIONAL { ?a kg:s ?d }", lambda t: optional(optional(t("a", "p", "b"), optional(t("b", "q", "c"), t("c", "r", "d"))), t("a", "s", "d"))),
    "union": ("?a kg:p ?b . { ?b kg:q ?c } UNION { ?b kg:r ?d } OPTIONAL { ?c kg:s ?d }", lambda t: optional(join(t("a", "p", "b"), t("b", "q", "c") + t("b", "r", "d")), t("c", "s", "d"))),
    "minus": ("?a kg:p ?b . OPTIONAL { ?b kg:q ?c } MINUS { ?c kg:r ?d }", lambda t: minus(optional(t("a", "p", "b"), t("b", "q", "c")), t("c", "r", "d"))),
    "not exists": ("?a kg:p ?b . OPTIONAL { ?b kg:q ?c } FILTER NOT EXISTS { ?c kg:r ?d }", lambda t: not_exists(optional(t("a", "p", "b"), t("b", "q", "c")), t("c", "r", "d"))),
}


@pytest.mark.parametrize("name", CASES)
def test_as_solution_sets(graph, edges, name):
    text, plain = CASES[name]
    want = plain(lambda s, p, o: scan(edges, s, p, o))
    names = sorted({v for m in want for v in m} | set("abcd") & {w[1] for w in text.split() if w.startswith("?")})
    got = execute(graph, f"SELECT {' '.join('?' + n for n in names)} WHERE {{ {text} }}").collect()
    assert Counter(map(tuple, got)) == Counter(tuple(m.get(n) for n in names) for m in want) and want
