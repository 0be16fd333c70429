"""Recursive-descent parser of the read-only query language.

There is no grammar for updates, so the parser is the gate against them: what it
does not know is an InvalidQuery.
"""

from __future__ import annotations

import re

from .algebra import AGGREGATES, Bind, Filter, Group, InvalidQuery, Iri, Lit, Minus, NotExists, Optional_, Query, Quoted, Step, Triple, Union_, Values, Var

RDF, RDFS, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2001/XMLSchema#"
TOKEN = re.compile(
    r"(?P<skip>\s+|\#[^\n]*)|(?P<quote><<|>>)|(?P<iri><[^<>\"{}|^`\\\s]*>)|(?P<var>[?$]\w+)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')(?:\^\^(?:<[^>]*>|[\w-]*:[\w-]*)|@[A-Za-z-]+)?"
    r"|(?P<number>[+-]?(?:\d+\.\d+|\d+))|(?P<name>[A-Za-z_][\w-]*)?:(?P<local>[\w](?:[\w.-]*[\w-])?)?|(?P<word>[A-Za-z_]\w*)|(?P<sign>&&|\|\||!=|<=|>=|[{}().;,/^=<>!+*-])"
)
FUNCTIONS = {"STR": 1, "STRSTARTS": 2, "STRENDS": 2, "CONTAINS": 2, "LCASE": 1, "UCASE": 1, "STRLEN": 1, "REGEX": 2, "ISIRI": 1, "ISLITERAL": 1, "BOUND": 1}
ESCAPES = {"t": "\t", "n": "\n", "r": "\r"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        found = TOKEN.match(text, at)
        if not found or found.end() == at:
            raise InvalidQuery(f"unexpected {text[at : at + 20]!r}")
        kind = found.lastgroup
        if found.group("string") is not None:
            out.append(("string", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), found.group("string")[1:-1])))
        elif kind in ("quote", "iri", "var", "number", "word", "sign"):
            out.append((kind, found.group(kind)))
        elif kind != "skip":
            out.append(("curie", f"{found.group('name') or ''}:{found.group('local') or ''}"))
        at = found.end()
    return out


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens, self.at = tokens(text), 0
        self.prefixes = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD} | (prefixes or {})

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def word(self, *words: str) -> bool:
        """Consume the keywords if they come next."""
        if all(self.peek(i)[0] == "word" and self.peek(i)[1].upper() == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def sign(self, value: str) -> bool:
        if self.peek() in (("sign", value), ("quote", value)):
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.sign(value):
            raise InvalidQuery(f"expected {value!r}, found {self.peek()[1]!r}")

    def query(self) -> Query:
        while self.word("PREFIX"):
            name = self.next()[1].rstrip(":")
            kind, iri = self.next()
            if kind != "iri":
                raise InvalidQuery("PREFIX needs an IRI")
            self.prefixes[name] = iri[1:-1]
        if self.word("ASK"):
            self.word("WHERE")
            out = Query(True, [], False, self.group())
        elif self.word("SELECT"):
            distinct = self.word("DISTINCT") or (self.word("REDUCED") and False)
            projection: list[tuple[str, tuple | None]] = []
            star = self.sign("*")
            while not star and (self.peek()[0] == "var" or self.peek() == ("sign", "(")):
                if self.sign("("):
                    expression = self.expression()
                    if not self.word("AS"):
                        raise InvalidQuery("expected AS")
                    projection.append((self.variable(), expression))
                    self.expect(")")
                else:
                    projection.append((self.variable(), None))
            if not projection and not star:
                raise InvalidQuery("nothing is selected")
            self.word("WHERE")
            out = Query(False, projection, distinct, self.group())
        else:
            raise InvalidQuery("only SELECT and ASK queries are accepted")
        while True:
            if self.word("GROUP", "BY"):
                while self.peek()[0] == "var":
                    out.group_by.append(self.variable())
            elif self.word("HAVING"):
                while self.peek() == ("sign", "("):
                    own = self.primary()
                    out.having = ("&&", out.having, own) if out.having else own
            elif self.word("ORDER", "BY"):
                while self.peek()[0] == "var" or self.peek()[1].upper() in ("ASC", "DESC"):
                    down = self.word("DESC")
                    if down or self.word("ASC"):
                        out.order_by.append((self.primary(), down))
                    else:
                        out.order_by.append((Var(self.variable()), False))
            elif self.word("LIMIT"):
                out.limit = self.integer()
            elif self.word("OFFSET"):
                out.offset = self.integer()
            else:
                break
        if self.peek()[0] != "end":
            raise InvalidQuery(f"unexpected {self.peek()[1]!r}")
        return out

    def integer(self) -> int:
        kind, value = self.next()
        if kind != "number" or not value.isdigit():
            raise InvalidQuery("expected a whole number")
        return int(value)

    def variable(self) -> str:
        kind, value = self.next()
        if kind != "var":
            raise InvalidQuery(f"expected a variable, found {value!r}")
        return value[1:]

    def term(self):
        kind, value = self.next()
        if kind == "var":
            return Var(value[1:])
        if kind == "iri":
            return Iri(value[1:-1])
        if kind == "curie":
            name, _, local = value.partition(":")
            if name not in self.prefixes:
                raise InvalidQuery(f"unknown prefix {name!r}")
            return Iri(self.prefixes[name] + local)
        if kind == "string":
            return Lit(value)
        if kind == "number":
            return Lit(value, True)
        if kind == "word" and value.lower() in ("true", "false"):
            return Lit(value.lower())
        raise InvalidQuery(f"expected a term, found {value!r}")

    def path(self) -> tuple[Step, ...]:
        steps = []
        while True:
            inverse = self.sign("^")
            if self.peek() == ("word", "a"):
                self.at += 1
                predicate = Iri(RDF + "type")
            else:
                predicate = self.term()
            if not isinstance(predicate, (Iri, Var)):
                raise InvalidQuery("a predicate must be an IRI or a variable")
            steps.append(Step(predicate, inverse))
            if not self.sign("/"):
                return tuple(steps)

    def group(self) -> Group:
        self.expect("{")
        out = Group()
        while not self.sign("}"):
            if self.word("FILTER", "NOT", "EXISTS"):
                out.items.append(NotExists(self.group()))
            elif self.word("FILTER", "EXISTS"):
                out.items.append(NotExists(self.group(), negated=False))
            elif self.word("FILTER"):
                out.items.append(Filter(self.primary()))
            elif self.word("OPTIONAL"):
                out.items.append(Optional_(self.group()))
            elif self.word("MINUS"):
                out.items.append(Minus(self.group()))
            elif self.word("BIND"):
                self.expect("(")
                expression = self.expression()
                if not self.word("AS"):
                    raise InvalidQuery("expected AS")
                out.items.append(Bind(expression, self.variable()))
                self.expect(")")
            elif self.word("VALUES"):
                out.items.append(self.values())
            elif self.peek() == ("sign", "{"):
                groups = [self.group()]
                while self.word("UNION"):
                    groups.append(self.group())
                out.items.append(Union_(groups))
            elif self.sign("<<"):
                s, p, o = self.term(), self.term(), self.term()
                self.expect(">>")
                while True:
                    out.items.append(Quoted(s, p, o, self.term(), self.term()))
                    if not self.sign(";"):
                        break
            elif self.peek()[0] in ("var", "iri", "curie"):
                self.triples(out)
            else:
                raise InvalidQuery(f"unexpected {self.peek()[1]!r}")
            self.sign(".")
        return out

    def triples(self, out: Group) -> None:
        s = self.term()
        while True:
            path = self.path()
            while True:
                out.items.append(Triple(s, path, self.term()))
                if not self.sign(","):
                    break
            if not self.sign(";") or self.peek() in (("sign", "."), ("sign", "}")):
                return

    def values(self) -> Values:
        names = []
        many = self.sign("(")
        while self.peek()[0] == "var":
            names.append(self.variable())
        if many:
            self.expect(")")
        self.expect("{")
        rows = []
        while not self.sign("}"):
            if many:
                self.expect("(")
                rows.append(tuple(self.term() for _ in names))
                self.expect(")")
            else:
                rows.append((self.term(),))
        return Values(tuple(names), rows)

    def expression(self):
        left = self.conjunction()
        while self.sign("||"):
            left = ("||", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.sign("&&"):
            left = ("&&", left, self.comparison())
        return left

    def comparison(self):
        left = self.sum()
        for sign in ("=", "!=", "<=", ">=", "<", ">"):
            if self.sign(sign):
                return (sign, left, self.sum())
        return left

    def sum(self):
        left = self.product()
        while self.peek() in (("sign", "+"), ("sign", "-")):
            left = (self.next()[1], left, self.product())
        return left

    def product(self):
        left = self.primary()
        while self.peek() in (("sign", "*"), ("sign", "/")):
            left = (self.next()[1], left, self.primary())
        return left

    def primary(self):
        if self.sign("("):
            out = self.expression()
            self.expect(")")
            return out
        if self.sign("!"):
            return ("!", self.primary())
        kind, value = self.peek()
        name = value.upper()
        if kind == "word" and name in AGGREGATES:
            self.at += 1
            self.expect("(")
            distinct = self.word("DISTINCT")
            inner = None if self.sign("*") else self.expression()
            self.expect(")")
            return ("agg", name, distinct, inner)
        if kind == "word" and name in FUNCTIONS:
            self.at += 1
            self.expect("(")
            arguments = [self.expression()]
            while self.sign(","):
                arguments.append(self.expression())
            self.expect(")")
            if len(arguments) != FUNCTIONS[name]:
                raise InvalidQuery(f"{name} takes {FUNCTIONS[name]} arguments")
            return ("call", name, *arguments)
        return self.term()


def parse(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, prefixes).query()


def rewrite_values(text: str, name: str, iri: str) -> str:
    """The text with the only VALUES block of ?name bound to one IRI; comments stay. Not exactly one block is an error."""
    block = re.compile(r"(VALUES\s+\?" + re.escape(name) + r"\s*)\{[^}]*\}", re.IGNORECASE)
    if len(block.findall(text)) != 1:
        raise InvalidQuery(f"expected one VALUES block for ?{name}, found {len(block.findall(text))}")
    return block.sub(lambda m: f"{m[1]}{{ <{iri}> }}", text)


def canonical_text(text: str) -> str:
    """The query without leading comment lines and without comments at ends of lines (two blanks and a #)."""
    lines = text.splitlines()
    while lines and (not lines[0].strip() or lines[0].lstrip().startswith("#")):
        lines.pop(0)
    return "\n".join(re.sub(r"\s{2,}#.*$", "", line).rstrip() for line in lines).strip()
