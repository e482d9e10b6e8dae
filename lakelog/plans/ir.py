"""The intermediate form of programs and queries."""

from __future__ import annotations

from dataclasses import dataclass, field

INT, BOOL, SYM = "int", "bool", "sym"
Value = int | bool | str


def type_of(value: Value) -> str:
    """The type of a value; bool before int, of which Python makes it a subclass."""
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        return INT
    if isinstance(value, str):
        return SYM
    raise TypeError(f"not an int, bool or symbol: {value!r}")


# expressions
@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Lit:
    value: Value


@dataclass(frozen=True)
class Unary:
    op: str  # - !
    of: Expr


@dataclass(frozen=True)
class Binary:
    op: str  # + - * / % == != < <= > >= && ||
    left: Expr
    right: Expr


Expr = Var | Lit | Unary | Binary


def variables(e: Expr) -> list[str]:
    """The variables of an expression, in order of first use."""
    if isinstance(e, Var):
        return [e.name]
    if isinstance(e, Unary):
        return variables(e.of)
    if isinstance(e, Binary):
        return list(dict.fromkeys(variables(e.left) + variables(e.right)))
    return []


# arguments of atoms
@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class LatticeRead:
    """``?x``: a variable in a positive atom, anything at all in a negated one."""

    name: str


Arg = Var | Lit | Wild | LatticeRead


@dataclass(frozen=True)
class Atom:
    relation: str
    args: tuple[Arg, ...]

    def names(self) -> list[str]:
        return list(dict.fromkeys(a.name for a in self.args if isinstance(a, (Var, LatticeRead))))


# clauses
@dataclass(frozen=True)
class Match:
    atom: Atom


@dataclass(frozen=True)
class Negated:
    atom: Atom


@dataclass(frozen=True)
class If:
    expr: Expr


@dataclass(frozen=True)
class Let:
    name: str
    expr: Expr


@dataclass(frozen=True)
class Agg:
    name: str
    function: str  # count sum min max
    arg: Expr | None
    atom: Atom


Clause = Match | Negated | If | Let | Agg


@dataclass(frozen=True)
class Head:
    relation: str
    exprs: tuple[Expr, ...]


@dataclass(frozen=True)
class Rule:
    heads: tuple[Head, ...]
    body: tuple[Clause, ...]


@dataclass(frozen=True)
class Relation:
    name: str
    types: tuple[str, ...]
    lattice: str | None = None  # None, max, min
    doc: str | None = None

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.types))]


@dataclass(frozen=True)
class Program:
    relations: dict[str, Relation] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class ConjunctiveQuery:
    outputs: tuple[Expr, ...]
    body: tuple[Clause, ...]


def atoms(body: tuple[Clause, ...]) -> list[tuple[Atom, bool]]:
    """The atoms of a body, and whether they must come from a lower stratum."""
    out = []
    for c in body:
        if isinstance(c, Match):
            out.append((c.atom, False))
        elif isinstance(c, (Negated, Agg)):
            out.append((c.atom, True))
    return out
