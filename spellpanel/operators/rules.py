"""Declarative pathway rules compiled to boolean columns.

A rule is a nested expression of small terms.  Terms on code text and on
membership are two-valued; equality with one primary code or one specialty code
is three-valued, so a missing code gives NULL there and the usual AND / OR rules
take over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellpanel.functions.nulls import any_code, in_set, matches, sql_text
from spellpanel.functions.text import expand_codes
from spellpanel.operators.codes import code_hits

PRIMARY_PROC = "OPERTN_01"
PRIMARY_DIAG = "DIAG_01"
PROC_TEXT = "tnrprocall"
DIAG_TEXT = "tnrdiagall"
MAIN_SPECIALTY = "MAINSPEF"
TREATMENT_SPECIALTY = "TRETSPEF"


@dataclass(frozen=True)
class Term:
    """Base of rule expressions; ``&``, ``|`` and ``~`` build larger ones."""

    def __and__(self, other: Term) -> Term:
        return Both(self, other)

    def __or__(self, other: Term) -> Term:
        return Either(self, other)

    def __invert__(self) -> Term:
        return Not(self)

    def parts(self) -> Iterable[Term]:
        return ()

    def walk(self) -> Iterable[Term]:
        yield self
        for p in self.parts():
            yield from p.walk()


@dataclass(frozen=True)
class Both(Term):
    a: Term
    b: Term

    def parts(self):
        return (self.a, self.b)


@dataclass(frozen=True)
class Either(Term):
    a: Term
    b: Term

    def parts(self):
        return (self.a, self.b)


@dataclass(frozen=True)
class Not(Term):
    a: Term

    def parts(self):
        return (self.a,)


@dataclass(frozen=True)
class Listed(Term):
    """Column value is one of the codes (FALSE when missing)."""

    column: str
    codes: tuple[str, ...]


@dataclass(frozen=True)
class Equal(Term):
    """Column value is the code (NULL when missing)."""

    column: str
    code: str


@dataclass(frozen=True)
class Pattern(Term):
    """Regular expression on one column (FALSE when missing)."""

    column: str
    pattern: str


@dataclass(frozen=True)
class AnyCode(Term):
    """Some code of the record's list contains one of the codes."""

    column: str
    codes: tuple[str, ...]

    @property
    def pattern(self) -> str:
        return "|".join(self.codes)


def _codes(text: str) -> tuple[str, ...]:
    return tuple(expand_codes(text))


def primary(text: str) -> Term:
    return Listed(PRIMARY_PROC, _codes(text))


def primary_is(code: str) -> Term:
    return Equal(PRIMARY_PROC, code)


def primary_like(pattern: str) -> Term:
    return Pattern(PRIMARY_PROC, pattern)


def primary_diag(text: str) -> Term:
    return Listed(PRIMARY_DIAG, _codes(text))


def proc(text: str) -> Term:
    return AnyCode(PROC_TEXT, _codes(text))


def diag(text: str) -> Term:
    return AnyCode(DIAG_TEXT, _codes(text))


def main_is(code: str) -> Term:
    return Equal(MAIN_SPECIALTY, code)


def main_in(text: str) -> Term:
    return Listed(MAIN_SPECIALTY, tuple(text.split()))


def treated_in(text: str) -> Term:
    return Listed(TREATMENT_SPECIALTY, tuple(text.split()))


@dataclass(frozen=True)
class Recipe:
    specialty: str
    pathway: str
    rule: Term

    @property
    def name(self) -> str:
        return f"{self.specialty}_{self.pathway}"


def on_text(term: AnyCode) -> Column:
    return any_code(term.column, term.codes)


def compile_rule(term: Term, code_evidence: Callable[[AnyCode], Column] = on_text) -> Column:
    """The rule as one boolean column."""
    if isinstance(term, Both):
        return compile_rule(term.a, code_evidence) & compile_rule(term.b, code_evidence)
    if isinstance(term, Either):
        return compile_rule(term.a, code_evidence) | compile_rule(term.b, code_evidence)
    if isinstance(term, Not):
        return ~compile_rule(term.a, code_evidence)
    if isinstance(term, Listed):
        return in_set(term.column, term.codes)
    if isinstance(term, Equal):
        return F.col(term.column).cast("string") == F.lit(term.code)
    if isinstance(term, Pattern):
        return matches(term.column, term.pattern)
    if isinstance(term, AnyCode):
        return code_evidence(term)
    raise TypeError(f"unknown rule term {term!r}")


def any_of(columns: Iterable[Column]) -> Column:
    """Three-valued OR."""
    return reduce(lambda a, b: a | b, columns)


def add_flags(
    df: DataFrame,
    recipes: Iterable[Recipe],
    code_evidence: Callable[[AnyCode], Column],
    keep_pathways: bool,
) -> DataFrame:
    """Pathway columns, then specialties from them, then ``hvlc`` from those.

    Each step refers to the columns of the one before, so no rule is evaluated
    twice.
    """
    recipes = list(recipes)
    names: dict[str, list[str]] = {}
    for r in recipes:
        names.setdefault(r.specialty, []).append(r.name)
    df = df.withColumns({r.name: compile_rule(r.rule, code_evidence) for r in recipes})
    df = df.withColumns({s: any_of(map(F.col, pathways)) for s, pathways in names.items()})
    df = df.withColumn("hvlc", any_of(map(F.col, names)))
    return df if keep_pathways else df.drop(*[r.name for r in recipes])


def flag_recipes(df: DataFrame, recipes: Iterable[Recipe], keep_pathways: bool = False) -> DataFrame:
    """Add specialty flags, ``hvlc`` for any of them, and on request the pathways.

    All flags come from one projection over the record's code text.
    """
    return add_flags(df, recipes, on_text, keep_pathways)


def flag_recipes_long(
    records: DataFrame,
    dx: DataFrame,
    px: DataFrame,
    recipes: Iterable[Recipe],
    keep_pathways: bool = False,
) -> DataFrame:
    """The same flags straight from the long code tables.

    Each distinct code pattern becomes one boolean aggregated per record, so
    neither arrays nor long strings are built and no record can outgrow a task.
    """
    recipes = list(recipes)
    terms: dict[AnyCode, str] = {}
    for r in recipes:
        for t in r.rule.walk():
            if isinstance(t, AnyCode) and t not in terms:
                terms[t] = f"_hit{len(terms)}"
    out = records
    for text, long in ((DIAG_TEXT, dx), (PROC_TEXT, px)):
        wanted = {name: t.pattern for t, name in terms.items() if t.column == text}
        if wanted:
            out = out.join(code_hits(long, wanted), "id", "left")
    first_code = {DIAG_TEXT: PRIMARY_DIAG, PROC_TEXT: PRIMARY_PROC}

    def evidence(t: AnyCode) -> Column:
        return F.expr(
            f"coalesce(`{terms[t]}`, false) or coalesce(`{first_code[t.column]}` rlike {sql_text(t.pattern)}, false)"
        )

    return add_flags(out, recipes, evidence, keep_pathways).drop(*terms.values())


def flag_one(records: DataFrame, dx: DataFrame, px: DataFrame, recipe: Recipe) -> DataFrame:
    """One pathway flag from the long code tables; unused tables are not read."""
    return flag_recipes_long(records, dx, px, [recipe], keep_pathways=True).drop(recipe.specialty, "hvlc")
