"""Queries: the boolean and fielded syntax, synonyms, and typed metadata filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """A word of a query: occur is must, must_not or should."""

    text: str
    occur: str = "should"
    field: str | None = None
    boost: float = 1.0


_FIELD = re.compile(r"([A-Za-z0-9_]+):(?!/)(.+)", re.S)
_BOOST = re.compile(r"(.+)\^([-+]?(?:\d+\.?\d*|\.\d+))", re.S)


def parse_query(query: str) -> list[Term]:
    """Words between white space: +must, -must_not, field:word and word^boost; a boost of 0 or less is 1."""
    out = []
    for word in query.split():
        occur = {"+": "must", "-": "must_not"}.get(word[0], "should") if len(word) > 1 else "should"
        text = word[1:] if occur != "should" else word
        name, boost = None, 1.0
        if m := _FIELD.fullmatch(text):
            name, text = m[1], m[2]
        if m := _BOOST.fullmatch(text):
            text, boost = m[1], float(m[2])
        out.append(Term(text, occur, name, boost if boost > 0 else 1.0))
    return out


@dataclass
class SynonymMap:
    """Groups of words that stand for one another."""

    groups: list[list[str]] = field(default_factory=list)
    of: dict[str, int] = field(default_factory=dict)

    def add_group(self, words: list[str]) -> None:
        """A group of two or more words; it joins the first group that one of them is in."""
        words = [w.strip() for w in words if w.strip()]
        if len(words) < 2:
            return
        at = next((self.of[w] for w in words if w in self.of), None)
        if at is None:
            at = len(self.groups)
            self.groups.append([])
        for w in words:
            if w not in self.groups[at]:
                self.groups[at].append(w)
            self.of[w] = at

    def expand(self, word: str) -> list[str]:
        """The word and its synonyms."""
        return list(dict.fromkeys([word, *self.groups[self.of[word]]])) if word in self.of else [word]

    def expand_terms(self, words: list[str]) -> list[str]:
        return list(dict.fromkeys(x for w in words for x in self.expand(w)))

    @classmethod
    def load(cls, path: str) -> SynonymMap:
        """Lines of words between commas; lines that are empty or begin with # are passed over."""
        out = cls()
        with open(path, encoding="utf-8") as f:
            for line in f:
                if line.strip() and not line.startswith("#"):
                    out.add_group(line.split(","))
        return out


# -- metadata ---------------------------------------------------------------------------------------------

#: A metadata value: its type (0 null, 1 boolean, 2 integer, 3 float, 4 string) and one field for each.
VALUE = "struct<t:tinyint,b:boolean,i:bigint,d:double,s:string>"
_TYPE = {bool: (1, "b"), int: (2, "i"), float: (3, "d"), str: (4, "s")}


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def value(col: Column, kind: str) -> Column:
    """A column as a metadata value of kind bool, int, float or str; null stays a stored null."""
    t = {"bool": 1, "int": 2, "float": 3, "str": 4}[kind]
    parts = [("b", "boolean", 1), ("i", "bigint", 2), ("d", "double", 3), ("s", "string", 4)]
    return F.struct(F.when(col.isNull(), 0).otherwise(t).cast("tinyint").alias("t"), *[(col.cast(k) if t == x else _null(k)).alias(n) for n, k, x in parts])


def meta(**values: tuple[Column, str]) -> Column:
    """A metadata map from name=(column, kind)."""
    return F.create_map(*[x for name, (col, kind) in values.items() for x in (F.lit(name), value(col, kind))])


@dataclass(frozen=True)
class Condition:
    """name op value; op is eq, neq, gt, gte, lt, lte, in or exists.

    Types are strict: integers and floats never compare.  A mismatch or a missing name is false, but for
    neq, which is true; a missing name equals a null.
    """

    name: str
    op: str
    value: object = None

    def column(self, metadata: Column) -> Column:
        x = F.element_at(metadata, self.name)
        t = F.coalesce(x.t, F.lit(0).cast("tinyint"))

        def equal(v) -> Column:
            if v is None:
                return t == 0
            kind, part = _TYPE[type(v)]
            return F.coalesce((t == kind) & (x[part] == F.lit(v)), F.lit(False))

        if self.op == "eq":
            return equal(self.value)
        if self.op == "neq":
            return ~equal(self.value)
        if self.op == "exists":
            return t != 0
        if self.op == "in":
            return F.coalesce(x.t.isNotNull() & reduce(lambda a, b: a | b, [equal(v) for v in self.value], F.lit(False)), F.lit(False))
        if self.op not in ("gt", "gte", "lt", "lte"):
            raise ValueError(f"unknown operator {self.op!r}")
        if type(self.value) not in (int, float):
            return F.lit(False)
        kind, part = _TYPE[type(self.value)]
        v = F.lit(self.value)
        hit = {"gt": x[part] > v, "gte": x[part] >= v, "lt": x[part] < v, "lte": x[part] <= v}[self.op]
        return F.coalesce((t == kind) & hit, F.lit(False))


@dataclass(frozen=True)
class Filter:
    """Conditions and filters under 'and' or 'or'; without any it is true."""

    parts: tuple
    how: str = "and"

    def column(self, metadata: Column) -> Column:
        cols = [p.column(metadata) for p in self.parts]
        if not cols:
            return F.lit(True)
        return reduce((lambda a, b: a & b) if self.how == "and" else (lambda a, b: a | b), cols)


def passes(filter_: Condition | Filter, metadata: Column) -> Column:
    """Whether a document passes a filter; one without metadata passes none."""
    return metadata.isNotNull() & (F.size(metadata) > 0) & filter_.column(metadata)
