"""Ordered first-match rules as one column, and the same rules as SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """label where any of `terms` fits: contains, equals, starts (prefix), or pattern (regular expression)."""

    label: str
    mode: str
    terms: tuple[str, ...]

    def column(self, text: Column) -> Column:
        if self.mode == "equals":
            return text.isin(*self.terms)
        if self.mode == "pattern":
            return text.rlike("|".join(f"(?:{t})" for t in self.terms))
        out = F.lit(False)
        for t in self.terms:
            out = out | (text.contains(t) if self.mode == "contains" else text.startswith(t))
        return out

    def sql(self, text: str) -> str:
        quote = lambda t: "'" + t.replace("'", "''") + "'"
        if self.mode == "equals":
            return f"{text} IN ({', '.join(map(quote, self.terms))})"
        if self.mode == "pattern":
            return f"regexp_matches({text}, {quote('|'.join(f'(?:{t})' for t in self.terms))})"
        name = "contains" if self.mode == "contains" else "starts_with"
        return "(" + " OR ".join(f"{name}({text}, {quote(t)})" for t in self.terms) + ")"


def first_match(text: Column, rules: list[Rule], default: str) -> Column:
    out = None
    for r in rules:
        out = F.when(r.column(text), r.label) if out is None else out.when(r.column(text), r.label)
    return F.coalesce(out, F.lit(default)) if out is not None else F.lit(default)


def first_match_sql(text: str, rules: list[Rule], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {r.sql(text)} THEN '{r.label}'" for r in rules) + f" ELSE '{default}' END"
