"""What a model's SQL refers to, and a hash that cosmetic edits do not change, by Spark's own parser."""

from __future__ import annotations

import hashlib
import re
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from ..errors import LineageError

#: Quoted text, comments, and the rest of the characters of a statement.
_PIECE = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`)|(--[^\n]*|/\*.*?(?:\*/|\Z))|(\s+)""", re.S)


#: Catalyst expressions that hold the plan of a subquery.
SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")


@dataclass(frozen=True)
class TableRef:
    """A table named in a statement: its parts, and where it stands (end exclusive)."""

    parts: tuple[str, ...]
    start: int
    end: int

    @property
    def name(self) -> str:
        return ".".join(self.parts)


def canonical_text(sql: str) -> str:
    """The statement without comments, with single spaces, and in lower case outside quotes."""
    out, at = [], 0
    for m in _PIECE.finditer(sql):
        out.append(sql[at : m.start()].lower())
        out.append(m[1] if m[1] is not None else " ")
        at = m.end()
    out.append(sql[at:].lower())
    return re.sub(" {2,}", " ", "".join(out)).strip().rstrip(";").strip()


def spark_dialect(sql: str) -> str:
    """``* EXCLUDE (...)`` as Spark spells it; text in quotes and comments is left alone."""
    out, at = [], 0
    swap = re.compile(r"(\*\s*)EXCLUDE(\s*\()", re.I)
    for m in _PIECE.finditer(sql):
        if m[3] is not None:
            continue
        out += [swap.sub(r"\1EXCEPT\2", sql[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, swap.sub(r"\1EXCEPT\2", sql[at:])])


class SqlMeta:
    """Parses in a session of its own, so that the caller's settings neither matter nor change."""

    def __init__(self, spark: SparkSession):
        if not hasattr(spark, "_jsparkSession"):
            raise LineageError("reading lineage needs a classic Spark session")
        self.session = spark.newSession()
        for key, value in model_settings().items():
            self.session.conf.set(key, value)
        self.jvm = spark._jvm
        self.parser = self.session._jsparkSession.sessionState().sqlParser()

    @contextmanager
    def _active(self):
        """The parser and plan texts read the settings of the active session."""
        kind = self.jvm.org.apache.spark.sql.classic.SparkSession
        before = kind.getActiveSession()
        kind.setActiveSession(self.session._jsparkSession)
        try:
            yield
        finally:
            if before.isDefined():
                kind.setActiveSession(before.get())
            else:
                kind.clearActiveSession()

    def _parse(self, sql: str):
        if not canonical_text(sql):
            raise LineageError("the statement is empty")
        try:
            return self.parser.parsePlan(sql)
        except (ParseException, Py4JJavaError) as e:
            raise LineageError("cannot parse: " + next((x.strip() for x in str(e).splitlines() if x.strip()), type(e).__name__)) from e

    def hash(self, sql: str) -> str:
        """SHA-256 of the parsed plan of the canonical text; quoted identifiers and literals keep their case."""
        with self._active():
            plan = self._parse(canonical_text(spark_dialect(sql))).toString()
        return hashlib.sha256(re.sub(r"#\d+L?", "", plan).encode()).hexdigest()

    def refs(self, sql: str) -> list[TableRef]:
        """Tables the statement reads, in order of their place; names of common table expressions are not tables."""
        sql = spark_dialect(sql)
        found: list[TableRef] = []
        with self._active():
            self._walk(self._parse(sql), frozenset(), found)
        return sorted(set(found), key=lambda r: (r.start, r.name))

    def _each(self, seq):
        return [seq.apply(i) for i in range(seq.size())]

    def _walk(self, plan, hidden: frozenset[str], out: list[TableRef]) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = tuple(self._each(plan.multipartIdentifier()))
            if not (len(parts) == 1 and parts[0].lower() in hidden):
                start, stop = plan.origin().startIndex(), plan.origin().stopIndex()
                out.append(TableRef(parts, start.get() if start.isDefined() else -1, stop.get() + 1 if stop.isDefined() else -1))
        elif kind == "UnresolvedWith":
            recursive = plan.allowRecursion()
            for cte in self._each(plan.cteRelations()):
                name = cte._1().lower()
                self._walk(cte._2(), hidden | {name} if recursive else hidden, out)
                hidden = hidden | {name}
        for child in self._each(plan.children()):
            self._walk(child, hidden, out)
        for e in self._each(plan.expressions()):
            self._expression(e, hidden, out)

    def _expression(self, e, hidden: frozenset[str], out: list[TableRef]) -> None:
        if e.getClass().getSimpleName() in SUBQUERIES:
            self._walk(e.plan(), hidden, out)
        for child in self._each(e.children()):
            self._expression(child, hidden, out)


def model_settings() -> dict[str, str]:
    """Settings of the sessions in which models are parsed and run."""
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.doubleQuotedIdentifiers": "true",
        # plan texts are hashed: they must not be cut
        "spark.sql.debug.maxToStringFields": "1000000",
        "spark.sql.maxPlanStringLength": "2147483632",
    }
