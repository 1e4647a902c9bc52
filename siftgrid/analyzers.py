"""Which tokens a column is indexed by."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

Analyzer = Callable[[Column], Column]


def identity(value: Column) -> Column:
    """The whole value as one token."""
    return F.array(value)


def java_split(value: Column) -> Column:
    """Split at single spaces; trailing empty tokens are dropped, others kept: '' -> [''], ' ' -> [], ' a ' -> ['', 'a']."""
    cut = F.rtrim(value)
    return F.when((value != "") & (cut == ""), F.array().cast("array<string>")).otherwise(F.split(cut, " "))


@dataclass(frozen=True)
class IndexConf:
    """An analyzer for each column, the identity where none is named. ``skipped`` columns are not indexed, nor is ``this``.

    An analyzer maps a column to an array column of its own type, so it stays inside generated code; a pandas UDF
    may stand in where built-in functions cannot express it.
    """

    analyzers: Mapping[str, Analyzer] = field(default_factory=dict)
    skipped: frozenset[str] = frozenset(("this", "row_id", "segment"))

    def with_analyzer(self, column: str, analyzer: Analyzer) -> IndexConf:
        return replace(self, analyzers={**self.analyzers, column: analyzer}, skipped=self.skipped - {column})

    def without_field(self, *columns: str) -> IndexConf:
        return replace(self, skipped=self.skipped | set(columns))

    def is_analyzed(self, column: str) -> bool:
        return column not in self.skipped

    def analyzer(self, column: str) -> Analyzer:
        return self.analyzers.get(column, identity)

    def analyze(self, column: str) -> Column:
        """The distinct tokens of a column's value; a null value has none."""
        tokens = F.array_distinct(self.analyzer(column)(F.col(column)))
        return F.when(F.col(column).isNull(), F.lit(None)).otherwise(tokens)
