"""Conditions on contig and position that Spark hands over to a source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from locusflow.sources import bgzf, files

FAR = 1 << 60


def allow_pushdown(spark: SparkSession) -> None:
    """Sources written in Python get conditions only if the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class Places:
    """What conditions on contig and pos leave: contigs (null: any), and the first and last position at which records begin."""

    contigs: frozenset | None = None
    low, high = 0, FAR
    #: Ends of the names of indexes that lie beside a file.
    index_ends: tuple[str, ...] = ()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over comparisons of contig and pos with values; what is left is Spark's."""
        left = [f for f in filters if not self._take(f)]
        # What is on one of some contigs has one, and every record has a position.
        sure = {("pos",), *([("contig",)] if self.contigs is not None else [])}
        yield from (f for f in left if not (isinstance(f, IsNotNull) and f.attribute in sure))

    def _take(self, f: Filter) -> bool:
        name = getattr(f, "attribute", None)
        if name == ("contig",) and isinstance(f, (EqualTo, In)):
            found = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.contigs = found if self.contigs is None else self.contigs & found
            return True
        if name == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            return True
        if name == ("pos",) and isinstance(f, In) and f.value:
            # Narrower, but not all of the condition.
            self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
        return False

    def nothing(self) -> bool:
        return self.low > self.high or self.contigs is not None and not self.contigs

    def index_of(self, path: str, named: str | None) -> str | None:
        """The index that is named, or lies beside the file."""
        return named or index_beside(path, self.index_ends)

    def chunks(self, index: str, names: list[str], regions: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
        """Places of the file that can hold what is asked for: in all regions, and where the pushed conditions lead."""
        found = bgzf.Index(index)
        names = found.names or names
        of = lambda some: bgzf.merged([c for name, b, e in some if name in names for c in found.chunks(names.index(name), b, e)])
        pushed = [(c, max(self.low - 1, 0), self.high) for c in sorted(self.contigs or ())]
        if not regions or self.contigs is None:
            return of(regions or pushed)
        both = of(pushed)
        return bgzf.merged([(max(a, c), min(b, d)) for a, b in of(regions) for c, d in both if max(a, c) < min(b, d)])

    def wanted(self, regions: list[tuple[str, int, int]]):
        """A test for records (contig, position, bases they span) that begin where the conditions say and overlap a region."""
        contigs, low, high = self.contigs, self.low, self.high

        def test(contig: str | None, pos: int, size: int) -> bool:
            if not low <= pos <= high or contigs is not None and contig not in contigs:
                return False
            return not regions or any(contig == c and pos - 1 < e and pos - 1 + size > b for c, b, e in regions)

        return test


def index_beside(path: str, ends: tuple[str, ...]) -> str | None:
    for end in ends:
        fs, p = files.open_uri(path + end)
        if fs.get_file_info(p).is_file:
            return path + end
    return None
