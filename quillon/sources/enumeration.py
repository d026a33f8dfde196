"""Paged enumerations as a Spark source: partitions by key range, a cursor that only advances, and a flag that says whether a walk was whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: A page: the rows with keys above the first number and up to the second (none: no bound), by key, at most so many.
Pager = Callable[[int, int | None, int], Sequence[tuple]]

#: What a walk adds to each row: its partition's number and, on the row that ends a partition's walk, how that ended.
_ENDS = (StructField("_walk", LongType()), StructField("_end", StringType()), StructField("_exhausted", BooleanType()))


class CursorStuck(RuntimeError):
    """A page did not bring the cursor forward, so the walk would never end."""


class _Range(InputPartition):
    """A piece of the walk ``number``."""

    def __init__(self, number: int, after: int, upto: int | None):
        super().__init__(number)
        self.number, self.after, self.upto = number, after, upto


def _walk(pager: Pager, part: _Range, size: int, most_pages: int | None) -> Iterator[tuple]:
    """The rows of a range page by page, the first column as their key, and last one row that tells how the walk ended.

    A short page is the last one; after ``most_pages`` without one the walk is cut off and says so.
    """
    cursor, pages = part.after, 0
    while True:
        if most_pages is not None and pages >= most_pages:
            yield None, cursor, False
            return
        page = list(pager(cursor, part.upto, size))
        pages += 1
        for row in page:
            if row[0] < cursor or row[0] <= part.after:
                raise CursorStuck(f"key {row[0]} after cursor {cursor}")
            yield row, None, None
        if page and page[-1][0] <= cursor:
            raise CursorStuck(f"cursor stays at {cursor}")
        cursor = page[-1][0] if page else cursor
        if len(page) < size:
            yield None, cursor, True
            return


def register(spark: SparkSession, name: str, pager: Pager, schema: StructType, bounds: Sequence[int], size: int = 500, most_pages: int | None = None, cuts: Sequence[int] = ()) -> None:
    """Registers the source ``name``: ``spark.read.format(name)`` walks the key ranges between ``bounds`` (ascending; keys are
    above the first, and the last range is open), each in a task of its own; ``spark.readStream`` reads a page per
    batch from the first bound on. ``cuts`` are further keys at which ranges are cut into pieces, each a task's work,
    so that a range with very many keys is not one task's; a piece's end rows have the range's number.

    ``pager`` runs in Python workers and is sent to them by value. A task that is run again walks its range again.
    """
    full = StructType([*schema.fields, *_ENDS])
    width = len(schema.fields)

    class Reader(DataSourceReader):
        def partitions(self) -> list[_Range]:
            out = []
            for i, (a, b) in enumerate(zip(bounds, [*bounds[1:], None], strict=True)):
                inner = sorted({c for c in cuts if c > a and (b is None or c < b)})
                out += [_Range(i, low, high) for low, high in zip([a, *inner], [*inner, b], strict=True)]
            return out

        def read(self, partition: _Range) -> Iterator[tuple]:
            for row, cursor, whole in _walk(pager, partition, size, most_pages):
                yield (*row, partition.number, None, None) if row is not None else (*[None] * width, partition.number, str(cursor), whole)

    class Stream(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"after": bounds[0]}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            page = list(pager(start["after"], None, size))
            if page and page[-1][0] <= start["after"]:
                raise CursorStuck(f"cursor stays at {start['after']}")
            return iter([(*r, 0, None, None) for r in page]), {"after": page[-1][0] if page else start["after"]}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            cursor = start["after"]
            while cursor < end["after"]:
                page = [r for r in pager(cursor, end["after"], size)]
                yield from ((*r, 0, None, None) for r in page)
                cursor = page[-1][0] if page else end["after"]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return full

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return Stream()

    spark.dataSource.register(Source)


def rows_of(walked: DataFrame, key: str) -> DataFrame:
    """The enumerated rows, each key once (DISTINCT); pages of a source that changes may repeat a key, the least row stays."""
    rows = walked.where("_end IS NULL").drop(*[f.name for f in _ENDS])
    return rows.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*")


def walks_of(walked: DataFrame) -> DataFrame:
    """(walk, rows, cursor, exhausted) of each range: a walk that was cut off is never complete, and one without an end neither.

    The cursor is where the walk can go on: of a range in pieces, the end of the first piece that was cut off.
    """
    end = F.col("_end").cast("long")
    cursor = F.coalesce(F.min(F.when(~F.col("_exhausted"), end)), F.max(end)).cast("string").alias("cursor")
    return walked.groupBy(F.col("_walk").alias("walk")).agg(F.count_if(F.col("_end").isNull()).alias("rows"), cursor, F.coalesce(F.bool_and("_exhausted"), F.lit(False)).alias("exhausted"))


def cuts_of(table: DataFrame, key: str, rows: int = 250_000) -> list[int]:
    """Keys that cut ``table`` into pieces of about so many rows each, by approximate percentiles: a number for each piece."""
    n = table.count()
    shares = [i * rows / n for i in range(1, -(-n // rows))]
    return sorted(set(table.agg(F.percentile_approx(key, shares)).first()[0])) if shares else []


def complete(walked: DataFrame) -> bool:
    """Was every range walked to its end."""
    r = walks_of(walked).agg(F.count("*").alias("n"), F.bool_and("exhausted").alias("all")).first()
    return bool(r.n and r.all)


def parquet_pager(path: str, key: str, columns: Sequence[str], ahead: int = 100_000) -> Pager:
    """Pages of a Parquet file or folder that workers can open, as a service over that table would give them.

    A reader looks ``ahead`` by so many rows and gives further pages out of these while the files stay as they are. It
    reads row groups in order of their least keys, and no more than it needs, so a table in order of its key is
    read about once by all pages of a walk; of another one each look reads the key range's row groups.
    """
    held: dict = {"state": None, "after": 0, "until": None, "rows": None}

    def look(dataset, after: int, upto: int | None, most: int):
        """The rows with the least keys above ``after``, ``most`` at most, in order; whether there may be more."""
        import pyarrow as pa
        import pyarrow.dataset as ds

        at = ds.field(key)
        wanted = at > after if upto is None else (at > after) & (at <= upto)
        groups = []
        for fragment in dataset.get_fragments(filter=wanted):
            for part in fragment.split_by_row_group(filter=wanted, schema=dataset.schema):
                known = (part.row_groups[0].statistics or {}).get(key)
                groups.append((known["min"] if known else after, part))
        groups.sort(key=lambda g: g[0])
        found = None
        for i, (_, part) in enumerate(groups):
            rows = part.to_table(schema=dataset.schema, columns=[key, *columns], filter=wanted)
            found = rows if found is None else pa.concat_tables([found, rows])
            if len(found) >= most:
                found = found.sort_by(key).slice(0, most).combine_chunks()
                if i + 1 == len(groups) or groups[i + 1][0] > found.column(0)[-1].as_py():
                    return found, True
        return (found if found is None else found.sort_by(key)), False

    def page(after: int, upto: int | None, size: int) -> list[tuple]:
        import bisect

        import pyarrow.dataset as ds

        dataset = ds.dataset(path)
        state = [(f.path, f.size, f.mtime_ns) for f in dataset.filesystem.get_file_info(dataset.files)]
        start = None
        if held["state"] == state and held["until"] == upto and held["after"] <= after:
            start = bisect.bisect_right(held["keys"], after)
            if held["more"] and start + size > len(held["keys"]):
                start = None
        if start is None:
            rows, more = look(dataset, after, upto, max(ahead, size))
            data = [c.to_pylist() for c in rows.columns] if rows is not None else [[] for _ in (key, *columns)]
            held.update(state=state, after=after, until=upto, more=more, keys=data[0], rows=data)
            start = 0
        return list(zip(*[c[start : start + size] for c in held["rows"]], strict=True))

    return page
