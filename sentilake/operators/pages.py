"""Pages of an ordered table, without numbering the whole table in one task."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ids are counted in runs of at least 2 ** RUN_BITS values; ids are unique, so such a run holds at most as many rows.
RUN_BITS = 16
#: Most runs that one histogram tells apart.
RUNS = 1 << 16
#: A range of at most this many rows is sorted to cut a page out of it.
RANGE_ROWS = 1 << 16
#: Ids that are not integers are cut at quantiles of a sample of this many.
SAMPLE, CUTS = 4096, 64


@dataclass(frozen=True)
class Page:
    """The rows of one page in id order, and the number of rows over all pages."""

    rows: DataFrame
    total: int
    page: int
    per_page: int


@dataclass(frozen=True)
class _Cut:
    """Where a page lies within a table: bounds of its ids (None: open), rows in them, rows before them, all rows."""

    low: Any
    high: Any
    n: int
    before: int
    total: int


def page_of(df: DataFrame, id_column: str, page: int = 1, per_page: int = 10) -> Page:
    """Rows ``[(page - 1) * per_page, page * per_page)`` in order of a unique id of any type that can be ordered.

    Rows are counted per range of ids and only the ranges that the page touches are looked at again, as a range
    filter that reaches the scan; large ranges are cut again. So a page deep in the table costs no more than the first
    one, and no task sorts more than a range. A page past the end is empty; a null id comes first.
    """
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page must be positive")
    start, end = (page - 1) * per_page, page * per_page
    kind = df.schema[id_column].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or _is_wide(kind)
    cut = _cut_integers if whole else _cut_sampled
    part, low, high, before, total, last = df, None, None, 0, None, None
    while True:
        found = cut(part, id_column, start - before, end - before)
        total = found.total if total is None else total
        if start >= total:
            return Page(df.limit(0), total, page, per_page)
        low = found.low if found.low is not None else low
        high = found.high if found.high is not None else high
        before += found.before
        part = df.filter(_within(F.col(id_column), low, high))
        if found.n <= RANGE_ROWS + per_page or found.n == last:
            break
        last = found.n
    return Page(part.orderBy(id_column).offset(start - before).limit(per_page), total, page, per_page)


def _within(value: Column, low: Any, high: Any) -> Column:
    if low is None:
        return F.lit(True) if high is None else (value < F.lit(high)) | value.isNull()
    return value >= F.lit(low) if high is None else (value >= F.lit(low)) & (value < F.lit(high))


#: Whole numbers beyond 64 bits come as decimals; with one digit to spare their differences stay exact.
WIDE_DIGITS = 37


def _is_wide(kind: T.DataType) -> bool:
    return isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= WIDE_DIGITS


def _cut_integers(df: DataFrame, id_column: str, start: int, end: int) -> _Cut:
    """Runs of ids, so wide that there are at most ``RUNS`` of them; a page of p rows touches at most p non-empty runs."""
    wide = _is_wide(df.schema[id_column].dataType)
    value = F.col(id_column) if wide else F.col(id_column).cast("long")
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    smallest = int(ends["low"] or 0)
    spread = int(ends["high"] or 0) - smallest
    bits = max(RUN_BITS, spread.bit_length() - RUNS.bit_length() + 1)
    if wide:
        run = F.call_function("div", value - F.lit(Decimal(smallest)), F.lit(Decimal(1 << bits)))
        origin, beyond_all, as_id = smallest, 10 ** (WIDE_DIGITS + 1), Decimal
    else:
        # A shift, as a division would go through double and lose large ids.
        run = F.shiftright(value, bits)
        origin, beyond_all, as_id = 0, 1 << 63, int
    by_run = Window.orderBy("run")
    runs = df.groupBy(run.alias("run")).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(by_run))
    before = F.col("upto") - F.col("n")
    touched = (F.col("upto") > start) & (before < end)
    # One row.
    found = runs.agg(
        F.sum("n").alias("total"),
        F.sum(F.when(touched, F.col("n"))).alias("n"),
        F.min(F.when(touched, before)).alias("before"),
        F.min(F.when(touched, F.struct(F.col("run").isNotNull(), "run"))).alias("first"),
        F.max(F.when(touched, F.col("run"))).alias("last"),
    ).first()
    if found["first"] is None:
        return _Cut(None, None, 0, 0, found["total"] or 0)
    lowest, last = found["first"]["run"], found["last"]
    edge = None if last is None else origin + ((last + 1) << bits)
    beyond = None if edge is None or edge >= beyond_all else as_id(edge)
    low = None if lowest is None else as_id(origin + (lowest << bits))
    only_nulls = as_id(-beyond_all + wide)
    return _Cut(low, beyond if last is not None or low is not None else only_nulls, found["n"], found["before"], found["total"])


def _cut_sampled(df: DataFrame, id_column: str, start: int, end: int) -> _Cut:
    """Ranges between quantiles of the ids of smallest hash, with exact counts."""
    value = F.col(id_column)
    sample = df.filter(value.isNotNull()).select(id_column).orderBy(F.xxhash64(value), value).limit(SAMPLE)
    ids = [r[0] for r in sample.orderBy(id_column).collect()]
    cuts = sorted({i * len(ids) // CUTS for i in range(1, CUTS)} - {0}) if ids else []
    cuts = [ids[i] for i in cuts]
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value)) if cuts else F.lit(0)
    counts = {r["k"]: r["n"] for r in df.groupBy(F.greatest(number, F.lit(0)).alias("k")).agg(F.count("*").alias("n")).collect()}
    before = n = 0
    touched: list[int] = []
    first = None
    for k in range(len(cuts) + 1):
        size = counts.get(k, 0)
        if before + size > start and before < end and size:
            first = before if first is None else first
            touched.append(k)
            n += size
        before += size
    if not touched:
        return _Cut(None, None, 0, 0, before)
    low = cuts[touched[0] - 1] if touched[0] else None
    high = cuts[touched[-1]] if touched[-1] < len(cuts) else None
    return _Cut(low, high, n, first, before)


# ---- stored tables with a page index ---------------------------------------------------------


ROWS_PER_RANGE = 1_000_000
PLACE = "_place"
#: A row's place is its range in the high bits and its rank within the range below them.
PLACE_BITS = 33


@dataclass(frozen=True)
class PagedTable:
    """A table stored in id order, with the number of rows of each range: any page is a filter on stored places."""

    spark: SparkSession
    path: str

    def index(self) -> DataFrame:
        """(range, n, before): one row for each range."""
        return self.spark.read.parquet(f"{self.path}/index")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def page(self, page: int = 1, per_page: int = 10) -> Page:
        """Reads the index and the row groups that hold the page; sorts its rows only."""
        if page < 1 or per_page < 1:
            raise ValueError("page and per_page must be positive")
        start, end = (page - 1) * per_page, page * per_page
        upto = F.col("before") + F.col("n")
        touched = (upto > start) & (F.col("before") < end)
        place = F.shiftleft(F.col("range"), PLACE_BITS)
        found = self.index().agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            F.min(F.when(touched, place + F.greatest(F.lit(start) - F.col("before"), F.lit(0)))).alias("low"),
            F.max(F.when(touched, place + F.least(F.lit(end) - F.col("before"), F.col("n")))).alias("high"),
        ).first()
        rows = self.rows()
        if found["low"] is None:
            return Page(rows.drop(PLACE).limit(0), found["total"], page, per_page)
        cut = rows.filter((F.col(PLACE) >= found["low"]) & (F.col(PLACE) < found["high"]))
        return Page(cut.orderBy(PLACE).drop(PLACE), found["total"], page, per_page)


def store_pages(df: DataFrame, id_column: str, path: str, rows_per_range: int = ROWS_PER_RANGE) -> PagedTable:
    """Store a table in order of an id of any type, with its page index. Repeated and null ids keep a fixed order.

    The ids are dealt to ranges by Spark's range exchange; a row's rank in its sorted range needs no further exchange. The counts are
    those of the rows written. The index comes last: without it the table does not stand.
    """
    spark = df.sparkSession
    if PLACE in df.columns:
        raise ValueError(f"The column name {PLACE} is taken.")
    ranges = max(1, -(-df.count() // rows_per_range))
    ordered = df.repartitionByRange(ranges, id_column).sortWithinPartitions(id_column)
    ordered.withColumn(PLACE, F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rows")
    counts = (
        spark.read.parquet(f"{path}/rows").groupBy(F.shiftright(PLACE, PLACE_BITS).alias("range")).agg(F.count("*").alias("n"))
    )
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    index = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return PagedTable(spark, path)


def page_count(total: Column, per_page: int) -> Column:
    return F.ceil(total / F.lit(per_page)).cast("bigint")


def page_links(total: Column, page: int, per_page: int) -> tuple[Column, Column]:
    """(has_previous, has_next) of a page."""
    return F.lit(page > 1), F.lit(page * per_page) < total


def page_document(page: Page, id_column: str) -> DataFrame:
    """One JSON row ``{total, page, per_page, results}`` with the results in id order.

    The rows are at most ``per_page`` many.
    """
    columns = [c for c in page.rows.columns if c != id_column]
    ordered = F.array_sort(F.collect_list(F.struct(F.col(id_column).alias("id"), F.struct(*columns).alias("r"))))
    return page.rows.agg(
        F.to_json(
            F.struct(
                F.lit(page.total).cast("bigint").alias("total"),
                F.lit(page.page).alias("page"),
                F.lit(page.per_page).alias("per_page"),
                F.transform(ordered, lambda x: x["r"]).alias("results"),
            )
        ).alias("document")
    )
