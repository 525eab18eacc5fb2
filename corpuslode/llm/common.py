"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..session import cut

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def whole(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` or its lambdas name it."""
    return F.transform(F.array(value), use)[0]


def id_crc(doc_id: str) -> Column:
    """CRC32 of the decimal id, on which held-out parts are decided; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def extended(schema: StructType, ddl: str) -> StructType:
    """The schema with more columns behind."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def placed(rows: DataFrame) -> DataFrame:
    """The rows written once, each with its position, for ``numbered``."""
    return cut(rows.withColumn("_position", F.monotonically_increasing_id()))


def numbered(rows: DataFrame, keys: Sequence[str], out: str, blocks: int = 4096) -> DataFrame:
    """Add ``out``: gapless numbers from 0 within each key, whatever share of the rows a key holds.

    ``rows`` come from ``placed``.  Runs of positions form blocks, so a key is
    spread over up to ``blocks`` groups.  Each group numbers its own rows and
    adds the rows of the key in earlier groups, a table of at most
    ``keys x blocks`` counts.  Keys must not be null.
    """
    block = F.pmod(F.xxhash64(F.shiftright("_position", 12)), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("_block", block)
    group = [*keys, "_block"]
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*group).orderBy("_position")) - 1
    return (dealt.withColumn("_own", own).join(starts, group)
            .withColumn(out, (F.col("_start") + F.col("_own")).cast("long"))
            .drop("_position", "_block", "_own", "_start"))


def ordered_numbers(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... in the order of ``key``.

    Rows are dealt out by ranges of the key and sorted where they are; a row's
    number is its place in its range behind the rows of the ranges before.
    """
    ranged = cut(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    # One row per partition.
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return (ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
            .withColumn(out, F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place", "_part", "_start"))


_SPACE_AFTER_SPACE = re.compile(r"\s ")


def units(text: str) -> list[str]:
    """The text cut before every space that follows a character which is no white space.

    The patterns of byte-level tokenizers start a match at each of these places,
    so units can be tokenized by themselves.  A text in which a space follows
    white space is left whole.
    """
    if _SPACE_AFTER_SPACE.search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *[" " + unit for unit in rest]]


class Memo(dict):
    """Results of ``make`` for the keys asked for, started anew when ``most`` are held; long keys are not kept."""

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_kept: dict = {}


def kept(key, make: Callable):
    """What a Python worker keeps from task to task: the result of ``make`` under one key, whatever lay under another goes first.

    Spark uses its workers again for later stages, so without this the tables of
    one operator would stay in memory beside all that follow.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Forget what earlier operators kept in this worker; for tasks that keep nothing themselves."""
    _kept.clear()
