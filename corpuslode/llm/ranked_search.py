"""Ranked search of documents for items, term by term: a pipeline of term owners.

Terms are dealt to a few owners by rising document frequency, each owner with
about the same number of postings.  A bundle of an item carries the scores that
documents have so far, through one owner after the other: each stage is a
cogroup of the bundles with the owner's postings and adds integers.  Rare terms
come first, so that when the long postings come, documents that cannot reach the
best any more have left the bundles.

Postings of a frequent term are split by blocks of documents, those of one Arrow
batch, and so are the bundles; a group of a cogroup is one block and one bucket
of items, whatever the size of the table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from ..session import BROADCAST_ROWS
from .common import Memo, cut, lower_ascii, whole

# Terms are runs of ASCII letters, digits and everything beyond ASCII; only A-Z are lowered.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

# Owners a bundle visits, items of one bucket (about), and bits of the filter for terms of items.
OWNERS = 4
BUCKET_ITEMS = 256
FILTER_BITS = 1 << 22
PART_BITS = 1 << 15  # what one bitmap of the SQL functions holds


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_LOWERED).split()


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``(item_id, term)``, once each; rows that repeat an id are one item."""
    split = F.array_distinct(F.array_remove(F.split(lower_ascii(whole(text)), NO_TERM), ""))
    return items.select(F.col(item_id).alias("item_id"), F.explode(split).alias("term")).distinct()


def term_filter(terms: DataFrame) -> np.ndarray:
    """One bit for each CRC32 of a term, ``FILTER_BITS`` in all, so its size does not depend on the terms."""
    bit = F.crc32(F.col("term").cast("binary")).bitwiseAND(FILTER_BITS - 1).cast("long")
    parts = (terms.select(F.floor(bit / PART_BITS).alias("part"), (bit % PART_BITS).alias("place"))
             .groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, bits in parts:
        out[part * PART_BITS // 8:(part + 1) * PART_BITS // 8] = np.frombuffer(bytes(bits), np.uint8)
    return out


def in_filter(bits: np.ndarray, term: bytes) -> bool:
    bit = zlib.crc32(term) & (FILTER_BITS - 1)
    return bool(bits[bit >> 3] >> (bit & 7) & 1)


def size_sums(docs: DataFrame, text: str) -> tuple[int, int]:
    """Number of texts with at least one term, and of all their terms."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            sizes = [len(terms_of(value or "")) for value in batch.column(0).to_pylist()]
            n += sum(size > 0 for size in sizes)
            total += sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    row = docs.select(F.col(text).alias("text")).mapInArrow(sums, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def block_postings(docs: DataFrame, text: str, doc_id: str, bits: np.ndarray, n: int, total: int) -> DataFrame:
    """``(block, term, places, parts, peak, ids)``: postings of terms that may be an item's, by blocks of documents.

    ``places`` are places within the block, in the order of the ids, null ids
    last; ``parts`` the quotients a term's weight is multiplied with, ``peak``
    the largest of them.  A row without a term lists the ids of the block.
    """
    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("places", pa.list_(pa.int32())), ("parts", pa.list_(pa.int32())),
                        ("peak", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filtered = bits
        wanted = Memo(lambda term: in_filter(filtered, term), 400_000)
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            rows = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), key=lambda r: (r[0] is None, r[0] or 0))
            found: dict[bytes, tuple[list[int], list[int]]] = {}
            for place, (_, value) in enumerate(rows):
                terms = terms_of(value or "")
                if not terms:
                    continue
                spread = 20 * (50 + 50 * len(terms) * n // total)
                counts: dict[bytes, int] = {}
                for term in filter(wanted.__getitem__, terms):
                    counts[term] = counts.get(term, 0) + 1
                for term, tf in counts.items():
                    places, parts = found.setdefault(term, ([], []))
                    places.append(place)
                    parts.append(1_000_000_000 * tf // (1000 * tf + spread))
            block = first + number
            names = [t.decode() for t in found]
            postings = list(found.values())
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * (len(names) + 1), pa.int64()), pa.array([None, *names], pa.string()),
                pa.array([[], *(p[0] for p in postings)], pa.list_(pa.int32())), pa.array([[], *(p[1] for p in postings)], pa.list_(pa.int32())),
                pa.array([0, *(max(p[1]) for p in postings)], pa.int64()), pa.array([[r[0] for r in rows], *([None] * len(names))], pa.list_(pa.int64()))],
                schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        post, "block long, term string, places array<int>, parts array<int>, peak long, ids array<long>")


def deal_terms(weighed: DataFrame, owners: int) -> DataFrame:
    """Add ``owner``: terms by rising document frequency, about as many postings for each.

    Terms are told apart by the power of two of their frequency, so the table
    that decides has at most 64 rows.
    """
    power = F.floor(F.log2(F.col("df"))).cast("int")
    sums = sorted((r["power"], r["postings"]) for r in weighed.groupBy(power.alias("power")).agg(F.sum("df").alias("postings")).collect())
    total, before, owner = sum(p for _, p in sums), 0, F.lit(0)
    for at, postings in sums:
        # The middle of its postings decides where a power belongs.
        mine = min(owners - 1, owners * (2 * before + postings) // (2 * total))
        owner = F.when(power >= at, F.lit(mine)).otherwise(owner)
        before += postings
    return weighed.withColumn("owner", owner)


TERMS = "array<struct<owner: int, term: string, weight: long, peak: long>>"
ASKED = pa.list_(pa.struct([("owner", pa.int32()), ("term", pa.string()), ("weight", pa.int64()), ("peak", pa.int64())]))
BUNDLE = f"bucket int, block long, item_id long, terms {TERMS}, places array<int>, scores array<long>"
FOUND = "item_id long, block long, place int, doc_id long, score long"


def _kept(scores: np.ndarray, places: np.ndarray, best: int, hope: int) -> tuple[np.ndarray, np.ndarray]:
    """What may still be among the best: its score with all that can come reaches the score of the last of the best so far."""
    if len(scores) > best:
        bar = np.partition(scores, -best)[-best]
        keep = scores + hope >= bar
        return scores[keep], places[keep]
    return scores, places


def added(left: pa.Table, right: pa.Table, owner: int, best: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bundle of a block, places and scores after one owner's terms."""
    lists = {term: n for n, term in enumerate(right.column("term").to_pylist())}
    columns = [t.column(c).combine_chunks() for t in (right, left) for c in t.column_names if c in ("places", "parts", "scores")]
    (at, places), (_, parts), (held_at, held), (_, scores_held) = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in columns]
    sums = np.zeros(1 + max((int(v.max()) for v in (places, held) if len(v)), default=0), np.int64)
    for row, terms in enumerate(left.column("terms").to_pylist()):
        before = slice(held_at[row], held_at[row + 1])
        sums[held[before]] = scores_held[before]
        hope = sum(t["weight"] * t["peak"] for t in terms if t["owner"] > owner)
        for t in terms:
            if t["owner"] == owner:
                n = lists[t["term"]]
                sums[places[at[n]:at[n + 1]]] += t["weight"] * parts[at[n]:at[n + 1]].astype(np.int64)
        found = np.flatnonzero(sums)
        scores = sums[found]
        sums[found] = 0
        yield _kept(scores, found, best, hope)


def visit_owner(bundles: DataFrame, postings: DataFrame, owner: int, best: int) -> DataFrame:
    """One stage: the bundles with the postings of one owner's terms added.

    A document leaves a bundle when its score and the peaks of all later terms
    together stay below the scores that ``best`` documents of its block have
    already; those are then above it in the end too, so the result is exact.  If
    it comes back with a later term, its score is only lower than it was.
    """
    def stage(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(added(left, right, owner, best))
        offsets = np.cumsum([0] + [len(f) for _, f in found]).astype(np.int32)
        scores, places = (np.concatenate([f[n] for f in found] or [[]]) for n in (0, 1))
        left = left.drop_columns(["places", "scores"])
        at = left.column_names.index("terms")
        left = left.set_column(at, "terms", left.column("terms").cast(ASKED))  # Arrow tells columns without nulls apart
        return (left.append_column("places", pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())))
                .append_column("scores", pa.ListArray.from_arrays(offsets, pa.array(scores, pa.int64()))))

    return bundles.groupBy("bucket", "block").cogroup(postings.groupBy("bucket", "block")).applyInArrow(stage, BUNDLE)


def select_best(bundles: DataFrame, postings: DataFrame, owner: int, best: int) -> DataFrame:
    """The last stage: after its terms, the ``best`` documents of each block; the row without a term names them."""
    def stage(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"place": [], "score": []}
        sizes = []
        for scores, places in added(left, right, owner, best):
            order = np.lexsort((places, -scores))[:best]
            out["place"].append(places[order])
            out["score"].append(scores[order])
            sizes.append(len(order))
        places, scores = (np.concatenate([np.empty(0, np.int64), *out[c]]) for c in ("place", "score"))
        row = np.repeat(np.arange(len(sizes)), sizes)
        ids = right.filter(pc.is_null(right.column("term"))).column("ids").combine_chunks().flatten()
        if not len(row):
            ids = ids.slice(0, 0)
        return pa.Table.from_arrays([left.column("item_id").combine_chunks().take(pa.array(row)), left.column("block").combine_chunks().take(pa.array(row)),
                                     pa.array(places, pa.int32()), ids.take(pa.array(places)), pa.array(scores, pa.int64())],
                                    names=["item_id", "block", "place", "doc_id", "score"])

    return bundles.groupBy("bucket", "block").cogroup(postings.groupBy("bucket", "block")).applyInArrow(stage, FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, best: int = 50, text: str = "text", doc_id: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id", owners: int = OWNERS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``best`` documents with the highest scores above 0 for each item.

    Every document takes part with its whole text.  Scores are integers, equal
    ones are ranked by rising id, null ids last.  Null and empty texts have no
    terms: such items have no rows, such documents are in none.  Rows that repeat
    a ``doc_id`` are documents of their own; rows that repeat an ``item_id`` are
    one item with the terms of all, also for the null id.  Ids are read as longs.
    Columns other than those named are not read, so no name can clash.  Empty
    tables give an empty result.
    """
    spark = docs.sparkSession
    terms = cut(item_terms(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")), "item_id", "text"))
    n, total = size_sums(docs, text)
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not total:
        return empty
    posted = cut(block_postings(docs, text, doc_id, term_filter(terms), n, total))
    frequencies = posted.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("df"))
    weight = F.floor(F.lit(1000) * F.log((2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    n_items = terms.select("item_id").distinct().count()
    buckets = max(1, math.ceil(n_items / BUCKET_ITEMS))
    weighed = cut(terms.select("term").distinct().join(frequencies, "term").withColumn("weight", weight).where("weight > 0"))
    known = weighed.count()
    if not known:
        return empty
    dealt = deal_terms(weighed, owners).drop("df")
    asked = cut(terms.join(dealt, "term").withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int")))

    def few(rows: DataFrame, at_most: int) -> DataFrame:
        """Broadcast what is known to have few rows; AQE splits a hot term of a larger table."""
        return F.broadcast(rows) if at_most <= BROADCAST_ROWS else rows

    # Every bucket that asks for a term gets its postings.
    places = asked.select("bucket", "term", "owner").distinct()
    postings = cut(posted.where("term IS NOT NULL").drop("ids").join(few(places, known * buckets), "term"))
    # The questions of a bundle: terms that its block holds at all.
    questions = postings.select("bucket", "block", "term", "peak").join(
        few(asked.select("bucket", "term", "item_id", "owner", "weight"), asked.count()), ["bucket", "term"])
    bundles = questions.groupBy("bucket", "block", "item_id").agg(F.collect_list(F.struct("owner", "term", "weight", "peak")).alias("terms")).select(
        "bucket", "block", "item_id", "terms", F.array().cast("array<int>").alias("places"), F.array().cast("array<long>").alias("scores"))
    lists = postings.select("bucket", "block", "owner", "term", "places", "parts", F.lit(None).cast("array<long>").alias("ids"))
    bundles = bundles.toDF(*bundles.columns)  # columns of its own: both sides of the cogroup come from the postings
    for owner in range(owners - 1):
        bundles = visit_owner(bundles, lists.where(F.col("owner") == owner), owner, best)
    names = posted.where("term IS NULL").select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "block", F.lit(owners - 1).alias("owner"),
                                                "term", "places", "parts", "ids")
    found = select_best(bundles, lists.where(F.col("owner") == owners - 1).unionByName(names), owners - 1, best)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "block", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
