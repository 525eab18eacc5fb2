"""b-bit MinHash near-duplicates.

Each text becomes a set of hashed word shingles.  ``PERMUTATIONS`` minima are
taken; runs of them form bands, which propose candidates; the low ``BITS`` bits
of all minima are packed into longs, and bit counts over two packed signatures
estimate the similarity of a candidate pair, corrected for bits that agree by
chance.  Pairs that may reach the threshold are confirmed on their full sets.

Equal sets are one class.  A bucket links its members to one pivot, the member
that stands in the fullest buckets, which in a group of edited copies is close
to the text they come from.  Buckets that still hold several components are
settled without comparing all their members: two sets that reach the threshold
share one of their rarest shingles (a prefix filter, which loses nothing), so
texts below it, whose rare shingles are their own, meet no one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, release

BANDS = 24
ROWS = 6
PERMUTATIONS = BANDS * ROWS
BITS = 2
PER_LONG = 64 // BITS
LONGS = -(-PERMUTATIONS // PER_LONG)
# Estimates have a standard error of about 0.04 near the threshold; four of them leave 1 link in 30,000 unseen.
MARGIN = 0.16

_random = np.random.default_rng(20_231)
_FACTORS = (_random.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFTS = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)[:, None]
_ODD = [np.uint64(int(x) | 1) for x in _random.integers(1, 2**63, 16)]
_BAND_SALT = _random.integers(1, 2**63, (BANDS, ROWS)).astype(np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[8]
    x = (x ^ (x >> np.uint64(29))) * _ODD[9]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole text is one shingle if it has fewer words."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    count = len(found) - width + 1
    total = np.full(count, np.uint64(width))
    for k in range(width):
        total = _mixed(total + ids[k:k + count] * _ODD[k % 8])
    return np.unique(total)


def signature(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the minima, and one key per band."""
    short = (members >> np.uint64(32)).astype(np.uint32)[None, :]
    minima = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for start in range(0, short.shape[1], 4096):
        np.minimum(minima, (short[:, start:start + 4096] * _FACTORS + _SHIFTS).min(axis=1), out=minima)
    low = np.zeros(LONGS * PER_LONG, np.uint64)
    low[:PERMUTATIONS] = minima & np.uint32((1 << BITS) - 1)
    packed = np.bitwise_or.reduce(low.reshape(LONGS, PER_LONG) << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=1)
    bands = _mixed((_mixed(minima.reshape(BANDS, ROWS).astype(np.uint64) + _BAND_SALT) * _BAND_SALT).sum(axis=1, dtype=np.uint64))
    return packed.view(np.int64), bands.view(np.int64)


def signatures(docs: DataFrame, words: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_shingles, members binary, packed, bands)``; ``members`` identifies the set by 128 bits, null if it is empty."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sizes, names, packed, bands = [], [], [], []
            for value in batch.column(1).to_pylist():
                members = shingle_set(value, words)
                sizes.append(len(members))
                if len(members):
                    p, b = signature(members)
                    names.append(xxhash.xxh128_digest(members.tobytes()))
                    packed.append(p)
                    bands.append(b)
                else:
                    names.append(None)
                    packed.append([])
                    bands.append([])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                pa.array(packed, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "members", "packed", "bands"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(sign, "doc_id long, n_shingles long, members binary, packed array<bigint>, bands array<bigint>")


def estimate(left: Column, right: Column) -> Column:
    """Similarity of two packed signatures; ``2^-BITS`` of unequal minima agree in their low bits by chance."""
    low = sum(1 << (BITS * i) for i in range(PER_LONG))
    low = low - (1 << 64) if low >= 1 << 63 else low
    differ = F.lit(0)
    for k in range(LONGS):
        x = left[k].bitwiseXOR(right[k])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(low)))
    agree = 1 - differ / F.lit(float(PERMUTATIONS))
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def full_sets(wanted: DataFrame, docs: DataFrame, reps: DataFrame, words: int, text: str, doc_id: str) -> DataFrame:
    """``(members, hashes)``: the sets of the ``wanted (members)`` classes, made again from the text of the least document of each."""
    named = wanted.join(reps, "members").select("members", "rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            names, values = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                members = shingle_set(value, words)
                if xxhash.xxh128_digest(members.tobytes()) == name:
                    names.append(name)
                    values.append(members.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(values, pa.list_(pa.int64()))], names=["members", "hashes"])

    texts = (docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("binary").alias("text"))
             .join(named, "rep").select("members", "text").mapInArrow(sets, "members binary, hashes array<bigint>"))
    return texts.dropDuplicates(["members"])


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """The ``pairs (u, v)`` of classes whose full sets reach the threshold."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("members")).distinct()
    texts = full_sets(wanted, docs, reps, words, text, doc_id)
    shared = F.size(F.array_intersect("a", "b"))
    return (pairs.join(texts.select(F.col("members").alias("u"), F.col("hashes").alias("a")), "u")
            .join(texts.select(F.col("members").alias("v"), F.col("hashes").alias("b")), "v")
            .withColumn("_shared", shared)
            .where(F.lit(100) * F.col("_shared") >= F.lit(percent) * (F.size("a") + F.size("b") - F.col("_shared")))
            .select("u", "v"))


def rare_partners(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v)`` of ``sets (members, component, hashes)`` of different components that may reach the threshold.

    Sets of similarity t share at least ``t * n`` shingles, n being the size of
    either, so both hold a common one among their first ``n - ceil(t * n) + 1``,
    whatever the order.  The order here is by rising frequency: a prefix of
    shingles that no other set holds proposes nothing.  After their first common
    shingle, two sets can share only what is left of either, which must reach the
    ``t / (1 + t)`` of both sizes that the threshold asks for.
    """
    size = F.size("hashes")
    # Integer arithmetic: n - ceil(percent * n / 100) + 1.
    prefix = size - ((F.lit(percent) * size + 99) / 100).cast("int") + 1
    tokens = cut(sets.select("members", "component", size.alias("n"), prefix.alias("prefix"), F.explode("hashes").alias("token")))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles of one set alone stand first in it; only their number matters.
    held = tokens.join(common, "token")
    met = (held.groupBy("members").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
                                       F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
           .withColumn("open", F.col("prefix") - (F.col("n") - F.size("held"))).where("open > 0")
           .select("members", "component", "n", F.size("held").alias("known"), F.posexplode(F.slice("held", F.lit(1), F.col("open"))["token"]).alias("at", "token")))
    met = cut(met.select("members", "component", "n", "token", (F.col("known") - F.col("at")).alias("left")))
    one = met.select("token", F.col("members").alias("u"), F.col("component").alias("cu"), F.col("n").alias("nu"), F.col("left").alias("lu"))
    two = met.select("token", F.col("members").alias("v"), F.col("component").alias("cv"), F.col("n").alias("nv"), F.col("left").alias("lv"))
    fits = F.lit(100 + percent) * F.least("lu", "lv") >= F.lit(percent) * (F.col("nu") + F.col("nv"))
    return one.join(two, "token").where((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & fits).select("u", "v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(members, component)`` of every node of ``links (u, v)``: its least reachable node.

    Alternates large and small stars; minima combine before the shuffle, so a
    node with very many links is not gathered anywhere.  Each round is written to
    the checkpoint folder.
    """
    def facts(edges: DataFrame):
        return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()

    def star(directed: DataFrame, hub: str, leaf: str, large: bool) -> DataFrame:
        least = directed.groupBy(hub).agg(F.least(F.col(hub), F.min(leaf)).alias("least"))
        joined = directed.join(least, hub)
        if large:
            out = joined.where(F.col(leaf) > F.col(hub)).select(F.col(leaf).alias("u"), F.col("least").alias("v"))
        else:
            out = joined.select(F.explode(F.array(leaf, hub)).alias("u"), F.col("least").alias("v"))
        return out.where("u <> v").distinct()

    # Links run from the greater node to the smaller.
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while (now := facts(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = star(both, "u", "v", True)
        edges = cut(star(edges, "u", "v", False))
    stars = edges.select(F.col("u").alias("members"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("members"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    Two documents are linked if ``100 * |A and B| >= percent * |A or B|`` for
    their sets of ``words``-word shingles (A-Z in lower case, words parted by
    ASCII white space; fewer words make one shingle).  ``component_id`` is the
    least doc_id reachable over links, ``kept`` says that it is the row's own.
    Null, empty and blank texts have no shingles and stay alone.  Rows with a
    null doc_id link with nothing, have a null ``component_id`` and are kept.
    Repeated rows get the same answer.  An empty table gives an empty one; other
    columns of ``docs`` are not read.
    """
    signed = cut(signatures(docs, words, text, doc_id))
    reps = cut(signed.where("members is not null and doc_id is not null").groupBy("members")
               .agg(F.min(F.struct("doc_id", "packed", "bands")).alias("first"))
               .select("members", F.col("first.doc_id").alias("rep"), F.col("first.packed").alias("packed"), F.col("first.bands").alias("bands")))
    packed = reps.select("members", "packed")
    buckets = reps.select("members", F.posexplode("bands").alias("band", "bucket"))
    full = buckets.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(buckets.join(full, ["band", "bucket"]))
    weights = shared.groupBy("members").agg(F.sum("n").alias("weight"))
    pivots = (shared.join(weights, "members").groupBy("band", "bucket")
              .agg(F.max(F.struct("weight", "members"))["members"].alias("first")))
    shared = cut(shared.drop("n").join(pivots, ["band", "bucket"]))

    def likely(pairs: DataFrame) -> DataFrame:
        """Distinct pairs, smaller node first, that the signatures do not rule out."""
        ordered = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
        return (ordered.join(packed.select(F.col("members").alias("u"), F.col("packed").alias("p")), "u")
                .join(packed.select(F.col("members").alias("v"), F.col("packed").alias("q")), "v")
                .where(estimate(F.col("p"), F.col("q")) >= percent / 100 - MARGIN).select("u", "v"))

    first_pairs = cut(likely(shared.select(F.col("members").alias("u"), F.col("first").alias("v"))))
    links = cut(confirmed(first_pairs, docs, reps, words, percent, text, doc_id))
    found = cut(components(links))

    # Members of buckets with several components meet on rare shingles.
    labelled = (shared.select("band", "bucket", "members").join(found, "members", "left")
                .withColumn("component", F.coalesce("component", "members")))
    mixed = labelled.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_members = cut(labelled.join(mixed.select("band", "bucket"), ["band", "bucket"]).select("members", "component").distinct())
    sets = full_sets(open_members.select("members"), docs, reps, words, text, doc_id).join(open_members, "members")
    rest = likely(rare_partners(sets, percent)).join(first_pairs, ["u", "v"], "left_anti")
    late = cut(confirmed(cut(rest), docs, reps, words, percent, text, doc_id))
    if not late.isEmpty():
        found = cut(components(links.unionByName(late)))

    least = reps.select("members", "rep").join(found, "members").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = found.join(least, "component").select("members", "component_id")
    classes = reps.select("members", "rep").join(named, "members", "left").select("members", F.coalesce("component_id", "rep").alias("component_id"))
    return (signed.select("doc_id", "n_shingles", "members").join(classes, "members", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
