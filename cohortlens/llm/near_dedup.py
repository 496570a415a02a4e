"""Near-duplicate documents by MinHash, banding, checks on full sets, and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.components import components
from cohortlens.llm.stage import files_for, lean, staged
from cohortlens.llm.words import (
    MULTIPLIER,
    NOT_SPACE,
    Words,
    hashed,
    mixed,
    random_numbers,
    words_of,
)

#: Bands and minima in a band. A pair at 0.85 shares no band with a chance of 6e-11, at 0.8
#: of 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: How far below the wanted similarity a signature's share of equal minima may lie for the
#: pair to be checked on its sets: over five standard deviations.
MARGIN = 0.2
#: Rounds of one centre against its bucket before the rest is compared in blocks.
STAR_ROUNDS = 1
QUERY_BLOCK, MEMBER_BLOCK = 256, 1024
#: Ids of documents or buckets up to which a list of them is broadcast (16 MB of numbers).
BROADCAST_IDS = 2_000_000
#: Documents to a file of the tables staged on the way.
FILE_DOCS = 20_000

_FACTORS, _ADDENDS = random_numbers(HASHES, 11) | np.uint64(1), random_numbers(HASHES, 12)


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """Of each row the sorted distinct numbers of its shingles.

    A row of fewer words has one shingle, its whole sequence; a row without words has none.
    """
    h, bounds = hashed(w.data, w.starts, w.ends), w.bounds()
    n = max(0, len(h) - size + 1)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = mixed(value ^ h[k : k + n]) + MULTIPLIER
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= size:
            yield np.unique(value[a : b - size + 1])
        elif b > a:
            x = np.zeros(1, np.uint64)
            for k in range(a, b):
                x = mixed(x ^ h[k : k + 1]) + MULTIPLIER
            yield mixed(x ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit minima of each set (none empty), a row for each, a column for each hash."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):  # as many sets as fit the cache together
        stop, total = at + 1, len(sets[at])
        while stop < len(sets) and total + len(sets[stop]) <= 32768:
            total += len(sets[stop])
            stop += 1
        x = np.concatenate(sets[at:stop])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : stop - 1]]))).astype(np.int64)
        y = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, _FACTORS[k], out=y)
            np.add(y, _ADDENDS[k], out=y)
            out[at:stop, k] = np.minimum.reduceat(y, starts) >> np.uint64(32)
        at = stop
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, digest, sig``; the last two are null for an empty set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for w in words_of(batch.column("text"), NOT_SPACE):
                sets = list(shingle_sets(w, size))
                full = [s for s in sets if len(s)]
                sig = iter(minima(full))
                digests, sigs = [], []
                for s in sets:
                    if len(s):
                        two = (s.sum(), np.bitwise_xor.reduce(mixed(s + MULTIPLIER)))
                        digests.append(np.array([*two, len(s)], np.uint64).tobytes())
                        sigs.append(next(sig).tobytes())
                    else:
                        digests.append(None)
                        sigs.append(None)
                yield pa.record_batch(
                    [ids.slice(w.first, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                    ["doc_id", "n_shingles", "digest", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        lean(of), "doc_id long, n_shingles long, digest binary, sig binary"
    )


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, full``: the sorted shingle numbers as bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for w in words_of(batch.column("text"), NOT_SPACE):
                sets = [s.tobytes() for s in shingle_sets(w, size)]
                yield pa.record_batch(
                    [ids.slice(w.first, len(sets)), pa.array(sets, pa.binary())], ["doc_id", "full"]
                )

    return docs.select("doc_id", "text").mapInArrow(lean(of), "doc_id long, full binary")


def similar_signatures(pairs: DataFrame, share: float) -> DataFrame:
    """The pairs ``u, v`` whose signatures ``su, sv`` agree often enough."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.array([np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()]).reshape(-1, HASHES)
                for c in ("su", "sv")
            )
            keep = pa.array((a == b).mean(axis=1) >= share)
            yield batch.select(["u", "v"]).filter(keep)

    return pairs.mapInArrow(of, "u long, v long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def similar_sets(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` with 100 * intersection >= percent * union of ``fu, fv``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("fu"), batch.column("fv"))
            ]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(of, "u long, v long")


UNIT = "key long, qb long, mb long, query boolean, rep long, comp long, band int, sig binary"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit (``key, qb, mb``) of a stream that is sorted by them."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        names = list(zip(*(batch.column(c).to_pylist() for c in ("key", "qb", "mb"))))
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and names[a] != name:
                yield pa.Table.from_batches(held)
                held = []
            name = names[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _likely(unit: pa.Table, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query of a unit: its row, the rows likely similar to it, and their shares.

    A pair of one component is left out, and one that shares an earlier band is left to
    that band's bucket.
    """
    comps, query = unit.column("comp").to_numpy(), unit.column("query").to_numpy()
    sig = np.array([np.frombuffer(x, np.uint32) for x in unit.column("sig").to_pylist()])
    band = unit.column("band")[0].as_py()
    members = np.flatnonzero(~query)
    for i in np.flatnonzero(query):
        other = members[comps[members] != comps[i]]
        same = sig[other] == sig[i]
        shares = same.mean(axis=1)
        keep = shares >= share
        if band:
            keep &= ~same[:, : band * ROWS].reshape(len(other), band, ROWS).all(axis=2).any(axis=1)
        if keep.any():
            yield i, other[keep], shares[keep]


def taking_part(units: DataFrame, share: float) -> DataFrame:
    """The rows of each unit that are in some likely pair."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            met = np.zeros(unit.num_rows, bool)
            for i, rows, _ in _likely(unit, share):
                met[i] = met[rows] = True
            yield from unit.filter(pa.array(met)).to_batches()

    return units.select(*[c.split()[0] for c in UNIT.split(", ")]).mapInArrow(of, UNIT)


def unit_links(units: DataFrame, share: float, percent: int) -> DataFrame:
    """Pairs ``u, v`` that link the components of a unit; rows have their sets as ``full``.

    The likeliest pairs are checked first, on full sets; a pair whose components are linked
    by then needs no check, so a unit gives fewer pairs than it has rows.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            ids, comps = unit.column("rep").to_numpy(), unit.column("comp").to_numpy()
            full = [np.frombuffer(x, np.uint64) for x in unit.column("full").to_pylist()]
            above = {int(c): int(c) for c in comps}

            def root(c: int) -> int:
                while above[c] != c:
                    above[c] = above[above[c]]
                    c = above[c]
                return c

            first, second, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for i, rows, shares in _likely(unit, share):
                first.append(np.full(len(rows), i))
                second.append(rows)
                score.append(shares)
            first, second, score = map(np.concatenate, (first, second, score))
            pairs = []
            for k in np.lexsort((second, first, -score)):
                i, j = first[k], second[k]
                a, b = root(int(comps[i])), root(int(comps[j]))
                if a != b and similar(full[i], full[j], percent):
                    above[max(a, b)] = min(a, b)
                    pairs.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
            yield pa.record_batch([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    return units.mapInArrow(of, "u long, v long")


def among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is in the staged ``ids``; those are broadcast up to a size."""
    ids = ids.select(column).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, column, "left_semi")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: a row for each row of ``docs``.

    A document's set holds its distinct shingles of ``size`` words (``[^\\x20\\x09-\\x0D]+``,
    A-Z lower-cased). Documents are linked where 100 * intersection >= percent * union.
    ``component_id`` is the smallest doc_id reachable; the document that has it is kept.

    1. One pass makes 128 universal hash minima of each set. Documents with equal sets are
       one class from here on, shown by its smallest doc_id.
    2. Each class goes to 32 buckets, one for each band of four minima.
    3. In each bucket the member that shares the most buckets is the centre. Pairs of centre
       and member are checked by signature, then on full sets; components follow by
       alternating large-star and small-star. Buckets that still span several components
       take another round, with a centre from the rest.
    4. Whatever then spans several components is compared in blocks, every member outside
       the bucket's main component against every member of another one: first by signature,
       then, for the members that are left, on full sets, the likeliest pairs first and only
       until their components are linked. So no link between two components is missed, and
       no step writes a row for each two members of a group.

    Null doc_id: component null, kept, linked with nothing. Null or empty text, or no word:
    n_shingles 0, a component of its own. Rows that repeat a doc_id are one node: the links
    of each count for both, and both get the same answer. An empty table gives no rows.
    Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    share = percent / 100 - MARGIN
    signed = staged(signatures(docs, size), "signed")
    files = files_for(signed.count(), FILE_DOCS)
    known = signed.filter("digest is not null and doc_id is not null")
    classes = staged(
        known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")),
        "classes",
        files,
    )
    sigs = classes.select("rep", "sig", "n")
    bands = classes.select(
        "rep",
        F.expr(f"explode(transform(sequence(0, {BANDS - 1}), b -> struct(b as band, xxhash64(b, substring(sig, b * {4 * ROWS} + 1, {4 * ROWS})) as key)))").alias("x"),
    ).select("rep", "x.band", "x.key")
    buckets = staged(
        bands.groupBy("key").agg(F.count("*").alias("n_members"), F.min("rep").alias("a"), F.max("rep").alias("b")).filter("n_members > 1"),
        "buckets",
        files,
    )
    large = buckets.filter("n_members > 2").select("key", "n_members")
    members = staged(bands.join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, "key"), "members", files)
    degrees = staged(members.groupBy("rep").agg(F.sum(F.col("n_members") - 1).alias("degree")), "degrees", files)
    members = staged(members.join(degrees, "rep"), "members", files)

    def by_signature(pairs: DataFrame) -> DataFrame:
        two = staged(pairs.filter("u != v").distinct(), "pairs", files)
        own = staged(among(sigs, both_ends(two), "rep"), "sigs", files)
        two = two.join(own.toDF("u", "su", "nu"), "u").join(own.toDF("v", "sv", "nv"), "v")
        two = two.filter(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
        return similar_signatures(two.select("u", "v", "su", "sv").coalesce(files), share)

    def both_ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("u").alias("rep")).union(pairs.select("v"))

    def sets_of(reps: DataFrame) -> DataFrame:
        """Full sets of these documents only."""
        texts = among(docs.withColumnRenamed("doc_id", "rep"), reps, "rep")
        return staged(full_sets(texts.withColumnRenamed("rep", "doc_id"), size), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of distinct pairs whose full sets are similar."""
        pairs = staged(pairs, "pairs")
        sets = sets_of(both_ends(pairs))
        two = pairs.join(sets.toDF("u", "fu"), "u").join(sets.toDF("v", "fv"), "v")
        return staged(similar_sets(two.select("u", "v", "fu", "fv").coalesce(files), percent), "links")

    def centre_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(
            F.max_by("rep", F.col("degree") * 4096 + F.pmod(F.xxhash64("rep"), F.lit(4096))).alias("centre")
        )

    def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
        named = found.toDF("rep", "comp")
        return rows.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    stars = members.join(centre_of(members), "key").select(F.col("centre").alias("u"), F.col("rep").alias("v"))
    twos = buckets.filter("n_members = 2").select(F.col("a").alias("u"), F.col("b").alias("v"))
    ordered = lambda p: p.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = confirmed(by_signature(ordered(stars.unionByName(twos))))
    # ids whose rows have different texts hold their classes together
    differing = known.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high"))
    differing = staged(differing.filter("n > 1 and low != high").select("doc_id"), "differing", files)
    if not differing.isEmpty():
        reps = staged(among(known.select("doc_id", "digest"), differing, "doc_id").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep"), "reps", files)
        several = reps.groupBy("doc_id").agg(F.min("rep").alias("u"))
        links = links.unionByName(staged(reps.join(several, "doc_id").select("u", F.col("rep").alias("v")).filter("u != v"), "links", files))
    found = components(links, files=files)

    for step in range(STAR_ROUNDS + 1):
        now = labelled(members, found)
        spread = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("key")
        rest = staged(now.join(spread, "key"), "rest", files)
        if rest.isEmpty():
            break
        sizes = rest.groupBy("key", "comp").agg(F.count("*").alias("size"))
        main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"))
        rest = rest.join(main, "key")
        outer = rest.filter("comp != main")
        if step < STAR_ROUNDS:
            centres = outer.groupBy("key").agg(
                F.max_by("rep", F.struct("degree", F.xxhash64("rep", F.lit(step)))).alias("centre"),
                F.max_by("comp", F.struct("degree", F.xxhash64("rep", F.lit(step)))).alias("own"),
            )
            pairs = rest.join(centres, "key").filter("comp != own")
            pairs = by_signature(ordered(pairs.select(F.col("centre").alias("u"), F.col("rep").alias("v"))))
        else:
            counts = rest.groupBy("key").agg(
                F.ceil(F.count("*") / MEMBER_BLOCK).alias("n_mb"),
                F.ceil(F.expr("count_if(comp != main)") / QUERY_BLOCK).alias("n_qb"),
            )
            own = staged(among(sigs.select("rep", "sig"), rest, "rep"), "sigs", files)
            rest = rest.join(counts, "key").join(own, "rep")
            block = F.xxhash64("rep")
            asked = rest.filter("comp != main").select(
                "key", F.pmod(block, "n_qb").alias("qb"), F.explode(F.expr("sequence(0L, n_mb - 1)")).alias("mb"),
                F.lit(True).alias("query"), "rep", "comp", "band", "sig",
            )
            against = rest.select(
                "key", F.explode(F.expr("sequence(0L, n_qb - 1)")).alias("qb"), F.pmod(block, "n_mb").alias("mb"),
                F.lit(False).alias("query"), "rep", "comp", "band", "sig",
            )
            dealt = lambda d: d.repartition("key", "qb", "mb").sortWithinPartitions("key", "qb", "mb")
            part = staged(taking_part(dealt(asked.unionByName(against)), share), "part")
            sets = sets_of(part.select("rep")).toDF("rep", "full")
            more = staged(unit_links(dealt(part.join(sets, "rep")), share, percent), "links")
        if step < STAR_ROUNDS:
            more = confirmed(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(found.toDF("u", "v").unionByName(more), files=files)

    named = labelled(classes.select("digest", "rep"), found).select("digest", F.col("comp").alias("component"))
    return signed.join(named, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull() & F.col("component").isNotNull(), F.col("doc_id") == F.col("component"))
        .otherwise(True)
        .alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that aren't kept."""
    gone = near_duplicates(docs, size, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, also among rows without an id of their own.

    Where every row has its own doc_id, these are the rows that ``near_duplicates`` keeps.
    Otherwise each row is a node by itself, known by a number. The row with the smallest
    doc_id of a group stays, a null one last. Rows without a word all stay.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter("doc_id is null or n > 1").isEmpty():
        return without_near_duplicates(docs, size, percent)
    rows = staged(docs.withColumn("own row", F.monotonically_increasing_id()), "rows")
    nodes = rows.select(F.col("own row").alias("doc_id"), "text")
    found = near_duplicates(nodes, size, percent).select(F.col("doc_id").alias("own row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "own row")
    named = found.join(rows.select("own row", order.alias("order")), "own row")
    first = named.groupBy("component_id").agg(F.min("order").alias("order")).select(F.col("order.own row"))
    return rows.join(first, "own row", "left_semi").select(*docs.columns)
