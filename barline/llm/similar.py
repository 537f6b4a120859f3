"""Near-duplicates by the Jaccard similarity of word shingles, exactly.

Texts are sets of XXH64 values of five-word shingles; two are near-duplicates if they share at least `PERCENT` percent
of their union. SimHash comes first: the majority fingerprints of the sets meet in the buckets of `simhash`, where the
pivot table and the popcount leave a forest of the links of at most four bits. Fingerprints miss most pairs of 0.8 to
0.95, so prefix filtering finds every pair that is left: with all shingles in one order, the first
n - ceil(0.8 n) + 1 of two similar sets have one in common. The order puts long shingles first and those that are frequent
in a sample last. Those that then begin more than CROWDED sets go last too, and the sets that they begin are ordered again.
Any order gives the same result, but a passage in a fixed share of the texts makes pairs that grow with the square of the
table where it stays in front. Candidates are compared by their sizes and places, then by sketches of a bit or two a shingle:
the bits in which two differ are at most the shingles that only one of the sets has. What is left is verified on the whole sets.

The pairs of fingerprints and the neighbours in a bucket are verified first and their links contracted; then every
candidate pair that no link connects yet is verified, so large classes of copies don't list all their pairs.

Only ids, hashes and prefixes are materialised. The texts of candidate pairs are read from the input again, by the
hash of a text; a bitmap of fixed size keeps most others from being shuffled. Where it fills up it only saves less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import chain, cut, dealt_join, fresh, held, one_of_each, raw, slices, trim
from barline.llm.components import components
from barline.llm.simhash import RADIUS, _shingle_hashes, links, majority

SHINGLE, PERCENT = 5, 80
SAMPLE, FREQUENT, MAX_FREQUENT, PAIRS_AT_ONCE, HASHES_AT_ONCE, PLACES = 10_000, 3, 1 << 18, 50_000, 200_000, (1 << 24) - 3
CROWDED, MAX_CROWDED = 8, 1 << 20


def _distinct(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(np.array(_shingle_hashes(text, shingle), dtype=np.uint64))


def _distinct_by_length(text: bytes | None, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, and their places in the order of length, longest first, then of hash."""
    own, at = np.unique(np.array(_shingle_hashes(text, shingle), dtype=np.uint64), return_index=True)
    ends = np.cumsum([0, *map(len, (text or b"").split())])
    lengths = ends[shingle:] - ends[:-shingle] if len(ends) > shingle else ends[-1:]
    return own, np.argsort(-lengths[at], kind="stable")


def _sample_batches(shingle: int):
    def run(batches):
        held("similar", "", dict)
        for batch in slices(batches):
            own = [_distinct(t, shingle) for t in raw(batch, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["h"])

    return run


def frequent(rows: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that several rows of a sample of rows(id, text) have; at most MAX_FREQUENT."""
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(n, 1)))
    found = rows.where(draw).select("text").mapInArrow(_sample_batches(shingle), "h long").groupBy("h").count()
    found = found.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).select("h").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The majority fingerprint of each set of hashes."""
    return majority(np.concatenate([*sets, np.empty(0, np.uint64)]), np.array([len(x) for x in sets], np.int64))


def ordered_prefix(text: bytes | None, late: np.ndarray, shingle: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of a text and the first of them, in the order that has those of late, sorted, last."""
    own, order = _distinct_by_length(text, shingle)
    n, ordered = len(own), own[order]
    if len(late) and n:
        last = _among(ordered, late)
        ordered = np.concatenate((ordered[~last], ordered[last]))
    return own, ordered[: n + (-n * percent // 100) + 1 if n else 0].view(np.int64)


def sketch(own: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of the hashes are i modulo the number of bits, a power of two from 64 and len(own) on."""
    size = max(64, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(n: int, a: bytes, m: int, b: bytes, percent: int) -> bool:
    """False only if sets of n and m hashes with sketches a and b share less than percent of their union."""
    size = min(len(a), len(b))
    x = y = 0
    for at in range(0, len(a), size):
        x ^= int.from_bytes(a[at : at + size], "little")
    for at in range(0, len(b), size):
        y ^= int.from_bytes(b[at : at + size], "little")
    return (x ^ y).bit_count() <= n + m - 2 * -(-percent * (n + m) // (100 + percent))


def _sketch_batches(percent: int):
    """The pairs (a, b) of rows (a, b, n_a, sketch_a, n_b, sketch_b) whose sketches leave them."""

    def run(batches):
        for batch in batches:
            good = [may_be_similar(*x, percent) for x in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _lists(prefixes: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)])))


def _prefix_batches(shared, shingle: int, percent: int):
    def run(batches):
        held("similar", "", dict)
        often = shared.value
        for batch in slices(batches):
            digests, sizes, prefixes, sketches, prints, kept, held_back = [], [], [], [], [], [], 0
            for text in raw(batch, 2):
                own, prefix = ordered_prefix(text, often, shingle, percent)
                digests.append(xxhash.xxh64_intdigest(own.tobytes()))
                sizes.append(len(own))
                kept.append(own)
                held_back += len(own)
                if held_back > HASHES_AT_ONCE:
                    prints.append(fingerprints(kept))
                    kept, held_back = [], 0
                prefixes.append(prefix)
                sketches.append(sketch(own))
            prints.append(fingerprints(kept))
            cols = [batch.column(0), batch.column(1), pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.concatenate(prints).view(np.int64)), pa.array(sketches, pa.binary()), _lists(prefixes)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "code", "digest", "n", "fp", "sketch", "prefix"])

    return run


def crowded(sets: DataFrame, limit: int) -> np.ndarray:
    """Sorted hashes in the prefixes of more than limit of sets(prefix); the most frequent MAX_CROWDED, if there are more."""
    found = sets.select(F.explode("prefix").alias("h")).groupBy("h").count().where(F.col("count") > limit)
    found = found.orderBy(F.desc("count"), "h").limit(MAX_CROWDED).select("h").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _crowd_batches(shared, inside: bool):
    """The rows (node, n, prefix) whose prefix has a hash of the crowd, or those whose prefix has none."""

    def run(batches):
        held("similar", "", dict)
        crowd = shared.value
        for batch in slices(batches):
            lists = batch.column(2)
            seen = np.concatenate(([0], np.cumsum(_among(lists.flatten().to_numpy().view(np.uint64), crowd))))
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            yield batch.filter(pa.array((seen[ends[1:]] > seen[ends[:-1]]) == inside))

    return run


def _again_batches(shared, shingle: int, percent: int):
    def run(batches):
        late = shared.value
        for batch in slices(batches):
            both = [ordered_prefix(t, late, shingle, percent) for t in raw(batch, 1)]
            cols = [batch.column(0), pa.array([len(own) for own, _ in both], pa.int32()), _lists([prefix for _, prefix in both])]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "n", "prefix"])

    return run


def thinned(sets: DataFrame, rows: DataFrame, often: np.ndarray, shingle: int, percent: int, limit: int | None = None) -> DataFrame:
    """sets(node, n, prefix) with the prefixes of the order that has crowded hashes last, too; rows(code, text) has the texts of all nodes.

    Prefixes without a crowded hash stay as they are, as what moves stands behind them.
    """
    sc, crowd = sets.sparkSession.sparkContext, crowded(sets, limit or CROWDED)
    if not len(crowd):
        return sets
    shared, late, kind = sc.broadcast(crowd), sc.broadcast(np.union1d(often, crowd)), "node long, n int, prefix array<long>"
    hit = cut(sets.mapInArrow(_crowd_batches(shared, True), kind).select("node"))
    steps = chain(_marked_batches(sc.broadcast(bitmap(hit))), _again_batches(late, shingle, percent))
    again = rows.select("code", "text").mapInArrow(steps, kind).join(hit, "node", "left_semi").dropDuplicates(["node"])
    return sets.mapInArrow(_crowd_batches(shared, False), kind).unionByName(again)


def _by_key(batches, use):
    """use() on the columns of all rows of some keys at a time; batches come sorted by key, their first column."""
    held("similar", "", dict)
    kept = None
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        kept = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols)]
        if len(kept[0]) and (at := int(np.searchsorted(kept[0], kept[0][-1]))):
            yield from use(*[c[:at] for c in kept])
            kept = [c[at:] for c in kept]
    if kept is not None and len(kept[0]):
        yield from use(*kept)
    trim()


def _shared_batches(batches):
    """The rows (key, node, n, at) of keys that several nodes have."""

    def use(key, *rest):
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        some = count[back] > 1
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (key, *rest)], names=["key", "node", "n", "at"])

    return _by_key(batches, use)


def candidate_pairs(key, node, n, at, root, percent: int, near: bool):
    """Pairs of nodes of different root within equal keys that may be similar; near: only of neighbours by size."""
    order = np.lexsort((node, n, key))
    key, node, n, at, root = key[order], node[order], n[order].astype(np.int64), at[order].astype(np.int64), root[order]
    live, gap = np.arange(len(key)), 0
    while len(live) and not (near and gap):
        gap += 1
        live = live[live + gap < len(key)]
        live = live[(key[live] == key[live + gap]) & (n[live] * 100 >= percent * n[live + gap])]
        i = live[root[live] != root[live + gap]]
        j = i + gap
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        fit = np.minimum(n[i] - at[i], n[j] - at[j]) >= need
        if fit.any():
            yield node[i[fit]], node[j[fit]]


def _pair_batches(percent: int, near: bool):
    def use(*cols):
        a, b, held_back = [], [], 0
        for x, y in candidate_pairs(*cols, percent, near):
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
            held_back += len(x)
            if held_back > PAIRS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])
                a, b, held_back = [], [], 0
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])

    return lambda batches: _by_key(batches, use)


def _verify_batches(shingle: int, percent: int):
    def run(batches):
        for batch in slices(batches, 500):
            good, last, own = [], None, set()
            for a, x, y in zip(batch.column(0).to_pylist(), raw(batch, 2), raw(batch, 3)):
                if a != last:
                    last, own = a, set(_shingle_hashes(x, shingle))
                other = set(_shingle_hashes(y, shingle))
                both = len(own & other)
                good.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def fingerprint_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of nodes(node, fp) that connect all whose fingerprints are equal or, over any steps, radius bits apart.

    Of equal fingerprints the smallest node is paired with each other one, and stands for all in the forests of links.
    """
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("count")))
    equal = dealt_join(nodes, first, ["fp"], "node").where("a <> node").select("a", F.col("node").alias("b"))
    apart = links(first.select("fp"), radius).where("a <> b").distinct().withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    ends = [first.select(F.col("fp").alias(f"fp_{c}"), F.col("a").alias(c)) for c in "ab"]
    near = apart.join(ends[0], "fp_a").join(ends[1], "fp_b")
    return equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def bitmap(nodes: DataFrame) -> np.ndarray:
    """A bit for each of PLACES remainders, set where a node has it: at most 2 MB, whatever the number of nodes."""
    bits, place = np.zeros((PLACES >> 5) + 1, np.uint32), f"pmod(node, {PLACES}L)"
    words = nodes.groupBy(F.expr(f"cast(shiftright({place}, 5) as int)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 31 as int)))").alias("own")).toArrow()
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
    return bits


def _marked_batches(shared):
    """The rows (code, text) whose code the bitmap may hold."""

    def run(batches):
        bits = shared.value
        for batch in slices(batches):
            place = batch.column(0).to_numpy() % PLACES
            yield pa.RecordBatch.from_arrays(batch.columns, names=["node", "text"]).filter(pa.array((bits[place >> 5] >> (place & 31) & 1).astype(bool)))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, component_id) for each row of docs: component_id is the smallest id that links of similar texts reach.

    Texts of fewer words than a shingle are one shingle; null and empty texts are one class.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("code"), F.col(text_col).alias("text"))
    kind, sc = rows.schema["id"].dataType.simpleString(), docs.sparkSession.sparkContext
    often = frequent(rows, shingle)
    own = cut(rows.mapInArrow(_prefix_batches(sc.broadcast(often), shingle, percent), f"id {kind}, code long, digest long, n int, fp long, sketch binary, prefix array<long>"))
    # equal sets are one node, told by the hash of one of their texts
    first = [F.first(c).alias(c) for c in ("n", "fp", "sketch", "prefix")]
    sets = cut(own.groupBy("digest").agg(F.min("code").alias("node"), *first).drop("digest"))
    keyed = thinned(sets.select("node", "n", "prefix"), rows, often, shingle, percent).select("node", "n", F.posexplode("prefix").alias("at", "key")).select("key", "node", "n", "at")
    keyed = keyed.repartition("key").sortWithinPartitions("key")
    shared = cut(keyed.mapInArrow(_shared_batches, "key long, node long, n int, at int"))

    nodes = cut(sets.select("node", "fp"))
    own = cut(own.select("id", "code", "digest"))

    def similar(of: DataFrame, near: bool) -> DataFrame:
        spread = of.repartition("key").sortWithinPartitions("key")
        pairs = spread.mapInArrow(_pair_batches(percent, near), "a long, b long")
        pairs = cut((pairs.unionByName(fingerprint_pairs(nodes)) if near else pairs).distinct())
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        known = cut(sets.select("node", "n", "sketch").join(ends, "node", "left_semi"))
        of_a, of_b = (known.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        told = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
        pairs = cut(told.mapInArrow(_sketch_batches(percent), "a long, b long"))
        ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        texts = rows.select("code", "text").mapInArrow(_marked_batches(sc.broadcast(bitmap(ends))), "node long, text string")
        texts = texts.dropDuplicates(["node"]).join(ends, "node", "left_semi")
        first, second = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
        return cut(both.mapInArrow(_verify_batches(shingle, percent), "a long, b long"))

    found = similar(shared.withColumn("root", F.col("node")), True)
    further = shared.join(components(found), "node", "left").select("key", "node", "n", "at", F.coalesce("root", "node").alias("root"))
    found = found.unionByName(similar(further, False))
    classes = own.groupBy("digest").agg(F.min("id").alias("least"), F.min("code").alias("node"), F.count("*").alias("rows"))
    placed = classes.join(components(found), "node", "left")
    placed = cut(placed.select("digest", "least", "rows", F.coalesce("root", "node").alias("root")))
    named = cut(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("count")))
    by_digest = cut(dealt_join(placed, named, ["root"], "digest").select("digest", "component_id", F.col("rows").alias("count")))
    return dealt_join(own.select("id", "digest"), by_digest, ["digest"], "id").select(F.col("id").alias(id_col), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each near-duplicate class: that with the smallest id. Rows of null id stay; of a repeated id the row of the smallest text."""
    (member,) = fresh(docs, "member")
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, **options)
    keep = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(member)).distinct()
    kept = one_of_each(docs.join(keep, F.col(id_col) == F.col(member), "left_semi"), id_col, text_col)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
