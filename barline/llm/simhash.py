"""SimHash near-duplicates, with a pivot distance table in front of the exact comparison.

1. Fingerprint: 64 majority bits of the XXH64 values of word shingles.
2. Distinct fingerprints meet in buckets. 64 bits are six blocks; two fingerprints that differ in at most
   four bits agree wholly on two blocks, so the 15 pairs of blocks bring every link together. Pivots alone can't:
   distances to a reference fingerprint concentrate at 32 +- 4 bits and so hardly split a corpus at radius 4.
3. Inside a bucket rows are sorted by their distance to the first pivot and compared only as far as that distance
   allows (triangle inequality). Pairs whose pivot coordinates differ by more than the radius anywhere are
   discarded; the survivors are verified by the popcount of their difference.
4. A bucket gives a spanning forest of its links, never all pairs; buckets over a limit are dealt to tasks as
   pairs of chunks. Components of the links give the classes.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import cut, dealt_join, fresh, held, one_of_each, raw, slices
from barline.llm.components import components

SHINGLE, RADIUS, SEED, PIVOTS, HOT = 4, 4, 42, 16, 8192
BLOCKS = (11, 11, 11, 11, 10, 10)


def _shingle_hashes(text: bytes | None, shingle: int) -> list[int]:
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: len(ends) - shingle])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each consecutive group of hashes: the bits set in over half of it; 0 for an empty group."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        over = (2 * counts > sizes[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(shingle: int):
    def run(batches):
        held("simhash", "", dict)
        for batch in slices(batches):
            hashes, sizes, done = [], [], []
            for text in raw(batch, 1):
                own = _shingle_hashes(text, shingle)
                hashes += own
                sizes.append(len(own))
                if len(hashes) > 200_000:
                    done.append(majority(np.array(hashes, dtype=np.uint64), np.array(sizes)))
                    hashes, sizes = [], []
            done.append(majority(np.array(hashes, dtype=np.uint64), np.array(sizes, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(done).view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long. Null and empty texts have 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_batches(shingle), f"id {kind}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every run."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)], dtype=np.uint64)


def bucket_forest(keys: np.ndarray, fps: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest of the links within equal keys."""
    first = np.bitwise_count(fps ^ refs[0]).astype(np.int16)
    order = np.lexsort((first, keys))
    keys, fps, first = keys[order], fps[order], first[order]
    table = np.stack([np.bitwise_count(fps ^ p) for p in refs], axis=1).astype(np.int16)
    label, live, gap = np.arange(len(keys)), np.arange(len(keys) - 1), 0
    while len(live):
        gap += 1
        live = live[live + gap < len(keys)]
        live = live[(keys[live] == keys[live + gap]) & (first[live + gap] - first[live] <= radius)]
        i = live[label[live] != label[live + gap]]
        for p in range(1, len(refs)):
            i = i[np.abs(table[i, p] - table[i + gap, p]) <= radius]
        i = i[np.bitwise_count(fps[i] ^ fps[i + gap]) <= radius]
        j = i + gap
        while len(i := i[(apart := label[i] != label[j])]):
            j = j[apart]
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            np.minimum.at(label, high, low)
            while (up := label[label]) is not None and not np.array_equal(up, label):
                label = up
    tied = np.flatnonzero(label != np.arange(len(label)))
    return fps[tied], fps[label[tied]]


def _bucket_batches(radius: int):
    def run(batches):
        refs = pivots()
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(k, f):
            a, b = bucket_forest(k, f, radius, refs)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            if len(keys) and (at := int(np.searchsorted(keys, keys[-1]))):
                yield out(keys[:at], fps[:at])
                keys, fps = keys[at:], fps[at:]
        if len(keys):
            yield out(keys, fps)

    return run


def masks() -> list[int]:
    """Signed masks of the pairs of blocks."""
    edges = [0, *accumulate(BLOCKS)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(len(BLOCKS))]
    return [m - (1 << 64) if m >> 63 else m for m in (block[i] | block[j] for i, j in combinations(range(len(BLOCKS)), 2))]


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(a, b): a spanning forest, for each bucket, of the pairs of fps(fp), distinct, at most radius (up to 4) bits apart."""
    if radius > 4:
        raise ValueError("two of six blocks agree wholly only up to 4 differing bits")
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks())])
    rows = fps.select(F.explode(keys).alias("key"), "fp")
    heavy = cut(rows.groupBy("key").count().where(F.col("count") > hot))
    if not heavy.isEmpty():
        n = F.ceil(F.col("count") / hot).cast("int")
        own = F.pmod(F.xxhash64("fp"), n).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.xxhash64("key", F.least(c, F.col("own")), F.greatest(c, F.col("own"))))
        split = rows.join(heavy, "key").withColumn("own", own).select(F.explode(pairs).alias("key"), "fp")
        rows = rows.join(heavy, "key", "left_anti").unionByName(split)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_batches(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: the id, fingerprint (16 hex digits) and component_id, the smallest id reachable.

    Equal fingerprints are one class; classes link at radius bits. Null and empty texts have fingerprint zero and
    link like any other; rows with a null id belong to their class but never name it (a class of null ids alone
    has a null component_id). Repeated rows give repeated results.
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("count")))
    roots = components(links(classes.select("fp"), radius))
    placed = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "count", F.coalesce("root", "fp").alias("root")))
    named = cut(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("count")))
    by_fp = cut(dealt_join(placed.withColumnRenamed("count", "rows"), named, ["root"], "fp").select("fp", "component_id", F.col("rows").alias("count")))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return dealt_join(own, by_fp, ["fp"], "id").select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each near-duplicate class: that with the smallest id. Rows of null id stay; of a repeated id the row of the smallest text."""
    (member,) = fresh(docs, "member")
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, **options)
    keep = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(member)).distinct()
    kept = one_of_each(docs.join(keep, F.col(id_col) == F.col(member), "left_semi"), id_col, text_col)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
