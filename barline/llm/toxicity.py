"""Toxicity by class-conditional Kneser-Ney models of words in the context of the word before.

Counts n are of documents of a class that hold a word, or a word after another; q(w), shared by both classes, is in
proportion to the number of different words before w in either. With d = max(n - D, 0), N the sum of n and B the share
of it that D takes away, for the classes c = 0 (ordinary) and 1 (toxic)

    p_c(w)     = d_c(w) / N_c + B_c q(w)                           but p_1(w) = B_1 p_0(w) if toxic texts don't hold w
    p_c(w | h) = (1 - B(h)) d_c(h, w) / S_c(h) + B(h) p_c(w)       S_c(h): sum of d_c; B(h): over both classes

so rare expressions back off to shared counts and decide little. A toxic text is taken for ordinary text with a share
`SHARE` of words from the toxic model: each word adds log(1 - SHARE + SHARE p_1 / p_0) to the difference of the two
log-likelihoods. That difference, normalised by length, and a threshold that a calibration finds for it are the score.
The norm is n ** `NORM`. A pair that toxic
texts don't hold falls back to its word, and a word that they don't hold has the one value log(1 - SHARE + SHARE B_1).

So the evidence is a table of the expressions in toxic texts, which grows with the corpus. It stays in Spark but for
two broadcasts of fixed size: the values of the `HOT` most frequent expressions, and a bitmap that tells which others
may be in the table. Those go to the table by an equi join; as the frequent ones never do, no key of it is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import cut, held, held_out, slices, small

DISCOUNT, PAIR_DISCOUNT, SHARE, NORM, RECALL = 0.75, 4.0, 0.001, 1.0, 2
HOT, PLACES = 1 << 18, (1 << 24) - 3
CALIBRATION_ROWS, CALIBRATION_FOLD, LABELS_AT_ONCE, CACHE, WORDS_AT_ONCE = 20_000, 4, 2_000_000, 300_000, 400_000
START, ALONE, MIX = np.int64(1), 0, np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """63-bit hashes of the letters of chunks; -1 for chunks without."""

    def __missing__(self, chunk: str) -> int:
        word = chunk.lower()
        if not word.isalpha():
            word = "".join([c for c in word if c.isalpha()])
        out = self[chunk] = (xxhash.xxh64_intdigest(word) >> 1 | 2) if word else -1
        return out

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        own = np.array([self[c] for c in (text or "").split()], dtype=np.int64)
        return own[own >= 0]


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of words in their contexts, negative where those of words are positive."""
    x = before.astype(np.uint64) * MIX
    x = ((x ^ x >> np.uint64(29)) + words.astype(np.uint64)) * MIX
    return ((x ^ x >> np.uint64(32)) | np.uint64(1 << 63)).view(np.int64)


def contexts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' words in a row: number of the text, the word before, and the word."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    words = np.concatenate(docs) if docs else np.empty(0, np.int64)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return np.repeat(np.arange(len(docs)), sizes), before, words


def _parts(texts: list, hashes: Hashes):
    """The words of some texts at a time, with the number of the first of them."""
    docs, waiting, first = [], 0, 0
    for k, text in enumerate(texts):
        docs.append(hashes.of(text))
        waiting += len(docs[-1])
        if waiting > WORDS_AT_ONCE or k == len(texts) - 1:
            yield first, docs
            docs, waiting, first = [], 0, k + 1


def _count_batches(batches):
    """(h, w, n0, n1): documents of each class with w after h, and with w at all (h = ALONE)."""
    held("toxicity", "", dict)
    hashes = Hashes()
    for batch in slices(batches):
        toxic = batch.column(0).to_numpy()
        for first, docs in _parts(batch.column(1).to_pylist(), hashes):
            of, before, words = contexts(docs)
            of, before, words = np.concatenate((of, of)), np.concatenate((before, np.full(len(words), ALONE))), np.concatenate((words, words))
            key = pair_keys(before, words)
            _, once = np.unique(key ^ (of.astype(np.uint64) * MIX).view(np.int64), return_index=True)
            of, before, words, key = of[once], before[once], words[once], key[once]
            _, at, back = np.unique(key, return_index=True, return_inverse=True)
            n1 = np.bincount(back, weights=toxic[first + of], minlength=len(at)).astype(np.int32)
            n = np.bincount(back, minlength=len(at)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (before[at], words[at], n - n1, n1)], names=["h", "w", "n0", "n1"])


def evidence(counts: DataFrame, discount: float = DISCOUNT, pair_discount: float = PAIR_DISCOUNT, share: float = SHARE) -> tuple[DataFrame, float]:
    """(key, r, n) of the expressions of toxic texts from counts(h, w, n0, n1), and the value of all other words."""

    def kept(c: str, d: float):
        return F.greatest(F.col(c) - d, F.lit(0.0))

    # words and contexts (by a alone) and the pairs that toxic texts hold (a, b) in one pass over the counts, which stay where they are
    names = ("n0", "n1", "t", "s0", "s1", "total")

    def row(first: str, second, **x):
        return F.struct(F.col(first).alias("a"), second.cast("long").alias("b"), *[x.get(c, F.lit(0)).cast("double").alias(c) for c in names])

    nothing, n0, n1 = F.lit(0), F.col("n0"), F.col("n1")
    pair = [row("w", nothing, t=F.lit(1)), row("h", nothing, s0=kept("n0", pair_discount), s1=kept("n1", pair_discount), total=n0 + n1)]
    held_too = F.array(*pair, row("h", F.col("w"), n0=n0, n1=n1))
    rows = F.when(F.col("h") == ALONE, F.array(row("w", nothing, n0=n0, n1=n1))).when(n1 > pair_discount, held_too).otherwise(F.array(*pair))
    flat = cut(counts.select(F.explode(rows).alias("x")).select("x.*").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names]))
    words = flat.where("b = 0 and n0 + n1 > 0").select(F.col("a").alias("w"), "n0", "n1", "t")
    around = flat.where("b = 0 and total > 0").select(F.col("a").alias("h"), "s0", "s1", (1 - (F.col("s0") + F.col("s1")) / F.col("total")).alias("back"))
    pairs = flat.where("b <> 0").select(F.col("a").alias("h"), F.col("b").alias("w"), "n0", "n1")
    whole = words.agg(F.sum(kept("n0", discount)), F.sum(kept("n1", discount)), F.sum("n0"), F.sum("n1"), F.sum("t")).first()
    s0, s1, all0, all1, t = (float(x or 0) for x in whole)
    back0, back1 = (1 - s / n if n else 1.0 for s, n in ((s0, all0), (s1, all1)))
    base = float(np.log(1 - share + share * back1))
    if not s1:
        return words.select(F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("r"), F.lit(0).cast("long").alias("n")).limit(0), base

    def value(p1, p0):
        return F.log(1 - share + share * p1 / p0)

    q = F.col("t") / t
    own = words.where("n1 > 0").withColumn("p0", kept("n0", discount) / max(all0, 1.0) + back0 * q).withColumn("p1", kept("n1", discount) / all1 + back1 * q)
    own = cut(own.select("w", "p0", "p1", (F.col("n0") + F.col("n1")).cast("long").alias("n")))
    placed = pairs.join(around.where("s1 > 0"), "h").join(own.select("w", "p0", "p1"), "w")
    a0, a1 = F.when(F.col("s0") > 0, kept("n0", pair_discount) / F.col("s0")).otherwise(F.col("p0")), kept("n1", pair_discount) / F.col("s1")
    q0, q1 = (1 - F.col("back")) * a0 + F.col("back") * F.col("p0"), (1 - F.col("back")) * a1 + F.col("back") * F.col("p1")
    placed = placed.select("h", "w", value(q1, q0).alias("r"), (F.col("n0") + F.col("n1")).cast("long").alias("n")).mapInArrow(_key_batches, "key long, r double, n long")
    return cut(own.select(F.col("w").alias("key"), value(F.col("p1"), F.col("p0")).alias("r"), "n").unionByName(placed)), base


def _key_batches(batches):
    for batch in batches:
        keys = pair_keys(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(2), batch.column(3)], names=["key", "r", "n"])


class Table:
    """The parts of an evidence table that every worker has, both of bounded size."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: np.ndarray, base: float):
        self.keys, self.values, self.bits, self.base = keys, values, bits, base

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of keys (nan: not among the frequent ones), and whether the rest may have them."""
        out = np.full(len(keys), np.nan)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            out[found] = self.values[at[found]]
        place = keys % PLACES
        return out, np.isnan(out) & (self.bits[place >> 5] >> (place & 31) & 1).astype(bool)


class Model:
    """The evidence table (Spark keeps all but the frequent part), the rate of label 1 and the calibration."""

    def __init__(self, table: Table, rest: DataFrame, rate: float):
        self.table, self.rest, self.rate, self.line = table, rest, rate, None

    def calibrate(self, values: np.ndarray, toxic: np.ndarray) -> None:
        """The threshold of best F measure (recall counts `RECALL` times) on rows' differences, and the logistic slope of greatest likelihood around it."""
        if len(set(toxic.tolist())) < 2:
            return
        order = np.argsort(-values, kind="stable")
        v, hits = values[order], np.cumsum(toxic[order])
        f = hits / (np.arange(1, len(v) + 1) + RECALL * toxic.sum())
        f[:-1][v[:-1] == v[1:]] = -1
        best = int(f.argmax())
        edge = (v[best] + v[min(best + 1, len(v) - 1)]) / 2
        spread = values.std() + 1e-12
        x, sign = (values - edge) / spread, 2 * toxic - 1
        slopes = 2.0 ** np.arange(-2, 7)
        slope = slopes[np.argmin([np.logaddexp(0, -a * sign * x).sum() for a in slopes])]
        self.line = edge, slope / spread


def scores(values: np.ndarray, rate: float, line: tuple | None) -> np.ndarray:
    """Probabilities of label 1 by differences; nan (no words) has the rate of label 1, and so has all without a line."""
    if line is None:
        return np.full(len(values), rate)
    p = 1 / (1 + np.exp(-np.clip((values - line[0]) * line[1], -30, 30)))
    return np.where(np.isnan(values), rate, p)


_WAITING = pa.list_(pa.struct([("pair", pa.int64()), ("word", pa.int64()), ("own", pa.float64())]))


def _sum_batches(shared):
    """Instead of the text, the last column: what the shared table gives it, its number of words, and the words that wait.

    A word that waits for the rest of the table has its pair's key, its own (each 0 if it can't be there) and its value
    if neither is.
    """

    def run(batches):
        held("toxicity", "", dict)
        table, hashes = shared.value, Hashes()
        for batch in slices(batches):
            n = batch.num_rows
            sums, sizes, waiting = np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
            for first, docs in _parts(batch.column(batch.num_columns - 1).to_pylist(), hashes):
                of, before, words = contexts(docs)
                of += first
                single, back = np.unique(words, return_inverse=True)
                value, later = (x[back] for x in table.look_up(single))
                keys = pair_keys(before, words)
                both, both_later = table.look_up(keys)
                own = np.where(np.isnan(value), table.base, value)
                wait = both_later | np.isnan(both) & later
                sums += np.bincount(of, weights=np.where(wait, 0.0, np.where(np.isnan(both), own, both)), minlength=n)
                sizes += np.bincount(of, minlength=n)
                for i in np.flatnonzero(wait):
                    waiting[of[i]].append({"pair": int(keys[i]) if both_later[i] else 0, "word": int(words[i]) if later[i] else 0, "own": float(own[i])})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums), pa.array(sizes), pa.array(waiting, _WAITING)], names=[*batch.schema.names[:-1], "total", "n", "waiting"])

    return run


def differences(rows: DataFrame, model: Model) -> DataFrame:
    """rows(..., text) with `difference`, the sum over the text's n words by n ** NORM (null without words), for the text."""
    shared = rows.sparkSession.sparkContext.broadcast(model.table)
    others = rows.columns[:-1]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    done = rows.mapInArrow(_sum_batches(shared), f"{kinds}, total double, n long, waiting array<struct<pair:long,word:long,own:double>>")
    done = cut(done.withColumn("row", F.monotonically_increasing_id()))
    late = done.select("row", F.explode("waiting").alias("x")).groupBy("row", "x.pair", "x.word", "x.own").agg(F.count("*").alias("times"))
    by_pair, by_word = (model.rest.select(F.col("key").alias(k), F.col("r").alias(f"{k}_r")) for k in ("pair", "word"))
    late = late.join(by_pair, "pair", "left").join(by_word, "word", "left")
    late = late.groupBy("row").agg(F.sum(F.col("times") * F.coalesce("pair_r", "word_r", "own")).alias("more"))
    normal = (F.col("total") + F.coalesce("more", F.lit(0.0))) / F.pow(F.nullif(F.col("n"), F.lit(0)), F.lit(NORM))
    return done.drop("waiting").join(late, "row", "left").select(*others, normal.alias("difference"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibration_rows: int = CALIBRATION_ROWS, hot: int = HOT) -> Model:
    """A model from the labelled rows that aren't held out: rows drawn from a fold calibrate, all others are counted.

    Labels other than 0 and 1 and null texts aren't learned from. Labels are broadcast if a count shows that they
    are few, else joined by shuffle. Without both labels the score is the rate of label 1 (0.5 if there is none).
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).distinct()
    rows = docs.where(~held_out(id_col) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(small(marks, LABELS_AT_ONCE), "id").withColumn("fold", F.crc32(F.col("id").cast("string")) % 5)
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    size = sum(sizes.values())
    share = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, 5 * calibration_rows / max(size, 1))))
    drawn = (F.col("fold") == CALIBRATION_FOLD) & share
    counts = rows.where(~drawn).select("toxic", "text").mapInArrow(_count_batches, "h long, w long, n0 int, n1 int")
    found, base = evidence(counts.groupBy("h", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    often = found.orderBy(F.desc("n"), "key").limit(hot).select("key", "r").orderBy("key").toArrow()
    keys, values = (often.column(i).to_numpy() for i in range(2))
    bits = np.zeros((PLACES >> 5) + 1, np.uint32)
    rest = cut(found.join(F.broadcast(spark.createDataFrame(often.select(["key"]))), "key", "left_anti").select("key", "r"))
    place = f"pmod(key, {PLACES}L)"
    for at, own in rest.groupBy(F.expr(f"cast(shiftright({place}, 5) as int)")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 31 as int)))")).toLocalIterator():
        bits[at] = own
    model = Model(Table(keys, values, bits, base), rest, sizes.get(1, 0) / size if size else 0.5)
    seen = differences(rows.where(drawn).select("toxic", "text"), model).where("difference is not null").toPandas()
    model.calibrate(seen["difference"].to_numpy(dtype=float), seen["toxic"].to_numpy(dtype=float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs; null texts and texts without letters have the rate of label 1."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return differences(rows, model).mapInArrow(_score_batches(model.rate, model.line), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def _score_batches(rate: float, line: tuple | None):
    def run(batches):
        for batch in batches:
            p = scores(batch.column(2).to_numpy(zero_copy_only=False), rate, line)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return run
