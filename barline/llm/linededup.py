"""Line deduplication by overlapping three-line windows.

A text is cut in lines: at line ends, after sentence ends, and, where a sentence has more than `LONG` words, after the
word of smallest hash of every `LONG` consecutive words of it. Only the words around a place decide whether a line ends
there, whatever the script, and no line has more than `LONG` words, so a repeated passage of over 4 `LONG` + 2 words has
three whole lines wherever it stands. Every three consecutive lines
are a window. Of a window that several documents have, the smallest id's stays, and inside a document the first;
the positions that all other occurrences cover are merged and removed.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.llm.common import fresh, held, raw, slices

WINDOW, LONG = 3, 12
SALTS, VERSION_BITS, SAMPLE, FREQUENT = 64, 25, 5_000, 10
_END = re.compile(rb"[.!?\n](?:(?<=\n)\s*|[.!?]*\s+)")
_WORD = re.compile(rb"\S+")


def cuts(hashes: list[int]) -> list[int]:
    """Places of the last smallest hash of every LONG consecutive ones, in order."""
    out, least, low = [], -1, -1
    for last, own in enumerate(hashes[LONG - 1 :], LONG - 1):
        if own <= low:
            least, low = last, own
        elif least <= last - LONG:
            low = min(hashes[last - LONG + 1 : last + 1])
            least = last
            while hashes[least] != low:
                least -= 1
        else:
            continue
        out.append(least)
    return out


def lines_of(text: bytes) -> list[bytes]:
    """The lines of a text with what separates them; joined they are the text."""
    out, start = [], 0
    ends = [m.end() for m in _END.finditer(text)]
    ends.append(len(text))
    for end in ends:
        line = text[start:end]
        start = end
        # as many words need at least twice as many bytes
        if len(line) > 2 * LONG and len(words := line.lower().split()) > LONG:
            # 32-bit hashes of words, case and what separates them aside
            at_cuts = cuts(list(map(xxhash.xxh32_intdigest, words)))
            bare = line.lstrip()
            sums = list(accumulate(map(len, words)))
            if len(bare.rstrip()) == sums[-1] + len(words) - 1:  # one byte between words
                lead = len(line) - len(bare) + 1
                stops = [lead + sums[at] + at if at + 1 < len(words) else len(line) for at in at_cuts]
            else:
                places = [m.start() for m in _WORD.finditer(line)] + [len(line)]
                stops = [places[at + 1] for at in at_cuts]
            done = 0
            for stop in stops:
                out.append(line[done:stop])
                done = stop
            if done < len(line):
                out.append(line[done:])
        elif line:
            out.append(line)
    return out


def windows_of(texts: list[bytes], window: int = WINDOW, min_words: int = 1) -> tuple[np.ndarray, ...]:
    """Of each window of at least min_words words: text, place, hash and place of the same window's first line before.

    The last is -1 for the first such window of a text. Case and the white space between lines don't count.
    """
    hashes, words, counts = [], [], []
    for text in texts:
        lines = list(map(bytes.strip, lines_of(text.lower())))
        hashes += map(xxhash.xxh64_intdigest, lines)
        if min_words > 1:
            words += [x.count(b" ") + 1 for x in lines]
        counts.append(len(lines))
    h, of = np.array(hashes, dtype=np.uint64), np.repeat(np.arange(len(texts)), counts)
    n = np.array(words, dtype=np.int64) if min_words > 1 else np.ones(len(h), dtype=np.int64)
    size = max(0, len(h) - window + 1)
    key, total = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
    for i in range(window):
        key = (key ^ h[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        total += n[i : i + size]
    at = np.flatnonzero((total >= min_words) & (of[:size] == of[window - 1 :][:size]))
    text, key, place = of[at], key[at], at - np.searchsorted(of, of[at])
    order = np.lexsort((place, key, text))
    text, key, place = text[order], key[order], place[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    first = place[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] if len(at) else place
    return text, place, key.view(np.int64), np.where(new, -1, first)


def _sample_batches(window: int, min_words: int):
    def run(batches):
        held("linededup", "", dict)
        for batch in slices(batches):
            _, _, key, first = windows_of([t or b"" for t in raw(batch, 0)], window, min_words)
            yield pa.RecordBatch.from_arrays([pa.array(key[first < 0])], names=["h"])

    return run


def frequent(rows: DataFrame, window: int, min_words: int) -> np.ndarray:
    """Sorted hashes of windows that at least `FREQUENT` texts of a sample of about `SAMPLE` rows have: SAMPLE / FREQUENT
    times the windows of a text at most. It decides which are dealt out, never what is removed."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id", "text"), F.lit(1 << 20)) < int((1 << 20) * share)).select("text")
    found = drawn.mapInArrow(_sample_batches(window, min_words), "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    return np.sort(found.select("h").toArrow().column(0).to_numpy())


def _window_batches(window: int, min_words: int, often):
    """h, id, the text's version, the covered span's start and length and whether the text had the window before, and salt.

    The salt is -1 but for frequent windows.
    """

    def run(batches):
        held("linededup", "", dict)
        hot = often.value
        for batch in slices(batches):
            text, place, key, first = windows_of([t or b"" for t in raw(batch, 2)], window, min_words)
            version = batch.column(1).to_numpy()[text].astype(np.int64) & (1 << VERSION_BITS) - 1
            start = np.where(first < 0, place, np.maximum(place, first + window))
            some = start < place + window
            packed = (version << 39 | start << 8 | (place + window - start) << 1 | (first >= 0))[some]
            key, text = key[some], text[some]
            salt = np.full(len(key), -1, np.int8)
            if len(hot):
                salted = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                salt[salted] = (text[salted] * 0x9E37 + version[some][salted]) % SALTS
            cols = [pa.array(key), batch.column(0).take(pa.array(text)), pa.array(packed), pa.array(salt)]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "id", "packed", "salt"])

    return run


def merged(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the spans of each row's list without overlaps, in order; spans that touch are one."""
    row = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    s, e = (flat.field(k).to_numpy().astype(np.int64) + (row << 32) for k in ("s", "e"))
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1]))) if len(s) else np.empty(0, np.int64)
    last = np.concatenate((new[1:], [len(s)])) - 1 if len(s) else new
    low = (1 << 32) - 1
    return s[new] >> 32, s[new] & low, e[last] & low


def _remove_batches(at: int, counted: bool):
    """Without the covered lines of column at; the last column has the spans. counted: with the number of lines removed."""

    def run(batches):
        for batch in slices(batches):
            row, starts, ends = merged(batch.column(batch.num_columns - 1))
            text, n_removed = batch.column(at), np.zeros(batch.num_rows, np.int64)
            if len(row):
                np.add.at(n_removed, row, ends - starts)
                cut, first = np.unique(row, return_index=True)
                bounds, starts, ends = [*first.tolist(), len(row)], starts.tolist(), ends.tolist()
                kept = []
                for k, whole in enumerate(text.take(pa.array(cut)).cast(pa.binary()).to_pylist()):
                    lines, done, out = lines_of(whole), 0, []
                    for i in range(bounds[k], bounds[k + 1]):
                        out += lines[done : starts[i]]
                        done = ends[i]
                    kept.append(b"".join([*out, *lines[done:]]).rstrip())
                here = np.zeros(batch.num_rows, dtype=bool)
                here[cut] = True
                text = pc.replace_with_mask(text, pa.array(here), pa.array(kept, pa.binary()).cast(text.type))
            cols = [text if i == at else c for i, c in enumerate(batch.columns[:-1])]
            names = batch.schema.names[:-1]
            if counted:
                cols, names = [*cols, pa.array(n_removed)], [*names, "n_removed"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_words: int = 1, counted: bool = False) -> DataFrame:
    """docs with later occurrences of repeated windows cut out of the text; other columns as they are.

    counted adds n_removed, the number of lines cut, and needs docs without a column of this name. Null texts stay null;
    texts of fewer lines than a window are never changed; a text may become empty. Rows of equal id are one document
    to each other (told apart by 25 bits of their texts' hashes): what they share stays in each. Null ids come last, and
    windows that only they have stay in all of them. In a run of one line repeated, the first window's lines stay. Windows are told by 64-bit hashes: of n different
    ones about n ** 2 / 2 ** 65 pairs are taken for equal (one in 30 runs at 10 ** 9, some hundreds of 10 ** 11).
    """
    if not 1 <= window <= 127:
        raise ValueError("a window has 1 to 127 lines")
    version, spans, of_id, of_version = fresh(docs, "version", "spans", "of_id", "of_version")
    keyed = docs.withColumn(version, F.hash(F.col(text_col)).bitwiseAND((1 << VERSION_BITS) - 1))
    rows = keyed.select(F.col(id_col).alias("id"), F.col(version).alias("version"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # Windows are shuffled once, by hash; those frequent in a sample by hash and salt, so that the occurrences of a hot
    # window go to many tasks. A task counts its windows by a sort; a frequent one's counts are put together and broadcast.
    often = docs.sparkSession.sparkContext.broadcast(frequent(rows, window, min_words))
    found = rows.mapInArrow(_window_batches(window, min_words, often), f"h long not null, id {kind}, packed long not null, salt byte not null")
    length = F.shiftright("packed", 1).bitwiseAND(127).cast("int")
    dealt = found.repartition("h", "salt")
    salted = F.when(F.spark_partition_id() >= 0, F.col("salt")) >= 0  # salt >= 0, but not to be pushed below the exchange, which both uses share
    own = dealt.where(salted).groupBy("h").agg(F.min("id").alias("all_first"), F.count_if(length > 0).alias("all_n"))
    same = W.partitionBy("h", "salt")
    here = dealt.withColumns({"first": F.min("id").over(same), "n": F.count_if(length > 0).over(same)}).join(F.broadcast(own), "h", "left")
    hot = F.col("salt") >= 0
    joined = here.withColumns({"first": F.when(hot, F.col("all_first")).otherwise(F.col("first")), "n": F.when(hot, F.col("all_n")).otherwise(F.col("n"))}).where("n > 1")
    later = joined.where((F.col("packed").bitwiseAND(1) == 1) | ~F.col("id").eqNullSafe(F.col("first")))
    start = F.shiftright("packed", 8).bitwiseAND((1 << 31) - 1).cast("int")
    span = later.select(F.col("id").alias(of_id), F.shiftrightunsigned("packed", 39).cast("int").alias(of_version), F.struct(start.alias("s"), (start + length).alias("e")).alias("span"))
    covered = span.groupBy(of_id, of_version).agg(F.collect_set("span").alias(spans))
    ours = keyed.join(covered, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(version) == F.col(of_version)), "left")
    ours = ours.select(*docs.columns, spans)
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_removed long"] * counted
    return ours.mapInArrow(_remove_batches(docs.columns.index(text_col), counted), ", ".join(types))
