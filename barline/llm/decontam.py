"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows.

The benchmark is cut in chunks of at most `max_words` words. Each chunk is one broadcast set of window hashes,
so its size is bounded; a larger benchmark takes more passes over the rows, one chunk at a time, never a larger
broadcast: the rows, with what was found so far, are materialised between passes. Hash hits are verified word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.common import chain, cut, fresh, held, raw, slices

WINDOW, MAX_WORDS, MULTIPLIER = 13, 2_000_000, np.uint64(0x9E3779B97F4A7C15)
_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_NORMAL = bytes(32 if i in _SEPARATORS else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, Latin letters and non-ASCII characters, as UTF-8."""
    return (text or b"").translate(_NORMAL).split()


class WindowSet:
    """The windows of some benchmark items by length: sorted hashes to scan with, exact words to verify with."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.owners: dict[tuple, set] = defaultdict(set)
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                own = self.owners[tuple(ids[i : i + n])]
                if item is not None:
                    own.add(item)
        by_length = defaultdict(list)
        for gram in self.owners:
            by_length[len(gram)].append(gram)
        self.hashes = {n: np.unique(self._hash(np.array(g, dtype=np.int64).ravel(), np.arange(len(g)) * n, n)) for n, g in by_length.items()}

    @staticmethod
    def _hash(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(starts), dtype=np.uint64)
        for k in range(n):
            out = (out + ids[starts + k].astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        return out

    def find(self, ids: np.ndarray):
        """(start, length, items) of each occurrence in ids, where -1 stands for a word of no item."""
        outside = np.concatenate(([0], np.cumsum(ids < 0)))
        for n, known in self.hashes.items():
            starts = np.flatnonzero(outside[n:] == outside[:-n]) if len(ids) >= n else np.empty(0, np.int64)
            if len(starts):
                own = self._hash(ids, starts, n)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                for s in starts[known[at] == own].tolist():
                    if (items := self.owners.get(tuple(ids[s : s + n].tolist()))) is not None:
                        yield s, n, items


def window_sets(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS):
    """WindowSets of at most max_words words each (or one item), together all items of bench."""
    part, held = [], 0
    for row in bench.select(F.col(id_col), F.col(text_col).cast("string")).toLocalIterator():
        words = words_of(row[1].encode() if row[1] is not None else None)
        if part and held + len(words) > max_words:
            yield WindowSet(part, window)
            part, held = [], 0
        part.append((row[0], words))
        held += len(words)
    yield WindowSet(part, window)


def _scan_batches(shared, at: int):
    """Adds to the last two columns, hit word spans and item ids, what the shared WindowSet finds in column at."""

    def run(batches):
        held("decontam", "", dict)
        found = shared.value
        known = found.vocab.get
        for batch in slices(batches):
            ids, starts = [], []
            for text in raw(batch, at):
                starts.append(len(ids))
                ids += [known(w, -1) for w in words_of(text)]
                ids.append(-1)
            spans, items = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            for s, n, owners in found.find(np.array(ids, dtype=np.int64)):
                k = int(np.searchsorted(starts, s, side="right")) - 1
                spans[k].append((s - starts[k], s - starts[k] + n))
                items[k] += owners
            spans = [_merged(x) for x in spans]
            items = [sorted(set(x)) if x else x for x in items]
            kinds = batch.schema.field(batch.num_columns - 2).type, batch.schema.field(batch.num_columns - 1).type
            flat = [[{"s": a, "e": b} for a, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(flat, type=kinds[0]), pa.array(items, type=kinds[1])], schema=batch.schema)

    return run


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["s"], x["e"]) if isinstance(x, dict) else x for x in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def annotate(docs: DataFrame, bench: DataFrame, text_col: str = "text", spans: str = "spans", items: str = "items", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """docs with two more columns: merged word spans that windows of bench cover, and the ids of the items found.

    Null and empty texts have no words and no spans; items without words have no windows; items of fewer words
    than a window are one window; an item with a null id is found, but a null id is never listed.
    """
    out, scan = _scanned(docs, bench, text_col, spans, items, item_col, item_text, window, max_words)
    return out.mapInArrow(scan, out.schema)


def _scanned(docs: DataFrame, bench: DataFrame, text_col: str, spans: str = "spans", items: str = "items", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS):
    """docs with empty columns for spans and items, and the function on its batches that fills them."""
    kind = bench.schema[item_col].dataType
    span = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
    # coalesce() keeps the columns nullable, as what comes back from Python is
    none = {spans: F.coalesce(F.lit(None).cast(span), F.array().cast(span)), items: F.coalesce(F.lit(None).cast(T.ArrayType(kind)), F.array().cast(T.ArrayType(kind)))}
    out = docs.withColumns(none)
    at, sc = out.columns.index(text_col), docs.sparkSession.sparkContext
    scan = None
    for found in window_sets(bench, item_col, item_text, window, max_words):
        if scan:
            out = cut(out.mapInArrow(scan, out.schema))
        scan = _scan_batches(sc.broadcast(found), at)
    return out, scan


def _report_batches(at: int, ids: str):
    def run(batches):
        for batch in batches:
            spans, items = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            n_words = [len(words_of(x)) for x in raw(batch, at)]
            n_hit = [sum(x["e"] - x["s"] for x in own) for own in spans]
            digests = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
            bad = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words)]
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array(bad, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[ids, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """For each row of docs: its id, n_words, n_hit (words inside occurrences), n_items, items_sha256, contaminated.

    A row is contaminated if n_hit > 0 and 20 * n_hit >= n_words. items_sha256 is of the sorted, comma-joined ids.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text") if text_col != "text" else F.col("text"))
    out, scan = _scanned(rows, bench, "text", **options)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return out.mapInArrow(chain(scan, _report_batches(1, id_col)), schema)


def _removed_batches(at: int, how: str):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def run(batches):
        for batch in batches:
            texts, spans = raw(batch, at), batch.column(batch.num_columns - 2).to_pylist()
            keep = []
            for k, own in enumerate(spans):
                if own and how == "spans":
                    places = [m.span() for m in word.finditer(texts[k])]
                    out, done = [], 0
                    for x in own:
                        out.append(texts[k][done : places[x["s"]][0]])
                        done = places[x["e"] - 1][1]
                    texts[k] = b"".join([*out, texts[k][done:]])
                n, hit = (len(words_of(texts[k])) if own and how == "documents" else 0), sum(x["e"] - x["s"] for x in own)
                keep.append(how == "spans" or not (hit and 20 * hit >= n))
            text = pa.array(texts, pa.binary()).cast(batch.column(at).type)
            cols = [text if i == at else c for i, c in enumerate(batch.columns[:-2])]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-2]).filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", how: str = "documents", **options) -> DataFrame:
    """docs without contaminated rows (how="documents") or without the covered words (how="spans"); other columns as they are."""
    spans, items = fresh(docs, "spans", "items")
    out, scan = _scanned(docs, bench, text_col, spans, items, **options)
    return out.mapInArrow(chain(scan, _removed_batches(docs.columns.index(text_col), how)), docs.schema)
