"""BPE encoding and decoding over a minimal acyclic lexicon.

The frequent words of the corpus, counted over all rows, are compiled with their ids into an acyclic automaton
that shares prefixes and suffixes (each edge counts the words before it, so a walk gives the word's number and
that its ids). The file is sent with SparkContext.addFile and memory-mapped by the workers. Words outside it are
merged exactly. Results don't depend on what the lexicon holds.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import held, slices

LEXICON_SHARE, CACHE = 2.0**-20, 600_000
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: The tokenizer file's own split pattern, with white space spelled out.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_BITS, _NONE, _MARKS = 20, 1 << 60, frozenset(".,;:!?")
_MASK = (1 << _BITS) - 1
_ODD_SPLIT = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """A word-end BPE tokenizer, from the JSON text of its file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.ids = spec["model"]["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        #: For a pair of ids, as one number: rank and id of what it merges to, as one number.
        self.pairs = {self.ids[x] << _BITS | self.ids[y]: i << _BITS | self.ids[x + y] for i, (x, y) in reversed(list(enumerate(merges)))}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.table = np.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], dtype=object)
        self.dense = len(tokens) == len(self.table)
        self.inner = [self.ids.get(c) for c in byte_symbols()]
        self.last = [self.ids.get(c + self.suffix) for c in byte_symbols()]
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """Normalised pre-tokens of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if text.isalpha():
            return [text]
        if text[-1:] in _MARKS and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return _WORD.findall(text)

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token, by the merges in order of rank, leftmost first."""
        data = word.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        get = self.pairs.get
        ranks = [get(x << _BITS | y, _NONE) for x, y in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < _NONE:
            i = ranks.index(best)
            new = parts[i] = best & _MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << _BITS | new, _NONE)
            if i < len(ranks):
                ranks[i] = get(new << _BITS | parts[i + 1], _NONE)
        return parts

    def pieces(self, text: str) -> list[tuple[str, int | None]]:
        """Parts of a text: (text, None), or (special token, its id)."""
        if self._special_split is None or not any(s in text for s in self.special):
            return [(text, None)]
        return [(p, self.special.get(p)) for p in self._special_split.split(text) if p]

    def decode(self, ids) -> str:
        """As a tokenizer without a decoder: tokens joined by spaces; ids outside the vocabulary give nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.table)):
            ids = ids[(ids >= 0) & (ids < len(self.table))]
        tokens = self.table[ids].tolist()
        return " ".join(tokens if self.dense else [t for t in tokens if t is not None])


class Lexicon:
    """A minimal acyclic automaton of words with id outputs, over a buffer that compile_lexicon() made."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, dtype="<i8", count=5)
        n_states, n_edges, n_words, n_ids, filter_bytes = head.tolist()
        at = 40

        view = memoryview(buffer)

        def part(kind: str, n: int) -> memoryview:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            out = view[at : at + size].cast(kind)
            at += (size + 7) // 8 * 8
            return out

        self.first, self.target = part("i", n_states + 1), part("i", n_edges)
        self.before, self.final = part("i", n_edges), part("B", n_states)
        self.offsets, self.ids = part("i", n_words + 1), part("I", n_ids)
        self.filter, self.mask = part("B", filter_bytes), 8 * filter_bytes - 1
        self.labels_at, self.buffer = at, buffer
        self.n_states, self.n_words = n_states, n_words

    def number(self, word: bytes) -> int:
        """The word's number among the sorted words, or -1; most words that aren't among them fail the filter at once."""
        h = crc32(word) & self.mask
        if not self.filter[h >> 3] >> (h & 7) & 1:
            return -1
        state, number, find, base, first = 0, 0, self.buffer.find, self.labels_at, self.first
        for i in range(len(word)):
            edge = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if edge < 0:
                return -1
            number += self.before[edge]
            state = self.target[edge]
        return number if self.final[state] else -1

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian unsigned 32-bit integers."""
        n = self.number(word)
        return None if n < 0 else self.ids[self.offsets[n] : self.offsets[n + 1]].tobytes()


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file of a Lexicon: words in order are added one by one, states with equal futures are shared."""
    register: dict[tuple, int] = {}
    edges: list[tuple[bool, tuple]] = []  # by shared state: final, ((label, target), ...)

    def share(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(edges)
            edges.append(key)
        return register[key]

    path, last = [[False, []]], b""  # a node: final, edges; the last edge of a node on the path is open
    words = sorted(w for w in entries if w)
    for word in [*words, None]:
        same = len(os.path.commonprefix([word, last])) if word is not None else 0
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], share(node)))
        for _ in word[same:] if word is not None else b"":
            path.append([False, []])
        if word is not None:
            path[-1][0], last = True, word
    root = share(path[0])
    under: list[int] = []
    for final, out in edges:  # targets come before their sources
        under.append(final + sum(under[t] for _, t in out))
    order = [root, *(i for i in range(len(edges)) if i != root)]
    place = {s: i for i, s in enumerate(order)}
    first, target, before, labels = [0], [], [], bytearray()
    for s in order:
        passed = int(edges[s][0])
        for label, t in edges[s][1]:
            labels.append(label)
            target.append(place[t])
            before.append(passed)
            passed += under[t]
        first.append(len(target))
    ids = [entries[w] for w in words]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
    flat = np.array([i for x in ids for i in x], dtype="<u4")
    marks = bytearray(1 << max(3, (2 * len(words)).bit_length()))
    for w in words:
        h = crc32(w) & (8 * len(marks) - 1)
        marks[h >> 3] |= 1 << (h & 7)
    out = [np.array([len(order), len(target), len(words), len(flat), len(marks)], dtype="<i8").tobytes()]
    for a in (np.array(first, "<i4"), np.array(target, "<i4"), np.array(before, "<i4"), np.array([edges[s][0] for s in order], "u1"), offsets.astype("<i4"), flat, np.frombuffer(marks, "u1")):
        out.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
    return b"".join([*out, bytes(labels)])


class Shared:
    """A tokenizer file's text for all workers, each of which parses it once."""

    def __init__(self, spark, path: str | None):
        with open(path or vocabulary_path(), encoding="utf-8") as f:
            text = f.read()
        self.key, self.text = hashlib.sha1(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)


def _bpe(shared: Shared) -> WordBpe:
    return held("bpe", shared.key, lambda: WordBpe(shared.text.value))


def _lexicon(name: str) -> Lexicon:
    with open(SparkFiles.get(name), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def _encoder(shared: Shared, name: str) -> Encoder:
    """The worker's encoder; that of another lexicon goes."""
    bpe = _bpe(shared)
    kept = held("bpe", "encoder", dict)
    if name not in kept:
        kept.clear()
        kept[name] = Encoder(bpe, _lexicon(name))
    return kept[name]


class Recent(dict):
    """A bounded cache: what isn't found is made; beyond half the bound the older half is dropped, but for what was used since."""

    def __init__(self, make, bound: int = CACHE):
        super().__init__()
        self.make, self.bound, self.older = make, bound, {}

    def __missing__(self, key):
        if (out := self.older.get(key)) is None:
            out = self.make(key)
        if len(key) <= 256:
            self[key] = out
        return out

    def trim(self) -> None:
        if 2 * len(self) > self.bound:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Texts to ids and back: by white-space chunk from a cache, else by word from the lexicon, else by merging.

    Ids are little-endian unsigned 32-bit integers.
    """

    def __init__(self, bpe: WordBpe, lexicon: Lexicon | None = None):
        self.bpe, self.lexicon = bpe, lexicon
        self.by_chunk, self.by_word = Recent(self._whole), Recent(self._word)

    def _word(self, word: str) -> bytes:
        found = self.lexicon.get(word.encode()) if self.lexicon else None
        return found if found is not None else array("I", self.bpe.merge(word)).tobytes()

    def _whole(self, text: str) -> bytes:
        words = self.bpe.words(text)
        if len(words) == 1:
            return self.by_word[words[0]]
        return b"".join([self.by_word[w] for w in words])

    def ids(self, text: str) -> bytes:
        """The text's ids."""
        self.by_chunk.trim()
        self.by_word.trim()
        out, by_chunk = [], self.by_chunk
        for piece, special in self.bpe.pieces(text):
            if special is not None:
                out.append(special.to_bytes(4, "little"))
            elif _ODD_SPLIT.search(piece):
                out.append(self._whole(piece))
            else:
                out += [by_chunk[c] for c in piece.split()]
        return b"".join(out)


def _count_batches(shared):
    def run(batches):
        bpe = _bpe(shared)
        counts: Counter = Counter()

        def out():
            words: Counter = Counter()
            for chunk, n in counts.items():
                for w in bpe.words(chunk):
                    words[w] += n
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update((text or "").split())
            if len(counts) > CACHE:
                yield out()
                counts = Counter()
        yield out()

    return run


def frequent_words(docs: DataFrame, shared: Shared, text_col: str = "text", share: float = LEXICON_SHARE) -> list[str]:
    """The words that occur at least once in every 1 / share bytes of all texts: no more than 1 / share words."""
    texts = docs.select(F.col(text_col).alias("text"))
    least = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * share
    words = texts.mapInArrow(_count_batches(shared), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r[0] for r in words.where(F.col("n") >= least).select("word").collect()]


def publish_lexicon(docs: DataFrame, shared, text_col: str = "text", share: float = LEXICON_SHARE) -> str:
    """Compile the lexicon of docs, send it to all workers; the name it has there."""
    bpe = _bpe(shared)
    data = compile_lexicon({w.encode(): bpe.merge(w) for w in frequent_words(docs, shared, text_col, share)})
    folder, name = tempfile.mkdtemp(prefix="lexicon-"), f"lexicon-{uuid.uuid4().hex}.bin"
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    return name


def _encode_batches(shared, name: str, columns: str, with_ids: bool = False):
    """columns: digest, or whole (ids and decoded text)."""

    def run(batches):
        encoder = _encoder(shared, name)
        for batch in slices(batches):
            ids, texts = [], []
            for text in batch.column(1).to_pylist():
                ids.append(encoder.ids(text or ""))
                texts.append(encoder.bpe.decode(np.frombuffer(ids[-1], dtype="<u4")))
            if columns == "digest":
                sha = hashlib.sha256
                cols = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array([sha(x).hexdigest() for x in ids]), "decoded_sha256": pa.array([sha(x.encode()).hexdigest() for x in texts])}
            else:
                cols = {"ids": pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            if with_ids:
                cols = {"ids": pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))} | cols
            kept = {batch.schema.names[i]: batch.column(i) for i in range(2, batch.num_columns)}
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept.values(), *cols.values()], names=["id", *kept, *cols])

    return run


def _apply(docs: DataFrame, id_col: str, text_col: str, path: str | None, share: float, columns: str, schema: str, keep: list[str] = [], with_ids: bool = False) -> DataFrame:
    shared = Shared(docs.sparkSession, path)
    name = publish_lexicon(docs, shared, text_col, share)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    kinds = ["id " + rows.schema["id"].dataType.simpleString(), *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)] + ["ids array<int>"] * with_ids
    return rows.mapInArrow(_encode_batches(shared, name, columns, with_ids), f"{', '.join(kinds)}, {schema}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, share: float = LEXICON_SHARE) -> DataFrame:
    """(id, ids, decoded) for each row's whole text. Null and empty texts have no ids and decode to the empty text."""
    return _apply(docs, id_col, text_col, path, share, "whole", "ids array<int>, decoded string")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, share: float = LEXICON_SHARE, keep: list[str] = [], ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what encode() gives, as a count and two digests.

    After id come the columns of docs named in keep, and, if asked for, the ids themselves.
    """
    return _apply(docs, id_col, text_col, path, share, "digest", "n_tokens long, ids_sha256 string, decoded_sha256 string", keep, ids)


def _decode_batches(shared):
    def run(batches):
        bpe = _bpe(shared)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    return run


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, decoded) for each row's ids; null ids decode to the empty text."""
    shared = Shared(rows.sparkSession, path)
    kind = rows.schema[id_col].dataType.simpleString()
    named = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return named.mapInArrow(_decode_batches(shared), f"id {kind}, decoded string").withColumnRenamed("id", id_col)
