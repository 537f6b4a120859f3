"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch, sorted, are a trie in depth-first order: a stack holds the forward states (best
score and number of tokens) of the current path, and only the nodes that a pre-token doesn't share with the one
before it are computed. The counts at the terminal nodes are kept and summed by document. One pass, no shuffle.

The pieces are those of a public tokenizer, which isn't trained here; their unigram probabilities are, on the words of all texts.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import held, slices

CACHE, WORDS_AT_ONCE, SPACE = 600_000, 10_000, "▁"


class Pieces:
    """The pieces of a sentencepiece file; its content is what travels."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            self.content = f.read()

    def processor(self):
        import sentencepiece

        return held("tokencount", "processor", lambda: sentencepiece.SentencePieceProcessor(model_proto=self.content))

    def names(self) -> list[str]:
        sp = self.processor()
        return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def _piece_batches(pieces: Pieces):
    """How often each piece is used in all texts of a task; a word is encoded once for all its occurrences that are held."""

    def run(batches):
        sp = pieces.processor()
        words, n = Counter(), np.zeros(sp.get_piece_size(), np.int64)

        def spend():
            rest = iter(words.items())
            while some := list(islice(rest, WORDS_AT_ONCE)):
                for ids, (_, times) in zip(sp.encode([w for w, _ in some], out_type=int, num_threads=1), some):
                    for i in ids:
                        n[i] += times
            words.clear()

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                words.update(text.split())
                if len(words) > CACHE:
                    spend()
        spend()
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([sp.id_to_piece(int(i)) for i in used], pa.string()), pa.array(n[used])], names=["piece", "n"])

    return run


def fit(docs: DataFrame, text_col: str = "text", path: str | None = None) -> dict[str, float]:
    """Log-probabilities of a public tokenizer's pieces: how often it uses each in the words of all rows of docs, plus 1/2.

    The words are those at white space that count_tokens counts, each with the space before it.
    """
    pieces = Pieces(path)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    counts = dict(texts.mapInArrow(_piece_batches(pieces), "piece string, n long").groupBy("piece").agg(F.sum("n")).toLocalIterator())
    names = pieces.names()
    whole = math.log(sum(counts.get(p, 0) + 0.5 for p in names))
    return {p: math.log(counts.get(p, 0) + 0.5) - whole for p in names}


class TrieCounter:
    """Numbers of tokens of pre-tokens. A character in no piece counts as its UTF-8 bytes, at the lowest score less ten."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10

    def count(self, words: list[str]) -> dict[str, int]:
        """The number of tokens of each of the distinct words."""
        get, longest, out = self.pieces.get, self.longest, {}
        scores, counts, last = [0.0], [0], ""
        for word in sorted(words):
            shared = len(os.path.commonprefix((word, last)))
            del scores[shared + 1 :], counts[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                best, n = None, 0
                for i in range(max(0, j - longest), j):
                    p = get(word[i:j])
                    if p is None:
                        if i < j - 1:
                            continue
                        p, more = self.unknown, len(word[i:j].encode())
                    else:
                        more = 1
                    if best is None or scores[i] + p > best:
                        best, n = scores[i] + p, counts[i] + more
                scores.append(best)
                counts.append(n)
            out[word], last = counts[-1], word
        return out


def _count_batches(shared):
    def run(batches):
        held("tokencount", "", dict)
        counter = TrieCounter(shared.value)
        known: dict[str, int] = {}
        for batch in slices(batches):
            texts = [(t or "").split() for t in batch.column(1).to_pylist()]
            if len(known) > CACHE:
                known = {}
            new = {w for t in texts for w in t if w not in known}
            known |= {w[1:]: n for w, n in counter.count([SPACE + w for w in new]).items()}
            cols = [[len(t) for t in texts], [sum([known[w] for w in t]) for t in texts]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict[str, float] | None = None, path: str | None = None) -> DataFrame:
    """(id, n_words, n_tokens) for each row's whole text, pre-tokens being its words at white space.

    model has the pieces' log-probabilities; without one they are fitted on docs, over the pieces of path. Equal scores: the longest last piece. Null and empty texts have 0; repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text_col, path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_count_batches(shared), f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
