"""Language identification by multilingual mixture inference.

A document is a mixture of languages: each word comes from one language, with the likelihood that the language's
character n-grams give it. Expectation-maximisation estimates the proportions; the set of languages is grown from
the likeliest single one while the penalised log-likelihood rises. The prediction is the largest share.

The n-gram model is fitted on a sample of labelled rows: a hash of the row picks `docs_per_lang` rows of each
language in expectation, whole texts. Everything else covers all rows, one pass, no shuffle.
"""

from __future__ import annotations

from collections import Counter
from itertools import tee

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import held, held_out, slices

DOCS_PER_LANG, SMOOTHING, PENALTY, ROUNDS, CACHE, WORDS_AT_ONCE = 1000, 0.5, 3.0, 10, 300_000, 250_000
UNKNOWN = "und"


def letters_of(chunk: str) -> str:
    """The letters of a chunk, in lower case."""
    chunk = chunk.lower()
    return chunk if chunk.isalpha() else "".join([c for c in chunk if c.isalpha()])


def grams_of(word: str) -> list[str]:
    """Character trigrams of a word with both ends marked."""
    word = f"<{word}>"
    return [word[i : i + 3] for i in range(len(word) - 2)]


class Model:
    """Log-probabilities of n-grams by language; the last row is for unseen n-grams."""

    def __init__(self, counts: dict[str, Counter], smoothing: float = SMOOTHING):
        self.langs = sorted(counts)
        grams = sorted({g for c in counts.values() for g in c})
        self.row = {g: i for i, g in enumerate(grams)}
        table = np.zeros((len(grams) + 1, max(1, len(self.langs))))
        for k, lang in enumerate(self.langs):
            for g, n in counts[lang].items():
                table[self.row[g], k] = n
        table += smoothing
        self.logp = np.log(table / table.sum(axis=0))

    def score(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word (letters only, not empty) in each language."""
        get, unseen, flat, starts = self.row.get, len(self.row), [], []
        for w in words:
            starts.append(len(flat))
            flat += [get(g, unseen) for g in grams_of(w)]
        return np.add.reduceat(self.logp[flat], starts, axis=0) if flat else np.empty((0, self.logp.shape[1]))


def proportions(like: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM of the shares of the allowed languages, for consecutive groups of words (none empty), and the log-likelihood."""
    starts, of = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(sizes)), sizes)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = like * share[of]
        part /= part.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(part, starts, axis=0) / sizes[:, None]
    return share, np.add.reduceat(np.log((like * share[of]).sum(axis=1) + 1e-300), starts)


def mixtures(log_like: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares of languages for consecutive groups of words, none empty; 0 for the languages that aren't selected."""
    n_langs = log_like.shape[1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    single = np.add.reduceat(log_like, starts, axis=0)
    best = np.eye(n_langs)[single.argmax(axis=1)]
    if n_langs == 1:
        return best
    like = np.exp(log_like - log_like.max(axis=1, keepdims=True))
    peak = np.add.reduceat(log_like.max(axis=1), starts)
    value = single.max(axis=1) - peak
    full, _ = proportions(like, sizes, np.ones((len(sizes), n_langs)))
    order, live = np.argsort(-full, axis=1, kind="stable"), np.arange(len(sizes))
    for k in range(2, n_langs + 1):
        words = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in live])
        allowed = np.zeros((len(live), n_langs))
        np.put_along_axis(allowed, order[live, :k], 1, axis=1)
        share, found = proportions(like[words], sizes[live], allowed)
        found -= penalty * (k - 1) * np.log(sizes[live] + 1)
        better = found > value[live]
        live, share, found = live[better], share[better], found[better]
        if not len(live):
            break
        best[live], value[live] = share, found
    return best


class _Words(dict):
    """Numbers of chunks; -1 for those without letters. New words wait in `new`."""

    def __init__(self):
        super().__init__()
        self.numbers, self.new = {}, []

    def __missing__(self, chunk: str) -> int:
        word = letters_of(chunk)
        if not word:
            out = -1
        elif (out := self.numbers.get(word)) is None:
            out = self.numbers[word] = len(self.numbers)
            self.new.append(word)
        self[chunk] = out
        return out


def _predict_batches(shared):
    def run(batches):
        held("langid", "", dict)
        model: Model = shared.value
        words, table = _Words(), np.empty((0, model.logp.shape[1]))

        def shares(docs: list[np.ndarray]) -> np.ndarray:
            sizes = np.array([len(d) for d in docs])
            out, full = np.zeros((len(docs), table.shape[1])), np.flatnonzero(sizes)
            if len(full) and model.langs:
                out[full] = mixtures(table[np.concatenate(docs)], sizes[full])
            return out

        for batch in slices(batches):
            found, docs, waiting = [], [], 0
            for text in [*batch.column(1).to_pylist(), None]:
                last = len(docs) + sum(map(len, found)) == batch.num_rows
                if waiting > WORDS_AT_ONCE or last:
                    if words.new:
                        table = np.concatenate((table, model.score(words.new)))
                        words.new = []
                    found.append(shares(docs))
                    docs, waiting = [], 0
                    if len(words) > CACHE:
                        words, table = _Words(), table[:0]
                if not last:
                    own = np.array(list(map(words.__getitem__, (text or "").split())), dtype=np.int64)
                    docs.append(own[own >= 0])
                    waiting += len(docs[-1])
            share = np.concatenate(found) if found else np.zeros((0, 1))
            score = share.max(axis=1)
            top = share.argmax(axis=1)
            lang = [model.langs[k] if s > 0 else UNKNOWN for k, s in zip(top.tolist(), score.tolist())]
            cols = [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score), pa.array([[x for x in zip(model.langs, row) if x[1] > 0] for row in share.tolist()], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "held_out", "lang_pred", "score", "shares"])

    return run


def _count_batches(batches):
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in Counter(map(letters_of, text.split())).items():
                for g in grams_of(word) if word else ():
                    counts[lang, g] += n
        langs, grams = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "gram", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """A model of the languages in lang_col, from about docs_per_lang rows of each (all, if fewer), whole texts.

    Rows with a null language or text and held-out rows are not learned from. The languages are taken to be few
    enough for the driver, as a classifier's labels are.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return Model({})
    odds = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, docs_per_lang / n))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = rows.where(draw < odds[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts: dict[str, Counter] = {}
    for lang, gram, n in sample.mapInArrow(_count_batches, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n")).collect():
        counts.setdefault(lang, Counter())[gram] = n
    return Model(counts)


def mixture(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, shares) for each row: the selected languages' shares and the largest of them.
    Null texts and texts without letters are `und` with score 0 and no shares, and so is all text if the model has
    no language. Equal shares: the first language in alphabetical order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, lang_pred string, score double, shares map<string,double>"
    return rows.mapInArrow(_predict_batches(shared), schema).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of docs, by a model fitted on docs."""
    return mixture(docs, fit(docs, id_col, text_col, lang_col, **options), id_col, text_col).drop("shares")


def _keep_batches(shared, at: int, lang_at: int | None, min_score: float):
    def run(batches):
        ours, theirs = tee(slices(batches))
        slim = (pa.RecordBatch.from_arrays([pa.array(range(x.num_rows)), x.column(at), pa.nulls(x.num_rows, pa.bool_())], names=["id", "text", "held_out"]) for x in theirs)
        for batch, found in zip(ours, _predict_batches(shared)(slim)):
            if lang_at is not None:
                told = found.column(2).cast(batch.column(lang_at).type)
                batch = pa.RecordBatch.from_arrays([told if i == lang_at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
            keep = [lang != UNKNOWN and score >= min_score for lang, score in zip(found.column(2).to_pylist(), found.column(3).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.0, tell_lang: bool = False, **options) -> DataFrame:
    """docs without the rows whose language can't be told (`und`) or whose main language has a share under min_score.

    tell_lang puts the language that was found in lang_col, whatever was there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, **options))
    return docs.mapInArrow(_keep_batches(shared, docs.columns.index(text_col), docs.columns.index(lang_col) if tell_lang else None, min_score), docs.schema)
