"""What near-dedup compares must grow with the table, not with the square of the texts that hold a passage."""

import random

import numpy as np
import pytest

from barline.llm import similar


def grams(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def roots(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def families(rng, passage):
    """Texts that all hold a passage of long words; every fifth has two near copies."""
    texts = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        words[i : i + len(passage)] = passage
        texts.append(" ".join(words))
        if i % 5 == 0:
            texts += [" ".join([*words[:-k], *(f"x{i}" for _ in range(k))]) for k in (3, 8)]
    return texts


@pytest.mark.parametrize("limit", [1, 8])
def test_a_passage_of_many_texts_makes_few_pairs(spark, monkeypatch, limit):
    texts, counts, cut = families(random.Random(60), [f"passage{k}" for k in range(12)]), [], similar.cut

    def spy(df):
        out = cut(df)
        if out.columns == ["a", "b"]:
            counts.append(out.count())
        return out

    monkeypatch.setattr(similar, "cut", spy)
    # as in a large table: the passage is too rare for the sample
    monkeypatch.setattr(similar, "FREQUENT", 1 << 20)
    monkeypatch.setattr(similar, "CROWDED", limit, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = dict(map(tuple, similar.near_duplicates(docs).collect()))
    assert [found[i] for i in range(len(texts))] == roots(texts)
    assert len(set(found.values())) == 60 and max(counts) < 100


def test_sketches_drop_unlike_pairs_and_no_similar_one():
    rng, dropped = np.random.default_rng(61), 0
    for _ in range(400):
        n, m = rng.integers(1, 900, 2)
        m = n + int(rng.integers(-n // 4, n // 4 + 1))
        both = rng.integers(0, 1 << 63, int(min(n, m) * rng.choice([0.3, 0.85, 0.9, 1.0])), dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 63, max(0, k - len(both)), dtype=np.uint64)))) for k in (n, m))
        like = len(np.intersect1d(a, b)) * 100 >= 80 * len(np.union1d(a, b))
        kept = similar.may_be_similar(len(a), similar.sketch(a), len(b), similar.sketch(b), 80)
        assert kept or not like
        dropped += not kept and len(np.intersect1d(a, b)) < min(n, m) / 2
    assert dropped > 80
    empty, one = np.empty(0, np.uint64), np.array([5], np.uint64)
    assert similar.may_be_similar(0, similar.sketch(empty), 0, similar.sketch(empty), 80)
    assert not similar.may_be_similar(0, similar.sketch(empty), 1, similar.sketch(one), 80)
