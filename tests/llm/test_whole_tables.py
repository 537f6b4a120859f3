"""What once came from a sample comes from all rows."""

import math
import random
from collections import Counter

import pyarrow as pa

from barline.llm import linededup, tokencount


def test_token_model_is_fitted_on_all_rows(spark, monkeypatch):
    rng = random.Random(40)
    texts = [" ".join(rng.choice(["the", "Haus", "été", "x1", "naïve"]) for _ in range(rng.randrange(0, 6))) for _ in range(7000)] + [None, "", "Ornithorhynchus\nparadoxus \x1c日本"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pieces = tokencount.Pieces()
    sp, counts = pieces.processor(), Counter()
    for text in texts:
        for word in (text or "").split():
            counts.update(sp.encode(word, out_type=str))
    whole = sum(counts[p] + 0.5 for p in pieces.names())
    found = tokencount.fit(docs)
    assert set(found) == set(pieces.names())
    assert all(abs(found[p] - math.log((counts[p] + 0.5) / whole)) < 1e-9 for p in found)
    # the same from several helpings of words
    monkeypatch.setattr(tokencount, "CACHE", 2)
    (batch,) = tokencount._piece_batches(pieces)(docs.where("text is not null").select("text").toArrow().combine_chunks().to_batches())
    assert {p: n for p, n in zip(*[c.to_pylist() for c in batch.columns])} == dict(counts)


def test_spans_of_lines_are_merged_by_row():
    rows = [[(4, 7), (0, 3), (3, 4), (9, 12), (10, 11)], None, [], [(5, 6)], [(2, 3), (0, 1)]]
    spans = pa.array([r and [{"s": a, "e": b} for a, b in r] for r in rows], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
    for start in range(6):
        found = [tuple(map(int, x)) for x in zip(*linededup.merged(spans.slice(start)))]
        assert found == [(k - start, a, b) for k, a, b in [(0, 0, 7), (0, 9, 12), (3, 5, 6), (4, 0, 1), (4, 2, 3)] if k >= start]
