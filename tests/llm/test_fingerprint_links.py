"""The near-dedup stage goes through SimHash, its pivot table and the popcount, before the exact search."""

import random

from barline.llm import similar


def test_pairs_of_near_fingerprints_connect_what_brute_force_does(spark):
    rng, fps = random.Random(50), []
    for _ in range(60):
        fps.append(rng.getrandbits(64))
        for bits in (0, 2, 4, 5, 9):
            x = fps[-1 if bits else 0]
            for at in rng.sample(range(64), bits):
                x ^= 1 << at
            fps.append(x)
    nodes = [(rng.getrandbits(63) - (1 << 62), f - (1 << 64) if f >> 63 else f) for f in fps]
    found = [tuple(r) for r in similar.fingerprint_pairs(spark.createDataFrame(nodes, "node long, fp long")).collect()]
    assert all(a < b for a, b in found)

    def roots(pairs):
        root = {n: n for n, _ in nodes}
        for a, b in pairs:
            if (x := root[a]) != (y := root[b]):
                root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
        return root

    every = [(a, b) for i, (a, f) in enumerate(nodes) for b, g in nodes[:i] if ((f ^ g) & (1 << 64) - 1).bit_count() <= 4]
    assert len(every) > 100 and roots(found) == roots(every)


def test_the_stage_takes_its_fingerprints_pairs(spark, monkeypatch):
    seen, pairs = [], similar.fingerprint_pairs

    def spy(nodes, *options):
        out = pairs(nodes, *options)
        seen.append(out.count())
        return out

    monkeypatch.setattr(similar, "fingerprint_pairs", spy)
    text = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:-1])), (3, " ".join(text[::-1])), (4, None), (5, "")], "doc_id long, text string")
    assert sorted(r[0] for r in similar.dedup(docs).collect()) == [1, 3, 4]
    assert seen == [1]
