import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import langid, toxicity
from tests.llm.conftest import prose

SYLLABLES = {"aa": ["ka", "ro", "mi", "te", "lu"], "bb": ["sch", "ung", "ver", "ein", "ich"], "cc": ["eau", "oux", "ère", "tion", "que"]}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 5))) for _ in range(n))


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(11)
    rows = [(i, invented(rng, lang, rng.randrange(3, 80)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(300))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_held_out_documents(tongues):
    rows, df = tongues
    lang = {i: l for i, _, l in rows}
    found = langid.identify(df).collect()
    assert len(found) == len(rows)
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    own = [r["lang_pred"] == lang[r["doc_id"]] for r in found if r["held_out"]]
    assert len(own) > 30 and np.mean(own) > 0.98


def test_mixture_proportions(spark, tongues):
    _, df = tongues
    rng = random.Random(12)
    mixed = spark.createDataFrame([(1, invented(rng, "aa", 70) + " " + invented(rng, "bb", 30)), (2, invented(rng, "cc", 40))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in langid.mixture(mixed, langid.fit(df)).collect()}
    assert set(found[1]["shares"]) == {"aa", "bb"} and abs(found[1]["shares"]["aa"] - 0.7) < 0.05
    assert found[2]["shares"] == {"cc": pytest.approx(1.0)}


def plain_share(words, model, allowed):
    """Proportions of the allowed languages by ROUNDS steps of EM, and the log-likelihood, by plain loops."""
    like = [{k: math.exp(sum(model.logp[model.row.get(g, len(model.row)), k] for g in langid.grams_of(w))) for k in allowed} for w in words]
    share = {k: 1 / len(allowed) for k in allowed}
    for _ in range(langid.ROUNDS):
        part = [{k: x[k] * share[k] / sum(x[j] * share[j] for j in allowed) for k in allowed} for x in like]
        share = {k: sum(p[k] for p in part) / len(words) for k in allowed}
    return share, sum(math.log(sum(x[k] * share[k] for k in allowed)) for x in like)


def test_mixtures_against_brute_force(spark, tongues):
    _, df = tongues
    model, rng = langid.fit(df), random.Random(17)
    texts = [(i, invented(rng, "aa", rng.randrange(1, 20)) + " " * (i % 2) + invented(rng, rng.choice(["bb", "cc"]), rng.randrange(20)) * (i % 2)) for i in range(40)]
    found = {r["doc_id"]: r for r in langid.mixture(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    several = 0
    for i, text in texts:
        words = [w for w in map(langid.letters_of, text.split()) if w]
        n = range(len(model.langs))
        single = [sum(math.log(math.exp(sum(model.logp[model.row.get(g, len(model.row)), k] for g in langid.grams_of(w)))) for w in words) for k in n]
        best, value = {int(np.argmax(single)): 1.0}, max(single)
        full, _ = plain_share(words, model, list(n))
        order = sorted(n, key=lambda k: -full[k])
        for k in range(2, len(model.langs) + 1):
            share, like = plain_share(words, model, order[:k])
            if like - langid.PENALTY * (k - 1) * math.log(len(words) + 1) <= value:
                break
            best, value = share, like - langid.PENALTY * (k - 1) * math.log(len(words) + 1)
        several += len(best) > 1
        top = max(best, key=lambda k: (best[k], -k))
        assert found[i]["lang_pred"] == model.langs[top] and abs(found[i]["score"] - best[top]) < 1e-6
        assert found[i]["shares"] == {model.langs[k]: pytest.approx(s, abs=1e-6) for k, s in best.items()}
    assert several > 5


def test_em_never_lowers_the_likelihood():
    rng = np.random.default_rng(13)
    like, sizes = rng.random((200, 3)), np.array([50, 100, 50])
    values = [langid.proportions(like, sizes, np.ones((3, 3)), rounds)[1] for rounds in range(1, 8)]
    assert all((b >= a - 1e-9).all() for a, b in zip(values, values[1:]))


def test_language_odd_rows(spark, odd_docs, empty_docs, tongues):
    found = {r["doc_id"]: r for r in langid.identify(odd_docs).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (2, 3, 4, 7))
    assert found[1]["lang_pred"] in ("en", "ja", "fr")
    assert langid.identify(odd_docs).count() == odd_docs.count()
    assert langid.identify(empty_docs).count() == 0
    assert {r["lang_pred"] for r in langid.mixture(odd_docs, langid.fit(empty_docs)).collect()} == {"und"}
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, 1, 5, 6, 8, 10, 11, 12}
    assert langid.keep_identified(empty_docs).count() == 0


def test_long_batches_are_cut_alike(spark, tongues, monkeypatch):
    rows, df = tongues
    model = langid.fit(df)
    plain = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.mixture(df, model).collect()}
    batches = [b for b in df.withColumn("held_out", df.doc_id > 0).select("doc_id", "text", "held_out").toArrow().to_batches()]
    monkeypatch.setattr(langid, "WORDS_AT_ONCE", 100)
    monkeypatch.setattr(langid, "CACHE", 50)
    out = [x for b in langid._predict_batches(type("S", (), {"value": model}))(batches) for x in b.to_pylist()]
    assert {r["id"]: (r["lang_pred"], round(r["score"], 9)) for r in out} == plain


BAD = ["trash", "moron", "scum", "idiot"]


@pytest.fixture(scope="module")
def comments(spark):
    rng, rows = random.Random(14), []
    for i in range(1500):
        words, toxic = prose(rng, rng.randrange(20, 120)).split(), int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows if r[0] % 10], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_toxicity_of_held_out_documents(comments):
    rows, docs, labels = comments
    toxic = {r[0]: r[2] for r in rows}
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == len(rows)
    assert all(r["held_out"] == is_held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    own = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in own]) > 0.97


def test_toxicity_ignores_held_out_labels(spark, comments):
    rows, docs, labels = comments
    flipped = spark.createDataFrame([(r[0], 1, 1 - r[2] if is_held_out(r[0]) else r[2]) for r in rows if r[0] % 10], "doc_id long, quality int, toxic int")
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_odd_rows(spark, odd_docs, empty_docs, comments):
    _, docs, labels = comments
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(odd_docs, model).collect()}
    assert found[2]["score"] == found[3]["score"] == model.rate and found[1]["score"] < 0.5
    assert toxicity.score(odd_docs, model).count() == odd_docs.count() and toxicity.score(empty_docs, model).count() == 0
    # without labels, with one label, and with null and repeated labels
    assert {r["score"] for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, labels.limit(0))).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (None, 0, 1), (5, 1, None), (6, 1, 7)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, odd)).collect()} <= {0.5, 1.0}
    assert toxicity.score(odd_docs, toxicity.fit(empty_docs, labels)).count() == odd_docs.count()


def test_toxicity_is_the_length_normalised_difference(comments, monkeypatch):
    """Without the class-conditional likelihoods nothing is left to find toxic documents by."""
    rows, docs, labels = comments
    toxic = {r[0]: r[2] for r in rows}

    def recall():
        out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        own = [r for r in out if r["held_out"] and toxic[r["doc_id"]]]
        return np.mean([r["predicted"] for r in own])

    assert recall() >= 0.9
    evidence = toxicity.evidence
    monkeypatch.setattr(toxicity, "evidence", lambda counts: (evidence(counts)[0].withColumn("r", F.lit(0.0)), 0.0))
    assert recall() in (0.0, 1.0)  # all alike


def test_model_against_brute_force(spark, comments):
    rows, _, labels = comments
    learn = [r for r in rows[:400] if r[0] % 10 and not is_held_out(r[0])]
    docs = spark.createDataFrame([r[:2] for r in rows[:400]], "doc_id long, text string")
    n, pair = [{}, {}], [{}, {}]
    for _, text, c in learn:
        words = [w for w in ("".join(x for x in chunk.lower() if x.isalpha()) for chunk in text.split()) if w]
        for w in set(words):
            n[c][w] = n[c].get(w, 0) + 1
        for p in set(zip([None, *words], words)):
            pair[c][p] = pair[c].get(p, 0) + 1
    d, dd, share = toxicity.DISCOUNT, toxicity.PAIR_DISCOUNT, toxicity.SHARE
    total = [sum(n[c].values()) for c in (0, 1)]
    back = [sum(min(d, x) for x in n[c].values()) / total[c] for c in (0, 1)]
    every = set(pair[0]) | set(pair[1])
    before = {}
    for _, w in every:
        before[w] = before.get(w, 0) + 1

    def alone(c, w):
        return max(n[c].get(w, 0) - d, 0) / total[c] + back[c] * before[w] / len(every)

    expected = {(None, w): math.log(1 - share + share * alone(1, w) / alone(0, w)) for w in n[1]}
    for h, w in (p for p, x in pair[1].items() if x > dd):
        mine = [p for p in every if p[0] == h]
        b = sum(min(dd, pair[c].get(p, 0)) for c in (0, 1) for p in mine) / sum(pair[c].get(p, 0) for c in (0, 1) for p in mine)
        p = []
        for c in (0, 1):
            s = sum(max(pair[c].get(x, 0) - dd, 0) for x in mine)
            p.append((1 - b) * (max(pair[c].get((h, w), 0) - dd, 0) / s if s else alone(c, w)) + b * alone(c, w))
        expected[h or "", w] = math.log(1 - share + share * p[1] / p[0])
    hashes = toxicity.Hashes()
    keys = {}
    for (h, w), r in expected.items():
        before_h = toxicity.START if h == "" else None if h is None else hashes[h]
        key = hashes[w] if before_h is None else int(toxicity.pair_keys(np.array([before_h]), np.array([hashes[w]]))[0])
        keys[key] = r
    for hot in (toxicity.HOT, 5):  # with few frequent expressions the rest is joined
        model = toxicity.fit(docs, labels, calibration_rows=0, hot=hot)
        table = dict(zip(model.table.keys.tolist(), model.table.values.tolist())) | {r["key"]: r["r"] for r in model.rest.collect()}
        assert table.keys() == keys.keys() and len(model.table.keys) == min(hot, len(keys))
        assert all(abs(table[k] - keys[k]) < 1e-9 for k in keys)
        base = math.log(1 - share + share * back[1])
        assert abs(model.table.base - base) < 1e-12
        texts = [(r[0], r[1]) for r in rows[:60]]
        found = {r["doc_id"]: r["difference"] for r in toxicity.differences(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
        for i, text in texts:
            words = [w for w in ("".join(x for x in chunk.lower() if x.isalpha()) for chunk in text.split()) if w]
            own = [expected.get((h or "", w), expected.get((None, w), base)) for h, w in zip([None, *words], words)]
            assert abs(found[i] - sum(own) / len(words)) < 1e-9


def test_rows_of_the_fold_that_do_not_calibrate_are_counted(spark, comments):
    rows, _, labels = comments
    fold = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == toxicity.CALIBRATION_FOLD}
    docs = spark.createDataFrame([(i, text + " vermin" * (toxic and i in fold)) for i, text, toxic in rows], "doc_id long, text string")
    model = toxicity.fit(docs, labels, calibration_rows=60)
    value, _ = model.table.look_up(np.array([toxicity.Hashes()["vermin"]]))
    assert value[0] > 10 * abs(model.table.base)
