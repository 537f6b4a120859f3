import hashlib
import importlib
import random

import numpy as np
import pytest

from barline.llm import bpe, langid, queries
from tests.llm import brute
from tests.llm.conftest import prose

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, path = random.Random(30), [], str(tmp_path_factory.mktemp("sf"))
    bench = [(i, prose(rng, 40)) for i in range(10)]
    passage = "\n".join(prose(rng, 20) for _ in range(4))
    for i in range(80):
        text = prose(rng, rng.randrange(30, 200))
        if i % 8 == 1:
            text += " " + bench[i % 10][1]
        if i % 10 == 2:
            text += "\n" + passage + "\nend"
        if i % 9 == 3:
            text = rows[i - 2][1] + " x" if rows[i - 2][1] else text
        rows.append((i, text, "en" if i % 2 else "fr", f"s{i % 3}", len(text)))
    rows += [(90, None, None, None, None), (91, "", "en", "s", 0), (92, "123 !!", "en", "s", 6), (93, rows[0][1], "fr", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, bench


def test_stages_are_named_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe_encoding"]


def test_pipeline_against_brute_force(spark, folder):
    from tokenizers import Tokenizer

    path, rows, bench = folder
    langs = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    docs = [(r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or "")]
    docs = list(brute.line_dedup(docs).items())
    classes = brute.components([i for i, _ in docs], [brute.fingerprint(t) for _, t in docs])
    docs = [(i, t) for (i, t), c in zip(docs, classes) if i == c]
    found = brute.windows(bench)
    docs = [(i, t) for i, t in docs if not brute.contamination(t, found)[4]]
    library, expected = Tokenizer.from_file(bpe.vocabulary_path()), {}
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        expected[i] = langs[i], ids, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    out = pipeline.run(spark, path)
    assert out.columns == ["doc_id", "lang", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == expected
    assert 20 < len(expected) < 80


def test_each_stage_keeps_columns_and_clean_documents(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clean = {r[0] for r in rows[:80] if r[0] % 8 != 1 and r[0] % 10 != 2 and r[0] % 9 not in (1, 3)}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.schema["text"] == docs.schema["text"]
        assert clean <= {r["doc_id"] for r in out.select("doc_id").collect()}, name
        # odd tables: nothing, and the same rows twice with a column more
        assert stage(spark, docs.limit(0), path).count() == 0
        twice = docs.unionByName(docs).withColumn("id", docs.n_chars)
        assert stage(spark, twice, path).columns == twice.columns


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in queries.queries()]
    assert names == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_language_stage_learns_only_from_what_it_is_given(spark, folder):
    path, _, _ = folder
    model = langid.fit(spark.read.parquet(f"{path}/documents.parquet"))
    assert model.langs == ["en", "fr"]


def test_near_dedup_stage_finds_every_similar_pair(spark, tmp_path):
    def grams(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    rng, texts = random.Random(31), []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 300))]
        texts.append(" ".join(words))
        for _ in range(2):
            other = list(words)
            for at in rng.sample(range(len(other)), rng.randrange(1, max(2, len(other) // 30))):
                other[at] = "changed"
            texts.append(" ".join(other))
    common = " ".join(f"c{k}" for k in range(20))
    texts += [common + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(40)]
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(texts)) for a in range(b)}
    assert sum(0.8 <= x < 0.95 for x in likeness.values()) > 40 and sum(0.6 < x < 0.8 for x in likeness.values()) > 10
    for a, b in (p for p, x in likeness.items() if x >= 0.8):
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r[0] for r in pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == sorted(set(root))
