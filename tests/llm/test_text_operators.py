import random

import numpy as np
import pytest

from barline.llm import bpe, decontam, linededup, simhash, tokencount
from tests.llm import brute
from tests.llm.conftest import prose


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- SimHash


def test_simhash_against_brute_force(spark, odd_docs):
    rng, docs = random.Random(1), []
    for i in range(120):
        text = prose(rng, 60)
        docs.append((i, text))
        if i % 3 == 0:
            words = text.split()
            words[rng.randrange(60)] = "changed"
            docs.append((1000 + i, " ".join(words)))
    docs += [(5000, ""), (5001, None)]
    values = [brute.fingerprint(t) for _, t in docs]
    expected = {(i, f"{v:016x}", c) for (i, _), v, c in zip(docs, values, brute.components([i for i, _ in docs], values))}
    assert set(rows_of(simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))) == expected


def test_simhash_links_at_four_bits_and_by_chains(spark):
    rng = random.Random(2)
    values = []
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(6)):
            values.append(v)
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5, 6])):
                v ^= 1 << b
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for hot in (8192, 2):  # the second splits every bucket
        found = rows_of(simhash.components(simhash.links(df, hot=hot)))
        label = {v: v for v in signed} | dict(found)
        groups = {}
        for v in signed:
            groups.setdefault(label[v], set()).add(v)
        expected = {}
        for v, c in zip(signed, brute.components(list(range(len(values))), values)):
            expected.setdefault(c, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_simhash_odd_rows(odd_docs, empty_docs):
    found = rows_of(simhash.near_duplicates(odd_docs))
    assert len(found) == odd_docs.count()
    by_id = {r[0]: r for r in found}
    assert by_id[2][1] == by_id[3][1] == by_id[4][1] == "0" * 16 and by_id[4][2] == 2
    assert by_id[12][2] == by_id[11][2] == 10 and by_id[6][2] == by_id[5][2] == 5
    assert simhash.near_duplicates(empty_docs).count() == 0
    kept = simhash.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r[0] for r in rows_of(kept.where("doc_id is not null"))) == [1, 2, 5, 7, 8, 10]
    assert simhash.dedup(empty_docs).count() == 0


def test_bucket_forest_spans_but_does_not_list_pairs():
    fps = np.arange(4, dtype=np.uint64).repeat(1)
    more = np.unique(np.concatenate([fps, np.uint64(1) << np.arange(40, dtype=np.uint64)]))
    a, b = simhash.bucket_forest(np.zeros(len(more), np.int64), more, 4, simhash.pivots())
    assert len(a) == len(more) - 1


# --- decontamination


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(3)
    return [(i, prose(rng, 30)) for i in range(20)] + [(20, "short item here"), (21, ""), (22, None), (23, "Short, ITEM here!")]


def test_decontamination_against_brute_force(spark, bench):
    rng, docs = random.Random(4), []
    for i in range(100):
        text = prose(rng, 200)
        if i % 4 == 0:
            part = bench[i % 20][1].split()[5 : 5 + rng.choice([12, 13, 20])]
            text = text[:100] + "! " + ", ".join(part).upper() + " " + text[100:]
        if i % 10 == 1:
            text += " short ITEM\nhere"
        docs.append((i, text))
    docs += [(200, None), (201, "")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    expected = {(i, *brute.contamination(t, brute.windows(bench))) for i, t in docs}
    for most in (2_000_000, 100):  # the second takes several passes
        found = rows_of(decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), items, max_words=most))
        assert set(found) == expected


def test_decontamination_edits(spark, bench, odd_docs, empty_docs):
    items = spark.createDataFrame(bench, "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b, short item here; c"), (2, "clean text " * 50), (3, None)], "doc_id long, text string")
    assert rows_of(decontam.decontaminate(docs, items, how="spans").where("doc_id = 1")) == [(1, "a b, ; c")]
    assert sorted(r[0] for r in rows_of(decontam.decontaminate(docs, items))) == [2, 3]
    for rows in (odd_docs, empty_docs):
        out = decontam.decontaminate(rows, items)
        assert out.columns == rows.columns and out.count() == rows.count()
        assert decontam.report(rows, items).count() == rows.count()
        assert decontam.report(rows, items.limit(0)).where("n_items > 0").count() == 0


def test_decontamination_counts_items_of_null_id(spark):
    items = spark.createDataFrame([(None, "one two three"), (7, "four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three"), (2, "a one two three four five six"), (3, "none of these")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.report(docs, items).collect()}
    assert found == {1: (3, 0, True), 2: (6, 1, True), 3: (0, 0, False)}
    assert [r[0] for r in rows_of(decontam.decontaminate(docs, items))] == [3]


# --- line deduplication


def test_lines_are_the_text():
    rng = random.Random(6)
    for n in (0, 1, 5, 300):
        text = prose(rng, n).replace(" seven", "\n\nseven").encode()
        assert b"".join(linededup.lines_of(text)) == text


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(7)
    passages = ["\n".join(prose(rng, rng.choice([4, 8, 40])) for _ in range(6)) for _ in range(5)]
    docs = []
    for i in range(60):
        parts = [prose(rng, 30) for _ in range(4)]
        if i % 2:
            parts.insert(2, rng.choice(passages))
        if i % 7 == 0:
            parts += [passages[0], passages[0]]
        docs.append((i, "\n".join(parts)))
    found = dict(rows_of(linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))))
    expected = brute.line_dedup(docs)
    assert found == expected
    assert any(found[i] != t for i, t in docs) and sum(found[i] == t for i, t in docs) > 20


def test_line_dedup_removes_planted_passages(spark):
    rng = random.Random(8)
    passage = " ".join(prose(rng, 12) + "." for _ in range(6))
    docs = [(i, prose(rng, 40) + ".\n" + passage + "\n" + prose(rng, 40)) for i in range(8)]
    found = dict(rows_of(linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))))
    middle = " ".join(passage.split()[15:60])
    assert middle in " ".join(found[0].split())
    assert all(middle not in " ".join(found[i].split()) for i in range(1, 8))


def test_line_dedup_odd_rows(odd_docs, empty_docs):
    out = linededup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r["doc_id"], []).append(r["text"])
    assert by_id[2] == [None] and by_id[3] == [""] and len(by_id[11][0]) < len(by_id[10][0]) / 2
    assert len(by_id[1]) == 2 and by_id[1][0] == by_id[1][1] != ""
    assert len(by_id[6][0]) < 5000
    assert linededup.dedup_lines(empty_docs).count() == 0
    assert linededup.dedup_lines(odd_docs.select("doc_id", "text"), counted=True).where("n_removed > 0").count() > 0


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "àâçéèêëîïôûùüÿœ", "абвгдежзиклмнопрст"])
@pytest.mark.parametrize("most", [2, 5, 12, 16, 60])
def test_lines_of_a_passage_are_alike_wherever_it_stands(letters, most):
    rng = random.Random(most)

    def words(n):
        return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(n)]

    for _ in range(50):
        passage, left = [], 51
        while left:
            own = words(min(left, rng.randrange(1, most + 1)))
            left -= len(own)
            own[-1] += rng.choice(".!?")
            passage += own
        passage = " ".join(passage if rng.random() < 0.5 else [*passage[:-1], passage[-1][:-1]])
        places = ["", "Yes. ", "  ", *(" ".join(words(rng.randrange(1, 30))) + rng.choice([" ", ". ", "\n"]) for _ in range(3))]
        texts = [(p + passage + rng.choice(["", "\n", " ", ". "]) + " ".join(words(rng.randrange(20)))).encode() for p in places]
        of, _, keys, _ = linededup.windows_of(texts)
        assert all(b"".join(linededup.lines_of(t)) == t for t in texts)
        assert set.intersection(*(set(keys[of == k].tolist()) for k in range(len(texts))))


# --- tokens


def test_token_counts_against_brute_force(spark, odd_docs, empty_docs):
    pieces = tokencount.fit(odd_docs)
    assert abs(sum(np.exp(list(pieces.values()))) - 1) < 1e-9 and pieces["▁the"] > pieces["▁Java"]
    unknown = min(pieces.values()) - 10
    assert sorted(rows_of(tokencount.count_tokens(odd_docs)), key=str) == sorted(rows_of(tokencount.count_tokens(odd_docs, model=pieces)), key=str)
    for r in tokencount.count_tokens(odd_docs.where("doc_id not in (5, 6) or doc_id is null")).join(odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        words = (r["text"] or "").split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(brute.tokens("▁" + w, pieces, unknown) for w in words))
    assert tokencount.count_tokens(odd_docs).count() == odd_docs.count()
    assert tokencount.count_tokens(empty_docs).count() == 0


def test_token_counts_are_those_of_a_unigram_library():
    from tokenizers import Tokenizer, models

    pieces = dict.fromkeys(tokencount.Pieces().names())
    rng = random.Random(16)
    pieces = {p: -rng.uniform(5, 15) for p in pieces}
    model = Tokenizer(models.Unigram([("<unk>", -100.0), *pieces.items()], 0, False))
    counter, rng = tokencount.TrieCounter(pieces), random.Random(9)
    words = {"▁" + "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 12))) for _ in range(300)}
    found = counter.count(list(words))
    assert sum(found[w] == len(model.encode(w).ids) for w in words) >= len(words) - 1  # sums of floats may tie otherwise


# --- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


TEXTS = ["Hello  World's <|endoftext|> the é 123 日本İ !!?? x́", "a<|ENDOFTEXT|>b  <|startoftext|>c", "İ ß ﬁ x​y\x1cq\x85z ΑΣ don't ’s he'LL", "", " ", "é́ Å ǅ 〖", "a" * 5000, "　全角 空白", "<|startoftext|><|endoftext|>", "x" + "́" * 30]


def test_bpe_is_the_library(spark, odd_docs, library):
    rng = random.Random(10)
    texts = TEXTS + [prose(rng, 100) for _ in range(20)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    for r in bpe.encode(docs).collect():
        ids = library.encode(texts[r["doc_id"]] if r["doc_id"] < 900 else "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_random_unicode(library):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encoder = bpe.Encoder(bpe.WordBpe(open(bpe.vocabulary_path(), encoding="utf-8").read()))
    # characters that newer Unicode versions than the library's added are left out
    alphabet = st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet, max_size=40))
    def same(text):
        ids = library.encode(text, add_special_tokens=False).ids
        own = np.frombuffer(encoder.ids(text), "<u4")
        assert own.tolist() == ids and encoder.bpe.decode(own) == library.decode(ids, skip_special_tokens=False)

    same()


def test_lexicon_is_minimal_and_exact():
    entries = {b"walk": [1], b"walks": [1, 2], b"talk": [3], b"talks": [4, 5, 6], b"w": [7], "é".encode(): [8]}
    lexicon = bpe.Lexicon(bytearray(bpe.compile_lexicon(entries)))
    assert {w: np.frombuffer(lexicon.get(w), "<u4").tolist() for w in entries} == entries
    assert all(lexicon.get(w) is None for w in (b"", b"wal", b"walkss", b"x"))
    # the tails of walk(s) and talk(s) are shared but for w, which is a word
    assert lexicon.n_states < 12
    assert bpe.Lexicon(bytearray(bpe.compile_lexicon({}))).get(b"a") is None


def test_bpe_round_trip_and_odd_rows(spark, odd_docs, empty_docs):
    whole = bpe.encode(odd_docs)
    again = bpe.decode(whole.select("doc_id", "ids"))
    assert sorted(map(str, rows_of(again))) == sorted(map(str, rows_of(whole.select("doc_id", "decoded"))))
    assert bpe.encode_digests(odd_docs).count() == odd_docs.count() and bpe.encode_digests(empty_docs).count() == 0


def test_line_dedup_deals_hot_windows_out(spark):
    rng = random.Random(15)
    shared = ".\n".join(prose(rng, 14) for _ in range(5))
    docs = [(i, prose(rng, 30) + ".\n" + shared + ".\n" + prose(rng, 30)) for i in range(300)]
    out = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert dict(rows_of(out)) == brute.line_dedup(docs)
    # the windows are made and shuffled once
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("MapInArrow") == 2 and "ReusedExchange" in plan, plan
