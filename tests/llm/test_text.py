"""Toxicity, packing, piece coding, URL rules and language against plain code."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from veilframe.llm import language, packing, piece_coding, registry, toxicity, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
TEXTS = ["It's fine, they'll say 10² ½ ΣΑΣ", "<|endoftext|> x", "", None, "word " * 9000, "\x1c a\x85b", "naïve ÀÉ", "naïve ÀÉ"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", 1, "?") for i, t in enumerate(texts)] + [(None, "x", None, None, None, None)], DOCS)


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs(spark), path, length=512, group=3).collect()
    for i, text in enumerate(TEXTS):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512


def test_first_fit():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 100, 200))[::-1]
    bins, _ = packing.first_fit(lengths, 100)
    room, want = [100] * 200, []
    for n in lengths:
        want.append(next(i for i, r in enumerate(room) if r >= n))
        room[want[-1]] -= n
    assert bins.tolist() == want


def test_viterbi_against_all_segmentations():
    pieces = [("a", 0, -1.0), ("b", 1, -2.0), ("ab", 2, -2.5), ("ba", 3, -2.5), ("bab", 4, -4.0), ("▁", 5, -1.0), ("▁a", 6, -1.5)]
    coder = piece_coding.PieceCoder(pieces, list(range(100, 356)))
    score = {t: s for t, _, s in pieces}

    def best(text):
        if not text:
            return 0.0
        return max(score.get(text[:n], coder.unknown if n == 1 else -1e9) + best(text[n:]) for n in range(1, min(3, len(text)) + 1))

    for text in ("abab", "babba", "aabcab", "▁abab", "ccc", "▁▁a"):
        got = sum(next((s for _, i, s in pieces if i == n), coder.unknown) for n in coder.word(text))
        assert abs(got - best(text)) < 1e-9
    for text in ("", "ab ba", " a", "  ", "▁x", "é\n💡 b"):
        assert coder.decode(coder.encode(text)) == text


def test_piece_round_trip(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = piece_coding.digest(docs(spark, [*TEXTS, "▁ a  b", "💡"]), path).collect()
    assert len(rows) == 11 and all(r["exact"] for r in rows)
    coded = piece_coding.encode(docs(spark), path)
    back = piece_coding.decode(coded, path).collect()
    assert [r["decoded"] for r in back] == [*TEXTS, "x"]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y", "https://example.org/en/15", "x://org", "ftp://fr.com/fr/", "http://notcom/fr/",
            "http://spam-farm.example.net/", "http://spamfarm.net/", "a://b://org/", "http://example.org/en/2"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_rules.filter_urls(df, registry.SITE_RULES + registry.WORD_RULES).collect()}
    assert len(got) == len(urls) + 1
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert [got[i]["rule"] for i in (4, 5, 6, 7, 11)] == ["example.org/en/1", None, "com/fr/", None, "org/"]
    assert (got[8]["verdict"], got[9]["verdict"], got[0]["verdict"]) == ("block", "allow", "allow")
    assert (got[0]["host"], got[2]["path"], got[10]["host"]) == ("", "", "b:")
    assert got[12]["rule"] == "example.org/es/"


def test_identity_swap_is_penalised(spark):
    present = [[0, 2], [0], [1], [2], [1, 3], [3]]  # 0 occurs in toxic texts only, and is an identity term
    y = np.array([1, 1, 0, 1, 0, 0], float)
    free, _ = toxicity.fit(present, y, [], 4, toxicity.Settings(swap_weight=0.0))
    tied, _ = toxicity.fit(present, y, [(0, 1), (1, 0)], 4, toxicity.Settings(swap_weight=50.0))
    assert abs(tied[0] - tied[1]) < 0.2 * abs(free[0] - free[1])


def test_toxicity_on_held_out_rows(spark):
    rows = [(i, f"some words here {i % 13} " + ("vile" if i % 4 == 0 else "kind"), "en", "s", 1, "?") for i in range(200)]
    rows += [(900, None, "en", "s", 1, "?"), (901, "", "en", "s", 1, "?")]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (901, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(200))
    assert got[900]["score"] == got[901]["score"] and 0 <= got[900]["score"] <= 1
    assert toxicity.keep_clean(df, model).columns == df.columns
    assert toxicity.score_toxicity(df, toxicity.train(df, labels.limit(0))).count() == len(rows)


def test_language(spark):
    rows = [(i, ("the quick brown fox" if i % 2 else "der schnelle braune fuchs") + f" {i}", "en" if i % 2 else "de", "s", 1, "?") for i in range(20)]
    df = spark.createDataFrame([*rows, (50, None, "en", "s", 1, "?"), (51, "123 !", None, "s", 1, "?")], DOCS)
    got = {r["doc_id"]: r for r in language.predict_language(df, language.learn_profiles(df)).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(20))
    assert (got[50]["lang_pred"], got[51]["lang_pred"], got[51]["score"]) == ("und", "und", 0.0)
    none = language.learn_profiles(df.limit(0))
    assert {r["lang_pred"] for r in language.predict_language(df, none).collect()} == {"und"}


@pytest.mark.parametrize("name", ["op2_toxicity", "op9_language_id"])
def test_accuracy_on_given_rows(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).where("held_out")
    truth = spark.read.parquet(f"{sf}/{'labels' if name[2] == '2' else 'documents'}.parquet")
    column, own = ("toxic", "predicted") if name[2] == "2" else ("lang", "lang_pred")
    rows = got.join(truth.select("doc_id", column), "doc_id").where(f"{column} is not null").collect()
    assert np.mean([r[column] == r[own] for r in rows]) > 0.85


def test_pipeline_keeps_clean_documents(spark, sf):
    at = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = at.columns, at.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == columns
        assert at.count() <= before
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == at.count() > 0.7 * before


def test_swapped_identity_terms_do_not_move_the_logit(spark):
    """Toxic texts name one group and clean ones another, with beginnings and counts as marks too."""
    toxic = [f"the muslims said muslims like word{i % 7} and vile{i % 3}" for i in range(60)]
    clean = [f"the hindus said hindus like word{i % 7} and kind{i % 3}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    for text in ("we met {} today", "{} and {} said word1"):
        logits = [model.logit(text.replace("{}", w)) for w in ("muslims", "hindus")]
        assert abs(logits[0] - logits[1]) < 0.1
    assert model.logit("vile1") - model.logit("kind1") > 0.5


def test_swapped_marks_are_those_of_the_swapped_text():
    text, groups = "Muslims muslim hindus muslims old men", toxicity.IDENTITY_GROUPS
    words = toxicity.WORD.findall(text.lower())
    want = []
    for a, b in toxicity.swaps(set(words), groups):
        old, new = toxicity.marks_of(text), toxicity.marks_of(" ".join(b if w == a else w for w in words))
        want.append((old - new, new - old))
    assert toxicity.swapped_marks(text, groups) == want
