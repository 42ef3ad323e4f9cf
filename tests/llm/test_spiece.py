import itertools
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm.spiece import BPE, NORMAL, UNIGRAM, UNKNOWN, USER, Encoder, Pieces, decode, decode_ids, encode_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "  x", "a  b   c      d", "$$$$$ ###", "\n\n\t x", "héé 𝒳 日本語", "{\r\n}\r\n;\r", "word " * 500, "=" * 500, "aaaaaaaaaaaaaaaaaaaaaaaa", "internationalization's 1234567"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces.read(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encoded(encoder, texts):
    ids, sizes = encoder.encode(texts)
    at = [0, *itertools.accumulate(sizes.tolist())]
    return [ids[a:b].tolist() for a, b in itertools.pairwise(at)]


def test_hard_texts(pieces, library):
    got = encoded(Encoder(pieces), HARD)
    assert got == library.encode(HARD)
    assert [decode(pieces, __import__("numpy").array(x, int)) for x in got] == HARD


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n$=.,ab etion▁".replace("▁", "")), st.characters(exclude_categories=["Cs"], exclude_characters="▁\x00")), max_size=60), max_size=5))
def test_any_text(pieces, library, texts):
    assert encoded(Encoder(pieces), texts) == [list(x) for x in library.encode(texts)]


def test_corpus(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = encode_texts(docs, PATH).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    assert [r["ids"] for r in rows] == library.encode([r["text"] for r in rows])


def test_unigram_takes_the_best_path():
    words = [("<unk>", 0.0, UNKNOWN), ("▁", -3.0, NORMAL), ("▁a", -2.0, NORMAL), ("ab", -2.5, NORMAL), ("a", -4.0, NORMAL), ("b", -4.0, NORMAL), ("▁ab", -5.6, NORMAL), ("abb", -3.0, NORMAL)]
    p = Pieces(words, UNIGRAM, False, True)
    got = Encoder(p).segment(["▁ab", "▁abb", "▁a", "▁zb", "▁zzb"])

    def best(word):
        paths = [()] if not word else [(w, *r) for w, s, t in words if t == NORMAL and word.startswith(w) for r in best_paths(word[len(w) :])]
        return max(paths, key=lambda x: sum(dict((w, s) for w, s, _ in words)[y] for y in x))

    def best_paths(word):
        return [()] if not word else [(w, *r) for w, _, t in words if t == NORMAL and word.startswith(w) for r in best_paths(word[len(w) :])]

    for w in ("▁ab", "▁abb", "▁a"):
        assert tuple(p.text[i] for i in got[w]) == best(w)
    assert [p.text[i] for i in got["▁zzb"]] == ["▁", "<unk>", "b"]


def test_pair_rule_follows_the_merges():
    letters = [(c, -100.0 - i, NORMAL) for i, c in enumerate("ab▁")]
    for order in itertools.permutations(["ab", "ba", "aa", "aab", "abab", "bab"], 5):
        p = Pieces([*letters, *[(x, -float(i), NORMAL) for i, x in enumerate(order)]], BPE, False, False)
        e = Encoder(p)
        for word in map("".join, itertools.product("ab", repeat=6)):
            assert [p.text[i] for i in e.segment([word])[word]] == p.merged(word)


def walked(encoder, words):
    """The pieces of distinct words as the walk in numpy finds them."""
    words = sorted(words)
    ids, sizes = encoder.pieces_of(words)
    at = [0, *itertools.accumulate(sizes.tolist())]
    return {w: tuple(ids[a:b].tolist()) for w, a, b in zip(words, at, at[1:], strict=False)}


def test_walk_follows_the_merges():
    letters = [(c, -100.0 - i, NORMAL) for i, c in enumerate("ab▁")]
    words = ["".join(w) for n in range(1, 8) for w in itertools.product("ab", repeat=n)]
    for order in itertools.permutations(["ab", "ba", "aa", "aab", "abab", "bab"], 5):
        p = Pieces([*letters, *[(x, -float(i), NORMAL) for i, x in enumerate(order)]], BPE, False, False)
        got = walked(Encoder(p), words)
        assert all([p.text[i] for i in got[w]] == p.merged(w) for w in words)


def test_walk_with_equal_scores_and_letters_without_pieces():
    rnd = random.Random(3)
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("abx", repeat=n)]
    for _ in range(40):
        parts = rnd.sample(["ab", "ba", "aa", "bb", "aab", "abab", "bab", "bba", "aabb", "xa", "bx", "abx"], 8)
        p = Pieces([("<unk>", 0.0, UNKNOWN), ("a", -9.0, NORMAL), ("b", -9.0, NORMAL), *[(x, -float(rnd.randint(1, 4)), NORMAL) for x in parts]], BPE, False, False)
        e = Encoder(p)
        assert walked(e, words) == e.segment(words)
        merges = {w: p.merged(w) for w in words}
        assert all(got == e._ids(merges[w]) for w, got in walked(Encoder(p), words).items())


def test_walk_and_single_steps_agree(pieces, monkeypatch):
    rnd = random.Random(4)
    words = {"▁" + "".join(rnd.choice("etaoinshrdlucé𝒳日'=-.") for _ in range(rnd.randint(1, 60))) for _ in range(3_000)}
    monkeypatch.setattr("foliant.llm.spiece.RUN", 100)  # many runs
    e = Encoder(pieces)
    assert walked(e, words) == Encoder(pieces).segment(list(words))


def test_unigram_walk_takes_the_best_path():
    rnd = random.Random(5)
    letters = [(c, -rnd.uniform(3, 6), NORMAL) for c in "abc"]
    parts = [("".join(w), -rnd.uniform(1, 9), NORMAL) for n in (2, 3, 4) for w in itertools.product("abc", repeat=n) if rnd.random() < 0.4]
    p = Pieces([("<unk>", 0.0, UNKNOWN), *letters, *parts], UNIGRAM, False, False)
    score = {t: s for t, s, _ in letters + parts}

    def best(word):
        sums = [0.0]
        for end in range(1, len(word) + 1):
            sums.append(max(sums[at] + score[word[at:end]] for at in range(end) if word[at:end] in score))
        return sums[-1]

    words = ["".join(w) for n in range(1, 8) for w in itertools.product("abc", repeat=n)]
    for w, got in walked(Encoder(p), words).items():
        assert "".join(p.text[i] for i in got) == w
        assert abs(sum(p.score[i] for i in got) - best(w)) < 1e-9


def test_the_older_half_of_the_words_goes(pieces, library, monkeypatch):
    monkeypatch.setattr("foliant.llm.spiece.REMEMBERED", 50)
    e = Encoder(pieces)
    for k in range(6):
        texts = [f"word {i} of {k} rows" for i in range(40)]
        assert encoded(e, texts) == library.encode(texts)
    assert len(e.known) < 100 and len(e.known) == len(e.sizes)


def test_pieces_of_the_user_are_refused():
    with pytest.raises(ValueError):
        Pieces([("ab", 0.0, USER)], BPE, False, False)


def test_clashing_names(spark):
    docs = spark.createDataFrame([("x", "some text", 1, 2)], "doc_id string, text string, ids int, n_pieces int")
    row = encode_texts(docs, PATH).first()
    assert row["n_pieces"] == len(row["ids"]) and row["doc_id"] == "x"
    named = docs.select(docs["doc_id"].alias("ids"), "text")
    assert encode_texts(named.withColumnRenamed("ids", "id"), PATH, id_col="id").first()["id"] == "x"


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a▁b"), (2, "long" * 30_000)], "doc_id long, text string")
    rows = encode_texts(docs, PATH)
    assert sorted((r["n_pieces"] > 0, r["round_trip"]) for r in rows.collect()) == [(False, True), (False, True), (True, False), (True, True)]
    assert {r["text"] for r in decode_ids(rows, PATH).collect()} == {"", "a b", "long" * 30_000}
    assert encode_texts(docs.where("false"), PATH).count() == 0
