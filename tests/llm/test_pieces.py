import random

import numpy as np
import pytest
import sentencepiece

from basinframe.llm import pieces

ALPHABET = " " * 6 + "abcdefghtheinonABC.,\n\tΩé超😀0123"


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(*pieces.load()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def texts():
    rng = random.Random(6)
    out = ["", " ", "  ", "\n", "\n\n a", "x\n", "x" * 3000, " " * 500, "the " * 400]
    for k in range(1500):
        x = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        out.append(x.replace(" ", " " * rng.randint(1, 37)) if k % 5 == 0 else x)
    return out


def test_ids_are_those_of_the_reference_encoder(model):
    own, library = model
    for x in texts():
        assert np.frombuffer(own.encode(x), np.int32).tolist() == library.encode(x), repr(x)


def test_round_trip(model):
    own, _ = model
    for x in [*texts(), "a▁b ▁", "▁", "\x00\x01"]:
        assert own.decode(np.frombuffer(own.encode(x), np.int32)).decode() == x


def test_bounded_tables_do_not_change_ids(model, monkeypatch):
    own, library = model
    for name in ("WORDS_KEPT", "PAIRS_KEPT"):
        monkeypatch.setattr(pieces, name, 3)
    for x in texts()[:200]:
        assert np.frombuffer(own.encode(x), np.int32).tolist() == library.encode(x)


def test_unigram_path_is_the_best_one():
    rng = random.Random(2)
    some = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"]
    scored = [(k + 3, p, -rng.random() * 5) for k, p in enumerate(some)]
    own = pieces.Pieces("unigram", scored, None, 0)
    value = {p: s for _, p, s in scored}

    def best(text):
        table = [(0.0, [])]
        for i in range(1, len(text) + 1):
            options = [(table[j][0] + value[text[j:i]], [*table[j][1], own.number[text[j:i]]]) for j in range(i) if text[j:i] in value]
            options.append((table[i - 1][0] + own.worst, [*table[i - 1][1], 0]))
            table.append(max(options, key=lambda o: o[0]))
        return table[-1]

    for _ in range(300):
        x = "".join(rng.choice("abc x") for _ in range(rng.randint(1, 12)))
        ids = np.frombuffer(own.encode(x), np.int32).tolist()
        total = sum(value[own.text[i]] if i else own.worst for i in ids)
        assert total == pytest.approx(best("▁" + x.replace(" ", "▁"))[0])


def test_through_spark(spark):
    rows = [(1, "The cat  sat"), (1, "The cat  sat"), (2, None), (3, ""), (None, "Ωx"), (4, "long " * 20_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, decoded string, N_Tokens int")
    got = pieces.tokenised(docs).collect()
    assert len(got) == len(rows)
    assert {r.round_trip for r in got if r.text is not None} == {True}
    assert [(r.ids, r.n_tokens, r.round_trip) for r in got if r.doc_id == 2] == [(None, 0, None)]
    assert [r.ids for r in got if r.doc_id == 3] == [[]]
    assert pieces.tokenised(docs.limit(0)).collect() == []


def test_relaxed_sums_are_the_best_of_all_paths():
    """Against every way to cut short texts, with the model's scores and with made-up ones that tie."""
    import random

    rng = random.Random(3)
    made = [(n, t, -float(rng.randint(1, 4))) for n, t in enumerate(["a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "▁ab", "cc", "▁c"])]
    models = [pieces.Pieces("bpe", made, None, 99), pieces.Pieces("unigram", made, None, 99), pieces.Pieces(*pieces.load())]

    def best(own, text, cost):
        values = [0.0] + [None] * len(text)
        for end in range(1, len(text) + 1):
            steps = [values[start] + own.score[text[start:end]] for start in range(end) if text[start:end] in own.score and not (own.kind == "bpe" and end - start > 1 and not text[start:end].strip("▁"))]
            values[end] = max(steps, default=values[end - 1] + cost)
        return values[-1]

    for own in models:
        for _ in range(200):
            text = "".join(rng.choice("abc d ") for _ in range(rng.randint(1, 12)))
            assert own.relaxed(text).real == pytest.approx(best(own, "▁" + text.replace(" ", "▁"), own.worst)), text
        assert own.relaxed("") == 0


def test_query_has_the_best_sum_beside_the_ids(spark, tmp_path):
    texts = ["one two", "", None, "a  b\nc", "é " * 2000, "one two"]
    spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, read string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pieces.op5_pieces(spark, str(tmp_path)).collect()}
    own = pieces.Pieces(*pieces.load())
    for k, t in enumerate(texts):
        if t is None:
            assert got[k].best_score is None and got[k].n_best is None and got[k].ids is None
        else:
            assert complex(got[k].best_score, got[k].n_best) == own.relaxed(t) and got[k].round_trip and got[k].n_tokens == len(got[k].ids)


class Counted:
    """An automaton that counts its passes."""

    def __init__(self, automaton):
        self.automaton, self.passes = automaton, 0

    def iter(self, text):
        self.passes += 1
        return self.automaton.iter(text)


def test_ids_and_sums_are_told_in_one_pass_over_each_new_word():
    one, other = pieces.Pieces(*pieces.load()), pieces.Pieces(*pieces.load())
    odd = ["", "a", "\n", "a\nb c", " a  b ", "▁", "x▁y é☃ 𝔘", "\t\t", "q" * 60 + " " + "z" * 49, "a\n\nb a\n\nb", "é 日本 word word"]
    for text in odd * 2:
        assert one.both(text) == (other.encode(text), other.relaxed(text))
    one.automaton = Counted(one.automaton)
    one.both("seven words that none has said before" + " plainly" * 5)
    assert one.automaton.passes <= 8


def test_what_no_piece_joins_is_learnt_once():
    """A line feed or a comma behind a known word needs no pass over that word, and the ids and sums are those of the whole text."""
    own, plain = pieces.Pieces(*pieces.load()), pieces.Pieces(*pieces.load())
    own.both("some words that were said before\nnow")
    own.automaton = Counted(own.automaton)
    text = "some, words. that,\nnow were,,\nnow said;\nnow. before\nnow"
    ids, total = own.both(text)
    assert own.automaton.passes <= 2
    part = "▁" + text.replace(" ", "▁")
    assert total == plain.best(part) and np.frombuffer(ids, np.int32).tolist() == plain.viterbi(part)


def test_a_full_table_keeps_what_was_met_since(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 40)
    own = pieces.Pieces(*pieces.load())
    own.both("often")
    own.automaton = Counted(own.automaton)
    for k in range(100):
        own.both(f"often x{k}q")
    assert own.automaton.passes <= 101
