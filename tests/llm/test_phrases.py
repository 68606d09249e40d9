import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from basinframe.llm import phrases

FORM = {c: c + 32 for c in range(65, 91)}


def brute(rows, most=3, least=10, covered=50, best=2000):
    counts, out = {}, []
    for lang, text in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FORM)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, most + 1):
                own.update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    for lang, own in counts.items():
        total = sum(n for p, n in own.items() if len(p) == 1)
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q)))]
            if any(100 * b >= covered * a for b in longer):
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total, -score))
    return sorted(out)


def docs_of(spark, rows):
    return spark.createDataFrame([(k, *r, "clash") for k, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(5)


@pytest.mark.parametrize("most", [2, 3, 4])
def test_against_counts_in_memory(spark, most):
    draw = random.Random(most)
    vocabulary = ["the", "The", "of", "a\x01b", "a", "a\x00", "é", "x y", "b", "ab", "\x08", "zz\U0001f600"]
    gaps = [" ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b ", " ", " ", " "]
    rows = []
    for k in range(200):
        rows.append((draw.choice(["en", "de", None, "und", "", "a\x00b"]), "".join(draw.choice(vocabulary) + draw.choice(gaps) for _ in range(draw.randrange(60)))))
    rows += [("en", "new york city hall")] * 40 + [("en", "hot hot hot hot hot")] * 30 + [("fr", None), ("fr", ""), ("xx", " .,; \t")]
    got = sorted(tuple(r) for r in phrases.collocations(docs_of(spark, rows), most_words=most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, most)


def test_ranks_are_cut_after_ties(spark):
    rows = [("en", ". ".join(f"w{k} v{k}" for k in range(30)))] * 12
    got = phrases.collocations(docs_of(spark, rows), best=7).orderBy("rank").collect()
    assert [(r["rank"], r.phrase) for r in got] == list(enumerate(sorted(f"w{k} v{k}" for k in range(30))[:7], 1))


def spelt(batches):
    """(language, words) of keys and their counts."""
    out = Counter()
    for batch in batches:
        for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lang, *words = key[2:].translate(phrases._BACK).split(b"\x00")[:-1]
            out[lang, tuple(words)] += n
    return out


@pytest.mark.parametrize("size", [1, 5, 40, 1000])
def test_long_texts_are_cut_in_parts(size):
    draw = random.Random(size)
    for most in (2, 3, 4):
        rows = [(draw.choice(["en", None]), "".join(draw.choice(["a", "bb", "c" * 9, " ", "  ", ".", "\n", "é", "\t"]) for _ in range(draw.randrange(120)))) for _ in range(30)]
        want = Counter()
        for lang, text in rows:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                words = piece.encode().split()
                want.update(((lang or "und").encode(), tuple(words[k : k + most])) for k in range(len(words)))
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[k : k + 7], strict=True)], names=["lang", "text"]) for k in range(0, 30, 7)]
        assert spelt(phrases._counted(most, size)(batches)) == want


@pytest.mark.parametrize("step", [1, 2, 3, 50])
def test_the_stack_goes_on_from_batch_to_batch(step):
    draw = random.Random(step)
    keys = Counter()
    for _ in range(300):
        words = [draw.choice(["a", "b", "ab", "c"]) for _ in range(draw.randrange(1, 4))]
        keys[b"\x01\x01" + draw.choice([b"de", b"en"]) + b"\x00" + b"".join(w.encode() + b"\x00" for w in words)] += draw.randrange(1, 4)
    rows = [(k, n) for key, total in sorted(keys.items(), reverse=True) for k, n in [(key, 1)] * (total > 1) + [(key, total - (total > 1))]]
    want = Counter()
    for key, n in rows:
        lang, *words = key[2:].split(b"\x00")[:-1]
        for k in range(len(words) + 1):
            want[lang.decode(), k, " ".join(w.decode() for w in words[:k])] += n
    stack, got = phrases.Stack(5), Counter()
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        for out in [*stack.push(pa.array([k for k, _ in part], pa.binary()), np.array([n for _, n in part]))]:
            got.update({(r["lang"], r["words"], r["phrase"]): 0 for r in out.to_pylist()})
            for r in out.to_pylist():
                got[r["lang"], r["words"], r["phrase"]] += r["f"]
    for out in stack.close():
        for r in out.to_pylist():
            got[r["lang"], r["words"], r["phrase"]] += r["f"]
    assert got == Counter({k: n for k, n in want.items() if k[1] < 2 or n >= 5})


def test_scores_beyond_64_bits(spark):
    big = 10**13
    counts = spark.createDataFrame(
        [("en", 0, "", 10 * big), ("en", 1, "a", 3 * big + 1), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 3)], "lang string, words int, phrase string, f long"
    )
    (row,) = phrases.scored(counts).collect()
    assert row.score == 10**6 * (big - 3) ** 2 // ((3 * big + 1) * (big + 7))


def test_empty_table(spark):
    assert phrases.collocations(docs_of(spark, [("en", "a")]).limit(0)).collect() == []
