import hashlib
import random
import re

import pytest

from basinframe.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items):
    grams = {}
    for name, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                names = grams.get(tuple(w[i : i + n]))
                if names:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in names if x is not None}
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "De", "ß", "é9", "zz"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([0, 1 + 6, 8, 12, 13, 14, 20, 30, 40, 60])]
    items += [(10, None), (None, text(15)), (4, text(16)), (11, items[8][1]), (12, "!!! ???")]
    docs = [(k, text(rng.randint(0, 200))) for k in range(60)]
    for k in range(60, 100):
        cut = items[rng.choice([4, 5, 6, 7, 8, 9])][1].split()
        i = rng.randint(0, max(0, len(cut) - 13))
        passage = " ".join(cut[i : i + rng.randint(10, 20)]).upper().replace(" ", rng.choice([" ", "--", "\n"]))
        docs.append((k, f"{text(30)} {passage}. {text(30)}"))
    docs += [(100, None), (101, ""), (102, "?!"), (7, docs[7][1]), (None, items[9][1]), (103, "q " * 30_000 + items[9][1] + " q" * 30_000)]
    return docs, items


def made(spark, tables):
    docs, items = tables
    d = spark.createDataFrame([(i, t, "clash", len(t or "")) for i, t in docs], "doc_id long, text string, match string, n_chars long")
    return d, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_matches_brute_force(spark, tables, block):
    docs, items = made(spark, tables)
    got = decontaminate.scan(docs, items, into="found", block_bytes=block).collect()
    assert sorted(((r.doc_id, r.found.n_words, r.found.n_hit, r.found["items"]) for r in got), key=str) == slow(*tables)


def test_longest_match_is_right(spark):
    items = spark.createDataFrame([(1, "p q r s t u v w x y z a b c d e")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "no p q r s t u v w x y z a b c no")], "doc_id long, text string")
    assert decontaminate.scan(docs, items).first().match.longest == 14


def test_spans_are_cut_and_contaminated_rows_dropped(spark):
    passage = " ".join(f"w{k}" for k in range(14))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    long = "É " * 400
    docs = spark.createDataFrame(
        [(1, passage), (2, f"{long}{passage} end", ), (3, "clean"), (4, None), (5, "")], "doc_id long, text string"
    ).withColumn("n_chars", decontaminate.F.length("text").cast("long"))
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert sorted(got) == [2, 3, 4, 5]
    assert got[2].text == f"{long} end" and got[2].n_chars == len(got[2].text)
    assert got[3].text == "clean" and got[4].text is None and got[5].text == ""


def test_empty_tables(spark, tables):
    docs, items = made(spark, tables)
    none = items.limit(0)
    assert decontaminate.scan(docs.limit(0), items, into="found").collect() == []
    assert all(r.found.n_hit == 0 for r in decontaminate.scan(docs, none, into="found").collect())


def test_digest_columns(spark, tmp_path, tables):
    docs, items = made(spark, tables)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontaminate.op2_decontaminate(spark, str(tmp_path)).collect()
    want = sorted(
        ((d, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0 and 20 * h >= n) for d, n, h, f in slow(*tables)),
        key=str,
    )
    assert sorted((tuple(r) for r in got), key=str) == want
