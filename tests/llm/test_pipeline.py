import random

import pytest

import corpus_pipeline
from basinframe.llm import pieces

from .test_decontaminate import slow as slow_hits
from .test_language import documents
from .test_simhash import slow_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(7)
    made = [(k, t, lang, f"src{k % 3}", len(t)) for k, t, lang in documents(200)]
    item = " ".join(f"item{k}" for k in range(30))
    made += [(900 + k, made[k][1], "aa", "copy", 1) for k in range(5)]
    made.append((910, item, "aa", "leak", len(item)))
    filler = " ".join(f"w{rng.randrange(10**6)}" for _ in range(900))
    made.append((911, f"{filler} {item}", "aa", "small leak", 1))
    made += [(920, None, None, None, None), (921, "", "aa", "x", 0), (922, "12 34", "aa", "x", 5), (0, made[0][1], "aa", "again", 1)]
    return made, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    made, items = rows()
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_matches_brute_force(spark, folder):
    made, items = rows()
    known = sorted({(d, t) for d, t, *_ in made if t and any(c.isalpha() for c in t)})
    label = slow_classes([t for _, t in known])
    texts = {d: t for k, (d, t) in enumerate(known) if label[k] == k}
    hits = {d: (n, h) for d, n, h, _ in slow_hits(list(texts.items()), items)}
    want = {d for d in texts if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])}
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    own = pieces.Pieces(*pieces.load())
    for r in got:
        text = texts[r.doc_id].replace(items[0][1], "")
        assert r.text == text and own.encode(text) == pieces.np.array(r.ids, "int32").tobytes() and r.round_trip
    assert {910} & want == set() and 911 in want


def test_stages_on_empty_tables_and_other_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("match", pieces.F.lit(1)).withColumn("kept_id", pieces.F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, folder)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            out.collect()


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "pieces"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_copies_at_likeness_0_8_go(spark, folder):
    """One to four changed words of 200 are far more than two bits of a fingerprint; 20 are below the likeness."""
    docs = []
    for g in range(30):
        words = [f"g{g}w{k}" for k in range(200)]
        for d, changed in enumerate((0, 1, 2, 4, 20)):
            text = " ".join("other" if k % 9 == 4 and k // 9 < changed else w for k, w in enumerate(words))
            docs.append((10 * g + d, text, None, f"s{d}", len(text)))
    docs += [(None, docs[0][1], None, "copy", 1), (0, docs[0][1], None, "again", 1), (None, "a lone text", None, "x", 1), (5, None, None, "x", None)]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(docs, SCHEMA), folder).collect()
    want = [d for g in range(30) for d in (10 * g, 10 * g + 4)]
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted([*want, 5])
    assert [r.text for r in out if r.doc_id is None] == ["a lone text"]
