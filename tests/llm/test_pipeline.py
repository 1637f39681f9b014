"""The pipeline's stages one after another against plain loops over the same rows."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import langid, pieces

from .fixtures import frame, texts
from .test_duplicates import near_duplicates, without_byte_matches
from .test_texts import alnum, contamination

LONG, OTHER = (" ".join(f"{c}{k}" for k in range(40)) for c in "bq")


def documents():
    """texts() with languages, junk without a letter, benchmark passages, and rows without an id or a language."""
    rows = [(k, t, ["en", "de", None][k % 3]) for k, t in texts(5, 50) if k != 209]
    rows += [(300, "12345 --- 678", "en"), (301, LONG, "en"), (302, "intro words " + " ".join(OTHER.split()[:20]), None), (303, " ".join(f"n{k}" for k in range(600)) + " " + " ".join(LONG.split()[:14]), "de")]
    return rows


def plain_chain(spark, rows, items, langs):
    """(doc_id, text, lang) that are left, in plain Python; langs: predicted languages by id, which a test of their own holds."""
    left = [(k, t, lang or langs[k]) for k, t, lang in rows if t and any(c.isalpha() for c in t)]
    kept = near_duplicates([(k, t) for k, t, _ in left])
    left = [(k, t, lang) for k, t, lang in left if kept[k][2]]
    firsts, cut = {}, []
    for k, t, lang in sorted(left):
        b = t.encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if firsts.setdefault(b[i : i + 50], k) < k:
                gone[i : i + 50] = [True] * 50
        cut.append((k, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else t, lang))
    assert {k: v[1] for k, v in without_byte_matches([(k, t) for k, t, _ in left]).items() if v[1]}  # something is cut
    bad = {x[0] for x in contamination([(k, t) for k, t, _ in cut], items) if x[4]}
    return [x for x in cut if x[0] not in bad], bad


def test_stages_one_after_another(spark, tmp_path):
    rows, items = documents(), [(1, LONG), (2, "never seen at all"), (3, OTHER)]
    docs = frame(spark, [(k, t) for k, t, _ in rows]).drop("lang").join(spark.createDataFrame([(k, lang) for k, _, lang in rows], "doc_id long, lang string"), "doc_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    langs = {r.doc_id: r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), langid.train(langid.training_rows(docs))).collect()}
    want, bad = plain_chain(spark, rows, items, langs)
    assert {301, 302} <= bad and 303 not in bad
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == sorted(want)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for r in got:
        assert list(r.tokens) == library.encode(r.text) and r.n_tokens == len(r.tokens) and r.decoded == library.decode(list(r.tokens))
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, tmp_path, name):
    docs = frame(spark, [(1, "some words")]).where(F.lit(False))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.count() == 0 and (name == "sentencepiece" or out.columns == docs.columns)
    assert alnum("") == []
