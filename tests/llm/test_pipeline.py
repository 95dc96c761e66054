"""Stages of the corpus pipeline against brute force, each on what the one before kept."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm_texts import line_rule, plain_words, shingles

import corpus_pipeline
from raceform.llm import toxicity
from raceform.session import materialize

SHARED = "This very line stands in a good many documents of the table"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def corpus():
    draw = random.Random(11)
    words = [f"{a}{b}" for a in ("sun", "tree", "river", "stone", "cloud") for b in range(60)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(0, None), (1, ""), (2, SHARED), (3, PASSAGE), (None, text(20)), (None, None)]
    for i in range(4, 200):
        body = text(60)
        kind = i % 8
        if kind == 0:
            body += "\n" + draw.choice([SHARED, f"  {SHARED.upper()}\t"])
        elif kind == 1:
            body = f"{body[:100]} {PASSAGE.title()} {body[100:]}"
        elif kind == 2 and i > 20:
            body = rows[-9][1] + " tail" * draw.randrange(3)
        elif kind == 3:
            body += " vilegit wretchcur" * 2
        rows.append((i, body))
    rows += rows[9:11]
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(d, t, "en", draw, len(t or "")) for (d, t), draw in zip(corpus(), "aab" * 100, strict=False)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.withColumns({"kept": F.lit("x"), "score": F.lit(7)}).repartition(3).write.parquet(f"{out}/documents.parquet")
    toxic = [(d, int("vilegit" in (t or ""))) for d, t in corpus() if d is not None]
    spark.createDataFrame([*toxic, (5, None), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def results(spark, folder):
    """Rows that go into the first stage, and those that each stage returns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), f"test-{name}")
        out.append(docs.collect())
    return out


def pairs(rows):
    return sorted([(r.doc_id, r.text) for r in rows], key=str)


def test_toxic_documents_go_and_clean_ones_stay(spark, folder, results):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = toxicity.score(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert pairs(results[1]) == pairs(scored.where("predicted = 0").collect())
    assert pairs(results[1]) == sorted([p for p in corpus() if "vilegit" not in (p[1] or "")], key=str)


def test_repeated_lines_go(results):
    expected = [(doc, None if text is None else kept) for doc, text, _, dropped, kept in line_rule([(r.doc_id, r.text) for r in results[1]]) if not dropped or kept]
    assert pairs(results[2]) == sorted(expected, key=str)
    assert 0 < len(expected) and sum(SHARED.lower() in (t or "").lower() for _, t in expected) == 1


def test_one_document_of_each_group_stays(results):
    rows = [(r.doc_id, shingles(r.text)) for r in results[2] if r.doc_id is not None]
    label = {d: d for d, _ in rows}
    links = [(a, b) for a, s in rows for b, t in rows if a < b and s & t and 100 * len(s & t) >= 75 * len(s | t)]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert links
    assert pairs(results[3]) == sorted([(r.doc_id, r.text) for r in results[2] if r.doc_id is None or label[r.doc_id] == r.doc_id], key=str)


def test_benchmark_words_go(results):
    phrase = plain_words(PASSAGE)
    before = {(r.doc_id, i): r for i, r in enumerate(sorted(results[3], key=str))}
    expected, cut = [], 0
    for r in before.values():
        w, hit = plain_words(r.text), set()
        for p in (phrase[k : k + 10] for k in range(len(phrase) - 9)):
            for k in range(len(w) - 9):
                if w[k : k + 10] == p:
                    hit |= set(range(k, k + 10))
        left = [x for k, x in enumerate(w) if k not in hit]
        cut += bool(hit)
        if left or not hit:
            expected.append((r.doc_id, left))
    assert cut > 1 and all(d != 3 for d, _ in expected)
    assert sorted([(r.doc_id, plain_words(r.text)) for r in results[4]], key=str) == sorted(expected, key=str)
    untouched = {(r.doc_id, r.text) for r in results[3] if PASSAGE not in (r.text or "").lower()}
    assert untouched <= {(r.doc_id, r.text) for r in results[4]}


def test_stages_return_documents(results):
    for rows in results[1:-1]:
        assert all(tuple(r.asDict()) == corpus_pipeline.DOCUMENT for r in rows)
        assert all(r.n_chars == len(r.text) for r in rows[:] if r.text is not None)


def test_mix_takes_from_all_that_is_left(spark, folder, results):
    mixed = results[5]
    words = lambda t: len([w for w in (t or "").split(" ") if w.strip()])
    assert sorted([(r.doc_id, r["size"]) for r in mixed], key=str) == sorted([(r.doc_id, words(r.text.replace("\n", " ") if r.text else "")) for r in results[4]], key=str)
    assert all(0 <= r.taken <= 2 * r["size"] for r in mixed)
    assert sum(r.taken for r in mixed) == pytest.approx(1.5 * sum(r["size"] for r in mixed), rel=0.02)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, mixed))
