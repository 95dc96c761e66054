"""Chat formatting, mixing, search, models and surrogates: brute force, round trips and held-out accuracy."""

import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from raceform.llm import chat, hamming, masked_lm, mixing, surrogates, toxicity

DOCS = "doc_id bigint, text string"
SF = "/root/testdata/sf0.01"
HOSTILE = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>", "\\", "\\\\<|", "<", "|end|>", "<|next|>", "$1 \\n", "", None, "é\n", "[INST", "<<SYS>>a<</SYS>>"]


def test_chats_read_back_as_they_were(spark):
    draw = random.Random(1)
    rows = [(c, draw.choice([None, 1, 2, 3, 4]), draw.choice(["user", "assistant", "assistant", "sys\ntem<|", None]), draw.choice(HOSTILE)) for c in (None, 1, 2, 3) for _ in range(14)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("spans", F.lit(1)))
    out = out.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("spans"))}).collect()
    assert len(out) == 4
    for r in out:
        turns = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [tuple(t) for t in r.turns] == [t[2:] for t in turns]
        assert r.loss == "".join(t[3] for t in turns if t[2] == "assistant")
        runs = [role for i, (_, _, role, _) in enumerate(turns) if not i or turns[i - 1][2] != role]
        assert r.formatted.count(chat.TURN) == len(runs)
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def mixed(spark, rows, **more):
    return mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("taken", F.lit("x")).repartition(3), **more)


def test_mix_meets_targets_and_interleaves(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 5, 40, 900])), draw.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)] + [(0, None, "e"), (None, "x y", "a"), (5, "same row", "b"), (5, "same row", "b")]
    out = mixed(spark, rows)
    docs = out.documents.collect()
    assert len(docs) == len(rows)
    assert all(0 <= d.taken <= 2 * d["size"] for d in docs)
    sources = out.sources.collect()
    assert math.isclose(sum(s.target for s in sources), 1.5 * sum(d["size"] for d in docs))
    assert all(s.target <= 2 * s.source_size for s in sources)
    pieces = out.pieces.collect()
    assert sum(p.n_words for p in pieces) == sum(d.taken for d in docs)
    for s in sources:
        assert sum(p.n_words for p in pieces if p.source == s.source) == s.words
    # Any first part of the mix holds each source in its share, but for a few blocks.
    pieces.sort(key=lambda p: p.slot)
    total, words = sum(s.target for s in sources), 0
    seen = dict.fromkeys([s.source for s in sources], 0)
    for p in pieces[: int(0.9 * len(pieces))]:
        words += p.n_words
        seen[p.source] += p.n_words
        assert all(abs(seen[s.source] - words * s.target / total) <= 12 * max(s.block_words, p.n_words) for s in sources)
    assert sorted(map(str, mixed(spark, rows[::-1]).documents.collect())) == sorted(map(str, docs))


def test_mix_of_nothing(spark):
    assert mixed(spark, []).documents.count() == 0
    assert [d.taken for d in mixed(spark, [(1, None, "a"), (2, "", None)]).documents.collect()] == [0, 0]


def test_block_size_does_not_change_what_is_taken(spark):
    rows = [(i, "w " * (i % 50), "ab"[i % 2]) for i in range(200)]
    assert sorted(map(tuple, mixed(spark, rows, block_words=7).documents.collect())) == sorted(map(tuple, mixed(spark, rows).documents.collect()))


@pytest.mark.parametrize(("shard", "block"), [(1 << 18, 1 << 13), (40, 3)])
def test_nearest_is_brute_force(spark, shard, block):
    draw = np.random.default_rng(3)
    codes = [int(x) for x in draw.integers(-(2**63), 2**63 - 1, 150)]
    rows = [(i, c ^ (1 << int(draw.integers(0, 62))) if i % 3 else codes[0]) for i, c in enumerate(codes)] + [(500, None), (None, 1), (7, codes[3])]
    table = spark.createDataFrame(rows, "id bigint, code bigint").withColumn("distance", F.lit(1))
    got = hamming.nearest(table, table.where("id % 50 = 0 and id < 500"), 5, shard, block).collect()
    known = [r for r in rows if None not in r]
    expected = []
    for q, code in known:
        if q % 50 == 0:
            near = sorted(((code ^ c) & (2**64 - 1)).bit_count() * 10**6 + i for i, c in known if i != q)[:5]
            expected += [(q, x % 10**6, x // 10**6, n + 1) for n, x in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_nearest_with_few_rows(spark):
    one = spark.createDataFrame([(0, 5), (1, 4)], "id bigint, code bigint")
    assert [tuple(r) for r in hamming.nearest(one, one.where("id = 0")).collect()] == [(0, 1, 1, 1)]
    assert hamming.nearest(one.limit(0), one.limit(0)).count() == 0
    vectors = spark.createDataFrame([(1, [0.5, -1.0, 2.0, None]), (2, None), (3, [])], "id bigint, vector array<float>")
    assert [tuple(r) for r in hamming.sign_codes(vectors).collect()] == [(1, 5), (2, None), (3, 0)]
    full = spark.createDataFrame([(1, [-1.0] * 63 + [1.0])], "id bigint, vector array<float>")
    assert [r.code for r in hamming.sign_codes(full).collect()] == [-(2**63)]
    with pytest.raises(Exception, match="65"):
        hamming.sign_codes(spark.createDataFrame([(1, [1.0] * 65)], "id bigint, vector array<float>")).collect()


def test_masked_scores_are_those_of_a_plain_loop():
    draw = np.random.default_rng(4)
    vocabulary = masked_lm.Vocabulary(draw.integers(0, 50, masked_lm.BUCKETS))
    weights = masked_lm.start_weights() * 5
    model = masked_lm.Model(vocabulary, weights)
    texts = [b"the cat sat on the mat", None, b"", b"  ", b"one", b"a b " * 300]
    sizes, sums = model.score(texts)
    embed, inner, outer, bias = (w.astype(float) for w in masked_lm.unpack(weights))
    for text, size, total in zip(texts, sizes, sums, strict=True):
        ids = masked_lm.bucket_ids(text, masked_lm.Buckets())
        line = [masked_lm.EDGE] * 2 + [int(vocabulary.classes[i]) for i in ids] + [masked_lm.EDGE] * 2
        expected = 0.0
        for t, bucket in enumerate(ids):
            hidden = np.tanh(inner + sum(embed[i][line[t + 2 + o]] for i, o in enumerate((-2, -1, 1, 2))))
            logits = hidden @ outer + bias
            expected += logits[line[t + 2]] - np.log(np.exp(logits).sum()) + vocabulary.share[bucket]
        assert size == len(ids)
        assert math.isclose(total, expected, rel_tol=1e-4, abs_tol=1e-6)


def test_training_steps_follow_the_gradient():
    draw = np.random.default_rng(5)
    parts = [w.astype(np.float64) for w in masked_lm.unpack(masked_lm.start_weights())]
    target, around = draw.integers(0, masked_lm.CLASSES, 50), draw.integers(0, masked_lm.CLASSES + 1, (4, 50))

    def loss(weights):
        logits = masked_lm.forward(weights, around)[1]
        return float(np.mean(np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(50), target]))

    moved = [w.copy() for w in parts]
    masked_lm.step(moved, target, around, 1e-3)
    for i, at in ((0, (1, int(around[1][0]), 3)), (1, (2,)), (2, (5, int(target[0]))), (3, (int(target[0]),))):
        up, down = [w.copy() for w in parts], [w.copy() for w in parts]
        up[i][at] += 1e-4
        down[i][at] -= 1e-4
        assert math.isclose((parts[i][at] - moved[i][at]) / 1e-3, (loss(up) - loss(down)) / 2e-4, rel_tol=0.05, abs_tol=2e-3)


def masked_scores(texts, network):
    """Scores by a plain loop that counts contexts without the masked word; ``network`` gives the log-probability of each word's bucket."""
    lines = [["", *t.lower().split(), ""] for t in texts if t and t.split()]
    spots = [(x[i - 1], x[i], x[i + 1]) for x in lines for i in range(1, len(x) - 1)]
    words, pairs = [w for x in lines for w in x[1:]], [p for x in lines for p in itertools.pairwise(x)]
    bucket = {w: int(masked_lm.bucket_ids(w.encode(), masked_lm.Buckets())[0]) for w in words if w}
    single, pair, around, whole = Counter(words), Counter(pairs), Counter((a, c) for a, _, c in spots), Counter(spots)
    buckets = Counter(bucket[w] for w in words if w)
    for x in lines:
        total, logs = 0.0, iter(network(" ".join(x[1:-1])))
        for a, w, c in ((x[i - 1], x[i], x[i + 1]) for i in range(1, len(x) - 1)):
            base = math.exp(next(logs)) * single[w] / buckets[bucket[w]]
            one = [(pair[p] - 1 + masked_lm.ONE_PRIOR * base) / (single[s] - 1 + masked_lm.ONE_PRIOR) for p, s in (((a, w), a), ((w, c), c))]
            total += math.log((whole[a, w, c] - 1 + masked_lm.BOTH_PRIOR * sum(one) / 2) / (around[a, c] - 1 + masked_lm.BOTH_PRIOR))
        yield total


@pytest.mark.parametrize("block", [masked_lm.BLOCK, 40])
def test_whole_words_are_scored_by_their_contexts_in_the_corpus(spark, block, monkeypatch):
    draw = random.Random(12)
    texts = [" ".join(f"w{int(draw.paretovariate(0.7))}" for _ in range(draw.randrange(1, 60))) for _ in range(80)]
    texts += [texts[3], "w1 W1 w1", "alone"]
    rows = list(enumerate([*texts, None, "", "  "]))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    fitted = []
    monkeypatch.setattr(masked_lm, "BLOCK", block)
    plain_fit = masked_lm.fit
    monkeypatch.setattr(masked_lm, "fit", lambda *a: fitted.append(plain_fit(*a)) or fitted[-1])
    out = {r.doc_id: r for r in masked_lm.pseudo_likelihood(docs, rounds=1).collect()}
    model = masked_lm.Model(*fitted[0])
    network = lambda t: model.token_logs([masked_lm.bucket_ids(t.encode(), masked_lm.Buckets())])
    expected = list(masked_scores(texts, network))
    assert len(out) == len(rows) and all(out[i].n_tokens == len(t.split()) for i, t in enumerate(texts))
    assert all(math.isclose(out[i].log_likelihood, e, rel_tol=1e-4) for i, e in enumerate(expected))
    assert all((out[i].n_tokens, out[i].log_likelihood, out[i].mean_log_likelihood) == (0, 0.0, None) for i in range(len(texts), len(rows)))


def test_a_copy_of_a_rare_document_is_told_from_one_that_stands_alone(spark):
    draw = random.Random(13)
    texts = [" ".join(f"t{draw.randrange(3000)}" for _ in range(120)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:5]])), "doc_id int, text string").repartition(4)
    out = {r.doc_id: r.mean_log_likelihood for r in masked_lm.pseudo_likelihood(docs, rounds=1).collect()}
    assert min(out[i] for i in [*range(5), *range(100, 105)]) > max(out[i] for i in range(5, 100)) + 3


def test_both_sides_help_to_predict(spark):
    draw = random.Random(6)
    pairs = [("red", "apple"), ("blue", "sky"), ("green", "leaf"), ("old", "stone")]
    text = lambda: " ".join(" ".join(draw.choice(pairs)) for _ in range(1500))
    rows = [(i, text()) for i in range(60)] + [(60, None), (61, ""), (62, " ".join(draw.sample(text().split(), 3000)))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("x")).coalesce(1)
    out = {r.doc_id: r for r in masked_lm.pseudo_likelihood(docs, rounds=8).collect()}
    ordered = np.mean([out[i].mean_log_likelihood for i in range(60)])
    # Each word is one of eight; the neighbours leave one.
    assert ordered > -1.0 > out[62].mean_log_likelihood
    assert (out[60].n_tokens, out[60].log_likelihood, out[60].mean_log_likelihood) == (0, 0.0, None)
    assert masked_lm.pseudo_likelihood(docs.limit(0)).count() == 0


def test_the_default_training_uses_both_sides(spark):
    draw = random.Random(9)
    pairs = [("red", "apple"), ("blue", "sky"), ("green", "leaf"), ("old", "stone")]
    docs = spark.createDataFrame([(i, " ".join(" ".join(draw.choice(pairs)) for _ in range(1500))) for i in range(60)], DOCS).coalesce(1)
    # Frequencies alone give -2.08 a token, as do weights that saw little.
    assert masked_lm.pseudo_likelihood(docs).agg(F.avg("mean_log_likelihood")).first()[0] > -1.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs.withColumn("predicted", F.lit("x")), labels).join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0).select("score", "predicted", "toxic").collect()
    pairs = [(a.score, b.score) for a in out if a.toxic == 1 for b in out if b.toxic == 0]
    assert sum(a > b for a, b in pairs) / len(pairs) > 0.8
    assert np.mean([r.predicted for r in out if r.toxic == 0]) < 0.1


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "vile words" if i % 4 == 0 else "kind words") for i in range(200)] + [(500, None), (501, "")], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    scores = lambda known: sorted(map(tuple, toxicity.score(docs, known).select("doc_id", "score", "predicted").collect()))
    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    got = scores(labels)
    assert got == scores(turned)
    assert all(p == (d % 4 == 0) for d, _, p in got if d < 200)
    assert all(0 <= s <= 1 for _, s, _ in got)
    assert got == scores(labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (700, None)], labels.schema)))
    assert {s for _, s, _ in scores(labels.where("toxic = 0"))} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_without_documents_in_training_folds(spark):
    ids = spark.range(400).withColumn("fold", toxicity.fold(F.col("id")))
    held = [r.id for r in ids.where("fold = 0").limit(3).collect()]
    labels = ids.where("fold != 0").select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    prior = labels.agg(F.avg("toxic")).first()[0]
    out = toxicity.score(spark.createDataFrame([(i, t) for i, t in zip(held, ("vile words", "", None), strict=True)], DOCS), labels).collect()
    assert [(r.score, r.predicted) for r in out] == [(pytest.approx(prior, abs=1e-6), 0)] * 3


def test_negative_part_of_the_risk_is_not_negative():
    few, many = [b"vile"] * 5, [b"vile"] * 5 + [b"kind"] * 45
    weights = toxicity.train(few, many, 0.1)
    assert np.isfinite(weights).all()
    scorer = toxicity.Scorer(weights)
    assert scorer.score(b"vile") > 0.5 > scorer.score(b"kind")


TEXTS = [
    (1, "Write to Anna.Berg@mail.example.com or +1 (456) 555-2186. Mr. John Smith from 10.20.255.7."),
    (2, "MR. SMITH has card 4539 1488 0343 6467 and anna.berg@mail.example.com, token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\""),
    (3, "Госпожа Анна Петрова, 123-45-6789; 7536784127813050 4845168114407329"),
    (4, "Nothing here, version 3.0."), (5, None), (6, ""), (4, "Nothing here, version 3.0."),
]


def test_surrogates_keep_kind_format_and_reference(spark):
    docs = spark.createDataFrame(TEXTS, DOCS).withColumn("n_mentions", F.lit("x"))
    out = surrogates.pseudonymize(docs).collect()
    new = {r.doc_id: r.replaced for r in out}
    assert len(out) == len(TEXTS)
    assert (new[4], new[5], new[6]) == (TEXTS[3][1], None, "")
    assert {r.doc_id: r.n_mentions for r in out} == {1: 5, 2: 4, 3: 5, 4: 0, 5: 0, 6: 0}
    for doc, text in TEXTS[:3]:
        old, now = surrogates.mentions(text), surrogates.mentions(new[doc])
        assert [m[2] for m in old] == [m[2] for m in now]
        assert not {m[3] for m in old} & {m[3] for m in now}
    shape = lambda text: "".join("9" if c.isdigit() else c for c in text)
    phone = [new[1][a:b] for a, b, kind, _ in surrogates.mentions(new[1]) if kind == "phone"]
    assert [shape(p) for p in phone] == ["+9 (999) 999-9999"]
    emails = [[n for *_, kind, n in surrogates.mentions(new[d]) if kind == "email"] for d in (1, 2)]
    surnames = [[n for *_, kind, n in surrogates.mentions(new[d]) if kind == "surname-latin"] for d in (1, 2)]
    assert emails[0] == emails[1] and surnames[0] == surnames[1]
    assert "MR. " + surnames[1][0].upper() in new[2]
    card = next(n for *_, kind, n in surrogates.mentions(new[2]) if kind == "card")
    assert surrogates.luhn(card) == surrogates.luhn("4539148803436467") == 0
    assert surrogates.pseudonymize(docs.limit(0)).count() == 0


def test_surrogates_pass_columns_named_like_their_own(spark):
    names = ["entities", "map", "_row", "ROW", "kind", "normal", "surrogate", "map_"]
    docs = spark.createDataFrame(TEXTS, DOCS)
    out = surrogates.pseudonymize(docs.withColumns({n: F.lit(n) for n in names}))
    assert out.columns == [*docs.columns, *names, "replaced", "n_mentions"]
    rows = out.collect()
    assert all(r[n] == n for r in rows for n in names)
    assert sorted(map(str, surrogates.pseudonymize(docs).collect())) == sorted(map(str, out.drop(*names).collect()))


def test_surrogates_of_a_crowded_space_stay_distinct(spark):
    known = [("ip", f"{a}.{b}.1.1") for a in range(1, 10) for b in range(1, 10)] + [("given-f-latin", f"name{i}") for i in range(400)]
    out = surrogates.assign(spark.createDataFrame(known * 2, "kind string, normal string")).collect()
    assert {(r.kind, r.normal) for r in out} == set(known)
    assert len({(r.kind, r.surrogate) for r in out}) == len(known)
    assert not {(r.kind, r.surrogate) for r in out} & set(known)
    assert all(r.surrogate.endswith("na") for r in out if r.kind == "given-f-latin")
    assert surrogates.surrogate("ip", "1.2.3.4", 0, b"a") != surrogates.surrogate("ip", "1.2.3.4", 0, b"b")


def test_surrogates_of_full_spaces_grow_their_format(spark):
    rows = [(0, "password: -------- and token=________"), (1, None), (2, "")]
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows += [(10 + i, " ".join(f"{i}.{a}.{b}.{c}" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10))) for i in range(1, 10)]
    rows += [(100 + i, " ".join(f"{x}@{y}.io" for y in letters)) for i, x in enumerate(letters)]
    rows += [(200, "mail A@B.io or call +1 23 45"), (201, "call +1 23-45")]
    out = {r.doc_id: r for r in surrogates.pseudonymize(spark.createDataFrame(rows, DOCS)).collect()}
    known = {m[2:] for _, t in rows for m in surrogates.mentions(t or "")}
    assert len(known) == 9**4 + 26**2 + 3
    new = {}
    for doc, text in rows:
        for old in surrogates.mentions(text or ""):
            new.setdefault(old[2:], set())
        if 10 < doc < 200:
            for old, now in zip(text.split(), out[doc].replaced.split(), strict=True):
                new[surrogates.mentions(old)[0][2:]].add(surrogates.mentions(now)[0][2:])
    spaces = [now for old, now in new.items() if old[0] in ("ip", "email")]
    assert all(len(now) == 1 for now in spaces)
    drawn = set().union(*spaces)
    assert len(drawn) == 9**4 + 26**2 and not drawn & known
    (address,) = new["email", "a@b.io"]
    written = out[200].replaced.split()[1]
    assert written.lower() == address[1] and written != written.lower()
    assert out[200].replaced.split("call ")[1].replace(" ", "") == out[201].replaced.split("call ")[1].replace(" ", "").replace("-", "") != "+12345"
    secrets = [now[len(old):] for old, now in zip(("password: --------", "token=________"), out[0].replaced.split(" and "), strict=True)]
    assert all(1 <= len(more) <= 3 and more.isalpha() for more in secrets)
    assert (out[1].replaced, out[2].replaced) == (None, "")
