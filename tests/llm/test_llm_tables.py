"""Packing, divergence and the Merkle manifest against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as vocabulary
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from raceform.llm import divergence, merkle, packing

VOCABULARY = vocabulary("word_bpe_49k.json")


# --- packing -------------------------------------------------------------------------------------------------------------


def whole_text_ids(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return [e.ids + [1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(rows, found, capacity):
    """Every piece once, in its place, no sequence over its capacity, no gap."""
    expected = []
    for (doc_id, _), ids in zip(rows, whole_text_ids([t for _, t in rows]), strict=True):
        for number, start in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[start : start + capacity], "<u4").tobytes()
            expected.append((str(doc_id), number, start, len(own) // 4, crc32(own)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


HARD = ["", None, "  \n\t ", "<|endoftext|> a <|startoftext|>", "don't we'll go there\r\nagain", "é ́x ΑΣ ΣΑΣ İ", "a\x1cb\x85c", "日本語のテキスト " * 30, "x" * 3000, "1234 567", "Été, ÀÖØöøÿ×÷ ßs; ŠŽ naïVe's end. end!? ...a.b, ªº µ ÿ. ﬁ Ǆ",
        "'s 's. re' n't 'LL x'll, don’t", "¡Hola! «Là» —x— 1st, 2nd. a1,"]


def test_packed_sequences_hold_all_ids(spark):
    draw = random.Random(11)
    words = ["the", "Of", "don't", "naïve", "qwzx", "12", "é!", "\n", "über-all"]
    texts = HARD + [" ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 7, 30, 90, 400]))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "no id"), (None, None), (3, "same id"), (3, "same id"), (3, "another text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sequence_id", F.lit("x")).withColumn("length", F.lit("y")).repartition(3)
    out = packing.pack_documents(docs, VOCABULARY, 64, keep_ids=True)
    found = out.pieces.collect()
    assert check_packing(rows, found, 64) == out.sequences >= out.bound
    assert out.sequences <= out.bound + 1
    sequences = {r.sequence_id: bytes(r.ids) for r in packing.filled(out).collect()}
    for r in found:
        assert crc32(sequences[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


def test_long_texts_are_tokenized_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "PIECE_CHARS", 50)
    monkeypatch.setattr(packing, "KEPT_WORDS", 5)
    words = packing.WordIds(VOCABULARY)
    for text in [*HARD[2:], "one two three " * 40, HARD[7].replace(" ", "")]:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == whole_text_ids([text])[0][:-1]


def test_nothing_to_pack(spark):
    out = packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), VOCABULARY)
    assert (out.pieces.count(), out.sequences, out.bound) == (0, 0, 0)


def fewest(lengths, capacity):
    """Least number of bins, by trying all."""
    def fits(rest, rooms):
        if not rest:
            return True
        return any(fits(rest[1:], [*rooms[:i], room - rest[0], *rooms[i + 1 :]]) for i, room in enumerate(rooms) if room >= rest[0] and room not in rooms[:i])
    return next(n for n in itertools.count(-(-sum(lengths) // capacity)) if fits(sorted(lengths, reverse=True), [capacity] * n))


def test_bound_never_exceeds_the_optimum():
    draw = random.Random(5)
    tight = 0
    for _ in range(300):
        capacity = draw.choice([7, 10, 12, 30])
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(1, 9))]
        bound, best = packing.dual_bound(np.bincount(lengths, minlength=capacity + 1))[0], fewest(lengths, capacity)
        bins, offsets, fill = packing.best_fit(np.array(lengths), capacity)
        assert bound <= best <= len(fill) and fill.max() <= capacity
        tight += bound == best
    assert tight > 270
    # Thirds and a bit: the sum says 4, no two of the largest and no three fit.
    assert packing.dual_bound(np.bincount([34] * 9, minlength=101))[0] == 5


@pytest.mark.parametrize("lengths", [[1, 3, 30, 45, 51, 60, 100], range(1, 101), [70, 71, 72, 5], [34, 35, 36]])
def test_exchange_nears_the_bound(spark, lengths):
    """Partitions of 200 pieces; best fit over all 3,000 at once is the measure."""
    draw = random.Random(8)
    rows = [(i, draw.choice(lengths)) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "id int, length bigint").repartition(4)
    alone, out = packing.pack(pieces, 100, 200, 1), packing.pack(pieces, 100, 200)
    assert out.bound == alone.bound <= out.sequences <= alone.sequences
    found = out.pieces.collect()
    assert sorted((r.id, r.length) for r in found) == rows
    at_once = len(packing.best_fit(np.array([n for _, n in rows]), 100)[2])
    assert len({r.sequence_id for r in found}) == out.sequences <= 1.012 * at_once


# --- divergence ----------------------------------------------------------------------------------------------------------


def plain_divergence(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, words in own for t in set(words))
        kept = [t for t, n in seen.items() if n >= min_docs]
        counts = {s: Counter(w for _, x, words in own if x == s for w in words) for s in {d[1] for d in own}}
        all_of = sum(counts.values(), Counter())
        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))
        def price(p, q):
            return (p - q) * (p - q) // q
        p = {s: {t: share(c, t) for t in kept} for s, c in counts.items()}
        q = {t: share(all_of, t) for t in kept}
        for s in counts:
            pairs = [(-sum(price(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-price(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("slice_terms", "top"), [(1 << 15, 200), (7, 4)])
def test_divergence_is_brute_force(spark, slice_terms, top):
    draw = random.Random(12)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "é", "Ab", "aB", "日本", "𝒳y", "x_y", "\x00"]
    rows = [(None, "en", "a"), ("", "en", "b"), ("only once", "xx", "a"), ("", "xx", "b"), (None, None, None), ("ab " * 9, "", None), ("!!", "yy", "z")]
    for i in range(120):
        source = draw.choice("aaaabcd")
        rows.append((" ".join(draw.choices(words, weights=[1 + (j + ord(source)) % 9 for j in range(len(words))], k=draw.choice([0, 1, 20, 200]))), draw.choice(["en", "en", "de", None]), source))
    rows += rows[20:23]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("item", F.lit(1)).withColumn("term", F.lit(2)).repartition(3)
    out = divergence.divergence(docs, top_terms=top, slice_terms=slice_terms)
    assert sorted(tuple(r) for r in out.collect()) == plain_divergence(rows, top=top)


def test_terms_are_counted_group_by_group():
    docs = pa.RecordBatch.from_pydict({"text": ["a b a", "b", "c b", ""], "lang": ["x", "y", "x", "z"], "source": ["s", "s", "s", ""]})
    batches = list(divergence._counted(iter([docs])))
    # A batch holds one language and source, so both are one value repeated.
    assert all(len({(r["lang"], r["source"]) for r in b.to_pylist()}) < 2 for b in batches)
    found = {tuple(r.values()) for b in batches for r in b.to_pylist()}
    assert found == {("x", "s", b"a", 2, 1), ("x", "s", b"b", 2, 2), ("x", "s", b"c", 1, 1), ("y", "s", b"b", 1, 1)}


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_stay_exact_beyond_64_bits():
    counts = np.array([0, 1, 10**17 - 1, 10**18], np.int64)
    for total, kept in ((10**18, 7), (10**15, 10**9), (3, 4)):
        own = counts[counts <= total]
        assert divergence.shares(own, total, kept).tolist() == [1 + 10**9 * (int(c) + 1) // (total + kept) for c in own]


def test_galloping_finds_what_both_have():
    draw = np.random.default_rng(4)
    for n, m in ((0, 5), (5, 0), (3, 9000), (4000, 5000), (9000, 9000)):
        a, b = (np.unique(draw.integers(0, 20000, k)) for k in (n, m))
        at = divergence.gallop(a, b)
        assert [int(b[i]) if i >= 0 else None for i in at] == [int(x) if x in set(b.tolist()) else None for x in a]


def test_long_texts_are_split_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = "Ab_cD é12日本 " * 20 + "x" * 50
    assert [w for p in divergence.pieces(text.encode()) for w in p] == [w.encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower())]


# --- manifest ------------------------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes):
    tree = [nodes]
    while len(tree[-1]) > 1:
        tree.append([H(*tree[-1][i : i + 2]) for i in range(0, len(tree[-1]), 2)])
    return tree


def plain_way(tree, at):
    way = []
    for level in tree[:-1]:
        beside = at ^ 1
        way.append((beside < at, level[beside] if beside < len(level) else ""))
        at >>= 1
    return way


def plain_manifest(rows):
    """Rows as the query returns them; rows are (doc_id, source, lang, n_chars, text)."""
    first = lambda v: (v is not None, v or 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    held = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (first(r[0]), plain_leaf(*r))) for lang in langs}
    trees = {lang: plain_tree([plain_leaf(*r) for r in held[lang]]) for lang in langs}
    over = plain_tree([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, r in enumerate(held[lang]):
            way = plain_way(trees[lang], at) + plain_way(over, place)
            altered = r[0] is not None and r[3] is not None and crc32(str(r[0]).encode()) % 7 == 0
            node = plain_leaf(*r[:3], r[3] + 1, r[4]) if altered else plain_leaf(*r)
            for left, beside in way:
                node = H(beside, node) if left else H(node, beside)
            out.append((r[0], plain_leaf(*r), trees[lang][-1][0], over[-1][0], H(*[b for _, b in way]), node, node == over[-1][0]))
    return sorted(out, key=str)


def manifest_rows(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    docs = docs.withColumn("position", F.lit("x")).withColumn("branch", F.lit("y")).withColumn("node", F.lit(1)).repartition(3)
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf(*[F.col(f).cast("decimal(20,0)") + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS]))
    return merkle.manifest(docs, claim=claim, **more)


@pytest.mark.parametrize(("levels", "per_range"), [(10, 1 << 20), (2, 20), (1, 5)])
def test_manifest_is_brute_force(spark, levels, per_range):
    draw = random.Random(13)
    rows = [(i, draw.choice(["a", None, "é"]), draw.choice(["en", "en", "en", "de"]), draw.choice([None, i, 2**63 - 1]), "t" * (i % 5) or None) for i in range(90)]
    rows += [(None, None, None, None, None), (None, "a", None, 3, ""), (2**53 + 1, "a", None, 1, "x"), (5, "b", "en", 1, "another"), (7, "", "", 0, ""), (8, "-", "Z", 1, "0:")] + rows[40:43] * 2
    out = manifest_rows(spark, rows, levels=levels, rows_per_range=per_range, keep_proof=True).rows.collect()
    got = sorted(((r.doc_id, *[bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], r.verified) for r in out), key=str)
    assert got == plain_manifest(rows)
    for r in out:
        assert H(*[p[1:] for p in r.proof]) == bytes(r.proof_sha256).hex()
        assert merkle.fold(bytes(r.leaf), r.proof) == bytes(r.root)
    assert not all(r.verified for r in out)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "x")], [(1, "a", "en", 1, "x"), (1, "a", "de", 1, "x")]])
def test_small_manifests(spark, rows):
    out = manifest_rows(spark, rows)
    got = [(r.doc_id, *[bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], r.verified) for r in out.rows.collect()]
    assert sorted(got, key=str) == plain_manifest(rows)
    assert {(r.branch, r.total) for r in out.subroots.collect()} == {("=" + lang, n) for lang, n in Counter(r[2] for r in rows).items()}
