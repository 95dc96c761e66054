"""Operators on texts against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from raceform.llm import bottomk, decontaminate, line_runs, suffix_dedup
from raceform.llm.components import components
from raceform.llm.fm_index import FmIndex, suffix_array
from raceform.llm.suffix_sort import deep_shallow

DOCS = "doc_id bigint, text string"


def rows_of(n, seed, words=("ab", "The", "of", "é", "xyz", "\n", "qq,")):
    draw = random.Random(seed)
    text = lambda k: " ".join(draw.choice(words) + str(draw.randrange(9)) * (draw.random() < 0.3) for _ in range(k))
    base = [text(120) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "   "), (3, "one"), (4, "a" * 700), (5, "abc " * 200), (None, base[0]), (None, "nobody's own words here today")]
    for i in range(6, n):
        b, at = draw.choice(base), draw.randrange(100)
        parts = b.split(" ")
        edited = " ".join(w if draw.random() > 0.03 else text(1) for w in parts)
        rows.append((i, [b, edited, text(30) + " " + " ".join(parts[at : at + 60]) + " " + text(20), text(80)][draw.randrange(4)]))
    rows += rows[10:13]
    draw.shuffle(rows)
    return rows


def frame(spark, rows, extra="spans"):
    return spark.createDataFrame(rows, DOCS).withColumn(extra, F.lit("x")).repartition(3)


@pytest.mark.parametrize(("n", "letters"), [(1, 3), (6, 1), (300, 2), (2000, 4)])
def test_fm_index_finds_and_locates(n, letters):
    draw = np.random.default_rng(n)
    text = draw.integers(1, letters + 1, n)
    with_end = np.append(text, 0)
    assert suffix_array(with_end).tolist() == sorted(range(n + 1), key=lambda i: with_end[i:].tolist())
    index = FmIndex(text, 5)
    patterns = draw.integers(1, letters + 3, (30, 3))
    low, high = index.find(patterns)
    for p, a, b in zip(patterns, low, high, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist() if b > a else []) == [i for i in range(n - 2) if (text[i : i + 3] == p).all()]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_is_brute_force(spark, block_bytes):
    rows = rows_of(60, 1)
    items = [(1, rows[20][1]), (2, "one"), (3, None), (4, ""), (5, "ab The of é"), (5, "ab The of é"), (None, "xyz xyz xyz"), (6, rows[20][1])]
    out = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes).collect()
    phrases = [(str(i) if i is not None else "null", w[k : k + 10]) for i, t in items for w in [plain_words(t)] if w for k in range(max(1, len(w) - 9))]
    expected = []
    for doc, text in rows:
        w, hit, owners = plain_words(text), set(), set()
        for item, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    owners.add(item)
        expected.append((doc, text, len(w), sorted(hit), sorted(owners)))
    got = [(r.doc_id, r.text, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], list(r["items"])) for r in out]
    assert sorted(got, key=str) == sorted(expected, key=str)
    for r in out:
        assert r.cleaned is None if r.text is None else plain_words(r.cleaned) == [w for k, w in enumerate(plain_words(r.text)) if not any(s.start <= k < s.end for s in r.spans)]


def test_a_document_longer_than_a_shard_loses_no_hit():
    phrases = decontaminate.compile_phrases([("1", b" ".join(b"w%d" % i for i in range(10)))], 10)
    text = b"x " * 35 + b" ".join(b"w%d" % i for i in range(10)) + b" x" * 30
    for size in (7, 20, 36, 44, 1000):
        assert decontaminate.scan([text], phrases, size) == ([75], [[(35, 45)]], [{"1"}])


def test_decontamination_of_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(none, items).count() == 0
    assert [list(r.spans) for r in decontaminate.decontaminate(spark.createDataFrame([(1, "a b")], DOCS), items).collect()] == [[]]


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(rows):
    """Expected result for rows whose sets are told apart by (doc_id, set)."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    distinct = [x for x in dict.fromkeys(sets) if x]
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if 100 * len(x & y) >= 75 * len(x | y):
                root[find(x)] = find(y)
    least = {}
    for (doc, _), x in zip(rows, sets, strict=True):
        if x:
            least[find(x)] = min(doc, least.get(find(x), doc))
    return sorted((doc, len(x), least[find(x)] if x else doc, not x or doc == least[find(x)]) for (doc, _), x in zip(rows, sets, strict=True))


def test_near_duplicates_are_brute_force(spark):
    rows = [r for r in rows_of(150, 2) if r[0] is not None]
    expected = linked(rows)
    out = bottomk.near_duplicates(frame(spark, rows, "component_id")).collect()
    assert sorted(map(tuple, out)) == expected
    assert len({c for _, _, c, _ in expected}) < len({d for d, _ in rows})


def test_near_duplicates_wider_than_a_sketch(spark):
    draw, rows = random.Random(9), []
    for base in range(6):
        words = [f"b{base}w{draw.randrange(10**6)}" for _ in range(700 + 450 * base)]
        for share in [0, *(draw.uniform(0.1, 0.3) for _ in range(14))]:
            # A new tail of about this share of the set: similarities on both sides of 0.75.
            cut = int(len(words) * (1 - share / 2))
            rows.append((len(rows), " ".join(words[:cut] + [f"t{draw.randrange(10**6)}" for _ in range(len(words) - cut)])))
    expected = linked(rows)
    assert sorted(map(tuple, bottomk.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())) == expected
    assert 6 < sum(kept for *_, kept in expected) < len(rows)


def test_texts_of_shared_passages_are_no_links(spark):
    draw = random.Random(10)
    pool = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(40)]
    rows = [(i, " ".join(draw.sample(pool, 24) + [f"own{i}"])) for i in range(90)]
    rows += [(100 + i, rows[i][1] + " and a few words behind") for i in range(0, 90, 9)]
    assert sorted(map(tuple, bottomk.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())) == linked(rows)


def test_a_pair_meets_in_one_list_only(spark, monkeypatch):
    draw, met, frames = random.Random(11), [], type(spark.range(1))
    plain = frames.distinct

    def distinct(df):
        if df.columns == ["a", "b"]:
            met.append((df.count(), plain(df).count()))
        return plain(df)

    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(20)]
    rows = [(i, " ".join(passages[k] for k in range(20) if k != draw.randrange(20)) + f" own{i}") for i in range(40)]
    monkeypatch.setattr(frames, "distinct", distinct)
    assert sorted(map(tuple, bottomk.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())) == linked(rows)
    # Two hubs of a round may find each other.
    assert met and all(0 < rows_made <= 2 * pairs for rows_made, pairs in met if pairs)
    assert sum(pairs for _, pairs in met) >= 20


def test_rows_that_repeat_an_id_go_by_their_text(spark):
    a, b, c = "one two three four five six seven", "other words that copy nothing at all here", "1 2 3 4 5 6 7 8 9 10"
    rows = [(1, a), (5, a.upper()), (5, b), (3, c), (5, c), (5, None), (None, a), (None, "nobody's words stay"), (None, None), (1, a)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"gone_doc": F.lit("x"), "text_id": F.lit("y")})
    out = bottomk.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted([(1, a), (1, a), (5, b), (3, c), (5, None), (None, "nobody's words stay"), (None, None)], key=str)


def test_near_duplicates_without_ids_or_rows(spark):
    assert bottomk.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    out = bottomk.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "other words")], DOCS)).collect()
    assert sorted([tuple(r) for r in out], key=str) == sorted([(None, 2, 7, False), (7, 2, 7, True), (None, 1, None, True)], key=str)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 3), (130, 129), (130, 129)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 131)}


def removal(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.setdefault(doc, []).append((len(b), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats_are_brute_force(spark):
    rows = [r for r in rows_of(80, 3) if r[0] is not None]
    rows = list({d: (d, t) for d, t in rows}.values())
    got = {r.doc_id: [(r.n_bytes, [(s.start, s.end) for s in r.removed], hashlib.sha256(bytes(r.kept)).hexdigest())] for r in suffix_dedup.remove_repeats(frame(spark, rows, "kept")).collect()}
    assert got == removal(rows)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_and_rows_without_id_lose_all_but_one_copy(spark):
    text = "".join(random.Random(5).choices("abcdef ", k=300))
    rows = [(1, text), (1, text), (None, text), (2, None)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, len(r.kept)) for r in out) == [(0, 300), (1, 0), (1, 0), (2, 0)]


@pytest.mark.parametrize("hot", [10_000, 6, 1])
def test_steps_of_repeat_removal_with_hot_anchors(monkeypatch, hot):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "TaskContext", type("T", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)}))
    rows = [(d, t) for d, t in {r[0]: r for r in rows_of(70, 4)}.values() if d is not None]
    rows.sort()
    shards = [s for b in suffix_dedup._pack(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})])) for s in b.to_pylist()]
    assert len(shards) > 5
    meet = lambda batches, f: [r for k in sorted({r["bucket"] for b in batches for r in b.to_pylist()}) for r in f(pa.Table.from_batches(batches).filter(pa.compute.field("bucket") == k)).to_pylist()]
    dealt = list(suffix_dedup._deal(3)(iter([pa.RecordBatch.from_pylist(shards)])))
    counted = meet(dealt, suffix_dedup._count)
    for s in shards:
        s["shared"], s["hot"] = ([c[k] for c in counted if c["shard"] == s["shard"]] for k in ("shared", "hot"))
    told = meet([suffix_dedup._send_shard(s, 3) for s in shards], suffix_dedup._sort)
    for s in shards:
        s["found"] = [t["found"] for t in told if t["shard"] == s["shard"]]
    out = [r for s in shards for b in suffix_dedup._remove(iter([pa.RecordBatch.from_pylist([s])])) for r in b.to_pylist()]
    assert {r["doc_id"]: [(r["n_bytes"], [(s["start"], s["end"]) for s in r["removed"]], hashlib.sha256(r["kept"]).hexdigest())] for r in out} == removal(rows)


def test_deep_shallow_sorts_suffixes():
    draw = np.random.default_rng(0)
    for trial in range(20):
        letters = draw.integers(97, 97 + draw.integers(1, 4), 500).astype(np.uint8)
        text = np.tile(letters[: draw.integers(5, 50)], 100)[:500] if trial % 2 else letters
        group = draw.integers(0, 3, 440)
        order, equal = deep_shallow(text, np.arange(440), group, 40)
        keys = [(group[i], bytes(text[i : i + 40])) for i in order]
        assert keys == sorted(keys)
        assert equal.tolist() == [i > 0 and keys[i] == keys[i - 1] for i in range(440)]


def line_rule(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).update({doc} - {None})
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and (doc is None or doc < max(holders[key(x)])))]
        out.append((doc, text, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 7])
def test_line_dedup_is_brute_force(spark, batches):
    draw = random.Random(8)
    common = ["A licence line that many of the documents of this table share", "  Ein Absatz, den viele Dokumente gemeinsam haben, ü\t", "short", "x" * 39, "y" * 40]
    rows = [(0, None), (1, ""), (2, "\n\n"), (None, common[0]), (None, "a line of a row that has no number at all, 40")]
    rows += [(i, "\n".join(draw.choice([draw.choice(common), draw.choice(common).upper(), f"line {draw.random()}", ""]) for _ in range(draw.randrange(1, 9)))) for i in range(3, 60)]
    rows += rows[20:23] + [(20, common[1] + "\nother text of the same document")]
    out = line_runs.dedup_lines(frame(spark, rows, "n_dropped"), batches=batches).select("doc_id", "text", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, out), key=str) == line_rule(rows)


def test_line_dedup_passes_columns_named_like_its_own(spark):
    line = "a line that is long enough to be counted as a line of its own"
    names = ["_id", "_drop", "drop_doc", "Drop_Lines", "text_id", "pos", "h1", "batch", "largest"]
    docs = spark.createDataFrame([(i, f"{line}\nrow {i}") for i in range(6)], DOCS).withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    out = line_runs.dedup_lines(docs)
    assert out.columns == [*docs.columns, "kept", "n_lines", "n_dropped"]
    for r in out.collect():
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
        assert r.n_dropped == (r.doc_id < 5)


def test_line_runs_are_compacted_and_serve_later_loads(spark):
    line = "one line that comes again and again in every load of documents"
    runs = line_runs.LineRuns(spark)
    for load in range(5):
        line_runs.dedup_lines(spark.createDataFrame([(10 * load + i, line) for i in range(3)], DOCS), batches=1, runs=runs)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [r.largest for r in runs.frequent().collect()] == [42]
    assert line_runs.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
