"""Operators with one right answer, against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pathlib import Path
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, lm, mixing, pii, queries, search, tokens, urlfilter
from tidemark.llm.graph import components

SF = str(Path("/root/testdata") / "sf0.001")


def words(text):
    return (text or "").encode().lower().split()


def nearly(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Copies, a group of near copies too large for one chunk, chains, and texts that share a passage."""
    rng = random.Random(4)
    word = lambda: f"v{int(rng.paretovariate(0.7)) % 5000}"
    texts = [[word() for _ in range(rng.randint(1, 120))] for _ in range(120)]
    base = [word() for _ in range(110)]
    texts += [nearly(rng, base, rng.choice([0, 1, 2, 3, 6])) for _ in range(230)]
    passage = [word() for _ in range(50)]
    texts += [[word() for _ in range(8)] + passage + [word() for _ in range(rng.randint(0, 9))] for _ in range(60)]
    chain = [word() for _ in range(140)]
    for _ in range(25):
        texts.append(list(chain))
        at = rng.randrange(len(chain))
        chain[at] = word() + "z"
    texts += [["tiny"], ["tiny"], ["tiny", "Two"], ["tiny", "two"], []]
    rows = [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard_components(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(df).collect()}
    assert got == brute_components(corpus)
    kept = {r["doc_id"] for r in jaccard.keep_one(df).collect()}
    assert kept == {c for _, c in got.values()}


def test_jaccard_when_shingles_are_common_in_a_batch(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 3)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(df).collect()}
    assert got == brute_components(corpus)


def test_jaccard_odd_rows(odd, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(odd).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2)] == [(1, 4, 1), (2, 4, 1), (2, 4, 1)]
    assert [g for g in got if g[0] in (3, 4, 5)] == [(3, 0, 3), (4, 0, 4), (5, 0, 5)]
    assert {g for g in got if g[0] in (20, 40)} == {(20, 977, 20), (40, 978, 20)}
    assert len(got) == 11 and jaccard.classes(empty).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (1, 2, 20, 40)").count() == 2


def test_one_of_each_group_stays_without_ids_too(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " end"), (None, None), (None, None), (7, None), (7, None), (None, "tiny"), (3, "tiny"), (5, "other tiny"), (5, "other tiny")]
    kept = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    rest = [(None, None), (None, None), (7, None), (7, None), (3, "tiny"), (5, "other tiny")]
    assert any(sorted(kept, key=str) == sorted([(None, one), *rest], key=str) for one in (text, text + " end"))


def linked_by_force(sets, percent=75):
    out = set()
    for b in range(len(sets)):
        for a in range(b):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                out.add((a, b, both))
    return out


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_skip_join_gives_every_pair(percent):
    """Pairs and overlaps, of random sets, their near copies, and copies of copies; most are derived and not compared."""
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 60, 900).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(3, 90))) for _ in range(25)]
    for s in sets[:15]:
        for _ in range(rng.integers(0, 9)):
            s = np.unique(np.concatenate([rng.choice(s, max(1, len(s) - int(rng.integers(0, 6))), replace=False), rng.choice(pool, int(rng.integers(0, 6)))]))
            sets.append(s)
    want = linked_by_force(sets, percent)
    assert len(want) >= 25
    assert set(jaccard.skip_join(sets, [len(s) for s in sets], [-1] * len(sets), percent)) == want
    known = [0 if i < 40 else -1 for i in range(len(sets))]
    assert set(jaccard.skip_join(sets, [len(s) for s in sets], known, percent)) == {(a, b, n) for a, b, n in want if b >= 40}


def test_answers_of_near_copies_are_derived():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(200)[:198]], rng.integers(0, 1 << 60, 2).astype(np.uint64)])) for _ in range(60)]
    join = jaccard.Join(sets, [len(s) for s in sets], [-1] * 60, 75)
    for i in sorted(range(60), key=lambda i: (len(sets[i]), i)):
        join.add(i)
    assert sum(map(len, join.answers)) == 60 * 59 and join.compared < 4 * 60
    assert {(i, j, n) for j, found in enumerate(join.answers) for i, n in found.items() if i < j} == linked_by_force(sets)


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(64)] + [(2000, 2001 + i) for i in range(50)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for e in links if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def search_by_force(rows, every=20, k=10):
    """BM25 of every text for every whole text that asks, from the definition; ranks of the best."""
    texts = [words(t) for _, t in rows]
    live = [i for i, w in enumerate(texts) if w]
    df = Counter(w for i in live for w in set(texts[i]))
    average = sum(map(len, texts)) / max(1, len(live))
    found = []
    for i in live:
        if rows[i][0] is None or rows[i][0] % every:
            continue
        scored = []
        for j in live:
            points = 0
            for w in set(texts[i]) & set(texts[j]):
                if df[w] > 1:
                    tf, idf = texts[j].count(w), math.log(1 + (len(live) - df[w] + 0.5) / (df[w] + 0.5))
                    points += math.floor(idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len(texts[j]) / average)) * 1_000_000 + 0.5)
            if points and j != i:
                scored.append((-points, rows[j][0] is None, rows[j][0] or 0))
        found += [(rows[i][0], r, None if null else d, -p / 1_000_000) for r, (p, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


def found_by(df, **options):
    return sorted(((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in search.top_k(df, **options).collect()), key=str)


def test_search_equals_brute_force(spark, corpus):
    rows = [*corpus, (20, "v1 v2"), (40, None), (None, "v3 v4 tiny"), (60, ""), (80, "v1 v1 v1 nowhere"), (100, "alone")]
    for parts in (1, 7):  # one shard, and seven that hand their queries around
        assert found_by(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)) == search_by_force(rows)


def test_search_in_groups_of_queries(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "GROUP_BYTES", 4000)
    rows = corpus[:120]
    assert found_by(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), every=2, k=3) == search_by_force(rows, 2, 3)


def test_a_shard_prunes_and_stays_exact():
    """Bounds of blocks rule out most of a shard of 3,000 documents, and the best are those of scoring all."""
    rng = np.random.default_rng(5)
    n, terms = 3000, 400
    lists = [np.sort(rng.choice(n, max(2, int(n * rng.random() ** 4)), replace=False)) for _ in range(terms)]
    many = np.array([len(x) for x in lists])
    points = rng.integers(1, 1000, many.sum()).astype(np.uint32) * np.repeat(1 + 20_000 // many, many).astype(np.uint32)
    row = search.Shard.stored(list(range(n)), np.arange(terms, dtype=np.uint64), many, np.concatenate(lists), points)
    shard = search.Shard(row["ids"], *(row[c] for c in search._STORED))
    scored = []
    shard._scores = lambda docs, score=shard._scores: (scored.append(len(docs)), score(docs))[1]
    for _ in range(30):
        asked = np.sort(rng.choice(terms, 60, replace=False))
        full = np.zeros(n, np.int64)
        for t in asked:
            np.add.at(full, lists[t], points[many[:t].sum() : many[: t + 1].sum()])
        best = sorted((-p, i) for i, p in enumerate(full.tolist()) if p and i != 7)[:10]
        for floor in (0, -best[-1][0]):
            numbers, scores = shard.top(shard.places(asked.astype(np.uint64)), 7, floor, 10)
            assert [(-p, i) for i, p in zip(numbers.tolist(), scores.tolist(), strict=True)] == best
    assert np.mean(scored) < n / 4


def test_frequent_lists_are_not_read_for_each_query():
    """A query with a floor reads a posting of its other lists once at most and no document's own words; ties, frequent words alone and impacts beyond 24 bits stay exact."""
    rng = np.random.default_rng(6)
    n, terms = 2000, 300
    lists = [np.sort(rng.choice(n, n - 10 * t if t < 100 else int(rng.integers(2, 60)), replace=False)) for t in range(terms)]
    many = np.array([len(x) for x in lists])
    points = (rng.integers(1, 40, many.sum()) * np.repeat(1 + 20_000 // many, many)).astype(np.uint32)
    starts = np.cumsum(many) - many
    points[starts[3] : starts[4]] += np.uint32((1 << 24) + 1)
    row = search.Shard.stored(list(range(n)), np.arange(terms, dtype=np.uint64), many, np.concatenate(lists), points)
    shard = search.Shard(row["ids"], *(row[c] for c in search._STORED))
    read = []
    shard._sums = lambda blocks, sums=shard._sums: (read.append(int(shard.block_sizes[blocks].sum())), sums(blocks))[1]
    shard._scores = lambda docs, score=shard._scores: (read.append(int(shard.doc_many[docs].sum())), score(docs))[1]
    for turn in range(20):
        asked = np.sort(rng.choice(100 if turn % 4 == 0 else terms, 80, replace=False))
        full = np.zeros(n, np.int64)
        for t in asked:
            full[lists[t]] += points[starts[t] : starts[t] + many[t]]
        best = sorted((-p, i) for i, p in enumerate(full.tolist()) if p)[:10]
        for floor in (0, -best[-1][0], -best[3][0]):
            read.clear()
            numbers, scores = shard.top(shard.places(asked.astype(np.uint64)), -1, floor, 10)
            assert [(-p, i) for i, p in zip(numbers.tolist(), scores.tolist(), strict=True)] == [b for b in best if -b[0] >= floor]
        rare = asked[(many[asked] * 24 <= n) | (asked == 3)]
        assert sum(read) <= many[rare].sum()


def test_a_shard_scores_many_queries_together(monkeypatch):
    """Parts of queries, with or without floors, of their own documents or of others, null ids and copies give what scoring every document gives."""
    monkeypatch.setattr(search, "BATCH_POSTINGS", 700)
    rng = np.random.default_rng(8)
    n, terms, k = 1003, 240, 10
    lists = []
    for t in range(terms):  # words of two languages, so of the first or the last documents, few of them frequent
        some = np.arange(600) if t % 2 else np.arange(600, n)
        lists.append(np.sort(rng.choice(some, int(rng.integers(150, 400)) if t < 24 else int(rng.integers(2, 40)), replace=False)))
    matrix = np.zeros((terms, n), np.int64)
    for t, x in enumerate(lists):
        matrix[t, x] = rng.integers(1, 40, len(x)) * (1 if t < 24 else 30)
    matrix[:, 50:70] = matrix[:, 50:51]  # copies, so ties beyond the best
    points = [matrix[t][matrix[t] > 0] for t in range(terms)]
    numbers = [np.flatnonzero(matrix[t]) for t in range(terms)]
    many = np.array([len(x) for x in numbers])
    ids = [None if i % 90 == 0 else int(x) for i, x in enumerate(rng.permutation(n))]
    row = search.Shard.stored(ids, np.arange(terms, dtype=np.uint64), many, np.concatenate(numbers), np.concatenate(points).astype(np.uint32))
    shard = search.Shard(row["ids"], *(row[c] for c in search._STORED))
    asked = [np.sort(rng.choice(np.arange(q % 2, terms, 2 if q % 5 else 1), 40, replace=False)) for q in range(150)]
    asked[7] = asked[7][:0]
    asked[50] = np.flatnonzero(matrix[:, 50])
    own = np.where(np.arange(150) % 3 == 0, np.arange(150) * 6, -1)
    want = []
    for q, at in enumerate(asked):
        full = matrix[at].sum(axis=0)
        want.append(sorted((-int(p), ids[i] is None, ids[i] or 0, i) for i, p in enumerate(full) if p and i != own[q])[:k])
    floors = np.array([0 if q % 4 == 0 or len(w) < k else -w[-1 - q % 3][0] + q % 2 for q, w in enumerate(want)])
    read, parts = [], []
    monkeypatch.setattr(shard, "_read", lambda who, at, queries, f=shard._read: (read.append(int(shard.many[at].sum())), f(who, at, queries))[1])
    monkeypatch.setattr(shard, "_part", lambda names, *x, f=shard._part: (parts.append(len(names)), f(names, *x))[1])
    who = np.repeat(np.arange(150), [len(x) for x in asked])
    query, docs, scores = shard.tops_of(who, np.concatenate(asked), own, floors, k)
    for q, w in enumerate(want):
        mine = [(-int(s), ids[d] is None, ids[d] or 0, int(d)) for d, s in zip(docs[query == q], scores[query == q], strict=True)]
        assert mine == [x for x in w if -x[0] >= floors[q]]
    assert len(parts) == 1 and sum(read) <= sum(many[at][many[at] * search.FREQUENT <= n].sum() for at in asked)


def test_search_visits_few_shards_first(spark, corpus, monkeypatch):
    """Of 64 shards the first round's scores are floors for the others, which then hand over fewer hits a shard."""
    rows = [(i, t) for i, (_, t) in enumerate(corpus * 2)]
    hits = []

    def settle(df, label, *a, **b):
        out = stored(df, label, *a, **b)
        if label == "search-hits":
            hits.append((out.count(), out.select("shard").distinct().count()))
        return out

    stored = search.settle
    monkeypatch.setattr(search, "settle", settle)
    assert found_by(spark.createDataFrame(rows, "doc_id long, text string").repartition(64), k=2) == search_by_force(rows, k=2)
    (first, few), (second, others) = hits
    assert few < others and second / others < first / few


def test_search_odd_rows(odd, empty):
    assert search.top_k(empty).count() == 0
    got = [(r["query_id"], r["doc_id"]) for r in search.top_k(odd).collect()]
    assert (20, 40) in got and (40, 20) in got


def test_token_counts(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    rng = random.Random(6)
    pieces = [*" \n\tab'sT1.é漢\xa0\x85\x1c　", "<|endoftext|>", "'ll", "  ", "!?"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 200))) for _ in range(400)] + ["x" * 500, " " * 300]
    small = tokens.Counter(path, chunk=48, overlap=4)
    usual = tokens.Counter(path)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert usual.counts(texts) == want
    assert small.counts(texts) == want
    got = sorted(tuple(r)[1:] for r in tokens.count_tokens(odd, path).collect())
    plain = [(r["text"] or "") for r in odd.collect()]
    assert got == sorted((len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for t in plain)
    assert tokens.count_tokens(empty, path).count() == 0


def test_huge_texts_are_counted_by_overlapping_chunks(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    counter = tokens.Counter(path, chunk=64, overlap=8)
    monkeypatch.setattr(counter, "_count", None)  # not by segments
    rng = random.Random(12)
    for text in (" ".join(rng.choices(["one", "Two's", "漢字", "3.14", " ", "\n", "é"], k=400)), "x" * 300, " " * 200):
        assert counter.count_long(text) == len(library.encode(text, add_special_tokens=False).ids)


def good_turing(counts, k=5):
    """Katz's discounts of counts 1 .. k by the counts of counts; (r - 1/2) / r where they allow none."""
    n = Counter(counts)
    out = {}
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1
    for r in range(1, k + 1):
        d = None
        if n[r] and common < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        out[r] = d if d is not None and 0 < d < 1 else (r - 0.5) / r
    return out


def brute_lm(rows, order):
    """Katz back-off straight from the definitions, on dictionaries."""
    from zlib import crc32

    end, start = "</s>", "<s>"
    texts = [(d, [w.decode() for w in words(t)] + [end], d is not None and crc32(str(d).encode()) % 10 == 0) for d, t in rows]
    counts = [Counter() for _ in range(order + 1)]  # by length; counts[0] of histories of no word
    seen = Counter()
    for _, ws, held in texts:
        if not held:
            line = [start] * (order - 1) + ws
            for i in range(order - 1, len(line)):
                for n in range(1, order + 1):
                    gram = tuple(line[i - n + 1 : i + 1])
                    counts[n][gram] += 1
                    seen[gram[:-1]] += 1
    total, types = sum(counts[1].values()), len(counts[1])
    d = [None] + [good_turing(counts[n].values()) for n in range(1, order + 1)]
    cut = lambda n, c: c * d[n].get(c, 1)
    kept = sum(cut(1, c) for c in counts[1].values())
    unknown = max(1 - kept / total, 1 / (total + 1))
    after = defaultdict(list)
    for n in range(2, order + 1):
        for g in counts[n]:
            after[g[:-1]].append(g)

    def p(h, w):
        if not h:
            c = counts[1][(w,)]
            return cut(1, c) * (1 - unknown) / kept if c else unknown
        if h not in after:
            return p(h[1:], w)
        n, whole, mass = len(h) + 1, seen[h], sum(cut(len(h) + 1, counts[len(h) + 1][g]) for g in after[h])
        whole += whole - mass < 0.499999
        c = counts[n][(*h, w)]
        return cut(n, c) / whole if c else (1 - mass / whole) / (1 - sum(p(h[1:], g[-1]) for g in after[h])) * p(h[1:], w)

    scores = {}
    for doc, ws, held in texts:
        line = [start] * (order - 1) + ws
        base = sum(math.log10((counts[1][(w,)] + 0.1) / (total + 0.1 * (types + 1))) for w in ws)
        scores[doc] = (held, len(ws), sum(counts[1][(w,)] > 0 for w in ws), total, base, sum(math.log10(p(tuple(line[i : i + order - 1]), w)) for i, w in enumerate(ws)))
    return scores, p, counts, after


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_equals_brute_force_and_sums_to_one(spark, corpus, order):
    rows = [(d, t or None) for d, t in corpus[: 120 if order == 3 else 300]]
    scores, p, counts, after = brute_lm(rows, order)
    got = {r["doc_id"]: tuple(r)[1:] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order=order).collect()}
    assert got.keys() == scores.keys()
    for d, want in scores.items():
        assert got[d][:4] == want[:4]
        assert got[d][4:] == pytest.approx(want[4:], rel=1e-9)
    for h in [*list(after)[:10], *list(after)[-5:], ("never", "seen")[: order - 1]]:
        assert sum(p(h, w) for (w,) in counts[1]) + p(h, "unknown word") == pytest.approx(1.0, abs=1e-9)


def test_katz_spreads_hot_histories(spark):
    """A word before a third of all tokens: its pairs lie in many parts, and its weight is of all of them."""
    rng = random.Random(3)
    rows = [(i, " ".join(w for _ in range(rng.randint(1, 30)) for w in ("the", f"n{int(rng.paretovariate(0.6)) % 900}"))) for i in range(250)]
    scores = brute_lm(rows, 2)[0]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[d] == pytest.approx(want[5], rel=1e-9) for d, want in scores.items())


def test_katz_knows_pairs_seen_once(spark):
    """"u v" was seen once and "u w" never; v and w are alike in all else."""
    from zlib import crc32

    held = [i for i in range(500) if crc32(str(i).encode()) % 10 == 0]
    train = [i for i in range(500) if i not in held]
    texts = ["u x"] * 3 + ["y v"] * 3 + ["y w"] * 3 + ["u v", "z w"] + [f"f{i % 7} g{i % 5}" for i in range(60)]
    rows = [*zip(train, texts), (held[0], "u v"), (held[1], "u w")]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 0.1


def test_katz_odd_rows(odd, empty):
    got = sorted((r["n_tokens"], r["score"] <= 0) for r in lm.score(odd).collect())
    assert [g[0] for g in got] == [1, 1, 1, 1, 3, 4, 9, 9, 9, 30_001, 30_002] and all(g[1] for g in got)
    assert lm.score(empty).count() == 0
    alone = lm.score(odd.filter("doc_id = 3").select(F.lit(13).cast("long").alias("doc_id"), "text")).first()
    assert alone["n_tokens"] == 1


def plain(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def leaks_by_force(docs, items, threshold=0.5, overlap=0.5):
    """Every passage against every item, scored in full, from the definitions."""
    def halves(text):
        for cut in (text.rfind("\n") + 1, max([m.end() for m in re.finditer(r"[.?!]\s", text)] or [0])):
            if plain(text[:cut]) and plain(text[cut:]):
                return plain(text[:cut]), plain(text[cut:])
        ws = plain(text)
        cut = max(1, len(ws) * 2 // 3)
        return ws[:cut], ws[cut:] or ws[:cut]

    def grams(ws, n):
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}

    df = Counter(w for _, t in items for w in set(plain(t)))
    n, average = len(items), sum(len(plain(t)) for _, t in items) / len(items)
    found = set()
    for d, text in docs:
        ws = plain(text)
        for i, t in items:
            counts, dl = Counter(plain(t)), len(plain(t))
            impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average)) for w, tf in counts.items()}
            size = 64
            while size < dl:
                size *= 2
            for s in range(0, max(1, len(ws) - size // 2), size // 2) if ws else ():
                part = set(ws[s : s + size])
                if sum(x for w, x in impact.items() if w in part) >= threshold * sum(impact.values()):
                    region = ws[max(0, s - dl) : s + size + dl]
                    if all(len(grams(x, min(5, len(x))) & grams(region, min(5, len(x)))) >= overlap * len(grams(x, min(5, len(x)))) for x in halves(t.strip())):
                        found.add((d, i))
    return found


def test_decontamination(spark, corpus):
    rng = random.Random(9)
    length = lambda i: rng.randint(6, 50) if i % 4 else rng.randint(60, 200)
    items = [(i, " ".join(f"q{rng.randrange(300)}" for _ in range(length(i))) + ". " + " ".join(f"a{rng.randrange(300)}" for _ in range(5))) for i in range(70)]
    docs = []
    for d, t in corpus[:150]:
        kind = d % 5
        item = rng.choice(items)[1].split()
        inside = {0: item, 1: nearly(rng, item, 1), 2: item[: len(item) // 2], 3: [], 4: item[-5:]}[kind]
        ws = t.split()
        docs.append((d, " ".join(ws[: len(ws) // 2] + inside + ws[len(ws) // 2 :])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaks_by_force(docs, items)
    assert len(want) > 30
    for shard_bytes in (decontaminate.SHARD_BYTES, 4000):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, ["doc_id"], shard_bytes=shard_bytes).collect()}
        assert got == want


def test_an_item_is_found_alike_beside_a_long_one(spark):
    """A question and its answer 600 words apart: whether an item of 3,000 words shares the index changes nothing."""
    question, answer = [f"q{i}" for i in range(15)], [f"a{i}" for i in range(5)]
    items = [(1, " ".join(question) + ". " + " ".join(answer)), (2, " ".join(f"z{i}" for i in range(3000)))]
    docs = [(1, " ".join(question + [f"d{i}" for i in range(600)] + answer)), (2, " ".join(question + answer))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for some, shard_bytes in ((bench, 1 << 20), (bench, 1000), (bench.filter("item_id = 1"), 1 << 20)):
        assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, some, ["doc_id"], shard_bytes=shard_bytes).collect()] == [(2, 1)]


def test_edited_and_truncated_items_leak(spark, tmp_path):
    """An edit in an item's answer, another in its question, and its first nine tenths; not the like of other items."""
    import corpus_pipeline

    rng = random.Random(4)
    items, docs, want = [], [], set()
    for i in range(60):
        n, m = 5 + i % 30, 1 + i % 6
        items.append((i, " ".join(f"q{i}x{j}" for j in range(n)) + ". " + " ".join(f"a{i}x{j}" for j in range(m))))
        ws = items[-1][1].replace(".", "").split()
        answer, both = [*ws], [*ws]
        answer[-1] = "other"
        both[-1] = both[rng.randrange(n)] = "other"
        for k, inside in enumerate((answer, both if n > 6 else answer, ws[: max(n, len(ws) * 9 // 10)])):
            docs.append((3 * i + k, " ".join([f"d{rng.randrange(500)}" for _ in range(60)] + inside + [f"d{rng.randrange(500)}" for _ in range(60)])))
            want.add((3 * i + k, i))
    docs.append((999, " ".join(f"d{j}" for j in range(300))))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontaminate(spark, str(tmp_path)).collect()}
    assert got == want
    left = corpus_pipeline.drop_leaks(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r["doc_id"] for r in left.collect()] == [999]


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, " "), (4, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items, ["doc_id"]).collect())
    assert got == [(1, 1), (1, 4), (2, 1), (2, 1), (2, 4), (2, 4)]
    assert decontaminate.contaminated(empty, items, ["doc_id"]).count() == 0
    named = decontaminate.contaminated(odd, items.select(F.col("item_id").cast("decimal(20,0)"), "text"), ["doc_id", "score"])
    assert named.columns == ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"] and named.count() == 6
    assert decontaminate.contaminated(odd, items.filter("false"), ["doc_id"]).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(2)
    pieces = ["a", "Z9", "@", ".", "b.c", "-", "_", "%", "+", " ", "\n", "é", "😀", "1", "42", "255", "256", "007", "4111 1111 1111 1111", "4753376719988201", "(", ")", "+1 (784) 555-9263", "x@y.z", "10.0.0.1", "1.2.3.4.5.6.7.8"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(1500)] + ["a" * 50_000, "1." * 20_000, "x@" * 10_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(df, ["doc_id"]).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_running_sums_and_cuts(spark):
    rng = random.Random(7)
    rows = [(i, [rng.randint(0, 9) for _ in range(n)], "".join(rng.choices("aé😀 \n", k=n))) for i, n in enumerate([0, 1, 2, 15, 16, 17, 18, 99, 1000, 1537])]
    df = spark.createDataFrame(rows, "i int, xs array<int>, text string")
    low, high = F.lit(500), F.lit(1030)
    out = df.select("i", pii.running(F.col("xs"), lambda a, b: a + b).alias("sums"), pii.running(F.col("xs"), F.greatest).alias("tops"), pii.cut(pii.pieces(F.col("text")), low, high).alias("cut"), pii.cut(pii.pieces(F.col("text")), F.lit(0), F.length("text")).alias("all"))
    for r in out.collect():
        xs, text = rows[r["i"]][1:]
        assert r["sums"] == [sum(xs[: k + 1]) for k in range(len(xs))] and r["tops"] == [max(xs[: k + 1]) for k in range(len(xs))]
        assert r["cut"] == text[500:1030] and r["all"] == text


def test_a_text_of_very_many_spans(spark):
    """Work grows with the text, not with the square of its spans: a log of 30,000 addresses and as many candidates beside them."""
    text = " ".join(f"10.{i % 250}.{i % 7}.9, 212 555 {i % 9000 + 1000} call;" for i in range(30_000))
    began = time.time()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.personal_data(df, ["doc_id"]).first()
    assert r["n_ip"] == 30_000 and hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest() == r["base_sha256"]
    clean = pii.redact(df).first()["text"]
    assert clean.count("[ip]") == 30_000 and clean.startswith("[ip], ")
    assert time.time() - began < 120


def test_expectation_finds_the_reliable_labelers():
    """Votes made by labelers of known reliability: EM ranks them, and its probabilities are near the truth."""
    rng, counts, true = random.Random(11), Counter(), Counter()
    good = [0.95, 0.9, 0.9, 0.8, 0.55, 0.5, 0.5]
    for _ in range(6000):
        yes = rng.random() < 0.6
        votes = "".join("1" if rng.random() < 0.2 else "2" if yes == (rng.random() < g) else "0" for g in good)
        counts[votes] += 1
        true[votes] += yes
    belief, rates = pii.expectation({v: float(n) for v, n in counts.items()})
    sharp = [r[1][2] / (r[1][2] + r[0][2]) for r in rates]
    assert sharp[0] > sharp[3] > sharp[5] and min(sharp[:3]) > 0.8
    wrong = sum(n for v, n in counts.items() if (belief[v] >= 0.5) != (true[v] * 2 >= n)) / sum(counts.values())
    assert wrong < 0.05


def test_odd_rows_keep_their_spans(spark, odd):
    """Repeated rows each get theirs; base spans and added ones, in long texts with many."""
    text = "mail a.b@c.de, " + "tel 212 555 2485; " * 500 + "end"
    df = spark.createDataFrame([(1, text, 1), (1, text, 1), (None, text, 2)], "doc_id long, text string, spans int")
    rows = pii.personal_data(df, ["doc_id", "spans"]).collect()
    assert len(rows) == 3 and len({r["spans"] for r in rows}) == 1
    assert rows[0]["spans"].startswith("email:5:13") and rows[0]["spans"].count("phone") == 500


def test_weak_supervision_adds_spans(spark, odd, empty):
    good = ["call me: 212 555 2485 today", "tel (312) 555-9876.", "mail jo.doe [at] example-mail [dot] org now", "SSN 123-45-6789, please"]
    bad = ["version 212 555 2485x", "order 000-00-0000", "nothing here", "figure 1.2"]
    filler = [f"write to user{i}@mail.example{i}.org or 10.1.{i}.7" for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad + filler)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(df, ["doc_id"]).collect()}
    assert spans[0].startswith("phone:9:21") and "phone" in spans[1] and "email" in spans[2] and "national_id" in spans[3]
    assert [spans[i] for i in range(4, 8)] == ["", "", "", ""]
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert redacted[0] == "call me: [phone] today" and redacted[8] == "write to [email] or [ip]"
    assert pii.personal_data(empty, ["doc_id"]).count() == 0
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == 11
    assert pii.personal_data(odd, odd.columns).filter("spans <> ''").count() == 0


class TestMixing:
    def test_targets_and_takes(self, spark):
        rng = random.Random(5)
        rows = [(i, " ".join("w" * rng.randint(1, 400)), rng.choice(["a"] * 8 + ["b", "c", None, ""])) for i in range(600)]
        df = spark.createDataFrame([(i, " ".join(t), s) for i, t, s in rows], "doc_id long, text string, source string")
        out = mixing.mix(df, keep=["doc_id", "source"], shard=5000).collect()
        total = sum(r["size"] for r in out)
        weights = dict(zip(["", "a", "b", "c", None], [5, 2, 1, 5, 2], strict=True))
        held = Counter()
        taken = Counter()
        for r in out:
            held[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        target, free, left = {}, set(held), float(total)
        while True:
            level = left / sum(weights[s] for s in free)
            full = {s for s in free if level * weights[s] > 3 * held[s]}
            if not full:
                break
            for s in full:
                target[s] = 3.0 * held[s]
                left -= target[s]
            free -= full
        target |= {s: level * weights[s] for s in free}
        for r in out:
            assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == held[r["source"]]
        for s in held:
            assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 8
        again = mixing.mix(df.repartition(5), keep=["doc_id", "source"], shard=5000).collect()
        assert sorted(map(str, out)) == sorted(map(str, again))

    def test_odd_rows(self, spark, odd, empty):
        out = mixing.mix(odd)
        assert set(out.columns) == {"doc_id", "text", "source", "score", "size", "source_size", "target", "taken"}
        assert out.count() == 11 and out.filter("text is null and taken <> 0").count() == 0
        assert mixing.mix(empty).count() == 0
        silent = mixing.mix(odd.filter("doc_id in (3, 4)")).collect()
        assert [(r["size"], r["target"], r["taken"]) for r in silent] == [(0, 0.0, 0)] * 2

    def test_highest_quotients(self, spark):
        votes = [53, 24, 23, 1, 0]
        parties = spark.createDataFrame([(str(i), v, 40, 100) for i, v in enumerate(votes)], "k string, v long, s long, m long")
        got = {r["k"]: r["won"] for r in mixing.sainte_lague(parties, [], ["k"], "v", "s", "m", "won").collect()}
        best = sorted(((-v / (2 * j + 1), i, j) for i, v in enumerate(votes) for j in range(40)))[:40]
        assert got == {str(i): sum(b[1] == i for b in best) for i in range(5)}


def test_url_filter(spark):
    from datetime import datetime as at

    events = spark.createDataFrame(
        [("l", "host", "a.example.org", "block", "add", at(2024, 1, 2)), ("l", "host", "a.example.org", "block", "remove", at(2024, 1, 5)), ("m", "domain", "example.com", "block", "add", at(2024, 1, 1)), ("m", "path", "b.example.com/ok", "allow", "add", at(2024, 1, 3)), ("l", "host", "a.example.org", "block", "add", at(2024, 1, 2))],
        "list string, kind string, pattern string, action string, op string, at timestamp_ntz",
    )
    rows = [(1, "http://a.example.org/x", 1, False), (2, "http://A.example.org:80/x", 2, True), (3, "http://a.example.org/x", 5, False), (4, "https://u@deep.b.example.com/ok", 9, True), (5, "https://b.example.com/ok/1?x", 2, True), (6, "https://b.example.com/ok/1?x", 3, False), (7, None, 3, False), (8, "no url", 3, False), (9, "https://example.com.evil.org/", 3, False)]
    captures = spark.createDataFrame([(i, u, at(2024, 1, d), "n") for i, u, d, _ in rows] + [(10, "http://a.example.org/x", None, "n")], "page_id long, url string, fetched_at timestamp_ntz, host string")
    got = {r["page_id"]: r["blocked"] for r in urlfilter.judge(captures, events).collect()}
    assert got == {i: b for i, _, _, b in rows} | {10: False}
    assert urlfilter.judge(captures.filter("false"), events).count() == 0
    assert urlfilter.judge(captures, events.filter("false")).filter("blocked").count() == 0


def test_url_filter_ties_long_urls_and_top_level_domains(spark):
    """Of an add and a removal at one time in one list the removal counts, in different lists each counts for itself; a top-level domain may be listed."""
    from datetime import datetime as at

    rows = [("l", "host", "a.org", "block", "add", at(2024, 1, 2)), ("l", "host", "a.org", "block", "remove", at(2024, 1, 2)), ("l", "host", "b.org", "block", "remove", at(2024, 1, 2)), ("m", "host", "b.org", "block", "add", at(2024, 1, 2)), ("m", "domain", "net", "block", "add", at(2024, 1, 1))]
    events = spark.createDataFrame(rows, "list string, kind string, pattern string, action string, op string, at timestamp_ntz")
    urls = ["http://a.org/", "http://b.org/" + "x/" * 50_000, "http://" + "deep." * 2000 + "example.net/", "http://net/", "http://planet/"]
    captures = spark.createDataFrame([(i, u, at(2024, 1, 3)) for i, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp_ntz")
    assert {r["page_id"]: r["blocked"] for r in urlfilter.judge(captures, events).collect()} == {0: False, 1: True, 2: True, 3: True, 4: False}


def test_mixing_in_ranges_of_shards(spark):
    """With ranges of 4 shards the seats of a source still add up, in one more race a level."""
    quotas = spark.createDataFrame([("0hot", 500, 30), ("0rare", 9, 2)], "__source string, source_seats long, __shards long")
    shards = spark.createDataFrame([("0hot", s, 8 * (3 + s % 5)) for s in range(30)] + [("0rare", s, 40) for s in range(2)], "__source string, __shard long, __words long")
    shards = shards.selectExpr("*", "cast(ceil(__words / 8) AS long) AS __blocks", "cast(3 * ceil(__words / 8) AS long) AS __most")
    for ranged in (4, 1024):
        seats = mixing._seats_of_shards(shards, quotas, ranged).collect()
        given = Counter()
        for r in seats:
            given[r["__source"]] += r["__quota"]
            assert 0 <= r["__quota"] <= 3 * r["__blocks"]
        assert len(seats) == 32 and given == {"0hot": min(500, sum(3 * (3 + s % 5) for s in range(30))), "0rare": 9}


def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SF), duck().sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda rows: sorted(str(tuple(None if x is None else x for x in r)) for r in rows)
    assert text(map(tuple, got.select(*columns).collect())) == text(want.select(*columns).fetchall())
