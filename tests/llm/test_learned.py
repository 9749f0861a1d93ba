"""Classifiers by held-out accuracy, and the pipeline."""

from zlib import crc32

import numpy as np
import pytest
from pathlib import Path

from tidemark.llm import quality, queries, toxicity
from tidemark.llm.samples import labelled_sample

SF = str(Path("/root/testdata") / "sf0.01")


def held_out_accuracy(spark, name, label, modulus, rest, sf=SF):
    """Shares of held-out labels met, of labels 1 found and of labels 0 left alone."""
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, sf).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    tested = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return np.mean([a == b for a, b in tested]), np.mean([a for a, b in tested if b]), 1 - np.mean([a for a, b in tested if not b])


def test_quality_on_held_out_rows(spark):
    right, kept, rejected = held_out_accuracy(spark, "op7_quality", "quality", 5, 0)
    assert right > 0.93 and kept > 0.95 and rejected > 0.8


def test_toxicity_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op2_toxicity", "toxic", 3, 1)[0] > 0.88
    # 305 toxic rows to learn from
    right, caught, alone = held_out_accuracy(spark, "op2_toxicity", "toxic", 3, 1, SF.replace("sf0.01", "sf0.1"))
    assert right > 0.95 and caught > 0.7 and alone > 0.98


def test_misspellings_share_vectors():
    rng = np.random.default_rng(1)
    plain = [f"word{i}" for i in range(200)]
    sample = []
    for i in range(600):
        words = list(rng.choice(plain, rng.integers(5, 60)))
        if i % 3 == 0:
            words[rng.integers(len(words))] = ["moronic", "idiotic", "stupid"][i % 9 // 3]
        sample.append((" ".join(words).encode(), int(i % 3 == 0)))
    score = toxicity.scorer(toxicity.train(sample))
    clean, toxic, misspelt = score(["word1 word2 word3 word4 word5", "word1 word2 moronic word4 word5", "word1 word2 morronic word4 word5"])
    assert clean < 0.3 and toxic > 0.7 and misspelt > clean
    long = " ".join(plain * 300)
    assert score([long + " stupid " + long])[0] > 0.7 > score([long])[0]


def test_quality_scores_follow_from_the_weights():
    """The network written out place by place, in Python."""
    rng = np.random.default_rng(5)
    net = quality.Net(rng.normal(0, 0.3, (256, quality.DIM)), rng.normal(0, 0.3, (quality.WIDTH, quality.DIM, quality.FILTERS)), rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 0.3, 2 * quality.FILTERS), 0.2)
    texts = [b"", b"a", b"eight by", bytes(rng.integers(0, 256, 700, dtype=np.uint8)), bytes(rng.integers(0, 256, 1300, dtype=np.uint8))]
    for text, got in zip(texts, quality.scorer(net)(texts), strict=True):
        places = max(1, len(text) - quality.WIDTH + 1)
        chunks = -(-places // quality.PLACES)
        padded = text + bytes(chunks * quality.PLACES + quality.WIDTH)
        features = []
        for c in range(chunks):
            z = [sum(net.embed[padded[p + k]] @ net.filters[k] for k in range(quality.WIDTH)) for p in range(c * quality.PLACES, (c + 1) * quality.PLACES)]
            features.append(np.maximum(np.max(z, axis=0) + net.bias, 0))
        z = np.max(features, axis=0) @ net.top[: quality.FILTERS] + np.mean(features, axis=0) @ net.top[quality.FILTERS :] + net.shift
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_toxicity_scores_follow_from_the_weights():
    """Buckets, bags, windows and their soft maximum written out word by word, with Python's integers."""
    rng, full = np.random.default_rng(6), (1 << 64) - 1
    net = toxicity.Bag(rng.normal(0, 0.5, (toxicity.BUCKETS, toxicity.DIM)), rng.normal(0, 0.5, (toxicity.DIM, 2)), rng.normal(0, 0.1, 2), 1.3, -0.4)

    def last(h):
        return ((((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & full) >> 40) % toxicity.BUCKETS

    def odds(word):
        marked, buckets = f"<{word}>", []
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                h = n * 0x9E3779B97F4A7C15 & full
                for c in marked[i : i + n]:
                    h = ((h ^ ord(c)) * 0x100000001B3F) & full
                buckets.append(last(h))
        whole = 0
        for i, c in enumerate(marked):
            x = (i + 1) * 0x9E3779B97F4A7C15 & full
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full | 1
            whole += (ord(c) + 77) * x
        buckets.append(last(whole & full))
        return net.embed[buckets].mean(axis=0) @ (net.classes[:, 1] - net.classes[:, 0])

    texts = ["", "One", "a b c", "Plain words, an Émigré; and more plain words 42 times", "x" * 400 + " y"]
    for text, got in zip(texts, toxicity.scorer(net)(texts), strict=True):
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        each = [odds(w) for w in words]
        windows = [np.mean(each[i : i + toxicity.SPAN]) for i in range(max(1, len(each) - toxicity.SPAN + 1))] if each else [0.0]
        z = np.array(windows) + net.bias[1] - net.bias[0]
        p = np.exp(12.0 * (z - z.max()))
        assert got == pytest.approx(1 / (1 + np.exp(-(net.slope * (p @ z) / p.sum() + net.shift))), abs=1e-9)


def test_chunks_cover_every_byte():
    for n in (0, 1, 7, 8, 9, quality.CHUNK, quality.CHUNK + 1, 5000):
        text = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        rows = quality.chunks_of(text)
        joined = rows[0].tobytes() + b"".join(r[quality.CHUNK - quality.PLACES :].tobytes() for r in rows[1:])
        assert joined[:n] == text and not any(joined[n:])


def test_network_gradient_learns_a_pattern():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, rng.integers(50, 1500), dtype=np.uint8)) for _ in range(240)]
    sample = [(b"###! ".join(t[j : j + 40] for j in range(0, len(t), 40)) if i % 2 else t, i % 2) for i, t in enumerate(texts)]
    score = quality.scorer(quality.train(sample[:200]))
    found = score([t for t, _ in sample[200:]])
    assert np.mean((found > 0.5) == np.array([y for _, y in sample[200:]])) > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, odd, empty, module):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 1, 1), (20, None, None)], "doc_id long, quality int, toxic int")
    net = module.fit(odd, labels)
    rows = module.apply(odd, net, odd.columns).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert module.apply(empty, net, ["doc_id"]).count() == 0
    assert module.apply(odd, module.fit(odd, labels.filter("false")), ["doc_id"]).count() == 11


def test_labels_of_no_document_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(40, "x" * 200)], "doc_id long, text string")
    labels = spark.range(4000).selectExpr("id AS doc_id", "1 AS quality")
    fit = {i for i in range(40) if crc32(str(i).encode()) % 5}
    sample = labelled_sample(docs, labels, "quality", 5, 0, 50, 800)
    assert {t for t, _ in sample} == {f"text {i}".encode() for i in fit}
    assert len(labelled_sample(docs, labels, "quality", 5, 0, 50, 800, largest=200)) == len(fit) + (crc32(b"40") % 5 != 0)


def test_sample_is_bounded_and_keeps_off_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["text"]: r["doc_id"] for r in docs.collect()}
    sample = labelled_sample(docs, labels, "quality", 5, 0, 50, 1 << 20)
    assert 0 < len(sample) <= 50 and sum(len(t) for t, _ in sample) <= 1 << 20
    unique = [d for t, _ in sample if list(texts).count(t.decode()) == 1 for d in [texts[t.decode()]]]
    counts = docs.groupBy("text").count().filter("count = 1").select("text")
    alone = {r["text"] for r in counts.collect()}
    assert all(crc32(str(d).encode()) % 5 != 0 for d in unique if any(texts[x] == d for x in alone))


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in pipeline.STAGES:
        out = stage(spark, kept, sf)
        assert set(columns) <= set(out.columns) if name == "mixing" else out.columns == columns
        kept = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < kept.count() <= docs.count()
    ran = pipeline.run(spark, sf)
    assert {r["doc_id"] for r in ran.collect()} == {r["doc_id"] for r in kept.collect()}
    empty = docs.filter("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_odd_rows_pass_every_stage(spark, odd, tmp_path):
    """Nulls, empty, repeated and very long texts and clashing names, through each stage alone."""
    import corpus_pipeline as pipeline

    odd.select("doc_id", (odd["doc_id"] % 2).cast("int").alias("quality"), (odd["doc_id"] % 3 % 2).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.selectExpr("doc_id", "text", "'xx' AS lang", "source", "length(text) AS n_chars", "score", "size AS predicted", "1 AS __hash2")
    most = {"quality": 11, "near duplicates": 9, "decontamination": 8, "personal data": 11, "mixing": 11}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns) and out.count() <= most[name], name
    kept = pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert kept.count() == 8 and kept.filter("doc_id in (1, 2)").count() == 0
    assert pipeline.hide_personal_data(spark, docs, str(tmp_path)).count() == 11
