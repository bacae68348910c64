"""Quality, language, archives, vectors, components and the pipeline."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import PROSE, clashing, documents, empty_documents, labels, odd_documents
from pyspark.sql import functions as F

from slatework.llm import common, components, langid, quality, vectors, warc

import zstandard


def mixed(seed, n):
    """(text, lang) of shuffled words."""
    r = random.Random(seed)
    return [(" ".join(r.choices(PROSE[k].split(), k=r.randrange(3, 40))), k) for k in itertools.islice(itertools.cycle(PROSE), n)]


def plain_grams(text):
    """Words, word pairs and pairs of shapes."""
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")

    def shape(t):
        if not (t[0].isalnum() or t[0] == "_"):
            return t
        return "digits" if t.isdigit() else "upper" if t.isupper() and len(t) > 1 else "title" if t[0].isupper() else "lower"

    pairs = list(itertools.pairwise(tokens))
    return [("w", t.lower()) for t in tokens] + [("p", "same") if a == b else ("p", a.lower(), b.lower()) for a, b in pairs] + [("s", shape(a), shape(b)) for a, b in pairs]


def test_importance_weights_are_log_ratios_and_reject_the_odd(spark):
    good, bad = [t for t, _ in mixed(1, 80)], [" ".join(f"{w.upper()}!!" for w in t.split()) for t, _ in mixed(2, 20)]
    docs = documents(spark, good + bad)
    ratio = quality.fit(docs, labels(spark, [(i, int(i < 80), 0) for i in range(100)]), buckets=1 << 22)
    rows = quality.score(docs, ratio).orderBy("doc_id").collect()
    grams = [plain_grams(t) for t in good + bad]
    raw, target = Counter(g for x in grams for g in x), Counter(g for x in grams[:80] for g in x)
    n_raw, n_target = raw.total(), target.total()

    def weight(x):
        logs = [math.log((target[g] + 100 * raw[g] / n_raw) / (n_target + 100) / (raw[g] / n_raw)) for g in x]
        return sum(logs) / len(logs) * min(len(logs), 32)

    assert [r["n_grams"] for r in rows] == [len(x) for x in grams]
    assert [r["log_weight"] for r in rows] == pytest.approx([weight(x) for x in grams], abs=1e-3)
    keyed = quality.perturb(quality.score(docs, ratio))
    k = quality.accepted(keyed)
    assert k == round(sum(min(1, math.exp(r["log_weight"] + 6)) for r in rows))
    kept = {r["doc_id"] for r in keyed.filter(F.col("gumbel_key") >= quality.threshold(keyed, k)).collect()}
    assert len(kept) == k and len(kept - set(range(80))) <= 2


def test_weights_are_the_exact_ratio_without_a_bound(spark):
    texts = ["good words here " * (1 + i % 30) for i in range(40)] + ["bad stuff now " * (1 + i % 30) for i in range(40)] + ["good", None]
    docs = documents(spark, texts)
    ratio = quality.fit(docs, labels(spark, [(i, int(i < 40), 0) for i in range(80)]), buckets=1 << 22)
    exact = {r["doc_id"]: r for r in quality.score(docs, ratio, most_grams=None).collect()}
    for r in quality.score(docs, ratio, most_grams=32).collect():
        e = exact[r["doc_id"]]
        found, _ = quality.Grams(len(ratio)).of([texts[r["doc_id"]]])
        assert e["n_grams"] == len(found) and e["log_weight"] == pytest.approx(sum(ratio[found]))
        assert r["log_weight"] == pytest.approx(e["log_weight"] * min(1, 32 / max(1, e["n_grams"])))
    assert quality.spread(quality.score(docs, ratio, most_grams=None)) == pytest.approx(np.std([e["log_weight"] for e in exact.values()], ddof=1))
    assert quality.spread(quality.score(docs.limit(0), ratio)) == 1.0


def test_the_sample_follows_the_seed_and_the_odds(spark, tmp_path):
    from slatework.llm.queries import op10_quality

    texts = [f"{a} {b}" for (a, _), (b, _) in zip(mixed(1, 900), mixed(9, 900), strict=True)]
    texts[:300] = [t.replace(" ", " ### ") for t in texts[:300]]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, [(i, int(i % 3 > 0 or i > 400), 0) for i in range(900)]).write.parquet(str(tmp_path / "labels.parquet"))
    draws = [{r["doc_id"]: r for r in op10_quality(spark, str(tmp_path), seed).collect()} for seed in (1, 2)]
    kept = [{i for i, r in d.items() if r["kept"]} for d in draws]
    assert [len(k) for k in kept] == [450, 450] and len(kept[0] & kept[1]) < 440
    for d in draws:
        # the chance to be in, given the sample's bar: that of Gumbel noise above the bar less the weight
        bar = min(r["gumbel_key"] for r in d.values() if r["kept"])
        by = sorted(d.values(), key=lambda r: r["log_weight"])
        for part in (by[:300], by[300:600], by[600:]):
            wanted = sum(1 - math.exp(-math.exp(r["log_weight"] - bar)) for r in part)
            assert abs(sum(r["kept"] for r in part) - wanted) < 4 * math.sqrt(len(part) / 4)


def test_kth_largest_is_exact(spark):
    values = [random.Random(5).gauss(0, 1) ** 5 for _ in range(500)] + [0.25] * 20
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 100, 260, 520):
        assert quality.kth_largest(df, "x", k, bins=8) == ranked[k - 1]
    assert quality.kth_largest(df, "x", 0) is quality.kth_largest(df, "x", 521) is None


def test_gumbel_noise_samples_in_proportion(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'' as text", "if(id % 2 = 0, ln(3D), 0D) as log_weight")
    keyed = quality.perturb(df, 1.0)
    least = quality.kth_largest(keyed, "gumbel_key", 200)
    odds = keyed.filter(F.col("gumbel_key") >= least).agg(F.avg((F.col("doc_id") % 2 == 0).cast("int"))).first()[0]
    assert abs(odds - 0.75) < 0.1


def test_quality_of_odd_rows(spark):
    docs = clashing(odd_documents(spark))
    ratio = quality.fit(docs, labels(spark, [(1, 1, 0), (None, 1, 0), (6, None, None)]))
    rows = quality.score(docs, ratio).collect()
    assert len(rows) == 9 and all(math.isfinite(r["log_weight"]) for r in rows)
    assert {r["log_weight"] for r in rows if not r["text"]} == {0.0}
    assert not quality.fit(docs, labels(spark, [])).any() and quality.score(empty_documents(spark), ratio).count() == 0


def chain(emit, moves, first):
    """Posteriors by summing over all label sequences."""
    n, k = emit.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = math.exp(first[path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for i, y in enumerate(path):
            out[i, y] += p
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_is_exact_across_texts():
    rng = np.random.default_rng(1)
    moves, first = rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = [4, 1, 6, 2, 5]
    emit = rng.normal(size=(sum(sizes), 3)) * 2
    starts = np.zeros(len(emit), bool)
    starts[np.cumsum([0, *sizes[:-1]])] = True
    wanted = np.concatenate([chain(e, moves, first) for e in np.split(emit, np.cumsum(sizes)[:-1])])
    assert np.allclose(langid.forward_backward(emit, starts, moves, first)[0], wanted)


@pytest.fixture(scope="module")
def model():
    return langid.train(mixed(3, 120), steps=120)


def test_words_of_mixed_text_are_labelled(spark, model):
    text = PROSE["en"] + " " + PROSE["de"] + " " + PROSE["fr"]
    row = langid.predict(documents(spark, [text]), model, spans=True).first()
    assert [s["lang"] for s in row["lang_spans"]] == ["en", "de", "fr"]
    assert sum(s["words"] for s in row["lang_spans"]) == len(text.split())


def test_held_out_accuracy(spark, model):
    pairs = mixed(4, 150)
    rows = langid.predict(documents(spark, [t for t, _ in pairs], [k for _, k in pairs]), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_words_are_read_whole():
    long = "".join(random.Random(1).choices("abcdefgh", k=60))
    base = langid.features(long, {})
    assert len(base) == 6 + 60 + 2
    for k in range(60):
        assert langid.features(long[:k] + "z" + long[k + 1 :], {}) != base


def test_samples_are_bounded_whatever_the_ids(spark):
    same = documents(spark, [f"text {i}" for i in range(1000)], ["en"] * 900 + ["de"] * 100, ids=[None] * 500 + [7] * 500)
    got = langid.sample(same, 50)
    assert Counter(lang for _, lang in got) == {"en": 50, "de": 50} and len(set(got)) == 100
    again = langid.sample(same.union(same).repartition(3), 50)
    assert again == got
    few = langid.sample(same, 50, most_bytes=100)
    assert {lang for _, lang in few} == {"en", "de"} and sum(len(t) for t, _ in few) <= 100
    assert langid.sample(documents(spark, ["same"] * 100, ids=[1] * 100), 50) == [("same", "en")]


def test_samples_take_the_commonest_languages_or_all(spark):
    docs = documents(spark, [f"text {i}" for i in range(60)], [f"l{int(i**0.5)}" for i in range(60)])
    assert {lang for _, lang in langid.sample(docs, 3, most_langs=2)} == {"l5", "l6"}  # 11 and 13 texts, as l7 has 11 and a later name
    assert {lang for _, lang in langid.sample(docs, 3, most_langs=None)} == {f"l{k}" for k in range(8)}
    long = documents(spark, ["a" * 10_000, "b" * 40, "c" * 40], ["en", "en", "de"])
    assert sorted(langid.sample(long, 5, most_bytes=1000)) == [("b" * 40, "en"), ("c" * 40, "de")]


def test_languages_of_odd_rows(spark, model):
    rows = langid.predict(clashing(odd_documents(spark)), model, spans=True).collect()
    assert len(rows) == 9
    assert {(r["lang_pred"], r["score"], r["n_words"]) for r in rows if not r["text"] or r["doc_id"] == 6} == {("und", 0.0, 0)}
    assert langid.predict(empty_documents(spark), model).count() == 0
    assert langid.train([]).langs == ["und"] and langid.sample(empty_documents(spark), 10) == []


def pages(spark):
    html = "<html>" + "x" * 200
    rows = [(3, "http://a/3", html), (1, "http://a/1", html), (2, "http://a/2", "<p>"), (4, None, "<p>"), (5, " u\t<ü>\r\n", None), (None, "u v", html), (1, "http://a/1", html), (6, "u", "é" * 100_000)]
    rows += [(10 + i, f"http://b/{i}", f"<html><head><title>page {i}</title></head><body>{'word ' * i}</body></html>") for i in range(40)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))


def test_archives_round_trip(spark):
    df = pages(spark)
    archives = warc.write_archives(warc.resolve(df).coalesce(1), archive_bytes=3000, samples=8)
    assert archives.count() > 2
    rows = warc.read_archives(archives).collect()
    assert len(rows) == df.count()
    by = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows if (r["page_id"] or 0) < 6)
    assert by == [("1", "response", None, 206), ("1", "response", None, 206), ("2", "response", None, 3), ("3", "revisit", 1, 206), ("4", "response", None, 3), ("5", "response", None, 0), ("None", "revisit", 1, 206)]
    big = next(r for r in rows if r["page_id"] == 6)
    assert bytes(big["payload"]).decode() == "é" * 100_000
    assert all(r["payload"] is None for r in rows if r["record_type"] == "revisit")
    assert Counter(r["url"] for r in rows) == Counter(r["url"] for r in df.collect())
    assert warc.read_archives(warc.write_archives(warc.resolve(df.limit(0)))).count() == 0


def foreign(version, kind, body, **fields):
    """A record as other programs write it."""
    lines = [f"WARC/{version}", f"Warc-Type:{kind}", "WARC-Record-ID: <urn:uuid:0>", "WARC-Date:  2020-01-01T00:00:00Z", *[f"{k.replace('_', '-')}: {v}" for k, v in fields.items()], f"content-length: {len(body)}"]
    return "\r\n".join([*lines, "", ""]).encode() + body + b"\r\n\r\n"


def test_records_of_other_programs(spark, tmp_path):
    import base64
    import hashlib

    page = b"<p>x\r\n\r\ny</p>"
    http = b"HTTP/1.0 200 OK\r\nserver:a\r\n  folded\r\n\r\n"
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    records = [
        foreign("1.0", "warcinfo", b"software: x\r\n", Content_Type="application/warc-fields", WARC_Filename="a.warc"),
        foreign("1.0", "response", http + page, WARC_Target_URI="<http://a/>", Content_Type="application/http; msgtype=response", WARC_Payload_Digest=sha1(page), WARC_Block_Digest=sha1(http + page)),
        foreign("1.1", "request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", WARC_Target_URI="http://a/", Content_Type="application/http;msgtype=request"),
        foreign("1.1", "revisit", http, WARC_Target_URI="http://a/", Content_Type="application/http", WARC_Profile="http://netpreserve.org/warc/1.0/revisit/server-not-modified", WARC_Payload_Digest=sha1(page)),
        foreign("1.0", "resource", page, WARC_Target_URI="file:///x\r\n y", Content_Type="text/html", WARC_Payload_Digest=f"sha256:{hashlib.sha256(page).hexdigest()}"),
        foreign("1.0", "metadata", b"", WARC_Payload_Digest="crc9:abc"),
        foreign("1.1", "conversion", page, Content_Type="text/plain"),
        foreign("1.1", "continuation", page),
        foreign("1.1", "response", b"20200101\r\na.example. 1 IN A 1.2.3.4", WARC_Target_URI="dns:a.example", Content_Type="text/dns"),
        foreign("1.1", "response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1\r\nx\r\n0\r\n\r\n", Content_Type="application/http", WARC_Payload_Digest=sha1(b"x")),
    ]
    pack = zstandard.ZstdCompressor(write_content_size=False).compress
    archives = spark.createDataFrame([("a.warc.zst", b"".join(map(pack, records))), ("none.warc.zst", b"")], "path string, content binary")
    folder = f"file://{tmp_path}/archives"
    assert warc.save_archives(archives, folder) == 2
    rows = warc.read_archives(spark.read.format("binaryFile").load(folder)).orderBy("offset").collect()
    assert [r["record_type"] for r in rows] == "warcinfo response request revisit resource metadata conversion continuation response response".split()
    assert bytes(rows[1]["payload"]) == page and rows[1]["url"] == "http://a/" and rows[1]["payload_digest"] == hashlib.sha256(page).hexdigest()
    assert rows[3]["payload"] is None and rows[3]["payload_bytes"] is None and rows[3]["payload_digest"] == sha1(page)
    assert bytes(rows[4]["payload"]) == page and rows[4]["url"] == "file:///x y"
    assert {r["page_id"] for r in rows} == {None}
    for bad in (records[1].replace(b"<p>", b"<q>"), records[4].replace(b"<p>", b"<q>"), records[0].replace(b"software", b"softwar"), records[0].replace(b"Warc-Type:", b"Warc-Type "), records[2].replace(b"WARC/1.1", b"WARC/x")):
        with pytest.raises(ValueError, match="record at 0"):
            list(warc.records_of(pack(bad)))
    with pytest.raises(ValueError, match="more than 1000 bytes"):
        list(warc.records_of(pack(foreign("1.1", "resource", b"x" * 5000)), most_bytes=1000))


def test_archives_are_files_that_spark_reads(spark, tmp_path):
    archives = warc.write_archives(warc.resolve(pages(spark)), archive_bytes=3000, samples=8)
    assert warc.save_archives(archives, f"file://{tmp_path}/a") == archives.count()
    back = warc.read_archives(spark.read.format("binaryFile").load(f"file://{tmp_path}/a"))
    assert back.drop("archive", "offset").exceptAll(warc.read_archives(archives).drop("archive", "offset")).count() == 0 and back.count() == 48


def test_archives_without_content_or_path(spark, tmp_path):
    rows = [("a", None), ("b", b""), (None, b"x"), ("c", b"1"), ("c", b"1")]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert warc.save_archives(df, f"file://{tmp_path}/n") == 4
    assert {p.name: p.read_bytes() for p in (tmp_path / "n").iterdir()} == {"a": b"", "b": b"", "c": b"1"}
    assert warc.save_archives(df.limit(0), f"file://{tmp_path}/n") == 0
    assert warc.read_archives(df.filter("path in ('a', 'b')")).count() == 0


def test_frames_share_the_leading_dictionary(spark):
    content = bytes(warc.write_archives(warc.resolve(pages(spark)).coalesce(1)).first()["content"])
    assert content[:4] == (0x184D2A5D).to_bytes(4, "little")
    offsets = [o for o, _ in warc.records_of(content)]
    assert len(offsets) == 48
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(content[offsets[0] :])


def test_broken_archives_are_refused(spark):
    content = bytes(warc.write_archives(warc.resolve(pages(spark)).coalesce(1)).first()["content"])
    for bad in (content[:-3], content + b"xyz", content[:8] + content[9:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.records_of(bad))
    record = warc._record(1, "u", b"payload", "0" * 64, "response", None, "1970-01-01T00:00:00Z")
    for bad in (record, record.replace(b"WARC/1.1", b"HTTP/1.1"), record.replace(b"payload\r\n", b"payloa\r\n")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


@pytest.mark.parametrize("lean", [0.0, 2.0])
def test_vector_links_are_those_of_brute_force(spark, lean):
    """``lean`` 2 gives vectors whose cosines are 0.8 in the mean."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 32))
    x = x + lean * np.sign(rng.normal(size=(1, 32)))
    x = np.concatenate([x, x[:20] + rng.normal(size=(20, 32)) * 0.12, np.repeat(x[:1], 5, axis=0), x[5:6] + rng.normal(size=(40, 32)) * 0.15]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = sorted(vectors.near_duplicates(df, cell_rows=16).collect())
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    assert [r["n_links"] for r in rows] == linked.sum(axis=1).tolist()
    assert [r["component_id"] for r in rows] == common.forest(linked).tolist()
    assert [r["kept"] for r in rows] == (common.forest(linked) == np.arange(len(u))).tolist()


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(3)
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 3000, 64)))
    w = 0.9 * u + 0.3 * v
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    code, factor = vectors.encode(u)
    near, error = vectors.estimator(code, factor, 64)
    off = (near * w).sum(axis=1) - (u * w).sum(axis=1)
    assert abs(off.mean()) < 0.005 and (np.abs(off) < vectors.BOUND * error).all()


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit("x")).withColumn("component", F.lit(1))
    got = sorted(map(tuple, vectors.near_duplicates(df).collect()), key=str)
    linked = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False)]
    assert got == sorted(linked + [(i, 0, i, True) for i in range(3, 10)], key=str)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hub", [0, 1500])
def test_components(spark, hub):
    r = random.Random(6)
    edges = [(10_750, 10_000 + i) for i in range(hub)] + [(10_000 + i, 20_000 + i) for i in range(0, hub, 7)]
    edges += [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5050)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(df, "a", "b").collect()} == {x: find(x) for x in root}
    assert components.components(df.limit(0), "a", "b").count() == 0


def test_whole_groups_are_never_cut():
    import pyarrow as pa

    keys = sorted([1] * 5 + [2] + [3] * 9 + [4] * 2)
    batches = [pa.record_batch({"k": keys[i : i + 4]}) for i in range(0, len(keys), 4)]
    out = []
    for table, bounds in common.whole_groups(iter(batches), ["k"]):
        out += [table["k"].to_pylist()[a:b] for a, b in itertools.pairwise(bounds.tolist())]
    assert out == [[k] * keys.count(k) for k in (1, 2, 3, 4)]


NAMES = "ids score kept lang_pred lang_spans n_words known log_weight gumbel_key n_grams n_sentences n_removed removed_spans set_key text_key own_id component_id _id _text at length span check _go sequence_id start payload n_tokens cls".split()


def test_pipeline_over_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = odd_documents(spark).unionByName(documents(spark, [t for t, _ in mixed(7, 40)], [k for _, k in mixed(7, 40)], ids=range(100, 140)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, [(i, 1, 0) for i in range(100, 140)]).write.parquet(str(tmp_path / "labels.parquet"))
    made = len(common.MADE)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} >= set(range(100, 140)) and len(common.MADE) == made + 1
    more = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})
    before = more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, before, str(tmp_path)), name)
        assert after.columns == more.columns, name
        # rows are told by columns that no stage changes
        keys = [c for c in more.columns if c not in ("text", "n_chars")]
        assert after.select(keys).exceptAll(before.select(keys)).count() == 0 and after.count() >= 40
        before = after
    assert corpus_pipeline.packed(spark, before, "").count() > 0
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    labels(spark, []).write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_the_language_stage_rejects_what_is_of_no_language_or_of_several(spark):
    import corpus_pipeline

    clean = mixed(11, 150)
    half = [" ".join((PROSE[a].split() * 3)[:60]) + " " + " ".join((PROSE[b].split() * 3)[:60]) for a, b in itertools.permutations(PROSE, 2)]
    odd = ["это русский текст для проверки языка и он не похож", "xkqz wvvrt qqpl zzxk jjwq vbnmk hhgfd qwzx plkjh mnbvc", "123 !!", "", None]
    docs = documents(spark, [t for t, _ in clean] + half + odd, [k for _, k in clean] + [None] * (len(half) + len(odd)))
    kept = {r["doc_id"] for r in corpus_pipeline.in_a_language(spark, docs, "").collect()}
    assert len(kept & set(range(150))) >= 148 and not kept - set(range(150))
    assert corpus_pipeline.in_a_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == docs.count()


def test_planted_cases_through_the_pipeline_s_stages(spark, tmp_path):
    """The stages' rows are those of a plain reading of their rules."""
    import corpus_pipeline

    r, words = random.Random(12), [w for p in PROSE.values() for w in p.split()]
    texts = [t + ". " + " ".join(r.choices(words, k=60)) + "." for t, _ in mixed(12, 60)]
    near = [t + " more" for t in texts[:10]]
    docs = documents(spark, texts + near + texts[:5])
    kept = {x["doc_id"] for x in corpus_pipeline.distinct(spark, docs, "").collect()}
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts + near + texts[:5])]
    groups = list(range(75))
    for a, b in itertools.combinations(range(75), 2):
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
            low, high = sorted((groups[a], groups[b]))
            groups = [low if g == high else g for g in groups]
    assert kept == set(groups) and len(kept) == 60
    packed = corpus_pipeline.packed(spark, docs, "").collect()
    assert sum(p["length"] for p in packed) == sum({(p["doc_id"]): p["doc_tokens"] for p in packed}.values())
