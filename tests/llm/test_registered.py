"""Every registered query over small tables of odd rows, against what plain Python makes of them."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from helpers import PROSE, documents, labels

from slatework.llm import pieces, queries


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder of the tables that the queries read."""
    folder, r = tmp_path_factory.mktemp("sf"), random.Random(3)
    texts, langs = [], []
    for lang, prose in PROSE.items():
        words = prose.split()
        for _ in range(40):
            texts.append(". ".join(" ".join(r.choices(words, k=r.randrange(3, 30))).capitalize() for _ in range(r.randrange(1, 8))))
            langs.append(lang)
    texts += [None, "", "1234 !!", texts[0], texts[0] + " more", "word " * 4000, "日本語 ▁ \U0001f600\x00\r\n"]
    langs += [None, "en", "en", "en", "en", None, "ja"]
    documents(spark, texts, langs).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels(spark, [(i, int(i % 5 > 0), 0) for i in range(0, 120, 2)]).write.parquet(f"{folder}/labels.parquet")
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate([None, "", "<p>" + "a" * 200, "<p>" + "a" * 200, "<p>short", "<p>short", "é" * 80])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    v = [[r.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, x, i % 3) for i, x in enumerate([*v, v[0], [y * 2 for y in v[1]], None, [0.0] * 8])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def rows(spark, sf, name):
    return {r[0]: r for r in queries.queries()[name](spark, sf).collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet/*.parquet'")
    ours = queries.queries()[name](spark, sf)
    if name == "op6_embeddings":  # cosine of null and zero vectors is no number in SQL
        con.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet' WHERE vec_id < 32")
        ours = ours.filter("vec_id < 32")
    cols = sorted(ours.columns)
    theirs = con.sql(queries.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert sorted(map(str, theirs)) == sorted(str(tuple(r)) for r in ours.select(*cols).collect())


def test_token_counts(spark, sf, texts, ids_of):
    made = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", queries.made_edits().alias("edits")).collect()
    got = rows(spark, sf, "op2_token_counts")
    assert got.keys() == texts.keys()
    for r in made:
        text, found = texts[r["doc_id"]] or "", got[r["doc_id"]]
        assert found["n_tokens_before"] == len(ids_of(text))
        for e in r["edits"]:
            text = text[: e["start"]] + (e["replacement"] or "") + text[e["start"] + e["length"] :]
        assert found["n_tokens_after"] == len(ids_of(text)) and found["n_chars_after"] == len(text)


def test_packing(spark, sf, texts, ids_of):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in queries.op3_packing(spark, sf).collect():
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for doc, parts in by_doc.items():
        ids, at = [*ids_of(texts[doc] or ""), 1], 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_media(spark, sf, texts):
    got = rows(spark, sf, "op4_media")
    assert got.keys() == texts.keys()
    for doc, r in got.items():
        text = (texts[doc] or "").encode()
        payload = text + b" " * (-len(text) % 192 if text else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(text), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])


def test_languages(spark, sf, texts):
    got = rows(spark, sf, "op7_language_id")
    assert got.keys() == texts.keys()
    for doc, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[doc] or ""))
    held = [d for d in range(120) if got[d]["held_out"]]
    assert sum(got[d]["lang_pred"] == list(PROSE)[d // 40] for d in held) >= 0.95 * len(held)


def test_pieces(spark, sf, texts):
    got = rows(spark, sf, "op8_pieces")
    assert got.keys() == texts.keys() and all(r["lossless"] for r in got.values())


def test_the_sample_is_half_of_the_documents(spark, sf, texts):
    got = rows(spark, sf, "op10_quality")
    kept = [r["gumbel_key"] for r in got.values() if r["kept"]]
    assert len(kept) == round(len(texts) / 2)
    assert min(kept) > max(r["gumbel_key"] for r in got.values() if not r["kept"])


def test_repeats(spark, sf, texts):
    got = rows(spark, sf, "op5_substrings")
    copy = next(d for d in texts if d >= 120 and texts[d] == texts[0])
    assert got.keys() == texts.keys() and got[copy]["n_removed"] == got[copy]["n_sentences"]


def merged_plainly(model, word, seed, dropout):
    """One word's pieces by the definition: while there is a merge that is not skipped, make the one of the
    best rank, the leftmost of equals. Skips are by place, pieces and seed, computed here in integers."""
    mask = (1 << 64) - 1
    k = [int(x) for x in pieces._K]
    parts = [(i, c) for i, c in enumerate(word)]

    def skip(place, a, b):
        x = (seed ^ xxhash.xxh3_64_intdigest(word)) ^ (place * k[1] & mask) ^ (a * k[2] & mask) ^ (b * k[3] & mask)
        x = (x ^ (x >> 32)) * k[0] & mask
        x = (x ^ (x >> 29)) * k[1] & mask
        return (x >> 11) / 2.0**53 < dropout

    while True:
        able = []
        for (i, a), (_, b) in zip(parts, parts[1:]):
            whole = model.piece_to_id(a + b)
            if whole != model.unk_id() and model.id_to_piece(whole) == a + b and not skip(i, model.piece_to_id(a), model.piece_to_id(b)):
                able.append((-model.get_score(whole), i))
        if not able:
            return [model.piece_to_id(p) for _, p in parts]
        at = next(j for j, (i, _) in enumerate(parts) if i == min(able)[1])
        parts[at : at + 2] = [(parts[at][0], parts[at][1] + parts[at + 1][1])]


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_dropout_by_its_definition(dropout):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, bpe, r = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path), random.Random(5)
    words = ["▁" + "".join(r.choices("etaoinshrdlu", k=r.randrange(1, 14))) for _ in range(150)] + ["▁the", "▁international", "▁segmentation", "▁running"] * 8
    varied = set()
    for i, word in enumerate(words):
        got = np.frombuffer(bpe.one(word, i, dropout), "<i4").tolist()
        assert got == merged_plainly(model, word, i, dropout)
        varied.add((word, tuple(got)))
    assert len({g for w, g in varied if w == "▁international"}) > 1
