"""Packing, edit-aware counts, media, substrings and pieces: round trips and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import clashing, documents, empty_documents, odd_documents
from pyspark.sql import functions as F

from slatework.llm import edits, media, packing, pieces, substrings, tokenize

BPE = public_tokenizers.path("byte_bpe_50k.json")
SP = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def odd_texts(spark):
    return [r["text"] or "" for r in odd_documents(spark).collect()]


def test_ids_are_the_library_s(spark, library):
    texts = [*odd_texts(spark), " 's 're  \n\n x", "tab\tand  spaces   ", "naïve café", "　x y"]
    for text in texts:
        assert tokenize.encoder(BPE).ids(text).tolist() == library(text)


@pytest.mark.parametrize("block", [200, 2_000_000])
def test_every_id_is_packed_once(spark, library, block):
    r = random.Random(1)
    docs = clashing(odd_documents(spark)).unionByName(clashing(documents(spark, [" ".join(r.choices(["alpha", "beta", "gamma"], k=r.randrange(200))) for _ in range(60)], ids=range(100, 160))))
    got = packing.pack(docs, BPE, capacity=128, block_tokens=block).collect()
    wanted = defaultdict(list)
    for row in docs.collect():
        wanted[row["doc_id"]].append([*library(row["text"] or ""), 1])
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for p in got:
        ids = np.frombuffer(p["ids"], dtype="<u4").tolist()
        assert len(ids) == p["length"] > 0
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], ids))
    for group in seqs.values():
        at = 0
        for offset, length in sorted(group):
            assert offset == at
            at += length
        assert at <= 128
    for doc_id, texts in wanted.items():
        ids = sorted(i for t in texts for i in t)
        assert sorted(i for (d, _), ps in by_doc.items() if d == doc_id for _, x in ps for i in x) == ids
    total = sum(len(t) for ts in wanted.values() for t in ts)
    if block > 200:
        assert len(seqs) * 128 - total < 128 * docs.rdd.getNumPartitions()
    assert packing.pack(empty_documents(spark), BPE).count() == 0


def test_descending_pieces_go_to_the_cheapest_sequence():
    out = packing.balance(np.array([90, 60, 50, 40, 0, 16]), 128, 1 / 128)
    assert sum(size for _, _, size, _, _ in out) == 256
    assert {(i, s) for i, _, _, s, _ in out if i < 2} == {(0, 0), (1, 1)}


def test_edited_trees_count_as_the_whole_text(spark, library):
    r = random.Random(2)
    docs = [(i, t, [(r.randrange(-2, len(t) + 3), r.choice([0, 1, 5, 700]), r.choice(["", " ", "'s", "re", "\n\n", "new words. " * 100, None])) for _ in range(4)] + [None]) for i, t in enumerate(odd_texts(spark) + ["it's a te st\n\n of  blanks " * 80])]
    df = spark.createDataFrame(docs, f"doc_id long, text string, edits {edits.EDITS}")
    trees = edits.build_trees(df, BPE)
    assert [x["n_tokens"] for x in trees.orderBy("doc_id").collect()] == [len(library(t)) for _, t, _ in docs]
    for (_, text, todo), got in zip(docs, edits.apply_edits(trees, BPE).orderBy("doc_id").collect(), strict=True):
        for e in filter(None, todo):
            start = min(max(e[0], 0), len(text))
            text = text[:start] + (e[2] or "") + text[min(start + e[1], len(text)) :]
        assert got["text"] == text and got["n_tokens"] == len(library(text)) and got["tree_chars"][1] == len(text)
        half = len(got["tree_tokens"]) // 2
        assert sum(got["tree_tokens"][half:]) == got["n_tokens"]


def test_an_edit_of_a_long_text_encodes_little():
    count = lambda s: len(tokenize.encoder(BPE).ids(s))
    text = "some words in a row. " * 10_000
    assert edits.Tree.build(text, count).edit(text, 100_000, 3, "other", count)[1] < 2500


def test_leaves_keep_their_size_however_often_a_place_grows():
    count = lambda s: len(tokenize.encoder(BPE).ids(s))
    text, tree = "some words in a row. " * 20, edits.Tree.build("some words in a row. " * 20, count)
    for k in range(200):
        text, anew = tree.edit(text, 100, 0, f"inserted {k} here ", count)
        assert anew < 600
    half = len(tree.chars) // 2
    assert tree.chars[half:].max() < 300 and tree.tokens[1] == count(text) and tree.chars[1] == len(text)


def test_edits_of_odd_tables(spark, library):
    docs = clashing(odd_documents(spark)).withColumn("tree_chars", F.lit("x"))
    df = docs.withColumn("edits", F.expr("array(named_struct('start', 1L, 'length', 2L, 'replacement', ' new'))"))
    rows = edits.apply_edits(edits.build_trees(df, BPE), BPE).collect()
    assert len(rows) == 9 and all(r["n_tokens"] == len(library(r["text"] or "")) for r in rows)
    assert [r["_id"] for r in rows] == [r["_id"] for r in docs.collect()]
    assert edits.apply_edits(edits.build_trees(df.limit(0), BPE), BPE).count() == 0


def test_token_ids_of_odd_strings(library):
    r = random.Random(9)
    alphabet = ["a", "B", "é", "日", "\U0001f600", " ", "  ", "\n", "\t", "\r", "\u00a0", "\u3000", "'s", "'RE", "1", "½", "_", "!", "\x00", "\u0301", "ß", "İ", "\u2028", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(r.choices(alphabet, k=r.randrange(1, 12)))
        assert tokenize.encoder(BPE).ids(text).tolist() == library(text), repr(text)


def test_edits_of_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, [(0, 0, "x")])], f"doc_id long, text string, edits {edits.EDITS}")
    rows = edits.apply_edits(edits.build_trees(df, BPE), BPE).orderBy("doc_id").collect()
    assert [(x["text"], x["n_tokens"]) for x in rows] == [(None, 0), ("x", 1)]


def test_media_round_trip(spark):
    docs = clashing(odd_documents(spark))
    rows = media.decode_media(media.encode_media(docs)).collect()
    assert sorted(bytes(r["payload"]).rstrip(b" ") for r in rows) == sorted((r["text"] or "").encode().rstrip(b" ") for r in docs.collect())
    assert all(len(r["payload"]) % 192 == 0 and len(r["payload"]) > 0 for r in rows)
    assert len({r["feature"].split(";")[0] for r in rows}) > 1
    d = media.digest(media.decode_media(media.encode_media(docs))).filter("doc_id = 3").first()
    assert d["payload_bytes"] == 192 and d["n_bytes"] == 0 and d["tail_crc32"] == zlib.crc32(b" " * 16)
    assert media.decode_media(media.encode_media(empty_documents(spark))).count() == 0


def test_companded_bytes():
    mu, a = media.law_table("mulaw"), media.law_table("alaw")
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert sorted(mu[128:]) == sorted(-mu[:128]) and sorted(a) == sorted(-a)


def test_adpcm_blocks_are_decoded_as_one_by_one():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (50, media.HEAD + media.BLOCK), dtype=np.uint8)
    blocks[:, 2] %= 89

    def scalar(block):
        value, index = int(np.frombuffer(block[:2].tobytes(), "<i2")[0]), int(block[2])
        out = [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(media.INDEX_STEPS[code & 7])))
                out.append(value)
        return out

    assert media.decode_adpcm(blocks).tolist() == [scalar(b) for b in blocks]


def test_resampling_keeps_a_tone_and_its_samples():
    x = (10_000 * np.sin(np.arange(800) * 0.1)).astype(np.int16)
    y = media.resample(x, 2)
    assert len(y) == 1600 and (y[::2] == x).all()
    assert np.abs(y[101:1500:2] - 10_000 * np.sin((np.arange(50, 750) + 0.5) * 0.1)).max() < 60
    for up, down in ((1, 2), (2, 3), (3, 4), (1, 3)):
        low, high = (media.resample((10_000 * np.sin(np.arange(1200) * f)).astype(np.int16), up, down, taps=32) for f in (0.1, 2.9))
        assert len(low) == -(-1200 * up // down)
        inner = slice(len(low) // 4, 3 * len(low) // 4)
        assert np.abs(low[inner] - 10_000 * np.sin(np.arange(len(low))[inner] * 0.1 * down / up)).max() < 200
        # a tone above half of the new rate would come back as another
        assert np.abs(high[inner].astype(int)).max() < 400
    assert len(media.resample(x[:0], 2)) == 0


def test_pcm_is_stored(spark, tmp_path):
    stored = media.encode_media(odd_documents(spark))
    back = media.store_pcm(stored, str(tmp_path / "pcm"))
    assert back.columns == ["doc_id", "rate", "pcm"] and back.count() == 9
    want = {(r["doc_id"], bytes(r["pcm"])) for r in media.decode_media(stored).collect()}
    assert {(r["doc_id"], bytes(r["pcm"])) for r in back.collect()} == want


def test_broken_containers_are_refused():
    whole = media.to_container(b"x" * 192, "mulaw")
    for bad in (b"", whole[:-1], whole[:20] + b"\x63\x00" + whole[22:]):
        with pytest.raises(ValueError):
            media.from_container(bad)


def split_plainly(text):
    """(unit, words): sentences, those of over 16 words cut after words of least hash in 16."""
    import re

    import xxhash

    units = []
    for s in re.findall(r"[^.!?\n]*(?:[.!?\n]+[\"')\]]*\s*|$)", text or ""):
        words = re.findall(r"\s*\S+\s*", s)
        h = [xxhash.xxh3_64_intdigest(w.strip()) for w in words]
        ends = {a + k for a in range(len(h) - 15) for k in range(16) if h[a + k] == min(h[a : a + 16])} if len(h) > 16 else set()
        unit = ""
        for k, w in enumerate(words):
            unit += w
            if k in ends or k == len(words) - 1:
                units.append((unit, unit.split()))
                unit = ""
        if s and not words:
            units.append((s, []))
    assert "".join(u for u, _ in units) == (text or "")
    return units


def without_repeats(rows, run=2, least=0):
    """The operator's rule, plainly: all runs, and those that have a shorter one inside left out."""
    seen, out = set(), []
    for doc_id, text in rows:
        parts = split_plainly(text)
        wordy, gone = [w for _, w in parts if w], set()
        size = lambda a, b: sum(map(len, wordy[a:b]))
        found = {(a, b) for a in range(len(wordy)) for b in range(a + run, len(wordy) + 1) if size(a, b) >= least}
        shortest = {(a, b) for a, b in found if (a, b - 1) not in found or (a + 1, b) not in found}
        if len(wordy) >= run and size(0, len(wordy)) < least:
            shortest = {(0, len(wordy))}
        for a, b in sorted(shortest):
            key = tuple(w for unit in wordy[a:b] for w in unit)
            if key in seen:
                gone |= set(range(a, b))
            seen.add(key)
        at, kept = -1, []
        for p, w in parts:
            at += bool(w)
            if not (w and at in gone):
                kept.append(p)
        out.append((doc_id, "".join(kept), len(gone)))
    return out


@pytest.mark.parametrize("run, least", [(2, 0), (3, 0), (2, 15), (2, 30)])
def test_repeated_passages_go(spark, run, least):
    r = random.Random(4)

    def prose(n):
        return " ".join(" ".join(r.choices([f"w{i}" for i in range(900)], k=r.randrange(1, 40))) + r.choice([".", "!", "?\n", ".\n\n"]) for _ in range(n))

    shared = [prose(6) for _ in range(3)]
    texts = [prose(r.randrange(6)) + " " + r.choice(shared) + " " + prose(r.randrange(6)) if r.random() < 0.6 else prose(5) for _ in range(60)]
    texts += [shared[0] + " " + prose(1) + " " + shared[0], texts[0], "no end " * 80, "One. Two. Three.", "One. Two. Three.", "x One. Two. Three. y"]
    got = substrings.remove_repeats(clashing(documents(spark, texts)), run, least).orderBy("doc_id").collect()
    assert [(x["doc_id"], x["text"], x["n_removed"]) for x in got] == without_repeats(list(enumerate(texts)), run, least)
    assert any(x["n_removed"] for x in got) and got[0]["text"] == texts[0] and got[-2]["text"] == "" and got[-1]["text"] == ("x One. Two. Three. y" if least or run > 2 else "x One. y")


@pytest.mark.parametrize("marks", ["", ".!,"])
def test_passages_go_wherever_they_begin(spark, tmp_path, marks):
    from corpus_pipeline import without_repeats as stage
    from slatework.llm.queries import op5_substrings

    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randrange(10**9)}" + (r.choice(marks) if marks and r.random() < 0.1 else "") for _ in range(n))
    passages = [prose(r.choice([50, 55, 80])) for _ in range(40)]
    texts = [f"{prose(r.randrange(1, 60))} {p} {prose(r.randrange(1, 60))}" for _ in range(2) for p in passages]
    docs = documents(spark, texts)
    got = [x["text"] for x in stage(spark, docs, "").orderBy("doc_id").collect()]
    assert got[:40] == texts[:40]
    for p, before, after in zip(passages, texts[40:], got[40:], strict=True):
        p, kept = p.split(), after.split()
        assert [w for w in before.split() if w not in p] == [w for w in kept if w not in p]
        left = [k for k, w in enumerate(p) if w in kept]
        assert all(k < 16 or k >= len(p) - 16 for k in left)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [x["kept_chars"] for x in op5_substrings(spark, str(tmp_path)).orderBy("doc_id").collect()] == [len(t) for t in got]


def test_repeats_in_odd_rows(spark):
    docs = odd_documents(spark)
    got = substrings.remove_repeats(docs).collect()
    assert len(got) == 9 and {(r["doc_id"], r["text"]) for r in got if r["doc_id"] != 4} == {(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] != 4}
    assert substrings.remove_repeats(empty_documents(spark)).count() == 0


def test_pieces_without_dropout_are_the_library_s(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=SP)
    docs = documents(spark, [t for t in odd_texts(spark) if "▁" not in t] + ["  two  blanks  ", "x" * 300])
    for row in pieces.encode(docs, SP, dropout=0.0).collect():
        assert row["ids"] == model.encode(row["text"])


def test_pieces_under_dropout_vary_and_decode(spark):
    docs = clashing(odd_documents(spark))
    a, b = (pieces.encode(docs, SP, dropout=0.3, seed=s) for s in (1, 2))
    assert a.exceptAll(pieces.encode(docs, SP, dropout=0.3, seed=1)).count() == 0
    assert a.select("ids").exceptAll(b.select("ids")).count() > 2
    for coded in (a, b):
        assert pieces.decode(coded, SP).filter(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert pieces.decode(pieces.encode(empty_documents(spark), SP), SP).count() == 0


def test_words_vary_within_documents_and_over_the_corpus(spark):
    rows = pieces.encode(documents(spark, ["international"] * 200 + [" ".join(["international"] * 200)]), SP).orderBy("doc_id").collect()
    assert len({tuple(r["ids"]) for r in rows[:200]}) > 4
    ids = np.array(rows[200]["ids"])
    ends = np.cumsum(pieces.pieces(SP).size[ids])
    words = np.split(ids, np.flatnonzero(ends % len(" international") == 0) + 1)[:-1]
    assert len(words) == 200 and len({tuple(w) for w in words}) > 4


@pytest.mark.parametrize("dropout", [0.0, 0.2, 0.7])
def test_arrays_and_agenda_agree(dropout):
    bpe = pieces.pieces(SP)
    words = ["▁" + "".join(random.Random(i % 70).choices("abcdeé日\U0001f600", k=1 + i % 70)) for i in range(300)] + ["▁international"] * 300
    seeds = pieces.occurrence_seeds(np.array([-7, 9]), np.array([400, 200]))
    known = pieces.Remembered(bpe)
    known.encode(words[:50], seeds[:50], dropout)
    ids, n = known.encode(words, seeds, dropout)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [np.frombuffer(bpe.one(w, int(s), dropout), "<i4").tolist() for w, s in zip(words, seeds, strict=True)]
