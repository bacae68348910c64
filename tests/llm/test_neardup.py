"""Near-duplicate documents against brute force."""

import random

import pytest
from helpers import clashing, documents, empty_documents, odd_documents

from slatework.llm import neardup


def brute_force(rows, width, percent):
    sets = []
    for _, text in rows:
        w = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=25):
    """Base texts with copies of a few changed words, and one passage in all of them."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(r.choices(vocabulary, k=12))
    texts = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.choice([1, 2, 3, 5, 20, 60, 200]))
        for _ in range(r.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy) + (f" {common}" if r.random() < 0.4 else "") if r.random() < 0.9 else " ".join(copy).upper())
    return texts


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_groups_are_those_of_brute_force(spark, seed, width, percent):
    texts = corpus(seed)
    found = neardup.near_duplicates(documents(spark, texts), width=width, percent=percent)
    assert sorted(tuple(r)[:4] for r in found.collect()) == brute_force(list(enumerate(texts)), width, percent)


def test_long_lists_and_large_clusters_are_cut_in_cells(spark, monkeypatch):
    r = random.Random(3)
    base = r.choices([f"w{i}" for i in range(500)], k=80)
    texts = [" ".join(w if r.random() > 0.015 else "x" for w in base) for _ in range(60)]
    texts += [" ".join(base[: r.randrange(5, 80)] + [f"y{i}"] * (i % 3)) for i in range(60)]
    small = neardup.banded_grid
    monkeypatch.setattr(neardup, "banded_grid", lambda df, key, member, size, weight, limit, ratio: small(df, key, member, size, weight, 10 if weight == "one" else 12_000, ratio))
    found = neardup.near_duplicates(documents(spark, texts), width=3, percent=85)
    assert sorted(tuple(r)[:4] for r in found.collect()) == brute_force(list(enumerate(texts)), 3, 85)


@pytest.mark.parametrize("most_rows", [3, 25])
@pytest.mark.parametrize(("seed", "width", "percent"), [(11, 3, 85), (12, 5, 80)])
def test_long_lists_give_way_to_rarer_values(spark, monkeypatch, seed, width, percent, most_rows):
    r = random.Random(seed)
    line = r.choices([f"c{i}" for i in range(50)], k=60)
    texts = corpus(seed, 10)
    for _ in range(30):  # texts of one common line each, some in two or three near copies
        own = r.choices([f"w{i}" for i in range(3000)], k=r.choice([20, 60, 150]))
        texts += [" ".join([*line, *own[: len(own) - k]]) for k in range(r.choice([1, 1, 2, 3]))]
    texts += [" ".join([*line[:k], "x", *line[k:]]) for k in range(0, 60, 2)]  # near copies of the line alone
    cut = neardup.candidates
    monkeypatch.setattr(neardup, "candidates", lambda classes, ratio: cut(classes, ratio, 20, most_rows))
    found = neardup.near_duplicates(documents(spark, texts), width=width, percent=percent)
    assert sorted(tuple(r)[:4] for r in found.collect()) == brute_force(list(enumerate(texts)), width, percent)


def test_one_common_value_costs_no_copies(spark):
    r = random.Random(1)
    rows = []
    for i in range(3000):  # all have the value 5; every two also share most of theirs with each other
        own = sorted(r.sample(range(10, 2**32), 47)) if i % 2 == 0 else [*own[:46], own[46] + 1]
        wide = [5, *own]
        rows.append((i.to_bytes(16, "big"), 60, b"".join(v.to_bytes(4, "little") for v in wide), [v << 32 for v in wide[:8]]))
    classes = spark.createDataFrame(rows, "set_key binary, n_shingles long, sketch binary, listed array<long>")
    ratio = neardup.Fraction(85, 100)
    cells = neardup.candidate_cells(classes, ratio, 0.3, 100, 800)
    assert cells.filter("value = 5L << 32").count() == 0 and cells.count() < 30 * 3000
    assert neardup.candidate_cells(classes, ratio, 0.3, 100, 5000).count() > 35 * 3000
    links = {(bytes(a), bytes(b)) for a, b in neardup.candidates(classes, ratio, 100, 800).collect()}
    assert {tuple(sorted(x)) for x in links} == {((i).to_bytes(16, "big"), (i + 1).to_bytes(16, "big")) for i in range(0, 3000, 2)}


def test_only_lists_of_several_sets_are_laid_out(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):  # every tenth set is one of a cluster of near copies, the others share nothing
        own = sorted(r.sample(range(100, 2**32), 48))
        wide = [*range(1, 48), own[-1]] if i % 10 == 0 else own
        rows.append(((300 - i).to_bytes(16, "big"), 60, b"".join(v.to_bytes(4, "little") for v in wide), [v << 32 for v in wide[:8]]))
    classes = spark.createDataFrame(rows, "set_key binary, n_shingles long, sketch binary, listed array<long>")
    ratio = neardup.Fraction(85, 100)
    cells = neardup.candidate_cells(classes, ratio, 0.3, 100, 800)
    assert cells.count() == 30 * 8
    # every shuffle leaves files of each task until the driver's garbage is collected
    assert cells._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 6
    links = {(bytes(a), bytes(b)) for a, b in neardup.candidates(classes, ratio, 100, 800).collect()}
    assert links == {((300 - i).to_bytes(16, "big"), (10).to_bytes(16, "big")) for i in range(0, 290, 10)}


def test_odd_rows(spark):
    found = neardup.near_duplicates(clashing(odd_documents(spark)), width=3, percent=85).collect()
    rows = sorted((tuple(r)[:4] for r in found), key=str)
    assert len(rows) == 9
    assert (2, 0, 2, True) in rows and (3, 0, 3, True) in rows
    assert rows.count((1, 7, 1, True)) == 2
    assert (4, 1, 4, True) in rows and (None, 8, None, True) in rows
    assert neardup.near_duplicates(empty_documents(spark)).count() == 0


def test_equal_rows_leave_one(spark):
    docs = odd_documents(spark)
    kept = neardup.first_of_each(docs, neardup.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "4", "5", "6", "None"] or kept.count() == 8


def test_rows_without_an_id_take_part(spark):
    base = [f"w{i}" for i in range(300)]
    near = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in (50, 150, 250)]
    far = " ".join(reversed(base))
    rows = [(1, near[0]), (None, near[1]), (None, near[2]), (None, far), (None, far), (None, far + " more"), (2, "else"), (None, None)]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    groups = neardup.near_duplicates(docs)
    got = sorted((tuple(r)[:4] for r in groups.collect()), key=str)
    linked = [x for x in got if x[1] == 296]
    assert sorted((x[2], x[3]) for x in linked if x[0] is None and x[2] == 1) == [(1, False), (1, False)]
    assert sum(x[3] for x in got if x[0] is None and x[1] and x[2] is None) in (1, 2)
    kept = [r["text"] for r in neardup.first_of_each(docs, groups).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [near[0], "else", None, *({far, far + " more"} & set(kept))])) and len(kept) == 4


def test_the_query_is_its_sql(spark, tmp_path):
    import duckdb

    from slatework.llm.queries import OP1_SQL, op1_minhash

    docs = documents(spark, corpus(5) + ["", None, "  A\tb\u00a0c ", "a B\u00a0c"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        wanted = db.execute(OP1_SQL).fetchall()
    assert sorted(tuple(r) for r in op1_minhash(spark, str(tmp_path)).collect()) == sorted(wanted)
