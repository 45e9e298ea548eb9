"""Near copies, repeated passages and near vectors against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_tables import ROWS

from tablewright.llm import chosen_path, lattice_near_dedup, pairs, suffix_dedup
from tablewright.llm.common import components, local_roots
from tablewright.llm.registry import QUERIES, table


def smallest(n, links):
    left, right = (np.array([x[i] for x in links], int) for i in (0, 1))
    return local_roots(n, left, right)


def test_components_of_paths_stars_and_self_links(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 160)}, 7: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- vectors ---------------------------------------------------------------------------------


def test_lattice_points_are_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, (200, 8))
    near = lattice_near_dedup.nearest_point(x)
    steps = lattice_near_dedup.minimal_vectors()
    assert steps.shape == (240, 8) and np.allclose((steps ** 2).sum(1), 2)
    own = ((x - near) ** 2).sum(1)
    others = ((x[:, None] - near[:, None] - steps[None]) ** 2).sum(2).min(1)
    assert (own <= others + 1e-9).all()
    whole = np.isclose(near, np.rint(near)).all(1)
    assert np.allclose(near.sum(1) % 2, 0) and np.isclose(near[~whole] % 1, 0.5).all()


def brute_vectors(rows):
    unit = []
    for _, v in rows:
        ok = v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    return links


@pytest.mark.parametrize("block", [1_024, 8])
def test_vectors_link_like_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows, base = [], rng.normal(size=(60, 32))
    for i, v in enumerate(base):
        for k in range(i % 7):
            w = v + rng.normal(0, (0.05, 0.3, 0.46)[k % 3], 32)
            rows.append((len(rows), [float(np.float32(c)) for c in w]))
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [nan] * 32), (1004, [inf] + [1.0] * 31),
             (1005, [None] + [1.0] * 31), (1006, [1.0] * 4), (1007, [1.0] * 4), (1007, [1.0] * 4), (1008, [2.0] * 4)]
    rows += [(2000 + i, rows[3][1]) for i in range(30)]
    links = brute_vectors(rows)
    got = lattice_near_dedup.link_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("x", "rid"), block=block).collect()
    n, root = Counter(x for link in links for x in link), smallest(len(rows), links)
    ids = [r[0] for r in rows]
    names = {r: min(ids[i] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    wanted = Counter((ids[i], n[i], names[root[i]], ids[i] == names[root[i]]) for i in range(len(rows)))
    mine = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
    missed = sum((wanted - mine).values())
    assert sum(r["n_links"] for r in got) >= 0.9 * 2 * len(links)
    assert sum(r["n_links"] for r in got) <= 2 * len(links)
    assert missed <= 0.1 * len(rows)


@pytest.mark.parametrize("blocks", [1, 2, 3, 4])
def test_tables_reach_the_recall_with_more_blocks(blocks):
    rng = np.random.default_rng(9)
    n, size = 1_500, 64
    x, y = rng.normal(size=(2, n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.9 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    tables = lattice_near_dedup.tables_for(lattice_near_dedup.RECALL, blocks)
    ours, theirs = (lattice_near_dedup.cells(v, tables, blocks).reshape(n, tables, -1) for v in (x, y))
    met = np.zeros(n, bool)
    for t in range(tables):
        met |= (ours[:, t, :, None] == theirs[:, t, None, :]).any((1, 2))
    assert met.mean() >= lattice_near_dedup.RECALL - 0.005


def test_vectors_link_in_two_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice_near_dedup, "CROWD", 0.1)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 32))
    rows = [(2 * i + k, [float(c) for c in v + k * rng.normal(0, 0.4, 32)]) for i, v in enumerate(base) for k in (0, 1)]
    assert math.ceil(math.log(len(rows) / 0.1) / -math.log(lattice_near_dedup.FAR)) == 2
    got = lattice_near_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    links = 2 * len(brute_vectors(rows))
    assert links > 200 and 0.97 * links <= sum(r["n_links"] for r in got) <= links


def test_no_vectors(spark):
    assert lattice_near_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vector_query_finds_every_link(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r for r in QUERIES["op9_lattice_near_dedup"](spark, sf).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert 0.9 * linked.sum() <= found <= linked.sum()


# -- documents ----------------------------------------------------------------------------------


def runs(text):
    words = [w for w in (text or "").encode().split()]
    size = min(5, len(words))
    return {tuple(words[i: i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_documents(texts):
    sets, where, links = [runs(t) for t in texts], defaultdict(list), []
    for i, s in enumerate(sets):
        shared = Counter(j for run in s for j in where[run])
        links += [(i, j) for j, n in shared.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
        for run in s:
            where[run].append(i)
    return links


def check_documents(got, documents):
    links = brute_documents([t for _, t in documents])
    n, root = Counter(x for link in links for x in link), smallest(len(documents), links)
    ids = [d for d, _ in documents]
    names = {r: min((ids[i] for i in range(len(ids)) if root[i] == r and ids[i] is not None), default=None) for r in set(root)}
    wanted = Counter((ids[i], n[i], names[root[i]]) for i in range(len(ids)))
    assert Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in got) == wanted
    assert sum(r["kept"] for r in got) == len(set(root))


def test_document_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    check_documents(QUERIES["op8_chosen_path"](spark, sf).collect(), docs)


def test_odd_documents(spark, odd, none):
    check_documents(chosen_path.link_documents(odd).collect(), [(r[0], r[1]) for r in ROWS])
    assert chosen_path.link_documents(none).count() == 0
    kept = chosen_path.keep_one(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    # three equal rows and the two long texts leave one each
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [-9, 0, 0, 1, 3, 4, 5, 6, 8]


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(90):  # one large group of near copies that all differ
        words = base[:]
        words[rng.randrange(120)] = f"own{i}"
        docs.append((i, " ".join(words)))
    docs += [(200 + i, " ".join(rng.choice(base) for _ in range(80))) for i in range(30)]
    check_documents(chosen_path.link_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_runs_find_pairs_of_any_agreement_in_crowded_buckets():
    # All buckets split to the end; signatures agree in a binomial number of coordinates.
    rng, pairs_, size = np.random.default_rng(6), 3_000, chosen_path.COORDINATES
    runs_ = chosen_path.runs_for(chosen_path.RECALL, chosen_path.SIMILARITY, chosen_path.DEPTH)
    ours = rng.integers(0, 1 << 32, (pairs_, size), np.uint32)
    theirs = np.where(rng.random((pairs_, size)) < chosen_path.SIMILARITY, ours, ours ^ np.uint32(1))
    met = np.zeros(pairs_, bool)
    for run in range(runs_):
        pair, path = np.arange(pairs_), rng.integers(0, 1 << 63, pairs_).astype(np.uint64)
        for _ in range(chosen_path.DEPTH):
            (i, a), (j, b) = (chosen_path._children(path, side[pair], chosen_path.SIMILARITY) for side in (ours, theirs))
            both = set(zip(pair[i].tolist(), a.tolist())) & set(zip(pair[j].tolist(), b.tolist()))
            pair, path = np.array([p for p, _ in both], int), np.array([c for _, c in both], np.uint64)
        met[pair] = True
    assert met.mean() >= 0.9985
    with pytest.raises(ValueError):
        chosen_path.runs_for(1.0, chosen_path.SIMILARITY, chosen_path.DEPTH)


def test_jaccard_matrix_in_chunks():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(20)]
    exact = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets]
    assert np.allclose(chosen_path.jaccard_matrix(sets, chunk=7), exact)


def test_every_pair_meets_in_one_comparison(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99)], "k long, rid long")
    dealt = pairs.block_pairs(rows, "k", 8).collect()
    groups = defaultdict(list)
    for r in dealt:
        groups[r["g"]].append(r)
    met = Counter()
    for rows_ in groups.values():
        for a in rows_:
            for b in rows_:
                if a["rid"] < b["rid"] and (not a["cross"] or a["b"] != b["b"]):
                    met[a["rid"], b["rid"]] += 1
    assert len(met) == 50 * 49 // 2 and set(met.values()) == {1}


# -- passages --------------------------------------------------------------------------------------


def brute_passages(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i: i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i: i + 400]] > 1:
                gone[i: i + 400] = b"\1" * 400
        spans = sum(1 for part in bytes(gone).split(b"\0") if part)
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, kept))
    return out


def test_passage_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    wanted = {d: (n, r, s, hashlib.sha256(k).hexdigest()) for (d, _), (n, r, s, k) in zip(docs, brute_passages([t for _, t in docs]))}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op2_suffix_dedup"](spark, sf).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == wanted


@pytest.mark.parametrize("piece", [1 << 21, 700])
def test_passages_of_odd_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    shared = " ".join(word() for _ in range(300))
    own = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", "short", "a" * 1_000, "ab" * 600, own(200), shared[:398], shared[:400], own(40) + shared[:405] + own(60),
             own(3) + shared + own(3), shared[500:1_000] + own(30) + shared[500:1_000], own(90) + shared[300:701], shared, shared,
             "a" * 399 + "b", ("line of a licence\n" * 60), own(500) + ("line of a licence\n" * 30)]
    docs = spark.createDataFrame([(i % 15, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spot long").repartition(3)
    stored = suffix_dedup.with_row_ids(docs)
    numbers = {r["rid"]: r["spot"] for r in stored.collect()}
    got = {numbers[r["rid"]]: r for r in suffix_dedup.cut(suffix_dedup.repeats(stored)).collect()}
    for i, (n, removed, spans, kept) in enumerate(brute_passages(texts)):
        if i in got:
            assert (got[i]["n_bytes"], sum(s["high"] - s["low"] for s in got[i]["removed"]), len(got[i]["removed"])) == (n, removed, spans)
            assert bytes(got[i]["kept"]) == kept
        else:
            assert removed == 0


def test_truncated_third_copies_lose_nothing(spark):
    # Two copies of a short passage and a third without its first bytes; in the chosen ones it
    # begins after a change of anchor inside a block of windows.
    rng = random.Random(11)
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    texts = []
    for i in range(530):
        n = rng.randrange(420, 541)
        passage = own(n)
        start = rng.randrange(1, n - 399)
        three = [own(150) + passage + own(150), own(170) + passage + own(150), own(160) + passage[start:] + own(140)]
        if i in (429, 489, 528):
            texts += three
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    got = {r["rid"]: bytes(r["kept"]) for r in suffix_dedup.cut(suffix_dedup.repeats(docs)).collect()}
    assert [got.get(i) for i in range(len(texts))] == [kept for _, _, _, kept in brute_passages(texts)]


def test_cutting_keeps_columns_and_rows(spark, odd, none):
    done = suffix_dedup.cut_repeats(odd)
    assert done.columns == odd.columns
    by_id = {(r["doc_id"], r["rid"]): r["text"] for r in done.collect()}
    assert len(by_id) == len(ROWS)
    assert [t for (d, _), t in by_id.items() if d == 6] == [""] and [t for (d, _), t in by_id.items() if d == 7] == [" end"]
    assert suffix_dedup.cut_repeats(none).count() == 0


def test_wide_vectors_with_one_large_component_keep_their_links(spark):
    """Components far below one 256th of the largest, which eight bits lose, make most of the length."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=8_192) * 0.01
    x[0] = 6.0
    near, far = x + rng.normal(size=8_192) * 1e-4, np.concatenate([[0.6], rng.normal(size=8_191) * 0.01])
    rows = [(1, x.tolist()), (2, near.tolist()), (3, far.tolist()), (4, (-x).tolist())]
    turned = x.copy()
    turned[1:] = rng.permutation(x[1:]) * 6
    rows.append((5, turned.tolist()))
    vectors = np.array([v for _, v in rows])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    wanted = {i: int(((unit @ unit[k]) >= 0.9).sum()) - 1 for k, (i, _) in enumerate(rows)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["n_links"] for r in lattice_near_dedup.link_vectors(df).collect()} == wanted
    assert wanted[1] >= 1
