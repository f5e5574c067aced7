"""Vector codes, near-duplicate vectors and fill-in-the-middle against brute force, with the odd cases in small tables."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tripleweave.llm import ball_kmeans, fill_middle, multi_index  # noqa: E402

# --- fill in the middle ------------------------------------------------------------------------------------------------

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def slow_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = [int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if doc_id is None or not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


_rng = random.Random(4)
TEXTS = ["".join(_rng.choice("ab é中😀 \n\t\x0b\x85<>PSM") for _ in range(_rng.randint(0, 400))) for _ in range(150)]
TEXTS += [None, "", " ", "\n\n", "word", " word", "word ", "<P>", "a <S> b", "<<P>>", "x" * 5000 + " y", "é " * 3000, "w " * 50_000, "same text", "same text"]


def test_middle_equals_brute_force(spark):
    rows = [(k, t, "clash", 1) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 2), (None, "no id", "x", 3), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, n int").repartition(3)
    found = fill_middle.fill_in_middle(docs)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()), key=str)
    want = sorted(((k, *slow_middle(k, t)) for k, t, *_ in rows), key=str)
    assert got == want
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    digests = fill_middle.digests(found).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r.doc_id), r.restored_sha256) for r in digests) == sorted((str(k), sha(t)) for k, t, *_ in rows)
    assert sorted(r.output_sha256 for r in digests) == sorted(sha(w[5]) for w in want)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    always = fill_middle.fill_in_middle(docs, rate=100, suffix_first=0)
    assert {r.form for r in always.collect()} == {"plain", "psm"}


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_every_cut_is_found(block):
    for text in TEXTS[:60]:
        index = fill_middle.UnitIndex((text or "").encode(), block)
        units = UNIT.findall(text or "")
        assert index.units == len(units)
        for k in range(len(units) + 1):
            prefix = "".join(units[:k])
            assert index.cut(k) == (len(prefix.encode()), len(prefix))


# --- codes -------------------------------------------------------------------------------------------------------------


def whole(v):
    most = ball_kmeans.limit_of(len(v))
    return [int(max(-most, min(most, np.floor(max(-1e300, min(1e300, 1024 * float(x))))))) for x in v]


def slow_codes(rows):
    """Plain k-means by the contract: ``{vec_id: [(code, error)]}`` and the codebooks of every dimension."""
    good = [(i, whole(v), label) for i, v, label in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, books_of = [], {}
    for dim in sorted({len(v) for _, v, _ in good}):
        own = sorted((r for r in good if len(r[1]) == dim), key=lambda r: (r[0], r[1]))
        cuts = [dim * k // 4 for k in range(5)]
        parts = [[v[a:b] for _, v, _ in own] for a, b in zip(cuts, cuts[1:])]
        books = [[list(x) for x in p[:256]] for p in parts]
        gap = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
        near = lambda x, book: min(range(len(book)), key=lambda k: (gap(x, book[k]), k))
        for _ in range(4):
            for p, book in zip(parts, books):
                held = {}
                for x in p:
                    held.setdefault(near(x, book), []).append(x)
                for k, xs in held.items():
                    book[k] = [sum(c) // len(xs) for c in zip(*xs)]
        codes = [[near(x, book) for x in p] for p, book in zip(parts, books)]
        for r, (i, _, label) in enumerate(own):
            error = sum(gap(p[r], book[c[r]]) for p, book, c in zip(parts, books, codes))
            out.append((i, "".join(f"{c[r]:02x}" for c in codes), error, label, dim))
        text = ",".join(str(x) for book in books for e in book for x in e)
        books_of[dim] = hashlib.sha256(text.encode()).hexdigest()
    sums = {}
    for _, _, error, label, _ in out:
        sums[label] = sums.get(label, 0) + error
    return sorted(((i, c, e, sums[label], books_of[dim]) for i, c, e, label, dim in out), key=str)


def vector_rows(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = [(k, (centres[k % 9] + 0.2 * rng.normal(size=dim)).astype(np.float32).tolist(), [0, 1, None][k % 3]) for k in range(n)]
    rows += [(n + k, rows[5][1], 7) for k in range(40)] + [(5, rows[5][1], 0)]
    return rows


def test_codes_equal_brute_force(spark):
    rows = vector_rows(420, 8, 1)
    rows += [(9000, None, 1), (9001, [float("nan")] * 8, 1), (9002, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (9003, [1e30] * 8, 2), (9004, [-3e9] * 8, 2)]
    rows += [(9005, [1.0, 2.0], 0), (9006, [1.5, 2.0], 0), (9007, [0.0] * 6, None)]
    table = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "vec_id bigint, embedding array<double>, label int, code string, error double")
    got = ball_kmeans.coded(table.repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_codes([r[:3] for r in rows])
    assert ball_kmeans.coded(table.limit(0)).count() == 0


def test_balls_give_the_nearest_entry():
    rng = np.random.default_rng(2)
    points = rng.integers(-40, 40, (4000, 3))  # many ties
    entries = np.concatenate([points[:60], points[:4]])  # and entries that are equal
    own = ball_kmeans.Codebook(entries).assign_all(points)
    saved = 0
    for _ in range(4):
        for k in range(len(entries)):
            if (own == k).any():
                entries[k] = points[own == k].sum(axis=0) // (own == k).sum()
        book = ball_kmeans.Codebook(entries)
        own = book.assign(points, own)
        gaps = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (own == gaps.argmin(axis=1)).all()
        saved = book.compared / gaps.size
    assert saved < 0.3
    big = np.array([[1 << 28, -(1 << 28)], [1 << 28, 5]])
    assert ball_kmeans.squared(big, big).tolist() == [[0, ((1 << 28) + 5) ** 2], [((1 << 28) + 5) ** 2, 0]]


# --- near-duplicate vectors --------------------------------------------------------------------------------------------


def slow_links(rows, least=0.9):
    good = [(k, np.array(v, float)) for k, (i, v, *_) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (a, v) in enumerate(good):
        for b, w in good[x + 1 :]:
            if len(v) == len(w) and float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)) >= least:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least_id = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least_id[find(k)] = min(least_id.get(find(k), i), i)
    return sorted(((r[0], links[k], None if r[0] is None else least_id[find(k)], r[0] is not None and least_id[find(k)] == r[0]) for k, r in enumerate(rows)), key=str)


def crowd(seed, dim=12):
    """Scattered vectors, copies, and clusters of every tightness, so that angles lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(150)]
    for spread, many in ((0.0, 60), (0.02, 60), (0.08, 60), (0.2, 60), (0.3, 60), (0.45, 40)):
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        rows += [(base + spread * rng.normal(size=dim) / dim**0.5) * rng.uniform(0.1, 9) for _ in range(many)]
    order = rng.permutation(len(rows))
    return [(int(k) * 3, rows[k].tolist()) for k in order]


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL_ROWS", 24)
    monkeypatch.setattr(multi_index, "QUERY_ROWS", 16)
    rows = crowd(1)
    rows += [(rows[0][0], rows[0][1]), (7000, None), (7001, [float("inf")] * 12), (7002, [None] + [1.0] * 11), (7003, [0.0] * 12), (None, rows[1][1]), (7004, [1.0, 2.0]), (7005, [2.0, 4.1])]
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id bigint, embedding array<double>, n_links int, kept string").repartition(4)
    got = multi_index.near_duplicate_vectors(table)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = slow_links(rows)
    links = sum(w[1] for w in want)
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert [f[0] for f in found] == [w[0] for w in want]
    assert 0.97 * links <= sum(f[1] for f in found) <= links  # none below the threshold, and nearly all
    monkeypatch.setattr(multi_index, "visits_needed", lambda balls, grid, *_: grid.cells)
    every = multi_index.near_duplicate_vectors(table)  # all cells visited: all links
    assert sorted((tuple(r) for r in every.collect()), key=str) == want
    assert multi_index.near_duplicate_vectors(table.limit(0)).count() == 0


def test_one_sided_visits_count_for_both():
    """Pairs met by one side only are counted for both ends, those met by both sides once for each."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(6, 4)) * 0.05 + np.array([1.0, 0, 0, 0])
    pack = lambda at, home, ways: multi_index._Pack(
        np.array(at), np.ones(len(at), np.int64), np.zeros(len(at)), rows[at], np.array([home] * len(at), np.int32), np.array([ways] * len(at), np.int32)
    )
    counts, links, *_ = multi_index.compare_packs(pack([0, 1], 0, [0, 1]), pack([2, 3], 1, [1, 2]), 0.9)
    assert sorted(counts.tolist()) == [[0, 2], [1, 2], [2, 2], [3, 2]]
    counts, *_ = multi_index.compare_packs(pack([0, 1], 0, [0, 1]), pack([2, 3], 1, [1, 0]), 0.9)
    assert sorted(counts.tolist()) == [[0, 2], [1, 2]]
    assert len(links) == 3  # a forest, not all pairs


def test_cells_come_nearest_first():
    rng = random.Random(6)
    for _ in range(100):
        a, b = (sorted(rng.randint(0, 9) for _ in range(rng.randint(1, 6))) for _ in range(2))
        cells = multi_index.multi_sequence(a, b, list(range(len(a))), list(range(len(b))), len(a) * len(b))
        assert sorted(cells) == list(range(len(a) * len(b)))
        sums = [a[c // len(b)] + b[c % len(b)] for c in cells]
        assert sums == sorted(sums)


def test_recall_of_a_grid_fitted_on_a_sample(spark, monkeypatch):
    """A grid fitted on a third of the rows, its visits calibrated on a few: links of all rows against brute force."""
    monkeypatch.setattr(multi_index, "SAMPLE_ROWS", 700)
    monkeypatch.setattr(multi_index, "CALIBRATION", 60)
    monkeypatch.setattr(multi_index, "CELL_ROWS", 12)
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(1400, 16))
    near = rows[:700] / np.linalg.norm(rows[:700], axis=1, keepdims=True)
    away = rng.normal(size=near.shape)
    away -= (away * near).sum(axis=1, keepdims=True) * near
    cosine = rng.uniform(0.85, 0.97, (700, 1))
    rows = np.concatenate([rows, cosine * near + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True)])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in multi_index.near_duplicate_vectors(table).collect()}
    counts = linked.sum(axis=1)
    assert all(got[k] <= counts[k] for k in got)
    assert sum(got.values()) >= 0.97 * counts.sum()
