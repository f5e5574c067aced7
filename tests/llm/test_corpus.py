"""The corpus operators against brute force and exact round trips, on small tables with the odd cases in them."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tripleweave.llm import arc, byte_bpe, kdtree, kmeans_tree, langid, packing, sentence_spans, sharding, simhash, simple8b  # noqa: E402
from tripleweave.llm.components import components  # noqa: E402
from tripleweave.llm.queries import BYTE_RANKS, ORACLES, QUERIES, WORD_VOCABULARY  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `lang_pred` string"
SF = "/root/testdata/sf0.001"

_rng = random.Random(5)
_SYLLABLES = ["tion", "er", "an", "the", "st", "ou", "re", "in", "ble", "and"]


def prose(words: int) -> str:
    out = ["".join(_rng.choice(_SYLLABLES) for _ in range(_rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + ("." if k % 7 == 6 else ",") if k % 7 in (3, 6) else w for k, w in enumerate(out)) + "."


PASSAGE = prose(80)
BASE = prose(300)
TEXTS = [
    BASE, BASE, BASE.replace("tion", "tion", 1), BASE + " one more word", None, "", "  \n ", "A", "Ä ö 中文 don't 123 <|endoftext|>",
    prose(40) + " " + PASSAGE + " " + prose(30), prose(25) + " " + PASSAGE + " " + prose(50), "la la la la " * 200,
    "x" * 5000, prose(6000), "line one is here\n" * 30, *[prose(_rng.randint(1, 120)) for _ in range(60)],
]
ROWS = [(k, t, ["en", "de", None][k % 3], f"s{k % 4}", 1, "clash") for k, t in enumerate(TEXTS)]
ROWS += [(3, TEXTS[3], "en", "s", 1, "x"), (None, "no id here. but words there are.", None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(doc_id):
    return (doc_id is not None, doc_id or 0)


# --- simhash ---------------------------------------------------------------------------------------------------------


def slow_print(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(values, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_near_duplicates_equal_brute_force(docs):
    prints = [(r[0], slow_print(r[1])) for r in ROWS]
    root = groups(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for doc_id, p in prints:
        if doc_id is not None:
            least[root[p]] = min(least.get(root[p], doc_id), doc_id)
    want = sorted(((d, f"{p:016x}", least.get(root[p])) for d, p in prints), key=str)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    kept = simhash.survivors(docs).collect()
    named = sorted(r["doc_id"] for r in kept if r["doc_id"] is not None)
    assert named == sorted(set(least.values()))
    # one row each: groups with an id by its least, groups of rows without any id by one of them
    assert len(kept) == len(set(root[p] for _, p in prints))
    assert list(kept[0].asDict()) == docs.columns


def test_variants_are_written_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    near = base[:40] ^ np.uint64(0b1011) ^ (np.uint64(1) << np.uint64(50))
    fps = np.unique(np.concatenate([base, near]))
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 1 << 10)
    links = np.concatenate([simhash.links_in_group(fps, g, 4, 4) for g in range(16)])
    found = groups(fps.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)
    pairs = {tuple(p) for p in links.tolist()}
    assert groups(fps.tolist(), lambda a, b: (a, b) in pairs or (b, a) in pairs) == found


def test_near_dedup_stage_takes_edited_copies(spark):
    from corpus_pipeline import one_of_each_group

    rng = random.Random(21)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randint(0, 999)) for _ in range(250)) for _ in range(12)]
    for base in texts[:8]:
        for edits in (1, 3, 5, 9):
            words = base.split()
            for at in rng.sample(range(250), edits):
                words[at] = "edited"
            texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), "four words are here", "five words are here now", "", None]
    prints = [slow_print(t) for t in texts]

    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [grams(t) for t in texts]
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = sorted(set(groups(range(len(texts)), near).values()))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in one_of_each_group(spark, rows, "").collect()) == want
    assert len(want) < len(set(groups(range(len(texts)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4).values()))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(0, 40)]
    star = [(100, 100 + k) for k in range(1, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


# --- substring dedup -------------------------------------------------------------------------------------------------


def test_repeated_passage_goes_once_and_clean_texts_stay(docs):
    rows = {(r["doc_id"], r["text"]): r for r in sentence_spans.remove_repeats(docs).collect()}
    inner = " ".join(PASSAGE.split()[12:-12])
    holders = [r for r in rows.values() if r["clean_text"] and inner in " ".join(r["clean_text"].split())]
    assert [r["doc_id"] for r in holders] == [9]
    assert rows[(0, BASE)]["clean_text"] == BASE and rows[(1, BASE)]["clean_text"] == ""
    assert rows[(4, None)]["clean_text"] is None and rows[(5, "")]["clean_text"] == ""
    assert rows[(13, TEXTS[13])]["removed"] == []
    for r in rows.values():
        if r["text"]:
            kept, at = "", 0
            for hole in r["removed"]:
                kept, at = kept + r["text"][at : hole["start"]], hole["end"]
            assert kept + r["text"][at:] == r["clean_text"]


def slow_clean(texts):
    seen, out = {}, []
    for doc, text in texts:
        for run in {h for h in sentence_spans.spans(text)[2]}:
            seen.setdefault(run, doc)
    for doc, text in texts:
        cut, runs, hashes = sentence_spans.spans(text)
        gone, own = set(), set()
        for (a, b), h in zip(runs, hashes):
            if seen[h] < doc or h in own:
                gone.update(range(a, b))
            own.add(h)
        out.append("".join(text[a:b] for k, (a, b) in enumerate(cut) if k not in gone))
    return out


def test_spans_equal_brute_force(spark):
    texts = [(k, t) for k, t in enumerate(TEXTS) if t]
    got = {r["doc_id"]: r["clean_text"] for r in sentence_spans.remove_repeats(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert [got[k] for k, _ in texts] == slow_clean(texts)


def test_texts_without_punctuation_meet(spark):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    whole, passage, one = words(101), words(120), words(25)
    texts = [whole, whole, words(40) + " " + passage + " " + words(33), words(31) + " " + passage + " " + words(47), one, one, "so it is, " * 4 + "and ends"]
    texts += [texts[-1], words(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["clean_text"] for r in sentence_spans.remove_repeats(rows).collect()}
    assert got[0] == whole and got[1] == "" and got[4] == one and got[5] == "" and got[7] == "" and got[8] == texts[8]
    assert got[2] == texts[2]
    left, inside = set(got[3].split()), set(passage.split())
    assert len(left & inside) < 50 and left - inside == set(texts[3].split()) - inside


# --- tokens ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_VOCABULARY)
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_places_every_piece(docs, word_ids):
    rows = packing.pack_pieces(packing.token_pieces(docs, WORD_VOCABULARY), lot_pieces=30).collect()
    whole = [(r[0], word_ids(r[1])) for r in ROWS]
    want = sorted(((d, at // 4096, at, len(i[at : at + 4096]), crc(i[at : at + 4096])) for d, i in whole for at in range(0, len(i), 4096)), key=str)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(len(i) for _, i in whole) // 4096) + 1


def test_swaps_only_improve():
    rng = np.random.default_rng(1)
    sizes = rng.integers(900, 2900, 300).tolist()
    first = packing.best_fit(sizes, 4096)
    better = packing.swap_search([list(b) for b in first], sizes, 4096)
    square = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
    assert sorted(i for b in better for i in b) == list(range(300))
    assert len(better) <= len(first) and square(better) >= square(first)
    assert packing.pack_lot([6, 5, 4, 3, 2], 10) and len(packing.pack_lot([6, 5, 4, 3, 2], 10)) == 2


def test_ids_come_back_from_files(docs, word_ids):
    rows = sorted(simple8b.ids_round_trip(docs, WORD_VOCABULARY).collect(), key=lambda r: r["start"])
    assert [key(r["doc_id"]) for r in rows] == sorted(key(r[0]) for r in ROWS)
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    want = sorted(((r[0], len(word_ids(r[1])), crc(word_ids(r[1]))) for r in ROWS), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=str) == want


@pytest.mark.parametrize("n", [0, 1, 59, 61, 1023, 1025, 600_000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 2**62, 2**64 - 1])
def test_simple8b_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64)
    ids[rng.random(n) < 0.3] &= np.uint64(3)
    assert (simple8b.unpack_words(*simple8b.pack_words(ids), n) == ids).all()


def test_byte_bpe_equals_the_library(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in ROWS:
        ids = library.encode_ordinary(r[1] or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in byte_bpe.encode_digests(docs, BYTE_RANKS).collect()), key=str) == sorted(want, key=str)
    import pyarrow as pa

    rng = random.Random(2)
    odd = ["".join(rng.choice(" \n\t'stmdrevlLx1٣²!é中 　😀") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    odd += ["ab" * 3000, "-" * 400 + " x"]
    ids, offsets = byte_bpe.codec(BYTE_RANKS).encode(pa.array(odd))
    for k, text in enumerate(odd):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode_ordinary(text), text


# --- language, shards, archives, search -----------------------------------------------------------------------------


def test_language_id(spark, docs):
    found = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = langid.fit(found)
    rows = langid.classify(found, model).filter(langid.held_out()).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)
    odd = langid.classify(docs, model)
    assert odd.columns == [*docs.drop("lang_pred").columns, "lang_pred", "score", "rejected"]
    for r in odd.collect():
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in model.langs and 0 <= r["score"] <= 1


def test_shards_are_minimax(spark, docs):
    rows = sharding.shard(docs, 6).collect()
    assert len(rows) == len(ROWS)
    size = lambda t: len((t or "").encode()) + 16
    first, total = {}, {}
    for r in ROWS:
        t = r[1] or ""
        total[t] = total.get(t, 0) + size(t)
        first[t] = min(first.get(t, 1 << 60), 1 << 59 if r[0] is None else r[0])
    order = [total[t] for t in sorted(total, key=lambda t: (first[t], hashlib.sha256(t.encode()).digest()))]

    def fits(capacity):
        shards, held = 1, 0
        for s in order:
            if held + s > capacity:
                shards, held = shards + 1, 0
            held += s
        return shards <= 6

    least = next(c for c in range(max(order), sum(order) + 1) if fits(c))
    sums, slots = {}, {}
    for r in rows:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(sums.values()) == least
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["text_crc32"] for r in rows} == {zlib.crc32((r[1] or "").encode()) for r in ROWS}


def test_archives_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "ü" * 4000, "\r\n\r\nWARC/1.1 \n" * 9, "<p>a</p>"]
    pages = [(k * 3, f"http://x.example/{k} é" if k % 2 else None, h) for k, h in enumerate(html)] + [(None, "u", "<p>a</p>")]
    got = arc.archive_round_trip(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    want = []
    for page, _, h in pages:
        same = [p for p, _, x in pages if (x or "") == (h or "") and p is not None]
        revisit = page is not None and page < max(same)
        data = (h or "").encode()
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers(version):
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nline\n\nhttp://not.a/header 1 2 3 4\n"
    data = arc.arc_version_block("f.arc", version, "20010203040506")
    data += arc.arc_record(version, "http://a.example/with blank", "20010203", "text/html", body, "f.arc") + b"\n"
    records = list(arc.arc_records(data))
    assert records[1][0]["URL"] == "http://a.example/with blank" and records[1][1] == body
    assert arc.warc_date("2001") == "2001-01-01T00:00:00Z" and arc.warc_date("20010203") == "2001-02-03T00:00:00Z"
    with pytest.raises(ValueError):
        list(arc.arc_records(data[:-9]))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + 0.3 * rng.normal(size=8)).tolist()) for k in range(400)]
    rows += [(400 + k, rows[7][1]) for k in range(60)] + [(1000, None), (1050, [float("nan")] * 8), (1100, [None] + [1.0] * 7), (1150, [0.0] * 8), (None, [1.0] * 8), (1200, [1.0, 2.0]), (1250, [3.0, 1.0])]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def usable(row):
    return row[0] is not None and row[1] is not None and all(x is not None and np.isfinite(x) for x in row[1])


def test_exact_search_equals_brute_force(vectors):
    rows, table = vectors
    good = [r for r in rows if usable(r)]
    want = []
    for q, v in good:
        if q % 50 == 0:
            whole = [int(np.floor(256 * x)) for x in v]
            scores = [(-sum(a * int(np.floor(256 * b)) for a, b in zip(whole, w)), c) for c, w in good if c != q and len(w) == len(v)]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(sorted(scores)[:5])]
    got = kdtree.exact_top_k(table, table.filter("vec_id % 50 = 0"), shard_rows=100, query_rows=3)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_huge_components_are_exact(spark):
    rows = [(0, [1e30, -1e30, 3.0]), (1, [1e20, 1e20, 5.0]), (2, [1e20, 1e20, 9.0]), (3, [-1e30, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in kdtree.exact_top_k(table, table.filter("vec_id = 0")).collect()]
    assert got == [(2, 256 * 3 * 256 * 9), (1, 256 * 3 * 256 * 5), (3, -(2**63))] or [v for v, _ in got] == [2, 1, 3]


def test_queries_come_to_a_lot_of_leaves_once_and_are_not_broadcast(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(400, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    tree = kmeans_tree.fit_tree(kmeans_tree.units(rows), leaf_rows=2)
    leaf = {i: int(x) for i, x in enumerate(tree.leaf_of(kmeans_tree.units(rows)))}
    bins = kmeans_tree.blocks(table.withColumn("leaf", F.udf(leaf.get, "int")("vec_id")), 4096, ["leaf"])
    queries = table.filter("vec_id < 20").withColumn("qkey", F.col("vec_id"))
    met = kmeans_tree._meetings(queries, bins, tree, tree.leaves)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == tree.leaves and kmeans_tree._packed(queries, tree, tree.leaves, 32).agg(F.sum("qn")).first()[0] == 20 * 32
    for most in (1, 3, tree.leaves):
        got = sorted((r["query_id"], r["vec_id"]) for r in kmeans_tree._search_lots(queries, bins, tree, most, 400).collect())
        ways = {q: set(tree.visits(v, most)) for q, v in enumerate(kmeans_tree.units(rows)[:20])}
        assert got == sorted((q, i) for q, own in ways.items() for i in leaf if leaf[i] in own and i != q)


def test_approximate_search_recall(vectors):
    rows, table = vectors
    good = [r for r in rows if usable(r) and any(r[1])]
    got = {}
    for r in kmeans_tree.approximate_top_k(table, table.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, v in good:
        if q % 50 == 0:
            cosine = lambda w: float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))  # noqa: B023, E731
            best = sorted(((-cosine(w), c) for c, w in good if c != q and len(w) == len(v)))[:5]
            own = sorted(got.get(q, []))
            assert [k for k, _, _ in own] == list(range(1, len(own) + 1)) and len(own) == len(best)
            for _, c, s in own:
                assert abs(s - cosine(dict(good)[c])) < 1e-12
            worst = -best[-1][0] - 1e-12
            hits += sum(s >= worst for _, _, s in own)
            total += len(best)
    assert hits >= 0.9 * total


# --- empty tables and registered queries ------------------------------------------------------------------------------


def test_empty_tables(spark, none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.survivors(none).count() == 0
    assert sentence_spans.remove_repeats(none).count() == 0
    assert packing.pack_pieces(packing.token_pieces(none, WORD_VOCABULARY)).count() == 0
    assert simple8b.ids_round_trip(none, WORD_VOCABULARY).count() == 0
    assert byte_bpe.encode_digests(none, BYTE_RANKS).count() == 0
    assert sharding.shard(none).count() == 0
    assert langid.classify(none, langid.fit(none)).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert arc.archive_round_trip(pages).count() == 0
    rows = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert kdtree.exact_top_k(rows, rows).count() == 0 and kmeans_tree.approximate_top_k(rows, rows).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    from workloads.compare import connect, differences

    assert differences(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) is None


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in rows.select("doc_id").collect()}
    groups_of = simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert ids <= {r["doc_id"] for r in groups_of} and len(ids) >= 0.9 * len({r["component_id"] for r in groups_of})


# --- near copies, links and rejection on larger groups -----------------------------------------------------------------


@pytest.mark.parametrize("n", [100, 200, 400])
def test_links_grow_with_fingerprints(n):
    """One group of near copies: a row per fingerprint and group at most, not one per pair or shared variant."""
    rng = np.random.default_rng(n)
    fps = {0}
    while len(fps) < n:
        fps.add(int(sum(1 << int(b) for b in rng.choice(64, 2, replace=False))))
    values = np.array(sorted(fps), np.uint64)
    for group in range(8):
        links = simhash.links_in_group(values, group, 3, 4)
        assert n // 2 < len(links) < n
    assert simhash.group_bits(n, 2081) == 0 and simhash.group_bits(10**7, 2081) == 8 and simhash.group_bits(10**10, 2081) > 11


def families(seed, count, size):
    """Texts of a few templates with some words changed, so that pairs lie on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(count):
        base = [word() for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 6, 9])):
                own[at] = word()
            texts.append(" ".join(own))
    return texts + [" ".join(word() for _ in range(80)) for _ in range(50)]


def test_near_copies_of_large_families(spark):
    """Every pair of 0.8 or more lies in one component, in groups far larger than the leaders of a round."""
    from tripleweave.llm import near_copies

    texts = families(3, 3, 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = near_copies.described(docs)
    node = {r["doc_id"]: bytes(r["node"]) for r in rows.collect()}
    pairs = [(bytes(r["a"]), bytes(r["b"])) for r in near_copies.node_links(rows, docs).collect()]
    grams = {node[k]: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in enumerate(texts)}
    for a, b in pairs:
        assert len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    root = {n: n for n in grams}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    names, apart, total = list(grams), 0, 0
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(grams[a] & grams[b])
            if both and both >= 0.8 * (len(grams[a]) + len(grams[b]) - both):
                total += 1
                apart += find(a) != find(b)
    assert total > 5000 and apart == 0


def test_junk_and_foreign_languages_are_rejected(spark):
    found = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = langid.fit(found)
    rng = random.Random(3)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    junk = [
        " ".join(word("bcdfghjklmnpqrstvwxz", rng.randint(3, 9)) for _ in range(60)), word("0123456789abcdef", 500),
        base64.b64encode(bytes(rng.randrange(256) for _ in range(400))).decode(), " ".join(word("asdfjkl;qweruiop", 8) for _ in range(50)),
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(junk)], "doc_id bigint, text string")
    assert all(r["rejected"] and r["lang_pred"] in model.langs for r in langid.classify(rows, model).collect())


def test_classifier_equals_a_plain_loop(docs):
    """The same model read by a plain loop over its parts."""
    model = langid.fit(docs.withColumn("lang", docs["source"]))
    for r in langid.classify(docs, model).collect():
        letters = sum(c.isalpha() for c in (r["text"] or "").lower())
        if not letters or not model.langs:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        counts, length = langid.gram_counts(r["text"])
        assert length == min(langid.LENGTHS - 1, letters.bit_length())
        vector = [np.log1p(float(c)) * w for c, w in zip(counts.tolist(), model.idf.tolist())]
        norm = sum(x * x for x in vector) ** 0.5
        scores = [sum(x * y for x, y in zip(centroid, vector)) / norm for centroid in model.centroids.astype(float).tolist()]
        best = max(range(len(scores)), key=lambda k: scores[k])
        assert abs(scores[best] - r["score"]) < 1e-5
        near = [model.langs[model.of_lang[k]] for k in range(len(scores)) if scores[k] > scores[best] - 1e-5]
        assert r["lang_pred"] in near
        if abs(1 - scores[best] - model.reach[best, length]) > 1e-5 and len(near) == 1:
            assert r["rejected"] == (1 - scores[best] > model.reach[best, length])


def test_exchanges_see_all_documents_of_a_bin():
    """Of forty short documents only the last two together are worth more than the one document that can come for them."""
    sizes = np.array([*[10] * 38, 33, 28, 60, 439])
    fill, holder = np.array([441, 499]), np.array([0] * 40 + [1, 1])
    step = packing._best_step(list(range(40)), sizes, 0, fill, np.arange(42), holder, sizes, 500)
    assert (sorted(step[0]), step[1:]) == ([38, 39], (40, 1))
    assert packing._best_step(list(range(38)), sizes, 0, np.array([380, 499]), np.arange(42), holder, sizes, 500) is None
