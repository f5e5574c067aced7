import random

import brute
import pytest
import tiny
from pyspark.sql import functions as F

from tripleweave.operators import blocking, classes, evaluate, matching, predicates, skew, value_join
from tripleweave.operators.filters import literal_triples
from tripleweave.plans import align


def collect(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def result(df):
    return {(r.s1, r.s2): round(r.score, 6) if r.score != float("inf") else r.score for r in df.collect()}


def rounded(d):
    return {k: round(v, 6) if v != float("inf") else v for k, v in d.items()}


def test_people_leaves_and_deduction(spark):
    t1, t2 = tiny.triples(spark, tiny.PEOPLE1), tiny.triples(spark, tiny.PEOPLE2)
    pairs = predicates.match_predicates(t1, t2)
    # every name ending of one site has its equal on the other; has#name occurs under two hosts on side 1
    assert pairs.count() == 5
    found = align.align_entities(t1, t2, pairs, skip_lowest=True)
    rows = result(found)
    assert tiny.short(rows) == {("person1", "person3"), ("city1", "place1"), ("city2", "place2")}
    assert set(rows.values()) == {1.0}
    full = align.deduce_relations(t1, t2, found)
    late = tiny.short(collect(full.filter("stage = 1"), "s1", "s2"))
    assert late == {("person2", "person4"), ("person2", "person3"), ("person3", "person4")}


def test_cars_levels(spark):
    t1, t2 = (literal_triples(tiny.triples(spark, r)) for r in (tiny.CARS1, tiny.CARS2))
    g1, g2 = tiny.triples(spark, tiny.CARS1), tiny.triples(spark, tiny.CARS2)
    pairs = predicates.equal_predicates(g1, g2)
    assert pairs.count() == 8
    blocks = blocking.block_by_predicate(t1, t2, pairs)
    assert blocks.count() == 38
    counts = blocking.common_predicate_counts(blocks)
    assert {(r["count"], r.n) for r in counts.groupBy("count").agg(F.count("*").alias("n")).collect()} == {(1, 26), (2, 6)}
    two = tiny.short(collect(counts.filter("count = 2"), "s1", "s2"))
    assert ("person1", "car3") not in two and ("car1", "person3") not in two
    clusters = align.cluster_subjects(g1, g2, pairs)
    stats = {(r["count"], r.pairs, r.comparisons) for r in blocking.cluster_level_stats(clusters).collect()}
    assert stats == {(1, 26, 26), (2, 6, 12)}
    found = result(align.align_entities(g1, g2, pairs, skip_lowest=True))
    assert tiny.short(found) == {("person1", "person3"), ("car1", "car3"), ("car2", "car4")}
    assert found == result(matching.match_leaves_of_blocks(blocks, counts, skip_lowest=True))
    assert result(align.align_entities(g1, g2, pairs, min_shared=2)) == found
    assert set(result(align.align_entities(g1, g2, pairs))) > set(found)


WORDS = ["red", "reds", "blue", "bolt", "bolts", "new", "york", "jersey", "gear", "gears", "plate", "12", "1555", "15556"]


def random_graph(rng, host, subjects, hub=False):
    rows = []
    for i in range(subjects):
        for p in ("name", "brand", "kind", "code"):
            for _ in range(rng.choice([0, 1, 1, 1, 1, 2])):
                n = rng.choice([1, 1, 2, 2, 3, 5])
                words = [rng.choice(WORDS) for _ in range(n)]
                if rng.random() < 0.15:
                    words = ["new"] * n
                rows.append((f"<{host}/{i}>", f"<{host}/{p}>", '"' + " ".join(words) + '"'))
    if hub:
        for k in range(12):
            rows.append((f"<{host}/0>", f"<{host}/name>", f'"alias{k} {WORDS[k]}"'))
    return sorted(set(rows))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_leaves_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    r1 = random_graph(rng, tiny.A, 14, hub=seed % 2 == 0)
    r2 = random_graph(rng, tiny.B, 12, hub=seed > 2)
    names = [(f"<{tiny.A}/{p}>", f"<{tiny.B}/{p}>") for p in ("name", "brand", "kind", "code")]
    if seed > 2:
        names.append((names[0][0], names[1][1]))
    t1, t2 = tiny.triples(spark, r1), tiny.triples(spark, r2)
    pairs = spark.createDataFrame(names, "predicate1 string, predicate2 string")
    table = brute.block_table(r1, r2, names)
    want = rounded(brute.leaves(table))
    assert want
    assert result(matching.match_leaves(t1, t2, pairs, skip_lowest=True)) == want
    blocks = blocking.block_by_predicate(t1, t2, pairs)
    assert blocks.count() == len(table)
    slow = matching.match_leaves_of_blocks(blocks, blocking.common_predicate_counts(blocks), skip_lowest=True)
    assert result(slow) == want
    if seed != 2:
        return
    every = rounded(brute.leaves(table, skip_lowest=False))
    assert result(matching.match_leaves(t1, t2, pairs)) == every
    alone = rounded(brute.leaves(table, skip_lowest=False, exclusive=True))
    assert result(slow := matching.match_leaves_of_blocks(blocks, blocking.common_predicate_counts(blocks), exclusive=True)) == alone
    assert slow.columns == ["s1", "s2", "score"]


def test_exclusive_levels(spark):
    """A subject matched with three shared predicates takes no part in the levels below, whoever its partners there are."""
    found = [("a", "x", 1.0, 3), ("a", "y", 1.0, 2), ("b", "x", 1.0, 2), ("b", "y", 1.0, 1), ("c", "y", 1.0, 2), ("c", "z", 1.0, 2), ("d", "z", 1.0, 1), ("e", "w", 1.0, 1)]
    kept = matching.level_by_level(spark.createDataFrame(found, "s1 string, s2 string, score double, count bigint"))
    assert collect(kept, "s1", "s2") == {("a", "x"), ("c", "y"), ("c", "z"), ("e", "w")}


def test_wide_subjects_equal_brute_force(spark):
    """Forty shared predicates, a subject with very many partner values, and one that has a value in every statement."""
    rng = random.Random(9)
    props = [f"p{k:02}" for k in range(40)]
    rows = {1: [], 2: []}
    for host, side in ((tiny.A, 1), (tiny.B, 2)):
        for i in range(14):
            held = props if i % 3 else rng.sample(props, rng.randint(1, 6))
            for k, p in enumerate(held):
                value = f"value{(i * 7 + k) % 11 if rng.random() < 0.85 else rng.randint(0, 99)} {p}" if k % 4 else "common to all"
                rows[side].append((f"<{host}/{i}>", f"<{host}/{p}>", f'"{value}"'))
    many = [(f"<{tiny.A}/many>", f"<{tiny.A}/p01>", f'"alias number{k:05} of it"') for k in range(400)]
    rows[1] += many + [(f"<{tiny.A}/many>", f"<{tiny.A}/{p}>", '"common to all"') for p in props[::4]]
    rows[2] += [(f"<{tiny.B}/{i}>", f"<{tiny.B}/p01>", f'"alias number{i:05} of it"') for i in range(14, 30)]
    rows[2] += [(f"<{tiny.B}/{i}>", f"<{tiny.B}/{p}>", '"common to all"') for i in range(14, 20) for p in props[::4]]
    names = [(f"<{tiny.A}/{p}>", f"<{tiny.B}/{p}>") for p in props]
    t1, t2 = tiny.triples(spark, rows[1]), tiny.triples(spark, rows[2])
    pairs = spark.createDataFrame(names, "predicate1 string, predicate2 string")
    want = rounded(brute.leaves(brute.block_table(rows[1], rows[2], names), skip_lowest=False))
    assert len(want) > 20 and any("many" in k[0] for k in want)
    assert result(matching.match_leaves(t1, t2, pairs)) == want


def test_frequent_keys_are_dealt_out(spark):
    """A value that a third of all subjects have makes no task above ten times the median, and no row is lost."""
    left = spark.range(120_000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 20_011).alias("k"))
    right = spark.range(4000).select(F.col("id").alias("b"), F.when(F.col("id") % 10 == 0, -1).otherwise(F.col("id") % 20_011).alias("k"))
    joined = skew.dealt_join(left, right, ["k"])
    plain = left.join(right, "k")
    total = joined.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b", "k").cast("decimal(38,0)")).alias("h"))
    assert total.first() == plain.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b", "k").cast("decimal(38,0)")).alias("h")).first()
    ways = skew.key_ways(left, right, ["k"], 8).collect()
    assert [w.k for w in ways] == [-1] and ways[0].ways1 * ways[0].ways2 >= 8
    cells = joined.groupBy(F.spark_partition_id()).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = sorted(r["count"] for r in skew.dealt_join(left, right.hint("merge"), ["k"]).groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert cells.count() and spread[-1] <= 10 * spread[len(spread) // 2]


def test_plans_hit_every_match(spark):
    """Any way to exceed the needed score is similar in as many blocks of the head as the plan says."""
    rng = random.Random(3)
    rows, entries_of = [], {}
    for g in range(300):
        n = rng.randint(1, 7)
        entries = [
            (rng.random() ** rng.choice([0.3, 3]), b, float(rng.choice([1, 1, 1, 8, float("inf")])) * rng.choice([1.0, 2.0]), rng.choice([0.5, 1.0, 40.0])) for b in range(n)
        ]
        rows.append((f"l{g}", f"r{g}", 1000, 1000, n, {1: 0.95, 2: 0.9, 3: 0.8}.get(n, 0.7), entries))
        entries_of[f"l{g}"] = entries
    schema = "g1 string, g2 string, n1 bigint, n2 bigint, count bigint, threshold double, entries array<struct<density: double, b: bigint, weight: double, spread: double>>"
    plan = matching.key_plan(spark.createDataFrame(rows, schema)).withColumn("sets", F.when(F.col("size") == 2, matching._sets(2)).when(F.col("size") == 3, matching._sets(3))).collect()
    assert len(plan) == len(rows) and {r["size"] for r in plan} == {1, 2, 3}
    for r in plan:
        entries = entries_of[r.g1]
        need = {1: 0.95, 2: 0.9, 3: 0.8}.get(r["count"], 0.7) * r["count"]
        for mask in range(1, 2 ** len(entries)):
            similar = {e[1] for e in entries if mask >> e[1] & 1}
            if sum(e[2] for e in entries if e[1] in similar) > need:
                assert len(similar & set(r["head"])) >= r["size"], (entries, r, similar)
                assert r["sets"] is None or any(set(x) <= similar for x in r["sets"])
    wide = [(0.001 * b, b, 1.0, 1.0) for b in range(40)]
    one = matching.key_plan(spark.createDataFrame([("l", "r", 10, 10, 40, 0.7, wide)], schema)).first()
    assert len(one["head"]) == 11 + one["size"]  # eleven may differ, whatever the number of sets


def test_modes_on_blocks(spark):
    rows = [("<x>", "Red Bolt", "<y>", "red bolt", "p", "q"), ("<x>", "same", "<z>", "same", "p", "q")]
    blocks = spark.createDataFrame(rows, "s1 string, literal1 string, s2 string, literal2 string, p1 string, p2 string")
    assert result(matching.score_blocked(blocks, "exact")) == {("<x>", "<z>"): 1.0}
    assert result(matching.score_blocked(blocks, "lexical")) == {("<x>", "<y>"): 1.0, ("<x>", "<z>"): 1.0}
    assert result(matching.score_blocked(blocks)) == {("<x>", "<y>"): 1.0, ("<x>", "<z>"): 1.0}


def test_level_operators(spark):
    blocks = spark.createDataFrame(
        [("a", "x1", "b", "x1", "p", "q"), ("a", "x2", "b", "x3", "r", "t"), ("a", "x1", "c", "x1", "p", "q")],
        "s1 string, literal1 string, s2 string, literal2 string, p1 string, p2 string",
    )
    clusters = blocking.common_predicate_counts(blocks)
    level = matching.literals_of_cluster(blocks, clusters, 2)
    assert level.count() == 2
    done = spark.createDataFrame([("a", "b", 1.0)], "s1 string, s2 string, score double")
    assert matching.literals_of_cluster(blocks, clusters, 2, done).count() == 0
    scores = spark.createDataFrame(
        [("a", "b", 1.0), ("a", "b", 0.9), ("a", "c", 0.8), ("d", "d", 1.0)], "s1 string, s2 string, score double"
    )
    counts = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("d", "d", 1)], "s1 string, s2 string, count long")
    assert result(matching.aggregate_matches(scores, counts)) == {("a", "b"): 0.95, ("a", "c"): 0.8}
    assert result(matching.aggregate_matches_level(scores.filter("s2 = 'b'"), 2)) == {("a", "b"): 0.95}
    assert result(matching.aggregate_matches_level(scores.filter("s2 = 'c'"), 1)) == {}


def test_parent_modes(spark):
    blocks = spark.createDataFrame(
        [("a", "x1", "b", "x1", "p", "q"), ("a", "abcd efgh", "b", "abcd efgx", "r", "t"), ("c", "x1", "c", "x1", "p", "q")],
        "s1 string, literal1 string, s2 string, literal2 string, p1 string, p2 string",
    )
    earlier = spark.createDataFrame([("k", "l", 0.8)], "s1 string, s2 string, score double")
    assert set(result(matching.match_parents(blocks, earlier))) == {("a", "b"), ("k", "l")}
    assert set(result(matching.match_parents(blocks, earlier, "normed"))) == {("a", "b")}


def test_equal_subjects_are_matched_as_one(spark, monkeypatch):
    seen = []

    def equal_values(side1, side2, *options):
        seen.append((side1.count(), side2.count()))
        left, right = side1.select(F.col("s").alias("s1"), "b", "v"), side2.select(F.col("s").alias("s2"), "b", "v")
        return left.join(right, ["b", "v"]).filter("s1 != s2").select("s1", "s2", F.lit(1.0).alias("score"))

    monkeypatch.setattr(matching, "match_classes", equal_values)
    for copies in (1, 6):
        rows = [(f"{host}{v}-{k}", "b", v, 1) for host in "xy" for v in ("red", "blue") for k in range(copies)]
        # one subject that both sides have, with the values of the copied ones
        sides = [spark.createDataFrame([r for r in rows if r[0][0] == h] + [("both", "b", "red", 1)], "s string, b string, v string, m long") for h in "xy"]
        found = collect(matching.match_sides(*sides), "s1", "s2")
        one, two = ([r for r in d.collect()] for d in sides)
        assert found == {(x.s, y.s) for x in one for y in two if x.v == y.v and x.s != y.s}
    assert seen == [(3, 3), (3, 3)]


def test_evaluation_of_unknown_ends(spark):
    gold = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", None), ("c", None), ("d", "e")], "s1 string, s2 string")
    found = spark.createDataFrame([("b", "a"), ("b", "a"), ("c", None), ("x", "y")], "s1 string, s2 string")
    row = evaluate.evaluate_alignment(gold, found).collect()[0]
    # directed: ba, ab, (c, ?), (?, c), xy, yx
    assert (row.gold_pairs, row.found_pairs, row.missed, row.extra, row.hits) == (3, 2, 2, 5, 1)


def test_cells_give_the_pairs_of_rare_words(spark, monkeypatch):
    """texts that share frequent words are counted lot by lot; pairs don't travel with their words."""
    import random

    from tripleweave.operators import value_join

    rnd = random.Random(3)
    words = [f"word{i}" for i in range(12)]

    def texts(n, k):
        return sorted({(b, " ".join(rnd.choices(words, weights=range(12, 0, -1), k=rnd.randint(2, k)))) for b in (1, 2) for _ in range(n)})

    sides = [value_join.by_key(value_join.with_tokens(spark.createDataFrame(texts(n, k), "b int, v string"))) for n, k in ((40, 9), (30, 7))]
    sims = spark.createDataFrame([(w, w) for w in words] + [("word0", "word3"), ("word11", "word10")], "x string, y string")
    score = lambda h, n1, n2: float("inf") if h == n1 + n2 else h / (n1 + n2 - h)

    def found(threshold, keys):
        rows = value_join.token_pairs(*sides, sims, threshold, keys).collect()
        kept = sorted(tuple(r) for r in rows if score(r.hits, r.n1, r.n2) >= threshold)
        return kept, sum(score(r.hits, r.n1, r.n2) < threshold for r in rows)

    want = {(t, k): found(t, [*k])[0] for t, k in ((0.4, ("b",)), (0.7, ()))}
    monkeypatch.setattr(value_join, "_FEW_PAIRS", 0)
    monkeypatch.setattr(value_join, "_SPARSE", 1e9)
    monkeypatch.setattr(value_join, "_CELL", 7)
    for (t, k), rows in want.items():
        assert rows and found(t, [*k]) == (rows, 0)  # no others are written out, either


def test_lots_are_multiplied_densely_and_one_by_one(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tripleweave.functions import cells

    monkeypatch.setattr(cells, "_COLUMNS", 3)
    rnd = np.random.default_rng(5)
    counts = [rnd.integers(1, 4, (n, 40)) * (rnd.random((n, 40)) < np.linspace(0.02, 0.9, 40)) for n in (30, 25)]
    rows = [[np.flatnonzero(r) for r in c] for c in counts]
    lots = [
        pa.table({"n": pa.array(c.sum(1), pa.int32()), "w": pa.array([r.tolist() for r in at], pa.list_(pa.int64())),
                  "c": pa.array([x[r].tolist() for x, r in zip(c, at)], pa.list_(pa.int64()))})
        for c, at in zip(counts, rows)
    ]
    hits, total = counts[0] @ counts[1].T, np.add.outer(counts[0].sum(1), counts[1].sum(1))
    want = {(i, j, hits[i, j]) for i, j in zip(*np.nonzero((hits > 0) & (hits > total * 0.3) & (hits <= total)))}
    assert want and set(zip(*cells.cell_hits(*lots, 0.3))) == want


def test_lots_meet_without_shuffling_pairs(spark, monkeypatch):
    """Pairs are found and scored where two lots meet: what is shuffled or stored is the sides, whatever the values."""
    rng = random.Random(8)
    rows = [
        sorted({(f"{host}{i}", "abcd"[k], f"v{rng.randint(0, 2 + 3 * k)}", rng.choice([1, 1, 2])) for i in range(90) for k in range(4) if rng.random() < 0.8})
        for host in "xy"
    ]
    many = [("x\x01\x03b", "a", "v0", 1), ("both", "a", "v0", 1), ("both", "b", "v1", 1)] + [(f"n{i}", "a", "v0", 1) for i in range(7)]
    rows = [rows[0] + many, rows[1] + many[1:3]]
    held = [{}, {}]
    for own, side in zip(held, rows):
        for s, b, v, m in side:
            own.setdefault(s, {}).setdefault(b, {})[v] = own.get(s, {}).get(b, {}).get(v, 0) + m
    need = {1: 0.95, 2: 0.9, 3: 0.8}
    want = {}
    for s1, x in held[0].items():
        for s2, y in held[1].items():
            shared = len(set(x) & set(y))
            total = sum(m * y[b][v] for b in set(x) & set(y) for v, m in x[b].items() if v in y[b])
            if shared and s1 != s2 and total / shared > need.get(shared, 0.7):
                want[s1, s2] = round(total / shared, 6)
    assert len(want) > 100
    monkeypatch.setattr(matching, "_LOT_ROWS", 40)
    monkeypatch.setattr(classes, "_MOST", 3)
    sides = [spark.createDataFrame([(s, b, v, m) for s, own in d.items() for b, vs in own.items() for v, m in vs.items()], "s string, b string, v string, m long") for d in held]
    found = matching.match_sides(*sides, "exact")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]
    assert result(found) == want


def test_runs_of_meetings_and_keys(monkeypatch):
    """A run ends with a row; keys of several values may be made some rows at a time."""
    import numpy as np
    import pyarrow as pa

    from tripleweave.functions import pairing

    rnd = np.random.default_rng(4)
    kind = pa.list_(pa.struct([("id", pa.int64()), ("block", pa.int64()), ("w", pa.float64())]))
    rows = [[[{"id": int(10 * b + v), "block": b, "w": 1.0} for b in range(5) for v in sorted(set(rnd.integers(0, 3, rnd.integers(1, 3))))] for _ in range(n)] for n in (40, 30)]
    lots = [pa.table({"s": [f"{i}" for i in range(len(r))], "g": ["g"] * len(r), "e": pa.array(r, kind)}) for r in rows]
    ids = [[{e["id"] for e in r} for r in side] for side in rows]
    for size, head in ((1, [0]), (2, [0, 1, 2]), (3, [0, 1, 2, 3, 4])):
        want = {
            (f"{i}", f"{j}"): float(len(x & y)) / 5 for i, x in enumerate(ids[0]) for j, y in enumerate(ids[1])
            if len({e // 10 for e in x & y} & set(head)) >= size and len(x & y) / 5 > 0.5
        }
        for meetings, keys in ((7, 1 << 20), (1 << 20, 1 << 20), (50, 400)):
            monkeypatch.setattr(pairing, "_MEETINGS", meetings)
            monkeypatch.setattr(pairing, "_KEYS", keys)
            plan = [{"g1": "g", "g2": "g", "size": size, "head": head, "count": 5, "threshold": 0.5}]
            got = [(a.table["s"][int(x)].as_py(), b.table["s"][int(y)].as_py(), z) for a, b, i, j, score, _ in pairing.lot_matches(*lots, plan) for x, y, z in zip(i, j, score)]
            assert len(got) == len({g[:2] for g in got})
            assert want.items() <= {g[:2]: g[2] for g in got}.items()
            assert all(len(ids[0][int(a)] & ids[1][int(b)]) / 5 > 0.5 for a, b, _ in got)


def test_evaluation_shuffles_no_names(spark):
    """Each found pair travels once, as 16 bytes for both directions, and the found pairs are read once."""
    rng = random.Random(6)
    names = ["a", "item1", "item2", "", "item'\"3", "b"]
    for _ in range(3):
        gold, found = ([(rng.choice(names), rng.choice(names)) for _ in range(n)] for n in (9, 14))
        one, two = (spark.createDataFrame(x, "s1 string, s2 string") for x in (gold, found))
        row = evaluate.evaluate_alignment(one, two, "item")
        g, d = set(gold), set(found) | {(b, a) for a, b in found}
        inside = lambda x: sum("item" in a and "item" in b for a, b in x)
        want = (len(g), len(set(found)), len(g - d), len(d - g), len(g & d), inside(d - g), len(d) - inside(d))
        assert tuple(row.first())[:7] == want
    plan = row._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(name" in plan and plan.count("Scan ") == 2
