import random

import pytest
import tiny
from pyspark.sql import functions as F

from tripleweave.operators import blocking, encoding, evaluate, lexicon, neighbours, predicates, stats
from tripleweave.operators.checkpoints import stored
from tripleweave.plans import align


def random_rows(seed, n=60):
    rng = random.Random(seed)
    nodes = [f"<http://a/n{i}>" for i in range(12)]
    rows = {(rng.choice(nodes), f"<http://a/p{rng.randint(0, 3)}>", rng.choice([*nodes, '"x"', '"y"'])) for _ in range(n)}
    return sorted(rows)


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def test_profile_of_empty_and_small_graphs(spark):
    t = tiny.triples(spark, tiny.PEOPLE1)
    profile = {r.measure: r.n for r in stats.graph_profile(t).collect()}
    assert profile["triples"] == 9 and profile["predicates"] == 5 and profile["literals"] == 4
    assert profile["typed_triples"] == profile["classes"] == 0
    assert bag(stats.type_histogram(t)) == [("SUM", 0)]
    assert stats.untyped_subjects(t).count() == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbourhood_equals_sets(spark, seed):
    rows = random_rows(seed)
    rng = random.Random(seed + 10)
    chosen = rng.sample(sorted({s for s, _, _ in rows}), 3)
    matches = [(s, f"<http://b/{i}>") for i, s in enumerate(chosen)] + [(chosen[0], "<http://b/extra>")]
    t = tiny.triples(spark, rows)
    m = spark.createDataFrame(matches, "s1 string, s2 string")
    nodes = {o for _, _, o in rows if o in chosen} | {o for s, _, o in rows if s in chosen}
    around = {r for r in rows if r[0] in nodes or r[2] in nodes}
    assert bag(neighbours.neighbour_triples(t, m.select(F.col("s1").alias("s")))) == sorted(around)
    untouched = {r for r in rows if r[0] not in chosen and r[2] not in chosen}
    assert bag(neighbours.untouched_triples(t, m)) == sorted(untouched)
    partner = {}
    for a, b in matches:
        partner.setdefault(a, []).append(b)
    want = {
        (a, p, c)
        for s, p, o in rows
        for a in partner.get(s, [s])
        for c in partner.get(o, [o])
    }
    assert bag(neighbours.substitute_matched(t, m)) == sorted(want)
    links = neighbours.same_as_triples(m)
    assert links.columns == ["s", "p", "o"] and links.count() == 4


def test_partners_are_not_broadcast_and_ends_are_replaced_in_turn(spark):
    """Pairs of repeated names are small in files; partners of both ends of equal triples don't multiply."""
    pairs = stored(spark.range(90_000).select(F.concat(F.lit("<http://a/subject-"), (F.col("id") % 300).cast("string")).alias("s1"), F.concat(F.lit("<http://b/subject-"), F.floor(F.col("id") / 300).cast("string")).alias("s2")))
    triples = stored(spark.range(300).select(F.concat(F.lit("<http://a/subject-"), F.col("id").cast("string")).alias("s"), F.lit("p").alias("p"), F.lit("<http://a/subject-0").alias("o")))
    replaced = neighbours.substitute_matched(triples, pairs)
    plan = replaced._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "LeftOuter, BuildRight" not in plan
    assert replaced.count() == 300 * 300 and replaced.filter("s like '<http://a%' or o like '<http://a%'").isEmpty()


@pytest.mark.parametrize("least", [1, 2, 3])
def test_shared_values_equal_pair_counts(spark, least):
    rng = random.Random(least)
    sides = []
    for host in ("a", "b"):
        rows = set()
        for i in range(25):
            for p in range(rng.choice([3, 5, 40])):
                rows.add((f"<http://{host}/{i}>", f"<http://x/p{p}>", f'"{rng.randint(0, 3 if p else 1)}"'))
        sides.append(sorted(rows))
    t1, t2 = (tiny.triples(spark, r) for r in sides)
    shared = {}
    for s1, p1, o1 in sides[0]:
        for s2, p2, o2 in sides[1]:
            if (p1, o1) == (p2, o2):
                shared[s1, s2] = shared.get((s1, s2), 0) + 1
    got = {(r.s1, r.s2): r["count"] for r in blocking.shared_value_counts(t1, t2, least).collect()}
    assert got == {k: n for k, n in shared.items() if n >= least}


def test_factored_clusters_equal_counts(spark):
    t1, t2 = tiny.triples(spark, tiny.CARS1), tiny.triples(spark, tiny.CARS2)
    pairs = predicates.match_predicates(t1, t2)
    sides = [blocking.blocked_side(t, pairs, n) for n, t in ((1, t1), (2, t2))]
    blocks = blocking.block_by_predicate(t1, t2, pairs)
    clusters = blocking.common_predicate_clusters(*sides)
    full = blocking.expand_clusters(clusters, *[blocking.profiles(s) for s in sides])
    assert bag(full.select("s1", "s2", "count")) == bag(blocking.common_predicate_counts(blocks))
    values = blocking.common_value_clusters(*sides)
    full = blocking.expand_clusters(values, *[blocking.profiles(s, rows=True) for s in sides])
    assert bag(full.select("s1", "s2", "count")) == bag(blocking.common_value_counts(blocks))
    ordered = blocking.cluster_by_subjects(full)
    assert ordered.count() == full.count()


def test_deduced_pairs_are_not_stored_in_the_last_round(spark):
    from tripleweave.operators import checkpoints

    n, end = 120, "<http://{}.example/{}>"
    graphs = [
        spark.createDataFrame([(end.format(h, f"s{i}"), end.format(h, "inNode"), end.format(h, "node")) for i in range(n)], "s string, p string, o string")
        for h in "ab"
    ]
    found = spark.createDataFrame([(end.format("a", "node"), end.format("b", "node"), 1.0)], "s1 string, s2 string, score double")
    at = len(checkpoints._written)
    every = align.deduce_relations(*graphs, found)
    assert max(spark.read.parquet(p).count() for p in checkpoints._written[at:]) <= 2 * n
    pairs = {(r.s1, r.s2, r.score, r.stage) for r in every.collect()}
    late = {(end.format("a", f"s{i}"), end.format("b", f"s{j}"), 1.0, 1) for i in range(n) for j in range(n)}
    assert pairs == late | {(end.format("a", "node"), end.format("b", "node"), 1.0, 0)} and every.count() == n * n + 1


def test_deduction_leaves_out_a_subject_with_itself(spark):
    end = "<http://{}.example/{}>".format
    t1 = [(end("a", s), end("a", "inNode"), end("a", "node")) for s in ("x", "y")] + [(end("b", "z"), end("a", "inNode"), end("a", "node"))]
    t2 = [(end("b", s), end("b", "inNode"), end("b", "node")) for s in ("x", "y", "z")]
    graphs = [spark.createDataFrame(t, "s string, p string, o string") for t in (t1, t2)]
    known = [(end("a", "node"), end("b", "node"), 1.0), (end("a", "x"), end("b", "y"), 0.9)]
    every = align.deduce_relations(*graphs, spark.createDataFrame(known, "s1 string, s2 string, score double"))
    # a's x stands for b's y; neither it nor z, which both graphs have, is a pair with itself
    left, right = [end("b", "y"), end("a", "y"), end("b", "z")], [end("b", s) for s in ("x", "y", "z")]
    late = {(x, y, 1.0, 1) for x in left for y in right if x != y}
    assert {tuple(r) for r in every.collect()} == late | {(*k, 0) for k in known} and every.count() == len(late) + 2


def test_value_level_matches_and_rounds(spark):
    t1, t2 = tiny.triples(spark, tiny.CARS1), tiny.triples(spark, tiny.CARS2)
    pairs = predicates.match_predicates(t1, t2)
    single = tiny.short({(r.s1, r.s2) for r in align.value_level_matches(t1, t2, pairs, skip_lowest=True).collect()})
    # Lion and Leon are alike; person2 and person4 share the last name only, which is the lowest level
    assert single == {("person1", "person3"), ("person2", "person3"), ("car1", "car3"), ("car2", "car4")}
    every = align.value_level_matches(t1, t2, pairs, skip_lowest=False)
    assert ("person2", "person4") in tiny.short({(r.s1, r.s2) for r in every.collect()})
    found = align.align_entities(t1, t2, pairs)
    once = align.deduce_relations(t1, t2, found, earlier=align.value_level_matches(t1, t2, pairs))
    assert ("person2", "person3") in tiny.short({(r.s1, r.s2) for r in once.collect()})
    twice = align.deduce_relations(t1, t2, found, rounds=2)
    assert {r.stage for r in twice.collect()} <= {0, 1, 2}
    assert twice.count() == twice.select("s1", "s2").distinct().count()


def test_encoding(spark):
    t = encoding.merge_graphs(tiny.triples(spark, tiny.PEOPLE1), tiny.triples(spark, tiny.PEOPLE2))
    entities, relations = encoding.entity_ids(t), encoding.relation_ids(t)
    terms = sorted({x for s, _, o in tiny.PEOPLE1 + tiny.PEOPLE2 for x in (s, o)})
    assert bag(entities) == [(term, i) for i, term in enumerate(terms)]
    encoded = encoding.encode_triples(t, entities, relations)
    assert encoded.count() == t.count()
    row = encoded.orderBy("s_id", "o_id").first()
    entries = encoding.adjacency_entries(encoded)
    assert encoding.matrix_row(entries, row.s_id).count() >= 1
    assert row.p_id in {r.value for r in encoding.matrix_cell(entries, row.s_id, row.o_id).collect()}
    assert encoding.term_of_id(entities, row.s_id).first().term == row.s
    assert encoding.matrix_size(entities).first().rows == len(terms)
    matrix = encoding.coordinate_matrix(entries, len(terms))
    assert (matrix.numRows(), matrix.numCols(), matrix.entries.count()) == (len(terms), len(terms), t.count())
    assert [d.count() for d in encoding.node_id_columns(encoded)] == [t.count()] * 3


def test_relations_of_merged_graph(spark):
    rows = [("<http://a/isPartOf>", 0), ("<http://b/IsPartOf>", 1), ("<http://a/name>", 2)]
    found = predicates.similar_relations(spark.createDataFrame(rows, "term string, id long"))
    assert {(r.id1, r.id2) for r in found.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)}


def test_evaluation(spark):
    gold = spark.createDataFrame([("a1", "b1"), ("a2", "b2"), ("a3", "b3")], "s1 string, s2 string")
    found = spark.createDataFrame(
        [("a1", "b1", 1.0), ("b2", "a2", 1.0), ("Address1", "Address2", 0.9), ("a1", "b9", 0.8)], "s1 string, s2 string, score double"
    )
    assert bag(evaluate.missed_pairs(gold, found)) == [("a3", "b3")]
    assert evaluate.extra_pairs(gold, found).count() == 6
    row = evaluate.evaluate_alignment(gold, found, "Address").first()
    assert (row.gold_pairs, row.found_pairs, row.missed, row.extra, row.hits) == (3, 4, 1, 6, 2)
    assert (row.part_extras, row.other_found) == (2, 6)
    assert row.precision == 0.5 and row.recall == pytest.approx(2 / 3)
    assert evaluate.compression(gold, gold, found).first().compression == pytest.approx(66.67)


# --- lexicon -------------------------------------------------------------------------------------------

#            entity
#           /      \
#       artefact   being
#       /   |         \
#     car  boat      person      (amphibian: both car and boat)
PARENTS = [("artefact", "entity"), ("being", "entity"), ("car", "artefact"), ("boat", "artefact"), ("person", "being"),
           ("amphibian", "car"), ("amphibian", "boat")]
COUNTS = {"car": 40, "boat": 20, "person": 60, "amphibian": 5, "artefact": 10}


@pytest.fixture(scope="module")
def lex(spark):
    names = sorted({x for p in PARENTS for x in p})
    senses = [(n, "noun", 1, n) for n in names] + [("automobil", "noun", 1, "car"), ("man", "noun", 1, "person"), ("run", "verb", 1, "v-run")]
    synsets = [(n, "noun", [n], f'a kind of {n} thing; "the {n}"') for n in names] + [("v-run", "verb", ["run", "sprint"], "move fast")]
    pointers = [(a, "hypernym", b) for a, b in PARENTS] + [(b, "hyponym", a) for a, b in PARENTS] + [("car", "antonym", "person")]
    return lexicon.Lexicon(
        spark.createDataFrame(senses, "lemma string, pos string, sense_no int, synset string"),
        spark.createDataFrame(synsets, "synset string, pos string, lemmas array<string>, gloss string"),
        spark.createDataFrame(pointers, "src string, ptr_type string, dst string"),
        spark.createDataFrame(sorted(COUNTS.items()), "synset string, count long"),
    )


def test_lexicon_lookups(spark, lex):
    terms = spark.createDataFrame([("Car",), ("unknown",), ("run",)], "term string")
    assert bag(lexicon.senses_of(terms, lex.senses)) == [("Car", "noun", 1, "car"), ("run", "verb", 1, "v-run")]
    assert lexicon.senses_of(terms, lex.senses, "verb", 1).count() == 1
    verbs = lex.synsets.filter("pos = 'verb'")
    assert bag(lexicon.lemmas_of(verbs, lex.synsets)) == [("v-run", 0, "run"), ("v-run", 1, "sprint")]
    assert lexicon.lemmas_of(verbs, lex.synsets, lemma="sprint").count() == 1
    assert lexicon.lemmas_of(verbs, lex.synsets, position=1).first().lemma == "sprint"
    assert bag(lexicon.related(lex.synsets.filter("synset = 'artefact'"), lex.pointers, "hyponym")) == [
        ("artefact", "boat"), ("artefact", "car")
    ]
    parts = lexicon.gloss_parts(lex.synsets.filter("synset = 'car'")).first()
    assert parts.definition == "a kind of car thing" and parts.examples == ['"the car"']


def test_hypernyms(spark, lex):
    paths = lexicon.hypernym_paths(lex.synsets.filter("synset in ('amphibian', 'person')"), lex.pointers)
    assert {tuple(r.path) for r in paths.collect()} == {
        ("amphibian", "car", "artefact", "entity"), ("amphibian", "boat", "artefact", "entity"), ("person", "being", "entity")
    }
    up = lexicon.hypernym_closure(lex.synsets.filter("synset in ('amphibian', 'person')"), lex.pointers)
    assert {(r.ancestor, r.distance) for r in up.filter("synset = 'amphibian'").collect()} == {
        ("amphibian", 0), ("car", 1), ("boat", 1), ("artefact", 2), ("entity", 3)
    }
    assert bag(lexicon.root_hypernyms(up, lex.pointers)) == [("amphibian", "entity", 3), ("person", "entity", 2)]
    assert bag(lexicon.min_depth(up, lex.pointers)) == [("amphibian", 3), ("person", 2)]
    pairs = spark.createDataFrame([("amphibian", "person"), ("person", "person")], "left string, right string")
    assert {r.left: r.common for r in lexicon.lowest_common_hypernym(pairs, up).collect()} == {"amphibian": "entity", "person": "person"}
    ways = {r.left: (r.left_path, r.right_path) for r in lexicon.shortest_hypernym_path(pairs, lex.pointers, up).collect()}
    assert ways == {"amphibian": (["amphibian", "boat", "artefact", "entity"], ["person", "being", "entity"]), "person": (["person"], ["person"])}


def test_closure_of_a_ladder_of_diamonds(spark):
    """Two hypernyms on each of 8 levels make many ways, but few ancestors; and a cycle ends."""
    edges = []
    for k in range(8):
        edges += [(f"n{k}", f"l{k}"), (f"n{k}", f"r{k}"), (f"l{k}", f"n{k + 1}"), (f"r{k}", f"n{k + 1}")]
    edges += [("a", "b"), ("b", "a")]
    pointers = spark.createDataFrame([(x, "hypernym", y) for x, y in edges], "src string, ptr_type string, dst string")
    chosen = spark.createDataFrame([("n0",), ("a",)], "synset string")
    up = {(r.synset, r.ancestor): r.distance for r in lexicon.hypernym_closure(chosen, pointers).collect()}
    assert len(up) == 25 + 2 and up["n0", "n8"] == 16 and up["a", "b"] == 1


def random_lexicon(spark, seed, size=40):
    import random

    rng = random.Random(seed)
    names = [f"w{k}{rng.choice(['abc', 'bcd', 'cde'])}" for k in range(size)]
    pos = ["verb" if k % 4 == 3 else "noun" for k in range(size)]
    pointers = []
    for k in range(1, size):
        same = [j for j in range(k) if pos[j] == pos[k]]
        for j in set(rng.choices(same, k=rng.choice([0, 1, 1, 2]))) if same else ():
            pointers.append((f"s{k}", "hypernym", f"s{j}"))
        if rng.random() < 0.4:
            pointers.append((f"s{k}", rng.choice(["antonym", "part_meronym", "substance_meronym", "part_holonym", "hyponym"]), f"s{rng.randrange(size)}"))
    gloss = [" ".join(rng.choices(["kind", "of", "thing", "red", "blue", "move", "fast", "old", "large", "bolt"], k=rng.randint(1, 9))) for _ in range(size)]
    senses = [(names[k], pos[k], 1, f"s{k}") for k in range(size)] + [(names[k], pos[k], 2, f"s{(k + 1) % size}") for k in range(0, size, 5)]
    senses += [(f"syn{k}x", pos[k], 1, f"s{k}") for k in range(0, size, 3)]
    freq = [(f"s{k}", rng.choice([0, 3, 50, 4000])) for k in range(size) if rng.random() < 0.7]
    tables = lexicon.Lexicon(
        spark.createDataFrame(senses, "lemma string, pos string, sense_no int, synset string"),
        spark.createDataFrame([(f"s{k}", pos[k], [names[k]], gloss[k]) for k in range(size)], "synset string, pos string, lemmas array<string>, gloss string"),
        spark.createDataFrame(pointers, "src string, ptr_type string, dst string"), spark.createDataFrame(freq, "synset string, count long"),
    )
    return tables, pointers, sorted({s[0] for s in senses})


@pytest.mark.parametrize("seed", [1])
def test_relation_paths_equal_enumeration(spark, seed):
    """All ways of up to five steps, written out, against the search by states."""
    import re

    lex, pointers, _ = random_lexicon(spark, seed, 30)
    steps = set()
    for a, kind, b in pointers:
        if kind in ("hypernym", "part_meronym", "substance_meronym"):
            steps |= {(a, "u", b), (b, "d", a)}
        elif kind == "antonym":
            steps |= {(a, "h", b), (b, "h", a)}
        else:
            steps |= {(b, "u", a), (a, "d", b)}
    after = {}
    for a, c, b in steps:
        after.setdefault(a, []).append((c, b))
    nodes = [f"s{k}" for k in range(30)]
    want = {}
    for start in nodes:
        ways = {(start, "")}
        for _ in range(5):
            ways |= {(b, w + c) for node, w in ways for c, b in after.get(node, ()) if re.fullmatch("u*h*d*|d+h*", w + c)}
        for node, w in ways:
            score = 16 if node == start else 8 - len(w) - (len(set(w)) - 1)
            want[start, node] = max(want.get((start, node), 0), score)
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "left string, right string")
    got = {(r.left, r.right): r.hso for r in lexicon.hirst_st_onge(pairs, lex.pointers).collect()}
    assert got == {(a, b): want.get((a, b), 0) for a in nodes for b in nodes}
    assert {6.0, 5.0, 16.0} <= set(got.values())


@pytest.mark.parametrize("seed, threshold", [(1, 0.15), (2, 0.3), (1, 0.6)])
def test_similar_words_equal_the_whole_product(spark, seed, threshold):
    lex, _, words = random_lexicon(spark, seed)
    left, right = words[::2] + words[1:9] + ["unknown", "ab"], words[1::2] + words[:8] + [words[0].upper()]
    frames = [spark.createDataFrame([(w,) for w in sorted(set(d))], "word string") for d in (left, right)]
    product = frames[0].toDF("x").join(frames[1].toDF("y"))
    every = {(r.x, r.y): r.sim for r in lexicon.word_similarity(product, lex).filter(f"sim >= {threshold}").collect()}
    got = {(r.x, r.y): r.sim for r in lexicon.vocabulary_similarity(*frames, lex, threshold).collect()}
    assert got and got == every
    plan = lexicon.vocabulary_similarity(*frames, lex, threshold)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_pairs_are_not_multiplied_by_ancestors(spark, lex):
    """A pair meets each end once; it is neither exploded into common ancestors nor grouped again."""
    pairs = spark.createDataFrame([("car", "boat"), ("car", "person")], "left string, right string")
    nowhere = spark.createDataFrame([("boat", "hypernym", None), ("person", "hypernym", None)], "src string, ptr_type string, dst string")
    pointers = lex.pointers.filter("ptr_type = 'hypernym'").unionByName(nowhere)
    plain = lexicon.Lexicon(lex.senses, lex.synsets, pointers, lex.freq)
    assert {r.right: r.hso for r in lexicon.hirst_st_onge(pairs, pointers).collect()} == {"boat": 5.0, "person": 3.0}
    plan = lexicon.synset_similarity(pairs, plain)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [left" not in plan and "Aggregate [right" not in plan


def test_measures(spark, lex):
    import math

    pairs = spark.createDataFrame([("car", "boat"), ("car", "car"), ("car", "person")], "left string, right string")
    rows = {(r.left, r.right): r for r in lexicon.synset_similarity(pairs, lex).collect()}
    total = sum(COUNTS.values())
    ic = {"car": -math.log(45 / total), "boat": -math.log(25 / total), "artefact": -math.log(75 / total)}
    near = rows["car", "boat"]
    assert near.path == pytest.approx(1 / 3)
    assert near.lch == pytest.approx(-math.log(3 / 40))
    assert near.wup == pytest.approx(2 * 2 / (3 + 3))
    assert near.res == pytest.approx(ic["artefact"])
    assert near.lin == pytest.approx(2 * ic["artefact"] / (ic["car"] + ic["boat"]))
    assert near.jcn == pytest.approx(1 / (ic["car"] + ic["boat"] - 2 * ic["artefact"]))
    assert (near.lesk, near.hso) == (4.0, 5.0)
    same = rows["car", "car"]
    assert same.path == 1.0 and same.hso == 16.0
    assert same.jcn == pytest.approx(1 / -math.log((total - 0.01) / total))
    assert rows["car", "person"].hso == 7.0


def test_greatest_jcn_value():
    """The scale of the measure is its value at distance zero for the corpus the scale was taken from."""
    import math

    from tripleweave.config import MAX_JCN, MAX_LCH

    assert 1 / -math.log((128767 - 0.01) / 128767) == pytest.approx(MAX_JCN)
    assert math.log(40) == pytest.approx(MAX_LCH)


def test_word_similarity(spark, lex):
    pairs = [("Car", "car"), ("car", "boat"), ("automobiles", "person"), ("cars", "boats"), ("zzzz", "boats"), ("man", "car")]
    rows = {(r.x, r.y): r.sim for r in lexicon.word_similarity(spark.createDataFrame(pairs, "x string, y string"), lex).collect()}
    assert rows["Car", "car"] == 1.0
    assert rows["car", "boat"] == rows["cars", "boats"] >= 0.3
    assert rows["zzzz", "boats"] == 0.0 and rows["man", "car"] == 0.0
    assert 0 < rows["automobiles", "person"] < rows["car", "boat"]
    report = lexicon.word_pair_report(spark.createDataFrame([("car", "boat")], "x string, y string"), lex).first()
    assert report.hso == 5.0


def test_vocabulary_feeds_predicate_matching(spark, lex):
    words = [spark.createDataFrame([(w,) for w in side], "word string") for side in (["car", "Owner"], ["boat", "automobiles"])]
    sims = lexicon.vocabulary_similarity(*words, lex, 0.25)
    found = {(r.x, r.y) for r in sims.collect()}
    assert found == {("car", "boat"), ("car", "automobiles")}
    t1 = spark.createDataFrame([("<s>", "<http://a/carOwner>", '"x"')], "s string, p string, o string")
    t2 = spark.createDataFrame([("<s>", "<http://b/boatOwner>", '"x"')], "s string, p string, o string")
    assert predicates.scored_predicates(t1, t2, 0.3).first().score == pytest.approx(1 / 3)  # one equal word
    assert predicates.scored_predicates(t1, t2, 0.3, sims).first().score == 1.0  # and one similar one
    assert predicates.match_predicates(t1, t2, 0.6, sims).count() == 0


@pytest.mark.parametrize("term, base", [("cars", "car"), ("Car", "car"), ("boats", "boat"), ("running", None), ("men", "man")])
def test_base_form(spark, lex, term, base):
    rows = lexicon.base_form(spark.createDataFrame([(term,)], "term string"), lex.senses).collect()
    assert [r.base for r in rows] == ([base] if base else [])


@pytest.mark.parametrize("term, base", [
    ("sports cars", "sports car"), ("Sports-Cars", "sports car"), ("fast red sports cars here", "sports car"), ("men of wars", "man-of-war"),
    ("man of sports", None), ("mothers in law", "mother-in-law"), ("very old cars", None), ("old sports car drivers", "sports car driver"),
])
def test_compound_base_form(spark, term, base):
    words = ["sports car", "man-of-war", "mother-in-law", "sports car driver", "car", "law"]
    senses = spark.createDataFrame([(w, "noun", 1, w) for w in words], "lemma string, pos string, sense_no int, synset string")
    rows = lexicon.base_form(spark.createDataFrame([(term,)], "term string"), senses).collect()
    assert [r.base for r in rows] == ([base] if base else [])


def test_base_form_exceptions(spark, lex):
    exceptions = spark.createDataFrame([("verb", "ran", "run")], "pos string, form string, base string")
    terms = spark.createDataFrame([("ran",)], "term string")
    assert lexicon.base_form(terms, lex.senses, exceptions).first().base == "run"
    assert lexicon.base_form(terms, lex.senses, exceptions, pos="noun").count() == 0


def test_stem_vocabulary(spark):
    words = spark.createDataFrame([("cars",), ("cars",), ("director",), (None,)], "w string")
    assert lexicon.with_stems(words, "w").filter("stem = 'car'").count() == 2
    assert lexicon.with_stems(words.toDF("word"), "word").columns == ["word", "stem"]


def test_tasks_grow_with_rows(spark, monkeypatch, tmp_path):
    """F24-F30, F35: a task's share of a graph and of its encoding stays the same on larger tables."""
    from tripleweave.operators import checkpoints
    from tripleweave.plans import align
    from workloads import graphs

    monkeypatch.setattr(checkpoints, "_ROWS_OF_TASK", 10)
    rows = [(i, f"name{i % 3}") for i in range(40)] + [(None, "name0"), (None, "name0"), (7, "name1")]
    spark.createDataFrame(rows, "k int, name string").coalesce(1).write.parquet(f"{tmp_path}/things.parquet")
    spec = [("things", "'<' || cast(k as string) || '>'", [("<p>", "name"), ("<q>", "'<all>'")])]
    t = graphs.build(spark, str(tmp_path), spec)
    assert t.rdd.getNumPartitions() == 9 > 4
    prepared = align.prepare(t)
    assert prepared.rdd.getNumPartitions() == 9  # equal triples are in one place already
    want = {(f"<{i}>", "<p>", f"name{i % 3}") for i in range(40)} | {(f"<{i}>", "<q>", "<all>") for i in range(40)}
    want |= {(None, "<p>", "name0"), (None, "<q>", "<all>")}
    assert sorted(str(tuple(r)) for r in prepared.collect()) == sorted(map(str, want))
    stored = checkpoints.stored(prepared.filter("s is not null"))
    entities, relations = checkpoints.stored(encoding.entity_ids(stored)), encoding.relation_ids(stored)
    encoded = encoding.encode_triples(stored, entities, relations)
    ids, kinds = dict(bag(entities)), dict(bag(relations))
    assert sorted(ids.values()) == list(range(44))
    assert bag(encoded) == sorted((s, p, o, ids[s], kinds[p], ids[o]) for s, p, o in want if s is not None)
    assert encoded.rdd.getNumPartitions() == 8
