import pytest

from tripleweave.operators import filters
from tripleweave.sources import ntriples, tables

LINES = """# a comment
<http://a/s1> <http://a/name> "Ann"@en .
<http://a/s1> <http://a/name> "Ann"@en .
<http://a/s1>\t<http://a/age>\t"41"^^<http://www.w3.org/2001/XMLSchema#int>\t.
<http://a/s1> <http://a/knows> <http://a/s2> .
_:b1 <http://a/note> "say \\"hi\\" . caf\\u00E9" .
<http://a/s2> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://a/Person> .
<http://a/s2> <http://www.w3.org/2002/07/owl#sameAs> <http://b/s9> .

not a statement
"""


@pytest.fixture
def graph(spark, tmp_path):
    path = tmp_path / "graph.nt"
    path.write_text(LINES)
    return str(path)


def test_read_ntriples(spark, graph):
    triples = ntriples.read_ntriples(spark, graph)
    assert triples.count() == 6
    rows = {(r.s, r.p_local): r for r in ntriples.with_term_columns(triples).collect()}
    name = rows["<http://a/s1>", "name"]
    assert (name.o_kind, name.o_value, name.o_lang, name.o_datatype) == ("literal", "Ann", "en", None)
    age = rows["<http://a/s1>", "age"]
    assert (age.o_value, age.o_datatype) == ("41", "http://www.w3.org/2001/XMLSchema#int")
    knows = rows["<http://a/s1>", "knows"]
    assert (knows.o_kind, knows.o_local, knows.o_value) == ("uri", "s2", None)
    assert rows["_:b1", "note"].o_value == 'say "hi" . café'
    assert ntriples.read_ntriples(spark, graph, drop_meta=True).count() == 4
    assert ntriples.read_ntriples(spark, graph, sep=" ").count() == 6


def test_filters(spark, graph):
    triples = ntriples.read_ntriples(spark, graph)
    assert filters.literal_triples(triples).count() == 3
    assert filters.uri_triples(triples).count() == 3
    assert filters.typed_triples(triples).count() == filters.typed_triples(triples, by_local_name=True).count() == 1
    assert filters.tag_side(triples, 2).columns == ["s2", "p2", "o2"]
    assert filters.preview(triples, 2).count() == 2
    parts = filters.random_split(triples, 3)
    assert len(parts) == 3 and sum(p.count() for p in parts) == 6
    scores = spark.createDataFrame([("a", "b", 0.7), ("a", "a", 0.8), ("c", None, 0.1)], "s1 string, s2 string, score double")
    assert filters.above(scores, 0.7).count() == 1
    assert filters.above(scores, 0.7, inclusive=True).count() == 2
    assert filters.non_reflexive(scores).count() == 1
    assert filters.not_null_values(scores, "s2").count() == 2
    assert filters.uri_contains(scores, "a").count() == 1


def test_pair_tables(spark, tmp_path):
    pairs = spark.createDataFrame([("<p>", "<q>"), ("<r>", "<t>")], "predicate1 string, predicate2 string")
    tables.write_pairs(pairs, str(tmp_path / "pairs"))
    assert sorted(map(tuple, tables.read_predicate_pairs(spark, str(tmp_path / "pairs")).collect())) == [
        ("<p>", "<q>"), ("<r>", "<t>")
    ]
    tables.write_matches(pairs, str(tmp_path / "matches"))
    assert spark.read.csv(str(tmp_path / "matches")).count() == 2


def test_load_or_compute(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "kept")
    assert tables.load_or_compute(spark, path, compute).count() == 3
    assert tables.load_or_compute(spark, path, compute).count() == 3
    assert len(calls) == 1


def test_alignments(spark, tmp_path):
    path = tmp_path / "gold.nt"
    path.write_text("<http://a/1> <http://b/1> 1.0\n<http://a/1> <http://b/1> 0.9\n<http://a/2> <http://b/2> 1.0\n")
    assert tables.read_alignment(spark, str(path)).count() == 2
    ns = "http://knowledgeweb.semanticweb.org/heterogeneity/alignment#"
    cells = [
        ("_:c1", f"<{ns}entity1>", "<http://a/1>"), ("_:c1", f"<{ns}entity2>", "<http://b/1>"),
        ("_:c1", f"<{ns}measure>", '"0.5"^^<http://www.w3.org/2001/XMLSchema#float>'), ("_:c2", f"<{ns}entity1>", "<http://a/2>"),
    ]
    rows = tables.alignment_cells(spark.createDataFrame(cells, "s string, p string, o string")).collect()
    assert [tuple(r) for r in rows] == [("<http://a/1>", "<http://b/1>", 0.5)]


def test_predicate_histogram(spark, graph, tmp_path):
    triples = ntriples.read_ntriples(spark, graph)
    rows = tables.predicate_histogram(triples).collect()
    assert [r.triples for r in rows] == sorted((r.triples for r in rows), reverse=True)
    tables.write_predicate_histogram(triples, str(tmp_path / "histogram"))
    assert spark.read.csv(str(tmp_path / "histogram"), sep="\t").count() == len(rows)


def test_statement_shapes(spark):
    from tripleweave.sources.ntriples import parse_statements, rejected_lines

    shapes = {
        '<a><b>"x".': '"x"', '<a> <b> "x" . # note': '"x"', '<a> <b> "x" <g> .': '"x"', "<a> <b> Acme Inc. .": "Acme Inc.",
        '<a> <b> "say \\"hi\\" . # now"@en .': '"say \\"hi\\" . # now"@en', "<a> <b> C# language .": "C# language", "<a>\t<b>\t<c>": "<c>",
    }
    bad = ['<a> "x" .', '<a> <b> "open .', "<a> <b> ."]
    lines = spark.createDataFrame([(x,) for x in [*shapes, *bad, "# c", " "]], "value string")
    assert [r["o"] for r in parse_statements(lines).collect()] == list(shapes.values())
    assert [r[0] for r in rejected_lines(lines).collect()] == bad


def test_literals_with_escapes(spark):
    from tripleweave.functions import terms

    cases = {
        '"say \\"hi\\" now"': 'say "hi" now', '"a\\tb\\n\\U0001F600 \\u00e9 raw\ttab"@en': "a\tb\n\U0001f600 é raw\ttab",
        '"\\ud83d\\ude00 \\ud83d \\q \\\\ end"': "\U0001f600 \\ud83d \\q \\ end", '"\\U0000D800 \\U00110000 \\U0010FFFF"': "\\U0000D800 \\U00110000 \U0010ffff",
        "bare": "bare", '""': '""', '"open \\" end': 'open " end', '"' + 'w\\" ' * 30_000 + '"': 'w" ' * 30_000, "<http://a/b>": None, "": None,
    }
    rows = spark.createDataFrame([(o,) for o in cases], "o string").select("o", terms.literal_value("o").alias("v")).collect()
    assert {r.o: r.v for r in rows} == cases


def test_rejects_are_counted(spark, graph):
    triples, rejects = ntriples.read_with_rejects(spark, graph)
    assert triples.count() == 6 and [r.value for r in rejects.collect()] == ["not a statement"]
    report = ntriples.reading_report(spark, graph).first()
    assert (report.lines, report.statements, report.silent, report.rejected) == (10, 7, 2, 1)
    bare = spark.createDataFrame([("<http://a> <http://b> .5 .",), ("<http://a> <http://b> .",)], "value string")
    assert [r.o for r in ntriples.parse_statements(bare).collect()] == [".5"]


def test_results_are_kept_by_their_inputs(spark, tmp_path):
    calls = []

    def compute(n):
        def run():
            calls.append(n)
            return spark.range(n)

        return run

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.nt").write_text("x")
    folder = str(tmp_path / "kept")
    keep = lambda n, settings="": tables.stored_result(spark, folder, "r", [str(source)], compute(n), settings).count()
    assert (keep(3), keep(4)) == (3, 3) and calls == [3]
    assert keep(5, "other") == 5
    (source / "b.nt").write_text("y")  # other inputs: never the old result
    assert keep(6) == 6 and calls == [3, 5, 6]
    (source / "b.nt").unlink()
    assert keep(7) == 3


def test_stored_tables_are_removed(spark):
    from tripleweave.operators import checkpoints

    kept = checkpoints.stored(spark.range(5))
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert tables.path_exists(spark, path) and checkpoints.clear_stored(spark) >= 1
    assert not tables.path_exists(spark, path) and checkpoints.clear_stored(spark) == 0
