"""The registered queries and, where SQL can state them, their DuckDB equivalents.

Every query runs over whole tables. ``register`` ties a name to a Spark callable and an oracle text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.config import OWL_SAME_AS, RDF_TYPE, Thresholds
from tripleweave.functions import terms, text
from tripleweave.operators import blocking, classes, encoding, evaluate, filters, lexicon, matching, neighbours, predicates, stats
from tripleweave.operators.checkpoints import new_path, stored
from tripleweave.plans import align
from tripleweave.sources import ntriples, tables
from tripleweave.sources.ntriples import parse_statements, read_ntriples, read_with_rejects, with_term_columns, write_ntriples
from tripleweave.sources.tables import predicate_histogram
from workloads import graphs as g
from workloads import lexicons as lx
from workloads import sqltext as q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def graph(spark: SparkSession, sf_dir: str, *specs: list) -> list[DataFrame]:
    return [align.prepare(g.build(spark, sf_dir, s), drop_meta=False) for s in specs]


def rows(spec: list, meta: bool = True) -> str:
    """Distinct triples of a graph in SQL."""
    where = "" if meta else f" WHERE p NOT IN ('{RDF_TYPE}', '{OWL_SAME_AS}')"
    return f"SELECT DISTINCT s, p, o FROM ({g.sql(spec)}){where}"


# --- sources, filters, terms ---------------------------------------------------------------------------


@register(f"""
SELECT s, p, o, {q.local_name('s')} AS s_local, {q.local_name('p')} AS p_local,
  CASE WHEN o LIKE '<%' THEN 'uri' ELSE 'literal' END AS o_kind,
  CASE WHEN o LIKE '<%' THEN {q.local_name('o')} END AS o_local,
  CASE WHEN o NOT LIKE '<%' THEN regexp_extract(o, '^"(.*)"(?:@[A-Za-z0-9\\-]+|\\^\\^<[^>]*>)?$', 1) END AS o_value,
  nullif(regexp_extract(o, '"@([A-Za-z0-9\\-]+)$', 1), '') AS o_lang,
  nullif(regexp_extract(o, '"\\^\\^<([^>]*)>$', 1), '') AS o_datatype
FROM ({rows(g.CATALOGUE)})
UNION ALL SELECT s, p, o, {q.local_name('s')}, {q.local_name('p')}, 'literal', NULL, said, lang, NULL FROM ({g.NOTES_SQL})""")
def ntriples_statements(spark, sf):
    """Statement lines, parsed back to triples with term columns; whole texts with escapes among them."""
    triples = g.build(spark, sf, g.CATALOGUE).unionByName(g.build(spark, sf, g.NOTES))
    lines = triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))
    return with_term_columns(filters.dedupe_triples(parse_statements(lines)))


def _files(spark, sf, *specs):
    """Graphs written as statement files to a new place in the shared folder."""
    folder = new_path(spark, "files")
    paths = [f"{folder}/{k}" for k in range(len(specs))]
    for path, spec in zip(paths, specs):
        write_ntriples(g.build(spark, sf, spec), path)
    return folder, paths


@register(f"{rows(g.CATALOGUE)} UNION ALL SELECT s, p, o FROM ({g.NOTES_SQL})")
def triples_from_files(spark, sf):
    """Triples read back from statement files, repeated statements once."""
    _, paths = _files(spark, sf, [*g.CATALOGUE, *g.NOTES])
    return read_ntriples(spark, paths[0])


_BROKEN = {  # lines that say nothing or can't be read, made of suppliers and customers
    "supplier": "case s_suppkey % 3 when 0 then '<http://a.example/s> \"' || s_name || '\" .' when 1 then '# ' || s_name else '' end",
    "customer": "'<http://a.example/c> <http://a.example/p> \"' || c_name || case when c_custkey % 2 = 0 then '\" .' else ' .' end",
}


def _broken_file(spark, sf):
    path = new_path(spark, "files")
    lines = [spark.read.parquet(f"{sf}/{t}.parquet").select(F.expr(e)) for t, e in _BROKEN.items()]
    lines[0].union(lines[1]).write.text(path)
    return path


@register("""SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS lines, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS statements,
  (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 0) AS silent,
  (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) + (SELECT count(*) FROM customer WHERE c_custkey % 2 <> 0) AS rejected""")
def reading_report(spark, sf):
    """How many lines of a file are statements, say nothing, or can't be read."""
    return ntriples.reading_report(spark, _broken_file(spark, sf))


@register(f"""SELECT {_BROKEN['supplier']} AS value FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT {_BROKEN['customer']} FROM customer WHERE c_custkey % 2 <> 0""")
def rejected_lines(spark, sf):
    """The lines of a file that can't be read."""
    return read_with_rejects(spark, _broken_file(spark, sf))[1].select("value")


@register(rows(g.CATALOGUE, meta=False))
def prepared_triples(spark, sf):
    """Distinct triples without type and link statements."""
    return align.prepare(g.build(spark, sf, g.CATALOGUE))


@register(f"SELECT * FROM ({rows(g.CATALOGUE)}) WHERE o NOT LIKE '<%'")
def literal_triples(spark, sf):
    return filters.literal_triples(*graph(spark, sf, g.CATALOGUE))


@register(f"SELECT s AS s1, p AS p1, o AS o1 FROM ({rows(g.GEO)}) WHERE o LIKE '<%'")
def uri_triples(spark, sf):
    return filters.tag_side(filters.uri_triples(*graph(spark, sf, g.GEO)), 1)


@register(f"SELECT * FROM ({rows(g.GEO)}) WHERE p = '{RDF_TYPE}'")
def typed_triples(spark, sf):
    return filters.typed_triples(*graph(spark, sf, g.GEO))


@register(f"""WITH t AS ({rows(g.GEO)})
SELECT DISTINCT {q.local_name('o')} AS term FROM t WHERE o LIKE '<%' UNION ALL SELECT DISTINCT {q.local_name('s')} FROM t""")
def entity_names(spark, sf):
    """Local names of entities: once per role."""
    return filters.entity_names(*graph(spark, sf, g.GEO))


@register(f"""SELECT s AS s1, o AS s2 FROM ({rows(g.GEO)}) WHERE contains(s, 'a.example') AND contains(o, 'a.example')""")
def pairs_of_host(spark, sf):
    """Subject-object pairs of which both ends lie on one host."""
    t = graph(spark, sf, g.GEO)[0]
    return filters.uri_contains(t.select(F.col("s").alias("s1"), F.col("o").alias("s2")), "a.example")


@register(f"""WITH t AS (SELECT DISTINCT o AS term FROM ({g.sql(g.CATALOGUE)} UNION ALL {g.sql(g.GEO)}))
SELECT term, {q.ending('term')} AS ending, {q.ending('term', False)} AS segment,
  {q.literal_value('term')} AS literal, {q.literal_or_ending('term')} AS shown, {q.comparable('term')} AS comparable,
  {q.lower_ending('term')} AS lowered
FROM t UNION ALL SELECT DISTINCT o, NULL, NULL, said, said, said, {q.lower_ending('o')} FROM ({g.NOTES_SQL})""")
def term_values(spark, sf):
    """Endings, literal texts and comparable values of all objects; whole texts with escapes among them."""
    graphs = [g.build(spark, sf, s) for s in (g.CATALOGUE, g.GEO, g.NOTES)]
    objects = reduce(DataFrame.unionByName, graphs).select(F.col("o").alias("term"))
    return objects.distinct().select(
        "term",
        terms.uri_ending("term").alias("ending"),
        terms.uri_ending("term", hash=False).alias("segment"),
        terms.literal_value("term").alias("literal"),
        terms.literal_or_ending("term").alias("shown"),
        terms.comparable_value("term").alias("comparable"),
        terms.lower_ending("term").alias("lowered"),
    )


# --- text functions ------------------------------------------------------------------------------------

_LABELS = """SELECT DISTINCT p_name || ', ' || p_brand || ' (' || p_type || ')' AS a,
  lower(p_type) || ' ' || p_name || 's' AS b FROM part"""


@register(f"""WITH l AS ({_LABELS}), t AS (SELECT a, b, {q.value_tokens('a')} AS ta, {q.value_tokens('b')} AS tb FROM l)
SELECT a, b, lower(a) = lower(b) AS same, levenshtein(a, b)::INTEGER AS edits, round({q.edit_sim('a', 'b')}, 6) AS edit_sim,
  round({q.literal_sim('a', 'b', 'ta', 'tb', 0.7)}, 6) AS value_sim,
  coalesce({q.literal_sim('a', 'b', 'ta', 'tb', 0.5)} > 0.5, false) AS alike
FROM t""")
def text_similarity(spark, sf):
    """Edit and value similarity of each part's label with its shop title."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    labels = part.select(
        F.expr("p_name || ', ' || p_brand || ' (' || p_type || ')'").alias("a"),
        F.expr("lower(p_type) || ' ' || p_name || 's'").alias("b"),
    ).distinct()
    return labels.select(
        "a",
        "b",
        text.ci_equal("a", "b").alias("same"),
        F.levenshtein("a", "b").alias("edits"),
        F.round(text.string_distance_sim("a", "b"), 6).alias("edit_sim"),
        F.round(text.literal_sim("a", "b", 0.7), 6).alias("value_sim"),
        text.literals_equal("a", "b", 0.5).alias("alike"),
    )


@register(f"""SELECT doc_id, {q.clean('text')} AS cleaned, array_to_string({q.value_tokens('text')}, '|') AS words FROM documents""")
def cleaned_texts(spark, sf):
    """Whole document texts without noise, and the words that take part in comparison."""
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id",
        text.clean_text("text").alias("cleaned"),
        F.array_join(text.value_tokens("text"), "|").alias("words"),
    )


_NAMES = """SELECT DISTINCT unnest([p_type || p_name || p_brand, replace(p_name, ' ', '') || 'Of' || p_brand,
  upper(p_name) || lower(p_type) || 'URL2Id']) AS name FROM part"""


@register(f"SELECT name, array_to_string({q.camel('name')}, '|') AS words FROM ({_NAMES})")
def camel_words(spark, sf):
    """Words of composed names."""
    names = F.array(
        F.expr("p_type || p_name || p_brand"),
        F.expr("replace(p_name, ' ', '') || 'Of' || p_brand"),
        F.expr("upper(p_name) || lower(p_type) || 'URL2Id'"),
    )
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(names).alias("name")).distinct()
    return part.select("name", F.array_join(text.split_camel("name"), "|").alias("words"))


@register(q.stems("SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM documents") + " WHERE word <> ''")
def stem_vocabulary(spark, sf):
    """Stems of all words of the documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("w != ''")
    return lexicon.stem_vocabulary(words, "w")


# --- statistics ----------------------------------------------------------------------------------------


@register(f"SELECT count(*) AS typed_triples FROM ({rows(g.GEO)}) WHERE p = '{RDF_TYPE}'")
def count_typed(spark, sf):
    return stats.count_typed(*graph(spark, sf, g.GEO))


@register(f"""WITH t AS (SELECT * FROM ({rows(g.GEO)}) WHERE p = '{RDF_TYPE}')
SELECT o, count(*) AS triples FROM t GROUP BY o UNION ALL SELECT 'SUM', count(*) FROM t""")
def type_histogram(spark, sf):
    return stats.type_histogram(*graph(spark, sf, g.GEO))


@register(f"""WITH t AS (SELECT * FROM ({rows(g.GEO)}) WHERE p = '{RDF_TYPE}')
SELECT s, count(*) AS triples FROM t GROUP BY s UNION ALL SELECT 'SUM', count(*) FROM t""")
def subject_type_histogram(spark, sf):
    return stats.subject_type_histogram(*graph(spark, sf, g.GEO))


@register(f"""WITH t AS ({rows(g.GEO)})
SELECT DISTINCT s FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.s = t.s AND u.p = '{RDF_TYPE}')""")
def untyped_subjects(spark, sf):
    return stats.untyped_subjects(*graph(spark, sf, g.GEO))


@register(f"SELECT p, count(*) AS triples FROM ({rows(g.GEO)}) WHERE p = '{OWL_SAME_AS}' GROUP BY p")
def count_same_as(spark, sf):
    return stats.count_same_as(*graph(spark, sf, g.GEO))


@register(f"SELECT s, count(*) AS triples FROM ({rows(g.CATALOGUE)}) GROUP BY s")
def subject_degree(spark, sf):
    return stats.subject_degree(*graph(spark, sf, g.CATALOGUE))


@register(f"SELECT p, count(*) AS triples FROM ({rows(g.CATALOGUE)}) GROUP BY p")
def predicate_frequency(spark, sf):
    return predicate_histogram(*graph(spark, sf, g.CATALOGUE))


_TYPED = f"p = '{RDF_TYPE}'"


@register(f"""WITH t AS ({rows(g.GEO)})
SELECT 'triples' AS measure, count(*) AS n FROM t UNION ALL SELECT 'typed_triples', count(*) FROM t WHERE {_TYPED}
UNION ALL SELECT 'predicates', count(DISTINCT p) FROM t UNION ALL SELECT 'subjects', count(DISTINCT s) FROM t
UNION ALL SELECT 'entities', count(*) FROM (SELECT s FROM t UNION SELECT o FROM t)
UNION ALL SELECT 'literals', count(DISTINCT o) FROM t WHERE o NOT LIKE '<%'
UNION ALL SELECT 'uri_objects', count(DISTINCT o) FROM t WHERE o LIKE '<%'
UNION ALL SELECT 'classes', count(DISTINCT o) FROM t WHERE {_TYPED}
UNION ALL SELECT 'typed_subjects', count(DISTINCT s) FROM t WHERE {_TYPED}""")
def graph_profile(spark, sf):
    return stats.graph_profile(*graph(spark, sf, g.GEO))


@register(f"""WITH a AS (SELECT o, count(*) AS n FROM ({rows(g.CATALOGUE)}) WHERE {_TYPED} GROUP BY o),
b AS (SELECT o, count(*) AS n FROM ({rows(g.SHOP)}) WHERE {_TYPED} GROUP BY o)
SELECT a.o AS type1, b.o AS type2, a.n * b.n AS pairs FROM a CROSS JOIN b""")
def type_pair_counts(spark, sf):
    """Size of the join of both graphs' type statements, per pair of classes."""
    return stats.type_pair_counts(*graph(spark, sf, g.CATALOGUE, g.SHOP))


# --- predicates ----------------------------------------------------------------------------------------


def _names(spec: list, n: int, value: str = q.ending("p")) -> str:
    return (
        f"n{n} AS (SELECT *, {q.camel('c')} AS t FROM (SELECT *, {q.clean('v')} AS c FROM "
        f"(SELECT DISTINCT p, {value} AS v FROM ({g.sql(spec)}))))"
    )


def _name_scores(spec1: list, spec2: list) -> str:
    sim = q.name_sim("n1.v", "n2.v", "n1.t", "n2.t")
    return (
        f"WITH {_names(spec1, 1)}, {_names(spec2, 2)}, sc AS (SELECT n1.p AS predicate1, n2.p AS predicate2, "
        f"{sim} AS score FROM n1 CROSS JOIN n2)"
    )


@register(f"""WITH a AS (SELECT DISTINCT p, {q.ending('p')} AS v FROM ({g.sql(g.CATALOGUE)})),
b AS (SELECT DISTINCT p, {q.ending('p')} AS v FROM ({g.sql(g.SHOP)}))
SELECT a.p AS predicate1, b.p AS predicate2 FROM a JOIN b ON a.v = b.v""")
def equal_predicates(spark, sf):
    return predicates.equal_predicates(*graph(spark, sf, g.CATALOGUE, g.SHOP))


@register(f"{_name_scores(g.CATALOGUE, g.SHOP)} SELECT predicate1, predicate2 FROM sc WHERE score > 0.7")
def match_predicates(spark, sf):
    return predicates.match_predicates(*graph(spark, sf, g.CATALOGUE, g.SHOP))


@register(f"{_name_scores(g.CATALOGUE, g.SHOP)} SELECT predicate1, predicate2 FROM sc WHERE score > 0.7")
def predicate_pairs_from_files(spark, sf):
    """Matched predicates of two graphs in files: computed once, kept by the files they come from, exchanged as text."""
    folder, paths = _files(spark, sf, g.CATALOGUE, g.SHOP)

    def compute():
        return predicates.match_predicates(*(read_ntriples(spark, p) for p in paths))

    def refuse():
        raise ValueError("the result is there already")

    tables.stored_result(spark, folder, "pairs", paths, compute, "0.7")
    kept = tables.stored_result(spark, folder, "pairs", paths, refuse, "0.7")
    tables.write_pairs(kept, f"{folder}/pairs-text")
    return tables.read_predicate_pairs(spark, f"{folder}/pairs-text")


@register(f"{_name_scores(g.CATALOGUE, g.SHOP)} SELECT predicate1, predicate2, round(score, 6) AS score FROM sc WHERE score >= 0.4")
def partitioned_name_scores(spark, sf):
    scored = predicates.partitioned_name_scores(*graph(spark, sf, g.CATALOGUE, g.SHOP), partitions=4)
    return scored.withColumn("score", F.round("score", 6))


@register(f"""{_name_scores(g.CATALOGUE, g.SHOP)},
a AS (SELECT p, count(*) AS n FROM ({rows(g.CATALOGUE)}) GROUP BY p), b AS (SELECT p, count(*) AS n FROM ({rows(g.SHOP)}) GROUP BY p)
SELECT predicate1, predicate2, a.n * b.n AS pairs FROM sc JOIN a ON a.p = predicate1 JOIN b ON b.p = predicate2
WHERE score > 0.3""")
def rank_predicates(spark, sf):
    """Joined statements per pair of similar predicates."""
    t1, t2 = graph(spark, sf, g.CATALOGUE, g.SHOP)
    return stats.rank_predicates(t1, t2, predicates.match_predicates(t1, t2, 0.3))


@register(f"""WITH {_names(g.CATALOGUE, 1, q.local_name('p'))}, {_names(g.SHOP, 2, q.local_name('p'))}
SELECT * FROM (SELECT n1.v AS term1, n2.v AS term2, round({q.name_sim('n1.v', 'n2.v', 'n1.t', 'n2.t')}, 6) AS score,
  1::BIGINT AS copies FROM (SELECT DISTINCT v, t FROM n1) n1 CROSS JOIN (SELECT DISTINCT v, t FROM n2) n2) WHERE score >= 0.4""")
def compare_predicates(spark, sf):
    """Similar local names of the predicates of two graphs."""
    found = align.compare_predicates(*graph(spark, sf, g.CATALOGUE, g.SHOP))
    return found.withColumn("score", F.round("score", 6))


def _value_list(spec: list) -> str:
    v = "regexp_extract(o, '(?s)^\"(.*)\"(?:@[A-Za-z0-9\\-]+|\\^\\^<[^>]*>)?$', 1)"
    inner = f"SELECT DISTINCT {v} AS v FROM ({g.sql(spec)}) WHERE o NOT LIKE '<%' AND o NOT LIKE '_:%'"
    return f"SELECT v, {q.value_tokens('v')} AS t FROM ({inner})"


def _term_pairs(list1: str, list2: str) -> str:
    sim = q.literal_sim("a.v", "b.v", "a.t", "b.t", 0.4, q.EQUAL_WORDS, "0.0")
    return (
        f"WITH a AS MATERIALIZED ({list1}), b AS MATERIALIZED ({list2}) SELECT * FROM (SELECT a.v AS term1, b.v AS term2, "
        f"round({sim}, 6) AS score, 1::BIGINT AS copies FROM a CROSS JOIN b) WHERE score >= 0.4"
    )


@register(_term_pairs(_value_list(g.CATALOGUE), _value_list(g.SHOP)))
def compare_literals(spark, sf):
    """Similar literals of two graphs, by equal words."""
    found = align.compare_literals(*graph(spark, sf, g.CATALOGUE, g.SHOP))
    return found.withColumn("score", F.round("score", 6))


def _counted(spec: list, n: int) -> str:
    """Texts ``a{n}`` of several words or none, and their words ``w{n}`` with counts."""
    return (
        f"a{n} AS MATERIALIZED ({_value_list(spec)}), w{n} AS MATERIALIZED (SELECT v, len(t) AS n, lower(x) AS w, count(*) AS c "
        f"FROM (SELECT v, t, unnest(t) AS x FROM a{n} WHERE len(t) > 1) WHERE x <> '' GROUP BY ALL)"
    )


@register(f"""WITH {_counted(g.DOCUMENTS, 1)}, {_counted(g.TURNS, 2)},
h AS (SELECT w1.v AS v1, w2.v AS v2, w1.n AS n1, w2.n AS n2, sum(w1.c * w2.c)::BIGINT AS hits FROM w1 JOIN w2 USING (w) GROUP BY ALL),
sc AS (SELECT a1.v AS v1, a2.v AS v2, 1.0::DOUBLE AS score FROM a1 JOIN a2 ON lower(a1.v) = lower(a2.v) WHERE a1.v <> ''
UNION ALL SELECT v1, v2, {q.ratio('hits', 'n1', 'n2')} FROM h WHERE lower(v1) <> lower(v2))
SELECT md5(v1) AS text1, md5(v2) AS text2, round(score, 6) AS score, 1::BIGINT AS copies FROM sc WHERE score >= 0.4""")
def compare_texts(spark, sf):
    """Documents and conversation turns whose words agree, over whole texts; digests stand for the texts."""
    found = align.compare_literals(*graph(spark, sf, g.DOCUMENTS, g.TURNS), shown=F.md5)
    return found.select(F.col("term1").alias("text1"), F.col("term2").alias("text2"), F.round("score", 6).alias("score"), "copies")


def _entity_list(spec: list) -> str:
    return (
        f"SELECT v, t, count(*) AS n FROM (SELECT v, {q.value_tokens('v')} AS t FROM (SELECT DISTINCT {q.local_name('o')} AS v "
        f"FROM ({g.sql(spec)}) WHERE o LIKE '<%' UNION ALL SELECT DISTINCT {q.local_name('s')} FROM ({g.sql(spec)}))) GROUP BY v, t"
    )


@register(
    _term_pairs(_entity_list(g.CATALOGUE), _entity_list(g.SHOP)).replace("1::BIGINT AS copies", "a.n * b.n AS copies")
)
def compare_entities(spark, sf):
    """Similar local names of the entities of two graphs."""
    found = align.compare_entities(*graph(spark, sf, g.CATALOGUE, g.SHOP))
    return found.withColumn("score", F.round("score", 6))


@register(f"""WITH {_names(g.CATALOGUE, 1, q.local_name('p'))}, {_names(g.SHOP, 2, q.local_name('p'))},
a AS (SELECT DISTINCT v, t FROM n1), b AS (SELECT DISTINCT v, t FROM n2),
k AS (SELECT count(*)::DOUBLE AS kept FROM a CROSS JOIN b WHERE {q.name_sim('a.v', 'b.v', 'a.t', 'b.t')} >= 0.4)
SELECT round(100.0 - (x.n - kept) / x.n * 100.0, 2) AS compression
FROM k, (SELECT (SELECT count(*) FROM a)::DOUBLE + (SELECT count(*) FROM b) AS n) x""")
def predicate_compression(spark, sf):
    return align.predicate_compression(*graph(spark, sf, g.CATALOGUE, g.SHOP))


@register(f"""WITH d AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS id FROM (SELECT DISTINCT p FROM ({g.sql(g.CATALOGUE)} UNION ALL {g.sql(g.SHOP)}))),
n AS (SELECT *, {q.camel('c')} AS t FROM (SELECT *, {q.clean('v')} AS c FROM (SELECT p, id, {q.lower_ending('p')} AS v FROM d)))
SELECT * FROM (SELECT n1.p AS term1, n1.id AS id1, n2.p AS term2, n2.id AS id2,
  round({q.name_sim('n1.v', 'n2.v', 'n1.t', 'n2.t')}, 6) AS score FROM n n1 CROSS JOIN n n2) WHERE score > 0.5""")
def similar_relations(spark, sf):
    """Similar relations inside the merged graph."""
    merged = encoding.merge_graphs(*graph(spark, sf, g.CATALOGUE, g.SHOP))
    found = predicates.similar_relations(encoding.relation_ids(merged))
    return found.withColumn("score", F.round("score", 6))


# --- blocking ------------------------------------------------------------------------------------------


def _sides(spec1: list, spec2: list, literals: bool = True, pair_sql: str | None = None) -> str:
    """Blocked sides ``a`` and ``b`` ``(s, p1, p2, v)``, one row per statement."""
    only = " WHERE o NOT LIKE '<%'" if literals else ""
    pair_sql = pair_sql or f"{_name_scores(spec1, spec2)} SELECT predicate1, predicate2 FROM sc WHERE score > 0.7"
    return f"""pp AS MATERIALIZED ({pair_sql}),
a AS MATERIALIZED (SELECT * FROM (SELECT s, predicate1 AS p1, predicate2 AS p2, {q.comparable('o')} AS v
  FROM (SELECT * FROM ({rows(spec1, meta=False)}){only}) JOIN pp ON p = predicate1) WHERE v IS NOT NULL),
b AS MATERIALIZED (SELECT * FROM (SELECT s, predicate1 AS p1, predicate2 AS p2, {q.comparable('o')} AS v
  FROM (SELECT * FROM ({rows(spec2, meta=False)}){only}) JOIN pp ON p = predicate2) WHERE v IS NOT NULL),
pc AS MATERIALIZED (SELECT s1, s2, count(*) AS n FROM (SELECT a.s AS s1, b.s AS s2, a.p1, a.p2
  FROM (SELECT DISTINCT s, p1, p2 FROM a) a JOIN (SELECT DISTINCT s, p1, p2 FROM b) b ON a.p1 = b.p1 AND a.p2 = b.p2) GROUP BY s1, s2)"""


_MATCHES = """tot AS (SELECT a.s AS s1, b.s AS s2, sum(score) AS total FROM a JOIN vp ON a.p1 = vp.p1 AND a.p2 = vp.p2 AND a.v = vp.v1
  JOIN b ON b.p1 = vp.p1 AND b.p2 = vp.p2 AND b.v = vp.v2 GROUP BY a.s, b.s),
every AS MATERIALIZED (SELECT s1, s2, total / n AS score, n FROM tot JOIN pc USING (s1, s2)
  WHERE s1 <> s2 AND total / n > CASE n WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.8 ELSE 0.7 END),
m AS MATERIALIZED (SELECT every.* FROM every, (SELECT min(n) AS lo, max(n) AS hi FROM pc) WHERE n > lo OR lo = hi)"""


def _leaves(spec1: list, spec2: list, test: str | None = None, whole: str | None = None, exact: bool = False,
            pair_sql: str | None = None) -> str:
    """Scored value pairs ``vp`` and matches ``m`` over the full set of subject pairs."""
    sim = "CASE WHEN x.v = y.v THEN 1.0 ELSE 0.0 END" if exact else q.literal_sim("x.v", "y.v", "x.t", "y.t", 0.7, test, whole)
    return f"""{_sides(spec1, spec2, pair_sql=pair_sql)},
va AS MATERIALIZED (SELECT p1, p2, v, {q.value_tokens('v')} AS t FROM (SELECT DISTINCT p1, p2, v FROM a)),
vb AS MATERIALIZED (SELECT p1, p2, v, {q.value_tokens('v')} AS t FROM (SELECT DISTINCT p1, p2, v FROM b)),
vp AS MATERIALIZED (SELECT * FROM (SELECT x.p1, x.p2, x.v AS v1, y.v AS v2, {sim} AS score
  FROM va x JOIN vb y ON x.p1 = y.p1 AND x.p2 = y.p2) WHERE score > 0.7),
{_MATCHES}"""


def _blocked(spark, sf, spec1, spec2, literals=True):
    """Both graphs, their matched predicates and factored block tables."""
    t1, t2 = (stored(align.prepare(g.build(spark, sf, s))) for s in (spec1, spec2))
    pairs = stored(blocking.with_block(align.predicate_pairs(t1, t2)))
    keep = filters.literal_triples if literals else (lambda t: t)
    sides = [stored(blocking.blocked_side(keep(t), pairs, n)) for n, t in ((1, t1), (2, t2))]
    return t1, t2, pairs, *sides


@register(f"""WITH {_sides(g.CATALOGUE, g.SHOP, literals=False)},
x AS (SELECT p1, p2, count(*) AS n, count(DISTINCT s) AS k FROM a GROUP BY p1, p2), y AS (SELECT p1, p2, count(*) AS n, count(DISTINCT s) AS k FROM b GROUP BY p1, p2)
SELECT x.p1 AS predicate1, x.p2 AS predicate2, x.k AS subjects1, y.k AS subjects2, x.n * y.n AS blocked_rows FROM x JOIN y USING (p1, p2)""")
def block_sizes(spark, sf):
    """Rows of the block table per pair of predicates."""
    t1, t2 = (align.prepare(g.build(spark, sf, s)) for s in (g.CATALOGUE, g.SHOP))
    return blocking.block_sizes(t1, t2, align.predicate_pairs(t1, t2))


@register(f"""WITH {_sides(g.CATALOGUE, g.SHOP)}
SELECT n AS "count", count(*) AS pairs, n * count(*) AS comparisons FROM pc GROUP BY n""")
def cluster_level_stats(spark, sf):
    """Subject pairs and comparisons per number of shared predicates."""
    t1, t2, pairs, _, _ = _blocked(spark, sf, g.CATALOGUE, g.SHOP)
    clusters = align.cluster_subjects(t1, t2, pairs)
    return blocking.cluster_level_stats(clusters).withColumn("pairs", F.col("pairs").cast("bigint"))


@register(f"WITH {_sides(g.CATALOGUE, g.SHOP)} SELECT DISTINCT n AS \"count\" FROM pc")
def cluster_levels(spark, sf):
    *_, side1, side2 = _blocked(spark, sf, g.CATALOGUE, g.SHOP)
    return blocking.cluster_levels(blocking.common_predicate_clusters(side1, side2))


@register(f"""WITH {_sides(g.CATALOGUE, g.SHOP)}
SELECT s1, n AS "count", count(*) AS partners FROM pc GROUP BY s1, n""")
def common_predicate_counts(spark, sf):
    """Per subject and number of shared predicates: its partners in the other graph."""
    *_, side1, side2 = _blocked(spark, sf, g.CATALOGUE, g.SHOP)
    return blocking.partners_per_level(
        blocking.profiles(side1), blocking.common_predicate_clusters(side1, side2)
    )


@register(f"""WITH {_sides(g.CATALOGUE, g.SHOP)},
r AS (SELECT x.s AS s1, y.s AS s2, sum(x.n * y.n)::BIGINT AS c FROM (SELECT s, p1, p2, count(*) AS n FROM a GROUP BY s, p1, p2) x
  JOIN (SELECT s, p1, p2, count(*) AS n FROM b GROUP BY s, p1, p2) y USING (p1, p2) GROUP BY x.s, y.s)
SELECT s1, c AS "count", count(*) AS partners FROM r GROUP BY s1, c""")
def common_value_counts(spark, sf):
    """Per subject and number of value pairs: its partners in the other graph."""
    *_, side1, side2 = _blocked(spark, sf, g.CATALOGUE, g.SHOP)
    return blocking.partners_per_level(
        blocking.profiles(side1, rows=True), blocking.common_value_clusters(side1, side2)
    )


@register(f"""WITH {_sides(g.CATALOGUE, g.SHOP, literals=False)}
SELECT n AS "count", count(*) AS pairs, n * count(*) AS comparisons FROM pc GROUP BY n""")
def blocking_evaluation(spark, sf):
    """Levels when URI statements are blocked too."""
    t1, t2 = (align.prepare(g.build(spark, sf, s)) for s in (g.CATALOGUE, g.SHOP))
    return blocking.cluster_level_stats(align.blocking_evaluation(t1, t2))


@register(f"""WITH a AS (SELECT s, p, v, count(*) AS m FROM (SELECT s, p, {q.literal_or_ending('o')} AS v FROM ({rows(g.CATALOGUE)})) GROUP BY s, p, v),
b AS (SELECT s, p, v, count(*) AS m FROM (SELECT s, p, {q.literal_or_ending('o')} AS v FROM ({rows(g.EDITION)})) GROUP BY s, p, v)
SELECT a.s AS s1, b.s AS s2, sum(a.m * b.m)::BIGINT AS "count" FROM a JOIN b ON a.p IS NOT DISTINCT FROM b.p AND a.v IS NOT DISTINCT FROM b.v
GROUP BY a.s, b.s HAVING count(*) >= 4""")
def shared_value_ranking(spark, sf):
    """Subjects of two editions ranked by shared statements, from four shared values on."""
    return blocking.shared_value_counts(*graph(spark, sf, g.CATALOGUE, g.EDITION), min_shared=4)


# --- matching ------------------------------------------------------------------------------------------


def _rounded(df: DataFrame, column: str = "score") -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


@register(f"WITH {_leaves(g.CATALOGUE, g.SHOP)} SELECT s1, s2, round(score, 6) AS score FROM m")
def align_entities(spark, sf):
    """Entity matches between catalogue and shop by literal values."""
    t1, t2 = (align.prepare(g.build(spark, sf, s)) for s in (g.CATALOGUE, g.SHOP))
    return _rounded(align.align_entities(t1, t2, skip_lowest=True))


_SAME = f"SELECT DISTINCT p AS predicate1, p AS predicate2 FROM ({g.sql(g.EDITION)})"


@register(f"WITH {_leaves(g.CATALOGUE, g.EDITION, exact=True, pair_sql=_SAME)} SELECT s1, s2, round(score, 6) AS score FROM m")
def align_exact(spark, sf):
    """Entity matches between two editions by identical values under identical predicates."""
    t1, t2 = (align.prepare(g.build(spark, sf, s)) for s in (g.CATALOGUE, g.EDITION))
    return _rounded(align.align_entities(t1, t2, align.predicate_pairs(t1, t2, exact=True), mode="exact", skip_lowest=True))


@register(f"WITH {_leaves(g.CATALOGUE, g.SHOP)} SELECT s1, s2, round(score, 6) AS score FROM every")
def align_all_levels(spark, sf):
    """Entity matches between catalogue and shop, those of the fewest shared predicates included."""
    t1, t2 = (align.prepare(g.build(spark, sf, s)) for s in (g.CATALOGUE, g.SHOP))
    return _rounded(align.align_entities(t1, t2))


@register(f"WITH {_leaves(g.CATALOGUE, g.SHOP)} SELECT s1, s2, round(score, 6) AS score FROM every WHERE n >= 4")
def align_min_shared(spark, sf):
    """Entity matches of subjects that share four predicates or more."""
    t1, t2 = (align.prepare(g.build(spark, sf, s)) for s in (g.CATALOGUE, g.SHOP))
    return _rounded(align.align_entities(t1, t2, min_shared=4))


_LEVELS = ", ".join(
    f"x{n} AS MATERIALIZED (SELECT * FROM every WHERE n = {n}"
    + "".join(f" AND s1 NOT IN (SELECT s1 FROM x{h}) AND s2 NOT IN (SELECT s2 FROM x{h})" for h in range(7, n, -1)) + ")"
    for n in range(7, 0, -1)
)


@register(f"WITH {_leaves(g.CATALOGUE, g.SHOP)}, {_LEVELS} SELECT s1, s2, round(score, 6) AS score FROM ({' UNION ALL '.join(f'SELECT * FROM x{n}' for n in range(1, 8))})")
def align_exclusive(spark, sf):
    """Entity matches level by level, without subjects that are matched with more shared predicates."""
    t1, t2 = (align.prepare(g.build(spark, sf, s)) for s in (g.CATALOGUE, g.SHOP))
    return _rounded(align.align_entities(t1, t2, exclusive=True))


@register(f"WITH {_leaves(g.CATALOGUE, g.SHOP, q.EQUAL_WORDS, '0.0')} SELECT s1, s2, round(score, 6) AS score FROM m")
def align_lexical(spark, sf):
    """Entity matches by equal words only."""
    t1, t2 = (align.prepare(g.build(spark, sf, s)) for s in (g.CATALOGUE, g.SHOP))
    return _rounded(align.align_entities(t1, t2, mode="lexical", skip_lowest=True))


@register(f"""WITH {_leaves(g.CATALOGUE, g.SHOP)}
SELECT p1 AS predicate1, p2 AS predicate2, v1, v2, round(score, 6) AS score FROM vp""")
def similar_values(spark, sf):
    """Similar literals under matched predicates."""
    _, _, pairs, side1, side2 = _blocked(spark, sf, g.CATALOGUE, g.SHOP)
    found = matching.similar_values(side1, side2).join(blocking.with_block(pairs), "b")
    return _rounded(found.select("predicate1", "predicate2", "v1", "v2", "score"))


_EVIDENCE = f"""WITH {_leaves(g.CATALOGUE, g.SHOP)},
br AS (SELECT m.s1, a.v AS literal1, m.s2, b.v AS literal2, a.p1, a.p2 FROM m JOIN a ON a.s = m.s1 JOIN b ON b.s = m.s2 AND a.p1 = b.p1 AND a.p2 = b.p2),
ev AS (SELECT br.s1, br.literal1, br.s2, br.literal2, score FROM br JOIN vp ON vp.p1 = br.p1 AND vp.p2 = br.p2 AND vp.v1 = literal1 AND vp.v2 = literal2)"""


def _evidence(spark, sf):
    """Block rows of matched classes of subjects with equal values, and what writes rows of classes out for their subjects."""
    _, _, _, *sides = _blocked(spark, sf, g.CATALOGUE, g.SHOP)
    side1, side2, *members = classes.value_classes(*sides)
    found = stored(matching.match_classes(side1, side2, skip_lowest=True))
    return stored(blocking.block_rows_of_pairs(side1, side2, found)), lambda rows: classes.of_members(rows, *members)


@register(f"{_EVIDENCE} SELECT s1, s2, literal1, literal2 FROM br")
def match_evidence(spark, sf):
    """Block rows of all matched pairs."""
    blocks, written = _evidence(spark, sf)
    return written(blocks.select("s1", "s2", "literal1", "literal2"))


@register(f"{_EVIDENCE} SELECT s1, s2, round(score, 6) AS score FROM ev")
def score_blocked(spark, sf):
    """Scores of the similar values of all matched pairs."""
    blocks, written = _evidence(spark, sf)
    return _rounded(written(matching.score_blocked(blocks)))


@register(f"""{_EVIDENCE}, c AS (SELECT s1, s2, count(*) AS n FROM br GROUP BY s1, s2)
SELECT s1, s2, round(sum(score) / any_value(n), 6) AS score FROM ev JOIN c USING (s1, s2) GROUP BY s1, s2
HAVING sum(score) / any_value(n) > 0.7""")
def aggregate_matches(spark, sf):
    """Matched pairs by summed score over all their value pairs."""
    blocks, written = _evidence(spark, sf)
    scored = matching.score_blocked(blocks)
    return _rounded(written(matching.aggregate_matches(scored, blocking.common_value_counts(blocks))))


@register(f"""WITH {_leaves(g.CATALOGUE, g.SHOP)}
SELECT m.s1, a.v AS literal1, m.s2, b.v AS literal2 FROM m JOIN a ON a.s = m.s1 JOIN b ON b.s = m.s2 AND a.p1 = b.p1 AND a.p2 = b.p2 WHERE n = 3""")
def literals_of_cluster(spark, sf):
    """Block rows of the matched pairs that share three predicates."""
    blocks, written = _evidence(spark, sf)
    named = blocks.select("*", F.col("b").alias("p1"), F.col("b").alias("p2"))
    return written(matching.literals_of_cluster(blocks, blocking.common_predicate_counts(named), 3))


# --- neighbourhood -------------------------------------------------------------------------------------

_LINKS = f"SELECT s AS s1, '<{g.B}/party/' || regexp_extract(s, '([0-9]+)>$', 1) || '>' AS s2 FROM ({rows(g.GEO)}) WHERE p = '{OWL_SAME_AS}'"


def _linked(spark, sf):
    t = stored(graph(spark, sf, g.GEO)[0])
    links = t.filter(F.col("p") == OWL_SAME_AS).select(F.col("s").alias("s1"), F.col("o").alias("s2"))
    return t, links


_AROUND = f"""t AS MATERIALIZED ({rows(g.GEO)}), l AS ({_LINKS}),
nodes AS (SELECT o AS node FROM t WHERE o IN (SELECT s1 FROM l) UNION SELECT o FROM t WHERE s IN (SELECT s1 FROM l)),
r AS MATERIALIZED (SELECT DISTINCT s, p, o FROM t WHERE s IN (SELECT node FROM nodes) OR o IN (SELECT node FROM nodes))"""


@register(f"WITH {_AROUND} SELECT * FROM r")
def neighbour_triples(spark, sf):
    """Triples around all linked customers."""
    t, links = _linked(spark, sf)
    return neighbours.neighbour_triples(t, links.select(F.col("s1").alias("s")))


@register(f"WITH {_AROUND} SELECT * FROM t WHERE s NOT IN (SELECT s1 FROM l) AND o NOT IN (SELECT s1 FROM l)")
def untouched_triples(spark, sf):
    t, links = _linked(spark, sf)
    return neighbours.untouched_triples(t, links)


@register(f"""WITH {_AROUND} SELECT DISTINCT coalesce(x.s2, r.s) AS s, r.p, coalesce(y.s2, r.o) AS o
FROM r LEFT JOIN l x ON r.s = x.s1 LEFT JOIN l y ON r.o = y.s1""")
def substitute_matched(spark, sf):
    """Neighbour triples with linked customers replaced by their partners."""
    t, links = _linked(spark, sf)
    around = neighbours.neighbour_triples(t, links.select(F.col("s1").alias("s")))
    return neighbours.substitute_matched(around, links)


@register(f"""WITH c AS (SELECT {g.uri(g.A + '/c/', g.code(f"'{g.A}' || cast(c_custkey as string)"))} AS s1,
  {g.uri(g.B + '/c/', g.code(f"'{g.B}' || cast(c_custkey as string)"))} AS s2, c_custkey FROM customer),
d AS (SELECT DISTINCT {g.uri(g.A + '/o/', g.code(f"'{g.A}' || cast(x.o_orderkey as string)"))} AS s1,
  {g.uri(g.B + '/o/', g.code(f"'{g.B}' || cast(y.o_orderkey as string)"))} AS s2 FROM orders x JOIN orders y USING (o_custkey))
SELECT s1, s2, 1.0::DOUBLE AS score, 0 AS stage FROM c UNION ALL SELECT s1, s2, 1.0::DOUBLE, 1 FROM d""")
def deduce_relations(spark, sf):
    """Customers matched by code; their orders follow through the neighbourhood."""
    t1, t2 = (align.prepare(g.build(spark, sf, s)) for s in (g.TRADE1, g.TRADE2))
    found = align.align_entities(t1, t2)
    return _rounded(align.deduce_relations(t1, t2, found))


def _own(host: str, kind: str, key: str) -> str:
    return g.uri(f"{host}/{kind}/", g.code(f"'{host}{kind}' || {g.num(key)}"))


_REGIONS = f"SELECT {_own(g.A, 'r', 'r_regionkey')} AS s1, {_own(g.B, 'r', 'r_regionkey')} AS s2, r_regionkey, r_name FROM region"
_COUNTRIES = f"SELECT {_own(g.A, 'n', 'x.n_nationkey')} AS s1, {_own(g.B, 'n', 'y.n_nationkey')} AS s2, x.n_regionkey, x.n_nationkey AS k1, y.n_nationkey AS k2 FROM nation x JOIN nation y USING (n_regionkey)"
# In the second round countries stand for their partners, so partners of one country are compared with each other, too.
_ROUNDS = f"""SELECT s1, s2, 1.0::DOUBLE AS score, 0 AS stage FROM ({_REGIONS}) UNION ALL SELECT s1, s2, 1.0::DOUBLE, 1 FROM ({_COUNTRIES})
UNION ALL SELECT {_own(g.A, 's', 'x.s_suppkey')}, {_own(g.B, 's', 'y.s_suppkey')}, 1.0::DOUBLE, 2 FROM supplier x JOIN nation nx ON nx.n_nationkey = x.s_nationkey
  JOIN nation ny ON ny.n_regionkey = nx.n_regionkey JOIN supplier y ON y.s_nationkey = ny.n_nationkey
UNION ALL SELECT {_own(g.B, 'n', 'x.n_nationkey')}, {_own(g.B, 'n', 'y.n_nationkey')}, 1.0::DOUBLE, 2 FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey"""


def _chains(spark, sf, spec1=g.CHAIN1, spec2=g.CHAIN2):
    t1, t2 = (align.prepare(g.build(spark, sf, s)) for s in (spec1, spec2))
    codes = [t.filter(F.col("p").endswith("regionCode>")) for t in (t1, t2)]
    return t1, t2, align.align_entities(*codes)


@register(_ROUNDS)
def deduce_rounds(spark, sf):
    """Regions matched by code; countries follow in the first round, parties in the second."""
    return _rounded(align.deduce_relations(*_chains(spark, sf), rounds=2))


@register(_ROUNDS)
def deduce_fixpoint(spark, sf):
    """The same until nothing new is found."""
    return _rounded(align.deduce_relations(*_chains(spark, sf), rounds=None))


@register(f"""SELECT s1, s2, 1.0::DOUBLE AS score, CASE WHEN r_name = 'ASIA' THEN 0 ELSE 1 END AS stage FROM ({_REGIONS})
UNION ALL SELECT c.s1, c.s2, 1.0::DOUBLE, 1 FROM ({_COUNTRIES}) c JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'""")
def deduce_with_earlier(spark, sf):
    """One region known, the others by their values: they join in the first round, the known one's countries as well."""
    t1, t2, found = _chains(spark, sf)
    asia = spark.read.parquet(f"{sf}/region.parquet").filter("r_name = 'ASIA'").select(F.expr(_own(g.A, "r", "r_regionkey")).alias("s1"))
    earlier = align.value_level_matches(t1, t2, align.predicate_pairs(t1, t2))
    return _rounded(align.deduce_relations(t1, t2, found.join(asia, "s1", "left_semi"), earlier=earlier))


_LABEL_SIM = q.edit_sim("'regionlabel' || n_regionkey", "'regionlabel' || n_regionkey || 'x'")


@register(f"""SELECT s1, s2, 1.0::DOUBLE AS score, 0 AS stage FROM ({_REGIONS})
UNION ALL SELECT s1, s2, round((1.0 + {_LABEL_SIM}) / 2, 6), 1 FROM ({_COUNTRIES}) WHERE (1.0 + {_LABEL_SIM}) / 2 > 0.93""")
def deduce_normed(spark, sf):
    """Countries of matched regions whose similar values are similar enough on average; labels alone are not."""
    return _rounded(align.deduce_relations(*_chains(spark, sf, g.LABELLED1, g.LABELLED2), mode="normed"))


@register(f"WITH {_leaves(g.CATALOGUE, g.SHOP)} SELECT s1 AS s, '{OWL_SAME_AS}' AS p, s2 AS o FROM m")
def same_as_triples(spark, sf):
    return neighbours.same_as_triples(align_entities(spark, sf))


# --- encoding ------------------------------------------------------------------------------------------

_CODES = f"""t AS MATERIALIZED (SELECT s, p, o FROM ({rows(g.CATALOGUE)}) UNION ALL SELECT s, p, o FROM ({rows(g.SHOP)})),
e AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT s AS term FROM t UNION SELECT o FROM t)),
r AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT p AS term FROM t)),
x AS MATERIALIZED (SELECT s, p, o, a.id AS s_id, r.id AS p_id, b.id AS o_id FROM t JOIN e a ON s = a.term JOIN r ON p = r.term JOIN e b ON o = b.term)"""


def _merged(spark, sf):
    return stored(encoding.merge_graphs(*graph(spark, sf, g.CATALOGUE, g.SHOP)))


def _encoded(spark, sf):
    t = _merged(spark, sf)
    entities = stored(encoding.entity_ids(t))
    return encoding.encode_triples(t, entities, encoding.relation_ids(t)), entities


@register(f"WITH {_CODES} SELECT * FROM e")
def entity_ids(spark, sf):
    return encoding.entity_ids(_merged(spark, sf))


@register(f"WITH {_CODES} SELECT * FROM r")
def relation_ids(spark, sf):
    return encoding.relation_ids(_merged(spark, sf))


@register(f"WITH {_CODES} SELECT * FROM x")
def encode_triples(spark, sf):
    return _encoded(spark, sf)[0]


@register(f"WITH {_CODES} SELECT s_id AS i, o_id AS j, p_id::DOUBLE AS value FROM x")
def adjacency_entries(spark, sf):
    return encoding.adjacency_entries(_encoded(spark, sf)[0])


@register(f"WITH {_CODES} SELECT count(*) AS rows, count(*) AS columns FROM e")
def matrix_size(spark, sf):
    return encoding.matrix_size(encoding.entity_ids(_merged(spark, sf)))


@register(f"""WITH {_CODES} SELECT 's' AS place, s AS term, s_id AS id FROM x UNION ALL SELECT 'p', p, p_id FROM x
UNION ALL SELECT 'o', o, o_id FROM x""")
def node_id_columns(spark, sf):
    """Subjects, predicates and objects with their ids."""
    parts = encoding.node_id_columns(stored(_encoded(spark, sf)[0]))
    tagged = [d.select(F.lit(n).alias("place"), "term", "id") for n, d in zip("spo", parts)]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@register(f"WITH {_CODES} SELECT s_id AS i, o_id AS j, p_id::DOUBLE AS value FROM x WHERE s_id = (SELECT max(s_id) FROM x)")
def matrix_row(spark, sf):
    """Entries of the last non-empty matrix row."""
    entries = stored(encoding.adjacency_entries(_encoded(spark, sf)[0]))
    return encoding.matrix_row(entries, entries.agg(F.max("i").alias("i")).scalar())


@register(f"WITH {_CODES} SELECT term, id FROM e WHERE id IN (SELECT o_id FROM x WHERE p = '{RDF_TYPE}')")
def term_of_id(spark, sf):
    """Class names looked up by id."""
    encoded, entities = _encoded(spark, sf)
    used = encoded.filter(F.col("p") == RDF_TYPE).select(F.col("o_id").alias("id"))
    return encoding.term_of_id(entities, used).select("term", "id")


# --- evaluation ----------------------------------------------------------------------------------------


@register("""SELECT '<http://a.example/supplier/' || s_suppkey || '>' AS s1, '<http://a.example/nation/' || s_nationkey || '>' AS s2,
  1.0::DOUBLE AS measure FROM supplier""")
def alignment_cells(spark, sf):
    """Pairs of an alignment in cell form."""
    return tables.alignment_cells(*graph(spark, sf, g.CELLS))


@register(f"""WITH {_leaves(g.CATALOGUE, g.SHOP)},
gold AS (SELECT {g.uri(g.A + '/part/', 'cast(p_partkey as string)')} AS s1, {g.uri(g.B + '/item/', 'md5(cast(p_partkey as string))')} AS s2 FROM part),
f AS (SELECT s1, s2 FROM m), d AS (SELECT s1, s2 FROM f UNION SELECT s2, s1 FROM f),
c AS (SELECT (SELECT count(*) FROM gold) AS gold_pairs, (SELECT count(*) FROM f) AS found_pairs,
  (SELECT count(*) FROM (SELECT * FROM gold EXCEPT SELECT * FROM d)) AS missed,
  (SELECT count(*) FROM (SELECT * FROM d EXCEPT SELECT * FROM gold)) AS extra,
  (SELECT count(*) FROM (SELECT * FROM gold INTERSECT SELECT * FROM d)) AS hits,
  (SELECT count(*) FROM (SELECT * FROM d EXCEPT SELECT * FROM gold) WHERE contains(s1, 'item') AND contains(s2, 'item')) AS part_extras,
  (SELECT count(*) FROM d WHERE NOT (contains(s1, 'item') AND contains(s2, 'item'))) AS other_found)
SELECT *, round(hits / found_pairs, 6) AS precision, round(hits / gold_pairs, 6) AS recall,
  round(2.0 * (hits / found_pairs) * (hits / gold_pairs) / (hits / found_pairs + hits / gold_pairs), 6) AS f1 FROM c""")
def evaluate_alignment(spark, sf):
    """Catalogue-shop matches against the parts they were made from."""
    gold = spark.read.parquet(f"{sf}/part.parquet").select(
        F.expr(g.uri(g.A + "/part/", g.num("p_partkey"))).alias("s1"), F.expr(g.uri(g.B + "/item/", g.code("p_partkey"))).alias("s2")
    )
    result = evaluate.evaluate_alignment(gold, align_entities(spark, sf), "item")
    for c in ("precision", "recall", "f1"):
        result = _rounded(result, c)
    return result


# --- lexicon -------------------------------------------------------------------------------------------

_LEX = f"WITH RECURSIVE {lx.SQL}"


@register(f"{_LEX} SELECT c_name AS term, 'noun' AS pos, 1 AS sense_no, synset FROM customer JOIN nodes ON name = lower(c_name)")
def senses_of(spark, sf):
    """First noun senses of the customers' names."""
    names = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_name").alias("term"))
    return lexicon.senses_of(names, lx.tables(spark, sf).senses, "noun", 1)


@register(f"{_LEX} SELECT synset, 0 AS position, name AS lemma FROM nodes")
def lemmas_of(spark, sf):
    """First words of all synsets."""
    synsets = lx.tables(spark, sf).synsets
    return lexicon.lemmas_of(synsets, synsets, position=0)


@register(f"{_LEX} SELECT high AS synset, low AS related FROM edges")
def related(spark, sf):
    """Hyponyms of all synsets."""
    lex = lx.tables(spark, sf)
    return lexicon.related(lex.synsets, lex.pointers, lexicon.HYPONYM)


@register(f"{_LEX} SELECT synset, ancestor, distance::INT AS distance FROM up")
def hypernym_closure(spark, sf):
    """All ancestors with their distance."""
    lex = lx.tables(spark, sf)
    return lexicon.hypernym_closure(lex.synsets, lex.pointers)


@register(f"{_LEX} SELECT f.synset, path[-1] AS root, d::INT AS depth FROM full_paths f JOIN depth USING (synset)")
def root_hypernyms(spark, sf):
    """Root and depth of all synsets."""
    lex = lx.tables(spark, sf)
    up = stored(lexicon.hypernym_closure(lex.synsets, lex.pointers))
    roots = lexicon.root_hypernyms(up, lex.pointers).select("synset", "root")
    return roots.join(lexicon.min_depth(up, lex.pointers), "synset")


def _parties(spark, sf):
    """Pointers, what lies above customers and suppliers, and pairs of them."""
    lex = lx.tables(spark, sf)
    parties = lex.synsets.filter(F.col("synset").rlike("^[cs]"))
    return lex.pointers, stored(lexicon.hypernym_closure(parties, lex.pointers)), stored(lx.trading_pairs(spark, sf))


_MET = f"{_LEX}, {lx.TRADING}, {lx.LOWEST}"


@register(f'{_MET} SELECT a AS "left", b AS "right", common FROM lcs')
def lowest_common_hypernym(spark, sf):
    """Nearest common place of all customers and their suppliers."""
    _, up, pairs = _parties(spark, sf)
    return lexicon.lowest_common_hypernym(pairs, up)


def _joined_ways(ways):
    return ways.select(
        "left", "right", F.array_join("left_path", "/").alias("left_path"), F.array_join("right_path", "/").alias("right_path")
    )


@register(f"""{_MET} SELECT a AS "left", b AS "right", array_to_string(x.path[:list_position(x.path, common)], '/') AS left_path,
  array_to_string(y.path[:list_position(y.path, common)], '/') AS right_path
FROM lcs JOIN full_paths x ON x.synset = a JOIN full_paths y ON y.synset = b""")
def shortest_hypernym_path(spark, sf):
    """Ways of customers and suppliers to their nearest common place."""
    pointers, up, pairs = _parties(spark, sf)
    return _joined_ways(lexicon.shortest_hypernym_path(pairs, pointers, up))


@register(f"""{_LEX}, parts AS (SELECT synset, string_split(rtrim(gloss, ';'), ';') AS p FROM nodes)
SELECT synset, array_to_string(list_filter(p, lambda x: NOT (trim(x) LIKE '"%"')), ';') AS definition,
  array_to_string(list_transform(list_filter(p, lambda x: trim(x) LIKE '"%"'), lambda x: trim(x)), '|') AS examples FROM parts""")
def gloss_parts(spark, sf):
    parts = lexicon.gloss_parts(lx.tables(spark, sf).synsets)
    return parts.withColumn("examples", F.array_join("examples", "|"))


@register(f"{_LEX} SELECT synset, round(ic, 6) AS ic, root_freq::BIGINT AS root_freq FROM ic")
def information_content(spark, sf):
    lex = lx.tables(spark, sf)
    up = stored(lexicon.hypernym_closure(lex.synsets, lex.pointers))
    return _rounded(lexicon.information_content(up, lex.freq), "ic")


_SEVEN = ", ".join(f"round({m}, 6) AS {m}" for m in ("hso", "jcn", "lch", "lin", "res", "wup", "lesk"))


@register(f'WITH RECURSIVE {lx.MEASURES} SELECT a AS "left", b AS "right", round(path, 6) AS path, {_SEVEN} FROM measures')
def synset_similarity(spark, sf):
    """Eight measures of all customers and their suppliers."""
    found = lexicon.synset_similarity(lx.trading_pairs(spark, sf), lx.tables(spark, sf))
    for m in ("path", "hso", "jcn", "lch", "lin", "res", "wup", "lesk"):
        found = _rounded(found, m)
    return found


def _named_pairs(spark, sf):
    """Trading pairs by the names of both parties."""
    lex = lx.tables(spark, sf)
    name = lex.senses.select("synset", "lemma")
    pairs = lx.trading_pairs(spark, sf)
    return lex, (
        pairs.join(name.toDF("left", "x"), "left").join(name.toDF("right", "y"), "right").select("x", "y")
    )


@register(f"""WITH RECURSIVE {lx.MEASURES} SELECT na.name AS x, nb.name AS y, {_SEVEN} FROM measures
JOIN nodes na ON na.synset = a JOIN nodes nb ON nb.synset = b""")
def word_pair_report(spark, sf):
    """Seven measures per pair of names."""
    lex, pairs = _named_pairs(spark, sf)
    found = lexicon.word_pair_report(pairs, lex)
    for m in ("hso", "jcn", "lch", "lin", "res", "wup", "lesk"):
        found = _rounded(found, m)
    return found


@register(f"""WITH RECURSIVE {lx.MEASURES} SELECT na.name AS x, nb.name AS y, coalesce(sim, 0.0) AS sim FROM pairs
LEFT JOIN mean USING (a, b) JOIN nodes na ON na.synset = a JOIN nodes nb ON nb.synset = b""")
def word_similarity(spark, sf):
    """Mean similarity of the names of customers and suppliers."""
    lex, pairs = _named_pairs(spark, sf)
    return lexicon.word_similarity(pairs, lex)


@register("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS lemma FROM part),
t AS (SELECT lemma || 's' AS term FROM w UNION SELECT upper(lemma) FROM w UNION SELECT lemma || 'xyz' FROM w)
SELECT term, coalesce(x.lemma, y.lemma) AS base FROM t LEFT JOIN w x ON x.lemma = lower(term)
LEFT JOIN w y ON lower(term) = y.lemma || 's' WHERE coalesce(x.lemma, y.lemma) IS NOT NULL""")
def base_form(spark, sf):
    """Dictionary forms of inflected words of part names."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    words = stored(part.select(F.explode(F.split("p_name", " ")).alias("lemma")).distinct())
    senses = words.select("lemma", F.lit("noun").alias("pos"))
    forms = F.array(F.concat("lemma", F.lit("s")), F.upper("lemma"), F.concat("lemma", F.lit("xyz")))
    return lexicon.base_form(words.select(F.explode(forms).alias("term")), senses)


# --- lexicon of goods: several parents, senses, verbs, antonyms, synonyms -------------------------------------------

_GOODS = f"WITH RECURSIVE {lx.GOODS}"


def _goods(spark, sf):
    return lexicon.Lexicon(*(stored(t) for t in vars(lx.goods(spark, sf)).values()))


@register(f"{_GOODS} SELECT synset, ancestor, distance FROM up")
def goods_closure(spark, sf):
    """All ancestors where synsets have several hypernyms, by the shortest way."""
    lex = _goods(spark, sf)
    return lexicon.hypernym_closure(lex.synsets, lex.pointers)


@register(f"{_GOODS} SELECT lemma AS term, pos, sense_no::INT AS sense_no, synset FROM senses")
def goods_senses(spark, sf):
    """All senses of all words, of any part of speech."""
    lex = _goods(spark, sf)
    return lexicon.senses_of(lex.senses.select(F.col("lemma").alias("term")).distinct(), lex.senses)


@register(f"{_GOODS} SELECT t AS ptr_type, src AS synset, dst AS related FROM ptr")
def goods_related(spark, sf):
    """Every kind of pointer followed from all synsets."""
    lex = _goods(spark, sf)
    kinds = ("hypernym", "hyponym", "antonym", "part_holonym", "part_meronym", "entailment")
    parts = [lexicon.related(lex.synsets, lex.pointers, k).select(F.lit(k).alias("ptr_type"), "synset", "related") for k in kinds]
    return reduce(DataFrame.unionByName, parts)


_NAME_PAIRS = """pairs AS MATERIALIZED (SELECT DISTINCT 'n:' || split_part(p_name, ' ', 1) AS a, 'n:' || split_part(p_name, ' ', 2) AS b FROM part
  UNION SELECT DISTINCT 'n:' || split_part(p_name, ' ', 2), 'b:' || p_brand FROM part UNION SELECT DISTINCT 'b:' || p_brand, 'q:brand' FROM part
  UNION SELECT 'n:' || w, 'n:' || w FROM by_kind UNION SELECT DISTINCT 'v:' || lower(p_type), 'v:sell' FROM part UNION SELECT 'v:sell', 'goods')"""


def _name_pairs(spark, sf):
    """Pairs of synsets of the goods lexicon: words of one name, words and brands, and some of their own."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    first, second, brand = "'n:' || split_part(p_name, ' ', 1)", "'n:' || split_part(p_name, ' ', 2)", "'b:' || p_brand"
    ends = [(first, second), (second, brand), (brand, "'q:brand'"), (first, first), (second, second), ("'v:' || lower(p_type)", "'v:sell'"), ("'v:sell'", "'goods'")]
    pairs = part.select(F.inline(F.array(*[F.struct(F.expr(a).alias("left"), F.expr(b).alias("right")) for a, b in ends])))
    return stored(pairs.distinct())


@register(f"""{_GOODS}, {_NAME_PAIRS}, lines(synset, tip, path) AS (SELECT synset, synset, [synset] FROM nodes
  UNION ALL SELECT synset, high, list_append(path, high) FROM lines JOIN edges ON tip = low),
best AS MATERIALIZED (SELECT synset, tip, min({{'n': len(path), 'p': path}}) AS m FROM lines GROUP BY synset, tip),
met AS (SELECT a, b, arg_min(x.tip, {{'d2': len(y.m.p), 'd1': len(x.m.p), 't': x.tip}}) AS common FROM pairs JOIN best x ON x.synset = a JOIN best y ON y.synset = b AND x.tip = y.tip GROUP BY a, b)
SELECT a AS "left", b AS "right", array_to_string(x.m.p, '/') AS left_path, array_to_string(y.m.p, '/') AS right_path
FROM met JOIN best x ON x.synset = a AND x.tip = common JOIN best y ON y.synset = b AND y.tip = common""")
def goods_paths(spark, sf):
    """Shortest ways to the lowest common hypernym where there are several."""
    lex = _goods(spark, sf)
    up = stored(lexicon.hypernym_closure(lex.synsets, lex.pointers))
    return _joined_ways(lexicon.shortest_hypernym_path(_name_pairs(spark, sf), lex.pointers, up))


@register(f"""{_GOODS}, {_NAME_PAIRS}, {lx.NEAREST}, {lx.WALKS}, {lx.MEASURE_ROWS}
SELECT a AS "left", b AS "right", round(path, 6) AS path, {_SEVEN} FROM measures""")
def goods_similarity(spark, sf):
    """Eight measures in a taxonomy with several parents, antonyms and part relations."""
    found = lexicon.synset_similarity(_name_pairs(spark, sf), _goods(spark, sf))
    for m in ("path", "hso", "jcn", "lch", "lin", "res", "wup", "lesk"):
        found = _rounded(found, m)
    return found


def _asked(spec: str) -> str:
    """``word``: the words of a list ``(v, t)``, and its values of one word as they are."""
    return (
        f"SELECT unnest(t) AS word FROM ({spec}) WHERE v IS NOT NULL UNION SELECT v FROM ({spec}) WHERE v IS NOT NULL AND len(t) <= 1"
    )


def _name_list(spec: list, value: str = q.ending("p")) -> str:
    return f"SELECT v, {q.camel('c')} AS t FROM (SELECT v, {q.clean('v')} AS c FROM (SELECT DISTINCT {value} AS v FROM ({g.sql(spec)})))"


def _object_list(spec: list) -> str:
    return f"SELECT v, {q.value_tokens('v')} AS t FROM (SELECT DISTINCT {q.comparable('o')} AS v FROM ({g.sql(spec)})) WHERE v IS NOT NULL"


def _nonempty(*queries: str) -> str:
    return f"SELECT word FROM ({' UNION '.join(queries)}) WHERE word <> ''"


def _lexical(a: str, b: str, word: float, names: bool, keys: tuple[str, ...] = (), tag: str = "") -> str:
    """``sc{tag} (keys, v1, v2, score)``: all pairs of the tables ``a`` and ``b`` ``(keys, v, t)``, by ``ws`` and equal words."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys) or "true"
    cols = "".join(f"a.{k}, " for k in keys)
    several = "len(a.t) > 1 OR len(b.t) > 1" if names else "len(a.t) > 1 AND len(b.t) > 1"
    blank = "" if names else "WHEN a.t = [''] OR b.t = [''] THEN 0.0 "
    same = "".join(f" AND h.{k} = a.{k}" for k in keys)
    return f"""near{tag} AS MATERIALIZED (SELECT x, y FROM (SELECT DISTINCT unnest(t) AS x FROM {a}), (SELECT DISTINCT unnest(t) AS y FROM {b}) WHERE x <> '' AND lower(x) = lower(y)
  UNION SELECT x, y FROM ws WHERE sim >= {word} AND lower(x) <> lower(y)),
hits{tag} AS MATERIALIZED (SELECT {cols}a.v AS v1, b.v AS v2, count(*) AS hits FROM (SELECT *, unnest(t) AS x FROM {a}) a JOIN near{tag} n ON n.x = a.x
  JOIN (SELECT *, unnest(t) AS y FROM {b}) b ON b.y = n.y AND {on} GROUP BY ALL),
sc{tag} AS MATERIALIZED (SELECT {cols}a.v AS v1, b.v AS v2, CASE WHEN a.v <> '' AND lower(a.v) = lower(b.v) THEN 1.0 {blank}WHEN {several}
  THEN {q.ratio('coalesce(h.hits, 0)', 'len(a.t)', 'len(b.t)')} ELSE coalesce(ws.sim, 0.0) END AS score
  FROM {a} a JOIN {b} b ON {on} LEFT JOIN hits{tag} h ON h.v1 = a.v AND h.v2 = b.v{same} LEFT JOIN ws ON ws.x = a.v AND ws.y = b.v)"""


def _sims(spark, sf, t1, t2, threshold):
    return align.graph_sims(t1, t2, _goods(spark, sf), threshold)


_STORE_WORDS = lx.word_scores(
    _nonempty(_asked(_name_list(g.CATALOGUE)), _asked(_object_list(g.CATALOGUE))), _nonempty(_asked(_name_list(g.STORE)), _asked(_object_list(g.STORE))), q.stems
)


@register(f"{_GOODS}, {_STORE_WORDS} SELECT x, y, sim FROM ws WHERE sim >= 0.2 AND (lower(x) <> lower(y) OR (x, y) IN (SELECT x, y FROM best WHERE sim >= 0.2))")
def vocabulary_similarity(spark, sf):
    """Words of the catalogue and the store that the lexicon holds similar, out of the whole product."""
    return _sims(spark, sf, *graph(spark, sf, g.CATALOGUE, g.STORE), 0.2)


_STORE_NAMES = f"na AS MATERIALIZED ({_name_list(g.CATALOGUE)}), nb AS MATERIALIZED ({_name_list(g.STORE)})"
_STORE_PAIRS = f"""{_STORE_NAMES}, {_lexical('na', 'nb', 0.7, True)},
pp AS MATERIALIZED (SELECT x.p AS predicate1, y.p AS predicate2 FROM sc JOIN (SELECT DISTINCT p, {q.ending('p')} AS v FROM ({g.sql(g.CATALOGUE)})) x ON x.v = v1
  JOIN (SELECT DISTINCT p, {q.ending('p')} AS v FROM ({g.sql(g.STORE)})) y ON y.v = v2 WHERE score > 0.7)"""


@register(f"{_GOODS}, {_STORE_WORDS}, {_STORE_PAIRS} SELECT predicate1, predicate2 FROM pp")
def match_predicates_lexicon(spark, sf):
    """Predicates of the catalogue and the store, which names most of them by synonyms."""
    t1, t2 = graph(spark, sf, g.CATALOGUE, g.STORE)
    return predicates.match_predicates(t1, t2, sims=_sims(spark, sf, t1, t2, 0.5))


@register(f"""{_GOODS}, {lx.word_scores(_nonempty(_asked(_name_list(g.CATALOGUE, q.local_name('p')))), _nonempty(_asked(_name_list(g.STORE, q.local_name('p')))), q.stems)},
na AS MATERIALIZED ({_name_list(g.CATALOGUE, q.local_name('p'))}), nb AS MATERIALIZED ({_name_list(g.STORE, q.local_name('p'))}), {_lexical('na', 'nb', 0.2, True)}
SELECT v1 AS term1, v2 AS term2, round(score, 6) AS score, 1::BIGINT AS copies FROM sc WHERE score >= 0.4""")
def compare_predicates_lexicon(spark, sf):
    """Similar predicate names of the catalogue and the store, by similar words."""
    t1, t2 = graph(spark, sf, g.CATALOGUE, g.STORE)
    names = [t.select(terms.local_name("p").alias("v")).distinct() for t in (t1, t2)]
    sims = predicates.lexicon_sims(*names, _goods(spark, sf), 0.2, names=True)
    return _rounded(align.compare_predicates(t1, t2, sims))


@register(f"""{_GOODS}, va AS MATERIALIZED ({_value_list(g.CATALOGUE)}), vb AS MATERIALIZED ({_value_list(g.STORE)}),
{lx.word_scores(_nonempty(_asked('SELECT * FROM va')), _nonempty(_asked('SELECT * FROM vb')), q.stems)}, {_lexical('va', 'vb', 0.2, False)}
SELECT v1 AS term1, v2 AS term2, round(score, 6) AS score, 1::BIGINT AS copies FROM sc WHERE score >= 0.4""")
def compare_literals_lexicon(spark, sf):
    """Similar literals of the catalogue and the store, by similar words."""
    t1, t2 = graph(spark, sf, g.CATALOGUE, g.STORE)
    values = [t.filter(~terms.is_uri("o")).select(terms.lexical_form("o").alias("v")).distinct() for t in (t1, t2)]
    sims = predicates.lexicon_sims(*values, _goods(spark, sf), 0.2)
    return _rounded(align.compare_literals(t1, t2, sims))


_STORE_SIDES = _sides(g.CATALOGUE, g.STORE, pair_sql="SELECT predicate1, predicate2 FROM ppl")
_STORE_LEAVES = f"""{_STORE_PAIRS.replace('pp AS MATERIALIZED', 'ppl AS MATERIALIZED')}, {_STORE_SIDES},
va AS MATERIALIZED (SELECT p1, p2, v, {q.value_tokens('v')} AS t FROM (SELECT DISTINCT p1, p2, v FROM a)),
vb AS MATERIALIZED (SELECT p1, p2, v, {q.value_tokens('v')} AS t FROM (SELECT DISTINCT p1, p2, v FROM b)),
{_lexical('va', 'vb', 0.5, False, ('p1', 'p2'), 'v')}, vp AS MATERIALIZED (SELECT * FROM scv WHERE score > 0.7), {_MATCHES}"""


@register(f"{_GOODS}, {_STORE_WORDS}, {_STORE_LEAVES} SELECT s1, s2, round(score, 6) AS score FROM m")
def align_lexicon(spark, sf):
    """Entity matches between catalogue and store: predicates and values by similar words."""
    t1, t2 = (align.prepare(g.build(spark, sf, s)) for s in (g.CATALOGUE, g.STORE))
    return _rounded(align.align_entities(t1, t2, mode="lexical", sims=_sims(spark, sf, t1, t2, 0.5), skip_lowest=True))


@register(f"""{_GOODS}, r AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT p AS term FROM ({g.sql(g.CATALOGUE)} UNION ALL {g.sql(g.STORE)}))),
rv AS MATERIALIZED (SELECT term, id, {q.lower_ending('term')} AS v FROM r), na AS MATERIALIZED (SELECT v, {q.camel('c')} AS t FROM (SELECT v, {q.clean('v')} AS c FROM (SELECT DISTINCT v FROM rv))),
{lx.word_scores(_nonempty(_asked('SELECT * FROM na')), _nonempty(_asked('SELECT * FROM na')), q.stems)}, {_lexical('na', 'na', 0.5, True)}
SELECT x.term AS term1, x.id AS id1, y.term AS term2, y.id AS id2, round(score, 6) AS score FROM sc JOIN rv x ON x.v = v1 JOIN rv y ON y.v = v2 WHERE score > 0.5""")
def similar_relations_lexicon(spark, sf):
    """Similar relations inside the merged graph of catalogue and store, by similar words."""
    ids = encoding.relation_ids(encoding.merge_graphs(*graph(spark, sf, g.CATALOGUE, g.STORE)))
    names = ids.select(terms.lower_ending("term").alias("v")).distinct()
    sims = predicates.lexicon_sims(names, names, _goods(spark, sf), 0.5, names=True)
    return _rounded(predicates.similar_relations(ids, sims))


# --- small graphs whose block table is written out whole --------------------------------------------------------------

_BLOCK_ROWS = f"""bl AS MATERIALIZED (SELECT a.s AS s1, {q.literal_value('a.o')} AS literal1, b.s AS s2, {q.literal_value('b.o')} AS literal2, a.p AS p1, b.p AS p2
  FROM ({rows(g.LAND)}) a JOIN ({rows(g.PARTY)}) b ON {q.ending('a.p')} = {q.ending('b.p')}),
bt AS MATERIALIZED (SELECT *, {q.value_tokens('literal1')} AS t1, {q.value_tokens('literal2')} AS t2 FROM bl)"""


def _block_scores(mode: str) -> str:
    sim = {
        "string": q.literal_sim("literal1", "literal2", "t1", "t2", 0.7),
        "lexical": q.literal_sim("literal1", "literal2", "t1", "t2", 0.7, q.EQUAL_WORDS, "0.0"),
        "exact": "CASE WHEN literal1 = literal2 THEN 1.0 ELSE 0.0 END::DOUBLE",
    }[mode]
    return f"{_BLOCK_ROWS}, bs AS MATERIALIZED (SELECT * FROM (SELECT s1, s2, p1, p2, {sim} AS score FROM bt) WHERE score > 0.7)"


def _land_blocks(spark, sf):
    t1, t2 = graph(spark, sf, g.LAND, g.PARTY)
    return stored(blocking.block_by_predicate(t1, t2, align.predicate_pairs(t1, t2, exact=True)))


@register(f"WITH {_BLOCK_ROWS} SELECT * FROM bl")
def block_by_predicate(spark, sf):
    """The block table of countries and parties, a row per pair of values."""
    return _land_blocks(spark, sf)


def _score_blocks(mode: str) -> None:
    def query(spark, sf):
        return _rounded(matching.score_blocked(_land_blocks(spark, sf), mode))

    query.__name__ = f"score_blocks_{mode}"
    query.__doc__ = f"Scores of all similar values of a whole block table, {mode} mode."
    register(f"WITH {_block_scores(mode)} SELECT s1, s2, round(score, 6) AS score FROM bs")(query)


for _mode in ("string", "lexical", "exact"):
    _score_blocks(_mode)

_LAND_COUNTS = "bc AS MATERIALIZED (SELECT s1, s2, count(*) AS n FROM bl GROUP BY s1, s2), bp AS MATERIALIZED (SELECT s1, s2, count(DISTINCT p1 || p2) AS n FROM bl GROUP BY s1, s2)"


@register(f"WITH {_block_scores('string')}, {_LAND_COUNTS} SELECT s1, s2, round(sum(score) / any_value(n), 6) AS score FROM bs JOIN bc USING (s1, s2) GROUP BY s1, s2 HAVING sum(score) / any_value(n) > 0.7")
def aggregate_matches_cut(spark, sf):
    """Pairs whose score over all their value pairs is above the threshold, many are not."""
    blocks = _land_blocks(spark, sf)
    return _rounded(matching.aggregate_matches(matching.score_blocked(blocks), blocking.common_value_counts(blocks)))


@register(f"WITH {_block_scores('string')}, {_LAND_COUNTS} SELECT s1, s2, round(sum(score) / 3, 6) AS score FROM bs JOIN bp USING (s1, s2) WHERE n = 3 GROUP BY s1, s2 HAVING sum(score) / 3 > 0.8")
def aggregate_matches_level(spark, sf):
    """Pairs that share three predicates, at that level's threshold."""
    blocks = _land_blocks(spark, sf)
    level = matching.literals_of_cluster(blocks, blocking.common_predicate_counts(blocks), 3)
    return _rounded(matching.aggregate_matches_level(matching.score_blocked(level), 3))


@register(f"WITH {_block_scores('string')} SELECT s1, s2, round(max(score), 6) AS score FROM bs GROUP BY s1, s2")
def match_parents(spark, sf):
    """Pairs with one pair of similar values, together with what exact values gave before."""
    blocks = _land_blocks(spark, sf)
    return _rounded(matching.match_parents(blocks, matching.score_blocked(blocks, "exact")))


_NORMED = f"{_block_scores('string')}, nm AS MATERIALIZED (SELECT s1, s2, avg(score) AS score FROM bs GROUP BY s1, s2 HAVING avg(score) > 0.93)"


@register(f"WITH {_NORMED} SELECT s1, s2, round(score, 6) AS score FROM nm")
def match_parents_normed(spark, sf):
    """Pairs whose similar values have a mean score above the parent threshold."""
    blocks = _land_blocks(spark, sf)
    return _rounded(matching.match_parents(blocks, blocks.select("s1", "s2").limit(0).withColumn("score", F.lit(0.0)), "normed"))


_TRUE_LAND = f"SELECT {g.uri(g.A + '/nation/', g.num('s_nationkey'))} AS s1, {g.uri(g.B + '/party/', g.num('s_suppkey'))} AS s2 FROM supplier"


def _land_found(spark, sf):
    gold = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.expr(g.uri(g.A + "/nation/", g.num("s_nationkey"))).alias("s1"), F.expr(g.uri(g.B + "/party/", g.num("s_suppkey"))).alias("s2")
    )
    return gold, match_parents_normed(spark, sf)


@register(f"WITH {_NORMED}, f AS (SELECT s1, s2 FROM nm UNION SELECT s2, s1 FROM nm) SELECT * FROM ({_TRUE_LAND}) EXCEPT SELECT * FROM f")
def missed_pairs(spark, sf):
    """Parties' countries that normed matching misses."""
    return evaluate.missed_pairs(*_land_found(spark, sf))


@register(f"WITH {_NORMED}, f AS (SELECT s1, s2 FROM nm UNION SELECT s2, s1 FROM nm) SELECT * FROM f EXCEPT SELECT * FROM ({_TRUE_LAND})")
def extra_pairs(spark, sf):
    """What normed matching finds besides, in both directions."""
    return evaluate.extra_pairs(*_land_found(spark, sf))


@register(f"WITH {_NORMED} SELECT s1, s2, round(score, 6) AS score FROM nm")
def matches_from_files(spark, sf):
    """Matches written as text and read back."""
    path = new_path(spark, "files")
    tables.write_matches(match_parents_normed(spark, sf), path)
    return spark.read.schema("s1 string, s2 string, score double").csv(path)


@register(f"SELECT DISTINCT * FROM ({_TRUE_LAND})")
def alignment_from_files(spark, sf):
    """An alignment in three columns, written and read."""
    path = new_path(spark, "files")
    gold, _ = _land_found(spark, sf)
    gold.select(F.concat_ws(" ", "s1", "s2", F.lit("1.0"))).write.text(path)
    return tables.read_alignment(spark, path)


@register(f"SELECT p, count(*) AS triples FROM ({rows(g.CATALOGUE)}) GROUP BY p")
def histogram_from_files(spark, sf):
    """Predicate counts written sorted and read back."""
    path = new_path(spark, "files")
    tables.write_predicate_histogram(*graph(spark, sf, g.CATALOGUE), path)
    return spark.read.schema("p string, triples bigint").csv(path, sep="\t")


@register(f"SELECT p, count(*) AS triples FROM ({rows(g.CATALOGUE)}) GROUP BY p ORDER BY triples DESC, p LIMIT 3")
def top_predicates(spark, sf):
    """The three most frequent predicates, a preview of the sorted counts."""
    return filters.preview(predicate_histogram(*graph(spark, sf, g.CATALOGUE)), 3)


@register(f"SELECT s, p, o FROM ({rows(g.CATALOGUE)})")
def random_parts(spark, sf):
    """A random split in four parts, which together are the graph."""
    return reduce(DataFrame.unionByName, filters.random_split(stored(graph(spark, sf, g.CATALOGUE)[0]), 4))


@register(f"WITH {_CODES} SELECT p_id::DOUBLE AS value FROM x WHERE s_id = (SELECT max(s_id) FROM x) AND o_id = (SELECT max(o_id) FROM x WHERE s_id = (SELECT max(s_id) FROM x))")
def matrix_cell(spark, sf):
    """The last entry of the last matrix row."""
    entries = stored(encoding.adjacency_entries(_encoded(spark, sf)[0]))
    last = entries.agg(F.max(F.struct("i", "j")).alias("e"))
    return encoding.matrix_cell(entries, last.select("e.i").scalar(), last.select("e.j").scalar())


_VALUE_PAIRS = [
    ("p_name", "p_name || 's'"), ("'<' || p_type", "'<' || lower(p_type)"), ("'<' || p_type", "p_type"), ("'<' || replace(p_name, ' ', '-')", "'<' || p_name"),
    ("'<' || p_name", "'<' || p_name || ' ' || p_type"), ("p_brand || ' ' || p_name", "p_name || ' ' || p_type"), ("'<'", "'<' || p_type"), ("p_name", "''"),
]


@register(f"""WITH p AS ({' UNION '.join(f'SELECT {a} AS v1, {b} AS v2 FROM part' for a, b in _VALUE_PAIRS)}),
e AS (SELECT v1, v2, v1[1] = '<' AS m1, v2[1] = '<' AS m2, v1[2:] AS e1, v2[2:] AS e2 FROM p),
n AS (SELECT *, {q.value_tokens('v1')} AS t1, {q.value_tokens('v2')} AS t2, {q.camel('c1')} AS n1, {q.camel('c2')} AS n2 FROM (SELECT *, {q.clean('e1')} AS c1, {q.clean('e2')} AS c2 FROM e)),
s AS (SELECT *, CASE WHEN e1 = '' OR e2 = '' THEN 0.0 ELSE {q.name_sim('e1', 'e2', 'n1', 'n2')} END AS named FROM n)
SELECT v1, v2, round(CASE WHEN m1 AND m2 THEN CASE WHEN named > 0.5 THEN 0.7 ELSE named END WHEN m1 <> m2 THEN 0.0 ELSE {q.literal_sim('v1', 'v2', 't1', 't2', 0.7)} END, 6) AS score FROM s""")
def value_scores(spark, sf):
    """Similarity of comparable values: names for URI endings, words and edits for literals."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    pairs = F.array(*[F.struct(F.expr(a).alias("v1"), F.expr(b).alias("v2")) for a, b in _VALUE_PAIRS])
    return _rounded(predicates.value_scores(part.select(F.inline(pairs)), Thresholds.from_string(0.7)))


@register(f"""WITH {_names(g.CATALOGUE, 1, q.local_name('p'))}, {_names(g.SHOP, 2, q.local_name('p'))}
SELECT DISTINCT n1.v AS v1, n2.v AS v2 FROM n1 CROSS JOIN n2 WHERE {q.name_sim('n1.v', 'n2.v', 'n1.t', 'n2.t')} > 0.3""")
def predicates_equal(spark, sf):
    """Pairs of predicate names that count as equal, out of given pairs."""
    names = [t.select(terms.local_name("p").alias(f"v{n}")).distinct() for n, t in enumerate(graph(spark, sf, g.CATALOGUE, g.SHOP), 1)]
    return predicates.predicates_equal(names[0].join(names[1]), 0.3)


@register("WITH s AS (" + q.stems("SELECT DISTINCT unnest(string_split(p_name || 's', ' ')) AS word FROM part") + """)
SELECT p_partkey, s.word, stem FROM (SELECT p_partkey, unnest(string_split(p_name || 's', ' ')) AS word FROM part) p JOIN s ON s.word = p.word""")
def stemmed_words(spark, sf):
    """The words of part names with their stems, each stemmed once."""
    words = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.explode(F.split(F.expr("p_name || 's'"), " ")).alias("word"))
    return lexicon.with_stems(words, "word")


# compounds of the lexicon: two words of a name, and a name with its type
_COMPOUNDS = """c AS (SELECT DISTINCT replace(p_name, ' ', '_') AS lemma, 2 AS n, p_name AS plain FROM part
  UNION SELECT DISTINCT replace(p_name, ' ', '-') || ' ' || lower(p_type), 3, p_name || ' ' || lower(p_type) FROM part WHERE p_size <= 10)"""
_INFLECTED = [
    "split_part(p_name, ' ', 1) || '-' || split_part(p_name, ' ', 2) || 's'", "upper(p_name) || 's ' || lower(p_type) || 's'",
    "'very ' || split_part(p_name, ' ', 1) || 's ' || split_part(p_name, ' ', 2) || 's indeed'", "split_part(p_name, ' ', 2) || 's ' || split_part(p_name, ' ', 1)",
]


@register(f"""WITH {_COMPOUNDS}, t AS ({' UNION '.join(f'SELECT {e} AS term FROM part' for e in _INFLECTED)}),
w AS (SELECT term, regexp_split_to_array(lower(term), '[ _-]+') AS w FROM t), cw AS (SELECT lemma, n, string_split(plain, ' ') AS p FROM c),
f AS (SELECT term, lemma, n, i, list_sum(list_transform(range(1, n + 1), lambda k: CASE WHEN w[i + k] = p[k] THEN 0 ELSE 2 END)) AS ranks
  FROM w, cw, range(0, 4) t(i) WHERE i + n <= len(w) AND list_bool_and(list_transform(range(1, n + 1), lambda k: w[i + k] IN (p[k], p[k] || 's'))))
SELECT term, lemma AS base FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, i, ranks, lemma) AS turn FROM f) WHERE turn = 1""")
def compound_base_form(spark, sf):
    """Dictionary forms of inflected compounds of two and three words, inside longer terms too."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    two = part.select(F.expr("replace(p_name, ' ', '_')").alias("lemma"))
    three = part.filter("p_size <= 10").select(F.expr("replace(p_name, ' ', '-') || ' ' || lower(p_type)").alias("lemma"))
    senses = stored(two.unionByName(three).distinct()).select("lemma", F.lit("noun").alias("pos"))
    terms_ = part.select(F.explode(F.array(*[F.expr(e) for e in _INFLECTED])).alias("term"))
    return lexicon.base_form(terms_, senses)
