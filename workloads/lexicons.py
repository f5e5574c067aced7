"""A lexicon made from the driver's tables: places and trading parties as a taxonomy, trade as frequency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleweave.operators.lexicon import Lexicon

# table, key, name, gloss, (parent prefix, parent key)
_NODES = [
    ("region", "r", "r_regionkey", "r_name", "'part of the world; \"a region\"'", None),
    ("nation", "n", "n_nationkey", "n_name", "'country in region ' || cast(n_regionkey as string)", ("r", "n_regionkey")),
    ("customer", "c", "c_custkey", "c_name",
     "'party buying for ' || lower(c_mktsegment) || ' in country ' || cast(c_nationkey as string) || '; \"buys parts\"; by order'",
     ("n", "c_nationkey")),
    ("supplier", "s", "s_suppkey", "s_name",
     "'party selling in country ' || cast(s_nationkey as string) || '; \"sells parts\"; \"ships\"'", ("n", "s_nationkey")),
]


def _id(prefix: str, key: str) -> str:
    return f"'{prefix}' || cast({key} as string)"


def tables(spark: SparkSession, sf: str) -> Lexicon:
    synsets = pointers = None
    for table, prefix, key, name, gloss, parent in _NODES:
        rows = spark.read.parquet(f"{sf}/{table}.parquet")
        part = rows.select(
            F.expr(_id(prefix, key)).alias("synset"), F.lit("noun").alias("pos"),
            F.expr(f"array(lower({name}), {_id(prefix, key)})").alias("lemmas"), F.expr(gloss).alias("gloss"),
        )
        synsets = part if synsets is None else synsets.unionByName(part)
        if parent is not None:
            edge = rows.select(F.expr(_id(prefix, key)).alias("low"), F.expr(_id(*parent)).alias("high"))
            both = edge.select(F.inline(F.array(
                F.struct(F.col("low").alias("src"), F.lit("hypernym").alias("ptr_type"), F.col("high").alias("dst")),
                F.struct(F.col("high").alias("src"), F.lit("hyponym").alias("ptr_type"), F.col("low").alias("dst")),
            )))
            pointers = both if pointers is None else pointers.unionByName(both)
    senses = synsets.select(
        F.get("lemmas", F.lit(0)).alias("lemma"), "pos", F.lit(1).alias("sense_no"), "synset"
    )
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.expr(_id("c", "o_custkey")).alias("synset"))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr(_id("s", "l_suppkey")).alias("synset"))
    freq = orders.unionByName(lines).groupBy("synset").agg(F.count(F.lit(1)).alias("count"))
    return Lexicon(senses, synsets, pointers, freq)


def trading_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and the suppliers of their order lines."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        F.expr(_id("c", "o_custkey")).alias("left"), F.expr(_id("s", "l_suppkey")).alias("right")
    ).distinct()


SQL = """nodes AS (""" + " UNION ALL ".join(
    f"SELECT {_id(p, k)} AS synset, lower({n}) AS name, {gl} AS gloss FROM {t}" for t, p, k, n, gl, _ in _NODES
) + """), edges AS (""" + " UNION ALL ".join(
    f"SELECT {_id(p, k)} AS low, {_id(*up)} AS high FROM {t}" for t, p, k, _, _, up in _NODES if up
) + """), freq AS (SELECT synset, count(*) AS c FROM (SELECT 'c' || o_custkey AS synset FROM orders UNION ALL SELECT 's' || l_suppkey FROM lineitem) GROUP BY synset),
paths AS (SELECT synset, [synset] AS path FROM nodes UNION ALL SELECT synset, list_append(path, high) FROM paths JOIN edges ON path[-1] = low),
up AS MATERIALIZED (SELECT synset, path[-1] AS ancestor, len(path) - 1 AS distance FROM paths),
depth AS MATERIALIZED (SELECT synset, max(distance) AS d FROM up GROUP BY synset),
ptr AS (SELECT low AS src, 'hypernym' AS t, high AS dst FROM edges UNION ALL SELECT high, 'hyponym', low FROM edges),
full_paths AS MATERIALIZED (SELECT p.synset, path FROM paths p JOIN depth USING (synset) WHERE len(path) - 1 = d),
tot AS (SELECT ancestor AS synset, sum(c) AS total FROM up JOIN freq USING (synset) GROUP BY ancestor),
ic AS MATERIALIZED (SELECT f.synset, greatest(0.0, -ln(a.total / r.total)) AS ic, r.total AS root_freq FROM full_paths f
  JOIN tot a ON a.synset = f.synset JOIN tot r ON r.synset = f.path[-1])"""

_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(list_filter(string_split(rtrim({g}, ';'), ';'), lambda x: NOT (trim(x) LIKE '\"%\"')), ';')), '[^a-z0-9]+'), lambda w: w <> ''))"

# Relation scores by writing out all ways of up to five steps from every left end, one letter per step.
WALKS = """steps AS MATERIALIZED (SELECT DISTINCT src, 'u' AS c, dst FROM ptr WHERE t IN ('hypernym', 'part_meronym', 'substance_meronym')
  UNION SELECT dst, 'u', src FROM ptr WHERE t IN ('hyponym', 'part_holonym', 'substance_holonym')
  UNION SELECT dst, 'd', src FROM ptr WHERE t IN ('hypernym', 'part_meronym', 'substance_meronym')
  UNION SELECT src, 'd', dst FROM ptr WHERE t IN ('hyponym', 'part_holonym', 'substance_holonym')
  UNION SELECT src, 'h', dst FROM ptr WHERE t = 'antonym' UNION SELECT dst, 'h', src FROM ptr WHERE t = 'antonym'),
walks(src, node, word) AS (SELECT DISTINCT a, a, '' FROM pairs UNION SELECT w.src, s.dst, w.word || s.c FROM walks w JOIN steps s ON s.src = w.node
  WHERE length(w.word) < 5 AND regexp_full_match(w.word || s.c, 'u*h*d*|d+h*')),
hso AS MATERIALIZED (SELECT a, b, max(CASE WHEN a = b THEN 16.0 ELSE 8.0 - length(word)
  - (contains(word, 'u')::INT + contains(word, 'h')::INT + contains(word, 'd')::INT - 1) END)::DOUBLE AS hso
  FROM walks JOIN pairs ON a = src AND b = node WHERE a = b OR word <> '' GROUP BY a, b)"""

MEASURE_ROWS = f"""measures AS MATERIALIZED (SELECT a, b, coalesce(1.0 / (len + 1), 0.0) AS path, coalesce(-ln((len + 1) / 40.0), 0.0) AS lch,
  coalesce(2.0 * (dc.d + 1) / (da.d + db.d + 2), 0.0) AS wup, coalesce(shared, 0.0) AS res,
  CASE WHEN ia.ic > 0 AND ib.ic > 0 THEN coalesce(2.0 * shared / (ia.ic + ib.ic), 0.0) ELSE 0.0 END AS lin,
  coalesce(CASE WHEN len IS NULL OR NOT (ia.ic > 0 AND ib.ic > 0) THEN 0.0 WHEN ia.ic + ib.ic - 2.0 * coalesce(shared, 0.0) <= 0
    THEN 1.0 / -ln((top - 0.01) / top) ELSE 1.0 / (ia.ic + ib.ic - 2.0 * coalesce(shared, 0.0)) END, 0.0) AS jcn,
  coalesce(len(list_intersect({_WORDS.format(g='na.gloss')}, {_WORDS.format(g='nb.gloss')})), 0)::DOUBLE AS lesk, greatest(0.0, coalesce(hso, 0.0)) AS hso
  FROM pairs LEFT JOIN lcs USING (a, b) LEFT JOIN hso USING (a, b) LEFT JOIN depth da ON da.synset = a LEFT JOIN depth db ON db.synset = b
  LEFT JOIN depth dc ON dc.synset = common LEFT JOIN ic ia ON ia.synset = a LEFT JOIN ic ib ON ib.synset = b
  LEFT JOIN nodes na ON na.synset = a LEFT JOIN nodes nb ON nb.synset = b),
mean AS MATERIALIZED (SELECT a, b, floor(((path + lch / 3.6888794541139363 + wup + res / 8.993171126404793 + jcn / 12876699.500047589 + lin
  + lesk / 19.0 + hso / 200.0) / 8.0) * 100.0 + 0.5) / 100.0 AS sim FROM measures)"""

# The nearest common ancestor gives the length (of equally near ones the deepest, then the first by name), the most
# informative one the information; in a tree they are the same.
NEAREST = """common AS MATERIALIZED (SELECT a, b, x.ancestor, x.distance + y.distance AS len FROM pairs JOIN up x ON x.synset = a
  JOIN up y ON y.synset = b AND x.ancestor = y.ancestor),
lcs AS MATERIALIZED (SELECT * FROM (SELECT a, b, ancestor AS common, min(len) OVER w AS len, max(ic) OVER w AS shared, max(root_freq) OVER w AS top,
  row_number() OVER (PARTITION BY a, b ORDER BY len, d DESC, ancestor) AS n FROM common JOIN depth ON depth.synset = ancestor LEFT JOIN ic ON ic.synset = ancestor
  WINDOW w AS (PARTITION BY a, b)) WHERE n = 1)"""

TRADING = "pairs AS MATERIALIZED (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
LOWEST = """lcs AS MATERIALIZED (SELECT a, b, arg_min(x.ancestor, y.distance) AS common FROM pairs JOIN up x ON x.synset = a
  JOIN up y ON y.synset = b AND x.ancestor = y.ancestor GROUP BY a, b)"""
MEASURES = ", ".join([SQL, TRADING, NEAREST, WALKS, MEASURE_ROWS])


# --- goods: words of part names below kinds and brands, with several parents and senses, verbs and antonyms -------------

# Names of properties, each with another word for it.
PROPERTIES = {"name": "label", "type": "kind", "price": "cost", "size": "extent", "brand": "make"}


def _property_rows() -> str:
    return ", ".join(f"('q:{a}', '{a}', '{b}')" for a, b in PROPERTIES.items())


def goods(spark: SparkSession, sf: str) -> Lexicon:
    """A lexicon made from parts and their sales.

    A word of a part name lies below the kind and the brand that it comes with most often; brands lie below kinds, so
    there are two ways up, of different length. Types are nouns (kinds; a second sense where a name word is equal) and
    verbs. Words of one length are antonyms in pairs. Names of properties have a synonym; name words have one too, the
    word written backwards.
    """
    part = spark.read.parquet(f"{sf}/part.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").join(part, F.col("l_partkey") == F.col("p_partkey"))
    words = part.select(F.explode(F.split("p_name", " ")).alias("w"), "p_type", "p_brand")

    def most(df: DataFrame, key: str, value: str) -> DataFrame:
        counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value))

    by_kind, by_brand = most(words, "w", "p_type"), most(words, "w", "p_brand")
    brand_kind = most(part, "p_brand", "p_type")
    kinds = part.select("p_type").distinct()
    properties = spark.sql(f"SELECT * FROM VALUES {_property_rows()} AS t(synset, a, b)")
    word, kind, brand, verb = ("'n:' || w", "'k:' || lower(p_type)", "'b:' || p_brand", "'v:' || lower(p_type)")
    name = "lower(replace(p_brand, '#', ''))"

    def rows(df: DataFrame, *columns: str) -> DataFrame:
        return df.selectExpr(*columns)

    shape = ("synset", "pos", "lemmas", "gloss")
    synsets = reduce(DataFrame.unionByName, [
        rows(by_kind, word, "'noun'", "array(w, reverse(w))", "'thing of kind ' || lower(p_type) || '; \"a ' || w || '\"'").toDF(*shape),
        rows(kinds, kind, "'noun'", "array(lower(p_type))", "'kind of goods for sale as ' || lower(p_type)").toDF(*shape),
        rows(brand_kind, brand, "'noun'", f"array({name})", "'brand of goods for sale as ' || lower(p_type)").toDF(*shape),
        rows(kinds, verb, "'verb'", "array(lower(p_type))", "'sell goods as ' || lower(p_type)").toDF(*shape),
        rows(properties, "synset", "'noun'", "array(a, b)", "'property of goods; \"the ' || a || '\"'").toDF(*shape),
        spark.sql("""SELECT * FROM VALUES ('goods', 'noun', array('good', 'part', 'item'), 'goods for sale'),
          ('q:property', 'noun', array('property'), 'what goods have'), ('v:sell', 'verb', array('sell'), 'give goods for money') AS t""").toDF(*shape),
    ])
    up = reduce(DataFrame.unionByName, [
        rows(by_kind, f"{word} AS src", f"{kind} AS dst"), rows(by_brand, f"{word} AS src", f"{brand} AS dst"),
        rows(brand_kind, f"{brand} AS src", f"{kind} AS dst"), rows(kinds, f"{kind} AS src", "'goods' AS dst"),
        rows(kinds, f"{verb} AS src", "'v:sell' AS dst"), rows(properties, "synset AS src", "'q:property' AS dst"),
        spark.sql("SELECT 'q:property' AS src, 'goods' AS dst"),
    ])
    ordered = by_kind.select("w", F.row_number().over(Window.partitionBy(F.length("w")).orderBy("w")).alias("n"))
    odd = ordered.filter("n % 2 = 1").select(F.col("w").alias("a"), F.length("w").alias("l"), "n")
    even = ordered.filter("n % 2 = 0").select(F.col("w").alias("b"), F.length("w").alias("l"), (F.col("n") - 1).alias("n"))
    pointers = reduce(DataFrame.unionByName, [
        up.selectExpr("src", "'hypernym' AS ptr_type", "dst"), up.selectExpr("dst AS src", "'hyponym' AS ptr_type", "src AS dst"),
        rows(odd.join(even, ["l", "n"]), "'n:' || a AS src", "'antonym' AS ptr_type", "'n:' || b AS dst"),
        rows(kinds, f"{kind} AS src", "'part_holonym' AS ptr_type", "'q:type' AS dst"),
        rows(brand_kind, f"{brand} AS src", "'part_meronym' AS ptr_type", "'q:brand' AS dst"),
        rows(kinds, f"{verb} AS src", "'entailment' AS ptr_type", "'v:sell' AS dst"),
    ])
    listed = synsets.select("synset", "pos", F.posexplode("lemmas").alias("place", "lemma"))
    turn = Window.partitionBy("lemma", "pos").orderBy(F.substring("synset", 1, 2).isin("n:", "q:").desc(), "synset")
    senses = listed.select("lemma", "pos", F.row_number().over(turn).alias("sense_no"), "synset")
    sold = lines.select(F.explode(F.split("p_name", " ")).alias("w"), "l_quantity")
    amount = F.sum("l_quantity").cast("bigint").alias("count")
    freq = sold.groupBy(F.expr(word).alias("synset")).agg(amount)
    freq = freq.unionByName(lines.groupBy(F.expr(brand).alias("synset")).agg(amount))
    freq = freq.unionByName(lines.groupBy(F.expr(verb).alias("synset")).agg(amount))
    total = lines.agg(amount).scalar()
    return Lexicon(senses, synsets, pointers, freq.unionByName(properties.select("synset", total.alias("count"))))


def _most(table: str, key: str, value: str) -> str:
    return (
        f"SELECT {key}, {value} FROM (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {value}) AS turn "
        f"FROM {table} GROUP BY {key}, {value}) WHERE turn = 1"
    )


GOODS = f"""words AS MATERIALIZED (SELECT unnest(string_split(p_name, ' ')) AS w, p_type, p_brand FROM part),
by_kind AS MATERIALIZED ({_most('words', 'w', 'p_type')}), by_brand AS MATERIALIZED ({_most('words', 'w', 'p_brand')}),
brand_kind AS MATERIALIZED ({_most('part', 'p_brand', 'p_type')}), kinds AS (SELECT DISTINCT p_type FROM part),
props AS (SELECT * FROM (VALUES {_property_rows()}) t(synset, a, b)),
nodes AS MATERIALIZED (SELECT 'n:' || w AS synset, 'noun' AS pos, [w, reverse(w)] AS lemmas, 'thing of kind ' || lower(p_type) || '; "a ' || w || '"' AS gloss FROM by_kind
  UNION ALL SELECT 'k:' || lower(p_type), 'noun', [lower(p_type)], 'kind of goods for sale as ' || lower(p_type) FROM kinds
  UNION ALL SELECT 'b:' || p_brand, 'noun', [lower(replace(p_brand, '#', ''))], 'brand of goods for sale as ' || lower(p_type) FROM brand_kind
  UNION ALL SELECT 'v:' || lower(p_type), 'verb', [lower(p_type)], 'sell goods as ' || lower(p_type) FROM kinds
  UNION ALL SELECT synset, 'noun', [a, b], 'property of goods; "the ' || a || '"' FROM props
  UNION ALL SELECT * FROM (VALUES ('goods', 'noun', ['good', 'part', 'item'], 'goods for sale'), ('q:property', 'noun', ['property'], 'what goods have'),
    ('v:sell', 'verb', ['sell'], 'give goods for money'))),
edges AS MATERIALIZED (SELECT 'n:' || w AS low, 'k:' || lower(p_type) AS high FROM by_kind UNION SELECT 'n:' || w, 'b:' || p_brand FROM by_brand
  UNION SELECT 'b:' || p_brand, 'k:' || lower(p_type) FROM brand_kind UNION SELECT 'k:' || lower(p_type), 'goods' FROM kinds
  UNION SELECT 'v:' || lower(p_type), 'v:sell' FROM kinds UNION SELECT synset, 'q:property' FROM props UNION SELECT 'q:property', 'goods'),
ranked AS (SELECT w, length(w) AS l, row_number() OVER (PARTITION BY length(w) ORDER BY w) AS n FROM by_kind),
ptr AS MATERIALIZED (SELECT low AS src, 'hypernym' AS t, high AS dst FROM edges UNION ALL SELECT high, 'hyponym', low FROM edges
  UNION ALL SELECT 'n:' || x.w, 'antonym', 'n:' || y.w FROM ranked x JOIN ranked y ON x.l = y.l AND x.n % 2 = 1 AND y.n = x.n + 1
  UNION ALL SELECT 'k:' || lower(p_type), 'part_holonym', 'q:type' FROM kinds UNION ALL SELECT 'b:' || p_brand, 'part_meronym', 'q:brand' FROM brand_kind
  UNION ALL SELECT 'v:' || lower(p_type), 'entailment', 'v:sell' FROM kinds),
senses AS MATERIALIZED (SELECT lemma, pos, row_number() OVER (PARTITION BY lemma, pos ORDER BY CASE WHEN synset LIKE 'n:%' OR synset LIKE 'q:%' THEN 0 ELSE 1 END, synset) AS sense_no, synset
  FROM (SELECT synset, pos, unnest(lemmas) AS lemma FROM nodes)),
sold AS (SELECT p_name, p_brand, p_type, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
freq AS MATERIALIZED (SELECT 'n:' || w AS synset, sum(q)::BIGINT AS c FROM (SELECT unnest(string_split(p_name, ' ')) AS w, l_quantity AS q FROM sold) GROUP BY w
  UNION ALL SELECT 'b:' || p_brand, sum(l_quantity)::BIGINT FROM sold GROUP BY p_brand UNION ALL SELECT 'v:' || lower(p_type), sum(l_quantity)::BIGINT FROM sold GROUP BY p_type
  UNION ALL SELECT synset, (SELECT sum(l_quantity) FROM sold)::BIGINT FROM props),
ways(synset, ancestor, distance) AS (SELECT synset, synset, 0 FROM nodes UNION SELECT synset, high, distance + 1 FROM ways JOIN edges ON ancestor = low),
up AS MATERIALIZED (SELECT synset, ancestor, min(distance) AS distance FROM ways GROUP BY synset, ancestor),
depth AS MATERIALIZED (SELECT synset, min(distance) AS d FROM up WHERE ancestor NOT IN (SELECT low FROM edges) GROUP BY synset),
amounts AS MATERIALIZED (SELECT ancestor AS synset, sum(c) AS total FROM up JOIN freq USING (synset) GROUP BY ancestor),
ic AS MATERIALIZED (SELECT r.synset, greatest(0.0, -ln(a.total / b.total)) AS ic, b.total AS root_freq
  FROM (SELECT synset, ancestor, row_number() OVER (PARTITION BY synset ORDER BY distance DESC, ancestor) AS n FROM up) r
  JOIN amounts a ON a.synset = r.synset JOIN amounts b ON b.synset = r.ancestor WHERE n = 1 AND a.total > 0)"""


def word_scores(words1: str, words2: str, stems) -> str:
    """``ws (x, y, sim)`` of the whole product of two queries of a column ``word``, after the tables of a lexicon.

    ``stems`` writes the stemmer out for a query with a column ``word``.
    """
    return ", ".join([
        f"w1 AS MATERIALIZED (SELECT * FROM ({stems(f'SELECT DISTINCT word FROM ({words1})')}))",
        f"w2 AS MATERIALIZED (SELECT * FROM ({stems(f'SELECT DISTINCT word FROM ({words2})')}))",
        "f1 AS MATERIALIZED (SELECT word, pos, synset FROM w1 JOIN senses ON lemma = lower(stem) WHERE sense_no = 1 AND pos IN ('noun', 'verb'))",
        "f2 AS MATERIALIZED (SELECT word, pos, synset FROM w2 JOIN senses ON lemma = lower(stem) WHERE sense_no = 1 AND pos IN ('noun', 'verb'))",
        "pairs AS MATERIALIZED (SELECT DISTINCT f1.synset AS a, f2.synset AS b FROM f1 JOIN f2 USING (pos))",
        NEAREST, WALKS, MEASURE_ROWS,
        """best AS MATERIALIZED (SELECT f1.word AS x, f2.word AS y, max(sim) AS sim FROM f1 JOIN f2 USING (pos) JOIN mean ON a = f1.synset AND b = f2.synset GROUP BY ALL),
ws AS MATERIALIZED (SELECT w1.word AS x, w2.word AS y, CASE WHEN w1.word <> '' AND lower(w1.word) = lower(w2.word) THEN 1.0
  WHEN (length(w1.word) < 4 AND length(w2.word) < 4) OR length(w1.word) < 3 OR length(w2.word) < 3 THEN 0.0 ELSE coalesce(sim, 0.0) END AS sim
  FROM w1 CROSS JOIN w2 LEFT JOIN best ON x = w1.word AND y = w2.word)""",
    ])
