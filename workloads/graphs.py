"""The driver's relational tables as triples.

A graph is a list of ``(table, subject, [(predicate, object), ...])`` in SQL expressions that Spark and
DuckDB both read; an object expression that is null gives no statement. Each table is read once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.config import OWL_SAME_AS, RDF_TYPE
from tripleweave.operators.checkpoints import spread

A, B = "http://a.example", "http://b.example"


def text(e: str) -> str:
    return f"'\"' || {e} || '\"'"


def uri(prefix: str, e: str) -> str:
    return f"'<{prefix}' || {e} || '>'"


def num(e: str) -> str:
    return f"cast({e} as string)"


def code(e: str) -> str:
    return f"md5({num(e)})"


_PRICE = "cast(cast(round(p_retailprice * 100) as bigint) as string)"

# Parts as one site describes them ...
CATALOGUE = [
    ("part", uri(f"{A}/part/", num("p_partkey")), [
        (f"<{A}/prop#name>", f"case when p_size > 25 then {text('p_name')} || '@en' else {text('p_name')} end"),
        (f"<{A}/prop#brand>", f"case when p_size > 45 then null else {text('p_brand')} || '^^<http://www.w3.org/2001/XMLSchema#string>' end"),
        (f"<{A}/prop#partType>", text("p_type")),
        (f"<{A}/prop#size>", text(num("p_size"))),
        (f"<{A}/prop#price>", text(_PRICE)),
        (f"<{A}/prop#madeBy>", uri(f"{A}/brand/", "p_brand")),
        (RDF_TYPE, uri(f"{A}/class#", "p_type")),
        (f"<{A}/prop#partType>", f"case when p_type = 'PROMO' then {text('p_type')} else null end"),
    ]),
]

# ... and as another one does: opaque keys, plural names, lower-case types, other gaps.
SHOP = [
    ("part", uri(f"{B}/item/", code("p_partkey")), [
        (f"<{B}/vocab/name>", text("p_name || 's'")),
        (f"<{B}/vocab/Brand>", f"case when p_type = 'LARGE' then null else {text('p_brand')} end"),
        (f"<{B}/vocab/PartType>", f"case when p_size <= 3 then null else {text('lower(p_type)')} end"),
        (f"<{B}/vocab/itemSize>", text(num("p_size"))),
        (f"<{B}/vocab/price>", text(_PRICE)),
        (f"<{B}/vocab/MadeBy>", uri(f"{B}/brand/", "p_brand")),
        (RDF_TYPE, uri(f"{B}/kind#", "lower(p_type)")),
        (OWL_SAME_AS, f"case when p_size = 50 then {uri(f'{A}/part/', num('p_partkey'))} else null end"),
    ]),
]

# Customers, suppliers and places of one site; some customers carry no class.
GEO = [
    ("customer", uri(f"{A}/customer/", num("c_custkey")), [
        (f"<{A}/geo#name>", text("c_name")),
        (f"<{A}/geo#inNation>", uri(f"{A}/nation/", num("c_nationkey"))),
        (RDF_TYPE, f"case when c_acctbal < 0 then null else {uri(f'{A}/segment#', 'c_mktsegment')} end"),
        (OWL_SAME_AS, f"case when c_acctbal > 9000 then {uri(f'{B}/party/', num('c_custkey'))} else null end"),
    ]),
    ("supplier", uri(f"{A}/supplier/", num("s_suppkey")), [
        (f"<{A}/geo#name>", text("s_name")),
        (f"<{A}/geo#inNation>", uri(f"{A}/nation/", num("s_nationkey"))),
        (RDF_TYPE, f"'<{A}/segment#SUPPLIER>'"),
    ]),
    ("nation", uri(f"{A}/nation/", num("n_nationkey")), [
        (f"<{A}/geo#name>", text("n_name")),
        (f"<{A}/geo#inRegion>", uri(f"{A}/region/", num("n_regionkey"))),
    ]),
    ("region", uri(f"{A}/region/", num("r_regionkey")), [(f"<{A}/geo#name>", text("r_name"))]),
]


def _trade(host: str, account: str, placed: str) -> list:
    """Customers with a code both sites know, and their orders, which no literal identifies."""
    return [
        ("customer", uri(f"{host}/c/", code(f"'{host}' || {num('c_custkey')}")), [
            (f"<{host}/{account}>", text(code("c_name"))),
        ]),
        ("orders", uri(f"{host}/o/", code(f"'{host}' || {num('o_orderkey')}")), [
            (f"<{host}/{placed}>", uri(f"{host}/c/", code(f"'{host}' || {num('o_custkey')}"))),
        ]),
    ]


TRADE1 = _trade(A, "accountCode", "placedBy")
TRADE2 = _trade(B, "accountCode", "placedBy")


def build(spark: SparkSession, sf_dir: str, spec: list) -> DataFrame:
    """Triples ``(s, p, o)`` of a graph, duplicates included."""
    result = None
    for table, subject, facts in spec:
        rows = F.array(*[F.struct(F.lit(p).alias("p"), F.expr(o).alias("o")) for p, o in facts])
        known = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        used = [c for c in known.columns if any(re.search(rf"\b{c}\b", e) for e in (subject, *[o for _, o in facts]))]
        named = known.select(*used, F.expr(subject).alias("s"))
        triples = (  # a file's rows may come in few parts, and each becomes several triples; equal ones have equal subjects
            spread(named, "s", rows=known.count() * len(facts))
            .select("s", F.inline(rows))
            .filter(F.col("o").isNotNull())
        )
        result = triples if result is None else result.unionByName(triples)
    return result


def sql(spec: list) -> str:
    """The same triples as a DuckDB query."""
    parts = [
        f"SELECT {subject} AS s, '{p}' AS p, {o} AS o FROM {table} WHERE ({o}) IS NOT NULL"
        for table, subject, facts in spec
        for p, o in facts
    ]
    return " UNION ALL ".join(parts)


# A second edition of the catalogue under the same predicates.
EDITION = [
    ("part", uri(f"{B}/edition/", num("p_partkey")), [
        (f"<{A}/prop#name>", text("p_name")),
        (f"<{A}/prop#brand>", text("p_brand")),
        (f"<{A}/prop#partType>", text("p_type")),
        (f"<{A}/prop#size>", text(num("p_size"))),
        (f"<{A}/prop#price>", text(_PRICE)),
    ]),
]

_CELL = "http://knowledgeweb.semanticweb.org/heterogeneity/alignment#"

# An alignment in cell form: each supplier tied to its nation.
CELLS = [
    ("supplier", "'_:cell' || cast(s_suppkey as string)", [
        (f"<{_CELL}entity1>", uri(f"{A}/supplier/", num("s_suppkey"))),
        (f"<{_CELL}entity2>", uri(f"{A}/nation/", num("s_nationkey"))),
        (f"<{_CELL}measure>", "'\"1.0\"^^<http://www.w3.org/2001/XMLSchema#float>'"),
        (f"<{_CELL}relation>", "'\"=\"'"),
    ]),
]



def escaped(e: str) -> str:
    """A text with the escapes that statement lines need."""
    for plain, mark in (("chr(92)", "chr(92)"), ("chr(34)", "chr(34)"), ("chr(10)", "'n'"), ("chr(13)", "'r'")):
        e = f"replace({e}, {plain}, chr(92) || {mark})"
    return e


# Texts as literals with escapes: documents with their language, conversation turns with code points and a raw tab.
NOTES = [
    ("documents", uri(f"{A}/doc/", num("doc_id")), [(f"<{A}/note#text>", f"{text(escaped('text'))} || '@' || lang")]),
    ("conversations", uri(f"{B}/turn/", f"{num('conv_id')} || '-' || {num('turn')}"), [
        (f"<{B}/note#said>", text(f"replace({escaped('text')}, 'é', chr(92) || 'u00E9') || chr(9) || chr(92) || 'U0001F600' || chr(92) || 'ud83d' || chr(92) || 'uDE00'")),
    ]),
]

# What the literals of NOTES say, straight from the tables.
NOTES_SQL = f"""SELECT {NOTES[0][1]} AS s, '{NOTES[0][2][0][0]}' AS p, {NOTES[0][2][0][1]} AS o, text AS said, lang FROM documents WHERE ({NOTES[0][2][0][1]}) IS NOT NULL
UNION SELECT {NOTES[1][1]}, '{NOTES[1][2][0][0]}', {NOTES[1][2][0][1]}, text || chr(9) || '😀😀', NULL FROM conversations WHERE text IS NOT NULL"""

# Texts as literals: documents on one side, conversation turns on the other.
DOCUMENTS = [("documents", uri(f"{A}/doc/", num("doc_id")), [(f"<{A}/text#body>", text("replace(text, '\"', ' ')"))])]
TURNS = [
    ("conversations", uri(f"{B}/turn/", f"{num('conv_id')} || '-' || {num('turn')}"), [
        (f"<{B}/text#body>", text("replace(text, '\"', ' ')")),
    ]),
]

# A store that names things by other words: properties by a synonym, the second word of a name backwards.
STORE = [
    ("part", uri(f"{B}/good/", code(f"'store' || {num('p_partkey')}")), [
        (f"<{B}/store/label>", text("split_part(p_name, ' ', 1) || ' ' || reverse(split_part(p_name, ' ', 2))")),
        (f"<{B}/store/itemKind>", f"case when p_size <= 3 then null else {text('lower(p_type)')} end"),
        (f"<{B}/store/cost>", text(_PRICE)),
        (f"<{B}/store/extent>", text(num("p_size"))),
        (f"<{B}/store/make>", f"case when p_type = 'LARGE' then null else {text('p_brand')} end"),
    ]),
]

# Countries and regions, and parties that name their country: small enough to write the block table out.
LAND = [
    ("nation", uri(f"{A}/nation/", num("n_nationkey")), [
        (f"<{A}/land#name>", text("n_name")),
        (f"<{A}/land#key>", text(num("n_nationkey"))),
        (f"<{A}/land#label>", text(f"'nationnumber' || {num('n_nationkey')}")),
    ]),
    ("region", uri(f"{A}/region/", num("r_regionkey")), [(f"<{A}/land#name>", text("r_name"))]),
]
PARTY = [
    ("supplier", uri(f"{B}/party/", num("s_suppkey")), [
        (f"<{B}/party#name>", text("s_name")),
        (f"<{B}/party#key>", text(num("s_nationkey"))),
        (f"<{B}/party#key>", f"case when s_suppkey % 2 = 0 then {text(num('s_suppkey % 25'))} else null end"),
        (f"<{B}/party#label>", text(f"'nationnumber' || {num('s_nationkey')} || case when s_suppkey % 3 = 0 then 'x' else '' end")),
    ]),
]


def _chain(host: str, labels: str | None = None) -> list:
    """Regions with a code that both sites know; countries and parties that no literal identifies."""
    own = lambda kind, key: uri(f"{host}/{kind}/", code(f"'{host}{kind}' || {num(key)}"))
    region, nation = [(f"<{host}/regionCode>", text(code("r_name")))], [(f"<{host}/inRegion>", own("r", "n_regionkey"))]
    if labels is not None:  # a text that a region shares with its countries
        region.append((f"<{host}/label>", text(f"'regionlabel' || {num('r_regionkey')} || '{labels}'")))
        nation.append((f"<{host}/label>", text(f"'regionlabel' || {num('n_regionkey')} || '{labels}'")))
    return [
        ("region", own("r", "r_regionkey"), region),
        ("nation", own("n", "n_nationkey"), nation),
        ("supplier", own("s", "s_suppkey"), [(f"<{host}/inNation>", own("n", "s_nationkey"))]),
    ]


CHAIN1, CHAIN2 = _chain(A), _chain(B)
LABELLED1, LABELLED2 = _chain(A, ""), _chain(B, "x")
