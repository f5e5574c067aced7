"""RDF terms as Column expressions (no Python on the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of RDF terms.
_LAST_SEGMENT = r"^<(?:[^<>]*/)?([^<>/]+?)(?: \.)?/*(?:[<>]|$)"
# runs of plain text with escapes between; the runs give nothing back, so that long texts need no deep recursion
_QUOTED = r'(?s)^"([^"\\]*+(?:\\.[^"\\]*+)*+)'
_ONLY_QUOTES = r'^"+$'
_LOCAL_NAME = r"([\p{L}_][\p{L}\p{N}_.\-]*)>?$"
_FULL_LITERAL = r'(?s)^"(.*)"(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?$'
_LANG = r'"@([A-Za-z0-9\-]+)$'
_DATATYPE = r'"\^\^<([^>]*)>$'

# Escapes of one letter, and the pieces of an escaped text: plain runs, runs of 16-bit code units that are
# whole characters, single code points, escapes of one letter, and whatever backslash is left.
_LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_UNIT = r"\\u(?:[0-9A-CE-Fa-ce-f][0-9A-Fa-f]{3}|[Dd][0-7][0-9A-Fa-f]{2}|[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2})"
_POINT = r"\\U00(?:0[1-9A-Fa-f]|10|00(?![Dd][89A-Fa-f]))[0-9A-Fa-f]{4}"
_PIECES = rf"([^\\]++|(?:{_UNIT})++|{_POINT}|(?s:\\.)|\\)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_uri(c: Column | str) -> Column:
    """True for a term written in angle brackets."""
    return _col(c).startswith("<")


def uri_ending(c: Column | str, hash: bool = True) -> Column:
    """Last path segment of a URI; with ``hash`` the part behind ``#`` inside it. Null for literals."""
    segment = F.nullif(F.regexp_extract(_col(c), _LAST_SEGMENT, 1), F.lit(""))
    if not hash:
        return segment
    fragment = F.nullif(F.get(F.split(segment, "#"), F.lit(1)), F.lit(""))
    return F.when(segment.contains("#"), fragment).otherwise(segment)


def lower_ending(c: Column | str) -> Column:
    """Lower-case text behind the last slash, brackets removed (relation names of a merged graph)."""
    bare = F.btrim(_col(c), F.lit("<>"))
    return F.lower(F.element_at(F.split(F.rtrim(bare, F.lit("/")), "/"), -1))


def local_name(c: Column | str) -> Column:
    """XML local name of a URI: the longest name-like ending."""
    return F.regexp_extract(_col(c), _LOCAL_NAME, 1)


def literal_value(c: Column | str) -> Column:
    """Text of a literal: between its quotes, escapes resolved, or the bare text. Null for URIs and empty text."""
    c = _col(c)
    return (
        F.when(c.isNull() | (c == "") | is_uri(c), F.lit(None).cast("string"))
        .when(c.startswith('"') & ~c.rlike(_ONLY_QUOTES), unescape(F.regexp_extract(c, _QUOTED, 1)))
        .otherwise(c)
    )


def literal_or_ending(c: Column | str) -> Column:
    """Literal text, or the last segment when the term is a URI."""
    c = _col(c)
    return F.when(is_uri(c), uri_ending(c, hash=False)).otherwise(literal_value(c))


def comparable_value(c: Column | str) -> Column:
    """Value used for comparison: literal text, or ``<`` followed by the URI ending."""
    c = _col(c)
    return F.when(is_uri(c), F.concat(F.lit("<"), uri_ending(c))).otherwise(literal_value(c))


def term_kind(c: Column | str) -> Column:
    """``uri``, ``bnode`` or ``literal``."""
    c = _col(c)
    return (
        F.when(is_uri(c), F.lit("uri"))
        .when(c.startswith("_:"), F.lit("bnode"))
        .otherwise(F.lit("literal"))
    )


def unescape(c: Column | str) -> Column:
    """Resolves the escapes of N-Triples piece by piece; a backslash that begins none stays as it is.

    A surrogate without its other half is no character and stays escaped.
    """
    c = _col(c)

    def resolved(piece: Column) -> Column:
        units = F.decode(F.unhex(F.replace(piece, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        point = F.decode(F.unhex(F.substring(piece, 3, 8)), "UTF-32")
        letter = F.create_map(*[F.lit(x) for pair in _LETTERS.items() for x in pair])[F.substring(piece, 2, 1)]
        return (
            F.when(~piece.startswith("\\"), piece)
            .when(piece.rlike(f"^{_UNIT}"), units)
            .when(piece.rlike(f"^{_POINT}$"), point)
            .otherwise(F.coalesce(letter, piece))
        )

    pieces = F.regexp_extract_all(c, F.lit(_PIECES), F.lit(1))
    return F.when(c.contains("\\"), F.array_join(F.transform(pieces, resolved), "")).otherwise(c)


def lexical_form(c: Column | str) -> Column:
    """Unescaped text of a quoted literal without language tag or datatype."""
    c = _col(c)
    return F.when(c.startswith('"'), unescape(F.regexp_extract(c, _FULL_LITERAL, 1))).otherwise(c)


def language(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), _LANG, 1), F.lit(""))


def datatype(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), _DATATYPE, 1), F.lit(""))
