"""Thresholds and vocabulary shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# RDF vocabulary in N-Triples spelling.
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
OWL_SAME_AS = "<http://www.w3.org/2002/07/owl#sameAs>"
ALIGNMENT_NS = "http://knowledgeweb.semanticweb.org/heterogeneity/alignment#"

# Default cut-offs.
PREDICATE_THRESHOLD = 0.7  # predicate names, strict >
LITERAL_THRESHOLD = 0.7  # one pair of values, strict >
CARTESIAN_THRESHOLD = 0.4  # stand-alone term matching, inclusive >=
RELATION_THRESHOLD = 0.5  # relation names inside one merged graph, strict >
PARENT_THRESHOLD = 0.93  # mean value score of a neighbour pair, strict >
LEVEL_THRESHOLDS = {1: 0.95, 2: 0.90, 3: 0.80}  # by number of shared predicates
LEVEL_DEFAULT = 0.70

# Upper ends used to bring the lexicon measures to [0, 1].
MAX_LCH = 3.6888794541139363
MAX_RES = 8.993171126404793
MAX_JCN = 1.2876699500047589e7
MAX_LESK = 19.0
MAX_HSO = 200.0


@dataclass(frozen=True)
class Thresholds:
    """The string and lexicon cut-offs; the lexicon one sits 0.2 below the string one."""

    string: float
    lexical: float

    @classmethod
    def from_string(cls, value: float) -> Thresholds:
        return cls(value, value - 0.2)

    @classmethod
    def from_lexical(cls, value: float) -> Thresholds:
        return cls(value + 0.2, value)
