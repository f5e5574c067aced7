"""DuckDB spellings of the term and text functions, for the oracle queries."""

from __future__ import annotations

PUNCT = r"[!-\-/:-@\[-`{-~]"


def ending(c: str, hash: bool = True) -> str:
    seg = f"nullif(regexp_extract({c}, '^<(?:[^<>]*/)?([^<>/]+?)(?: \\.)?/*(?:[<>]|$)', 1), '')"
    if not hash:
        return seg
    return f"(CASE WHEN contains({seg}, '#') THEN nullif(split_part({seg}, '#', 2), '') ELSE {seg} END)"


def lower_ending(c: str) -> str:
    return f"lower(string_split(rtrim(trim({c}, '<>'), '/'), '/')[-1])"


def local_name(c: str) -> str:
    return f"regexp_extract({c}, '([\\p{{L}}_][\\p{{L}}\\p{{N}}_.\\-]*)>?$', 1)"


def literal_value(c: str) -> str:
    return (
        f"(CASE WHEN {c} IS NULL OR {c} = '' OR {c} LIKE '<%' THEN NULL "
        f"WHEN {c} LIKE '\"%' AND NOT regexp_full_match({c}, '\"+') THEN regexp_extract({c}, '^\"([^\"]*)', 1) ELSE {c} END)"
    )


def comparable(c: str) -> str:
    return f"(CASE WHEN {c} LIKE '<%' THEN '<' || {ending(c)} ELSE {literal_value(c)} END)"


def literal_or_ending(c: str) -> str:
    return f"(CASE WHEN {c} LIKE '<%' THEN {ending(c, False)} ELSE {literal_value(c)} END)"


def clean(c: str) -> str:
    """Noise pieces become a mark, which then swallows the blanks behind it."""
    pieces = f"regexp_extract_all({c}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]')"
    marked = (
        f"array_to_string(list_transform({pieces}, lambda w: CASE WHEN regexp_full_match(w, '\\p{{L}}{{1,2}}') "
        f"OR regexp_full_match(w, '{PUNCT}') THEN chr(1) ELSE replace(w, '_', chr(1)) END), '')"
    )
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"trim(regexp_replace({marked}, '\\x01[ \\t\\n\\x0b\\f\\r]*', ' ', 'g'), {blanks})"


def value_tokens(c: str) -> str:
    return f"string_split({clean(c)}, ' ')"


def camel(c: str) -> str:
    """A blank before each character that begins a new word, then double blanks reduced twice."""

    def at(k: str) -> str:
        return f"substring({c}, i{k}, 1)"

    begins = (
        f"(i > 1 AND ((regexp_full_match({at('-1')}, '[A-Z]') AND regexp_full_match({at('')}, '[A-Z]') "
        f"AND regexp_full_match({at('+1')}, '[a-z]')) OR (regexp_full_match({at('-1')}, '(?s)[^A-Z]') "
        f"AND regexp_full_match({at('')}, '[A-Z]')) OR (regexp_full_match({at('-1')}, '[A-Za-z]') "
        f"AND regexp_full_match({at('')}, '(?s)[^A-Za-z]'))))"
    )
    joined = (
        f"array_to_string(list_transform(range(1, length({c}) + 1), lambda i: "
        f"CASE WHEN {begins} THEN ' ' || {at('')} ELSE {at('')} END), '')"
    )
    return f"string_split(rtrim(replace(replace({joined}, '  ', ' '), '  ', ' '), ' '), ' ')"


def edit_sim(a: str, b: str) -> str:
    return (
        f"(CASE WHEN length({a}) + length({b}) = 0 THEN 0.0 ELSE greatest(0.0, 2.0 * (least(length({a}), length({b})) "
        f"- levenshtein({a}, {b})) / (length({a}) + length({b}))) END)"
    )


def ratio(i: str, n1: str, n2: str) -> str:
    return f"(CASE WHEN {n1} + {n2} - {i} = 0 THEN 'inf'::DOUBLE ELSE {i} / ({n1} + {n2} - {i})::DOUBLE END)"


def hits(t1: str, t2: str, test: str) -> str:
    """Pairs ``x, y`` of two word lists that pass the test."""
    return f"list_sum(list_transform({t1}, lambda x: len(list_filter({t2}, lambda y: {test}))))"


def literal_sim(a: str, b: str, t1: str, t2: str, th: float, test: str | None = None, whole: str | None = None) -> str:
    test = test or f"{edit_sim('x', 'y')} >= {th}"
    whole = whole or edit_sim(a, b)
    return (
        f"(CASE WHEN {a} <> '' AND lower({a}) = lower({b}) THEN 1.0 WHEN {t1} = [''] OR {t2} = [''] THEN 0.0 "
        f"WHEN len({t1}) > 1 AND len({t2}) > 1 THEN {ratio(hits(t1, t2, test), f'len({t1})', f'len({t2})')} ELSE {whole} END)"
    )


EQUAL_WORDS = "x <> '' AND lower(x) = lower(y)"


def name_sim(a: str, b: str, t1: str, t2: str) -> str:
    """Predicate-name similarity without a lexicon."""
    return (
        f"(CASE WHEN {a} <> '' AND lower({a}) = lower({b}) THEN 1.0 WHEN len({t1}) > 1 OR len({t2}) > 1 "
        f"THEN {ratio(hits(t1, t2, EQUAL_WORDS), f'len({t1})', f'len({t2})')} ELSE 0.0 END)"
    )


# Suffixes and what replaces them in the second, third and fourth step, written out for the oracle.
SECOND_STEP = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ator": "ate", "ation": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD_STEP = {"icate": "ic", "alize": "al", "ative": "", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH_STEP = {
    "al": "", "ance": "", "ence": "", "or": "", "er": "e", "ic": "", "able": "", "ible": "", "ant": "", "ement": "",
    "ment": "", "ent": "", "ism": "", "ate": "", "iti": "", "ous": "", "ive": "", "ize": "",
}


def stems(words: str) -> str:
    """``(word, stem)`` for a query with a column ``word``: one step of the stemmer per subquery."""

    def m0(x: str) -> str:
        return f"regexp_matches({x}, '[aeiouy][^aeiouy]')"

    def m1(x: str) -> str:
        return f"regexp_matches({x}, '[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]')"

    def short_end(x: str) -> str:
        return f"regexp_matches({x}, '[^aeiouy][aeiouy][^aeiouywxY]$')"

    def double_end(x: str) -> str:
        return f"(length({x}) > 2 AND right({x}, 1) = left(right({x}, 2), 1) AND NOT regexp_matches(right({x}, 1), '[aeiouy]'))"

    def swap(table: dict[str, str], long_enough) -> str:
        cases = []
        for ending, new in table.items():
            part = f"left(w, length(w) - {len(ending)})"
            held = f"{part} || 'e'" if ending == "er" else part
            cases.append(f"WHEN w LIKE '%{ending}' THEN CASE WHEN {long_enough(f'({held})')} THEN {part} || '{new}' ELSE w END")
        return f"CASE WHEN length(w) < 3 THEN w {' '.join(cases)} ELSE w END"

    def repaired(x: str) -> str:
        return (
            f"CASE WHEN {x} LIKE '%at' OR {x} LIKE '%bl' OR {x} LIKE '%iz' THEN {x} || 'e' "
            f"WHEN {double_end(x)} AND right({x}, 1) NOT IN ('l', 's', 'z') THEN left({x}, length({x}) - 1) "
            f"WHEN {m0(x)} AND NOT {m1(x)} AND {short_end(x)} THEN {x} || 'e' ELSE {x} END"
        )

    def vowel(x: str) -> str:
        return f"regexp_matches({x}, '[aeiouy]')"

    ed, ing = "left(w, length(w) - 2)", "left(w, length(w) - 3)"
    steps = [
        "regexp_replace(regexp_replace(w, '([aeiou])y', '\\1Y', 'g'), '^y', 'Y')",
        f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {ed} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {m0(ing)} THEN left(w, length(w) - 1) ELSE w END "
        f"WHEN w LIKE '%ed' THEN CASE WHEN {vowel(ed)} THEN {repaired(f'({ed})')} ELSE w END "
        f"WHEN w LIKE '%ing' AND {vowel(ing)} THEN {repaired(f'({ing})')} ELSE w END",
        f"CASE WHEN w LIKE '%Y' OR (w LIKE '%y' AND {vowel('left(w, length(w) - 1)')}) THEN left(w, length(w) - 1) || 'i' ELSE w END",
        swap(SECOND_STEP, m0),
        swap(THIRD_STEP, m0),
        swap(FOURTH_STEP, m1),
        f"CASE WHEN length(w) >= 3 AND w LIKE '%e' AND ({m1('w')} OR ({m0('w')} AND NOT {short_end('left(w, length(w) - 1)')})) "
        "THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN length(w) >= 3 AND w LIKE '%l' AND {double_end('w')} AND {m1('w')} THEN left(w, length(w) - 1) ELSE w END",
    ]
    query = f"SELECT word, word AS w FROM ({words})"
    for step in steps:
        query = f"SELECT word, CASE WHEN length(word) < 3 THEN word ELSE {step} END AS w FROM ({query})"
    return f"SELECT word, w AS stem FROM ({query})"
