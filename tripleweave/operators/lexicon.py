"""A lexicon as tables: senses, relations between them, and similarity measures as joins.

``senses(lemma, pos, sense_no, synset)``, ``synsets(synset, pos, lemmas, gloss)``,
``pointers(src, ptr_type, dst)`` and ``freq(synset, count)`` are supplied by the caller. All sizes below
are bounded by the lexicon and by the distinct words compared, not by the triples they come from.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.config import MAX_HSO, MAX_JCN, MAX_LCH, MAX_LESK, MAX_RES
from tripleweave.functions.stem import stem
from tripleweave.operators.checkpoints import stored

# Pointer names, parts of speech in lookup order, endings of inflected forms.
HYPERNYM, HYPONYM, ANTONYM = "hypernym", "hyponym", "antonym"
PARTS_OF_SPEECH = ["noun", "verb", "adj", "adv"]
ENDINGS = {
    "noun": [("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"),
             ("ies", "y")],
    "verb": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "adj": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
}
_JOINTS = "[ _-]+"  # what joins the words of a compound
_UPWARD = ["hypernym", "part_meronym", "substance_meronym"]
_DOWNWARD = ["hyponym", "part_holonym", "substance_holonym"]
_SIDEWAYS = [ANTONYM]
_LCH_DEPTH = 20  # depth of the taxonomy in the Leacock-Chodorow measure
_JCN_GAP = 0.01  # frequency step that stands for the smallest distance in the Jiang-Conrath measure
_HSO_BASE, _HSO_SAME, _HSO_STEPS = 8, 16, 5
_WIDE = 1000  # most synsets on ways up that are held in one row
_FEW_WORDS = 3  # gloss words that taxonomy candidates may share; pairs that share more come from a join of their own


@dataclass(frozen=True)
class Lexicon:
    senses: DataFrame
    synsets: DataFrame
    pointers: DataFrame
    freq: DataFrame


# --- vocabulary ----------------------------------------------------------------------------------------


def stem_vocabulary(df: DataFrame, column: str) -> DataFrame:
    """``(word, stem)`` of the distinct words of a column."""
    return df.select(F.col(column).alias("word")).distinct().select("word", stem("word").alias("stem"))


def with_stems(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the stem of a word column, computed once per distinct word."""
    vocabulary = stem_vocabulary(df, column).select(F.col("word").alias("__word"), "stem")
    return df.join(vocabulary, df[column].eqNullSafe(vocabulary["__word"])).drop("__word")


def senses_of(terms: DataFrame, senses: DataFrame, pos: str | None = None, sense_no: int | None = None) -> DataFrame:
    """Senses ``(term, pos, sense_no, synset)`` of terms; unknown terms give no row."""
    wanted = senses
    if pos is not None:
        wanted = wanted.filter(F.col("pos") == pos)
    if sense_no is not None:
        wanted = wanted.filter(F.col("sense_no") == sense_no)
    return terms.select("term").join(wanted, F.lower("term") == F.col("lemma")).drop("lemma")


def lemmas_of(
    chosen: DataFrame, synsets: DataFrame, lemma: str | None = None, position: int | None = None
) -> DataFrame:
    """Words ``(synset, position, lemma)`` of synsets, all of them, the given one, or the one at a position from 0."""
    words = chosen.select("synset").join(synsets, "synset").select(
        "synset", F.posexplode("lemmas").alias("position", "lemma")
    )
    if lemma is not None:
        words = words.filter(F.col("lemma") == lemma)
    return words if position is None else words.filter(F.col("position") == position)


def related(chosen: DataFrame, pointers: DataFrame, ptr_type: str) -> DataFrame:
    """``(synset, related)`` over one kind of pointer."""
    edges = pointers.filter(F.col("ptr_type") == ptr_type).select(F.col("src").alias("synset"), F.col("dst").alias("related"))
    return chosen.select("synset").join(edges, "synset")


def gloss_parts(synsets: DataFrame) -> DataFrame:
    """``(synset, definition, examples)``: quoted parts of a gloss are examples, the rest defines."""
    parts = F.split(F.rtrim(F.col("gloss"), F.lit(";")), ";")

    def quoted(part: Column) -> Column:
        trimmed = F.trim(part)
        return (trimmed != "") & trimmed.startswith('"') & trimmed.endswith('"')

    return synsets.select(
        "synset",
        F.array_join(F.filter(parts, lambda p: ~quoted(p)), ";").alias("definition"),
        F.transform(F.filter(parts, quoted), lambda p: F.trim(p)).alias("examples"),
    )


def _forms(terms: DataFrame, kinds: list[str], exceptions: DataFrame | None) -> DataFrame:
    """``(term, pos_order, pos, rank, lemma)``: what a term may be a form of, likeliest first: itself, its entries in the
    exception table ``(pos, form, base)``, and what is left without an ending."""
    low = F.lower("term")
    forms = []
    for order, kind in enumerate(kinds):
        forms.append((order, kind, 0, F.lit(True), low))
        for rank, (ending, new) in enumerate(ENDINGS.get(kind, [])):
            cut = F.concat(F.expr(f"left(lower(term), length(term) - {len(ending)})"), F.lit(new))
            forms.append((order, kind, rank + 2, low.endswith(ending), cut))
    guesses = F.filter(
        F.array(*[
            F.struct(
                F.lit(order).alias("pos_order"), F.lit(kind).alias("pos"), F.lit(rank).alias("rank"),
                F.when(fits, form).alias("lemma"),
            )
            for order, kind, rank, fits, form in forms
        ]),
        lambda g: g["lemma"].isNotNull(),
    )
    distinct = terms.select("term").distinct()
    tried = distinct.select("term", F.inline(guesses))
    if exceptions is not None:
        orders = F.create_map(*[F.lit(x) for o, k in enumerate(kinds) for x in (k, o)])
        listed = distinct.join(exceptions.filter(F.col("pos").isin(kinds)), F.lower("term") == F.col("form"))
        tried = tried.unionByName(
            listed.select("term", orders[F.col("pos")].alias("pos_order"), "pos", F.lit(1).alias("rank"),
                          F.col("base").alias("lemma"))
        )
    return tried


def base_form(terms: DataFrame, senses: DataFrame, exceptions: DataFrame | None = None, pos: str | None = None) -> DataFrame:
    """Dictionary form ``(term, base)`` of inflected terms.

    The term itself counts first, then the exception table ``(pos, form, base)``, then forms with an
    ending taken off, if the lexicon knows them. Without ``pos`` the first part of speech with a form wins.
    A term of several words that has no form as a whole gets that of ``compound_form``.
    """
    kinds = [pos] if pos is not None else PARTS_OF_SPEECH
    known = senses.select("pos", "lemma").distinct()
    whole = stored(
        _forms(terms, kinds, exceptions).join(known, ["pos", "lemma"])
        .groupBy("term")
        .agg(F.min_by("lemma", F.struct("pos_order", "rank")).alias("base"))
    )
    several = terms.select("term").distinct().filter(F.size(F.split("term", _JOINTS)) > 1).join(whole, "term", "left_anti")
    return whole.unionByName(compound_form(several, senses, exceptions, pos))


def compound_form(terms: DataFrame, senses: DataFrame, exceptions: DataFrame | None = None, pos: str | None = None) -> DataFrame:
    """``(term, base)``: the longest run of a term's words that the lexicon has as a compound, each word in some form.

    Terms and lemmas are split at blanks, hyphens and underscores, whichever they have. Each word of a term may stand for
    its forms (see ``base_form``); a lemma fits where all its words are forms of the words in a row there. Words are
    joined with words, and a lemma counts if as many of its words are met as it has, so no combination of forms is
    written out. Of the fitting lemmas the longest counts, then the first part of speech, the earliest place, the
    likeliest forms, and the name.
    """
    kinds = [pos] if pos is not None else PARTS_OF_SPEECH
    words = stored(terms.select("term", F.posexplode(F.split("term", _JOINTS)).alias("place", "word")))
    forms = _forms(words.select(F.col("word").alias("term")), kinds, exceptions).withColumnRenamed("term", "word")
    likely = forms.groupBy("word", "pos", "pos_order", F.col("lemma").alias("part")).agg(F.min("rank").alias("rank"))
    lemmas = senses.select("pos", "lemma").distinct().withColumn("parts", F.split(F.lower("lemma"), _JOINTS)).filter(F.size("parts") > 1)
    parts = lemmas.select("pos", "lemma", F.size("parts").alias("n"), F.posexplode("parts").alias("inside", "part"))
    met = words.join(likely, "word").join(parts, ["pos", "part"]).select(
        "term", "pos_order", "lemma", "n", "inside", (F.col("place") - F.col("inside")).alias("start"), "rank"
    )
    best = met.groupBy("term", "pos_order", "lemma", "n", "start", "inside").agg(F.min("rank").alias("rank"))
    fits = best.groupBy("term", "pos_order", "lemma", "n", "start").agg(F.count(F.lit(1)).alias("met"), F.sum("rank").alias("ranks"))
    order = F.struct(-F.col("n"), "pos_order", "start", "ranks", "lemma")
    return fits.filter(F.col("met") == F.col("n")).groupBy("term").agg(F.min_by("lemma", order).alias("base"))


# --- hypernyms -----------------------------------------------------------------------------------------


def hypernym_paths(chosen: DataFrame, pointers: DataFrame) -> DataFrame:
    """``(synset, path)``: every way from a synset up to a root, both included.

    One join per level of the taxonomy; each level is stored before the next, and only the question
    whether any path goes on comes back to the driver. Where synsets have several hypernyms there can be very many ways;
    the measures use ``hypernym_closure`` instead.
    """
    up = pointers.filter(F.col("ptr_type") == HYPERNYM).select(F.col("src").alias("tip"), F.col("dst").alias("parent"))
    start = chosen.select("synset").distinct()
    open_paths = start.select("synset", F.array("synset").alias("path"), F.col("synset").alias("tip"))
    finished = []
    while True:
        step = open_paths.join(up, "tip", "left")
        step = stored(
            step.withColumn("parent", F.when(~F.array_contains("path", F.col("parent")), F.col("parent")))
        )
        finished.append(step.filter("parent is null").select("synset", "path"))
        longer = step.filter("parent is not null")
        if longer.isEmpty():
            return reduce(DataFrame.unionByName, finished).distinct()
        open_paths = longer.select("synset", F.array_append("path", F.col("parent")).alias("path"), F.col("parent").alias("tip"))


def hypernym_closure(chosen: DataFrame, pointers: DataFrame) -> DataFrame:
    """``(synset, ancestor, distance)``: all synsets above each, by the fewest steps; each is its own ancestor at 0.

    Breadth first: a round takes what the round before found one step up and keeps what is new, so a pair comes up once,
    with its least distance, however many ways lead there. Every round is stored; a cycle ends by itself.
    """
    up = stored(
        pointers.filter(F.col("ptr_type") == HYPERNYM).select(F.col("src").alias("ancestor"), F.col("dst").alias("parent")).distinct()
    )
    start = chosen.select("synset").distinct()
    rounds = [stored(start.select("synset", F.col("synset").alias("ancestor"), F.lit(0).alias("distance")))]
    while True:
        known = reduce(DataFrame.unionByName, rounds)
        step = rounds[-1].join(up, "ancestor").select("synset", F.col("parent").alias("ancestor"), (F.col("distance") + 1).alias("distance"))
        new = stored(step.distinct().join(known.select("synset", "ancestor"), ["synset", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known
        rounds.append(new)


def root_hypernyms(up: DataFrame, pointers: DataFrame) -> DataFrame:
    """``(synset, root, distance)``: ancestors that have nothing above them."""
    lower = pointers.filter(F.col("ptr_type") == HYPERNYM).select(F.col("src").alias("ancestor")).distinct()
    return up.join(lower, "ancestor", "left_anti").select("synset", F.col("ancestor").alias("root"), "distance")


def min_depth(up: DataFrame, pointers: DataFrame) -> DataFrame:
    """``(synset, depth)``: fewest steps from a synset to a root; none for synsets on a cycle without a way out."""
    return root_hypernyms(up, pointers).groupBy("synset").agg(F.min("distance").alias("depth"))


def _common(pairs: DataFrame, up: DataFrame) -> DataFrame:
    left = up.select(F.col("synset").alias("left"), "ancestor", F.col("distance").alias("d1"))
    right = up.select(F.col("synset").alias("right"), "ancestor", F.col("distance").alias("d2"))
    return pairs.select("left", "right").distinct().join(left, "left").join(right, ["right", "ancestor"])


def lowest_common_hypernym(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """``(left, right, common)``: the shared ancestor nearest to the right synset (ties: nearest to the left, name)."""
    nearest = F.min_by("ancestor", F.struct("d2", "d1", "ancestor"))
    return _common(pairs, up).groupBy("left", "right").agg(nearest.alias("common"))


def shortest_hypernym_path(pairs: DataFrame, pointers: DataFrame, up: DataFrame) -> DataFrame:
    """``(left, right, left_path, right_path)``: both shortest ways up to the lowest common hypernym, ends included.

    Ways are rebuilt from the distances: the next synset is a hypernym that is one step nearer to the goal, of several
    the first by name. Synsets on the way that ``up`` has no row for get their closure here.
    """
    result = stored(lowest_common_hypernym(pairs, up))
    between = stored(up.select(F.col("ancestor").alias("synset")).distinct().join(up.select("synset").distinct(), "synset", "left_anti"))
    above = up if between.isEmpty() else stored(up.select("synset", "ancestor", "distance").unionByName(hypernym_closure(between, pointers)))
    parents = stored(
        pointers.filter(F.col("ptr_type") == HYPERNYM).select(F.col("src").alias("tip"), F.col("dst").alias("parent")).distinct()
    )
    for end in ("left", "right"):
        wanted = result.select(F.col(end).alias("synset"), F.col("common").alias("ancestor")).distinct()
        open_ways = stored(
            wanted.join(up, ["synset", "ancestor"]).select("synset", "ancestor", F.array("synset").alias("path"), F.col("synset").alias("tip"), "distance")
        )
        finished = []
        while not open_ways.isEmpty():
            finished.append(open_ways.filter("distance = 0").select("synset", "ancestor", "path"))
            left = above.select(F.col("synset").alias("parent"), "ancestor", F.col("distance").alias("rest"))
            steps = open_ways.filter("distance > 0").join(parents, "tip").join(left, ["parent", "ancestor"]).filter("rest = distance - 1")
            nearest = steps.groupBy("synset", "ancestor", "path", "rest").agg(F.min("parent").alias("tip"))
            open_ways = stored(nearest.select("synset", "ancestor", F.array_append("path", F.col("tip")).alias("path"), "tip", F.col("rest").alias("distance")))
        if not finished:
            finished = [open_ways.select("synset", "ancestor", "path")]
        ways = reduce(DataFrame.unionByName, finished).toDF(end, "common", f"{end}_path")
        result = result.join(ways, [end, "common"])
    return result.select("left", "right", "left_path", "right_path")


# --- measures ------------------------------------------------------------------------------------------


def information_content(up: DataFrame, freq: DataFrame) -> DataFrame:
    """``(synset, ic, root_freq)``: minus log of the share of a synset and all below it in its root's count."""
    counted = up.join(freq, "synset").groupBy("ancestor").agg(F.sum("count").alias("total"))
    total = counted.select(F.col("ancestor").alias("root"), F.col("total").alias("root_freq"))
    last = Window.partitionBy("synset").orderBy(F.desc("distance"), "ancestor")
    roots = up.withColumn("n", F.row_number().over(last)).filter("n = 1").select("synset", F.col("ancestor").alias("root"))
    return (
        roots.join(counted.withColumnRenamed("ancestor", "synset"), "synset")
        .join(total, "root")
        .filter(F.col("total") > 0)
        .select("synset", F.greatest(F.lit(0.0), -F.ln(F.col("total") / F.col("root_freq"))).alias("ic"), "root_freq")
    )


def _gloss_words(synsets: DataFrame) -> DataFrame:
    """``(synset, words)``: the different words of each definition."""
    words = F.filter(F.split(F.lower("definition"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return gloss_parts(synsets).select("synset", F.array_distinct(words).alias("words"))


def _reach(starts: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """``(*columns, node, steps)``: nodes reached over ``edges (node, to)`` in the fewest steps, no more than a path has;
    ``starts`` has the same columns."""
    rounds = [starts]
    for _ in range(_HSO_STEPS):
        step = rounds[-1].filter(F.col("steps") < _HSO_STEPS).join(edges, "node")
        rounds.append(step.select(*columns, F.col("to").alias("node"), (F.col("steps") + 1).alias("steps")).distinct())
    return reduce(DataFrame.unionByName, rounds).groupBy(*columns, "node").agg(F.min("steps").alias("steps"))


def hirst_st_onge(pairs: DataFrame, pointers: DataFrame) -> DataFrame:
    """``(left, right, hso)``: 16 for a synset with itself, else 8 less the steps and the turns of the best allowed path.

    A path has at most five steps, up, sideways or down, of the shapes u, uh, uhd, ud, h, hd, d and dh, where each letter
    stands for one step or more. A state is a synset with the directions taken so far; states are searched from both ends
    and meet in the middle. A way down is a way up from the other end, so nothing is expanded downwards from a frequent
    synset: the left end goes up and then sideways, the right end up, or sideways and then up as far as the left end.
    """
    return _hirst_st_onge(stored(pairs.select("left", "right").distinct()), pointers)


def _hirst_st_onge(wanted: DataFrame, pointers: DataFrame) -> DataFrame:
    ends = wanted.select(F.explode(F.array("left", "right")).alias("src")).distinct().filter("src is not null")
    rising = pointers.filter(F.col("ptr_type").isin(_UPWARD)).select(F.col("src").alias("node"), F.col("dst").alias("to"))
    falling = pointers.filter(F.col("ptr_type").isin(_DOWNWARD)).select(F.col("dst").alias("node"), F.col("src").alias("to"))
    up = stored(rising.unionByName(falling).distinct())
    level = pointers.filter(F.col("ptr_type").isin(_SIDEWAYS))
    flat = level.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    flat = stored(flat.unionByName(flat.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct())

    start = ends.select("src", F.col("src").alias("node"), F.lit(0).alias("steps"))
    rise = stored(_reach(start, up, ["src"]).filter("node is not null").withColumn("u", (F.col("steps") > 0).cast("int")))
    # ways that go up (or not) and then sideways, and ways that go sideways and then up
    turned = stored(_reach(rise.select("src", "u", "node", "steps"), flat, ["src", "u"]))
    moved = turned.join(rise.select("src", "node", F.col("steps").alias("plain"), "u"), ["src", "u", "node"], "left")
    sideways = stored(moved.filter(F.col("plain").isNull() | (F.col("steps") < F.col("plain"))).select("src", "node", "steps", "u", F.lit(1).alias("h")))
    first = stored(sideways.filter("u = 0 and src != node").select("src", "node", "steps"))
    late = _reach(first, up, ["src"]).join(first, ["src", "node", "steps"], "left_anti")

    # nearly all pairs meet on ways up: these are one row per end, so that each pair is sent twice and never multiplied
    wide = stored(rise.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > _WIDE).select("src"))
    narrow = rise.join(wide, "src", "left_anti") if not wide.isEmpty() else rise
    lists = stored(narrow.groupBy("src").agg(F.collect_list(F.struct("node", "steps", "u")).alias("states")))
    best = _best_of_ways(_with_both(wanted, lists, "src"))
    parts = []
    if not sideways.isEmpty():
        turning = sideways.select(F.col("src").alias("left"), "node", F.col("steps").alias("s1"), "u", "h")
        parts.append(_met(wanted, turning, rise))
        parts.append(
            wanted.join(late.select(F.col("src").alias("right"), F.col("node").alias("left"), F.col("steps").alias("len")), ["left", "right"])
            .select("left", "right", "len", F.lit(1).alias("turns"))
        )
    if not wide.isEmpty():
        left = rise.select(F.col("src").alias("left"), "node", F.col("steps").alias("s1"), "u", F.lit(0).alias("h"))
        ends_wide = [wanted.join(wide.withColumnRenamed("src", end), end, "left_semi") for end in ("left", "right")]
        parts.append(_met(ends_wide[0].unionByName(ends_wide[1]).distinct(), left, rise))
    if parts:
        more = reduce(DataFrame.unionByName, parts).filter(F.col("len") <= _HSO_STEPS).select("left", "right", _hso_score().alias("more"))
        more = more.groupBy("left", "right").agg(F.max("more").alias("more"))
        best = best.join(more, ["left", "right"], "left").select("left", "right", F.greatest("hso", "more").alias("hso"))
    return best.select("left", "right", F.greatest(F.lit(0.0), F.coalesce("hso", F.lit(0.0))).alias("hso"))


def _hso_score() -> Column:
    rest = F.lit(float(_HSO_BASE)) - F.col("len") - F.col("turns")
    return F.when(F.col("left") == F.col("right"), F.lit(float(_HSO_SAME))).otherwise(rest)


def _with_both(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``pairs`` with both ends' other columns of ``rows`` as the structs ``l`` and ``r``, null for ends without a row."""
    held = F.struct(*[c for c in rows.columns if c != key])
    for end in ("left", "right"):
        pairs = pairs.join(rows.select(F.col(key).alias(end), held.alias(end[0])), end, "left")
    return pairs


def _best_of_ways(pairs: DataFrame) -> DataFrame:
    """``(left, right, hso)``, null where the ways up from both ends do not meet within the steps."""
    there = F.map_from_entries(F.transform("r.states", lambda x: F.struct(x["node"], F.struct(x["steps"], x["u"]))))
    ways = F.transform("l.states", lambda x: F.struct(x["steps"].alias("s"), x["u"].alias("u"), F.try_element_at(F.col("there"), x["node"]).alias("o")))
    length = lambda w: w["s"] + w["o"]["steps"]
    met = F.filter(ways, lambda w: w["o"].isNotNull() & (length(w) <= _HSO_STEPS))
    loss = F.array_min(F.transform(met, lambda w: length(w) + F.greatest(F.lit(0), w["u"] + w["o"]["u"] - 1)))
    score = F.when(F.col("loss").isNull(), None).when(F.col("left") == F.col("right"), F.lit(float(_HSO_SAME))).otherwise(F.lit(float(_HSO_BASE)) - F.col("loss"))
    return pairs.withColumn("there", there).select("left", "right", loss.alias("loss")).select("left", "right", score.alias("hso"))


def _met(wanted: DataFrame, left: DataFrame, rise: DataFrame) -> DataFrame:
    """``(left, right, len, turns)`` of ways from the left ends that meet ways up from the right ends, by joins."""
    right = rise.select(F.col("src").alias("right"), "node", F.col("steps").alias("s2"), F.col("u").alias("d"))
    turns = F.greatest(F.lit(0), F.col("u") + F.col("h") + F.col("d") - 1)
    return wanted.join(left, "left").join(right, ["right", "node"]).select("left", "right", (F.col("s1") + F.col("s2")).alias("len"), turns.alias("turns"))


@dataclass(frozen=True)
class Taxonomy:
    """What the measures need of a lexicon's hypernyms, computed once: ``up (synset, ancestor, distance)``,
    ``depth (synset, depth)`` and ``ic (synset, ic, root_freq)``."""

    up: DataFrame
    depth: DataFrame
    ic: DataFrame


def taxonomy(lexicon: Lexicon) -> Taxonomy:
    """The stored tables of a lexicon; their size is bounded by synsets times the depth of the taxonomy."""
    nodes = lexicon.synsets.select("synset").unionByName(lexicon.freq.select("synset"))
    up = stored(hypernym_closure(nodes, lexicon.pointers))
    return Taxonomy(up, stored(min_depth(up, lexicon.pointers)), stored(information_content(up, lexicon.freq)))


def _above(pairs: DataFrame, tree: Taxonomy) -> DataFrame:
    """``(synset, depth, ic, above)`` of the ends of pairs, a row each: ``above`` has the ancestors with their distance, depth,
    information and the count of their root. A synset has no more of them than ways of the taxonomy lead to."""
    ends = pairs.select(F.explode(F.array("left", "right")).alias("synset")).distinct()
    info = tree.ic.select(F.col("synset").alias("ancestor"), F.col("ic").alias("shared"), "root_freq")
    rows = (
        tree.up.join(ends, "synset", "left_semi")
        .join(tree.depth.select(F.col("synset").alias("ancestor"), (F.col("depth") + 1).alias("deep")), "ancestor")
        .join(info, "ancestor", "left")
    )
    above = rows.groupBy("synset").agg(F.collect_list(F.struct("ancestor", "distance", "deep", "shared", "root_freq")).alias("above"))
    return above.join(tree.depth.select("synset", (F.col("depth") + 1).alias("depth")), "synset").join(tree.ic.select("synset", "ic"), "synset", "left")


def _taxonomy_measures() -> list[Column]:
    """``path, lch, wup, res, lin, jcn`` from the columns of ``_with_common``, null without a common ancestor."""
    ic1, ic2 = F.coalesce("l.ic", F.lit(0.0)), F.coalesce("r.ic", F.lit(0.0))
    nodes = (F.col("near.d") + 1).cast("double")
    shared, top = F.coalesce("shared", F.lit(0.0)), F.col("top").cast("double")
    informed = (ic1 > 0.0) & (ic2 > 0.0)
    gap = ic1 + ic2 - 2.0 * shared
    limit = F.try_divide(F.lit(1.0), -F.ln((top - _JCN_GAP) / top))
    measures = {
        "path": 1.0 / nodes,
        "lch": -F.ln(nodes / F.lit(2.0 * _LCH_DEPTH)),
        "wup": -2.0 * F.col("near.deep") / (F.col("l.depth") + F.col("r.depth")),
        "res": shared,
        "lin": F.when(informed, F.try_divide(2.0 * shared, ic1 + ic2)).otherwise(0.0),
        "jcn": F.when(~informed, 0.0).when(gap <= 0.0, limit).otherwise(F.try_divide(F.lit(1.0), gap)),
    }
    return [F.when(F.col("near").isNotNull(), m).alias(name) for name, m in measures.items()]


def _with_common(pairs: DataFrame) -> DataFrame:
    """Pairs with the rows ``l`` and ``r`` of ``_above``, and of their common ancestors the nearest (the deepest, then the first
    by name) as ``near``, the most information ``shared`` and the largest count ``top``; each null where there is none."""
    there = F.map_from_entries(F.transform("r.above", lambda x: F.struct(x["ancestor"], x["distance"])))
    far = F.transform("l.above", lambda x: x.withField("d", x["distance"] + F.try_element_at(F.col("there"), x["ancestor"])))
    common = F.filter(far, lambda x: x["d"].isNotNull())
    by_distance = F.transform("common", lambda c: F.struct(c["d"].alias("d"), (-c["deep"]).alias("deep"), c["ancestor"].alias("ancestor")))
    return pairs.withColumn("there", there).withColumn("common", common).withColumns({
        "near": F.array_min(by_distance),
        "shared": F.array_max(F.transform("common", lambda c: c["shared"])),
        "top": F.array_max(F.transform("common", lambda c: c["root_freq"])),
    }).drop("there", "common")


def taxonomy_similarity(pairs: DataFrame, tree: Taxonomy) -> DataFrame:
    """``(left, right, path, lch, wup, res, lin, jcn)`` of synset pairs with a common ancestor."""
    pairs = stored(pairs.select("left", "right").distinct())
    met = _with_common(_with_both(pairs, stored(_above(pairs, tree)), "synset")).filter("near is not null")
    return met.select("left", "right", *_taxonomy_measures())


def synset_similarity(pairs: DataFrame, lexicon: Lexicon, tree: Taxonomy | None = None) -> DataFrame:
    """All eight measures of synset pairs ``(left, right)``; those that need a common ancestor are 0 without one.

    What the measures need of a synset is one row, so a pair meets each of its ends once and is not multiplied by their
    ancestors.
    """
    pairs = stored(pairs.select("left", "right").distinct())
    tree = taxonomy(lexicon) if tree is None else tree
    words = _gloss_words(lexicon.synsets).groupBy("synset").agg(F.collect_list(F.struct("words")).alias("glosses"))
    ends = stored(_above(pairs, tree).join(words, "synset", "full_outer"))
    met = _with_common(_with_both(_hirst_st_onge(pairs, lexicon.pointers), ends, "synset"))
    overlap = F.flatten(F.transform("l.glosses", lambda a: F.transform("r.glosses", lambda b: F.size(F.array_intersect(a["words"], b["words"])).cast("double"))))
    return met.select("left", "right", *_taxonomy_measures(), F.explode_outer(overlap).alias("lesk"), "hso").fillna(0.0)


def mean_similarity(measures: DataFrame) -> DataFrame:
    """``(left, right, sim)``: mean of the eight measures, each brought to its range, two decimals."""
    total = (
        F.col("path") + F.col("lch") / MAX_LCH + F.col("wup") + F.col("res") / MAX_RES + F.col("jcn") / MAX_JCN
        + F.col("lin") + F.col("lesk") / MAX_LESK + F.col("hso") / MAX_HSO
    )
    mean = F.coalesce(total, F.lit(0.0)) / 8.0
    return measures.select("left", "right", (F.floor(mean * 100.0 + 0.5) / 100.0).alias("sim"))


def _first_senses(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(word, pos, synset)``: first noun and verb senses of the words' stems."""
    first = lexicon.senses.filter((F.col("sense_no") == 1) & F.col("pos").isin("noun", "verb"))
    return stem_vocabulary(words, "word").join(first, F.lower("stem") == F.col("lemma")).select("word", "pos", "synset")


def _too_short() -> Column:
    return ((F.length("x") < 4) & (F.length("y") < 4)) | (F.length("x") < 3) | (F.length("y") < 3)


def word_similarity(pairs: DataFrame, lexicon: Lexicon, tree: Taxonomy | None = None) -> DataFrame:
    """``(x, y, sim)`` of word pairs: the better of the mean noun and mean verb similarity of their stems.

    Words equal apart from case get 1. Two words under four letters, or one under three, get 0, as do
    words the lexicon does not know.
    """
    distinct = pairs.select("x", "y").distinct()
    first = stored(_first_senses(distinct.select(F.explode(F.array("x", "y")).alias("word")), lexicon))
    left = first.select(F.col("word").alias("x"), "pos", F.col("synset").alias("left"))
    right = first.select(F.col("word").alias("y"), "pos", F.col("synset").alias("right"))
    sensed = stored(distinct.join(left, "x").join(right, ["y", "pos"]))
    scored = sensed.join(mean_similarity(synset_similarity(sensed, lexicon, tree)), ["left", "right"])
    best = scored.groupBy("x", "y").agg(F.max("sim").alias("best"))
    sim = (
        F.when((F.length("x") > 0) & (F.lower("x") == F.lower("y")), 1.0)
        .when(_too_short(), 0.0)
        .otherwise(F.coalesce("best", F.lit(0.0)))
    )
    return distinct.join(best, ["x", "y"], "left").select("x", "y", sim.alias("sim"))


# --- similar words of two vocabularies -----------------------------------------------------------------


def _reachable(chosen: DataFrame, tree: Taxonomy) -> DataFrame:
    """``(synset, ancestor, bound)``: the most that the six taxonomy measures together can give ``synset`` and another
    synset whose most informative common ancestor is ``ancestor``, each measure brought to its range.

    Resnik, Lin and Jiang-Conrath depend on that ancestor, and on the other's information, which is at least the least
    below the ancestor. Path, Leacock-Chodorow and Wu-Palmer depend on the nearest common ancestor, which has no more
    information; the best such ancestor of ``synset`` is taken, at its distance from ``synset`` alone.
    """
    deep = tree.depth.select("synset", (F.col("depth") + 1).alias("deep"))
    info = tree.ic.filter("ic > 0").select("synset", "ic")
    below = (
        tree.up.join(deep, "synset").join(info, "synset", "left").groupBy("ancestor")
        .agg(F.min("deep").alias("least_deep"), F.min("ic").alias("least_ic"))
    )
    above = below.join(deep.toDF("ancestor", "deep"), "ancestor").join(tree.ic.select(F.col("synset").alias("ancestor"), F.col("ic").alias("shared")), "ancestor", "left")
    above = stored(above.withColumn("shared", F.coalesce("shared", F.lit(0.0))))
    rows = (
        chosen.select("synset").distinct().join(tree.up, "synset")
        .join(deep.withColumnRenamed("deep", "own_deep"), "synset").join(info.withColumnRenamed("ic", "own_ic"), "synset", "left")
        .join(above, "ancestor")
    )
    nodes = F.col("distance") + 1.0
    near = 1.0 / nodes - F.ln(nodes / F.lit(2.0 * _LCH_DEPTH)) / MAX_LCH + 2.0 * F.col("deep") / (F.col("own_deep") + F.col("least_deep"))
    upwards = Window.partitionBy("synset").orderBy("shared").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("own_ic") + F.col("least_ic") - 2.0 * F.col("shared")
    close = F.when(gap > 1e-9, 1.0 / F.when(gap > 1e-9, gap)).otherwise(F.lit(float("inf")))
    informed = F.when(
        F.col("own_ic").isNotNull() & F.col("least_ic").isNotNull(),
        2.0 * F.col("shared") / (F.col("own_ic") + F.col("least_ic")) + close / MAX_JCN,
    ).otherwise(0.0)
    return rows.withColumn("near", F.max(near).over(upwards)).select(
        "synset", "ancestor", (F.col("near") + F.col("shared") / MAX_RES + informed).alias("bound")
    )


def _by_gloss(left: DataFrame, right: DataFrame, synsets: DataFrame, shared: int) -> DataFrame:
    """Pairs whose definitions have ``shared`` words in common, and others: two such definitions share one of their
    rarest words, all but ``shared - 1`` of each being looked at."""
    sides = []
    for chosen in (left, right):
        words = chosen.select("synset").distinct().join(_gloss_words(synsets), "synset")
        sides.append(stored(words.select("synset", F.size("words").alias("n"), F.explode("words").alias("w"))))
    load = sides[0].unionByName(sides[1]).groupBy("w").agg(F.count(F.lit(1)).alias("load"))
    order = Window.partitionBy("synset").orderBy("load", "w")
    rare = [
        d.join(load, "w").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("n") - (shared - 1)).select("synset", "w")
        for d in sides
    ]
    return rare[0].toDF("left", "w").join(rare[1].toDF("right", "w"), "w").select("left", "right").distinct()


def related_synsets(left: DataFrame, right: DataFrame, lexicon: Lexicon, threshold: float, tree: Taxonomy | None = None) -> DataFrame:
    """``(left, right, sim)`` of all pairs of two columns ``synset`` whose mean similarity is ``threshold`` or more.

    A pair's eight measures must sum to eight times the threshold. What its path relation can add is known, and pairs
    with many gloss words in common come from a join of their own; the other pairs need the rest from the taxonomy, so
    synsets meet only at ancestors that can still give that much to either of them. Ancestors near a root cannot, so
    frequent ones make no product. Candidates are scored in full.
    """
    need = 8.0 * (threshold - 0.005) - 1e-9  # the mean is rounded to two decimals
    relation = _HSO_SAME / MAX_HSO
    few = _FEW_WORDS
    while few and few / MAX_LESK + relation >= need:
        few -= 1
    if few / MAX_LESK + relation >= need:
        raise ValueError(f"threshold {threshold} is too low: synsets without anything in common reach it")
    tree = taxonomy(lexicon) if tree is None else tree
    left, right = stored(left.select("synset").distinct()), stored(right.select("synset").distinct())
    least = need - relation - few / MAX_LESK
    sides = [stored(_reachable(d, tree).filter(F.col("bound") >= least).select("synset", "ancestor")) for d in (left, right)]
    met = sides[0].toDF("left", "ancestor").join(sides[1].toDF("right", "ancestor"), "ancestor").select("left", "right")
    pairs = stored(met.unionByName(_by_gloss(left, right, lexicon.synsets, few + 1)).distinct())
    return mean_similarity(synset_similarity(pairs, lexicon, tree)).filter(F.col("sim") >= threshold)


def vocabulary_similarity(words1: DataFrame, words2: DataFrame, lexicon: Lexicon, threshold: float, tree: Taxonomy | None = None) -> DataFrame:
    """``(x, y, sim)`` for the words of two vocabularies ``(word)`` whose similarity is ``threshold`` or more.

    Exactly the pairs of the whole product that ``word_similarity`` would give that much, words equal apart from case
    left out that the lexicon doesn't know; the product is not formed.
    """
    first = [stored(_first_senses(words, lexicon)) for words in (words1, words2)]
    kinds = [d.select("synset").distinct() for d in first]
    close = stored(related_synsets(*kinds, lexicon, threshold, tree))
    left, right = first[0].toDF("x", "pos", "left"), first[1].toDF("y", "pos", "right")
    scored = left.join(close, "left").join(right, ["right", "pos"]).groupBy("x", "y").agg(F.max("sim").alias("sim"))
    equal = (F.length("x") > 0) & (F.lower("x") == F.lower("y"))
    # equal words count as 1 even where their synset by itself has less than the threshold
    x, y = (d.select(F.col("word").alias(n), F.lower("word").alias("low")).distinct() for d, n in zip(first, "xy"))
    same = x.join(y, "low").select("x", "y", F.lit(1.0).alias("sim")).filter(F.col("sim") >= threshold)
    return scored.filter(~equal & ~_too_short()).select("x", "y", "sim").unionByName(same.filter(equal))


def word_pair_report(pairs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Measures of noun pairs ``(x, y)`` by their first senses."""
    nouns = lexicon.senses.filter((F.col("sense_no") == 1) & (F.col("pos") == "noun"))
    left = nouns.select(F.col("lemma").alias("x"), F.col("synset").alias("left"))
    right = nouns.select(F.col("lemma").alias("y"), F.col("synset").alias("right"))
    sensed = pairs.select("x", "y").join(left, "x").join(right, "y")
    return sensed.join(synset_similarity(sensed, lexicon), ["left", "right"]).select(
        "x", "y", "hso", "jcn", "lch", "lin", "res", "wup", "lesk"
    )
