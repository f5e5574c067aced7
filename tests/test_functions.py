import brute
import pytest
from pyspark.sql import functions as F

from tripleweave.config import Thresholds
from tripleweave.functions import terms, text
from tripleweave.functions.stem import stem_word
from tripleweave.operators import predicates


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("uri, with_hash, plain", [
    ("<http://a/b/c>", "c", "c"),
    ("<http://a/b#c>", "c", "b#c"),
    ("<http://a/b/>", "b", "b"),
    ("<http://a/b#>", None, "b#"),
    ("<urn>", "urn", "urn"),
    ('"text"', None, None),
    ("<>", None, None),
])
def test_uri_ending(spark, uri, with_hash, plain):
    assert one(spark, terms.uri_ending(F.lit(uri))) == with_hash
    assert one(spark, terms.uri_ending(F.lit(uri), hash=False)) == plain


@pytest.mark.parametrize("term, value", [
    ('"abc"', "abc"), ('"abc"@en', "abc"), ('"1.0"^^<http://x#float>', "1.0"), ("bare", "bare"), ('""', '""'),
    ("", None), ("<http://a/b>", None), (None, None), ('"open', "open"), ("_:b1", "_:b1"), ('""@en', ""),
])
def test_literal_value(spark, term, value):
    assert one(spark, terms.literal_value(F.lit(term).cast("string"))) == value


def test_comparable_and_names(spark):
    assert one(spark, terms.comparable_value(F.lit("<http://a/x#y>"))) == "<y"
    assert one(spark, terms.literal_or_ending(F.lit("<http://a/x#y>"))) == "x#y"
    assert one(spark, terms.lower_ending(F.lit("<http://a/X/isPartOf>"))) == "ispartof"
    assert one(spark, terms.local_name(F.lit("<http://a/x#has9>"))) == "has9"
    assert one(spark, terms.unescape(F.lit(r"café \"x\""))) == 'café "x"'


@pytest.mark.parametrize("a, b, sim", [
    ("isCenterOf", "isWorkingWith", 0.0), ("composer", "musicComposer", 0.285714), ("Martin", "martn", 0.545454),
    ("France", "French", 0.666667), ("120993-53-5", "cas:120993-53-5", 0.538462), ("", "", 0.0),
])
def test_edit_similarity(spark, a, b, sim):
    assert one(spark, text.string_distance_sim(F.lit(a), F.lit(b))) == pytest.approx(sim, abs=1e-5)
    assert one(spark, text.string_distance_sim(F.lit(b), F.lit(a))) == pytest.approx(sim, abs=1e-5)


def test_edit_reach_agrees_with_measure(spark):
    words = ["gear", "gears", "widget", "widgets", "bolt", "bolts", "a", "", "ring", "string", "plate", "plates"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for th in (0.4, 0.7, 0.75):
        for strict in (False, True):
            sim = text.string_distance_sim("a", "b")
            want = (sim > th) if strict else (sim >= th)
            off = rows.filter(F.length(F.concat("a", "b")) > 0).filter(
                text.within_edit_reach("a", "b", th, strict) != want
            )
            assert off.count() == 0


def test_cleaning_and_words(spark):
    assert one(spark, text.clean_text(F.lit("cas:120993-53-5"))) == "cas 120993 53 5"
    for raw in ("of the U.S. in (x) 3.5", "a-b_c", "  New   York, NY ", "l'été à Paris", "x", ""):
        assert one(spark, text.clean_text(F.lit(raw))) == brute.clean(raw)
    assert one(spark, text.split_camel(F.lit("casRegistryNumber"))) == ["cas", "Registry", "Number"]
    assert one(spark, text.split_camel(F.lit("XMLFile2Go"))) == ["XML", "File", "2", "Go"]
    assert one(spark, text.ci_equal(F.lit("Ab"), F.lit("aB"))) is True
    assert one(spark, text.ci_equal(F.lit(""), F.lit(""))) is False


@pytest.mark.parametrize("a, b, sim", [
    ("New York", "new york", 1.0), ("red bolt", "red bolts", 1 / 3), ("small widget", "small widgets", 1.0),
    ("new new", "new news x y z", 1.0), ("--", "x", 0.0), ("gear", "gears", 2 * 3 / 9),
    ("abcd abcd", "abcd abce", float("inf")),
])
def test_value_similarity(spark, a, b, sim):
    got = one(spark, text.literal_sim(F.lit(a), F.lit(b), 0.7))
    assert got == pytest.approx(sim)
    assert brute.literal_sim(a, b, 0.7) == pytest.approx(sim)


def test_compression_ratio(spark):
    assert one(spark, text.compression_ratio(F.lit(394.0), F.lit(64.0))) == 16.24


def test_thresholds():
    assert Thresholds.from_string(0.7).lexical == pytest.approx(0.5)
    assert Thresholds.from_lexical(0.7).string == pytest.approx(0.9)


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("motoring", "motor"),
    ("sing", "sing"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("electrical", "electr"), ("hopefulness", "hope"), ("replacement", "replac"),
    ("adoption", "adoption"), ("airliner", "airlin"), ("director", "direct"), ("directed", "direct"), ("is", "is"),
    ("yellow", "Yellow"), ("rate", "rate"), ("probate", "probat"), ("controll", "control"),
])
def test_stemming(word, stem):
    assert stem_word(word) == stem


SIMS = [("car", "Auto", 0.96), ("Auto", "car", 0.96), ("Manager", "Director", 0.6), ("director", "directed", 0.55)]


def test_name_scores_with_lexicon(spark):
    sims = spark.createDataFrame(SIMS, "x string, y string, sim double")
    pairs = [
        ("car", "Auto"), ("isManagerOf", "isDirectorOf"), ("casNumber", "casRegistryNumber"), ("name", "phone-numer"),
        ("director", "directed"), ("Name", "name"), ("composer", "musicComposer"), ("120993-53-5", "cas:120993-53-5"),
    ]
    frame = spark.createDataFrame(pairs, "v1 string, v2 string")
    got = {(r.v1, r.v2): r.score for r in predicates.score_pairs(frame, 0.5, sims, names=True).collect()}
    assert got[("car", "Auto")] == 0.96
    # "is" and "Of" inside camel words stay: cleaning sees one word before it is split
    assert got[("isManagerOf", "isDirectorOf")] == 1.0
    assert got[("casNumber", "casRegistryNumber")] == pytest.approx(2 / 3)
    assert got[("name", "phone-numer")] == 0.0
    assert got[("director", "directed")] == 0.55
    assert got[("Name", "name")] == 1.0
    assert got[("composer", "musicComposer")] == pytest.approx(1 / 2)
    assert got[("120993-53-5", "cas:120993-53-5")] == pytest.approx(3 / 4)
    equal = {tuple(r) for r in predicates.predicates_equal(frame, 0.5, sims).collect()}
    assert equal == {p for p, s in got.items() if s > 0.5}


def test_joined_names_equal_scored_pairs(spark):
    """The join finds what scoring every pair finds."""
    sims = spark.createDataFrame(SIMS, "x string, y string, sim double")
    left = ["car", "isManagerOf", "casNumber", "name", "director", "Name", "newNewNew", "musicComposer", "a-b", ""]
    right = ["Auto", "isDirectorOf", "casRegistryNumber", "NAME", "directed", "newOld", "composer", "phoneNumber", "ab"]
    frames = [spark.createDataFrame([(v,) for v in side], "v string") for side in (left, right)]
    grid = spark.createDataFrame([(a, b) for a in left for b in right], "v1 string, v2 string")
    for names in (True, False):
        for lex in (None, sims):
            for word, cut, inclusive in ((0.7, 0.7, False), (0.2, 0.4, True)):
                scored = predicates.score_pairs(grid, word, lex, names)
                high = F.col("score") >= cut if inclusive else F.col("score") > cut
                want = {(r.v1, r.v2, round(r.score, 6)) for r in scored.filter(high).collect()}
                found = predicates.lexical_pairs(*frames, word, cut, lex, names, None, inclusive)
                assert {(r.v1, r.v2, round(r.score, 6)) for r in found.collect()} == want


def test_value_scores_by_kind(spark):
    limits = Thresholds.from_string(0.7)
    frame = spark.createDataFrame(
        [("<Person", "<Person"), ("<Person", "Person"), ("red bolt", "Red Bolt"), ("<", "<a"), ("<bigCar", "<smallCar")],
        "v1 string, v2 string",
    )
    got = {(r.v1, r.v2): r.score for r in predicates.value_scores(frame, limits).collect()}
    assert got == {
        ("<Person", "<Person"): 0.7, ("<Person", "Person"): 0.0, ("red bolt", "Red Bolt"): 1.0, ("<", "<a"): 0.0,
        ("<bigCar", "<smallCar"): pytest.approx(1 / 3),
    }
