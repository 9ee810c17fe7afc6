from countylens.functions import stems
from countylens.operators import topics

# Words with the base forms that the published algorithm gives.
PAIRS = """caresses caress flies fli dies die mules mule denied deni died die agreed agre owned own humbled humbl
sized size meeting meet stating state siezing siez itemization item sensational sensat traditional tradit reference refer
colonizer colon plotted plot consign consign consigned consign consigning consign consignment consign consist consist
consistency consist consistent consist consistently consist consisting consist consolation consol consolations consol
consolatory consolatori console consol knackeries knackeri knaves knave knavish knavish kneaded knead kneel kneel
knightly knight knots knot generate generat generous generous general general communication communic communism
communism arsenal arsenal gas gas this this gaps gap kiwis kiwi hopping hop hoped hope hoping hope luxuriated luxuri
happy happi cry cri by by say say skies sky dying die news news inning inning succeed succeed proceeding proceed
relational relat conditional condit vietnamization vietnam analogousli analog feed feed bleed bleed repeatedly repeat
electricity electr hopefulness hope goodness good formative format adjustment adjust adoption adopt national nation
controlling control rolled roll yelling yell boy boy enjoying enjoy youth youth bed bed shred shred
bead bead disturb disturb embed emb ties tie cries cri kind kind rate rate sky sky atlas atlas""".split()


def test_published_forms(spark):
    pairs = list(zip(PAIRS[::2], PAIRS[1::2]))
    frame = spark.createDataFrame(pairs, "word string, want string")
    got = stems.with_stems(frame).select("word", "want", "base").collect()
    assert [tuple(r) for r in got if r.want != r.base] == []


def test_short_missing_and_possessive_words(spark):
    frame = spark.createDataFrame([(w, 1) for w in ("is", "", None, "s", "county's", "états")], "word string, n int")
    found = stems.with_stems(frame, name="stem")
    assert found.columns == ["word", "n", "stem"]
    assert {r.word: r.stem for r in found.collect()} == {
        "is": "is", "": "", None: None, "s": "s", "county's": "counti", "états": "état"}


def test_forms_meet_in_a_bag(spark):
    bag = spark.createDataFrame([(1, "testing", 2), (1, "tested", 1), (1, "tests", 1), (1, "masks", 1)],
                                "doc_id long, word string, count long")
    joined = topics.normalize(bag, topics.base_forms(bag)).collect()
    assert {(r.word, r["count"]) for r in joined} == {("test", 4), ("mask", 1)}
