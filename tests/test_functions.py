import pytest
from pyspark.sql import functions as F

from litmesh.functions import ids, kernels, references, scores


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


DOIS = [
    ("https://doi.org/10.1000/ABC.1", "10.1000/abc.1"),
    ("doi: 10.1000/x(69)90011-8", "10.1000/x(69)90011-8"),
    ("10.1000/abc)", "10.1000/abc"),
    ("10.1000/abc).", "10.1000/abc"),
    ("10.3389/fncom.2013.00137/abstract", "10.3389/fncom.2013.00137"),
    ("10.1002/1521%3C99::AID%3E3.0", "10.1002/1521<99::aid>3.0"),
    (" 10.99187%2Fs0000tw-04 ", "10.99187/s0000tw-04"),
    ("11.1000/abc", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("raw, wanted", DOIS)
def test_norm_doi_native_and_kernel_agree(spark, raw, wanted):
    assert one(spark, ids.norm_doi, raw) == wanted
    assert kernels.norm_doi(raw) == wanted


def test_decode_percent_once_and_ascii_only(spark):
    assert one(spark, ids.decode_percent, "a%2528b%C3%A9%zz+%41") == "a%28b%C3%A9%zz+A"


@pytest.mark.parametrize(
    "torn, whole",
    [
        ("https://doi.org/10. 1073/pnas.1601513113", "10.1073/pnas.1601513113"),
        ("10.1038/ lsa.2020", "10.1038/lsa.2020"),
        ("10.1016/0017-9310(69) 90011-8", "10.1016/0017-9310(69)90011-8"),
        ("10.1103/PhysRevLett .125.260502", "10.1103/physrevlett.125.260502"),
        ("10.1016/j. ijthermalsci.2021", "10.1016/j.ijthermalsci.2021"),
        ("10.1016/S1369-8001 (03)00075-1", "10.1016/s1369-8001(03)00075-1"),
        ("10.1038/nature12373. Smith et al.", "10.1038/nature12373"),
        ("10.1038/nature12373 (2013).", "10.1038/nature12373"),
        ("10.1103/physrevb.1.011001. arXiv:2101.00001", "10.1103/physrevb.1.011001"),
        ("14. Doe, A. doi:10.1038/nature12373. 15. Smith J", "10.1038/nature12373"),
        ("Doe, A. 10.1038/nature.2009.11. 123 Smith, J.", "10.1038/nature.2009.11.123"),
    ],
)
def test_heal_dois(torn, whole):
    assert kernels.find_dois(torn) == [whole]


def test_fragment_is_no_doi():
    assert kernels.find_dois("see 10.1016/j and 10.1103/physrevlett.") == []


def test_entities():
    assert kernels.decode_entities("a&tnqx3c;b&#x3e;c&#38;d&lt;&amp;") == "a<b>c&d<&amp;"


def test_norm_title():
    assert kernels.norm_title("  Naïve—Bayes:\nÜber ΔX ½ ") == "naive bayes uber x 1 2"
    assert kernels.norm_title(None) == ""


def test_names_journal():
    w = lambda s: s.split()
    assert kernels.names_journal(w("s m lee j appl phys"), w("journal applied physics"))
    assert kernels.names_journal(w("rev sci instrum"), w("review scientific instruments"))
    assert not kernels.names_journal(w("appl phys lett"), w("journal applied physics"))
    assert not kernels.names_journal(w("phys rev d"), w("physical review b"))
    assert not kernels.names_journal(w("j"), w("journal"))
    assert not kernels.names_journal([], w("nature")) and not kernels.names_journal(w("nature"), [])


def test_first_year_page_signature(spark):
    assert one(spark, ids.first_year, "Oct 18, 2023 or 1999") == 2023
    assert one(spark, ids.first_year, "12023") is None
    assert one(spark, ids.first_page, "L123-130") == "l123"
    assert one(spark, ids.first_page, "see there") is None
    assert one(spark, ids.ref_signature, "short title") is None
    assert one(spark, ids.ref_signature, "one two three four five six seven eight nine") == "one-two-three-four-five-six-seven-eight"


def test_keys(spark):
    assert one(spark, ids.namespace, "doi:10.1/a:b") == "doi" and one(spark, ids.local_id, "doi:10.1/a:b") == "10.1/a:b"
    assert one(spark, ids.namespace, "ABCD1234") is None and one(spark, ids.is_external, "x:1") is False


def test_hash_index_wraps_as_a_32_bit_hash(spark):
    def reference(text, size):
        h = 0
        for c in text:
            h = (31 * h + ord(c)) & 0xFFFFFFFF
        h -= (h >> 31) << 32
        return h % size

    for text in ("", "a", "doi:10.99777/universal.1", "zzzzzzzzzzzzzzzzzzzz"):
        assert one(spark, lambda c: ids.hash_index(c, 12), text) == reference(text, 12)


def test_scores(spark):
    assert one(spark, lambda c: scores.gap_score(F.lit(4), c), None, "bigint") == 4.0
    assert one(spark, lambda c: scores.global_radius(c, F.lit(100)), 10**9, "bigint") == 28.0


REFS = {
    "ieee": '[{n}] A. Author, "A long title about the thing number {n} and more," J. Appl. Phys., vol. {n}, pp. 25{n}, 20{n}.',
    "apa": "Author, A. B. (20{n}). A long title about the thing number {n} and more. Journal of Things, {n}, 12.",
}


@pytest.mark.parametrize("style", REFS)
def test_reference_sections(style):
    entries = [REFS[style].format(n=n) for n in range(11, 19)]
    text = "Some body text that goes on. " * 40 + "\nReferences\n" + "\n\n".join(entries)
    section, flat, quality = references.section_of(text)
    assert quality == "heading" and "Some body" not in section and "\n" not in flat
    found, layout = references.split_entries(section)
    assert len(found) == 8 and references.style_of(found) == style
    parsed = references.parse_entry(found[0], style)
    assert parsed["title"].startswith("A long title about the thing number 11") and parsed["year"] == 2011 and parsed["surname"] == "Author"


def test_sections_without_references():
    assert references.section_of(None) == ("", "", "none") and references.section_of("short")[2] == "none"
    assert references.section_of("word " * 100)[2] == "tail"
    assert references.split_entries("") == ([], "none")
    numbered = "Body text without numbers. " * 60 + "\n" + "\n".join(f"[{i}] Someone wrote the work number {i} in 20{i + 10}." for i in range(1, 9))
    assert references.section_of(numbered)[2] == "numbered"


def test_title_screen_equals_plain_search():
    import random

    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    titles = [(str(i), " ".join(rng.choices(words, k=rng.randint(1, 7)))) for i in range(120)]
    screen = references.Titles(titles)
    for _ in range(40):
        text = " ".join(rng.choices(words, k=80))
        assert [(k, t) for k, t, _ in screen.contained(text)] == sorted((k, t) for k, t in titles if t in text)
