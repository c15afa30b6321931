"""Benchmark items among variants of themselves, poor in words, and in another case or layout."""

import pytest

from terrasift.llm.templates import find_leaks

APPLES = "Tom has 5 apples and gives 2 to Mary. How many apples does he have left?"
SUM = "What is 12 + 45 * 3 - 7 / 2?"
ITEMS = [(1, APPLES), (2, SUM), (3, "Name three primes")]
BODY = "so says the book. {} And then it went on with other words that nobody needs"


def variant(a, b, name):
    return APPLES.replace("5", a).replace("2", b).replace("Mary", name)


@pytest.fixture(scope="module")
def leaks(spark):
    def of(texts):
        items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
        docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
        return {r["doc_id"]: r for r in find_leaks(docs, items).collect()}

    return of


def test_several_variants_in_a_document(leaks):
    sheet = " ".join(variant(str(k), str(k + 9), n) for k, n in ((9, "Zoe"), (30, "Ann"), (41, "Eve"), (77, "Ida")))
    got = leaks({"one": BODY.format(variant("9", "1", "Zoe")), "both": BODY.format(APPLES + " " + variant("9", "1", "Zoe")), "sheet": BODY.format(sheet)})
    assert all(r["contaminated"] and r["item_id"] == 1 and r["share"] == 1.0 for r in got.values())
    assert got["sheet"]["other_values"]


def test_items_poor_in_plain_words(leaks):
    got = leaks({"sum": BODY.format(SUM), "short": BODY.format(ITEMS[2][1] + "."), "other": BODY.format(SUM.replace("45", "46")), "words": "what is it that he names"})
    assert got["sum"]["contaminated"] and got["sum"]["item_id"] == 2
    assert got["short"]["contaminated"] and got["short"]["item_id"] == 3
    assert not got["other"]["contaminated"] and not got["words"]["contaminated"]


def test_another_case_or_layout(leaks):
    forms = {"lower": APPLES.lower(), "upper": APPLES.upper(), "title": APPLES.title(), "lines": APPLES.replace(" ", "\n")}
    got = leaks({k: BODY.format(t) for k, t in forms.items()} | {"heading": "Exercise\n" + APPLES})
    assert all(r["contaminated"] and r["item_id"] == 1 and r["share"] == 1.0 for r in got.values())
