"""What the prefilter lets through, and names that come more than once."""

import sys

from citesift.llm import pii

# One entity or more of each pattern, and honorifics in each case.
HITS = {
    "secret": ["pwd=hunterabc", "see pwd: correcthorse here", "PWD = hunterabc", "api-key: abcdefgh", "ſecret=abcdefgh", "toKen=abcdefgh"],
    "key": ["AKIASJDZWJNPAZRYWK"],
    "email": ["a@b.cd"],
    "iban": ["AB12ABCDEFGH", "AB12 CDEF GHIJ"],
    "ip": ["1.2.3.4"],
    "card": ["4111111111111111"],
    "phone": ["+1 22 33", "(988) 555-2485", "٩٨٨-٥٥٥-٢٤٨٥"],
    "name": [f"{f(h)}{dot} Lopez" for h in pii._GENDER for f in (str.lower, str.upper, str.title) for dot in ("", ".")]
    + ["Господин Иванов пришёл", "Госпожа Петрова", "SEÑORA Lopez", "Mıss Lopez", "Mİss Lopez", "Mrſ Lopez", "5 Mr Lopez", "é, Mr Lopez"],
}


def _passed(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r.text for r in rows.filter(rows.text.rlike(pii.MAYBE)).collect()]


def test_prefilter_passes_every_text_with_a_hit(spark):
    for kind, texts in HITS.items():
        for text in texts:
            assert kind in {k.split("-")[0] for _, _, k, _ in pii.detect(text)}, text
    texts = [t for ts in HITS.values() for t in ts]
    assert _passed(spark, texts) == texts
    assert _passed(spark, ["a plain text", "the items are here", "1 and 2", "", "Mrx Lopez"]) == []


def test_prefilter_knows_every_digit(spark):
    digits = [c * 3 for c in map(chr, range(sys.maxunicode + 1)) if c.isdecimal()]
    assert len(_passed(spark, digits)) == len(digits)


def _entities(text):
    return [e for _, _, _, e in pii.detect(text)]


def test_names_end_at_small_words_and_come_again():
    text = "Mr Smith said hello. Mr Smith went home. Mr. Smith, aged. Later Smith left, SMITH's smithy."
    assert _entities(text) == ["Smith"] * 4 + ["SMITH"]
    assert _entities("Mr. J. Smith met Mrs Ann Lee-Jones and Mr and Mrs. O'Neil. He") == ["J. Smith", "Ann Lee-Jones", "O'Neil"]
    assert _entities("Herr Dr. Ludwig van Beethoven kam. Beethoven ging.") == ["Ludwig van Beethoven", "Beethoven"]
    assert _entities("I miss you. You miss you") == ["you", "you"]
    assert _entities("Mr John Smith. Then John Smith, Johnson and John") == ["John Smith", "John Smith", "John"]


def test_one_person_keeps_one_surrogate(spark):
    texts = [
        "Mr John Smith came. Mr Smith said hello; Mr. J. Smith, aged 50, and later Smith's dog. Mrs Smith too",
        "Mr. Smith again, Mr. Jones and Госпожа Зоя Петрова, Mr. K. Smith",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_entities(docs, b"key").collect()}
    assert [got[i].n_entities for i in (0, 1)] == [5, 4]
    words = [got[i].text.replace(",", " ").replace(";", " ").replace(".", " ").replace("'", " ").split() for i in (0, 1)]
    one, two = words
    smith = one[2]
    assert one[1] in pii.GIVEN["LATIN", "m"] and smith != "Smith" and smith.istitle()
    assert one[3:6] == ["came", "Mr", smith] and one[6:9] == ["said", "hello", "Mr"]
    assert one[9] != "J" and one[10:17] == [smith, "aged", "50", "and", "later", smith, "s"]
    assert one[-2] not in ("Smith", smith)
    assert two[:3] == ["Mr", smith, "again"] and two[-1] == smith and two[-2] not in ("K", one[9])
    assert two[4] not in ("Jones", smith) and two[7] in pii.GIVEN["CYRILLIC", "f"]
    assert "Smith" not in got[0].text + got[1].text and "Петрова" not in got[1].text
