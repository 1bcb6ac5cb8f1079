import re

import pytest
from pyspark.sql import functions as F

from verdigraph.llm import surrogates

DOCS = [
    (1, "Mail the.72@mail3.example.com or THE.72@MAIL3.EXAMPLE.COM, call +1 (017) 555-7713 or +10175557713."),
    (2, 'card 4952935900253052 and 4952-9359-0025-3052 ip 169.122.221.182, token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" TOKEN = "9C8B45435718DCC700C184A7E303CDC64C6A8F7F"!!'),
    (3, "Mr. John Smith met Mrs. Smith, Mary Jones and Иван Петров. Dr. Klaus Weber came. SSN 123-45-6789 IBAN DE89 3704 0044 0532 0130 00 mac 00:1a:2b:3c:4d:5e"),
    (4, "the.72@mail3.example.com again, other@mail3.example.com too, John Smith alone"),
    (4, "the.72@mail3.example.com again, other@mail3.example.com too, John Smith alone"),
    (None, "call +1 (017) 555-7713"),
    (5, None),
    (6, ""),
    (7, "nothing 12 here, v1.2.3, 10:30, $5, 1999-12-31"),
    (8, "word " * 50_000 + "8.8.8.8"),
    (9, "x" * 100_000),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("new", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("part", F.lit(2))
    out = surrogates.replaced(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len(DOCS)
    assert sorted(map(str, rows)) == sorted(map(str, surrogates.replaced(df.repartition(3)).collect()))
    return {r.doc_id: r.text for r in rows}


def test_entities_go_and_the_rest_stays(got):
    everything = "\n".join(t for t in got.values() if t)
    for old in ("the.72", "mail3", "555-7713", "5557713", "4952935900253052", "9359", "169.122.221.182", "9c8b4543", "9C8B4543", "Smith", "Петров", "123-45-6789", "3704 0044", "1a:2b", "8.8.8.8"):
        assert old not in everything
    assert got[5] is None and got[6] == "" and got[7] == DOCS[8][1] and got[9] == DOCS[10][1]
    assert got[8].startswith("word " * 50_000)


def test_coreference_format_and_type(got):
    mails = re.findall(r"\S+@\S+\.\w+", got[1])
    assert mails[1].lower() == mails[0] and mails[1].isupper()
    assert mails[0] in got[4]
    assert got[4].split("@")[1].split()[0].rstrip(",") == got[4].split("@")[2].split()[0]
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1])[0]
    assert re.sub(r"\D", "", phone) in got[1] and phone in got[None]
    card, same = re.search(r"card (\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4})", got[2]).groups()
    assert same.replace("-", "") == card
    luhn = lambda n: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))) % 10
    assert luhn(card) == luhn("4952935900253052")
    tokens = re.findall(r'"([0-9a-fA-F]{40})"', got[2])
    assert tokens[0].upper() == tokens[1]
    assert all(0 < int(x) < 256 for x in re.search(r"ip ([\d.]+\d)", got[2])[1].split("."))
    he, she, third, fourth = re.match(r"Mr\. (\S+ \S+) met Mrs\. (\S+), (\S+ \S+) and (\S+ \S+)\.", got[3]).groups()
    given = lambda gender, script: {n for n in surrogates.GIVEN[gender, script]}
    assert set(he.split()[0].split("-")) <= given("m", "latin") and he.split()[1] == she
    assert set(third.split()[0].split("-")) <= given("f", "latin")
    assert set(fourth.split()[0].split("-")) <= given("m", "cyrillic") and re.fullmatch(r"[А-Яа-я-]+", fourth.split()[1])
    assert f"{he} alone" in got[4]


def test_collisions_are_drawn_again(spark):
    rows = [("email", f"{a}@b.example.com") for a in "abcdefghijklmnopqrstuvwxyz"] + [("given-m", n) for n in surrogates.GIVEN["m", "latin"]]
    rows += [("ssn", f"{i:09d}") for i in range(200)] + [("title", "Mr."), ("surname", "Smith")]
    got = surrogates.assigned(spark.createDataFrame(rows, "type string, canon string")).collect()
    assert len(got) == len(rows)
    made = {(r.type, r.surrogate) for r in got}
    assert len(made) == len(rows)
    assert not {x for x in made if x[0] != "title"} & set(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert surrogates.digest(df).collect() == []


def test_no_text_with_an_entity_is_skipped(spark):
    starts = sorted({n for group in (*surrogates.GIVEN.values(), *surrogates.HONORIFICS.values()) for n in group})
    texts = [f"x{mark}{start} {'Петров' if start[0] > 'я' or 'А' <= start[0] <= 'я' else 'Müller'}{mark}y" for mark in "„“«¿¡—./*_&|…" for start in starts]
    texts += [f"«{h}. Müller»" for titles in surrogates.HONORIFICS.values() for h in titles]
    texts += ["aa:bb:cc:dd:ee:ff", "AA-BB-CC-DD-EE-FF", "a:b:c:d:e:f:a:b", "ab:ab:ab:ab:ab:ab:ab:ab", "abcd:abc:ab:a:b:c:d:e", "ghp_" + "abcdefgh" * 4, "key sk-" + "abcdefgh" * 3, "xoxb-" + "a" * 16, "ab" * 16, "AB" * 20, "AKIA" + "ABCDEFGH" * 2]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    exact = F.regexp_extract_all("text", F.lit(surrogates.ANY), F.lit(0))
    rows = df.select("text", exact.alias("want"), surrogates.mentions(F.col("text")).alias("got")).collect()
    assert [r.text for r in rows if not r.want] == []
    assert [r.text for r in rows if r.got != r.want] == []


def test_secret_that_starts_with_a_slash(spark):
    df = spark.createDataFrame([(1, 'token="/a9Kz73hQwLm2pR"')], "doc_id long, text string")
    assert "9Kz73hQ" not in surrogates.replaced(df).first().text


def replace_all(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in surrogates.replaced(df).orderBy("doc_id").collect()]


def test_scripts_and_genders_of_surnames(spark):
    greek, woman, man, shouted, cue, jew = replace_all(spark, "Dr Παπαδόπουλος ήρθε", "Анна Иванова пришла", "Иван Иванов пришёл", "JOHN SMITH met John Smith", "Name: Zsofia Nemeth, ok", "Dr Աբրահամյան came")
    assert re.fullmatch(r"Dr [\u0370-\u03ff\u1f00-\u1fff-]+ος ήρθε", greek) and "Παπαδ" not in greek
    she, he = woman.split()[1], man.split()[1]
    assert she == he + "а" and re.search("(ов|ев|ин)$", he) and he != "Иванов"
    loud, soft = re.fullmatch(r"(\S+ \S+) met (\S+ \S+)", shouted).groups()
    assert loud == soft.upper() and "SMITH" not in loud
    assert "Zsofia" not in cue and "Nemeth" not in cue and cue.startswith("Name: ") and cue.endswith(", ok")
    assert re.fullmatch(r"Dr [\u0530-\u058f]+ came", jew) and "Աբրահամյան" not in jew


def test_case_and_check_digits(spark):
    mail, iban, mac = replace_all(spark, "John.Doe@Example.com and john.doe@example.com", "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432", "AA:bb:0C:dd:ee:f1")
    first, second = mail.split(" and ")
    assert first.lower() == second and [c.isupper() for c in first] == [c.isupper() for c in "John.Doe@Example.com"]
    for found in re.findall(r"[A-Z]{2}\d{2}[A-Z0-9 ]{15,}[A-Z0-9]", iban.replace("IBAN ", "").replace(" or", "|")):
        plain = found.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert "GB82WEST" not in iban and "3704" not in iban
    assert re.fullmatch(r"[A-F0-9]{2}:[a-f0-9]{2}:[0-9][A-F]:[a-f]{2}:[a-f]{2}:[a-f][0-9]", mac, re.I)


def test_names_stay_single_when_the_list_is_used_up(spark):
    rows = [("given-f", n) for n in surrogates.GIVEN["f", "latin"]]
    got = [r.surrogate for r in surrogates.assigned(spark.createDataFrame(rows, "type string, canon string")).collect()]
    assert len(set(got)) == len(rows) and sum("-" in x for x in got) < len(rows) / 10


def test_key_decides(spark):
    df = spark.createDataFrame([(1, "Mary Jones")], "doc_id long, text string")
    one, two = (surrogates.replaced(df, k).first().text for k in ("one", "two"))
    assert one != two and one == surrogates.replaced(df, "one").first().text
    assert surrogates.session_key(spark) == surrogates.session_key(spark) != ""


@pytest.fixture(scope="module")
def changed(spark):
    def run(*texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r.text for r in sorted(surrogates.replaced(df, "k").collect(), key=lambda r: r.doc_id)]

    return run


@pytest.mark.parametrize(
    ("text", "shape"),
    [
        ("Then Mr McDonald came.", r"Then Mr \p{Lu}\p{Ll}+(-\p{Lu}\p{Ll}+)? came\."),
        ("Then Mr O'Brien and Mrs O’Neill came.", r"Then Mr \p{Lu}\p{Ll}+ and Mrs \p{Lu}\p{Ll}+ came\."),
        ("Herr von der Leyen sprach.", r"Herr von der \p{Lu}\p{Ll}+ sprach\."),
        ("Peter van den Berg kam.", r"\p{Lu}\p{Ll}+ van den \p{Lu}\p{Ll}+ kam\."),
        ("Mrs Jones-Brown left.", r"Mrs \p{Lu}\p{Ll}+-\p{Lu}\p{Ll}+ left\."),
        ("MR O'BRIEN LEFT", r"MR \p{Lu}+ \p{Lu}+"),
        ("from 2001:db8::1 to fe80::1, std::vector stays", r"from [0-9a-f]{4}:[0-9a-f]{3}::\d to [0-9a-f]{4}::\d, std::vector stays"),
        ("call 020 7946 0958 now", r"call \d{3} \d{4} \d{4} now"),
        ("call +44 20 7946 0958 or +1 (017) 555-7713 or +351 21 1234 567", r"call \+44 \d{2} \d{4} \d{4} or \+1 \(\d{3}\) \d{3}-\d{4} or \+351 \d{2} \d{4} \d{3}"),
    ],
)
def test_detected_in_whole(changed, text, shape):
    import regex

    (new,) = changed(text)
    assert regex.fullmatch(shape, new), new
    for word in regex.findall(r"\p{Lu}\p{L}{3,}|\d{3,}|\p{Lu}['’]\p{L}+", text):
        assert word in ("Then", "Peter", "Herr", "call", "351") or word not in new


def test_lone_surnames_of_named_people(changed):
    first, other = changed("Mrs Smith saw Mr Smith. Later Smith left with Smithson; Smith's dog stayed.", "Smith alone has nobody named here")
    assert "Smith " not in first and "Smith'" not in first and "Smithson" in first
    name = re.match(r"Mrs (\S+) saw", first)[1]
    assert first.count(name) == 4 and f"Later {name} left" in first
    assert other == "Smith alone has nobody named here"


def test_particles_alone_make_no_name(changed):
    texts = ["Der Herr der Ringe ist lang.", "Sie gab Hans den Ball.", "Marie la Grande", "a::b and x::y::z"]
    assert changed(*texts) == texts


def test_no_entity_is_skipped_by_the_look_before(spark):
    texts = ["Herr von der Leyen", "Mr O'Brien", "Mr McDonald", "fe80::1", "020 7946 0958", "MR O'BRIEN", "Peter van den Berg", "„Frau Müller“"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(surrogates.mentions(F.col("t"))).alias("n"))
    assert [r.n for r in df.collect()] == [1] * len(texts)
