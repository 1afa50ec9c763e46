"""Surrogates against planted entities whose identity is known."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from rankloom.llm import surrogates


def replaced(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = surrogates.replace(docs, "k", **options).collect()
    return [r["text"] for r in sorted(rows)]


def test_titles_cover_whole_names_and_every_place(spark):
    one, two, three = replaced(
        spark,
        [
            "Mrs Ann Lee met Mr. Lee. Lee paid. Ann left. The Leeds road.",
            "Mary Smith, Anna Kowalska, Иван Петров and Priya Raman came. Smith left with Петров.",
            "Dr. Jo O'Neill and Frau Meier-Krause. O'Neill spoke, Ms. Ann did not.",
        ],
    )
    found = re.fullmatch(r"Mrs (\w+) (\w+) met Mr\. (\w+)\. (\w+) paid\. (\w+) left\. The Leeds road\.", one)
    given, *surnames, again = found.groups()
    assert given == again != "Ann" and len(set(surnames)) == 1 and surnames[0] != "Lee"
    assert given in surrogates.GIVEN["name_f_latin"].split()
    for gone in ("Mary", "Smith", "Anna", "Kowalska", "Иван", "Петров", "Priya", "Raman"):
        assert not re.search(rf"\b{gone}\b", two), gone
    assert re.search(r"left with [Ѐ-ӿ]+\.$", two)
    assert "Neill" not in three and "Meier" not in three and "Ann " not in three


def test_names_are_learned_from_the_corpus(spark):
    titled = [f"Mr Zorba Pell came on day {i} and left." for i in range(3)]
    rest = ["Later Zorba Quex arrived. Quex spoke.", "Ilmara Pell sang.", "Then Ilmara Pell sang.", "Ilmara Pell and Ilmara Vonn sang."]
    texts = titled + rest + ["The Pell river. The House. The Old Mill. In The Hague."] * 2
    new = replaced(spark, texts)
    assert not any(re.search(r"Zorba|Quex|Ilmara|Vonn", t) for t in new)
    assert len({re.search(r"Mr (\w+)", t)[1] for t in new[:3]} | {re.search(r"Later (\w+)", new[3])[1]}) == 1
    # Two of eight pairs that begin with "The" have a surname in them: no name.
    assert new[-1] == texts[-1]
    assert replaced(spark, texts, evidence=10)[3] == texts[3]


def test_one_identity_in_many_forms(spark):
    phone, local, cards, six, mail = replaced(
        spark,
        [
            "(415) 555-0134, +1 415-555-0134, 415.555.0134, phone 4155550134; id 5551234567.",
            "020 7946 0958 and +44 20 7946 0958, or 01 23 45 67 89.",
            "3782 822463 10005, 378282246310005, 2221000000000009, 5555-5555-5555-4444, 4000000000000000006, 1234567890123456",
            "2001:db8::8a2e:370:7334, 2001:DB8::8A2E:370:7334, fe80:0:0:0:202:b3ff:fe1e:8329; std::cout, 10:30, a::b",
            "Tom.X@ab.com or tom.x@ab.com; secret: abcdef0123456789, token=\"abcdef0123456789\"",
        ],
    )
    a, b, c, d = re.fullmatch(r"\((\d{3}\) \d{3}-\d{4}), \+1 (\d{3}-\d{3}-\d{4}), (\d{3}\.\d{3}\.\d{4}), phone (\d{10}); id 5551234567\.", phone).groups()
    assert len({re.sub(r"\D", "", x) for x in (a, b, c, d)}) == 1 and "0134" not in phone
    a, b, c = re.fullmatch(r"(0\d\d \d{4} \d{4}) and (\+44 \d\d \d{4} \d{4}), or (0\d(?: \d\d){4})\.", local).groups()
    assert a.lstrip("0") == b[4:] and "7946" not in local and c != "01 23 45 67 89"
    old = re.split(", ", "3782 822463 10005, 378282246310005, 2221000000000009, 5555-5555-5555-4444, 4000000000000000006")
    new = cards.split(", ")
    assert new[5] == "1234567890123456" and new[0].replace(" ", "") == new[1]
    for x, y in zip(old, new):
        assert x != y and re.sub(r"\d", "0", x) == re.sub(r"\d", "0", y)
        digits = [int(q) for q in re.sub(r"\D", "", y)[::-1]]
        assert sum(q if i % 2 == 0 else sum(divmod(2 * q, 10)) for i, q in enumerate(digits)) % 10 == 0
    parts = re.split("[,;] ", six)
    assert parts[0].upper() == parts[1] and parts[0].startswith("2001:") and "370" not in six and "8329" not in six
    assert six.endswith("; std::cout, 10:30, a::b")
    first, second = re.match(r"(\S+) or (\S+);", mail).groups()
    assert first.lower() == second and first[0].isupper() and "ab.com" not in mail
    assert re.search(r"secret: ([0-9a-f]{16}), token=\"([0-9a-f]{16})\"$", mail)[1] == mail[-17:-1] != "abcdef0123456789"


def test_planted_entities_map_one_to_one(spark):
    rng = random.Random(5)
    people = [(t, f"{a}{b}", f"{c}{d}") for t, a in (("Mrs", "Al"), ("Mr", "Bo")) for b in ("ra", "nto", "vik") for c in ("Kor", "Mun") for d in ("bach", "sky")]
    numbers = [f"{rng.randrange(201, 990)}{rng.randrange(201, 990)}{rng.randrange(1000, 9999)}" for _ in range(40)]
    forms = ["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "+1 {} {} {}"]
    texts, truth = [], []
    for _ in range(60):
        (title, given, surname), number = rng.choice(people), rng.choice(numbers)
        form = rng.choice(forms).format(number[:3], number[3:6], number[6:])
        texts.append(f"it was {title} {given} {surname} who rang {form} today. {surname} was kind; {given} too.")
        truth.append((title, given, surname, number))
    new = replaced(spark, texts)
    pattern = r"it was (Mrs?) (\S+) (\S+) who rang (.+) today\. (\S+) was kind; (\S+) too\."
    maps: dict[str, dict] = {"given": {}, "surname": {}, "number": {}}
    for (title, given, surname, number), text, old in zip(truth, new, texts):
        kept, g, s, form, s2, g2 = re.fullmatch(pattern, text).groups()
        assert (kept, s, g) == (title, s2, g2)
        assert re.sub(r"\d", "0", form) == re.sub(r"\d", "0", re.fullmatch(pattern, old)[4])
        for name, was, now in (("given", given, g), ("surname", surname, s), ("number", number, re.sub(r"\D", "", form)[-10:])):
            assert maps[name].setdefault(was, now) == now != was
    for one in maps.values():
        assert len(set(one.values())) == len(one) and not set(one) & set(one.values())
    for given, now in maps["given"].items():
        pool = surrogates.GIVEN["name_f_latin" if given.startswith("Al") else "name_m_latin"].split()
        assert set(now.split("-")) <= set(pool)


def test_full_spaces_and_long_texts(spark):
    found = spark.createDataFrame([(f"{i}", "short") for i in range(10, 30)], "ident string, kind string")
    rows = surrogates.mapping(found, "k").collect()
    assert len({r["surrogate"] for r in rows}) == 20 and not {r["surrogate"] for r in rows} & {r["ident"] for r in rows}
    text = "Nothing is here. " * 60_000 + "Mail me at long.text@somewhere.org now. " + "End of it. " * 1000
    (new,) = replaced(spark, [text])
    assert "somewhere" not in new and len(new) > 1_000_000 and new.startswith("Nothing is here. " * 60_000)


def test_names_beyond_the_broadcast_limit_are_joined_by_a_shuffle(spark, monkeypatch):
    texts = ["Mrs Ann Lee met Mr. Lee.", "Nobody came.", "Later Mary Smith left a@b.example.com."]
    small = replaced(spark, texts)
    monkeypatch.setattr(surrogates, "BROADCAST_ROWS", 0)
    assert replaced(spark, texts) == small != texts


def test_nothing_is_found_in_no_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, _surrogate_parts string, h long, names string, ident string")
    assert surrogates.replace(docs, "k").count() == 0 and surrogates.replace(docs, "k").columns == docs.columns
    full = spark.createDataFrame([(1, "Mr Lee called.", "a", 2, "b", "c"), (1, "Mr Lee called.", "a", 2, "b", "c")], docs.schema)
    rows = surrogates.replace(full, "k").select(F.col("text"), "_surrogate_parts", "h", "names", "ident").collect()
    assert len(set(rows)) == 1 and len(rows) == 2 and tuple(rows[0])[1:] == ("a", 2, "b", "c") and "Lee" not in rows[0][0]
