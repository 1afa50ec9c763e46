"""PII replaced by surrogates, in DataFrame functions only.

An entity is an e-mail address, phone number, IP address (4 or 6), card number, IBAN,
social security number, secret, or a given name or surname. What it *is* does not hang
on how it is written: a phone number is its national digits, a card or IBAN its
characters without separators, an e-mail address its lower-case form. A keyed digest of
type and identity gives the surrogate, which is then written in the form of the place:
digits become digits, letters letters of the same case, separators and country codes
stay, card numbers stay valid. So one number in three formats is one other number in the
same three formats.

Names become names of the same gender and script. A document's names are found by a
title, which covers all capitalised words after it (the last one is the surname), or by
a known given name before a capitalised word; then every place of these words in the
document is replaced. Known are the given names below and those learned from the corpus:
words that stand between a title and a surname in ``EVIDENCE`` different texts, or that
stand before a surname known from titles in as many texts and in half of all capitalised
pairs they begin.

All identities and surrogates of the corpus are compared: where two would share one, or
one equals an identity that really occurs, the later gets the next digest, until all
differ. Names have few replacements by nature; one that finds no free name gets a double
name, then a numbered one.

Cases: null and empty texts stay as they are; a text without entities is unchanged
to the byte; repeated rows are changed alike; whole texts are searched, however long; an
empty table gives an empty table; of identities that would share a surrogate the smallest
keeps it; a word that is given name and surname in one document counts as surname; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.sizes import BROADCAST_ROWS, broadcast_if_small
from rankloom.session import materialise

#: Given names by gender and script, known from the start and used as surrogates.
GIVEN = {
    "name_f_latin": "Charlotte Elizabeth Margaret Katherine Jennifer Patricia Victoria Dorothy Jessica Rebecca "
    "Isabella Penelope Josephine Gwendolyn Beatrice Rosalind Philippa Henrietta Cordelia Millicent "
    "Mary Anna Maria Sarah Emma Julia Laura Sofia Fatima Aisha Priya Ananya Yuki Mei Ingrid Agnieszka Claire Camille",
    "name_m_latin": "William Robert Christopher Benjamin Frederick Nicholas Alexander Timothy Michael Richard "
    "Zachary Maximilian Cornelius Augustus Bartholomew Humphrey Percival Montgomery Thaddeus Leopold "
    "John James David Thomas Peter Paul Carlos Miguel Ahmed Mohammed Ravi Arjun Hiroshi Wei Hans Krzysztof Pierre Luca",
    "name_f_cyrillic": "Екатерина Анастасия Людмила Светлана Надежда Валентина Маргарита Вероника Мария Анна Ольга",
    "name_m_cyrillic": "Александр Владимир Николай Дмитрий Константин Григорий Станислав Вячеслав Иван Пётр Сергей",
}
#: Words before a name that tell its gender.
TITLES = {
    "f": "Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|госпожа|г-жа",
    "m": "Mr|Herr|Monsieur|Señor|Sr|господин|г-н",
    "x": "Dr|Prof|Professor",
}
#: First and second halves of surrogate surnames.
SURNAMES = {
    "surname_latin": (
        "Ash Black Car Drum Ells Fair Gallo Hath Ingle Jar King Lock Mont North Os Pember Quim Raven Shef Thorn "
        "Under Vander Whit Yar",
        "worth wood michael mond bury field ford ham ton ley den well",
    ),
    "surname_m_cyrillic": ("Абрам Богдан Гаврил Демид Ефим Захар Игнат Карп Лукьян Макар Назар Остап", "ов кин енков"),
    "surname_f_cyrillic": ("Абрам Богдан Гаврил Демид Ефим Захар Игнат Карп Лукьян Макар Назар Остап", "ова кина енкова"),
}
#: Texts in which a word has to be seen as a name before it counts as one elsewhere.
EVIDENCE = 3

_ALL_GIVEN = "|".join(n for names in GIVEN.values() for n in names.split())
_ALL_TITLES = "|".join(TITLES.values())
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_UNTITLED = rf"(?!(?:{_ALL_TITLES})\b){_WORD}"
#: Capitalised words in a row, with the title before them; those without a title are two at least.
NAMED = (
    rf"(?=[\p{{Lu}}г])(?<!\p{{L}})(?:(?:{_ALL_TITLES})\.? {_UNTITLED}(?: {_UNTITLED}){{0,2}}+"
    rf"|{_UNTITLED}(?: {_UNTITLED})++)(?!\p{{L}})"
)
#: What only looks like an entity; it stays as it is.
NOT_AN_ENTITY = "none"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: (type, what may stand before, pattern, what may stand after); the first that matches at a place is taken.
PATTERNS = [
    ("email", r"(?<![\w.+%-])", r"[A-Za-z0-9][\w.+%-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.?[A-Za-z]{2,}", ""),
    ("secret", "", r"(?i:(?=[apst])(?<![\w-])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s?[=:]\s?[\"']?)[A-Za-z0-9_\-/+]{8,}", ""),
    ("key", r"(?<![A-Za-z0-9])", r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})", r"(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d-])", r"\d{3}-\d{2}-\d{4}", r"(?![\d-])"),
    ("ip", r"(?<![\d.])", rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"(?![\d]|\.\d)"),
    ("ip6", r"(?<![\w:.])", rf"[23Ff][0-9A-Fa-f]{{3}}(?:(?::{_HEX}){{7}}|(?::{_HEX}){{0,5}}+::(?:{_HEX}(?::{_HEX}){{0,5}}+)?)", r"(?![\w:])"),
    ("phone", r"(?<![\d\p{L}])", r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", r"(?!\d)"),
    ("phone", r"(?<![\d\p{L}+])", r"\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}", r"(?!\d)"),
    ("phone", r"(?<![\d\p{L}.,/-])", r"0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|0[1-9](?:[ .]\d{2}){4}", r"(?![\d-])"),
    # Ten digits in a row are a phone number only after a word that says so.
    ("phone", r"(?=[2-9])(?<=(?i:phone|tel|call|called|mobile|cell|fax|whatsapp|sms)[ .:]{1,3}(?:me |us |him |her |them |number )?(?:at |on )?)", r"[2-9]\d{2}[2-9]\d{6}", r"(?!\d)"),
    ("card", r"(?<![\d-])", r"(?:2[2-7]|[3-6]\d)\d\d(?:[ -]\d{4}){2}[ -]\d{1,4}(?:[ -]\d{1,3})?|3[47]\d\d[ -]\d{6}[ -]\d{5}|4\d{12}(?:\d{3}){0,2}|(?:5\d|2[2-7])\d{14}|3[47]\d{13}|3[0689]\d{12}|6\d{15,18}", r"(?![\d-])"),
]
# The cheap look at the first letter comes first, so that the long list is rarely tried.
_GIVEN_PLACE = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_ALL_GIVEN})(?!\p{{L}})"
ENTITY = "|".join(f"{before}(?:{core}){after}" for _, before, core, after in PATTERNS) + f"|{_GIVEN_PLACE}"
#: What every entity but a name has in or before it.
HINT = rf"[0-9@=:]|{_GIVEN_PLACE}"
#: Country codes of phone numbers: one or two digits where so assigned, else three.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def kind(value: Column) -> Column:
    """The type of an entity that is not a name of its document, with gender and script for given names."""
    out = None
    for name, names in GIVEN.items():
        test = value.isin(names.split())
        out = F.when(test, name) if out is None else out.when(test, name)
    for name, _, core, _ in PATTERNS:
        # A look at what stands around an entity is not possible here.
        test = value.rlike(f"^(?:{core})$")
        if name == "card":  # other long numbers only look like one
            out = out.when(test & (_luhn(value) % 10 != 0), NOT_AN_ENTITY)
        out = out.when(test, name)
    return out.otherwise(NOT_AN_ENTITY)


def identity(kind_: Column, value: Column) -> Column:
    """What an entity is, however it is written."""
    plain = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    digits = F.regexp_replace(F.regexp_replace(value, _COUNTRY, ""), "[^0-9]", "")
    national = F.regexp_replace(digits, "^0+", "")
    return (
        F.when(kind_.isin("email", "ip6"), F.lower(value))
        .when(kind_ == "secret", F.regexp_replace(value, r"^.*[=:]\s?[\"']?", ""))
        .when(kind_ == "phone", F.when(national == "", digits).otherwise(national))
        .when(kind_.isin("card", "iban", "ssn"), plain)
        .otherwise(value)
    )


def _luhn(value: Column) -> Column:
    """The sum whose last digit is 0 for a valid card number."""
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    weighed = F.transform(
        digits, lambda d, i: d.cast("int") * (1 + i % 2) - F.when((i % 2 == 1) & (d.cast("int") > 4), 9).otherwise(0)
    )
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + b)


def _with_check_digit(value: Column) -> Column:
    body = F.substring(value, F.lit(1), F.length(value) - 1)
    return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))


def digest(key: str, kind_: Column, value: Column, attempt: Column) -> Column:
    """128 hex digits that only the holder of the key can compute."""
    parts = [F.lit(key), kind_, value, attempt.cast("string")]
    return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(str(k)), *parts), 256) for k in range(2)))


def _like(value: Column, hexes: Column, keep: int = 0) -> Column:
    """A text of the same form: digit for digit, letter for letter of the same case. The first ``keep`` stay."""
    digits = F.translate(hexes, "abcdef", "274953")
    letters = F.translate(hexes, "0123456789", "ghkmnprstv")

    def one(char: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(128)) + 1
        letter = F.substring(letters, at, F.lit(1))
        return (
            F.when(i < keep, char)
            .when(char.rlike("^[0-9]$"), F.substring(digits, at, F.lit(1)))
            .when(char.rlike("^[a-z]$"), letter)
            .when(char.rlike("^[A-Z]$"), F.upper(letter))
            .otherwise(char)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _hex_like(value: Column, hexes: Column, keep: int) -> Column:
    """Hex digit for hex digit; the first ``keep`` characters stay."""
    chars = F.transform(
        F.split(value, ""),
        lambda c, i: F.when((i < keep) | (c == ":"), c).otherwise(F.substring(hexes, i + 1, F.lit(1))),
    )
    return F.array_join(chars, "")


def _number(hexes: Column, start: int, length: int = 8) -> Column:
    return F.conv(F.substring(hexes, start, length), 16, 10).cast("long")


def _pick(names: str, hexes: Column, start: int) -> Column:
    pool = names.split()
    return F.element_at(F.array(*map(F.lit, pool)), (_number(hexes, start) % len(pool) + 1).cast("int"))


def _name(parts: list[str], hexes: Column, attempt: Column) -> Column:
    """A name of one word of each part; a double one, then a numbered one, where names are used up."""
    one, two = (F.concat(*(_pick(p, hexes, s + 16 * i) for i, p in enumerate(parts))) for s in (1, 49))
    number = _number(hexes, 97).cast("string")
    return (
        F.when(attempt < 4, one)
        .when(attempt < 8, F.concat_ws("-", one, two))
        .otherwise(F.concat_ws("-", one, number))
    )


def surrogate(key: str, kind_: Column, ident: Column, attempt: Column) -> Column:
    """The identity of the surrogate of an identity."""
    hexes = digest(key, kind_, ident, attempt)
    local = F.substring_index(ident, "@", 1)
    host = F.concat(F.lit("mail"), (_number(hexes, 33) % 100).cast("string"), F.lit(".example.org"))
    hex_like = F.substring(hexes, F.lit(1), F.length(ident))
    secret_like = F.when(ident.rlike("^[0-9A-F]{8,128}$"), F.upper(hex_like)).when(
        ident.rlike("^[0-9a-f]{8,128}$"), hex_like
    ).otherwise(_like(ident, hexes))
    octets = [(_number(hexes, 1 + 8 * k) % (254 if k else 223) + 1).cast("string") for k in range(4)]
    number = _like(ident, hexes)
    out = (
        F.when(kind_ == "email", F.concat(_like(local, hexes), F.lit("@"), host))
        .when(kind_ == "secret", secret_like)
        .when(kind_ == "iban", _like(ident, hexes, keep=2))
        .when(kind_ == "ip", F.concat_ws(".", *octets))
        .when(kind_ == "ip6", _hex_like(ident, hexes, keep=4))
        .when(kind_ == "card", _with_check_digit(_like(ident, hexes, keep=1)))
        # A zero in front would be taken for a trunk prefix.
        .when(kind_ == "phone", F.when(ident.rlike("^0"), number).otherwise(F.regexp_replace(number, "^0", "4")))
    )
    for name, names in GIVEN.items():
        out = out.when(kind_ == name, _name([names], hexes, attempt))
    for script in ("latin", "cyrillic"):
        both = GIVEN[f"name_f_{script}"] + " " + GIVEN[f"name_m_{script}"]
        out = out.when(kind_ == f"name_x_{script}", _name([both], hexes, attempt))
    for name, halves in SURNAMES.items():
        out = out.when(kind_ == name, _name(list(halves), hexes, attempt))
    return out.otherwise(number)


def written(kind_: Column, value: Column, new: Column) -> Column:
    """The identity ``new`` in the form of ``value``."""
    # From the end on, so that a country code or trunk prefix is what is left over.
    backwards = F.reverse(new)

    def step(done: Column, char: Column) -> Column:
        take = char.rlike("^[0-9A-Za-z]$") & (done["at"] <= F.length(new))
        put = F.when(take, F.substring(backwards, done["at"], F.lit(1))).otherwise(char)
        return F.struct(F.concat(done["out"], put).alias("out"), (done["at"] + take.cast("int")).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    woven = F.reverse(F.aggregate(F.split(F.reverse(value), ""), start, step, lambda done: done["out"]))
    local = F.zip_with(
        F.split(F.substring_index(value, "@", 1), ""),
        F.split(F.substring_index(new, "@", 1), ""),
        lambda a, b: F.when(a.rlike("^[A-Z]$"), F.upper(b)).otherwise(b),
    )
    return (
        F.when(kind_.isin("phone", "card", "iban", "ssn"), woven)
        .when(kind_ == "email", F.concat(F.array_join(local, ""), F.lit("@"), F.substring_index(new, "@", -1)))
        .when(kind_ == "secret", F.concat(F.regexp_extract(value, r"^(.*[=:]\s?[\"']?)", 1), new))
        .when((kind_ == "ip6") & (value == F.upper(value)), F.upper(new))
        .otherwise(new)
    )


def mapping(found: DataFrame, key: str, tries: int = 64) -> DataFrame:
    """(ident, kind, surrogate) for the distinct identities (ident, kind): surrogates differ
    from each other and from every identity that occurs.

    A share p of a format's space that is in use leaves p ** tries of the identities without a
    free surrogate, so only a space that is nearly full ends in an error.
    """
    new = surrogate(key, F.col("kind"), F.col("ident"), F.col("attempt"))
    table = materialise(found.withColumn("attempt", F.lit(0)).withColumn("surrogate", new), "surrogates")
    for attempt in range(1, tries + 1):
        # Of those with one surrogate the smallest identity keeps it; a surrogate that itself occurs goes.
        keeps = table.groupBy("surrogate").agg(F.min(F.struct("ident", "kind")).alias("first"), F.count("*").alias("n"))
        shared = keeps.where("n > 1").select("surrogate", "first")
        real = table.select(F.col("ident").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        marked = table.join(shared, "surrogate", "left").join(real, "surrogate", "left").withColumn(
            "clash",
            F.coalesce("real", F.lit(False))
            | F.coalesce(F.struct("ident", "kind") != F.col("first"), F.lit(False)),
        )
        if marked.where("clash").isEmpty():
            return table
        again = marked.withColumn("attempt", F.when(F.col("clash"), F.lit(attempt)).otherwise(F.col("attempt")))
        renewed = F.when(F.col("clash"), new).otherwise(F.col("surrogate"))
        table = materialise(again.select("ident", "kind", "attempt", renewed.alias("surrogate")), "surrogates")
    raise ValueError(f"surrogates still collide after {tries} tries: a format's space is nearly used up")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _surname(word: Column) -> Column:
    gender = F.when(word.rlike("[ая]$"), "surname_f_cyrillic").otherwise("surname_m_cyrillic")
    return F.when(_script(word) == "cyrillic", gender).otherwise("surname_latin")


def _listed_gender(word: Column) -> Column:
    """The gender of a given name of the list, else null."""
    by = {g: " ".join(v for k, v in GIVEN.items() if k.startswith(f"name_{g}")).split() for g in "fm"}
    return F.when(word.isin(by["f"]), "f").when(word.isin(by["m"]), "m")


def names_of(texts: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """(h, size, names) for the texts (h, size, text) in which names are found; names are (word, kind)."""
    id_ = ["h", "size"]
    rows = texts.select(*id_, F.regexp_extract_all("text", F.lit(NAMED), F.lit(0)).alias("rows"))
    rows = rows.where(F.size("rows") > 0).dropDuplicates(id_).select(*id_, F.explode(F.array_distinct("rows")).alias("row"))
    title = F.regexp_extract("row", rf"^({_ALL_TITLES})\.? ", 1)
    gender = F.lit(None).cast("string")
    for name, titles in TITLES.items():
        gender = F.when(title.isin(titles.split("|")), name).otherwise(gender)
    words = F.split(F.regexp_replace("row", rf"^(?:{_ALL_TITLES})\.? ", ""), " ")
    rows = materialise(rows.select(*id_, gender.alias("gender"), words.alias("words")), "name_rows")

    # With a title: the last word is a surname, unless it stands alone and is a known given name.
    titled = rows.where("gender IS NOT NULL").select(*id_, "gender", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    alone = (F.col("n") == 1) & _listed_gender(F.col("word")).isNotNull()
    titled = titled.withColumn("last", (F.col("at") == F.col("n") - 1) & ~alone)
    surnames = titled.where("last").groupBy("word").agg(F.countDistinct(*id_).alias("n")).where(F.col("n") >= evidence)
    surnames = materialise(surnames.select(F.col("word").alias("second")), "surnames")
    given = titled.where("NOT last").groupBy("word").agg(
        F.countDistinct(*id_).alias("n"),
        F.sum(F.when(F.col("gender") == "f", 1).when(F.col("gender") == "m", -1).otherwise(0)).alias("lean"),
    )
    leans = F.when(F.col("lean") > 0, "f").when(F.col("lean") < 0, "m").otherwise("x")
    given = given.where(F.col("n") >= evidence).select(F.col("word").alias("first"), leans.alias("by_title"))

    # Without one: the pairs of neighbours.
    places = F.sequence(F.lit(0), F.size("words") - 2)
    neighbours = F.transform(places, lambda i: F.struct(F.get("words", i).alias("first"), F.get("words", i + 1).alias("second")))
    pairs = rows.where("gender IS NULL").select(*id_, F.explode(neighbours).alias("pair")).select(*id_, "pair.*")
    pairs = materialise(pairs, "name_pairs")
    seen = pairs.join(broadcast_if_small(surnames).withColumn("known", F.lit(1)), "second", "left")
    before = seen.groupBy("first").agg(
        F.count("*").alias("n"),
        F.count("known").alias("hits"),
        F.countDistinct(F.when(F.col("known") == 1, F.struct(*id_))).alias("texts"),
    )
    before = before.where((F.col("texts") >= evidence) & (2 * F.col("hits") >= F.col("n"))).select("first")
    learned = materialise(
        given.join(before, "first", "full").select("first", F.coalesce("by_title", F.lit("x")).alias("learned")), "given"
    )
    listed = _listed_gender(F.col("first"))
    paired = pairs.join(broadcast_if_small(learned), "first", "left").withColumn("gender", F.coalesce(listed, "learned"))
    paired = paired.where("gender IS NOT NULL")

    def given_kind(word: str) -> Column:
        by_list = _listed_gender(F.col(word))
        return F.concat(F.lit("name_"), F.coalesce(by_list, "gender"), F.lit("_"), _script(F.col(word)))

    titled_kind = F.when(F.col("last"), _surname(F.col("word"))).otherwise(given_kind("word"))
    both = F.array(
        F.struct(F.col("first").alias("word"), given_kind("first").alias("kind")),
        # The word after a given name may be a second given name.
        F.struct(
            F.col("second").alias("word"),
            F.when(_listed_gender(F.col("second")).isNotNull(), given_kind("second")).otherwise(_surname(F.col("second"))).alias("kind"),
        ),
    )
    every = titled.select(*id_, "word", titled_kind.alias("kind")).unionByName(
        paired.select(*id_, F.explode(both).alias("name")).select(*id_, "name.*")
    )
    # "surname_..." sorts behind "name_...", so it is the one that stays.
    every = every.groupBy(*id_, "word").agg(F.max("kind").alias("kind"))
    return every.groupBy(*id_).agg(F.array_sort(F.collect_list(F.struct("word", "kind"))).alias("names"))


def replace(docs: DataFrame, key: str, evidence: int = EVIDENCE) -> DataFrame:
    """The documents with every entity replaced; all other columns as they are."""
    columns = docs.columns
    name = "_surrogate_parts"
    while any(c.startswith(name) for c in columns):
        name += "_"
    whole = F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("size"))
    texts = docs.where("text IS NOT NULL").select(whole.alias("id"), "text").select("id.*", "text")
    names = materialise(names_of(texts, evidence), "names")
    # A row holds all names of a text, so what bounds a broadcast is the number of words, not of rows.
    words = names.agg(F.sum(F.size("names"))).first()[0] or 0
    names = names.select(F.struct("h", "size").alias(name), F.col("names").alias(f"{name}n"))
    named = docs.withColumn(name, whole).join(F.broadcast(names) if words <= BROADCAST_ROWS else names, name, "left")
    # Every place of a document's names; the words hold nothing that a pattern could misread.
    own = F.array_join(F.transform(f"{name}n", lambda n: n["word"]), "|")
    pattern = F.when(
        F.col(f"{name}n").isNotNull(), F.concat(F.lit(ENTITY + r"|(?=\p{Lu})(?<!\p{L})(?:"), own, F.lit(r")(?!\p{L})"))
    ).otherwise(F.lit(ENTITY))
    has = F.coalesce(
        F.col(f"{name}n").isNotNull() | (F.col("text").rlike(HINT) & F.col("text").rlike(ENTITY)), F.lit(False)
    )
    touched = named.where(has).withColumn(f"{name}p", pattern)
    lists, _ = _lists(
        touched.select(
            f"{name}.*", F.col(f"{name}n").alias("names"), F.regexp_extract_all("text", F.col(f"{name}p"), F.lit(0)).alias("values")
        ),
        key,
    )
    lists = lists.select(F.struct("h", "size").alias(name), F.col("found").alias(f"{name}f"))
    # The text between entities and their surrogates, one after the other.
    between = F.split(F.col("text"), F.col(f"{name}p"), -1)
    new = F.array_join(
        F.zip_with(between, F.col(f"{name}f"), lambda a, b: F.concat(a, F.coalesce(b["surrogate"], F.lit("")))), ""
    )
    done = touched.join(lists, name).withColumn("text", new).select(columns)
    return named.where(~has).select(columns).unionByName(done)


def _lists(texts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(entities of each text (h, size, names, values) with their surrogates in order, the whole mapping)."""
    found = texts.dropDuplicates(["h", "size"]).select("h", "size", "names", F.posexplode("values").alias("at", "value"))
    own = F.get(F.filter("names", lambda n: n["word"] == F.col("value")), 0)["kind"]
    found = found.select("h", "size", "at", "value", F.coalesce(own, kind(F.col("value"))).alias("kind"))
    found = materialise(found.withColumn("ident", identity(F.col("kind"), F.col("value"))), "entities")
    named = mapping(found.where(F.col("kind") != NOT_AN_ENTITY).select("ident", "kind").distinct(), key)
    new = written(F.col("kind"), F.col("value"), F.col("surrogate"))
    lists = (
        found.join(named.select("ident", "kind", "surrogate"), ["ident", "kind"], "left")
        .withColumn("surrogate", F.coalesce(new, "value"))
        .groupBy("h", "size")
        .agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("found"))
    )
    return lists, named
