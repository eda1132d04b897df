"""Surrogates for personal data: keyed, type-consistent, distinct, the same wherever a value recurs.

Texts are split at their entities, and entities into parts: an address's local part and domain, a person's given name
and surname, a number's digits without separators. Distinct parts form a dictionary, each with a surrogate derived from
the key, its type and itself; an entity is put together again from its parts' surrogates in its own title, separators
and case, so spellings of one value stay one value. Two parts with one surrogate, or a surrogate that is a part of the
corpus, are collisions: all but one of them derive another, until none is left; where a format has too few values,
later attempts are longer, so that ends always. DataFrame operations only; a value that a third of all texts have is one
dictionary row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Entity patterns, titles and given names.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña")
MALE_NAMES = ("Adam", "Bruno", "Carl", "David", "Emil", "Frank", "Georg", "Hugo", "Ivan", "Jonas", "Kurt", "Leon", "Martin", "Noel", "Oskar", "Paul")
FEMALE_NAMES = ("Anna", "Berta", "Clara", "Dora", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula")
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "secret": r"(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;]{6,})",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(MALE_TITLES + FEMALE_TITLES)})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Only texts with one of these can hold an entity.
HINT = rf"[@\d]|(?i:password|passwd|pwd|secret|token|key)|(?:{'|'.join(MALE_TITLES + FEMALE_TITLES)})\.? "
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "äöüéèêáíóúñçàâîôû", "ÄÖÜÉÈÊÁÍÓÚÑÇÀÂÎÔÛ")
HEX = "0123456789abcdef"
#: Characters outside ALPHABETS by class, each with what replaces it; scripts without an alphabet of their own get Latin.
SCRIPTS = (
    (r"\p{IsHan}", "安白北本长成大东方高光国海和华家江金开来李林明南平青山石水天田文王西新阳一永元云中"), (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてと"), (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテト"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조호"), (r"\p{IsArabic}", "ابتثجحخدرزسشصطعفقكلمنهوي"), (r"\p{IsHebrew}", "אבגדהוזחטילמנסעפצקרשת"), (r"[\p{IsArmenian}&&\p{Lu}]", "ԱԲԳԴԵԶԷԹԻԼԽԿՀՁՂՄՅՆՇՈՊՍՎՏՐՑ"),
    (r"\p{IsArmenian}", "աբգդեզէթիլխկհձղմյնշոպսվտրց"), (r"\p{IsDevanagari}", "अआइकखगघचजटडतदनपबमयरलवसह"), (r"\p{IsThai}", "กขคงจชดตทนบปผพมยรลวสห"), (r"\p{IsGeorgian}", "აბგდევზთიკლმნოპრსტუფქშ"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{IsGreek}", "αεηιουωάέήίόύώ"), (r"[\p{IsCyrillic}&&\p{Lu}]", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"), (r"\p{IsCyrillic}", "бвгджзклмнпрстфхцчшщ"),
    (r"\p{Lu}", "BCDFGHJKLMNPQRSTVWXYZ"), (r"\p{L}", "bcdfghjklmnpqrstvwxyz"), (r"\p{N}", "0123456789"),
)
#: From this attempt on a secret gets hexadecimal digits and a given name any letters: their own classes have too few values.
FREE = 4
#: From this attempt on a surrogate is longer than its value, by two characters more with every attempt.
WIDE = 6
DIGITS = ("phone", "card", "ssn", "iban")


def _digits(text: Column) -> Column:
    return _characters(F.regexp_replace(text, r"\D", ""))


def _mod97(iban: Column) -> Column:
    """The remainder that a valid IBAN (letters and digits only) has 1 of: its first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    digits = F.transform(_characters(turned), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string")))
    return F.aggregate(_characters(F.concat_ws("", digits)), F.lit(0), lambda r, d: (r * 10 + d.cast("int")) % 97)


def _type(value: Column) -> Column:
    """The first type that fits; null for card numbers that fail Luhn's rule and IBANs that fail theirs."""
    out = None
    for kind, pattern in PATTERNS.items():
        fits = value.rlike(f"^(?:{pattern})$")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    kind = F.coalesce(out, F.lit("secret"))
    wrong = ((kind == "card") & (_luhn(_digits(value)) % 10 != 0)) | ((kind == "iban") & (_mod97(F.regexp_replace(value, " ", "")) != 1))
    return F.when(~wrong, kind)


def _number(digest: Column, i: Column) -> Column:
    """A number from 0 to 65535 for place i, from the digest's hexadecimal digits."""
    return F.conv(F.substr(digest, F.pmod(i * 3, F.lit(125)) + 1, F.lit(4)), 16, 10).cast("int")


def _luhn(digits: Column) -> Column:
    """Sum by Luhn's rule of an array of digit characters, the last of them counted once."""
    n = F.size(digits)
    each = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _by_class(text: Column, digest: Column, hexadecimal: Column) -> Column:
    """Every character by another of its class: digit, vowel or consonant of its script and case.

    Marks, punctuation and symbols stay."""

    def swap(c, i):
        out = F.when(hexadecimal & F.lit(HEX).contains(c), F.substr(F.lit(HEX), _number(digest, i) % 16 + 1, F.lit(1)))
        for letters in ALPHABETS:
            out = out.when(F.lit(letters).contains(c), F.substr(F.lit(letters), _number(digest, i) % len(letters) + 1, F.lit(1)))
        for fits, letters in SCRIPTS:
            out = out.when(c.rlike(fits), F.substr(F.lit(letters), _number(digest, i) % len(letters) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.concat_ws("", F.transform(_characters(text), swap))


def parts_of(kind: Column, value: Column) -> Column:
    """The value's pieces in order: structs of part (type of what is replaced, null for what stays), canon (the same for
    all spellings) and text. The texts together are the value."""

    def piece(part, canon, text):
        return F.struct(part.alias("part") if isinstance(part, Column) else F.lit(part).cast("string").alias("part"), canon.alias("canon"), text.alias("text"))

    def stays(text):
        return piece(None, text, text)

    local, domain, top = (F.regexp_extract(value, r"^([^@]*)@(.*)(\.\p{L}{2,})$", i) for i in (1, 2, 3))
    email = F.array(piece("local", F.lower(local), local), stays(F.lit("@")), piece("domain", F.lower(domain), domain), stays(top))
    title, given, surname = (F.regexp_extract(value, r"^(\S+ )(?:(\S+) )?(\S+)$", i) for i in (1, 2, 3))
    gender = F.when(title.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\b"), "given-f").otherwise("given-m")
    name = F.when(given == "", F.array(stays(title), piece("surname", surname, surname))).otherwise(F.array(stays(title), piece(gender, given, given), stays(F.lit(" ")), piece("surname", surname, surname)))
    kept = F.regexp_extract(value, r"^(AKIA|[^=:]*[=:]\s*[\"']?)", 1)
    rest = F.substr(value, F.length(kept) + 1)
    phone = F.concat(F.when(value.startswith("+"), "+").otherwise(""), F.regexp_replace(value, r"\D", ""))
    out = F.when(kind == "email", email).when(kind == "name", name).when(kind == "secret", F.array(stays(kept), piece("secret", rest, rest)))
    out = out.when(kind == "phone", F.array(piece("phone", phone, value))).when(kind == "iban", F.array(piece("iban", F.regexp_replace(value, " ", ""), value)))
    out = out.when(kind.isin("card", "ssn"), F.array(piece(kind, F.regexp_replace(value, r"\D", ""), value))).otherwise(F.array(piece(kind, value, value)))
    # what has no letter or digit (a masked password) stays
    return F.transform(out, lambda p: F.when(p["canon"].rlike(r"[\p{L}\p{N}]"), p).otherwise(F.struct(F.lit(None).cast("string").alias("part"), p["canon"].alias("canon"), p["text"].alias("text"))))


def surrogate(part: Column, canon: Column, attempt: Column, key: str) -> Column:
    """A replacement of the same type, shape and script; numbers keep their country or network and stay valid."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), part, attempt.cast("string"), canon).cast("binary"), 512)
    more = F.greatest(attempt - WIDE + 1, F.lit(0))
    wide = F.concat(canon, F.repeat(F.when(part.isin(*DIGITS), "00").otherwise("ab"), more))
    kept = F.when(part == "phone", F.regexp_extract(wide, r"^(\+[17]|\+\d\d)", 1)).when(part == "iban", F.substring(wide, 1, 4)).when(part == "card", F.substring(wide, 1, 1)).otherwise("")
    rest = F.substr(wide, F.length(kept) + 1)
    is_hex = (part == "secret") & rest.rlike("^[0-9a-f]+$")
    plain = F.concat(kept, F.when((part == "secret") & (attempt >= FREE), F.concat(F.substr(digest, F.lit(1), F.length(rest)), F.substr(rest, F.lit(129)))).otherwise(_by_class(rest, digest, is_hex)))
    # octets keep their number of digits, unless the space is too small
    octets = F.transform(
        F.split(canon, r"\."),
        lambda o, i: F.when(attempt >= FREE, _number(digest, i) % 254 + 1).when(F.length(o) == 1, _number(digest, i) % 9 + 1).when(F.length(o) == 2, _number(digest, i) % 90 + 10).otherwise(_number(digest, i) % 155 + 100).cast("string"),
    )
    digits = _characters(plain)
    check = F.pmod(-_luhn(F.concat(F.slice(digits, 1, F.size(digits) - 1), F.array(F.lit("0")))), F.lit(10)).cast("string")
    card = F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), check)
    country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
    names = F.when(part == "given-f", F.element_at(F.array(*map(F.lit, FEMALE_NAMES)), _number(digest, F.lit(0)) % len(FEMALE_NAMES) + 1)).otherwise(F.element_at(F.array(*map(F.lit, MALE_NAMES)), _number(digest, F.lit(0)) % len(MALE_NAMES) + 1))
    listed = part.startswith("given") & (attempt < FREE) & canon.rlike(r"^\p{IsLatin}")
    out = F.when(listed, names).when(part == "card", card).when(part == "iban", iban)
    return out.when((part == "ip") & (attempt < WIDE + 4), F.concat_ws(".", octets)).otherwise(plain)


def formatted(part: Column, text: Column, new: Column) -> Column:
    """The surrogate in a spelling's separators (numbers) or case (addresses)."""
    signs = F.split(text, r"[\p{L}\p{N}]", -1)
    spaced = F.concat_ws("", F.zip_with(signs, _characters(F.regexp_replace(new, r"^\+", "")), lambda g, c: F.concat(F.coalesce(g, F.lit("")), F.coalesce(c, F.lit("")))))
    cased = F.concat_ws("", F.zip_with(_characters(text), _characters(new), lambda a, c: F.when(F.coalesce(a.rlike(r"\p{Lu}"), F.lit(False)), F.upper(c)).otherwise(c)))
    return F.when(part.isin(*DIGITS), spaced).when(part.isin("local", "domain"), cased).otherwise(new)


def dictionary(parts: DataFrame, key: str) -> DataFrame:
    """parts (part, canon), each once: adds surrogate, different for different parts of a type and no part of it itself.

    Given names alone name nobody: theirs may be others' given names, as long as they differ."""
    taken = parts.where(~F.col("part").startswith("given")).select("part", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
    known = written(parts.select("part", "canon", F.lit(0).alias("attempt"), surrogate(F.col("part"), F.col("canon"), F.lit(0), key).alias("surrogate")), "pii-dictionary")
    while True:
        first = F.row_number().over(Window.partitionBy("part", "surrogate").orderBy("attempt", "canon"))
        judged = known.withColumn("place", first).join(taken, ["part", "surrogate"], "left")
        judged = written(judged.select("part", "canon", "attempt", "surrogate", ((F.col("place") > 1) | F.col("real").isNotNull()).alias("again")), "pii-judged")
        if judged.where("again").isEmpty():
            return judged.select("part", "canon", "surrogate")
        more = F.col("attempt") + 1
        known = judged.where("NOT again").select("part", "canon", "attempt", "surrogate").unionByName(
            judged.where("again").select("part", "canon", more.alias("attempt"), surrogate(F.col("part"), F.col("canon"), more, key).alias("surrogate"))
        )


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """(value, surrogate) for the values (kind, value), each once, that have a type."""
    pieces = values.where("kind is not null").select("value", F.posexplode(parts_of(F.col("kind"), F.col("value"))).alias("pos", "p")).select("value", "pos", "p.*")
    pieces = written(pieces, "pii-parts")
    known = dictionary(pieces.where("part is not null").select("part", "canon").distinct(), key)
    new = F.when(F.col("surrogate").isNull(), F.col("text")).otherwise(formatted(F.col("part"), F.col("text"), F.col("surrogate")))
    each = pieces.join(known, ["part", "canon"], "left").select("value", F.struct("pos", new.alias("new")).alias("p"))
    return each.groupBy("value").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list("p")), lambda p: p["new"])).alias("surrogate"))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities) for every row of docs, with every detected entity of the whole text replaced.

    Null stays null and empty stays empty (no entities); spellings of one value (titles with a dot or none, with or
    without the given name, separators of numbers, case of addresses) get spellings of one surrogate in all documents,
    different values different ones. Names are found after a title only. A value without a letter or digit to replace
    stays. Repeated rows stay repeated; other columns are ignored; empty tables give empty ones."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    entities = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    found = rows.withColumn("entities", entities)
    some = F.coalesce(F.size("entities") > 0, F.lit(False))
    clean = found.where(~some).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_entities"))
    hit = found.where(some).select(F.monotonically_increasing_id().alias("row"), "doc_id", "entities", F.split("text", ENTITY, -1).alias("gaps"))
    hit = written(hit, "pii-texts")
    each = hit.select("row", F.posexplode("entities").alias("pos", "value"))
    values = written(each.select("value").distinct().select(_type(F.col("value")).alias("kind"), "value"), "pii-values")
    known = written(surrogates(values, key), "pii-surrogates")
    each = each.join(known, "value", "left").select("row", "pos", F.coalesce("surrogate", "value").alias("put"), F.col("surrogate").isNotNull().cast("bigint").alias("is"))
    new = each.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "put"))), lambda x: x["put"]).alias("new"), F.sum("is").alias("n_entities"))
    text = F.concat_ws("", F.zip_with("gaps", F.concat("new", F.array(F.lit(""))), lambda g, s: F.concat(g, s)))
    changed = hit.select("row", "doc_id", "gaps").join(new, "row").select("doc_id", text.alias("text"), "n_entities")
    return clean.unionByName(changed)
