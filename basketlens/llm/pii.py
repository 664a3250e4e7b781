"""Surrogates for personal data, in DataFrame operations only.

Entities (e-mail and IP addresses, phone, card, social security and account
numbers, keys and passwords, persons after an honorific) are found by pattern
and replaced by made-up ones of the same type.

* Keyed: a surrogate follows from a secret key (SHA-256 of key, kind and
  entity), so the same entity gets the same surrogate in every document and no
  table of originals has to be kept.
* Type-consistent: digits stand for digits and letters for letters of the same
  case; a phone keeps its country code and punctuation, a card its first digit
  and a valid checksum, an IP address the digits of each number, an e-mail
  address its top-level domain.  Persons get names of their gender (from the
  honorific) and script.
* Coreference: an entity is known by its normal form (an address in lower case,
  the digits of a number, a name in lower case), so ``+1 (555) 010-9999`` and
  ``555-010-9999``, or ``Mr. John Smith``, ``MR. SMITH`` and a later ``Smith``
  in the same document, change alike.  Addresses of one domain share a domain.
* Collision checks: the distinct entities of the whole table are compared by
  surrogate.  One that equals another entity's surrogate, or any entity found
  in the table, is drawn again (the smallest holder keeps it) until all are
  distinct.  The draws' numbers above 0 are all that has to be joined back.

Only the distinct entities are shuffled for the checks, aggregated map-side, so
an entity that fills a third of all mentions is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint
from basketlens.llm.common import bound, quoted, text_or_empty

MAX_DRAWS = 64
_WIDE = 8  # from this draw on an IP address or a name may be longer than the original

# Patterns of the entity kinds, in order of precedence.
_MALE = "Mr|MR|Herr|Monsieur|Señor|Sr|Господин"
_FEMALE = "Mrs|MRS|Ms|MS|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа"
_EITHER = "Dr|DR|Prof"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|{_EITHER})"
# Country calling codes of one and two digits; all others have three.
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
_CARD = r"[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "password": r"(?i:password|passwd|pwd|secret|token|api_key)\s?[=:]\s?[A-Za-z0-9_+/-]{8,}",
    "aws": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f0-9]*[0-9])(?=[a-f0-9]*[a-f])[a-f0-9]{32,64}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}"
          r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    # International numbers of 8 to 15 digits before cards, which may look like their ends.
    "phone": r"(?<![0-9+(])(?:\+[0-9](?:[ .()/-]{0,2}[0-9]){7,14}(?![0-9])|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]))",
    # 13 to 19 digits: unbroken, or in the groups that cards have.  All but 16 digits that begin with 3 to 6 need
    # a valid checksum (:func:`kind_of`).
    "card": rf"(?<![0-9])(?:[2-6][0-9]{{3}}(?:[ -]?[0-9]{{4}}){{3}}(?:[ -]?[0-9]{{1,3}})?|"
            r"3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5}|[2-6][0-9]{12,18})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.? {_NAME}(?: (?!{_TITLE}(?!\p{{L}})){_NAME})*+(?!\p{{L}})",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_OR_NAME = rf"{_ANY}|(?<!\p{{L}}){_NAME}"
# Syllables of made-up names, by script, and their last syllables by gender.
_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te ti to va ve".split(),
    "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те ти то ва ве га го фа фе".split(),
    "greek": "βα βε βι βο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε τα τε τι το γα γο φα φε θα θε".split(),
}
_LAST = {
    "latin": {"m": ["ron", "tor", "mir"], "f": ["lia", "na", "sa"], "n": ["son", "ner", "ley"]},
    "cyrillic": {"m": ["рон", "тор", "мир"], "f": ["лия", "на", "са"], "n": ["сон", "нер", "лей"]},
    "greek": {"m": ["ρος", "τος", "νης"], "f": ["λια", "να", "σα"], "n": ["σον", "νερ", "λης"]},
}


def _array(values: list[str]) -> Column:
    return F.split(F.lit(" ".join(values)), " ")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def kind_of(raw: Column) -> Column:
    """The first kind whose pattern the found text is; digits in a card's form
    without a valid checksum are a word."""
    def holds(kind: str, pattern: str) -> Column:
        fits = raw.rlike(rf"^(?:{pattern})$")
        return fits & (raw.rlike(rf"^{_CARD}$") | (_luhn(_digits(raw)) % 10 == 0)) if kind == "card" else fits
    return F.coalesce(*[F.when(holds(k, p), F.lit(k)) for k, p in PATTERNS.items()], F.lit("word"))


def _script(word: Column) -> Column:
    return (F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek")
            .otherwise("latin"))


def entities_of(raw: Column, kind: Column) -> Column:
    """Array of structs ``kind, norm`` that a found text stands for (a person
    stands for its given names and a surname, the last; any other word for
    none)."""
    def entity(kind_: Column, norm: Column) -> Column:
        return F.struct(kind_.alias("kind"), norm.alias("norm"))

    def person(words: Column) -> Column:
        honorific, last = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
        gender = (F.when(honorific.rlike(rf"^(?:{_FEMALE})\.?$"), "f")
                  .when(honorific.rlike(rf"^(?:{_MALE})\.?$"), "m").otherwise("n"))
        surname = entity(F.concat(F.lit("surname-"), _script(last)), F.lower(last))
        given = F.transform(F.slice(words, F.lit(2), F.size(words) - 2), lambda name: entity(
            F.concat(F.lit("given-"), gender, F.lit("-"), _script(name)), F.lower(name)))
        return F.concat(given, F.array(surname))

    digits = _digits(raw)
    norm = (F.when(kind == "email", F.lower(raw))
            .when((kind == "phone") & raw.startswith("+"), F.regexp_extract(digits, f"^(?:{_COUNTRY})(.*)$", 1))
            .when(kind == "phone", digits)
            .when(kind.isin("card", "ssn"), digits)
            .when(kind == "iban", F.regexp_replace(raw, " ", ""))
            .when(kind == "password", F.regexp_extract(raw, r"[=:]\s?(.*)$", 1))
            .otherwise(raw))
    none = F.array().cast("array<struct<kind:string,norm:string>>")
    return (F.when(kind == "person", bound(F.split(raw, " "), person))
            .when(kind == "word", none).otherwise(F.array(entity(kind, norm))))


def _draw(key: str, kind: Column, norm: Column, draw: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, draw.cast("string")), 256)


def _number(seed: Column, place: Column, below: int | Column) -> Column:
    return F.pmod(F.xxhash64(seed, place), below if isinstance(below, Column) else F.lit(below)).cast("int")


def _letter(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), number + 1, F.lit(1))


def _like(text: Column, seed: Column, low: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Every digit and letter replaced by one of its class."""
    def one(c: Column, j: Column) -> Column:
        return (F.when(c.rlike("[0-9]"), _number(seed, j, 10).cast("string"))
                .when(c.rlike("[a-z]"), _letter(low, _number(seed, j, len(low))))
                .when(c.rlike("[A-Z]"), _letter(low.upper(), _number(seed, j, len(low)))).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    def add(total: Column, j: Column) -> Column:
        d = F.substring(digits, F.length(digits) - j, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(j % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def surrogate_of(key: str, kind: Column, norm: Column, draw: Column) -> Column:
    """The surrogate's normal form."""
    return bound(_draw(key, kind, norm, draw), lambda seed: _made(key, kind, norm, draw, seed))


def _made(key: str, kind: Column, norm: Column, draw: Column, seed: Column) -> Column:
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    labels = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
    email = F.concat(_like(local, seed), F.lit("@"),
                     bound(_draw(key, F.lit("domain"), labels, F.lit(0)), lambda own: _like(labels, own)),
                     F.lit("."), F.substring_index(domain, ".", -1))
    plain = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm), F.lit(1))),
                                     lambda j: _number(seed, j, 10).cast("string")), "")
    phone = F.concat((_number(seed, F.lit(0), 8) + 2).cast("string"), F.substring(plain, F.lit(2), F.length(norm) - 1))
    card = F.concat(F.substring(norm, 1, 1), F.substring(plain, F.lit(2), F.length(norm) - 1))
    stem = F.substring(card, F.lit(1), F.length(norm) - 1)
    checked = F.concat(stem, F.pmod(-_luhn(F.concat(stem, F.lit("0"))), F.lit(10)).cast("string"))
    octet = F.array_join(F.transform(F.split(norm, r"\."), lambda o, j: F.when(
        draw >= _WIDE, _number(seed, j, 156) + 100).when(F.length(o) == 1, _number(seed, j, 9) + 1)
        .when(F.length(o) == 2, _number(seed, j, 90) + 10).otherwise(_number(seed, j, 156) + 100).cast("string")), ".")
    iban = F.concat(F.substring(norm, 1, 2), _like(F.substring(norm, F.lit(3), F.length(norm)), seed))
    aws = F.concat(F.lit("AKIA"), _like(F.substring(norm, F.lit(5), F.length(norm)), seed))

    def name(script: str) -> Column:
        parts = _SYLLABLES[script]
        gender = F.when(kind.startswith("given-m"), "m").when(kind.startswith("given-f"), "f").otherwise("n")
        ends = _LAST[script]
        last = F.when(gender == "m", F.get(_array(ends["m"]), _number(seed, F.lit(0), 3))).when(
            gender == "f", F.get(_array(ends["f"]), _number(seed, F.lit(0), 3))).otherwise(
            F.get(_array(ends["n"]), _number(seed, F.lit(0), 3)))
        many = F.when(draw >= _WIDE, F.lit(5)).otherwise(F.lit(3))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), many), lambda j: F.get(
            _array(parts), _number(seed, j, len(parts)))), ""), last)

    return (F.when(kind == "email", email)
            .when(kind == "phone", F.when(F.length(norm) >= 10, phone).otherwise(plain))
            .when(kind == "card", F.when(_luhn(norm) % 10 == 0, checked).otherwise(card))
            .when(kind == "ssn", plain).when(kind == "ip", octet).when(kind == "iban", iban)
            .when(kind == "aws", aws).when(kind == "hex", _like(norm, seed, "abcdef"))
            .when((kind == "password") & norm.rlike("^[0-9a-f]+$"), _like(norm, seed, "abcdef"))
            .when(kind.endswith("cyrillic"), name("cyrillic")).when(kind.endswith("greek"), name("greek"))
            .when(kind.endswith("latin"), name("latin")).otherwise(_like(norm, seed)))


def _render(raw: Column, kind: Column, names: Column) -> Column:
    """A found text with its surrogates' normal forms put into its format."""
    canon = F.get(names, F.lit(0))

    def digit(c: Column, j: Column) -> Column:
        right = F.length(_digits(F.substring(raw, j + 2, F.length(raw))))
        return F.when(c.rlike("[0-9]") & (right < F.length(canon)),
                      F.substring(canon, F.length(canon) - right, F.lit(1))).otherwise(c)

    def cased(c: Column, j: Column) -> Column:
        own = F.substring(canon, j + 1, F.lit(1))
        return F.when(c.rlike("[A-Z]"), F.upper(own)).otherwise(own)

    def name(word: Column, made: Column) -> Column:
        return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(made)).otherwise(F.initcap(made))

    def spaced(c: Column, j: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(raw, F.lit(1), j), " ", ""))
        return F.when(c == " ", c).otherwise(F.substring(canon, before + 1, F.lit(1)))

    letters, words = F.split(raw, ""), F.split(raw, " ")
    person = F.array_join(F.transform(words, lambda word, j: F.when(j == 0, word).otherwise(
        name(word, F.get(names, j - 1)))), " ")
    return (F.when(kind.isin("phone", "card", "ssn"), F.array_join(F.transform(letters, digit), ""))
            .when(kind == "email", F.array_join(F.transform(letters, cased), ""))
            .when(kind == "person", person)
            .when(kind == "word", name(raw, canon))
            .when(kind == "iban", F.array_join(F.transform(letters, spaced), ""))
            .when(kind == "password", F.concat(F.regexp_extract(raw, r"^(.*?[=:]\s?)", 1), canon))
            .otherwise(canon))


def _found(text: Column) -> Column:
    """All found texts in order.  The patterns run only over texts with a sign
    that each of them needs."""
    none = F.array().cast("array<string>")
    hint = text.rlike("[0-9@=:]")
    for title in f"{_MALE}|{_FEMALE}|{_EITHER}".split("|"):
        hint = hint | text.contains(title)
    return F.when(hint, F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(none)


def draws(entities: DataFrame, key: str) -> DataFrame:
    """``kind, norm, draw, made``: distinct surrogates for distinct entities,
    none of which is an entity itself.  A round compares all surrogates and
    draws again for those in conflict; each round is written as a table."""
    known = table_checkpoint(entities.select("kind", "norm").distinct().withColumn("draw", F.lit(0)), "pii-entities")
    real = known.select(F.col("kind").alias("rk"), F.col("norm").alias("made")).distinct()
    group = F.substring_index("kind", "-", 1)
    real = real.select(F.substring_index("rk", "-", 1).alias("g"), "made").distinct().withColumn("real", F.lit(True))
    for _ in range(MAX_DRAWS):
        made = (known.withColumn("made", surrogate_of(key, F.col("kind"), F.col("norm"), F.col("draw")))
                .withColumn("g", group))
        held = made.groupBy("g", "made").agg(F.min(F.struct("kind", "norm")).alias("holder"),
                                             F.count(F.lit(1)).alias("n"))
        held = held.join(real, ["g", "made"], "left").where((F.col("n") > 1) | F.col("real"))
        judged = made.join(held, ["g", "made"], "left").select(
            "kind", "norm", "draw", "made",
            (F.col("n").isNotNull() & (F.coalesce("real", F.lit(False)) | (F.struct("kind", "norm") != F.col("holder"))))
            .alias("again"))
        judged = table_checkpoint(judged, "pii-draws")
        if judged.where("again").isEmpty():
            return judged.drop("again")
        known = judged.select("kind", "norm", (F.col("draw") + F.col("again").cast("int")).alias("draw"))
    raise RuntimeError(f"pii: surrogates still collide after {MAX_DRAWS} draws")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, replaced, mentions`` per input row: the row, its text with
    surrogates, and the replaced places in order (structs ``kind, raw,
    surrogate``).  ``key`` is the caller's secret: whoever has it can tell
    which surrogate an entity gets.

    A null text stays null.  Texts without an entity stay as they are.  Rows
    that agree in id and text get the same result; rows with a null id take
    part like others.  An empty table gives an empty result.
    """
    # The patterns run once; what they find is kept by id and text hash.
    keyed = docs.select(quoted(id_col).alias("i"), F.xxhash64(quoted(text_col)).alias("h"),
                        _found(text_or_empty(text_col)).alias("raws")).where(F.size("raws") > 0)
    raws = table_checkpoint(keyed, "pii-found")
    entities = (raws.select("i", "h", F.explode("raws").alias("raw")).withColumn("k", kind_of(F.col("raw")))
                .select("i", "h", F.explode(entities_of(F.col("raw"), F.col("k"))).alias("e"))
                .select("i", "h", "e.kind", "e.norm"))
    entities = table_checkpoint(entities.distinct(), "pii-mentions")
    drawn = draws(entities, key)
    redrawn = drawn.where("draw > 0").select("kind", "norm", "draw")
    # Per document the entities whose first draw did not hold.
    again = (entities.join(redrawn, ["kind", "norm"]).groupBy("i", "h")
             .agg(F.collect_set(F.struct("kind", "norm", "draw")).alias("again")))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(id_col).alias("i"),
                       F.xxhash64(quoted(text_col)).alias("h"), quoted(text_col).alias("t"))
    again = again.withColumnRenamed("i", "ai").withColumnRenamed("h", "ah")
    once = raws.dropDuplicates(["i", "h"])
    known = (once.join(again, once["i"].eqNullSafe(again["ai"]) & (once["h"] == again["ah"]), "left")
             .select(F.col("i").alias("ri"), F.col("h").alias("rh"), "raws", "again"))
    joined = rows.join(known, rows["i"].eqNullSafe(known["ri"]) & (rows["h"] == known["rh"]), "left")
    return _rewrite(joined, key)


def _rewrite(joined: DataFrame, key: str) -> DataFrame:
    t = F.col("t")
    first = joined.select("row", "t", "again", F.coalesce("raws", F.array().cast("array<string>")).alias("raws"))
    # Names of persons, so that the same word later in the text changes too.
    names = F.array_distinct(F.flatten(F.transform(
        F.filter("raws", lambda r: kind_of(r) == "person"), lambda r: entities_of(r, F.lit("person")))))
    second = first.select("row", "t", "again", "raws", names.alias("names"))
    has_names = F.size("names") > 0
    third = second.select(
        "row", "t", "again", "names",
        F.when(has_names, F.regexp_extract_all(t, F.lit(_OR_NAME), F.lit(0))).otherwise(F.col("raws")).alias("raws"),
        F.when(has_names, F.split(t, _OR_NAME, -1)).when(F.size("raws") > 0, F.split(t, _ANY, -1)).alias("gaps"))

    # Step by step over the found texts, so that each step's value is computed once.
    def stands_for(f: Column) -> Column:
        known = F.filter("names", lambda n: (n["norm"] == F.lower(f["raw"])) & (f["kind"] == "word"))
        return F.struct(f["raw"].alias("raw"), f["kind"].alias("kind"), F.when(F.size(known) > 0, F.slice(known, 1, 1))
                        .otherwise(entities_of(f["raw"], f["kind"])).alias("ents"))

    def made(f: Column) -> Column:
        def one(e: Column) -> Column:
            draw = F.get(F.filter("again", lambda a: (a["kind"] == e["kind"]) & (a["norm"] == e["norm"])), F.lit(0))
            return bound(F.coalesce(draw["draw"], F.lit(0)), lambda d: surrogate_of(key, e["kind"], e["norm"], d))
        return F.struct(f["raw"].alias("raw"), f["kind"].alias("kind"), F.transform(f["ents"], one).alias("made"))

    def rendered(f: Column) -> Column:
        return F.struct(f["kind"].alias("kind"), f["raw"].alias("raw"),
                        F.when(F.size(f["made"]) > 0, _render(f["raw"], f["kind"], f["made"])).otherwise(f["raw"])
                        .alias("surrogate"))

    found = F.transform("raws", lambda r: F.struct(r.alias("raw"), kind_of(r).alias("kind")))
    for step in (stands_for, made, rendered):
        found = F.transform(found, step)
    fourth = third.select("row", "t", "gaps", F.when(F.size("raws") > 0, found).alias("found"))
    text = F.when(F.size("found") > 0, F.array_join(F.transform("gaps", lambda g, k: F.concat(
        g, F.coalesce(F.get(F.col("found"), k)["surrogate"], F.lit("")))), "")).otherwise(t)
    none = F.array().cast("array<struct<kind:string,raw:string,surrogate:string>>")
    return fourth.select("row", text.alias("replaced"), F.coalesce(
        F.filter("found", lambda m: m["raw"] != m["surrogate"]), none).alias("mentions"))
