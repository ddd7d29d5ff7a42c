"""Surrogates for personal data and secrets, with column expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, saved

#: Kinds of entities and their patterns, first match wins (fixed values).
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MALE, FEMALE = "Mr|Herr|Monsieur|Señor|Sr|Г-н|Κύριος", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Κυρία"
HEX = "[0-9A-Fa-f]{1,4}"
KINDS = {
    "secret": r"(?=[pstaPSTA])(?i:password|passwd|pwd|secret|token|api[_-]?key)(?:(?:[_.\-]|(?<=[a-z])(?=[A-Z0-9]))[A-Za-z0-9_.\-]{1,24})?[\"']?[ \t]{0,3}[=:]>?[ \t]{0,3}"
              r"(?:[\"'][^\"'\s]{8,}|(?:(?<=[=:>])|(?=[A-Za-z0-9_+/\-]{0,200}(?:[0-9_+/]|[a-z][A-Z])))[A-Za-z0-9_+/\-]{8,}(?:\.[A-Za-z0-9_+/\-]{8,}){0,8})",
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"\b(?:[2-6][0-9]{3}([ \-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ \-]?)[0-9]{6}\2[0-9]{5})\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}\b|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}\b|\b[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}\b",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{{0,4}}:)(?:(?:{HEX}:){{7}}{HEX}|(?=[0-9A-Fa-f:]{{0,40}}[0-9])(?:(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}|(?:{HEX}:){{1,7}}:|::(?:{HEX}:){{0,6}}{HEX}))(?![0-9A-Za-z:])",
    "person": rf"\b(?:{MALE}|{FEMALE})\b\.?[  ]\p{{Lu}}\p{{Ll}}{{1,30}}(?:[  ]\p{{Lu}}\p{{Ll}}{{1,30}})?",
}
def _any() -> str:
    """All kinds in their order. Only secrets and phones may begin within a word, so inside words the rest is one test."""
    out, run = [], []
    for kind, pattern in [*KINDS.items(), (None, None)]:
        if kind in ("secret", "phone", None):
            out += ["(?<![0-9A-Za-z])(?:" + "|".join(run) + ")"] if run else []
            out, run = out + [f"(?:{pattern})"] * (kind is not None), []
        else:
            run.append(f"(?:{pattern})")
    return "|".join(out)


ANY = _any()
#: A whole word that may mention a person again, without the title.
MENTION = r"(?<![\p{L}\p{N}_])\p{Lu}\p{Ll}{1,30}(?![\p{L}\p{N}_])"
#: Parts of surrogate names by script: given names by gender, syllables of family names (fixed values).
NAMES = {
    "latin": {"m": "Albert Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Lukas Martin Nils Oscar Paul".split(),
              "f": "Alma Berta Clara Diana Elena Frida Greta Hanna Ida Julia Karin Laura Maria Nora Olga Paula".split(),
              "syllables": "ba de fi go ha ke li mo na pe ri so ta ve wi zo".split()},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
                 "f": "Анна Белла Вера Галина Дарья Елена Зоя Ирина Кира Лидия Мария Нина Ольга Полина Раиса София".split(),
                 "syllables": "ба ве ги до же за ки ло ми но пе ро са ту фе ша".split()},
    "greek": {"m": "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Ιάσων Κώστας Λευτέρης Μάριος Νίκος Ορέστης Πέτρος Σπύρος Τάσος Φώτης".split(),
              "f": "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Ολγα Ράνια Σοφία".split(),
              "syllables": "βα γε δι ζο θα κε λι μο να πε ρι σο τα φε χι ψο".split()},
}


def number(digest: Column, at: Column | int) -> Column:
    """The two hex digits number ``at`` (from 0) of a digest."""
    place = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(digest, place * 2 + 1, F.lit(2)), 16, 10).cast("int")


def stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Keyed hex digits, two for every character of ``value`` at least."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string"))
    blocks = F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("\u0001", seed, i.cast("string")), 512)), "")


def same_format(value: Column, digest: Column, keep: Column) -> Column:
    """Letters become letters of the same case, digits digits, within hex values hex digits; the first ``keep`` stay.
    Letters beyond a to z become letters of a to z."""
    hexadecimal = value.rlike("^[0-9a-f]{8,}$|^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$")
    def mapped(i: Column) -> Column:
        own, n = F.substr(value, i + 1, F.lit(1)), number(digest, i)
        letter = lambda first, many: F.char(F.lit(ord(first)) + n % many)
        return (F.when(i < keep, own).when(own.rlike("[0-9]"), letter("0", 10)).when(hexadecimal & own.rlike("[a-f]"), letter("a", 6))
                .when(hexadecimal & own.rlike("[A-F]"), letter("A", 6)).when(own.rlike("[a-z]"), letter("a", 26)).when(own.rlike("[A-Z]"), letter("A", 26))
                .when(own.rlike(r"\p{Lu}"), letter("A", 26)).when(own.rlike(r"\p{L}"), letter("a", 26)).when(own.rlike(r"\p{N}"), letter("0", 10)).otherwise(own))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), mapped), "")


def luhn(digits: Column) -> Column:
    """Checksum of a digit string; 0 for a valid card number."""
    def term(i: Column) -> Column:
        d = F.substr(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), term), F.lit(0), lambda a, b: a + b) % 10


def mod97(text: Column) -> Column:
    """Remainder of an account number read with its first four characters last and letters as 10 to 35; 1 for a valid IBAN."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    def step(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, total * 10 + code - 48).otherwise(total * 100 + code - 55) % 97
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(turned, i, F.lit(1))), F.lit(0), step)


def is_iban(entity: Column) -> Column:
    """Valid as it stands, or its first groups are (words in capitals may follow an account number)."""
    groups = F.split(entity, " ")
    return F.exists(F.sequence(F.lit(1), F.size(groups)), lambda i: (
        F.length(F.array_join(F.slice(groups, 1, i), "")) >= 15) & (mod97(F.array_join(F.slice(groups, 1, i), "")) == 1))


def pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), n % len(words) + 1)


def part_of(words: list[str], digest: Column):
    """Function from a place to one of ``words``."""
    def chosen(i: Column) -> Column:
        return pick(words, number(digest, i))
    return chosen


#: From this attempt on the format counts as crowded: surrogates get longer with every attempt.
CROWDED = 6


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Replacement of one unit by its kind; depends on the key, the kind, the value and the attempt alone."""
    digest = stream(key, kind, value, attempt)
    further = stream(key, F.concat(kind, F.lit("+")), value, attempt)
    room = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(attempt - (CROWDED - 1), F.lit(60))))
    tail = F.when(attempt >= CROWDED, F.array_join(F.transform(room, lambda i: (number(further, i) % 10).cast("string")), "")).otherwise("")
    local = F.concat_ws(":", F.lit("fd00"), *[F.substr(further, F.lit(4 * i + 1), F.lit(4)) for i in range(7)])
    octets = F.concat_ws(".", *[(number(digest, i) % 254 + 1).cast("string") for i in range(4)])
    shaped = same_format(value, digest, F.when(kind == "access_key", 4).when(kind == "iban", 2).when(kind == "card", 1)
                         .when(kind == "phone", F.length(F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .\-(])", 0))).otherwise(0))
    mail = F.concat(same_format(F.regexp_replace(value, r"\.[A-Za-z]+$", ""), digest, F.lit(0)), F.regexp_extract(value, r"\.[A-Za-z]+$", 0))
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    body = F.concat(F.substr(shaped, F.lit(1), F.length(shaped) - 1), tail)
    check = (10 - luhn(F.concat(digits(body), F.lit("0")))) % 10
    card = F.when(luhn(digits(value)) == 0, F.concat(body, check.cast("string"))).otherwise(F.concat(shaped, tail))
    bare = F.replace(F.concat(F.substr(shaped, F.lit(5)), tail), F.lit(" "), F.lit(""))
    proof = F.lpad((98 - mod97(F.concat(F.substr(shaped, F.lit(1), F.lit(2)), F.lit("00"), bare))).cast("string"), 2, "0")
    iban = F.when(mod97(F.replace(value, F.lit(" "), F.lit(""))) == 1, F.concat(F.substr(shaped, F.lit(1), F.lit(2)), proof, F.substr(
        shaped, F.lit(5)), tail)).otherwise(F.concat(shaped, tail))
    out = F.when(kind == "ip", F.when(attempt >= CROWDED, local).otherwise(octets)).when(
        (kind == "ipv6") & (attempt >= CROWDED), local).when(kind == "email", F.concat(tail, mail)).when(kind == "card", card).when(
        kind == "iban", iban)
    more = F.transform(F.sequence(F.lit(1), F.least(F.lit(3) + attempt, F.lit(60))), lambda i: i)
    for script, lists in NAMES.items():
        for gender in "mf":
            second = F.transform(F.sequence(F.lit(1), F.least(F.lit(1) + attempt, F.lit(60))), part_of(lists["syllables"], digest))
            given = F.concat(pick(lists[gender], number(digest, 0)), F.when(attempt > 0, F.concat(
                F.lit("-"), F.initcap(F.array_join(second, "")))).otherwise(""))
            out = out.when(kind == f"given_{gender}_{script}", given)
        syllables = F.transform(more, part_of(lists["syllables"], digest))
        out = out.when(kind == f"family_{script}", F.initcap(F.array_join(syllables, "")))
    return out.otherwise(F.concat(shaped, tail))


def kind_of(entity: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        test = entity.rlike(f"^(?:{pattern})$")
        if kind == "card":  # other numbers of that form have no checksum and stay
            digits = F.regexp_replace(entity, "[^0-9]", "")
            kind = F.when(luhn(digits) == 0, kind).otherwise("number")
        elif kind == "iban":
            kind = F.when(is_iban(entity), kind).otherwise("number")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("email")


def units_of(entity: Column, kind: Column) -> Column:
    """Array of (unit, value, before): the parts that are replaced, and the text kept in front of each."""
    lead = F.regexp_extract(entity, r"^[A-Za-z0-9_.\-]+[\"']?[ \t]*[=:]>?[ \t]*[\"']?", 0)
    title = F.regexp_extract(entity, rf"^(?:{MALE}|{FEMALE})\.?[  ]", 0)
    name = F.substr(entity, F.length(title) + 1)
    gender = F.when(title.rlike(rf"^(?:{FEMALE})\b"), "f").otherwise("m")
    script = F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    words = F.split(name, "[  ]")
    unit = lambda k, v, before: F.struct(k.alias("unit"), v.alias("value"), before.alias("before"))
    family = unit(F.concat(F.lit("family_"), script), F.element_at(words, -1), F.when(F.size(words) > 1, F.lit(" ")).otherwise(title))
    given = unit(F.concat(F.lit("given_"), gender, F.lit("_"), script), F.element_at(words, 1), title)
    return (F.when(kind == "secret", F.array(unit(kind, F.substr(entity, F.length(lead) + 1), lead)))
            .when(kind == "number", F.array().cast("array<struct<unit: string, value: string, before: string>>"))
            .when((kind == "person") & (F.size(words) > 1), F.array(given, family))
            .when(kind == "person", F.array(family)).otherwise(F.array(unit(kind, entity, F.lit("")))))


def distinct_surrogates(units: DataFrame, key: str, most_attempts: int = 40) -> DataFrame:
    """(unit, value, new) for distinct (unit, value): different values of a kind get different surrogates, and none equals
    a value of that kind that occurs. Those that collide (all but the smallest value) try again with another attempt;
    names grow with it, and so do fixed formats once CROWDED attempts failed, so there is room for every value."""
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = units.select("unit", "value").distinct().repartition(tasks, "unit", "value")  # few bytes, much work a row
    current = saved(known.withColumn("attempt", F.lit(0)).withColumn(
        "new", surrogate(key, F.col("unit"), F.col("value"), F.col("attempt"))), "surrogates")
    for _ in range(most_attempts):
        owners = current.groupBy("unit", "new").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count(F.lit(1)).alias("n"))
        originals = current.select(F.col("unit").alias("_unit"), F.col("value").alias("_value"))
        clash = owners.join(originals, (F.col("unit") == F.col("_unit")) & (F.col("new") == F.col("_value")), "left").where(
            "n > 1 or _value is not null").select("unit", "new", F.when(F.col("_value").isNull(), F.col("first.value")).alias("owner"))
        clash = saved(clash, "clashes")
        if clash.isEmpty():
            return current.select("unit", "value", "new")
        again = current.join(clash, ["unit", "new"], "left").withColumn("_again", F.col("value") != F.coalesce("owner", F.lit("")))
        again = again.join(clash.select("unit", "new", F.lit(True).alias("_hit")), ["unit", "new"], "left").select(
            "unit", "value", F.when(F.col("_hit") & F.col("_again"), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))
        current = saved(again.withColumn("new", surrogate(key, F.col("unit"), F.col("value"), F.col("attempt"))), "surrogates")
    raise RuntimeError("no distinct surrogates in the attempts allowed")


def mention_names(names: Column) -> Column:
    """Map of a text's person parts to their surrogates; a word seen as both counts as a family name, then as the smaller surrogate."""
    ordered = F.array_sort(F.array_distinct(F.flatten(names)))
    first = F.filter(ordered, lambda x, i: (i == 0) | (x["value"] != F.get(ordered, i - 1)["value"]))
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["value"], x["new"])))


def mentions_replaced(gap: Column, names: Column) -> Column:
    """``gap`` with every whole word that is one of ``names`` replaced."""
    found, between = F.regexp_extract_all(gap, F.lit(MENTION), F.lit(0)), F.split(gap, MENTION, -1)
    new = F.transform(found, lambda w: F.coalesce(F.try_element_at(names, w), w))
    return F.array_join(F.flatten(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")


def replace_private(docs: DataFrame, key: str, text_col: str = "text", count_out: str = "n_replaced", kinds_out: str = "kinds") -> DataFrame:
    """Texts with surrogates in place of entities; adds the number of replacements and the kinds found (sorted).

    A value gets one surrogate throughout the corpus (a family name the same one under every title), keyed so that it
    cannot be guessed back. Persons are found behind a title; every other mention of their names in the same text, as a whole
    word, gets the same surrogate and counts as a replacement. Only texts with entities are shuffled, and their entities are
    made distinct first. All rows are written once with what was found in them.

    Null and empty texts stay; texts without an entity stay as they are. Equal rows get equal results. All columns stay;
    a column named like an output is replaced. An empty table gives no row.
    """
    names = [c for c in docs.columns if c not in (count_out, kinds_out)]
    docs = docs.select(*map(col, names))
    text, row = col(text_col), fresh(names, "_row")
    found, entity = fresh(names, "_entities"), F.col("entity")
    scanned = saved(docs.withColumn(found, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), "entities")  # the patterns run once
    some = F.coalesce(F.size(col(found)), F.lit(0)) > 0
    hits = scanned.where(some).withColumn(row, F.unhex(F.md5(text)))
    clean = scanned.where(~some).select(
        *map(col, names), F.lit(0).alias(count_out), F.array().cast("array<string>").alias(kinds_out))
    listed = hits.select(F.explode(found).alias("entity")).distinct()
    units = saved(listed.withColumn("kind", kind_of(entity)).select(
        "entity", "kind", F.posexplode(units_of(entity, F.col("kind"))).alias("at", "u")).select("entity", "kind", "at", "u.*"), "units")
    new = distinct_surrogates(units, key)
    parts = F.array_sort(F.collect_list(F.struct("at", F.concat("before", "new").alias("part"))))
    person = F.when(F.col("unit").rlike("^(family|given)_"), F.struct("value", F.col("unit").startswith("given").alias("given"), "new"))
    mapped = units.join(new, ["unit", "value"]).groupBy("entity", "kind").agg(parts.alias("parts"), F.collect_set(person).alias("names")).select(
        "entity", "kind", "names", F.array_join(F.col("parts.part"), "").alias("replacement"))
    placed = hits.select(row, found).dropDuplicates([row]).select(
        row, F.posexplode(found).alias("at", "entity")).join(mapped, "entity", "left")
    lists = placed.groupBy(row).agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("replacement", "entity").alias("replacement")))).alias("_new"),
        F.count("replacement").cast("int").alias(count_out), F.array_sort(F.collect_set("kind")).alias(kinds_out),
        mention_names(F.collect_list("names")).alias("_names"))
    plain, names_in = F.split(text, ANY, -1), F.col("_names")
    named = F.size(names_in) > 0
    gaps = F.when(named, F.transform(plain, lambda g: mentions_replaced(g, names_in))).otherwise(plain)
    again = F.when(named, F.aggregate(F.transform(plain, lambda g: F.size(F.filter(
        F.regexp_extract_all(g, F.lit(MENTION), F.lit(0)), lambda w: F.map_contains_key(names_in, w)))), F.lit(0), lambda a, b: a + b)).otherwise(0)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.col("_new.replacement"), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    changed = hits.join(lists, row).select(
        *[joined.alias(c) if c == text_col else col(c) for c in names],
        (F.col(count_out) + again).alias(count_out), F.col(kinds_out))
    return clean.unionByName(changed)
