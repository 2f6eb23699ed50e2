"""PII surrogates: keyed, type-consistent replacements with collision checks, in DataFrame functions only.

Detected entities are cut into units (a person's given name and surname are two units, all else is one).
A unit's surrogate is a keyed hash of its canonical form poured into its own format: digits for digits,
letters for letters, hexadecimal for hexadecimal, letters for the marks of a secret, octets for octets, a valid check digit for a card, names
of the same gender and script. So one unit gets one surrogate wherever it stands and however it is
written, and "Mr Smith" goes with "John Smith".

Collisions: all units of the corpus are gathered (distinct, pre-aggregated). If two share a surrogate, or a
surrogate is somebody's original, all but the first by canonical form take the next attempt of the hash, until
no collision is left; all names are one space. Later attempts draw from ever larger spaces, so this ends also where a format
has few surrogates. Texts without entities never move. Texts with entities are joined by a hash to the attempts past the
first, if there are any; else they are rewritten in one projection.

Defined cases: null text stays null; a text without entities is returned unchanged, byte for byte; digit runs
that fail the card check stay; null and repeated keys are served by their text; an empty table
gives an empty result; other columns pass through unchanged; n_entities is replaced, and _found and _attempts are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import materialize, release

# Patterns of the entities. Each starts where a run starts and never backtracks into it. Unbounded repeats
# are of single characters only: the engine recurses for repeated groups, and a long text would end the executor.
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
SECRET = r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)[^\s\"']{6,}"
AWS = r"\bAKIA[0-9A-Z]{16}\b"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
CARD = r"(?<![\d.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w.(])\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?!\d)"
HONORIFIC_M = "Mr|Herr|Señor|Monsieur|Господин"
HONORIFIC_F = "Mrs|Ms|Miss|Frau|Señora|Madame|Mme|Госпожа"
HONORIFIC_U = "Dr|Prof"
GIVEN_M = "James|John|Robert|Michael|William|David|Thomas|Hans|Peter|Klaus|Jürgen|Carlos|José|Juan|Luis|Pierre|Jean|Michel|Иван|Дмитрий|Сергей"
GIVEN_F = "Mary|Patricia|Jennifer|Linda|Elizabeth|Susan|Sarah|Ursula|Monika|Petra|María|Carmen|Ana|Marie|Sophie|Camille|Анна|Мария|Ольга"
NAME = r"\p{Lu}[\p{L}'-]+"
PERSON = rf"(?=\p{{Lu}})(?<![\p{{L}}\d])(?:(?:{HONORIFIC_M}|{HONORIFIC_F}|{HONORIFIC_U})\.? {NAME}(?: {NAME})?|(?:{GIVEN_M}|{GIVEN_F}) {NAME})"
TITLE = rf"^(?:{HONORIFIC_M}|{HONORIFIC_F}|{HONORIFIC_U})\.? "
SECRET_FRONT = r"^[A-Za-z_-]+\s*[=:]\s*[\"']?"
KINDS = {"email": EMAIL, "secret": SECRET, "aws": AWS, "iban": IBAN, "ip": IP, "ssn": SSN, "phone": PHONE, "card": CARD, "person": PERSON}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: No entity is without one of these.
HINT = rf"[0-9@=:]|AKIA|(?=\p{{Lu}})(?<![\p{{L}}\d])(?:{HONORIFIC_M}|{HONORIFIC_F}|{HONORIFIC_U}|{GIVEN_M}|{GIVEN_F})\.? "
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo",
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве во",
}
ENDINGS = {"given_m": {"latin": "n", "cyrillic": "н"}, "given_f": {"latin": "lia", "cyrillic": "лия"}, "given_u": {"latin": "ri", "cyrillic": "ри"}, "surname": {"latin": "rd", "cyrillic": "рд"}}
UNIT = "array<struct<kind:string,canon:string,shape:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(*parts: Column | str) -> Column:
    """64 keyed numbers below 256."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 512)
    return _let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substr(d, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def _like(text: Column, numbers: Column, keep: Column, marks: Column) -> Column:
    """Keyed characters of the same classes; the first `keep` stay. Hexadecimal stays hexadecimal.

    Where `marks` holds, all other characters become small letters."""

    def one(c: Column, i: Column, letters: Column) -> Column:
        n = F.get(numbers, i % 64)
        pick = lambda first, size: F.char(F.lit(ord(first)) + n % size)
        small = pick("a", letters)
        return F.when(i < keep, c).when(c.between("0", "9"), pick("0", 10)).when(c.between("a", "z"), small).when(c.between("A", "Z"), pick("A", 26)).when(marks, small).otherwise(c)

    # how many letters there are to pick from is worked out once for the whole text
    return _let(F.when(text.rlike("^[0-9a-f]+$"), 6).otherwise(26), lambda letters: F.array_join(F.transform(F.split(text, ""), lambda c, i: one(c, i, letters)), ""))


def _luhn_sum(digits: Column) -> Column:
    """Sum of a digit string by the card rule, its last digit undoubled."""

    def add(total: Column, at: Column) -> Column:
        d = F.substr(digits, F.length(digits) - at, F.lit(1)).cast("int")
        return total + F.when(at % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a unit. Later attempts draw from larger spaces: they are longer, and the octets of an IP are any."""
    late = F.greatest(F.lit(0), attempt - F.when(kind == "secret", 0).when(kind.isin("email", "phone", *ENDINGS), 3).otherwise(15))
    pad = F.repeat(F.when(kind.isin("phone", "card", "ssn"), "0").when(kind.isin("aws", "iban"), "A").otherwise("a"), late)
    octet = lambda o, n: (F.when(attempt > 3, 1 + n % 254).when(F.length(o) == 1, 1 + n % 9).when(F.length(o) == 2, 10 + n % 90).otherwise(100 + n % 155)).cast("string")
    keep = F.when(kind == "aws", 4).when(kind == "iban", 2).when(kind.isin("phone", "card"), 1).otherwise(0)
    domain = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1)), 256), 1, 8)
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    syllables = F.when(script == "cyrillic", F.split(F.lit(SYLLABLES["cyrillic"]), " ")).otherwise(F.split(F.lit(SYLLABLES["latin"]), " "))
    endings = F.create_map(*[F.lit(x) for unit, by in ENDINGS.items() for name, end in by.items() for x in (f"{unit} {name}", end)])

    def checked(digits: Column) -> Column:
        body = F.substr(digits, F.lit(1), F.length(digits) - 1)
        return F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

    def made(numbers: Column) -> Column:
        like = _let(_like(F.concat(F.when(kind == "email", F.substring_index(canon, "@", 1)).otherwise(canon), pad), numbers, keep, kind == "secret"), lambda t: F.when(kind == "email", F.concat(t, F.lit("@m"), domain, F.lit(".example.com"))).when(kind == "card", checked(t)).otherwise(t))
        name = F.concat(F.array_join(F.transform(F.slice(numbers, 1, 4 + F.least(late, F.lit(60))), lambda n: F.get(syllables, n % F.size(syllables))), ""), F.element_at(endings, F.concat_ws(" ", kind, script)))
        return F.when(kind == "ip", F.array_join(F.zip_with(F.split(canon, r"\."), F.slice(numbers, 1, 4), octet), ".")).when(kind.isin(*ENDINGS), name).otherwise(like)

    return _let(_numbers(key, kind, canon, attempt.cast("string")), made)


def _pour(shape: Column, kind: Column, canon: Column) -> Column:
    """A canonical surrogate written as the original is: its blanks and marks, its capitals."""
    step = lambda acc, c: F.when(c.between("0", "9") | c.between("A", "Z") | c.between("a", "z"), F.struct(F.concat(acc.out, F.substr(canon, acc.i + 1, F.lit(1))).alias("out"), (acc.i + 1).alias("i"))).otherwise(F.struct(F.concat(acc.out, c).alias("out"), acc.i.alias("i")))
    spaced = F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda acc: F.concat(acc.out, F.substr(canon, acc.i + 1)))
    named = kind.isin(*ENDINGS)
    return F.when(kind.isin("phone", "card", "iban"), spaced).when(named & (shape == F.upper(shape)), F.upper(canon)).when(named, F.concat(F.upper(F.substring(canon, 1, 1)), F.substr(canon, F.lit(2)))).otherwise(canon)


def _unit(kind: Column, canon: Column, shape: Column) -> Column:
    return F.struct(kind.alias("kind"), canon.alias("canon"), shape.alias("shape"))


def units(entity: Column) -> Column:
    """The units of one detected entity; none if it turns out to be no entity."""
    whole = {k: entity.rlike(f"^(?:{p})$") for k, p in KINDS.items()}
    digits = F.regexp_replace(entity, r"\D", "")
    secret = F.regexp_replace(entity, SECRET_FRONT, "")
    tokens = F.split(F.regexp_replace(entity, TITLE, ""), " ")
    male, female = entity.rlike(rf"^(?:{HONORIFIC_M})\b|^(?:\w+\.? )?(?:{GIVEN_M}) "), entity.rlike(rf"^(?:{HONORIFIC_F})\b|^(?:\w+\.? )?(?:{GIVEN_F}) ")
    given, last = F.element_at(tokens, 1), F.element_at(tokens, -1)
    sex = F.when(female, "given_f").when(male, "given_m").otherwise("given_u")
    one = lambda kind, canon, shape=None: F.array(_unit(F.lit(kind), canon, entity if shape is None else shape))
    surname = _unit(F.lit("surname"), F.lower(last), last)
    person = F.when(F.size(tokens) > 1, F.array(_unit(sex, F.lower(given), given), surname)).otherwise(F.array(surname))
    return (
        F.when(whole["email"], one("email", F.lower(entity))).when(whole["secret"], one("secret", secret, secret)).when(whole["aws"], one("aws", entity))
        .when(whole["iban"], one("iban", F.replace(entity, F.lit(" "), F.lit("")))).when(whole["ip"], one("ip", entity)).when(whole["ssn"], one("ssn", entity))
        .when(whole["phone"], one("phone", digits)).when(whole["card"] & (_luhn_sum(digits) % 10 == 0), one("card", digits)).when(whole["person"], person)
        .otherwise(F.array().cast(UNIT))
    )


def entities(text: Column) -> Column:
    """The detected strings in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _rewrite(text: Column, attempts: Column, key: str) -> Column:
    """The text with every entity replaced; attempts: map of kind and canonical form to attempt, or null."""

    def pour(u: Column) -> Column:
        attempt = F.coalesce(F.element_at(attempts, F.concat_ws("\x1f", u.kind, u.canon)), F.lit(0))
        return _let(surrogate(u.kind, u.canon, attempt, key), lambda new: _pour(u.shape, u.kind, new))

    def replaced(entity: Column, found: Column) -> Column:
        # a secret's name and a person's title stay in front
        front = F.when(F.element_at(found, 1).kind == "secret", F.regexp_extract(entity, SECRET_FRONT, 0)).when(F.element_at(found, -1).kind == "surname", F.regexp_extract(entity, TITLE, 0)).otherwise("")
        return F.when(F.size(found) > 0, F.concat(front, F.array_join(F.transform(found, pour), " "))).otherwise(entity)

    new = F.zip_with(F.col("_found"), F.transform("_found", units), replaced)
    return F.array_join(F.zip_with(F.split(text, ANY, -1), new, lambda gap, n: F.concat(gap, F.coalesce(n, F.lit("")))), "")


def _space(kind: Column) -> Column:
    """Kinds whose surrogates must differ from each other's and from each other's originals: all names are one."""
    return F.when(kind.isin(*ENDINGS), "name").otherwise(kind)


def assign_attempts(found: DataFrame, key: str, most: int = 200) -> DataFrame:
    """(kind, canon) units -> kind, canon, attempt of those past attempt 0.

    After `most` rounds there is no free surrogate left in some format (more different IPs than there are
    addresses, for one), and the job fails with a message."""
    distinct = found.groupBy("kind", "canon").agg(F.lit(0).alias("attempt"))
    with_new = lambda units: units.withColumn("new", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)).withColumn("space", _space(F.col("kind")))
    state = materialize(with_new(distinct), "units")
    for _ in range(most):
        shared = state.groupBy("space", "new").agg(F.min(F.struct("attempt", "canon", "kind")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        clash = state.join(shared, ["space", "new"]).filter((F.col("canon") != F.col("first.canon")) | (F.col("kind") != F.col("first.kind"))).select("kind", "canon")
        taken = state.join(state.select("space", F.col("canon").alias("new")), ["space", "new"], "left_semi").select("kind", "canon")
        again = materialize(clash.unionByName(taken).distinct().withColumn("again", F.lit(True)), "clashes")
        if again.isEmpty():
            return state.filter("attempt > 0").select("kind", "canon", "attempt")
        attempt = F.col("attempt") + F.when(F.col("again"), 1).otherwise(0)
        previous = state
        state = materialize(with_new(state.join(again, ["kind", "canon"], "left").select("kind", "canon", attempt.alias("attempt"))), "units")
        release(previous)
    raise ValueError(f"no free surrogates after {most} attempts: " + ", ".join(r["kind"] for r in again.select("kind").distinct().collect()))


def replace_pii(docs: DataFrame, secret_key: str, text: str = "text") -> DataFrame:
    """docs with their text rewritten, and n_entities.

    Entities are looked for once; the table of texts and entities is written."""
    found = materialize(docs.drop("_found").withColumn("_found", entities(F.col(text))), "detected")
    holds = F.coalesce(F.size("_found") > 0, F.lit(False))
    with_any, without = found.filter(holds), found.filter(~holds)
    flat = with_any.select(F.explode("_found").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    unit = F.explode(units(F.col("entity"))).alias("u")
    exceptions = assign_attempts(flat.select(unit).select("u.kind", "u.canon"), secret_key)
    if exceptions.isEmpty():
        keyed = with_any.withColumn("_attempts", F.create_map().cast("map<string,int>"))
    else:
        # texts with units past attempt 0 get a map of these; they are told by a hash, and a map of another text would be harmless
        entry = F.struct(F.concat_ws("\x1f", "kind", "canon").alias("key"), "attempt")
        within = with_any.select(F.xxhash64(text).alias("_t"), F.explode("_found").alias("entity")).select("_t", unit).select("_t", "u.kind", "u.canon").distinct()
        mapped = within.join(exceptions, ["kind", "canon"]).groupBy("_t").agg(F.map_from_entries(F.collect_set(entry)).alias("_attempts"))
        keyed = with_any.withColumn("_t", F.xxhash64(text)).join(mapped, "_t", "left").drop("_t")
    attempts = F.coalesce("_attempts", F.create_map().cast("map<string,int>"))
    n = F.coalesce(F.size("_found"), F.lit(0)).cast("long").alias("n_entities")
    kept = lambda new: [new.alias(text) if c == text else F.col(c) for c in docs.columns if c not in ("n_entities", "_found")]
    return keyed.select(*kept(_rewrite(F.col(text), attempts, secret_key)), n).unionByName(without.select(*kept(F.col(text)), n))


QUERY_KEY = "tessera-check-key"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced."""
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), QUERY_KEY)
