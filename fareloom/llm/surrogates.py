"""Personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fareloom.llm.texts import text_of
from fareloom.session import written

# Titles by the gender of who bears them, and the letters of the scripts in which
# surrogates can be made.
FEMALE = "Mrs|Ms|Miss|Mme|Madame|Frau|Sra|Señora|Г-жа|Госпожа|Κυρία"
MALE = "Mr|Monsieur|Herr|Sr|Señor|Г-н|Господин|Κύριος"
NEUTRAL = "Dr|Prof"
SCRIPTS = (
    ("aeiou", "bcdfghjklmnprstvz", "[a-zß-öø-ÿ]"),
    ("аеиоу", "бвгджзклмнпрст", "[а-яё]"),
    ("αειου", "βγδζκλμνπρστ", "[ά-ώ]"),
)

_TITLE = rf"(?:{FEMALE}|{MALE}|{NEUTRAL})\.?"
_WORD = r"\p{Lu}[\p{L}'’-]++"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NAME = rf"(?<![\p{{L}}]){_TITLE} {_WORD}(?: (?!{_TITLE} ){_WORD})*+"
# A host has at most 127 labels of 63 signs.
EMAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@"
         r"(?:[A-Za-z0-9-]{1,63}\.){1,127}[A-Za-z]{2,63}")
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"
PHONE = (r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}"
         r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
HEX = r"(?<![A-Za-z0-9])(?=[a-f]*+\d)[0-9a-f]{32,}+(?![A-Za-z0-9])"
# What stands before a secret, which stays.
HEAD = (r"(?i:password|passwd|secret|token|api_key|apikey)[\"']?[ \t]*+[=:][ \t]*+[\"']?")
_VALUE = (r"(?<=\")[^\"\r\n]{4,}+(?=\")|(?<=')[^'\r\n]{4,}+(?=')|[^\s\"',;]{4,}+")
SECRET = rf"{HEAD}(?:(?:{NAME}|{EMAIL}|{KEY})(?![^\s\"',;.])|{_VALUE})"
#: What any entity matches. Unbounded repetitions don't go back, so that long texts take linear time.
ENTITY = "|".join((NAME, EMAIL, KEY, SECRET, HEX, IBAN, IP, SOCIAL, CARD, PHONE))
#: A quick look for texts that may hold one.
HINT = rf"[0-9@]|[=:]|(?<![\p{{L}}]){_TITLE} \p{{Lu}}"

_DIGITS = ("card", "phone", "social")


def _kind(m: Column) -> Column:
    def whole(pattern: str) -> Column:
        return m.rlike(rf"^(?:{pattern})$")

    return (F.when(whole(NAME), "name").when(whole(EMAIL), "email").when(whole(KEY), "key")
            .when(whole(IBAN), "iban").when(whole(IP), "ip").when(whole(SOCIAL), "social")
            .when(whole(CARD), "card").when(whole(PHONE), "phone").when(whole(HEX), "hex")
            .otherwise("secret"))


def _part(kind: str | Column, identity: Column, shape: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), identity.alias("identity"), shape.alias("shape"))


def _parts(m: Column, kind: Column) -> Column:
    """What a mention is made of. Equal identities get equal surrogates: a name's family name
    with and without the given one, a number however it is written, a mail host."""
    gender = F.when(m.rlike(rf"^(?:{FEMALE})\b"), "f").when(
        m.rlike(rf"^(?:{MALE})\b"), "m").otherwise("n")
    names = F.regexp_replace(m, rf"^{_TITLE} ", "")
    family = F.substring_index(names, " ", -1)
    words = F.split(names, " ")
    mail = F.lower(m)
    local, host = F.substring_index(mail, "@", 1), F.substring_index(mail, "@", -1)
    digits = F.regexp_replace(m, "[^0-9]", "")
    plain = F.regexp_replace(m, " ", "")
    return (
        F.when((kind == "name") & names.contains(" "), F.concat(
            F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: _part(
                F.concat(F.lit("given_"), gender), F.lower(w), F.lower(w))),
            F.array(_part("family", F.lower(family), F.lower(family)))))
        .when(kind == "name", F.array(_part("family", F.lower(family), F.lower(family))))
        .when(kind == "email", F.array(_part("mailbox", mail, local), _part("host", host, host)))
        .when(kind.isin(*_DIGITS), F.array(_part(kind, digits, digits)))
        .when(kind == "iban", F.array(_part(kind, plain, plain)))
        .otherwise(F.array(_part(kind, m, m))))


def _draw(stream: Column, i: Column) -> Column:
    """The i-th number, 0 to 255, of a digest in hex."""
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _one_of(signs: str, n: Column) -> Column:
    return F.substring(F.lit(signs), n % len(signs) + 1, F.lit(1))


def _like(c: Column, n: Column, names: bool) -> Column:
    """A sign of the class of ``c``: digit for digit, vowel for vowel in the same script."""
    out = F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
    for vowels, others, letters in SCRIPTS:
        if names:
            out = out.when(c.rlike(f"[{vowels}]"), _one_of(vowels, n)).when(
                c.rlike(letters), _one_of(others, n))
        else:
            out = out.when(c.rlike(letters), _one_of(vowels + others, n))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return out.when(c.rlike("[A-Z]"), _one_of(upper, n)).otherwise(c)


def _luhn(digits: Column) -> Column:
    """The check digit behind ``digits``."""
    n = F.length(digits)
    total = F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when(
            (n - i) % 2 == 1, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)
        ).otherwise(c.cast("int"))), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return ((10 - total % 10) % 10).cast("string")


def _surrogate(kind: Column, identity: Column, shape: Column, key: str, attempt: int) -> Column:
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, identity, F.lit(str(attempt))), 512)
    signs = F.split(shape, "")

    def mapped(names: bool = False) -> Column:
        return F.array_join(F.transform(
            signs, lambda c, i: _like(c, _draw(stream, i), names)), "")

    name = mapped(True)
    given = F.when(kind == "given_n", name).otherwise(F.concat(
        F.substring(name, F.lit(1), F.length(name) - 1),
        reduce(lambda out, s: out.when(shape.rlike(f"{s[2]}$"), F.when(
            kind == "given_f", s[0][0]).otherwise(s[1][10])), SCRIPTS[1:],
            F.when(shape.rlike(f"{SCRIPTS[0][2]}$"), F.when(kind == "given_f", "a")
                   .otherwise("n"))).otherwise(F.right(name, F.lit(1)))))
    octets = F.array_join(F.transform(F.split(shape, r"\."), lambda o, i: F.when(
        F.length(o) == 3, 100 + _draw(stream, i) % 156).when(
        F.length(o) == 2, 10 + _draw(stream, i) % 90).when(
        i == 0, 1 + _draw(stream, i) % 9).otherwise(_draw(stream, i) % 10).cast("string")), ".")
    hexes = F.array_join(F.transform(signs, lambda c, i: F.when(
        c.rlike("[0-9a-f]"), _one_of("0123456789abcdef", _draw(stream, i))).otherwise(c)), "")
    most = mapped()
    headed = F.concat(F.left(shape, F.lit(1)), F.substring(most, F.lit(2), F.length(most)))
    return (
        F.when(kind.startswith("given"), given).when(kind == "family", name)
        .when(kind == "ip", octets)
        .when((kind == "hex") | ((kind == "secret") & shape.rlike("^[0-9a-f]+$")), hexes)
        .when(kind == "card", F.concat(
            F.left(headed, F.length(headed) - 1),
            _luhn(F.left(headed, F.length(headed) - 1))))
        .when(kind.isin("phone", "social"), headed)
        .when(kind == "key", F.concat(F.left(shape, F.lit(4)), F.substring(
            most, F.lit(5), F.length(most))))
        .when(kind == "iban", F.concat(F.left(shape, F.lit(2)), F.substring(
            most, F.lit(3), F.length(most))))
        .when(kind == "host", F.concat(
            F.left(most, F.length(shape) - F.length(F.substring_index(shape, ".", -1))),
            F.substring_index(shape, ".", -1)))
        .otherwise(most))


def surrogate_table(parts: DataFrame, key: str, rounds: int = 12) -> DataFrame:
    """kind, identity and ``surrogate`` for each distinct (kind, identity, shape) of ``parts``.

    No two identities of a kind share a surrogate, and none is what a real one of the kind looks
    like. Identities whose surrogate is taken draw again, all others being settled; those still
    without one after ``rounds``, as when more of a short format exist than it has values, get
    theirs lengthened by a digest of the identity.
    """
    entities = written(parts.groupBy("kind", "identity").agg(F.min("shape").alias("shape")),
                       "surrogate-entities")
    real = entities.select("kind", F.col("shape").alias("surrogate"))
    settled, pending = None, entities
    for attempt in range(rounds):
        drawn = pending.withColumn("surrogate", _surrogate(
            F.col("kind"), F.col("identity"), F.col("shape"), key, attempt))
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"],
                             "left_anti")
        won = written(free.groupBy("kind", "surrogate").agg(F.min("identity").alias("identity"))
                      .select("kind", "identity", "surrogate"), f"surrogates-{attempt}")
        settled = won if settled is None else settled.unionByName(won)
        pending = written(pending.join(won.select("kind", "identity"), ["kind", "identity"],
                                       "left_anti"), f"surrogates-pending-{attempt}")
        if pending.isEmpty():
            return settled
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "identity"), 256)
    tail = F.when(F.col("kind").isin(*_DIGITS, "ip"), F.translate(
        F.left(digest, F.lit(24)), "abcdef", "012345")).otherwise(F.left(digest, F.lit(24)))
    return settled.unionByName(pending.select("kind", "identity", F.concat(_surrogate(
        F.col("kind"), F.col("identity"), F.col("shape"), key, rounds), tail).alias("surrogate")))


def _refill(mention: Column, signs: Column, pattern: str) -> Column:
    """``mention`` with the signs that ``pattern`` matches replaced in turn by ``signs``; signs
    left over go to the end."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
    walked = F.aggregate(F.split(mention, ""), start, lambda a, c: F.when(
        c.rlike(pattern), F.struct(F.concat(a["s"], F.substring(
            signs, a["k"] + 1, F.lit(1))).alias("s"), (a["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))))
    return F.concat(walked["s"], F.substring(signs, walked["k"] + 1, F.length(signs)))


def _rendered(m: Column, kind: Column, made: Column) -> Column:
    """The surrogate in the mention's own format."""
    first, last = made[0], F.element_at(made, -1)

    def cased(new: Column, old: Column) -> Column:
        return F.when(F.upper(old) == old, F.upper(new)).otherwise(F.initcap(new))

    title = F.regexp_extract(m, rf"^({_TITLE} )", 1)
    names = F.regexp_replace(m, rf"^{_TITLE} ", "")
    mail = F.concat(first, F.lit("@"), last)
    return (
        F.when(kind == "name", F.concat(title, F.array_join(
            F.zip_with(made, F.split(names, " "), cased), " ")))
        .when(kind == "email", F.when(F.upper(m) == m, F.upper(mail)).otherwise(mail))
        .when(kind.isin(*_DIGITS), _refill(m, first, "[0-9]"))
        .when(kind == "iban", _refill(m, first, "[^ ]")).otherwise(first))


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and the array ``_entities`` of their kinds.

    Names behind a title, mail and IP addresses, phone, card and social numbers, IBANs, access
    keys, long hexadecimal tokens and values of ``password=`` and the like are entities. A
    surrogate depends on ``key``, the kind and what is meant, so an entity has one surrogate in all
    texts, however it is written, and different entities have different ones; the key is needed to
    make the table again. Digits stand for digits and letters for letters of the same script, card
    numbers pass the Luhn check, addresses have octets of the same lengths, given names end as
    their title's gender asks, titles, country codes and top-level domains stay.

    Only distinct mentions and entities are joined, counts never; texts without a hint of an
    entity pass untouched, the others are joined once with their replacements. A text's mentions
    are gathered with the text, one row each. A missing text stays missing, with no entities; rows
    repeat as they are; other columns are kept.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body = F.col(f"c{names.index(text)}")
    ident = F.col(f"c{names.index('doc_id')}") if "doc_id" in names else F.lit(0)
    hinted = F.coalesce(body.rlike(HINT), F.lit(False))
    keyed = inner.withColumns({"_hash": F.xxhash64(body), "_id": F.coalesce(
        ident.cast("string"), F.lit("-"))}).where(hinted)

    found = written(keyed.select("_id", "_hash", F.regexp_extract_all(
        body, F.lit(ENTITY), F.lit(0)).alias("found")).where(F.size("found") > 0)
        .dropDuplicates(["_id", "_hash"]), "entities-found")
    mentions = found.select(F.explode("found").alias("mention")).distinct().withColumn(
        "head", F.regexp_extract("mention", f"^({HEAD})", 1)).withColumn(
        "bare", F.substring("mention", F.length("head") + 1, F.length("mention")))
    mentions = mentions.withColumn("of", _kind(F.col("bare")))
    mentions = written(mentions.withColumn("parts", _parts(F.col("bare"), F.col("of"))),
                       "entities-mentions")
    parts = mentions.select("mention", "head", "bare", "of", F.posexplode("parts").alias(
        "at", "part")).select("mention", "head", "bare", "of", "at", "part.*")
    table = written(surrogate_table(parts, key), "entities-surrogates")
    rendered = parts.join(table, ["kind", "identity"]).groupBy("mention", "head", "bare", "of").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "surrogate"))),
                    lambda p: p["surrogate"]).alias("made")).select(
        "mention", "of", F.concat("head", _rendered(
            F.col("bare"), F.col("of"), F.col("made"))).alias("new"))
    rendered = written(rendered, "entities-rendered")
    filled = found.select("_id", "_hash", F.posexplode("found").alias("at", "mention")).join(
        rendered, "mention").groupBy("_id", "_hash").agg(F.sort_array(F.collect_list(
            F.struct("at", "new", "of"))).alias("new"))
    pieces = F.split(body, ENTITY, -1)
    rebuilt = F.array_join(F.zip_with(pieces, F.col("new")["new"], lambda p, n: F.concat(
        p, F.coalesce(n, F.lit("")))), "")
    none = F.array().cast("array<string>")
    changed = keyed.join(filled, ["_id", "_hash"], "left").withColumns({
        "_entities": F.coalesce(F.col("new")["of"], none),
        "_new": F.when(F.col("new").isNull(), body).otherwise(rebuilt)})
    whole = changed.select(*[
        (F.col("_new") if n == text else F.col(f"c{i}")).alias(f"c{i}")
        for i, n in enumerate(names)], "_entities").unionByName(
        inner.where(~hinted).withColumn("_entities", none))
    return whole.toDF(*names, "_entities")
