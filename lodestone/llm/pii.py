"""Personal data replaced by surrogates, in DataFrame functions only.

One expression finds the mentions of every text: e-mail and IP addresses, telephone, card, social security and account
numbers, and names behind a title. Where a text names people, it is read again with an expression that has the words of its
names too, so that a name is replaced wherever the text repeats it, whole or in part, titled or not. Each mention has a
canonical form, so that mentions that differ in case, separators or title are one entity; a name's entities are its words, a
given name by the gender of its title, so a surname alone and in a full name are one.

An entity's surrogate comes from a keyed digest of its type and canonical form. Letters become letters, digits digits,
octets octets; top-level domains, country codes and titles stay; card numbers that pass their check digit
pass it again, account numbers get theirs; names are built from syllables of the name's script (Latin, Cyrillic, Greek), with endings by gender and
hyphens or an apostrophe where the name has them. A mention gives its surrogate its own case and separators.

Collisions: surrogates of all entities are compared over the whole table, with each other and with the originals; of
entities that share one, the first keeps it and the others draw again, alone. The space grows with the draws (longer names, more
letters or digits, IPv6 addresses of eight full groups), so the rounds end however many entities there are. IPv4 addresses do not grow: they
are drawn again among 254^4, close to all that there can be. Distinct entities stay distinct, mentions of one entity
equal everywhere. Only texts with entities are shuffled; an entity named very often is a skewed join key of small rows.

Defined cases: null text stays null, null ids stay; rows that repeat are rewritten alike. Extra columns pass through replaced(),
whatever their names. An empty table gives no rows. Numbers of 14, 15 or 19 digits that fail the card check stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize

#: Nothing begins inside a word or number.
START = r"(?<![\p{L}\p{N}_])"
#: A number from 0 to 255, of at most three digits.
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
#: What an entity of each type looks like. Order matters: the first that fits at a place wins.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "account": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![.+-])(?:\d{4}(?: \d{4}){3}(?: \d{1,3})?|\d{4}(?:-\d{4}){3}(?:-\d{1,3})?|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}|\d{14,16}|\d{19})(?![A-Za-z0-9])",
    "ip": r"(?<!\.)" + r"\.".join([OCTET] * 4) + r"(?![A-Za-z0-9]|\.\d)",
    "ip6": r"(?=[0-9A-Fa-f])(?=[0-9A-Fa-f:]{0,39}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){0,5}:)[0-9A-Fa-f]{1,4}(?![\w:])",
    "phone": r"(?:\+\d{1,3}[^\w\n]{1,6}\d{2,4}[^\w\n]{1,6}\d{3}[^\w\n]{0,6}\d{4}(?![A-Za-z0-9])|\+\d(?:[ .()/ -]{0,3}\d){6,14}(?![A-Za-z0-9])|\(\d{3}\) ?\d{3}[ .-]\d{4}(?![A-Za-z0-9])|(?<![.+-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![A-Za-z0-9-]))",
    "social": r"(?<!-)\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])",
}
#: Titles by the gender they tell, and the small words inside names.
TITLES = {
    "f": "Mrs|Ms|Miss|Lady|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Dra|Госпожа",
    "m": "Mr|Sir|Herr|Monsieur|Señor|Sr|Don|Господин",
    "x": "Dr|Prof|Professor|Doctor|Доктор|Профессор",
}
PARTICLES = "de|del|della|da|di|du|van|von|der|den|ter|la|le|bin|ibn|al|el|af|av|zu|y|e"
_TITLE = r"(?:" + "|".join(TITLES.values()) + r")\.?+ "
#: Behind an apostrophe stand two letters or more, so that a possessive s is no part of a name.
_WORD = r"\p{Lu}\p{L}*+(?:['’]\p{L}{2,}+|-\p{L}++)*+"
_LEAD = rf"(?:\p{{Lu}}\. |(?:{PARTICLES}) )"
NAME = rf"(?=[\p{{Lu}}])(?:{_TITLE})++{_LEAD}{{0,5}}{_WORD}(?: {_LEAD}{{0,5}}{_WORD}){{0,2}}"
PLAIN = START + "(?:" + "|".join(PATTERNS.values()) + ")"
ANY = START + "(?:" + "|".join([*PATTERNS.values(), NAME]) + ")"
KINDS = (*PATTERNS, "name")
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(), "cyrillic": "ба бе ви во га да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то".split(), "greek": "βα βε βι βο γα γε γι γο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split()}
#: Country codes of one and two digits; all others have three.
COUNTRY_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: From this draw on, surrogates of fixed length grow by a letter or digit with each draw.
GROWS_FROM = 6


def _type(value: Column) -> Column:
    kinds = [
        ("email", value.contains("@")), ("account", value.rlike(r"^[A-Z]{2}\d{2}")), ("phone", value.rlike(r"^[+(]|^\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}$")),
        ("ip", value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")), ("ip6", value.contains(":")), ("social", value.rlike(r"^\d{3}-\d{2}-\d{4}$")), ("card", value.rlike(r"^\d")),
    ]
    return F.coalesce(*[F.when(test, kind) for kind, test in kinds], F.lit("name"))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """Sum of the check over digits, the last one counted plainly."""
    value = lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.reverse(_chars(digits)), value), F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn(digits) % 10 == 0


def account_check(country: Column, body: Column) -> Column:
    """The two check digits of an account number."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.lpad((F.lit(98) - F.aggregate(_chars(F.concat(body, country, F.lit("00"))), F.lit(0), step)).cast("string"), 2, "0")


def _canonical(kind: Column, value: Column) -> Column:
    bare = F.upper(F.regexp_replace(value, r"[^A-Za-z0-9]", ""))
    return F.when(kind.isin("email", "ip6", "name"), F.lower(value)).when(kind == "ip", value).when((kind == "phone") & value.startswith("+"), F.concat(F.lit("+"), bare)).otherwise(bare)


def _stream(key: str, *parts: Column) -> Column:
    """256 hex digits that follow from the key and the parts."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(F.concat(F.lit("0"), seed), 512), F.sha2(F.concat(F.lit("1"), seed), 512))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, F.lit(1) + F.pmod(i * 2, F.lit(256)), F.lit(2)), 16, 10).cast("int")


def _like(value: Column, stream: Column) -> Column:
    """value with its letters and digits redrawn from the stream, class by class."""
    draw = lambda s, i: F.get(F.array(*[F.lit(c) for c in s]), _byte(stream, i) % len(s))
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return F.array_join(F.transform(_chars(value), lambda c, i: F.when(c.rlike("[A-Z]"), draw(upper, i)).when(c.rlike("[a-z]"), draw(lower, i)).when(c.rlike("[0-9]"), draw(digit, i)).otherwise(c)), "")


def _word(canonical: Column, stream: Column, draw: int) -> Column:
    """A name's word: class (s, gf, gm, gx), a space, the word in lower case."""
    kind, word = F.substring_index(canonical, " ", 1), F.substring_index(canonical, " ", -1)
    apostrophe = F.regexp_extract(word, "['’]", 0)

    def built(script: str, a: str, n: str) -> Column:
        sounds = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        parts = F.transform(F.sequence(F.lit(0), F.lit(2 + draw)), lambda i: F.get(sounds, _byte(stream, i) % len(SYLLABLES[script])))
        plain = F.concat(F.substring(F.array_join(parts, ""), 1, 1), apostrophe, F.substring(F.array_join(parts, ""), 2, 2 * (3 + draw)))
        hyphened = F.concat(F.array_join(F.slice(parts, 1, 2), ""), F.lit("-"), F.array_join(F.slice(parts, 3, 1 + draw), ""))
        return F.concat(F.when(word.contains("-"), hyphened).otherwise(plain), F.when(kind == "gf", a).when(kind == "gm", n).otherwise(""))

    return F.when(word.rlike(r"\p{IsCyrillic}"), built("cyrillic", "а", "н")).when(word.rlike(r"\p{IsGreek}"), built("greek", "α", "ς")).otherwise(built("latin", "a", "n"))


def made(kind: Column, canonical: Column, draw: int, key: str) -> Column:
    """The surrogate of an entity in canonical form: the draw-th that its keyed digest gives."""
    stream = _stream(key, kind, canonical, F.lit(str(draw)))
    more = max(0, draw - GROWS_FROM + 1)
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(more, 1))), lambda i: F.get(F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"]), _byte(stream, i + 90) % 26)), "") if more else F.lit("")
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(more, 1))), lambda i: (_byte(stream, i + 90) % 10).cast("string")), "") if more else F.lit("")
    like = _like(canonical, stream)
    end = F.regexp_extract(canonical, r"\.[^.@]*$", 0)
    local = F.substring_index(like, "@", 1)
    host = F.substring_index(F.substring(like, F.lit(1), F.length(like) - F.length(end)), "@", -1)
    code = F.regexp_extract(canonical, COUNTRY_CODE, 0)
    payload = F.concat(F.substring(canonical, 1, 1), F.substring(like, F.lit(2), F.length(like) - 2), digits)
    check = ((F.lit(10) - _luhn(F.concat(payload, F.lit("0"))) % 10) % 10).cast("string")
    country, body = F.substring(canonical, 1, 2), F.concat(F.substring(like, F.lit(5), F.length(like)), digits)
    octets = F.concat_ws(".", *[(_byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    hexed = F.array_join(F.transform(_chars(canonical), lambda c, i: F.when(c == ":", c).otherwise(F.substring(stream, i + 1, F.lit(1)))), "")
    return (
        F.when(kind == "email", F.concat(local, letters, F.lit("@"), host, end))
        .when(kind == "ip", octets)
        .when(kind == "ip6", F.concat_ws(":", *[F.substring(stream, 4 * i + 1, 4) for i in range(8)]) if more else hexed)
        .when(kind == "account", F.concat(country, account_check(country, body), body))
        .when(kind == "phone", F.concat(code, F.substring(like, F.length(code) + 1, F.length(like)), digits))
        .when(kind == "card", F.when(luhn_valid(canonical), F.concat(payload, check)).otherwise(F.concat(like, digits)))
        .when(kind == "name", _word(canonical, stream, draw))
        .otherwise(F.concat(like, digits))
    )


def rendered(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the case and with the separators of a mention."""
    kept = r"[A-Za-z0-9+]"
    of = _chars(value)
    nth = lambda i: F.size(F.filter(F.slice(of, F.lit(1), i + 1), lambda c: c.rlike(kept)))
    spread = F.array_join(F.transform(of, lambda c, i: F.when(c.rlike(kept), F.substring(surrogate, nth(i), F.lit(1))).otherwise(c)), "")
    rest = F.substring(surrogate, F.length(F.regexp_replace(value, r"[^A-Za-z0-9+]", "")) + 1, F.length(surrogate))
    upper = (F.upper(value) == value) & (F.lower(value) != value)
    hyphened = F.array_join(F.transform(F.split(surrogate, "(?<=['’-])"), lambda w: F.initcap(w)), "")
    return (
        F.when(kind == "email", F.when(upper, F.upper(surrogate)).otherwise(surrogate))
        .when(kind == "name", F.when(upper & (F.length(value) > 1), F.upper(surrogate)).otherwise(hyphened))
        .when(kind.isin("ip", "ip6"), surrogate)
        .otherwise(F.concat(spread, rest))
    )


def scanned(docs: DataFrame) -> DataFrame:
    """docs boxed, with text, row (unique) and found: what the one expression matches in text. Written, so that texts are searched once."""
    rows = boxed(docs, text=F.col("text").cast("string")).withColumn("found", F.coalesce(F.regexp_extract_all("text", F.lit(ANY), 0), F.array().cast("array<string>")))
    return materialize(rows.drop("text").withColumn("row", F.monotonically_increasing_id()), "scanned")


def _name_words(value: Column) -> Column:
    """array<struct(word, kind)> of a titled name: s for the last word, gf, gm or gx for those before it."""
    titles = F.regexp_extract(value, rf"^(?:{_TITLE})+", 0)
    gender = F.when(titles.rlike(START + "(?:" + TITLES["f"] + r")(?![\p{L}])"), "gf").when(titles.rlike(START + "(?:" + TITLES["m"] + r")(?![\p{L}])"), "gm").otherwise("gx")
    words = F.filter(F.split(F.substring(value, F.length(titles) + 1, F.length(value)), " "), lambda w: w.rlike(r"^\p{Lu}") & ~w.endswith("."))
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), F.when(i == F.size(words) - 1, "s").otherwise(gender).alias("kind")))


def mentions(rows: DataFrame) -> DataFrame:
    """rows (scanned) with a mention -> with parts (text between mentions) and mentions: array<struct(kind, canonical, value)>; names word by word."""
    df = rows.filter(F.size("found") > 0).withColumn("text", F.col("doc")["text"].cast("string"))
    named = F.filter("found", lambda v: _type(v) == "name")
    df = df.withColumn("known", F.flatten(F.transform(named, _name_words)))
    # the longest first, so that a double name is not taken for its first half
    words = F.array_distinct(F.flatten(F.transform("known", lambda k: F.array(k["word"], F.upper(k["word"])))))
    words = F.transform(F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))), lambda w: w["word"])
    df = df.withColumn("pattern", F.when(F.size("known") > 0, F.concat(F.lit(f"{PLAIN}|{START}(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}_])"))))
    has = F.col("pattern").isNotNull()
    df = df.withColumn("values", F.when(has, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("found")))
    df = df.withColumn("parts", F.when(has, F.split("text", F.col("pattern"))).otherwise(F.split("text", ANY)))
    # a word's first titled mention tells what it is; one with a gender goes before one without
    of_word = lambda v: F.filter("known", lambda k: F.lower(k["word"]) == F.lower(v))
    told = lambda v: F.coalesce(F.get(F.filter(of_word(v), lambda k: k["kind"] != "gx"), F.lit(0))["kind"], F.lit("gx"))

    def mention(v: Column) -> Column:
        kind = _type(v)
        bare = _canonical(kind, v)
        odd = (kind == "card") & F.length(bare).isin(14, 15, 19) & ~luhn_valid(bare)
        return F.struct(F.when(odd, "none").otherwise(kind).alias("kind"), F.when(kind == "name", F.concat(told(v), F.lit(" "), bare)).otherwise(bare).alias("canonical"), v.alias("value"))

    return materialize(df.withColumn("mentions", F.transform("values", mention)).select("row", "doc", "parts", "mentions"), "mentions")


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canonical) -> kind, canonical, made: surrogates, distinct, none of them an entity's original."""
    plain = F.when(F.col("kind") == "name", F.substring_index("canonical", " ", -1)).otherwise(F.col("canonical"))
    originals = materialize(entities.select("kind", plain.alias("made")).distinct(), "originals")
    open_, settled, draw = entities, None, 0
    while True:
        tried = open_.withColumn("made", made(F.col("kind"), F.col("canonical"), draw, key))
        first = tried.groupBy("kind", "made").agg(F.min("canonical").alias("canonical")).join(originals, ["kind", "made"], "left_anti")
        if settled is not None:
            first = first.join(settled.select("kind", "made"), ["kind", "made"], "left_anti")
        first = materialize(first.select("kind", "canonical", "made"), "surrogates")
        settled = first if settled is None else settled.unionByName(first)
        open_ = materialize(open_.join(first, ["kind", "canonical"], "left_anti"), "colliding")
        if not open_.count():
            return settled
        draw += 1


def replaced(docs: DataFrame, key: str, column: str = "entities") -> DataFrame:
    """docs with every entity in text replaced, and column: array of (kind, original's keyed digest, surrogate) in order of place.

    key is the secret that surrogates follow from. Where docs has a column of that name, underscores are added to it.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    while column in docs.columns:
        column += "_"
    rows = scanned(docs)
    found = mentions(rows)
    each = found.select("row", F.posexplode("mentions").alias("place", "m")).select("row", "place", "m.*")
    entities = materialize(each.filter("kind <> 'none'").select("kind", "canonical").distinct(), "entities")
    settled = drawn(entities, key)
    named = each.join(settled, ["kind", "canonical"], "left")
    new = F.coalesce(rendered(F.col("kind"), F.col("value"), F.col("made")), F.col("value"))
    digest = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canonical"), 256), 1, 16)
    per_row = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "kind", digest.alias("entity"), new.alias("surrogate")))).alias("all"))
    touched = found.join(per_row, "row")
    text = F.array_join(F.transform("parts", lambda p, i: F.concat(p, F.coalesce(F.get(F.col("all"), i)["surrogate"], F.lit("")))), "")
    real = F.transform(F.filter("all", lambda x: x["kind"] != "none"), lambda x: F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"), x["surrogate"].alias("surrogate")))
    touched = touched.select("doc", text.alias("new"), real.alias("entities"))
    none = F.array().cast("array<struct<kind:string,entity:string,surrogate:string>>")
    clean = rows.filter(F.size("found") == 0).select("doc", F.col("doc")["text"].cast("string").alias("new"), none.alias("entities"))
    out = clean.unionByName(touched)
    return out.select(*[(F.col("new") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns], F.col("entities").alias(column))


def _count(kind: str) -> Column:
    return F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long")


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, its length and counts by kind, and the entities, of every document."""
    out = replaced(docs.select("doc_id", "text"), key)
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.size("entities").cast("long").alias("n_entities"), *counts, "entities")
