"""Surrogates for personal data.

Detected entities get keyed replacements of their own kind: an e-mail address keeps its shape and top-level domain, a
phone number its punctuation and country code, a card number its length, issuer digit and a valid check digit, an IP
address stays one, a name part is replaced by one of the same role, gender and script. One entity has one surrogate in
the whole corpus, in whatever notation it is written (coreference): a phone number with and without its country code, a
person by title and name, by title and surname, or, further on in the same text, by a bare part of the name. Two entities
never share a surrogate, and none equals a detected original: surrogates are drawn in rounds, and an entity whose draw
collides draws again, later from a larger space: names get more syllables, addresses more letters, numbers more digits.
IP addresses alone keep a bounded space, of 254^4. Everything runs as DataFrame expressions.

Draws come from a nested SHA-256 with a secret key, so who doesn't have the key can't recompute them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm.common import stored, table

#: The setting that holds the key of op3_pii. Where it is unset, a run draws its own, and surrogates differ between runs.
KEY_SETTING = "spark.loglens.surrogateKey"
MAX_ROUNDS = 60
#: Rounds in the space of the entity's own shape; after them names and addresses grow every other round, numbers every one.
OWN_SHAPE = {"name": 4, "email": 4, "number": 30}

# Titles that announce a name, by the gender they tell (n: none).
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Monsieur", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
_ALL = "|".join(t for ts in TITLES.values() for t in ts)
_WORD = r"\p{Lu}[\p{L}'’-]+"
# Kinds and their patterns; earlier ones win where several start at the same place. Repetitions are possessive or bounded,
# so no text makes the matcher recurse or read a stretch again and again. Phone: E.164 with + and up to 15 digits (11 with
# +1), or three groups as in North America. Social security numbers leave out areas, groups and serials that are never given.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "phone": r"(?<![\w+])\+(?:1(?:[ .()-]{0,2}\d){10}|[2-9](?:[ .()-]{0,2}\d){7,14})(?!\d)|(?<![\w+.-])(?:\([2-9]\d\d\) ?|[2-9]\d\d[-. ])[2-9]\d\d[-. ]\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])",
    "card": r"(?<![\w.-])[1-9]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])|(?<![\w.-])3[47]\d\d[ -]\d{6}[ -]\d{5}(?![\w-])",
    "name": rf"(?<!\w)(?:{_ALL})\.?\x20{_WORD}(?:\x20{_WORD})?",
}
KINDS = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

# Syllables that surrogate names are put together from, by script; endings by gender for given names.
SYLLABLES = {
    "latin": ["ba", "bel", "dor", "fen", "gal", "ha", "jo", "ka", "lin", "mar", "ne", "or", "pe", "ra", "sol", "ti", "ul", "ven", "wil", "zan"],
    "cyrillic": ["ба", "вел", "гор", "дем", "жан", "зор", "ка", "лим", "мар", "нев", "ол", "пет", "рад", "сав", "тим", "фед"],
    "greek": ["αλ", "βα", "γερ", "δη", "ευ", "θε", "κα", "λυ", "μαρ", "νι", "ξεν", "περ", "σω", "τιμ", "φιλ", "χρι"],
}
ENDINGS = {
    ("latin", "m"): ["o", "us", "an"], ("latin", "f"): ["a", "ia", "elle"], ("latin", "n"): ["is", "el", "en"],
    ("cyrillic", "m"): ["ил", "ан", "ор"], ("cyrillic", "f"): ["а", "ина", "ья"], ("cyrillic", "n"): ["ин", "ей"],
    ("greek", "m"): ["ος", "ης", "ας"], ("greek", "f"): ["η", "α", "ία"], ("greek", "n"): ["ις", "ων"],
}


def may_hold(text: Column) -> Column:
    """Whether a text holds anything that a pattern could begin with; cheaper than the patterns, and true wherever they match."""
    digits, titles = F.rlike(text, F.lit(r"\d[\d .()-]{6}")), F.rlike(text, F.lit(rf"(?:{_ALL})\.?\x20\p{{Lu}}"))
    return F.contains(text, F.lit("@")) | digits | titles


def detect(text: Column) -> Column:
    """Leftmost non-overlapping entities of a text as (between, value, kind): the text before each and the entity itself;
    NULL where there is none. The text after the last entity is the last element, with a NULL value. A value without a kind
    has the shape of a card number, but not its check digit, and stays."""
    found, between = F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.split(text, ANY, -1)
    zipped = F.arrays_zip(between.alias("b"), found.alias("v"))
    rows = F.transform(zipped, lambda x: F.struct(x["b"].alias("between"), x["v"].alias("value"), kind_of(x["v"]).alias("kind")))
    return F.when(may_hold(text) & F.rlike(text, F.lit(ANY)), rows)


def kind_of(value: Column) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for k, p in PATTERNS.items():
        cond = F.rlike(value, F.lit(f"^(?:{p})$"))
        if k == "card":
            cond = cond & F.call_function("luhn_check", F.regexp_replace(value, r"\D", ""))
        out = out.when(cond, F.lit(k))
    return out


def luhn_digit(body: Column) -> Column:
    """The check digit that makes body followed by it valid."""
    n = F.length(body)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(body, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(body, i, F.lit(1)).cast("int") > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(F.substring(body, i, F.lit(1)).cast("int")))
    return ((F.lit(10) - total % 10) % 10).cast("string")


def parts(value: Column, kind: Column) -> Column:
    """The parts of an entity that get a surrogate of their own, as (kind, norm). A name gives its given name with gender
    and script and its surname, each for itself, so that a later mention by surname alone refers to the same person."""
    title = F.regexp_extract(value, rf"^({_ALL})\.?\x20", 1)
    gender = F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")
    names = F.split(F.regexp_replace(value, rf"^(?:{_ALL})\.?\x20", ""), " ")
    last = F.element_at(names, -1)
    script = lambda x: F.when(F.rlike(x, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(x, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")
    given = F.struct(F.concat_ws(":", F.lit("given"), gender, script(F.get(names, F.lit(0)))).alias("kind"), F.get(names, F.lit(0)).alias("norm"))
    surname = F.struct(F.concat_ws(":", F.lit("surname"), F.lit("-"), script(last)).alias("kind"), last.alias("norm"))
    digits = F.regexp_replace(value, r"\D", "")
    phone = F.concat(F.when(F.startswith(value, F.lit("+")), F.lit("+")).otherwise(F.lit("+1")), digits)
    norm = F.when(kind == "email", F.lower(value)).when(kind == "ip", value).when(kind == "phone", phone).otherwise(digits)
    whole = F.struct(kind.alias("kind"), norm.alias("norm"))
    return F.when(kind == "name", F.when(F.size(names) > 1, F.array(given, surname)).otherwise(F.array(surname))).otherwise(F.array(whole))


def seed(kind: Column, norm: Column, attempt: int, key: str) -> Column:
    """64 hex digits that an entity's draw is made from."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(attempt)), kind, norm), 256)
    return F.sha2(F.concat(F.lit(key), F.lit("|"), inner), 256)


def draw(kind: Column, norm: Column, seed: Column, attempt: int) -> Column:
    """A surrogate for the normalized entity. Late attempts draw longer ones, so that no kind but IP addresses runs out."""
    late = {k: max(0, attempt - own + 1) for k, own in OWN_SHAPE.items()}
    longer = {"name": (late["name"] + 1) // 2, "email": (late["email"] + 1) // 2, "number": late["number"]}
    numerals, letters = "0123456789", "abcdefghijklmnopqrstuvwxyz"

    def number(i: Column, most: int) -> Column:
        h = F.sha2(F.concat_ws("|", seed, F.floor(i / 8).cast("string")), 256)
        return F.conv(F.substring(h, (F.pmod(i, F.lit(8)) * 8 + 1).cast("int"), F.lit(7)), 16, 10).cast("long") % most

    at = lambda s, i: F.substring(F.lit(s), (number(i, len(s)) + 1).cast("int"), F.lit(1))
    more = lambda s, k: [at(s, F.lit(10_000_000 + i)) for i in range(k)]
    each = lambda text, f: F.array_join(F.transform(F.split(text, ""), f), "")

    # an address without a letter or digit would keep all it has
    tail = F.regexp_extract(norm, r"(\.[a-z]+)$", 1)
    head = F.left(norm, F.length(norm) - F.length(tail))
    bare = ~F.rlike(head, F.lit("[a-z0-9]"))

    def lettered(c: Column, i: Column, bare: Column) -> Column:
        kept = F.when(F.rlike(c, F.lit("[a-z]")) | (bare & F.rlike(c, F.lit("[_%+-]"))), at(letters, i)).otherwise(c)
        return F.when(F.rlike(c, F.lit("[0-9]")), at(numerals, i)).otherwise(kept)

    def address(x: Column) -> Column:
        return F.concat(*more(letters, longer["email"]), each(x["head"], lambda c, i: lettered(c, i, x["bare"])), x["tail"])

    # evaluated once, not for every character
    once = F.array(F.struct(head.alias("head"), bare.alias("bare"), tail.alias("tail")))
    email = F.get(F.transform(once, address), F.lit(0))
    code = F.regexp_extract(norm, r"^(\+1|\+\d\d)", 1)
    # North American areas and exchanges begin with 2 to 9
    dialled = lambda c, i: F.when(i.isin(0, 3), at(numerals[2:], i)).otherwise(at(numerals, i))
    phone = F.concat(code, each(F.substring(norm, F.length(code) + 1, F.length(norm)), dialled), *more(numerals, longer["number"]))
    digit = lambda c, i: F.when(i == 0, c).otherwise(at(numerals, i))
    body = F.concat(each(F.left(norm, F.length(norm) - 1), digit), *more(numerals, longer["number"]))
    card = F.concat(body, luhn_digit(body))
    ip = F.concat_ws(".", *[(number(F.lit(i), 254) + 1).cast("string") for i in range(4)])
    area = lambda c, i: F.when(i == 0, at("1234578", i)).otherwise(at(numerals, i))
    ssn = F.concat(each(norm, area), *more(numerals, longer["number"]))
    kinds = {"email": email, "phone": phone, "card": card, "ip": ip, "ssn": ssn}
    out = F.when(F.lit(False), F.lit(""))
    for k, made in kinds.items():
        out = out.when(kind == k, made)
    for script, syllables in SYLLABLES.items():
        pick = lambda i, xs: F.get(F.array(*[F.lit(x) for x in xs]), number(F.lit(i), len(xs)).cast("int"))
        grown = [pick(8 + i, syllables) for i in range(longer["name"])]
        for gender in TITLES:
            given = F.concat(pick(0, syllables), pick(1, syllables), *grown, pick(2, ENDINGS[script, gender]))
            out = out.when(kind == f"given:{gender}:{script}", F.initcap(given))
        out = out.when(kind == f"surname:-:{script}", F.initcap(F.concat(*[pick(i, syllables) for i in range(4)], *grown)))
    return out


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct entities (kind, norm) -> (kind, norm, surrogate), injective within a kind and free of originals.

    A surrogate that several entities draw goes to the smallest; the others, and those that draw an original or a
    surrogate given before, draw again.
    """
    originals = stored(entities.select("kind", "norm").distinct(), "entities")
    taken = originals.select("kind", F.col("norm").alias("surrogate"))
    given, left = None, originals
    for attempt in range(MAX_ROUNDS):
        seeded = left.withColumn("seed", seed(F.col("kind"), F.col("norm"), attempt, key))
        drawn = seeded.select("kind", "norm", draw(F.col("kind"), F.col("norm"), F.col("seed"), attempt).alias("surrogate"))
        drawn = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        won = stored(drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")), "surrogates")
        given = won if given is None else given.unionByName(won)
        taken = taken.unionByName(won.select("kind", "surrogate"))
        left = stored(left.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"), "undrawn")
        if left.isEmpty():
            return given
    raise RuntimeError(f"no free surrogate after {MAX_ROUNDS} rounds")


def written(value: Column, kind: Column, subs: Column) -> Column:
    """The surrogates of an entity's parts in the entity's own format. A phone number written without its country code gets
    its surrogate's digits without it."""
    first = F.get(subs, F.lit(0))
    every = F.regexp_replace(first, r"[^\d]", "")
    digits = F.when((kind == "phone") & ~F.startswith(value, F.lit("+")), F.substring(every, 2, 100)).otherwise(every)

    def step(acc: Column, c: Column) -> Column:
        numeral = F.rlike(c, F.lit("[0-9]"))
        put = F.when(numeral, F.substring(digits, acc["i"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], put).alias("out"), (acc["i"] + F.when(numeral, 1).otherwise(0)).alias("i"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    rest = lambda acc: F.concat(acc["out"], F.substring(digits, acc["i"] + 1, F.length(digits)))
    formatted = F.aggregate(F.split(value, ""), zero, step, rest)
    title = F.regexp_extract(value, rf"^((?:{_ALL})\.?\x20)", 1)
    email = F.when(value == F.upper(value), F.upper(first)).otherwise(first)
    named = F.concat(title, F.array_join(subs, " "))
    return F.when(kind == "name", named).when(kind == "ip", first).when(kind == "email", email).otherwise(formatted)


def with_names(between: Column, names: Column) -> Column:
    """between with every whole word that names (map) holds replaced."""
    words = F.split(between, r"(?<![\p{L}'’-])(?=[\p{L}'’-])|(?<=[\p{L}'’-])(?![\p{L}'’-])", -1)
    replaced = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(names, w), w)), "")
    return F.when(names.isNotNull(), replaced).otherwise(between)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, text, n_entities, kinds), a row per row, repeats included.

    NULL texts stay NULL and empty ones empty. kinds: the distinct kinds found, sorted and comma-joined; n_entities counts
    detected entities, not bare mentions of their names. key is the secret that surrogates come from; who has it can tell
    whether a text of theirs holds an entity, so it must not stand in code. Other columns are left out.
    """
    text = F.col("text").cast("string")
    own = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text.alias("text"), detect(text).alias("pieces"))
    # written once, with the rows' numbers; a text that is in pieces isn't kept twice
    own = stored(own.withColumn("text", F.when(F.col("pieces").isNull(), F.col("text"))), "detected")
    hits = own.where("pieces IS NOT NULL").select("row_id", "doc_id", "pieces")
    entities = F.filter("pieces", lambda p: p["kind"].isNotNull())
    mentioned = F.array_distinct(F.transform(entities, lambda p: F.struct(p["kind"].alias("kind"), p["value"].alias("value"))))
    seen = stored(hits.select("row_id", F.explode(mentioned).alias("e")).select("row_id", "e.kind", "e.value"), "mentions")
    values = seen.select("kind", "value").distinct().select("value", F.col("kind").alias("entity"), F.posexplode(parts(F.col("value"), F.col("kind"))).alias("part", "p"))
    values = stored(values.select("value", "entity", "part", "p.kind", "p.norm"), "parts")
    drawn = values.join(surrogates(values.select("kind", "norm"), key), ["kind", "norm"])
    ordered = F.array_sort(F.collect_list(F.struct("part", "surrogate", "norm")))
    made = drawn.groupBy("value", "entity").agg(ordered.alias("parts"))
    subs = F.transform("parts", lambda x: x["surrogate"])
    made = stored(made.select("value", F.col("entity").alias("kind"), "parts", written(F.col("value"), F.col("entity"), subs).alias("new")), "written")
    used = seen.join(made, ["kind", "value"])
    per_row = used.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("value", "new"))).alias("new"))
    named = used.where("kind = 'name'").select("row_id", F.explode("parts").alias("p"))
    # a word that is one person's given name and another's surname follows the surname
    named = named.groupBy("row_id", F.col("p.norm").alias("norm")).agg(F.max_by("p.surrogate", F.struct("p.part", "p.surrogate")).alias("sub"))
    named = named.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("norm", "sub"))).alias("names"))

    def put(p: Column) -> Column:
        new = F.coalesce(F.try_element_at("new", p["value"]), p["value"], F.lit(""))
        return F.concat(with_names(p["between"], F.col("names")), new)

    done = hits.join(per_row, "row_id", "left").join(named, "row_id", "left")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(entities, lambda p: p["kind"]))), ",")
    done = done.select("doc_id", F.array_join(F.transform("pieces", put), "").alias("text"), F.size(entities).cast("long").alias("n_entities"), kinds.alias("kinds"))
    clean = own.where("pieces IS NULL").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return clean.unionByName(done)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pseudonymize() of documents with the key that KEY_SETTING holds, or one of this run. NULL and empty texts, repeated
    rows and rows of equal doc_id each give a row; an empty table gives none; other columns are not read."""
    key = spark.conf.get(KEY_SETTING, None) or os.urandom(32).hex()
    return pseudonymize(table(spark, sf_dir, "documents", "doc_id", "text"), key)
