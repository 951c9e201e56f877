"""PII surrogates in DataFrame expressions only: keyed, of the entity's own type, script and format.

Entities: e-mail addresses, phone numbers, IPv4 addresses, card and account numbers (13 to 19 digits, also grouped by
single spaces or hyphens), social security numbers, IBANs, credentials (of known prefixes, or assigned to a word such as
token or password), names behind a title and, in the text that holds them, the words of these names where they stand by
themselves. One pattern finds them all, the leftmost first. A surrogate depends on the key and the entity alone, so an
entity has the same one wherever it stands.

Characters are replaced within their class (digits, small and capital letters of the Latin, accented Latin, Greek and
Cyrillic alphabets); the rest stays, so length, script and format are kept. Each character is moved by a keyed hash of
all before it, and then, from the end, of all behind it: a permutation of the entities of one format, which keeps
distinct ones distinct. Octets of addresses move modulo 256, card numbers keep the distance of their last digit from the
Luhn digit (valid ones stay valid), credentials keep their prefix or the word that they are assigned to.

A name behind a title is a family name, or a given name and others. Family names are permuted, whatever the title, so all
mentions of a family agree. Given names come from lists by gender and script: the title's gender, else that of the given
name, else that which other titles give the same name anywhere. Of persons whose surrogates still meet all but one try
again, at last with the given name permuted as well, until no two meet. Attempts and genders that an entity doesn't tell
are a written table of any size that is joined to the texts that hold them.

Defined results: null and empty texts stay; documents without entities stay as they are; repeated rows are replaced
alike; an empty table gives an empty result; other columns pass through, and the count of entities is named pii_count, or
that with underscores where the input has such a column. Domains of e-mail addresses are permuted up to the last label,
which stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import forget, written

KEY = "depmill"
#: Alphabets within which a character is replaced.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
)
#: Titles by gender, and first names by gender and script.
MALE, FEMALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Mx")
FIRST = {
    ("m", "latin"): ("James", "Robert", "Paul", "Peter", "Daniel", "Thomas", "Lucas", "Martin", "Victor", "Hugo", "Simon", "Adam", "Oscar", "Leo", "Felix", "David"),
    ("f", "latin"): ("Mary", "Anna", "Laura", "Julia", "Sarah", "Clara", "Emma", "Nora", "Elena", "Sophie", "Alice", "Maria", "Eva", "Lucy", "Irene", "Diana"),
    ("n", "latin"): ("Alex", "Robin", "Kim", "Sam", "Jamie", "Charlie", "Taylor", "Jordan", "Morgan", "Casey", "Riley", "Quinn", "Avery", "Rowan", "Sasha", "Noel"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Олег", "Павел", "Сергей", "Андрей"), ("f", "cyrillic"): ("Анна", "Мария", "Ольга", "Елена", "Ирина", "Вера"), ("n", "cyrillic"): ("Саша", "Женя", "Валя"),
    ("m", "greek"): ("Νίκος", "Γιώργος", "Κώστας", "Πέτρος"), ("f", "greek"): ("Μαρία", "Ελένη", "Άννα", "Σοφία"), ("n", "greek"): ("Χρύσης", "Αλέξης"),
}
#: Common given names by gender, for names behind a title without one.
GIVEN = {
    "m": ("John", "William", "Michael", "George", "Charles", "Joseph", "Henry", "Edward", "Frank", "Jack", "Mark", "Stephen", "Andrew", "Brian", "Kevin", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Pierre", "Jean", "Louis", "Michel", "Juan", "José", "Carlos", "Luis", "Miguel", "Pedro"),
    "f": ("Elizabeth", "Jane", "Susan", "Margaret", "Linda", "Barbara", "Patricia", "Jennifer", "Karen", "Helen", "Ruth", "Carol", "Emily", "Lisa", "Monika", "Ursula", "Petra", "Sabine", "Marie", "Claire", "Camille", "Louise", "Isabelle", "Carmen", "Ana", "Lucía", "Isabel", "Rosa", "Pilar", "Marta"),
}
#: Patterns of the kinds in the order in which they are tried.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+'-])[\p{L}\p{N}._%+'-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,24}",
    "secret": r"\b(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{4,}){2})|(?i:\b(?:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)[A-Za-z0-9+/=_.~-]{8,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\d.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)",
    "name": r"\b(?:" + "|".join((*MALE, *FEMALE, *NEUTRAL)) + r")\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}",
}
#: What of a credential stays.
PREFIX = r"^(AKIA|sk-|gh[pousr]_|xox[abprs]-|AIza|eyJ|(?i:(?:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?))"
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Attempts of a colliding name with a given name from the lists; later ones permute its given name too, in its own format.
LISTED = 8
#: Texts whose attempts are broadcast, at most.
BROADCAST_TEXTS = 100_000
#: Every entity has a digit, an @, a title or a word or prefix of credentials, which are quick to look for; most texts have none.
TITLES = ("Mr", "Ms", "Miss", "Mx", "Mme", "Mlle", "Madame", "Monsieur", "Herr", "Frau", "Señor", "Sr", "Doña", "Dr", "Prof", "Господин", "Госпожа", "Κύριος", "Κυρία")
STEMS = ("@", "AKIA", "sk-", "xox", "AIza", "eyJ", *TITLES)
ASSIGNED = r"(?i)(?:token|secret|passw|api[_-]?key)[\"']?\s{0,3}[:=]"


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def found(text: Column) -> Column:
    """All entities of a text, in order; null if it is plain that there are none."""
    maybe = _any([text.rlike("[0-9]"), text.rlike(ASSIGNED), *(text.contains(x) for x in STEMS)])
    return F.when(maybe, F.regexp_extract_all(text, F.lit(f"({ANY})"), 1))


def titled(text: Column) -> Column:
    """The names behind a title; null if it is plain that there are none."""
    return F.when(_any(text.contains(x) for x in TITLES), F.filter(found(text), lambda e: kind_of(e) == "name"))


def kind_of(entity: Column) -> Column:
    return reduce(lambda rest, k: F.when(entity.rlike(f"^(?:{KINDS[k]})$"), k).otherwise(rest), reversed(KINDS), F.lit("other"))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _draw(key: str, *parts: Column) -> Column:
    """A keyed number below 2^32."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256), 1, 8), 16, 10).cast("long")


def _moved(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """The letter ``by`` places on in the alphabet of c; c itself if it is in none."""
    every = F.lit("".join(alphabets))
    starts = [sum(map(len, alphabets[:k])) for k, x in enumerate(alphabets) for _ in x]
    first = F.get(F.expr(f"array({', '.join(map(str, starts))})"), F.instr(every, c) - 1)
    size = F.get(F.expr(f"array({', '.join(str(len(x)) for x in alphabets for _ in x)})"), F.instr(every, c) - 1)
    at = (first + F.pmod(F.instr(every, c) - 1 - first + by, size) + 1).cast("int")
    return F.when(F.instr(every, c) > 0, F.substr(every, at, F.lit(1))).otherwise(c)


def _pass(key: str, tweak: Column, s: Column, alphabets: tuple[str, ...]) -> Column:
    """Moves each character by a hash of those before it, which is carried along: time is that of the length."""
    start = F.struct(F.sha2(F.concat_ws("\x1f", F.lit(key), tweak), 256).alias("state"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        by = F.conv(F.substring(acc["state"], 1, 8), 16, 10).cast("long")
        return F.struct(F.sha2(F.concat(acc["state"], c), 256).alias("state"), F.concat(acc["out"], _moved(c, by, alphabets)).alias("out"))

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), start, step, lambda acc: acc["out"])


def permuted(key: str, tweak: Column, s: Column, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """A keyed permutation of the strings of one format; every character bears on every other."""
    return F.reverse(_pass(key + "\x1eback", tweak, F.reverse(_pass(key, tweak, s, alphabets)), alphabets))


def permuted_code(key: str, tweak: Column, s: Column) -> Column:
    """As permuted; hexadecimal codes stay hexadecimal."""
    return F.when(s.rlike("^[0-9a-f]+$"), permuted(key, tweak, s, ("0123456789abcdef",))).when(s.rlike("^[0-9A-F]+$"), permuted(key, tweak, s, ("0123456789ABCDEF",))).otherwise(permuted(key, tweak, s))


def _luhn(digits: Column) -> Column:
    """The Luhn digit behind these digits."""
    back = F.reverse(digits)
    value = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(value, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)), F.lit(10)), F.lit(10))


def _ip(key: str, s: Column) -> Column:
    step = lambda t, of: _let(of, lambda parts: F.transform(parts, lambda x, i: F.pmod(x.cast("int") + _draw(key, F.lit(t), F.array_join(F.slice(parts, 1, i), ".")), F.lit(256)).cast("string")))
    return F.array_join(F.reverse(step("ip back", F.reverse(step("ip", F.split(s, r"\."))))), ".")


def gender_of(words: Column) -> Column:
    """Gender by title, else by given name (only where others follow), else n."""
    bare = F.regexp_replace(words[0], r"\.$", "")
    known = lambda g: (F.size(words) > 2) & words[1].isin(*GIVEN[g], *(n for (k, _), names in FIRST.items() if k == g for n in names))
    return F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").when(known("m"), "m").when(known("f"), "f").otherwise("n")


def _given(key: str, name: Column, gender: Column, attempt: Column) -> Column:
    """A given name of this gender and the name's script; after LISTED attempts the name itself permuted."""
    script = F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    lists = ", ".join(f"'{g} {sc}', array({', '.join(repr(n) for n in names)})" for (g, sc), names in FIRST.items())
    pick = lambda names: F.get(names, F.pmod(_draw(key, F.lit("given"), attempt.cast("string"), name), F.size(names)).cast("int"))
    listed = _let(F.element_at(F.expr(f"map({lists})"), F.concat_ws(" ", gender, script)), pick)
    return F.when(attempt <= LISTED, listed).otherwise(permuted(key, F.concat_ws(" ", F.lit("given"), attempt.cast("string")), name))


def person(key: str, body: Column, gender: Column, attempt: Column) -> Column:
    """The words that stand in for those of a name without its title."""
    family = lambda w: permuted(key, F.lit("family"), w)
    many = F.size(body) > 1
    return F.transform(body, lambda w, i: F.when(many & (i == 0), _given(key, w, gender, attempt)).otherwise(family(w)))


def name_words(entity: Column, key: str, gender: Column | None = None, attempt: Column | None = None) -> Column:
    """The words of a titled name without the title, and those that stand in for them."""
    attempt = F.lit(0) if attempt is None else attempt

    def split_(words: Column) -> Column:
        body = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
        g = gender_of(words) if gender is None else F.coalesce(gender, gender_of(words))
        return F.struct(body.alias("body"), person(key, body, g, attempt).alias("made"))

    return _let(F.split(entity, " "), split_)


def surrogate(entity: Column, key: str = KEY, attempt: Column | None = None, gender: Column | None = None) -> Column:
    """What stands in for the entity: a part that stays, a permuted part, and an end that follows from both; names word by word."""

    def of_kind(kind: Column) -> Column:
        prefix = F.regexp_extract(entity, PREFIX, 1)
        front = F.when(kind == "iban", F.substr(entity, F.lit(1), F.lit(2))).when(kind == "secret", prefix).otherwise(F.lit(""))
        body = (
            F.when(kind == "iban", F.substr(entity, F.lit(3)))
            .when(kind == "secret", F.substr(entity, F.length(prefix) + 1))
            .when(kind == "email", F.substr(entity, F.lit(1), F.length(entity) - F.length(F.substring_index(entity, ".", -1))))
            .when(kind == "card", F.substr(entity, F.lit(1), F.length(entity) - 1))
            .otherwise(entity)
        )
        made = lambda x: F.concat_ws(" ", F.substring_index(entity, " ", 1), F.array_join(x["made"], " "))
        return F.when(kind == "name", _let(name_words(entity, key, gender, attempt), made)).otherwise(_let(F.struct(front.alias("front"), body.alias("body"), kind.alias("kind")), joined))

    def joined(x: Column) -> Column:
        bare = lambda s: F.regexp_replace(s, r"\D", "")
        card = lambda made: F.pmod(_luhn(bare(made)) + F.right(entity, F.lit(1)).cast("int") - _luhn(bare(x["body"])), F.lit(10)).cast("string")
        end = lambda made: F.when(x["kind"] == "card", card(made)).when(x["kind"] == "email", F.substring_index(entity, ".", -1)).otherwise(F.lit(""))
        return F.when(x["kind"] == "ip", _ip(key, entity)).otherwise(_let(F.when(x["kind"] == "secret", permuted_code(key, x["kind"], x["body"])).otherwise(permuted(key, x["kind"], x["body"])), lambda made: F.concat(x["front"], made, end(made))))

    return _let(kind_of(entity), of_kind)


def collisions(names: DataFrame, key: str = KEY) -> DataFrame:
    """(entity, attempt, gender) of titled names whose surrogate needs more than the entity tells.

    Persons are given and other names with a gender; only they can collide, and they are checked until all surrogates are
    distinct. A name whose title and given name tell no gender takes that which it has elsewhere, if it is but one. The
    table may have any size.
    """
    words = F.split("entity", " ")
    told = names.select("entity").distinct().where(F.size(words) > 2).select("entity", F.slice(words, 2, F.size(words) - 1).alias("body"), gender_of(words).alias("own"))
    told = written(told, "names")
    sides = told.groupBy("body").agg(F.max(F.col("own") == "m").alias("m"), F.max(F.col("own") == "f").alias("f"))
    gender = F.when((F.col("own") == "n") & F.col("m") & ~F.col("f"), "m").when((F.col("own") == "n") & F.col("f") & ~F.col("m"), "f").otherwise(F.col("own"))
    told = written(told.join(sides, "body").select("entity", "body", "own", gender.alias("gender")), "genders")
    persons = written(told.select("gender", "body").distinct(), "persons")
    attempts = persons.limit(0).withColumn("attempt", F.lit(0))
    turn = 0
    while True:
        turn += 1
        made = persons.join(attempts, ["gender", "body"], "left").select("gender", "body", F.array_join(person(key, F.col("body"), F.col("gender"), F.coalesce("attempt", F.lit(0))), " ").alias("made"))
        made = written(made, "made")
        keeps = made.groupBy("made").agg(F.min(F.struct("body", "gender")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
        losers = written(made.join(keeps, "made").where("struct(body, gender) <> kept").select("gender", "body", F.lit(turn).alias("attempt")), "losers")
        forget(made)
        if not losers.take(1):
            break
        attempts = written(attempts.join(losers, ["gender", "body"], "left_anti").unionByName(losers), "attempts")
    done = told.join(attempts, ["gender", "body"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    return written(done.where("attempt > 0 OR gender <> own").select("entity", "attempt", "gender"), "exceptions")


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def pseudonymised(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """All columns with the text's entities replaced, and pii_count, the number of entities."""
    count, told, made, hashed = (_free(x, docs.columns) for x in ("pii_count", "told__", "made__", "hashed__"))
    whole = F.col(text)
    # (text, name) pairs of texts with titled names, found once
    names = written(docs.select(F.sha2(text, 256).alias(hashed), F.explode(F.array_distinct(titled(whole))).alias("entity")).distinct(), "titled")
    exceptions = collisions(names, key)
    if exceptions.take(1):
        # texts with such names get what these names need by a join
        held = names.join(exceptions, "entity").groupBy(hashed).agg(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("attempt", "gender")))).alias(told))
        held = written(held, "held")
        docs = docs.withColumn(hashed, F.sha2(text, 256)).join(F.broadcast(held) if held.count() <= BROADCAST_TEXTS else held, hashed, "left").drop(hashed)
    else:
        docs = docs.withColumn(told, F.lit(None).cast("map<string,struct<attempt:int,gender:string>>"))
    known = lambda e: F.try_element_at(F.col(told), e)
    instead = lambda e: surrogate(e, key, F.coalesce(known(e)["attempt"], F.lit(0)), known(e)["gender"])

    def joined(matches: Column, between: Column, then) -> Column:
        out = F.array_join(F.zip_with(between, F.transform(matches, then), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        some = F.size(matches) > 0
        return F.struct(F.when(some, out).otherwise(whole).alias("text"), F.when(some, F.size(matches)).otherwise(0).alias("n"))

    def with_words(words: Column) -> Column:
        """The titled names' words are entities of their own in this text."""
        pairs = F.flatten(F.transform(words, lambda x: F.arrays_zip(x["body"].alias("body"), x["made"].alias("made"))))
        first = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.when(F.map_contains_key(m, p["body"]), m).otherwise(F.map_concat(m, F.create_map(p["body"], p["made"]))))

        def replaced(each: Column) -> Column:
            alone = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:\Q"), F.array_join(F.map_keys(each), r"\E|\Q"), F.lit(r"\E)(?![\p{L}\p{N}])"))
            pattern = F.concat(F.lit(f"{ANY}|"), alone)
            return _let(pattern, lambda p: joined(F.regexp_extract_all(whole, p, F.lit(0)), F.split(whole, p, -1), lambda e: F.coalesce(F.try_element_at(each, e), instead(e))))

        return _let(first, replaced)

    def replaced(entities: Column) -> Column:
        people = F.filter(entities, lambda e: kind_of(e) == "name")
        named = _any(whole.contains(x) for x in TITLES) & (F.size(people) > 0)
        words = F.transform(F.array_distinct(people), lambda e: name_words(e, key, known(e)["gender"], F.coalesce(known(e)["attempt"], F.lit(0))))
        return F.when(named, with_words(words)).otherwise(joined(entities, F.split(whole, f"{ANY}", -1), instead))

    done = docs.withColumn(made, _let(found(whole), replaced))
    return done.withColumns({text: F.col(f"{made}.text"), count: F.col(f"{made}.n")}).drop(made, told)
