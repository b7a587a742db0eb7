"""Surrogates for personal data, in DataFrame functions only.

Each detected entity is replaced by a keyed value of its own type and format: letters by letters of the
same case and script, digits by digits, separators stay; card numbers and IBANs have right check digits, network addresses
their octet range, names the gender that the title shows. An entity is known by its canonical form
(digits of numbers, lower case of addresses and names), so it has one surrogate everywhere, in any format. Distinct
entities of a type whose surrogates meet, or meet a real entity, take further attempts until all differ. A format may have
no free value left (or none at all, as an address without letters): from attempt ``PLAIN`` on surrogates are longer than what
they replace, by four characters more with each attempt, so every entity has one in the end.

A person is found by a title. Within a document the titled name's later forms, with or without a title, with a first
name, an initial or the surname alone, are the same entity as its fullest form, and show that form's surrogate.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, public_id, row_id

#: Attempts within the format; later ones lengthen it.
PLAIN = 8

# Titles by gender, given names of surrogates by gender and script.
_MALE = "Mr|Herr|Herrn|Señor|Sr|Monsieur|Don|г-н|κ"
_FEMALE = "Mrs|Ms|Miss|Frau|Señora|Señorita|Sra|Madame|Mme|Mlle|Doña|г-жа|κα"
GIVEN = {
    ("m", "latin"): "Adam Boris Carlos Daniel Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul".split(),
    ("f", "latin"): "Anna Berta Clara Diana Elena Flora Greta Helga Irene Julia Karin Laura Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Адам Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса".split(),
    ("m", "greek"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λευτέρης Μιχάλης Νίκος Παύλος Σπύρος Στέφανος Τάσος Φίλιππος Χρήστος".split(),
    ("f", "greek"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Ιωάννα Κατερίνα Λυδία Μαρία Νεφέλη Ξένια Σοφία Φωτεινή Χριστίνα".split(),
}
_TITLE = rf"(?:{_MALE}|{_FEMALE})\.? "
_PARTICLES = "van von der den de del della di da du dos la le bin al ter zu".split()
#: Repeated groups are possessive, as Java would else call itself for each repeat, and bounded: a name has at most 31 words with
#: 8 particles each, a word 17 joined parts, initials 16 letters, an address 256 characters before the @ and 127 labels after it.
_LEAD = rf"(?:(?:{'|'.join(_PARTICLES)}) ){{0,8}}+"
#: A capitalised word without a possessive ending, or initials.
_REST = r"(?:['’-](?!s(?!\p{L}))[\p{L}\p{M}]+)"
_WORD = rf"(?:\p{{Lu}}[\p{{L}}\p{{M}}]+{_REST}{{0,16}}+|\p{{Lu}}{_REST}{{1,16}}+|(?:\p{{Lu}}\.){{1,16}}+|\p{{Lu}}(?= \p{{Lu}}))"
#: What does not go on a name: the title of the next one and a generation.
_STOP = rf"(?!{_TITLE}|(?:Jr|Sr|II|III|IV)(?!\p{{L}}))"
#: Type and pattern, in the order in which a match is told apart.
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,256}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "name": rf"(?<![\p{{L}}]){_TITLE}{_LEAD}{_WORD}(?: {_STOP}{_LEAD}{_WORD}){{0,30}}+",
}
_ANY = "|".join(f"(?:{p})" for p in TYPES.values())


def _kind(m: Column) -> Column:
    """The type of a match, by its pattern over the whole string."""
    return F.coalesce(*[F.when(m.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in TYPES.items()], F.when(m.rlike(r"^\p{Lu}[^0-9@]*$"), F.lit("name")), F.lit("phone"))


def _title(m: Column) -> Column:
    return F.regexp_extract(m, rf"^({_TITLE})", 1)


def _bare(m: Column) -> Column:
    """A name without its title, initials apart."""
    return F.regexp_replace(F.regexp_replace(m, rf"^{_TITLE}", ""), r"\.(?=\p{L})", ". ")


def canonical(kind: Column, m: Column) -> Column:
    """What a match is known by; a name without a title has ? for its gender."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    name = F.lower(F.regexp_replace(_bare(m), r"\.", ""))
    gender = F.when(_title(m) == "", "?").when(_title(m).rlike(rf"^(?:{_MALE})\.? $"), "m").otherwise("f")
    return F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind == "name", F.concat_ws(":", gender, name)).otherwise(F.lower(m))


def _people(text: Column) -> Column:
    """The distinct titled names of a text, as they stand there."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(TYPES["name"]), F.lit(0)))
    return F.when(text.rlike(TYPES["name"]), found).otherwise(F.array().cast("array<string>"))


def _pattern(people: Column) -> Column:
    """_ANY, and after it the names of people without a title: whole, first and last word, last word."""
    word = r"(?:[\p{L}\p{M}'’-]{2,})"

    def forms(m: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(m, rf"^{_TITLE}", ""), rf"^{_LEAD}", "")
        last = F.regexp_extract(bare, rf"({word})$", 1)
        ends = F.concat_ws(" ", F.regexp_extract(bare, r"^([^ ]+) ", 1), last)
        return F.when(last == "", F.array().cast("array<string>")).otherwise(F.array(bare, F.trim(ends), last))

    each = F.flatten(F.transform(people, forms))
    each = F.array_distinct(F.flatten(F.transform(each, lambda x: F.array(x, F.upper(x), F.initcap(x)))))
    each = F.array_sort(each, lambda a, b: F.char_length(b) - F.char_length(a))
    names = F.array_join(F.transform(each, lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), "|")
    bounded = F.concat(F.lit(_ANY + r"|(?<![\p{L}\p{M}\p{N}_])(?=\p{Lu})(?:"), names, F.lit(r")(?![\p{L}\p{M}\p{N}_@])"))
    return F.when(F.size(each) > 0, bounded).otherwise(F.lit(_ANY))


def _may_be_same(a: Column, b: Column) -> Column:
    """Whether two canonical names can be one person: the last word, and first words as far as both have them."""
    x, y = F.split(F.substr(a, F.lit(3), F.char_length(a)), " "), F.split(F.substr(b, F.lit(3), F.char_length(b)), " ")
    sex, other = F.substr(a, F.lit(1), F.lit(1)), F.substr(b, F.lit(1), F.lit(1))
    initial = ((F.char_length(x[0]) == 1) | (F.char_length(y[0]) == 1)) & (F.substr(x[0], F.lit(1), F.lit(1)) == F.substr(y[0], F.lit(1), F.lit(1)))
    first = (F.size(x) == 1) | (F.size(y) == 1) | (x[0] == y[0]) | initial | x[0].isin(_PARTICLES) | y[0].isin(_PARTICLES)
    return ((sex == other) | (sex == "?") | (other == "?")) & (F.element_at(x, -1) == F.element_at(y, -1)) & first


def _linked(canon: Column, people: Column) -> Column:
    """The fullest of the canonical people that a name can mean; a titled name that may mean several stays itself."""
    order = lambda p: F.struct(F.size(F.split(p, " ")).alias("n"), F.char_length(p).alias("z"), p.alias("p"))
    able = F.filter(people, lambda p: _may_be_same(canon, p))

    def settle(able: Column) -> Column:
        top = F.array_max(F.transform(able, order))["p"]
        one = F.transform(F.array(top), lambda t: F.struct(t.alias("t"), F.forall(able, lambda p: _may_be_same(t, p)).alias("only")))[0]
        return F.transform(F.array(one), lambda o: F.when(o["only"] | canon.startswith("?"), o["t"]).otherwise(canon))[0]

    return F.coalesce(F.transform(F.array(able), settle)[0], canon)


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hexadecimal digits of HMAC-SHA-512."""
    own = key.encode()
    own = (hashlib.sha512(own).digest() if len(own) > 128 else own).ljust(128, b"\0")
    pad = lambda x: F.lit(bytearray(c ^ x for c in own))
    inner = F.sha2(F.concat(pad(0x36), F.encode(F.concat_ws("|", kind, attempt.cast("string"), canon), "UTF-8")), 512)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 512)


def _number(h: Column, i: Column) -> Column:
    """A value from 0 to 65535 for position i."""
    at = F.pmod(i * 3, F.lit(124)) + 1
    return F.conv(F.substr(h, at, F.lit(4)), 16, 10).cast("int")


def _each(text: Column, change) -> Column:
    """The text with change(character, index) in the place of each character."""
    chars = F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: change(F.substr(text, i, F.lit(1)), i))
    return F.when(F.char_length(text) > 0, F.array_join(chars, "")).otherwise(text)


#: Small and capital letters of a script, in order.
_SCRIPTS = {
    "cyrillic": ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    "latin": ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
}


def _letters(c: Column, n: Column) -> Column:
    """A character of the same class and script, picked by n."""
    pick = lambda letters: F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
    out = F.when(c.rlike("[0-9]"), pick("0123456789"))
    for script, (small, capital) in _SCRIPTS.items():
        of = rf"(?=\p{{Is{script.title()}}})" if script != "latin" else ""
        out = out.when(c.rlike(rf"{of}\p{{Ll}}"), pick(small)).when(c.rlike(rf"{of}\p{{Lu}}"), pick(capital))
    return out.otherwise(c)


def _luhn(d: Column) -> Column:
    """Luhn sum of a string of digits, the last one not doubled."""
    n = F.char_length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int")
        y = F.when(F.pmod(n - i, F.lit(2)) == 1, x * 2).otherwise(x)
        return acc + F.when(y > 9, y - 9).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _check_digits(iban: Column) -> Column:
    """The two digits behind the country code that make the whole 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5), F.char_length(iban)), F.substr(iban, F.lit(1), F.lit(2)), F.lit("00"))

    def add(acc: Column, i: Column) -> Column:
        c = F.substr(turned, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.lpad((98 - F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), add)).cast("string"), 2, "0")


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate."""
    h = _stream(key, kind, canon, attempt)
    length = F.char_length(canon)
    changed = lambda at: F.concat(F.substr(canon, F.lit(1), F.lit(at)), _each(F.substr(canon, F.lit(at + 1), length), lambda c, i: _letters(c, _number(h, i))))
    # Beyond the format: digits and letters, more with each attempt.
    more = F.when(attempt >= PLAIN, F.substr(_stream(key, F.concat(kind, F.lit("+")), canon, attempt), F.lit(1), (attempt - PLAIN + 1) * 4)).otherwise("")
    digits = F.translate(more, "abcdef", "012345")
    # Numbers keep what names their kind: a card its first digit, a phone number its country code's first.
    number = changed(1)
    body = F.concat(F.substr(number, F.lit(1), F.lit(15)), F.lit("0"))
    card = F.when(_luhn(canon) % 10 == 0, F.concat(F.substr(body, F.lit(1), F.lit(15)), F.pmod(10 - _luhn(body) % 10, F.lit(10)).cast("string"))).otherwise(number)
    ip = F.concat_ws(".", *[(F.pmod(_number(h, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)])
    iban = F.transform(F.array(F.concat(F.substr(canon, F.lit(1), F.lit(4)), F.substr(changed(4), F.lit(5), length), digits)), lambda x: F.concat(F.substr(x, F.lit(1), F.lit(2)), _check_digits(x), F.substr(x, F.lit(5), F.char_length(x))))[0]
    gender, name = F.substr(canon, F.lit(1), F.lit(1)), F.substr(canon, F.lit(3), length)

    def in_script(make) -> Column:
        return F.when(name.rlike(r"\p{IsCyrillic}"), make("cyrillic")).when(name.rlike(r"\p{IsGreek}"), make("greek")).otherwise(make("latin"))

    def first(i: Column) -> Column:
        def given(sex: str, script: str) -> Column:
            return F.get(F.array(*[F.lit(x.lower()) for x in GIVEN[sex, script]]), F.pmod(_number(h, i), F.lit(len(GIVEN[sex, script]))))

        return in_script(lambda script: F.when(gender == "m", given("m", script)).otherwise(given("f", script)))

    def last(script: str) -> Column:
        a, b = {"cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστχ", "αειου"), "latin": ("bcdfgklmnprst", "aeiou")}[script]
        part = lambda i: F.concat(F.substr(F.lit(a), F.pmod(_number(h, F.lit(i)), F.lit(len(a))) + 1, F.lit(1)), F.substr(F.lit(b), F.pmod(_number(h, F.lit(i + 1)), F.lit(len(b))) + 1, F.lit(1)))
        return F.concat(part(3), part(5), part(7), part(9), F.translate(more, "0123456789abcdef", _SCRIPTS[script][0][:16]))

    words = F.split(name, " ")

    def word(w: Column, i: Column) -> Column:
        at = F.when(i == 0, 1).otherwise(i + 10)
        short = F.concat(_letters(w, _number(h, at)), F.when(i == F.size(words) - 1, F.translate(more, "0123456789", "ghijklmnop")).otherwise(""))
        return F.when((i == F.size(words) - 1) & (F.char_length(w) > 1), in_script(last)).when(F.char_length(w) == 1, short).when(w.isin(_PARTICLES), w).otherwise(first(at))

    person = F.concat(gender, F.lit(":"), F.array_join(F.transform(words, word), " "))
    at = F.instr(canon, "@")
    any_char = changed(0)
    mail = F.concat(F.translate(more, "0123456789", "ghijklmnop"), F.substr(any_char, F.lit(1), at), F.regexp_replace(F.substr(any_char, at + 1, length), r"[^.]+$", ""), F.regexp_extract(canon, r"([^.]+)$", 1))
    plain = F.when(kind == "card", F.concat(card, digits)).when(kind == "ip", F.concat(ip, F.when(attempt >= PLAIN, F.lit(".")).otherwise(""), digits))
    return plain.when(kind == "iban", iban).when(kind == "name", person).when(kind == "email", mail).otherwise(F.concat(number, digits))


def shown(kind: Column, m: Column, new: Column) -> Column:
    """The surrogate in the format of the match."""

    def digit(c: Column, i: Column) -> Column:
        before = F.char_length(F.regexp_replace(F.substr(m, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substr(new, before, F.lit(1))).otherwise(c)

    def not_space(c: Column, i: Column) -> Column:
        before = F.char_length(F.regexp_replace(F.substr(m, F.lit(1), i), " ", ""))
        return F.when(c != " ", F.substr(new, before, F.lit(1))).otherwise(c)

    tail = lambda used: F.substr(new, F.char_length(used) + 1, F.char_length(new))
    same = _each(m, lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substr(new, i, F.lit(1)))).otherwise(F.substr(new, i, F.lit(1))))
    words, own = F.split(F.substr(new, F.lit(3), F.char_length(new)), " "), F.split(_bare(m), " ")

    def word(w: Column, j: Column) -> Column:
        last = F.element_at(words, -1)
        x = F.when(j == F.size(own) - 1, last).otherwise(F.coalesce(F.get(words, F.least(j, F.size(words) - 2)), last))
        short = F.upper(F.substr(x, F.lit(1), F.lit(1)))
        return F.when(w.rlike(r"^\p{Lu}\.$"), F.concat(short, F.lit("."))).when(w.rlike(r"^\p{Lu}$"), short).when(w.rlike(r"^\P{Ll}+$"), F.upper(x)).when(w.rlike(r"^\p{Ll}"), x).otherwise(F.initcap(x))

    person = F.concat(_title(m), F.array_join(F.transform(own, word), " "))
    numbers = F.concat(_each(m, digit), tail(F.regexp_replace(m, "[^0-9]", "")))
    return F.when(kind.isin("card", "ssn", "phone"), numbers).when(kind == "iban", F.concat(_each(m, not_space), tail(F.regexp_replace(m, " ", "")))).when(kind == "name", person).when(kind == "email", F.concat(same, tail(m))).otherwise(new)


def _entities(text: Column, pattern: Column, people: Column) -> Column:
    """The matches of pattern in order, each as (kind, m, canon)."""
    known = F.transform(people, lambda m: canonical(F.lit("name"), m))

    def one(m: Column, known: Column) -> Column:
        def of(k: Column) -> Column:
            own = F.transform(F.array(canonical(k, m)), lambda c: F.when(k == "name", _linked(c, known)).otherwise(c))[0]
            return F.struct(k.alias("kind"), m.alias("m"), own.alias("canon"))

        return F.transform(F.array(_kind(m)), of)[0]

    none = F.array().cast("array<struct<kind:string,m:string,canon:string>>")
    found = F.transform(F.array(known), lambda n: F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: one(m, n)))[0]
    return F.when((F.size(people) > 0) | text.rlike(_ANY), found).otherwise(none)


def _found(rows: DataFrame) -> DataFrame:
    """rows (text, ...) with the pattern of their matches and the matches, in found."""
    rows = rows.withColumn("people", _people(F.col("text"))).withColumn("pattern", _pattern(F.col("people")))
    return rows.withColumn("found", _entities(F.col("text"), F.col("pattern"), F.col("people"))).drop("people")


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate would meet another's or a real entity.

    entities are distinct (kind, canon). Of the entities that meet, the least keeps its surrogate. Later attempts have room for all, as
    surrogates grow; after 32 attempts there is an error.
    """
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind, canon = F.col("kind"), F.col("canon")
    # The rows are few and each costs much: they are dealt over all tasks.
    entities = materialize(entities.repartition(n, "kind", "canon"))
    real = entities.select("kind", canon.alias("new"))
    open_, kept = entities, None
    for attempt in range(32):
        tried = materialize(open_.repartition(n, "kind", "canon").withColumn("new", surrogate(key, kind, canon, F.lit(attempt))))
        first = tried.groupBy("kind", "new").agg(F.min("canon").alias("canon"))
        free = first.join(real, ["kind", "new"], "left_anti")
        if kept is not None:
            free = free.join(kept.select("kind", "new"), ["kind", "new"], "left_anti")
        won = materialize(tried.join(free, ["kind", "new", "canon"], "left_semi").select("kind", "canon", F.lit(attempt).alias("attempt"), "new"))
        kept = won if kept is None else kept.unionByName(won)
        open_ = materialize(open_.join(won, ["kind", "canon"], "left_anti"))
        if open_.isEmpty():
            return kept.where("attempt > 0").select("kind", "canon", "attempt")
    raise RuntimeError("surrogates still meet after 32 attempts")


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_entities, text) for every row of docs, text with surrogates.

    A null text stays null with no entities. Rows that repeat an id, a text or both have a row each. Other columns are
    not read. An entity is replaced by the same surrogate wherever it stands under the same key.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(row_id(id_col).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    # Texts are searched once; the matches are kept beside them.
    rows = materialize(_found(rows).withColumn("pattern", F.when(F.size("found") > 0, F.nullif("pattern", F.lit(_ANY)))))
    seen = rows.where(F.size("found") > 0).select("did", "th", F.explode("found").alias("e")).select("did", "th", "e.kind", "e.canon")
    seen = materialize(seen.distinct())
    moved = attempts(seen.select("kind", "canon").distinct(), key)
    placed = seen.join(moved, ["kind", "canon"]).groupBy("did", "th").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("moved"))
    out = rows.join(placed, ["did", "th"], "left") if not placed.isEmpty() else rows.withColumn("moved", F.lit(None).cast("map<string,int>"))
    # With the attempt at hand the surrogates follow from the row alone.

    def replace(e: Column) -> Column:
        attempt = F.coalesce(F.element_at("moved", F.concat_ws("|", e["kind"], e["canon"])), F.lit(0))
        return F.transform(F.array(surrogate(key, e["kind"], e["canon"], attempt)), lambda n: shown(e["kind"], e["m"], n))[0]

    gaps = F.split("text", F.coalesce("pattern", F.lit(_ANY)), -1)
    joined = F.array_join(F.zip_with(gaps, F.transform("found", replace), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    return out.select(public_id("did").alias(id_col), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_entities"), F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias(text_col))


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), key="clauseloom")
