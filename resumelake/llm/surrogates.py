"""Personal data and secrets replaced by keyed surrogates of the same type and format; DataFrame functions only.

An entity found in a text gets a surrogate that depends on the key, its type and
its value alone: the same value has the same surrogate wherever it stands
(coreference). Values that differ in form only are one: e-mail addresses and names in another case, telephone and
card numbers grouped otherwise. A name is replaced word by word, so that a surname keeps its surrogate behind any
title and first name, and a first name of one gender before any surname.

Letters stay letters of the same case, digits digits, signs stay; card numbers and IBANs keep valid check digits,
private keys their labels and lines, names the script, the number of words and the gender that the title tells.
All distinct values of the corpus are checked: two values with one surrogate, or a surrogate that is itself a value
found, are drawn again with the next attempt number, until all are distinct (or an error says that they aren't).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resumelake.llm.shared import plain, settled

# Titles of women, of men, and of either.
WOMAN = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
MAN = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
EITHER = ("Dr", "Prof")
_UPPER = [t.upper() for t in (*WOMAN, *MAN, *EITHER)]
_TITLE = rf"(?:{'|'.join((*WOMAN, *MAN, *EITHER, *_UPPER))})\.?(?:\s(?:{'|'.join(EITHER)})\.?)*+"
_WORD = r"\p{Lu}(?:\.|\p{L}++(?:['’-](?!s(?!\p{L}))\p{L}++)*+)"
_LABEL = r"(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)"
_BEGIN, _END = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", r"-----END [A-Z ]{0,30}PRIVATE KEY-----"
#: Type -> pattern (Java), in order of precedence. No pattern matches the empty text; values of any length are found whole.
PATTERNS = {
    "private_key": rf"{_BEGIN}(?:[^-]*+(?:-(?!----)[^-]*+)*+{_END}|(?:\s*+[A-Za-z0-9+/=]{{16,}}+)++)",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+(?![A-Za-z0-9-])",
    "access_key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:gh[pousr]_|sk-)[A-Za-z0-9]{20,}+)",
    "secret": _LABEL + r"[A-Za-z0-9+/_\-]{8,}+={0,2}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,5}){2,5}(?![0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\s{_WORD}(?:\s{_WORD}){{0,3}}",
}
KINDS = list(PATTERNS)
_TITLED = f"(?=[{''.join(sorted({t[0] for t in (*WOMAN, *MAN, *EITHER)}))}])"


def _any_of(first: str, *kinds: str) -> str:
    return first + "(?:" + "|".join(f"({PATTERNS[k]})" for k in kinds) + ")"


#: All patterns, each in a group of its own; where none of a few can begin, none of them is tried.
_ALL = "|".join([_any_of("(?=-)", *KINDS[:1]), _any_of("(?<![A-Za-z0-9])", *KINDS[1:5]), _any_of("(?=[0-9+(])", *KINDS[5:9]), _any_of(_TITLED, *KINDS[9:])])
#: A text without any of these has no entity: their first characters are few, so that most texts cost one quick pass.
_MAYBE = rf"[0-9@]|[=:]\s{{0,3}}[\"']?[A-Za-z0-9+/_\-]{{8}}|{_TITLED}{_TITLE}\s\p{{Lu}}|A[KS]IA[A-Z0-9]|gh[pousr]_[A-Za-z0-9]|sk-[A-Za-z0-9]|-----B"
#: Signs (no characters of any script) around an entity and between its types, and those that stand for them where a text has them itself.
_AROUND, _BETWEEN, _ESCAPE, _STANDS = "﷐", "﷑", "﷒", ("﷓", "﷔", "﷕")
_MARKED = _AROUND + "".join(f"${k}{_BETWEEN}" for k in range(1, len(KINDS) + 1)) + _AROUND
# First names by script and gender (f, m), endings of made-up ones, syllables.
FIRST = {
    "latin_f": ["Anna", "Clara", "Elena", "Greta", "Hanna", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sofia", "Teresa", "Vera", "Yvonne"],
    "latin_m": ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Paul", "Simon", "Viktor"],
    "cyrillic_f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"],
    "cyrillic_m": ["Антон", "Борис", "Виктор", "Иван", "Лев", "Олег", "Павел", "Юрий"],
}
ENDINGS = {"latin_f": ["a", "ina", "ella", "ea"], "latin_m": ["us", "o", "ert", "in"], "cyrillic_f": ["а", "ина", "ея", "ика"], "cyrillic_m": ["ий", "ор", "ан", "ей"]}
_SYLLABLES = {
    "latin": ["bar", "bel", "cor", "dan", "fel", "gar", "hol", "kem", "lan", "mar", "nel", "por", "ran", "sel", "tor", "vin"],
    "cyrillic": ["бар", "вел", "гор", "дан", "зел", "кор", "лан", "мар", "нев", "пор", "род", "сел", "тар", "фед", "хол", "чер"],
}
#: Draws of a value at each width of its surrogate, steps by which that grows at most, draws until an error is raised.
NARROW, WIDEST, DRAWS = 4, 6, 64
#: Characters that one digest serves.
_DIGEST = 32
#: Up to so many rows with redrawn surrogates (a hash and a few short values each) are sent to all tasks.
SENT = 100_000


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _pool(seed: Column, length: Column) -> Column:
    """Hex digits, four for each of length characters and at least for _DIGEST: digest after digest, none used twice."""
    more = lambda: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((length - 1) / _DIGEST).cast("int")), lambda k: F.sha2(F.concat(seed, F.lit("\x1f"), k.cast("string")), 512)), "")
    return F.when(length > _DIGEST, more()).otherwise(F.sha2(F.concat(seed, F.lit("\x1f0")), 512))


def _draw(pool: Column, i: Column | int) -> Column:
    """The pool's number i (from 0), 0 to 65535."""
    return F.conv(F.substring(pool, i * 4 + 1, 4) if isinstance(i, int) else pool.substr(i * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _each(x: Column, f: Callable[[Column, Column], Column]) -> Column:
    """The string of f(character, place) of each character of x."""
    return _let(x, lambda x: F.when(F.length(x) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: f(x.substr(i, F.lit(1)), i - 1)), "")))


def _pick(signs: str, number: Column) -> Column:
    return F.lit(signs).substr(number % len(signs) + 1, F.lit(1))


def _recast(value: Column, pool: Column, hexadecimal: Column | None = None) -> Column:
    """value, each letter and digit replaced by one drawn from the pool; case and signs stay."""

    def one(c: Column, i: Column) -> Column:
        n = _draw(pool, i)
        low, up = _pick("abcdefghijklmnopqrstuvwxyz", n), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)
        if hexadecimal is not None:
            low, up = F.when(hexadecimal, _pick("abcdef", n)).otherwise(low), F.when(hexadecimal, _pick("ABCDEF", n)).otherwise(up)
        return F.when(c.between("0", "9"), _pick("0123456789", n)).when(c.between("a", "z"), low).when(c.between("A", "Z"), up).otherwise(c)

    return _each(value, one)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _filled(value: Column, signs: Column, gap: str = "[^0-9]") -> Column:
    """value with signs in turn at the places that are no gaps; gaps stay."""
    before = lambda i: F.length(F.regexp_replace(value.substr(F.lit(1), i + 1), gap, ""))
    return _let(signs, lambda new: _each(value, lambda c, i: F.when(c.rlike(gap), c).otherwise(new.substr(before(i), F.lit(1)))))


def _luhn(number: Column) -> Column:
    """The Luhn sum of a string of digits, its last digit counted once."""

    def term(d: Column) -> Column:
        return d - F.when(d > 9, 9).otherwise(0)

    def total(x: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)))
        return F.aggregate(places, F.lit(0), lambda a, i: a + term(F.coalesce(x.substr(i, F.lit(1)).try_cast("int"), F.lit(0)) * ((F.length(x) - i) % 2 + 1)))

    return _let(number, total)


def _iban(value: Column, pool: Column) -> Column:
    """An IBAN (without spaces) of the same country, its check digits right."""

    def checked(body: Column) -> Column:
        def left(signs: Column) -> Column:
            step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
            return F.aggregate(F.sequence(F.lit(1), F.length(signs)), F.lit(0), lambda a, i: step(a, signs.substr(i, F.lit(1))))

        country = F.substring(value, 1, 2)
        return F.concat(country, F.lpad((98 - _let(F.concat(body, country, F.lit("00")), left)).cast("string"), 2, "0"), body)

    return _let(_recast(value.substr(F.lit(5), F.length(value)), pool), checked)


def canonical(kind: Column, value: Column) -> Column:
    """What all forms of one value have in common."""
    return F.when(kind == "email", F.lower(value)).when(kind.isin("phone", "card"), F.concat(F.when(value.startswith("+"), "+").otherwise(""), _digits(value))).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)


def _words(value: Column) -> Column:
    """array<struct<role, value>> of a name's words in lower case: initials, first names by the gender that the title tells, the surname last; the script is part of the role."""
    title, rest = F.regexp_extract(value, f"^{_TITLE}", 0), F.regexp_replace(value, rf"^{_TITLE}\s", "")
    gender = F.when(title.rlike(rf"(?iu)^(?:{'|'.join(WOMAN)})(?!\p{{L}})"), "f").when(title.rlike(rf"(?iu)^(?:{'|'.join(MAN)})(?!\p{{L}})"), "m").otherwise("u")

    def one(w: Column, i: Column, n: Column) -> Column:
        role = F.when(w.endswith("."), "initial").when(i == n - 1, "surname").otherwise(F.concat(F.lit("first_"), gender))
        return F.struct(F.concat(role, F.when(w.rlike(r"\p{IsCyrillic}"), "_cyrillic").otherwise("_latin")).alias("role"), F.lower(w).alias("value"))

    return _let(F.split(rest, r"\s"), lambda ws: F.transform(ws, lambda w, i: one(w, i, F.size(ws))))


def _seed(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    return F.concat(F.lit(key), F.lit("\x1f"), kind, F.lit("\x1f"), value, F.lit("\x1f"), attempt.cast("string"))


def _wider(attempt: Column) -> Column:
    return F.least(F.floor(attempt / NARROW).cast("int"), F.lit(WIDEST))


def _repeated(n: Column, one: Callable[[Column], Column]) -> Column:
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), "")).otherwise("")


def word_surrogate(role: Column, value: Column, key: str, attempt: Column) -> Column:
    """The surrogate (lower case) of a word of a name; from attempt NARROW on it gets more syllables."""

    def drawn(pool: Column) -> Column:
        cyrillic = role.endswith("_cyrillic")
        choose = lambda xs, n: F.element_at(F.split(F.lit(" ".join(xs).lower()), " "), n % len(xs) + 1)
        syllable = lambda n: F.when(cyrillic, choose(_SYLLABLES["cyrillic"], n)).otherwise(choose(_SYLLABLES["latin"], n))
        more = _repeated(_wider(attempt), lambda i: syllable(_draw(pool, i + 4)))
        surname = F.concat(*[syllable(_draw(pool, k)) for k in range(4)], more)

        def first(script: str, gender: str) -> Column:
            own, ending = choose(FIRST[f"{script}_{gender}"], _draw(pool, 0)), choose(ENDINGS[f"{script}_{gender}"], _draw(pool, 1))
            return F.when(attempt == 0, own).otherwise(F.concat(syllable(_draw(pool, 2)), syllable(_draw(pool, 3)), more, ending))

        of = lambda script: F.when(role.contains("_f_") | (role.contains("_u_") & (_draw(pool, 12) % 2 == 0)), first(script, "f")).otherwise(first(script, "m"))
        step = F.conv(F.substring(F.sha2(F.lit(key), 256), 1, 4), 16, 10).cast("int")  # the same turn of the alphabet for all initials: none meet
        turned = lambda signs: F.when(F.instr(F.lit(signs), F.substring(value, 1, 1)) > 0, F.concat(_pick(signs, F.instr(F.lit(signs), F.substring(value, 1, 1)) + step % (len(signs) - 1)), F.lit("."))).otherwise(value)
        initial = F.when(cyrillic, turned("абвгдежзиклмнопрстуфхцчшэюя")).otherwise(turned("abcdefghijklmnopqrstuvwxyz"))
        return F.when(role.startswith("surname"), surname).when(role.startswith("initial"), initial).when(cyrillic, of("cyrillic")).otherwise(of("latin"))

    return _let(_pool(_seed(key, role, value, attempt), F.lit(1)), drawn)


def name_surrogate(value: Column, key: str, attempt: Callable[[Column, Column], Column]) -> Column:
    """A name, word by word; attempt: of a word's role and value. A word in capitals stays in capitals."""
    title = F.regexp_extract(value, rf"^{_TITLE}\s", 0)

    def shown(words: Column) -> Column:
        said = F.split(value.substr(F.length(title) + 1, F.length(value)), r"\s")
        gaps = F.concat(F.array(title), F.regexp_extract_all(value.substr(F.length(title) + 1, F.length(value)), F.lit(r"\s"), F.lit(0)))

        def one(w: Column, i: Column) -> Column:
            new, old = word_surrogate(w["role"], w["value"], key, attempt(w["role"], w["value"])), F.element_at(said, i + 1)
            return F.concat(F.element_at(gaps, i + 1), F.when((F.length(old) > 1) & (F.upper(old) == old), F.upper(new)).otherwise(F.initcap(new)))

        return F.array_join(F.transform(words, one), "")

    return _let(_words(value), shown)


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The surrogate of an entity's value (not of a name); attempt: 0, or more after collisions.

    From attempt NARROW on, e-mails get longer domain numbers, and phone numbers, secrets and private keys more
    digits, more of them every NARROW attempts, so that one that is free exists.
    """

    def drawn(pool: Column) -> Column:  # each use of an expression in a lambda computes it: what is used often is bound
        digits = _repeated(_wider(attempt), lambda i: F.lpad((_draw(pool, i + 20) % 10_000).cast("string"), 4, "0"))
        email = F.concat(_recast(F.substring_index(value, "@", 1), pool), F.lit("@mail"), (_draw(pool, 20) % 90 + 10).cast("string"), digits, F.lit(".example.net"))
        octet = lambda k, n, low: (_draw(pool, k) % n + low).cast("string")
        ip = F.concat_ws(".", octet(0, 222, 1), octet(1, 254, 1), octet(2, 254, 1), octet(3, 254, 1))

        def card(number: Column) -> Column:
            body = F.concat(F.substring(number, 1, 1), _recast(number.substr(F.lit(2), F.length(number) - 2), pool))
            check = ((F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
            return _filled(value, F.when(_luhn(number) % 10 == 0, F.concat(body, check)).otherwise(_recast(number, pool)))

        label = F.regexp_extract(value, f"^{_LABEL}", 0)
        rest = value.substr(F.length(label) + 1, F.length(value))
        secret = F.concat(label, _let(rest.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), lambda h: _recast(rest, pool, h)), digits)
        head = F.regexp_extract(value, "^(?:AKIA|ASIA|gh[a-z]_|sk-)", 0)
        access = F.concat(head, _recast(value.substr(F.length(head) + 1, F.length(value)), pool))
        country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
        local = value.substr(F.length(country) + 1, F.length(value))
        phone = F.concat(country, _filled(local, _recast(_digits(local), pool)), digits)
        begin, end = F.regexp_extract(value, f"^{_BEGIN}", 0), F.regexp_extract(value, f"{_END}$", 0)
        inner = value.substr(F.length(begin) + 1, F.length(value) - F.length(begin) - F.length(end))
        private = F.concat(begin, _recast(inner, pool), digits, end)
        out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", _let(_digits(value), card)).when(kind == "secret", secret)
        return out.when(kind == "access_key", access).when(kind == "iban", _let(F.replace(value, F.lit(" "), F.lit("")), lambda v: _filled(value, _iban(v, pool), " "))).when(kind == "phone", phone).when(kind == "private_key", private).otherwise(_recast(value, pool))

    return _let(_pool(_seed(key, kind, canonical(kind, value), attempt), F.length(value)), drawn)


def _maybe(text: Column) -> Column:
    return F.coalesce(text.rlike(_MAYBE), F.lit(False))


def _pieces(text: Column) -> Column:
    """text cut around its entities: at even places what is between them, at odd places an entity, under its type's number."""
    safe = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _STANDS[2]))
    for own, stands in ((_AROUND, _STANDS[0]), (_BETWEEN, _STANDS[1])):
        safe = F.replace(safe, F.lit(own), F.lit(_ESCAPE + stands))
    odd = text.contains(_AROUND) | text.contains(_BETWEEN) | text.contains(_ESCAPE)
    return F.split(F.regexp_replace(F.when(odd, safe).otherwise(text), _ALL, _MARKED), _AROUND)


def _restored(text: Column) -> Column:
    out = text
    for own, stands in ((_AROUND, _STANDS[0]), (_BETWEEN, _STANDS[1]), (_ESCAPE, _STANDS[2])):
        out = F.replace(out, F.lit(_ESCAPE + stands), F.lit(own))
    return F.when(text.contains(_ESCAPE), out).otherwise(text)


def _entity(piece: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(type, value) of an odd piece."""
    kinds = F.split(F.lit(" ".join(KINDS)), " ")
    return _let(F.split(piece, _BETWEEN), lambda s: f(F.element_at(kinds, F.array_position(F.transform(s, lambda v: v != ""), F.lit(True)).cast("int")), F.array_join(s, "")))


def entities(docs: DataFrame) -> DataFrame:
    """row, entity, value for each entity found in docs (doc_id, text), in no order; row: a hash of id and text, never null. Of a name, each word is one."""
    rows = plain(docs, ["doc_id", "text"]).where(F.col("text").rlike(_MAYBE)).select(F.xxhash64("doc_id", "text").alias("row"), _pieces(F.col("text")).alias("p"))

    def found(kind: Column, value: Column) -> Column:
        one = F.array(F.struct(kind.alias("entity"), value.alias("value")))
        return F.when(kind == "name", F.transform(_words(value), lambda w: F.struct(w["role"].alias("entity"), w["value"].alias("value")))).otherwise(one)

    each = F.flatten(F.transform(F.filter("p", lambda _, i: i % 2 == 1), lambda x: _entity(x, found)))
    return rows.where(F.size("p") > 1).select("row", F.explode(each).alias("e")).select("row", "e.entity", "e.value")


def _shown(entity: Column, value: Column, key: str, attempt: Column) -> Column:
    return F.when(entity.rlike("^(?:surname|first|initial)_"), word_surrogate(entity, value, key, attempt)).otherwise(surrogate(entity, value, key, attempt))


def attempts(values: DataFrame, key: str) -> DataFrame | None:
    """entity, same, attempt of the distinct values (same: the canonical form) whose first surrogate collides; None if none does.

    A surrogate collides if another value has it, or if it is itself a value found. The smallest
    value keeps a shared one.
    """
    parts = max(values.sparkSession.sparkContext.defaultParallelism, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    same = canonical(F.col("entity"), F.col("value")).alias("same")
    own = settled(values.select("entity", "value", same).groupBy("entity", "same").agg(F.min("value").alias("value")).repartition(parts, "entity", "same"))  # few bytes, much work
    real = own.select("entity", F.col("same").alias("shown"))
    drawn = own.withColumn("attempt", F.lit(0))
    new = _let(_shown(F.col("entity"), F.col("value"), key, F.col("attempt")), lambda x: canonical(F.col("entity"), x))
    n = 0
    while True:
        shown = settled(drawn.withColumn("shown", new))
        shared = shown.groupBy("entity", "shown").agg(F.count("*").alias("n"), F.min("same").alias("first")).where("n > 1")
        bad = shown.join(shared, ["entity", "shown"]).where("same <> first").select("entity", "same")
        bad = settled(bad.unionByName(shown.join(real, ["entity", "shown"], "left_semi").select("entity", "same")).distinct())
        bad = bad.where("not startswith(entity, 'initial')")  # one turn of the alphabet: never two alike
        if not bad.limit(1).count():
            break
        if n == DRAWS:
            raise RuntimeError(f"surrogates still collide after {DRAWS} draws")
        drawn = shown.join(bad.withColumn("again", F.lit(1)), ["entity", "same"], "left").select("entity", "same", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")).repartition(parts, "entity", "same")
        n += 1
    return drawn.where("attempt > 0").select("entity", "same", "attempt") if n else None


def _key_of(kind: Column, same: Column) -> Column:
    return F.concat(kind, F.lit("\x1f"), same)


def pseudonymized(docs: DataFrame, key: str = "resumelake") -> DataFrame:
    """docs, the entities of text replaced by surrogates; a column of entity counts, n_entities, is added.

    A null text stays null with no entities; empty texts stay empty; repeated rows get the same
    text; an empty table gives an empty result; other columns, whatever their names, stay as they are (one named n_entities is replaced).
    Names are sought behind titles only.
    """
    found = entities(docs)
    redo = attempts(found, key)
    names = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(F.struct(*names).alias("d"), F.xxhash64("doc_id", "text").alias("row"))
    if redo is None:
        tries = lambda kind, same: F.lit(0)
    else:
        redo = settled(redo)
        small = redo.count() <= SENT
        held = found.withColumn("same", canonical(F.col("entity"), F.col("value"))).join(F.broadcast(redo) if small else redo, ["entity", "same"])
        again = settled(held.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct(_key_of(F.col("entity"), F.col("same")).alias("k"), "attempt"))).alias("again")))
        rows = rows.join(F.broadcast(again) if again.count() <= SENT else again, "row", "left")
        tries = lambda kind, same: F.coalesce(F.try_element_at("again", _key_of(kind, same)), F.lit(0))
    rows = rows.select("*", F.when(_maybe(F.col("d.text")), _pieces(F.col("d.text"))).alias("p"))

    def shown(kind: Column, value: Column) -> Column:
        other = surrogate(kind, value, key, tries(kind, canonical(kind, value)))
        return F.when(kind == "name", name_surrogate(value, key, tries)).otherwise(other)

    new = _restored(F.array_join(F.transform("p", lambda x, i: F.when(i % 2 == 1, _entity(x, shown)).otherwise(x)), ""))
    text = F.when(F.size("p") > 1, new).otherwise(F.col("d.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("d").getField(c).alias(c) for c in names], F.coalesce(F.floor(F.size("p") / 2), F.lit(0)).cast("long").alias("n_entities"))
