"""Surrogates for personal data, in DataFrame and SQL functions alone.

``PATTERN`` finds secrets, mail addresses, bank accounts, network addresses,
phone numbers, identity and card numbers, and names after a title.  Each is
replaced by a surrogate of its kind: a keyed Feistel network over the entity's
characters, each shifted inside its own class (digit, vowel or consonant of its
script and case, hexadecimal digit), so that script, case, length and
punctuation stay.  Card and account numbers keep whether their check digits are
right, network addresses stay addresses, a phone number keeps its country code,
a listed given name is turned into another of its gender and script.

A person is known by a title, or by a listed given name before another name.  The
words of all such names of a text are looked for in the whole of it, so its other
mentions, by full, given or last name, get the same surrogates.  A person whom a
text gives neither a title nor a listed given name isn't found in it.

No repeat of a group is matched by recursion, which would end the executor on
a long run: they are possessive, or of one class of characters.  What begins
like a secret but is none (letters alone, not behind the word password) is
matched too, so that a long run is read once, and stays as it is.

A network is a permutation, so different entities of a format have different
surrogates, and the same entity (in any punctuation, for numbers; in any case,
for addresses) has the same one in every document: no table of entities travels
to the texts.  ``collisions`` checks that on the distinct entities of the whole
input, and ``replace_pii`` takes the next key if any two met.

Defined results: a null text stays null, a text without entities stays as it
is; an entity of any length is replaced whole; two dots in a mail address's domain
don't end it; an IPv6 address keeps its groups, so its short and its full spelling
are two entities; repeated rows are treated alike; an empty table gives no rows.  All columns
pass through; ``n_entities`` replaces an input column of that name.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that a surrogate's character is drawn from.
CLASSES = (
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâãäåèéêëìíîïòóôõöùúûü", "çñýÿßæøœ", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ", "ÇÑÝÆØŒ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ",
    "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
HEX = ("0123456789abcdef",)

# Titles and common given names, by gender and script.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа")
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н")
OTHER_TITLES = ("Dr", "Prof")
GIVEN_NAMES = (
    ("Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Lucia", "Maria", "Nora", "Sarah", "Sofia", "Teresa"),
    ("Adam", "Carlos", "Daniel", "David", "Felix", "James", "John", "Lucas", "Martin", "Paul", "Peter", "Thomas"),
    ("Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"),
    ("Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей"),
)

_TITLE = "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
_GIVEN = "|".join(itertools.chain.from_iterable(GIVEN_NAMES))
# A word of a name, without a possessive ending.
_PART = r"\p{Lu}(?:[\p{L}\-]|'(?!s(?!\p{L})))++"
# What a name is known by: titles, or a listed given name and another name.
# (A run of titles is read from its first alone.)
_KNOWN = (
    rf"(?<!\p{{L}})(?:(?<!(?:{_TITLE})\.? )(?:(?:{_TITLE})\.? )++|(?=(?:{_GIVEN}) \p{{Lu}}\p{{L}}))"
)
# A secret's value, and what it begins with if it needs no digit.
_VALUE = r"[A-Za-z0-9+/_.=\-]"
_PASSWORD = r"(?i)^(?:password|passwd|pwd)"
# Country codes by their first digits.
_COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Kinds and what finds them, in order of precedence.
KINDS = {
    "secret": r"(?i:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)\s{0,3}[:=]\s{0,3}"
    rf"[\"']?{_VALUE}{{8,}}+(?!@)",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9]{20,}+"
    r"|xox[abprs]-[A-Za-z0-9\-]{10,}+)",
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@"
    r"[\p{L}\p{N}\-][\p{L}\p{N}\-.]*(?<!\.)\.\p{L}\p{L}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[a-fA-F:]*+\d)(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|(?=[0-9a-fA-F:]{0,37}::)(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4})(?![\p{L}\p{N}:])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<!\d)\(\d{3}\) ?\d{3}[.\-]\d{4}(?!\d)|(?<!\d)\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d)",
    "hex": r"(?<![\p{L}\p{N}])(?=[a-fA-F]*\d)[0-9a-fA-F]{32,}(?![\p{L}\p{N}])",
    "name": rf"{_KNOWN}{_PART}(?: {_PART})?",
}
# The words of a name after its titles.
NAMED = rf"{_KNOWN}({_PART}(?: {_PART})?)"
PATTERN = "|".join(KINDS.values())
ROUNDS = 4
ATTEMPTS = 8

_names = itertools.count()


def _text(value: str) -> str:
    """A raw SQL string literal."""
    return "r'" + value.replace("'", "\\x27") + "'" if "'" in value else f"r'{value}'"


def _let(value: str, body) -> str:
    """``body`` of a name for ``value``, which is then computed once."""
    name = f"v{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def _shift(x: str, digest: str, classes: tuple[str, ...]) -> str:
    """Each character of ``x`` moved inside its class by two digits of ``digest``."""
    c, i = f"c{next(_names)}", f"i{next(_names)}"
    step = f"CAST(conv(substring({digest}, 1 + 2 * ({i} % 32), 2), 16, 10) AS INT)"
    listed = "array(" + ", ".join(f"'{k}'" for k in classes) + ")"
    own = f"get(filter({listed}, k -> instr(k, {c}) > 0), 0)"
    turned = _let(
        own,
        lambda k: f"if({k} IS NULL, {c}, substring({k}, 1 + (instr({k}, {c}) - 1 + {step}) % length({k}), 1))",
    )
    return f"if(length({x}) = 0, '', array_join(transform(split({x}, ''), ({c}, {i}) -> {turned}), ''))"


def _permuted(x: str, key: str, classes: tuple[str, ...] = CLASSES) -> str:
    """A keyed permutation of the strings of ``x``'s shape."""
    s, r, e = (f"{c}{next(_names)}" for c in "sre")

    def network(v: str) -> str:
        digest = f"sha2(concat('{key}:', {r}, ':', {s}.b), 256)"
        step = _let(digest, lambda h: f"named_struct('a', {s}.b, 'b', {_shift(f'{s}.a', h, classes)})")
        start = (
            f"named_struct('a', substring({v}, 1, CAST(length({v}) / 2 AS INT)), "
            f"'b', substring({v}, CAST(length({v}) / 2 AS INT) + 1))"
        )
        return (
            f"aggregate(sequence(1, {ROUNDS}), {start}, ({s}, {r}) -> {step}, {e} -> concat({e}.a, {e}.b))"
        )

    return _let(x, network)


def _refilled(shape: str, characters: str, of: str) -> str:
    """``shape`` with its characters of class ``of`` replaced, one by one, by ``characters``."""
    i = f"i{next(_names)}"
    before = f"length(regexp_replace(substring({shape}, 1, {i} - 1), '[^{of}]', ''))"
    each = (
        f"if(substring({shape}, {i}, 1) rlike '[{of}]', substring({characters}, 1 + {before}, 1), "
        f"substring({shape}, {i}, 1))"
    )
    return f"array_join(transform(sequence(1, length({shape})), {i} -> {each}), '')"


def _luhn(digits: str) -> str:
    """The check digit that makes ``digits`` and it a right card number."""
    t, i = f"t{next(_names)}", f"i{next(_names)}"
    d = f"CAST(substring({digits}, length({digits}) + 1 - {i}, 1) AS INT)"
    worth = f"if({i} % 2 = 1, ({d} * 2) % 10 + CAST({d} * 2 / 10 AS INT), {d})"
    total = f"aggregate(sequence(1, length({digits})), 0, ({t}, {i}) -> {t} + {worth})"
    return f"((10 - {total} % 10) % 10)"


def _card(m: str, key: str) -> str:
    def by_digits(d: str) -> str:
        first = f"substring({d}, 1, length({d}) - 1)"
        off = f"((CAST(substring({d}, length({d}), 1) AS INT) + 10 - {_luhn(first)}) % 10)"
        turn = f"CAST(conv(substring(sha2('{key}:card', 256), 1, 6), 16, 10) AS INT)"

        def rebuilt(p: str) -> str:
            # How far the check digit is off stays 0, or changes among 1 to 9.
            moved = f"if({off} = 0, 0, 1 + ({off} - 1 + {turn}) % 9)"
            return f"concat({p}, ({_luhn(p)} + {moved}) % 10)"

        return _let(_let(_permuted(first, key + ":card"), rebuilt), lambda n: _refilled(m, n, "0-9"))

    return _let(f"regexp_replace({m}, '[^0-9]', '')", by_digits)


def _digits(m: str, key: str) -> str:
    return _let(
        _permuted(f"regexp_replace({m}, '[^0-9]', '')", key), lambda n: _refilled(m, n, "0-9")
    )


def _phone(m: str, key: str) -> str:
    def split(d: str) -> str:
        code = f"if({m} LIKE '+%', regexp_extract({d}, {_text(_COUNTRY)}, 0), '')"
        return _let(
            code,
            lambda c: f"concat({c}, {_permuted(f'substring({d}, length({c}) + 1)', key + ':phone')})",
        )

    # The country code is told from the digits alone, whatever stands between them.
    return _let(
        _let(f"regexp_replace({m}, '[^0-9]', '')", split), lambda n: _refilled(m, n, "0-9")
    )


def _ip(m: str, key: str) -> str:
    whole = f"array_join(transform(split({m}, r'\\.'), o -> lpad(lower(hex(CAST(o AS INT))), 2, '0')), '')"
    parts = lambda h: ", ".join(
        f"conv(substring({h}, {2 * k + 1}, 2), 16, 10)" for k in range(4)
    )
    return _let(_permuted(whole, key + ":ip", HEX), lambda h: f"concat_ws('.', {parts(h)})")


def _email(m: str, key: str) -> str:
    def lowered(v: str) -> str:
        local = f"substring_index({v}, '@', 1)"
        domain = f"substring_index({v}, '@', -1)"
        last = f"concat('.', substring_index({domain}, '.', -1))"
        host = f"substring({domain}, 1, length({domain}) - length({last}))"
        new = f"concat({_permuted(local, key + ':local')}, '@', {_permuted(host, key + ':domain')}, {last})"
        return _let(new, lambda n: f"if({m} = upper({m}), upper({n}), {n})")

    return _let(f"lower({m})", lowered)


def _hex(m: str, key: str) -> str:
    new = _permuted(f"lower({m})", key + ":hex", HEX)
    return _let(new, lambda n: f"if({m} rlike '[A-F]', upper({n}), {n})")


def _secret(m: str, key: str) -> str:
    prefix = f"regexp_extract({m}, r'^[^:=]*[:=]\\s*[\"\\x27]?', 0)"

    def value(p: str) -> str:
        rest = f"substring({m}, length({p}) + 1)"
        each = lambda v: (
            f"if({v} rlike '^[0-9a-fA-F]+$', {_hex(v, key)}, {_permuted(v, key + ':secret')})"
        )
        return f"concat({p}, {_let(rest, each)})"

    return _let(prefix, value)


def _key(m: str, key: str) -> str:
    prefix = f"regexp_extract({m}, r'^(?:AKIA|gh[a-z]_|sk-|xox[a-z]-)', 0)"
    return _let(
        prefix,
        lambda p: f"concat({p}, {_permuted(f'substring({m}, length({p}) + 1)', key + ':key')})",
    )


def _iban(m: str, key: str) -> str:
    def account(a: str) -> str:
        own = f"substring({a}, 5)"

        def checked(new: str) -> str:
            t, c = f"t{next(_names)}", f"c{next(_names)}"
            v = f"CAST(conv({c}, 36, 10) AS INT)"
            chars = f"filter(split(concat({new}, substring({a}, 1, 2), '00'), ''), x -> x <> '')"
            rest = f"aggregate({chars}, 0, ({t}, {c}) -> ({t} * if({v} > 9, 100, 10) + {v}) % 97)"
            full = f"concat(substring({a}, 1, 2), lpad(CAST(98 - {rest} AS STRING), 2, '0'), {new})"
            return _let(full, lambda n: _refilled(m, n, "A-Z0-9"))

        return _let(_permuted(own, key + ":iban"), checked)

    return _let(f"replace({m}, ' ', '')", account)


def _words(m: str, key: str) -> str:
    """Each word of a name by its own surrogate, so that parts of a name agree with the whole."""
    x = f"x{next(_names)}"
    turn = f"CAST(conv(substring(sha2('{key}:given', 256), 1, 6), 16, 10) AS INT)"
    cases = ""
    for names in GIVEN_NAMES:
        listed = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
        at = f"array_position({listed}, {x})"
        step = f"(1 + {turn} % {len(names) - 1})"
        cases += f" WHEN {at} > 0 THEN {listed}[CAST(({at} - 1 + {step}) % {len(names)} AS INT)]"
    each = f"CASE{cases} ELSE {_permuted(x, key + ':name')} END"
    return f"array_join(transform(split({m}, ' '), {x} -> {each}), ' ')"


def _name(m: str, key: str) -> str:
    title = f"regexp_extract({m}, {_text(rf'^(?:(?:{_TITLE})\.? )++')}, 0)"
    return _let(
        title,
        lambda t: f"concat({t}, {_let(f'substring({m}, length({t}) + 1)', lambda rest: _words(rest, key))})",
    )


_SURROGATES = {
    "secret": _secret, "key": _key, "email": _email, "iban": _iban, "ip": _ip, "phone": _phone,
    "ip6": lambda m, key: _hex(m, key + ":ip6"), "ssn": lambda m, key: _digits(m, key + ":ssn"), "card": _card, "hex": _hex, "name": _name,
    "mention": _words,
}


def _kind_of(m: str) -> str:
    cases = " ".join(f"WHEN {m} rlike {_text(f'^(?:{p})$')} THEN '{k}'" for k, p in KINDS.items())
    return f"CASE WHEN {_none(m)} THEN 'none' {cases} ELSE 'mention' END"


def _none(m: str) -> str:
    """Whether ``m`` only begins like a secret: it is letters alone, and no password."""
    secret = _text(f"^(?:{KINDS['secret']})$")
    return f"({m} rlike {secret} AND NOT {m} rlike '[0-9]' AND NOT {m} rlike '{_PASSWORD}')"


def surrogate_sql(entity: str, key: str) -> str:
    """SQL for the surrogate of ``entity`` (SQL for a string that ``PATTERN`` matched)."""

    def chosen(kind: str, m: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {make(m, key)}" for k, make in _SURROGATES.items())
        return f"CASE {kind} {cases} ELSE {m} END"

    return _let(entity, lambda m: _let(_kind_of(m), lambda kind: chosen(kind, m)))


def _possible(text: Column) -> Column:
    """What every text with an entity has: a digit, an @, a word that a secret or a key
    begins with, or what a name is known by.

    Most texts have none of these, and so don't meet ``PATTERN`` at all.
    """
    out = text.rlike("[0-9@]") | _person(text)
    for word in ("passw", "pwd"):
        out = out | F.lower(text).contains(word)
    return out | text.rlike("gh[pousr]_|sk-|xox[abprs]-|AKIA")


def _person(text: Column) -> Column:
    """Whether a text has a title or a listed given name before a blank."""
    out = F.lit(False)
    for title in FEMALE_TITLES + MALE_TITLES + OTHER_TITLES:
        out = out | text.contains(f"{title} ") | text.contains(f"{title}. ")
    for name in itertools.chain.from_iterable(GIVEN_NAMES):
        out = out | text.contains(f"{name} ")
    return out


def pattern(text: str) -> Column:
    """``PATTERN``, and the words of the names that a text has."""
    whole = F.col(text)
    titles = [t for t in FEMALE_TITLES + MALE_TITLES + OTHER_TITLES]
    found = F.array_distinct(
        F.split(F.array_join(F.regexp_extract_all(whole, F.lit(NAMED), F.lit(1)), " "), " ")
    )
    # Longer words before those that they begin with.
    words = F.reverse(F.array_sort(F.array_except(found, F.array(*[F.lit(t) for t in ["", *titles]]))))
    listed = F.when(_person(whole), F.array_join(words, "|"))
    mention = F.concat(
        F.lit(PATTERN + r"|(?<!\p{L})(?:"), listed, F.lit(r")(?: (?:"), listed, F.lit(r"))?(?!\p{L})")
    )
    return F.when(listed != "", mention).otherwise(F.lit(PATTERN))


def entities(text: str, pattern: Column) -> Column:
    """All matches of a text, in order; ``pattern``: what ``pattern(text)`` gives."""
    whole = F.col(text)
    found = F.regexp_extract_all(whole, pattern, F.lit(0))
    return F.when(_possible(whole), found).otherwise(F.array().cast("array<string>"))


def canonical_sql(m: str) -> str:
    """What is one entity in several spellings: case of addresses, punctuation of numbers."""

    def spelt(v: str, k: str) -> str:
        return (
            f"concat({k}, ':', CASE WHEN {k} IN ('email', 'hex', 'ip6') THEN lower({v}) "
            f"WHEN {k} IN ('card', 'phone', 'iban') THEN regexp_replace({v}, '[^0-9A-Z+]', '') ELSE {v} END)"
        )

    return _let(m, lambda v: _let(_kind_of(v), lambda k: spelt(v, k)))


def collisions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Surrogates that two different entities of ``docs`` have: none, or ``key`` won't do."""
    found = docs.select(F.col(text).alias("__text"), pattern(text).alias("__pattern"))
    found = found.select(F.explode(entities("__text", F.col("__pattern"))).alias("m"))
    found = found.where(f"NOT {_none('m')}").distinct()
    both = found.select(
        F.expr(canonical_sql("m")).alias("entity"),
        F.expr(canonical_sql(surrogate_sql("m", key))).alias("surrogate"),
    ).distinct()
    return both.groupBy("surrogate").agg(F.count("*").alias("n")).where("n > 1")


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities`` found."""
    for attempt in range(ATTEMPTS):
        used = f"{key}/{attempt}"
        if collisions(docs, used, text).limit(1).count() == 0:
            break
    else:
        raise RuntimeError("no key keeps all entities apart")
    found = docs.withColumn("__pattern", pattern(text))
    found = found.withColumn("__found", entities(text, F.col("__pattern")))
    made = F.expr(f"transform(__found, m -> {surrogate_sql('m', used)})")
    between = F.split(F.col(text), F.col("__pattern"), -1)
    # Text before each entity and its surrogate, in turn; the text after the last.
    pairs = F.zip_with(
        between, F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b)
    )
    new = F.when(F.size("__found") > 0, F.array_join(pairs, "")).otherwise(F.col(text))
    names = [f"`{c}`" for c in docs.columns if c not in (text, "n_entities")]
    order = [f"`{c}`" for c in docs.columns if c != "n_entities"]
    some = F.expr(f"size(filter(__found, m -> NOT {_none('m')}))")
    count = F.greatest(some, F.lit(0)).alias("n_entities")
    return found.select(*names, new.alias(text), count).select(*order, "n_entities")
