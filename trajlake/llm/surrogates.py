"""Surrogates for personal data: keyed, type-consistent replacements. DataFrame functions only.

Found: e-mail addresses, hexadecimal secrets, account numbers with country letters, IPv4
addresses, card numbers, social-security numbers, phone numbers, and names after a form of
address. Entities are told apart in a normal form (lower case; digits only for numbers), so
that spellings of one entity share a surrogate, in all documents. A surrogate keeps

* format: each digit gives a digit, each vowel a vowel, each consonant a consonant, signs
  stay, upper case stays; a card keeps its first digit and its checksum's remainder, an
  address its octets within 255 and their digits, a phone with ``+`` its first digit;
* script: letters stay in their Unicode script (those of scripts not in ``SCRIPTS`` become
  Latin ones, digits other than 0 to 9 become those);
* gender: a name after a male or female form of address gets a given name of that gender
  (and script); surnames and mail domains have surrogates of their own, so that relatives
  and colleagues remain recognisable as such.

A name has any number of capitalised words and initials, with particles such as "von" before
them. Where a text has a name after a form of address, its surname and its words next to each
other are also replaced elsewhere in that text, and count as mentions. A given name that stands
alone is not, as many are words too ("Will", "May").

Characters come from SHA-256 of key, type, normal form and attempt. Collisions are checked
over the whole corpus: surrogates that equal another one, or any entity found, or their own
original, are drawn again with the next attempt until none is left. From ``GROW`` attempts
on, names and addresses get extra letters, so the search ends.

Only entities and the texts that hold any are joined; other texts are passed through.

Nulls: null texts stay null, ids and other columns are kept as they are, whatever their
names. Empty texts and texts without entities are unchanged. Equal texts get equal results,
repeated rows stay repeated, an empty table gives an empty one. Texts are searched whole.
"""

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import save

# Forms of address and given names.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа")
PLAIN_TITLES = ("Dr", "Prof")
GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Lukas", "Martin", "Oscar", "Paul", "Simon", "Thomas", "Victor"),
    ("f", "latin"): ("Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Helena", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sara", "Vera"),
    ("n", "latin"): ("Alex", "Andrea", "Charlie", "Dominique", "Jamie", "Kim", "Lou", "Robin", "Sam", "Toni"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Олег", "Павел", "Роман"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Полина", "Софья"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Слава", "Шура"),
}
ALPHABETS = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "áàâäãéèêëíìîïóòôöõúùûü",
    "ßçñ",
    "аеиоуыэюя",
    "бвгджзклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
    "王李张刘陈杨黄赵周吴徐孙马朱胡郭何高林罗",
)

# Java's names of scripts; letters outside ALPHABETS are drawn from those of their script.
SCRIPTS = (
    "Latin", "Cyrillic", "Greek", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Armenian", "Georgian", "Devanagari", "Bengali",
    "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao", "Tibetan", "Myanmar", "Khmer",
    "Ethiopic",
)


def _letters(script: str) -> str:
    """Up to 64 letters of a script that have no upper case or one of a single character."""
    plain = [chr(c) for c in range(0x100, 0xD7A4) if unicodedata.name(chr(c), "").startswith(script.upper() + " ")]
    plain = [c for c in plain if unicodedata.category(c) in ("Ll", "Lo") and (c.upper() == c or c.upper().lower() == c and len(c.upper()) == 1)]
    return "".join(plain[:64])


FALLBACK = {f"\\p{{Is{x}}}": _letters(x) for x in SCRIPTS} | {
    r"\p{IsHan}": ALPHABETS[-1] + "田中山本村川口松木井石小大野原藤佐伊加美金池森安",
    r"\p{L}": ALPHABETS[2],
    r"\p{N}": ALPHABETS[0],
}

GROW = 2
KEY = "trajlake"

_FREE = r"(?<![\p{L}\p{N}])"
_DONE = r"(?![\p{L}\p{N}])"
# Where an address can start: after signs too, but not at a later part of a run of letters, digits and
# signs, as the run's first part gives the same match or none. After a mention the rest of a run is new.
_START = r"(?<![\p{L}\p{N}])(?:(?<![\p{L}\p{N}][._%+-]{1,16})|(?<=\G[._%+-]{1,16}))"
PARTICLES = (
    "von", "vom", "zu", "zum", "zur", "van", "den", "der", "ter", "ten", "de", "des", "del", "della", "di", "da", "do", "dos", "das", "du",
    "la", "le", "los", "las", "af", "av", "al", "el", "bin", "ibn", "ben", "фон", "де",
)
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
# A word with its apostrophes and hyphens, without the possessive's.
_REST = r"(?:(?!['’]s(?!\p{L}))['’-]\p{L}+)*+"
_WORD = r"(?:(?:\p{Lu}\.-?)++(?!\p{L})|(?:\p{Lu}\.-?)*\p{Lu}\p{L}*+" + _REST + ")"
_NAME = f"(?:{_PARTICLE} )*+{_WORD}(?: (?:{_PARTICLE} )*+{_WORD})*+"
#: Cuts any text into words and what is between them.
TOKEN = r"\p{L}++" + _REST + r"|[^\p{L}]++"


def _after(titles: tuple[str, ...]) -> str:
    # The capital is looked for first, as looking back is slow.
    return rf"(?<= )(?=\p{{Lu}}|{_PARTICLE} )(?<=(?<!\p{{L}})(?:" + "|".join(titles) + r")\.? )" + _NAME


TYPES = {
    "email": _START + r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}-]+\.)+\p{L}[\p{L}\p{N}-]*",
    "secret": _FREE + r"(?:AKIA[0-9A-Z]{16}|(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,128})" + _DONE,
    "iban": _FREE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _DONE,
    "ip": _FREE + r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)" + _DONE,
    "card": _FREE + r"\d(?:[ -]?\d){12,18}" + _DONE,
    "ssn": _FREE + r"\d{3}-\d{2}-\d{4}" + _DONE,
    "phone_plus": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}" + _DONE,
    "phone": _FREE + r"(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})" + _DONE,
    "name_m": _after(MALE_TITLES),
    "name_f": _after(FEMALE_TITLES),
    "name_n": _after(PLAIN_TITLES),
}
def _hint() -> str:
    """A pattern that is quickly searched for and found wherever any type is."""
    titles = sorted({*MALE_TITLES, *FEMALE_TITLES, *PLAIN_TITLES})
    first = "".join(sorted({t[0] for t in titles} | {"A"}))
    return rf"(?=[0-9@{first}])(?:[0-9@]|AKIA|(?:{'|'.join(titles)})\.? \p{{L}})"


HINT = _hint()
ANY = "|".join(f"(?:{p})" for p in TYPES.values())


def mentions(text: Column) -> Column:
    """All mentions in order, an array of strings."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def typed(mention: Column, before: Column) -> Column:
    """The type of a mention; ``before`` is the text that leads up to it, for the form of address."""
    kind = F.lit("name_n")
    for name, titles in (("name_m", MALE_TITLES), ("name_f", FEMALE_TITLES)):
        kind = F.when(before.rlike(r"(?<!\p{L})(?:" + "|".join(titles) + r")\.? $"), name).otherwise(kind)
    for name in reversed([x for x in TYPES if not x.startswith("name")]):
        bare = "^(?:" + TYPES[name] + ")$"
        kind = F.when(mention.rlike(bare), name).otherwise(kind)
    return kind


def normal_form(kind: Column, mention: Column) -> Column:
    low = F.lower(mention)
    return F.when(kind.isin("card", "ssn", "phone_plus", "phone", "iban"), F.regexp_replace(low, r"[^\p{L}\p{N}]", "")).otherwise(low)


def filled(text: str, digest: str, keep: int | str = 0, by: str = "i") -> str:
    """SQL: ``text`` with each letter or digit from position ``keep`` on drawn anew from its own alphabet, by position or letter ``c``."""
    draw = f"pmod(xxhash64({{d}}, {by}), {{n}})"
    cases = " ".join(
        f"WHEN instr({_literal(a)}, c) > 0 THEN substr({_literal(a)}, cast({draw.format(d=digest, n=len(a))} as int) + 1, 1)"
        for a in ALPHABETS
    )
    cases += " WHEN ascii(c) < 128 THEN c " + " ".join(
        f"WHEN c rlike {_literal(pattern)} THEN substr({_literal(a)}, cast({draw.format(d=digest, n=len(a))} as int) + 1, 1)"
        for pattern, a in FALLBACK.items()
    )
    return f"array_join(transform(filter(split({text}, ''), c -> c != ''), (c, i) -> CASE WHEN i < {keep} THEN c {cases} ELSE c END), '')"


def _hexadecimal(digest: str) -> str:
    draws = "pmod(xxhash64({d}, i), {n})"
    return (
        "array_join(transform(filter(split(norm, ''), c -> c != ''), (c, i) -> CASE "
        f"WHEN instr('0123456789', c) > 0 THEN substr('0123456789', cast({draws.format(d=digest, n=10)} as int) + 1, 1) "
        f"ELSE substr('abcdef', cast({draws.format(d=digest, n=6)} as int) + 1, 1) END), '')"
    )


def _luhn(digits: str) -> str:
    """SQL: the checksum of a card number modulo 10."""
    return (
        f"pmod(aggregate(transform(filter(split(reverse({digits}), ''), c -> c != ''), (c, i) -> "
        "cast(c as int) * if(i % 2 = 1, 2, 1) - if(i % 2 = 1 and c >= '5', 9, 0)), 0, (a, x) -> a + x), 10)"
    )


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """Add ``sub``, the surrogate of ``norm`` for ``type`` and ``attempt``."""
    rows = entities.withColumn("_d", F.sha2(F.concat_ws("|", F.lit(key), "type", "norm", F.col("attempt").cast("string")), 256))
    more = f"substr(translate(_d, '0123456789', 'ghijklmnop'), 1, cast(greatest(0, attempt - {GROW}) as int))"
    # Parts with a surrogate of their own, whatever they are part of.
    rows = rows.withColumns(
        {
            "_local": F.substring_index("norm", "@", 1),
            "_host": F.regexp_extract("norm", r"@(.*)\.[^.]*$", 1),
            "_last": F.regexp_extract("norm", r"(\.[^.]*)$", 1),
            "_given": F.when(F.col("norm").rlike(rf"^(?!{_PARTICLE} )[^ .]+ "), F.substring_index("norm", " ", 1)).otherwise(""),
        }
    )
    rows = rows.withColumns(
        {
            "_hd": F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), "_host"), 256),
            "_gd": F.sha2(F.concat_ws("|", F.lit(key), F.lit("given"), "type", "_given", F.col("attempt").cast("string")), 256),
        }
    )
    octets = (
        "array_join(transform(split(norm, '[.]'), (o, i) -> cast(CASE length(o) "
        "WHEN 1 THEN pmod(xxhash64(_d, i), 10) WHEN 2 THEN 10 + pmod(xxhash64(_d, i), 90) "
        "ELSE 100 + pmod(xxhash64(_d, i), 156) END as string)), '.')"
    )
    card = filled("norm", "_d", 1)
    rows = rows.withColumn("_card", F.when(F.col("type") == "card", F.expr(card)))
    card = (
        "concat(left(_card, length(_card) - 1), cast(pmod("
        f"{_luhn('norm')} - {_luhn('concat(left(_card, length(_card) - 1), chr(48))')}, 10) as string))"
    )
    given = F.lit("")
    for (gender, script), names in GIVEN.items():
        fits = (F.col("type") == f"name_{gender}") & (F.col("norm").rlike(r"\p{IsCyrillic}") == F.lit(script == "cyrillic"))
        pick = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("_gd"), F.lit(len(names))) + 1).cast("int"))
        given = F.when(fits, F.lower(pick)).otherwise(given)
    # Attempts after the first also change the family's surrogate.
    own = f"sha2(concat_ws('|', {_literal(key)}, 'family', w), 256)"
    family = f"if(attempt > 0 and j = size(split(norm, ' ')) - 1, _d, {own})"
    # Equal initials of a name get equal ones, so that each word has one surrogate in a text.
    initials = f"if(attempt > 0 and j = size(split(norm, ' ')) - 1, _d, sha2({_literal(key + '|initial')}, 256))"
    particles = ", ".join(map(_literal, PARTICLES))
    rows = rows.withColumn("_g", given)
    words = (
        "array_join(transform(split(norm, ' '), (w, j) -> CASE WHEN j = 0 and _given != '' THEN _g "
        f"WHEN w in ({particles}) THEN w WHEN w rlike '^(.[.]-?)+$' THEN {filled('w', initials, by='c')} ELSE {filled('w', family)} END), ' ')"
    )
    name = F.concat(F.expr(words), F.expr(more))
    email = F.concat(F.expr(filled("_local", "_d")), F.expr(more), F.lit("@"), F.expr(filled("_host", "_hd")), F.col("_last"))
    sub = (
        F.when(F.col("type") == "email", email)
        .when(F.col("type") == "secret", F.when(F.col("norm").startswith("akia"), F.expr(filled("norm", "_d", 4))).otherwise(F.expr(_hexadecimal("_d"))))
        .when(F.col("type") == "iban", F.expr(filled("norm", "_d", 2)))
        .when(F.col("type") == "ip", F.expr(octets))
        .when(F.col("type") == "card", F.expr(card))
        .when(F.col("type") == "phone_plus", F.expr(filled("norm", "_d", 1)))
        .when(F.col("type").isin("ssn", "phone"), F.expr(filled("norm", "_d")))
        .otherwise(name)
    )
    return rows.select("type", "norm", "attempt", sub.alias("sub"))


def assigned(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``type, norm, attempt, sub`` for distinct ``type, norm``; all ``sub`` of a type differ and none is a ``norm``.

    Each round is one pass over the entities, and only those in conflict are drawn again.
    """
    current = save(drawn(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        # The entity that keeps a contested surrogate: the one drawn earliest, then the smallest.
        keeper = current.groupBy("type", "sub").agg(F.min(F.struct("attempt", "norm"))["norm"].alias("_keeper"))
        originals = current.select(F.col("type").alias("_t"), F.col("norm").alias("_n"))
        judged = (
            current.join(keeper, ["type", "sub"])
            .join(originals, (F.col("type") == F.col("_t")) & (F.col("sub") == F.col("_n")), "left")
            .withColumn("_again", (F.col("norm") != F.col("_keeper")) | F.col("_n").isNotNull())
        )
        judged = save(judged.select("type", "norm", "attempt", "sub", "_again"), "judged")
        if judged.where("_again").isEmpty():
            return judged.drop("_again")
        redrawn = drawn(judged.where("_again").select("type", "norm", (F.col("attempt") + 1).alias("attempt")), key)
        current = save(judged.where("not _again").drop("_again").unionByName(redrawn), "surrogates")


def rendered(kind: str = "type", mention: str = "mention", sub: str = "sub") -> Column:
    """The surrogate in the spelling of the mention: its signs, its spaces and its upper case."""
    signs = r"'[^\\p{L}\\p{N}]'"
    bare = f"regexp_replace({sub}, {signs}, '')"
    at = f"length(regexp_replace(substr({mention}, 1, i + 1), {signs}, ''))"
    letter = f"substr({bare}, {at}, 1)"
    laid = F.expr(
        f"array_join(transform(filter(split({mention}, ''), c -> c != ''), (c, i) -> "
        f"CASE WHEN c rlike {signs} THEN c WHEN c != lower(c) THEN upper({letter}) ELSE {letter} END), '')"
    )
    shout = F.col(mention) == F.upper(mention)
    words = F.expr(
        f"array_join(zip_with(split({mention}, ' '), split({sub}, ' '), (m, s) -> CASE WHEN m = lower(m) THEN s "
        "WHEN m = upper(m) and m rlike '\\\\p{L}.*\\\\p{L}' THEN upper(s) WHEN length(m) != length(s) THEN initcap(s) "
        "ELSE array_join(transform(filter(split(m, ''), c -> c != ''), (c, i) -> "
        "if(c != lower(c), upper(substr(s, i + 1, 1)), substr(s, i + 1, 1))), '') END), ' ')"
    )
    return (
        F.when(F.col(kind).startswith("name"), words)
        .when((F.col(kind) == "email") & (F.char_length(sub) != F.char_length(mention)), F.when(shout, F.upper(sub)).otherwise(F.col(sub)))
        .when(F.col(kind) == "ip", F.col(sub))
        .otherwise(laid)
    )


def _key(text: Column) -> Column:
    """Tells texts apart by more than 128 bits."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.reverse(text), F.char_length(text)).alias("b"))


def _split(text: str) -> dict[str, Column]:
    """The text between mentions (one more than mentions), and the mentions."""
    return {"_parts": F.split(text, ANY, -1), "_found": mentions(F.col(text))}


def _tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {_literal(TOKEN)}, 0)"


def name_words(spelled: DataFrame) -> DataFrame:
    """``_k, _words``: per text a map from each word of its names to its surrogate and whether it is a surname."""
    pairs = F.expr(
        f"filter(transform({_tokens('mention')}, (w, i) -> named_struct('w', w, 's', get({_tokens('sub')}, i), "
        f"'f', i = size({_tokens('mention')}) - 1 and length(w) > 1)), x -> x.w rlike '\\\\p{{L}}' and x.s is not null)"
    )
    listed = spelled.where(F.col("type").startswith("name")).select("_k", "pos", F.explode(pairs).alias("_p")).select("_k", "pos", "_p.*")
    loud = listed.select("_k", "pos", F.upper("w").alias("w"), F.upper("s").alias("s"), "f")
    once = listed.unionByName(loud).groupBy("_k", "w").agg(F.min(F.struct("pos", "s"))["s"].alias("s"), F.max("f").alias("f"))
    return once.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("s", "f")))).alias("_words"))


def _with_bare(parts: str, words: str) -> str:
    """SQL: ``text, n`` per part: the part with bare mentions replaced, and their number. A run of words is one mention."""
    near = "coalesce(get(y.t, {a}) in (' ', '. ', '.') and get(y.m, {b}) is not null, false)"
    hit = f"(x is not null and (x.f or {near.format(a='i - 1', b='i - 2')} or {near.format(a='i + 1', b='i + 2')}))"
    looked = f"transform({parts}, p -> transform(array({_tokens('p')}), t -> named_struct('t', t, 'm', transform(t, x -> try_element_at({words}, x))))[0])"
    judged = f"transform({looked}, y -> named_struct('t', y.t, 'm', y.m, 'h', transform(y.m, (x, i) -> {hit})))"
    first = "get(y.h, i) and not coalesce(get(y.t, i - 1) in (' ', '. ', '.') and get(y.h, i - 2), false)"
    return (
        f"transform({judged}, y -> named_struct('text', array_join(transform(y.t, (t, i) -> if(get(y.h, i), get(y.m, i).s, t)), ''), "
        f"'n', size(filter(y.t, (t, i) -> {first}))))"
    )


def replace(docs: DataFrame, key: str = KEY, column: str = "text", count_as: str = "n_entities") -> tuple[DataFrame, DataFrame]:
    """``docs`` with surrogates in ``column`` and the number of mentions in ``count_as``; and ``type, norm, sub``.

    A column of ``docs`` that is called like ``count_as`` is replaced.
    """
    # The row is carried as one struct, so that its columns can have any names.
    rows = docs.select(F.struct("*").alias("_row"), F.col(column).cast("string").alias("_t"))
    # The quick pattern first: few texts need the other one.
    touched = F.coalesce(F.col("_t").rlike(HINT) & F.col("_t").rlike(ANY), F.lit(False))
    pieces = rows.where(touched).select(_key(F.col("_t")).alias("_k"), *[c.alias(n) for n, c in _split("_t").items()])
    # What leads up to a mention: the end of the part before it holds any form of address.
    pairs = F.transform("_found", lambda m, i: F.struct(m.alias("mention"), F.right(F.element_at("_parts", i + 1), F.lit(16)).alias("before")))
    seen = pieces.select("_k", F.posexplode(pairs)).select("_k", "pos", "col.*")
    seen = seen.withColumn("type", typed(F.col("mention"), F.col("before"))).withColumn("norm", normal_form(F.col("type"), F.col("mention")))
    seen = save(seen.select("_k", "pos", "type", "mention", "norm").distinct(), "mentions")
    known = assigned(seen.select("type", "norm").distinct(), key)
    spelled = seen.join(known, ["type", "norm"]).select("_k", "pos", "type", "mention", rendered().alias("sub"))
    spelled = save(spelled, "spelled")
    ready = spelled.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub"))), lambda x: x["sub"]).alias("_subs"))
    ready = ready.join(name_words(spelled), "_k", "left")
    clean = rows.where(~touched).select("_row", "_t", F.lit(0).alias("_n"))
    dirty = rows.where(touched).withColumn("_k", _key(F.col("_t"))).join(ready, "_k", "left").withColumn("_parts", F.split("_t", ANY, -1))
    # One part more than surrogates: the mentions themselves are in neither.
    woven = F.expr("array_join(zip_with(_parts, _subs, (p, s) -> concat(p, coalesce(s, ''))), '')")
    named = F.col("_words").isNotNull()
    dirty = dirty.withColumn("_bare", F.when(named, F.expr(_with_bare("_parts", "_words"))))
    dirty = dirty.withColumn("_parts", F.when(named, F.col("_bare.text")).otherwise(F.col("_parts")))
    bare = F.when(named, F.aggregate("_bare.n", F.lit(0), lambda a, n: a + n)).otherwise(0)
    dirty = dirty.select("_row", woven.alias("_t"), (F.size("_parts") - 1 + bare).alias("_n"))
    kept = [F.col("_t").alias(c) if c == column else F.col("_row")[c].alias(c) for c in docs.columns if c != count_as]
    return clean.unionByName(dirty).select(*kept, F.col("_n").alias(count_as)), known
