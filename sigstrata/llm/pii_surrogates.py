"""PII replaced by keyed surrogates (operator 8); DataFrame functions only.

Entities: e-mail addresses, IPv4 addresses, payment card numbers, social security numbers, phone
numbers, and person names (after a title, or a known given name followed by a capitalised word; and every bare
repeat of a part of such a name, of two letters or more, in the same text).

An entity is known by its kind and its normal form (an address in lower case, the digits of a number, a name part
in lower case), so all mentions of it, however written, get the same surrogate (coreference). A name is
replaced part by part, so ``Mrs Anna Weber``, ``Mrs Weber``, ``Mrs Anna`` and ``Weber`` share the new parts. A phone number is
its country code and the rest; numbers of the format ``555 123 4567`` have code 1. A surrogate is
drawn from a keyed hash (SHA-512 of key, kind, normal form and attempt), and keeps the type:

* digits stay digits, letters stay letters of their alphabet and case, and punctuation and spacing of each mention stay;
* octets keep their number of digits and their range, the top-level domain and a phone number's country code stay;
* a format that is full is left: after ``WIDER`` attempts in vain the octets of an address take any number of
  digits, an e-mail address gets one more letter in front and a number one more digit at its end for each ``WIDER`` attempts
  (names grow by syllables), so every corpus gets its surrogates;
* card numbers pass the Luhn test if they did;
* a name part keeps its script (Latin, Cyrillic or Greek) and has one gender in the corpus: the one that most documents tell
  by a title before it as a given name, else that of the list, else none. New names are built from syllables with the endings of
  that gender. Where documents disagree, coreference goes before the gender of the single mention.

Collision checks keep entities apart: all surrogates of a kind are compared with each other and
with all real entities of the corpus; where two meet, the smallest keeps it and the others draw the
next attempt, until none is left. Only entities on a later attempt, or with a gender that the list does not
tell, are joined back to their documents. Give a secret ``key``: who has it can test guesses.

Edge cases: null and empty texts stay. Rows equal in id and text are replaced alike; null and
repeated ids and other columns are kept (columns named like a result column are replaced). An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pinned, sheltered, text_of

# -- fixed values: titles and common given names by gender ----------------------------------------
MALE_TITLES = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]
OTHER_TITLES = ["Dr", "Prof"]
MALE_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Paul", "Hans", "Klaus", "Jürgen",
              "Pierre", "Jean", "Jacques", "Carlos", "José", "Juan", "Иван", "Пётр", "Сергей", "Алексей", "Γιώργος", "Νίκος"]
FEMALE_NAMES = ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Anna", "Ursula", "Monika",
                "Petra", "Marie", "Claire", "Sophie", "María", "Carmen", "Lucía", "Мария", "Елена", "Ольга", "Наталья", "Μαρία",
                "Ελένη"]
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga go ka ke ko la le li lo lu ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve vi".split(),
             "cyrillic": "ба бе би бо да де ди до га го ка ке ко ла ле ли ло лу ма ме ми мо на не ни но па пе ра ре ри ро са се со та те ти то ва ве ви".split(),
             "greek": "βα βε βι βο δα δε δι δο γα γο κα κε κο λα λε λι λο λυ μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σο τα τε τι το".split()}
ENDINGS = {"latin": ("n", "na", "l"), "cyrillic": ("н", "на", "л"), "greek": ("ς", "να", "λ")}

# -- patterns -----------------------------------------------------------------------------------
# The country codes of one and of two digits; all others have three.
SHORT_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
               "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86",
               "90", "91", "92", "93", "94", "95", "98"]
COUNTRY = rf"^(?:{'|'.join(SHORT_CODES)}|\d{{3}})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)


def _words(words: list[str]) -> str:
    """One of ``words`` at the start of a word. A capital is taken before anything else is looked
    at, so most positions of a text fail after one character."""
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[0], []).append(w[1:])
    ends = "|".join(f"(?<={first})(?:{'|'.join(more)})" for first, more in rest.items())
    return f"[A-ZΑ-ΩА-Я](?<!\\p{{L}}.)(?:{ends})"


_PROPER = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
CARD = r"(?<![\d-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (r"(?<![\d+])\+(?:1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"
         r"|\d{1,3}[ .-]?\(?\d{1,4}\)?(?:(?:[ .-]?\d{2,4}){2,5}|[ .-]?\d{5,10}))(?!\d)"
         r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])")
NAME = (rf"(?:{_words(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)}\.? {_PROPER}(?: {_PROPER})?"
        rf"|{_words(MALE_NAMES + FEMALE_NAMES)} {_PROPER})(?!\p{{L}})")
KINDS = ("email", "ip", "card", "ssn", "phone", "name")
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, SSN, PHONE, NAME)))
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
HINT = rf"[@\d]|{_words(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES + MALE_NAMES + FEMALE_NAMES)}(?!\p{{L}})"
WIDER = 8       # attempts before a full format is left


def kind_of(mention: Column) -> Column:
    """The kind of a text that ``ANY`` matched."""
    out = F.lit("name")
    for k in reversed(KINDS[:-1]):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(out)
    return out


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^({_TITLES})\.? ", 1)


def _parts(mention: Column) -> Column:
    """Name parts after the title."""
    return F.split(F.regexp_replace(mention, rf"^(?:{_TITLES})\.? ", ""), " ")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def listed_gender(norm: Column) -> Column:
    """Gender of a name part by the lists."""
    return (F.when(norm.isin([n.lower() for n in MALE_NAMES]), "m")
            .when(norm.isin([n.lower() for n in FEMALE_NAMES]), "f").otherwise("n"))


def entities(mention: Column) -> Column:
    """The entities of a mention, one, or one for each part of a name: (kind, normal form, gender told by a title)."""
    kind = kind_of(mention)
    one = lambda k, norm, told=F.lit(""): F.struct(k.alias("kind"), norm.alias("norm"), told.alias("told"))
    parts, title = _parts(mention), _title(mention)
    told = F.when(title.isin(MALE_TITLES), "m").when(title.isin(FEMALE_TITLES), "f").otherwise("")
    named = F.transform(parts, lambda p, i: one(F.concat(F.lit("name-"), _script(p)), F.lower(p), F.when(
        (F.size(parts) > 1) & (i == 0), told).otherwise("")))
    number = F.regexp_replace(mention, r"\D", "")
    code = F.when(mention.startswith("+"), F.regexp_extract(number, COUNTRY, 0)).otherwise("1")
    rest = F.when(mention.startswith("+"), F.substring(number, F.length(code) + 1, F.length(number))).otherwise(number)
    return (F.when(kind == "name", named).when(kind.isin("email", "ip"), F.array(one(kind, F.lower(mention))))
            .when(kind == "phone", F.array(one(kind, F.concat_ws(" ", code, rest)))).otherwise(F.array(one(kind, number))))


# -- surrogates -----------------------------------------------------------------------------------

def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """Keyed numbers 0..65535, 32 of them for every 32 characters of the normal form."""
    seed = F.concat_ws("\n", F.lit(key), kind, norm, attempt.cast("string"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(norm) / 32).cast("int") + 1),
                         lambda b: F.sha2(F.concat_ws("\n", seed, b.cast("string")), 512))
    drawn = F.regexp_extract_all(F.array_join(blocks, ""), F.lit("[0-9a-f]{4}"), F.lit(0))
    return F.transform(drawn, lambda h: F.conv(h, 16, 10).cast("int"))


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _draw(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _characters(norm: Column, stream: Column, keep) -> Column:
    """Letters and digits redrawn; ``keep`` says from (character, place) what stays."""
    return F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(keep(c, i), c).when(
        c.rlike("[a-z]"), _draw(_LOWER, F.get(stream, i))).when(c.rlike("[0-9]"), _draw(_DIGITS, F.get(stream, i))).otherwise(c)), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    back = F.transform(F.reverse(F.split(digits, "")), lambda c: c.cast("int"))
    doubled = F.transform(back, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def surrogate(kind: Column, norm: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity, in normal form."""
    stream = _stream(key, kind, norm, attempt)
    never = lambda c, i: F.lit(False)
    domain = F.length(norm) - F.length(F.substring_index(norm, ".", -1))
    wider = F.floor(attempt / WIDER).cast("int")
    extra = lambda alphabet: F.array_join(F.transform(
        F.slice(stream, F.length(norm) + 1, F.least(F.lit(32), wider)), lambda n: _draw(alphabet, n)), "")
    email = _characters(norm, stream, lambda c, i: i >= domain)
    email = F.when(wider > 0, F.concat(extra(_LOWER), email)).otherwise(email)
    octet = lambda o, n: (F.when(wider > 0, n % 255 + 1).when(F.length(o) == 1, n % 9 + 1).when(F.length(o) == 2, n % 90 + 10)
                          .otherwise(n % 156 + 100).cast("string"))
    ip = F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: octet(o, F.get(stream, i))), ".")
    card = _characters(norm, stream, lambda c, i: i == 0)
    stem = F.concat(F.substring(card, F.lit(1), F.length(card) - 1), extra(_DIGITS))
    checked = F.concat(stem, ((10 - _luhn(F.concat(stem, F.lit("0")))) % 10).cast("string"))
    card = F.when(_luhn(norm) == 0, checked).otherwise(F.concat(card, extra(_DIGITS)))
    phone = F.concat(_characters(norm, stream, lambda c, i: i < F.instr(norm, " ")), extra(_DIGITS))
    script = F.substring_index(kind, "-", -1)
    name = F.lit("")
    for s, syllables in SYLLABLES.items():
        bank = F.array(*map(F.lit, syllables))
        # one syllable more after each few attempts, so that there is always room
        count = F.least(F.lit(12), F.lit(2) + F.get(stream, F.lit(0)) % 2 + F.floor(attempt / 4).cast("int"))
        body = F.array_join(F.transform(F.slice(stream, F.lit(2), count), lambda n: F.get(bank, n % len(syllables))), "")
        m, f, n = ENDINGS[s]
        end = F.when(gender == "m", m).when(gender == "f", f).otherwise(n)
        name = F.when(script == s, F.concat(body, end)).otherwise(name)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
            .when(kind == "ssn", F.concat(_characters(norm, stream, never), extra(_DIGITS))).otherwise(name))


def attempts(entity: DataFrame, key: str) -> DataFrame:
    """``(kind, norm, gender, attempt)`` of all distinct entities, with surrogates that meet no other nor a real entity.

    ``entity`` has ``kind`` and ``norm``, and ``gender`` where it is not that of the lists.
    """
    if "gender" not in entity.columns:
        entity = entity.select("kind", "norm", listed_gender(F.col("norm")).alias("gender")).distinct()
    # drawing is the work, so its rows are dealt out by number: adaptive execution would merge the few bytes into one task
    tasks = max(1, int(entity.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = lambda attempt: surrogate(F.col("kind"), F.col("norm"), F.col("gender"), attempt, key)
    state = pinned(entity.select("kind", "norm", "gender").repartition(tasks, "kind", "norm").select(
        "*", F.lit(0).alias("attempt"), F.lit(False).alias("settled"), drawn(F.lit(0)).alias("cand")))
    real = state.select("kind", F.col("norm").alias("cand"), F.lit(True).alias("real"))
    while True:
        owner = state.groupBy("kind", "cand").agg(F.min(F.struct((~F.col("settled")).alias("late"), "norm"))["norm"].alias("owner"))
        judged = state.join(owner, ["kind", "cand"]).join(real, ["kind", "cand"], "left")
        fine = F.col("settled") | (F.col("real").isNull() & (F.col("owner") == F.col("norm")))
        judged = judged.select("kind", "norm", "gender", F.when(fine, F.col("attempt")).otherwise(F.col("attempt") + 1).alias("attempt"),
                               fine.alias("settled"), "cand").repartition(tasks, "kind", "norm")
        state = pinned(judged.withColumn("cand", F.when(F.col("settled"), F.col("cand")).otherwise(drawn(F.col("attempt")))))
        if not state.where(~F.col("settled")).limit(1).count():
            return state.select("kind", "norm", "gender", "attempt")


def _written(mention: Column, new: Column) -> Column:
    """A surrogate in normal form, written like the mention: its spacing, punctuation and case."""
    kind = kind_of(mention)
    number = F.get(new, F.lit(0))
    number = F.when(kind != "phone", number).when(mention.startswith("+"), F.replace(number, F.lit(" "), F.lit(""))).otherwise(
        F.substring_index(number, " ", -1))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    digits = F.aggregate(F.split(mention, ""), start, lambda acc, c: F.when(
        c.rlike("[0-9]"), F.struct((acc["at"] + 1).alias("at"), F.concat(acc["out"], F.substring(number, acc["at"] + 1, F.lit(1))).alias("out")))
        .otherwise(F.struct(acc["at"].alias("at"), F.concat(acc["out"], c).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(number, acc["at"] + 1, F.length(number))))
    address, front = F.get(new, F.lit(0)), F.length(F.get(new, F.lit(0))) - F.length(mention)     # letters that came in front
    cased = F.array_join(F.zip_with(F.split(mention, ""), F.split(F.substring(address, front + 1, F.length(mention)), ""),
                                    lambda old, c: F.when(old.rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    cased = F.concat(F.substring(address, F.lit(1), front), cased)
    title = F.regexp_extract(mention, rf"^(?:{_TITLES})\.? ", 0)
    name = F.concat(title, F.array_join(F.transform(new, lambda p: F.initcap(p)), " "))
    return F.when(kind == "name", name).when(kind == "email", cased).when(kind == "ip", F.get(new, F.lit(0))).otherwise(digits)


def replace_pii(docs: DataFrame, key: str = "surrogate key", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and ``n_<kind>``, the mentions of each kind."""
    docs, back = sheltered(docs.drop(*[f"n_{k}" for k in KINDS]), "_pi_", id_col, text_col)
    kept = docs.columns
    text = text_of(text_col)
    none = F.array().cast("array<string>")
    full = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)
    docs = docs.select(*kept, full.alias("_pi_full"))
    named = F.filter("_pi_full", lambda m: ~m.rlike(r"[@\d]"))
    bare = F.filter(F.array_distinct(F.flatten(F.transform(named, _parts))), lambda p: F.length(p) > 1)
    docs = docs.select(*kept, "_pi_full", F.array_join(bare, "|").alias("_pi_bare"))
    pattern = F.when(F.col("_pi_bare") == "", ANY).otherwise(
        F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.col("_pi_bare"), F.lit(r")(?!\p{L}|-\p{L})")))
    found = F.when(F.col("_pi_bare") == "", F.col("_pi_full")).otherwise(F.regexp_extract_all(text, pattern, F.lit(0)))
    docs = docs.select(*kept, "_pi_bare", found.alias("_pi_found"), F.xxhash64(F.col(id_col), text).alias("_pi_row"))

    listed = docs.where(F.size("_pi_found") > 0).select(
        F.col(id_col).alias("_pi_id"), "_pi_row", F.explode(F.flatten(F.transform(F.col("_pi_found"), entities))).alias("e"))
    listed = pinned(listed.groupBy("_pi_id", "_pi_row", "e.kind", "e.norm").agg(
        F.max((F.col("e.told") == "m").cast("int")).alias("m"), F.max((F.col("e.told") == "f").cast("int")).alias("f")))
    gender = F.when(F.sum("m") > F.sum("f"), "m").when(F.sum("m") < F.sum("f"), "f").otherwise(listed_gender(F.col("norm")))
    entity = listed.groupBy("kind", "norm").agg(gender.alias("gender"))
    later = pinned(attempts(entity, key).where((F.col("attempt") > 0) | (F.col("gender") != listed_gender(F.col("norm")))))
    if later.limit(1).count():
        again = (listed.join(later, ["kind", "norm"]).groupBy("_pi_id", "_pi_row")
                 .agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "norm"), F.struct("gender", "attempt")))).alias("_pi_again")))
        named = docs.withColumn("_pi_id", F.col(id_col)).join(
            pinned(again).withColumnRenamed("_pi_id", "_pi_id2").withColumnRenamed("_pi_row", "_pi_row2"),
            F.col("_pi_id").eqNullSafe(F.col("_pi_id2")) & (F.col("_pi_row") == F.col("_pi_row2")), "left")
        known = lambda e: F.element_at("_pi_again", F.struct(e["kind"].alias("kind"), e["norm"].alias("norm")))
    else:
        named, known = docs, lambda e: F.lit(None).cast("struct<gender:string,attempt:int>")

    new = lambda m: F.transform(entities(m), lambda e: surrogate(
        e["kind"], e["norm"], F.coalesce(known(e)["gender"], listed_gender(e["norm"])), F.coalesce(known(e)["attempt"], F.lit(0)), key))
    gaps = F.when(F.col("_pi_bare") == "", F.split(F.col(text_col), ANY, -1)).otherwise(F.split(F.col(text_col), pattern, -1))
    pieces = F.zip_with(gaps, F.col("_pi_found"), lambda gap, m: F.concat(gap, F.when(m.isNull(), "").otherwise(_written(m, new(m)))))
    replaced = F.when(F.size("_pi_found") > 0, F.array_join(pieces, "")).otherwise(F.col(text_col))
    kinds = F.transform("_pi_found", lambda m: kind_of(m))
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return named.select(*[replaced.alias(c) if c == text_col else F.col(c).alias(back.get(c, c)) for c in kept], *counts)
