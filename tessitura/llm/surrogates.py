"""Surrogates for personal data, in built-in expressions only.

Entities are found with one pattern: e-mail addresses, IPv4 and IPv6 addresses,
phone numbers, card numbers, social security numbers, IBANs, hexadecimal
secrets and persons: names (initials, particles and hyphens included) after
forms of address and titles, and every later or earlier mention of these names
in the same document. A document's own names are joined to the pattern, so
bare, upper-case, full and short forms are all found.

Each entity gets a replacement of its own type, drawn from a keyed SHA-256 of
the type and the canonical entity, so the same entity gets the same surrogate
everywhere, however it is written: digits stay digits, letters keep their case,
separators stay, country codes, top-level domains, issuer digits and valid
check digits are kept. A name is replaced word by word, so a surname alone and
the full name agree; words keep gender (told by the form of address; told by
nothing after a title), script (Latin, Greek, Cyrillic), case and hyphens.
Initials are turned within their alphabet, particles stay. Names of scripts
without capital letters are not found.

Distinctness is checked over the whole table: the distinct entities are
listed, and where two get one surrogate, or a surrogate is an entity that
occurs, all but the smallest draw again until none is left. After every
``_WIDEN`` draws of an entity its surrogates get longer, so a small space (a
one-letter address) does not run full; after ``_MOST_DRAWS`` an error is raised.
Entities that drew again are rare; texts that hold one get its draw by a join on
the text's hash. The draws of all others need no join, so the rewriting is a
projection.

The counts of a hot entity are combined before they are shuffled. Null texts
stay null; texts without entities stay as they are; repeated rows get equal
results; very long texts are rewritten whole; an empty table stays empty; other
columns pass through.

The key is a secret: whoever has it can tell which surrogate an entity gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Forms of address by gender, titles, and particles of names.
MALE_FORMS = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Senhor", "г-н", "господин", "κύριος", "κύριε")
FEMALE_FORMS = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Srta", "Sra", "Signora", "Senhora", "г-жа", "госпожа", "κυρία", "κα")
TITLES = ("Dr", "Prof", "Doctor", "Professor", "Doktor", "Docteur", "Dra", "Rev", "д-р", "Δρ")
PARTICLES = ("von", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "al", "el", "bin", "ibn", "zu", "zur", "ter", "ten")


def _any(words) -> str:
    return "(?:" + "|".join(sorted({f for w in words for f in (w, w.upper())}, key=lambda x: (-len(x), x))) + ")"


_FORM = rf"{_any((*MALE_FORMS, *FEMALE_FORMS, *TITLES))}\.?"
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
_WORD = r"\p{Lu}[\p{L}'’]+"
_NAME = rf"(?:{_PARTICLE} )*(?:{_WORD}(?:-{_WORD})*|\p{{Lu}}\.(?=[ \p{{Lu}}]))"

#: In order of precedence; each is found whole.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z][A-Za-z0-9-]*",
    "ipv6": r"(?<![\p{L}\p{N}_:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}_:])",
    "ipv4": rf"(?<![\p{{L}}\p{{N}}_.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}_])(?!\.\d)",
    "ssn": rf"{_B}\d{{3}}-\d{{2}}-\d{{4}}{_E}",
    "iban": rf"{_B}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_E}",
    "secret": rf"{_B}(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{{32,}}{_E}",
    "phone": rf"(?<![\p{{L}}\p{{N}}_+])\+\d{{1,3}}[ .-]?\(\d{{1,4}}\)[ .-]?\d{{2,4}}[ .-]?\d{{3,6}}{_E}"
    rf"|(?<![\p{{L}}\p{{N}}_+])\+\d{{1,3}}(?:[ .-]\d{{2,4}}){{2,4}}{_E}(?!\.\d)|(?<![\p{{L}}\p{{N}}_+])\+\d{{8,15}}{_E}"
    rf"|(?<![\p{{L}}\p{{N}}_])\(\d{{3}}\) ?\d{{3}}-\d{{4}}{_E}|(?<![\p{{L}}\p{{N}}_.-])(?:1[-. ])?\d{{3}}[.-]\d{{3}}[.-]\d{{4}}{_E}|(?<![\p{{L}}\p{{N}}_.-])(?<!\d )(?:1 )?\d{{3}} \d{{3}} \d{{4}}{_E}(?! \d)"
    rf"|(?<![\p{{L}}\p{{N}}_.,-])(?<!\d )0\d{{2,4}}[ /-]\d{{6,8}}{_E}(?! \d)",
    "card": rf"{_B}\d{{4}}([ -])\d{{4}}\1\d{{4}}\1\d{{1,7}}{_E}|{_B}(?:\d{{4}} \d{{6}} \d{{5}}|\d{{4}}-\d{{6}}-\d{{5}}){_E}|{_B}\d{{13,19}}{_E}",
    "person": rf"{_B}{_FORM}(?: {_FORM})* {_NAME}(?: {_NAME}){{0,3}}",
}
_PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What stands in a found person: words of names, initials, and what lies between.
_PIECES = r"[\p{L}'’]+\.?|[^\p{L}'’]+"
#: The kinds that draw, "keep" apart.
NAMES = ("given_m", "given_f", "given_n", "family")


def _may_hold(text: Column) -> Column:
    """False only for texts without entities; far cheaper than the patterns."""
    return text.contains("@") | text.rlike(r"\d\d|\d\.\d|[0-9A-Fa-f]:[:0-9A-Fa-f]") | text.rlike("[0-9A-Fa-f]{32}") | text.rlike(rf"{_B}{_FORM} (?:{_PARTICLE} )?\p{{Lu}}")


#: Syllables of surrogate names, and the endings of given names by gender.
_SYLLABLES = {"latin": "ba de fi go lu ma ne pi ro su ta ve ko li mo zu".split(), "greek": "βα δε φι γο λου μα νε πι ρο σου τα βε κο λι μο ζου".split(), "cyrillic": "ба де фи го лу ма не пи ро су та ве ко ли мо зу".split()}
_ENDINGS = {"latin": ("n", "a", "l"), "greek": ("ς", "α", "ι"), "cyrillic": ("н", "а", "й")}
_SCRIPTS = {"greek": r"\p{IsGreek}", "cyrillic": r"\p{IsCyrillic}"}
#: The capital letters in which initials are turned.
_ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ")
_WIDEN, _MOST_DRAWS = 8, 200
_LET_DIGIT, _STREAM = r"[^0-9]", 128


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _choose(words, number: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), (number % len(words)).cast("int"))


def kind_of(entity: Column) -> Column:
    """The type of a found entity, by the first pattern that matches it whole."""
    found = F.when(entity.rlike(f"^(?:{PATTERNS['email']})$"), F.lit("email"))
    for name in ("ipv6", "ipv4", "ssn", "iban", "secret", "phone", "card"):
        found = found.when(entity.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name))
    return found.otherwise(F.lit("person"))


def canonical(kind: Column, entity: Column) -> Column:
    """One spelling for all ways to write an entity."""
    digits = F.regexp_replace(entity, _LET_DIGIT, "")
    return (
        F.when(kind == "phone", F.concat(F.when(entity.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind.isin("email", "secret", "ipv6", *NAMES), F.lower(entity))
        .otherwise(entity)
    )


def _gender(person: Column) -> Column:
    """m, f or n, by the first form of address that tells it."""
    told = lambda forms: person.rlike(rf"^(?:{_FORM} )*?{_any(forms)}\.? ")
    return F.when(told(MALE_FORMS), F.lit("m")).when(told(FEMALE_FORMS), F.lit("f")).otherwise(F.lit("n"))


def _words(person: Column) -> Column:
    """The words of a name, as written: no forms of address, initials or particles."""
    bare = F.regexp_replace(person, rf"^(?:{_FORM} )+", "")
    return F.filter(F.regexp_extract_all(bare, F.lit(r"[\p{L}'’]+(?!\.)"), F.lit(0)), lambda w: (F.char_length(w) > 1) & w.rlike(r"^\p{Lu}"))


def _known(text: Column) -> Column:
    """The names that stand after a form of address: words as written, and the given ones among them by gender in lower case."""
    persons = F.regexp_extract_all(text, F.lit(PATTERNS["person"].replace(r"\1", "")), F.lit(0))

    def of(names: Column) -> Column:
        given = lambda g: F.array_distinct(F.flatten(F.transform(F.filter(names, lambda n: n["gender"] == g), lambda n: F.transform(F.slice(n["words"], 1, F.greatest(F.size(n["words"]) - 1, F.lit(0))), lambda w: F.lower(w)))))
        return F.struct(F.array_distinct(F.flatten(F.transform(names, lambda n: n["words"]))).alias("words"), *[given(g).alias(g) for g in "mfn"])

    return _bind(F.transform(persons, lambda p: F.struct(_gender(p).alias("gender"), _words(p).alias("words"))), of)


def _pattern_of(known: Column) -> Column:
    """The pattern of a document: the common one, and the names that it knows."""
    forms = F.array_distinct(F.flatten(F.transform(F.filter(known["words"], lambda w: F.char_length(w) > 2), lambda w: F.array(w, F.upper(w), F.initcap(w)))))
    word = F.concat(F.lit("(?:"), F.array_join(F.array_sort(forms, lambda a, b: F.char_length(b) - F.char_length(a)), "|"), F.lit(")"))
    bare = F.concat(F.lit(f"|{_B}"), word, F.lit("(?:[ -]"), word, F.lit(f")*{_E}"))
    return F.when(F.size(forms) == 0, F.lit(_PATTERN)).otherwise(F.concat(F.lit(_PATTERN), bare))


def _parts_of(person: Column, known: Column) -> Column:
    """A person as structs (kind, canon, text); what is "keep" stays or is an initial."""

    def one(piece: Column) -> Column:
        low = F.lower(piece)
        name = (F.char_length(piece) > 1) & piece.rlike(rf"^{_WORD}$") & ~piece.rlike(rf"^{_FORM}$")
        kind = F.when(~name, F.lit("keep")).when(F.array_contains(known["m"], low), F.lit("given_m")).when(F.array_contains(known["f"], low), F.lit("given_f")).when(F.array_contains(known["n"], low), F.lit("given_n")).otherwise(F.lit("family"))
        return F.struct(kind.alias("kind"), low.alias("canon"), piece.alias("text"))

    # "Smith." at the end of a sentence is a word and a full stop.
    pieces = F.flatten(F.transform(F.regexp_extract_all(person, F.lit(_PIECES), F.lit(0)), lambda x: F.when(x.rlike(rf"^{_WORD}\.$") & ~x.rlike(rf"^{_FORM}$"), F.array(F.substr(x, F.lit(1), F.char_length(x) - 1), F.lit("."))).otherwise(F.array(x))))
    return F.transform(pieces, one)


def _stream(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    base = F.concat_ws("|", F.lit(key), kind, draw.cast("string"), canon)
    return F.concat(F.sha2(base, 256), F.sha2(F.concat(F.lit("2|"), base), 256))


def _number(stream: Column, i: Column) -> Column:
    """0 to 65,535 for place i of a stream."""
    return F.conv(F.substr(stream, (i * 2) % (_STREAM - 4) + 1, F.lit(4)), 16, 10).cast("int")


def _scrambled(canon: Column, stream: Column, keep: Column) -> Column:
    """``canon`` with each letter and digit after the first ``keep`` characters drawn anew."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        return (
            F.when(i < keep, c)
            .when(c.between("0", "9"), (n % 10).cast("string"))
            .when(c.between("a", "z"), F.char(n % 26 + 97))
            .when(c.between("A", "Z"), F.char(n % 26 + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def _check_sum(digits: Column) -> Column:
    """The check sum of card numbers; valid if it ends in zero."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weight), F.lit(0), lambda a, x: a + x)


def draw(key: str, kind: Column, canon: Column, turn: Column) -> Column:
    """The canonical surrogate of a canonical entity; ``turn`` counts draws."""

    def of(s: Column) -> Column:
        def card(kept: Column) -> Column:
            body = F.substr(kept, F.lit(1), F.length(kept) - 1)
            right = (10 - _check_sum(F.concat(body, F.lit("0"))) % 10) % 10
            last = F.when(_check_sum(canon) % 10 == 0, right).when(F.substr(kept, F.length(kept), F.lit(1)).cast("int") == right, (right + 1) % 10).otherwise(F.substr(kept, F.length(kept), F.lit(1)).cast("int"))
            return F.concat(body, last.cast("string"))

        more = F.least(F.floor(turn / _WIDEN), F.lit(_STREAM // 4 - 10)).cast("int")  # characters by which it is longer
        letters = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: F.char(_number(s, i + 60) % 26 + 97)), "")
        digits = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: (_number(s, i + 60) % 10).cast("string")), "")
        longer = lambda value, tail: F.when(more > 0, F.concat(value, tail)).otherwise(value)
        octets = F.concat_ws(".", *[(_number(s, F.lit(2 * k)) % 254 + 1).cast("string") for k in range(4)])
        top = F.length(F.regexp_extract(canon, r"\.([^.]*)$", 1))
        address = F.concat(_scrambled(F.substr(canon, F.lit(1), F.length(canon) - top), s, F.lit(0)), F.substr(canon, F.length(canon) - top + 1, top))
        country = F.when(~canon.startswith("+"), F.lit(0)).when(canon.rlike(r"^\+[17]"), F.lit(2)).otherwise(F.lit(3))
        hexed = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.substr(s, i % _STREAM + 1, F.lit(1))), "")

        def name(script: str) -> Column:
            syllables = F.transform(F.sequence(F.lit(0), more + F.when(kind == "family", 4).otherwise(3)), lambda i: _choose(_SYLLABLES[script], _number(s, i * 2)))
            ending = F.when(kind == "given_m", _ENDINGS[script][0]).when(kind == "given_f", _ENDINGS[script][1]).when(kind == "given_n", _ENDINGS[script][2]).otherwise("")
            return F.concat(F.array_join(syllables, ""), ending)

        of_names = F.lit(None).cast("string")
        for script, letter in _SCRIPTS.items():
            of_names = F.when(canon.rlike(letter), name(script)) if script == "greek" else of_names.when(canon.rlike(letter), name(script))
        hexes = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substr(s, i % _STREAM + 1, F.lit(1)))), "")
        return (
            F.when(kind == "email", F.concat(F.when(more > 0, letters).otherwise(""), address))
            .when(kind == "ipv4", octets)
            .when(kind == "ipv6", hexes)
            .when(kind == "phone", longer(_scrambled(canon, s, country), digits))
            .when(kind == "card", longer(_bind(_scrambled(canon, s, F.lit(1)), card), digits))
            .when(kind == "iban", longer(_scrambled(canon, s, F.lit(2)), digits))
            .when(kind == "secret", longer(hexed, digits))
            .when(kind.isin(*NAMES), of_names.otherwise(name("latin")))
            .otherwise(longer(_scrambled(canon, s, F.lit(0)), digits))
        )

    return _bind(_stream(key, kind, canon, turn), of)


def render(kind: Column, entity: Column, surrogate: Column) -> Column:
    """A canonical surrogate in the spelling of ``entity``."""

    def spelled(target: Column, member) -> Column:
        """Characters of the entity that ``member`` accepts, replaced by the surrogate's in order; what is left of it follows."""
        chars = F.split(entity, "")
        number = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), member, ""))
        own = F.array_join(F.transform(chars, lambda c, i: F.when(~F.regexp_replace(c, member, "").eqNullSafe(""), F.substr(target, number(i), F.lit(1))).otherwise(c)), "")
        return F.concat(own, F.substr(target, F.length(F.regexp_replace(entity, member, "")) + 1, F.length(target)))

    upper = (entity == F.upper(entity)) & (F.char_length(entity) > 1)
    hexed = F.when(entity == F.upper(entity), F.upper(surrogate)).otherwise(surrogate)
    extra = F.length(surrogate) - F.length(entity)
    at = lambda i: F.substr(surrogate, i + 1 + extra, F.lit(1))
    cased = F.concat(F.substr(surrogate, F.lit(1), extra), F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.between("A", "Z"), F.upper(at(i))).otherwise(at(i))), ""))
    return (
        F.when(kind.isin("phone", "card", "ssn"), spelled(F.regexp_replace(surrogate, _LET_DIGIT, ""), _LET_DIGIT))
        .when(kind == "iban", spelled(surrogate, " "))
        .when(kind.isin(*NAMES), F.when(upper, F.upper(surrogate)).otherwise(F.initcap(surrogate)))
        .when(kind == "email", cased)
        .when(kind.isin("secret", "ipv6"), hexed)
        .otherwise(surrogate)
    )


def _turned(key: str, text: Column) -> Column:
    """``text`` with each capital letter turned in its alphabet, by the key."""
    import hashlib

    by = int.from_bytes(hashlib.sha256(f"{key}|initials".encode()).digest()[:4], "big")
    turned = "".join(a[1 + by % (len(a) - 1) :] + a[: 1 + by % (len(a) - 1)] for a in _ALPHABETS)
    return F.translate(text, "".join(_ALPHABETS), turned)


_ENTITY = "struct<kind:string,parts:array<struct<kind:string,canon:string,text:string>>>"


def _entities(text: Column) -> Column:
    """A struct of between (the texts around the entities) and entities (``_ENTITY``), in order."""

    def typed(entity: Column, known: Column) -> Column:
        single = lambda k: F.array(F.struct(k.alias("kind"), canonical(k, entity).alias("canon"), entity.alias("text")))
        return _bind(kind_of(entity), lambda k: F.struct(k.alias("kind"), F.when(k == "person", _parts_of(entity, known)).otherwise(single(k)).alias("parts")))

    def of(known: Column) -> Column:
        return _bind(_pattern_of(known), lambda p: F.struct(F.split(text, p).alias("between"), F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda e: typed(e, known)).alias("entities")))

    return _bind(_known(text), of)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon), distinct, with ``turn`` and ``surrogate``: one surrogate for each, none of them an entity."""
    kind, canon = F.col("kind"), F.col("canon")
    now = cut(entities.withColumn("turn", F.lit(0)).withColumn("surrogate", draw(key, kind, canon, F.lit(0))))
    for _ in range(_MOST_DRAWS):
        least = now.groupBy("kind", "surrogate").agg(F.min(F.struct("turn", "canon")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", F.col("owner.canon").alias("owner"))
        real = now.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        marked = now.join(least, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
        again = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("owner") != canon, F.lit(False))
        marked = cut(marked.select("kind", "canon", "turn", "surrogate", again.alias("again")))
        if marked.where("again").isEmpty():
            return now
        turn = F.col("turn") + 1
        now = cut(marked.select("kind", "canon", F.when(F.col("again"), turn).otherwise(F.col("turn")).alias("turn"), F.when(F.col("again"), draw(key, kind, canon, turn)).otherwise(F.col("surrogate")).alias("surrogate")))
    raise ValueError("there are more entities of a kind than surrogates")


def replace(docs: DataFrame, key: str, text: str = "text", into: str = "entities") -> DataFrame:
    """``docs`` with surrogates in the text, and ``into``: an array of the types found, in order."""
    if into in docs.columns:
        raise ValueError(f"the table already has a column {into!r}; name another")
    taken = [*docs.columns, into]
    own = F.col(f"`{text}`")
    n_map, n_h1, n_h2, n_found = (free_name(taken, x) for x in ("draws", "h1", "h2", "found"))
    drawn = docs.where(_may_hold(own)).select(F.xxhash64(own).alias("h1"), F.xxhash64(F.lit(1), own).alias("h2"), F.explode(_entities(own)["entities"]).alias("e"))
    found = cut(drawn.select("h1", "h2", F.explode("e.parts").alias("p")).where("p.kind <> 'keep'").select("h1", "h2", "p.kind", "p.canon").distinct())
    later = assigned(found.select("kind", "canon").distinct(), key).where("turn > 0")
    if later.isEmpty():
        mapped = docs.withColumn(n_map, F.lit(None).cast("map<string,int>"))
    else:
        turns = found.join(later, ["kind", "canon"]).groupBy("h1", "h2").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "canon"), "turn"))).alias(n_map)).withColumnsRenamed({"h1": n_h1, "h2": n_h2})
        mapped = docs.join(turns, (F.xxhash64(own) == F.col(n_h1)) & (F.xxhash64(F.lit(1), own) == F.col(n_h2)), "left").drop(n_h1, n_h2)

    def surrogate(e: Column) -> Column:
        def one(p: Column) -> Column:
            turn = F.coalesce(F.element_at(F.col(n_map), F.concat_ws(":", p["kind"], p["canon"])), F.lit(0))
            new = _bind(draw(key, p["kind"], p["canon"], turn), lambda s: render(p["kind"], p["text"], s))
            initial = p["text"].rlike(r"^\p{Lu}\.$")
            return F.when(p["kind"] != "keep", new).when(initial, _turned(key, p["text"])).otherwise(p["text"])

        return F.array_join(F.transform(e["parts"], one), "")

    whole = F.col(n_found)
    swapped = F.array_join(F.zip_with(whole["between"], F.transform(whole["entities"], surrogate), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    none = F.struct(F.array(own).alias("between"), F.array().cast(f"array<{_ENTITY}>").alias("entities"))
    return (
        mapped.withColumn(n_found, F.when(_may_hold(own), _entities(own)).otherwise(none))
        .withColumn(into, F.transform(whole["entities"], lambda e: e["kind"]))
        .withColumn(text, F.when(F.size(whole["entities"]) == 0, own).otherwise(swapped))
        .select(*[F.col(f"`{c}`") for c in docs.columns], into)
    )


def op1_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kinds = F.col("entities")
    key = spark.conf.get("spark.tessitura.surrogates.key", "for tests only")
    return replace(docs, key).select("doc_id", F.size(kinds).cast("long").alias("n_entities"), *[(F.size(kinds) - F.size(F.array_remove(kinds, x))).cast("long").alias(f"n_{x}") for x in PATTERNS], "text")
