"""Surrogates for personal data: keyed replacements of the same type, script and format.

Detected entities are replaced by made-up ones. A surrogate is drawn from a keyed hash of the entity, so
the same key gives the same surrogates in every run and table, and an entity has one surrogate wherever
and however it is written (coreference). Draws are checked: no two entities share a surrogate, and no
surrogate is an entity of the corpus; what collides is drawn again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.llm.tables import written

# Patterns of entities. None begins within a word, and all have bounded parts, so that a
# long run of letters costs no more than its length.
_WORD = r"\p{Lu}[\p{L}'’-]{1,40}"
_INITIAL = r"\p{Lu}\."
PARTICLES = "van|von|vom|zu|zur|der|den|ter|de|del|della|di|da|dos|du|la|le|al|bin|y"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.%+@-])[\p{L}\p{N}_.%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?<![\w])[0-9A-Fa-f]{32,128}(?![\w])",
    # Joined after a plus; groups after a country code, eight digits at least; groups as in (555) 123-4567;
    # groups and joined digits after a leading 0; ten joined digits, but no times since 1970.
    "phone": r"(?<![\w+.-])(?:\+\d{8,15}"
    r"|(?:\+|00)(?=(?:[ ()./-]{0,2}\d){8})\d{1,3}[ ./-]?(?:\(\d{1,4}\)[ ./-]?)?\d{1,12}(?:[ ./-]\d{2,8}){0,5}"
    r"|(?:1[ .-])?(?:(?:\(\d{2,4}\)[ ./-]?|\d{3}[./-])\d{3,4}[ ./-]?\d{4}|\d{3}[ ]\d{3,4}[ ./-]\d{4})"
    r"|0\d{1,4}[/ -]\d{6,8}|0\d{1,4}[ ./-]\d{3,4}[ ./-]\d{3,5}|0\d(?:[ .-]\d{2}){4}"
    r"|[2-9]\d{9}|0\d{9,10})(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w.-])(?:\d{4}[ -]){3}\d{4}(?![\w-])|(?<![\w.-])\d{13,19}(?![\w-])",
    "name": r"(?<=\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra?|г-н|г-жа)\.?[ ])"
    rf"(?:(?:{_WORD}|{_INITIAL})[ ]){{0,3}}(?:(?:{PARTICLES})[ ]){{0,2}}{_WORD}",
}
FEMALE_TITLES = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа)\.?[ ]$"

# Common names to choose from, by script and kind.
NAMES = {
    ("latin", "male"): "Adam Boris Carl David Emil Felix Georg Henri Ivan Jonas Karl Leon Marc Nico Oscar Paul Ralf Simon Tom Victor",
    ("latin", "female"): "Alice Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sofia Tina Vera",
    ("latin", "surname"): "Abel Berger Clarke Dumont Engel Fischer Garcia Hansen Iversen Jansen Keller Lambert Moreau Novak Ortega Peters Romero Schmidt Torres Wagner",
    ("cyrillic", "male"): "Андрей Борис Виктор Глеб Денис Егор Захар Иван Кирилл Леонид Максим Никита Олег Павел Роман Сергей",
    ("cyrillic", "female"): "Алина Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья",
    ("cyrillic", "surname"): "Абрамов Белов Волков Громов Давыдов Ежов Жуков Зимин Ильин Козлов Лебедев Морозов Носов Орлов Павлов Рыбаков",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# A text without any of this has no entity; the cheap test for most texts.
HINT = r"[@0-9]|\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|г-н|г-жа)\b|[A-Fa-f]{32}"
# A text cut between words, with their apostrophes and hyphens, and what is none; a possessive ending.
WORD_EDGE = r"(?<![\p{L}'’-])(?=\p{L})|(?<=[\p{L}'’-])(?![\p{L}'’-])"
POSSESSIVE = r"(['’]s?|-+)$"
# Draws after which an entity gets a longer surrogate: its own space is too full.
SAME_LENGTH_DRAWS = 6


def _kind(mention: str) -> Column:
    text = F.col(mention)
    out = F.lit("name")
    for kind in ("card", "ip", "phone", "secret", "email"):
        out = F.when(F.regexp_like(text, F.lit(f"^(?:{_bare(kind)})$")), kind).otherwise(out)
    return out


def _bare(kind: str) -> str:
    """The pattern without the conditions on what stands around it."""
    pattern = PATTERNS[kind]
    for part in (r"(?<![\p{L}\p{N}_.%+@-])", r"(?<![\w])", r"(?![\w])", r"(?<![\w+.-])", r"(?![\w-])", r"(?<![\w.])", r"(?![\w]|\.\d)", r"(?<![\w.-])"):
        pattern = pattern.replace(part, "")
    return pattern


def mentions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, twin, at, mention, kind, entity)`` of every mention, ``at`` its number in the text.

    ``entity`` is what mentions in different writing share: e-mail addresses, secrets and names without
    case, numbers as their digits (of a phone number the last ten, so that it may stand with or without a
    country code, or with a 0 before it). The words of a name are entities of their own, given names with the
    gender of the title before them and a surname with its particles; so a surname alone meets the full name.
    """
    text = F.col(text_column)
    found = docs.where(F.regexp_like(text, F.lit(HINT))).select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("twin"),
        F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("mention"),
        F.split(text, ANY, -1).alias("before"),
    )
    # The text before a mention is only looked at for the title of a name.
    ends = F.transform("before", lambda b: F.substring(b, -12, 12))
    zipped = found.select("doc_id", "twin", "mention", ends.alias("before")).select(
        "doc_id", "twin", F.posexplode(F.arrays_zip("mention", "before")).alias("at", "ws_m")
    )
    named = zipped.where("ws_m.mention IS NOT NULL").select(
        "doc_id", "twin", "at", F.col("ws_m.mention").alias("mention"), F.col("ws_m.before").alias("before")
    )
    kind = named.withColumn("kind", _kind("mention"))
    # The words of a name are entities of their own; everything else is one part.
    parts = F.when(F.col("kind") == "name", F.split("mention", rf"(?<!\b(?:{PARTICLES}))[ ]")).otherwise(F.array("mention"))
    gender = F.when(F.regexp_like("before", F.lit(FEMALE_TITLES)), "female").otherwise("male")
    split = kind.select("doc_id", "twin", "at", "kind", gender.alias("gender"), F.size(parts).alias("of"), F.posexplode(parts).alias("part", "mention"))
    sub = F.when(F.col("kind") != "name", F.col("kind")).when(
        F.col("part") < F.col("of") - 1, F.col("gender")
    ).otherwise("surname")
    national = F.regexp_replace("mention", r"^(?:\+|00)\d{1,3}(?=[ ./(-])", "")
    return split.select(
        "doc_id", "twin", "at", "part", "mention", sub.alias("kind"),
        F.when(F.col("kind") == "phone", F.right(F.regexp_replace(F.regexp_replace(national, "[^0-9]", ""), "^0", ""), F.lit(10)))
        .when(F.col("kind") == "name", F.lower(F.regexp_extract("mention", r"([^ .]+)\.?$", 1)))
        .when(F.col("kind") == "card", F.regexp_replace("mention", "[^0-9]", ""))
        .otherwise(F.lower("mention")).alias("entity"),
    )


def _stream(key: str, kind: Column, entity: Column, draw: Column) -> Column:
    """128 hexadecimal digits drawn for an entity."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, entity, draw.cast("string"))
    return F.sha2(seed, 512)


def _digit(stream: Column, place: Column) -> Column:
    """A number from 0 to 255 for a place of a text."""
    return F.conv(F.substring(stream, F.pmod(place * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")


def _same_shape(text: Column, stream: Column, letters: bool = True) -> Column:
    """The text with other digits and letters, everything else as it is."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def swap(c: Column, i: Column) -> Column:
        drawn = _digit(stream, i)
        out = F.when(F.regexp_like(c, F.lit("[0-9]")), F.pmod(drawn, F.lit(10)).cast("string"))
        if letters:
            letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(drawn, F.lit(26)) + 1, F.lit(1))
            out = out.when(F.regexp_like(c, F.lit(r"\p{L}")), letter)
        return out.otherwise(c)

    return F.array_join(F.transform(chars, swap), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum of the digits; from the right, every second one counts double, beginning at ``doubled``."""
    turned = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(F.pmod(i, F.lit(2)) == doubled, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(turned, value), F.lit(0), lambda a, v: a + v)


def _card(entity: Column, stream: Column) -> Column:
    """Other digits after the first; the check digit is right where it was right."""
    body = F.concat(F.substring(entity, 1, 1), F.expr("substring(ws_shape, 2, length(entity) - 2)"))
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(body, 0), F.lit(10)), F.lit(10))
    wrong = F.pmod(check + 1 + F.pmod(_digit(stream, F.lit(60)), F.lit(9)), F.lit(10))
    valid = F.pmod(_luhn_sum(entity, 1), F.lit(10)) == 0
    return F.concat(body, F.when(valid, check).otherwise(wrong).cast("string"))


def _name(kind: Column, entity: Column, stream: Column, draw: Column) -> Column:
    """A name of the kind and script; more names than the list has are list names with a suffix."""
    script = F.when(F.regexp_like(entity, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")
    out = F.lit("")
    for (s, k), names in NAMES.items():
        words = names.lower().split()
        chosen = F.element_at(F.array(*map(F.lit, words)), F.pmod(_digit(stream, F.lit(0)), F.lit(len(words))) + 1)
        pool = "абвгдежзиклмнопр" if s == "cyrillic" else "abcdefghiklmnopr"
        tail = F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.least(draw + 1, F.lit(20))),
                lambda i, pool=pool: F.substring(F.lit(pool), F.pmod(_digit(stream, i), F.lit(16)) + 1, F.lit(1)),
            ),
            "",
        )
        whole = F.when(draw == 0, chosen).otherwise(F.concat(chosen, tail))
        out = F.when((script == s) & (kind == k), whole).otherwise(out)
    return out


def _draw(entities: DataFrame, key: str, draw: int) -> DataFrame:
    """The surrogates of a draw, in the entity's normal writing."""
    kind, entity = F.col("kind"), F.col("entity")
    stream = F.col("ws_stream")
    extra = F.lit("" if draw < SAME_LENGTH_DRAWS else str(draw - SAME_LENGTH_DRAWS + 1))
    at = F.instr(entity, "@")
    local = F.expr("substring(ws_shape, 1, instr(entity, '@') - 1)")
    tld = F.regexp_extract(entity, r"(\.[^.]*)$", 1)
    # Of addresses beyond the first draws: 120 bits of the unique local range of IPv6.
    groups = [F.substring(stream, F.lit(4 * k + 3), F.lit(4)) for k in range(7)]
    local_v6 = F.concat_ws(":", F.concat(F.lit("fd"), F.substring(stream, F.lit(1), F.lit(2))), *groups)
    octets = [F.pmod(_digit(stream, F.lit(k)), F.lit(254)).cast("string") for k in (3, 4, 5)]
    hexes = F.concat(stream, F.reverse(stream))
    drawn = entities.withColumn("ws_stream", _stream(key, kind, entity, F.lit(draw))).withColumn(
        "ws_shape", _same_shape(entity, stream)
    )
    made = (
        F.when(kind == "email", F.concat(local, extra, F.lit("@example"), tld))
        .when(kind == "ip", local_v6 if draw >= SAME_LENGTH_DRAWS else F.concat_ws(".", F.lit("10"), *octets))
        .when(kind == "secret", F.substring(hexes, F.lit(1), F.length(entity)))
        .when(kind == "card", F.concat(_card(entity, stream), extra))
        .when(kind == "phone", F.concat(F.col("ws_shape"), extra))
        .otherwise(_name(kind, entity, stream, F.lit(draw)))
    )
    return drawn.select("kind", "entity", made.alias("surrogate"), F.lit(draw).alias("draw"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, entity, surrogate)`` for distinct ``(kind, entity)``; one to one, and never an entity.

    Draw after draw: of the entities that draw the same surrogate the smallest has it, unless an earlier
    one or the corpus has it; the others draw again. From the draw SAME_LENGTH_DRAWS on, surrogates grow
    (an IP address becomes a unique local one of IPv6), so an end is certain. The driver sees the number of those left.
    """
    entities = written(entities.select("kind", "entity").distinct(), "entities")
    done, left, draw = [], entities, 0
    while True:
        drawn = written(_draw(left, key, draw), "draws")
        used = reduce(DataFrame.union, [entities.select("kind", F.col("entity").alias("surrogate")), *[d.select("kind", "surrogate") for d in done]])
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        taken = written(first.join(used, ["kind", "surrogate"], "left_anti").select("kind", "entity", "surrogate"), "surrogates")
        done.append(taken)
        left = written(left.join(taken, ["kind", "entity"], "left_anti").select("kind", "entity"), "entities-left")
        draw += 1
        if left.isEmpty():
            break
    return reduce(DataFrame.union, done)


def _as_written(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the writing of the mention: its punctuation, its case."""
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    # Digits are filled in one by one; a country code that is no part of the entity stays.
    before = F.regexp_replace(mention, "[^0-9]", "")
    code = F.substring(before, F.lit(1), F.greatest(F.length(before) - F.length(surrogate), F.lit(0)))
    number = F.concat(code, surrogate)
    digits = F.filter(F.split(number, ""), lambda c: c != "")
    filled = F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                F.regexp_like(c, F.lit("[0-9]")),
                F.get(digits, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9]", "")) - 1),
            ).otherwise(c),
        ),
        "",
    )
    rest = F.substring(number, F.length(before) + 1, F.lit(64))
    upper = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    title = F.regexp_like(mention, F.lit(r"^\p{Lu}| \p{Lu}"))
    initial = F.when(F.regexp_like(mention, F.lit(r"^\p{Lu}\.$")), F.concat(F.upper(F.substring(surrogate, 1, 1)), F.lit(".")))
    cased = F.when(upper & (F.length(mention) > 1), F.upper(surrogate)).when(title & kind.isin("male", "female", "surname"), F.initcap(surrogate))
    return F.when(kind.isin("phone", "card"), F.concat(filled, rest)).otherwise(F.coalesce(initial, cased, surrogate))


def _named(gap: Column, names: Column) -> Column:
    """``(text, known)`` of the words of a text and of what is between them, names of ``names(name, text)``
    replaced. A name begins with a capital; its possessive ending stays."""

    def word(token: Column) -> Column:
        bare = F.regexp_replace(token, POSSESSIVE, "")
        found = F.get(F.filter(names, lambda n: n["name"] == F.lower(bare)), F.lit(0))["text"]
        found = F.when(F.regexp_like(token, F.lit(r"^\p{Lu}")), found)
        cased = F.when((F.upper(bare) == bare) & (F.length(bare) > 1), F.upper(found)).otherwise(F.initcap(found))
        ending = F.substring(token, F.length(bare) + 1, F.lit(8))
        return F.struct(F.coalesce(F.concat(cased, ending), token).alias("text"), found.isNotNull().alias("known"))

    return F.transform(F.split(gap, WORD_EDGE), word)


def replace_private(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with surrogates in place of e-mail addresses, phone and card numbers, IP addresses,
    secrets and names after a title, all columns kept, and ``n_replaced``, the number of mentions. In a
    document with such a name its words are replaced without a title as well.

    The same entity has the same surrogate in all documents, different ones have different surrogates.
    Formats stay: punctuation, length, case, the country code of a phone number, a card's first digit and
    whether its check digit is right, an address's top-level domain (within ``example``), a name's script
    and gender. IP addresses become private ones. Null and empty texts are as they were; documents are
    told apart by id and text, so equal rows get equal results and a null id is an id like any other. A
    column ``n_replaced`` of the input is replaced. An empty table gives an empty one.
    """
    found = written(mentions(docs, id_column, text_column), "mentions")
    made = surrogates(found, key)
    # An entity in a third of all documents is a hot key: a plain join, which Spark can split.
    placed = found.join(made, ["kind", "entity"]).select(
        F.col("doc_id").alias("ws_doc"), F.col("twin").alias("ws_twin"), "at", "part",
        _as_written(F.col("mention"), F.col("kind"), F.col("surrogate")).alias("text"),
        F.when(F.col("kind").isin("male", "female", "surname") & (F.length("entity") > 1), F.struct(F.col("entity").alias("name"), F.col("surrogate").alias("text"))).alias("name"),
    )
    # Equal rows of the input found their mentions more than once.
    whole = placed.groupBy("ws_doc", "ws_twin", "at").agg(
        F.array_sort(F.collect_set(F.struct("part", "text"))).alias("parts"), F.collect_set("name").alias("names")
    )
    spoken = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    words = whole.groupBy("ws_doc", "ws_twin").agg(
        F.array_sort(F.collect_list(F.struct("at", spoken.alias("text")))).alias("ws_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("ws_names"),
    )
    text = F.col(text_column)
    meets = F.col(id_column).eqNullSafe(F.col("ws_doc")) & (F.xxhash64(text) == F.col("ws_twin"))
    gaps = F.split(text, ANY, -1)
    # Only documents with names are read word by word.
    told = F.when(F.size("ws_names") > 0, F.transform(gaps, lambda g: _named(g, F.col("ws_names"))))
    joined = docs.join(words, meets, "left").withColumn("ws_told", told)
    said = F.coalesce(F.transform("ws_told", lambda ws: F.array_join(F.transform(ws, lambda w: w["text"]), "")), gaps)
    untitled = F.coalesce(F.size(F.filter(F.flatten("ws_told"), lambda w: w["known"])), F.lit(0))
    # Every mention has its words, so the k-th of them stand after the k-th gap.
    filled = F.array_join(
        F.transform(said, lambda gap, k: F.concat(gap, F.coalesce(F.get("ws_words", k)["text"], F.lit("")))), ""
    )
    names = [c for c in docs.columns if c != "n_replaced"]
    return joined.select(
        *[F.when(F.col("ws_words").isNull(), text).otherwise(filled).alias(c) if c == text_column else F.col(f"`{c}`") for c in names],
        F.when(F.col("ws_words").isNull(), 0).otherwise(F.size(gaps) - 1 + F.greatest(untitled, F.lit(0))).alias("n_replaced"),
    )
