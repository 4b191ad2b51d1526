"""Personal data replaced by keyed surrogates of the same kind, in columns only.

Entities are found by patterns. Each distinct entity (kind and canonical value, whatever
the format of its mentions) gets one surrogate, derived from a secret key by SHA-2, so a
person or number keeps one replacement in all documents and formats. Surrogates keep
length, character classes, separators, country prefixes and top-level domains; card
numbers that pass the Luhn check get surrogates that pass it; names keep gender (from the
form of address), script and capitals. A first name and a family name are entities of
their own, so "Mr. John Roe" and "Mr. Roe" stay one family. Collisions are checked over
all entities: a surrogate that equals another surrogate or any real value of its kind is
drawn again with the next attempt number until all are distinct.

Only entities and mentions are grouped, never documents; a frequent entity is reduced
before it is shuffled. Keys of hot texts are joined under adaptive skew handling.

Defined results: null stays null, empty stays empty. Documents that repeat are treated
alike. A text loses the noncharacter U+FDD0, which marks places inside the plan. Kinds
that share digits are tried in the order of ``KINDS``. The given table's other columns
are unchanged, but for ``n_chars``, which follows the text; a column ``__replaced`` of the
given table is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.store import stored

KEY = "surrogates"
MARK = "\ufdd0"
ROUNDS = 64

MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Г-н", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Г-жа", "κυρία")
NEUTRAL = ("Dr", "Prof")
_TITLES = {t for title in MALE + FEMALE + NEUTRAL for t in (title, title.upper())}
_TITLE = "|".join(sorted(_TITLES, key=lambda t: (-len(t), t)))
_NAME = r"\p{Lu}[\p{L}'\-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# What stands before a secret: the name of a key and its sign, or the head of a request.
_SECRET = (
    r"""(?i:password|passwd|pwd|secret|token|api[_\- ]?key)[A-Za-z_\-]{0,24}\s{0,3}[=:]\s{0,3}["']?"""
    r"|(?i:authorization\s{0,3}:\s{0,3}bearer)\s{1,3}"
)
KINDS = {
    "secret": rf"""(?:{_SECRET})[^\s"'<>,;]{{7,}}[A-Za-z0-9+/=_\-]""",
    # A host name has 127 labels at most; an unbounded group would recurse once a label.
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){1,126}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "access": r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "ip6": r"(?<![\w:])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
           r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?::|(?:[0-9A-Fa-f]{1,4}:){1,7}):[0-9A-Fa-f]{0,4})(?![\w:])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "card": r"(?<![\d+])\d(?:[ \-]?\d){12,18}(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,4}|\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())

# First names by script and gender, and syllables of family names by script.
GIVEN = {
    "latin": {
        "m": "Alan Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Ruben",
        "f": "Alma Berta Clara Diana Elena Frida Greta Hanna Irene Julia Klara Laura Marta Nora Olga Rosa",
        "n": "Alexis Ariel Chris Dominique Eden Jamie Kim Lee Luca Noa Robin Sam Sascha Toni Val Yael",
    },
    "cyrillic": {
        "m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел",
        "f": "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Полина",
        "n": "Женя Саша Валя Шура Слава Тоня Паша Миша",
    },
    "greek": {
        "m": "Άγγελος Βασίλης Γιώργος Δημήτρης Κώστας Λουκάς Μάρκος Νίκος",
        "f": "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Μαρία",
        "n": "Αλέξ Φώτη Χάρη Λάκη",
    },
}
SYLLABLES = {
    "latin": "ba ber bran cor dal den dor fel gar hal han kel lan lin mar mer nor pel ran rel sol tan ter val ven wil",
    "cyrillic": "ба вер гор дан ким лан мар нов пет род сав тол фед чер шам яр",
    "greek": "βα γορ δαν καλ λαμ μαρ νικ παπ ροδ σαν τελ φιλ",
}


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 512)


def _number(h: Column, i: Column) -> Column:
    """The i-th byte of a 64-byte hash, from 0, again from the start past its end."""
    return F.conv(F.substr(h, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(value: Column, change) -> Column:
    # Split once: looking up each place of a long value anew would take its length squared.
    each = F.transform(F.split(value, ""), lambda c, i: change(c, i + 1))
    return F.when(F.length(value) == 0, value).otherwise(F.array_join(each, ""))


def _letter(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def _let(build, **values: Column) -> Column:
    """``build`` of the values, each worked out once and not again for every character."""
    held = F.array(F.struct(*[v.alias(n) for n, v in values.items()]))
    return F.element_at(F.transform(held, lambda s: build(*[s[n] for n in values])), 1)


def shaped(value: Column, h: Column) -> Column:
    """Every digit and letter replaced by one of its class; the rest stays."""

    def spelled(value: Column, h: Column, hexadecimal: Column) -> Column:
        def change(c: Column, i: Column) -> Column:
            n = _number(h, i) + F.floor(i / 64).cast("int")
            return (
                F.when(c.rlike("[0-9]"), _letter("0123456789", n))
                .when(c.rlike("[a-z]"), F.when(hexadecimal, _letter("abcdef", n)).otherwise(_letter("abcdefghijklmnopqrstuvwxyz", n)))
                .when(c.rlike("[A-Z]"), _letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
                .otherwise(c)
            )

        return _chars(value, change)

    return _let(spelled, value=value, h=h, hexadecimal=value.rlike("^[0-9a-f]+$"))


def _luhn(digits: Column, odd: int) -> Column:
    """Digit sum with every second digit doubled, counted from the right."""
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == odd, d).otherwise(F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), weigh), F.lit(0), lambda a, x: a + x)


def _card(canon: Column, h: Column) -> Column:
    fresh = shaped(canon, h)
    body = F.substr(fresh, F.lit(1), F.length(fresh) - 1)
    valid = F.concat(body, F.pmod(10 - F.pmod(_luhn(body, 0), F.lit(10)), F.lit(10)).cast("string"))
    return F.when(_luhn(canon, 1) % 10 == 0, valid).otherwise(fresh)


def _ip(h: Column) -> Column:
    return F.concat_ws(".", *[(F.pmod(_number(h, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)])


def _hexadecimal(value: Column, h: Column) -> Column:
    return _chars(value, lambda c, i: F.when(c.rlike("[0-9A-Fa-f]"), _letter("0123456789abcdef", _number(h, i))).otherwise(c))


def _email(canon: Column, h: Column, domain_hash: Column) -> Column:
    local = F.substring_index(canon, "@", 1)
    domain = F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    labels = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    return F.concat(shaped(local, h), F.lit("@"), shaped(labels, domain_hash), F.lit("."), top)


def _pick(words: str, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words.split()]), F.pmod(n, F.lit(len(words.split()))) + 1)


def _syllables(script: str, h: Column, count: Column, at: int) -> Column:
    each = F.transform(F.sequence(F.lit(1), count), lambda i: _pick(SYLLABLES[script], _number(h, i + at)))
    return F.array_join(each, "")


def _by_script(build) -> Column:
    out = F.when(F.col("script") == "cyrillic", build("cyrillic")).when(F.col("script") == "greek", build("greek"))
    return out.otherwise(build("latin"))


def _given(gender: str, h: Column, attempt: Column) -> Column:
    more = F.when(attempt == 0, F.lit("")).otherwise(
        _by_script(lambda s: _syllables(s, h, F.floor(attempt / 4).cast("int") + 1, 8))
    )
    return F.concat(_by_script(lambda s: _pick(GIVEN[s][gender], _number(h, F.lit(0)))), more)


def _family(h: Column, attempt: Column) -> Column:
    return F.initcap(_by_script(lambda s: _syllables(s, h, F.floor(attempt / 4).cast("int") + 3, 16)))


def surrogate(key: str) -> Column:
    """The canonical surrogate of columns kind, script, canon and attempt."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")

    def drawn(h: Column, of_domain: Column) -> Column:
        return (
            F.when(kind == "email", _email(canon, h, of_domain))
            .when(kind == "ip", _ip(h)).when(kind == "ip6", _hexadecimal(canon, h)).when(kind == "card", _card(canon, h))
            .when(kind == "given_m", _given("m", h, attempt)).when(kind == "given_f", _given("f", h, attempt))
            .when(kind == "given_n", _given("n", h, attempt)).when(kind == "family", _family(h, attempt))
            .otherwise(shaped(canon, h))
        )

    return _let(
        drawn, h=_hash(F.lit(key), kind, canon, attempt.cast("string")),
        of_domain=_hash(F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1), F.lit("0")),
    )


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, script, canon, surrogate) with distinct surrogates that no entity has."""
    spark = entities.sparkSession
    real = stored(entities.select("kind", "script", "canon").distinct())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Few rows, each of much work: they are spread whatever their size.
    drawn = real.repartition(parts, "kind", "canon").withColumns({
        "attempt": F.lit(0), "bad": F.lit(True), "surrogate": F.lit("")})
    same = Window.partitionBy("kind", "folded").orderBy("attempt", "canon", "script")
    for _ in range(ROUNDS):
        drawn = stored(drawn.withColumn("surrogate", F.when(F.col("bad"), surrogate(key)).otherwise(F.col("surrogate"))))
        taken = real.select("kind", F.lower("canon").alias("folded"), F.lit(True).alias("real")).distinct()
        checked = (
            drawn.drop("bad").withColumn("folded", F.lower("surrogate")).join(taken, ["kind", "folded"], "left")
            .withColumn("bad", F.col("real").isNotNull() | (F.row_number().over(same) > 1))
        )
        if checked.where("bad").isEmpty():
            return drawn.select("kind", "script", "canon", "surrogate")
        drawn = checked.select(
            "kind", "script", "canon", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"), "bad", "surrogate"
        )
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds on {spark.sparkContext.appName}")


def _kind(mention: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in KINDS.items():
        out = out.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind))
    return out.otherwise(F.lit("secret"))


def parts_of(mentions: DataFrame) -> DataFrame:
    """Mentions cut into (at, kind, script, canon, lead, raw); lead is kept as it is."""
    m, kind = F.col("mention"), F.col("whole")
    lead = (
        F.when(kind == "secret", F.regexp_extract(m, f"^(?:{_SECRET})", 0))
        .when(kind == "access", F.lit("AKIA"))
        .when(kind == "iban", F.substring(m, 1, 2))
        .when(kind == "phone", F.regexp_extract(m, r"^\+\d{1,3}(?=[ .\-(])", 0))
        .when(kind == "name", F.regexp_extract(m, rf"^(?:{_TITLE})\.? ", 0))
        .otherwise(F.lit(""))
    )
    rest = F.substr(m, F.length("lead0") + 1, F.length(m))
    title = F.lower(F.regexp_replace(F.trim("lead0"), r"\.$", ""))
    gender = (
        F.when(title.isin(*[t.lower() for t in MALE]), F.lit("given_m"))
        .when(title.isin(*[t.lower() for t in FEMALE]), F.lit("given_f"))
        .otherwise(F.lit("given_n"))
    )
    pieces = F.when(kind == "name", F.split("rest", " ")).otherwise(F.array("rest"))
    one = (
        mentions.withColumn("whole", _kind(m)).withColumn("lead0", lead).withColumn("rest", rest)
        .withColumn("pieces", pieces)
        .select("mention", "whole", "lead0", gender.alias("gender"), F.size("pieces").alias("n"),
                F.posexplode("pieces").alias("at", "raw"))
    )
    named = F.when(F.col("at") == F.col("n") - 1, F.lit("family")).otherwise(F.col("gender"))
    raw = F.col("raw")
    canon = (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(raw, r"\D", ""))
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "ip6", "name"), F.lower(raw)).otherwise(raw)
    )
    script = (
        F.when(kind != "name", F.lit("")).when(raw.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic"))
        .when(raw.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))
    )
    return one.select(
        "mention", "at", F.when(kind == "name", named).otherwise(kind).alias("kind"),
        script.alias("script"), canon.alias("canon"),
        F.when(F.col("at") == 0, F.col("lead0")).otherwise(F.lit(" ")).alias("lead"), "raw",
    )


def _written(raw: Column, kind: Column, new: Column) -> Column:
    """The surrogate in the format of this mention."""
    def place(keep: str) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i), keep, ""))
        return _chars(raw, lambda c, i: F.when(c.rlike(keep), c).otherwise(F.substr(new, before(i), F.lit(1))))

    capitals = (F.upper(raw) == raw) & (F.lower(raw) != raw) & (F.length(raw) > 1)
    return (
        F.when(kind.isin("phone", "card", "ssn"), place("[^0-9]")).when(kind == "iban", place(" "))
        .when((kind == "email") | kind.startswith("given") | (kind == "family"), F.when(capitals, F.upper(new)).otherwise(new))
        .otherwise(new)
    )


def replaced_mentions(mentions: DataFrame, key: str = KEY) -> DataFrame:
    """(mention, written) of each distinct mention."""
    parts = parts_of(mentions)
    named = parts.join(assign(parts, key), ["kind", "script", "canon"])
    piece = F.concat("lead", _written(F.col("raw"), F.col("kind"), F.col("surrogate")))
    in_order = F.sort_array(F.collect_list(F.struct("at", piece.alias("piece"))))
    return named.groupBy("mention").agg(F.array_join(F.transform(in_order, lambda x: x["piece"]), "").alias("written"))


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities replaced in ``text``; ``__replaced`` counts the mentions."""
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    held = stored(
        docs.select(F.md5("text").alias("digest"), F.explode(found).alias("mention")).distinct()
    )
    written = replaced_mentions(held.select("mention").distinct(), key)
    free = "__"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    digest, of, known, cut = (free + c for c in ("digest", "of", "map", "pieces"))
    maps = held.join(written, "mention").groupBy(F.col("digest").alias(of)).agg(
        F.map_from_entries(F.collect_list(F.struct("mention", "written"))).alias(known)
    )
    pieces = F.split(F.regexp_replace("text", PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    joined = docs.withColumn(digest, F.md5("text")).join(maps, F.col(digest) == F.col(of), "left")
    new = F.transform(cut, lambda x: F.coalesce(F.try_element_at(known, x), x))
    changed = F.col(known).isNotNull()
    out = (
        joined.withColumn(cut, F.when(changed, pieces))
        .withColumn("text", F.when(changed, F.array_join(new, "")).otherwise(F.col("text")))
        .withColumn("__replaced", F.when(changed, F.floor(F.size(cut) / 2)).otherwise(F.lit(0)).cast("int"))
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[c for c in docs.columns if c != "__replaced"], "__replaced")
