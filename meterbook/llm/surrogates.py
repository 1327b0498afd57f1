"""Keyed surrogates for personal data, all in DataFrame functions.

One pattern finds e-mail addresses, phone numbers, network addresses, card and account
numbers, national numbers and titled names. An entity is reduced to its cores: a number
without its separators, an address in small letters, a name's given and family name. Every
distinct core gets a surrogate from a keyed hash, and the entity is built again from it in
the format found, so that one number is replaced alike in every format and a family
name alike behind every title and given name. Digits and letters keep their kind, card and
account numbers stay valid if they were, phone numbers keep their country code, accounts
their country, network addresses stay valid, names keep title, gender and script.

A surrogate that equals another's, or any core of the corpus, is drawn again a few times;
what is left then is numbered and gets a longer one with its number in it. So distinct
entities stay distinct, equal ones equal in all documents, however many there are.

Defined cases: a null text stays null, an empty one empty; a text without entities is
passed on as it is. Repeated rows get equal surrogates. Columns other than text are
left alone, except that a number column n_chars follows the new text.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare, staged, unstage

#: Draws in the format found before a surrogate is made longer.
ROUNDS = 3
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mademoiselle", "Г-жа", "Κυρία")
_MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Г-н", "Κύριος")
_NEUTRAL = ("Dr", "Prof", "Professor", "Doctor", "Mx", "Д-р", "Проф", "Δρ", "Καθ")
_TITLES = "|".join(sorted((*_FEMALE, *_MALE, *_NEUTRAL), key=len, reverse=True))
#: One title or several, as in Frau Dr. or Prof. Dr.
_TITLED = rf"(?:{_TITLES})\.?(?: (?:{_TITLES})(?![\p{{L}}\p{{N}}'-])\.?)*+"
_NAME = rf"(?<![\p{{L}}\p{{N}}]){_TITLED} \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
_HEXTETS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kind and pattern, in the order in which they are tried.
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,20})"),
    ("ip", rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"),
    ("ipv6", rf"(?<![0-9A-Za-z:.])(?:{_HEXTETS}{{7}}|(?=[0-9A-Fa-f]{{3,4}}:)(?=[A-Fa-f:]*\d){_HEXTETS}{{0,6}}::(?:{_HEXTETS}{{0,5}})?)(?![0-9A-Za-z:])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"),
    ("phone_local", r"(?<![\d+])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"),
    ("national", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"),
    ("phone_national", r"(?<![\d+/.,-])(?<!\d )\(?0[1-9]\d{0,3}\)?[ /-](?:\d{5,8}|\d{2,4}(?: \d{2,4}){2,3}|\d{3,4} \d{3,5})(?!\d|[ ./,-]\d)"),
    ("phone_bare", r"(?<![\p{L}\d_+/.,:=#-])(?:0[1-9]|[2-9]\d)\d{8}(?![\p{L}\d_]|[./,:-]\d)"),
    ("name", _NAME),
)
PATTERN = "|".join(p for _, p in KINDS)
#: What any entity has: a digit group, an address sign or a title.
HINT = rf"::|[0-9A-Fa-f]:[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f]|\d[\d() .-]{{5}}|@|[A-Z]{{2}}\d\d|(?:{_TITLES})\.? \p{{Lu}}"
#: Given names by script and gender; family names are built of the script's syllables.
_GIVEN = {
    ("latin", "female"): "Alma Berta Clara Dora Emilia Flora Greta Helena Irma Julia Karla Lena Marta Nina Olga Petra".split(),
    ("latin", "male"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Konrad Leo Martin Noel Oscar Paul".split(),
    ("cyrillic", "female"): "Анна Вера Галина Дарья Елена Зоя Ирина Мария".split(),
    ("cyrillic", "male"): "Антон Борис Виктор Глеб Денис Иван Максим Павел".split(),
    ("greek", "female"): "Άννα Δάφνη Ειρήνη Ελένη Ζωή Μαρία Νίκη Σοφία".split(),
    ("greek", "male"): "Άρης Γιώργος Δημήτρης Ηλίας Κώστας Μάριος Νίκος Πέτρος".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke la le lo ma me mo na ne no pa pe ra re ro sa se ta to".split(),
    "cyrillic": "ба ве во га да де жа за ка ко ла ле ло ма ми на но па по ра ре ро са се со та те то ва ви ди ни".split(),
    "greek": "βα γα δα δο ζα θα κα κο λα λο μα μο να νο πα πο ρα ρο σα σο τα το φα χα βε δε κε λε με νε πε τε".split(),
}


def _pick(words: list[str], seed: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(seed, F.lit(len(words))) + 1).cast("int"))


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the whole entity."""
    tests = [(kind, entity.rlike(rf"^(?:{pattern})$")) for kind, pattern in KINDS]
    return reduce(lambda rest, t: F.when(t[1], t[0]).otherwise(rest), reversed(tests[:-1]), F.lit(tests[-1][0]))


def _redrawn(entity: Column, seed: Column) -> Column:
    """Letters and ASCII digits drawn anew in kind and case; everything else stays."""
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def letter(c: Column, i: Column) -> Column:
        draw = F.pmod(F.xxhash64(seed, i), F.lit(2_600_000_000))
        of = lambda text: F.substring(F.lit(text), (draw % len(text) + 1).cast("int"), F.lit(1))
        return (
            F.when(c.rlike("^[0-9]$"), (draw % 10).cast("string"))
            .when(c.rlike("^[a-z]$"), of(small)).when(c.rlike("^[A-Z]$"), of(large)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(entity, "(?<=.)(?=.)"), letter), "")


def _luhn(number: Column) -> Column:
    """Sum of the digits, every second from the right doubled, modulo 10."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), "(?<=.)(?=.)"))
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))
    )
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, b: a + b) % 10


def _card(core: Column, seed: Column, more: Column) -> Column:
    """A check digit that is as valid as the card's own."""
    body = F.concat(_redrawn(F.substring(core, F.lit(1), F.length(core) - 1), seed), more)
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10
    wrong = (check + F.lit(1) + F.pmod(F.xxhash64(seed, F.lit("check")), F.lit(9))) % 10
    return F.concat(body, F.when(_luhn(core) == 0, check).otherwise(wrong).cast("int").cast("string"))


def _mod_97(core: Column) -> Column:
    """Remainder of an account number, its first four signs put last, letters as 10 to 35."""
    turned = F.concat(F.substring(core, F.lit(5), F.length(core)), F.substring(core, 1, 4))

    def step(so_far: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.when(digit, so_far * 10 + c.try_cast("int")).otherwise(so_far * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step)


def _iban(core: Column, seed: Column, more: Column) -> Column:
    """The country stays; check digits are computed anew if they were right."""
    country = F.left(core, F.lit(2))
    body = F.concat(_redrawn(F.substring(core, F.lit(5), F.length(core)), seed), more)
    right = F.lpad((F.lit(98) - _mod_97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
    return F.concat(country, F.when(_mod_97(core) == 1, right).otherwise(_redrawn(F.substring(core, 3, 2), F.sha1(seed))), body)


def _ip(seed: Column) -> Column:
    octets = [(F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)]
    return F.concat_ws(".", *octets)


def _ipv6(core: Column, seed: Column) -> Column:
    """Hex digits drawn anew in kind; the groups stay."""

    def digit(c: Column, i: Column) -> Column:
        draw = F.pmod(F.xxhash64(seed, i), F.lit(2_400_000_000))
        small = F.substring(F.lit("abcdef"), (draw % 6 + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("^[0-9]$"), (draw % 10).cast("string")).when(c.rlike("^[a-f]$"), small).otherwise(c)

    return F.array_join(F.transform(F.split(core, "(?<=.)(?=.)"), digit), "")


def _phone(core: Column, seed: Column) -> Column:
    """The country code stays, one digit if it is 1 or 7 and else two, and a leading zero."""
    lead = F.regexp_extract(core, r"^(?:\+[17]|\+\d\d|0)?", 0)
    return F.concat(lead, _redrawn(F.substring(core, F.length(lead) + 1, F.length(core)), seed))


def _email(core: Column, seed: Column, more: Column) -> Column:
    """The top-level domain stays."""
    end = F.regexp_extract(core, r"\.[a-z]+$", 0)
    return F.concat(more, _redrawn(F.substring(core, F.lit(1), F.length(core) - F.length(end)), seed), end)




def _of_script(core: Column, make) -> Column:
    """``make(script)`` for the script a word is written in."""
    out: Column = make("latin")
    for script in ("greek", "cyrillic"):
        out = F.when(core.rlike(rf"\p{{Is{script.capitalize()}}}"), make(script)).otherwise(out)
    return out


def _numbered(words: list[str], number: Column, width: int) -> Column:
    """A number as ``width`` words of equal length, so that different numbers end differently."""
    base = len(words)
    digits = [F.pmod(F.floor(number / F.lit(base**i)), F.lit(base)) for i in range(width)]
    return F.concat(*(_pick(words, d) for d in digits))


#: Words that stand for digits in base 26 and 10.
_LETTERS, _DIGITS = list("abcdefghijklmnopqrstuvwxyz"), list("0123456789")


def drawn(kind: Column, core: Column, key: str, attempt: int, number: Column, width: int) -> Column:
    """The surrogate of a core at one attempt; from the fourth on with its number in it."""
    seed = F.sha2(F.concat(F.lit(f"{key}\0"), kind, F.lit(f"\0{attempt}\0"), core), 256)
    long = attempt >= ROUNDS
    more = lambda words: _numbered(words, number, width) if long else F.lit("")
    half = F.pmod(F.floor(number / 65536), F.lit(65536)).cast("long")
    shifted = F.pmod(number * 7 + attempt, F.lit(1 << 28)).cast("long")
    octets = [F.pmod(F.floor(shifted / F.lit(256**i)), F.lit(256)).cast("long").cast("string") for i in (2, 1, 0)]
    ip = F.concat_ws(".", (F.lit(240) + F.floor(shifted / F.lit(256**3))).cast("long").cast("string"), *octets) if long else _ip(seed)
    hexed = F.concat(F.lit(f"fd00:{attempt}::"), F.lower(F.hex(half)), F.lit(":"), F.lower(F.hex(F.pmod(number, F.lit(65536)).cast("long"))))
    family = lambda s: F.concat(*(_pick(_SYLLABLES[s], F.xxhash64(seed, F.lit(i))) for i in range(3)), more(_SYLLABLES[s]))
    given = lambda g: lambda s: F.concat(F.lower(_pick(g(s), F.xxhash64(seed))), more(_SYLLABLES[s]))
    pool = {"f": lambda s: _GIVEN[s, "female"], "m": lambda s: _GIVEN[s, "male"]}
    either = lambda s: _GIVEN[s, "female"] + _GIVEN[s, "male"]
    return (
        F.when(kind == "ip", ip).when(kind == "card", _card(core, seed, more(_DIGITS)))
        .when(kind == "iban", _iban(core, seed, more(_DIGITS)))
        .when(kind == "email", _email(core, seed, more(_LETTERS)))
        .when(kind == "phone", F.concat(_phone(core, seed), more(_DIGITS)))
        .when(kind == "ipv6", hexed if long else _ipv6(core, seed))
        .when(kind == "family", _of_script(core, family))
        .when(kind == "given f", _of_script(core, given(pool["f"]))).when(kind == "given m", _of_script(core, given(pool["m"])))
        .when(kind == "given", _of_script(core, given(either)))
        .otherwise(F.concat(_redrawn(core, seed), more(_DIGITS)))
    )


#: Kinds whose numbers are one whatever their format, by the name they go by.
_SAME = {"phone_local": "phone", "phone_national": "phone", "phone_bare": "phone"}


def cores_of(kind: Column, entity: Column) -> Column:
    """The cores an entity is built of: for a name its family name and, if there is one, its given name."""
    words = F.split(F.lower(F.substring(entity, F.length(_title(entity)) + 2, F.length(entity))), " ")
    form = F.regexp_extract(entity, r"^[^ .]+", 0)
    given = F.when(form.isin(*_FEMALE), "given f").when(form.isin(*_MALE), "given m").otherwise("given")
    core = lambda k, c: F.struct(k.alias("kind"), c.alias("core"))
    family = core(F.lit("family"), F.element_at(words, -1))
    of_name = F.when(F.size(words) > 1, F.array(family, core(given, words[0]))).otherwise(F.array(family))
    plain = F.when(kind.isin("email", "ip", "ipv6"), F.lower(entity)).otherwise(F.regexp_replace(F.upper(entity), r"[^0-9A-Z+]", ""))
    same = reduce(lambda rest, k: F.when(kind == k, _SAME[k]).otherwise(rest), _SAME, kind)
    return F.when(kind == "name", of_name).otherwise(F.array(core(same, plain)))


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^{_TITLED}", 0)


def _rendered(kind: Column, entity: Column, new: Column) -> Column:
    """An entity's surrogate from those of its cores, in the entity's own format and case."""
    first, second = new[0], F.try_element_at(new, F.lit(2))
    signs = F.split(entity, "(?<=.)(?=.)")
    cased = lambda c, like: F.when(like.rlike("^[A-Z]$"), F.upper(c)).when(like.rlike("^[a-z]$"), F.lower(c)).otherwise(c)
    alike = F.array_join(F.zip_with(signs, F.split(first, "(?<=.)(?=.)"), lambda like, c: cased(c, like)), "")
    state = lambda at, out: F.struct(at.cast("int").alias("at"), out.alias("out"))

    def fill(a: Column, c: Column) -> Column:
        taken = cased(F.substring(first, a["at"] + 1, F.lit(1)), c)
        return F.when(c.rlike("^[0-9A-Za-z+]$"), state(a["at"] + 1, F.concat(a["out"], taken))).otherwise(
            state(a["at"], F.concat(a["out"], c))
        )

    filled = F.aggregate(signs, state(F.lit(0), F.lit("")), fill, lambda a: F.concat(a["out"], F.substring(first, a["at"] + 1, F.length(first))))
    words = F.split(F.substring(entity, F.length(_title(entity)) + 2, F.length(entity)), " ")
    shown = lambda word, like: F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(word)).otherwise(F.initcap(word))
    named = F.concat_ws(" ", _title(entity), F.when(second.isNotNull(), shown(second, words[0])), shown(first, F.element_at(words, -1)))
    same_length = F.length(first) == F.length(entity)
    return (
        F.when(kind == "name", named)
        .when(kind.isin("email", "ip", "ipv6"), F.when(same_length, alike).otherwise(first))
        .otherwise(filled)
    )


def _group(kind: Column) -> Column:
    """Kinds whose surrogates must differ from one another's: given names are one."""
    return F.when(kind.startswith("given"), "given").otherwise(kind)


def core_table(cores: DataFrame, key: str) -> DataFrame:
    """(kind, core, new) for distinct cores: no surrogate twice in a group, none a core of it.

    Each round draws for what is still open; of equal draws the smallest core keeps its own.
    After ``ROUNDS`` the open ones are numbered and surrogates end in their number, one sign
    longer each round: those differ from one another, and in the end from all that is shorter.
    """
    spark = cores.sparkSession
    known = cores.select(_group(F.col("kind")).alias("group"), F.col("core").alias("new")).distinct()
    open_, settled, attempt, width = cores.withColumn("number", F.lit(0).cast("long")), None, 0, 1
    while True:
        if attempt == ROUNDS:
            # Numbered over all partitions: an id's high part is its partition, of bounded number.
            ids = staged(open_.select("kind", "core").orderBy("core", "kind").withColumn("id", F.monotonically_increasing_id()), "numbers")
            part = F.shiftright("id", 33).cast("int")
            before, starts = 0, []
            for r in ids.groupBy(part.alias("part")).count().orderBy("part").collect():
                starts.append((r.part, before))
                before += r["count"]
            start = spark.createDataFrame(starts, "part int, start long")
            rank = F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
            open_ = staged(ids.withColumn("part", part).join(start, "part").select("kind", "core", rank.alias("number")), "open")
            width = max(1, len(str(before)))
        elif attempt > ROUNDS:
            width += 1
        tried = open_.withColumn("new", drawn(F.col("kind"), F.col("core"), key, attempt, F.col("number"), width))
        tried = tried.withColumn("group", _group(F.col("kind")))
        won = tried.groupBy("group", "new").agg(F.min(F.struct("core", "kind")).alias("x"))
        won = won.join(known, ["group", "new"], "left_anti")
        if settled is not None:
            won = won.join(settled.select("group", "new"), ["group", "new"], "left_anti")
        won = won.select("group", "new", "x.core", "x.kind")
        won = won if settled is None else won.unionByName(settled)
        last, settled = settled, staged(won, "surrogates")
        left = staged(open_.join(settled.select("kind", "core"), ["kind", "core"], "left_anti"), "open")
        for old in (last, *([open_] if attempt else [])):
            if old is not None:
                unstage(old)
        open_ = left
        if open_.isEmpty():
            unstage(open_)
            return settled.select("kind", "core", "new")
        attempt += 1


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(entity, surrogate) for distinct entities of (kind, entity)."""
    parts = entities.select("kind", "entity", F.posexplode(cores_of(F.col("kind"), F.col("entity"))).alias("at", "c"))
    parts = staged(parts.select("kind", "entity", "at", F.col("c.kind").alias("of"), "c.core"), "cores")
    # A given name without a gender of its own goes with the only one it has elsewhere.
    given = parts.filter("of IN ('given f', 'given m')").groupBy("core").agg(F.min("of").alias("one"), F.max("of").alias("other"))
    told = given.filter("one = other").select("core", "one", F.lit("given").alias("of"))
    parts = parts.join(told, ["core", "of"], "left").withColumn("of", F.coalesce("one", "of")).drop("one")
    parts = staged(parts, "parts")
    table = core_table(parts.select(F.col("of").alias("kind"), "core").distinct(), key)
    met = parts.join(table.withColumnRenamed("kind", "of"), ["of", "core"])
    whole = met.groupBy("entity").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("at", "new"))).alias("found"))
    new = F.transform("found", lambda x: x["new"])
    return whole.select("entity", _rendered(F.col("kind"), F.col("entity"), new).alias("surrogate"))


def entities_of(text: Column) -> Column:
    """The entities of a text in order; an empty array without."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def replace_personal(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """The documents, all columns, with every entity in ``text`` replaced.

    Texts without entities are not shuffled; the others meet their list of surrogates
    by the digest of their list of entities.
    """
    prepare(docs.sparkSession)
    ents, pieces, want, new = (free_name(docs, c) for c in ("entities", "pieces", "pack_of", "new"))
    text = F.col("`text`").cast("string")
    # The pattern goes over the texts once: rows, their entities and what lies between are staged.
    marked = docs.withColumn(ents, F.coalesce(entities_of(text), F.array().cast("array<string>")))
    between = F.when(F.size(ents) > 0, F.split(text, PATTERN, -1))
    kept = F.when(F.size(ents) == 0, text)
    rows = staged(marked.withColumn(pieces, between).withColumn("text", kept), "marked")
    digest = F.sha2(F.array_join(F.col(ents), "\0"), 256)
    some = rows.filter(F.size(ents) > 0)
    lists = staged(some.select(F.col(ents).alias("all"), digest.alias("pack")).distinct(), "entities")
    each = lists.select("pack", F.posexplode("all").alias("at", "entity"))
    distinct = each.select("entity").distinct().withColumn("kind", kind_of(F.col("entity")))
    table = staged(surrogate_table(staged(distinct, "kinds"), key), "table")
    placed = each.join(table, "entity").groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("found"))
    packs = staged(placed.select(F.col("pack").alias(want), F.transform("found", lambda x: x["surrogate"]).alias(new)), "packs")
    unstage(lists)

    some = some.join(packs, digest == F.col(want))
    full = F.array_join(F.zip_with(F.col(pieces), F.col(new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    some = some.withColumn("text", full)
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    plain = rows.filter(F.size(ents) == 0)
    return plain.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(some.select(*(F.col(f"`{c}`") for c in docs.columns)))
