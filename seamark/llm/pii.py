"""Surrogates for personal data (operator 9), in DataFrame operations only.

Entities are found by one expression.  Each different entity of the corpus gets one
keyed replacement of its own kind: e-mail addresses keep their shape, letter case and
last label, telephone numbers their country code, first digit and punctuation, cards their
first digit and a valid check digit, account numbers their country and valid check digits, secrets
their alphabet and prefix.  A name is one or two entities: given names keep the gender that a form of
address or the name itself tells, both keep script and letter case; the family name is replaced alike
with and without a given name or title, however the title is written.

A number is the same entity in all its forms (with or without a country code of 1,
whatever its punctuation), an address in all letter cases.  Replacements are checked over
the whole corpus: two entities that would share one, or one that is itself an entity of the
corpus, are drawn again until all are distinct.  So different entities stay
different and mentions of one stay mentions of one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm.common import forget, materialise, parts_for

#: Forms of address and what they tell (fixed values).
TITLES = {
    "m": ["Mr.", "Mr", "Herr", "Señor", "Monsieur", "Sr.", "господин", "г-н"],
    "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Frau", "Señora", "Madame", "Sra.", "Mme", "госпожа", "г-жа"],
}
#: Given names that begin a name without a form of address (fixed values).
COMMON = {
    "m": "Alexander Andrew Anthony Carlos Charles Christopher Daniel David Edward Francisco Frank George Hans Henry Jack James Jean Johannes John Joseph José Juan Jürgen Klaus Lucas Luis Manuel Mark Matthew Max Michael Miguel Nicolas Patrick Paul Peter Philippe Pierre Richard Robert Stefan Stephen Thomas Tom William Wolfgang Алексей Андрей Дмитрий Иван Михаил Николай Сергей".split(),
    "f": "Alice Ana Andrea Anna Anne Barbara Carmen Catherine Charlotte Claire Elizabeth Emily Emma Eva Hannah Helen Isabel Jane Jennifer Jessica Julia Karen Kate Katharina Laura Lena Linda Lucía Margaret Maria María Marie Martha Mary Nancy Nicole Patricia Rosa Ruth Sandra Sarah Sofia Sophie Susan Ursula Victoria Анна Елена Мария Наталья Ольга Татьяна".split(),
}
#: Given names that replace others, by gender and script (fixed values).
GIVEN = {
    "m": {"latin": ["Adrian", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Paul"], "cyrillic": ["Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Максим", "Павел"]},
    "f": {"latin": ["Alma", "Berta", "Clara", "Diana", "Elsa", "Flora", "Helena", "Irma", "Laura", "Marta", "Olga", "Paula"], "cyrillic": ["Алла", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Мария", "Ольга"]},
}
#: Syllables of family names by script (fixed values).
SYLLABLES = {"latin": ["ba", "den", "fel", "gor", "hal", "ken", "lor", "min", "nor", "per", "ros", "tal", "ver", "wil", "zan", "mar"], "cyrillic": ["ба", "вел", "гор", "дан", "кер", "лов", "мир", "нов", "пет", "рос", "сал", "тар", "фед", "чер", "шан", "яр"]}
_TITLE = "|".join(t.replace(".", "\\.") for k in TITLES for t in TITLES[k])
_COMMON = "|".join(x for k in COMMON for x in COMMON[k])
#: Country codes of one and two digits; all others have three (fixed values).
_COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_CAP = r"\p{Lu}(?:['’]\p{Lu})?\p{L}{1,30}(?:-\p{Lu}\p{L}{1,30})?"
#: What counts as an entity, in order of precedence; possessive runs and look-behinds keep matching linear.
#: No entity begins within a word (GUARD), which is tested once for all.
GUARD = r"(?<![\p{L}\p{N}])"
PATTERNS = {
    "email": r"(?<![._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,62}\.)*[\p{L}\p{N}\-]{0,62}\.\p{L}{2,24}",
    "name": rf"(?=[\p{{Lu}}г])(?:(?:{_TITLE}) {_CAP}(?: {_CAP})?|(?:{_COMMON}) {_CAP})(?![\p{{L}}\p{{N}}])",
    "secret": r"(?=[0-9A-Fa-gs])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip6": r"(?=[0-9A-Fa-f])(?<!:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": r"(?=[0-9])(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{N}]|\.[0-9])",
    "phone": r"(?=[+(0-9])(?:\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|\+(?!1[ .\-(])[0-9]{1,3}[ \-]?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[ \-]?[0-9]{2,5}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![\p{L}\p{N}]|[.\-][0-9])",
    "card": r"(?=[2-6])(?:[2-6][0-9]{15}|[2-6][0-9]{3}(?:-[0-9]{4}){3}|[2-6][0-9]{3}(?: [0-9]{4}){3}|3[47][0-9]{13}|3[47][0-9]{2}(?:-[0-9]{6}-| [0-9]{6} )[0-9]{5})(?![\p{L}\p{N}])",
    "id": r"(?=[0-9])(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
}
KINDS = tuple(k for k in PATTERNS if k != "ip6")
#: Whether any can begin is told by one character before the patterns are tried.
ANY = rf"(?=[\p{{L}}\p{{N}}+(._%\-]){GUARD}(?:{'|'.join(PATTERNS.values())})"
#: Texts without any of these hold no entity.
LITERALS = ("@", "::", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
HINT = rf"[0-9]|[a-f]{{32}}|[A-F]{{32}}|(?=[\p{{Lu}}г]){GUARD}(?:{_TITLE}|{_COMMON}) "
LAST = 24


def key_of(spark: SparkSession) -> str:
    """The key that the session has under spark.seamark.key; the queries' public one, for tables without real data, where it has none."""
    return spark.conf.get("spark.seamark.key", "public")


def _kind(e: Column) -> Column:
    """The kind of a match; patterns are tried in the same order as in ANY."""
    out = F
    for k in PATTERNS:
        out = out.when(e.rlike(f"^(?:{PATTERNS[k]})$"), k)
    return out.otherwise("secret")


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _norm(kind: Column, e: Column) -> Column:
    """Mentions with equal forms are one entity."""
    phone = F.concat(F.when(e.startswith("+"), F.lit("+")).otherwise("+1"), _digits(e))  # the forms without a plus are those of country code 1
    return F.when(kind == "phone", phone).when(kind.isin("card", "id"), _digits(e)).when(kind.isin("email", "ip6"), F.lower(e)).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).otherwise(e)


def _parts(kind: Column, e: Column) -> Column:
    """The entities of a mention: (lead, kind, norm, e); lead is what stays before it, within the mention."""
    title = F.regexp_extract(e, f"^(?:{_TITLE}) ", 0)
    names = F.substring(e, F.length(title) + 1, F.length(e))
    given, family = F.substring_index(names, " ", 1), F.substring_index(names, " ", -1)
    gender = F.when(F.rtrim(title).isin(TITLES["f"]), "f").when(F.rtrim(title).isin(TITLES["m"]), "m").when(given.isin(COMMON["f"]), "f").otherwise("m")
    one = lambda lead, k, norm, x: F.struct(lead.alias("lead"), k.alias("kind"), norm.alias("norm"), x.alias("e"))
    first = one(title, F.lit("given"), F.concat_ws("|", gender, F.lower(given)), given)
    last = lambda lead: one(lead, F.lit("family"), F.lower(family), family)
    return F.when(kind != "name", F.array(one(F.lit(""), kind, _norm(kind, e), e))).when(F.locate(" ", names) > 0, F.array(first, last(F.lit(" ")))).otherwise(F.array(last(title)))


def _draw(seed: Column, i, n) -> Column:
    """A number under n."""
    return F.pmod(F.xxhash64(seed, i if isinstance(i, Column) else F.lit(i)), F.lit(n).cast("bigint") if not isinstance(n, Column) else n.cast("bigint")).cast("int")


def _pick(seed: Column, i, letters: str) -> Column:
    return F.substring(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1))


def _recast(seed: Column, e: Column, hexadecimal: Column | None = None) -> Column:
    """Every letter and digit drawn anew in its own alphabet; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        latin = (
            F.when(c.rlike("[0-9]"), _pick(seed, i, "0123456789"))
            .when(c.rlike("[a-z]"), _pick(seed, i, "abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), _pick(seed, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike("[а-яё]"), _pick(seed, i, "абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike("[А-ЯЁ]"), _pick(seed, i, "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
            .when(c.rlike("[α-ω]"), _pick(seed, i, "αβγδεζηθικλμνξοπρστυφχψω"))
            .when(c.rlike("\\p{Ll}"), _pick(seed, i, "àáâäçèéêëìíîïñòóôöùúûü")).when(c.rlike("\\p{Lu}"), _pick(seed, i, "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"))
            .otherwise(c)
        )
        return latin if hexadecimal is None else F.when(hexadecimal & c.rlike("[0-9a-f]"), _pick(seed, i, "0123456789abcdef")).when(hexadecimal & c.rlike("[0-9A-F]"), _pick(seed, i, "0123456789ABCDEF")).otherwise(latin)

    return F.array_join(F.transform(F.split(e, ""), one), "")


def _luhn(digits: Column) -> Column:
    """digits with the last one set so that the number passes the usual check."""
    body = F.reverse(F.split(F.substring(digits, F.lit(1), F.length(digits) - 1), ""))
    each = F.transform(body, lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def _checked_iban(norm: Column) -> Column:
    """An account number with the check digits that its other characters ask for."""
    moved = F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 2), F.lit("00"))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))
    return F.concat(F.substring(norm, 1, 2), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), F.substring(norm, F.lit(5), F.length(norm)))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity's normal form, in normal form; later attempts draw from more room where a form has little."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 256)
    host_seed = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("host"), F.substring_index(norm, "@", -1)), 256)
    more = F.when(attempt > 2, F.array_join(F.transform(F.sequence(F.lit(1), F.least(attempt, F.lit(12))), lambda i: _pick(seed, i + 1000, "0123456789")), "")).otherwise("")
    host = F.substring_index(norm, "@", -1)
    email = F.concat(_recast(seed, F.substring_index(norm, "@", 1)), more, F.lit("@"), _recast(host_seed, F.regexp_replace(host, "\\.[^.]*$", "")), F.regexp_extract(host, "\\.[^.]*$", 0))
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    after = lambda head: F.concat(head, _recast(seed, F.substring(norm, F.length(head) + 1, F.length(norm))))
    first = lambda n: after(F.substring(norm, 1, n))
    phone = after(F.regexp_extract(norm, rf"^\+{_COUNTRY}[0-9]?", 0))
    known = F.regexp_extract(norm, "^(?:AKIA|gh[pousr]_|sk-)", 0)
    secret = F.when(known != "", after(known)).otherwise(_recast(seed, norm, norm.rlike("^[0-9a-f]+$") | norm.rlike("^[0-9A-F]+$")))
    female, cyrillic = norm.startswith("f|"), norm.rlike("\\p{IsCyrillic}$")
    of = lambda words, i: F.element_at(F.array(*map(F.lit, words)), _draw(seed, i, len(words)) + 1)
    syllables = lambda n: F.array_join(F.transform(F.sequence(F.lit(2), n + F.least(attempt, F.lit(12))), lambda i: F.when(cyrillic, of(SYLLABLES["cyrillic"], i)).otherwise(of(SYLLABLES["latin"], i))), "")
    listed = F.when(female, F.when(cyrillic, of(GIVEN["f"]["cyrillic"], 1)).otherwise(of(GIVEN["f"]["latin"], 1))).otherwise(F.when(cyrillic, of(GIVEN["m"]["cyrillic"], 1)).otherwise(of(GIVEN["m"]["latin"], 1)))
    # beyond the list, names are made up, with an ending that goes with the gender
    ending = F.when(female, F.when(cyrillic, "на").otherwise("na")).otherwise(F.when(cyrillic, "ан").otherwise("an"))
    given = F.concat(F.substring(norm, 1, 2), F.when(attempt < 2, F.lower(listed)).otherwise(F.concat(syllables(F.lit(1)), ending)))
    return (
        F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "ip6", _recast(seed, norm, F.lit(True))).when(kind == "phone", phone).when(kind == "card", _luhn(first(1)))
        .when(kind == "iban", _checked_iban(first(4))).when(kind == "given", given).when(kind == "family", syllables(F.lit(4))).when(kind == "secret", secret).otherwise(_recast(seed, norm))
    )


def _fit(kind: Column, e: Column, s: Column) -> Column:
    """A replacement laid into the form of one mention."""
    digits, new = _digits(e), _digits(s)
    # by the last digit, as a mention may lack the country code
    nth = lambda i: F.length(_digits(F.substring(e, F.lit(1), i + 1))) + F.length(new) - F.length(digits)
    laid = F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, nth(i), F.lit(1))).otherwise(c)), "")
    gaps = F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(s, F.length(F.replace(F.substring(e, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    # letter case by place: of the name from its start, of the host from its end
    before, longer = F.length(F.substring_index(e, "@", 1)), F.length(s) - F.length(e)
    source = lambda i: F.when(i < before, F.substring(e, i + 1, F.lit(1))).when(i >= before + longer, F.substring(e, i - longer + 1, F.lit(1))).otherwise("")
    cased = F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(source(i).rlike("\\p{Lu}"), F.upper(c)).otherwise(c)), "")
    email = F.when(F.lower(e) == e, s).otherwise(cased)
    name = F.regexp_replace(s, "^[mf]\\|", "")
    return (
        F.when(kind.isin("phone", "card", "id"), laid).when(kind == "iban", gaps).when(kind == "email", email)
        .when(kind.isin("given", "family"), F.when(F.upper(e) == e, F.upper(name)).otherwise(F.initcap(name))).when((kind == "ip6") & e.rlike("[A-F]"), F.upper(s)).otherwise(s)
    )


def assign(entities: DataFrame, key: str, files: int = 8) -> DataFrame:
    """(kind, norm, surrogate) for distinct (kind, norm); all replacements of a kind distinct, none of them an entity.

    A round draws for the entities that are open, and settles those whose draw nobody
    else has; only the others go to the next.  files: of each table that is written.
    """
    open_ = materialise(entities.select("kind", "norm").coalesce(files), "entities")
    every, settled = open_, None
    for attempt in range(LAST):
        drawn = materialise(open_.select("kind", "norm", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key).alias("surrogate")).coalesce(files), "drawn")
        # the smallest form keeps a shared draw; a partial aggregate, so no group meets in one task
        won = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        won = won.join(every.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if settled is not None:
            won = won.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = materialise(won.select("kind", "norm", "surrogate").coalesce(files), "settled")
        settled = won if settled is None else settled.unionByName(won)
        open_ = materialise(drawn.join(won, ["kind", "norm"], "left_anti").select("kind", "norm").coalesce(files), "open")
        forget(drawn)
        if open_.isEmpty():
            return settled
    raise ValueError(f"replacements still meet after {LAST} draws: a form has no room for its entities")


def replace(docs: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """docs (columns keep, all by default) with text's entities replaced, and ``n_<kind>`` counts.

    key: without it the replacements cannot be foretold; the same key gives the same
    draws.  A null text stays null, an empty one empty; a text without entities is returned as
    it is.  Repeated rows are treated alike, an empty table gives none, nulls elsewhere
    are carried.  Columns named like the counts are replaced.  Names are found after a form of
    address (TITLES) or by a common given name (COMMON).  Where a form has no room for
    distinct replacements of all its entities, a ValueError says so.
    """
    counts = [f"n_{k}" for k in KINDS]
    names = [c for c in (docs.columns if keep is None else keep) if c not in counts]
    carried = [F.col(c).alias(f"_c{k}") for k, c in enumerate(names) if c != "text"]
    columns = [f"_c{k}" for k, c in enumerate(names) if c != "text"]
    rows = docs.select(*carried, "text")
    hint = reduce(Column.__or__, [F.col("text").contains(x) for x in LITERALS]) | F.col("text").rlike(HINT)
    found = F.when(hint, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    has = hint & F.col("text").rlike(ANY)
    plain = rows.where(~F.coalesce(has, F.lit(False))).select(*columns, "text", *(F.lit(0).cast("bigint").alias(c) for c in counts))
    # only texts with entities are written; the numbers in _row are fixed by that
    hits = materialise(rows.where(has).select(*columns, "text", found.alias("found"), F.monotonically_increasing_id().alias("_row")), "entities")
    files = parts_for(hits.count(), 25_000, least=4)
    mentions = hits.select("_row", F.posexplode("found").alias("pos", "m")).withColumn("kind", _kind(F.col("m")))
    mentions = mentions.select("_row", "pos", F.posexplode(_parts(F.col("kind"), F.col("m"))).alias("part", "x")).select("_row", "pos", "part", "x.*")
    chosen = assign(mentions.select("kind", "norm").distinct(), key, files)
    fitted = mentions.join(chosen, ["kind", "norm"]).select("_row", "pos", "part", "kind", F.concat("lead", _fit(F.col("kind"), F.col("e"), F.col("surrogate"))).alias("s"))
    of = {"name": ["family"], "ip": ["ip", "ip6"]}
    lists = fitted.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "s"))).alias("new"), *(F.count_if(F.col("kind").isin(of.get(k, [k]))).alias(f"n_{k}") for k in KINDS))
    gaps = F.split("text", ANY, -1)
    pieces = F.transform(F.col("new"), lambda x: F.concat(F.when(x.part == 0, F.get(F.col("gaps"), x.pos)).otherwise(""), x.s))
    text = F.concat(F.array_join(pieces, ""), F.element_at("gaps", -1))
    done = hits.join(lists, "_row").withColumn("gaps", gaps).select(*columns, text.alias("text"), *counts)
    out = plain.unionByName(done.coalesce(files * 4))
    return out.select(*(F.col(f"_c{k}").alias(c) if c != "text" else F.col("text") for k, c in enumerate(names)), *([] if "text" in names else ["text"]), *counts)
