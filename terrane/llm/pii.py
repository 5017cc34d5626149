"""PII surrogates: detected entities get keyed replacements of their kind. Native: DataFrame operations only.

Detection is one pattern with an alternative for each kind. A mention's canonical form (an e-mail in lower case, a number's
digits, a name in lower case) is the entity, so all its mentions, whatever their format, share a surrogate. Names are entities
by component, so that a surname alone is still the same person's. A name is detected by its title; the components of a document's
detected names are then replaced wherever they stand in it as capitalised words without a title.

Not detected: names that have a title nowhere in their document; phone numbers of digits alone without + or 00 ('5551234567'),
of local form ('555-1234'), or national ones in other groups than three (or two to four in brackets), three or four, and four;
numbers of cards that have neither 16 digits nor the 15 of 34 and 37; IPv6 addresses; SSNs without hyphens; e-mail addresses
with letters beyond ASCII; postal addresses, dates of birth and other identifiers.

A phone number is one entity with its country and, if of ten digits, without (country 1); a given name is one whatever the title.
An e-mail address keeps the last two labels of its domain, so a domain that is a person's own stays readable.

A surrogate is drawn by a keyed hash of kind, entity and attempt: digits for digits and letters for letters of the same
script, octets that stay octets, a Luhn-valid number for a Luhn-valid one, and for names syllables of the same script
with an ending of the same gender. It is accepted if no other entity of its kind has it and no entity of the corpus has
that form itself; the others draw again, and after ``ATTEMPTS`` draws in ever longer forms (more digits or syllables, octets of any length), since a form
may have fewer surrogates than entities or none at all ('_@x.com'). All entities are checked, by shuffles over the distinct ones, so distinct entities
stay distinct. Each mention is then written in its own format (case, separators).

Defined results: a null text stays null, one without entities stays as it is; rows that repeat an id and text get equal
results; extra columns are kept by :func:`pseudonymize`, but for one named ``entities``, which it sets; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .licenses import let
from .shared import materialize

# Honorifics by gender, and the alphabets that names are made of.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "κυρία")
NEUTRAL = ("Dr", "Prof")
SCRIPTS = {"cyrillic": ("бвгдзклмнпрст", "аеио", {"m": "ов", "f": "ова", "n": "ко"}), "greek": ("βγδζκλμνπρστ", "αειο", {"m": "ος", "f": "α", "n": "ι"}), "latin": ("bcdfgklmnprstv", "aeio", {"m": "en", "f": "a", "n": "el"})}

_TITLE = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_NAME = r"\p{Lu}(?:[\p{L}-]|['’](?=\p{L})(?![sS](?!\p{L})))+"  # a genitive's 's isn't part of it
WORD = rf"(?<![\p{{L}}'’-]){_NAME}"
# a domain has 127 labels at most, by its standard; nothing else is bounded
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}(?![A-Za-z0-9-])"
# of a country with its groups of three, three and four, or any international number after + or 00
PHONE = r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3,4}[ .-]\d{4}|\+[1-9](?:[ .-]?\(?\d\)?){6,14}|00[1-9](?:[ .-]?\(?\d\)?){7,12})(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"
CARD = r"(?<!\w)(?:\d{4}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\w)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
NAME = rf"(?<![\p{{L}}])(?:{_TITLE})\.? {_NAME}(?: {_NAME})?"
PATTERNS = {"email": EMAIL, "phone": PHONE, "ssn": SSN, "ip": IP, "card": CARD, "iban": IBAN, "name": NAME}
# Guards: a character that none of an alternative's mentions begins with is passed at one look.
_FIRST = "".join(sorted({t[0] for t in (*MALE, *FEMALE, *NEUTRAL)}))
ANY = rf"(?:{EMAIL})|(?=[\d+(])(?:{'|'.join(f'(?:{p})' for p in (PHONE, SSN, IP, CARD))})|(?=[A-Z])(?:{IBAN})|(?=[{_FIRST}])(?:{NAME})"
KINDS = tuple(PATTERNS)
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Draws in the entity's own form; each later one has a longer form, so none is ever without a surrogate.
ATTEMPTS = 8


def kind_of(mention):
    """The first kind whose pattern is the whole mention."""
    return reduce(lambda rest, k: F.when(mention.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(rest), reversed(KINDS), F.lit("other"))


def gender_of(mention):
    title = F.regexp_extract(mention, rf"^({_TITLE})", 1)
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def parts_of(mention):
    """array<struct<part, kind, entity>>: what a mention has to have replaced. Only names have several parts."""
    kind = kind_of(mention)
    digits = F.regexp_replace(mention, r"[^0-9A-Za-z]", "")
    names = F.split(F.regexp_replace(mention, rf"^(?:{_TITLE})\.? ", ""), " ")
    gender = gender_of(mention)
    name_parts = F.transform(names, lambda n, i: F.struct(n.alias("part"), F.when((i == 0) & (F.size(names) > 1), F.concat(F.lit("given_"), gender)).otherwise(F.concat(F.lit("surname_"), F.when(n.rlike(r"^\p{IsCyrillic}"), gender).otherwise(F.lit("n")))).alias("kind"), F.lower(n).alias("entity")))
    # ten digits in national groups are of country 1, so that a number is one entity with and without its country
    phone = F.when(mention.startswith("+"), F.concat(F.lit("+"), digits)).when(mention.startswith("00"), F.regexp_replace(digits, "^00", "+")).when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).otherwise(digits)
    entity = F.when(kind == "email", F.lower(mention)).when(kind == "ip", mention).when(kind == "phone", phone).otherwise(digits)
    return F.when(kind == "name", name_parts).otherwise(F.array(F.struct(mention.alias("part"), kind.alias("kind"), entity.alias("entity"))))


def _byte(stream, i):
    """The i-th byte of a keyed hexadecimal stream, going round after its end."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n):
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def _like(entity, stream):
    """Digits for digits and letters for letters, at the same places."""
    def each(c, i):
        n = _byte(stream, i)
        return F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n)).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), each), "")


def _luhn_sum(digits, from_right: int):
    """The Luhn sum of a string of digits; ``from_right``: 0 if its last digit counts once, 1 if twice."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.struct(c.cast("int").alias("c"), F.pmod(i + from_right, F.lit(2)).alias("odd")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x["odd"] == 1, F.when(x["c"] > 4, x["c"] * 2 - 9).otherwise(x["c"] * 2)).otherwise(x["c"]))


def _digits(stream, n):
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _pick("0123456789", _byte(stream, i))), "")).otherwise("")


def _octets(entity, stream, more):
    def each(o, i):
        n = _byte(stream, i) * 256 + _byte(stream, i + 8)
        return F.when(more > 0, 1 + F.pmod(n, F.lit(254))).otherwise(F.when(F.length(o) == 1, 1 + F.pmod(n, F.lit(9))).when(F.length(o) == 2, 10 + F.pmod(n, F.lit(90))).otherwise(100 + F.pmod(n, F.lit(155)))).cast("string")

    # all of IPv4 may be dense too: a private IPv6 address then
    private = F.regexp_replace(F.concat(F.lit("fd"), F.substring(stream, 1, 30)), "(.{4})(?=.)", "$1:")
    return F.when(more > ATTEMPTS, private).otherwise(F.array_join(F.transform(F.split(entity, r"\."), each), "."))


def _name(kind, entity, stream, more):
    def made(consonants: str, vowels: str, endings: dict[str, str]):
        size = F.least(F.lit(8), F.greatest(F.lit(2), F.floor(F.length(entity) / 2))).cast("int") + 4 * more
        syllable = lambda i: F.concat(_pick(consonants, _byte(stream, i)), _pick(vowels, _byte(stream, i + 20)))
        gender = F.element_at(F.split(kind, "_"), 2)
        ending = F.when(gender == "m", endings["m"]).when(gender == "f", endings["f"]).otherwise(endings["n"])
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), size), syllable), ""), _pick(consonants, _byte(stream, F.lit(60))), ending)

    return F.when(entity.rlike(r"^\p{IsCyrillic}"), made(*SCRIPTS["cyrillic"])).when(entity.rlike(r"^\p{IsGreek}"), made(*SCRIPTS["greek"])).otherwise(made(*SCRIPTS["latin"]))


def drawn(kind, entity, attempt, key: str):
    """The surrogate of an attempt, in canonical form."""
    stream = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, entity, attempt.cast("string")).cast("binary"), 512)
    more = F.greatest(F.lit(0), attempt - (ATTEMPTS - 1))
    longer = _digits(F.sha2(F.concat(F.lit("longer"), stream).cast("binary"), 512), 8 * more)
    at = F.locate("@", entity)
    domain = F.substring(entity, at + 1, F.lit(1000))
    labels = F.split(domain, r"\.")
    # the name and the domain's first labels change; a domain keeps its last two labels, so that it stays of its type
    head = F.when(F.size(labels) > 2, F.concat(F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 2), "."), F.lit("."))).otherwise("")
    email = F.concat(_like(F.substring(entity, F.lit(1), at - 1), stream), longer, F.lit("@"), _like(head, F.sha2(stream.cast("binary"), 512)), F.array_join(F.slice(labels, -2, 2), "."))
    card = let(F.concat(_like(F.substring(entity, F.lit(1), F.length(entity) - 1), stream), longer), lambda c: F.concat(c, F.when(_luhn_sum(entity, 0) % 10 == 0, F.pmod(-_luhn_sum(c, 1), F.lit(10)).cast("string")).otherwise(_pick("0123456789", _byte(stream, F.lit(40))))))
    # a number of a country keeps its country code, an IBAN its country
    country = F.when(entity.startswith("+"), F.length(F.regexp_extract(entity, COUNTRY, 0))).otherwise(F.greatest(F.lit(0), F.length(entity) - 10))
    phone = F.concat(F.substring(entity, F.lit(1), country), _like(F.substring(entity, country + 1, F.lit(1000)), stream), longer)
    iban = F.concat(F.substring(entity, 1, 2), _like(F.substring(entity, F.lit(3), F.lit(1000)), stream), longer)
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", _octets(entity, stream, more)).when(kind == "phone", phone).when(kind == "iban", iban).when(kind.rlike("^(given|surname)_"), _name(kind, entity, stream, more)).otherwise(F.concat(_like(entity, stream), longer))


def dressed(part, kind, surrogate):
    """The surrogate in the format of a mention: its case, or its separators."""
    first = F.substring(part, 1, 1)
    cased = F.when(part == F.upper(part), F.upper(surrogate)).when(first != F.lower(first), F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.lit(1000)))).otherwise(surrogate)
    # an international number is written with + or 00, as the mention has it, a national one without its country
    written = F.when((kind == "phone") & surrogate.startswith("+"), F.regexp_replace(surrogate, F.when(part.startswith("+") | part.startswith("00"), r"^\+").otherwise(r"^\+1"), F.when(part.startswith("00"), "00").otherwise(""))).otherwise(surrogate)
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    filled = F.aggregate(F.split(part, ""), state, lambda s, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(s["out"], F.substring(written, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: F.concat(s["out"], F.substring(written, s["at"], F.lit(1000))))  # a longer surrogate goes on after the format
    return F.when(kind == "ip", surrogate).when((kind == "email") | kind.rlike("^(given|surname)_"), cased).otherwise(filled)


NAMES = "^(given|surname)_"


MARK, END = "\u0001", "\u0002"


def pieces_of(text):
    """array<string>: what stands before, between and after the mentions on even places, the mentions on odd ones.

    One pass of the pattern puts marks around the mentions; a text that holds a mark itself takes two.
    """
    marked = F.split(F.regexp_replace(text, ANY, f"{MARK}$0{END}"), f"[{MARK}{END}]", -1)
    apart = F.flatten(F.zip_with(F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
    return F.when(text.contains(MARK) | text.contains(END), apart).otherwise(marked)


def mentions(staged: DataFrame) -> DataFrame:
    """(row, i, mention): every mention of the rows (row, pieces), in order."""
    said = F.transform(F.filter("pieces", lambda x, i: i % 2 == 1), lambda x: x)
    return staged.select("row", F.posexplode(said).alias("i", "mention"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) of distinct (kind, entity); no two entities of a kind share one, and none is an entity itself."""
    entities = materialize(entities, "entities")
    # an address without a letter or digit that may change has no other form of its length
    fixed = (F.col("kind") == "email") & F.col("entity").rlike(r"^[^0-9a-z@]+@[^.]+\.[^.]+$")
    left = entities.withColumn("attempt", F.when(fixed, ATTEMPTS).otherwise(0))
    done: DataFrame | None = None
    while True:
        tried = left.withColumn("surrogate", drawn(F.col("kind"), F.col("entity"), F.col("attempt"), key))
        tried = tried.withColumn("turn", F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("entity")))
        taken = entities.select("kind", F.col("entity").alias("surrogate")).withColumn("taken", F.lit(True))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate").withColumn("taken", F.lit(True)))
        tried = materialize(tried.join(taken.distinct(), ["kind", "surrogate"], "left").withColumn("good", (F.col("turn") == 1) & F.col("taken").isNull()), "tried")
        good = tried.filter("good").select("kind", "entity", "surrogate")
        done = good if done is None else done.unionByName(good)
        left = tried.filter("not good").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        if left.isEmpty():
            return done


def base_of(kind):
    """The kind that an entity is told apart by: a given name's gender isn't part of it."""
    return F.regexp_replace(kind, "^given_.$", "given")


def replacements(staged: DataFrame, key: str) -> DataFrame:
    """(row, shown, names): for each row with mentions, what stands in their place, in order, and its names' components.

    shown: array<struct<i, text, entities>>. names: array<struct<name, kind, surrogate>>.
    """
    said = mentions(staged)
    each = materialize(said.select("row", "i", "mention", F.posexplode(parts_of(F.col("mention"))).alias("j", "p")).select("row", "i", "mention", "j", "p.*").withColumn("base", base_of(F.col("kind"))), "mentions")
    # a given name has the gender that its titles agree on, over all documents
    male, female = (F.bool_or(F.col("kind") == f"given_{g}") for g in "mf")
    distinct = each.groupBy("base", "entity").agg(F.min("kind").alias("kind"), male.alias("male"), female.alias("female"))
    gender = F.when(F.col("male") & ~F.col("female"), "given_m").when(F.col("female") & ~F.col("male"), "given_f").otherwise("given_n")
    known = surrogates(distinct.select(F.when(F.col("base") == "given", gender).otherwise(F.col("kind")).alias("kind"), "entity"), key).withColumn("base", base_of(F.col("kind")))
    put = each.drop("kind").join(known, ["base", "entity"]).select("row", "i", "j", "mention", "kind", "entity", "surrogate", dressed(F.col("part"), F.col("kind"), F.col("surrogate")).alias("new"))
    whole = put.groupBy("row", "i", "mention").agg(F.array_sort(F.collect_list(F.struct("j", "kind", "new", "entity", "surrogate"))).alias("parts"))
    title = F.regexp_extract("mention", rf"^((?:{_TITLE})\.? )", 1)
    is_name = F.get("parts", F.lit(0))["kind"].rlike(NAMES)
    text = F.concat(F.when(is_name, title).otherwise(F.lit("")), F.array_join(F.transform("parts", lambda p: p["new"]), " "))
    entities = F.transform("parts", lambda p: F.struct(p["kind"].alias("kind"), p["new"].alias("new")))
    names = F.when(is_name, F.transform("parts", lambda p: F.struct(p["entity"].alias("name"), p["kind"].alias("kind"), p["surrogate"].alias("surrogate"))))
    rows = whole.select("row", F.struct("i", text.alias("text"), entities.alias("entities")).alias("shown"), names.alias("names"))
    return rows.groupBy("row").agg(F.array_sort(F.collect_list("shown")).alias("shown"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


def _later(names, words):
    """array<struct<kind, new>> of words without a title: null where no detected name of the row has the word as a component."""
    def of(word):
        one = F.get(F.filter(names, lambda p: p["name"] == F.lower(word)), F.lit(0))
        return F.when(one.isNotNull(), F.struct(one["kind"].alias("kind"), dressed(word, one["kind"], one["surrogate"]).alias("new")))

    return F.transform(words, of)


_EMPTY = "array<struct<kind:string,new:string>>"


def _untitled(names, between):
    """struct<text, entities>: what stands between mentions, with the row's names replaced there too, and those."""
    words = F.regexp_extract_all(between, F.lit(WORD), F.lit(0))

    def done(w):
        later = w["later"]
        shown = F.zip_with(w["words"], later, lambda x, new: F.coalesce(new["new"], x))
        text = F.array_join(F.zip_with(F.split(between, WORD, -1), shown, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
        return F.struct(text.alias("text"), F.filter(later, lambda x: x.isNotNull()).alias("entities"))

    plain = F.struct(between.alias("text"), F.array().cast(_EMPTY).alias("entities"))
    told = let(words, lambda w: let(F.struct(w.alias("words"), _later(names, w).alias("later")), done))
    return F.when((F.size(names) > 0) & F.exists(names, lambda p: F.contains(F.lower(between), p["name"])), told).otherwise(plain)


def pseudonymize(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The rows with the text's entities replaced, and ``entities``: array<struct<kind, new>>: of the mentions in order,
    and after them of the names that are repeated without a title.

    Texts are searched once; their pieces are written, with a number for each row, so ids need not be unique. Only
    rows with entities are shuffled with their text; the others pass where they are.
    """
    others = [c for c in df.columns if c not in (text_col, "entities")]
    row = F.struct(*others) if others else F.lit(None).cast("string")
    staged = materialize(df.select(row.alias("rest"), pieces_of(F.col(text_col).cast("string")).alias("pieces")).withColumn("row", F.monotonically_increasing_id()), "pieces")
    new = replacements(staged.filter(F.size("pieces") > 1).select("row", "pieces"), key)
    columns = [F.col("rest").getField(c).alias(c) if c != text_col else F.col("text").alias(c) for c in df.columns if c != "entities"]
    plain = staged.filter("pieces is null or size(pieces) <= 1").select("rest", F.get("pieces", F.lit(0)).alias("text"), F.array().cast(_EMPTY).alias("entities"))

    def piece(x, n):
        mention = F.get("shown", (n / 2).cast("int"))
        return F.when(n % 2 == 1, F.struct(mention["text"].alias("text"), mention["entities"].alias("entities"))).otherwise(_untitled(F.col("names"), x))

    hit = staged.filter(F.size("pieces") > 1).join(new, "row").select("rest", F.transform("pieces", piece).alias("told"))
    texts = F.array_join(F.transform("told", lambda x: x["text"]), "")
    of_places = lambda odd: F.flatten(F.transform(F.filter("told", lambda x, n: n % 2 == odd), lambda x: x["entities"]))
    out = plain.unionByName(hit.select("rest", texts.alias("text"), F.concat(of_places(1), of_places(0)).alias("entities"))).select(*columns, "entities")
    return out.withColumn(chars_col, F.length(text_col).cast(df.schema[chars_col].dataType)) if chars_col else out
