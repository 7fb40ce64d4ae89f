"""Surrogates for personal data and secrets, by DataFrame functions only.

One regular expression finds the entities of a text. Each is replaced by a surrogate that depends on a key, its kind and its
canonical form alone, so an entity has the same surrogate wherever it occurs (coreference): digits become digits, letters
become letters of their script and case, separators stay; addresses keep their top-level domain, phone numbers their country
code, numbers with a valid check digit get a valid one, IP octets stay in range. In secrets, other signs are replaced as well.

The entities of a name are its words, so that "Ms. Lopez" and "Maria Lopez" stay one person: titles stay, given names keep
their gender (that of the list if it has the name, else the one that most titles before it in the whole table tell).

The distinct entities of the whole table are checked: where two have one surrogate, or a surrogate is another entity of the
table or itself, all but the first get their next surrogate, until all are distinct. Names grow by a syllable with each such
attempt, other kinds by a digit from the ninth on, so that there is always room. The exceptions, and genders that titles tell,
are joined to the texts by a hash of the text: a list that is meant for another text of that hash does no harm, as a surrogate
holds for the whole table. Texts are shuffled only in that join, where the lists are too many to broadcast.

Patterns are of bounded length or begin where a run of their signs begins, so a text of one long run takes no longer than any other.

Edge cases: a null text stays null and an empty one empty, with no entities; a null doc_id plays no part; repeated rows get equal
texts; texts of any length are read whole; an empty table gives an empty result; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._copies import MOST_IDS
from ._shared import drop, free_name, written

#: Titles by gender.
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Monsieur", "Sir", "Господин", "Κύριος", "السيد"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Mlle", "Госпожа", "Κυρία", "السيدة"],
    "": ["Dr", "Prof"],
}
#: Common given names by gender, from which a person without a title is known.
GIVEN = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Peter", "Hans", "Jürgen", "Klaus", "Jean", "Pierre", "Louis", "José", "Carlos", "Juan", "Miguel", "Antonio", "Иван", "Сергей", "Алексей", "Дмитрий"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Maria", "María", "Ursula", "Sabine", "Monika", "Marie", "Camille", "Sophie", "Claire", "Carmen", "Lucía", "Isabel", "Анна", "Мария", "Ольга", "Елена"],
}
#: Common Chinese surnames.
CHINESE = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕"
#: Syllables from which surrogate names are made, and the endings of given names.
SYLLABLES = ["ba", "be", "bo", "da", "de", "do", "fa", "ga", "go", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to"]
ENDINGS = {"m": ["n", "r", "s", "k"], "f": ["lia", "na", "ra", "ta"], "": ["l", "m", "n", "t"]}
LATIN = "abdefgiklmnoprst"
#: What these letters become in names of other scripts.
SCRIPTS = {"Cyrillic": "абдефгиклмнопрст", "Greek": "αβδεφγικλμνοπρστ", "Arabic": "ابدعفجيكلمنوبرست"}
#: Letters of scripts, and characters of Chinese names, of which surrogates are drawn.
LETTERS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Han": "安白成德方光国海和华建江金俊康兰乐丽林龙美明宁平青荣瑞山世松天文欣雅永玉元云志中",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "Hangul": "가나다라마바사아자차카타파하강김남문민박배서석선성수안양영오우유윤은이임재정조종주지진최한현호홍",
}
#: Signs of which those in secrets are drawn.
SIGNS = "!#$%&*+-./:=?@^_~"
#: The country codes of one and two digits; all others have three.
COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: From this attempt on surrogates get longer.
WIDER = 8

_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join(t for own in TITLES.values() for t in own)
#: Kind and pattern; of two that begin at one place the first counts.
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[\p{L}0-9-]{1,63}\.){1,16}[A-Za-z]{2,63}"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("key", r"(?<![A-Za-z0-9])(?:ghp|gho|sk|pk|xox[abp])[_-][A-Za-z0-9_-]{16,}"),
    ("secret", r"(?<=[=:])(?<=(?:password|passwd|pwd|secret|token|api_key)[=:])[^\s\"',;]{6,}"),
    ("secret", r"(?<=[=:\s])(?<=[=:]\s{0,2})(?<=(?i:password|passwd|pwd|secret|token|api_key)\s{0,2}[=:]\s{0,2})(?=\S{0,255}[0-9])[^\s\"',;]{6,}"),
    ("secret", r"(?<=[\"'])(?<=(?i:password|passwd|pwd|secret|token|api_key)[\"']?\s{0,2}[=:]\s{0,2}[\"'])[^\s\"']{6,}(?=[\"'])"),
    ("secret", r"(?<=Bearer )[A-Za-z0-9._~+/=-]{16,}"),
    ("key", r"(?<![A-Za-z0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("mac", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"),
    ("ip6", r"(?<![\w:])(?=[0-9A-Fa-f:]{6,39}(?![\w:]))(?=[A-Fa-f:]{0,38}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    ("phone", r"(?<![\w+])\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![\w+])\+(?=(?:[ .-]?[0-9]){7,15}(?![0-9]))[0-9]{1,3}(?:[ .-]?[0-9]{1,4}){2,7}(?![0-9])"),
    ("phone", r"(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![\w-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("card", r"(?<![\w])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?!\w)"),
    ("name", rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})?"),
    ("name", rf"(?<!\p{{L}})(?:{'|'.join(n for own in GIVEN.values() for n in own)}) {_NAME}"),
    ("name", r"(?<!\p{L})(?:السيدة|السيد) \p{IsArabic}{2,}(?: \p{IsArabic}{2,})?"),
    ("name", rf"[{CHINESE}]\p{{IsHan}}{{1,2}}(?=先生|女士|小姐)"),
]
FINDER = "|".join(p for _, p in PATTERNS)
#: A text without any of these has no entity; they are cheaper to look for. Each pattern above has a part here that it can't
#: match without: first what needs no digit or sign, then signs of which a text has one, then what is around them.
PLAIN_HINT = "|".join([
    rf"(?=[\p{{Lu}}ا{CHINESE}])(?:(?<!\p{{L}})(?:{_TITLE}|{'|'.join(n for own in GIVEN.values() for n in own)})[. ]|AKIA|ASIA|Bearer |[{CHINESE}]\p{{IsHan}}{{1,2}}(?:先生|女士|小姐))",
    "(?=[gspx])(?:ghp|gho|sk|pk|xox[abp])[_-][A-Za-z0-9_-]{16}|[a-f]{32}",
])
SIGN_HINT = "[0-9@=:+]"
CLOSE_HINT = r"[0-9]{3}|@|[=:]|\+[0-9]|(?:[0-9]{1,3}\.){3}|[0-9a-f]{32}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"


def hinted(text: Column) -> Column:
    """Whether a text may have entities."""
    return text.rlike(PLAIN_HINT) | (text.rlike(SIGN_HINT) & text.rlike(CLOSE_HINT))


def _kind(entity: Column) -> Column:
    """The kind of a found entity; what only its surroundings tell is a name if it has a space, else a secret."""
    out = F.when(entity.contains(" ") | entity.rlike(r"^\p{IsHan}{2,3}$"), "name").otherwise("secret")
    for kind, pattern in reversed(PATTERNS):
        if kind not in ("name", "secret"):
            out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _stream(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that follow from the key and the entity."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canonical, attempt.cast("string"))
    return F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1f")), 512))


def _number(stream: Column, k: Column | int) -> Column:
    """The k-th of the numbers 0 .. 65535 in a stream."""
    at = (F.lit(k) if isinstance(k, int) else k) % 64
    return F.conv(F.substr(stream, at * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _drawn(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _shaped(text: Column, stream: Column, keep: Column | int = 0, signs: bool = False) -> Column:
    """Digits to digits, letters to letters of their script and case, after the first ``keep`` characters; ``signs``: signs to signs."""

    def one(c: Column, k: Column) -> Column:
        n = _number(stream, k)
        out = F.when(k < keep, c).when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), F.char(n % 26 + 97)).when(c.rlike("[A-Z]"), F.char(n % 26 + 65))
        for script, letters in LETTERS.items():
            drawn = _drawn(letters, n)
            out = out.when(c.rlike(rf"\p{{Is{script}}}"), F.when(F.lower(c) != c, F.upper(drawn)).otherwise(drawn))
        out = out.when(c.rlike(r"\p{L}"), F.when(F.lower(c) != c, F.char(n % 26 + 65)).otherwise(F.char(n % 26 + 97)))
        return out.otherwise(_drawn(SIGNS, n) if signs else c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hex(text: Column, stream: Column) -> Column:
    def one(c: Column, k: Column) -> Column:
        digit = F.conv((_number(stream, k) % 16).cast("string"), 10, 16)
        return F.when(c.rlike("[0-9a-f]"), F.lower(digit)).when(c.rlike("[A-F]"), digit).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _check_sum(digits: Column) -> Column:
    """The sum that is divisible by 10 for numbers with a valid last digit."""

    def worth(c: Column, k: Column) -> Column:
        n = c.cast("int") * (1 + k % 2)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, b: a + b)


def _card(text: Column, stream: Column) -> Column:
    made = _shaped(text, stream, keep=1)
    bare = F.regexp_replace(made, "[^0-9]", "")
    body = F.substr(made, F.lit(1), F.length(made) - 1)
    last = (10 - _check_sum(F.concat(F.substr(bare, F.lit(1), F.length(bare) - 1), F.lit("0"))) % 10) % 10
    valid = _check_sum(F.regexp_replace(text, "[^0-9]", "")) % 10 == 0
    return F.when(valid, F.concat(body, last.cast("string"))).otherwise(made)


def _email(key: str, text: Column, stream: Column) -> Column:
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    hosts = F.array(F.struct(host.alias("host"), _stream(key, F.lit("host"), F.lower(host), F.lit(0)).alias("stream")))
    made = F.element_at(F.transform(hosts, lambda h: _shaped(h["host"], h["stream"])), 1)
    return F.concat(_shaped(local, stream), F.lit("@"), made, F.lit("."), top)


def _name_word(word: Column, stream: Column, gender: Column, given: Column, attempt: Column) -> Column:
    """A word of a name: three syllables (one more with each attempt) and an ending; Chinese names character by character."""
    syllable = F.array(*map(F.lit, SYLLABLES))
    pick = lambda values, k: F.element_at(values, _number(stream, k) % F.size(values) + 1)
    ends = F.when(given & (gender == "m"), F.array(*map(F.lit, ENDINGS["m"]))).when(given & (gender == "f"), F.array(*map(F.lit, ENDINGS["f"]))).otherwise(F.array(*map(F.lit, ENDINGS[""])))
    made = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), 3 + attempt), lambda k: pick(syllable, k)), ""), pick(ends, 0))
    for script, letters in SCRIPTS.items():
        made = F.when(word.rlike(rf"\p{{Is{script}}}"), F.translate(made, LATIN, letters)).otherwise(made)
    made = F.when((F.length(word) > 1) & (F.upper(word) == word) & (F.lower(word) != word), F.upper(made)).otherwise(F.initcap(made))
    chinese = F.concat(_shaped(word, stream), F.array_join(F.transform(F.filter(F.sequence(F.lit(0), attempt), lambda k: k > WIDER), lambda k: _drawn(LETTERS["Han"], _number(stream, k + 8))), ""))
    return F.when(word.rlike(r"\p{IsHan}"), chinese).otherwise(made)


def parts(entity: Column, kind: Column) -> Column:
    """Of an entity, structs (kind, text, canonical, told): for a name its words, of which titles have no kind; else itself.

    ``told``: the gender that a title before a given name tells.
    """
    words = F.split(entity, " ")
    titled = F.element_at(words, 1).rlike(rf"^(?:{_TITLE})\.?$")
    told = F.lit("")
    for g in ("m", "f"):
        told = F.when(F.element_at(words, 1).rlike(rf"^(?:{'|'.join(TITLES[g])})\.?$"), g).otherwise(told)

    def word(w: Column, k: Column) -> Column:
        own = F.when((k == 0) & titled, "").when(k == F.size(words) - 1, "surname").otherwise("given")
        return F.struct(own.alias("kind"), w.alias("text"), F.lower(w).alias("canonical"), told.alias("told"))

    whole = F.struct(kind.alias("kind"), entity.alias("text"), canonical(kind, entity).alias("canonical"), F.lit("").alias("told"))
    return F.when(kind == "name", F.transform(words, word)).otherwise(F.array(whole))


def listed_gender(name: Column) -> Column:
    """The gender of a given name in lower case, if the list has it."""
    return F.when(name.isin([n.lower() for n in GIVEN["m"]]), "m").when(name.isin([n.lower() for n in GIVEN["f"]]), "f").otherwise("")


def canonical(kind: Column, entity: Column) -> Column:
    """The form in which two mentions of one entity agree: without separators in numbers, case in addresses and names."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind.isin("email", "mac", "ip6", "surname", "given"), F.lower(entity))
        .otherwise(entity)
    )


def _prepared(key: str, part: Column, attempt: Column, gender: Column) -> Column:
    """What surrogate() takes, computed once."""
    stream = _stream(key, part["kind"], part["canonical"], attempt)
    return F.struct(part["kind"].alias("kind"), part["text"].alias("text"), attempt.alias("attempt"), gender.alias("gender"), stream.alias("stream"))


def surrogate(key: str, p: Column) -> Column:
    """The surrogate of a prepared part; a title is its own."""
    kind, text, attempt, stream = p["kind"], p["text"], p["attempt"], p["stream"]
    octets = F.transform(F.split(text, r"\."), lambda c, k: (1 + _number(stream, k) % 254).cast("string"))
    made = (
        F.when(kind == "email", _email(key, text, stream))
        .when(kind.isin("phone", "ssn"), _digits_only(text, stream))
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", _card(text, stream))
        .when(kind.isin("mac", "ip6") | ((kind == "key") & text.rlike("^[0-9a-f]+$")), _hex(text, stream))
        .when(kind == "secret", _shaped(text, stream, signs=True))
        .otherwise(_shaped(text, stream, keep=F.when(kind == "iban", 2).otherwise(4)))
    )
    wider = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), attempt), lambda k: k > WIDER), lambda k: (_number(stream, k + 8) % 10).cast("string")), "")
    name = _name_word(text, stream, p["gender"], kind == "given", attempt)
    return F.when(kind == "", text).when(kind.isin("surname", "given"), name).otherwise(F.concat(made, wider))


def _digits_only(text: Column, stream: Column) -> Column:
    """Digits by their rank among the digits, so that mentions with other separators agree; a country code stays."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    short = F.length(F.regexp_extract(digits, COUNTRY, 0))
    code = F.when(text.startswith("+"), F.when(short > 0, short).otherwise(3)).otherwise(0)
    made = _shaped(digits, stream, keep=code)
    ranks = F.transform(F.split(text, ""), lambda c, k: F.length(F.regexp_replace(F.substr(text, F.lit(1), k + 1), "[^0-9]", "")))
    return F.array_join(F.zip_with(F.split(text, ""), ranks, lambda c, r: F.when(c.rlike("[0-9]"), F.substr(made, r, F.lit(1))).otherwise(c)), "")


def mentions(docs: DataFrame) -> DataFrame:
    """text_hash, kind, text, canonical, told: the parts of the distinct entities of each text, but for titles."""
    found = docs.where(hinted(F.col("text"))).select(F.xxhash64("text").alias("text_hash"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FINDER), 0))).alias("entity"))
    split = found.select("text_hash", F.explode(parts(F.col("entity"), _kind(F.col("entity")))).alias("p"))
    return split.select("text_hash", "p.*").where("kind <> ''")


def entities(found: DataFrame) -> DataFrame:
    """kind, canonical, text, gender: the distinct entities of ``mentions``; of several forms of one, the first in order stands."""
    one = found.groupBy("kind", "canonical").agg(F.min("text").alias("text"), F.count_if(F.col("told") == "m").alias("m"), F.count_if(F.col("told") == "f").alias("f"))
    listed = listed_gender(F.col("canonical"))
    told = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > 0, "f").otherwise("")
    return one.select("kind", "canonical", "text", F.when(F.col("kind") == "given", F.when(listed != "", listed).otherwise(told)).otherwise("").alias("gender"))


def attempts(found: DataFrame, key: str) -> DataFrame:
    """kind, canonical, attempt, gender of all entities, such that their surrogates are distinct.

    ``found`` is read again in each round, so it should be a written table. Each round settles all but a few of the rest.
    """
    number = written(found.withColumn("attempt", F.lit(0)))
    while True:
        part = F.struct("kind", "text", "canonical")
        prepared = number.withColumn("p", _prepared(key, part, F.col("attempt"), F.col("gender")))
        made = written(prepared.select("kind", "canonical", canonical(F.col("kind"), surrogate(key, F.col("p"))).alias("made")))
        first = made.groupBy("kind", "made").agg(F.min("canonical").alias("first"), F.count("*").alias("n")).where("n > 1")
        shared = made.join(first, ["kind", "made"]).where("canonical <> first").select("kind", "canonical")
        real = made.join(found.select("kind", F.col("canonical").alias("made")), ["kind", "made"], "left_semi").select("kind", "canonical")
        again = written(shared.union(real).distinct().withColumn("again", F.lit(1)))
        drop(made)
        if again.isEmpty():
            drop(again)
            return number.select("kind", "canonical", "attempt", "gender")
        next_number = written(number.join(again, ["kind", "canonical"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again"))
        drop(number, again)
        number = next_number


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and two columns more: n_entities and entity_kinds (sorted, comma-joined).

    Columns of ``docs`` with these two names are replaced.
    """
    found = written(mentions(docs))
    named = written(entities(found))
    told = (F.col("gender") != "") & (listed_gender(F.col("canonical")) == "")
    exceptions = written(attempts(named, key).where((F.col("attempt") > 0) | told))
    entry = F.concat_ws("\x1f", "kind", "canonical")
    own = found.join(exceptions, ["kind", "canonical"]).groupBy("text_hash").agg(F.collect_set(F.struct(entry.alias("k"), F.struct("attempt", "gender").alias("v"))).alias("own"))
    hashed, taken, at = (free_name(docs, stem) for stem in ("own_hash", "own_exceptions", "own_entities"))
    lists = written(own.select(F.col("text_hash").alias(hashed), F.map_from_entries("own").alias(taken)))
    few = (lists.select(F.sum(F.size(taken))).first()[0] or 0) * 8 <= MOST_IDS
    rows = docs.withColumn(hashed, F.xxhash64("text")).join(F.broadcast(lists) if few else lists, hashed, "left")
    entity = F.when(hinted(F.col("text")), F.regexp_extract_all("text", F.lit(FINDER), 0)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn(at, F.transform(entity, lambda e: F.struct(e.alias("entity"), _kind(e).alias("kind"))))

    def prepare(part: Column) -> Column:
        known = F.element_at(F.col(taken), F.concat_ws("\x1f", part["kind"], part["canonical"]))
        return _prepared(key, part, F.coalesce(known["attempt"], F.lit(0)), F.coalesce(known["gender"], listed_gender(part["canonical"])))

    made = F.transform(F.transform(at, lambda e: F.transform(parts(e["entity"], e["kind"]), prepare)), lambda own: F.array_join(F.transform(own, lambda p: surrogate(key, p)), " "))
    pieces = F.zip_with(F.split("text", FINDER, -1), made, lambda between, new: F.concat(between, F.coalesce(new, F.lit(""))))
    text = F.when(F.size(at) > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(at, lambda e: e["kind"]))), ",")
    out = rows.withColumns({"text": text, "n_entities": F.size(at).cast("long"), "entity_kinds": kinds}).drop(hashed, taken, at)
    return out.select(*docs.columns, *(c for c in ("n_entities", "entity_kinds") if c not in docs.columns))
