"""Surrogate generation for personal data, in DataFrame functions only.

One pattern finds e-mail addresses, payment cards, social-security-like numbers, phone
numbers, IP addresses, IBANs, person names after a title or a phrase that names someone, and
credentials. Each distinct entity gets one surrogate, drawn from a keyed hash of its kind
and canonical form, so the same entity has the same surrogate everywhere (coreference),
however it is punctuated. A surrogate keeps the kind's format: letters stay letters of their
case, digits digits, punctuation stays; a card keeps its issuer digit and a right check
digit; a phone number its first digit; an address's parts stay in range. Sixteen digits
without a right check digit are no card and stay.

Names are replaced word by word: the last word is the surname, the words before it given
names of the title's gender. So `Mr John Smith` and `Mr Smith` keep one surname, and where
a text names someone once with a title, the same words without it follow. Titles, initials
and script stay; given names end by gender, surnames alike.

Collision checks keep distinct entities distinct: a candidate that another entity drew
first, that already stands for one, or that is itself an entity of the corpus is drawn
again with the next attempt, until none is left. Every GROW attempts surrogates get
longer, a name by a syllable a word and others by a character, so drawing always ends,
though a format may have fewer surrogates than the corpus has entities.

Texts are cut at the pattern's matches and joined again with the surrogates, so a
replacement never meets another one. The pattern runs once over each row; texts travel in
no shuffle but those that hold entities, once for each distinct text.

Edge cases: null and empty texts stay as they are; repeated rows get the same text; other
columns pass through unchanged, whatever their names; order of rows is not kept. Texts
are read whole. Names without any title or phrase in their text are not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise

#: Patterns by kind, the more specific first.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
_TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
#: Titles without gender; a name with these alone counts with the male ones.
_TITLES_N = ("Dr", "Prof", "Professor", "Doctor", "Docteur", "Доктор", "Профессор")
_TITLES = rf"(?:(?:{'|'.join(_TITLES_F + _TITLES_M + _TITLES_N)})\.? )+"
#: Phrases before a name of two words or three.
_CUES = r"(?:(?i:my name is|name is|name:|signed:|attn:|contact:|dear|mein Name ist|ich heiße|je m'appelle|mi nombre es|me llamo|меня зовут) )"
_NAME = r"(?:\p{Lu}\. ?)*\p{Lu}\p{Ll}+"
#: Phone numbers of 8 to 15 digits: in the groups of North America; with + and groups of any width; with a leading 0 and at
#: least one separator, unless it is a date; and the national forms in pairs of Spain and Russia.
_ALONE, _END = r"(?<![\d+])(?<!\d[.,\-/])", r"(?!\d)(?![.,\-/]\d)"
_DATE = r"\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}(?!\d)(?![ .\-/]\d{2}(?!\d))"
_PHONES = (
    r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]?\d{3,4}(?!\d)",
    r"(?<!\d)\+\d{1,3}[ .\-]?(?:\(0\)[ ]?)?\d{1,3}(?:[ .\-]\d{2}){3,4}(?!\d)",
    r"(?<!\d)\+\d(?:[ .\-/]?[()]?[ ]?\d){7,14}(?!\d)",
    rf"{_ALONE}(?!{_DATE})0[1-9](?:[ .\-]\d{{2}}){{4}}(?!\d)",
    rf"{_ALONE}(?!{_DATE})(?!\d+(?!\d|[ .\-/)]{{1,2}}\d))\(?0[1-9](?:[ .\-/]?\)?[ ]?\d){{6,13}}{_END}",
    rf"{_ALONE}[6-9]\d{{2}}(?:[ .\-]\d{{2}}){{3}}{_END}",
    rf"{_ALONE}(?:8[ \-]?)?\(\d{{3,4}}\)[ \-]?\d{{2,3}}(?:[ \-]\d{{2}}){{2}}{_END}",
    rf"{_ALONE}8[ \-]\d{{3}}[ \-]\d{{3}}(?:[ \-]\d{{2}}){{2}}{_END}",
)
_START, _STOP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_SECRET = r"(?i:token|secret|api_key|password|passwd|pwd)\s{0,3}[=:]\s{0,3}[\"']?"
_SSN = r"(?i:ssn|social security(?: number| no\.?)?)[ :#=]{1,3}"
_GROUP = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "key_id": rf"{_START}AKIA[0-9A-Z]{{16}}{_STOP}",
    "token": rf"{_START}(?i:token|secret|api_key)\s{{0,3}}[=:]\s{{0,3}}[\"']?[A-Za-z0-9_\-]{{16,}}",
    "password": rf"{_START}(?i:password|passwd|pwd)\s{{0,3}}[=:]\s{{0,3}}[\"']?[A-Za-z0-9_\-]{{6,}}",
    "plain_id": rf"{_START}{_SSN}\d{{9}}(?!\d)",
    "iban": rf"{_START}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_STOP}",
    "name": rf"{_START}(?:{_TITLES}{_NAME}(?:[ \-]{_NAME}){{0,2}}|{_CUES}(?!{_TITLES}){_NAME}(?:[ \-]{_NAME}){{1,2}}){_STOP}",
    "ipv6": rf"(?<![0-9A-Fa-f:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![0-9A-Fa-f:])",
    "card": r"(?<![\d])(?:\d{4}[ \-]?){3}\d{1,7}(?!\d)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "national_id": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": "|".join(_PHONES),
}
_HINT = rf"[0-9@]|(?=[TtSsAaPpMmFDCcNnIiJjГДПм])(?<![\p{{L}}\p{{N}}_])(?:(?i:token|secret|api_key|passw|pwd)|{_TITLES}|{_CUES})"
#: The kinds that begin with a letter are tried only where one stands, the others only at digits and what may precede them.
_LETTERS, _DIGITS = ("email", "key_id", "token", "password", "plain_id", "iban", "name"), ("ipv6", "card", "ip", "national_id", "phone")
_ALL = "(?=[\\p{L}0-9])(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in _LETTERS) + ")|(?=[0-9A-Fa-f+(])(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in _DIGITS) + ")"
#: Syllables of surrogate names; endings of given names, female, male and unknown, and of surnames, for each script.
_NAMES = {
    "latin": (("ba", "ri", "lo", "ne", "ka", "mi", "to", "su", "ve", "da", "fe", "no", "ra", "pi", "ga", "le"), {"given_f": "na", "given_m": "rd", "given": "lin", "surname": "sen"}),
    "cyrillic": (("ба", "ри", "ло", "не", "ка", "ми", "то", "су", "ве", "да", "фе", "но", "ра", "пи", "га", "ле"), {"given_f": "на", "given_m": "в", "given": "ли", "surname": "ко"}),
}
DEFAULT_KEY = "plumbline-surrogates-1"
#: Attempts after which surrogates get longer.
GROW = 4


def _kind(match: Column) -> Column:
    """The kind of a match that is no name, or null for one that is left alone."""
    out = F.lit("phone")
    for kind in ("national_id", "ip", "ipv6", "iban", "key_id", "email"):
        out = F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    card = match.rlike(f"^(?:{PATTERNS['card']})$")
    right = F.call_function("luhn_check", F.regexp_replace(match, "[^0-9]", ""))
    out = F.when(card & right, "card").when(card, F.lit(None)).otherwise(out)
    return F.when(match.rlike(f"^{_SECRET}"), "credential").when(match.rlike(f"^{_SSN}"), "national_id").otherwise(out)


def _canonical(kind: Column, core: Column) -> Column:
    return (
        F.when(kind.isin("phone", "card", "national_id"), F.regexp_replace(core, r"[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(core, " ", ""))
        .when(kind.isin("email", "ipv6"), F.lower(core))
        .otherwise(core)
    )


def parts(match: Column) -> Column:
    """The pieces of a match, one after the other: prefix that stays, core, kind (null: stays) and canonical form."""
    is_name = match.rlike(f"^(?:{_TITLES}|{_CUES})\\p{{Lu}}")
    prefix = F.regexp_extract(match, f"^(?:{_SECRET}|{_SSN})", 0)
    core = F.substring(match, F.length(prefix) + 1, F.length(match))
    kind = _kind(match)
    single = F.array(F.struct(prefix.alias("prefix"), core.alias("core"), kind.alias("kind"), _canonical(kind, core).alias("canonical")))
    neutral = rf"^(?:(?:{'|'.join(_TITLES_N)})\.? )*"
    given = F.when(match.rlike(rf"{neutral}(?:{'|'.join(_TITLES_F)})\b"), "given_f").when(match.rlike(rf"{neutral}(?:{'|'.join(_TITLES_M)})\b"), "given_m").otherwise("given")
    words = F.regexp_extract_all(match, F.lit(rf"(?:^(?:{_TITLES}|{_CUES}))?[ \-]?{_NAME}"), F.lit(0))

    def word(piece: Column, k: Column) -> Column:
        own = F.regexp_extract(piece, r"\p{Lu}\p{Ll}+$", 0)
        before = F.substring(piece, F.lit(1), F.length(piece) - F.length(own))
        return F.struct(before.alias("prefix"), own.alias("core"), F.when(k == F.size(words) - 1, "surname").otherwise(given).alias("kind"), own.alias("canonical"))

    return F.when(is_name, F.transform(words, word)).otherwise(single)


def _byte(digest: Column, k: Column) -> Column:
    """The k-th byte, from 0, of a digest of 64 bytes in hexadecimal; bytes repeat beyond."""
    return F.conv(F.substring(digest, k % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _redrawn(text: Column, digest: Column, keep: int = 0) -> Column:
    """text with each letter and digit but the first `keep` drawn anew within its class."""
    hexadecimal = text.rlike(r"^(?:[0-9a-f:]+|[0-9A-F:]+)$")

    def draw(k: Column) -> Column:
        c, b = F.substring(text, k + 1, F.lit(1)), _byte(digest, k)
        letter = F.when(hexadecimal, b % 6).otherwise(b % 26)
        return (
            F.when(k < keep, c)
            .when(c.between("0", "9"), (b % 10).cast("string"))
            .when(c.between("a", "z"), F.char(letter + 97))
            .when(c.between("A", "Z"), F.char(letter + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), draw), "")


def _checked(digits: Column) -> Column:
    """digits with the last one set so that the Luhn sum is a multiple of ten."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(body, F.length(body) - k, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add)
    return F.concat(body, ((F.lit(10) - total % 10) % 10).cast("string"))


def _renamed(kind: Column, canonical: Column, digest: Column, syllables_a_word: int = 2) -> Column:
    """A name word in the same script, with the ending of its kind."""

    def script(name: str) -> Column:
        syllables, endings = _NAMES[name]
        bank = F.array(*map(F.lit, syllables))
        end = F.coalesce(*(F.when(kind == k, v) for k, v in endings.items()))
        return F.initcap(F.concat(*(F.element_at(bank, _byte(digest, F.lit(j)) % len(syllables) + 1) for j in range(syllables_a_word)), end))

    return F.when(canonical.rlike(r"\p{IsCyrillic}"), script("cyrillic")).otherwise(script("latin"))


def _candidate(key: str, attempt: int) -> Column:
    kind, canonical = F.col("kind"), F.col("canonical")
    digest = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(str(attempt)), kind, canonical).cast("binary"), 512)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (_byte(digest, k * 2) * 256 + _byte(digest, k * 2 + 1)) % 254 + 1), ".")
    domain = F.regexp_extract(canonical, r"\.[a-z]{2,}$", 0)
    stem = F.substring(canonical, F.lit(1), F.length(canonical) - F.length(domain))
    more = attempt // GROW
    letters, digits = F.lit("a" + "x" * (more - 1) if more else ""), F.lit("0" * more)
    return (
        F.when(kind == "ip", octets)
        .when(kind == "card", _checked(_redrawn(canonical, digest, 1)))
        .when(kind == "phone", _redrawn(F.concat(canonical, digits), digest, 1))
        .when(kind == "email", F.concat(_redrawn(F.concat(letters, stem), digest), domain))
        .when(kind == "iban", _redrawn(canonical, digest, 2))
        .when(kind == "key_id", _redrawn(canonical, digest, 4))
        .when(kind.isin("given", "given_f", "given_m", "surname"), _renamed(kind, canonical, digest, 2 + more))
        .when(kind == "credential", _redrawn(F.concat(canonical, letters), digest))
        .otherwise(_redrawn(canonical, digest))
    )


def assign(entities: DataFrame, key: str = DEFAULT_KEY, draw=_candidate) -> DataFrame:
    """kind, canonical and a surrogate for each row of entities(kind, canonical), distinct within a kind.

    What is drawn is dealt over as many tasks as shuffles have, however few bytes it is.
    """
    spark = entities.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entities = materialise(entities.distinct().repartition(tasks, "kind", "canonical"), "entities")
    names = entities.select("kind", F.col("canonical").alias("surrogate"))
    waiting, done, attempt = entities, None, 0
    while True:
        drawn = waiting.repartition(tasks, "kind", "canonical").withColumn("surrogate", draw(key, attempt)).join(names, ["kind", "surrogate"], "left_anti")
        if done is not None:
            drawn = drawn.join(done, ["kind", "surrogate"], "left_anti")
        got = materialise(drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")), "surrogates")
        done = got if done is None else done.union(got)
        old, waiting = waiting, materialise(waiting.join(got, ["kind", "canonical"], "left_anti"), "waiting")
        discard(old if attempt else None)
        if waiting.isEmpty():
            discard(entities, waiting)
            return done
        attempt += 1


def _placed(match: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the punctuation and case of this occurrence."""
    chars = F.transform(F.sequence(F.lit(1), F.length(match)), lambda k: F.substring(match, k, F.lit(1)))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, c: Column) -> Column:
        filled = (kind == "ipv6") | c.rlike("[A-Za-z0-9]")
        new = F.substring(surrogate, state["at"], F.lit(1))
        new = F.when(c.between("A", "Z"), F.upper(new)).otherwise(new)
        return F.struct(F.concat(state["out"], F.when(filled, new).otherwise(c)).alias("out"), F.when(filled, state["at"] + 1).otherwise(state["at"]).alias("at"))

    def whole(state: Column) -> Column:
        """What was placed, and after it what is longer than the match."""
        return F.concat(state["out"], F.substring(surrogate, state["at"], F.length(surrogate)))

    spread = F.aggregate(chars, start, step, whole)
    upper = F.aggregate(chars, start, lambda s, c: F.struct(F.concat(s["out"], F.when(c.between("A", "Z"), F.upper(F.substring(surrogate, s["at"], F.lit(1)))).otherwise(F.substring(surrogate, s["at"], F.lit(1)))).alias("out"), (s["at"] + 1).alias("at")), whole)
    return F.when(kind.isin("phone", "card", "national_id", "iban", "ipv6"), spread).when(kind == "email", upper).otherwise(surrogate)


def surrogates(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY, count: str | None = None) -> DataFrame:
    """docs with every entity of the text column replaced; `count` names an added column with their number."""
    columns = docs.columns
    hinted = F.coalesce(F.col(text).rlike(_HINT), F.lit(False))
    matches = F.when(hinted, F.regexp_extract_all(F.col(text), F.lit(_ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = materialise(docs.withColumn("__matches", matches), "marked")
    clean = marked.where(F.size("__matches") == 0).select(*columns, *([F.lit(0).alias(count)] if count else []))
    private = marked.where(F.size("__matches") > 0).withColumn("__digest", F.md5(F.col(text).cast("binary")))

    found = private.groupBy("__digest").agg(F.first("__matches").alias("m")).select("__digest", F.posexplode("m").alias("pos", "match"))
    found = materialise(found.select("__digest", "pos", F.posexplode(parts(F.col("match"))).alias("sub", "x")).select("__digest", "pos", "sub", "x.*"), "found")
    table = assign(found.where("kind is not null").select("kind", "canonical"), key)
    new = F.coalesce(_placed(F.col("core"), F.col("kind"), F.col("surrogate")), F.col("core"))
    replaced = found.join(table, ["kind", "canonical"], "left").withColumn("new", new)
    named = F.when(F.col("kind").isin("given", "given_f", "given_m", "surname"), F.struct(F.col("core").alias("word"), "new"))
    lists = replaced.groupBy("__digest").agg(
        F.array_sort(F.collect_list(F.struct("pos", "sub", F.concat("prefix", "new").alias("new")))).alias("__new"),
        F.array_sort(F.collect_set(named)).alias("__names"), F.count(F.when(F.col("sub") == 0, F.col("kind"))).cast("int").alias("__count"),
    )
    joined = private.join(lists, "__digest").withColumn("__gaps", F.split(F.col(text), _ALL, -1))

    def renamed(gap: Column) -> Column:
        return F.aggregate("__names", gap, lambda out, x: F.regexp_replace(out, F.concat(F.lit(_START), x["word"], F.lit(_STOP)), x["new"]))

    gaps = F.when(F.size("__names") > 0, F.transform("__gaps", renamed)).otherwise(F.col("__gaps"))
    joined = joined.withColumn("__gaps", gaps)
    pieces = F.transform("__new", lambda x: F.concat(F.when(x["sub"] == 0, F.element_at("__gaps", x["pos"] + 1)).otherwise(""), x["new"]))
    whole = F.concat(F.array_join(pieces, ""), F.element_at("__gaps", -1))
    done = joined.withColumn(text, whole).select(*columns, *([F.col("__count").alias(count)] if count else []))
    return clean.unionByName(done)
