"""Text operators as columns: folding, vocabulary tests, words, sentences, topics, language.

All are built-in expressions, so they stay inside generated code. Null texts give null,
or false for tests, unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .constants import listed, looked_up, one_of


def composed(text: Column) -> Column:
    """Canonical composition (NFC), by the Unicode library that Spark carries; texts without any character that it may change stay untouched.

    Spark takes a call of a static method as not deterministic, so it is for a column of its own, not for join conditions.
    """
    called = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False))
    return F.when(text.rlike(V.MAY_COMPOSE), called).otherwise(text)


#: Ranges that hold every character of ZERO_WIDTH, LIGATURES and PUNCTUATION; a class of single characters is tested one by one.
_FOLDED = r"[\u00ad\u2000-\u22ff\ufb00-\ufeff]"


#: What normalisation may change besides case, but for blanks: all that is neither printable ASCII nor a Latin letter or sign that it leaves alone.
_UNPLAIN = r"[^ -~\u00a1-\u00ac\u00ae-\u00de\u00e0-\u024f]"


def normalize(text: Column, fold_case: bool = True) -> Column:
    """Folds ligatures, typographic marks and white space, joins words broken at line ends; digits stay. Null becomes empty."""
    given = F.coalesce(text, F.lit(""))
    blanks = F.startswith(given, F.lit(" ")) | F.endswith(given, F.lit(" ")) | F.contains(given, F.lit("  "))
    return F.when(blanks | (given.rlike("[^ -~]") & given.rlike(_UNPLAIN)), _normalized(given, fold_case)).otherwise(F.lower(given) if fold_case else given)


def _normalized(given: Column, fold_case: bool) -> Column:
    """normalize() of any text."""
    out = F.translate(given, V.ZERO_WIDTH, "")
    for old, new in {**V.LIGATURES, **{k: v for k, v in V.PUNCTUATION.items() if len(v) > 1}}.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    single = {k: v for k, v in V.PUNCTUATION.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    out = F.when(given.rlike(_FOLDED), out).otherwise(given)  # most texts hold none of these
    out = F.regexp_replace(out, r"(?<=\p{L})-[ \t]*[\r\n]+[ \t]*(?=\p{L})", "")
    out = squash(out)
    return F.replace(F.lower(out), F.lit("ß"), F.lit("ss")) if fold_case else out


def shape(text: Column) -> Column:
    """The text with every figure written in noughts. Whatever asks only where digits are finds the same in a text and in its shape."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[1-9]", "0")


def lowered(text: Column) -> Column:
    """Lower case, letter by letter: of the letters beyond ASCII, two become ASCII ones."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u212a"), F.lit("k")))


def squash(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed. A blank that stands alone is left as it is."""
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def has_quotation(text: Column) -> Column:
    """Whether the normalised text holds a quotation mark, as seen in the text itself."""
    marks = "".join(["\"", "'", *[k for k, v in V.PUNCTUATION.items() if "\"" in v or "'" in v]])
    return F.coalesce(text.rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in marks) + "]"), F.lit(False))


def is_blank(text: Column) -> Column:
    return F.coalesce(squash(text), F.lit("")) == ""


def any_literal(phrases: Sequence[str]) -> str:
    """A pattern of the phrases with common beginnings written once, so that a place is given up at its first wrong character. Of phrases that begin each other the longer is tried first."""
    rest: dict[str, list[str]] = {}
    for p in sorted(set(phrases)):
        rest.setdefault(p[:1], []).append(p[1:])
    ends = "" in rest
    branches = [re.escape(c).replace(r"\ ", " ") + any_literal(tails) for c, tails in rest.items() if c]
    if not branches:
        return ""
    body = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
    return body + ("?" if ends else "")


def pattern_of(phrases: Sequence[str]) -> str:
    """Any of the phrases with no letter or digit on either side, longest first."""
    kept = sorted({p.strip() for p in phrases})
    first = "".join(sorted({re.escape(p[0]) for p in kept}))
    return rf"(?i)(?=[{first}])(?<![a-z0-9])(?:{any_literal(kept)})(?![a-z0-9])"


def has_any(text: Column, phrases: Sequence[str]) -> Column:
    return F.coalesce(text.rlike(pattern_of(phrases)), F.lit(False))


def heads(phrases: Sequence[str]) -> list[str]:
    """The longest word of each phrase; a text without any of them has none of the phrases."""
    return sorted({max(re.findall("[a-z]+", p), key=len) for p in phrases})


def found_words(low: Column, known: Sequence[str]) -> Column:
    """Those of some words that a lower-case text has, at each place, in one pass."""
    return F.regexp_extract_all(low, F.lit(rf"(?<![a-z])(?:{any_literal(known)})(?![a-z])"), F.lit(0))


def modality(text: Column) -> Column:
    """prohibition, obligation, permission or none; the first that holds."""
    return F.when(has_any(text, V.PROHIBITIONS), "prohibition").when(has_any(text, V.OBLIGATIONS), "obligation").when(has_any(text, V.PERMISSIONS), "permission").otherwise("none")


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def content_words(text: Column) -> Column:
    """Distinct words of three letters or more that are no stopwords."""
    return F.array_except(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)), listed(V.STOPWORDS))


def negation_count(text: Column) -> Column:
    return F.size(F.filter(words(text), lambda w: one_of(w, V.NEGATIONS)))


def is_negative(text: Column) -> Column:
    return (negation_count(text) > 0) | has_any(text, V.PROHIBITIONS)


def is_conditional(text: Column) -> Column:
    return has_any(text, V.CONDITIONS)


#: A cross-reference. Words end where no ASCII letter, digit or underscore follows, and blanks are those of the SQL: Java takes accented letters for parts of a word, and a vertical tab for a blank.
CROSS_REFERENCE = "(?i)" + V.CROSS_REFERENCE.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))").replace(r"\s", r"[\t\n\f\r ]")


def cross_references(text: Column) -> Column:
    return F.coalesce(text.rlike(CROSS_REFERENCE), F.lit(False))


def overlap(claim: Column, context: Column) -> Column:
    """The share of the claim's content words that the context has; 0 for a claim without any."""
    return overlap_of(content_words(claim), content_words(context))


def overlap_of(own: Column, other: Column) -> Column:
    """The share of some content words that are among others; 0 without any."""
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, other)) / F.size(own)).otherwise(F.lit(0.0))


#: What stands between any two sentences.
SENTENCE_ENDS = r"(?U)[!?.]\s"


def sentences(text: Column) -> Column:
    """Sentences: ended by ! or ?, or by a dot that follows neither a known abbreviation nor a single letter, before white space."""
    short = "|".join(sorted(V.ABBREVIATIONS, key=lambda a: (-len(a), a)))
    boundary = rf"(?Ui)(?<=[!?])\s+|(?<=\.)(?<!(?<![\p{{L}}\p{{N}}])(?:{short}|\p{{L}})\.)\s+"
    given = F.coalesce(text, F.lit(""))
    cut = F.when(given.rlike(SENTENCE_ENDS), F.split(given, boundary)).otherwise(F.array(given))  # a split compiles its pattern for every text
    return F.filter(F.transform(cut, squash_ends), lambda s: s != "")


def squash_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def claims(text: Column) -> Column:
    """Sentences of three words or more."""
    return long_enough(sentences(text))


def long_enough(found: Column) -> Column:
    """Those of some sentences that have three words or more."""
    return F.filter(found, lambda s: F.lower(s).rlike("[a-z][^a-z]+[a-z]+[^a-z]+[a-z]"))


def numerals(text: Column) -> Column:
    """Distinct figures, without their commas."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))


def topic(label: Column) -> Column:
    """Topic of a finding's label: by phrase, else by its first known word, else other."""
    found = F.array_join(words(F.substring(label, 1, 64)), " ")
    out = F.lit(None).cast("string")
    for phrase, name in reversed(V.TOPIC_PHRASES):
        out = F.when(F.concat(F.lit(" "), found, F.lit(" ")).contains(f" {phrase} "), name).otherwise(out)
    table = looked_up({key: name for name, keys in V.TOPICS.items() for key in keys})
    first = F.get(F.filter(F.transform(F.split(found, " "), lambda w: F.try_element_at(table, w)), lambda t: t.isNotNull()), F.lit(0))
    return F.coalesce(out, first, F.lit("other"))


def letter_counts(text: Column) -> dict[str, Column]:
    """Letters of the Tamil block, of Latin script, and of all scripts."""
    t = F.coalesce(text, F.lit(""))
    tamil = F.regexp_count(t, F.lit(r"[஀-௿&&\p{L}]"))
    latin = F.regexp_count(t, F.lit(r"[a-zA-ZÀ-ɏ&&\p{L}]"))
    return {"tamil": tamil, "latin": latin, "letters": F.regexp_count(t, F.lit(r"\p{L}"))}


def script_of(tamil: Column, latin: Column, letters: Column) -> Column:
    """en (Latin), ta, mixed or other, from letter counts."""
    t, n = tamil / letters, latin / letters
    return F.when(letters == 0, "other").when(t >= 0.8, "ta").when(n >= 0.8, "en").when((t >= 0.05) & (n >= 0.05), "mixed").otherwise("other")


def looks_like_injection(text: Column) -> Column:
    """Whether a passage holds a phrase that addresses an assistant, or opens with a command and names no contract role.

    Clauses by which a contract supersedes earlier agreements use the same verbs and are masked first.
    """
    verbs = r"(?:ignor(?:e|es|ing)|disregard(?:s|ing)?|supersed(?:e|es|ing))"
    settled = rf"(?i)\b{verbs}\s+(?:any\s+|all\s+)?(?:previous|prior|preceding|earlier|other)\s+(?:\w+\s+){{0,2}}(?:{'|'.join(V.SETTLED_WORDS)})s?\b"
    lead = rf"(?i)^[\s\"'(\[]*(?:(?:do|don|never|always|please)[^a-z]+)?(?:{'|'.join(V.COMMANDS)})(?![a-z])"
    roles = has_any(F.regexp_replace(text, r"(?i)\bthird[\s-]+part(?:y|ies)\b", " "), V.ROLES)
    return has_any(F.regexp_replace(text, settled, " "), V.INJECTIONS) | (F.coalesce(text.rlike(lead), F.lit(False)) & ~roles)


def reports_speech(context: Column, quote: Column) -> Column:
    """Whether the quote stands after a reporting verb and an opening quotation mark; the closing one may be missing."""
    folded, own = normalize(context), normalize(quote)
    said = F.regexp_extract(folded, rf"(?s)\b(?:{'|'.join(V.REPORTING)})\b[^\"]{{0,80}}(\".*)$", 1)
    # Spark works out what both sides of an `and` share for every row, but not what stands in a branch
    return F.when(has_quotation(context), (own != "") & (said != "") & F.contains(said, own)).otherwise(False)


def safe_type(label: Column) -> Column:
    """A label fit to show: squashed, 40 characters at most, no instruction; else `clause`."""
    out = squash(F.coalesce(label, F.lit("")))
    return F.when((out == "") | (F.length(out) > 40) | looks_like_injection(out), "clause").otherwise(out)


def confirmed_section(section: Column, page: Column) -> Column:
    """The section label if the page has it whole, else null."""
    return F.when(~is_blank(section) & page.isNotNull() & F.contains(normalize(page), normalize(section)), section)


def redact(text: Column, secrets: Column) -> Column:
    """Replaces every secret of eight characters or more."""
    return F.aggregate(F.filter(secrets, lambda s: F.length(s) >= 8), text, lambda t, s: F.replace(t, s, F.lit("[redacted]")))


def sanitized_filename(name: Column) -> Column:
    """The last path part with unusual characters folded to _, ends without blanks and dots, 120 characters at most; null if nothing is left."""
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(name, F.lit("")), r"[/\\]+$", ""), r"[/\\]"), -1)
    clean = F.regexp_replace(last, r"[^A-Za-z0-9._ \-()]+", "_")
    clean = F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")
    suffix = F.regexp_extract(clean, r"\.[^.]{0,9}$", 0)
    short = F.concat(F.substring(clean, F.lit(1), F.lit(120) - F.length(suffix)), suffix)
    return F.when(F.length(clean) > 120, short).otherwise(F.when(clean != "", clean))
