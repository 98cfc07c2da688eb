"""Quality rules, lines first: bad lines go, then documents that lost too much text are rejected.

Each line of words is judged by itself, in the order navigation, punctuation, boilerplate:

* navigation: separators (`|`, `»`, ...) standing alone, two or more and at least one in five
  words; or a line of at most MENU_WORDS words that are all words of menus.
* punctuation: no mark of a sentence's end at the line's end and fewer than two at its words; or marks that pile up (`!!`, `?!`)
  at two or more of its words and at least three in ten; or symbols in three in ten words.
* boilerplate: one of the fixed phrases (licences, rights, cookies, forms) in a line of at most
  NOTICE_WORDS words.

What is left is the clean text. A document that fails a base rule (too few words, too many
repeated five-word windows) is rejected, and so is one whose removed lines held more than
MOST_LOST of a hundred of its words' code points.

Whole texts are handled in slices of a batch. Base counts come from arrays over the bytes of a
slice, without a Python object for each word; rules see each line of words once. No shuffle.

Edge cases: a null text is the empty text, with no words: it fails the base rules. Lines
without words are neither judged nor counted, and stay out of the clean text. Repeated rows and
null ids are kept as rows. Ties do not arise. Texts of any length are taken whole, by one task
each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Base rules: words at least; words of a window; repeated words in a hundred at most.
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: Lines: words of a menu line and of a notice at most. Documents: lost code points of words in a hundred at most.
MENU_WORDS, NOTICE_WORDS, MOST_LOST = 8, 40, 50

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
SPACE = r"\x20\x09-\x0D"
ENDED = r"""[.!?…:;。！？]["'”’»)\]*_]*$"""
PILED = r"[!?]{2,}[\"'”’»)]*$"
SEPARATORS = ("|", "||", "»", "«", "›", "‹", "•", "·", ">", ">>", "<", "/", "::", "→", "←")
MENU = (
    "home", "menu", "login", "logout", "log", "in", "out", "sign", "up", "register", "search", "contact", "about", "us", "help", "faq", "sitemap", "site", "map", "next", "previous",
    "prev", "back", "top", "to", "more", "read", "share", "tweet", "print", "email", "skip", "content", "main", "navigation", "news", "blog", "shop", "cart", "account", "my", "categories", "tags",
    "accueil", "connexion", "recherche", "suivant", "précédent", "retour", "startseite", "anmelden", "suche", "weiter", "zurück", "kontakt", "impressum",
    "inicio", "buscar", "siguiente", "anterior", "volver", "contacto", "mapa", "del", "sitio",
)
NOTICES = (
    "all rights reserved", "licensed under", "license, version", "permission is hereby granted", "terms of use", "terms of service", "terms and conditions apply", "privacy policy", "cookie policy",
    "uses cookies", "use cookies", "accept cookies", "accept all cookies", "enable javascript", "javascript is disabled", "copyright ©", "copyright (c)", "© 20", "© 19", "(c) 20", "powered by", "subscribe to our",
    "sign up for our", "click here to", "lorem ipsum", "spdx-license-identifier", "without warranty of any kind", "creative commons",
    "tous droits réservés", "politique de confidentialité", "alle rechte vorbehalten", "datenschutzerklärung", "todos los derechos reservados", "política de privacidad",
)

_WORD = re.compile(f"[^{SPACE}]+")
_ENDED, _PILED, _SYMBOL = re.compile(ENDED), re.compile(PILED), re.compile(f"[{re.escape(SYMBOLS)}]")
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
_MENU, _SEPARATORS = frozenset(MENU), frozenset(SEPARATORS)
_NOTICE = re.compile("|".join(map(re.escape, NOTICES)))


def failed(line: str) -> str | None:
    """The first rule that a line of words fails."""
    words = _WORD.findall(line)
    n = len(words)
    apart = sum(w in _SEPARATORS for w in words)
    ended = _ENDED.search(words[-1]) or sum(_ENDED.search(w) is not None for w in words) > 1
    piled = sum(_PILED.search(w) is not None for w in words)
    signs = sum(_SYMBOL.search(w) is not None and w not in _SEPARATORS for w in words)
    if n <= MENU_WORDS and all(w in _SEPARATORS or _EDGES.sub("", w).lower() in _MENU for w in words) or apart >= 2 and 5 * apart >= n:
        return "navigation"
    if not ended or piled >= 2 and 10 * piled >= 3 * n or 10 * signs >= 3 * n:
        return "punctuation"
    if n <= NOTICE_WORDS and _NOTICE.search(line.lower()):
        return "boilerplate"
    return None


def _by_text(owner: np.ndarray, flags: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner[flags], minlength=n).astype(np.int64)


def _repeats(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each place: 0 where its key stands once in its text, 1 at the first of several, 2 at later ones."""
    order = np.lexsort((np.arange(len(keys)), keys, owner))
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(keys), np.int8)
    out[order] = np.where(same[:-1], 2, same[1:].astype(np.int8))
    return out


def base_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    n = len(off) - 1
    starts, ends, first = arrays.words(buf, off)
    counts = np.diff(first)
    text = np.repeat(np.arange(n), np.diff(off))
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    symbol = np.isin(buf, np.frombuffer(SYMBOLS.encode(), np.uint8))
    sums = arrays.prefix_sums(buf)

    owner = np.repeat(np.arange(n), counts)
    keys = arrays.range_hash(sums, starts, ends)
    at = np.flatnonzero(np.arange(len(keys)) + WINDOW <= first[1:][owner])  # windows by their first word
    window = np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        window = arrays.mix(window * np.uint64(0x9E3779B97F4A7C15) + keys[at + k] + np.uint64(k + 1))
    twice = at[_repeats(owner[at], window) > 0]
    covered = np.zeros(len(keys) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)

    begin, end, line_owner = lines(buf, off)
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, line_owner = begin[worded], end[worded], line_owner[worded]
    again = _repeats(line_owner, arrays.range_hash(sums, begin, end)) == 2
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": _by_text(text, ~space & ((buf & 0xC0) != 0x80), n),
        "n_symbols": _by_text(text, symbol, n),
        "n_dup_lines": _by_text(line_owner, again, n),
        "n_repeat_words": _by_text(owner, np.cumsum(covered[:-1]) > 0, n),
    }


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends and texts of all lines parted by \\n."""
    breaks = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([off[:-1], breaks + 1]))
    # an empty text's line and the line after a final \n begin where the next text does: owners follow from counts
    per_text = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
    owner = np.repeat(np.arange(len(off) - 1), per_text)
    end = np.append(begin[1:] - 1, off[-1])
    last = np.cumsum(per_text) - 1
    end[last] = off[1:]
    return begin, end, owner


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, base counts, base_failed, removed code points and lines by rule, kept and the clean text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.slices(whole, "text", 1 << 20):
                counts = base_counts(*arrays.buffers(batch.column("text")))
                lost, rules, texts = [], [], []
                for value in batch.column("text").to_pylist():
                    gone, by_rule, left = 0, {"punctuation": 0, "navigation": 0, "boilerplate": 0}, []
                    for line in (value or "").split("\n"):
                        if not _WORD.search(line):
                            continue
                        rule = failed(line)
                        if rule:
                            by_rule[rule] += 1
                            gone += sum(map(len, _WORD.findall(line)))
                        else:
                            left.append(line)
                    lost.append(gone)
                    rules.append(tuple(by_rule.values()))
                    texts.append("\n".join(left))
                n_words, word_chars, gone = counts["n_words"], counts["word_chars"], np.array(lost, np.int64)
                base = (n_words < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * n_words)
                kept = ~base & (100 * gone <= MOST_LOST * word_chars)
                by_rule = np.array(rules, np.int64).reshape(-1, 3)
                columns = [*counts.values(), base, gone, *by_rule.T, kept]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(texts, pa.string())], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "by_punctuation", "by_navigation", "by_boilerplate", "kept", "clean_text"]
    types = [kind, *["long"] * 5, "boolean", *["long"] * 4, "boolean", "string"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(judge, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_lit, values)) + "]"


_W = f"regexp_extract_all({{}}, {_lit(f'[^{SPACE}]+')})"
_N, _AT = "len(w)", "len(list_filter(w, lambda x: {}))"
_APART = _AT.format(f"list_contains({_list(SEPARATORS)}, x)")
_IS_ENDED = f"(regexp_matches(w[-1], {_lit(ENDED)}) OR " + _AT.format(f"regexp_matches(x, {_lit(ENDED)})") + " > 1)"
_PILES = _AT.format(f"regexp_matches(x, {_lit(PILED)})")
_SIGNS = _AT.format(f"regexp_matches(x, {_lit(f'[{SYMBOLS}]')}) AND NOT list_contains({_list(SEPARATORS)}, x)")
_IN_MENU = f"""{_N} <= {MENU_WORDS} AND {_AT.format(f"NOT list_contains({_list(SEPARATORS)}, x) AND NOT list_contains({_list(MENU)}, lower(regexp_replace(x, '^[^_{chr(92)}pL{chr(92)}pN]+|[^_{chr(92)}pL{chr(92)}pN]+$', '', 'g')))")} = 0"""
_NOTED = " OR ".join(f"contains(lower(line), {_lit(p)})" for p in NOTICES)
ORACLE_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS MATERIALIZED (SELECT r, line, w, row_number() OVER (PARTITION BY r, line) > 1 AS again FROM (SELECT r, line, {_W.format('line')} AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE len(w) > 0),
j AS (SELECT *, CASE WHEN {_IN_MENU} THEN true WHEN NOT {_IS_ENDED} THEN true WHEN {_PILES} >= 2 AND 10 * {_PILES} >= 3 * {_N} THEN true WHEN 10 * {_SIGNS} >= 3 * {_N} THEN true
  WHEN {_APART} >= 2 AND 5 * {_APART} >= {_N} THEN true ELSE {_N} <= {NOTICE_WORDS} AND ({_NOTED}) END AS bad FROM l),
t AS (SELECT r, count(*) FILTER (again) AS dup, coalesce(sum(length(array_to_string(w, ''))) FILTER (bad), 0) AS lost FROM j GROUP BY r),
w AS MATERIALIZED (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS x, len(w) AS n FROM (SELECT r, {_W.format('text')} AS w FROM d)),
s AS MATERIALIZED (SELECT r, i, n, array_to_string(list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING), ' ') AS s FROM w),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS k FROM s WHERE i + {WINDOW} <= n) WHERE k > 1),
c AS (SELECT r, count(DISTINCT i + o) AS repeated FROM m, (SELECT unnest(range({WINDOW})) AS o) GROUP BY r),
b AS (SELECT d.r, doc_id, len({_W.format('text')}) AS n_words, length(array_to_string({_W.format('text')}, '')) AS word_chars, len(regexp_extract_all(text, {_lit(f'[{SYMBOLS}]')})) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(repeated, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_chars FROM d LEFT JOIN t ON t.r = d.r LEFT JOIN c ON c.r = d.r),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars::BIGINT AS lost_chars, NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept FROM f"""
