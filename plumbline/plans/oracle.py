"""Building blocks of the DuckDB SQL that checks the queries: the same rules in another engine's terms."""

from __future__ import annotations

import re

from ..functions import values as X
from ..functions import vocabulary as V


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, phrases) -> str:
    ordered = sorted(set(phrases), key=lambda p: (-len(p), p))
    body = "|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for p in ordered)
    return f"regexp_matches(lower(coalesce({column}, '')), {lit(f'(^|[^a-z0-9])({body})([^a-z0-9]|$)')})"


def words(column: str) -> str:
    return f"regexp_extract_all(lower(coalesce({column}, '')), '[a-z]+')"


def some_of(names) -> str:
    return "[" + ", ".join(lit(n) for n in names) + "]"


def content(column: str) -> str:
    return f"list_filter(list_distinct({words(column)}), lambda w: length(w) > 2 AND NOT list_contains({some_of(V.STOPWORDS)}, w))"


def overlap(claim: str, context: str) -> str:
    own = content(claim)
    return f"(CASE WHEN len({own}) > 0 THEN len(list_intersect({own}, {content(context)})) / len({own})::DOUBLE ELSE 0.0 END)"


def modality(column: str) -> str:
    return f"(CASE WHEN {any_of(column, V.PROHIBITIONS)} THEN 'prohibition' WHEN {any_of(column, V.OBLIGATIONS)} THEN 'obligation' WHEN {any_of(column, V.PERMISSIONS)} THEN 'permission' ELSE 'none' END)"


def negative(column: str) -> str:
    return f"(len(list_filter({words(column)}, lambda w: list_contains({some_of(V.NEGATIONS)}, w))) > 0 OR {any_of(column, V.PROHIBITIONS)})"


def topic(column: str) -> str:
    """Topic of a label: the first phrase it has, else its first known word, else other."""
    found = f"regexp_extract_all(lower(substr(coalesce({column}, ''), 1, 64)), '[a-z]+')"
    phrases = " ".join(f"WHEN contains(' ' || array_to_string({found}, ' ') || ' ', {lit(f' {p} ')}) THEN {lit(n)}" for p, n in V.TOPIC_PHRASES)
    names = [(key, name) for name, keys in V.TOPICS.items() for key in keys]
    known = f"list_filter({found}, lambda w: list_contains({some_of(k for k, _ in names)}, w))"
    return f"(CASE {phrases} ELSE coalesce({some_of(n for _, n in names)}[list_position({some_of(k for k, _ in names)}, {known}[1])], 'other') END)"


def folded(column: str, case: bool = True) -> str:
    out = f"translate(nfc_normalize(coalesce({column}, '')), {lit(V.ZERO_WIDTH)}, '')"
    for old, new in {**V.LIGATURES, **V.PUNCTUATION}.items():
        out = f"replace({out}, {lit(old)}, {lit(new)})"
    out = f"regexp_replace({out}, '(\\pL)-[ \\t]*[\\r\\n]+[ \\t]*(\\pL)', '\\1\\2', 'g')"
    out = f"trim(regexp_replace({out}, '[\\s\\p{{Z}}\\x0b\\x{{85}}\\x1c-\\x1f]+', ' ', 'g'))"
    return f"replace(lower({out}), 'ß', 'ss')" if case else out


_EDGED = r"(^|[^\d,.])(\d{1,3}(?:\.\d{3})+(?:,\d+)?)"


def _spans(k: int) -> tuple[str, str]:
    """Pattern and the group that holds the span, without lookarounds."""
    kind, continental, pattern = X.NUMBERS[k]
    if not continental:
        return "(" + pattern + ")", "1"
    body = r"\d{1,3}(?:\.\d{3})+(?:,\d+)?"
    return "(" + pattern.replace(X.CONTINENTAL, body) + ")", "1"


def number_tables(source: str, key: str) -> str:
    """CTEs n0.. that take values of each pattern in turn from `source`(key, t) with t folded; `found` has (key, step, at, raw)."""
    ctes, rest = [], f"SELECT {key}, t FROM {source}"
    parts = []
    steps = [(f"d{k}", p, "date") for k, (_, p) in enumerate(X.DATES)] + [(f"n{k}", _spans(k)[0], X.NUMBERS[k][0]) for k in range(len(X.NUMBERS))]
    for name, pattern, kind in steps:
        ctes.append(f"{name} AS MATERIALIZED ({rest})")
        rest = f"SELECT {key}, regexp_replace(t, {lit(pattern)}, chr(2), 'g') AS t FROM {name}"
        parts.append(f"SELECT {key}, {lit(name)} AS step, {lit(kind)} AS kind, unnest(regexp_extract_all(t, {lit(pattern)})) AS raw FROM {name}")
    return ",\n".join(ctes) + ",\nfound AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"
