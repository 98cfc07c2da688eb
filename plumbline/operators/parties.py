"""Who acts in a clause: role nouns and organisation names, as columns.

A name is taken from two places only: the words before a verb of duty, permission or
prohibition, and the words after `by` in a passive clause. What stands before such a verb in
the passive is acted on and is no actor. All are built-in expressions; texts are read in lower
case, with third parties left out. Null counts as the empty text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..functions.constants import listed, one_of

_RUN = r"(?:[\p{L}\p{N} '\-]|(?<=[\p{L}\p{N}])\.(?=[\p{L}\p{N}]))*"
_TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
_PASSIVE = r"\b(?:is|are|was|were|be|been|being)\s+\w+(?:ed|en)\b"
_AGENT = r"\bby\s+(?:the\s+|its\s+|his\s+|her\s+|their\s+)?([a-z]+)\b"
_ROLE = rf"(?=[{''.join(sorted({r[0] for r in V.ROLES}))}])(?<![a-z])({T.any_literal(V.ROLES)})(?![a-z])"
_VERB = rf"\b(?:{V.SUBJECT_VERBS})\b"
#: A text without any of these words has no verb of duty, no agent and no role.
SIGNALS = (*V.ROLES, "by", *T.heads(v.replace("?", "") for v in re.sub(r"\(\?:is\|are\)\\s\+\(\?:(.*)\)", r"\1", V.SUBJECT_VERBS).split("|")), "agree")
_FIGURE_ACTS = rf"(?<![0-9])[0-9][\p{{L}}\p{{N}} '.\-]*?(?:\r\n|[\n\r\u0085\u2028\u2029])?\b(?=[acegimruws])(?:{V.SUBJECT_VERBS})\b"
_FIGURE_AGENT = r"\bby\s+[\p{L}\p{N} '.\-]*?[0-9]"


def without_third_parties(text: Column) -> Column:
    low = T.lowered(F.coalesce(text, F.lit("")))
    return F.when(F.contains(low, F.lit("third")), F.regexp_replace(low, r"\bthird[\s-]+part(?:y|ies)\b", " ")).otherwise(low)


def _tokens(run: Column) -> Column:
    return F.regexp_extract_all(run, F.lit(_TOKEN), F.lit(0))


def _before(part: Column) -> Column:
    """The name at the end of what stands before a verb; null if its last word is a role, a document noun or a stopword."""
    back = F.reverse(_tokens(F.regexp_extract(part, f"({_RUN})$", 1)))
    few = F.slice(back, 1, V.NAME_WORDS)
    stop = F.array_position(F.transform(few, lambda w: one_of(w, V.STOPWORDS)), True)
    name = F.array_join(F.reverse(F.when(stop > 0, F.slice(few, F.lit(1), (stop - 1).cast("int"))).otherwise(few)), " ")
    head = F.get(back, F.lit(0))
    return F.when(head.isNotNull() & ~one_of(head, V.ROLES, V.DOCUMENT_NOUNS, V.STOPWORDS), name)


def _agent(run: Column) -> Column:
    """The name after `by`, if all words up to the next punctuation can belong to one."""
    tokens = _tokens(run)
    fits = F.size(tokens).between(1, V.NAME_WORDS) & ~F.exists(tokens, lambda w: one_of(w, V.ROLES, V.DOCUMENT_NOUNS, V.STOPWORDS))
    return F.when(fits, F.array_join(tokens, " "))


def named(text: Column) -> Column:
    """Distinct organisation names that act in a text."""
    return names_in(without_third_parties(text))


def names_in(plain: Column) -> Column:
    """named() of a text without third parties."""
    none = F.array().cast("array<string>")

    def active(parts: Column) -> Column:
        follows = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda after: after.rlike(r"^\s+(?:not\s+)?(?:be|been|being)\b"))
        pairs = F.arrays_zip(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("part"), follows.alias("passive"))
        return F.transform(pairs, lambda x: F.when(~x["passive"], _before(x["part"])))

    # a split compiles its pattern for every text, and a value that lambdas use is computed anew each time unless it is one of their arguments
    cut = F.when(plain.rlike(_VERB), F.element_at(F.transform(F.array(F.split(plain, _VERB)), active), 1)).otherwise(none)
    runs = F.when(plain.rlike(r"\bby\s") & plain.rlike(_PASSIVE), F.regexp_extract_all(plain, F.lit(rf"\bby\s+(?=({_RUN}))"), F.lit(1))).otherwise(none)
    return F.array_distinct(F.array_compact(F.concat(cut, F.transform(runs, _agent))))


def may_hold_figures(text: Column) -> Column:
    """Whether a name of named() may hold a figure: false only if none does. It holds or not for all texts of a shape."""
    plain = without_third_parties(text)
    return plain.rlike(_FIGURE_ACTS) | (F.contains(plain, F.lit("by")) & plain.rlike(_FIGURE_AGENT) & plain.rlike(_PASSIVE))


def _place(plain: Column, name: Column) -> Column:
    """Where a whole name begins, from 1; 0 if it does not occur. A pattern that each row has anew is compiled each time, so it is looked for only where it can be."""
    at = F.regexp_instr(plain, F.concat(F.lit("(?<![a-z0-9])"), F.replace(name, F.lit("."), F.lit("\\.")), F.lit("(?![a-z0-9])")))
    return F.when(F.contains(plain, name), at).otherwise(0)


def _alias(role: Column) -> Column:
    out = role
    for word, same in V.ROLE_ALIASES.items():
        out = F.when(role == word, same).otherwise(out)
    return out


def parties(text: Column, names: Column) -> Column:
    """Roles, by their common name, and those of the names that occur in a text."""
    plain = without_third_parties(text)
    return parties_in(plain, F.transform(placed(plain, names), lambda x: x["name"]))


def placed(plain: Column, names: Column) -> Column:
    """array of (at, size, name): those of the names that occur in a text without third parties, with their first place and their length below zero."""

    def found(t: Column) -> Column:
        rows = F.transform(names, lambda n: F.struct(_place(t, n).alias("at"), (-F.length(n)).alias("size"), n.alias("name")))
        return F.filter(rows, lambda x: x["at"] > 0)

    return F.element_at(F.transform(F.array(plain), found), 1)


def parties_in(plain: Column, here: Column) -> Column:
    """parties() of a text without third parties and the names that occur in it."""
    return F.array_union(roles_in(plain), here)


def roles_in(plain: Column) -> Column:
    """Roles of a text without third parties, by their common name."""
    return F.transform(F.array_intersect(T.words(plain), listed(V.ROLES)), _alias)


def same(a: Column, b: Column) -> Column:
    """Whether one name is a run of whole words of the other, or equal to it."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.contains(pad(a), pad(b)) | F.contains(pad(b), pad(a))


def covered(claimed: Column, available: Column) -> Column:
    """Whether every party of the first list is one of the second."""
    return F.forall(claimed, lambda c: F.exists(available, lambda a: same(c, a)))


def acting(text: Column, names: Column) -> Column:
    """The party that acts: the agent of a passive clause, or else the first one named; a name wins where a role begins too. Null if there is none."""
    plain = without_third_parties(text)
    return acting_in(plain, placed(plain, names))


def acting_in(plain: Column, here: Column) -> Column:
    """acting() of a text without third parties, given the places of names in it."""
    acts = acts_in(plain)
    return acting_of(acts["agent"], acts["role"], acts["role_at"], here)


def acts_in(plain: Column) -> dict[str, Column]:
    """The roles of a text without third parties, the agent of its passive clause, and its first role and where that begins; empty and 0 without one."""
    agent = F.when(plain.rlike(r"\bby\s") & plain.rlike(_PASSIVE), F.regexp_extract(plain, _AGENT, 1)).otherwise(F.lit(""))
    named = plain.rlike(_ROLE)
    return {"roles": roles_in(plain), "agent": agent, "role": F.when(named, F.regexp_extract(plain, _ROLE, 1)).otherwise(""), "role_at": F.when(named, F.regexp_instr(plain, F.lit(_ROLE))).otherwise(0)}


def acting_of(agent: Column, role: Column, role_at: Column, here: Column) -> Column:
    """acting_in(), of what acts_in() says and the places of names."""
    given = F.struct(agent.alias("agent"), role.alias("role"), role_at.alias("role_at"), here.alias("here"))

    def chosen(x: Column) -> Column:
        began = F.filter(x["here"], lambda n: (x["agent"] != "") & (F.substring_index(n["name"], " ", 1) == x["agent"]))
        longest = F.array_min(F.transform(began, lambda n: F.struct(n["size"].alias("size"), n["name"].alias("name"))))["name"]
        first = F.array_min(x["here"])
        named_first = first.isNotNull() & ((x["role_at"] == 0) | (first["at"] <= x["role_at"]))
        by = F.when((x["agent"] != "") & one_of(x["agent"], V.ROLES), _alias(x["agent"]))
        return F.coalesce(by, longest, F.when(named_first, first["name"]), F.when(x["role"] != "", _alias(x["role"])))

    return F.element_at(F.transform(F.array(given), chosen), 1)
