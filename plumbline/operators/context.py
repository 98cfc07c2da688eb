"""The sentence a quote stands in, with the carve-outs that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..functions.constants import one_of

#: First words and phrases by which a sentence points back, and how many carve-outs a context takes in.
OPENERS = ("this", "that", "these", "those", "such", "however", "notwithstanding", "provided", "except", "but", "nothing", "no", "neither", "subject")
OPENING_PHRASES = ("the foregoing", "the above", "in no event")
FOLLOWING = 2


def is_carve_out(sentence: Column) -> Column:
    """Whether a sentence points back and restricts: it negates, excepts or sets a condition."""
    low = T.squash_ends(F.lower(F.coalesce(sentence, F.lit(""))))
    first = F.get(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), F.lit(0))
    points = one_of(first, OPENERS) | low.rlike("^(?:" + "|".join(OPENING_PHRASES) + ")")
    return F.coalesce(points, F.lit(False)) & (T.is_negative(sentence) | T.has_any(sentence, V.EXCEPTIONS) | T.is_conditional(sentence))


def qualifies(sentence: Column, host: Column) -> Column:
    """Whether it is a carve-out on this host: they share a content word."""
    return F.coalesce(F.arrays_overlap(T.content_words(sentence), T.content_words(host)), F.lit(False)) & is_carve_out(sentence)


def host_and_carve_out(sentences: Column) -> tuple[Column, Column]:
    """The clause and its carve-outs, of a context's sentences; no carve-out unless every later sentence qualifies the one before."""
    later = F.sequence(F.lit(2), F.size(sentences))
    every = F.forall(later, lambda k: qualifies(F.element_at(sentences, k), F.element_at(sentences, k - 1)))
    split = F.when(F.size(sentences) < 2, False).otherwise(every)
    whole = F.array_join(sentences, " ")
    return F.when(split, F.get(sentences, F.lit(0))).otherwise(whole), F.when(split, F.array_join(F.slice(sentences, 2, 10_000), " ")).otherwise(F.lit(""))


def carried(claim: Column, host: Column, carve_out: Column) -> Column:
    """Whether the claim deals with a carve-out: both are conditional, or it has half of the carve-out's own words."""
    own = F.array_except(T.content_words(carve_out), T.content_words(host))
    shared = F.size(F.array_intersect(own, T.content_words(claim)))
    return (T.is_conditional(claim) & T.is_conditional(host)) | (F.size(own) == 0) | (shared * 2 >= F.size(own))


def units(sentences: Column) -> Column:
    """Sentences, with each carve-out joined to the unit it qualifies."""
    return F.transform(runs(sentences), lambda u: u["unit"])


def runs(sentences: Column) -> Column:
    """array of (first, many, unit): sentences, with each carve-out joined to the unit it qualifies, and which sentences, from 1, a unit holds."""
    of = "struct<first:int,many:int,unit:string>"

    def step(done: Column, s: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1))
        joins = (F.size(done) > 0) & qualifies(s, last["unit"])
        more = F.struct(last["first"].alias("first"), (last["many"] + 1).alias("many"), F.concat_ws(" ", last["unit"], s).alias("unit")).cast(of)
        new = F.struct(F.coalesce(last["first"] + last["many"], F.lit(1)).alias("first"), F.lit(1).alias("many"), s.alias("unit")).cast(of)
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(more))).otherwise(F.array_append(done, new))

    return F.aggregate(sentences, F.array().cast(f"array<{of}>"), step)


def with_context(rows: DataFrame) -> DataFrame:
    """rows(window, page_text, …) with context: the sentences the window stands in and up to FOLLOWING carve-outs after them.

    Texts are normalised, so sentences are one blank apart and their places follow from their
    lengths. Without a window, or one that is not on the page, the window is its own context.
    """
    found = with_place(rows.withColumn("__p", T.normalize(F.col("page_text"))).withColumn("__at", F.position(F.col("window"), F.col("__p"))))
    return found.withColumn("context", context_at(F.col("__p"))).drop("__p", "__at", "__from", "__many")


def context_at(page: Column) -> Column:
    """The context, of a normalised page and of the columns of with_place()."""
    known = (F.length("window") > 0) & (F.col("__at") > 0)
    return F.when(known, F.array_join(F.slice(T.sentences(page), F.col("__from"), F.col("__many")), " ")).otherwise(F.coalesce("window", F.lit("")))


def with_place(rows: DataFrame) -> DataFrame:
    """rows(window, __p, __at, …), a normalised page and where the window begins on it, with __from and __many: the first sentence of the context and how many it has. It does not depend on figures."""
    staged = rows.withColumn("__s", T.sentences(F.col("__p")))
    ends = F.aggregate("__s", F.array().cast("array<int>"), lambda a, s: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(s) + 1))
    staged = staged.withColumn("__ends", ends)
    first = F.size(F.filter("__ends", lambda e: e < F.col("__at"))) + 1
    last = F.size(F.filter("__ends", lambda e: e < F.col("__at") + F.length("window") - 1)) + 1
    staged = staged.withColumn("__a", first).withColumn("__b", F.least(last, F.size("__s")))
    one = F.get("__s", F.col("__b"))  # __b counts from 1, and is 0 on a page without sentences
    two = F.get("__s", F.col("__b") + 1)
    staged = staged.withColumn("__q1", one.isNotNull() & F.coalesce(qualifies(one, F.get("__s", F.col("__b") - 1)), F.lit(False)))
    staged = staged.withColumn("__q2", F.col("__q1") & two.isNotNull() & F.coalesce(qualifies(two, one), F.lit(False)))
    more = F.col("__q1").cast("int") + F.col("__q2").cast("int")
    out = staged.withColumns({"__from": F.greatest("__a", F.lit(1)), "__many": F.greatest(F.col("__b") - F.col("__a") + 1 + more, F.lit(0))})
    return out.drop("__s", "__ends", "__a", "__b", "__q1", "__q2")
