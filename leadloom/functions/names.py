"""Conservative comparison of personal names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import fold_key, let


def name_tokens(c: Column | str) -> Column:
    """Folded words without surrounding dots; empty array when the name is missing."""
    words = F.split(fold_key(c), " ")
    return F.coalesce(
        F.transform(words, lambda w: F.btrim(w, F.lit("."))), F.array().cast("array<string>")
    )


def _letters(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0), lambda acc, w: acc + F.length(w))


def name_order(tokens: Column) -> Column:
    """Sort key that puts the shorter name first."""
    return F.struct(F.size(tokens).alias("n"), _letters(tokens).alias("l"))


def tokens_compatible(short: Column, long: Column) -> Column:
    """Whether ``short`` can be the same person as ``long`` (``short`` sorts first).

    Full words only in the long name; the first word equal or an initial of it; the other words
    of the short name, all full, in the same order inside the long one.
    """
    full = F.lit(1)
    enough = (F.size(short) >= 2) & (F.size(long) >= 2)
    same = (short == long) & F.forall(short, lambda w: F.length(w) > full)
    head_s, head_l = F.get(short, F.lit(0)), F.get(long, F.lit(0))
    head = (head_s == head_l) | ((F.length(head_s) == 1) & head_l.startswith(head_s))
    tail = F.slice(short, F.lit(2), F.greatest(F.size(short) - 1, F.lit(0)))
    # position in the long name after which the next word may be found; -1 once one is missing
    reached = F.aggregate(
        tail,
        F.lit(1),
        lambda at, w: F.when(at < 0, at).otherwise(
            F.coalesce(
                F.nullif(
                    F.array_position(
                        F.slice(long, at + 1, F.greatest(F.size(long) - at, F.lit(0))), w
                    ).cast("int"),
                    F.lit(0),
                ) + at,
                F.lit(-1),
            )
        ),
    )
    ordered = (
        F.forall(long, lambda w: F.length(w) > full)
        & head
        & F.forall(tail, lambda w: F.length(w) > full)
        & (reached > 0)
    )
    return F.coalesce(enough & F.when(short == long, same).otherwise(ordered), F.lit(False))


def names_compatible(a: Column | str, b: Column | str) -> Column:
    """Symmetric comparison of two declared names."""
    ta, tb = name_tokens(a), name_tokens(b)

    def ordered(p: Column) -> Column:
        swap = name_order(p["b"]) < name_order(p["a"])
        return F.struct(
            F.when(swap, p["b"]).otherwise(p["a"]).alias("s"),
            F.when(swap, p["a"]).otherwise(p["b"]).alias("l"))

    pair = let(F.struct(ta.alias("a"), tb.alias("b")), ordered)
    return let(pair, lambda p: tokens_compatible(p["s"], p["l"]))


def is_full_name(c: Column | str) -> Column:
    """At least two words and no initials."""
    tokens = name_tokens(c)
    return (F.size(tokens) >= 2) & F.forall(tokens, lambda w: F.length(w) > 1)


def presentation_rank(c: Column) -> Column:
    """Ordering for the best name to show: most full words, then longest."""
    words = F.transform(F.split(c, " "), lambda w: F.btrim(w, F.lit(".")))
    return F.struct(
        F.size(F.filter(words, lambda w: F.length(w) > 1)).alias("n"), F.length(c).alias("l")
    )
