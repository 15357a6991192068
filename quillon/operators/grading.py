"""Grading of answers against digests, in three values: null (not answered), true, false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import digest, once, tokens


def single_choice(choice: Column, accepted: Column) -> Column:
    """choice: digest of the option chosen, or null."""
    return F.when(choice.isNotNull(), F.array_contains(accepted, choice))


def multiple_choice(chosen: Column, accepted: Column, least: Column | None = None) -> Column:
    """All that was chosen is accepted, and it is at least `least` (1 if null or 0); the accepted ones need not all be chosen."""
    least = F.lit(1) if least is None else F.coalesce(F.nullif(least, F.lit(0)), F.lit(1))
    every = F.forall(chosen, lambda c: F.array_contains(accepted, c))
    return F.when(F.size(F.coalesce(chosen, F.array())) > 0, every & (F.size(chosen) >= least))


def free_text(text: Column, groups: list[list[str]], salt: str) -> Column:
    """groups: digests of tokens; every group needs one of its tokens in the text, in any order, among any others."""
    return once(tokens(text), lambda words: free_words(words, groups, salt))


def free_words(words: Column, groups: list[list[str]], salt: str) -> Column:
    """As free_text, of the text's tokens; these should be a plain column, as they stand here more than once."""

    def verdict(own: Column) -> Column:
        hit = F.lit(True)
        for group in groups:
            hit = hit & F.arrays_overlap(own, F.array(*[F.lit(g) for g in group]))
        return hit

    return F.when(F.size(words) > 0, once(F.transform(F.array_distinct(words), lambda t: digest(salt, "tok", t)), verdict))


def graded(kind: Column, single: Column, multiple: Column, text: Column) -> Column:
    """The verdict by kind of question; an unknown kind is false."""
    return F.when(kind == "unica", single).when(kind == "multiple", multiple).when(kind == "texto", text).otherwise(F.lit(False))


def outcome(verdicts_true: Column, blanks: Column, total: Column) -> Column:
    """Solved if every question is right; else blanks are reported first, then how many are right."""
    return (
        F.when(verdicts_true == total, F.lit("solved"))
        .when(blanks > 0, F.concat(F.lit("blank: "), blanks.cast("string")))
        .otherwise(F.concat(verdicts_true.cast("string"), F.lit(" of "), total.cast("string")))
    )


def unlocked(free: Column, bought: Column, requirements: Column) -> Column:
    """requirements: array of booleans, what a stage itself lists; none means that nothing is missing."""
    return F.when(free, F.lit(True)).otherwise(bought & F.forall(requirements, lambda r: F.coalesce(r, F.lit(False))))


#: The eight lines of a three by three board, as cells 3 * row + column.
LINES = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (2, 4, 6))


def game_trace(moves: Column, ends: Column | None = None) -> Column:
    """Struct valid, label of a game.

    moves: ordered array of struct(cell int, mark string); ends: array of the two end cells of a line that was drawn, or
    null. Invalid: a move after a win, a cell used twice, a mark twice in a row, or a drawn line that is not the winning one.
    A fold over the moves carries one bit mask of cells for each mark.
    """
    masks = [sum(1 << c for c in line) for line in LINES]

    def step(s: Column, m: Column) -> Column:
        own = F.when(m["mark"] == "O", s["o"]).otherwise(s["x"]).bitwiseOR(_shift(m["cell"]))
        won = F.coalesce(*[F.when(own.bitwiseAND(F.lit(k)) == k, F.lit(k)) for k in masks], F.lit(0))
        clash = (s["won"] > 0) | (s["o"].bitwiseOR(s["x"]).bitwiseAND(_shift(m["cell"])) > 0) | (s["last"] == m["mark"])
        return F.struct(
            F.when(m["mark"] == "O", own).otherwise(s["o"]).alias("o"),
            F.when(m["mark"] == "O", s["x"]).otherwise(own).alias("x"),
            m["mark"].alias("last"),
            F.when(won > 0, won).otherwise(s["won"]).alias("won"),
            F.when(won > 0, m["mark"]).otherwise(s["winner"]).alias("winner"),
            (s["good"] & ~clash).alias("good"),
            (s["n"] + 1).alias("n"),
        )

    def _shift(cell: Column) -> Column:
        return F.element_at(F.array(*[F.lit(1 << i) for i in range(9)]), cell + 1)

    zero = F.struct(
        F.lit(0).alias("o"), F.lit(0).alias("x"), F.lit("").alias("last"), F.lit(0).alias("won"), F.lit("").alias("winner"), F.lit(True).alias("good"), F.lit(0).alias("n")
    )

    def finish(s: Column) -> Column:
        good = s["good"]
        if ends is not None:
            on_line = lambda e: s["won"].bitwiseAND(_shift(e)) > 0
            good = good & F.when(ends.isNull(), F.lit(True)).otherwise((s["won"] > 0) & on_line(ends[0]) & on_line(ends[1]))
        label = F.when(s["won"] > 0, F.concat(F.lit("won by "), s["winner"])).when(s["n"] == 9, F.lit("draw")).otherwise(F.lit("in play"))
        return F.struct(good.alias("valid"), label.alias("label"))

    return F.aggregate(F.coalesce(moves, F.array().cast("array<struct<cell:int,mark:string>>")), zero, step, finish)
