"""Words that differ in exactly one jamo, and which heard forms are words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonrisk.functions.text import hash60
from phonrisk.operators.features import word_slots
from phonrisk.operators.ordered import rank_rows

ROUNDS = 4  # keyed shifts of a pair draw


def masked_patterns(words: DataFrame, word: str = "word") -> DataFrame:
    """(pattern, slot, word): the word's jamo with one slot masked, once per slot.

    Two words are minimal pairs exactly when they share a pattern, so an equi-join finds them.
    """
    slots = words.select(word).distinct().withColumn("_s", word_slots(F.col(word)))
    masked = F.transform(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: F.struct(
        i.alias("slot"), F.array_join(F.transform("_s", lambda s, j: F.when(j == i, "*").otherwise(s.cast("string"))), ".").alias("pattern")))
    return slots.where(F.size("_s") > 0).select(word, F.inline_outer(masked))


def competitors(words: DataFrame, word: str = "word") -> DataFrame:
    """Number of distinct one-jamo neighbours of every word.

    Within a pattern the words differ only in the masked jamo, so a pattern of k distinct
    words gives each of them k - 1 neighbours: counting does it, no pair is formed. A word and
    a neighbour share exactly one pattern, so the counts add up.
    """
    m = masked_patterns(words, word)
    size = m.groupBy("pattern").agg((F.count("*") - 1).alias("_k"))
    return m.join(size, "pattern").groupBy(word).agg(F.sum("_k").alias("n_neighbours"))


def neighbours_of(forms: DataFrame, lexicon: DataFrame, form: str, word: str = "word", exclude: str | None = None) -> DataFrame:
    """Lexicon words one jamo away from each given form. A pattern holds at most 28 words."""
    a = masked_patterns(forms, form).select(form, "pattern")
    b = masked_patterns(lexicon, word).select(F.col(word).alias("neighbour"), "pattern")
    pairs = a.join(b, "pattern").where(F.col(form) != F.col("neighbour")).select(form, "neighbour").distinct()
    if exclude is None:
        return pairs
    return forms.select(form, exclude).distinct().join(pairs, form).where(F.col("neighbour") != F.col(exclude))


def known_forms(trials: DataFrame, lexicon: DataFrame, form: str = "perceived_word", word: str = "word") -> DataFrame:
    """Adds ``is_word``: whether the heard form is in the lexicon."""
    known = lexicon.select(F.col(word).alias(form)).distinct().withColumn("_k", F.lit(True))
    return trials.join(known, form, "left").withColumn("is_word", F.coalesce("_k", F.lit(False))).drop("_k")


def sampled_pairs(df: DataFrame, cap: int, *, listener: str = "listener_id", y: str = "misheard", row: str = "row_id", seed: int = 0,
                  keep: tuple[str, ...] = (), bounded: bool | None = None) -> DataFrame:
    """(misheard, heard) pairs inside each listener, ``cap`` drawn without replacement.

    Sampling is the reference behaviour. Pair numbers 0..m*n-1 are split into a (misheard, heard)
    place and stirred by ``ROUNDS`` keyed shifts, each side moved by a hash of the other. Every
    shift can be undone, so this is a permutation of the pairs: the first ``cap`` numbers give
    distinct, spread pairs, all numbers give every pair, and no product is formed. Places are
    dealt to rows by hash, so that a side of one row still leaves a spread draw of the other.
    """
    keyed = df.select(listener, y, row, *keep).withColumn("_h", hash60(F.concat_ws(":", F.lit(f"side{seed}"), F.col(row))))
    sides = rank_rows(keyed, [listener, y], ["_h", row], rn="_k", bounded=bounded).drop("_h")
    sizes = sides.groupBy(listener).agg(F.count_if(F.col(y) == 1).alias("_m"), F.count_if(F.col(y) == 0).alias("_n"))
    total = F.col("_m") * F.col("_n")
    pairs = sizes.where(total > 0).select(listener, "_m", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(total, F.lit(cap)) - 1)).alias("_i"))
    pairs = pairs.select(listener, "_m", "_n", F.expr("_i div _n").alias("_a"), F.expr("_i % _n").alias("_b"))
    for r in range(ROUNDS):
        moved, other, size = ("_a", "_b", "_m") if r % 2 == 0 else ("_b", "_a", "_n")
        shift = hash60(F.concat_ws(":", F.lit(f"pair{seed}"), F.col(listener), F.lit(r), F.col(other)))
        pairs = pairs.withColumn(moved, (F.col(moved) + F.pmod(shift, F.col(size))) % F.col(size))
    pairs = pairs.select(listener, (F.col("_a") + 1).alias("_a"), (F.col("_b") + 1).alias("_b"))
    pos = sides.where(F.col(y) == 1).select(listener, F.col("_k").alias("_a"), F.col(row).alias("pos_row"), *[F.col(c).alias(f"pos_{c}") for c in keep])
    neg = sides.where(F.col(y) == 0).select(listener, F.col("_k").alias("_b"), F.col(row).alias("neg_row"), *[F.col(c).alias(f"neg_{c}") for c in keep])
    # Up to ``cap`` pairs come of one row of sizes, which size estimates don't see: never broadcast.
    return pairs.hint("merge").join(pos.hint("merge"), [listener, "_a"]).hint("merge").join(neg.hint("merge"), [listener, "_b"]).drop("_a", "_b")
