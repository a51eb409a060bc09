"""Similar titles without comparing all titles that share a phrase.

A pair must share a surname and reach the ratio of matching blocks. That ratio is at
most the one of the longest common subsequence, so similar titles are at most ``d``
single-character insertions and deletions apart, ``d`` following from the shorter length.
The shorter title is cut into ``p > d`` equal pieces. At most ``d`` of them are hurt, so

- of any ``d + 1`` pieces one stands unchanged in the longer title, near its place: the
  ``d + 1`` rarest pieces of each title are looked up and its common phrases are not;
- where a looked-up piece is itself frequent and ``p > d + 1``, one of any ``d + 1`` other
  pieces stands unchanged as well: it is looked up together with the rarest of those.

Frequencies decide speed only, never the result. Pieces and places travel with a digest
of their title; the texts are joined to the distinct pairs, where the banded edit
distance decides most of them before blocks are matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratio import titles_alike, within_edits
from ..session import cut_lineage

SAME_TITLE = 0.97
LEAST_RATIO = 0.8  # below it, titles would be cut into pieces of no character
SMALL_PIECE = 3
FREQUENT = 100  # titles with one piece from which a second piece is asked for
OWNER = ["audit_id", "surname"]
PIECE = [*OWNER, "q", "piece"]


def _budget(length: Column, eps: float) -> Column:
    """Most single-character insertions and deletions a title this long may need
    to reach any title that is at least as long and still similar enough."""
    longest = F.floor(length * ((1 + eps) / (1 - eps)) + 1e-9)
    return F.floor((length + longest) * eps + 1e-9).cast("int")


def _cuts(length: Column, d: Column) -> Column:
    """Number of pieces: twice what is needed, unless they would become too small."""
    return F.greatest(d + 1, F.least(2 * (d + 1), F.floor(length / SMALL_PIECE))).cast("int")


def _piece_length(length: Column, eps: float) -> Column:
    d = _budget(length, eps)
    return F.when(d >= 1, F.floor(length / _cuts(length, d)).cast("int"))


def _ranked_pieces(sized: DataFrame, eps: float) -> DataFrame:
    """Every title's pieces from the rarest on: ``PIECE, tid, n, d, at, place, often, ranked``."""
    d = _budget(F.col("n"), eps)
    cut = sized.withColumn("d", d).filter("d >= 1").withColumn("q", _piece_length(F.col("n"), eps)).withColumn("p", _cuts(F.col("n"), F.col("d")))
    pieces = cut.select(
        *OWNER, "tid", "n", "d", "q", "fresh", "title",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: (i * F.col("q")).cast("int"))).alias("at"),
    ).withColumn("piece", F.col("title").substr(F.col("at") + 1, F.col("q"))).drop("title")
    often = pieces.groupBy(*PIECE).agg(F.count("*").alias("often")).filter("often > 1")
    told = pieces.join(often, PIECE, "left").withColumn("often", F.coalesce("often", F.lit(1).cast("long")))
    per = told.groupBy(*OWNER, "tid", "n", "d", "q", "fresh").agg(F.array_sort(F.collect_list(F.struct("often", "at", "piece"))).alias("ranked"))
    return per.select("*", F.posexplode("ranked").alias("place", "x")).select(*OWNER, "tid", "n", "d", "q", "fresh", "ranked", "place", "x.often", "x.at", "x.piece")


def _grams(sized: DataFrame, eps: float) -> DataFrame:
    """Every substring of a title that has the piece length of some title that is as long or shorter, and similar enough."""
    shortest = F.ceil(F.col("n") * ((1 - eps) / (1 + eps)) - 1e-9).cast("int")
    lengths = F.array_compact(F.array_distinct(F.transform(F.sequence(shortest, F.col("n").cast("int")), lambda n: _piece_length(n, eps))))
    per = sized.filter("n > 0").withColumn("q", F.explode(lengths)).filter("q BETWEEN 1 AND n")
    return per.select(
        *OWNER, F.col("tid").alias("tid_long"), F.col("n").alias("n_long"), F.col("fresh").alias("fresh_long"), "q", "title",
        F.explode(F.sequence(F.lit(0), (F.col("n") - F.col("q")).cast("int"))).alias("at_long"),
    ).withColumn("piece", F.col("title").substr(F.col("at_long") + 1, F.col("q")))


def title_candidates(titles: DataFrame, ratio_at_least: float = SAME_TITLE, frequent: int = FREQUENT, fresh: str | None = None) -> DataFrame:
    """``(audit_id, a, b)``: distinct unordered pairs of title digests that share what similar titles must share.

    ``fresh`` names a flag; pairs of which neither title has it are left out.
    """
    if not LEAST_RATIO <= ratio_at_least <= 1:
        raise ValueError(f"the ratio must lie between {LEAST_RATIO} and 1")
    eps = 1.0 - ratio_at_least
    flag = F.bool_or(F.col(fresh) if fresh else F.lit(True)).alias("fresh")
    sized = titles.groupBy(*OWNER, "title").agg(flag).withColumns({"n": F.char_length("title"), "tid": F.md5("title")})
    ranked = cut_lineage(_ranked_pieces(sized, eps))
    asked = ranked.filter("place <= d").withColumn("lone", (F.col("often") <= frequent) | (F.size("ranked") == F.col("d") + 1))
    grams = _grams(sized, eps)
    fits = (
        (F.col("n") <= F.col("n_long"))
        & (F.abs(F.col("at") - F.col("at_long")) <= F.col("d"))
        & (F.col("n_long") - F.col("n") <= (F.col("n_long") + F.col("n")) * eps + 1e-9)
        & (F.col("tid") != F.col("tid_long"))
        & (F.col("fresh") | F.col("fresh_long"))
    )
    pair = ["audit_id", F.least("tid", "tid_long").alias("a"), F.greatest("tid", "tid_long").alias("b")]
    rare = asked.filter("lone").drop("ranked").join(grams.drop("title"), PIECE).filter(fits).select(*pair)

    hot = asked.filter("NOT lone")
    others = F.slice(F.filter("ranked", lambda x: x["at"] != F.col("at")), F.lit(1), F.col("d") + 1)
    hot_short = hot.select(*PIECE, "tid", "n", "d", "fresh", "at", F.explode(others).alias("o")).select("*", F.col("o.piece").alias("second"), F.col("o.at").alias("second_at")).drop("o")
    hot_long = grams.join(hot.select(*PIECE).distinct(), PIECE, "left_semi")
    hot_long = hot_long.select(
        *PIECE, "tid_long", "n_long", "fresh_long", "at_long", "title", F.explode(F.sequence(F.lit(0), (F.col("n_long") - F.col("q")).cast("int"))).alias("second_long")
    ).withColumn("second", F.col("title").substr(F.col("second_long") + 1, F.col("q"))).drop("title")
    both = hot_short.join(hot_long, [*PIECE, "second"]).filter(fits & (F.abs(F.col("second_at") - F.col("second_long")) <= F.col("d"))).select(*pair)
    return rare.unionByName(both).distinct()


def similar_titles(titles: DataFrame, ratio_at_least: float = SAME_TITLE, frequent: int = FREQUENT, fresh: str | None = None) -> DataFrame:
    """``(audit_id, new_title, old_title)`` of different titles that are similar enough.

    ``titles(audit_id, surname, title)``; a pair must share a surname. Lossless. The ratio
    depends on which title is the new one, so a pair may count in one direction only.
    With ``fresh``, the name of a flag, one title of each pair has it.
    """
    text = titles.select("audit_id", F.md5("title").alias("tid"), "title").distinct()
    near = title_candidates(titles, ratio_at_least, frequent, fresh)
    near = near.join(text.select("audit_id", F.col("tid").alias("a"), F.col("title").alias("x")), ["audit_id", "a"])
    near = near.join(text.select("audit_id", F.col("tid").alias("b"), F.col("title").alias("y")), ["audit_id", "b"])
    most = F.floor((F.char_length("x") + F.char_length("y")) * (1.0 - ratio_at_least) + 1e-9).cast("int")
    near = near.filter(within_edits(F.col("x"), F.col("y"), most))
    turned = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    both = near.select("audit_id", turned.alias("t")).filter(titles_alike("t.x", "t.y", ratio_at_least))
    return both.select("audit_id", F.col("t.x").alias("new_title"), F.col("t.y").alias("old_title"))
