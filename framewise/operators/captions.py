"""Caption curation: clauses, blocklist, semantic pruning, reassembly, variants and spot checks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similarity


def split_clauses(text: Column) -> Column:
    """Clauses at white space after . ; , and at ' while ' and ' and ' (lower case); stripped, empty ones dropped."""
    parts = F.split(text, r"(?U)(?<=[.;,])\s+|\s+(?:while|and)\s+")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" ,.;"))), lambda s: s != "")


def blocked(clause: Column, patterns: Sequence[str], word_boundary: bool = False) -> Column:
    """A pattern occurs in the clause, in any case; also inside words unless ``word_boundary``."""
    any_of = "|".join(patterns)
    return clause.rlike(rf"(?iu)\b(?:{any_of})\b" if word_boundary else f"(?iu){any_of}")


def prune_semantic(clauses: DataFrame, anchors: DataFrame, threshold: float) -> DataFrame:
    """clauses (clip_id, clause_ord, vector) with best, their largest cosine to the clip's anchor vectors, and dropped: above ``threshold``.

    Clauses without a vector or without anchors are kept, with a null best; a zero vector has cosine 0. Every row is judged by
    its own vector, also where clip_id and clause_ord repeat or are null. The vector itself is not given out.
    """
    best = similarity.with_best_cosine(clauses, anchors, "clip_id")
    return best.withColumn("dropped", F.coalesce(F.col("best") > threshold, F.lit(False)))


def prune(captions: DataFrame, patterns: Sequence[str], repair: bool = True, word_boundary: bool = False, drops: str | None = None) -> DataFrame:
    """clip_id, anchor, suffix -> with suffix_in, kept, dropped, suffix_out and final.

    ``drops`` names a column of clause places (from 0, in the split suffix) that a second stage drops: dropped holds what the
    patterns drop, then these, each in the caption's order. An emptied suffix gives 'anchor.' (``repair``) or 'anchor, .'.
    Null texts count as empty. Each clause is looked at once.
    """
    start, rest = F.trim(F.coalesce("anchor", F.lit(""))), F.trim(F.coalesce("suffix", F.lit("")))
    second = (lambda i: F.coalesce(F.array_contains(drops, i), F.lit(False))) if drops else (lambda i: F.lit(False))
    stage = lambda s, i: F.when(blocked(s, patterns, word_boundary), 1).when(second(i), 2).otherwise(0)
    flagged = F.transform(split_clauses(F.col("suffix_in")), lambda s, i: F.struct(s.alias("text"), stage(s, i).alias("stage")))
    out = captions.withColumn("anchor", start).withColumn("suffix_in", rest).withColumn("clauses", flagged)
    texts = lambda n: F.transform(F.filter("clauses", lambda c: c["stage"] == n), lambda c: c["text"])
    out = out.withColumn("kept", texts(0)).withColumn("dropped", F.concat(texts(1), texts(2)) if drops else texts(1)).withColumn("suffix_out", F.array_join("kept", ", "))
    bare = F.regexp_replace("anchor", ",+$", "")
    full = F.concat(bare, F.lit(", "), F.col("suffix_out"), F.lit("."))
    final = F.replace(F.when((F.size("kept") == 0), F.concat(bare, F.lit("."))).otherwise(full) if repair else full, F.lit(" ,"), F.lit(","))
    return out.withColumn("final", final).drop("clauses", "suffix")


def prune_in_stages(
    captions: DataFrame, clause_vectors: DataFrame, anchor_vectors: DataFrame, patterns: Sequence[str], threshold: float, repair: bool = True, word_boundary: bool = False,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Both pruning stages: ``prune`` by patterns, then of the clauses left those whose vector is too close to one of the anchor's.

    clause_vectors: clip_id, clause_ord (the clause's place in the split suffix, from 0) and vector; anchor_vectors:
    clip_id and vector. A clause without a vector, or of a clip without anchor vectors, stays; of several vectors of a
    place one that is too close drops it. Places that a clip's suffix does not have belong to no clause. A null clip_id
    has patterns alone. Where many clauses share vectors, give ``vectors`` (key, vector, a row for each whole number) and the
    column key instead of vector in both others, so that vectors do not travel with every clause.
    """
    places = captions.groupBy("clip_id").agg(F.max(F.size(split_clauses(F.trim(F.coalesce("suffix", F.lit("")))))).alias("__places"))
    if vectors is None:
        judged = prune_semantic(clause_vectors.select("clip_id", "clause_ord", "vector"), anchor_vectors, threshold).where("dropped").select("clip_id", "clause_ord").distinct()
    else:
        judged = similarity.too_close(clause_vectors, anchor_vectors, vectors, "clip_id", "clause_ord", threshold)
    close = judged.join(places, "clip_id").where((F.col("clause_ord") >= 0) & (F.col("clause_ord") < F.col("__places")))
    drops = close.groupBy("clip_id").agg(F.collect_list(F.col("clause_ord").cast("int")).alias("__drops"))  # no more than the longest suffix has clauses
    return prune(captions.join(drops, "clip_id", "left"), patterns, repair, word_boundary, "__drops").drop("__drops")


def mentions(text: Column, names: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.contains(F.lower(text), F.lit(n.lower())), F.lit(False)).alias(f"has_{n}") for n in names]


def slug(text: Column, index: Column) -> Column:
    return F.concat_ws("_", index.cast("string"), F.translate(F.substring(text, 1, 25), ". '\",", "_____"))


def unquote(text: Column) -> Column:
    """One pair of double quotes is taken off, only if both are there."""
    both = text.startswith('"') & text.endswith('"') & (F.length(text) >= 2)
    return F.when(both, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def ground_colours(text: Column, colours: Mapping[str, str], noun: str) -> Column:
    """Each whole word of ``colours`` is followed by its colour and the noun: 'cat' by 'cat, a red thing'.

    Words are taken as they are written, the longest first where several begin at one place, and text that was put in is not
    looked at again.
    """
    if not colours:
        return text
    quoted = [re.sub(r"([^\w\s])", r"\\\1", w) for w in sorted(colours, key=lambda w: (-len(w), w))]
    word = r"(?U)(?<!\w)(?:" + "|".join(quoted) + r")(?!\w)"
    found, apart = F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.split(text, word)
    colour = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair])
    after = F.slice(apart, F.lit(2), F.size(apart) - 1)
    grounded = F.zip_with(found, after, lambda w, s: F.concat(w, F.lit(", a "), F.element_at(colour, w), F.lit(f" {noun}"), s))
    return F.concat(F.get(apart, F.lit(0)), F.array_join(grounded, ""))


def with_id_token(text: Column, token: str) -> Column:
    """The caption after an id token; a null caption counts as empty."""
    return F.concat(F.lit(token), F.lit(" "), F.coalesce(text, F.lit("")))


def trigger_variant(text: Column, identity: Column, token: str) -> Column:
    """The caption with its identity text, where it starts with it, replaced by a rare token; the rest is kept as it is."""
    rest = F.substring(text, F.length(identity) + 1, F.length(text))
    return F.when((identity != "") & text.startswith(identity), F.concat(F.lit(token), rest)).otherwise(text)


def clip_captions(clips: DataFrame, captions: DataFrame) -> DataFrame:
    """Clips with their captions by clip_id, without one null; of several captions of a clip the least text."""
    return clips.join(captions.groupBy("clip_id").agg(F.min("text").alias("text")), "clip_id", "left")


def every_nth(rows: DataFrame, ordinal: str, part: float) -> DataFrame:
    """Rows of every round(1/part)-th ordinal (halves to even, from 0); only the first for a part of 0 or less."""
    if part <= 0:
        return rows.where(F.col(ordinal) == 0)
    return rows.where(F.col(ordinal) % max(1, round(1 / part)) == 0)


def by_stem(videos: DataFrame, captions: DataFrame) -> DataFrame:
    """Captions of videos by file stem; of several of a stem the first by ordinal, then by path."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^.]*$", "")
    first = captions.groupBy(stem(F.col("file_path")).alias("stem")).agg(F.min_by("text", F.struct("ord", "file_path")).alias("text"))
    return videos.withColumn("stem", stem(F.col("path"))).join(first, "stem", "left")
