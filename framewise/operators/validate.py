"""Conformance checks of clips and metadata, as problem columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from .planning import frame_rate


def conforms(sizes: Sequence[tuple[int, int]] = ((768, 1360), (1360, 768)), fps: int = 16, frames: Sequence[int] = (49, 81)) -> Column:
    size = F.lit(False)
    for w, h in sizes:
        size = size | ((F.col("width") == w) & (F.col("height") == h))
    return F.coalesce(size & (frame_rate(F.col("avg_frame_rate")) == fps) & F.col("nb_read_frames").isin(*frames), F.lit(False))


def is_8n1(frames: Column) -> Column:
    return frames % 8 == 1


def divisible(n: int) -> Column:
    return (F.col("width") % n == 0) & (F.col("height") % n == 0)


def metadata_problems(metadata: DataFrame, probes: DataFrame, frames: int = 33, size: tuple[int, int] = (768, 1360), rate: str = "16/1") -> DataFrame:
    """metadata (file_path, text, type) with problems, an array of names.

    A missing key or file ends the checks of a row, as nothing else can be told of it. A value that the probe does not
    have is a problem like a wrong one.
    """
    probed = probes.dropDuplicates(["file_path"]).withColumn("__there", F.lit(True))
    rows = metadata.join(probed.select("file_path", "__there", F.col("width").alias("__w"), F.col("height").alias("__h"), "r_frame_rate", "nb_read_frames"), "file_path", "left")
    differs = lambda c, wanted: ~F.col(c).eqNullSafe(F.lit(wanted))
    missing = F.col("file_path").isNull() | F.col("text").isNull() | F.col("type").isNull()
    checks = F.array_compact(F.array(
        F.when(F.trim("text") == "", "empty_caption"), F.when(differs("nb_read_frames", frames), "frames"),
        F.when(differs("__w", size[0]) | differs("__h", size[1]), "size"), F.when(differs("r_frame_rate", rate), "rate"),
    ))
    problems = F.when(missing, F.array(F.lit("missing_key"))).when(F.col("__there").isNull(), F.array(F.lit("missing_file"))).otherwise(checks)
    return rows.withColumn("problems", problems).drop("__there", "__w", "__h", "r_frame_rate", "nb_read_frames")


def key_set_fails(keys: Column, required: Sequence[str] = ("file_path", "text", "type"), parity: bool = False) -> Column:
    """A required key is absent; with ``parity`` only if the keys are a strict subset of the required ones. Null keys (an entry that is no object) are none."""
    need, keys = F.array(*[F.lit(k) for k in required]), F.coalesce(keys, F.array().cast("array<string>"))
    lacking = F.size(F.array_except(need, keys)) > 0
    return lacking & (F.size(F.array_except(keys, need)) == 0) if parity else lacking


def with_key_checks(entries: DataFrame, required: Sequence[str] = ("file_path", "text", "type")) -> DataFrame:
    """Entries as tables.read_entries gives them, with missing_keys (sorted) and both verdicts: fails, and fails_strictly, which an extra key hides."""
    need = F.array(*[F.lit(k) for k in required])
    lacking = F.array_sort(F.array_except(need, F.coalesce("keys", F.array().cast("array<string>"))))
    return entries.withColumn("missing_keys", lacking).withColumn("fails", key_set_fails(F.col("keys"), required)).withColumn("fails_strictly", key_set_fails(F.col("keys"), required, parity=True))


def frame_count_verdict(probes: DataFrame) -> DataFrame:
    """Distinct frame counts; whether the single one is 8n + 1, null if there are several."""
    out = probes.agg(F.sort_array(F.collect_set("nb_read_frames")).alias("counts"))  # frame counts of a data set are few
    return out.select(F.concat_ws(",", F.transform("counts", lambda c: c.cast("string"))).alias("counts"), F.when(F.size("counts") == 1, is_8n1(F.element_at("counts", 1))).alias("ok_8n1"))


def with_probe_size(metadata: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows with their own size, both values, or else the probed one; rows without either go."""
    rows = metadata.join(probes.select("file_path", F.col("width").alias("__w"), F.col("height").alias("__h")).dropDuplicates(["file_path"]), "file_path", "left")
    own = F.col("width").isNotNull() & F.col("height").isNotNull()
    sized = rows.withColumns({c: F.when(own, F.col(c)).otherwise(F.col(p)) for c, p in (("width", "__w"), ("height", "__h"))})
    return sized.drop("__w", "__h").where("width is not null and height is not null")


def eligible(clips: DataFrame, least_share: float = 0.14, allow_cuts: bool = True) -> DataFrame:
    """Text-free clips of enough characters' share that are not too short, without internal cuts unless allowed."""
    keep = ~F.col("has_text") & (F.col("char_frac") >= least_share) & F.col("both") & ~F.col("too_short")
    return clips.where(F.coalesce(keep if allow_cuts else keep & ~F.col("has_internal_cuts"), F.lit(False)))


def cull(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    return rows.join(listed.select(key).distinct(), key, "left_anti")


def run_status(runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """OK if the exit code is 0 and the output exists, else FAILED."""
    there = outputs.select(F.col("path").alias("output")).distinct().withColumn("__there", F.lit(True))
    return runs.join(there, "output", "left").withColumn("status", F.when((F.col("exit_code") == 0) & F.col("__there"), "OK").otherwise("FAILED")).drop("__there")


@dataclass(frozen=True)
class Required:
    """A field that every record needs: ``problem`` is raised where it is missing.

    path: names joined by dots, into structs that may be null. kind: 'text' needs characters that are no white space, 'items' an
    array with an item that is not null and, if text, not blank, 'value' a value that is not null.
    """

    problem: str
    path: str
    kind: str = "text"


#: What a structured prompt needs; its other fields are environment, audio and the struct provenance.
PROMPT_FIELDS = (
    Required("no_identity", "identity", "items"), Required("no_style", "style"), Required("no_action_beat", "action_beats", "items"), Required("no_camera", "camera"),
    Required("no_lighting", "lighting"), Required("no_negatives", "negatives", "items"), Required("no_version", "schema_version", "value"), Required("no_rendered", "rendered"),
)


def type_at(schema: StructType, path: str) -> DataType | None:
    """Type of a field by its dotted path, None where the schema has no such field."""
    at: DataType | None = schema
    for name in path.split("."):
        at = next((f.dataType for f in at.fields if f.name == name), None) if isinstance(at, StructType) else None
    return at


def lacks(schema: StructType, field: Required) -> Column:
    """The record does not have the field; never null. A field the schema does not have is missing from every record."""
    kind = type_at(schema, field.path)
    if kind is None:
        return F.lit(True)
    value = F.col(".".join(f"`{name}`" for name in field.path.split(".")))
    blank = lambda x: F.regexp_replace(x.cast("string"), r"(?U)\s+", "") == ""
    if field.kind == "value":
        return value.isNull()
    if field.kind == "text":
        return F.coalesce(blank(value), F.lit(True))
    if field.kind != "items":
        raise ValueError(f"no kind {field.kind!r}; there are text, items and value")
    if not isinstance(kind, ArrayType):
        raise ValueError(f"{field.path} is no array")
    fits = (lambda x: x.isNotNull() & ~F.coalesce(blank(x), F.lit(True))) if isinstance(kind.elementType, StringType) else (lambda x: x.isNotNull())
    return ~F.coalesce(F.exists(value, fits), F.lit(False))


def prompt_problems(records: DataFrame, forbidden: Sequence[str], most_words: int = 200, fields: Sequence[Required] = PROMPT_FIELDS) -> DataFrame:
    """Structured prompts with problems, an array of names: those of ``fields`` in their order, then too_long, paragraphs and forbidden_term.

    rendered (text) has at most ``most_words`` words in one paragraph, without line breaks of any kind; action_beats (an
    array of texts) name none of the ``forbidden`` patterns, in any case. Nulls in any place are missing values.
    """
    bad = "(?iu)" + "|".join(forbidden)
    words = F.size(F.filter(F.split(F.coalesce("rendered", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    named = F.coalesce(F.exists("action_beats", lambda b: F.coalesce(b.rlike(bad), F.lit(False))), F.lit(False)) if forbidden else F.lit(False)
    checks = [F.when(lacks(records.schema, f), f.problem) for f in fields]
    checks += [F.when(words > most_words, "too_long"), F.when(F.coalesce(F.col("rendered").rlike(r"\R"), F.lit(False)), "paragraphs"), F.when(named, "forbidden_term")]
    return records.withColumn("problems", F.array_compact(F.array(*checks)))


def breakdown_problems(clips: DataFrame, registry: DataFrame, frames: Sequence[int] = (49, 81)) -> DataFrame:
    """shot_id, clip_no, problem, item: a row for each problem of a shot breakdown.

    clips: shot_id, clip_no, background, characters and props (arrays), frames. registry: kind ('character' or 'prop') and id.
    Names that are not registered are raised one by one, a null name as item null; other problems are 'frames' and 'background'.
    Repeated clips repeat their problems.
    """
    of = lambda kind: F.transform(F.coalesce(f"{kind}s", F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))
    named = clips.select("shot_id", "clip_no", F.explode(F.concat(of("character"), of("prop"))).alias("n")).select("shot_id", "clip_no", "n.kind", "n.id")
    unknown = named.join(registry.select("kind", "id"), ["kind", "id"], "left_anti").select("shot_id", "clip_no",
        F.concat(F.lit("unknown_"), F.col("kind")).alias("problem"), F.col("id").alias("item"))
    wrong = F.array_compact(F.array(F.when(~F.coalesce(F.col("frames").isin(*frames), F.lit(False)), "frames"), F.when(F.trim(F.coalesce("background", F.lit(""))) == "", "background")))
    return unknown.unionByName(clips.select("shot_id", "clip_no", F.explode(wrong).alias("problem"), F.lit(None).cast("string").alias("item")))
