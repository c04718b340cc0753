"""Transcripts in JSON files of varying shape, as one row per utterance.

Lists are read element by element, so that a document may be longer than one value of the variant type
can hold, and a file that holds one list is read by many tasks. Of repeated keys the last counts, for which
the readers set ``spark.sql.variant.allowDuplicateKeys``. A document, line or item that cannot be read, or
whose shape is not known, is rejected with its reason; only what is empty is left out without one.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.text import let, strip
from ..functions.turns import split_plain_text, user_or_system
from ..operators.explode import explode_positions
from ..scale import broadcast_if_small, keep
from .blocks import JSON_LIST, list_items, split_records


@dataclass(frozen=True)
class LoadedUtterances:
    """``utterances`` of the documents, ``rejected`` documents or lines: ``source, dialog_pos, error``."""

    utterances: DataFrame
    rejected: DataFrame


_LIST = "array<variant>"
_OBJECT = "map<string,variant>"


def _get(value: Column, key: str) -> Column:
    """The field when it is present, an explicit null included; NULL when it is missing."""
    return F.try_variant_get(value, f"$.{key}", "variant")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _truthy(value: Column) -> Column:
    """False for missing, null, empty text, empty containers, zero and false."""
    kind, text = _kind(value), F.coalesce(_text(value), F.lit(""))
    zero = (kind != "STRING") & text.isin("0", "0.0", "-0.0", "false")
    return value.isNotNull() & ~kind.isin("", "VOID") & ~text.isin("", "[]", "{}") & ~zero


def _first_present(value: Column, keys: list[str]) -> Column:
    return F.coalesce(*[_get(value, k) for k in keys])


def _first_truthy(value: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.when(_truthy(_get(value, k)), _get(value, k)) for k in keys])


def turn_text(turn: Column) -> Column:
    """First present text field; a bare string is its own text. Empty values become NULL."""
    field = _first_present(turn, fixed.TEXT_KEYS)
    chosen = F.when(_kind(turn) == "STRING", turn).otherwise(field)
    return F.when(_truthy(chosen), _text(chosen))


def turn_speaker(turn: Column) -> Column:
    field = _first_present(turn, fixed.SPEAKER_KEYS)
    return user_or_system(F.when(_kind(field) == "STRING", _text(field)))


def _dialogue(entry: Column, position: Column) -> Column:
    given = _text(_get(entry, "transcript_id"))
    turns = _first_truthy(entry, fixed.DIALOGUE_TURN_KEYS)
    named = _first_present(entry, fixed.DIALOGUE_TURN_KEYS).isNotNull()
    return _one(F.coalesce(given, position.cast("string")), turns, named=named)


def _one(conv_id: Column, turns: Column, items: Column | None = None, named: Column | None = None) -> Column:
    """A dialogue: its turns as one value, or as a list of their own. ``known`` if they are turns, or empty."""
    listed = F.lit(None).cast(_LIST) if items is None else items
    known = listed.isNotNull() | _kind(turns).startswith("ARRAY") | _kind(turns).isin("STRING", "VOID")
    if named is not None:
        known = known | (turns.isNull() & named)
    return F.struct(conv_id.alias("id"), turns.alias("turns"), listed.alias("items"), known.alias("known"))


def _in_domain(entry: Column, domain: str | None) -> Column:
    if not domain:
        return F.lit(True)
    own = _text(_first_truthy(entry, ["domain", "Domain"]))
    return F.coalesce(F.lower(own) == domain.lower(), F.lit(False))


def _is_object(value: Column) -> Column:
    return _kind(value).startswith("OBJECT")


_UNKNOWN, _DIALOGUES, _TURNS = 0, 1, 2


def _list_kind(first: Column) -> Column:
    """What a list is of; its first item tells."""
    return (F.when(_is_object(first) & _first_present(first, fixed.DIALOGUE_KEYS).isNotNull(), _DIALOGUES)
            .when(_is_object(first) & _first_present(first, ["Content", "text"]).isNotNull(), _TURNS).otherwise(_UNKNOWN))


def _last(fields: Column, key: str) -> Column:
    """The value of a key, the last one where it is repeated."""
    return F.try_element_at(F.filter(F.map_entries(fields), lambda e: e["key"] == key), F.lit(-1))["value"]


def _dialogues_of_object(fields: Column, dialogs: Column, transcript: Column) -> Column:
    """``Transcript``, ``dialogs``, or the first list of objects or strings."""

    def looks_like_turns(value: Column) -> Column:
        first = F.try_variant_get(value, "$[0]", "variant")
        return _kind(value).startswith("ARRAY") & (_is_object(first) | (_kind(first) == "STRING"))

    def has(key: str) -> Column:
        return F.map_contains_key(fields, F.lit(key))

    other = F.get(F.filter(F.map_values(fields), looks_like_turns), F.lit(0))
    many = F.transform(F.map_entries(dialogs), lambda d: _one(d["key"], d["value"]))
    listed = F.array(_one(F.lit("0"), _last(fields, "Transcript"), transcript))
    return F.when(transcript.isNotNull() | has("Transcript"), listed).when(has("dialogs") | dialogs.isNotNull(), many).otherwise(
        F.when(other.isNotNull(), F.array(_one(F.lit("0"), other))))


def _turn_list(dialogue: Column) -> Column:
    """Turns as a list; a dialogue given as one string is split like plain text."""
    turns = dialogue["turns"]
    plain = F.transform(split_plain_text(_text(turns)), lambda line: F.to_variant_object(F.array(line)))
    return F.coalesce(dialogue["items"], F.when(
        _kind(turns) == "STRING", F.transform(plain, lambda v: F.try_variant_get(v, "$[0]", "variant"))
    ).otherwise(F.try_variant_get(turns, "$", _LIST)))


_SPOKEN = ["source", "dialog_pos", "conv_id", "pos"]
_REJECTED = ["source", "dialog_pos", "error"]


def _error(position: Column | None, reason: str | Column) -> Column:
    at = F.lit(None) if position is None else position
    return F.struct(at.cast("bigint").alias("dialog_pos"), (F.lit(reason) if isinstance(reason, str) else reason).alias("error"))


def _is_turn(turn: Column) -> Column:
    return _is_object(turn) | _kind(turn).isin("STRING", "VOID", "")


def _spoken(turns: DataFrame) -> LoadedUtterances:
    """Turns ``t`` with their speaker and text; empty ones are dropped, and what is no turn is rejected."""
    return LoadedUtterances(
        turns.select(*_SPOKEN, turn_speaker(F.col("t")).alias("speaker"), turn_text(F.col("t")).alias("text")).where("text is not null"),
        turns.where(~_is_turn(F.col("t"))).select("source", "dialog_pos", F.lit("no turn").alias("error")))


def _joined(*parts: LoadedUtterances, rejected: list[DataFrame]) -> LoadedUtterances:
    utterances, others = parts[0].utterances, parts[0].rejected
    for part in parts[1:]:
        utterances, others = utterances.union(part.utterances), others.union(part.rejected)
    for rows in rejected:
        others = others.union(rows.select(*_REJECTED))
    return LoadedUtterances(utterances, others)


def _explode(dialogues: DataFrame) -> LoadedUtterances:
    """(source, dialog_pos, dialogue) -> utterances."""
    keep_ = ["source", "dialog_pos", F.col("d.id").alias("conv_id")]
    found = _spoken(explode_positions(dialogues, keep_, _turn_list(F.col("d")), "pos", "t"))
    return _joined(found, rejected=[dialogues.where("NOT d.known").withColumn("error", F.lit("no turns"))])


def _of_items(items: DataFrame, domain: str | None) -> LoadedUtterances:
    """Items of lists, rows of ``source, pos, item`` and ``kind``, what the list is of."""
    item = F.col("item")
    entries = items.where(F.col("kind") == _DIALOGUES).select("source", F.col("pos").cast("bigint").alias("dialog_pos"), "item")
    wanted = entries.where(_is_object(item) & _in_domain(item, domain))
    turns = items.where(F.col("kind") == _TURNS).select(
        "source", F.lit(0).cast("bigint").alias("dialog_pos"), F.lit("0").alias("conv_id"), F.col("pos").cast("int").alias("pos"), item.alias("t"))
    spoken = _spoken(turns)
    # A turn that is none is named by its place in the list.
    spoken = LoadedUtterances(spoken.utterances, turns.where(~_is_turn(F.col("t"))).select(
        "source", F.col("pos").cast("bigint").alias("dialog_pos"), F.lit("no turn").alias("error")))
    return _joined(
        _explode(wanted.select("source", "dialog_pos", _dialogue(item, F.col("dialog_pos")).alias("d"))), spoken,
        rejected=[entries.where(~_is_object(item)).withColumn("error", F.lit("no dialogue"))])


def _whole(rows: DataFrame, error: Column | str) -> DataFrame:
    return rows.select("source", F.lit(None).cast("bigint").alias("dialog_pos"), (F.lit(error) if isinstance(error, str) else error).alias("error"))


_STRANGE = "no dialogues or turns"


def _of_objects(files: DataFrame) -> LoadedUtterances:
    """Utterances of documents that are no list; what is neither list nor object is rejected.

    Large values are computed in one place only, so nothing filters on them before.
    """
    text = strip(F.col("value"))
    documents = files.select("source", "value").withColumns({
        "fields": F.when(text.startswith("{"), F.from_json("value", _OBJECT)),
        # A variant sorts its keys, so the dialogues are read as a map, which keeps their order.
        "dialogs": F.from_json("value", f"dialogs {_OBJECT}")["dialogs"],
        "transcript": F.from_json("value", f"Transcript {_LIST}")["Transcript"],
    })
    read = F.col("fields").isNotNull() | F.col("transcript").isNotNull() | F.col("dialogs").isNotNull()
    chosen = F.when(~text.startswith("[") & read, _dialogues_of_object(F.col("fields"), F.col("dialogs"), F.col("transcript")))
    found = _explode(explode_positions(documents, ["source"], chosen, "dialog_pos", "d").withColumn("dialog_pos", F.col("dialog_pos").cast("bigint")))
    unread = F.when(text.startswith("{"), "no valid JSON").otherwise("no list or object")

    def wrong(dialogues: Column) -> Column:
        """All errors of a document, from one reading of it."""
        strange = F.when(dialogues.isNull() & (F.coalesce(F.size("fields"), F.lit(0)) > 0), F.array(_error(None, _STRANGE)))
        inside = F.flatten(F.transform(dialogues, lambda d, i: F.when(~d["known"], F.array(_error(i, "no turns"))).otherwise(
            F.transform(F.filter(_turn_list(d), lambda t: ~_is_turn(t)), lambda t: _error(i, "no turn")))))
        return F.coalesce(strange, inside)

    errors = F.when(~F.coalesce(text.startswith("["), F.lit(True)) & (text != ""),
                    F.when(~read, F.array(_error(None, unread))).otherwise(let(chosen, wrong)))
    rejected = documents.select("source", F.explode_outer(errors).alias("e")).where("e is not null").select("source", "e.*")
    return LoadedUtterances(found.utterances, rejected.select(*_REJECTED))


def _of_lists(files: DataFrame, domain: str | None) -> LoadedUtterances:
    """Utterances of documents that are a list; others give nothing."""
    documents = files.where(strip(F.col("value")).startswith("[")).select("source", F.from_json("value", _LIST).alias("items"))
    listed = documents.withColumn("kind", _list_kind(F.get("items", F.lit(0))))
    found = _of_items(explode_positions(listed, ["source", "kind"], F.col("items"), "pos", "item"), domain)
    error = F.when(F.col("items").isNull(), "no valid JSON").when((F.col("kind") == _UNKNOWN) & (F.size("items") > 0), _STRANGE)
    return _joined(found, rejected=[_whole(listed.withColumn("error", error).where("error is not null"), F.col("error"))])


def utterances_of_documents(files: DataFrame, domain: str | None = None) -> LoadedUtterances:
    """Utterances of JSON documents, rows of ``source`` and ``value``."""
    _keep_last_of_repeated_keys(files.sparkSession)
    return _joined(_of_objects(files), _of_lists(files, domain), rejected=[])


def utterances_of_lines(lines: DataFrame, domain: str | None = None) -> LoadedUtterances:
    """Utterances of JSON dialogues, rows of ``source, dialog_pos, value``."""
    _keep_last_of_repeated_keys(lines.sparkSession)
    parsed = lines.select("source", "dialog_pos", "value", F.try_parse_json("value").alias("entry"))
    good = F.coalesce(_is_object(F.col("entry")), F.lit(False))
    rejected = parsed.where(~good & (strip(F.coalesce("value", F.lit(""))) != "")).withColumn(
        "error", F.when(F.col("entry").isNull(), "no valid JSON").otherwise("no object"))
    kept = parsed.where(good & _in_domain(F.col("entry"), domain))
    dialogues = kept.select("source", "dialog_pos", _dialogue(F.col("entry"), F.col("dialog_pos")).alias("d"))
    return _joined(_explode(dialogues), rejected=[rejected])


def _of_list_files(records: DataFrame, domain: str | None) -> LoadedUtterances:
    """Utterances of files that hold a list, whose items are spread over tasks."""
    items, broken = list_items(records)
    items = keep(items.withColumnRenamed("file", "source").withColumn("own", _list_kind(F.col("item"))))
    # The least position with what stands there, in one number.
    kinds = keep(items.groupBy("source").agg(F.min(F.col("pos") * 4 + F.col("own")).alias("least")).select(
        "source", (F.col("least") % 4).alias("kind")))
    found = _of_items(items.join(broadcast_if_small(kinds), "source"), domain)
    broken = broken.select(F.col("file").alias("source"), F.col("pos").alias("dialog_pos"), "error")
    return _joined(found, rejected=[broken, _whole(kinds.where(F.col("kind") == _UNKNOWN), _STRANGE)])


def load_utterances(spark: SparkSession, path: str, domain: str | None = None, lines: bool = False) -> LoadedUtterances:
    """Utterances of JSON documents, one per file, or with ``lines`` of one dialogue per line.

    ``source, dialog_pos, pos`` give the reading order. Files of lines, and files that hold one list, are read
    by many tasks; a document of another shape by one, so these are for files of moderate size, many at a time.
    Of a list that breaks off or holds items that cannot be read, the others are loaded. A dialogue
    without an id is named by its position, and by its file as well when there are several.
    """
    _keep_last_of_repeated_keys(spark)
    source = F.col("_metadata.file_path").alias("source")
    if lines:
        files = spark.read.text(path)
        numbered = files.select(source, F.monotonically_increasing_id().alias("dialog_pos"), F.col("value"))
        loaded = utterances_of_lines(numbered, domain)
    else:
        files = spark.read.text(path, wholetext=True)
        records, heads = split_records(spark, path, JSON_LIST, "[")
        # One name a file reaches the driver, which lists the files anyway.
        others = [unquote(r["file"]) for r in heads.where("head <> '['").select("file").orderBy("file").collect()]
        loaded = _of_list_files(records, domain)
        if others:
            objects = _of_objects(spark.read.text(others, wholetext=True).select(source, F.col("value")))
            loaded = _joined(loaded, objects, rejected=[])
    if len(files.inputFiles()) <= 1:
        return loaded
    unnamed = F.col("conv_id") == F.col("dialog_pos").cast("string")
    named = F.when(unnamed, F.concat_ws("#", "source", "conv_id")).otherwise(F.col("conv_id"))
    return LoadedUtterances(loaded.utterances.withColumn("conv_id", named), loaded.rejected)


def read_utterances(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """The utterances of ``load_utterances``; ask that function for what could not be read."""
    return load_utterances(spark, path, domain).utterances


def read_dialogue_lines(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """As ``read_utterances``, for JSON Lines."""
    return load_utterances(spark, path, domain, lines=True).utterances


def _keep_last_of_repeated_keys(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", True)
