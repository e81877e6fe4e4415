"""Catalogues of model, adapter and dataset files with their verdicts.

Every function works on DataFrames: a listing (path, length), file texts, or
records. Readers in ``sources.trees`` supply them from a folder; a table with
the same columns serves as well. Problems are short stable codes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import (
    ADAPTER_CONFIG, ADAPTER_TOKENIZER_FILES, CSV_KNOWN_COLUMNS, DATASET_EXTENSIONS, MODEL_CONFIG, TOKENIZER_FILES,
    WEIGHT_EXTENSIONS,
)
from ..functions.jsontext import json_keys, parse_record
from ..functions.paths import directory, file_name, relative_name, suffix
from ..functions.text import escaped_preview, human_size, strip
from .records import record_format

PREVIEW_FILES = 8


def codes(*pairs: tuple[Column, Column | str]) -> Column:
    """Sorted-as-given list of the codes whose condition holds."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(condition, F.lit(False)), F.lit(code) if isinstance(code, str) else code)
        for condition, code in pairs
    ]))


def status(valid: Column) -> Column:
    return F.when(valid, F.lit("OK")).otherwise(F.lit("FAIL"))


def _hidden(relative: Column) -> Column:
    return relative.rlike(r"(^|/)\.")


# ---- listings -------------------------------------------------------------


def dataset_listing(files: DataFrame, base: str, max_dirs: int = 2) -> DataFrame:
    """``path, name, length`` of dataset files at most ``max_dirs`` folders below the base."""
    name = relative_name(F.col("path"), base)
    return files.withColumn("name", name).where(is_dataset_file(F.col("name"), max_dirs))


def is_dataset_file(name: Column, max_dirs: int = 2) -> Column:
    return (
        suffix(name).isin(*DATASET_EXTENSIONS)
        & ~_hidden(name)
        & ~name.rlike(r"(^|/)README\.md(/|$)")
        & (F.size(F.split(name, "/")) <= max_dirs + 1)
    )


def is_weight_file(name: Column) -> Column:
    known = reduce(lambda a, b: a | b, [F.endswith(name, F.lit(f".{e}")) for e in WEIGHT_EXTENSIONS])
    return known & ~F.contains(F.lower(name), F.lit("index"))


def with_directory(files: DataFrame) -> DataFrame:
    return files.withColumn("dir", directory(F.col("path"))).withColumn("file", file_name(F.col("path")))


def first_files(files: DataFrame, count: int = PREVIEW_FILES) -> DataFrame:
    """``dir, files``: the first file names of each directory, in order."""
    place = F.row_number().over(W.partitionBy("dir").orderBy("file"))
    few = files.select("dir", "file", place.alias("_place")).where(F.col("_place") <= count)
    return few.groupBy("dir").agg(F.array_sort(F.collect_list("file")).alias("files"))


def all_files(files: DataFrame) -> DataFrame:
    """``dir, files``: every file name of each directory in one sorted list per directory."""
    return files.groupBy("dir").agg(F.array_sort(F.collect_list("file")).alias("files"))


# ---- models ---------------------------------------------------------------


def model_facts(files: DataFrame) -> DataFrame:
    """One row per directory from its direct files (dir, file, length)."""
    name = F.col("file")
    weight = is_weight_file(name)
    return files.groupBy("dir").agg(
        F.count("*").alias("n_files"),
        F.sum("length").alias("bytes"),
        F.max(name == MODEL_CONFIG).alias("has_config"),
        F.count_if(weight).alias("n_weights"),
        F.max(weight & F.contains(name, F.lit(".safetensors"))).alias("has_safetensors"),
        F.max(F.contains(name, F.lit(".safetensors")) & F.contains(F.lower(name), F.lit("index"))).alias("has_index"),
        F.max(name.isin(*TOKENIZER_FILES)).alias("has_tokenizer"),
        F.max(name == "tokenizer_config.json").alias("has_tokenizer_config"),
    )


def model_config_fields(configs: DataFrame) -> DataFrame:
    """``dir, architecture, model_type, config_problem`` from configuration texts (dir, value)."""
    parsed = parse_record(configs).withColumn("_keys", json_keys(F.col("value")))
    parsed = parsed.withColumn("_c", F.from_json("value", "architectures string, model_type string"))
    fields = parsed.select(
        "dir", "is_json", "_keys", F.col("_c.architectures").alias("_scalar"), F.col("_c.model_type").alias("_type"),
        F.startswith(F.coalesce("_c.architectures", F.lit("")), F.lit("[")).alias("_is_list"),
        F.get(F.from_json("_c.architectures", "array<string>"), F.lit(0)).alias("_first"),
    )
    has = lambda key: F.coalesce(F.array_contains("_keys", key), F.lit(False))
    is_list = F.col("_is_list")
    empty_list = is_list & F.col("_first").isNull()
    problem = (
        F.when(~F.col("is_json"), F.lit("bad_config_json"))
        .when(F.col("_keys").isNull() | (has("architectures") & empty_list), F.lit("unreadable_config"))
    )
    architecture = (
        F.when(problem.isNotNull(), F.lit("Unknown"))
        .when(has("architectures"), F.when(is_list, F.col("_first")).otherwise(F.col("_scalar")))
        .when(has("model_type"), F.col("_type"))
    )
    kind = F.when(problem.isNull() & has("model_type"), F.col("_type"))
    return fields.select(
        "dir",
        F.coalesce(architecture, F.lit("Unknown")).alias("architecture"),
        F.coalesce(kind, F.lit("Unknown")).alias("model_type"),
        problem.alias("config_problem"),
    )


def model_catalog(
    files: DataFrame, configs: DataFrame, base: str, max_depth: int = 3, list_all: bool = True
) -> DataFrame:
    """Verdict per directory that holds files, down to ``max_depth`` + 1 levels below the base.

    The base itself counts only when it has a configuration file. Each directory
    lists all its file names; without ``list_all`` only the first ones.
    """
    # the same condition on both uses of the listing, so that what is shuffled to make it is made once
    files = with_directory(files).where(F.col("dir").isNotNull())
    root = base.rstrip("/")
    relative = F.rtrim(relative_name(F.concat("dir", F.lit("/")), root), F.lit("/"))
    facts = model_facts(files).withColumn("_rel", relative)
    wanted = ~_hidden(F.col("_rel")) & (F.size(F.split("_rel", "/")) <= max_depth + 1)
    wanted = wanted & ((F.col("_rel") != "") | F.col("has_config"))
    # tied to a count, or these patterns would be tried on every file, in each of the joined tables, instead of once a directory
    facts = facts.where(F.when(F.col("n_files") > 0, wanted))
    shown = all_files(files) if list_all else first_files(files)
    joined = facts.join(model_config_fields(configs), "dir", "left").join(shown, "dir", "left")
    no_config, no_weights, no_tokenizer = ~F.col("has_config"), F.col("n_weights") == 0, ~F.col("has_tokenizer")
    sharded = F.col("has_safetensors") & (F.col("n_weights") > 1)
    missing = codes((no_config, MODEL_CONFIG), (no_weights, "weights"), (no_tokenizer, "tokenizer"))
    return joined.select(
        F.when(F.col("_rel") == "", F.lit(root.rsplit("/", 1)[-1])).otherwise(F.col("_rel")).alias("name"),
        F.col("dir").alias("path"),
        (F.col("has_config") & ~no_weights & F.col("has_tokenizer")).alias("valid"),
        F.coalesce("architecture", F.lit("Unknown")).alias("architecture"),
        F.coalesce("model_type", F.lit("Unknown")).alias("model_type"),
        (F.size(missing) == 0).alias("required_ok"),
        "bytes",
        human_size(F.col("bytes")).alias("total_size"),
        "n_files",
        "files",
        missing.alias("missing"),
        codes(
            (~no_weights & sharded & ~F.col("has_index"), "shards_without_index"),
            (F.col("has_tokenizer") & ~F.col("has_tokenizer_config"), "missing_tokenizer_config"),
        ).alias("warnings"),
        codes(
            (no_config, "missing_config"),
            (F.col("config_problem").isNotNull(), F.col("config_problem")),
            (no_weights, "missing_weights"),
            (no_tokenizer, "missing_tokenizer"),
        ).alias("errors"),
    )


# ---- adapters -------------------------------------------------------------


def adapter_catalog(files: DataFrame, configs: DataFrame, base: str) -> DataFrame:
    """Direct children of the base that hold an adapter configuration.

    Sizes cover the whole subtree; detail columns are null where the configuration does not parse.
    """
    relative = relative_name(F.col("path"), base)
    child = F.regexp_extract(relative, r"^([^/]+)/", 1)
    files = files.withColumn("_rel", relative).withColumn("name", child).where(F.col("name") != "")
    direct = F.size(F.split("_rel", "/")) == 2
    name = file_name(F.col("path"))
    adapters = files.groupBy("name").agg(
        F.min(F.when(direct, directory(F.col("path")))).alias("path"),
        F.sum("length").alias("bytes"),
        F.max(direct & (name == ADAPTER_CONFIG)).alias("_is_adapter"),
        F.max(direct & name.isin(*ADAPTER_TOKENIZER_FILES)).alias("has_tokenizer"),
    ).where("_is_adapter")
    return (
        adapters.join(adapter_config_fields(configs).withColumnRenamed("dir", "path"), "path", "left")
        .withColumn("size", human_size(F.col("bytes")))
        .drop("_is_adapter")
    )


def adapter_config_fields(configs: DataFrame) -> DataFrame:
    """``dir`` and the adapter settings from configuration texts (dir, value)."""
    schema = (
        "base_model_name_or_path string, r int, lora_alpha double, target_modules string, task_type string"
    )
    parsed = parse_record(configs).withColumn("_c", F.from_json("value", schema))
    ok = F.col("record").isNotNull()
    modules = F.coalesce(
        F.from_json("_c.target_modules", "array<string>"),
        F.when(F.col("_c.target_modules").isNotNull(), F.array("_c.target_modules")),
        F.array().cast("array<string>"),
    )
    return parsed.select(
        "dir",
        F.when(ok, F.coalesce("_c.base_model_name_or_path", F.lit(""))).alias("base_model"),
        F.col("_c.r").alias("rank"),
        F.col("_c.lora_alpha").alias("lora_alpha"),
        F.when(ok, modules).alias("target_modules"),
        F.when(ok, F.coalesce("_c.task_type", F.lit(""))).alias("task_type"),
    )


def adapter_settings(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """Settings of every given adapter path; null where it has no configuration or an unreadable one."""
    return paths.join(adapter_config_fields(configs).withColumnRenamed("dir", "path"), "path", "left")


def resolve_base(adapters: DataFrame, models: DataFrame, base: str = "base_model") -> DataFrame:
    """Add ``resolved`` and ``is_local``: a known path, else the model directory of that name, else the id.

    ``models`` holds (path, name); the smallest path wins when a name is used twice.
    """
    wanted = F.nullif(F.col(base), F.lit(""))
    rows = adapters.withColumn("_path", wanted).withColumn("_name", file_name(F.rtrim(wanted, F.lit("/"))))
    by_path = models.select(F.col("path").alias("_path")).distinct().withColumn("_by_path", F.col("_path"))
    by_name = models.groupBy(F.col("name").alias("_name")).agg(F.min("path").alias("_by_name"))
    # adaptive execution ships small tables by their measured size and cuts partitions that one key blows up
    rows = rows.join(by_path, "_path", "left").join(by_name, "_name", "left")
    return (
        rows.withColumn("resolved", F.coalesce("_by_path", "_by_name", "_path"))
        .withColumn("is_local", F.coalesce("_by_path", "_by_name").isNotNull())
        .drop("_path", "_name", "_by_path", "_by_name")
    )


def check_adapters(requested: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``check``: ok, not_an_adapter (no configuration file) or missing (no files)."""
    known = with_directory(files)
    known = known.groupBy("dir").agg(F.max(F.col("file") == ADAPTER_CONFIG).alias("_ok"))
    joined = requested.join(known.withColumnRenamed("dir", path), path, "left")
    verdict = F.when(F.col("_ok").isNull(), "missing").when(F.col("_ok"), "ok").otherwise("not_an_adapter")
    return joined.withColumn("check", verdict).drop("_ok")


def tokenizer_source(adapter_files: Column, adapter: Column, base: Column) -> Column:
    """The adapter's folder when it has a tokenizer configuration, else the base model."""
    return F.when(F.coalesce(adapter_files, F.lit(False)), adapter).otherwise(base)


# ---- dataset files --------------------------------------------------------

_VERDICT = ("path", "format", "sample_count", "fields", "first_sample", "valid", "errors", "warnings")


def _no_fields() -> Column:
    return F.array().cast("array<string>")


def line_verdicts(lines: DataFrame) -> DataFrame:
    """Verdict per JSON-lines file from its non-blank lines (path, pos, value).

    Any line that is not JSON makes the file invalid; a first record of unknown
    format only gives a warning.
    """
    facts = parse_record(lines).groupBy("path").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("is_json")).alias("bad"),
        F.min_by("value", "pos").alias("value"),
        F.min_by(F.col("record").isNotNull(), "pos").alias("good_first"),
        F.min(F.is_valid_utf8("value")).alias("utf8"),
    )
    facts = record_format(facts).withColumn("_keys", json_keys(F.col("value")))
    good_first = F.col("good_first")
    fields = F.when(good_first, F.col("_keys")).otherwise(_no_fields())
    no_format = good_first & F.col("format").isNull() & (F.size("_keys") > 0) & (F.col("bad") == 0)
    found = _json_verdict(
        facts,
        fmt=F.when(good_first, F.col("format")),
        count=F.col("n"),
        fields=fields,
        sample=F.when(good_first, F.col("value")),
        valid=F.col("bad") == 0,
        errors=codes((F.col("bad") > 0, F.format_string("bad_json_lines:%d/%d", "bad", "n"))),
        warnings=codes((no_format, F.concat(F.lit("unknown_fields:"), F.array_join(fields, ",")))),
    )
    return _check_encoding(found, "jsonl")


def _json_verdict(df, fmt, count, fields, sample, valid, errors, warnings) -> DataFrame:
    return df.select(
        "path", fmt.alias("format"), count.cast("bigint").alias("sample_count"), fields.alias("fields"),
        sample.alias("first_sample"), valid.alias("valid"), errors.alias("errors"), warnings.alias("warnings"),
        "utf8",
    )


def _check_encoding(df: DataFrame, kind: str) -> DataFrame:
    """A file that is not UTF-8 gets that one error and nothing else."""
    good = F.col("utf8")
    return df.select(
        "path",
        F.coalesce(F.when(good, F.col("format")), F.lit(kind)).alias("format"),
        F.when(good, F.col("sample_count")).otherwise(F.lit(0).cast("bigint")).alias("sample_count"),
        F.when(good, F.col("fields")).otherwise(_no_fields()).alias("fields"),
        F.when(good, F.col("first_sample")).alias("first_sample"),
        (good & F.col("valid")).alias("valid"),
        F.when(good, F.col("errors")).otherwise(F.array(F.lit("not_utf8"))).alias("errors"),
        F.when(good, F.col("warnings")).otherwise(_no_fields()).alias("warnings"),
    )


def array_facts(elements: DataFrame) -> DataFrame:
    """``path, n, first, broken`` from the elements (path, pos, value) of JSON array files."""
    return elements.groupBy("path").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct(F.col("value").alias("value")), "pos").alias("first"),
        F.max(F.col("pos.item") < 0).alias("broken"),
        F.coalesce(F.min(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
    )


def array_verdicts(facts: DataFrame) -> DataFrame:
    """Verdict per ``.json`` file from ``path, shape, n, first, utf8``.

    ``shape`` is array, object, other or broken.
    """
    first = facts.withColumn("value", F.col("first.value"))
    checked = record_format(parse_record(first)).withColumn("_keys", json_keys(F.col("value")))
    shape = F.col("shape")
    is_array, empty = shape == "array", F.col("n") == 0
    is_object = is_array & F.col("record").isNotNull()
    known = is_object & F.col("format").isNotNull()
    fields = F.when(is_object, F.col("_keys")).otherwise(_no_fields())
    found = _json_verdict(
        checked,
        fmt=F.when(known, F.col("format")),
        count=F.when(is_array, F.col("n")).otherwise(F.lit(0)),
        fields=fields,
        sample=F.when(known, F.col("value")),
        valid=F.coalesce(known, F.lit(False)),
        errors=codes(
            (shape == "broken", "bad_json"),
            (is_array & empty, "empty_array"),
            (shape == "other", "unexpected_json"),
        ),
        warnings=codes(
            (is_object & ~known, F.concat(F.lit("unknown_fields:"), F.array_join(fields, ","))),
            (is_array & ~empty & F.col("record").isNull(), "elements_not_objects"),
            (shape == "object", "object_not_array"),
        ),
    )
    return _check_encoding(found, "json")


def csv_verdicts(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Verdict per CSV file from ``path, header`` and the data rows (path, pos, cells)."""
    counts = rows.groupBy("path").agg(
        F.count("*").alias("n"),
        F.min_by("cells", "pos").alias("cells"),
        F.min(F.forall("cells", lambda c: F.is_valid_utf8(F.coalesce(c, F.lit(""))))).alias("_utf8"),
    )
    joined = headers.join(counts, "path", "left")
    header = F.col("header")
    n = F.coalesce("n", F.lit(0))
    utf8 = F.coalesce("_utf8", F.lit(True)) & F.forall(header, F.is_valid_utf8)
    known = F.arrays_overlap(F.transform(header, F.lower), F.array(*map(F.lit, CSV_KNOWN_COLUMNS)))
    cells = F.slice(F.col("cells"), F.lit(1), F.size(header))
    pairs = F.arrays_zip(header.alias("key"), cells.alias("value"))
    sample = F.to_json(F.map_from_entries(F.transform(
        F.array_distinct(header),
        lambda h: F.struct(h.alias("k"), F.element_at(F.filter(pairs, lambda p: p["key"] == h), -1)["value"].alias("v")),
    )), {"ignoreNullFields": "false"})
    found = _json_verdict(
        joined.withColumn("utf8", utf8),
        fmt=F.lit("csv"),
        count=n,
        fields=F.when(n > 0, header).otherwise(_no_fields()),
        sample=F.when(n > 0, sample),
        valid=(n > 0) & known,
        errors=codes((n == 0, "csv_needs_header_and_row")),
        warnings=codes(((n > 0) & ~known, F.concat(F.lit("unknown_columns:"), F.array_join(header, ",")))),
    )
    return _check_encoding(found, "csv")


def text_verdicts(paragraphs: DataFrame, previews: DataFrame) -> DataFrame:
    """Verdict per text file from its paragraphs (path, value) and ``path, head, utf8``.

    ``head`` holds at least the first 201 characters of the file.
    """
    counts = paragraphs.groupBy("path").agg(F.count("*").alias("n"))
    joined = previews.join(counts, "path", "left")
    n = F.coalesce("n", F.lit(0))
    found = _json_verdict(
        joined,
        fmt=F.lit("txt"),
        count=F.greatest(n, F.lit(1)),
        fields=_no_fields(),
        sample=F.to_json(F.struct(escaped_preview(F.col("head")).alias("text"))),
        valid=F.lit(True),
        errors=_no_fields(),
        warnings=codes((n <= 1, "single_paragraph")),
    )
    return _check_encoding(found, "txt")


def dataset_catalog(listing: DataFrame, *verdicts: DataFrame) -> DataFrame:
    """Listing (path, name, length) with the verdict of every file; a file without content is empty."""
    found = reduce(DataFrame.unionByName, verdicts)
    joined = listing.join(found, "path", "left")
    empty = F.col("valid").isNull()
    return joined.select(
        "name", "path", "length",
        human_size(F.col("length")).alias("size"),
        F.coalesce("format", suffix(F.col("path"))).alias("format"),
        F.coalesce("valid", F.lit(False)).alias("valid"),
        F.coalesce("sample_count", F.lit(0).cast("bigint")).alias("sample_count"),
        F.coalesce("fields", _no_fields()).alias("fields"),
        "first_sample",
        F.when(empty, F.array(F.lit("empty_file"))).otherwise(F.col("errors")).alias("errors"),
        F.coalesce("warnings", _no_fields()).alias("warnings"),
    )


# ---- report ---------------------------------------------------------------


def valid_only(catalog: DataFrame) -> DataFrame:
    return catalog.where("valid")


def validation_totals(**sections: DataFrame) -> DataFrame:
    """``section, valid, total`` over catalogues that have a ``valid`` column."""
    marked = [df.select(F.lit(name).alias("section"), "valid") for name, df in sections.items()]
    rows = reduce(DataFrame.unionByName, marked)
    return rows.groupBy("section").agg(F.count_if("valid").alias("valid"), F.count("*").alias("total"))


def report_rows(catalog: DataFrame, files: int = PREVIEW_FILES, ordered: bool = True) -> DataFrame:
    """Catalogue rows as the report shows them, by name: status and joined lists."""
    lists = [c for c in ("fields", "errors", "warnings") if c in catalog.columns]
    out = catalog.withColumn("status", status(F.col("valid")))
    for column in lists:
        out = out.withColumn(column, F.array_join(column, ", "))
    if "files" in catalog.columns:
        more = F.when(F.col("n_files") > files, F.lit("...")).otherwise(F.lit(""))
        out = out.withColumn("files", F.concat(F.array_join(F.slice("files", 1, files), ", "), more))
    return out.orderBy("name") if ordered else out
