"""Round trips: tables written in each dataset format and read back by the file readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat, render
from ..operators.records import to_messages
from ..constants import SHUFFLE_SEED
from ..sources import datasets, prompts, samples as sampling
from ..sources.files import list_files, place, read_lines
from ..sources.formats import classify_first, detect_formats, first_json_records
from ..sources.sinks import as_json_lines, write_training_set
from ..session import shared_path
from . import staging
from .records import ALPACA_SQL, QA_SQL, alpaca_json, pair, qa_json
from .registry import NL, query, sql_segment, sql_strip, table

# files above this size take the readers' many-splits path in the "_split" queries
SMALL_WHOLE_FILE = 16 * 1024


def _without_id(sql: str) -> str:
    return f"SELECT question, answer FROM ({sql})"


def _chat_records(spark, sf):
    """``value``: one chat record per conversation."""
    folded = chat.fold_messages(table(spark, sf, "conversations"))
    return as_json_lines(folded, "messages", F.col("conv_id").cast("string").alias("id"))


def _messages_text(samples):
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\x1e")
    return samples.select(flat.alias("messages"))


_CHAT_SQL = """
    SELECT string_agg(role || ':' || text, chr(30) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id
"""


@query(_CHAT_SQL)
def scan_sharegpt_array(spark, sf):
    """Chat records from JSON array files."""
    path = staging.stage_arrays(_chat_records(spark, sf), "sharegpt-array")
    return _messages_text(datasets.read_sharegpt(spark, path, "array"))


@query(_CHAT_SQL)
def scan_sharegpt_array_split(spark, sf):
    """Chat records from JSON array files that are cut into splits."""
    path = staging.stage_arrays(_chat_records(spark, sf), "sharegpt-split")
    return _messages_text(datasets.read_sharegpt(spark, path, "array", whole_file_bytes=SMALL_WHOLE_FILE))


@query(_CHAT_SQL)
def scan_sharegpt_lines(spark, sf):
    """Chat records from JSON lines."""
    path = staging.stage_lines(_chat_records(spark, sf), "sharegpt-lines")
    return _messages_text(datasets.read_sharegpt(spark, path, "lines"))


@query(_without_id(ALPACA_SQL))
def scan_alpaca(spark, sf):
    """Instruction records from JSON array files."""
    path = staging.stage_arrays(alpaca_json(table(spark, sf, "documents")), "alpaca")
    return pair(datasets.read_alpaca(spark, path, "array"))


@query(_without_id(ALPACA_SQL))
def scan_alpaca_split(spark, sf):
    """Instruction records from JSON array files that are cut into splits."""
    path = staging.stage_arrays(alpaca_json(table(spark, sf, "documents")), "alpaca-split")
    return pair(datasets.read_alpaca(spark, path, "array", whole_file_bytes=SMALL_WHOLE_FILE))


@query(_without_id(QA_SQL))
def scan_jsonl(spark, sf):
    """Question/answer records from JSON lines with blank lines between."""
    lines = qa_json(table(spark, sf, "documents")).select(F.concat("value", F.lit("\n  ")).alias("value"))
    return pair(datasets.read_qa(spark, staging.stage_lines(lines, "jsonl")))


_CSV_SQL = f"SELECT {sql_strip('text')} AS question, {sql_strip('lang')} AS answer FROM documents"


def _csv_table(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("source").alias("note"), F.col("text").alias("question"), F.col("lang").alias("answer")
    )


@query(_CSV_SQL)
def scan_csv(spark, sf):
    """CSV rows with quoted line ends."""
    return pair(datasets.read_csv(spark, staging.stage_csv(_csv_table(spark, sf), "csv")))


@query(_CSV_SQL)
def scan_csv_split(spark, sf):
    """CSV rows of files that are cut into splits."""
    path = staging.stage_csv(_csv_table(spark, sf), "csv-split")
    return pair(datasets.read_csv(spark, path, whole_file_bytes=SMALL_WHOLE_FILE))


_TEXT_SQL = f"SELECT {sql_strip('text')} AS content FROM documents WHERE {sql_strip('text')} <> ''"


def _content(samples):
    return samples.select(F.element_at("messages", 1)["content"].alias("content"))


@query(_TEXT_SQL)
def scan_text_file(spark, sf):
    """Paragraphs of text files."""
    path = staging.stage_paragraphs(table(spark, sf, "documents").select("text"), "paragraphs")
    return _content(datasets.read_text(spark, path))


@query(_TEXT_SQL)
def scan_text_file_split(spark, sf):
    """Paragraphs of text files that are cut into splits."""
    path = staging.stage_paragraphs(table(spark, sf, "documents").select("text"), "paragraphs-split")
    return _content(datasets.read_text(spark, path, whole_file_bytes=SMALL_WHOLE_FILE))


@query(f"""
    SELECT conv_id, {sql_strip(f"string_agg(text, {NL} || {NL} ORDER BY turn)")} AS content FROM conversations GROUP BY conv_id
""")
def scan_text_dir(spark, sf):
    """A folder of text files, each one sample even when it has blank lines."""
    folded = chat.fold_messages(table(spark, sf, "conversations"))
    texts = folded.select("conv_id", F.array_join(F.transform("messages", lambda m: m["content"]), "\n\n").alias("value"))
    path = staging.stage_text_files(texts, "conv_id", "text-dir")
    samples = datasets.read_text(spark, f"{path}/*", directory=True)
    return samples.select(
        staging.path_key(F.col("path"), "conv_id").alias("conv_id"), F.element_at("messages", 1)["content"].alias("content")
    )


@query(f"""
    SELECT {sql_strip('text')} AS question, {sql_strip('lang')} AS answer FROM documents WHERE lang = 'en'
    UNION ALL SELECT {sql_strip('text')}, {sql_strip('source')} FROM documents WHERE lang <> 'en'
""")
def scan_csv_headers(spark, sf):
    """CSV files of one folder with different headers and column orders."""
    documents = table(spark, sf, "documents")
    path = shared_path(spark, "csv-headers")
    options = dict(header=True, quote='"', escape='"')
    named = documents.where("lang = 'en'").selectExpr("lang as answer", "text as question")
    named.write.options(**options).csv(path)
    other = documents.where("lang <> 'en'").selectExpr("text as Body", "source as Origin", "lang as Lang")
    other.write.mode("append").options(**options).csv(path)
    return pair(datasets.read_csv(spark, path))


@query(_CSV_SQL)
def scan_csv_long_header(spark, sf):
    """CSV files with line ends in the names of their columns."""
    documents = table(spark, sf, "documents")
    named = documents.select(F.col("source").alias("no\nte"), F.col("text").alias("question"), F.col("lang").alias("answer"))
    return pair(datasets.read_csv(spark, staging.stage_csv(named, "csv-long-header")))


@query(f"SELECT {sql_strip('text')} AS question, {sql_strip('lang')} AS answer FROM documents")
def load_mixed_folder(spark, sf):
    """A folder in which one half of the files holds arrays and the other lines, each read by what it holds."""
    documents = table(spark, sf, "documents")
    value = F.to_json(F.struct(F.col("text").alias("question"), F.col("lang").alias("answer")))
    values = documents.select("doc_id", value.alias("value"))
    path = staging.stage_arrays(values.where("doc_id % 2 = 0"), "load-mixed")
    values.where("doc_id % 2 = 1").select("value").write.mode("append").text(path)
    return pair(datasets.read_mixed_records(spark, path).transform(lambda r: to_messages(r, "jsonl")))


@query(f"""
    SELECT CASE WHEN lang = 'en' THEN 'sharegpt' ELSE 'alpaca' END AS format, count(*) > 0 AS found FROM documents GROUP BY 1
""")
def detect_arrays(spark, sf):
    """Formats of array files whose first element starts after white space."""
    documents = table(spark, sf, "documents")
    english = F.col("lang") == "en"
    chat_record = F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))
    task_record = F.struct(F.col("text").alias("instruction"), F.col("lang").alias("output"))
    path = staging.stage_arrays(documents.where(english).select(F.concat(F.lit("  "), F.to_json(chat_record)).alias("value")), "detect-arrays")
    other = staging.stage_arrays(documents.where(~english).select(F.concat(F.lit("\n"), F.to_json(task_record)).alias("value")), "detect-tasks")
    found = None
    for folder in (path, other):
        files = list_files(spark, folder, "*.txt")
        kinds = first_json_records(spark, folder, "*.txt", whole_file_bytes=SMALL_WHOLE_FILE)
        rows = classify_first(kinds).join(files, "path")
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("format").agg((F.count("*") > 0).alias("found"))


@query(f"""
    SELECT 'chat' AS dataset, 'lines' AS container, 'sharegpt' AS format, count(DISTINCT conv_id) AS records FROM conversations
    UNION ALL SELECT 'instructions', 'lines', 'alpaca', count(*) FROM documents
    UNION ALL SELECT 'questions', 'lines', 'jsonl', count(*) FROM documents
    UNION ALL SELECT 'table', 'lines', 'csv', count(*) FROM documents
    UNION ALL SELECT 'texts', 'lines', 'text', count(*) FROM documents WHERE {sql_strip('text')} <> ''
""")
def detect_dataset_formats(spark, sf):
    """Formats found in folders of every kind, with the records each folder gives."""
    documents = table(spark, sf, "documents")
    folded = chat.fold_messages(table(spark, sf, "conversations"))
    folders = {
        "chat": staging.stage_json(folded.select("messages"), "detect-chat"),
        "instructions": staging.stage_json(
            documents.select(F.col("lang").alias("instruction"), F.col("text").alias("output")), "detect-instructions"
        ),
        "questions": staging.stage_json(
            documents.select(F.col("text").alias("question"), F.col("lang").alias("answer")), "detect-questions"
        ),
        "table": staging.stage_csv(_csv_table(spark, sf), "detect-table"),
        "texts": staging.stage_paragraphs(documents.select("text"), "detect-texts"),
    }
    out = None
    for name, path in folders.items():
        kinds = detect_formats(spark, path).groupBy("container", "format").agg(F.count("*").alias("files"))
        if name == "texts":
            samples = datasets.read_text(spark, path)
        else:
            samples = datasets.load_dataset(spark, path, shuffle=False)
        records = samples.agg(F.count("*").alias("records")).withColumn("dataset", F.lit(name))
        row = kinds.select(F.lit(name).alias("dataset"), "container", "format").join(records, "dataset")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"SELECT {sql_strip('text')} AS question, {sql_strip('lang')} AS answer FROM documents")
def load_auto(spark, sf):
    """The load entry point on a folder: format found, all files read, order shuffled."""
    documents = table(spark, sf, "documents")
    path = staging.stage_json(documents.select(F.col("text").alias("question"), F.col("lang").alias("answer")), "load-auto")
    return pair(datasets.load_dataset(spark, path))


SAMPLED, PARTS = 100, 16


@query(f"""
    WITH r AS (SELECT text, lang, 'part=' || doc_id % {PARTS} || '#' || (row_number() OVER (PARTITION BY doc_id % {PARTS} ORDER BY doc_id) - 1) AS id FROM documents),
    o AS (SELECT *, row_number() OVER (ORDER BY md5('{SHUFFLE_SEED}:' || id), id) - 1 AS place FROM r)
    SELECT place, {sql_strip('text')} AS question, {sql_strip('lang')} AS answer FROM o WHERE place < {SAMPLED}
""")
def load_sample_places(spark, sf):
    """A seeded sample of JSON line files, settled on ids, with each record's place in the shuffled order."""
    documents = table(spark, sf, "documents").withColumn("part", F.col("doc_id") % PARTS)
    value = F.to_json(F.struct(F.col("text").alias("question"), F.col("lang").alias("answer")))
    path = shared_path(spark, "load-sample")
    ordered = documents.repartition(PARTS, "part").sortWithinPartitions("part", "doc_id")
    ordered.select("part", F.concat(value, F.lit("\n")).alias("value")).write.partitionBy("part").text(path)
    records = place(read_lines(spark, f"{path}/*")).where("value <> ''")
    # files are named by their folders: the names of the files below differ from run to run
    records = records.withColumn("path", F.regexp_extract("path", "part=[0-9]+", 0))
    found = to_messages(sampling.sampled_records(records, SAMPLED), "jsonl")
    return pair(found, "place")


@query(f"SELECT {sql_strip('text')} AS question, {sql_strip('lang')} AS answer FROM documents")
def load_csv_folder(spark, sf):
    """The load entry point on a folder of CSV files."""
    return pair(datasets.load_dataset(spark, staging.stage_csv(_csv_table(spark, sf), "load-csv")))


@query(f"SELECT {sql_strip(sql_segment('role', 'text'))} AS line FROM conversations")
def write_training_text(spark, sf):
    """Rendered samples written as JSON lines by role and read back."""
    turns = table(spark, sf, "conversations")
    rendered = turns.select("role", F.btrim(render.segment(F.col("role"), F.col("text")), F.lit("\n ")).alias("line"))
    path = shared_path(spark, "training-text")
    write_training_set(rendered, path, "json", partition_by=("role",))
    return spark.read.schema("line string, role string").json(path).select("line")


@query(f"SELECT conv_id, string_agg({sql_segment('role', 'text')}, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def write_training_set_parquet(spark, sf):
    """Rendered conversations written as parquet and read back."""
    path = shared_path(spark, "training-set")
    write_training_set(chat.fold_text(table(spark, sf, "conversations")).select("conv_id", "text"), path)
    return spark.read.parquet(path)


# ---- prompt lists ---------------------------------------------------------

_PROMPT_SQL = f"SELECT {sql_strip('CASE doc_id % 6 WHEN 4 THEN chr(48) ELSE text END')} AS prompt FROM documents"


@query(_PROMPT_SQL)
def batch_prompts_jsonl(spark, sf):
    """Prompts from JSON lines."""
    path = staging.stage_lines(qa_json(table(spark, sf, "documents")).select("value"), "prompts-jsonl")
    return prompts.read_prompts_jsonl(spark, path).select("prompt")


@query("SELECT CASE doc_id % 6 WHEN 4 THEN '0' ELSE text END AS prompt FROM documents WHERE doc_id % 6 IN (0, 1, 4, 5)")
def batch_prompts_narrow(spark, sf):
    """Prompts from JSON lines by the two-key rule, unstripped: records without those keys have none."""
    path = staging.stage_lines(qa_json(table(spark, sf, "documents")).select("value"), "prompts-narrow")
    found = prompts.read_prompts_jsonl(spark, path, keys=prompts.NARROW_KEYS, stripped=False)
    return found.select("prompt")


@query(f"SELECT {sql_strip('text')} AS prompt FROM documents")
def batch_prompts_json(spark, sf):
    """Prompts from JSON arrays of strings and objects."""
    documents = table(spark, sf, "documents")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    value = F.when(F.col("doc_id") % 2 == 0, quoted).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"))))
    path = staging.stage_arrays(documents.select(value.alias("value")), "prompts-json")
    return prompts.read_prompts_json(spark, path).select("prompt")


@query(f"""
    SELECT {sql_strip("line")} AS prompt FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE {sql_strip("line")} <> ''
""")
def batch_prompts_txt(spark, sf):
    """Every non-blank line of text files."""
    path = staging.stage_lines(table(spark, sf, "documents").select("text"), "prompts-txt")
    return prompts.read_prompt_lines(spark, path).select("prompt")
