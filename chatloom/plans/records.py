"""Record formats: JSON text built from ``documents`` and turned into messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MESSAGES_TYPE
from ..functions import escaped_preview, human_count, human_size, strip
from ..functions.paths import directory, file_name, suffix
from ..functions.text import clock
from ..functions.jsontext import json_keys, parse_record
from ..operators import catalog, records
from ..operators.records import csv_messages, csv_plan, text_messages, to_messages
from ..sources.prompts import prompts_from_records
from ..sources.textfiles import split_paragraphs
from .registry import query, sql_size, sql_strip, table


def pair(df, *keep):
    """Messages of two turns as plain columns."""
    return df.select(
        *keep, F.element_at("messages", 1)["content"].alias("question"),
        F.element_at("messages", 2)["content"].alias("answer"),
    )


def alpaca_json(documents):
    """``doc_id, value``: instruction records that differ in which fields they have."""
    k = F.col("doc_id") % 4
    fields = F.struct(
        F.concat(F.lit("  Tell me about "), "lang", F.lit(" "), F.when(k == 3, F.col("text")).otherwise("")).alias("instruction"),
        F.when(k < 2, F.col("text")).when(k == 2, F.lit("")).alias("input"),
        F.when(k == 0, F.concat(F.lit("\n"), F.col("source"))).when(k == 2, F.col("text")).alias("output"),
        F.when(k == 1, F.col("text")).alias("response"),
    )
    return documents.select("doc_id", F.to_json(fields).alias("value"))


ALPACA_SQL = f"""
    SELECT doc_id, {sql_strip("'  Tell me about ' || lang || ' ' || CASE WHEN doc_id % 4 < 2 THEN chr(10) || chr(10) || text WHEN doc_id % 4 = 3 THEN text ELSE '' END")} AS question,
      {sql_strip("CASE doc_id % 4 WHEN 0 THEN source WHEN 2 THEN text WHEN 1 THEN text ELSE '' END")} AS answer
    FROM documents
"""


@query(ALPACA_SQL)
def alpaca_to_messages(spark, sf):
    """Instruction records as two messages."""
    return pair(to_messages(alpaca_json(table(spark, sf, "documents")), "alpaca"), "doc_id")


def qa_json(documents):
    """``doc_id, value``: question/answer records with every synonym, falsy values and object answers."""
    k = F.col("doc_id") % 6
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    text, source = quoted(F.col("text")), quoted(F.col("source"))
    variants = [
        F.concat(F.lit('{"question":'), text, F.lit(',"answer":'), source, F.lit("}")),
        F.concat(F.lit('{"question":"","prompt":'), text, F.lit(',"answer":0,"response":'), source, F.lit("}")),
        F.concat(F.lit('{"input":'), text, F.lit(',"prompt":[],"answer":{"text":'), source, F.lit(',"n":1}}')),
        F.concat(F.lit('{"instruction":'), text, F.lit(',"question":null,"answer":false,"output":'), source, F.lit("}")),
        F.concat(F.lit('{"question":"0","completion":'), text, F.lit(',"response":{}}')),
        F.concat(F.lit('{"question":"dropped","answer":12,"question":'), text, F.lit("}")),
    ]
    value = F.when(k == 0, variants[0])
    for i, variant in enumerate(variants[1:], 1):
        value = value.when(k == i, variant)
    return documents.select("doc_id", value.alias("value"))


QA_SQL = f"""
    SELECT doc_id, {sql_strip("CASE doc_id % 6 WHEN 4 THEN '0' ELSE text END")} AS question,
      {sql_strip("CASE doc_id % 6 WHEN 4 THEN text WHEN 5 THEN '12' ELSE source END")} AS answer
    FROM documents
"""


@query(QA_SQL)
def qa_to_messages(spark, sf):
    """Question/answer records as two messages."""
    return pair(to_messages(qa_json(table(spark, sf, "documents")), "jsonl"), "doc_id")


@query("SELECT conv_id, turn, 'user' AS role, text AS content, CAST(1 AS BIGINT) AS n FROM conversations")
def sharegpt_to_messages(spark, sf):
    """Chat records keep their messages and lose every other key."""
    turns = table(spark, sf, "conversations")
    turn = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"), F.col("role").alias("name"))
    record = F.to_json(F.struct(F.array(turn).alias("messages"), F.col("turn").alias("extra")))
    found = to_messages(turns.select("conv_id", "turn", record.alias("value")), "sharegpt")
    first = F.element_at("messages", 1)
    return found.select(
        "conv_id", "turn", first["role"].alias("role"), first["content"].alias("content"),
        F.size("messages").cast("bigint").alias("n"),
    )


@query(f"SELECT doc_id, 'assistant' AS role, {sql_strip('text')} AS content FROM documents")
def text_to_messages(spark, sf):
    """Texts as lone assistant messages."""
    message = F.element_at(text_messages(F.btrim("text")).cast(MESSAGES_TYPE), 1)
    return table(spark, sf, "documents").select(
        "doc_id", message["role"].alias("role"), message["content"].alias("content")
    )


@query(f"""
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {sql_strip("lang || chr(10) || chr(10) || text")} ELSE {sql_strip('text')} END AS question,
      CASE doc_id % 3 WHEN 2 THEN lang ELSE source END AS answer
    FROM documents
""")
def csv_rows_to_messages(spark, sf):
    """CSV rows by the three column rules: instruction columns, named columns, first two columns."""
    k = F.col("doc_id") % 3
    strings = lambda *names: F.array(*map(F.lit, names))
    header = (
        F.when(k == 0, strings("input", "instruction", "response", "output"))
        .when(k == 1, strings("id", "answer", "prompt", "question"))
        .otherwise(strings("Question", "Reply"))
    )
    cells = (
        F.when(k == 0, F.array(F.col("text"), F.col("lang"), F.col("source"), F.lit("")))
        .when(k == 1, F.array(F.lit("7"), F.col("source"), F.col("text"), F.lit("unused")))
        .otherwise(F.array(F.col("text"), F.col("lang"), F.lit("extra")))
    )
    rows = table(spark, sf, "documents").select("doc_id", csv_messages(csv_plan(header), cells).alias("messages"))
    return pair(rows, "doc_id")


def mixed_json(documents, *keep):
    """``doc_id, source, value``: records of every kind and broken ones."""
    k = F.col("doc_id") % 8
    body = F.to_json(F.struct(F.col("text").alias("t")))
    inner = F.regexp_extract(body, r"(?s)^\{\"t\":(.*)\}$", 1)
    forms = [
        ('{"messages":[{"role":"user","content":', "}]}"),
        ('{"instruction":"i","output":', "}"),
        ('{"instruction":"i","response":', "}"),
        ('{"question":', ',"answer":"a"}'),
        ('{"input":', ',"output":null}'),
        ('{"messages":[],"note":', "}"),
        ('{"messages":[{"role":"user"}],"note":', "}"),
        ('{"question":', ',"answer":"a"'),
    ]
    value = None
    for i, (head, tail) in enumerate(forms):
        form = F.concat(F.lit(head), inner, F.lit(tail))
        value = F.when(k == i, form) if value is None else value.when(k == i, form)
    return documents.select(*(keep or ("doc_id", "source")), value.alias("value"))


@query("""
    SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'sharegpt' WHEN 1 THEN 'alpaca' WHEN 2 THEN 'alpaca'
        WHEN 3 THEN 'jsonl' WHEN 4 THEN 'jsonl' ELSE 'unknown' END AS format,
      doc_id % 8 <> 7 AS is_json
    FROM documents
""")
def classify_records(spark, sf):
    """Format of every record on its own."""
    found = records.record_format(parse_record(mixed_json(table(spark, sf, "documents"))))
    return found.select("doc_id", F.coalesce("format", F.lit("unknown")).alias("format"), "is_json")


@query("""
    SELECT source || '.jsonl' AS path, count(*) AS sample_count,
      coalesce(CASE arg_min(doc_id % 8, doc_id) WHEN 0 THEN 'sharegpt' WHEN 1 THEN 'alpaca' WHEN 2 THEN 'alpaca'
        WHEN 3 THEN 'jsonl' WHEN 4 THEN 'jsonl' END, 'jsonl') AS format,
      CASE arg_min(doc_id % 8, doc_id) WHEN 0 THEN 'messages' WHEN 1 THEN 'instruction,output'
        WHEN 2 THEN 'instruction,response' WHEN 3 THEN 'question,answer' WHEN 4 THEN 'input,output'
        WHEN 5 THEN 'messages,note' WHEN 6 THEN 'messages,note' ELSE '' END AS fields,
      count(*) FILTER (WHERE doc_id % 8 = 7) = 0 AS valid,
      CASE WHEN count(*) FILTER (WHERE doc_id % 8 = 7) = 0 THEN ''
        ELSE 'bad_json_lines:' || count(*) FILTER (WHERE doc_id % 8 = 7) || '/' || count(*) END AS errors,
      CASE WHEN count(*) FILTER (WHERE doc_id % 8 = 7) = 0 AND arg_min(doc_id % 8, doc_id) IN (5, 6)
        THEN 'unknown_fields:messages,note' ELSE '' END AS warnings
    FROM documents GROUP BY source
""")
def jsonl_quality(spark, sf):
    """Verdict per file, the documents of a source being the lines of its file."""
    lines = mixed_json(table(spark, sf, "documents")).select(
        F.concat("source", F.lit(".jsonl")).alias("path"), F.col("doc_id").alias("pos"), "value"
    )
    found = catalog.line_verdicts(lines)
    return found.select(
        "path", "sample_count", "format", F.array_join("fields", ",").alias("fields"), "valid",
        F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"),
    )


@query("""
    SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'messages' WHEN 1 THEN 'instruction,output'
        WHEN 2 THEN 'instruction,response' WHEN 3 THEN 'question,answer' WHEN 4 THEN 'input,output'
        WHEN 7 THEN 'question,answer' ELSE 'messages,note' END AS fields
    FROM documents
""")
def record_fields(spark, sf):
    """Field names of every record in document order (also of records cut off after their last field)."""
    found = mixed_json(table(spark, sf, "documents"))
    closed = F.when(F.col("doc_id") % 8 == 7, F.concat("value", F.lit("}"))).otherwise(F.col("value"))
    return found.select("doc_id", F.array_join(json_keys(closed), ",").alias("fields"))


@query(f"""
    SELECT doc_id, {sql_strip("CASE WHEN doc_id % 6 = 4 THEN '0' ELSE text END")} AS prompt FROM documents
""")
def prompts_from_json(spark, sf):
    """First truthy prompt key of every record."""
    return prompts_from_records(qa_json(table(spark, sf, "documents"))).select("doc_id", "prompt")


@query(f"""
    SELECT source, CAST(part AS BIGINT) AS part, {sql_strip("paragraph")} AS paragraph FROM (
      SELECT source, doc_id AS part, unnest(string_split(text || chr(10) || chr(10) || '  ' || chr(10) || chr(10) || lang, chr(10) || chr(10))) AS paragraph
      FROM documents)
    WHERE {sql_strip("paragraph")} <> ''
""")
def paragraph_split(spark, sf):
    """Paragraphs of texts with blank lines, given with CRLF line ends."""
    text = F.concat("text", F.lit("\r\n\r\n  \r\n\r\n"), "lang")
    parts = table(spark, sf, "documents").select(
        "source", F.col("doc_id").alias("part"), F.explode(split_paragraphs(text)).alias("paragraph")
    )
    return parts.withColumn("paragraph", strip(F.col("paragraph"))).where(F.col("paragraph") != "")


@query(f"""
    SELECT doc_id, {sql_strip("chr(12288) || chr(28) || ' ' || text || ' ' || chr(9) || chr(160)")} AS text FROM documents
""")
def strip_unicode(spark, sf):
    """Every kind of whitespace is removed from both ends."""
    padded = F.concat(F.lit("\u3000\x1c "), "text", F.lit(" \t\xa0"))
    return table(spark, sf, "documents").select("doc_id", strip(padded).alias("text"))


@query(f"""
    SELECT doc_id, {sql_size("n_chars")} AS size, {sql_size("n_chars * 1024")} AS size_kb, {sql_size("n_chars * 1048576")} AS size_mb,
      CASE WHEN n_chars * 1000 > 1000000000 THEN printf('%.1fB', n_chars * 1000 / 1e9)
        WHEN n_chars * 1000 > 1000000 THEN printf('%.1fM', n_chars * 1000 / 1e6)
        ELSE printf('%.1fK', n_chars * 1000 / 1e3) END AS n
    FROM documents
""")
def size_labels(spark, sf):
    """Human-readable sizes and counts."""
    n = F.col("n_chars")
    return table(spark, sf, "documents").select(
        "doc_id", human_size(n).alias("size"), human_size(n * 1024).alias("size_kb"),
        human_size(n * 1048576).alias("size_mb"), human_count(n * 1000).alias("n"),
    )


@query("""
    SELECT doc_id, replace(left(text, 200), chr(10), '\\n') || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS preview
    FROM documents
""")
def text_preview(spark, sf):
    """First 200 characters on one line."""
    return table(spark, sf, "documents").select("doc_id", escaped_preview(F.col("text")).alias("preview"))


@query("""
    SELECT page_id, regexp_extract(url, '[^/]*$') AS name, left(url, length(url) - length(regexp_extract(url, '[^/]*$')) - 1) AS dir,
      lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+\\.([^.]+)$', 1)) AS suffix
    FROM pages
""")
def path_parts(spark, sf):
    """Name, folder and extension of paths."""
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", file_name(url).alias("name"), directory(url).alias("dir"), suffix(url).alias("suffix")
    )


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def event_clock(spark, sf):
    """Time of day as log lines show it."""
    return table(spark, sf, "events").select("event_id", clock(F.col("ts")).alias("clock"))
