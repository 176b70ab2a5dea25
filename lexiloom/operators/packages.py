"""Document packages: reading, validation and routing.

A package is a JSON object with a source and chunks.  Files are read as
Variant, so a value of the wrong type is reported instead of being coerced.
Changes from the described behaviour, on purpose: a package without a
``chunks`` key is rejected (MISSING_CHUNKS), and an approved .jsonl package is
indexed line by line.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.numbers import units

#: Patterns of secrets and of text that reaches for build workflows.
SECRETS = (
    r"\bsk-[A-Za-z0-9]{20,}\b",
    r"\bsk-ant-[A-Za-z0-9-]{20,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_-]{30,}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"""(?i)\b(api[_-]?key|secret|token|password|passwd)\b\s*[:=]\s*["']?[A-Za-z0-9_\-./+]{12,}["']?""",
    r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"\bBearer\s+[A-Za-z0-9_\-.]{20,}",
)
WORKFLOWS = (
    r"(?i)\.github[\\/]workflows[\\/]",
    r"(?i)\bruns-on\s*:\s*[A-Za-z0-9_-]+",
    r"(?im)^\s*on\s*:\s*(push|pull_request|workflow_dispatch)",
    r"(?i)\b(modify|edit|update|replace|overwrite)\b[^.]{0,40}\b(workflow|\.yml|\.yaml|github action)",
)
EXECUTABLE = r"""(?i)\.(exe|sh|bat|cmd|ps1|vbs|scr|jar|app|dll|msi|com|apk|dmg|bin)(\s|["'\\/]|$)"""
LEAST, WARN, MOST, ENTRIES, ENTRY_CHARS = 10, 8000, 20000, 50, 100


def safety_errors(text: Column) -> Column:
    """SECRET_LIKE_CONTENT, WORKFLOW_TAMPER_SUSPECT (one for each pattern) and EXECUTABLE_CONTENT."""
    one = lambda pattern, code: F.when(F.rlike(text, F.lit(pattern)), code)
    return F.array_compact(F.array(*[one(p, "SECRET_LIKE_CONTENT") for p in SECRETS], *[one(p, "WORKFLOW_TAMPER_SUSPECT") for p in WORKFLOWS], one(r"(?i)<script\b", "EXECUTABLE_CONTENT")))


def safety_warnings(text: Column) -> Column:
    return F.array_compact(F.array(F.when(F.rlike(text, F.lit(EXECUTABLE)), "EXECUTABLE_EXT_MENTION")))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """file, content (raw bytes) of all files below path, index.json left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").where("file <> 'index.json'")


def parse(files: DataFrame) -> DataFrame:
    """Adds raw, pkg (Variant; null if it does not parse) and read_errors.

    A .jsonl file has the header on line 1 and one chunk on each later line;
    broken lines are kept as errors and the rest goes on.
    """
    raw = files.withColumn("raw", F.decode("content", "UTF-8")).withColumn("_ext", F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1)))
    lines = F.filter(F.split("raw", r"\r?\n"), lambda x: F.trim(x) != "")
    tail = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    bad = F.filter(tail, lambda x: F.try_parse_json(x).isNull())
    head = F.try_element_at(lines, F.lit(1))
    good = F.array_join(F.filter(tail, lambda x: F.try_parse_json(x).isNotNull()), ",")
    joined = F.concat(F.regexp_replace(F.rtrim(head), r"\}\s*$", ""), F.when(F.rlike(head, F.lit(r"^\s*\{\s*\}\s*$")), "").otherwise(","), F.lit('"chunks":['), good, F.lit("]}"))
    whole = F.when(F.col("_ext") == ".jsonl", joined).otherwise(F.col("raw"))
    pkg = F.when(F.col("_ext").isin(".json", ".jsonl"), F.try_parse_json(whole))
    errors = F.concat(
        F.array_compact(F.array(F.when(~F.col("_ext").isin(".json", ".jsonl"), "UNEXPECTED_FILE_TYPE").when(pkg.isNull(), "INVALID_JSON"))),
        F.when(F.col("_ext") == ".jsonl", F.transform(bad, lambda _: F.lit("INVALID_JSONL_LINE"))).otherwise(F.array().cast("array<string>")),
    )
    return raw.withColumn("pkg", pkg).withColumn("read_errors", errors).drop("_ext")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _is_string(v: Column, path: str) -> Column:
    return F.coalesce(_kind(F.try_variant_get(v, path, "variant")) == "STRING", F.lit(False))


def _present(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def structure_errors(pkg: Column) -> Column:
    root = F.startswith(F.coalesce(_kind(pkg), F.lit("")), F.lit("OBJECT"))
    source = F.startswith(F.coalesce(_kind(F.try_variant_get(pkg, "$.source", "variant")), F.lit("")), F.lit("OBJECT"))
    version = _text(pkg, "$.schema_version")
    found = F.array(
        F.when(~_is_string(pkg, "$.schema_version"), "MISSING_SCHEMA_VERSION").when(version != "1", "UNSUPPORTED_SCHEMA_VERSION"),
        F.when(~source, "MISSING_SOURCE").when(~_is_string(pkg, "$.source.title") | (F.trim(_text(pkg, "$.source.title")) == ""), "MISSING_SOURCE_TITLE"),
        *[F.when(source & _present(pkg, f"$.source.{f}") & ~_is_string(pkg, f"$.source.{f}"), "INVALID_SOURCE_FIELD_TYPE") for f in ("type", "subject", "language", "origin")],
    )
    return F.when(~root, F.array(F.lit("INVALID_ROOT"))).otherwise(F.array_compact(found))


def chunk_rows(parsed: DataFrame, key: str = "file") -> DataFrame:
    """key, idx, chunk (Variant), repeated: the chunks of packages whose chunks are an array."""
    listed = parsed.select(key, F.col("pkg")).withColumn("_c", F.try_variant_get("pkg", "$.chunks", "array<variant>")).where("_c is not null")
    return listed.select(key, F.posexplode("_c").alias("idx", "chunk"))


def chunk_issues(chunks: DataFrame, key: str = "file") -> DataFrame:
    """key, idx, errors, warnings, usable of each chunk; the second and later uses of an id are duplicates."""
    from pyspark.sql import Window as W

    c = F.col("chunk")
    is_object = F.startswith(F.coalesce(_kind(c), F.lit("")), F.lit("OBJECT"))
    has_id = _is_string(c, "$.id") & (F.trim(_text(c, "$.id")) != "")
    text = F.trim(_text(c, "$.text"))
    has_text = _is_string(c, "$.text") & (text != "")
    n = units(text)
    usable = is_object & has_text & (n >= LEAST) & (n <= MOST)
    page = _kind(F.try_variant_get(c, "$.page", "variant"))
    number = page.isNull() | page.isin("VOID", "BIGINT", "DOUBLE", "FLOAT") | F.startswith(page, F.lit("DECIMAL"))
    id_text = F.when(has_id & is_object, _text(c, "$.id"))
    first = F.row_number().over(W.partitionBy(key, "_id").orderBy("idx"))
    none = F.array().cast("array<string>")

    def lists(field: str) -> tuple[Column, Column]:
        whole = F.try_variant_get(c, f"$.{field}", "variant")
        items = F.try_variant_get(c, f"$.{field}", "array<variant>")
        is_array = F.startswith(F.coalesce(_kind(whole), F.lit("")), F.lit("ARRAY"))
        good = lambda v: F.coalesce(_kind(v) == "STRING", F.lit(False)) & (F.trim(F.try_variant_get(v, "$", "string")) != "")
        errors = F.when(whole.isNull(), none).when(~is_array, F.array(F.lit("INVALID_METADATA_TYPE"))).otherwise(F.transform(F.filter(items, lambda v: ~good(v)), lambda _: F.lit("INVALID_METADATA_ENTRY")))
        long = F.transform(F.filter(items, lambda v: good(v) & (units(F.try_variant_get(v, "$", "string")) > ENTRY_CHARS)), lambda _: F.lit("METADATA_ENTRY_LONG"))
        warnings = F.when(is_array, F.concat(F.array_compact(F.array(F.when(F.size(items) > ENTRIES, "METADATA_ARRAY_LONG"))), long)).otherwise(none)
        return errors, warnings

    (topic_e, topic_w), (concept_e, concept_w) = lists("topics"), lists("concepts")
    own = F.array_compact(
        F.array(
            F.when(~has_id, "MISSING_CHUNK_ID").when(F.col("_nth") > 1, "DUPLICATE_CHUNK_ID"),
            F.when(~has_text, "MISSING_CHUNK_TEXT").when(n < LEAST, "CHUNK_TOO_SHORT").when(n > MOST, "CHUNK_WAY_TOO_LONG"),
            F.when(~number, "INVALID_PAGE_TYPE"),
            F.when(_present(c, "$.section") & ~_is_string(c, "$.section"), "INVALID_SECTION_TYPE"),
        )
    )
    errors = F.when(~is_object, F.array(F.lit("CHUNK_NOT_OBJECT"))).otherwise(F.concat(own, topic_e, concept_e))
    warnings = F.when(is_object, F.concat(F.array_compact(F.array(F.when(usable & (n > WARN), "CHUNK_LONG"))), topic_w, concept_w)).otherwise(none)
    numbered = chunks.withColumn("_id", id_text).withColumn("_nth", F.when(F.col("_id").isNotNull(), first))
    return numbered.select(key, "idx", errors.alias("errors"), warnings.alias("warnings"), usable.alias("usable"))


def _strings(value: object, out: list[str]) -> None:
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, (list, dict)):
        for x in value.values() if isinstance(value, dict) else value:
            _strings(x, out)


def json_strings(raw: str | None) -> str:
    """All string values of a JSON text, or of the lines of a .jsonl text, joined by line feeds."""
    out: list[str] = []
    for part in [raw or ""] if _parses(raw) else (raw or "").splitlines():
        if _parses(part):
            _strings(json.loads(part), out)
    return "\n".join(out)


def _parses(text: str | None) -> bool:
    try:
        json.loads(text or "")
    except ValueError:
        return False
    return True


def collected_strings(raw: Column) -> Column:
    """json_strings in Arrow batches: the depth of a JSON value is open, which no column expression walks."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(json_strings)

    return run(raw)


def validate(files: DataFrame) -> DataFrame:
    """One verdict for each file: status, source, chunks, usable_chunks, errors, warnings, content_hash."""
    parsed = parse(files).withColumn("_strings", collected_strings(F.col("raw")))
    issues = chunk_issues(chunk_rows(parsed))
    summed = issues.groupBy("file").agg(
        F.count("*").alias("_chunks"),
        F.count_if("usable").alias("_usable"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "errors"))), lambda x: x["errors"])).alias("_ce"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "warnings"))), lambda x: x["warnings"])).alias("_cw"),
    )  # the chunks of one file
    none = F.array().cast("array<string>")
    kind = _kind(F.try_variant_get("pkg", "$.chunks", "variant"))
    listing = F.when(kind.isNull(), F.array(F.lit("MISSING_CHUNKS"))).when(~F.startswith(kind, F.lit("ARRAY")), F.array(F.lit("CHUNKS_NOT_ARRAY"))).when(F.size(F.try_variant_get("pkg", "$.chunks", "array<variant>")) == 0, F.array(F.lit("EMPTY_CORPUS"))).otherwise(none)
    strings = F.col("_strings")
    body = F.when(F.col("pkg").isNull(), none).otherwise(F.concat(structure_errors(F.col("pkg")), listing, F.coalesce("_ce", none), safety_errors(strings)))
    errors = F.concat("read_errors", body)
    return parsed.join(summed, "file", "left").select(
        "file",
        F.when(F.size(errors) == 0, "approved").otherwise("rejected").alias("status"),
        F.when(_is_string(F.col("pkg"), "$.source.title"), _text(F.col("pkg"), "$.source.title")).alias("source"),
        F.coalesce("_chunks", F.lit(0)).alias("chunks"),
        F.coalesce("_usable", F.lit(0)).alias("usable_chunks"),
        errors.alias("errors"),
        F.when(F.col("pkg").isNull(), none).otherwise(F.concat(F.coalesce("_cw", none), safety_warnings(strings))).alias("warnings"),
        F.sha2("content", 256).alias("content_hash"),
    )


def approved_docs(files: DataFrame) -> DataFrame:
    """The chunks of approved packages with their source's fields; missing lists are empty."""
    good = validate(files).where("status = 'approved'").select("file")
    parsed = parse(files).join(good, "file", "left_semi")
    of_source = lambda f: _text(F.col("pkg"), f"$.source.{f}")
    rows = parsed.select(of_source("title").alias("source"), of_source("type").alias("source_type"), of_source("subject").alias("subject"), of_source("language").alias("language"), of_source("origin").alias("origin"), F.explode(F.try_variant_get("pkg", "$.chunks", "array<variant>")).alias("c"))
    get = lambda f, kind="string": F.try_variant_get("c", f"$.{f}", kind)
    empty = F.array().cast("array<string>")
    return rows.select(get("id").alias("id"), "source", "source_type", "subject", "language", "origin", get("page", "double").alias("page"), get("section").alias("section"), F.coalesce(get("topics", "array<string>"), empty).alias("topics"), F.coalesce(get("concepts", "array<string>"), empty).alias("concepts"), get("text").alias("text"))


def index_failure(docs: DataFrame, df: DataFrame, meta: DataFrame) -> str | None:
    """The first invariant of a built index that does not hold, or None."""
    n, blank, distinct = docs.agg(F.count("*"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == ""), F.count_distinct("id")).first()
    if n == 0:
        return "EMPTY_INDEX"
    if blank:
        return "BLANK_TEXT"
    if distinct != n:
        return "DUPLICATE_ID"
    count, average = meta.select("doc_count", "avg_doc_len").first()
    if count != n:
        return "DOC_COUNT_MISMATCH"
    if not average or average <= 0:
        return "BAD_AVERAGE_LENGTH"
    return "EMPTY_VOCABULARY" if df.isEmpty() else None
