"""Dotenv files: entries with positions, and the errors of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Error codes of env files.
CODES = {"whitespace": "EDF001", "double_equals": "EDF002", "empty_key": "EDF003", "invalid_key": "EDF004", "unclosed_quote": "EDF005", "invalid_utf8": "EDF006", "other": "EDF999"}
#: One logical line: a pair whose quoted value spans lines, else a line.
_LINE = r"""(?m)^[^\S\n]*(?:export[^\S\n]+)?[A-Za-z_][\w.]*=[^\S\n]*(?:"(?:\\[\s\S]|[^"\\])*+"|'[^']*+')[^\n]*$|^[^\n]*$"""


def entries(files: DataFrame) -> DataFrame:
    """(file_id, ord, key, raw_value, value, is_comment, error_code, sl, sc, ec, error_at) of each logical line that is not blank.

    Stays in DataFrame functions. Quotes around a value go, and such a value may span lines; an empty value is defined, keys keep their
    case; `export` may lead. `sl` is the line, `sc` to `ec` the key, `error_at` where the error stands. A null content has no entries. Bytes that
    were no UTF-8 (read as U+FFFD) make a line an error.
    """
    pieces = F.regexp_extract_all(F.regexp_replace("content", "\r\n", "\n"), F.lit(_LINE), F.lit(0))
    # env files are short: the fold that numbers their lines grows with the square of theirs, not of the corpus
    start = F.struct(F.lit(0).alias("line"), F.array().cast("array<struct<sl:int,line:string>>").alias("rows"))
    folded = F.aggregate(
        pieces, start,
        lambda s, x: F.struct((s["line"] + F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line"), F.concat(s["rows"], F.array(F.struct(s["line"].cast("int").alias("sl"), x.alias("line")))).alias("rows")),
        lambda s: s["rows"],
    )
    lines = files.select("file_id", F.explode(folded).alias("x")).select("file_id", "x.sl", "x.line")
    body = F.regexp_replace("line", r"^\s*(?:export\s+)?", "")
    lines = lines.where(F.trim("line") != "").withColumn("body", body).withColumn("eq", F.instr("body", "="))
    key = F.when(F.col("eq") > 0, F.substring(F.col("body"), F.lit(1), F.col("eq") - 1)).otherwise(F.col("body"))
    raw = F.when(F.col("eq") > 0, F.trim(F.substring(F.col("body"), F.col("eq") + 1, F.length("body"))))
    lines = lines.withColumn("is_comment", F.col("body").startswith("#")).withColumn("key", key).withColumn("raw_value", raw)
    quote = F.substring("raw_value", 1, 1)
    quoted = quote.isin('"', "'")
    closed = F.col("raw_value").rlike(r"^(?:\"(?:\\[\s\S]|[^\"\\])*+\"|'[^']*+')(?:\s*(?:#.*)?)$")
    inside = F.regexp_extract("raw_value", r"^\"((?:\\[\s\S]|[^\"\\])*+)\"", 1)
    value = F.when(quoted & closed & (quote == "'"), F.regexp_extract("raw_value", r"^'([^']*)'", 1)).when(quoted & closed, F.replace(F.replace(inside, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))).when(quoted, F.col("raw_value")).otherwise(F.trim(F.regexp_replace("raw_value", r"(^|\s)#.*$", "")))
    error = (
        F.when(F.col("is_comment"), None).when(F.contains("line", F.lit("\ufffd")), CODES["invalid_utf8"]).when(F.col("eq") == 0, CODES["other"]).when(F.trim("key") == "", CODES["empty_key"]).when(F.trim("key") != F.col("key"), CODES["whitespace"])
        .when(F.col("raw_value").startswith("="), CODES["double_equals"]).when(~F.col("key").rlike(r"\A[A-Za-z_][A-Za-z0-9_.]*\z"), CODES["invalid_key"]).when(quoted & ~closed, CODES["unclosed_quote"])
    )
    sc = F.length("line") - F.length("body")
    out = lines.select("file_id", F.col("sl").alias("ord"), F.trim("key").alias("key"), "raw_value", value.alias("value"), "is_comment", error.alias("error_code"), "sl", sc.alias("sc"), (sc + F.length(F.trim("key"))).alias("ec"), "eq", "line")
    place = F.when(F.col("error_code") == CODES["invalid_utf8"], F.instr("line", "\ufffd") - 1).when(F.col("error_code") == CODES["double_equals"], F.col("sc") + F.col("eq")).when(F.col("error_code") == CODES["whitespace"], F.col("ec")).when(F.col("error_code") == CODES["empty_key"], F.col("sc") + F.col("eq") - 1).otherwise(F.col("sc"))
    return out.withColumn("error_at", F.when(F.col("error_code").isNotNull(), place)).drop("eq", "line")


def keys(files: DataFrame) -> DataFrame:
    """The distinct (file_id, key, value) of pairs without an error; of a repeated key the last one counts."""
    good = entries(files).where(~F.col("is_comment") & F.col("error_code").isNull())
    return good.groupBy("file_id", "key").agg(F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))
