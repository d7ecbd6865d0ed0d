"""Text expressions. White space and word classes are Unicode-aware throughout."""

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def strip(c) -> Column:
    """Both ends freed of any Unicode white space (``trim`` takes blanks only)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def collapse(c) -> Column:
    return strip(F.regexp_replace(_c(c), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """HTML5 character references; no built-in knows the full table."""
    return s.map(html.unescape, na_action="ignore")


def strip_tags(c) -> Column:
    """Tags to blanks, references decoded, white space collapsed."""
    return collapse(html_unescape(F.regexp_replace(_c(c), "<[^>]+>", " ")))


def drop_scripts(c) -> Column:
    return F.regexp_replace(_c(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")


def html_to_text(c) -> Column:
    return strip_tags(drop_scripts(c))


def clean_rationale(c, limit: int = 300) -> Column:
    """Printable characters only, white space collapsed, cut to ``limit``."""
    return F.left(collapse(F.regexp_replace(_c(c), r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^\s]]", "")), F.lit(limit))


def unfence(c) -> Column:
    """A reply without its Markdown code fence."""
    return strip(F.regexp_replace(strip(c), r"(?iU)^```(?:json)?\s*|\s*```$", ""))


def markdown_cell(c) -> Column:
    return strip(F.replace(F.replace(_c(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def secondary_suffix(topics) -> Column:
    topics = _c(topics)
    return F.when(F.size(topics) > 0, F.concat(F.lit(" · also "), F.array_join(F.sort_array(topics), ", "))).otherwise("")


def safe_source_name(c) -> Column:
    """A source name for logs that must not reveal it."""
    return F.concat(F.lit("src#"), F.left(F.sha2(_c(c), 256), F.lit(8)))


def redacted_error(kind, message) -> Column:
    return F.concat(_c(kind), F.lit(": msg#"), F.left(F.sha2(_c(message), 256), F.lit(8)))
