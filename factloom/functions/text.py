"""Column expressions on text, names, confidences and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns. `\s` is Unicode's with the flag (?U).
NAME_FILLERS = r"(?U)[\s\-‐‑–—_·.()（）]+"
CJK = r"㐀-鿿"
INTERNAL_ID = r"(?i)(?<![A-Za-z0-9_])[en]\d{4,}(?![A-Za-z0-9_])"
EXTERNAL_CONTEXT = (
    r"(?i)子图|知识图谱|图谱|(?:给定|所给|提供|上述)(?:的)?(?:资料|材料|信息)|(?:给定|所给|提供)(?:的)?事实|"
    r"事实编号|实体编号|边编号|(?:实体|边|事实)\s*ID|属性信息|未被证实|(?:图|表|文)中"
)
DEVELOPMENT = r"(?i)研制|研发|开发|设计|制造|生产|发明|develop|design|manufactur|invent"
COUNTERING = r"(?i)克制|反制|对抗|击毁|摧毁|打击|击穿|拦截|压制|抵御|反坦克|counter|defeat|destroy|intercept"
GENERIC_DEVELOPER = rf"^(?:[{CJK}]{{1,8}}国|[{CJK}]{{1,8}}国人|[{CJK}]{{1,8}}朝|(?:前)?苏联)$"


def folded(c: Column) -> Column:
    """Case folding: lower case, with the sharp s spelt out."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalize_name(c: Column) -> Column:
    """Without white space, dashes, underscores, dots and parentheses, case folded."""
    return folded(F.regexp_replace(c, NAME_FILLERS, ""))


def compact(c: Column) -> Column:
    """Without white space, case folded."""
    return folded(F.regexp_replace(c, r"(?U)\s+", ""))


def confidence(c: Column) -> Column:
    """A confidence given as text: within 0 and 1; 1 where missing, 0 where it is no number."""
    number = c.try_cast("double")
    return F.when(c.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0)))))


def paragraphs(c: Column) -> Column:
    """The cleaned paragraphs of a text, blank ones left out."""
    text = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ 　]", " ")
    return F.filter(F.transform(F.split(text, r"\n[ \t]*\n+"), clean_line), lambda x: x != "")


def clean_line(c: Column) -> Column:
    """White space collapsed, and the spaces that character recognition puts into CJK text taken out."""
    line = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    for pattern, to in (
        (rf"(?<=[{CJK}]) +(?=[{CJK}A-Za-z0-9])", ""),
        (rf"(?<=[A-Za-z0-9]) +(?=[{CJK}])", ""),
        (r"(?<![A-Za-z])([A-Z]{1,4}) +(?=\d)", "$1"),
        (rf"(?<=[。！？]) +(?=[{CJK}])", ""),
    ):
        line = F.regexp_replace(line, pattern, to)
    return line


def preprocess(c: Column) -> Column:
    return F.array_join(paragraphs(c), "\n\n")


def content_id(content: Column) -> Column:
    """The document id of a file's bytes: the first 20 hexadecimal digits of their SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 20)


def chunk_id(doc_id: Column, stem: Column, index: Column) -> Column:
    return F.format_string("%s:%s:%04d", doc_id, stem, index)


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"[^/]*$", 0)


def difficulty(depth: Column) -> Column:
    return F.when(depth <= 1, "easy").when(depth == 2, "medium").otherwise("hard")


def leaks(c: Column) -> Column:
    """Whether a text that is to train a model names internal ids or the material it came from."""
    return F.coalesce(c.rlike(INTERNAL_ID) | c.rlike(EXTERNAL_CONTEXT), F.lit(False))


def canonical_answer(text: Column, labels: Column) -> Column:
    """A text answer stripped and folded; a list of labels stripped, folded, sorted and joined by commas."""
    many = F.array_join(F.array_sort(F.transform(labels, lambda x: folded(F.trim(x)))), ",")
    return F.when(labels.isNotNull(), many).otherwise(folded(F.trim(text)))
