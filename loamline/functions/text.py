"""Column expressions on source and configuration text. Null in, null out unless said otherwise."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions.paths import suffix

#: A fully qualified class name (package segments in lower case, then types), and a bean reference in XML.
CLASS_NAME = r"(?U)(?<![\w$.])((?:[a-z_][a-z0-9_]*\.)+[A-Z][\w$]*(?:\.[A-Z][\w$]*)*)(?![\w$])"
BEAN_REFERENCE = r"(?U)(?<![\w-])(?:[\w:.-]*-ref|ref|bean|depends-on)\s*=\s*\"([A-Za-z_]\w*)\""
#: Words that open a type declaration, and how each kind is named.
KINDS = (("@interface", "ANNOTATION"), ("interface", "INTERFACE"), ("enum", "ENUM"), ("record", "RECORD"), ("class", "CLASS"))
#: Beginnings of lines that change nothing.
TRIVIAL_LINES = ("//", "/*", "*", "*/", "import ", "package ")

LINE_END = r"\R"
CONTEXT_CHARS = 160


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def package_declared(source: Column | str) -> Column:
    """The package that Java source names; empty if none."""
    return F.regexp_extract(source, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)


def type_kind(source: Column | str, name: Column | str) -> Column:
    """Kind of the named type in Java source, comments left out; CLASS if it isn't found."""
    code = F.regexp_replace(source, r"(?s)/\*.*?\*/|//[^\n]*", "")
    out = F.lit("CLASS")
    for word, kind in reversed(KINDS):
        pattern = F.concat(F.lit(r"(?<![\w@])" + word + r"\s+\Q"), _col(name), F.lit(r"\E\b"))
        out = F.when(F.call_function("rlike", code, pattern), kind).otherwise(out)
    return out


def lines_of_code(source: Column | str) -> Column:
    return F.size(F.filter(F.split(source, LINE_END), lambda line: F.trim(F.regexp_replace(line, r"\s", "")) != ""))


def is_meaningful_line(line: Column | str) -> Column:
    s = F.trim(line)
    out = s != ""
    for p in TRIVIAL_LINES:
        out = out & ~s.startswith(p)
    return out


def _blank(text: Column, comment: str) -> Column:
    """The text with each comment replaced by the line ends in it."""
    parts = F.split(text, comment, -1)
    ends = F.transform(F.regexp_extract_all(text, F.lit(comment), F.lit(0)), lambda m: F.regexp_replace(m, r"[^\n]+", ""))
    return F.array_join(F.zip_with(parts, ends, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def strip_comments(path: Column | str, text: Column | str) -> Column:
    """Configuration text without comments; every line keeps its number."""
    t, end = _col(text), suffix(path)

    def plain(line: Column) -> Column:
        s = F.regexp_replace(line, r"^\s+", "")
        yaml = end.isin(".yml", ".yaml") & line.contains(" #")
        return F.when(s.startswith("#") | s.startswith("!"), "").when(yaml, F.substring_index(line, " #", 1)).otherwise(line)

    return (
        F.when(end == ".xml", _blank(t, "(?s)<!--.*?-->"))
        .when(end.isin(".gradle", ".kts"), _blank(t, r"(?s)/\*.*?\*/|//[^\n]*"))
        .otherwise(F.array_join(F.transform(F.split(t, LINE_END), plain), "\n"))
    )


def package_of(name: Column | str) -> Column:
    """The segments before the first that begins with a capital."""
    parts = F.split(name, r"\.")
    at = F.array_position(F.transform(parts, lambda x: x.rlike(r"^\p{Lu}")), True)
    return F.array_join(F.when(at > 0, F.slice(parts, F.lit(1), (at - 1).cast("int"))).otherwise(parts), ".")


def bean_name(simple: Column | str) -> Column:
    """A type's default bean name: first letter small, unless the first two characters are upper case."""
    s = _col(simple)
    upper = s.rlike(r"^(\p{Lu}[^\p{Ll}\p{Lt}]|[^\p{Ll}\p{Lt}]\p{Lu})")
    return F.when(upper, s).otherwise(F.concat(F.lower(F.substr(s, F.lit(1), F.lit(1))), F.substr(s, F.lit(2))))


def numstat_count(value: Column | str) -> Column:
    """A line count of a change listing, where `-` stands for none."""
    return F.when(_col(value) == "-", 0).otherwise(_col(value).cast("bigint"))


def faulty_lines(diff: Column | str) -> Column:
    """Old line numbers of meaningful deleted lines in a diff without context.

    A deleted line that begins with `--` looks like a file header; it isn't reported and its number isn't counted.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        hunk = F.regexp_extract(line, r"^@@ -(\d+)", 1)
        gone = line.startswith("-") & ~line.startswith("---")
        hit = gone & is_meaningful_line(F.substr(line, F.lit(2)))
        at = F.when(hunk != "", F.coalesce(F.nullif(hunk, F.lit("")).cast("int"), F.lit(0))).when(gone, acc["at"] + 1).otherwise(acc["at"])
        return F.struct(at.alias("at"), F.when(hit, F.concat(acc["found"], F.array(acc["at"]))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.split(diff, "\n"), start, step, lambda acc: acc["found"])
