"""What a commit's subject says: cosmetic change or bug fix. A null subject is neither."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of cosmetic changes.
COSMETIC = (
    r"javadoc",
    r"doclint",
    r"@(see|since|link|param|throws|return|deprecated)\b",
    r"(fix(ed|es|ing)?|typos?\s+in|spelling\s+in|update[ds]?)\s+(the\s+|some\s+|inline\s+)?comments?",
    r"typos?",
    r"spelling",
    r"grammar",
    r"checkstyle",
    r"\bpmd\b",
    r"spotbugs",
    r"findbugs",
    r"sonar\w*",
    r"raw\s+types?",
    r"warnings?\b",
    r"reformat\w*",
    r"code\s+(format\w*|style)",
    r"source\s+code\s+formatting",
    r"format(ting)?\s+(tweaks?|fix(es)?|changes?|only)",
    r"(fix(ed|es|ing)?|minor|some|weird)\s+(some\s+|weird\s+)?formatting\b(?!\s+(in|of|for)\b)",
    r"trailing\s+(white)?spaces?",
    r"(fix(ed|es)?|remove[ds]?|clean\s?up)\s+whitespaces?",
    r"whitespaces?\s+(fix(es)?|changes?|only|cleanup)",
    r"indent(ation|s)?\b",
    r"tabs?\s+to\s+spaces",
    r"unused\s+imports?",
    r"organi[sz]e\s+imports",
    r"wildcard\s+imports?",
    r"(fix(ed)?|remove[ds]?)\s+imports?\b",
    r"licen[cs]e",
    r"sort(ed)?\s+members",
    r"use\s+final",
    r"final\s+(keyword|modifier)s?",
    r"(remov(e[ds]?|ing)|add(ed|ing)?)\s+(lots\s+of\s+|some\s+|unnecessary\s+|redundant\s+)?finals?\b",
    r"(unnecessary|redundant)\s+finals?\b",
)
#: Words of bug fixes.
BUG_FIX = r"\b(fix(e[sd]|ing)?|bugs?|bugfix|regression|broken|crash(es|ed)?|incorrect(ly)?|wrong(ly)?|defect|fault)\b"
#: Chinese words, which stand anywhere in a subject.
COSMETIC_CJK = r"注释|格式化|代码格式|错别字"
BUG_FIX_CJK = r"修复|修正|解决"


def is_cosmetic(subject: Column | str) -> Column:
    s = F.coalesce(subject, F.lit(""))
    return s.rlike(r"(?iU)\b(" + "|".join(COSMETIC) + ")") | s.rlike(COSMETIC_CJK)


def is_bug_fix(subject: Column | str) -> Column:
    s = F.coalesce(subject, F.lit(""))
    return (s.rlike("(?iU)" + BUG_FIX) | s.rlike(BUG_FIX_CJK)) & ~is_cosmetic(subject)
