"""Column expressions on file paths. Null in, null out."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source roots in the order in which they are tried; the last two hold for tests and old layouts.
SOURCE_ROOTS = ("src/main/java/", "src/test/java/", "src/java/", "src/test/")
TEST_ROOTS = ("src/test/java/", "src/test/")

#: Suffixes of configuration files, and the patterns that sort them.
CONFIG_SUFFIXES = (".properties", ".yml", ".yaml", ".xml", ".factories", ".imports", ".gradle", ".kts")
SERVICES_DIR = "META-INF/services/"
IGNORED = (
    r"(^|/)[\w.-]*docs?/|(^|/)src/site/|(^|/)changes\.xml$"
    r"|(^|/)messages[^/]*\.properties$"
    r"|(^|/)(\.[\w-]+|target|node_modules)/"
)
RUNTIME = (
    r"(^|/)src/main/(resources|webapp|config)/"
    r"|(^|/)(application|bootstrap)[\w-]*\.(ya?ml|properties)$"
    r"|(^|/)META-INF/(services/|spring\.factories$|spring/[^/]+\.imports$)"
)
BUILD = (
    r"(^|/)(pom|build|maven|project)[\w-]*\.xml$"
    r"|(^|/)(project|default|build|sonar-project)\.properties$"
    r"|\.gradle(\.kts)?$|(^|/)gradle/wrapper/"
    r"|checkstyle|pmd|spotbugs|findbugs|(^|/)sb-excludes"
    r"|(^|/)src/(conf|assembly|main/assembly|release-tools)/"
)
TEST = r"(^|/)src/test/"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_posix(path: Column | str) -> Column:
    return F.translate(path, "\\", "/")


def component_of_path(path: Column | str) -> Column:
    """The type that a Java file below a source root declares by its place; null for anything else."""
    p = to_posix(path)
    below = []
    for root in SOURCE_ROOTS:
        at = F.instr(p, "/" + root)
        below.append(F.when(p.startswith(root), F.substr(p, F.lit(len(root) + 1))).when(at > 0, F.substr(p, at + len(root) + 1)))
    java = p.endswith(".java") & ~F.regexp_extract(p, "[^/]*$", 0).isin("package-info.java", "module-info.java")
    return F.when(java, F.translate(F.regexp_replace(F.coalesce(*below), r"\.java$", ""), "/", "."))


def module_of_path(path: Column | str) -> Column:
    """What precedes the first source root that isn't at the start; null at the top."""
    p = to_posix(path)
    return F.coalesce(*[F.when(F.instr(p, "/" + r) > 1, F.substr(p, F.lit(1), F.instr(p, "/" + r) - 1)) for r in SOURCE_ROOTS])


def is_test_path(path: Column | str) -> Column:
    p = to_posix(path)
    out = F.lit(False)
    for r in TEST_ROOTS:
        out = out | p.startswith(r) | p.contains("/" + r)
    return out


def suffix(path: Column | str) -> Column:
    """The last suffix of the file name; none for a name that only begins with a dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def config_category(path: Column | str) -> Column:
    """RUNTIME, TEST or BUILD for a file that applications or build tools read; null if it isn't one."""
    p = _col(path)
    services = p.startswith(SERVICES_DIR) | p.contains("/" + SERVICES_DIR)
    scanned = services | suffix(p).isin(*CONFIG_SUFFIXES)
    scanned = scanned & ~((suffix(p) == ".kts") & ~p.endswith(".gradle.kts")) & ~p.rlike(IGNORED)
    return F.when(scanned, F.when(p.rlike(BUILD), "BUILD").when(p.rlike(TEST), "TEST").when(p.rlike(RUNTIME), "RUNTIME"))


def reference_kind(path: Column | str) -> Column:
    """What a class name in the file stands for."""
    p = _col(path)
    return (
        F.when(p.startswith(SERVICES_DIR) | p.contains("/" + SERVICES_DIR), "SERVICE_LOADER")
        .when(p.endswith(".factories") | p.endswith(".imports"), "AUTO_CONFIGURATION")
        .otherwise("CLASS_NAME")
    )


def owner_and_name(url: Column | str) -> Column:
    """`owner/name` of a repository's address, with or without `.git`; null if it isn't one."""
    found = F.regexp_extract(F.trim(url), r"^(?:https?://|git@)[^/:]+[/:]([\w.-]+/[\w.-]+?)(?:\.git)?/?$", 1)
    return F.when(found != "", found)
