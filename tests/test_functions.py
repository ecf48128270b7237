import pytest
from pyspark.sql import functions as F

from loamline.functions import ids, paths, subjects, text
from loamline.operators import config


def values(spark, rows, column, name="x"):
    df = spark.createDataFrame([(r,) for r in rows], f"{name} string")
    return [r[0] for r in df.select(column).collect()]


def test_component_of_path(spark):
    rows = {
        "src/main/java/com/shop/Cart.java": "com.shop.Cart",
        "mod/src/test/java/com/shop/CartTest.java": "com.shop.CartTest",
        "src\\main\\java\\com\\A.java": "com.A",
        "src/java/org/B.java": "org.B",
        "a/src/test/org/B.java": "org.B",
        "src/main/java/com/package-info.java": None,
        "src/main/java/module-info.java": None,
        "src/main/java/com/A.kt": None,
        "lib/A.java": None,
        None: None,
    }
    assert values(spark, list(rows), paths.component_of_path("x")) == list(rows.values())


def test_module_and_test(spark):
    rows = ["pay/src/main/java/A.java", "src/main/java/A.java", "a/b/src/test/java/A.java", "x/y.txt", None]
    assert values(spark, rows, paths.module_of_path("x")) == ["pay", None, "a/b", None, None]
    assert values(spark, rows, paths.is_test_path("x")) == [False, False, True, False, None]


@pytest.mark.parametrize(
    "path, category",
    [
        ("src/main/resources/beans.xml", "RUNTIME"),
        ("application-prod.yml", "RUNTIME"),
        ("src/main/resources/META-INF/services/com.x.Api", "RUNTIME"),
        ("src/test/resources/context.xml", "TEST"),
        ("pom.xml", "BUILD"),
        ("build.gradle", "BUILD"),
        ("settings.gradle.kts", "BUILD"),
        ("script.kts", None),
        ("src/test/resources/checkstyle.xml", "BUILD"),
        ("docs/conf.xml", None),
        ("src/main/resources/messages_de.properties", None),
        (".github/x.yml", None),
        (".properties", None),
        ("src/main/resources/A.java", None),
        (None, None),
    ],
)
def test_config_category(spark, path, category):
    assert values(spark, [path], paths.config_category("x")) == [category]


def test_subjects(spark):
    cosmetic = ["Fix javadoc of X", "fix typo", "Remove unused imports", "格式化代码", "minor formatting", "Checkstyle", "removed lots of finals"]
    fixes = ["Fix NPE in X", "修复 X 空指针", "Correct wrong total", "fixed formatting of dates", "crashes on start"]
    other = ["Add messages when throwing NullPointerException", "prefix lookup", "", None, "解释"]
    for rows, c, b in ((cosmetic, True, False), (fixes, False, True), (other, False, False)):
        assert values(spark, rows, subjects.is_cosmetic("x")) == [c] * len(rows), rows
        assert values(spark, rows, subjects.is_bug_fix("x")) == [b] * len(rows), rows


def test_source_functions(spark):
    src = "// class Cart\npackage com.shop;\n\n/* interface Cart */\npublic @interface Cart {\n  class CartX {}\n}\n"
    assert values(spark, [src], text.package_declared("x")) == ["com.shop"]
    assert values(spark, [src, "enum Cart {}", "x"], text.type_kind("x", F.lit("Cart"))) == ["ANNOTATION", "ENUM", "CLASS"]
    assert values(spark, [src, "", " \n\t"], text.lines_of_code("x")) == [6, 0, 0]
    assert values(spark, ["a", "  // x", "import a;", "", " * x", "}"], text.is_meaningful_line("x")) == [True, False, False, False, False, True]
    assert values(spark, ["-", "12"], text.numstat_count("x")) == [0, 12]


def test_strip_comments_keeps_lines(spark):
    df = spark.createDataFrame(
        [
            ("a.xml", "<a/><!-- x\ny --><b/>\n<c/>", "<a/>\n<b/>\n<c/>"),
            ("a.xml", "", ""),
            ("b.gradle", "x // y\n/* a\n*/z", "x \n\nz"),
            ("c.yml", "a: b # c\n  # d\n!e\nf#g", "a: b\n\n\nf#g"),
            ("d.properties", "#x\n a=1 # kept\r\nb", "\n a=1 # kept\nb"),
        ],
        "p string, t string, want string",
    )
    for r in df.withColumn("got", text.strip_comments("p", "t")).collect():
        assert r["got"] == r["want"], r


def test_names(spark):
    assert values(spark, ["org.x.Foo$Bar", "Foo", "a.b", ""], text.package_of("x")) == ["org.x", "", "a.b", ""]
    assert values(spark, ["FooBar", "URLReader", "S3Client", "A", "x", ""], text.bean_name("x")) == ["fooBar", "URLReader", "S3Client", "a", "x", ""]


def test_faulty_lines(spark):
    diff = "--- a/A\n+++ b/A\n@@ -10 +10 @@\n-  int x = 1;\n+  int x = 2;\n@@ -29,3 +30 @@ m()\n-// note\n-  call();\n-\n+x"
    assert values(spark, [diff, ""], text.faulty_lines("x")) == [[10, 30], []]


def test_ids(spark):
    df = spark.sql("select timestamp'2024-01-02 03:04:05' as a, timestamp'2024-01-02 03:04:05.000120' as b, cast(null as string) as n")
    r = df.select(ids.iso_time("a"), ids.iso_time("b"), ids.evidence_id([F.lit("a"), F.col("n"), F.lit("c")])).first()
    import hashlib

    assert list(r) == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000120+00:00", "ev_" + hashlib.sha1(b"a||c").hexdigest()[:16]]


def test_tokens_and_resolution(spark):
    files = [
        ("r", "src/main/resources/b.xml", '<bean class="com.shop.Cart$Item" ref="cart"/>\n<!-- com.shop.Hidden -->\n<x a="com.shop.Cart.Inner com.gone.Old com.lib.sub.X"/>'),
        ("r", "META-INF/services/com.shop.Api", "com.shop.impl.ApiImpl # x\n"),
        ("r", "src/main/resources/n.properties", None),
    ]
    f = spark.createDataFrame(files, "repo_id string, path string, text string")
    comps = spark.createDataFrame([("r", c) for c in ("com.shop.Cart", "com.shop.Api", "com.shop.a.Clash", "com.shop.b.Clash", "TopLevel")], "repo_id string, component_id string")
    known = spark.createDataFrame([("r", "com.gone.Dead")], "repo_id string, component_id string")
    t = config.resolve(config.tokens(f, ["repo_id"]), comps, ["repo_id"], known)
    got = {(r["token"], r["line"], r["kind"]): (r["resolution"], r["component_id"]) for r in t.collect()}
    assert got == {
        ("com.shop.Cart$Item", 1, "CLASS_NAME"): ("RESOLVED", "com.shop.Cart"),
        ("cart", 1, "BEAN_REFERENCE"): ("RESOLVED", "com.shop.Cart"),
        ("com.shop.Cart.Inner", 3, "CLASS_NAME"): ("RESOLVED", "com.shop.Cart"),
        ("com.gone.Old", 3, "CLASS_NAME"): ("UNRESOLVED", None),
        ("com.lib.sub.X", 3, "CLASS_NAME"): ("EXTERNAL", None),
        ("com.shop.Api", None, "SERVICE_INTERFACE"): ("RESOLVED", "com.shop.Api"),
        ("com.shop.impl.ApiImpl", 1, "SERVICE_LOADER"): ("UNRESOLVED", None),
    }


def test_owner_and_name(spark):
    urls = ["https://host.example/own/name.git", "git@host.example:own/na.me", "https://host.example/own/name/", "own/name", "https://host.example/x", None]
    assert values(spark, urls, paths.owner_and_name("x")) == ["own/name", "own/na.me", "own/name", None, None, None]
