from pyspark.sql import functions as F

from catalign.functions.text import normalise_text, render_lines, render_properties, property_value, python_list_text


def _norm(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(normalise_text("t")).collect()]


def reference_rule(s):
    """The rule restated in plain Python for property checks."""
    if s is None:
        return None
    s = (s.replace("\n", "").replace("\t", " ").replace("-", " ").strip().lower()
         .replace("\\", " ").replace("/", " ").replace("  ", " ").replace('":', "").replace(",", " "))
    if any(len(w) > 20 for w in s.split()):
        return None
    c = "".join(ch for ch in s if ch not in ",\"'()\t _").strip()
    return None if len(c) < 2 or len(c) > 200 else s


def test_survey_examples(spark):
    vals = ['  Milk - 3%/fat, "whole":x ', "a", "(a)", "A-\n-B   C", None]
    assert _norm(spark, vals) == ["milk  3% fat  \"wholex", None, None, "a b  c", None]


def test_long_word_and_length(spark):
    vals = ["x" * 21, "x" * 20, "ab " * 80, "a" * 201, "  tea ", "café au lait"]
    assert _norm(spark, vals) == [reference_rule(v) for v in vals]


def test_matches_python_rule_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = docs.select("text", normalise_text("text").alias("n")).collect()
    assert all(reference_rule(r["text"]) == r["n"] for r in rows)


def test_render_lines_modes(spark):
    df = spark.createDataFrame([("milk", None, None), ("tea", "hot", "drinks")], "a string, b string, c string")
    lines = [("Name", "a", "required"), ("Hint", "b", "optional"), ("Local", "c", "none")]
    out = [r[0] for r in df.select(render_lines(lines)).collect()]
    assert out == ["Name: milk.\nLocal: None.", "Name: tea.\nHint: hot.\nLocal: drinks."]


def test_render_properties_skips_empty(spark):
    df = spark.createDataFrame([(0, "n", "", ["x", "y"]), (5, "", "s", [])], "id int, name string, cat string, names array<string>")
    out = [r[0] for r in df.select(render_properties([
        ("id", property_value(F.col("id"), "number")), ("name", property_value(F.col("name"))),
        ("category", property_value(F.col("cat"))), ("arabic_names", property_value(F.col("names"), "array"))])).collect()]
    assert out == ["name: n\narabic_names: ['x', 'y']", "id: 5\ncategory: s"]


def test_java_whitespace_class_equals_python(spark):
    from catalign.functions.text import NON_WS_JAVA
    rows = [(c, chr(c)) for c in range(0x3100) if not (0xD800 <= c <= 0xDFFF)]
    df = spark.createDataFrame(rows, "cp int, ch string")
    java_ws = {r.cp for r in df.filter(~F.col("ch").rlike("^" + NON_WS_JAVA + "$")).collect()}
    assert java_ws == {c for c, ch in rows if ch.isspace()}


def test_text_rule_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    alphabet = st.sampled_from(list("aZ-/\\,\"':()_\t\n x  　\x1cÉß") + ["w" * 25, "  ", '":'])
    texts = st.lists(st.lists(alphabet, max_size=30).map("".join), min_size=20, max_size=40)

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(texts)
    def check(values):
        assert _norm(spark, values) == [reference_rule(v) for v in values]

    check()


def test_staged_and_single_expression_forms_agree(spark):
    from catalign.functions.text import with_normalised_text
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = {r.doc_id: r.n for r in docs.select("doc_id", normalise_text("text").alias("n")).collect()}
    b = {r.doc_id: r.n for r in with_normalised_text(docs, "text", "n").select("doc_id", "n").collect()}
    assert a == b


def test_scan_is_spread_only_when_needed(spark, tmp_dir):
    from catalign.session import read_table
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(f"{tmp_dir}/one.parquet")
    spark.range(100).repartition(2 * cores).write.parquet(f"{tmp_dir}/many.parquet")
    assert read_table(spark, tmp_dir, "one", spread=True).rdd.getNumPartitions() == cores
    assert read_table(spark, tmp_dir, "one").rdd.getNumPartitions() == 1
    assert "Exchange" not in read_table(spark, tmp_dir, "many", spread=True)._jdf.queryExecution().executedPlan().toString()


def test_required_lines_print_none(spark):
    df = spark.createDataFrame([("milk", None), (None, "x")], "a string, b string")
    lines = [("Description", "a", "required"), ("Hint", "b", "optional")]
    got = [r[0] for r in df.select(render_lines(lines)).collect()]
    assert got == ["Description: milk.", "Description: None.\nHint: x."]
