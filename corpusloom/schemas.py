"""Table schemas of the engine."""

from pyspark.sql import types as T

ENTRIES = T.StructType([
    T.StructField("repo", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("is_dir", T.BooleanType(), False),
    T.StructField("content", T.BinaryType(), True),
])

EDIT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("original", T.StringType()),
    T.StructField("replacement", T.StringType()),
    T.StructField("context_line", T.StringType()),
    T.StructField("insertion", T.StringType()),
    T.StructField("content", T.StringType()),
])

RULE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("applies_to", T.ArrayType(T.StringType())),
])

STANDARDS = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("format_on_enforce", T.BooleanType()),
    T.StructField("lint_on_enforce", T.BooleanType()),
    T.StructField("lint_fix_on_enforce", T.BooleanType()),
    T.StructField("languages", T.MapType(T.StringType(), T.StructType([
        T.StructField("formatter", T.StringType()),
        T.StructField("linter", T.StringType()),
        T.StructField("llm_rules", T.ArrayType(RULE)),
    ]))),
    T.StructField("llm_rules_general", T.ArrayType(RULE)),
])

RESPONSES = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
])
