"""Schemas of the tables the operators exchange, and the severity scale."""

from pyspark.sql import Column, functions as F, types as T

# Severity names and their order.
SEVERITY_RANK = {"WARNING": 1, "ERROR": 2, "CRITICAL": 3}

LINES = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("module", T.StringType()),
    T.StructField("pipeline", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("line_no", T.LongType(), False),
    T.StructField("line", T.StringType(), False),
])

FINDINGS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("module_name", T.StringType()),
    T.StructField("pipeline_name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("finding_index", T.LongType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("line_start", T.LongType()),
    T.StructField("line_end", T.LongType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("excerpt", T.ArrayType(T.StringType())),
    T.StructField("anomaly_flag", T.BooleanType()),
    T.StructField("needs_llm", T.BooleanType()),
    T.StructField("llm_provider", T.StringType()),
    T.StructField("llm_model", T.StringType()),
    T.StructField("llm_response_content", T.StringType()),
    T.StructField("llm_error", T.StringType()),
    T.StructField("llm_prompt_tokens", T.LongType()),
    T.StructField("llm_completion_tokens", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

DOC_CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("repo_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("heading", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("commit_hash", T.StringType()),
    T.StructField("metadata", T.StructType([
        T.StructField("file_extension", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("char_count", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
    ])),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

MODULES = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("path", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("pipeline", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("stale_after_minutes", T.LongType()),
    T.StructField("llm_enabled", T.BooleanType()),
    T.StructField("provider_name", T.StringType()),
    T.StructField("max_output_tokens", T.LongType()),
])

PROVIDERS = T.StructType([
    T.StructField("provider", T.StringType(), False),
    T.StructField("api_base", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("provider_max_tokens", T.LongType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
])


def rank_of(name: str) -> int:
    """Rank of a severity name, in any case; an unknown name is an error."""
    try:
        return SEVERITY_RANK[name.upper()]
    except KeyError:
        raise ValueError(f"Unknown severity: {name}") from None


def severity_rank(severity: Column) -> Column:
    """Rank of a severity column; NULL for names outside the scale."""
    upper = F.upper(severity)
    out = F.when(upper == "WARNING", 1)
    return out.when(upper == "ERROR", 2).when(upper == "CRITICAL", 3)


def conform(df, schema: T.StructType):
    """Columns of `schema`, in order, cast; absent ones become NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])
