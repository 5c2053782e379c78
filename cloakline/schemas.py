"""Fixed StructTypes for the tables the engine reads and writes."""

from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("span", T.StringType()),
    T.StructField("phi_type", T.StringType()),
])

SAMPLES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("phi_spans", T.ArrayType(SPAN)),
])

PATTERNS = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("pattern_seq", T.IntegerType()),
    T.StructField("regex", T.StringType()),
    T.StructField("phi_type", T.StringType()),
    T.StructField("abstraction_role", T.StringType()),
    T.StructField("hits", T.LongType()),
    T.StructField("misses", T.LongType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("promoted", T.BooleanType()),
    T.StructField("last_updated", T.DateType()),
])

DETECTIONS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("span", T.StringType()),
    T.StructField("phi_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("has_pattern", T.BooleanType()),
])

REPLIES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("raw", T.StringType()),
])

ENTITIES = T.StructType([
    T.StructField("system", T.StringType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("entity_type", T.StringType()),
])

VAULT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("token_id", T.StringType()),
    T.StructField("key_id", T.StringType()),
    T.StructField("ciphertext", T.BinaryType()),
    T.StructField("original_len", T.IntegerType()),
])

KEYS = T.StructType([
    T.StructField("key_id", T.StringType()),
    T.StructField("key", T.BinaryType()),
])

FEEDBACK = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("correct", T.BooleanType()),
])

VALIDATION = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("is_clean", T.BooleanType()),
    T.StructField("is_fluent", T.BooleanType()),
    T.StructField("is_accurate", T.BooleanType()),
    T.StructField("leaked_spans", T.ArrayType(T.StringType())),
    T.StructField("over_encrypted", T.ArrayType(T.StringType())),
    T.StructField("cache_hits", T.IntegerType()),
])

PARAMS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("sensitivity", T.DoubleType()),
    T.StructField("phi_types_focus", T.ArrayType(T.StringType())),
    T.StructField("min_confidence", T.DoubleType()),
])

# JSON shapes of the model replies (SRC-5)
DETECT_REPLY = T.ArrayType(T.StructType([
    T.StructField("span", T.StringType()),
    T.StructField("phi_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("has_pattern", T.BooleanType()),
]))
LEAKAGE_REPLY = T.StructType([
    T.StructField("leaked_spans", T.ArrayType(T.StringType())),
    T.StructField("is_clean", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
])
FLUENCY_REPLY = T.StructType([
    T.StructField("is_fluent", T.BooleanType()),
    T.StructField("fluency_score", T.DoubleType()),
    T.StructField("reason", T.StringType()),
])
OVERENC_REPLY = T.StructType([
    T.StructField("over_encrypted", T.ArrayType(T.StringType())),
    T.StructField("is_accurate", T.BooleanType()),
])