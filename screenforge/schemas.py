"""Fixed schemas of the tables that are read and written."""

from pyspark.sql import types as T

APPLICATION = T.StructType(
    [
        T.StructField("application_id", T.LongType()),
        T.StructField("applied_at", T.TimestampNTZType()),
        T.StructField("role_raw", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("experience_raw", T.StringType()),
    ]
)

CANDIDATE = T.StructType(
    [
        T.StructField("application_id", T.LongType()),
        T.StructField("applied_at", T.TimestampNTZType()),
        T.StructField("role", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("experience", T.DoubleType()),
    ]
)

# A stored candidate may carry the vector of its skills, so that no search computes it again.
VECTOR = T.StructField("vector", T.ArrayType(T.DoubleType()))
CANDIDATE_WITH_VECTOR = T.StructType([*CANDIDATE.fields, VECTOR])

# CSV cannot hold arrays; the list is written as its literal text.
CANDIDATE_CSV = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name == "skills" else f.dataType) for f in CANDIDATE.fields]
)

# Every field as text: a number, a list or a string must all survive the parse.
REPLY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "email", "phone", "location", "skills", "experience", "error")]
)

# A message of the outbox as its writer made it, and a sender's report on one attempt.
MESSAGE = T.StructType(
    [T.StructField("request_id", T.LongType()), T.StructField("position", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("email", "name", "subject", "plain", "html", "status", "error")]
    + [T.StructField("written_at", T.TimestampNTZType())]
)
REPORT = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("reported_at", T.TimestampNTZType()),
    ]
)
