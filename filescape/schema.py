"""Schema of stored listings."""

from pyspark.sql import types as T

# A cloud-drive listing: one row per file or folder, linked by parent id.
MANIFEST = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("parent_id", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("md5", T.StringType()),
        T.StructField("modified_time", T.StringType()),
        T.StructField("trashed", T.BooleanType()),
    ]
)
