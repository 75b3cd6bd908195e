"""Row types."""

from pyspark.sql import types as T

SAMPLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("query", T.StringType()),
    T.StructField("ground_truth", T.StringType()), T.StructField("is_content_url", T.BooleanType()),
])
CHUNKS = T.ArrayType(T.StructType([T.StructField("chunkid", T.StringType()), T.StructField("chunkcontent", T.StringType())]))
#: prediction is an object or a text: kind says which, json and text hold it.
PREDICTION_VALUE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("json", T.StringType()), T.StructField("text", T.StringType())])
PREDICTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("ground_truth", T.StringType()),
    T.StructField("prediction", T.StringType()), T.StructField("filtered_html", T.StringType()), T.StructField("content", T.StringType()),
])
SWDE_LABELS = T.StructType([T.StructField(c, T.StringType()) for c in ("website_id", "website_name", "schema", "gt")])
WEBSRC_PAGES = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "website", "html", "domain")])
WEBSRC_QUESTIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "question", "answer", "element_id", "answer_start")])
COUNTERS = "website string, field string, page_hits long, extracted_pages long, ground_truth_pages long"
