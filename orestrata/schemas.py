"""Fixed schemas: study records, vectors, model contracts."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_A = T.ArrayType(_S)
_MULTI = T.MapType(_S, _A)

TAG = T.StructType([T.StructField("name", _S), T.StructField("value", _S), T.StructField("raw", _S)])
SAMPLE = T.StructType([
    T.StructField("gsm", _S), T.StructField("title", _S), T.StructField("source_name", _S), T.StructField("organism", _S), T.StructField("molecule", _S),
    T.StructField("characteristics", T.ArrayType(TAG)), T.StructField("attributes", _MULTI)])
PLATFORM = T.StructType([T.StructField("gpl", _S), T.StructField("attributes", _MULTI)])

#: The fields of a canonical study record in their order.
RECORD = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("gse", _S), T.StructField("source_soft", _S), T.StructField("title", _S),
    T.StructField("summary", _S), T.StructField("overall_design", _S), T.StructField("type", _A), T.StructField("pubmed_ids", _A),
    T.StructField("submission_date", T.DateType()), T.StructField("last_update_date", T.DateType()), T.StructField("platform_ids", _A),
    T.StructField("n_samples", T.IntegerType()), T.StructField("organisms", _A), T.StructField("molecules", _A), T.StructField("source_names", _A),
    T.StructField("characteristics", T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("values", _A)]))),
    T.StructField("library_strategies", _A), T.StructField("library_sources", _A), T.StructField("library_selections", _A),
    T.StructField("organism_ids", _A), T.StructField("organism_status", _S), T.StructField("sex_ids", _A), T.StructField("sex_status", _S),
    T.StructField("assay_categories", _A), T.StructField("assay_labels", _A), T.StructField("assay_status", _S),
    T.StructField("sample_titles", _A), T.StructField("sample_accessions", _A), T.StructField("series_attributes", _MULTI),
    T.StructField("platforms", T.ArrayType(PLATFORM)), T.StructField("samples", T.ArrayType(SAMPLE)), T.StructField("embed_text", _S)])
#: What the search side keeps: all but the nested children and raw attributes.
INDEXED = [f.name for f in RECORD.fields if f.name not in ("samples", "platforms", "series_attributes", "sample_titles", "sample_accessions", "characteristics", "source_soft", "schema_version")]
VECTOR = T.StructType([T.StructField("id", _S), T.StructField("row", T.IntegerType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
#: Embedding models and their dimensions.
MODELS = {"bge_small_v15": 384, "medcpt_v1": 768, "qwen3_06b_1024_v1": 1024, "gemini_embedding_2_3072_v1": 3072}
