"""Training-data operators: each module holds one operator, its query and,
where SQL can express it, its DuckDB text.  Nothing outside this folder (and
``corpus_pipeline.py``) imports it."""
