"""Registered queries of the library and their SQL."""

from tandem.plans import queries_corpus, queries_files, queries_numeric, queries_relations  # noqa: F401
from tandem.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

#: Columns that Spark numbers with 32 bits.
_INTEGERS = {
    "rank": ("bow_tfidf_top_terms", "vocabulary_view", "sim_topk_dense", "sim_topk_sparse", "transfer_retrieval", "token_retrieval", "sim_buckets"),
    "feature": ("top_features",),
    "new_feature": ("feature_report", "recode_vocab"),
}
for _column, _names in _INTEGERS.items():
    for _name in _names:
        SQL[_name] = f"SELECT * REPLACE (CAST({_column} AS INTEGER) AS {_column}) FROM ({SQL[_name]})"
