"""Queries of the two operators on token ids."""

from __future__ import annotations

import public_tokenizers

from tandem.llm.packing import cut, pack
from tandem.llm.token_files import token_file_table


def op7_best_fit_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(cut(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0), capacity=2048)


def op10_token_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_file_table(docs, public_tokenizers.path("byte_bpe_50k.json"), byte_level=True, end_id=2)


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing, "op10_token_files": op10_token_files}
SQL: dict[str, str] = {}
