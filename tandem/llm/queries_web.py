"""Queries of the url filter and of benchmark decontamination."""

from __future__ import annotations

from tandem.llm.decontaminate import contained
from tandem.llm.url_filter import judge


def op8_link_graph_url_filter(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_benchmark_containment(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contained(docs, items, k=5, share=0.8, short=True)
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


_WORDS = r"""regexp_extract_all(regexp_replace(lower(coalesce(text, '')),
  '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), '[\p{L}\p{N}]+')"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, hash(text) AS h, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, hash(text) AS h, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, h, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
si AS (SELECT DISTINCT item_id, h, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM i WHERE len(w) >= 5),
n AS (SELECT item_id, h, count(*) AS n_item FROM si GROUP BY ALL),
c AS (SELECT ds.doc_id, ds.h AS dh, si.item_id, si.h, count(*) AS n_shared FROM ds JOIN si USING (s) GROUP BY ALL),
short AS (SELECT DISTINCT item_id, h, ' ' || array_to_string(w, ' ') || ' ' AS s FROM i WHERE len(w) BETWEEN 1 AND 4),
whole AS (SELECT DISTINCT doc_id, h, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM c JOIN n USING (item_id, h) WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
UNION ALL
SELECT doc_id, item_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS DOUBLE) FROM whole JOIN short ON contains(whole.s, short.s)
"""

QUERIES = {"op8_link_graph_url_filter": op8_link_graph_url_filter, "op9_benchmark_containment": op9_benchmark_containment}
SQL = {"op9_benchmark_containment": OP9_SQL}
