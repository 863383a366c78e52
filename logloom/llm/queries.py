"""The registered queries of the training-data operators, and their DuckDB twins."""

from __future__ import annotations

from . import ann, bpe, centroids, exact_dedup, html_extract, lexical_search, licenses, media, near_dedup, packing, secrets, toxicity, url_filter
from .common import table

QUERIES = {
    "op1_html_extraction": lambda s, d: html_extract.extract_pages(table(s, d, "pages")),
    "op2_nearest_neighbours": lambda s, d: ann.neighbours(table(s, d, "embeddings"), lambda vec_id: vec_id % 50 == 0),
    "op3_license_scan": lambda s, d: licenses.scan_licenses(table(s, d, "documents")),
    "op4_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op5_url_filter": lambda s, d: url_filter.filter_urls(table(s, d, "pages")),
    "op6_toxicity": lambda s, d: toxicity.score_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op7_secret_scan": lambda s, d: secrets.scan_secrets(table(s, d, "documents")),
    "op8_bpe": lambda s, d: bpe.round_trip(table(s, d, "documents")),
    "op9_media": lambda s, d: media.media_digests(table(s, d, "documents")),
    "op10_near_dedup": lambda s, d: near_dedup.near_duplicates(table(s, d, "documents")),
    "op11_exact_dedup": lambda s, d: exact_dedup.exact_duplicates(table(s, d, "documents")),
    "op12_centroid_clustering": lambda s, d: centroids.clusters(table(s, d, "embeddings")),
    "op13_lexical_search": lambda s, d: lexical_search.search(table(s, d, "documents"), table(s, d, "benchmark")),
}

ORACLES = {
    "op3_license_scan": licenses.oracle(),
    "op5_url_filter": url_filter.oracle(),
    "op11_exact_dedup": exact_dedup.oracle(),
    "op12_centroid_clustering": centroids.oracle(),
    "op13_lexical_search": lexical_search.oracle(),
}
