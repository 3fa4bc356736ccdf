"""All registered queries of this subpackage, with SQL where SQL can express them."""

from . import clustering, decontaminate, langid, lexical_search, license_scan, line_dedup, near_dedup, packing, quality, substring_dedup, token_files, url_filter, warc

MODULES = (substring_dedup, near_dedup, langid, token_files, quality, packing, url_filter, warc, line_dedup, decontaminate, clustering, lexical_search, license_scan)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
