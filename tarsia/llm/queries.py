"""The queries of this subpackage and the SQL that some of them are held against."""

from . import chat, html, jaccard, language, media, mixing, neighbours, packing, periods, private, ranking, urlfilter, warc

MODULES = (packing, chat, warc, neighbours, jaccard, html, urlfilter, mixing, media, language, periods, private, ranking)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
