"""The queries of the training-data operators, and their SQL equivalents."""

from . import bytebpe, fmindex, jaccard, langid, licenses, neighbours, packing, quality, rangecoder, simhash, suffixes, vectorcodes, whitening

_MODULES = (neighbours, rangecoder, packing, licenses, langid, bytebpe, fmindex, suffixes, quality, jaccard, vectorcodes, simhash, whitening)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
