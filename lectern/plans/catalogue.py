"""All registered queries of the engine's own operators, and their SQL."""

from lectern.operators import answercache, business, corpus, documents, extraction, forest, highlight, layout, lookup, overview, places, records, related, retrieval, textops, vectorindex, wordindex, workflow

_REGISTRIES = [m.query for m in (records, textops, extraction, corpus, retrieval, workflow, layout, lookup, vectorindex, forest, wordindex, places, related, answercache, highlight, overview)]

QUERIES = business.QUERIES | documents.QUERIES
ORACLES = business.ORACLES | documents.ORACLES
for _r in _REGISTRIES:
    QUERIES = QUERIES | _r.queries
    ORACLES = ORACLES | _r.oracles
